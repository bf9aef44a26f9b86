"""Installed packages, compiled requirements, conda environments and import names, JVM-side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import canonical_name
from tidemark.operators.graph import closure

#: Endings of compiled modules.
COMPILED = r"\.(so|pyd)$"


def _files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"))


def read_installed(spark: SparkSession, path: str) -> DataFrame:
    """SC10, SC16: (file, name, version, requires) of METADATA and PKG-INFO files; only the header counts."""
    files = _files(spark, path, "{METADATA,PKG-INFO}").withColumn("head", F.element_at(F.split("text", r"\n\s*\n", 2), 1))
    field = lambda n: F.nullif(F.trim(F.regexp_extract("head", rf"(?im)^{n}:[ \t]*(.*)$", 1)), F.lit(""))
    requires = F.transform(F.regexp_extract_all("head", F.lit(r"(?im)^Requires-Dist:[ \t]*(.*)$"), F.lit(1)), lambda r: F.trim(r))
    return files.select("file", canonical_name(field("Name")).alias("name"), field("Version").alias("version"), requires.alias("requires")).where("name is not null")


def read_conda_pip(spark: SparkSession, path: str, most_lines: int = 10_000) -> DataFrame:
    """SC7: (file, line, requirement) of the ``pip:`` lists of conda environment files.

    A list is the deeper "- " lines after "- pip:"; lines from ``most_lines`` on aren't read,
    as the format's readers do."""
    lines = _files(spark, path, "*.{yml,yaml}").select("file", F.posexplode(F.split("text", "\n")).alias("line", "raw")).where(F.col("line") < most_lines)
    lines = lines.withColumn("raw", F.regexp_replace("raw", r"(^|\s)#.*$", "")).where(F.trim("raw") != "")
    lines = lines.withColumns({"_in": F.length(F.regexp_extract("raw", r"^(\s*)", 1)), "_pip": F.col("raw").rlike(r"^\s*-\s*pip\s*:\s*$")})
    before = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    head = F.last(F.when(F.col("_pip"), F.struct("line", "_in")), ignorenulls=True).over(before)
    lines = lines.withColumn("_head", head).where("_head is not null and not _pip")
    inside = Window.partitionBy("file", "_head.line").orderBy("line")
    lines = lines.withColumn("_left", F.max((F.col("_in") <= F.col("_head._in")).cast("int")).over(inside)).where("_left = 0")
    text = F.regexp_replace(F.regexp_replace(F.trim("raw"), r"^-\s*", ""), r"^(['\"])(.*)\1$", "$2")
    return lines.select("file", "line", text.alias("requirement")).where("requirement <> ''")


def read_compiled(spark: SparkSession, path: str) -> DataFrame:
    """SC9: (file, name, via, direct) of compiled requirements.

    ``via`` has the entries of a requirement's "# via" comments, on its own line or below.  It is
    direct if one of them is an input file or if it has none; null where a file has none at all."""
    lines = _files(spark, path).select("file", F.posexplode(F.split(F.regexp_replace("text", r"\\\n", " "), "\n")).alias("line", "raw"))
    lines = lines.withColumns({"raw": F.trim("raw"), "_note": F.trim("raw").startswith("#")})
    name = F.when(~F.col("_note"), F.nullif(F.regexp_extract("raw", r"^([A-Za-z0-9][A-Za-z0-9._-]*)", 1), F.lit("")))
    after = Window.partitionBy("file").orderBy("line")
    lines = lines.withColumn("_own", name).withColumn("_at", F.last(F.when(~F.col("_note"), F.struct("line", "_own")), ignorenulls=True).over(after)).where("_at._own is not null")
    comment = F.when(F.col("_note"), F.col("raw")).otherwise(F.concat(F.lit("#"), F.regexp_extract("raw", r"\s#(.*)$", 1)))
    says = comment.rlike(r"^#\s*via\b")
    inside = Window.partitionBy("file", "_at.line").orderBy("line")
    # a block ends at the first comment without text
    lines = lines.withColumns({"_text": F.trim(F.regexp_replace(comment, r"^#\s*(via\b)?", "")), "_via": says})
    lines = lines.withColumn("_open", F.max(F.col("_via").cast("int")).over(inside) - F.max((F.col("_note") & ~F.col("_via") & (F.col("_text") == "")).cast("int")).over(inside))
    entries = F.filter(F.transform(F.split("_text", ","), lambda e: F.trim(e)), lambda e: e != "")
    entry = F.when((F.col("_open") == 1) & (F.col("_note") | F.col("_via")), entries)
    out = lines.groupBy("file", canonical_name(F.col("_at._own")).alias("name")).agg(F.array_distinct(F.flatten(F.collect_list(entry))).alias("via"))
    some = F.max(F.size("via") > 0).over(Window.partitionBy("file"))
    given = F.exists("via", lambda v: v.rlike(r"^-r\s|\.(in|toml|txt|cfg|py)\b|\("))
    return out.withColumn("direct", F.when(some, (F.size("via") == 0) | given))


def included_files(includes: DataFrame) -> DataFrame:
    """SC6, REC7: (root, file) of all files that a file includes ("-r"), itself too; cycles end.

    ``includes`` has file and target (null for a file without any)."""
    own = includes.select(F.col("file").alias("root"), "file").distinct()
    return own.unionByName(closure(includes.where("target is not null"), "file", "target").select(F.col("node").alias("root"), F.col("ancestor").alias("file")))


def import_names(members: DataFrame) -> DataFrame:
    """SC15: (archive, name, compiled, stub_only) of the names that an archive's files give to import.

    ``members`` has archive and path, as in a RECORD.  A folder without ``__init__`` is a namespace,
    which the folders and modules below stand for; a name is stub_only if all its files are stubs."""
    rows = members.where(~F.col("path").rlike(r"\.(dist|egg)-info/|\.data/|^\.\./|(^|/)(tests?|docs?|examples?)/")).where(F.col("path").rlike(rf"\.pyi?$|{COMPILED}"))
    parts = F.split(F.regexp_replace("path", r"(\.cpython[^/]*|\.abi3|\.cp\d+[^/]*)?\.(pyi?|so|pyd)$", ""), "/")
    rows = rows.select("archive", parts.alias("p"), F.col("path").rlike(COMPILED).alias("_c"), F.col("path").endswith(".pyi").alias("_s"))
    packages = rows.where(F.element_at("p", -1) == "__init__").select("archive", F.array_join(F.slice("p", F.lit(1), F.size("p") - 1), ".").alias("_prefix")).distinct()
    # every file meets the packages above it; the shortest is the name to import
    rows = rows.withColumn("_file", F.array_join("p", "."))
    up = rows.select("*", F.posexplode(F.transform(F.sequence(F.lit(1), F.size("p")), lambda i: F.array_join(F.slice("p", F.lit(1), i), "."))).alias("_n", "_prefix"))
    found = up.join(packages, ["archive", "_prefix"], "left_semi").groupBy("archive", "_file", "_s", "_c").agg(F.min(F.struct("_n", "_prefix")).alias("_top"))
    named = rows.select("archive", "_file", "_s", "_c").distinct().join(found, ["archive", "_file", "_s", "_c"], "left")
    name = F.regexp_replace(F.coalesce("_top._prefix", "_file"), "-stubs(?=$|[.])", "")
    return named.groupBy("archive", name.alias("name")).agg(F.max("_c").alias("compiled"), F.min("_s").alias("stub_only"))


def placeholders(statements: DataFrame, most_files: int = 20) -> DataFrame:
    """SF29: (package, version, placeholder): releases of 1 to ``most_files`` files in which every top-level
    statement is pass, a constant or a dunder assignment.

    ``statements`` has package, version, file, kind, target; a file without statements has a null kind."""
    fine = F.coalesce(F.col("kind").isin("pass", "constant") | ((F.col("kind") == "assign") & F.col("target").rlike(r"^__\w+__$")), F.lit(True))
    out = statements.groupBy("package", "version").agg(F.bool_and(fine).alias("_fine"), F.count_distinct("file").alias("_n"))
    return out.select("package", "version", (F.col("_fine") & F.col("_n").between(1, most_files)).alias("placeholder"))


def top_statements(sources: DataFrame) -> DataFrame:
    """Top-level statements (package, version, file, kind, target) of sources (package, version, path, text)."""
    import ast
    from collections.abc import Iterator

    import pandas as pd

    def rows(text: str) -> Iterator[tuple]:
        for node in ast.parse(text).body:
            if isinstance(node, ast.Pass):
                yield "pass", None
            elif isinstance(node, ast.Expr) and isinstance(node.value, ast.Constant):
                yield "constant", None
            elif isinstance(node, (ast.Assign, ast.AnnAssign)):
                for target in node.targets if isinstance(node, ast.Assign) else [node.target]:
                    yield "assign", ast.unparse(target)
            else:
                yield "other", None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for package, version, path, text in batch[["package", "version", "path", "text"]].itertuples(index=False):
                try:
                    these = list(rows(text or "")) or [(None, None)]
                except (SyntaxError, ValueError, RecursionError):
                    these = [("other", None)]
                found += [(package, version, path, kind, target) for kind, target in these]
            yield pd.DataFrame(found, columns=["package", "version", "file", "kind", "target"])

    return sources.select("package", "version", "path", "text").mapInPandas(run, "package string, version string, file string, kind string, target string")


def flatten_runs(runs: DataFrame, columns: dict[str, Column | str]) -> DataFrame:
    """SC27: nested run records as flat columns, ready for ``write.csv(header=True)``."""
    return runs.select(*[(F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()])
