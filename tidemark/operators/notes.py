"""Texts made of changes: lines, notes, Markdown pages, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def display(owner: str = "owner", name: str = "name", parameter: str = "parameter") -> Column:
    """SF7: ``Owner.name(parameter)``, with what a change has of it."""
    base = F.concat_ws(".", owner, name)
    return F.when(F.col(parameter).isNotNull(), F.concat(base, F.lit("("), F.col(parameter), F.lit(")"))).otherwise(base)


def change_line() -> Column:
    """SF18: one line on a change of ``release_diff.diff``, by kind."""
    code = lambda c: F.concat(F.lit("`"), c, F.lit("`"))
    what, parameter = code(F.col("path")), code(F.regexp_replace(F.coalesce("parameter", F.lit("")), r"^[*]+", ""))
    one = F.get("suggestions", F.lit(0))
    lines = {
        "removed": F.concat(what, F.lit(" was removed")),
        "moved": F.concat(what, F.lit(" moved to "), code(F.coalesce("moved_to", F.lit("?")))),
        "param_removed": F.concat(what, F.lit(" no longer takes "), parameter, F.coalesce(F.concat(F.lit(", now "), code(one)), F.lit(""))),
        "param_required": F.concat(what, F.lit(" now requires "), parameter),
        "param_keyword_only": F.concat(what, F.lit(" takes "), parameter, F.lit(" by keyword only")),
        "param_positional_only": F.concat(what, F.lit(" takes "), parameter, F.lit(" by position only")),
        "kind_changed": F.concat(what, F.lit(" was a "), F.col("old_kind"), F.lit(" and is a "), F.col("new_kind"), F.lit(" now")),
        "deprecated": F.concat(what, F.lit(" is deprecated"), F.coalesce(F.concat(F.lit(": "), F.rtrim(F.col("deprecation"), F.lit(". "))), F.lit(""))),
        "dependency_switched": F.concat(F.lit("types of "), code(F.col("name")), F.lit(" in the public API are now "), code(F.coalesce("moved_to", F.lit("?")))),
    }
    out = F.lit(None).cast("string")
    for kind, line in lines.items():
        out = F.when(F.col("kind") == kind, line).otherwise(out)
    return F.concat(out, F.lit("."))


def api_notes(changes: DataFrame, versions: DataFrame, most: int = 20) -> DataFrame:
    """SF18: one note for each API: (package, api, old_version, new_version, title, bullets, place).

    ``changes`` are rows of ``release_diff.diff`` with ``score``; ``versions`` (package, old_version,
    new_version).  An API is a changed object without its parameter; its lines stand in score
    order, equal ones once, ``most`` at most (the note's own limit) with a last line that
    tells how many are left out."""
    rows = changes.withColumn("_line", change_line()).groupBy("package", F.col("path").alias("api"), "_line").agg(F.max("score").alias("_score"), F.max("old_signature").alias("_sig"))
    line = F.struct((-F.col("_score")).alias("s"), F.col("_line").alias("l"))
    one = rows.groupBy("package", "api").agg(F.array_sort(F.collect_list(line)).alias("_lines"), F.max("_score").alias("_score"), F.max("_sig").alias("signature"))
    lines = F.transform("_lines", lambda x: x["l"])
    left = F.size(lines) - most
    shown = F.when(left > 0, F.concat(F.slice(lines, 1, most), F.array(F.concat(F.lit("and "), left.cast("string"), F.lit(" more."))))).otherwise(lines)
    place = F.row_number().over(Window.partitionBy("package").orderBy(F.desc("_score"), "api"))
    out = one.join(versions, "package").withColumns({"bullets": shown, "place": place, "title": F.concat(F.lit("`"), F.col("api"), F.lit("`"))})
    return out.select("package", "api", "old_version", "new_version", "title", "signature", "bullets", "place")


def markdown(notes: DataFrame) -> DataFrame:
    """SC25: (package, text): the notes of a package as Markdown, in the form that ``registry.note_blocks`` reads."""
    bullets = F.array_join(F.transform("bullets", lambda b: F.concat(F.lit("- "), b)), "\n")
    rows = notes.groupBy("package", "old_version", "new_version").agg(F.array_sort(F.collect_list(F.struct("place", bullets.alias("b")))).alias("_b"))
    head = F.concat(F.lit("### "), F.col("package"), F.lit(" "), F.col("old_version"), F.lit(" -> "), F.col("new_version"), F.lit("\n"))
    return rows.select("package", F.concat(head, F.array_join(F.transform("_b", lambda x: x["b"]), "\n")).alias("text"))


def summary_table(changes: DataFrame) -> DataFrame:
    """SC25: (line): a Markdown table of the changes by package and kind, packages with most changes first."""
    counts = changes.groupBy("package", "kind").agg(F.count("*").alias("n"))
    total = Window.partitionBy("package")
    rows = counts.withColumn("_all", F.sum("n").over(total)).orderBy(F.desc("_all"), "package", F.desc("n"), "kind")
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", "package", "kind", F.col("n").cast("string")), F.lit(" |")).alias("line"))


def write_markdown(pages: DataFrame, path: str) -> None:
    """SC25: one folder a package (``package=name``) with its page as text; pages that aren't written stay."""
    pages.select("package", "text").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").text(path)


def task_prompt(language: str = "Python") -> Column:
    """UD9: the task by which a model is asked for code that uses a changed API, from the API's own old
    signature and summary; neither the change nor its replacement is named."""
    signature = F.coalesce(F.concat(F.lit(" Its signature is `"), F.col("old_signature"), F.lit("`.")), F.lit(""))
    about = F.coalesce(F.concat(F.lit(" "), F.col("old_doc")), F.lit(""))
    return F.concat(F.lit(f"Write a short {language} example that uses `"), display(parameter="_no_parameter"), F.lit("` of `"), F.col("package"), F.lit("`."), signature, about)


def task_prompts(changes: DataFrame, language: str = "Python") -> DataFrame:
    """UD9: (package, path, prompt) for each API; ``changes`` has old_signature and old_doc."""
    rows = changes.withColumn("_no_parameter", F.lit(None).cast("string")).dropDuplicates(["package", "path"])
    return rows.select("package", "path", task_prompt(language).alias("prompt"))


def wrapped(text: Column, width: int = 80) -> Column:
    """SF31: lines of at most ``width`` characters, cut at blanks; a longer word has a line of its own."""
    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, w: Column) -> Column:
        longer = F.concat(acc["line"], F.lit(" "), w)
        first, fits = acc["line"] == "", F.char_length(longer) <= width
        lines = F.when(first | fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"])))
        return F.struct(lines.alias("lines"), F.when(first, w).when(fits, longer).otherwise(w).alias("line"))

    return F.aggregate(words, start, add, lambda acc: F.when(acc["line"] == "", acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))))
