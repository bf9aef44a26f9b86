"""Readers and writers of release indexes, dependency files, archives and run records."""

from __future__ import annotations

import io
import json
import tarfile
import tomllib
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.markers import marker_applies
from tidemark.functions.scalar import annotation_escape, canonical_name
from tidemark.functions.versions import version_key
from tidemark.operators.ranking import best_per_key

from .environments import included_files

RELEASE_DOC = "package string, releases map<string, array<struct<upload_time_iso_8601: string, yanked: boolean>>>"
LOCKED = "file string, name string, version string, direct boolean, markers string, private string, error string"
MEMBER_BYTES, ARCHIVE_BYTES = 1 << 20, 200 << 20


def read_release_docs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RELEASE_DOC).json(path)


def releases(docs: DataFrame) -> DataFrame:
    """One row a release: first upload, yanked if all its files are; none for versions without files."""
    rows = docs.select("package", F.explode("releases").alias("version", "files")).where(F.size("files") > 0)
    uploaded = F.to_timestamp(F.array_min(F.transform("files", lambda f: f["upload_time_iso_8601"])))
    return rows.select("package", "version", uploaded.alias("uploaded"), F.forall("files", lambda f: F.coalesce(f["yanked"], F.lit(False))).alias("yanked"))


def _requirement_lines(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.read.option("recursiveFileLookup", True).text(path, wholetext=True)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "text"))
    return lines.withColumn("text", F.trim(F.regexp_replace("text", r"(^|\s)#.*$", ""))).where("text <> ''")


def read_requirements(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, name, specifier, pin) of requirements files; comments, options and blank lines go."""
    lines = _requirement_lines(spark, path).where("text not like '-%'")
    parts = r"^([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*([^;@]*)"
    lines = lines.withColumn("name", canonical_name(F.regexp_extract("text", parts, 1))).withColumn("specifier", F.trim(F.regexp_extract("text", parts, 2)))
    pin = F.nullif(F.regexp_extract("specifier", r"^===?\s*([^,*\s]+)$", 1), F.lit(""))
    return lines.where("name <> ''").select("file", "line", "name", "specifier", pin.alias("pin"))


def requirement_includes(spark: SparkSession, path: str) -> DataFrame:
    """SC6: (file, target) of the files that requirements files include with "-r", relative to their own place."""
    asked = F.regexp_extract("text", r"^(?:-r|--requirement)[ =]*(\S+)", 1)
    folder = F.regexp_replace("file", r"[^/]*$", "")
    whole = F.when(asked.rlike("^/"), F.concat(F.lit("file:"), asked)).otherwise(F.concat(folder, asked))
    step = F.regexp_replace(F.regexp_replace(whole, r"/\./", "/"), r"/(?!\.\.)[^/]+/\.\./", "/")
    return _requirement_lines(spark, path).where("text like '-r%' or text like '--requirement%'").select("file", step.alias("target")).distinct()


def read_requirements_with_includes(spark: SparkSession, path: str) -> DataFrame:
    """SC6: (root, file, line, name, specifier, pin): what each file below ``path`` asks for, with the files that
    it includes, all the way; cycles end and a file counts once for each root."""
    rows = read_requirements(spark, path)
    every = _requirement_lines(spark, path).select("file").distinct()
    includes = every.join(requirement_includes(spark, path), "file", "left")
    return included_files(includes).join(rows, "file").select("root", "file", "line", "name", "specifier", "pin")


#: Names of lock files.
LOCK_NAMES = ("uv.lock", "poetry.lock", "pdm.lock", "pylock.toml", "Pipfile.lock")


def _private(entry: dict) -> str | None:
    """Why a locked package isn't the public index's, if so: git, url, path, directory, editable, virtual,
    archive, vcs or private index."""
    source = entry.get("source") if isinstance(entry.get("source"), dict) else {}
    kind = str(source.get("type") or "")
    if "git" in source or kind == "git" or isinstance(entry.get("git"), str):
        return "git"
    for key in ("path", "directory", "editable", "virtual"):
        if key in source:
            return key
    for key in ("vcs", "directory", "archive", "path", "url"):
        if key in entry:
            return key
    place = str(source.get("registry") or source.get("url") or entry.get("index") or "")
    if "url" in source and kind in ("", "url"):
        return "url"
    known = ("pypi.org", "files.pythonhosted.org", "pypi.python.org")
    return "private index" if kind == "legacy" or (place and not any(h in place for h in known)) else None


def read_locks(spark: SparkSession, path: str) -> DataFrame:
    """SC3, SC4, SC5: ``LOCKED`` rows of lock files: uv, poetry, pdm, pylock (``pylock.*.toml`` too) and Pipfile.lock.

    One row a locked package, also where a name is locked once for each of several ranges (``markers`` tells
    them apart; see ``picked``).  ``private`` says why a package isn't the public index's.  A file that can't
    be read, or whose name is no lock file's, gives one row with its error."""

    def rows(file: str, raw: bytes) -> Iterator[tuple]:
        name = file.rpartition("/")[2]
        if name == "Pipfile.lock":
            data = json.loads(raw)
            for section in ("default", "develop"):
                for key, entry in sorted((data.get(section) or {}).items()):
                    yield file, key, (entry.get("version") or "").removeprefix("==") or None, None, entry.get("markers"), _private(entry), None
            return
        is_pylock = name == "pylock.toml" or (name.startswith("pylock.") and name.endswith(".toml"))
        if not is_pylock and name not in LOCK_NAMES:
            raise ValueError(f"no known lock file: {name}")
        data = tomllib.loads(raw.decode())
        packages = data.get("packages" if is_pylock else "package") or []
        own = [p for p in packages if {"editable", "virtual"} & set(p["source"] if isinstance(p.get("source"), dict) else {})]
        direct = {d["name"] for p in own for group in [p.get("dependencies", []), *(p.get("optional-dependencies") or {}).values(), *(p.get("dev-dependencies") or {}).values()] for d in group}
        for p in packages:
            if p not in own:
                marker = p.get("markers", p.get("marker", p.get("resolution-markers")))
                many = list(marker.values()) if isinstance(marker, dict) else marker if isinstance(marker, list) else [marker]
                text = " or ".join(f"({m})" for m in many if isinstance(m, str)) or None
                yield file, p["name"], p.get("version"), (p["name"] in direct) if own else None, text, _private(p), None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for file, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    found += rows(file, bytes(raw))
                except (ValueError, KeyError, TypeError, AttributeError) as e:
                    found.append((file, None, None, None, None, None, str(e)[:200]))
            yield pd.DataFrame(found, columns=["file", "name", "version", "direct", "markers", "private", "error"]).astype({"direct": "boolean"})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, LOCKED).withColumn("name", canonical_name(F.col("name")))


def picked(locked: DataFrame, python: str) -> DataFrame:
    """AG6: one row for each (file, name) of ``read_locks``: of the versions whose markers hold for ``python`` on some
    platform the highest, else the highest of all."""
    rows = locked.where("name is not null").withColumns({"_fits": marker_applies(F.col("markers"), python).cast("int"), "_key": version_key(F.col("version"))})
    return best_per_key(rows, ["file", "name"], [F.desc("_fits"), F.desc_nulls_last("_key"), F.desc("version")]).drop("_fits", "_key")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(archive, path, text, error) of the Python files in wheels and source archives.  Members
    whose path leaves the archive, larger ones than a megabyte and those beyond the archive's
    byte budget are reported with an error and no text."""

    def members(raw: bytes, name: str) -> Iterator[tuple[str, int, object]]:
        if name.endswith((".whl", ".zip")):
            z = zipfile.ZipFile(io.BytesIO(raw))
            yield from ((i.filename, i.file_size, lambda i=i: z.read(i)) for i in z.infolist())
        else:
            t = tarfile.open(fileobj=io.BytesIO(raw))
            yield from ((m.name, m.size, lambda m=m: t.extractfile(m).read()) for m in t.getmembers() if m.isfile())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for archive, raw in zip(batch["path"], batch["content"], strict=True):
                found, left = [], ARCHIVE_BYTES
                try:
                    for name, size, read in members(bytes(raw), archive):
                        if not name.endswith((".py", ".pyi")):
                            continue
                        if name.startswith("/") or ".." in name.split("/"):
                            found.append((archive, name, None, "path leaves the archive"))
                        elif size > MEMBER_BYTES or size > left:
                            found.append((archive, name, None, "too large"))
                        else:
                            left -= size
                            found.append((archive, name, read().decode("utf-8", "replace"), None))
                except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError) as e:
                    found.append((archive, None, None, str(e)[:200]))
                yield pd.DataFrame(found, columns=["archive", "path", "text", "error"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, "archive string, path string, text string, error string")


def valid_runs(runs: DataFrame) -> DataFrame:
    """SC22: valid runs (run_id, attempt, valid, pilot) that are no pilots, the first attempt of each run id."""
    return best_per_key(runs.where("valid and not coalesce(pilot, false)"), ["run_id"], [F.asc("attempt")])


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """``valid_runs`` of JSON lines."""
    return valid_runs(spark.read.schema(schema).json(path))


def annotations(uses: DataFrame) -> DataFrame:
    """``line`` of a CI annotation for each (file, line, title, message)."""
    where = F.concat(F.lit("file="), annotation_escape(F.col("file")), F.coalesce(F.concat(F.lit(",line="), F.col("line").cast("string")), F.lit("")))
    return uses.select(F.concat(F.lit("::warning "), where, F.lit(",title="), annotation_escape(F.col("title")), F.lit("::"), annotation_escape(F.col("message"))).alias("line"))
