"""The model registry, note blocks and keyed result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.scalar import parse_cutoff
from tidemark.operators.lineage import cut
from tidemark.operators.ranking import best_per_key

MODELS = "map<string, struct<name: string, models: map<string, struct<id: string, name: string, family: string, knowledge: string, release_date: string>>>>"
NOTES = "file string, package string, old_version string, new_version string, ordinal int, bullet string"


def models(documents: DataFrame, column: str = "value") -> DataFrame:
    """(provider, id, name, family, knowledge, released) of a nested registry document."""
    found = documents.select(F.explode(F.from_json(column, MODELS)).alias("provider", "p")).select("provider", F.explode("p.models").alias("key", "m"))
    return found.select("provider", F.coalesce("m.id", "key").alias("id"), "m.name", "m.family", parse_cutoff(F.col("m.knowledge")).alias("knowledge"), parse_cutoff(F.col("m.release_date")).alias("released"))


def lookup(asked: DataFrame, registry: DataFrame, first_party: list[str]) -> DataFrame:
    """The listing of each asked (model, provider): its spellings are the id as given, then
    without a date or "latest", then without what stands before a slash; own provider before
    first parties before others, the earliest cutoff of equals."""
    dated = F.regexp_replace("model", r"[-@](?:\d{8}|\d{4}-\d{2}-\d{2}|latest)$", "")
    spelt = F.array_distinct(F.array(F.col("model"), dated, F.regexp_replace("model", "^.*/", ""), F.regexp_replace(dated, "^.*/", "")))
    once = asked.select("model", F.col("provider").alias("own")).groupBy("model", "own").agg(F.count("*").alias("_times"))  # equal questions have one answer
    rows = once.select("model", "own", "_times", F.posexplode_outer(spelt).alias("spelling", "id"))
    rank = F.when(F.col("provider") == F.col("own"), 0).when(F.col("provider").isin(*first_party), 1).otherwise(2)
    found = rows.join(registry, "id").withColumn("_class", rank)
    found = best_per_key(found, ["model", "own"], ["_class", "spelling", F.asc_nulls_last("knowledge"), "provider", "id"])
    return found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_times"))).drop("_copy", "_times", "_class", "spelling", "own")


def blocks_in(texts: DataFrame, start: str = "<!-- notes:start -->", end: str = "<!-- notes:end -->") -> DataFrame:
    """SC28: bullets of the marked block of Markdown ``texts`` (file, value): headings "### package old -> new" and "- " lines."""
    text = texts.select("file", F.element_at(F.split(F.element_at(F.split("value", start), 2), end), 1).alias("block"))
    parts = text.select("file", F.posexplode(F.regexp_extract_all("block", F.lit(r"(?m)^###\s+[^\n]*(?:\n(?!###)[^\n]*)*"), F.lit(0))).alias("at", "part"))
    head = r"^###\s+`?([^\s`]+)`?\s+(\S+)\s*->\s*(\S+)"
    out = parts.select("file", *[F.regexp_extract("part", head, i).alias(n) for i, n in ((1, "package"), (2, "old_version"), (3, "new_version"))], F.posexplode(F.regexp_extract_all("part", F.lit(r"(?m)^- (.*)$"), F.lit(1))).alias("ordinal", "bullet"))
    return out.where("package <> ''")


def note_blocks(spark: SparkSession, path: str) -> DataFrame:
    """``blocks_in`` Markdown files."""
    return blocks_in(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value"))


def put_results(results: DataFrame, path: str) -> None:
    """Adds keyed JSON results (namespace, key, value, at) to a table by namespace; readers take a key's newest."""
    results.write.mode("append").partitionBy("namespace").parquet(path)


def compact_results(spark: SparkSession, path: str) -> None:
    """SC20: rewrites each namespace to the newest value of each key.

    Files are committed by the output committer as a whole, so a reader sees the old or the new set."""
    newest = best_per_key(spark.read.parquet(path), ["namespace", "key"], [F.desc("at")])
    cut(newest).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("namespace").parquet(path)


def with_fallback(fresh: DataFrame, stored: DataFrame, keys: list[str], at: str = "at", max_age_hours: float | None = None, now=None) -> DataFrame:
    """SC1, SC19: documents by key: the fresh one, else the stored one however old, with ``stale`` for
    stored ones older than ``max_age_hours``."""
    now = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    old = F.lit(False) if max_age_hours is None else F.col(at) < now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600.0))
    kept = best_per_key(stored.join(fresh.select(*keys), keys, "left_anti"), keys, [F.desc(at)])
    return fresh.withColumn("stale", F.lit(False)).unionByName(kept.withColumn("stale", old))


def to_fetch(wanted: DataFrame, stored: DataFrame, keys: list[str], at: str = "at", max_age_hours: float = 12.0, now=None) -> DataFrame:
    """SC1: keys of ``wanted`` without a stored document that is young enough."""
    now = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
    young = stored.where(F.col(at) >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600.0)))
    return wanted.select(*keys).distinct().join(young, keys, "left_anti")


def get_results(spark: SparkSession, path: str, max_age_hours: float | None = None, now=None) -> DataFrame:
    """The newest value of each key, of those young enough."""
    rows = spark.read.parquet(path)
    if max_age_hours is not None:
        now = F.lit(now).cast("timestamp") if now is not None else F.current_timestamp()
        rows = rows.where(F.col("at") >= now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(max_age_hours * 3600.0)))
    return best_per_key(rows, ["namespace", "key"], [F.desc("at")])
