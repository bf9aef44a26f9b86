"""JSON records: transcripts, tasks and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from tidemark.operators.ranking import best_per_key

TASK = "fingerprint string, change_id string, task string, prompt string"


def transcript_records(lines: DataFrame, schema: str) -> DataFrame:
    """SC23: records of transcript ``lines`` (file, line, value), with ``bad`` for lines that are no JSON object.

    Blank lines are no records; fields that a record lacks are null, and a bad line has null fields."""
    fields = Ty.StructType.fromDDL(schema)
    parsed = F.from_json("value", fields, {"mode": "PERMISSIVE"})
    rows = lines.where(F.trim("value") != "").withColumns({"_r": parsed, "bad": ~F.trim("value").startswith("{") | F.get_json_object("value", "$").isNull()})
    return rows.select("file", "line", "bad", *[F.when(~F.col("bad"), F.col("_r")[f.name]).alias(f.name) for f in fields.fields])


def read_transcripts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SC23: ``transcript_records`` of JSON-lines files; lines are numbered from 0 within a file."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", r"\r?\n")).alias("line", "value"))
    return transcript_records(files, schema)


def fingerprint(package: Column, old_version: Column, new_version: Column, kind: Column, path: Column, parameter: Column) -> Column:
    """The key of a change: a hash of what it says, whatever run found it."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in (package, old_version, new_version, kind, path, parameter)]
    return F.substring(F.sha2(F.concat_ws("\x00", *parts), 256), 1, 16)


def write_tasks(tasks: DataFrame, path: str) -> None:
    """SC21: tasks as JSON lines, one folder a fingerprint's first two digits; other folders stay."""
    rows = tasks.select(*[c.strip().split(" ")[0] for c in TASK.split(",")]).withColumn("shelf", F.substring("fingerprint", 1, 2))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("shelf").json(path)


def read_tasks(spark: SparkSession, path: str, changes: DataFrame | None = None) -> DataFrame:
    """SC21: ``TASK`` rows, of the changes (fingerprint) that are still found if given; a task once."""
    rows = spark.read.schema(f"{TASK}, shelf string").json(path).drop("shelf").where("fingerprint is not null")
    rows = best_per_key(rows, ["fingerprint", "task"], [F.asc("prompt")])
    return rows if changes is None else rows.join(changes.select("fingerprint").distinct(), "fingerprint", "left_semi")


def result_documents(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """SC24, PF14: (package, document): one nested JSON document a package, its public fields and its changes in
    score order; packages without changes have an empty list."""
    columns = [c for c in changes.columns if c != "package" and not c.startswith("_")]
    row = F.struct((-F.col("score")).alias("_s"), F.struct(*columns).alias("change"))
    lists = changes.groupBy("package").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["_s"] < b["_s"], -1).when(a["_s"] > b["_s"], 1).when(a["change"]["path"] < b["change"]["path"], -1).otherwise(1)).alias("_l"))
    public = [c for c in packages.columns if not c.startswith("_")]
    found = packages.join(lists, "package", "left").withColumn("changes", F.transform("_l", lambda x: x["change"]))
    found = found.withColumn("changes", F.coalesce("changes", F.filter("changes", lambda x: F.lit(False)), F.from_json(F.lit("[]"), changes.select(F.array(F.struct(*columns)).alias("x")).schema["x"].dataType)))
    return found.select("package", F.to_json(F.struct(*public, "changes"), {"ignoreNullFields": "false"}).alias("document"))


def write_documents(documents: DataFrame, path: str) -> None:
    """SC24: one text file of JSON documents for each package's folder; other packages' folders stay."""
    documents.select("package", "document").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("package").text(path)
