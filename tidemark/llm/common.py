"""What several operators share: reading tables, cutting lineage, bounded samples."""

from __future__ import annotations

import os
import tempfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut in the folder of ``spark.checkpoint.dir``.

    A folder of this machine is chosen only where the session names none and runs in
    one process, as in tests; a cluster without the setting is an error.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tidemark-"))
    return df.checkpoint(eager=True)


def ranked(df: DataFrame, order: list, name: str = "_rank") -> tuple[DataFrame, int]:
    """``df`` with a gapless 0-based global rank by ``order``, and the number of rows.

    Ranges are sorted in parallel and numbered from the counts of the ranges before
    them; no task holds more than its range.  Pass narrow rows: they are
    materialised in the checkpoint folder.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    placed = df.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = checkpointed(placed.withColumns({"_part": F.spark_partition_id(), "_at": at}))
    counts = placed.groupBy("_part").count()  # one row a partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    total = counts.agg(F.sum("count")).first()[0] or 0
    out = placed.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at"))
    return out.drop("_part", "_at", "_start"), total


def fold(column, divisor: int):
    """crc32(column as text) mod ``divisor``; null ids fall into fold 0."""
    return F.coalesce(F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(divisor)), F.lit(0))


#: Bytes of text of each class that a fit reads at most.
SAMPLE_BYTES = 32 << 20


def labelled_sample(
    docs: DataFrame, labels: DataFrame, target: str, train, per_class: int, sample_bytes: int = SAMPLE_BYTES
) -> tuple[list[str], list[int], float | None]:
    """At most ``per_class`` labelled training texts of each class, their labels, and
    the positive class's share among all training labels (None without labels).

    The bounds are fixed, in rows and in ``sample_bytes`` of text of each class, so neither
    the driver nor a broadcast grows with the corpus; texts are taken whole or not at all.
    Rows are taken in the order of a hash of their id, which makes the
    sample the same in every run.  ``train`` is a column over ``doc_id``.  Rows with
    a null id, label or text are left out; of an id with several labels the
    largest counts, and texts that repeat under one label count once.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(target).isin(0, 1) & train)
    known = known.groupBy("doc_id").agg(F.max(F.col(target).cast("int")).alias("y"))
    share = known.agg(F.avg("y")).first()[0]
    order = F.xxhash64(F.lit(target), F.col("doc_id"))
    picked = [tuple(r) for y in (0, 1) for r in known.where(F.col("y") == y).orderBy(order, "doc_id").limit(per_class).collect()]
    if not picked:
        return [], [], None
    chosen = F.broadcast(docs.sparkSession.createDataFrame(pd.DataFrame(picked, columns=["doc_id", "y"]), "doc_id long, y int"))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id").where(F.col("text").isNotNull())
    rows = rows.groupBy("y", "text").agg(F.min(order).alias("at"))  # one row a text and label
    so_far = Window.partitionBy("y").orderBy("at", "text").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("bytes", F.sum(F.octet_length("text").cast("long")).over(so_far)).where(F.col("bytes") <= sample_bytes)
    distinct = sorted((r["y"], r["text"]) for r in rows.select("y", "text").collect())
    return [t for _, t in distinct], [y for y, _ in distinct], share


ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_words(text):
    """Words of a text column: runs of digits, ASCII letters (made lower case) and all
    characters beyond ASCII; an empty array for null.

    Splitting is many times as fast as extracting matches.  Explode what is made of
    it with explode_outer: for explode, the optimizer adds a filter on the array's
    size below, with the split inside a lambda once for each word.
    """
    lower = F.translate(F.coalesce(text, F.lit("")), ASCII_UPPER, ASCII_UPPER.lower())
    return F.array_remove(F.split(lower, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def tokenizer_file(name: str, folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` overrides the installed package."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
