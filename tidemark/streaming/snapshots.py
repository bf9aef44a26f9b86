"""Incremental maintenance of a keyed table from a stream of snapshots.

There are no event-time windows in this domain: a poll delivers rows, and the table
keeps the newest row of each key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.incremental import upsert
from tidemark.operators.ranking import best_per_key

#: Parts that a table's keys are dealt over by a hash.
PARTS = 64
#: Columns by which the files lie in folders; the rows' own columns have other names.
PART, BATCH = "tm_part", "tm_batch"


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The table's rows: of every part the newest version, or the newest before batch ``before``."""
    rows = spark.read.parquet(path)
    known = rows.where(F.col(BATCH) < before) if before is not None else rows
    newest = known.select(PART, BATCH).distinct().groupBy(PART).agg(F.max(BATCH).alias(BATCH))
    return rows.join(F.broadcast(newest), [PART, BATCH]).drop(PART, BATCH)  # one row a part


def maintain(stream: DataFrame, path: str, keys: Sequence[str], order: str, checkpoint: str, parts: int = PARTS):
    """Starts a query that upserts every batch of ``stream`` into a Parquet table.

    Keys are dealt over ``parts`` parts by a hash.  A batch writes new versions, ``path/tm_part=p/tm_batch=<batch>``,
    of the parts that it changes and leaves the others as they are; a batch that runs again after
    a failure reads what was there before it and overwrites its own versions only."""
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = best_per_key(batch, keys, [F.desc(order)]).withColumn(PART, part)
        touched = [r[PART] for r in newest.select(PART).distinct().collect()]  # ``parts`` numbers at most
        if not touched:
            return
        if number:
            held = spark.read.parquet(path).where(F.col(PART).isin(touched) & (F.col(BATCH) < number))
            last = held.select(PART, BATCH).distinct().groupBy(PART).agg(F.max(BATCH).alias(BATCH))
            newest = upsert(held.join(F.broadcast(last), [PART, BATCH]).drop(BATCH).select(*newest.columns), newest, keys)
        for_part = newest.withColumn(BATCH, F.lit(number).cast("int")).repartition(PART)
        for_part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART, BATCH).parquet(path)

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
