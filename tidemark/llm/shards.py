"""Operator 1: shards cut from a Hilbert-curve order over several metadata columns.

Every dimension is quantised to equal-count cells, a row's cells give its index
on the Hilbert curve, rows are ranked by that index and the ranking is cut into
runs.  Rows that are near in all dimensions share a shard, so the minimum and
maximum of *each* dimension prune files, and the runs' counts differ by one at
most (law ``rows``).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, ranked, table

BITS = 6
N_SHARDS = 24
#: Largest table of distinct strings of a dimension that is broadcast.
BROADCAST_BYTES = 8 << 20


def hilbert_index(cells: Sequence[np.ndarray], bits: int) -> np.ndarray:
    """Positions on the Hilbert curve over a cube with ``2**bits`` cells a side.

    The transposed form of the index (Skilling, 2004) is computed for all points
    at once and its bits are interleaved.  ``bits * len(cells)`` is 62 at most.
    """
    x = [np.array(c, dtype=np.int64) for c in cells]
    n = len(x)
    top = 1 << (bits - 1)
    bit = top
    while bit > 1:
        low = bit - 1
        x[0] = np.where(x[0] & bit, x[0] ^ low, x[0])
        for i in range(1, n):
            swap = (x[0] ^ x[i]) & low
            hit = (x[i] & bit) != 0
            x[0], x[i] = np.where(hit, x[0] ^ low, x[0] ^ swap), np.where(hit, x[i], x[i] ^ swap)
        bit >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = top
    while bit > 1:
        flip = np.where(x[n - 1] & bit, flip ^ (bit - 1), flip)
        bit >>= 1
    index = np.zeros_like(x[0])
    for j in range(bits - 1, -1, -1):
        for i in range(n):
            index = (index << 1) | (((x[i] ^ flip) >> j) & 1)
    return index


def _numbered(df: DataFrame, name: str, number: str) -> DataFrame:
    """``df`` with an order-preserving number for a column: strings by their place among the
    distinct ones.  The table of these is broadcast where its measured size allows."""
    if dict(df.dtypes)[name] not in ("string", "binary"):
        return df.withColumn(number, F.col(name).cast("double"))
    value = F.col(name).alias("_value")
    places, _ = ranked(df.where(F.col(name).isNotNull()).select(value).distinct(), ["_value"], number)
    size = places.agg(F.sum(F.octet_length("_value") + 8)).first()[0] or 0
    if size <= BROADCAST_BYTES:
        places = F.broadcast(places)
    return df.join(places, F.col(name) == F.col("_value"), "left").drop("_value").withColumn(number, F.col(number).cast("double"))


def hilbert_shards(
    df: DataFrame, dimensions: Sequence[str], n_shards: int, tie: Sequence[str] = (), bits: int = BITS
) -> DataFrame:
    """``df`` with ``curve`` long, ``shard`` int and ``slot`` long added.

    Pass metadata only: rows are materialised twice, in the checkpoint folder.
    Nulls get the lowest cell.  Rows equal in the curve index are ordered by the
    ``tie`` columns; rows equal in those too are interchangeable.  Shard ``s`` of
    ``n`` rows has ranks from ``ceil(s * n / n_shards)``, so counts differ by one
    at most, and slots are gapless.  An empty table gives no rows.  A table that has one
    of the added columns already, or one that begins with ``_hilbert``, is refused.
    """
    clash = [c for c in df.columns if c in ("curve", "shard", "slot", "_rank", "_part", "_at", "_start", "_value") or c.startswith("_hilbert")]
    if clash:
        raise ValueError(f"columns {clash} have names that are added here; rename them first")
    numbers = [f"_hilbert{i}" for i in range(len(dimensions))]
    base = df
    for number, name in zip(numbers, dimensions, strict=True):
        base = _numbered(base, name, number)
    base = checkpointed(base)
    cells = 1 << bits
    share = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    cuts = base.agg(*[F.percentile_approx(n, share, F.lit(10_000)).alias(n) for n in numbers]).first()
    edges = [np.array(cuts[n] if cuts[n] is not None else [], dtype=float) for n in numbers]

    @F.pandas_udf("long")
    def curve(frame: pd.DataFrame) -> pd.Series:
        found = []
        for name, edge in zip(frame.columns, edges, strict=True):
            values = frame[name].to_numpy(dtype=float)
            found.append(np.where(np.isnan(values), 0, np.searchsorted(edge, values, side="left")))
        return pd.Series(hilbert_index(found, bits))

    order = ["curve", *tie]
    placed, total = ranked(base.withColumn("curve", curve(F.struct(*numbers))).drop(*numbers), order)
    n = max(total, 1)
    # integer arithmetic: floor(rank * shards / n), and the first rank of a shard
    shard = F.expr(f"cast((_rank * {n_shards}) div {n} as int)")
    first = F.expr(f"(shard * {n}L + {n_shards - 1}) div {n_shards}")
    return placed.withColumn("shard", shard).withColumn("slot", F.col("_rank") - first).drop("_rank")


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by source, language, size and id; law ``rows``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    meta = table(spark, sf_dir, "documents").select(
        "doc_id", "source", "lang", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")
    )
    out = hilbert_shards(meta, ["source", "lang", "size", "doc_id"], N_SHARDS, tie=["doc_id", "text_crc32", "size"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
