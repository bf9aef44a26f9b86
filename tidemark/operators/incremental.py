"""State comparison, upserts and missing keys over snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compare_state(stored: DataFrame, current: DataFrame, key: str, version: str) -> DataFrame:
    """Every stored key as orphan, unpinned, current or out_of_date."""
    now = current.select(key, F.col(version).alias("_now"), F.lit(True).alias("_has"))
    state = F.when(F.col("_has").isNull(), "orphan").when(F.col("_now").isNull(), "unpinned").when(F.col("_now").eqNullSafe(F.col(version)), "current").otherwise("out_of_date")
    return stored.join(now, key, "left").withColumn("state", state).drop("_has", "_now")


def missing_keys(requested: DataFrame, cached: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Requested keys that the cache doesn't have, once each."""
    return requested.select(*keys).distinct().join(cached.select(*keys), list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``new``, and the rows of ``old`` whose key it doesn't have."""
    return new.unionByName(old.join(new.select(*keys), list(keys), "left_anti"), allowMissingColumns=True)


def stale(df: DataFrame, as_of: str, limit: Column) -> DataFrame:
    """Keys computed from inputs older than ``limit``."""
    return df.where(F.col(as_of) < limit)
