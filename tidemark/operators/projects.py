"""Declared, locked and installed dependencies of projects."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.scalar import canonical_name


def scanned(dependencies: DataFrame, imported: DataFrame, every: bool = False, include: Iterable[str] = (), exclude: Iterable[str] = ()) -> DataFrame:
    """Dependencies to scan: direct ones, all with ``every``, named ones, or transitive ones whose
    name the code imports; only ``include`` where it is given, never ``exclude``."""
    plain = lambda names: [n.lower().replace("_", "-").replace(".", "-") for n in names]
    include, exclude = plain(include), plain(exclude)
    used = imported.select(canonical_name(F.col("name")).alias("_key")).distinct().withColumn("_used", F.lit(True))
    rows = dependencies.withColumn("_key", canonical_name(F.col("name"))).join(used, "_key", "left")
    wanted = F.col("direct") | F.lit(every) | F.coalesce("_used", F.lit(False)) | F.col("_key").isin(*include)
    rows = rows.where(wanted & ~F.col("_key").isin(*exclude))
    return (rows.where(F.col("_key").isin(*include)) if include else rows).drop("_key", "_used")


def pin_conflicts(declared: DataFrame, locked: DataFrame) -> DataFrame:
    """Names that are pinned to another version than the locked one."""
    d = declared.select("name", F.col("version").alias("pinned")).where("pinned is not null")
    return d.join(locked.select("name", F.col("version").alias("locked")), "name").where("pinned <> locked")


def merged(locked: DataFrame, installed: DataFrame, declared: DataFrame) -> DataFrame:
    """One row a name: the locked version, else the installed, else the pinned one; direct if
    declared or locked as direct.  Where no name is direct, all locked ones are, else all."""
    a = locked.select("name", F.col("version").alias("l"), F.col("direct").alias("ld"), F.lit(True).alias("has_lock"))
    b = installed.select("name", F.col("version").alias("i"))
    c = declared.select("name", F.col("version").alias("p"), F.lit(True).alias("d"))
    rows = a.join(b, "name", "full_outer").join(c, "name", "full_outer")
    direct = F.coalesce("d", F.lit(False)) | F.coalesce("ld", F.lit(False))
    source = F.when(F.col("l").isNotNull(), "lock").when(F.col("i").isNotNull(), "installed").when(F.col("p").isNotNull(), "pinned")
    rows = rows.select("name", F.coalesce("l", "i", "p").alias("version"), source.alias("source"), direct.alias("direct"), F.coalesce("has_lock", F.lit(False)).alias("has_lock"))
    some = rows.agg(F.max(F.col("direct")).alias("_any"), F.max("has_lock").alias("_lock"))
    fallback = F.when(F.col("_any"), F.col("direct")).when(F.col("_lock"), F.col("has_lock")).otherwise(F.lit(True))
    return rows.crossJoin(F.broadcast(some)).withColumn("direct", fallback).drop("_any", "_lock", "has_lock")


def declared_once(rows: DataFrame, key) -> DataFrame:
    """One row a name of several declarations (name, version, specifier, applies, ordinal): those that
    apply, or all if none does; the highest pin by ``key``, the first of equals; else all ranges."""
    some = F.max(F.col("applies")).over(Window.partitionBy("name"))
    kept = rows.withColumn("_some", some).where(F.col("applies") | ~F.col("_some"))
    pin = F.max(F.when(F.col("version").isNotNull(), F.struct(key.alias("k"), (-F.col("ordinal")).alias("o"), "version"))).alias("pin")
    ranges = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("specifier") != "", F.struct("ordinal", "specifier")))), lambda s: s["specifier"]), ",")
    out = kept.groupBy("name").agg(pin, ranges.alias("specifier"))
    return out.select("name", F.col("pin.version").alias("version"), F.when(F.col("pin").isNull(), F.col("specifier")).alias("specifier"))
