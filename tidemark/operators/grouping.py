"""Roll-ups of change records and set-valued aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def representative(df: DataFrame, keys: Sequence[str], order: Sequence[str], keep: Sequence[str], count: str | None = None) -> DataFrame:
    """One row a key: the smallest by ``order`` gives ``keep``; ``count`` columns are summed."""
    first = F.min(F.struct(*order, *[k for k in keep if k not in order])).alias("_first")
    total = F.sum(count).alias("occurrences") if count else F.count("*").alias("occurrences")
    return df.groupBy(*keys).agg(first, total).select(*keys, *[F.col(f"_first.{k}").alias(k) for k in keep], "occurrences")


def collapse(df: DataFrame, keys: Sequence[str], path: str, order: Sequence[Column], also: int = 5) -> DataFrame:
    """Keep-first duplicates: the first row of each key by ``order``, how many there were and the
    next ``also`` paths.  Paths beyond those are never gathered."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w)).withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    near = ranked.where(F.col("_r") <= also + 1)
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("_r") > 1, F.struct("_r", path)))), lambda x: x[path])
    return near.groupBy(*keys).agg(F.max(F.when(F.col("_r") == 1, F.col(path))).alias(path), F.max("_n").alias("occurrences"), others.alias("also"))


def grouped_moves(df: DataFrame, source: str, target: str, clean: Column, least: int = 3, least_sole: int = 2) -> DataFrame:
    """(source, target) with at least ``least`` moves, or ``least_sole`` if it is the source's only
    target, and nothing left behind (``clean`` on every row)."""
    pairs = df.groupBy(source, target).agg(F.count("*").alias("n"), F.bool_and(clean).alias("_clean"))
    targets = F.count("*").over(Window.partitionBy(source))
    pairs = pairs.withColumn("targets", targets)
    return pairs.where(F.col("_clean") & ((F.col("n") >= least) | ((F.col("n") >= least_sole) & (F.col("targets") == 1)))).drop("_clean")


def conditional_counts(df: DataFrame, keys: Sequence[str], conditions: dict[str, Column]) -> DataFrame:
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()])


def set_fingerprint(df: DataFrame, keys: Sequence[str], item: Column, digits: int = 12) -> DataFrame:
    """Order-insensitive hash of the distinct items of a key."""
    text = F.array_join(F.array_sort(F.collect_set(item)), "\n")
    return df.groupBy(*keys).agg(F.substring(F.sha2(text, 256), 1, digits).alias("fingerprint"))


def divide(df: DataFrame, key: str, required: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keys of ``df`` that have every row of ``required`` (relational division)."""
    need = required.select(*columns).distinct()
    total = need.agg(F.count("*").alias("_need"))
    have = df.select(key, *columns).distinct().join(need, list(columns)).groupBy(key).agg(F.count("*").alias("_have"))
    return have.crossJoin(F.broadcast(total)).where("_have = _need").select(key)


def unique_names(df: DataFrame, name: str, owner: str) -> DataFrame:
    """Names that one owner alone has."""
    return df.groupBy(name).agg(F.count_distinct(owner).alias("owners"), F.min(owner).alias(owner)).where("owners = 1").drop("owners")


def majority(df: DataFrame, keys: Sequence[str], fixed: Column) -> DataFrame:
    """n, fixed and whether more than half are fixed."""
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(fixed).alias("fixed")).withColumn("majority", 2 * F.col("fixed") > F.col("n"))


def recall(df: DataFrame, keys: Sequence[str], found: Column, among: Column | None = None) -> DataFrame:
    """AG24: (keys, n, hits, share, low, high): the share of rows that were found, of those where ``among`` holds."""
    from .statistics import wilson

    rows = df if among is None else df.where(among)
    counts = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count_if(found).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counts.select(*keys, "n", "hits", (F.col("hits") / F.col("n")).alias("share"), low.alias("low"), high.alias("high"))


def decomposition(df: DataFrame, keys: Sequence[str], parts: Sequence[str], arm: Column, treated: str, control: str) -> DataFrame:
    """AG25: (keys, part, treated, control, change, share): totals of each part in two arms, the change, and its share
    of the change of all parts together; sums come before the unpivot."""
    rows = df.withColumn("_arm", arm).where(F.col("_arm").isin(treated, control))
    sums = [F.sum(F.when(F.col("_arm") == a, F.col(p))).alias(f"{p}|{a}") for p in parts for a in (treated, control)]
    wide = rows.groupBy(*keys).agg(*sums)
    zero = lambda p, a: F.coalesce(F.col(f"`{p}|{a}`"), F.lit(0))
    whole = sum((zero(p, treated) - zero(p, control) for p in parts[1:]), zero(parts[0], treated) - zero(parts[0], control))
    entries = F.array(*[F.struct(F.lit(p).alias("part"), zero(p, treated).alias("treated"), zero(p, control).alias("control")) for p in parts])
    out = wide.select(*keys, whole.alias("_all"), F.explode(entries).alias("_e")).select(*keys, "_all", "_e.*").withColumn("change", F.col("treated") - F.col("control"))
    return out.withColumn("share", F.when(F.col("_all") != 0, F.col("change") / F.col("_all"))).drop("_all")
