"""Windows, budgets, samples and composite orders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by ``order`` (arg-max, keep-first dedup)."""
    return top_n(df, keys, order, 1).drop("rank")


def top_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each key by ``order``, with ``rank`` from 1."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def round_robin(df: DataFrame, key: str, order: Sequence[Column], group_order: Sequence[Column], budget: int) -> DataFrame:
    """Rows taken in turns from every key's order until ``budget`` is spent.

    The turn is the row's rank in its key; within a turn keys come by
    ``group_order``.  Only ``budget`` rows of a key can be taken, so the final order
    sees no more than that from each."""
    turns = top_n(df, [key], order, max(budget, 0)).withColumnRenamed("rank", "turn")
    return turns.orderBy("turn", *group_order).limit(max(budget, 0))


def hash_sample(df: DataFrame, key: str, n: int, salt: str = "") -> DataFrame:
    """``n`` rows in the order of a stable hash of ``key``."""
    return df.withColumn("_h", F.sha2(F.concat(F.lit(salt), F.col(key).cast("string")), 256)).orderBy("_h").limit(n).drop("_h")


def span(df: DataFrame, by: str, parts: int | None = None) -> Column:
    """The number of a row's range when the values of ``by`` (numbers or times) are cut into ranges of
    about equal numbers of rows; equal values share a range, nulls are in the first."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    value = F.col(by).cast("double")
    cuts = df.agg(F.percentile_approx(value, [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    edges = [F.lit(float(c)) for c in sorted(set(cuts or []))]
    return F.size(F.filter(F.array(*edges), lambda c: c < value)) if edges else F.lit(0)


def _over_ranges(df: DataFrame, value: Column, name: str, fold, start) -> DataFrame:
    """``df`` (with ``_span``) with the fold of ``value`` over all earlier ranges, one row a range."""
    each = df.groupBy("_span").agg(fold(value).alias("_v"))
    earlier = Window.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select("_span", F.coalesce(fold(F.col("_v")).over(earlier), F.lit(start)).alias(name))
    return df.join(F.broadcast(offsets), "_span")  # as many rows as ranges


def _sum_before(df: DataFrame, value: str, keys: Sequence[str], by: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before each row; without keys, ranges of ``by`` are
    summed in parallel."""
    if keys:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0)))
    placed = df.withColumn("_span", span(df, by))
    w = Window.partitionBy("_span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = _over_ranges(placed.withColumn("_own", F.coalesce(F.sum(value).over(w), F.lit(0))), F.col(value), "_past", F.sum, 0)
    return placed.withColumn(name, F.col("_own") + F.col("_past")).drop("_own", "_past", "_span")


def fractional_rank(df: DataFrame, value: str, keys: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Average rank with ties, from value frequencies instead of all rows in one order."""
    counts = df.groupBy(*keys, value).agg(F.count("*").alias("_n"))
    placed = _sum_before(counts, "_n", keys, value, [value], "_before")
    placed = placed.withColumn(name, F.col("_before") + (F.col("_n") + 1) / 2)
    return df.join(placed.drop("_n", "_before"), [*keys, value])


def holm(df: DataFrame, p: str, keys: Sequence[str] = (), name: str = "p_holm") -> DataFrame:
    """Holm step-down: (m - rank) * p, running maximum in the order of p, at most 1."""
    if keys:
        by = Window.partitionBy(*keys).orderBy(p)
        m = F.count("*").over(Window.partitionBy(*keys))
        placed = df.withColumn("_step", (m - F.row_number().over(by) + 1) * F.col(p)).withColumn("_past", F.lit(0.0))
        running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    else:
        placed = df.withColumn("_span", span(df, p))
        by = Window.partitionBy("_span").orderBy(p)
        placed = _over_ranges(placed.withColumn("_rank", F.row_number().over(by)), F.lit(1), "_earlier", F.sum, 0)
        placed = placed.join(F.broadcast(df.agg(F.count("*").alias("_m"))))  # one row
        placed = placed.withColumn("_step", (F.col("_m") - F.col("_earlier") - F.col("_rank") + 1) * F.col(p))
        placed = _over_ranges(placed, F.col("_step"), "_past", F.max, 0.0)
        running = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = placed.withColumn(name, F.least(F.lit(1.0), F.greatest("_past", F.max("_step").over(running))))
    return out.select(*df.columns, name)


def lru_evict(df: DataFrame, size: str, used: str, cap: int, tie: str, evictable: Column | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Entries to evict, oldest first, until what remains fits ``cap``.

    ``evictable`` keeps protected entries, whose sizes still count."""
    total = df.groupBy(*keys).agg(F.sum(size).alias("_total"))
    able = _sum_before(df if evictable is None else df.where(evictable), size, keys, used, [used, tie], "freed")
    joined = able.join(total, list(keys)) if keys else able.crossJoin(F.broadcast(total))  # one row
    return joined.where(F.col("_total") - F.col("freed") > cap).drop("_total")


def change_score(kind_priority: Column, usage: Column, class_named: Column, path: Column, occurrences: Column, documented: Column, hinted: Column, noise: Column, segment_penalty: Column, top_level: Column) -> Column:
    """The weighted score by which changes are ranked; conditions are booleans."""
    dots = F.length(path) - F.length(F.replace(path, F.lit("."), F.lit("")))
    flag = lambda c: c.cast("double")
    return (
        F.lit(10.0) - 1.5 * kind_priority + 3.0 * usage + 2.0 * flag(class_named) + F.greatest(F.lit(0.0), 3.0 - 0.75 * dots)
        + F.least(F.lit(2.0), F.log2(occurrences + 1) - 1) + flag(documented) + 0.5 * flag(hinted) - 4.0 * flag(noise) - segment_penalty - flag(top_level)
    )
