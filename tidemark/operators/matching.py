"""As-of selection, snapshot comparison and tiered matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import best_per_key


def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, when: str, order: Sequence[Column], how: str = "left", given: Sequence[str] = (), holds: Column | None = None) -> DataFrame:
    """For every row of ``left`` the best row of ``right`` with an equal key and ``at`` <= ``when``.

    ``holds`` is a further condition on the candidates; it may read the columns ``given`` of
    ``left``, which are never null.
    ``order`` ranks the candidates, best first, e.g. final versions before others.
    Rows of ``left`` that ask the same are asked once.  The equi-join deals by key and the
    range is its filter; where ``left`` is one date for all, filter ``right`` and use
    ``best_per_key`` instead."""
    by = [*keys, when, *given]
    found = left.select(*by).distinct().join(right, list(keys)).where(F.col(at) <= F.col(when))
    found = found if holds is None else found.where(holds)
    return left.join(best_per_key(found, by, order), by, how)


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``keys``, ``change`` (added, removed, changed), ``old_*`` and ``new_*`` of the keys that differ."""
    o = old.select(*keys, *[F.col(v).alias(f"old_{v}") for v in values], F.lit(True).alias("_old"))
    n = new.select(*keys, *[F.col(v).alias(f"new_{v}") for v in values], F.lit(True).alias("_new"))
    same = reduce(lambda a, b: a & b, [F.col(f"old_{v}").eqNullSafe(F.col(f"new_{v}")) for v in values], F.lit(True))
    kind = F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").when(~same, "changed")
    return o.join(n, list(keys), "full_outer").withColumn("change", kind).where("change is not null").drop("_old", "_new")


def priority_union(frames: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Union where the first frame that has a key gives its rows; ``tier`` from 0."""
    tiers = [f.withColumn("tier", F.lit(i)) for i, f in enumerate(frames)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tiers)
    return every.withColumn("_best", F.min("tier").over(Window.partitionBy(*keys))).where("tier = _best").drop("_best")


def override(base: DataFrame, overrides: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """``base`` with the values of ``overrides`` where it has them."""
    o = overrides.select(*keys, *[F.col(v).alias(f"_o_{v}") for v in values])
    return base.join(o, list(keys), "left").withColumns({v: F.coalesce(f"_o_{v}", v) for v in values}).drop(*[f"_o_{v}" for v in values])


def longest_prefix(left: DataFrame, path: Column, table: DataFrame, prefix: str, row_keys: Sequence[str], separator: str = ".") -> DataFrame:
    """``left`` joined with the row of ``table`` whose ``prefix`` is its path's longest prefix."""
    parts = F.split(path, "[" + separator + "]")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), separator))
    spread = left.select("*", F.posexplode(prefixes).alias("_length", prefix))
    return best_per_key(spread.join(table, prefix), row_keys, [F.desc("_length")]).drop("_length")


def overlap_pairs(members: DataFrame, key: str, member: str, least: float, group: Sequence[str] = ()) -> DataFrame:
    """Pairs of different keys with at least ``least`` of the first key's members in common.

    ``members`` is distinct in (group, key, member).  A key that has n members and must keep
    k of them shares one of its n - k + 1 rarest members with every partner, so only
    those lead to candidates; members that many keys hold join last or not at all."""
    sizes = members.groupBy(*group, key).agg(F.count("*").alias("n"))
    holders = members.groupBy(*group, member).agg(F.count("*").alias("_holders"))
    rare = Window.partitionBy(*group, key).orderBy("_holders", member)
    need = F.greatest(F.lit(1), F.ceil(F.lit(least) * F.col("n") - 1e-9))
    prefix = members.join(holders, [*group, member]).withColumn("_at", F.row_number().over(rare)).join(sizes, [*group, key])
    prefix = prefix.where(F.col("_at") <= F.col("n") - need + 1)
    other = members.select(*group, F.col(key).alias("other"), member)
    met = prefix.select(*group, key, member).join(other, [*group, member]).where(F.col(key) != F.col("other")).select(*group, key, "other").distinct()
    sets = members.groupBy(*group, key).agg(F.collect_set(member).alias("_own"))
    both = met.join(sets, [*group, key]).join(sets.select(*group, F.col(key).alias("other"), F.col("_own").alias("_theirs")), [*group, "other"])
    shared = both.select(*group, key, "other", F.size(F.array_intersect("_own", "_theirs")).cast("long").alias("kept"))
    return shared.join(sizes, [*group, key]).where(F.col("kept") >= least * F.col("n"))


def semi_anti(left: DataFrame, right: DataFrame, keys: Sequence[str], flag: str = "used") -> DataFrame:
    """``left`` with a flag for the rows whose key ``right`` has."""
    has = right.select(*keys).distinct().withColumn(flag, F.lit(True))
    return left.join(has, list(keys), "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def strict_or_loose(strict: DataFrame, loose: DataFrame) -> DataFrame:
    """``strict``, or ``loose`` if it is empty; decided inside the plan."""
    some = strict.agg(F.count("*").alias("_n"))
    return strict.unionByName(loose.crossJoin(F.broadcast(some)).where("_n = 0").drop("_n"))


def merge_aliases(df: DataFrame, path: str, alias: str, count: str) -> DataFrame:
    """Rows whose ``alias`` is the path of another row are absorbed by it, with their count."""
    targets = df.select(F.col(path).alias("_target")).distinct()
    absorbed = df.join(targets, (F.col(alias) == F.col("_target")) & (F.col(alias) != F.col(path)), "left_semi")
    extra = absorbed.groupBy(F.col(alias).alias(path)).agg(F.sum(count).alias("_more"))
    kept = df.join(absorbed.select(path), path, "left_anti").join(extra, path, "left")
    return kept.withColumn(count, F.col(count) + F.coalesce("_more", F.lit(0))).drop("_more")


def unique_containment(members: DataFrame, gone: DataFrame, fresh: DataFrame, key: str, member: str, group: Sequence[str] = (), least: int = 5) -> DataFrame:
    """Renames: (group, key, other) where a fresh key holds at least 80 percent and ``least`` of a
    gone key's members and no other fresh key does."""
    old = members.join(gone, [*group, key], "left_semi")
    new = members.join(fresh, [*group, key], "left_semi").withColumnRenamed(key, "other")
    sizes = old.groupBy(*group, key).agg(F.count("*").alias("n"))
    kept = old.join(new, [*group, member]).groupBy(*group, key, "other").agg(F.count("*").alias("kept"))
    good = kept.join(sizes, [*group, key]).where((F.col("n") >= least) & (5 * F.col("kept") >= 4 * F.col("n")))
    return good.withColumn("_c", F.count("*").over(Window.partitionBy(*group, key))).where("_c = 1").drop("_c")
