import random

from pyspark.sql import functions as F

from tidemark.functions import scalar as S
from tidemark.operators import graph, grouping, incremental, matching, ranking
from tidemark.operators import statistics as st


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_snapshot_diff(spark):
    old = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, None), (4, "d")], "k int, v string")
    got = rows(matching.snapshot_diff(old, new, ["k"], ["v"]).select("k", "change"))
    assert got == [(1, "changed"), (3, "removed"), (4, "added")]


def test_as_of_keeps_rows_without_match(spark):
    left = spark.createDataFrame([("p", 5), ("p", 1), ("q", 9)], "k string, cut int")
    right = spark.createDataFrame([("p", 2, "x"), ("p", 4, "y"), ("p", 6, "z")], "k string, at int, v string")
    got = rows(matching.as_of(left, right, ["k"], "at", "cut", [F.desc("at")]).select("k", "cut", "v"))
    assert got == [("p", 1, None), ("p", 5, "y"), ("q", 9, None)]


def test_round_robin_is_fair(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", i) for i in range(2)], "k string, v int")
    got = [tuple(r) for r in ranking.round_robin(df, "k", [F.desc("v")], [F.asc("k")], 6).select("k", "v").collect()]
    assert got == [("a", 8), ("b", 1), ("a", 7), ("b", 0), ("a", 6), ("a", 5)]
    assert ranking.round_robin(df, "k", [F.desc("v")], [F.asc("k")], -1).count() == 0


def test_lru_matches_a_loop(spark):
    rng = random.Random(4)
    for _ in range(3):
        items = [(i, rng.randint(1, 9), rng.randint(0, 5)) for i in range(12)]
        left, out = sum(s for _, s, _ in items), []
        for i, s, _ in sorted(items, key=lambda t: (t[2], t[0])):
            if left > 20:
                out.append(i)
                left -= s
        df = spark.createDataFrame([(i, s, u, 0) for i, s, u in items], "id int, s long, u int, g int")
        assert sorted(r["id"] for r in ranking.lru_evict(df, "s", "u", 20, "id", keys=["g"]).collect()) == sorted(out)


def test_holm_and_fractional_rank(spark):
    df = spark.createDataFrame([(1, 0.01), (2, 0.04), (3, 0.03)], "id int, p double")
    assert {r["id"]: round(r["p_holm"], 9) for r in ranking.holm(df, "p").collect()} == {1: 0.03, 2: 0.06, 3: 0.06}
    ties = spark.createDataFrame([(1,), (2,), (2,), (5,)], "v int")
    assert sorted(r["rank"] for r in ranking.fractional_rank(ties, "v").collect()) == [1.0, 2.5, 2.5, 4.0]


def test_collapse_and_division(spark):
    df = spark.createDataFrame([("x", f"p{i}", i) for i in range(8)] + [("y", "q", 0)], "k string, path string, o int")
    got = {r["k"]: (r["path"], r["occurrences"], r["also"]) for r in grouping.collapse(df, ["k"], "path", [F.asc("o")]).collect()}
    assert got == {"x": ("p0", 8, ["p1", "p2", "p3", "p4", "p5"]), "y": ("q", 1, [])}
    have = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("b", 1)], "k string, v int")
    assert [r["k"] for r in grouping.divide(have, "k", have, ["v"]).collect()] == ["a"]


def test_closure_with_cycle(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "x string, y string")
    got = {(r["node"], r["ancestor"]): r["depth"] for r in graph.closure(edges, "x", "y").collect()}
    assert got[("d", "c")] == 3 and got[("a", "c")] == 2 and ("a", "a") not in got and len(got) == 9


def test_state_and_upsert(spark):
    stored = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1"), ("d", "1")], "k string, v string")
    now = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", None)], "k string, v string")
    assert {r["k"]: r["state"] for r in incremental.compare_state(stored, now, "k", "v").collect()} == {"a": "current", "b": "out_of_date", "c": "unpinned", "d": "orphan"}
    assert rows(incremental.upsert(stored, now, ["k"])) == [("a", "1"), ("b", "2"), ("c", None), ("d", "1")]


def test_global_orders_over_ranges(spark):
    rng = random.Random(6)
    items = [(i, rng.randint(1, 9), rng.choice([None, *range(30)]), rng.random()) for i in range(300)]
    df = spark.createDataFrame(items, "id int, s long, u int, p double")
    order = sorted(items, key=lambda t: (t[2] is not None, t[2] or 0, t[0]))
    left, want = sum(t[1] for t in items), []
    for t in order:
        if left > 400:
            want.append(t[0])
            left -= t[1]
    assert sorted(r["id"] for r in ranking.lru_evict(df, "s", "u", 400, "id").collect()) == sorted(want)
    holm, top = {}, 0.0
    for k, t in enumerate(sorted(items, key=lambda t: t[3])):
        top = max(top, (300 - k) * t[3])
        holm[t[0]] = min(1.0, top)
    got = {r["id"]: r["p_holm"] for r in ranking.holm(df, "p").collect()}
    assert all(abs(got[i] - holm[i]) < 1e-12 for i in holm)


def test_overlap_pairs_match_a_loop(spark):
    rng = random.Random(5)
    sets = {k: {rng.randint(0, 12) for _ in range(rng.randint(1, 8))} | {99} for k in range(40)}
    df = spark.createDataFrame([(k, v) for k, s in sets.items() for v in s], "k int, v int")
    got = {(r["k"], r["other"]): (r["kept"], r["n"]) for r in matching.overlap_pairs(df, "k", "v", 0.6).collect()}
    assert got == {(a, b): (len(sets[a] & sets[b]), len(sets[a])) for a in sets for b in sets if a != b and len(sets[a] & sets[b]) >= 0.6 * len(sets[a])}


def test_exact_tests(spark):
    from math import comb

    cases = [(0, 0), (1, 9), (7, 3), (500, 430)]
    df = spark.createDataFrame(cases, "a int, b int")
    for r in df.withColumn("p", st.sign_test("a", "b")).collect():
        n, k = r["a"] + r["b"], min(r["a"], r["b"])
        assert abs(r["p"] - min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2**n)) < 1e-9
    tables = [(1, 9, 11, 3), (3, 1, 1, 3), (0, 5, 5, 0), (10, 10, 10, 10), (0, 0, 0, 0), (40, 2, 30, 25)]
    df = spark.createDataFrame(tables, "a int, b int, c int, d int")
    for r in df.withColumn("p", st.fisher("a", "b", "c", "d")).collect():
        row, column, total = r["a"] + r["b"], r["a"] + r["c"], r["a"] + r["b"] + r["c"] + r["d"]
        ways = {x: comb(row, x) * comb(total - row, column - x) for x in range(max(0, column + row - total), min(row, column) + 1)}
        assert abs(r["p"] - sum(w for w in ways.values() if w <= ways[r["a"]]) / sum(ways.values())) < 1e-9
    df = spark.createDataFrame([(8, 10), (0, 5), (5, 5), (0, 0)], "k int, n int")
    low, high = st.clopper_pearson("k", "n")
    got = [(round(r[0], 6), round(r[1], 6)) for r in df.select(low, high).collect()]
    assert got == [(0.443905, 0.974789), (0.0, 0.521824), (0.478176, 1.0), (0.0, 1.0)]


def test_resamples_are_not_broadcast(spark):
    """Sizes are guessed without what explode adds, so a small table's draws would look small too."""
    rows = spark.range(60).select((F.col("id") % 3).alias("k"), F.col("id").alias("row"), (F.col("id") % 7).cast("double").alias("v"))
    drawn = st.resampled(rows, ["k"], "row", {"_sum": F.col("v"), "_n": F.lit(1)}, resamples=50)
    plan = drawn._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    assert [tuple(r) for r in drawn.groupBy("k").agg(F.count("*"), F.min("_n"), F.max("_n")).orderBy("k").collect()] == [(k, 50, 20, 20) for k in range(3)]


def test_permutation_tests_by_enumeration(spark):
    from itertools import combinations, product

    rng = random.Random(8)
    values = [(g, i, round(rng.gauss(0.4, 1), 3), rng.random() < 0.4) for g in "ab" for i in range(9)]
    df = spark.createDataFrame(values, "g string, i int, v double, on boolean")
    flips = {r["g"]: r for r in st.sign_flip(df, ["g"], F.col("v")).collect()}
    labels = {r["g"]: r["p"] for r in st.label_permutation(df, ["g"], F.col("v"), F.col("on")).collect()}
    for g in "ab":
        v = [x for k, _, x, _ in values if k == g]
        sums = [sum(s * x for s, x in zip(signs, v, strict=True)) for signs in product((1, -1), repeat=9)]
        assert abs(flips[g]["p"] - sum(abs(s) >= abs(sum(v)) - 1e-9 for s in sums) / 512) < 1e-9 and flips[g]["n"] == 9
        assert abs(flips[g]["p_greater"] - sum(s >= sum(v) - 1e-9 for s in sums) / 512) < 1e-9
        on = [x for k, _, x, f in values if k == g and f]
        ways = [abs(sum(c) / len(on) - (sum(v) - sum(c)) / (9 - len(on))) for c in combinations(v, len(on))]
        own = abs(sum(on) / len(on) - (sum(v) - sum(on)) / (9 - len(on)))
        assert abs(labels[g] - sum(w >= own - 1e-9 for w in ways) / len(ways)) < 1e-9
    assert st.label_permutation(spark.createDataFrame([(float(x), x > 5) for x in (1, 2, 3, 7, 8, 9)], "v double, l boolean"), [], F.col("v"), F.col("l")).first()["p"] == 0.1


def test_sign_flips_of_many_values(spark):
    """Thousands of values: by whole-number arithmetic, and by hand where the values are alike."""
    from math import comb

    rng = random.Random(5)
    some = [rng.randrange(-5500, 5500) for _ in range(300)]
    rows = [("some", float(v)) for v in some] + [("alike", 2.5)] * 1300 + [("alike", -2.5)] * 1200 + [("cents", v / 100) for v in some] + [("none", 0.0)]
    got = {r["g"]: r for r in st.sign_flip(spark.createDataFrame(rows, "g string, v double"), ["g"], F.col("v")).collect()}
    ways = 1  # a whole number that holds the count of each sum in 320 bits of its own
    for v in some:
        ways += ways << 320 * abs(v)
    whole, own, total = ways.to_bytes(40 * (sum(map(abs, some)) + 1), "little"), sum(some), sum(map(abs, some))
    counts = [int.from_bytes(whole[i : i + 40], "little") for i in range(0, len(whole), 40)]
    for g in ("some", "cents"):
        assert abs(got[g]["p_greater"] - sum(counts[(own + total) // 2 :]) / 2**300) < 1e-12
        assert abs(got[g]["p_less"] - sum(counts[: (own + total) // 2 + 1]) / 2**300) < 1e-12
        assert abs(got[g]["p"] - sum(c for i, c in enumerate(counts) if abs(2 * i - total) >= abs(own)) / 2**300) < 1e-12
    tail = sum(comb(2500, i) for i in range(1300, 2501)) / 2**2500
    assert got["alike"]["n"] == 2500 and abs(got["alike"]["p_greater"] - tail) < 1e-12 and abs(got["alike"]["p"] - 2 * tail) < 1e-12
    assert tuple(got["none"])[1:] == (0, 1.0, 1.0, 1.0)


def test_sign_flips_round_only_what_fits_no_grid():
    import numpy as np

    exact = np.array([1234.56, -5499.99, 0.01] * 8)
    units, whole = st._units(exact)
    assert whole and units.tolist() == [123456, -549999, 1] * 8
    assert not st._units(np.array([1e6 / 3, -2e6 / 7]))[1] and abs(st._units(np.array([1e6 / 3, -2e6 / 7]))[0]).sum() <= st.GRID
    ways = st._subset_sums(np.arange(1, 2001))  # by halves; the sums of all ways, their mean and their spread
    at = np.arange(len(ways))
    assert abs(ways.sum() - 1) < 1e-12 and abs((ways * at).sum() - 2001 * 500) < 1e-6
    assert abs((ways * (at - 2001 * 500.0) ** 2).sum() / (2000 * 2001 * 4001 / 24) - 1) < 1e-9


def test_sign_flip_query_counts_zeros_and_nulls_as_sql(spark, tmp_path):
    import duckdb

    from tidemark.plans import catalog

    rows = [(i, i % 4 if i % 4 < 3 else None, None if i % 4 == 2 or i == 5 else 4500.0 if i < 6 else 1000.0 * i) for i in range(24)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").write.parquet(str(tmp_path / "supplier.parquet"))
    got = [tuple(r) for r in catalog.QUERIES["sign_flip_by_nation"](spark, str(tmp_path)).collect()]
    connection = duckdb.connect()
    connection.sql(f"create view supplier as from '{tmp_path}/supplier.parquet/*.parquet'")
    assert sorted(got) == sorted(connection.sql(catalog.ORACLE_SQL["sign_flip_by_nation"]).fetchall())


def test_scalars(spark):
    df = spark.createDataFrame([("2025",), ("2024-02",), ("2025-03-04",), ("soon",)], "d string")
    assert [str(r[0]) for r in df.select(S.parse_cutoff(F.col("d"))).collect()] == ["2025-12-31", "2024-02-29", "2025-03-04", "None"]
    one = spark.range(1)
    got = one.select(
        S.canonical_name(F.lit("A__b-.C")), S.plain_owner(F.lit("AsyncClientWithRawResponse")), S.module_of(F.lit("a.b.C.d"), F.lit(True)), S.has_beta_segment(F.lit("x.v1beta2.y")),
        S.same_spelling(F.lit("getName"), F.lit("get_name")), S.percent(F.lit(1), F.lit(8)), S.estimate_tokens(F.lit("")), S.name_words(F.lit("HTTPServer_name2")),
    ).first()
    assert tuple(got) == ("a-b-c", "Client", "a.b", True, True, 12, 1, ["http", "server", "name", "2"])
