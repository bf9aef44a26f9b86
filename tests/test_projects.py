import math

from pyspark.sql import functions as F

from tidemark.functions.versions import version_key
from tidemark.operators import projects
from tidemark.operators import statistics as st


def test_scanned_filter(spark):
    deps = spark.createDataFrame([("A_b", True), ("c", False), ("d", False)], "name string, direct boolean")
    imported = spark.createDataFrame([("D",)], "name string")
    names = lambda **k: sorted(r["name"] for r in projects.scanned(deps, imported, **k).collect())
    assert names() == ["A_b", "d"] and names(every=True, exclude=["a.b"]) == ["c", "d"] and names(include=["C"]) == ["c"]


def test_merged_falls_back(spark):
    lock = spark.createDataFrame([("a", "1", False)], "name string, version string, direct boolean")
    inst = spark.createDataFrame([("a", "0"), ("b", "2")], "name string, version string")
    none = spark.createDataFrame([], "name string, version string")
    got = {r["name"]: (r["version"], r["source"], r["direct"]) for r in projects.merged(lock, inst, none).collect()}
    assert got == {"a": ("1", "lock", True), "b": ("2", "installed", False)}
    assert [tuple(r) for r in projects.pin_conflicts(inst, lock.select("name", "version")).collect()] == [("a", "0", "1")]


def test_declared_once(spark):
    rows = [("a", "1.9", "==1.9", True, 0), ("a", "1.10", "==1.10", True, 1), ("a", "2.0", "==2.0", False, 2), ("b", None, ">=1", False, 0), ("b", None, "<3", False, 1)]
    df = spark.createDataFrame(rows, "name string, version string, specifier string, applies boolean, ordinal int")
    got = {r["name"]: (r["version"], r["specifier"]) for r in projects.declared_once(df, version_key(F.col("version"))).collect()}
    assert got == {"a": ("1.10", None), "b": (None, ">=1,<3")}


def test_intervals(spark):
    rows = [("x", v, True) for v in (1.0, 2.0, 3.0)] + [("x", v, False) for v in (2.0, 4.0, 6.0)] + [("y", 1.0, True), ("y", 2.0, False), ("y", 3.0, False)]
    got = {r["k"]: r for r in st.welch(spark.createDataFrame(rows, "k string, v double, a boolean"), ["k"], F.col("v"), F.col("a")).collect()}
    # error sqrt(1/3 + 4/3), freedom (5/3)^2 / ((1/3)^2 / 2 + (4/3)^2 / 2), t(0.975; 2.941) = 3.2185
    assert got["x"]["gap"] == -2.0 and abs(got["x"]["freedom"] - 2.9412) < 1e-4 and abs(got["x"]["high"] + 2.0 - 3.2185 * math.sqrt(5 / 3)) < 5e-3
    assert got["y"]["low"] is None and got["y"]["gap"] == -1.5
    near = spark.createDataFrame([("n", i, v) for i, v in enumerate((0.01, -0.01, 0.0, 0.02))] + [("f", i, v) for i, v in enumerate((0.5, 0.6))], "k string, i int, v double")
    assert {r["k"]: r["equivalent"] for r in st.equivalent(near, ["k"], F.col("v"), "i", 0.1, 500).collect()} == {"n": True, "f": False}
