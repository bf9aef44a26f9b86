import pytest
from pyspark.sql import functions as F

from tidemark.functions.versions import satisfies
from tidemark.plans.release_diff import current_releases

VERSIONS = ["1.0", "1.0.0", "1.0.1", "1.0a1", "1.0.dev2", "1.0.post1", "1.0+abc", "1.1rc1", "1.1", "1.10", "2.0", "2.0b2", "2!1.0", "0.9.9", "1.0.1.post2"]
SPECIFIERS = ["", ">=1.0", ">1.0", "<1.1", "<=1.0", "==1.0", "!=1.0", "==1.0.*", "!=1.0.*", "~=1.0", "~=1.0.0", "~=1.0.1", ">=1.0,<2", ">1.0.post1", "<2.0b2", "==1.0+abc", "===1.0", ">=1.1rc1,!=1.10", "==1.*"]


def test_against_the_library(spark):
    specifiers = pytest.importorskip("packaging.specifiers")
    rows = [(v, s) for v in VERSIONS for s in SPECIFIERS]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, v string, s string")
    got = [r[0] for r in df.orderBy("i").select(satisfies(F.col("v"), F.col("s"))).collect()]
    want = [specifiers.SpecifierSet(s).contains(v, prereleases=True) for v, s in rows]
    assert [(r, g) for r, g, w in zip(rows, got, want, strict=True) if g != w] == []


def test_awkward_clauses(spark):
    rows = [("1.0", None, True), ("no version", ">=1", False), ("1.0", "junk", False), (None, ">=1", False), ("1.0", " >= 0.9 , < 2 ", True), ("1.0", ">=1.*", False)]
    df = spark.createDataFrame([(i, v, s) for i, (v, s, _) in enumerate(rows)], "i int, v string, s string")
    assert [r[0] for r in df.orderBy("i").select(satisfies(F.col("v"), F.col("s"))).collect()] == [w for *_, w in rows]


def test_current_release_within_bounds(spark):
    schema = "package string, version string, uploaded timestamp, yanked boolean, requires_python string"
    made = [("p", v, day, False, python) for v, day, python in (("1.0", "2024-01-01", None), ("1.5", "2024-02-01", ">=3.8"), ("2.0", "2024-03-01", ">=3.13"))]
    releases = spark.createDataFrame(made, "package string, version string, uploaded string, yanked boolean, requires_python string")
    releases = releases.withColumn("uploaded", F.to_timestamp("uploaded")).select(*[c.split(" ")[0] for c in schema.split(", ")])
    asked = spark.createDataFrame([("p", "2024-12-31", None), ("p", "2024-12-31", "<1.5"), ("p", "2023-01-01", None)], "package string, cutoff string, specifier string")
    asked = asked.withColumn("cutoff", F.to_date("cutoff"))
    got = lambda **k: {(str(r["cutoff"]), r["specifier"]): r["version"] for r in current_releases(releases, asked, **k).collect()}
    assert got() == {("2024-12-31", ""): "2.0", ("2024-12-31", "<1.5"): "1.0", ("2023-01-01", ""): None}
    assert got(python="3.12")[("2024-12-31", "")] == "1.5"
