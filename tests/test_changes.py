import random

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.markers import marker_applies
from tidemark.operators import calls, changes, matching
from tidemark.operators import statistics as st
from tidemark.sources import environments as env
from tidemark.sources import python_api


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_change_filters(spark):
    schema = "package string, kind string, owner string, name string, parameter string, old_signature string, new_signature string, deprecated_by string, tier string"
    df = spark.createDataFrame(
        [
            ("p", "param_removed", None, "send", "limit", "send(limit: int = 1)", None, None, "public"),
            ("p", "removed", "ListParams", "limit", None, None, None, None, None),
            ("q", "removed", "ListParams", "limit", None, None, None, None, "internal"),
            ("p", "param_required", None, "hook", "cfg", None, "hook(cfg: _Private)", "x", "public"),
            ("p", "dependency_switched", None, "Client", None, None, None, None, "public"),
        ],
        schema,
    )
    assert [(r["package"], r["name"]) for r in changes.worth_a_note(df).orderBy("package", "name").collect()] == [("p", "Client"), ("p", "send"), ("q", "limit")]
    assert changes.probeable(df).count() == 3
    assert [f.count() for f in changes.by_tier(df)] == [4, 1]
    cases = [("removed", None, ["a"], "old"), ("param_removed", "x", ["a"], "uses"), ("param_removed", "x", ["a", "x"], "old"), ("param_required", "x", ["a", "x"], "uses"), ("dependency_switched", None, ["a", "except b.E"], "old"), ("dependency_switched", None, ["a", "b"], "uses"), ("removed", None, [], "uses")]
    got = spark.createDataFrame([c[:3] for c in cases], "k string, p string, n array<string>").select(changes.use_form(F.col("k"), F.col("p"), F.col("n"))).collect()
    assert [r[0] for r in got] == [c[3] for c in cases]


def test_orders(spark):
    df = spark.createDataFrame([("param_removed", p, "f(b: Dict[str, int], a, *args, **kw)", f"m.{p}") for p in ("z", "a", "b", "kw")], "kind string, parameter string, old_signature string, path string").withColumn("new_signature", F.lit(None).cast("string"))
    assert [r["parameter"] for r in changes.canonical_order(df, F.lit(1)).collect()] == ["b", "a", "kw", "z"]
    uses = spark.createDataFrame([("p", 0, "x", 0, "name_only", "uses"), ("q", 1, "y", 0, "name_only", "old"), ("q", 1, "z", 1, "path", "uses"), ("q", 1, "w", 2, "name", "old"), ("q", 1, "w", 2, "path", "uses")], "package string, ordinal int, api string, position int, how string, form string")
    assert [(r["api"], r["match"], r["old"]) for r in changes.used_apis(uses).collect()] == [("w", "path", 1), ("z", "path", 0), ("y", "name_only", 1), ("x", "name_only", 0)]


def test_inherited(spark):
    bases = spark.createDataFrame([("C", "B", 0), ("C", "X", 1), ("B", "A", 0), ("D", "C", 0), ("E", "ext.Q", 0)], "class string, base string, place int")
    members = spark.createDataFrame([("A", "run"), ("X", "run"), ("X", "go"), ("D", "go"), ("B", "run")], "class string, name string")
    classes = spark.createDataFrame([(c,) for c in "ABCDEX"], "class string")
    got = changes.inherited_members(classes, bases, members)
    assert rows(got) == [("C", "go", "X"), ("C", "run", "B"), ("D", "run", "B")]
    lost = spark.createDataFrame([("m.Long", "run", "m.B"), ("m.C", "run", "m.B"), ("m.B", "run", "m.B"), ("m.Y", "go", "m.Z"), ("m.LongY", "go", "m.Z")], "class string, name string, origin string")
    assert rows(changes.fold_inherited(lost)) == [("m.B", "run", "m.B", 3, ["m.C", "m.Long"]), ("m.Z", "go", "m.Y", 2, ["m.LongY"])]
    assert rows(changes.unresolved_ancestor(bases, classes)) == [("B", False), ("C", False), ("D", False), ("E", True)]


def test_requirements_breadth_first(spark):
    requires = spark.createDataFrame([("r", "b", 0), ("r", "a", 1), ("b", "c", 0), ("a", "d", 0), ("a", "c", 1), ("b", "r", 1), ("c", "e", 0)], "package string, name string, ordinal int")
    roots = spark.createDataFrame([("r",)], "root string")
    got = changes.requirements_within(roots, requires).orderBy("place").collect()
    assert [(r["name"], r["level"], r["place"]) for r in got] == [("b", 1, 1), ("a", 1, 2), ("c", 2, 3), ("d", 2, 4)]
    assert changes.requirements_within(roots, requires, most=3).count() == 3


def test_switches_and_keywords(spark):
    schema = "path string, parameter string, context string, root string, name string"
    old = spark.createDataFrame([("f", "c", "ann", "requests", "Session"), ("g", None, "raises", "requests", "HTTPError"), ("h", "x", "ann", "other", "Y")], schema)
    new = spark.createDataFrame([("f", "c", "ann", "httpx", "Client"), ("g", None, "raises", "httpx", "HTTPError")], schema)
    root = lambda n: spark.createDataFrame([(n,)], "root string")
    assert rows(changes.switched_dependencies(old, new, root("requests"), root("httpx"))) == [("requests", "httpx", 2, 1)]
    assert changes.switched_dependencies(old, new.union(old.limit(1)), root("requests"), root("httpx")).count() == 0
    sets = spark.createDataFrame([(["b", "a", "c"], ["c"]), (["a"], None)], "p array<string>, a array<string>")
    assert [r[0] for r in sets.select(changes.unknown_keywords(F.col("p"), F.col("a"))).collect()] == [["a", "b"], []]
    made = spark.createDataFrame([("x.py", "C", "http", 0), ("x.py", "C", None, 1), ("y.py", "C", "other", 0)], "file string, callee string, keyword string, position int")
    wanted = spark.createDataFrame([("C", "http", 3), ("C", "pos", 1)], "callee string, parameter string, position int")
    assert rows(changes.passed_on(made, wanted)) == [("x.py", "C", ["http", "pos"])]


def test_suffix_and_notes(spark):
    ch = spark.createDataFrame([("lib.a.Client.send", "Client", "send"), ("lib.beta.Client.go", "Client", "go")], "path string, owner string, name string")
    used = spark.createDataFrame([("lib.Client",), ("lib.beta1.Client",), ("other.Client",)], "used string")
    assert rows(changes.by_suffix(ch, used).select("name", "used")) == [("go", "lib.beta1.Client"), ("send", "lib.Client")]
    fresh = spark.createDataFrame([("p", "a", "2", "diff"), ("p", "b", "2", "diff")], "package string, api string, version string, text string")
    stored = spark.createDataFrame([("p", "a", "2", "kept"), ("p", "b", "1", "old"), ("p", "z", "2", "gone")], "package string, api string, version string, text string")
    assert rows(changes.keep_checked(fresh, stored).select("api", "text")) == [("a", "kept"), ("b", "diff")]


def test_as_of_asks_once_and_keeps_rows(spark):
    left = spark.createDataFrame([("a", 5), ("a", 5), ("a", 0), (None, 5), ("b", None)], "k string, when int")
    right = spark.createDataFrame([("a", 1, "x"), ("a", 4, "y"), ("a", 6, "z"), ("b", 1, "w")], "k string, at int, v string")
    got = matching.as_of(left, right, ["k"], "at", "when", [F.desc("at")]).select("k", "when", "v")
    assert rows(got) == rows(spark.createDataFrame([("a", 5, "y"), ("a", 5, "y"), ("a", 0, None), (None, 5, None), ("b", None, None)], "k string, when int, v string"))


def test_markers(spark):
    cases = [
        ("python_version >= '3.10'", True), ("python_version < '3.9'", False), ("sys_platform == 'win32'", True), ("sys_platform == 'cygwin'", False),
        ("python_version < '3.9' or (os_name == 'nt' and platform_system == 'Windows')", True), ("os_name == 'nt' and sys_platform == 'linux'", False),
        ("extra == 'dev'", False), ("'linux' in sys_platform", True), ("python_version not in '3.8 3.9'", True), ("python_full_version ~= '3.12.0'", True),
        ("python_version == '3.*'", True), ("not a marker", False), ("", True), (None, True), ("(python_version > '3'", False),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m string")
    assert [r[0] for r in df.orderBy("i").select(marker_applies(F.col("m"), "3.12")).collect()] == [want for _, want in cases]


def test_environment_sources(spark, tmp_path):
    info = tmp_path / "site" / "a.dist-info"
    info.mkdir(parents=True)
    (info / "METADATA").write_bytes(b"Metadata-Version: 2.1\r\nName: My_Pkg\r\nVersion: 1.2\r\nRequires-Dist: x>=1\r\nRequires-Dist: y\r\n\r\nName: not this\r\n")
    assert rows(env.read_installed(spark, str(tmp_path / "site")).drop("file")) == [("my-pkg", "1.2", ["x>=1", "y"])]
    conda = tmp_path / "conda"
    conda.mkdir()
    (conda / "environment.yml").write_text("name: e\ndependencies:\n  - python=3.12\n  - pip:\n    - rich==13.0 # why\n    - 'httpx>=0.2'\n  - numpy\n")
    assert [r["requirement"] for r in env.read_conda_pip(spark, str(conda)).orderBy("line").collect()] == ["rich==13.0", "httpx>=0.2"]
    locks = tmp_path / "locks"
    locks.mkdir()
    (locks / "a.txt").write_text("# autogenerated\namqp==5.1 \\\n    --hash=sha256:aa\n    # via kombu\nclick==7.1  # via flask, -r requirements.in\nkombu==5\n    # via\n    #   celery\n    #   -r base.in\n    #\n    # note\n")
    (locks / "b.txt").write_text("plain==1\n")
    got = {r["name"]: (sorted(r["via"]), r["direct"]) for r in env.read_compiled(spark, str(locks)).collect()}
    assert got == {"amqp": (["kombu"], False), "click": (["-r requirements.in", "flask"], True), "kombu": (["-r base.in", "celery"], True), "plain": ([], None)}
    inc = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("c", None)], "file string, target string")
    assert rows(env.included_files(inc)) == [("a", "a"), ("a", "b"), ("a", "c"), ("b", "a"), ("b", "b"), ("b", "c"), ("c", "c")]
    paths = ["pkg/__init__.py", "pkg/sub/x.py", "ns/one/__init__.py", "ns/two.py", "fast.cpython-312-x86_64-linux-gnu.so", "typed-stubs/__init__.pyi", "a.dist-info/METADATA", "tests/test_x.py"]
    got = env.import_names(spark.createDataFrame([("w", p) for p in paths], "archive string, path string")).drop("archive")
    assert rows(got) == [("fast", True, False), ("ns.one", False, False), ("ns.two", False, False), ("pkg", False, False), ("typed", False, True)]
    src = spark.createDataFrame([("p", "1", "p/__init__.py", '"""Doc."""\n__version__ = "1"\n'), ("q", "1", "q.py", "import os\n"), ("r", "1", "r.py", None)], "package string, version string, path string, text string")
    assert rows(env.placeholders(env.top_statements(src))) == [("p", "1", True), ("q", "1", False), ("r", "1", True)]


def test_calls(spark):
    def call(x):
        if x == 2:
            raise ValueError("two")
        return str(x * 10)

    got = calls.call_each(spark.createDataFrame([(1,), (2,), (1,)], "x int"), ["x"], call)
    assert rows(got) == [(1, "10", None), (2, None, "ValueError: two")]
    requests = spark.createDataFrame([("s", "u"), ("s", "v")], "system string, user string")
    first = calls.complete(requests.limit(1), spark.createDataFrame([], "key string, answer string"), lambda s, u: f"{s}-{u}")
    both = calls.complete(requests, first.select("key", "answer"), lambda s, u: f"new {u}")
    assert sorted(r["answer"] for r in both.collect()) == ["new v", "s-u"]
    snippets = spark.createDataFrame([("p", "1", "a", "x"), ("p", "1", "b", "yy"), (None, "1", "c", "z")], "package string, version string, snippet string, code string")
    found = calls.check_snippets(snippets, lambda p, v, items: [(s, len(c), 0, "rule", c) for s, c in items])
    assert rows(found.select("snippet", "line")) == [("a", 1), ("b", 2)]
    diag = spark.createDataFrame([("a", 1, 0, "call"), ("a", 1, 0, "missing"), ("a", 2, 0, "call")], "snippet string, line int, column int, rule string")
    assert rows(calls.first_at_place(diag, ["call"], ["missing"]).select("line")) == [(2,)]


def test_splice_and_imports(spark):
    texts = ["", "head", "head\n", "a\n<!-- notes:start -->\nold\n<!-- notes:end -->\ntail"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    once = df.select("t", T.splice(F.col("t"), F.lit("new")).alias("one")).withColumn("two", T.splice(F.col("one"), F.lit("new")))
    for r in once.collect():
        assert r["one"] == r["two"] and r["one"].count("new") == 1 and "old" not in r["one"]
        assert r["one"].startswith("a\n<!--") and r["one"].endswith("-->\ntail") if "tail" in r["t"] else r["one"].startswith(r["t"])
    code = spark.createDataFrame([("import os, sys as s\nfrom a.b import (c\n  import x.y  # z\nfrom . import q\n",), (None,)], "c string")
    assert [r[0] for r in code.select(T.imported_modules(F.col("c"))).collect()] == [["a.b", "os", "sys", "x.y"], []]
    labelled = spark.createDataFrame([("rate limit hit",), ("timeout, rate limit",), ("fine",)], "t string").select(T.first_label(F.col("t"), [("timeout", "slow"), ("rate", "limited")]))
    assert [r[0] for r in labelled.collect()] == ["limited", "slow", None]


def test_bootstraps(spark):
    rng = random.Random(1)
    a, b = [rng.gauss(1, 1) for _ in range(60)], [rng.gauss(0, 1) for _ in range(50)]
    df = spark.createDataFrame([(i, v, i < 60) for i, v in enumerate(a + b)], "i int, v double, on boolean")
    gap, low, high = st.strata_difference(df, [], F.col("on"), F.col("v"), "i", 500).select("gap", "low", "high").first()
    assert low < gap < high and abs(gap - (sum(a) / 60 - sum(b) / 50)) < 1e-9 and high - low < 1.5
    drawn = st.resampled(df, [], "i", {"s": F.col("v"), "n": F.lit(1), "q": F.col("v") * F.col("v")}, 500)
    both = st.intervals(drawn, [], {"mean": F.col("s") / F.col("n"), "square": F.col("q") / F.col("n")}).first()
    assert both["mean_low"] < sum(a + b) / 110 < both["mean_high"] and both["square_low"] < both["square_high"]
    pairs = spark.createDataFrame([("x", 1, 2.0), ("x", 2, 4.0), ("x", 3, 6.0), ("y", 1, 1.0), ("y", 1, 2.0)], "k string, a int, b double")
    assert {r["k"]: r["r"] and round(r["r"], 9) for r in st.pearson(pairs, ["k"], "a", "b").collect()} == {"x": 1.0, "y": None}
    lone = spark.createDataFrame([("one", "c", 1), ("two", "c", 1), ("two", "d", -1)], "k string, c string, net int")
    got = {r["k"]: (r["clusters"], r["pairs"], r["low"], r["high"]) for r in st.cluster_bootstrap(lone, ["k"], "c", F.col("net"), 200).collect()}
    assert got == {"one": (1, 1, None, None), "two": (2, 2, -1.0, 1.0)}
    rank = spark.createDataFrame([(i, i, i * i) for i in range(12)], "i int, a int, b int")
    rho, p = st.spearman(rank, "i", "a", "b", 200).first()
    assert abs(rho - 1) < 1e-9 and p < 0.02


def test_served_and_replacements(spark):
    code = (
        "import warnings\n_OLD = {'gone': 'new.gone', 'two': 1}\n"
        "def __getattr__(name):\n    if name in _OLD:\n        warnings.warn('x')\n        return 1\n    if name == 'three' or name in ('four', 'five'):\n        return 2\n    raise AttributeError(name)\n"
    )
    quiet = "T: dict = {'q': 1}\ndef __getattr__(n):\n    return T[n]\n"
    src = spark.createDataFrame([("p", "2", "p/__init__.py", code), ("p", "2", "p/m.py", quiet), ("p", "2", "p/bad.py", "def ("), ("p", "2", "p/e.py", None)], "package string, version string, path string, text string")
    served = python_api.served_names(src)
    assert rows(served.select("module", "name", "warns")) == [("p", n, True) for n in ("five", "four", "gone", "three", "two")] + [("p.m", "q", False)]
    ch = spark.createDataFrame([("p", "removed", "p.gone"), ("p", "removed", "p.m.q"), ("p", "removed", "p.really"), ("p", "param_removed", "p.two")], "package string, kind string, path string")
    assert rows(changes.reclassify_served(ch, served).select("path", "kind")) == [("p.gone", "deprecated"), ("p.really", "removed"), ("p.two", "param_removed")]
    text = "Use `Client.shutdown()` instead of `close`, or `nothing`."
    dep = spark.createDataFrame([("p", "p.Client.close", "deprecated", None, text), ("p", "p.x", "deprecated", None, None)], "package string, path string, kind string, parameter string, deprecation string")
    objects = spark.createDataFrame([("p", "p.Client.shutdown", "shutdown", True), ("p", "p.deep.Client.shutdown", "shutdown", True), ("p", "p.Client.close", "close", True), ("p", "p.Other.shutdown", "shutdown", True), ("q", "q.Client.shutdown", "shutdown", True)], "package string, path string, name string, is_public boolean")
    assert [r["replacements"] for r in changes.replacements(dep, objects).collect()] == [["p.Client.shutdown"]]
