import zipfile
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tidemark.functions.versions import is_final, version_key
from tidemark.operators import changes as ops
from tidemark.operators import notes
from tidemark.plans import release_diff
from tidemark.sources import files, python_api, snippets, usage_facts

OLD = {
    "depot/__init__.py": "from .stock import Shelf, count_items\nfrom .routes import *\nfrom . import util\n",
    "depot/stock.py": '''
import logging
from collections import UserDict
from typing import overload
import pytest
log = logging.getLogger(__name__)
LIMIT = 10
if LIMIT:
    scratch = 1
if __name__ == "__main__":
    demo = 2
class Base:
    """A base."""
    def lift(self, load): ...
    def drop(self): ...
class Shelf(Base):
    """Holds crates."""
    def put(self, crate, depth=1, /, side="left", *, force=False): ...
    def take(self, crate, count): ...
    def stack(self, first, second): ...
    def tidy(self, **options): ...
    def label(self, text, colour="red"): ...
    def paint(self, colour, coats=1): ...
    def weigh(self, item): ...
class Ledger(UserDict):
    def keys(self): ...
    def total(self): ...
    def __init__(self):
        self.owner = "x"
        self.page = 1
def count_items(shelf, deep=False): ...
def audit(shelf, year, strict): ...
def crane(): ...
def pack_up(shelf: "Shelf"): ...
@pytest.fixture
def sample(request, size): ...
@overload
def find(key: int) -> int: ...
@overload
def find(key: str, fuzzy: bool) -> str: ...
def find(key, fuzzy=None): ...
class Gauge: ...
def ratio(): ...
def old_name(): ...
''',
    "depot/routes.py": "import os\nclass Truck:\n    def load(self): ...\n    def unload(self): ...\ndef dispatch(): ...\n",
    "depot/util.py": "def helper(): ...\n",
    "depot/cli/tools.py": "def run(): ...\n",
    "depot/trade.py": "import oldhttp\ndef send(client: oldhttp.Client) -> oldhttp.Reply: ...\nclass Call(oldhttp.Request): ...\n",
}
NEW = {
    "depot/__init__.py": "from .stock import Shelf, count_items\nfrom .fleet import Truck\n",
    "depot/stock.py": '''
from collections import UserDict
from typing import overload
import pytest
class Base:
    """A base."""
    def lift(self, load, /): ...
class Shelf(Base):
    """Holds crates."""
    def put(self, box, depth=1, /, side="left", **rest): ...
    def take(self, crate, count, place): ...
    def stack(self, one, second): ...
    def tidy(self, order=1, deep=False): ...
    def label(self, text, *, colour="red"): ...
    @property
    def paint(self): ...
    def pack_up(self): ...
    @deprecated("Use Scale.weigh instead.")
    def weigh(self, item): ...
class Ledger(UserDict):
    def __init__(self):
        super().__init__()
        self.page, self.owner = 1, 2
def count_items(shelf): ...
def audit(shelf, year, strict=True, *, region): ...
class crane: ...
@pytest.fixture
def sample(request): ...
@overload
def find(key: int) -> int: ...
@overload
def find(key: str, fuzzy: bool) -> str: ...
def find(key): ...
Gauge = 3
def ratio(): ...
ratio.__doc__ = "x"
''',
    "depot/fleet.py": "class Truck:\n    def load(self): ...\n    def unload(self): ...\n",
    "depot/cli/__init__.py": "",
    "depot/trade.py": "import newhttp\ndef send(client: newhttp.Client) -> newhttp.Reply: ...\nclass Call(newhttp.Request): ...\n",
    "depot/broken.py": "def (",
}
SOURCE = "package string, version string, path string, text string"


def sources(spark, texts, version, package="depot"):
    return spark.createDataFrame([(package, version, p, t) for p, t in texts.items()], SOURCE)


@pytest.fixture(scope="module")
def objects(spark):
    return [python_api.api_objects(sources(spark, t, v)).persist() for t, v in ((OLD, "1"), (NEW, "2"))]


@pytest.fixture(scope="module")
def found(objects):
    return release_diff.diff(*objects).persist()


def test_nine_kinds_of_a_small_library(spark, objects, found):
    assert objects[1].where("error is not null").count() == 1
    got = {(r["kind"], r["path"], r["parameter"]) for r in found.collect()}
    stock = "depot.stock."
    want = {
        ("param_removed", stock + "Shelf.stack", "first"),  # the place is kept, the name is gone for callers by keyword
        ("param_required", stock + "Shelf.take", "place"),
        ("param_keyword_only", stock + "Shelf.label", "colour"),
        ("param_positional_only", stock + "Base.lift", "load"),
        ("param_removed", stock + "count_items", "deep"), ("param_required", stock + "audit", "region"),
        ("kind_changed", stock + "Shelf.paint", None), ("kind_changed", stock + "Gauge", None),
        ("deprecated", stock + "Shelf.weigh", None),
        ("removed", stock + "Base.drop", None), ("removed", stock + "Shelf.drop", None), ("removed", stock + "LIMIT", None), ("removed", stock + "Ledger.total", None),
        ("removed", stock + "old_name", None), ("moved", "depot.routes.Truck", None), ("removed", "depot.routes.dispatch", None),
        ("removed", "depot.util", None), ("removed", "depot.routes", None), ("removed", "depot.cli.tools", None),
    }
    modules = {g for g in want if g[1] in ("depot.routes.Truck", "depot.routes.dispatch")}
    want -= {g for g in modules if g not in got}  # what a removed module held goes with it
    assert got == want


def test_what_is_no_removal(spark, objects):
    old, new = (python_api.expand_stars(o) for o in objects)
    gone = old.join(new.select("path"), "path", "left_anti")
    why = {r["path"]: r["suppressed_by"] for r in release_diff.suppressed(gone, old, new, release_diff.lineage(new, python_api.public_paths(new))).collect()}
    stock = "depot.stock."
    assert {p: why.get(stock + p) for p in ("log", "scratch", "demo", "Ledger.keys", "pack_up", "LIMIT", "old_name")} == {
        "log": "per_module", "scratch": "sometimes", "demo": "never_api", "Ledger.keys": "outside_base", "pack_up": "method", "LIMIT": None, "old_name": None,
    }


def test_inherited_members_fold_into_one(found):
    ranked = {(r["kind"], r["path"]): r for r in release_diff.ranked_changes(found).collect()}
    assert ranked["removed", "depot.stock.Base.drop"]["occurrences"] == 2 and ("removed", "depot.stock.Shelf.drop") not in ranked


def test_suggestions_and_signatures(found):
    row = {(r["path"], r["parameter"]): r for r in found.collect()}["depot.stock.Shelf.stack", "first"]
    assert row["suggestions"] == ["one"] and row["old_signature"] == "stack(self, first, second)" and row["owner"] == "Shelf" and not row["documented"]


def test_priorities_are_the_fixed_values():
    p = release_diff.PRIORITY
    assert [p[k] for k in ("dependency_switched", "removed", "moved", "param_removed", "param_required", "kind_changed", "deprecated", "param_keyword_only", "param_positional_only")] == [0, 0, 0, 1, 2, 3, 4, 5, 5]


def test_scores(spark):
    rows = [("p", "p.a.run", "run", None, "removed", None), ("p", "p.cli.stop", "stop", None, "moved", None), ("p", "p.compat.deep.go", "go", None, "deprecated", None), ("p", "p.E.RED", "RED", "E", "removed", None)]
    base = spark.createDataFrame(rows, "package string, path string, name string, owner string, kind string, parameter string")
    extra = {"moved_to": "string", "deprecation": "string", "origin": "string", "old_signature": "string", "documented": "boolean"}
    base = base.withColumns({c: F.lit(None).cast(t) for c, t in extra.items()})
    got = {r["path"]: r["score"] for r in release_diff.ranked_changes(base).collect()}
    assert got == {"p.a.run": 10 + 1.5, "p.cli.stop": 10 + 1.5 - 2, "p.compat.deep.go": 10 - 6 + 0.75 - 3, "p.E.RED": 10 + 1.5 - 4}
    used = spark.createDataFrame([("p", "p.E.RED", None, "app.py", 3, "member", True)], "package string, path string, parameter string, file string, pos int, how string, class_used boolean")
    got = {r["path"]: r["score"] for r in release_diff.ranked_changes(base, used).collect()}
    assert got["p.E.RED"] == 10 + 1.5 - 4 + 6 + 2 and got["p.a.run"] == 11.5


def test_a_long_chain_of_aliases_keeps_its_public_path(spark):
    texts = {"p/__init__.py": "from .m0 import Thing\n"} | {f"p/m{i}.py": f"from .m{i + 1} import Thing as Thing\n" for i in range(20)} | {"p/m20.py": "class Thing: ...\n", "p/x.py": "from .y import loop as loop\n", "p/y.py": "from .x import loop as loop\n"}
    paths = {(r["canonical"], r["public"]) for r in python_api.public_paths(python_api.api_objects(sources(spark, texts, "1", "p"))).collect()}
    assert ("p.m20.Thing", "p.Thing") in paths


def test_dependency_switch(spark, objects):
    requires = lambda *names: spark.createDataFrame([("depot", n, None) for n in names], "package string, name string, extra string")
    sites = [ops.reference_roots(o) for o in objects]
    rows = ops.switches(*sites, requires("oldhttp", "both"), requires("newhttp", "both"))
    assert [(r["gone"], r["fresh"], r["sites"]) for r in rows.collect()] == [("oldhttp", "newhttp", 3)]
    assert release_diff.diff(*objects, rows).where("kind = 'dependency_switched'").select("path", "name", "moved_to").collect() == [("depot", "oldhttp", "newhttp")]
    assert ops.switches(*sites, requires("oldhttp"), requires("oldhttp", "newhttp")).count() == 0
    had = spark.createDataFrame([("p", "a", None), ("p", "b", "fast"), ("p", "c", "fast"), ("p", "d", "gone"), ("p", "e", "fast")], "package string, name string, extra string")
    has = spark.createDataFrame([("p", "b", "fast"), ("p", "e", None), ("p", "x", "fast")], "package string, name string, extra string")
    assert sorted(tuple(r) for r in ops.dropped_requirements(had, has).collect()) == [("p", "a", None), ("p", "c", "fast")]


CODE = '''
import depot
from depot import Shelf
from depot.stock import old_name as gone, Ledger
old = gone()
shelf = Shelf()
shelf.label("x", colour="red")
def work(s: Shelf, other):
    s.weigh(1)
    other.total()
    return s
class Mine(Ledger):
    def total(self): ...
    def show(self):
        self.owner
work(shelf, None).put(1, force=True)
try:
    depot.count_items(shelf, deep=True)
except depot.Problem:
    pass
'''


@pytest.fixture(scope="module")
def facts(spark):
    return usage_facts.file_facts(spark.createDataFrame([("app.py", CODE), ("bad.py", "def ("), ("none.py", None)], "path string, text string")).persist()


def test_facts_of_a_file(facts):
    got = {(r["fact"], r["a"], r["b"]) for r in facts.where("file = 'app.py'").collect()}
    assert facts.where("file <> 'app.py'").count() == 0
    assert {
        ("path", "depot.stock.old_name", None), ("path", "depot.stock", None), ("path", "depot.count_items", None), ("call", "old_name", None), ("call", "label", None),
        ("keyword", "count_items", "deep"), ("keyword_path", "depot.count_items", "deep"), ("keyword_path", "depot.Shelf.label", "colour"), ("keyword_chain", "shelf.label", "colour"),
        ("member", "depot.Shelf", "label"), ("member", "depot.Shelf", "weigh"), ("member", "depot.stock.Ledger", "owner"), ("shadowed", "depot.stock.Ledger", "total"),
        ("handled", "depot.Problem", "depot"), ("bound", "gone", "depot.stock.old_name"), ("assigned", "shelf", "Shelf()"), ("annotated", "s", "Shelf"), ("defined", "Mine", None),
        ("type_ref", "depot.stock.Ledger", None), ("positional_module", "depot.count_items", "0"), ("access", "work().put()", None),
    } <= got
    assert ("member", "depot.stock.Ledger", "total") not in got


def test_uses_by_path_keyword_and_type(spark, objects, found, facts):
    edges = usage_facts.receiver_edges(objects[0])
    typed = usage_facts.typed(facts, edges).persist()
    members = {(r["fact"], r["a"], r["b"]) for r in typed.collect()}
    assert ("member", "depot.stock.Shelf", "weigh") in members and ("loose", "total", None) in members
    how = {(r["path"].rpartition("stock.")[2], r["parameter"]): r["how"] for r in release_diff.uses(found, facts, objects[0], typed).collect()}
    assert how == {
        ("old_name", None): "path", ("count_items", "deep"): "keyword", ("Shelf.label", "colour"): "keyword", ("Shelf.weigh", None): "member",
        ("Ledger.total", None): "name_only",
    }
    used = release_diff.uses(found, facts, objects[0], typed)
    usage = {(r["path"], r["parameter"]): (r["usage"], r["class_used"]) for r in release_diff.usage(found, used).collect()}
    assert usage["depot.stock.Shelf.label", "colour"] == (2, True) and usage["depot.stock.old_name", None] == (2, False) and usage["depot.stock.LIMIT", None] == (0, False)


def test_typing_follows_calls_attributes_and_bases(spark):
    lib = {
        "g/__init__.py": "from .frame import Frame, read\n",
        "g/frame.py": "class Root:\n    def clean(self) -> 'Self': ...\nclass Frame(Root):\n    index: 'Index'\n    def group(self, by) -> 'Groups': ...\nclass Groups:\n    def count(self) -> Frame: ...\nclass Index:\n    def names(self): ...\ndef read(path) -> Frame | None: ...\n",
    }
    code = "import g\nf = g.read('x')\nclean = f.clean()\nn = clean.group('a').count().index.names()\nclean.group(by=1)\nmaybe.names()\n"
    facts = usage_facts.file_facts(spark.createDataFrame([("a.py", code)], "path string, text string"))
    got = {(r["fact"], r["a"], r["b"]) for r in usage_facts.typed(facts, usage_facts.receiver_edges(python_api.api_objects(sources(spark, lib, "1", "g")))).collect()}
    p = "g.frame."
    assert {("member", p + "Root", "clean"), ("member", p + "Frame", "group"), ("member", p + "Groups", "count"), ("member", p + "Frame", "index"), ("member", p + "Index", "names"), ("keyword_path", p + "Frame.group", "by"), ("loose", "names", None)} == got


def test_source_files(spark):
    paths = ["b.py", "a/z.py", "a/b/c.py", ".git/x.py", "venv/y.py", "a/big.py", "a/data.txt", "A.py"]
    df = spark.createDataFrame([(p, 2 << 20 if "big" in p else 10) for p in paths], "path string, length long")
    assert [r["path"] for r in usage_facts.source_files(df, ("venv",)).collect()] == ["A.py", "b.py", "a/z.py", "a/b/c.py"]
    assert usage_facts.source_files(df, ("venv",), most=2).count() == 2


def test_parameters_still_read(spark):
    code = "def outer(**kw):\n    return inner(kw)\ndef inner(kw):\n    x = 1\n    return kw.pop('speed')\ndef wrap(f):\n    if 'mode' in f.kw: ...\n@wrap\ndef other(a, **kw): ...\n"
    reads = python_api.parameter_reads(sources(spark, {"q/__init__.py": code}, "2", "q"))
    lost = spark.createDataFrame([("q", "q.outer", "speed", "param_removed"), ("q", "q.other", "mode", "param_removed"), ("q", "q.other", "colour", "param_removed")], "package string, path string, parameter string, kind string")
    assert sorted(tuple(r)[1:] for r in ops.still_read(lost, reads).collect()) == [("q.other", "mode", "q.wrap", 7), ("q.outer", "speed", "q.inner", 5)]


def test_diagnostics_about_a_package(spark):
    code = "import lib\nimport os\nclient = lib.Client()\nfor item in client.items():\n    item.name\nos.path.foo\nwith client.open() as handle:\n    y = handle\ny.read(size=1)\n"
    snippets_ = spark.createDataFrame([("a", code, ["lib"]), ("b", "x = (", ["lib"]), ("c", None, None)], "snippet string, code string, imports array<string>")
    places = [("a", 5, 4), ("a", 6, 0), ("a", 9, 0), ("a", 9, 7), ("a", 1, 7), ("b", 1, 0)]
    found = spark.createDataFrame([(*p, "r") for p in places], "snippet string, line int, column int, rule string")
    got = {(r["snippet"], r["line"], r["column"]): (r["about"], r["name"]) for r in snippets.attribute_diagnostics(snippets_, found).collect()}
    assert got == {("a", 5, 4): (True, "item"), ("a", 6, 0): (False, "os"), ("a", 9, 0): (True, "y"), ("a", 9, 7): (True, "y"), ("a", 1, 7): (True, "lib"), ("b", 1, 0): (None, None)}


def test_notes_and_pages(spark, found, tmp_path):
    from tidemark.sources import registry

    scored = found.withColumn("score", F.lit(1.0))
    versions = spark.createDataFrame([("depot", "1", "2")], "package string, old_version string, new_version string")
    rows = {r["api"]: r["bullets"] for r in notes.api_notes(scored, versions).collect()}
    assert rows["depot.stock.Shelf.stack"] == ["`depot.stock.Shelf.stack` no longer takes `first`, now `one`."]
    assert rows["depot.stock.Shelf.weigh"] == ["`depot.stock.Shelf.weigh` is deprecated: Use Scale.weigh instead."]
    pages = notes.markdown(notes.api_notes(scored, versions))
    notes.write_markdown(pages, str(tmp_path / "pages"))
    (tmp_path / "N.md").write_text("<!-- notes:start -->\n" + pages.first()["text"] + "\n<!-- notes:end -->\n")
    back = registry.note_blocks(spark, str(tmp_path / "N.md")).collect()
    assert {r["bullet"] for r in back} == {b for bs in rows.values() for b in bs} and {r["new_version"] for r in back} == {"2"}
    assert notes.summary_table(found).first()["line"].startswith("| depot | removed | ")
    text = spark.range(1).select(notes.wrapped(F.lit("one two three four fivesixseven"), 9).alias("w")).first()["w"]
    assert text == ["one two", "three", "four", "fivesixseven"]
    prompts = notes.task_prompts(found.withColumn("old_doc", F.lit(None).cast("string")), "Python").where("path = 'depot.stock.Shelf.stack'").first()["prompt"]
    assert "`Shelf.stack` of `depot`" in prompts and "one" not in prompts.split("signature")[0].split()


def test_version_order(spark):
    order = ["1.0.dev1", "1.0a1.dev2", "1.0a1", "1.0b2", "1.0rc1", "1.0", "1.0.post1.dev1", "1.0.post1", "1.0.1", "1.10", "1!0.5"]
    df = spark.createDataFrame([(v,) for v in reversed(order)], "v string")
    assert [r["v"] for r in df.orderBy(version_key(F.col("v"))).collect()] == order
    same = spark.createDataFrame([("1.0", "1.0.0"), ("1.0", "v1")], "a string, b string")
    assert all(r[0] for r in same.select(version_key(F.col("a")) == version_key(F.col("b"))).collect())
    assert [r[0] for r in spark.createDataFrame([("1.0",), ("1.0rc1",), ("x",)], "v string").select(is_final(F.col("v"))).collect()] == [True, False, False]


def test_current_release(spark):
    rows = [("p", "1.0", 1, False), ("p", "1.10", 5, False), ("p", "1.9", 6, False), ("p", "2.0rc1", 7, False), ("p", "3.0", 7, True), ("q", "0.1a1", 2, False), ("q", "0.1.dev1", 3, False)]
    releases = spark.createDataFrame([(p, v, datetime(2024, 1, d), y) for p, v, d, y in rows], "package string, version string, uploaded timestamp, yanked boolean")
    cutoffs = spark.createDataFrame([("p", date(2024, 1, 9)), ("p", date(2024, 1, 4)), ("q", date(2024, 1, 9)), ("r", date(2024, 1, 9))], "package string, cutoff date")
    got = {(r["package"], r["cutoff"].day): r["version"] for r in release_diff.current_releases(releases, cutoffs).collect()}
    assert got == {("p", 9): "1.10", ("p", 4): "1.0", ("q", 9): "0.1a1", ("r", 9): None}


def test_sources(spark, tmp_path):
    (tmp_path / "docs.json").write_text('{"package":"p","releases":{"1.0":[{"upload_time_iso_8601":"2024-01-02T00:00:00Z","yanked":true},{"upload_time_iso_8601":"2024-01-01T00:00:00Z","yanked":false}],"2.0":[]}}\n')
    got = files.releases(files.read_release_docs(spark, str(tmp_path / "docs.json"))).collect()
    assert [(r["version"], r["uploaded"], r["yanked"]) for r in got] == [("1.0", datetime(2024, 1, 1), False)]
    (tmp_path / "reqs/sub").mkdir(parents=True)
    (tmp_path / "reqs/requirements.txt").write_text("# c\n-r sub/other.txt\nFoo_Bar==1.2  # pin\nbaz[x] >=1,<2 ; python_version > '3'\n")
    (tmp_path / "reqs/sub/other.txt").write_text("-r ../requirements.txt\nqux\n")
    got = [tuple(r)[2:] for r in files.read_requirements(spark, str(tmp_path / "reqs/requirements.txt")).orderBy("line").collect()]
    assert got == [("foo-bar", "==1.2", "1.2"), ("baz", ">=1,<2", None)]
    got = sorted((r["root"].rpartition("/")[2], r["name"]) for r in files.read_requirements_with_includes(spark, str(tmp_path / "reqs")).collect())
    assert got == [(f, n) for f in ("other.txt", "requirements.txt") for n in ("baz", "foo-bar", "qux")]
    locks = tmp_path / "locks"
    locks.mkdir()
    (locks / "uv.lock").write_text('[[package]]\nname = "app"\nsource = { editable = "." }\ndependencies = [{ name = "a" }]\n[[package]]\nname = "a"\nversion = "1"\n[[package]]\nname = "b"\nversion = "2"\nsource = { git = "https://x" }\n')
    (locks / "poetry.lock").write_text("not toml [")
    (locks / "pylock.toml").write_text('lock-version = "1.0"\n[[packages]]\nname = "n"\nversion = "1.5"\nmarker = "python_version < \'3.9\'"\n[[packages]]\nname = "n"\nversion = "1.2"\nmarker = "python_version >= \'3.9\'"\n[[packages]]\nname = "v"\nversion = "3"\n[packages.vcs]\ntype = "git"\n')
    (locks / "other.lock").write_text("x")
    read = files.read_locks(spark, str(locks))
    got = sorted(((r["name"], r["version"], r["direct"], r["private"], r["error"] is None) for r in read.collect()), key=repr)
    want = [("a", "1", True, None, True), ("b", "2", False, "git", True), ("n", "1.2", None, None, True), ("n", "1.5", None, None, True), ("v", "3", None, "vcs", True), (None, None, None, None, False), (None, None, None, None, False)]
    assert got == sorted(want, key=repr)
    picked = lambda python: {r["name"]: r["version"] for r in files.picked(read, python).collect()}
    assert picked("3.12")["n"] == "1.2" and picked("3.8")["n"] == "1.5" and picked("3.12")["a"] == "1"
    (tmp_path / "wheels").mkdir()
    with zipfile.ZipFile(tmp_path / "wheels/x.whl", "w") as z:
        z.writestr("x/__init__.py", "a = 1")
        z.writestr("../evil.py", "b")
        z.writestr("x/data.txt", "no")
    got = sorted((r["path"], r["text"], r["error"]) for r in files.read_archives(spark, str(tmp_path / "wheels")).collect())
    assert got == [("../evil.py", None, "path leaves the archive"), ("x/__init__.py", "a = 1", None)]


def test_annotations(spark):
    df = spark.createDataFrame([("a.py", 3, "t", "50%\nx"), ("b.py", None, "t", "m")], "file string, line int, title string, message string")
    assert [r["line"] for r in files.annotations(df).collect()] == ["::warning file=a.py,line=3,title=t::50%25%0Ax", "::warning file=b.py,title=t::m"]
