from datetime import date, datetime

from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import experiments
from tidemark.sources import registry


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text_functions(spark):
    lit = F.lit
    assert one(spark, T.plain(lit("See :func:`~a.b <c>` and *this* [x](http://y)."))) == ("See a.b and this x.",)
    assert one(spark, T.sentences(lit("Use a.b now. It is 1.2 better! Yes?")))[0] == ["Use a.b now.", "It is 1.2 better!", "Yes?"]
    assert one(spark, T.quote(lit("One two three. Four five. Six."), 16)) == ("Four five. Six.",)
    assert one(spark, T.named_replacement(lit("Deprecated; use `Client.send` instead.")), T.named_replacement(lit("nothing"))) == ("Client.send", None)
    assert one(spark, T.is_grounded(lit("call `a.b()`"), F.array(lit("a.b"))), T.is_grounded(lit("call `c`"), F.array(lit("a.b")))) == (True, False)
    assert one(spark, T.leaks(lit("please Send it"), F.array(lit("send"))), T.leaks(lit("resend"), F.array(lit("send")))) == (True, False)
    answer = "a\n```python\nx = 1\n```\nb\n```\nlonger = 2\n```"
    assert one(spark, T.longest_code(lit(answer)), T.longest_code(lit("x = 3"))) == ("longer = 2\n", "x = 3")
    assert one(spark, T.without_control_comments(lit("a = 1  # type: ignore[x]\nb = 2 # ok"))) == ("a = 1\nb = 2 # ok",)
    assert one(spark, T.decode_tags(T.encode_tags(F.array(lit("a"), lit("b"), lit("a"))))) == (["a", "b"],)
    assert one(spark, T.link_by_label(F.create_map(lit("Home"), lit("h"), lit("Release Notes"), lit("r")))) == ("r",)
    df = spark.createDataFrame([('x {bad} {"a": {"b": 1}} y', "sendd", ["send", "sent", "other"])], "t string, n string, c array<string>")
    assert tuple(df.select(T.first_json_object(F.col("t")), T.close_names(F.col("n"), F.col("c"))).first()) == ('{"a": {"b": 1}}', ["send"])


def test_pairs_and_majority(spark):
    rows = [
        ("c1", "t1", False, "", "wrong"), ("c1", "t1", True, "v", "pass"), ("c1", "t2", False, "", "stale"), ("c1", "t2", True, "v", "invalid"),
        ("c2", "t1", False, "", "off-task"), ("c2", "t1", True, "v", "pass"), ("c3", "t1", False, "", "pass"), ("c3", "t1", True, "v", "error"),
        ("c4", "t1", False, "", "stale"), ("c4", "t1", True, "v", "pass"), ("c4", "t1", True, "u", "error"),
    ]
    df = spark.createDataFrame(rows, "change_id string, task string, with_notes boolean, arm string, outcome string")
    got = {r["change_id"]: (r["n"], r["fixed"], r["mostly_fixed"]) for r in experiments.by_change(experiments.pairs(df, "v")).collect()}
    assert got == {"c1": (2, 1, False), "c4": (1, 1, True)}
    assert experiments.pairs(df, "v", common=True).count() == 0
    n = F.lit(0)
    labels = [experiments.outcome(F.lit(i), F.lit(o), F.lit(e), F.lit(k), n, F.lit(t)) for i, o, e, k, t in ((True, True, 1, 1, True), (False, False, 2, 1, True), (False, False, 1, 0, True), (False, False, 0, 0, False), (False, False, 0, 0, True))]
    assert one(spark, *labels) == ("invalid", "stale", "wrong", "untouched", "pass")


def test_registry_lookup_and_results(spark, tmp_path):
    doc = '{"acme": {"name": "Acme", "models": {"big-1": {"id": "big-1", "family": "big", "knowledge": "2024-02"}}}, "host": {"name": "H", "models": {"acme/big-1": {"knowledge": "2023"}, "big-1": {"knowledge": "2023-01"}}}}'
    models = registry.models(spark.createDataFrame([(doc,)], "value string"))
    assert {(r["provider"], r["id"]): r["knowledge"] for r in models.collect()}[("acme", "big-1")] == date(2024, 2, 29)
    asked = spark.createDataFrame([("big-1-20240101", None), ("big-1", "host"), ("none", None)], "model string, provider string")
    got = {(r["model"]): r["provider"] for r in registry.lookup(asked, models, ["acme"]).collect()}
    assert got == {"big-1-20240101": "acme", "big-1": "host"}
    rows = [("ns", "k", "old", datetime(2024, 1, 1)), ("ns", "k", "new", datetime(2024, 1, 2)), ("ns", "m", "x", datetime(2023, 1, 1))]
    registry.put_results(spark.createDataFrame(rows, "namespace string, key string, value string, at timestamp"), str(tmp_path / "r"))
    assert [(r["key"], r["value"]) for r in registry.get_results(spark, str(tmp_path / "r"), 48, datetime(2024, 1, 3)).collect()] == [("k", "new")]
    (tmp_path / "N.md").write_text("x\n<!-- notes:start -->\n### a 1 -> 2\n- one\n- two\n### b 3 -> 4\n- three\n<!-- notes:end -->\n- no\n")
    got = [(r["package"], r["new_version"], r["ordinal"], r["bullet"]) for r in registry.note_blocks(spark, str(tmp_path / "N.md")).collect()]
    assert got == [("a", "2", 0, "one"), ("a", "2", 1, "two"), ("b", "4", 0, "three")]
