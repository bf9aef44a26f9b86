"""From changes to measured help: sample, ask with and without notes, check, label, pair, aggregate."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import calls, experiments, notes, ranking
from tidemark.operators import statistics as st


def ask(changes: DataFrame, known: DataFrame, model: Callable[[str, str], str], arms: dict[str, str | None], tasks: int = 1) -> DataFrame:
    """(change_id, task, with_notes, arm, code, error): answers of ``model`` to the task of each change.

    ``changes`` has change_id, package, owner, name, path, old_signature, old_doc and note; ``arms`` maps an arm
    to the head of its system text, None for the arm without notes.  Only requests that ``known`` (key,
    answer) lacks are put."""
    rows = changes.withColumn("_no_parameter", F.lit(None).cast("string")).withColumn("_prompt", notes.task_prompt())
    rows = rows.withColumn("task", F.explode(F.sequence(F.lit(1), F.lit(tasks)))).withColumn("user", F.concat("_prompt", F.lit(" Variant "), F.col("task").cast("string"), F.lit(".")))
    every = None
    for arm, head in arms.items():
        system = F.lit("") if head is None else F.concat(F.lit(head + "\n"), F.coalesce("note", F.lit("")))
        part = rows.select("change_id", F.col("task").cast("string").alias("task"), F.lit(head is not None).alias("with_notes"), F.lit(arm).alias("arm"), system.alias("system"), "user")
        every = part if every is None else every.unionByName(part)
    key = F.sha2(F.concat_ws("\x00", "system", "user"), 256)
    answers = calls.complete(every, known, model)
    out = every.withColumn("key", key).join(answers, "key", "left")
    return out.select("change_id", "task", "with_notes", "arm", T.without_control_comments(T.longest_code(F.col("answer"))).alias("code"), "error")


def label(answers: DataFrame, judge: Callable[[str, str], str]) -> DataFrame:
    """``answers`` with ``outcome``: what ``judge`` (change_id, code) says, once for each distinct answer; an answer
    that failed is an error, one without code invalid."""
    given = answers.where("error is null and code is not null")
    said = calls.call_each(given, ["change_id", "code"], judge).select("change_id", "code", F.coalesce("value", F.lit("error")).alias("_said"))
    rows = answers.join(said, ["change_id", "code"], "left")
    return rows.withColumn("outcome", F.when(F.col("error").isNotNull(), "error").when(F.col("code").isNull() | (F.trim("code") == ""), "invalid").otherwise(F.col("_said"))).drop("_said")


def run(changes: DataFrame, known: DataFrame, model, judge, arms: dict[str, str | None], treated: str, most: int = 200, tasks: int = 1, resamples: int = 4000) -> DataFrame:
    """UD10: one row: pairs, before, after, p of the sign test, and the interval of the net rate with changes resampled.

    ``most`` changes are asked about, by a stable hash of their id (the experiment's own limit)."""
    sampled = ranking.hash_sample(changes, "change_id", most, "experiment")
    pairs = experiments.pairs(label(ask(sampled, known, model, arms, tasks), judge), treated)
    net = F.col("after").cast("int") - F.col("before").cast("int")
    counts = pairs.agg(
        F.count("*").alias("pairs"), F.count_if("before").alias("before"), F.count_if("after").alias("after"), F.count_if(net > 0).alias("fixed"), F.count_if(net < 0).alias("broken")
    )
    interval = st.cluster_bootstrap(pairs, [], "change_id", net, resamples).select("clusters", "rate", "low", "high")
    return counts.withColumn("p", st.sign_test("fixed", "broken")).join(interval, how="left")
