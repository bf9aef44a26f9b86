"""Paired experiments: outcomes of answers, pairs and comparisons of arms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VALID = ("pass", "stale", "wrong", "deprecated")


def outcome(invalid: Column, off_task: Column, errors: Column, knowledge_errors: Column, deprecated: Column, touched: Column) -> Column:
    """Label of an answer, the first that holds: invalid, off-task, stale or wrong, deprecated, untouched, pass.

    ``errors`` counts new errors and ``knowledge_errors`` those on statements that the old release accepted."""
    wrong = F.when(knowledge_errors > 0, "stale").otherwise("wrong")
    return F.when(invalid, "invalid").when(off_task, "off-task").when(errors > 0, wrong).when(deprecated > 0, "deprecated").when(~touched, "untouched").otherwise("pass")


def new_errors(new: DataFrame, old: DataFrame, keys: tuple[str, ...] = ("snippet", "statement")) -> DataFrame:
    """Diagnostics on statements that had none under the old release."""
    return new.join(old.select(*keys).distinct(), list(keys), "left_anti")


def pairs(attempts: DataFrame, treated: str, common: bool = False) -> DataFrame:
    """(change_id, task, before, after) of answers without notes and with the arm ``treated``.

    A pair counts if the answer without notes has a valid outcome and the other is no error;
    what is off-task, untouched or invalid with notes counts as wrong.  ``common`` asks that of
    every arm with notes."""
    without = attempts.where(~F.col("with_notes")).groupBy("change_id", "task").agg(F.min("outcome").alias("first"))
    arms = attempts.where("with_notes").groupBy("change_id", "task").agg(
        F.min(F.when(F.col("arm") == treated, F.col("outcome"))).alias("second"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_distinct("arm").alias("arms")
    )
    rows = without.join(arms, ["change_id", "task"]).where(F.col("first").isin(*VALID) & F.col("second").isNotNull() & (F.col("second") != "error"))
    if common:
        every = attempts.where("with_notes").agg(F.count_distinct("arm").alias("_all"))
        rows = rows.crossJoin(F.broadcast(every)).where("errors = 0 and arms = _all")
    return rows.select("change_id", "task", (F.col("first") == "pass").alias("before"), (F.col("second") == "pass").alias("after"))


def by_change(rows: DataFrame) -> DataFrame:
    """Counts of each change, and whether most of its pairs are fixed."""
    fixed, broken = ~F.col("before") & F.col("after"), F.col("before") & ~F.col("after")
    out = rows.groupBy("change_id").agg(
        F.count("*").alias("n"), F.count_if("before").alias("before"), F.count_if("after").alias("after"), F.count_if(fixed).alias("fixed"), F.count_if(broken).alias("broken")
    )
    return out.withColumn("mostly_fixed", 2 * F.col("fixed") > F.col("n"))


def head_to_head(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of the pairs that both arms have: how many only one of them got right."""
    both = a.select("change_id", "task", F.col("after").alias("x")).join(b.select("change_id", "task", F.col("after").alias("y")), ["change_id", "task"])
    return both.agg(F.count("*").alias("n"), F.count_if(F.col("x") & ~F.col("y")).alias("only_first"), F.count_if(~F.col("x") & F.col("y")).alias("only_second"))
