"""Calls of user functions on executors: once for each distinct input, errors as values, results kept."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .incremental import missing_keys


def call_each(df: DataFrame, columns: Sequence[str], call: Callable[..., str | None]) -> DataFrame:
    """SC29, UD1, UD7: ``columns``, value and error of ``call`` for every distinct input, in parallel.

    What the function raises is the row's error; other rows go on.  A lost executor's inputs are
    called again, so a call should be safe to repeat."""
    given = df.select(*columns).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, errors = [], []
            for row in batch[list(columns)].itertuples(index=False, name=None):
                value = error = None
                try:
                    value = call(*row)
                except Exception as e:  # any failure of the user's function is data
                    error = f"{type(e).__name__}: {e}"[:300]
                values.append(value)
                errors.append(error)
            yield batch.assign(value=pd.Series(values, dtype=object, index=batch.index), error=pd.Series(errors, dtype=object, index=batch.index))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema)
    return given.mapInPandas(run, f"{fields}, value string, error string")


def complete(requests: DataFrame, known: DataFrame, model: Callable[[str, str], str]) -> DataFrame:
    """UD1: (key, answer, error) of (system, user) requests; only keys that ``known`` (key, answer) lacks are called."""
    keyed = requests.select("system", "user", F.sha2(F.concat_ws("\x00", F.coalesce("system", F.lit("")), F.coalesce("user", F.lit(""))), 256).alias("key"))
    fresh = keyed.join(missing_keys(keyed.select("key"), known.select("key"), ["key"]), "key", "left_semi")
    called = call_each(fresh, ["key", "system", "user"], lambda key, system, user: model(system, user))
    found = known.join(keyed.select("key").distinct(), "key", "left_semi").select("key", "answer", F.lit(None).cast("string").alias("error"))
    return found.unionByName(called.select("key", F.col("value").alias("answer"), "error"))


def check_snippets(snippets: DataFrame, checker: Callable[[str, str, list[tuple[str, str]]], list[tuple[str, int, int, str, str]]]) -> DataFrame:
    """UD6: diagnostics (package, version, snippet, line, column, rule, message) of snippets.

    ``snippets`` has package, version, snippet, code.  The checker gets a package, a version and
    the (snippet, code) of a batch of them, as its start costs more than a snippet does."""
    schema = "package string, version string, snippet string, line int, column int, rule string, message string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for (package, version), part in batch.groupby(["package", "version"], sort=True):
                rows = checker(package, version, list(part[["snippet", "code"]].itertuples(index=False, name=None)))
                found += [(package, version, *row) for row in rows]
            yield pd.DataFrame(found, columns=["package", "version", "snippet", "line", "column", "rule", "message"]).astype({"line": "Int32", "column": "Int32"})

    placed = snippets.select("package", "version", "snippet", "code").where("package is not null and version is not null")
    # salted by the snippet, so a release with most of the snippets isn't one task
    return placed.repartition("package", "version", F.pmod(F.xxhash64("snippet"), F.lit(16))).sortWithinPartitions("package", "version").mapInPandas(run, schema)


def first_at_place(diagnostics: DataFrame, rules: Sequence[str], unless: Sequence[str]) -> DataFrame:
    """PF10: diagnostics of ``rules``, without those with one of ``unless`` at the same place."""
    place = ["snippet", "line", "column"]
    other = diagnostics.where(F.col("rule").isin(*unless)).select(*place).distinct()
    return diagnostics.where(F.col("rule").isin(*rules)).join(other, place, "left_anti")
