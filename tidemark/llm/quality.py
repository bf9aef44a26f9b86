"""Operator 6: quality as a sparse ensemble of rules over text statistics.

Statistics of whole texts are computed in Arrow batches.  Shallow boosted trees
over a bounded labelled sample give conjunctive rules (their paths), an
l1-penalised logistic regression keeps the few that matter, and those are
compiled into one Spark column expression, so scoring needs no model file.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, table
from .trees import boost, lasso_logistic

#: Labelled rows of each class that a fit reads at most (and ``common.SAMPLE_BYTES`` of text).
PER_CLASS = 2000
N_TREES, DEPTH, PENALTY = 24, 3, 0.002

STATISTICS = (
    "log_chars", "log_words", "word_chars", "upper", "digits", "symbols", "bars", "shouts", "distinct_words", "commonest_word",
    "repeated_next", "short_words", "long_words", "distinct_lines", "line_words", "spaces", "stops", "ends_odd", "non_ascii",
)


def statistics(text: str | None) -> list[float]:
    """The values of ``STATISTICS`` for a whole text; null counts as empty."""
    text = text or ""
    raw = text.encode("utf-8", "replace")
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    words = text.split()
    k = len(words)
    lines = [line for line in text.split("\n") if line]
    seen = Counter(words)
    upper, lower, digits = int(count[65:91].sum()), int(count[97:123].sum()), int(count[48:58].sum())
    high, spaces = int(count[128:].sum()), int(count[32] + count[9] + count[10] + count[13])
    plain = int(count[44] + count[46] + count[39] + count[45])
    sizes = [len(w) for w in words]
    odd = sum(1 for w in words if not (w[-1].isalnum() or w[-1] in ".,"))
    return [
        float(np.log1p(n)),
        float(np.log1p(k)),
        sum(sizes) / k if k else 0.0,
        upper / max(1, upper + lower),
        digits / n,
        (n - upper - lower - digits - high - spaces - plain) / n,
        int(count[124]) / n,
        int(count[33] + count[63]) / n,
        len(seen) / np.sqrt(k) if k else 0.0,
        max(seen.values()) / k if k else 0.0,
        sum(map(operator.eq, words, words[1:])) / max(1, k - 1),
        sum(1 for s in sizes if s <= 2) / k if k else 0.0,
        sum(1 for s in sizes if s >= 14) / k if k else 0.0,
        len(set(lines)) / max(1, len(lines)),
        k / max(1, len(lines)),
        spaces / n,
        int(count[46]) / max(1, k),
        odd / max(1, k),
        high / n,
    ]


@dataclass(frozen=True)
class Rules:
    """Conjunctions of (statistic, above, threshold) with weights, and the intercept."""

    intercept: float
    rules: tuple[tuple[tuple[tuple[int, bool, float], ...], float], ...]

    def column(self, values: Column) -> Column:
        """The score as an expression over an array column of statistics."""

        def test(part: tuple[int, bool, float]) -> Column:
            at = F.element_at(values, part[0] + 1)
            return at > F.lit(part[2]) if part[1] else at <= F.lit(part[2])

        total = F.lit(self.intercept)
        for path, weight in self.rules:
            total = total + F.when(reduce(operator.and_, map(test, path)), F.lit(weight)).otherwise(F.lit(0.0))
        return 1.0 / (1.0 + F.exp(-total))


def _matrix(x: np.ndarray, paths: list) -> np.ndarray:
    def holds(path):
        return np.logical_and.reduce([(x[:, f] > t) if above else (x[:, f] <= t) for f, above, t in path])

    return np.stack([holds(p) for p in paths], axis=1).astype(float)


def fit(texts: list[str], y: list[int], positive_share: float | None = None) -> Rules:
    """Rules from labelled texts.  ``positive_share`` is the class's share among all
    labelled rows, for samples that hold the classes in another proportion.  Without
    both classes the score is constant."""
    target = np.array(y, dtype=float)
    if len(set(y)) < 2:
        share = float(np.clip(target.mean() if len(y) else 0.5, 0.05, 0.95))
        return Rules(float(np.log(share / (1 - share))), ())
    x = np.array([statistics(t) for t in texts])
    model = boost(x, target, N_TREES, DEPTH)
    paths = list(dict.fromkeys(p for tree in model.trees for p in tree.paths()))
    if not paths:
        return Rules(model.start, ())
    rows = _matrix(x, paths)
    some = (rows.mean(0) > 0.002) & (rows.mean(0) < 0.998)
    paths, rows = [p for p, s in zip(paths, some, strict=True) if s], rows[:, some]
    intercept, weights = lasso_logistic(rows, target, PENALTY)
    if positive_share is not None:
        own, real = target.mean(), float(np.clip(positive_share, 0.01, 0.99))
        intercept += float(np.log(real / (1 - real)) - np.log(own / (1 - own)))
    kept = tuple((p, float(w)) for p, w in zip(paths, weights, strict=True) if abs(w) > 1e-6)
    return Rules(intercept, kept)


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> Rules:
    """Rules fitted on ``labels.quality`` over the rows where ``train`` holds, a sample bounded in
    rows and bytes (``labelled_sample``); without both classes the score is constant."""
    texts, y, share = labelled_sample(docs, labels, "quality", train, per_class)
    return fit(texts, y, share)


def score_quality(df: DataFrame, rules: Rules) -> DataFrame:
    """``df`` with ``statistics``, ``score`` double and ``predicted`` int added.

    Null and empty texts have all statistics 0 and the score that the rules give
    them; repeated rows have equal scores; columns of the added names are replaced.
    """

    @F.pandas_udf("array<double>")
    def measure(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([statistics(t) for t in texts])

    scored = df.withColumn("statistics", measure("text"))
    scored = scored.withColumn("score", rules.column(F.col("statistics")))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document; rows with crc32(doc_id) mod 3 = 1 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_quality(docs, learn(docs, labels, fold(F.col("doc_id"), 3) != 1))
    return out.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")
