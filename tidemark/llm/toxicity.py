"""Operator 5: toxic spans by a linear-chain conditional random field.

Labels mark documents, so tokens get theirs from them: words and word beginnings
that occur in toxic training documents far more often than in clean ones (a G
test) are toxic tokens there, all others are clean.  A two-state chain over
these token labels learns weights for words, beginnings and transitions by the
exact likelihood.  Scoring runs forward and backward over the whole text; tokens
without a learned feature share one transition matrix, so a gap of any length
is one power of it and the marginals stay exact.  Marginals give spans with
offsets, and their peak and sum give the document's score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fold, labelled_sample, table
from .trees import ridge_logistic, sigmoid

#: Labelled rows of each class that a fit reads at most (and ``common.SAMPLE_BYTES`` of text).
PER_CLASS = 2000
#: Lengths of the word beginnings that serve as features beside the word itself.
BEGINNINGS = (4, 5, 6)
#: Least G statistic and least ratio of document frequencies of a toxic feature.
LEAST_G, LEAST_LIFT = 24.0, 10.0
#: Tokens of a training window, steps of the fit.
SIZE, STEPS = 13, 120

_WORD = re.compile(r"\w+")


def features(word: str) -> list[str]:
    """Of a lower-case word: itself, and its beginnings, each with its kind."""
    return ["w" + word, *(f"{n}{word[:n]}" for n in BEGINNINGS if len(word) > n)]


@dataclass
class Chain:
    """``weights``: log-odds of the toxic state by feature; ``rest``: those of any token;
    ``step``: 2 x 2 transition scores; ``document``: weights of peak and sum."""

    weights: dict[str, float]
    rest: float
    step: np.ndarray
    document: np.ndarray
    _powers: dict = field(default_factory=dict, repr=False)

    def odds(self, word: str) -> float | None:
        """A token's log-odds, None if it has no learned feature."""
        found = [self.weights[f] for f in features(word) if f in self.weights]
        return sum(found) + self.rest if found else None

    def gap(self, n: int) -> np.ndarray:
        """The matrix of ``n`` tokens without features, scaled to a largest entry of 1."""
        if n not in self._powers:
            if n <= 1:
                m = np.exp(self.step + np.array([0.0, self.rest])) if n else np.eye(2)
            else:
                half = self.gap(n // 2)
                m = half @ half
                if n % 2:
                    m = m @ self.gap(1)
            if len(self._powers) > 20_000:
                self._powers.clear()
            self._powers[n] = m / m.max()
        return self._powers[n]

    def marginals(self, n: int, hits: list[tuple[int, float]]) -> np.ndarray:
        """P(toxic) at the ``hits`` (position, log-odds) of a text of ``n`` tokens."""
        ahead, at = [], -1
        now = np.array([1.0, 0.0])  # a text begins as if after a clean token
        for position, odds in hits:
            now = now @ self.gap(position - at - 1) @ np.exp(self.step + np.array([0.0, odds]))
            now = now / now.sum()
            ahead.append(now)
            at = position
        out = np.empty(len(hits))
        back, at = np.ones(2), n
        for i in range(len(hits) - 1, -1, -1):
            position, _ = hits[i]
            back = self.gap(at - position - 1) @ (np.exp(self.step + np.array([0.0, hits[i + 1][1]])) @ back if i + 1 < len(hits) else back)
            back = back / back.sum()
            both = ahead[i] * back
            out[i] = both[1] / both.sum()
            at = position
        return out

    def read(self, text: str | None, cache: dict) -> tuple[float, list[dict]]:
        """Score and toxic spans (code points, end exclusive) of a whole text."""
        text = text or ""
        hits = []
        words = _WORD.findall(text.lower())
        for i, word in enumerate(words):
            odds = cache.get(word, 0)
            if odds == 0:
                odds = cache[word] = self.odds(word)
            if odds is not None:
                hits.append((i, odds))
        p = self.marginals(len(words), hits) if hits else np.zeros(0)
        score = float(sigmoid(self.document @ np.array([1.0, *_summary(p)])))
        spans: list[dict] = []
        toxic = {i: float(v) for (i, _), v in zip(hits, p, strict=True) if v >= 0.5}
        if toxic:
            last = -2
            for i, m in enumerate(_WORD.finditer(text)):
                if i in toxic:
                    if last == i - 1:
                        spans[-1] |= {"end": m.end(), "p": max(spans[-1]["p"], toxic[i])}
                    else:
                        spans.append({"start": m.start(), "end": m.end(), "p": toxic[i]})
                    last = i
        return score, spans


def _summary(p: np.ndarray) -> list[float]:
    if not len(p):
        return [-8.0, 0.0]
    peak = min(max(float(p.max()), 3e-4), 1 - 3e-4)
    return [max(-8.0, float(np.log(peak / (1 - peak)))), float(np.log1p(p.sum()))]


def toxic_features(toxic: list[list[str]], clean: list[list[str]]) -> set[str]:
    """Features that mark toxic documents, by document frequency.

    Every document counts, but those that look like copies of one another (the same two
    smallest word hashes) share one vote, or a group of copies would make all its words toxic."""

    def frequencies(docs: list[list[str]]) -> tuple[Counter, float]:
        distinct = [set(words) for words in docs]
        kinds = [tuple(sorted(zlib.crc32(w.encode("utf-8", "replace")) for w in d)[:2]) for d in distinct]
        times, seen = Counter(kinds), Counter()
        for d, kind in zip(distinct, kinds, strict=True):
            vote = 1.0 / times[kind]
            for f in {f for w in d for f in features(w)}:
                seen[f] += vote
        return seen, max(1, len(times))

    (bad, n_bad), (good, n_good) = frequencies(toxic), frequencies(clean)
    found = set()
    for f, b in bad.items():
        g = good.get(f, 0.0)
        if b < 3 - 1e-9 or (b + 0.5) / (n_bad + 1) < LEAST_LIFT * (g + 0.5) / (n_good + 1):
            continue
        expected = (b + g) * n_bad / (n_bad + n_good)
        rest = (b + g) - expected
        statistic = 2 * (b * np.log(b / expected) + (g * np.log(g / rest) if g else 0.0))
        if statistic >= LEAST_G:
            found.add(f)
    return found


def _windows(docs: list[list[str]], marked: set[str], is_toxic: bool) -> Counter:
    """The whole documents in windows of ``SIZE`` tokens, and how often each occurs.

    A window is (label before it, marked features and label of each token).  Windows without
    a marked feature are alike, so all tokens of the sample count and few windows differ."""
    found: Counter = Counter()
    known: dict[str, tuple] = {}
    for words in docs:
        tokens = []
        for w in words:
            if (token := known.get(w)) is None:
                own = tuple(f for f in features(w) if f in marked)
                token = known[w] = (own, int(is_toxic and bool(own)))
            tokens.append(token)
        for at in range(0, len(tokens), SIZE):
            found[tokens[at - 1][1] if at else 0, tuple(tokens[at : at + SIZE])] += 1
    return found


def fit(texts: list[str], y: list[int], positive_share: float | None = None) -> Chain:
    """A chain from labelled documents; without both classes it marks nothing."""
    docs = [_WORD.findall(t.lower()) for t in texts]
    toxic, clean = [d for d, v in zip(docs, y, strict=True) if v], [d for d, v in zip(docs, y, strict=True) if not v]
    marked = toxic_features(toxic, clean) if toxic and clean else set()
    if not marked:
        return Chain({}, -8.0, np.zeros((2, 2)), np.array([-3.0, 0.0, 0.0]))
    chain = Chain(*_train(_windows(toxic, marked, True) + _windows(clean, marked, False)), np.zeros(3))
    cache: dict = {}
    x = []
    for words in docs:
        cache.update((w, chain.odds(w)) for w in set(words) if w not in cache)
        hits = [(i, o) for i, w in enumerate(words) if (o := cache[w]) is not None]
        x.append(_summary(chain.marginals(len(words), hits) if hits else np.zeros(0)))
    target = np.array(y, dtype=float)
    chain.document = ridge_logistic(np.array(x), target)
    if positive_share is not None:
        own, real = target.mean(), float(np.clip(positive_share, 0.01, 0.99))
        chain.document[0] += np.log(real / (1 - real)) - np.log(own / (1 - own))
    chain._powers.clear()
    return chain


def _train(windows: Counter) -> tuple[dict[str, float], float, np.ndarray]:
    """Weights by the exact log-likelihood of windows given the label before them, with a
    quadratic penalty, full-batch Adam; each window counts as often as it occurs.

    Only features that mark toxicity get weights, so all other tokens look alike and
    long gaps between hits cost one matrix power."""
    rows = sorted(windows)
    names = sorted({f for _, tokens in rows for own, _ in tokens for f in own})
    at = {f: i + 1 for i, f in enumerate(names)}  # 0: no feature
    n, size, width = len(rows), SIZE, len(BEGINNINGS) + 1
    index, tags, real = np.zeros((n, size, width), np.int64), np.zeros((n, size), np.int64), np.zeros((n, size), bool)
    times, first = np.array([float(windows[row]) for row in rows]), np.array([before for before, _ in rows])
    for r, (_, tokens) in enumerate(rows):
        for t, (own, label) in enumerate(tokens):
            index[r, t, : len(own)], tags[r, t], real[r, t] = [at[f] for f in own], label, True
    before = np.hstack([first[:, None], tags[:, :-1]])
    start = np.where(first[:, None] == np.arange(2), 0.0, -50.0)
    theta = np.zeros(len(names) + 1 + 1 + 4)  # features, token, transitions
    theta[-5] = -2.0
    mean, square = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, STEPS + 1):
        w = theta[: len(names) + 1].copy()
        w[0] = 0.0
        odds = w[index].sum(2) + theta[-5]
        step = theta[-4:].reshape(2, 2)
        score = np.where(real, odds, 0.0)
        ahead = np.zeros((n, size, 2))
        past = start
        for t in range(size):
            m = past[:, :, None] + step
            now = np.logaddexp(m[:, 0], m[:, 1])
            now[:, 1] += score[:, t]
            ahead[:, t] = past = np.where(real[:, t, None], now, past)
        total = np.logaddexp(past[:, 0], past[:, 1])
        back = np.zeros((n, 2))
        p = np.zeros((n, size))
        pairs = np.zeros((2, 2))
        for t in range(size - 1, -1, -1):
            here = real[:, t]
            p[:, t] = np.where(here, np.exp(ahead[:, t, 1] + back[:, 1] - total), 0.0)
            prior = ahead[:, t - 1] if t else start
            come = step[None] + back[:, None, :] + np.stack([np.zeros(n), score[:, t]], 1)[:, None, :]
            pairs += (np.exp(np.minimum(prior[:, :, None] + come - total[:, None, None], 0.0)) * (here * times)[:, None, None]).sum(0)
            back = np.where(here[:, None], np.logaddexp(come[:, :, 0], come[:, :, 1]), back)
        gap = np.where(real, tags - p, 0.0) * times[:, None]
        slope = np.zeros_like(theta)
        slope[: len(names) + 1] = np.bincount(index.ravel(), np.repeat(gap.ravel(), width), len(names) + 1)
        slope[0] = 0.0
        slope[-5] = gap.sum()
        seen = np.array([[((real & (before == i) & (tags == j)) * times[:, None]).sum() for j in (0, 1)] for i in (0, 1)])
        slope[-4:] = (seen - pairs).ravel()
        slope -= 0.1 * theta
        mean, square = 0.9 * mean + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        theta += 0.15 * (mean / (1 - 0.9**k)) / (np.sqrt(square / (1 - 0.999**k)) + 1e-8)
    return dict(zip(names, theta[1 : len(names) + 1].tolist(), strict=True)), float(theta[-5]), theta[-4:].reshape(2, 2)


def learn(docs: DataFrame, labels: DataFrame, train: Column, per_class: int = PER_CLASS) -> Chain:
    """A chain fitted on ``labels.toxic`` over the rows where ``train`` holds, a sample bounded in
    rows and bytes (``labelled_sample``); empty tables and one class alone give a chain that marks nothing."""
    return fit(*labelled_sample(docs, labels, "toxic", train, per_class))


def score_toxicity(df: DataFrame, chain: Chain) -> DataFrame:
    """``df`` with ``score`` double, ``predicted`` int and ``spans`` (start, end, p) added.

    Offsets count code points of the text.  Null and empty texts have the score of a
    text without toxic tokens and no spans; repeated rows have equal results;
    columns of the added names are replaced.
    """

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for texts in batches:
            found = [chain.read(t, cache) for t in texts]
            if len(cache) > 500_000:
                cache.clear()
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": [s for _, s in found]})

    scored = df.withColumn("_read", read("text"))
    scored = scored.withColumns({"score": F.col("_read.score"), "spans": F.col("_read.spans")}).drop("_read")
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op5_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document; rows with crc32(doc_id) mod 5 = 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = score_toxicity(docs, learn(docs, labels, fold(F.col("doc_id"), 5) != 0))
    return out.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted", "spans")
