"""The pipeline against a plain Python version of its stages, on planted documents."""

import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import neardup, quality, toxicity
from tidemark.llm.common import tokenizer_file

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def planted():
    """(documents, labels): clean, toxic and poor texts, exact and near copies, and awkward rows."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    docs, labels = [], []
    for i in range(240):
        kind = i % 4
        text = " ".join(prose(r.randint(8, 30)) for _ in range(r.randint(2, 6)))
        if kind == 1:  # toxic words
            words = text.split()
            for _ in range(3):
                words.insert(r.randrange(len(words)), r.choice(["zzvile", "zzvilest", "grubscum"]))
            text = " ".join(words)
        elif kind == 2:  # poor
            text = " ".join([word().upper() + "!!!"] * r.randint(30, 60)) + " |||| " + word()
        docs.append((i, text))
        if i % 3:
            labels.append((i, int(kind != 2), int(kind == 1)))
    good = [t for i, t in docs if i % 4 in (0, 3)]
    for j in range(20):
        words = good[j].split()
        words[len(words) // 2] = word()
        docs += [(1000 + j, good[j]), (2000 + j, " ".join(words))]
    docs += [(3000, None), (3001, ""), (None, good[0]), (5, docs[5][1])]
    return [(i, t, "en", "s", len(t or "")) for i, t in docs], labels


def fold(i, n):
    return 0 if i is None else zlib.crc32(str(i).encode()) % n


def sample(docs, labels, column, keep):
    """Texts, labels and share of the positives, as the operators' samples have them."""
    y = {row[0]: row[column] for row in labels if keep(row[0])}
    rows = sorted({(y[i], t) for i, t, *_ in docs if i in y and t is not None})
    return [t for _, t in rows], [v for v, _ in rows], sum(y.values()) / len(y)


def plain(docs, labels):
    chain = toxicity.fit(*sample(docs, labels, 2, lambda i: fold(i, 5) != 0))
    clean = [d for d in docs if chain.read(d[1], {})[0] < 0.5]
    rules = quality.fit(*sample(clean, labels, 1, lambda i: fold(i, 3) != 1))

    def good(text):
        s = quality.statistics(text)
        total = rules.intercept + sum(w for path, w in rules.rules if all((s[f] > t) == above for f, above, t in path))
        return 1 / (1 + np.exp(-total)) >= 0.5

    fine = [d for d in clean if good(d[1])]
    words = [neardup_words(t) for _, t, *_ in fine]
    number: dict[str, int] = {}
    arrays = [np.array([number.setdefault(w, len(number)) for w in ws], np.int64) for ws in words]
    parent = list(range(len(fine)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fine)):
        for j in range(i):
            if words[i] == words[j] if not words[i] or not words[j] else neardup.similar([(arrays[i], arrays[j])])[0]:
                if words[i] or (fine[i][1] or "") == (fine[j][1] or ""):
                    parent[max(root(i), root(j))] = min(root(i), root(j))
    groups: dict[int, list] = {}
    for i, d in enumerate(fine):
        groups.setdefault(root(i), []).append(d)
    kept = [min(g, key=lambda d: (d[0] is None, d[0])) for g in groups.values()]
    return clean, fine, kept


def neardup_words(text):
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", (text or "").lower()) if w]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("pipeline"))
    docs, labels = planted()
    spark.createDataFrame(docs, COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d, docs, labels


def test_stages_match_the_plain_version(spark, tables):
    import corpus_pipeline

    d, docs, labels = tables
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "quality", "near_duplicates", "packing"]
    now = spark.read.parquet(f"{d}/documents.parquet")
    key = lambda rows: sorted(((r[0] is None, r[0] or 0, r[1] or "") for r in rows))
    for name, want in zip(["toxicity", "quality", "near_duplicates"], plain(docs, labels), strict=True):
        out = stages[name](spark, now, d)
        assert out.columns == now.columns, name
        path = f"{d}/after_{name}"
        out.write.parquet(path)
        now = spark.read.parquet(path)
        assert key(now.select("doc_id", "text").collect()) == key(want), name
    kept = {r["doc_id"] for r in now.collect()}
    toxic, poor = {i for i in range(240) if i % 4 == 1}, {i for i in range(240) if i % 4 == 2}
    assert len(kept & toxic) <= 1 and len(kept & poor) <= 1 and len(kept - {None, 3000, 3001}) >= 115
    assert not any(1000 + j in kept or 2000 + j in kept for j in range(20))
    tokenizer = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    want = {r["doc_id"]: [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1] for r in now.collect()}
    pieces = stages["packing"](spark, now, d).collect()
    seen: dict = {}
    for p in pieces:
        ids = want[p["doc_id"]][p["start"] : p["start"] + p["length"]]
        assert p["doc_tokens"] == len(want[p["doc_id"]]) and zlib.crc32(np.array(ids, "<u4").tobytes()) == p["ids_crc32"]
        seen.setdefault(p["doc_id"], []).append((p["start"], p["length"]))
    for i, parts in seen.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(want[i])
    assert set(seen) == set(want)


def test_run_is_the_stages_in_a_row(spark, tables):
    import corpus_pipeline

    d, _, _ = tables
    ids = {r["doc_id"] for r in corpus_pipeline.run(spark, d).select("doc_id").distinct().collect()}
    assert ids == {r["doc_id"] for r in spark.read.parquet(f"{d}/after_near_duplicates").collect()}


def test_pipeline_of_an_empty_table_and_of_one_label(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    d = tmp_path / "one"
    spark.createDataFrame([(1, "a text", "en", None, 6), (1, "a text", "en", None, 6), (None, None, None, None, None)], COLUMNS).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(d)).collect()} == {1, None}
