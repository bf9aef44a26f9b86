"""Long inputs, ties, repeated rows, clashing names and cases that were once lost."""

import random
import re
import time

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import common, fingerprints, html, licenses, neardup, quality, shards, topk, toxicity

PARAGRAPHS = "".join(f"<p>Mirelo hasun tovira kamelo dustin veltra, soramin el dovara kintu melora sivan trelo number {i}.</p>" for i in range(4))


@pytest.fixture(scope="module")
def read_page():
    fitted = html.model()
    return lambda page: html.main_text([page], fitted)[0]


@pytest.mark.parametrize(
    "page",
    [
        f"<article><h1>T</h1><p title=it's fine>First words of the text, and some more of them.</p>{PARAGRAPHS}</article>",
        f"<div><select><option>x</div><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<object data=x><article><h1>T</h1>{PARAGRAPHS}</article><footer>f</footer>",
        f"<math><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<noscript><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<textarea><article><h1>T</h1>{PARAGRAPHS}</article>",
        f"<!--><article><h1>T</h1>{PARAGRAPHS}</article>",
        f'<article><h1>T</h1><p class="a>b" data-x=\'c>d\'>In front, words that stay in the text of it all.</p>{PARAGRAPHS}</article>',
    ],
)
def test_odd_markup_keeps_the_article(read_page, page):
    text = read_page(f"<html><body>{page}</body></html>")
    assert all(f"number {i}." in text for i in range(4)) and "T" in text.split("\n") and "fine" not in text and "data-x" not in text


def test_text_of_math_and_links_stays(read_page):
    text = read_page(f"<body><nav><a href=/>Home</a></nav><article><h1>T</h1>{PARAGRAPHS}<p>here <math><mi>x</mi></math> is <a href=/a/>linked</a> text</p></article></body>")
    assert text.endswith("here x is linked text") and "Home" not in text


def test_a_page_with_many_siblings_takes_time_in_proportion(read_page):
    took = []
    for n in (10_000, 40_000):
        page = "<body><article>" + "".join(f"<p>word word {i}.</p>" for i in range(n)) + "</article></body>"
        start = time.process_time()
        assert len(read_page(page).split("\n")) == n
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1


def test_toxic_windows_cover_the_whole_sample():
    docs = [["bad", *["w"] * 100, "bad", "bad"], ["w"] * 27]
    windows = toxicity._windows(docs, {"wbad"}, True)
    assert sum(len(tokens) * n for (_, tokens), n in windows.items()) == 130
    assert sum(label * n for (_, tokens), n in windows.items() for _, label in tokens) == 3


def test_copies_share_a_vote():
    toxic = [["slur", "alpha", "beta", f"x{i}"] for i in range(12)] + [["onlyhere", "copy", "text"]] * 200
    clean = [["alpha", "beta", f"y{i}"] for i in range(60)]
    found = toxicity.toxic_features(toxic, clean)
    assert "wslur" in found and "wonlyhere" not in found


def test_sample_is_bounded_in_bytes(spark):
    docs = spark.createDataFrame([(i, "x" * 1000 + str(i)) for i in range(50)] + [(99, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (99, 1)], "doc_id long, toxic int")
    texts, y, share = common.labelled_sample(docs, labels, "toxic", F.lit(True), 20, 5_500)
    assert y.count(0) == y.count(1) == 5 and all(len(t) > 1000 for t in texts) and abs(share - 0.5) < 0.02
    assert common.labelled_sample(docs, labels.limit(0), "toxic", F.lit(True), 20) == ([], [], None)


def votes(text):
    """Plain form of the fingerprint's votes: terms with their weights, in order."""
    words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(f"({fingerprints.UNSPACED})", r" \1 ", text).translate({c: c + 32 for c in range(65, 91)})) if w]
    words = words or list(text)
    return words and [(a, b, 1 + (len(a) > 3) + (len(b) > 3)) for a, b in zip(words, [*words[1:], ""], strict=True)]


def test_block_tables_are_not_broadcast(spark):
    df = spark.range(0, 400).select("id", F.xxhash64("id").alias("f0"), F.xxhash64("id", "id").alias("f1"))
    near = fingerprints.within_radius(df.where("id % 50 = 0"), df, 6)
    plan = near._jdf.queryExecution().sparkPlan().toString()
    tables = plan.index("explode") if "explode" in plan else plan.index("Generate")
    assert "SortMergeJoin [key" in plan[:tables] and {r["query_id"] for r in near.collect()} == set(range(0, 400, 50))


def test_fingerprints_match_plain_votes(spark):
    texts = ["spam spam " * 50 + "ham eggs", "spam spam ham eggs", "!!!", "??? ---", "今日は天気がいいので散歩に行きました", "今日は天気がいいので散歩へ行きました", "Ünï code Words here", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = {r["id"]: (r["f0"], r["f1"]) for r in fingerprints.vote(df, ["id"]).collect()}
    terms = [(i, a, b, w) for i, t in enumerate(texts) for a, b, w in votes(t)]
    hashed = spark.createDataFrame(terms, "id int, a string, b string, w long")
    hashed = hashed.withColumn("t", F.xxhash64("a", "b").bitwiseAND(F.lit(-4)).bitwiseOR(F.col("w"))).select("id", "w", F.xxhash64("t", F.lit(0)).alias("h0"), F.xxhash64("t", F.lit(1)).alias("h1")).collect()
    for i in range(len(texts)):
        rows = [r for r in hashed if r["id"] == i]
        for k in (0, 1):
            total = sum(r["w"] for r in rows)
            want = sum(1 << j for j in range(64) if 2 * sum(r["w"] for r in rows if r[f"h{k}"] >> j & 1) > total)
            assert got[i][k] & (1 << 64) - 1 == want, texts[i]
    gap = lambda a, b: sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(got[a], got[b], strict=True))
    assert got[0] != got[1] and gap(2, 3) > 20 and gap(4, 5) < 45 and got[7] == (0, 0)


def test_search_names_the_nearest(spark, tmp_path):
    r = random.Random(9)
    words = [f"{r.choice('bcdfg')}{r.choice('aeiou')}{i}" for i in range(4000)]
    base = " ".join(words)
    near = base.replace(words[7], "other").replace(words[2000], "more")
    rows = [(50, base), (51, near), (52, " ".join(reversed(words))), (100, base), (None, None), (150, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x["doc_id"]: x for x in fingerprints.op7_simhash(spark, str(tmp_path)).collect()}
    assert got[50]["nearest_doc"] == 51 and got[50]["n_within_radius"] == 1 and 0 < got[50]["nearest_bits"] <= fingerprints.RADIUS
    assert got[50]["fingerprint"] == got[100]["fingerprint"] and got[51]["n_within_radius"] is None and got[150]["n_within_radius"] == 0


def test_license_template_with_a_passage_put_in_or_left_out(spark):
    words = licenses.TEMPLATES[0][1].split()
    inside = words[:27] + [f"filler{i}" for i in range(12)] + words[27:]
    without = words[:20] + words[29:]
    other = ["permission", "is", "hereby", "granted"] + [f"w{i}" for i in range(40)]
    texts = [" ".join(["start", *inside]), " ".join(without), " ".join(other)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(1, texts[1])], "id int, text string").withColumn("template", F.lit(1)).withColumn("n", F.lit(1))
    got = sorted((r["id"], r["labels"]) for r in licenses.scan_licenses(df, ["id"]).collect())
    assert got == [(0, "mit"), (1, "mit"), (1, "mit"), (2, "")]


def test_license_scan_of_a_very_long_text(spark):
    n = 200_000
    text = " ".join(f"w{i % 5000}" for i in range(n)) + " the MIT license " + licenses.TEMPLATES[1][1]
    row = licenses.scan_licenses(spark.createDataFrame([(1, text)], "id int, text string"), ["id"]).first()
    assert row["labels"] == "apache,mit" and row["base_labels"] == "mit" and row["first_word"] == n + 1


def test_alignment_of_very_long_texts():
    r = np.random.default_rng(3)
    a = r.integers(0, 1 << 30, 200_000).astype(np.int32)
    b = a.copy()
    b[r.choice(len(b), 2000, replace=False)] = 7
    assert neardup.edit_distances([(a, b)], [40_000]) == [2000]


def test_fine_parities_never_rule_out_a_link():
    r = np.random.default_rng(6)
    for n in (1, 40, 290, 310, 900, 5000, 20_000):
        a = r.integers(0, 1 << 30, n)
        for share in (0.0, 0.1, 0.2):
            b = a.copy()
            edits = int(share * n)
            b[r.choice(n, edits, replace=False)] = r.integers(1 << 30, 1 << 31, edits)
            b = b[: n - int(0.02 * n)] if share < 0.2 else b
            most = edits + int(0.02 * n)
            assert neardup.differing_bits(neardup.fine_parity(a), neardup.fine_parity(b)) <= 2 * most
        other = r.integers(0, 1 << 30, n)
        assert n < 40 or neardup.differing_bits(neardup.fine_parity(a), neardup.fine_parity(other)) > 0.4 * n


def test_texts_that_share_most_of_a_passage_find_their_copies(spark):
    r = random.Random(31)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    passage, rows = " ".join(word() for _ in range(90)), []
    for g in range(120):  # a common passage makes most of each text; 2g + 1 is 2g with some words replaced
        own = [word() for _ in range(60)]
        near = [word() if i % 12 == 4 else w for i, w in enumerate(own)]
        rows += [(2 * g, f"{passage} {' '.join(own)}"), (2 * g + 1, f"{passage} {' '.join(near)}")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    nodes, documents = neardup.classes(df)
    got = {x["id"]: x["class_id"] for x in documents.join(nodes, "same").collect()}
    assert sum(got[i] == i - i % 2 for i in got) >= 228 and all(got[i] // 2 == i // 2 for i in got)


def test_near_duplicate_recall_against_brute_force(spark):
    """All pairs of isolated near copies by similarity, without any cap on partners."""
    r = random.Random(41)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(2))
    rows, texts = [], []
    for g in range(150):
        n = r.choice([8, 20, 60, 200])
        own = [word() for _ in range(n)]
        edits = r.sample(range(n), max(1, int(n * r.choice([0.02, 0.08, 0.15]))))
        other = list(own)
        for i in edits:
            other[i] = word()
        if r.random() < 0.5 and n > 8:
            del other[r.randrange(len(other))]
        texts += [own, other]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    arrays = [np.array([hash(w) & 0x7FFFFFFF for w in t], np.int64) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if min(len(texts[i]), len(texts[j])) >= 0.8 * max(len(texts[i]), len(texts[j]))]
    near = {p for p, ok in zip(pairs, neardup.similar([(arrays[i], arrays[j]) for i, j in pairs]), strict=True) if ok}
    nodes, documents = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["id"]: x["class_id"] for x in documents.join(nodes, "same").collect()}
    assert sum(got[i] == got[j] for i, j in near) >= 0.98 * len(near) and len(near) > 120
    linked = {}
    for i, j in near:  # classes hold nothing but chains of links
        linked.setdefault(i, set()).add(j)
        linked.setdefault(j, set()).add(i)
    for i, c in got.items():
        assert c == i or linked.get(i)


def test_top_k_is_exact_and_counts_repeated_ids(spark, tmp_path):
    rows = [(100, [1e6, 1.0]), (1, [1e6 + 1 / 1024, 1.0]), (2, [2.0, 0.0]), (2, [3.0, 0.0]), (100, [1e6, 1.0]), (3, [1e6, 1e6]), (200, [1e6, 1.5e6]), (4, [float("inf"), 0.0]), (5, None), (None, [1.0, 1.0]), (300, []), (6, []), (400, [1e6 + 1 / 1024, 1.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = sorted(tuple(r) for r in topk.op10_exact_topk(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = sorted(tuple(r) for r in con.execute(topk.OP10_SQL).fetchall())
    assert got == want and any(int(float(r[3])) != r[3] for r in got)
    far = spark.createDataFrame([(100, [3e7, 4e7]), (1, [4e7, 4e7]), (2, [-4e7, -4e7]), (3, [5e7, 5e7])], "vec_id long, embedding array<double>")
    assert [tuple(r)[2:] for r in topk.top_k(far.where("vec_id = 100"), far).orderBy("rank").collect()] == [(1, (1 << 63) - 1), (3, (1 << 63) - 1), (2, -(1 << 63))]


def test_top_k_prunes_pairs_of_groups_and_keeps_the_results(spark):
    r = np.random.default_rng(8)
    centers = r.normal(size=(12, 6)) * 6
    v = np.concatenate([c + r.normal(size=(60, 6)) * 0.05 for c in centers] + [np.repeat(r.normal(size=(1, 6)), 200, axis=0)])
    df = spark.createDataFrame([(i, [float(x) for x in e], "x", 1, 2) for i, e in enumerate(v)], "vec_id long, embedding array<double>, cell string, n int, part int")
    met: list = []
    got = sorted(tuple(x) for x in topk.top_k(df.where("vec_id % 10 = 0"), df, block=64, pivots=24, met=met).collect())
    whole = np.floor(1024 * v)
    want = []
    for q in range(0, len(v), 10):
        best = sorted((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q)[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(best, 1)]
    assert got == sorted(want)
    assert met[1] < 0.7 * met[0]


def test_equal_vectors_beyond_a_leaf(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(3000)] + [(5, [1.0, 2.0])] * 300, "vec_id long, embedding array<double>")
    got = sorted(tuple(x) for x in topk.top_k(df.where("vec_id in (0, 2000)").distinct(), df, k=4).collect())
    score = 1024**2 * 5
    assert got == [(0, 1, 1, score), (0, 2, 2, score), (0, 3, 3, score), (0, 4, 4, score), (2000, 1, 0, score), (2000, 2, 1, score), (2000, 3, 2, score), (2000, 4, 3, score)]


def test_shards_keep_strings_with_a_common_prefix_apart(spark):
    rows = [(i, f"https://example.org/source-{i % 4}") for i in range(400)] + [(400, None)]
    df = spark.createDataFrame(rows, "doc_id long, source string")
    got = shards.hilbert_shards(df, ["source"], 4, tie=["doc_id"]).collect()
    by = {}
    for x in got:
        by.setdefault(x["shard"], set()).add(x["source"])
    assert max(map(len, by.values())) <= 2 and sum(map(len, by.values())) <= 9
    with pytest.raises(ValueError, match="shard"):
        shards.hilbert_shards(df.withColumn("shard", F.lit(1)), ["source"], 4)


def test_block_names_fill_every_partition(spark):
    from tidemark.llm import bpe

    names = bpe.block_names(spark, 37)
    df = spark.createDataFrame([(n,) for n in names], "block int").repartition(37, "block")
    assert len(names) == 37 and df.select(F.spark_partition_id()).distinct().count() == 37
    assert bpe.n_ranges_for(10**14, 8) < 10**5 and bpe.n_ranges_for(0, 8) == 8


def test_quality_column_is_the_rules(spark):
    rules = quality.Rules(-0.3, ((((0, True, 1.5), (3, False, 0.2)), 0.8), (((5, True, 0.0),), -1.1)))
    r = random.Random(2)
    rows = [(i, [r.uniform(-1, 4) for _ in quality.STATISTICS]) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, s array<double>")
    got = {x["id"]: x["score"] for x in df.select("id", rules.column(F.col("s")).alias("score")).collect()}
    for i, s in rows:
        total = -0.3 + (0.8 if s[0] > 1.5 and s[3] <= 0.2 else 0) + (-1.1 if s[5] > 0 else 0)
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-12


def test_names_that_clash(spark):
    names = ("statistics", "score", "predicted", "spans", "_read", "held_out", "y", "bytes")
    df = spark.createDataFrame([(1, "a text"), (1, "a text"), (None, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in names})
    chain, rules = toxicity.fit([], []), quality.fit([], [])
    assert [r["predicted"] for r in toxicity.score_toxicity(df, chain).collect()] == [0, 0, 0]
    assert {r["predicted"] for r in quality.score_quality(df, rules).collect()} <= {0, 1}


def test_a_cluster_without_a_shared_folder_is_refused():
    class Empty:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"

        class _jsc:
            @staticmethod
            def sc():
                class S:
                    @staticmethod
                    def getCheckpointDir():
                        return Empty()

                return S()

    class Frame:
        class sparkSession:
            sparkContext = Context()

            class conf:
                @staticmethod
                def get(name, default=None):
                    return default

    with pytest.raises(ValueError, match="checkpoint"):
        common.checkpointed(Frame())


def passage_rows():
    """A passage of all, words of two alone and one edit between these, and one text more."""
    rng = random.Random(21)
    rows = []
    for i in range(45):
        own = [f"w{i}x{rng.randrange(10**6)}" for _ in range(40)]
        rows += [(2 * i, " ".join(["passage of all"] * 5 + own)), (2 * i + 1, " ".join(["passage of all"] * 5 + own[:-1] + ["edited"]))]
    return [*rows, (90, " ".join(["passage of all"] * 5 + [f"alone{k}" for k in range(40)]))]


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """All texts in one bucket, many more than are compared first: every link between any two is found."""
    monkeypatch.setattr(neardup, "sketch", lambda words: np.array([7], np.int64))
    nodes, documents = neardup.classes(spark.createDataFrame(passage_rows(), "doc_id long, text string"))
    got = {r["id"]: r["class_id"] for r in documents.join(nodes, "same").collect()}
    assert got == {i: i - i % 2 for i in range(91)}


def test_pipeline_drops_copies_of_large_buckets(spark, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(neardup, "sketch", lambda words: np.array([7], np.int64))
    docs = spark.createDataFrame(passage_rows(), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == list(range(0, 91, 2))


def test_large_buckets_make_no_pairs(spark, monkeypatch):
    """The same words in 120 orders, which parities can't tell apart, in one bucket: their pairs are no rows,
    and links between any two blocks are found."""
    rng, asked, links = random.Random(5), [], neardup._links
    words = [f"w{i}" for i in range(60)]
    texts = [rng.sample(words, 60) for _ in range(120)]
    for i in range(1, 120, 2):  # a few of the last words of the text before in another order
        texts[i] = texts[i - 1][:55] + texts[i - 1][:-6:-1]
    monkeypatch.setattr(neardup, "sketch", lambda words: np.array([7], np.int64))
    monkeypatch.setattr(neardup, "_links", lambda pairs, *more: (asked.append(pairs.count()), links(pairs, *more))[1])
    for size in (256, 16):
        monkeypatch.setattr(neardup, "BLOCK", size, raising=False)
        nodes, documents = neardup.classes(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string"))
        got = {r["id"]: r["class_id"] for r in documents.join(nodes, "same").collect()}
        assert got == {i: i - i % 2 for i in range(120)} and sum(asked) < 3 * 120
        asked.clear()


def test_few_links_take_few_jobs_and_many_the_same_components(spark, monkeypatch):
    rng, written, checkpointed = random.Random(3), [], neardup.checkpointed
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 410)]
    want = {x: x for link in links for x in link}
    for _ in want:
        for a, b in links:
            want[a] = want[b] = min(want[a], want[b])
    monkeypatch.setattr(neardup, "checkpointed", lambda df: (written.append(1), checkpointed(df))[1])
    old, new = (spark.createDataFrame(x, "a long, b long") for x in (links[::2], links[1::2]))
    assert {tuple(r) for r in neardup.components(old.union(new)).collect()} == set(want.items()) and len(written) <= 2
    assert {tuple(r) for r in neardup._joined(neardup.components(old), new).collect()} == set(want.items())
    monkeypatch.setattr(neardup, "FEW_LINKS", 60)
    assert {tuple(r) for r in neardup.components(old.union(new)).collect()} == set(want.items())
