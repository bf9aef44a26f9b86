"""Operators against brute force, the public libraries or planted cases, with awkward rows:
nulls in every column, empty and long texts, repeated rows, an empty table and extra columns."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, fingerprints, html, licenses, neardup, packing, quality, shards, topk, toxicity
from tidemark.llm.common import tokenizer_file

LONG = " ".join(f"word{i % 97} Ünï{i % 13}" for i in range(6000))
TEXTS = [
    (1, "The MIT License\nit's  a test.\t42 apples", "en", "a"), (2, None, None, None), (3, "", "en", "a"), (None, "no id here", "en", "b"), (4, LONG, "de", "b"),
    (5, "   \n\n  spaces  ", "fr", None), (5, "   \n\n  spaces  ", "fr", None), (6, "日本語 текст <|endoftext|> Apache license, general PUBLIC license", "xx", "c"), (7, "one", "en", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string, lang string, source string")
    extra = {c: F.lit("clash") for c in ("shard", "score", "ids", "node", "root", "key", "block", "words", "n", "w")}
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns(extra)


@pytest.fixture(scope="module")
def documents_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{d}/documents.parquet")
    return d


@pytest.fixture(scope="module")
def empty_dir(spark, docs, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("empty"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").limit(0).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{d}/embeddings.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{d}/pages.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_empty_tables(spark, empty_dir):
    from tidemark.llm.queries import QUERIES

    for name, query in QUERIES.items():
        assert query(spark, empty_dir).count() == 0, name


def test_hilbert_index_is_a_curve():
    side, bits = 8, 3
    cells = np.array([(x, y, z) for x in range(side) for y in range(side) for z in range(side)])
    index = shards.hilbert_index(list(cells.T), bits)
    order = cells[np.argsort(index)]
    assert sorted(index) == list(range(side**3))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_shards_rows_law(spark, documents_dir):
    rows = shards.op1_hilbert_sharding(spark, documents_dir).collect()
    assert len(rows) == len(TEXTS)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(24)]
    assert max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in by.values())
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in TEXTS)
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["size"], r["text_crc32"]) for r in rows) == want


@pytest.fixture(scope="module")
def encode():
    return packing.encoder(tokenizer_file("byte_bpe_50k.json")).encode_ordinary


def test_bpe_matches_the_library(spark, docs, encode):
    got = sorted((r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_and_decode(docs).collect())
    want = []
    for _, t, _, _ in TEXTS:
        ids = encode(t or "")
        want.append((len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    full = bpe.encode_and_decode(docs, emit="ids").where("doc_id = 6").first()
    assert full["ids"] == encode(TEXTS[7][1]) and bytes(full["decoded"]).decode() == TEXTS[7][1]


def test_packing_ids_are_the_tokenizers(encode):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    for _, text, _, _ in TEXTS:
        assert encode(text or "") == t.encode(text or "", add_special_tokens=False).ids


def test_packing_places_every_id_once(spark, docs, encode):
    pieces = packing.pack(docs).collect()
    total = sum(len(encode(t or "")) + 1 for _, t, _, _ in TEXTS)
    assert sum(p["length"] for p in pieces) == total
    by = {}
    for p in pieces:
        assert len(p["ids"]) == 4 * p["length"]
        by.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048 and at & (at - 1) == 0  # a power of two takes no padding
    long = sorted((p for p in pieces if p["doc_id"] == 4), key=lambda p: p["start"])
    assert b"".join(bytes(p["ids"]) for p in long) == np.array([*encode(LONG), 1], "<u4").tobytes()


def test_packing_added_tokens_are_the_tokenizers(spark, tmp_path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_file("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", "x<|endoftext|>\n\n y", "  <|endoftext|", "plain  words", "", "日本 <|endoftext|>"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {}
    for p in packing.pack(spark.read.parquet(f"{tmp_path}/documents.parquet"), added_tokens=True).collect():
        got.setdefault(p["doc_id"], []).append((p["start"], np.frombuffer(bytes(p["ids"]), "<u4").tolist()))
    ids = [t.encode(x, add_special_tokens=False).ids for x in texts]
    assert [sum((part for _, part in sorted(got[i])), []) for i in range(len(texts))] == [[*x, 1] for x in ids]
    counts = {r["doc_id"]: r["doc_tokens"] for r in packing.op4_harmonic_packing(spark, str(tmp_path)).collect()}
    assert counts == {i: len(x) + 1 for i, x in enumerate(ids)}


def labelled(n, bad, good, seed=3):
    r = random.Random(seed)
    texts, y = [], []
    for i in range(n):
        words = [r.choice(good) + r.choice(good) for _ in range(r.randint(5, 60))]
        if i % 3 == 0:
            for _ in range(3):
                words.insert(r.randint(0, len(words)), r.choice(bad))
        texts.append(" ".join(words))
        y.append(int(i % 3 == 0))
    return texts, y


def test_toxicity_held_out_and_offsets(spark):
    texts, y = labelled(420, ["zzbad", "zzbadly", "vilex", "vilexo"], ["ka", "lo", "mi", "nu", "re", "so"])
    chain = toxicity.fit(texts[:300], y[:300], 1 / 3)
    cache = {}
    assert [int(chain.read(t, cache)[0] >= 0.5) for t in texts[300:]] == y[300:]
    score, spans = chain.read("Ünï ok ZZBADLY then fine", cache)
    assert score >= 0.5 and [(s["start"], s["end"]) for s in spans] == [(7, 14)]
    df = spark.createDataFrame([(1, None), (2, ""), (3, "vilex"), (3, "vilex")], "doc_id long, text string")
    got = toxicity.score_toxicity(df, chain).orderBy("doc_id").collect()
    assert [r["predicted"] for r in got] == [0, 0, 1, 1] and got[0]["score"] == got[1]["score"]


def test_chain_marginals_match_all_paths():
    chain = toxicity.Chain({}, -1.2, np.array([[0.4, -0.7], [0.1, 0.3]]), np.zeros(3))
    n, hits = 6, [(1, 0.8), (2, -0.3), (5, 1.1)]
    odds = [dict(hits).get(i, chain.rest) for i in range(n)]
    total, on = 0.0, np.zeros(n)
    for code in range(2**n):
        tags, last, s = [(code >> i) & 1 for i in range(n)], 0, 0.0
        for tag, o in zip(tags, odds, strict=True):
            s += chain.step[last, tag] + tag * o
            last = tag
        total += np.exp(s)
        on += np.exp(s) * np.array(tags)
    assert np.allclose(chain.marginals(n, hits), (on / total)[[1, 2, 5]])


def test_quality_rules_and_their_column(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    good = [" ".join(word() for _ in range(r.randint(3, 80))).capitalize() + "." for _ in range(150)]
    bad = [" ".join([word()] * r.randint(20, 60)) if i % 2 else " ".join(word().upper() + "!!" for _ in range(20)) for i in range(150)]
    rules = quality.fit(good[:100] + bad[:100], [1] * 100 + [0] * 100)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good[100:] + bad[100:])], "doc_id long, text string")
    got = {x["doc_id"]: x["predicted"] for x in quality.score_quality(df, rules).collect()}
    assert sum(got[i] == (i < 50) for i in got) >= 96
    odd = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    a, b = quality.score_quality(odd, rules).collect()
    assert a["score"] == b["score"] and 0 <= a["score"] <= 1
    assert quality.fit([], []).rules == ()


def test_simhash_edits_and_copies(spark, documents_dir):
    rows = fingerprints.op7_simhash(spark, documents_dir).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    follows = {7: 6, 6: 5, 5: 4, 4: 3, 3: 2, 2: 1, 1: None, None: 7}
    text = {i: t or "" for i, t, _, _ in TEXTS}
    for i, j in follows.items():
        k = len(text[i]) // 3
        edited = text[i][: len(text[i]) - k] + text[j][:k]
        assert by[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest(), i
        assert by[i]["n_chars"] == len(text[i]) and 0 <= by[i]["near_edited"] <= 1
    assert by[2]["fingerprint"] == by[3]["fingerprint"] == "0" * 32


def test_hamming_search_matches_brute_force(spark):
    r = random.Random(7)
    base = [(r.getrandbits(64), r.getrandbits(64)) for _ in range(20)]
    items = []
    for i in range(200):
        a, b = base[i % 20]
        for _ in range(r.randint(0, 5)):
            k = r.randrange(128)
            a, b = (a ^ (1 << k), b) if k < 64 else (a, b ^ (1 << (k - 64)))
        items.append((i, a, b))
    sign = lambda v: v - (1 << 64) if v >> 63 else v
    df = spark.createDataFrame([(i, sign(a), sign(b)) for i, a, b in items], "id long, f0 long, f1 long")
    got = {(x["query_id"], x["f0"], x["f1"]) for x in fingerprints.within_radius(df.where("id % 50 = 0"), df, 3).collect()}
    want = {(i, sign(c), sign(d)) for i, a, b in items if i % 50 == 0 for _, c, d in items if (a ^ c).bit_count() + (b ^ d).bit_count() <= 3}
    assert got == want


def test_license_places(spark, docs):
    got = sorted((r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in licenses.scan_licenses(docs, ["doc_id"]).collect())
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    want = []
    for _, t, _, _ in TEXTS:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(lower))
        places = [(i, label) for phrase, label in licenses.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        at = [i for i, _ in places]
        want.append((len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(got, key=key) == sorted(want, key=key)
    damaged = licenses.TEMPLATES[0][1].replace("free of charge", "free and clear of any charge").replace("publish ", "")
    one = licenses.scan_licenses(spark.createDataFrame([(1, "x y z " + damaged + " tail")], "id int, text string"), ["id"]).first()
    assert one["labels"] == "mit" and one["base_labels"] == "" and one["spans"][0]["first_word"] == 3


def test_edit_distances_match_the_table():
    def plain(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    r = random.Random(5)
    pairs, most = [], []
    for _ in range(120):
        a = [r.randint(0, 20) for _ in range(r.randint(0, 80))]
        b = [x for x in a if r.random() > 0.1] + [r.randint(0, 20) for _ in range(r.randint(0, 9))]
        pairs.append((np.array(a, np.int32), np.array(b, np.int32)))
        most.append(r.randint(0, 40))
    assert neardup.edit_distances(pairs, most) == [min(plain(a, b), t + 1) for (a, b), t in zip(pairs, most, strict=True)]


def test_near_duplicates(spark, docs):
    r = random.Random(11)
    word = lambda: "".join(r.choice("bcdfgklm") + r.choice("aeiou") for _ in range(3))
    rows = []
    passage = " ".join(word() for _ in range(60))
    for g in range(12):
        words = [word() for _ in range(150)]
        for c in range(4):
            other = [word() if r.random() < 0.02 else w for w in words]
            rows.append((100 * g + c, " ".join(words if c == 1 else other)))
        rows.append((100 * g + 50, passage + " " + " ".join(word() for _ in range(300))))  # shares a passage only
    rows += [(5000, None), (5001, ""), (None, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n", F.lit(0)).withColumn("node", F.lit("x"))
    nodes, documents = neardup.classes(df)
    got = {x["id"]: x["class_id"] for x in documents.join(nodes, "same").collect()}
    for g in range(12):
        assert [got[100 * g + c] for c in range(4)] == [100 * g] * 4 and got[100 * g + 50] == 100 * g + 50
    assert got[5000] == got[5001] == 5000 and got[None] == 0
    kept = sorted(x["doc_id"] for x in neardup.one_of_each(df).collect())
    assert kept == sorted([100 * g for g in range(12)] + [100 * g + 50 for g in range(12)] + [5000])
    assert neardup.one_of_each(docs).count() == 7  # null and empty are one text, repeated rows one document


def test_near_duplicates_behind_an_unrelated_leader(spark):
    r = random.Random(23)
    word = lambda: "".join(r.choice("bcdfgklmnprst") + r.choice("aeiou") for _ in range(3))
    passage, rows = " ".join(word() for _ in range(60)), []
    for g in range(150):  # all share a passage; 2g + 1 is 2g with a tenth of its own words replaced
        own = [word() for _ in range(60)]
        near = [word() if i % 10 == 4 else w for i, w in enumerate(own)]
        rows += [(2 * g, f"{passage} {' '.join(own)}"), (2 * g + 1, f"{passage} {' '.join(near)}")]
    nodes, documents = neardup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {x["id"]: x["class_id"] for x in documents.join(nodes, "same").collect()}
    assert got == {i: i - i % 2 for i in range(300)}


@pytest.mark.parametrize("n, edits, least", [(5, 1, 0.95), (9, 1, 0.99), (10, 2, 0.95), (17, 3, 0.93), (30, 6, 0.93), (200, 40, 0.96), (200, 20, 0.99)])
def test_sketches_meet_down_to_the_similarity(n, edits, least):
    r, met = np.random.default_rng(n + edits), 0
    for _ in range(300):
        a = r.integers(0, 1 << 30, n)
        b = a.copy()
        b[r.choice(n, edits, replace=False)] = r.integers(1 << 30, 1 << 31, edits)
        x, y = neardup.sketch(a), neardup.sketch(b)
        met += bool((x[: len(y)] == y[: len(x)]).any())
    assert met >= least * 300


def test_open_pairs_of_mixed_buckets(spark):
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 30, 100)
    near = base.copy()
    near[::6] = r.integers(0, 1 << 30, 17)
    texts = {0: r.integers(0, 1 << 30, 100), 1: base, 2: near, 3: base[:70], 4: base[::-1].copy(), 5: base}
    buckets = spark.createDataFrame([(7, i, len(w), 6) for i, w in texts.items()] + [(8, 3, 70, 1)], "key long, node long, n int, times long")
    held = spark.createDataFrame([(i, len(w), *neardup.parity(w).tolist()) for i, w in texts.items()], "node long, n int, " + ", ".join(f"p{i} long" for i in range(neardup.PARITY)))
    roots = spark.createDataFrame([(1, 1), (5, 1)], "node long, root long")
    got = {tuple(x) for x in neardup._open_pairs(neardup._mixed(buckets, roots), held, 0.8).collect()}
    assert got == {(1, 2), (2, 5), (1, 4), (4, 5), (2, 4)}  # not 0 (other words), 3 (length) or 1 with 5 (one class)


def test_top_k_matches_brute_force(spark):
    r = np.random.default_rng(2)
    v = np.vstack([r.normal(size=(150, 8)) * 0.3, np.repeat(r.normal(size=(3, 8)), 30, axis=0)]).astype(np.float32)
    rows = [(i, [float(x) for x in e]) for i, e in enumerate(v)] + [(900, None), (None, [0.5] * 8), (901, [float("nan")] * 8), (902, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, topk.top_k(df.where("vec_id % 10 = 0"), df, block=64).collect()))
    whole = np.floor(1024 * v.astype(float))
    want = []
    for q in range(0, len(v), 10):
        scores = sorted(((-int(s), i) for i, s in enumerate(whole @ whole[q]) if i != q))[:10]
        want += [(q, rank, i, -s) for rank, (s, i) in enumerate(scores, 1)]
    assert got == sorted(want)


def test_cover_tree_covers():
    x = np.random.default_rng(1).normal(size=(500, 5))
    seen = []

    def walk(node):
        assert (np.sqrt(((x[node.rows] - node.center) ** 2).sum(1)) <= node.radius + 1e-9).all()
        if node.children:
            assert sorted(np.concatenate([c.rows for c in node.children])) == sorted(node.rows)
            for c in node.children:
                walk(c)
        else:
            seen.extend(node.rows)

    walk(topk.cover_tree(x, 16))
    assert sorted(seen) == list(range(500))


def test_html_held_out_layouts_and_consistency(spark):
    fitted = html.model()
    r = random.Random(77)
    exact = 0
    for _ in range(60):
        page = html._page(r)
        nodes = html.nodes_of(html.parse(page))
        keep = html.decode(nodes, fitted.logit(html.features(nodes)))
        assert all(keep[n.parent.index] for n in nodes[1:] if keep[n.index])
        text = "\n".join(html.blocks(nodes, keep))
        exact += text.count("\x01") == page.count("\x01") and all("\x01" in w for w in text.split())
    assert exact >= 55
    page = "<body><nav><a href=/>Home</a></nav><article><h1>A &amp; B</h1><p>One <i>two</i>\n three<p>Four &lt; five.<script>var t='</p>'</script></article><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<p")], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {x["page_id"]: (x["text"], x["n_chars"]) for x in html.extract(df, ["page_id", "url"]).collect()}
    assert got == {1: ("A & B\nOne two three\nFour < five.", 32), 2: ("", 0), 3: ("", 0), 4: ("", 0)}


