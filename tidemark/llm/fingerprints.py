"""Operator 7: 128-bit SimHash fingerprints, and a search within a Hamming radius.

Terms are the pairs of neighbouring words (the last word pairs with the text's end);
each occurrence votes, weighted by how many of the two are long.  Letters of scripts
that are written without spaces are words of their own, and a text without words has its
characters as words.  Terms vote on 128 bits; a bit is set when more than half the
weight voted for it.  Two counters of 32 bits share one long, so 64 sums count all votes
and stay in generated code.  The search cuts fingerprints into blocks, keeps a table for
every choice of blocks that must be equal within the radius, and compares what meets.
DataFrame functions only.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_words, checkpointed, ranked, table

BITS = 128
#: Differing bits at most, in the search for the documents whose id is divisible by 50.
RADIUS = 6
_PAIR = (1 << 32) | 1
#: Letters of scripts without spaces between words: Thai to Khmer, kana, Han.
UNSPACED = r"[\u0E00-\u0EFF\u1000-\u109F\u1780-\u17FF\u3040-\u30FF\u3400-\u4DBF\u4E00-\u9FFF\uF900-\uFAFF]"


def words_of(text: Column) -> Column:
    """Words of a text, letters of unspaced scripts apart."""
    return ascii_words(F.when(text.rlike(UNSPACED), F.regexp_replace(text, f"({UNSPACED})", " $1 ")).otherwise(text))


def vote(df: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Fingerprints of the rows of ``df`` by ``keys``: ``f0`` and ``f1`` long.

    Rows with equal keys vote together, so keys tell rows apart.  An empty text,
    or null, has no votes and the fingerprint 0.  A text may have 2**30 terms.
    """
    words = words_of(F.col(text))
    characters = F.array_remove(F.split(F.coalesce("_text", F.lit("")), ""), "")
    read = df.select(*keys, F.col(text).alias("_text"), words.alias("_found"))
    read = read.select(*keys, F.when(F.size("_found") > 0, F.col("_found")).otherwise(characters).alias("_words"))
    after = F.slice(F.concat("_words", F.array(F.lit(""))), 2, F.greatest(F.size("_words"), F.lit(1)))

    def term(word: Column, after: Column) -> Column:
        weight = 1 + (F.length(word) > 3).cast("long") + (F.length(after) > 3).cast("long")
        return F.xxhash64(word, after).bitwiseAND(F.lit(-4)).bitwiseOR(weight)  # the weight sits in two low bits

    terms = read.select(*keys, F.explode_outer(F.zip_with("_words", after, term)).alias("_term"))
    hashes = {k: F.xxhash64("_term", F.lit(k)) for k in (0, 1)}
    terms = terms.select(*keys, F.coalesce(F.col("_term").bitwiseAND(F.lit(3)), F.lit(0)).alias("_w"), *[h.alias(f"_h{k}") for k, h in hashes.items()])
    sums = [
        F.sum(F.shiftrightunsigned(f"_h{k}", j).bitwiseAND(F.lit(_PAIR)) * F.col("_w")).alias(f"_v{k}_{j}") for k in hashes for j in range(32)
    ]
    votes = terms.groupBy(*keys).agg(F.sum("_w").alias("_total"), *sums)

    def fingerprint(k: int) -> Column:
        out = F.lit(0).cast("long")
        for j in range(32):
            v = F.coalesce(F.col(f"_v{k}_{j}"), F.lit(0))
            for bit, count in ((j, v.bitwiseAND(F.lit((1 << 32) - 1))), (j + 32, F.shiftrightunsigned(v, 32))):
                one = (1 << bit) - (1 << 64 if bit == 63 else 0)
                out = out.bitwiseOR(F.when(count * 2 > F.col("_total"), F.lit(one).cast("long")).otherwise(F.lit(0).cast("long")))
        return out

    return votes.select(*keys, fingerprint(0).alias("f0"), fingerprint(1).alias("f1"))


def distance(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.bit_count(a0.bitwiseXOR(b0)) + F.bit_count(a1.bitwiseXOR(b1))


def shown(f0: Column, f1: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f0), 16, "0"), F.lpad(F.hex(f1), 16, "0")))


def within_radius(queries: DataFrame, rows: DataFrame, radius: int, blocks: int | None = None) -> DataFrame:
    """(query_id, f0, f1, distance): all distinct fingerprints within ``radius`` of each query.

    Both have ``id``, ``f0`` and ``f1``.  Of the ``blocks`` (radius + 2 if not given) 8 to
    32 bits wide, those that hold a differing bit number ``radius`` at most, so some choice
    of the others is equal; there is a table for each choice, keyed by its number and the
    blocks' bits.  Equal fingerprints count once on both sides: a group of copies costs one
    row.  Neither side is broadcast.  Keys of large groups of near copies are left to the adaptive skew join, which splits
    both sides of them.  Rows without a fingerprint (null) take no part,
    queries that share one have the same results, and an empty table gives no rows.
    """
    blocks = blocks or radius + 2
    cuts = [round(i * BITS / blocks) for i in range(blocks + 1)]

    def bits(low: int, high: int) -> list[Column]:
        parts = []
        for k in (0, 1):
            a, b = max(low, 64 * k) - 64 * k, min(high, 64 * k + 64) - 64 * k
            if a < b:
                mask = (1 << (b - a)) - 1
                parts.append(F.shiftrightunsigned(f"f{k}", a).bitwiseAND(F.lit(mask if mask < 1 << 63 else -1)))
        return parts

    chosen = list(combinations(range(blocks), blocks - radius))

    def distinct(df: DataFrame) -> DataFrame:
        return df.select("f0", "f1").where(F.col("f0").isNotNull()).distinct()

    def keyed(df: DataFrame) -> DataFrame:
        tables = [F.xxhash64(F.lit(n), *[x for i in choice for x in bits(cuts[i], cuts[i + 1])]) for n, choice in enumerate(chosen)]
        return df.select("f0", "f1", F.explode(F.array(*tables)).alias("key"))

    q = keyed(distinct(queries)).select("key", F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    gap = distance(F.col("q0"), F.col("q1"), F.col("f0"), F.col("f1"))
    # sizes are guessed without what explode adds, 28 rows a query: a broadcast of them would fill the driver
    near = q.join(keyed(distinct(rows)).hint("merge"), "key").withColumn("distance", gap).where(F.col("distance") <= radius)
    near = near.select("q0", "q1", "f0", "f1", "distance").distinct()
    asked = queries.select(F.col("id").alias("query_id"), F.col("f0").alias("q0"), F.col("f1").alias("q1"))
    return asked.join(near, ["q0", "q1"]).select("query_id", "f0", "f1", "distance")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text.

    The next document is the next lower one by (doc_id, text hash), null ids last and
    exact repetitions of a row counted as one document; after the last comes the first.
    For ids divisible by 50, ``n_within_radius`` counts the other fingerprints of the whole table
    within ``RADIUS`` bits (copies share a fingerprint and count once), and ``nearest_doc`` and
    ``nearest_bits`` name the smallest id with the nearest of them and its distance.
    """
    docs = table(spark, sf_dir, "documents").select(
        F.coalesce(F.col("doc_id"), F.lit(0)).alias("d"),
        F.xxhash64(F.col("doc_id").isNull(), F.coalesce(F.col("text"), F.lit(""))).alias("h"),
        F.col("doc_id").isNull().alias("no_id"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    meta = docs.groupBy("d", "h").agg(F.max("no_id").alias("no_id"), F.max(F.char_length("text")).cast("long").alias("n"), F.count("*").alias("times"))
    order, total = ranked(meta, [F.asc("no_id"), F.desc("d"), F.desc("h")])
    after = order.select(F.pmod(F.col("_rank") - 1, F.lit(max(total, 1))).alias("_rank"), F.col("d").alias("d2"), F.col("h").alias("h2"))
    pairs = order.join(after, "_rank").drop("_rank")

    texts = docs.select("d", "h", "text")
    give = pairs.select(F.col("d2").alias("d"), F.col("h2").alias("h"), F.col("d").alias("to_d"), F.col("h").alias("to_h"), F.expr("n div 3").alias("take"))
    heads = texts.join(give, ["d", "h"]).select(F.col("to_d").alias("d"), F.col("to_h").alias("h"), F.expr("substring(text, 1, cast(take as int))").alias("head"))
    heads = heads.groupBy("d", "h").agg(F.first("head").alias("head"))
    edits = texts.join(heads, ["d", "h"])
    edited = F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 3), head)")
    both = F.array(F.struct(F.lit(0).alias("v"), F.col("text").alias("t"), F.lit("").alias("sha")), F.struct(F.lit(1).alias("v"), edited.alias("t"), F.sha2(edited, 256).alias("sha")))
    versions = edits.dropDuplicates(["d", "h"]).select("d", "h", F.explode(both).alias("x")).select("d", "h", "x.v", "x.sha", F.col("x.t").alias("text"))
    found = vote(versions, ["d", "h", "v", "sha"])
    pick = lambda v, c: F.max(F.when(F.col("v") == v, F.col(c))).alias(f"{c}_{v}")
    row = found.groupBy("d", "h").agg(F.max("sha").alias("sha"), *[pick(v, c) for v in (0, 1) for c in ("f0", "f1")])
    row = checkpointed(row)  # read twice below; the votes are the costly part
    other = row.select(F.col("d").alias("d2"), F.col("h").alias("h2"), F.col("f0_0").alias("g0"), F.col("f1_0").alias("g1"))
    held = row.select(F.struct("d", "h").alias("id"), F.col("f0_0").alias("f0"), F.col("f1_0").alias("f1"))
    asked = held.join(pairs.where("not no_id and d % 50 = 0").select(F.struct("d", "h").alias("id")), "id", "left_semi")
    names = held.join(pairs.where("not no_id").select(F.struct("d", "h").alias("id")), "id", "left_semi")
    names = names.groupBy("f0", "f1").agg(F.min("id.d").alias("doc"))
    near_by = within_radius(asked, held, RADIUS).join(names, ["f0", "f1"], "left")
    near_by = near_by.groupBy("query_id").agg(
        (F.count("*") - 1).alias("n_within_radius"), F.min(F.when(F.col("distance") > 0, F.struct("distance", "doc"))).alias("best")
    )
    near_by = near_by.select("query_id.d", "query_id.h", "n_within_radius", F.col("best.doc").alias("nearest_doc"), F.col("best.distance").alias("nearest_bits"))
    out = pairs.join(row, ["d", "h"]).join(other, ["d2", "h2"]).join(near_by, ["d", "h"], "left")
    near = lambda a, b: 1.0 - distance(F.col("f0_0"), F.col("f1_0"), F.col(a), F.col(b)) / F.lit(float(BITS))
    return out.select(
        F.when(~F.col("no_id"), F.col("d")).alias("doc_id"),
        F.col("n").alias("n_chars"),
        F.col("sha").alias("edited_sha256"),
        shown(F.col("f0_0"), F.col("f1_0")).alias("fingerprint"),
        shown(F.col("f0_1"), F.col("f1_1")).alias("edited_fingerprint"),
        near("f0_1", "f1_1").alias("near_edited"),
        near("g0", "g1").alias("near_next"),
        "n_within_radius",
        "nearest_doc",
        "nearest_bits",
        F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))).alias("copy"),
    ).drop("copy")
