"""Operator 9: near duplicates by Order MinHash, verified by alignment.

Texts with the same words are one node.  A node's sketch has several entries; each
takes the smallest few of its occurrence-labelled words under a hash of its
own and keeps them in text order, so entries agree when the texts share the
words *and* their order.  Nodes that share an entry form a bucket.  A bucket
isn't expanded into pairs: each member is compared with one leader, first with the
one that it shares most entries with.  In buckets of up to SMALL nodes that still hold
several classes afterwards, the members of different classes are compared.  A larger bucket
comes from a passage or words that many texts share: its members are compared with its leader,
similar ones meet in the buckets of their other entries, and the members that are of different
classes even then are compared last, all with one another, in blocks that return no pairs but
one link for two classes that they find to be one.  A comparison is an exact alignment of the two word
sequences; links need an edit similarity of 0.8 or more.  Pairs that lengths or word
parities rule out for certain are never aligned, and texts are fetched only for the
others.  Classes are the connected components of the links.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, table

#: Words of a k-mer, entries of a sketch, k-mers of an entry.
K, ENTRIES, SIZE = 1, 40, 5
#: Texts of up to so many words have further entries, with fewer words each: at a
#: similarity of 0.8 too few common words are left for the entries of all texts.
SHORT, SHORT_ENTRIES, SHORT_SIZE = 16, 16, 2
#: Nodes of a bucket whose members are compared with one another before those of larger ones, at most.
SMALL = 32
#: Nodes of a block, about: two blocks of a larger bucket are compared by one task.
BLOCK = 256
SIMILARITY = 0.8
PARITY = 16
#: Links that one task follows to their end; more are contracted by joins until no more are left.
FEW_LINKS = 100_000
#: Numbers that tell how often the words of a text occur, by a hash of the word.
COUNTS = 1024
#: Nodes whose texts are fetched through a broadcast of their hashes; more are fetched by a join.
BROADCAST_NODES = 500_000

_A, _B, _P = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_SEEDS = _mix(np.arange(1, ENTRIES + 1, dtype=np.uint64) * _P)


def sketch(words: np.ndarray, k: int = K, size: int = SIZE) -> np.ndarray:
    """Order MinHash of a sequence of word hashes: ``ENTRIES`` longs, none for no words.

    A sequence of fewer than ``k`` words is one k-mer.  One of up to ``SHORT`` words
    has ``SHORT_ENTRIES`` longs more."""
    n = len(words)
    if not n:
        return np.zeros(0, np.int64)
    w = np.asarray(words).astype(np.int64).astype(np.uint64)
    k = min(k, n)
    h = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        h = h * _P + _mix(w[i : n - k + 1 + i] + np.uint64(i + 1))
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if not new.all():  # the label: how often the k-mer has occurred before
        first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
        label = np.empty(len(h), np.uint64)
        label[order] = (np.arange(len(h)) - first).astype(np.uint64)
        h = h + label * _B
    h = _mix(h)
    draws = _mix(h[None, :] ^ _SEEDS[:, None])
    out = _entries(h, draws, _SEEDS, size)
    if n <= SHORT:
        out = np.concatenate([out, _entries(h, draws[:SHORT_ENTRIES], _mix(_SEEDS[:SHORT_ENTRIES]), SHORT_SIZE)])
    return out.astype(np.int64)


def _entries(h: np.ndarray, draws: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` least k-mers of each row of ``draws``, in text order."""
    size = min(size, len(h))
    least = np.sort(np.argpartition(draws, size - 1, axis=1)[:, :size], axis=1)
    out = seeds.copy()
    for j in range(size):
        out = _mix(out * _P + h[least[:, j]])
    return out


def parity(words: np.ndarray) -> np.ndarray:
    """``PARITY`` longs of bits; each tells whether the words that hash to it are odd in number.

    An edit flips two bits at most, so texts with more than twice as many differing
    bits as edits allowed can't be linked."""
    at = _mix(np.asarray(words).astype(np.int64).astype(np.uint64) + _P) % np.uint64(64 * PARITY)
    odd = (np.bincount(at.astype(np.int64), minlength=64 * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def fine_parity(words: np.ndarray) -> np.ndarray:
    """Like ``parity``, with 3.4 to 6.8 bits a word (a power of two of 1024), so that it tells long texts
    apart too.  The halves of a longer one, bit by bit, make the one of half the length."""
    bits = 64 * PARITY
    while bits < 3.4 * len(words):
        bits *= 2
    at = _mix(np.asarray(words).astype(np.int64).astype(np.uint64) + _P) % np.uint64(bits)
    odd = (np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def differing_bits(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two fine parities differ, at the shorter one's length."""
    while len(a) != len(b):
        longer = a if len(a) > len(b) else b
        half = longer[: len(longer) // 2] ^ longer[len(longer) // 2 :]
        a, b = (half, b) if len(a) > len(b) else (a, half)
    return int(np.bitwise_count((a ^ b).astype(np.uint64)).sum())  # of signed numbers numpy counts the absolute value


def edit_distances(pairs: list[tuple[np.ndarray, np.ndarray]], most: list[int]) -> list[int]:
    """Edit distance of each pair where it is at most the pair's bound, else bound + 1.

    Ends that are equal are cut off, pairs whose common words are too few are
    given up at once, and the rest are aligned."""
    out = [0] * len(pairs)
    open_: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, (a, b) in enumerate(pairs):
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[:n] != b[:n])
        start = int(differ[0]) if len(differ) else n
        a, b = a[start:], b[start:]
        n = min(len(a), len(b))
        differ = np.flatnonzero(a[::-1][:n] != b[::-1][:n])
        end = int(differ[0]) if len(differ) else n
        a, b = a[: len(a) - end], b[: len(b) - end]
        if not len(a) or not len(b):
            out[i] = min(max(len(a), len(b)), most[i] + 1)
            continue
        counts = Counter(a.tolist())
        counts.subtract(Counter(b.tolist()))
        surplus = sum(v for v in counts.values() if v > 0)
        lack = -sum(v for v in counts.values() if v < 0)
        if max(surplus, lack) > most[i]:
            out[i] = most[i] + 1
            continue
        open_.append((i, a, b))
    for i, a, b in open_:
        out[i] = _aligned(a.tolist(), b.tolist(), most[i])
    return out


def _aligned(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences, or ``most`` + 1 where it is more.

    Myers' bit-parallel table: integers of len(a) bits hold a column's rises and falls."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    rise, fall, cost, left = full, 0, len(a), len(b)
    for y in b:
        equal = places.get(y, 0)
        v = equal | fall
        h = (((equal & rise) + rise) ^ rise) | equal
        up, down = fall | (full & ~(h | rise)), rise & h
        left -= 1
        if up & last:
            cost += 1
            if cost - left > most:
                return most + 1
        elif down & last:
            cost -= 1
        up, down = (up << 1 | 1) & full, (down << 1) & full
        rise, fall = down | (full & ~(v | up)), up & v
    return min(cost, most + 1)


def similar(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> list[bool]:
    """Whether 1 - edit distance / longer length is ``least`` or more, for each pair."""
    most = [int(np.floor((1 - least) * max(len(a), len(b)) + 1e-9)) for a, b in pairs]
    return [d <= t for d, t in zip(edit_distances(pairs, most), most, strict=True)]


def word_counts(words: np.ndarray) -> np.ndarray:
    """``COUNTS`` numbers of words, by a hash of the word.

    An edit takes one word at most and adds one at most, so texts can't be linked where one has more
    words beyond the other's, number by number, than edits are allowed.  Tells texts of few distinct
    words apart, whose parities differ in few bits."""
    at = _mix(np.asarray(words).astype(np.int64).astype(np.uint64) + _P) % np.uint64(COUNTS)
    return np.bincount(at.astype(np.int64), minlength=COUNTS)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _read(df: DataFrame, id_column: str) -> DataFrame:
    """id, text hash ``th``, words and the key of equal texts."""
    rows = df.select(F.col(id_column).alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    rows = rows.select("id", F.xxhash64("text").alias("th"), "text", _words(F.col("text")).alias("w"))
    same = F.when(F.size("w") > 0, F.md5(F.array_join("w", " ").cast("binary"))).otherwise(F.concat(F.lit("-"), F.md5(F.col("text").cast("binary"))))
    return rows.select("id", "th", same.alias("same"), F.transform("w", lambda x: F.hash(x)).alias("w"))


def _links(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of ``pairs`` whose texts are similar, written.

    Fine parities, a tenth of the texts, meet first; texts move only for pairs that these let be
    similar.  Joins have no aggregation in their stage, so the adaptive join splits a leader with
    very many members over tasks."""

    @F.pandas_udf("array<long>")
    def fine(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in batches:
            yield pd.Series([fine_parity(w) for w in part])

    @F.pandas_udf("boolean")
    def may(fa: pd.Series, fb: pd.Series, most: pd.Series) -> pd.Series:
        return pd.Series([differing_bits(x, y) <= m for x, y, m in zip(fa, fb, most, strict=True)], dtype=bool)

    marks = checkpointed(words.select("node", F.size("w").alias("n"), fine("w").alias("f")))
    near = pairs.select("a", "b").join(marks.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("f").alias("fb")), "b")
    near = near.join(marks.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("f").alias("fa")), "a")
    most = (2 * F.floor((1 - least) * F.greatest("na", "nb") + 1e-9)).cast("long")
    near = checkpointed(near.where(may("fa", "fb", most)).select("a", "b"))
    both = near.join(words.select(F.col("node").alias("b"), F.col("w").alias("wb")), "b")
    both = both.join(words.select(F.col("node").alias("a"), F.col("w").alias("wa")), "a")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.iloc[low : low + 512]
                good = similar(list(zip(part["wa"], part["wb"], strict=True)), least)
                yield part.loc[good, ["a", "b"]]

    return checkpointed(both.select("a", "b", "wa", "wb").mapInPandas(verify, "a long, b long"))


def _can(n: str, m: str, least: float) -> Column:
    """Lengths that leave room for a link: d is at least the difference in length."""
    return F.least(n, m) + 1e-9 >= least * F.greatest(n, m)


def _bits(prefix: str) -> list[Column]:
    return [F.col(f"{prefix}{i}") for i in range(PARITY)]


def _apart(p: list[Column], q: list[Column]) -> Column:
    return sum((F.bit_count(x.bitwiseXOR(y)) for x, y in zip(p[1:], q[1:], strict=True)), F.bit_count(p[0].bitwiseXOR(q[0])))


def _may_link(apart: Column, n: str, m: str, least: float) -> Column:
    return apart <= 2 * F.floor((1 - least) * F.greatest(n, m) + 1e-9)


def _buckets(entries: DataFrame) -> DataFrame:
    """(key, node, n, a, an, times) of the rows (key, node, n) whose key has several, written;
    ``a`` is the leader, the key's smallest node.  Keys are counted before they are shuffled."""
    leaders = entries.groupBy("key").agg(F.min(F.struct("node", "n")).alias("l"), F.count("*").alias("times")).where("times > 1")
    return checkpointed(entries.join(leaders.select("key", F.col("l.node").alias("a"), F.col("l.n").alias("an"), "times"), "key"))


def _leader_pairs(buckets: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(a, b, shared): leaders and members that lengths and parities let be similar, with the number of
    entries that they share, written."""
    pairs = buckets.where("node <> a").where(_can("n", "an", least)).groupBy("a", F.col("node").alias("b"), "n", "an").agg(F.count("*").alias("shared"))
    side = lambda name, to: held.select(F.col("node").alias(name), *[F.col(f"p{i}").alias(f"{to}{i}") for i in range(PARITY)])
    both = pairs.join(side("b", "q"), "b").join(side("a", "p"), "a")
    return checkpointed(both.where(_may_link(_apart(_bits("p"), _bits("q")), "n", "an", least)).select("a", "b", "shared"))


def _apart_in(pairs: DataFrame, roots: DataFrame | None) -> DataFrame:
    """The pairs whose ends are in different classes."""
    if roots is None:
        return pairs
    ends = pairs.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
    ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    return ends.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def _mixed(buckets: DataFrame, roots: DataFrame | None) -> DataFrame:
    """(key, node, n, times, root, in_main) of the buckets that hold several classes, written.

    ``in_main`` marks the members of a bucket's largest class."""
    placed = buckets.select("key", "node", "n", "times").withColumn("root", F.col("node"))
    if roots is not None:
        placed = placed.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    sizes = placed.groupBy("key", "root").count().groupBy("key").agg(F.max_by("root", F.struct("count", "root")).alias("main"), F.count("*").alias("classes"))
    mixed = placed.join(sizes.where("classes > 1").select("key", "main"), "key")
    return checkpointed(mixed.select("key", "node", "n", "times", "root", (F.col("root") == F.col("main")).alias("in_main")))


def _open_pairs(mixed: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """(a, b), a < b: all pairs of the buckets whose classes differ, without those that lengths or
    parities rule out for certain.

    One side of such a pair is outside the bucket's largest class, so a group of copies
    meets only the others, not itself."""
    rows = checkpointed(mixed.join(held.drop("n"), "node"))
    x, y = rows.where("not in_main").alias("x"), rows.alias("y")
    open_ = (F.col("x.key") == F.col("y.key")) & (F.col("x.root") != F.col("y.root")) & (F.col("y.in_main") | (F.col("x.node") < F.col("y.node")))
    open_ = open_ & _can("x.n", "y.n", least) & _may_link(_apart(_bits("x.p"), _bits("y.p")), "x.n", "y.n", least)
    return x.join(y, open_).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _block_rows(mixed: DataFrame, held: DataFrame) -> DataFrame:
    """(meeting, block, node, n, root, keys, parity): the members of the buckets, once for each ``meeting``,
    the array of a bucket's key and two of its blocks, which one task compares.

    A bucket's first blocks hold the members outside its largest class, the others that class, whose
    blocks don't meet one another; ``keys`` are all buckets of the node.  As an array, a meeting isn't
    dealt by the bucket's key alone."""
    outside = F.count_if(~F.col("in_main"))
    sizes = mixed.groupBy("key").agg(F.ceil(outside / BLOCK).alias("first"), F.ceil(F.count_if("in_main") / BLOCK).alias("rest"))
    known = mixed.groupBy("node").agg(F.collect_set("key").alias("keys"))
    parity = held.select("node", F.array(*_bits("p")).alias("parity"))
    rows = mixed.select("key", "node", "n", "root", "in_main").join(known, "node").join(parity, "node").join(sizes, "key")
    number = lambda of: F.pmod(F.xxhash64("node"), F.col(of))
    rows = rows.withColumn("block", F.when(F.col("in_main"), F.col("first") + number("rest")).otherwise(number("first")))
    last = F.when(F.col("in_main"), F.col("first")).otherwise(F.col("first") + F.col("rest")) - 1
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    meeting = F.array("key", F.least("block", "_other"), F.greatest("block", "_other")).alias("meeting")
    return rows.select(meeting, "block", "node", "n", "root", "keys", "parity")


def _block_pairs(key: int, x: pd.DataFrame, y: pd.DataFrame, least: float) -> Iterator[tuple[int, np.ndarray]]:
    """Each row of ``x`` and the rows of ``y`` that it may be linked with: of other classes, in no bucket together
    that has a smaller key, where they meet too, and not ruled out by lengths or parities.

    Of one block, ``x`` and ``y`` being the same, every pair comes once."""
    n, root, bits = y["n"].to_numpy(), y["root"].to_numpy(), np.stack(y["parity"].to_numpy()).view(np.uint64)
    before = [k[k < key] for k in map(np.asarray, y["keys"])]
    earlier = np.full((len(y), max(map(len, before)) + 1), key)
    for row, k in zip(earlier, before, strict=True):
        row[: len(k)] = k
    for i, (size, own, keys, parity_) in enumerate(zip(x["n"], x["root"], x["keys"], x["parity"], strict=True)):
        at = np.arange(i + 1 if x is y else 0, len(y))
        longer = np.maximum(n[at], size)
        at = at[(root[at] != own) & (np.minimum(n[at], size) + 1e-9 >= least * longer)]
        keys = np.asarray(keys)
        at = at[~np.isin(earlier[at], keys[keys < key]).any(axis=1)]
        most = np.floor((1 - least) * np.maximum(n[at], size) + 1e-9)
        yield i, at[np.bitwise_count(bits[at] ^ np.asarray(parity_).view(np.uint64)).sum(axis=1) <= 2 * most]


def _sides(part: pd.DataFrame) -> tuple[int, pd.DataFrame, pd.DataFrame]:
    """The key and the two blocks of a meeting."""
    key, low, high = part["meeting"].iloc[0]
    x = part[part["block"] == low].reset_index(drop=True)
    return key, x, x if low == high else part[part["block"] == high].reset_index(drop=True)


def _block_open(rows: DataFrame, least: float) -> DataFrame:
    """The rows of ``_block_rows`` that may be linked with another of their two blocks, written."""

    def open_(part: pd.DataFrame) -> pd.DataFrame:
        key, x, y = _sides(part)
        found: set[int] = set()
        if len(x) and len(y):
            for i, partners in _block_pairs(key, x, y, least):
                if len(partners):
                    found.add(x["node"][i])
                    found.update(y["node"].to_numpy()[partners])
        return part[part["node"].isin(found)]

    return checkpointed(rows.groupBy("meeting").applyInPandas(open_, rows.schema))


def _block_links(rows: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(a, b): of the classes between which the rows of ``_block_rows`` have links, links that join them, written.

    Two blocks give fewer links than they have classes: what joins classes that are joined already isn't
    aligned."""

    def joined(part: pd.DataFrame) -> pd.DataFrame:
        key, x, y = _sides(part)
        links: list[tuple[int, int]] = []
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while c in up:
                c = up[c]
            return c

        if len(x) and len(y):
            counts = np.stack([word_counts(w) for w in y["w"]])
            for i, partners in _block_pairs(key, x, y, least):
                if not len(partners):
                    continue
                more = counts[partners] - word_counts(x["w"][i])
                most = np.floor((1 - least) * np.maximum(y["n"].to_numpy()[partners], x["n"][i]) + 1e-9)
                partners = partners[np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1)) <= most]
                for j in partners.tolist():
                    c, d = top(x["root"][i]), top(y["root"][j])
                    if c != d and similar([(x["w"][i], y["w"][j])], least)[0]:
                        up[max(c, d)] = min(c, d)
                        links.append((x["node"][i], y["node"][j]))
        return pd.DataFrame(links, columns=["a", "b"], dtype=np.int64)

    return checkpointed(rows.join(words, "node").groupBy("meeting").applyInPandas(joined, "a long, b long"))


def _followed(links: DataFrame) -> DataFrame:
    """(node, root) of few links, in one task."""

    def roots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        up: dict[int, int] = {}

        def top(c: int) -> int:
            while up.setdefault(c, c) != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for batch in batches:
            for a, b in zip(batch["a"].tolist(), batch["b"].tolist(), strict=True):
                x, y = top(a), top(b)
                up[max(x, y)] = min(x, y)
        yield pd.DataFrame({"node": list(up), "root": [top(c) for c in list(up)]}, dtype=np.int64)

    return checkpointed(links.select("a", "b").coalesce(1).mapInPandas(roots, "node long, root long"))


def _moved(roots: DataFrame, top: DataFrame) -> DataFrame:
    """``roots`` with each root that is a node of ``top`` replaced by its root there."""
    moved = top.select(F.col("node").alias("root"), F.col("root").alias("_top"))
    return roots.join(moved, "root", "left").select("node", F.coalesce("_top", "root").alias("root"))


def components(links: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the component, for nodes with a link.

    As long as there are many links, every round points each node at its smallest neighbour or itself,
    follows the pointer once more, and contracts the links to what is pointed at; links inside a
    contracted node go.  The smallest node of a component points at itself throughout,
    and the links shrink every round.  Few links are followed by one task, as each round is many jobs,
    of which the driver keeps a record.  Joins stand apart from
    aggregations, so the adaptive join splits nodes with very many links."""
    links = checkpointed(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    roots = None
    while links.count() > FEW_LINKS:
        ends = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        point = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("up"))
        point = checkpointed(point)
        upper = point.select(F.col("node").alias("up"), F.col("up").alias("root"))
        point = checkpointed(point.join(upper, "up").select("node", "root"))
        roots = point if roots is None else checkpointed(_moved(roots, point))
        low = point.select(F.col("node").alias("a"), F.col("root").alias("x"))
        high = point.select(F.col("node").alias("b"), F.col("root").alias("y"))
        apart = links.join(low, "a").join(high, "b").where("x <> y")
        links = checkpointed(apart.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")))
        links = checkpointed(links.distinct())
    top = _followed(links)
    return top if roots is None else checkpointed(_moved(roots, top))


def _joined(roots: DataFrame | None, more: DataFrame) -> DataFrame:
    """``roots`` with the classes joined that the links ``more`` hold together."""
    if roots is None:
        return components(more)
    ends = more.join(roots.select(F.col("node").alias("a"), F.col("root").alias("_ra")), "a", "left")
    ends = ends.join(roots.select(F.col("node").alias("b"), F.col("root").alias("_rb")), "b", "left")
    top = components(ends.select(F.coalesce("_ra", "a").alias("a"), F.coalesce("_rb", "b").alias("b")))
    return checkpointed(_moved(roots, top).unionByName(top.join(roots.select("node"), "node", "left_anti")))


def classes(df: DataFrame, id_column: str = "doc_id", least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """(nodes, documents): ``nodes`` has ``same``, ``rep`` (no_id, id, th: the class's
    document) and ``class_id``; ``documents`` has id, th and same of every row.

    Texts with equal words are one node; texts without words are equal only as a
    whole, null being the empty text.  A class is named by its smallest id, null if
    none of its rows has one; repeated rows and ids are in the class of their text.
    Other columns are not read; an empty table gives no rows.
    Candidates come from hashing: two texts that share a portion j of their words
    in order miss each other with a probability near (1 - j^5)^40.  At a similarity
    of 0.8 by replaced words j is 2/3, which makes 0.004.  All that share an entry are
    compared, however many do, unless they are in one class already: the pairs of a passage's
    texts cost time, with the square of their number, but no row.
    """

    @F.pandas_udf("entries array<long>, parity array<long>")
    def sketched(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for words in batches:
            yield pd.DataFrame({"entries": [sketch(w) for w in words], "parity": [parity(w) for w in words]})

    rows = _read(df, id_column)
    rep = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "th")).alias("rep")
    nodes = rows.select("id", "th", "same", F.size("w").alias("n"), sketched("w").alias("s"))
    nodes = nodes.groupBy("same").agg(rep, F.max("n").alias("n"), F.first("s").alias("s")).select("same", "rep", "n", "s.*")
    nodes = checkpointed(nodes.withColumn("node", F.monotonically_increasing_id()))
    key = F.xxhash64("i", "e").alias("key")
    buckets = _buckets(nodes.select("node", "n", F.posexplode("entries").alias("i", "e")).select("node", "n", key))
    held = nodes.join(buckets.select("node").distinct(), "node", "left_semi")
    held = checkpointed(held.select("node", "n", *[F.get("parity", F.lit(i)).alias(f"p{i}") for i in range(PARITY)]))
    where = nodes.select("node", F.col("rep.id").alias("_id"), F.col("rep.th").alias("_th"))

    def words_of(wanted: DataFrame) -> DataFrame:
        """(node, w) of the nodes ``wanted``, written: read from the documents that stand for them."""
        wanted = checkpointed(where.join(wanted.distinct(), "node"))
        n = wanted.count()
        here = (F.xxhash64("_text") == F.col("_th")) & F.col("_doc").eqNullSafe(F.col("_id"))
        texts = df.select(F.col(id_column).alias("_doc"), F.coalesce(F.col("text"), F.lit("")).alias("_text"))
        found = texts.join(F.broadcast(wanted) if n <= BROADCAST_NODES else wanted, here)
        found = checkpointed(found.select("node", F.transform(_words(F.col("_text")), lambda x: F.hash(x)).alias("w")))
        return checkpointed(found.dropDuplicates(["node"])) if found.count() > n else found  # where rows repeat

    ends = lambda pairs: pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node")))
    # each member with the leader that it shares most entries with
    pairs = _leader_pairs(buckets, held, least)
    words = words_of(ends(pairs))
    first = pairs.groupBy("b").agg(F.max(F.struct("shared", (-F.col("a")).alias("m"))).alias("best")).select((-F.col("best.m")).alias("a"), "b")
    links = _links(first, words, least)
    roots = components(links) if links.limit(1).count() else None
    # then with the other leaders, and members of small buckets with one another, where classes differ
    mixed = _mixed(buckets.where(F.col("times") <= SMALL), roots)
    wanted = _open_pairs(mixed, held, least).unionByName(pairs.select("a", "b"))
    wanted = checkpointed(_apart_in(wanted.distinct(), roots))
    fetched = lambda found: words.unionByName(words_of(found.distinct().join(words.select("node"), "node", "left_anti")))
    if wanted.limit(1).count():
        words = fetched(ends(wanted))
        more = _links(wanted, words, least)
        if more.limit(1).count():
            roots = _joined(roots, more)
    # and last all members of large buckets, where classes still differ
    mixed = _mixed(buckets.where(F.col("times") > SMALL), roots)
    if mixed.limit(1).count():
        left = _block_open(_block_rows(mixed, held), least)
        if left.limit(1).count():
            more = _block_links(left, fetched(left.select("node")), least)
            if more.limit(1).count():
                roots = _joined(roots, more)

    named = nodes.select("same", "rep", "node")
    if roots is not None:
        named = named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        named = named.withColumn("root", F.col("node"))
    top = checkpointed(named.groupBy("root").agg(F.min("rep").alias("rep")))
    out = named.drop("rep", "node").join(top, "root").select("same", "rep", F.col("rep.id").alias("class_id"))
    return out, rows.select("id", "th", "same")


def op9_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, named by its smallest id."""
    nodes, rows = classes(table(spark, sf_dir, "documents"))
    return rows.join(nodes, "same").select(F.col("id").alias("doc_id"), "class_id")


def one_of_each(df: DataFrame, id_column: str = "doc_id", least: float = SIMILARITY) -> DataFrame:
    """The rows of ``df`` that stand for their classes: the smallest id of each (a null
    id if it has no other), one row where that id and text repeat."""
    nodes, _ = classes(df, id_column, least)
    kept = nodes.select("rep.id", "rep.th").distinct().select(F.col("id").alias("_id"), F.col("th").alias("_th"))
    named = df.withColumn("_text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    repeated = df.groupBy(F.col(id_column), F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).count().where("count > 1").limit(1).count()
    if repeated:
        named = named.dropDuplicates([id_column, "_text_hash"])
    return named.join(kept, (F.col("_text_hash") == F.col("_th")) & F.col(id_column).eqNullSafe(F.col("_id")), "left_semi").drop("_text_hash")
