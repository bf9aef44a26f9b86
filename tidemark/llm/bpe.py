"""Operator 2: byte-level BPE of whole texts through a global distinct-word shuffle.

Texts are dealt into blocks.  A block's distinct pre-tokens go, by a hash of the
word, to the task that holds all copies of a word; there each distinct word is
encoded once, and its ids go back to the blocks that asked.  A block then lays
the ids out by the words' positions and decodes them through the table of
token bytes.  Words travel as one compressed list for each (block, word range)
instead of a row for each word and position: rows would be several times the text (a
block of 33 MB holds 440,000 distinct words).  So what is shuffled beside the texts is a
small part of them, and a word that a third of all texts hold costs one entry a block.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import json
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_file

#: Bytes of text that a block holds, about; blocks bound what one task keeps in memory.
BLOCK_BYTES = 16 << 20
#: Distinct words for which a word range is meant, and the growth of their number with the text
#: (Heaps' law): WORDS_AT distinct words in BYTES_AT bytes, more by the power GROWTH.
RANGE_WORDS, WORDS_AT, BYTES_AT, GROWTH = 1 << 17, 440_000, 33e6, 0.6
#: Blocks up to this number are named so that each falls into a partition of its own.
NAMED = 4096


@functools.lru_cache(maxsize=2)
def vocabulary(path: str):
    """(encoder of one pre-token, token bytes by id) of a rank file."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    encoding = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoding.encode_ordinary, {rank: token for token, rank in ranks.items()}


@functools.lru_cache(maxsize=1)
def splitter() -> Callable[[str], list[str]]:
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN).findall


def _range_of(word: str, n: int) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) % n


def _by_range(words, n: int) -> dict[int, list[str]]:
    """Distinct pre-tokens in sorted order, by word range."""
    found: dict[int, list[str]] = {}
    for word in sorted(words):
        found.setdefault(_range_of(word, n), []).append(word)
    return found


def n_ranges_for(size: int, parallel: int) -> int:
    """Number of word ranges for ``size`` bytes of text: it grows with the distinct words."""
    return max(parallel, math.ceil(WORDS_AT * (size / BYTES_AT) ** GROWTH / RANGE_WORDS))


def block_names(spark: SparkSession, n: int) -> list[int]:
    """``n`` numbers that hash partitioning deals to ``n`` different partitions."""
    found = spark.range(n * (4 + 2 * n.bit_length())).select(F.col("id").cast("int").alias("name"))
    found = found.groupBy(F.pmod(F.hash("name"), F.lit(n)).alias("at")).agg(F.min("name").alias("name"))
    names = {r["name"] for r in found.collect()}
    spare = (i for i in range(1 << 30, 1 << 31) if i not in names)
    return sorted(names) + [next(spare) for _ in range(n - len(names))]


def encode_and_decode(df: DataFrame, id_column: str = "doc_id", path: str | None = None, emit: str = "digests", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Ids of every text of ``df`` (``id_column``, ``text``), and the bytes they decode to.

    ``emit="digests"`` gives ``n_tokens`` long, ``ids_sha256`` and ``decoded_sha256``;
    ``emit="ids"`` gives ``n_tokens``, ``ids`` array<int> and ``decoded`` binary.
    Null and empty texts have no ids.  Rows are independent of one another: repeated
    rows and null or repeated ids stay as they are.  Other columns are dropped; an
    empty table gives no rows.
    """
    path = path or tokenizer_file("byte_bpe_50k.tiktoken")
    kind = df.schema[id_column].dataType.simpleString()
    rows = df.select(F.col(id_column).alias("key"), "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    spark = rows.sparkSession
    n_blocks = max(spark.sparkContext.defaultParallelism, -(-size // block_bytes))
    n_ranges = n_ranges_for(size, spark.sparkContext.defaultParallelism)
    code = "<u2" if max(vocabulary(path)[1]) < 1 << 16 else "<u4"
    block = F.pmod(F.xxhash64("key", F.crc32(F.col("text").cast("binary"))), F.lit(n_blocks)).cast("int")
    if n_blocks <= NAMED:
        block = F.element_at(F.array(*[F.lit(x) for x in block_names(spark, n_blocks)]), block + 1)
    # beyond, many blocks share a partition, which evens them out
    texts = rows.withColumn("block", block).repartition(n_blocks if n_blocks <= NAMED else max(NAMED, n_blocks // 16), "block")

    def ask(given: pa.Table) -> pa.Table:
        number = given.column("block")[0].as_py()
        split, words = splitter(), set()
        for text in given.column("text"):
            words.update(split(text.as_py() or ""))
        found = _by_range(words, n_ranges)
        return pa.table(
            {
                "range": pa.array(list(found), pa.int32()),
                "block": pa.array([number] * len(found), pa.int32()),
                "words": pa.array([zlib.compress(json.dumps(w).encode(), 1) for w in found.values()], pa.binary()),
            }
        )

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # holds the distinct words of the task's ranges, not the requests
        encode, _ = vocabulary(path)
        known: dict[str, list[int]] = {}
        for given in batches:
            out = []
            for packed in given.column("words"):
                flat: list[int] = []
                for word in json.loads(zlib.decompress(packed.as_py())):
                    ids = known.get(word)
                    if ids is None:
                        ids = known[word] = encode(word)
                    flat.append(len(ids))
                    flat.extend(ids)
                out.append(zlib.compress(np.array(flat, code).tobytes(), 1))
            yield pa.RecordBatch.from_arrays([given.column("range"), given.column("block"), pa.array(out, pa.binary())], names=["range", "block", "ids"])

    def assemble(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return out_table([], [])
        _, token = vocabulary(path)
        split = splitter()
        same: dict[str, str] = {}  # one object for each word, so positions cost a pointer
        texts = []
        for text in docs.column("text"):
            pieces = split(text.as_py() or "")
            texts.append(list(map(same.setdefault, pieces, pieces)))
        words = _by_range(same, n_ranges)
        first: dict = {}  # of each word: its ids as text (digests) or as they are
        back: dict[str, bytes] = {}
        for number, packed in zip(answers.column("range").to_pylist(), answers.column("ids"), strict=True):
            flat = np.frombuffer(zlib.decompress(packed.as_py()), code).tolist()
            at = 0
            for word in words.pop(number):
                end = at + 1 + flat[at]
                ids = flat[at + 1 : end]
                first[word] = ids if emit == "ids" else " ".join(map(str, ids))
                back[word] = b"".join([token[x] for x in ids])
                at = end
        found = []
        for pieces in texts:
            decoded = b"".join([back[w] for w in pieces])
            if emit == "ids":
                flat = [x for w in pieces for x in first[w]]
                found.append((len(flat), flat, decoded))
            else:
                line = " ".join([first[w] for w in pieces])
                n = line.count(" ") + 1 if line else 0
                found.append((n, hashlib.sha256(line.encode()).hexdigest(), hashlib.sha256(decoded).hexdigest()))
        return out_table(docs.column("key"), found)

    names = ("ids", "decoded") if emit == "ids" else ("ids_sha256", "decoded_sha256")
    types = (pa.list_(pa.int32()), pa.binary()) if emit == "ids" else (pa.string(), pa.string())
    key_type = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()

    def out_table(keys, found: list) -> pa.Table:
        n, first, second = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({id_column: keys if found else pa.array([], key_type), "n_tokens": pa.array(n, pa.int64()), names[0]: pa.array(first, types[0]), names[1]: pa.array(second, types[1])})

    asked = texts.groupBy("block").applyInArrow(ask, "range int, block int, words binary")
    answered = asked.repartition(n_ranges, "range").mapInArrow(answer, "range int, block int, ids binary")
    columns = "ids array<int>, decoded binary" if emit == "ids" else "ids_sha256 string, decoded_sha256 string"
    return texts.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(assemble, f"{id_column} {kind}, n_tokens long, {columns}")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and round trip of every document, as digests."""
    return encode_and_decode(table(spark, sf_dir, "documents"))
