"""Operator 4: harmonic packing of token sequences.

A document's ids are cut by the binary digits of its length: full sequences
first, then one piece for each power of two in the rest.  The piece lengths are
the reciprocal-capacity classes 2048/1, 2048/2, 2048/4 ... and a bin of class
2048/k takes exactly k pieces, so every closed bin is full.  Each task fills its
own bins and needs neither a shuffle nor another task; the one open bin of a class
is split, when the task's rows end, into sequences whose lengths are powers of
two, which take no padding either.  A task holds 11 open bins at most.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tokenizer_file

CAPACITY = 2048
END_ID = 1
SLICE = 256

PIECES = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _byte_of() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level BPE files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """A fast encoder over the vocabulary of a ``tokenizers`` byte-level BPE file.

    Ids in such a file follow the order of its merges, so they serve as ranks.
    ``encode_ordinary`` takes strings of added tokens inside a text as ordinary text;
    ``encode`` with all special tokens allowed gives their ids, as the library does.
    """
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    byte = _byte_of()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def cuts(n: int, capacity: int = CAPACITY) -> list[int]:
    """Piece lengths of a document with ``n`` ids, in order; ``capacity`` is a power of two."""
    out = [capacity] * (n // capacity)
    rest = n % capacity
    bit = capacity >> 1
    while bit:
        if rest & bit:
            out.append(bit)
        bit >>= 1
    return out


class Bins:
    """The open bins of one task, one a class; ``base`` keeps its sequence ids apart."""

    def __init__(self, base: int, capacity: int = CAPACITY):
        self.capacity, self.next, self.open = capacity, base, {}

    def add(self, piece: tuple, length: int) -> Iterator[tuple]:
        """Takes a piece; yields (piece, sequence, offset) for a bin that is now full."""
        held = self.open.setdefault(length, [])
        held.append(piece)
        if len(held) * length == self.capacity:
            yield from self._close(length, held)
            self.open[length] = []

    def rest(self) -> Iterator[tuple]:
        for length, held in sorted(self.open.items(), reverse=True):
            at = 0
            for take in cuts(len(held), self.capacity):
                yield from self._close(length, held[at : at + take])
                at += take
        self.open = {}

    def _close(self, length: int, held: list) -> Iterator[tuple]:
        for i, piece in enumerate(held):
            yield piece, self.next, i * length
        self.next += 1


def pack(df: DataFrame, id_column: str = "doc_id", capacity: int = CAPACITY, end_id: int = END_ID, path: str | None = None, added_tokens: bool = False) -> DataFrame:
    """Pieces of all documents of ``df`` (``id_column``, ``text``) in sequences of ``capacity`` ids.

    Adds ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit),
    ``doc_tokens``, ``sequence_id`` and ``offset``.  A null or empty text has the
    end id alone.  With ``added_tokens``, strings of the file's added tokens inside a
    text have the ids of those tokens, as by the library's default; else they are
    ordinary text.  Repeated rows and repeated or null ids are documents of their
    own.  Other columns of ``df`` are dropped; an empty table gives no rows.
    A task that runs again gives the same sequence ids, as they follow from its
    number and its rows.
    """
    path = path or tokenizer_file("byte_bpe_50k.json")
    id_type = df.schema[id_column].dataType
    schema = f"{id_column} {id_type.simpleString()}, {PIECES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = functools.partial(encoder(path).encode, allowed_special="all") if added_tokens else encoder(path).encode_ordinary
        bins = Bins(TaskContext.get().partitionId() << 36, capacity)
        names = [id_column, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
        kind = None
        done: list[tuple] = []

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*((*piece, sequence, offset) for piece, sequence, offset in rows), strict=True))
            types = [kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

        for given in batches:
            kind = given.schema.field(0).type
            for low in range(0, given.num_rows, SLICE):
                part = given.slice(low, SLICE)
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                    at = 0
                    for length in cuts(len(ids), capacity):
                        done.extend(bins.add((key, at, length, ids[at : at + length].tobytes(), len(ids)), length))
                        at += length
                if len(done) >= SLICE:
                    yield batch(done)
                    done = []
        done.extend(bins.rest())
        if done:
            yield batch(done)

    return df.select(id_column, "text").mapInArrow(run, schema)


def op4_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed to 2048 ids; ids leave as checksums."""
    return digest(pack(table(spark, sf_dir, "documents"), added_tokens=True))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
