"""Packing documents into token sequences along a space-filling curve.

A document's hashed words are averaged to a point of few dimensions; the point's place on a Hilbert curve is
its key. Documents are range-partitioned and sorted by (key, doc_id), so that neighbours on the curve, which
share words, share sequences. Each partition cuts its stream of ids into sequences of `size`; what is left at its
end becomes sequences of decreasing powers of two, so that nothing is padded and no partition waits for another.
Equal keys (copies) are split over partitions by doc_id.

Defined cases: a null or empty text is the end id alone; an added token of the tokenizer file, such as an end marker, becomes its own id wherever
a text holds it; texts are read whole; rows that repeat a doc_id are packed row by row;
an empty table gives no pieces; other columns aren't touched.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from functools import partial
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hashing
from .bpe import digest_of
from .common import held, release, small_batches

DIMENSIONS, BITS = 4, 10
PIECE_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
PIECE = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows, dimensions) with coordinates of so many bits.

    From the highest bit down, the curve's cell is reflected and turned for each coordinate; the Gray code of what remains is the place.
    """
    x = x.astype("i8").T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q, low = 1 << b, (1 << b) - 1
        for i in range(n):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], "i8")
    for b in range(bits - 1, 0, -1):
        t ^= np.where(x[n - 1] & (1 << b), (1 << b) - 1, 0)
    x ^= t
    out = np.zeros(x.shape[1], "i8")
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def points(texts: pa.Array) -> np.ndarray:
    """Each text's point in [0, 1) ** DIMENSIONS: the mean of its words' hashed vectors, stretched around the middle."""
    out = np.full((len(texts), DIMENSIONS), 0.5)
    for row, data, offsets in hashing.groups(texts):
        starts, ends, before = hashing.words(data, offsets)
        if not len(starts):
            continue
        h = hashing.word_hashes(data, starts, ends, lower=True)
        n = np.diff(before)
        has = np.flatnonzero(n)
        for d in range(DIMENSIONS):
            v = ((h >> np.uint64(16 * d)) & np.uint64(0xFFFF)).astype("f4") / 32768 - 1
            out[row + has, d] = 0.5 + 0.499 * np.tanh(4 * np.add.reduceat(v, before[:-1][has], dtype="f8") / n[has])
    return out


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        key = hilbert((points(b["text"]) * (1 << BITS)).astype("i8"))
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text"], pa.array(key)], ["doc_id", "text", "key"])


def read_vocabulary(path: str) -> dict[bytes, int]:
    """The vocabulary of a byte-level BPE tokenizer.json as bytes and ids: its characters stand for bytes, printable ones for themselves and the others, in order, for 256 and on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    other = [b for b in range(256) if b not in own]
    byte = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(other)}
    held = json.loads(Path(path).read_text("utf-8"))
    special = {x["content"] for x in held["added_tokens"]}
    return {bytes(byte[c] for c in k): v for k, v in held["model"]["vocab"].items() if k not in special}


def read_added(path: str) -> dict[str, int]:
    """The added tokens of a tokenizer.json. Only plain ones are known here: they are found anywhere in the text and leave what is around them."""
    held = json.loads(Path(path).read_text("utf-8"))["added_tokens"]
    if odd := [x["content"] for x in held if x["single_word"] or x["lstrip"] or x["rstrip"]]:
        raise ValueError(f"added tokens that take part of their surroundings: {odd}")
    return {x["content"]: x["id"] for x in held}


class Splitter:
    """Ids of texts whose added tokens stand for themselves; at one place, the longest counts."""

    def __init__(self, e, added: dict[str, int]):
        self.e, self.added = e, added
        self.dtype = np.dtype("<u4") if max(added.values(), default=0) >= 1 << 16 else e.dtype
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")").split if added else None

    def ids(self, text: str | None) -> np.ndarray:
        if not text or not self.split or len(parts := self.split(text)) == 1:
            return self.e.ids(text)
        return np.concatenate([np.array([self.added[x]], self.dtype) if k % 2 else self.e.ids(x) for k, x in enumerate(parts)])


#: Entries of a worker's lookup table: smaller than that of the tree encoder, as a miss costs less here.
TABLE = 120_000


def encoder(ranks: dict[bytes, int], pattern: str, digest: str | None = None):
    """One per worker process and vocabulary, which its digest names."""
    import tiktoken

    from .bpe import TextEncoder

    def make() -> TextEncoder:
        plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        return TextEncoder(ranks, pattern, encode_text=plain, table=TABLE)

    return held(("packing", digest or digest_of(ranks), pattern), make)


def powers(n: int) -> list[int]:
    """n as decreasing powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Cuts a stream of documents into sequences; holds the ids of one open sequence."""

    def __init__(self, size: int, first_sequence: int):
        self.size, self.next, self.filled = size, first_sequence, 0
        self.open: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple]:
        at = 0
        while at < len(ids):
            part = ids[at : at + self.size - self.filled]
            self.open.append((doc_id, at, part, len(ids)))
            self.filled += len(part)
            at += len(part)
            if self.filled == self.size:
                yield from self._deal([self.size])

    def close(self) -> Iterator[tuple]:
        if self.filled:
            yield from self._deal(powers(self.filled))

    def _deal(self, sizes: list[int]) -> Iterator[tuple]:
        """The open pieces into sequences of these sizes."""
        room, offset = list(sizes), 0
        for doc_id, start, ids, total in self.open:
            while len(ids):
                part = ids[: room[0] - offset]
                yield doc_id, start, len(part), zlib.crc32(part.astype("<u4").tobytes()), total, self.next, offset, part
                ids, start, offset = ids[len(part) :], start + len(part), offset + len(part)
                if offset == room[0]:
                    self.next, offset = self.next + 1, 0
                    room.pop(0)
        self.open, self.filled = [], 0


def _packed(size: int, end_id: int, with_ids: bool, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    ranks, pattern, added, digest = shared.value
    e = Splitter(encoder(ranks, pattern, digest), added)
    packer = Packer(size, TaskContext.get().partitionId() << 40)
    end = np.array([end_id], e.dtype)
    types = [pa.int64()] * 7

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
        if with_ids:
            columns.append(pa.array([r[7].astype("i4") for r in rows], pa.list_(pa.int32())))
        return pa.RecordBatch.from_arrays(columns, [*PIECE, *["ids"] * with_ids])

    for b in batches:
        rows: list[tuple] = []
        for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"], strict=True):
            rows += packer.add(doc_id, np.concatenate([e.ids(text.as_py()), end]))
            if len(rows) >= 2000:
                yield out(rows)
                rows = []
        if rows:
            yield out(rows)
    if rows := list(packer.close()):
        yield out(rows)


def pack(docs: DataFrame, path: str, pattern: str, size: int = 1024, end_id: int = 0, with_ids: bool = False, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids)."""
    spark = small_batches(docs).sparkSession
    ranks = read_vocabulary(path)
    shared = spark.sparkContext.broadcast((ranks, pattern, read_added(path), digest_of(ranks)))
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = d.mapInArrow(_keyed, "doc_id long, text string, key long").repartitionByRange(parts, "key", "doc_id").sortWithinPartitions("key", "doc_id")
    return keyed.mapInArrow(partial(_packed, size, end_id, with_ids, shared), PIECE_DDL + ", ids array<int>" * with_ids)
