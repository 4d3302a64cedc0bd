"""Byte-level BPE by monoid tree reduction.

Encodings of byte strings form a monoid under "join and re-encode at the seam". `Merger.encode`
splits a piece in halves, encodes both recursively and joins them. A join compares the two tokens
that meet: a token sequence is the encoding of its bytes exactly if every adjacent pair of tokens is the
encoding of its own bytes, since the first merge that crosses a boundary of the sequence would cross
it in that pair alone as well. Where the pair isn't stable, a window around the seam is re-encoded and grown until
the tokens at its rim and those outside are stable pairs, which proves that nothing outside changes.

Text is cut by the pre-tokenizing pattern first. A single space before a non-space always begins a match of
that pattern and no earlier match reaches past it, so text is cut there and the tokens of each cut
are looked up in a bounded table; what isn't there goes through the pattern and, where a match is no token, the tree. At a cut nothing can
merge, so joins above the pieces are plain concatenation. Decoding halves the ids down to leaves of single look-ups and concatenates their bytes up the tree.

Defined cases: null and empty texts have no ids; texts and pieces of any length are read whole (a piece of n bytes costs n log n);
repeated rows are encoded row by row; an empty table gives an empty table; other columns aren't touched.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from array import array
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held, small_batches

#: Pieces of up to this many bytes are the leaves of the tree; ids of up to so many those of decoding's.
LEAF, LEAF_IDS = 4, 512
#: Entries of a worker's lookup tables; beyond, a table starts anew.
TABLE = 400_000
#: Longer cuts aren't kept in the table.
KEPT_CHARS = 48
#: Strings of up to SHORT bytes, as leaves and seams are, are encoded once while a table of so many holds them.
SHORT, SHORTS = 16, 1 << 17
#: Ids handled at once when a text is digested.
BLOCK = 1 << 16


def read_ranks(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}


def digest_of(ranks: dict[bytes, int]) -> str:
    """Tells a whole vocabulary from any other."""
    h = hashlib.sha256()
    for token, rank in sorted(ranks.items()):
        h.update(b"%d:%d:" % (rank, len(token)) + token)
    return h.hexdigest()


class Merger:
    """BPE of one piece."""

    def __init__(self, ranks: dict[bytes, int], leaf: int = LEAF):
        self.ranks, self.leaf = ranks, leaf
        self.bytes = {v: k for k, v in ranks.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.shorts: dict[bytes, list[int]] = {}

    def direct(self, piece: bytes) -> list[int]:
        """Lowest rank first, leftmost among equals, over the whole piece."""
        ranks = self.ranks
        if len(piece) > 64:
            return self._heap(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[x] for x in parts]

    def short(self, piece: bytes) -> list[int]:
        """direct(), looked up where the piece is short; the list isn't to be changed."""
        if len(piece) > SHORT:
            return self.direct(piece)
        found = self.shorts.get(piece)
        if found is None:
            if len(self.shorts) >= SHORTS:
                self.shorts.clear()
            found = self.shorts[piece] = self.direct(piece)
        return found

    def _heap(self, piece: bytes) -> list[int]:
        """The same order of merges by a heap over a linked list: n log n."""
        n, ranks = len(piece), self.ranks
        end, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, e = heapq.heappop(heap)
            if gone[i] or end[i] >= n or end[end[i]] != e:
                continue
            j = end[i]
            gone[j], end[i] = True, e
            if e < n:
                before[e] = i
                if (r := ranks.get(piece[i : end[e]])) is not None:
                    heapq.heappush(heap, (r, i, end[e]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:e])) is not None:
                heapq.heappush(heap, (r, h, e))
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]

    def fits(self, a: int, b: int) -> bool:
        """Whether the tokens a, b are the encoding of their bytes."""
        found = self.stable.get((a, b))
        if found is None:
            if len(self.stable) >= TABLE:
                self.stable.clear()
            found = self.stable[a, b] = self.short(self.bytes[a] + self.bytes[b]) == [a, b]
        return found

    def join(self, a: list[int], b: list[int]) -> list[int]:
        if not a or not b:
            return a or b
        if self.fits(a[-1], b[0]):
            return a + b
        i = j = 1
        while True:
            seam = self.short(b"".join(map(self.bytes.__getitem__, a[-i:] + b[:j])))
            left = i >= len(a) or self.fits(a[-i - 1], seam[0])
            right = j >= len(b) or self.fits(seam[-1], b[j])
            if left and right:
                return a[: max(0, len(a) - i)] + seam + b[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= self.leaf:
            return self.short(piece)
        half = len(piece) // 2
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def encode(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else self.tree(piece)


class _Odd(Exception):
    """A text that single spaces don't cut: white space follows one, or ends it."""


class _Cuts(dict):
    """Ids, as bytes, of ' ' + cut."""

    space = staticmethod(regex.compile(r"\s|\Z").match)

    def __init__(self, encode: Callable[[str], bytes], size: int):
        self.encode, self.size = encode, size

    def __missing__(self, cut: str) -> bytes:
        if self.space(cut):  # never kept, so that texts needn't be searched for such cuts
            raise _Odd
        ids = self.encode(" " + cut)
        if len(cut) <= KEPT_CHARS:
            if len(self) >= self.size:
                self.clear()
            self[cut] = ids
        return ids


class TextEncoder:
    """Ids of texts, by a function that encodes one match of the pattern, or one that encodes a text of a few words."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, encode_piece: Callable[[bytes], list[int]] | None = None, encode_text: Callable[[str], list[int]] | None = None, table: int = TABLE):
        self.bytes = [b""] * (1 + max(ranks.values()))
        for k, v in ranks.items():
            self.bytes[v] = k
        self.names = [str(i) for i in range(len(self.bytes))]
        self.dtype = np.dtype("<u2" if len(self.bytes) <= 1 << 16 else "<u4")
        self.match = regex.compile(pattern).findall
        self.cut = regex.compile(r" (?=\S)").split
        self.piece = encode_piece or Merger(ranks).encode
        self.text = encode_text
        self.pieces: dict[str, bytes] = {}
        self.cuts = _Cuts(self._plain, table)

    def _plain(self, text: str) -> bytes:
        if self.text:
            return array(self.dtype.char, self.text(text)).tobytes()
        out, pieces = [], self.pieces
        for p in self.match(text):
            ids = pieces.get(p)
            if ids is None:
                ids = np.array(self.piece(p.encode()), self.dtype).tobytes()
                if len(p) <= KEPT_CHARS:
                    if len(pieces) >= TABLE:
                        pieces.clear()
                    pieces[p] = ids
            out.append(ids)
        return b"".join(out)

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, self.dtype)
        if text[-1] != " " and "  " not in text and " \n" not in text:
            try:
                return np.frombuffer(self._cut(text.split(" ")), self.dtype)
            except _Odd:
                pass
        return np.frombuffer(self._cut(self.cut(text)), self.dtype)

    def _cut(self, cuts: list[str]) -> bytes:
        rest = b"".join(map(self.cuts.__getitem__, cuts[1:]))
        return self._plain(cuts[0]) + rest

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids: halves are decoded recursively and joined; joining byte strings needs no window."""
        if len(ids) <= LEAF_IDS:
            return b"".join(map(self.bytes.__getitem__, ids.tolist()))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids; SHA-256 of the decimal ids joined by spaces; SHA-256 of the decoded bytes."""
        ids = self.ids(text)
        names = hashlib.sha256()
        for k in range(0, len(ids), BLOCK):
            names.update((" " if k else "").encode() + " ".join(map(self.names.__getitem__, ids[k : k + BLOCK].tolist())).encode())
        return len(ids), names.hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def _encoder(shared) -> TextEncoder:
    """One per worker process: the tables outlive a task."""
    ranks, pattern, digest = shared.value
    return held(("bpe", digest, pattern), lambda: TextEncoder(ranks, pattern))


def _shared(docs: DataFrame, path: str, pattern: str):
    """The ranks, read by the driver and broadcast: the size of a vocabulary, not of the data."""
    ranks = read_ranks(path)
    return small_batches(docs).sparkSession.sparkContext.broadcast((ranks, pattern, digest_of(ranks)))


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """docs with the column out: the ids of text."""
    shared = _shared(docs, path, pattern)

    @F.pandas_udf("array<int>")
    def ids(texts):
        e = _encoder(shared)
        return texts.map(lambda t: e.ids(t).astype("i4"))

    return docs.withColumn(out, ids(F.coalesce(F.col(f"`{text}`"), F.lit(""))))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """df with the column out: the bytes of ids."""
    shared = _shared(df, path, pattern)

    @F.pandas_udf("binary")
    def back(rows):
        e = _encoder(shared)
        return rows.map(lambda x: b"" if x is None else e.decode(np.asarray(x)))

    return df.withColumn(out, back(F.col(f"`{ids}`")))


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    shared = _shared(docs, path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = _encoder(shared)
        for b in batches:
            found = [e.digests(t.as_py()) for t in b["text"]]
            yield pa.RecordBatch.from_arrays([b["doc_id"], *[pa.array([x[k] for x in found], t) for k, t in enumerate((pa.int64(), pa.string(), pa.string()))]], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
