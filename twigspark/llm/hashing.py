"""Word and shingle hashes of whole Arrow columns by numpy: no Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes hashed at once; bounds the working memory of a task whatever the length of a text.
BLOCK = 1 << 18
#: Bytes of texts handled together.
GROUP = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype="u1")
_LOWER[65:91] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_TABLES: list = []


def _powers() -> tuple[np.ndarray, np.ndarray]:
    """_BASE ** i and its inverse, modulo 2 ** 64."""
    if not _TABLES:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        with np.errstate(over="ignore"):
            _TABLES.append(tuple(np.cumprod(np.r_[np.uint64(1), np.full(BLOCK + 1, x, "u8")], dtype="u8") for x in (_BASE, inverse)))
    return _TABLES[0]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype("u8", copy=True)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def groups(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows with about GROUP bytes; null texts are empty."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], "i8")[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", "u1")
    row = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + GROUP, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in data, and the number of words before each text (one more than there are texts)."""
    inside = ~_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    start = inside & (np.r_[True, ~inside[:-1]] | first[:-1])
    end = inside & np.r_[~inside[1:] | first[1:-1], np.ones(min(1, len(data)), bool)]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of words, A-Z lower-cased if lower."""
    power, inverse = _powers()
    out = np.empty(len(starts), "u8")
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            a = int(starts[i])
            j = int(np.searchsorted(ends, a + BLOCK, "right"))
            if j <= i:  # one word longer than a block
                h = np.uint64(0)
                for k in range(a, int(ends[i]), BLOCK):
                    part = data[k : min(k + BLOCK, int(ends[i]))]
                    part = (_LOWER[part] if lower else part).astype("u8") + np.uint64(1)
                    h = h * np.uint64(0xD6E8FEB86659FD93) + (part * power[: len(part)]).sum(dtype="u8") + np.uint64(1)
                out[i] = h
                i += 1
                continue
            part = data[a : int(ends[j - 1])]
            part = (_LOWER[part] if lower else part).astype("u8") + np.uint64(1)
            part *= power[: len(part)]
            total = np.empty(len(part) + 1, "u8")
            total[0] = 0
            np.cumsum(part, out=total[1:])
            s, e = starts[i:j] - a, ends[i:j] - a
            out[i:j] = (total[e] - total[s]) * inverse[s]
            i = j
    return mix(out)


def shingles(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-word shingles of one text; a text of fewer words is one shingle, of none has none."""
    if not len(hashes):
        return hashes
    n = min(n, len(hashes))
    with np.errstate(over="ignore"):
        h = np.full(len(hashes) - n + 1, n, "u8")
        for k in range(n):
            h = h * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + len(h)]
    return mix(h)
