"""Lines that many documents share, found by range-partitioned line hashes with a secondary sort.

Every line's key (stripped, A-Z lower-cased) becomes a 128-bit hash in a row (hash, document,
position). Rows are range-partitioned and sorted by (hash, document, position), so equal keys form one run; a
run is streamed once, holding no more than what is undecided. Ranges are cut on (hash, document): a key that
a third of all documents hold spreads over many partitions, and one partition's share of it is
decided from that partition's own count plus the counts that the few partitions at its edges publish
(at most two keys a partition). What comes back is one compressed keep bitmap per document that loses lines.

Rules: `drop="all"` drops every line whose key at least `min_docs` documents hold; `drop="later"` leaves
the first of them, by document and position.

Defined cases: a null or empty text is one empty line; a key of under `min_chars` code points or `min_words` words is never dropped;
rows that repeat a doc_id are one document for counting, and each row loses the dropped positions of its own text (a text
digest is part of the bitmap's key); a null doc_id counts as one document; texts are read whole; an empty
table gives no bitmaps; other columns pass through `apply`, whatever their names.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, free, release, small_batches

STRIPPED = b" \t\n\x0b\x0c\r"
ROW = "h1 long, h2 long, doc_id long, digest long, pos int, n_lines int"
SCHEMA = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.int64()), ("pos", pa.int32()), ("n_lines", pa.int32())])
OUT = pa.schema([("kind", pa.int32()), *SCHEMA, ("n_docs", pa.int64())])
#: What a streamed row says: drop it; undecided, of a key at the partition's edge; such a key's local count; its first row here.
DROP, UNDECIDED, COUNT, FIRST = 0, 1, 2, 3


def line_rows(min_chars: int, min_words: int = 0):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        release()
        for batch in batches:
            lo, hi, doc, dig, pos, count = [], [], [], [], [], []
            for doc_id, digest, text in zip(batch["doc_id"].to_pylist(), batch["digest"].to_pylist(), batch["text"].to_pylist(), strict=True):
                lines = (text or "").encode().lower().split(b"\n")  # bytes.lower() changes A-Z only
                n = len(lines)
                for k, line in enumerate(lines):
                    key = line.strip(STRIPPED)
                    if key and (min_chars <= 1 or len(key) >= min_chars and len(key.decode()) >= min_chars) and (not min_words or len(key.split()) >= min_words):
                        h = xxhash.xxh3_128_intdigest(key)
                        lo.append((h & 0xFFFFFFFFFFFFFFFF) - (1 << 63))
                        hi.append((h >> 64) - (1 << 63))
                        doc.append(doc_id)
                        dig.append(digest)
                        pos.append(k)
                        count.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip((hi, lo, doc, dig, pos, count), SCHEMA.types, strict=True)], schema=SCHEMA)

    return run


def streamed(min_docs: int, later: bool):
    """Walks one sorted partition. Whole runs inside it are decided here; the first and the last run may go on elsewhere."""

    def out(kind: int, rows: pa.Table, n_docs: int = 0) -> pa.Table:
        n = rows.num_rows
        columns = [rows[c].combine_chunks() for c in SCHEMA.names]
        return pa.Table.from_arrays([pa.array(np.full(n, kind, "i4")), *columns, pa.array(np.full(n, n_docs, "i8"))], schema=OUT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []  # undecided rows of the open run: of fewer than min_docs documents
        key, docs, last_doc, edge, head = None, 0, None, True, None  # edge: no run has ended yet; head: the open run's first row, if it may stay

        def close(at_end: bool) -> Iterator[pa.Table]:
            """The open run ends, or the partition does."""
            rows = pa.concat_tables(held).combine_chunks() if held else None
            if edge or at_end:
                one = pa.Table.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int64()), *[pa.array([0], t) for t in SCHEMA.types[2:]]], schema=SCHEMA)
                yield out(COUNT, one, docs)
                if head is not None:
                    yield out(FIRST, head)
                if rows is not None:
                    yield out(UNDECIDED, rows)
            held.clear()

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            t = pa.Table.from_batches([batch])
            h1, h2 = (batch[c].to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            d = batch["doc_id"].fill_null(-(1 << 63)).to_numpy(zero_copy_only=False)
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            starts = np.flatnonzero(new_run)
            ends = np.r_[starts[1:], n]
            new_doc = new_run | np.r_[True, d[1:] != d[:-1]]
            counts = np.add.reduceat(new_doc.astype("i8"), starts)
            goes_on = key is not None and (int(h1[0]), int(h2[0])) == key
            if key is not None and not goes_on:
                for x in close(at_end=False):
                    yield from x.to_batches()
                edge = False
            drop = np.zeros(n, bool)
            for k in dict.fromkeys((0, len(starts) - 1)):  # the first run may continue the open one, the last stays open
                a, b = int(starts[k]), int(ends[k])
                if k == 0 and goes_on:
                    docs += int(counts[0]) - int(d[0] == last_doc)
                    rows = t.slice(a, b - a)
                else:
                    if k and key is not None:
                        for x in close(at_end=False):
                            yield from x.to_batches()
                        edge = False
                    key, docs = (int(h1[a]), int(h2[a])), int(counts[k])
                    rows = t.slice(a, b - a)
                    if later:
                        head, rows = rows.slice(0, 1), rows.slice(1)
                last_doc = int(d[b - 1])
                if docs >= min_docs:
                    if held:
                        yield from out(DROP, pa.concat_tables(held)).to_batches()
                        held.clear()
                    if rows.num_rows:
                        yield from out(DROP, rows).to_batches()
                elif rows.num_rows:
                    held.append(rows)
            middle = np.flatnonzero(counts >= min_docs)
            for k in middle[(middle > 0) & (middle < len(starts) - 1)]:
                drop[starts[k] + later : ends[k]] = True
            if drop.any():
                yield from out(DROP, t.filter(pa.array(drop))).to_batches()
        if key is not None:
            for x in close(at_end=True):
                yield from x.to_batches()

    return run


def bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        packed = []
        for n, at in zip(batch["n_lines"].to_pylist(), batch["dropped"].to_pylist(), strict=True):
            keep = np.ones(n, bool)
            keep[np.asarray(at, "i8")] = False
            packed.append(zlib.compress(np.packbits(keep).tobytes(), 6))
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["digest"], batch["n_lines"], pa.array(packed, pa.binary())], ["doc_id", "digest", "n_lines", "keep"])


def digested(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(F.col(f"`{text}`")).alias("digest"), F.col(f"`{text}`").alias("text"))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, drop: str = "all", doc_id: str = "doc_id", text: str = "text", min_words: int = 0) -> DataFrame:
    """(doc_id, digest, n_lines, keep): a row per document and text that loses lines; keep is the zlib-compressed bitmap of kept lines. All others keep all."""
    later = {"all": False, "later": True}[drop]
    parts = int(small_batches(docs).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = digested(docs, doc_id, text).mapInArrow(line_rows(min_chars, min_words), ROW)
    rows = rows.repartitionByRange(parts, "h1", "h2", "doc_id").sortWithinPartitions("h1", "h2", "doc_id", "pos", "digest")
    said = cut(rows.mapInArrow(streamed(min_docs, later), f"kind int, {ROW}, n_docs long"))
    key = ["h1", "h2"]
    # Two keys a partition at most: this table is bounded by the number of partitions, not by the data.
    total = said.where(f"kind = {COUNT}").groupBy(*key).agg(F.sum("n_docs").alias("in_docs")).where(F.col("in_docs") >= min_docs)
    open_rows = said.where(f"kind in ({UNDECIDED}, {FIRST})").join(total, key)
    if later:
        first = said.where(f"kind = {FIRST}").groupBy(*key).agg(F.min(F.struct("doc_id", "pos", "digest")).alias("first"))
        open_rows = open_rows.join(first, key).where(~F.struct("doc_id", "pos", "digest").eqNullSafe(F.col("first")))
    columns = ["doc_id", "digest", "n_lines", "pos"]
    dropped = said.where(f"kind = {DROP}").select(columns).unionByName(open_rows.select(columns))
    return dropped.groupBy("doc_id", "digest", "n_lines").agg(F.collect_set("pos").alias("dropped")).mapInArrow(bitmaps, "doc_id long, digest long, n_lines int, keep binary")


def with_bitmaps(docs: DataFrame, found: DataFrame, keep: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with the column keep (null: all lines stay). The bitmaps are broadcast if they measure at most BROADCAST_BYTES, else both sides are shuffled by document."""
    d, g, digest = free(docs, "__d", "__g", "__digest")
    found = cut(found).select(F.col("doc_id").alias(d), F.col("digest").alias(g), F.col("keep").alias(keep))
    held = found.agg(F.coalesce(F.sum(F.length(keep) + 16), F.lit(0))).first()[0]
    found = F.broadcast(found) if held <= BROADCAST_BYTES else found.hint("shuffle_hash")
    left = docs.withColumn(digest, F.xxhash64(F.col(f"`{text}`")))
    return left.join(found, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.col(digest) == F.col(g)), "left").drop(d, g, digest)


def kept_lines(text: str | None, keep: bytes | None) -> tuple[int, int, bytes]:
    """How many lines a text has, how many go, and what stays."""
    raw = (text or "").encode()
    if keep is None:
        return raw.count(b"\n") + 1, 0, raw
    lines = raw.split(b"\n")
    stays = np.unpackbits(np.frombuffer(zlib.decompress(keep), "u1"), count=len(lines)).tolist()
    left = [x for x, k in zip(lines, stays, strict=True) if k]
    return len(lines), len(lines) - len(left), b"\n".join(left)


def report(docs: DataFrame, min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """Per document: doc_id, n_lines, n_dropped, kept_sha256 of the lines that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [kept_lines(*x) for x in zip(b["text"].to_pylist(), b["__keep"].to_pylist(), strict=True)]
            shas = [hashlib.sha256(x).hexdigest() for _, _, x in found]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64()), pa.array(shas, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    both = with_bitmaps(docs.select("doc_id", "text"), keep_bitmaps(docs, min_docs, min_chars), "__keep")
    return both.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def apply(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, drop: str = "later", min_words: int = 0) -> DataFrame:
    """docs with the dropped lines taken out of text (and n_chars counted anew, where there is such a column); a document that had words and loses them all goes."""
    (k,) = free(docs, "__keep")
    both = with_bitmaps(docs, keep_bitmaps(docs, min_docs, min_chars, drop, min_words=min_words), k)

    @F.pandas_udf("string")
    def stripped(text, keep):
        return text.combine(keep, lambda t, k: None if t is None else kept_lines(t, k)[2].decode())

    out = both.withColumn("text", F.when(F.col(k).isNull(), F.col("text")).otherwise(stripped("text", k)))
    out = out.where(F.col(k).isNull() | F.col("text").rlike("[^ \\t\\n\\x0B\\f\\r]")).drop(k)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
