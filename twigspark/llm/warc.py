"""WARC archives as a Spark data source, written and read by Python on the executors.

`register(spark)` makes the format "warc" known. The writer makes one gzip member per record, with the
member's compressed length in a gzip extra field ("sl"), and commits a manifest of the files of successful
tasks with an offset every few megabytes; files that a lost or repeated task left are in no manifest.
The reader plans one partition per offset range of the manifest (of archives without one: per file),
takes over filters on header columns, reads a record's headers first, and goes to the next record by its
length: the payload of a record that no filter passes, or of a read whose schema doesn't name `payload`, is never decoded. In gzip files without that
field, where a member's end is known only by inflating it, such payloads are inflated in bounded pieces and thrown away; a member may hold any number of records.

Defined cases: a null payload is empty; a null url writes no WARC-Target-URI and reads as null; control characters in
a url are percent-encoded; payloads of any length are written whole (members over 4 GB go without the extra
field and are skipped by inflating); an empty table writes archives without records; unknown columns of the written
frame become no part of a record; rows that repeat a page_id with the same payload are written alike. `mode("overwrite")` takes away what was there once the new
archives are complete. A record that is cut off, damaged or without a Content-Length is an error that names the file; with the option
malformed="skip" the rest of that file's range is left out and what stands before is read.
Paths go through pyarrow's file systems (local, HDFS, S3, GCS), so every executor and the driver must share them.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    Not,
    StringContains,
    StringEndsWith,
    StringStartsWith,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from . import hashing
from .common import BROADCAST_BYTES, cut, fresh_path, small_batches

HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "warc_date", "content_type", "payload_digest", "payload_bytes", "refers_to", "headers")
ALL = "record_id string, record_type string, target_uri string, warc_date string, content_type string, payload_digest string, payload_bytes long, refers_to string, headers map<string,string>, payload binary"
MANIFEST, ARCHIVE = "_manifest.json", re.compile(r"\.warc(\.gz)?$")
SPLIT_BYTES = 8 << 20
#: Bytes read, and inflated, at once; the longest block of headers.
CHUNK, PIECE, MOST_HEADER = 16 << 10, 64 << 10, 1 << 20
#: The Bloom filter's bits at most, as a power of two (16 MB), and its probes.
BLOOM_BITS, PROBES = 27, 4
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(record: bytes, level: int) -> bytes:
    """A gzip member; its extra field "sl" holds the member's length and the record's, so that a reader can step over it."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    tail = struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)
    total = 10 + 2 + 12 + len(body) + 8
    if total >= 1 << 32 or len(record) >= 1 << 32:
        return b"\x1f\x8b\x08\x00\0\0\0\0\x00\xff" + body + tail
    extra = b"sl" + struct.pack("<HII", 8, total, len(record))
    return b"\x1f\x8b\x08\x04\0\0\0\0\x00\xff" + struct.pack("<H", len(extra)) + extra + body + tail


def printable(value: str) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(row: dict, date: str) -> bytes:
    """The bytes of one response or revisit record."""
    revisit = row["record_type"] == "revisit"
    payload = b"" if revisit else row.get("payload") or b""
    payload = payload.encode() if isinstance(payload, str) else payload
    block = HTTP + payload
    head = [("WARC-Type", row["record_type"]), ("WARC-Record-ID", f"<{row['record_id']}>"), ("WARC-Date", row.get("warc_date") or date), ("Content-Type", "application/http; msgtype=response")]
    if row.get("target_uri") is not None:
        head.append(("WARC-Target-URI", printable(row["target_uri"])))
    digest = row.get("payload_digest") or base32_sha1(payload)
    count = row.get("payload_bytes")
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload) if count is None else count))]
    if revisit:
        head += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", REVISIT)]
    head.append(("Content-Length", str(len(block))))
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    size: int
    splits: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool = False):
        self.path, self.overwrite = options["path"], overwrite
        self.level = int(options.get("compression_level", 6))
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        name, at, splits = f"{uuid.uuid4().hex}.warc.gz", 0, [0]
        with system.open_output_stream(f"{root}/{name}", compression=None) as out:
            for batch in iterator:
                for k in range(batch.num_rows):  # one row at a time: a batch of long payloads isn't copied whole
                    data = member(record({c: batch[c][k].as_py() for c in batch.schema.names}, self.date), self.level)
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, at, splits)

    def commit(self, messages: list) -> None:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        new = [m for m in messages if m]
        before = system.get_file_info(fs.FileSelector(root, recursive=True)) if self.overwrite else []
        with system.open_output_stream(f"{root}/{uuid.uuid4().hex}{MANIFEST}", compression=None) as out:
            out.write(json.dumps([[m.file, m.size, m.splits] for m in new]).encode())
        old = [x.path for x in before if (x.path.endswith(MANIFEST) or ARCHIVE.search(x.path)) and x.base_name not in {m.file for m in new}]
        for path in sorted(old, key=lambda x: not x.endswith(MANIFEST)):  # manifests first: what no manifest names isn't read
            system.delete_file(path)

    def abort(self, messages: list) -> None:
        system, root = opened(self.path)
        for m in messages:
            if m:
                system.delete_file(f"{root}/{m.file}")


@dataclass
class Range(InputPartition):
    file: str
    start: int
    end: int


def passes(f, head: dict) -> bool:
    """A pushed filter on a record's header columns; comparisons with null fail, as in SQL."""
    if isinstance(f, Not):
        inner = f.child
        known = isinstance(inner, (IsNull, IsNotNull, EqualNullSafe)) or head.get(inner.attribute[0]) is not None
        return known and not passes(inner, head)
    v = head.get(f.attribute[0])
    if isinstance(f, IsNull):
        return v is None
    if isinstance(f, IsNotNull):
        return v is not None
    if isinstance(f, EqualNullSafe):
        return v == f.value
    if v is None:
        return False
    test = {EqualTo: lambda x: v == x, In: lambda x: v in x, GreaterThan: lambda x: v > x, GreaterThanOrEqual: lambda x: v >= x, LessThan: lambda x: v < x, LessThanOrEqual: lambda x: v <= x, StringStartsWith: lambda x: v.startswith(x), StringEndsWith: lambda x: v.endswith(x), StringContains: lambda x: x in v}
    return test[type(f)](f.value)


SUPPORTED = (EqualTo, EqualNullSafe, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull, StringStartsWith, StringEndsWith, StringContains)


def parsed(head: bytes) -> dict:
    """Header columns of a record's header block."""
    fields: dict[str, str] = {}
    last = None
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and last:
            fields[last] += " " + line.strip()
        elif ":" in line:
            k, _, v = line.partition(":")
            last = k.strip().lower()
            fields[last] = v.strip()
    bare = lambda k: fields[k].strip("<>") if k in fields else None
    digest = fields.get("warc-payload-digest")
    size = fields.get("x-payload-length")
    return {"record_id": bare("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": bare("warc-target-uri"), "warc_date": fields.get("warc-date"), "content_type": fields.get("content-type"), "payload_digest": digest and digest.rpartition(":")[2], "payload_bytes": int(size) if size and size.isdigit() else None, "refers_to": bare("warc-refers-to"), "headers": fields}


class Stream:
    """The bytes of a file from one place to another, inflated if it is gzipped, a piece at a time. Members of a gzip file follow one another."""

    def __init__(self, file, start: int, end: int, gz: bool):
        self.file, self.place, self.end = file, start, end
        self.z = zlib.decompressobj(31) if gz else None
        self.raw, self.held, self.inflated, self.whole, self.piece = b"", b"", 0, True, 2048
        file.seek(start)

    def more(self) -> bool:
        """Adds a piece to what is held, if there is one."""
        while True:
            if not self.raw:
                self.raw = self.file.read(min(CHUNK, self.end - self.place))
                self.place += len(self.raw)
                if not self.raw:
                    return False
            if self.z is None:
                part, self.raw = self.raw, b""
            else:
                part = self.z.decompress(self.raw, self.piece)
                self.piece = min(PIECE, 4 * self.piece)  # headers are short
                self.raw, self.whole = self.z.unconsumed_tail, self.z.eof
                if self.z.eof:
                    self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
                self.inflated += len(part)
            if part:
                self.held += part
                return True

    def head(self) -> dict | None:
        """The next record's header columns; None at the end."""
        while True:
            self.held = self.held.lstrip(b"\r\n")
            k = self.held.find(b"\r\n\r\n")
            if k >= 0:
                head, self.held = parsed(self.held[:k]), self.held[k + 4 :]
                return head
            if len(self.held) > MOST_HEADER:
                raise ValueError("no end of a record's headers")
            if not self.more():
                if self.held or not self.whole:
                    raise ValueError("a record is cut off")
                return None

    def take(self, n: int, keep: bool) -> bytes:
        """The next n bytes, or, if they aren't kept, none of them."""
        out = []
        while n:
            if not self.held:
                if self.z is None and not keep:  # plain bytes are stepped over
                    if self.place + n > self.end:
                        raise ValueError("a record is cut off")
                    self.place += n
                    self.file.seek(self.place)
                    break
                if not self.more():
                    raise ValueError("a record is cut off")
            part, self.held = self.held[:n], self.held[n:]
            n -= len(part)
            if keep:
                out.append(part)
        return b"".join(out)


def block_size(head: dict) -> int:
    size = head["headers"].get("content-length", "")
    if not size.isdigit():
        raise ValueError(f"record {head['record_id']} has no Content-Length")
    return int(size)


class Records:
    """Walks the records of one range: headers first, the block only when asked for, before the walk goes on."""

    def __init__(self, file, start: int, end: int, gz: bool):
        self.file, self.at, self.end, self.gz = file, start, end, gz
        self.inflated = 0  # bytes decoded, for tests

    def __iter__(self) -> Iterator[tuple[dict, object]]:
        while self.at < self.end:
            self.file.seek(self.at)
            length = self._length(self.file.read(64)) if self.gz else None
            if length is None:
                yield from self._stream()
                return
            stream = Stream(self.file, self.at, min(self.at + length, self.end), True)
            head = stream.head()
            if head is None:
                raise ValueError("a member without a record")
            yield head, partial(self._block, stream, head)
            self.inflated += stream.inflated
            self.at += length

    def _block(self, stream: Stream, head: dict) -> bytes:
        return stream.take(block_size(head), True)

    def _stream(self) -> Iterator[tuple[dict, object]]:
        stream = Stream(self.file, self.at, self.end, self.gz)
        while (head := stream.head()) is not None:
            size, asked = block_size(head), []

            def body(n: int = size, asked: list = asked) -> bytes:
                asked.append(True)
                return stream.take(n, True)

            yield head, body
            if not asked:
                stream.take(size, False)
            self.inflated = stream.inflated

    @staticmethod
    def _length(raw: bytes) -> int | None:
        if len(raw) < 12 or not raw[3] & 4:
            return None
        (n,) = struct.unpack_from("<H", raw, 10)
        extra = raw[12 : 12 + n]
        while len(extra) >= 4:
            name, (size,) = extra[:2], struct.unpack_from("<H", extra, 2)
            if name == b"sl":
                return struct.unpack_from("<I", extra, 4)[0]
            extra = extra[4 + size :]
        return None


class WarcReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.path = schema, options["path"]
        self.verify = str(options.get("verify", "false")).lower() == "true"
        self.skips = str(options.get("malformed", "fail")).lower() == "skip"
        self.filters: list = []

    def pushFilters(self, filters: list) -> Iterator:
        for f in filters:
            inner = f.child if isinstance(f, Not) else f
            if isinstance(inner, SUPPORTED) and len(inner.attribute) == 1 and inner.attribute[0] in HEADER_COLUMNS[:-1]:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Range]:
        system, root = opened(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.File:
            return [Range(self.path, 0, info.size)]
        found = system.get_file_info(fs.FileSelector(root, recursive=True))
        base, out = self.path.rstrip("/"), []
        if manifests := [x.path for x in found if x.path.endswith(MANIFEST)]:
            for m in manifests:
                for name, size, splits in json.loads(system.open_input_stream(m, compression=None).read()):
                    out += [Range(f"{base}/{name}", a, b) for a, b in zip(splits, [*splits[1:], size], strict=True) if b > a]
        else:
            out = [Range(f"{base}/{x.path[len(root.rstrip('/')) + 1 :]}", 0, x.size) for x in found if ARCHIVE.search(x.path) and x.size]
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.schema)
        if not partition.file:
            return
        system, path = opened(partition.file)
        wants = "payload" in schema.names
        rows, held = [], 0
        with system.open_input_file(path) as file:
            for head, body in self._records(file, partition, path.endswith(".gz")):
                if not all(passes(f, head) for f in self.filters):
                    continue
                if wants or self.verify:
                    try:
                        block = body()
                    except (ValueError, zlib.error) as e:
                        if self.skips:
                            break
                        raise ValueError(f"{partition.file}: {e}") from e
                    http = (head["content_type"] or "").startswith("application/http")
                    payload = block.partition(b"\r\n\r\n")[2] if http else block
                    if self.verify and head["record_type"] == "response" and (base32_sha1(payload) != head["payload_digest"] or head["payload_bytes"] not in (None, len(payload))):
                        raise ValueError(f"payload of {head['record_id']} doesn't match its digest")
                    head["payload"] = payload
                    held += len(payload)
                rows.append({c: head.get(c) for c in schema.names})
                if len(rows) >= 1000 or held >= 16 << 20:
                    yield self._batch(rows, schema)
                    rows, held = [], 0
        if rows:
            yield self._batch(rows, schema)

    def _records(self, file, partition: Range, gz: bool) -> Iterator[tuple[dict, object]]:
        try:
            yield from Records(file, partition.start, partition.end, gz)
        except (ValueError, zlib.error) as e:
            if not self.skips:
                raise ValueError(f"{partition.file}: {e}") from e

    @staticmethod
    def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([list(v.items()) if isinstance(v := r[f.name], dict) else v for r in rows], f.type) for f in schema], schema=schema)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ALL

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def _bits(n: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The filter's bits that a partition's hashes set, as numbers of 64-bit words and their values."""
    bits = np.zeros(n // 64, "u8")
    for b in batches:
        h = b["h"].to_numpy(zero_copy_only=False).view("u8")
        for k in range(PROBES):
            at = probe(h, k, n)
            np.bitwise_or.at(bits, at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63)))
    used = np.flatnonzero(bits)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(bits[used].view("i8"))], ["word", "bits"])


def probe(h: np.ndarray, k: int, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return hashing.mix(h + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)


def bloom(gone: DataFrame, rows: int):
    """A test on a column of hashes of (page_id, sha): false where the pair is certainly not in gone."""
    n = 1 << min(BLOOM_BITS, max(12, (10 * rows).bit_length()))
    found = gone.select(F.xxhash64("page_id", "sha").alias("h")).mapInArrow(partial(_bits, n), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(n // 64, "u8")
    bits[found["word"].to_numpy()] = found["bits"].to_numpy().view("u8")
    shared = gone.sparkSession.sparkContext.broadcast(bits)

    @F.arrow_udf("boolean")
    def maybe(h: pa.Array) -> pa.Array:
        h, out = h.to_numpy(zero_copy_only=False).view("u8"), np.ones(len(h), bool)
        for k in range(PROBES):
            at = probe(h, k, n)
            out &= (shared.value[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) > 0
        return pa.array(out)

    return maybe


def records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """A record to write per row of pages (page_id, url, html): of equal payloads of at least min_bytes bytes, the smallest page_id's row is the response and the others revisit it.

    Only payloads that occur twice are matched; revisits travel without their payload. If they measure more than BROADCAST_BYTES,
    a Bloom filter of them of at most BLOOM_BITS tells which pages can be revisits, and only these are moved. A payload that very many pages share is counted by partial
    aggregation, and its revisits are matched under salted keys.
    """
    salts = 32
    html = F.coalesce(F.col("html"), F.lit(""))
    p = pages.select("page_id", "url", F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("payload_bytes"))
    shared = p.where(F.col("payload_bytes") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = p.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    revisits = cut(salted.join(shared, ["sha", "salt"]).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).drop("salt"))
    held = revisits.count() * 64
    gone = revisits.select("page_id", "sha").distinct()
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")))
    both = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("sha"), F.octet_length(html).cast("long").alias("payload_bytes"))

    def without(rows: DataFrame, gone: DataFrame) -> DataFrame:
        g = gone.select(F.col("page_id").alias("__p"), F.col("sha").alias("__s"))
        return rows.join(g, F.col("page_id").eqNullSafe(F.col("__p")) & (F.col("sha") == F.col("__s")), "left_anti")

    if held <= BROADCAST_BYTES:
        left = without(both, F.broadcast(gone))
    else:  # only rows that a Bloom filter takes for revisits are shuffled
        maybe = bloom(cut(gone), held // 64)
        marked = both.withColumn("__maybe", maybe(F.xxhash64("page_id", "sha")))
        sure, asked = (marked.where(x).drop("__maybe") for x in (~F.col("__maybe"), F.col("__maybe")))
        left = sure.unionByName(without(asked, gone.hint("shuffle_hash")))
    none = F.lit(None).cast("string")
    a = left.select(urn("page_id").alias("record_id"), F.lit("response").alias("record_type"), F.col("url").alias("target_uri"), F.col("sha"), "payload_bytes", none.alias("refers_to"), F.col("html").alias("payload"))
    b = revisits.select(urn("page_id").alias("record_id"), F.lit("revisit").alias("record_type"), F.col("url").alias("target_uri"), F.col("sha"), "payload_bytes", urn("first_id").alias("refers_to"), none.alias("payload"))

    @F.pandas_udf("string")
    def base32(hexes):
        return hexes.map(lambda x: base64.b32encode(bytes.fromhex(x)).decode())

    return a.unionByName(b).withColumn("payload_digest", base32("sha")).drop("sha")


def write(df: DataFrame, path: str, **options: str) -> None:
    register(small_batches(df).sparkSession)
    df.write.format("warc").mode("append").options(**options).save(path)


def read(spark: SparkSession, path: str, schema: str | None = None, **options: str) -> DataFrame:
    register(spark)
    r = spark.read.format("warc").options(**options)
    return (r.schema(schema) if schema else r).load(path)


def report(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """pages as archives and back. Per record: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(records(pages, min_bytes), path)
    back = read(spark, path, "record_id string, record_type string, payload_bytes long, payload_digest string, refers_to string", verify="true")
    number = lambda c: F.regexp_extract(c, "(-?\\d+)$", 1).try_cast("long")
    return back.select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"))
