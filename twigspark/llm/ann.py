"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each of `tables` hash tables takes `hashes` Gaussian projections of the unit vector, shifted and cut into cells
of `width`: on unit vectors, the Euclidean distance that such hashing follows orders as the cosine does. A query
looks into its own bucket and into perturbed ones, in the order of their estimated success: the squared
distances from its projections to the cell borders that a perturbation crosses, summed, smallest first. Every vector is in the index.

Buckets are dealt to tasks; a bucket with more than `hot` vectors is split over several. A query goes to
each task that holds buckets it visits, once, with their keys. There it is compared with whole buckets by matrix product in double
precision, what may be among its k nearest is measured exactly on the original vectors, and candidates of all tables are
merged and ranked: exact cosine, then the smaller id. Of equal vectors, those with the k + 1 smallest ids take part: no other can be among
the k nearest.

Defined cases: a vector that is null, empty, zero or holds a null or non-finite component takes no part, as query or candidate; vectors of
different lengths aren't compared; rows that repeat an id are one candidate, the nearest of them, and never their own query's;
a query for which the probes find fewer than k candidates is compared with all vectors of its length, so that it has fewer than k only
where there are no more; an empty table gives an empty result; other columns aren't touched.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from . import hashing
from .common import cut

#: Vectors of a task's share of buckets.
SHARE = 8_192
#: Most buckets that are known as hot: their keys are broadcast.
HOT_KEYS = 500_000
#: Queries of one matrix product.
QUERIES_AT_ONCE = 512


def projections(dim: int, tables: int, hashes: int, width: float, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng([seed, dim, tables, hashes])
    return r.normal(size=(tables, dim, hashes)), r.uniform(0, width, (tables, 1, hashes))


def cells(unit: np.ndarray, tables: int, hashes: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell numbers and places within them, in units of width: (tables, rows, hashes)."""
    a, b = projections(unit.shape[1], tables, hashes, width)
    f = (np.einsum("rd,tdh->trh", unit, a) + b) / width
    h = np.floor(f)
    return h.astype("i8"), f - h


def keys_of(cell: np.ndarray, dim: int, first: int = 0) -> np.ndarray:
    """One key for a table (from first on), a vector length and cell numbers: (tables, rows)."""
    with np.errstate(over="ignore"):
        k = np.broadcast_to((np.arange(first, first + len(cell), dtype="u8") * np.uint64(1 << 20) + np.uint64(dim))[:, None], cell.shape[:2])
        for j in range(cell.shape[2]):
            k = hashing.mix(k * np.uint64(0x9E3779B97F4A7C15) + cell[:, :, j].astype("u8"))
    return k.view("i8")


def perturbations(place: np.ndarray, probes: int) -> list[list[tuple[int, int]]]:
    """The probes cheapest sets of (hash, step), the empty one first, by the sum of squared distances to the borders crossed."""
    m = len(place)
    z = sorted([(x * x, j, -1) for j, x in enumerate(place)] + [((1 - x) ** 2, j, 1) for j, x in enumerate(place)])
    out, heap = [[]], [(z[0][0], (0,))]
    while heap and len(out) < probes:
        cost, at = heapq.heappop(heap)
        if len({z[k][1] for k in at}) == len(at):
            out.append([z[k][1:] for k in at])
        last = at[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (cost - z[last][0] + z[last + 1][0], (*at[:-1], last + 1)))
            heapq.heappush(heap, (cost + z[last + 1][0], (*at, last + 1)))
    return out


def by_length(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, vectors) of a batch, for each vector length."""
    column = batch["vector"]
    length = np.diff(column.offsets.to_numpy(zero_copy_only=False))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    start = np.r_[0, np.cumsum(length)]
    ids = batch["id"].to_numpy(zero_copy_only=False)
    for n in np.unique(length):
        at = np.flatnonzero(length == n)
        yield ids[at], flat[start[at][:, None] + np.arange(n)].astype("f8")


def unit_of(v: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by the largest component first, so that no square overflows."""
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _counted(tables: int, hashes: int, width: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for _, v in by_length(b):
            k, n = np.unique(keys_of(cells(unit_of(v), tables, hashes, width)[0], v.shape[1]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n)], ["key", "n"])


ROW = ["part", "query", "id", "keys", "vector"]
ROW_DDL = "part long, query boolean, id long, keys binary, vector binary"


def _rows(part: list, query: bool, ids: list, keys: list, vectors: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([query] * len(part), pa.bool_()), pa.array(ids, pa.int64()), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())], ROW)


def _indexed(tables: int, hashes: int, width: float, parts: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hot = shared.value
    for b in batches:
        for ids, v in by_length(b):
            k = keys_of(cells(unit_of(v), tables, hashes, width)[0], v.shape[1])
            split = hashing.mix(ids.astype("u8"))
            raw = [x.tobytes() for x in v]
            for keys in k:
                part = [_part(int(key), int(split[i]) % hot.get(int(key), 1), parts) for i, key in enumerate(keys)]
                yield _rows(part, False, ids.tolist(), [x.tobytes() for x in keys], raw)


def _part(key: int, share: int, parts: int) -> int:
    return (key + 0x9E3779B97F4A7C15 * share) % parts


def _probing(tables: int, hashes: int, width: float, probes: int, parts: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hot = shared.value
    for b in batches:
        for ids, v in by_length(b):
            cell, place = cells(unit_of(v), tables, hashes, width)
            for i, own in enumerate(ids.tolist()):
                to: dict[int, list[int]] = {}
                for t in range(tables):
                    visits = perturbations(place[t, i].tolist(), probes)
                    at = np.repeat(cell[t, i][None], len(visits), axis=0)
                    for r, steps in enumerate(visits):
                        for j, step in steps:
                            at[r, j] += step
                    for key in keys_of(at[None], v.shape[1], t)[0].tolist():
                        for share in range(hot.get(key, 1)):
                            to.setdefault(_part(key, share, parts), []).append(key)
                raw = v[i].tobytes()
                yield _rows(list(to), True, [own] * len(to), [np.unique(np.array(x, "i8")).tobytes() for x in to.values()], [raw] * len(to))


def _blocks(parts: int, shared, query: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows for an exact comparison: a length's vectors are dealt over its shares, and a query goes to each of them."""
    shares = shared.value
    for b in batches:
        for ids, v in by_length(b):
            n = v.shape[1]
            if n not in shares:
                continue
            raw, key = [x.tobytes() for x in v], np.array([n], "i8").tobytes()
            if query:
                for share in range(shares[n]):
                    yield _rows([_part(n, share, parts)] * len(ids), True, ids.tolist(), [key] * len(ids), raw)
            else:
                yield _rows([_part(n, int(x) % shares[n], parts) for x in hashing.mix(ids.astype("u8"))], False, ids.tolist(), [key] * len(ids), raw)


def exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Cosines of rows, each summed alone and in the same order: equal vectors have equal scores."""
    q, c = (x / np.abs(x).max(axis=1, keepdims=True) for x in (q, c))
    return (q * c).sum(axis=1) / np.sqrt((q * q).sum(axis=1) * (c * c).sum(axis=1))


def _nearest(k: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each query's k nearest among the buckets that it visits in a part. Rows come by part, buckets first."""
    part, held, ready = None, [], None

    def built():
        keys = np.concatenate([x[0] for x in held])
        by = np.argsort(keys, kind="stable")
        ids, raw = np.concatenate([x[1] for x in held])[by], [r for x in held for r in x[2]]
        v = [np.frombuffer(raw[i], "f8") for i in by]
        return keys[by], ids, v

    for b in batches:
        parts, is_query = b["part"].to_numpy(zero_copy_only=False), b["query"].to_numpy(zero_copy_only=False)
        ids = b["id"].to_numpy(zero_copy_only=False)
        cut = np.flatnonzero(np.r_[True, (parts[1:] != parts[:-1]) | (is_query[1:] != is_query[:-1])]) if len(parts) else []
        for a, e in zip(cut, [*cut[1:], len(parts)], strict=True):
            if parts[a] != part:
                part, held, ready = parts[a], [], None
            keys, vectors = b["keys"].slice(a, e - a).to_pylist(), b["vector"].slice(a, e - a).to_pylist()
            if not is_query[a]:
                held.append((np.frombuffer(b"".join(keys), "i8"), ids[a:e], vectors))
                continue
            if not held:
                continue
            if ready is None:
                ready = built()
                held[1:] = []  # only tells that there are buckets
            visits: dict[int, list[int]] = {}
            for r, x in enumerate(keys):
                for key in np.frombuffer(x, "i8").tolist():
                    visits.setdefault(key, []).append(r)
            groups = [(key, rows[j : j + QUERIES_AT_ONCE]) for key, rows in visits.items() for j in range(0, len(rows), QUERIES_AT_ONCE)]
            found: list[dict[int, float]] = [{} for _ in keys]
            all_keys, all_ids, all_v = ready
            for key, rows in groups:
                lo, hi = np.searchsorted(all_keys, key), np.searchsorted(all_keys, key, "right")
                if lo == hi:
                    continue
                q, c = np.stack([np.frombuffer(vectors[r], "f8") for r in rows]), np.stack(all_v[lo:hi])
                s = unit_of(q) @ unit_of(c).T
                s[ids[a:e][rows][:, None] == all_ids[lo:hi][None]] = -np.inf
                by = np.argsort(all_ids[lo:hi], kind="stable")
                first = np.flatnonzero(np.diff(all_ids[lo:hi][by], prepend=all_ids[lo:hi][by][0] - 1))
                best = s if len(first) == hi - lo else np.maximum.reduceat(s[:, by], first, axis=1)  # an id's nearest vector counts for it
                least = np.partition(best, -k, axis=1)[:, -k] if best.shape[1] > k else np.full(len(rows), -2.0)
                x, y = np.nonzero(s >= np.maximum(least, -2.0)[:, None] - 1e-9)
                for r, i, score in zip(x.tolist(), all_ids[lo + y].tolist(), exact(q[x], c[y]).tolist(), strict=True):
                    found[rows[r]][i] = max(score, found[rows[r]].get(i, -2.0))
            out = [(q, i, -s) for q, x in zip(ids[a:e].tolist(), found, strict=True) for s, i in heapq.nsmallest(k, ((-s, i) for i, s in x.items()))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(f"`{embedding}`")
    kind = vectors.schema[embedding].dataType
    of = "float" if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.FloatType) else "double"
    ok = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(ok).select(F.col(f"`{vec_id}`").cast("long").alias("id"), v.cast(f"array<{of}>").alias("vector"))


def search(vectors: DataFrame, is_query: Column, k: int = 5, tables: int = 10, hashes: int = 6, width: float = 1.5, probes: int = 90, hot: int = 16_384, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k nearest found for each row where is_query(vec_id) holds, among all other rows."""
    spark = vectors.sparkSession
    good = usable(vectors, vec_id, embedding)
    # Of equal vectors the k + 1 smallest ids can be among a query's k. Spark limits the ranks before the shuffle as well, so a task sends no more than those of a vector.
    ranked = Window.partitionBy("vector").orderBy("id")
    index = good.withColumn("__r", F.dense_rank().over(ranked)).where(F.col("__r") <= k + 1).select("vector", "id").dropDuplicates(["vector", "id"]).select("id", "vector")
    cfg = (tables, hashes, width)
    counts = good.mapInArrow(partial(_counted, *cfg), "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).persist()
    rows = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = max(hot, rows // HOT_KEYS)  # so at most HOT_KEYS buckets are hot, whatever the size of the data
    shared = spark.sparkContext.broadcast({r["key"]: -(-r["n"] // hot) for r in counts.where(F.col("n") > hot).collect()})
    counts.unpersist()
    # Parts follow the data and not the cluster: each part that a query visits returns up to k rows.
    parts = 1 + rows // SHARE
    queries = good.where(is_query)
    both = index.mapInArrow(partial(_indexed, *cfg, parts, shared), ROW_DDL).unionByName(queries.mapInArrow(partial(_probing, *cfg, probes, parts, shared), ROW_DDL))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")

    def best(rows: DataFrame, n: int) -> DataFrame:
        found = rows.repartition(n, "part").sortWithinPartitions("part", "query").mapInArrow(partial(_nearest, k), "query_id long, vec_id long, score double")
        each = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
        out = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        return out.select("query_id", "rank", "vec_id", "score")

    near = cut(best(both, parts))
    full = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    short = queries.join(full, "id", "left_anti").select("id", "vector")
    lengths = [r[0] for r in short.select(F.size("vector")).distinct().collect()]
    if not lengths:
        return near
    # The probes found too few for these: all vectors of their lengths, in blocks.
    sizes = index.groupBy(F.size("vector").alias("n")).count().where(F.col("n").isin(lengths)).collect()
    shares = spark.sparkContext.broadcast({r["n"]: -(-r["count"] // SHARE) for r in sizes})
    n = sum(shares.value.values())
    rest = index.mapInArrow(partial(_blocks, n, shares, False), ROW_DDL).unionByName(short.mapInArrow(partial(_blocks, n, shares, True), ROW_DDL))
    return near.join(short.select(F.col("id").alias("query_id")), "query_id", "left_anti").unionByName(best(rest, n))
