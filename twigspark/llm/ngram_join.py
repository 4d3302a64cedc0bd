"""Jaccard self-join of word n-gram sets by prefix filters under several global token orders.

A document's set is its distinct n-word shingles, as 64-bit hashes. Copies with equal sets are one node, named by a
128-bit digest of the set. For a threshold t and any global token order, two sets with similarity t or
more share a token in the first n - ceil(t n) + 1 tokens of each, and share at least as many there as the rest of
the sets can't make up for. Three orders are used; each sorts by approximate document frequency first (a sketch of
counts over all documents), so that text which very many documents share stays out of the prefixes, and
breaks ties by a hash of its own.

1. Nodes send their prefix under the first order to the tokens' partitions. Runs of up to `HOT` nodes give
   pairs, which are counted and kept by the count bound. Longer runs give only a star of their members.
2. Connected components of pairs and stars are clusters: every pair that can link lies within one. A cluster is
   dealt into blocks by hash and each pair of blocks is one group, so no task holds more than two blocks; members move as texts.
3. In a group the bounds of the second and third order are intersected, what is left is verified by exact set overlaps
   in matrices, and only a spanning forest of the links goes out: pairs never become rows.
4. Components of the links are labelled with their smallest doc_id.

Defined cases: a null or empty text has no shingles and links with nothing, not even another empty one; a text of
fewer words than a shingle is one shingle; rows that repeat a doc_id are nodes by their texts; a null doc_id is never a component's smallest
unless all are null; texts are read whole; an empty table gives an empty table; other columns aren't touched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigspark.operators.components import components

from . import hashing
from .common import BROADCAST_BYTES, cut, free, release, small_batches

#: Members of a token's run that are paired one by one; longer runs go through a star.
HOT = 48
#: Sets of shingles at most that are known for their many copies; they are broadcast.
HOT_SETS = 100_000
#: Documents of a block, and shingles at most on average.
BLOCK, BLOCK_SHINGLES = 1024, 1_500_000
ORDERS = 3


def sets_of(texts: pa.Array, words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    for _, data, offsets in hashing.groups(texts):
        starts, ends, before = hashing.words(data, offsets)
        h = hashing.word_hashes(data, starts, ends, lower=True)
        for k in range(len(offsets) - 1):
            yield np.unique(hashing.shingles(h[before[k] : before[k + 1]], words))


def named(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(s.tobytes())
    return (h & 0xFFFFFFFFFFFFFFFF) - (1 << 63), (h >> 64) - (1 << 63)


def ceil_div(a, b):
    return -(-a // b)


def prefix_size(n, num: int, den: int):
    return n - ceil_div(num * n, den) + 1


def order_keys(s: np.ndarray, counts: np.ndarray, bits: int, k: int) -> np.ndarray:
    """s in the order k: by frequency, then by a hash. counts: the sketch."""
    c = counts[(s >> np.uint64(64 - bits)).astype("i8")]
    if k:
        with np.errstate(over="ignore"):
            return s[np.lexsort((hashing.mix(s + np.uint64(k) * np.uint64(0x9E3779B97F4A7C15)), np.log2(c + 1).astype("i4")))]
    return s[np.lexsort((s, c))]


def _nodes(words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    release()
    for b in batches:
        n, s1, s2 = [], [], []
        for s in sets_of(b["text"], words):
            x, y = named(s)
            n.append(len(s)), s1.append(x), s2.append(y)
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["digest"], *[pa.array(x, pa.int64()) for x in (n, s1, s2)]], ["doc_id", "digest", "n", "s1", "s2"])


SLICE = 1 << 12


def _sketched(words: int, bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << bits, "u4")
    for b in batches:
        for s in sets_of(b["text"], words):
            np.add.at(counts, (s >> np.uint64(64 - bits)).astype("i8"), np.uint32(1))
    yield from _slices(counts)


def _slices(counts: np.ndarray) -> Iterator[pa.RecordBatch]:
    parts = counts.reshape(-1, SLICE) if len(counts) > SLICE else counts[None]
    yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary())], ["slice", "counts"])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[int, np.ndarray] = {}
    for b in batches:
        for k, x in zip(b["slice"].to_pylist(), b["counts"].to_pylist(), strict=True):
            a = np.frombuffer(x, "u4")
            held[k] = held[k] + a if k in held else a
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["slice", "counts"])


def sketch(docs: DataFrame, words: int, n_docs: int) -> tuple[np.ndarray, int]:
    """Approximate numbers of documents by shingle hash, over all documents. Its size follows theirs up to 2 ** 22 counters (16 MB)."""
    bits = min(22, max(12, int(n_docs).bit_length() + 1))
    parts = max(1, (1 << bits) // SLICE // 16)
    found = docs.mapInArrow(partial(_sketched, words, bits), "slice int, counts binary").repartition(parts, "slice").mapInArrow(_summed, "slice int, counts binary").collect()
    counts = np.zeros(1 << bits, "u4")
    for r in found:
        part = np.frombuffer(r["counts"], "u4")
        counts[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    return counts, bits


def _prefixes(words: int, num: int, den: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts, bits = shared.value
    for b in batches:
        s1, s2, n, tokens = [], [], [], []
        for s in sets_of(b["text"], words):
            k = len(s)
            if k and den * k >= num * (k + 1):  # else only an equal set is near enough
                x, y = named(s)
                s1.append(x), s2.append(y), n.append(k)
                tokens.append(order_keys(s, counts, bits, 0)[: prefix_size(k, num, den)].view("i8"))
        flat = np.concatenate(tokens) if tokens else np.empty(0, "i8")
        lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(t) for t in tokens])], pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([*[pa.array(x, pa.int64()) for x in (s1, s2, n)], lists], ["s1", "s2", "n", "tokens"])


PAIR = ["star", "a1", "a2", "b1", "b2", "na", "nb"]
PAIR_DDL = "star boolean, a1 long, a2 long, b1 long, b2 long, na long, nb long"


def _paired(num: int, den: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within the runs of equal tokens of a sorted partition; stars of runs over HOT, however long, of which only the first row is held."""

    def out(star: bool, x: np.ndarray, y: np.ndarray) -> pa.RecordBatch:
        """x, y: rows (s1, s2, n)."""
        swap = (x[:, 0] > y[:, 0]) | (x[:, 0] == y[:, 0]) & (x[:, 1] > y[:, 1])
        a, b = np.where(swap[:, None], y, x), np.where(swap[:, None], x, y)
        columns = (a[:, 0], a[:, 1], b[:, 0], b[:, 1], a[:, 2], b[:, 2])
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(a), star)), *[pa.array(np.ascontiguousarray(c)) for c in columns]], PAIR)

    def closed(token: np.ndarray, rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        starts = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
        sizes = np.diff(np.r_[starts, len(token)])
        big = sizes > HOT
        if big.any():
            at = np.flatnonzero(np.repeat(big, sizes))
            lead = np.repeat(starts, sizes)[at]
            yield out(True, rows[lead[at != lead]], rows[at[at != lead]])
        small = np.repeat(~big & (sizes > 1), sizes)
        token, rows = token[small], rows[small]
        for k in range(1, HOT):
            same = np.flatnonzero(token[k:] == token[:-k])
            if not len(same):
                break
            x, y = rows[same], rows[same + k]
            ok = (den * np.minimum(x[:, 2], y[:, 2]) >= num * np.maximum(x[:, 2], y[:, 2])) & ((x[:, 0] != y[:, 0]) | (x[:, 1] != y[:, 1]))
            if ok.any():
                yield out(False, x[ok], y[ok])

    held_t, held_r = np.empty(0, "i8"), np.empty((0, 3), "i8")
    hot, lead = None, None
    for b in batches:
        token = b["token"].to_numpy(zero_copy_only=False)
        rows = np.stack([b[c].to_numpy(zero_copy_only=False) for c in ("s1", "s2", "n")], axis=1)
        if hot is not None and len(token):
            k = int(np.searchsorted(token, hot, "right"))
            if k:
                yield out(True, np.repeat(lead, k, axis=0), rows[:k])
            token, rows = token[k:], rows[k:]
            if len(token):
                hot = None
        if not len(token):
            continue
        token, rows = np.r_[held_t, token], np.concatenate([held_r, rows])
        last = int(np.searchsorted(token, token[-1], "left"))
        if len(token) - last > HOT:
            hot, lead = int(token[-1]), rows[last : last + 1]
            yield out(True, np.repeat(lead, len(token) - last - 1, axis=0), rows[last + 1 :])
            held_t, held_r = token[:0], rows[:0]
        else:
            held_t, held_r = token[last:], rows[last:]
        if last:
            yield from closed(token[:last], rows[:last])
    if len(held_t):
        yield from closed(held_t, held_r)


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of the sets of one group."""
    n = len(sets)
    out = np.zeros((n, n), "i4")
    flat = np.concatenate(sets) if sets else np.empty(0, "u8")
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    by = np.argsort(flat, kind="stable")
    flat, owner = flat[by], owner[by]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.empty(0, "i8")
    sizes = np.diff(np.r_[starts, len(flat)])
    wide = sizes > 64
    shift = ~wide & (sizes > 1)
    rows = owner[np.repeat(shift, sizes)]
    token = np.repeat(np.arange(len(starts)), sizes)[np.repeat(shift, sizes)]
    cells = out.reshape(-1)
    for k in range(1, 64):
        same = np.flatnonzero(token[k:] == token[:-k])
        if not len(same):
            break
        np.add.at(cells, rows[same] * n + rows[same + k], 1)
    out += out.T
    picked = np.flatnonzero(wide)
    for k in range(0, len(picked), 2048):
        part = picked[k : k + 2048]
        m = np.zeros((n, len(part)), "f4")
        for j, t in enumerate(part):
            m[owner[starts[t] : starts[t] + sizes[t]], j] = 1
        out += (m @ m.T).astype("i4")
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def links_of(sets: list[np.ndarray], counts: np.ndarray, bits: int, num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with similarity of num / den or more."""
    alive = np.arange(len(sets))
    size = np.array([len(s) for s in sets], "i8")

    def bounds(of: np.ndarray, extra) -> np.ndarray:
        """Pairs whose shared prefix tokens and what lies behind the prefixes suffice."""
        n = size[of]
        need = ceil_div(num * (n[:, None] + n[None]), num + den)
        return extra(n) >= need

    for k in range(1, ORDERS):
        if len(alive) < 2:
            return []
        heads = [order_keys(sets[i], counts, bits, k)[: prefix_size(int(size[i]), num, den)] for i in alive]
        shared = overlaps(heads)
        rest = size[alive] - prefix_size(size[alive], num, den)
        ok = bounds(alive, lambda n, c=shared, r=rest: c + np.maximum(r[:, None], r[None])) & (shared > 0)
        np.fill_diagonal(ok, False)
        alive = alive[ok.any(axis=1)]
    if len(alive) < 2:
        return []
    both = overlaps([sets[i] for i in alive])
    n = size[alive]
    ok = den * both >= num * (n[:, None] + n[None] - both)
    root = list(range(len(alive)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    found = []
    for x, y in np.argwhere(np.triu(ok, 1)).tolist():
        a, b = find(x), find(y)
        if a != b:
            root[b] = a
            found.append((int(alive[x]), int(alive[y])))
    return found


def _verified(words: int, num: int, den: int, shared, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of the groups (g1, g2, i, j) of a sorted partition."""
    counts, bits = shared.value
    group, names, sets = None, [], []

    def closed() -> Iterator[pa.RecordBatch]:
        if found := links_of(sets, counts, bits, num, den):
            a, b = ([names[p[k]] for p in found] for k in (0, 1))
            columns = ([x[0] for x in a], [x[1] for x in a], [x[0] for x in b], [x[1] for x in b])
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a1", "a2", "b1", "b2"])

    for b in batches:
        keys = zip(*(b[c].to_pylist() for c in ("g1", "g2", "i", "j")), strict=True)
        want = zip(b["s1"].to_pylist(), b["s2"].to_pylist(), strict=True)
        for key, name, s in zip(keys, want, sets_of(b["text"], words), strict=True):
            if key != group:
                yield from closed()
                group, names, sets = key, [], []
            if named(s) == name and name not in names[-1:]:
                names.append(name), sets.append(s)
    yield from closed()


def sized(df: DataFrame, bytes_a_row: int) -> DataFrame:
    """df (checkpointed) as a side to broadcast if it measures at most BROADCAST_BYTES, else as the built side of a shuffled join."""
    return F.broadcast(df) if df.count() * bytes_a_row <= BROADCAST_BYTES else df.hint("shuffle_hash")


def linked_sets(docs: DataFrame, words: int, num: int, den: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Per row of docs its set of shingles (doc_id, digest, n, s1, s2); each set's smallest doc_id and its copies; and the sets with a similar one, by component (s1, s2, root)."""
    sc, conf = small_batches(docs).sparkSession.sparkContext, docs.sparkSession.conf
    parts = int(conf.get("spark.sql.shuffle.partitions"))
    d = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    nodes = cut(d.withColumn("digest", F.xxhash64("text")).mapInArrow(partial(_nodes, words), "doc_id long, digest long, n long, s1 long, s2 long"))
    shared = sc.broadcast(sketch(d, words, nodes.count()))
    heads = d.mapInArrow(partial(_prefixes, words, num, den, shared), "s1 long, s2 long, n long, tokens array<long>").dropDuplicates(["s1", "s2"])
    tokens = heads.select(F.explode("tokens").alias("token"), "s1", "s2", "n").repartition(parts, "token").sortWithinPartitions("token", "s1", "s2")
    pairs = tokens.mapInArrow(partial(_paired, num, den), PAIR_DDL).groupBy(*PAIR).count()
    rest = lambda c: F.expr(f"cast(ceil({num} * {c} / {den}) as long) - 1")  # noqa: E731  shingles behind the prefix
    need = f"ceil({num} * (na + nb) / {num + den})"
    node = lambda x: F.struct(F.col(f"{x}1").alias("s1"), F.col(f"{x}2").alias("s2")).alias(x)
    near = pairs.where(F.col("star") | (F.col("count") + F.greatest(rest("na"), rest("nb")) >= F.expr(need)))
    clusters = components(near.select(node("a"), node("b"))).select("node.s1", "node.s2", F.col("root.s1").alias("g1"), F.col("root.s2").alias("g2"))
    # A set's row is named by its doc_id and the digest of its text, since doc_ids may be null or repeated.
    first = F.min(F.struct("doc_id", "digest")).alias("first")
    own = cut(nodes.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"), first))
    members = cut(own.join(sized(clusters, 48), ["s1", "s2"]))
    held = members.groupBy("g1", "g2").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks")).where("blocks > 1")
    members = members.join(sized(cut(held), 32), ["g1", "g2"], "left").select("g1", "g2", "s1", "s2", F.col("first.doc_id").alias("__d"), F.col("first.digest").alias("__g"), F.coalesce("blocks", F.lit(1)).alias("blocks"))
    dealt = d.join(sized(cut(members), 72), F.col("doc_id").eqNullSafe(F.col("__d")) & (F.xxhash64("text") == F.col("__g")))
    dealt = dealt.withColumn("b", F.pmod("s1", "blocks").cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("g1", "g2", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "s1", "s2", "text")
    dealt = dealt.repartition(parts, "g1", "g2", "i", "j").sortWithinPartitions("g1", "g2", "i", "j", "s1", "s2")
    links = dealt.mapInArrow(partial(_verified, words, num, den, shared), "a1 long, a2 long, b1 long, b2 long")
    linked = components(links.select(node("a"), node("b"))).select("node.s1", "node.s2", "root")
    shared.destroy()  # components are checkpointed: nothing reads the sketch again
    return nodes, own, linked


def labelled(nodes: DataFrame, found: DataFrame, rows: int) -> DataFrame:
    """nodes with component_id: that of their set in found (s1, s2, copies, component_id), else their own doc_id.

    If found measures more than BROADCAST_BYTES, sets with very many copies, of which there are at most HOT_SETS, are looked up apart, so that no task gets all
    copies of a text, and nodes without shingles in no join at all.
    """
    own = F.col("doc_id").alias("own")
    if found.count() * 40 <= BROADCAST_BYTES:
        out = nodes.join(F.broadcast(found.drop("copies")), ["s1", "s2"], "left")
        return out.withColumn("component_id", F.when(F.col("n") > 0, F.coalesce("component_id", own)).otherwise(own))
    many = F.col("copies") > max(1, rows // HOT_SETS)
    hot, rest = F.broadcast(found.where(many).drop("copies")), found.where(~many).drop("copies").hint("shuffle_hash")
    full = nodes.where("n > 0")
    apart = full.join(hot, ["s1", "s2"])
    others = full.join(hot, ["s1", "s2"], "left_anti").join(rest, ["s1", "s2"], "left").withColumn("component_id", F.coalesce("component_id", own))
    return apart.unionByName(others).unionByName(nodes.where("n = 0").withColumn("component_id", own))


def join(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (the smallest doc_id reachable over pairs with Jaccard similarity of num / den or more)."""
    nodes, own, linked = linked_sets(docs, words, num, den, doc_id, text)
    at = own.join(sized(linked, 32), ["s1", "s2"], "left").select("s1", "s2", "copies", "doc_id", "root")
    least = at.where(F.col("root").isNotNull()).groupBy("root").agg(F.min("doc_id").alias("least"))
    found = at.join(sized(cut(least), 24), "root", "left").where("least is not null or copies > 1")
    found = cut(found.select("s1", "s2", "copies", F.coalesce("least", "doc_id").alias("component_id")))
    return labelled(nodes, found, nodes.count()).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def representatives(docs: DataFrame, words: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """docs, one row of each component: the first by doc_id (null last), then by text digest. Documents without words all stay.

    Rows are told apart by doc_id and text, so a doc_id may come with several texts; of rows that repeat both, the first by their other columns stays.
    """
    d, g = free(docs, "__d", "__g")
    nodes, _, linked = linked_sets(docs, words, num, den)
    rows = cut(nodes.where("n > 0").groupBy("doc_id", "digest", "s1", "s2").count())
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "digest")).alias("first")
    sets = rows.groupBy("s1", "s2").agg(first).join(sized(linked, 32), ["s1", "s2"], "left")
    kept = sets.groupBy(F.coalesce("root", F.struct("s1", "s2")).alias("root")).agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias(d), F.col("first.digest").alias(g))
    is_kept = F.col("doc_id").eqNullSafe(F.col(d)) & (F.col("digest") == F.col(g))
    named_rows = rows.select(F.col("doc_id").alias(d), F.col("digest").alias(g), "count")
    found = cut(rows.join(kept, is_kept, "left_anti").select(F.col("doc_id").alias(d), F.col("digest").alias(g)))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64("text") == F.col(g))
    out = docs.join(sized(found, 24), same, "left_anti")
    repeated = cut(named_rows.where("count > 1").drop("count"))
    if repeated.isEmpty():
        return out
    # Few rows: of a repeated doc_id and text, one; all columns go through the aggregate as one value.
    others = F.to_json(F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]))
    whole = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), others).alias("__row")
    one = out.join(sized(repeated, 24), same, "left_semi").groupBy(F.col("doc_id").alias(d), F.xxhash64("text").alias(g)).agg(whole).select("__row.*")
    return out.join(sized(repeated, 24), same, "left_anti").unionByName(one)
