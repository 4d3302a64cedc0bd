"""Connected components and breadth-first levels of edge tables, without bringing edges or labels to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twigspark.functions.durable import cut

#: Edges that are left to one task: some MB at most. More rounds over so few rows would be all scheduling.
FEW = 100_000


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, up) of at most FEW edges: each node's root."""
    up: dict = {}
    given: dict = {}
    kind = None

    def root(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def key(x):
        return tuple(map(key, x.values())) if isinstance(x, dict) else x

    for batch in batches:
        kind = batch["a"].type
        for ends in zip(batch["a"].to_pylist(), batch["b"].to_pylist(), strict=True):
            for x in ends:
                given.setdefault(key(x), x)
            a, b = (root(up.setdefault(k, k)) for k in map(key, ends))
            up[max(a, b)] = min(a, b)
    if kind is not None:
        yield pa.RecordBatch.from_arrays([pa.array(given.values(), kind), pa.array([given[root(x)] for x in given], kind)], ["node", "up"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Each round points every node at its smallest neighbour if that is smaller, follows pointers twice, and contracts the
    edges, so nodes with hashed names shrink by a constant factor a round and a star of any size goes in one. As soon as no more
    than FEW edges are left, one task unites them.
    Tables of a round are checkpointed; joins on a hub's key are left to AQE's skew splitting.
    """
    e = cut(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    label = None

    def composed(p: DataFrame) -> DataFrame:
        """Labels after the step p (node, up)."""
        if label is None:
            return cut(p.select("node", F.col("up").alias("root")))
        step = p.select(F.col("node").alias("root"), "up")
        return cut(label.join(step, "root", "left").select("node", F.coalesce("up", "root").alias("root")))

    while (left := e.count()) > FEW:
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        p = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("up"))
        for _ in range(2):
            q = p.select(F.col("node").alias("up"), F.col("up").alias("further"))
            p = p.join(q, "up").select("node", F.col("further").alias("up"))
        p = cut(p)
        label = composed(p)
        for c in ("a", "b"):
            e = e.join(p.select(F.col("node").alias(c), "up"), c).drop(c).withColumnRenamed("up", c)
        e = cut(e.select("a", "b").where(F.col("a") != F.col("b")).distinct())
    if left:
        kind = e.schema["a"].dataType
        label = composed(e.coalesce(1).mapInArrow(_united, T.StructType([T.StructField("node", kind), T.StructField("up", kind)])))
    return label if label is not None else e.select(F.col("a").alias("node"), F.col("b").alias("root"))


def levels(nodes: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(node, level): steps from the nearest root over undirected edges (a, b); -1 where none reaches.

    The frontier expands by a join and drops what was seen by an anti join, so cycles end the search by themselves.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = front = cut(roots.select("node").distinct().withColumn("level", F.lit(0)))
    while True:
        front = cut(front.join(both, F.col("node") == F.col("a")).select(F.col("b").alias("node"), (F.col("level") + 1).alias("level")).distinct().join(seen.select("node"), "node", "left_anti"))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
    return nodes.select("node").join(seen, "node", "left").select("node", F.coalesce("level", F.lit(-1)).alias("level"))
