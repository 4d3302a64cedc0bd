"""Shortest paths along skeletons between chosen pixels, without a row for every pixel that a path passes.

The pixels of an image that are at most a gap apart form a graph. Pixels that nobody asks about are eliminated: each pair of a pixel's neighbours gets an edge as long as the way through it, which leaves the
distances between all others as they are. A skeleton's pixels have few neighbours, so the graph shrinks to the chosen pixels. Images with more than FEW edges are eliminated by joins, a set of pixels of which no
two are neighbours at a time (those with the least neighbours around, by hash where equal), which takes a constant part of them a round; smaller ones, and what is left of large ones, go to a kernel each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigspark.functions.durable import kept
from twigspark.operators.joins import apart, radius_pairs

#: Edges of an image that one kernel takes, and neighbours up to which a pixel is eliminated by a join.
FEW, STAR = 100_000, 24


def pixel_edges(pixels: DataFrame, gap: float) -> DataFrame:
    """(image_id, a, b, w) of pixels (image_id, ord, x, y) at most gap apart, a < b."""
    return radius_pairs(pixels.select("image_id", F.col("ord").alias("id"), "x", "y"), gap).withColumnRenamed("distance", "w")


def _both(e: DataFrame) -> DataFrame:
    return e.select("image_id", F.col("a").alias("u"), F.col("b").alias("v"), "w").unionByName(e.select("image_id", F.col("b").alias("u"), F.col("a").alias("v"), "w"))


def contracted(edges: DataFrame, keep: DataFrame, few: int = FEW) -> DataFrame:
    """edges (image_id, a, b, w) with the same distances between the nodes of keep (image_id, ord), and at most few of them an image where elimination gets so far."""
    sizes = lambda e: e.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > few).select("image_id")
    edges = kept(edges)
    large = kept(sizes(edges))
    if large.isEmpty():
        return edges
    done = edges.join(large, "image_id", "left_anti")
    left = kept(edges.join(large, "image_id", "left_semi"))
    k = 0
    while not left.isEmpty():
        k += 1
        both = _both(left)
        degree = both.groupBy("image_id", "u").agg(F.count("*").alias("n")).where(F.col("n") <= STAR)
        may = degree.join(keep.select("image_id", F.col("ord").alias("u")), ["image_id", "u"], "left_anti").withColumn("rank", F.struct("n", F.xxhash64("image_id", "u", F.lit(k)), "u")).select("image_id", "u", "rank")
        around = both.join(may.select("image_id", F.col("u").alias("v"), F.col("rank").alias("other")), ["image_id", "v"]).groupBy("image_id", "u").agg(F.min("other").alias("other"))
        out = kept(may.join(around, ["image_id", "u"], "left").where(F.col("other").isNull() | (F.col("rank") < F.col("other"))).select("image_id", "u"))
        if out.isEmpty():  # no pixel has few enough neighbours
            return done.unionByName(left)
        star = both.join(out, ["image_id", "u"])
        ways = star.join(star.select("image_id", "u", F.col("v").alias("v2"), F.col("w").alias("w2")), ["image_id", "u"]).where("v < v2").select("image_id", F.col("v").alias("a"), F.col("v2").alias("b"), (F.col("w") + F.col("w2")).alias("w"))
        rest = left
        for c in ("a", "b"):
            rest = rest.join(out.select("image_id", F.col("u").alias(c)), ["image_id", c], "left_anti")
        left = kept(rest.unionByName(ways).groupBy("image_id", "a", "b").agg(F.min("w").alias("w")))
        # Images that are small enough go on to their kernels; most rounds end none.
        small = kept(left.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") <= few).select("image_id"))
        if not small.isEmpty():
            done = done.unionByName(left.join(small, "image_id", "left_semi"))
            left = left.join(small, "image_id", "left_anti")
    return done


def distances(nodes: np.ndarray, a: np.ndarray, b: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Distances between all nodes over edges (a, b, w), infinite where no path leads: other ends are eliminated, those with the least neighbours first, then paths are closed over the nodes."""
    at = {v: k for k, v in enumerate(nodes.tolist())}
    near: dict = {v: {} for v in at}
    for x, y, d in zip(a.tolist(), b.tolist(), w.tolist(), strict=True):
        p, q = near.setdefault(x, {}), near.setdefault(y, {})
        if x != y and d < p.get(y, np.inf):
            p[y] = q[x] = d
    heap = [(len(n), v) for v, n in near.items() if v not in at]
    heapq.heapify(heap)
    while heap:
        degree, v = heapq.heappop(heap)
        if v not in near or degree != len(near[v]):
            continue
        own = list(near.pop(v).items())
        for x, (p, d) in enumerate(own):
            row = near[p]
            del row[v]
            for q, e in own[:x]:
                if d + e < row.get(q, np.inf):
                    row[q] = near[q][p] = d + e
        for p, _ in own:
            if p not in at:
                heapq.heappush(heap, (len(near[p]), p))
    out = np.full((len(at),) * 2, np.inf)
    np.fill_diagonal(out, 0)
    for v, k in at.items():
        for q, d in near[v].items():
            out[k, at[q]] = d
    for k in range(len(at)):
        reached = np.flatnonzero(np.isfinite(out[k]))
        if len(reached) > 1:
            part = np.ix_(reached, reached)
            out[part] = np.minimum(out[part], out[reached, k][:, None] + out[k, reached])
    return out


def _between(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    ords = np.unique(nodes["ord"].to_numpy())
    d = distances(ords, edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy())
    i, j = np.nonzero(np.triu(np.isfinite(d), 1))
    return pd.DataFrame({"image_id": nodes["image_id"].iloc[0] if len(nodes) else pd.Series(dtype="i8"), "a": ords[i], "b": ords[j], "distance": d[i, j]})


def geodesics(pixels: DataFrame, nodes: DataFrame, gap: float = 3.0, few: int = FEW) -> DataFrame:
    """(image_id, a, b, distance) between nodes (image_id, ord) a < b over pixels at most gap apart; pairs that no path joins have no row."""
    edges = contracted(pixel_edges(pixels, gap), nodes, few)
    return apart(nodes.select("image_id", "ord")).cogroup(apart(edges)).applyInPandas(_between, "image_id long, a long, b long, distance double")
