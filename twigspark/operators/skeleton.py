"""Skeleton pixels to branches: tracing, de-duplication, filters and the trunk path. Kernels per image; inputs are sorted inside, so partitioning doesn't change results."""

from __future__ import annotations

from collections import Counter, deque
from functools import partial
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twigspark.operators.hierarchy import RING
from twigspark.operators.raster import thinned_sets


def _near(on: set, p: tuple) -> list[tuple]:
    return [q for dx, dy in RING if (q := (p[0] + dx, p[1] + dy)) in on]


def classified(on: set) -> tuple[list, list]:
    """Ends and junction pixels, in row order."""
    ends, forks = [], []
    for p in sorted(on, key=lambda q: (q[1], q[0])):
        hit = [(p[0] + dx, p[1] + dy) in on for dx, dy in RING]
        n, turns = sum(hit), sum(not hit[k] and hit[(k + 1) % 8] for k in range(8))
        if n == 1 and turns == 1:
            ends.append(p)
        elif turns >= 3 or n >= 3:
            forks.append(p)
    return ends, forks


def clustered(forks: list) -> dict:
    """Junction pixel to its cluster's representative: the member nearest to the truncated mean."""
    left, of = set(forks), {}
    for start in forks:
        if start not in left:
            continue
        left.discard(start)
        group, todo = [start], [start]
        while todo:
            for q in _near(left, todo.pop()):
                left.discard(q)
                group.append(q)
                todo.append(q)
        cx, cy = int(np.mean([p[0] for p in group])), int(np.mean([p[1] for p in group]))
        best = min(sorted(group), key=lambda p: (p[0] - cx) ** 2 + (p[1] - cy) ** 2)
        of |= dict.fromkeys(group, best)
    return of


def traced(on: set) -> list[dict]:
    """Branches between nodes (ends and junction clusters); at a choice the walk goes on as straight as it can."""
    ends, forks = classified(on)
    rep = clustered(forks) | {p: p for p in ends}
    used, out = set(), []
    for node in sorted(rep, key=lambda p: (p[1], p[0])):
        for first in _near(on, node):
            if first in rep and rep[first] == rep[node] or (node, first) in used:
                continue
            path, seen = [node, first], {node, first}
            used.add((node, first))
            while path[-1] not in rep:
                ways = [q for q in _near(on, path[-1]) if q not in seen and not (len(path) == 2 and q in rep and rep[q] == rep[node])]
                if not ways:
                    break
                back = path[-min(len(path), 5)]
                way = (path[-1][0] - back[0], path[-1][1] - back[1])
                straight = lambda q: -(way[0] * (q[0] - path[-1][0]) + way[1] * (q[1] - path[-1][1])) / np.hypot(q[0] - path[-1][0], q[1] - path[-1][1])  # noqa: E731, B023
                nodes = [q for q in ways if q in rep]
                nxt = min(sorted(nodes or ways), key=straight)
                path.append(nxt)
                seen.add(nxt)
            if path[-1] in rep:
                used.add((path[-1], path[-2]))
            out.append({"pixels": path, "src": rep[node], "dst": rep.get(path[-1], path[-1])})
    return out


def distinct_branches(branches: list[dict], overlap: float = 0.6) -> list[dict]:
    """Of branches that share more than overlap of the longer's pixels, the longer stays, in the place of the earlier one."""
    holders: dict[tuple, list[int]] = {}
    sizes = [len(set(b["pixels"])) for b in branches]
    for n, b in enumerate(branches):
        for p in set(b["pixels"]):
            holders.setdefault(p, []).append(n)
    both = Counter(pair for held in holders.values() for pair in combinations(held, 2))
    close = {(i, j) for (i, j), n in both.items() if n > overlap * max(sizes[i], sizes[j])}
    place: list[int] = []
    for n, size in enumerate(sizes):
        met = [k for k, m in enumerate(place) if (min(m, n), max(m, n)) in close]
        if not met:
            place.append(n)
        elif size > sizes[place[met[0]]]:
            place[met[0]] = n
    return [branches[n] for n in place]


def _traced(least: int, table: pd.DataFrame) -> pd.DataFrame:
    on = set(zip(table["x"].tolist(), table["y"].tolist(), strict=True))
    rows = [b for b in distinct_branches(traced(on)) if len(b["pixels"]) >= least]
    image = table["image_id"].iloc[0]
    out = [(image, k, n, x, y, *b["src"], *b["dst"]) for k, b in enumerate(rows) for n, (x, y) in enumerate(b["pixels"])]
    return pd.DataFrame(out, columns=["image_id", "branch_id", "ord", "x", "y", "src_x", "src_y", "dst_x", "dst_y"])


def branches(pixels: DataFrame, least: int = 5) -> DataFrame:
    """(image_id, branch_id, ord, x, y, src, dst) of traced branches with at least so many pixels."""
    return pixels.select("image_id", "x", "y").groupBy("image_id").applyInPandas(partial(_traced, least), "image_id long, branch_id long, ord long, x long, y long, src_x long, src_y long, dst_x long, dst_y long")


def branch_stats(traced_pixels: DataFrame) -> DataFrame:
    """Per branch: length, truncated centroid, its nodes' degrees and a type: isolated, terminal or internal."""
    ends = traced_pixels.groupBy("image_id", "branch_id").agg(F.count("*").alias("length"), F.avg("x").cast("int").alias("cx"), F.avg("y").cast("int").alias("cy"), F.first(F.struct("src_x", "src_y")).alias("src"), F.first(F.struct("dst_x", "dst_y")).alias("dst"))
    node = ends.select("image_id", F.explode(F.array(F.struct(F.col("src.src_x").alias("x"), F.col("src.src_y").alias("y")), F.struct(F.col("dst.dst_x").alias("x"), F.col("dst.dst_y").alias("y")))).alias("node"))
    degree = node.groupBy("image_id", "node").agg(F.count("*").alias("degree"))
    at = lambda c: degree.select("image_id", F.struct(F.col("node.x").alias(f"{c}_x"), F.col("node.y").alias(f"{c}_y")).alias(c), F.col("degree").alias(f"{c}_degree"))
    j = ends.join(at("src"), ["image_id", "src"]).join(at("dst"), ["image_id", "dst"])
    free = (F.col("src_degree") == 1).cast("int") + (F.col("dst_degree") == 1).cast("int")
    return j.select("image_id", "branch_id", "length", "cx", "cy", "src_degree", "dst_degree", F.when(free == 2, "isolated").when(free == 1, "terminal").otherwise("internal").alias("type"))


def pixel_owner(traced_pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, branch_id): the last branch that holds a pixel."""
    return traced_pixels.groupBy("image_id", "x", "y").agg(F.max("branch_id").alias("branch_id"))


def farthest(graph: dict, start) -> tuple[object, dict]:
    """The node farthest from start by first-in first-out relaxation of branch lengths, and each node's way there."""
    dist, way, todo = {start: 0.0}, {start: (None, None)}, deque([start])
    while todo:
        p = todo.popleft()
        for q, branch, length in graph[p]:
            if q not in dist:
                dist[q], way[q] = dist[p] + length, (p, branch)
                todo.append(q)
    return max(sorted(dist), key=lambda n: dist[n]), way


def _diameter(table: pd.DataFrame) -> pd.DataFrame:
    graph: dict = {}
    for r in table.sort_values("branch_id").itertuples():
        a, b = (r.src_x, r.src_y), (r.dst_x, r.dst_y)
        graph.setdefault(a, []).append((b, r.branch_id, r.length))
        graph.setdefault(b, []).append((a, r.branch_id, r.length))
    best: list = []
    left = set(graph)
    while left:
        a, way = farthest(graph, min(left))
        left -= set(way)
        b, way = farthest(graph, a)
        path = []
        while way[b][1] is not None:
            b, branch = way[b]
            path.append(branch)
        best = max(best, path, key=len)
    return pd.DataFrame({"image_id": table["image_id"].iloc[0], "branch_id": best, "step": range(len(best))})


def diameter(traced_pixels: DataFrame) -> DataFrame:
    """(image_id, branch_id, step): the branches of the longest path, by two passes; exact on trees."""
    ends = traced_pixels.groupBy("image_id", "branch_id").agg(F.count("*").alias("length"), *[F.first(c).alias(c) for c in ("src_x", "src_y", "dst_x", "dst_y")])
    return ends.groupBy("image_id").applyInPandas(_diameter, "image_id long, branch_id long, step long")


#: Pixels of a branch whose distances from each other are kept while they are chained.
PAIRED = 2048


def chain(xy: np.ndarray) -> np.ndarray:
    """Nearest-neighbour order from the pixel farthest from the centroid, ties to the first."""
    at, order = int(((xy - xy.mean(axis=0)) ** 2).sum(axis=1).argmax()), np.empty(len(xy), "i8")
    away = ((xy[:, None] - xy[None]) ** 2).sum(axis=2) if len(xy) <= PAIRED else None
    gone = np.zeros(len(xy), bool)
    for k in range(len(xy)):
        order[k], gone[at] = at, True
        if away is not None:
            away[:, at] = np.inf
            at = int(away[at].argmin())
        else:
            at = int(np.where(gone, np.inf, ((xy - xy[at]) ** 2).sum(axis=1)).argmin())
    return order


def _chained(table: pd.DataFrame) -> pd.DataFrame:
    t = table.sort_values("ord")
    out = t.iloc[chain(t[["x", "y"]].to_numpy(float))].copy()
    out["ord"] = range(len(out))
    return out[["image_id", "branch_id", "ord", "x", "y"]]


def chained(pixels: DataFrame) -> DataFrame:
    """Pixels of each branch in nearest-neighbour order from the one farthest from their centroid."""
    return pixels.select("image_id", "branch_id", "ord", "x", "y").groupBy("image_id", "branch_id").applyInPandas(_chained, "image_id long, branch_id long, ord long, x double, y double")


def axes_of(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, axis) of each branch of an image's pixels, in order of branches: its rows by ord, and its pixels, thinned, in nearest-neighbour order; of a branch that is too small to thin, its first pixel alone. Rows without a branch are left out."""
    table = table.append_column("__row", pa.array(np.arange(len(table)))).filter(pc.is_valid(table["branch_id"]))
    branch, order, row = (table[c].to_numpy() for c in ("branch_id", "ord", "__row"))
    x, y = (table[c].to_numpy().astype(float) for c in "xy")
    at = np.lexsort((y, x, order, branch))
    branch, x, y, row = branch[at], x[at], y[at], row[at]
    first = np.flatnonzero(np.r_[True, branch[1:] != branch[:-1]]) if len(branch) else np.zeros(0, "i8")
    many = np.diff(np.r_[first, len(branch)])
    large = np.repeat(many >= 3, many)
    of, px, py = np.repeat(np.arange(len(first)), many)[large], np.rint(x[large]).astype("i8"), np.rint(y[large]).astype("i8")
    at = np.lexsort((px, py, of))
    of, px, py = of[at], px[at], py[at]
    own = np.r_[True, (np.diff(of) != 0) | (np.diff(px) != 0) | (np.diff(py) != 0)] if len(of) else np.zeros(0, bool)
    of, px, py = of[own], px[own], py[own]
    left = thinned_sets(of, px, py)
    of, thin = of[left], np.column_stack([px, py])[left].astype(float)
    low, high = np.searchsorted(of, np.arange(len(first))), np.searchsorted(of, np.arange(len(first)), "right")
    out = []
    for k, (start, n) in enumerate(zip(first.tolist(), many.tolist(), strict=True)):
        xy = thin[low[k] : high[k]]
        out.append((row[start : start + n], xy[chain(xy)] if len(xy) >= 2 else np.array([[x[start], y[start]]])))
    return out


def _axes(table: pa.Table) -> pa.Table:
    found = axes_of(table)
    first = pa.array(np.array([rows[0] for rows, axis in found for _ in axis], "i8"))
    xy = np.concatenate([a for _, a in found]) if found else np.zeros((0, 2))
    order = pa.array(np.concatenate([np.arange(len(a)) for _, a in found]) if found else np.zeros(0, "i8"))
    return pa.Table.from_arrays([table["image_id"].take(first), table["branch_id"].take(first), order, pa.array(xy[:, 0]), pa.array(xy[:, 1])], ["image_id", "branch_id", "ord", "x", "y"])


def axes(pixels: DataFrame) -> DataFrame:
    """(image_id, branch_id, ord, x, y): each branch's medial axis, a pixel wide, in nearest-neighbour order. All branches of an image go to one kernel."""
    p = pixels.select("image_id", F.col("branch_id").cast("long").alias("branch_id"), F.col("ord").cast("long").alias("ord"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return p.groupBy("image_id").applyInArrow(_axes, T.StructType([T.StructField(f.name, f.dataType) for f in p.schema]))


def deduplicated_candidates(pixels: DataFrame, overlap: float = 0.6) -> DataFrame:
    """(image_id, a, b, share): branch pairs a < b that share more than overlap of the longer's pixels, by an equi-join on pixels."""
    p = pixels.select("image_id", "branch_id", "x", "y").distinct()
    n = p.withColumn("n", F.count("*").over(Window.partitionBy("image_id", "branch_id")))
    j = n.withColumnsRenamed({"branch_id": "a", "n": "na"}).join(n.withColumnsRenamed({"branch_id": "b", "n": "nb"}), ["image_id", "x", "y"]).where("a < b")
    return j.groupBy("image_id", "a", "b", "na", "nb").agg(F.count("*").alias("both")).select("image_id", "a", "b", (F.col("both") / F.greatest("na", "nb")).alias("share")).where(F.col("share") > overlap)
