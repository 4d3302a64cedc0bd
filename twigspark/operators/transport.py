"""Optimal transport of load along the skeleton: Sinkhorn divergence between loads on an image's nodes, similarity. A kernel holds the distances between the nodes of one image, whose number is a parameter."""

from __future__ import annotations

import heapq
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigspark.functions.durable import cut
from twigspark.operators.geodesic import contracted, distances, pixel_edges
from twigspark.operators.heat import sampled
from twigspark.operators.joins import apart, nearest


def geodesic(xy: np.ndarray, sources: np.ndarray, gap: float) -> np.ndarray:
    """Shortest paths from sources over pixel pairs at most gap apart; unreachable ones count twice the largest distance."""
    cells: dict[tuple[int, int], list[int]] = {}
    for k, (a, b) in enumerate(np.floor(xy / gap).astype(int).tolist()):
        cells.setdefault((a, b), []).append(k)
    near: list[list[tuple[int, float]]] = [[] for _ in xy]
    for (a, b), own in cells.items():
        other = [k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((a + i, b + j), ())]
        d = np.sqrt(((xy[own][:, None] - xy[other][None]) ** 2).sum(axis=2))
        for r, p in enumerate(own):
            near[p] = [(other[c], float(d[r, c])) for c in np.flatnonzero(d[r] <= gap) if other[c] != p]
    out = np.full((len(sources), len(xy)), np.inf)
    for r, s in enumerate(sources.tolist()):
        best, heap = out[r], [(0.0, s)]
        best[s] = 0
        while heap:
            d, p = heapq.heappop(heap)
            if d > best[p]:
                continue
            for q, w in near[p]:
                if d + w < best[q]:
                    best[q] = d + w
                    heapq.heappush(heap, (d + w, q))
    finite = out[np.isfinite(out)]
    out[~np.isfinite(out)] = 2 * (finite.max() if finite.size else 1.0)
    return out


#: Largest sum of differences between a converged plan's masses and those asked for, of a total of 1, that from which on a plan is called unconverged, and rounds at most: where mass has to cross between parts that no path joins, plans converge
#: ever more slowly.
TOLERANCE, UNCONVERGED, MOST = 1e-9, 1e-6, 20_000


def plan(a: np.ndarray, b: np.ndarray, d: np.ndarray, reg: float, rounds: int = 400) -> tuple[float, float]:
    """(cost, difference of the masses) of the entropic plan between two masses, NaN where one is empty. At least so many rounds are made, and more until the plan's masses are a and b or come no closer to them."""
    if a.sum() <= 0 or b.sum() <= 0:
        return float("nan"), float("nan")
    a, b = a / a.sum(), b / b.sum()
    k = np.maximum(np.exp(-d / reg), 1e-300)
    v = np.ones_like(b)
    last, made = np.inf, 0
    while True:
        for _ in range(rounds):
            u = a / np.maximum(k @ v, 1e-300)
            v = b / np.maximum(k.T @ u, 1e-300)
        off, made = float(np.abs(u * (k @ v) - a).sum()), made + rounds
        if not TOLERANCE < off < last or made >= MOST:
            break
        last = off
    return float((u[:, None] * k * v[None] * d).sum()), off


def sinkhorn(a: np.ndarray, b: np.ndarray, d: np.ndarray, reg: float, rounds: int = 400) -> float:
    return plan(a, b, d, reg, rounds)[0]


def divergence(a: np.ndarray, b: np.ndarray, d: np.ndarray, reg: float, rounds: int = 400) -> float:
    """Debiased: zero for equal masses, never negative."""
    w = sinkhorn(a, b, d, reg, rounds) - sinkhorn(a, a, d, reg, rounds) / 2 - sinkhorn(b, b, d, reg, rounds) / 2
    return max(w, 0.0) if np.isfinite(w) else float("nan")


def repaired(d: np.ndarray) -> np.ndarray:
    """Distances with twice the largest finite one where no path leads."""
    finite = d[np.isfinite(d)]
    return np.where(np.isfinite(d), d, 2 * (finite.max() if finite.size else 1.0))


COMPARED = "image_id long, method string, wasserstein_px double, wasserstein_cm double, diameter_px double, diameter_cm double, similarity double, reg double, nodes long, note string"
#: Kinds of rows that the kernel gets: a node, the truth's mass on it, a method's mass on it.
NODE, TRUTH, METHOD = range(3)


def _compared(rounds: int, loads: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """One distance matrix an image for all of its methods; a method that fails gets a note instead of a score."""
    of = loads[loads["kind"] == NODE].sort_values("ord")
    ords = of["ord"].to_numpy()
    if not len(ords):
        return pd.DataFrame(columns=[x.split()[0] for x in COMPARED.split(", ")])
    scale = float(of["mass"].iloc[0])
    d = repaired(distances(ords, edges["a"].to_numpy(), edges["b"].to_numpy(), edges["w"].to_numpy()))
    positive = d[d > 0]
    reg, diameter = float(np.median(positive)) * 0.05 if positive.size else 1.0, float(d.max())

    def onto(rows: pd.DataFrame) -> np.ndarray:
        return np.bincount(np.searchsorted(ords, rows["ord"].to_numpy()), rows["mass"].to_numpy(float), len(ords))

    a, own, out = onto(loads[loads["kind"] == TRUTH]), None, []
    for method, rows in loads[loads["kind"] == METHOD].groupby("method"):
        w, note = float("nan"), ""
        try:
            own = plan(a, a, d, reg, rounds) if own is None else own
            b = onto(rows)
            between, other = plan(a, b, d, reg, rounds), plan(b, b, d, reg, rounds)
            w = between[0] - own[0] / 2 - other[0] / 2
            note = "no mass" if not np.isfinite(w) else "unconverged" if max(between[1], own[1], other[1]) > UNCONVERGED else ""
        except (ValueError, FloatingPointError, MemoryError) as e:
            note = f"W_ERR:{type(e).__name__}"
        w = max(w, 0.0) if np.isfinite(w) else float("nan")
        similarity = float(np.clip(1 - w / max(diameter, 1e-12), 0, 1)) if np.isfinite(w) else float("nan")
        out.append((of["image_id"].iloc[0], method, w, w / scale, diameter, diameter / scale, similarity, reg, len(ords), note))
    return pd.DataFrame(out, columns=[x.split()[0] for x in COMPARED.split(", ")])


def compared(truth: DataFrame, fields: DataFrame, pixels: DataFrame, scale: DataFrame | None = None, nodes: int = 600, gap: float = 3.0, rounds: int = 400) -> DataFrame:
    """Per image and method: the transport along the skeleton from the truth's field (image_id, ord, heat) to each method's (and method), in pixels and in cm by scale (image_id, px_per_cm), and what part of the
    diameter it spares. Fields are summed onto about so many nodes an image; all methods of an image share its distances."""
    of = cut(sampled(pixels, nodes))
    home = nearest(pixels.select("image_id", F.col("ord").alias("id"), "x", "y"), of.withColumn("branch_id", F.lit(0).cast("long"))).select("image_id", F.col("id").alias("pixel"), "ord")

    def onto(field: DataFrame, kind: int, method) -> DataFrame:
        mass = field.withColumnRenamed("ord", "pixel").join(home, ["image_id", "pixel"]).withColumn("method", method)
        return mass.groupBy("image_id", "method", "ord").agg(F.sum("heat").alias("mass")).select("image_id", F.lit(kind).alias("kind"), "method", "ord", "mass")

    per_cm = of.join(scale, "image_id", "left") if scale is not None else of.withColumn("px_per_cm", F.lit(1.0))
    given = per_cm.select("image_id", F.lit(NODE).alias("kind"), F.lit(None).cast("string").alias("method"), "ord", F.coalesce("px_per_cm", F.lit(1.0)).alias("mass"))
    loads = given.unionByName(onto(truth, TRUTH, F.lit(None).cast("string"))).unionByName(onto(fields, METHOD, F.col("method")))
    edges = contracted(pixel_edges(pixels, gap), of)
    return apart(loads).cogroup(apart(edges)).applyInPandas(partial(_compared, rounds), COMPARED)


def transport_similarity(field_a: DataFrame, field_b: DataFrame, pixels: DataFrame, nodes: int = 600, gap: float = 3.0, rounds: int = 400) -> DataFrame:
    """Per image: Wasserstein distance of two heat fields along the skeleton, and 1 minus it over the diameter."""
    one = compared(field_a, field_b.withColumn("method", F.lit("b")), pixels, None, nodes, gap, rounds)
    return one.select("image_id", "wasserstein_px", "diameter_px", "similarity", "nodes")
