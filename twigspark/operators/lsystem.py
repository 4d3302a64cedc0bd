"""Shoots as L-Systems: a forward model of internodes with constant turning, fitted to clusters of flowers."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.operators import cluster, joins

#: Centimetres, counts, and shares.
PRIORS = {"internode": 2.5, "gap": 9.0, "shortest": 30.0, "longest": 80.0, "fewest": 20, "most": 40, "spacing": 0.4, "eps": 7.5, "least": 3, "squeeze": 4.0, "residual": 1.0, "trials": 200, "ratio": 1.5}


def forward(shoots: DataFrame, internodes: int, base: int) -> DataFrame:
    """(…, node, x, y, flower) of shoots (x0, y0, theta, kappa, delta): node k lies delta further in direction theta + (k - 1) kappa; nodes past base carry flowers."""
    def node(k: Column) -> Column:
        turn = F.transform(F.sequence(F.lit(0), F.lit(internodes - 1)), lambda i: F.when(i < k, F.col("delta") * F.cos(F.col("theta") + i * F.col("kappa"))).otherwise(0.0))
        rise = F.transform(F.sequence(F.lit(0), F.lit(internodes - 1)), lambda i: F.when(i < k, F.col("delta") * F.sin(F.col("theta") + i * F.col("kappa"))).otherwise(0.0))
        add = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
        return F.struct(k.alias("node"), (F.col("x0") + add(turn)).alias("x"), (F.col("y0") + add(rise)).alias("y"), (k > base).alias("flower"))

    return shoots.withColumn("n", F.explode(F.transform(F.sequence(F.lit(0), F.lit(internodes)), node))).select("*", "n.node", "n.x", "n.y", "n.flower").drop("n")


def validated(t: DataFrame, by: list[str], px_per_cm: float, p: dict = PRIORS) -> DataFrame:
    """Per shoot, from places t along its axis: median spacing, length with the basal gap, score and whether all priors hold. It discards nothing."""
    w = Window.partitionBy(*by).orderBy("t")
    s = t.withColumn("space", (F.col("t") - F.lag("t").over(w)) / px_per_cm)
    a = s.groupBy(*by).agg(F.count("*").alias("n"), F.percentile("space", 0.5).alias("spacing_cm"), ((F.max("t") - F.min("t")) / px_per_cm + p["gap"]).alias("length_cm"))
    long, count = F.col("length_cm").between(p["shortest"], p["longest"]), F.col("n").between(p["fewest"], p["most"])
    off = F.abs(F.col("spacing_cm") - p["internode"]) / p["internode"]
    score = (1 - F.least(off, F.lit(1.0))) * (0.5 * long.cast("double") + 0.5 * count.cast("double"))
    single = F.col("n") < 2
    return a.withColumns({"ok": F.when(single, False).otherwise(long & count & (off <= p["spacing"])), "score": F.when(single, 0.0).otherwise(score)})


def path(p0: np.ndarray, theta: float, kappa: float, count: int, delta: float) -> np.ndarray:
    turn = theta + kappa * np.arange(count)
    return p0 + delta * np.cumsum(np.stack([np.cos(turn), np.sin(turn)], axis=1), axis=0)


def consensus_axis(xy: np.ndarray, residual: float, trials: int, seed: int) -> np.ndarray:
    """Direction of the line through two points that most points lie near, refitted on those; the same trials each time."""
    r, best = np.random.default_rng(seed), None
    for _ in range(trials):
        i, j = r.choice(len(xy), 2, replace=False)
        d = xy[j] - xy[i]
        n = np.hypot(*d)
        if n < 1e-12:
            continue
        off = np.abs((xy - xy[i]) @ np.array([-d[1], d[0]]) / n)
        key = ((off <= residual).sum(), -off[off <= residual].sum())
        if best is None or key > best[0]:
            best = (key, off <= residual)
    inliers = xy if best is None else xy[best[1]]
    c = inliers - inliers.mean(axis=0)
    return np.linalg.eigh(c.T @ c)[1][:, -1]


def refined(seen: np.ndarray, start: np.ndarray, count: int, delta: float, base: int, rounds: int = 60) -> np.ndarray:
    """(x0, y0, theta, kappa) that bring the model's flowers onto the observed ones: damped Gauss-Newton on the analytic Jacobian."""
    def model(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.arange(count)
        turn = v[2] + v[3] * k
        c, s = delta * np.cos(turn), delta * np.sin(turn)
        at = v[:2] + np.stack([np.cumsum(c), np.cumsum(s)], axis=1)
        j = np.zeros((count, 2, 4))
        j[:, 0, 0] = j[:, 1, 1] = 1
        j[:, 0, 2], j[:, 1, 2] = -np.cumsum(s), np.cumsum(c)
        j[:, 0, 3], j[:, 1, 3] = -np.cumsum(k * s), np.cumsum(k * c)
        return (at[base:] - seen).ravel(), j[base:].reshape(-1, 4)

    v, damp = start.astype(float), 1e-3
    r, j = model(v)
    for _ in range(rounds):
        a = j.T @ j
        step = np.linalg.solve(a + damp * np.diag(np.diag(a) + 1e-9), -j.T @ r)
        new, jn = model(v + step)
        if new @ new < r @ r:
            done = r @ r - new @ new < 1e-10 * (1 + r @ r)
            v, r, j, damp = v + step, new, jn, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return v


def _fitted(delta: float, base: int, residual: float, trials: int, flowers: pd.DataFrame, pixels: pd.DataFrame) -> pd.DataFrame:
    rows, skeleton = [], pixels[["x", "y"]].to_numpy(float)
    reach = lambda p: ((skeleton - p) ** 2).sum(axis=1).min() if len(skeleton) else 0.0
    for label, g in flowers[flowers["cluster"] >= 0].sort_values("id").groupby("cluster"):
        xy = g[["x", "y"]].to_numpy(float)
        if len(xy) < 2:
            continue
        axis = consensus_axis(xy, residual, trials, int(label))
        order = np.argsort((xy - xy.mean(axis=0)) @ axis, kind="stable")
        if reach(xy[order[0]]) > reach(xy[order[-1]]):
            order = order[::-1]
        seen = xy[order]
        if (seen[-1] - seen[0]) @ axis < 0:
            axis = -axis
        start = np.r_[seen[0] - axis * base * delta, np.arctan2(axis[1], axis[0]), 0.0]
        v = refined(seen, start, base + len(seen), delta, base)
        t = (seen - v[:2]) @ np.array([np.cos(v[2]), np.sin(v[2])])
        rows += [(int(g["image_id"].iloc[0]), int(label), int(i), float(a), *map(float, v)) for i, a in zip(g["id"].to_numpy()[order], t, strict=True)]
    return pd.DataFrame(rows, columns=["image_id", "shoot_id", "id", "t", "x0", "y0", "theta", "kappa"])


def reconstruct(flowers: DataFrame, pixels: DataFrame, px_per_cm: float, p: dict = PRIORS) -> tuple[DataFrame, DataFrame]:
    """(shoots, assignments); every flower gets a branch: its shoot's, else that of the shoot with the nearest centre, else the nearest pixel's."""
    s = px_per_cm
    delta, base = p["internode"] * s, round(p["gap"] / p["internode"])
    labelled = cut(flowers.join(cluster.dbscan(flowers, p["eps"] * s, p["least"], p["squeeze"]), ["image_id", "id"]))
    fitted = joins.dealt(labelled).groupBy("image_id").cogroup(joins.dealt(pixels).groupBy("image_id")).applyInPandas(partial(_fitted, delta, base, p["residual"] * s, p["trials"]), "image_id long, shoot_id long, id long, t double, x0 double, y0 double, theta double, kappa double")
    fitted = cut(fitted)
    by = ["image_id", "shoot_id"]
    one = fitted.groupBy(*by).agg(*[F.first(c).alias(c) for c in ("x0", "y0", "theta", "kappa")])
    home = joins.two_nearest(one.select("image_id", F.col("shoot_id").alias("id"), F.col("x0").alias("x"), F.col("y0").alias("y")), pixels, p["ratio"]).withColumnRenamed("id", "shoot_id")
    shoots = cut(one.join(home, by).join(validated(fitted, by, s, p), by))
    inside = fitted.join(shoots.select(*by, "branch_id"), by).select("image_id", "id", "shoot_id", "branch_id")
    centres = labelled.join(inside.select("image_id", "id", "shoot_id", "branch_id"), ["image_id", "id"]).groupBy("image_id", F.col("shoot_id").alias("ord"), "branch_id").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    near = joins.rehomed(flowers, inside, centres).select("image_id", "id", F.col("ord").alias("shoot_id"), "branch_id")
    known = cut(inside.unionByName(near))
    last = joins.rehomed(flowers, known, pixels).select("image_id", "id", F.lit(-1).cast("long").alias("shoot_id"), "branch_id")
    return shoots, known.unionByName(last)
