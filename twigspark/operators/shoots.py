"""Shoot reconstruction: cluster, fit, find the base, score, merge (first form) and region growing with rays (second form)."""

from __future__ import annotations

from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.operators import cluster, fit, joins, rays
from twigspark.operators.components import components

#: Fixed values, in centimetres or degrees unless named otherwise.
FIRST = {"eps": 4.0, "squeeze": 4.0, "gap": 7.0, "extension": 18.0, "tolerance_px": 6.0, "merge_angle": 20.0, "merge_lateral": 36.0, "merge_reach": 50.0, "curved_from": 10, "most_curved": 0.0012, "shortest": 8.0, "longest": 80.0, "fewest": 3, "most": 60}
SECOND = {"grow": 7.0, "grow_angle": 18.0, "seed": 6.0, "stride_px": 5.0, "normal_px": 6.0, "slack_px": 4.0, "basal_px": 30.0, "ray": 80.0, "tension": 0.25, "samples": 30, "merge_angle": 20.0, "merge_lateral": 36.0, "merge_reach": 50.0}


def _cliques(table: pd.DataFrame) -> pd.DataFrame:
    """Greedy groups of shoots, nearest pairs first: two groups join only if every pair between them is compatible."""
    pairs = table.dropna(subset=["b"]).sort_values(["centre_distance", "a", "b"])
    ok = {frozenset(p) for p in zip(pairs["a"], pairs["b"], strict=True)}
    group = {i: [i] for i in sorted(set(table["a"]) | set(pairs["b"]))}
    for a, b in zip(pairs["a"], pairs["b"], strict=True):
        x, y = group[a], group[b]
        if x is not y and all(frozenset((i, j)) in ok for i in x for j in y):
            x += y
            group |= dict.fromkeys(y, x)
    rows = [(table["image_id"].iloc[0], int(i), int(min(g)), len(g)) for i, g in group.items()]
    return pd.DataFrame(rows, columns=["image_id", "shoot_id", "group_id", "merged_from"])


def merge_groups(shoots: DataFrame, candidates: DataFrame) -> DataFrame:
    """(image_id, shoot_id, group_id, merged_from): candidates are plan rows; only an image's compatible pairs go through its greedy step."""
    alone = shoots.select("image_id", F.col("shoot_id").alias("a"))
    both = candidates.select("image_id", "a", "b", "centre_distance").unionByName(alone.withColumns({"b": F.lit(None).cast("long"), "centre_distance": F.lit(0.0)}))
    return both.groupBy("image_id").applyInPandas(_cliques, "image_id long, shoot_id long, group_id long, merged_from int")


def first_form(flowers: DataFrame, pixels: DataFrame, px_per_cm: float, p: dict = FIRST, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(shoots, assignments). Shoots carry their line, ends, base, branch, confidence and flags; every flower belongs to one."""
    s = px_per_cm
    labelled = cut(flowers.join(cluster.aniso_components(flowers, p["eps"] * s, p["squeeze"]), ["image_id", "id"]).withColumnRenamed("cluster", "shoot_id"))
    found = described(labelled, pixels, s, p)
    if merge:
        found = cut(found)
        near = fit.merge_candidates(found, "image_id", "shoot_id", p["merge_angle"], p["merge_lateral"] * s, p["merge_reach"] * s)
        groups = merge_groups(found, near)
        labelled = cut(labelled.join(groups, ["image_id", "shoot_id"]).withColumn("shoot_id", F.col("group_id")).drop("group_id"))
        count = labelled.groupBy("image_id", "shoot_id").agg(F.first("merged_from").alias("merged_from"))
        found = described(labelled.drop("merged_from"), pixels, s, p).join(count, ["image_id", "shoot_id"])
    found = cut(found)
    assigned = labelled.join(found.select("image_id", "shoot_id", "branch_id", "confidence"), ["image_id", "shoot_id"]).select("image_id", "id", "shoot_id", "branch_id", "confidence")
    return found, assigned


def described(labelled: DataFrame, pixels: DataFrame, s: float, p: dict = FIRST) -> DataFrame:
    """Shoot records of labelled flowers (image_id, shoot_id, x, y)."""
    f = fit.shoots(labelled, ["image_id", "shoot_id"], p["curved_from"], p["most_curved"])
    starts = f.select("image_id", F.col("shoot_id").alias("id"), F.col("bottom_x").alias("x"), F.col("bottom_y").alias("y"), F.col("bx").alias("dx"), F.col("by").alias("dy"))
    base = joins.marched(starts, pixels, p["gap"] * s, p["extension"] * s, p["tolerance_px"]).select("image_id", F.col("id").alias("shoot_id"), "found", "branch_id", F.col("tx").alias("base_x"), F.col("ty").alias("base_y"), F.col("distance").alias("base_distance"))
    r = f.join(base, ["image_id", "shoot_id"]).withColumn("length_cm", F.col("length_px") / s)
    sure = fit.confidence(F.col("rms"), F.col("found"), F.col("base_distance"), F.col("length_cm"), F.col("n"), p["eps"] * s, p["tolerance_px"], p["shortest"], p["longest"], p["fewest"], p["most"])
    return r.withColumns({"confidence": sure, "flag_too_short": F.col("length_cm") < p["shortest"], "flag_too_long": F.col("length_cm") > p["longest"], "flag_bad_count": (F.col("n") < p["fewest"]) | (F.col("n") > p["most"])})


def grown_labels(xy: np.ndarray, grow: float, angle: float, seed: float) -> np.ndarray:
    """Lines of any direction: seeds are the tightest free points with their nearest free neighbour; a line takes the free point within reach of a member that lies most along
    its axis, which is fitted again each time; what finds no partner stays alone."""
    n, out, least = len(xy), np.full(len(xy), -1), np.cos(np.radians(angle))
    if n == 0:
        return out
    gap = xy[:, None] - xy[None]
    d = np.sqrt((gap * gap).sum(axis=2))
    off = d + np.where(np.eye(n, dtype=bool), np.inf, 0)
    label = 0
    for s in np.argsort(off.min(axis=1), kind="stable"):
        if out[s] >= 0:
            continue
        free = np.where((out < 0) & (np.arange(n) != s), d[s], np.inf)
        mate = int(free.argmin())
        out[s] = label
        if free[mate] <= seed:
            out[mate] = label
            while True:
                own = np.flatnonzero(out == label)
                c = xy[own] - xy[own].mean(axis=0)
                axis = np.linalg.eigh(c.T @ c)[1][:, -1]
                dist = d[own]
                with np.errstate(divide="ignore", invalid="ignore"):
                    along = np.abs(gap[own] @ axis) / dist
                ok = (out < 0)[None] & (dist <= grow) & (dist >= 1e-9) & (along >= least)
                if not ok.any():
                    break
                score = np.where(ok, np.round(along, 12), -1.0)
                best = np.argwhere(score == score.max())
                pick = min(best.tolist(), key=lambda q: (dist[q[0], q[1]], q[1]))
                out[pick[1]] = label
        label += 1
    return out


def neighbours(xy: np.ndarray, reach: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """(others, distances) within reach of each point, in order of their numbers, by a grid of that width."""
    cells: dict[tuple[int, int], list[int]] = {}
    for k, (x, y) in enumerate(np.floor(xy / reach).astype("i8").tolist()):
        cells.setdefault((x, y), []).append(k)
    others, away = [np.zeros(0, "i8")] * len(xy), [np.zeros(0)] * len(xy)
    for (x, y), own in cells.items():
        around = np.sort(np.array([k for i in (-1, 0, 1) for j in (-1, 0, 1) for k in cells.get((x + i, y + j), ())]))
        for k in own:
            gap = xy[k] - xy[around]
            d = np.sqrt((gap * gap).sum(axis=1))
            ok = (d <= reach) & (around != k)
            others[k], away[k] = around[ok], d[ok]
    return others, away


def grown_sparsely(xy: np.ndarray, grow: float, angle: float, seed: float) -> np.ndarray:
    """grown_labels() with what is in reach of each point in place of all distances: a line carries the pairs of its members and the free points near them."""
    n, out, least = len(xy), np.full(len(xy), -1), np.cos(np.radians(angle))
    if n == 0:
        return out
    others, away = neighbours(xy, max(grow, seed, 1e-9))
    label = 0
    for s in np.argsort([d.min(initial=np.inf) for d in away], kind="stable"):
        if out[s] >= 0:
            continue
        out[s] = label
        free = np.where((out[others[s]] < 0) & (away[s] <= seed), away[s], np.inf)
        if len(free) and free.min() < np.inf:
            new = int(others[s][free.argmin()])
            out[new] = label
            own, pairs = [int(s)], [np.zeros((0, 2), "i8")]
            far = [np.zeros(0)]
            fresh = [int(s), new]
            while fresh:
                for m in fresh:
                    ok = (away[m] <= grow) & (away[m] >= 1e-9)
                    pairs.append(np.column_stack([np.full(ok.sum(), m), others[m][ok]]))
                    far.append(away[m][ok])
                own = sorted({*own, *fresh})
                p, d = np.concatenate(pairs), np.concatenate(far)
                left = out[p[:, 1]] < 0
                p, d = p[left], d[left]
                pairs, far, fresh = [p], [d], []
                c = xy[own] - xy[own].mean(axis=0)
                axis = np.linalg.eigh(c.T @ c)[1][:, -1]
                along = np.abs((xy[p[:, 0]] - xy[p[:, 1]]) @ axis) / d
                ok = along >= least
                if ok.any():
                    score = np.where(ok, np.round(along, 12), -1.0)
                    best = np.flatnonzero(score == score.max())
                    pick = best[np.lexsort((p[best, 1], d[best]))[0]]
                    fresh = [int(p[pick, 1])]
                    out[fresh[0]] = label
        label += 1
    return out


def _grown(grow: float, angle: float, seed: float, table: pd.DataFrame) -> pd.DataFrame:
    t = table.sort_values("id")
    own = grown_sparsely(t[["x", "y"]].to_numpy(float), grow, angle, seed)
    return pd.DataFrame({"image_id": t["image_id"], "id": t["id"], "first": t["id"].groupby(own).transform("min")})


#: Points of an image that one kernel grows; of larger ones, a component.
KERNEL_POINTS = 2048


def directional(flowers: DataFrame, grow: float, angle: float, seed: float) -> DataFrame:
    """(image_id, id, cluster) by directional region growing, a kernel an image. Points further apart than a line or a seed reaches never meet, so of images of many points each component of the graph of points in reach is grown by itself, in the order of its own seeds; clusters are numbered by their smallest id."""
    f = cut(flowers.select("image_id", "id", "x", "y"))
    run = lambda df, *by: df.groupBy("image_id", *by).applyInPandas(partial(_grown, grow, angle, seed), "image_id long, id long, first long")
    large = cut(f.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > KERNEL_POINTS).select("image_id"))
    if large.isEmpty():
        grown = run(joins.dealt(f))
    else:
        many = cut(f.join(large, "image_id", "left_semi"))
        node = lambda c: F.struct("image_id", F.col(c).alias("id"))
        # A little more than the reach, as the kernel compares roots.
        near = joins.radius_pairs(many, max(grow, seed, 1e-9) * (1 + 1e-9)).select(node("a").alias("a"), node("b").alias("b"))
        root = components(near).select("node.image_id", "node.id", F.col("root.id").alias("root"))
        parts = many.join(root, ["image_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
        grown = run(parts, "root").unionByName(run(joins.dealt(f.join(large, "image_id", "left_anti"))))
    grown = cut(grown)
    number = grown.select("image_id", "first").distinct().withColumn("cluster", (F.row_number().over(Window.partitionBy("image_id").orderBy("first")) - 1).cast("int"))
    return grown.join(number, ["image_id", "first"]).select("image_id", "id", "cluster")


def second_form(flowers: DataFrame, pixels: DataFrame, px_per_cm: float, p: dict = SECOND, merge: bool = True) -> tuple[DataFrame, DataFrame]:
    """(shoots, assignments) by region growing, rays and their competition; clusters that no ray hits hang on the nearest branch."""
    s = px_per_cm
    labelled = cut(flowers.join(directional(flowers, p["grow"] * s, p["grow_angle"], p["seed"] * s), ["image_id", "id"]))
    by = ["image_id", "cluster"]
    lines = fit.shoots(labelled, by)
    if merge:
        lines = cut(lines)
        near = fit.merge_candidates(lines, "image_id", "cluster", p["merge_angle"], p["merge_lateral"] * s, p["merge_reach"] * s)
        groups = merge_groups(lines.withColumnRenamed("cluster", "shoot_id"), near).select("image_id", F.col("shoot_id").alias("cluster"), "group_id")
        labelled = cut(labelled.join(groups, by).withColumn("cluster", F.col("group_id")).drop("group_id"))
        lines = fit.shoots(labelled, by)
    segments = cut(lines.select(*by, F.col("bottom_x").alias("ax"), F.col("bottom_y").alias("ay"), F.col("top_x").alias("bx"), F.col("top_y").alias("by")))
    origins = rays.local_normals(rays.thinned(pixels, p["stride_px"]), pixels, p["normal_px"])
    won = cut(rays.competed(origins, segments, p["ray"] * s, p["slack_px"], p["basal_px"]))
    hit = won.select(*by, "branch_id", F.lit(True).alias("found"), "ox", "oy", "hx", "hy", "score")
    none = F.lit(None).cast("double")
    rest = rays.unhit(segments, won, pixels).select("image_id", F.col("id").alias("cluster"), "branch_id", F.lit(False).alias("found"), F.col("tx").alias("ox"), F.col("ty").alias("oy"), none.alias("hx"), none.alias("hy"), F.lit(0.0).alias("score"))
    shoots = hit.unionByName(rest).join(segments, by)
    shoots = rays.smoothed(shoots.withColumns({"hx": F.coalesce("hx", "ax"), "hy": F.coalesce("hy", "ay"), "tx": F.col("bx"), "ty": F.col("by")}), p["tension"], p["samples"]).drop("tx", "ty")
    shoots = cut(shoots.withColumnRenamed("cluster", "shoot_id"))
    assigned = labelled.withColumnRenamed("cluster", "shoot_id").join(shoots.select("image_id", "shoot_id", "branch_id"), ["image_id", "shoot_id"]).select("image_id", "id", "shoot_id", "branch_id")
    return shoots, assigned
