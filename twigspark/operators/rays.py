"""Candidate shoots by rays cast from the skeleton."""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.functions.geometry import bezier, cell, principal_angle, rotated
from twigspark.operators.joins import dealt, in_kernels, nearest, radius_join, ray_hits


def thinned(pixels: DataFrame, stride: float = 5.0) -> DataFrame:
    """The first pixel (by ord) of each grid cell."""
    w = Window.partitionBy("image_id", cell("x", stride), cell("y", stride)).orderBy("ord")
    return pixels.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def local_normals(origins: DataFrame, pixels: DataFrame, reach: float = 6.0) -> DataFrame:
    """origins (image_id, ord, ...) with the unit normal (nx, ny) of the pixels within reach, pointing up; (0, -1) with fewer than two."""
    near = radius_join(origins.select("image_id", F.col("ord").alias("id"), "x", "y"), pixels, reach)
    a = near.groupBy("image_id", F.col("id").alias("ord")).agg(F.count("*").alias("n"), F.var_pop("tx").alias("sxx"), F.covar_pop("tx", "ty").alias("sxy"), F.var_pop("ty").alias("syy"))
    angle = principal_angle(F.col("sxx"), F.col("sxy"), F.col("syy"))
    nx, ny = -F.sin(angle), F.cos(angle)
    few = F.col("n") < 2
    a = a.select("image_id", "ord", F.when(few, 0.0).otherwise(F.when(ny > 0, -nx).otherwise(nx)).alias("nx"), F.when(few, -1.0).otherwise(F.when(ny > 0, -ny).otherwise(ny)).alias("ny"))
    return origins.join(a, ["image_id", "ord"])


def fan(centre: float = 45.0, low: float = 0.0, high: float = 90.0, step: float = 5.0) -> list[tuple[float, int]]:
    """(deviation, side) in the order of shooting: nearest to centre first, wider before narrower, positive side first."""
    count = int(max(high - centre, centre - low) / step + 1e-9)
    at = [centre, *[centre + s * k * step for k in range(1, count + 1) for s in (1, -1)]]
    return [(a, s) for a in at if low - 1e-9 <= a <= high + 1e-9 for s in (1, -1)]


def ray_fan(origins: DataFrame, **angles: float) -> DataFrame:
    """A row per origin and direction (dx, dy) that doesn't point down, with its place `turn` in the order of shooting."""
    table = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(float(a)).alias("deviation"), F.lit(float(s)).alias("side")) for k, (a, s) in enumerate(fan(**angles))])
    r = origins.withColumn("f", F.explode(table)).select("*", "f.turn", "f.deviation", "f.side").drop("f")
    dx, dy = rotated(F.col("nx"), F.col("ny"), F.col("side") * F.col("deviation"))
    return r.withColumns({"dx": dx, "dy": dy}).where(F.col("dy") <= 1e-6)


def extended(segments: DataFrame, slack: float) -> DataFrame:
    """segments (image_id, cluster, ax, ay basal, bx, by apical) lengthened by slack at both ends; sx, sy their unit direction, basal_x, basal_y the old end."""
    ex, ey = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    n = F.sqrt(ex * ex + ey * ey) + 1e-12
    s = segments.withColumns({"sx": ex / n, "sy": ey / n, "basal_x": F.col("ax"), "basal_y": F.col("ay")})
    return s.withColumns({"ax": F.col("ax") - slack * F.col("sx"), "ay": F.col("ay") - slack * F.col("sy"), "bx": F.col("bx") + slack * F.col("sx"), "by": F.col("by") + slack * F.col("sy")})


def winners(rays: DataFrame, segments: DataFrame, reach: float, slack: float = 4.0, basal: float = 30.0) -> DataFrame:
    """For each cluster the winning ray: of each origin the first direction that hits, of these the highest colinearity plus half the basal bonus, ties to the
    smaller origin (ord). A cluster that none hits has no row."""
    h = ray_hits(rays.withColumnsRenamed({"x": "ox", "y": "oy"}), extended(segments, slack), reach)
    first = Window.partitionBy("image_id", "cluster", "ord").orderBy("turn")
    h = h.withColumn("k", F.row_number().over(first)).where("k = 1")
    away = F.sqrt((F.col("hx") - F.col("basal_x")) * (F.col("hx") - F.col("basal_x")) + (F.col("hy") - F.col("basal_y")) * (F.col("hy") - F.col("basal_y")))
    colinear = F.abs(F.col("dx") * F.col("sx") + F.col("dy") * F.col("sy"))
    h = h.withColumns({"colinearity": colinear, "basal_bonus": F.exp(-away / max(basal, 1.0))}).withColumn("score", F.col("colinearity") + 0.5 * F.col("basal_bonus"))
    best = Window.partitionBy("image_id", "cluster").orderBy(F.col("score").desc(), "ord")
    return h.withColumn("k", F.row_number().over(best)).where("k = 1").drop("k")


#: Pairs of origins and clusters of an image whose rays one kernel compares; larger images go by cells.
KERNEL_PAIRS = 1 << 20


def _competed(reach: float, slack: float, basal: float, angles: dict[str, float], shape: pa.Schema, origins: pa.Table, segments: pa.Table) -> pa.Table:
    """What `winners` gives for one image: each direction of the fan in turn, from all origins against all clusters."""
    if not len(origins) or not len(segments):
        return shape.empty_table()
    column = lambda t, c: t[c].to_numpy().astype(float, copy=False)
    origins = origins.sort_by("ord")
    (x, y, nx, ny), (px, py, qx, qy) = ([column(t, c) for c in names] for t, names in ((origins, ("x", "y", "nx", "ny")), (segments, ("ax", "ay", "bx", "by"))))
    n = np.sqrt((qx - px) * (qx - px) + (qy - py) * (qy - py)) + 1e-12
    sx, sy = (qx - px) / n, (qy - py) / n
    ax, ay, bx, by = px - slack * sx, py - slack * sy, qx + slack * sx, qy + slack * sy
    known = np.all([np.abs(v) < 1e15 for v in (ax, ay, bx, by)], axis=0)
    ex, ey = bx - ax, by - ay
    best, at, hits = np.full(len(segments), -np.inf), np.zeros(len(segments), "i8"), np.zeros((2, len(segments)))
    step = max(1, KERNEL_PAIRS // 4 // len(segments))
    for low in range(0, len(origins), step):
        ox, oy, mx, my = (v[low : low + step, None] for v in (x, y, nx, ny))
        wx, wy = ax - ox, ay - oy
        along = wy * ex - wx * ey
        left = known & (np.abs(ox) < 1e15) & (np.abs(oy) < 1e15)
        score, hx, hy = (np.full(left.shape, -np.inf) for _ in range(3))
        for deviation, side in fan(**angles):
            c, s = math.cos(math.radians(side * deviation)), math.sin(math.radians(side * deviation))
            dx, dy = c * mx - s * my, s * mx + c * my
            det = dy * ex - dx * ey
            t, u = along / det, (dx * wy - dy * wx) / det
            i, k = np.nonzero(left & (dy <= 1e-6) & (np.abs(det) >= 1e-12) & (t >= 0) & (t <= reach) & (u >= 0) & (u <= 1))
            left[i, k] = False
            t, dx, dy = t[i, k], dx[i, 0], dy[i, 0]
            hx[i, k], hy[i, k] = ox[i, 0] + t * dx, oy[i, 0] + t * dy
            away = np.sqrt((hx[i, k] - px[k]) * (hx[i, k] - px[k]) + (hy[i, k] - py[k]) * (hy[i, k] - py[k]))
            score[i, k] = np.abs(dx * sx[k] + dy * sy[k]) + 0.5 * np.exp(-away / max(basal, 1.0))
        first = score.argmax(axis=0)
        k = np.flatnonzero(score.max(axis=0) > best)
        best[k], at[k], hits[:, k] = score[first[k], k], low + first[k], (hx[first[k], k], hy[first[k], k])
    k = np.flatnonzero(best > -np.inf)
    own = origins.take(pa.array(at[k]))
    return pa.Table.from_arrays([segments["image_id"].take(pa.array(k)), segments["cluster"].take(pa.array(k)), own["ord"], own["branch_id"], pa.array(x[at[k]]), pa.array(y[at[k]]), pa.array(hits[0, k]), pa.array(hits[1, k]), pa.array(best[k])], shape.names)


def competed(origins: DataFrame, segments: DataFrame, reach: float, slack: float = 4.0, basal: float = 30.0, **angles: float) -> DataFrame:
    """(image_id, cluster, ord, branch_id, ox, oy, hx, hy, score) of the winners of the fans of origins (with nx, ny): images of few pairs of origins and clusters go to a kernel each, so that only origins are shuffled; in larger ones rays meet
    clusters by cells."""
    of = lambda df, c: T.StructField(c, df.schema[c].dataType)
    shape = T.StructType([of(segments, "image_id"), of(segments, "cluster"), of(origins, "ord"), of(origins, "branch_id"), *[T.StructField(c, T.DoubleType()) for c in ("ox", "oy", "hx", "hy", "score")]])
    o, s = origins.select("image_id", "ord", "branch_id", "x", "y", "nx", "ny"), segments.select("image_id", "cluster", "ax", "ay", "bx", "by")
    n = lambda df, c: df.groupBy("image_id").agg(F.count("*").alias(c))
    large = cut(n(o, "o").join(n(s, "s"), "image_id").where(F.col("o") * F.col("s") > KERNEL_PAIRS).select("image_id"))
    kernel = partial(_competed, reach, slack, basal, angles)
    if large.isEmpty():
        return in_kernels(kernel, dealt(o), dealt(s), shape)
    few, many = ([df.join(large, "image_id", how) for df in (o, s)] for how in ("left_anti", "left_semi"))
    won = winners(ray_fan(many[0], **angles), many[1], reach, slack, basal).select(*shape.names)
    return in_kernels(kernel, *map(dealt, few), shape).unionByName(won)


def unhit(segments: DataFrame, won: DataFrame, pixels: DataFrame) -> DataFrame:
    """Clusters without a winner, attached to the branch nearest to their basal end."""
    left = segments.join(won.select("image_id", "cluster"), ["image_id", "cluster"], "left_anti")
    return nearest(left.select("image_id", F.col("cluster").alias("id"), F.col("ax").alias("x"), F.col("ay").alias("y")), pixels)


def smoothed(curves: DataFrame, tension: float = 0.25, samples: int = 30) -> DataFrame:
    """curves (ox, oy origin; hx, hy impact; tx, ty apex) with the array curve of samples points of a quadratic curve whose control point lies from the middle
    of origin and apex towards the impact by tension: 0 is a straight line."""
    t = F.transform(F.sequence(F.lit(0), F.lit(samples - 1)), lambda k: k / F.lit(float(samples - 1)))
    middle = lambda a: (F.col(f"o{a}") + F.col(f"t{a}")) / 2
    control = lambda a: middle(a) + tension * (F.col(f"h{a}") - middle(a))
    return curves.withColumn("curve", F.transform(t, lambda u: F.struct(bezier(F.col("ox"), control("x"), F.col("tx"), u).alias("x"), bezier(F.col("oy"), control("y"), F.col("ty"), u).alias("y"))))
