"""Line fits of point clusters and what follows from them: extents, curvature, confidence, merge candidates. All are aggregates and column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twigspark.functions.geometry import axis_angle, clip
from twigspark.operators.joins import radius_pairs

ASSUMED_HEIGHT_CM = 350.0


def px_per_cm(pixels: DataFrame, height_cm: float = ASSUMED_HEIGHT_CM) -> DataFrame:
    """(image_id, px_per_cm): vertical extent of all branch pixels over the assumed height; 1 for fewer than two pixels, an extent of at most 1 or no height."""
    a = pixels.groupBy("image_id").agg(F.count("*").alias("n"), (F.max("y") - F.min("y")).alias("h"))
    bad = (F.col("n") < 2) | (F.col("h") <= 1) | F.lit(height_cm <= 0)
    return a.select("image_id", F.when(bad, 1.0).otherwise(F.col("h") / F.lit(height_cm or 1.0)).alias("px_per_cm"))


def line_fit(points: DataFrame, by: list[str]) -> DataFrame:
    """Per cluster: n, centroid (cx, cy), direction (ux, uy) of the least-squares line on the axis of larger variance, normal (vx, vy).

    A single point, or points that coincide, have the direction (0, -1) and normal (1, 0).
    """
    a = points.groupBy(*by).agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), F.var_pop("x").alias("sxx"), F.var_pop("y").alias("syy"), F.covar_pop("x", "y").alias("sxy"))
    steep = F.col("syy") >= F.col("sxx")
    none = (F.col("n") == 1) | ((F.col("sxx") == 0) & (F.col("syy") == 0))
    a = a.withColumns({
        "px": F.when(none, 0.0).when(steep, F.try_divide("sxy", "syy")).otherwise(1.0),
        "py": F.when(none, -1.0).when(steep, 1.0).otherwise(F.try_divide("sxy", "sxx")),
    })
    norm = F.sqrt(F.col("px") * F.col("px") + F.col("py") * F.col("py"))
    a = a.withColumns({"ux": F.col("px") / norm, "uy": F.col("py") / norm})
    return a.withColumns({"vx": -F.col("uy"), "vy": F.col("ux")}).drop("px", "py", "sxx", "syy", "sxy")


def projected(points: DataFrame, fits: DataFrame, by: list[str]) -> DataFrame:
    """points with t along and r across their cluster's line."""
    j = points.join(fits.select(*by, "cx", "cy", "ux", "uy", "vx", "vy"), by)
    dx, dy = F.col("x") - F.col("cx"), F.col("y") - F.col("cy")
    return j.withColumns({"t": dx * F.col("ux") + dy * F.col("uy"), "r": dx * F.col("vx") + dy * F.col("vy")})


def shoots(points: DataFrame, by: list[str], curved_from: int = 10, most_curved: float = 0.0012) -> DataFrame:
    """line_fit with curvature c (from curved_from points on, clipped), extent, rms residual, both ends and the basal direction.

    The basal end is the lower one (larger y); the basal direction is the curve's tangent there, pointing out; (0, 1) if it vanishes.
    """
    fits = line_fit(points, by)
    p = projected(points, fits, by)
    t2 = F.col("t") * F.col("t")
    a = p.groupBy(*by).agg(
        F.try_divide(F.sum(t2 * F.col("r")), F.sum(t2 * t2)).alias("q"),
        F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.sqrt(F.avg(F.col("r") * F.col("r"))).alias("rms"),
    )
    s = fits.join(a, by).withColumn("c", F.when(F.col("n") >= curved_from, clip(F.coalesce("q", F.lit(0.0)), -most_curved, most_curved)).otherwise(0.0)).drop("q")
    s = s.withColumn("rms", F.when(F.col("n") > 1, F.col("rms")).otherwise(0.0))
    at = lambda t, a: F.col(f"c{a}") + F.col(t) * F.col(f"u{a}") + F.col("c") * F.col(t) * F.col(t) * F.col(f"v{a}")
    s = s.withColumns({f"{e}{a}": at(t, a) for e, t in (("lo_", "t_min"), ("hi_", "t_max")) for a in "xy"})
    low = F.col("hi_y") >= F.col("lo_y")  # whether t_max is the basal end
    pick = lambda a, yes: F.when(low == F.lit(yes), F.col(f"hi_{a}")).otherwise(F.col(f"lo_{a}"))
    tb, sign = F.when(low, F.col("t_max")).otherwise(F.col("t_min")), F.when(low, 1.0).otherwise(-1.0)
    tx, ty = (sign * (F.col(f"u{a}") + 2 * F.col("c") * tb * F.col(f"v{a}")) for a in "xy")
    norm = F.sqrt(tx * tx + ty * ty)
    s = s.withColumns({"bottom_x": pick("x", True), "bottom_y": pick("y", True), "top_x": pick("x", False), "top_y": pick("y", False), "bx": F.when(norm > 1e-9, tx / norm).otherwise(0.0), "by": F.when(norm > 1e-9, ty / norm).otherwise(1.0)})
    return s.withColumn("length_px", F.col("t_max") - F.col("t_min")).drop("lo_x", "lo_y", "hi_x", "hi_y")


def confidence(rms: Column, found: Column, distance: Column, length_cm: Column, n: Column, eps: float, tolerance: float, shortest: float = 8.0, longest: float = 80.0, fewest: int = 3, most: int = 60) -> Column:
    """0.4 for a small residual, 0.4 for a near base (0.2 of it if none was found), 0.2 for a usual length; halved for an unusual count."""
    fit = F.exp(-rms / max(eps, 1.0))
    base = F.when(found, F.exp(-distance / F.lit(tolerance))).otherwise(0.2)
    length = F.when(length_cm < shortest, F.greatest(F.lit(0.2), length_cm / max(shortest, 1.0))).when(length_cm > longest, F.greatest(F.lit(0.2), F.lit(longest) / F.greatest(length_cm, F.lit(1.0)))).otherwise(1.0)
    return clip((0.4 * fit + 0.4 * base + 0.2 * length) * F.when((n < fewest) | (n > most), 0.5).otherwise(1.0), 0.0, 1.0)


def merge_candidates(s: DataFrame, image: str, ident: str, angle: float, lateral: float, reach: float) -> DataFrame:
    """(image, a, b, gap): pairs of shoots a < b that may be one: nearly parallel axes, small offset of b's centre across a's axis, and near ends or centres."""
    keep = ["cx", "cy", "ux", "uy", "vx", "vy", "top_x", "top_y", "bottom_x", "bottom_y"]
    side = lambda n: s.select(image, F.col(ident).alias(n), *[F.col(c).alias(f"{n}_{c}") for c in keep])
    # Two shoots with a gap of at most reach have spots in neighbouring cells of that size; a little more, as the exact test compares roots.
    place = F.explode(F.array(*[F.struct(F.col(f"{p}x").alias("x"), F.col(f"{p}y").alias("y")) for p in ("c", "top_", "bottom_")]))
    at = s.select(F.col(image).alias("image_id"), F.col(ident).alias("id"), place.alias("p")).select("image_id", "id", "p.x", "p.y")
    near = radius_pairs(at, max(reach * (1 + 1e-9), 1e-9)).select(F.col("image_id").alias(image), "a", "b").distinct()
    j = near.join(side("a"), [image, "a"]).join(side("b"), [image, "b"])
    spots = ("c", "top_", "bottom_")
    gaps = [F.sqrt(sum((F.col(f"a_{p}{k}") - F.col(f"b_{q}{k}")) * (F.col(f"a_{p}{k}") - F.col(f"b_{q}{k}")) for k in "xy")) for p in spots for q in spots]
    j = j.withColumns({
        "angle": axis_angle(F.col("a_ux"), F.col("a_uy"), F.col("b_ux"), F.col("b_uy")),
        "lateral": F.abs((F.col("b_cx") - F.col("a_cx")) * F.col("a_vx") + (F.col("b_cy") - F.col("a_cy")) * F.col("a_vy")),
        "gap": F.least(*gaps),
    })
    centre = F.sqrt((F.col("a_cx") - F.col("b_cx")) * (F.col("a_cx") - F.col("b_cx")) + (F.col("a_cy") - F.col("b_cy")) * (F.col("a_cy") - F.col("b_cy")))
    return j.where((F.col("angle") <= angle) & (F.col("lateral") <= lateral) & (F.col("gap") <= reach)).select(image, "a", "b", "gap", centre.alias("centre_distance"))
