"""Branches from coloured pixels, their adjacency, trunk and levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.durable import cut
from twigspark.functions.geometry import distance2
from twigspark.operators.components import levels
from twigspark.operators.joins import by_size, finite, radius_join

CHANNELS = ("b", "g", "r")


def background(pixels: DataFrame, block: int) -> DataFrame:
    """(image_id, bg_b, bg_g, bg_r): median of the four corner blocks, truncated."""
    size = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    p = pixels.join(size, "image_id")
    corner = ((F.col("x") < block) | (F.col("x") >= F.col("w") - block)) & ((F.col("y") < block) | (F.col("y") >= F.col("h") - block))
    return p.where(corner).groupBy("image_id").agg(*[F.percentile(c, 0.5).cast("int").alias(f"bg_{c}") for c in CHANNELS])


def without_text(pixels: DataFrame, above: int = 200) -> DataFrame:
    """pixels that aren't near white."""
    return pixels.where(~((F.col("b") > above) & (F.col("g") > above) & (F.col("r") > above)))


def quantised(channel: Column, tolerance: int) -> Column:
    q = max(tolerance // 2, 6)
    return F.least(F.floor((channel + q // 2) / q) * q, F.lit(255)).cast("int")


def colour_groups(pixels: DataFrame, bg: DataFrame, tolerance: int = 25, least: int = 15) -> DataFrame:
    """Per image and quantised colour of foreground pixels, in order of first appearance: branch_id, colour, size_px, mean and largest coordinates. Small groups go."""
    p = pixels.join(bg, "image_id")
    front = F.greatest(*[F.abs(F.col(c) - F.col(f"bg_{c}")) for c in CHANNELS]) > tolerance
    width = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    p = p.where(front).join(width, "image_id").withColumn("place", F.col("y") * F.col("w") + F.col("x"))
    keys = {f"q{c}": quantised(F.col(c), tolerance) for c in CHANNELS}
    g = p.withColumns(keys).groupBy("image_id", *keys).agg(F.count("*").alias("size_px"), F.min("place").alias("first"), F.avg("x").alias("avg_x"), F.avg("y").alias("avg_y"), F.max("y").alias("max_y"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"))
    w = Window.partitionBy("image_id").orderBy("first")
    return g.where(F.col("size_px") >= least).withColumn("branch_id", F.row_number().over(w) - 1)


def canonical_edges(edges: DataFrame) -> DataFrame:
    """Undirected edges once each, smaller id first, without loops."""
    return edges.where("a <> b").select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def touching(pixels: DataFrame, gap: float) -> DataFrame:
    """(image_id, a, b), a < b, of branches with pixels within gap, by all pairs of such pixels."""
    p = pixels.select("image_id", F.col("branch_id").alias("id"), "x", "y")
    near = radius_join(p, pixels, gap).where(F.col("id") < F.col("branch_id"))
    return near.select("image_id", F.col("id").alias("a"), F.col("branch_id").alias("b")).distinct()


def adjacency(pixels: DataFrame, gap: float) -> DataFrame:
    """(image_id, a, b): branches with pixels within gap of each other.

    Images of many pixels begin with a gap of about their pixels' distance, and widen it: branches that touch all others of their image leave, so that dense images don't meet all pairs of pixels within the gap."""
    pixels = pixels.select("image_id", "branch_id", "ord", "x", "y")
    few, many = by_size(pixels, pixels, of_targets=True)
    if many is None:
        return touching(pixels, gap)
    left = cut(finite(pixels).where("branch_id is not null").join(many, "image_id", "left_semi"))
    area = (F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))
    apart = left.groupBy("image_id").agg(F.sqrt(area / F.count("*")).alias("d")).agg(F.min("d")).first()[0]
    gaps = [gap]
    while gaps[0] > 2 * max(apart or 0.0, gap * 4.0**-8):
        gaps.insert(0, gaps[0] / 4)
    branches = left.groupBy("image_id").agg(F.count_distinct("branch_id").alias("of"))
    found = None
    for k, width in enumerate(gaps):
        near = touching(left, width)
        found = cut(near if found is None else near.unionByName(found).distinct())
        if k + 1 < len(gaps):
            both = found.select("image_id", F.col("a").alias("branch_id")).unionByName(found.select("image_id", F.col("b").alias("branch_id")))
            done = both.groupBy("image_id", "branch_id").agg(F.count("*").alias("n")).join(branches, "image_id").where(F.col("n") >= F.col("of") - 1)
            left = cut(left.join(done.select("image_id", "branch_id"), ["image_id", "branch_id"], "left_anti"))
            if left.isEmpty():
                break
    return found if few is None else found.unionByName(touching(pixels.join(few, "image_id", "left_semi"), gap))


def trunk(branches: DataFrame, edges: DataFrame, ratio: float = 0.30) -> DataFrame:
    """(image_id, branch_id): the lowest branch (largest mean y, then largest y, then smallest id) and what it reaches through branches of at most
    ratio times the upper median size."""
    seed = branches.groupBy("image_id").agg(F.max_by("branch_id", F.struct("avg_y", "max_y", -F.col("branch_id"))).alias("branch_id"))
    w = Window.partitionBy("image_id").orderBy("size_px", "branch_id")
    n = branches.groupBy("image_id").agg(F.count("*").alias("n"))
    rank = branches.withColumn("k", F.row_number().over(w) - 1).join(n, "image_id")
    limit = rank.where(F.col("k") == F.floor(F.col("n") / 2)).select("image_id", (F.col("size_px") * ratio).alias("limit"))
    short = branches.join(limit, "image_id").where(F.col("size_px") <= F.col("limit")).select("image_id", "branch_id")
    both = cut(edges.select("image_id", "a", "b").unionByName(edges.select("image_id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    seen = front = cut(seed)
    while True:
        front = front.withColumnRenamed("branch_id", "a").join(both, ["image_id", "a"]).select("image_id", F.col("b").alias("branch_id")).distinct()
        front = cut(front.join(short, ["image_id", "branch_id"]).join(seen, ["image_id", "branch_id"], "left_anti"))
        if front.isEmpty():
            return seen
        seen = cut(seen.unionByName(front))


def branch_levels(branches: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(image_id, branch_id, level): steps from the trunk, -1 where it doesn't reach."""
    node = lambda c: F.struct("image_id", F.col(c).alias("branch_id"))
    found = levels(branches.select(node("branch_id").alias("node")), edges.select(node("a").alias("a"), node("b").alias("b")), roots.select(node("branch_id").alias("node")))
    return found.select("node.image_id", "node.branch_id", "level")


def level_name(level: Column) -> Column:
    return F.when(level == -1, "Desconectada").when(level == 0, "Tronco").otherwise(F.concat(level.cast("string"), F.lit("º orden")))


def merged_branches(pixels: DataFrame, groups: DataFrame) -> DataFrame:
    """pixels with branches of a group (image_id, group_id, branch_id) under the smallest id of the group."""
    to = groups.groupBy("image_id", "group_id").agg(F.min("branch_id").alias("to")).join(groups, ["image_id", "group_id"]).select("image_id", "branch_id", "to")
    return pixels.join(to, ["image_id", "branch_id"], "left").withColumn("branch_id", F.coalesce("to", "branch_id")).drop("to")


def deleted_branches(pixels: DataFrame, gone: DataFrame) -> DataFrame:
    return pixels.join(gone.select("image_id", "branch_id"), ["image_id", "branch_id"], "left_anti")


def graph_nodes(branches: DataFrame, found: DataFrame) -> DataFrame:
    """Node records: rounded centroid (half to even), level and its name, trunk mark, size."""
    j = branches.join(found, ["image_id", "branch_id"], "left")
    return j.select("image_id", "branch_id", F.bround("avg_x", 1).alias("centroid_x"), F.bround("avg_y", 1).alias("centroid_y"), "level", level_name(F.col("level")).alias("level_name"), (F.col("level") == 0).alias("is_trunk"), "size_px")


def pixel_graph(pixels: DataFrame) -> DataFrame:
    """(image_id, a, b): 8-neighbour edges of skeleton pixels (ord), a pixel in several branches counted for the first."""
    w = Window.partitionBy("image_id", "x", "y").orderBy("ord")
    p = pixels.withColumn("k", F.row_number().over(w)).where("k = 1").select("image_id", F.col("ord").alias("a"), "x", "y")
    step = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ((1, 0), (-1, 1), (0, 1), (1, 1))]))
    q = p.withColumn("s", step).select("image_id", "a", (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    return q.join(p.withColumnRenamed("a", "b"), ["image_id", "x", "y"]).select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bridges_of_all(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    p = lambda n: pixels.select("image_id", F.col("branch_id").alias(n), F.col("ord").alias(f"pixel_{n}"), F.col("x").alias(f"{n}x"), F.col("y").alias(f"{n}y"))
    j = edges.join(p("a"), ["image_id", "a"]).join(p("b"), ["image_id", "b"]).withColumn("d2", distance2("ax", "ay", "bx", "by"))
    return j.groupBy("image_id", "a", "b").agg(F.min(F.struct("d2", "pixel_a", "pixel_b")).alias("m"))


def bridges(edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """(image_id, a, b, pixel_a, pixel_b, distance): the nearest pixels of each two adjacent branches, ties in pixel order.

    In images of many pixels only those near each other are compared: an edge is settled once its nearest pixels are no further apart than the radius of a round, which sees all pairs as near as that; for the others the next is four times as wide."""
    edges, pixels = edges.select("image_id", "a", "b").distinct(), pixels.select("image_id", "branch_id", "ord", "x", "y")
    shown = lambda best: best.select("image_id", "a", "b", "m.pixel_a", "m.pixel_b", F.sqrt("m.d2").alias("distance"))
    few, many = by_size(pixels, pixels, of_targets=True)
    if many is None:
        return shown(_bridges_of_all(edges, pixels))
    p, left = cut(finite(pixels).join(many, "image_id", "left_semi")), cut(edges.join(many, "image_id", "left_semi"))
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    low, reach = p.groupBy("image_id").agg(F.sqrt(wide * high / F.count("*")).alias("d"), F.sqrt(wide * wide + high * high).alias("reach")).agg(F.min("d"), F.max("reach")).first() or (None, None)
    radius, done = max(low or 0.0, (reach or 0.0) * 1e-6, 1e-9), None
    while not left.isEmpty():
        ends = left.select("image_id", F.col("a").alias("branch_id")).unionByName(left.select("image_id", F.col("b").alias("branch_id"))).distinct()
        p = cut(p.join(ends, ["image_id", "branch_id"], "left_semi"))
        near = radius_join(p.select("image_id", F.col("branch_id").alias("a"), F.col("ord").alias("pixel_a"), "x", "y"), p, radius).where("a <> branch_id")
        best = near.groupBy("image_id", "a", F.col("branch_id").alias("b")).agg(F.min(F.struct("d2", "pixel_a", F.col("ord").alias("pixel_b"))).alias("m"))
        ok = cut(best.join(left, ["image_id", "a", "b"]))
        done = ok if done is None else done.unionByName(ok)
        if radius > (reach or 0.0):
            break
        left = cut(left.join(ok.select("image_id", "a", "b"), ["image_id", "a", "b"], "left_anti"))
        radius *= 4
    out = shown(done) if done is not None else None
    if few is None and out is not None:
        return out
    rest = shown(_bridges_of_all(edges, pixels if few is None else pixels.join(few, "image_id", "left_semi")))
    return rest if out is None else out.unionByName(rest)


RING = ((0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1))


def pixel_classes(pixels: DataFrame) -> DataFrame:
    """(image_id, x, y, neighbours, crossings, class): 8-neighbour count and number of background-to-foreground changes around each foreground pixel;
    endpoint: one of both; junction: three or more of either."""
    p = pixels.select("image_id", "x", "y").distinct()
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(j).alias("j")) for k, (i, j) in enumerate(RING)])
    asks = p.withColumn("s", F.explode(steps)).select("image_id", F.col("x").alias("px"), F.col("y").alias("py"), F.col("s.k").alias("k"), (F.col("x") + F.col("s.i")).alias("x"), (F.col("y") + F.col("s.j")).alias("y"))
    got = asks.join(p, ["image_id", "x", "y"]).groupBy("image_id", F.col("px").alias("x"), F.col("py").alias("y")).agg(F.collect_set("k").alias("on"))
    n = p.join(got, ["image_id", "x", "y"], "left").withColumn("on", F.coalesce("on", F.array().cast("array<int>")))
    changes = sum(F.when(F.array_contains("on", (k + 1) % 8) & ~F.array_contains("on", k), 1).otherwise(0) for k in range(8))
    n = n.select("image_id", "x", "y", F.size("on").alias("neighbours"), changes.alias("crossings"))
    kind = F.when((F.col("crossings") == 1) & (F.col("neighbours") == 1), "endpoint").when((F.col("crossings") >= 3) | (F.col("neighbours") >= 3), "junction").otherwise("body")
    return n.withColumn("class", kind)
