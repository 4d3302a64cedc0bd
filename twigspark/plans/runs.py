"""End-to-end runs over folders: shoots and heat, masks to branches, hierarchy of coloured rasters, and the evaluation of all methods. One plan covers all images."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from twigspark.functions.durable import cut
from twigspark.operators import counts, evaluate, fit, heat, hierarchy, joins, raster, shoots, skeleton, transport
from twigspark.sources import files

SIGMA_CM = 8.0
#: Fixed values of the hierarchy: colour tolerance, gap in pixels, least pixels of a branch, trunk ratio.
HIERARCHY = {"tolerance": 25, "gap": 7.0, "least": 15, "ratio": 0.30}


def load(spark: SparkSession, graph_path: str, flower_path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(flowers, pixels, frames of graphs without flowers), matched by frame number."""
    g, f = files.graphs(spark, graph_path), files.read_json(spark, flower_path, files.FLOWERS)
    image = F.col("frame").cast("long").alias("image_id")
    pixels = files.graph_pixels(g).select(image, F.col("ord").cast("long"), F.col("branch_id").cast("long"), "x", "y")
    flowers = files.flowers(f).select(image, F.col("id").cast("long"), "x", "y")
    _, missing = files.matched(g, f)
    return flowers.join(pixels.select("image_id").distinct(), "image_id", "left_semi"), pixels, missing.select("frame", "name")


def shoots_and_heat(spark: SparkSession, graph_path: str, flower_path: str, px_per_cm: float, form: Callable = shoots.first_form) -> dict[str, DataFrame]:
    """Shoots, assignments, counts by branch, and the heat of the shoots' bases on the skeleton."""
    flowers, pixels, missing = load(spark, graph_path, flower_path)
    flowers, pixels = cut(flowers), cut(pixels)
    found, assigned = form(flowers, pixels, px_per_cm)
    if form is shoots.second_form:
        found = found.join(assigned.groupBy("image_id", "shoot_id").agg(F.count("*").alias("n")), ["image_id", "shoot_id"]).withColumnsRenamed({"ox": "base_x", "oy": "base_y"})
    bases = found.select("image_id", F.col("base_x").alias("x"), F.col("base_y").alias("y"), "n")
    branches = pixels.select("image_id", "branch_id").distinct()
    return {"shoots": found, "assignments": assigned, "per_branch": counts.per_branch(assigned, branches), "heat": heat.heat_field(bases, pixels, SIGMA_CM * px_per_cm), "missing": missing}


def branches_of_masks(masks: DataFrame, params: DataFrame | None = None, least: int = 5) -> dict[str, DataFrame]:
    """Skeletons, traced branches, their statistics, the trunk path, and a report of masks that failed."""
    sk = cut(raster.skeletonise(masks, params))
    traced = cut(skeleton.branches(raster.to_pixels(sk), least))
    status = sk.select(F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"))
    return {"skeletons": sk, "branches": traced, "stats": skeleton.branch_stats(traced), "trunk": skeleton.diameter(traced), "report": counts.run_report(status)}


def hierarchy_of_rasters(pixels: DataFrame, corner: int = 10, p: dict = HIERARCHY) -> dict[str, DataFrame]:
    """Nodes, canonical edges and branch pixels of coloured rasters (image_id, x, y, b, g, r), as the graph documents hold them."""
    bg = hierarchy.background(pixels, corner)
    clean = cut(hierarchy.without_text(pixels))
    groups = cut(hierarchy.colour_groups(clean, bg, p["tolerance"], p["least"]))
    keys = {f"q{c}": hierarchy.quantised(F.col(c), p["tolerance"]) for c in hierarchy.CHANNELS}
    own = clean.withColumns(keys).join(groups.select("image_id", *keys, F.col("branch_id").cast("long"), "first"), ["image_id", *keys])
    width = pixels.groupBy("image_id").agg((F.max("x") + 1).alias("w"))
    own = cut(own.join(width, "image_id").select("image_id", "branch_id", (F.col("y") * F.col("w") + F.col("x")).alias("ord"), "x", "y"))
    edges = cut(hierarchy.adjacency(own, p["gap"]))
    groups = groups.withColumn("branch_id", F.col("branch_id").cast("long"))
    found = hierarchy.branch_levels(groups, edges, hierarchy.trunk(groups, edges, p["ratio"]))
    return {"nodes": hierarchy.graph_nodes(groups, found), "edges": hierarchy.canonical_edges(edges), "pixels": own}


def evaluated(flowers: DataFrame, pixels: DataFrame, truth: DataFrame, methods: dict[str, Callable[[DataFrame, DataFrame], DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """(scores by image and method, macro means) against the branch of the ground-truth point nearest to each flower."""
    real = cut(evaluate.true_branches(flowers, truth))
    scores = None
    for name, method in methods.items():
        s = evaluate.accuracy(method(flowers, pixels).select("image_id", "id", "branch_id").withColumn("method", F.lit(name)), real)
        scores = s if scores is None else scores.unionByName(s)
    scores = cut(scores)
    return scores, evaluate.macro(scores)


def of_images(images: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    return [t.join(images.select("image_id"), "image_id", "left_semi") for t in tables]


def isolated(images: DataFrame, run: Callable[[DataFrame], DataFrame], step: int = 0) -> tuple[DataFrame | None, list[tuple[int, str]]]:
    """(results of run(images) or None, notes (image_id, error) of the images where it fails). One plan covers all images; only where it fails are they halved by a hash, down to the images at fault, which takes a
    few runs for each of those and leaves all others together."""
    try:
        return cut(run(images)), []
    except Exception as e:  # noqa: BLE001 - whatever a method raises is its note
        cause = f"ERR:{type(e).__name__}"
    few = [r.image_id for r in images.select("image_id").distinct().limit(2).collect()]
    if len(few) < 2:
        return None, [(i, cause) for i in few]
    done, notes = None, []
    for half in (0, 1):
        part = cut(images.where(F.pmod(F.shiftright(F.xxhash64("image_id"), step % 63), F.lit(2)) == half))
        if part.isEmpty():
            continue
        out, more = isolated(part, run, step + 1)
        notes += more
        done = out if done is None else done if out is None else done.unionByName(out)
    return done, notes


SCORES = "image_id long, method string, accuracy double, wasserstein_cm double, similarity double, diameter_cm double, px_per_cm double, nodes long, flowers long, note string, timestamp string"


def method_table(flowers: DataFrame, pixels: DataFrame, truth: DataFrame, methods: dict[str, Callable[[DataFrame, DataFrame], DataFrame]], loads: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None, nodes: int = 600, gap: float = 3.0) -> DataFrame:
    """A row per image and method: accuracy against the branch of the truth's nearest point, and for methods with loads (image_id, x, y, n) how far their load is from the truth's (points with n) along the
    skeleton, in cm, and what part of the diameter that spares. Where a method fails on an image, its row has a note and no score; other images and methods keep theirs."""
    spark = flowers.sparkSession
    scale = cut(fit.px_per_cm(pixels).select("image_id", "px_per_cm"))
    images = cut(flowers.select("image_id").distinct())
    branch_of = truth.select("image_id", F.col("branch_id").cast("long").alias("branch_id"), "ord", "x", "y")
    real = cut(evaluate.true_branches(flowers, branch_of))
    count = flowers.groupBy("image_id").agg(F.count("*").alias("flowers"))

    def in_cm(df: DataFrame) -> DataFrame:
        return df.join(scale, "image_id").withColumns({"x": F.col("x") / F.col("px_per_cm"), "y": F.col("y") / F.col("px_per_cm")}).drop("px_per_cm")

    field = lambda load, p: heat.heat_field(in_cm(load), in_cm(p), SIGMA_CM)
    notes: list[tuple[int, str, str]] = []
    scores, fields = None, None
    for name, method in methods.items():
        found, failed = isolated(images, lambda i, m=method, n=name: evaluate.accuracy(m(*of_images(i, flowers, pixels)).select("image_id", "id", "branch_id").withColumn("method", F.lit(n)), real))
        notes += [(i, name, e) for i, e in failed]
        scores = found if scores is None else scores if found is None else scores.unionByName(found)
        if loads and name in loads:
            load = loads[name]
            warm, failed = isolated(images, lambda i, m=load, n=name: field(m(*of_images(i, flowers, pixels)), of_images(i, pixels)[0]).select("image_id", "ord", "heat").withColumn("method", F.lit(n)))
            notes += [(i, name, f"W_{e}") for i, e in failed]
            fields = warm if fields is None else fields if warm is None else fields.unionByName(warm)
    every = images.withColumn("method", F.explode(F.array(*map(F.lit, methods))))
    out = every.join(count, "image_id").join(scale, "image_id")
    empty = spark.createDataFrame([], SCORES)
    out = out.join(scores.select("image_id", "method", "accuracy") if scores is not None else empty.select("image_id", "method", "accuracy"), ["image_id", "method"], "left")
    shape = ["image_id", "method", "wasserstein_cm", "similarity", "diameter_cm", "nodes"]
    moved = transport.compared(field(truth.select("image_id", "x", "y", "n"), pixels), fields, pixels, scale, nodes, gap) if fields is not None else empty
    out = out.join(moved.select(*shape, F.col("note").alias("moved")), ["image_id", "method"], "left")
    said = spark.createDataFrame(notes, "image_id long, method string, note string").groupBy("image_id", "method").agg(F.concat_ws(" ", F.sort_array(F.collect_list("note"))).alias("said"))
    note = F.trim(F.concat_ws(" ", F.coalesce("said", F.lit("")), F.coalesce("moved", F.lit(""))))
    stamp = F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss")
    out = out.join(said, ["image_id", "method"], "left").withColumns({"note": note, "timestamp": stamp})
    return out.select(*[F.col(x.split()[0]) for x in SCORES.split(", ")])


def resumed(path: str, images: DataFrame, run: Callable[[DataFrame], DataFrame], batches: int = 8) -> DataFrame:
    """Results of run(images), kept as Parquet under path: images that are there already aren't run again, the others go in batches (by a hash), each of which is committed before the next begins. run has to give a row, at least, for each image;
    an image on which it fails has one with a note and nulls, which a later run takes up again."""
    spark = images.sparkSession
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
    # What an earlier run wrote last may be without its mark of success, but a committed job's files are whole.
    before = spark.read.option("mergeSchema", True).parquet(f"{path}/*") if there else None
    left = images.select("image_id").distinct()
    if before is not None:
        left = left.join(before.where("failed is null").select("image_id").distinct(), "image_id", "left_anti")
    left = cut(left)
    for k in range(batches):
        part = cut(left.where(F.pmod(F.xxhash64("image_id"), F.lit(batches)) == k))
        if part.isEmpty():
            continue
        found, notes = isolated(part, run)
        failed = spark.createDataFrame(notes, "image_id long, failed string") if notes else None
        if found is not None:
            found = found.withColumn("failed", F.lit(None).cast("string"))
        out = failed if found is None else found if failed is None else found.unionByName(failed, allowMissingColumns=True)
        out.write.parquet(f"{path}/{uuid.uuid4().hex}")
    whole = spark.read.option("mergeSchema", True).parquet(f"{path}/*")
    good = whole.where("failed is null")
    bad = whole.where("failed is not null").join(good.select("image_id").distinct(), "image_id", "left_anti").dropDuplicates(["image_id"])
    return good.unionByName(bad)


def nearest_by_image(flowers: DataFrame, pixels: DataFrame) -> DataFrame:
    return joins.nearest(flowers, pixels)
