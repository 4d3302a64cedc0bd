"""Readers and writers of the file formats: branch graphs, flower annotations, ground truth, shoots, parameters, images and metric tables.

Schemas are declared, so no file is read twice. File coordinates differ (branch pixels are [y, x], points [x, y]); readers
turn all into x and y columns.
"""

from __future__ import annotations

import json
import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.functions.geometry import frame_number, natural_key

GRAPH = "image string, nodes array<struct<id:int,centroid_x:double,centroid_y:double,level:int,level_name:string,is_trunk:boolean,size_px:int,color_rgb:array<int>>>, edges array<struct<`from`:int,`to`:int>>, branches array<struct<id:int,pixels:array<array<int>>>>"
FLOWERS = "shapes array<struct<label:string,points:array<array<double>>>>"
TRUTH = "image string, graph_json string, source string, n_points int, n_varillas int, n_flowers int, varillas array<struct<varilla_id:int,rama_id:int,num_flowers:int,base_xy:array<double>>>, points array<struct<x:double,y:double,num_flowers:int,rama_id:int>>"
SHOOTS = "image string, n_flowers int, varillas array<struct<varilla_id:int,rama_id:int,num_flowers:int,base_xy:array<double>,centroid:array<double>,confidence:double,flower_indices:array<int>>>"
PARAMETERS = "map<string,struct<close_k:int,open_k:int,thick_dist:double,dilate_k:int,min_branch:int>>"
IMAGE_ENDINGS = ("png", "jpg", "jpeg", "bmp", "tif", "tiff")
DEFAULT_PATHS = {"data_dir": "data", "gt_dir": "ground_truth", "output_dir": "output"}


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file, with the file's path, name and frame number. A document that isn't valid has null fields."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("path", F.input_file_name())
    name = F.element_at(F.split("path", "/"), -1)
    return df.withColumns({"name": name, "frame": frame_number(name)})


def graphs(spark: SparkSession, path: str) -> DataFrame:
    return read_json(spark, path, GRAPH)


def graph_nodes(g: DataFrame) -> DataFrame:
    return g.select("frame", "name", F.explode("nodes").alias("n")).select("frame", "name", F.col("n.id").alias("branch_id"), "n.centroid_x", "n.centroid_y", "n.level", "n.level_name", "n.is_trunk", "n.size_px", "n.color_rgb")


def graph_edges(g: DataFrame) -> DataFrame:
    return g.select("frame", "name", F.explode("edges").alias("e")).select("frame", "name", F.col("e.from").alias("a"), F.col("e.to").alias("b"))


def graph_pixels(g: DataFrame) -> DataFrame:
    """(frame, branch_id, ord, x, y): all branch pixels, ord by position in the file."""
    b = g.select("frame", "name", F.posexplode("branches").alias("k", "b")).select("frame", "name", "k", F.col("b.id").alias("branch_id"), F.posexplode("b.pixels").alias("j", "p"))
    w = Window.partitionBy("frame", "name").orderBy("k", "j")
    return b.select("frame", "name", "branch_id", (F.row_number().over(w) - 1).alias("ord"), F.col("p")[1].cast("double").alias("x"), F.col("p")[0].cast("double").alias("y"))


def branch_colours(g: DataFrame) -> DataFrame:
    return graph_nodes(g).select("frame", "branch_id", "color_rgb")


def flowers(df: DataFrame, label: str = "flower") -> DataFrame:
    """(frame, id, x, y) of annotation documents: id is the place among shapes of that label that have points; their first point counts."""
    kept = F.filter("shapes", lambda s: (s["label"] == label) & (F.size(s["points"]) > 0))
    return df.select("frame", "name", F.posexplode(kept).alias("id", "s")).select("frame", "name", "id", F.col("s.points")[0][0].alias("x"), F.col("s.points")[0][1].alias("y"))


def truth_points(df: DataFrame) -> DataFrame:
    p = df.select("frame", "name", F.posexplode("points").alias("ord", "p"))
    return p.select("frame", "name", "ord", "p.x", "p.y", "p.num_flowers", F.col("p.rama_id").alias("branch_id"))


def shoot_records(df: DataFrame) -> DataFrame:
    s = df.select("frame", "name", F.explode("varillas").alias("s"))
    return s.select("frame", "name", F.col("s.varilla_id").alias("shoot_id"), F.col("s.rama_id").alias("branch_id"), F.col("s.num_flowers").alias("n"), F.col("s.base_xy")[0].alias("x"), F.col("s.base_xy")[1].alias("y"), "s.confidence", "s.flower_indices")


def matched(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs by frame, left files without a partner); of several partners the first path counts."""
    first = right.where("frame is not null").groupBy("frame").agg(F.min("path").alias("partner"))
    return left.join(first, "frame"), left.join(first, "frame", "left_anti")


def first_source(keys: DataFrame, *sources: DataFrame) -> DataFrame:
    """(frame, path): each frame's path in the first source that has it."""
    out, names = keys, []
    for k, s in enumerate(sources):
        names.append(f"p{k}")
        out = out.join(s.groupBy("frame").agg(F.min("path").alias(f"p{k}")), "frame", "left")
    return out.withColumn("path", F.coalesce(*names)).drop(*names)


def truth_graph(df: DataFrame) -> DataFrame:
    """Ground truth with the name of its graph file: as stated, else from its own name."""
    stem = F.regexp_replace("name", r"_GT\.json$", "")
    return df.withColumn("graph_name", F.coalesce("graph_json", F.concat(stem, F.lit(".json"))))


def work_list(shoot_files: DataFrame, graph_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(shoot files whose graph is there, those whose isn't)."""
    return shoot_files.join(graph_files, "frame", "left_semi"), shoot_files.join(graph_files, "frame", "left_anti")


def in_order(files: DataFrame) -> DataFrame:
    """Files by frame number, then name; those without a number last."""
    return files.orderBy(natural_key("name"))


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(name, frame, height, width, b, g, r planes as `data`, channels) of all decodable images in a folder."""
    pattern = "*.{" + ",".join(sorted({*IMAGE_ENDINGS, *(e.upper() for e in IMAGE_ENDINGS)})) + "}"
    df = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).load(folder).select("image.*")
    name = F.element_at(F.split("origin", "/"), -1)
    return df.select(name.alias("name"), frame_number(name).alias("frame"), "height", "width", F.col("nChannels").alias("channels"), "data")


def parameters(spark: SparkSession, path: str) -> DataFrame:
    """(name, close_k, open_k, thick_dist, dilate_k, min_branch) of the parameter store; a broken store is empty."""
    return parameter_rows(spark.read.text(path, wholetext=True))


def parameter_rows(text: DataFrame) -> DataFrame:
    """Rows of stores given as text in the column value."""
    return text.select(F.explode(F.from_json("value", PARAMETERS)).alias("name", "p")).select("name", "p.*")


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """old with the rows of new in place of those with equal keys; of repeated keys in new the last (by column seq, if there is one) counts."""
    if "seq" in new.columns:
        w = Window.partitionBy(*keys).orderBy(F.col("seq").desc())
        new = new.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k", "seq")
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def metrics_table(df: DataFrame, digits: dict[str, int]) -> DataFrame:
    """Metrics as they are written: rounded by column, NaN as null (an empty cell)."""
    return df.withColumns({c: F.round(F.when(~F.isnan(c), F.col(c)), n) for c, n in digits.items()})


def write_metrics(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def graph_documents(nodes: DataFrame, edges: DataFrame, pixels: DataFrame) -> DataFrame:
    """One document per image in the graph format: nodes, canonical edges, and branch pixels as [y, x] in order."""
    n = nodes.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("branch_id").alias("id"), "centroid_x", "centroid_y", "level", "level_name", "is_trunk", "size_px"))).alias("nodes"))
    e = edges.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("a").alias("from"), F.col("b").alias("to")))).alias("edges"))
    p = pixels.groupBy("image_id", "branch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "y", "x"))), lambda s: F.array(s["y"], s["x"])).alias("pixels"))
    b = p.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct(F.col("branch_id").alias("id"), "pixels"))).alias("branches"))
    return n.join(e, "image_id", "left").join(b, "image_id", "left")


def truth_documents(points: DataFrame) -> DataFrame:
    """One ground-truth document per image, from annotated points (image_id, ord, x, y, num_flowers, branch_id)."""
    listed = F.array_sort(F.collect_list(F.struct("ord", "x", "y", "num_flowers", F.col("branch_id").alias("rama_id"))))
    return points.groupBy("image_id").agg(F.count("*").alias("n_points"), F.sum("num_flowers").alias("n_flowers"), F.transform(listed, lambda s: F.struct(s["x"].alias("x"), s["y"].alias("y"), s["num_flowers"].alias("num_flowers"), s["rama_id"].alias("rama_id"))).alias("points"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def configured(key: str, file: str | None = None, env: str = "TWIGSPARK_") -> str:
    """A folder: environment variable, then configuration file, then default. A broken file counts as none."""
    if value := os.environ.get(env + key.upper()):
        return value
    try:
        held = json.loads(Path(file).read_text("utf-8")) if file else {}
    except (OSError, ValueError):
        held = {}
    return (held.get(key) if isinstance(held, dict) else None) or DEFAULT_PATHS[key]


def active_paths(file: str | None = None) -> dict[str, str]:
    return {k: configured(k, file) for k in DEFAULT_PATHS}
