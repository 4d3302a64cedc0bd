"""Density clustering of points by radius joins and connected components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from twigspark.operators.components import components
from twigspark.operators.joins import radius_pairs


def halves(points: DataFrame, squeeze: float) -> DataFrame:
    """points with the half of their image they lie in (0 above mid-height, 1 below) and coordinates in which the across axis counts squeeze times:
    x above, y below."""
    mid = points.groupBy("image_id").agg(((F.min("y") + F.max("y")) / 2).alias("mid"))
    p = points.join(mid, "image_id").withColumn("half", F.when(F.col("y") < F.col("mid"), 0).otherwise(1))
    return p.withColumns({"sx": F.when(F.col("half") == 0, F.col("x") * squeeze).otherwise(F.col("x")), "sy": F.when(F.col("half") == 0, F.col("y")).otherwise(F.col("y") * squeeze)}).drop("mid")


def _near(p: DataFrame, eps: float, part: list[str]) -> DataFrame:
    """(image_id struct of part, a, b) within eps in the scaled coordinates."""
    scaled = p.select(F.struct(*part).alias("image_id"), "id", F.col("sx").alias("x"), F.col("sy").alias("y"))
    return radius_pairs(scaled, eps)


def _edges(near: DataFrame) -> DataFrame:
    node = lambda c: F.struct("image_id", F.col(c).alias("id")).alias(c)
    return near.select(node("a"), node("b"))


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """cluster from 0 per image: the rank of each root by order, which holds one value for each root."""
    roots = df.groupBy("image_id", "root").agg(*[F.min(c).alias(f"__{c}") for c in order])
    w = Window.partitionBy("image_id").orderBy(*[f"__{c}" for c in order])
    return df.join(roots.select("image_id", "root", (F.row_number().over(w) - 1).alias("cluster")), ["image_id", "root"])


def aniso_components(points: DataFrame, eps: float, squeeze: float = 4.0) -> DataFrame:
    """(image_id, id, cluster): with a minimum of one point, density clusters are the components of the eps-graph of each half; upper half first, then by smallest id."""
    p = halves(points, squeeze)
    near = _near(p, eps, ["image_id", "half"])
    label = components(_edges(near)).select(F.col("node.image_id.image_id").alias("image_id"), "node.id", F.col("root.id").alias("root"))
    out = p.join(label, ["image_id", "id"], "left").withColumn("root", F.coalesce("root", "id"))
    return numbered(out.select("image_id", "id", "half", "root"), ["half", "root"]).select("image_id", "id", "cluster")


def dbscan(points: DataFrame, eps: float, least: int = 3, squeeze: float = 4.0) -> DataFrame:
    """(image_id, id, cluster): core points have least points within eps, themselves included; clusters are components of cores; a border point joins the first of
    its clusters; noise is -1. The x axis counts squeeze times."""
    p = points.withColumns({"sx": F.col("x") * squeeze, "sy": F.col("y")})
    near = _near(p, eps, ["image_id"]).select(F.col("image_id.image_id").alias("image_id"), "a", "b")
    both = near.select("image_id", "a", "b").unionByName(near.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
    core = both.groupBy("image_id", "a").count().where(F.col("count") + 1 >= least).select("image_id", F.col("a").alias("id"))
    if least <= 1:
        core = points.select("image_id", "id")
    a, b = core.withColumnRenamed("id", "a"), core.withColumnRenamed("id", "b")
    links = near.join(a, ["image_id", "a"]).join(b, ["image_id", "b"])
    label = components(_edges(links)).select("node.image_id", "node.id", F.col("root.id").alias("root"))
    cores = numbered(core.join(label, ["image_id", "id"], "left").withColumn("root", F.coalesce("root", "id")), ["root"]).select("image_id", "id", "cluster")
    border = both.join(cores.withColumnRenamed("id", "b"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("id")).agg(F.min("cluster").alias("near"))
    out = points.select("image_id", "id").join(cores, ["image_id", "id"], "left").join(border, ["image_id", "id"], "left")
    return out.select("image_id", "id", F.coalesce("cluster", "near", F.lit(-1)).cast("int").alias("cluster"))


def cluster_sizes(clusters: DataFrame) -> DataFrame:
    """Per image: n_clusters, n_singletons, max_size, mean_size."""
    n = clusters.groupBy("image_id", "cluster").agg(F.count("*").alias("n"))
    return n.groupBy("image_id").agg(F.count("*").alias("n_clusters"), F.count_if(F.col("n") == 1).alias("n_singletons"), F.max("n").alias("max_size"), F.avg("n").alias("mean_size"))
