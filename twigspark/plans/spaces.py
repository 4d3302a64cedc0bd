"""Points, pixels and graphs derived from the relational test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """One image: every fifth vector is a flower, the others are pixels of the branch that their label names; the first two elements are x and y."""
    e = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("long").alias("branch_id"), *[(F.col("embedding")[k].cast("double") * 1000).alias(a) for k, a in enumerate("xy")])
    one = F.lit(1).cast("long").alias("image_id")
    return e.where("vec_id % 5 = 0").select(one, F.col("vec_id").alias("id"), "x", "y"), e.where("vec_id % 5 <> 0").select(one, F.col("vec_id").alias("ord"), "branch_id", "x", "y")


#: Vectors of an image of `several`.
IMAGE = 250


def several(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """The labelled space as an image for every IMAGE vectors, so that images grow in number with the table and not in size."""
    of = lambda df, c: df.withColumn("image_id", F.floor(F.col(c) / IMAGE))
    f, p = labelled(spark, sf)
    return of(f, "id"), of(p, "ord")


def tree(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An image per supplier, a branch per line number; returned lines are flowers, the others pixels."""
    key = ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 10_000_000 + F.col("l_partkey")).alias("id")
    t = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("image_id"), key, F.col("l_linenumber").cast("long").alias("branch_id"), (F.col("l_quantity") * 10).alias("x"), (F.col("l_extendedprice") / 100).alias("y"), "l_returnflag")
    return t.where("l_returnflag = 'R'").drop("l_returnflag"), t.where("l_returnflag <> 'R'").withColumnRenamed("id", "ord").drop("l_returnflag")


def branches(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("image_id", "branch_id").agg(F.count("*").alias("size_px"), F.avg("x").alias("avg_x"), F.avg("y").alias("avg_y"), F.max("y").alias("max_y"))


def grid(spark: SparkSession, sf: str, size: float = 25.0) -> DataFrame:
    """Pixels of the labelled space on a whole-number grid."""
    f, p = labelled(spark, sf)
    both = f.select("image_id", "x", "y").unionByName(p.select("image_id", "x", "y"))
    return both.select("image_id", F.floor(F.col("x") / size).alias("x"), F.floor(F.col("y") / size).alias("y")).distinct()


def colours(spark: SparkSession, sf: str) -> DataFrame:
    """A coloured raster of 40 columns: a pixel per part, channels from its size, price and key."""
    p = table(spark, sf, "part")
    return p.select(F.lit(1).cast("long").alias("image_id"), (F.col("p_partkey") % 40).alias("x"), F.floor(F.col("p_partkey") / 40).alias("y"), (F.col("p_size") * 5 % 256).cast("int").alias("b"), (F.floor("p_retailprice").cast("long") % 256).cast("int").alias("g"), (F.col("p_partkey") % 3 * 80).cast("int").alias("r"))


def hierarchy(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, roots) of region, nation, customer; ids by kind."""
    r, n, c = (table(spark, sf, t) for t in ("region", "nation", "customer"))
    rid, nid, cid = (lambda x: F.concat(F.lit("r"), x)), (lambda x: F.concat(F.lit("n"), x)), (lambda x: F.concat(F.lit("c"), x))
    s = lambda x: F.col(x).cast("string")
    roots = r.select(rid(s("r_regionkey")).alias("node"))
    nodes = roots.unionByName(n.select(nid(s("n_nationkey")).alias("node"))).unionByName(c.select(cid(s("c_custkey")).alias("node")))
    edges = n.select(rid(s("n_regionkey")).alias("a"), nid(s("n_nationkey")).alias("b")).unionByName(c.select(nid(s("c_nationkey")).alias("a"), cid(s("c_custkey")).alias("b")))
    return nodes, edges, roots
