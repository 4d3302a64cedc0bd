"""Counts of flowers by branch, level and section, and reports on runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def per_branch(assigned: DataFrame, branches: DataFrame) -> DataFrame:
    """(image_id, branch_id, flowers): zero where a branch has none."""
    n = assigned.groupBy("image_id", "branch_id").agg(F.count("*").alias("flowers"))
    return branches.select("image_id", "branch_id").join(n, ["image_id", "branch_id"], "left").withColumn("flowers", F.coalesce("flowers", F.lit(0)))


def per_level(counts: DataFrame, levels: DataFrame) -> DataFrame:
    return counts.join(levels, ["image_id", "branch_id"]).groupBy("image_id", "level").agg(F.sum("flowers").alias("flowers"), F.count("*").alias("branches"))


def branch_summary(counts: DataFrame, branches: DataFrame) -> DataFrame:
    """Per image and branch: size_px and flowers, and a total row of each image with a null branch."""
    j = branches.join(counts, ["image_id", "branch_id"])
    return j.rollup("image_id", "branch_id").agg(F.sum("size_px").alias("size_px"), F.sum("flowers").alias("flowers")).where("image_id is not null")


def distance_stats(near: DataFrame) -> DataFrame:
    return near.groupBy("image_id").agg(F.count("*").alias("flowers"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"))


def per_section(near: DataFrame, sections: DataFrame) -> DataFrame:
    """(image_id, branch_id, section_id, flowers) over all sections."""
    keys = ["image_id", "branch_id", "section_id"]
    n = near.groupBy(*keys).agg(F.count("*").alias("flowers"))
    return sections.select(*keys).distinct().join(n, keys, "left").withColumn("flowers", F.coalesce("flowers", F.lit(0)))


def ambiguity(matrix: DataFrame, threshold: float = 1.5) -> DataFrame:
    """(image_id, id, branch_id, d1, d2, ratio, nearest): the two nearest branches of each point; ratio is infinite with one branch; above threshold the nearest is taken as it is."""
    two = matrix.groupBy("image_id", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("distance", "branch_id"))), 1, 2).alias("m"))
    d1, d2 = F.col("m")[0]["distance"], F.try_element_at(F.col("m"), F.lit(2))["distance"]
    r = two.select("image_id", "id", F.col("m")[0]["branch_id"].alias("branch_id"), d1.alias("d1"), d2.alias("d2"))
    r = r.withColumn("ratio", F.when(F.col("d2").isNull(), float("inf")).otherwise(F.col("d2") / (F.col("d1") + 1e-6)))
    return r.withColumn("nearest", F.col("ratio") > threshold)


def ratio_histogram(split: DataFrame, bins: int = 40, low: float = 1.0, high: float = 5.0) -> DataFrame:
    """(bin, n) of finite ratios; those beyond high in the last bin."""
    width = (high - low) / bins
    at = F.least(F.greatest(F.floor((F.col("ratio") - low) / width), F.lit(0)), F.lit(bins - 1))
    return split.where(F.col("ratio") != float("inf")).groupBy(at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def ratio_thresholds(split: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, share) of points at or below each threshold."""
    t = F.explode(F.array(*[F.lit(float(x)) for x in thresholds])).alias("threshold")
    return split.select("ratio", t).groupBy("threshold").agg((F.count_if(F.col("ratio") <= F.col("threshold")) / F.count("*")).alias("share"))


def run_report(status: DataFrame) -> DataFrame:
    """(status, n)."""
    return status.groupBy("status").agg(F.count("*").alias("n"))


def truth_totals(points: DataFrame) -> DataFrame:
    """Per image: points, flowers, branches, and points without a branch."""
    return points.groupBy("image_id").agg(F.count("*").alias("points"), F.sum("num_flowers").alias("flowers"), F.count_distinct("branch_id").alias("branches"), F.count_if(F.col("branch_id").isNull()).alias("orphans"))


def prioritised(*columns: Column) -> Column:
    """Manual before learned before fixed."""
    return F.coalesce(*columns)
