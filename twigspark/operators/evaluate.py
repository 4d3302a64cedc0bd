"""Scores of assignments against ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twigspark.operators.joins import nearest


def true_branches(points: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, id, true_branch): branch of the ground-truth point nearest to each flower."""
    return nearest(points, truth).select("image_id", "id", F.col("branch_id").alias("true_branch"))


def accuracy(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """(image_id, method, accuracy, flowers) of predictions (image_id, method, id, branch_id); flowers that one side lacks don't count."""
    j = predicted.join(truth, ["image_id", "id"])
    return j.groupBy("image_id", "method").agg(F.avg((F.col("branch_id") == F.col("true_branch")).cast("int")).alias("accuracy"), F.count("*").alias("flowers"))


def macro(scores: DataFrame) -> DataFrame:
    """(method, accuracy, images): unweighted mean over images; NaN and null don't count."""
    ok = scores.where(F.col("accuracy").isNotNull() & ~F.isnan("accuracy"))
    return ok.groupBy("method").agg(F.avg("accuracy").alias("accuracy"), F.count("*").alias("images"))
