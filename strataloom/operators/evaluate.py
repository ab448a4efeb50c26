"""Evaluation: AUROC, accuracy, mean outputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scans import moving_mean, running


def _six(x: Column) -> Column:
    """Six digits of a number from 0; halves, which the mean of two such numbers often has, go by x * 10^6 in double, not by the decimal that x prints as."""
    return F.floor(x * 1e6 + 0.5).cast("double") / 1e6


def auroc(scores: DataFrame, by: str = "class") -> DataFrame:
    """(by, auroc) by the rank-sum formula with mean ranks of ties; scores: (by, score, truth 0/1).

    Distinct scores are counted first, and ranks are a running sum over slices of them.  A class without both truths has null.
    """
    tied = scores.groupBy(by, "score").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("truth").cast("long")).alias("p"))
    ranked = running(tied, by, "score", {"below": F.col("n")}).withColumn("r", F.col("below") + (F.col("n") + 1) / 2)
    sums = ranked.groupBy(by).agg(F.sum(F.col("r") * F.col("p")).alias("rs"), F.sum("p").cast("double").alias("p"), F.sum("n").cast("double").alias("n"))
    return sums.select(by, _six(F.try_divide(F.col("rs") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * (F.col("n") - F.col("p")))).alias("auroc"))


def macro(per_class: DataFrame) -> DataFrame:
    return per_class.agg(_six(F.avg("auroc")).alias("auroc"))


def accuracy(rows: DataFrame, label: str, cls: str) -> DataFrame:
    """Share of rows whose label string contains the class; null counts as no."""
    return rows.agg(F.round(F.avg(F.coalesce(F.col(label).contains(cls), F.lit(False)).cast("double")), 6).alias("accuracy"))


def crop_mean(outputs: DataFrame, by: list[str]) -> DataFrame:
    """Mean score of the crops of an image and class."""
    return outputs.groupBy(*by).agg(F.round(F.avg("score"), 6).alias("score"))


def losses(rows: DataFrame, step: str = "step", width: int = 10) -> DataFrame:
    """rows with the mean loss of the last `width` steps of an epoch."""
    return moving_mean(rows, "epoch", step, "loss", width).withColumn("running", F.round("moving", 6)).drop("moving")
