"""Connected components of an edge table, in DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node of the component; edges: (a, b) of longs in any order.

    Each round maps every node to its smallest neighbour's smallest neighbour and
    contracts the edges, so stars vanish in one round and chains shrink by a
    factor; rounds are cut by tables in the shared folder, which go when the next round is written.
    """

    def tidy(e: DataFrame) -> DataFrame:
        return e.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    edges = _spark.written(tidy(edges), "edges")
    labels = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("label", F.col("node"))
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        near = _spark.written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "near")
        jump = near.alias("x").join(near.alias("y"), F.col("x.m") == F.col("y.a"), "left")
        step = _spark.written(jump.select("x.a", F.coalesce("y.m", "x.m").alias("to")), "step")
        old, before = labels, edges
        labels = old.join(step.withColumnRenamed("a", "label"), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        labels = _spark.written(labels, "labels")
        moved = edges.join(step.withColumnRenamed("to", "ta"), "a").join(step.select(F.col("a").alias("b"), F.col("to").alias("tb")), "b")
        edges = _spark.written(tidy(moved.select(F.col("ta").alias("a"), F.col("tb").alias("b"))), "edges")
        _spark.drop_written(before, near, step, *([old] if hasattr(old, "_written_to") else []))
    return labels
