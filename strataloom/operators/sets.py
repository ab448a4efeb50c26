"""Concept sets: building, inverting, overlapping and weighing them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def as_arrays(pairs: DataFrame, key: str, concept: str = "concept") -> DataFrame:
    """(key, cset): sorted distinct concepts, which can serve as a group key."""
    return pairs.groupBy(key).agg(F.array_sort(F.collect_set(concept)).alias("cset"))


def inverted(sets: DataFrame, key: str) -> DataFrame:
    """(cset, ids): rows that share a set."""
    return sets.groupBy("cset").agg(F.array_sort(F.collect_list(key)).alias("ids"))


def universe(pairs: DataFrame, concept: str = "concept") -> DataFrame:
    return pairs.select(concept).distinct()


def weights(pairs: DataFrame, key: str, weight: DataFrame) -> DataFrame:
    """(key, w): sum of the weights of each key's concepts; concepts without one count 0."""
    return pairs.join(weight, "concept", "left").groupBy(key).agg(F.sum(F.coalesce("weight", F.lit(0))).cast("double").alias("w"))


def overlaps(targets: DataFrame, refs: DataFrame, weight: DataFrame | None = None) -> DataFrame:
    """(target_id, ref_id, n, w): size and weight of the common concepts of pairs that have any.

    targets: (target_id, concept), refs: (ref_id, concept), distinct pairs each.
    """
    t = targets
    if weight is not None:
        t = targets.join(weight, "concept", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    else:
        t = t.withColumn("weight", F.lit(1))
    return t.join(refs, "concept").groupBy("target_id", "ref_id").agg(F.count(F.lit(1)).cast("long").alias("n"), F.sum("weight").cast("double").alias("w"))


def sizes(pairs: DataFrame, key: str) -> DataFrame:
    return pairs.groupBy(key).agg(F.count(F.lit(1)).cast("long").alias("size"))


def important(pairs: DataFrame, weight: DataFrame) -> DataFrame:
    """The pairs whose concept has a weight over 0; weight: (concept, weight)."""
    return pairs.join(weight.where("weight > 0").select("concept"), "concept", "left_semi")
