"""Concept hierarchies: ancestors, intrinsic information content, and similarities from them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import numbered, ship
from .workers import stored as cut


def leaf_paths(hier: DataFrame) -> DataFrame:
    """(node, n): number of downward paths from a node to leaves, by a level loop over distinct (child, parent) edges of a DAG."""
    nodes = hier.select(F.col("child").alias("node")).union(hier.select("parent")).distinct()
    leaves = nodes.join(hier.select(F.col("parent").alias("node")), "node", "left_anti")
    level = cut(leaves.withColumn("n", F.lit(1).cast("long")))
    every = level
    left = nodes.count()
    while True:
        left -= 1
        if left < -1:
            raise ValueError("the hierarchy has a cycle")  # no path is longer than there are nodes
        level = cut(level.join(hier, level["node"] == hier["child"]).groupBy(F.col("parent").alias("node")).agg(F.sum("n").alias("n")))
        if level.isEmpty():
            break
        every = every.unionByName(level)
    return every.groupBy("node").agg(F.sum("n").alias("n"))


def information_content(hier: DataFrame, isolated: DataFrame | None = None) -> DataFrame:
    """(node, ic): -ln(leaf paths / leaves), not clamped; isolated nodes (node) have 0."""
    counts = leaf_paths(hier)
    parents = hier.select(F.col("parent").alias("node")).distinct()
    leaves = counts.join(parents, "node", "left_anti").agg(F.count(F.lit(1)).alias("leaves"))  # one row
    out = counts.join(F.broadcast(leaves)).select("node", (-F.log(F.col("n") / F.col("leaves"))).alias("ic"))
    if isolated is not None:
        out = out.unionByName(isolated.join(out, "node", "left_anti").select("node", F.lit(0.0).alias("ic")))
    return out


def ancestors(hier: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (node, ancestor), a node being its own; for the given nodes (node), or all."""
    if nodes is None:
        nodes = hier.select(F.col("child").alias("node")).union(hier.select("parent")).distinct()
    every = level = cut(nodes.select("node", F.col("node").alias("ancestor")).distinct())
    while True:
        up = level.join(hier, level["ancestor"] == hier["child"]).select("node", F.col("parent").alias("ancestor")).distinct()
        level = cut(up.join(every, ["node", "ancestor"], "left_anti"))
        if level.isEmpty():
            return every
        every = every.unionByName(level)


def ranked(closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(node, up, ics): each node's ancestors as numbers, and their information contents, the largest content first; ancestors without one are left out."""
    known = cut(ic.select(F.col("node").alias("ancestor"), "ic", F.struct((-F.col("ic")).alias("by"), "node").alias("place")))
    known = known.join(numbered(known, "place").withColumnRenamed("n", "z"), "place").select("ancestor", "ic", "z")
    up = closure.join(known, "ancestor").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("z", "ic"))).alias("l"))
    return cut(up.select("node", F.col("l.z").alias("up"), F.col("l.ic").alias("ics")))


def mica(pairs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(a, b, ic): largest information content of the common ancestors of each pair (a, b); 0 if there is none.

    A pair stays one row: the first number that both lists of ancestors have is that of the largest content.
    """
    up = ranked(closure, ic)
    left = up.select(F.col("node").alias("a"), F.col("up").alias("up_a"), "ics")
    right = up.select(F.col("node").alias("b"), F.col("up").alias("up_b"))
    both = pairs.select("a", "b").distinct().join(left, "a", "left").join(right, "b", "left")
    first = F.get("ics", (F.array_position("up_a", F.get(F.array_intersect("up_a", "up_b"), 0)) - 1).cast("int"))
    return both.select("a", "b", F.coalesce(first, F.lit(0.0)).alias("ic"))


def mean_ic(sets: DataFrame, key: str, ic: DataFrame) -> DataFrame:
    """(key, mean_ic) of sets (key, concept); concepts outside the hierarchy are dropped."""
    return sets.join(ic.withColumnRenamed("node", "concept"), "concept").groupBy(key).agg(F.avg("ic").alias("mean_ic"))


def best_match(pairs: DataFrame, targets: DataFrame, refs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(target_id, ref_id, bma): half the mean over target concepts of their best match, plus half the mean over reference concepts.

    pairs: (target_id, ref_id); concepts outside the hierarchy are dropped; pairs with an empty side are left out.
    A pair stays one row, with the numbers of both sides' ancestors; no row is made for two concepts.
    """
    ship(pairs.sparkSession)
    up = ic.select("node").join(ranked(closure, ic), "node", "left").select(F.col("node").alias("concept"), F.coalesce("up", F.array().cast("array<long>")).alias("up"), F.coalesce("ics", F.array().cast("array<double>")).alias("ics"))
    listed = lambda d, key, *c: d.join(up, "concept").groupBy(key).agg(*(F.collect_list(x).alias(f"{key[0]}_{x}") for x in c))
    both = pairs.join(listed(targets, "target_id", "up", "ics"), "target_id").join(listed(refs, "ref_id", "up"), "ref_id")
    kinds = {c: both.schema[c].dataType.simpleString() for c in ("target_id", "ref_id")}
    return both.mapInArrow(_best_matches, ", ".join([*(f"{c} {t}" for c, t in kinds.items()), "bma double"]))


#: Pairs of concepts that are matched at once.
MATCHED = 1 << 20


def listed_numbers(start: np.ndarray, size: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Lists of numbers, as what common_content() looks in."""
    return np.sort((np.repeat(np.arange(len(size)), size) << 32) | numbers)


def common_content(a: np.ndarray, b: np.ndarray, lists: tuple, known: np.ndarray) -> np.ndarray:
    """For each i, the content of the first number of list a[i] that list b[i] has too, 0 if there is none.

    lists: (start, size, numbers, contents) of the a's, each with its largest content first; known: listed_numbers() of the b's.
    """
    start, size, numbers, contents = lists
    out = np.zeros(len(a))
    left = np.arange(len(a)) if len(known) else np.zeros(0, np.int64)
    step = 0
    while (left := left[size[a[left]] > step]).size:  # the next number of each list that has no match yet
        at = start[a[left]] + step
        want = (b[left] << 32) | numbers[at]
        hit = known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want
        out[left[hit]] = contents[at[hit]]
        left, step = left[~hit], step + 1
    return out


def means_of_best(a0: np.ndarray, an: np.ndarray, b0: np.ndarray, bn: np.ndarray, value) -> np.ndarray:
    """Half the mean over each a of its largest value with any b, plus half the same the other way; pair i has `an` a's from a0 on and `bn` b's from b0 on, at least one each."""
    out = np.zeros(len(an))
    edge = np.r_[0, np.cumsum(an * bn)]
    first = 0
    while first < len(an):  # a bounded number of values at once
        last = max(first + 1, int(np.searchsorted(edge, edge[first] + MATCHED, "right")) - 1)
        some = slice(first, last)
        n = an[some] * bn[some]
        at = np.cumsum(n) - n
        pair = np.repeat(np.arange(len(n)), n)
        nth = np.arange(int(n.sum())) - at[pair]
        i, j = nth // bn[some][pair], nth % bn[some][pair]
        v = value(a0[some][pair] + i, b0[some][pair] + j)
        row = np.cumsum(an[some]) - an[some]
        forward = np.maximum.reduceat(v, np.flatnonzero(j == 0))
        column = np.cumsum(bn[some]) - bn[some]
        backward = np.full(int(bn[some].sum()), -np.inf)
        np.maximum.at(backward, column[pair] + j, v)
        out[some] = (np.add.reduceat(forward, row) / an[some] + np.add.reduceat(backward, column) / bn[some]) / 2
        first = last
    return out


def nested(column) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of lists of lists: the first inner list and the number of inner lists of each row, and the inner lists."""
    n = np.asarray(pc.list_value_length(column).fill_null(0), np.int64)
    return np.cumsum(n) - n, n, column.flatten()


def _best_matches(batches):
    """(target_id, ref_id, bma) of rows with t_up, t_ics and r_up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        (a0, an, a), (b0, bn, b) = nested(batch.column("t_up")), nested(batch.column("r_up"))
        numbers = lambda x: nested(x)[:2] + (np.asarray(x.flatten(), np.int64),)
        lists, known = (*numbers(a), np.asarray(batch.column("t_ics").flatten().flatten(), np.float64)), listed_numbers(*numbers(b))
        bma = means_of_best(a0, an, b0, bn, lambda i, j: common_content(i, j, lists, known))
        yield pa.RecordBatch.from_arrays([batch.column("target_id"), batch.column("ref_id"), pa.array(bma)], ["target_id", "ref_id", "bma"])


def lin_cost(pairs: DataFrame, targets: DataFrame, refs: DataFrame, closure: DataFrame, ic: DataFrame) -> DataFrame:
    """(target_id, ref_id, cost): 1 - 2 * best match / (mean contents); both sets empty 0, one empty 1, zero denominator 1."""
    bma = best_match(pairs, targets, refs, closure, ic)
    got = pairs.join(bma, ["target_id", "ref_id"], "left").join(mean_ic(targets, "target_id", ic).withColumnRenamed("mean_ic", "mt"), "target_id", "left").join(mean_ic(refs, "ref_id", ic).withColumnRenamed("mean_ic", "mr"), "ref_id", "left")
    den = F.col("mt") + F.col("mr")
    cost = F.when(F.col("mt").isNull() & F.col("mr").isNull(), 0.0).when(F.col("mt").isNull() | F.col("mr").isNull(), 1.0).when(den == 0, 1.0).otherwise(1 - F.try_divide(2 * F.col("bma"), den))
    return got.select("target_id", "ref_id", cost.alias("cost"))


def kept(hier: DataFrame, keep: DataFrame, max_depth: int) -> tuple[DataFrame, DataFrame]:
    """The hierarchy up to max_depth levels above the kept nodes (node), and the kept nodes that have no edge there (node)."""
    level, edges = keep.select("node").distinct(), None
    for _ in range(max_depth):
        up = cut(level.join(hier, level["node"] == hier["child"]).select("child", "parent").distinct())
        if up.isEmpty():
            break
        edges = up if edges is None else edges.unionByName(up)
        level = up.select(F.col("parent").alias("node")).distinct()
    edges = hier.limit(0).select("child", "parent") if edges is None else cut(edges.distinct())
    inside = edges.select(F.col("child").alias("node")).union(edges.select("parent"))
    return edges, keep.select("node").distinct().join(inside, "node", "left_anti")
