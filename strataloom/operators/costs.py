"""Similarity costs of report pairs, lower is better; a registry by name.

A cost function takes a Pairing and gives (target_id, ref_id, cost) for the pairs
that have something in common; every pair that it leaves out has DEFAULT.  best() gives
the k best references of each target without a row for each pair; it is the way for many
references.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, graph, ontology, sets
from .workers import numbered, stored

DEFAULT = 1.0


@dataclass(frozen=True)
class Pairing:
    """Targets and references as distinct (target_id | ref_id, concept) pairs, and what some costs need besides.

    weight: (concept, weight); found: graph.bfs() with root sets named by target_id; forest: graph.forest(), which best() takes in its place;
    distances: (concept, other, depth) from single target concepts; web: the same from graph.web(), which best() takes in its place; closure, ic: ontology; pairs: (target_id, ref_id) that lin is to score.
    """

    targets: DataFrame
    refs: DataFrame
    weight: DataFrame | None = None
    target_neg: DataFrame | None = None
    ref_neg: DataFrame | None = None
    found: DataFrame | None = None
    forest: graph.Forest | None = None
    distances: DataFrame | None = None
    web: graph.Web | None = None
    closure: DataFrame | None = None
    pairs: DataFrame | None = None
    ic: DataFrame | None = None
    alpha: float = 0.5
    beta: float = 1.0
    gamma: float = 1.0
    max_depth: int = 10
    decay: float = 0.5


def _sized(p: Pairing) -> DataFrame:
    n = lambda d, k, out: sets.sizes(d, k).withColumnRenamed("size", out)
    return sets.overlaps(p.targets, p.refs).join(n(p.targets, "target_id", "nt"), "target_id").join(n(p.refs, "ref_id", "nr"), "ref_id")


def _rounded(cost: Column) -> Column:
    """Six digits, and 0.0 for -0.0, whose sign would depend on the order of a sum."""
    return F.round(cost, 6) + F.lit(0.0)


def _cost(pairs: DataFrame, sim: Column) -> DataFrame:
    return pairs.select("target_id", "ref_id", _rounded(1 - sim).alias("cost"))


def jaccard(p: Pairing) -> DataFrame:
    return _cost(_sized(p), F.col("n") / (F.col("nt") + F.col("nr") - F.col("n")))


def dice(p: Pairing) -> DataFrame:
    return _cost(_sized(p), 2 * F.col("n") / (F.col("nt") + F.col("nr")))


def overlap(p: Pairing) -> DataFrame:
    return _cost(_sized(p), F.col("n") / F.least("nt", "nr"))


def _weighed(p: Pairing) -> DataFrame:
    """(target_id, ref_id, w, wt, wr): weights of the common part and of both sides."""
    side = lambda d, k, out: sets.weights(d, k, p.weight).withColumnRenamed("w", out)
    return sets.overlaps(p.targets, p.refs, p.weight).join(side(p.targets, "target_id", "wt"), "target_id").join(side(p.refs, "ref_id", "wr"), "ref_id")


def tversky(p: Pairing) -> DataFrame:
    """alpha weighs what only the reference has, beta what only the target has (0.1 and 0.9 are usual)."""
    den = F.col("w") + p.alpha * (F.col("wr") - F.col("w")) + p.beta * (F.col("wt") - F.col("w"))
    return _cost(_weighed(p), F.coalesce(F.try_divide(F.col("w"), den), F.lit(0.0)))


def _contradictions(p: Pairing) -> DataFrame:
    """(target_id, wc): weight of the concepts that a target both has and negates."""
    both = p.targets.join(p.target_neg, ["target_id", "concept"], "left_semi")
    return sets.weights(both, "target_id", p.weight).withColumnRenamed("w", "wc")


def _synonym_overlap(p: Pairing) -> DataFrame:
    """(target_id, ref_id, ws): weight of a reference's concepts that a target reaches by synonyms alone."""
    syn = p.found.where("depth > 0 and all_sy").select(F.col("root_set").alias("target_id"), F.col("v").alias("concept"))
    return sets.overlaps(syn, p.refs, p.weight).select("target_id", "ref_id", F.col("w").alias("ws"))


def _expanded(p: Pairing, how: str) -> DataFrame:
    """_weighed() with wc and ws, 0 where there are none."""
    pairs = _weighed(p)
    if p.found is not None:
        pairs = pairs.join(_synonym_overlap(p), ["target_id", "ref_id"], how)
    pairs = pairs.join(_contradictions(p), "target_id", "left") if p.target_neg is not None else pairs.withColumn("wc", F.lit(0.0))
    ws = F.coalesce("ws", F.lit(0.0)) if p.found is not None else F.lit(0.0)
    return pairs.withColumns({"ws": ws, "wc": F.coalesce("wc", F.lit(0.0)), "w": F.coalesce("w", F.lit(0.0))})


def sym_tversky(p: Pairing) -> DataFrame:
    """Symmetric: the smaller difference has alpha, the larger 1 - alpha, both times beta; contradictions add to the denominator."""
    forward, backward = F.col("wr") - F.col("w") - F.col("ws"), F.col("wt") - F.col("w")
    den = F.col("w") + p.beta * (p.alpha * F.least(forward, backward) + (1 - p.alpha) * F.greatest(forward, backward)) + F.col("wc")
    return _cost(_expanded(p, "left"), F.when(den > 0, F.try_divide(F.col("w"), den)).otherwise(F.col("w")))


def umls_neg(p: Pairing) -> DataFrame:
    """alpha times the weighted Jaccard of positive concepts, with synonyms, plus beta times that of negated ones; contradictions in both denominators."""
    side = lambda d, k, out: sets.weights(d, k, p.weight).withColumnRenamed("w", out)
    parts = [sets.overlaps(p.targets, p.refs, p.weight).select("target_id", "ref_id", F.col("w"), F.lit(0.0).alias("ws"), F.lit(0.0).alias("wn"))]
    if p.found is not None:
        parts.append(_synonym_overlap(p).select("target_id", "ref_id", F.lit(0.0).alias("w"), "ws", F.lit(0.0).alias("wn")))
    parts.append(sets.overlaps(p.target_neg, p.ref_neg, p.weight).select("target_id", "ref_id", F.lit(0.0).alias("w"), F.lit(0.0).alias("ws"), F.col("w").alias("wn")))
    pairs = reduce(DataFrame.unionByName, parts).groupBy("target_id", "ref_id").agg(*(F.sum(c).alias(c) for c in ("w", "ws", "wn")))
    for d, k, out in ((p.targets, "target_id", "wt"), (p.refs, "ref_id", "wr"), (p.target_neg, "target_id", "wtn"), (p.ref_neg, "ref_id", "wrn")):
        pairs = pairs.join(side(d, k, out), k, "left")
    pairs = pairs.join(_contradictions(p), "target_id", "left").na.fill(0.0, ["wt", "wr", "wtn", "wrn", "wc"])
    common = F.col("w") + F.col("ws")
    den, den_neg = F.col("wt") + F.col("wr") - F.col("w") + F.col("wc"), F.col("wtn") + F.col("wrn") - F.col("wn") + F.col("wc")
    ratio = lambda a, b: F.when(b > 0, F.try_divide(a, b)).otherwise(a)
    return _cost(pairs, p.alpha * ratio(common, den) + p.beta * ratio(F.col("wn"), den_neg))


def depth(p: Pairing) -> DataFrame:
    """1 / (1 + sum over the reference's concepts at depth d of exp(-gamma (d - 1))); exact matches don't count."""
    near = p.found.where("depth > 0").select(F.col("root_set").alias("target_id"), F.col("v").alias("concept"), F.exp(-p.gamma * (F.col("depth") - 1)).alias("s"))
    sums = near.join(p.refs, "concept").groupBy("target_id", "ref_id").agg(F.sum("s").alias("s"))
    return sums.select("target_id", "ref_id", F.round(1 / (1 + F.col("s")), 6).alias("cost"))


def umls(p: Pairing) -> DataFrame:
    """Matches against distance-weighted additions on both sides; deeper levels weigh more.

    Needs found (target concepts' search) and distances (concept, other, depth) from each target concept.
    """
    weight = p.weight.withColumn("weight", F.col("weight").cast("double"))
    hit = p.found.select(F.col("root_set").alias("target_id"), F.col("v").alias("concept"), "depth").join(p.refs, "concept").join(weight, "concept", "left").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    forward = hit.where("depth > 0").groupBy("target_id", "ref_id", F.col("depth").alias("d")).agg(F.sum("weight").alias("f"))
    reach = hit.groupBy("target_id", "ref_id").agg(F.sum(F.when(F.col("depth") == 0, F.col("weight")).otherwise(0.0)).alias("w"), F.sum("weight").alias("seen"))
    near = p.targets.join(p.distances, "concept").join(p.refs.withColumnRenamed("concept", "other"), "other").groupBy("target_id", "ref_id", "concept").agg(F.min("depth").alias("d"))
    reverse = near.where((F.col("d") >= 1) & (F.col("d") <= p.max_depth)).join(weight, "concept", "left").groupBy("target_id", "ref_id", "d").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("r"))
    levels = forward.join(reverse, ["target_id", "ref_id", "d"], "full").withColumn("a", F.coalesce("f", F.lit(0.0)) + F.coalesce("r", F.lit(0.0)))
    lists = levels.groupBy("target_id", "ref_id").agg(F.max(F.when(F.col("a") > 0, F.col("d") - 1)).alias("m"), F.collect_list(F.struct("d", "a")).alias("l"))
    total = sets.weights(p.refs, "ref_id", p.weight).withColumnRenamed("w", "wr")
    pairs = reach.join(total, "ref_id").join(lists, ["target_id", "ref_id"], "left").withColumn("m", F.coalesce("m", F.lit(0)))
    added = F.coalesce(F.aggregate(F.array_sort(F.filter("l", lambda x: x["d"] - 1 <= F.col("m"))), F.lit(0.0), lambda s, x: s + F.exp(-p.decay * (F.col("m") + 2 - x["d"])) * x["d"] * x["a"]), F.lit(0.0))
    lost = 2 * (F.col("wr") - F.col("seen")) * (F.col("m") + 1)
    den = F.col("w") + added + lost
    return _cost(pairs, F.when(den == 0, 0.0).otherwise(F.try_divide(F.col("w"), den)))


def lin(p: Pairing) -> DataFrame:
    """Information content, for the given pairs, or else those that share a concept."""
    pairs = p.pairs if p.pairs is not None else sets.overlaps(p.targets, p.refs).select("target_id", "ref_id")
    return ontology.lin_cost(pairs, p.targets, p.refs, p.closure, p.ic).withColumn("cost", _rounded(F.col("cost")))


REGISTRY: dict[str, Callable[[Pairing], DataFrame]] = {"jac": jaccard, "dice": dice, "overlap": overlap, "tversky": tversky, "sym_tversky": sym_tversky, "umls_neg": umls_neg, "depth": depth, "umls": umls, "lin": lin}


def cost(name: str, p: Pairing) -> DataFrame:
    """The named cost of the pairs."""
    if name not in REGISTRY:
        raise NotImplementedError(f"no cost is named {name!r}; there are {sorted(REGISTRY)}")
    return REGISTRY[name](p)


def _measured(pairs: DataFrame, key: str, weight: DataFrame | None, n: str, w: str, concepts: str | None = None) -> DataFrame:
    """(key, n, w), and the concepts' numbers as an array: number and weight of each key's concepts."""
    weighed = pairs.withColumn("weight", F.lit(1)) if weight is None else pairs.join(weight, "concept", "left")
    more = [F.collect_list("n").alias(concepts)] if concepts else []
    return weighed.groupBy(key).agg(F.count(F.lit(1)).alias(n), F.sum(F.coalesce("weight", F.lit(0))).cast("double").alias(w), *more)


def _weights(pairs: DataFrame, weight: DataFrame | None) -> DataFrame:
    """(target_id, concept, w)."""
    if weight is None:
        return pairs.select("target_id", "concept", F.lit(1.0).alias("w"))
    return pairs.join(weight, "concept", "left").select("target_id", "concept", F.coalesce("weight", F.lit(0)).alias("w"))


def concept_numbers(*refs: DataFrame) -> DataFrame:
    """(concept, n) of the references' concepts."""
    return numbered(reduce(DataFrame.unionByName, (d.select("concept") for d in refs)), "concept")


def compared(name: str, p: Pairing, targets: DataFrame | None = None, refs: DataFrame | None = None, concepts: DataFrame | None = None, reach: bool = False) -> tuple[blocks.Search, blocks.Formula]:
    """What a block search sums for the named cost, and the formula (valid, cost) of the sums; targets, refs: further (target_id | ref_id) without concepts; reach: a mask of that name says what p.forest found."""
    if name not in REGISTRY:
        raise NotImplementedError(f"no cost that can be compared in blocks is named {name!r}")
    none = p.refs.limit(0)
    neg = p.ref_neg if p.ref_neg is not None else none
    concepts = concept_numbers(p.refs, neg) if concepts is None else concepts
    own = lambda d: d.join(concepts, "concept")  # noqa: E731  every concept of a reference has a number
    r = _measured(own(p.refs), "ref_id", p.weight, "nr", "wr", "pos").join(_measured(own(neg), "ref_id", p.weight, "nrn", "wrn", "neg"), "ref_id", "full")
    r = r if refs is None else refs.select("ref_id").distinct().join(r, "ref_id", "left")
    r = r.select("ref_id", "pos", "neg", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("nr", "wr", "nrn", "wrn")))
    t_neg = p.target_neg if p.target_neg is not None else p.targets.limit(0)
    t = _measured(p.targets, "target_id", p.weight, "nt", "wt").join(_measured(t_neg, "target_id", p.weight, "ntn", "wtn"), "target_id", "full")
    t = t if targets is None else targets.select("target_id").distinct().join(t, "target_id", "left")
    if p.target_neg is not None and p.weight is not None:
        t = t.join(_contradictions(p), "target_id", "left")
    else:
        t = t.withColumn("wc", F.lit(0.0))
    t = t.select("target_id", *(F.coalesce(c, F.lit(0)).cast("double").alias(c) for c in ("nt", "wt", "ntn", "wtn", "wc")))
    kinds, masks, near, deepest = {"own": ("pos", _weights(p.targets, p.weight))}, {}, {}, 0
    found = p.found.withColumnsRenamed({"root_set": "target_id", "v": "concept"}) if p.found is not None else None
    levels = p.forest.levels.select(F.col("v").alias("concept"), F.col("chunk").alias("block"), "depth", "mask", "all_sy") if p.forest is not None else None
    weighed = lambda d: d.withColumn("w", F.lit(1.0)) if p.weight is None else d.join(p.weight, "concept", "left").withColumn("w", F.coalesce("weight", F.lit(0)).cast("double"))
    side, kin = "pos", None
    if levels is not None and p.forest.twins is not None:
        side, kin = "kin", _kin(p)
        own_kin = p.refs.join(kin, "concept").groupBy("ref_id").agg(F.array_sort(F.collect_list("c")).alias("kin"))
        r = r.join(own_kin, "ref_id", "left")
        names = stored(kin.select(F.col("name").alias("concept"), "c", F.col("weight").alias("w")).distinct())
        levels = levels.join(names, "concept")
        weighed = lambda d: d  # noqa: E731  the names' weights are those of their concepts
    if name in ("sym_tversky", "umls_neg") and levels is not None:
        masks["syn"] = side, weighed(levels.where("depth > 0").select(*(["c", "w"] if kin is not None else ["concept"]), "block", F.col("all_sy").alias("mask")))
    elif name in ("sym_tversky", "umls_neg") and found is not None:
        kinds["syn"] = "pos", _weights(found.where("depth > 0 and all_sy"), p.weight)
    if name == "umls_neg":
        kinds["negated"] = "neg", _weights(t_neg, p.weight)
    if name == "depth":
        decayed = F.exp(-p.gamma * (F.col("depth") - 1)).alias("w")
        kinds = {"near": ("pos", found.where("depth > 0").select("target_id", "concept", decayed))} if levels is None else {}
        masks = {"near": (side, levels.where("depth > 0").select("c" if kin is not None else "concept", "block", "mask", decayed))} if levels is not None else {}
    if name == "umls":
        if targets is None:
            kinds["own"] = "pos", _weights(p.targets, p.weight).where("w <> 0")
        web = p.web if p.web is not None else graph.web_of(p.distances.select(F.col("concept").alias("root"), F.col("other").alias("v"), "depth"))
        near, deepest = {"near": ("pos", _weights(p.targets, p.weight).withColumnRenamed("w", "v"), web)}, web.deepest
        r, t = _placed(p, concepts, web, r if refs is not None or kin is not None else None), t if targets is not None else p.targets.groupBy("target_id").agg(F.count(F.lit(1)).alias("nt"))
    if reach:
        masks["reach"] = side, levels.where("depth > 0" if kin is not None else "true").select("c" if kin is not None else "concept", "block", "mask", F.lit(None).cast("double").alias("w"))
    if kin is not None:
        kinds["self"] = "pos", p.targets.join(kin, "concept").select("target_id", "concept", F.col("c").alias("w"))
    contents = None
    if name == "lin":
        r, t, contents = _contents(p, r, t)
    alpha, beta, decay, max_depth = p.alpha, p.beta, p.decay, p.max_depth

    def formula(s, t, r):
        ratio = lambda a, b, other: np.divide(a, b, out=np.broadcast_to(np.asarray(other, np.float64), np.shape(b)).copy(), where=b > 0)
        ratio_of = lambda a, b: np.divide(a, b, out=np.zeros(np.broadcast_shapes(np.shape(a), np.shape(b))), where=b != 0)
        if name == "depth":
            return s["n_near"] > 0, blocks.rounded(1 / (1 + s["near"]))
        if name == "umls":
            return _umls(s, r, decay, deepest, max_depth)
        n, w = s["n_own"], s["own"]
        valid, syn = n > 0, s.get("syn", 0.0)
        if name == "jac":
            sim = n / np.maximum(t["nt"] + r["nr"] - n, 1)
        elif name == "dice":
            sim = 2 * n / np.maximum(t["nt"] + r["nr"], 1)
        elif name == "lin":
            den, some = t["mt"] + r["mr"], (t["kt"] > 0) & (r["kr"] > 0)
            sim = np.where(some, ratio_of(2 * s["bma"], den), (t["kt"] == 0) & (r["kr"] == 0))
        elif name == "overlap":
            sim = n / np.maximum(np.minimum(t["nt"], r["nr"]), 1)
        elif name == "tversky":
            sim = ratio(w, w + alpha * (r["wr"] - w) + beta * (t["wt"] - w), 0.0)
        elif name == "sym_tversky":
            forward, backward = r["wr"] - w - syn, t["wt"] - w
            sim = ratio(w, w + beta * (alpha * np.minimum(forward, backward) + (1 - alpha) * np.maximum(forward, backward)) + t["wc"], w)
        else:
            common, lost = w + syn, s["negated"]
            sim = alpha * ratio(common, t["wt"] + r["wr"] - w + t["wc"], common) + beta * ratio(lost, t["wtn"] + r["wrn"] - lost + t["wc"], lost)
            valid = valid | (s["n_negated"] > 0) | (s["n_syn"] > 0 if "n_syn" in s else False)  # a mask's count is whether there are any
        return valid, blocks.rounded(1 - sim)

    where = {} if p.forest is None else {"numbers": p.forest.numbers.withColumnRenamed("root_set", "target_id"), "width": p.forest.width}
    return blocks.Search(kinds, t, r, concepts, contents, near, masks, **where), formula


def _placed(p: Pairing, concepts: DataFrame, web: graph.Web, refs: DataFrame | None) -> DataFrame:
    """References with their concepts, those's numbers in the web and weights as near_z and near_w, and the sum wr; refs: those to be had, where some have no concept."""
    known = concepts.join(web.places.withColumnRenamed("v", "concept"), "concept", "left")
    known = known.withColumn("weight", F.lit(1)) if p.weight is None else known.join(p.weight, "concept", "left")
    known = known.select("concept", "n", F.coalesce("z", F.lit(-1)).cast("int").alias("z"), F.coalesce("weight", F.lit(0)).cast("double").alias("w"))
    lists = p.refs.join(known, "concept").groupBy("ref_id").agg(F.collect_list(F.struct("n", "z", "w")).alias("l"), F.sum("w").alias("wr"))
    lists = lists.select("ref_id", F.col("l.n").alias("pos"), F.col("l.z").alias("near_z"), F.col("l.w").alias("near_w"), "wr")
    if refs is None:
        return lists.withColumn("neg", F.array().cast("array<long>"))
    return refs.drop("pos", "wr").join(lists, "ref_id", "left").na.fill(0.0, ["wr"])


def _kin(p: Pairing) -> DataFrame:
    """(concept, name, weight, c): what the references' concepts stand for in the forest, with their weights, and its number."""
    known = p.refs.select("concept").distinct().join(p.forest.twins.withColumnRenamed("v", "concept"), "concept", "left").withColumn("name", F.coalesce("name", "concept"))
    known = known.withColumn("weight", F.lit(1)) if p.weight is None else known.join(p.weight, "concept", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    known = stored(known.withColumn("kin", F.struct("name", "weight")))
    return stored(known.join(numbered(known, "kin").withColumnRenamed("n", "c"), "kin").select("concept", "name", "weight", "c"))


def _contents(p: Pairing, refs: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """refs with c_z, c_ic, kr, mr and targets with kt, mt: number and mean content of the concepts that the hierarchy has; and what a block search takes as contents."""
    up = ontology.ranked(p.closure, p.ic).select(F.col("node").alias("concept"), F.col("up").alias("z"), F.col("ics").alias("up")).join(p.ic.withColumnRenamed("node", "concept"), "concept")
    up = stored(up)
    some = lambda d, key, k, m: d.groupBy(key).agg(F.count(F.lit(1)).alias(k), F.avg("ic").alias(m))
    r, t = p.refs.join(up, "concept"), p.targets.join(up, "concept")
    lists = r.groupBy("ref_id").agg(F.collect_list(F.struct("z", "up")).alias("l"), F.count(F.lit(1)).alias("kr"), F.avg("ic").alias("mr"))
    refs = refs.join(lists.select("ref_id", F.col("l.z").alias("c_z"), F.col("l.up").alias("c_ic"), "kr", "mr"), "ref_id", "left").na.fill(0, ["kr", "mr"])
    return refs, targets.join(some(t, "target_id", "kt", "mt"), "target_id", "left").na.fill(0, ["kt", "mt"]), t.select("target_id", F.col("concept").alias("own"), "z", F.col("up").alias("ic"))


def _umls(s: dict, r: dict, decay: float, deepest: int, max_depth: int) -> tuple[np.ndarray, np.ndarray]:
    """The formula of umls(); f0, f1, ..: weights of the reference's concepts by depth; r0, r1, ..: those of the target's."""
    w, seen = s["f0"], sum(s[f"f{d}"] for d in range(deepest + 1))
    levels = [s[f"f{d}"] + s[f"r{d}"] if d <= max_depth else s[f"f{d}"] for d in range(1, deepest + 1)]
    m = np.zeros(w.shape)
    for d, a in enumerate(levels, 1):
        m = np.where(a > 0, d - 1, m)
    added = sum(np.where(d - 1 <= m, np.exp(-decay * (m + 2 - d)) * d * a, 0.0) for d, a in enumerate(levels, 1)) if levels else 0.0
    den = w + added + 2 * (r["wr"] - seen) * (m + 1)
    return s["n_near"], blocks.rounded(1 - np.divide(w, den, out=np.zeros(w.shape), where=den != 0))


#: Costs that are DEFAULT unless the sets have a common concept.
SHARING = ("jac", "dice", "overlap", "tversky", "sym_tversky")


def best(name: str, p: Pairing, k: int, cells=None) -> DataFrame:
    """(target_id, ref_id, cost, rank): the k references of least named cost of each target, ties by ref_id, among those that cost() would give; cells: an accumulator of the pairs compared."""
    what, formula = compared(name, p)

    def columns(s, t, r):
        valid, value = formula(s, t, r)
        return valid, {"cost": value}

    bound = {"live": ("own",)} if name in (*SHARING, "lin") else {}
    if name == "umls":  # a pair without a common weight has DEFAULT, if any of its concepts are connected
        bound = {"live": ("own",), "floor": lambda t: DEFAULT, "like": lambda t: np.zeros(len(t["nt"]))}
    if name in ("depth", "umls_neg") and p.forest is not None and p.forest.twins is not None:  # what they share lowers or raises what masks give, but neither sum raises the cost
        bound = {"live": ("self",) if name == "depth" else ("own", "negated"), "alike": () if name == "depth" else ("wr", "wt", "wc")}
    return blocks.search(what, columns, ["cost"], k, cells=cells, **bound)
