"""Concept graphs: edges, multi-source breadth-first search, and what depends on its tree.

Undirected edges are rows (src, dst, rels) in both directions; rels is the sorted
array of relation codes.  A search runs for all root sets in one loop of joins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import drop, numbered, ship, stored


def keep_edges(pairs: DataFrame, keep: DataFrame, both: bool = True) -> DataFrame:
    """Relations (a, b, rel) with both ends (or either) in keep (concept)."""
    at = lambda c: keep.select(F.col("concept").alias(c)).distinct()
    if both:
        return pairs.join(at("a"), "a", "left_semi").join(at("b"), "b", "left_semi")
    flag = lambda c: at(c).withColumn(f"_{c}", F.lit(True))
    return pairs.join(flag("a"), "a", "left").join(flag("b"), "b", "left").where("_a or _b").select("a", "b", "rel")


def edge_relations(pairs: DataFrame) -> DataFrame:
    """(a, b, rels) with a < b: all codes between two concepts; self loops go."""
    tidy = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "rel")
    return tidy.groupBy("a", "b").agg(F.array_sort(F.collect_set("rel")).alias("rels"))


def both_ways(edges: DataFrame) -> DataFrame:
    one = edges.select(F.col("a").alias("src"), F.col("b").alias("dst"), "rels")
    return one.unionByName(edges.select(F.col("b").alias("src"), F.col("a").alias("dst"), "rels"))


def vertices(edges: DataFrame, keep: DataFrame) -> DataFrame:
    """(concept, degree): ends of edges, and kept concepts without any."""
    ends = edges.select(F.col("a").alias("concept")).unionAll(edges.select("b"))
    return keep.select("concept").distinct().join(ends.groupBy("concept").agg(F.count(F.lit(1)).alias("degree")), "concept", "full").select("concept", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def in_degree(edges: DataFrame, nodes: DataFrame, dst: str = "parent") -> DataFrame:
    counts = edges.groupBy(F.col(dst).alias("node")).agg(F.count(F.lit(1)).alias("n"))
    return nodes.join(counts, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("in_degree"))


#: Root sets in a mask; degree from which a vertex's neighbours are folded by parts first.
WIDTH, HUB = 1024, 65_536
_TREE = ("only_sy", "true", "steps", "cost")


@dataclass(frozen=True)
class Forest:
    """Breadth-first trees of many root sets: a row for a vertex, depth and chunk of `width` root sets, whose masks have a bit for each.

    levels: (v, chunk, depth, mask, all_sy), or with the tree one row for each parent (pred), and only_sy,
    and true, steps and cost: 16-bit and 32-bit numbers a bit.  numbers: (root_set, n); n counts bits through the chunks.
    twins: (v, name); if there, rows of depth 1 and more under a name hold for all its vertices, but for the root sets that have them.
    """

    levels: DataFrame
    numbers: DataFrame
    width: int
    tree: bool
    twins: DataFrame | None = None


def _bits(column) -> np.ndarray:
    """A column of equally long binaries as rows of bytes."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return np.zeros((0, 1), np.uint8)
    offs = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2], np.uint8)[offs[0] : offs[-1]].reshape(len(column), -1)


def _binary(rows: np.ndarray) -> pa.Array:
    if not len(rows):
        return pa.array([], pa.binary())
    rows = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    offs = np.arange(len(rows) + 1, dtype=np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offs), pa.py_buffer(rows)])


def _fold(rows: DataFrame, tree: bool, keys: list[str]) -> DataFrame:
    """What each (v, chunk) takes from its neighbours in ascending order, bits once, as `fresh` rows, and what it has seen then.

    rows: keys, src (null for the row of what was seen), mask, all_sy, those of the tree, and the edge's raw, e_sy, e_any, e_step, e_cost.
    A task goes through sorted rows and holds those of a batch and one vertex.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    more = list(_TREE) if tree else []
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in keys), "fresh boolean", f"pred {kinds['src']}", "mask binary", "all_sy binary", *(f"{c} binary" for c in more)])

    def folded(batch):
        n = batch.num_rows
        new = np.zeros(n, bool)
        new[0] = True
        for c in keys:
            col = batch.column(c)
            new[1:] |= np.asarray(pc.fill_null(pc.not_equal(col.slice(1), col.slice(0, n - 1)), False), bool)
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        group = np.repeat(np.arange(len(start)), size)
        mask, known = _bits(batch.column("mask")), np.asarray(batch.column("src").is_null(), bool)
        acc = np.zeros((len(start), mask.shape[1]), np.uint8)
        acc[group[known]] = mask[known]
        before, took = acc.copy(), np.zeros_like(mask)
        at, left = start + known[start], size - known[start]
        while (some := np.flatnonzero(left > 0)).size:
            row = at[some]
            took[row] = mask[row] & ~acc[some]
            acc[some] |= took[row]
            at, left = at + 1, left - 1
        column = lambda c: _bits(batch.column(c))
        flag = lambda c: np.where(np.asarray(batch.column(c).fill_null(False), bool), np.uint8(255), np.uint8(0))[:, None]
        all_sy = took & column("all_sy") & flag("e_sy")
        out, keep = [], np.flatnonzero(took.any(1))
        if tree:
            step, cost = np.asarray(batch.column("e_step").fill_null(False), np.int16), np.asarray(batch.column("e_cost").fill_null(0.0), np.float32)
            true, raw = column("true").view(np.int16)[keep], flag("raw")[keep] > 0
            steps = np.where(raw, true + np.int16(1), column("steps").view(np.int16)[keep])
            only = (took & column("only_sy") & flag("e_any"))[keep]
            bits = np.unpackbits(took[keep], axis=1, bitorder="little")
            numbers = [bits * x for x in (true + step[keep, None], steps, column("cost").view(np.float32)[keep] + cost[keep, None])]
            if len(keep):  # what came from one neighbour in several rows is one row again
                src = batch.column("src").take(pa.array(keep))
                other = np.asarray(pc.fill_null(pc.not_equal(src.slice(1), src.slice(0, len(keep) - 1)), True), bool)
                run = np.flatnonzero(np.r_[True, other | (group[keep][1:] != group[keep][:-1])])
                masks = [np.bitwise_or.reduceat(x, run) for x in (took[keep], all_sy[keep], only)]
                values = [*masks, *(np.add.reduceat(x, run).astype(x.dtype) for x in numbers)]
                pick = pa.array(keep[run])
                out.append([*(batch.column(c).take(pick) for c in keys), pa.array(np.ones(len(run), bool)), batch.column("src").take(pick), *map(_binary, values)])
        else:
            sy = np.zeros_like(acc)
            np.bitwise_or.at(sy, group[keep], all_sy[keep])
            fresh = np.flatnonzero((acc & ~before).any(1))
            out.append([*(batch.column(c).take(pa.array(start[fresh])) for c in keys), pa.array(np.ones(len(fresh), bool)), batch.column("src").take(pa.array((start + size - 1)[fresh])), _binary((acc & ~before)[fresh]), _binary(sy[fresh])])
        none = pa.nulls(len(start), pa.binary())
        out.append([*(batch.column(c).take(pa.array(start)) for c in keys), pa.array(np.zeros(len(start), bool)), pa.nulls(len(start), batch.schema.field("src").type), _binary(acc), none, *(none for _ in more)])
        names = [*keys, "fresh", "pred", "mask", "all_sy", *more]
        return [pa.RecordBatch.from_arrays(columns, names) for columns in out]

    def run(batches):
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = batch if held is None else pa.RecordBatch.from_struct_array(pa.concat_arrays([held.to_struct_array(), batch.to_struct_array()]))
            last = whole.num_rows - 1
            while last and all(whole.column(c)[last].equals(whole.column(c)[last - 1]) for c in keys):
                last -= 1
            held = whole.slice(last)
            if last:
                yield from folded(whole.slice(0, last))
        if held is not None:
            yield from folded(held)

    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ship(rows.sparkSession)
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys, F.asc_nulls_first("src")).mapInArrow(run, schema)


def _cut_flags(edges: DataFrame, hub: int) -> tuple[DataFrame, bool]:
    """Edges with what the search needs of their codes, and the part of a hub's neighbours that each is in (null for others); whether there are hubs."""
    other = F.array_except("rels", F.array(F.lit("RQ"), F.lit("SY")))
    flags = edges.where("src is not null and dst is not null").select(
        "src", "dst", F.array_contains("rels", "SY").alias("e_sy"), F.arrays_overlap("rels", F.array(*map(F.lit, ("RL", "RQ", "SY")))).alias("e_any"),
        (F.size(other) > 0).alias("e_step"), F.when(F.size(other) == 0, 0.0).when(F.array_contains(other, "CHD"), 0.5).otherwise(1.0).alias("e_cost"), F.lit(True).alias("raw"),
    )
    flags = stored(flags)
    hubs = stored(flags.groupBy("dst").agg(F.count(F.lit(1)).alias("degree")).where(F.col("degree") > hub).select("dst", F.lit(True).alias("_hub")))
    if hubs.isEmpty():
        return flags.withColumn("part", F.lit(None).cast("long")), False
    at = numbered(flags.join(hubs, "dst", "left_semi"), "src").select("src", F.floor(F.col("n") / hub).alias("part"))
    many = flags.join(hubs, "dst", "left_semi").join(at, "src")
    return stored(flags.join(hubs, "dst", "left_anti").withColumn("part", F.lit(None).cast("long")).unionByName(many)), True


#: Neighbours up to which vertices with the same ones are searched as one.
LEAF = 64


def _twinned(edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(v, name): vertices with few neighbours, by the smallest one that has the same ones by the same codes; the edges between names, and those from all vertices to names.

    A root set that has none of a name's vertices reaches them all at once.  If it has one, their neighbours are reached
    at depth 1, so that no other way through the name counts.
    """
    ways = stored(edges.where("src is not null and dst is not null").select("src", "dst", "rels").distinct())
    few = ways.groupBy("src").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= LEAF).select("src")
    lists = ways.join(few, "src", "left_semi").groupBy("src").agg(F.to_json(F.array_sort(F.collect_list(F.struct("dst", "rels")))).alias("near"))
    lists = stored(lists)
    twins = stored(lists.join(lists.groupBy("near").agg(F.min("src").alias("name")), "near").select(F.col("src").alias("v"), "name"))
    to = twins.select(F.col("v").alias("dst"), "name")
    first = stored(ways.join(to, "dst", "left").select("src", F.coalesce("name", "dst").alias("dst"), "rels").distinct())
    return twins, first.join(twins.where("v <> name").select(F.col("v").alias("src")), "src", "left_anti"), first


def even_width(count: int, most: int = WIDTH) -> int:
    """Bits of a mask, a multiple of 8, so that chunks of at most `most` root sets are equally full."""
    chunks = max(1, math.ceil(count / most))
    return max(8, 8 * math.ceil(count / chunks / 8))


def forest(edges: DataFrame, roots: DataFrame, max_depth: int, numbers: DataFrame | None = None, width: int = WIDTH, tree: bool = False, hub: int = HUB, twins: bool = False, alike: bool = False) -> Forest:
    """Breadth-first search from all root sets at once, in masks of at most `width` of them; edges: (src, dst, rels) both ways, roots: (root_set, v).

    At each level a vertex takes, from its neighbours in ascending order, the bits that it has neither seen nor
    taken, which gives every root set the smallest parent; what is carried along the edge comes with them.  Neighbours of a
    vertex with more than `hub` are folded by parts of that many, and the parts in order.  numbers: (root_set, n), where the caller has numbered them.
    twins: vertices with the same neighbours are searched as one, under the smallest, which is also the parent that a tree takes of them.
    alike: with twins, root sets of the same names are numbered one after the other, in any order else.
    """
    spark = edges.sparkSession
    ship(spark)
    numbers = numbered(roots, "root_set") if numbers is None else numbers
    width = even_width(numbers._count if hasattr(numbers, "_count") else numbers.count(), width)
    twin, edges, first = _twinned(edges) if twins else (None, edges, None)
    if alike and twins:
        named = roots.join(twin, "v", "left").groupBy("root_set").agg(F.xxhash64(F.array_sort(F.collect_list(F.coalesce("name", "v")))).alias("_names"))
        again = numbered(numbers.select("root_set").join(named, "root_set", "left").select(F.struct("_names", "root_set").alias("set")), "set")
        count = again._count
        numbers = stored(again.select("set.root_set", "n"))
        numbers._count = count
    ways = [_cut_flags(edges, hub)]
    ways = [_cut_flags(first, hub) if twins else ways[0], *ways]
    v_type = roots.schema["v"].dataType.simpleString()
    more = list(_TREE) if tree else []

    def single(batches):
        for batch in batches:
            bit = np.asarray(batch.column("bit"), np.int64)
            mask = np.zeros((len(bit), width // 8), np.uint8)
            mask[np.arange(len(bit)), bit // 8] = np.uint8(1) << (bit % 8).astype(np.uint8)
            none = np.zeros((len(bit), width), np.int16)
            values = {"mask": mask, "all_sy": mask, "only_sy": mask, "true": none, "steps": none, "cost": np.zeros((len(bit), width), np.float32)}
            names = ["mask", "all_sy", *more]
            yield pa.RecordBatch.from_arrays([batch.column("v"), batch.column("chunk"), *(_binary(values[c]) for c in names)], ["v", "chunk", *names])

    placed = roots.where("v is not null").select("root_set", "v").distinct().join(numbers, "root_set").select("v", F.floor(F.col("n") / width).alias("chunk"), (F.col("n") % width).alias("bit"))
    begun = placed.mapInArrow(single, ", ".join([f"v {v_type}, chunk long, mask binary, all_sy binary", *(f"{c} binary" for c in more)]))
    names = ["v", "chunk", "src", "mask", "all_sy", *more, "raw", "e_sy", "e_any", "e_step", "e_cost"]
    plain = {"raw": F.lit(False), "e_sy": F.lit(True), "e_any": F.lit(True), "e_step": F.lit(False), "e_cost": F.lit(0.0)}
    rows = begun.withColumns({"src": F.col("v"), **plain}).select(names)
    kept, levels = [], []
    for depth in range(max_depth + 1):
        if depth:
            flags, hubs = ways[depth > 1]
            cand = before.where("fresh").select(F.col("v").alias("src"), "chunk", "mask", "all_sy", *more).join(flags, "src").withColumnRenamed("dst", "v")
            rows = cand.where("part is null").select(names) if hubs else cand.select(names)
            if hubs:
                some = _fold(cand.where("part is not null").select("part", *names), tree, ["v", "chunk", "part"]).where("fresh")
                rows = rows.unionByName(some.withColumn("src", F.col("pred")).withColumns(plain).select(names))
            seen = before.where("not fresh").select("v", "chunk", F.lit(None).cast(v_type).alias("src"), "mask", F.col("mask").alias("all_sy"))
            if twins and depth == 1:  # a root isn't what its name stands for
                seen = seen.join(twin, "v", "left_anti")
            zero = {"only_sy": F.col("mask"), **{c: F.lit(bytes(width * size)) for c, size in (("true", 2), ("steps", 2), ("cost", 4))}}
            rows = rows.unionByName(seen.withColumns({c: zero[c] for c in more} | plain).select(names))
        before = stored(_fold(rows, tree, ["v", "chunk"]))
        kept.append(before)
        fresh = before.where("fresh")
        if depth and fresh.isEmpty():
            break
        pred = F.col("pred") if depth else F.lit(None).cast(v_type)
        levels.append(fresh.select("v", "chunk", F.lit(depth).alias("depth"), "mask", "all_sy", *([pred.alias("pred"), *more] if tree else [])))
    out = stored(reduce(DataFrame.unionByName, levels))
    drop(*kept)
    return Forest(out, numbers, width, tree, twin)


def unmasked(found: Forest) -> DataFrame:
    """The forest's rows, one for each root set and vertex, those with the same neighbours from the row of their name: (root_set, v, depth, all_sy), and with the tree pred, only_sy, steps, cost."""
    tree, width = found.tree, found.width
    v_type = found.levels.schema["v"].dataType.simpleString()
    schema = f"n long, v {v_type}, depth int, all_sy boolean" + (f", pred {v_type}, only_sy boolean, steps double, cost double" if tree else "")

    def run(batches):
        for batch in batches:
            masks = np.unpackbits(_bits(batch.column("mask")), axis=1, bitorder="little") if batch.num_rows else np.zeros((0, width), np.uint8)
            row, bit = np.nonzero(masks)
            pick = pa.array(row)
            flag = lambda c: pa.array(np.unpackbits(_bits(batch.column(c)), axis=1, bitorder="little")[row, bit].astype(bool))
            depth = np.asarray(batch.column("depth"))[row]
            out = [pa.array(np.asarray(batch.column("chunk"), np.int64)[row] * width + bit), batch.column("v").take(pick), pa.array(depth), flag("all_sy") if len(row) else pa.array([], pa.bool_())]
            names = ["n", "v", "depth", "all_sy"]
            if tree:
                steps = _bits(batch.column("steps")).view(np.int16)[row, bit].astype(np.float64) if len(row) else np.zeros(0)
                out += [batch.column("pred").take(pick), flag("only_sy") if len(row) else pa.array([], pa.bool_()), pa.array(np.where(depth == 0, 0.5, steps)), pa.array(_bits(batch.column("cost")).view(np.float32)[row, bit].astype(np.float64) if len(row) else np.zeros(0))]
                names += ["pred", "only_sy", "steps", "cost"]
            yield pa.RecordBatch.from_arrays(out, names)

    ship(found.levels.sparkSession)
    rows = found.levels.mapInArrow(run, schema).join(found.numbers, "n").drop("n")
    if found.twins is None:
        return rows
    names = rows.columns
    roots = rows.where("depth = 0")
    members = found.twins.select(F.col("v").alias("_member"), F.col("name").alias("v"))
    reached = rows.where("depth > 0").join(members, "v", "left").withColumn("v", F.coalesce("_member", "v"))
    return roots.unionByName(reached.select(names).join(roots.select("root_set", "v"), ["root_set", "v"], "left_anti").select(names))


def bfs(edges: DataFrame, roots: DataFrame, max_depth: int, measures: bool = True) -> DataFrame:
    """(root_set, v, depth, pred, all_sy, only_sy, steps, cost): breadth-first trees of all root sets, roots included.

    edges: (src, dst, rels) both ways; roots: (root_set, v).  The parent is the
    smallest neighbour of the level before.  Carried along the tree: all_sy, every
    edge holds SY; only_sy, every edge holds one of RL, RQ, SY; steps, edges with a
    code besides RQ and SY, where a first edge of those alone counts 1; cost, the cheapest such code of each edge
    (CHD 0.5, others 1).  Without measures, (root_set, v, depth, all_sy).
    """
    names = ["root_set", "v", "depth", *(["pred", "all_sy", "only_sy", "steps", "cost"] if measures else ["all_sy"])]
    return unmasked(forest(edges, roots, max_depth, width=64 if measures else WIDTH, tree=measures, twins=True)).select(names)


def distances(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root, v, depth): bfs() without the tree, from single roots (root)."""
    sets = roots.select(F.col("root").alias("root_set"), F.col("root").alias("v"))
    return bfs(edges.select("src", "dst", F.array().cast("array<string>").alias("rels")), sets, max_depth, measures=False).select(F.col("root_set").alias("root"), "v", "depth")


#: Bytes of depths that a task puts together at once, and the depth of what is not found.
DEPTHS, FAR = 64 << 20, 255


@dataclass(frozen=True)
class Web:
    """Depths of places from roots, both by what they stand for: vertices with the same neighbours are one.

    roots: (v, n), places: (v, z): numbers of what they stand for, `roots_n` and `places_n` different ones; vertices without edges have none.
    near: (n, depths): byte z is the depth, at most `deepest`, or FAR.  Where a root and a place stand for the same it holds for different vertices; a root's own depth is 0.
    """

    roots: DataFrame
    places: DataFrame
    near: DataFrame
    roots_n: int
    places_n: int
    deepest: int


def web(edges: DataFrame, roots: DataFrame, places: DataFrame, max_depth: int) -> Web:
    """distances() from roots (v) to places (v), a byte each, of vertices that have the same neighbours once."""
    twin, between, _ = _twinned(edges.select("src", "dst", F.array().cast("array<string>").alias("rels")))
    between = stored(between)
    ends = stored(between.select(F.col("src").alias("name")).union(between.select("dst")).distinct())
    named = lambda d: stored(d.select("v").distinct().join(twin, "v", "left").select("v", F.coalesce("name", "v").alias("name")).join(ends, "name", "left_semi"))
    roots, places = named(roots), named(places)
    root_n, place_n = numbered(roots, "name"), numbered(places, "name")
    size = max(1, place_n._count)
    width = max(8, min(WIDTH, DEPTHS // size // 8 * 8))
    numbers = root_n.withColumnRenamed("name", "root_set")
    numbers._count = root_n._count
    found = forest(between, root_n.select(F.col("name").alias("root_set"), F.col("name").alias("v")), max_depth, numbers, width)
    loops = between.where("src = dst").select(F.col("src").alias("v"), F.lit(1).alias("_loop"))  # twins that are neighbours
    twice = F.coalesce("_loop", F.lit(2))
    depth = F.when(F.col("depth") > 0, F.col("depth")).otherwise(F.when(twice <= max_depth, twice).otherwise(FAR))
    place_n = place_n.select(F.col("name"), F.col("n").alias("z"))
    rows = found.levels.join(place_n.withColumnRenamed("name", "v"), "v").join(loops, "v", "left").select("chunk", "z", depth.alias("depth"), "mask")
    width, count = found.width, root_n._count

    def put(table):
        out = np.full((width, size), FAR, np.uint8)
        for batch in table.to_batches(max_chunksize=4096):
            row, bit = np.nonzero(np.unpackbits(_bits(batch.column("mask")), axis=1, bitorder="little"))
            out[bit, np.asarray(batch.column("z"))[row]] = np.asarray(batch.column("depth"))[row]
        first = table["chunk"][0].as_py() * width
        some = min(width, count - first)
        return pa.table({"n": pa.array(np.arange(first, first + some)), "depths": _binary(out[:some])})

    ship(edges.sparkSession)
    near = stored(rows.groupBy("chunk").applyInArrow(put, "n long, depths binary"))
    deepest = found.levels.agg(F.max("depth")).first()[0] or 0
    return Web(roots.join(root_n, "name").select("v", "n"), places.join(place_n, "name").select("v", "z"), near, count, size, max(deepest, min(2, max_depth)))


def web_of(found: DataFrame) -> Web:
    """The same of (root, v, depth)."""
    found = stored(found.where(f"depth < {FAR}"))
    root_n, place_n = numbered(found, "root"), numbered(found, "v")
    size = max(1, place_n._count)

    def put(table):
        out = np.full((1, size), FAR, np.uint8)
        out[0, np.asarray(table["z"])] = np.asarray(table["depth"])
        return pa.table({"n": table["n"].slice(0, 1), "depths": _binary(out)})

    rows = found.join(root_n, "root").join(place_n.withColumnRenamed("n", "z"), "v").select("n", "z", "depth")
    ship(found.sparkSession)
    near = stored(rows.groupBy("n").applyInArrow(put, "n long, depths binary"))
    return Web(root_n.withColumnRenamed("root", "v"), place_n.withColumnRenamed("n", "z"), near, root_n._count, size, found.agg(F.max("depth")).first()[0] or 0)


def depth_sets(found: DataFrame) -> DataFrame:
    """(root_set, depth, n, concepts) for depth 1 and more."""
    return found.where("depth > 0").groupBy("root_set", "depth").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("v")).alias("concepts"))


def reachable(found: DataFrame) -> DataFrame:
    return found.select("root_set", "v").distinct()


def synonyms(found: DataFrame) -> DataFrame:
    """(root_set, concept): concepts outside a root set whose chain to it consists of edges with SY."""
    return found.where("depth > 0 and all_sy").select("root_set", F.col("v").alias("concept"))


def chain_measures(found: DataFrame, refs: DataFrame, known: DataFrame, unreachable: float = 5.0) -> DataFrame:
    """(root_set, ref_id, not_synonym, steps, cost): sums over each reference's concepts, against each root set.

    refs: (ref_id, concept); known: (concept) of the graph.  A concept that the search
    did not reach counts 0, 0.5 and `unreachable`; one outside the graph 1, 1 and
    `unreachable`.  Pairs without any reached concept are left out.
    """
    flag = known.select("concept").distinct().withColumn("_k", F.lit(1))
    sizes = refs.join(flag, "concept", "left").groupBy("ref_id").agg(F.count(F.lit(1)).alias("size"), F.count("_k").alias("inside"))
    hit = refs.join(found.withColumnRenamed("v", "concept"), "concept")
    sums = hit.groupBy("root_set", "ref_id").agg(F.count(F.lit(1)).alias("n"), F.sum((~F.col("only_sy")).cast("int")).alias("ns"), F.sum("steps").alias("st"), F.sum("cost").alias("co"))
    lost, outside = F.col("inside") - F.col("n"), F.col("size") - F.col("inside")
    return sums.join(sizes, "ref_id").select("root_set", "ref_id", (F.col("ns") + outside).cast("long").alias("not_synonym"), (F.col("st") + 0.5 * lost + outside).alias("steps"), (F.col("co") + unreachable * (lost + outside)).alias("cost"))


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (a, b, ..) with both ends in nodes (concept)."""
    at = lambda c: nodes.select(F.col("concept").alias(c)).distinct()
    return edges.join(at("a"), "a", "left_semi").join(at("b"), "b", "left_semi")


def without(edges: DataFrame, drop: DataFrame) -> DataFrame:
    """Edges (a, b, ..) with neither end in drop (concept)."""
    at = lambda c: drop.select(F.col("concept").alias(c)).distinct()
    return edges.join(at("a"), "a", "left_anti").join(at("b"), "b", "left_anti")


def trimmed(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root_set, a, b): edges with an end that the search reaches."""
    found = reachable(bfs(both_ways(edges), roots, max_depth))
    one = found.join(edges.select("a", "b"), found["v"] == edges["a"]).select("root_set", "a", "b")
    return one.unionByName(found.join(edges.select("a", "b"), found["v"] == edges["b"]).select("root_set", "a", "b")).distinct()


def level_dag(edges: DataFrame, roots: DataFrame, max_depth: int) -> DataFrame:
    """(root_set, src, dst): edges that lead to a deeper level of the search."""
    two = both_ways(edges)
    found = bfs(two, roots, max_depth)
    at = lambda c, d: found.select("root_set", F.col("v").alias(c), F.col("depth").alias(d))
    return at("src", "d1").join(two.select("src", "dst"), "src").join(at("dst", "d2"), ["root_set", "dst"]).where("d2 > d1").select("root_set", "src", "dst")
