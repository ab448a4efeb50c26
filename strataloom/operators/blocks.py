"""Exact top-k search of concept sets on a grid, without a row for each pair.

Targets are numbered and cut into blocks of bounded size; a block is one row, which holds
concept -> target lists, and masks with a bit a target for what a graph search found.  References are dealt to
pieces.  One shuffle brings each block to each piece, whatever the number of targets; the cell's task
goes through its references a few hundred at a time, sums what they share with
the targets of the block, and keeps the k best of each target; only those are shuffled again.
A cell has as many blocks as CELL_BYTES hold, so that references are shuffled once for all of them; where there are more, and pairs
that share an entry come first, these are searched by groups of neighbouring blocks, each of which gets only the references that share something with it.
Where a cost has a bound for pairs without a common concept, only pairs with one are compared at first, and all
pairs of a target only if its k-th best reaches the bound; these in the order of what a pair that shares nothing
gets at least, until no later one can be among the k best.  Where masks decide such pairs, references that masks don't tell
apart are one: the k first of each are compared, those that masks favour first, until no later one can be among the k best.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ontology
from .graph import DEPTHS, FAR, Web, even_width
from .vectors import top
from .workers import numbered, ship
from .workers import stored as cut

#: Entries and targets of a block, and references of a piece: the bounds of what a task holds.
BLOCK_ENTRIES, BLOCK_TARGETS, PIECE = 4_000_000, 1024, 200_000
#: References that are compared at once, and cells for each shuffle partition; references with which those that share nothing begin.
STEP, CELLS, FEW = 256, 4, 16
#: Targets of a block and references of a step where only pairs that share an entry are compared, and bytes of the blocks of a cell.
WIDE, SPARSE, CELL_BYTES = 16_384, 8_192, 32 << 20
#: Bytes of the blocks of a group to which references are sent by what they share, so many groups are put together where references are in more than SPREAD of them.
GROUP_BYTES, TOGETHER, SPREAD = 8 << 20, 4, 3
#: References that are compared at once where all concepts are matched by their ancestors, and entries that pairs share at once.
MATCHED, SHARED = 32, 1 << 20

#: Pairs of concepts whose depths are looked up at once, and entries of cells whose masks are.
NEAR = 1 << 20
#: Targets of a block for which the references are put in order together, and buckets of references that masks don't tell apart.
ORDERED, BUCKETS = 256, 65_536
#: What the values of a formula may differ by through the order of a sum.
SLACK = 2e-6
#: Numbers of a mask's bits that are kept unpacked.
TABLE = 4 << 20
#: Columns of the references that are lists.
_LISTS = ("pos", "neg", "kin", "c_z", "c_ic", "near_z", "near_w", "neg:near_z", "neg:near_w")

Formula = Callable[[dict, dict, dict], tuple[np.ndarray, dict[str, np.ndarray]]]


@dataclass(frozen=True)
class Search:
    """What is compared.

    kinds: name -> (side, entries), entries (target_id, concept, w): per kind, the weights and the number of a target's
    entries among a reference's concepts on that side ('pos' or 'neg') are summed.
    masks: name -> (side, entries), entries (concept, block, mask, w): the same for all targets of a block whose bit is set; where
    w is null, only whether there is one.  Entries may have the number c in place of the concept.  Side 'kin' are numbers of what the concepts stand for, whose bits
    don't hold for a target's own concepts; kinds then has 'self', on side 'pos', with the number of each own concept as its weight.  They need numbers, (target_id, n), and width: target n is bit n % width of block n // width.
    near: 'near' on side 'pos', 'neg:near' on side 'neg' -> (side, entries, web), entries (target_id, concept, v); refs then have name + '_z' and '_w', the web's numbers (-1 for none) and the weights of their concepts on that side.  'f0', 'f1', .. are
    the weights of a reference's concepts by their least depth from any of the target's, 'r0', 'r1', .. the v of the target's concepts by their least depth to any of the reference's; 'n_near' says whether any is found; likewise 'neg:f0' and so on.
    contents: (target_id, own, z, ic): the ancestors of each own concept, as arrays of numbers and of their information contents, the largest first; refs then have
    c_z and c_ic, such arrays for each of their concepts.  'bma' is half the mean, over a target's concepts, of the largest content of an
    ancestor in common with any of the reference's (0 where there is none), plus half the same the other way.
    targets: (target_id, numbers ..); refs: (ref_id, pos, neg: arrays of concepts' numbers, numbers ..); concepts: (concept, n) of the references.
    """

    kinds: dict[str, tuple[str, DataFrame]]
    targets: DataFrame
    refs: DataFrame
    concepts: DataFrame
    contents: DataFrame | None = None
    near: dict[str, tuple[str, DataFrame, Web]] = field(default_factory=dict)
    masks: dict[str, tuple[str, DataFrame]] = field(default_factory=dict)
    numbers: DataFrame | None = None
    width: int | None = None


class _Lists:
    """Concepts' lists of (place, weight)."""

    def __init__(self, concept: np.ndarray, place: np.ndarray, w: np.ndarray):
        order = np.argsort(concept, kind="stable")
        self.names, first = np.unique(concept[order], return_index=True)
        self.edge = np.r_[first, len(concept)]
        self.place, self.w = place[order], w[order]

    def count(self, concept: np.ndarray) -> int:
        """The number of entries of the concepts."""
        if not len(self.names) or not len(concept):
            return 0
        at = np.minimum(np.searchsorted(self.names, concept), len(self.names) - 1)
        at = at[self.names[at] == concept]
        return int((self.edge[at + 1] - self.edge[at]).sum())

    def hits(self, row: np.ndarray, concept: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Cells row * width + place, and weights, of all entries of the rows' concepts."""
        if not len(self.names) or not len(concept):
            return np.zeros(0, np.int64), np.zeros(0)
        at = np.minimum(np.searchsorted(self.names, concept), len(self.names) - 1)
        same = self.names[at] == concept
        at, row = at[same], row[same]
        n = self.edge[at + 1] - self.edge[at]
        pick = np.repeat(self.edge[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.repeat(row * width, n) + self.place[pick], self.w[pick]


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from 0, and no -0.0."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x) + 0.0


class _Masks:
    """Concepts' masks; a concept may have several, each with a weight (None: only whether a bit is set)."""

    def __init__(self, concept: np.ndarray, mask: np.ndarray, w: np.ndarray | None):
        order = np.argsort(concept, kind="stable")
        self.concept, self.mask, self.w = concept[order], mask[order], None if w is None else w[order]

    def __getstate__(self):
        return {c: x for c, x in self.__dict__.items() if c != "_tables"}

    def tables(self, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(concepts, counts, weights) of each bit, kept while the block is; None if there are too many."""
        if not hasattr(self, "_tables"):
            names, first = np.unique(self.concept, return_index=True)
            self._tables = None
            if 0 < len(names) * width <= TABLE:
                bits = np.unpackbits(self.mask, axis=1, count=width, bitorder="little")
                counts = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
                self._tables = names, counts.astype(np.float64), counts if self.w is None else np.add.reduceat(bits * self.w[:, None], first, axis=0)
        return self._tables

    def most(self, concept: np.ndarray, width: int, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest weight that each concept can have for any of the bits, and whether it has one."""
        if not len(self.concept):
            return np.zeros(len(concept)), np.zeros(len(concept), bool)
        if (tables := self.tables(width)) is not None:
            names, counts, sums = tables
            weight, some = sums[:, places].max(1), counts[:, places].max(1) > 0
        else:
            names, first = np.unique(self.concept, return_index=True)
            weight, some = np.add.reduceat(np.ones(len(self.concept)) if self.w is None else np.maximum(self.w, 0), first), np.ones(len(names), bool)
        at = np.minimum(np.searchsorted(names, concept), len(names) - 1)
        known = names[at] == concept
        return np.where(known, weight[at], 0.0), known & some[at]

    def reach(self, width: int) -> np.ndarray:
        """The number of rows in which each bit is set."""
        out = np.zeros(width, np.int64)
        for start in range(0, len(self.mask), 4096):
            out += np.unpackbits(self.mask[start : start + 4096], axis=1, count=width, bitorder="little").sum(0, dtype=np.int64)
        return out

    def sums(self, row: np.ndarray, concept: np.ndarray, rows: int, width: int, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(weights, number) of the rows' concepts for each bit, or for the bits `places`; rows ascend."""
        if (tables := self.tables(width)) is None and places is not None:
            return tuple(x[:, places] for x in self.sums(row, concept, rows, width))
        some, weights = (np.zeros((rows, width if places is None else len(places))) for _ in range(2))
        if tables is not None:
            names, counts, sums = tables
            if places is not None and len(places) < width:
                counts, sums = counts[:, places], sums[:, places]
            at = np.minimum(np.searchsorted(names, concept), len(names) - 1)
            known = names[at] == concept
            at, row = at[known], row[known]
            if len(row):
                start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
                some[row[start]] = np.add.reduceat(counts[at], start)
                if self.w is not None:
                    weights[row[start]] = np.add.reduceat(sums[at], start)
            return weights, some
        first, last = np.searchsorted(self.concept, concept, "left"), np.searchsorted(self.concept, concept, "right")
        n = last - first
        pick = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        row = np.repeat(row, n)
        if len(row):
            start = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
            bits = np.unpackbits(self.mask[pick], axis=1, count=width, bitorder="little")
            some[row[start]] = np.add.reduceat(bits, start, dtype=np.int64)
            if self.w is not None:
                weights[row[start]] = np.add.reduceat(bits * self.w[pick][:, None], start)
        return weights, some

    def of(self, concept: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(weights, number) of single concepts for single bits."""
        return self.at(np.arange(len(concept)), concept, np.arange(len(concept)), place)

    def at(self, row: np.ndarray, concept: np.ndarray, cell_row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """sums() of some cells."""
        known = np.isin(concept, self.concept)
        row, concept = row[known], concept[known]
        lo, hi = np.searchsorted(row, cell_row, "left"), np.searchsorted(row, cell_row, "right")
        n, weights, some, start = hi - lo, np.zeros(len(cell_row)), np.zeros(len(cell_row)), 0
        ends = np.cumsum(n)
        while start < len(cell_row):  # a bounded number of entries at once
            stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + NEAR // 4, "right")))
            weights[start:stop], some[start:stop] = self._at(concept, lo[start:stop], n[start:stop], place[start:stop])
            start = stop
        return weights, some

    def _at(self, concept: np.ndarray, lo: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """at() of cells with n concepts from lo on, which all have masks."""
        cell_row = lo
        cell = np.repeat(np.arange(len(cell_row)), n)
        entry = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        first, last = np.searchsorted(self.concept, concept[entry], "left"), np.searchsorted(self.concept, concept[entry], "right")
        m = last - first
        pick = np.repeat(first - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))
        cell = np.repeat(cell, m)
        bit = (self.mask[pick, place[cell] // 8] >> (place[cell] % 8).astype(np.uint8)) & 1
        weights = np.bincount(cell, weights=bit * (0.0 if self.w is None else self.w[pick]), minlength=len(cell_row))
        return weights, np.bincount(cell, weights=bit, minlength=len(cell_row))


class _Contents:
    """The ancestors of targets' concepts, and best matches of them."""

    def __init__(self, place: np.ndarray, own: np.ndarray, z: pa.Array, contents: pa.Array):
        order = np.argsort(place, kind="stable")
        own, first, self.row = np.unique(own[order], return_index=True, return_inverse=True)
        z, contents = z.take(pa.array(order[first])), contents.take(pa.array(order[first]))
        self.start = np.flatnonzero(np.r_[True, place[order][1:] != place[order][:-1]])
        self.place, self.n = place[order][self.start], len(own)
        self.size = np.diff(np.r_[self.start, len(order)])
        self.up = (*ontology.nested(z)[:2], np.asarray(z.flatten(), np.int64), np.asarray(contents.flatten(), np.float64))
        self.lists = _Lists(np.asarray(z.flatten(), np.int64), np.repeat(np.arange(self.n), np.asarray(pc.list_value_length(z), np.int64)), np.zeros(len(z.flatten())))

    def _matches(self, c_z: pa.Array, c_ic: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The largest common content of each own concept and each of the references' concepts; the references' first columns and numbers of columns."""
        count = np.asarray(pc.list_value_length(c_z).fill_null(0), np.int64)
        inner, content = c_z.flatten(), np.asarray(c_ic.flatten().flatten(), np.float64)
        column = np.repeat(np.arange(len(inner)), np.asarray(pc.list_value_length(inner), np.int64))
        order = np.argsort(content, kind="stable")  # so that the largest is written last
        entry, _ = self.lists.hits(order, np.asarray(inner.flatten(), np.int64)[order], self.n)
        which, own = entry // self.n, entry % self.n
        match = np.full((self.n, len(inner)), -np.inf)
        match[own, column[which]] = content[which]
        match[match == -np.inf] = 0.0
        return match, np.cumsum(count) - count, count

    def best_match(self, c_z: pa.Array, c_ic: pa.Array, width: int) -> np.ndarray:
        """(references, targets): the mean of both directions; 0 where a side has no concept."""
        out = np.zeros((len(c_z), width))
        match, first, count = self._matches(c_z, c_ic)
        refs = np.flatnonzero(count)
        if not len(refs):
            return out
        first, count = first[refs], count[refs]
        forward = np.add.reduceat(np.maximum.reduceat(match, first, axis=1)[self.row], self.start, axis=0) / self.size[:, None]
        backward = np.add.reduceat(np.maximum.reduceat(match[self.row], self.start, axis=0), first, axis=1) / count
        out[refs[:, None], self.place[None, :]] = ((forward + backward) / 2).T
        return out

    def best_match_at(self, c_z: pa.Array, c_ic: pa.Array, row: np.ndarray, place: np.ndarray) -> np.ndarray:
        """best_match() of some cells, for which only their own concepts are matched."""
        first, count, inner = ontology.nested(c_z)
        known = ontology.listed_numbers(*ontology.nested(inner)[:2], np.asarray(inner.flatten(), np.int64))
        at = np.minimum(np.searchsorted(self.place, place), len(self.place) - 1)
        some = np.flatnonzero((self.place[at] == place) & (count[row] > 0))
        out = np.zeros(len(row))
        at, row = at[some], row[some]
        out[some] = ontology.means_of_best(self.start[at], self.size[at], first[row], count[row], lambda a, b: ontology.common_content(self.row[a], b, self.up, known))
        return out


class _Near:
    """Targets' concepts, and the depths of others from them."""

    def __init__(self, place: np.ndarray, c: np.ndarray, v: np.ndarray, n: np.ndarray, ids: np.ndarray, depths: np.ndarray, deepest: int, width: int):
        order, rank = np.argsort(place, kind="stable"), np.argsort(ids)
        self.c, self.v, self.deepest = c[order], v[order], deepest
        self.count = np.bincount(place, minlength=width)
        self.first = np.cumsum(self.count) - self.count
        known = np.r_[ids[rank], np.iinfo(np.int64).max]
        row = np.searchsorted(known, n[order])
        self.row = np.where(known[row] == n[order], row, len(ids))
        self.depths = np.full((len(ids) + 1, depths.shape[1] + 1), FAR, np.uint8)  # the last ones are of what has no edges
        self.depths[:-1, :-1] = depths[rank]

    def sums(self, name: str, side: str, batch, row: np.ndarray, place: np.ndarray) -> dict[str, np.ndarray]:
        """f0, f1, .., r0, r1, .. and n_near of cells."""
        count = np.asarray(pc.list_value_length(batch.column(side)).fill_null(0), np.int64)
        c, z, w = (np.asarray(batch.column(x).flatten()) for x in (side, f"{name}_z", f"{name}_w"))
        first, levels, stride = np.cumsum(count) - count, self.deepest + 2, self.depths.shape[1]
        z = np.where(z < 0, stride - 1, z)
        forward, reverse = np.zeros((levels, len(row))), np.zeros((levels, len(row)))
        some = np.zeros(len(row), bool)
        a, b = self.count[place], count[row]
        order = np.lexsort((b, a))
        a, b = a[order], b[order]
        edge = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]), True]) if len(order) else np.zeros(1, np.int64)
        for lo, hi in zip(edge[:-1], edge[1:]):  # cells of the same numbers of concepts
            own_n, ref_n = int(a[lo]), int(b[lo])
            step = max(1, NEAR // max(1, own_n * ref_n))
            for at in range(lo, hi if own_n and ref_n else lo, step):
                cell = order[at : min(at + step, hi)]
                own, ref = self.first[place[cell]] + np.arange(own_n)[:, None], first[row[cell]] + np.arange(ref_n)[:, None]
                d = self.depths.reshape(-1).take((self.row[own] * stride)[:, None] + z[ref][None])
                d[self.c[own][:, None] == c[ref][None]] = 0
                for out, least, value in ((forward, d.min(0), w[ref]), (reverse, d.min(1), self.v[own])):
                    least = np.minimum(least, levels - 1)
                    out[:, cell] = np.bincount((least * np.int64(len(cell)) + np.arange(len(cell))).reshape(-1), weights=value.reshape(-1), minlength=levels * len(cell)).reshape(levels, -1)
                some[cell] = (d < FAR).any((0, 1))
        return {f"n_{name}": some} | {f"{name[:-4]}{kind}{d}": x[d] for kind, x in (("f", forward), ("r", reverse)) for d in range(levels - 1)}

    def nothing(self, name: str, shape: tuple[int, ...]) -> dict[str, np.ndarray]:
        """sums() of cells that have nothing in common, but reach each other."""
        return {f"n_{name}": np.ones(shape, bool)} | {f"{name[:-4]}{kind}{d}": np.zeros(shape) for kind in "fr" for d in range(self.deepest + 1)}


def _packed(what: Search, numbers: DataFrame, width: int) -> DataFrame:
    """(block, payload): each block as one row."""
    concepts = what.concepts.select("concept", F.col("n").alias("c"))
    block, place = F.floor(F.col("n") / width).alias("block"), (F.col("n") % width).cast("int").alias("place")
    empty = {"place": "int", "c": "long", "w": "double", "own": "long", "v": "double", "mask": "binary", "t": "array<double>", "z": "array<long>"}
    columns = [c for c in what.targets.columns if c != "target_id"]
    names, rows = ["t"], [what.targets.join(numbers, "target_id").select(block, place, F.array(*(F.col(f"`{c}`").cast("double") for c in columns)).alias("t"))]
    for name, (_, d) in what.kinds.items():
        names.append(name)
        rows.append(d.join(numbers, "target_id").join(concepts, "concept").select(block, place, "c", F.col("w").cast("double").alias("w")))
    for name, (_, entries, web) in what.near.items():
        own = entries.join(numbers, "target_id").join(concepts, "concept", "left").join(web.roots.select(F.col("v").alias("concept"), F.col("n").alias("own")), "concept", "left")
        own = cut(own.select(block, place, F.coalesce("c", F.lit(-1)).alias("c"), F.coalesce("own", F.lit(-1)).alias("own"), F.col("v").cast("double").alias("v")))
        names += [name, f"{name}:depths"]
        rows += [own, own.select("block", "own").distinct().join(web.near.select(F.col("n").alias("own"), F.col("depths").alias("mask")), "own")]
    for name, (_, d) in what.masks.items():
        names.append(name)
        d = d if "c" in d.columns else d.join(concepts, "concept")
        rows.append(d.select("block", "c", "mask", F.col("w").cast("double").alias("w")))
    if what.contents is not None:
        names.append("contents")
        rows.append(what.contents.join(numbers, "target_id").select(block, place, F.xxhash64("own").alias("own"), "z", F.col("ic").alias("t")))
    whole = [d.select(F.col("block").cast("long"), F.lit(i).alias("part"), *(F.col(c) if c in d.columns else F.lit(None).cast(kind).alias(c) for c, kind in empty.items())) for i, d in enumerate(rows)]
    sides = {name: side for kind in (what.kinds, what.masks) for name, (side, _) in kind.items()}
    lists, webs = set(what.kinds), {name: (side, web.places_n, web.deepest) for name, (side, _, web) in what.near.items()}

    def pack(table):
        table = table.combine_chunks()
        part = np.asarray(table["part"])
        out = {"t": {c: np.zeros(width) for c in columns}, "here": np.zeros(width, bool), "kinds": {}, "near": {}, "masks": {}, "fix": {}, "contents": None}
        for i, name in enumerate(names):
            own = table.filter(pa.array(part == i)).combine_chunks()
            column = lambda c, kind: np.asarray(own[c], kind)
            if name == "t":
                at = column("place", np.int64)
                out["here"][at] = True
                values = np.asarray(own["t"].combine_chunks().flatten(), np.float64).reshape(len(at), -1)
                for k, c in enumerate(columns):
                    out["t"][c][at] = values[:, k]
            elif name == "contents":
                out["contents"] = _Contents(column("place", np.int64), column("own", np.int64), own["z"].combine_chunks(), own["t"].combine_chunks()) if own.num_rows else None
            elif name in lists:
                out["kinds"][name] = sides[name], _Lists(column("c", np.int64), column("place", np.int64), column("w", np.float64))
            elif name in webs:
                near = [column("place", np.int64), column("c", np.int64), column("v", np.float64), column("own", np.int64)]
            elif name.endswith(":depths"):
                name = name.removesuffix(":depths")
                side, size, deepest = webs[name]
                depths = np.frombuffer(b"".join(own["mask"].to_pylist()), np.uint8).reshape(-1, size)
                out["near"][name] = side, _Near(*near, column("own", np.int64), depths, deepest, width)
            else:
                mask = np.frombuffer(b"".join(own["mask"].to_pylist()), np.uint8).reshape(-1, width // 8)
                keep = mask.any(1)
                weigh = own.num_rows and own["w"].null_count == 0
                out["masks"][name] = sides[name], _Masks(column("c", np.int64)[keep], mask[keep], column("w", np.float64)[keep] if weigh else None)
        if "self" in out["kinds"]:
            out["self"] = _, own = out["kinds"].pop("self")
            concept = np.repeat(own.names, np.diff(own.edge))
            for name, (side, masks) in out["masks"].items():
                if side == "kin":
                    out["fix"][name] = tuple(_Lists(concept, own.place, x) for x in masks.of(own.w.astype(np.int64), own.place))
        return pa.table({"block": pa.array([table["block"][0].as_py()], pa.int64()), "payload": pa.array([pickle.dumps(out)], pa.binary())})

    return cut(reduce(DataFrame.unionByName, whole).groupBy("block").applyInArrow(pack, "block long, payload binary"))


def _width(what: Search, numbers: DataFrame, targets: int) -> int:
    """Targets of a block, a multiple of 8, so that blocks are equally full and none has more than BLOCK_ENTRIES."""
    width = even_width(numbers._count, targets)
    entries = [d.select("target_id") for _, d in what.kinds.values()] + [d.select("target_id") for _, d, _ in what.near.values()]
    held = BLOCK_ENTRIES
    for _, _, web in what.near.values():
        if web.roots_n * web.places_n > DEPTHS:  # a block holds the depths from its entries
            held = min(held, DEPTHS // web.places_n)
    if not entries:
        return width
    eights = reduce(DataFrame.unionByName, entries).join(numbers, "target_id").groupBy(F.floor(F.col("n") / 8).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    most = eights.agg(F.max("n")).first()[0] or 0
    return max(8, min(width, 8 * (held // most))) if most else width


def search(
    what: Search, formula: Formula, order: list[str], k: int, after: DataFrame | None = None, live: tuple[str, ...] = (), floor: Callable[[dict], np.ndarray] | None = None,
    like: Callable[[dict], np.ndarray] | None = None, alike: tuple[str, ...] | None = None, cells=None, sent: bool = True,
) -> DataFrame:
    """(target_id, ref_id, the formula's columns, rank): the k first references of each target by `order`, then ref_id.

    formula(sums, t, r): sums has, per kind, the weights and, as 'n_' + kind, the counts, all
    of (references, targets) or of some cells;
    t and r have the numbers.  It gives which pairs are compared at all, and columns of doubles.
    after: (target_id, the columns of `order`, ref_id): where a target's search goes on, behind that row; targets without a row are left out.
    live, floor: kinds, and from t the least that the first column of `order` is for pairs that have none of them (infinite where such pairs aren't compared);
    without a floor and with live ones, such pairs never are.
    like: from t, numbers; targets of the same number have the same columns with a reference with which they have nothing of a live kind, and no less
    than those of a pair with zero sums for which each mask has something.
    alike: the numbers of a target and of a reference that, with its masks' sums (all of side 'kin'), give all columns of a pair that has nothing of a live kind; the first column of
    `order` must not rise with those sums.  Not with `after`.
    cells: an accumulator that counts the pairs that the formula was applied to.
    sent: references may be sent to groups of blocks by what they share, before all of them meet the targets that need others.
    """
    spark = what.refs.sparkSession
    ship(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if after is not None:
        cursor = after.select("target_id", *(F.col(c).cast("double").alias(f"after:{c}") for c in order))
        what = replace(what, targets=what.targets.join(cursor, "target_id"))
    numbers = numbered(what.targets, "target_id") if what.numbers is None else what.numbers
    wide = bool(live) and (floor is None or bool(what.near)) and what.contents is None
    width = _width(what, numbers, WIDE if wide else BLOCK_TARGETS) if what.width is None else what.width
    id_type = what.refs.schema["ref_id"].dataType.simpleString()
    sizes = [c for c in what.refs.columns if c not in ("ref_id", *_LISTS)]
    lists = [c for c in what.refs.columns if c in _LISTS]
    refs = what.refs.select("ref_id", *lists, *(F.col(f"`{c}`").cast("double").alias(c) for c in sizes))
    if hasattr(what.refs, "_stored_at"):
        refs._stored_at = what.refs._stored_at
    else:
        refs = cut(refs)
    packed = _packed(what, numbers, width)
    if after is not None:  # a reference's id can't be among the numbers
        packed = packed.join(_cursors(after, numbers, width), "block")
    bytes_, many = packed.agg(F.sum(F.octet_length("payload"))).first()[0] or 0, refs.count()
    shape = ", ".join(["n long", f"ref_id {id_type}", *(f"{c} double" for c in order)])
    by_order = [*(F.asc(c) for c in order), F.asc("ref_id")]
    if sent and live and alike is None and after is None and bytes_ > GROUP_BYTES:
        left, right = _sent(what, refs, packed, numbers, width, live, math.ceil(bytes_ / GROUP_BYTES), many, parts)
        grid = left.groupBy("group", "piece").cogroup(right.groupBy("group", "piece"))
        got = grid.applyInArrow(_cell(formula, order, k, sizes, width, False, id_type, live, None, None, None, cells), shape)
        best = top(got, "n", by_order, k).join(numbers, "n").select("target_id", "ref_id", *order, "rank")
        if floor is None:
            return best
        best = cut(best)
        last = best.where(F.col("rank") == k).select("target_id", F.col(order[0]).alias("_last"))
        open_ = cut(_floors(what.targets, floor).join(last, "target_id", "left").where("floor < double('infinity') and (_last is null or _last >= floor)").select("target_id"))
        rest = search(replace(what, targets=what.targets.join(open_, "target_id", "left_semi"), refs=refs), formula, order, k, None, live, floor, like, cells=cells, sent=False)
        return best.join(open_, "target_id", "left_anti").unionByName(rest)
    groups = max(1, math.ceil(bytes_ / CELL_BYTES))
    pieces = max(1, math.ceil(many / PIECE), math.ceil(CELLS * parts / groups) if not live else math.ceil(parts / groups))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    by = F.xxhash64("ref_id")
    if alike is not None:  # those that masks don't tell apart meet in a piece, unless they are many
        kind = F.xxhash64("kin", *(c for c in alike if c in sizes))
        bucket = F.pmod(kind, F.lit(BUCKETS))
        large = [r[0] for r in refs.groupBy(bucket).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PIECE // 8).collect()]  # 8 a piece at most
        by = F.when(bucket.isin(large), by).otherwise(kind)
    left = refs.withColumn("piece", F.pmod(by, F.lit(pieces)).cast("int")).withColumn("group", every(groups))
    right = packed.withColumn("group", F.pmod("block", F.lit(groups)).cast("int")).withColumn("piece", every(pieces))
    dealt = lambda d: d.repartition(max(parts, min(groups * pieces, CELLS * parts)), "group", "piece").groupBy("group", "piece")  # noqa: E731  small cells are work, so they aren't put together
    grid = dealt(left).cogroup(dealt(right))
    got = grid.applyInArrow(_cell(formula, order, k, sizes, width, after is not None, id_type, live, floor, like, alike, cells), shape)
    return top(got, "n", by_order, k).join(numbers, "n").select("target_id", "ref_id", *order, "rank")


def _sent(what: Search, refs: DataFrame, packed: DataFrame, numbers: DataFrame, width: int, live: tuple[str, ...], groups: int, many: int, parts: int) -> tuple[DataFrame, DataFrame]:
    """References and blocks with the group and the piece that they belong to: neighbouring blocks are a group, which has the references that share an entry of a live kind with it."""
    last = packed.agg(F.max("block")).first()[0]
    per = math.ceil((last + 1) / groups)
    group = F.floor(F.col("n") / (width * per)).cast("int").alias("group")
    own = {}
    for side, d in (what.kinds[name] for name in live):
        own.setdefault(side, []).append(d.select("target_id", "concept"))
    concepts = what.concepts.select("concept", F.col("n").alias("c"))
    shared = []
    for side, kinds in own.items():
        there = reduce(DataFrame.unionByName, kinds).join(numbers, "target_id").select("concept", group).distinct().join(concepts, "concept").select("c", "group")
        # a stored table of entries is a small file, but not in memory
        shared.append(refs.select("ref_id", F.explode(side).alias("c")).hint("merge").join(there, "c").select("ref_id", "group"))
    to = cut(reduce(DataFrame.unionByName, shared).distinct())
    if to.count() > SPREAD * many:
        to, per = cut(to.select("ref_id", F.floor(F.col("group") / TOGETHER).cast("int").alias("group")).distinct()), per * TOGETHER
    count = (last + 1 + per - 1) // per
    pieces = to.groupBy("group").agg(F.greatest(F.ceil(F.count(F.lit(1)) / PIECE), F.lit(math.ceil(parts / count))).cast("int").alias("pieces"))
    pieces = F.broadcast(cut(pieces))  # a row a group
    left = refs.hint("merge").join(to, "ref_id").join(pieces, "group").withColumn("piece", F.pmod(F.xxhash64("ref_id"), "pieces").cast("int")).drop("pieces")
    right = packed.withColumn("group", F.floor(F.col("block") / per).cast("int")).join(pieces, "group").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1))).drop("pieces")
    n = max(parts, min(CELLS * parts, count * math.ceil(parts / count)))
    return left.repartition(n, "group", "piece"), right.repartition(n, "group", "piece")


def _floors(targets: DataFrame, floor: Callable[[dict], np.ndarray]) -> DataFrame:
    """(target_id, floor)."""
    names = [c for c in targets.columns if c != "target_id"]

    def run(batches):
        for batch in batches:
            x = np.broadcast_to(floor({c: np.asarray(batch.column(c).cast(pa.float64()), np.float64) for c in names}), (batch.num_rows,)).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column("target_id"), pa.array(x)], ["target_id", "floor"])

    return targets.mapInArrow(run, f"target_id {targets.schema['target_id'].dataType.simpleString()}, floor double")


def _cursors(after: DataFrame, numbers: DataFrame, width: int) -> DataFrame:
    """(block, places, last): the ids behind which the targets of a block go on."""
    rows = after.select("target_id", F.col("ref_id").alias("last")).join(numbers, "target_id")
    listed = F.array_sort(F.collect_list(F.struct((F.col("n") % width).cast("int").alias("place"), "last")))
    return rows.groupBy(F.floor(F.col("n") / width).cast("long").alias("block")).agg(listed.alias("cursors")).select("block", F.col("cursors.place").alias("places"), F.col("cursors.last").alias("last"))


def _cell(formula: Formula, order: list[str], k: int, sizes: list[str], width: int, resumed: bool, id_type: str, live: tuple[str, ...], floor, like, alike, cells):
    """The k best of each target of some blocks among the references of a piece."""
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "smallint": pa.int16(), "tinyint": pa.int8()}
    schema = pa.schema([("n", pa.int64()), ("ref_id", kinds.get(id_type, pa.string())), *((c, pa.float64()) for c in order)])
    plain = lambda x: x.astype(str) if x.dtype == object else x

    def entries(batch):
        flat = {}
        for side in ("pos", "neg", *(["kin"] if "kin" in batch.schema.names else [])):
            col = batch.column(side)
            offs = np.asarray(pc.list_value_length(col).fill_null(0), np.int64)
            flat[side] = np.repeat(np.arange(batch.num_rows), offs), np.asarray(col.flatten(), np.int64)
        return flat, numbers_of(batch)

    def numbers_of(batch):
        return {c: np.asarray(batch.column(c), np.float64) for c in sizes}

    def batches(table, size):
        return [whole.slice(at, size) for whole in table.combine_chunks().to_batches() for at in range(0, whole.num_rows, size)]

    def dense(batch, block, at):
        """(row, target, columns) of all cells of the targets `at` that are compared."""
        rows, (flat, r) = batch.num_rows, entries(batch)
        sums, of_place = {}, np.full(width, -1)
        of_place[at] = np.arange(len(at))
        for name, (side, lists) in block["kinds"].items():
            cell, w = lists.hits(*flat[side], width)
            to = of_place[cell % width]
            cell, w = (cell // width * len(at) + to)[to >= 0], w[to >= 0]
            sums[name] = np.bincount(cell, weights=w, minlength=rows * len(at)).astype(np.float64, copy=False).reshape(rows, -1)
            sums["n_" + name] = np.bincount(cell, minlength=rows * len(at)).reshape(rows, -1)
        for name, (side, masks) in block["masks"].items():
            both = masks.sums(*flat[side], rows, width, at)
            for x, lists in zip(both, block["fix"].get(name, ())):
                cell, w = lists.hits(*flat["pos"], width)
                to = of_place[cell % width]
                np.subtract.at(x.reshape(-1), (cell // width * len(at) + to)[to >= 0], w[to >= 0])
            sums[name], sums["n_" + name] = both
        for name, (side, near) in block["near"].items():
            both = near.sums(name, side, batch, np.repeat(np.arange(rows), len(at)), np.tile(at, rows))
            sums |= {c: x.reshape(rows, -1) for c, x in both.items()}
        if block["contents"] is not None:
            sums["bma"] = block["contents"].best_match(batch.column("c_z"), batch.column("c_ic"), width)[:, at]
        valid, columns = formula(sums, {c: x[at] for c, x in block["t"].items()}, {c: x[:, None] for c, x in r.items()})
        row, target = np.nonzero(np.broadcast_to(valid, (rows, len(at))))
        return row, at[target], {c: np.broadcast_to(columns[c], (rows, len(at)))[row, target] for c in order}, rows * len(at)

    def pieces(batch, block):
        """The batch in parts whose rows have few entries of the live kinds, or are single ones."""
        flat, _ = entries(batch)
        kinds = [block["kinds"].get(name) or block[name] for name in live]
        if batch.num_rows > 1 and sum(lists.count(flat[side][1]) for side, lists in kinds) > SHARED:
            half = batch.num_rows // 2
            yield from pieces(batch.slice(0, half), block)
            yield from pieces(batch.slice(half), block)
        else:
            yield batch

    def index(left):
        """side -> concepts of all references, ascending, and their rows."""
        out = {}
        for side in ("pos", "neg"):
            col = left[side].combine_chunks()
            concept, row = np.asarray(col.flatten(), np.int64), np.repeat(np.arange(len(col)), np.asarray(pc.list_value_length(col).fill_null(0), np.int64))
            rank = np.argsort(concept, kind="stable")
            out[side] = concept[rank], row[rank]
        return out

    def touched(left, block, index):
        """The rows that share an entry of a live kind."""
        some = np.zeros(left.num_rows, bool)
        for side, lists in (block["kinds"].get(name) or block[name] for name in live):
            concept, row = index[side]
            lo, hi = np.searchsorted(concept, lists.names, "left"), np.searchsorted(concept, lists.names, "right")
            n = hi - lo
            some[row[np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]] = True
        return np.flatnonzero(some)

    def sharing(batch, block):
        """The cells that share an entry of a live kind."""
        flat, _ = entries(batch)
        kinds = [block["kinds"].get(name) or block[name] for name in live]
        cell = np.unique(np.concatenate([lists.hits(*flat[side], width)[0] for side, lists in kinds]))
        return cell[block["here"][cell % width]]

    def sparse(batch, block, cell):
        """The same of some cells."""
        flat, r = entries(batch)
        hits = {name: lists.hits(*flat[side], width) for name, (side, lists) in block["kinds"].items()}
        row, place, n, sums = cell // width, cell % width, len(cell), {}
        if not n:
            return row, place, {c: np.zeros(0) for c in order}, 0
        for name, (at, w) in hits.items():
            to = np.minimum(np.searchsorted(cell, at), n - 1)
            same = cell[to] == at
            sums[name] = np.bincount(to[same], weights=w[same], minlength=n)
            sums["n_" + name] = np.bincount(to[same], minlength=n)
        for name, (side, masks) in block["masks"].items():
            both = masks.at(*flat[side], row, place)
            for x, lists in zip(both, block["fix"].get(name, ())):
                at, w = lists.hits(*flat["pos"], width)
                to = np.minimum(np.searchsorted(cell, at), n - 1)
                same = cell[to] == at
                np.subtract.at(x, to[same], w[same])
            sums[name], sums["n_" + name] = both
        for name, (side, near) in block["near"].items():
            sums |= near.sums(name, side, batch, row, place)
        if block["contents"] is not None:
            sums["bma"] = block["contents"].best_match_at(batch.column("c_z"), batch.column("c_ic"), row, place)
        valid, columns = formula(sums, {c: x[place] for c, x in block["t"].items()}, {c: x[row] for c, x in r.items()})
        keep = np.broadcast_to(valid, (1, n)).reshape(-1)
        return row[keep], place[keep], {c: np.broadcast_to(columns[c], (1, n)).reshape(-1)[keep] for c in order}, n

    def ordered(left, block, target):
        """The rows in the order of what a target like this one gets at least where nothing is shared: (rows, columns, ids)."""
        zero, r = np.zeros((left.num_rows, 1)), {c: x[:, None] for c, x in numbers_of(left).items()}
        sums = {name: zero for name in block["kinds"]} | {f"n_{name}": zero for name in block["kinds"]}
        sums |= {name: zero for name in block["masks"]} | {f"n_{name}": zero == 0 for name in block["masks"]}
        for name, (_, near) in block["near"].items():
            sums |= near.nothing(name, zero.shape)
        if block["contents"] is not None:
            sums["bma"] = zero
        valid, columns = formula(sums, {c: x[[target]] for c, x in block["t"].items()}, r)
        rows = np.flatnonzero(np.broadcast_to(valid, zero.shape)[:, 0])
        columns = {c: np.broadcast_to(columns[c], zero.shape)[rows, 0] for c in order}
        ids = plain(np.asarray(left["ref_id"]))[rows]
        rank = np.lexsort((ids, *(columns[c] for c in reversed(order))))
        return rows[rank], {c: x[rank] for c, x in columns.items()}, ids[rank]

    def told(left):
        """The references sorted by what masks don't tell apart, then by id; of each row the first and the end of those like it; the first of each, and their concepts."""
        kin, r = left["kin"].combine_chunks().fill_null([]), numbers_of(left)
        size = np.asarray(pc.list_value_length(kin), np.int64)
        end = np.cumsum(size) * 8
        data, more = np.asarray(kin.flatten(), np.int64).tobytes(), np.column_stack([r[c] for c in alike if c in r] + [size.astype(np.float64)])
        code, seen = np.zeros(len(size), np.int64), {}
        for i, (a, b, x) in enumerate(zip((end - size * 8).tolist(), end.tolist(), more)):
            code[i] = seen.setdefault((data[a:b], x.tobytes()), len(seen))
        rank = np.lexsort((plain(np.asarray(left["ref_id"])), code))
        left, code = left.take(pa.array(rank)).combine_chunks(), code[rank]
        start = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
        n = np.diff(np.r_[start, len(code)])
        first, end = np.repeat(start, n), np.repeat(start + n, n)
        head = start
        head = head[np.asarray(pc.list_value_length(left["kin"].combine_chunks()).fill_null(0), np.int64)[head] > 0]  # masks find nothing of the others
        batch = left.take(pa.array(head)).combine_chunks()
        kin = batch["kin"].combine_chunks() if len(head) else pa.array([], pa.list_(pa.int64()))
        row = np.repeat(np.arange(len(head)), np.asarray(pc.list_value_length(kin), np.int64))
        return left, {"first": first, "end": end, "at": head, "head": batch, "row": row, "concept": np.asarray(kin.flatten(), np.int64), "numbers": numbers_of(batch)}

    def unlike(left, known, block, enter, limit):
        """Enters the pairs that share an entry of a live kind, and of those that don't the k first of each that masks don't tell apart, as long as they can be among the k best."""
        first, end = known["first"], known["end"]
        base, kind, counts, more = 0, -1, np.zeros(width, np.int64), []
        here = touched(left, block, known["index"])
        for whole in batches(left.take(pa.array(here)), SPARSE):
            for batch in pieces(whole, block):
                cell = sharing(batch, block)
                enter(batch, *sparse(batch, block, cell))
                # the i-th of its kind that shares something stands, if among the k + i first, for one more that doesn't
                row, place = here[cell // width + base], cell % width
                base += batch.num_rows
                rank = np.lexsort((row, place, first[row]))
                row, place = row[rank], place[rank]
                new = np.r_[True, (first[row[1:]] != first[row[:-1]]) | (place[1:] != place[:-1])] if len(row) else np.zeros(0, bool)
                start = np.flatnonzero(new)
                nth = np.arange(len(row)) - np.repeat(start, np.diff(np.r_[start, len(row)])) + np.where(first[row] == kind, counts[place], 0)
                other = first[row] + k + nth
                keep = (row <= other) & (other < end[row])
                more.append((other[keep], place[keep]))
                if first[here[base - 1]] != kind:
                    kind, counts = first[here[base - 1]], np.zeros(width, np.int64)
                counts += np.bincount(place[first[row] == kind], minlength=width)
        row, place = (np.concatenate(x) for x in zip(*more)) if more else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        rows, at = np.unique(row, return_inverse=True)
        for lo in range(0, len(rows), SPARSE):
            some = (at >= lo) & (at < lo + SPARSE)
            batch = left.take(pa.array(rows[lo : lo + SPARSE])).combine_chunks().to_batches()[0]
            enter(batch, *sparse(batch, block, np.unique((at[some] - lo) * width + place[some])))
        reach = sum(masks.reach(width) for _, masks in block["masks"].values())
        places = np.flatnonzero(block["here"] & (reach > 0))
        if not len(places):
            return
        # targets with the same masks and numbers are one
        bits = [np.packbits(np.unpackbits(masks.mask[lo : lo + 4096], axis=1, count=width, bitorder="little").T, axis=1)[places] for _, masks in block["masks"].values() for lo in range(0, len(masks.mask), 4096)]
        own = np.column_stack([*bits, *(np.ascontiguousarray(block["t"][c][places]).view(np.uint8).reshape(len(places), -1) for c in alike if c in block["t"])])
        _, which = np.unique(own, axis=0, return_inverse=True)
        members = places[np.argsort(which.reshape(-1), kind="stable")]
        start = np.searchsorted(np.sort(which.reshape(-1)), np.arange(which.max() + 1))
        rank = np.argsort(reach[members[start]], kind="stable")  # those that reach as much have more alike bounds
        edge = np.r_[start, len(members)]
        for lo in range(0, len(rank), ORDERED):
            some = rank[lo : lo + ORDERED]
            size = edge[some + 1] - edge[some]
            first_ = np.cumsum(size) - size
            pick = np.repeat(edge[some] - first_, size) + np.arange(int(size.sum()))
            favoured(left, known, block, members[pick], first_, enter, limit)

    def alone(batch, block, at):
        """(valid, columns) of the targets `at` and the batch, as if they shared nothing."""
        rows, (flat, r) = batch.num_rows, entries(batch)
        zero = np.zeros((rows, 1))
        sums = {name: zero for name in block["kinds"]} | {f"n_{name}": zero for name in block["kinds"]}
        for name, (side, masks) in block["masks"].items():
            sums[name], sums["n_" + name] = masks.sums(*flat[side], rows, width, at)
        valid, columns = formula(sums, {c: x[at] for c, x in block["t"].items()}, {c: x[:, None] for c, x in r.items()})
        return np.broadcast_to(valid, (rows, len(at))), {c: np.broadcast_to(columns[c], (rows, len(at))) for c in order}

    def favoured(left, known, block, members, start, enter, limit):
        """Enters, of the pairs that share nothing, the k first of each kind, as long as these can be among the k best: the formula of the largest sums is the bound.

        members: targets; those from each start on are alike.
        """
        head, count, at = known["head"], known["head"].num_rows, members[start]
        if not count:
            return
        n, held = np.diff(np.r_[start, len(members)]), lambda: np.maximum.reduceat(limit[members], start)
        key = [known["numbers"][c] for c in alike if c in sizes]
        for _, masks in block["masks"].values():
            w, some = masks.most(known["concept"], width, at)
            key += [np.ceil(np.bincount(known["row"], weights=w, minlength=count) * 4096 - 1e-6) / 4096, (np.bincount(known["row"], weights=some, minlength=count) > 0).astype(np.float64)]
        key, which = np.unique(np.column_stack(key), axis=0, return_inverse=True)
        which, own = which.reshape(-1), [c for c in alike if c in sizes]
        zero = np.zeros((len(key), 1))
        sums = {name: zero for name in block["kinds"]} | {f"n_{name}": zero for name in block["kinds"]}
        for i, name in enumerate(block["masks"]):
            sums |= {name: key[:, [len(own) + 2 * i]], f"n_{name}": key[:, [len(own) + 2 * i + 1]]}
        r = {c: key[:, [own.index(c)]] if c in own else zero for c in sizes}
        least = np.full((len(key), len(at)), np.inf)
        for lo in range(0, len(key), STEP):
            part = slice(lo, lo + STEP)
            cut_ = lambda d: {c: x[part] for c, x in d.items()}
            valid, columns = formula(cut_(sums), {c: x[at] for c, x in block["t"].items()}, cut_(r))
            least[part] = np.where(valid, columns[order[0]] - SLACK, np.inf)
        turn = np.argsort(least.min(1), kind="stable")
        place = np.empty(len(key), np.int64)
        place[turn] = np.arange(len(key))
        least = least[turn]
        tail = np.minimum.accumulate(least[::-1])[::-1]
        rows = np.argsort(place[which], kind="stable")
        step, lo, size = place[which][rows], 0, FEW
        while lo < count:
            most = held()
            if not (tail[step[lo]] <= most).any():
                break
            hi = min(count, lo + size)
            some = np.flatnonzero(least[step[lo] : step[hi - 1] + 1].min(0) <= most)
            if len(some):
                pick = np.sort(rows[lo:hi])
                valid, columns = alone(head.take(pa.array(pick)).combine_chunks().to_batches()[0], block, at[some])
                row, rep = np.nonzero(valid & (columns[order[0]] <= most[some]))
                compared = valid.size
                for c in range(0, len(row), SHARED // 8):
                    expand(left, known, block, members, start, n, pick, some, row[c : c + SHARED // 8], rep[c : c + SHARED // 8], columns, enter, limit, compared)
                    compared = 0
            lo, size = hi, min(STEP * max(1, 2 * ORDERED // max(1, len(some))), 4 * size)

    def expand(left, known, block, members, start, n, pick, some, row, rep, columns, enter, limit, compared):
        """Enters the members and references that pairs of their kinds stand for."""
        value = {c: columns[c][row, rep] for c in order}
        each = n[some[rep]]
        cell = np.repeat(np.arange(len(row)), each)
        target = members[np.repeat(start[some[rep]] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))]
        keep = value[order[0]][cell] <= limit[target]
        cell, target = cell[keep], target[keep]
        first = known["at"][pick[row]]
        each = np.minimum(known["end"][first] - first, k)[cell]
        ref = np.repeat(first[cell] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
        cell, target = np.repeat(cell, each), np.repeat(target, each)
        rows, at = np.unique(ref, return_inverse=True)
        for lo in range(0, len(rows), SPARSE):
            batch = left.take(pa.array(rows[lo : lo + SPARSE])).combine_chunks().to_batches()[0]
            here = np.flatnonzero((at >= lo) & (at < lo + SPARSE))
            base = lo
            for part in pieces(batch, block):
                own = here[(at[here] >= base) & (at[here] < base + part.num_rows)]
                own = own[~np.isin((at[own] - base) * width + target[own], sharing(part, block))]
                enter(part, at[own] - base, target[own], {c: value[c][cell[own]] for c in order}, compared)
                base, compared = base + part.num_rows, 0

    def searched(left, narrow, known, block, number, last):
        here = np.flatnonzero(block["here"])
        best, limit = None, np.full(width, np.inf)

        def enter(batch, row, target, columns, compared):
            nonlocal best
            if cells is not None:
                cells.add(int(compared))
            every = np.asarray(batch.column("ref_id"))
            keep = columns[order[0]] <= limit[target]
            if resumed:
                keep &= _behind([columns[c] for c in order], [block["t"][f"after:{c}"][target] for c in order], every[row], last[target])
            if not keep.any():
                return
            new = {"target": target[keep], "ref": plain(every)[row[keep]], **{c: columns[c][keep] for c in order}}
            if best is not None:
                own = np.zeros(width, bool)
                own[new["target"]] = True
                own = own[best["target"]]
                rest, new = {c: x[~own] for c, x in best.items()}, {c: np.concatenate([best[c][own], new[c]]) for c in new}
            rank = np.lexsort((new["ref"], *(new[c] for c in reversed(order)), new["target"]))
            new = {c: x[rank] for c, x in new.items()}
            twice = np.r_[False, (new["target"][1:] == new["target"][:-1]) & (new["ref"][1:] == new["ref"][:-1])]
            new = {c: x[~twice] for c, x in new.items()}  # pairs that share something are gone through again
            t = new["target"]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            nth = np.arange(len(t)) - np.repeat(first, np.diff(np.r_[first, len(t)]))
            full = nth == k - 1
            limit[t[full]] = new[order[0]][full]
            new = {c: x[nth < k] for c, x in new.items()}
            best = new if best is None else {c: np.concatenate([rest[c], new[c]]) for c in new}

        def closed(at, key):
            """Which targets have k pairs, none behind the key."""
            out = np.zeros(len(at), bool)
            if best is None:
                return out
            some = np.flatnonzero(np.isin(best["target"], at))
            some = some[np.lexsort((best["ref"][some], *(best[c][some] for c in reversed(order)), best["target"][some]))]
            t = best["target"][some]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]]) if len(t) else np.zeros(0, np.int64)
            full = np.diff(np.r_[first, len(t)]) >= k
            kth = some[first[full] + k - 1]
            before, same = np.zeros(len(kth), bool), np.ones(len(kth), bool)
            for c, x in zip(order, key):
                before |= same & (best[c][kth] < x)
                same &= best[c][kth] == x
            before |= same & (best["ref"][kth] <= key[-1])
            return np.isin(at, best["target"][kth[before]])

        if alike is not None:
            unlike(left, known, block, enter, limit)
            here = here[:0]
        elif live and all(name in block["kinds"] for name in live):
            for whole in batches(left.take(pa.array(touched(left, block, known["index"]))), SPARSE):
                for batch in pieces(whole, block):
                    enter(batch, *sparse(batch, block, sharing(batch, block)))
            bound = np.broadcast_to(np.inf if floor is None else floor(block["t"]), (width,))
            here = here[(bound[here] < np.inf) & (bound[here] <= limit[here])]
            if like is not None:
                which = np.asarray(like(block["t"]))[here]
                for kind in np.unique(which):
                    at = here[which == kind]
                    if kind not in known["order"]:
                        known["order"][kind] = ordered(left, block, at[0])
                    rows, columns, ids = known["order"][kind]
                    start, size = 0, min(STEP, max(k, FEW))
                    while start < len(rows):
                        at = at[~closed(at, [*(columns[c][start] for c in order), ids[start]])]
                        if not len(at):
                            break
                        batch = left.take(pa.array(rows[start : start + size])).combine_chunks().to_batches()[0]
                        enter(batch, *dense(batch, block, at))
                        start, size = start + size, min(STEP, 4 * size)
                here = here[:0]
            if best is not None:  # those are gone through once more
                best = {c: x[~np.isin(best["target"], here)] for c, x in best.items()}
            limit[here] = np.inf
        if len(here):
            for batch in narrow:
                enter(batch, *dense(batch, block, here))
        if best is None or not len(best["target"]):
            return schema.empty_table()
        return pa.table([pa.array(number * width + best["target"], pa.int64()), pa.array(best["ref"], schema.field("ref_id").type), *(pa.array(best[c]) for c in order)], schema=schema)

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        left = left.combine_chunks()
        known, out = {}, []  # what all blocks need of the references
        if alike is not None:
            left, known = told(left)
        if live:
            known |= {"index": index(left), "order": {}}
        for i in range(right.num_rows):
            block = pickle.loads(right["payload"][i].as_py())
            last = np.zeros(width, object)
            if resumed:
                last[right["places"][i].as_py()] = right["last"][i].as_py()
            narrow = batches(left, STEP if block["contents"] is None else min(STEP, MATCHED))
            out.append(searched(left, narrow, known, block, int(right["block"][i].as_py()), last))
        return pa.concat_tables(out)

    return run


def _behind(values: list[np.ndarray], cursor: list[np.ndarray], ref: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Which cells come behind their target's cursor."""
    same, behind = np.ones(len(ref), bool), np.zeros(len(ref), bool)
    for value, at in zip(values, cursor):
        behind |= same & (value > at)
        same &= value == at
    tie = np.flatnonzero(same)
    behind[tie] = [ref[i] > last[i] for i in tie]
    return behind
