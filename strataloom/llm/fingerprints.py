r"""Document fingerprints: Merkle trees over sections, paragraphs and leaves.

A text is cut, without gaps, at starts of words: a paragraph starts after a line break, and a section
after an empty line or after a paragraph whose digest's first byte 8 divides, so that an edit
moves no cut but those next to it.  Leaves are runs of words in a paragraph, cut after
words whose hash 8 divides (and that differ from the word before) or after 32 words; of a longer word than 256 bytes, each 256 bytes are one.
Leaves have digests of their bytes, the others of the digests below them: equal roots are equal texts,
and where roots differ only differing branches need to be looked at.

A fingerprint is the root's digest in hex, a colon, and the leaves, as 8 hex digits and
their code points (`1f00ba55.41`), with `,` within a paragraph, `;` between paragraphs and `/` between sections.

Defined results: null counts as the empty text, which has a root and no leaves; equal texts have
equal fingerprints, whatever else differs; a text of any length is taken whole;
documents follow each other by id (nulls first), equal ids by the MD5 of their texts, and repeated rows each other;
further columns, clashing names included, are not read; empty tables give empty tables.
"""

from __future__ import annotations

import hashlib
import json
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

CUT, LEAF_WORDS, LONG_WORD = 8, 32, 256
#: Buckets of with_next() for each shuffle partition; least copies of a row that are dealt apart.
BUCKETS, MANY = 2, 10_000
#: Rows that one task makes of a row with many copies.
COPIES = 100_000


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


@dataclass(frozen=True)
class Tree:
    """sections: (digest, [(paragraph's digest, [(leaf's digest, first code point, code points)])])."""

    root: bytes
    sections: list

    def leaves(self) -> Counter:
        return Counter((leaf[:4], size) for _, paragraphs in self.sections for _, leaves in paragraphs for leaf, _, size in leaves)

    def fingerprint(self) -> str:
        return self.root.hex() + ":" + "/".join(";".join(",".join(f"{leaf[:4].hex()}.{size}" for leaf, _, size in leaves) for _, leaves in paragraphs) for _, paragraphs in self.sections)


def _cuts(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts of leaves in the column's bytes, whether a paragraph or a section starts there; the bytes' rows' offsets."""
    w = _text.Words(column)
    data, offs, n = w.data, w.offs, len(w.start)
    level = np.zeros(n, np.int8)  # 1 leaf, 2 paragraph, 3 section
    if n > 1:
        lines = np.zeros(len(data) + 1, np.int64)
        np.cumsum(data == 0x0A, out=lines[1:])
        broken = lines[w.start[1:]] - lines[w.end[:-1]]
        cut = w.hash[:-1] % np.uint64(CUT) == 0
        cut[1:] &= w.hash[1:-1] != w.hash[:-2]
        level[1:] = np.maximum(cut, np.minimum(broken + (broken > 0), 3))
    first = np.flatnonzero(np.r_[True, w.row[1:] != w.row[:-1]]) if n else np.zeros(0, np.int64)
    level[first] = 3
    since = np.arange(n)
    since = since - np.maximum.accumulate(np.where(level > 0, since, 0))
    level[(since > 0) & (since % LEAF_WORDS == 0)] = 1
    start = w.start.copy()
    start[first] = offs[w.row[first]]  # leading white space belongs to the first leaf
    at, kind = start[level > 0], level[level > 0]
    none = np.flatnonzero((w.count == 0) & (np.diff(offs) > 0))  # white space alone
    at, kind = np.r_[at, offs[none]], np.r_[kind, np.full(len(none), 3, np.int8)]
    for i in np.flatnonzero(w.end - w.start > LONG_WORD):
        more = np.arange(w.start[i] + LONG_WORD, w.end[i], LONG_WORD)
        while len(inside := np.flatnonzero((more < w.end[i]) & ((data[np.minimum(more, len(data) - 1)] & 0xC0) == 0x80))):
            more[inside] += 1  # on to the start of a code point
        more = more[more < w.end[i]]
        at, kind = np.r_[at, more], np.r_[kind, np.ones(len(more), np.int8)]
    order = np.argsort(at, kind="stable")
    return data, offs, at[order], kind[order]


def trees(texts: list[str | None]) -> list[Tree]:
    """The tree of each text."""
    data, offs, at, kind = _cuts(pa.array(texts, pa.large_string()))
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    end = np.r_[at[1:], offs[-1:]]
    bounds = np.searchsorted(at, offs)
    end[bounds[1:][bounds[1:] > bounds[:-1]] - 1] = offs[1:][bounds[1:] > bounds[:-1]]
    size, whole = (points[end] - points[at]).tolist(), data.tobytes()
    first = (points[at] - points[offs[np.searchsorted(offs, at, "right") - 1]]).tolist()
    digests = [_digest(whole[a:b]) for a, b in zip(at.tolist(), end.tolist())]
    kind, bounds, out = kind.tolist(), bounds.tolist(), []
    for lo, hi in zip(bounds, bounds[1:]):
        sections, paragraphs, i = [], [], lo
        while i < hi:
            j = i + 1
            while j < hi and kind[j] == 1:
                j += 1
            paragraphs.append((_digest(b"p" + b"".join(digests[i:j])), [(digests[x], first[x], size[x]) for x in range(i, j)]))
            if j == hi or kind[j] == 3 or paragraphs[-1][0][0] % CUT == 0:
                sections.append((_digest(b"s" + b"".join(p for p, _ in paragraphs)), paragraphs))
                paragraphs = []
            i = j
        out.append(Tree(_digest(b"r" + b"".join(s for s, _ in sections)), sections))
    return out


def _alike(a: Counter, b: Counter) -> float:
    """Share of code points in leaves that both have (Dice); 1 for two texts without any."""
    total = sum(n * size for side in (a, b) for (_, size), n in side.items())
    small, large = (a, b) if len(a) < len(b) else (b, a)
    return 2.0 * sum(min(n, large[leaf]) * leaf[1] for leaf, n in small.items() if leaf in large) / total if total else 1.0


def likeness(a: str, b: str) -> float:
    """How alike two fingerprints are, from 0 to 1: the share of code points in common leaves; 1 for equal roots."""
    if a[:32] == b[:32]:
        return 1.0
    parsed = lambda x: Counter((leaf[:8], int(leaf[9:])) for leaf in x[33:].replace("/", ",").replace(";", ",").split(",") if leaf)
    return _alike(parsed(a), parsed(b))


def fingerprints(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, fingerprint) of every whole text."""

    def run(batches):
        for part in _text.chunks(batches):
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array([t.fingerprint() for t in trees(part.column("text").to_pylist())], pa.string())], [key, "fingerprint"])

    return _spark.arrow_map(docs.select(key, F.col("text").cast("string").alias("text")), run, f"{key} {_spark.id_type(docs, key)}, fingerprint string")


def leaves(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, root, section, paragraph, leaf: digests, start, end: code points): the leaves of every text with the branches they are on."""

    def run(batches):
        for part in _text.chunks(batches):
            got = {c: [] for c in ("at", "root", "section", "paragraph", "leaf", "start", "end")}
            for i, tree in enumerate(trees(part.column("text").to_pylist())):
                for s, paragraphs in tree.sections:
                    for p, below in paragraphs:
                        for leaf, start, size in below:
                            for c, v in zip(got, (i, tree.root, s, p, leaf, start, start + size)):
                                got[c].append(v)
            kinds = [pa.binary()] * 4 + [pa.int64()] * 2
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(got.pop("at"), pa.int64())), *(pa.array(v, t) for v, t in zip(got.values(), kinds))], [key, *got])

    return _spark.arrow_map(docs.select(key, F.col("text").cast("string").alias("text")), run, f"{key} {_spark.id_type(docs, key)}, root binary, section binary, paragraph binary, leaf binary, start long, end long")


def edits(before: DataFrame, after: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, side, start, end): the code points of `before` and of `after` (side) that the other text of the key hasn't; ids are unique and not null.

    Whole equal texts, then equal sections, paragraphs and leaves leave the comparison; what only moved is not listed.
    """
    sides = {"before": leaves(before, key), "after": leaves(after, key)}

    def only(side: str, other: str) -> DataFrame:
        left = sides[side]
        for level in ("root", "section", "paragraph", "leaf"):
            left = left.join(sides[other].select(key, level), [key, level], "left_anti")
        return left.select(key, F.lit(side).alias("side"), "start", "end")

    return only("before", "after").unionByName(only("after", "before"))


_RESULT = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(rows: DataFrame, kind: str) -> DataFrame:
    """(doc_id, md, ..) of each row with the row after it; rows: (bucket, last, doc_id, md, text), in order within buckets, of which those with `last` only end one."""

    def run(batches):
        held = None  # (id, md, text, tree) of the row that waits for its next one
        for part in _text.chunks(batches):
            texts = [t or "" for t in part.column("text").to_pylist()]
            every = list(zip(part.column("last").to_pylist(), part.column("doc_id").to_pylist(), part.column("md").to_pylist(), texts, trees(texts)))
            pairs = []
            for last, doc_id, md, text, tree in every:
                if held is not None:
                    half = len(held[2]) // 2
                    pairs.append((*held, held[2][: len(held[2]) - half] + text[:half], tree))
                held = None if last else (doc_id, md, text, tree)
            if not pairs:
                continue
            out = []
            for (doc_id, md, text, own, edited, after), tree in zip(pairs, trees([p[4] for p in pairs])):
                mine = own.leaves()
                near = [1.0 if own.root == x.root else _alike(mine, x.leaves()) for x in (tree, after)]
                out.append((doc_id, md, len(text), hashlib.sha256(edited.encode()).hexdigest(), own.fingerprint(), tree.fingerprint(), *near))
            columns = list(zip(*out))
            types = [part.schema.field("doc_id").type, pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["doc_id", "md", *(x.split()[0] for x in _RESULT.split(", "))])

    return _spark.arrow_map(rows, run, f"doc_id {kind}, md string, {_RESULT}")


def with_next(docs: DataFrame, many: int = MANY) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row; docs: (doc_id, text).

    A document is edited by the next one.  A light pass over ids and MD5s of texts gives the
    bounds of buckets of about equally many documents; texts are shuffled once, to their buckets, and the
    first document of each bucket also to the one before.  Tasks read sorted buckets and hold two documents at a time.
    A row with more copies than a bucket has documents (there are fewer of those than buckets) is shuffled once, and its copies are made afterwards.
    """
    spark, kind = docs.sparkSession, _spark.id_type(docs)
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("md", F.md5("text"))
    parts = _spark.parts(spark)
    buckets = BUCKETS * parts
    keys = rows.groupBy("doc_id", "md").agg(F.count(F.lit(1)).alias("n")).repartitionByRange(buckets, "doc_id", "md")
    keys = _spark.written(keys.withColumn("part", F.spark_partition_id()), "fingerprint-keys")
    total = keys.agg(F.sum("n")).first()[0] or 0
    first = keys.groupBy("part").agg(F.min(F.struct("doc_id", "md")).alias("b")).orderBy("part")  # a row a bucket
    bounds = [json.loads(r[0]) for r in first.select(F.to_json("b")).collect()]
    if not bounds:
        return spark.createDataFrame([], f"doc_id {kind}, {_RESULT}")
    listed = F.from_json(F.lit(json.dumps(bounds)), f"array<struct<doc_id: {kind}, md: string>>")
    hot = keys.where(F.col("n") > max(many, total // buckets)).select("doc_id", "md", "n")  # fewer than buckets
    some = not hot.isEmpty()
    if some:
        names = F.broadcast(hot.select(F.col("doc_id").alias("_id"), F.col("md").alias("_md"), F.col("n")))
        same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("md") == F.col("_md"))
        copies = rows.join(names, same).groupBy("doc_id", "md").agg(F.first("text").alias("text"), F.first("n").alias("n"))
        rows = rows.join(names, same, "left_anti").unionByName(copies.drop("n"))
    at = F.size(F.filter(listed, lambda b: b <= F.struct("doc_id", "md"))) - 1
    placed = rows.withColumn("at", at)
    head = F.element_at(listed, F.col("at") + 1).eqNullSafe(F.struct("doc_id", "md"))
    role = lambda bucket, last: F.struct(bucket.alias("bucket"), F.lit(last).alias("last"))
    before = F.when(F.col("at") > 0, F.col("at") - 1).otherwise(len(bounds) - 1)
    placed = placed.select("*", F.inline(F.when(head, F.array(role(F.col("at"), False), role(before, True))).otherwise(F.array(role(F.col("at"), False)))))
    order = lambda d: d.select("bucket", "last", "doc_id", "md", "text").repartition(parts, "bucket").sortWithinPartitions("bucket", "last", "doc_id", "md")
    got = _compared(order(placed), kind)
    if some:  # all copies but one are followed by a copy
        twice = copies.select("*", F.xxhash64("doc_id", "md").alias("bucket"), F.explode(F.array(F.lit(False), F.lit(True))).alias("last"))
        selves = _compared(order(twice), kind).join(names, same).withColumn("share", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 2) / COPIES))))
        selves = selves.repartition(parts, "doc_id", "md", "share")
        left = F.least(F.lit(COPIES), F.col("n") - 1 - F.col("share") * COPIES).cast("int")
        got = got.unionByName(selves.withColumn("_", F.explode(F.sequence(F.lit(1), left))).select(got.columns))
    return got.drop("md")


def op12_fingerprints(spark, sf_dir: str) -> DataFrame:
    return with_next(_spark.table(spark, sf_dir, "documents").select("doc_id", "text"))
