"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of word shingles (words [^\\x20\\x09-\\x0D]+, unchanged; a text of
fewer words is one shingle).  Equal texts (by SHA-1) form one class, whose
representative alone is compared; it gets a number of its own, so that no two
texts are taken for one.  MinHash bands bring candidates together.  Their MinHash
values are compared a few at a time, and a pair goes as soon as the posterior
probability that it reaches the threshold, given the matches so far, is below
TOLERANCE.  What survives spans clusters; inside a cluster the same pruning is
applied to each pair, and those that it leaves are verified exactly on the
shingle sets, and counted, without becoming rows.

A pair at the threshold shares no band with probability (1 - t**ROWS)**BANDS,
3e-6 at 0.8 and less above.  Large buckets and clusters are cut into blocks of
at most BLOCK members and about BLOCK_BYTES of shingles; one task compares two
blocks.  What a task emits is linear in its members: link counts and a spanning forest.

Defined results: null texts and texts without a word link to nothing and are
classes of their own; repeated rows are copies; rows of one id with different
texts are different texts, and the class takes its smallest id; ids that are not integers are numbered
in ascending order for that; a text of any length
is one set, and one text alone may exceed the bytes of a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.workers import numbered
from . import _spark, _text
from ._components import components

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
HASHES = BANDS * ROWS
#: MinHash values that are compared at a time; of each, one byte is kept.
STEP = 16
TOLERANCE = 1e-6
BLOCK = 512
#: Clusters of full texts take smaller blocks, as long as these make no more than SPREAD of them.
SMALL_BLOCK, SPREAD = 128, 16
#: Bytes of the shingles of a block, on average.
BLOCK_BYTES = 32 << 20
_NO_ID = -(1 << 63) + 1

_RNG = np.random.default_rng(7)
_MUL = _RNG.integers(1, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _RNG.integers(0, 2**63, HASHES, dtype=np.uint64)


def needed(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[int]:
    """For STEP, 2 * STEP, ... compared values: the fewest matches whose posterior probability of reaching the threshold is at least the tolerance (uniform prior; a byte matches by chance in 1 of 256)."""
    j = (np.arange(20_000) + 0.5) / 20_000
    p = j + (1 - j) / 256
    out = []
    for k in range(STEP, HASHES + 1, STEP):
        for m in range(k + 1):
            like = m * np.log(p) + (k - m) * np.log1p(-p)
            like = np.exp(like - like.max())
            if like[j >= threshold].sum() / like.sum() >= tolerance:
                out.append(m)
                break
    return out


def shingles(column, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles and their rows, in order of the rows."""
    w = _text.Words(column)
    at = np.flatnonzero(_text.window_ok(w.row, n))
    row, h = w.row[at], _text.window_hash(w.hash, n)[at]
    short = np.flatnonzero((w.count > 0) & (w.count < n))
    if len(short):
        own = [_text.window_hash(w.hash[w.first[r] : w.first[r] + w.count[r]], int(w.count[r]))[0] for r in short]
        row, h = np.r_[row, short], np.r_[h, np.array(own, np.uint64)]
        order = np.argsort(row, kind="stable")
        row, h = row[order], h[order]
    return row, h


def signatures_chunk(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows that have shingles, and for them their number, band keys (rows, BANDS) and MinHash bytes (rows, HASHES)."""
    row, h = shingles(column)
    if not len(row):
        return row, row, np.zeros((0, BANDS), np.int64), np.zeros((0, HASHES), np.uint8)
    first = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    low = np.empty((HASHES, len(first)), np.uint64)
    for k in range(HASHES):
        low[k] = np.minimum.reduceat(h * _MUL[k] + _ADD[k], first)
    low = _text.mix(low.T.copy())
    keys = low.reshape(len(first), BANDS, ROWS)
    band = np.zeros((len(first), BANDS), np.uint64)
    for r in range(ROWS):
        band = _text.mix(band * np.uint64(31) + keys[:, :, r])
    band = _text.mix(band + np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return row[first], np.diff(np.r_[first, len(row)]), band.view(np.int64), (low >> np.uint64(56)).astype(np.uint8)


def _by_number(docs: DataFrame, numbers: DataFrame) -> DataFrame:
    """docs with their ids' places in ascending order as doc_id; numbers: (doc_id, n)."""
    name = _spark.free("n", docs)
    both = docs.join(numbers.withColumnRenamed("n", name), "doc_id", "left")
    return both.select(*(F.col(name).alias("doc_id") if c == "doc_id" else F.col(f"`{c}`") for c in docs.columns))


def _id(docs: DataFrame):
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))


def _sha():
    return F.unhex(F.sha1(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary")))


def signatures(docs: DataFrame) -> DataFrame:
    """(id, sha, size, bands, sig) of every text; size: shingles; bands and sig are null without shingles."""

    def run(batches):
        for part in _text.chunks(batches):
            rows, size, band, sig = signatures_chunk(part.column("text"))
            n = part.num_rows
            has = np.zeros(n, bool)
            has[rows] = True
            sizes = np.zeros(n, np.int64)
            sizes[rows] = size
            at = np.r_[0, np.cumsum(has)]
            null = pa.array(~has)
            bands = pa.ListArray.from_arrays(pa.array(at * BANDS, pa.int32()), pa.array(band.ravel()), mask=null)
            sigs = np.full(n, None, object)
            sigs[rows] = [s.tobytes() for s in sig]
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("sha"), pa.array(sizes), bands, pa.array(sigs, pa.binary())], ["id", "sha", "size", "bands", "sig"])

    rows = docs.select(_id(docs).alias("id"), _sha().alias("sha"), F.col("text").cast("string").alias("text"))
    return _spark.arrow_map(rows, run, "id long, sha binary, size long, bands array<long>, sig binary")


def _blocks(rows: DataFrame, n: str, by: str, small: bool = False) -> DataFrame:
    """Each row once for every pair of blocks (i, j) that its block, own, belongs to; n: rows with the same key `by`; small: there are full texts, of `bytes` for the key."""
    many = F.ceil(F.col(n) / BLOCK).cast("int")
    if small:
        many = F.least(F.ceil(F.col(n) / min(SMALL_BLOCK, BLOCK)).cast("int"), F.greatest(many, F.lit(SPREAD)))
        many = F.least(F.greatest(many, F.ceil(F.col("bytes") / BLOCK_BYTES).cast("int")), F.col(n).cast("int"))
    own = F.pmod(F.xxhash64("node", by), many).cast("int")
    split = rows.withColumn("many", many).withColumn("own", own)
    return split.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("many") - 1))).withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("many", "other")


def _grouped(batches, keys: tuple[str, ...]):
    """Record batches of sorted rows as batches that hold whole groups of equal keys."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        got = pa.Table.from_batches([batch])
        if rest is not None:
            got = pa.concat_tables([rest, got]).combine_chunks()
        last = np.ones(got.num_rows, bool)
        for k in keys:
            col = np.asarray(got.column(k))
            last &= col == col[-1]
        cut = got.num_rows - int(last[::-1].cumprod().sum())
        if cut:
            yield got.slice(0, cut)
        rest = got.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _edges_of(*columns) -> np.ndarray:
    new = np.zeros(len(columns[0]), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.r_[np.flatnonzero(new), len(new)]


def _pairs(own: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs of a task: within a block if i = j, else between the two."""
    if i == j:
        return np.triu_indices(len(own), 1)
    a, b = np.flatnonzero(own == i), np.flatnonzero(own == j)
    return np.repeat(a, len(b)), np.tile(b, len(a))


def _surviving(sig: np.ndarray, a: np.ndarray, b: np.ndarray, need: list[int]):
    """Pairs that the incremental comparison doesn't drop."""
    out_a, out_b = [], []
    for at in range(0, len(a), 200_000):
        x, y = a[at : at + 200_000], b[at : at + 200_000]
        match = np.zeros(len(x), np.int32)
        for k, least in enumerate(need):
            part = slice(k * STEP, (k + 1) * STEP)
            match = match + (sig[x, part] == sig[y, part]).sum(1)
            ok = match >= least
            x, y, match = x[ok], y[ok], match[ok]
        out_a.append(x)
        out_b.append(y)
    return np.concatenate(out_a) if out_a else a, np.concatenate(out_b) if out_b else b


def _leaders(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest position of each position's component under the pairs."""
    lead = np.arange(n)
    while True:
        low = np.minimum(lead[a], lead[b])
        new = lead.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, lead, new)
        new = new[new]
        if (new == lead).all():
            return lead
        lead = new


def _spanned(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the pairs: (member, leader) by node."""
    seen, at = np.unique(np.r_[a, b], return_inverse=True)
    lead = _leaders(len(seen), at[: len(a)], at[len(a) :])
    away = np.flatnonzero(lead != np.arange(len(seen)))
    return node[seen[away]], node[seen[lead[away]]]


def candidates(reps: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(a, b): spanning forests of the pairs that share a band and survive the pruning; reps: node, bands, sig."""
    need = needed(threshold, tolerance)
    banded = reps.select("node", F.explode("bands").alias("key"))
    counts = _spark.written(banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "bands")
    shared = _spark.spread_join(banded, counts, "key", "n", BANDS * reps.count())
    members = _blocks(shared.join(reps.select("node", "sig"), "node"), "n", "key")
    spark = reps.sparkSession
    dealt = members.select("key", "i", "j", "own", "node", "sig").repartition(_spark.parts(spark), "key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches):
        for got in _grouped(batches, ("key", "i", "j")):
            key, i, j, own, node = (np.asarray(got.column(c)) for c in ("key", "i", "j", "own", "node"))
            sig = np.frombuffer(b"".join(got.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            edge = _edges_of(key, i, j)
            size = np.diff(edge)
            found = []
            for s in np.unique(size[size > 1]):
                start = edge[:-1][size == s]
                if s <= 32:
                    same = i[start] == j[start]
                    x, y = np.triu_indices(s, 1)
                    a, b = ((start[same, None] + z).ravel() for z in (x, y))
                    found.append(_surviving(sig, a, b, need))
                    start = start[~same]
                for at in start:
                    a, b = _pairs(own[at : at + s], i[at], j[at])
                    a, b = _surviving(sig, a + at, b + at, need)
                    found.append((a, b))
            if found:
                a, b = (np.concatenate(x) for x in zip(*found))
                if len(a):
                    # positions of one node in several groups are one
                    names, place = np.unique(node, return_inverse=True)
                    x, y = _spanned(names, place[a], place[b])
                    yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(y)], ["a", "b"])

    return _spark.arrow_map(dealt, run, "a long, b long").distinct()


def _sets(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(cluster, n, bytes, node, sig, shingles): sorted distinct fingerprints of the members' texts; members: node, sha, rep, sig, cluster, n, bytes."""
    texts = docs.select(_id(docs).alias("rep"), _sha().alias("sha"), F.col("text").cast("string").alias("text"))
    names = ["cluster", "n", "bytes", "node", "sig"]
    joined = texts.join(members.hint("shuffle_hash"), ["sha", "rep"]).select(*names, "text")

    def run(batches):
        for part in _text.chunks(batches):
            row, h = shingles(part.column("text"))
            edge = np.searchsorted(row, np.arange(part.num_rows + 1))
            sets = [np.unique(h[a:b]).tobytes() for a, b in zip(edge[:-1], edge[1:])]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(sets, pa.binary())], [*names, "shingles"])

    return _spark.arrow_map(joined, run, "cluster long, n long, bytes long, node long, sig binary, shingles binary")


def _exact(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs (a, b) of positions, those whose Jaccard similarity reaches the threshold."""
    size = np.array([len(s) for s in sets])
    left, right = np.unique(a), np.unique(b)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), size)
    order = np.argsort(flat, kind="stable")
    new = np.r_[True, flat[order[1:]] != flat[order[:-1]]]
    term = np.cumsum(new) - 1
    often = np.bincount(term) > 1
    number = np.cumsum(often) - 1
    pick = often[term]
    term, owner = number[term[pick]], owner[order[pick]]  # sorted by term
    place = {}
    for name, side in (("l", left), ("r", right)):
        place[name] = np.full(len(sets), -1)
        place[name][side] = np.arange(len(side))
    both = np.zeros((len(left), len(right)), np.float32)
    width = 4096
    for at in range(0, int(often.sum()), width):
        low, high = np.searchsorted(term, [at, at + width])
        t, o = term[low:high] - at, owner[low:high]
        planes = []
        for name, side in (("l", left), ("r", right)):
            plane = np.zeros((len(side), width), np.float32)
            mine = place[name][o]
            plane[mine[mine >= 0], t[mine >= 0]] = 1
            planes.append(plane)
        both += planes[0] @ planes[1].T
    common = both[place["l"][a], place["r"][b]]
    ok = common >= threshold * (size[a] + size[b] - common) - 1e-6
    return a[ok], b[ok]


def verified(sets: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """(node, leader, links): exact links of each member within a pair of blocks, and its leader there (itself, if it has none); only pairs that the pruning leaves are verified."""
    spark, need = sets.sparkSession, needed(threshold, tolerance)
    dealt = _blocks(sets, "n", "cluster", small=True).select("cluster", "i", "j", "own", "node", "sig", "shingles").repartition(_spark.parts(spark), "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j")

    def run(batches):
        for got in _grouped(batches, ("cluster", "i", "j")):
            cluster, i, j, own, node = (np.asarray(got.column(c)) for c in ("cluster", "i", "j", "own", "node"))
            blobs = got.column("shingles").to_pylist()
            sig = np.frombuffer(b"".join(got.column("sig").to_pylist()), np.uint8).reshape(-1, HASHES)
            edge = _edges_of(cluster, i, j)
            out = []
            for start, end in zip(edge[:-1], edge[1:]):
                names, index = np.unique(node[start:end], return_index=True)  # repeated rows are one text
                place = np.arange(start, end)[index]
                a, b = _pairs(own[place], i[start], j[start])
                a, b = _surviving(sig[place], a, b, need)
                if not len(a):
                    continue
                left, right = np.unique(a), np.unique(b)
                some = np.union1d(left, right)
                sets = [np.frombuffer(blobs[place[k]], np.uint64) for k in some]
                x, y = _exact(sets, np.searchsorted(some, a), np.searchsorted(some, b), threshold)
                x, y = some[x], some[y]
                if len(x):
                    links = np.bincount(np.r_[x, y], minlength=len(names))
                    lead = _leaders(len(names), x, y)
                    some = np.flatnonzero(links)
                    out.append((names[some], names[lead[some]], links[some]))
            if out:
                a, b, n = (np.concatenate(x) for x in zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64))], ["node", "leader", "links"])

    return _spark.arrow_map(dealt, run, "node long, leader long, links long")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """By text with a word: (sha, copy_of, class_id, class_sha, copies, n_links), where the ids are the smallest ones; and by row: (id, sha, worded)."""
    sigs = _spark.written(signatures(docs), "signatures")
    worded = sigs.where("sig is not null")
    reps = worded.groupBy("sha").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("size").alias("size"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    # written with its numbers, which are a text's name from here on
    reps = _spark.written(reps.withColumn("node", F.monotonically_increasing_id()), "reps")
    clusters = components(candidates(reps, threshold))
    linked = clusters.join(reps.select("node", "sha", "rep", "size", "sig"), "node").withColumnRenamed("label", "cluster")
    sizes = _spark.written(linked.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("size") * 8).alias("bytes")), "sizes")
    n = clusters.count()
    members = _spark.spread_join(linked, sizes, "cluster", "n", n)
    links = _spark.written(verified(_sets(docs, members), threshold), "links")
    labels = components(links.select(F.col("node").alias("a"), F.col("leader").alias("b")))
    counts = links.groupBy("node").agg(F.sum("links").alias("n_links"))
    texts = reps.select("node", "sha", "rep", "copies")
    grouped = texts.join(labels, "node").join(counts, "node", "left")
    first = _spark.written(grouped.groupBy("label").agg(F.min(F.struct("rep", "sha")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    grouped = _spark.spread_join(grouped, first, "label", "n", n).select("sha", F.col("rep").alias("copy_of"), F.col("first.rep").alias("class_id"), F.col("first.sha").alias("class_sha"), "copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    alone = texts.join(labels, "node", "left_anti").select("sha", F.col("rep").alias("copy_of"), F.col("rep").alias("class_id"), F.col("sha").alias("class_sha"), "copies", F.lit(0).cast("long").alias("n_links"))
    return grouped.unionByName(alone), sigs.select("id", "sha", F.col("sig").isNotNull().alias("worded"))


def join(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, copy_of, n_copies, n_links) of every row.

    class_id: smallest id that links of similar or equal texts lead to; copy_of:
    smallest id with the same text; n_links: different texts that reach the threshold.
    """
    if not _spark.integer_ids(docs):
        numbers = numbered(docs.select("doc_id"), "doc_id")
        got = join(_by_number(docs.select("doc_id", "text"), numbers), threshold)
        for c in ("doc_id", "class_id", "copy_of"):
            got = got.withColumnRenamed(c, "n").join(numbers.withColumnRenamed("doc_id", c), "n", "left").drop("n")
        return got.select("doc_id", "class_id", "copy_of", "n_copies", "n_links")
    texts, rows = classes(docs, threshold)
    texts = _spark.written(texts.drop("class_sha"), "texts")
    got = _spark.spread_join(rows.where("worded").select("id", "sha"), texts, "sha", "copies", rows.count())
    got = got.unionByName(rows.where("not worded").select("id", "sha"), allowMissingColumns=True)
    own = F.when(F.col("id") != _NO_ID, F.col("id"))
    pick = lambda c: F.when(F.coalesce(c, "id") != _NO_ID, F.coalesce(c, "id"))
    return got.select(own.alias("doc_id"), pick("class_id").alias("class_id"), pick("copy_of").alias("copy_of"), F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The row of docs with the smallest id of each class, all columns; rows without a word stay, repeated rows once."""
    if not _spark.integer_ids(docs):
        numbers, name = numbered(docs.select("doc_id"), "doc_id"), _spark.free("n", docs)
        kept = one_of_each(_by_number(docs, numbers), threshold).withColumnRenamed("doc_id", name)
        kept = kept.join(numbers.withColumnRenamed("n", name), name, "left")
        return kept.select(*(f"`{c}`" for c in docs.columns))
    texts, rows = classes(docs, threshold)
    id_, sha = _spark.free("_id", docs), _spark.free("_sha", docs)
    first = texts.where("sha = class_sha").select(F.col("class_id").alias(id_), F.col("sha").alias(sha))
    keep = first.unionByName(rows.where("not worded").select(F.col("id").alias(id_), F.col("sha").alias(sha)).distinct())
    keep = _spark.written(keep, "kept")
    keyed = docs.withColumns({id_: _id(docs), sha: _sha()})
    kept = keyed.join(keep.hint("shuffle_hash"), [id_, sha])
    return kept.dropDuplicates([id_, sha]).select(*(f"`{c}`" for c in docs.columns))


def op1_ngram_join(spark, sf_dir: str) -> DataFrame:
    return join(_spark.table(spark, sf_dir, "documents"))
