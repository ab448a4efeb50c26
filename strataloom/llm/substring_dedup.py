"""Substring dedup by prefix-partitioned suffix trees.

Every window of WINDOW words is filed under one suffix: the one that starts at
the window's minimal PREFIX-word fingerprint.  So equal windows stand at the same
offset of suffixes with equal prefixes, and only a few suffixes of a text are
needed.  Prefixes have variable length, so that every group fits into memory: a
first pass counts the suffixes by buckets of their prefixes, after equal suffixes of
a task are folded; where a bucket has more than CAP, the prefixes in it are lengthened to the
whole window, which deals its windows to other groups.  In a group, a
prefix that occurs once is a leaf and is dropped at once; below the others, the tree is
grown to the windows: a node that is reached by two starts and is WINDOW words deep is a
repeat, and the runs of such starts are the maximal repeats.  Edges of the tree
are held as fingerprints of their words (64 bits for the prefix, 48 for the rest),
since the words themselves would double what travels.

Defined results: null and short texts have no window and stay as they are; equal
rows repeat each other; rows of one id with different texts are kept apart; ids may be texts; a text
of any length is split into its suffixes like others.
"""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

WINDOW = 35
PREFIX = 12
#: Bytes of text whose suffixes are folded and sent together.
FLUSH = 24 << 20
#: Bytes of input per group, and groups per partition at least.
GROUP_BYTES = 8 << 20
GROUPS_EACH = 8
#: Suffixes of a bucket of prefixes from which these are lengthened, buckets for each CAP of suffixes that the input may have, and the fewest buckets.
CAP = 1 << 18
BUCKETS_EACH, LEAST_BUCKETS = 16, 1 << 12

_HEAD = "id long, chk long"


def _bucket(head: np.ndarray, buckets: int) -> np.ndarray:
    return (_text.mix(head + np.uint64(7)) % np.uint64(buckets)).astype(np.int64)


def _suffixes(ids, chk, column, window: int, prefix: int, heavy: np.ndarray | None = None):
    """Per suffix: prefix fingerprint, id, chk, first window start, number of windows; and all windows' fingerprints.  heavy: for each bucket of prefixes, whether they are lengthened to the window."""
    w = _text.Words(column)
    ok = _text.window_ok(w.row, window)
    if not ok.any():
        return None
    head = _text.window_hash(w.hash, prefix)
    whole = _text.window_hash(w.hash, window)
    anchor = _text.sliding_min(head, window - prefix + 1)
    at = np.flatnonzero(ok)
    anchor, whole, row = anchor[at], whole[at], w.row[at]
    new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])]
    long = None
    if heavy is not None and heavy.any():
        first = np.flatnonzero(new)
        long = np.repeat(heavy[_bucket(head[anchor[first]], len(heavy))], np.diff(np.r_[first, len(at)]))
        new |= long
    first = np.flatnonzero(new)
    count = np.diff(np.r_[first, len(at)])
    row = row[first]
    key = head[anchor[first]]
    if long is not None:
        key = np.where(long[first], _text.mix(whole[first] + np.uint64(11)), key)
    return key, ids[row], chk[row], (at[first] - w.first[row]).astype(np.int32), count.astype(np.uint16), whole


def _ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges start .. start+count-1."""
    count = count.astype(np.int64)
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))


def _folded(head, ids, chk, start, count, whole):
    """Of equal suffixes, the places of the first ones, and whether each suffix has equal ones; and the edges of the suffixes in whole."""
    edge = np.r_[0, np.cumsum(count.astype(np.int64))]
    total = np.zeros(len(whole) + 1, np.uint64)
    np.cumsum(_text.mix(whole + np.uint64(1)), out=total[1:])
    same = _text.mix(head ^ _text.mix(total[edge[1:]] - total[edge[:-1]] + count))
    order = np.argsort(same, kind="stable")
    new = np.r_[True, same[order[1:]] != same[order[:-1]]]
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    twice = np.zeros(len(head), bool)
    twice[order] = np.repeat(size > 1, size)
    return np.sort(order[new]), twice, edge


def _packed(groups: int, head, ids, chk, start, count, whole):
    """Rows (grp, kind, n, blob): kind 0 for suffixes to compare, kind 1 for starts that are known to repeat."""
    keep, twice, edge = _folded(head, ids, chk, start, count, whole)
    grp = (head % np.uint64(groups)).astype(np.int64)
    pick = keep[np.argsort(grp[keep], kind="stable")]
    bounds = np.searchsorted(grp[pick], np.arange(groups + 1))
    out = []
    for g in np.flatnonzero(np.diff(bounds)):
        own = pick[bounds[g] : bounds[g + 1]]
        win = whole[_ragged(edge[own], count[own])]
        blob = b"".join(x.tobytes() for x in (head[own], ids[own], chk[own], start[own], count[own], twice[own].astype(np.uint8), (win & np.uint64(0xFFFFFFFF)).astype(np.uint32), ((win >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.uint16)))
        out.append((int(g), 0, len(own), blob))
    known = np.flatnonzero(twice)
    for part in np.array_split(known, max(1, -(-len(known) // 50_000))) if len(known) else []:
        blob = b"".join(x.tobytes() for x in (ids[part], chk[part], start[part], count[part]))
        out.append((int(grp[part[0]]), 1, len(part), blob))
    return out


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), types)], names)


_SENT = (("grp", "kind", "n", "blob"), (pa.int32(), pa.int32(), pa.int32(), pa.binary()))


def _flushes(batches, window: int, prefix: int, heavy: np.ndarray | None = None):
    """The suffixes of FLUSH bytes of text at a time."""
    held, size = [], 0
    for part in _text.chunks(batches):
        ids, chk = (np.asarray(part.column(c)) for c in ("id", "chk"))
        got = _suffixes(ids, chk, part.column("text"), window, prefix, heavy)
        if got is not None:
            held.append(got)
            size += part.column("text").nbytes
            if size > FLUSH:
                yield [np.concatenate(x) for x in zip(*held)]
                held, size = [], 0
    if held:
        yield [np.concatenate(x) for x in zip(*held)]


def _map(window: int, prefix: int, groups: int, heavy: np.ndarray | None):
    def run(batches):
        for suffixes in _flushes(batches, window, prefix, heavy):
            rows = _packed(groups, *suffixes)
            for at in range(0, len(rows), 64):
                yield _batch(rows[at : at + 64], *_SENT)

    return run


#: Buckets of one row of counts.
_SLICE = 1 << 16


def _counting(window: int, prefix: int, buckets: int):
    """Rows (slice, blob): the buckets of a slice and their numbers of different suffixes, as two arrays of int64."""

    def run(batches):
        total = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for suffixes in _flushes(batches, window, prefix):
            key, n = np.unique(_bucket(suffixes[0][_folded(*suffixes)[0]], buckets), return_counts=True)
            total = _summed([total, (key, n)])
        edge = np.searchsorted(total[0], np.arange(0, buckets + _SLICE, _SLICE))
        rows = [(k, np.concatenate([x[a:b] for x in total]).tobytes()) for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])) if a < b]
        for at in range(0, len(rows), 64):
            yield _batch(rows[at : at + 64], ("slice", "blob"), (pa.int32(), pa.binary()))

    return run


def _summed(parts) -> tuple[np.ndarray, np.ndarray]:
    key, n = (np.concatenate(x) for x in zip(*parts))
    key, place = np.unique(key, return_inverse=True)
    return key, np.bincount(place, weights=n, minlength=len(key)).astype(np.int64)


def _over(cap: int):
    """Rows (bucket) of slices' buckets with more than cap."""

    def run(batches):
        held: dict[int, tuple] = {}
        for batch in batches:
            for k, blob in zip(batch.column("slice").to_pylist(), batch.column("blob").to_pylist()):
                x = np.frombuffer(blob, np.int64)
                part = x[: len(x) // 2], x[len(x) // 2 :]
                held[k] = _summed([held[k], part]) if k in held else part
        for key, n in held.values():
            yield pa.RecordBatch.from_arrays([pa.array(key[n > cap])], ["bucket"])

    return run


def heavy_prefixes(docs: DataFrame, window: int, prefix: int) -> np.ndarray:
    """For each bucket of prefixes, whether these are lengthened.  What reaches the driver, and is broadcast, is a bit for each CAP / BUCKETS_EACH suffixes at most."""
    spark = docs.sparkSession
    # a word takes two bytes at least, and a window has a new suffix every few words
    buckets = max(LEAST_BUCKETS, 1 << int(np.ceil(np.log2(max(1, BUCKETS_EACH * _spark.input_bytes(docs) / 8 / CAP)))))
    counts = _spark.arrow_map(docs.select("id", "chk", "text"), _counting(window, prefix, buckets), "slice int, blob binary").repartition(_spark.parts(spark), "slice")
    heavy = np.zeros(buckets, bool)
    heavy[[r["bucket"] for r in _spark.arrow_map(counts, _over(CAP), "bucket long").toLocalIterator()]] = True
    return heavy


def _unpack(blob: bytes, n: int, kinds):
    at, out = 0, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out, at


def _runs(ids, chk, start, length):
    """Rows (id, chk, runs) of starts and lengths: touching runs of a text are joined; runs is int32 pairs."""
    order = np.lexsort((start, chk, ids))
    ids, chk, start, length = ids[order], chk[order], start[order], length[order]
    new = np.r_[True, (ids[1:] != ids[:-1]) | (chk[1:] != chk[:-1])]
    joined = np.flatnonzero(new | np.r_[True, start[1:] > start[:-1] + length[:-1]])
    stop = np.maximum.reduceat(start + length, joined)
    pairs = np.stack([start[joined], stop - start[joined]], 1).astype(np.int32)
    text = np.flatnonzero(new[joined])
    edge = np.r_[text, len(joined)]
    return [(int(ids[joined[a]]), int(chk[joined[a]]), pairs[a:b].tobytes()) for a, b in zip(edge[:-1], edge[1:])]


_REPLY = (("id", "chk", "runs"), (pa.int64(), pa.int64(), pa.binary()))


def _repeats(blobs):
    """Runs of starts whose windows repeat within one group of suffixes."""
    parts = [[], [], [], [], [], [], [], []]
    for n, blob in blobs:
        fields, at = _unpack(blob, n, (np.uint64, np.int64, np.int64, np.int32, np.uint16, np.uint8))
        total = int(fields[4].sum(dtype=np.int64))
        (low,), step = _unpack(blob[at:], total, (np.uint32,))
        (high,), _ = _unpack(blob[at + step :], total, (np.uint16,))
        for held, x in zip(parts, (*fields, low, high)):
            held.append(x)
    head, ids, chk, start, count, twice, low, high = map(np.concatenate, parts)
    order = np.argsort(head, kind="stable")
    new = np.r_[True, head[order[1:]] != head[order[:-1]]]
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    branch = np.zeros(len(head), bool)
    branch[order] = np.repeat(size > 1, size)  # a prefix that occurs once is a leaf; what was folded is known already
    own = np.flatnonzero(branch)
    if not len(own):
        return []
    edge = np.cumsum(count.astype(np.int64)) - count
    win = _ragged(edge[own], count[own])
    owner = np.repeat(own, count[own])
    node = _text.mix(head[owner]) ^ (low[win].astype(np.uint64) | (high[win].astype(np.uint64) << np.uint64(32)))
    order = np.argsort(node)
    new = np.r_[True, node[order[1:]] != node[order[:-1]]]
    size = np.diff(np.r_[np.flatnonzero(new), len(order)])
    deep = np.zeros(len(node), bool)
    deep[order] = np.repeat(size > 1, size)
    at = np.flatnonzero(deep)
    if not len(at):
        return []
    o = owner[at]
    return _runs(ids[o], chk[o], start[o].astype(np.int64) + win[at] - edge[o], np.ones(len(at), np.int64))


def _reduce(batches):
    held, now = [], None

    def out(rows):
        for at in range(0, len(rows), 2000):
            yield _batch(rows[at : at + 2000], *_REPLY)

    for batch in batches:
        for grp, kind, n, blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "kind", "n", "blob"))):
            if grp != now:
                if held:
                    yield from out(_repeats(held))
                held, now = [], grp
            if kind:
                (ids, chk, start, count), _ = _unpack(blob, n, (np.int64, np.int64, np.int32, np.uint16))
                yield from out(_runs(ids, chk, start.astype(np.int64), count.astype(np.int64)))
            else:
                held.append((n, blob))
    if held:
        yield from out(_repeats(held))


def repeats(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(id, chk, runs) of texts with repeated windows; docs: id long, chk long, text.  runs: arrays of int32 (first start, number of starts)."""
    if not 0 < window < 1 << 16:
        raise ValueError("a window has 1 to 65535 words")
    spark, prefix = docs.sparkSession, min(prefix, window)
    heavy = heavy_prefixes(docs, window, prefix)
    groups = max(GROUPS_EACH * _spark.parts(spark), _spark.input_bytes(docs) // GROUP_BYTES)
    sent = _spark.arrow_map(docs.select("id", "chk", "text"), _map(window, prefix, groups, heavy), "grp int, kind int, n int, blob binary")
    dealt = sent.repartition(max(_spark.parts(spark), groups // GROUPS_EACH), "grp").sortWithinPartitions("grp")
    found = _spark.arrow_map(dealt, _reduce, f"{_HEAD}, runs binary")
    return found.groupBy("id", "chk").agg(F.collect_list("runs").alias("runs"))


def _keyed(docs: DataFrame, *more) -> DataFrame:
    text = F.col("text").cast("string")
    number = F.col("doc_id").cast("long") if _spark.integer_ids(docs) else F.xxhash64(F.col("doc_id").cast("string"))  # with chk it only names a row
    return docs.select(F.coalesce(number, F.lit(-(1 << 63) + 1)).alias("id"), F.xxhash64(text).alias("chk"), text.alias("text"), *more)


def covered(runs, n_words: int, window: int = WINDOW) -> np.ndarray:
    """Mask of the words that repeated windows cover."""
    delta = np.zeros(n_words + 1, np.int32)
    pairs = np.frombuffer(b"".join(runs), np.int32).reshape(-1, 2)
    np.add.at(delta, pairs[:, 0], 1)
    np.add.at(delta, np.minimum(pairs[:, 0] + pairs[:, 1] - 1 + window, n_words), -1)
    return np.cumsum(delta[:-1]) > 0


def _joined(docs: DataFrame, window: int, *more) -> DataFrame:
    """The keyed rows of docs with the runs of their text."""
    found = repeats(_keyed(docs), window)
    return _keyed(docs, *more).join(found.hint("shuffle_hash"), ["id", "chk"], "left")


def measure(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every whole text."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                words = (text or "").encode().split()
                kept = words
                if runs:
                    kept = list(compress(words, (~covered(runs, len(words), window)).tolist()))
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            if rows:
                n, gone, sha = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    rows = _joined(docs, window, F.col("doc_id")).select("doc_id", "text", "runs")
    return _spark.arrow_map(rows, run, f"doc_id {_spark.id_type(docs)}, n_words long, n_removed long, kept_sha256 string")


def without(text: str, removed: np.ndarray) -> str:
    """The text without the removed words and the white space after them."""
    data = np.frombuffer(text.encode(), np.uint8)
    w = _text.Words(pa.array([text], pa.string()))
    edge = np.r_[w.start, len(data)]
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, edge[:-1][removed], 1)
    np.add.at(gone, edge[1:][removed], -1)
    return data[np.cumsum(gone[:-1]) == 0].tobytes().decode()


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs, all columns, with repeated passages taken out of text; n_chars, where there is one, follows."""
    columns = docs.columns
    others = [c for c in columns if c != "text"]

    def run(batches):
        for batch in batches:
            texts = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist()):
                if runs:
                    removed = covered(runs, len(text.encode().split()), window)
                    text = without(text, removed)
                texts.append(text)
            yield pa.RecordBatch.from_arrays([*(batch.column(f"c{k}") for k in range(len(others))), pa.array(texts, pa.string())], [*others, "text"])

    rows = _joined(docs, window, *(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)))
    schema = docs.select(*(f"`{c}`" for c in others), F.col("text").cast("string").alias("text")).schema
    out = _spark.arrow_map(rows, run, schema).select(*(f"`{c}`" for c in columns))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op5_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return measure(_spark.table(spark, sf_dir, "documents"))


#: Brute force by window text, for whole tables at small scale.
_W = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_W} AS w FROM documents),
g AS (SELECT r, i, sha256(array_to_string(list_slice(w, i, i + {WINDOW} - 1), ' ')) AS g
      FROM (SELECT r, w, unnest(range(1, len(w) - {WINDOW} + 2)) AS i FROM d WHERE len(w) >= {WINDOW})),
c AS (SELECT r, i, count(*) OVER (PARTITION BY g) AS n FROM g),
k AS (SELECT r, list(DISTINCT k) AS gone FROM (SELECT r, unnest(range(i, i + {WINDOW})) AS k FROM c WHERE n > 1) GROUP BY r),
x AS (SELECT r, j, w[j] AS word FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS j FROM d)),
y AS (SELECT x.r, count(*) AS n_kept, string_agg(word, ' ' ORDER BY x.j) AS kept
      FROM x LEFT JOIN (SELECT r, unnest(gone) AS j FROM k) z ON x.r = z.r AND x.j = z.j WHERE z.r IS NULL GROUP BY x.r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n_kept, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN y USING (r)
"""
