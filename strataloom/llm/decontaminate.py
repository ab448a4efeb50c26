"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the 13-word windows of the benchmark items (an item of fewer words
is one shorter pattern).  Patterns of one length share a block shift table: the
last two words under the search position give the number of positions that
cannot end an occurrence and are skipped; where the shift is 0, the suffix hash
selects a bucket of test strings, and direct comparison of all the words, byte by
byte, confirms occurrences.  Many text segments are searched in step (one numpy lane
each), so skipping stays vectorised; segments keep very long texts balanced.

The benchmark goes out in blocks of at most BLOCK_WORDS words or one item, one pass over the documents for
each; what a pass found travels with its row, written to the shared folder.  So the
driver, a broadcast and a worker hold one block at a time.

Defined results: null or word-less text has no hit; items without words and
items with a null id have no pattern; repeated items with one id count once;
an empty benchmark leaves every document clean.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _spark, _text

WINDOW = 13
#: Share of hit words from which a document is contaminated.
PER_WORDS = 20
_LANE = 256
_SLOTS = 16
#: Words of benchmark text in one broadcast block of patterns; a larger benchmark goes in several passes.
BLOCK_WORDS = 2_000_000


class BlockWords:
    """Fingerprints and bytes of the words of a block of items."""

    def __init__(self, w: _text.Words):
        small = np.int32 if len(w.data) < 1 << 31 else np.int64
        self.hash, self.data, self.start, self.size = w.hash, w.data, w.start.astype(small), (w.end - w.start).astype(small)


class Patterns:
    """Tables of the patterns of one length.

    The words of a block of items are kept once, and a pattern is the place of its first word among them;
    patterns lie in the order of their suffix hashes, so a bucket is a range of them.  Equal windows are one pattern.
    """

    def __init__(self, text: BlockWords, length: int, place: np.ndarray, owner: np.ndarray):
        """place: the first words of the windows, in the items `owner`."""
        self.text, self.length, self.block = text, length, min(2, length)
        h, m = text.hash, length
        suffix = self._key_at(h, place + m - 1)
        order = np.lexsort((owner, _text.window_hash(h, m)[place], suffix))
        place, owner, suffix = place[order], owner[order], suffix[order]
        same = np.ones(len(place) - 1, bool)
        for j in range(m):  # neighbours of one fingerprint, told apart by their words
            same &= h[place[1:] + j] == h[place[:-1] + j]
        new = np.r_[True, ~same]
        once = new | np.r_[True, owner[1:] != owner[:-1]]
        self.place = place[new].astype(text.start.dtype)
        self.owners = owner[once].astype(np.int32)
        self.owner_at = np.r_[np.flatnonzero(new[once]), once.sum()].astype(text.start.dtype)
        self.bucket_at = np.searchsorted(suffix[new], np.arange((1 << _SLOTS) + 1)).astype(np.int32)
        self.shift = np.full(1 << _SLOTS, m - self.block + 1, np.int32)
        for q in range(self.block, m + 1):
            np.minimum.at(self.shift, self._key_at(h, place + q - 1), m - q)

    @staticmethod
    def _key(last: np.ndarray, before: np.ndarray | None) -> np.ndarray:
        h = last if before is None else last + before * np.uint64(0x9E3779B97F4A7C15)
        return (_text.mix(h) >> np.uint64(64 - _SLOTS)).astype(np.int64)

    def _key_at(self, h: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._key(h[at], h[at - 1] if self.block == 2 else None)

    def search(self, w: _text.Words) -> tuple[np.ndarray, np.ndarray]:
        """Occurrences in the texts of w: (start, pattern)."""
        m, h, first, count = self.length, w.hash, w.first, w.count
        lanes = np.maximum(count - m + 1 + _LANE - 1, 0) // _LANE
        text = np.repeat(np.arange(len(first)), lanes)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        at = first[text] + m - 1 + nth * _LANE
        stop = np.minimum(at + _LANE, (first + count)[text])
        found = []
        while len(at):
            step = self.shift[self._key_at(h, at)]
            if not step.all():
                found.append(at[step == 0])
            at = at + np.maximum(step, 1)
            going = at < stop
            at, stop = at[going], stop[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        key = self._key_at(h, at)
        n = self.bucket_at[key + 1] - self.bucket_at[key]
        pos = np.repeat(at - m + 1, n)
        which = np.repeat(self.bucket_at[key], n) + np.arange(len(pos)) - np.repeat(np.cumsum(n) - n, n)
        for j in range(m):  # fingerprints first, so that few are left for the bytes
            same = h[pos + j] == self.text.hash[self.place[which] + j]
            pos, which = pos[same], which[same]
        for j in range(m):
            same = self._same_bytes(w, pos + j, which, j)
            pos, which = pos[same], which[same]
        return pos, which

    def _same_bytes(self, w: _text.Words, word: np.ndarray, which: np.ndarray, j: int) -> np.ndarray:
        """Whether words of w are, byte by byte, the j-th words of patterns."""
        own = self.place[which] + j
        size = self.text.size[own].astype(np.int64)
        same = (w.end - w.start)[word] == size
        size = np.where(same, size, 0)
        stop = np.cumsum(size)
        inside = np.arange(int(stop[-1]) if len(stop) else 0) - np.repeat(stop - size, size)
        differ = w.data[np.repeat(w.start[word], size) + inside] != self.text.data[np.repeat(self.text.start[own].astype(np.int64), size) + inside]
        return same & (_text.row_sums(differ, np.r_[0, stop]) == 0)


def patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> tuple[list[str], list[Patterns]]:
    """Names of the items and the tables of their patterns by length."""
    names = sorted({i for i, _ in items})
    number = {x: k for k, x in enumerate(names)}
    w = _text.Words(pa.array([t for _, t in items], pa.string()), _text.NON_ALNUM, _text.LOWER)
    text = BlockWords(w)
    numbers = np.array([number[i] for i, _ in items], np.int64)
    length = np.minimum(window, w.count)
    out = []
    for m in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == m)
        n = w.count[own] - m + 1
        place = np.repeat(w.first[own], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out.append(Patterns(text, m, place, np.repeat(numbers[own], n)))
    return names, out


def _blocks(benchmark: DataFrame, window: int):
    """(patterns, whether more follow) of the benchmark in blocks, each made when it is asked for."""
    held, size = [], 0
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).where("item_id is not null")
    for r in rows.toLocalIterator():
        more = len(r["text"] or "") // 2
        if held and size + more > BLOCK_WORDS:
            yield patterns(held, window), True
            held, size = [], 0
        held.append((r["item"], r["text"]))
        size += more
    yield patterns(held, window), False


def scan_chunk(column, block, spans=None, items=None) -> tuple[np.ndarray, list[bytes], list[set[str]]]:
    """Words, spans of hit words (int32 starts and lengths) and items of each text, with those of earlier blocks; block: patterns()."""
    w = _text.Words(column, _text.NON_ALNUM, _text.LOWER)
    rows = w.rows()
    spans = [x or b"" for x in spans] if spans is not None else [b""] * rows
    items = [set(x or ()) for x in items] if items is not None else [set() for _ in range(rows)]
    names, tables = block
    for p in tables:
        start, which = p.search(w)
        if not len(start):
            continue
        row = w.row[start]
        for r, pattern in np.unique(np.stack([row, which], 1), axis=0):
            items[r].update(names[i] for i in p.owners[p.owner_at[pattern] : p.owner_at[pattern + 1]])
        order = np.lexsort((start, row))
        start, row = start[order], row[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + p.length)]
        first = np.flatnonzero(new)
        last = np.r_[first[1:], len(start)] - 1
        pairs = np.stack([start[first] - w.first[row[first]], start[last] - start[first] + p.length], 1).astype(np.int32)
        for k, r in zip(range(len(first)), row[first].tolist()):
            spans[r] += pairs[k].tobytes()
    return w.count, spans, items


def hit_words(spans: bytes) -> int:
    """Words in any of the spans."""
    pairs = np.frombuffer(spans, np.int32).reshape(-1, 2).astype(np.int64)
    if len(pairs) < 2:
        return int(pairs[:, 1].sum())
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    reach = np.maximum.accumulate(pairs.sum(1))
    return int((reach - np.maximum(pairs[:, 0], np.r_[0, reach[:-1]])).clip(0).sum())


def _scanned(docs: DataFrame, benchmark: DataFrame, window: int, schema, finish) -> DataFrame:
    """docs (c0, c1, .., text) with what finish(batch, words, spans, items) makes of each batch, after all blocks."""
    spark = docs.sparkSession
    carried = T.StructType([*docs.schema.fields, T.StructField("_spans", T.BinaryType()), T.StructField("_items", T.ArrayType(T.StringType()))])
    before = None
    for block, more in _blocks(benchmark, window):
        held = spark.sparkContext.broadcast(block)
        del block

        def run(batches, held=held, more=more):
            for part in _text.chunks(batches):
                old = [part.column(c).to_pylist() if c in part.schema.names else None for c in ("_spans", "_items")]
                n, spans, items = scan_chunk(part.column("text"), held.value, *old)
                if not more:
                    yield finish(part, n, spans, items)
                    continue
                own = [c for c in part.schema.names if c not in ("_spans", "_items")]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in own), pa.array(spans, pa.binary()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], [*own, "_spans", "_items"])

        if not more:
            return _spark.arrow_map(docs, run, schema)
        docs = _spark.written(_spark.arrow_map(docs, run, carried), "scanned")
        held.destroy()
        if before is not None:
            _spark.drop_written(before)
        before = docs


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, n_words, n_hit, items) of every whole text; items: sorted array of item ids as strings."""

    def finish(part, n, spans, items):
        hit = [hit_words(x) for x in spans]
        return pa.RecordBatch.from_arrays([part.column("c0"), pa.array(n, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    rows = docs.select(F.col("doc_id").alias("c0"), F.col("text").cast("string").alias("text"))
    return _scanned(rows, benchmark, window, f"doc_id {_spark.id_type(docs)}, n_words long, n_hit long, items array<string>", finish)


def verdict():
    return (F.col("n_hit") > 0) & (F.col("n_hit") * PER_WORDS >= F.col("n_words"))


def op4_decontamination(spark, sf_dir: str) -> DataFrame:
    found = scan(_spark.table(spark, sf_dir, "documents"), _spark.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), verdict().alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs that are not contaminated, with all their columns."""
    others = [c for c in docs.columns if c != "text"]

    def finish(part, n, spans, items):
        hit = np.array([hit_words(x) for x in spans], np.int64)
        kept = pa.array((hit == 0) | (hit * PER_WORDS < n))
        return pa.RecordBatch.from_arrays([*(part.column(f"c{k}") for k in range(len(others))), part.column("text")], [*others, "text"]).filter(kept)

    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)), F.col("text").cast("string").alias("text"))
    schema = docs.select(*(f"`{c}`" for c in others), F.col("text").cast("string").alias("text")).schema
    return _scanned(rows, benchmark, WINDOW, schema, finish).select(*(f"`{c}`" for c in docs.columns))


_TOKENS = "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
ORACLE_SQL = f"""
WITH item AS (SELECT CAST(item_id AS VARCHAR) AS item, {_TOKENS} AS w FROM benchmark WHERE item_id IS NOT NULL),
pat AS (SELECT DISTINCT item, least({WINDOW}, len(w)) AS m, list_slice(w, i, i + least({WINDOW}, len(w)) - 1) AS p
        FROM (SELECT item, w, unnest(range(1, len(w) - least({WINDOW}, len(w)) + 2)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, {_TOKENS} AS w FROM documents),
win AS (SELECT doc_id, m, i, list_slice(w, i, i + m - 1) AS p
        FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM pat) WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, win.m, item FROM win JOIN pat ON win.m = pat.m AND win.p = pat.p),
cov AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS s FROM hit GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND {PER_WORDS} * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM doc LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)
"""


def items_digest(items) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
