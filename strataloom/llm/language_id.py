"""Language ID by language-bitmask n-gram filters.

One bit-sliced Bloom filter serves all languages: each slot holds a bitmask
with one bit per language, so ANDing the slots of an n-gram gives all
languages whose training text contains it, which means: at least twice, and with at
least MIN_SHARE of that language's n-grams (a text in the wrong language, or a
foreign name, would otherwise make its n-grams part of every language, once there is enough text).
A text's predicted language has the largest popcount over its n-grams after the
expected false positives of that language's slice are taken off.

The filter is made by the executors: what reaches the driver are its slots, and one row a language.

Defined results: rows are judged one by one, so repeated rows are equal; a text of
any length is judged whole; null text, empty text or text without a letter gives `und`
with score 0; without any labelled text every prediction is `und`; equal
counts go to the language with more training n-grams, then by name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

#: Bytes in an n-gram.
GRAM = 4
#: An n-gram enters a language's slice from this share of that language's n-grams
#: (so a slice holds 1 / MIN_SHARE n-grams at most, whatever the corpus).
MIN_SHARE = 5e-6
#: Slots of the filter and hashes per n-gram.
SLOT_BITS, HASHES = 20, 2

_FOLD = _text.LOWER.copy()
_FOLD[:0x41] = 0x20
_FOLD[0x5B:0x61] = 0x20
_FOLD[0x7B:0x80] = 0x20


@dataclass
class Filter:
    """languages, largest first; slots: (words of 64 languages, slots); false_rate: by language."""

    languages: list[str]
    slots: np.ndarray
    false_rate: np.ndarray


def _grams(column) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Packed n-grams of folded bytes, their rows, and the raw buffers."""
    data, offs = _text.buffers(column)
    n = len(data) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64), data, offs
    folded = _FOLD[data].astype(np.uint32)
    gram = np.zeros(n, np.uint32)
    for j in range(GRAM):
        gram |= folded[j : j + n] << np.uint32(8 * j)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    ok = (row[GRAM - 1 :] == row[:n]) & (gram != np.uint32(0x20202020))
    return gram[ok], row[:n][ok], data, offs


def _counted(batches):
    """(lang, gram, n) of a partition."""
    names: dict[str, int] = {}
    held, size = [], 0

    def merged():
        keys, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(keys, kind="stable")
        keys, n = keys[order], n[order]
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        return keys[first], np.add.reduceat(n, first)

    for part in _text.chunks(batches):
        gram, row, _, _ = _grams(part.column("text"))
        if not len(gram):
            continue
        codes = np.array([names.setdefault(x, len(names)) for x in part.column("lang").to_pylist()], np.uint64)
        keys, n = np.unique((codes[row] << np.uint64(32)) | gram, return_counts=True)
        held.append((keys, n))
        size += len(keys)
        if size > 3_000_000:
            held = [merged()]
            size = len(held[0][0]) // 2
    if held:
        keys, n = merged()
        lang = pa.DictionaryArray.from_arrays(pa.array((keys >> np.uint64(32)).astype(np.int32)), pa.array(list(names))).cast(pa.string())
        for at in range(0, len(keys), 100_000):
            part = slice(at, at + 100_000)
            yield pa.RecordBatch.from_arrays([lang[part], pa.array((keys[part] & np.uint64(0xFFFFFFFF)).astype(np.int64)), pa.array(n[part].astype(np.int64))], ["lang", "gram", "n"])


def train(labelled: DataFrame, min_share: float = MIN_SHARE, slot_bits: int = SLOT_BITS, hashes: int = HASHES) -> Filter:
    """The filter of all rows (text, lang) with a non-null lang."""
    spark = labelled.sparkSession
    rows = labelled.select("text", F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    counts = _spark.written(_spark.arrow_map(rows, _counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "language-grams")
    totals = sorted(((r["lang"], r["n"]) for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()), key=lambda x: (-x[1], x[0]))
    languages = [x for x, _ in totals]
    slots = np.zeros((max(1, -(-len(languages) // 64)), 1 << slot_bits), np.uint64)
    if languages:
        # a row a language
        index = spark.createDataFrame([(x, k, float(max(2, min_share * n))) for k, (x, n) in enumerate(totals)], "lang string, k int, least double")
        kept = counts.join(F.broadcast(index), "lang").where("n >= least").select("k", "gram")
        masks = _spark.arrow_map(kept, lambda b: _masks(b, slot_bits, hashes), "word int, slot int, mask long").groupBy("word", "slot").agg(F.bit_or("mask").alias("mask")).toPandas()
        slots[masks["word"].to_numpy(), masks["slot"].to_numpy()] = masks["mask"].to_numpy(np.int64).view(np.uint64)
    _spark.drop_written(counts)
    fill = [float(((slots[k // 64] >> np.uint64(k % 64)) & np.uint64(1)).mean()) for k in range(len(languages))]
    return Filter(languages, slots, np.array(fill) ** hashes)


def _masks(batches, slot_bits: int, hashes: int):
    """(word, slot, mask): language bits of the slots of n-grams; rows (k, gram)."""
    for batch in batches:
        k = np.asarray(batch.column("k"), np.int64)
        mask = (np.uint64(1) << (k % 64).astype(np.uint64)).view(np.int64)
        for at in _positions(np.asarray(batch.column("gram"), np.int64).astype(np.uint64), slot_bits, hashes):
            yield pa.RecordBatch.from_arrays([pa.array(k // 64, pa.int32()), pa.array(at, pa.int32()), pa.array(mask)], ["word", "slot", "mask"])


def _positions(gram: np.ndarray, slot_bits: int, hashes: int):
    h = _text.mix(gram.astype(np.uint64) + np.uint64(0x51ED270B9F652295))
    return [((h >> np.uint64(64 - slot_bits * (j + 1))) & np.uint64((1 << slot_bits) - 1)).astype(np.int64) for j in range(hashes)]


def _has_letter(column, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    low = data | 0x20
    found = _text.row_sums((low >= 0x61) & (low <= 0x7A), offs) > 0
    for i in np.flatnonzero(~found & (_text.row_sums(data >= 0x80, offs) > 0)):
        found[i] = any(c.isalpha() for c in column[int(i)].as_py() or "")
    return found


def score_chunk(column, model: Filter) -> tuple[list[str], np.ndarray]:
    """Predicted languages and scores of one chunk of texts."""
    gram, row, data, offs = _grams(column)
    rows, languages = len(offs) - 1, model.languages
    letter = _has_letter(column, data, offs)
    if not languages:
        return ["und"] * rows, np.zeros(rows)
    bits = model.slots.shape[1].bit_length() - 1
    hashes = _positions(gram, bits, HASHES)
    total = np.bincount(row, minlength=rows).astype(float)
    found = np.zeros((len(languages), rows))
    for w, plane in enumerate(model.slots):
        mask = plane[hashes[0]]
        for at in hashes[1:]:
            mask &= plane[at]
        for k in range(w * 64, min(len(languages), w * 64 + 64)):
            hit = (mask >> np.uint64(k % 64)) & np.uint64(1)
            found[k] = np.bincount(row, weights=hit, minlength=rows)
    rate = model.false_rate[:, None]
    found = np.maximum(found - rate * total, 0) / np.maximum(1 - rate, 1e-9)
    best = found.argmax(0)
    score = np.where(letter & (total > 0), found[best, np.arange(rows)] / np.maximum(total, 1), 0.0)
    return [languages[b] if ok else "und" for b, ok in zip(best, letter)], np.clip(score, 0, 1)


def predict(docs: DataFrame, model: Filter, key: str = "doc_id") -> DataFrame:
    """(key, lang_pred, score) of every whole text.  The broadcast filter has a fixed size."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for part in _text.chunks(batches):
            lang, score = score_chunk(part.column("text"), held.value)
            yield pa.RecordBatch.from_arrays([part.column(key), pa.array(lang, pa.string()), pa.array(score)], [key, "lang_pred", "score"])

    return _spark.arrow_map(docs.select(key, F.col("text").cast("string").alias("text")), run, f"{key} {_spark.id_type(docs, key)}, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = _spark.table(spark, sf_dir, "documents")
    fold = _spark.fold_of(F.col("doc_id"), 5)
    out = predict(docs, train(docs.where(fold != 0)))
    return out.select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")


#: Stage of the pipeline: texts whose best language covers less of their n-grams than this go.
ACCEPT = 0.25


def accept_languages(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """The rows of docs whose text has a recognised language; `lang` itself is left as it is.

    Fitted on the rows' own labels (fold 0 held out).  Each row is judged by its
    own text, so equal rows share their verdict and the count of rows stays exact.
    """
    held = docs.sparkSession.sparkContext.broadcast(train(docs.where(_spark.fold_of(F.col("doc_id"), 5) != 0)))

    def run(batches):
        for part in _text.chunks(batches):
            lang, score = score_chunk(part.column("text"), held.value)
            keep = (np.array(lang) != "und") & (score >= accept)
            yield part.filter(pa.array(keep))

    return _spark.arrow_map(docs, run, docs.schema)
