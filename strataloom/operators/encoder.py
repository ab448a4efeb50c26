"""A text encoder that is fitted to texts: term weights, and a truncated SVD of the weighted terms of all texts.

Terms are lower-case words.  A text is a sparse row: the `size` terms of most texts have a column each, all others
share `shared` columns by hash, so no word is left out.  An entry is (1 + ln of the term's count in the text) x
(1 + ln((1 + texts) / (1 + texts with the term))); a shared column takes the latter from its most frequent term; rows have unit length.

The right singular vectors come from a randomised range finder with power iterations.  One pass over the stored rows
multiplies their Gram matrix by a matrix of (columns x (rank + extra)) numbers: each task folds its rows into one such
matrix, and sums of at most FAN matrices a group add them up.  A task has at least as many entries as its matrix has
numbers, so no more is shuffled than the rows have.  The matrix's size is set by the parameters, not by the
texts, so the driver may hold it, make its columns orthogonal, and send it out again.

Defined results: a null text, and one without words, has a zero vector; an empty table gives zero vectors; equal
texts have equal vectors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .workers import drop, ship, stored

#: Entries of sparse rows that are multiplied at once, columns of a block of a matrix, and matrices that a group adds up.
ENTRIES, BLOCK, FAN = 32_768, 1024, 32


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def term_weights(texts: DataFrame) -> DataFrame:
    """(term, n, idf): the texts that hold each term; texts: (id, text)."""
    found = texts.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    all_ = texts.agg(F.count(F.lit(1)).alias("_all"))  # one row
    return found.crossJoin(F.broadcast(all_)).select("term", "n", (F.log((1 + F.col("_all")) / (1 + F.col("n"))) + 1).alias("idf"))


@dataclass(frozen=True)
class Encoder:
    """keys: ascending hashes of the terms with a column; idf: of all columns, the shared ones last; axes: (columns, rank)."""

    keys: np.ndarray
    idf: np.ndarray
    axes: np.ndarray

    def __call__(self, texts: DataFrame) -> DataFrame:
        """(id, embedding) of (id, text)."""
        spark = texts.sparkSession
        ship(spark)
        kind = texts.schema["id"].dataType.simpleString()
        held = spark.sparkContext.broadcast((self.keys, self.idf, self.axes))

        def run(batches):
            keys, idf, axes = held.value
            for batch in batches:
                row, at, w = _entries(batch.column("keys"), keys, idf)
                out = np.round(_project(row, at, w, axes, batch.num_rows), 9) + 0.0
                flat = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1) * axes.shape[1], pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("id"), flat], ["id", "embedding"])

        return _hashed_words(texts, "id").mapInArrow(run, f"id {kind}, embedding array<double>")

    def save(self, spark: SparkSession, path: str) -> None:
        """Writes the encoder as a Parquet table with a row a column."""
        n = len(self.idf)
        key = pa.array([*map(int, self.keys), *([None] * (n - len(self.keys)))], pa.int64())
        rows = pa.table({"at": np.arange(n), "key": key, "idf": self.idf, "axes": pa.array(list(self.axes), pa.list_(pa.float64()))})
        spark.createDataFrame(rows).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Encoder:
        rows = spark.read.parquet(path).orderBy("at").toArrow()
        keys = rows["key"].drop_null().to_numpy()
        axes = rows["axes"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
        return Encoder(keys, rows["idf"].to_numpy(), axes)


def _hashed_words(texts: DataFrame, *keep: str) -> DataFrame:
    return texts.select(*keep, F.transform(words(F.col("text")), lambda w: F.xxhash64(w)).alias("keys"))


def _entries(column, keys: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, weight) of unit rows, ordered by row and column, from lists of hashes."""
    sizes = np.asarray(pc.list_value_length(column), np.int64)
    found = np.asarray(column.flatten(), np.int64)
    shared = len(idf) - len(keys)
    at = np.searchsorted(keys, found)
    known = at < len(keys)
    known[known] = keys[at[known]] == found[known]
    at = np.where(known, at, len(keys) + found % shared)
    both, count = np.unique(np.repeat(np.arange(len(sizes)), sizes) * len(idf) + at, return_counts=True)
    row, at = np.divmod(both, len(idf))
    w = (1 + np.log(count)) * idf[at]
    length = np.sqrt(np.bincount(row, w * w, len(sizes)))
    return row, at, w / length[row]


def _project(row: np.ndarray, at: np.ndarray, w: np.ndarray, axes: np.ndarray, rows: int) -> np.ndarray:
    """The sparse rows times axes; a long row is summed in parts."""
    out = np.zeros((rows, axes.shape[1]))
    for lo in range(0, len(row), ENTRIES):
        part = slice(lo, lo + ENTRIES)
        first = np.flatnonzero(np.r_[True, np.diff(row[part]) > 0])
        out[row[part][first]] += np.add.reduceat(axes[at[part]] * w[part, None], first)
    return out


def _gram(rows: DataFrame, basis: np.ndarray) -> np.ndarray:
    """The Gram matrix of the stored sparse rows (at, w) times basis."""
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(basis)
    columns, wide = basis.shape
    entries = rows.agg(F.coalesce(F.sum(F.size("at")), F.lit(0)).alias("n")).first()["n"]  # from the stored lists
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, entries // (columns * wide)))

    def fold(batches):
        from pyspark import TaskContext

        axes, sums = held.value, np.zeros((columns, wide))
        for batch in batches:
            sizes = np.asarray(pc.list_value_length(batch.column("at")), np.int64)
            row = np.repeat(np.arange(len(sizes)), sizes)
            at, w = np.asarray(batch.column("at").flatten(), np.int64), np.asarray(batch.column("w").flatten(), np.float64)
            got = _project(row, at, w, axes, len(sizes))
            for lo in range(0, len(at), ENTRIES):
                part = slice(lo, lo + ENTRIES)
                order = np.argsort(at[part], kind="stable")
                own = at[part][order]
                first = np.flatnonzero(np.r_[True, np.diff(own) > 0])
                sums[own[first]] += np.add.reduceat((got[row[part]] * w[part, None])[order], first)
        task = TaskContext.get().partitionId()
        for lo in range(0, columns, BLOCK):
            block = sums[lo : lo + BLOCK]
            if block.any():
                yield pa.RecordBatch.from_pydict({"block": pa.array([lo // BLOCK], pa.int32()), "part": pa.array([task // FAN], pa.int32()), "sums": [block.tobytes()]})

    def add(table):
        total = np.zeros(len(table["sums"][0].as_py()) // 8)
        order = np.argsort(np.asarray(table["sums"].combine_chunks().cast(pa.large_binary())), kind="stable")  # the same sum whatever the order of arrival
        for k in order.tolist():
            total += np.frombuffer(table["sums"][k].as_py())
        return pa.table({"block": table["block"][:1], "part": pa.array([table["part"][0].as_py() // FAN], pa.int32()), "sums": [total.tobytes()]})

    schema, left = "block int, part int, sums binary", -(-parts // FAN)
    got = rows.coalesce(parts).mapInArrow(fold, schema)
    while parts > 1:
        got = got.groupBy("block", "part").applyInArrow(add, schema)
        if left == 1:
            break
        left = -(-left // FAN)
    out = np.zeros((columns, wide))
    for block, sums in zip(*(c.to_pylist() for c in got.select("block", "sums").toArrow().columns)):
        out[block * BLOCK : (block + 1) * BLOCK] = np.frombuffer(sums).reshape(-1, wide)
    held.destroy()
    return out


def fit(texts: DataFrame, rank: int = 64, size: int = 65_536, shared: int = 4_096, extra: int = 8, passes: int = 5, seed: int = 42) -> Encoder:
    """Fits an encoder to all texts (id, text), which it passes `passes` times after counting their terms."""
    spark = texts.sparkSession
    ship(spark)
    terms = stored(term_weights(texts).select(F.xxhash64("term").alias("key"), "n", "idf"))
    own = terms.orderBy(F.desc("n"), "key").limit(size)
    top = own.select("key", "idf").toArrow()  # at most `size` rows
    order = np.argsort(top["key"].to_numpy(), kind="stable")
    keys, new = np.unique(top["key"].to_numpy()[order], return_index=True)
    rest = terms.join(own.select("key"), "key", "left_anti").groupBy(F.pmod("key", F.lit(shared)).cast("int").alias("at")).agg(F.min("idf").alias("idf")).toArrow()  # at most `shared` rows
    idf = np.ones(len(keys) + shared)
    idf[: len(keys)] = top["idf"].to_numpy()[order][new]
    idf[len(keys) + rest["at"].to_numpy()] = rest["idf"].to_numpy()
    drop(terms)
    held = spark.sparkContext.broadcast((keys, idf))

    def sparse(batches):
        for batch in batches:
            row, at, w = _entries(batch.column("keys"), *held.value)
            ends = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)), pa.int32())
            lists = [pa.ListArray.from_arrays(ends, pa.array(v, t)) for v, t in ((at, pa.int32()), (w, pa.float64()))]
            yield pa.RecordBatch.from_arrays(lists, ["at", "w"])

    rows = stored(_hashed_words(texts).mapInArrow(sparse, "at array<int>, w array<double>"))
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((len(idf), min(rank + extra, len(idf)))))[0]
    for _ in range(passes - 1):
        basis = np.linalg.qr(_gram(rows, basis))[0]
    small = basis.T @ _gram(rows, basis)
    drop(rows)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    best = np.argsort(-values, kind="stable")[:rank]
    axes = basis @ turn[:, best]
    axes = axes * np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    return Encoder(keys, idf, np.where(values[best] > 1e-12, axes, 0.0))
