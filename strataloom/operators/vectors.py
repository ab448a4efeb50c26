"""Vectors: normalisation, pooling, exact inner-product search."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workers import ship, stored

#: Queries of a block, vectors of a piece, vectors that are compared at once, and cells for each shuffle partition.
QUERY_BLOCK, PIECE, STEP, CELLS = 4096, 50_000, 256, 2  # every vector is shuffled once for each block


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def _once(value: Column, then) -> Column:
    """then(value), with the value made once a row, however often `then` names it in its lambdas."""
    return F.get(F.transform(F.array(value), then), 0)


def unit(v: Column) -> Column:
    """Unit-length vector in double; a zero vector stays as it is."""
    scaled = lambda v, n: F.transform(v, lambda x: F.when(n > 0, x.cast("double") / F.when(n > 0, n)).otherwise(x.cast("double")))
    return _once(v, lambda v: _once(norm(v), lambda n: scaled(v, n)))


def inner(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def mean_pool(tokens: Column, mask: Column, size: int) -> Column:
    """Mean of the token vectors whose mask is set; the count is at least 1e-9."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] == 1)
    count = F.greatest(F.size(kept).cast("double"), F.lit(1e-9))
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.aggregate(kept, F.lit(0.0), lambda s, x: s + F.get(x["v"], i).cast("double")) / count)


def mean_by(rows: DataFrame, by: str, vector: str, mask: Column, size: int) -> DataFrame:
    """(by, mean): mean of the vectors of each key whose mask is true, position by position, so that no task holds a key's vectors; the count is at least 1e-9."""
    kept = F.coalesce(mask, F.lit(False)) & F.col(vector).isNotNull()
    sums = [F.sum(F.when(kept, F.get(F.col(vector), k).cast("double")).otherwise(0.0)).alias(f"_s{k}") for k in range(size)]
    got = rows.groupBy(by).agg(F.sum(kept.cast("long")).alias("_n"), *sums)
    count = F.greatest(F.col("_n").cast("double"), F.lit(1e-9))
    return got.select(by, F.array(*(F.col(f"_s{k}") / count for k in range(size))).alias("mean"))


def knn(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool = True, after: DataFrame | None = None) -> DataFrame:
    """(query_id, ref_id, score, rank): the k largest cosine similarities of each query, ties by ref_id.

    queries, vectors: (id, embedding), ids of numbers or text.  Equal vectors are compared once, under their smallest id: of
    each the k smallest ids (one more to leave a query itself out) can be among the k best, and no vector behind the k first by score and smallest id.
    after: (query_id, score, ref_id), rows of a former call: the k next ones behind them, of those queries; then each vector is compared.
    """
    if after is not None:
        return _compared(queries, vectors, k, exclude_self, after)
    kind, asked = (_id_kind(d) for d in (vectors, queries))
    exclude_self = exclude_self and kind == asked
    most = k + exclude_self
    known, own = _distinct(vectors, kind, most), _distinct(queries, asked)
    one = lambda d: d.where("nth = 1").select("id", "embedding")
    near = _compared(one(own), one(known), most, False).drop("rank")
    members = known.select(F.col("name").alias("ref_id"), F.col("id").alias("_member"))
    near = near.join(members, "ref_id").select("query_id", F.col("_member").alias("ref_id"), "score")
    near = top(near, "query_id", [F.desc("score"), F.asc("ref_id")], most).drop("rank")
    near = near.join(own.select(F.col("name").alias("query_id"), F.col("id").alias("_asked")), "query_id").select(F.col("_asked").alias("query_id"), "ref_id", "score")
    near = near.where("query_id <> ref_id") if exclude_self else near
    return top(near, "query_id", [F.desc("score"), F.asc("ref_id")], k)


def _id_kind(d: DataFrame) -> str:
    return "long" if d.schema["id"].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint") else "string"


def _distinct(vectors: DataFrame, kind: str, most: int | None = None) -> DataFrame:
    """(name, id, nth, embedding): the smallest ids of each different vector, at most `most`, under the smallest one, which alone has the embedding."""
    by = Window.partitionBy("embedding").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = vectors.select(F.col("id").cast(kind).alias("id"), "embedding")
    rows = rows.withColumns({"nth": F.row_number().over(by), "name": F.first("id").over(by)})
    rows = rows if most is None else rows.where(F.col("nth") <= most)
    rows = rows.select("name", "id", "nth", F.when(F.col("nth") == 1, F.col("embedding")).alias("embedding"), F.col("embedding").isNotNull().alias("some"))
    return stored(rows).where("some").drop("some")  # a condition on the embedding itself would make it twice


def _compared(queries: DataFrame, vectors: DataFrame, k: int, exclude_self: bool, after: DataFrame | None = None) -> DataFrame:
    """knn() of each vector by itself.

    Queries are dealt to blocks of some QUERY_BLOCK, vectors to pieces of at most PIECE; one shuffle brings each block to each
    piece, and each cell of that grid keeps its own k best of a query, so what is shuffled then is k rows a query and piece.
    """
    spark = queries.sparkSession
    ship(spark)
    kind, asked = (_id_kind(d) for d in (vectors, queries))
    exclude_self = exclude_self and kind == asked
    schema = f"query_id {asked}, ref_id {kind}, score double"
    types = pa.schema([(c, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[t]) for c, t in (x.split() for x in schema.split(", "))])
    plain = lambda x: x.astype(str) if x.dtype == object else x

    def unit_rows(column) -> np.ndarray:
        x = np.asarray(column.combine_chunks().flatten(), np.float64).reshape(len(column), -1)
        n = np.linalg.norm(x, axis=1, keepdims=True)
        return np.divide(x, n, out=x.copy(), where=n > 0)

    def cell(left, right):
        if not left.num_rows or not right.num_rows:
            return types.empty_table()
        ids, q = plain(np.asarray(left["id"])), unit_rows(left["asked"])
        last = (np.asarray(left["s"], np.float64)[:, None], plain(np.asarray(left["r"]))[:, None]) if "r" in left.column_names else None
        best_s, best_i = np.full((len(ids), 0), -np.inf), None
        for at in range(0, right.num_rows, STEP):
            part = right.slice(at, STEP)
            ref = plain(np.asarray(part["id"]))
            s = q @ unit_rows(part["embedding"]).T
            if best_s.shape[1] == k and (n := np.count_nonzero(near := s >= best_s[:, -1:] - 1e-6)) * 8 < s.size:
                # only what reaches the k-th best of its query so far can enter; those that no more than round up to it are judged below
                row, col = np.nonzero(near)
                value, width = np.round(s[row, col], 6), np.bincount(row, minlength=len(ids))
                place = np.arange(n) - np.repeat(np.cumsum(width) - width, width)
                s = np.full((len(ids), int(width.max(initial=0))), -np.inf)
                i = np.zeros(s.shape, ref.dtype)
                s[row, place], i[row, place] = value, ref[col]
            else:
                s, i = np.round(s, 6), np.broadcast_to(ref, s.shape)
            if exclude_self:
                s[ids[:, None] == i] = -np.inf
            if last is not None:
                s[(s > last[0]) | ((s == last[0]) & (i <= last[1]))] = -np.inf
            some = np.flatnonzero((s >= best_s[:, -1:]).any(1)) if best_s.shape[1] == k else np.arange(len(ids))
            if best_s.shape[1] < k:
                s, i = np.concatenate([best_s, s], 1), i if best_i is None else np.concatenate([best_i, i], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                best_s, best_i = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
            elif len(some):
                s, i = np.concatenate([best_s[some], s[some]], 1), np.concatenate([best_i[some], i[some]], 1)
                order = np.lexsort((i, -s), axis=1)[:, :k]
                if best_i.dtype != i.dtype:  # longer texts
                    best_i = best_i.astype(i.dtype)
                best_s[some], best_i[some] = np.take_along_axis(s, order, 1), np.take_along_axis(i, order, 1)
        row, col = np.nonzero(best_s > -np.inf)
        return pa.table([pa.array(ids[row]), pa.array(best_i[row, col]), pa.array(best_s[row, col])], schema=types)

    rows = queries.select(F.col("id").cast(asked).alias("id"), F.col("embedding").alias("asked")).where("asked is not null")
    if after is not None:
        rows = rows.join(after.select(F.col("query_id").cast(asked).alias("id"), F.col("score").alias("s"), F.col("ref_id").cast(kind).alias("r")), "id")
    known = vectors.select(F.col("id").cast(kind).alias("id"), "embedding").where("embedding is not null")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = max(1, math.ceil(rows.count() / QUERY_BLOCK))
    pieces = max(1, math.ceil(known.count() / PIECE), math.ceil(CELLS * parts / blocks))
    deal = lambda d, n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = rows.withColumn("block", deal(rows, blocks)).withColumn("piece", every(pieces))
    right = known.withColumn("piece", deal(known, pieces)).withColumn("block", every(blocks))
    dealt = lambda d: d.repartition(max(parts, min(blocks * pieces, CELLS * parts)), "block", "piece").groupBy("block", "piece")
    found = dealt(left).cogroup(dealt(right)).applyInArrow(cell, schema)
    return top(found, "query_id", [F.desc("score"), F.asc("ref_id")], k)


def top(rows: DataFrame, by: str, order: list[Column], k: int) -> DataFrame:
    """The k first rows of each key, with rank; Spark keeps k rows a key and task before it shuffles."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("rank") <= k)


def hashed(text: Column, size: int = 64) -> Column:
    """A bag of lower-case words as a vector: counts by hash.  It stands where no text encoder is plugged in."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    place = F.transform(words, lambda w: F.conv(F.substring(F.md5(w.cast("binary")), 1, 8), 16, 10).cast("long") % size)
    count = lambda place, i: F.size(place) - F.size(F.call_function("array_remove", place, i))
    return _once(place, lambda place: F.transform(F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long")), lambda i: count(place, i).cast("double")))


def embedded(texts: DataFrame, encode=None) -> DataFrame:
    """(id, embedding) of (id, text): unit vectors by the encoder, a function from (id, text) to (id, embedding) rows; by default, hashed words.

    Texts are dealt to all tasks first, as a small file of them is one task's, however long encoding takes.
    """
    texts = texts.repartition(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), "id")
    got = texts.select("id", hashed(F.col("text")).alias("embedding")) if encode is None else encode(texts)
    return got.select("id", unit(F.col("embedding")).alias("embedding"))


def synonym_index(names: DataFrame, encode=None) -> tuple[DataFrame, DataFrame]:
    """The index of all names of concepts, one vector for each name, and the map (id, cui) of its ids; names: (cui, name)."""
    rows = names.select("cui", "name").distinct().withColumn("id", F.xxhash64("cui", "name"))
    return embedded(rows.select("id", F.col("name").alias("text")), encode), rows.select("id", "cui")
