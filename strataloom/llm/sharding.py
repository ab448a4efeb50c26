"""Sharding by jump consistent hashing, in DataFrame functions only.

A row's stable key walks a short pseudo-random chain of ever larger shard
numbers; its shard is the last one below the shard count.  No ring table is
needed, and a further shard takes rows only into itself.

Slots number the rows of a shard from 0 without gaps.  To rank without putting a
shard's rows into one task, each shard is cut into BUCKETS buckets by the key's
chain; rows are ranked in their bucket, and the buckets' counts (a table of
shards x BUCKETS rows, whatever the corpus) give the offsets.

Defined results: a null key counts as 0; keys that are not integers count by their
64-bit hash; equal keys share a shard; fully equal rows take adjacent slots in either
order; null text has size 1 and crc 0, and a text of any length only gives its size and
crc; columns named shard, grown_shard or slot are replaced, all others are kept.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

SHARDS = 8
BUCKETS = 256
#: Fixed values of the published algorithm's linear congruential generator.
_MULTIPLIER, _TWO64, _TWO33, _TWO31 = 2862933555777941757, 18446744073709551616, 8589934592, 2147483648


def _state(key: Column) -> Column:
    """The key as an unsigned 64-bit number."""
    k = F.coalesce(key.cast("long"), F.lit(0)).cast("decimal(20,0)")
    return F.when(k < 0, (k + F.lit(Decimal(_TWO64)).cast("decimal(20,0)")).cast("decimal(20,0)")).otherwise(k)


def _next(state: Column) -> Column:
    product = state * F.lit(Decimal(_MULTIPLIER)).cast("decimal(19,0)") + F.lit(1).cast("decimal(1,0)")
    return (product % F.lit(Decimal(_TWO64)).cast("decimal(20,0)")).cast("decimal(20,0)")


def _high(state: Column) -> Column:
    """The upper 31 bits."""
    return ((state - state % F.lit(Decimal(_TWO33)).cast("decimal(20,0)")) / F.lit(Decimal(_TWO33)).cast("decimal(20,0)")).cast("long")


def jump(key: Column, shards: int) -> Column:
    """The shard of each key; at most `shards` steps, as each goes to a larger number."""
    start = F.struct(_state(key).alias("s"), F.lit(-1).cast("long").alias("b"), F.lit(0).cast("long").alias("j"))

    def step(acc, _):
        s = _next(acc["s"])
        # the state must be made once for the jump and once for the next step
        far = F.floor((acc["j"] + 1) * (F.lit(float(_TWO31)) / (_high(s) + 1).cast("double"))).cast("long")
        return F.when(acc["j"] < shards, F.struct(s.alias("s"), acc["j"].alias("b"), far.alias("j"))).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, lambda acc: acc["b"].cast("int"))


def bucket(key: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(_high(_next(_state(key))), F.lit(buckets)).cast("int")


def assign(rows: DataFrame, key: str, shards: int = SHARDS, order: tuple[str, ...] = ()) -> DataFrame:
    """rows with shard, grown_shard (with one shard more) and slot; `order` breaks ties of equal keys."""
    integer = rows.schema[key].dataType.simpleString() in ("bigint", "int", "smallint", "tinyint")
    number = F.col(f"`{key}`").cast("long") if integer else F.xxhash64(F.col(f"`{key}`").cast("string"))
    number = number if integer else F.when(F.col(f"`{key}`").isNotNull(), number)
    bucket_, rank_, before_, n_ = (_spark.free(c, rows) for c in ("_bucket", "_rank", "_before", "_n"))
    dealt = rows.withColumns({"shard": jump(number, shards), "grown_shard": jump(number, shards + 1), bucket_: bucket(number)})
    counts = dealt.groupBy("shard", bucket_).agg(F.count(F.lit(1)).alias(n_))
    before = Window.partitionBy("shard").orderBy(bucket_).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("shard", bucket_, F.coalesce(F.sum(n_).over(before), F.lit(0)).alias(before_))
    rank = F.row_number().over(Window.partitionBy("shard", bucket_).orderBy(*(F.col(f"`{c}`") for c in (key, *order))))
    ranked = dealt.withColumn(rank_, rank)
    out = ranked.join(F.broadcast(offsets), ["shard", bucket_])  # shards x BUCKETS rows
    out = out.withColumn("slot", (F.col(before_) + F.col(rank_) - 1).cast("long"))
    return out.select(*(f"`{c}`" for c in rows.columns if c not in ("shard", "grown_shard", "slot")), "shard", "grown_shard", "slot")


def op6_sharding(spark, sf_dir: str) -> DataFrame:
    text = F.col("text").cast("string").cast("binary")
    light = _spark.table(spark, sf_dir, "documents").select("doc_id", (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("").cast("binary"))).alias("text_crc32"))
    return assign(light, "doc_id", SHARDS, ("text_crc32", "size")).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def _sql_jump(source: str, shards: int, out: str) -> str:
    for _ in range(shards):
        source = f"""SELECT * EXCLUDE (s, b, j), CASE WHEN j < {shards} THEN s2 ELSE s END AS s, CASE WHEN j < {shards} THEN j ELSE b END AS b,
 CASE WHEN j < {shards} THEN floor((j + 1) * ({_TWO31}.0::DOUBLE / ((s2 // {_TWO33}) + 1)::DOUBLE))::BIGINT ELSE j END AS j
 FROM (SELECT * EXCLUDE (s2), (s * {_MULTIPLIER}::HUGEINT + 1) % {_TWO64}::HUGEINT AS s2 FROM ({source}))"""
    return f"SELECT * EXCLUDE (s, b, j, s2), b::INTEGER AS {out} FROM ({source})"


_KEY = f"(CASE WHEN coalesce(doc_id, 0) < 0 THEN coalesce(doc_id, 0)::HUGEINT + {_TWO64}::HUGEINT ELSE coalesce(doc_id, 0)::HUGEINT END)"
_START = f"{_KEY} AS s, -1::BIGINT AS b, 0::BIGINT AS j, 0::HUGEINT AS s2"
_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(t)), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])))"
_ROWS = f"""SELECT doc_id, (strlen(t) + 1)::BIGINT AS size, {_CRC}::BIGINT AS text_crc32,
 ((({_KEY} * {_MULTIPLIER}::HUGEINT + 1) % {_TWO64}::HUGEINT) // {_TWO33}) % {BUCKETS} AS bucket
 FROM (SELECT doc_id, coalesce(text, '') AS t, hex(encode(coalesce(text, ''))) AS h FROM documents), tab"""
_ONE = _sql_jump(f"SELECT *, {_START} FROM ({_ROWS})", SHARDS, "shard")
_TWO = _sql_jump(f"SELECT *, {_START} FROM ({_ONE})", SHARDS + 1, "grown_shard")
ORACLE_SQL = f"""
WITH RECURSIVE c AS (SELECT range AS n, range AS v, 0 AS k FROM range(256)
 UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM c WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS tab FROM c WHERE k = 8)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY bucket, doc_id, text_crc32, size) - 1 AS slot, grown_shard FROM ({_TWO})
"""
