"""Versioned dimension history from late and corrected changes.

A change is an update or a delete, which holds from its start on, or a correction, which
holds for some days and overrules both.  Each day takes the last-arrived correction that
covers it, else the update or delete with the latest start, ties to the last-arrived.

Timelines are cut into pages of PAGE days.  Changes of equal key, kind, start and end are
folded to the last-arrived one before they are shuffled, and corrections are clipped to
pages, so a page of a key has at most PAGE starts and PAGE * (PAGE + 1) / 2 spans,
however many changes the key has.  Pages are dealt to shards of some SHARD_ROWS rows;
each shard is a grouped Arrow table that DuckDB turns into change points: an ASOF join of
the boundaries to the base, an interval join with arg_max for the corrections, islands
by window.  Islands that go on over a page's end are joined by a window over a key's change points, of
which there is one a day at most.

Defined results: changes without a key, a kind or a start, and corrections without a day,
concern nothing; an absent day is one with a delete or nothing, a null value is a value;
changes of equal arrival are ordered by their values, nulls first; repeated changes count once;
further columns are left out; no changes give no versions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import _spark

PAGE = 64
SHARD_ROWS = 50_000
_BASE, _CORRECTION, _MARK = 0, 1, 2

#: Of one shard; page_days is put in.  A base row before the page's first day carries what held then.
_POINTS = """
WITH e AS (SELECT *, row_number() OVER (ORDER BY arrived NULLS FIRST, value NULLS FIRST) AS nth FROM shard),
b AS (SELECT k, page, page * {page_days} AS d FROM e UNION SELECT k, page, lo FROM e WHERE lo >= page * {page_days}
      UNION SELECT k, page, hi FROM e WHERE hi < (page + 1) * {page_days}),
base AS (SELECT b.k, b.page, b.d, e.nth, e.deleted, e.value FROM b ASOF LEFT JOIN (SELECT * FROM e WHERE kind = 0) e ON b.k = e.k AND b.page = e.page AND b.d >= e.lo),
fix AS (SELECT b.k, b.page, b.d, max(e.nth) AS nth, arg_max({{'v': e.value}}, e.nth) AS fixed FROM b JOIN e ON b.k = e.k AND b.page = e.page AND b.d >= e.lo AND b.d < e.hi
        WHERE e.kind = 1 GROUP BY ALL),
s AS (SELECT k, page, d, fix.nth IS NOT NULL OR (base.nth IS NOT NULL AND NOT base.deleted) AS present,
      CASE WHEN fix.nth IS NOT NULL THEN fixed.v WHEN NOT base.deleted THEN base.value END AS value FROM base LEFT JOIN fix USING (k, page, d)),
i AS (SELECT *, row_number() OVER w AS n, lag(present) OVER w AS p0, lag(value) OVER w AS v0 FROM s WINDOW w AS (PARTITION BY k, page ORDER BY d))
SELECT k, d, present, value FROM i WHERE n = 1 OR present <> p0 OR value IS DISTINCT FROM v0
"""


def _paged(rows: DataFrame, page_days: int) -> DataFrame:
    """(k, page, kind, lo, hi, m): corrections clipped to their pages, and the day after each as a mark, so that its page exists."""
    to_page = lambda day: F.floor(day / page_days).cast("long")
    base = rows.where(F.col("kind") == _BASE).select("k", to_page(F.col("lo")).alias("page"), "kind", "lo", F.lit(None).cast("long").alias("hi"), "m")
    spans = rows.where((F.col("kind") == _CORRECTION) & (F.col("hi") > F.col("lo")))
    cut = spans.withColumn("page", F.explode(F.sequence(to_page(F.col("lo")), to_page(F.col("hi") - 1))))
    first = F.col("page") * page_days
    cut = cut.select("k", "page", "kind", F.greatest("lo", first).alias("lo"), F.least("hi", first + page_days).alias("hi"), "m")
    nothing = F.lit(None).cast(rows.schema["m"].dataType)
    marks = spans.select("k", to_page(F.col("hi")).alias("page"), F.lit(_MARK).alias("kind"), F.col("hi").alias("lo"), F.lit(None).cast("long").alias("hi"), nothing.alias("m"))
    return base.unionByName(cut).unionByName(marks)


def change_points(rows: DataFrame, page_days: int = PAGE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(k, d, present, value) at the days on which a page begins or its state changes; rows: (k, kind, lo, hi, m), m: (arrived, deleted, value)."""
    fold = lambda d: d.groupBy("k", "page", "kind", "lo", "hi").agg(F.max("m").alias("m"))
    events = _spark.written(fold(_paged(rows, page_days)), "history")
    last = F.max(F.when(F.col("kind") == _BASE, F.struct("lo", "m")))
    pages = events.groupBy("k", "page").agg(last.alias("last"))
    before = Window.partitionBy("k").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    carried = pages.withColumn("last", F.last("last", ignorenulls=True).over(before)).where("last is not null")
    carried = carried.select("k", "page", F.lit(_BASE).alias("kind"), (F.col("page") * page_days - 1).alias("lo"), F.lit(None).cast("long").alias("hi"), "last.m")
    shards = max(_spark.parts(rows.sparkSession), math.ceil(events.count() / shard_rows))
    dealt = events.unionByName(carried).select(F.pmod(F.hash("k", "page"), F.lit(shards)).alias("shard"), "k", "page", "kind", "lo", "hi", "m.arrived", "m.deleted", "m.value")
    sql = _POINTS.format(page_days=page_days)

    def points(table):
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": ""}) as con:
            con.register("shard", table)
            return con.sql(sql).to_arrow_table()

    kinds = {c: rows.schema["m"].dataType[c].dataType.simpleString() for c in ("value",)}
    _spark.ship(rows.sparkSession)
    return dealt.groupBy("shard").applyInArrow(points, f"k {_spark.id_type(rows, 'k')}, d long, present boolean, value {kinds['value']}")


def history(
    changes: DataFrame, key: Column, kind: Column, start: Column, days: Column, value: Column, arrival: list[Column],
    page_days: int = PAGE, shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(key, version, valid_from, valid_to, value): maximal runs of days with one value, numbered from 1 by key; valid_to is exclusive, and null where it is endless.

    kind: 'update', 'delete' or 'correction'; start, days: whole days; arrival: what orders arrivals.
    """
    arrived = F.struct(*(c.alias(f"a{i}") for i, c in enumerate(arrival)))
    rows = changes.select(
        key.alias("k"), F.when(kind == "correction", _CORRECTION).when(kind.isin("update", "delete"), _BASE).alias("kind"), start.cast("long").alias("lo"),
        F.when(kind == "correction", start.cast("long") + days.cast("long")).alias("hi"), F.struct(arrived.alias("arrived"), (kind == "delete").alias("deleted"), value.alias("value")).alias("m"),
    ).where("k is not null and kind is not null and lo is not null")
    points = change_points(rows, page_days, shard_rows)
    w = Window.partitionBy("k").orderBy("d")
    runs = points.withColumns({"p0": F.lag("present").over(w), "v0": F.lag("value").over(w)})
    runs = runs.where("(p0 is null and present) or p0 <> present or not (value <=> v0)")
    runs = runs.withColumns({"valid_to": F.lead("d").over(w), "version": F.sum(F.col("present").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    return runs.where("present").select(F.col("k").alias("key"), F.col("version").cast("int").alias("version"), F.col("d").alias("valid_from"), "valid_to", "value")


def op11_history(spark, sf_dir: str) -> DataFrame:
    """Two changes of every document, which concern the document whose id is the next lower multiple of 20."""
    docs = _spark.table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").cast("long"), "source", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    hashed = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("j").cast("string")), 256)
    docs = docs.withColumn("h", F.conv(F.substring(hashed, 1, 12), 16, 10).cast("long"))
    of_ten = F.floor(F.col("h") / 1000) % 10
    kind = F.when(of_ten < 2, "delete").when(of_ten < 5, "correction").otherwise("update")
    concerned = F.col("doc_id") - F.col("doc_id") % 20
    got = history(docs, concerned, kind, F.col("h") % 120, F.lit(30), F.col("source"), [F.col("h"), F.col("doc_id"), F.col("j")])
    return got.withColumnRenamed("key", "doc_id")


#: Day by day, which is plain but needs no page, run or interval: after day 150 nothing changes.
ORACLE_SQL = """
WITH c AS (SELECT doc_id - doc_id % 20 AS k, source, doc_id AS id, j, ('0x' || substr(sha256(doc_id || ':' || j), 1, 12))::BIGINT AS h
           FROM documents, (VALUES (0), (1)) v(j) WHERE doc_id IS NOT NULL),
o AS (SELECT k, source, h % 120 AS s, (h // 1000) % 10 AS t, row_number() OVER (ORDER BY h, id, j, source NULLS FIRST) AS a FROM c),
d AS (SELECT k, d FROM (SELECT DISTINCT k FROM o), (SELECT unnest(range(0, 151)) AS d)),
x AS (SELECT d.k, d.d, o.source, t < 2 AS gone, row_number() OVER (PARTITION BY d.k, d.d ORDER BY (t BETWEEN 2 AND 4) DESC, CASE WHEN t BETWEEN 2 AND 4 THEN 0 ELSE s END DESC, a DESC) AS n
      FROM d JOIN o ON o.k = d.k AND s <= d AND (t NOT BETWEEN 2 AND 4 OR d < s + 30)),
p AS (SELECT k, d, source, d - row_number() OVER (PARTITION BY k, source ORDER BY d) AS run FROM x WHERE n = 1 AND NOT gone),
r AS (SELECT k, source, min(d) AS a, max(d) AS b FROM p GROUP BY k, source, run)
SELECT k AS doc_id, (row_number() OVER (PARTITION BY k ORDER BY a))::INTEGER AS version, a AS valid_from, CASE WHEN b < 150 THEN b + 1 END AS valid_to, source AS value FROM r
"""
