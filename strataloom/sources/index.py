"""An index of vectors on files: segments of vectors in id ranges, and bitmaps of the removed ones.

A segment is a Parquet table whose partitions are ranges of ids; a row keeps its place in its range.  Removing ids
looks up their ranges, reads the ids of these alone, and writes bitmaps of their places; the vectors stay as they are.
A manifest names the segments and the bitmaps that count, so readers see a removal or an addition as a whole,
and of two writers at a time the later one starts again from what the earlier one has left.

Defined results: an id that is added again after its removal is there once more, in another segment; an id that occurs
several times goes as a whole; ids that the index lacks, and null, remove nothing; rows with a null id stay.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.workers import drop, stored
from . import _Manifest

#: Places of a bitmap (a row, 8 KB), ranges of a segment at most, and bitmaps that are broadcast at most (64 MB; more are joined by a shuffle).
CHUNK, RANGES, BROADCAST = 65_536, 1024, 8192
_AT = ["segment", "part", "chunk"]


class VectorIndex:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifest = _Manifest(spark, self.path)

    def exists(self) -> bool:
        return self.manifest.latest()[0] > 0

    def _rows(self, segment: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{segment}/rows").withColumn("segment", F.lit(segment))

    def _commit(self, parts) -> None:
        """Makes what parts(current names) gives the next version, from the start again where another writer came first."""
        while True:
            version, names = self.manifest.latest()
            if self.manifest.commit(version + 1, parts(names)):
                return

    def add(self, vectors: DataFrame) -> VectorIndex:
        """Adds (id, embedding) as a segment."""
        name, ranges = f"rows-{uuid.uuid4().hex}", min(RANGES, int(self.spark.conf.get("spark.sql.shuffle.partitions")))
        dealt = vectors.select("id", "embedding").repartitionByRange(ranges, "id").sortWithinPartitions("id")
        placed = dealt.withColumns({"pos": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)), "part": F.spark_partition_id()})
        placed.write.partitionBy("part").parquet(f"{self.path}/{name}/rows")
        self.spark.createDataFrame([], placed.drop("part").schema).coalesce(1).write.parquet(f"{self.path}/{name}/rows/part=-1")  # so that a segment without rows has a schema
        lows = self.spark.read.schema(placed.schema).parquet(f"{self.path}/{name}/rows").groupBy("part").agg(F.min("id").alias("low")).where("low is not null")
        lows.coalesce(1).write.parquet(f"{self.path}/{name}/lows")
        self._commit(lambda names: [*names, name])
        return self

    def _hits(self, segment: str, ids: DataFrame) -> DataFrame | None:
        """(segment, part, pos) of ids in the segment; only the ranges that may hold them are read."""
        lows = self.spark.read.parquet(f"{self.path}/{segment}/lows").orderBy("low").collect()  # at most RANGES rows
        if not lows:
            return None
        known = F.array(*(F.struct(F.lit(r["low"]).alias("low"), F.lit(r["part"]).alias("part")) for r in lows))
        asked = ids.select("id", F.try_element_at(F.filter(known, lambda x: x["low"] <= F.col("id")), F.lit(-1))["part"].alias("part"))
        touched = [r["part"] for r in asked.where("part is not null").select("part").distinct().collect()]  # likewise
        if not touched:
            return None
        return self._rows(segment).select("segment", "part", "pos", "id").where(F.col("part").isin(touched)).join(ids, "id", "left_semi").drop("id")

    def remove(self, ids: DataFrame) -> VectorIndex:
        """Removes the ids (id)."""
        asked = stored(ids.select("id").where("id is not null").distinct())

        def marked(names):
            segments, old = ([n for n in names if n.startswith(kind)] for kind in ("rows-", "removed-"))
            hits = [h for h in (self._hits(s, asked) for s in segments) if h is not None]
            if not hits:
                return names
            place = F.col("pos") % CHUNK
            words = reduce(DataFrame.union, hits).select("segment", "part", F.floor(F.col("pos") / CHUNK).alias("chunk"), F.floor(place / 64).cast("int").alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int")).alias("bits"))
            for name in old:
                before = self.spark.read.parquet(f"{self.path}/{name}").select(*_AT, F.posexplode("words").alias("word", "bits"))
                words = words.union(before.where("bits <> 0"))
            each = words.groupBy(*_AT, "word").agg(F.bit_or("bits").alias("bits"))
            maps = each.groupBy(*_AT).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))  # at most CHUNK / 64 entries
            out = maps.select(*_AT, F.transform(F.sequence(F.lit(0), F.lit(CHUNK // 64 - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))
            name = f"removed-{uuid.uuid4().hex}"
            out.write.parquet(f"{self.path}/{name}")
            return [*segments, name]

        self._commit(marked)
        drop(asked)
        return self

    def read(self) -> DataFrame:
        """(id, embedding) of what is not removed."""
        names = self.manifest.latest()[1]
        rows = reduce(DataFrame.union, (self._rows(n).select("id", "embedding", "segment", "part", "pos") for n in names if n.startswith("rows-")))
        for name in (n for n in names if n.startswith("removed-")):  # one at most
            gone = self.spark.read.parquet(f"{self.path}/{name}")
            few = gone.count() <= BROADCAST
            both = rows.withColumn("chunk", F.floor(F.col("pos") / CHUNK)).join(F.broadcast(gone) if few else gone.hint("merge"), _AT, "left")
            word = F.get("words", F.floor(F.col("pos") % CHUNK / 64).cast("int"))
            bit = F.call_function("shiftrightunsigned", word, (F.col("pos") % 64).cast("int")).bitwiseAND(F.lit(1))
            rows = both.where(F.coalesce(bit, F.lit(0)) == 0)
        return rows.select("id", "embedding")
