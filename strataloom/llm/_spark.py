"""Spark plumbing of the corpus operators: reading, cutting lineage, Arrow maps."""

from __future__ import annotations

import ctypes
import sys
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch: long texts must not pile up in a Python worker.
BATCH_ROWS = 2000
BATCH_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; only a local session (tests) gets an own one where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataloom-")
        sc.setCheckpointDir(folder)
    return folder


#: Lists that paths of written tables go to, innermost last.
_COLLECTING: list[list[str]] = []


@contextmanager
def collecting():
    """The paths of the tables that are written inside, as a list."""
    _COLLECTING.append([])
    try:
        yield _COLLECTING[-1]
    finally:
        _COLLECTING.pop()


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows of df, written as Parquet to the shared folder and read again; cuts the lineage and survives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_to = path
    if _COLLECTING:
        _COLLECTING[-1].append(path)
    return out


def drop_path(spark: SparkSession, path: str) -> None:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def drop_written(*tables: DataFrame) -> None:
    """Deletes the files of tables made by written(), once nothing that is still to run reads them."""
    for df in tables:
        drop_path(df.sparkSession, df._written_to)


#: Settings of the batches of Arrow maps.  Spark reads them when the plan runs, so they hold for the session; they are lowered only.
_LIMITS = {"spark.sql.execution.arrow.maxRecordsPerBatch": BATCH_ROWS, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}


def arrow_map(df: DataFrame, fn, schema: str) -> DataFrame:
    """mapInArrow in batches of bounded rows and bytes."""
    ship(df.sparkSession)
    conf = df.sparkSession.conf
    for name, most in _LIMITS.items():
        now = conf.get(name, None)
        if now is None or not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df.mapInArrow(_released(fn), schema)


def _released(fn):
    """The function, after which a worker gives what it has freed back to the system: workers live on from stage to stage."""

    def run(batches):
        try:
            yield from fn(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if sys.platform == "linux":
                ctypes.CDLL(None).malloc_trim(0)

    return run


#: A key with more than one in so many of all rows is joined by broadcast: there are at most as many of those.
HEAVY = 4096


def spread_join(rows: DataFrame, table: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Inner join of rows with a table of distinct keys, where column n of the table counts the rows with that key and total all rows.

    The table's keys with over total / HEAVY rows (at most HEAVY of them) are broadcast, so that no task gets all rows of one;
    the rest is joined by shuffle.  Both inputs are read twice.
    """
    heavy = table.where(F.col(n) * F.lit(HEAVY) > total)
    light = table.where(F.col(n) * F.lit(HEAVY) <= total)
    often = rows.join(F.broadcast(heavy), key)
    rest = rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(light, key)
    return often.unionByName(rest)


def fold_of(doc_id, folds: int):
    """crc32 of the id as text, modulo the folds; a null id counts as the empty string."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def id_type(df: DataFrame, column: str = "doc_id") -> str:
    return df.schema[column].dataType.simpleString()


def integer_ids(df: DataFrame, column: str = "doc_id") -> bool:
    return id_type(df, column) in ("bigint", "int", "smallint", "tinyint")


def input_bytes(df: DataFrame, text: str = "text") -> int:
    """The optimizer's estimate of the size of the rows; where it has none, the bytes of their texts."""
    guess = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if guess < 1 << 60:
        return guess
    return df.agg(F.sum(F.octet_length(text))).first()[0] or 0


def ship(spark: SparkSession) -> None:
    """Gives the executors this package, once a session: they need not have it installed."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="strataloom-"))
    with zipfile.ZipFile(folder / "strataloom_code.zip", "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(folder / "strataloom_code.zip"))
    sc._strataloom_shipped = True


def free(name: str, df: DataFrame) -> str:
    """The name, or a longer one that df doesn't have in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
