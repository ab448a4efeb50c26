"""What operators share with the executors: a folder, and this package, which they need not have installed."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; only a local session (tests) gets a folder of its own where it is unset."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="strataloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame) -> DataFrame:
    """The rows of df from a Parquet table in the shared folder: cuts the lineage, survives executors, and is read by columns."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def drop(*tables: DataFrame) -> None:
    """Deletes the files of tables made by stored(), once nothing that is still to run reads them."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        folder.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def numbered(df: DataFrame, column: str) -> DataFrame:
    """(column, n): the distinct values that are not null, numbered from 0 without gaps in ascending order.

    Values are dealt by ranges and numbered in each; only the ranges' sizes come to the driver.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = df.select(column).where(F.col(column).isNotNull()).distinct()
    rows = stored(values.repartitionByRange(parts, column).sortWithinPartitions(column).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(tuple(r) for r in rows.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    before, offsets = 0, []
    for p in range(max(sizes, default=-1) + 1):
        offsets.append(before)
        before += sizes.get(p, 0)
    out = rows.select(column, (F.element_at(F.array(*map(F.lit, offsets or [0])), part + 1) + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).cast("long").alias("n"))
    out._count = before
    return out


def ship(spark: SparkSession) -> None:
    """Sends the package's code, once a session; functions that run in Python on executors need it."""
    sc = spark.sparkContext
    if getattr(sc, "_strataloom_shipped", False):
        return
    top = Path(__file__).resolve().parent.parent
    folder = Path(tempfile.mkdtemp(prefix="strataloom-"))  # of the driver alone: Spark sends the file on
    with zipfile.ZipFile(folder / "strataloom_code.zip", "w") as out:
        for file in sorted(top.rglob("*.py")):
            out.write(file, file.relative_to(top.parent))
    sc.addPyFile(str(folder / "strataloom_code.zip"))
    sc._strataloom_shipped = True
