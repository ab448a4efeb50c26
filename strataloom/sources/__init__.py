"""Readers and writers: report tables, ontology files, caches, results."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import vocab

# Columns of study tables that hold text, and numbers.
_TEXT = ("dicom_id", "PerformedProcedureStepDescription", "ViewPosition", "ProcedureCodeSequence_CodeMeaning", "ViewCodeSequence_CodeMeaning", "PatientOrientationCodeSequence_CodeMeaning", "p", "path", "split", "report_path", "impression", "Finding Label", "Finding Labels")
_NUMBER = ("subject_id", "study_id", "Rows", "Columns", "StudyDate", "StudyTime", *vocab.CLASSES, "Pleural Other", "Support Devices")
#: Types of the columns of a study table; others are text.
STUDY_TYPES: dict[str, T.DataType] = {c: T.StringType() for c in _TEXT} | {c: T.DoubleType() for c in _NUMBER}


@dataclass(frozen=True)
class Config:
    """Parameters of labelling and retrieval."""

    metric: str = "sym_tversky"
    alpha: float = 0.5
    beta: float = 1.0
    k: int = 1
    max_depth: int = 10
    use_ic: bool = False
    report_column: str = "impression"
    id_column: str = "dicom_id"
    path_column: str = "path"
    image_base_path: str = ""

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Config:
        """From a YAML file of plain `key: value` lines, in sections or not; other keys are ignored."""
        names = {"cost_function": "metric", "max_expl_depth": "max_depth", "image_path_column": "path_column"}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        values = {}
        for line in "\n".join(r["value"] for r in spark.read.option("wholetext", True).text(path).collect()).splitlines():  # one small file
            key, _, value = line.partition("#")[0].partition(":")
            name, value = names.get(key.strip(), key.strip()), value.strip().strip("\"'")
            if name in kinds and value:
                values[name] = value.lower() == "true" if kinds[name] is bool else kinds[name](value)
        return cls(**values)

    @classmethod
    def of(cls, values: dict) -> Config:
        known = {f.name for f in fields(cls)}
        if unknown := sorted(set(values) - known):
            raise ValueError(f"unknown parameters: {unknown}")
        return cls(**values)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def study_table(spark: SparkSession, path: str | None = None, df: DataFrame | None = None) -> DataFrame:
    """A study table from a CSV file with a header (types by column name, NaN as null), or the frame that is given."""
    if df is not None:
        return df
    if path is None:
        raise ValueError("either a path or a DataFrame is needed")
    header = spark.read.option("header", True).csv(path).columns  # reads the first line only
    schema = T.StructType([T.StructField(c, STUDY_TYPES.get(c, T.StringType())) for c in header])
    got = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return got.withColumns({c: F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")) for c, t in got.dtypes if t == "double"})


# Columns of the published ontology files.
RRF = {
    "MRCONSO": ["CUI", "LAT", "TS", "LUI", "STT", "SUI", "ISPREF", "AUI", "SAUI", "SCUI", "SDUI", "SAB", "TTY", "CODE", "STR", "SRL", "SUPPRESS", "CVF"],
    "MRSTY": ["CUI", "TUI", "STN", "STY", "ATUI", "CVF"],
    "MRDEF": ["CUI", "AUI", "ATUI", "SATUI", "SAB", "DEF", "SUPPRESS", "CVF"],
    "MRREL": ["CUI1", "AUI1", "STYPE1", "REL", "CUI2", "AUI2", "STYPE2", "RELA", "RUI", "SRUI", "SAB", "SL", "RG", "DIR", "SUPPRESS", "CVF"],
    "MRHIER": ["CUI", "AUI", "CXN", "PAUI", "SAB", "RELA", "PTR", "HCD", "CVF"],
}


def rrf(spark: SparkSession, path: str, kind: str, columns: list[str] | None = None) -> DataFrame:
    """A pipe-delimited ontology file, plain or gz: all columns are text, quotes are ordinary characters, the trailing separator is ignored."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*(columns or RRF[kind]), "_end"]])
    got = spark.read.schema(schema).option("sep", "|").option("quote", "").option("mode", "PERMISSIVE").csv(path)
    return got.drop("_end")


def concept_names(mrconso: DataFrame) -> DataFrame:
    """(cui, name): English, not suppressed forms, of one vocabulary."""
    keep = (F.col("LAT") == "ENG") & ~F.col("TS").eqNullSafe("S") & (F.col("SAB") == "SNOMEDCT_US")
    return mrconso.where(keep).select(F.col("CUI").alias("cui"), F.col("STR").alias("name")).dropna()


def last_per_key(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key by an explicit order column."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def semantic_types(mrsty: DataFrame, order: str = "line") -> DataFrame:
    return last_per_key(mrsty.select(F.col("CUI").alias("cui"), F.col("TUI").alias("tui"), order), "cui", "tui", order)


def definitions(mrdef: DataFrame, order: str = "line") -> DataFrame:
    return last_per_key(mrdef.select(F.col("CUI").alias("cui"), F.col("DEF").alias("definition"), order), "cui", "definition", order)


def numbered(rows: DataFrame) -> DataFrame:
    """Adds `line`, which grows in the order of a file's lines, and of files by path; rows: as a reader of files gives them."""
    return rows.withColumn("line", F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")))


def parent_relations(mrrel: DataFrame, types: DataFrame, allowed=vocab.PARENT_TYPES) -> DataFrame:
    """(cui, parents): broader concepts of one vocabulary where both ends have an allowed type."""
    pairs = mrrel.where((F.col("REL") == "PAR") & (F.col("SL") == "SNOMEDCT_US") & (F.col("CUI1") != F.col("CUI2"))).select(F.col("CUI1").alias("cui"), F.col("CUI2").alias("parent")).distinct()
    ok = types.where(F.col("tui").isin(*allowed)).select("cui")
    both = pairs.join(ok, "cui", "left_semi").join(ok.withColumnRenamed("cui", "parent"), "parent", "left_semi")
    return both.groupBy("cui").agg(F.array_sort(F.collect_set("parent")).alias("parents"))


def graph_relations(mrrel: DataFrame, codes=vocab.RELATIONS) -> DataFrame:
    """Distinct (a, b, rel) of the concept graph."""
    return mrrel.where(F.col("REL").isin(*codes) & (F.col("CUI1") != F.col("CUI2"))).select(F.col("CUI1").alias("a"), F.col("CUI2").alias("b"), F.col("REL").alias("rel")).distinct()


def hierarchy(mrhier: DataFrame, order: str = "line") -> DataFrame:
    """Distinct (child, parent) concepts: the parent atom is looked up, first row per atom; unknown and own parents go."""
    atoms = mrhier.groupBy(F.col("AUI").alias("PAUI")).agg(F.min_by("CUI", order).alias("parent"))
    return mrhier.join(atoms, "PAUI").where(F.col("CUI") != F.col("parent")).select(F.col("CUI").alias("child"), "parent").distinct()


class _Manifest:
    """The parts of a cache: each version is a file of part names, which is renamed into place, so that it is there as a whole or not at all."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.jvm = spark, path.rstrip("/"), spark.sparkContext._jvm
        self.fs = self._at("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def latest(self) -> tuple[int, list[str]]:
        """(version, parts); version 0 is an empty cache."""
        if not self.fs.exists(self._at("manifests")):
            return 0, []
        version = max((int(f.getPath().getName()) for f in self.fs.listStatus(self._at("manifests")) if f.getPath().getName().isdigit()), default=0)
        if not version:
            return 0, []
        source = self.fs.open(self._at(f"manifests/{version}"))
        try:
            return version, self.jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8").split()
        finally:
            source.close()

    def commit(self, version: int, parts: list[str]) -> bool:
        """Makes `parts` the version, unless someone else has made it."""
        draft, final = self._at(f"manifests/.draft-{uuid.uuid4().hex}"), self._at(f"manifests/{version}")
        out = self.fs.create(draft, True)
        out.write(bytearray("\n".join(parts).encode()))
        out.close()
        if not self.fs.exists(final) and self.fs.rename(draft, final):
            return True
        self.fs.delete(draft, False)
        return False

    def read(self, parts: list[str]) -> DataFrame:
        return self.spark.read.parquet(*(f"{self.path}/{part}" for part in parts))


def cached(spark: SparkSession, path: str, make, key: str = "report_id", texts: DataFrame | None = None) -> DataFrame:
    """Read-through Parquet cache: rows of make(texts) for ids or texts that the cache lacks are added, once.

    What is made is written as a part of its own, which counts from the manifest that names it on; so what a failed or stopped
    fill leaves is never read, and a fill that another one has overtaken adds only what that one hasn't.
    """
    cache, names = _Manifest(spark, path), [key, "text_hash"]
    todo = texts.withColumn("text_hash", F.xxhash64("text"))
    version, parts = cache.latest()
    missing = todo.join(cache.read(parts).select(names).distinct(), names, "left_anti") if parts else todo
    if not parts or not missing.isEmpty():
        part = f"part-{uuid.uuid4().hex}"
        make(missing.drop("text_hash")).join(missing.select(names), key, "right").write.parquet(f"{path}/{part}")
        known = parts
        while not cache.commit(version + 1, [*parts, part]):
            version, parts = cache.latest()
            others = cache.read([x for x in parts if x not in known]).select(names).distinct()
            less = f"part-{uuid.uuid4().hex}"
            cache.read([part]).join(others, names, "left_anti").write.parquet(f"{path}/{less}")
            part, known = less, parts
    return cache.read(cache.latest()[1]).join(todo.select(names), names, "left_semi").drop("text_hash")


def resolve_ids(rows: DataFrame, id_map: DataFrame, column: str = "id") -> DataFrame:
    """rows with the concept of a vector id; id_map: (id, cui)."""
    return rows.join(id_map.select(F.col("id").alias(column), "cui"), column, "left")


def output_name(prefix: str, config: Config, classes: list[str] | None = None, model: str = "", suffix: str = "") -> str:
    """File stem from the parameters of a run."""
    parts = [prefix, config.metric, f"a{config.alpha:g}", f"b{config.beta:g}", model, "-".join(c.replace(" ", "") for c in classes or []), suffix]
    return "_".join(p for p in parts if p)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def metrics_lines(per_class: DataFrame, macro: DataFrame) -> DataFrame:
    """Text lines of a metrics file: the mean, then one line per class in order."""
    head = macro.select(F.lit(0).alias("o"), F.lit("").alias("c"), F.format_string("AUROC mean: %.6f", "auroc").alias("value"))
    rest = per_class.select(F.lit(1).alias("o"), F.col("class").alias("c"), F.format_string("%s: %.6f", "class", "auroc").alias("value"))
    return head.unionByName(rest).orderBy("o", "c").select("value")


def images(spark: SparkSession, path: str) -> DataFrame:
    """Image files as (path, modificationTime, length, content)."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)


def resolved_images(rows: DataFrame, files: DataFrame, column: str = "path") -> DataFrame:
    """rows with `found`: the jpg file if it is there, else the png file, else null; each row on its own."""
    names = files.select(F.col("path").alias("found"))
    png = F.regexp_replace(column, r"\.[^.]*$", ".png")
    return rows.join(names.withColumn("_a", F.col("found")).select(F.col("_a").alias(column), F.col("found").alias("_jpg")), column, "left").join(names.select(F.col("found").alias("_png")), png == F.col("_png"), "left").withColumn("found", F.coalesce("_jpg", "_png")).drop("_jpg", "_png")
