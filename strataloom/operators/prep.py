"""Preparation of report tables: projections, exclusions, deterministic samples and splits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from .workers import stored as cut


def named(df: DataFrame, column: str | int) -> str:
    """A column by name or by position."""
    return df.columns[column] if isinstance(column, int) else column


def dataset(df: DataFrame, id_column, report_column, path_column, base: str = "", suffix: str = ".jpg", split_value=None, split_column=None) -> DataFrame:
    """(id, report, image_path) of rows where the required columns are present."""
    picks = [named(df, c) for c in (id_column, report_column, path_column)]
    if split_column is not None and split_value is not None:
        df = split_filter(df, named(df, split_column), split_value)
    df = df.dropna(subset=picks)
    i, r, p = (F.col(f"`{c}`") for c in picks)
    return df.select(i.alias("id"), r.alias("report"), text.rewritten_path(p, base, suffix).alias("image_path"))


def split_filter(df: DataFrame, column: str, value) -> DataFrame:
    """Rows whose split, as text, is the value (so 3 and '3' match an integer column, '3.0' a floating one)."""
    return df.where(F.col(column).cast("string") == str(value))


def is_one(column: str | Column) -> Column:
    """True where the number is 1; null, 0 and -1 are false."""
    return F.coalesce((F.col(column) if isinstance(column, str) else column) == 1.0, F.lit(False))


def label_count(labels: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, (c.cast("int") for c in labels))


def one_label(df: DataFrame, labels: list[str]) -> DataFrame:
    """Rows with exactly one positive label, as `label`."""
    flags = [is_one(F.col(f"`{c}`")) for c in labels]
    pick = F.coalesce(*(F.when(f, F.lit(c)) for f, c in zip(flags, labels)))
    return df.where(label_count(flags) == 1).withColumn("label", pick)


def only_subjects(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    return df.join(of.select(key).distinct(), key, "left_semi")


def without_subjects(df: DataFrame, of: DataFrame, key: str) -> DataFrame:
    return df.join(of.select(key).distinct(), key, "left_anti")


def draw(seed, key: str) -> Column:
    """Reproducible order of rows."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))


def stratified(df: DataFrame, by: str, key: str, n: int, seed=1, strict: bool = False) -> DataFrame:
    """Exactly n rows of each class (all of a smaller one, or an error if strict), in a reproducible order."""
    if strict:
        short = df.groupBy(by).count().where(F.col("count") < n).limit(1).collect()
        if short:
            raise ValueError(f"class {short[0][by]} has fewer than {n} rows")
    rank = F.row_number().over(Window.partitionBy(by).orderBy(draw(seed, key), key))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")


def three_way(df: DataFrame, by: str, key: str, subject: str, sizes: tuple[int, int, int], seed=1) -> DataFrame:
    """df's rows of three subject-disjoint, class-balanced splits, as `part`: test, then retrieve, then train."""
    parts, rest = [], df
    for name, n in zip(("test", "retrieve", "train"), sizes):
        got = cut(stratified(rest, by, key, n, seed))  # or each split would plan the ones before anew
        parts.append(got.withColumn("part", F.lit(name)))
        rest = without_subjects(rest, got, subject)
    return reduce(DataFrame.unionByName, parts)


def shared_subjects(parts: DataFrame, subject: str) -> DataFrame:
    """(a, b, n_shared) for the pairs of parts; 0 where they are disjoint."""
    own = parts.select("part", subject).distinct()
    names = parts.select("part").distinct()
    pairs = names.select(F.col("part").alias("a")).crossJoin(names.select(F.col("part").alias("b"))).where("a < b")  # a row per pair of splits
    both = own.alias("x").join(own.alias("y"), subject).where("x.part < y.part").groupBy(F.col("x.part").alias("a"), F.col("y.part").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return pairs.join(both, ["a", "b"], "left").select("a", "b", F.coalesce("n", F.lit(0)).cast("long").alias("n_shared"))


def picks(df: DataFrame, by: str, order: list[str], wanted: DataFrame) -> DataFrame:
    """Rows at given 0-based ordinals of their class; wanted: (by, ordinal)."""
    most = wanted.agg(F.max("ordinal")).first()[0]
    rank = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    # the limit lets Spark keep few rows a class and task before it shuffles
    first = df.withColumn("_rank", rank).where(F.col("_rank") <= (-1 if most is None else most) + 1)
    return first.withColumn("ordinal", (F.col("_rank") - 1).cast("int")).drop("_rank").join(F.broadcast(wanted), [by, "ordinal"], "left_semi")


def candidate_pool(df: DataFrame, used: list[DataFrame], key: str, label: str, classes: list[str]) -> DataFrame:
    """Unused rows whose label string contains a class; each goes to the first such class, as `cls`."""
    rest = reduce(lambda d, u: d.join(u.select(key), key, "left_anti"), used, df)
    first = F.coalesce(*(F.when(F.col(label).contains(c), F.lit(c)) for c in classes))
    return rest.withColumn("cls", first).where("cls is not null")


def histogram(df: DataFrame, flags: list[str]) -> DataFrame:
    """(cls, n): rows in which a flag is set, one row per flag."""
    sums = df.agg(*(F.coalesce(F.sum(is_one(F.col(f"`{c}`").cast("double")).cast("long")), F.lit(0)).alias(c) for c in flags))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("cls"), F.col(f"`{c}`").alias("n")) for c in flags))))


def fraction(df: DataFrame, key: str, share: float = 0.8, seed=42) -> DataFrame:
    """df with `fold`: exactly floor(share * n) rows are 'train', the rest 'val'.

    Rows are dealt into ranges of the order's first byte and ranked there, so no task holds all rows.
    """
    rows = df.withColumn("_o", draw(seed, key)).withColumn("_b", F.substring("_o", 1, 2))
    counts = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))  # 256 rows
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    rank = F.row_number().over(Window.partitionBy("_b").orderBy("_o", key))
    ranked = rows.withColumn("_r", rank).join(F.broadcast(offsets), "_b")
    return ranked.withColumn("fold", F.when(F.col("_before") + F.col("_r") <= F.floor(F.col("_all") * share), "train").otherwise("val")).drop("_o", "_b", "_r", "_before", "_all")


def first_per_key(df: DataFrame, keys: list[str], order: list[str], last: bool = False) -> DataFrame:
    """The first (or last) row of each key by explicit order columns."""
    by = [F.col(c).desc() if last else F.col(c) for c in order]
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where("_r = 1").drop("_r")


def append(df: DataFrame, more: DataFrame) -> DataFrame:
    """Rows of both; columns that one side lacks are null."""
    return df.unionByName(more, allowMissingColumns=True)


def sample_head(df: DataFrame, key: str, n: int, seed=1) -> DataFrame:
    """The first n rows in the reproducible order."""
    return df.orderBy(draw(seed, key), key).limit(n)
