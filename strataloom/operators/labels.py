"""Labels from mentions, label tables, and the reconciliation of two label sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab


def _has(name: Column, label: Column) -> Column:
    return F.coalesce(F.contains(F.lower(name), F.lower(label)), F.lit(False))


def direct(mentions: DataFrame, names: DataFrame, labels: list[str] = vocab.LABELS) -> DataFrame:
    """(report_id, seq, assertion, label, score): the best label in the names of a mention's two concepts; the earlier label wins ties.

    Names are searched once each: the first label in a name is the one that can win with its score.
    """
    first = F.coalesce(*(F.when(_has(F.col("name"), F.lit(x)), k) for k, x in enumerate(labels)))
    known = names.select("cui", first.alias("_first"))
    by = lambda c, out: known.select(F.col("cui").alias(c), F.col("_first").alias(out))
    named = mentions.join(by("cui", "_surface"), "cui", "left").join(by("cui_text", "_text"), "cui_text", "left")
    a, b = (F.when(F.col(c).isNotNull(), F.coalesce(s, F.lit(0.0))).otherwise(0.0) for c, s in (("_text", "score_text"), ("_surface", "score_surface")))
    named = named.withColumns({"_a": a, "_b": b})
    place = F.when(F.col("_a") > F.col("_b"), F.col("_text")).when(F.col("_b") > F.col("_a"), F.col("_surface")).otherwise(F.least("_text", "_surface"))
    label = F.get(F.array(*map(F.lit, labels)), place)
    return named.withColumn("score", F.greatest("_a", "_b")).where("score > 0").select("report_id", "seq", "assertion", label.alias("label"), "score")


def broader(mentions: DataFrame, found: DataFrame, parents: DataFrame, names: DataFrame, labels: list[str] = vocab.LABELS) -> DataFrame:
    """(report_id, seq, assertion, label): for mentions without a direct label, all labels in the names of any parent; parents: (cui, parent)."""
    rest = mentions.join(found.select("report_id", "seq"), ["report_id", "seq"], "left_anti")
    ids = rest.select("report_id", "seq", "assertion", F.explode(F.array_distinct(F.array_compact(F.array("cui", "cui_text")))).alias("cui"))
    up = ids.join(parents, "cui").join(names.select(F.col("cui").alias("parent"), "name"), "parent")
    hits = F.filter(F.array(*map(F.lit, labels)), lambda x: _has(F.col("name"), x))
    return up.select("report_id", "seq", "assertion", F.explode(hits).alias("label")).distinct()


def strongest(found: DataFrame) -> DataFrame:
    """(report_id, label, assertion): the assertion of highest precedence."""
    return found.groupBy("report_id", "label").agg(F.max_by("assertion", F.struct(text.precedence(F.col("assertion")), "assertion")).alias("assertion"))


def _all_labels(mentions: DataFrame, names: DataFrame, parents: DataFrame, labels: list[str]) -> DataFrame:
    """(report_id, label, assertion) of direct() and broader(): names are searched once a concept, and a mention meets its two concepts once."""
    first = F.coalesce(*(F.when(_has(F.col("name"), F.lit(x)), k) for k, x in enumerate(labels)), F.lit(-1))
    firsts = names.groupBy("cui").agg(F.collect_set(first).alias("firsts"))
    hits = F.filter(F.array(*map(F.lit, labels)), lambda x: _has(F.col("name"), x))
    ups = parents.join(names.select(F.col("cui").alias("parent"), F.explode(hits).alias("up")), "parent").groupBy("cui").agg(F.collect_set("up").alias("ups"))
    known = firsts.join(ups, "cui", "full")
    by = lambda c, out: known.select(F.col("cui").alias(c), F.col("firsts").alias(f"_f{out}"), F.col("ups").alias(f"_u{out}"))
    met = mentions.join(by("cui", "s"), "cui", "left").join(by("cui_text", "t"), "cui_text", "left")
    none, unnamed = F.array().cast("array<string>"), F.array(F.lit(-1))

    def won(t: Column, s: Column) -> Column:  # the place of the label of one pair of names
        a, b = (F.when(x >= 0, F.coalesce(F.col(c), F.lit(0.0))).otherwise(0.0) for x, c in ((t, "score_text"), (s, "score_surface")))
        known_ = lambda x: F.when(x >= 0, x)
        return F.when(F.greatest(a, b) > 0, F.when(a > b, t).when(b > a, s).otherwise(F.least(known_(t), known_(s))))

    pairs = F.flatten(F.transform(F.coalesce("_ft", unnamed), lambda t: F.transform(F.coalesce("_fs", unnamed), lambda s: won(t, s))))
    own = F.transform(F.array_distinct(F.array_compact(pairs)), lambda k: F.get(F.array(*map(F.lit, labels)), k))
    rows = met.select("report_id", "seq", "assertion", own.alias("own"), F.array_union(F.coalesce("_us", none), F.coalesce("_ut", none)).alias("ups")).where("size(own) > 0 or size(ups) > 0")
    some = F.max(F.size("own") > 0).over(Window.partitionBy("report_id", "seq")) & F.col("report_id").isNotNull() & F.col("seq").isNotNull()
    rows = rows.withColumn("_some", some)
    return rows.select("report_id", F.explode(F.when(F.col("_some"), F.col("own")).otherwise(F.array_union("own", "ups"))).alias("label"), "assertion")


def report_labels(reports: DataFrame, mentions: DataFrame, names: DataFrame, parents: DataFrame, labels: list[str] = vocab.LABELS) -> DataFrame:
    """(report_id, label, assertion) of every report; one without a label gets a present 'No Finding'."""
    got = strongest(_all_labels(mentions, names, parents, labels))
    return reports.select("report_id").distinct().join(got, "report_id", "left").select("report_id", F.coalesce("label", F.lit("No Finding")).alias("label"), F.when(F.col("label").isNull(), "present").otherwise(F.col("assertion")).alias("assertion"))


def label_table(found: DataFrame, labels: list[str], use_uncertain: bool = False) -> DataFrame:
    """(report_id, finding_labels, one code column per label): 1 present, 0 absent, -1 uncertain, null otherwise."""
    coded = found.withColumn("code", text.assertion_code(F.col("assertion")))
    kept = F.col("code") != 0 if use_uncertain else F.col("code") == 1
    codes = [F.max(F.when(F.col("label") == x, F.col("code"))).alias(x) for x in labels]
    wide = coded.groupBy("report_id").agg(F.array_join(F.array_sort(F.collect_set(F.when(kept, F.col("label")))), "|").alias("_s"), *codes)
    return wide.select("report_id", F.when(F.col("_s") == "", "No Finding").otherwise(F.col("_s")).alias("finding_labels"), *(F.col(f"`{x}`") for x in labels))


def label_concepts(mentions: DataFrame, names: DataFrame, types: DataFrame, seeds: DataFrame, label_names: dict[str, str] | None = None) -> DataFrame:
    """Distinct (label, cui): the seeds, and mentioned concepts whose name contains the label's name or that are devices.

    seeds: (label, cui) with a null cui for a label without one.
    """
    renamed = label_names or vocab.LABEL_NAMES
    pairs = F.create_map(*(F.lit(x) for p in renamed.items() for x in p))
    labels = seeds.select("label").distinct().withColumn("needle", F.lower(F.coalesce(F.try_element_at(pairs, F.col("label")), F.col("label"))))
    used = mentions.select(F.explode(F.array_compact(F.array("cui", "cui_text"))).alias("cui")).distinct()
    by_name = used.join(names, "cui").join(F.broadcast(labels), F.contains(F.lower("name"), F.col("needle"))).select("label", "cui")  # a row per label name
    devices = used.join(types.where(F.col("tui") == vocab.DEVICE_TYPE), "cui").select(F.lit("Support Devices").alias("label"), "cui")
    return seeds.where("cui is not null").select("label", "cui").unionByName(by_name).unionByName(devices).distinct()


def string_concepts(rows: DataFrame, column: str, concepts: DataFrame) -> DataFrame:
    """Distinct (column, cui): the concepts of the parts of each different label string."""
    parts = rows.select(column).distinct().select(column, F.explode(text.tokens(F.col(column))).alias("label"))
    return parts.join(concepts, "label").select(column, "cui").distinct()


def concepts_of(rows: DataFrame, column: str, concepts: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, cuis): union of the concepts of a label string's parts, made once a string; unknown parts have none, null is empty; keys are distinct."""
    got = string_concepts(rows, column, concepts).groupBy(column).agg(F.array_sort(F.collect_list("cui")).alias("cuis"))
    return rows.select(key, column).join(got, column, "left").select(key, F.coalesce("cuis", F.array().cast("array<string>")).alias("cuis"))


def choose(rows: DataFrame, present: DataFrame, concepts: DataFrame, key: str = "report_id") -> DataFrame:
    """(key, choice, label): of two label strings, their common or all parts, what covers the report's present concepts best.

    rows: (key, label1, label2); present: (key, concept); concepts: (label, cui).
    Ties go to label1, label2, intersection, union in this order; equal strings are kept as they are.
    """
    two = rows.select(key, F.coalesce("label1", F.lit("")).alias("label1"), F.coalesce("label2", F.lit("")).alias("label2"))
    t1, t2 = text.tokens(F.col("label1")), text.tokens(F.col("label2"))
    two = two.withColumns({"t1": t1, "t2": t2}).withColumns({"ti": F.array_intersect("t1", "t2"), "tu": F.array_distinct(F.concat("t1", "t2"))})
    sets = present.groupBy(key).agg(F.collect_set("concept").alias("_p"))
    hits = present.distinct().join(concepts.withColumnRenamed("cui", "concept"), "concept").groupBy(key, "label").agg(F.collect_set("concept").alias("c"))
    cover = hits.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("label", "c"))).alias("_m"))
    all_ = two.join(sets, key, "left").join(cover, key, "left")
    none = F.array().cast("array<string>")

    def score(tokens: str) -> Column:
        got = F.array_distinct(F.flatten(F.transform(F.col(tokens), lambda t: F.coalesce(F.try_element_at("_m", t), none))))
        n = F.size(F.coalesce("_p", none))
        return F.when(n == 0, 1.0).otherwise(F.when(F.col("_m").isNull(), 0).otherwise(F.size(got)) / F.greatest(n, F.lit(1)))

    scored = all_.withColumns({"s1": score("t1"), "s2": score("t2"), "si": F.when(F.size("ti") > 0, score("ti")).otherwise(-1.0), "su": score("tu")})
    top = F.greatest("s1", "s2", "si", "su")
    choice = F.when(F.col("label1") == F.col("label2"), "identical").when(F.col("s1") == top, "label1").when(F.col("s2") == top, "label2").when(F.col("si") == top, "intersection").otherwise("union")
    scored = scored.withColumn("choice", choice)
    label = F.when(F.col("choice").isin("identical", "label1"), F.col("label1")).when(F.col("choice") == "label2", F.col("label2")).when(F.col("choice") == "intersection", F.array_join("ti", "|")).otherwise(F.array_join("tu", "|"))
    return scored.select(key, "choice", label.alias("label"))
