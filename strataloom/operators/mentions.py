"""Mentions: extraction protocol, label override, negation propagation, linking, concept sets.

A mention row has report_id, seq, text, category, assertion, mods, cui, cui_text
and scores; extraction models plug in as functions from (report_id, text) rows to
mention rows.  The default extractors match a lexicon, automaton() one of any size.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, vocab
from .workers import ship, stored

Extractor = Callable[[DataFrame], DataFrame]


def lexicon(terms: DataFrame, kind: str = "Observation", size: int = 5) -> Extractor:
    """An extractor of known terms; terms: (term, cui), terms of up to `size` words.  A sentence's assertion follows its words."""

    def extract(reports: DataFrame) -> DataFrame:
        sentences = reports.select("report_id", "text", F.posexplode(F.split("text", r"(?<=[.!?])\s+|\n+")).alias("sentence", "part"))
        tokens = F.filter(F.split(F.lower("part"), r"[^\p{L}\p{N}'-]+"), lambda t: t != "")
        worded = sentences.withColumn("w", tokens).withColumn("assertion", text.negation(F.col("part")))
        grams = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(size)), lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.array_join(F.slice("w", i, n), " "))).otherwise(F.array().cast("array<string>"))))
        found = worded.select("report_id", "text", "sentence", "assertion", F.posexplode(F.array_distinct(grams)).alias("at", "term")).join(terms, "term")
        seq = F.row_number().over(Window.partitionBy("report_id").orderBy("sentence", "at", "cui"))
        span = text.mention_span(F.col("text"), F.col("term"))
        return found.select("report_id", seq.alias("seq"), F.col("term").alias("text"), span.alias("span"), F.concat(F.lit(f"{kind}::"), F.when(F.col("assertion") == "present", "definitely present").when(F.col("assertion") == "absent", "definitely absent").otherwise("uncertain")).alias("category"), "assertion", F.array().cast("array<string>").alias("mods"), "cui", F.col("cui").alias("cui_text"))

    return extract


#: Bytes of terms that go out at once.
PART_BYTES = 32 << 20


def automaton(terms: DataFrame, kind: str | Column = "Observation") -> Extractor:
    """lexicon() for terms of any length, by Aho-Corasick automata: each sentence is read once for all terms of a part; with `sentence`.

    terms: (term, cui), where a term is words joined by single spaces.  Terms are dealt to parts by hash, so that a part,
    which every task gets, has about PART_BYTES; texts are read once a part.  kind: the mentions' category, or a column of term and cui.
    """
    kind = F.lit(kind) if isinstance(kind, str) else kind

    def extract(reports: DataFrame) -> DataFrame:
        spark = reports.sparkSession
        ship(spark)
        known = terms.where("term is not null and term <> ''").groupBy("term").agg(F.array_sort(F.collect_set("cui")).alias("cuis"))
        size = known.agg(F.sum(F.octet_length("term") + F.lit(64))).first()[0] or 0
        parts = max(1, math.ceil(size / PART_BYTES))
        tokens = lambda part: F.filter(F.split(F.lower(part), r"[^\p{L}\p{N}'-]+"), lambda t: t != "")
        sentences = F.split("text", r"(?<=[.!?])\s+|\n+")
        lined = reports.select("report_id", "text", F.transform(sentences, lambda x: F.concat(F.lit(" "), F.array_join(tokens(x), " "), F.lit(" "))).alias("lines"), F.transform(sentences, text.negation).alias("assertions"))
        hit = "struct<sentence: int, n: int, at: int, term: string>"
        id_type = reports.schema["report_id"].dataType.simpleString()

        def searched(part: int) -> DataFrame:
            words = [r[0] for r in known.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).select("term").toLocalIterator()]
            held = spark.sparkContext.broadcast(words)

            def run(batches):
                import ahocorasick

                machine = ahocorasick.Automaton()
                for term in held.value:
                    machine.add_word(f" {term} ", (term, term.count(" ") + 1))
                if len(machine):
                    machine.make_automaton()
                for batch in batches:
                    found = []
                    for lines in batch.column("lines").to_pylist():
                        own = []
                        for i, line in enumerate(lines or []):
                            first = {}
                            for end, (term, n) in machine.iter(line) if len(machine) else ():
                                first.setdefault(term, (n, end))
                            own += [{"sentence": i, "n": n, "at": end, "term": term} for term, (n, end) in first.items()]
                        found.append(own)
                    kinds = pa.list_(pa.struct([("sentence", pa.int32()), ("n", pa.int32()), ("at", pa.int32()), ("term", pa.string())]))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("report_id", "text", "assertions")), pa.array(found, kinds)], ["report_id", "text", "assertions", "hits"])

            return lined.mapInArrow(run, f"report_id {id_type}, text string, assertions array<string>, hits array<{hit}>")

        rows = reduce(DataFrame.unionByName, (searched(part) for part in range(parts)))
        each = rows.select("report_id", "text", "assertions", F.explode("hits").alias("h")).select("report_id", "text", "h.*", F.get("assertions", F.col("h.sentence")).alias("assertion"))
        each = each.join(known, "term").withColumn("cui", F.explode("cuis"))
        seq = F.row_number().over(Window.partitionBy("report_id").orderBy("sentence", "n", "at", "cui"))
        state = F.when(F.col("assertion") == "present", "definitely present").when(F.col("assertion") == "absent", "definitely absent").otherwise("uncertain")
        return each.select("report_id", seq.alias("seq"), F.col("term").alias("text"), text.mention_span(F.col("text"), F.col("term")).alias("span"), F.concat(kind, F.lit("::"), state).alias("category"), "assertion", F.array().cast("array<string>").alias("mods"), "cui", F.col("cui").alias("cui_text"), "sentence")

    return extract


def related(found: DataFrame) -> DataFrame:
    """(report_id, ent, other): mentions of a sentence that are not anatomy, with those that are; found: (report_id, seq, category, sentence)."""
    own = found.where(~F.col("category").startswith("Anatomy")).select("report_id", "sentence", F.col("seq").alias("ent"))
    anatomy = found.where(F.col("category").startswith("Anatomy")).select("report_id", "sentence", F.col("seq").alias("other"))
    return own.join(_dealt(anatomy), ["report_id", "sentence"]).select("report_id", "ent", "other")


def _dealt(rows: DataFrame) -> DataFrame:
    """rows, for a join that shuffles both sides: a stored table of mentions is so small as a file that Spark would broadcast all of it."""
    return rows.hint("merge")


def override_labels(entities: DataFrame, of_note: DataFrame) -> DataFrame:
    """Labels of a note's own pass replace those of its sentences, by lower-cased token; of_note: (report_id, token, label)."""
    note = of_note.groupBy("report_id", F.lower("token").alias("_t")).agg(F.max("label").alias("_label"))
    return entities.withColumn("_t", F.lower("token")).join(_dealt(note), ["report_id", "_t"], "left").withColumn("label", F.coalesce("_label", "label")).drop("_t", "_label")


def propagate_negation(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """An absent entity makes the present ones it relates to absent, except those that relate to a present one.

    entities: (report_id, ent, label); relations: (report_id, ent, other).
    """
    labels = entities.select("report_id", F.col("ent").alias("other"), F.col("label").alias("other_label"))
    related = relations.join(_dealt(labels), ["report_id", "other"])
    anchored = related.where(F.col("other_label").endswith("definitely present")).select("report_id", "ent").distinct()
    absent = entities.where(F.col("label").endswith("definitely absent")).select("report_id", "ent")
    hit = related.join(_dealt(absent), ["report_id", "ent"], "left_semi").where(F.col("other_label").endswith("definitely present")).select("report_id", F.col("other").alias("ent")).distinct()
    hit = hit.join(_dealt(anchored), ["report_id", "ent"], "left_anti").withColumn("_hit", F.lit(True))
    flipped = F.when(F.col("_hit"), F.regexp_replace("label", "definitely present", "definitely absent")).otherwise(F.col("label"))
    return entities.join(_dealt(hit), ["report_id", "ent"], "left").withColumn("label", flipped).drop("_hit")


def modifiers(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(report_id, ent, mods): texts of the anatomy that an entity relates to."""
    anatomy = entities.where(F.col("label").startswith("Anatomy")).select("report_id", F.col("ent").alias("other"), "token")
    return relations.join(_dealt(anatomy), ["report_id", "other"]).groupBy("report_id", "ent").agg(F.array_sort(F.collect_list("token")).alias("mods"))


def inferred(entities: DataFrame, relations: DataFrame, of_note: DataFrame | None = None) -> DataFrame:
    """entities (report_id, ent, token, label) with the labels of the note's own pass, propagated negation, and mods; relations: (report_id, ent, other).

    As propagate_negation() and then modifiers() give them, from relations that meet their entities once: whether a label is anatomy
    doesn't change with its negation.  Further columns of entities stay.
    """
    own = entities if of_note is None else stored(override_labels(entities, of_note))
    none = F.lit(None)
    absent = own.where(F.col("label").endswith("definitely absent")).select("report_id", "ent", F.lit(True).alias("_absent")).distinct()
    others = own.select("report_id", F.col("ent").alias("other"), F.col("label").endswith("definitely present").alias("_present"), F.when(F.col("label").startswith("Anatomy"), F.col("token")).alias("_mod"))
    both = relations.join(_dealt(absent), ["report_id", "ent"], "left").join(_dealt(others), ["report_id", "other"])
    of = lambda key, anchored, mod, hit: F.struct(F.col(key).alias("ent"), anchored.cast("boolean").alias("anchored"), mod.cast("string").alias("mod"), hit.cast("boolean").alias("hit"))
    says = F.array(of("ent", F.col("_present"), F.col("_mod"), none), of("other", none, none, F.col("_absent") & F.col("_present")))
    said = both.select("report_id", F.inline(F.filter(says, lambda x: x["anchored"] | x["hit"] | x["mod"].isNotNull())))
    got = said.groupBy("report_id", "ent").agg(F.bool_or("anchored").alias("_anchored"), F.bool_or("hit").alias("_hit"), F.array_sort(F.collect_list("mod")).alias("mods"))
    flipped = F.when(F.col("_hit") & ~F.coalesce("_anchored", F.lit(False)), F.regexp_replace("label", "definitely present", "definitely absent")).otherwise(F.col("label"))
    out = own.join(_dealt(got), ["report_id", "ent"], "left").withColumns({"label": flipped, "mods": F.coalesce("mods", F.array().cast("array<string>"))})
    return out.drop("_anchored", "_hit")


def link(ranked: DataFrame, types: DataFrame, allowed: dict[str, list[str]] | None = None) -> DataFrame:
    """(mention, cui, rank, allowed) and further columns of ranked: the first hit of each mention whose type is allowed for its category, else the first hit; ranked: (mention, category, rank, cui)."""
    allowed = allowed or vocab.ALLOWED_TYPES
    pairs = [(c, t) for c, ts in allowed.items() for t in ts]
    ok = F.lit(False)
    for c, t in pairs:
        ok = ok | ((F.col("category") == c) & F.col("tui").eqNullSafe(t))
    typed = ranked.join(types, "cui", "left").withColumn("allowed", ok)
    more = [c for c in ranked.columns if c not in ("mention", "category", "rank", "cui")]
    best = typed.groupBy("mention").agg(F.min_by(F.struct("cui", "rank", "allowed", *more), F.struct((~F.col("allowed")).alias("a"), "rank", "cui")).alias("b"))
    return best.select("mention", "b.cui", "b.rank", "b.allowed", *(f"b.{c}" for c in more))


def concept_pairs(mentions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (report_id, concept) of positive and of negated concepts.

    Positive: ids of mentions that are not absent; anatomy counts only in reports
    with a present observation.  Negated: ids of absent mentions.
    """
    kind = text.category_kind(F.col("category"))
    observed = mentions.where((kind == "Observation") & (F.col("assertion") == "present")).select("report_id").distinct()
    ids = F.explode(F.array_compact(F.array("cui", "cui_text"))).alias("concept")
    positive = mentions.where(F.col("assertion") != "absent").withColumn("kind", kind)
    plain = positive.where("kind <> 'Anatomy'").select("report_id", ids)
    anatomy = positive.where("kind = 'Anatomy'").join(observed, "report_id", "left_semi").select("report_id", ids)
    negated = mentions.where(F.col("assertion") == "absent").select("report_id", ids)
    return plain.unionByName(anatomy).distinct(), negated.distinct()


def concept_sets(reports: DataFrame, mentions: DataFrame) -> DataFrame:
    """(report_id, pos, neg): sorted concept arrays; reports without mentions have empty ones."""
    pos, neg = concept_pairs(mentions)
    arrays = lambda p, name: p.groupBy("report_id").agg(F.array_sort(F.collect_set("concept")).alias(name))
    none = F.array().cast("array<string>")
    out = reports.select("report_id").join(arrays(pos, "pos"), "report_id", "left").join(arrays(neg, "neg"), "report_id", "left")
    return out.select("report_id", F.coalesce("pos", none).alias("pos"), F.coalesce("neg", none).alias("neg"))
