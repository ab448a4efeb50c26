"""Scalar functions on labels, mentions and notes, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

CODE = {"present": 1, "absent": 0, "uncertain": -1}


def tokens(label: Column) -> Column:
    """Trimmed, non-empty parts of a pipe-joined label string."""
    return F.filter(F.transform(F.split(label, r"\|"), lambda t: F.trim(t)), lambda t: t != "")


def label_vector(findings: Column, n: int | None = None, classes=vocab.CLASSES) -> Column:
    """0/1 per class: null means the first class; unknown parts are ignored."""
    names = classes[:n]
    parts = tokens(findings)
    one = F.array(*(F.array_contains(parts, c).cast("int") for c in names))
    return F.when(findings.isNull(), F.array(*(F.lit(int(k == 0)) for k in range(len(names))))).otherwise(one)


def vector_findings(vector: Column, classes=vocab.CLASSES) -> Column:
    """Names of the slots that hold 1, joined by comma; none gives the first class."""
    named = F.array_join(F.transform(F.filter(F.arrays_zip(F.array(*map(F.lit, classes)).alias("name"), vector.alias("bit")), lambda x: x["bit"] == 1), lambda x: x["name"]), ", ")
    return F.when(named == "", F.lit(classes[0])).otherwise(named)


def normalize_labels(label: Column) -> Column:
    """Renames the parts of a label string; 'Pleural' beside an effusion goes.  Null stays null."""
    parts = F.transform(tokens(label), lambda t: F.when(t == "Effusion", "Pleural Effusion").otherwise(t))
    kept = F.when(F.array_contains(parts, "Pleural Effusion"), F.filter(parts, lambda t: t != "Pleural")).otherwise(parts)
    names = F.create_map(*(F.lit(x) for pair in vocab.RENAMES.items() for x in pair))
    return F.array_join(F.transform(kept, lambda t: F.coalesce(F.try_element_at(names, t), t)), "|")


def words(note: Column) -> Column:
    return F.filter(F.split(F.lower(note), r"\s+"), lambda t: t != "")


def negation(note: Column) -> Column:
    """Assertion of a short note by its words: uncertain before absent before present."""
    has = lambda keys: F.arrays_overlap(words(note), F.array(*map(F.lit, keys)))
    return F.when(has(vocab.UNCERTAIN_WORDS), "uncertain").when(has(vocab.ABSENCE_WORDS), "absent").otherwise("present")


def is_short(note: Column) -> Column:
    return F.size(words(note)) < 3


def mention_span(note: Column, text: Column) -> Column:
    """struct(start, end) of the first occurrence in any case; -1 if there is none."""
    at = F.instr(F.lower(note), F.lower(text)) - 1
    return F.struct(at.alias("start"), F.when(at >= 0, at + F.length(text)).otherwise(-1).alias("end"))


def decoded_assertion(label: Column) -> Column:
    """Assertion part of a category like 'Observation::definitely present'; 'na' if unknown."""
    kind, state = F.split_part(label, F.lit("::"), F.lit(1)), F.split_part(label, F.lit("::"), F.lit(2))
    known = kind.isin("Observation", "Anatomy")
    return F.coalesce(F.when(known & (state == "definitely present"), "present").when(known & (state == "definitely absent"), "absent").when(known & (state == "uncertain"), "uncertain"), F.lit("na"))


def assertion_code(assertion: Column) -> Column:
    """1 present, 0 absent, -1 uncertain, else null."""
    return F.when(assertion == "present", 1).when(assertion == "absent", 0).when(assertion == "uncertain", -1).cast("int")


def precedence(assertion: Column) -> Column:
    return F.when(assertion == "absent", 3).when(assertion == "present", 2).when(assertion == "uncertain", 1).otherwise(0)


def surface(mods: Column, text: Column) -> Column:
    return F.trim(F.array_join(F.concat(mods, F.array(text)), " "))


def category_kind(category: Column) -> Column:
    return F.split_part(category, F.lit("::"), F.lit(1))


def coverage(report: Column, label: Column) -> Column:
    """Share of the report's concepts that the label covers; 1 for an empty report."""
    return F.when(F.size(report) == 0, 1.0).otherwise(F.size(F.array_intersect(report, label)) / F.greatest(F.size(report), F.lit(1)))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / F.greatest(union, F.lit(1)))


def stamp(ts: Column) -> Column:
    return F.date_format(ts, "ddMMyyyy-HHmmss")


def rewritten_path(path: Column, base: str, suffix: str = ".jpg") -> Column:
    """base + path without its last extension + suffix; no separator is added."""
    return F.concat(F.lit(base), F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(suffix))


def json_of(mention: Column) -> Column:
    return F.to_json(mention)


def trainer_path(path: Column, base: str, suffix: str = ".jpg") -> Column:
    """base/path with its last four characters replaced; an absolute path stands for itself."""
    joined = F.when(path.startswith("/"), path).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), path))
    return F.concat(F.substring(joined, F.lit(1), F.greatest(F.length(joined) - 4, F.lit(0))), F.lit(suffix))
