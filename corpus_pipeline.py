"""The corpus pipeline: five stages from documents to token digests.

A stage deletes what it wrote to the shared folder on its way, but for small tables that its
result, which is lazy, reads: those of ids that stay.  run() deletes these, too, and the table of
each stage once the next one is written; its own result reads the last of them.

Defined results, for every stage: null or empty texts have no language and go at the
first stage; repeated rows and equal texts are one class, of which a single row stays;
of equal smallest ids the text with the smaller SHA-1 stays; columns besides doc_id and
text are kept whatever their names; empty tables give empty tables; texts of any length
are judged whole.
"""

from __future__ import annotations

import functools
import gc

from pyspark.sql import DataFrame, SparkSession

from strataloom.llm import _spark, decontaminate, language_id, ngram_join, sentence_pieces, substring_dedup


#: Lists of what a stage's result still reads, for the run() that called it.
_KEPT: list[list[str]] = []


def _stage(function):
    """The function, which deletes at once what it wrote on its way and its result doesn't read."""

    @functools.wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with _spark.collecting() as made:
            out = function(spark, docs, sf_dir)
        reads = out.inputFiles() if made else []
        for path in made:
            if not any(path in file for file in reads):
                _spark.drop_path(spark, path)
            elif _KEPT:
                _KEPT[-1].append(path)
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # shuffles that nothing refers to are deleted then
        return out

    return run


@_stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognised language go."""
    return language_id.accept_languages(docs)


@_stage
def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, the document with the smallest id stays."""
    return ngram_join.one_of_each(docs)


@_stage
def substring(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat are taken out of the texts."""
    return substring_dedup.remove_repeats(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Contaminated documents go."""
    return decontaminate.drop_contaminated(docs, _spark.table(spark, sf_dir, "benchmark"))


@_stage
def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, as digests."""
    return sentence_pieces.digest(docs)


STAGES = [("language_id", language), ("ngram_join", near_copies), ("substring_dedup", substring), ("decontamination", decontamination), ("sentencepiece", encoding)]

#: Learned filters, MinHash and a tokenizer: SQL cannot express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    docs, before = _spark.table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        _KEPT.append([])
        try:
            docs = _spark.written(stage(spark, docs, sf_dir), f"stage-{name}")
        finally:
            kept = _KEPT.pop()
        for path in kept:
            _spark.drop_path(spark, path)
        if before is not None:
            _spark.drop_written(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
