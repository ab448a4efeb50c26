"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each text: the ledger stores the measurements
and one failure bit per rule.  A policy is a versioned set of rules, that is a
mask; applying it, or asking what each rule alone decides (ablation), is bitwise
arithmetic on the ledger and never reads the texts again.

A rule never changes: a new wording is a new rule with a bit of its own, so ledgers
that were written before keep their meaning, and every policy version its verdicts.

Defined results: a null text counts as one without words, so it fails the word
count; repeated rows and equal ids are judged row by row; a text of any length is
measured whole; an ablation has a row for each rule of the policy, of zeros without texts.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark, _text

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_upper_words")
#: Bit, name, and failure as SQL over the measures; the SQL is the same in Spark and DuckDB.
RULES = (
    (0, "few_words", "n_words < 50"),
    (1, "repeated_windows", "100 * n_repeat_words > 50 * n_words"),
    (2, "symbols", "10 * n_symbols > 3 * n_words"),
    (3, "duplicate_lines", "100 * n_dup_lines > 30 * n_lines"),
    (4, "shouting", "100 * n_upper_words > 30 * n_words"),
    (5, "word_length", "word_chars > 20 * n_words OR word_chars < 2 * n_words"),
    (6, "many_words", "n_words > 1000000"),
    (7, "many_duplicate_lines", "n_dup_lines > 2 AND 100 * n_dup_lines > 30 * n_lines"),
)
#: Version -> rules in force.  Version 1 is the base; version 2 rejected short texts for a single repeated line, so
#: version 3, which is in production, asks for three.
POLICIES = {
    1: ("few_words", "repeated_windows"),
    2: ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "word_length", "many_words"),
    3: ("few_words", "repeated_windows", "symbols", "many_duplicate_lines", "shouting", "word_length", "many_words"),
}
PRODUCTION = 3

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


def _distinct(row: np.ndarray, h: np.ndarray, rows: int) -> np.ndarray:
    """Distinct values of h in each row."""
    keyed = _text.mix(h + row.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    _, first = np.unique(keyed, return_index=True)
    return np.bincount(row[first], minlength=rows)


def measure_chunk(column) -> dict[str, np.ndarray]:
    """The measures of each text of a chunk."""
    w = _text.Words(column)
    rows, data, offs = w.rows(), w.data, w.offs
    lead = (data & 0xC0) != 0x80
    space = _text.SPACES[data]
    out = {
        "n_words": w.count.astype(np.int64),
        "word_chars": _text.row_sums(lead & ~space, offs),
        "n_symbols": _text.row_sums(_SYMBOL[data], offs),
    }
    lines = _text.Words(column, _NEWLINE)
    inside = np.zeros(len(data) + 1, np.int64)
    np.cumsum(~space, out=inside[1:])
    full = inside[lines.end] > inside[lines.start]
    out["n_lines"] = np.bincount(lines.row[full], minlength=rows)
    out["n_dup_lines"] = out["n_lines"] - _distinct(lines.row[full], lines.hash[full], rows)
    ok = np.flatnonzero(_text.window_ok(w.row, 3))
    key = _text.mix(_text.window_hash(w.hash, 3)[ok] + w.row[ok].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    order = np.argsort(key)
    same = np.zeros(len(order) + 1, bool)
    same[1:-1] = key[order[1:]] == key[order[:-1]]
    repeated = ok[order[same[:-1] | same[1:]]]
    out["n_repeat_words"] = np.bincount(w.row, weights=_text.cover(repeated, 3, len(w.hash)), minlength=rows).astype(np.int64)
    upper, lower = np.zeros(len(data) + 1, np.int64), np.zeros(len(data) + 1, np.int64)
    np.cumsum((data >= 0x41) & (data <= 0x5A), out=upper[1:])
    np.cumsum((data >= 0x61) & (data <= 0x7A), out=lower[1:])
    shout = (upper[w.end] - upper[w.start] >= 2) & (lower[w.end] == lower[w.start])
    out["n_upper_words"] = np.bincount(w.row, weights=shout, minlength=rows).astype(np.int64)
    return out


def measure(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, measures) of every whole text."""

    def run(batches):
        for part in _text.chunks(batches):
            got = measure_chunk(part.column("text"))
            yield pa.RecordBatch.from_arrays([part.column(key), *(pa.array(got[m].astype(np.int64)) for m in MEASURES)], [key, *MEASURES])

    rows = docs.select(key, F.col("text").cast("string").alias("text"))
    return _spark.arrow_map(rows, run, f"{key} {_spark.id_type(docs, key)}, " + ", ".join(f"{m} long" for m in MEASURES))


def ledger(docs: DataFrame, key: str = "doc_id", rules=RULES) -> DataFrame:
    """measure() with fail_bits, one bit for each rule that the text fails."""
    bits = [F.when(F.expr(sql), F.lit(1 << bit)).otherwise(F.lit(0)).cast("long") for bit, _, sql in rules]
    return measure(docs, key).withColumn("fail_bits", reduce(lambda a, b: a.bitwiseOR(b), bits))


def mask(version: int, rules=RULES, policies=None) -> int:
    """The policy's rules as a bitmask."""
    names = set((policies or POLICIES)[version])
    return sum(1 << bit for bit, name, _ in rules if name in names)


def apply_policy(entries: DataFrame, version: int = PRODUCTION, rules=RULES, policies=None) -> DataFrame:
    """The ledger with the policy's verdict: kept, and policy_version."""
    bits = F.lit(mask(version, rules, policies)).cast("long")
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(bits) == 0).withColumn("policy_version", F.lit(version))


def ablation(entries: DataFrame, version: int = PRODUCTION, rules=RULES, policies=None) -> DataFrame:
    """For each rule of the policy: texts that fail it, and those that only it rejects; one aggregation of the ledger's bits."""
    bits = mask(version, rules, policies)
    active = [(bit, name) for bit, name, _ in rules if bits >> bit & 1]
    failed = F.col("fail_bits").bitwiseAND(F.lit(bits).cast("long"))
    sums = [F.sum((failed.bitwiseAND(F.lit(1 << b).cast("long")) != 0).cast("long")).alias(f"f{b}") for b, _ in active]
    alone = [F.sum((failed == (1 << b)).cast("long")).alias(f"a{b}") for b, _ in active]
    row = entries.agg(*sums, *alone)
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(f"f{b}", F.lit(0)).alias("n_failed"), F.coalesce(f"a{b}", F.lit(0)).alias("n_only")) for b, n in active))))


def quality_ablation(spark, sf_dir: str) -> DataFrame:
    """The production policy's ablation over all documents."""
    return ablation(ledger(_spark.table(spark, sf_dir, "documents")))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    base = F.col("fail_bits").bitwiseAND(F.lit(mask(1)).cast("long")) != 0
    judged = apply_policy(ledger(_spark.table(spark, sf_dir, "documents")))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return judged.select("doc_id", *names, base.alias("base_failed"), (~base & F.col("kept")).alias("kept"), "n_lines", "n_upper_words", "fail_bits", "policy_version")


_CASES = " + ".join(f"CASE WHEN {sql} THEN {1 << bit} ELSE 0 END" for bit, _, sql in RULES)
ORACLE_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT r, doc_id, text, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM d),
l AS (SELECT r, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
      FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY r),
g AS (SELECT r, i, list_slice(w, i, i + 2) AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) >= 3)),
rep AS (SELECT r, count(DISTINCT k) AS n_repeat_words FROM (
        SELECT r, unnest(range(i, i + 3)) AS k FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n >= 2) GROUP BY r),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
      (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
      coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
      len(list_filter(w, lambda x: regexp_matches(x, '[A-Z].*[A-Z]') AND NOT regexp_matches(x, '[a-z]')))::BIGINT AS n_upper_words
      FROM t LEFT JOIN l USING (r) LEFT JOIN rep USING (r)),
b AS (SELECT *, ({_CASES})::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & {mask(1)}) <> 0 AS base_failed,
       (fail_bits & {mask(1)}) = 0 AND (fail_bits & {mask(PRODUCTION)}) = 0 AS kept, n_lines, n_upper_words, fail_bits, {PRODUCTION}::INTEGER AS policy_version
FROM b
"""
_BITS = mask(PRODUCTION)
_ACTIVE = ", ".join(f"({bit}, '{name}')" for bit, name, _ in RULES if _BITS >> bit & 1)
ABLATION_SQL = f"""
WITH entry AS ({ORACLE_SQL})
SELECT rule, coalesce(sum((fail_bits >> bit) & 1), 0)::BIGINT AS n_failed, coalesce(sum(((fail_bits & {_BITS}) = (1 << bit))::INTEGER), 0)::BIGINT AS n_only
FROM (VALUES {_ACTIVE}) r(bit, rule) LEFT JOIN entry ON true GROUP BY rule
"""
