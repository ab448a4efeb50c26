"""Versioned history, fingerprints and conversation repair against brute force, with nulls, ties, hot keys and clashing names."""

import collections
import hashlib
import itertools
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom.llm import _spark, conversations, fingerprints, history

# ------------------------------------------------------------- 11


def by_day(changes, days):
    """(key, version, valid_from, valid_to, value) of a state for each day; changes: (key, kind, start, days, value, arrival)."""
    out = []
    for key in sorted({c[0] for c in changes if c[0] is not None and c[1] is not None and c[2] is not None}):
        own = [c for c in changes if c[0] == key and c[1] is not None and c[2] is not None]
        arrived = lambda c: (c[5], c[4] is not None, c[4] or "")
        states = []
        for day in days:
            fixes = [c for c in own if c[1] == "correction" and c[3] is not None and c[2] <= day < c[2] + c[3]]
            base = [c for c in own if c[1] in ("update", "delete") and c[2] <= day]
            best = max(fixes, key=arrived) if fixes else max(base, key=lambda c: (c[2], arrived(c))) if base else None
            states.append(None if best is None or best[1] == "delete" else (best[4],))
        version = 0
        for state, run in itertools.groupby(zip(days, states), key=lambda x: x[1]):
            run = list(run)
            if state is not None:
                version += 1
                out.append((key, version, run[0][0], None if run[-1][0] == days[-1] else run[-1][0] + 1, state[0]))
    return out


def changes_of(rng, n, keys):
    rows = []
    for i in range(n):
        kind = rng.choice(["update", "update", "delete", "correction", "correction"])
        rows.append((rng.choice(keys), kind, rng.randrange(-20, 60), rng.choice([0, 1, 3, 9, 30]), rng.choice(["a", "b", None]), i))
    return rows


@pytest.mark.parametrize("page", [4, 64])
def test_history_equals_a_state_a_day(spark, page):
    rng = random.Random(page)
    rows = changes_of(rng, 150, ["x", "y", "z"]) + changes_of(rng, 300, ["hot"])
    rows += [rows[0], (None, "update", 1, 1, "a", 900), ("n", None, 1, 1, "a", 901), ("m", "update", None, 1, "a", 902), ("c", "correction", 5, None, "a", 903), ("d", "delete", 5, 0, None, 904)]
    df = spark.createDataFrame(rows, "k string, kind string, start long, value_days int, value string, page long").withColumn("shard", F.lit(1))
    got = history.history(df, F.col("k"), F.col("kind"), F.col("start"), F.col("value_days"), F.col("value"), [F.col("page")], page, 50)
    want = by_day(rows, range(-25, 120))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert history.history(df.limit(0), F.col("k"), F.col("kind"), F.col("start"), F.col("value_days"), F.col("value"), [F.col("page")]).count() == 0


def test_history_of_a_hot_key_is_folded_before_it_is_dealt(spark):
    df = spark.range(40_000).select(F.lit(1).alias("k"), (F.col("id") % 100).alias("start"), F.col("id").alias("a"))
    rows = df.select("k", F.lit(0).alias("kind"), F.col("start").alias("lo"), F.lit(None).cast("long").alias("hi"), F.struct(F.struct("a").alias("arrived"), F.lit(False).alias("deleted"), F.col("a").cast("string").alias("value")).alias("m"))
    with _spark.collecting() as made:
        points = history.change_points(rows).collect()
    assert spark.read.parquet(made[0]).count() == 100
    assert {p["value"] for p in points if p["present"]} == {str(39_900 + i) for i in range(100)}


def test_history_query_takes_nulls_and_equals_its_sql(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.choice(["a", "b", None])) for i in range(300)] + [(None, "a"), (-7, "b"), (-25, None)]
    spark.createDataFrame(rows, "doc_id long, source string").withColumn("text", F.lit("t")).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = history.op11_history(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(history.ORACLE_SQL).select(", ".join(got.columns)).fetchall(), key=str)


# ------------------------------------------------------------- 12


def cuts(text):
    """Leaves as (first, end, level) by a walk over words."""
    words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]
    hashes = [int(h) for h in fingerprints._text.Words(fingerprints.pa.array([text])).hash]
    at, since = ([(0, 3)] if text else []), 0
    for i, (start, end) in enumerate(words):
        if i:
            since += 1
            lines = text[words[i - 1][1] : start].count("\n")
            cut = hashes[i - 1] % fingerprints.CUT == 0 and (i == 1 or hashes[i - 1] != hashes[i - 2])
            level = min(lines + 1, 3) if lines else int(cut)
            if level or since % fingerprints.LEAF_WORDS == 0:
                at.append((start, max(level, 1)))
            if level:
                since = 0
        size, last = 0, start
        for p in range(start, end):  # long words
            if size >= (p > last) * fingerprints.LONG_WORD and p > start and size >= fingerprints.LONG_WORD:
                at.append((p, 1))
                size -= fingerprints.LONG_WORD
            size += len(text[p].encode())
    return at


def naive(text):
    at = cuts(text)
    d = lambda b: hashlib.blake2b(b, digest_size=16).digest()
    leaves = [(d(text[a:b].encode()), b - a, level) for (a, level), (b, _) in zip(at, at[1:] + [(len(text), 0)])]
    sections, paragraphs, own = [], [], []
    for i, (leaf, size, _) in enumerate(leaves):
        own.append((leaf, size))
        after = leaves[i + 1][2] if i + 1 < len(leaves) else 3
        if after > 1:
            p = d(b"p" + b"".join(x for x, _ in own))
            paragraphs.append((p, own))
            own = []
            if after == 3 or p[0] % fingerprints.CUT == 0:
                sections.append((d(b"s" + b"".join(x for x, _ in paragraphs)), [o for _, o in paragraphs]))
                paragraphs = []
    root = d(b"r" + b"".join(x for x, _ in sections))
    return root.hex() + ":" + "/".join(";".join(",".join(f"{x[:4].hex()}.{n}" for x, n in p) for p in s) for _, s in sections)


def texts(n=60):
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 7)))
    out = ["".join(word() + rng.choice([" "] * 12 + ["\n", ". \n", "\n\n", "\t"]) for _ in range(rng.choice([2, 9, 80, 400]))) for _ in range(n)]
    return out + ["", " \n ", "  lead", "go " * 200, "a" * 2000, "é" * 700 + " x", "x\n\n\ny", "one"]


def test_trees_equal_a_walk_over_words():
    every = texts()
    for text, tree in zip(every, fingerprints.trees(every)):
        assert tree.fingerprint() == naive(text)
        spans = [(start, size) for _, ps in tree.sections for _, leaves in ps for _, start, size in leaves]
        assert [s for s, _ in spans] == [sum(n for _, n in spans[:i]) for i in range(len(spans))] and sum(n for _, n in spans) == len(text)
    assert [t.fingerprint() for t in fingerprints.trees([None, ""])] == [naive("")] * 2


def expected(rows):
    order = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, hashlib.md5(r[1].encode()).hexdigest()))
    out = []
    for (i, text), (_, after) in zip(order, order[1:] + order[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, new, other = map(naive, (text, edited, after))
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), own, new, round(fingerprints.likeness(own, new), 9), round(fingerprints.likeness(own, other), 9)))
    return collections.Counter(out)


@pytest.mark.parametrize("many", [3, 10_000])
def test_with_next_equals_brute_force(spark, many):
    every = texts()
    rows = [(i, t) for i, t in enumerate(every)] + [(None, "no id"), (7, "the same id"), (5, None), (5, None)] + [(30, "copied text here")] * 40 + [(0, every[0])] * 3
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"bucket": F.lit(1), "md": F.lit("x"), "last": F.lit(True)}).repartition(5)
    got = fingerprints.with_next(df, many)
    assert collections.Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got.collect()) == expected(rows)


def test_with_next_of_one_row_of_none_and_of_text_ids(spark):
    one = spark.createDataFrame([("a-1", "abcd ef")], "doc_id string, text string")
    (r,) = fingerprints.with_next(one).collect()
    assert (r["doc_id"], r["near_next"]) == ("a-1", 1.0) and r["edited_sha256"] == hashlib.sha256(b"abcdabc").hexdigest()
    assert fingerprints.with_next(one.limit(0)).count() == 0
    assert fingerprints.fingerprints(one.limit(0)).count() == 0


def test_edits_are_located(spark):
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefgh ") for _ in range(60)) for _ in range(200)]
    text = "\n".join(lines)
    at = sum(len(x) + 1 for x in lines[:77])
    changed = text[:at] + "something else" + text[at + len(lines[77]) :]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    got = fingerprints.edits(frame([(1, text), (2, text), (3, None)]), frame([(1, changed), (2, text), (3, "")])).collect()
    assert {r["doc_id"] for r in got} == {1}
    before = [(r["start"], r["end"]) for r in got if r["side"] == "before"]
    assert min(a for a, _ in before) <= at < max(b for _, b in before) and sum(b - a for a, b in before) < 300
    assert any(a <= at < b for a, b in ((r["start"], r["end"]) for r in got if r["side"] == "after"))
    f = {r["doc_id"]: r["fingerprint"] for r in fingerprints.fingerprints(frame([(1, text), (2, changed), (3, "qqq")])).collect()}
    assert 0.9 < fingerprints.likeness(f[1], f[2]) < 1 and fingerprints.likeness(f[1], f[1]) == 1 and fingerprints.likeness(f[1], f[3]) == 0


# ------------------------------------------------------------- 13


def cheapest(rows, most=3):
    """All repairs of rows (initial, fault) with few inserts, by exhaustion: (cost, audit, roles)."""
    best = None

    def go(i, inserted, cost, audit, initials):
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", initials):
            if best is None or (cost, audit) < best[:2]:
                best = (cost, audit, initials)
        if i < len(rows):
            initial, fault = rows[i]
            go(i + 1, inserted, cost + 2, audit + "D", initials)
            if fault in (0, 3):
                more = 5 * (fault == 3)
                go(i + 1, inserted, cost + more, audit + "K", initials + (initial or "?"))
                for to in "ua":
                    go(i + 1, inserted, cost + 1 + more, audit + "R", initials + to)
        if inserted < most:
            for to in "ua":
                go(i, inserted + 1, cost + 5, audit + "I", initials + to)

    go(0, 0, 0, "", "")
    return best


def test_repair_is_the_cheapest_and_ascii_least():
    rng = random.Random(1)
    for _ in range(250):
        rows = [(rng.choice(["s", "u", "u", "a", "a", "t", ""]), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(rng.randrange(0, 6))]
        costs = conversations.costs_to_go(rows)
        edits, _ = conversations.walk(rows, costs, 0, True)
        assert (costs[0][0], "".join(e for e, _ in edits)) == cheapest(rows)[:2]


TALK = "conv_id long, turn long, role string, text string"


def talks():
    rng = random.Random(13)
    rows = []
    for c in [*range(60), None]:
        for t in range(rng.choice([1, 2, 5, 9, 40]) if c != 3 else 300):
            turn = None if rng.random() < 0.05 else t + 2 * (rng.random() < 0.1)
            rows.append((c, turn, rng.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), rng.choice(["a b.", "same?", "cut", " \n", None, f"é {t}!", f"{t} x  "])))
    return rows + [(5, 1, "user", "again.")] * 4


@pytest.mark.parametrize("most, block", [(4096, 16_384), (3, 4), (1, 1)])
def test_repair_in_blocks_equals_its_sql(spark, tmp_path, most, block):
    rows = spark.createDataFrame(talks(), TALK).repartition(4).withColumns({"slice": F.lit(1), "kind": F.lit("x")})
    rows.write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{tmp_path}/conversations.parquet/*.parquet')")
    stored = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    got = conversations.repair(conversations.damaged(stored), most, block=block)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(con.sql(conversations.ORACLE_SQL).select(", ".join(got.columns)).fetchall(), key=str)


def test_repaired_turns_are_what_was_hashed(spark):
    rows = conversations.damaged(spark.createDataFrame(talks(), TALK))
    for most, block in ((4096, 16_384), (3, 4)):
        turns = collections.defaultdict(list)
        for r in conversations.repaired_turns(rows, most, block=block).collect():
            turns[r["conv_id"]].append((tuple(r["place"]), f"{r['role']}:{r['text']}"))
        for r in conversations.repair(rows, most, block=block).collect():
            assert hashlib.sha256("\n".join(x for _, x in sorted(turns[r["conv_id"]])).encode()).hexdigest() == r["repaired_sha256"]


def test_no_conversations(spark):
    assert conversations.repair(conversations.damaged(spark.createDataFrame([], TALK))).count() == 0
    long = [(1, t, "user" if t % 2 else "assistant", "x " * 200_000 + ".") for t in range(1, 5)]
    (r,) = conversations.repair(spark.createDataFrame(long, TALK), most_bytes=1 << 18).collect()
    assert (r["audit"], r["cost"], r["duplicate"]) == ("KKDD", 4, 2)


# ------------------------------------------------------------- ids that are texts, and what stages leave


def test_ids_may_be_texts(spark, tmp_path):
    from strataloom.llm import ngram_join, substring_dedup, warc

    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [("b-2", " ".join(base)), ("a-1", " ".join(base)), ("c 3", " ".join(base[:-1] + ["zz"])), (None, "alone here"), ("d", None), ("", "x y z")]
    docs = spark.createDataFrame(rows, "doc_id string, text string").withColumn("n", F.lit(5))
    got = {r["doc_id"]: (r["class_id"], r["copy_of"], r["n_copies"], r["n_links"]) for r in ngram_join.join(docs).collect()}
    assert got == {"b-2": ("a-1", "a-1", 2, 1), "a-1": ("a-1", "a-1", 2, 1), "c 3": ("a-1", "c 3", 1, 1), None: (None, None, 1, 0), "d": ("d", "d", 1, 0), "": ("", "", 1, 0)}
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {"a-1", None, "d", ""}
    removed = {r["doc_id"]: r["n_removed"] for r in substring_dedup.measure(docs).collect()}
    assert removed == {"b-2": 120, "a-1": 120, "c 3": 119, None: 0, "d": 0, "": 0}
    pages = [("a\r\nb", "http://x", "same"), ("", None, "same"), (None, None, "other"), ("%", "http://y", "more"), ("é b>", "z", "y" * 300_000)]
    frame = spark.createDataFrame(pages, "page_id string, url string, html string").withColumn("archive", F.lit(1))
    back = warc.read(warc.write(warc.classify(frame)), "string").collect()
    assert {r["page_id"] for r in back} == {p[0] for p in pages} and len(back) == len(pages)
    assert {r["page_id"]: r["refers_to"] for r in back if r["record_type"] == "revisit"} == {"": "a\r\nb"}


def test_interleaved_stages_keep_what_their_results_read(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(3)
    some = lambda n: spark.createDataFrame([(i, " ".join(rng.choice("abcdefgh") * 3 for _ in range(40)), "en", "s", 1) for i in range(n)], "doc_id long, text string, lang string, source string, n_chars long")
    a = corpus_pipeline.near_copies(spark, some(20), str(tmp_path))
    b = corpus_pipeline.near_copies(spark, some(30), str(tmp_path))
    c = corpus_pipeline.substring(spark, a, str(tmp_path))
    assert (a.count(), b.count(), c.count()) == (20, 30, 20)
