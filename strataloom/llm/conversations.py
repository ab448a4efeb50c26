r"""Conversation structure repair.

A conversation's rows become a legal one, whose role initials are `(s?(ua)+)?`, by the
cheapest edits: Keep 0, Rerole to user or assistant 1, Delete 2 (blank and repeated rows have to
go), Insert an empty user or assistant turn 5; a truncated row that stays adds 5.  The cost to go is a
backward DP over turns and the four states of the grammar; a forward walk then takes
the ASCII-least initial among the edits on which the cost is tight.  State and initial
fix the role, so one audit string is one repair.

Rows are sorted once, by conversation and turn, over all tasks by ranges; a task repairs the
conversations that lie inside its range.  Those that are longer than MOST_ROWS or MOST_BYTES or
reach its ends are repaired in blocks of BLOCK rows: a block is a (min, +) matrix from
entry to exit state, matrices give each block the cost to go at its end, then each block its
exits, and those its entry.  Only a block's numbers meet in one task for a
conversation; its texts do so one batch after the other, for the digest, which can't be split.

Defined results: null roles and texts are one space (in damage() null ids and turns too); rows go by
turn, nulls first, equal turns by the MD5 of role and text, and equal rows are
duplicates; a null conversation is one of its own; further columns are left out; texts of any length are
taken whole; no conversations give no rows.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _spark

MOST_ROWS, MOST_BYTES, BLOCK = 4096, 8 << 20, 16_384
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
_FINE, _BLANK, _DUPLICATE, _CUT = 0, 1, 2, 3
_SPACE = " \t\n\x0b\x0c\r"

#: States: 0 nothing yet, 1 after the system turn, 2 after a user turn, 3 after an assistant turn.
_WANTED = ("u", "u", "a", "u")
_GOES = (2, 2, 3, 2)
_NAMES = {"u": "user", "a": "assistant"}
_KEPT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Cost to go after the last row.
_END = (0, 2 * INSERT, INSERT, 0)
_FAR = 1 << 50


def costs_to_go(rows: list[tuple[str, int]], end=_END) -> list[tuple]:
    """The costs to go in each state before each row, and after the last one (end); rows: (initial, fault)."""
    out = [tuple(end)]
    for initial, fault in reversed(rows):
        after, own = out[-1], []
        for state in range(4):
            best = DELETE + after[state]
            if fault != _BLANK and fault != _DUPLICATE:
                more = TRUNCATED if fault == _CUT else 0
                to = _KEPT.get((state, initial))
                best = min(best, REROLE + more + after[_GOES[state]], KEEP + more + after[to] if to is not None else _FAR)
            own.append(best)
        two, three = min(own[2], INSERT + own[3]), min(own[3], INSERT + own[2])
        out.append((min(own[0], INSERT + two), min(own[1], INSERT + two), two, three))
    return out[::-1]


def walk(rows: list[tuple[str, int]], costs: list[tuple], state: int, ends: bool) -> tuple[list[tuple[str, str]], int]:
    """(initial of the edit, role that it gives) in order, and the state at the end; ends: whether the conversation does."""
    edits, i = [], 0
    while True:
        here = costs[i][state]
        if i == len(rows):
            if not ends or here == 0:
                return edits, state
        elif DELETE + costs[i + 1][state] == here:
            edits.append(("D", ""))
            i += 1
            continue
        if INSERT + costs[i][_GOES[state]] == here:
            edits.append(("I", _NAMES[_WANTED[state]]))
            state = _GOES[state]
            continue
        initial, fault = rows[i]
        to = _KEPT.get((state, initial))
        if to is not None and KEEP + (TRUNCATED if fault == _CUT else 0) + costs[i + 1][to] == here:
            edits.append(("K", ""))
            state = to
        else:
            edits.append(("R", _NAMES[_WANTED[state]]))
            state = _GOES[state]
        i += 1


def _turns(edits: list[tuple[str, str]], turns: list[tuple[str, str]]):
    """(edit, role, text) of the repaired turns."""
    rows = iter(turns)
    for edit, role in edits:
        if edit == "I":
            yield edit, role, ""
        else:
            own, text = next(rows)
            if edit != "D":
                yield edit, role or own, text


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def _fault(text: str, seen: bool) -> int:
    text = text.rstrip(_SPACE)
    return _BLANK if not text else _DUPLICATE if seen else _FINE if text[-1] in ".!?" else _CUT


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_RESULT = [*_COUNTS, "audit", "repaired_sha256"]


def _repaired(rows: list[tuple]) -> tuple[dict, list]:
    """What repair() gives for one conversation, and its repaired turns; rows: (turn, role, text, md) in order."""
    seen, marks = set(), []
    for _, role, text, md in rows:
        marks.append((role[:1], _fault(text, md in seen)))
        seen.add(md)
    numbers = {r[0] for r in rows} - {None}
    costs = costs_to_go(marks)
    edits, _ = walk(marks, costs, 0, True)
    turns = list(_turns(edits, [(r[1], r[2]) for r in rows]))
    faults = [f for _, f in marks]
    digest = hashlib.sha256("\n".join(f"{role}:{text}" for _, role, text in turns).encode()).hexdigest()
    counts = (max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0, *map(faults.count, (_BLANK, _DUPLICATE, _CUT)), _illegal([m[0] for m in marks]), costs[0][0])
    return dict(zip(_RESULT, (*counts, "".join(e for e, _ in edits), digest))), turns


def _sorted(rows: DataFrame, most_rows: int, most_bytes: int, with_turns: bool) -> DataFrame:
    """Rows of `kind` 0: results of conversations; 1: rows of those that are still open; 2: repaired turns, if wanted.  rows: (conv_id, turn, role, text, gone)."""
    id_type, parts = _spark.id_type(rows, "conv_id"), _spark.parts(rows.sparkSession)
    rows = rows.withColumn("md", F.md5(F.concat_ws("\0", "role", "text"))).withColumn("row", F.monotonically_increasing_id())
    order = ["conv_id", "turn", "md", "row"]  # the last one so that equal rows can be dealt to several tasks
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("row")
    schema = f"conv_id {id_type}, kind int, slice int, run int, pos long, turn long, role string, text string, md string, gone boolean, edit string, {', '.join(f'{c} long' for c in _COUNTS)}, audit string, repaired_sha256 string"

    def run(batches):
        part, runs, pos = TaskContext.get().partitionId(), -1, 0
        conv, held, size, open_, ready = None, [], 0, True, []

        def closed():
            got, turns = _repaired([r[:4] for r in held if not r[4]])
            ready.append({"conv_id": conv, "kind": 0, **got})
            if with_turns:
                ready.extend({"conv_id": conv, "kind": 2, "pos": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(turns))

        def opened():
            nonlocal pos
            for turn, role, text, md, gone in held:
                ready.append({"conv_id": conv, "kind": 1, "slice": part, "run": runs, "pos": pos, "turn": turn, "role": role, "text": text, "md": md, "gone": gone})
                pos += 1

        for batch in batches:
            for at, *row in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "md", "gone"))):
                if runs < 0 or at != conv:
                    if runs >= 0:
                        opened() if open_ else closed()
                    conv, held, size, runs = at, [], 0, runs + 1
                    open_ = runs == 0  # it may have begun in the task before
                held.append(row)
                size += len(row[2])
                if len(held) >= most_rows or size >= most_bytes:
                    open_ = True
                    opened()
                    held, size = [], 0
                if len(ready) >= 1000 or size >= most_bytes:
                    yield from _batches(ready)
                    ready = []
            yield from _batches(ready)
            ready = []
        if runs >= 0:
            opened()  # it may go on in the next task
        yield from _batches(ready)

    types = pa.schema([("conv_id", rows.sparkSession.createDataFrame([], rows.schema).toArrow().schema.field("conv_id").type), ("kind", pa.int32()), ("slice", pa.int32()), ("run", pa.int32()), ("pos", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("md", pa.string()), ("gone", pa.bool_()), ("edit", pa.string()), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def _batches(ready):
        if ready:
            yield pa.RecordBatch.from_pylist(ready, types)

    return _spark.arrow_map(rows, run, schema)


_BLOCK_KEY = ["slice", "run", "block"]


def _marks(table: pa.Table) -> list[tuple[str, int]]:
    return list(zip(table["initial"].to_pylist(), table["fault"].to_pylist()))


def _block_costs(rows: DataFrame, block: int) -> tuple[DataFrame, DataFrame]:
    """(light rows with initial and fault, blocks with costs to go at their ends and entry states) of open conversations."""
    id_type = _spark.id_type(rows, "conv_id")
    firsts = rows.groupBy("conv_id", "md").agg(F.min(F.struct("slice", "pos")).alias("f")).select("f.slice", "f.pos", F.lit(True).alias("first"))
    stripped = F.rtrim(F.translate("text", "\t\n\x0b\x0c\r", "     "))
    light = rows.select("conv_id", "slice", "run", "pos", "turn", F.substring("role", 1, 1).alias("initial"), stripped.alias("s"))
    light = light.withColumns({"empty": F.col("s") == "", "ends": F.substring("s", -1, 1).isin(".", "!", "?")}).drop("s").join(firsts, ["slice", "pos"], "left")
    fault = F.when(F.col("empty"), _BLANK).when(F.col("first").isNull(), _DUPLICATE).when(F.col("ends"), _FINE).otherwise(_CUT)
    light = _spark.written(light.select("conv_id", "slice", "run", "pos", F.floor(F.col("pos") / block).alias("block"), "turn", "initial", fault.alias("fault")), "conversations-light")

    def matrix(table):
        table = table.sort_by("pos")
        marks = _marks(table)
        columns = [costs_to_go(marks, [0 if s == t else _FAR for s in range(4)])[0] for t in range(4)]
        initials = [m[0] for m in marks]
        one = {"conv_id": table["conv_id"][0].as_py(), **{c: table[c][0].as_py() for c in _BLOCK_KEY}, "first": initials[0], "last": initials[-1], "illegal": _illegal(initials), "costs": [min(columns[t][s], _FAR) for s in range(4) for t in range(4)]}
        return pa.Table.from_pylist([one], schema)

    conv = light.limit(0).toArrow().schema.field("conv_id").type
    schema = pa.schema([("conv_id", conv), ("slice", pa.int32()), ("run", pa.int32()), ("block", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("illegal", pa.int64()), ("costs", pa.list_(pa.int64()))])
    key = f"conv_id {id_type}, slice int, run int, block long"
    matrices = _spark.written(light.groupBy(*_BLOCK_KEY).applyInArrow(matrix, f"{key}, first string, last string, illegal long, costs array<long>"), "conversations-blocks")
    ends_schema = pa.schema([*list(schema)[:4], ("illegal", pa.int64()), ("cost", pa.int64()), ("ends", pa.bool_()), ("end", pa.list_(pa.int64()))])

    def ends(table):
        own = sorted(table.to_pylist(), key=lambda r: (r["slice"], r["block"]))
        after, out = list(_END), []
        for i in reversed(range(len(own))):
            r, m = own[i], own[i]["costs"]
            across = _illegal([own[i - 1]["last"], r["first"]]) if i else 0
            before = [min(m[4 * s + t] + after[t] for t in range(4)) for s in range(4)]
            out.append({c: r[c] for c in ("conv_id", *_BLOCK_KEY)} | {"illegal": r["illegal"] + across, "cost": 0 if i else before[0], "ends": i == len(own) - 1, "end": after})
            after = before
        return pa.Table.from_pylist(out, ends_schema)

    blocks = _spark.written(matrices.groupBy("conv_id").applyInArrow(ends, f"{key}, illegal long, cost long, ends boolean, end array<long>"), "conversations-ends")

    def exits(rows, block):
        marks, one = _marks(rows.sort_by("pos")), block.to_pylist()[0]
        costs = costs_to_go(marks, one["end"])
        return pa.Table.from_pylist([{c: one[c] for c in ("conv_id", *_BLOCK_KEY)} | {"exits": [walk(marks, costs, s, False)[1] for s in range(4)]}], pa.schema([*list(schema)[:4], ("exits", pa.list_(pa.int32()))]))

    def entries(table):
        state, out = 0, []
        for r in sorted(table.to_pylist(), key=lambda r: (r["slice"], r["block"])):
            out.append({c: r[c] for c in _BLOCK_KEY} | {"entry": state})
            state = r["exits"][state]
        return pa.Table.from_pylist(out, pa.schema([*list(schema)[1:4], ("entry", pa.int32())]))

    left = light.groupBy(*_BLOCK_KEY).cogroup(blocks.groupBy(*_BLOCK_KEY)).applyInArrow(exits, f"{key}, exits array<int>")
    entry = left.groupBy("conv_id").applyInArrow(entries, "slice int, run int, block long, entry int")
    return light, _spark.written(blocks.join(entry, _BLOCK_KEY), "conversations-entries")


def _blockwise(rows: DataFrame, block: int, with_turns: bool) -> DataFrame:
    """repair() of open rows, or their repaired turns."""
    id_type = _spark.id_type(rows, "conv_id")
    live = rows.where("not gone")
    light, blocks = _block_costs(live, block)

    def edits(own, block):
        own, one = own.sort_by("pos"), block.to_pylist()[0]
        marks = _marks(own)
        got, _ = walk(marks, costs_to_go(marks, one["end"]), one["entry"], one["ends"])
        out = [{"slice": one["slice"], "pos": p, "edits": [], "roles": []} for p in own["pos"].to_pylist()]
        at = 0
        for edit, role in got:  # what is inserted goes with the next row, at the end with the last one
            out[min(at, len(out) - 1)]["edits"].append(edit)
            out[min(at, len(out) - 1)]["roles"].append(role)
            at += edit != "I"
        return pa.Table.from_pylist(out, pa.schema([("slice", pa.int32()), ("pos", pa.int64()), ("edits", pa.list_(pa.string())), ("roles", pa.list_(pa.string()))]))

    done = light.groupBy(*_BLOCK_KEY).cogroup(blocks.groupBy(*_BLOCK_KEY)).applyInArrow(edits, "slice int, pos long, edits array<string>, roles array<string>")
    done = live.select("conv_id", "slice", "run", "pos", "role", "text").join(_spark.written(done, "conversations-edits"), ["slice", "pos"])
    if with_turns:
        each = done.select("conv_id", "slice", "pos", "role", "text", F.posexplode(F.arrays_zip("edits", "roles")).alias("n", "e")).where("e.edits <> 'D'")
        given = F.when(F.col("e.roles") == "", F.col("role")).otherwise(F.col("e.roles"))
        return each.select("conv_id", F.struct("slice", "pos", "n").alias("place"), F.col("e.edits").alias("edit"), given.alias("role"), F.when(F.col("e.edits") == "I", "").otherwise(F.col("text")).alias("text"))

    def digest(batches):
        conv, sha, turns, begun = None, None, 0, False
        convs, found = [], []
        for batch in batches:
            for at, role, text, marks, roles in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text", "edits", "roles"))):
                if not begun or at != conv:
                    if begun:
                        convs.append(conv)
                        found.append(sha.hexdigest())
                    conv, sha, turns, begun = at, hashlib.sha256(), 0, True
                for edit, given in zip(marks, roles):
                    if edit != "D":
                        sha.update((("\n" if turns else "") + (given or role) + ":" + ("" if edit == "I" else text)).encode())
                        turns += 1
            kind = batch.schema.field("conv_id").type
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array([*convs, conv], kind), pa.array([*found, sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    parts = _spark.parts(rows.sparkSession)
    order = ["conv_id", "slice", "pos"]
    digests = _spark.arrow_map(done.repartition(parts, "conv_id").sortWithinPartitions(*order), digest, f"conv_id {id_type}, repaired_sha256 string")
    text = lambda d, by, name: F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct(*by, name))), lambda x: x[name])).alias(name)
    audits = done.withColumn("audit", F.concat_ws("", "edits")).groupBy("conv_id", "slice", F.floor(F.col("pos") / block).alias("block")).agg(text(done, ["pos"], "audit"))
    audits = audits.groupBy("conv_id").agg(text(audits, ["slice", "block"], "audit"))
    count = lambda fault: F.sum((F.col("fault") == fault).cast("long"))
    faults = light.groupBy("conv_id").agg(count(_BLANK).alias("blank"), count(_DUPLICATE).alias("duplicate"), count(_CUT).alias("truncated"), (F.max("turn") - F.min("turn") + 1).alias("gaps"))
    turns = light.where("turn is not null").select("conv_id", "turn").distinct().groupBy("conv_id").agg((-F.count(F.lit(1))).alias("gaps"))
    totals = blocks.groupBy("conv_id").agg(F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"))
    both = rows.select("conv_id").distinct()
    for one in (faults, turns, totals, audits, digests):
        both = both.unionByName(one, allowMissingColumns=True)
    nothing = hashlib.sha256(b"").hexdigest()
    return both.groupBy("conv_id").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in _COUNTS), F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("repaired_sha256"), F.lit(nothing)).alias("repaired_sha256"))


def _cleaned(rows: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)
    return rows.select("conv_id", F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), gone.alias("gone"))


def repair(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation; rows: (conv_id, turn, role, text), and `gone` if they only name one."""
    got = _spark.written(_sorted(_cleaned(rows), most_rows, most_bytes, False), "conversations")
    return got.where("kind = 0").select("conv_id", *_RESULT).unionByName(_blockwise(got.where("kind = 1"), block, False).select("conv_id", *_RESULT))


def repaired_turns(rows: DataFrame, most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES, block: int = BLOCK) -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations; place orders those of one."""
    got = _spark.written(_sorted(_cleaned(rows), most_rows, most_bytes, True), "conversations")
    whole = got.where("kind = 2").select("conv_id", F.struct(F.lit(0).alias("slice"), "pos", F.lit(0).alias("n")).alias("place"), "edit", "role", "text")
    return whole.unionByName(_blockwise(got.where("kind = 1"), block, True))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with planted faults, by a checksum of conversation and turn; rows that are dropped stay as `gone`."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    n = F.crc32(name.cast("binary")) % 20
    text = F.when((n == 0) | (n == 1), "").when(n == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(n == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select("conv_id", "turn", F.when(n == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (n == 0).alias("gone"), copies.alias("copy"))
    return out.drop("copy")


def op13_conversations(spark, sf_dir: str) -> DataFrame:
    return repair(damaged(_spark.table(spark, sf_dir, "conversations")))


_CRC = "xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, strlen(s)), lambda i: ('0x' || substr(hex(encode(s)), 2 * i + 1, 2))::BIGINT)), lambda c, x: xor(c >> 8, tab[(xor(c, x) & 255) + 1])))"
ORACLE_SQL = f"""
WITH RECURSIVE z AS (SELECT range AS n, range AS v, 0 AS k FROM range(256)
 UNION ALL SELECT n, CASE WHEN v & 1 = 1 THEN xor(3988292384, v >> 1) ELSE v >> 1 END, k + 1 FROM z WHERE k < 8),
tab AS (SELECT list(v ORDER BY n) AS tab FROM z WHERE k = 8),
raw AS (SELECT dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS t, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
hit AS (SELECT raw.*, {_CRC} % 20 AS n FROM raw, tab),
dmg AS (SELECT c, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN regexp_replace(t, '[.!?]', '', 'g') ELSE t END AS text, unnest(CASE WHEN n = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE n <> 0),
o AS (SELECT c, turn, role, text, substr(role, 1, 1) AS x, row_number() OVER w AS i, row_number() OVER (PARTITION BY c, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
      lag(substr(role, 1, 1)) OVER w || substr(role, 1, 1) AS pair FROM dmg WINDOW w AS (PARTITION BY c ORDER BY turn NULLS FIRST, md5(role || chr(0) || text), copy)),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN nth > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 3 ELSE 0 END AS fault FROM o),
m AS MATERIALIZED (SELECT c, max(i) AS n FROM f GROUP BY c),
b(c, i, c0, c1, c2, c3) AS (SELECT c, n + 1, 0, 10, 5, 0 FROM m
 UNION ALL SELECT c, i, least(b0, 5 + b2, 10 + b3), least(b1, 5 + b2, 10 + b3), least(b2, 5 + b3), least(b3, 5 + b2) FROM (
  SELECT b.c, f.i, least(2 + c0, y + c2 + (x <> 'u')::INTEGER, y + CASE WHEN x = 's' THEN c1 ELSE 999999999 END) AS b0, least(2 + c1, y + c2 + (x <> 'u')::INTEGER) AS b1,
         least(2 + c2, y + c3 + (x <> 'a')::INTEGER) AS b2, least(2 + c3, y + c2 + (x <> 'u')::INTEGER) AS b3
  FROM b JOIN (SELECT *, CASE fault WHEN 0 THEN 0 WHEN 3 THEN 5 ELSE 999999999 END AS y FROM f) f ON f.c = b.c AND f.i = b.i - 1)),
bm AS MATERIALIZED (SELECT c, i, [c0, c1, c2, c3] AS v FROM b),
w(c, i, s, audit, turns) AS (SELECT c, 1::BIGINT, 0, '', []::VARCHAR[] FROM m
 UNION ALL SELECT c, i + (e <> 'I')::INTEGER, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND x = 's' THEN 1 ELSE [2, 2, 3, 2][s + 1] END, audit || e,
   CASE e WHEN 'D' THEN turns WHEN 'K' THEN list_append(turns, role || ':' || text) WHEN 'I' THEN list_append(turns, wanted || ':') ELSE list_append(turns, wanted || ':' || text) END FROM (
  SELECT w.*, f.x, f.role, f.text, CASE WHEN s = 2 THEN 'assistant' ELSE 'user' END AS wanted, CASE
   WHEN f.i IS NOT NULL AND 2 + nx.v[s + 1] = hr.v[s + 1] THEN 'D'
   WHEN 5 + hr.v[[3, 3, 4, 3][s + 1]] = hr.v[s + 1] THEN 'I'
   WHEN f.x = 's' AND s = 0 AND (fault = 3)::INTEGER * 5 + nx.v[2] = hr.v[s + 1] THEN 'K'
   WHEN f.x = CASE WHEN s = 2 THEN 'a' ELSE 'u' END AND (fault = 3)::INTEGER * 5 + nx.v[[3, 3, 4, 3][s + 1]] = hr.v[s + 1] THEN 'K' ELSE 'R' END AS e
  FROM w JOIN bm hr ON hr.c = w.c AND hr.i = w.i LEFT JOIN f ON f.c = w.c AND f.i = w.i LEFT JOIN bm nx ON nx.c = w.c AND nx.i = w.i + 1
  WHERE f.i IS NOT NULL OR hr.v[s + 1] > 0)),
r AS (SELECT w.c, audit, turns FROM w JOIN bm ON bm.c = w.c AND bm.i = w.i JOIN m ON m.c = w.c WHERE w.i = m.n + 1 AND bm.v[s + 1] = 0),
g AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
      count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c)
SELECT conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce((SELECT v[1] FROM bm WHERE bm.c = ids.c AND bm.i = 1), 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(turns, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM raw) ids LEFT JOIN g USING (c) LEFT JOIN r USING (c)
"""
