"""Reports, mentions, concepts and graphs out of the test tables, in Spark and as SQL for the oracle.

A report is an order; a mention is one of its lines, with the supplier as its
concept and the part as its text concept; return flags are assertions, line status
is the category.  Types weigh 3 to 0 by key.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import table

TYPES = ["PROMO", "MEDIUM", "STANDARD", "ECONOMY", "LARGE", "SMALL"]
#: Searches take as queries every row whose id this divides.
QUERY_STEP = 100


def key(c: str, prefix: str):
    return F.concat(F.lit(prefix), F.col(c).cast("string"))


def mentions(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    seq = F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey")
    assertion = F.when(F.col("l_returnflag") == "A", "present").when(F.col("l_returnflag") == "N", "uncertain").otherwise("absent")
    kind = F.when(F.col("l_linestatus") == "O", "Observation").otherwise("Anatomy")
    state = F.when(F.col("l_returnflag") == "A", "definitely present").when(F.col("l_returnflag") == "N", "uncertain").otherwise("definitely absent")
    return li.select(F.col("l_orderkey").alias("report_id"), seq.alias("seq"), key("l_suppkey", "s").alias("cui"), key("l_partkey", "p").alias("cui_text"), assertion.alias("assertion"), F.concat(kind, F.lit("::"), state).alias("category"), (F.col("l_discount") + 0.1).alias("score_text"), (F.col("l_tax") + 0.1).alias("score_surface"))


def reports(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"))


def names(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(key("p_partkey", "p").alias("cui"), F.concat_ws(" ", "p_type", "p_name").alias("name"))
    return p.unionByName(table(spark, d, "supplier").select(key("s_suppkey", "s").alias("cui"), F.col("s_name").alias("name")))


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Broader concepts: of a supplier, the parts with its key (so that parents' names hold labels)."""
    return table(spark, d, "supplier").select(key("s_suppkey", "s").alias("cui"), key("s_suppkey", "p").alias("parent"))


def weight(pairs: DataFrame) -> DataFrame:
    """(concept, weight) of the concepts of pairs."""
    return pairs.select("concept").distinct().withColumn("weight", (3 - F.substring("concept", 2, 20).cast("long") % 4).cast("long"))


def is_query(c: str):
    return F.col(c) % QUERY_STEP == 0


def split_sets(pos: DataFrame):
    """Positive (or negated) pairs as targets and as references."""
    return pos.where(is_query("report_id")).withColumnRenamed("report_id", "target_id"), pos.withColumnRenamed("report_id", "ref_id")


def relations(spark: SparkSession, d: str, parts: bool = True) -> DataFrame:
    """(a, b, rel): supplier-nation, nation-region, and part-brand, part-type; SY where the left key is even."""
    def rel(c):
        return F.when(F.col(c) % 2 == 0, "SY").otherwise("PAR").alias("rel")

    s, n, p = (table(spark, d, t) for t in ("supplier", "nation", "part"))
    out = [s.select(key("s_suppkey", "s").alias("a"), key("s_nationkey", "n").alias("b"), rel("s_suppkey")), n.select(key("n_nationkey", "n").alias("a"), key("n_regionkey", "r").alias("b"), rel("n_nationkey"))]
    if parts:
        out += [p.select(key("p_partkey", "p").alias("a"), F.concat(F.lit("b"), "p_brand").alias("b"), rel("p_partkey")), p.select(key("p_partkey", "p").alias("a"), F.concat(F.lit("t"), "p_type").alias("b"), rel("p_partkey"))]
    return reduce(DataFrame.unionByName, out)


def roots(spark: SparkSession, d: str) -> DataFrame:
    """One root set for each region and each brand."""
    r = table(spark, d, "region").select(key("r_regionkey", "r").alias("v"))
    b = table(spark, d, "part").select(F.concat(F.lit("b"), "p_brand").alias("v")).distinct()
    return r.unionByName(b).select(F.col("v").alias("root_set"), "v")


def hierarchy(spark: SparkSession, d: str) -> DataFrame:
    """(child, parent): part to brand and type, those to a root; a part reaches the root by two paths."""
    p = table(spark, d, "part")
    brand, kind = F.concat(F.lit("b"), "p_brand"), F.concat(F.lit("t"), "p_type")
    up = lambda c: p.select(c.alias("child")).distinct().withColumn("parent", F.lit("root"))
    return p.select(key("p_partkey", "p").alias("child"), brand.alias("parent")).unionByName(p.select(key("p_partkey", "p").alias("child"), kind.alias("parent"))).unionByName(up(brand)).unionByName(up(kind)).distinct()


# The same in SQL, as common table expressions.
MENTION = """mention AS (SELECT l_orderkey AS report_id, concat_ws('-', l_linenumber, l_partkey, l_suppkey) AS seq, 's' || l_suppkey AS cui, 'p' || l_partkey AS cui_text,
 CASE l_returnflag WHEN 'A' THEN 'present' WHEN 'N' THEN 'uncertain' ELSE 'absent' END AS assertion, CASE l_linestatus WHEN 'O' THEN 'Observation' ELSE 'Anatomy' END AS kind,
 l_discount + 0.1 AS score_text, l_tax + 0.1 AS score_surface FROM lineitem)"""
SETS = (
    MENTION
    + """,
obs AS (SELECT DISTINCT report_id FROM mention WHERE kind = 'Observation' AND assertion = 'present'),
pos AS (SELECT DISTINCT report_id, concept FROM (SELECT report_id, unnest([cui, cui_text]) AS concept FROM mention WHERE assertion <> 'absent' AND (kind <> 'Anatomy' OR report_id IN (SELECT report_id FROM obs)))),
neg AS (SELECT DISTINCT report_id, concept FROM (SELECT report_id, unnest([cui, cui_text]) AS concept FROM mention WHERE assertion = 'absent'))"""
)
NAMES = """name AS (SELECT 'p' || p_partkey AS cui, p_type || ' ' || p_name AS name FROM part UNION ALL SELECT 's' || s_suppkey, s_name FROM supplier)"""
WEIGHT = "(3 - substr(concept, 2)::BIGINT % 4)"


def rel_sql(c: str) -> str:
    return f"CASE WHEN {c} % 2 = 0 THEN 'SY' ELSE 'PAR' END AS rel"


SUPPLY = f"""SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b, {rel_sql("s_suppkey")} FROM supplier UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, {rel_sql("n_nationkey")} FROM nation"""
PARTS = f"""SELECT 'p' || p_partkey AS a, 'b' || p_brand AS b, {rel_sql("p_partkey")} FROM part UNION ALL SELECT 'p' || p_partkey, 't' || p_type, {rel_sql("p_partkey")} FROM part"""


def edges_sql(parts: bool = True) -> str:
    """relation (a, b, rel), edge (a, b, rels) and way (src, dst, rels)."""
    return f"""relation AS ({SUPPLY}{" UNION ALL " + PARTS if parts else ""}),
edge AS (SELECT least(a, b) AS a, greatest(a, b) AS b, list_sort(list(DISTINCT rel)) AS rels FROM relation WHERE a <> b GROUP BY ALL),
way AS (SELECT a AS src, b AS dst, rels FROM edge UNION ALL SELECT b, a, rels FROM edge)"""


ROOTS = """root AS (SELECT 'r' || r_regionkey AS root_set, 'r' || r_regionkey AS v FROM region UNION ALL SELECT DISTINCT 'b' || p_brand, 'b' || p_brand FROM part)"""


def bfs_sql(depth: int, root: str = "root") -> str:
    """found (root_set, v, depth, pred, all_sy, only_sy, steps, cost), level by level."""
    out = [f"l0 AS (SELECT DISTINCT root_set, v, 0 AS depth, NULL::VARCHAR AS pred, true AS all_sy, true AS only_sy, 0 AS n_true, 0.5::DOUBLE AS steps, 0.0::DOUBLE AS cost FROM {root})", "s0 AS (SELECT * FROM l0)"]
    for k in range(1, depth + 1):
        out.append(f"""c{k} AS MATERIALIZED (SELECT l.root_set, w.dst AS v, l.v AS src, l.all_sy AND list_contains(rels, 'SY') AS all_sy, l.only_sy AND list_has_any(rels, ['RL', 'RQ', 'SY']) AS only_sy,
 n_true, len(list_filter(rels, lambda x: x NOT IN ('RQ', 'SY'))) > 0 AS step, l.cost + CASE WHEN len(list_filter(rels, lambda x: x NOT IN ('RQ', 'SY'))) = 0 THEN 0.0 WHEN list_contains(rels, 'CHD') THEN 0.5 ELSE 1.0 END AS cost
 FROM l{k - 1} l JOIN way w ON w.src = l.v),
l{k} AS MATERIALIZED (SELECT root_set, v, {k} AS depth, src AS pred, all_sy, only_sy, n_true + step::INT AS n_true, (n_true + step::INT + (NOT step)::INT)::DOUBLE AS steps, cost
 FROM (SELECT *, row_number() OVER (PARTITION BY root_set, v ORDER BY src) AS k FROM c{k}) c WHERE k = 1 AND NOT EXISTS (SELECT 1 FROM s{k - 1} s WHERE s.root_set = c.root_set AND s.v = c.v)),
s{k} AS MATERIALIZED (SELECT * FROM s{k - 1} UNION ALL SELECT * FROM l{k})""")
    return ",\n".join([*out, f"found AS MATERIALIZED (SELECT * FROM s{depth})"])


HIER = """hier AS (SELECT DISTINCT child, parent FROM (SELECT 'p' || p_partkey AS child, 'b' || p_brand AS parent FROM part UNION ALL SELECT 'p' || p_partkey, 't' || p_type FROM part
 UNION ALL SELECT 'b' || p_brand, 'root' FROM part UNION ALL SELECT 't' || p_type, 'root' FROM part)),
node AS (SELECT child AS node FROM hier UNION SELECT parent FROM hier)"""
#: To be used after WITH RECURSIVE.
IC = (
    HIER
    + """,
leaf AS (SELECT node FROM node WHERE node NOT IN (SELECT parent FROM hier)),
path AS (SELECT node FROM leaf UNION ALL SELECT parent FROM path JOIN hier ON child = path.node),
ic AS (SELECT node, -ln(count(*) / (SELECT count(*) FROM leaf)) AS ic FROM path GROUP BY node),
anc AS (SELECT node, node AS ancestor FROM node UNION SELECT anc.node, parent FROM anc JOIN hier ON child = ancestor)"""
)
