"""Queries of readers and writers: stand-in files are written from the test tables to the shared folder, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import sources
from ..functions import text
from ..operators import evaluate, mentions, ontology, sets, vectors
from ..operators.workers import shared_folder
from ..sources import table
from ..sources.index import VectorIndex
from . import standins as si
from .catalogue import _VEC, _scores, query


def _path(spark, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written(spark, rows: DataFrame, kind: str, fields: dict, order: str | None = None, gz: bool = False) -> str:
    """An ontology file of a kind: fields by name, others are empty; lines in the given order."""
    line = F.concat(F.concat_ws("|", *(F.coalesce(fields.get(c, F.lit("")), F.lit("")) for c in sources.RRF[kind])), F.lit("|"))
    path = _path(spark, kind)
    lines = rows.orderBy(order) if order else rows
    lines.select(line.alias("value")).write.option("compression", "gzip" if gz else "none").text(path)
    return path


def _key(c: str, prefix: str):
    return si.key(c, prefix)


@query("SELECT o_orderkey::VARCHAR AS dicom_id, o_custkey::DOUBLE AS subject_id, CASE WHEN o_orderkey % 3 = 0 THEN 1.0 WHEN o_orderkey % 3 = 1 THEN 0.0 END::DOUBLE AS edema, 'a \"quoted\", text' || chr(10) || o_orderpriority AS impression FROM orders")
def source_study_csv(spark, d):
    edema = F.when(F.col("o_orderkey") % 3 == 0, 1.0).when(F.col("o_orderkey") % 3 == 1, 0.0).otherwise(float("nan"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("dicom_id"), F.col("o_custkey").cast("double").alias("subject_id"), edema.alias("Edema"), F.concat(F.lit('a "quoted", text\n'), "o_orderpriority").alias("impression"))
    path = _path(spark, "studies")
    rows.write.option("header", True).option("escape", '"').csv(path)
    got = sources.study_table(spark, path)
    return got.select("dicom_id", "subject_id", F.col("Edema").alias("edema"), "impression")


@query("SELECT o_orderkey::VARCHAR AS dicom_id, o_orderpriority AS impression FROM orders")
def source_study_frame(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("dicom_id"), F.col("o_orderpriority").alias("impression"))
    return sources.study_table(spark, df=rows)


@query("""SELECT 'p' || p_partkey AS cui, '"' || p_name || '" x' AS name FROM part WHERE p_size % 5 <> 0 AND p_size % 7 <> 0 AND p_partkey % 3 <> 0""")
def source_names(spark, d):
    p = table(spark, d, "part")
    fields = {
        "CUI": _key("p_partkey", "p"), "LAT": F.when(F.col("p_size") % 5 == 0, "FRE").otherwise("ENG"), "TS": F.when(F.col("p_size") % 7 == 0, "S").when(F.col("p_size") % 11 == 0, "").otherwise("P"),
        "SAB": F.when(F.col("p_partkey") % 3 == 0, "MSH").otherwise("SNOMEDCT_US"), "STR": F.concat(F.lit('"'), "p_name", F.lit('" x')),
    }
    return sources.concept_names(sources.rrf(spark, _written(spark, p, "MRCONSO", fields), "MRCONSO"))


@query("SELECT 'b' || p_brand AS cui, max_by('T' || p_size, p_partkey) AS tui FROM part GROUP BY 1")
def source_types(spark, d):
    path = _written(spark, table(spark, d, "part"), "MRSTY", {"CUI": F.concat(F.lit("b"), "p_brand"), "TUI": F.concat(F.lit("T"), F.col("p_size").cast("string"))}, "p_partkey")
    return sources.semantic_types(sources.numbered(sources.rrf(spark, path, "MRSTY")))


@query("SELECT 'b' || p_brand AS cui, max_by(p_name, p_partkey) AS definition FROM part GROUP BY 1")
def source_definitions(spark, d):
    path = _written(spark, table(spark, d, "part"), "MRDEF", {"CUI": F.concat(F.lit("b"), "p_brand"), "DEF": F.col("p_name")}, "p_partkey")
    return sources.definitions(sources.numbered(sources.rrf(spark, path, "MRDEF")))


@query("SELECT 's' || s_suppkey AS cui, 'n' || s_nationkey AS parents FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 4 <> 2 AND s_nationkey % 3 <> 0")
def source_parents(spark, d):
    s = table(spark, d, "supplier")
    fields = {"CUI1": _key("s_suppkey", "s"), "REL": F.lit("PAR"), "CUI2": _key("s_nationkey", "n"), "SL": F.when(F.col("s_suppkey") % 2 == 0, "SNOMEDCT_US").otherwise("MSH")}
    own = s.select(_key("s_suppkey", "s").alias("cui"), F.when(F.col("s_suppkey") % 4 == 2, "T017").otherwise("T047").alias("tui"))
    up = table(spark, d, "nation").select(_key("n_nationkey", "n").alias("cui"), F.when(F.col("n_nationkey") % 3 == 0, "T082").otherwise("T033").alias("tui"))
    got = sources.parent_relations(sources.rrf(spark, _written(spark, s, "MRREL", fields), "MRREL"), own.unionByName(up))
    return got.select("cui", F.array_join("parents", ",").alias("parents"))


_CODES = ["SY", "CHD", "RQ", "RL", "PAR", "RB", "RN", "XX"]
_REL = "SELECT DISTINCT 'c' || (p_partkey % 500) AS a, 'c' || p_size AS b, [" + ", ".join(f"'{c}'" for c in _CODES) + "][p_partkey % 8 + 1] AS rel FROM part WHERE p_partkey % 8 <> 7 AND p_partkey % 500 <> p_size"


def _relations(spark, d, gz: bool) -> DataFrame:
    fields = {"CUI1": F.concat(F.lit("c"), (F.col("p_partkey") % 500).cast("string")), "CUI2": _key("p_size", "c"), "REL": F.get(F.array(*map(F.lit, _CODES)), (F.col("p_partkey") % 8).cast("int"))}
    return sources.graph_relations(sources.rrf(spark, _written(spark, table(spark, d, "part"), "MRREL", fields, gz=gz), "MRREL"))


@query(_REL)
def source_relations(spark, d):
    return _relations(spark, d, False)


@query(_REL)
def source_relations_gz(spark, d):
    return _relations(spark, d, True)


@query("SELECT DISTINCT 'c' || (x.p_partkey % 700) AS child, 'c' || (y.p_partkey % 700) AS parent FROM part x JOIN part y ON y.p_partkey = x.p_partkey // 2 WHERE x.p_partkey % 700 <> y.p_partkey % 700")
def source_hierarchy(spark, d):
    fields = {"CUI": F.concat(F.lit("c"), (F.col("p_partkey") % 700).cast("string")), "AUI": _key("p_partkey", "a"), "PAUI": F.concat(F.lit("a"), F.floor(F.col("p_partkey") / 2).cast("string")), "SAB": F.lit("SNOMEDCT_US")}
    path = _written(spark, table(spark, d, "part"), "MRHIER", fields, "p_partkey")
    return sources.hierarchy(sources.numbered(sources.rrf(spark, path, "MRHIER")))


@query("SELECT o_orderkey AS report_id, length(o_orderpriority)::INTEGER AS n FROM orders")
def source_mention_cache(spark, d):
    """A cache of half of the reports is filled up for all of them."""
    notes = table(spark, d, "orders").select(F.col("o_orderkey").alias("report_id"), F.col("o_orderpriority").alias("text"))
    make = lambda texts: texts.select("report_id", F.length("text").alias("n"))
    path = _path(spark, "mentions")
    sources.cached(spark, path, make, texts=notes.where("report_id % 2 = 0")).count()
    return sources.cached(spark, path, make, texts=notes)


@query("SELECT 'sym_tversky' AS metric, 0.25::DOUBLE AS alpha, 1.0::DOUBLE AS beta, 10 AS max_depth, true AS use_ic, 'report' AS report_column")
def source_config(spark, d):
    lines = ["retrieval_args:", "  use_ic: True", "  cost_function: sym_tversky # the default", "hyperparameters:", "  alpha: 0.25", "  beta: 1", "  max_expl_depth: 10", "init_data_args:", '  report_column: "report"', "other: 3"]
    path = _path(spark, "config")
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
    c = sources.Config.load(spark, path)
    return spark.createDataFrame([(c.metric, c.alpha, c.beta, c.max_depth, c.use_ic, c.report_column)], "metric string, alpha double, beta double, max_depth int, use_ic boolean, report_column string")


@query("SELECT n_nationkey AS id, CASE WHEN n_nationkey % 3 = 0 THEN 'jpg' WHEN n_nationkey % 3 = 1 THEN 'png' END AS found, CASE WHEN n_nationkey % 3 < 2 THEN length(n_name) END::BIGINT AS size FROM nation")
def source_images(spark, d):
    """A jpg file for every third nation, a png file for every third, none for the others."""
    folder, jvm = _path(spark, "images"), spark.sparkContext._jvm
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    for r in nations.collect():  # as many files as nations
        if r["n_nationkey"] % 3 < 2:
            name = jvm.org.apache.hadoop.fs.Path(f"{folder}/{r['n_nationkey']}.{('jpg', 'png')[r['n_nationkey'] % 3]}")
            out = name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(name)
            out.write(bytearray(r["n_name"].encode()))
            out.close()
    files = sources.images(spark, folder)
    base = files.select(F.regexp_replace("path", "/[^/]*$", "/").alias("base")).limit(1)
    rows = nations.crossJoin(base).select(F.col("n_nationkey").alias("id"), F.concat("base", F.col("n_nationkey").cast("string"), F.lit(".jpg")).alias("path"))
    got = sources.resolved_images(rows, files).join(files.select(F.col("path").alias("found"), "length"), "found", "left")
    return got.select("id", F.regexp_extract("found", "([a-z]+)$", 1).alias("found"), F.col("length").alias("size"))


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def sink_csv(spark, d):
    path = _path(spark, "out")
    sources.write_csv(table(spark, d, "part").select("p_partkey", "p_name", "p_retailprice"), path)
    return spark.read.schema("p_partkey long, p_name string, p_retailprice double").option("header", True).csv(path)


@query("SELECT 'run_sym_tversky_a0.5_b1_m_PleuralEffusion-Edema_x' AS name")
def sink_name(spark, d):
    return spark.createDataFrame([(sources.output_name("run", sources.Config(), ["Pleural Effusion", "Edema"], "m", "x"),)], "name string")


_AUROC = """sc AS (SELECT 'toxic' AS class, n_chars AS score, toxic AS truth FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'quality', n_chars, quality FROM documents JOIN labels USING (doc_id)),
rk AS (SELECT class, truth, (SELECT count(*) FROM sc y WHERE y.class = x.class AND y.score < x.score) + ((SELECT count(*) FROM sc y WHERE y.class = x.class AND y.score = x.score) + 1) / 2 AS r FROM sc x),
au AS (SELECT class, round((sum(r) FILTER (WHERE truth = 1) - sum(truth) * (sum(truth) + 1) / 2) / nullif(sum(truth) * (count(*) - sum(truth)), 0), 6) AS auroc FROM rk GROUP BY 1)"""


@query(f"WITH {_AUROC} SELECT 'AUROC mean: ' || format('{{:.6f}}', round(avg(auroc), 6)) AS value FROM au UNION ALL SELECT class || ': ' || format('{{:.6f}}', auroc) FROM au")
def sink_metrics(spark, d):
    per_class = evaluate.auroc(_scores(spark, d))
    return sources.metrics_lines(per_class, evaluate.macro(per_class))


@query("SELECT l_orderkey AS report_id, '{\"text\":\"' || l_shipdate::DATE::VARCHAR || '\",\"line\":' || l_linenumber || ',\"present\":' || CASE WHEN l_returnflag = 'A' THEN 'true' ELSE 'false' END || '}' AS json FROM lineitem")
def mention_json(spark, d):
    m = F.struct(F.to_date("l_shipdate").cast("string").alias("text"), F.col("l_linenumber").alias("line"), (F.col("l_returnflag") == "A").alias("present"))
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), text.json_of(m).alias("json"))


@query("SELECT page_id, CASE WHEN url LIKE '/%' THEN url ELSE 'img/' || url END AS p, CASE WHEN url LIKE '/%' THEN left(url, length(url) - 4) ELSE left('img/' || url, length(url)) END || '.jpg' AS path FROM pages WHERE url IS NOT NULL")
def trainer_paths(spark, d):
    url = F.col("url")
    return table(spark, d, "pages").where(url.isNotNull()).select("page_id", F.when(url.startswith("/"), url).otherwise(F.concat(F.lit("img/"), url)).alias("p"), text.trainer_path(url, "img/").alias("path"))


@query(f"WITH {si.SETS} SELECT report_id, concept FROM pos WHERE {si.WEIGHT} > 0")
def important_concepts(spark, d):
    pos, _ = mentions.concept_pairs(si.mentions(spark, d))
    return sets.important(pos, si.weight(pos))


@query(f"WITH {si.SETS} SELECT DISTINCT concept FROM (SELECT concept FROM pos UNION ALL SELECT concept FROM neg)")
def concept_universe(spark, d):
    pos, neg = mentions.concept_pairs(si.mentions(spark, d))
    return sets.universe(pos.unionByName(neg))


@query("SELECT vec_id, round(list_sum(list_transform(u, lambda x: x * x)), 6) AS n, round(u[1], 6) AS first FROM (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS u FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings))")
def unit_vectors(spark, d):
    u = vectors.unit(F.col("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(vectors.inner(u, u), 6).alias("n"), F.round(F.get(u, 0), 6).alias("first"))


@query(_VEC.replace("k AS (SELECT *", "k AS (SELECT *", 1).replace("JOIN u r ON q.vec_id <> r.vec_id", "JOIN u r ON r.vec_id % 7 <> 0") + " SELECT query_id, ref_id, score, rank::INTEGER AS rank FROM k WHERE rank <= 3")
def vector_index(spark, d):
    """Vectors are saved as an index, and searched after two rounds of removals, which leave the vectors as they are."""
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    index = VectorIndex(spark, _path(spark, "index")).add(v)
    index.remove(v.where("id % 14 = 0")).remove(v.where("id % 14 = 7"))
    return vectors.knn(v.where(si.is_query("id")), index.read(), 3, exclude_self=False)


_HASHED = """wd AS (SELECT cui, name, unnest(list_filter(regexp_split_to_array(lower(name), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')) AS w FROM (SELECT DISTINCT cui, name FROM name)),
cn AS (SELECT cui, name, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, count(*)::DOUBLE AS n FROM wd GROUP BY ALL)"""


@query(f"WITH {si.NAMES}, {_HASHED} SELECT cui, round(max(n) / sqrt(sum(n * n)), 6) AS largest, count(*) AS places FROM cn GROUP BY cui, name")
def synonym_index(spark, d):
    """One vector for each name of a concept, by its largest number and how many are not 0; the map from vectors to concepts is written and read."""
    index, ids = vectors.synonym_index(si.names(spark, d))
    path = _path(spark, "ids")
    ids.write.parquet(path)
    got = sources.resolve_ids(index, spark.read.parquet(path))
    return got.select("cui", F.round(F.array_max("embedding"), 6).alias("largest"), F.size(F.filter("embedding", lambda x: x > 0)).cast("long").alias("places"))


_KEPT = f"""{si.HIER}, keep AS (SELECT 'p' || p_partkey AS node FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'alone' || r_regionkey FROM region),
up AS (SELECT child, parent, 1 AS d FROM hier JOIN keep ON child = keep.node UNION SELECT h.child, h.parent, d + 1 FROM up JOIN hier h ON h.child = up.parent WHERE d < 10),
e AS (SELECT DISTINCT child, parent FROM up), nd AS (SELECT child AS node FROM e UNION SELECT parent FROM e),
lf AS (SELECT node FROM nd WHERE node NOT IN (SELECT parent FROM e)), pt AS (SELECT node FROM lf UNION ALL SELECT parent FROM pt JOIN e ON child = pt.node)"""


@query(f"WITH RECURSIVE {_KEPT} SELECT node, round(-ln(count(*) / (SELECT count(*) FROM lf)), 6) AS ic FROM pt GROUP BY node UNION ALL SELECT node, 0.0 FROM keep WHERE node NOT IN (SELECT node FROM nd)")
def kept_ic(spark, d):
    """Information content on the hierarchy above kept concepts; those outside it have 0."""
    keep = table(spark, d, "part").where("p_partkey % 2 = 0").select(_key("p_partkey", "p").alias("node")).unionByName(table(spark, d, "region").select(_key("r_regionkey", "alone").alias("node")))
    edges, alone = ontology.kept(si.hierarchy(spark, d), keep, 10)
    return ontology.information_content(edges, alone).select("node", F.round("ic", 6).alias("ic"))
