"""Queries of what is fitted to the test tables: term weights, a text encoder, and logistic heads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import encoder, evaluate, prep, training
from ..operators.workers import shared_folder, stored
from ..sources import table
from . import flows
from . import standins as si
from .catalogue import query

_TERMS = """tm AS (SELECT doc_id, unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))) AS term FROM documents)"""


def _texts(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query(f"WITH {_TERMS} SELECT term, count(*) AS n, round(ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1, 6) AS idf FROM tm GROUP BY 1")
def term_weights(spark, d):
    """Each term of all documents, with the documents that hold it and its weight."""
    return encoder.term_weights(_texts(spark, d)).withColumn("idf", F.round("idf", 6))


@query()
def flow_semantic_search_fitted(spark, d):
    """The documents closest to every hundredth one, by an encoder fitted to all of them."""
    texts = _texts(spark, d)
    return flows.semantic_search(texts, texts.where(si.is_query("id")), 5, encoder.fit(texts))


CLASSES = [str(c) for c in range(10)]
SCHEDULE = training.Schedule(epochs=6, batches=2, lr=0.1, patience=0, factor=0.5)


def _heads_sql(by: training.Schedule, then: str) -> str:
    """One row a class and step; a step is joined with its own batch, and judged on the held-out rows at the end of an epoch."""
    steps = [(n, e, c, n % by.batches == 0) for n, (e, c) in enumerate(((e, c) for e in range(1, by.epochs + 1) for c in by.order(e)), 1)]
    listed = ", ".join(f"({n}, {e}, {c}, {str(last).lower()})" for n, e, c, last in steps)
    one, two = by.betas
    logs = "greatest(-ln(1 + exp(-z)), -100.0)", "greatest(-ln(1 + exp(z)), -100.0)"
    loss = f"-sum(CASE WHEN label = c THEN {logs[0]} ELSE {logs[1]} END)"
    return f"""WITH RECURSIVE dt AS MATERIALIZED (SELECT vec_id, label, list_append(list_transform(embedding, lambda e: e::DOUBLE), 1.0::DOUBLE) AS x,
 row_number() OVER (ORDER BY md5('42:' || vec_id), vec_id) <= floor(0.8 * count(*) OVER ()) AS tr, ('0x' || substr(md5('{by.seed}:cell:' || vec_id), 1, 8))::BIGINT % {by.batches} AS cell FROM embeddings WHERE embedding IS NOT NULL),
sp AS (SELECT * FROM (VALUES {listed}) v(n, epoch, cell, last)), dims AS (SELECT unnest(range(1, (SELECT max(len(x)) FROM dt) + 1)) AS j),
r AS (SELECT 0::BIGINT AS n, c, list_transform(range((SELECT max(len(x)) FROM dt)), lambda i: 0.0::DOUBLE) AS w, list_transform(range((SELECT max(len(x)) FROM dt)), lambda i: 0.0::DOUBLE) AS m, list_transform(range((SELECT max(len(x)) FROM dt)), lambda i: 0.0::DOUBLE) AS v,
  {by.lr}::DOUBLE AS lr, {by.lr}::DOUBLE AS own_lr, 'infinity'::DOUBLE AS best, 0::BIGINT AS bad, 0::BIGINT AS best_epoch, 0.0::DOUBLE AS train, NULL::DOUBLE AS val FROM (SELECT unnest(range({len(CLASSES)})) AS c)
 UNION ALL
 SELECT n, c, w, m, v, CASE WHEN last AND now_bad > {by.patience} THEN lr * {by.factor} ELSE lr END, lr, CASE WHEN last THEN least(best, val) ELSE best END,
  CASE WHEN last THEN CASE WHEN now_bad > {by.patience} THEN 0 ELSE now_bad END ELSE bad END, CASE WHEN last AND val < best THEN epoch ELSE best_epoch END, train, val FROM (
  SELECT *, CASE WHEN val < best * (1 - {by.threshold}) THEN 0 ELSE bad + 1 END AS now_bad FROM (
   SELECT *, sum(lost) OVER () / sum(held) OVER () AS val FROM (
    SELECT n, c, any_value(w) AS w, any_value(m) AS m, any_value(v) AS v, any_value(lr) AS lr, any_value(best) AS best, any_value(bad) AS bad, any_value(best_epoch) AS best_epoch, any_value(train) AS train, any_value(epoch) AS epoch, any_value(last) AS last,
     {loss} AS lost, count(*) AS held FROM (SELECT t.*, dt.label, list_inner_product(t.w, dt.x) AS z FROM (
      SELECT n, c, list(w - lr * (m / (1 - {one} ** n)) / (sqrt(v / (1 - {two} ** n)) + {by.eps}) ORDER BY j) AS w, list(m ORDER BY j) AS m, list(v ORDER BY j) AS v, any_value(lr) AS lr, any_value(best) AS best, any_value(bad) AS bad,
       any_value(best_epoch) AS best_epoch, any_value(train) AS train, any_value(epoch) AS epoch, any_value(last) AS last FROM (
       SELECT *, {one} * m0 + (1 - {one}) * g AS m, {two} * v0 + (1 - {two}) * g * g AS v FROM (
        SELECT n, c, j, any_value(w[j]) AS w, any_value(m[j]) AS m0, any_value(v[j]) AS v0, sum((p - (label = c)::INTEGER) * x[j]) / (count(*) * {len(CLASSES)}) + {by.decay} * any_value(w[j]) AS g, any_value(lr) AS lr, any_value(best) AS best, any_value(bad) AS bad, any_value(best_epoch) AS best_epoch,
         any_value(CASE WHEN first THEN 0 ELSE train END) + any_value(batch_loss) / {by.batches} AS train, any_value(epoch) AS epoch, any_value(last) AS last FROM (
         SELECT *, 1 / (1 + exp(-z)) AS p, sum(CASE WHEN label = c THEN -{logs[0]} ELSE -{logs[1]} END) OVER () / count(*) OVER () AS batch_loss FROM (
          SELECT sp.n, sp.epoch, sp.last, (sp.n - 1) % {by.batches} = 0 AS first, r.c, r.w, r.m, r.v, r.lr, r.best, r.bad, r.best_epoch, r.train, dt.label, dt.x, list_inner_product(r.w, dt.x) AS z
          FROM r JOIN sp ON sp.n = r.n + 1 JOIN dt ON dt.tr AND dt.cell = sp.cell)) s, dims GROUP BY n, c, j)) GROUP BY n, c) t, dt WHERE NOT dt.tr) GROUP BY n, c))))
{then}"""


def _trained(spark, d):
    """Heads of the vectors' labels: (id, x, y) of the held-out fifth, and the run."""
    v = table(spark, d, "embeddings").where("embedding is not null")
    y = F.array(*(F.coalesce((F.col("label") == int(c)).cast("double"), F.lit(0.0)) for c in CLASSES))
    rows = stored(prep.fraction(v.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("x"), y.alias("y")), "id"))
    held = rows.where("fold = 'val'")
    return held, training.train(rows.where("fold = 'train'"), held, f"{shared_folder(spark).rstrip('/')}/heads-{uuid.uuid4().hex}", SCHEDULE)


@query(_heads_sql(SCHEDULE, "SELECT DISTINCT epoch::INTEGER AS epoch, round(own_lr, 6) AS lr, round(train, 6) AS train_loss, round(val, 6) AS val_loss FROM r JOIN sp USING (n) WHERE last"))
def train_heads(spark, d):
    """Rates and losses of the epochs in which logistic heads learn the vectors' labels."""
    got = _trained(spark, d)[1].history(SCHEDULE.lr)
    return got.select("epoch", *(F.round(c, 6).alias(c) for c in ("lr", "train_loss", "val_loss")))


_HEADS_AUROC = """, bs AS (SELECT DISTINCT c, w FROM r JOIN sp USING (n) WHERE last AND epoch = (SELECT arg_max(best_epoch, n) FROM r)),
sc AS (SELECT c, label = c AS truth, list_inner_product(w, x) AS s FROM bs, dt WHERE NOT tr), rk AS (SELECT *, rank() OVER (PARTITION BY c ORDER BY s) + (count(*) OVER (PARTITION BY c, s) - 1) / 2 AS r FROM sc)
SELECT c::VARCHAR AS class, round((sum(r) FILTER (WHERE truth) - sum(truth::INTEGER) * (sum(truth::INTEGER) + 1) / 2) / nullif(sum(truth::INTEGER) * (count(*) - sum(truth::INTEGER)), 0), 6) AS auroc FROM rk GROUP BY c"""


@query(_heads_sql(SCHEDULE, _HEADS_AUROC))
def train_heads_auroc(spark, d):
    """AUROC of each label on the held-out vectors, by the weights of the epoch with the lowest loss."""
    held, run = _trained(spark, d)
    return evaluate.auroc(training.scores(held, run.best(), CLASSES))
