"""URL filters by link-graph propagation, in DataFrame functions only.

Rules on host and path decide first.  What no rule fits is judged by its host:
personalised PageRank carries trust from hosts whose pages the rules allow along
the links, and distrust from hosts whose pages they block against them; a host
with more distrust than trust, and at least THRESHOLD, is blocked.  Scores are in units
of what a seed without links has.  What reaches hosts without onward links returns to the
seeds; that multiplies all scores of a kind by one number, and the unit by the same, so
verdicts don't need it, and propagate() does it at the end.

Links are reduced to distinct host pairs before they travel.  The two scores are
rows of one table, so an iteration is one join and one partial-aggregated sum; the
links of a hub are dealt to several tasks;
every CUT iterations the scores are written to the shared folder.  The iteration
ends when what is still to come is at most TOLERANCE of what a seed without links has.

Defined results: a null url, or one without ://, has an empty host and path, fits
no rule and is allowed; hosts without links keep their seed; ties are allowed; repeated pages are judged row by row, and
repeat their links; a page of any length gives all its links; null html has none; columns besides page_id, url and html are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _spark

#: (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
DAMPING = 0.85
TOLERANCE = 1e-10
#: As many suffice for a single seed; the mass to come falls by DAMPING at least.
ITERATIONS = math.ceil(math.log(TOLERANCE * (1 - DAMPING)) / math.log(DAMPING))
CUT = 4
THRESHOLD = 0.25
#: A host's pages are dealt to this many tasks when its verdict is joined to them.
SALTS = 16
_LINK = r"""(?i)\shref\s*=\s*["']?\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"'\s>]+)"""


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host(url: Column) -> Column:
    return F.coalesce(_lower(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 1)), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://([^/?#]*)([^?#]*)", 2), F.lit(""))


def matched(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct(rule, verdict); null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for verdict, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        out = F.when(fits, F.struct(F.lit(rule_host + rule_path).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def host_edges(pages: DataFrame) -> DataFrame:
    """Distinct (src, dst) of links between different hosts; pages: host, html."""
    linked = pages.select("host", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(_LINK), F.lit(1)))).alias("dst"))
    return linked.select(F.col("host").alias("src"), _lower(F.col("dst")).alias("dst")).where("src <> '' AND src <> dst").distinct()


def spread(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, score): kind 'trust' flows along the edges (src, dst), 'distrust' against them; what reaches hosts without onward links is lost.

    seeds: (host, kind, seed), where the seeds of a kind sum to 1.  No score is short by
    more than the tolerance times what the least seed of its kind has without links.
    """
    edges = _spark.written(edges, "links")
    total = edges.count()
    each = max(1, -(-total // _spark.HEAVY))
    ways, hubs = [], []
    for kind, a, b in (("trust", "src", "dst"), ("distrust", "dst", "src")):
        degree = _spark.written(edges.groupBy(a).agg(F.count(F.lit(1)).alias("n")), "degrees")
        salts = F.ceil(F.col("n") / each).cast("int")
        ways.append(_spark.spread_join(edges, degree, a, "n", total).select(F.col(a).alias("host"), F.lit(kind).alias("kind"), F.pmod(F.xxhash64(b), salts).cast("int").alias("salt"), F.col(b).alias("to"), (F.lit(damping) / F.col("n")).alias("part")))
        hubs.append(degree.where(F.col("n") > each).select(F.col(a).alias("host"), F.lit(kind).alias("kind"), salts.alias("salts")))
    flows = _spark.written(reduce(DataFrame.unionByName, ways), "flows")
    hubs = _spark.written(reduce(DataFrame.unionByName, hubs), "hubs")  # 2 * HEAVY rows at most
    seeds = _spark.written(seeds, "seeds")
    base = seeds.select("host", "kind", (F.col("seed") * (1 - damping)).alias("score"))
    enough = {r["kind"]: tolerance * (1 - damping) * r["least"] for r in seeds.groupBy("kind").agg(F.min("seed").alias("least")).collect()}  # two rows
    # last: what the last iteration added; the iterations after it add damping / (1 - damping) times its sum at most
    scores = base.withColumn("last", F.col("score"))
    base = base.withColumn("last", F.lit(0.0))
    old = None
    while enough:
        for _ in range(CUT):
            salted = scores.join(F.broadcast(hubs), ["host", "kind"], "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
            moved = salted.join(flows, ["host", "kind", "salt"]).select(F.col("to").alias("host"), "kind", (F.col("score") * F.col("part")).alias("score"), (F.col("last") * F.col("part")).alias("last"))
            scores = moved.unionByName(base).groupBy("host", "kind").agg(F.sum("score").alias("score"), F.sum("last").alias("last"))
        scores = _spark.written(scores, "scores")
        if old is not None:
            _spark.drop_written(old)
        old = scores
        if all(r["mass"] * damping / (1 - damping) <= enough[r["kind"]] for r in scores.groupBy("kind").agg(F.sum("last").alias("mass")).collect()):
            break
    return scores.drop("last")


def propagate(edges: DataFrame, seeds: DataFrame, damping: float = DAMPING, tolerance: float = TOLERANCE) -> DataFrame:
    """(host, kind, score): personalised PageRank of both kinds, each of which sums to 1; see spread()."""
    scores = spread(edges, seeds, damping, tolerance)
    sums = scores.groupBy("kind").agg(F.sum("score").alias("all"))  # two rows
    return scores.join(F.broadcast(sums), "kind").select("host", "kind", (F.col("score") / F.col("all")).alias("score"))


def blocked_hosts(judged: DataFrame, edges: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(host, trust, distrust) of hosts that the method blocks; judged: (host, verdict), null where no rule fits."""
    votes = judged.where("host <> ''").groupBy("host").agg(F.count(F.when(F.col("verdict") == "allow", 1)).alias("a"), F.count(F.when(F.col("verdict") == "block", 1)).alias("b"))
    votes = _spark.written(votes, "votes")
    sides = votes.select("host", F.when(F.col("a") > F.col("b"), "trust").when(F.col("b") > F.col("a"), "distrust").alias("kind")).where("kind is not null")
    sizes = sides.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))  # two rows
    seeds = sides.join(F.broadcast(sizes), "kind").select("host", "kind", (F.lit(1.0) / F.col("n")).alias("seed"))
    scores = spread(edges, seeds).join(F.broadcast(sizes), "kind").withColumn("score", F.col("score") * F.col("n") / (1 - DAMPING))
    wide = scores.groupBy("host").agg(*(F.round(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("score"))), F.lit(0.0)), 9).alias(k) for k in ("trust", "distrust")))
    return wide.where((F.col("distrust") > F.col("trust")) & (F.col("distrust") >= threshold))


def judge(pages: DataFrame, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict) of every page."""
    url = F.col("url").cast("string")
    parsed = pages.select("page_id", host(url).alias("host"), path(url).alias("path"), "html").withColumn("m", matched(F.col("host"), F.col("path"), rules))
    narrow = parsed.select("page_id", "host", "path", F.col("m.rule").alias("rule"), F.col("m.verdict").alias("by_rule"))
    edges = host_edges(parsed.select("host", F.col("html").cast("string").alias("html")))
    bad = blocked_hosts(narrow.select("host", F.col("by_rule").alias("verdict")), edges).select("host", F.lit(True).alias("bad"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int"))
    return salted.join(bad, ["host", "salt"], "left").select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("bad"), "block").otherwise("allow")).alias("verdict"))


def op10_url_filter(spark, sf_dir: str) -> DataFrame:
    return judge(_spark.table(spark, sf_dir, "pages"))
