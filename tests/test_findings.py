"""What reviews of the operators found."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from strataloom.operators import blocks, costs, graph, labels, mentions, ontology, retrieve, vectors


def test_concepts_once_a_string(spark):
    """Reports with the same label string are one row until their concepts are known."""
    rows = spark.createDataFrame([(i, None if i % 3 == 2 else ["a|b", "c"][i % 3]) for i in range(300)], "report_id long, s string")
    concepts = spark.createDataFrame([("a", "p1"), ("b", "p1"), ("b", "p2"), ("d", "p3")], "label string, cui string")
    assert {tuple(r) for r in labels.string_concepts(rows, "s", concepts).collect()} == {("a|b", "p1"), ("a|b", "p2")}
    got = {r.report_id: r.cuis for r in labels.concepts_of(rows, "s", concepts).collect()}
    assert got == {i: ["p1", "p2"] if i % 3 == 0 else [] for i in range(300)}


def test_equal_vectors_are_compared_once(spark, monkeypatch):
    """Many copies of few vectors: exact, and only the different ones are compared."""
    rng = np.random.default_rng(1)
    kinds = rng.integers(-2, 3, size=(12, 4)).astype(float)
    kinds[3] = 0
    kind = rng.integers(0, 12, size=400)
    df = spark.createDataFrame([(i, kinds[j].tolist()) for i, j in enumerate(kind)], "id long, embedding array<double>").repartition(4)
    compared, plain = [], vectors._compared

    def counted(queries, known, *more):
        compared.append((queries.count(), known.count()))
        return plain(queries, known, *more)

    monkeypatch.setattr(vectors, "_compared", counted)
    u = kinds[kind] / np.maximum(np.linalg.norm(kinds[kind], axis=1, keepdims=True), 1e-300)
    for own in (True, False):
        got = {}
        for r in vectors.knn(df.where("id % 7 = 0"), df, 5, exclude_self=own).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.ref_id))
        for q in range(0, 400, 7):
            s = np.round(u @ u[q], 6)
            assert [i for _, i in sorted(got[q])] == sorted((i for i in range(400) if i != q or not own), key=lambda i: (-s[i], i))[:5]
    assert all(max(pair) <= 12 for pair in compared)


def _contents_by_hand():
    """Ancestors of concepts as (number, content), the largest content first, and the best common one of two."""
    rng = np.random.default_rng(5)
    content = np.sort(rng.random(20))[::-1]
    up = [np.sort(rng.choice(20, size=rng.integers(0, 6), replace=False)) for _ in range(30)]
    best = lambda a, b: max((content[z] for z in np.intersect1d(up[a], up[b])), default=0.0)
    return content, up, best


def _bma(best, a, b):
    m = np.array([[best(x, y) for y in b] for x in a])
    return (m.max(1).mean() + m.max(0).mean()) / 2


def test_best_matches_are_made_of_a_row_a_pair(monkeypatch):
    """A pair is one row, however many concepts it has, and a few values are held at once."""
    content, up, best = _contents_by_hand()
    monkeypatch.setattr(ontology, "MATCHED", 10)
    rng = np.random.default_rng(6)
    sides = [(rng.choice(30, size=rng.integers(1, 5)), rng.choice(30, size=rng.integers(1, 5))) for _ in range(40)]
    batch = pa.RecordBatch.from_pydict({
        "target_id": list(range(40)), "ref_id": list(range(40)), "t_up": pa.array([[up[c].tolist() for c in a] for a, _ in sides], pa.list_(pa.list_(pa.int64()))),
        "t_ics": pa.array([[content[up[c]].tolist() for c in a] for a, _ in sides], pa.list_(pa.list_(pa.float64()))), "r_up": pa.array([[up[c].tolist() for c in b] for _, b in sides], pa.list_(pa.list_(pa.int64()))),
    })
    (got,) = ontology._best_matches([batch])
    np.testing.assert_allclose(got.column("bma").to_numpy(), [_bma(best, a, b) for a, b in sides], atol=1e-12)


def test_only_the_concepts_of_compared_pairs_are_matched(monkeypatch):
    """Not all concepts of a block with all of the references."""
    content, up, best = _contents_by_hand()
    rng = np.random.default_rng(7)
    targets, refs = [rng.choice(30, size=n) for n in (3, 1, 4)], [rng.choice(30, size=n) for n in (2, 0, 5, 1)]
    own = np.concatenate(targets)
    lists = lambda values, kind: pa.array(values, pa.list_(kind))
    held = blocks._Contents(np.repeat([1, 4, 6], [3, 1, 4]), own, lists([up[c].tolist() for c in own], pa.int64()), lists([content[up[c]].tolist() for c in own], pa.float64()))
    monkeypatch.setattr(blocks._Contents, "_matches", None)
    c_z = lists([[up[c].tolist() for c in r] for r in refs], pa.list_(pa.int64()))
    row, place = np.array([0, 0, 1, 2, 2, 3, 3]), np.array([1, 6, 1, 4, 5, 6, 1])
    want = [_bma(best, targets[[1, 4, 6].index(t)], refs[r]) if t in (1, 4, 6) and len(refs[r]) else 0.0 for r, t in zip(row, place)]
    np.testing.assert_allclose(held.best_match_at(c_z, None, row, place), want, atol=1e-12)


def test_trees_of_vertices_with_the_same_neighbours(spark, monkeypatch):
    """They are searched as one, and the rows are those of a search vertex by vertex."""
    rng = np.random.default_rng(8)
    rel = [(f"p{i:02}", f"b{i % 3}", "SY" if i % 2 else "PAR") for i in range(24)] + [(f"p{i:02}", f"t{i % 2}", "CHD") for i in range(24)] + [("b0", "q", "SY"), ("q", "z", "RQ"), ("b1", "z", "SY")]
    ways = graph.both_ways(graph.edge_relations(spark.createDataFrame(rel, "a string, b string, rel string")))
    roots = spark.createDataFrame([(f"s{k}", v) for k, own in enumerate([["b0"], ["p00", "p06"], ["p06"], ["z", "p01"], list(rng.choice([f"p{i:02}" for i in range(24)], 5, replace=False))]) for v in own], "root_set string, v string")
    plain = {tuple(r) for r in graph.unmasked(graph.forest(ways, roots, 5, width=64, tree=True)).select("root_set", "v", "depth", "pred", "all_sy", "only_sy", "steps", "cost").collect()}
    made, forest = [], graph.forest
    monkeypatch.setattr(graph, "forest", lambda *a, **k: made.append(forest(*a, **k)) or made[-1])
    got = [tuple(r) for r in graph.bfs(ways, roots, 5).collect()]
    assert len(got) == len(plain) and set(got) == plain
    assert {r.v for r in made[0].levels.where("depth > 0").select("v").collect()} < {r[1] for r in plain}


def test_inferred_is_propagated_negation_and_modifiers(spark):
    """In one pass as step by step, with equal entities, missing labels and relations to nothing."""
    rng = np.random.default_rng(3)
    states = [f"{kind}::{state}" for kind in ("Anatomy", "Observation") for state in ("definitely present", "definitely absent", "uncertain")] + [None]
    rows = [(r, e, None if rng.random() < 0.1 else f"T{rng.integers(4)}", states[rng.integers(len(states))], r * e) for r in range(60) for e in range(6)]
    ent = spark.createDataFrame(rows + rows[:3], "report_id long, ent long, token string, label string, more long")
    pairs = {(int(r), int(a), int(b)) for r, a, b in zip(rng.integers(0, 62, 500), rng.integers(0, 7, 500), rng.integers(0, 7, 500))}
    rel = spark.createDataFrame(sorted(pairs), "report_id long, ent long, other long")
    note = spark.createDataFrame([(r, f"t{r % 4}", "Observation::definitely present") for r in range(0, 60, 2)], "report_id long, token string, label string")
    for of_note in (None, note):
        own = mentions.propagate_negation(ent if of_note is None else mentions.override_labels(ent, of_note), rel)
        exp = own.join(mentions.modifiers(own, rel), ["report_id", "ent"], "left").withColumn("mods", F.coalesce("mods", F.array().cast("array<string>")))
        got = mentions.inferred(ent, rel, of_note)
        assert sorted(map(repr, got.select(exp.columns).collect())) == sorted(map(repr, exp.collect()))
        assert any(r.label != x.label for r, x in zip(sorted(got.collect(), key=repr), sorted(ent.collect(), key=repr)))


def test_mentions_are_not_broadcast(spark, tmp_path):
    """A stored table of many mentions is a small file; no join may send all of it to the driver and every task."""
    rows = spark.range(4000).select((F.col("id") % 500).alias("report_id"), F.col("id").alias("ent"), F.lit("t").alias("token"), F.lit("Anatomy::uncertain").alias("label"), F.lit(0).alias("sentence"))
    rows.write.parquet(f"{tmp_path}/mentions")
    ent = spark.read.parquet(f"{tmp_path}/mentions")
    found = ent.withColumnsRenamed({"ent": "seq", "label": "category"})
    rel = ent.select("report_id", "ent", F.col("ent").alias("other"))
    for got in (mentions.inferred(ent, rel), mentions.related(found), mentions.propagate_negation(ent, rel), mentions.modifiers(ent, rel)):
        assert "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_report_labels_meet_names_once(spark, tmp_path):
    """As by direct() and broader(), with several names of a concept, equal seqs and missing values, but mentions are read once."""
    rng = np.random.default_rng(5)
    pick = lambda xs: xs[rng.integers(len(xs))]
    ids = [f"c{n}" for n in range(12)]
    names = spark.createDataFrame([(pick(ids), pick(["Edema of it", "pneumonia, edema", "fracture", "other", None])) for _ in range(20)], "cui string, name string")
    parents = spark.createDataFrame([(pick(ids), pick(ids)) for _ in range(10)], "cui string, parent string")
    rows = [(pick([*range(40), None]), pick(["1", "2", "3", None]), pick([*ids, "x", None]), pick([*ids, None]), pick(["present", "absent", "uncertain"]), pick([0.0, 0.5, 1.0, None]), pick([0.0, 0.5, 0.7, None])) for _ in range(300)]
    spark.createDataFrame(rows, "report_id long, seq string, cui string, cui_text string, assertion string, score_text double, score_surface double").write.parquet(f"{tmp_path}/mentions")
    found = spark.read.parquet(f"{tmp_path}/mentions")
    kinds = ["Edema", "Pneumonia", "Fracture"]
    near = labels.direct(found, names, kinds)
    up = labels.broader(found, near, parents, names, kinds)
    exp = {tuple(r) for r in labels.strongest(near.select("report_id", "label", "assertion").unionByName(up.select("report_id", "label", "assertion"))).collect() if r.report_id is not None}
    got = labels.report_labels(spark.range(40).withColumnRenamed("id", "report_id"), found, names, parents, kinds)
    assert {tuple(r) for r in got.collect() if r.label != "No Finding"} == exp and len({x for _, x, _ in exp}) == 3
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") == 1


def test_only_what_can_enter_is_sorted(spark, monkeypatch):
    """Many steps, ties and near ties, of which only what can enter is sorted: the k best as by brute force."""
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(900, 6)), 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>").coalesce(1)
    monkeypatch.setattr(vectors, "STEP", 64)
    monkeypatch.setattr(vectors, "CELLS", 1)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    got = {}
    for r in vectors.knn(df.where("id % 9 = 0"), df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.ref_id, r.score))
    for q in range(0, 900, 9):
        s = np.round(u @ u[q], 6)
        exp = sorted((i for i in range(900) if i != q), key=lambda i: (-s[i], i))[:3]
        assert [(i, v) for _, i, v in sorted(got[q])] == [(i, s[i]) for i in exp]


def test_umls_compares_only_what_shares_a_weight(spark):
    """Depths are those of the whole search, and no pair is compared that has no common weight, but for a few of those targets that need them."""
    rng = np.random.default_rng(21)
    leaves, hubs = [f"p{i}" for i in range(150)], ["h0", "h1", "h2", "h3"]
    some_of = [("h0", "h1"), ("h1", "h2"), ("h0",), ("h3",)]
    links = {(a, h) for a in leaves[:-5] for h in some_of[rng.integers(4)]} | {("h2", "q"), ("q", "z"), ("z", "h3"), ("p7", "p8")}
    way = graph.both_ways(spark.createDataFrame([(a, b, ["SY"]) for a, b in sorted(links)], "a string, b string, rels array<string>"))
    sets_of = lambda p, key, n, names: [(f"{p}{i:03}", c) for i in range(n) for c in rng.choice(names, rng.integers(1, 6), replace=False)]
    t, r = sets_of("t", "target_id", 30, [*leaves, *hubs]), sets_of("r", "ref_id", 400, [*leaves, *hubs, "x"])
    t += [("t900", "p3"), ("t901", "y"), ("t902", "p149"), ("t903", "x")]
    t, r = spark.createDataFrame(t, "target_id string, concept string"), spark.createDataFrame(r, "ref_id string, concept string")
    weight = spark.createDataFrame([(c, k % 4) for k, c in enumerate([*leaves, *hubs, "x", "y"])], "concept string, weight long").withColumn("weight", F.when(F.col("concept") == "p3", 0).otherwise(F.col("weight")))
    own = t.select(F.col("concept").alias("root")).distinct()
    for depth in (1, 6):
        far = graph.distances(way, own, depth)
        net = graph.web(way, own.withColumnRenamed("root", "v"), r.select(F.col("concept").alias("v")), depth)
        near, at, to = ({x[0]: x[1] for x in d.collect()} for d in (net.near, net.roots, net.places))
        want = {(x.root, x.v): x.depth for x in far.where("root <> v").collect()}
        places = {x.concept for x in r.select("concept").distinct().collect()}
        assert {(a, b): near[at[a]][to[b]] for a in at for b in to if a != b and near[at[a]][to[b]] < 255} == {k: d for k, d in want.items() if k[1] in places}
    found = graph.bfs(way, t.select(F.col("target_id").alias("root_set"), F.col("concept").alias("v")), 6)
    p = costs.Pairing(t, r, weight=weight, found=found, distances=far.select(F.col("root").alias("concept"), F.col("v").alias("other"), "depth"))
    exp = {(x.target_id, x.ref_id): (x.cost, x["rank"]) for x in vectors.top(costs.cost("umls", p), "target_id", [F.asc("cost"), F.asc("ref_id")], 3).collect()}
    cells = spark.sparkContext.accumulator(0)
    got = {(x.target_id, x.ref_id): (x.cost, x["rank"]) for x in costs.best("umls", costs.Pairing(t, r, weight=weight, web=net), 3, cells).collect()}
    assert got == exp and {"t900", "t903"} <= {a for a, _ in got} and not any(a == "t901" for a, _ in got)
    assert cells.value < 34 * 400 / 2


def test_references_that_masks_do_not_tell_apart_are_one(spark):
    """As by a row for each pair, where targets share something with the first references of a kind; and fewer than a quarter of the pairs are compared."""
    rng = np.random.default_rng(31)
    leaves = [f"p{i:03}" for i in range(240)]
    links = [(a, f"h{i % 4}", ["SY"] if i % 3 else ["PAR"]) for i, a in enumerate(leaves)] + [("h0", "q", ["SY"]), ("h1", "q", ["SY"]), ("h2", "z", ["PAR"]), ("q", "z", ["SY"])]
    way = graph.both_ways(spark.createDataFrame(links, "a string, b string, rels array<string>"))
    pick = lambda most: rng.choice([*leaves[:-4], "h3", "x"], rng.integers(1, most), replace=False)
    refs = [pick(3) if i % 5 else pick(9) for i in range(1200)]
    targets = [list(refs[i]) + list(pick(2)) if i % 2 else list(refs[i]) for i in range(40)] + [["x"], ["y"], ["p239"], ["p239", "p236"]]
    rows = lambda p, sets_: [(f"{p}{i:04}", c) for i, s in enumerate(sets_) for c in set(map(str, s))]
    t, r = spark.createDataFrame(rows("t", targets), "target_id string, concept string"), spark.createDataFrame(rows("r", refs), "ref_id string, concept string")
    tn = spark.createDataFrame(rows("t", [pick(3) for _ in targets[:-2]]), "target_id string, concept string")
    rn = spark.createDataFrame(rows("r", [pick(3) for _ in range(900)]), "ref_id string, concept string")
    weight = spark.createDataFrame([(c, 3 - k % 4) for k, c in enumerate([*leaves, "h3", "x", "y"])], "concept string, weight long")
    roots = t.select(F.col("target_id").alias("root_set"), F.col("concept").alias("v"))
    net = graph.forest(way, roots, 4, twins=True, alike=True)
    for name in ("depth", "umls_neg"):
        p = costs.Pairing(t, r, weight=weight, target_neg=tn, ref_neg=rn, found=graph.bfs(way, roots, 4, measures=False), beta=0.5)
        exp = {(x.target_id, x.ref_id): (x.cost, x["rank"]) for x in vectors.top(costs.cost(name, p), "target_id", [F.asc("cost"), F.asc("ref_id")], 3).collect()}
        cells = spark.sparkContext.accumulator(0)
        got = {(x.target_id, x.ref_id): (x.cost, x["rank"]) for x in costs.best(name, costs.Pairing(t, r, weight=weight, target_neg=tn, ref_neg=rn, forest=net, beta=0.5), 3, cells).collect()}
        assert got == exp and len(got) > 100
        assert cells.value < 44 * 1200 / 4


def test_a_chain_of_turns_that_drive_each_other_out_takes_few_rounds(spark, monkeypatch):
    """Turn i takes what turn i + 1 wants most: one round in a task, a few over several tasks, and no more pages than needed."""
    n, calls, top = 40, [], retrieve.top
    monkeypatch.setattr(retrieve, "top", lambda *a: calls.append(1) or top(*a))
    wanted = {i: [max(i, 1), i + 1, i + 2, 500 + i] for i in range(n)}
    rng = np.random.default_rng(4)
    mixed = {i: list(map(int, rng.permutation(30)[: rng.integers(2, 12)])) for i in range(n)}
    for lists, seeds, most in ((wanted, 2048, 6), (wanted, 10, 16), (mixed, 2048, 60), (mixed, 7, 60)):
        monkeypatch.setattr(retrieve, "SEEDS", seeds)
        calls.clear()
        turns = spark.createDataFrame([(i, 0, i % 33) for i in range(n)], "step int, cls_no int, seed_id int")
        ranked = spark.createDataFrame([(i, r, r / 10, k + 1) for i in range(33) for k, r in enumerate(lists[i])], "seed_id int, ref_id int, cost double, rank int")
        exp, used = [], set()
        for i in range(n):
            free = [r for r in lists[i % 33] if r not in used]
            if free:
                exp.append((i, 0, i % 33, free[0], free[0] / 10))
                used.add(free[0])
        assert sorted(tuple(r) for r in retrieve.greedy(turns, ranked).collect()) == exp
        assert len(calls) <= most


def test_references_go_only_where_they_share_something(spark, monkeypatch):
    """The same rows by groups of blocks as by one, also for targets that share nothing; references are sent to about as many groups as they share something with."""
    rng = np.random.default_rng(12)
    own = lambda j, n: [f"p{j * 20 + c}" for c in rng.choice(20, n, replace=False)]
    rows = [(j * 100 + i, c) for j in range(6) for i in range(100) if i % 9 for c in own(j, rng.integers(1, 5))]
    negated = [(j * 100 + i, c) for j in range(6) for i in range(100) if i % 4 for c in own(j, rng.integers(1, 3))]
    side = lambda d, key, keep: spark.createDataFrame([x for x in d if keep(x[0])], f"{key} long, concept string")
    query = lambda i: i % 5 == 0
    t, r = side([(i, c if i % 25 else "x" + c) for i, c in rows], "target_id", query), side(rows, "ref_id", lambda i: True)
    tn, rn = side(negated, "target_id", query), side(negated, "ref_id", lambda i: True)
    targets, refs = (spark.range(600).withColumnRenamed("id", c) for c in ("target_id", "ref_id"))
    pairings = costs.Pairing(t, r, target_neg=tn, ref_neg=rn), costs.Pairing(tn, rn)
    search = lambda: [{tuple(x) for x in d.collect()} for d in (costs.best("jac", pairings[0], 3), retrieve.nearest(targets.where("target_id % 5 = 0"), refs, *pairings, "dice", 3))]
    exp, sent, plain = search(), [], blocks._sent

    def counted(*a):
        left, right = plain(*a)
        sent.append(left.count())
        return left, right

    monkeypatch.setattr(blocks, "_sent", counted)
    monkeypatch.setattr(blocks, "WIDE", 16)
    monkeypatch.setattr(blocks, "GROUP_BYTES", 1)
    assert search() == exp
    assert len(sent) == 2 and max(sent) < 3 * 600
    assert {x[0] for x in exp[1]} == set(range(0, 600, 5))
