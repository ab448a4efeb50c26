"""Operators on hand-made fixtures with known answers, and invariants."""

import itertools
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from strataloom import sources
from strataloom.functions import text, vocab
from strataloom.operators import blocks, costs, evaluate, graph, labels, mentions, ontology, prep, retrieve, scans, sets, vectors
from strataloom.plans import flows
from strataloom.streaming import each_batch


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} {'array<int>' if isinstance(values[n], list) and n == 'v' else 'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)).select(column.alias("x")).collect()[0].x


def pairs(spark, sets_, key):
    return spark.createDataFrame([(k, c) for k, s in sets_.items() for c in s], f"{key} string, concept string")


# ------------------------------------------------------------- text


@pytest.mark.parametrize("given,expected", [("Effusion|Pleural|Opacity", "Pleural Effusion|Lung Opacity"), ("Pleural|Device", "Pleural Other|Support Devices"), (None, None), (" Edema | Lesion ", "Edema|Lung Lesion"), ("", "")])
def test_normalize_labels(spark, given, expected):
    assert one(spark, text.normalize_labels(F.col("s")), s=given) == expected


@pytest.mark.parametrize("given,expected", [("Edema|Pneumonia", [0, 0, 0, 0, 1, 0, 1, 0]), (None, [1] + [0] * 7), ("", [0] * 8), ("Edema,Pneumonia|x", [0] * 8)])
def test_label_vector(spark, given, expected):
    assert one(spark, text.label_vector(F.col("s"), 8), s=given) == expected


def test_vector_findings(spark):
    assert one(spark, text.vector_findings(F.col("v")), v=[0, 1, 0, 0, 1]) == "Atelectasis, Edema"
    assert one(spark, text.vector_findings(F.col("v")), v=[0, 0]) == "No Finding"


@pytest.mark.parametrize("given,expected", [("No effusion", "absent"), ("possible no change", "uncertain"), ("no.", "present"), ("  Without\tpain ", "absent"), ("", "present")])
def test_negation(spark, given, expected):
    assert one(spark, text.negation(F.col("s")), s=given) == expected


def test_small_text_functions(spark):
    assert tuple(one(spark, text.mention_span(F.col("n"), F.col("t")), n="A Small Ring", t="small")) == (2, 7)
    assert tuple(one(spark, text.mention_span(F.col("n"), F.col("t")), n="abc", t="x")) == (-1, -1)
    assert one(spark, text.decoded_assertion(F.col("c")), c="Anatomy::uncertain") == "uncertain"
    assert one(spark, text.decoded_assertion(F.col("c")), c="Other::definitely present") == "na"
    assert one(spark, text.assertion_code(F.col("c")), c="na") is None
    assert one(spark, text.surface(F.col("m"), F.col("t")), m=["left", "lower"], t="lobe ") == "left lower lobe"
    assert one(spark, text.rewritten_path(F.col("p"), "/base/", ".png"), p="a/b.c/d.e.jpg") == "/base/a/b.c/d.e.png"
    assert one(spark, text.coverage(F.col("a"), F.col("b")), a=["x", "y", "z"], b=["x", "y"]) == pytest.approx(0.666667, abs=1e-6)
    assert one(spark, text.coverage(F.col("a"), F.col("b")), a=[], b=["x"]) == 1.0
    assert one(spark, text.jaccard(F.col("a"), F.col("b")), a=[], b=[]) == 0.0


# ------------------------------------------------------------- sources


def test_study_table(spark, tmp_path):
    (tmp_path / "s.csv").write_text('dicom_id,subject_id,Edema,impression,extra\nd1,10.0,1.0,"two\nlines, ""q""",x\nd2,,nan,,\n')
    got = sources.study_table(spark, str(tmp_path / "s.csv")).orderBy("dicom_id").collect()
    assert (got[0].subject_id, got[0].Edema, got[0].impression, got[0].extra) == (10.0, 1.0, 'two\nlines, "q"', "x")
    assert got[1].subject_id is None and got[1].Edema is None
    with pytest.raises(ValueError):
        sources.study_table(spark)


def test_rrf_readers(spark, tmp_path):
    import gzip

    conso = [["C1", "ENG", "P", "", "", "", "", "A1", "", "", "", "SNOMEDCT_US", "", "", 'a "quoted name', "", "", ""], ["C2", "ENG", "", "", "", "", "", "A2", "", "", "", "SNOMEDCT_US", "", "", "two", "", "", ""], ["C3", "ENG", "S", "", "", "", "", "A3", "", "", "", "SNOMEDCT_US", "", "", "suppressed", "", "", ""], ["C4", "GER", "P", "", "", "", "", "A4", "", "", "", "SNOMEDCT_US", "", "", "vier", "", "", ""]]
    (tmp_path / "MRCONSO.RRF").write_text("".join("|".join(r) + "|\n" for r in conso))
    names = sources.concept_names(sources.rrf(spark, str(tmp_path / "MRCONSO.RRF"), "MRCONSO"))
    assert {tuple(r) for r in names.collect()} == {("C1", 'a "quoted name'), ("C2", "two")}
    with gzip.open(tmp_path / "MRSTY.RRF.gz", "wt") as f:
        f.write("C1|T046|s|t|a||\nC1|T047|s|t|a||\nC2|T033|s|t|a||\nC5|T017|s|t|a||\n")
    types = sources.semantic_types(sources.numbered(sources.rrf(spark, str(tmp_path / "MRSTY.RRF.gz"), "MRSTY")))
    assert dict(types.collect()) == {"C1": "T047", "C2": "T033", "C5": "T017"}
    rel = [("C1", "PAR", "C2", "SNOMEDCT_US"), ("C1", "PAR", "C2", "SNOMEDCT_US"), ("C1", "PAR", "C1", "SNOMEDCT_US"), ("C2", "PAR", "C5", "SNOMEDCT_US"), ("C2", "SY", "C1", "X"), ("C2", "XX", "C1", "X")]
    (tmp_path / "MRREL.RRF").write_text("".join(f"{a}|A|S|{r}|{b}|A|S|x|R|SR|sab|{sl}|g|d|n||\n" for a, r, b, sl in rel))
    mrrel = sources.rrf(spark, str(tmp_path / "MRREL.RRF"), "MRREL")
    assert [tuple(r) for r in sources.parent_relations(mrrel, types).collect()] == [("C1", ["C2"])]
    assert {tuple(r) for r in sources.graph_relations(mrrel).collect()} == {("C1", "C2", "PAR"), ("C2", "C5", "PAR"), ("C2", "C1", "SY")}
    (tmp_path / "MRHIER.RRF").write_text("C1|A1|1|A2|s||||||\nC2|A2|1||s||||||\nC3|A3|1|A9|s||||||\nC2|A2|2|A2|s||||||\n")
    hier = sources.hierarchy(sources.numbered(sources.rrf(spark, str(tmp_path / "MRHIER.RRF"), "MRHIER")))
    assert [tuple(r) for r in hier.collect()] == [("C1", "C2")]


def test_cache_reads_through(spark, tmp_path):
    calls = []

    def make(rows):
        got = rows.select("report_id", F.upper("text").alias("u"))
        calls.append(got.count())
        return got

    a = spark.createDataFrame([(1, "a"), (2, "b")], "report_id long, text string")
    b = spark.createDataFrame([(1, "a"), (2, "changed"), (3, "c")], "report_id long, text string")
    path = str(tmp_path / "cache")
    assert {tuple(r) for r in sources.cached(spark, path, make, texts=a).select("report_id", "u").collect()} == {(1, "A"), (2, "B")}
    assert {tuple(r) for r in sources.cached(spark, path, make, texts=b).select("report_id", "u").collect()} == {(1, "A"), (2, "CHANGED"), (3, "C")}
    sources.cached(spark, path, make, texts=b).count()
    assert calls == [2, 2]


def test_sinks_and_names(spark, tmp_path):
    config = sources.Config.of({"metric": "dice", "alpha": 0.25})
    assert sources.output_name("acc", config, ["No Finding"], "m") == "acc_dice_a0.25_b1_m_NoFinding"
    with pytest.raises(ValueError):
        sources.Config.of({"nope": 1})
    df = spark.createDataFrame([("a", 0.5), ("b", 1.0)], "class string, auroc double")
    sources.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 2
    assert [r.value for r in sources.metrics_lines(df, evaluate.macro(df)).collect()] == ["AUROC mean: 0.750000", "a: 0.500000", "b: 1.000000"]


def test_images_fall_back_per_row(spark, tmp_path):
    for n in ("a.jpg", "b.png"):
        (tmp_path / n).write_bytes(b"x")
    files = sources.images(spark, str(tmp_path))
    rows = spark.createDataFrame([(f"file:{tmp_path}/{n}.jpg",) for n in "abc"], "path string")
    got = {r.path[-5]: r.found and r.found[-5:] for r in sources.resolved_images(rows, files).collect()}
    assert got == {"a": "a.jpg", "b": "b.png", "c": None}


# ------------------------------------------------------------- prep


def test_dataset(spark):
    df = spark.createDataFrame([("1", "r", "p/a.x.png", 3.0), ("2", None, "q.png", 3.0), ("3", "r", "s", 3.0), ("4", "r", "t.png", 1.0)], "id string, rep string, pic string, split double")
    got = prep.dataset(df, "id", 1, "pic", "b/", split_value="3.0", split_column="split")
    assert {tuple(r) for r in got.collect()} == {("1", "r", "b/p/a.x.jpg"), ("3", "r", "b/s.jpg")}
    assert prep.dataset(df, "id", 1, "pic", split_value="3", split_column="split").count() == 0


def test_one_label_and_flags(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, 1.0, 1.0), (3, 0.0, -1.0), (4, None, 1.0)], "k int, `A b` double, c double")
    assert {(r.k, r.label) for r in prep.one_label(df, ["A b", "c"]).collect()} == {(1, "A b"), (4, "c")}
    assert {tuple(r) for r in prep.histogram(df, ["A b", "c"]).collect()} == {("A b", 2), ("c", 2)}


def test_splits_are_exact_and_disjoint(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, rng.randrange(600), rng.choice("ab")) for i in range(3000)], "id int, subject int, cls string")
    parts = prep.three_way(df, "cls", "id", "subject", (20, 30, 40)).cache()
    assert {(r.part, r.cls): r["count"] for r in parts.groupBy("part", "cls").count().collect()} == {(p, c): n for p, n in (("test", 20), ("retrieve", 30), ("train", 40)) for c in "ab"}
    assert {r.n_shared for r in prep.shared_subjects(parts, "subject").collect()} == {0}
    again = prep.three_way(df.repartition(7), "cls", "id", "subject", (20, 30, 40))
    assert set(again.collect()) == set(parts.collect())
    with pytest.raises(ValueError):
        prep.stratified(df, "cls", "id", 10**6, strict=True)
    assert {r.fold: r["count"] for r in prep.fraction(df, "id").groupBy("fold").count().collect()} == {"train": 2400, "val": 600}


def test_candidate_pool_first_class_wins(spark):
    df = spark.createDataFrame([(1, "Edema|Pneumonia"), (2, "Pneumonia"), (3, None), (4, "Edema")], "id int, s string")
    used = spark.createDataFrame([(4,)], "id int")
    got = prep.candidate_pool(df, [used], "id", "s", ["Pneumonia", "Edema"])
    assert {(r.id, r.cls) for r in got.collect()} == {(1, "Pneumonia"), (2, "Pneumonia")}


def test_picks_and_first(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(10)], "id int, cls string")
    wanted = spark.createDataFrame([("a", 0), ("a", 3), ("b", 4), ("b", 9)], "cls string, ordinal int")
    assert {r.id for r in prep.picks(df, "cls", ["id"], wanted).collect()} == {0, 6, 9}
    assert {r.id for r in prep.first_per_key(df, ["cls"], ["id"], last=True).collect()} == {8, 9}


# ------------------------------------------------------------- mentions and labels

MENTION = "report_id string, seq int, cui string, cui_text string, assertion string, category string, score_text double, score_surface double"


def test_concept_sets(spark):
    rows = [
        ("r1", 1, "a", "b", "present", "Anatomy::definitely present", 1.0, 1.0), ("r2", 1, "a", "b", "present", "Anatomy::definitely present", 1.0, 1.0), ("r2", 2, "c", None, "present", "Observation::definitely present", 1.0, 1.0),
        ("r3", 1, "d", "e", "absent", "Anatomy::definitely absent", 1.0, 1.0), ("r3", 2, "f", "f", "uncertain", "Observation::uncertain", 1.0, 1.0), ("r3", 3, "g", "g", "na", "Other", 1.0, 1.0),
    ]
    reports = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "report_id string")
    got = {r.report_id: (r.pos, r.neg) for r in mentions.concept_sets(reports, spark.createDataFrame(rows, MENTION)).collect()}
    assert got == {"r1": ([], []), "r2": (["a", "b", "c"], []), "r3": (["f", "g"], ["d", "e"]), "r4": ([], [])}


def test_negation_spreads_unless_anchored(spark):
    p, a = "Observation::definitely present", "Observation::definitely absent"
    ent = spark.createDataFrame([("r", 1, a), ("r", 2, p), ("r", 3, p), ("r", 4, p), ("r", 5, "Anatomy::definitely present")], "report_id string, ent int, label string")
    rel = spark.createDataFrame([("r", 1, 2), ("r", 1, 3), ("r", 3, 4), ("r", 1, 5)], "report_id string, ent int, other int")
    got = {r.ent: r.label for r in mentions.propagate_negation(ent, rel).collect()}
    assert got == {1: a, 2: a, 3: p, 4: p, 5: "Anatomy::definitely absent"}


def test_note_labels_override_sentences(spark):
    ent = spark.createDataFrame([("r", "Heart", "x"), ("r", "lung", "y")], "report_id string, token string, label string")
    note = spark.createDataFrame([("r", "heart", "z")], "report_id string, token string, label string")
    assert {r.token: r.label for r in mentions.override_labels(ent, note).collect()} == {"Heart": "z", "lung": "y"}


def test_lexicon_extractor(spark):
    terms = spark.createDataFrame([("pleural effusion", "c1"), ("edema", "c2")], "term string, cui string")
    reports = spark.createDataFrame([("r1", "No pleural effusion. Possible edema"), ("r2", "Edema.\nHeart fine"), ("r3", "")], "report_id string, text string")
    got = {(r.report_id, r.cui): r.assertion for r in mentions.lexicon(terms)(reports).collect()}
    assert got == {("r1", "c1"): "absent", ("r1", "c2"): "uncertain", ("r2", "c2"): "present"}


def test_linking_prefers_allowed_types(spark):
    ranked = spark.createDataFrame([("m1", "Observation", 1, "x"), ("m1", "Observation", 2, "y"), ("m2", "Anatomy", 1, "x"), ("m2", "Anatomy", 2, "y")], "mention string, category string, rank int, cui string")
    types = spark.createDataFrame([("y", "T047")], "cui string, tui string")
    assert {(r.mention, r.cui) for r in mentions.link(ranked, types).collect()} == {("m1", "y"), ("m2", "x")}


def test_report_labels(spark):
    names = spark.createDataFrame([("c1", "Pulmonary EDEMA"), ("c2", "pleural effusion"), ("c3", "something"), ("c4", "fracture of rib")], "cui string, name string")
    parents = spark.createDataFrame([("c3", "c4")], "cui string, parent string")
    o = "Observation::x"
    rows = [("r1", 1, "c1", "c2", "present", o, 0.9, 0.5), ("r1", 2, "c2", "c2", "absent", o, 0.7, 0.8), ("r2", 1, "c3", "c3", "uncertain", o, 1.0, 1.0), ("r3", 1, "c1", "c1", "na", o, 1.0, 1.0), ("r3", 2, "c1", "c1", "uncertain", o, 1.0, 1.0)]
    m = spark.createDataFrame(rows, MENTION)
    reports = spark.createDataFrame([("r1",), ("r2",), ("r3",), ("r4",)], "report_id string")
    got = labels.report_labels(reports, m, names, parents).cache()
    # r1: 'Effusion' comes before 'Pleural'; the text score beats the surface score; absent beats present
    assert {tuple(r) for r in got.collect()} == {("r1", "Effusion", "absent"), ("r2", "Fracture", "uncertain"), ("r3", "Edema", "uncertain"), ("r4", "No Finding", "present")}
    wide = {r.report_id: r for r in labels.label_table(got, ["Edema", "Effusion", "Fracture", "No Finding"]).collect()}
    assert (wide["r1"].Effusion, wide["r1"].finding_labels, wide["r4"]["No Finding"], wide["r4"].finding_labels) == (0, "No Finding", 1, "No Finding")
    assert {r.report_id: r.finding_labels for r in labels.label_table(got, ["Edema"], use_uncertain=True).collect()} == {"r1": "No Finding", "r2": "Fracture", "r3": "Edema", "r4": "No Finding"}


def test_choose_label(spark):
    rows = spark.createDataFrame([("same", "A|B", "A|B"), ("one", "A", "B"), ("two", "B", "A"), ("both", "A", "B"), ("tie", "A", "B"), ("empty", "A", None), ("part", "A|C", "B|C")], "report_id string, label1 string, label2 string")
    present = spark.createDataFrame([("one", "a"), ("two", "a"), ("both", "a"), ("both", "b"), ("part", "a"), ("part", "b"), ("part", "c")], "report_id string, concept string")
    concepts = spark.createDataFrame([("A", "a"), ("B", "b"), ("C", "c")], "label string, cui string")
    got = {r.report_id: (r.choice, r.label) for r in labels.choose(rows, present, concepts).collect()}
    assert got == {"same": ("identical", "A|B"), "one": ("label1", "A"), "two": ("label2", "A"), "both": ("union", "A|B"), "tie": ("label1", "A"), "empty": ("label1", "A"), "part": ("union", "A|C|B")}


def test_label_concepts(spark):
    seeds = spark.createDataFrame([(k, c) for k, cs in vocab.LABEL_CONCEPTS.items() for c in (cs or [None])], "label string, cui string")
    m = spark.createDataFrame([("r", 1, "x1", "x2", "present", "o", 1.0, 1.0)], MENTION)
    names = spark.createDataFrame([("x1", "Small effusion"), ("x2", "pacemaker")], "cui string, name string")
    types = spark.createDataFrame([("x2", "T074")], "cui string, tui string")
    got = {tuple(r) for r in labels.label_concepts(m, names, types, seeds).collect()}
    assert {("Pleural Effusion", "x1"), ("Support Devices", "x2"), ("Edema", "C0013604")} <= got
    assert not any(k == "No Finding" for k, _ in got)


# ------------------------------------------------------------- graph and ontology


def chain_graph(spark):
    rel = [("a", "b", "SY"), ("b", "c", "SY"), ("b", "c", "PAR"), ("c", "d", "CHD"), ("a", "e", "RQ"), ("e", "d", "PAR"), ("x", "x", "SY")]
    return graph.edge_relations(spark.createDataFrame(rel, "a string, b string, rel string"))


def test_bfs_tree(spark):
    roots = spark.createDataFrame([("s", "a"), ("two", "a"), ("two", "d")], "root_set string, v string")
    rows = graph.bfs(graph.both_ways(chain_graph(spark)), roots, 10).collect()
    got = {(r.root_set, r.v): (r.depth, r.pred, r.all_sy, r.only_sy, r.steps, r.cost) for r in rows}
    assert got["s", "a"] == (0, None, True, True, 0.5, 0.0)
    assert got["s", "b"] == (1, "a", True, True, 1.0, 0.0)
    assert got["s", "c"] == (2, "b", True, True, 1.0, 1.0)
    assert got["s", "e"] == (1, "a", False, True, 1.0, 0.0)
    assert got["s", "d"] == (2, "e", False, False, 1.0, 1.0)
    assert got["two", "d"][0] == 0 and got["two", "c"][:2] == (1, "d") and got["two", "e"][:2] == (1, "a")
    assert {r.v for r in graph.synonyms(spark.createDataFrame(rows)).withColumnRenamed("concept", "v").where("root_set = 's'").collect()} == {"b", "c"}
    cut = graph.bfs(graph.both_ways(chain_graph(spark)), roots.where("root_set = 's'"), 1)
    assert {r.v for r in cut.collect()} == {"a", "b", "e"}


def test_chain_measures(spark):
    e = chain_graph(spark)
    found = graph.bfs(graph.both_ways(e), spark.createDataFrame([("s", "a")], "root_set string, v string"), 1)
    refs = spark.createDataFrame([("r", "b"), ("r", "d"), ("r", "zz")], "ref_id string, concept string")
    known = graph.vertices(e, e.select(F.col("a").alias("concept")))
    r = graph.chain_measures(found, refs, known).collect()[0]
    assert (r.not_synonym, r.steps, r.cost) == (1, 1.0 + 0.5 + 1, 10.0)


def test_subgraphs(spark):
    e = chain_graph(spark)
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "concept string")
    as_set = lambda d: {(r.a, r.b) for r in d.collect()}
    assert as_set(graph.induced(e, nodes)) == {("a", "b"), ("b", "c")}
    assert as_set(graph.without(e, nodes)) == {("d", "e")}
    roots = spark.createDataFrame([("s", "a")], "root_set string, v string")
    assert as_set(graph.trimmed(e, roots, 1)) == {("a", "b"), ("b", "c"), ("a", "e"), ("d", "e")}
    assert {(r.src, r.dst) for r in graph.level_dag(e, roots, 5).collect()} == {("a", "b"), ("a", "e"), ("b", "c"), ("c", "d"), ("e", "d")} - {("c", "d")}
    keep = spark.createDataFrame([("a",), ("lone",)], "concept string")
    assert {(r.concept, r.degree) for r in graph.vertices(e, keep).collect()} >= {("a", 2), ("lone", 0)}
    rel = spark.createDataFrame([("a", "b", "SY"), ("b", "c", "SY")], "a string, b string, rel string")
    assert graph.keep_edges(rel, keep).count() == 0 and graph.keep_edges(rel, keep, both=False).count() == 1


def hierarchy(spark):
    return spark.createDataFrame([("p1", "b"), ("p2", "b"), ("p1", "t"), ("p2", "t"), ("b", "root"), ("t", "root")], "child string, parent string")


def test_information_content(spark):
    lone = spark.createDataFrame([("z",)], "node string")
    got = {r.node: r.ic for r in ontology.information_content(hierarchy(spark), lone).collect()}
    ln2 = math.log(2)
    assert got == pytest.approx({"p1": ln2, "p2": ln2, "b": 0, "t": 0, "root": -ln2, "z": 0})


def test_lin(spark):
    h = hierarchy(spark)
    closure, ic = ontology.ancestors(h), ontology.information_content(h)
    t = pairs(spark, {"T": ["p1", "p2"], "E": ["q"], "R": ["root"]}, "target_id")
    r = pairs(spark, {"x": ["p1"], "y": ["nothing"], "z": ["root"]}, "ref_id")
    every = spark.createDataFrame([(a, b) for a in ("T", "E", "R") for b in ("x", "y", "z")], "target_id string, ref_id string")
    got = {(k.target_id, k.ref_id): k.cost for k in ontology.lin_cost(every, t, r, closure, ic).collect()}
    # p1-p1 has ln 2, p2-p1 has 0 (b, t)
    assert got["T", "x"] == pytest.approx(1 - 2 * ((1 / 2 + 1) / 2 * math.log(2)) / (2 * math.log(2)))
    assert got["E", "y"] == 0.0 and got["E", "x"] == 1.0 and got["T", "y"] == 1.0


# ------------------------------------------------------------- costs


def pairing(spark, weight, **more):
    t, r = pairs(spark, {"T": "abc"}, "target_id"), pairs(spark, {"R": "bcde"}, "ref_id")
    return costs.Pairing(t, r, weight=spark.createDataFrame(list(weight.items()), "concept string, weight long"), **more)


def test_set_costs(spark):
    w = {"a": 3, "b": 2, "c": 1, "d": 0, "e": 3}
    value = lambda name, p: costs.cost(name, p).collect()[0].cost
    p = pairing(spark, w, alpha=0.1, beta=0.9)
    assert (value("dice", p), value("overlap", p), value("jac", p)) == (0.428571, 0.333333, 0.6)
    assert value("tversky", p) == 0.5
    assert value("sym_tversky", pairing(spark, w)) == 0.5
    assert value("sym_tversky", pairing(spark, w, target_neg=pairs(spark, {"T": "b"}, "target_id"))) == 0.625
    with pytest.raises(NotImplementedError):
        costs.cost("nope", p)


def test_depth_cost(spark):
    found = spark.createDataFrame([("T", "a", 0), ("T", "b", 0), ("T", "c", 0), ("T", "d", 1), ("T", "e", 2)], "root_set string, v string, depth int")
    assert costs.cost("depth", pairing(spark, {"a": 1}, found=found)).collect()[0].cost == 0.422319


def test_synonyms_count_as_the_target(spark):
    found = spark.createDataFrame([("T", "a", 0, True), ("T", "d", 1, True), ("T", "e", 1, False)], "root_set string, v string, depth int, all_sy boolean")
    w = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 3}
    # forward: e (3), as d is a synonym; backward: a (1)
    assert costs.cost("sym_tversky", pairing(spark, w, found=found)).collect()[0].cost == round(1 - 2 / (2 + 0.5 * 1 + 0.5 * 3), 6)


def test_umls_cost(spark):
    w = {"a": 1, "b": 1, "c": 1, "d": 2, "e": 3}
    found = spark.createDataFrame([("T", c, 0) for c in "abc"] + [("T", "d", 2)], "root_set string, v string, depth int")
    far = spark.createDataFrame([("a", "b", 1), ("b", "b", 0), ("c", "c", 0), ("a", "a", 0)], "concept string, other string, depth int")
    # forward: d at level 2 (index 1); reverse: a at level 1; m = 1; e is out of reach
    forward = math.exp(-0.5) * 2 * 2 + 3 * 2
    reverse = math.exp(-1.0) * 1 * 1 + 3 * 2
    got = costs.cost("umls", pairing(spark, w, found=found, distances=far)).collect()[0].cost
    assert got == round(1 - 2 / (2 + forward + reverse), 6)


def test_umls_neg_cost(spark):
    w = dict.fromkeys("abcde", 1)
    p = pairing(spark, w, alpha=0.5, beta=0.5, target_neg=pairs(spark, {"T": "ax"}, "target_id"), ref_neg=pairs(spark, {"R": "a"}, "ref_id"))
    # contradiction a: 1; positive 2 / (5 + 1); negated 1 / (1 + 1), x has no weight
    assert costs.cost("umls_neg", p).collect()[0].cost == round(1 - (0.5 * 2 / 6 + 0.5 * 1 / 2), 6)


def test_costs_are_bounded_and_symmetric(spark):
    rng = random.Random(5)
    every = {str(i): rng.sample("abcdefgh", rng.randrange(1, 6)) for i in range(25)}
    t, r = pairs(spark, every, "target_id"), pairs(spark, every, "ref_id")
    weight = spark.createDataFrame([(c, k % 4) for k, c in enumerate("abcdefgh")], "concept string, weight long")
    for name in ("jac", "dice", "overlap", "tversky", "sym_tversky"):
        got = {(x.target_id, x.ref_id): x.cost for x in costs.cost(name, costs.Pairing(t, r, weight=weight)).collect()}
        assert all(0 <= c <= 1 for c in got.values())
        if name != "tversky":
            assert all(c == got[b, a] for (a, b), c in got.items())
        assert set(got) == {(a, b) for a, b in itertools.product(every, every) if set(every[a]) & set(every[b])}


# ------------------------------------------------------------- retrieval


def closest(spark, t_pos, t_neg, r_pos, r_neg, k=2, how="rows", **more):
    frame = lambda s, key: pairs(spark, s, key) if any(s.values()) else spark.createDataFrame([], f"{key} string, concept string")
    ids = lambda a, b, key: spark.createDataFrame([(x,) for x in sorted({*a, *b})], f"{key} string")
    targets, refs = ids(t_pos, t_neg, "target_id"), ids(r_pos, r_neg, "ref_id")
    four = [frame(t_pos, "target_id"), frame(t_neg, "target_id"), frame(r_pos, "ref_id"), frame(r_neg, "ref_id")]
    if how == "rows":
        got = retrieve.closest(targets, refs, *four, k, lambda a, b: costs.dice(costs.Pairing(a, b)), **more)
    else:
        got = retrieve.nearest(targets, refs, costs.Pairing(four[0], four[2], target_neg=four[1], ref_neg=four[3]), costs.Pairing(four[1], four[3]), "dice", k, **more)
    out = {}
    for r in sorted(got.collect(), key=lambda r: (r.target_id, r["rank"])):
        out.setdefault(r.target_id, []).append((r.ref_id, r.cost, r.neg_cost, r.branch))
    return out


REFS = {"r1": "ab", "r2": "abc", "r3": "", "r4": "", "r5": "xyz"}
NEGS = {"r1": "", "r2": "n", "r3": "no", "r4": "q", "r5": "n"}


@pytest.mark.parametrize("how", ["rows", "blocks"])
def test_closest_branches(spark, how):
    got = closest(spark, {"pos": "ab", "neg": "", "none": "", "both": "ab", "alien": "k", "odd": "ab"}, {"pos": "", "neg": "no", "none": "", "both": "n", "alien": "", "odd": "u"}, REFS, NEGS, how=how)
    assert got["pos"] == [("r1", 0.0, 0.0, "main"), ("r2", 0.2, 0.0, "main")]
    assert got["neg"] == [("r3", 0.0, 0.0, "neg"), ("r4", 1.0, 0.0, "neg")]
    assert {x[0] for x in got["none"]} == {"r3", "r4"} and got["none"][0][1:] == (0.0, 0.0, "random")
    assert got["both"] == [("r2", 0.2, 0.0, "main")]  # r1 negates nothing
    assert got["alien"] == [("r3", 1.0, 0.0, "subset"), ("r4", 1.0, 0.0, "subset")]
    assert got["odd"] == [("r2", 0.2, 1.0, "main")]


@pytest.mark.parametrize("how", ["rows", "blocks"])
def test_closest_without_empty_references(spark, how):
    refs = {k: v for k, v in REFS.items() if v}
    got = closest(spark, {"neg": "", "alien": "k", "pos": "ab"}, {"neg": "no", "alien": "", "pos": "m"}, refs, {"r1": "", "r2": "", "r5": "n"}, allow_empty=False, how=how)
    assert got["neg"] == [("r1", 1.0, 1.0, "smallest")]
    assert got["alien"] == [("r1", 1.0, 0.0, "subset")]
    assert got["pos"] == [("r1", 0.0, 0.0, "main"), ("r2", 0.2, 0.0, "main")]  # no valid pair negates: all by cost


@pytest.mark.parametrize("how", ["rows", "blocks"])
def test_closest_uses_reach(spark, how):
    reach = spark.createDataFrame([("t", "a"), ("t", "x")], "target_id string, concept string")
    got = closest(spark, {"t": "a"}, {"t": ""}, {"r1": "x", "r2": "a", "r3": "q"}, {}, k=5, reach=reach, how=how)
    assert got["t"] == [("r2", 0.0, 0.0, "main"), ("r1", 1.0, 0.0, "main")]
    with pytest.raises(ValueError):
        closest(spark, {"t": "a"}, {}, REFS, {}, k=0, how=how)
    with pytest.raises(ValueError):
        retrieve.check_known(pairs(spark, {"t": "ab"}, "target_id"), spark.createDataFrame([("a",)], "concept string"))


def test_blocks_equal_rows(spark, monkeypatch):
    """Both ways give the same, with blocks of two targets and steps of three references."""
    monkeypatch.setattr(blocks, "BLOCK_TARGETS", 2)
    monkeypatch.setattr(blocks, "STEP", 3)
    rng = random.Random(8)
    some = lambda n, low: {f"{n}{i}": "".join(rng.sample("abcdefg", rng.randrange(low, 5))) for i in range(14)}
    for low in (0, 1):
        sets_ = some("t", 0), some("t", 0), some("r", low), some("r", 0)
        kept = {k: v for k, v in sets_[2].items() if v or not low}
        rows, both = (closest(spark, sets_[0], sets_[1], kept, {k: sets_[3][k] for k in kept}, k=3, how=how, allow_empty=not low) for how in ("rows", "blocks"))
        assert rows == both and len({x[3] for v in rows.values() for x in v}) > 1


@pytest.mark.parametrize("name", ["jac", "dice", "overlap", "tversky", "sym_tversky", "umls_neg", "depth", "umls"])
def test_best_equals_all_costs(spark, name):
    rng = random.Random(4)
    letters = "abcdefghij"
    some = lambda key, p: pairs(spark, {f"{p}{i}": rng.sample(letters, rng.randrange(1, 5)) for i in range(12)}, key)
    edges = spark.createDataFrame([(a, b, rng.choice([["SY"], ["PAR"], ["CHD", "SY"]])) for a, b in zip(letters, letters[1:])], "a string, b string, rels array<string>")
    t = some("target_id", "t")
    way = graph.both_ways(edges)
    far = graph.distances(way, t.select(F.col("concept").alias("root")), 3).select(F.col("root").alias("concept"), F.col("v").alias("other"), "depth")
    weight = spark.createDataFrame([(c, k % 4) for k, c in enumerate(letters)], "concept string, weight long")
    p = costs.Pairing(t, some("ref_id", "r"), weight=weight, target_neg=some("target_id", "t"), ref_neg=some("ref_id", "r"), found=graph.bfs(way, t.select(F.col("target_id").alias("root_set"), F.col("concept").alias("v")), 3), distances=far)
    got = {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in costs.best(name, p, 4).collect()}
    exp = {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in vectors.top(costs.cost(name, p), "target_id", [F.asc("cost"), F.asc("ref_id")], 4).collect()}
    assert got == exp and len(got) > 12


@pytest.mark.parametrize("name", ["dice", "sym_tversky"])
def test_bounds_leave_most_pairs_out(spark, name):
    """Pairs without a common concept aren't compared; the rows are the same."""
    rng = random.Random(3)
    letters = [f"c{i}" for i in range(400)]
    some = lambda key, p, n: pairs(spark, {f"{p}{i}": rng.sample(letters, 4) for i in range(n)}, key)
    p = costs.Pairing(some("target_id", "t", 30), some("ref_id", "r", 300), weight=spark.createDataFrame([(c, 1 + i % 3) for i, c in enumerate(letters)], "concept string, weight long"))
    cells = spark.sparkContext.accumulator(0)
    got = {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in costs.best(name, p, 3, cells).collect()}
    assert got == {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in vectors.top(costs.cost(name, p), "target_id", [F.asc("cost"), F.asc("ref_id")], 3).collect()}
    assert 0 < cells.value < 30 * 300 / 10


def test_vertices_with_the_same_neighbours_are_searched_once(spark):
    """The masks' rows grow with the different neighbourhoods, not with the concepts; costs are those of the whole search."""
    rng = random.Random(11)
    leaves, hubs = [f"p{i}" for i in range(120)], ["h0", "h1", "h2", "z"]
    links = {(a, h): ["SY"] if i % 2 else ["PAR"] for i, a in enumerate(leaves[:-4]) for h in rng.choice([("h0", "h1"), ("h1", "h2"), ("h0",)])} | {("h2", "z"): ["SY"]}
    way = graph.both_ways(spark.createDataFrame([(a, b, r) for (a, b), r in links.items()], "a string, b string, rels array<string>"))
    some = lambda key, p, n: pairs(spark, {f"{p}{i}": rng.sample([*leaves, *hubs], rng.randrange(1, 5)) for i in range(n)}, key)
    t, tn, r, rn = some("target_id", "t", 12), some("target_id", "t", 12), some("ref_id", "r", 30), some("ref_id", "r", 30)
    roots = t.select(F.col("target_id").alias("root_set"), F.col("concept").alias("v"))
    weight = spark.createDataFrame([(c, k % 4) for k, c in enumerate([*leaves, *hubs])], "concept string, weight long")
    forests = graph.forest(way, roots, 5), graph.forest(way, roots, 5, twins=True)
    assert forests[1].levels.count() < forests[0].levels.count() / 2
    rows = lambda d: {(x.target_id, x.ref_id): (x.cost, x["rank"]) for x in d.collect()}
    for name in ("depth", "sym_tversky", "umls_neg"):
        whole, short = (rows(costs.best(name, costs.Pairing(t, r, weight=weight, target_neg=tn, ref_neg=rn, forest=f), 4)) for f in forests)
        assert whole == short and len(whole) >= 12


def test_references_go_out_once_for_all_blocks(spark, monkeypatch):
    """However many blocks the targets make, a cell has them all, and each reference is in one cell."""
    monkeypatch.setattr(blocks, "WIDE", 8)
    rows, cell = spark.sparkContext.accumulator(0), blocks._cell

    def counted(*a):
        run = cell(*a)

        def counting(left, right):
            rows.add(left.num_rows)
            return run(left, right)

        return counting

    monkeypatch.setattr(blocks, "_cell", counted)
    rng = random.Random(5)
    some = lambda key, p, n: pairs(spark, {f"{p}{i}": rng.sample("abcdefghij", 3) for i in range(n)}, key)
    p = costs.Pairing(some("target_id", "t", 30), some("ref_id", "r", 50))
    got = {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in costs.best("dice", p, 3).collect()}
    assert rows.value == 50
    assert got == {(r.target_id, r.ref_id): (r.cost, r["rank"]) for r in vectors.top(costs.cost("dice", p), "target_id", [F.asc("cost"), F.asc("ref_id")], 3).collect()}


def test_targets_that_share_nothing_stop_early(spark, monkeypatch):
    """A target without positive concepts isn't compared with all references; the rows are the same."""
    monkeypatch.setattr(blocks, "STEP", 4)
    rng = random.Random(7)
    names = [f"c{i}" for i in range(200)]
    some = lambda n, k, p: {f"{n}{i}": rng.sample(names, rng.randrange(1, 4)) if rng.random() < p else [] for i in range(k)}
    t, tn, r, rn = some("t", 20, 0.3), some("t", 20, 0.5), some("r", 300, 0.7), some("r", 300, 0.5)
    frames = [pairs(spark, s, key) for s, key in ((t, "target_id"), (tn, "target_id"), (r, "ref_id"), (rn, "ref_id"))]
    ids = [spark.createDataFrame([(x,) for x in s], f"{key} string") for s, key in ((t, "target_id"), (r, "ref_id"))]
    score = lambda a, b: costs.cost("dice", costs.Pairing(a, b))
    want = retrieve.closest(*ids, frames[0], frames[1], frames[2], frames[3], 3, score)
    cells = spark.sparkContext.accumulator(0)
    got = retrieve.nearest(*ids, costs.Pairing(frames[0], frames[2], target_neg=frames[1], ref_neg=frames[3]), costs.Pairing(frames[1], frames[3]), "dice", 3, cells=cells)
    key = ["target_id", "ref_id", "cost", "neg_cost", "branch", "rank"]
    assert {tuple(x[c] for c in key) for x in got.collect()} == {tuple(x[c] for c in key) for x in want.collect()}
    assert 0 < cells.value < 20 * 300 / 2


def some_contents(spark, rng):
    """A hierarchy over letters, and what lin needs of it; not all letters are in it."""
    tree = [(c, p) for c, p in zip("abcdefgh", "ijijkkkl")] + [("i", "m"), ("j", "m"), ("k", "n"), ("m", "n"), ("l", "n"), ("a", "k")]
    h = spark.createDataFrame(tree, "child string, parent string")
    some = lambda key, p: pairs(spark, {f"{p}{i}": rng.sample("abcdefghxy", rng.randrange(1, 5)) for i in range(14)}, key)
    return costs.Pairing(some("target_id", "t"), some("ref_id", "r"), closure=ontology.ancestors(h), ic=ontology.information_content(h))


def test_information_content_in_blocks(spark, monkeypatch):
    """lin by blocks, of sharing pairs and of all, equals lin by rows."""
    monkeypatch.setattr(blocks, "MATCHED", 3)
    p = some_contents(spark, random.Random(9))
    rows = lambda d, *c: {tuple(r[x] for x in ("target_id", "ref_id", *c)) for r in d.collect()}
    assert rows(costs.best("lin", p, 4), "cost", "rank") == rows(vectors.top(costs.cost("lin", p), "target_id", [F.asc("cost"), F.asc("ref_id")], 4), "cost", "rank")
    ids = [d.select(c).distinct() for d, c in ((p.targets, "target_id"), (p.refs, "ref_id"))]
    every = ids[0].crossJoin(ids[1])
    want = costs.cost("lin", costs.Pairing(**{**p.__dict__, "pairs": every}))
    reach = ids[0].crossJoin(p.refs.select("concept").distinct())
    none = costs.Pairing(p.targets.limit(0), p.refs.limit(0))
    got = retrieve.nearest(*ids, p, none, "lin", 14, reach=reach)
    assert rows(got, "cost") == rows(want, "cost") and {r.branch for r in got.collect()} == {"main"}
    first = retrieve.nearest(*ids, p, none, "lin", 1)
    assert rows(first, "cost") == rows(costs.best("lin", p, 1), "cost")


def test_nearest_spills_over(spark):
    """What is left follows: paired, unpaired, then sets that nothing is shared with, the smallest first."""
    t_pos, t_neg = {"t": "ab", "n": "", "o": ""}, {"t": "n", "n": "n", "o": ""}
    got = closest(spark, t_pos, t_neg, {**REFS, "r6": "z", "r7": "abq"}, {**NEGS, "r6": "n", "r7": "n"}, k=9, how="blocks", spill=True)
    assert [x[0] for x in got["t"]] == ["r2", "r7", "r1", "r3", "r4", "r6", "r5"]
    assert [x[0] for x in got["n"]][:2] == ["r3", "r4"] and [x[0] for x in got["n"]][2] == "r6"
    assert {x[0] for x in got["o"][:2]} == {"r3", "r4"} and len(got["o"]) == 7


def one_by_one(turns, lists):
    """What turns (step, cls_no, seed) take in order from lists (seed -> references)."""
    used, out = set(), []
    for step, cls_no, seed in sorted(turns):
        ref = next((r for r in lists.get(seed, []) if r not in used), None)
        if ref is not None:
            used.add(ref)
            out.append((step, cls_no, seed, ref))
    return out


@pytest.mark.parametrize("page", [1, 2, 64])
def test_greedy_reads_on_page_by_page(spark, monkeypatch, page):
    """Deferred acceptance over pages gives what one turn after the other takes, also where lists end."""
    monkeypatch.setattr(retrieve, "PAGE", page)
    rng = random.Random(page)
    lists = {f"s{i}": rng.sample([f"r{k}" for k in range(9)], rng.choice([1, 4, 9])) for i in range(4)}
    turns = [(step, c, rng.choice([*lists, "none"])) for step in range(6) for c in range(2)]
    rows = spark.createDataFrame([(s, r, i / 10, i + 1) for s, refs in lists.items() for i, r in enumerate(refs)], "seed_id string, ref_id string, cost double, rank int")
    asked = []

    def more(last):
        asked.append(1)
        old = last.select("seed_id", F.col("rank").alias("o"))
        return rows.join(old, "seed_id").where((F.col("rank") > F.col("o")) & (F.col("rank") <= F.col("o") + page)).withColumn("rank", (F.col("rank") - F.col("o")).cast("int")).drop("o")

    got = retrieve.greedy(spark.createDataFrame(turns, "step int, cls_no int, seed_id string"), rows.where(F.col("rank") <= page), more)
    assert sorted((r.step, r.cls_no, r.seed_id, r.ref_id) for r in got.collect()) == one_by_one(turns, lists)
    assert asked


def test_searches_go_on_behind_a_row(spark):
    """Pages of a search are the parts of the whole search."""
    rng = random.Random(6)
    some = lambda n: {f"{n}{i}": "".join(rng.sample("abcdefg", rng.randrange(0, 5))) for i in range(20)}
    frame = lambda s, key: pairs(spark, s, key)
    t, tn, r, rn = frame(some("t"), "target_id"), frame(some("t"), "target_id"), frame(some("r"), "ref_id"), frame(some("r"), "ref_id")
    ids = lambda key, n: spark.createDataFrame([(f"{n}{i}",) for i in range(20)], f"{key} string")
    search = lambda k, after=None: retrieve.nearest(ids("target_id", "t"), ids("ref_id", "r"), costs.Pairing(t, r, target_neg=tn, ref_neg=rn), costs.Pairing(tn, rn), "dice", k, spill=True, after=after)
    as_lists = lambda d: {x: [r.ref_id for r in sorted(rows, key=lambda r: r["rank"])] for x, rows in itertools.groupby(sorted(d.collect(), key=lambda r: r.target_id), key=lambda r: r.target_id)}
    whole, first = as_lists(search(20)), search(7)
    second = search(7, first.where("rank = 7"))
    assert all(len(v) == 20 for v in whole.values())
    assert as_lists(first) == {k: v[:7] for k, v in whole.items()} and as_lists(second) == {k: v[7:14] for k, v in whole.items()}
    v = spark.createDataFrame([(i, [rng.choice([0.0, 1.0]) for _ in range(3)]) for i in range(30)], "id long, embedding array<double>")
    near = lambda k, after=None: {x: [r.ref_id for r in sorted(rows, key=lambda r: r["rank"])] for x, rows in itertools.groupby(sorted(vectors.knn(v.where("id < 5"), v, k, after=after).collect(), key=lambda r: r.query_id), key=lambda r: r.query_id)}
    assert near(6, vectors.knn(v.where("id < 5"), v, 4).where("rank = 4")) == {k: x[4:] for k, x in near(10).items()}


def trees(edges, roots, depth):
    """Breadth-first trees, one root set and vertex after the other."""
    out, ways = {}, {}
    for a, b, rels in edges:
        ways.setdefault(a, {})[b] = ways.setdefault(b, {})[a] = rels
    for s in {s for s, _ in roots}:
        seen = level = {v: (0, None, True, True, [], 0.0) for x, v in roots if x == s}
        for d in range(1, depth + 1):
            new = {}
            for src in sorted(level):
                for v, rels in ways.get(src, {}).items():
                    if v not in seen and v not in new:
                        _, _, sy, only, path, cost = level[src]
                        other = [x for x in rels if x not in ("RQ", "SY")]
                        new[v] = (d, src, sy and "SY" in rels, only and bool({"RL", "RQ", "SY"} & set(rels)), [bool(other), *path], cost + (0.0 if not other else 0.5 if "CHD" in other else 1.0))
            level, seen = new, seen | new
        for v, (d, src, sy, only, path, cost) in seen.items():
            n = 0.0
            for step in path:
                n = n + 1 if step else n or 1.0
            out[s, v] = (d, src, sy, only, n or 0.5, cost)
    return out


@pytest.mark.parametrize("hub", [graph.HUB, 5])
def test_forest_equals_trees_one_by_one(spark, hub):
    """All masks and carried numbers, with several chunks of root sets, and with hubs whose neighbours are folded by parts."""
    rng = random.Random(hub)
    v = [f"v{i:02d}" for i in range(40)]
    edges = {tuple(sorted(rng.sample(v, 2))): sorted(rng.sample(["SY", "PAR", "CHD", "RQ", "RL"], rng.choice([1, 1, 2]))) for _ in range(60)}
    edges |= {(v[0], x): ["SY"] if i % 2 else ["PAR"] for i, x in enumerate(v[1:30])}
    edges = [(a, b, r) for (a, b), r in edges.items()]
    roots = [(f"s{i}", rng.choice(v)) for i in range(70) for _ in range(rng.choice([1, 3]))]
    e = graph.both_ways(spark.createDataFrame(edges, "a string, b string, rels array<string>"))
    r = spark.createDataFrame(roots, "root_set string, v string")
    want = trees(edges, roots, 6)
    got = graph.unmasked(graph.forest(e, r, 6, width=32, tree=True, hub=hub)).collect()
    assert {(x.root_set, x.v): (x.depth, x.pred, x.all_sy, x.only_sy, x.steps, x.cost) for x in got} == want and len(got) == len(want)
    found = graph.forest(e, r, 6, width=32, hub=hub)
    assert {(x.root_set, x.v): (x.depth, x.all_sy) for x in graph.unmasked(found).collect()} == {k: (x[0], x[2]) for k, x in want.items()}
    assert found.levels.count() < len(want) / 4  # masks, not rows


def test_greedy_equals_brute_force_with_collisions(spark):
    rng = random.Random(2)
    seeds = [f"s{i}" for i in range(4)]
    cost = {(s, f"r{j}"): (j * 7 % 5 + rng.randrange(2)) / 10 for s in seeds for j in range(12)}
    budgets = spark.createDataFrame([(0, "x", 5), (1, "y", 3), (2, "z", 0)], "cls_no int, cls string, budget int")
    turns = retrieve.schedule(budgets, spark.createDataFrame([("x", 0, "s0"), ("x", 1, "s1"), ("y", 0, "s2"), ("y", 1, "s3")], "cls string, pos int, seed_id string"))
    ranked = vectors.top(spark.createDataFrame([(*k, c) for k, c in cost.items()], "seed_id string, ref_id string, cost double"), "seed_id", [F.asc("cost"), F.asc("ref_id")], 8)
    got = [(r.step, r.cls_no, r.seed_id, r.ref_id) for r in sorted(retrieve.greedy(turns, ranked).collect(), key=lambda r: (r.step, r.cls_no))]
    left, exp = {r for _, r in cost}, []
    for t in sorted(turns.collect(), key=lambda t: (t.step, t.cls_no)):
        best = min(left, key=lambda r: (cost[t.seed_id, r], r))
        left.discard(best)
        exp.append((t.step, t.cls_no, t.seed_id, best))
    assert got == exp and len({r for *_, r in got}) == 8
    assert [(t[0], t[2]) for t in exp] == [(0, "s0"), (0, "s2"), (1, "s1"), (1, "s3"), (2, "s0"), (2, "s2"), (3, "s1"), (4, "s0")]


def test_running_accuracy(spark):
    hits = spark.createDataFrame([("c", 0, 1), ("c", 1, 0), ("c", 2, 1), ("d", 0, 0)], "cls string, step int, hit int")
    acc = retrieve.running_accuracy(hits)
    assert [r.acc for r in acc.where("cls = 'c'").orderBy("step").collect()] == [1.0, 0.5, 0.666667]
    wide = {r.step: (r.c, r.d) for r in retrieve.accuracy_table(acc, ["c", "d"]).collect()}
    assert wide == {0: (1.0, 0.0), 1: (0.5, None), 2: (0.666667, None)}


def test_knn_is_exact(spark, monkeypatch):
    import numpy as np

    x = np.random.default_rng(0).normal(size=(60, 8)).astype("float32")
    x[10] = x[11] = x[12]
    x[20] = 0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 4)
    got = {}
    for r in vectors.knn(df.where("id % 6 = 0"), df, 3).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.ref_id))
    n = np.linalg.norm(x.astype(float), axis=1)
    u = x / np.where(n > 0, n, 1)[:, None]
    for q in range(0, 60, 6):
        s = np.round(u @ u[q], 6)
        assert [i for _, i in sorted(got[q])] == sorted((i for i in range(60) if i != q), key=lambda i: (-s[i], i))[:3]


def test_vector_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [[1.0, 2.0], [3.0, 6.0], [9.0, 9.0]], [1, 1, 0])], "v array<float>, t array<array<float>>, m array<int>")
    r = df.select(vectors.unit(F.col("v")).alias("u"), vectors.inner(F.col("v"), F.col("v")).alias("i"), vectors.mean_pool(F.col("t"), F.col("m"), 2).alias("p")).collect()[0]
    assert r.u == pytest.approx([0.6, 0.8]) and r.i == 25.0 and r.p == pytest.approx([2.0, 4.0])


# ------------------------------------------------------------- evaluation and streaming


def test_auroc(spark):
    rng = random.Random(4)
    rows = [("a", rng.randrange(8) / 7, rng.randrange(2)) for _ in range(80)] + [("b", 0.1, 1), ("b", 0.2, 1)]
    got = {r["class"]: r.auroc for r in evaluate.auroc(spark.createDataFrame(rows, "class string, score double, truth int")).collect()}
    pos, neg = ([s for c, s, t in rows if c == "a" and t == k] for k in (1, 0))
    exp = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert got["a"] == pytest.approx(exp, abs=1e-6) and got["b"] is None


def test_means_are_rounded_as_in_sql(spark):
    """The mean of two figures of six digits is often half a digit."""
    rng = random.Random(2)
    rows = [(k, c, rng.randrange(10**6) / 1e6) for k in range(2000) for c in "ab"]
    means = spark.createDataFrame(rows, "k int, class string, auroc double").groupBy("k").agg(evaluate._six(F.avg("auroc")).alias("m"))
    con = duckdb.connect()
    con.execute("CREATE TABLE t (k INTEGER, x DOUBLE)")
    con.executemany("INSERT INTO t VALUES (?, ?)", [(k, x) for k, _, x in rows])
    assert dict(map(tuple, means.collect())) == dict(con.execute("SELECT k, round(avg(x), 6) FROM t GROUP BY 1").fetchall())
    one = [(0.5, 0.500001), (0.000002, 0.000005)]
    for a, b in one:
        want = con.execute(f"SELECT round(({a}::DOUBLE + {b}::DOUBLE) / 2, 6)").fetchone()[0]
        assert evaluate.macro(spark.createDataFrame([("a", a), ("b", b)], "class string, auroc double")).first()[0] == want


def test_sets(spark):
    p = pairs(spark, {"x": "ab", "y": "ba", "z": "c"}, "id")
    got = {tuple(r.cset): r.ids for r in sets.inverted(sets.as_arrays(p, "id"), "id").collect()}
    assert got == {("a", "b"): ["x", "y"], ("c",): ["z"]}
    assert sets.universe(p).count() == 3


def test_stream_applies_batch_operators(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    for ids in ([1, 2], [3]):
        spark.createDataFrame([(i, "Effusion|Pleural") for i in ids], "id long, s string").write.mode("append").parquet(src)
        stream = spark.readStream.schema("id long, s string").parquet(src)
        each_batch(stream, lambda b: b.select("id", text.normalize_labels(F.col("s")).alias("s")), out, str(tmp_path / "cp")).awaitTermination()
    assert {(r.id, r.s) for r in spark.read.parquet(out).collect()} == {(i, "Pleural Effusion") for i in (1, 2, 3)}


# ------------------------------------------------------------- guards


def test_a_cycle_in_a_hierarchy_is_an_error(spark):
    loop = spark.createDataFrame([("leaf", "a"), ("a", "b"), ("b", "a")], "child string, parent string")
    with pytest.raises(ValueError):
        ontology.leaf_paths(loop)


def test_line_numbers_hold_across_files(spark, tmp_path):
    for k, name in enumerate(("a.rrf", "b.rrf", "c.rrf")):
        (tmp_path / name).write_text("".join(f"C{i}|T{k}{i}|||||\n" for i in range(5)))
    got = sources.semantic_types(sources.numbered(sources.rrf(spark, str(tmp_path), "MRSTY")))
    assert {r.cui: r.tui for r in got.collect()} == {f"C{i}": f"T2{i}" for i in range(5)}


def test_vectors_with_text_ids(spark):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("bb", [0.0, 2.0]), ("c", [3.0, 1.0]), ("z", None)], "id string, embedding array<double>")
    got = [(r.query_id, r.ref_id, r["rank"]) for r in sorted(vectors.knn(v, v, 1).collect())]
    assert got == [("a", "c", 1), ("bb", "c", 1), ("c", "a", 1)]
    mean = vectors.mean_by(v.withColumn("k", F.lit(1)), "k", "embedding", F.col("id") != "bb", 2).collect()[0]["mean"]
    assert mean == [2.0, 0.5]


# ------------------------------------------------------------- running sums


def test_running_sums_over_slices(spark):
    """Groups lie in many slices; null is a group."""
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None]) if i > 50 else "a", i, rng.randrange(9)) for i in rng.sample(range(200), 200)]
    df = spark.createDataFrame(rows, "g string, at int, x int")
    got = {(r.g, r["at"]): (r.s, r.n) for r in scans.running(df, "g", "at", {"s": F.col("x"), "n": F.lit(1)}).collect()}
    before = lambda g, at: [x for h, b, x in rows if h == g and b < at]
    assert got == {(g, at): (sum(before(g, at)), len(before(g, at))) for g, at, _ in rows}
    near = {(r.g, r["at"]): r.moving for r in scans.moving_mean(df, "g", "at", "x", 4, part=7).collect()}
    last = lambda g, at: [x for h, b, x in sorted(rows, key=lambda r: r[1]) if h == g and b <= at][-4:]
    assert near == {(g, at): sum(last(g, at)) / len(last(g, at)) for g, at, _ in rows}
    assert scans.running(df.limit(0), "g", "at", {"s": F.col("x")}).count() == 0


def test_automaton_equals_lexicon(spark, monkeypatch):
    """With one part of terms and with several; a report without text has no mentions."""
    notes = spark.createDataFrame([(1, "Large pleural effusion. No pleural effusion, no edema!\nEdema edema of the left lung"), (2, None), (3, ""), (4, "effusions and l'edema; the left  lung? Possible edema")], "report_id long, text string")
    terms = spark.createDataFrame([("pleural effusion", "c1"), ("effusion", "c2"), ("edema", "c3"), ("edema", "c4"), ("left lung", "c5"), ("large pleural effusion", "c6"), ("nothing", "c7")], "term string, cui string")
    want = sorted(map(tuple, mentions.lexicon(terms)(notes).select("report_id", "seq", "text", "category", "assertion", "cui").collect()))
    for size in (32 << 20, 100):
        monkeypatch.setattr(mentions, "PART_BYTES", size)
        got = mentions.automaton(terms)(notes)
        assert sorted(map(tuple, got.select("report_id", "seq", "text", "category", "assertion", "cui").collect())) == want and len(want) > 8
    assert mentions.automaton(terms.limit(0))(notes).count() == 0


def test_notes_to_linked_mentions(spark):
    """Extraction, negation, modifiers of the sentence, and linking in one call."""
    notes = spark.createDataFrame([(1, "Edema of the lung. No effusion."), (2, "nothing here")], "report_id long, text string")
    terms = spark.createDataFrame([("edema", "c1"), ("lung", "c2"), ("effusion", "c3")], "term string, cui string")
    names = spark.createDataFrame([(1, "edema", "k1"), (2, "edema lung", "k2"), (3, "effusion", "k3")], "id long, text string, cui string")
    kind = F.when(F.col("term") == "lung", "Anatomy").otherwise("Observation")
    types = spark.createDataFrame([("k1", "T047"), ("k2", "T047"), ("k3", "T047")], "cui string, tui string")
    got = {r.text: r for r in flows.link_notes(notes, mentions.automaton(terms, kind), vectors.embedded(names.select("id", "text")), names.select("id", "cui"), types).collect()}
    assert set(got) == {"edema", "lung", "effusion"} and got["edema"].mods == ["lung"] and got["effusion"].category.endswith("definitely absent")
    assert (got["edema"].cui_text, got["edema"].cui_surface, got["effusion"].cui_text) == ("k1", "k2", "k3")


def test_cache_survives_failed_and_concurrent_fills(spark, tmp_path):
    """A fill that fails half-way leaves nothing that is read, and two fills at once add each row once."""
    path = f"file://{tmp_path}/cache"
    texts = spark.createDataFrame([(i, f"t{i}") for i in range(20)], "report_id int, text string")
    make = lambda d: d.select("report_id", F.upper("text").alias("u"))
    broken = lambda d: d.select("report_id", F.when(F.col("report_id") == 13, F.raise_error(F.lit("stop")).cast("string")).otherwise("x").alias("u"))
    with pytest.raises(Exception, match="stop"):
        sources.cached(spark, path, broken, texts=texts)

    def overtaken(d):  # another fill of some of the rows ends while this one makes its own
        sources.cached(spark, path, make, texts=texts.where("report_id < 8"))
        return make(d)

    got = sources.cached(spark, path, overtaken, texts=texts)
    assert sorted(map(tuple, got.collect())) == [(i, f"T{i}") for i in range(20)]
    assert sources.cached(spark, path, None, texts=texts).count() == 20


def test_low_tail_by_information_content(spark):
    """With use_ic, turns take the references of least lin cost, one after the other."""
    rng = random.Random(4)
    h = spark.createDataFrame([(c, p) for c, p in zip("abcdefgh", "ijijkkkl")] + [(c, "m") for c in "ijkl"], "child string, parent string")
    ids = [1, 2, *range(10, 16), 20, 21, 22]
    sets_ = {i: ["a", *rng.sample("bcdefgh", rng.randrange(1, 4))] for i in ids}
    labels_ = {1: "A", 2: "B", 20: "A", 21: "A", 22: "B"}
    study = lambda some: spark.createDataFrame([(i, "text", f"p/{i}.dcm", labels_.get(i, "C"), float(labels_.get(i) == "A"), float(labels_.get(i) == "B")) for i in some], "dicom_id long, impression string, path string, `Finding Labels` string, A double, B double")
    found = spark.createDataFrame([(i, str(k), c, c, "present", "Observation::definitely present") for i, cs in sets_.items() for k, c in enumerate(cs)], "report_id long, seq string, cui string, cui_text string, assertion string, category string")
    config = sources.Config(image_base_path="img/", k=1, use_ic=True)
    got = flows.fill_low_tail(study([1, 2]), study(range(10, 16)), study([1, 2, 20, 21, 22]), found, classes=["A", "B"], config=config, hierarchy=h)
    frame = lambda some, key: pairs(spark, {i: sets_[i] for i in some}, key)
    t, r = frame([1, 2], "target_id"), frame(ids[2:], "ref_id")
    every = t.select("target_id").distinct().crossJoin(r.select("ref_id").distinct())
    cost = costs.cost("lin", costs.Pairing(t, r, pairs=every, closure=ontology.ancestors(h), ic=ontology.information_content(h)))
    lists = {int(x): [int(c.ref_id) for c in sorted(rows, key=lambda c: (c.cost, int(c.ref_id)))] for x, rows in itertools.groupby(sorted(cost.collect(), key=lambda c: int(c.target_id)), key=lambda c: c.target_id)}
    taken = sorted((x.step, x.cls_no, x.seed_id, x.ref_id) for x in got.taken.collect())
    assert taken == one_by_one([(0, 0, 1), (0, 1, 2), (1, 0, 1)], lists) and got.rows.count() == 2 + 3
    with pytest.raises(ValueError):
        flows.fill_low_tail(study([1]), study([10]), study([20]), found, classes=["A"], config=config)
