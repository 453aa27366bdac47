import pytest
from pyspark.sql import functions as F

from quillgraph.operators import build, chains, checks, conflict, construct, graph, intent, mentions, parse, resolve, retrieval, runlog, selection, transform


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


ENTITIES = "ingest_seq long, collection_name string, document_id string, page_number int, term string, top_category string, specific_category string, confidence string, witness string"


def test_endpoint_tiers(spark):
    e = spark.createDataFrame([(1, "c", "d1", 1, "Office of Inspector General || OIG", "organization", None, "high", "w"), (2, "c", "d1", 2, "OIG", "organization", None, "low", "v")], ENTITIES)
    canon = build.canonical_rows(e)
    assert build.entity_nodes(canon).count() == 1
    asked = ["office of inspector general", "oig", "The Office-of Inspector General", "General Inspector Office", "Inspector General", "xyz"]
    got = {r["query"]: r["tier"] for r in build.resolve_endpoints(spark.createDataFrame([(x,) for x in asked], "query string"), canon).collect()}
    assert [got[x] for x in asked] == ["exact", "abbrev_alias", "normalized", "token_set", "token_sub", "miss"]
    more = e.unionByName(spark.createDataFrame([(3, "c", "d1", 1, "Inspector General Staff", "organization", None, "high", "w")], ENTITIES))
    again = build.resolve_endpoints(spark.createDataFrame([("Inspector General",)], "query string"), build.canonical_rows(more)).first()
    assert again["tier"] == "miss"


def test_pages_and_mentions(spark):
    e = spark.createDataFrame([(1, "c", "d1", 1, "Acme", "org", None, "high", "Acme sells"), (2, "c", "d1", None, "Acme", "org", None, "low", "sells"), (3, "c", "d2", 4, "Zeta", "org", None, "low", None), (4, "c", "d9", 1, "", "org", None, "low", None)], ENTITIES)
    docs = spark.createDataFrame([("d1",), ("d2",), ("d3",)], "document_id string")
    labelled = spark.createDataFrame([("d1", 0, "cover")], "document_id string, page int, label string")
    pages = build.page_nodes(docs, labelled, e.select("document_id", F.col("page_number").alias("page")))
    assert rows(pages, "document_id", "page") == [("d1", 0), ("d1", 1), ("d2", 4), ("d3", 0)]
    edges = build.mention_edges(build.canonical_rows(e), pages)
    assert sorted(r["witness"] for r in edges.collect()) == ["", "Acme sells", "sells"]


def test_relation_names_are_dropped_or_renamed(spark):
    e = spark.createDataFrame([(1, "c", "d", 1, "A one", "org", None, "high", ""), (2, "c", "d", 1, "B two", "org", None, "high", "")], ENTITIES)
    edges = spark.createDataFrame([(1, "A one", "B two", "works for", "high"), (2, "A one", "B two", "noise", "low"), (3, "A one", "nobody", "works for", "low")], "ingest_seq long, term_1 string, term_2 string, relationship string, confidence string")
    names = spark.createDataFrame([("WORKS_FOR", "EMPLOYED_BY"), ("NOISE", None)], "slug string, canonical string")
    assert [r["rel_type"] for r in build.relation_edges(edges, build.canonical_rows(e), names).collect()] == ["EMPLOYED_BY"]


def test_person_candidates(spark):
    n = spark.createDataFrame([(1, "Polster, Natasha"), (2, "Tasha Polster"), (3, "Natasha Polster, M.D.")], "id long, name string")
    assert rows(resolve.candidates(n, "id", "name", "person"), "id1", "id2", "pass") == [(1, 2, 2), (1, 3, 1), (2, 3, 2)]


W = "uid string, slot_type string, var_name string, surface string, content_excerpt string, reliability_score double, kg0_entity_id string, artifact_id string, quality string, claim_uid string"


def found(spark, *pair):
    w = spark.createDataFrame([(f"w{i}", "WHAT", "V", *p) for i, p in enumerate(pair)], W)
    return [(r.rule, r.defeater_type, round(r.confidence, 6), r.weaker_uid) for r in conflict.contradictions(w).collect()]


def test_contradiction_rules(spark):
    g = ("a1", "GROUNDED", "c1")
    assert found(spark, ("acme corp", "", 0.9, "k1", *g), ("zenith labs", "", 0.6, "k2", *g)) == [("SURFACE_MISMATCH", "rebutting", 0.7, "w1")]
    assert found(spark, ("reynolds", "", 0.9, "k1", *g), ("r.j. reynolds", "", 0.6, "k2", *g)) == []
    assert found(spark, ("the plan", "2020-06-01", 0.9, "k", *g), ("the plan", "2019-06-01", 0.8, "k", *g)) == [("TEMPORAL_CLASH", "rebutting", 0.8, "w1")]
    assert found(spark, ("the plan", "2020-06-01 replaces it", 0.9, "k", *g), ("the plan", "2019-06-01", 0.8, "k", *g)) == [("TEMPORAL_SUPERSESSION", "undercutting", 0.75, "w1")]
    assert found(spark, ("the plan", "in 1994", 0.9, "k", *g), ("the plan", "June 1994", 0.8, "k", *g)) == []
    assert found(spark, ("the plan", "", 0.9, "k", *g), ("The plan", "", 0.4, "k", *g)) == [("RELIABILITY_DIVERGE", "undercutting", 0.5, "w1")]
    assert [x[0] for x in found(spark, ("fund health research", "they did not fund health research", 0.9, "k", *g), ("fund health research", "", 0.8, "k", *g))] == ["NEGATION_CONFLICT"]
    long = ("one two three four five six", "", 0.9, "k")
    assert [x[0] for x in found(spark, (*long, "a1", "GROUNDED", "c"), ("seven eight nine ten eleven", "", 0.8, "k", "a2", "GROUNDED", "c"))] == ["CROSS_ARTIFACT_ENTITY"]


def test_entity_pairs_are_not_cut(spark):
    same = [(f"alpha beta gamma delta epsilon n{i}", "", 0.9, "k", "a1", "GROUNDED", "c") for i in range(25)]
    other = ("one two three four five six", "", 0.5, "k", "a2", "GROUNDED", "c")
    w = spark.createDataFrame([(f"w{i}", "", "V", *p) for i, p in enumerate([*same, other])], W)
    assert rows(conflict.contradictions(w), "rule", "weaker_uid") == [("CROSS_ARTIFACT_ENTITY", "w25")] * 25


def test_clusters_and_writes(spark):
    c = spark.createDataFrame([("a", "b", "c1", None, "R", "rebutting", 0.5, "a"), ("a", "d", "c1", None, "R", "rebutting", 0.7, "a")], "uid_a string, uid_b string, claim_a string, claim_b string, rule string, defeater_type string, confidence double, weaker_uid string")
    assert rows(conflict.clusters(c), "cluster", "size", "confidence") == [("c1", 2, 0.7)]
    assert conflict.contested(c).count() == 1
    assert conflict.written(c).where("rel_type = 'CONTRADICTS'").count() == 4


def test_transformations(spark):
    pairs = [("the policy must be followed by staff", "the policy be followed by staff"), ("A b!", "a B"), ("one two", "three four"), ("", "x")]
    got = [tuple(r[0]) for r in spark.createDataFrame(pairs, "s string, t string").coalesce(1).select(transform.classify(F.col("s"), F.col("t"))).collect()]
    assert [g[0] for g in got] == ["QUALIFIER_DROP", "VERBATIM", "OMISSION", "OTHER"]
    assert [round(g[1], 7) for g in got] == [0.9357143, 1.0, 0.55, 0.2]


def test_confidence_rules(spark):
    w = spark.createDataFrame([("s", "GROUNDED", "a1"), ("s", "INFERRED", "a2")], "slot_id string, quality string, artifact_id string")
    pieces = spark.createDataFrame([("s", "P", 0.8), ("s", "P", 0.8)], "slot_id string, var string, confidence double")
    r = chains.slot_confidence(w, pieces).first()
    assert (round(r.confidence, 4), r.quality) == (0.7925, "INFERRED")
    claims = spark.createDataFrame([("q", "WHAT", 0.925), ("q", "WHO", 0.85), ("q", "HOW", 0.80), ("q", "EVIDENCE", 0.9604), ("q", "WHEN", 0.772)], "g string, slot string, confidence double")
    assert tuple(construct.synthesis(claims, "g").first())[1:] == (0.8823, "composite")
    inf = spark.createDataFrame([("i", "c", 0.9427)], "uid string, claim_uid string, confidence double")
    assert construct.weakened(inf, spark.createDataFrame([("i", "rebutting", 3)], "uid string, type string, cluster_size int")).first().updated == pytest.approx(0.4714, abs=1e-4)
    prem = spark.createDataFrame([("i", "x"), ("i", "y")], "uid string, claim_uid string")
    base = spark.createDataFrame([("i", 0.8)], "uid string, confidence double")
    for contested, want in ([], 0.80), (["x"], 0.56), (["x", "y"], 0.40):
        assert construct.discounted(base, prem, spark.createDataFrame([(c,) for c in contested], "claim_uid string")).first().updated == pytest.approx(want)


def test_fusion_order(spark):
    lex = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
    sem = spark.createDataFrame([("b", 1), ("a", 2), ("d", 3)], "id string, rank int")
    got = retrieval.reciprocal_fusion(lex, sem, "id").orderBy(F.desc("fused"), F.desc("id")).collect()
    assert [r.id for r in got] == ["b", "a", "d", "c"] and round(got[0].fused, 7) == 0.0325225


def test_intent_score(spark):
    s = spark.createDataFrame([("i", k, v) for k, v in zip(["graph_spec_correctness", "entity_completeness", "retrieval_quality", "slot_completeness", "scope_correctness", "internal_consistency"], [0.8, 1.0, 0.9, 0.7, 1.0, 0.5], strict=True)], "intent_id string, layer string, score double")
    assert tuple(intent.verdicts(s).first())[1:] == (0.837, "PARTIAL_PASS")
    q = spark.createDataFrame([("Who signed the Acme Report and when was it sent in 2003?",)], "question string")
    p = intent.parsed(q).first()
    assert p.kind == "multi" and set(p.slots) == {"WHO", "WHEN"} and p.last_day == "2003-12-31" and p.entities == ["Acme Report"]


def test_intent_correction(spark):
    i = spark.createDataFrame([(["Acme"], [], ["WHO"], ["WHO", "WHEN"], [])], "entities array<string>, hints array<string>, slots array<string>, needed array<string>, terms array<string>")
    r = intent.corrected(i).first()
    assert (r.hints, r.slots, r.terms, r.changes) == (["Acme"], ["WHO", "WHEN"], ["acme"], ["hints", "slots", "terms"])


def test_graph(spark):
    e = spark.createDataFrame([("a", "b", "R", "1"), ("b", "c", "R", "2"), ("c", "d", "R", "3")], "src string, dst string, rel_type string, uid string")
    start = spark.createDataFrame([("a",)], "id string")
    assert {r.node for r in graph.distances(e, start, 1).collect()} == {"a", "b"}
    assert {r.node for r in graph.distances(e, start, 2).collect()} == {"a", "b", "c"}
    assert graph.cyclic(e).isEmpty() and graph.cyclic(e.unionByName(spark.createDataFrame([("d", "b", "R", "4")], e.schema))).count() == 3
    assert graph.closure(e).count() == 6
    assert {r.component for r in graph.components(e.select(F.col("src").alias("a"), F.col("dst").alias("b"))).collect()} == {"a"}


def test_greedy_selection(spark):
    c = spark.createDataFrame([("a", 1.0, "F", "x", 0.0, ""), ("b", 0.9, "F", "x", 0.0, ""), ("c", 0.1, "G", "y", 0.0, ""), ("d", 0.2, "F", "y", 0.0, "")], "artifact_id string, fused double, family string, collection string, relevance double, doc_group string")
    got = [r.artifact_id for r in selection.cover(c, 3, ["G"]).orderBy("step").collect()]
    assert got == ["c", "a", "b"]


def test_parse(spark):
    text = "intro\n=== Page 1 ===\nA\n=== Page 2 ===\n\n=== Page 3 ===\nC"
    pages = parse.split_pages(spark.createDataFrame([("d", text), ("e", "no marker"), ("f", None)], "k string, x string"), "k", "x")
    assert rows(pages, "k", "page", "text") == [("d", 1, "A"), ("d", 3, "C"), ("e", 1, "no marker")]
    lines = spark.createDataFrame([("Acme | Org > Company | High | in text | 3",), ("bad",)], "value string")
    assert tuple(parse.entity_lines(lines).first()) == ("Acme", "Org > Company", "Org", "Company", "high", "in text", 3)
    cov = spark.createDataFrame([("a", 1, 3), ("a", 2, 3), ("a", 2, 3), ("b", 3, 3), ("b", 1, 3), ("b", 2, 3)], "d string, p int, n int")
    assert rows(checks.page_coverage(cov, "d", "p", "n"), "d", "valid") == [("a", False), ("b", True)]
    lab = spark.createDataFrame([("d", x, i) for i, x in enumerate(["text", "email", "email", "text"])] + [("e", None, 0)], "d string, l string, i int")
    assert rows(build.dominant_label(lab, "d", "l", "i", "document"), "d", "dominant") == [("d", "text"), ("e", "document")]


def test_mentions(spark):
    a = spark.createDataFrame([(1, "On 2020-01-02 Jane Doe sent $5,000 to a.b@c.org"), (2, None)], "anchor_id long, raw_text string")
    assert {(r.category, r.surface) for r in mentions.extract(a).collect()} == {("DATE", "2020-01-02"), ("NAME", "Jane Doe"), ("MONEY", "$5,000"), ("EMAIL", "a.b@c.org")}
    n = spark.createDataFrame([(7, "Acme Holding Company"), (8, "Zeta Works")], "node_id long, name string")
    m = spark.createDataFrame([(1, "Acme Holding")], "mention_id long, surface string")
    assert tuple(mentions.link_lookup(m, n).first())[:2] == (1, 7)


def test_reviews_keep_creation_time(spark):
    r = spark.createDataFrame([(1, "x", 1, 1), (1, "y", 5, 5), (2, "z", 2, 2)], "k int, status string, created_at int, updated_at int")
    assert rows(runlog.reviews(r.where("updated_at < 3"), r.where("updated_at >= 3"), ["k"]), "k", "status", "created_at") == [(1, "y", 1), (2, "z", 2)]
