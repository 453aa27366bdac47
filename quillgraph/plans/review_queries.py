"""Queries on categories, evidence and what a reviewer sees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import collect, evidence, evidence_graph, ontology, slots, workbench
from quillgraph.plans.registry import Inputs, query

_CATEGORIES = ["entity_event", "ENTITY_CLAIM", "ENTITY_POLICY", "ENTITY_DOCUMENT", "ENTITY_PERSON", "ENTITY_TEXT_SPAN", "ARTIFACT_EMAIL"]
_TREE = ", ".join(f"('{k}', '{x}')" for k, xs in ontology.HIERARCHY.items() for x in xs)
_ALIASES = ", ".join(f"('{k}', '{x}')" for k, xs in ontology.EDGE_ALIASES.items() for x in xs)
_PICK = "[" + ", ".join(f"'{x}'" for x in _CATEGORIES) + "]"


def _category(col) -> F.Column:
    return F.element_at(F.array(*map(F.lit, _CATEGORIES)), (col % len(_CATEGORIES) + 1).cast("int"))


@query(
    f""", tree(parent, child) AS (VALUES {_TREE}), start AS (SELECT DISTINCT {_PICK}[CAST(p_partkey % 7 + 1 AS INTEGER)] AS asked FROM part),
        down(asked, category) AS (SELECT asked, upper(asked) FROM start UNION SELECT d.asked, t.child FROM down d JOIN tree t ON t.parent = d.category) SELECT asked, category FROM down""".replace(", tree(", "WITH RECURSIVE tree(", 1)
)
def category_expansion(p: Inputs) -> DataFrame:
    """PRJ-01, MSC-04: categories with all below them."""
    rows = p.part.select(_category(F.col("p_partkey")).alias("asked"))
    return ontology.expanded(rows, "asked", ontology.index(p.spark, ontology.HIERARCHY, None, "parent", "child"))


@query(
    f"""WITH tree(parent, child) AS (VALUES {_TREE}), takes(slot, c) AS (VALUES ('WHAT', 'ENTITY_EVENT'), ('WHAT', 'ENTITY_CLAIM'), ('WHO', 'ENTITY_PERSON')),
        every AS (SELECT slot, c FROM takes UNION SELECT slot, child FROM takes JOIN tree ON parent = c),
        r AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'WHO' WHEN 1 THEN 'WHAT' ELSE 'WHEN' END AS slot, upper({_PICK}[CAST(p_partkey % 7 + 1 AS INTEGER)]) AS c, lower(p_name) AS role FROM part)
        SELECT p_partkey, (slot = 'WHO' AND contains(role, 'red')) OR (slot = 'WHAT' AND (contains(role, 'ring') OR contains(role, 'blue'))) AS fits FROM r JOIN every USING (slot, c)"""
)
def slot_compatibility(p: Inputs) -> DataFrame:
    """PRJ-01: what a slot takes, by category or its parent's, and roles that fit it."""
    k = F.col("p_partkey")
    rows = p.part.select("p_partkey", F.when(k % 3 == 0, "WHO").when(k % 3 == 1, "WHAT").otherwise("WHEN").alias("slot_type"), _category(k).alias("category"), F.upper("p_name").alias("role"))
    slots = p.spark.createDataFrame([("WHAT", "ENTITY_EVENT"), ("WHAT", "ENTITY_CLAIM"), ("WHO", "ENTITY_PERSON")], "slot_type string, category string")
    words = p.spark.createDataFrame([("WHO", "red"), ("WHAT", "ring"), ("WHAT", "blue")], "slot_type string, keyword string")
    kept = ontology.compatible(rows, slots, ontology.index(p.spark, ontology.HIERARCHY, None, "parent", "child"))
    return ontology.role_fits(kept, words).select("p_partkey", "fits")


@query(
    f"""WITH a(edge_type, rel) AS (VALUES {_ALIASES}), r AS (SELECT DISTINCT CASE p_partkey % 5 WHEN 0 THEN 'about' WHEN 1 THEN 'REPRESENTS' WHEN 2 THEN 'has_page' WHEN 3 THEN 'Internal_only' ELSE 'unheard' END AS asked FROM part)
        SELECT asked, rel AS rel_type FROM r JOIN a ON edge_type = upper(asked) UNION ALL SELECT asked, CASE WHEN upper(asked) IN ('HAS_PAGE') THEN upper(asked) ELSE asked END FROM r WHERE upper(asked) NOT IN (SELECT edge_type FROM a) AND asked <> 'Internal_only'"""
)
def edge_type_resolution(p: Inputs) -> DataFrame:
    """PRJ-01: relationships that satisfy an edge type."""
    k = F.col("p_partkey") % 5
    rows = p.part.select(F.when(k == 0, "about").when(k == 1, "REPRESENTS").when(k == 2, "has_page").when(k == 3, "Internal_only").otherwise("unheard").alias("asked"))
    found = ontology.edge_types(rows, "asked", ontology.index(p.spark, ontology.EDGE_ALIASES, None, "edge_type", "rel_type"), ["HAS_PAGE"])
    return found.where("rel_type IS NOT NULL") if "rel_type" in found.columns else found


@query("SELECT asked, CASE asked WHEN 'ENTITY_PERSON' THEN 'Person' WHEN 'ARTIFACT_EMAIL' THEN 'Email' WHEN 'ENTITY_CLAIM' THEN 'Claim' ELSE asked END AS label FROM (SELECT DISTINCT " + _PICK + "[CAST(p_partkey % 7 + 1 AS INTEGER)] AS asked FROM part) UNION ALL SELECT 'ENTITY_CLAIM', 'Assertion' WHERE (SELECT count(*) FROM part) > 0")
def category_labels(p: Inputs) -> DataFrame:
    """PRJ-03: labels of the graph that categories stand for."""
    labels = p.spark.createDataFrame([("PERSON", "Person"), ("Email", "Email"), ("ENTITY_CLAIM", "Claim"), ("ENTITY_CLAIM", "Assertion"), ("CLAIM", "never")], "category string, label string")
    return ontology.graph_labels(p.part.select(_category(F.col("p_partkey")).alias("asked")), "asked", labels)


@query(
    """WITH x AS (SELECT event_id, CASE event_type WHEN 'view' THEN 'Artifact' WHEN 'click' THEN 'Derived' WHEN 'error' THEN 'Record' WHEN 'signup' THEN 'Observation' ELSE NULL END AS kind,
           CASE event_id % 4 WHEN 0 THEN 'T::SnapshotNode' WHEN 1 THEN 'T::FrameWitness' WHEN 2 THEN 'T::Mention' ELSE '' END AS dom, CASE event_id % 5 WHEN 0 THEN 'Privileged memo' WHEN 1 THEN 'Press release' WHEN 2 THEN 'Sensitive and public' ELSE '' END AS label,
           CASE event_id % 6 WHEN 0 THEN '2018' WHEN 1 THEN '2018-06' WHEN 2 THEN '2018-06-04' WHEN 3 THEN '2018-06-04T01:00' WHEN 4 THEN 'circa 2018' ELSE NULL END AS starts FROM events),
       y AS (SELECT *, lower(coalesce(kind, 'Other')) AS k, CASE WHEN contains(lower(dom), 'snapshot') THEN 'tertiary' WHEN contains(lower(dom), 'witness') THEN 'secondary' ELSE 'primary' END AS cat FROM x),
       z AS (SELECT *, CASE WHEN k = 'artifact' THEN 'direct-capture' WHEN contains(lower(dom), 'framewitness') OR k = 'derived' THEN 'aggregation' WHEN contains(lower(dom), 'snapshot') OR k = 'record' THEN 'transformation' WHEN k = 'observation' THEN 'extraction' ELSE 'unknown' END AS m FROM y)
       SELECT event_id, cat AS source_category, m AS method, CASE WHEN cat = 'tertiary' THEN 'KG0' WHEN event_id % 7 = 0 THEN 'ALIGN::C' WHEN contains(lower(dom), 'framewitness') THEN 'TRACE::FrameAggregation' ELSE 'ALIGN::LocalCorpus' END AS origin,
         CASE WHEN k = 'record' OR contains(lower(dom), 'snapshot') THEN 'application/json' WHEN k = 'artifact' THEN 'application/octet-stream' ELSE 'text/plain' END AS media_type,
         CASE event_id % 5 WHEN 0 THEN 'confidential' WHEN 1 THEN 'public' WHEN 2 THEN 'restricted' ELSE 'internal' END AS access_level, CASE event_id % 6 WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'exact' WHEN 4 THEN 'approximate' ELSE 'unknown' END AS precision,
         CASE WHEN event_id % 3 = 0 THEN 'http://x/' || CAST(event_id AS STRING) ELSE 'trace://evidence/e' || CAST(event_id AS STRING) END AS uri,
         round(greatest(0, least(1, CASE cat WHEN 'primary' THEN 0.88 WHEN 'secondary' THEN 0.76 ELSE 0.68 END + CASE m WHEN 'aggregation' THEN -0.05 WHEN 'direct-capture' THEN 0.03 ELSE 0 END + CASE k WHEN 'artifact' THEN 0.02 WHEN 'derived' THEN -0.03 ELSE 0 END)), 9) AS reliability FROM z"""
)
def evidence_enrichment(p: Inputs) -> DataFrame:
    """TRC-06, TRC-05: what can be inferred about evidence."""
    k, e = F.col("event_id"), F.col("event_type")
    nodes = p.events.select(
        k.alias("event_id"), F.concat(F.lit("e"), k.cast("string")).alias("uid"), F.when(e == "view", "Artifact").when(e == "click", "Derived").when(e == "error", "Record").when(e == "signup", "Observation").alias("type"),
        F.when(k % 4 == 0, "T::SnapshotNode").when(k % 4 == 1, "T::FrameWitness").when(k % 4 == 2, "T::Mention").otherwise("").alias("domain_type"), F.when(k % 7 == 0, "C").alias("collection"),
        F.when(k % 5 == 0, "Privileged memo").when(k % 5 == 1, "Press release").when(k % 5 == 2, "Sensitive and public").otherwise("").alias("label"), F.lit("").alias("description"), F.lit(None).cast("string").alias("content"),
        F.when(k % 3 == 0, F.concat(F.lit("http://x/"), k.cast("string"))).alias("source_reference"), F.when(k % 6 == 0, "2018").when(k % 6 == 1, "2018-06").when(k % 6 == 2, "2018-06-04").when(k % 6 == 3, "2018-06-04T01:00").when(k % 6 == 4, "circa 2018").alias("starts"),
        F.lit(None).cast("double").alias("reliability"),
    )
    return evidence.enriched(nodes).select("event_id", "source_category", "method", "origin", "media_type", "access_level", "precision", "uri", "reliability")


@query("SELECT event_id, CASE event_type WHEN 'view' THEN 'reviewed' WHEN 'click' THEN 'linked' WHEN 'error' THEN 'collected' WHEN 'signup' THEN 'created' ELSE 'transferred' END AS action FROM events")
def provenance_actions(p: Inputs) -> DataFrame:
    """TRC-07: actions that labels of steps name."""
    e = F.col("event_type")
    label = F.when(e == "view", "Examined by staff").when(e == "click", "Mapped and reviewed").when(e == "error", "Went wrong").when(e == "signup", "Authored").otherwise("Prescribed")
    return p.events.select("event_id", evidence.action(label).alias("action"))


@query("SELECT c_custkey AS document_id, o_orderkey AS page_id, coalesce(n, 0) AS n, coalesce(first, '') AS first FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(CAST(l_linenumber AS STRING)) AS first FROM lineitem WHERE l_linenumber > 2 GROUP BY 1) ON l_orderkey = o_orderkey")
def page_mentions(p: Inputs) -> DataFrame:
    """JN-16: documents with pages and what is mentioned there, empty ones too."""
    docs, pages = p.customer.select(F.col("c_custkey").alias("document_id")), p.orders.select(F.col("o_custkey").alias("document_id"), F.col("o_orderkey").alias("page_id"))
    held = p.lineitem.where("l_linenumber > 2").select(F.col("l_orderkey").alias("page_id"), F.col("l_linenumber").cast("string").alias("mention_id"), F.col("l_returnflag").alias("surface"))
    out = evidence.page_mentions(docs, pages, held)
    return out.select("document_id", "page_id", F.size("mentions").alias("n"), F.coalesce(F.get("mentions", F.lit(0))["mention_id"], F.lit("")).alias("first"))


@query("SELECT o_custkey % 100 AS artifact_id, o_orderkey AS address, row_number() OVER (PARTITION BY o_custkey % 100 ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders QUALIFY rank <= 20")
def top_anchors(p: Inputs) -> DataFrame:
    """TOP-01: the best anchors of each artifact."""
    a = p.orders.select((F.col("o_custkey") % 100).alias("artifact_id"), F.col("o_orderkey").alias("address"), F.col("o_totalprice").alias("relevance"))
    return evidence.top_anchors(a).select("artifact_id", "address", "rank")


@query(
    """, c AS (SELECT candidate_id, slot_type, score, row_number() OVER (ORDER BY score DESC, candidate_id) AS place FROM (SELECT candidate_id, slot_type, score FROM chain_members))
       SELECT candidate_id, 'F' || CAST(place AS STRING) AS display_id, round(round(score, 4), 4) AS evidence_strength, CASE WHEN slot_type = 'WHAT' THEN 'selected_chain' ELSE 'expanded_grounded_slot_candidate' END AS candidate_scope, slot_type <> 'WHO' AS grounded, 'e1,e2' AS conflict_edge_ids FROM c""",
    ("chain_members",),
)
def answer_findings(p: Inputs) -> DataFrame:
    """CON-02: findings in their order, with what they cite and what contests them."""
    m = p.chain_members
    c = m.select("candidate_id", "slot_type", F.lit("").alias("surface"), F.col("score").alias("confidence"), F.when(F.col("slot_type") == "WHO", "INFERRED").otherwise("GROUNDED").alias("quality"), F.col("witness_id").alias("object_id"), (-F.col("score")).alias("position"))
    edges = p.spark.createDataFrame([("e2",), ("e1",), ("",)], "edge_id string")
    return evidence.findings(c, m.where("slot_type = 'WHAT'").select("candidate_id"), edges).select("candidate_id", "display_id", "evidence_strength", "candidate_scope", "grounded", "conflict_edge_ids")


@query(
    """WITH c AS (SELECT c_custkey AS chain_id, c_custkey % 3 <> 0 AS complete FROM customer), m AS (SELECT o_orderkey AS mapping_id, o_custkey AS chain_id, CASE o_orderkey % 5 WHEN 0 THEN 'OMISSION' WHEN 1 THEN 'HEDGE_DROP' ELSE 'VERBATIM' END AS label FROM orders)
       SELECT CAST(chain_id AS STRING) AS chain_id, 'EXTRACTION_UNCERTAINTY' AS kind, CAST(mapping_id AS STRING) AS source_id FROM m WHERE label <> 'VERBATIM' AND chain_id IN (SELECT chain_id FROM c)
       UNION ALL SELECT CAST(chain_id AS STRING), 'UNTETHERED_CLAIM', CAST(chain_id AS STRING) FROM c WHERE NOT complete UNION ALL SELECT CAST(c_custkey AS STRING), 'CONFLICT_DERIVED', 'e' || CAST(c_nationkey AS STRING) FROM customer WHERE c_acctbal < 0"""
)
def answer_limitations(p: Inputs) -> DataFrame:
    """CON-02: what limits an answer: lossy mappings, conflicts, missing witnesses."""
    lists = p.orders.groupBy(F.col("o_custkey").cast("string").alias("chain_id")).agg(F.collect_list(F.col("o_orderkey").cast("string")).alias("mapping_ids"))
    c = p.customer.select(F.col("c_custkey").cast("string").alias("chain_id"), (F.col("c_custkey") % 3 != 0).alias("witness_complete")).join(lists, "chain_id", "left")
    k = F.col("o_orderkey") % 5
    m = p.orders.select(F.col("o_orderkey").cast("string").alias("mapping_id"), F.when(k == 0, "OMISSION").when(k == 1, "HEDGE_DROP").otherwise("VERBATIM").alias("label"))
    edges = p.customer.where("c_acctbal < 0").select(F.col("c_custkey").cast("string").alias("chain_id"), F.concat(F.lit("e"), F.col("c_nationkey").cast("string")).alias("edge_id"))
    return evidence.limitations(c, m, edges)


@query(
    """WITH h AS (SELECT c_custkey % 50 AS intent_id, c_custkey AS pos, CASE c_custkey % 3 WHEN 0 THEN 'ENTITY_PERSON' WHEN 1 THEN 'ENTITY_ORGANIZATION' ELSE 'ENTITY_DATE' END AS cat, c_acctbal / 10000 AS conf, c_mktsegment AS s, ' ' || lower(c_mktsegment) || ' x' AS n FROM customer),
       t AS (SELECT intent_id, unnest([lower(s), trim(n)]) AS term, pos * 2 + unnest([0, 1]) AS i FROM h WHERE cat <> 'ENTITY_DATE' AND conf >= 0.9), f AS (SELECT intent_id, term, min(i) AS i FROM t GROUP BY 1, 2) SELECT intent_id, string_agg(term, ',' ORDER BY i) AS terms FROM f GROUP BY 1"""
)
def required_hint_terms(p: Inputs) -> DataFrame:
    """FLT-08: terms that a question insists on."""
    k = F.col("c_custkey")
    hints = p.customer.select((k % 50).alias("intent_id"), k.alias("position"), F.when(k % 3 == 0, "ENTITY_PERSON").when(k % 3 == 1, "ENTITY_ORGANIZATION").otherwise("ENTITY_DATE").alias("category"), (F.col("c_acctbal") / 10000).alias("confidence"), F.col("c_mktsegment").alias("surface"), F.concat(F.lit(" "), F.lower("c_mktsegment"), F.lit(" x")).alias("normalized"))
    return evidence.required_terms(hints).select("intent_id", F.array_join("terms", ",").alias("terms"))


@query("SELECT user_id AS run_id, count(*) AS n_invocations, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS operators, coalesce(string_agg(DISTINCT CASE WHEN value > 50 THEN 'a' || CAST(event_id % 5 AS STRING) END, ',' ORDER BY CASE WHEN value > 50 THEN 'a' || CAST(event_id % 5 AS STRING) END), '') AS artifacts, count(CASE WHEN value > 50 THEN 1 END) AS n_witnesses FROM events GROUP BY user_id")
def provenance_manifest(p: Inputs) -> DataFrame:
    """TRC-09: what a run's provenance rests on."""
    e = p.events.withColumnRenamed("user_id", "run_id")
    w = e.where("value > 50").select("run_id", F.concat(F.lit("a"), (F.col("event_id") % 5).cast("string")).alias("artifact_id"), F.col("event_id").alias("witness_id"))
    return evidence.manifest(w, e.select("run_id", F.col("event_type").alias("operator")))


@query(
    """WITH e AS (SELECT 'e' || CAST(o_orderkey AS STRING) AS edge_id, 'x' || CAST(o_orderkey % 40 AS STRING) AS a, 'x' || CAST(o_custkey % 45 AS STRING) AS b FROM orders), k AS (SELECT 'x' || CAST(s_suppkey % 42 AS STRING) AS o, 'c' || CAST(max(s_suppkey) AS STRING) AS c FROM supplier GROUP BY 1),
       m AS (SELECT 'm' || CAST(n_nationkey AS STRING) AS m, n_nationkey AS seq, 'x' || CAST(n_nationkey AS STRING) AS so, 'x' || CAST(n_nationkey + 7 AS STRING) AS t_o, 'c' || CAST(n_nationkey + 42 AS STRING) AS sc, 'c' || CAST(n_nationkey + 3 AS STRING) AS tc FROM nation),
       r AS (SELECT 'ch' || CAST(s_suppkey % 6 AS STRING) AS ch, 'c' || CAST(s_suppkey AS STRING) AS c FROM supplier), rm AS (SELECT 'ch' || CAST(n_regionkey AS STRING) AS ch, 'm' || CAST(n_nationkey AS STRING) AS m FROM nation),
       x AS (SELECT e.*, ka.c AS ca, kb.c AS cb FROM e LEFT JOIN k ka ON ka.o = a LEFT JOIN k kb ON kb.o = b),
       y AS (SELECT x.*, (SELECT arg_min(m, seq) FROM m WHERE (least(so, t_o) = least(a, b) AND greatest(so, t_o) = greatest(a, b)) OR (ca IS NOT NULL AND cb IS NOT NULL AND least(sc, tc) = least(ca, cb) AND greatest(sc, tc) = greatest(ca, cb))) AS mp FROM x),
       z AS (SELECT edge_id, ch FROM y JOIN rm ON rm.m = mp UNION SELECT edge_id, p.ch FROM y JOIN r p ON p.c = ca JOIN r q ON q.c = cb AND q.ch = p.ch WHERE ca <> cb)
       SELECT y.edge_id, coalesce(ca, '') AS source_candidate_id, coalesce(cb, '') AS target_candidate_id, coalesce(mp, '') AS mapping_id, coalesce(string_agg(DISTINCT ch, ',' ORDER BY ch), '') AS chain_ids FROM y LEFT JOIN z USING (edge_id) GROUP BY 1, 2, 3, 4"""
)
def conflict_attribution(p: Inputs) -> DataFrame:
    """JN-20: candidates, mapping and chains that a conflict concerns."""
    s = lambda prefix, c: F.concat(F.lit(prefix), c.cast("string"))
    e = p.orders.select(s("e", F.col("o_orderkey")).alias("edge_id"), s("x", F.col("o_orderkey") % 40).alias("a"), s("x", F.col("o_custkey") % 45).alias("b"))
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    c = p.supplier.select(s("c", k).alias("candidate_id"), s("x", k % 42).alias("object_id"), k.alias("seq"))
    m = p.nation.select(s("m", n).alias("mapping_id"), n.alias("seq"), s("x", n).alias("source_object_id"), s("x", n + 7).alias("target_object_id"), s("c", n + 42).alias("source_candidate_id"), s("c", n + 3).alias("target_candidate_id"))
    out = workbench.attributed(e, c, m, p.supplier.select(s("ch", k % 6).alias("chain_id"), s("c", k).alias("candidate_id")), p.nation.select(s("ch", F.col("n_regionkey")).alias("chain_id"), s("m", n).alias("mapping_id")))
    return out.select("edge_id", "source_candidate_id", "target_candidate_id", "mapping_id", "chain_ids")


@query(
    """WITH e AS (SELECT o_orderkey AS edge_id, o_orderkey % 4 AS k, o_orderkey % 100 AS s, o_custkey % 100 AS t FROM orders), c AS (SELECT s_suppkey AS c, s_suppkey % 5 AS slot_id, CASE WHEN s_suppkey % 5 = 0 THEN 'WHO' ELSE 'WHAT' END AS slot FROM supplier),
       x AS (SELECT e.*, a.slot_id AS sa, b.slot_id AS sb, coalesce(a.slot, '') AS ta, coalesce(b.slot, '') AS tb FROM e LEFT JOIN c a ON a.c = s LEFT JOIN c b ON b.c = t),
       y AS (SELECT *, ta = 'WHO' OR tb = 'WHO' OR coalesce(sa, -1) = 1 OR coalesce(sb, -1) = 1 AS several, coalesce(sa = sb, FALSE) AS same FROM x)
       SELECT edge_id, CASE WHEN k = 0 THEN 'semantic' WHEN k = 1 AND several AND same THEN 'plurality' WHEN k = 1 THEN 'diagnostic' ELSE 'unresolved' END AS status,
         CASE WHEN k = 0 THEN 'QUALIFIES' WHEN k = 1 AND several AND same THEN 'Multiple candidate bindings / role distinction' WHEN k = 1 AND same THEN 'Alternative bindings for same claim/slot' WHEN k = 1 THEN 'Surface mismatch' WHEN k = 2 THEN 'REFUTES' ELSE 'Claim relationship under review' END AS label FROM y"""
)
def conflict_workups(p: Inputs) -> DataFrame:
    """JN-23: conflicts read with the candidates and claims that they join."""
    k = F.col("o_orderkey") % 4
    e = p.orders.select(F.col("o_orderkey").alias("edge_id"), F.when(k == 1, "SURFACE_MISMATCH").otherwise("TEMPORAL_CLASH").alias("rule"), F.when(k == 2, "REFUTES").otherwise("").alias("stance"), F.when(k == 0, "QUALIFIES").alias("relationship"), F.lit("").alias("claim_a"), F.lit(None).cast("string").alias("claim_b"), (F.col("o_orderkey") % 100).alias("source_candidate_id"), (F.col("o_custkey") % 100).alias("target_candidate_id"))
    s = F.col("s_suppkey")
    c = p.supplier.select(s.alias("candidate_id"), (s % 5).cast("string").alias("slot_id"), F.when(s % 5 == 0, "WHO").otherwise("WHAT").alias("slot_type"), F.col("s_name").alias("surface"), F.concat(F.lit("k"), (s % 5).cast("string")).alias("claim_uid"))
    claims = p.spark.createDataFrame([("k1", "WHAT", "Which documents were sent"), ("k2", "WHAT", "What was it")], "claim_uid string, slot_type string, description string")
    return workbench.fused(e, c, claims).select("edge_id", "status", "label")


@query(
    """WITH r AS (SELECT conv_id, string_agg(CASE turn % 3 WHEN 0 THEN 'Alpha said so.' WHEN 1 THEN 'Beta did it.' ELSE 'Gamma.' END, ' ' ORDER BY turn) AS a, count(*) AS n, count(CASE WHEN turn % 2 = 0 THEN 1 END) AS open_ FROM conversations GROUP BY 1)
       SELECT conv_id, n AS total, n - CASE WHEN n > 1 THEN 1 ELSE 0 END AS placed, CASE WHEN n > 1 THEN 1 ELSE 0 END AS unplaced, open_ AS unresolved FROM r"""
)
def citation_health(p: Inputs) -> DataFrame:
    """AGG-30: citations whose sentences stand in the answer one after the other; here the first sentence is cited last again."""
    k = F.col("turn") % 3
    said = F.when(k == 0, "Alpha said so.").when(k == 1, "Beta did it.").otherwise("Gamma.")
    r = p.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", said.alias("s")))).alias("x"))
    answer = F.array_join(F.transform("x", lambda s: s["s"]), " ")
    # Every turn's sentence is cited in its place, but the last turn's citation names the whole answer's opening, which is behind the cursor then.
    opening = F.concat(F.get("x", F.lit(0))["s"], F.lit(" "), F.get("x", F.lit(1))["s"])
    cited = F.transform("x", lambda s, i: F.struct(F.when((F.size("x") > 1) & (i == F.size("x") - 1), opening).otherwise(F.upper(s["s"])).alias("text"), F.when(s["turn"] % 2 == 0, F.array().cast("array<string>")).otherwise(F.array(F.lit("o"))).alias("objects")))
    return r.select("conv_id", workbench.citation_health(answer, cited).alias("h")).select("conv_id", "h.*")


@query(
    """SELECT c_custkey AS run_id, unnest(['overview', 'answer', 'explain', 'align', 'trace', 'findings', 'conflicts', 'graphs']) AS view, unnest([NULL, 3, c_nationkey, 7, 5, c_custkey % 9, c_custkey % 4, 11]) AS count,
         unnest([1 + 1 + c_custkey % 3, 1 + 2 + 1, 2 + 1, 1, c_custkey % 5, 1 + 2, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 ELSE c_custkey % 4 END, 0]) AS attention FROM customer"""
)
def view_badges(p: Inputs) -> DataFrame:
    """AGG-30: numbers beside the views of a run."""
    k, n = F.col("c_custkey"), lambda x: F.lit(x)
    health = F.struct(n(3).alias("total"), n(2).alias("placed"), n(1).alias("unplaced"), n(2).alias("unresolved"))
    r = p.customer.select(
        k.alias("run_id"), health.alias("health"), n(1).alias("warnings"), (k % 3).alias("unresolved_conflicts"), F.col("c_nationkey").alias("tethers"), n(2).alias("uncertainties"), n(1).alias("tether_failures"), n(7).alias("witnesses"), n(1).alias("empty_slots"),
        n(5).alias("chains"), (k % 5).alias("incomplete_chains"), (k % 9).alias("findings"), n(1).alias("weak_findings"), n(2).alias("finding_conflicts"), (k % 4).alias("conflicts"), n(11).alias("nodes"),
    )
    return workbench.view_badges(r)


@query("SELECT c_custkey FROM customer WHERE upper(c_mktsegment) = 'MACHINERY' AND c_acctbal / 10000 >= 0.3 AND contains(lower(c_name || ' ' || c_mktsegment), '1')")
def shown_slots(p: Inputs) -> DataFrame:
    """FLT-13, FLT-06: slots of a type, with a confidence, that hold a text."""
    s = p.customer.select("c_custkey", F.col("c_name").alias("slot_id"), F.col("c_mktsegment").alias("slot_type"), F.lit(None).cast("string").alias("quality"), F.lit("").alias("description"), (F.col("c_acctbal") / 10000).alias("confidence"))
    return workbench.slots_shown(s, " 1 ", "machinery", least=0.3).select("c_custkey")


@query("SELECT o_orderkey AS edge_id, CASE WHEN o_orderkey % 4 = 0 THEN 'REFUTED' ELSE 'UNRESOLVED' END AS review_label FROM orders WHERE o_orderkey % 3 = 1 OR o_orderkey % 3 = 2 AND o_orderkey % 2 = 1")
def shown_conflicts(p: Inputs) -> DataFrame:
    """FLT-13: conflicts that say something of content."""
    k = F.col("o_orderkey")
    c = p.orders.select(k.alias("edge_id"), F.lit("TEMPORAL_CLASH").alias("rule"), F.when(k % 3 == 1, "REFUTES").otherwise("").alias("stance"), F.when((k % 3 == 2) & (k % 2 == 1), "QUALIFIES").alias("relationship"), F.lit("").alias("description"), F.col("o_totalprice").alias("confidence"))
    return workbench.conflicts_shown(c, p.orders.where("o_orderkey % 4 = 0").select(k.alias("edge_id"), F.lit("REFUTED").alias("label")), relation="semantic").select("edge_id", "review_label")


@query(
    """WITH s AS (SELECT DISTINCT p_type AS filter_id, p_brand AS collection_id FROM part WHERE p_brand IN ('Brand#1', 'Brand#2', 'Brand#3')), f AS (SELECT filter_id, count(*) AS n, string_agg(collection_id, ',' ORDER BY collection_id DESC) AS cols, max(collection_id) AS first FROM s GROUP BY 1)
       SELECT CASE WHEN filter_id < 'M' THEN 'g1' ELSE 'g2' END AS group_id, filter_id, CASE WHEN first = 'Brand#3' THEN 'Three ' || filter_id ELSE 'Common ' || filter_id END AS label, 'enum' AS kind, CASE WHEN n = 3 THEN 'all' ELSE 'partial' END AS coverage, cols AS collections FROM f WHERE filter_id <> 'SMALL'"""
)
def facet_filters(p: Inputs) -> DataFrame:
    """FLT-12: filters that an application offers for the collections selected."""
    t = p.part.select(F.col("p_type").alias("filter_id"), F.col("p_brand").alias("collection_id")).distinct()
    supported = t.withColumns({"label": F.when(F.col("collection_id") == "Brand#3", F.concat(F.lit("Three "), "filter_id")), "kind": F.lit(None).cast("string")})
    ids = t.select("filter_id").distinct()
    common = ids.select("filter_id", F.concat(F.lit("Common "), "filter_id").alias("label"), F.lit(None).cast("string").alias("kind"))
    app = ids.select("filter_id", (F.col("filter_id") != "SMALL").alias("included"))
    groups = ids.select(F.when(F.col("filter_id") < "M", "g1").otherwise("g2").alias("group_id"), "filter_id")
    return workbench.resolved_filters(common, supported, app, groups, ["Brand#3", "Brand#2", "Brand#1"])


def _evidence_graph(p: Inputs) -> tuple[DataFrame, DataFrame]:
    """Suppliers as artifacts of their nation, orders as anchors, line items as mentions and witnesses of slots, parts as snapshots."""
    s = lambda prefix, c: F.concat(F.lit(prefix), F.col(c).cast("string"))
    artifacts = p.customer.select(s("a", "c_custkey").alias("artifact_id"), s("n", "c_nationkey").alias("collection"))
    anchors = p.orders.select(s("o", "o_orderkey").alias("anchor_id"), s("a", "o_custkey").alias("artifact_id"))
    lines = p.lineitem.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("kg_id"), F.min("l_suppkey").alias("l_suppkey"), F.min("l_quantity").alias("l_quantity"))
    lines = lines.withColumns({"id": F.concat_ws("-", F.lit("l"), "l_orderkey", "l_linenumber"), "anchor_id": s("o", "l_orderkey")})
    mentions = lines.select(F.col("id").alias("mention_id"), "anchor_id", s("part ", "kg_id").alias("surface"), F.when(F.col("kg_id") % 3 == 0, F.col("kg_id")).alias("kg_id"))
    witnesses = lines.where("l_suppkey % 10 = 0").select(F.concat(F.lit("w"), "id").alias("witness_id"), s("s", "l_suppkey").alias("slot_id"), F.lit("v").alias("var_name"), F.lit("said").alias("surface"), "anchor_id", F.col("id").alias("mention_id"), F.col("l_quantity").alias("score"))
    snapshots = p.part.where("p_partkey % 6 = 0").select(F.col("p_partkey").alias("kg_id"))
    frames = p.orders.select(s("f", "o_custkey").alias("frame_id"), s("o", "o_orderkey").alias("member_id"))
    slots = p.supplier.where("s_suppkey % 10 = 0").select(s("s", "s_suppkey").alias("slot_id"), F.when(F.col("s_suppkey") % 20 == 0, "GROUNDED").otherwise("AMBIGUOUS").alias("quality"), F.when(F.col("s_suppkey") % 30 == 0, 0.0).otherwise(0.5).alias("confidence"))
    relations = p.supplier.select(s("s", "s_suppkey").alias("from_slot"), F.concat(F.lit("s"), (F.col("s_suppkey") + 20).cast("string")).alias("to_slot"))
    return evidence_graph.built("q", artifacts, anchors, mentions, witnesses, snapshots, frames, slots, relations)


_EG = """WITH art AS (SELECT 'a' || CAST(c_custkey AS STRING) AS id, c_nationkey AS coll FROM customer), anc AS (SELECT 'o' || CAST(o_orderkey AS STRING) AS id, 'a' || CAST(o_custkey AS STRING) AS art, 'f' || CAST(o_custkey AS STRING) AS frame FROM orders),
l AS (SELECT l_orderkey, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber)"""


@query(
    _EG
    + """, w AS (SELECT DISTINCT l_suppkey, l_orderkey FROM l WHERE l_suppkey % 10 = 0), sl AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 AND NOT (s_suppkey % 20 <> 0 AND s_suppkey % 30 = 0)),
       n AS (SELECT 'artifact' AS kind, count(*) AS n FROM art UNION ALL SELECT 'anchor', count(*) FROM anc UNION ALL SELECT 'mention', count(*) FROM l UNION ALL SELECT 'witness', count(*) FROM w UNION ALL SELECT 'snapshot', count(*) FROM part WHERE p_partkey % 6 = 0 UNION ALL SELECT 'frame', count(DISTINCT frame) FROM anc)
       SELECT kind, n FROM (SELECT * FROM n UNION ALL SELECT 'factor', sum(n) FROM n UNION ALL SELECT 'claim', count(*) FROM sl UNION ALL SELECT 'inference', count(*) FROM sl x JOIN sl y ON y.s_suppkey = x.s_suppkey + 20 UNION ALL SELECT 'root', 2 UNION ALL SELECT 'agent', 1) WHERE n > 0"""
)
def evidence_graph_nodes(p: Inputs) -> DataFrame:
    """GR-13, GR-14: nodes of the evidence graph by kind."""
    return _evidence_graph(p)[0].groupBy("kind").agg(F.count("*").alias("n"))


@query(
    _EG
    + """, w AS (SELECT DISTINCT l_suppkey, l_orderkey FROM l WHERE l_suppkey % 10 = 0), sl AS (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 0 AND NOT (s_suppkey % 20 <> 0 AND s_suppkey % 30 = 0)),
       inf AS (SELECT x.s_suppkey FROM sl x JOIN sl y ON y.s_suppkey = x.s_suppkey + 20), e AS (SELECT (SELECT count(*) FROM art) + (SELECT count(*) FROM anc) + (SELECT count(*) FROM l) + (SELECT count(*) FROM w) + (SELECT count(*) FROM part WHERE p_partkey % 6 = 0) + (SELECT count(DISTINCT frame) FROM anc) AS n),
       a1 AS (SELECT count(*) AS n FROM anc JOIN art ON art.id = anc.art), c AS (SELECT count(*) - count(DISTINCT l_partkey) AS n FROM l), i AS (SELECT count(*) - count(DISTINCT coll) AS n FROM art), lo AS (SELECT count(*) AS n FROM l WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
       wo AS (SELECT count(*) AS n FROM w WHERE l_orderkey IN (SELECT o_orderkey FROM orders)), ls AS (SELECT count(*) AS n FROM l WHERE l_partkey % 6 = 0 AND l_partkey IN (SELECT p_partkey FROM part))
       SELECT rel_type, n FROM (SELECT 'DERIVES_FROM' AS rel_type, (SELECT n FROM a1) + (SELECT n FROM lo) + (SELECT n FROM wo) + (SELECT count(*) FROM w) + (SELECT count(*) FROM anc) + (SELECT n FROM ls) AS n
       UNION ALL SELECT 'CORROBORATES', n FROM c UNION ALL SELECT 'IDENTICAL_TO', n FROM i UNION ALL SELECT 'CONTAINS_NODE', n FROM e UNION ALL SELECT 'CREATED_BY', n FROM e UNION ALL SELECT 'HAS_RELIABILITY_FACTOR', n FROM e
       UNION ALL SELECT 'CONTAINS_CLAIM', count(*) FROM sl UNION ALL SELECT 'ASSERTED_BY', count(*) FROM sl UNION ALL SELECT 'GROUNDED_BY', count(*) FROM w WHERE l_suppkey IN (SELECT s_suppkey FROM sl)
       UNION ALL SELECT unnest(['CONTAINS_INFERENCE', 'HAS_PREMISE', 'HAS_CONCLUSION', 'PERFORMED_BY']), (SELECT count(*) FROM inf)) WHERE n > 0"""
)
def evidence_graph_edges(p: Inputs) -> DataFrame:
    """GR-13: edges of the evidence graph by type."""
    return _evidence_graph(p)[1].groupBy("rel_type").agg(F.count("*").alias("n"))


@query(
    """SELECT c_custkey, 'i' || CAST(c_custkey AS STRING) AS intent_id, CASE WHEN c_custkey % 2 = 0 THEN 'STRICT' ELSE 'PREFER' END AS mode, CASE WHEN c_custkey % 3 = 0 THEN 40 ELSE 250 END AS top_k, 'America/Los_Angeles' AS timezone, 10 AS alternatives, 2 AS n_slots,
         CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '' END AS target, CASE WHEN c_custkey % 5 = 0 THEN 0.0 ELSE 0.9 END AS confidence FROM customer WHERE c_custkey % 7 <> 0"""
)
def typed_intents(p: Inputs) -> DataFrame:
    """INT-05, SRC-13: intents out of JSON bundles, with their defaults."""
    k = F.col("c_custkey")
    parts = F.concat(
        F.lit('```json\n{"Header": {'), F.when(k % 7 == 0, F.lit("")).otherwise(F.concat(F.lit('"intent_id": "i'), k.cast("string"), F.lit('", "question_text": "q"'))), F.lit('}, "EntityHints": [{"surface": "x"'), F.when(k % 5 == 0, "").otherwise(', "confidence": 0.9'), F.lit("}], "),
        F.when(k % 2 == 0, '"ScopeSpec": {"mode": "STRICT"}, ').otherwise(""), F.when(k % 3 == 0, '"RetrievalSpec": {"top_k_lex": 40}, ').otherwise(""), F.lit('"SlotSpec": {"slots": [{"slot_id": "s1", "slot_type": "WHO"'), F.when(k % 2 == 0, ', "target_graph_var": "A"').otherwise(""), F.lit('}, {"slot_id": "s2", "slot_type": "WHAT"},]}}\n```'),
    )
    i = slots.typed_intent(p.customer.select("c_custkey", parts.alias("raw")), "raw").where("intent IS NOT NULL")
    return i.select("c_custkey", "intent.header.intent_id", F.col("intent.scope.mode").alias("mode"), F.col("intent.retrieval.top_k_lex").alias("top_k"), F.col("intent.scope.timezone").alias("timezone"), F.col("intent.top_k_alternatives").alias("alternatives"), F.size("intent.slots").alias("n_slots"), F.get("intent.slots", F.lit(0))["target_var"].alias("target"), F.get("intent.hints", F.lit(0))["confidence"].alias("confidence"))


@query(
    """WITH s AS (SELECT c_custkey AS slot_id, CASE c_custkey % 3 WHEN 0 THEN 'WHO' WHEN 1 THEN 'WHAT' ELSE 'HOW' END AS slot_type, CASE WHEN c_custkey % 5 = 0 THEN 'P' ELSE '' END AS target, CASE WHEN c_custkey % 7 = 0 THEN 'CL' WHEN c_custkey % 7 = 1 THEN 'author schema' ELSE '' END AS sch, CASE WHEN c_custkey % 4 = 0 THEN 'the claim of a person' ELSE '' END AS descr FROM customer),
       v(var, type, role, hard) AS (VALUES ('P', 'ENTITY_PERSON', 'author', TRUE), ('CL', 'ENTITY_CLAIM', 'claim', FALSE), ('E', 'ENTITY_EVENT', '', FALSE), ('L', 'ENTITY_LEGAL', 'rule', TRUE)),
       x AS (SELECT *, 2.0 * CASE WHEN sch = 'author schema' AND var = 'P' THEN 1 WHEN sch = 'CL' AND var = 'CL' THEN 1 ELSE 0 END + CASE WHEN (slot_type = 'WHO' AND var = 'P') OR (slot_type = 'WHAT' AND var IN ('CL', 'E', 'L')) THEN 4.0 ELSE 0 END + CASE WHEN slot_type = 'WHO' AND role = 'author' THEN 2.5 ELSE 0 END
              + 1.5 * CASE WHEN descr = '' THEN 0 WHEN var = 'P' THEN 1 WHEN var = 'CL' THEN 1 ELSE 0 END + CASE WHEN hard THEN 0.25 ELSE 0 END AS score, CASE WHEN target = var THEN 0 WHEN sch = var THEN 1 ELSE 2 END AS how FROM s, v),
       y AS (SELECT *, min(how) OVER (PARTITION BY slot_id) AS best FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY slot_id ORDER BY score DESC, var) AS i, max(score) OVER (PARTITION BY slot_id) AS top FROM y WHERE how = best AND (how < 2 OR score > 0))
       SELECT slot_id, var, CAST(score AS DOUBLE) AS score FROM z WHERE how < 2 OR (i <= 5 AND score >= greatest(1.0, top - 1.5))"""
)
def slot_variables(p: Inputs) -> DataFrame:
    """SLT-05: the variables that a slot is about."""
    k = F.col("c_custkey")
    s = p.customer.select(k.alias("slot_id"), F.when(k % 3 == 0, "WHO").when(k % 3 == 1, "WHAT").otherwise("HOW").alias("slot_type"), F.when(k % 5 == 0, "P").otherwise("").alias("target_var"), F.when(k % 7 == 0, "CL").when(k % 7 == 1, "author schema").otherwise("").alias("target_schema_id"), F.when(k % 4 == 0, "the claim of a person").otherwise("").alias("description"), F.lit(1).alias("intent_id"))
    v = p.spark.createDataFrame([(1, "P", "ENTITY_PERSON", "author", "person", True), (1, "CL", "ENTITY_CLAIM", "claim", "", False), (1, "E", "ENTITY_EVENT", "", "", False), (1, "L", "ENTITY_LEGAL", "rule", "", True)], "intent_id int, var string, type string, role string, hint string, hard boolean")
    takes = p.spark.createDataFrame([("WHO", "ENTITY_PERSON"), ("WHAT", "ENTITY_CLAIM"), ("WHAT", "ENTITY_EVENT")], "slot_type string, category string")
    return slots.slot_variables(s, v, takes, ontology.index(p.spark, ontology.HIERARCHY, None, "parent", "child"), p.spark.createDataFrame([("WHO", "author")], "slot_type string, keyword string"))


_BONUS = ", ".join([f"('{s}', 'e', '{e}', 100)" for s, (es, _) in slots.PREFERRED.items() for e in es] + [f"('{s}', 'v', '{v}', {round(w * 100)})" for s, (_, vs) in slots.PREFERRED.items() for v, w in vs.items()])


@query(
    f"""WITH s AS (SELECT n_nationkey AS slot_id, CASE n_nationkey % 5 WHEN 0 THEN 'EVIDENCE' WHEN 1 THEN 'HOW' WHEN 2 THEN 'WHO' WHEN 3 THEN 'WHAT' ELSE 'OUTCOME' END AS slot_type FROM nation), g AS (SELECT s_suppkey AS subgraph_id, s_suppkey % 4 / 4 AS hard, s_acctbal AS score FROM supplier),
        names(i, v) AS (VALUES (0, 'A'), (1, 'CL'), (2, 'C'), (3, 'RESP'), (4, 'P')), bound AS (SELECT s_suppkey AS subgraph_id, v FROM supplier JOIN names ON s_suppkey % 5 = i OR s_suppkey % 7 = i), held AS (SELECT s_suppkey AS subgraph_id, CASE s_suppkey % 4 WHEN 0 THEN 'CL-[ABOUT]->C' WHEN 1 THEN 'A-[SUPPORTS]->CL' WHEN 2 THEN 'RESP-[RESULTED_IN]->CL' ELSE 'x' END AS e FROM supplier),
        rel AS (SELECT n_nationkey AS slot_id, CASE WHEN n_nationkey % 2 = 0 THEN 'CL' ELSE 'P' END AS v FROM nation), bonus(slot_type, kind, name, w) AS (VALUES {_BONUS}),
        parts AS (SELECT slot_id, subgraph_id, 100 AS w FROM rel JOIN (SELECT DISTINCT * FROM bound) USING (v) UNION ALL SELECT slot_id, subgraph_id, w FROM s JOIN bonus USING (slot_type) JOIN held ON kind = 'e' AND e = name UNION ALL SELECT slot_id, subgraph_id, w FROM s JOIN bonus USING (slot_type) JOIN (SELECT DISTINCT * FROM bound) b ON kind = 'v' AND v = name),
        f AS (SELECT slot_id, subgraph_id, sum(w) / 100 AS fit FROM parts GROUP BY 1, 2)
        SELECT slot_id, subgraph_id, CAST(fit AS DOUBLE) AS score, row_number() OVER (PARTITION BY slot_id ORDER BY fit DESC, hard DESC, score DESC, subgraph_id) AS rank FROM f JOIN g USING (subgraph_id)"""
)
def subgraphs_for_slots(p: Inputs) -> DataFrame:
    """SLT-06: subgraphs ranked for each slot."""
    n, k = F.col("n_nationkey"), F.col("s_suppkey")
    s = p.nation.select(n.alias("slot_id"), F.when(n % 5 == 0, "evidence").when(n % 5 == 1, "HOW").when(n % 5 == 2, "WHO").when(n % 5 == 3, "WHAT").otherwise("OUTCOME").alias("slot_type"))
    names = F.array(*map(F.lit, ["A", "CL", "C", "RESP", "P"]))
    bound = p.supplier.select(k.alias("subgraph_id"), F.explode(F.array_compact(F.array(F.get(names, (k % 5).cast("int")), F.get(names, (k % 7).cast("int"))))).alias("var"))
    held = p.supplier.select(k.alias("subgraph_id"), F.when(k % 4 == 0, "CL-[ABOUT]->C").when(k % 4 == 1, "A-[SUPPORTS]->CL").when(k % 4 == 2, "RESP-[RESULTED_IN]->CL").otherwise("x").alias("edge"))
    g = p.supplier.select(k.alias("subgraph_id"), (k % 4 / 4).alias("hard_coverage"), F.col("s_acctbal").alias("score"))
    return slots.ranked_for_slots(s, p.nation.select(n.alias("slot_id"), F.when(n % 2 == 0, "CL").otherwise("P").alias("var")), g, bound, held)


@query(
    """SELECT o_custkey AS group_id, o_orderkey AS item_id, row_number() OVER (PARTITION BY o_custkey ORDER BY day NULLS LAST, a, o_orderkey) AS step FROM (
         SELECT *, row_number() OVER (PARTITION BY o_custkey, a, day ORDER BY o_totalprice DESC, o_orderkey) AS i FROM (SELECT *, o_orderkey % 3 AS a, CASE WHEN o_orderkey % 4 > 0 THEN date_trunc('month', o_orderdate) END AS day FROM orders)) WHERE i = 1"""
)
def evidence_chronology(p: Inputs) -> DataFrame:
    """SLT-14: a frame's evidence in order of time."""
    e = p.orders.select(F.col("o_custkey").alias("group_id"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 3).alias("artifact_id"), F.when(F.col("o_orderkey") % 4 > 0, F.trunc("o_orderdate", "month")).alias("day"), F.col("o_totalprice").alias("score"))
    return slots.chronology(e)


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 WHEN 2 THEN 1.0 WHEN 3 THEN 0.0 ELSE 0.0 END AS confidence, CASE event_id % 4 WHEN 0 THEN 3 WHEN 1 THEN 12 WHEN 2 THEN NULL ELSE 7 END AS page FROM events")
def normalised_payloads(p: Inputs) -> DataFrame:
    """MSC-19: confidences and page numbers of labels as they come."""
    k = F.col("event_id")
    said = F.when(k % 5 == 0, "75").when(k % 5 == 1, " 0.5").when(k % 5 == 2, "1000").when(k % 5 == 3, "-3").otherwise("high")
    fields = F.when(k % 4 == 0, F.create_map(F.lit("page"), F.lit(" 3 "))).when(k % 4 == 1, F.create_map(F.lit("page"), F.lit("none"), F.lit("index"), F.lit("12"))).when(k % 4 == 2, F.create_map(F.lit("page"), F.lit("0"))).otherwise(F.create_map(F.lit("index"), F.lit("7")))
    return p.events.select("event_id", slots.confidence01(said).alias("confidence"), slots.page_index(fields, ["page", "index"]).alias("page"))


def _records(p: Inputs) -> DataFrame:
    k = F.col("c_custkey")
    person = F.struct(F.when(k % 3 == 0, F.concat(F.lit(" P"), (k % 40).cast("string"), F.lit("@X.org"))).alias("email"), F.concat(F.lit("Name "), (k % 25).cast("string")).alias("name"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("org"))
    firm = F.struct(F.concat(F.initcap("c_mktsegment"), F.when(k % 2 == 0, " Inc.").otherwise("")).alias("name"))
    return p.customer.select(k.cast("string").alias("document_id"), k.alias("seq"), F.array(person).alias("people"), F.array(firm, F.struct(F.lit(" ").alias("name"))).alias("firms"))


@query(
    """WITH x AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN 'p' || CAST(c_custkey % 40 AS STRING) || '@x.org' WHEN c_custkey % 5 > 0 THEN 'name ' || CAST(c_custkey % 25 AS STRING) || '|' || lower(c_mktsegment) END AS key, 'Name ' || CAST(c_custkey % 25 AS STRING) AS name FROM customer)
       SELECT 'Person' AS label, key, arg_min(name, k) AS name FROM x WHERE key IS NOT NULL GROUP BY key UNION ALL
       SELECT 'Organization', lower(c_mktsegment), arg_min(c_name_, k) FROM (SELECT c_custkey AS k, c_mktsegment, upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || CASE WHEN c_custkey % 2 = 0 THEN ' Inc.' ELSE '' END AS c_name_ FROM customer) GROUP BY 2"""
)
def loaded_records(p: Inputs) -> DataFrame:
    """LEG-01, LEG-02: nodes of nested records by their keys."""
    sources = [collect.Source("Person", "people", (("email",), ("name", "org")), "name", "MENTIONS_PERSON"), collect.Source("Organization", "firms", (("name",),), "name", "MENTIONS_ORG", "org")]
    return collect.loaded(_records(p), sources)[0]


@query(
    """SELECT c_custkey AS document_id, CASE WHEN c_custkey % 4 IN (0, 1) THEN 2 ELSE 0 END AS n_entities, CASE WHEN c_custkey % 4 = 1 THEN 1 ELSE 0 END AS n_edges, CASE WHEN c_custkey % 4 = 2 THEN 'no JSON' WHEN c_custkey % 4 = 3 THEN 'empty' END AS skipped FROM customer"""
)
def collected_summaries(p: Inputs) -> DataFrame:
    """MSC-17: entities and relations of summaries, and which were skipped."""
    k = F.col("c_custkey")
    ents = F.concat(F.lit('"entities": [{"term": "'), "c_name", F.lit('", "category": "X"}, {"term": "y"}, {"term": " "}]'))
    said = F.when(k % 4 == 0, F.concat(F.lit("{"), ents, F.lit("}"))).when(k % 4 == 1, F.concat(F.lit("Here: {"), ents, F.lit(', "relationships": [{"term_1": "y", "relationship": "r", "term_2": "z"}, {"term_1": "y"}],}'))).when(k % 4 == 2, "sorry").otherwise("{}")
    return collect.summaries(p.customer.select(k.alias("document_id"), said.alias("raw")), "raw")[2]


@query(
    """SELECT 'label ' || l AS "check", n > 0 AS ok, CAST(n AS STRING) AS detail FROM (SELECT l, (SELECT count(*) FROM supplier WHERE l = 'S') + (SELECT count(*) FROM nation WHERE l = 'N') AS n FROM (VALUES ('S'), ('N'), ('X')) t(l))
       UNION ALL SELECT 'ids of ' || l, CASE WHEN l = 'S' THEN (SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) = 0 ELSE TRUE END, CASE WHEN l = 'S' THEN CAST((SELECT count(*) FROM supplier WHERE s_suppkey % 10 = 0) AS STRING) ELSE '0' END FROM (VALUES ('S'), ('N'), ('X')) t(l)
       UNION ALL SELECT 'path of two edges', TRUE, '1'"""
)
def contract_check(p: Inputs) -> DataFrame:
    """GR-23: labels, ids and paths that a graph must have."""
    nodes = p.supplier.select(F.lit("S").alias("label"), F.when(F.col("s_suppkey") % 10 > 0, F.col("s_name")).otherwise("").alias("uid")).unionByName(p.nation.select(F.lit("N").alias("label"), F.col("n_name").alias("uid")))
    return collect.contract(nodes, p.graph_edges, ["S", "N", "X"])
