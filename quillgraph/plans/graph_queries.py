"""Queries on traversals, rules and runs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators import checks, graph, resolve, rules, runlog
from quillgraph.plans.registry import Inputs, query


@query(
    """
, trail(start_, node, hops, path, used) AS (
  SELECT 's' || CAST(s_suppkey AS STRING), 's' || CAST(s_suppkey AS STRING), 0, '', [''] FROM supplier
  UNION ALL SELECT t.start_, e.dst, t.hops + 1, CASE WHEN t.path = '' THEN e.rel_type ELSE t.path || '>' || e.rel_type END, list_append(t.used, e.uid) FROM trail t JOIN graph_edges e ON e.src = t.node WHERE t.hops < 3 AND NOT list_contains(t.used, e.uid))
SELECT start_ AS "start", node, CAST(min(hops) AS BIGINT) AS hops, arg_min(path, (hops, path)) AS path FROM trail WHERE hops > 0 GROUP BY 1, 2""",
    ("graph_edges",),
)
def khop_neighbors(p: Inputs) -> DataFrame:
    """GR-01: nodes within three hops along trails, with the first path."""
    starts = p.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"))
    return graph.hops(p.graph_edges, starts, 3)


@query(
    """
, both_ AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges),
d(start_, node, hops) AS (
  SELECT 'r' || CAST(r_regionkey AS STRING), 'r' || CAST(r_regionkey AS STRING), 0 FROM region
  UNION SELECT d.start_, b.dst, d.hops + 1 FROM d JOIN both_ b ON b.src = d.node WHERE d.hops < 3)
SELECT start_ AS "start", node, CAST(min(hops) AS BIGINT) AS hops FROM d GROUP BY 1, 2""",
    ("graph_edges",),
)
def shortest_path_3(p: Inputs) -> DataFrame:
    """GR-02: fewest hops, up to three, either way along edges."""
    return graph.distances(p.graph_edges, p.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")), 3)


@query("SELECT src, dst, rel_type, uid FROM graph_edges WHERE substr(src, 1, 1) = 'n' AND substr(dst, 1, 1) = 'n'", ("graph_edges",))
def induced_subgraph(p: Inputs) -> DataFrame:
    """GR-03, FLT-14: edges between nations."""
    return graph.induced(p.graph_edges, p.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")))


@query(
    """
, both_ AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges),
h AS (SELECT 'n0' AS id, 0 AS hops UNION ALL SELECT dst, 1 FROM both_ WHERE src = 'n0' UNION ALL SELECT b.dst, 2 FROM both_ a JOIN both_ b ON b.src = a.dst WHERE a.src = 'n0')
SELECT id, CAST(min(hops) AS BIGINT) AS hops FROM h GROUP BY id ORDER BY hops, id LIMIT 30""",
    ("graph_edges",),
)
def neighbourhood_focus(p: Inputs) -> DataFrame:
    """GR-04: the neighbourhood of one node, nearest first, a view of thirty nodes."""
    e = p.graph_edges
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct()
    return graph.focus(nodes, e, nodes.where("id = 'n0'"), 2, 30)


@query(
    """
, both_ AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges),
h AS (SELECT 'n0' AS id, 0 AS hops UNION ALL SELECT dst, 1 FROM both_ WHERE src = 'n0' UNION ALL SELECT b.dst, 2 FROM both_ a JOIN both_ b ON b.src = a.dst WHERE a.src = 'n0'),
m AS (SELECT id, min(hops) AS hops FROM h GROUP BY id)
SELECT id, kind, CAST(hops AS BIGINT) AS hops, CAST(CASE WHEN hops = 0 THEN 0 WHEN hops = 1 AND kind = 'witness' THEN 1 WHEN hops = 1 THEN 2 ELSE 3 END AS BIGINT) AS priority
FROM (SELECT id, hops, CASE substr(id, 1, 1) WHEN 's' THEN 'witness' ELSE 'other' END AS kind FROM m) ORDER BY priority, id LIMIT 25""",
    ("graph_edges",),
)
def evidence_preview(p: Inputs) -> DataFrame:
    """GR-05: root, witnesses, neighbours, by priority."""
    e = p.graph_edges
    nodes = e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))).distinct().withColumn("kind", F.when(F.col("id").startswith("s"), "witness").otherwise("other"))
    return graph.evidence_preview(nodes, e, nodes.where("id = 'n0'").select("id"), 25)


@query("SELECT CAST((s_suppkey - s_suppkey % 10) AS BIGINT) AS component, CAST(s_suppkey AS BIGINT) AS node FROM supplier WHERE (SELECT max(s_suppkey) FROM supplier) >= (s_suppkey - s_suppkey % 10) + 1")
def connected_components(p: Inputs) -> DataFrame:
    """GR-07: components of chains of ten suppliers."""
    s = p.supplier.select(F.col("s_suppkey").alias("a"))
    edges = s.join(s.select((F.col("a") - 1).alias("k"), F.col("a").alias("b")), F.col("a") == F.col("k")).where("a % 10 <> 9").select("a", "b")
    return graph.components(edges)


@query("SELECT s_suppkey AS src, CASE WHEN s_suppkey % 10 = 9 THEN s_suppkey - 9 ELSE s_suppkey + 1 END AS dst FROM supplier WHERE s_suppkey % 20 < 10")
def cycle_detection(p: Inputs) -> DataFrame:
    """GR-06: of rings and chains of ten, the edges of the rings."""
    k = F.col("s_suppkey")
    ring = F.when(k % 10 != 9, k + 1).when(k % 20 < 10, k - 9)
    return graph.cyclic(p.supplier.select(k.alias("src"), ring.alias("dst")).where("dst IS NOT NULL"))


@query(
    """
, base AS (SELECT src, dst FROM graph_edges WHERE rel_type = 'PART_OF'),
c(src, dst) AS (SELECT src, dst FROM base UNION SELECT c.src, b.dst FROM c JOIN base b ON b.src = c.dst)
SELECT src, dst FROM c""",
    ("graph_edges",),
)
def transitive_closure_rule(p: Inputs) -> DataFrame:
    """GR-18: what is part of a part."""
    return graph.closure(p.graph_edges.where("rel_type = 'PART_OF'"))


@query("SELECT DISTINCT src, dst, rel_type FROM (SELECT src, dst, rel_type FROM graph_edges UNION ALL SELECT dst, src, rel_type FROM graph_edges) WHERE rel_type = 'CORROBORATES'", ("graph_edges",))
def symmetric_rule(p: Inputs) -> DataFrame:
    """GR-18: symmetric relations hold both ways."""
    return rules.symmetric(p.graph_edges)


@query(
    """
, base AS (SELECT src, dst, rel_type FROM graph_edges UNION SELECT dst, src, rel_type FROM graph_edges WHERE rel_type = 'CORROBORATES'),
c(src, dst) AS (SELECT src, dst FROM base WHERE rel_type = 'PART_OF' UNION SELECT c.src, b.dst FROM c JOIN base b ON b.src = c.dst AND b.rel_type = 'PART_OF')
SELECT src, dst, rel_type FROM base UNION SELECT src, dst, 'PART_OF' FROM c""",
    ("graph_edges",),
)
def fixpoint_rules(p: Inputs) -> DataFrame:
    """GR-18: all closure rules together."""
    return rules.closed(p.graph_edges)


@query(
    """SELECT 's' || CAST(s_suppkey AS STRING) AS uid, CASE WHEN s_suppkey % 3 = 0 THEN s_acctbal ELSE CAST(n_regionkey AS DOUBLE) END AS scope FROM supplier JOIN nation ON n_nationkey = s_nationkey
       UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), CAST(n_regionkey AS DOUBLE) FROM nation"""
)
def scope_inheritance(p: Inputs) -> DataFrame:
    """GR-18: a node without a scope takes that of what it is part of."""
    s = p.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("uid"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_acctbal")).alias("scope"))
    n = p.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"), F.col("n_regionkey").cast("double").alias("scope"))
    return rules.inherited(s.unionByName(n), p.graph_edges, "PART_OF", "scope")


@query(
    """
, sym AS (SELECT DISTINCT src, dst FROM (SELECT src, dst FROM graph_edges WHERE rel_type = 'CORROBORATES' UNION SELECT dst, src FROM graph_edges WHERE rel_type = 'CORROBORATES'))
SELECT 'n' || CAST(n_nationkey AS STRING) AS uid, round(CASE WHEN (SELECT count(*) FROM sym WHERE src = 'n' || CAST(n_nationkey AS STRING)) >= 2 THEN least(1.0, n_nationkey / 25.0 + 0.1) ELSE n_nationkey / 25.0 END, 9) AS reliability FROM nation""",
    ("graph_edges",),
)
def support_elevation(p: Inputs) -> DataFrame:
    """GR-19: evidence that two others corroborate gains reliability."""
    ev = p.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("uid"), (F.col("n_nationkey") / 25.0).alias("reliability"))
    return rules.elevated(ev, p.graph_edges)


@query(
    """
, weak AS (SELECT DISTINCT uid FROM premises WHERE claim_uid IN (SELECT claim_uid FROM claims WHERE status IN ('contested', 'retracted', 'superseded'))),
good AS (SELECT DISTINCT conclusion FROM inferences WHERE confidence >= 0.7 AND uid NOT IN (SELECT uid FROM weak) AND uid NOT IN (SELECT uid FROM defeaters))
SELECT claim_uid, CASE WHEN claim_uid IN (SELECT conclusion FROM good) AND status IN ('proposed', 'weakly-supported') THEN 'supported' ELSE status END AS status FROM claims""",
    ("claims", "inferences", "premises", "defeaters"),
)
def claim_elevation(p: Inputs) -> DataFrame:
    """GR-19: claims that a strong, unattacked inference concludes."""
    return rules.supported(p.claims, p.inferences, p.premises, p.defeaters)


@query(
    """
, hit AS (SELECT conclusion, bool_or(type = 'rebutting') AS rebutted, sum(CASE WHEN type = 'undercutting' THEN 1 ELSE 0 END) AS cuts FROM inferences JOIN defeaters USING (uid) GROUP BY conclusion)
SELECT claim_uid, CASE WHEN rebutted THEN 'contested' WHEN cuts > 0 THEN 'weakly-supported' ELSE status END AS status, round(confidence * power(0.5, coalesce(cuts, 0)), 9) AS confidence FROM claims LEFT JOIN hit ON conclusion = claim_uid""",
    ("claims", "inferences", "defeaters"),
)
def claim_degradation(p: Inputs) -> DataFrame:
    """GR-20: what defeaters do to claims."""
    return rules.degraded(p.claims, p.inferences, p.defeaters)


@query("SELECT event_type, date_trunc('day', ts)::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1, 2")
def log_event_metrics(p: Inputs) -> DataFrame:
    """AGG-31: events per kind and day."""
    return runlog.event_counts(p.events.withColumn("day", F.date_format("ts", "yyyy-MM-dd")), ["event_type", "day"])


@query("SELECT e.event_id, e.event_type, c_mktsegment, n_name FROM events e JOIN customer ON c_custkey = e.user_id JOIN nation ON n_nationkey = c_nationkey")
def joined_run_log(p: Inputs) -> DataFrame:
    """JN-25: events with their invocation (customer) and run (nation)."""
    inv = p.customer.select(F.col("c_custkey").alias("invocation_id"), F.col("c_nationkey").alias("run_id"), "c_mktsegment")
    out = runlog.joined_log(p.events.withColumnRenamed("user_id", "invocation_id"), inv, p.nation.select(F.col("n_nationkey").alias("run_id"), "n_name"))
    return out.select("event_id", "event_type", "c_mktsegment", "n_name")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY user_id")
def latest_run_state(p: Inputs) -> DataFrame:
    """STM-03: the latest state of each key of an append-only log."""
    return runlog.latest_state(p.events, "user_id", "event_id").select("user_id", "event_type", "event_id")


@query("SELECT run_id, question FROM runs ORDER BY created_at DESC, run_id LIMIT 5", ("runs",))
def latest_runs(p: Inputs) -> DataFrame:
    """TOP-12."""
    return runlog.latest_runs(p.runs, "created_at", "run_id").select("run_id", "question")


@query("SELECT question, run_id, round(confidence, 9) AS confidence, round(confidence - lag(confidence) OVER (PARTITION BY question ORDER BY run_id), 9) AS delta FROM runs", ("runs",))
def confidence_evolution(p: Inputs) -> DataFrame:
    """WIN-09: confidence from snapshot to snapshot."""
    return runlog.evolution(p.runs, "question", "run_id", "confidence")


@query("SELECT user_id, event_id, round(value, 9) AS value FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events) WHERE value < before")
def out_of_order_events(p: Inputs) -> DataFrame:
    """WIN-10: rows that fall below the row before (values stand for times)."""
    return runlog.out_of_order(p.events, "user_id", "event_id", "value").select("user_id", "event_id", "value")


@query(
    """SELECT a, b, string_agg(why, ',' ORDER BY why) AS why FROM (
         SELECT x.run_id AS a, y.run_id AS b, 'question' AS why FROM runs x JOIN runs y ON x.question = y.question AND x.run_id <> y.run_id
         UNION SELECT x.run_id, y.run_id, 'scope' FROM runs x JOIN runs y ON x.scope_id = y.scope_id AND x.run_id <> y.run_id
         UNION SELECT run_id, parent_id, 'lineage' FROM runs WHERE parent_id IS NOT NULL UNION SELECT parent_id, run_id, 'lineage' FROM runs WHERE parent_id IS NOT NULL) GROUP BY a, b""",
    ("runs",),
)
def related_runs(p: Inputs) -> DataFrame:
    """JN-24, MSC-20: runs of the same question or scope, parents and children."""
    return runlog.related(p.runs)


@query(
    """, l(scope_id, root, up, depth) AS (SELECT run_id, run_id, parent_id, 0 FROM runs UNION ALL SELECT l.scope_id, r.run_id, r.parent_id, l.depth + 1 FROM l JOIN runs r ON r.run_id = l.up WHERE l.depth < 10)
       SELECT scope_id, arg_max(root, depth) AS root, CAST(max(depth) AS BIGINT) AS depth FROM l GROUP BY scope_id""",
    ("runs",),
)
def scope_lineage(p: Inputs) -> DataFrame:
    """REV-04: the first ancestor of each scope."""
    return runlog.lineage(p.runs.select(F.col("run_id").alias("scope_id"), "parent_id"))


@query(
    """SELECT o_custkey, arg_max(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS created_at, max(o_orderkey) AS updated_at FROM orders GROUP BY o_custkey"""
)
def review_upsert(p: Inputs) -> DataFrame:
    """REV-01: the newest review of each key with its first creation time."""
    r = p.orders.select("o_custkey", F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("created_at"), F.col("o_orderkey").alias("updated_at"))
    return runlog.reviews(r.where("updated_at % 3 = 0"), r.where("updated_at % 3 <> 0"), ["o_custkey"])


@query("SELECT event_id, event_type FROM events WHERE user_id = 8 AND event_type = 'error'")
def workspace_context(p: Inputs) -> DataFrame:
    """REV-03."""
    return runlog.workspace(p.events.withColumnsRenamed({"user_id": "workspace_id", "event_type": "status"}), 8, "error").select("event_id", F.col("status").alias("event_type"))


@query(
    """SELECT 'align' AS stage, 'documents' AS metric, CAST(count(*) AS DOUBLE) AS value FROM documents UNION ALL SELECT 'align', 'languages', CAST(count(DISTINCT lang) AS DOUBLE) FROM documents
       UNION ALL SELECT 'trace', 'labelled', CAST(count(*) AS DOUBLE) FROM labels UNION ALL SELECT 'trace', 'toxic', CAST(sum(toxic) AS DOUBLE) FROM labels"""
)
def stage_metrics(p: Inputs) -> DataFrame:
    """MSC-01, STM-05, AGG-33: metrics of stages as event rows."""
    return runlog.stage_metrics({"align": (p.documents, {"documents": F.count("*"), "languages": F.countDistinct("lang")}), "trace": (p.labels, {"labelled": F.count("*"), "toxic": F.sum("toxic")})})


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN event_type = 'error' THEN 'patched' ELSE 'kept' END AS state FROM events")
def json_merge(p: Inputs) -> DataFrame:
    """JSN-03, STM-02: JSON properties with a patch that wins."""
    from quillgraph.functions.structs import merged

    props = F.map_concat(F.from_json("props", "map<string,string>"), F.create_map(F.lit("state"), F.lit("kept")))
    patch = F.when(F.col("event_type") == "error", F.create_map(F.lit("state"), F.lit("patched")))
    m = merged(props, patch)
    return p.events.select("event_id", m["k"].cast("long").alias("k"), m["state"].alias("state"))


@query(
    """SELECT event_id, CASE event_type WHEN 'error' THEN 'CORROBORATES' WHEN 'view' THEN 'Surface disagreement diagnostic' WHEN 'click' THEN 'Support / corroboration' WHEN 'signup' THEN 'Potential refutation' WHEN 'purchase' THEN 'CONTRADICTS' ELSE 'Claim relationship' END AS label,
         CASE event_type WHEN 'error' THEN 'support' WHEN 'view' THEN 'diagnostic' WHEN 'click' THEN 'support' WHEN 'signup' THEN 'semantic' WHEN 'purchase' THEN 'semantic' ELSE 'unknown' END AS severity, event_type IN ('error', 'click', 'signup', 'purchase') AS is_semantic FROM events"""
)
def relation_kinds(p: Inputs) -> DataFrame:
    """REV-02: what conflicts say, by relationship, rule or stance."""
    of = lambda **x: F.coalesce(*[F.when(F.col("event_type") == k, v) for k, v in x.items()], F.lit(None).cast("string"))
    kind = runlog.relation_kind(of(error="SURFACE_MISMATCH", view="SURFACE_MISMATCH", signup="TEMPORAL_CLASH"), of(view="REFUTES", click="SUPPORTS", signup="REFUTES"), of(error="CORROBORATES", purchase="CONTRADICTS"))
    return p.events.select("event_id", kind.alias("x")).select("event_id", "x.*")


@query("SELECT uid FROM (SELECT 's' || CAST(s_suppkey AS STRING) AS uid FROM supplier WHERE s_suppkey % 2 = 0)")
def derivation_subgraph(p: Inputs) -> DataFrame:
    """GR-17: sources that what is derived comes from."""
    e = p.supplier.where("s_suppkey % 2 = 0").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("src"), F.lit("c").alias("dst"), F.lit("SUPPORTS").alias("rel_type"))
    back = graph.induced(e, e.select(F.col("src").alias("id")).unionByName(e.select(F.col("dst").alias("id"))))
    return back.select(F.col("src").alias("uid")).distinct()


@query("SELECT category, count(*) AS n FROM (SELECT DISTINCT p_type AS category, p_name FROM part) GROUP BY category")
def mention_clusters(p: Inputs) -> DataFrame:
    """GR-10: mentions clustered in order; names of one category that contain each other are one."""
    m = p.part.select(F.col("p_partkey").cast("string").alias("mention_id"), F.col("p_partkey").alias("seq"), F.col("p_type").alias("category"), F.upper("p_name").alias("surface"), F.col("p_name").alias("normalized"))
    return resolve.mention_clusters(m).groupBy("category").agg(F.countDistinct("cluster").alias("n"))


@query("SELECT rel_type, count(*) AS n FROM graph_edges GROUP BY 1 HAVING count(*) > 1", ("graph_edges",))
def graph_histogram(p: Inputs) -> DataFrame:
    """AGG-10, AGG-32."""
    return checks.counts(p.graph_edges, "rel_type").withColumnRenamed("name", "rel_type").where("n > 1")
