"""Queries on contradictions, transformations, chains, confidence, hypotheses and intents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import dates, scores
from quillgraph.functions import text as t
from quillgraph.operators import chains, conflict, construct, intent, mentions, transform
from quillgraph.plans.registry import Inputs, query

#: Witnesses with tokens, month of their date and pairs within slots, as the rules see them.
PAIRS = """
, w AS (SELECT *, list_distinct(regexp_extract_all(lower(surface), '[a-z0-9]+')) AS toks, regexp_extract(content_excerpt, '(20[0-9]{2}-[0-9]{2}-[0-9]{2})', 1) AS iso, regexp_extract(content_excerpt, '([0-9]{4})-', 1) AS yr FROM witnesses WHERE reliability_score >= 0.05),
dated AS (SELECT *, CASE WHEN iso <> '' THEN CAST(substr(iso, 1, 4) AS INT) * 12 + CAST(substr(iso, 6, 2) AS INT) ELSE CAST(yr AS INT) * 12 + 6 END AS mon, CASE WHEN iso <> '' THEN iso ELSE yr END AS day FROM w),
pairs AS (
  SELECT a.uid AS uid_a, b.uid AS uid_b, a.claim_uid AS claim_a, b.claim_uid AS claim_b, a.surface AS sa, b.surface AS sb, a.var_name AS va, b.var_name AS vb, a.kg0_entity_id AS ka, b.kg0_entity_id AS kb, a.reliability_score AS ra, b.reliability_score AS rb,
         a.quality AS qa, b.quality AS qb, a.slot_type AS slot, a.day AS da, b.day AS db, a.mon AS ma, b.mon AS mb, contains(lower(b.content_excerpt), 'replaces') AS bsup, contains(lower(a.content_excerpt), 'replaces') AS asup,
         len(list_intersect(a.toks, b.toks)) / len(list_distinct(list_concat(a.toks, b.toks))) AS j
  FROM dated a JOIN dated b ON a.slot_type = b.slot_type AND a.uid < b.uid)
"""
R1 = """SELECT uid_a, uid_b, round(least(ra + 0.1, rb + 0.1, 1.0), 9) AS confidence, CASE WHEN ra <= rb THEN uid_a ELSE uid_b END AS weaker_uid FROM pairs
 WHERE va = vb AND NOT (ka <> '' AND ka = kb) AND NOT contains(lower(sa), lower(sb)) AND NOT contains(lower(sb), lower(sa)) AND j < 0.6 AND NOT (qa = 'AMBIGUOUS' AND qb = 'AMBIGUOUS')"""


@query(PAIRS + R1, ("witnesses",))
def conflict_surface_mismatch(p: Inputs) -> DataFrame:
    """R1, JN-19, STR-13: incompatible answers to one slot and variable."""
    pairs = conflict.grouped(conflict.usable(p.witnesses), ["slot_type", "var_name"])
    return conflict.detect(pairs, conflict.surface_mismatch()).select("uid_a", "uid_b", "confidence", "weaker_uid")


@query(
    PAIRS
    + """SELECT uid_a, uid_b, CASE WHEN sup THEN 'TEMPORAL_SUPERSESSION' ELSE 'TEMPORAL_CLASH' END AS rule, CASE WHEN sup THEN 'undercutting' ELSE 'rebutting' END AS defeater_type,
  round(CASE WHEN sup THEN least(least(0.7 + apart / 120, 0.95), 0.75) ELSE least(0.7 + apart / 120, 0.95) END, 9) AS confidence
FROM (SELECT *, abs(ma - mb) AS apart, CASE WHEN (mb - 1) // 12 >= (ma - 1) // 12 THEN bsup ELSE asup END AS sup FROM pairs) WHERE da <> db AND apart >= 6""",
    ("witnesses",),
)
def conflict_temporal(p: Inputs) -> DataFrame:
    """R2, R2S, DT-03, DT-04: dates months apart, or one text that replaces the other."""
    pairs = conflict.grouped(conflict.usable(p.witnesses), ["slot_type"])
    return conflict.detect(pairs, conflict.temporal()).select("uid_a", "uid_b", "rule", "defeater_type", "confidence")


@query(
    PAIRS
    + """SELECT uid_a, uid_b, round(least(abs(ra - rb), 0.9), 9) AS confidence, CASE WHEN ra <= rb THEN uid_a ELSE uid_b END AS weaker_uid FROM pairs WHERE abs(ra - rb) >= 0.4 AND (va = '' OR vb = '' OR va = vb) AND ((ka <> '' AND ka = kb) OR j >= 0.6)""",
    ("witnesses",),
)
def conflict_reliability(p: Inputs) -> DataFrame:
    """R5: one answer on evidence of very different reliability."""
    pairs = conflict.grouped(conflict.usable(p.witnesses), ["slot_type"])
    return conflict.detect(pairs, conflict.divergence()).select("uid_a", "uid_b", "confidence", "weaker_uid")


@query(
    PAIRS
    + """, n AS (SELECT uid_a, uid_b, sup, apart, claim_a FROM (SELECT *, abs(ma - mb) AS apart, CASE WHEN (mb - 1) // 12 >= (ma - 1) // 12 THEN bsup ELSE asup END AS sup FROM pairs) WHERE da <> db AND apart >= 6)
SELECT claim_a AS cluster, count(*) AS size, round(max(CASE WHEN sup THEN least(0.7 + apart / 120, 0.75) ELSE least(0.7 + apart / 120, 0.95) END), 9) AS confidence, CASE arg_min(sup, (uid_a, uid_b)) WHEN TRUE THEN 'UNDERCUTS' ELSE 'REFUTES' END AS stance FROM n GROUP BY claim_a""",
    ("witnesses",),
)
def conflict_clusters(p: Inputs) -> DataFrame:
    """AGG-20, stance: conflicts about one claim."""
    found = conflict.detect(conflict.grouped(conflict.usable(p.witnesses), ["slot_type"]), conflict.temporal())
    return conflict.clusters(found).select("cluster", "size", "confidence", conflict.stance(F.col("defeater_type")).alias("stance"))


@query()
def contradictions(p: Inputs) -> DataFrame:
    """All rules in their order, TOP-09: up to 200 pairs of a group, the reliable first."""
    return conflict.contradictions(p.witnesses).groupBy("rule", "defeater_type").agg(F.count("*").alias("n"))


@query(
    """
, w AS (SELECT uid, var_name, slot_type, reliability_score AS r FROM witnesses WHERE reliability_score >= 0.05),
t AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY slot_type ORDER BY r DESC, uid) <= greatest(1, count(*) OVER (PARTITION BY slot_type) // 2) THEN 0 ELSE 1 END AS tier FROM w),
x AS (SELECT a.slot_type, a.uid AS uid_a, b.uid AS uid_b, row_number() OVER (PARTITION BY a.slot_type ORDER BY a.tier + b.tier, least(a.r, b.r) DESC, a.uid, b.uid) AS i FROM t a JOIN t b ON a.slot_type = b.slot_type AND a.uid < b.uid)
SELECT uid_a, uid_b FROM x WHERE i <= 20""",
    ("witnesses",),
)
def capped_pairs(p: Inputs) -> DataFrame:
    """TOP-09: twenty pairs of a slot."""
    return conflict.grouped(conflict.usable(p.witnesses), ["slot_type"], 20).select(F.col("a.uid").alias("uid_a"), F.col("b.uid").alias("uid_b"))


_TEXTS = """
WITH d AS (SELECT item_id, text AS s, CASE item_id % 5 WHEN 0 THEN text WHEN 1 THEN substr(text, 1, CAST(length(text) * 0.5 AS INT)) WHEN 2 THEN regexp_replace(text, 'the ', 'a ', 'g') WHEN 3 THEN 'zzz yyy' ELSE '' END AS t FROM benchmark),
k AS (SELECT item_id, regexp_extract_all(lower(s), '[a-z0-9]+') AS st, regexp_extract_all(lower(t), '[a-z0-9]+') AS tt FROM d),
x AS (SELECT item_id, array_to_string(st, ' ') AS sn, array_to_string(tt, ' ') AS tn, len(st) AS sl, len(tt) AS tl, len(list_intersect(list_distinct(st), list_distinct(tt))) AS i, CASE WHEN len(st) > 0 AND len(tt) > 0 THEN len(list_intersect(list_distinct(st), list_distinct(tt))) / len(list_distinct(list_concat(st, tt))) ELSE 0 END AS j FROM k)
"""


@query(
    _TEXTS
    + """SELECT item_id, CASE WHEN sl = 0 OR tl = 0 THEN 'OTHER' WHEN sn = tn THEN 'VERBATIM' WHEN (contains(sn, tn) OR contains(tn, sn)) AND least(sl, tl) / greatest(sl, tl) <= 0.75 THEN 'COMPRESSION' WHEN j >= 0.35 THEN 'PARAPHRASE' WHEN i = 0 THEN 'OMISSION' ELSE 'OTHER' END AS label,
  round(CASE WHEN sl = 0 OR tl = 0 THEN 0.2 WHEN sn = tn THEN 1.0 WHEN (contains(sn, tn) OR contains(tn, sn)) AND least(sl, tl) / greatest(sl, tl) <= 0.75 THEN least(0.95, 0.7 + j / 4) WHEN j >= 0.35 THEN least(0.9, 0.55 + j / 3) WHEN i = 0 THEN 0.55 ELSE 0.35 END, 9) AS confidence FROM x"""
)
def text_transform_labels(p: Inputs) -> DataFrame:
    """Text transformation classifier: what became of a passage."""
    k = F.col("item_id") % 5
    changed = F.when(k == 0, F.col("text")).when(k == 1, F.substr("text", F.lit(1), F.round(F.length("text") * 0.5).cast("int"))).when(k == 2, F.regexp_replace("text", "the ", "a ")).when(k == 3, F.lit("zzz yyy")).otherwise("")
    out = p.benchmark.withColumn("x", transform.classify(F.col("text"), changed))
    return out.select("item_id", "x.label", "x.confidence")


@query(
    """
WITH s AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (0, 1)), t AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IN (1, 2)),
x AS (SELECT s.vec_id AS source, t.vec_id AS target, list_dot_product(s.v, t.v) / (sqrt(list_dot_product(s.v, s.v)) * sqrt(list_dot_product(t.v, t.v))) AS similarity FROM s JOIN t ON s.vec_id <> t.vec_id
      WHERE NOT (s.vec_id > t.vec_id AND s.label = 1 AND t.label = 1))
SELECT source, target, round(similarity, 6) AS similarity FROM (SELECT * FROM x ORDER BY similarity DESC, source, target LIMIT 60)"""
)
def mapping_pairs(p: Inputs) -> DataFrame:
    """JN-18, TOP-02: the pairs of a source and a target with the largest cosine; vectors of label 1 are both."""
    e = p.embeddings
    return transform.similar_pairs(e.where("label IN (0, 1)"), e.where("label IN (1, 2)"), "vec_id", "embedding", 60, 100).withColumn("similarity", F.round("similarity", 6))


@query(
    """SELECT source, target, rank, CASE WHEN rank <= 3 THEN 'active' ELSE 'retracted' END AS status FROM (SELECT l_partkey AS source, l_orderkey AS target, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_tax DESC, l_partkey) AS rank
       FROM (SELECT l_orderkey, l_partkey, max(l_discount) AS l_discount, max(l_tax) AS l_tax FROM lineitem GROUP BY 1, 2))"""
)
def retained_mappings(p: Inputs) -> DataFrame:
    """WIN-04: three mappings per target stay."""
    m = p.lineitem.groupBy(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target")).agg(F.max("l_discount").alias("confidence"), F.max("l_tax").alias("similarity"))
    return transform.retained(m).select("source", "target", "rank", "status")


@query("SELECT l_partkey AS source, l_orderkey AS target FROM (SELECT l_orderkey, l_partkey, max(l_extendedprice) AS s FROM lineitem GROUP BY 1, 2) ORDER BY s DESC, l_partkey, l_orderkey LIMIT 40")
def top_pairs(p: Inputs) -> DataFrame:
    """TOP-02."""
    m = p.lineitem.groupBy(F.col("l_partkey").alias("source"), F.col("l_orderkey").alias("target")).agg(F.max("l_extendedprice").alias("similarity"))
    return transform.top_pairs(m, 40).select("source", "target")


@query("SELECT o_orderkey AS candidate_id, row_number() OVER (PARTITION BY o_custkey ORDER BY least(1, CASE WHEN o_totalprice / 4000 > 1 THEN o_totalprice / 400000 ELSE o_totalprice / 4000 END) DESC, o_orderkey) AS rank FROM orders")
def slot_candidate_rank(p: Inputs) -> DataFrame:
    """WIN-03, TRC-02: candidates ranked within slots."""
    c = p.orders.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("slot_id"), (F.col("o_totalprice") / 4000).alias("score"))
    return chains.ranked_candidates(c).select("candidate_id", "rank")


@query(
    """
, best AS (SELECT chain_id, slot_type, max(score) AS b FROM chain_members GROUP BY 1, 2),
e AS (SELECT chain_id, avg(b) AS ec FROM best GROUP BY 1),
g AS (SELECT chain_id, count(DISTINCT slot_type) AS ns, count(DISTINCT artifact_id) AS na, bool_and(witness_id <> '') AS wc, bool_and(temporal) AS tc, max(source_score) AS ss, bool_or(slot_type = 'WHAT') AND bool_or(slot_type = 'WHO') AS ok FROM chain_members GROUP BY 1),
s AS (SELECT chain_id, ok, 0.2 * ns / 4 + 0.15 * CASE WHEN wc THEN 1 ELSE 0 END + 0.05 * na / 13 + 0.1 * CASE WHEN tc THEN 1 ELSE 0 END + 0.2 * ec + 0.05 * ss + 0.2 AS score FROM g JOIN e USING (chain_id)),
f AS (SELECT chain_id, ok, CASE WHEN NOT ok THEN least(score, 0.1999) ELSE score END AS score FROM s)
SELECT chain_id, round(score, 9) AS score, ok AS answerable FROM f""",
    ("chain_members",),
)
def chain_rank(p: Inputs) -> DataFrame:
    """AGG-17, AGG-18, AGG-19, TOP-07: scores of evidence chains."""
    members = p.chain_members
    none = members.select(F.col("candidate_id").alias("source"), F.col("candidate_id").alias("target")).where("FALSE")
    return chains.chains(members, none, 4, 13, ["WHAT", "WHO"]).select("chain_id", "score", "answerable")


@query(
    """, b AS (SELECT question, slot, max(confidence) AS c FROM claims GROUP BY 1, 2), w AS (SELECT *, CASE slot WHEN 'WHAT' THEN 2.0 WHEN 'EVIDENCE' THEN 1.5 WHEN 'WHEN' THEN 0.8 ELSE 1.0 END AS w FROM b)
       SELECT question, round(greatest(round(sum(c * w) / sum(w), 4), 0.01), 9) AS confidence, CASE WHEN count(*) FILTER (WHERE slot IN ('WHAT', 'EVIDENCE', 'WHO', 'HOW', 'WHEN')) = 5 THEN 'composite' ELSE 'partial' END AS kind FROM w GROUP BY question""",
    ("claims",),
)
def synthesis_confidence(p: Inputs) -> DataFrame:
    """AGG-24."""
    return construct.synthesis(p.claims, "question")


@query(
    """, d AS (SELECT uid, product(CASE WHEN type = 'rebutting' THEN greatest(0.4::DOUBLE, 0.6::DOUBLE - (cluster_size - 1) * 0.05::DOUBLE) ELSE 0.8::DOUBLE END) AS f, count(*) AS n FROM defeaters GROUP BY uid)
       SELECT uid, round(confidence, 9) AS confidence, CASE WHEN f IS NULL THEN round(confidence, 9) ELSE CAST(round(CAST(greatest(confidence * f, 0.01) AS DECIMAL(18,12)), 4) AS DOUBLE) END AS updated, coalesce(n, 0) AS defeaters FROM inferences LEFT JOIN d USING (uid)""",
    ("inferences", "defeaters"),
)
def defeater_weakening(p: Inputs) -> DataFrame:
    """AGG-21: the product of the penalties."""
    return construct.weakened(p.inferences, p.defeaters)


@query(
    """, n AS (SELECT uid, count(*) AS n FROM premises WHERE claim_uid IN (SELECT claim_uid FROM claims WHERE status = 'contested') GROUP BY uid)
       SELECT uid, round(CASE WHEN n IS NULL THEN confidence ELSE greatest(round(confidence * CASE WHEN n = 1 THEN 0.7 ELSE 0.5 END, 4), 0.01) END, 9) AS updated FROM inferences LEFT JOIN n USING (uid)""",
    ("inferences", "premises", "claims"),
)
def contested_premises(p: Inputs) -> DataFrame:
    """AGG-22: inferences on contested claims lose .3, on several .5."""
    return construct.discounted(p.inferences, p.premises, p.claims.where("status = 'contested'").select("claim_uid")).select("uid", "updated")


@query(
    """SELECT uid, CASE WHEN gain > 0.075 THEN 'three' WHEN gain > 0.025 THEN 'two' ELSE 'none' END AS boost FROM (
         SELECT 'i' || CAST(c_custkey AS STRING) AS uid, least((c_acctbal + 1000) / 11000 + CASE WHEN coalesce(docs, 0) >= 3 THEN 0.1 WHEN docs = 2 THEN 0.05 ELSE 0 END, 1) - (c_acctbal + 1000) / 11000 AS gain
         FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey % 13) AS docs FROM orders GROUP BY 1) ON o_custkey = c_custkey)"""
)
def corroboration_boost(p: Inputs) -> DataFrame:
    """AGG-23: what further documents add to a confidence, 1 at most."""
    grounds = p.orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("claim_uid"), (F.col("o_orderkey") % 13).cast("string").alias("artifact_id"))
    gain = F.col("updated") - F.col("confidence")
    return construct.corroborated(p.inferences, grounds).select("uid", F.when(gain > 0.075, "three").when(gain > 0.025, "two").otherwise("none").alias("boost"))


@query(
    """, b AS (SELECT question, slot, max(confidence) AS c FROM claims GROUP BY 1, 2), r(f, t) AS (VALUES ('WHO', 'WHAT'), ('WHO', 'HOW'), ('WHAT', 'EVIDENCE'), ('WHEN', 'WHAT'), ('HOW', 'EVIDENCE'))
       SELECT x.question, f AS from_slot, t AS to_slot, round((x.c + y.c) / 2, 9) AS confidence FROM r JOIN b x ON x.slot = f JOIN b y ON y.slot = t AND y.question = x.question""",
    ("claims",),
)
def cross_slot_inferences(p: Inputs) -> DataFrame:
    """AGG-25, GR-16."""
    return construct.cross_slot(p.claims, "question")


_BANDS = "CASE WHEN confidence - 0.5 > 0.2 THEN 'STABLE' WHEN confidence - 0.5 > 0.1 THEN 'MARGINAL' WHEN confidence - 0.5 > 0 THEN 'SENSITIVE' ELSE 'BELOW_FLOOR' END"


@query(
    f""", b AS (SELECT claim_uid, {_BANDS} AS band FROM inferences)
       SELECT claim_uid, CASE WHEN status = 'contested' OR coalesce(band, '') = 'SENSITIVE' THEN 'HIGH' WHEN coalesce(band, '') = 'MARGINAL' OR n_witnesses = 1 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM claims LEFT JOIN b USING (claim_uid)""",
    ("claims", "inferences"),
)
def uncertainty_map(p: Inputs) -> DataFrame:
    """AGG-27: how uncertain claims are, by contest, sensitivity and number of witnesses."""
    bands = construct.sensitivity(p.inferences).join(p.inferences.select("uid", "claim_uid"), "uid").select("claim_uid", F.col("band").alias("sensitivity"))
    return construct.uncertainty(p.claims.join(bands, "claim_uid", "left"))


@query(f"SELECT uid, round(confidence - 0.5, 4) AS margin, {_BANDS} AS band FROM inferences", ("inferences",))
def sensitivity_bands(p: Inputs) -> DataFrame:
    """AGG-27: margins over the floor at which an answer is accepted."""
    return construct.sensitivity(p.inferences)


@query("SELECT c_custkey AS statement_id, coalesce(n, 0) AS n_witnesses, coalesce(n, 0) >= 1 AS tethered FROM customer LEFT JOIN (SELECT o_custkey, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1) ON o_custkey = c_custkey")
def tether_completeness(p: Inputs) -> DataFrame:
    """AGG-28."""
    return construct.tethered(p.customer.select(F.col("c_custkey").alias("statement_id")), p.orders.select(F.col("o_custkey").alias("statement_id"), F.col("o_orderkey").alias("witness_uid")))


@query(
    """, r AS (SELECT claim_uid, CAST(sum(CAST(CASE WHEN quality = 'AMBIGUOUS' THEN 0.5 ELSE reliability_score END AS DECIMAL(18,9))) AS DOUBLE) / count(*) AS reliability FROM witnesses GROUP BY 1)
       SELECT claim_uid, CAST(round(CAST(reliability AS DECIMAL(28,15)), 9) AS DOUBLE) AS reliability, CASE WHEN reliability >= 0.8 THEN round(least(confidence * 1.0, 1.0), 4) ELSE round(confidence, 9) END AS confidence FROM claims LEFT JOIN r USING (claim_uid)""",
    ("witnesses", "claims"),
)
def claim_reliability(p: Inputs) -> DataFrame:
    """AGG-26: mean reliability of a claim's witnesses (of ambiguous ones, none is known) and the confidence that it weighs."""
    grounds = p.witnesses.select("claim_uid", F.when(F.col("quality") != "AMBIGUOUS", F.col("reliability_score")).alias("reliability"))
    return construct.trusted(p.claims.select("claim_uid", "confidence"), grounds)


@query("SELECT claim_uid, CASE quality WHEN 'GROUNDED' THEN 'supported' WHEN 'INFERRED' THEN 'weakly-supported' ELSE 'proposed' END AS status FROM claims WHERE NOT (quality = 'AMBIGUOUS' AND confidence = 0)", ("claims",))
def claim_status(p: Inputs) -> DataFrame:
    """GR-15."""
    return construct.status(p.claims)


@query(
    """SELECT slot, role, surface, candidate_id FROM (SELECT slot_type AS slot, var_name AS role, lower(surface) AS surface, uid AS candidate_id,
         row_number() OVER (PARTITION BY slot_type, var_name, lower(surface) ORDER BY CASE quality WHEN 'GROUNDED' THEN 0 WHEN 'INFERRED' THEN 1 ELSE 2 END, reliability_score DESC, 1, artifact_id, '', uid) AS i FROM witnesses) WHERE i = 1""",
    ("witnesses",),
)
def output_candidates(p: Inputs) -> DataFrame:
    """WIN-06: one candidate per slot, role and surface."""
    w = p.witnesses.select(F.col("slot_type").alias("slot"), F.col("var_name").alias("role"), F.lower("surface").alias("surface"), F.col("uid").alias("candidate_id"), "quality", F.col("reliability_score").alias("confidence"), F.lit(1).alias("rank"), "artifact_id", F.lit("").alias("anchor_id"))
    return construct.output_candidates(w).select("slot", "role", "surface", "candidate_id")


@query(
    """, w AS (SELECT slot_type, avg(CASE quality WHEN 'GROUNDED' THEN 1.0 WHEN 'INFERRED' THEN 0.7 ELSE 0.4 END) AS q, count(*) AS n, count(DISTINCT artifact_id) AS a, avg(reliability_score) AS m, bool_and(quality = 'GROUNDED') AS ev, bool_or(quality = 'GROUNDED') AS an FROM witnesses GROUP BY 1),
       v AS (SELECT slot_type, max(k) AS k FROM (SELECT slot_type, var_name, count(*) AS k FROM witnesses WHERE var_name <> '' GROUP BY 1, 2) GROUP BY 1)
       SELECT slot_type AS slot_id, round(greatest(0, least(1, 0.35 * m + 0.25 * q + 0.15 * least(1, n / 3) + 0.15 * coalesce(k / n, 0) + 0.1 * least(1, greatest(0, a - 1) / 2))), 6) AS confidence, CASE WHEN ev THEN 'GROUNDED' WHEN an THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS quality FROM w LEFT JOIN v USING (slot_type)""",
    ("witnesses",),
)
def slot_confidence(p: Inputs) -> DataFrame:
    """AGG-14, AGG-15."""
    w = p.witnesses.withColumnRenamed("slot_type", "slot_id")
    out = chains.slot_confidence(w, w.select("slot_id", F.col("var_name").alias("var"), F.col("reliability_score").alias("confidence")))
    return out.withColumn("confidence", F.round("confidence", 6))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS seq, round(max(value) OVER (PARTITION BY user_id ORDER BY value, event_id ROWS UNBOUNDED PRECEDING), 9) AS ts FROM events")
def provenance_sequence(p: Inputs) -> DataFrame:
    """WIN-07: numbered steps whose times never fall."""
    return chains.sequence(p.events, "user_id", "value", "event_id")


@query(
    """SELECT slot_type, candidate_id FROM (SELECT slot_type, candidate_id, row_number() OVER (PARTITION BY slot_type ORDER BY score DESC, candidate_id) AS i FROM chain_members WHERE slot_type IN ('WHAT', 'WHEN')) WHERE i = 1""", ("chain_members",)
)
def repair_chain(p: Inputs) -> DataFrame:
    """TOP-13: the best candidate of each required slot."""
    return chains.repair(p.chain_members, ["WHAT", "WHEN"]).select("slot_type", "candidate_id")


@query(
    """SELECT candidate_id, rank FROM (SELECT candidate_id, row_number() OVER (ORDER BY prio, score DESC, candidate_id) AS rank FROM (SELECT *, CASE artifact_id WHEN 'a1' THEN 0 ELSE 1 END AS prio FROM chain_members) WHERE slot_type = 'EVIDENCE' AND chain_id NOT LIKE 'ch1%') WHERE rank <= 3""",
    ("chain_members",),
)
def evidence_supplement(p: Inputs) -> DataFrame:
    """TOP-11."""
    m = p.chain_members.withColumn("priority", F.when(F.col("artifact_id") == "a1", 0).otherwise(1))
    return chains.supplement(m, "EVIDENCE", m.where("chain_id LIKE 'ch1%'")).select("candidate_id", "rank")


@query(
    """, c AS (SELECT chain_id, round(avg(score), 6) AS score, count(*) AS n FROM chain_members GROUP BY 1)
       SELECT chain_id, round(score, 9) AS score, round(greatest(0, score - n / 1000), 9) AS effective FROM c ORDER BY greatest(0, score - n / 1000) DESC, chain_id LIMIT 1""",
    ("chain_members",),
)
def effective_chain(p: Inputs) -> DataFrame:
    """TOP-08, JN-21, CON-01: the best chain after penalties."""
    c = p.chain_members.groupBy("chain_id").agg(F.round(F.avg("score"), 6).alias("score"), (F.count("*") / 1000).alias("penalty"))
    return chains.effective(c.select("chain_id", "score", F.lit(1).alias("rank")), c.select("chain_id", "penalty")).select("chain_id", "score", "effective")


@query("SELECT hypothesis, round(least(1.0, max(confidence) + least(0.2, 0.05 * (count(DISTINCT artifact_id) - 1))), 9) AS confidence FROM mentions GROUP BY 1", ("mentions",))
def entity_confidence(p: Inputs) -> DataFrame:
    """AGG-13."""
    return mentions.entity_confidence(p.mentions)


@query(
    """, h AS (SELECT DISTINCT hypothesis, anchor_id FROM mentions), c AS (SELECT hypothesis, max(confidence) AS c FROM mentions GROUP BY 1)
       SELECT a.hypothesis AS src, b.hypothesis AS dst, count(*) AS shared, CAST(round(CAST(least(0.86, 0.52 + least(0.14, 0.06 * count(*)) + least(0.1, 0.1 * min(x.c)) + least(0.1, 0.1 * min(y.c))) AS DECIMAL(18,9)), 4) AS DOUBLE) AS confidence
       FROM h a JOIN h b ON a.anchor_id = b.anchor_id AND a.hypothesis < b.hypothesis JOIN c x ON x.hypothesis = a.hypothesis JOIN c y ON y.hypothesis = b.hypothesis GROUP BY 1, 2""",
    ("mentions",),
)
def anchor_links(p: Inputs) -> DataFrame:
    """GR-11, SLT-11, STR-18: hypotheses that share anchors."""
    out = mentions.shared_links(p.mentions, "anchor_id")
    return out.select("src", "dst", "shared", scores.shared_anchor_confidence(F.col("src_confidence"), F.col("dst_confidence"), F.col("shared")).alias("confidence"))


@query("SELECT hypothesis, candidate, round(total, 9) AS total, support, rank FROM (SELECT *, row_number() OVER (PARTITION BY hypothesis ORDER BY total DESC, candidate) AS rank FROM (SELECT hypothesis, artifact_id AS candidate, sum(confidence * 1.0) AS total, count(DISTINCT mention_id) AS support FROM mentions GROUP BY 1, 2))", ("mentions",))
def kg_candidate_totals(p: Inputs) -> DataFrame:
    """AGG-12, MSC-05: candidates of hypotheses added up over mentions."""
    links = p.mentions.select("hypothesis", "mention_id", F.col("artifact_id").alias("candidate"), F.col("confidence").alias("score"), F.lit(1).alias("rank"), F.lit(1.0).alias("weight"), F.lit(1.0).alias("ratio"))
    return mentions.kg_candidates(links).select("hypothesis", "candidate", "total", "support", "rank")


@query("SELECT var, hint FROM (SELECT 'v' || CAST(n_regionkey AS STRING) || CAST(n_nationkey % 4 AS STRING) AS var, min(n_name) AS hint, count(DISTINCT n_name) AS n FROM nation GROUP BY 1) WHERE n = 1")
def seed_variables(p: Inputs) -> DataFrame:
    """SLT-01: variables that one hint fits."""
    return mentions.seeds(p.nation.select(F.concat(F.lit("v"), F.col("n_regionkey").cast("string"), (F.col("n_nationkey") % 4).cast("string")).alias("var"), F.col("n_name").alias("hint")))


@query(
    """SELECT slot_type, var_name, uid FROM (SELECT *, row_number() OVER (PARTITION BY slot_type, var_name ORDER BY reliability_score DESC, length(surface) DESC, uid) AS i FROM witnesses) WHERE i = 1""", ("witnesses",)
)
def collapsed_slots(p: Inputs) -> DataFrame:
    """SLT-08: the best piece per variable."""
    w = p.witnesses.select(F.col("slot_type").alias("slot_id"), F.col("var_name").alias("var"), F.col("uid").alias("piece_id"), F.col("reliability_score").alias("score"), "surface")
    return mentions.collapsed(w).select(F.col("slot_id").alias("slot_type"), F.col("var").alias("var_name"), F.col("piece_id").alias("uid"))


@query()
def extracted_mentions(p: Inputs) -> DataFrame:
    """STR-25: mentions by patterns, overlaps resolved; per category how many."""
    anchors = p.documents.select(F.col("doc_id").alias("anchor_id"), F.col("text").alias("raw_text"))
    return mentions.extract(anchors).groupBy("category").agg(F.count("*").alias("n"))


@query(
    """, q AS (SELECT c_custkey AS intent_id, CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 0 END AS e, CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS s, CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS v FROM customer),
       l AS (SELECT intent_id, 'entity_completeness' AS layer, greatest(0.0, round(1 - 3.0 * e / 6, 2)) AS score FROM q UNION ALL SELECT intent_id, 'slot_completeness', greatest(0.0, round(1 - 3.0 * s / 6, 2)) FROM q UNION ALL SELECT intent_id, 'graph_spec_correctness', greatest(0.0, round(1 - 3.0 * v / 6, 2)) FROM q
             UNION ALL SELECT intent_id, 'scope_correctness', 1.0 FROM q UNION ALL SELECT intent_id, 'retrieval_quality', 1.0 FROM q UNION ALL SELECT intent_id, 'internal_consistency', 1.0 FROM q),
       t AS (SELECT intent_id, round(sum(score * CASE layer WHEN 'entity_completeness' THEN 0.2 WHEN 'scope_correctness' THEN 0.12 WHEN 'retrieval_quality' THEN 0.18 WHEN 'slot_completeness' THEN 0.15 WHEN 'graph_spec_correctness' THEN 0.25 ELSE 0.1 END), 3) AS score FROM l GROUP BY 1)
       SELECT intent_id, CAST(score AS DOUBLE) AS score, CASE WHEN score >= 0.85 THEN 'PASS' WHEN score >= 0.6 THEN 'PARTIAL_PASS' ELSE 'FAIL' END AS verdict FROM t""".replace(", q AS", "WITH q AS", 1)
)
def intent_verdicts(p: Inputs) -> DataFrame:
    """AGG-29, INT-02, INT-03: issues, layer scores and verdicts of intents."""
    c, one = p.customer, lambda x: F.array(F.lit(x))
    none = F.array().cast("array<string>")
    k = F.col("c_custkey")
    intents = c.select(
        k.alias("intent_id"), one("Alpha").alias("entities"), F.when(k % 3 == 0, one("beta")).otherwise(one("alpha")).alias("hints"), F.when(k % 4 == 0, none).otherwise(one("WHO")).alias("slots"), one("WHO").alias("needed"),
        F.array(F.lit("a"), F.lit("b"), F.lit("c")).alias("terms"), F.when(k % 5 == 0, none).otherwise(one("P")).alias("vars"), none.alias("edges"), F.lit("EMAIL").alias("family"),
    )
    checks_ = c.select(k.alias("intent_id"), F.explode(F.array(*[F.lit(x) for x in intent.LAYERS])).alias("layer"), F.lit(2).alias("n"))
    return intent.verdicts(intent.layer_scores(intent.issues(intents), checks_))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS iso, CAST(year(o_orderdate) * 12 + month(o_orderdate) AS BIGINT) AS months, CASE WHEN year(o_orderdate) < 1996 THEN FALSE WHEN year(o_orderdate) > 1998 THEN FALSE ELSE TRUE END AS inside FROM orders")
def date_functions(p: Inputs) -> DataFrame:
    """DT-01, DT-02, DT-04, DT-05: dates written out and read again."""
    written = F.date_format("o_orderdate", "yyyy MMMM dd")
    iso = dates.normal(written)
    return p.orders.select("o_orderkey", iso.alias("iso"), dates.months(dates.parse_day(written)).alias("months"), dates.in_years(iso, F.lit(1996), F.lit(1998)).alias("inside"))


@query("SELECT p_partkey, lower(p_name) AS key, list_sort(string_split(p_name, ' ')) [1] AS first_token, CASE WHEN p_partkey % 2 = 0 THEN 1.0::DOUBLE ELSE round(1 / 3, 9) END AS likeness FROM part")
def name_functions(p: Inputs) -> DataFrame:
    """STR-04, STR-05, STR-07, STR-13: keys and likeness of names."""
    other = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(" zzz")))
    turned = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(", M.D."))
    return p.part.select("p_partkey", t.person_key(turned).alias("key"), F.get(t.token_key(F.concat(F.lit("The "), "p_name")), F.lit(0)).alias("first_token"), t.jaccard(t.tokens(F.col("p_name")), t.tokens(other)).alias("likeness"))


@query("SELECT s_suppkey, round(greatest(0, least(1, CASE s_suppkey % 4 WHEN 0 THEN 0.88 WHEN 1 THEN 0.76 WHEN 2 THEN 0.68 ELSE 0.70 END + CASE s_suppkey % 3 WHEN 0 THEN -0.05 WHEN 1 THEN 0.03 ELSE 0 END + CASE s_suppkey % 2 WHEN 0 THEN 0.02 ELSE -0.03 END)), 9) AS reliability FROM supplier")
def default_reliability(p: Inputs) -> DataFrame:
    """TRC-05."""
    k = F.col("s_suppkey")
    pick = lambda n, *xs: F.element_at(F.array(*map(F.lit, xs)), (k % n + 1).cast("int"))
    return p.supplier.select("s_suppkey", scores.default_reliability(pick(2, "document", "derived"), pick(4, "primary", "secondary", "tertiary", "other"), pick(3, "aggregation", "direct-capture", "manual")).alias("reliability"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'WHAT: EVIDENCE:  WHAT: WHAT: twice. ord' WHEN 1 THEN 'ord' ELSE 'In [sic] ord' END || lpad(CAST(o_orderkey % 1000 AS STRING), 4, '0') || ' it was so.' AS statement, 'ord' || lpad(CAST(o_orderkey % 1000 AS STRING), 4, '0') AS exhibits FROM orders"""
)
def exhibits(p: Inputs) -> DataFrame:
    """CON-03, STR-29: statements without slots and openings, and the document ids that they name."""
    k = F.col("o_orderkey") % 3
    opening = F.when(k == 0, "EVIDENCE: HOW: WHO: OUTCOME: WHAT: EVIDENCE:  WHAT: WHAT: twice. ord").when(k == 1, " WHEN: Responsibility chain: ord").otherwise("In [sic] ord")
    text = F.concat(opening, F.lpad((F.col("o_orderkey") % 1000).cast("string"), 4, "0"), F.lit(" it was so.  "))
    said = t.clean_statement(text)
    return p.orders.select("o_orderkey", said.alias("statement"), t.document_ids(said).alias("exhibits"))
