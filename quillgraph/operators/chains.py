"""Slot candidates, evidence chains and their scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scores
from quillgraph.operators.build import keep_first
from quillgraph.operators.graph import numbered

# Weights of a chain's parts, and the cap of chains that leave required slots open.
WEIGHTS = {"slot_coverage": 0.2, "witness_complete": 0.15, "source_diversity": 0.05, "temporal_consistency": 0.1, "mapping_support": 0.05, "evidence_confidence": 0.2, "source_score": 0.05, "question_relevance": 0.2}
OPEN_CAP = 0.1999
SLOT_ORDER = ["WHAT", "WHO", "WHEN", "HOW", "WHY", "OUTCOME", "EVIDENCE"]


def ranked_candidates(candidates: DataFrame) -> DataFrame:
    """Candidates with score within 0 and 1 and rank within their slot."""
    return candidates.withColumn("score", scores.ratio01(F.col("score"))).withColumn("rank", F.row_number().over(W.partitionBy("slot_id").orderBy(F.desc("score"), "candidate_id")))


def evidence_confidence(members: DataFrame, group: str) -> DataFrame:
    """group, evidence_confidence: mean over slot types of the best score."""
    return members.groupBy(group, "slot_type").agg(F.max("score").alias("best")).groupBy(group).agg(F.avg("best").alias("evidence_confidence"))


def answerability(members: DataFrame, group: str, required: list[str]) -> DataFrame:
    """group, present, missing (of the required slot types, sorted), answerable."""
    want = F.array(*map(F.lit, required))
    have = members.groupBy(group).agg(F.collect_set("slot_type").alias("have"))
    out = have.select(group, F.array_sort(F.array_intersect(want, "have")).alias("present"), F.array_sort(F.array_except(want, "have")).alias("missing"))
    return out.withColumn("answerable", F.size("missing") == 0)


def chains(members: DataFrame, mappings: DataFrame, slot_types: int, artifacts: int, required: list[str], relevance: Column | None = None) -> DataFrame:
    """chain_id, parts of the score, score, answerable, rank: members are (chain_id, source_score, temporal, candidate_id, slot_type, artifact_id, witness_id, score)."""
    inside = mappings.join(members.select("chain_id", F.col("candidate_id").alias("source")), "source").join(members.select("chain_id", F.col("candidate_id").alias("target")), ["chain_id", "target"])
    supported = inside.groupBy("chain_id").agg(F.count("*").alias("n_maps"))
    g = members.groupBy("chain_id").agg(
        F.count("*").alias("n"), F.countDistinct("slot_type").alias("n_slots"), F.countDistinct("artifact_id").alias("n_artifacts"), F.bool_and(F.coalesce("witness_id", F.lit("")) != "").alias("complete"),
        F.bool_and("temporal").alias("temporal"), F.max("source_score").alias("source_score"), F.sort_array(F.collect_set("candidate_id")).alias("candidates"), (F.max(relevance) if relevance is not None else F.lit(1.0)).alias("question_relevance"),
    )
    g = g.join(supported, "chain_id", "left").join(evidence_confidence(members, "chain_id"), "chain_id").join(answerability(members, "chain_id", required), "chain_id")
    g = g.withColumns({
        "slot_coverage": F.col("n_slots") / max(1, slot_types), "witness_complete": F.col("complete").cast("double"), "source_diversity": F.col("n_artifacts") / max(1, artifacts),
        "temporal_consistency": F.col("temporal").cast("double"), "mapping_support": F.least(F.lit(1.0), F.coalesce("n_maps", F.lit(0)) / F.col("n")), "source_score": scores.ratio01(F.col("source_score")),
    })
    score = sum((w * F.col(c) for c, w in WEIGHTS.items()), F.lit(0.0))
    score = F.when(~F.col("answerable"), F.least(score, F.lit(OPEN_CAP))).otherwise(score) if required else score
    # One chain per set of candidates, the best; then all in order.
    best = keep_first(g.withColumn("score", score), ["candidates"], F.desc("score"), F.desc("chain_id"))
    return numbered(best, "rank", F.desc("score"), "chain_id").select("chain_id", *WEIGHTS, "score", "answerable", "missing", "rank")


def repair(candidates: DataFrame, required: list[str]) -> DataFrame:
    """The best candidate of each required slot type: a chain for when none answers."""
    return keep_first(candidates.where(F.col("slot_type").isin(required)), ["slot_type"], F.desc("score"), "candidate_id")


def supplement(candidates: DataFrame, slot: str, taken: DataFrame, most: int = 3) -> DataFrame:
    """Up to ``most`` further candidates of a slot that no chain has taken, by priority, score and id."""
    left = candidates.where(F.col("slot_type") == slot).join(taken.select("candidate_id"), "candidate_id", "left_anti")
    return left.withColumn("rank", F.row_number().over(W.partitionBy("slot_type").orderBy("priority", F.desc("score"), "candidate_id"))).where(F.col("rank") <= most)


def membership(candidates: DataFrame, chain_mentions: DataFrame, chain_anchors: DataFrame) -> DataFrame:
    """chain_id, candidate_id, by: candidates that a chain names by mention, else by anchor; never by artifact alone."""
    m = candidates.join(chain_mentions, "mention_id").select("chain_id", "candidate_id", F.lit("mention").alias("by"))
    a = candidates.join(chain_anchors, "anchor_id").select("chain_id", "candidate_id").join(m.select("chain_id", "candidate_id"), ["chain_id", "candidate_id"], "left_anti").withColumn("by", F.lit("anchor"))
    return m.unionByName(a).distinct()


def effective(ranked: DataFrame, penalties: DataFrame) -> DataFrame:
    """The chain whose score less its penalties is largest, ties to rank and id."""
    out = ranked.join(penalties.groupBy("chain_id").agg(F.sum("penalty").alias("penalty")), "chain_id", "left").withColumn("effective", F.greatest(F.lit(0.0), F.col("score") - F.coalesce("penalty", F.lit(0.0))))
    return out.orderBy(F.desc("effective"), "rank", "chain_id").limit(1).select("chain_id", "score", "effective", "rank")


def slot_confidence(witnesses: DataFrame, pieces: DataFrame, slot: str = "slot_id") -> DataFrame:
    """slot, confidence, quality: .35 mean mention, .25 quality, .15 support, .15 share of the most frequent variable, .10 further artifacts."""
    w = witnesses.groupBy(slot).agg(
        F.avg(scores.quality_weight(F.col("quality"))).alias("q"), F.count("*").alias("n"), F.countDistinct(F.nullif("artifact_id", F.lit(""))).alias("arts"),
        F.bool_and(F.col("quality") == "GROUNDED").alias("every"), F.bool_or(F.col("quality") == "GROUNDED").alias("any"),
    )
    vars_ = pieces.groupBy(slot, "var").agg(F.count("*").alias("n_var"))
    p = pieces.groupBy(slot).agg(F.avg(F.coalesce("confidence", F.lit(0.0))).alias("m"), F.count("*").alias("n_pieces"))
    p = p.join(vars_.where("var <> ''").groupBy(slot).agg(F.max("n_var").alias("modal")), slot, "left")
    out = w.join(p, slot, "left")
    score = 0.35 * F.coalesce("m", F.lit(0.0)) + 0.25 * F.col("q") + 0.15 * F.least(F.lit(1.0), F.col("n") / 3.0) + 0.15 * F.coalesce(F.col("modal") / F.col("n_pieces"), F.lit(0.0)) + 0.10 * F.least(F.lit(1.0), F.greatest(F.lit(0), F.col("arts") - 1) / 2.0)
    return out.select(slot, scores.clamp01(score).alias("confidence"), F.when(F.col("every"), "GROUNDED").when(F.col("any"), "INFERRED").otherwise("AMBIGUOUS").alias("quality"))


def sequence(rows: DataFrame, group: str, ts: str, key: str) -> DataFrame:
    """Rows of a group numbered in order, their times never falling."""
    by = W.partitionBy(group).orderBy(ts, key)
    return rows.select(group, key, F.row_number().over(by).alias("seq"), F.max(ts).over(by.rowsBetween(W.unboundedPreceding, W.currentRow)).alias("ts"))
