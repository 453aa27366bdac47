"""Confidence of inferences and claims, synthesis, findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.build import keep_first

# Factors and weights of the rules.
UNDERCUTTING, CLUSTER_BASE, CLUSTER_STEP, CLUSTER_FLOOR, LEAST = 0.80, 0.60, 0.05, 0.40, 0.01
CONTESTED_ONE, CONTESTED_MORE, TWO_DOCUMENTS, THREE_DOCUMENTS = 0.70, 0.50, 0.05, 0.10
SLOT_WEIGHTS = {"WHAT": 2.0, "EVIDENCE": 1.5, "WHO": 1.0, "HOW": 1.0, "WHEN": 0.8}
ACCEPTANCE_FLOOR, TOP_CHAIN_WEIGHT = 0.50, 1.0
SENSITIVITY = {"STABLE": 0.20, "MARGINAL": 0.10, "SENSITIVE": 0.0}
SLOT_PAIRS = [("WHO", "WHAT"), ("WHO", "HOW"), ("WHAT", "EVIDENCE"), ("WHEN", "WHAT"), ("HOW", "EVIDENCE")]


def weakened(inferences: DataFrame, defeaters: DataFrame) -> DataFrame:
    """uid, confidence, updated, defeaters: the product of the penalties of an inference's defeaters (uid, type, cluster_size)."""
    penalty = F.when(F.col("type") == "rebutting", F.greatest(F.lit(CLUSTER_FLOOR), CLUSTER_BASE - (F.col("cluster_size") - 1) * CLUSTER_STEP)).otherwise(UNDERCUTTING)
    d = defeaters.groupBy("uid").agg(F.product(penalty).alias("factor"), F.count("*").alias("defeaters"))
    out = inferences.join(d, "uid", "left")
    return out.select("uid", "confidence", F.when(F.col("factor").isNull(), F.col("confidence")).otherwise(F.round(F.greatest(F.col("confidence") * F.col("factor"), F.lit(LEAST)).cast("decimal(18,12)"), 4).cast("double")).alias("updated"), F.coalesce("defeaters", F.lit(0)).alias("defeaters"))


def discounted(inferences: DataFrame, premises: DataFrame, contested: DataFrame) -> DataFrame:
    """uid, confidence, updated: inferences (uid, confidence) on contested claims; premises are (uid, claim_uid)."""
    n = premises.join(contested, "claim_uid", "left_semi").groupBy("uid").agg(F.count("*").alias("n"))
    out = inferences.join(n, "uid", "left")
    factor = F.when(F.col("n") == 1, CONTESTED_ONE).when(F.col("n") > 1, CONTESTED_MORE)
    return out.select("uid", "confidence", F.when(factor.isNull(), F.col("confidence")).otherwise(F.greatest(F.round(F.col("confidence") * factor, 4), F.lit(LEAST))).alias("updated"))


def corroborated(inferences: DataFrame, grounds: DataFrame) -> DataFrame:
    """uid, confidence, updated: inferences (uid, claim_uid, confidence) gain by the documents that ground their claim; grounds are (claim_uid, artifact_id)."""
    n = grounds.where("artifact_id <> ''").groupBy("claim_uid").agg(F.countDistinct("artifact_id").alias("docs"))
    out = inferences.join(n, "claim_uid", "left")
    boost = F.when(F.col("docs") >= 3, THREE_DOCUMENTS).when(F.col("docs") == 2, TWO_DOCUMENTS).otherwise(0.0)
    return out.select("uid", "confidence", F.when(boost > 0, F.round(F.least(F.col("confidence") + boost, F.lit(1.0)), 4)).otherwise(F.col("confidence")).alias("updated"))


def synthesis(claims: DataFrame, group: str) -> DataFrame:
    """group, confidence, kind: weighted mean over the slots that have a claim, each by its best; all five make it composite."""
    best = claims.where("slot IS NOT NULL").groupBy(group, "slot").agg(F.max("confidence").alias("c"))
    w = F.coalesce(*[F.when(F.col("slot") == s, F.lit(x)) for s, x in SLOT_WEIGHTS.items()], F.lit(1.0))
    out = best.groupBy(group).agg(F.sum(F.col("c") * w).alias("sum"), F.sum(w).alias("w"), F.count_if(F.col("slot").isin(list(SLOT_WEIGHTS))).alias("n"))
    return out.select(group, F.greatest(F.round(F.col("sum") / F.col("w"), 4), F.lit(LEAST)).alias("confidence"), F.when(F.col("n") == len(SLOT_WEIGHTS), "composite").otherwise("partial").alias("kind"))


def cross_slot(claims: DataFrame, group: str) -> DataFrame:
    """group, from_slot, to_slot, confidence: mean of the two best claims of slots that inform each other."""
    best = claims.groupBy(group, "slot").agg(F.max("confidence").alias("c"))
    rules = F.array(*[F.struct(F.lit(a).alias("from_slot"), F.lit(b).alias("to_slot")) for a, b in SLOT_PAIRS])
    a = best.withColumn("r", F.explode(rules)).where("slot = r.from_slot").select(group, "r.from_slot", "r.to_slot", F.col("c").alias("c1"))
    b = best.select(group, F.col("slot").alias("to_slot"), F.col("c").alias("c2"))
    return a.join(b, [group, "to_slot"]).select(group, "from_slot", "to_slot", ((F.col("c1") + F.col("c2")) / 2).alias("confidence"))


def claim_reliability(grounds: DataFrame, default: float = 0.5) -> DataFrame:
    """claim_uid, reliability: mean over its witnesses, of which one without a value counts as the default.

    Values are added up as decimals of nine digits, so that the mean does not depend on the order of rows.
    """
    value = F.coalesce(F.col("reliability").cast("double"), F.lit(default)).cast("decimal(18,9)")
    return grounds.groupBy("claim_uid").agg((F.sum(value).cast("double") / F.count("*")).alias("reliability"))


def trusted(claims: DataFrame, grounds: DataFrame, weight: float = TOP_CHAIN_WEIGHT, least: float = 0.80) -> DataFrame:
    """claim_uid, reliability, confidence: claims whose witnesses are reliable on average have their confidence times the weight, 1 at most."""
    out = claims.join(claim_reliability(grounds), "claim_uid", "left")
    raised = F.round(F.least(F.col("confidence") * weight, F.lit(1.0)), 4)
    return out.select("claim_uid", "reliability", F.when(F.col("reliability") >= least, raised).otherwise(F.col("confidence")).alias("confidence"))


def uncertainty(claims: DataFrame) -> DataFrame:
    """claim_uid, level: how uncertain a claim (status, n_witnesses, sensitivity of its first decision, null if none) is."""
    high = (F.col("status") == "contested") | F.coalesce(F.col("sensitivity") == "SENSITIVE", F.lit(False))
    medium = F.coalesce(F.col("sensitivity") == "MARGINAL", F.lit(False)) | (F.col("n_witnesses") == 1)
    return claims.select("claim_uid", F.when(high, "HIGH").when(medium, "MEDIUM").otherwise("LOW").alias("level"))


def sensitivity(inferences: DataFrame, floor: float = ACCEPTANCE_FLOOR) -> DataFrame:
    """uid, margin, band: how far a confidence is above the floor at which an answer is accepted."""
    margin = F.col("confidence") - floor
    band = F.coalesce(*[F.when(margin > least, F.lit(name)) for name, least in SENSITIVITY.items()], F.lit("BELOW_FLOOR"))
    # Rounded as binary numbers are, by their value in ten-thousandths: rounding their decimal text differs where they lie beside a half.
    return inferences.select("uid", (F.round(margin * 10_000) / 10_000).alias("margin"), band.alias("band"))


def tethered(statements: DataFrame, grounds: DataFrame, least: int = 1) -> DataFrame:
    """statement_id, n_witnesses, tethered."""
    n = grounds.groupBy("statement_id").agg(F.countDistinct("witness_uid").alias("n_witnesses"))
    out = statements.select("statement_id").join(n, "statement_id", "left").withColumn("n_witnesses", F.coalesce("n_witnesses", F.lit(0)))
    return out.withColumn("tethered", F.col("n_witnesses") >= least)


def output_candidates(rows: DataFrame) -> DataFrame:
    """One row per (slot, role, lower-case surface), the best by quality, confidence, rank and ids."""
    quality = F.when(F.col("quality") == "GROUNDED", 0).when(F.col("quality") == "INFERRED", 1).otherwise(2)
    return keep_first(rows.withColumn("_surface", F.lower(F.trim("surface"))), ["slot", "role", "_surface"], quality, F.desc("confidence"), "rank", "artifact_id", "anchor_id", "candidate_id").drop("_surface")


def chain_penalties(chains: DataFrame, conflicts: DataFrame) -> DataFrame:
    """chain_id, penalty, n: chains (chain_id, witness_uid) that hold both ends of a conflict; rebutting costs more."""
    a = chains.select("chain_id", F.col("witness_uid").alias("uid_a")).join(conflicts, "uid_a")
    both = a.join(chains.select("chain_id", F.col("witness_uid").alias("uid_b")), ["chain_id", "uid_b"])
    return both.groupBy("chain_id").agg(F.sum(F.when(F.col("defeater_type") == "rebutting", 0.10).otherwise(0.05)).alias("penalty"), F.count("*").alias("n"))


def status(claims: DataFrame) -> DataFrame:
    """claim_uid, status by the quality of its binding; ambiguous ones without confidence go."""
    s = F.when(F.col("quality") == "GROUNDED", "supported").when(F.col("quality") == "INFERRED", "weakly-supported").otherwise("proposed")
    return claims.where(~((F.col("quality") == "AMBIGUOUS") & (F.col("confidence") == 0))).select("claim_uid", s.alias("status"))
