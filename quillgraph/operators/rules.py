"""Rules over the evidence graph in three tiers: closure, elevation, degradation.  Later tiers win.

These rules are a specification of their own; the confidence rules of ``construct`` have other constants.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.build import union_all
from quillgraph.operators.graph import closure

TRANSITIVE = ["DERIVES_FROM", "PART_OF", "SUPERSEDES", "PRECEDES", "ENTAILS"]
SYMMETRIC = ["CONTRADICTS", "CORROBORATES", "IDENTICAL_TO"]
INVERSE = {"SUPPORTS": "SUPPORTED_BY", "CONTAINS": "PART_OF"}
#: A later status of this order replaces an earlier one.
PRECEDENCE = ["proposed", "weakly-supported", "supported", "undetermined", "contested", "superseded", "retracted"]


def closed(edges: DataFrame) -> DataFrame:
    """Edges with those that symmetry, inversion and transitivity add."""
    e = edges.select("src", "dst", "rel_type")
    turned = [e.where(F.col("rel_type").isin(SYMMETRIC)).select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")]
    turned += [e.where(F.col("rel_type") == a).select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(b).alias("rel_type")) for a, b in INVERSE.items()]
    base = union_all([e, *turned]).distinct()
    every = [base] + [closure(base.where(F.col("rel_type") == r)).withColumn("rel_type", F.lit(r)) for r in TRANSITIVE]
    return union_all(every).distinct()


def symmetric(edges: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Edges of symmetric types in both directions."""
    e = edges.where(F.col("rel_type").isin(types or SYMMETRIC)).select("src", "dst", "rel_type")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type")).distinct()


def inherited(nodes: DataFrame, edges: DataFrame, rel_type: str, attribute: str) -> DataFrame:
    """uid, attribute: a node without the attribute takes the smallest that its targets have."""
    have = nodes.where(F.col(attribute).isNotNull()).select(F.col("uid").alias("dst"), F.col(attribute).alias("_v"))
    given = edges.where(F.col("rel_type") == rel_type).join(have, "dst").groupBy(F.col("src").alias("uid")).agg(F.min("_v").alias("_v"))
    return nodes.join(given, "uid", "left").select("uid", F.coalesce(attribute, "_v").alias(attribute))


def elevated(evidence: DataFrame, edges: DataFrame) -> DataFrame:
    """uid, reliability: .1 more, once, for evidence that two or more others corroborate."""
    c = edges.where("rel_type = 'CORROBORATES'")
    n = c.select("src", "dst").unionByName(c.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct().groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n"))
    out = evidence.join(n, "uid", "left")
    return out.select("uid", F.when(F.col("n") >= 2, F.least(F.lit(1.0), F.col("reliability") + 0.1)).otherwise(F.col("reliability")).alias("reliability"))


def supported(claims: DataFrame, inferences: DataFrame, premises: DataFrame, defeaters: DataFrame) -> DataFrame:
    """claim_uid, status: supported if an inference of .7 or more concludes it, all its premises hold and no defeater attacks it."""
    weak = premises.join(claims.where(F.col("status").isin("contested", "retracted", "superseded")).select("claim_uid"), "claim_uid", "left_semi").select("uid").distinct()
    good = inferences.where("confidence >= 0.7").join(weak, "uid", "left_anti").join(defeaters.select("uid").distinct(), "uid", "left_anti").select(F.col("conclusion").alias("claim_uid"), F.lit(True).alias("_ok")).distinct()
    out = claims.join(good, "claim_uid", "left")
    return out.select("claim_uid", F.when(F.coalesce("_ok", F.lit(False)) & F.col("status").isin("proposed", "weakly-supported"), "supported").otherwise(F.col("status")).alias("status"))


def degraded(claims: DataFrame, inferences: DataFrame, defeaters: DataFrame) -> DataFrame:
    """claim_uid, status, confidence: a rebutting defeater of an inference contests its conclusion; an undercutting one halves the confidence and weakens it."""
    hit = inferences.join(defeaters, "uid").groupBy(F.col("conclusion").alias("claim_uid")).agg(F.bool_or(F.col("type") == "rebutting").alias("rebutted"), F.count_if(F.col("type") == "undercutting").alias("cuts"))
    out = claims.join(hit, "claim_uid", "left")
    status = F.when(F.col("status").isin("retracted", "superseded"), F.col("status")).when(F.col("rebutted"), "contested").when(F.col("cuts") > 0, "weakly-supported").otherwise(F.col("status"))
    return out.select("claim_uid", status.alias("status"), (F.col("confidence") * F.pow(F.lit(0.5), F.coalesce("cuts", F.lit(0)))).alias("confidence"))
