"""The evidence graph of a question, phase by phase, as two long tables: nodes (uid, label, kind, ref) and edges (src, dst, rel_type, graph).

Every phase is a projection or a join on keys; co-references and segments are linked in chains, not with each other, so there are no more edges
than rows.  Ids of nodes that the graph makes are name-based, so a second run makes the same ones.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.ids import uuid5
from quillgraph.operators.build import keep_first

NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "quillgraph/evidence-graph")
AGENT = "agent"
EVIDENCE, REASONING, BRIDGE = "evidence", "reasoning", "bridge"


def uid(*seed: str | Column) -> Column:
    return uuid5(NAMESPACE, F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in seed]))


def _nodes(df: DataFrame, key: str | Column, label: str, kind: str) -> DataFrame:
    return df.select((F.col(key) if isinstance(key, str) else key).cast("string").alias("uid"), F.lit(label).alias("label"), F.lit(kind).alias("kind"))


def _edges(df: DataFrame, src: str | Column, dst: str | Column, rel_type: str, graph: str = EVIDENCE) -> DataFrame:
    col = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    return df.select(col(src).alias("src"), col(dst).alias("dst"), F.lit(rel_type).alias("rel_type"), F.lit(graph).alias("graph")).where("src IS NOT NULL AND dst IS NOT NULL")


def linked(rows: DataFrame, group: Column, key: str, order: str) -> DataFrame:
    """a, b: each row of a group with the next one."""
    by = W.partitionBy("_g").orderBy(order, key)
    out = rows.withColumn("_g", group).where("_g IS NOT NULL AND _g <> ''").withColumn("b", F.lead(key).over(by))
    return out.where("b IS NOT NULL").select(F.col(key).alias("a"), "b")


def built(
    question: str, artifacts: DataFrame, anchors: DataFrame, mentions: DataFrame, witnesses: DataFrame, snapshots: DataFrame, frames: DataFrame, slots: DataFrame, relations: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one question.

    artifacts: artifact_id, collection; anchors: anchor_id, artifact_id; mentions: mention_id, anchor_id, surface, kg_id; witnesses: witness_id,
    slot_id, var_name, surface, anchor_id, mention_id, score; snapshots: kg_id; frames: frame_id, member_id (anchor, mention or snapshot);
    slots: slot_id, quality, confidence; relations: from_slot, to_slot.  Equal pieces of a slot are one witness, the one that scores best.
    """
    root, claims_root = uid("evidence::", question), uid("claims::", question)
    # Artifacts, anchors, mentions, witnesses, snapshots, frames.
    witnesses = keep_first(witnesses.withColumn("_hash", F.sha2(F.concat_ws("|", "slot_id", "var_name", F.lower(F.trim("surface")), "anchor_id"), 256)), ["_hash"], F.desc("score"), "witness_id").drop("_hash")
    node = F.concat(F.lit("snapshot::"), F.col("kg_id").cast("string"))
    members = frames.select("frame_id").distinct()
    evidence = [
        _nodes(artifacts, "artifact_id", "EvidenceNode", "artifact"), _nodes(anchors, "anchor_id", "EvidenceNode", "anchor"), _nodes(mentions, "mention_id", "EvidenceNode", "mention"), _nodes(witnesses, "witness_id", "EvidenceNode", "witness"),
        _nodes(snapshots, node, "EvidenceNode", "snapshot"), _nodes(members, "frame_id", "EvidenceNode", "frame"),
    ]
    found = keep_first(reduce(DataFrame.unionByName, evidence), ["uid"], "kind")
    derived = [
        _edges(anchors, "anchor_id", "artifact_id", "DERIVES_FROM"), _edges(mentions, "mention_id", "anchor_id", "DERIVES_FROM"), _edges(witnesses, "witness_id", "anchor_id", "DERIVES_FROM"), _edges(witnesses, "witness_id", "mention_id", "DERIVES_FROM"),
        _edges(frames, "frame_id", "member_id", "DERIVES_FROM"), _edges(mentions.where("kg_id IS NOT NULL").join(snapshots.select("kg_id"), "kg_id", "left_semi"), "mention_id", node, "DERIVES_FROM"),
    ]
    # Mentions of one entity, by its id or else its normal form; segments of one collection.
    same = F.coalesce(F.col("kg_id").cast("string"), F.nullif(t.phrase(F.col("surface")), F.lit("")))
    chained = [_edges(linked(mentions, same, "mention_id", "anchor_id"), "a", "b", "CORROBORATES"), _edges(linked(artifacts, F.col("collection"), "artifact_id", "artifact_id"), "a", "b", "IDENTICAL_TO")]
    # Claims of slots that have something to say, grounded by their witnesses; inferences between claims.
    claim = uid("claim::", F.col("slot_id"))
    held = slots.where(~((F.col("quality") == "AMBIGUOUS") & (F.coalesce("confidence", F.lit(0.0)) == 0))).withColumn("claim", claim)
    grounded = witnesses.join(held.select("slot_id", "claim"), "slot_id")
    steps = relations.join(held.select(F.col("slot_id").alias("from_slot"), F.col("claim").alias("premise")), "from_slot").join(held.select(F.col("slot_id").alias("to_slot"), F.col("claim").alias("conclusion")), "to_slot")
    steps = steps.withColumn("inference", uid("inference::", F.col("premise"), "::", F.col("conclusion")))
    reasoning = [_nodes(held, "claim", "Claim", "claim"), _nodes(steps, "inference", "Inference", "inference")]
    argued = [
        _edges(held, claims_root, "claim", "CONTAINS_CLAIM", REASONING), _edges(held, "claim", F.lit(AGENT), "ASSERTED_BY", REASONING), _edges(grounded, "claim", "witness_id", "GROUNDED_BY", BRIDGE), _edges(steps, claims_root, "inference", "CONTAINS_INFERENCE", REASONING),
        _edges(steps, "inference", "premise", "HAS_PREMISE", REASONING), _edges(steps, "inference", "conclusion", "HAS_CONCLUSION", REASONING), _edges(steps, "inference", F.lit(AGENT), "PERFORMED_BY", REASONING),
    ]
    # Completion: every evidence node is in the graph, has a maker, and a factor of its reliability.
    factor = uid("reliability::", F.col("uid"))
    whole = [_edges(found, root, "uid", "CONTAINS_NODE"), _edges(found, "uid", F.lit(AGENT), "CREATED_BY"), _edges(found, "uid", factor, "HAS_RELIABILITY_FACTOR")]
    one = artifacts.sparkSession.range(1)
    roots = [_nodes(one, root, "EvidenceGraph", "root"), _nodes(one, claims_root, "ReasoningGraph", "root"), _nodes(one, F.lit(AGENT), "Agent", "agent"), _nodes(found, factor, "ReliabilityFactor", "factor")]
    nodes = keep_first(reduce(DataFrame.unionByName, [found, *reasoning, *roots]), ["uid"], "label", "kind")
    edges = reduce(DataFrame.unionByName, [*derived, *chained, *argued, *whole]).distinct()
    # An edge whose end is no node is left out, as the phases that make them may not have run.
    ends = nodes.select("uid")
    return nodes, edges.join(ends.select(F.col("uid").alias("src")), "src", "left_semi").join(ends.select(F.col("uid").alias("dst")), "dst", "left_semi").select("src", "dst", "rel_type", "graph")
