"""Evidence nodes: what can be inferred about them, the pages and mentions they come from, findings and their limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scores
from quillgraph.functions import text as t
from quillgraph.operators.graph import numbered

# Words that mark how a text may be handled, in the order in which they are tried.
ACCESS = {"confidential": ["attorney-client", "privileged", "confidential"], "restricted": ["restricted", "do not distribute", "sensitive"], "public": ["public", "press release", "published"]}
HANDLING = {
    "public": "Standard handling permitted.", "internal": "Internal use only.", "restricted": "Restricted distribution; share on a need-to-know basis.",
    "confidential": "Confidential handling required; do not redistribute without approval.",
}
# Actions and the words in a step's label that name them, in the order in which they are tried.
ACTIONS = [
    ("collected", "identified documented surfaced extracted detected found discovered observed reported noted recorded gathered"),
    ("linked", "bound linked associated connected mapped matched resolved correlated"),
    ("verified", "verified confirmed validated corroborated"),
    ("reviewed", "reviewed examined assessed evaluated analyzed analysed inspected"),
    ("created", "created generated produced initiated authored"),
    ("transferred", "prescribed administered transferred moved sent submitted delivered forwarded"),
    ("modified", "modified updated changed amended revised edited"),
    ("archived", "filed archived stored catalogued"),
    ("redacted", "redacted removed censored obscured"),
    ("restored", "restored recovered reinstated"),
    ("retracted", "retracted withdrawn revoked"),
    ("superseded", "superseded replaced overridden deprecated"),
]
#: Transformations that lose something.
LOSSY = ["OMISSION", "QUALIFIER_DROP", "HEDGE_DROP"]


def action(label: Column) -> Column:
    """Action that a step's label names: that of the first word that stands in it, collected if none does."""
    low = F.lower(t.blank(label))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(a)) for a, words in ACTIONS for w in words.split()], F.lit("collected"))


def source_category(domain: Column) -> Column:
    low = F.lower(t.blank(domain))
    return F.when(F.contains(low, F.lit("snapshot")), "tertiary").when(F.contains(low, F.lit("witness")), "secondary").otherwise("primary")


def method(kind: Column, domain: Column) -> Column:
    k, d = F.lower(t.blank(kind)), F.lower(t.blank(domain))
    return (
        F.when(k == "artifact", "direct-capture").when(F.contains(d, F.lit("framewitness")) | (k == "derived"), "aggregation").when(F.contains(d, F.lit("snapshot")) | (k == "record"), "transformation")
        .when(k.isin("document", "observation", "testimony", "correspondence"), "extraction").otherwise("unknown")
    )


def access_level(text: Column) -> Column:
    low = F.lower(t.blank(text))
    return F.coalesce(*[F.when(F.contains(low, F.lit(w)), F.lit(level)) for level, words in ACCESS.items() for w in words], F.lit("internal"))


def temporal_precision(value: Column) -> Column:
    v = F.trim(t.blank(value))
    vague = F.lower(v).rlike("circa|approx|around")
    return F.when(v == "", "unknown").when(v.rlike(r"^\d{4}$"), "year").when(v.rlike(r"^\d{4}-\d{2}$"), "month").when(v.rlike(r"^\d{4}-\d{2}-\d{2}$"), "day").when(F.contains(v, F.lit("T")), "exact").when(vague, "approximate").otherwise("unknown")


def enriched(nodes: DataFrame) -> DataFrame:
    """Nodes (uid, type, domain_type, collection, label, description, content, source_reference, starts, reliability) with what is missing inferred."""
    kind, domain = F.coalesce("type", F.lit("Other")), t.blank(F.col("domain_type"))
    out = nodes.withColumns({"source_category": source_category(domain), "method": method(kind, domain), "content": F.coalesce(F.nullif("content", F.lit("")), F.nullif("description", F.lit("")), F.nullif("label", F.lit("")), "uid")})
    origin = F.when(F.col("source_category") == "tertiary", "KG0").when(t.blank(F.col("collection")) != "", F.concat(F.lit("ALIGN::"), "collection")).when(F.contains(F.lower(domain), F.lit("framewitness")), "TRACE::FrameAggregation").otherwise("ALIGN::LocalCorpus")
    media = F.when((F.lower(kind) == "record") | F.contains(F.lower(domain), F.lit("snapshot")), "application/json").when(F.lower(kind).isin("artifact", "media"), "application/octet-stream").otherwise("text/plain")
    level = access_level(F.concat_ws(" ", F.nullif("label", F.lit("")), F.nullif("description", F.lit("")), "content"))
    ref = F.trim(F.coalesce(F.nullif("source_reference", F.lit("")), "uid"))
    uri = F.when(F.contains(ref, F.lit("://")) | ref.rlike("^[/.]") | F.contains(ref, F.lit("::")), ref).otherwise(F.concat(F.lit("trace://evidence/"), "uid"))
    hint = F.lower(F.element_at(F.split(domain, "::"), -1))
    out = out.withColumns({"origin": origin, "media_type": media, "access_level": level, "uri": uri, "content_size": F.octet_length("content"), "precision": temporal_precision(F.col("starts"))})
    out = out.withColumns({
        "handling": F.coalesce(*[F.when(F.col("access_level") == k, F.lit(v)) for k, v in HANDLING.items()]), "reliability": scores.clamp01(F.coalesce(F.col("reliability").cast("double"), scores.default_reliability(kind, F.col("source_category"), F.col("method")))),
        "tags": F.array_distinct(F.array_compact(F.array(F.lit("trace"), F.lower(kind), F.nullif(hint, F.lit(""))))),
    })
    return out


def page_mentions(documents: DataFrame, pages: DataFrame, mentions: DataFrame) -> DataFrame:
    """document_id, page_id, mentions (by id): every page of the documents, those without mentions too; documents without pages have one row."""
    held = mentions.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("mention_id", "surface"))).alias("mentions"))
    out = documents.select("document_id").join(pages.select("document_id", "page_id"), "document_id", "left").join(held, "page_id", "left")
    return out.select("document_id", "page_id", F.coalesce("mentions", F.array().cast("array<struct<mention_id: string, surface: string>>")).alias("mentions"))


def top_anchors(anchors: DataFrame, k: int = 20) -> DataFrame:
    """The k anchors of each artifact with the highest relevance, ties by address."""
    return anchors.withColumn("rank", F.row_number().over(W.partitionBy("artifact_id").orderBy(F.desc("relevance"), "address"))).where(F.col("rank") <= k)


def findings(candidates: DataFrame, selected: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Findings of candidates (candidate_id, slot_type, surface, confidence, quality, object_id, position) in their order, and what they cite.

    ``selected``: candidate_id of the chain's own; ``conflicts``: edge_id of what applies to the chain, a short list.
    """
    out = numbered(candidates.join(selected.select("candidate_id", F.lit(True).alias("_own")), "candidate_id", "left"), "place", "position", "candidate_id")
    edges = conflicts.where("edge_id <> ''").agg(F.array_sort(F.collect_set("edge_id")).alias("conflict_edge_ids"))
    own = F.coalesce("_own", F.lit(False))
    out = out.withColumns({
        "display_id": F.concat(F.lit("F"), F.col("place").cast("string")), "evidence_strength": F.round(F.coalesce("confidence", F.lit(0.0)), 4), "selected_chain_member": own, "grounded": F.col("quality") == "GROUNDED",
        "candidate_scope": F.when(own, "selected_chain").otherwise("expanded_grounded_slot_candidate"), "sentence_index": F.col("place") - 1, "cited_objects": F.filter(F.array("object_id"), lambda x: F.trim(t.blank(x)) != ""),
    })
    return out.join(F.broadcast(edges)).drop("_own")  # one row


def limitations(chains: DataFrame, mappings: DataFrame, conflicts: DataFrame) -> DataFrame:
    """chain_id, kind, source_id: what limits chains (chain_id, mapping_ids, witness_complete): lossy mappings, conflicts (chain_id, edge_id), missing witnesses."""
    lossy = chains.select("chain_id", F.explode("mapping_ids").alias("mapping_id")).join(mappings.where(F.col("label").isin(LOSSY)).select("mapping_id"), "mapping_id")
    out = lossy.select("chain_id", F.lit("EXTRACTION_UNCERTAINTY").alias("kind"), F.col("mapping_id").alias("source_id"))
    out = out.unionByName(conflicts.where("edge_id <> ''").join(chains.select("chain_id"), "chain_id", "left_semi").select("chain_id", F.lit("CONFLICT_DERIVED").alias("kind"), F.col("edge_id").alias("source_id")))
    return out.unionByName(chains.where(~F.coalesce("witness_complete", F.lit(False))).select("chain_id", F.lit("UNTETHERED_CLAIM").alias("kind"), F.col("chain_id").alias("source_id")))


def required_terms(hints: DataFrame, least: float = 0.9) -> DataFrame:
    """intent_id, terms: surfaces and normal forms of organisations and persons named with enough confidence; lower-case, each once, in order."""
    kept = hints.where(F.col("category").isin("ENTITY_ORGANIZATION", "ENTITY_PERSON") & (F.coalesce("confidence", F.lit(0.0)) >= least))
    listed = kept.groupBy("intent_id").agg(F.array_sort(F.collect_list(F.struct("position", "surface", "normalized"))).alias("x"))
    return listed.select("intent_id", t.lower_unique(F.flatten(F.transform("x", lambda h: F.array(h["surface"], h["normalized"])))).alias("terms"))


def manifest(witnesses: DataFrame, invocations: DataFrame) -> DataFrame:
    """run_id, n_invocations, operators, artifacts, n_witnesses: what a run's provenance rests on."""
    i = invocations.groupBy("run_id").agg(F.count("*").alias("n_invocations"), F.array_sort(F.collect_set("operator")).alias("operators"))
    w = witnesses.groupBy("run_id").agg(F.array_sort(F.collect_set("artifact_id")).alias("artifacts"), F.countDistinct("witness_id").alias("n_witnesses"))
    return i.join(w, "run_id", "left").select("run_id", "n_invocations", "operators", F.coalesce("artifacts", F.array().cast("array<string>")).alias("artifacts"), F.coalesce("n_witnesses", F.lit(0)).alias("n_witnesses"))
