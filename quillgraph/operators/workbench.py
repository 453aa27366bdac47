"""What a reviewer sees of a run: filters, badges, conflicts with the candidates, mappings and chains they concern."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators.build import keep_first
from quillgraph.operators.runlog import relation_kind

#: Words in a slot's description by which it takes more than one answer, and slots that always do.
SEVERAL = r"\b(?:employees|people|persons|actors|leaders|companies|documents|records|examples|sources)\b"
SEVERAL_SLOTS = ["WHO", "EVIDENCE"]
WEAK = 0.55


def attributed(conflicts: DataFrame, candidates: DataFrame, mappings: DataFrame, members: DataFrame, chain_mappings: DataFrame) -> DataFrame:
    """Conflicts (edge_id, a, b) with source and target candidate, mapping_id and chain_ids; empty where there is none.

    ``candidates``: candidate_id, object_id, seq (the last of an object counts); ``mappings``: mapping_id, seq and both ends as objects and as
    candidates (the first that joins the same two counts); chains hold candidates (``members``) and mappings (``chain_mappings``).
    """
    of = keep_first(candidates.where("object_id <> ''"), ["object_id"], F.desc("seq")).select("object_id", "candidate_id")
    side = lambda c, name: of.select(F.col("object_id").alias(c), F.col("candidate_id").alias(name))
    out = conflicts.join(side("a", "source_candidate_id"), "a", "left").join(side("b", "target_candidate_id"), "b", "left")
    low, high = lambda x, y: F.least(x, y), lambda x, y: F.greatest(x, y)
    by_object = mappings.where("source_object_id <> '' AND target_object_id <> ''").select(low("source_object_id", "target_object_id").alias("x"), high("source_object_id", "target_object_id").alias("y"), "mapping_id", "seq")
    by_candidate = mappings.where("source_candidate_id <> '' AND target_candidate_id <> ''").select(low("source_candidate_id", "target_candidate_id").alias("x"), high("source_candidate_id", "target_candidate_id").alias("y"), "mapping_id", "seq")
    met = out.select("edge_id", low("a", "b").alias("x"), high("a", "b").alias("y")).join(by_object, ["x", "y"]).unionByName(
        out.where("source_candidate_id IS NOT NULL AND target_candidate_id IS NOT NULL").select("edge_id", low("source_candidate_id", "target_candidate_id").alias("x"), high("source_candidate_id", "target_candidate_id").alias("y")).join(by_candidate, ["x", "y"])
    )
    out = out.join(keep_first(met, ["edge_id"], "seq").select("edge_id", "mapping_id"), "edge_id", "left")
    both = out.where("source_candidate_id <> target_candidate_id").select("edge_id", "source_candidate_id", "target_candidate_id").join(members.select(F.col("candidate_id").alias("source_candidate_id"), "chain_id").distinct(), "source_candidate_id")
    both = both.join(members.select(F.col("candidate_id").alias("target_candidate_id"), "chain_id").distinct(), ["target_candidate_id", "chain_id"]).select("edge_id", "chain_id")
    mapped = out.where("mapping_id <> ''").select("edge_id", "mapping_id").join(chain_mappings.select("mapping_id", "chain_id").distinct(), "mapping_id").select("edge_id", "chain_id")
    held = both.unionByName(mapped).where("chain_id <> ''").groupBy("edge_id").agg(F.array_sort(F.collect_set("chain_id")).alias("chain_ids"))
    out = out.join(held, "edge_id", "left")
    return out.select(*conflicts.columns, *[t.blank(F.col(c)).alias(c) for c in ("source_candidate_id", "target_candidate_id", "mapping_id")], F.coalesce("chain_ids", F.array().cast("array<string>")).alias("chain_ids"))


def fused(conflicts: DataFrame, candidates: DataFrame, claims: DataFrame) -> DataFrame:
    """Conflicts (edge_id, rule, stance, relationship, claim_a, claim_b, source_candidate_id, target_candidate_id) with status and label.

    ``candidates``: candidate_id, slot_id, slot_type, surface, claim_uid; ``claims``: claim_uid, slot_type, description.  A claim that the edge does
    not name is that of the candidate.
    """
    side = lambda x, key: candidates.select(F.col("candidate_id").alias(key), *[F.col(c).alias(f"{x}_{c}") for c in ("slot_id", "slot_type", "surface", "claim_uid")])
    out = conflicts.join(side("s", "source_candidate_id"), "source_candidate_id", "left").join(side("t", "target_candidate_id"), "target_candidate_id", "left")
    for x, own in (("s", "claim_a"), ("t", "claim_b")):
        claim = claims.select(F.col("claim_uid").alias(f"_{x}"), F.col("slot_type").alias(f"{x}_claim_slot"), F.col("description").alias(f"{x}_claim_text"))
        out = out.join(claim, F.coalesce(F.nullif(own, F.lit("")), f"{x}_claim_uid") == F.col(f"_{x}"), "left").drop(f"_{x}")
    several = F.lit(False)
    for x in ("s", "t"):
        slot = F.coalesce(F.nullif(f"{x}_slot_type", F.lit("")), f"{x}_claim_slot", F.lit(""))
        several = several | slot.isin(SEVERAL_SLOTS) | F.lower(t.blank(F.col(f"{x}_claim_text"))).rlike(SEVERAL)
    same_claim = (t.blank(F.col("claim_a")) != "") & (F.col("claim_a") == F.col("claim_b"))
    same_slot = F.coalesce((F.col("s_slot_id") != "") & (F.col("s_slot_id") == F.col("t_slot_id")), F.lit(False))
    surface = F.col("rule") == "SURFACE_MISMATCH"
    named = t.blank(F.col("relationship")) != ""
    status = F.when(named, "semantic").when(surface & several & same_slot, "plurality").when(surface, "diagnostic").otherwise("unresolved")
    label = (
        F.when(named, F.col("relationship")).when(surface & several & same_slot, "Multiple candidate bindings / role distinction").when(surface & (F.coalesce(same_claim, F.lit(False)) | same_slot), "Alternative bindings for same claim/slot")
        .when(surface, "Surface mismatch").otherwise(F.coalesce(F.nullif("stance", F.lit("")), F.lit("Claim relationship under review")))
    )
    return out.select("edge_id", status.alias("status"), label.alias("label"), F.col("s_surface").alias("source_surface"), F.col("t_surface").alias("target_surface"))


def citation_health(answer: Column, citations: Column) -> Column:
    """Struct (total, placed, unplaced, unresolved): citations (array of struct<text, objects>) whose sentences stand in the answer one after the other.

    A sentence is looked for behind the last one that was found, so this is a fold over the citations of one answer.
    """
    low = F.lower(t.blank(answer))

    def step(acc: Column, c: Column) -> Column:
        said = F.lower(F.trim(t.blank(c["text"])))
        at = F.when(said == "", 0).otherwise(F.call_function("locate", said, low, acc["cursor"] + 1))
        return F.struct(F.when(at > 0, at - 1 + F.length(said)).otherwise(acc["cursor"]).alias("cursor"), (acc["placed"] + (at > 0).cast("int")).alias("placed"))

    total = F.size(citations)
    placed = F.aggregate(citations, F.struct(F.lit(0).alias("cursor"), F.lit(0).alias("placed")), step)["placed"]
    return F.struct(total.alias("total"), placed.alias("placed"), F.greatest(F.lit(0), total - placed).alias("unplaced"), F.size(F.filter(citations, lambda c: F.coalesce(F.size(c["objects"]), F.lit(0)) == 0)).alias("unresolved"))


def view_badges(runs: DataFrame) -> DataFrame:
    """run_id, view, count, attention out of one row of numbers per run (health: struct of ``citation_health``)."""
    h = F.col("health")
    none = F.lit(None).cast("int")
    rows = [
        ("overview", none, F.col("warnings") + h["unplaced"] + F.col("unresolved_conflicts")), ("answer", h["total"], h["unplaced"] + h["unresolved"] + F.col("warnings")),
        ("explain", F.col("tethers"), F.col("uncertainties") + F.col("tether_failures")), ("align", F.col("witnesses"), F.col("empty_slots")), ("trace", F.col("chains"), F.col("incomplete_chains")),
        ("findings", F.col("findings"), F.col("weak_findings") + F.col("finding_conflicts")), ("conflicts", F.col("conflicts"), F.when(F.col("unresolved_conflicts") > 0, F.col("unresolved_conflicts")).otherwise(F.col("conflicts"))), ("graphs", F.col("nodes"), F.lit(0)),
    ]
    packed = F.array(*[F.struct(F.lit(v).alias("view"), n.cast("long").alias("count"), a.cast("long").alias("attention")) for v, n, a in rows])
    return runs.select("run_id", F.explode(packed).alias("x")).select("run_id", "x.*")


def _holds(query: str, *columns: str) -> Column:
    return F.contains(F.lower(F.concat_ws(" ", *[F.nullif(F.col(c).cast("string"), F.lit("")) for c in columns])), F.lit(query.strip().lower())) if query.strip() else F.lit(True)


def slots_shown(slots: DataFrame, query: str = "", slot_type: str = "ALL", quality: str = "ALL", least: float = 0.0, texts: tuple[str, ...] = ("slot_id", "slot_type", "quality", "description")) -> DataFrame:
    is_ = lambda c, v: F.lit(True) if v.upper() == "ALL" else F.upper(t.blank(F.col(c))) == v.upper()
    return slots.where(is_("slot_type", slot_type) & is_("quality", quality) & (F.coalesce("confidence", F.lit(0.0)) >= least) & _holds(query, *texts))


def chains_shown(chains: DataFrame, shown: str = "all", sort: str = "rank") -> DataFrame:
    complete = F.coalesce("witness_complete", F.lit(False))
    order = {"score": F.desc(F.coalesce("score", F.lit(-1.0))), "coverage": F.desc(F.coalesce("slot_coverage", F.lit(0.0)))}.get(sort, F.coalesce("rank", F.lit(0)))
    return chains.where(complete if shown == "complete" else ~complete if shown == "incomplete" else F.lit(True)).orderBy(order, "chain_id")


def conflicts_shown(conflicts: DataFrame, reviews: DataFrame, review: str = "ALL", relation: str = "all", sort: str = "confidence", query: str = "") -> DataFrame:
    """Conflicts (edge_id, rule, stance, relationship, description, confidence) with review label, filtered and sorted; not reviewed is UNRESOLVED."""
    out = conflicts.join(reviews.select("edge_id", F.col("label").alias("review_label")), "edge_id", "left").withColumn("review_label", F.coalesce("review_label", F.lit("UNRESOLVED")))
    out = out.withColumn("_semantic", relation_kind(F.col("rule"), F.col("stance"), F.col("relationship"))["is_semantic"])
    wanted = F.col("_semantic") if relation == "semantic" else ~F.col("_semantic") if relation == "diagnostic" else F.lit(True)
    out = out.where(wanted & (F.lit(True) if review == "ALL" else F.col("review_label") == review) & _holds(query, "edge_id", "stance", "rule", "description"))
    return out.orderBy("review_label" if sort == "review" else F.desc(F.coalesce("confidence", F.lit(0.0))), "edge_id").drop("_semantic")


def resolved_filters(common: DataFrame, supported: DataFrame, app: DataFrame, groups: DataFrame, selected: list[str]) -> DataFrame:
    """group_id, filter_id, label, kind, coverage, collections: filters that an application includes and any selected collection supports.

    The first selected collection that supports a filter names it, else the common table does; it covers all if every selected one supports it.
    """
    order = F.array_position(F.array(*map(F.lit, selected)), F.col("collection_id"))
    held = supported.where(F.col("collection_id").isin(selected)).withColumn("_o", order)
    first = held.groupBy("filter_id").agg(F.min_by("label", "_o").alias("_label"), F.min_by("kind", "_o").alias("_kind"), F.transform(F.array_sort(F.collect_set(F.struct("_o", "collection_id"))), lambda x: x["collection_id"]).alias("collections"))
    out = app.where("included").select("filter_id").join(first, "filter_id").join(common.select("filter_id", F.col("label").alias("_l"), F.col("kind").alias("_k")), "filter_id", "left")
    out = out.select("filter_id", F.coalesce("_label", "_l", F.initcap("filter_id")).alias("label"), F.coalesce("_kind", "_k", F.lit("enum")).alias("kind"), F.when(F.size("collections") == len(selected), "all").otherwise("partial").alias("coverage"), "collections")
    return groups.select("group_id", "filter_id").join(out, "filter_id").select("group_id", "filter_id", "label", "kind", "coverage", "collections")
