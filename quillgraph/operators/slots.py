"""Slots of an intent: the typed intent itself, the graph variables a slot is about, subgraphs ranked for it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.structs import tolerant_json
from quillgraph.operators.build import keep_first
from quillgraph.operators.ontology import compatible, role_fits

GRAPH = (
    "query_name string, vars array<struct<var: string, type: string, role: string, hint: string, hard: boolean>>, edges array<struct<src: string, rel: string, dst: string, hard: boolean, notes: string>>, "
    "temporal_constraints array<struct<kind: string, before: string, after: string, window_days: int, vars: array<string>, notes: string>>, objective struct<primary: string, secondary: array<string>, return_top_k_alternatives: int>"
)
INTENT = (
    "Header struct<intent_id: string, schema_version: string, question_id: string, created_at: string, question_text: string>, "
    "EntityHints array<struct<entity_id: string, surface: string, category: string, normalized: string, confidence: double, qualifiers: map<string, string>>>, "
    "ScopeSpec struct<mode: string, collections: struct<include: array<string>, exclude: array<string>>, artifact_types: array<string>, time_filter: struct<op: string, start: string, end: string, timezone: string>, exclude_features: array<string>, scope_notes: string>, "
    "RetrievalSpec struct<query_text: string, query_expansions: array<string>, field_boosts: map<string, double>, top_k_lex: int, top_k_sem: int, fusion_method: string>, "
    f"SlotSpec struct<global_trigger: struct<trigger_id: string, terms: array<string>>, slots: array<struct<slot_id: string, slot_type: string, description: string, target_schema_id: string, target_var: string, target_graph_var: string, graph_spec: struct<{GRAPH}>>>, graph_spec: struct<{GRAPH}>>, "
    "Diagnostics struct<rule_hits: array<string>, notes: array<string>>"
)
#: Edges (1 each) and bound variables that speak for a subgraph, by slot type.
PREFERRED = {
    "EVIDENCE": (["A-[SUPPORTS]->CL", "CL-[CONTRADICTS]->POL", "CL-[QUOTES_SPAN]->TS", "TS-[EVIDENCED_BY]->A"], {"A": 0.35, "CL": 0.35, "POL": 0.35, "TS": 0.35, "RF": 0.35}),
    "HOW": (["O-[INVOLVED_IN]->RESP", "RESP-[RESULTED_IN]->CL"], {"RESP": 0.30, "O": 0.30, "CL": 0.30}),
    "WHO": (["A-[AUTHORED_BY]->P", "P-[AFFILIATED_WITH]->R", "R-[AFFILIATED_WITH]->O"], {}),
    "WHAT": (["CL-[ABOUT]->C", "CL-[ABOUT]->T", "D-[ABOUT]->C", "D-[ABOUT]->T"], {"C": 0.85, "T": 0.55, "CL": 0.45, "D": 0.20}),
    "OUTCOME": (["RESP-[RESULTED_IN]->CL"], {"RESP": 0.25, "CL": 0.25, "POL": 0.25, "S": 0.25}),
}
MOST_VARS, SPREAD = 5, 1.5


def typed_intent(rows: DataFrame, column: str) -> DataFrame:
    """Rows with ``intent``: the JSON bundle as one struct, with the defaults of what it leaves out; null without an intent id."""
    raw = rows.withColumn("_i", F.from_json(tolerant_json(F.col(column)), INTENT))
    i = F.col("_i")
    none = F.array().cast("array<string>")
    scope = F.struct(
        F.coalesce(i["ScopeSpec"]["mode"], F.lit("PREFER")).alias("mode"), F.coalesce(i["ScopeSpec"]["collections"]["include"], none).alias("include"), F.coalesce(i["ScopeSpec"]["collections"]["exclude"], none).alias("exclude"),
        F.coalesce(i["ScopeSpec"]["artifact_types"], none).alias("artifact_types"), F.coalesce(i["ScopeSpec"]["time_filter"]["op"], F.lit("none")).alias("time_op"), i["ScopeSpec"]["time_filter"]["start"].alias("start"), i["ScopeSpec"]["time_filter"]["end"].alias("end"),
        F.coalesce(i["ScopeSpec"]["time_filter"]["timezone"], F.lit("America/Los_Angeles")).alias("timezone"),
    )
    find = F.struct(
        F.coalesce(i["RetrievalSpec"]["query_text"], F.lit("")).alias("query_text"), F.coalesce(i["RetrievalSpec"]["query_expansions"], none).alias("query_expansions"), F.coalesce(i["RetrievalSpec"]["top_k_lex"], F.lit(250)).alias("top_k_lex"),
        F.coalesce(i["RetrievalSpec"]["top_k_sem"], F.lit(250)).alias("top_k_sem"), F.coalesce(i["RetrievalSpec"]["fusion_method"], F.lit("rrf")).alias("fusion_method"),
    )
    graph = i["SlotSpec"]["graph_spec"]
    slots = F.transform(
        F.coalesce(i["SlotSpec"]["slots"], F.array().cast("array<struct<slot_id: string, slot_type: string, description: string, target_schema_id: string, target_var: string, target_graph_var: string, graph_spec: struct<" + GRAPH + ">>>")),
        lambda s: F.struct(s["slot_id"].alias("slot_id"), s["slot_type"].alias("slot_type"), t.blank(s["description"]).alias("description"), F.coalesce(s["target_var"], s["target_graph_var"], F.lit("")).alias("target_var"), F.coalesce(s["graph_spec"], graph).alias("graph_spec")),
    )
    hints = F.transform(F.coalesce(i["EntityHints"], F.array().cast("array<struct<entity_id: string, surface: string, category: string, normalized: string, confidence: double, qualifiers: map<string, string>>>")), lambda h: h.withField("normalized", t.blank(h["normalized"])).withField("confidence", F.coalesce(h["confidence"], F.lit(0.0))))
    whole = F.struct(i["Header"].alias("header"), hints.alias("hints"), scope.alias("scope"), find.alias("retrieval"), slots.alias("slots"), graph.alias("graph_spec"), F.coalesce(graph["objective"]["return_top_k_alternatives"], F.lit(10)).alias("top_k_alternatives"))
    return raw.withColumn("intent", F.when(i["Header"]["intent_id"].isNotNull(), whole)).drop("_i")


def slot_variables(slots: DataFrame, variables: DataFrame, takes: DataFrame, hierarchy: DataFrame, keywords: DataFrame) -> DataFrame:
    """slot_id, var, score: the variables that a slot (of the same intent_id) is about.

    The one that it names as its target; else the one that its schema id names; else up to five within 1.5 of the best score (and 1 at least),
    by shared tokens of schema id (2 each) and description (1.5), category (4), role (2.5) and whether a variable is hard (.25).
    """
    j = slots.join(variables, "intent_id")
    tokens = lambda *c: t.tokens(F.concat_ws(" ", *c))
    fits = compatible(j.select("slot_id", "var", "slot_type", F.col("type").alias("category")), takes, hierarchy).select("slot_id", "var", F.lit(True).alias("_cat"))
    roles = role_fits(j.select("slot_id", "var", "slot_type", "role").where("role <> ''"), keywords).where("fits").select("slot_id", "var", F.lit(True).alias("_role"))
    j = j.join(fits, ["slot_id", "var"], "left").join(roles, ["slot_id", "var"], "left")
    own = tokens("var", "type", "role", "hint")
    shared = lambda c: F.size(F.array_intersect(t.tokens(F.col(c)), own))
    score = 2.0 * shared("target_schema_id") + F.when(F.col("_cat"), 4.0).otherwise(0.0) + F.when(F.col("_role"), 2.5).otherwise(0.0) + 1.5 * shared("description") + F.when(F.col("hard"), 0.25).otherwise(0.0)
    named = F.when((F.col("target_var") != "") & (F.col("target_var") == F.col("var")), 0).when((F.col("target_schema_id") != "") & (F.col("target_schema_id") == F.col("var")), 1).otherwise(2)
    by = W.partitionBy("slot_id")
    j = j.withColumns({"score": score, "_how": named}).withColumn("_best_how", F.min("_how").over(by)).where("_how = _best_how AND (_how < 2 OR score > 0)")
    j = j.withColumns({"_i": F.row_number().over(by.orderBy(F.desc("score"), "var")), "_top": F.max("score").over(by)})
    kept = (F.col("_how") < 2) | ((F.col("_i") <= MOST_VARS) & (F.col("score") >= F.greatest(F.lit(1.0), F.col("_top") - SPREAD)))
    return j.where(kept).select("slot_id", "var", "score")


def ranked_for_slots(slots: DataFrame, relevant: DataFrame, subgraphs: DataFrame, bound: DataFrame, held: DataFrame) -> DataFrame:
    """slot_id, subgraph_id, score, rank: by relevant variables bound plus bonuses of the slot's type, then hard coverage, then own score.

    ``relevant``: slot_id, var; ``bound``: subgraph_id, var; ``held``: subgraph_id, edge (``A-[REL]->B``).  Bonuses are the table ``PREFERRED``.
    """
    spark = slots.sparkSession
    edges = spark.createDataFrame([(s, e, 1.0) for s, (es, _) in PREFERRED.items() for e in es], "slot_type string, edge string, weight double")
    vars_ = spark.createDataFrame([(s, v, w) for s, (_, vs) in PREFERRED.items() for v, w in vs.items()], "slot_type string, var string, weight double")
    s = slots.select("slot_id", F.upper("slot_type").alias("slot_type"))
    parts = relevant.join(bound.distinct(), "var").select("slot_id", "subgraph_id", F.lit(1.0).alias("weight"))
    parts = parts.unionByName(s.join(F.broadcast(edges), "slot_type").join(held.distinct(), "edge").select("slot_id", "subgraph_id", "weight"))
    parts = parts.unionByName(s.join(F.broadcast(vars_), "slot_type").join(bound.distinct(), "var").select("slot_id", "subgraph_id", "weight"))
    # Weights are hundredths: added up as whole numbers they do not depend on the order of rows.
    sums = parts.groupBy("slot_id", "subgraph_id").agg((F.sum(F.round(F.col("weight") * 100).cast("long")) / 100).alias("fit"))
    out = sums.join(subgraphs, "subgraph_id")
    return out.withColumn("rank", F.row_number().over(W.partitionBy("slot_id").orderBy(F.desc("fit"), F.desc("hard_coverage"), F.desc("score"), "subgraph_id"))).select("slot_id", "subgraph_id", F.col("fit").alias("score"), "rank")


def chronology(evidence: DataFrame, most: int = 500) -> DataFrame:
    """group_id, item_id, step: dated evidence of a frame in order of time, undated last; one per artifact and day, ``most`` a group."""
    once = keep_first(evidence, ["group_id", "artifact_id", "day"], F.desc("score"), "item_id")
    step = F.row_number().over(W.partitionBy("group_id").orderBy(F.col("day").asc_nulls_last(), "artifact_id", "item_id"))
    return once.withColumn("step", step).where(F.col("step") <= most).select("group_id", "item_id", "step")


def confidence01(value: Column) -> Column:
    """A number between 0 and 1 out of text: percentages are divided, what is no number is 0."""
    n = F.coalesce(F.try_to_number(F.trim(value), F.lit("S999999999D999999999")).cast("double"), F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when((n > 1) & (n <= 100), n / 100).otherwise(n)))


def page_index(fields: Column, keys: list[str]) -> Column:
    """The first of the keys whose value is a whole number from 1."""
    number = lambda k: F.when(F.element_at(fields, k).rlike(r"^\s*\+?\d{1,9}\s*$"), F.trim(F.element_at(fields, k)).cast("int"))
    return F.coalesce(*[F.when(number(k) >= 1, number(k)) for k in keys])
