"""Questions as intents: parsing, validation, scores, correction, retrieval plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import dates
from quillgraph.functions import text as t

# Weights of the layers, penalties and verdicts.
LAYERS = {"entity_completeness": 0.20, "scope_correctness": 0.12, "retrieval_quality": 0.18, "slot_completeness": 0.15, "graph_spec_correctness": 0.25, "internal_consistency": 0.10}
PENALTY = {"HIGH": 3, "MEDIUM": 2, "LOW": 1}
PASS, PARTIAL = 0.85, 0.60
#: Slot, pattern of the question that asks for it.
SLOTS = [("WHO", r"\bwho\b|\bwhom\b|\bwhose\b"), ("WHEN", r"\bwhen\b|\bwhat (?:year|date)\b|\btimeline\b"), ("HOW", r"\bhow\b"), ("WHY", r"\bwhy\b"), ("OUTCOME", r"\boutcome\b|\bresult"), ("EVIDENCE", r"\bevidence\b|\bdocument"), ("WHAT", r"\bwhat\b|\bwhich\b")]

#: What a question opens with is no part of a name, though it is capitalised.
OPENING = r"(^|[?;.!])\s*(?:Who|Whom|Whose|What|When|Where|Why|How|Which|Did|Does|Do|Is|Are|Was|Were|Has|Have|Had|Can|Could|Should|Would)\b"


def parsed(questions: DataFrame, text: str = "question") -> DataFrame:
    """Questions with type, parts, slots, quoted and capitalised entities, first and last day."""
    q, low = F.col(text), F.lower(F.col(text))
    slots = F.array_compact(F.array(*[F.when(low.rlike(p), F.lit(s)) for s, p in SLOTS]))
    parts = F.filter(F.transform(F.split(q, r"\?\s*|;\s*|,?\s+and\s+(?=(?:who|what|when|where|why|how)\b)"), lambda x: F.trim(x)), lambda x: x != "")
    names = F.regexp_extract_all(F.regexp_replace(q, OPENING, "$1"), F.lit(r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b"), 1)
    quoted = F.regexp_extract_all(q, F.lit(r'"([^"]+)"'), 1)
    first, last = dates.question_range(q)
    kind = F.when(F.size(parts) > 1, "multi").when(low.rlike(r"\bcompare|\bversus\b|\bdiffer"), "comparison").when(low.rlike(r"^\s*(?:did|does|do|is|are|was|were|has|have)\b"), "yes_no").otherwise("factoid")
    return questions.withColumns({"kind": kind, "parts": parts, "slots": F.when(F.size(slots) == 0, F.array(F.lit("WHAT"))).otherwise(slots), "entities": F.array_sort(F.array_distinct(F.concat(names, quoted))), "first_day": first, "last_day": last})


def required_slots(question: Column, available: Column) -> Column:
    """Slots that a question asks for and that there are; WHAT if it asks for none."""
    asked = F.array_compact(F.array(*[F.when(F.lower(question).rlike(p), F.lit(s)) for s, p in SLOTS]))
    both = F.array_intersect(asked, available)
    return F.when(F.size(both) > 0, both).otherwise(F.array(F.lit("WHAT")))


def issues(intents: DataFrame) -> DataFrame:
    """intent_id, layer, issue, priority: intents (entities, hints, slots, needed, terms, vars, edges, family) against their question's parts."""
    has = lambda c: F.size(F.coalesce(F.col(c), F.array().cast("array<string>")))
    lost = F.array_except(t.lower_unique(F.col("entities")), t.lower_unique(F.col("hints")))
    rules = [
        ("entity_completeness", "missing_entity", "HIGH", F.size(lost) > 0), ("entity_completeness", "no_hints", "MEDIUM", has("hints") == 0), ("scope_correctness", "no_family", "LOW", F.coalesce("family", F.lit("")) == ""),
        ("retrieval_quality", "no_terms", "HIGH", has("terms") == 0), ("retrieval_quality", "few_terms", "LOW", has("terms").between(1, 2)), ("slot_completeness", "missing_slot", "HIGH", F.size(F.array_except("needed", "slots")) > 0),
        ("graph_spec_correctness", "no_variables", "HIGH", has("vars") == 0), ("graph_spec_correctness", "unconnected", "MEDIUM", (has("vars") > 1) & (has("edges") == 0)), ("internal_consistency", "repeated_terms", "LOW", F.size(t.lower_unique(F.col("terms"))) < has("terms")),
    ]
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(a).alias("layer"), F.lit(b).alias("issue"), F.lit(p).alias("priority"))) for a, b, p, c in rules]))
    return intents.select("intent_id", F.explode(found).alias("x")).select("intent_id", "x.*")


def layer_scores(found: DataFrame, checks: DataFrame) -> DataFrame:
    """intent_id, layer, score: 1 less the penalties over three times the checks; checks are (intent_id, layer, n)."""
    p = F.coalesce(*[F.when(F.col("priority") == k, F.lit(v)) for k, v in PENALTY.items()])
    sums = found.groupBy("intent_id", "layer").agg(F.sum(p).alias("p"))
    out = checks.join(sums, ["intent_id", "layer"], "left")
    return out.select("intent_id", "layer", F.when(F.col("n") == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.round(1 - F.coalesce("p", F.lit(0)) / (F.col("n") * 3), 2))).alias("score"))


def verdicts(scored: DataFrame) -> DataFrame:
    """intent_id, score, verdict: weighted sum over the layers."""
    w = F.coalesce(*[F.when(F.col("layer") == k, F.lit(v)) for k, v in LAYERS.items()], F.lit(0.0))
    out = scored.groupBy("intent_id").agg(F.round(F.sum(F.col("score") * w), 3).alias("score"))
    return out.withColumn("verdict", F.when(F.col("score") >= PASS, "PASS").when(F.col("score") >= PARTIAL, "PARTIAL_PASS").otherwise("FAIL"))


def minimality(extra: Column) -> Column:
    return F.when(extra > 6, "BLOATED").when(extra > 2, "PARTIALLY_MINIMAL").otherwise("MINIMAL")


def corrected(intents: DataFrame) -> DataFrame:
    """Intents with what their issues ask for: lost entities become hints, missing slots are added, terms come from entities, repeated terms go; ``changes`` says which."""
    empty = F.array().cast("array<string>")
    hints, slots, terms = F.coalesce("hints", empty), F.coalesce("slots", empty), F.coalesce("terms", empty)
    # The keys of the known hints are made first, so that the filter compares plain columns.
    out = intents.withColumns({"_keys": t.lower_unique(hints), "_asked": t.lower_unique(F.col("entities"))})
    out = out.withColumn("_lost", F.filter("entities", lambda e: ~F.array_contains(F.col("_keys"), F.lower(F.trim(e)))))
    out = out.withColumns({"_hints": F.array_distinct(F.concat(hints, "_lost")), "_slots": F.array_union(slots, F.col("needed")), "_terms": F.when(F.size(terms) > 0, t.lower_unique(terms)).otherwise(F.col("_asked"))})
    changes = F.array_compact(F.array(F.when(F.size("_lost") > 0, F.lit("hints")), F.when(F.size("_slots") > F.size(slots), F.lit("slots")), F.when(~F.coalesce(F.col("_terms") == terms, F.lit(False)), F.lit("terms"))))
    out = out.withColumn("changes", changes).withColumns({"hints": F.col("_hints"), "slots": F.col("_slots"), "terms": F.col("_terms")})
    return out.drop("_keys", "_asked", "_lost", "_hints", "_slots", "_terms")


def query_plan(intents: DataFrame) -> DataFrame:
    """intent_id, query: terms widened by variable hints and labels, as one OR query."""
    return intents.select("intent_id", t.or_query(t.expanded(F.col("terms"), F.coalesce("hints", F.array().cast("array<string>")))).alias("query"))
