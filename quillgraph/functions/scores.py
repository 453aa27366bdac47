"""Scores, bands and vector measures as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp01(col: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), col))


def ratio01(col: Column) -> Column:
    """Percentages become shares; the result is within 0 and 1."""
    return clamp01(F.when(col > 1, col / 100).otherwise(col))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return F.when((norm(a) > 0) & (norm(b) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)


def impact(score: Column, positive: float = 0.7, neutral: float = 0.4) -> Column:
    return F.when(score >= positive, "positive").when(score >= neutral, "neutral").otherwise("negative")


def confidence_label(score: Column) -> Column:
    return F.when(score >= 0.85, "HIGH").when(score >= 0.60, "MODERATE").when(score >= 0.35, "LOW").otherwise("VERY LOW")


def reciprocal_rank(*ranks: Column, k: int = 60) -> Column:
    """Sum of 1 / (k + rank) over the lists that hold the item."""
    return reduce(lambda a, b: a + b, (F.coalesce(1.0 / (k + r), F.lit(0.0)) for r in ranks))


def relevance_total(hard: Column, topic: Column, focus: Column, time: Column, family: Column, missing: Column, generic: Column, drift: Column) -> Column:
    return 4.0 * hard + 2.2 * topic + 1.2 * focus + time + family - missing - generic - drift


def token_coverage(have: Column, want: Column) -> Column:
    """Hits over max(4, min(wanted, 20)); 0 if either side is empty."""
    hits = F.size(F.array_intersect(have, want))
    return F.when((F.size(have) > 0) & (F.size(want) > 0), F.least(F.lit(1.0), hits / F.greatest(F.lit(4), F.least(F.size(want), F.lit(20))))).otherwise(0.0)


def group_coverage(text: Column, groups: list[list[str]]) -> Column:
    """Share of groups of alternative phrases of which one stands in a text (a phrase, with spaces around)."""
    if not groups:
        return F.lit(0.0)
    padded = F.concat(F.lit(" "), text, F.lit(" "))
    hit = [reduce(lambda a, b: a | b, (F.contains(padded, F.lit(f" {alt} ")) for alt in alts)) for alts in groups]
    return sum((h.cast("int") for h in hit), F.lit(0)) / len(groups)


def drift(have: Column, expected: Column, groups: list[tuple[list[str], int]], each: float = 1.35, most: float = 2.0) -> Column:
    """Penalty for each group of terms, unexpected here, of which a text has at least so many."""
    total = F.lit(0.0)
    for words, least in groups:
        group = F.array(*map(F.lit, words))
        off = ~F.arrays_overlap(expected, group) & (F.size(F.array_intersect(have, group)) >= least)
        total = total + F.when(F.coalesce(off, F.size(F.array_intersect(have, group)) >= least), each).otherwise(0.0)
    return F.least(F.lit(most), total)


def family_score(family: Column, allowed: Column) -> Column:
    return F.when(F.size(allowed) == 0, 0.0).when(F.array_contains(allowed, family), 0.45).otherwise(-0.75)


# Names under which a family of artifacts also comes.
FAMILY_ALIASES = {
    "DOC": "DOCUMENT", "DOCS": "DOCUMENT", "DOCUMENTS": "DOCUMENT", "PPT": "PRESENTATION", "PPTX": "PRESENTATION", "SLIDES": "PRESENTATION", "EMAILS": "EMAIL", "MAIL": "EMAIL",
    "PDF": "DOCUMENT", "PDFS": "DOCUMENT", "THREAD": "EMAIL", "THREADS": "EMAIL", "ATTACHMENT": "DOCUMENT", "ATTACHMENTS": "DOCUMENT",
}


def canonical_family(col: Column) -> Column:
    """Upper-case family name without prefix, by its usual name; DOCUMENT if there is none."""
    raw = F.regexp_replace(F.translate(F.upper(F.trim(F.coalesce(col, F.lit("")))), "- ", "__"), "^ARTIFACT_", "")
    known = F.create_map(*[F.lit(x) for pair in FAMILY_ALIASES.items() for x in pair])
    return F.coalesce(F.element_at(known, raw), F.when(raw != "", raw), F.lit("DOCUMENT"))


def family_name(family: str | None) -> str:
    """The same for a plain value."""
    raw = (family or "").strip().upper().translate(str.maketrans("- ", "__")).removeprefix("ARTIFACT_")
    return FAMILY_ALIASES.get(raw, raw or "DOCUMENT")


def path_confidence(a: Column, b: Column, hops: Column, a_selected: Column, b_selected: Column, candidate_only: Column) -> Column:
    """Confidence of a link along a path of so many nodes between candidates of these qualities."""
    score = 0.18 + 0.24 * a + 0.24 * b + F.greatest(F.lit(0.04), 0.20 - 0.04 * F.greatest(F.lit(0), hops - 1))
    score += F.when(a_selected, 0.05).otherwise(0.0) + F.when(b_selected, 0.05).otherwise(0.0) - F.when(candidate_only, 0.08).otherwise(0.0)
    return F.round(F.greatest(F.lit(0.10), F.least(F.lit(0.95), score)), 4)


def shared_anchor_confidence(a: Column, b: Column, shared: Column) -> Column:
    score = 0.52 + F.least(F.lit(0.14), 0.06 * shared) + F.least(F.lit(0.10), 0.10 * a) + F.least(F.lit(0.10), 0.10 * b)
    return F.round(F.least(F.lit(0.86), score).cast("decimal(18,9)"), 4).cast("double")


def shared_artifact_confidence(a: Column, b: Column, shared: Column, lexical: Column) -> Column:
    score = 0.48 + F.least(F.lit(0.16), 0.16 * lexical) + F.least(F.lit(0.08), 0.05 * shared) + F.least(F.lit(0.10), 0.10 * a) + F.least(F.lit(0.10), 0.10 * b)
    return F.round(F.least(F.lit(0.84), score).cast("decimal(18,9)"), 4).cast("double")


def default_reliability(kind: Column, category: Column, method: Column) -> Column:
    """Reliability by source category, adjusted for how and as what the evidence came."""
    category, kind = F.lower(F.coalesce(category, F.lit("secondary"))), F.lower(F.coalesce(kind, F.lit("")))
    score = F.when(category == "primary", 0.88).when(category == "secondary", 0.76).when(category == "tertiary", 0.68).otherwise(0.70)
    score += F.when(method == "aggregation", -0.05).when(method == "direct-capture", 0.03).otherwise(0.0)
    score += F.when(kind.isin("artifact", "document"), 0.02).when(kind == "derived", -0.03).otherwise(0.0)
    return clamp01(score)


def quality_weight(quality: Column) -> Column:
    return F.when(quality == "GROUNDED", 1.0).when(quality == "INFERRED", 0.7).otherwise(0.4)
