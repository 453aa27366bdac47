"""Scoped hybrid retrieval: scope predicate, lexical and vector ranking, fusion, relevance."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import dates, scores
from quillgraph.functions import text as t
from quillgraph.operators.graph import checkpointed, numbered

K1, B, TITLE_BOOST = 1.2, 0.75, 3.0


def scope(
    collection: Column, family: Column, date: Column, features: Column | None = None, include: list[str] | None = None, exclude: list[str] | None = None, families: list[str] | None = None,
    op: str = "none", start: str = "", end: str = "", without: list[str] | None = None, strict: bool = True,
) -> Column:
    """Whether an artifact is in scope.  A missing value passes; a preferred (not strict) scope lets all pass and only ranks."""
    if not strict:
        return F.lit(True)
    missing = lambda c: c.isNull() | (c == "")
    conditions = [F.lit(True)]
    if include:
        conditions.append(missing(collection) | collection.isin(include))
    if exclude:
        conditions.append(missing(collection) | ~collection.isin(exclude))
    if families:
        conditions.append(missing(family) | scores.canonical_family(family).isin([scores.family_name(f) for f in families]))
    when = dates.normal(date)
    if op == "between" and start and end:
        conditions.append(missing(when) | when.between(start, end))
    elif op == "before" and end:
        conditions.append(missing(when) | (when <= end))
    elif op == "after" and start:
        conditions.append(missing(when) | (when >= start))
    if without and features is not None:
        conditions.append(~F.coalesce(F.arrays_overlap(features, F.array(*map(F.lit, without))), F.lit(False)))
    return reduce(lambda a, b: a & b, conditions)


def payload(filters: dict[str, object]) -> Column:
    """Equality, any-of (list) and range (pair) conditions on columns."""
    parts = [F.lit(True)]
    for name, v in filters.items():
        parts.append(F.col(name).isin(v) if isinstance(v, list) else F.col(name).between(*v) if isinstance(v, tuple) else F.col(name) == v)
    return reduce(lambda a, b: a & b, parts)


def has_label(docs: DataFrame, pages: DataFrame, key: str, label: str, wanted: list[str]) -> DataFrame:
    """Documents with a page of one of the labels."""
    return docs.join(pages.where(F.lower(label).isin([w.lower() for w in wanted])).select(key).distinct(), key, "left_semi")


def _as_token(term: str) -> str:
    """Pattern of a term that stands as a token in lower-case text: counting matches needs no array of all tokens."""
    return f"(?<![a-z0-9]){term}(?![a-z0-9])" if re.fullmatch("[a-z0-9]+", term) else "(?!)"


def bm25(docs: DataFrame, key: str, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """key, score: BM25 of each field times its boost, summed.  Term counts are made per row, so only one row per document and field is ever moved."""
    q = sorted({x.lower() for x in terms})
    rows = docs.select(key, *[F.lower(t.blank(F.col(f))).alias(f) for f in fields])
    counted = rows.select(key, *[F.regexp_count(F.col(f), F.lit("[a-z0-9]+")).alias(f"{f}_n") for f in fields], *[F.regexp_count(F.col(f), F.lit(_as_token(w))).alias(f"{f}_{i}") for f in fields for i, w in enumerate(q)])
    # Texts are tokenised once: statistics and scores both read the counts.
    counted = checkpointed(counted)
    stats = counted.agg(F.count("*").alias("docs"), *[F.avg(f"{f}_n").alias(f"{f}_avg") for f in fields], *[F.sum((F.col(f"{f}_{i}") > 0).cast("int")).alias(f"{f}_df{i}") for f in fields for i in range(len(q))])
    joined = counted.join(F.broadcast(stats))  # one row

    def part(f: str, i: int) -> Column:
        df, tf = F.col(f"{f}_df{i}"), F.col(f"{f}_{i}")
        idf = F.log(1 + (F.col("docs") - df + 0.5) / (df + 0.5))
        return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col(f"{f}_n") / F.col(f"{f}_avg")))

    score = sum((fields[f] * F.when(F.col(f"{f}_{i}") > 0, part(f, i)).otherwise(0.0) for f in fields for i in range(len(q))), F.lit(0.0))
    return joined.select(key, score.alias("score")).where("score > 0")


def term_hits(docs: DataFrame, key: str, text: str, terms: list[str]) -> DataFrame:
    """key, score: how many of the terms stand in a text as tokens."""
    low = docs.select(key, F.lower(t.blank(F.col(text))).alias("_low"))
    score = sum((F.col("_low").rlike(_as_token(x.lower())).cast("int") for x in terms), F.lit(0))
    return low.select(key, score.cast("double").alias("score")).where("score > 0")


def ranked(scored: DataFrame, key: str, top: int) -> DataFrame:
    """The best ``top`` rows with rank, ties to the larger key.  The limit comes before the ranking, so the one ordered partition is small."""
    best = scored.orderBy(F.desc("score"), F.desc(key)).limit(top)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), F.desc(key))))


def nearest(vectors: DataFrame, key: str, vector: str, query: list[float], top: int, where: Column | None = None) -> DataFrame:
    """The vectors closest to one query by cosine: an exact scan, kept to the best rows of each task before they meet."""
    rows = vectors if where is None else vectors.where(where)
    q = F.array(*[F.lit(float(x)) for x in query])
    return ranked(rows.select(key, scores.cosine(F.col(vector), q).alias("score")), key, top)


def more_like(vectors: DataFrame, key: str, vector: str, positive: int, top: int) -> DataFrame:
    """The vectors closest to one of them, without itself."""
    found = vectors.where(F.col(key) == positive).select(vector).first()
    return nearest(vectors, key, vector, list(found[0]) if found else [0.0], top, F.col(key) != positive)


def first_hits(pages: DataFrame, artifact: str) -> DataFrame:
    """Ranked page hits as ranked artifacts: each at its first page, ranks closed up."""
    best = pages.groupBy(artifact).agg(F.min("rank").alias("first"))
    return numbered(best, "rank", "first", artifact).select(artifact, "rank")


def reciprocal_fusion(lexical: DataFrame, semantic: DataFrame, key: str, k: int = 60) -> DataFrame:
    """Both ranked lists merged: sum of 1 / (k + rank)."""
    a, b = lexical.select(key, F.col("rank").alias("lex_rank")), semantic.select(key, F.col("rank").alias("sem_rank"))
    out = a.join(b, key, "full_outer")
    return out.select(key, "lex_rank", "sem_rank", scores.reciprocal_rank(F.col("lex_rank"), F.col("sem_rank"), k=k).alias("fused"))


def linear_fusion(lexical: DataFrame, semantic: DataFrame, key: str, alpha: float = 0.5) -> DataFrame:
    """Both scored lists merged: alpha of the lexical score over its maximum, the rest of the semantic one over its own."""
    whole = W.partitionBy(F.lit(0))
    part = lambda df, name: df.select(key, (F.when(F.max("score").over(whole) > 0, F.col("score") / F.max("score").over(whole)).otherwise(0.0)).alias(name))
    out = part(lexical, "lex").join(part(semantic, "sem"), key, "full_outer")
    return out.select(key, (alpha * F.coalesce("lex", F.lit(0.0)) + (1 - alpha) * F.coalesce("sem", F.lit(0.0))).alias("fused"))


def relevance(candidates: DataFrame, hard: list[list[str]], topic: list[str], focus: list[str], families: list[str], first_year: int | None = None, last_year: int | None = None, drift_groups: list[tuple[list[str], int]] | None = None, required: list[list[str]] | None = None, text_years: bool = True) -> DataFrame:
    """Candidates (text, family, date) with the parts and the total of their relevance to an intent; years in the text count beside the date's with ``text_years``."""
    # Made once, in a projection of their own, as every part reads them.
    candidates = candidates.withColumns({"_have": t.tokens(F.col("text")), "_norm": t.phrase(F.col("text"))})
    have, norm = F.col("_have"), F.col("_norm")
    said = F.transform(F.regexp_extract_all(F.col("text"), F.lit(r"\b((?:19|20)\d{2})\b"), 1), lambda x: x.cast("int")) if text_years else F.array().cast("array<int>")
    lit = lambda xs: F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")
    out = candidates.withColumns({
        "hard": scores.group_coverage(norm, hard), "required": scores.group_coverage(norm, required or []), "topic": scores.token_coverage(have, lit(topic)), "focus": scores.token_coverage(have, lit(focus)),
        "drift": scores.drift(have, lit([*topic, *focus]), drift_groups or []), "family_score": scores.family_score(scores.canonical_family(F.col("family")), lit(families)),
        "time_score": dates.time_score(F.array_compact(F.array(dates.year(F.col("date")))), said, F.lit(first_year).cast("int"), F.lit(last_year).cast("int")),
    })
    has_text = F.size(have) > 0
    no_hard = has_text & F.lit(bool(hard)) & (F.col("hard") <= 0.01)
    missing = F.when(no_hard, 2.0).otherwise(0.0)
    missing = F.greatest(missing, F.when(has_text & F.lit(bool(required)) & (F.col("required") <= 0.01), 2.5).otherwise(0.0))
    out = out.withColumns({"missing": missing, "generic": F.when(no_hard & (F.col("topic") < 0.18), 0.75).otherwise(0.0)})
    return out.withColumn("total", scores.relevance_total(*[F.col(c) for c in ("hard", "topic", "focus", "time_score", "family_score", "missing", "generic", "drift")])).drop("_have", "_norm")


def rejections(least_total: float = 0.0, most_drift: float = 1.0) -> Column:
    """Why a scored candidate is not selectable; empty if it is."""
    rules = {"missing_hard_entity": F.col("missing") >= 2.0, "scope_drift": F.col("drift") > most_drift, "family_mismatch": F.col("family_score") < 0, "low_relevance": F.col("total") < least_total}
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules.items()]))
