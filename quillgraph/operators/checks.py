"""Checks and counts over nodes and edges: orphans, duplicates, degrees, completeness, constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.operators.build import union_all


def unlinked(name: str, nodes: DataFrame, key: str, edges: DataFrame, end: str) -> DataFrame:
    """check, n: nodes that no edge ends at."""
    return nodes.join(edges.select(F.col(end).alias(key)).distinct(), key, "left_anti").agg(F.lit(name).alias("check"), F.count("*").alias("n"))


def counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(F.col(by).alias("name")).agg(F.count("*").alias("n"))


def duplicate_keys(df: DataFrame, key: Column, top: int = 20) -> DataFrame:
    """Keys held by several rows, most frequent first."""
    return df.select(key.alias("key")).where("key IS NOT NULL AND key <> ''").groupBy("key").agg(F.count("*").alias("n")).where("n > 1").orderBy(F.desc("n"), "key").limit(top)


def degrees(nodes: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    """Edges at either end of each node, 0 without any."""
    ends = edges.select(F.col("src").alias(key)).unionByName(edges.select(F.col("dst").alias(key))).groupBy(key).agg(F.count("*").alias("degree"))
    return nodes.select(key).join(ends, key, "left").select(key, F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n_missing, n_rows: null or empty values."""
    sums = df.agg(F.count("*").alias("n"), *[F.sum(F.when(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == ""), 1).otherwise(0)).alias(c) for c in columns])
    return sums.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_missing")) for c in columns])).alias("x")).select("x.column", "x.n_missing", F.col("n").alias("n_rows"))


def coverage(df: DataFrame, condition: Column) -> DataFrame:
    """n_covered, n_rows, ratio."""
    sums = df.agg(F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).alias("n_covered"), F.count("*").alias("n_rows"))
    return sums.withColumn("ratio", F.when(F.col("n_rows") > 0, F.col("n_covered") / F.col("n_rows")).otherwise(0.0))


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """rule, uid: rows that break a rule; an unknown outcome is no break.  One pass over the table for all rules."""
    broken = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in rules.items()]), lambda x: x.isNotNull())
    return df.select(F.col(key).cast("string").alias("uid"), F.explode(broken).alias("rule")).select("rule", "uid")


def dangling(edges: DataFrame, nodes: DataFrame, key: str, ends: tuple[str, ...] = ("src", "dst")) -> DataFrame:
    """rule, uid: edge ends that are no node."""
    ids = nodes.select(F.col(key).alias("_id")).distinct()
    return union_all([edges.join(ids, F.col(e) == F.col("_id"), "left_anti").select(F.lit(f"dangling_{e}").alias("rule"), F.col(e).cast("string").alias("uid")).distinct() for e in ends])


def page_coverage(pages: DataFrame, doc: str, page: str, expected: str) -> DataFrame:
    """doc, valid: whether the page numbers are exactly 1 to the expected number, in any order."""
    g = pages.groupBy(doc).agg(F.count(page).alias("_n"), F.countDistinct(page).alias("_distinct"), F.min(page).alias("_least"), F.max(page).alias("_most"), F.max(expected).alias("_want"))
    return g.select(doc, ((F.col("_n") == F.col("_want")) & (F.col("_distinct") == F.col("_want")) & (F.col("_least") == 1) & (F.col("_most") == F.col("_want"))).alias("valid"))
