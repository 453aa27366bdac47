"""Duplicate entities: candidates, scores, merging."""

from __future__ import annotations


import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.operators.build import keep_first
from quillgraph.operators.graph import components

KEYS = {"person": t.person_key, "org": t.organisation_key, "location": t.location_key, "lower": lambda c: F.lower(F.trim(t.blank(c)))}


def _pairs(keyed: DataFrame) -> DataFrame:
    return keyed.join(keyed.select("key", F.col("id").alias("id2"), F.col("val").alias("val2")), "key").where("id < id2").select("id", "val", "id2", "val2")


def candidates(nodes: DataFrame, key: str, value: str, mode: str = "lower", least_last: int = 4) -> DataFrame:
    """id1, str1, id2, str2, pass: pairs of one grouping key; persons also by last name of four letters or more, once per pair."""
    rows = nodes.select(F.col(key).alias("id"), F.col(value).alias("val")).where("val IS NOT NULL AND val <> ''").withColumn("key", KEYS[mode](F.col("val"))).where("key <> ''")
    found = _pairs(rows).withColumn("pass", F.lit(1))
    if mode == "person":
        by_last = rows.withColumn("key", t.last_name(F.col("key"))).where(F.length("key") >= least_last)
        found = found.unionByName(_pairs(by_last).withColumn("pass", F.lit(2)))
    found = found.groupBy("id", "id2").agg(F.min("pass").alias("pass"), F.min("val").alias("val"), F.min("val2").alias("val2"))
    return found.select(F.col("id").alias("id1"), F.col("val").alias("str1"), F.col("id2"), F.col("val2").alias("str2"), "pass")


def scored(pairs: DataFrame, scorer: Column | None = None, threshold: float = 0.85) -> DataFrame:
    """Candidate pairs with score and decision; the default scorer is the sequence ratio of the grouping keys."""
    score = scorer if scorer is not None else t.sequence_ratio(t.phrase(F.col("str1")), t.phrase(F.col("str2")))
    return pairs.withColumn("score", score).withColumn("decision", F.when(F.col("score") >= threshold, "merge").otherwise("keep"))


def keepers(pairs: DataFrame, degree: DataFrame) -> DataFrame:
    """dup, keeper for all but one node of each group of merged pairs: the one of highest degree stays, ties to the smallest id."""
    groups = components(pairs.select(F.col("id1").alias("a"), F.col("id2").alias("b")))
    ranked = groups.join(degree.select(F.col("id").alias("node"), "degree"), "node", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    best = keep_first(ranked, ["component"], F.desc("degree"), "node").select("component", F.col("node").alias("keeper"))
    return ranked.join(best, "component").where("node <> keeper").select(F.col("node").alias("dup"), "keeper")


def merged_edges(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Edges moved to the keepers; loops and repeated edges go."""
    m1, m2 = mapping.select(F.col("dup").alias("src"), F.col("keeper").alias("k1")), mapping.select(F.col("dup").alias("dst"), F.col("keeper").alias("k2"))
    out = edges.join(m1, "src", "left").join(m2, "dst", "left").select(F.coalesce("k1", "src").alias("src"), F.coalesce("k2", "dst").alias("dst"), "rel_type")
    return out.where("src <> dst").distinct()


def merged_nodes(nodes: DataFrame, mapping: DataFrame, key: str) -> DataFrame:
    """Nodes that stay, with the number of nodes that went into them."""
    n = mapping.groupBy(F.col("keeper").alias(key)).agg(F.count("*").alias("n_merged"))
    return nodes.join(mapping.select(F.col("dup").alias(key)), key, "left_anti").join(n, key, "left").withColumn("n_merged", F.coalesce("n_merged", F.lit(0)))


def mention_clusters(mentions: DataFrame, threshold: float = 0.75) -> DataFrame:
    """mention_id, category, cluster: mentions in order join the first cluster of their category that their surface is like.

    Greedy, so the outcome depends on the order.  Equal surfaces meet first (one row per surface, by its first mention), and only surfaces with
    the same first character are compared, so a group is the distinct surfaces of one category and character.
    """
    keyed = mentions.withColumn("key", F.lower(F.trim(F.coalesce(F.nullif("normalized", F.lit("")), "surface"))))
    distinct = keyed.groupBy("category", "key").agg(F.min("seq").alias("seq")).withColumn("bucket", F.substring("key", 1, 1))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        found: list[str] = []
        names = []
        for key in group.sort_values("seq")["key"]:
            hit = next((c for c in found if _alike(key, c, threshold)), None)
            if hit is None:
                found.append(key)
            names.append((key, hit or key))
        out = pd.DataFrame(names, columns=["key", "cluster"])
        out["category"] = group["category"].iloc[0]
        return out

    named = distinct.groupBy("category", "bucket").applyInPandas(run, "key string, cluster string, category string")
    return keyed.join(named, ["category", "key"]).select("mention_id", "category", "cluster")


def _alike(a: str, b: str, threshold: float) -> bool:
    if a == b or (a and b and (a in b or b in a)):
        return True
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return False
    p, q = x - set(t.STOPWORDS), y - set(t.STOPWORDS)
    p, q = (p, q) if p and q else (x, y)
    return p <= q or q <= p or len(p & q) / len(p | q) >= threshold


def tagged(nodes: DataFrame, key: Column, names: list[str], label: str) -> DataFrame:
    """Nodes with one more label if their name is listed."""
    return nodes.withColumn("labels", F.when(F.lower(key).isin([n.lower() for n in names]), F.array_union("labels", F.array(F.lit(label)))).otherwise(F.col("labels")))


def enriched(nodes: DataFrame, key: str, vocabularies: dict[str, DataFrame]) -> DataFrame:
    """Nodes with (code, status) per vocabulary; a vocabulary is a table (key, code) of lower-case names."""
    out = nodes
    for name, v in vocabularies.items():
        v = v.select(F.lower("key").alias(f"_{name}"), F.col("code").alias(f"{name}_code"), F.lit(True).alias(f"_{name}_hit"))
        out = out.join(v, F.lower(F.trim(F.col(key))) == F.col(f"_{name}"), "left").withColumn(f"{name}_status", F.when(F.col(f"_{name}_hit").isNull(), "not_found").when(F.col(f"{name}_code").isNull(), "no_match").otherwise("matched")).drop(f"_{name}", f"_{name}_hit")
    return out


