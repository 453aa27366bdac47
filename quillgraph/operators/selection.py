"""Greedy choices.  Each step depends on the ones before, so they run on one group; Spark first takes out the rows that can be chosen at all."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def cover(candidates: DataFrame, k: int, required: list[str], family_weight: float = 2.0, diversity: float = 0.5, relevance_weight: float = 0.35, group_boost: float = 2.0) -> DataFrame:
    """artifact_id, step, gain: the k artifacts (artifact_id, fused, family, collection, relevance, doc_group) taken one after the other.

    A family that is required and not yet covered gains, one that is there loses, so does a collection at half the weight; a group that is there gains.
    What a step adds or takes off is the same for all artifacts of one family, collection and group, so of each only the k best can be chosen;
    and of groups, only those that hold one of the k best of a family and collection.
    """
    base = candidates.withColumn("_base", F.col("fused") + relevance_weight * F.col("relevance"))
    best = lambda df, *by: df.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("_base"), F.desc("fused"), "artifact_id"))).where(F.col("_i") <= k).drop("_i", "_base")
    leaders = best(base, "family", "collection")
    groups = leaders.where("doc_group <> ''").select("doc_group").distinct()
    members = best(base.join(groups, "doc_group", "left_semi"), "family", "collection", "doc_group")
    short = leaders.unionByName(members).dropDuplicates(["artifact_id"])

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, out = rows.sort_values(["fused", "artifact_id"], ascending=[False, True]).to_dict("records"), []
        while left and len(out) < k:
            best = None
            for c in left:
                score = c["fused"] + relevance_weight * c["relevance"]
                score += family_weight if c["family"] in required and all(s["family"] != c["family"] for s in out) else 0.0
                score -= diversity * sum(s["family"] == c["family"] for s in out)
                score -= 0.5 * diversity * sum(s["collection"] == c["collection"] for s in out) if c["collection"] else 0.0
                score += group_boost if c["doc_group"] and any(s["doc_group"] == c["doc_group"] for s in out) else 0.0
                if best is None or score > best[0]:
                    best = (score, c)
            out.append(best[1] | {"gain": best[0], "step": len(out) + 1})
            left.remove(best[1])
        return pd.DataFrame([{"artifact_id": r["artifact_id"], "step": r["step"], "gain": r["gain"]} for r in out], columns=["artifact_id", "step", "gain"])

    kind = candidates.schema["artifact_id"].dataType.simpleString()
    return short.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"artifact_id {kind}, step int, gain double")


def diverse(subgraphs: DataFrame, bonus: float = 0.3, most: int = 10_000) -> DataFrame:
    """subgraph_id, step, novelty: (subgraph_id, score, nodes array) by score and share of nodes not yet seen.

    It orders what a beam has kept; more than ``most`` rows are refused, as one task goes through them again and again.
    """
    if subgraphs.count() > most:
        raise ValueError(f"more than {most} subgraphs: keep the best of a beam first")
    lam = min(bonus, 0.5)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, out, seen = rows.sort_values(["score", "subgraph_id"], ascending=[False, True]).to_dict("records"), [], set()
        low, high = rows.score.min(), rows.score.max()
        width = high - low if high > low else 1.0
        while left:
            best = None
            for c in left:
                nodes = set(c["nodes"])
                novelty = len(nodes - seen) / len(nodes) if nodes else (0.0 if out else 1.0)
                score = (1 - lam) * (c["score"] - low) / width + lam * novelty
                if best is None or score > best[0]:
                    best = (score, c, novelty)
            seen |= set(best[1]["nodes"])
            out.append({"subgraph_id": best[1]["subgraph_id"], "step": len(out) + 1, "novelty": round(best[2], 3)})
            left = [c for c in left if c["subgraph_id"] != best[1]["subgraph_id"]]
        return pd.DataFrame(out, columns=["subgraph_id", "step", "novelty"])

    kind = subgraphs.schema["subgraph_id"].dataType.simpleString()
    return subgraphs.withColumn("_all", F.lit(0)).groupBy("_all").applyInPandas(run, f"subgraph_id {kind}, step int, novelty double")


def bridged(candidates: DataFrame, chosen: DataFrame, most: int = 3) -> DataFrame:
    """artifact_id: what to add so that two artifacts of different families share a token (title, subject, collection, family); none if some do already."""
    words = F.array_distinct(F.filter(F.split(F.lower(F.concat_ws(" ", "title", "collection", "family")), r"[\s;,]+"), lambda x: F.length(x) >= 3))
    c = candidates.select("artifact_id", "family", "fused", F.explode(words).alias("tok"))
    taken = c.join(chosen.select("artifact_id"), "artifact_id", "left_semi")
    across = taken.select(F.col("family").alias("f1"), "tok").distinct().groupBy("tok").agg(F.count("*").alias("n")).where("n > 1")
    fits = c.join(chosen.select("artifact_id"), "artifact_id", "left_anti").join(taken.select("tok", F.col("family").alias("f2")).distinct(), "tok").where("family <> f2")
    best = fits.groupBy("artifact_id").agg(F.max("fused").alias("fused")).orderBy(F.desc("fused"), "artifact_id").limit(most)
    return best.join(across.limit(1).select(F.lit(1).alias("_one")), F.lit(True), "left_anti").select("artifact_id")


def beam(variables: list[str], candidates: DataFrame, edges: DataFrame, pattern: list[tuple[str, str]], width: int = 10) -> DataFrame:
    """Bindings of graph variables (var, cand, score) in order, the ``width`` best kept after each: score of candidates, and 10 per pattern edge that ``edges`` (src, dst) hold.

    There are as many rounds as variables; a round joins ``width`` rows with the candidates of one variable.
    """
    rows = candidates.select("var", F.col("cand"), F.col("score"))
    now = None
    held = edges.select("src", "dst").distinct()
    for i, v in enumerate(variables):
        own = rows.where(F.col("var") == v).select(F.col("cand").alias(v), F.col("score").alias("_s"))
        now = own.withColumnRenamed("_s", "total") if now is None else now.join(own, F.lit(True)).where(~F.col(v).isin(*[F.col(u) for u in variables[:i]])).withColumn("total", F.col("total") + F.col("_s")).drop("_s")
        for a, b in pattern:
            if v in (a, b) and {a, b} <= set(variables[: i + 1]):
                now = now.join(held.select(F.col("src").alias(f"_{a}"), F.col("dst").alias(f"_{b}"), F.lit(10.0).alias("_hit")), (F.col(a) == F.col(f"_{a}")) & (F.col(b) == F.col(f"_{b}")), "left")
                now = now.withColumn("total", F.col("total") + F.coalesce("_hit", F.lit(0.0))).drop(f"_{a}", f"_{b}", "_hit")
        now = now.orderBy(F.desc("total"), *variables[: i + 1]).limit(width)
    return now
