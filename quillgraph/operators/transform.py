"""How one text became another: an ordered decision over token arrays, and the mappings kept per target."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as t

# Words that make a statement binding, and words that make it tentative.
QUALIFIERS = ["shall", "must", "required", "requires", "require", "definitive", "legitimate", "outside", "training", "periodic", "routine", "promptly"]
HEDGES = ["may", "might", "could", "consider", "suggestion", "possible", "possibly", "likely"]


def classify(source: Column, target: Column) -> Column:
    """Struct (label, confidence)."""
    seq = lambda c: F.regexp_extract_all(F.lower(t.blank(c)), F.lit("[a-z0-9]+"), 0)
    s, d = seq(source), seq(target)
    ss, ds, sn, dn = F.array_distinct(s), F.array_distinct(d), F.array_join(s, " "), F.array_join(d, " ")
    j = t.jaccard(ss, ds)
    lost = F.array_except(ss, ds)
    loses = lambda words: F.arrays_overlap(lost, F.array(*map(F.lit, words)))
    contains = F.contains(sn, dn) | F.contains(dn, sn)
    shorter = F.least(F.size(s), F.size(d)) / F.greatest(F.lit(1), F.greatest(F.size(s), F.size(d)))
    out = lambda label, c: F.struct(F.lit(label).alias("label"), (F.lit(c) if isinstance(c, float) else c).alias("confidence"))
    return (
        F.when((F.size(s) == 0) | (F.size(d) == 0), out("OTHER", 0.2))
        .when(sn == dn, out("VERBATIM", 1.0))
        .when(F.coalesce(loses(QUALIFIERS), F.lit(False)) & (j >= 0.35), out("QUALIFIER_DROP", F.least(F.lit(0.95), 0.65 + j / 3)))
        .when(F.coalesce(loses(HEDGES), F.lit(False)) & (j >= 0.35), out("HEDGE_DROP", F.least(F.lit(0.9), 0.6 + j / 3)))
        .when(contains & (shorter <= 0.75), out("COMPRESSION", F.least(F.lit(0.95), 0.7 + j / 4)))
        .when(j >= 0.35, out("PARAPHRASE", F.least(F.lit(0.9), 0.55 + j / 3)))
        .when(F.size(F.array_intersect(ss, ds)) == 0, out("OMISSION", 0.55))
        .otherwise(out("OTHER", 0.35))
    )


def similar_pairs(sources: DataFrame, targets: DataFrame, key: str, vector: str, k: int, block_rows: int = 2_048) -> DataFrame:
    """source, target, similarity: of all pairs of a source and a target, the k with the largest cosine, ties to the smaller keys.

    A row makes no pair with itself, and of two rows that are both sources and targets only the smaller is the source.  Every pair is compared,
    in blocks of at most some ``block_rows`` by ``block_rows``, each of which keeps its own k best.
    """
    both = sources.select(key).distinct().join(targets.select(key).distinct(), key)
    side = lambda df: df.where(F.col(key).isNotNull() & F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias("v")).join(both.select(F.col(key).cast("long").alias(key), F.lit(True).alias("both")), key, "left")
    s, d = side(sources), side(targets)
    n_s, n_d = (max(1, -(-x.count() // block_rows)) for x in (s, d))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    left = s.withColumn("bs", own(n_s)).withColumn("bt", every(n_d))
    right = d.withColumn("bt", own(n_d)).withColumn("bs", every(n_s))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        for size in sorted({len(v) for v in a.v}):
            x, y = a[a.v.map(len) == size], b[b.v.map(len) == size]
            if not size or not len(y):
                continue
            mx, my = np.stack(x.v.to_numpy()), np.stack(y.v.to_numpy())
            norms = np.sqrt((mx * mx).sum(1))[:, None] * np.sqrt((my * my).sum(1))[None, :]
            sim = np.divide(mx @ my.T, norms, out=np.zeros_like(norms), where=norms > 0)
            i, j = x[key].to_numpy()[:, None], y[key].to_numpy()[None, :]
            ok = (i != j) & ~((x.both == True).to_numpy()[:, None] & (y.both == True).to_numpy()[None, :] & (i > j))  # noqa: E712
            at = np.flatnonzero(ok)
            flat = sim.ravel()[at]
            if len(at) > k:
                at = at[flat >= np.partition(flat, -k)[-k]]
            r, c = np.unravel_index(at, sim.shape)
            out.append(pd.DataFrame({"source": i[r, 0], "target": j[0, c], "similarity": sim[r, c]}).sort_values(["similarity", "source", "target"], ascending=[False, True, True]).head(k))
        return pd.concat(out) if out else pd.DataFrame({"source": [], "target": [], "similarity": []})

    found = left.groupBy("bs", "bt").cogroup(right.groupBy("bs", "bt")).applyInPandas(best, "source long, target long, similarity double")
    return top_pairs(found, k)


def top_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """The k most similar pairs of all."""
    return pairs.orderBy(F.desc("similarity"), "source", "target").limit(k)


def retained(mappings: DataFrame, n: int = 3) -> DataFrame:
    """Mappings with rank within their target and status: the n best are active, the others retracted."""
    rank = F.row_number().over(W.partitionBy("target").orderBy(F.desc("confidence"), F.desc("similarity"), "source"))
    return mappings.withColumn("rank", rank).withColumn("status", F.when(F.col("rank") <= n, "active").otherwise("retracted"))
