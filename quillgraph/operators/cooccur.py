"""Co-occurrence and same-attribute pairs.

Pairs are made within a group (document, message, order), which holds few members; a group's pairs are as many as the square of its size, as
the result holds them all.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pairs(rows: DataFrame, group: str, member: str) -> DataFrame:
    """a, b, n: members that share groups (a < b), and how many."""
    r = rows.select(F.col(group).alias("g"), F.col(member).alias("a")).where("a IS NOT NULL").distinct()
    return r.join(r.select("g", F.col("a").alias("b")), "g").where("a < b").groupBy("a", "b").agg(F.count("*").alias("n"))


def bipartite(left: DataFrame, right: DataFrame, group: str, a: str, b: str) -> DataFrame:
    """a, b, n: members of two kinds in the same group."""
    x, y = left.select(F.col(group).alias("g"), F.col(a).alias("a")).distinct(), right.select(F.col(group).alias("g"), F.col(b).alias("b")).distinct()
    return x.join(y, "g").groupBy("a", "b").agg(F.count("*").alias("n"))


def same_attribute(rows: DataFrame, key: str, attribute: str) -> DataFrame:
    """a, b: pairs of rows with the same non-empty attribute.  The result itself is as large as the square of a group."""
    r = rows.select(F.col(key).alias("a"), F.col(attribute).alias("v")).where("v IS NOT NULL").where(F.col("v").cast("string") != "")
    return r.join(r.select("v", F.col("a").alias("b")), "v").where("a < b").select("a", "b", "v")


def chained(rows: DataFrame, group: str, key: str, rel_type: str, most: int | None = 500) -> DataFrame:
    """src, dst: each member of a group to the next one; linear where pairs would be quadratic; the first ``most`` links of a group, all if None."""
    by = W.partitionBy(group).orderBy(key)
    out = rows.select(F.col(group).alias("g"), F.col(key).alias("src"), F.lead(key).over(by).alias("dst"), F.row_number().over(by).alias("i"))
    out = out if most is None else out.where(F.col("i") <= most)
    return out.where("dst IS NOT NULL").select("g", "src", "dst", F.lit(rel_type).alias("rel_type"))


def next_in_thread(messages: DataFrame, thread: str, order: list[str], key: str) -> DataFrame:
    """Each message to the next of its thread."""
    return messages.select(F.col(thread).alias("thread"), F.col(key).alias("src"), F.lead(key).over(W.partitionBy(thread).orderBy(*order)).alias("dst")).where("dst IS NOT NULL")
