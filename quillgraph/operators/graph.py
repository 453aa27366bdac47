"""Graph traversals by bounded iterations of joins; each round's table is checkpointed to the shared folder, so the lineage stays short."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names; a temporary one only where driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="quillgraph-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Eager checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def numbered(df: DataFrame, name: str, *order) -> DataFrame:
    """Rows numbered from 1 in an order: ranges of it are numbered each by itself and moved on by the size of the ranges before."""
    keys = [F.col(c) if isinstance(c, str) else c for c in order]
    ranged = checkpointed(df.repartitionByRange(*keys).withColumn("_range", F.spark_partition_id()))
    sizes = ranged.groupBy("_range").agg(F.count("*").alias("_size"))  # one row per range
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select("_range", "_before")
    out = ranged.withColumn(name, F.row_number().over(W.partitionBy("_range").orderBy(*keys))).join(F.broadcast(before), "_range")
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")


def both_ways(edges: DataFrame) -> DataFrame:
    rows = edges.select("src", "dst", "rel_type", "uid")
    return rows.unionByName(rows.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "rel_type", "uid"))


def hops(edges: DataFrame, starts: DataFrame, most: int, directed: bool = True, types: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """start, node, hops, path (relation types of the first such trail by name): trails of up to ``most`` edges, none of them twice."""
    e = edges.where(F.col("rel_type").isin(types)) if types else edges
    e = (e.select("src", "dst", "rel_type", "uid") if directed else both_ways(e)).select(F.col("src").alias("_s"), F.col("dst").alias("_d"), F.col("rel_type").alias("_r"), F.col("uid").alias("_u"))
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array().cast("array<string>").alias("path"), F.array().cast("array<string>").alias("used"))
    found = []
    for n in range(1, most + 1):
        front = front.join(e, F.col("node") == F.col("_s")).where(~F.array_contains("used", F.col("_u").cast("string")))
        front = front.select("start", F.col("_d").alias("node"), F.concat("path", F.array("_r")).alias("path"), F.concat("used", F.array(F.col("_u").cast("string"))).alias("used"))
        front = checkpointed(front) if n < most else front
        found.append(front.select("start", "node", F.lit(n).alias("hops"), "path"))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    out = out.groupBy("start", "node").agg(F.min(F.struct("hops", "path")).alias("x")).select("start", "node", "x.hops", F.array_join("x.path", ">").alias("path"))
    if limit:
        out = out.withColumn("_i", F.row_number().over(W.partitionBy("start").orderBy("hops", "node"))).where(F.col("_i") <= limit).drop("_i")
    return out


def distances(edges: DataFrame, starts: DataFrame, most: int, directed: bool = False) -> DataFrame:
    """start, node, hops: breadth first, each node once."""
    rows = edges.select("src", "dst") if directed else edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    rows = rows.distinct().select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("hops")).distinct()
    front = seen
    for n in range(1, most + 1):
        step = front.join(rows, F.col("node") == F.col("_s")).select("start", F.col("_d").alias("node")).distinct()
        front = checkpointed(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("hops", F.lit(n)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def induced(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges between nodes of a set."""
    i = ids.select(F.col("id")).distinct()
    return edges.join(i.select(F.col("id").alias("src")), "src", "left_semi").join(i.select(F.col("id").alias("dst")), "dst", "left_semi")


def focus(nodes: DataFrame, edges: DataFrame, centre: DataFrame, most: int, cap: int = 90) -> DataFrame:
    """The centre's neighbourhood, nearest first, up to ``cap`` nodes: a view of a graph, not the graph."""
    near = distances(edges, centre, most).groupBy(F.col("node").alias("id")).agg(F.min("hops").alias("hops"))
    return nodes.join(near, "id").orderBy("hops", "id").limit(cap)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, component (the smallest node reachable): labels fall along edges and jump to their own label's label until none changes."""
    e = edges.select("a", "b").where("a <> b")
    e = checkpointed(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(e.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node")))
    for _ in range(most_rounds):
        near = e.join(label.select(F.col("node").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("node")).agg(F.min("c").alias("c"))
        low = label.join(near, "node").select("node", F.least("component", "c").alias("low"), F.col("component").alias("old"))
        jump = low.join(label.select(F.col("node").alias("low"), F.col("component").alias("far")), "low").select("node", F.least("low", "far").alias("component"), "old")
        jump = checkpointed(jump)
        label = jump.select("node", "component")
        if jump.where("component <> old").isEmpty():
            return label
    raise RuntimeError("components did not settle")


def cyclic(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """Edges that remain when nodes without way on or way back are taken off, again and again: empty if there is no cycle."""
    left = checkpointed(edges.select("src", "dst").distinct())
    n = left.count()
    for _ in range(most_rounds):
        left = checkpointed(left.join(left.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi").join(left.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").select("src", "dst"))
        now = left.count()
        if now in (n, 0):
            break
        n = now
    return left


def closure(edges: DataFrame, most_rounds: int = 30) -> DataFrame:
    """src, dst: the transitive closure; each round joins only what the last one has found."""
    base = checkpointed(edges.select("src", "dst").distinct())
    every, fresh = base, base
    for _ in range(most_rounds):
        step = fresh.join(base.select(F.col("src").alias("dst"), F.col("dst").alias("_far")), "dst").select("src", F.col("_far").alias("dst")).distinct()
        fresh = checkpointed(step.join(every, ["src", "dst"], "left_anti"))
        if fresh.isEmpty():
            return every
        every = checkpointed(every.unionByName(fresh))
    raise RuntimeError("closure did not settle")


def evidence_preview(nodes: DataFrame, edges: DataFrame, root: DataFrame, cap: int = 60) -> DataFrame:
    """Root, its witnesses, their neighbours: by that order of priority, ``cap`` nodes."""
    near = distances(edges, root, 2).groupBy(F.col("node").alias("id")).agg(F.min("hops").alias("hops"))
    rank = F.when(F.col("hops") == 0, 0).when((F.col("hops") == 1) & (F.col("kind") == "witness"), 1).when(F.col("hops") == 1, 2).otherwise(3)
    return nodes.join(near, "id").withColumn("priority", rank).orderBy("priority", "id").limit(cap)
