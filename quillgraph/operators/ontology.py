"""Categories and edge types: expansion along a hierarchy, compatibility with slots, names in the graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.graph import closure

# Abstract categories of intents with the categories that extraction yields for them.
HIERARCHY = {
    "ENTITY_EVENT": ["ENTITY_LEGAL", "ENTITY_ACTION_ITEM"],
    "ENTITY_ACTION_ITEM": ["ENTITY_LEGAL", "ENTITY_OTHER"],
    "ENTITY_DOCUMENT": ["ENTITY_DOCUMENT_REF", "ARTIFACT_DOCUMENT"],
    "ENTITY_TEXT_SPAN": ["ENTITY_OTHER", "ENTITY_DOCUMENT_REF"],
    "ENTITY_VISIBILITY_LEVEL": ["ENTITY_OTHER"],
    "ENTITY_COLLECTION": ["ENTITY_OTHER"],
    "ENTITY_CONCEPT": ["ENTITY_OTHER", "ENTITY_LEGAL"],
    "ENTITY_CLAIM": ["ENTITY_OTHER", "ENTITY_LEGAL"],
    "ENTITY_RISK_FINDING": ["ENTITY_OTHER", "ENTITY_LEGAL"],
    "ENTITY_POLICY": ["ENTITY_LEGAL", "ENTITY_OTHER"],
}
# Abstract edge types with the relationships that the graph stores for them.
EDGE_ALIASES = {
    "AFFILIATED_WITH": ["WORKS_FOR", "OWNS", "MENTIONS_ORG"],
    "REPRESENTS": ["WORKS_FOR", "MENTIONS_PERSON"],
    "AUTHORED_BY": ["MENTIONS_PERSON", "SENT_TO", "FORWARDED_TO"],
    "ABOUT": ["HAS_EVENT", "HAS_CLAIM", "HAS_RISK", "CONCERNS", "ASKED_ABOUT"],
    "INVOLVED_IN": ["MENTIONS_PERSON", "HAS_EVENT", "HAS_CLAIM"],
    "COORDINATED_RESPONSE_TO": ["HAS_EVENT", "CONCERNS", "HAS_CLAIM"],
    "EVIDENCED_BY": ["HAS_PAGE", "CONTAINS_DOCUMENTS", "CITES"],
    "QUOTES_SPAN": ["HAS_CLAIM", "HAS_RISK", "MENTIONS_PERSON"],
    "INTERNAL_ONLY": [],
}


def index(spark: SparkSession, default: dict[str, list[str]], given: DataFrame | None, key: str, value: str) -> DataFrame:
    """key, value, position: a table of lists; what ``given`` has for a key replaces the default's list."""
    rows = spark.createDataFrame([(k, x, i) for k, xs in default.items() for i, x in enumerate(xs or [None])], f"{key} string, {value} string, position int")
    return rows if given is None else given.select(key, value, "position").unionByName(rows.join(given.select(key).distinct(), key, "left_anti"))


def expanded(rows: DataFrame, column: str, hierarchy: DataFrame) -> DataFrame:
    """column, category: every category with itself and all below it; ``hierarchy``: parent, child."""
    below = closure(hierarchy.where("child IS NOT NULL").select(F.col("parent").alias("src"), F.col("child").alias("dst")))
    start = rows.select(column).distinct().withColumn("src", F.upper(column))
    return start.select(column, F.col("src").alias("category")).unionByName(start.join(F.broadcast(below), "src").select(column, F.col("dst").alias("category"))).distinct()


def compatible(rows: DataFrame, slots: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Rows (slot_type, category) that a slot takes: a category of its own, or a child of one.  ``slots``: slot_type, category."""
    takes = slots.select("slot_type", F.col("category").alias("_c"))
    takes = takes.unionByName(takes.join(hierarchy.where("child IS NOT NULL").select(F.col("parent").alias("_c"), "child"), "_c").select("slot_type", F.col("child").alias("_c"))).distinct()
    return rows.withColumn("_c", F.upper("category")).join(F.broadcast(takes), ["slot_type", "_c"], "left_semi").drop("_c")


def role_fits(rows: DataFrame, keywords: DataFrame) -> DataFrame:
    """Rows (slot_type, role) with ``fits``: the role holds a keyword of its slot.  ``keywords``: slot_type, keyword."""
    words = keywords.groupBy("slot_type").agg(F.collect_set("keyword").alias("_words"))
    hit = F.exists("_words", lambda w: F.contains(F.lower("role"), w))
    return rows.join(F.broadcast(words), "slot_type", "left").withColumn("fits", F.coalesce(hit, F.lit(False))).drop("_words")


def graph_labels(rows: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """column, label: labels of a category, by its name, else by that without its prefix, else the name itself.  ``labels``: category, label."""
    names = rows.select(column).distinct().withColumns({"_a": F.upper(column), "_b": F.regexp_replace(F.upper(column), "^(?:ENTITY_|ARTIFACT_)", "")})
    by = lambda c, out: labels.groupBy(F.upper("category").alias(c)).agg(F.collect_list("label").alias(out))
    met = names.join(by("_a", "_x"), "_a", "left").join(by("_b", "_y"), "_b", "left")
    return met.select(column, F.explode(F.coalesce("_x", "_y", F.array(column))).alias("label"))


def edge_types(rows: DataFrame, column: str, aliases: DataFrame, known: list[str]) -> DataFrame:
    """column, rel_type: relationships that satisfy an edge type: those of its alias (maybe none), else a stored one of that name, else the type as it is."""
    lists = aliases.groupBy("edge_type").agg(F.collect_list("rel_type").alias("_list"))
    up = F.upper(column)
    own = F.when(up.isin(known), F.array(up)).otherwise(F.array(F.col(column)))
    return rows.select(column).distinct().withColumn("edge_type", up).join(F.broadcast(lists), "edge_type", "left").select(column, F.explode(F.coalesce("_list", own)).alias("rel_type"))
