"""Knowledge graph from extraction rows: nodes, edges, endpoint resolution.

Rows that come first win; ``ingest_seq`` says which is first.  Nodes and edges are long tables (kg_id, labels, ...) and (src, dst, rel_type, ...).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.ids import sha_id

# Relation from a page to an entity by the entity's first label; all others have DEFAULT_RELATION.
MENTION_RELATIONS = {
    "Person": "MENTIONS_PERSON", "Organization": "MENTIONS_ORG", "Drug": "MENTIONS_DRUG", "Product": "MENTIONS_PRODUCT", "Location": "MENTIONS_LOCATION_IN_TEXT",
    "Gpe": "MENTIONS_LOCATION_IN_TEXT", "HealthMention": "MENTIONS_HEALTH", "Health": "MENTIONS_HEALTH", "MedicalCondition": "MENTIONS_HEALTH", "DateMention": "MENTIONS_DATE",
    "Date": "MENTIONS_DATE", "Event": "HAS_EVENT", "Risk": "HAS_RISK", "Decision": "HAS_DECISION", "Requirement": "HAS_REQUIREMENT", "LegalFramework": "HAS_REQUIREMENT",
    "Regulation": "HAS_REQUIREMENT", "Claim": "HAS_CLAIM", "Topic": "HAS_CLAIM", "DocumentEntity": "CITES", "AbbreviationEntity": "HAS_ABBREVIATION",
    "Identifier": "HAS_IDENTIFIER", "Procedure": "HAS_PROCEDURE", "Assessment": "HAS_RISK", "Finance": "HAS_FINANCE", "Metric": "HAS_METRIC",
}
DEFAULT_RELATION = "HAS_CLAIM"


def keep_first(df: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key; dropDuplicates would keep any."""
    return df.withColumn("_rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def mention_relation(label: Column) -> Column:
    pairs = [F.lit(x) for kv in MENTION_RELATIONS.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), label), F.lit(DEFAULT_RELATION))


def abbreviation_map(entities: DataFrame) -> DataFrame:
    """abbr, canonical, label for abbreviations that stand for one term of one label."""
    rows = entities.select(F.lower(t.abbreviation(F.col("term"))).alias("abbr"), t.canonical_term(F.col("term")).alias("canonical"), F.get(t.labels(F.col("top_category"), F.col("specific_category")), F.lit(0)).alias("label"))
    rows = rows.where("abbr IS NOT NULL AND label IS NOT NULL")
    return rows.groupBy("abbr").agg(F.min("canonical").alias("canonical"), F.min("label").alias("label"), F.countDistinct("canonical", "label").alias("n")).where("n = 1").drop("n")


def canonical_rows(entities: DataFrame) -> DataFrame:
    """Extraction rows with name, labels, abbreviation and kg_id; a bare term that is a known abbreviation takes its full form.  Rows without label go."""
    short = abbreviation_map(entities).select("abbr", "canonical", "label")
    rows = entities.withColumns({"_name": t.canonical_term(F.col("term")), "abbreviation": t.abbreviation(F.col("term")), "_labels": t.labels(F.col("top_category"), F.col("specific_category"))})
    rows = rows.where((F.size("_labels") > 0) & (F.trim(F.coalesce("term", F.lit(""))) != ""))
    rows = rows.join(short, F.col("abbreviation").isNull() & (F.lower("_name") == F.col("abbr")), "left")
    turned = F.array_distinct(F.concat(F.array("label"), F.slice("_labels", 2, 10)))
    rows = rows.withColumns({"name": F.coalesce("canonical", "_name"), "labels": F.when(F.col("label").isNotNull(), turned).otherwise(F.col("_labels"))})
    return rows.withColumn("kg_id", sha_id("entity_weak", F.get("labels", F.lit(0)), F.lower("name"))).drop("_name", "_labels", "abbr", "canonical", "label")


def entity_nodes(rows: DataFrame) -> DataFrame:
    """One node per (first label, lower-case name): name, confidence of the first row; labels in the order in which they were first seen."""
    first = rows.groupBy("kg_id").agg(F.min_by(F.struct("name", "confidence"), "ingest_seq").alias("f"))
    seen = rows.select("kg_id", "ingest_seq", F.posexplode("labels").alias("pos", "label")).groupBy("kg_id", "label").agg(F.min(F.struct("ingest_seq", "pos")).alias("at"))
    ordered = seen.groupBy("kg_id").agg(F.array_sort(F.collect_list(F.struct("at", "label"))).alias("x")).select("kg_id", F.col("x.label").alias("labels"))
    return first.join(ordered, "kg_id").select("kg_id", "f.name", "labels", "f.confidence")


def abbreviations(rows: DataFrame) -> DataFrame:
    """Distinct abbreviation nodes with the edges to what they stand for: src (entity), dst (abbreviation), abbreviation."""
    found = rows.where("abbreviation IS NOT NULL").select(F.col("kg_id").alias("src"), F.upper("abbreviation").alias("abbreviation")).distinct()
    return found.withColumn("dst", sha_id("abbreviation", F.lower("abbreviation"))).select("src", "dst", "abbreviation")


def page_nodes(documents: DataFrame, labelled: DataFrame, mentioned: DataFrame) -> DataFrame:
    """Pages known from labels or mentions, and page 0 for documents without any; what labels say wins."""
    both = labelled.select("document_id", "page", "label", F.lit(0).alias("_from")).unionByName(mentioned.where("page IS NOT NULL").select("document_id", "page", F.lit(None).cast("string").alias("label"), F.lit(1).alias("_from")))
    known = both.groupBy("document_id", "page").agg(F.min(F.struct("_from", "label")).alias("x")).select("document_id", "page", F.col("x.label").alias("label"))
    bare = documents.select("document_id").distinct().join(known, "document_id", "left_anti").select("document_id", F.lit(0).alias("page"), F.lit(None).cast("string").alias("label"))
    every = known.join(documents.select("document_id").distinct(), "document_id", "left_semi").unionByName(bare)
    return every.withColumn("kg_id", sha_id("page_strong", F.col("document_id"), F.col("page")))


def mention_edges(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Page to entity; a mention without known page goes to page 0 if there is one, else nowhere.  Witnesses are merged, first seen first.

    A witness is left out if the text so far contains it, so the text is a fold over the rows of one (page, entity), in order.
    """
    known = pages.select("document_id", "page", F.col("kg_id").alias("page_id"))
    zero = known.where("page = 0").select("document_id", F.col("page_id").alias("zero_id"))
    linked = rows.join(known, (rows["document_id"] == known["document_id"]) & (rows["page_number"] == known["page"]), "left").drop(known["document_id"])
    linked = linked.join(zero, "document_id", "left").withColumn("src", F.coalesce("page_id", "zero_id")).where("src IS NOT NULL")
    linked = linked.withColumn("rel_type", mention_relation(F.get("labels", F.lit(0))))
    # A witness that comes again adds nothing to the text, so each is gathered once.
    once = linked.groupBy("src", F.col("kg_id").alias("dst"), "rel_type", F.trim(F.coalesce("witness", F.lit(""))).alias("w")).agg(F.min("ingest_seq").alias("ingest_seq"), F.count("*").alias("n"))
    ordered = once.groupBy("src", "dst", "rel_type").agg(F.array_sort(F.collect_list(F.struct("ingest_seq", "w"))).alias("x"), F.sum("n").alias("n_mentions"))
    merged = F.aggregate("x", F.lit(""), lambda acc, s: F.when((s["w"] == "") | F.contains(acc, s["w"]), acc).when(acc == "", s["w"]).otherwise(F.concat(acc, F.lit(" | "), s["w"])))
    return ordered.select("src", "dst", "rel_type", merged.alias("witness"), F.col("n_mentions").cast("int").alias("n_mentions"))


def resolve_endpoints(queries: DataFrame, rows: DataFrame) -> DataFrame:
    """query, kg_id, tier: five ways in falling precision, each tried for what the ones before have left.

    exact, abbrev_alias: by lower-case name or abbreviation; normalized, token_set: by key, if one entity has it; token_sub: if the tokens of one
    entity only contain, or are contained in, the query's, the smaller set being substantive.  The smaller set is wholly in the larger, so either meets the
    other on its own rarest token (fewest entities have it), never on a common one only.
    """
    entities = rows.select("kg_id", "name", "ingest_seq", "abbreviation")
    asked = queries.select("query").where("query IS NOT NULL").distinct().withColumn("q", t.canonical_term(F.col("query")))
    asked = asked.withColumns({"low": F.lower("q"), "norm": t.match_key(F.col("q")), "toks": t.token_key(F.col("q"))}).where("low <> ''")
    exact = entities.groupBy(F.lower("name").alias("key")).agg(F.min_by("kg_id", "ingest_seq").alias("found"))
    alias = entities.where("abbreviation IS NOT NULL").groupBy(F.lower("abbreviation").alias("key")).agg(F.min_by("kg_id", "ingest_seq").alias("found"))
    only = lambda key: entities.withColumn("key", key).where("key <> ''").groupBy("key").agg(F.min("kg_id").alias("found"), F.countDistinct("kg_id").alias("n")).where("n = 1").drop("n")
    steps = [(exact, F.col("low"), "exact"), (alias, F.col("low"), "abbrev_alias"), (only(t.match_key(F.col("name"))), F.col("norm"), "normalized"), (only(F.array_join(t.token_key(F.col("name")), " ")), F.array_join("toks", " "), "token_set")]
    found = asked
    for i, (table, key, _) in enumerate(steps):
        found = found.join(table.select(F.col("key").alias(f"k{i}"), F.col("found").alias(f"f{i}")), key == F.col(f"k{i}"), "left").drop(f"k{i}")
    tier = F.coalesce(*[F.when(F.col(f"f{i}").isNotNull(), F.lit(name)) for i, (_, _, name) in enumerate(steps)])
    found = found.withColumns({"kg_id": F.coalesce(*[F.col(f"f{i}") for i in range(4)]), "tier": tier})
    # Subset tier: number of shared distinct tokens equals the smaller set's size.
    sets = entities.select("kg_id", F.array_distinct(t.token_key(F.col("name"))).alias("etoks")).distinct().where(F.size("etoks") > 0)
    open_ = found.where("tier IS NULL").where(F.size("toks") >= 2).select("query", F.array_distinct("toks").alias("qtoks"))
    held = sets.select("kg_id", "etoks", F.explode("etoks").alias("tok"))
    wanted = open_.select("query", "qtoks", F.explode("qtoks").alias("tok"))
    common = held.groupBy("tok").agg(F.count("*").alias("n"))
    # A token that no entity has is the rarest of all: what holds it is contained in nothing.
    rarest = lambda df, *keys: df.join(common, "tok", "left").groupBy(*keys).agg(F.min_by("tok", F.struct(F.coalesce("n", F.lit(0)), "tok")).alias("tok"))
    inside = rarest(wanted, "query", "qtoks").join(held, "tok").where(F.size(F.array_except("qtoks", "etoks")) == 0).select("query", "kg_id", F.col("qtoks").alias("both"))
    around = rarest(held, "kg_id", "etoks").join(wanted, "tok").where(F.size(F.array_except("etoks", "qtoks")) == 0).select("query", "kg_id", F.col("etoks").alias("both"))
    hits = inside.unionByName(around).where(t.substantive(F.col("both")))
    sub = hits.groupBy("query").agg(F.min("kg_id").alias("sub_id"), F.countDistinct("kg_id").alias("n")).where("n = 1").drop("n")
    out = found.join(sub, "query", "left")
    return out.select("query", F.coalesce("kg_id", "sub_id").alias("kg_id"), F.coalesce("tier", F.when(F.col("sub_id").isNotNull(), "token_sub"), F.lit("miss")).alias("tier"))


def relation_edges(edges: DataFrame, rows: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    """Entity to entity where both ends resolve; ``relations`` (slug, canonical) renames types, and drops those with null."""
    ends = resolve_endpoints(edges.select(F.col("term_1").alias("query")).unionByName(edges.select(F.col("term_2").alias("query"))), rows).where("kg_id IS NOT NULL").select("query", "kg_id")
    a, b = ends.select(F.col("query").alias("term_1"), F.col("kg_id").alias("src")), ends.select(F.col("query").alias("term_2"), F.col("kg_id").alias("dst"))
    out = edges.join(a, "term_1").join(b, "term_2").withColumn("rel_type", t.slug(F.col("relationship")))
    if relations is not None:
        out = out.join(relations.select(F.col("slug").alias("rel_type"), "canonical", F.lit(True).alias("_known")), "rel_type", "left")
        out = out.where("_known IS NULL OR canonical IS NOT NULL").withColumn("rel_type", F.coalesce("canonical", "rel_type")).drop("canonical", "_known")
    return out.groupBy("src", "dst", "rel_type").agg(F.max_by("confidence", "ingest_seq").alias("confidence"), F.count("*").alias("n_rows"))


def dominant_label(rows: DataFrame, group: str, label: str, order: str, default: str) -> DataFrame:
    """Most frequent label of each group, ties to the first seen; the default for groups without any."""
    counted = rows.groupBy(group, label).agg(F.count(label).alias("n"), F.min(order).alias("first")).where(F.col(label).isNotNull())
    best = keep_first(counted, [group], F.desc("n"), "first").select(group, F.col(label).alias("dominant"))
    return rows.select(group).distinct().join(best, group, "left").select(group, F.coalesce("dominant", F.lit(default)).alias("dominant"))


def documents_with_catalog(documents: DataFrame, catalog: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Documents with what the catalog says, empty text where it says nothing."""
    joined = documents.join(catalog.select(key, *fields), key, "left")
    return joined.withColumns({f: F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields})


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The latest row of each key of both tables."""
    return keep_first(old.unionByName(new), keys, F.desc(order))


def replace_documents(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """All rows of documents that come again are replaced."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def duplicates_of_key(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are not unique: must be empty."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
