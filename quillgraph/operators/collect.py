"""Nested summaries of documents as nodes and edges: one helper for all kinds of records, driven by a table."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.structs import tolerant_json
from quillgraph.operators.build import keep_first


@dataclass(frozen=True)
class Source:
    """Records of one kind: the array that holds them, the fields that make their key (the first group whose fields are all there), and the edge from their document."""

    label: str
    column: str
    keys: tuple[tuple[str, ...], ...]
    name: str
    rel_type: str
    normal: str = "phrase"


def _key(source: Source, record: Column) -> Column:
    fold = t.organisation_key if source.normal == "org" else lambda c: F.lower(F.trim(F.regexp_replace(t.blank(c), r"\s+", " ")))
    groups = []
    for fields in source.keys:
        parts = [fold(record[f]) for f in fields]
        groups.append(F.when(reduce(lambda a, b: a & b, [p != "" for p in parts]), F.concat_ws("|", *parts)))
    return F.coalesce(*groups)


def loaded(docs: DataFrame, sources: list[Source], key: str = "document_id", order: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Nodes (label, key, name; that of the first document) and edges (document_id, rel_type, label, key) of the records of documents.

    A record without any of its keys makes no node; a key's records of all documents are one node.
    """
    rows = []
    for s in sources:
        held = docs.select(key, order, F.posexplode(s.column).alias("_at", "r"))
        rows.append(held.select(key, order, "_at", F.lit(s.label).alias("label"), F.lit(s.rel_type).alias("rel_type"), _key(s, F.col("r")).alias("key"), F.trim(t.blank(F.col("r")[s.name])).alias("name")).where("key IS NOT NULL"))
    every = reduce(DataFrame.unionByName, rows)
    nodes = keep_first(every, ["label", "key"], order, key, "_at").select("label", "key", "name")
    return nodes, every.select(key, "rel_type", "label", "key").distinct()


def summaries(docs: DataFrame, column: str, key: str = "document_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities (document_id, term, category), edges (document_id, term_1, relationship, term_2) and a report (document_id, n_entities, n_edges, skipped).

    A summary is JSON with ``entities`` and ``relationships``; one that cannot be read, or has neither, is skipped and says why.
    """
    kind = "entities array<struct<term: string, category: string>>, relationships array<struct<term_1: string, relationship: string, term_2: string>>"
    parsed = docs.select(key, F.from_json(tolerant_json(F.col(column)), kind).alias("j"), (tolerant_json(F.col(column)) == "").alias("none"))
    ents = F.filter(F.coalesce("j.entities", F.array().cast("array<struct<term: string, category: string>>")), lambda e: F.trim(t.blank(e["term"])) != "")
    rels = F.filter(F.coalesce("j.relationships", F.array().cast("array<struct<term_1: string, relationship: string, term_2: string>>")), lambda r: (F.trim(t.blank(r["term_1"])) != "") & (F.trim(t.blank(r["term_2"])) != ""))
    rows = parsed.select(key, "none", ents.alias("e"), rels.alias("r"))
    entities = rows.select(key, F.explode("e").alias("x")).select(key, F.trim("x.term").alias("term"), t.blank(F.col("x.category")).alias("category")).distinct()
    edges = rows.select(key, F.explode("r").alias("x")).select(key, F.trim("x.term_1").alias("term_1"), t.blank(F.col("x.relationship")).alias("relationship"), F.trim("x.term_2").alias("term_2")).distinct()
    why = F.when(F.col("none"), "no JSON").when((F.size("e") == 0) & (F.size("r") == 0), "empty")
    return entities, edges, rows.select(key, F.size("e").alias("n_entities"), F.size("r").alias("n_edges"), why.alias("skipped"))


def contract(nodes: DataFrame, edges: DataFrame, labels: list[str], id_column: str = "uid") -> DataFrame:
    """check, ok, detail: whether a graph has the labels, ids and paths that the operators rely on."""
    counts = nodes.groupBy("label").agg(F.count("*").alias("n"), F.count(F.nullif(id_column, F.lit(""))).alias("ids"))
    wanted = nodes.sparkSession.createDataFrame([(x,) for x in labels], "label string").join(counts, "label", "left")
    present = wanted.select(F.concat(F.lit("label "), "label").alias("check"), (F.coalesce("n", F.lit(0)) > 0).alias("ok"), F.coalesce("n", F.lit(0)).cast("string").alias("detail"))
    named = wanted.select(F.concat(F.lit("ids of "), "label").alias("check"), (F.coalesce("n", F.lit(0)) == F.coalesce("ids", F.lit(0))).alias("ok"), (F.coalesce("n", F.lit(0)) - F.coalesce("ids", F.lit(0))).cast("string").alias("detail"))
    step = edges.select(F.col("src").alias("_s"), F.col("dst").alias("src")).join(edges.select("src"), "src", "left_semi").limit(1).agg(F.count("*").alias("n"))
    return present.unionByName(named).unionByName(step.select(F.lit("path of two edges").alias("check"), (F.col("n") > 0).alias("ok"), F.col("n").cast("string").alias("detail")))
