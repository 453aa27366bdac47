"""Writers.  A keyed table is a folder per version and a file that names the current one, as Parquet has no update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import dates
from quillgraph.functions import text as t
from quillgraph.operators.build import dominant_label, duplicates_of_key, keep_first, replace_documents, upsert


def write_upsert(old: DataFrame | None, new: DataFrame, keys: list[str], order: str, path: str) -> None:
    """The latest row of each key of both tables, written to a new folder; the old one is left to its readers."""
    (keep_first(new, keys, F.desc(order)) if old is None else upsert(old, new, keys, order)).write.mode("error").parquet(path)


def write_replacing(old: DataFrame, new: DataFrame, key: str, path: str) -> None:
    replace_documents(old, new, key).write.mode("error").parquet(path)


def write_partitioned(df: DataFrame, key: str, path: str) -> None:
    """Replaces the partitions that the rows belong to and leaves the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(key).parquet(path)


def unique_edges(edges: DataFrame, keys: list[str], order: str) -> DataFrame:
    return keep_first(edges, keys, order)


def assert_unique(df: DataFrame, keys: list[str]) -> None:
    bad = duplicates_of_key(df, keys).limit(5).collect()
    if bad:
        raise ValueError(f"keys are not unique: {bad}")


def search_documents(pages: DataFrame, catalog: DataFrame) -> DataFrame:
    """document_id, title, family (dominant page label in capitals), page_count, body, date of pages (document_id, page, label, text)."""
    body = pages.groupBy("document_id").agg(F.countDistinct("page").alias("page_count"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: p["text"]), "\n").alias("body"))
    family = dominant_label(pages, "document_id", "label", "page", "document").select("document_id", F.upper("dominant").alias("family"))
    out = body.join(family, "document_id").join(catalog.select("document_id", "title", "dd"), "document_id", "left")
    return out.select("document_id", F.coalesce("title", F.lit("")).alias("title"), "family", "page_count", "body", dates.newest_day(F.col("dd")).alias("date"))


def page_points(pages: DataFrame, vectors: DataFrame, dim: int) -> DataFrame:
    """Page vectors with their label, else the document's dominant one; a vector of another length raises."""
    family = dominant_label(pages, "document_id", "label", "page", "unknown")
    out = pages.join(vectors, ["document_id", "page"]).join(family, "document_id")
    checked = F.when(F.size("vector") == dim, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of length "), F.size("vector").cast("string"))))
    return out.select("document_id", "page", F.coalesce("label", "dominant").alias("label"), checked.alias("vector"))


def spool(rows: DataFrame, key: str, path: str) -> None:
    """One JSON array per document."""
    fields = [c for c in rows.columns if c != key]
    packed = rows.groupBy(key).agg(F.to_json(F.array_sort(F.collect_list(F.struct(*fields)))).alias("value"))
    packed.select("value").write.mode("error").text(path)


def report(sections: DataFrame) -> DataFrame:
    """run_id, markdown of sections (run_id, position, title, body)."""
    part = F.concat(F.lit("## "), F.col("title"), F.lit("\n\n"), t.blank(F.col("body")))
    return sections.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", part.alias("x")))), lambda s: s["x"]), "\n\n").alias("markdown"))
