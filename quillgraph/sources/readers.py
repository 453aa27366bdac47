"""Readers.  All go through Spark's data sources, so a path may be in any store that Spark can read."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions.structs import tolerant_json
from quillgraph.operators.build import keep_first
from quillgraph.operators.parse import decoded

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def jdbc(spark: SparkSession, url: str, query: str, column: str | None = None, lower: int = 0, upper: int = 0, parts: int = 1, **options: str) -> DataFrame:
    """Rows of a database query; read in ``parts`` ranges of a column if one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=f"({query}) q", **options)
    return (reader.options(partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts) if column else reader).load()


def page_labels(spark: SparkSession, path: str) -> DataFrame:
    """document_id, page_index, label, confidence of JSON lines; lines that are no JSON or have no page number go, the last line of a page wins."""
    schema = "document_id string, page_index string, label string, confidence string, image_path string, _bad string"
    rows = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id()).where(F.trim("value") != "")
    rows = rows.withColumn("j", F.from_json("value", schema, {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"})).where("j._bad IS NULL").select("_at", "j.*").drop("_bad")
    rows = rows.where(F.col("page_index").rlike(r"^\d+$")).withColumns({"page_index": F.col("page_index").cast("int"), "confidence": F.try_to_number("confidence", F.lit("9D9999")).cast("double")})
    return keep_first(rows, ["document_id", "page_index"], F.desc("_at")).drop("_at")


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of files that each hold one JSON array, however it is laid out."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def tolerant(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Rows with ``parsed``: JSON in text that may have code fences, words around it or commas too many; null if that does not help."""
    return rows.withColumn("parsed", F.from_json(tolerant_json(F.col(column)), schema))


def folders(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """document_id, n_files, bytes of the folders of a folder, by name.  Only names and sizes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    out = files.select(F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("document_id"), "length").groupBy("document_id").agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes")).orderBy("document_id")
    return out.limit(limit) if limit else out


def texts(spark: SparkSession, path: str) -> DataFrame:
    """path, text of text files of mixed encodings; null for what is no text."""
    return spark.read.format("binaryFile").load(path).select("path", decoded(F.col("content")).alias("text"))


def zips(spark: SparkSession, path: str, most_bytes: int = 64 << 20) -> DataFrame:
    """document_id, member, content of zip files.  Members with unsafe paths, or larger than ``most_bytes``, have null content and a reason; repeated ids get __2, __3 ..."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for source, raw in zip(rows["path"], rows["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for m in sorted(archive.infolist(), key=lambda m: m.filename):
                        if m.is_dir():
                            continue
                        unsafe = m.filename.startswith(("/", "\\")) or ".." in re.split(r"[/\\]", m.filename) or ":" in m.filename
                        reason = "unsafe path" if unsafe else "too large" if m.file_size > most_bytes else None
                        name = re.sub(r"[^A-Za-z0-9_.-]+", "_", m.filename.rsplit("/", 1)[-1].rsplit(".", 1)[0]).strip("._") or "document"
                        yield pd.DataFrame({"name": [name.lower()], "source": [source], "member": [m.filename], "content": [None if reason else archive.read(m)], "reason": [reason]})

    found = spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "name string, source string, member string, content binary, reason string")
    n = F.row_number().over(W.partitionBy("name").orderBy("source", "member"))
    return found.withColumn("_n", n).select(F.when(F.col("_n") == 1, F.col("name")).otherwise(F.concat("name", F.lit("__"), F.col("_n").cast("string"))).alias("document_id"), "member", "content", "reason")
