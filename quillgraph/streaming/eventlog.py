"""The run log as a stream: files of events come in, checked rows are appended to a table, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from quillgraph.operators.runlog import SEVERITIES

EVENTS = "event_id string, run_id string, operator string, kind string, severity string, ts timestamp, payload string"


def events(spark: SparkSession, path: str, schema: str | StructType = EVENTS, kind: str = "json") -> DataFrame:
    return spark.readStream.schema(schema).format(kind).load(path)


def valid(rows: DataFrame) -> DataFrame:
    """Rows with id, time and a known severity."""
    return rows.where(F.col("event_id").isNotNull() & F.col("ts").isNotNull() & F.coalesce("severity", F.lit("INFO")).isin(SEVERITIES))


def unique(rows: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event once, as long as its copies come within the delay."""
    return rows.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def append(rows: DataFrame, path: str, checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Append to a Parquet table.  Each batch goes to a folder of its own number, so a batch that is repeated after a failure replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def exploded(rows: DataFrame, column: str, schema: str) -> DataFrame:
    """Bulk messages, each a JSON array, as rows."""
    return rows.select(F.explode(F.from_json(column, f"array<struct<{schema}>>")).alias("x")).select("x.*")


def counts(rows: DataFrame, width: str, delay: str = "10 minutes") -> DataFrame:
    """Events per kind and time window; an extension, as the log itself has no windows."""
    return rows.withWatermark("ts", delay).groupBy(F.window("ts", width), "kind").agg(F.count("*").alias("n"))
