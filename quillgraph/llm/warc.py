"""WARC archives: records with segments and chunked HTTP bodies, written by Spark's text writer and read back whole.

Writing.  One record per page; a payload that another page holds too is stored once (the smallest page_id is the response, the others are
revisits that refer to it).  A record whose block is longer than ``segment_bytes`` becomes a first segment and continuation records.
Spark's text sink writes the bytes of a string column as they are, with the record separator as line end, so archives can go to any store
that Spark can write.

Reading.  Archives are parsed as streams; continuation records are grouped by WARC-Segment-Origin-ID, ordered by WARC-Segment-Number,
checked for gaps and against WARC-Segment-Total-Length, and joined; then the HTTP head is cut off and the chunked framing decoded.

Defined results: null html is an empty payload; null url gives a record without target; null page_id counts as larger than every other
and is kept; a repeated row (same page_id, same payload) repeats the response; an empty table writes an archive without records; columns
beyond page_id, url and html are ignored; a record that lacks segments or bytes has status ``incomplete`` and a null payload.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import fresh_path, settled

SEGMENT_BYTES = 16 * 1024
CHUNK = 4096
END = "\r\n\r\n"
PARSED = "record_id string, record_type string, page_id long, url string, segment int, origin string, total long, refers_to long, digest string, block binary"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hexadecimal digits are eight groups of 20 bits, that is four base-32 digits each."""
    digits = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digits, i, 5), 16, 32), 4, "0") for i in range(1, 40, 5)]
    return F.translate(F.lower(F.concat(*groups)), "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + size]), payload[i : i + size]) for i in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if the framing is broken or the last chunk is missing."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            size = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if size == 0:
            return b"".join(out)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes | None:
    """The decoded HTTP body of a response block."""
    head, gap, body = block.partition(b"\r\n\r\n")
    if not gap:
        return None
    return dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body


def _head(fields: list[tuple[str, object]]) -> bytes:
    return ("WARC/1.1\r\n" + "".join(f"{k}: {str(v).replace(chr(13), ' ').replace(chr(10), ' ')}\r\n" for k, v in fields if v is not None)).encode() + b"\r\n"


def records_of(page_id: int | None, url: str | None, payload: bytes | None, digest: str, first_id: int | None, segment_bytes: int) -> Iterator[bytes]:
    """The records of a page, without the separator: a revisit if payload is None, else a response in one or more segments."""
    # A record is named after its page and its payload, so pages that share a page_id keep their own segments.
    name, about = f"<urn:page:{page_id}:{digest}>", [("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Target-URI", url), ("WARC-Page-ID", page_id)]
    if payload is None:
        yield _head([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *about, ("WARC-Refers-To", f"<urn:page:{first_id}:{digest}>"), ("WARC-Refers-To-Page-ID", first_id), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Length", 0)])
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    for k, piece in enumerate(pieces, 1):
        many, last = len(pieces) > 1, k == len(pieces)
        yield _head([
            ("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", name if k == 1 else f"<urn:page:{page_id}:{digest}:{k}>"), *about,
            ("WARC-Segment-Number", k if many else None), ("WARC-Segment-Origin-ID", name if k > 1 else None), ("WARC-Segment-Total-Length", len(block) if many and last else None),
            ("WARC-Payload-Digest", f"sha1:{digest}" if k == 1 else None), ("Content-Type", "application/http; msgtype=response" if k == 1 else None), ("Content-Length", len(piece)),
        ]) + piece


def write_archives(pages: DataFrame, path: str, segment_bytes: int = SEGMENT_BYTES, min_revisit_bytes: int = 0, records_per_file: int = 20_000) -> None:
    """Write the pages as gzip-compressed WARC files under ``path``."""
    base = pages.select("page_id", "url", F.coalesce(F.col("html").cast("string").cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", base32_sha1(F.col("payload")))
    # Settled, so that the join below is of two plain shuffles, which Spark can split at a hot digest.
    first = settled(base.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id")), "first")
    # Payloads are dealt by (page_id, digest), which no hot payload can skew; the revisits, which may all share one digest, carry no payload.
    f = first.select(F.col("digest").alias("d"), "first_id")
    stored = base.join(f, (F.col("digest") == F.col("d")) & F.col("page_id").eqNullSafe(F.col("first_id"))).drop("d")
    revisits = base.where(F.octet_length("payload") >= min_revisit_bytes).drop("payload").join(f, F.col("digest") == F.col("d")).where(~F.col("page_id").eqNullSafe(F.col("first_id"))).drop("d")
    small = base.where(F.octet_length("payload") < min_revisit_bytes).withColumn("first_id", F.lit(None).cast("long"))
    rows = stored.unionByName(small).unionByName(revisits.withColumn("payload", F.lit(None).cast("binary")))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, size = [], 0
            for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "first_id")), strict=True):
                for x in records_of(*r, segment_bytes):
                    out.append(x)
                    size += len(x)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    lines = rows.select("page_id", "url", "payload", "digest", "first_id").mapInArrow(emit, "value binary")
    lines.select(F.col("value").cast("string").alias("value")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_archive(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an uncompressed stream; ends at a cut-off record."""
    while line := stream.readline():
        if not line.strip():
            continue
        fields: dict[str, str] = {}
        while (line := stream.readline()) and line.strip():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            fields[key.strip().lower()] = value.strip()
        size = int(fields.get("content-length", 0))
        block = stream.read(size)
        if len(block) < size:
            return
        yield fields, block


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "record_type", "page_id", "url", "segment", "origin", "total", "refers_to", "digest", "block"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    whole = lambda x: int(x) if x not in (None, "", "None") else None

    def flush(rows: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_buffer()
            head = raw[:2].to_pybytes()
            stream = io.BytesIO(raw) if head != b"\x1f\x8b" else io.BufferedReader(gzip.GzipFile(fileobj=io.BytesIO(raw)), 1 << 18)
            rows, size = [], 0
            for f, block in parse_archive(stream):
                rows.append((f.get("warc-record-id"), f.get("warc-type"), whole(f.get("warc-page-id")), f.get("warc-target-uri"), whole(f.get("warc-segment-number")), f.get("warc-segment-origin-id"), whole(f.get("warc-segment-total-length")), whole(f.get("warc-refers-to-page-id")), (f.get("warc-payload-digest") or "").removeprefix("sha1:") or None, block))
                size += len(block)
                if size > 4 << 20:
                    yield flush(rows)
                    rows, size = [], 0
            if rows:
                yield flush(rows)


def _decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [payload_of(x) if x is not None else None for x in batch.column("block").to_pylist()]
        at = batch.schema.get_field_index("block")
        yield pa.RecordBatch.from_arrays([pa.array(payloads, pa.binary()) if i == at else batch.column(i) for i in range(batch.num_columns)], ["payload" if i == at else n for i, n in enumerate(batch.schema.names)])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per page record: page_id, url, record_type, refers_to, digest (as the header gives it), payload, status.

    The payload of a revisit is null; it is that of the record it refers to.
    """
    parsed = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_parsed, PARSED)
    alone = parsed.where("segment IS NULL").withColumn("ok", F.lit(True))
    # All rows of one origin are one record: the group is as large as that record, never larger.
    parts = parsed.where("segment IS NOT NULL").withColumn("origin", F.coalesce("origin", "record_id"))
    # A repeated page writes the same segments again; equal segments of one origin count once.
    grouped = parts.groupBy("origin").agg(
        F.array_sort(F.collect_set(F.struct("segment", "block"))).alias("pieces"), F.max("total").alias("total"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("page_id", "url", "digest")), F.sum(F.when(F.col("segment") == 1, 1)).alias("times"),
    )
    complete = (F.element_at("pieces", 1)["segment"] == 1) & (F.element_at("pieces", -1)["segment"] == F.size("pieces"))
    grouped = grouped.withColumn("block", F.aggregate("pieces", F.lit(b""), lambda whole, p: F.concat(whole, p["block"])))
    grouped = grouped.withColumn("ok", F.coalesce(complete & (F.octet_length("block") == F.col("total")), F.lit(False)))
    joined = grouped.withColumn("again", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1))))).select(
        F.col("origin").alias("record_id"), F.lit("response").alias("record_type"), "page_id", "url", F.lit(None).cast("long").alias("refers_to"), "digest", "ok", F.when(F.col("ok"), F.col("block")).alias("block")
    )
    every = alone.select("record_id", "record_type", "page_id", "url", "refers_to", "digest", "ok", F.when(F.col("record_type") == "response", F.col("block")).alias("block")).unionByName(joined)
    out = every.mapInArrow(_decoded, "record_id string, record_type string, page_id long, url string, refers_to long, digest string, ok boolean, payload binary")
    broken = ~F.col("ok") | ((F.col("record_type") == "response") & F.col("payload").isNull())
    return out.select("record_id", "page_id", "url", "record_type", "refers_to", "digest", "payload", F.when(broken, "incomplete").otherwise("whole").alias("status"))


def warc_round_trip(spark: SparkSession, pages: DataFrame, **options) -> DataFrame:
    """Write the pages, read the archives back, and return page_id, payload_bytes, payload_digest, record_type, refers_to per page.

    Length and digest of a revisit are those of the payload of the response that it refers to.
    """
    write_archives(pages, path := fresh_path(spark, "warc"), **options)
    read = settled(read_archives(spark, path).select("page_id", "record_type", "refers_to", "digest", "status", F.octet_length("payload").cast("long").alias("n"), base32_sha1(F.col("payload")).alias("own")), "read")
    answers = read.where("record_type = 'response'")
    kept = answers.select("page_id", F.col("n").alias("payload_bytes"), F.col("own").alias("payload_digest"), "record_type", "refers_to", "status")
    stored = settled(answers.groupBy(F.col("page_id").alias("p"), F.col("own").alias("o")).agg(F.max("n").alias("m")), "stored")
    again = read.where("record_type = 'revisit'").join(stored, F.col("refers_to").eqNullSafe(F.col("p")) & (F.col("digest") == F.col("o")), "left")
    return kept.unionByName(again.select("page_id", F.col("m").alias("payload_bytes"), F.col("o").alias("payload_digest"), "record_type", "refers_to", F.when(F.col("o").isNull(), "incomplete").otherwise("whole").alias("status")))
