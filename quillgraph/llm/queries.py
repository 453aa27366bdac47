"""The queries opN_<name> and the SQL that states them for those that SQL can express.  Each is a thin projection of its operator's output."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import decontaminate, hmm_lm, html_text, language_id, learned_ann, mixing, quality_fm, simhash_dedup, substring_dedup, warc
from quillgraph.llm.common import crc_mod, table


def op1_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"))


def op2_hmm(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", (crc_mod(F.col("doc_id"), 7) == 2).alias("held_out"))
    return hmm_lm.score(docs)


def op3_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    cut = substring_dedup.remove_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op4_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text", "n_chars")
    held_out = crc_mod(F.col("doc_id"), 5) == 0
    model = quality_fm.train(docs, table(spark, folder, "labels"), ~held_out)
    return quality_fm.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality_fm.THRESHOLD).cast("int").alias("predicted"))


def op5_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = crc_mod(F.col("doc_id"), 3) == 1
    model = language_id.train(docs, ~held_out)
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash_dedup.near_duplicates(table(spark, folder, "documents"))


def op7_source_mix(spark: SparkSession, folder: str) -> DataFrame:
    mixed = mixing.mix(table(spark, folder, "documents").select("doc_id", "source", "text"), keep_text=False)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op9_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.warc_round_trip(spark, table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_ann(spark: SparkSession, folder: str) -> DataFrame:
    return learned_ann.nearest(table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_text": op1_html_text,
    "op2_hmm": op2_hmm,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_quality": op4_quality,
    "op5_language": op5_language,
    "op6_simhash": op6_simhash,
    "op7_source_mix": op7_source_mix,
    "op8_decontaminate": op8_decontaminate,
    "op9_warc": op9_warc,
    "op10_ann": op10_ann,
}

OP7_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS token,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s1 AS (SELECT source, source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS idx
       FROM (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source)),
s2 AS (SELECT *, CASE idx % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w, source_size * 3 AS cap FROM s1),
s3 AS (SELECT *, sum(source_size) OVER () AS whole,
         sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM s2),
s4 AS (SELECT *, min(CASE WHEN cap::DOUBLE * weights_left::DOUBLE < w::DOUBLE * rest::DOUBLE THEN 1 ELSE 0 END)
         OVER (ORDER BY cap::DOUBLE / w, idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS is_full FROM s3),
s5 AS (SELECT *, CASE WHEN is_full = 0 THEN w::DOUBLE * (whole - coalesce(sum(CASE WHEN is_full = 1 THEN cap END) OVER (), 0))::DOUBLE
         / (sum(CASE WHEN is_full = 0 THEN w END) OVER ())::DOUBLE ELSE cap::DOUBLE END AS target FROM s4),
v1 AS (SELECT idx, target AS votes, CAST(round(whole / 16.0) AS BIGINT) AS total FROM s5),
q1 AS (SELECT *, total * votes / sum(votes) OVER () AS q, count(*) OVER () AS k FROM v1 WHERE votes > 0 AND total > 0),
r1 AS (SELECT *, greatest(0, CAST(floor(q - q * k / (2 * total) - 1) AS BIGINT)) AS lo, CAST(ceil(q + q * k / (2 * total) + 1) AS BIGINT) AS hi FROM q1),
c1 AS (SELECT idx, lo, total - sum(lo) OVER () AS open_seats, votes, hi FROM r1),
e1 AS (SELECT idx, lo, open_seats, n, votes / (2 * n + 1) AS quotient FROM (SELECT *, unnest(range(lo, hi)) AS n FROM c1)),
k1 AS (SELECT *, row_number() OVER (ORDER BY quotient DESC, idx, n) AS rank FROM e1),
w1 AS (SELECT idx, max(lo) + sum(CASE WHEN rank <= open_seats THEN 1 ELSE 0 END) AS quota FROM k1 GROUP BY idx),
dealt AS (
  SELECT d.*, s5.idx, s5.source_size, s5.target, coalesce(w1.quota, 0) AS quota,
         CAST('0x' || substr(token, 1, 8) AS BIGINT) % greatest(1, CAST(ceil(s5.source_size / 131072.0) AS BIGINT)) AS shard
  FROM d JOIN s5 ON d.source IS NOT DISTINCT FROM s5.source LEFT JOIN w1 USING (idx)),
v2 AS (SELECT idx, shard, CAST(sum(size) AS BIGINT) AS votes, CAST(max(quota) AS BIGINT) AS total FROM dealt GROUP BY idx, shard),
q2 AS (SELECT *, total * votes::DOUBLE / sum(votes) OVER (PARTITION BY idx) AS q, count(*) OVER (PARTITION BY idx) AS k FROM v2 WHERE votes > 0 AND total > 0),
r2 AS (SELECT *, greatest(0, CAST(floor(q - q * k / (2 * total) - 1) AS BIGINT)) AS lo, CAST(ceil(q + q * k / (2 * total) + 1) AS BIGINT) AS hi FROM q2),
c2 AS (SELECT idx, shard, lo, total - sum(lo) OVER (PARTITION BY idx) AS open_seats, votes, hi FROM r2),
e2 AS (SELECT idx, shard, lo, open_seats, n, votes::DOUBLE / (2 * n + 1) AS quotient FROM (SELECT *, unnest(range(lo, hi)) AS n FROM c2)),
k2 AS (SELECT *, row_number() OVER (PARTITION BY idx ORDER BY quotient DESC, shard, n) AS rank FROM e2),
w2 AS (SELECT idx, shard, max(lo) + sum(CASE WHEN rank <= open_seats THEN 1 ELSE 0 END) AS seats FROM k2 GROUP BY idx, shard),
placed AS (
  SELECT dealt.*, coalesce(w2.seats, 0) AS seats, sum(size) OVER (PARTITION BY idx, shard) AS whole,
         sum(size) OVER (PARTITION BY idx, shard ORDER BY token, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM dealt LEFT JOIN w2 USING (idx, shard)),
wanted AS (SELECT *, least(seats * 16, whole * 3) AS want FROM placed)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN whole > 0 THEN (want // whole) * size + greatest(0, least(upto, want % whole) - (upto - size)) ELSE 0 END AS BIGINT) AS taken
FROM wanted
"""

OP9_SQL = r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
h AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
g AS (SELECT *, list_transform(range(0, 8), lambda i: CAST('0x' || substr(hex, CAST(i * 5 + 1 AS INTEGER), 5) AS BIGINT)) AS parts FROM h),
b AS (SELECT page_id, payload_bytes, array_to_string(list_transform(range(0, 32),
        lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(((parts[CAST(i // 4 + 1 AS INTEGER)] // CAST(power(32, 3 - i % 4) AS BIGINT)) % 32) + 1 AS INTEGER), 1)), '') AS payload_digest FROM g),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM b GROUP BY payload_digest)
SELECT b.page_id, b.payload_bytes, b.payload_digest,
       CASE WHEN b.page_id IS NOT DISTINCT FROM f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN b.page_id IS NOT DISTINCT FROM f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM b JOIN f USING (payload_digest)
"""

ORACLE_SQL: dict[str, str] = {"op7_source_mix": OP7_SQL, "op9_warc": OP9_SQL}
