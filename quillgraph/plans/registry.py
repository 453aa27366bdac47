"""Registry of queries.  The test tables hold no extraction rows, so queries derive them by proxies: SQL that Spark and the oracle both run."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillgraph.sources.readers import TABLES, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Extraction rows and graphs out of parts, orders, events and texts.
PROXIES = {
    "raw_entities": """
        SELECT p_partkey AS ingest_seq, p_brand AS collection_name, 'd' || CAST(p_partkey % 97 AS STRING) AS document_id,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size % 4 END AS page_number,
               CASE WHEN p_partkey % 7 = 0 THEN p_name || ' || ' || upper(substr(p_name, 1, 1)) || upper(substr(p_name, length(p_name) - 2, 3)) || substr(p_type, 1, 2)
                    WHEN p_partkey % 11 = 0 THEN lower(upper(substr(p_name, 1, 1)) || upper(substr(p_name, length(p_name) - 2, 3)) || substr(p_type, 1, 2))
                    ELSE p_name END AS term,
               p_type AS top_category, p_brand AS specific_category, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence,
               p_type || ' ' || p_name AS witness
        FROM part""",
    "graph_edges": """
        SELECT 's' || CAST(s_suppkey AS STRING) AS src, 'n' || CAST(s_nationkey AS STRING) AS dst, 'PART_OF' AS rel_type, 'sn' || CAST(s_suppkey AS STRING) AS uid FROM supplier
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), 'PART_OF', 'nr' || CAST(n_nationkey AS STRING) FROM nation
        UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'n' || CAST((n_nationkey + 7) % 25 AS STRING), 'CORROBORATES', 'nn' || CAST(n_nationkey AS STRING) FROM nation""",
    "witnesses": """
        SELECT 'w' || CAST(o_orderkey AS STRING) AS uid, CASE o_custkey % 3 WHEN 0 THEN 'WHAT' WHEN 1 THEN 'WHEN' ELSE 'WHO' END || CAST(o_custkey AS STRING) AS slot_type,
               CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'V' || CAST(o_orderkey % 2 AS STRING) END AS var_name,
               o_orderpriority || ' order ' || CASE o_orderstatus WHEN 'P' THEN 'is pending' WHEN 'F' THEN 'was filled' ELSE 'is open now' END AS surface,
               'Placed on ' || CAST(CAST(o_orderdate AS DATE) AS STRING) || CASE WHEN o_orderkey % 10 = 3 THEN ' which replaces the former one' ELSE ' by phone' END AS content_excerpt,
               o_totalprice / 500000.0 AS reliability_score, 'k' || CAST(o_orderkey % 50 AS STRING) AS kg0_entity_id, 'a' || CAST(o_orderkey % 13 AS STRING) AS artifact_id,
               CASE o_orderkey % 3 WHEN 0 THEN 'GROUNDED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS quality, 'c' || CAST(o_custkey AS STRING) AS claim_uid
        FROM orders""",
    "chain_members": """
        SELECT 'ch' || CAST(o_custkey % 40 AS STRING) || '-' || CAST(o_orderkey % 5 AS STRING) AS chain_id, 0.2 + (o_custkey % 40) / 80.0 AS source_score, (o_custkey % 40) % 9 <> 0 AS temporal,
               'cand' || CAST(o_orderkey AS STRING) AS candidate_id, CASE o_orderkey % 4 WHEN 0 THEN 'WHAT' WHEN 1 THEN 'WHO' WHEN 2 THEN 'WHEN' ELSE 'EVIDENCE' END AS slot_type,
               'a' || CAST(o_orderkey % 13 AS STRING) AS artifact_id, CASE WHEN o_orderkey % 300 = 0 THEN '' ELSE 'w' || CAST(o_orderkey AS STRING) END AS witness_id, o_totalprice / 500000.0 AS score
        FROM orders WHERE o_orderstatus = 'F'""",
    "claims": """
        SELECT 'c' || CAST(c_custkey AS STRING) AS claim_uid, 'q' || CAST(c_custkey % 60 AS STRING) AS question, CASE c_custkey % 7 WHEN 0 THEN 'WHAT' WHEN 1 THEN 'EVIDENCE' WHEN 2 THEN 'WHO' WHEN 3 THEN 'HOW' WHEN 4 THEN 'WHEN' ELSE 'WHY' END AS slot,
               (c_acctbal + 1000) / 11000.0 AS confidence, CASE c_custkey % 5 WHEN 0 THEN 'contested' WHEN 1 THEN 'supported' WHEN 2 THEN 'proposed' ELSE 'weakly-supported' END AS status,
               c_custkey % 4 AS n_witnesses, CASE c_custkey % 3 WHEN 0 THEN 'GROUNDED' WHEN 1 THEN 'INFERRED' ELSE 'AMBIGUOUS' END AS quality
        FROM customer""",
    "inferences": """
        SELECT 'i' || CAST(c_custkey AS STRING) AS uid, 'c' || CAST(c_custkey AS STRING) AS claim_uid, 'c' || CAST(c_custkey AS STRING) AS conclusion, (c_acctbal + 1000) / 11000.0 AS confidence FROM customer""",
    "defeaters": """
        SELECT 'i' || CAST(o_custkey AS STRING) AS uid, CASE o_orderkey % 2 WHEN 0 THEN 'rebutting' ELSE 'undercutting' END AS type, CAST(1 + o_orderkey % 4 AS INT) AS cluster_size
        FROM orders WHERE o_orderpriority = '1-URGENT'""",
    "premises": """
        SELECT 'i' || CAST(o_custkey AS STRING) AS uid, 'c' || CAST(o_orderkey % 150 AS STRING) AS claim_uid FROM orders WHERE o_orderpriority = '2-HIGH'""",
    "mentions": """
        SELECT 'h' || CAST(o_custkey % 200 AS STRING) AS hypothesis, 'm' || CAST(o_orderkey AS STRING) AS mention_id, 'an' || CAST(o_orderkey % 400 AS STRING) AS anchor_id, 'a' || CAST(o_orderkey % 40 AS STRING) AS artifact_id,
               o_totalprice / 500000.0 AS confidence
        FROM orders WHERE o_orderstatus = 'O'""",
    "runs": """
        SELECT event_id AS run_id, 'q' || CAST(user_id AS STRING) AS question, CASE WHEN event_id % 3 = 0 THEN 'sc' || CAST(user_id % 20 AS STRING) END AS scope_id,
               CASE WHEN event_id % 50 = 0 AND event_id > 0 THEN event_id - 50 END AS parent_id, ts AS created_at, value AS confidence
        FROM events WHERE event_type = 'signup'""",
    "threads": """
        SELECT conv_id, turn, CAST(conv_id AS STRING) || ':' || CAST(turn AS STRING) AS msg, role, text FROM conversations""",
    "lower_docs": """
        SELECT doc_id, lang, source, n_chars, lower(text) AS text FROM documents""",
}


class Inputs:
    """Tables and proxies by name."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return table(self.spark, self._folder, name)
        used = [x for x in TABLES if re.search(rf"\b(?:FROM|JOIN) {x}\b", PROXIES[name])]
        text = re.sub(r"\b(FROM|JOIN) (\w+)\b", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], PROXIES[name])
        return self.spark.sql(text, **{x: table(self.spark, self._folder, x) for x in used})


def plain(df: DataFrame, digits: int = 9) -> DataFrame:
    """Whole numbers as long, doubles rounded, arrays of text as text: what both engines print alike."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("long")
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, T.ArrayType):
            c = F.array_join(c.cast("array<string>"), ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(sql: str | None = None, uses: tuple[str, ...] = ()):
    """Register a query under its function's name; ``sql`` may start with further common table expressions (``, x AS (...) SELECT``)."""

    def add(build: Callable[[Inputs], DataFrame]) -> Callable[[Inputs], DataFrame]:
        QUERIES[build.__name__] = lambda spark, folder: plain(build(Inputs(spark, folder)))
        if sql is not None:
            parts = [f"{x} AS ({PROXIES[x]})" for x in uses]
            body = sql.strip()
            if body.startswith(","):
                parts.append(body[1:].strip())
                ORACLE[build.__name__] = "WITH RECURSIVE " + ", ".join(parts)
            else:
                ORACLE[build.__name__] = ("WITH " + ", ".join(parts) + " " if parts else "") + body
        return build

    return add
