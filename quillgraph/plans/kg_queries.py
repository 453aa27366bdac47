"""Queries that build and check the knowledge graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import text as t
from quillgraph.functions.ids import sha_id
from quillgraph.operators import build, checks, cooccur, parse, resolve
from quillgraph.plans.registry import Inputs, query

#: Canonical rows in SQL; the test categories have the plain forms that these labels assume.
CANON = r"""
, split AS (
  SELECT *, CASE WHEN instr(term, '||') > 0 THEN trim(split_part(term, '||', 1)) ELSE trim(term) END AS canon, CASE WHEN instr(term, '||') > 0 THEN trim(split_part(term, '||', 2)) END AS abbr,
         upper(substr(top_category, 1, 1)) || lower(substr(top_category, 2)) AS l1, replace(specific_category, '#', '') AS l2
  FROM raw_entities),
amap AS (SELECT lower(abbr) AS ab, min(canon) AS mc, min(l1) AS ml FROM split WHERE abbr IS NOT NULL GROUP BY lower(abbr) HAVING count(DISTINCT (canon, l1)) = 1),
rows AS (
  SELECT s.*, coalesce(mc, canon) AS name, CASE WHEN ml IS NULL THEN [l1, l2] WHEN ml = l2 THEN [ml] ELSE [ml, l2] END AS labels_, coalesce(ml, l1) AS first_label,
         substr(sha256('entity_weak|' || coalesce(ml, l1) || '|' || lower(coalesce(mc, canon))), 1, 12) AS kg_id
  FROM split s LEFT JOIN amap ON s.abbr IS NULL AND lower(s.canon) = ab)
"""


@query(CANON + "SELECT ingest_seq, kg_id, name, abbr AS abbreviation FROM rows", ("raw_entities",))
def kg_canonical_rows(p: Inputs) -> DataFrame:
    """JN-05, STR-01, STR-03: terms, abbreviations and labels of extraction rows."""
    return build.canonical_rows(p.raw_entities).select("ingest_seq", "kg_id", "name", "abbreviation")


@query(
    CANON
    + """
, seen AS (SELECT kg_id, label, min((ingest_seq, pos)) AS spot FROM (SELECT kg_id, ingest_seq, unnest(labels_) AS label, generate_subscripts(labels_, 1) AS pos FROM rows) GROUP BY kg_id, label),
firsts AS (SELECT kg_id, arg_min(name, ingest_seq) AS name, arg_min(confidence, ingest_seq) AS confidence FROM rows GROUP BY kg_id)
SELECT f.kg_id, f.name, string_agg(label, ',' ORDER BY spot) AS labels, f.confidence FROM firsts f JOIN seen USING (kg_id) GROUP BY ALL""",
    ("raw_entities",),
)
def kg_entities_first_wins(p: Inputs) -> DataFrame:
    """AGG-01, WIN-02: entity nodes; first row's attributes, labels as first seen."""
    return build.entity_nodes(build.canonical_rows(p.raw_entities))


@query(CANON + "SELECT DISTINCT kg_id AS src, substr(sha256('abbreviation|' || lower(abbr)), 1, 12) AS dst, upper(abbr) AS abbreviation FROM rows WHERE abbr IS NOT NULL", ("raw_entities",))
def kg_abbreviations(p: Inputs) -> DataFrame:
    """AGG-03."""
    return build.abbreviations(build.canonical_rows(p.raw_entities))


def _pages(p: Inputs) -> DataFrame:
    docs = p.raw_entities.select("document_id").unionByName(p.supplier.select(F.concat(F.lit("d"), (F.col("s_suppkey") + 90).cast("string")).alias("document_id")))
    labelled = p.supplier.select(F.concat(F.lit("d"), (F.col("s_suppkey") % 60).cast("string")).alias("document_id"), (F.col("s_suppkey") % 6).cast("int").alias("page"), F.lit("memo").alias("label"))
    mentioned = p.raw_entities.select("document_id", F.col("page_number").cast("int").alias("page"))
    return build.page_nodes(docs, labelled, mentioned)


PAGES = """
, docs AS (SELECT document_id FROM raw_entities UNION SELECT 'd' || CAST(s_suppkey + 90 AS STRING) FROM supplier),
labelled AS (SELECT DISTINCT 'd' || CAST(s_suppkey % 60 AS STRING) AS document_id, s_suppkey % 6 AS page, 'memo' AS label FROM supplier),
known AS (SELECT document_id, page, max(label) AS label FROM (SELECT * FROM labelled UNION ALL SELECT document_id, page_number, NULL FROM raw_entities WHERE page_number IS NOT NULL) GROUP BY 1, 2),
pg AS (
  SELECT * FROM known WHERE document_id IN (SELECT document_id FROM docs)
  UNION ALL SELECT document_id, 0, NULL FROM docs WHERE document_id NOT IN (SELECT document_id FROM known))
"""


@query(PAGES + "SELECT document_id, CAST(page AS BIGINT) AS page, label, substr(sha256('page_strong|' || document_id || '|' || CAST(page AS STRING)), 1, 12) AS kg_id FROM pg", ("raw_entities",))
def kg_page_nodes(p: Inputs) -> DataFrame:
    """JN-03, SET-01, JSN-06: pages from labels and mentions, page 0 for documents without."""
    return _pages(p)


@query(
    CANON
    + PAGES.replace("\n, docs", ", docs", 1)
    + """
, linked AS (
  SELECT r.*, coalesce(a.page, z.page) AS spot FROM rows r LEFT JOIN pg a ON a.document_id = r.document_id AND a.page = r.page_number LEFT JOIN pg z ON z.document_id = r.document_id AND z.page = 0)
SELECT substr(sha256('page_strong|' || document_id || '|' || CAST(spot AS STRING)), 1, 12) AS src, kg_id AS dst, 'HAS_CLAIM' AS rel_type, count(*) AS n_mentions, count(DISTINCT witness) AS n_witnesses
FROM linked WHERE spot IS NOT NULL GROUP BY document_id, spot, kg_id""",
    ("raw_entities",),
)
def kg_mention_edges(p: Inputs) -> DataFrame:
    """JN-04, AGG-02: page to entity with fallback to page 0; witnesses merged where none contains another."""
    edges = build.mention_edges(build.canonical_rows(p.raw_entities), _pages(p))
    return edges.select("src", "dst", "rel_type", "n_mentions", F.size(F.split("witness", r" \| ")).alias("n_witnesses"))


def _asked(p: Inputs) -> DataFrame:
    name, words = F.col("p_name"), F.split("p_name", " ")
    forms = F.array(name, F.upper(name), F.concat(F.lit("The "), name), F.concat(F.get(words, F.lit(1)), F.lit(" of "), F.get(words, F.lit(0))), F.concat(name, F.lit(" unit"), F.col("p_brand")), F.lit("nothing known"))
    return p.part.select(F.explode(forms).alias("query")).distinct()


@query(
    r"""
, names AS (SELECT DISTINCT p_type, p_name, substr(sha256('entity_weak|' || upper(substr(p_type, 1, 1)) || lower(substr(p_type, 2)) || '|' || lower(p_name)), 1, 12) AS kg_id, p_partkey FROM part),
first_id AS (SELECT p_name, arg_min(kg_id, p_partkey) AS kg_id, count(DISTINCT kg_id) AS n FROM names GROUP BY p_name)
SELECT query, kg_id, tier FROM (
  SELECT DISTINCT p_name AS query, kg_id, 'exact' AS tier FROM first_id UNION SELECT upper(p_name), kg_id, 'exact' FROM first_id
  UNION SELECT 'The ' || p_name, CASE WHEN n = 1 THEN kg_id END, CASE WHEN n = 1 THEN 'normalized' ELSE 'miss' END FROM first_id
  UNION SELECT split_part(p_name, ' ', 2) || ' of ' || split_part(p_name, ' ', 1), CASE WHEN n = 1 THEN kg_id END, CASE WHEN n = 1 THEN 'token_set' ELSE 'miss' END FROM first_id
  UNION SELECT DISTINCT p.p_name || ' unit' || p_brand, CASE WHEN n = 1 THEN f.kg_id END, CASE WHEN n = 1 THEN 'token_sub' ELSE 'miss' END FROM part p JOIN first_id f USING (p_name)
  UNION SELECT 'nothing known', NULL, 'miss')""".replace("\n, names", "\nWITH names", 1)
)
def endpoint_resolution_tiers(p: Inputs) -> DataFrame:
    """JN-06, STR-04 to STR-06: names asked for in five forms against entities named by part and type."""
    rows = p.part.select(F.col("p_partkey").alias("ingest_seq"), F.col("p_name").alias("term"), F.col("p_type").alias("top_category"), F.lit(None).cast("string").alias("specific_category"))
    return build.resolve_endpoints(_asked(p), build.canonical_rows(rows))


@query(
    """
, ent AS (SELECT n_name, substr(sha256('entity_weak|Nation|' || lower(n_name)), 1, 12) AS kg_id FROM nation)
SELECT a.kg_id AS src, b.kg_id AS dst, 'SHIPS_TO_' || upper(replace(o.o_orderpriority, ' ', '_')) AS rel_type, count(*) AS n_rows
FROM (SELECT c_nationkey, o_orderpriority FROM orders JOIN customer ON c_custkey = o_custkey) o JOIN nation x ON x.n_nationkey = c_nationkey JOIN nation y ON y.n_nationkey = (c_nationkey + 3) % 25
JOIN ent a ON a.n_name = x.n_name JOIN ent b ON b.n_name = y.n_name GROUP BY ALL""".replace("\n, ent", "\nWITH ent", 1).replace("replace(o.o_orderpriority, ' ', '_')", "replace(replace(o.o_orderpriority, ' ', '_'), '-', '_')")
)
def kg_relation_edges(p: Inputs) -> DataFrame:
    """JN-07, STR-02: both ends of free-text relations resolved, types as slugs."""
    entities = p.nation.select(F.col("n_nationkey").cast("long").alias("ingest_seq"), F.col("n_name").alias("term"), F.lit("nation").alias("top_category"), F.lit(None).cast("string").alias("specific_category"))
    far = p.nation.select(F.col("n_nationkey").alias("k2"), F.col("n_name").alias("term_2"))
    rows = p.orders.join(p.customer, F.col("o_custkey") == F.col("c_custkey")).join(p.nation.select(F.col("n_nationkey").alias("k1"), F.col("n_name").alias("term_1")), F.col("c_nationkey") == F.col("k1")).join(far, (F.col("c_nationkey") + 3) % 25 == F.col("k2"))
    edges = rows.select(F.col("o_orderkey").alias("ingest_seq"), "term_1", "term_2", F.concat(F.lit(" ships to / "), "o_orderpriority").alias("relationship"), F.lit("high").alias("confidence"))
    return build.relation_edges(edges, build.canonical_rows(entities)).select("src", "dst", "rel_type", "n_rows")


@query(
    """SELECT source, arg_min(lang, (-n, first)) AS dominant FROM (SELECT source, lang, count(*) AS n, min(doc_id) AS first FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) GROUP BY source"""
)
def dominant_label(p: Inputs) -> DataFrame:
    """AGG-09: most frequent language of a source, ties to the first seen."""
    return build.dominant_label(p.documents, "source", "lang", "doc_id", "document")


@query("SELECT o_orderkey, coalesce(c_mktsegment, '') AS c_mktsegment, coalesce(c_name, '') AS c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey")
def catalog_join(p: Inputs) -> DataFrame:
    """JN-01, JN-02, SRC-01, SRC-02: orders with what the catalog of customers says."""
    catalog = p.customer.withColumnRenamed("c_custkey", "key")
    return build.documents_with_catalog(p.orders.select("o_orderkey", F.col("o_custkey").alias("key")), catalog, "key", ["c_mktsegment", "c_name"]).drop("key")


@query(
    """SELECT 'customer_without_order' AS "check", count(*) AS n FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
       UNION ALL SELECT 'order_without_line', count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
       UNION ALL SELECT 'part_without_line', count(*) FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem)
       UNION ALL SELECT 'document_without_label', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"""
)
def orphan_checks(p: Inputs) -> DataFrame:
    """JN-12: nodes that nothing links to."""
    return build.union_all([
        checks.unlinked("customer_without_order", p.customer, "c_custkey", p.orders, "o_custkey"), checks.unlinked("order_without_line", p.orders, "o_orderkey", p.lineitem, "l_orderkey"),
        checks.unlinked("part_without_line", p.part, "p_partkey", p.lineitem, "l_partkey"), checks.unlinked("document_without_label", p.documents, "doc_id", p.labels, "doc_id"),
    ])


@query("SELECT lower(trim(p_name)) AS key, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, key LIMIT 20")
def duplicate_keys_top20(p: Inputs) -> DataFrame:
    """AGG-05, SNK-02: names that several nodes hold."""
    return checks.duplicate_keys(p.part, F.lower(F.trim("p_name")))


@query(
    """, ends AS (SELECT src AS id FROM graph_edges UNION ALL SELECT dst FROM graph_edges)
       SELECT DISTINCT id, coalesce(d, 0) AS degree FROM (SELECT 's' || CAST(s_suppkey AS STRING) AS id FROM supplier UNION SELECT 'r' || CAST(r_regionkey AS STRING) FROM region UNION SELECT 'x0') n LEFT JOIN (SELECT id, count(*) AS d FROM ends GROUP BY id) USING (id)""",
    ("graph_edges",),
)
def degree_outliers(p: Inputs) -> DataFrame:
    """AGG-06, AGG-32: degrees, 0 for nodes without edge."""
    nodes = p.supplier.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id")).unionByName(p.region.select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("id")))
    nodes = nodes.unionByName(p.region.select(F.lit("x0").alias("id")).distinct())
    return checks.degrees(nodes, "id", p.graph_edges)


@query(
    """SELECT "column", CAST(n_missing AS BIGINT) AS n_missing, n_rows FROM (
         SELECT 'quality' AS "column", sum(CASE WHEN quality IS NULL THEN 1 ELSE 0 END) AS n_missing, count(*) AS n_rows FROM documents LEFT JOIN labels USING (doc_id)
         UNION ALL SELECT 'lang', sum(CASE WHEN lang IS NULL OR trim(lang) = '' THEN 1 ELSE 0 END), count(*) FROM documents LEFT JOIN labels USING (doc_id)
         UNION ALL SELECT 'text', sum(CASE WHEN text IS NULL OR trim(text) = '' THEN 1 ELSE 0 END), count(*) FROM documents LEFT JOIN labels USING (doc_id))"""
)
def completeness(p: Inputs) -> DataFrame:
    """AGG-07: missing values per column."""
    return checks.completeness(p.documents.join(p.labels, "doc_id", "left"), ["quality", "lang", "text"])


@query("SELECT CAST(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_covered, count(*) AS n_rows, round(sum(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) / count(*), 9) AS ratio FROM labels")
def coverage_ratio(p: Inputs) -> DataFrame:
    """AGG-08."""
    return checks.coverage(p.labels, F.col("toxic") == 1)


@query("SELECT rel_type AS name, count(*) AS n FROM graph_edges GROUP BY 1", ("graph_edges",))
def edge_type_counts(p: Inputs) -> DataFrame:
    """AGG-04."""
    return checks.counts(p.graph_edges, "rel_type")


@query(
    """SELECT a.l_partkey AS a, b.l_partkey AS b, count(DISTINCT a.l_orderkey) AS n FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b
       ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey GROUP BY 1, 2"""
)
def cooccurrence_pairs(p: Inputs) -> DataFrame:
    """JN-08: parts in the same order."""
    return cooccur.pairs(p.lineitem, "l_orderkey", "l_partkey")


@query(
    """SELECT c_nationkey AS a, l_suppkey AS b, count(*) AS n FROM (SELECT DISTINCT o_orderkey, c_nationkey FROM orders JOIN customer ON c_custkey = o_custkey) JOIN (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) ON l_orderkey = o_orderkey GROUP BY 1, 2"""
)
def bipartite_cooccurrence(p: Inputs) -> DataFrame:
    """JN-09: nations and suppliers that meet in orders."""
    left = p.orders.join(p.customer, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("g"), "c_nationkey")
    return cooccur.bipartite(left, p.lineitem.select(F.col("l_orderkey").alias("g"), "l_suppkey"), "g", "c_nationkey", "l_suppkey")


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_regionkey AS v FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def same_attribute_pairs(p: Inputs) -> DataFrame:
    """JN-10: nations of one region."""
    return cooccur.same_attribute(p.nation, "n_nationkey", "n_regionkey")


@query("SELECT DISTINCT 'd' || CAST(p_partkey % 97 AS STRING) AS document_id, p_name FROM part WHERE p_type = 'PROMO'")
def mentioned_in_family(p: Inputs) -> DataFrame:
    """JN-11: names mentioned in documents of one family."""
    rows = p.part.where("p_type = 'PROMO'")
    return rows.select(F.concat(F.lit("d"), (F.col("p_partkey") % 97).cast("string")).alias("document_id"), "p_name").distinct()


@query("SELECT * FROM (SELECT conv_id AS thread, msg AS src, lead(msg) OVER (PARTITION BY conv_id ORDER BY turn) AS dst FROM threads) WHERE dst IS NOT NULL", ("threads",))
def next_in_thread(p: Inputs) -> DataFrame:
    """WIN-01."""
    return cooccur.next_in_thread(p.threads, "conv_id", ["turn"], "msg")


@query(
    """SELECT source AS g, src, dst, 'IDENTICAL_TO' AS rel_type FROM (SELECT source, doc_id AS src, lead(doc_id) OVER w AS dst, row_number() OVER w AS i FROM documents WINDOW w AS (PARTITION BY source ORDER BY doc_id)) WHERE dst IS NOT NULL AND i <= 500"""
)
def chain_topology_links(p: Inputs) -> DataFrame:
    """WIN-08: each document to the next of its source."""
    return cooccur.chained(p.documents, "source", "doc_id", "IDENTICAL_TO")


@query(
    """, k AS (SELECT c_custkey AS id, lower(c_mktsegment) || ' ' || CAST(c_nationkey AS STRING) || CAST(c_custkey % 20 AS STRING) AS val FROM customer)
       SELECT a.id AS id1, a.val AS str1, b.id AS id2, b.val AS str2, 1 AS pass FROM k a JOIN k b ON a.val = b.val AND a.id < b.id""".replace(", k AS", "WITH k AS", 1)
)
def dup_candidate_pairs(p: Inputs) -> DataFrame:
    """JN-13, STR-08: customers whose names agree without legal endings."""
    name = F.concat(F.lower("c_mktsegment"), F.lit(" "), F.col("c_nationkey").cast("string"), (F.col("c_custkey") % 20).cast("string"))
    rows = p.customer.select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.upper(name), F.lit(", Inc."))).otherwise(name).alias("val"))
    out = resolve.candidates(rows, "c_custkey", "val", "org")
    strip = lambda c: t.organisation_key(F.col(c)).alias(c)
    return out.select("id1", strip("str1"), "id2", strip("str2"), "pass")


@query(
    """WITH RECURSIVE e AS (SELECT s_suppkey AS a, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS b FROM supplier), comp AS (SELECT b AS keeper, a AS dup FROM e WHERE a <> b) SELECT dup, keeper FROM comp"""
)
def merge_keepers(p: Inputs) -> DataFrame:
    """GR-07, GR-08: groups of merged suppliers (all of a nation, chained) and the one that stays."""
    s = p.supplier.select("s_nationkey", "s_suppkey")
    pairs = cooccur.chained(s, "s_nationkey", "s_suppkey", "same", most=None).select(F.col("src").alias("id1"), F.col("dst").alias("id2"))
    return resolve.keepers(pairs, s.select(F.col("s_suppkey").alias("id"), F.lit(1).alias("degree")))


@query(
    """SELECT DISTINCT least(m1, m2) AS src, greatest(m1, m2) AS dst, 'LINK' AS rel_type FROM (
         SELECT min(a.s_suppkey) OVER (PARTITION BY a.s_nationkey) AS m1, min(b.s_suppkey) OVER (PARTITION BY b.s_nationkey) AS m2
         FROM supplier a JOIN supplier b ON b.s_suppkey = a.s_suppkey + 1) WHERE m1 <> m2 AND FALSE
       UNION SELECT DISTINCT x.m, y.m, 'LINK' FROM (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS m FROM supplier) x JOIN (SELECT s_suppkey, min(s_suppkey) OVER (PARTITION BY s_nationkey) AS m FROM supplier) y ON y.s_suppkey = x.s_suppkey + 1 WHERE x.m <> y.m"""
)
def merged_edges(p: Inputs) -> DataFrame:
    """GR-07: edges moved to the nodes that stay."""
    s = p.supplier.select("s_nationkey", "s_suppkey")
    least = s.groupBy("s_nationkey").agg(F.min("s_suppkey").alias("keeper"))
    mapping = s.join(least, "s_nationkey").where("s_suppkey <> keeper").select(F.col("s_suppkey").alias("dup"), "keeper")
    edges = s.select(F.col("s_suppkey").alias("src")).join(s.select((F.col("s_suppkey") - 1).alias("src"), F.col("s_suppkey").alias("dst")), "src").withColumn("rel_type", F.lit("LINK"))
    return resolve.merged_edges(edges, mapping)


@query(
    """SELECT n_nationkey, CASE WHEN n_name IN ('NATION_3', 'NATION_8') THEN 'Gpe,Country' ELSE 'Gpe' END AS labels FROM nation"""
)
def secondary_labels(p: Inputs) -> DataFrame:
    """GR-09: listed names get one more label."""
    nodes = p.nation.withColumn("labels", F.array(F.lit("Gpe")))
    return resolve.tagged(nodes, F.col("n_name"), ["Nation_3", "Nation_8"], "Country").select("n_nationkey", "labels")


@query(
    """SELECT p_partkey, b.code AS brands_code, CASE WHEN b.key IS NULL THEN 'not_found' WHEN b.code IS NULL THEN 'no_match' ELSE 'matched' END AS brands_status
       FROM part LEFT JOIN (SELECT DISTINCT lower(p_brand) AS key, CASE WHEN p_brand = 'Brand#3' THEN NULL ELSE 'B' || substr(p_brand, 7) END AS code FROM part WHERE p_brand < 'Brand#20') b ON lower(p_brand) = b.key"""
)
def vocabulary_enrichment(p: Inputs) -> DataFrame:
    """JN-14, SRC-14: codes from a vocabulary table, with status."""
    v = p.part.where("p_brand < 'Brand#20'").select(F.col("p_brand").alias("key"), F.when(F.col("p_brand") != "Brand#3", F.concat(F.lit("B"), F.substr("p_brand", F.lit(7)))).alias("code")).distinct()
    return resolve.enriched(p.part, "p_brand", {"brands": v}).select("p_partkey", "brands_code", "brands_status")


@query(
    """SELECT 'quality_range' AS rule, CAST(doc_id AS STRING) AS uid FROM labels WHERE quality NOT IN (1) UNION ALL SELECT 'toxic_and_good', CAST(doc_id AS STRING) FROM labels WHERE toxic = 1 AND quality = 1
       UNION ALL SELECT 'value_range', CAST(event_id AS STRING) FROM events WHERE value > 200"""
)
def constraint_violations(p: Inputs) -> DataFrame:
    """GR-21: rows that break rules, all rules of a table in one pass."""
    a = checks.violations(p.labels, "doc_id", {"quality_range": ~F.col("quality").isin(1), "toxic_and_good": (F.col("toxic") == 1) & (F.col("quality") == 1)})
    return a.unionByName(checks.violations(p.events, "event_id", {"value_range": F.col("value") > 200}))


@query("SELECT 'dangling_dst' AS rule, dst AS uid FROM graph_edges WHERE dst NOT LIKE 'n%' GROUP BY dst UNION ALL SELECT 'dangling_src', src FROM graph_edges WHERE src NOT LIKE 'n%' GROUP BY src", ("graph_edges",))
def dangling_edges(p: Inputs) -> DataFrame:
    """GR-22, JN-22: ends of edges that are no node (nations are the nodes here)."""
    return checks.dangling(p.graph_edges, p.nation.select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("id")), "id")


@query("SELECT conv_id, (count(*) = max(turn) + 1 AND count(DISTINCT turn) = max(turn) + 1 AND min(turn) = 0) AS valid FROM conversations GROUP BY conv_id")
def page_coverage(p: Inputs) -> DataFrame:
    """LAB-01: page numbers are exactly 1 to N (turns, counted from 1)."""
    rows = p.conversations.withColumn("page", F.col("turn") + 1)
    n = rows.groupBy("conv_id").agg(F.max("page").alias("n"))
    return checks.page_coverage(rows.join(n, "conv_id"), "conv_id", "page", "n")


@query(
    """SELECT conv_id, CAST(turn + 1 AS BIGINT) AS page, length(trim(regexp_replace(replace(text, chr(10), ' '), ' +', ' ', 'g'))) AS n FROM conversations WHERE trim(text) <> ''"""
)
def split_pages(p: Inputs) -> DataFrame:
    """SRC-07: conversations written with page markers, split again."""
    clean = F.trim(F.regexp_replace(F.translate("text", "\n", " "), " +", " "))
    part = F.concat(F.lit("=== Page "), (F.col("turn") + 1).cast("string"), F.lit(" ===\n"), clean)
    whole = p.conversations.groupBy("conv_id").agg(F.concat(F.lit("front matter\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", part.alias("x")))), lambda s: s["x"]), "\n")).alias("body"))
    return parse.split_pages(whole, "conv_id", "body").select("conv_id", "page", F.length("text").alias("n"))


@query(
    """SELECT p_name AS term, p_type AS top, p_brand AS specific, CASE p_size % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS confidence, CAST(p_size AS BIGINT) AS page, count(*) AS n FROM part GROUP BY ALL"""
)
def entity_lines(p: Inputs) -> DataFrame:
    """SRC-05, JSN-05: inventory lines parsed."""
    level = F.element_at(F.array(F.lit("High"), F.lit("Medium"), F.lit("Low")), (F.col("p_size") % 3 + 1).cast("int"))
    lines = p.part.select(F.concat_ws(" | ", "p_name", F.concat("p_type", F.lit(" > sort > "), "p_brand"), level, F.lit("seen in stock"), F.col("p_size").cast("string")).alias("value"))
    return parse.entity_lines(lines.unionByName(lines.select(F.lit("no category here").alias("value")).limit(3))).groupBy("term", "top", "specific", "confidence", "page").agg(F.count("*").alias("n"))


@query(
    """SELECT DISTINCT p_name AS term_1, 'made as' AS relationship, p_type AS term_2, p_brand AS category, 'high' AS confidence FROM part WHERE p_size % 3 = 0"""
)
def relationship_lines(p: Inputs) -> DataFrame:
    """SRC-06, SET-06, SNK-04: relationship lines parsed, unknown confidences dropped, each 4-tuple once."""
    level = F.when(F.col("p_size") % 3 == 0, "High").otherwise("unsure")
    lines = p.part.select("p_partkey", F.concat_ws(" | ", "p_name", F.lit("made as"), "p_type", "p_brand", level).alias("value"))
    return parse.relationship_lines(lines, "p_partkey")


@query("SELECT DISTINCT 'x' || p_type AS name FROM part")
def missing_entities(p: Inputs) -> DataFrame:
    """SET-04, LAB-03: ends of relations that the inventory does not have."""
    relations = p.part.select(F.col("p_name").alias("term_1"), F.concat(F.lit("x"), "p_type").alias("term_2"))
    return parse.missing_names(relations, p.part.select(F.upper("p_name").alias("term")))


@query(
    """SELECT p_partkey, CASE WHEN n = 1 THEN v END AS category FROM part JOIN (SELECT p_name, min(p_brand) AS v, count(DISTINCT p_brand) AS n FROM part WHERE p_partkey % 40 = 0 GROUP BY p_name) USING (p_name)
       UNION ALL SELECT p_partkey, NULL FROM part WHERE p_name NOT IN (SELECT p_name FROM part WHERE p_partkey % 40 = 0)"""
)
def entity_enrichment(p: Inputs) -> DataFrame:
    """LAB-02: category by unambiguous name."""
    known = p.part.where("p_partkey % 40 = 0").select(F.col("p_name").alias("term"), F.col("p_brand").alias("category"))
    return parse.enriched(p.part.select("p_partkey", F.col("p_name").alias("term")), known, "category").select("p_partkey", "category")


@query(
    """SELECT term_1, arg_min(p_type, p_partkey) AS category FROM (SELECT DISTINCT split_part(p_name, ' ', 1) AS term_1 FROM part) JOIN part ON strpos(lower(p_name), lower(term_1)) > 0 GROUP BY term_1"""
)
def edge_category_lookup(p: Inputs) -> DataFrame:
    """LAB-04: category of a name by the first known term that contains it."""
    edges = p.part.select(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("term_1")).distinct()
    known = p.part.select(F.col("p_name").alias("term"), F.col("p_type").alias("category"), F.col("p_partkey").alias("seq"))
    return parse.edge_category(edges, known)


@query(
    """SELECT doc_id, CASE WHEN l.quality IS NOT NULL THEN 1 ELSE 0 END AS is_segmented, CASE WHEN n_chars > 0 THEN 1 ELSE 0 END AS is_ocred, CASE WHEN coalesce(lang = 'en', FALSE) THEN 1 ELSE 0 END AS is_entity_extracted, CASE WHEN n_chars > 2000 THEN 1 ELSE 0 END AS is_relationship_extracted
       FROM documents LEFT JOIN labels l USING (doc_id)"""
)
def document_progress(p: Inputs) -> DataFrame:
    """LAB-05: which steps of a document have an output with content."""
    d, one = p.documents, F.lit(1).cast("long")
    outputs = p.labels.where("quality IS NOT NULL").select("doc_id", F.lit("labels").alias("kind"), one.alias("size"))
    for kind, size in (("text", F.col("n_chars")), ("entities", (F.col("lang") == "en").cast("long")), ("relationships", F.col("n_chars") - 2000)):
        outputs = outputs.unionByName(d.select("doc_id", F.lit(kind).alias("kind"), size.alias("size")))
    return parse.progress(d, outputs, "doc_id")


@query(
    """SELECT o_custkey, arg_max(o_totalprice, o_orderkey) AS price, count(*) AS n FROM orders GROUP BY o_custkey"""
)
def keyed_upsert(p: Inputs) -> DataFrame:
    """SNK-01, SNK-05: two batches upserted by key, the later row wins."""
    rows = p.orders.select("o_custkey", "o_orderkey", F.col("o_totalprice").alias("price"))
    merged = build.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), ["o_custkey"], "o_orderkey")
    return merged.select("o_custkey", "price").join(rows.groupBy("o_custkey").agg(F.count("*").alias("n")), "o_custkey")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1")
def replace_by_document(p: Inputs) -> DataFrame:
    """SNK-03: lines of an order that come again replace the old ones."""
    rows = p.lineitem.select("l_orderkey", "l_linenumber", "l_partkey")
    old = rows.unionByName(rows.where("l_orderkey % 2 = 0"))
    return build.replace_documents(old, rows.where("l_orderkey % 2 = 0"), "l_orderkey").groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, substr(sha256('doc_strong|' || CAST(o_orderkey AS STRING) || '|' || coalesce(o_orderstatus, '')), 1, 12) AS kg_id FROM orders")
def document_node_ids(p: Inputs) -> DataFrame:
    """JSN-06: short hashed ids."""
    return p.orders.select("o_orderkey", sha_id("doc_strong", F.col("o_orderkey"), F.col("o_orderstatus")).alias("kg_id"))
