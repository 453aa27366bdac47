"""Queries on single functions and on readers and writers, each over a whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import dates, ids, structs
from quillgraph.functions import text as t
from quillgraph.operators import chains, conflict, graph, intent, mentions, resolve
from quillgraph.plans.registry import Inputs, query
from quillgraph.sources import readers, sinks

_STOP = "['the','a','an','of','for','in','to','and','or','by','on','at','with','from']"


# --- text


@query(
    """WITH x AS (SELECT p_partkey, list_distinct(regexp_extract_all(lower(p_name || 's ' || p_type || ' parties a'), '[a-z0-9]+')) AS toks FROM part),
       y AS (SELECT p_partkey, unnest(toks) AS w FROM x), z AS (SELECT p_partkey, w FROM y WHERE length(w) > 1 UNION SELECT p_partkey, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN substr(w, 1, length(w) - 3) || 'y' WHEN w LIKE '%s' AND length(w) > 4 THEN substr(w, 1, length(w) - 1) ELSE w END FROM y WHERE length(w) > 1)
       SELECT p_partkey, string_agg(w, ',' ORDER BY w) AS toks FROM z GROUP BY p_partkey"""
)
def surface_token_sets(p: Inputs) -> DataFrame:
    """STR-09: tokens of surfaces with their singulars."""
    return p.part.select("p_partkey", t.surface_tokens(F.concat("p_name", F.lit("s "), "p_type", F.lit(" parties a"))).alias("toks"))


@query("SELECT p_partkey, CASE WHEN a < b THEN a || '|' || b WHEN a > b THEN b || '|' || a ELSE a END AS variants FROM (SELECT p_partkey, lower(split_part(p_name, ' ', 2)) || ' ' || lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 1)) || ' ' || lower(split_part(p_name, ' ', 2)) AS b FROM part)")
def person_name_variants(p: Inputs) -> DataFrame:
    """STR-11: names given last name first, both ways round."""
    turned = F.concat(F.initcap(F.split_part("p_name", F.lit(" "), F.lit(2))), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    return p.part.select("p_partkey", F.array_join(t.person_variants(turned), "|").alias("variants"))


@query(
    """SELECT p_partkey, string_agg(DISTINCT v, '|' ORDER BY v) AS variants, ends AS is_file FROM (
         SELECT p_partkey, ends, unnest([p_name || CASE WHEN ver THEN ' v3' ELSE '' END || CASE WHEN ends THEN ' pdf' ELSE '' END, p_name || CASE WHEN ver THEN ' v3' ELSE '' END, p_name]) AS v FROM (SELECT p_partkey, lower(p_name) AS p_name, p_partkey % 2 = 0 AS ends, p_partkey % 3 = 0 AS ver FROM part)) GROUP BY p_partkey, ends"""
)
def document_name_variants(p: Inputs) -> DataFrame:
    """STR-11: file names with, and without, ending and version."""
    name = F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " v3").otherwise(""), F.when(F.col("p_partkey") % 2 == 0, ".PDF").otherwise(""))
    return p.part.select("p_partkey", F.array_join(t.document_variants(name), "|").alias("variants"), t.is_filename(name).alias("is_file"))


@query(
    """WITH n AS (SELECT p_partkey, lower(split_part(p_name, ' ', 1)) AS a, lower(split_part(p_name, ' ', 2)) || 's' AS b FROM part),
       c AS (SELECT p_partkey, unnest([a || ' ' || b, a, CASE WHEN a LIKE '%s' AND length(a) >= 5 THEN substr(a, 1, length(a) - 1) ELSE a END, b, CASE WHEN length(b) >= 5 THEN substr(b, 1, length(b) - 1) ELSE b END]) AS x, unnest([1, 2, 3, 4, 5]) AS i FROM n),
       f AS (SELECT p_partkey, x, min(i) AS i FROM c GROUP BY 1, 2)
       SELECT p_partkey, string_agg(x, '|' ORDER BY length(x) DESC, i) AS hints FROM f GROUP BY 1"""
)
def link_hint_phrases(p: Inputs) -> DataFrame:
    """STR-12: phrases to look a surface up by, longest first."""
    return p.part.select("p_partkey", F.array_join(t.link_hints(F.concat("p_name", F.lit("s"))), "|").alias("hints"))


@query(
    """WITH x AS (SELECT p_partkey, lower(p_name) AS s, lower(p_name) || ' zz' AS c, list_distinct(string_split(lower(p_name), ' ')) AS w FROM part)
       SELECT p_partkey, 1.0 AS overlap, round(2.0 * length(s) / (2 * length(s) + 3), 9) AS ratio, length(s) > 0 AS alike,
         round(least(1.0, round(0.45 * (2.0::DOUBLE * length(s) / (2 * length(s) + 3)) + 0.35 * (len(w) / (len(w) + 1)) + 0.2 + CASE WHEN len(list_filter(w, lambda y: length(y) >= 4)) > 0 THEN 0.1 ELSE 0 END, 4)), 4) AS score FROM x"""
)
def surface_likeness(p: Inputs) -> DataFrame:
    """STR-14, STR-15, STR-16, STR-17: how alike a name and a longer one are."""
    name, more = F.lower("p_name"), F.concat(F.lower("p_name"), F.lit(" zz"))
    out = p.part.select("p_partkey", name.alias("s"), more.alias("c")).withColumn("ratio", t.sequence_ratio(F.col("s"), F.col("c")))
    return out.select("p_partkey", t.overlap(t.tokens(F.col("s")), t.tokens(F.col("c"))).alias("overlap"), "ratio", t.similar(F.col("s"), F.col("c"), 0.6).alias("alike"), t.link_score(F.col("s"), F.col("c"), F.col("ratio")).alias("score"))


@query(
    """WITH x AS (SELECT doc_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS t FROM documents), y AS (SELECT doc_id, t, list_distinct(regexp_extract_all(t, '[a-z0-9]+')) AS w FROM x)
       SELECT doc_id, CASE WHEN t = '' THEN 0.0 WHEN contains(t, 'the thing') THEN 1.0 WHEN contains('the thing', t) THEN 0.7
         WHEN (list_contains(w, 'the') AND (list_contains(w, 'thing') OR list_contains(w, 'things'))) THEN 1.0 ELSE 0.0 END AS fit FROM y"""
)
def context_fit(p: Inputs) -> DataFrame:
    """STR-19: how well a phrase fits into texts."""
    return p.documents.select("doc_id", t.context_overlap(F.array("text"), F.array(F.lit("The thing"))).alias("fit"))


@query(
    """WITH x AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS a, lower(p_type) AS b FROM part),
       y AS (SELECT p_partkey, list_distinct(list_transform(range(1, length(a)), lambda i: substr(a, CAST(i AS INTEGER), 2))) AS g, list_distinct(list_transform(range(1, length(b)), lambda i: substr(b, CAST(i AS INTEGER), 2))) AS h FROM x)
       SELECT p_partkey, len(g) AS n, round(len(list_intersect(g, h)) / len(list_distinct(list_concat(g, h))), 9) AS likeness FROM y"""
)
def bigram_likeness(p: Inputs) -> DataFrame:
    """STR-20: shared pairs of characters."""
    a, b = t.bigrams(F.col("p_name")), t.bigrams(F.col("p_type"))
    return p.part.select("p_partkey", F.size(a).alias("n"), t.jaccard(a, b).alias("likeness"))


@query("SELECT p_partkey, p_name || ' (draft) - ' || p_type || '.docx|' || p_name || ' (draft) - ' || p_type || '|' || p_name || ' - ' || p_type || '|' || p_name AS needles FROM part")
def highlight_needles(p: Inputs) -> DataFrame:
    """STR-21: what to look for to highlight a title."""
    title = F.concat("p_name", F.lit(" (draft) - "), "p_type", F.lit(".docx"))
    return p.part.select("p_partkey", F.array_join(t.needles(title), "|").alias("needles"))


@query("SELECT p_partkey, '\"' || p_name || '\" OR ' || p_type || CASE WHEN lower(p_type) = 'small' THEN '' ELSE ' OR small' END || ' OR x' AS q FROM part")
def search_queries(p: Inputs) -> DataFrame:
    """STR-22: an OR query out of terms and further ones."""
    terms = t.expanded(F.array("p_name", "p_type"), F.array(F.lit("small"), F.lower("p_name"), F.lit(""), F.lit("x")))
    return p.part.select("p_partkey", t.or_query(terms).alias("q"))


@query(r"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text), '\w+'), lambda x: x IN ('the', 'thing', 'of'))) AS n FROM documents")
def alias_occurrences(p: Inputs) -> DataFrame:
    """AGG-11: how often any alias stands in a text as a whole word."""
    return p.documents.select("doc_id", t.occurrences(F.col("text"), ["the", "thing", "of"]).alias("n"))


@query("SELECT p_partkey, p_partkey % 3 = 0 AS is_id, p_partkey % 3 = 1 AS is_person FROM part")
def surface_kinds(p: Inputs) -> DataFrame:
    """FLT-11, STR-30: surfaces that look like ids or like persons."""
    k = F.col("p_partkey") % 3
    surface = F.when(k == 0, F.lpad(F.concat(F.lit("x"), F.col("p_partkey").cast("string")), 8, "0")).when(k == 1, F.initcap("p_name")).otherwise(F.initcap(F.concat(F.lit("Good "), "p_name")))
    return p.part.select("p_partkey", t.looks_like_id(surface).alias("is_id"), t.looks_like_person(surface).alias("is_person"))


@query(
    """WITH x AS (SELECT doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM documents)
       SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0.0 ELSE 0.65 * least(1.0, len(list_intersect(w, ['did', 'thing', 'cause', 'erthan'])) / 4) + 0.35 * least(1.0, len(list_intersect(w, ['cause', 'for', 'with'])) / 3) END, 9) AS relevance FROM x"""
)
def question_relevance(p: Inputs) -> DataFrame:
    """STR-31: terms and actions of a question that texts cover."""
    return p.documents.select("doc_id", t.question_relevance(F.lit("Did the thing cause an erthan?"), F.col("text"), ["the", "an"], ["cause", "for", "with"], r"\bcause\b").alias("relevance"))


@query(
    "WITH x AS (SELECT ingest_seq, unnest(CASE WHEN contains(term, ' || ') THEN [lower(term), lower(split_part(term, ' || ', 1)), lower(split_part(term, ' || ', 2))] ELSE [lower(term)] END) AS v FROM raw_entities) SELECT ingest_seq, string_agg(DISTINCT v, '|' ORDER BY v) AS variants FROM x GROUP BY 1".replace("WITH x", ", x", 1),
    ("raw_entities",),
)
def entity_key_variants(p: Inputs) -> DataFrame:
    """STR-32: keys under which an entity is known."""
    return p.raw_entities.select("ingest_seq", F.array_join(t.entity_variants(F.col("term")), "|").alias("variants"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'not shipped' WHEN 1 THEN 'failed to' ELSE '' END AS cue FROM orders")
def negation_cues(p: Inputs) -> DataFrame:
    """STR-27: the cue by which a text negates a surface."""
    k = F.col("o_orderkey") % 4
    said = F.when(k == 0, "The order was not shipped by the clerk").when(k == 1, "The clerk failed to ship the order").when(k == 2, "The order was not only shipped by the clerk").otherwise("The clerk shipped the order")
    return p.orders.select("o_orderkey", F.coalesce(t.negation(said, F.lit("the order the clerk")), F.lit("")).alias("cue"))


# --- dates


@query("SELECT o_orderkey, o_orderdate <= TIMESTAMP '1997-01-01' AS ordered, abs(date_diff('day', CAST(o_orderdate AS DATE), DATE '1997-01-01')) <= 30 AS within, NULL::BOOLEAN AS concurrent FROM orders")
def temporal_constraints(p: Inputs) -> DataFrame:
    """DT-07: order and distance of days."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return p.orders.select("o_orderkey", *[dates.constraint(k, day, F.lit("1997-01-01"), 30).alias(n) for k, n in (("ORDER", "ordered"), ("WITHIN", "within"), ("CONCURRENT", "concurrent"))])


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 = 5 THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS iso FROM orders")
def date_formats(p: Inputs) -> DataFrame:
    """DT-08: days written in five ways."""
    k, forms = F.col("o_orderkey") % 6, ["yyyy-MM-dd", "MM/dd/yyyy", "dd MMMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd"]
    said = F.coalesce(*[F.when(k == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)], F.lit("soon"))
    return p.orders.select("o_orderkey", dates.any_format(said).alias("iso"))


@query(
    """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN d || 'T00:00:00Z' WHEN 1 THEN strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE 'after ' || d END AS low,
         CASE o_orderkey % 3 WHEN 0 THEN d || 'T23:59:59Z' WHEN 1 THEN strftime(o_orderdate + INTERVAL 10 HOUR, '%Y-%m-%dT%H:%M:%SZ') ELSE 'after ' || d END AS high FROM (SELECT *, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)"""
)
def scope_bounds(p: Inputs) -> DataFrame:
    """DT-09: bounds of a scope in UTC."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 3
    said = F.when(k == 0, day).when(k == 1, F.concat(day, F.lit("T12:00:00+02:00"))).otherwise(F.concat(F.lit("after "), day))
    return p.orders.select("o_orderkey", dates.scope_bound(said).alias("low"), dates.scope_bound(said, True).alias("high"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(year(o_orderdate) AS STRING) || '-01-01' END AS first_day, CASE WHEN o_orderkey % 4 > 0 THEN CAST(CASE WHEN o_orderkey % 4 = 1 THEN 2021 ELSE year(o_orderdate) END AS STRING) || '-12-31' END AS last_day FROM orders")
def question_ranges(p: Inputs) -> DataFrame:
    """DT-10: the years that a question names."""
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "What was ordered by 31250?").when(k == 1, F.concat(F.lit("What was ordered from 2021 back to "), F.year("o_orderdate").cast("string"), F.lit("?"))).otherwise(F.concat(F.lit("Who ordered in "), F.year("o_orderdate").cast("string")))
    first, last = dates.question_range(asked)
    return p.orders.select("o_orderkey", first.alias("first_day"), last.alias("last_day"))


# --- JSON and ids


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN '' ELSE '' END AS title FROM events")
def first_titles(p: Inputs) -> DataFrame:
    """JSN-01: the title of the first source."""
    k = F.col("event_id") % 3
    said = F.when(k == 0, F.concat(F.lit('[{"title": " '), "event_type", F.lit('"}, {"title": "x"}]'))).when(k == 1, "[]").otherwise("no JSON")
    return p.events.select("event_id", structs.first_title(said).alias("title"))


@query("""SELECT event_id, substr(sha256('{"a":' || event_id || ',"b":"' || event_type || '"}'), 1, 16) AS hash FROM events""")
def stable_hashes(p: Inputs) -> DataFrame:
    """JSN-02: short hashes of records, whatever the order of their fields."""
    return p.events.select("event_id", ids.stable_hash(16, b=F.col("event_type"), a=F.col("event_id")).alias("hash"))


@query("""SELECT event_id, CASE WHEN event_type = 'error' THEN '{"k":"' || json_extract_string(props, '$.k') || '"}' ELSE '{}' END AS raw FROM events""")
def leftover_fields(p: Inputs) -> DataFrame:
    """JSN-04: fields without a column of their own."""
    fields = F.map_concat(F.create_map(F.lit("id"), F.col("event_id").cast("string")), F.when(F.col("event_type") == "error", F.from_json("props", "map<string,string>")).otherwise(F.create_map().cast("map<string,string>")))
    return p.events.select("event_id", structs.leftover(fields, ["id"]).alias("raw"))


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events")
def tolerant_records(p: Inputs) -> DataFrame:
    """SRC-13: records within fences, words or commas too many."""
    k = F.col("event_id") % 4
    said = F.when(k == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(k == 1, F.concat(F.lit("Here it is: "), "props", F.lit(" as asked."))).when(k == 2, F.regexp_replace("props", r"\}$", ",}")).otherwise("none")
    return readers.tolerant(p.events.select("event_id", said.alias("said")), "said", "k long").select("event_id", "parsed.k")


# --- files


def _folder(p: Inputs, name: str) -> str:
    import uuid

    return f"{graph.shared_folder(p.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("SELECT 'd' || CAST(conv_id AS STRING) AS document_id, turn AS page_index, arg_max(role, i) AS label, 0.5 AS confidence FROM (SELECT *, 0 AS i FROM conversations) GROUP BY 1, 2")
def page_label_lines(p: Inputs) -> DataFrame:
    """SRC-03: labels of pages out of JSON lines, some of which are broken."""
    line = F.to_json(F.struct(F.concat(F.lit("d"), F.col("conv_id").cast("string")).alias("document_id"), F.col("turn").alias("page_index"), F.col("role").alias("label"), F.lit("0.5").alias("confidence")))
    lines = p.conversations.select(F.explode(F.array(line, F.lit("{broken"), F.lit('{"document_id": "x", "page_index": "p"}'))).alias("value"))
    lines.write.text(path := _folder(p, "lines"))
    return readers.page_labels(p.spark, path).select("document_id", "page_index", "label", "confidence")


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders")
def spooled_records(p: Inputs) -> DataFrame:
    """SNK-09, SRC-04: one JSON array per group, written and read back as a stream of objects."""
    sinks.spool(p.orders.select("o_custkey", "o_orderkey", F.col("o_custkey").alias("owner"), "o_totalprice"), "o_custkey", path := _folder(p, "spool"))
    rows = p.spark.read.text(path).select(F.explode(F.from_json("value", "array<struct<o_orderkey: long, owner: long, o_totalprice: double>>")).alias("r"))
    return rows.select(F.col("r.owner").alias("o_custkey"), "r.o_orderkey", "r.o_totalprice")


@query("SELECT 'n' || CAST(c_nationkey AS STRING) AS document_id, 1 AS n_files FROM customer GROUP BY 1")
def document_folders(p: Inputs) -> DataFrame:
    """SRC-08: folders of documents, by name."""
    rows = p.customer.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("document_id"), F.col("c_name").alias("value"))
    rows.repartition(1).sortWithinPartitions("document_id").write.partitionBy("document_id").text(path := _folder(p, "documents"))
    out = readers.folders(p.spark, path)
    return out.select(F.regexp_replace("document_id", "^document_id=", "").alias("document_id"), "n_files")


@query("SELECT string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10) AS text FROM nation")
def decoded_files(p: Inputs) -> DataFrame:
    """SRC-11: text files."""
    p.nation.select("n_nationkey", "n_name").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path := _folder(p, "texts"))
    return readers.texts(p.spark, f"{path}/*.txt").select("text")


@query(
    """SELECT 'c' || CAST(conv_id AS STRING) AS document_id, 'conversation ' || CAST(conv_id AS STRING) AS title, upper(arg_min(role, (-n, first))) AS family, max(pages) AS page_count, max(chars) AS body_chars FROM (
         SELECT conv_id, role, count(*) AS n, min(turn) AS first FROM conversations GROUP BY 1, 2) JOIN (SELECT conv_id, count(DISTINCT turn) AS pages, sum(length(text) + 1) - 1 AS chars FROM conversations GROUP BY 1) USING (conv_id) GROUP BY conv_id"""
)
def search_index_rows(p: Inputs) -> DataFrame:
    """SNK-07: documents as a full-text index takes them."""
    key = F.concat(F.lit("c"), F.col("conv_id").cast("string"))
    pages = p.conversations.select(key.alias("document_id"), F.col("turn").alias("page"), F.col("role").alias("label"), "text")
    catalog = p.conversations.select(key.alias("document_id"), F.concat(F.lit("conversation "), F.col("conv_id").cast("string")).alias("title"), F.lit("2018 January 04").alias("dd")).distinct()
    return sinks.search_documents(pages, catalog).select("document_id", "title", "family", "page_count", F.length("body").alias("body_chars"))


@query("SELECT vec_id AS document_id, vec_id % 3 AS page, CASE WHEN vec_id % 2 = 0 THEN 'even' ELSE 'unknown' END AS label, len(embedding) AS dim FROM embeddings")
def vector_points(p: Inputs) -> DataFrame:
    """SNK-08: vectors of pages with the label of the page or of its document."""
    rows = p.embeddings.select(F.col("vec_id").alias("document_id"), (F.col("vec_id") % 3).alias("page"), F.when(F.col("vec_id") % 2 == 0, "even").alias("label"))
    vectors = p.embeddings.select(F.col("vec_id").alias("document_id"), (F.col("vec_id") % 3).alias("page"), F.col("embedding").alias("vector"))
    dim = len(p.embeddings.select("embedding").first()[0])
    return sinks.page_points(rows, vectors, dim).select("document_id", "page", "label", F.size("vector").alias("dim"))


@query("""SELECT run_id, string_agg('## ' || title || chr(10) || chr(10) || body, chr(10) || chr(10) ORDER BY position) AS markdown FROM (SELECT conv_id AS run_id, turn AS position, role AS title, text AS body FROM conversations) GROUP BY run_id""")
def run_reports(p: Inputs) -> DataFrame:
    """SNK-10: sections of runs as Markdown."""
    return sinks.report(p.conversations.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("position"), F.col("role").alias("title"), F.col("text").alias("body")))


# --- bindings, chains and questions


@query(
    """WITH e AS (SELECT o_orderkey AS edge_id, o_custkey AS a, o_custkey % 7 AS b, o_orderkey % 5 = 0 AS hard FROM orders), n AS (SELECT c_custkey AS node, c_nationkey % 5 AS anchor, c_custkey % 3 AS artifact FROM customer)
       SELECT edge_id, CASE WHEN a % 10 = 1 AND b = 1 THEN 'kg_path' WHEN a % 10 = 2 AND b = 2 THEN 'link' WHEN x.anchor = y.anchor THEN 'same_anchor' WHEN x.artifact = y.artifact AND NOT hard THEN 'same_artifact' END AS how FROM e LEFT JOIN n x ON x.node = a LEFT JOIN n y ON y.node = b"""
)
def satisfied_edges(p: Inputs) -> DataFrame:
    """GR-12: what joins the ends of a pattern's edges."""
    edges = p.orders.select(F.col("o_orderkey").alias("edge_id"), F.col("o_custkey").alias("a"), (F.col("o_custkey") % 7).alias("b"), (F.col("o_orderkey") % 5 == 0).alias("hard"))
    ends = lambda k: p.orders.where(f"o_custkey % 10 = {k} AND o_custkey % 7 = {k}").select((F.col("o_custkey") % 7).alias("src"), F.col("o_custkey").alias("dst"))
    places = p.customer.select(F.col("c_custkey").alias("node"), (F.col("c_nationkey") % 5).alias("anchor_id"), (F.col("c_custkey") % 3).alias("artifact_id"))
    return mentions.satisfied(edges, ends(1), ends(2), places)


@query(
    """SELECT var, candidate, source, row_number() OVER (PARTITION BY var ORDER BY source, score DESC, candidate) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY var, source ORDER BY score DESC, candidate) AS i FROM (
           SELECT n_nationkey AS var, s_suppkey AS candidate, s_suppkey % 3 AS source, s_acctbal AS score, row_number() OVER (PARTITION BY n_nationkey, s_suppkey % 20 ORDER BY s_suppkey % 3, s_acctbal DESC, s_suppkey) AS k
           FROM nation JOIN supplier ON s_nationkey % 5 = n_regionkey) WHERE k = 1) WHERE i <= 5"""
)
def variable_candidates(p: Inputs) -> DataFrame:
    """SLT-02: candidates for the variables of a category."""
    variables = p.nation.select(F.col("n_nationkey").alias("var"), F.col("n_regionkey").cast("long").alias("category"))
    found = p.supplier.select((F.col("s_nationkey") % 5).cast("long").alias("category"), F.col("s_suppkey").alias("candidate"), (F.col("s_suppkey") % 20).alias("key"), (F.col("s_suppkey") % 3).alias("source"), F.col("s_acctbal").alias("score"))
    return mentions.variable_candidates(variables, found, 5)


@query("SELECT o_orderkey FROM (SELECT *, max(o_totalprice / 500000) OVER (PARTITION BY o_custkey % 5, o_custkey) AS best FROM orders) WHERE NOT (o_orderkey % 2 = 0 AND best - o_totalprice / 500000 >= 0.18)")
def pruned_hypotheses(p: Inputs) -> DataFrame:
    """SLT-12: generic hypotheses go that stand far below the best of their place."""
    h = p.orders.select("o_orderkey", (F.col("o_custkey") % 5).alias("category"), F.col("o_custkey").alias("anchor_id"), (F.col("o_orderkey") % 2 == 0).alias("generic"), (F.col("o_totalprice") / 500000).alias("confidence"))
    return mentions.pruned(h).select("o_orderkey")


@query("SELECT p_partkey AS mention_id, 'node ' || p_name AS node_id, 1.0 AS score FROM part")
def mention_links(p: Inputs) -> DataFrame:
    """SLT-13: nodes that surfaces lead to."""
    return mentions.link_lookup(p.part.select(F.col("p_partkey").alias("mention_id"), F.upper("p_name").alias("surface")), p.part.select(F.concat(F.lit("node "), "p_name").alias("node_id"), F.col("p_name").alias("name")).distinct())


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'WHO,WHEN' WHEN 1 THEN 'HOW' WHEN 2 THEN 'WHAT' ELSE 'WHAT' END AS slots FROM orders")
def question_slots(p: Inputs) -> DataFrame:
    """TRC-01: slots that questions ask for and that there are."""
    k = F.col("o_orderkey") % 4
    asked = F.when(k == 0, "Who ordered it, and when?").when(k == 1, "How was it sent?").when(k == 2, "Why so late?").otherwise("Tell me")
    return p.orders.select("o_orderkey", F.array_join(intent.required_slots(asked, F.array(*map(F.lit, ["WHO", "WHEN", "HOW", "WHAT"]))), ",").alias("slots"))


@query(
    """WITH c AS (SELECT o_orderkey AS candidate_id, o_custkey % 50 AS m, o_custkey % 9 AS a FROM orders), x AS (SELECT DISTINCT n_regionkey AS chain_id, CAST(n_nationkey AS BIGINT) AS m FROM nation), y AS (SELECT DISTINCT n_regionkey AS chain_id, CAST(n_nationkey % 7 AS BIGINT) AS a FROM nation),
       j AS (SELECT DISTINCT chain_id, candidate_id FROM c JOIN x USING (m))
       SELECT chain_id, candidate_id, 'mention' AS by FROM j UNION SELECT chain_id, candidate_id, 'anchor' FROM c JOIN y USING (a) WHERE (chain_id, candidate_id) NOT IN (SELECT (chain_id, candidate_id) FROM j)"""
)
def chain_members_by(p: Inputs) -> DataFrame:
    """TRC-03: candidates that chains name, by mention or else by anchor."""
    c = p.orders.select(F.col("o_orderkey").alias("candidate_id"), (F.col("o_custkey") % 50).alias("mention_id"), (F.col("o_custkey") % 9).alias("anchor_id"))
    n = p.nation.select(F.col("n_regionkey").alias("chain_id"), F.col("n_nationkey").cast("long").alias("mention_id"), (F.col("n_nationkey") % 7).cast("long").alias("anchor_id"))
    return chains.membership(c, n.select("chain_id", "mention_id").distinct(), n.select("chain_id", "anchor_id").distinct())


@query(
    """SELECT 'ch' || CAST(o_custkey % 40 AS STRING) AS chain, string_agg(DISTINCT s, ',' ORDER BY s) FILTER (WHERE s IN ('WHAT', 'WHO', 'WHY')) AS present, CASE WHEN bool_or(s = 'WHAT') THEN '' ELSE 'WHAT,' END || CASE WHEN bool_or(s = 'WHO') THEN '' ELSE 'WHO,' END || 'WHY' AS missing
       FROM (SELECT o_custkey, CASE o_orderkey % 4 WHEN 0 THEN 'WHAT' WHEN 1 THEN 'WHO' WHEN 2 THEN 'WHEN' ELSE 'EVIDENCE' END AS s FROM orders) GROUP BY 1"""
)
def required_set_difference(p: Inputs) -> DataFrame:
    """SET-02, MSC-13: required slots that chains have, and that they lack."""
    k = F.col("o_orderkey") % 4
    m = p.orders.select(F.concat(F.lit("ch"), (F.col("o_custkey") % 40).cast("string")).alias("chain"), F.when(k == 0, "WHAT").when(k == 1, "WHO").when(k == 2, "WHEN").otherwise("EVIDENCE").alias("slot_type"))
    return chains.answerability(m, "chain", ["WHAT", "WHO", "WHY"]).select("chain", "present", "missing")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'DATE' END AS category, round(CASE o_orderkey % 3 WHEN 0 THEN 0.75 WHEN 1 THEN 0.5 ELSE 1 / 1.05 END, 9) AS share, o_orderkey % 3 = 1 AS suppressed FROM orders")
def typed_mentions(p: Inputs) -> DataFrame:
    """FLT-09, STR-26: the category that most speaks for, unless others speak as loud."""
    k = F.col("o_orderkey") % 3
    rules = {"PERSON": F.when(k == 0, 0.75).when(k == 1, 0.45).otherwise(0.0), "ORG": F.when(k == 0, 0.25).when(k == 1, 0.5).otherwise(0.05), "DATE": F.when(k == 2, 1.0).when(k == 1, 0.05).otherwise(0.0)}
    return mentions.typed(p.orders.select("o_orderkey"), rules).select("o_orderkey", "category", "share", "suppressed")


@query("SELECT slot_id, person, role, score FROM (SELECT *, row_number() OVER (PARTITION BY slot_id, person ORDER BY score DESC, role) AS i FROM (SELECT p.c_nationkey AS slot_id, p.c_name AS person, r.c_mktsegment AS role, sum(CASE WHEN p.c_custkey % 4 = r.c_custkey % 4 THEN 2 ELSE 1 END) AS score FROM customer p JOIN customer r ON p.c_nationkey = r.c_nationkey AND p.c_custkey % 2 = r.c_custkey % 2 AND p.c_custkey % 5 = 0 AND r.c_custkey % 5 = 1 GROUP BY 1, 2, 3)) WHERE i = 1")
def person_roles(p: Inputs) -> DataFrame:
    """SLT-10: the role that shares most with a person."""
    kind = F.when(F.col("c_custkey") % 5 == 0, "person").when(F.col("c_custkey") % 5 == 1, "role")
    pieces = p.customer.select(F.col("c_nationkey").alias("slot_id"), kind.alias("kind"), F.when(kind == "person", F.col("c_name")).otherwise(F.col("c_mktsegment")).alias("surface"), (F.col("c_custkey") % 4).alias("anchor_id"), (F.col("c_custkey") % 2).alias("artifact_id"))
    return mentions.roles(pieces)


@query("SELECT p_partkey AS anchor_id, 'WHEN' AS slot_type, 'date' AS role, 0.6 AS weight, '2018-06-04' AS surface FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 'WHO', 'author', 0.8, 'by ' || split_part(p_name, ' ', 1) FROM part")
def augmented_slots(p: Inputs) -> DataFrame:
    """SLT-09: what a table of patterns finds in anchors."""
    text = F.concat(F.lit("Written by "), "p_name", F.when(F.col("p_partkey") % 2 == 0, " on 2018-06-04").otherwise(""))
    return mentions.augmented(p.part.select(F.col("p_partkey").alias("anchor_id"), text.alias("raw_text")), [("WHEN", r"\b\d{4}-\d{2}-\d{2}\b", 0.6, "date"), ("WHO", r"by \w+", 0.8, "author")])


@query(
    """, w AS (SELECT *, row_number() OVER (PARTITION BY slot_type, var_name, surface, artifact_id ORDER BY reliability_score DESC, uid) AS k FROM witnesses)
       SELECT uid, CASE WHEN slot_type LIKE 'WHO%' THEN var_name || CAST(row_number() OVER (PARTITION BY slot_type, var_name ORDER BY reliability_score DESC, uid) AS STRING) ELSE var_name END AS var_name FROM w WHERE k = 1""",
    ("witnesses",),
)
def emitted_witnesses(p: Inputs) -> DataFrame:
    """SLT-07, GR-14: each piece once, those of evidence numbered."""
    w = p.witnesses.select(F.col("slot_type").alias("slot_id"), F.when(F.col("slot_type").startswith("WHO"), "EVIDENCE").otherwise("x").alias("slot_type"), F.col("var_name").alias("var"), "surface", F.col("artifact_id").alias("address"), F.col("reliability_score").alias("score"), F.col("uid").alias("piece_id"))
    return mentions.emitted(w).select(F.col("piece_id").alias("uid"), "var_name")


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'multi' WHEN 1 THEN 'yes_no' ELSE 'factoid' END AS kind, CASE o_orderkey % 3 WHEN 0 THEN 2 ELSE 1 END AS n_parts, CASE o_orderkey % 3 WHEN 0 THEN '' WHEN 1 THEN 'Acme Corp' ELSE 'red fox' END AS entities FROM orders")
def parsed_questions(p: Inputs) -> DataFrame:
    """INT-01: kind, parts and entities of questions."""
    k = F.col("o_orderkey") % 3
    q = p.orders.select("o_orderkey", F.when(k == 0, "who ordered it and when was it sent?").when(k == 1, "Did Acme Corp pay?").otherwise('Where is the "red fox"?').alias("question"))
    return intent.parsed(q).select("o_orderkey", "kind", F.size("parts").alias("n_parts"), F.array_join("entities", "|").alias("entities"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'beta,Alpha' ELSE 'alpha' END AS hints, CASE WHEN c_custkey % 3 = 0 THEN 'WHAT,WHO' ELSE 'WHO' END AS slots, CASE WHEN c_custkey % 2 = 0 THEN 'x' ELSE 'alpha' END AS terms, CASE WHEN c_custkey % 2 = 0 THEN 'x OR beta OR Alpha' ELSE 'alpha' END AS query FROM customer")
def corrected_intents(p: Inputs) -> DataFrame:
    """INT-04, INT-06: intents with their faults mended, and the query they plan."""
    k, one = F.col("c_custkey"), lambda x: F.array(F.lit(x))
    i = p.customer.select(k.alias("intent_id"), one("Alpha").alias("entities"), F.when(k % 2 == 0, one("beta")).otherwise(one("alpha")).alias("hints"), F.when(k % 3 == 0, one("WHAT")).otherwise(one("WHO")).alias("slots"), one("WHO").alias("needed"), F.when(k % 2 == 0, F.array(F.lit("X"), F.lit("x "))).otherwise(F.array().cast("array<string>")).alias("terms"))
    fixed = intent.corrected(i)
    return fixed.join(intent.query_plan(fixed), "intent_id").select(F.col("intent_id").alias("c_custkey"), F.array_join("hints", ",").alias("hints"), F.array_join("slots", ",").alias("slots"), F.array_join("terms", ",").alias("terms"), "query")


# --- contradictions

_NEG = "CASE o_orderkey % 5 WHEN 0 THEN 'The parcel was not shipped that day' ELSE 'The parcel was shipped that day' END"


@query(
    f"""WITH w AS (SELECT o_orderkey AS uid, o_custkey, {_NEG} AS txt, o_orderkey % 5 = 0 AS neg FROM orders)
        SELECT CAST(least(a.s, b.s) AS STRING) AS uid_a, CAST(greatest(a.s, b.s) AS STRING) AS uid_b, CASE WHEN a.s < b.s THEN (CASE WHEN a.neg THEN a.s ELSE b.s END) ELSE (CASE WHEN b.neg THEN b.s ELSE a.s END) END AS weaker_uid
        FROM (SELECT *, CAST(uid AS STRING) AS s FROM w) a JOIN (SELECT *, CAST(uid AS STRING) AS s FROM w) b ON a.o_custkey = b.o_custkey AND a.s < b.s WHERE a.neg OR b.neg"""
)
def conflict_negation(p: Inputs) -> DataFrame:
    """R3, STR-27: one text negates what the other says."""
    o = p.orders
    said = F.when(F.col("o_orderkey") % 5 == 0, "The parcel was not shipped that day").otherwise("The parcel was shipped that day")
    w = o.select(F.col("o_orderkey").cast("string").alias("uid"), F.concat(F.lit("s"), F.col("o_custkey").cast("string")).alias("slot_type"), F.lit("").alias("var_name"), F.lit("the parcel was shipped that day").alias("surface"), said.alias("content_excerpt"), F.lit(0.5).alias("reliability_score"), F.lit("").alias("kg0_entity_id"), F.lit("").alias("artifact_id"), F.lit("GROUNDED").alias("quality"), F.lit("").alias("claim_uid"))
    return conflict.detect(conflict.grouped(conflict.usable(w), ["slot_type"]), conflict.negated()).select("uid_a", "uid_b", "weaker_uid")


@query(
    """WITH w AS (SELECT CAST(c_custkey AS STRING) AS uid, c_nationkey AS k, c_custkey % 13 AS art, c_custkey % 3 AS v, 0.3 + (c_custkey % 50) / 100.0 AS r FROM customer)
       SELECT a.uid AS uid_a, b.uid AS uid_b, round(least((a.r + b.r) / 2 * 0.8, 1.0), 9) AS confidence, CASE WHEN a.r <= b.r THEN a.uid ELSE b.uid END AS weaker_uid FROM w a JOIN w b ON a.k = b.k AND a.uid < b.uid AND a.art <> b.art AND a.v <> b.v"""
)
def conflict_cross_artifact(p: Inputs) -> DataFrame:
    """R4: descriptions of one entity in two artifacts that do not fit."""
    k = F.col("c_custkey")
    said = F.when(k % 3 == 0, "a small red house by the river bank").when(k % 3 == 1, "one large company from another far country").otherwise("some very old ship without any sails left")
    w = p.customer.select(k.cast("string").alias("uid"), F.lit("").alias("slot_type"), F.lit("").alias("var_name"), said.alias("surface"), said.alias("content_excerpt"), (0.3 + (k % 50) / 100.0).alias("reliability_score"), F.col("c_nationkey").cast("string").alias("kg0_entity_id"), (k % 13).cast("string").alias("artifact_id"), F.lit("GROUNDED").alias("quality"), F.lit("").alias("claim_uid"))
    within, without = conflict.cross_artifact(conflict.usable(w))
    return within.unionByName(without).select("uid_a", "uid_b", "confidence", "weaker_uid")


@query(
    """WITH n AS (SELECT DISTINCT p_name FROM part), r AS (SELECT p_name AS id, p_name AS k, split_part(p_name, ' ', 2) AS l FROM n UNION ALL SELECT 'turned ' || p_name, p_name, split_part(p_name, ' ', 2) FROM n)
       SELECT a.id AS id1, b.id AS id2, CASE WHEN a.k = b.k THEN 1 ELSE 2 END AS pass FROM r a JOIN r b ON a.l = b.l AND a.id < b.id WHERE a.k = b.k OR length(a.l) >= 4"""
)
def person_candidates(p: Inputs) -> DataFrame:
    """SET-05: pairs of names that may be one person, by whole name or by last name, each once."""
    names = p.part.select("p_name").distinct()
    turned = F.concat(F.split_part("p_name", F.lit(" "), F.lit(2)), F.lit(", "), F.split_part("p_name", F.lit(" "), F.lit(1)))
    rows = names.select(F.col("p_name").alias("id"), F.col("p_name").alias("val")).unionByName(names.select(F.concat(F.lit("turned "), "p_name").alias("id"), turned.alias("val")))
    return resolve.candidates(rows, "id", "val", "person").select("id1", "id2", "pass")
