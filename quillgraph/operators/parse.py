"""Rows from text lines and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import structs
from quillgraph.functions import text as t
from quillgraph.operators.build import keep_first

CONFIDENCES = ["high", "medium", "low"]


def split_pages(rows: DataFrame, key: str, text: str) -> DataFrame:
    """key, page, text: by ``=== Page N ===`` markers; no marker makes one page 1; what stands before the first marker and empty pages go."""
    raw = F.regexp_replace(t.blank(F.col(text)), r"\r\n?", "\n")
    marker = r"===\s*Page\s+(\d+)\s*==="
    bodies, numbers = F.split(raw, marker), F.regexp_extract_all(raw, F.lit(marker), 1)
    pages = F.when(F.size(numbers) == 0, F.array(F.struct(F.lit(1).alias("page"), F.trim(raw).alias("text")))).otherwise(
        F.zip_with(numbers, F.slice(bodies, F.lit(2), F.greatest(F.lit(1), F.size(bodies) - 1)), lambda n, b: F.struct(n.cast("int").alias("page"), F.trim(F.regexp_replace(b, r"^\s+|\s+$", "")).alias("text")))
    )
    return rows.select(key, F.explode(pages).alias("p")).select(key, "p.page", "p.text").where("text <> ''")


def entity_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """term, category, top, specific, confidence, context, page from ``Entity | Top > Specific | High | context | page`` lines; lines without category or confidence go."""
    p = F.transform(F.split(F.col(line), r"\|"), lambda x: F.trim(x))
    at = F.array_position(F.transform(p, lambda x: F.lower(x).isin(CONFIDENCES)), True).cast("int")
    rows = lines.withColumns({"p": p, "at": at}).where((F.col("at") >= 3) & F.contains(F.get("p", F.col("at") - 2), F.lit(">")))
    top, specific = structs.category_ends(F.get("p", F.col("at") - 2))
    tail = F.element_at("p", -1)
    return rows.select(
        F.array_join(F.slice("p", F.lit(1), F.col("at") - 2), " || ").alias("term"), F.get("p", F.col("at") - 2).alias("category"), top.alias("top"), specific.alias("specific"), F.lower(F.get("p", F.col("at") - 1)).alias("confidence"),
        F.when(F.size("p") > F.col("at"), F.get("p", F.col("at"))).alias("context"), F.when(tail.rlike(r"^\d+$") & (F.size("p") > F.col("at")), tail.cast("int")).alias("page"),
    )


def relationship_lines(lines: DataFrame, order: str, line: str = "value") -> DataFrame:
    """term_1, relationship, term_2, category, confidence of lines with five fields; comments, rules and unknown confidences go; each 4-tuple once, the first."""
    p = F.transform(F.split(F.col(line), r"\|"), lambda x: F.trim(x))
    rows = lines.withColumn("p", p).where((F.size("p") == 5) & ~F.col(line).rlike(r"^\s*(?:#|-{3,}|={3,})") & F.lower(F.get("p", F.lit(4))).isin(CONFIDENCES) & (F.get("p", F.lit(0)) != "") & (F.get("p", F.lit(2)) != ""))
    out = rows.select(F.col(order).alias("_o"), *[F.get("p", F.lit(i)).alias(n) for i, n in enumerate(["term_1", "relationship", "term_2", "category"])], F.lower(F.get("p", F.lit(4))).alias("confidence"))
    return keep_first(out, ["term_1", "relationship", "term_2", "category"], "_o").drop("_o")


def missing_names(relations: DataFrame, inventory: DataFrame) -> DataFrame:
    """name: ends of relations that the inventory has under none of its keys."""
    ends = relations.select(F.col("term_1").alias("name")).unionByName(relations.select(F.col("term_2").alias("name"))).distinct()
    keys = inventory.select(F.explode(t.entity_variants(F.col("term"))).alias("key")).distinct()
    asked = ends.select("name", F.explode(t.entity_variants(F.col("name"))).alias("key"))
    return ends.join(asked.join(keys, "key", "left_semi").select("name").distinct(), "name", "left_anti")


def sane_relations(relations: DataFrame, inventory: DataFrame, order: str) -> DataFrame:
    """Relations whose ends the inventory has, in order, each once."""
    gone = missing_names(relations, inventory)
    kept = relations.join(gone.select(F.col("name").alias("term_1")), "term_1", "left_anti").join(gone.select(F.col("name").alias("term_2")), "term_2", "left_anti")
    return keep_first(kept, ["term_1", "relationship", "term_2"], order)


def enriched(rows: DataFrame, known: DataFrame, value: str) -> DataFrame:
    """Rows (term) with a value by exact name, else by alias key; keys with several values match nothing."""
    only = lambda df: df.groupBy("key").agg(F.min(value).alias("v"), F.countDistinct(value).alias("n")).where("n = 1").select("key", "v")
    exact = only(known.select(F.lower(F.trim("term")).alias("key"), value))
    alias = only(known.select(F.explode(t.entity_variants(F.col("term"))).alias("key"), value))
    out = rows.join(exact.select(F.col("key").alias("_k1"), F.col("v").alias("_v1")), F.lower(F.trim("term")) == F.col("_k1"), "left")
    out = out.join(alias.select(F.col("key").alias("_k2"), F.col("v").alias("_v2")), t.match_key(F.col("term")) == F.col("_k2"), "left")
    return out.withColumn(value, F.coalesce("_v1", "_v2")).drop("_k1", "_k2", "_v1", "_v2")


def edge_category(edges: DataFrame, known: DataFrame) -> DataFrame:
    """Edges with category: exact name, else name without case, else the first known term that contains it."""
    exact = known.groupBy(F.col("term").alias("_e")).agg(F.min_by("category", "seq").alias("c1"))
    folded = known.groupBy(F.lower("term").alias("_f")).agg(F.min_by("category", "seq").alias("c2"))
    # By merge throughout: what is counted of a small file, or exploded from it, is planned as small and would be gathered on the driver.
    out = edges.join(exact.hint("merge"), F.col("term_1") == F.col("_e"), "left").join(folded.hint("merge"), F.lower("term_1") == F.col("_f"), "left").drop("_e", "_f")
    open_ = out.where("c1 IS NULL AND c2 IS NULL").select("term_1").distinct()
    # Containment has no key, but a term that contains a name holds all its runs of three characters; they meet on the name's rarest one.
    grams = lambda c, size: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - size + 1)), lambda i: F.substr(c, i, F.lit(size))))
    # Equal terms are one, by the first of them.
    terms = known.select(F.lower("term").alias("term"), "category", "seq").where("term <> ''").groupBy("term").agg(F.min_by("category", "seq").alias("category"), F.min("seq").alias("seq"))
    low = F.lower("term_1")
    asked = open_.where(F.length("term_1") > 0).select("term_1", F.explode(F.when(F.length(low) >= 3, grams(low, 3)).when(F.length(low) == 2, F.array(low)).otherwise(F.array(low))).alias("gram"))
    holds = terms.withColumn("gram", F.explode(F.concat(grams(F.col("term"), 1), grams(F.col("term"), 2), grams(F.col("term"), 3))))
    counts = holds.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = asked.join(counts.hint("merge"), "gram", "left").groupBy("term_1").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), "gram")).alias("gram"))
    third = rarest.join(holds.hint("merge"), "gram").where(F.contains(F.col("term"), F.lower("term_1"))).groupBy("term_1").agg(F.min_by("category", "seq").alias("c3"))
    return out.join(third.hint("merge"), "term_1", "left").withColumn("category", F.coalesce("c1", "c2", "c3")).drop("c1", "c2", "c3")


#: Steps of a document and the output whose presence, with any content, shows that one is done.
STEPS = {"is_segmented": "labels", "is_ocred": "text", "is_entity_extracted": "entities", "is_relationship_extracted": "relationships"}


def progress(docs: DataFrame, outputs: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """One row per document with a flag (0 or 1) per step; ``outputs``: key, kind, size.  Rows of ``known`` for other documents stay."""
    done = outputs.where("size > 0").groupBy(key).agg(*[F.max((F.col("kind") == kind).cast("int")).alias(step) for step, kind in STEPS.items()])
    now = docs.select(key).distinct().join(done, key, "left").select(key, *[F.coalesce(F.col(step), F.lit(0)).alias(step) for step in STEPS])
    return now if known is None else now.unionByName(known.select(key, *STEPS).join(now.select(key), key, "left_anti"))


def decoded(content: Column) -> Column:
    """Text of a file: UTF-16 or UTF-8 by byte order mark, else UTF-8, else Windows-1252; null if its first 4 096 bytes hold a zero byte; line ends as line feeds."""
    head = F.hex(F.substring(content, 1, 3))
    # Windows-1252 is Latin-1 but for its bytes 0x80 to 0x9F.
    high = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
    plain = F.translate(F.decode(content, "ISO-8859-1"), "".join(a for a, b in high if b), "".join(b for _, b in high if b))
    utf8 = F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(plain)
    zero = F.contains(F.regexp_replace(F.hex(F.substring(content, 1, 4096)), "(..)", "$1 "), F.lit("00 "))
    text = F.when(head.startswith("FFFE") | head.startswith("FEFF"), F.decode(content, "UTF-16")).when(head == "EFBBBF", F.decode(F.substring(content, 4, 2147483647), "UTF-8")).when(zero, F.lit(None)).otherwise(utf8)
    return F.regexp_replace(text, r"\r\n?", "\n")
