"""Mentions, entity and link hypotheses, slot bindings."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.functions import scores
from quillgraph.functions import text as t
from quillgraph.operators.build import keep_first
from quillgraph.operators.graph import numbered

#: Category, priority, pattern.  A table, so that a corpus brings its own.
PATTERNS = [
    ("DATE", 90, r"\b(?:19|20)\d{2}-\d{2}-\d{2}\b"),
    ("EMAIL", 80, r"\b[\w.+-]+@[\w-]+\.[\w.]+\b"),
    ("MONEY", 70, r"\$\s?\d[\d,]*(?:\.\d+)?"),
    ("DOC_ID", 60, r"\b[a-z]{2,4}\d{3,6}\b"),
    ("NAME", 50, r"\b[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+\b"),
    ("NUMBER", 10, r"\b\d+(?:\.\d+)?\b"),
]


def extract(anchors: DataFrame, patterns: list[tuple[str, int, str]] = PATTERNS) -> DataFrame:
    """anchor_id, start, end, surface, category: what any pattern finds; of overlapping finds that of higher priority, then the longer, then the first.

    Resolving overlaps walks along one text, so it runs over Arrow batches; a batch holds whole texts and nothing is shuffled.
    """
    import re

    compiled = [(c, p, re.compile(x)) for c, p, x in patterns]
    kind = anchors.schema["anchor_id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for anchor, text in zip(rows["anchor_id"], rows["raw_text"], strict=True):
                taken: list[tuple[int, int]] = []
                found = [(-p, m.start() - m.end(), m.start(), m.end(), c) for c, p, x in compiled for m in x.finditer(text or "")]
                for _, _, a, b, c in sorted(found):
                    if all(b <= x or a >= y for x, y in taken):
                        taken.append((a, b))
                        out.append((anchor, a, b, text[a:b], c))
            yield pd.DataFrame(out, columns=["anchor_id", "start", "end", "surface", "category"])

    return anchors.select("anchor_id", "raw_text").mapInPandas(run, f"anchor_id {kind}, start int, end int, surface string, category string")


def typed(mentions: DataFrame, rules: dict[str, Column], least: float = 0.4, margin: float = 0.1) -> DataFrame:
    """Mentions with the category of the largest share of scores; suppressed if the share or its lead over the next is small."""
    array = F.array(*[F.struct(c.cast("double").alias("score"), F.lit(name).alias("name")) for name, c in rules.items()])
    total = F.aggregate(array, F.lit(0.0), lambda s, x: s + x["score"])
    ranked = F.reverse(F.array_sort(array))
    share = lambda i: F.when(total > 0, F.get(ranked, F.lit(i))["score"] / total).otherwise(0.0)
    return mentions.withColumns({"category": F.get(ranked, F.lit(0))["name"], "share": share(0), "lead": share(0) - share(1)}).withColumn("suppressed", (F.col("share") < least) | (F.col("lead") < margin))


def kg_candidates(links: DataFrame, least_support: int = 1, least_score: float = 0.5, least_margin: float = 0.05) -> DataFrame:
    """hypothesis, candidate, total, support, rank, selected: links (hypothesis, mention_id, candidate, score, rank, weight, ratio) added up per candidate."""
    weight = F.col("weight") * F.col("score") * (1.0 / F.col("rank")) * (0.85 + 0.15 * F.col("ratio"))
    g = links.groupBy("hypothesis", "candidate").agg(F.sum(weight).alias("total"), F.countDistinct("mention_id").alias("support"), F.max("score").alias("best"))
    by = W.partitionBy("hypothesis").orderBy(F.desc("total"), "candidate")
    g = g.withColumns({"rank": F.row_number().over(by), "next": F.lead("total").over(by)})
    ok = (F.col("rank") == 1) & (F.col("support") >= least_support) & (F.col("best") >= least_score) & (F.col("total") - F.coalesce("next", F.lit(0.0)) >= least_margin)
    return g.select("hypothesis", "candidate", "total", "support", "rank", ok.alias("selected"))


def entity_confidence(mentions: DataFrame, bonus: Column | None = None) -> DataFrame:
    """hypothesis, confidence: the best mention's, .05 more for each further artifact up to .2, and what its candidate adds."""
    g = mentions.groupBy("hypothesis").agg(F.max("confidence").alias("best"), F.countDistinct("artifact_id").alias("arts"), F.max(bonus if bonus is not None else F.lit(0.0)).alias("bonus"))
    return g.select("hypothesis", F.least(F.lit(1.0), F.col("best") + F.least(F.lit(0.2), 0.05 * (F.col("arts") - 1)) + F.col("bonus")).alias("confidence"))


def shared_links(held: DataFrame, place: str, entity: str = "hypothesis") -> DataFrame:
    """src, dst, shared: hypotheses that share anchors or artifacts (src < dst)."""
    h = held.select(F.col(entity).alias("src"), F.col(place).alias("p"), "confidence").distinct()
    c = h.groupBy("src").agg(F.max("confidence").alias("c"))
    pairs = h.select("src", "p").distinct().join(h.select(F.col("src").alias("dst"), "p").distinct(), "p").where("src < dst").groupBy("src", "dst").agg(F.count("*").alias("shared"))
    return pairs.join(c.select("src", F.col("c").alias("src_confidence")), "src").join(c.select(F.col("src").alias("dst"), F.col("c").alias("dst_confidence")), "dst")


def link_hypotheses(held: DataFrame, lexical: float = 0.0, cap: int = 1000) -> DataFrame:
    """src, dst, via, confidence: by shared anchor, else by shared artifact; the ``cap`` most confident."""
    a = shared_links(held, "anchor_id").select("src", "dst", F.lit("anchor").alias("via"), scores.shared_anchor_confidence(F.col("src_confidence"), F.col("dst_confidence"), F.col("shared")).alias("confidence"))
    b = shared_links(held, "artifact_id").select("src", "dst", F.lit("artifact").alias("via"), scores.shared_artifact_confidence(F.col("src_confidence"), F.col("dst_confidence"), F.col("shared"), F.lit(lexical)).alias("confidence"))
    return a.unionByName(b.join(a.select("src", "dst"), ["src", "dst"], "left_anti")).orderBy(F.desc("confidence"), "src", "dst").limit(cap)


def satisfied(edges: DataFrame, paths: DataFrame, links: DataFrame, places: DataFrame) -> DataFrame:
    """edge_id, how: the first of KG path, link hypothesis, same anchor, same artifact (for soft edges only) that joins the ends (a, b)."""
    ordered = lambda df, name: df.select(F.least("src", "dst").alias("_x"), F.greatest("src", "dst").alias("_y"), F.lit(True).alias(name)).distinct()
    out = edges.withColumns({"_x": F.least("a", "b"), "_y": F.greatest("a", "b")})
    out = out.join(ordered(paths, "_path"), ["_x", "_y"], "left").join(ordered(links, "_link"), ["_x", "_y"], "left")
    at = lambda side, c, name: places.select(F.col("node").alias(side), F.col(c).alias(name))
    for c in ("anchor_id", "artifact_id"):
        both = edges.join(at("a", c, "_p"), "a").join(at("b", c, "_q"), "b").where("_p = _q").select("edge_id", F.lit(True).alias(f"_{c}")).distinct()
        out = out.join(both, "edge_id", "left")
    how = F.when(F.col("_path"), "kg_path").when(F.col("_link"), "link").when(F.col("_anchor_id"), "same_anchor").when(F.col("_artifact_id") & ~F.col("hard"), "same_artifact")
    return out.select("edge_id", how.alias("how"))


def coherence(subgraphs: DataFrame) -> DataFrame:
    """Subgraphs (bindings: array of struct<var, hard, bound, grounded, artifact>, edges: array of struct<hard, ok>) with coverage and base score."""
    share = lambda xs, ok: F.when(F.size(xs) > 0, F.size(F.filter(xs, ok)) / F.size(xs)).otherwise(1.0)
    hard, soft = F.filter("edges", lambda e: e["hard"]), F.filter("edges", lambda e: ~e["hard"])
    n = lambda xs, ok: F.size(F.filter(xs, ok))
    arts = F.size(F.array_distinct(F.array_compact(F.transform(F.filter("bindings", lambda b: b["bound"]), lambda b: b["artifact"]))))
    base = 10.0 * n(hard, lambda e: e["ok"]) + 1.0 * n(soft, lambda e: e["ok"]) + 1.0 * n("bindings", lambda b: b["bound"]) + 0.5 * n("bindings", lambda b: b["bound"] & b["grounded"]) + 2.0 * F.greatest(F.lit(0), arts - 1)
    return subgraphs.withColumns({
        "hard_coverage": share(hard, lambda e: e["ok"]), "soft_coverage": share(soft, lambda e: e["ok"]), "bound_share": share("bindings", lambda b: b["bound"]),
        "hard_bound": F.forall("bindings", lambda b: ~b["hard"] | b["bound"]), "base_score": base,
    })


def distinct_subgraphs(subgraphs: DataFrame) -> DataFrame:
    """The best subgraph of each set of bindings, in the order of their score."""
    signature = F.array_join(F.array_sort(F.transform("bindings", lambda b: F.concat_ws("=", b["var"], b["artifact"]))), ";")
    best = keep_first(subgraphs.withColumn("signature", signature), ["signature"], F.desc("score"), "subgraph_id")
    return numbered(best, "rank", F.desc("score"), "subgraph_id")


def seeds(hints: DataFrame) -> DataFrame:
    """var, hint: variables that exactly one hint fits; those with several are left to the search."""
    return hints.groupBy("var").agg(F.countDistinct("hint").alias("n"), F.min("hint").alias("hint")).where("n = 1").drop("n")


def variable_candidates(variables: DataFrame, candidates: DataFrame, most: int = 50) -> DataFrame:
    """var, candidate, source, rank: candidates of a variable's category, hypotheses before mentions before anchors; each key once, ``most`` of a source."""
    j = variables.join(candidates, "category")
    j = keep_first(j, ["var", "key"], "source", F.desc("score"), "candidate")
    by = W.partitionBy("var", "source").orderBy(F.desc("score"), "candidate")
    j = j.withColumn("_i", F.row_number().over(by)).where(F.col("_i") <= most)
    return j.select("var", "candidate", "source", F.row_number().over(W.partitionBy("var").orderBy("source", F.desc("score"), "candidate")).alias("rank"))


def emitted(pieces: DataFrame) -> DataFrame:
    """Witnesses of a slot: each (variable, surface, address) once, at the best anchor; EVIDENCE variables numbered, so that co-supporting pieces do not compete."""
    w = keep_first(pieces, ["slot_id", "var", "surface", "address"], F.desc("score"), "piece_id")
    n = F.row_number().over(W.partitionBy("slot_id", "var").orderBy(F.desc("score"), "piece_id"))
    return w.withColumn("var_name", F.when(F.col("slot_type") == "EVIDENCE", F.concat("var", n.cast("string"))).otherwise(F.col("var")))


def collapsed(pieces: DataFrame) -> DataFrame:
    """The best piece of each variable of a slot: score, then longer surface, then id."""
    return keep_first(pieces, ["slot_id", "var"], F.desc("score"), F.desc(F.length("surface")), "piece_id")


def augmented(anchors: DataFrame, table: list[tuple[str, str, float, str]]) -> DataFrame:
    """anchor_id, slot_type, role, weight, surface: what a table (slot_type, pattern, weight, role) finds in the anchors' texts."""
    found = [F.when(F.regexp_extract("raw_text", p, 0) != "", F.struct(F.lit(s).alias("slot_type"), F.lit(r).alias("role"), F.lit(float(w)).alias("weight"), F.regexp_extract("raw_text", p, 0).alias("surface"))) for s, p, w, r in table]
    return anchors.select("anchor_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("anchor_id", "x.*")


def roles(pieces: DataFrame) -> DataFrame:
    """slot_id, person, role, score: persons with the role that shares most with them: an anchor counts 2, an artifact 1."""
    p = pieces.where("kind = 'person'").select("slot_id", F.col("surface").alias("person"), "anchor_id", "artifact_id")
    r = pieces.where("kind = 'role'").select("slot_id", F.col("surface").alias("role"), F.col("anchor_id").alias("ra"), F.col("artifact_id").alias("rd"))
    j = p.join(r, "slot_id").where("artifact_id = rd").groupBy("slot_id", "person", "role").agg(F.sum(F.when(F.col("anchor_id") == F.col("ra"), 2).otherwise(1)).alias("score"))
    return keep_first(j, ["slot_id", "person"], F.desc("score"), "role")


def pruned(hypotheses: DataFrame, gap: float = 0.18) -> DataFrame:
    """Hypotheses without generic ones that stand ``gap`` or more below the best of their anchor and category."""
    best = F.max("confidence").over(W.partitionBy("category", "anchor_id"))
    return hypotheses.withColumn("_best", best).where(~(F.col("generic") & (F.col("_best") - F.col("confidence") >= gap))).drop("_best")


def link_lookup(mentions: DataFrame, nodes: DataFrame, margin: float = 0.05, least: float = 0.5) -> DataFrame:
    """mention_id, node_id, score: the node that a mention's hints lead to, if its score leads the next by the margin.  Hints and names meet on phrases."""
    m = mentions.select("mention_id", t.phrase(F.col("surface")).alias("norm"), F.explode(t.link_hints(F.col("surface"))).alias("hint"))
    n = nodes.select("node_id", "name", F.explode(t.link_hints(F.col("name"))).alias("hint"))
    met = m.join(n, "hint").select("mention_id", "norm", "node_id", "name").distinct()
    scored = met.withColumn("ratio", t.sequence_ratio(F.col("norm"), t.phrase(F.col("name")))).withColumn("score", t.link_score(F.col("norm"), F.col("name"), F.col("ratio")))
    by = W.partitionBy("mention_id").orderBy(F.desc("score"), "node_id")
    top = scored.withColumns({"_i": F.row_number().over(by), "_next": F.lead("score").over(by)}).where("_i = 1")
    return top.where((F.col("score") >= least) & (F.col("score") - F.coalesce("_next", F.lit(0.0)) >= margin)).select("mention_id", "node_id", "score")
