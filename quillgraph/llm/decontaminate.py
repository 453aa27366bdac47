"""Benchmark decontamination: SimHash of item-sized windows, DataFrame operations only.

A document is contaminated by an item of n words if one of its windows of n words has, with the item, a weighted Jaccard similarity of
``similarity`` or more: shingles of ``shingle`` words (of all words, if the item has fewer), repeats counted.  A document of fewer words than
the item is one window as a whole.

1. Anchors.  Such a window shares all but u = m (1 - t) / (1 + t) of its m shingles with the item, so it has a run of at least
   (m - u) / (u + 1) shared ones in a row.  It is enough to look up every k-th shingle of a document, k the shortest such run of any item.
2. Windows.  Every window that holds enough looked-up shingles of an item (all of the window but u) is a candidate for that item, whatever the
   order of words within it; it gets a SimHash over its shingles.
3. Search.  A window and its items meet on ``radius`` + 1 blocks of bits: two fingerprints that differ in at most ``radius`` bits agree on one
   block at least, so all within the radius are found.  A document shorter than the item goes to the proof at once.
4. Proof.  The exact weighted similarity decides.

Blocks alone would not tell items apart, as a radius wide enough for ``similarity`` leaves blocks of two or three bits; so the item that a
window is a candidate for is part of the key, and a window never meets an item that it shares no shingles with.

The benchmark's shingles are broadcast only if they are counted to be at most ``MOST_BROADCAST``; beyond that the joins are by shuffle.

Defined results: words are lower-cased; null and empty texts and items match nothing; rows without doc_id or item_id are not searched;
rows that repeat a doc_id are one document; items of equal text are all reported; ties of windows go to the first; an empty benchmark or
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import packed, settled, small, unpacked

SHINGLE = 5
SIMILARITY = 0.8
RADIUS = 24
MOST_BROADCAST = 200_000
MOST_STRIDE = 8


def _words(text: Column) -> Column:
    clean = F.btrim(F.lower(text), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(clean != "", F.split(clean, r"[\x20\x09-\x0D]+"))


def _shingles(words: Column, first: Column, last: Column, width: int, step: int = 1) -> Column:
    """Hashes of the shingles that start at ``first``, ``first`` + step ... up to ``last``."""
    return F.transform(F.sequence(first, last, F.lit(step)), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))


def _fingerprints(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and fp from rows (keys, h, w): a bit is set if it is in over half of the weight."""
    sums = rows.groupBy(*keys).agg(F.sum("w").alias("m"), *[F.sum(F.when(F.col("h").bitwiseAND(F.lit(1 << b if b < 63 else -(1 << 63))) != 0, F.col("w"))).alias(f"b{b}") for b in range(64)])
    bits = [F.when(F.coalesce(F.col(f"b{b}"), F.lit(0)) * 2 > F.col("m"), F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")) for b in range(64)]
    return sums.select(*keys, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fp"))


def _blocks(radius: int) -> Column:
    """Array of (block, bits) of fp."""
    edges = [64 * i // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1)).alias("bits")) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))])


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, start (first word of the best window), n_words (its size): every contaminated document and item."""
    spent = (1 - similarity) / (1 + similarity)
    items = benchmark.where("item_id IS NOT NULL").select("item_id", _words(F.col("text")).alias("words")).where("words IS NOT NULL").withColumn("n", F.size("words"))
    items = items.withColumn("width", F.least(F.col("n"), F.lit(shingle))).withColumn("m", F.col("n") - F.col("width") + 1)
    # Guard against rounding down a product that is whole in exact arithmetic.
    items = items.withColumn("u", F.floor(F.col("m") * spent + 1e-9).cast("int"))
    items = items.withColumn("run", F.ceil((F.col("m") - F.col("u")) / (F.col("u") + 1)).cast("int"))
    items = settled(items.dropDuplicates(["item_id", "words"]), "items")
    plan = items.groupBy("width").agg(F.min("run").alias("run"), F.sum("m").alias("shingles")).orderBy("width").collect()  # one row per width up to ``shingle``
    every = [_matches(docs, items.where(F.col("width") == r.width), r.width, max(1, min(r.run, MOST_STRIDE)), r.shingles, similarity, radius) for r in plan]
    none = docs.sparkSession.createDataFrame([], "doc_id long, item_id long, similarity double, start int, n_words int")
    return reduce(DataFrame.unionByName, every, none)


def _matches(docs: DataFrame, items: DataFrame, width: int, step: int, shingles: int, similarity: float, radius: int) -> DataFrame:
    hashed = items.select("item_id", "n", "m", "u", _shingles(F.col("words"), F.lit(0), F.col("m") - 1, width).alias("hashes"))
    weighted = settled(hashed.select("item_id", "n", "m", "u", F.explode("hashes").alias("h")).groupBy("item_id", "n", "m", "u", "h").agg(F.count("*").alias("w")), "weighted")
    sized = lambda df: small(df, shingles, MOST_BROADCAST)
    prints = settled(_fingerprints(weighted, ["item_id", "n"]), "prints")
    n_blocks = prints.count() * (radius + 1)
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _words(F.col("text")).alias("words")).where("words IS NOT NULL").withColumn("size", F.size("words")).where(F.col("size") >= width)
    # 1. Anchors: only ids, places and hashes leave the scan; most meet no item and end here.  A whole document of M < m shingles can reach the
    # similarity if M >= t m; then (M - t m) / (1 + t) of its shingles at most are not the item's, and every k-th from the first on is enough.
    spare = F.col("own") - similarity * F.col("m")
    looked = texts.select("doc_id", "size", F.posexplode(_shingles(F.col("words"), F.lit(0), F.col("size") - width, width, step)).alias("at", "h"))
    hits = looked.join(sized(weighted.select("item_id", "n", "m", "u", "h")), "h").withColumn("own", F.least("n", "size") - width + 1)
    hits = hits.where((F.col("own") == F.col("m")) | (spare >= -1e-9)).withColumn("u", F.when(F.col("own") == F.col("m"), F.col("u")).otherwise(F.floor(spare / (1 + similarity) + 1e-9).cast("int")))
    hits = settled(hits.select("doc_id", "size", "item_id", "n", "m", "own", "u", (F.col("at") * step).alias("pos")).distinct(), "hits")
    # 2. Windows that hold enough of them: of the looked-up shingles of a window, at most u are not the item's.  A hit is in the windows from
    # ``first`` to ``last``; between these places the number of hits does not change, so only starts that reach the least number are made.
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("own") + 1), F.greatest(F.lit(0), F.least(F.col("pos"), F.col("size") - F.col("n")))
    pair = ["doc_id", "item_id", "n", "m", "own", "u"]
    edges = hits.where(first <= last).select(*pair, F.explode(F.array(F.struct(first.alias("start"), F.lit(1).alias("d")), F.struct((last + 1).alias("start"), F.lit(-1).alias("d")))).alias("e"))
    by = W.partitionBy(*pair).orderBy("start")
    steps = edges.groupBy(*pair, F.col("e.start").alias("start")).agg(F.sum("e.d").alias("d"))
    runs = steps.withColumns({"found": F.sum("d").over(by.rowsBetween(W.unboundedPreceding, W.currentRow)), "until": F.lead("start").over(by)})
    runs = runs.where(F.col("until").isNotNull() & (F.col("found") >= F.greatest(F.lit(1), F.floor(F.col("own") / step) - F.col("u"))))
    opened = runs.withColumn("start", F.explode(F.sequence(F.col("start"), F.col("until") - 1)))
    asked = F.ceil((F.col("start") + F.col("own")) / F.lit(step)) - F.ceil(F.col("start") / F.lit(step))
    enough = opened.where(F.col("found") >= F.greatest(F.lit(1), asked - F.col("u")))
    enough = settled(enough.select("doc_id", "item_id", "start", "n", "m", "own"), "enough")
    windows = enough.groupBy("doc_id").agg(F.collect_set(F.struct("start", "n", "m", "own")).alias("windows"))
    # Texts are shuffled as they are, and cut to words behind the join.
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    read = plain.join(windows.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).withColumn("words", _words(F.col("text")))
    whole = F.filter("windows", lambda w: (w["own"] == w["m"]) | (w["own"] == F.size("words") - width + 1))
    cut = read.select("doc_id", F.explode(F.transform(whole, lambda w: F.struct(*[w[c].alias(c) for c in ("start", "n", "m", "own")], _shingles(F.col("words"), w["start"], w["start"] + w["own"] - 1, width).alias("hashes")))).alias("w"))
    cut = settled(cut.select("doc_id", "w.start", "w.n", "w.m", "w.own", "w.hashes").distinct(), "windows")
    pieces = cut.where("own = m").select("doc_id", "start", "n", F.explode("hashes").alias("h")).withColumn("w", F.lit(1))
    marked = settled(_fingerprints(pieces, ["doc_id", "start", "n"]), "marked")
    # 3. Search by blocks.
    own = enough.where("own = m").select("doc_id", "start", "n", "item_id")
    near = marked.join(own.hint("merge"), ["doc_id", "start", "n"]).select("doc_id", "start", "n", "item_id", "fp", F.explode(_blocks(radius)).alias("b")).select("doc_id", "start", "n", "item_id", "fp", "b.block", "b.bits")
    known = prints.withColumn("item_fp", F.col("fp")).select("item_id", "item_fp", F.explode(_blocks(radius)).alias("b")).select("item_id", "item_fp", "b.block", "b.bits")
    met = near.join(small(known, n_blocks, MOST_BROADCAST), ["item_id", "block", "bits"]).where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius).select("doc_id", "start", "n", "item_id", (F.col("n") - width + 1).alias("own")).distinct()
    met = met.unionByName(enough.where("own < m").select("doc_id", "start", "n", "item_id", "own"))
    # 4. Proof: the weight that both have, over the weight that either has.
    # Both grow with the documents, so they are joined by merge at every size.
    pairs = met.hint("merge").join(cut, ["doc_id", "start", "n", "own"]).select("doc_id", "start", "m", "own", "item_id", F.explode("hashes").alias("h")).groupBy("doc_id", "start", "m", "own", "item_id", "h").agg(F.count("*").alias("held"))
    both = pairs.join(sized(weighted.select("item_id", "h", "w")), ["item_id", "h"]).groupBy("doc_id", "start", "m", "own", "item_id").agg(F.sum(F.least("held", "w")).alias("both"))
    scored = both.withColumn("similarity", F.col("both") / (F.col("m") + F.col("own") - F.col("both"))).where(F.col("similarity") >= similarity - 1e-12)
    best = F.row_number().over(W.partitionBy("doc_id", "item_id").orderBy(F.desc("similarity"), "start"))
    return scored.withColumn("_rank", best).where("_rank = 1").select("doc_id", F.col("item_id").cast("long").alias("item_id"), "similarity", "start", (F.col("own") + width - 1).alias("n_words"))


def clean(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that no item contaminates."""
    found = settled(matches(docs, benchmark, **options).select(F.col("doc_id").alias("leaked")).distinct(), "leaks")
    return packed(docs, "doc_id").join(found, F.col("doc_id").cast("long") == F.col("leaked"), "left_anti").select(*unpacked(docs.columns, "doc_id"))
