"""Substring deduplication on a compacted de Bruijn graph of word k-mers.

A window of ``window`` words is an edge of the graph (from its first to its last ``window`` - 1 words).  A word goes if a window covers it whose
word sequence also starts in a document with a smaller doc_id.

1. Runs.  Each window names the smallest of the hashes of its short k-mers (its minimiser); consecutive windows of one name form a run (a
   super-k-mer), some twenty windows in one row.  Equal windows have equal names, so nothing is sampled.  The windows of a run that a smaller
   document has as a whole go; so does every equal run but that of the smallest document, its representative.
2. Edges.  What is left to compare are representatives of different runs of one name.  Their documents emit the hashes of those windows.
   An edge keeps its source coordinate (smallest doc_id and place), its number of occurrences and signatures of where they are.
3. Paths.  An edge continues another if it follows it in the source and both occur at the same places, shifted by one (no branch before or
   after, no document that ends between).  A join finds the continuations; runs of them compact to one path with its head and length.
4. Spans.  Occurrences of path heads in documents after the source are the repeated spans, with both coordinates; whoever meets the head
   meets the whole path.
5. Check.  Runs and edges are told apart by 95 bits of hashes of word hashes.  With each goes a digest of the words' own bytes, read at its
   coordinates; if any digest differs from that at the source's coordinates, all is done again with other hashes.

Defined results: null and empty texts have no words; rows without doc_id lose nothing and are no source; repeated rows (one doc_id) are no
sources for each other but both lose what smaller documents hold; an empty table gives an empty result; extra columns are carried on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, hashed_words, packed, rolling, settled, sliding, span_hashes, text_chunks, unpacked

WINDOW = 50
ANCHOR = 12
RUN = 64
OUTPUTS = ("n_words", "n_removed", "kept")
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _anchored(texts: list[bytes], window: int, anchor: int, salt: int):
    """Word hashes, document of each word, first word of each document, each window's anchor (0 where there is no window)."""
    h, counts = hashed_words(texts, salt=salt)
    doc = np.repeat(np.arange(len(texts)), counts)
    first = np.cumsum(counts) - counts
    left = np.repeat(first + counts, counts) - np.arange(len(h))
    kmers = np.full(len(h), _TOP)
    got = rolling(h, anchor, salt)
    kmers[: len(got)] = np.minimum(np.maximum(got, np.uint64(1)), _TOP - np.uint64(1))
    kmers[left < anchor] = _TOP
    least = sliding(kmers, window - anchor + 1, np.minimum, int(_TOP)) if len(h) else kmers
    least[left < window] = 0
    return h, doc, first, least


def _digests(texts: list[bytes], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Digests of the words from starts to ends (of the words of all texts), each with one space between words."""
    buf = b" ".join(x for t in texts if (x := b" ".join(t.split())))
    at = np.concatenate([[0], np.flatnonzero(np.frombuffer(buf, np.uint8) == 32) + 1, [len(buf) + 1]])
    view, digest = memoryview(buf), xxhash.xxh3_64_intdigest
    return np.fromiter((digest(view[a:b]) for a, b in zip(at[starts].tolist(), (at[ends] - 1).tolist(), strict=True)), np.uint64, len(starts)).view(np.int64)


def _cut_runs(least: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and end of runs of consecutive windows of one text and one anchor, of at most ``RUN`` windows each."""
    fresh = np.ones(len(least), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(fresh)
    step = np.arange(len(least)) - np.repeat(first, np.diff(np.append(first, len(least))))
    starts = np.flatnonzero((step % RUN == 0) & (least != 0))
    cut = np.flatnonzero((step % RUN == 0))
    ends = np.append(cut, len(least))[np.searchsorted(cut, starts) + 1]
    return starts, ends


def _runs(window: int, anchor: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            h, doc, first, least = _anchored(texts, window, anchor, salt)
            starts, ends = _cut_runs(least, doc)
            words = ends + (window - 1)
            ids, own = (rows.column(c).take(pa.array(doc[starts])) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(least[starts].view(np.int64)), pa.array(span_hashes(h, starts, words, 2 * salt).view(np.int64)), pa.array((span_hashes(h, starts, words, 2 * salt + 1) >> np.uint64(33)).astype(np.int32)),
                    ids, own, pa.array((starts - first[doc[starts]]).astype(np.int32)), pa.array((words - starts).astype(np.int32)), pa.array(_digests(texts, starts, words)),
                ], ["anchor", "run", "c", "doc_id", "row", "pos", "words", "digest"],
            )

    return run


def _windows(window: int, anchor: int, salt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            h, doc, first, least = _anchored(texts, window, anchor, salt)
            starts, ends = _cut_runs(least, doc)
            keys, owner, lists = span_hashes(h, starts, ends + (window - 1), 2 * salt), doc[starts], rows.column("runs")
            keep = np.zeros(len(starts), bool)
            edge = np.searchsorted(owner, np.arange(len(texts) + 1))
            for i in range(len(texts)):
                a, b = edge[i], edge[i + 1]
                if a < b:
                    keep[a:b] = np.isin(keys[a:b], lists[i].values.to_numpy().view(np.uint64))
            starts, sizes = starts[keep], (ends - starts)[keep]
            at = np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
            one, two = rolling(h, window, 2 * salt), rolling(h, window, 2 * salt + 1)
            ids, own = (rows.column(c).take(pa.array(doc[at])) for c in ("doc_id", "row"))
            yield pa.RecordBatch.from_arrays(
                [pa.array(one[at].view(np.int64)), pa.array((two[at] >> np.uint64(33)).astype(np.int32)), ids, own, pa.array((at - first[doc[at]]).astype(np.int32)), pa.array(_digests(texts, at, at + window))],
                ["h", "c", "doc_id", "row", "pos", "digest"],
            )

    return run


def repeated_spans(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR, attempts: int = 4) -> DataFrame:
    """doc_id, row (hash of the text), pos, words, source_doc, whole: spans of ``window`` or more words that a document shares with a smaller one (whole runs, unbranched paths)."""
    for salt in range(attempts):
        found, chance = _spans(docs, window, anchor, salt)
        if not chance:
            return found
        discard(found)
    raise RuntimeError("different words with one hash, in every attempt")


def _spans(docs: DataFrame, window: int, anchor: int, salt: int) -> tuple[DataFrame, bool]:
    """The spans, and whether different words were met under one hash."""
    # A row is known by its doc_id and the hash of its text, as a doc_id may come with several texts.
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("row"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = settled(light.mapInArrow(_runs(window, anchor, salt), "anchor long, run long, c int, doc_id long, row long, pos int, words int, digest long"), "runs")
    distinct = settled(runs.groupBy("run", "c", "anchor").agg(F.min("doc_id").alias("doc"), F.max("doc_id").alias("last"), F.min("digest").alias("low"), F.max("digest").alias("high")), "distinct")
    chance = not distinct.where("low <> high").isEmpty()
    copied = distinct.where("doc < last").select(F.col("run").alias("_run"), F.col("c").alias("_c"), "doc")
    # Joins are by merge at every size, so that what a small input shows holds for a large one.
    whole = runs.join(copied.hint("merge"), (F.col("run") == F.col("_run")) & (F.col("c") == F.col("_c"))).where("doc_id > doc")
    whole = settled(whole.select("doc_id", "row", "pos", "words", F.col("doc").alias("source_doc"), F.lit(True).alias("whole")), "copies")
    contested = settled(distinct.groupBy(F.col("anchor").alias("_anchor")).agg(F.count("*").alias("n"), F.min("doc").alias("a"), F.max("doc").alias("b")).where("n > 1 AND a < b").select("_anchor"), "contested")
    # One row per document: the runs that it represents, never more than it has words.
    lists = distinct.join(contested.hint("merge"), F.col("anchor") == F.col("_anchor")).groupBy(F.col("doc").alias("_id")).agg(F.collect_list("run").alias("runs"))
    found = light.join(lists.hint("merge"), F.col("doc_id") == F.col("_id")).select("doc_id", "row", "text", "runs")
    windows = settled(found.mapInArrow(_windows(window, anchor, salt), "h long, c int, doc_id long, row long, pos int, digest long"), "windows")
    discard(runs, distinct, contested)
    at = lambda back: F.xxhash64("doc_id", "row", F.col("pos") - back)
    low = F.lit(0x7FFFFFFF)
    edges = windows.groupBy("h", "c").agg(
        F.min(F.struct("doc_id", "row", "pos")).alias("source"), F.max("doc_id").alias("last"), F.count("*").alias("n"),
        F.bit_xor(at(0)).alias("here"), F.bit_xor(at(1)).alias("before"), F.sum(at(0).bitwiseAND(low)).alias("here_sum"), F.sum(at(1).bitwiseAND(low)).alias("before_sum"), F.min("digest").alias("least"), F.max("digest").alias("most"),
    )
    edges = settled(edges.where("source.doc_id < last").select("h", "c", F.col("source.doc_id").alias("doc"), "source.row", "source.pos", "n", "here", "before", "here_sum", "before_sum", "least", "most"), "edges")
    chance = chance or not edges.where("least <> most").isEmpty()
    prior = edges.select(F.col("doc").alias("_doc"), F.col("row").alias("_row"), (F.col("pos") + 1).alias("_next"), F.col("n").alias("_n"), F.col("here").alias("_here"), F.col("here_sum").alias("_sum"))
    same = (F.col("doc") == F.col("_doc")) & (F.col("row") == F.col("_row")) & (F.col("pos") == F.col("_next")) & (F.col("n") == F.col("_n")) & (F.col("before") == F.col("_here")) & (F.col("before_sum") == F.col("_sum"))
    linked = edges.join(prior.hint("merge"), same, "left").select("h", "c", "doc", "row", "pos", F.col("_next").isNull().cast("int").alias("head"))
    # A document's edges in its own order: no larger than the document.
    numbered = linked.withColumn("path", F.sum("head").over(W.partitionBy("doc", "row").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)))
    paths = numbered.groupBy("doc", "row", "path").agg(F.min(F.struct("pos", "h", "c")).alias("first"), F.count("*").alias("edges"))
    heads = settled(paths.select(F.col("first.h").alias("_h"), F.col("first.c").alias("_c"), "doc", "edges"), "paths")
    spans = windows.join(heads.hint("merge"), (F.col("h") == F.col("_h")) & (F.col("c") == F.col("_c"))).where("doc_id > doc")
    out = whole.unionByName(spans.select("doc_id", "row", "pos", (F.col("edges") + (window - 1)).cast("int").alias("words"), F.col("doc").alias("source_doc"), F.lit(False).alias("whole")))
    out = settled(out, "spans")
    discard(whole, windows, edges, heads)
    return out, chance


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in text_chunks(batches):
        n_words, n_removed, kept = [], [], []
        for data, cuts in zip(texts, rows.column("_cuts").to_pylist(), strict=True):
            ws = data.split()
            if cuts:
                edge = np.zeros(len(ws) + 1, np.int64)
                np.add.at(edge, [c["pos"] for c in cuts], 1)
                np.add.at(edge, [c["pos"] + c["words"] for c in cuts], -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = [ws[i] for i in np.flatnonzero(~gone).tolist()]
            else:
                left = ws
            n_words.append(len(ws))
            n_removed.append(len(ws) - len(left))
            kept.append(b" ".join(left))
        names = [n for n in rows.schema.names if n != "_cuts"]
        yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], [*names, "n_words", "n_removed", "kept"])


def _kept(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """``rows``: doc_id, text and whatever else.  Adds n_words, n_removed and kept."""
    cuts = repeated_spans(rows, window, anchor).groupBy(F.col("doc_id").alias("cut_id"), F.col("row").alias("cut_row")).agg(F.collect_list(F.struct("pos", "words")).alias("_cuts"))
    met = rows.join(cuts.hint("merge"), (F.col("doc_id").cast("long") == F.col("cut_id")) & (F.xxhash64("text") == F.col("cut_row")), "left").drop("cut_id", "cut_row")
    return met.mapInArrow(_cut, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema), "n_words long, n_removed long, kept string"]))


def remove_repeats(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with n_words, n_removed and kept (the words that stay, joined by one space), which replace columns of these names."""
    own = [c for c in docs.columns if c not in OUTPUTS]
    return _kept(packed(docs.select(*[F.col(f"`{c}`") for c in own]), "doc_id", "text"), window, anchor).select(*unpacked(own, "doc_id", "text"), *OUTPUTS)


def cut_documents(docs: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """The documents with their own columns; one that loses words keeps the others joined by one space (and n_chars is theirs), one that loses all goes."""
    changed = F.col("n_removed") > 0
    cut = _kept(packed(docs, "doc_id", "text"), window, anchor).where(~changed | (F.col("kept") != ""))
    new = {"text": F.when(changed, F.col("kept")).otherwise(F.col("text")), "n_chars": F.when(changed, F.length("kept").cast("long")).otherwise(F.col("_row.n_chars") if "n_chars" in docs.columns else None)}
    return cut.select(*[new[c].alias(c) if c in new else x for c, x in zip(docs.columns, unpacked(docs.columns, "doc_id", "text"), strict=True)])
