"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most ``2 r`` bits exactly if some number lies within r bits of both.  So if every fingerprint emits all numbers
within half the radius, the fingerprints that meet at a number are the linked ones, and a number meets at most 2 081 distinct fingerprints.

All 2 081 variants of all fingerprints would be some 25 GB of shuffle per GB of text, so the same method first runs on the halves: of two
fingerprints within 4 bits, one 32-bit half of both is within 2 bits, so their half-balls of radius 1 (33 variants, 66 a fingerprint) meet.
- A half-variant met by two fingerprints is a pair, which is verified on all 64 bits.
- One met by up to ``crowd`` fingerprints is verified within its list, of which only a spanning forest of the links goes on.
- Fingerprints at a half-variant met by more emit all their full variants; they are linked to the smallest fingerprint at each.
Nothing is left out at any size: a pair meets at a half-variant, and each half-variant is of one of these three kinds.

Equal fingerprints are one node from the start (minima are combined before the shuffle), so exact copies cost nothing however many.

Defined results: null and empty texts have no shingle and fingerprint zero, linked like any other; texts of fewer than ``shingle`` words have
one shingle; rows without doc_id take the component of their fingerprint, and are never its name; repeated rows are copies; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import connected_components, discard, packed, settled, small, spread_join, text_chunks, unpacked

SHINGLE = 4
RADIUS = 4
CROWD = 64
SEED = 42
#: Fingerprints that one task spreads out on halves.
SPREAD_ROWS = 8_000
_BITS = ((np.arange(256)[:, None] >> np.arange(8)[None, :]) & 1).astype(np.int64)


def fingerprint(data: bytes, shingle: int = SHINGLE) -> int:
    """Unsigned 64-bit SimHash of a text in UTF-8: a bit is set if it is in over half of the shingles' hashes."""
    joined = b" ".join(data.lower().split())
    if not joined:
        return 0
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
    if len(gaps) + 1 <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    digest = xxhash.xxh64_intdigest
    starts, ends = [0, *(g + 1 for g in gaps[: len(gaps) + 1 - shingle])], [*gaps[shingle - 1 :], len(joined)]
    n, ones, step = len(starts), np.zeros((8, 8), np.int64), 1 << 18
    for a in range(0, n, step):
        hashes = np.array([digest(joined[i:j], SEED) for i, j in zip(starts[a : a + step], ends[a : a + step], strict=True)], np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8).astype(np.int64) + np.arange(0, 2048, 256)
        ones += np.bincount(octets.ravel(), minlength=2048).reshape(8, 256) @ _BITS
    return int(np.packbits(ones.ravel() * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the fingerprint as a signed long, and ``row`` if the documents have it."""
    own = [c for c in ("doc_id", "row") if c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_chunks(batches):
            found = np.array([fingerprint(x, shingle) for x in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in own), pa.array(found)], [*own, "fp"])

    return docs.select(*[F.col(c).cast("long").alias(c) for c in own], "text").mapInArrow(run, ", ".join(f"{c} long" for c in own) + ", fp long")


def ball(bits: int, radius: int) -> list[int]:
    """Masks of at most ``radius`` of the lowest ``bits`` bits, as signed longs."""
    now, every = {0}, {0}
    for _ in range(radius):
        now = {m | 1 << i for m in now for i in range(bits)} - every
        every |= now
    return sorted(m - (1 << 64) if m >> 63 else m for m in every)


def _masks(values: list[int]):
    return F.expr("array(" + ",".join("(-9223372036854775807L - 1L)" if v == -(1 << 63) else f"{v}L" for v in values) + ")")


def _forest(radius: int):
    """Verified links within each list, as a spanning forest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a_out, b_out = [], []
            for fps, ids in zip(batch.column("fps").to_pylist(), batch.column("ids").to_pylist(), strict=True):
                x = np.array(fps, np.int64).view(np.uint64)
                near = np.bitwise_count(x[:, None] ^ x[None, :]) <= radius
                left = set(range(len(ids)))
                while left:
                    stack = [left.pop()]
                    while stack:
                        i = stack.pop()
                        for j in [j for j in np.flatnonzero(near[i]).tolist() if j in left]:
                            left.discard(j)
                            stack.append(j)
                            a_out.append(ids[i])
                            b_out.append(ids[j])
            yield pa.RecordBatch.from_arrays([pa.array(a_out, pa.int64()), pa.array(b_out, pa.int64())], ["a", "b"])

    return run


def links(nodes: DataFrame, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """(a, b): links that join all of ``nodes`` (distinct fp, id) whose fingerprints are within ``radius`` bits, as ids."""
    half = radius // 2
    # Few small rows come from few files, and each is spread out 66-fold: deal them first, to so many tasks that none makes more than some rows.
    dealt = nodes.repartition(max(1, -(-nodes.count() // SPREAD_ROWS)), "fp")
    parts = F.array(F.expr("fp & 4294967295L"), F.expr("shiftrightunsigned(fp, 32)"))
    keyed = dealt.select("fp", "id", F.posexplode(parts).alias("side", "part"))
    keyed = keyed.select("fp", "id", "side", "part", F.explode(_masks(ball(32, half // 2 if half > 1 else half))).alias("mask")).select(F.expr("shiftleft(cast(side as long), 32) | (part ^ mask)").alias("key"), "fp", "id")
    # Of two rows, the smallest and the largest are both.  Most keys are met once, so a hash table of them would only fill memory before the
    # shuffle; minima of structs are aggregated by sorting, which spills.
    met = settled(keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("fp", "id")).alias("p"), F.max(F.struct("fp", "id")).alias("q")).where("n > 1"), "met")
    near = F.bit_count(F.col("p.fp").bitwiseXOR(F.col("q.fp"))) <= radius
    pairs = met.where("n = 2").where(near).select(F.col("p.id").alias("a"), F.col("q.id").alias("b"))
    # Few keys are met by more than two; they are broadcast if counted to be few, else joined by shuffle.
    many = met.where("n > 2").select("key", "n")
    crowded = settled(keyed.join(small(many, many.count()), "key"), "crowded")
    lists = crowded.where(F.col("n") <= crowd).groupBy("key").agg(F.collect_list(F.struct("fp", "id")).alias("x")).select(F.col("x.fp").alias("fps"), F.col("x.id").alias("ids"))
    listed = lists.mapInArrow(_forest(radius), "a long, b long")
    # Deal again before the ball is spread out, so that the work of a crowd is shared by many tasks.
    hot = settled(crowded.where(F.col("n") > crowd).select("fp", "id").distinct(), "hot")
    spread = hot.repartition(max(1, -(-hot.count() * 32 // SPREAD_ROWS)), "fp").select("fp", "id", F.explode(_masks(ball(64, half))).alias("mask")).select(F.expr("fp ^ mask").alias("variant"), "fp", "id")
    least = spread.groupBy("variant").agg(F.min(F.struct("id", "fp")).alias("least"), F.count("*").alias("n")).where("n > 1")
    starred = spread.join(least.hint("merge"), "variant").where((F.col("id") != F.col("least.id")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= radius))
    out = settled(pairs.unionByName(listed).unionByName(starred.select(F.col("id").alias("a"), F.col("least.id").alias("b"))).distinct(), "near")
    discard(met, crowded, hot)
    return out


def _grouped(docs: DataFrame, shingle: int, radius: int, crowd: int) -> DataFrame:
    """The columns of ``fingerprints`` and component_id."""
    light = settled(fingerprints(docs, shingle), "fingerprints")
    nodes = settled(light.groupBy("fp").agg(F.min("doc_id").alias("id")), "nodes")
    near = links(nodes.where("id IS NOT NULL"), radius, crowd)
    found = connected_components(near)
    named = settled(nodes.join(found.hint("merge"), nodes["id"] == found["node"], "left").select("fp", F.coalesce("component", "id").alias("component_id")), "named")
    discard(near, found, nodes)
    return spread_join(light, light.count(), "fp", named)


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id (the smallest doc_id reachable) of every document."""
    return _grouped(docs.select("doc_id", "text"), shingle, radius, crowd).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, crowd: int = CROWD) -> DataFrame:
    """The documents with one of each group: the row with the smallest doc_id, and of several with that one the smallest hash.  Rows without doc_id all stay."""
    rows = packed(docs, "doc_id", "text").withColumn("row", F.xxhash64("doc_id", "text", F.to_json("_row")))
    found = _grouped(rows.where("doc_id IS NOT NULL").select("doc_id", "row", "text"), shingle, radius, crowd)
    kept = settled(found.groupBy("component_id").agg(F.min(F.struct("doc_id", "row")).alias("k")).select(F.col("k.doc_id").alias("kept_id"), F.col("k.row").alias("kept_row")), "kept")
    met = rows.join(kept.hint("merge"), (F.col("doc_id").cast("long") == F.col("kept_id")) & (F.col("row") == F.col("kept_row"))).dropDuplicates(["kept_id", "kept_row"])
    own = unpacked(docs.columns, "doc_id", "text")
    return met.select(*own).unionByName(rows.where("doc_id IS NULL").select(*own))
