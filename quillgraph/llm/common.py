"""Helpers that the text operators share: words, shared folders, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark import SparkContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes outside 0x20 and 0x09-0x0D, which is how ``bytes.split()`` cuts; this is the same rule for Java and RE2.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: Bytes of text that a Python worker expands at a time; bounds its memory whatever the Arrow batch holds.
CHUNK_BYTES = 4 << 20


def words(data: bytes | None) -> list[bytes]:
    return data.split() if data else []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def crc_mod(col: Column, mod: int) -> Column:
    """crc32 of the value written as text, modulo ``mod``; null counts as 0."""
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % mod, F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.  A temporary one is made only in local mode, where driver and executors are one process."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="quillgraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Folders of settled tables that are still there; what is left when the program ends is deleted then.
_scratch: list[str] = []
#: Lists that the folders of new settled tables are also entered in.
_open: list[list[str]] = []


def settled(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, survives the loss of executors."""
    spark = df.sparkSession
    df.write.parquet(path := fresh_path(spark, name))
    out = spark.read.schema(df.schema).parquet(path)
    out.settled_at = path
    for known in (_scratch, *_open):
        known.append(path)
    return out


@contextmanager
def gathered() -> Iterator[list[str]]:
    """The folders of the tables that are settled within, to be deleted when the result that reads them has been written."""
    paths: list[str] = []
    _open.append(paths)
    try:
        yield paths
    finally:
        _open[:] = [x for x in _open if x is not paths]


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of settled tables that nothing will read again."""
    for path in [x for x in paths if x in _scratch]:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        _scratch.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that nothing will read again, and let go of the shuffle files of finished plans."""
    for df in tables:
        delete(df.sparkSession, [df.settled_at])
    if tables:
        release(tables[0].sparkSession)


@atexit.register
def _leave() -> None:
    spark = SparkSession.getActiveSession() if SparkContext._active_spark_context is not None else None
    if spark is not None:
        delete(spark, list(_scratch))


def packed(docs: DataFrame, *names: str) -> DataFrame:
    """The named columns, and all others in one struct ``_row``, so that no column of a user meets one of an operator's own."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    return docs.select(F.struct(*rest).alias("_row") if rest else F.lit(None).cast("struct<none: int>").alias("_row"), *[F.col(f"`{c}`") for c in names if c in docs.columns])


def unpacked(columns: list[str], *names: str) -> list[Column]:
    """Of a table made by ``packed`` with the same names: the columns given, in their order."""
    return [F.col(f"`{c}`" if c in names else f"_row.`{c}`").alias(c) for c in columns]


def bounded(df: DataFrame, most: int, *keys: str) -> DataFrame:
    """At most ``most`` rows, those with the smallest hashes of the keys.

    A threshold on the hash, from the counted rows, leaves hardly more than that in all tasks together before any are gathered; it falls
    short of ``most`` with a chance below 1e-9, and then the sample is that much smaller.
    """
    rows = df.count()
    hashed = df.withColumn("_hash", F.xxhash64(*keys))
    if rows > most:
        hashed = hashed.where(F.pmod("_hash", F.lit(1 << 40)) < int((most + 7 * most**0.5 + 50) / rows * (1 << 40)))
    return hashed.orderBy(F.pmod("_hash", F.lit(1 << 40)), *keys).limit(most).drop("_hash")


#: Above this number of rows a key may be hot, unless all rows are so many that this is one in MOST_HOT of them.
HOT = 128
MOST_HOT = 50_000


def spread_join(rows: DataFrame, n_rows: int, key: str, lookup: DataFrame) -> DataFrame:
    """Left join of rows with the one row of ``lookup`` that has their key, hot keys dealt to several tasks.

    Rows of a key are counted (before the shuffle first).  There are at most MOST_HOT keys above the limit, so these are broadcast; their rows
    get a salt, and their lookup row is there once per salt.
    """
    most = max(HOT, n_rows // MOST_HOT)
    hot = rows.groupBy(F.col(key).alias("_hot")).agg(F.count("*").alias("_n")).where(F.col("_n") > most).select("_hot", F.ceil(F.col("_n") / most).cast("int").alias("_salts"))
    salt = F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("_salts")).cast("int"), F.lit(0))
    left = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", salt).drop("_hot", "_salts")
    right = lookup.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts") - 1, F.lit(0))))).drop("_hot", "_salts")
    return left.join(right.hint("merge"), [key, "_salt"], "left").drop("_salt")


def small(df: DataFrame, rows: int, limit: int = 100_000) -> DataFrame:
    """Mark a side for broadcast only if its counted rows are within the limit; beyond it Spark joins by shuffle."""
    return F.broadcast(df) if rows <= limit else df


def chunks(sizes: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges whose sizes add up to about ``most``; a row of any size is whole in one range."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += int(n)
    if start < len(sizes):
        yield start, len(sizes)


def text_chunks(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of Arrow batches with the whole texts as UTF-8 bytes; null reads as empty."""
    for batch in batches:
        col = batch.column(text).cast(pa.large_binary())
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(col).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
        for a, b in chunks(sizes):
            yield batch.slice(a, b - a), [x or b"" for x in col.slice(a, b - a).to_pylist()]


def longest_first(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of sequences by falling length, and how many of them are still running at each step."""
    order = np.argsort(-lengths, kind="stable")
    most = int(lengths.max(initial=0))
    running = len(lengths) - np.searchsorted(np.sort(lengths), np.arange(most), side="right")
    return order, running


class Interned(dict):
    """Word to row number, for words seen so far; ``fresh`` holds those not yet given a value by the caller."""

    def __init__(self) -> None:
        super().__init__()
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        self.fresh.append(word)
        return n


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the smallest node reachable.

    Alternating large-star and small-star steps: each halves the depth of the trees and keeps at most one row per edge, so no group is
    gathered anywhere (minima are combined before the shuffle, and the centre of a star meets its minimum in several tasks).  The table is
    settled in the shared folder each round; the rounds end when every edge leads to a root.  Nulls and loops drop out.
    """
    downward = lambda df: df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()

    def large(now: DataFrame, n: int) -> DataFrame:
        """Every node goes to the smallest neighbour of its smaller neighbour, or to that one."""
        least = settled(now.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("m")), "least")
        return spread_join(now, n, "b", least).select("a", F.coalesce("m", "b").alias("b"))

    def small_(now: DataFrame, n: int) -> DataFrame:
        """The smaller neighbours of a node go to the smallest of them, and so does the node."""
        least = settled(now.groupBy("a").agg(F.min("b").alias("m")), "least")
        return spread_join(now, n, "a", least).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))

    every = now = settled(downward(edges.select("a", "b")), "links")
    for _ in range(most_rounds):
        with gathered() as used:
            half = settled(downward(large(now, now.count())), "links")
            last, now = now, settled(downward(small_(half, half.count())), "links")
            delete(now.sparkSession, [x for x in used if x != now.settled_at])
        if last is not every:
            delete(now.sparkSession, [last.settled_at])
        ends = now.select(F.col("b").alias("x"), F.lit(1).alias("as_root"), F.lit(0).alias("as_leaf")).unionByName(now.select("a", F.lit(0), F.lit(1)).toDF("x", "as_root", "as_leaf"))
        if ends.groupBy("x").agg(F.sum("as_root").alias("r"), F.sum("as_leaf").alias("l")).where("l > 1 OR (r > 0 AND l > 0)").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    nodes = every.select(F.col("a").alias("node")).unionByName(every.select(F.col("b").alias("node"))).distinct()
    out = settled(nodes.join(now.select(F.col("a").alias("node"), F.col("b").alias("component")).hint("merge"), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "components")
    discard(every, now)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of plans that are no longer referred to; it does so when the driver's JVM collects garbage."""
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


SEGMENT = 1 << 21
_ODD = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, odd: int = _ODD) -> tuple[np.ndarray, np.ndarray]:
    """odd ** i and its inverse, modulo 2 ** 64, for i < n."""
    got = _powers.get(odd)
    if got is None or len(got[0]) < n:
        size = max(n, 1 << 16)
        got = _powers[odd] = tuple(np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(size, x, np.uint64))]) for x in (odd, pow(odd, -1, 1 << 64)))
    return got


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x + np.uint64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def hashed_words(texts: list[bytes], endings: bool = False, salt: int = 0) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words of the texts, and the number of words of each text; with ``endings`` also each word's last two bytes.

    A word's hash is a polynomial of its bytes, taken from prefix sums over the joined texts; segments cut at white space bound the tables.
    """
    buf = b"\n".join(texts) + b"\n"
    b = np.frombuffer(buf, np.uint8)
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[::2], edge[1::2]
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])]) if texts else np.zeros(0, np.int64)
    counts = np.diff(np.searchsorted(starts, [*offsets, len(b)])) if texts else np.zeros(0, np.int64)
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        base = starts[at]
        to = max(int(np.searchsorted(ends, base + SEGMENT, side="right")), at + 1)
        up, down = powers(int(ends[to - 1] - base), _ODD + 0x5851F42D4C957F2C * salt & (1 << 64) - 1)
        piece = b[base : ends[to - 1]].astype(np.uint64)
        piece += np.uint64(1)
        piece *= up[: len(piece)]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(piece)])
        out[at:to] = mixed((sums[ends[at:to] - base] - sums[starts[at:to] - base]) * down[starts[at:to] - base])
        at = to
    if endings:
        return out, counts.astype(np.int64), b[ends - 1].astype(np.int64) * 256 + np.where(ends - starts > 1, b[np.maximum(ends - 2, 0)], 0)
    return out, counts.astype(np.int64)


class HashIndex:
    """Row numbers of a bounded set of 64-bit keys, looked up by arrays: open addressing on the top 20 bits."""

    def __init__(self, keys: np.ndarray) -> None:
        size = 1 << 20
        if len(keys) > size // 2:
            raise ValueError("too many keys")
        self.keys, self.rows = np.zeros(size + 4096, np.uint64), np.full(size + 4096, -1, np.int32)
        left = np.arange(len(keys))
        slot = (keys >> np.uint64(44)).astype(np.int64)
        while len(left):
            free = self.rows[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            chosen = np.flatnonzero(free)[first]
            self.keys[slot[chosen]], self.rows[slot[chosen]] = keys[left[chosen]], left[chosen]
            rest = np.ones(len(left), bool)
            rest[chosen] = False
            left, slot = left[rest], slot[rest] + 1

    def find(self, h: np.ndarray) -> np.ndarray:
        """Row numbers, -1 for keys that are not there."""
        out = np.full(len(h), -1, np.int32)
        at, slot = np.arange(len(h)), (h >> np.uint64(44)).astype(np.int64)
        while len(at):
            row = self.rows[slot]
            hit = (row >= 0) & (self.keys[slot] == h[at])
            out[at[hit]] = row[hit]
            on = ~hit & (row >= 0)
            at, slot = at[on], slot[on] + 1
        return out


def rolling(h: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of ``size`` consecutive numbers."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, block = np.empty(n, np.uint64), 1 << 18
    up, down = powers(block + size, 0xD6E8FEB86659FD93)
    for a in range(0, n, block):
        part = h[a : a + block + size - 1]
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(part, salt) * up[: len(part)])])
        out[a : a + block] = mixed((sums[size:] - sums[:-size]) * down[: len(sums) - size], salt)
    return out


def span_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """Hashes of runs of numbers, h[start:end], given by rising starts."""
    out, block = np.empty(len(starts), np.uint64), 1 << 18
    longest = int((ends - starts).max(initial=0))
    up, down = powers(block + longest + 1, 0xA0761D6478BD642F)
    for a in range(0, len(h), block):
        i, j = np.searchsorted(starts, [a, a + block])
        if i < j:
            part = h[a : a + block + longest]
            sums = np.concatenate([[np.uint64(0)], np.cumsum(mixed(part, salt) * up[: len(part)])])
            out[i:j] = mixed((sums[ends[i:j] - a] - sums[starts[i:j] - a]) * down[starts[i:j] - a] + (ends[i:j] - starts[i:j]).astype(np.uint64), salt)
    return out


def sliding(x: np.ndarray, size: int, pick: np.ufunc, rest: int) -> np.ndarray:
    """Minimum or maximum of all runs of ``size`` numbers; the last runs are filled up with ``rest``."""
    n = len(x)
    pad = np.full((-(-(n + size) // size)) * size, rest, x.dtype)
    pad[:n] = x
    rows = pad.reshape(-1, size)
    ahead = pick.accumulate(rows, axis=1).reshape(-1)
    behind = pick.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return pick(behind[:n], ahead[size - 1 : size - 1 + n])
