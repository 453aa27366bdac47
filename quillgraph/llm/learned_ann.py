"""Approximate nearest neighbours with learned partitions.

Equal vectors are one from the start, with the ``k`` + 1 first of their rows, which are all that can be among the nearest.

Fitting.  All vectors of one length are a node, which is split if it has more than two parts' rows: a task takes at most ``sample_rows`` of them
(those with the smallest hashes), cuts the exact neighbour graph of the sample into balanced parts with few edges between them (one per
``part_rows`` vectors, up to ``FANOUT``), and a small network learns from a vector the parts of its neighbours.  How many of the most probable
parts a query must visit for its share of ``recall`` (its root over the levels) is measured on sample vectors that the network has not seen.

Indexing.  Every vector, sampled or not, goes to its most probable part.  Parts of more than ``leaf_rows`` vectors are split again in the same
way, so parts stay bounded at any number of rows.  Rows meet their network in blocks of a bounded number.

Searching.  A query follows its most probable parts down to the last ones.  These are searched in blocks of at most about ``block_rows`` vectors
and as many queries; a block gives its best by cosine in double precision on the original vectors, and the best of all blocks are ranked.
Ties go to the smaller id: scores that decide are computed row by row, so equal vectors have equal scores.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part, as query or candidate; so do rows without
id.  Vectors of different lengths have no cosine: each is searched among those of its own.  Rows that repeat a vec_id are rows of their own: each
is a candidate for all but itself, and each that is a query has its own answer.  Where no node is large the search is exact; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillgraph.llm.common import discard, settled, small, spread_join

SAMPLE_ROWS = 6_000
PART_ROWS = 128
FANOUT = 64
LEAF_ROWS = 4_096
MOST_LEVELS = 8
BLOCK_ROWS = 4_096
NEIGHBOURS = 10
RECALL = 0.95


@dataclass
class Router:
    """A network of one hidden layer over unit vectors."""

    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    @property
    def parts(self) -> int:
        return len(self.b2)

    def logits(self, unit: np.ndarray) -> np.ndarray:
        return np.maximum(unit @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def ranked(self, unit: np.ndarray) -> np.ndarray:
        """Parts of each vector, most probable first."""
        return np.argsort(-self.logits(unit), axis=1, kind="stable")


def neighbours(unit: np.ndarray, among: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k nearest of ``among`` by cosine, without the first that is the vector itself."""
    out = []
    for a in range(0, len(unit), 512):
        s = unit[a : a + 512] @ among.T
        out.append(np.argpartition(-s, min(k, s.shape[1] - 1), axis=1)[:, : k + 1] if s.shape[1] > k + 1 else np.tile(np.arange(s.shape[1]), (len(s), 1)))
    return np.concatenate(out) if out else np.zeros((0, k), int)


def balanced_parts(unit: np.ndarray, graph: np.ndarray, parts: int, rounds: int = 12, slack: float = 1.1, seed: int = 3) -> np.ndarray:
    """A part for every node so that no part is above ``slack`` times the mean and many edges stay inside.

    Starts from halvings along directions of largest spread; then nodes move, those with most to win first, to the part that most of their
    neighbours are in, while it has room.
    """
    rng = np.random.default_rng(seed)
    label = np.zeros(len(unit), np.int64)
    todo = [(np.arange(len(unit)), 0, parts)]
    while todo:
        rows, first, n = todo.pop()
        label[rows] = first
        if n == 1 or len(rows) < 2:
            continue
        x = unit[rows] - unit[rows].mean(0)
        v = rng.normal(size=x.shape[1])
        for _ in range(12):
            v = x.T @ (x @ v)
            v /= np.linalg.norm(v) + 1e-12
        order, left = np.argsort(x @ v, kind="stable"), n // 2
        cut = len(rows) * left // n
        todo += [(rows[order[:cut]], first, left), (rows[order[cut:]], first + left, n - left)]
    most = int(np.ceil(len(unit) / parts * slack))
    src = np.repeat(np.arange(len(unit)), graph.shape[1])
    for _ in range(rounds):
        votes = np.zeros((len(unit), parts), np.int32)
        np.add.at(votes, (src, label[graph].ravel()), 1)
        np.add.at(votes, (graph.ravel(), label[src]), 1)
        here = votes[np.arange(len(unit)), label]
        best = votes.argmax(1)
        gain = votes[np.arange(len(unit)), best] - here
        sizes, moved = np.bincount(label, minlength=parts), 0
        for i in np.argsort(-gain, kind="stable"):
            if gain[i] <= 0:
                break
            if sizes[best[i]] < most:
                sizes[label[i]] -= 1
                sizes[best[i]] += 1
                label[i] = best[i]
                moved += 1
        if not moved:
            break
    return label


def fit(vectors: np.ndarray, parts: int, recall: float = RECALL, k: int = NEIGHBOURS, hidden: int = 128, epochs: int = 40, seed: int = 5) -> Router:
    """Learn the parts of a sample; the last fifth of it measures how many parts a query must visit."""
    dim = vectors.shape[1] if vectors.ndim == 2 and vectors.size else 1
    if parts <= 1 or len(vectors) < 50:
        return Router(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    rng = np.random.default_rng(seed)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    graph = neighbours(unit, unit, k)
    label = balanced_parts(unit, graph, parts)
    target = np.zeros((len(unit), parts))
    np.add.at(target, (np.repeat(np.arange(len(unit)), graph.shape[1]), label[graph].ravel()), 1.0)
    target[np.arange(len(unit)), label] += 1.0
    target /= target.sum(1, keepdims=True)
    hidden = min(hidden, max(16, len(unit) // 8))
    p = [rng.normal(0, (2 / dim) ** 0.5, (dim, hidden)), np.zeros(hidden), rng.normal(0, (1 / hidden) ** 0.5, (hidden, parts)), np.zeros(parts)]
    m, s, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    learn = len(unit) * 4 // 5
    for _ in range(epochs):
        order = rng.permutation(learn)
        for a in range(0, learn, 128):
            rows = order[a : a + 128]
            x, y = unit[rows], target[rows]
            h = np.maximum(x @ p[0] + p[1], 0)
            z = h @ p[2] + p[3]
            e = np.exp(z - z.max(1, keepdims=True))
            d = (e / e.sum(1, keepdims=True) - y) / len(rows)
            dh = (d @ p[2].T) * (h > 0)
            t += 1
            for j, g in enumerate((x.T @ dh + 1e-4 * p[0], dh.sum(0), h.T @ d + 1e-4 * p[2], d.sum(0))):
                m[j] = 0.9 * m[j] + 0.1 * g
                s[j] = 0.999 * s[j] + 0.001 * g * g
                p[j] = p[j] - 0.003 * (m[j] / (1 - 0.9**t)) / (np.sqrt(s[j] / (1 - 0.999**t)) + 1e-8)
    router = Router(*p, probes=parts)
    # Rows go to their most probable part, so that is where neighbours are found.
    home = router.ranked(unit)[:, 0]
    place = np.argsort(router.ranked(unit[learn:]), axis=1)
    visits = np.sort(np.take_along_axis(place, home[graph[learn:]], axis=1).ravel())
    router.probes = int(min(parts, visits[min(len(visits) - 1, int(np.ceil(recall * len(visits))))] + 1))
    return router


def _usable(vector: Column) -> Column:
    v = vector.cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & (F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def _matrix(lists: pa.ChunkedArray) -> np.ndarray:
    """Rows of lists of one length."""
    flat = lists.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1) if len(flat) else np.zeros((0, 1))


def _unit(x: np.ndarray) -> np.ndarray:
    """Scaled first: the square of a component may not be finite, or zero, where the component is neither."""
    if not len(x):
        return x
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fitted(recall: float, part_rows: int):
    """A node's router out of its sample."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("key")
        n = int(rows.n.iloc[0])
        router = fit(_unit(np.stack(rows.v.to_numpy()).astype(float)), min(FANOUT, -(-n // part_rows)), recall)
        return pd.DataFrame({"node": [rows.node.iloc[0]], "router": [pickle.dumps(router)]})

    return run


def _routed(left: pa.Table, right: pa.Table) -> pa.Table:
    """The rows of a block with their part, or as queries once for every part that they visit.  A node that has but one part is final."""
    if not left.num_rows:
        return left.select(["key", "v", "node", "query"])
    router: Router = pickle.loads(right.column("router")[0].as_py())
    order = router.ranked(_unit(_matrix(left.column("v"))))
    query = left.column("query").to_numpy(zero_copy_only=False)
    times = np.where(query, router.probes, 1)
    at = np.repeat(np.arange(left.num_rows), times)
    place = np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)
    node = left.column("node")[0].as_py()
    names = pa.array([f"{node}!" if router.parts == 1 else f"{node}/{x}" for x in order[at, place].tolist()], pa.string())
    rows = left.take(pa.array(at))
    return pa.table({"key": rows.column("key"), "v": rows.column("v"), "node": names, "query": rows.column("query")})


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Cosine of one vector with each row, the same sum order for every row."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(1, keepdims=True)
    return np.einsum("ij,j->i", x, q) / (np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(np.einsum("i,i->", q, q)))


def _block(k: int):
    """The ``k`` + 1 best rows of a block for every query, one of which may be the query's own."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        qs, xs, out = _matrix(left.column("v")), _matrix(right.column("v")), []
        q_keys, held = left.column("key").to_pylist(), right.column("held").to_pylist()
        if len(qs) and len(xs):
            unit, asked = _unit(xs), _unit(qs)
            for a in range(0, len(qs), 256):
                rough = asked[a : a + 256] @ unit.T
                for i, row in enumerate(rough, a):
                    least = np.partition(row, -k - 1)[-k - 1] if len(row) > k + 1 else -np.inf
                    hit = np.flatnonzero(row >= least - 1e-9)
                    exact = cosines(qs[i], xs[hit])
                    found = [(-float(s), h["vec_id"], h["uid"]) for s, j in zip(exact, hit.tolist(), strict=True) for h in held[j]]
                    out += [(q_keys[i], v, u, -s) for s, v, u in sorted(found)[: k + 1]]
        columns = list(zip(*out, strict=True)) if out else [[]] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("key", "vec_id", "uid", "score"), columns, (pa.string(), pa.int64(), pa.int64(), pa.float64()), strict=True)})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, part_rows: int = PART_ROWS, leaf_rows: int = LEAF_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that passes ``is_query`` (a condition on vec_id)."""
    usable = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v")).where(F.col("vec_id").isNotNull() & _usable(F.col("v")))
    usable = usable.select("vec_id", F.col("v").cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("query"))
    key = F.concat_ws("-", F.hex(F.xxhash64(F.lit(1), "v")), F.hex(F.xxhash64(F.lit(2), "v")))
    rows = settled(usable.withColumns({"uid": F.monotonically_increasing_id(), "key": key}), "vectors")
    first = rows.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy("vec_id", "uid"))).where(F.col("i") <= k + 1)
    distinct = settled(first.groupBy("key").agg(F.any_value("v").alias("v"), F.array_sort(F.collect_list(F.struct("vec_id", "uid"))).alias("held")), "distinct")
    asking = rows.where("query").select("key", F.col("vec_id").alias("query_id"), F.col("uid").alias("own"))

    root = distinct.select("key", "v", F.size("v").cast("string").alias("node"))
    now = settled(root.withColumn("query", F.lit(False)).unionByName(root.join(asking.select("key").distinct().hint("merge"), "key", "left_semi").withColumn("query", F.lit(True))), "placed")
    final, share = [], recall
    for level in range(MOST_LEVELS):
        sizes = settled(now.where("NOT query").groupBy("node").agg(F.count("*").alias("n")), "sizes")
        if level == 0:
            most = sizes.agg(F.max("n")).first()[0] or 0
            levels = 1
            while most > leaf_rows * FANOUT**levels and levels < MOST_LEVELS:
                levels += 1
            share = recall ** (1 / levels)
        large = sizes.where((F.col("n") > (leaf_rows if level else 2 * part_rows)) & ~F.col("node").endswith("!"))
        n_large = large.count()
        if not n_large:
            break
        split = settled(now.join(small(large, n_large), "node"), "split")
        final.append(settled(now.join(small(large, n_large), "node", "left_anti"), "final"))
        spot = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
        chosen = split.where(~F.col("query") & (spot < (sample_rows + 7 * sample_rows**0.5 + 50) / F.col("n") * (1 << 40))).withColumn("spot", spot)
        chosen = chosen.withColumn("i", F.row_number().over(W.partitionBy("node").orderBy("spot", "key"))).where(F.col("i") <= sample_rows).select("node", "n", "key", "v")
        routers = settled(chosen.groupBy("node").applyInPandas(_fitted(share, part_rows), "node string, router binary"), "routers")
        blocks = F.ceil(F.col("n") / block_rows).cast("int")
        left = split.withColumn("block", F.pmod(F.xxhash64("key"), blocks).cast("int"))
        right = routers.join(large, "node").withColumn("block", F.explode(F.sequence(F.lit(0), blocks - 1))).select("node", "block", "router")
        right = right.toDF(*right.columns)
        moved = left.groupBy("node", "block").cogroup(right.groupBy("node", "block")).applyInArrow(_routed, "key string, v array<double>, node string, query boolean")
        last, now = now, settled(moved, "placed")
        discard(last, sizes, split, routers)
    for part in final:
        now = now.unionByName(part)
    counted = settled(now.groupBy("node").agg(F.count_if(~F.col("query")).alias("n"), F.count_if("query").alias("asked")).where("n > 0 AND asked > 0"), "counted")
    n_parts = counted.count()
    blocks, turns = F.ceil(F.col("n") / block_rows).cast("int"), F.ceil(F.col("asked") / block_rows).cast("int")
    met = now.join(small(counted, n_parts), "node")
    each = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    own = lambda count: F.pmod(F.xxhash64("key", F.lit(7)), count).cast("int")
    candidates = met.where("NOT query").withColumn("block", own(blocks)).withColumn("turn", each(turns)).join(distinct.select("key", "held").hint("merge"), "key").select("node", "block", "turn", "v", "held")
    asked = met.where("query").withColumn("turn", own(turns)).withColumn("block", each(blocks)).select("node", "block", "turn", "key", "v")
    by = ("node", "block", "turn")
    candidates = candidates.toDF(*candidates.columns)  # columns of its own, as both sides come from one table
    found = asked.groupBy(*by).cogroup(candidates.groupBy(*by)).applyInArrow(_block(k), "key string, vec_id long, uid long, score double")
    best = found.withColumn("i", F.row_number().over(W.partitionBy("key").orderBy(F.desc("score"), "vec_id", "uid"))).where(F.col("i") <= k + 1)
    best = settled(best.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("i", "vec_id", "uid", "score"))).alias("best")), "best")
    answers = spread_join(asking, asking.count(), "key", best).select("query_id", "own", F.slice(F.filter("best", lambda x: x["uid"] != F.col("own")), 1, k).alias("best"))
    return answers.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
