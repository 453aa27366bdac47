"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pairwise sum is 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2), so
a document costs time linear in its words.  Words are hashed to ``2 ** BITS`` buckets, each occurrence with value ``WORD_WEIGHT`` / words.

Training takes at most ``max_train_rows`` labelled rows, those with the smallest hash of their id; their features (not their texts) go to
one task, which fits the model by mini-batches of AdaGrad.  Scoring reads every whole text.

Defined results: null and empty texts have no words and are scored from their statistics; rows without label, or with a null label, train
nothing; several labels of a document count as their smallest; with no training row, or only one class, all scores are the smoothed base rate;
null n_chars (or no such column) gives no metadata; repeated rows are scored each; further columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import bounded, packed, text_chunks, unpacked

BITS = 15
RANK = 8
WORD_WEIGHT = 3.0
MAX_TRAIN_ROWS = 8_000
THRESHOLD = 0.3
STATS = 18
_SYMBOLS = np.frombuffer(b"#$%&*+/<=>@\\^_`{|}~[]()", np.uint8)


class Buckets(dict):
    """Word to bucket; forgets all when it has grown to ``most`` words."""

    def __init__(self, most: int = 200_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = n = xxhash.xxh64_intdigest(word) & ((1 << BITS) - 1)
        return n


def statistics(data: bytes, ws: list[bytes], n_chars: int | None) -> list[float]:
    """Structure of a text, and what the metadata say beyond it."""
    n, k = max(len(data), 1), max(len(ws), 1)
    h = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    upper, lower, digits = int(h[65:91].sum()), int(h[97:123].sum()), int(h[48:58].sum())
    lines = data.split(b"\n")
    chars = n - int(h[128:192].sum()) if data else 0
    return [
        np.log1p(len(ws)), np.log1p(len(data)), upper / max(upper + lower, 1), (upper + lower) / n, digits / n, int(h[_SYMBOLS].sum()) / n, int(h[33]) / n, int(h[124]) / n, int(h[46]) / k, int(h[44]) / k,
        int(h[128:].sum()) / n, len(set(ws)) / k, sum(map(eq, ws, ws[1:])) / k, 1 - len(set(lines)) / len(lines), np.log1p(len(lines)), (n - k) / k, int(h[58:65].sum() + h[34:40].sum()) / n,
        abs(np.log1p(n_chars) - np.log1p(chars)) if n_chars is not None and n_chars >= 0 else 0.0,
    ]


def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, statistics, number of words of each row, buckets of all words)."""
    buckets = Buckets()
    for rows, texts in text_chunks(batches):
        meta = rows.column("n_chars").to_pylist() if "n_chars" in rows.schema.names else [None] * len(texts)
        stats, counts, found = np.zeros((len(texts), STATS)), np.zeros(len(texts), np.int64), []
        for i, data in enumerate(texts):
            ws = data.split()
            stats[i], counts[i] = statistics(data, ws, meta[i]), len(ws)
            found.append(np.fromiter(map(buckets.__getitem__, ws), np.int32, len(ws)))
        yield rows, stats, counts, np.concatenate(found) if found else np.zeros(0, np.int32)


@dataclass
class Model:
    w0: float
    w: np.ndarray  # buckets, then statistics
    v: np.ndarray
    mean: np.ndarray
    std: np.ndarray

    def scores(self, stats: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> np.ndarray:
        z = np.clip((stats - self.mean) / self.std, -4, 4)
        n = 1 << BITS
        x = np.where(counts > 0, WORD_WEIGHT / np.maximum(counts, 1), 0)
        # Words in runs of a bounded number, so that no text makes the gathered rows large.
        linear, total, squares = np.zeros(len(counts)), np.zeros((len(counts), RANK)), np.zeros(len(counts))
        row = np.repeat(np.arange(len(counts)), counts)
        for a in range(0, len(ids), 1 << 18):
            b, r = ids[a : a + (1 << 18)], row[a : a + (1 << 18)]
            starts = np.flatnonzero(np.diff(r, prepend=-1))
            at = r[starts]
            v = self.v[b]
            linear[at] += np.add.reduceat(self.w[b], starts, dtype=np.float64)
            total[at] += np.add.reduceat(v, starts, axis=0, dtype=np.float64)
            squares[at] += np.add.reduceat((v * v).sum(1), starts, dtype=np.float64)
        linear, total, squares = linear * x, total * x[:, None], squares * x * x
        linear += z @ self.w[n:]
        total += z @ self.v[n:]
        squares += (z * z) @ (self.v[n:] ** 2).sum(1)
        # Sums are in double precision and rounded, so that equal texts have equal scores whatever stands beside them.
        return np.round(1 / (1 + np.exp(-np.clip(self.w0 + linear + 0.5 * ((total**2).sum(1) - squares), -30, 30))), 9)


def fit(stats: np.ndarray, words: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = 10, batch: int = 64, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> Model:
    """``words``: distinct buckets and their shares of the words, of each row."""
    n, rng = 1 << BITS, np.random.default_rng(seed)
    mean, std = (stats.mean(0), stats.std(0) + 1e-6) if len(stats) else (np.zeros(STATS), np.ones(STATS))
    base = (labels.sum() + 1) / (len(labels) + 2)
    model = Model(float(np.log(base / (1 - base))), np.zeros(n + STATS, np.float32), np.zeros((n + STATS, RANK), np.float32), mean, std)
    if len(set(labels.tolist())) < 2:
        return model
    model.v[:] = rng.normal(0, 0.02, model.v.shape)
    z = np.clip((stats - mean) / std, -4, 4).astype(np.float32)
    gw, gv, g0 = np.full(len(model.w), 1e-6, np.float32), np.full(model.v.shape, 1e-6, np.float32), 1e-6
    own = np.arange(n, n + STATS)
    for _ in range(epochs):
        order = rng.permutation(len(labels))
        for a in range(0, len(order), batch):
            rows = order[a : a + batch]
            ids = np.concatenate([np.concatenate([words[i][0], own]) for i in rows])
            x = np.concatenate([np.concatenate([words[i][1] * WORD_WEIGHT, z[i]]) for i in rows]).astype(np.float32)
            ends = np.cumsum([len(words[i][0]) + STATS for i in rows])
            starts = np.concatenate([[0], ends[:-1]])
            vx = model.v[ids] * x[:, None]
            s = np.add.reduceat(vx, starts, axis=0)
            out = model.w0 + np.add.reduceat(model.w[ids] * x, starts) + 0.5 * ((s**2).sum(1) - np.add.reduceat((vx**2).sum(1), starts))
            err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - labels[rows]) / len(rows)
            lengths = ends - starts
            ex = np.repeat(err, lengths).astype(np.float32) * x
            distinct, back = np.unique(ids, return_inverse=True)
            dw, dv = np.zeros(len(distinct), np.float32), np.zeros((len(distinct), RANK), np.float32)
            np.add.at(dw, back, ex)
            np.add.at(dv, back, ex[:, None] * (np.repeat(s, lengths, axis=0) - vx))
            dw += decay * model.w[distinct]
            dv += decay * model.v[distinct]
            gw[distinct] += dw * dw
            gv[distinct] += dv * dv
            g0 += float(err.sum()) ** 2
            model.w[distinct] -= rate * dw / np.sqrt(gw[distinct])
            model.v[distinct] -= rate * 0.5 * dv / np.sqrt(gv[distinct])
            model.w0 -= rate * float(err.sum()) / g0**0.5
    return model


def train(docs: DataFrame, labels: DataFrame, may_train: Column, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Fit on the documents whose label row passes ``may_train`` (a condition on doc_id)."""
    chosen = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & may_train).groupBy("doc_id").agg(F.min("quality").cast("int").alias("_label"))
    chosen = bounded(chosen, max_train_rows, "doc_id")
    rows = docs.select(*[c for c in ("doc_id", "text", "n_chars") if c in docs.columns]).join(F.broadcast(chosen), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, stats, counts, ids in featured(batches):
            ends, found = np.cumsum(counts), []
            for a, b in zip(ends - counts, ends, strict=True):
                u, c = np.unique(ids[a:b], return_counts=True)
                found.append((u.astype(np.int32).tobytes(), (c / max(b - a, 1)).astype(np.float32).tobytes()))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_label"), pa.array([x.tobytes() for x in stats], pa.binary()), pa.array([x[0] for x in found], pa.binary()), pa.array([x[1] for x in found], pa.binary())], ["doc_id", "label", "stats", "ids", "shares"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted((tuple(r.values()) for b in batches for r in b.to_pylist()), key=lambda r: (r[0], r[2], r[3]))
        own = np.array([np.frombuffer(r[2]) for r in got]).reshape(len(got), STATS)
        model = fit(own, [(np.frombuffer(r[3], np.int32), np.frombuffer(r[4], np.float32)) for r in got], np.array([min(max(r[1], 0), 1) for r in got], float))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    # One task gets the features of at most max_train_rows documents; the driver gets the model alone.
    features = rows.mapInArrow(run, "doc_id long, label int, stats binary, ids binary, shares binary")
    found = features.repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else fit(np.zeros((0, STATS)), [], np.zeros(0))


def _scored(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``: text, and n_chars if known; any other columns are carried on.  Adds ``score``."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, stats, counts, ids in featured(batches):
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(model.scores(stats, counts, ids), pa.float64())], [*rows.schema.names, "score"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with the column ``score``: 0 to 1, higher if label 1 is likelier.  It replaces a column of that name."""
    return _scored(docs.drop("score"), model)


def keep(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose score reaches the threshold, with their own columns."""
    return _scored(packed(docs, "text", "n_chars"), model).where(F.col("score") >= threshold).select(*unpacked(docs.columns, "text", "n_chars"))
