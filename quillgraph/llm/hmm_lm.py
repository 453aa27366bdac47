"""Hidden Markov language model.

Words have counts from all training texts.  The model's symbols are the most frequent words, the end, and classes of the other words (by
their last two bytes); a state emits a symbol, and a class emits its words by their add-one shares, one of them for words never seen.

Training.  Word counts are added up on the executors.  One task makes a first guess for Baum-Welch out of a sample: ``warm_docs`` texts of at
most ``WARM_LENGTH`` tokens, ``WARM_TOKENS`` together (clusters of texts, then ``warm_rounds`` rounds).  What is learned then comes from all
training texts: in each of ``rounds`` rounds every task adds up expected counts in runs of ``RUN`` tokens, they are summed per symbol across
tasks, and the driver gets one row per symbol.

Scoring.  The scaled forward recursion runs over the whole text, however long, so the likelihood is exact.  The counts of frequent words
(at most ``HEAD``, a bound that a count threshold guarantees) go to every task; all other words meet their counts in a join.

Defined results: null and empty texts are the end alone; rows without doc_id are for training (remainder 0); repeated rows count each; with no
training row all counts are 0 and the base score is 0; other columns are ignored.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import HashIndex, bounded, hashed_words, longest_first, release, settled, text_chunks

HEAD = 1 << 17
SYMBOLS = 1 << 13
CLASSES = 1 << 10
STATES = 12
RUN = 512
WARM_DOCS = 2_000
WARM_LENGTH = 8_192
WARM_TOKENS = 1 << 20
WARM_ROUNDS = 12
ROUNDS = 2
END = SYMBOLS + CLASSES
SIZE = END + 1


def _class(endings: np.ndarray) -> np.ndarray:
    return ((endings * 40503) >> 5) % CLASSES


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, class, n) of the words of a task; equal words of up to ``most`` gathered rows are one row."""
    most, gathered, held = 1 << 21, [], 0

    def merged(parts: list) -> tuple[np.ndarray, ...]:
        h, kind, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        u, first, back = np.unique(h, return_index=True, return_inverse=True)
        return u, kind[first], np.bincount(back, n, len(u)).astype(np.int64)

    def out(part: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(part[0].view(np.int64)), pa.array(part[1].astype(np.int32)), pa.array(part[2])], ["h", "kind", "n"])

    for _, texts in text_chunks(batches):
        h, _, endings = hashed_words([t.lower() for t in texts], True)
        u, first, n = np.unique(h, return_index=True, return_counts=True)
        gathered.append((u, _class(endings[first]), n))
        held += len(u)
        if held > most:
            gathered = [merged(gathered)]
            held = len(gathered[0][0])
            if held > most // 2:
                yield out(gathered[0])
                gathered, held = [], 0
    if gathered:
        yield out(merged(gathered))


@dataclass
class Counts:
    """What all training texts together say; ``head`` holds the bounded part."""

    total: int
    distinct: int
    texts: int
    hashes: np.ndarray
    times: np.ndarray
    symbol: np.ndarray  # of head words: their symbol, or -1
    class_mass: np.ndarray
    least: int  # smallest count of a head word
    symbol_share: np.ndarray


def _threshold(steps: list[tuple[int, int]], most: int) -> int:
    """The smallest count c so that at most ``most`` words have c or more; steps: (smallest count of a step, words), any order."""
    got, least = 0, 1 << 62
    for c, n in sorted(steps, reverse=True):
        if got + n > most:
            break
        got, least = got + n, c
    return least


def count(train: DataFrame) -> tuple[Counts, DataFrame]:
    """The counts, and the table (h, kind, c) of all words."""
    table = settled(train.select("text").mapInArrow(_counted, "h long, kind int, n long").groupBy("h").agg(F.min("kind").alias("kind"), F.sum("n").alias("c")), "words")
    texts = train.count()
    # At most 16 steps per doubling of the count: a few hundred rows whatever the corpus.
    step = F.floor(F.log2("c") * 16)
    by_step = [(r.least, r.n) for r in table.groupBy(step.alias("step")).agg(F.min("c").alias("least"), F.count("*").alias("n")).collect()]
    least, top = _threshold(by_step, HEAD), _threshold(by_step, SYMBOLS)
    sums = table.agg(F.sum("c").alias("c"), F.count("*").alias("n")).first()
    mass = np.ones(CLASSES)
    share = np.ones(SIZE)
    for r in table.where(F.col("c") < top).groupBy("kind").agg(F.sum(F.col("c") + 1).alias("m"), F.sum("c").alias("c")).collect():
        mass[r.kind] += r.m
        share[SYMBOLS + r.kind] += r.c
    head = table.where(F.col("c") >= least).select("h", "c").toPandas().sort_values("h", ignore_index=True)
    hashes, times = head.h.to_numpy(np.int64).view(np.uint64), head.c.to_numpy(np.int64)
    symbol = np.full(len(times), -1, np.int32)
    frequent = np.flatnonzero(times >= top)
    symbol[frequent] = np.arange(len(frequent))
    share[: len(frequent)] += times[frequent]
    share[END] += texts
    return Counts((sums.c or 0) + texts, sums.n + (texts > 0), texts, hashes, times, symbol, mass, least, share / share.sum()), table


def _encoded(counts: Counts):
    """Per text: symbols, counts and sums of its head words, and its other words with their numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = HashIndex(counts.hashes)
        logs, class_logs = np.append(np.log10(counts.times + 1.0), 0.0), np.log10(counts.class_mass)
        symbols, end_log = np.append(counts.symbol, -1), np.log10(counts.texts + 1.0)
        for rows, texts in text_chunks(batches):
            h, n, endings = hashed_words([t.lower() for t in texts], True)
            doc = np.repeat(np.arange(len(texts)), n)
            row = index.find(h)
            sym, kind = symbols[row], _class(endings)
            other = sym < 0
            sym = np.where(other, SYMBOLS + kind, sym).astype(np.uint16)
            total = lambda x: np.bincount(doc, x, len(texts))  # noqa: E731, B023
            head_log, inner = total(logs[row]) + end_log, total(np.where(other, logs[row] - class_logs[kind], 0.0))
            known = total(row >= 0).astype(np.int64) + (counts.texts > 0)
            at = np.flatnonzero(row < 0)
            order = at[np.lexsort((h[at], doc[at]))]
            first = np.ones(len(order), bool)
            first[1:] = (np.diff(doc[order]) != 0) | (h[order][1:] != h[order][:-1])
            starts = np.flatnonzero(first)
            times = np.diff(np.append(starts, len(order)))
            offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[order][starts], minlength=len(texts)))])
            ends = np.cumsum(n)
            packed = [np.append(sym[b - k : b], np.uint16(END)).astype(np.uint16).tobytes() for k, b in zip(n, ends, strict=True)]
            lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (h[order][starts].view(np.int64), times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(
                [rows.column("doc_id"), rows.column("held_out"), pa.array(packed, pa.binary()), pa.array(n + 1), pa.array(known), pa.array(head_log), pa.array(inner), *lists],
                ["doc_id", "held_out", "symbols", "n_tokens", "known", "head_log", "inner", "rare", "times"],
            )

    return run


@dataclass
class Hmm:
    start: np.ndarray
    again: np.ndarray  # state where a run of a longer text begins
    move: np.ndarray
    emit: np.ndarray  # (symbols, states)

    def forward(self, sequences: list[np.ndarray]) -> np.ndarray:
        """log10 likelihoods of whole sequences; those of a list advance together."""
        lengths = np.array([len(x) for x in sequences])
        order, running = longest_first(lengths)
        flat, at = np.concatenate(sequences), (np.cumsum(lengths) - lengths)[order]
        out, alpha = np.zeros(len(sequences)), None
        for t, n in enumerate(running):
            alpha = (self.start[None, :] if t == 0 else alpha[:n] @ self.move) * self.emit[flat[at[:n] + t]]
            scale = alpha.sum(1)
            out[order[:n]] += np.log10(scale)
            alpha = alpha / scale[:, None]
        return out

    def expected(self, runs: list[np.ndarray], opens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Expected counts (start, again, moves, emissions) of runs; opens: whether a run begins its text."""
        k = len(self.start)
        lengths = np.array([len(x) for x in runs])
        order, running = longest_first(lengths)
        flat, opens = np.concatenate([runs[i] for i in order]), opens[order]
        at = np.cumsum(lengths[order]) - lengths[order]
        b = self.emit[flat]
        alpha, scale = np.empty((len(flat), k)), np.empty(len(flat))
        for t, n in enumerate(running):
            x = (np.where(opens[:, None], self.start, self.again) if t == 0 else alpha[at[:n] + t - 1] @ self.move) * b[at[:n] + t]
            scale[at[:n] + t] = s = x.sum(1)
            alpha[at[:n] + t] = x / s[:, None]
        # ahead: what the move into a token leads to; gamma overwrites alpha from the end on.
        ahead, beta, moved = np.zeros((len(flat), k)), np.ones((len(runs), k)), np.zeros((k, k))
        for t in range(len(running) - 1, -1, -1):
            n = running[t]
            more = running[t + 1] if t + 1 < len(running) else 0
            rows = at[:n] + t
            beta[:more] = ahead[at[:more] + t + 1] @ self.move.T
            beta[more:n] = 1.0
            ahead[rows] = b[rows] * beta[:n] / scale[rows][:, None]
        last = np.zeros(len(flat), bool)
        last[at + lengths[order] - 1] = True
        inner = np.flatnonzero(~last)
        moved = self.move * (alpha[inner].T @ ahead[inner + 1])
        after = np.ones((len(flat), k))
        after[inner] = ahead[inner + 1] @ self.move.T
        gamma = alpha * after
        emitted = np.stack([np.bincount(flat, gamma[:, j], SIZE) for j in range(k)], axis=1)
        return gamma[at[opens]].sum(0), gamma[at[~opens]].sum(0), moved, emitted


def maximised(counts: tuple[np.ndarray, ...], share: np.ndarray, pull: float = 5.0) -> Hmm:
    """Probabilities from expected counts; a symbol's overall share keeps every emission above zero."""
    start, again, moved, emitted = (np.asarray(x, float) for x in counts)
    norm = lambda x, add: (x + add) / (x + add).sum(-1, keepdims=True)
    move = norm(moved, 0.01)
    return Hmm(norm(start, 0.1), norm(again, 0.1), move, ((emitted + pull * share[:, None]) / (emitted.sum(0) + pull)))


def _runs(sequences: Iterator[np.ndarray], tokens: int = 300_000) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    runs, opens, held = [], [], 0
    for x in sequences:
        for a in range(0, len(x), RUN):
            runs.append(x[a : a + RUN])
            opens.append(a == 0)
            held += len(runs[-1])
            if held >= tokens:
                yield runs, np.array(opens)
                runs, opens, held = [], [], 0
    if runs:
        yield runs, np.array(opens)


def warm_start(sequences: list[np.ndarray], share: np.ndarray, states: int = STATES, rounds: int = WARM_ROUNDS, seed: int = 11) -> Hmm:
    """Clusters of texts by their symbols give the first emissions; then rounds of Baum-Welch on these texts."""
    rng = np.random.default_rng(seed)
    if not sequences:
        return maximised((np.ones(states), np.ones(states), np.eye(states) * 9 + 1, np.repeat(share[:, None], states, 1)), share)
    group = rng.integers(0, states, len(sequences))
    sums = np.zeros((SIZE, states))
    for turn in range(8):
        sums[:] = 0
        for x, g in zip(sequences, group, strict=True):
            sums[:, g] += np.bincount(x, minlength=SIZE)
        logs = np.log((sums + 2 * share[:, None]) / (sums.sum(0) + 2))
        group = np.array([int((logs[x].sum(0) + rng.gumbel(size=states) * len(x) * 0.05 / (turn + 1)).argmax()) for x in sequences])
    model = maximised((np.bincount(group, minlength=states) + 1.0, sums.sum(0) / sums.sum() + 0.01, np.eye(states) * 95 + 5 / states, sums), share)
    for _ in range(rounds):
        found = [0, 0, 0, 0]
        for runs, opens in _runs(iter(sequences)):
            found = [a + b for a, b in zip(found, model.expected(runs, opens), strict=True)]
        model = maximised(tuple(found), share)
    return model


def first_guess(learn: DataFrame, share: np.ndarray, warm_docs: int = WARM_DOCS) -> Hmm:
    """``learn``: doc_id, symbols, n_tokens.  The driver gets the model alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen, left = [], WARM_TOKENS
        for batch in batches:
            for x in batch.column("symbols").to_pylist():
                if len(x) // 2 <= left:
                    chosen.append(np.frombuffer(x, np.uint16))
                    left -= len(x) // 2
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(warm_start(chosen, share))], pa.binary())], ["model"])

    short = learn.where(F.col("n_tokens") <= WARM_LENGTH).select("doc_id", "symbols")
    found = bounded(short, warm_docs, "doc_id", "symbols").select("symbols").coalesce(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0].model) if found else warm_start([], share)


def _summed(model: Hmm):
    """Expected counts of a task: a row per symbol; the moves and starts as rows of negative numbers."""
    k = len(model.start)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = None
        for batch in batches:
            for runs, opens in _runs(np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()):
                got = model.expected(runs, opens)
                found = got if found is None else tuple(a + b for a, b in zip(found, got, strict=True))
        if found is not None:
            hit = np.flatnonzero(found[3].sum(1))
            names = np.concatenate([[-1, -2], -3 - np.arange(k), hit])
            values = np.concatenate([found[0][None], found[1][None], found[2], found[3][hit]])
            yield pa.RecordBatch.from_arrays([pa.array(names.astype(np.int32)), *(pa.array(values[:, j]) for j in range(k))], ["name", *(f"s{j}" for j in range(k))])

    return run


def baum_welch(encoded: DataFrame, model: Hmm, share: np.ndarray) -> Hmm:
    """One round over all rows of ``encoded``."""
    k = len(model.start)
    columns = [f"s{j}" for j in range(k)]
    sums = encoded.select("symbols").mapInArrow(_summed(model), "name int, " + ", ".join(f"{c} double" for c in columns)).groupBy("name").agg(*(F.sum(c).alias(c) for c in columns))
    got = sums.toPandas().set_index("name")  # one row per symbol at most
    if not len(got):
        return model
    emitted = np.zeros((SIZE, k))
    own = got[got.index >= 0]
    emitted[own.index] = own.to_numpy()
    return maximised((got.loc[-1].to_numpy(), got.loc[-2].to_numpy(), got.loc[[-3 - j for j in range(k)]].to_numpy(), emitted), share)


def _forward(model: Hmm):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = model.forward([np.frombuffer(x, np.uint16) for x in batch.column("symbols").to_pylist()])
            keep = [c for c in batch.schema.names if c != "symbols"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(found)], [*keep, "likelihood"])

    return run


def score(docs: DataFrame, rounds: int = ROUNDS, warm_docs: int = WARM_DOCS) -> DataFrame:
    """``docs``: doc_id, text, held_out.  Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark = docs.sparkSession
    train = docs.where("NOT held_out")
    counts, words = count(train)
    release(spark)
    encoded = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(
        _encoded(counts), "doc_id long, held_out boolean, symbols binary, n_tokens long, known long, head_log double, inner double, rare array<long>, times array<int>"
    )
    encoded = settled(encoded.withColumn("uid", F.monotonically_increasing_id()), "encoded")
    learn = encoded.where("NOT held_out")
    model = first_guess(learn, counts.symbol_share, warm_docs)
    for _ in range(rounds):
        model = baum_welch(learn, model, counts.symbol_share)
    # Rare words meet their counts; words never seen in training add nothing (log10 of 0 + 1).
    rare = encoded.select("uid", F.explode(F.arrays_zip("rare", "times")).alias("w")).select("uid", F.col("w.rare").alias("h"), F.col("w.times").alias("t"))
    found = rare.join(words.where(F.col("c") < counts.least).select("h", "c"), "h")
    sums = found.groupBy("uid").agg(F.sum("t").alias("rare_known"), F.sum(F.col("t") * F.log10(F.col("c") + 1)).alias("rare_log"))
    light = encoded.select("uid", "doc_id", "held_out", "n_tokens", "known", "head_log", "inner", "symbols")
    scored = light.mapInArrow(_forward(model), "uid long, doc_id long, held_out boolean, n_tokens long, known long, head_log double, inner double, likelihood double")
    out = scored.join(sums, "uid", "left").withColumns({"rare_log": F.coalesce("rare_log", F.lit(0.0)), "rare_known": F.coalesce("rare_known", F.lit(0))})
    room = float(np.log10(counts.total + counts.distinct + 1))
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("head_log") + F.col("rare_log") - F.col("n_tokens") * room).alias("base_score"), (F.col("likelihood") + F.col("inner") + F.col("rare_log")).alias("score"),
    )
