"""Language identification of mixed-language text.

The scripts of a word's letters narrow the languages that it may have; byte trigrams and the whole word score it under each; Viterbi over the
words, with a penalty for each switch, labels spans.  A text's language is the one that most of its letters are labelled with.

Training takes at most ``max_train_rows`` rows with text and language, those with the smallest hash of their id; counts of their features are
added up on the executors, so the driver gets one row per language and bucket.

Defined results: null text, empty text and text without a letter have the language ``und``, no spans and score 0; so have all texts if there
is no training row; null languages train nothing; ties go to the language first by code point; repeated rows are labelled each; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.common import Interned, bounded, longest_first, text_chunks

BITS = 16
MAX_TRAIN_ROWS = 20_000
SWITCH = 6.0
FLOOR = 1e-6
#: First and last code point of letters of a script (Unicode blocks).
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "thai": [(0xE00, 0xE7F)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0x20000, 0x2FA1F)],
}
NAMES = [*SCRIPTS, "other", "none"]
_NOT_WORD = bytes(c if c >= 128 or 65 <= c <= 90 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


def script_of(word: bytes) -> int:
    """Index into NAMES of the script that most letters of a word have; ``none`` without letters."""
    if word.isascii():
        return 0 if any(65 <= c <= 90 or 97 <= c <= 122 for c in word) else len(NAMES) - 1
    votes = [0] * len(NAMES)
    for ch in word.decode("utf-8", "replace"):
        if ch.isalpha():
            c = ord(ch)
            votes[next((i for i, r in enumerate(SCRIPTS.values()) if any(a <= c <= b for a, b in r)), len(SCRIPTS))] += 1
    return int(np.argmax(votes)) if any(votes) else len(NAMES) - 1


def features(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the word, bucket) of all byte trigrams of the words, and of the words as wholes."""
    joined = b"".join(b" " + w + b" " for w in words)
    b = np.frombuffer(joined, np.uint8).astype(np.uint32)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    tri = ((b[:-2] * 0x9E3779B1 + b[1:-1] * 0x85EBCA6B + b[2:] * 0xC2B2AE35) >> np.uint32(32 - BITS)).astype(np.int64)
    at = np.repeat(np.arange(len(words)), sizes)[:-2]
    inside = np.arange(len(tri)) - np.repeat(np.cumsum(sizes) - sizes, sizes)[:-2] <= np.repeat(sizes, sizes)[:-2] - 3
    whole = np.fromiter((xxhash.xxh32_intdigest(w) & ((1 << BITS) - 1) for w in words), np.int64, len(words)) + (1 << BITS)
    return np.concatenate([at[inside], np.arange(len(words))]), np.concatenate([tri[inside], whole])


def normal(data: bytes) -> list[bytes]:
    """Lower-case words of letters."""
    return (data.decode("utf-8", "replace").lower().encode() if not data.isascii() else data.lower()).translate(_NOT_WORD).split()


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # (2 ** (BITS + 1), languages): log share of a feature
    allowed: np.ndarray  # (scripts, languages)

    def word_scores(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Scores of words under each language, and whether they have letters."""
        at, bucket = features(words)
        out = np.zeros((len(words), len(self.languages)))
        for j in range(len(self.languages)):
            out[:, j] = np.bincount(at, self.weights[bucket, j], len(words))
        scripts = np.fromiter(map(script_of, words), np.int64, len(words))
        out -= out.max(1, keepdims=True)
        out = np.maximum(out, -12.0)
        lettered = scripts < len(NAMES) - 1
        out += np.where(self.allowed[scripts], 0.0, -30.0)
        out[~lettered] = 0.0
        return out.astype(np.float32), lettered


def viterbi(scores: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """Best labels of all words of all texts (their rows of ``scores`` one after the other); the texts advance together, word by word."""
    ends = np.cumsum(lengths)
    order, running = longest_first(lengths)
    at = (ends - lengths)[order]
    k = scores.shape[1]
    stay, came = np.zeros((len(scores), k), bool), np.zeros(len(scores), np.int16)
    last = np.zeros((len(lengths), k), np.float32)
    for t, n in enumerate(running):
        rows = at[:n] + t
        if t == 0:
            last[:n] = scores[rows]
            continue
        best = last[:n].argmax(1)
        switch = last[np.arange(n), best][:, None] - penalty
        kept = last[:n] >= switch
        stay[rows], came[rows] = kept, best
        last[:n] = np.where(kept, last[:n], switch) + scores[rows]
    labels = np.zeros(len(scores), np.int16)
    now = last.argmax(1)
    for t in range(len(running) - 1, -1, -1):
        n = running[t]
        rows = at[:n] + t
        labels[rows] = now[:n]
        kept = stay[rows, now[:n]]
        now[:n] = np.where(kept, now[:n], came[rows])
    return labels


def train(docs: DataFrame, may_train: Column, max_train_rows: int = MAX_TRAIN_ROWS) -> Model:
    """Learn from documents that pass ``may_train`` (a condition on doc_id)."""
    able = docs.select("doc_id", F.col("lang").alias("_lang"), "text").where(F.col("_lang").isNotNull() & F.col("doc_id").isNotNull() & may_train)
    chosen = bounded(able.select("doc_id", "_lang"), max_train_rows, "doc_id", "_lang").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total, scripts = Interned(), {}, {}
        for rows, texts in text_chunks(batches):
            langs = rows.column("_lang").to_pylist()
            for lang in set(langs):
                known.clear()
                known.fresh.clear()
                ws = [w for x, data in zip(langs, texts, strict=True) if x == lang for w in normal(data)]
                if not ws:
                    continue
                times = np.bincount(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
                at, bucket = features(known.fresh)
                total[lang] = total.get(lang, 0) + np.bincount(bucket, times[at], 2 << BITS)
                scripts[lang] = scripts.get(lang, 0) + np.bincount([script_of(w) for w in known.fresh], times, len(NAMES))
        for lang, counts in total.items():
            both = np.concatenate([counts, scripts[lang]])
            hit = np.flatnonzero(both)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(hit), pa.string()), pa.array(hit, pa.int32()), pa.array(both[hit], pa.float64())], ["lang", "bucket", "n"])

    counted = able.join(F.broadcast(chosen), "doc_id").mapInArrow(run, "lang string, bucket int, n double").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    # One row per language and bucket at most, whatever the size of the corpus.
    got = counted.toPandas()
    languages = sorted(set(got.lang))
    counts = np.zeros(((2 << BITS) + len(NAMES), max(len(languages), 1)))
    for j, lang in enumerate(languages):
        part = got[got.lang == lang]
        counts[part.bucket.to_numpy(), j] = part.n.to_numpy()
    half = 1 << BITS
    logs = [np.log(x / np.maximum(x.sum(0), 1) + FLOOR) for x in (counts[:half], counts[half : 2 * half])]
    seen = counts[2 * half :]
    allowed = seen > 0.001 * np.maximum(seen.sum(0), 1)
    allowed[~allowed.any(1)] = True
    return Model(languages, np.concatenate(logs).astype(np.float32), allowed)


def spans(labels: np.ndarray) -> list[tuple[int, int, int]]:
    """(label, first word, number of words) of runs."""
    cuts = np.flatnonzero(np.diff(labels, prepend=-1))
    return [(int(labels[a]), int(a), int(b - a)) for a, b in zip(cuts, [*cuts[1:], len(labels)], strict=True)]


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, most_words: int = 200_000) -> DataFrame:
    """doc_id, lang_pred, score (share of the letters so labelled), spans (language, first word, words) of every text."""
    names = model.languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, scores, lettered = Interned(), np.zeros((0, max(len(names), 1)), np.float32), np.zeros(0, bool)
        for rows, texts in text_chunks(batches):
            if len(known) > most_words:
                known, scores, lettered = Interned(), scores[:0], lettered[:0]
            ids, lengths, sizes = [], np.zeros(len(texts), np.int64), []
            for i, data in enumerate(texts):
                ws = normal(data)
                lengths[i] = len(ws)
                ids.append(np.fromiter(map(known.__getitem__, ws), np.int64, len(ws)))
                sizes.append(np.fromiter(map(len, ws), np.int64, len(ws)))
            if known.fresh and names:
                more, has = model.word_scores(known.fresh)
                scores, lettered = np.concatenate([scores, more]), np.concatenate([lettered, has])
                known.fresh.clear()
            flat, size = np.concatenate(ids), np.concatenate(sizes)
            pred, share, found = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
            if names and len(flat):
                labels, weight = viterbi(scores[flat], lengths, penalty), size * lettered[flat]
                ends = np.cumsum(lengths)
                for i, (a, b) in enumerate(zip(ends - lengths, ends, strict=True)):
                    votes = np.bincount(labels[a:b], weight[a:b], len(names))
                    if votes.sum() > 0:
                        pred[i], share[i] = names[int(votes.argmax())], float(votes.max() / votes.sum())
                        found[i] = [{"lang": names[k], "first": s, "words": n} for k, s, n in spans(labels[a:b])]
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())]))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(share, pa.float64()), pa.array(found, kind)], ["doc_id", "lang_pred", "score", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first: int, words: int>>")
