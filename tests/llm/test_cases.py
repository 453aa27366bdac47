"""Odd rows in every operator and stage, hot keys, samples, and plain second implementations of what other tests only measure."""

import collections
import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipe
from quillgraph.llm import common, decontaminate, hmm_lm, language_id, mixing, quality_fm, simhash_dedup, substring_dedup

#: Names that the operators use, or used to use, for columns of their own.
EXTRA = ["_id", "_row", "row", "kept", "n_words", "score", "idx", "s", "seats", "quota", "shard", "token", "component_id", "leaked"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in EXTRA)


def words(rng, n):
    return " ".join(f"w{rng.randrange(900)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    rng = random.Random(5)
    folder = f"file://{tmp_path_factory.mktemp('odd')}"
    item, passage = words(rng, 24), words(rng, 70)
    long = words(rng, 9_000)
    texts = [(i, words(rng, rng.randrange(5, 80))) for i in range(30)]
    texts += [(40, None), (41, ""), (42, " \n\t "), (None, "no id"), (None, None), (43, long), (44, long + " tail"), (45, "one"), (45, "one"), (45, "another text of the same id")]
    texts += [(50, words(rng, 20) + " " + item + " " + words(rng, 20)), (51, f"{passage} {words(rng, 30)}"), (52, f"{words(rng, 30)} {passage} {words(rng, 9)}"), (60, texts[3][1]), (61, texts[3][1])]
    rows = [(i, x, None if (i or 0) % 4 == 0 else "en", None if (i or 0) % 5 == 0 else f"s{(i or 0) % 3}", None if (i or 0) % 3 == 0 else len(x or ""), *[f"{c}-{i}" for c in EXTRA]) for i, x in texts]
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, int(i % 2 == 0), 0) for i in range(20)] + [(21, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item), (2, None), (3, ""), (None, item), (4, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def own_columns_kept(rows):
    assert all(r[c] == f"{c}-{r.doc_id}" for r in rows for c in EXTRA)


def test_stages_on_odd_rows(spark, odd):
    docs = common.table(spark, odd, "documents")
    start = docs.collect()
    for name, stage in pipe.STAGES:
        before = docs.collect()
        out = common.settled(stage(spark, docs, odd), f"odd-{name}")
        rows = out.collect()
        own_columns_kept(rows)
        assert out.columns[: len(docs.columns)] == docs.columns and (name == "mix" or out.columns == docs.columns)
        have = collections.Counter((r.doc_id, r.text) for r in rows)
        if name != "substrings":
            assert not have - collections.Counter((r.doc_id, r.text) for r in before)
        if name == "near_dups":
            assert sum(r.doc_id is None for r in rows) == sum(r.doc_id is None for r in before)
            prints = {r.doc_id: simhash_dedup.fingerprint((r.text or "").encode()) for r in rows if r.doc_id is not None}
            assert len(prints) == sum(r.doc_id is not None for r in rows)
            assert all((a ^ b).bit_count() > 4 for a, b in itertools.combinations(prints.values(), 2))
            every = [simhash_dedup.fingerprint((r.text or "").encode()) for r in before if r.doc_id is not None]
            assert all(any((f ^ p).bit_count() <= 4 * len(every) for p in prints.values()) for f in every)
        if name == "benchmark":
            assert 50 not in {r.doc_id for r in rows} and {r.doc_id for r in rows} >= {r.doc_id for r in before} - {50, None}
        if name == "mix":
            assert all(0 < r.taken <= 3 * r["size"] for r in rows)
        docs = out
    assert {r.doc_id for r in start} > {r.doc_id for r in rows}


def test_stages_on_empty_tables(spark, odd):
    none = common.table(spark, odd, "documents").where("FALSE")
    for name, stage in pipe.STAGES:
        out = stage(spark, none, odd)
        assert out.isEmpty() and out.columns[: len(none.columns)] == none.columns


def test_a_stage_leaves_other_results_alone(spark, odd):
    docs = common.table(spark, odd, "documents")
    held = simhash_dedup.near_duplicates(docs)
    first = common.settled(pipe.near_dups(spark, docs, odd), "first")
    left = common.settled(pipe.substrings(spark, first, odd), "second")
    assert held.count() == docs.count() and left.count() <= first.count()


def test_near_duplicates_on_odd_rows(spark, odd):
    rows = common.table(spark, odd, "documents")
    got = simhash_dedup.near_duplicates(rows).collect()
    want = collections.Counter((r.doc_id, f"{simhash_dedup.fingerprint((r.text or '').encode()):016x}") for r in rows.collect())
    assert collections.Counter((r.doc_id, r.fingerprint) for r in got) == want
    assert {r.component_id for r in got if r.doc_id in (40, 41, 42)} == {40} and {r.component_id for r in got if r.doc_id in (43, 44)} == {43}


def test_mix_with_columns_of_the_same_names(spark, odd):
    docs = common.table(spark, odd, "documents")
    key = lambda df: sorted((r.doc_id or -1, r["size"], r.source_size, round(r.target, 6), r.taken) for r in df.collect())
    mixed = mixing.mix(docs.withColumn("taken", F.lit("old")))
    assert key(mixed) == key(mixing.mix(docs.select("doc_id", "source", "text")))
    own_columns_kept(mixed.collect())
    assert mixing.mix(docs.where("FALSE")).isEmpty()


def test_substrings_with_columns_of_the_same_names(spark, odd):
    docs = common.table(spark, odd, "documents")
    cut = {(r.doc_id, r.text): r for r in substring_dedup.remove_repeats(docs).collect()}
    assert all(r["_id"] == f"_id-{i}" and r["score"] == f"score-{i}" for (i, _), r in cut.items())
    plain = {(r.doc_id, r.text): r for r in substring_dedup.remove_repeats(docs.select("doc_id", "text")).collect()}
    assert {k: (r.n_words, r.n_removed, r.kept) for k, r in cut.items()} == {k: (r.n_words, r.n_removed, r.kept) for k, r in plain.items()}
    assert next(r for (i, _), r in cut.items() if i == 44).n_removed == 9_000 and next(r for (i, _), r in cut.items() if i == 52).n_removed == 70


def test_substring_hash_chance_is_met_by_other_hashes(spark, odd, monkeypatch):
    docs = common.table(spark, odd, "documents").select("doc_id", "text")
    want = sorted(map(tuple, substring_dedup.repeated_spans(docs).select("doc_id", "pos", "words").collect()))
    real, calls = substring_dedup._spans, []

    def spans(*args):
        found, chance = real(*args)
        calls.append(args[-1])
        return found, chance or len(calls) == 1

    monkeypatch.setattr(substring_dedup, "_spans", spans)
    got = substring_dedup.repeated_spans(docs)
    assert calls == [0, 1]
    cover = lambda rows: {(i, p) for i, a, n in rows for p in range(a, a + n)}
    assert cover(map(tuple, got.select("doc_id", "pos", "words").collect())) == cover(want)


def test_decontamination_of_long_texts_and_ties(spark):
    rng = random.Random(6)
    item = words(rng, 30)
    docs = [(1, f"{words(rng, 15_000)} {item} {words(rng, 15_000)}", "x"), (2, f"a b {item} c {item} d", "x"), (3, None, "x"), (4, "", "x"), (None, item, "x"), (5, words(rng, 60), "x"), (2, f"a b {item} c {item} d", "y")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, item, 1), (8, item, 1), (9, None, 1)], "item_id long, text string, doc_id long")
    got = sorted((r.doc_id, r.item_id, round(r.similarity, 6), r.start, r.n_words) for r in decontaminate.matches(df, bench).collect())
    assert got == [(1, 7, 1.0, 15_000, 30), (1, 8, 1.0, 15_000, 30), (2, 7, 1.0, 2, 30), (2, 8, 1.0, 2, 30)]
    left = decontaminate.clean(df, bench)
    assert sorted((r.doc_id or 0, r.item_id) for r in left.collect()) == [(0, "x"), (3, "x"), (4, "x"), (5, "x")]
    assert decontaminate.matches(df.where("FALSE"), bench).isEmpty() and decontaminate.matches(df, bench.where("FALSE")).isEmpty()


def test_radius_loses_nothing_at_the_similarity():
    """SimHash of shingle sets with the least overlap that the similarity allows."""
    rng = np.random.default_rng(0)

    def fingerprint(h):
        return ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).sum(0) * 2 > len(h)

    for m in (9, 12, 20, 50, 200):
        u = int(m * (1 - decontaminate.SIMILARITY) / (1 + decontaminate.SIMILARITY) + 1e-9)
        for _ in range(400):
            x = rng.integers(0, 2**64, m, dtype=np.uint64)
            y = np.concatenate([x[u:], rng.integers(0, 2**64, u, dtype=np.uint64)])
            assert (fingerprint(x) != fingerprint(y)).sum() <= decontaminate.RADIUS


# --- language model


def test_forward_over_a_long_text():
    rng = np.random.default_rng(1)
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Hmm(norm(rng.random(3)), norm(rng.random(3)), norm(rng.random((3, 3))), norm(rng.random((hmm_lm.SIZE, 3)).T).T)
    x = rng.integers(0, hmm_lm.SIZE, 20_000).astype(np.uint16)
    logs = np.log(model.start) + np.log(model.emit[x[0]])
    for t in x[1:]:
        top = logs.max()
        logs = np.log(np.exp(logs - top) @ model.move) + top + np.log(model.emit[t])
    want = (logs.max() + math.log(np.exp(logs - logs.max()).sum())) / math.log(10)
    assert model.forward([x])[0] == pytest.approx(want, rel=1e-9)


def test_language_model_on_odd_tables(spark, odd):
    docs = common.table(spark, odd, "documents").withColumn("held_out", F.col("doc_id") % 7 == 2)
    docs = docs.withColumn("held_out", F.coalesce("held_out", F.lit(False)))
    got = hmm_lm.score(docs, rounds=1, warm_docs=10).collect()
    assert len(got) == docs.count() and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (40, 41, 42)} == {1} and {r.n_tokens for r in got if r.doc_id == 43} == {9_001}
    assert hmm_lm.score(docs.where("FALSE"), rounds=1).isEmpty()
    untrained = hmm_lm.score(docs.where("doc_id < 5").withColumn("held_out", F.lit(True)), rounds=1).collect()
    assert {r.train_tokens for r in untrained} == {0} and {r.base_score for r in untrained} == {0.0}


# --- classifiers


def test_first_step_follows_the_gradient():
    rng = np.random.default_rng(4)
    rows, rate = 24, 1e-3
    stats = rng.normal(size=(rows, quality_fm.STATS))
    labels = (rng.random(rows) > 0.5).astype(float)
    ids = [np.unique(rng.integers(0, 12, 5)).astype(np.int32) for _ in range(rows)]
    shares = [np.full(len(x), 1 / len(x), np.float32) for x in ids]
    model = quality_fm.fit(stats, list(zip(ids, shares, strict=True)), labels, epochs=1, batch=rows, rate=rate, decay=0.0)
    n = 1 << quality_fm.BITS
    v = np.random.default_rng(7).normal(0, 0.02, (n + quality_fm.STATS, quality_fm.RANK)).astype(np.float32).astype(float)
    w = np.zeros(n + quality_fm.STATS)
    z = np.clip((stats - stats.mean(0)) / (stats.std(0) + 1e-6), -4, 4)
    base = (labels.sum() + 1) / (rows + 2)
    w0 = math.log(base / (1 - base))

    def loss(w, v):
        total = 0.0
        for i in range(rows):
            at = np.concatenate([ids[i], np.arange(n, n + quality_fm.STATS)])
            x = np.concatenate([shares[i] * quality_fm.WORD_WEIGHT, z[i]])
            pairs = sum(float(v[a] @ v[b]) * x[j] * x[k] for (j, a), (k, b) in itertools.combinations(enumerate(at), 2))
            p = 1 / (1 + math.exp(-(w0 + float(w[at] @ x) + pairs)))
            total -= labels[i] * math.log(p) + (1 - labels[i]) * math.log(1 - p)
        return total / rows

    eps = 1e-4
    for j in (0, 3, 7, n, n + 5):
        up, down = w.copy(), w.copy()
        up[j] += eps
        down[j] -= eps
        g = (loss(up, v) - loss(down, v)) / (2 * eps)
        assert model.w[j] == pytest.approx(-rate * g / math.sqrt(1e-6 + g * g), rel=0.02, abs=1e-6)
        up, down = v.copy(), v.copy()
        up[j, 2] += eps
        down[j, 2] -= eps
        g = (loss(w, up) - loss(w, down)) / (2 * eps)
        assert model.v[j, 2] - v[j, 2] == pytest.approx(-rate * 0.5 * g / math.sqrt(1e-6 + g * g), rel=0.05, abs=3e-6)


def test_quality_without_metadata_and_with_ties(spark, odd):
    docs = common.table(spark, odd, "documents")
    model = quality_fm.train(docs, common.table(spark, odd, "labels"), F.lit(True))
    got = quality_fm.score(docs, model).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    same = collections.defaultdict(set)
    for r in quality_fm.score(docs.drop("n_chars"), model).collect():
        same[r.text].add(r.score)
    assert all(len(x) == 1 for x in same.values())
    assert quality_fm.score(docs.where("FALSE"), model).isEmpty()


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    lengths = np.array([5, 1, 0, 6, 3])
    scores = rng.normal(size=(int(lengths.sum()), 3)).astype(np.float32) * 2
    labels = language_id.viterbi(scores, lengths, 1.5)
    ends = np.cumsum(lengths)
    for a, b in zip(ends - lengths, ends, strict=True):
        value = lambda path, part=scores[a:b]: sum(part[i, k] for i, k in enumerate(path)) - 1.5 * sum(x != y for x, y in itertools.pairwise(path))
        best = max((value(p) for p in itertools.product(range(3), repeat=int(b - a))), default=0.0)
        assert value(labels[a:b].tolist()) == pytest.approx(best, abs=1e-4)


def test_scripts_narrow_the_languages(spark):
    texts = ["der die das und nicht"] * 6, ["και το είναι από"] * 6, ["the of and to in"] * 6
    docs = spark.createDataFrame([(i * 10 + j, x, lang) for i, (lang, xs) in enumerate(zip(("de", "el", "en"), texts, strict=True)) for j, x in enumerate(xs)], "doc_id long, text string, lang string")
    model = language_id.train(docs, F.lit(True))
    for word in ("λόγος", "κόσμος", "word", "haus", "слово"):
        scores, lettered = model.word_scores([word.encode()])
        script = language_id.NAMES[language_id.script_of(word.encode())]
        by_hand = next((s for s, ranges in language_id.SCRIPTS.items() if any(a <= ord(word[0]) <= b for a, b in ranges)), "other")
        assert script == by_hand and lettered[0]
        seen = {"el"} if script == "greek" else {"de", "en"} if script == "latin" else {"de", "el", "en"}
        assert {x for x, s in zip(model.languages, scores[0], strict=True) if s > -20} == seen
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame([(1, "το και από", 1), (2, "12 .", 1), (3, None, 1), (4, "der das und το και από είναι και", 1)], "doc_id long, text string, score long"), model).collect()}
    assert got[1].lang_pred == "el" and got[2].lang_pred == got[3].lang_pred == "und" and [x.lang for x in got[4].spans] == ["de", "el"]
    assert language_id.identify(docs.where("FALSE"), model).isEmpty()
    nothing = language_id.train(docs.where("FALSE"), F.lit(True))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}


def test_languages_that_tie_go_by_code_point(spark):
    docs = spark.createDataFrame([(i, "same words here", lang) for i, lang in enumerate(("xx", "aa", "xx", "aa"))], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs, F.lit(True))).collect()} == {"aa"}


# --- shared helpers


def test_bounded_takes_the_smallest_hashes(spark):
    df = spark.range(5_000).withColumnRenamed("id", "k")
    got = {r.k for r in common.bounded(df, 300, "k").collect()}
    hashes = {r.k: r.h % (1 << 40) for r in df.withColumn("h", F.xxhash64("k")).collect()}
    assert got == set(sorted(hashes, key=hashes.get)[:300]) and common.bounded(df.where("k < 10"), 300, "k").count() == 10


def test_spread_join_of_a_hot_key(spark):
    rows = spark.createDataFrame([(0 if i % 2 else i % 40, i) for i in range(4_000)] + [(None, -1), (99, -2)], "k long, x long")
    lookup = spark.createDataFrame([(i, i * 10) for i in range(40)], "k long, y long")
    got = common.spread_join(rows, 4_002, "k", lookup)
    want = rows.join(lookup, "k", "left")
    assert collections.Counter(map(tuple, got.select("k", "x", "y").collect())) == collections.Counter(map(tuple, want.select("k", "x", "y").collect()))


def test_star_of_a_hot_centre(spark):
    edges = [(i, 0) for i in range(1, 1_500)] + [(5_000 + i, 4_999) for i in range(1, 300)] + [(5_000, 1)]
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {0, 4_999} - ({4_999} if got[4_999] == 0 else set()) and got[1_200] == 0 and got[5_000] == 0
