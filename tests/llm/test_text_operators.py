"""Operators on texts against brute force on small tables, with nulls, empties, repeats, clashing columns and empty tables."""

import base64
import collections
import hashlib
import math
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from quillgraph.llm import common, decontaminate, hmm_lm, html_text, language_id, learned_ann, mixing, quality_fm, simhash_dedup, substring_dedup, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark, texts, lang="en", source="s"):
    return spark.createDataFrame([(i, x, lang, source, len(x) if x is not None else None) for i, x in texts], DOC)


def prose(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


# --- shared helpers


def test_hashed_words_follow_split():
    texts = [b" a b\tcc\n", b"", b"\x0b", "é ü".encode(), b"a b", b"x" * 5000 + b" a"]
    h, n, endings = common.hashed_words(texts, True)
    assert n.tolist() == [len(t.split()) for t in texts]
    names = [w for t in texts for w in t.split()]
    assert len({(a, b) for a, b in zip(h.tolist(), names, strict=True)}) == len(set(names)) == len(set(h.tolist()))
    assert endings[0] == ord("a") * 256


def test_hash_index():
    keys = np.unique(np.random.default_rng(1).integers(1, 2**63, 5000).astype(np.uint64) * np.uint64(2))
    index = common.HashIndex(keys)
    assert (index.find(keys) == np.arange(len(keys))).all() and (index.find(keys + np.uint64(1)) == -1).all()


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, 5)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.node: r.component for r in common.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for e in edges if e[0] != e[1] for x in e}
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).isEmpty()


# --- 1 html


PAGE = "<html><head><title>T</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class='cookie-notice'>We use cookies</div>%s<aside>More</aside><form><input> Join</form><footer>&copy; X</footer></body></html>"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (None, ""),
        ("", ""),
        ("just text", "just text"),
        (PAGE % "<article><h1>Head</h1><p>One &amp; two  <b>bold</b>.<p>Three<br>four &#233;</article>", "Head\nOne & two bold.\nThree four é"),
        (PAGE % "<article><h1>Head</h1><p>Body text is here.</p><div class='comments'><p>I disagree</p></div><script>var a='<p>no</p>'</script></article>", "Head\nBody text is here."),
        (PAGE % ("<div id='content'>" + "<p>A long paragraph with many words, and then some more of them.</p>" * 3 + "</div>"), "\n".join(["A long paragraph with many words, and then some more of them."] * 3)),
        (PAGE % "<main><ul><li>First item<li>Second item</ul><table><tr><td>a<td>b</table></main>", "First item\nSecond item\na\nb"),
        ("<body><article><p>cut off in a refer&am", "cut off in a refer&am"),
        ("<body><article><p>cut off in a tag <b cla", "cut off in a tag"),
        (PAGE % "<article><p>x<style>p{}</style>y</p><!-- hidden --><p hidden>no</p></article>", "xy"),
    ],
)
def test_main_text(html, want):
    assert html_text.main_text(html) == want


def test_extract_keeps_rows(spark):
    rows = [(1, "u", "<p>é</p>", "clash"), (1, "u", "<p>é</p>", "clash"), (2, None, None, None), (None, "v", "<p>" + "x " * 50_000 + "</p>", "z")]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 99_999), (1, 1), (1, 1), (2, 0)]
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).isEmpty()


# --- 2 language model


def test_language_model(spark):
    rng = random.Random(2)
    texts = [(i, prose(rng, rng.randrange(60), 30) if i % 2 else " ".join(f"Z{rng.randrange(30)}" for _ in range(rng.randrange(60)))) for i in range(80)] + [(80, None), (81, ""), (3, "w1 unseen"), (None, "w1 w2")]
    docs = spark.createDataFrame([(i, x, (i or 0) % 7 == 2, "clash") for i, x in texts], "doc_id long, text string, held_out boolean, score string")
    got = hmm_lm.score(docs.drop("score"), rounds=1).collect()
    counts = collections.Counter()
    for i, x in texts:
        if (i or 0) % 7 != 2:
            counts.update([*(x or "").encode().lower().split(), "end"])
    n, v = sum(counts.values()), len(counts)
    want = sorted((i or -1, len((x or "").split()) + 1, sum(counts[w] > 0 for w in [*(x or "").encode().lower().split(), "end"]), round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in [*(x or "").encode().lower().split(), "end"]), 6)) for i, x in texts)
    assert sorted((r.doc_id or -1, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {n}
    assert sum(r.score for r in got) > sum(r.base_score for r in got)


def test_forward_and_expected_counts_against_plain_sums():
    rng = np.random.default_rng(0)
    k = 3
    norm = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm_lm.Hmm(norm(rng.random(k)), norm(rng.random(k)), norm(rng.random((k, k))), norm(rng.random((hmm_lm.SIZE, k)).T).T)
    seqs = [np.array([1, 5, 2], np.uint16), np.array([7], np.uint16), np.array([3, 3, 9, 1], np.uint16)]
    import itertools

    def paths(x, start):
        for p in itertools.product(range(k), repeat=len(x)):
            yield p, start[p[0]] * np.prod([model.move[a, b] for a, b in itertools.pairwise(p)]) * np.prod([model.emit[s, q] for s, q in zip(x, p, strict=True)])

    want = [math.log10(sum(v for _, v in paths(x, model.start))) for x in seqs]
    assert np.allclose(model.forward(seqs), want)
    opens = np.array([True, False, True])
    start, again, moved, emitted = model.expected(seqs, opens)
    s, g, m, e = np.zeros(k), np.zeros(k), np.zeros((k, k)), np.zeros((hmm_lm.SIZE, k))
    for x, o in zip(seqs, opens, strict=True):
        every = list(paths(x, model.start if o else model.again))
        z = sum(v for _, v in every)
        for p, v in every:
            (s if o else g)[p[0]] += v / z
            for a, b in itertools.pairwise(p):
                m[a, b] += v / z
            for w, q in zip(x, p, strict=True):
                e[w, q] += v / z
    assert np.allclose(start, s) and np.allclose(again, g) and np.allclose(moved, m) and np.allclose(emitted, e)


# --- 3 substrings


def test_substrings(spark):
    rng = random.Random(3)
    passage, other = prose(rng, 30), prose(rng, 14)
    texts = []
    for i in range(60):
        x = prose(rng, rng.randrange(40))
        if i % 3 == 0:
            cut = rng.randrange(25)
            x = f"{x} {' '.join(passage.split()[cut:])} {prose(rng, 3)}"
        if i % 7 == 0:
            x = f"{other} {x} {other}"
        texts.append((i, x))
    texts += [(70, texts[3][1]), (71, texts[3][1] + " tail"), (72, None), (73, ""), (74, "same " * 300), (75, "same " * 200), (3, texts[6][1])]
    docs = documents(spark, texts).withColumn("kept", F.lit("clash")).unionByName(documents(spark, [(None, texts[3][1])]).withColumn("kept", F.lit("x")))
    size = 10
    first = {}
    for i, x in texts:
        w = (x or "").split()
        for p in range(len(w) - size + 1):
            key = tuple(w[p : p + size])
            first[key] = min(first.get(key, i), i)

    def kept(i, x):
        w = (x or "").split()
        gone = [False] * len(w)
        for p in range(len(w) - size + 1):
            if first[tuple(w[p : p + size])] < i:
                gone[p : p + size] = [True] * size
        return i, len(w), sum(gone), " ".join(a for a, g in zip(w, gone, strict=True) if not g)

    got = substring_dedup.remove_repeats(docs, window=size, anchor=3).collect()
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got if r.doc_id is not None) == sorted(kept(i, x) for i, x in texts)
    assert [r.n_removed for r in got if r.doc_id is None] == [0]
    assert substring_dedup.remove_repeats(documents(spark, [])).isEmpty()


# --- 4 quality


def test_quality(spark):
    rng = random.Random(5)
    good = [(i, prose(rng, 60) + ".") for i in range(150)]
    bad = [(i, " ".join(f"W{rng.randrange(99)}!!" for _ in range(60)).upper()) for i in range(150, 300)]
    docs = documents(spark, good + bad + [(300, None), (301, ""), (302, "x " * 30_000)]).withColumn("score", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i < 150), 0) for i in range(300)] + [(0, None, 0), (None, 1, 0), (5, 1, 1)], "doc_id long, quality int, toxic int")
    model = quality_fm.train(docs, labels, F.col("doc_id") % 5 != 0)
    got = {r.doc_id: r for r in quality_fm.score(docs, model).collect()}
    held = [i for i in range(300) if i % 5 == 0]
    assert sum((got[i].score >= 0.3) == (i < 150) for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values()) and len(got) == 303 and "lang" in got[0].asDict()
    none = quality_fm.train(docs, labels.where("FALSE"), F.lit(True))
    assert {r.score for r in quality_fm.score(docs, none).collect()} == {0.5}
    assert quality_fm.score(documents(spark, []), model).isEmpty()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(1)
    n = 1 << quality_fm.BITS
    model = quality_fm.Model(0.1, rng.normal(0, 0.1, n + quality_fm.STATS).astype(np.float32), rng.normal(0, 0.1, (n + quality_fm.STATS, quality_fm.RANK)).astype(np.float32), np.zeros(quality_fm.STATS), np.ones(quality_fm.STATS))
    stats, ids = rng.normal(size=(1, quality_fm.STATS)), np.array([4, 9, 4], np.int32)
    x = [(int(i), 1.0) for i in ids] + [(n + j, float(np.clip(stats[0, j], -4, 4))) for j in range(quality_fm.STATS)]
    total = 0.1 + sum(model.w[i] * v for i, v in x) + sum(float(model.v[i] @ model.v[j]) * a * b for p, (i, a) in enumerate(x) for j, b in x[p + 1 :])
    assert model.scores(stats, np.array([3]), ids)[0] == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-5)


# --- 5 language


def test_language(spark):
    rng = random.Random(6)
    word = {"en": lambda: rng.choice(["the", "thing", "with", "ingthe", "ender"]), "fr": lambda: rng.choice(["eau", "leque", "oui", "étre", "quoi"]), "ru": lambda: rng.choice(["это", "слово", "мир", "дом"])}
    make = lambda lang, n: " ".join(word[lang]() for _ in range(n))
    rows = [(i, make(lang, 30), lang) for i, lang in enumerate(["en", "fr", "ru"] * 30)]
    rows += [(90, make("en", 40) + " " + make("ru", 20), "en"), (91, None, "fr"), (92, "", "fr"), (93, "12 34 !!", "en"), (94, make("fr", 20_000), None), (0, rows[0][1], "en"), (None, make("en", 9), "en")]
    docs = spark.createDataFrame([(i, x, lang, "clash") for i, x, lang in rows], "doc_id long, text string, lang string, score string")
    model = language_id.train(docs, F.col("doc_id") % 4 != 1)
    got = language_id.identify(docs, model).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].lang_pred == lang for i, _, lang in rows[:90])
    assert [by[i].lang_pred for i in (90, 91, 92, 93, 94)] == ["en", "und", "und", "und", "fr"]
    assert [(s.lang, s.words) for s in by[90].spans] == [("en", 40), ("ru", 20)]
    assert {r.lang_pred for r in language_id.identify(docs, language_id.train(docs, F.lit(False))).collect()} == {"und"}


# --- 6 simhash


def simhash(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [b" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def linked(prints):
    parent = list(range(len(prints)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 4:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(7)
    base = prose(rng, 300).split()
    texts = [prose(rng, rng.randrange(50)) for _ in range(60)] + [None, "", "one two", "ONE two"]
    for _ in range(60):
        w = list(base)
        w[rng.randrange(300)] = "changed"
        texts.append(" ".join(w))
    rows = list(enumerate(texts))
    want = [simhash(x) for x in texts]
    root = linked(want)
    for crowd in (64, 2):  # a crowd of two sends the copies through the full balls
        got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash_dedup.near_duplicates(documents(spark, rows).withColumn("fp", F.lit(1)), crowd=crowd).collect()}
        assert got == {i: (want[i], root[i]) for i, _ in rows}
    kept = simhash_dedup.deduplicate(documents(spark, [*rows, (0, texts[0]), (None, "a")]))
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(set(root)) and kept.where("doc_id IS NULL").count() == 1
    assert simhash_dedup.near_duplicates(documents(spark, [])).isEmpty()


def test_links_of_dense_fingerprints(spark):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    prints = sorted({centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(7))) for _ in range(250)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    nodes = spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, id long")
    found = {r.node: r.component for r in common.connected_components(simhash_dedup.links(nodes, crowd=8)).collect()}
    assert [found.get(i, i) for i in range(len(prints))] == linked(prints)


# --- 7 mixing


def lague(votes, seats):
    won = [0] * len(votes)
    for _ in range(seats):
        best = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[best] += 1
    return won


def test_sainte_lague(spark):
    rng = random.Random(9)
    for _ in range(4):
        votes, seats = [rng.randrange(1, 3000) for _ in range(rng.randrange(1, 40))], rng.randrange(1, 300)
        df = spark.createDataFrame([(i, float(v), seats) for i, v in enumerate(votes)], "k long, votes double, total long")
        got = {r.k: r.seats for r in mixing.sainte_lague(df.withColumn("g", F.lit(0)), "g", "k", buckets=7).collect()}
        assert [got.get(i, 0) for i in range(len(votes))] == lague(votes, seats)


def test_targets(spark):
    sizes = {"a": 10, "b": 5000, "c": 40, None: 300}
    got = {r.source: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    total, weights, target, full = sum(sizes.values()), {"a": 5, "b": 2, "c": 1, None: 5}, {}, set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        target = {s: 3 * sizes[s] if s in full else rest * weights[s] / sum(w for x, w in weights.items() if x not in full) for s in sizes}
        over = {s for s in sizes if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    assert all(got[s].target == pytest.approx(target[s]) for s in sizes)


def test_mix(spark):
    rng = random.Random(10)
    rows = [(i, prose(rng, rng.randrange(200)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(300)] + [(300, None, "en", "a", 0), (5, "w w", "en", "a", 0), (None, "x y", "en", "b", 0), (301, "z " * 9000, "en", "c", 0)]
    docs = spark.createDataFrame(rows, DOC).withColumn("taken", F.lit("clash"))
    got = mixing.mix(docs, shard_words=4096).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r["size"] for r in got)
    for s in ("a", "b", "c", None):
        part = [r for r in got if r.source == s]
        assert sum(r["size"] for r in part) == part[0].source_size
        assert abs(sum(r.taken for r in part) - part[0].target) <= 32
    key = lambda r: (r.doc_id if r.doc_id is not None else -1, r["size"], r.taken)
    assert sorted(map(key, mixing.mix(docs.repartition(7), shard_words=4096).collect())) == sorted(map(key, got))
    assert mixing.mix(documents(spark, [])).isEmpty()


# --- 8 decontamination


def test_decontamination(spark):
    rng = random.Random(11)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([14, 25, 40, 59, 30])] + [(5, "tiny item here"), (6, None), (7, ""), (8, None), (None, "a b c d e f g")]
    items.append((9, items[2][1]))
    texts = []
    for i in range(120):
        n, w = rng.randrange(5), None
        w = items[n][1].split()
        for _ in range(rng.randrange(6)):
            w[rng.randrange(len(w))] = rng.choice(["x", "y", w[0]])
        if rng.random() < 0.3:
            cut = rng.randrange(len(w))
            w = w[cut:] + w[:cut]
        texts.append((i, f"{prose(rng, rng.randrange(30), 3000)} {' '.join(w).upper() if i % 9 == 0 else ' '.join(w)}\n{prose(rng, rng.randrange(30), 3000)}"))
    texts += [(200, None), (201, ""), (202, "the tiny item here it is"), (203, " \t"), (204, "tiny item"), (None, items[1][1])]
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start) for r in decontaminate.matches(documents(spark, texts).withColumn("size", F.lit("clash")), spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = {}
    for d, x in texts:
        w = (x or "").lower().split()
        for i, y in items:
            v = (y or "").lower().split()
            if d is None or i is None or not v or len(w) < len(v):
                continue
            k = min(5, len(v))
            cut = lambda z: collections.Counter(tuple(z[p : p + k]) for p in range(len(z) - k + 1))  # noqa: E731, B023
            m, c = len(v) - k + 1, cut(v)
            scores = [sum((cut(w[s : s + len(v)]) & c).values()) for s in range(len(w) - len(v) + 1)]
            best = max(range(len(scores)), key=lambda s: (scores[s], -s))
            if scores[best] / (2 * m - scores[best]) >= 0.8 - 1e-12:
                want[d, i] = (round(scores[best] / (2 * m - scores[best]), 9), best)
    assert got == want and len(want) > 20
    clean = decontaminate.clean(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect() if r.doc_id is not None) == sorted({d for d, _ in texts if d is not None} - {d for d, _ in want})
    assert decontaminate.matches(documents(spark, texts), spark.createDataFrame([], "item_id long, text string")).isEmpty()
    assert decontaminate.matches(documents(spark, []), spark.createDataFrame(items, "item_id long, text string")).isEmpty()


def test_decontamination_of_documents_shorter_than_items(spark):
    rng = random.Random(13)
    items = [(i, prose(rng, n, 3000)) for i, n in enumerate([16, 25, 40, 9, 14, 60])] + [(6, " ".join(["a b c d e"] * 4))]
    texts = []
    for i, y in items:
        v = y.split()
        for cut in range(1, len(v) // 4 + 2):
            changed = [rng.choice(["x", v[0]]) if rng.random() < 0.03 else w for w in v]
            texts += [(len(texts) + k, " ".join(w)) for k, w in enumerate([v[:-cut], v[cut:], v[cut // 2 : len(v) - (cut - cut // 2)], changed[:-cut]])]
    assert all(len(x.split()) < 60 for _, x in texts)
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.n_words) for r in decontaminate.matches(documents(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect() if len(texts[r.doc_id][1].split()) < len(items[r.item_id][1].split())}
    shingles = lambda z: collections.Counter(tuple(z[p : p + 5]) for p in range(len(z) - 4))
    want = {}
    for d, x in texts:
        for i, y in items:
            w, v = x.split(), y.split()
            if len(w) < len(v):
                a, b = shingles(w), shingles(v)
                both = sum((a & b).values())
                if both / (a.total() + b.total() - both) >= 0.8 - 1e-12:
                    want[d, i] = (round(both / (a.total() + b.total() - both), 9), 0, len(w))
    assert got == want and len(want) > 20
    assert want[0, 0][0] == round(11 / 12, 9)


# --- 9 warc


def test_warc(spark):
    big = "é<p>" + "0123456789" * 9000
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://c/\r\nX: y", big), (4, "u", big), (5, "u", None), (6, "u", ""), (7, "u", "a\r\n\r\nWARC/1.1\r\n\r\n"), (1, "http://a/", "x"), (8, "u", "y" * 16_384), (3, "u", "second of three"), (None, "u", "nobody")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.warc_round_trip(spark, pages, segment_bytes=1000).collect()
    bytes_ = lambda h: (h or "").encode()
    first = {}
    for i, _, h in rows:
        first[bytes_(h)] = min([x for x in (first.get(bytes_(h)), i) if x is not None], default=None)
    want = []
    for i, _, h in rows:
        b = bytes_(h)
        want.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert {r.status for r in got} == {"whole"}
    assert warc.warc_round_trip(spark, pages.where("FALSE")).isEmpty()
    none = warc.warc_round_trip(spark, pages.where("page_id IN (1, 2)"), min_revisit_bytes=2).collect()
    assert {r.record_type for r in none} == {"response"}


def test_broken_archives(spark, tmp_path):
    page = (1, "u", "z" * 5000, "D", 1)
    records = list(warc.records_of(page[0], page[1], page[2].encode(), page[3], page[4], 1000))
    whole = b"".join(r + b"\r\n\r\n" for r in records)
    lost = b"".join(r + b"\r\n\r\n" for i, r in enumerate(records) if i != 2)
    short = b"".join(r + b"\r\n\r\n" for r in records[:-1])
    for name, raw in (("a", whole), ("b", lost), ("c", short), ("d", whole[:-700])):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.warc").write_bytes(raw)
        got = warc.read_archives(spark, str(tmp_path / name)).collect()
        assert [(r.status, r.payload is not None) for r in got] == [("whole", True) if name == "a" else ("incomplete", False)]
    assert warc.dechunked(b"3\r\nabc\r\n0\r\n\r\n") == b"abc" and warc.dechunked(b"3\r\nab") is None and warc.dechunked(b"x\r\n") is None


# --- 10 neighbours


def exact(rows, i, k):
    q = np.array(dict(rows)[i], float)
    out = []
    for j, v in rows:
        x = np.array(v, float)
        if j != i:
            out.append((-float(x @ q / (np.linalg.norm(x) * np.linalg.norm(q))), j))
    return [j for _, j in sorted(out)[:k]]


def test_neighbours(spark):
    rng = np.random.default_rng(12)
    centres = rng.normal(size=(30, 16))
    rows = [(i, (centres[i % 30] + 0.4 * rng.normal(size=16)).astype(np.float32).tolist()) for i in range(2500)]
    odd = [(9000, None), (9050, [0.0] * 16), (9100, [float("nan")] * 16), (9150, [1.0] * 15 + [None]), (9200, [1.0, 2.0]), (9250, [float("inf")] + [1.0] * 15), (None, rows[0][1])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows + odd], "vec_id long, embedding array<float>, label int")
    got = collections.defaultdict(list)
    for r in learned_ann.nearest(df, F.col("vec_id") % 50 == 0, sample_rows=1500, part_rows=200, block_rows=64).collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    queries = [i for i, _ in rows if i % 50 == 0]
    assert sorted(got) == queries and all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in got.values())
    hits = sum(len(set(exact(rows, i, 5)) & {x[1] for x in got[i]}) for i in queries)
    assert hits >= 0.9 * 5 * len(queries)


def test_few_and_equal_neighbours(spark):
    same = [(i, [1.0, 2.0, 3.0]) for i in range(100, 400)]
    df = spark.createDataFrame(same, "vec_id long, embedding array<double>")
    got = learned_ann.nearest(df, F.col("vec_id") == 100, block_rows=16).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [101, 102, 103, 104, 105] and all(r.score == pytest.approx(1.0) for r in got)
    few = learned_ann.nearest(df.where("vec_id < 103"), F.col("vec_id") == 100).collect()
    assert len(few) == 2
    assert learned_ann.nearest(df.where("FALSE"), F.lit(True)).isEmpty()


def test_nearest_takes_repeated_ids_as_rows(spark):
    angles = [(0, 0.0), *[(1, 0.01 * i) for i in range(1, 4)], (2, 0.2), (2, 0.21), (3, 0.3), (4, 0.4), (0, 0.05)]
    rows = [(i, [float(np.cos(a)), float(np.sin(a))], "clash") for i, a in angles] + [(50, [1.0, 0.0, 0.0], "c"), (51, [2.0, 0.1, 0.0], "c")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string")
    got = collections.defaultdict(list)
    for r in learned_ann.nearest(df, F.col("vec_id") % 50 == 0, k=5).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    own = lambda at: sorted(((i, round(float(np.cos(a - at)), 9)) for i, a in angles if a != at), key=lambda x: (-x[1], x[0]))[:5]
    assert sorted(got[0]) == sorted(own(0.0) + own(0.05))
    assert got[50] == [(51, round(2 / math.hypot(2, 0.1), 9))]  # of its own length only


def test_neighbours_of_copies_and_of_many_levels(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(12, 8))
    rows = [(i, (centres[i % 12] + 0.5 * rng.normal(size=8)).tolist()) for i in range(1200)] + [(i, [1.0] * 8) for i in range(1200, 1800)]
    got = collections.defaultdict(list)
    old, learned_ann.FANOUT = learned_ann.FANOUT, 4
    try:
        for r in learned_ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 50 == 0, sample_rows=400, part_rows=64, leaf_rows=100, block_rows=50).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
    finally:
        learned_ann.FANOUT = old
    queries = [i for i, _ in rows if i % 50 == 0]
    assert sorted(got) == queries and all(len(v) == 5 for v in got.values())
    assert got[1250] == [1200, 1201, 1202, 1203, 1204] and got[1200] == [1201, 1202, 1203, 1204, 1205]
    hits = sum(len(set(exact(rows, i, 5)) & set(got[i])) for i in queries if i < 1200)
    assert hits >= 0.9 * 5 * 24


def test_wrappers_of_the_article_are_not_boilerplate():
    text = " ".join(["The article is told in many plain words."] * 6)
    side = "<div class='sidebar'><p>Elsewhere on this site</p></div>"
    for name in ["content with-sidebar", "page no-sidebar", "site has-header", "layout-right-rail", "entry-content share"]:
        for inner in [f"<article><p>{text}</p></article>", f"<main><p>{text}</p></main>", f"<p>{text}</p><p>{text}</p>"]:
            got = html_text.main_text(f"<html><body><div class='{name}'>{inner}{side}</div><div class='footer'>About us</div></body></html>")
            assert text in got and "Elsewhere" not in got and "About" not in got, (name, inner)
    page = f"<body><div><p>{text}</p></div><div class='comments'><p>{'I do not agree. ' * 200}</p></div><div class='related'><article><p>Teaser</p></article></div></body>"
    assert html_text.main_text(page) == text
    held = html_text.main_text(f"<article><p>{text}</p><figure><figcaption>A view of the town</figcaption></figure><fieldset>Set <label>of words</label></fieldset></article>")
    assert held.split("\n") == [text, "A view of the town", "Set of words"]
