"""The pipeline's stages against brute force on the smallest tables."""

import collections

import corpus_pipeline as pipe
from quillgraph.llm import queries
from quillgraph.llm.common import settled, table

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark):
    docs = table(spark, FOLDER, "documents")
    outputs = []
    for name, stage in pipe.STAGES:
        docs = settled(stage(spark, docs, FOLDER), f"test-{name}")
        outputs.append({r.doc_id: r for r in docs.collect()})
        if name != "mix":
            assert docs.columns == COLUMNS
    start = {r.doc_id: r for r in table(spark, FOLDER, "documents").collect()}
    labels = {r.doc_id: r.quality for r in table(spark, FOLDER, "labels").collect()}
    good, single, cut, clean, mixed = outputs
    assert set(mixed) <= set(clean) <= set(cut) <= set(single) <= set(good) <= set(start)
    kept = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in kept) >= 0.97 * len(kept)

    texts = {i: r.text.split() for i, r in single.items()}
    first = {}
    for i in sorted(texts):
        for p in range(len(texts[i]) - 49):
            first.setdefault(tuple(texts[i][p : p + 50]), i)
    for i, w in texts.items():
        gone = [False] * len(w)
        for p in range(len(w) - 49):
            if first[tuple(w[p : p + 50])] < i:
                gone[p : p + 50] = [True] * 50
        left = [x for x, g in zip(w, gone, strict=True) if not g]
        assert (i in cut) == bool(left or not any(gone))
        if i in cut:
            assert cut[i].text.split() == left and (any(gone) or cut[i].text == single[i].text)

    shingles = lambda w: collections.Counter(tuple(w[p : p + 5]) for p in range(len(w) - 4))
    items = [r.text.lower().split() for r in table(spark, FOLDER, "benchmark").collect()]
    for i, r in cut.items():
        w = r.text.lower().split()
        own, leaked = shingles(w), False
        for v in items:
            c, m = shingles(v), len(v) - 4
            if sum((own & c).values()) >= 0.88 * m:
                leaked |= any((b := sum((shingles(w[s : s + len(v)]) & c).values())) / (2 * m - b) >= 0.8 for s in range(len(w) - len(v) + 1))
        assert (i in clean) == (not leaked)
    assert all(0 < r.taken <= 3 * r["size"] for r in mixed.values())


def test_run_and_queries(spark):
    assert pipe.run(spark, FOLDER).count() > 0
    assert pipe.ORACLE_SQL is None
    assert {int(k[2:].split("_")[0]) for k in queries.QUERIES} == set(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)
