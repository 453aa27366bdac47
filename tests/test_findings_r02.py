"""What the review of round 2 found, in small."""

import random
import re
from itertools import combinations

import duckdb

from quillgraph.operators import conflict, construct, cooccur, intent, parse, resolve, retrieval, runlog

W = "uid string, slot_type string, var_name string, surface string, content_excerpt string, reliability_score double, kg0_entity_id string, artifact_id string, quality string, claim_uid string"
SAID = ["a small red house by the river bank", "one large company from another far country", "Some very old ship without any sails left", "a red house", "ship one", "some very old house by the far country"]


def cross_pairs(rows: list[tuple]) -> set[tuple]:
    """R4 by its definition, pair by pair."""
    words = lambda s: set(re.findall("[a-z0-9]+", s.lower()))
    found = set()
    for a, b in combinations(sorted(rows), 2):
        s, t = a[3].lower(), b[3].lower()
        short = len(s.split()) <= 4 and len(t.split()) <= 4
        fit = s in t or t in s or short or len(words(s) & words(t)) / len(words(s) | words(t)) >= 0.5
        if a[6] and a[6] == b[6] and a[8] == b[8] == "GROUNDED" and a[7] != b[7] and not fit and all(not x or not y or x == y for x, y in ((a[1], b[1]), (a[2], b[2]))):
            found.add((a[0], b[0], round(min((a[5] + b[5]) / 2 * 0.8, 1.0), 9), a[0] if a[5] <= b[5] else b[0]))
    return found


def test_cross_artifact_pairs_of_dealt_groups(spark, monkeypatch):
    monkeypatch.setattr(conflict, "DEALT", 20)
    pick = random.Random(7).choice
    rows = [(f"w{i}", pick(["", "WHO", "WHAT"]), pick(["", "A", "B"]), pick(SAID), "", pick([0.2, 0.5, 0.9]), pick(["k1", "k1", "k2", ""]), pick(["a1", "a2", "a3"]), pick(["GROUNDED", "GROUNDED", "INFERRED"]), "c") for i in range(240)]
    within, without = conflict.cross_artifact(conflict.usable(spark.createDataFrame(rows, W)))
    got = [(r.uid_a, r.uid_b, round(r.confidence, 9), r.weaker_uid) for r in within.unionByName(without).collect()]
    assert len(got) == len(set(got)) and set(got) == cross_pairs(rows)


def test_opening_words_are_no_names(spark):
    asked = ["Did Acme Corp pay?", "Were Jane Doe and Acme Corp paid? Has Beta Works?", "Who paid Will Smith?", "Did Acme pay?"]
    got = intent.parsed(spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")).orderBy("i").collect()
    assert [r.entities for r in got] == [["Acme Corp"], ["Acme Corp", "Beta Works", "Jane Doe"], ["Will Smith"], []]


def test_relevance_can_leave_the_years_of_texts_out(spark):
    c = spark.createDataFrame([(1, "what that report of 1960 said", "EN", "2005")], "doc_id int, text string, family string, date string")
    scored = lambda **kw: retrieval.relevance(c, [["that"]], ["the"], ["in"], ["EN"], 2000, 2010, **kw).first().time_score
    assert (scored(), scored(text_years=False)) == (-1.25, 0.75)


def test_long_chains_are_merged_whole(spark):
    s = spark.range(1200).selectExpr("id % 2 AS g", "id AS k")
    links = cooccur.chained(s, "g", "k", "same", most=None)
    assert links.count() == 1198 and cooccur.chained(s, "g", "k", "same").count() == 1000
    kept = resolve.keepers(links.selectExpr("src AS id1", "dst AS id2"), s.selectExpr("k AS id", "1 AS degree"))
    assert {(r.dup, r.keeper) for r in kept.collect()} == {(k, k % 2) for k in range(2, 1200)}


def test_margins_are_rounded_by_their_value(spark):
    # Written with a half after the fourth digit, which their binary values times 10 000 do not all have; of these 300, 18 were rounded otherwise than by the SQL.
    values = [i / 1e5 for i in range(5, 3000, 10)]
    got = {r.uid: r.margin for r in construct.sensitivity(spark.createDataFrame([(str(i), v) for i, v in enumerate(values)], "uid string, confidence double"), 0.0).collect()}
    want = duckdb.execute("SELECT list(round(v, 4)) FROM (SELECT unnest(?) AS v)", [values]).fetchone()[0]
    assert [got[str(i)] for i in range(len(values))] == want


def test_known_terms_are_not_gathered(spark):
    edges = spark.createDataFrame([("red",), ("Blue Fox",), ("zz",)], "term_1 string")
    known = spark.createDataFrame([("a Red house", "late", 9), ("A RED HOUSE", "first", 2), ("reddish", "mid", 5), ("blue fox", "fox", 1)], "term string, category string, seq int")
    out = parse.edge_category(edges, known)
    assert {(r.term_1, r.category) for r in out.collect()} == {("red", "first"), ("Blue Fox", "fox"), ("zz", None)}
    assert "Broadcast" not in out._jdf.queryExecution().sparkPlan().toString()


def test_related_runs_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(runlog, "DEALT", 5)
    pick = random.Random(3).choice
    runs = [(i, pick(["q1", "q2", "q3", None]), pick(["s1", "s2", None]), pick([None, None, i - 1, i + 1, 99])) for i in range(40)]
    want: dict = {}
    for a in runs:
        for b in runs:
            for why, at in (("question", 1), ("scope", 2)):
                if a[0] != b[0] and a[at] is not None and a[at] == b[at]:
                    want.setdefault((a[0], b[0]), set()).add(why)
        if a[3] is not None:
            want.setdefault((a[0], a[3]), set()).add("lineage")
            want.setdefault((a[3], a[0]), set()).add("lineage")
    want = sorted((*k, ",".join(sorted(v))) for k, v in want.items())
    schema = "run_id int, question string, scope_id string, parent_id int"
    out = runlog.related(spark.createDataFrame(runs, schema))
    assert sorted(map(tuple, out.collect())) == want
    assert "collect_set" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, runlog.related(spark.createDataFrame([*runs, *runs[:3]], schema)).collect())) == want


def test_slots_of_one_entity_do_not_meet(spark):
    rows = [(f"w{i}", f"s{i // 2}", "V", SAID[i % 2], "", 0.5, "k", f"a{i % 2}", "GROUNDED", "c") for i in range(20)]
    within, _ = conflict.cross_artifact(conflict.usable(spark.createDataFrame(rows, W)))
    assert within.count() == 10
    joins = [x for x in within._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in x]
    assert len(joins) == 1 and "slot_type" in joins[0]
