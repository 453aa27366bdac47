"""Micro fixtures with values computed from the definitions."""

import uuid

import pytest
from pyspark.sql import functions as F

from quillgraph.functions import dates, ids, scores, structs
from quillgraph.functions import text as t


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def lit(x):
    return F.lit(x).cast("string") if x is None else F.lit(x)


CASES = [
    (lambda: ids.sha_id("doc_strong", F.lit("d1")), "4b8338ad8ef6"),
    (lambda: ids.sha_id("page_strong", F.lit("d1"), F.lit("0")), "9d25f69bae83"),
    (lambda: ids.sha_id("collection_strong", F.lit("coll a")), "7c3a0083a286"),
    (lambda: ids.sha_id("entity_weak", F.lit("Organization"), F.lit("office of inspector general")), "14d690ebdd4a"),
    (lambda: ids.uuid5(uuid.NAMESPACE_DNS, F.lit("héllo")), str(uuid.uuid5(uuid.NAMESPACE_DNS, "héllo"))),
    (lambda: t.to_label(F.lit("medical condition")), "MedicalCondition"),
    (lambda: t.to_label(F.lit("3d print")), "N3dPrint"),
    (lambda: t.to_label(F.lit("document")), "DocumentEntity"),
    (lambda: t.to_label(F.lit("")), None),
    (lambda: t.slug(F.lit("  works for / at ")), "WORKS_FOR_AT"),
    (lambda: t.slug(F.lit("--")), "RELATED_TO"),
    (lambda: t.canonical_term(F.lit("Office of Inspector General || OIG")), "Office of Inspector General"),
    (lambda: t.abbreviation(F.lit("Office of Inspector General || OIG")), "OIG"),
    (lambda: t.match_key(F.lit("The Office-of  Inspector General")), "office of inspector general"),
    (lambda: t.person_key(F.lit("Polster, Natasha")), "natasha polster"),
    (lambda: t.person_key(F.lit("Natasha Polster, M.D., Ph.D.")), "natasha polster"),
    (lambda: t.person_key(F.lit("Zoë Ünal")), "zoe unal"),
    (lambda: t.last_name(F.lit("tasha polster")), "polster"),
    (lambda: t.organisation_key(F.lit("Acme Labs, Inc.")), "acme labs"),
    (lambda: t.location_key(F.lit("Ohio (OH)")), "ohio"),
    (lambda: t.surface_tokens(F.lit("Policies and a Trucks")), ["and", "policies", "policy", "truck", "trucks"]),
    (lambda: t.condition(F.lit("Posttraumatic-Stress  disorder!")), "post traumatic stress disorder"),
    (lambda: t.person_variants(F.lit("Doe, Jane")), ["doe jane", "jane doe"]),
    (lambda: t.is_filename(F.lit("plan v2.docx")), True),
    (lambda: t.context(F.lit("x" * 60 + "NEEDLE" + "y" * 60), F.lit(60), F.lit(66)), "x" * 48 + "needle" + "y" * 48),
    (lambda: t.link_hints(F.lit("Chief Risk Officers")), ["chief risk officers", "risk officers", "chief risk", "officers", "officer", "chief", "risk"]),
    (lambda: t.jaccard(t.tokens(F.lit("funded research")), t.tokens(F.lit("never funded health research"))), 0.5),
    (lambda: t.jaccard(t.tokens(F.lit("")), t.tokens(F.lit(""))), 0.0),
    (lambda: t.overlap(t.tokens(F.lit("a b")), t.tokens(F.lit("b c d"))), 0.5),
    (lambda: t.similar(F.lit("acme corp"), F.lit("acme"), 0.9), True),
    (lambda: t.similar(F.lit("red house"), F.lit("blue moon"), 0.5), False),
    (lambda: t.negation(F.lit("The company did not fund research"), F.lit("fund research")), "did not"),
    (lambda: t.negation(F.lit("They funded not only research, and did not fund research"), F.lit("fund research")), None),
    (lambda: t.document_ids(F.lit("see zlcx0257, abc123 and zlcx0257")), ["zlcx0257", "abc123"]),
    (lambda: t.looks_like_id(F.lit("zlcx0257")), True),
    (lambda: t.looks_like_id(F.lit("Walgreens")), False),
    (lambda: t.looks_like_person(F.lit("Jane Q. Doe")), True),
    (lambda: t.looks_like_person(F.lit("Good Faith")), False),
    (lambda: t.or_query(F.array(F.lit("a b"), F.lit(""), F.lit("c"))), '"a b" OR c'),
    (lambda: t.lower_unique(F.array(F.lit(" A"), F.lit("a"), F.lit("B"))), ["a", "b"]),
    (lambda: t.expanded(F.array(F.lit("Alpha")), F.array(F.lit("alpha"), F.lit("beta"), F.lit("Beta"))), ["Alpha", "beta"]),
    (lambda: t.paragraphs(F.lit("short\n\nlong enough\nto stay\n\n\nanother paragraph")), ["long enough to stay", "another paragraph"]),
    (lambda: t.occurrences(F.lit("OIG and oig, not oigs; Office of IG"), ["OIG", "office of ig"]), 3),
    (lambda: t.context_overlap(F.array(F.lit("the annual compliance report")), F.array(F.lit("compliance report"))), 1.0),
    (lambda: t.entity_variants(F.lit("Foo  Bar || FB")), ["fb", "foo bar", "foo bar || fb"]),
    (lambda: dates.newest_day(F.lit("2018 January 04; 2019 March 2; junk")), "2019-03-02"),
    (lambda: dates.newest_day(F.lit("no date")), "no date"),
    (lambda: dates.normal(F.lit("2018 March 7")), "2018-03-07"),
    (lambda: dates.normal(F.lit("2018/5/30")), "2018-05-30"),
    (lambda: dates.normal(F.lit("2020-06-01T10:00")), "2020-06-01"),
    (lambda: dates.normal(F.lit("last year")), "last year"),
    (lambda: dates.find_date(F.lit("in June 1994 or 2001")), "June 1994"),
    (lambda: dates.find_day(F.lit("on March 3, 2011")), "March 3, 2011"),
    (lambda: F.abs(dates.months(F.lit("1994")) - dates.months(F.lit("June 1994"))), 0),
    (lambda: dates.in_years(F.lit("no year"), F.lit(2000), F.lit(2001)), None),
    (lambda: dates.in_years(F.lit("in 2003"), F.lit(2000), F.lit(2001)), False),
    (lambda: dates.full_year(F.lit(31)), 1931),
    (lambda: dates.time_score(F.array(F.lit(2005)), F.array(F.lit(1990)), F.lit(2000), F.lit(2010)), -1.25),
    (lambda: dates.constraint("WITHIN", F.lit("2020-01-01"), F.lit("2020-01-20"), 30), True),
    (lambda: dates.constraint("ORDER", F.lit("junk"), F.lit("2020-01-20")), None),
    (lambda: dates.any_format(F.lit("03/04/2020")), "2020-03-04"),
    (lambda: dates.scope_bound(F.lit("2020-01-02"), True), "2020-01-02T23:59:59Z"),
    (lambda: dates.scope_bound(F.lit("soon")), "soon"),
    (lambda: dates.question_range(F.lit("from 2003 to 1999"))[1], "2003-12-31"),
    (lambda: scores.confidence_label(F.lit(0.85)), "HIGH"),
    (lambda: scores.confidence_label(F.lit(0.60)), "MODERATE"),
    (lambda: scores.confidence_label(F.lit(0.35)), "LOW"),
    (lambda: scores.confidence_label(F.lit(0.34)), "VERY LOW"),
    (lambda: scores.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0))), 0.0),
    (lambda: scores.path_confidence(F.lit(0.9), F.lit(0.5), F.lit(2), F.lit(True), F.lit(False), F.lit(False)), 0.726),
    (lambda: scores.default_reliability(F.lit("document"), F.lit("primary"), F.lit("direct-capture")), 0.93),
    (lambda: structs.first_title(F.lit('[{"title": " A "}, {"title": "B"}]')), "A"),
    (lambda: structs.first_title(F.lit("junk")), ""),
    (lambda: structs.merged(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))), {"a": "2", "b": "3"}),
    (lambda: structs.tolerant_json(F.lit('```json\n{"a": [1, 2,],}\n```')), '{"a": [1, 2]}'),
]


def test_micro_fixtures(spark):
    bad = []
    for i, (make, want) in enumerate(CASES):
        got = one(spark, make())
        if got != want and not (isinstance(want, float) and got is not None and abs(got - want) < 1e-9):
            bad.append((i, got, want))
    assert not bad


def test_sequence_ratio(spark):
    assert one(spark, t.sequence_ratio(F.lit("abcd"), F.lit("bcde"))) == pytest.approx(0.75)
    score = t.link_score(F.lit("acme holding"), F.lit("Acme"), t.sequence_ratio(F.lit("acme holding"), F.lit("acme")))
    assert one(spark, score) == pytest.approx(0.45 * 0.5 + 0.35 * 0.5 + 0.20, abs=1e-4)


def test_near_matches(spark):
    found = one(spark, t.near_matches("annual report")(F.lit("the anual report of a@b.c annual report")))
    assert [(r["first"], r["last"]) for r in found] == [(5, 6), (1, 2)]
