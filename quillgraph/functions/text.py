"""Text functions as column expressions; they stay in generated code but for the two similarity functions that are marked."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

# Words without weight in names and their articles.
STOPWORDS = ["the", "a", "an", "of", "for", "in", "to", "and", "or", "by", "on", "at", "with", "from"]
INFRA_LABELS = ["Document", "Collection", "Abbreviation"]
# Endings that do not tell names apart.
ORG_SUFFIX = r"(?i)[,\s]+(?:inc\.?|corp\.?|ltd\.?|llc\.?|llp\.?|plc\.?|gmbh|company|group|holdings?|international|labs?|laboratory|laboratories)\.?$"
CREDENTIAL = r"m\.?d\.?|ph\.?d\.?|r\.?ph\.?|m\.?b\.?a\.?|j\.?d\.?|d\.?o\.?|pharm\.?d\.?|r\.?n\.?|m\.?s\.?|b\.?s\.?|esq\.?|jr\.?|sr\.?|ii|iii|iv|inc\.?"
FILE_ENDING = r"\.(?:docx?|pdf|pptx?|xlsx?|xls|txt)"
# Cues of negation in the order in which they are tried, and what only looks like negation.
NEGATIONS = [r"\bdid not\b", r"\bdoes not\b", r"\bnever\b", r"\bno evidence\b", r"\bdenied\b", r"\bdenies\b", r"\bcontradicts\b", r"\bnot\s+\w+ed\b", r"\bfailed to\b", r"\bno\s+\w+\s+was\b"]
NOT_NEGATIONS = ["not only", "not always", "not necessarily", "not just", "not merely", "not limited to"]
# Words of domain names that a personal name does not hold.
NOT_PERSON = ["target", "drug", "good", "faith", "dispensing", "policy", "checklist", "professional", "judgment"]


def blank(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))



def to_label(col: Column) -> Column:
    """Label of a category: its alphanumeric parts capitalised and joined; null without any."""
    parts = F.filter(F.split(F.trim(col), "[^A-Za-z0-9]+"), lambda x: x != "")
    label = F.array_join(F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substr(x, F.lit(2))))), "")
    label = F.when(label.rlike("^[0-9]"), F.concat(F.lit("N"), label)).otherwise(label)
    return F.when(label.isin(INFRA_LABELS), F.concat(label, F.lit("Entity"))).when(label != "", label)


def labels(top: Column, specific: Column) -> Column:
    """Distinct labels of a row, the top category's first."""
    return F.array_distinct(F.array_compact(F.array(to_label(top), to_label(specific))))


def slug(col: Column) -> Column:
    """Relationship type of a phrase."""
    out = F.upper(F.regexp_replace(F.regexp_replace(F.trim(blank(col)), "[^a-zA-Z0-9]+", "_"), "^_+|_+$", ""))
    return F.when(out == "", F.lit("RELATED_TO")).otherwise(out)


def canonical_term(col: Column) -> Column:
    """What stands before the first ``||``; the whole term if that is empty."""
    whole = F.trim(blank(col))
    head = F.trim(F.regexp_replace(whole, r"(?s)\|\|.*$", ""))
    return F.when(head == "", whole).otherwise(head)


def abbreviation(col: Column) -> Column:
    """What stands after the first ``||``; null if there is none."""
    return F.nullif(F.trim(F.regexp_extract(blank(col), r"(?s)^.*?\|\|(.*)$", 1)), F.lit(""))


def match_key(col: Column) -> Column:
    """Lower case, punctuation as space, one leading article removed."""
    out = F.regexp_replace(F.lower(F.trim(blank(col))), r"[^a-z0-9\s]+", " ")
    return F.regexp_replace(F.trim(F.regexp_replace(out, r"\s+", " ")), "^(?:the|an|a) ", "")


def token_key(col: Column) -> Column:
    """Sorted tokens of the match key without stop words, as an array."""
    return F.array_sort(F.filter(F.split(match_key(col), " "), lambda x: (x != "") & ~x.isin(STOPWORDS)))


def substantive(tokens: Column) -> Column:
    """Two tokens that are no numbers, or one of five letters or more."""
    words = F.filter(F.array_distinct(tokens), lambda x: ~x.rlike("^[0-9]+$"))
    return (F.size(words) >= 2) | ((F.size(words) == 1) & (F.length(F.get(words, F.lit(0))) >= 5))


def _accents() -> tuple[str, str]:
    pairs = [(chr(c), "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x))) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]]
    pairs = [(a, b) for a, b in pairs if len(b) == 1 and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def without_accents(col: Column) -> Column:
    """Latin letters without their marks, by the decompositions that Unicode gives."""
    return F.translate(col, *_accents())


def person_key(col: Column) -> Column:
    """Name for grouping: stacked credentials off, ``Last, First`` turned round, accents off, lower case."""
    name = F.regexp_replace(F.trim(blank(col)), rf"(?i)(?:[,\s]+(?:{CREDENTIAL})\.?,?)*[,\s]*$", "")
    last, first = F.trim(F.regexp_extract(name, r"^([^,]*),(.*)$", 1)), F.trim(F.regexp_extract(name, r"^([^,]*),(.*)$", 2))
    return F.lower(F.trim(without_accents(F.when(first != "", F.concat(first, F.lit(" "), last)).otherwise(name))))


def last_name(key: Column) -> Column:
    """Last token of a grouping key of two or more tokens, else empty."""
    parts = F.split(F.trim(key), r"\s+")
    return F.when(F.size(parts) >= 2, F.element_at(parts, -1)).otherwise("")


def organisation_key(col: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(F.regexp_replace(F.trim(blank(col)), ORG_SUFFIX, "")), r"[,\s]+$", ""))


def location_key(col: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(F.trim(blank(col)), r"\s*\([^)]{1,10}\)\s*$", "")))


def phrase(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(blank(col)), "[^a-z0-9]+", " "))


def phrase_tokens(col: Column) -> Column:
    return F.filter(F.split(phrase(col), " "), lambda x: x != "")


def tokens(col: Column) -> Column:
    """Distinct lower-case alphanumeric tokens."""
    return F.array_distinct(F.regexp_extract_all(F.lower(blank(col)), F.lit("[a-z0-9]+"), 0))


def surface_tokens(col: Column) -> Column:
    """Tokens of two letters or more, and what they are in the singular; sorted."""
    base = F.filter(tokens(col), lambda x: F.length(x) > 1)
    folded = F.transform(
        base,
        lambda x: F.when(x.endswith("ies") & (F.length(x) > 4), F.concat(F.substr(x, F.lit(1), F.length(x) - 3), F.lit("y"))).when(x.endswith("s") & (F.length(x) > 4), F.substr(x, F.lit(1), F.length(x) - 1)).otherwise(x),
    )
    return F.array_sort(F.array_distinct(F.concat(base, folded)))


def condition(col: Column) -> Column:
    out = F.translate(F.regexp_replace(F.regexp_replace(F.lower(F.trim(blank(col))), r"\s+", " "), r"[^a-z0-9\s-]", ""), "-", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "posttraumatic", "post traumatic"), r"\s+", " "))


def person_variants(col: Column) -> Column:
    raw = F.trim(blank(col))
    last, first = F.trim(F.regexp_extract(raw, r"^([^,]*),(.*)$", 1)), F.trim(F.regexp_extract(raw, r"^([^,]*),(.*)$", 2))
    turned = F.when((first != "") & (last != ""), phrase(F.concat(first, F.lit(" "), last)))
    return F.array_sort(F.array_distinct(F.filter(F.array_compact(F.array(phrase(raw), turned)), lambda x: x != "")))


def document_variants(col: Column) -> Column:
    raw = F.trim(blank(col))
    stem = F.trim(F.regexp_replace(raw, rf"(?i){FILE_ENDING}$", ""))
    plain = F.regexp_replace(F.regexp_replace(F.when(stem == "", raw).otherwise(stem), r"(?i)\bv(?:er(?:sion)?)?\s*\d+\b", ""), r"^[ \-_()]+|[ \-_()]+$", "")
    return F.array_sort(F.array_distinct(F.filter(F.array(phrase(raw), phrase(stem), phrase(plain)), lambda x: x != "")))


def is_filename(col: Column) -> Column:
    return blank(col).rlike(rf"(?i){FILE_ENDING}\b")


def context(col: Column, start: Column, end: Column, width: int = 48) -> Column:
    """Lower-case text from ``width`` characters before to ``width`` after a span (0-based, end exclusive)."""
    first = F.greatest(F.lit(0), start - width)
    return F.lower(F.substr(col, (first + 1).cast("int"), (F.least(F.length(col), end + width) - first).cast("int")))


def link_hints(col: Column, stopwords: Iterable[str] = (), limit: int = 8, role: bool = False) -> Column:
    """Phrases to look a surface up by, longest first: itself, its significant tokens, their runs of three and two, each alone and singular."""
    norm, stop = phrase(col), list(stopwords)
    every = F.filter(phrase_tokens(col), lambda x: (F.length(x) >= 2) & (~x.isin(stop) if stop else F.lit(True)))
    main = F.filter(every, lambda x: F.length(x) >= 3)

    def runs(width: int) -> Column:
        starts = F.when(F.size(main) >= width, F.sequence(F.lit(1), F.size(main) - (width - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.array_join(F.slice(main, i, F.lit(width)), " "))

    alone = F.flatten(F.transform(main, lambda x: F.when(x.endswith("s") & (F.length(x) >= 5), F.array(x, F.substr(x, F.lit(1), F.length(x) - 1))).otherwise(F.array(x))))
    parts = [F.array(norm), F.array(F.array_join(main, " ")), runs(3), runs(2), alone]
    if role:
        short = F.filter(every, lambda x: (F.length(x) <= 3) & x.rlike("^[a-z]+$"))
        parts += [F.when(F.size(short) >= 2, F.array(F.array_join(short, " "), F.array_join(short, ""))).otherwise(F.array().cast("array<string>")), short]
    found = F.filter(F.array_distinct(F.concat(*parts)), lambda x: x != "")
    ordered = F.array_sort(F.transform(found, lambda x, i: F.struct((-F.length(x)).alias("a"), i.alias("i"), x.alias("x"))))
    return F.slice(F.transform(ordered, lambda s: s["x"]), 1, limit)


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two arrays of distinct tokens; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def overlap(a: Column, b: Column) -> Column:
    """Shared tokens over the smaller set; 0 if either is empty."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratio of matching blocks (Ratcliff-Obershelp), which has no built-in equivalent: Arrow batches, one call per pair."""
    return pd.Series([0.0 if not x or not y else 1.0 if x == y else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)


def similar(a: Column, b: Column, threshold: float, stopwords: list[str] = STOPWORDS) -> Column:
    """Equal, contained, token subset without stop words, or shared share of tokens at the threshold."""
    strip = lambda c: F.array_distinct(F.filter(F.split(c, r"\s+"), lambda x: x != ""))
    x, y, stop = strip(a), strip(b), F.array(*map(F.lit, stopwords))
    p, q = F.array_except(x, stop), F.array_except(y, stop)
    empty = (F.size(p) == 0) | (F.size(q) == 0)
    p, q = F.when(empty, x).otherwise(p), F.when(empty, y).otherwise(q)
    subset = (F.size(F.array_except(p, q)) == 0) | (F.size(F.array_except(q, p)) == 0)
    known = (F.length(a) > 0) & (F.length(b) > 0) & (F.size(x) > 0) & (F.size(y) > 0)
    return (a == b) | (known & (F.contains(a, b) | F.contains(b, a) | subset | (jaccard(p, q) >= threshold)))


def subset_bonus(surface: Column, candidate: Column, legal: list[str], modifiers: list[str]) -> Column:
    """Bonus of a candidate whose tokens are a proper part of the surface's, the rest being modifiers."""
    extra = F.array_except(surface, candidate)
    fits = (F.size(candidate) > 0) & (F.size(F.array_except(candidate, surface)) == 0) & (F.size(extra) > 0)
    fits &= F.arrays_overlap(candidate, F.array(*map(F.lit, legal))) & (F.size(F.array_except(extra, F.array(*map(F.lit, modifiers)))) == 0)
    bonus = 0.18 + 0.03 * F.least(F.lit(3), F.size(extra)) + F.when(F.size(candidate) >= 2, 0.02).otherwise(0.0)
    return F.when(fits, F.least(F.lit(0.30), bonus)).otherwise(0.0)


def link_score(surface: Column, candidate: Column, ratio: Column, bonus: Column | None = None) -> Column:
    """Score of a surface (a phrase) against a candidate's text; ``ratio`` is their sequence ratio."""
    other = phrase(candidate)
    s, c = F.array_distinct(phrase_tokens(surface)), F.array_distinct(phrase_tokens(other))
    score = 0.45 * ratio + 0.35 * jaccard(s, c)
    score += F.when(other.startswith(surface) | surface.startswith(other), 0.20).when(F.contains(other, surface) | F.contains(surface, other), 0.10).otherwise(0.0)
    main = F.filter(s, lambda x: F.length(x) >= 4)
    score += F.when((F.size(main) > 0) & (F.size(F.array_except(main, c)) == 0), 0.10).otherwise(0.0)
    score = score if bonus is None else score + bonus
    return F.when(other == "", 0.0).when(other == surface, 1.0).otherwise(F.round(F.least(F.lit(1.0), score), 4))


def context_overlap(texts: Column, phrases: Column) -> Column:
    """Best fit of any phrase (two tokens or more) in any text, both given as arrays."""
    pairs = F.flatten(F.transform(F.transform(phrases, phrase), lambda p: F.transform(F.transform(texts, phrase), lambda t: F.struct(p.alias("p"), t.alias("t")))))

    def fit(x: Column) -> Column:
        want = surface_tokens(x["p"])
        hits = F.size(F.array_intersect(want, surface_tokens(x["t"])))
        partly = F.when(hits >= F.greatest(F.lit(2), F.size(want) - 1), hits / F.size(want)).otherwise(0.0)
        inside = F.when(F.contains(x["t"], x["p"]), 1.0).when(F.contains(x["p"], x["t"]), 0.7).otherwise(partly)
        return F.when((x["p"] == "") | (x["t"] == "") | (F.size(want) < 2), 0.0).otherwise(inside)

    return F.round(F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform(pairs, fit)), F.lit(0.0))), 4)


def bigrams(col: Column) -> Column:
    """Distinct pairs of neighbouring characters of the phrase without spaces."""
    s = F.regexp_replace(phrase(col), " ", "")
    at = F.when(F.length(s) >= 2, F.sequence(F.lit(1), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(s, i, F.lit(2))))


def near_matches(needle: str, threshold: float = 0.6):
    """Pandas UDF over texts: (first, last) words of non-overlapping windows like the needle, best first; words with @ are passed over.

    A greedy choice along the text is sequential, so it runs in Arrow batches.
    """
    pair = lambda s: {s[i : i + 2] for i in range(len(s) - 1)}
    flat = lambda ws: "".join(c for w in ws for c in w.lower() if c.isalnum())
    want, size = pair(flat(needle.split())), len(needle.split())

    @F.pandas_udf("array<struct<first: int, last: int, score: double>>")
    def run(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            ws, found = (text or "").split(), []
            for width in range(max(1, size - 1), size + 2):
                for i in range(len(ws) - width + 1):
                    if any("@" in w for w in ws[i : i + width]):
                        continue
                    have = pair(flat(ws[i : i + width]))
                    score = len(want & have) / len(want | have) if want and have else 0.0
                    if score >= threshold:
                        found.append((-score, i, i + width - 1))
            kept: list[tuple[float, int, int]] = []
            for s, a, b in sorted(found):
                if all(b < x or a > y for _, x, y in kept):
                    kept.append((s, a, b))
            out.append([{"first": a, "last": b, "score": -s} for s, a, b in kept])
        return pd.Series(out)

    return run


def needles(col: Column) -> Column:
    """What to look for to highlight a title: itself, without ending, without parenthesis, before a separator; distinct, in that order."""
    raw = F.trim(blank(col))
    stem = F.trim(F.regexp_replace(raw, rf"(?i){FILE_ENDING}$", ""))
    bare = F.trim(F.regexp_replace(stem, r"\s*\([^)]*\)\s*", " "))
    head = F.trim(F.regexp_replace(bare, r"\s+[-–—|:]\s+.*$", ""))
    return F.filter(F.array_distinct(F.array(raw, stem, bare, head)), lambda x: F.length(x) >= 3)


def or_query(terms: Column) -> Column:
    """Terms joined by OR, those with a space in quotes, empty ones left out."""
    kept = F.filter(terms, lambda x: F.coalesce(x, F.lit("")) != "")
    return F.array_join(F.transform(kept, lambda x: F.when(F.contains(x, F.lit(" ")), F.concat(F.lit('"'), x, F.lit('"'))).otherwise(x)), " OR ")


def lower_unique(values: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(values, lambda x: F.lower(F.trim(x))), lambda x: F.coalesce(x, F.lit("")) != ""))


def expanded(terms: Column, more: Column) -> Column:
    """Terms, then those of ``more`` that are new whatever their case."""
    both = F.concat(terms, F.filter(more, lambda x: F.coalesce(x, F.lit("")) != ""))
    first = F.transform(both, lambda x: F.lower(x))
    return F.filter(both, lambda x, i: (i < F.size(terms)) | (F.array_position(first, F.lower(x)) == i + 1))


def paragraphs(col: Column, least: int = 10) -> Column:
    """Blocks between blank lines, lines joined by a space, longer than ``least``."""
    blocks = F.transform(F.split(blank(col), r"\n\s*\n"), lambda x: F.trim(F.regexp_replace(x, r"\s*\n\s*", " ")))
    return F.filter(blocks, lambda x: F.length(x) > least)


def paragraph_relevance(col: Column, triggers: list[str], hints: dict[str, float], expansions: list[str]) -> Column:
    """Weights of the features found in a paragraph over the number of features, 1 at most."""
    text = F.lower(blank(col))
    weighted = [(t, 1.0) for t in triggers] + list(hints.items()) + [(t, 0.5) for t in expansions]
    total = sum((F.when(F.contains(text, F.lit(t.lower())), F.lit(w)).otherwise(0.0) for t, w in weighted), F.lit(0.0))
    return F.least(F.lit(1.0), total / max(1, len(weighted)))


def negation_cues(col: Column, reach: int = 80) -> Column:
    """Array of (cue, toks): the negation patterns that a text holds, in order, with the tokens around each; empty if it only looks like negation."""
    text = F.lower(blank(col))

    def found(pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern)) - 1
        first = F.greatest(F.lit(0), at - reach)
        return F.when(at >= 0, F.struct(F.trim(F.regexp_extract(text, pattern, 0)).alias("cue"), tokens(F.substr(text, first + 1, at + reach - first)).alias("toks")))

    every = F.array_compact(F.array(*map(found, NEGATIONS)))
    # One look for any of them spares most texts the search for each.
    return F.when(text.rlike("|".join(NOT_NEGATIONS)) | ~text.rlike("|".join(NEGATIONS)), F.array().cast("array<struct<cue: string, toks: array<string>>>")).otherwise(every)


def negates(cues: Column, want: Column, least: float = 0.30) -> Column:
    """The first cue whose surroundings share enough tokens with the wanted ones; null if none."""
    return F.get(F.filter(cues, lambda c: jaccard(want, c["toks"]) >= least), F.lit(0))["cue"]


def negation(col: Column, surface: Column, least: float = 0.30, reach: int = 80) -> Column:
    """The cue by which a text negates a surface; null if it does not."""
    return F.when(blank(surface) != "", negates(negation_cues(col, reach), tokens(surface), least))


def document_ids(col: Column) -> Column:
    """Distinct ids of two to four letters and three to six digits."""
    return F.array_distinct(F.regexp_extract_all(blank(col), F.lit(r"\b([a-z]{2,4}\d{3,6})\b"), 1))


# Names of slots that a statement may start with, and openings that say nothing.
SLOT_PREFIXES = ["WHAT:", "WHO:", "WHY:", "HOW:", "WHEN:", "EVIDENCE:", "OUTCOME:"]
OPENINGS = ["The focal document was ", "The retrieved evidence was authored by ", "Responsibility chain: ", "The relevant date or period is ", "Supporting evidence comes from "]


def clean_statement(col: Column) -> Column:
    """Without the slots it starts with (three passes over their list, in its order) and without an opening; each pass and the end trim."""
    out = blank(col)
    trimmed = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    for _ in range(3):
        for slot in SLOT_PREFIXES:
            out = F.regexp_replace(out, rf"^\s*{slot}\s*([\s\S]*?)\s*$", "$1")
    for opening in OPENINGS:
        out = F.regexp_replace(out, f"^{opening}", "")
    return trimmed(out)


def looks_like_id(col: Column, most: int = 12) -> Column:
    return F.trim(blank(col)).rlike(f"^[a-z0-9]{{4,{most}}}$")


def looks_like_person(col: Column) -> Column:
    """Two to five name tokens, two of them capitalised, none generic."""
    parts = F.regexp_extract_all(blank(col), F.lit(r"[A-Za-z][A-Za-z'.-]*"), 0)
    capital = F.size(F.filter(parts, lambda x: x.rlike("^[A-Z]")))
    generic = F.arrays_overlap(F.transform(parts, lambda x: F.lower(x)), F.array(*map(F.lit, NOT_PERSON)))
    return F.size(parts).between(2, 5) & (capital >= 2) & ~generic


def question_relevance(question: Column, text: Column, stopwords: list[str], actions: list[str], trigger: str) -> Column:
    """.65 of the question's terms that a text covers, and .35 of its action terms if the question asks for action; 1 without terms."""
    want = F.filter(tokens(question), lambda x: (F.length(x) >= 3) & ~x.isin(stopwords))
    have = tokens(text)
    coverage = F.least(F.lit(1.0), F.size(F.array_intersect(want, have)) / F.greatest(F.lit(1), F.least(F.size(want), F.lit(12))))
    acts = F.array(*map(F.lit, actions))
    action = F.least(F.lit(1.0), F.size(F.array_intersect(acts, have)) / F.greatest(F.lit(1), F.least(F.size(acts), F.lit(8))))
    action = F.when(F.lower(question).rlike(trigger), action).otherwise(0.0)
    return F.when(F.size(want) == 0, 1.0).when(F.size(have) == 0, 0.0).otherwise(0.65 * coverage + 0.35 * action)


def entity_variants(col: Column) -> Column:
    """Keys of an entity: the term, its full form and its abbreviation, lower-cased, white space folded."""
    fold = lambda c: F.lower(F.trim(F.regexp_replace(blank(c), r"\s+", " ")))
    found = F.array(fold(col), fold(canonical_term(col)), fold(F.coalesce(abbreviation(col), F.lit(""))))
    return F.array_sort(F.array_distinct(F.filter(found, lambda x: x != "")))


def occurrences(col: Column, variants: list[str]) -> Column:
    """How often any variant stands in a text as a whole word, longer variants first, without overlap."""
    import re

    pattern = "|".join(re.escape(v.lower()) for v in sorted(set(variants), key=lambda v: (-len(v), v)))
    return F.regexp_count(F.lower(blank(col)), F.lit(rf"(?<!\w)(?:{pattern})(?!\w)"))
