"""Dates that are kept as text and compared as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import blank

# Names of months, in full and as three letters.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
SHORT = [m[:3] for m in MONTHS]
_NAMES = "|".join(m.capitalize() for m in MONTHS)


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name, its first three letters, or sept; null otherwise."""
    word = F.lower(name)
    pairs = {m: i for i, m in enumerate(MONTHS, 1)} | {m: i for i, m in enumerate(SHORT, 1)} | {"sept": 9}
    return F.coalesce(*[F.when(word.isin(*[k for k, v in pairs.items() if v == i]), F.lit(i)) for i in range(1, 13)])


def iso(year: Column, month: Column, day: Column) -> Column:
    pad = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    return F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-"), pad(month), F.lit("-"), pad(day))


def parse_day(col: Column) -> Column:
    """``2018 January 04`` as ISO date; null otherwise."""
    pattern = r"^(\d{4})\s+(\w+)\s+(\d{1,2})"
    part = lambda i: F.regexp_extract(F.trim(blank(col)), pattern, i)
    number = F.coalesce(*[F.when(F.lower(part(2)) == m, F.lit(i)) for i, m in enumerate(MONTHS, 1)])
    return F.when(part(1) != "", iso(part(1), number, F.nullif(part(3), F.lit("")).cast("int")))


def newest_day(col: Column) -> Column:
    """The newest date of a list parted by semicolons; the text itself if none can be read."""
    raw = F.trim(blank(col))
    return F.coalesce(F.array_max(F.array_compact(F.transform(F.split(raw, ";"), parse_day))), raw)


def normal(col: Column) -> Column:
    """Date-like text as YYYY-MM-DD: ISO as it is; after a leading year, month and day from the tokens; other text unchanged."""
    raw = F.trim(blank(col))
    words = F.filter(F.split(F.lower(F.substr(raw, F.lit(5))), r"[\s,/.\-]+"), lambda x: x != "")
    start = F.struct(F.lit(1).alias("m"), F.lit(1).alias("d"), F.lit(False).alias("has_m"), F.lit(False).alias("has_d"))

    def step(acc: Column, word: Column) -> Column:
        named = month_number(word)
        number = F.when(word.rlike("^[0-9]{1,9}$"), word.cast("int"))
        as_month = named.isNull() & ~acc["has_m"] & number.between(1, 12)
        as_day = named.isNull() & ~F.coalesce(as_month, F.lit(False)) & ~acc["has_d"] & number.between(1, 31)
        as_month, as_day = F.coalesce(as_month, F.lit(False)), F.coalesce(as_day, F.lit(False))
        return F.struct(
            F.when(named.isNotNull(), named).when(as_month, number).otherwise(acc["m"]).alias("m"), F.when(as_day, number).otherwise(acc["d"]).alias("d"),
            (acc["has_m"] | named.isNotNull() | as_month).alias("has_m"), (acc["has_d"] | as_day).alias("has_d"),
        )

    found = F.aggregate(words, start, step)
    is_iso = (F.length(raw) >= 10) & (F.substring(raw, 5, 1) == "-") & (F.substring(raw, 8, 1) == "-")
    return F.when(is_iso, F.substring(raw, 1, 10)).when(raw.rlike(r"^\d{4}"), iso(F.substring(raw, 1, 4), found["m"], found["d"])).otherwise(raw)


def find_day(col: Column) -> Column:
    """First ISO date of this century in a text, else first ``Month D, YYYY``, else empty."""
    got = lambda p, i: F.nullif(F.regexp_extract(blank(col), p, i), F.lit(""))
    return F.coalesce(got(r"\b(20\d{2}-\d{2}-\d{2})\b", 1), got(rf"(?i)\b(?:{_NAMES})\s+\d{{1,2}},\s+\d{{4}}\b", 0), F.lit(""))


def find_date(col: Column) -> Column:
    """First ISO date, else ``Month YYYY``, else year, else empty."""
    got = lambda p, i: F.nullif(F.regexp_extract(blank(col), p, i), F.lit(""))
    month = rf"(?i)\b({_NAMES}|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\s+(\d{{4}})\b"
    return F.coalesce(got(r"\b(20\d{2}-\d{2}-\d{2})\b", 1), F.when(got(month, 0).isNotNull(), F.concat(got(month, 1), F.lit(" "), got(month, 2))), got(r"\b(19\d{2}|20\d{2})\b", 1), F.lit(""))


def months(col: Column) -> Column:
    """year * 12 + month of a found date; a year alone counts as its middle (month 6); null if it cannot be read."""
    got = lambda p, i: F.nullif(F.regexp_extract(blank(col), p, i), F.lit(""))
    is_iso, named = r"^(\d{4})-(\d{2})", r"^(\w+)\s+(\d+)$"
    return F.coalesce(
        got(is_iso, 1).cast("int") * 12 + got(is_iso, 2).cast("int"), got(named, 2).cast("int") * 12 + month_number(got(named, 1)), got(r"^\s*(\d{4})\s*$", 1).cast("int") * 12 + 6
    )


def year(col: Column) -> Column:
    """First year of 1900 to 2099 in a text; null if none."""
    return F.nullif(F.regexp_extract(blank(col), r"\b((?:19|20)\d{2})\b", 1), F.lit("")).cast("int")


def in_years(col: Column, first: Column, last: Column) -> Column:
    """Whether the year lies within bounds that may be null; null if the year, or both bounds, are unknown."""
    y = year(col)
    outside = F.coalesce(y < first, F.lit(False)) | F.coalesce(y > last, F.lit(False))
    return F.when(y.isNull() | (first.isNull() & last.isNull()), F.lit(None).cast("boolean")).otherwise(~outside)


def full_year(two: Column) -> Column:
    """Years of two digits up to 30 are of this century."""
    return F.when(two <= 30, two + 2000).otherwise(two + 1900)


def time_score(years: Column, text_years: Column, first: Column, last: Column) -> Column:
    """.75 if a known year lies within the bounds, -1.25 if none does (or none of the text's), 0 if nothing is known."""
    inside = lambda y: F.coalesce(y >= first, F.lit(True)) & F.coalesce(y <= last, F.lit(True))
    every = F.array_union(years, text_years)
    known = (first.isNotNull() | last.isNotNull()) & (F.size(every) > 0)
    return F.when(~known, 0.0).when((F.size(text_years) > 0) & ~F.exists(text_years, inside), -1.25).when(F.exists(every, inside), 0.75).otherwise(-1.25)


def constraint(kind: str, a: Column, b: Column, days: int | None = None) -> Column:
    """ORDER (a not after b) or WITHIN so many days, on ISO dates; null if a side is unknown. CONCURRENT is never decided."""
    x, y = F.try_to_timestamp(a).cast("date"), F.try_to_timestamp(b).cast("date")
    if kind == "ORDER":
        return x <= y
    if kind == "WITHIN":
        return F.abs(F.datediff(x, y)) <= days
    return F.lit(None).cast("boolean")


def any_format(col: Column, formats: tuple[str, ...] = ("yyyy-MM-dd", "MM/dd/yyyy", "dd MMMM yyyy", "MMMM d, yyyy", "yyyy/MM/dd")) -> Column:
    """ISO date by the first format that fits; null if none does."""
    return F.date_format(F.coalesce(*[F.try_to_timestamp(F.trim(col), F.lit(f)) for f in formats]), "yyyy-MM-dd")


def scope_bound(col: Column, end: bool = False) -> Column:
    """Time bound in UTC: a bare date gets the day's first or last second, an offset is taken out, other text stays."""
    raw = F.trim(blank(col))
    bare = raw.rlike(r"^\d{4}-\d{2}-\d{2}$")
    stamped = F.date_format(F.to_utc_timestamp(F.try_to_timestamp(raw), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(bare, F.concat(raw, F.lit("T23:59:59Z" if end else "T00:00:00Z"))).when(raw.rlike(r"^\d{4}-\d{2}-\d{2}T"), F.coalesce(stamped, raw)).otherwise(raw)


def question_range(col: Column) -> tuple[Column, Column]:
    """January 1 of the first and December 31 of the last year that a question names; null without years."""
    found = F.regexp_extract_all(blank(col), F.lit(r"\b((?:19|20)\d{2})\b"), 1)
    return F.when(F.size(found) > 0, F.concat(F.array_min(found), F.lit("-01-01"))), F.when(F.size(found) > 0, F.concat(F.array_max(found), F.lit("-12-31")))
