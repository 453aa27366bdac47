"""JSON and map functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillgraph.functions.text import blank


def first_title(col: Column) -> Column:
    """Title of the first object of a JSON array; empty if there is none."""
    return F.coalesce(F.trim(F.get(F.from_json(col, "array<struct<title: string>>"), F.lit(0))["title"]), F.lit(""))


def merged(base: Column, patch: Column) -> Column:
    """Map with the entries of both; those of the patch win."""
    empty = F.create_map().cast("map<string,string>")
    base, patch = F.coalesce(base, empty), F.coalesce(patch, empty)
    return F.map_concat(F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k)), patch)


def leftover(fields: Column, known: list[str]) -> Column:
    """JSON of the entries of a map that have no column of their own."""
    return F.to_json(F.map_filter(fields, lambda k, v: ~k.isin(known)))


def category_ends(col: Column) -> tuple[Column, Column]:
    """What stands before the first and after the last > of a category path."""
    parts = F.split(blank(col), ">")
    return F.trim(F.get(parts, F.lit(0))), F.trim(F.element_at(parts, -1))


def tolerant_json(col: Column) -> Column:
    """JSON text without code fences and without commas before a closing bracket."""
    bare = F.regexp_replace(blank(col), r"(?s)^\s*```(?:json)?\s*|\s*```\s*$", "")
    return F.regexp_replace(F.regexp_extract(bare, r"(?s)([\[{].*[\]}])", 1), r",\s*([\]}])", "$1")
