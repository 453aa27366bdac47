"""Deterministic identifiers as column expressions."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(col: Column) -> Column:
    """A key part; null counts as the empty text, as concat_ws would skip it."""
    return F.coalesce(col.cast("string"), F.lit(""))


def sha_id(namespace: str, *parts: Column) -> Column:
    """The first 12 hexadecimal digits of sha256 of namespace|part|part..."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(namespace), *map(text, parts)), 256), 1, 12)


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """Name-based UUID: sha1 of the namespace's bytes and the name, with version and variant bits set on hexadecimal digits."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3), F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12))


def stable_hash(length: int = 16, **fields: Column) -> Column:
    """Short hash of a record: JSON of its fields in the order of their names."""
    record = F.struct(*[fields[k].alias(k) for k in sorted(fields)])
    return F.substring(F.sha2(F.to_json(record), 256), 1, length)
