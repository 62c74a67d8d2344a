"""Content-derived identifiers: the first 128 bits of a SHA-256 over unit-separated parts, in hexadecimal."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def content_id(kind: str, *parts: Column) -> Column:
    """An id of this kind; null parts count as empty, so that parts never change places."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.substring(F.sha2(F.concat_ws(SEPARATOR, F.lit(kind), *texts), 256), 1, 32)


def content_sha256(text: Column) -> Column:
    return F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
