"""Which texts may be read as artifacts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the largest file that is admitted.
MAX_BYTES = 8 * 1024 * 1024


def status(body: Column) -> Column:
    """A text's admission: the first rule that it breaks. A DOCTYPE is rejected wherever it stands."""
    hostile = F.contains(F.upper(body), F.lit("<!DOCTYPE"))
    return F.when(body.isNull(), "NOT_A_FILE").when(F.octet_length(body) > MAX_BYTES, "OVERSIZE").when(F.contains(body, F.lit("\0")), "BINARY_AS_TEXT").when(hostile, "HOSTILE_MARKUP").otherwise("ADMITTED")


def admitted(documents: DataFrame, pages: DataFrame) -> DataFrame:
    """(kind, id, status) of documents (doc_id, text) and pages (page_id, html)."""
    both = documents.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("text").alias("body")).union(pages.select(F.lit("page"), "page_id", "html"))
    return both.select("kind", "id", status(F.col("body")).alias("status"))


ORACLE = f"""WITH u AS (SELECT 'document' AS kind, doc_id AS id, text AS body FROM documents UNION ALL SELECT 'page', page_id, html FROM pages)
SELECT kind, id, CASE WHEN body IS NULL THEN 'NOT_A_FILE' WHEN strlen(body) > {MAX_BYTES} THEN 'OVERSIZE' WHEN strpos(body, chr(0)) > 0 THEN 'BINARY_AS_TEXT' WHEN regexp_matches(body, '(?i)<!doctype') THEN 'HOSTILE_MARKUP' ELSE 'ADMITTED' END AS status FROM u"""
