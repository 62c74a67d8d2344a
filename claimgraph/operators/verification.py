"""Verbatim verification of quotations against artifacts: candidates by an equi-join on an anchor word, then an exact test."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.ids import content_id, content_sha256

#: Bytes, roughly, of quotations up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def verify_quotations(artifacts: DataFrame, quotations: DataFrame) -> DataFrame:
    """Each place where a quotation (item_id, text) first stands verbatim in an artifact (doc_id, text).

    A quotation's inner words stand between spaces or line feeds wherever it stands, so its longest inner word is joined with
    the artifacts' distinct words; quotations of fewer than three words have no inner word and are tested directly."""
    parts = F.split(F.col("quote"), "[ \n]")
    quotes = quotations.select("item_id", F.col("text").alias("quote")).where(F.length("quote") > 0)
    inner = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    anchored = quotes.withColumn("anchor", longest)
    small = (anchored.agg(F.sum(F.octet_length("quote") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    long_ones, short_ones = anchored.where("anchor <> ''"), anchored.where("anchor IS NULL OR anchor = ''")
    words = artifacts.select("doc_id", F.explode(F.array_distinct(F.split("text", "[ \n]"))).alias("anchor"))
    side = F.broadcast(long_ones) if small else long_ones
    pairs = words.join(side, "anchor").select("doc_id", "item_id", "quote")
    found = artifacts.join(pairs, "doc_id").where(F.contains("text", "quote"))
    columns = ["doc_id", "item_id", "text", "quote"]
    if short_ones.limit(1).count():
        direct = artifacts.join(F.broadcast(short_ones) if small else short_ones, F.contains("text", "quote"))
        found = found.select(*columns).unionByName(direct.select(*columns))
    start = F.instr("text", F.col("quote")) - 1
    sha = content_sha256(F.col("text"))
    artifact = content_id("artifact", F.col("doc_id"), sha)
    return found.select("doc_id", "item_id", artifact.alias("artifact_id"), sha.alias("artifact_sha256"), content_id("evidence", artifact, sha, start, F.col("quote")).alias("evidence_id"), start.cast("long").alias("char_start"), (start + F.length("quote")).cast("long").alias("char_end"), F.lit("EXACT").alias("strength"))


VERIFY_ORACLE = """
WITH f AS (SELECT d.doc_id, b.item_id, b.text AS quote, sha256(d.text) AS sha, strpos(d.text, b.text) - 1 AS p
           FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0),
a AS (SELECT *, substr(sha256(concat_ws(chr(31), 'artifact', CAST(doc_id AS VARCHAR), sha)), 1, 32) AS artifact_id FROM f)
SELECT doc_id, item_id, artifact_id, sha AS artifact_sha256,
       substr(sha256(concat_ws(chr(31), 'evidence', artifact_id, sha, CAST(p AS VARCHAR), quote)), 1, 32) AS evidence_id,
       p AS char_start, p + length(quote) AS char_end, 'EXACT' AS strength FROM a
"""
