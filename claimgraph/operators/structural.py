"""Three-valued checks of assertions against the edges of a claim graph."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def order_assertions(part: DataFrame, supplier: DataFrame, lineitem: DataFrame) -> DataFrame:
    """(subject, object): every part of an order with every supplier of the same order, which includes all pairs of
    lineitem; and every part with the least supplier, so that each part is asserted at least once."""
    lines = lineitem.select("l_orderkey", F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object"))
    mates = lines.select("l_orderkey", "subject").join(lines.select("l_orderkey", "object"), "l_orderkey").select("subject", "object")
    least = part.select(F.col("p_partkey").alias("subject")).crossJoin(F.broadcast(supplier.agg(F.min("s_suppkey").alias("object"))))
    return lines.select("subject", "object").union(mates).union(least).where("subject IS NOT NULL AND object IS NOT NULL").distinct()


def check(assertions: DataFrame, edges: DataFrame) -> DataFrame:
    """(subject, object, verdict) of every assertion (subject, object): SUPPORTED by an equal edge, else NOT_ESTABLISHED if
    the subject has no edge at all, else EXPLICIT_CONTRADICTION. Nulls equal nothing."""
    edges = edges.select("subject", "object").where("subject IS NOT NULL AND object IS NOT NULL").distinct()
    found = assertions.join(edges.withColumn("equal", F.lit(True)), ["subject", "object"], "left").join(edges.select("subject", F.lit(True).alias("known")).distinct(), "subject", "left")
    verdict = F.when(F.col("equal"), "SUPPORTED").when(F.col("known").isNull(), "NOT_ESTABLISHED").otherwise("EXPLICIT_CONTRADICTION")
    return found.select("subject", "object", verdict.alias("verdict"))


ORDER_ORACLE = """WITH p AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_suppkey IS NOT NULL),
a AS (SELECT l_partkey AS subject, l_suppkey AS object FROM p UNION SELECT x.l_partkey, y.l_suppkey FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey WHERE x.l_partkey IS NOT NULL AND y.l_suppkey IS NOT NULL
UNION SELECT p_partkey, (SELECT min(s_suppkey) FROM supplier) FROM part WHERE p_partkey IS NOT NULL AND EXISTS (SELECT 1 FROM supplier WHERE s_suppkey IS NOT NULL))
SELECT subject, object, CASE WHEN EXISTS (SELECT 1 FROM p WHERE p.l_partkey = a.subject AND p.l_suppkey = a.object) THEN 'SUPPORTED' WHEN NOT EXISTS (SELECT 1 FROM p WHERE p.l_partkey = a.subject) THEN 'NOT_ESTABLISHED' ELSE 'EXPLICIT_CONTRADICTION' END AS verdict FROM a"""
