"""Which occurrence of a name a place in the source belongs to.

A qualified name is a name and no identity: a file may define it several times. The occurrence that counts is the
tightest one whose span holds the place, and none if that is not one alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def located(sites: DataFrame, symbols: DataFrame) -> DataFrame:
    """sites (site, artifact_id, qname, byte_start, byte_end; site is unique) with `enclosing`, the tightest occurrence of the name
    around the site, null if there is none or no single one; `sole`, the name's only occurrence in the file, else null; and
    `occurrences`, their number. symbols are (artifact_id, qname, byte_start, byte_end, symbol_id, seq)."""
    there = symbols.select(F.col("artifact_id").alias("a"), F.col("qname").alias("q"), F.col("byte_start").alias("s"), F.col("byte_end").alias("e"), "symbol_id", "seq")
    pairs = sites.select("site", "artifact_id", "qname", "byte_start", "byte_end").join(there, (F.col("artifact_id") == F.col("a")) & (F.col("qname") == F.col("q")), "left")
    inside = (F.col("s") <= F.col("byte_start")) & (F.col("byte_end") <= F.col("e"))
    width = F.col("e") - F.col("s")
    # The first and the last of the tightest ones are the same row if there is one alone.
    low = F.min(F.when(inside, F.struct(width.alias("w"), "seq", "symbol_id")))
    high = F.max(F.when(inside, F.struct((-width).alias("w"), "seq", "symbol_id")))
    n = F.count("symbol_id")
    found = pairs.groupBy("site").agg(low.alias("low"), high.alias("high"), n.alias("occurrences"), F.min("symbol_id").alias("one"))
    return sites.join(found.select("site", F.when(F.col("low.seq") == F.col("high.seq"), F.col("low.symbol_id")).alias("enclosing"), F.when(F.col("occurrences") == 1, F.col("one")).alias("sole"), "occurrences"), "site")


def sole_names(symbols: DataFrame) -> DataFrame:
    """(qname, n, sole_id): how many symbols of the whole corpus carry a name, and the one that does if there is only one."""
    return symbols.groupBy("qname").agg(F.count(F.lit(1)).alias("n"), F.min("symbol_id").alias("id")).select("qname", "n", F.when(F.col("n") == 1, F.col("id")).alias("sole_id"))
