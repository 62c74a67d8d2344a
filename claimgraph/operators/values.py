"""Values of claims: parsing into a closed domain, and comparing what was parsed.

A text outside the domain has no value (null), which agrees with nothing and contradicts nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions import vocabulary

# Spellings of units, and seconds by unit of time.
UNITS = {"s": "s", "sec": "s", "secs": "s", "second": "s", "seconds": "s", "ms": "ms", "millisecond": "ms", "milliseconds": "ms", "m": "min", "min": "min", "minute": "min", "minutes": "min", "h": "h", "hour": "h", "hours": "h", "b": "byte", "byte": "byte", "bytes": "byte"}
SECONDS = {"ms": 0.001, "s": 1.0, "min": 60.0, "h": 3600.0}
NUMBER = r"(?U)(?<![\w.])(-?\d+(?:\.\d+)?)\s*([A-Za-z]+)?"
QUOTED = r"""(?:b|r|f)?["']([^"']*)["']"""
NAME = r"^[A-Za-z_][A-Za-z0-9_.\-]*$"
_VALUE = "struct<kind:string,text:string,number:double,unit:string>"


def _map(values: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def _value(kind: str, text: Column | None = None, number: Column | None = None, unit: Column | None = None) -> Column:
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("kind"), (null if text is None else text).cast("string").alias("text"), (null if number is None else number).cast("double").alias("number"), (null if unit is None else unit).cast("string").alias("unit"))


def parse(text: Column) -> Column:
    """struct(kind, text, number, unit), kind being boolean, none, string, number or identifier; null outside the domain.

    In this order: true and false, none and null; the first quotation, unless a number (and a word) is all that it holds;
    the only number, with its unit if a word follows that is one (`x` counts as none, any other word leaves nothing);
    an identifier, of which the part after the last dot counts."""
    t = F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    low = F.lower(t)
    quoted = F.regexp_extract(t, QUOTED, 1)
    stripped = F.regexp_replace(F.regexp_replace(quoted, r"(?U)^\s+", ""), r"(?U)\s+$", "")
    numeric = F.rlike(stripped, F.lit(f"^(?:{NUMBER})$"))
    numbers, words = F.regexp_extract_all(t, F.lit(NUMBER), F.lit(1)), F.regexp_extract_all(t, F.lit(NUMBER), F.lit(2))
    word = F.lower(F.get(words, F.lit(0)))
    unit = F.element_at(_map(UNITS), word)
    known = (word == "") | word.isNull() | unit.isNotNull() | (word == "x")
    return (
        F.when(t.isNull() | (t == ""), F.lit(None).cast(_VALUE))
        .when(low.isin("true", "false"), _value("boolean", low))
        .when(low.isin("none", "null"), _value("none"))
        .when((quoted != "") & ~numeric, _value("string", quoted))
        .when((F.size(numbers) == 1) & known, _value("number", None, F.get(numbers, F.lit(0)), unit))
        .when(F.size(numbers) > 0, F.lit(None).cast(_VALUE))
        .when(F.rlike(t, F.lit(NAME)), _value("identifier", F.substring_index(t, ".", -1)))
    )


def compare(a: Column, b: Column) -> Column:
    """SAME, DIFFERENT or UNRESOLVED of two parsed values. Values of different kinds differ, but for a number and a string,
    of which nothing is known; so of unequal numbers of which one has a unit, and of times and sizes."""
    time = lambda v: F.element_at(_map(SECONDS), v["unit"])
    kinds = F.array_sort(F.array(a["kind"], b["kind"])) == F.array(F.lit("number"), F.lit("string"))
    one_unit = a["unit"].isNull() != b["unit"].isNull()
    both_units = a["unit"].isNotNull() & b["unit"].isNotNull()
    base = lambda v: F.round(v["number"] * time(v), 9)
    same_number = F.when(time(a).isNotNull() & time(b).isNotNull(), base(a) == base(b)).otherwise((a["number"] == b["number"]) & a["unit"].eqNullSafe(b["unit"]))
    verdict = lambda same: F.when(same, "SAME").otherwise("DIFFERENT")
    return (
        F.when(a.isNull() | b.isNull(), "UNRESOLVED")
        .when(a["kind"] != b["kind"], F.when(kinds, "UNRESOLVED").otherwise("DIFFERENT"))
        .when((a["kind"] == "number") & one_unit, F.when(a["number"] == b["number"], "SAME").otherwise("UNRESOLVED"))
        .when((a["kind"] == "number") & both_units & (time(a).isNull() != time(b).isNull()), "UNRESOLVED")
        .when(a["kind"] == "number", verdict(same_number))
        .otherwise(verdict(a["text"].eqNullSafe(b["text"])))
    )


def conflicts(claims: DataFrame, *group: str) -> DataFrame:
    """One row for each group and functional predicate whose claims (claim_id, predicate, value, ...) hold two values that
    differ: the first such pair in the order of claim_id, and how many pairs do.

    Claims are joined by group and predicate, one for each distinct value, so that many claims of one value make one row."""
    firsts = claims.where(F.col("predicate").isin(*vocabulary.FUNCTIONAL)).groupBy(*group, "predicate", "value").agg(F.min("claim_id").alias("claim_id")).withColumn("parsed", parse(F.col("value")))
    right = firsts.select(*(F.col(c).alias(f"r_{c}") for c in [*group, "predicate", "claim_id", "value", "parsed"]))
    on = [F.col(c).eqNullSafe(F.col(f"r_{c}")) for c in [*group, "predicate"]]
    pairs = firsts.join(right, on, "inner").where((F.col("claim_id") < F.col("r_claim_id")) & (compare(F.col("parsed"), F.col("r_parsed")) == "DIFFERENT"))
    first = F.min(F.struct("claim_id", "r_claim_id", "value", "r_value"))
    return pairs.groupBy(*group, "predicate").agg(first.alias("p"), F.count(F.lit(1)).alias("pairs")).select(*group, "predicate", F.col("p.claim_id").alias("left_claim"), F.col("p.r_claim_id").alias("right_claim"), F.col("p.value").alias("left_value"), F.col("p.r_value").alias("right_value"), "pairs")
