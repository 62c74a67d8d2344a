"""Predicates of claims: what their objects are, how many an entity may have, and what their absence says.

One table is the authority for all rules; unknown predicates are multi-valued, open-world and trusted by their
establishment alone, since a contradiction that is made up is worse than one that is missed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Predicate, object, structural, functional (at most one value), closed world (absence may falsify).
PREDICATES = [
    ("CONTAINS", "symbol", True, False, True),
    ("DEFINES", "symbol", True, False, False),
    ("CALLS", "symbol or literal", True, False, False),
    ("IMPORTS", "symbol or literal", True, False, False),
    ("EXTENDS", "symbol or literal", True, False, True),
    ("READS", "symbol", True, False, False),
    ("WRITES", "symbol", True, False, False),
    ("HAS_DEFAULT", "literal", True, True, False),
    ("HAS_VALUE", "literal", True, True, False),
    ("HAS_TYPE", "symbol or literal", True, True, False),
    ("HAS_PURPOSE", "literal", False, True, False),
]
STRUCTURAL = tuple(p for p, _, structural, _, _ in PREDICATES if structural)
LITERAL = tuple(p for p, kind, _, _, _ in PREDICATES if kind == "literal")
FUNCTIONAL = tuple(p for p, _, _, functional, _ in PREDICATES if functional)
CLOSED_WORLD = tuple(p for p, _, _, _, closed in PREDICATES if closed)
# What may be answered with, what may be stored for predicates that are not structural, words for properties.
TRUSTED = ("DERIVED", "CONFIRMED")
SEMANTIC_LEVELS = ("DERIVED", "CONFIRMED", "PROPOSED", "DISPUTED")
PRESENTABLE = ("ACTIVE", "VERIFIED")
VERIFIABLE = ("EXACT", "REPRODUCIBLE")
PROPERTY_WORDS = {"default": "HAS_DEFAULT", "defaults": "HAS_DEFAULT", "value": "HAS_VALUE", "type": "HAS_TYPE", "purpose": "HAS_PURPOSE", "rationale": "HAS_PURPOSE"}


def table(spark: SparkSession) -> DataFrame:
    """The vocabulary as a dimension to join."""
    return spark.createDataFrame(PREDICATES, "predicate string, object string, structural boolean, functional boolean, closed_world boolean")


def allowed(predicate: Column, establishment: Column) -> Column:
    """Whether a claim of a known predicate may be stored at this level."""
    return F.when(predicate.isin(*STRUCTURAL), establishment.isin(*TRUSTED)).when(predicate.isin(*(p for p, *_ in PREDICATES)), establishment.isin(*SEMANTIC_LEVELS)).otherwise(False)


def trusted(predicate: Column, establishment: Column) -> Column:
    """Whether a claim may support an answer."""
    known = predicate.isin(*(p for p, *_ in PREDICATES))
    return establishment.isin(*TRUSTED) & (~known | allowed(predicate, establishment))
