"""Helpers that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.shared import shared_path, written  # noqa: F401

# What separates words in the mixing and near-duplicate contracts, and in the license and benchmark
# contracts after A-Z are lower-cased.
SPACE = r"\x20\x09-\x0D"
NOT_ALNUM = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Rows and bytes of a batch that a Python worker gets at once, where the session says nothing else: a few very long texts
#: fill a batch as well as many short ones.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20
_SET = {"spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", str(BATCH_ROWS)), "spark.sql.execution.arrow.maxBytesPerBatch": ("268435456", str(BATCH_BYTES))}


def small_batches(spark: SparkSession) -> None:
    """Bound what Python workers hold, unless the session has other values than Spark's own."""
    for key, (default, value) in _SET.items():
        if spark.conf.get(key, default) in (default, "2147483647", "256MB", "-1"):
            spark.conf.set(key, value)


def checkpoint(df: DataFrame) -> DataFrame:
    """Write a table to the shared folder and read it again: cuts lineage, so that a lost executor costs no
    recomputation of what came before, and leaves the planner with the table's true size."""
    return written(df)


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return df.select(*columns) if columns else df


def held_out(doc_id: Column) -> Column:
    """The rows that no label is learnt from: crc32 of the id's text leaves 1 when divided by 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3 == 1


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)
