"""A training corpus from raw documents: quality, near duplicates, benchmark leaks, secrets, mixture.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All but the last return the columns of documents; the last returns a row for each copy that the mixture
takes. Stages keep whole rows: nulls in any column, empty and very long texts, repeated rows and extra columns pass
through as the operators' docstrings define them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.llm import decontamination, mixing, near_duplicates, quality, secret_scan
from claimgraph.llm.common import read, shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject, with all their columns.

    Null and empty texts are scored as texts without words, very long ones whole; a null source or language is a site of
    its own; repeated rows and ties in the score are treated alike, a score at the threshold stays; without labels, or
    in an empty table, nothing is rejected. Columns named like the classifier's own pass through untouched."""
    found = quality.classify(docs, read(spark, sf_dir, "labels", "doc_id", "quality"))
    return found.where("quality_keep").select("row.*")


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one document, that of the least id.

    Repeated rows are copies of each other, of which one stays; so are rows of equal texts without an id, which go if their
    class has a document with one. Documents without words (null, empty, white space) are copies of nothing and stay.
    Texts are compared whole; other columns pass through whatever their names."""
    return near_duplicates.one_per_class(docs)


def keep_unseen(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item.

    Null and empty texts hold none; null ids are looked at like others, by their text; repeated rows go or stay
    together; an empty benchmark removes nothing. Columns pass through whatever their names."""
    found = decontamination.hits(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.where(F.size("hits") == 0).select("row.*")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark, and n_chars (where it is given and not null) counted anew.

    Null texts stay null and empty ones empty; repeated rows stay repeated; other columns pass through."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long"))) if "n_chars" in docs.columns else clean


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy of each document that the target mixture takes, with size, target, rate and the copy's number
    from 1.

    A null source is a source of its own. Null and empty texts have size 0 and rate 1, so one copy of each stays; repeated
    rows are taken alike. A column of the input that has the name of an added one is kept with `_in` behind its name, and
    so on until no name is taken twice."""
    found = mixing.balance(docs)
    added = ["size", "target", "rate", "copy"]
    names: list[str] = []
    for c in docs.columns:
        given = c
        while given.lower() in added or given in names or given != c and given in docs.columns:
            given += "_in"
        names.append(given)
    taken = found.where("copies > 0")
    kept = [F.col(f"row.`{c}`").alias(given) for c, given in zip(docs.columns, names, strict=True)]
    return taken.select(*kept, "size", "target", "rate", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))


STAGES: list[tuple[str, Stage]] = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("decontamination", keep_unseen), ("secrets", without_secrets), ("mixing", mixture)]
#: The classifier's fit and the exact join over all shingles are not expressed in SQL; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
