"""The registered queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from claimgraph.llm import decontamination, licenses, media, mixing, near_duplicates, pages, quality, secret_scan, toxicity, warc
from claimgraph.llm.common import read


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op2(read(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.op3(read(spark, sf_dir, "documents", "doc_id", "text", "source", "lang"), read(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.op5(read(spark, sf_dir, "documents", "doc_id", "text"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.op1(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.op6(read(spark, sf_dir, "documents", "doc_id", "text"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.op7(spark, read(spark, sf_dir, "pages", "page_id", "url", "html"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.op8(read(spark, sf_dir, "documents", "doc_id", "text"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.op9(read(spark, sf_dir, "documents", "doc_id", "text"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.op10(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_toxicity": op1_toxicity, "op2_mixing": op2_mixing, "op3_quality": op3_quality, "op4_extraction": op4_extraction, "op5_media": op5_media, "op6_jaccard": op6_jaccard, "op7_warc": op7_warc, "op8_secrets": op8_secrets, "op9_licenses": op9_licenses, "op10_decontamination": op10_decontamination}


def oracle_sql() -> dict[str, str]:
    return {"op7_warc": warc.ORACLE, "op10_decontamination": decontamination.ORACLE}
