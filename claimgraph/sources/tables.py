"""Driver tables as DataFrames and as temporary views for SQL plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run_sql(spark: SparkSession, sf_dir: str, sql: str, tables: tuple[str, ...]) -> DataFrame:
    """Plan a statement over the named tables; the views are bound when it is analysed."""
    for name in tables:
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION sha256(x STRING) RETURNS STRING RETURN sha2(x, 256)")
    return spark.sql(sql)
