"""Name -> query and name -> SQL oracle for the operators of the claim graph."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.operators import admission, ranking, structural, verification
from claimgraph.plans import sample_expected, sample_queries, sql_plans, table_queries
from claimgraph.sources.tables import run_sql, table

QUERY = "the thing of and that with er"


def evidence_verify_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verification.verify_quotations(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text"))


def bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.bm25(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY)


def dense_cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.cosine_topk(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 0)


def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    lexical = ranking.ranked(ranking.bm25(docs, QUERY, 50), "doc_id", "score")
    by_length = ranking.ranked(docs.orderBy(F.col("n_chars").desc(), "doc_id").limit(50), "doc_id", "n_chars")
    return ranking.reciprocal_rank_fusion([(lexical, 1.0), (by_length, 0.5)], "doc_id")


def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", F.from_json("props", "map<string,string>").alias("m"))
    return rows.select("event_id", F.explode("m").alias("key", "value")).select("event_id", F.concat(F.lit("/"), "key").alias("pointer"), "value")


def block_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("block", "body"))
    return rows.select("doc_id", F.col("block").cast("long").alias("block"), F.length("body").cast("long").alias("n_chars")).where("n_chars > 0")


def span_budget_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.length("text").alias("size"))
    return ranking.budget_fit(spans, "conv_id", "turn", "size", limit=3, budget=400)


def structural_check_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supplier, lineitem = (table(spark, sf_dir, t) for t in ("part", "supplier", "lineitem"))
    return structural.check(structural.order_assertions(part, supplier, lineitem), lineitem.select(F.col("l_partkey").alias("subject"), F.col("l_suppkey").alias("object")))


def admission_status_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return admission.admitted(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pages"))


_TOKENS = "regexp_extract_all(lower(text), '[a-z0-9_]+')"
BM25_ORACLE = f"""WITH b AS (SELECT doc_id, {_TOKENS} AS w FROM documents), s AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM b),
p AS (SELECT doc_id, len, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM b) x WHERE term IN ({", ".join(f"'{t}'" for t in sorted(set(QUERY.split())))}) GROUP BY ALL),
d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / avg_len))), 6) AS score FROM p JOIN d USING (term), s GROUP BY doc_id"""
OWN: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "evidence_verify_exact": (evidence_verify_exact, verification.VERIFY_ORACLE),
    "bm25_search": (bm25_search, BM25_ORACLE + " ORDER BY score DESC, doc_id LIMIT 20"),
    "dense_cosine_topk": (dense_cosine_topk, """WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id <> 0)
SELECT vec_id, round(list_dot_product(v, q) / sqrt(list_dot_product(v, v) * list_dot_product(q, q)), 6) AS cosine FROM e, q ORDER BY cosine DESC, vec_id LIMIT 20"""),
    "rrf_fusion": (rrf_fusion, f"""WITH l AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM ({BM25_ORACLE}) x QUALIFY rank <= 50), n AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 50)
SELECT doc_id, round(sum(part), 9) AS score FROM (SELECT doc_id, 1.0 / (60 + rank) AS part FROM l UNION ALL SELECT doc_id, 0.5 / (60 + rank) FROM n) y GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""),
    "json_flatten": (json_flatten, "SELECT event_id, concat('/', key) AS pointer, json_extract_string(props, concat('$.\"', key, '\"')) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events) x"),
    "block_chunks": (block_chunks, "SELECT doc_id, i - 1 AS block, length(b[i]) AS n_chars FROM (SELECT doc_id, b, unnest(range(1, len(b) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS b FROM documents) x) y WHERE length(b[i]) > 0"),
    "span_budget_fit": (span_budget_fit, None),
    "admission_status_all": (admission_status_all, admission.ORACLE),
    "structural_check_all": (structural_check_all, structural.ORDER_ORACLE),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = {name: partial(_plan, name) for name in sql_plans.PLANS}
    return {name: f for name, (f, _) in (OWN | table_queries.QUERIES).items()} | plans | sample_queries.QUERIES


def _plan(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_sql(spark, sf_dir, sql_plans.spark_sql(name), sql_plans.PLANS[name][0])


def oracle_sql() -> dict[str, str]:
    own = {name: sql for name, (_, sql) in (OWN | table_queries.QUERIES).items() if sql}
    return own | {name: sql_plans.oracle_sql(name) for name in sql_plans.PLANS} | {name: sample_expected.sql(name) for name in sample_expected.EXPECTED}
