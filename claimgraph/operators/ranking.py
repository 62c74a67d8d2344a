"""Ranking operators: BM25 over a postings plan, dense cosine, reciprocal-rank fusion, budgeted selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.words import between

K1, B = 1.2, 0.75
RRF_K = 60
NOT_TOKEN = r"\x00-\x2F\x3A-\x5E\x60\x7B-\x{10FFFF}"


def tokens(text: Column) -> Column:
    return between(F.lower(text), NOT_TOKEN)


def bm25(documents: DataFrame, query: str, k: int = 20) -> DataFrame:
    """(doc_id, score): the k best documents under an OR of the query's terms. Postings are filtered to query terms
    before the shuffle; only counts move."""
    terms = sorted(set(query.lower().split()))
    base = documents.select("doc_id", tokens(F.col("text")).alias("w")).select("doc_id", F.size("w").alias("len"), "w")
    stats = base.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    postings = base.select("doc_id", "len", F.explode(F.filter("w", lambda x: x.isin(terms))).alias("term")).groupBy("doc_id", "len", "term").agg(F.count(F.lit(1)).alias("tf"))
    df = postings.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    scored = postings.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return scored.groupBy("doc_id").agg(F.round(F.sum(part), 6).alias("score")).orderBy(F.col("score").desc(), "doc_id").limit(k)


def cosine_topk(vectors: DataFrame, query_id: int, k: int = 20) -> DataFrame:
    """(vec_id, cosine): the k nearest vectors to one of them, by exact cosine."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    q = vectors.where(F.col("vec_id") == query_id).limit(1).select(F.col("embedding").alias("q"))
    rows = vectors.where(F.col("vec_id") != query_id).crossJoin(F.broadcast(q))
    value = dot(F.col("embedding"), F.col("q")) / F.sqrt(dot(F.col("embedding"), F.col("embedding")) * dot(F.col("q"), F.col("q")))
    return rows.select("vec_id", F.round(value, 6).alias("cosine")).orderBy(F.col("cosine").desc(), "vec_id").limit(k)


def reciprocal_rank_fusion(rankings: list[tuple[DataFrame, float]], key: str, k: int = 20) -> DataFrame:
    """(key, score) from rankings (key, rank from 1) with weights: sum of weight / (60 + rank)."""
    parts = [r.select(key, (F.lit(w) / (RRF_K + F.col("rank"))).alias("part")) for r, w in rankings]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    return every.groupBy(key).agg(F.round(F.sum("part"), 9).alias("score")).orderBy(F.col("score").desc(), key).limit(k)


def ranked(df: DataFrame, key: str, score: str) -> DataFrame:
    """Rank from 1 of an already bounded top list."""
    return df.select(key, F.row_number().over(Window.orderBy(F.col(score).desc(), key)).alias("rank"))


def budget_fit(spans: DataFrame, group: str, order: str, size: str, limit: int, budget: int) -> DataFrame:
    """Greedy choice in order: a span that exceeds what is left is skipped, never cut; at most `limit` are kept."""
    ordered = spans.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(size).alias("size")))).alias("s"))
    start = F.struct(F.array().cast("array<bigint>").alias("kept"), F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("skipped"))

    def step(a: Column, x: Column) -> Column:
        full, over = F.size(a["kept"]) >= limit, a["used"] + x["size"] > budget
        take = ~full & ~over
        return F.struct(F.when(take, F.array_append(a["kept"], x["at"].cast("bigint"))).otherwise(a["kept"]).alias("kept"), (a["used"] + F.when(take, x["size"]).otherwise(0)).cast("bigint").alias("used"), (a["skipped"] + (over & ~full).cast("int")).alias("skipped"))

    return ordered.select(group, F.aggregate("s", start, step).alias("r")).select(group, F.array_join(F.col("r.kept").cast("array<string>"), ",").alias("kept"), "r.used", "r.skipped")
