"""Whether retrieved text supports an answer to a question: a gate of conditions, its threshold, and its calibration.

Conditions: the span can be derived again (S1); it holds one of the question's distinctive terms, or all (S2); it holds every
literal of the question (S3); a relation that the question asserts between two known symbols is in the graph (S4). Supported
texts that state several numbers close to a distinctive term conflict (S5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph
from claimgraph.functions.shared import written
from claimgraph.operators import text

# Conditions by design, and the words by which a question asserts a relation.
DESIGNS = {"G1": ("S1", "S2"), "G2": ("S1", "S2", "S3"), "G3": ("S1", "S2", "S3", "S4"), "G4": ("S1", "S2all", "S3", "S4")}
RELATION = r"(?i)\b(call|calls|called|import|imports|imported|use|uses|used|define|defines|defined)\b"
THETAS = (50, 60, 70, 75, 80, 85, 90, 95)
MOST_FALSE_ABSTENTION = 0.30
NEAR = 6


def idf(chunks: DataFrame) -> DataFrame:
    """(token, idf = ln(n / df)) over chunks (chunk_id, body)."""
    n = chunks.agg(F.greatest(F.count(F.lit(1)), F.lit(1)).alias("n"))
    df = chunks.select("chunk_id", F.explode(F.array_distinct(text.tokens(F.col("body")))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    return df.crossJoin(F.broadcast(n)).select("token", F.log(F.col("n") / F.col("df")).alias("idf"))


def distinctive(queries: DataFrame, weights: DataFrame, percentile: int = 80) -> DataFrame:
    """(qid, terms): tokens of a question whose idf reaches that at the percentile of this question's own; tokens that no chunk
    has are the most distinctive of all."""
    tokens = queries.select("qid", F.explode(F.array_distinct(text.tokens(F.col("question")))).alias("token"))
    rows = tokens.join(weights, "token", "left").withColumn("idf", F.coalesce("idf", F.lit(float("inf"))))
    each = rows.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("idf", "token"))).alias("t"))
    cut = F.least(F.size("t") - 1, F.floor(F.size("t") * percentile / 100).cast("int"))
    return each.withColumn("floor", F.get("t", cut)["idf"]).select("qid", F.transform(F.filter("t", lambda x: x["idf"] >= F.col("floor")), lambda x: x["token"]).alias("terms"))


def _stems(tokens: Column) -> Column:
    return F.array_distinct(F.transform(tokens, text.stem))


def related(queries: DataFrame, graph: Graph) -> DataFrame:
    """(qid, grounded): false only for questions that assert a relation between two symbols of the graph between which, in
    either direction, no derived claim stands. Names are compared as parts of qualified names, joined by the token."""
    asked = queries.where(F.rlike("question", F.lit(RELATION))).select("qid", F.explode(F.array_distinct(text.tokens(F.col("question"), split=False))).alias("token"))
    known = graph.symbols.groupBy(F.lower("name").alias("token")).agg(F.min_by("qname", F.struct("symbol_id")).alias("qname"))
    named = asked.join(known, "token").groupBy("qid").agg(F.array_sort(F.collect_set("qname")).alias("names")).where("size(names) >= 2")
    named = named.select("qid", F.get("names", F.lit(0)).alias("one"), F.get("names", F.lit(1)).alias("two"))
    ends = graph.symbols.select("symbol_id", "qname")
    edges = graph.claims.where("establishment = 'DERIVED' AND object_id IS NOT NULL").select("subject_id", "object_id").join(ends.select(F.col("symbol_id").alias("subject_id"), F.col("qname").alias("s")), "subject_id").join(ends.select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("o")), "object_id").select("s", "o").distinct()
    # The few named pairs go to the edges; each edge is looked at once for each of them.
    hit = (F.contains("s", F.col("one")) & F.contains("o", F.col("two"))) | (F.contains("s", F.col("two")) & F.contains("o", F.col("one")))
    found = edges.join(F.broadcast(named), hit).select("qid").distinct().withColumn("grounded", F.lit(True))
    return named.select("qid").join(found, "qid", "left").select("qid", F.coalesce("grounded", F.lit(False)).alias("grounded"))


def gate(queries: DataFrame, hits: DataFrame, chunks: DataFrame, graph: Graph | None, design: str = "G3", percentile: int = 80, weights: DataFrame | None = None) -> DataFrame:
    """(qid, outcome, failed, chunk_id, values) of queries (qid, question) with hits (qid, chunk_id, rank) among chunks (chunk_id,
    rel_path, body): the best supported chunk, or the first condition that failed."""
    conditions = DESIGNS[design]
    terms = distinctive(queries, idf(chunks) if weights is None else weights, percentile)
    literal = F.array_distinct(F.concat(F.regexp_extract_all("question", F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), F.array_except(F.concat(F.regexp_extract_all("question", F.lit(r"'([^']+)'"), F.lit(1)), F.regexp_extract_all("question", F.lit(r'"([^"]+)"'), F.lit(1))), F.array(F.lit("")))))
    rows = hits.select("qid", "chunk_id", "rank").join(queries.select("qid", literal.alias("literals")), "qid").join(terms, "qid", "left").join(chunks.select("chunk_id", "rel_path", "body"), "chunk_id")
    rows = rows.withColumn("words", text.tokens(F.col("body"))).withColumn("wanted", _stems(F.coalesce("terms", F.array().cast("array<string>"))))
    have = _stems(F.col("words"))
    word = lambda x: F.rlike(F.col("body"), F.concat(F.lit(r"(?U)\b\Q"), x, F.lit(r"\E\b")))
    tests = {"S1": F.length("body") > 0, "S2": F.arrays_overlap("wanted", have) & (F.size("wanted") > 0), "S2all": (F.size("wanted") > 0) & (F.size(F.array_except("wanted", have)) == 0), "S3": F.forall("literals", word)}
    failed = F.coalesce(*(F.when(~F.coalesce(tests[c], F.lit(False)), F.lit(c)) for c in conditions if c in tests), F.lit(None).cast("string"))
    rows = written(rows.withColumn("failed", failed), "gate")
    best = rows.groupBy("qid").agg(F.min_by(F.when(F.col("failed").isNull(), F.col("chunk_id")), F.when(F.col("failed").isNull(), F.col("rank"))).alias("chunk_id"), F.min_by("failed", F.when(F.col("failed").isNotNull(), F.col("rank"))).alias("first_failed"))
    numbers = rows.where("failed IS NULL").select("qid", "rel_path", "wanted", "words", F.posexplode("words").alias("at", "w")).where(F.array_contains("wanted", text.stem(F.col("w"))))
    about = F.slice("words", F.greatest(F.col("at") - NEAR, F.lit(0)) + 1, F.col("at") + NEAR + 1 - F.greatest(F.col("at") - NEAR, F.lit(0)))
    values = numbers.select("qid", F.explode(about).alias("v")).where(F.rlike("v", F.lit("^[0-9]{1,4}$"))).groupBy("qid").agg(F.array_sort(F.collect_set("v")).alias("values"))
    out = queries.select("qid").join(best, "qid", "left").join(values, "qid", "left")
    if graph is not None and "S4" in conditions:
        out = out.join(related(queries, graph), "qid", "left")
    else:
        out = out.withColumn("grounded", F.lit(True))
    none, ungrounded = F.col("chunk_id").isNull(), ~F.coalesce("grounded", F.lit(True))
    hit = hits.select("qid").distinct().withColumn("any", F.lit(True))
    out = out.join(hit, "qid", "left")
    why = F.when(F.col("any").isNull(), "S0").when(ungrounded, "S4").when(none, F.coalesce("first_failed", F.lit("S2")))
    several = F.size(F.coalesce("values", F.array().cast("array<string>"))) > 1
    outcome = F.when(why.isNotNull(), "ABSTAIN").when(several, "EXPOSE_CONFLICTED").otherwise("EXPOSE")
    return out.select("qid", outcome.alias("outcome"), why.alias("failed"), F.when(why.isNull(), F.col("chunk_id")).alias("chunk_id"), F.when(why.isNull() & several, F.col("values")).alias("values"))


def calibrated(scored: DataFrame) -> DataFrame:
    """The one chosen row of (theta, false_support, false_abstention): of those with a false abstention of 0.30 at most, or of all if
    there is none, the least false support, then the least false abstention, then the least theta."""
    open_ = F.max((F.col("false_abstention") <= MOST_FALSE_ABSTENTION).cast("int")).over(Window.partitionBy())
    rows = scored.withColumn("some", open_).where((F.col("some") == 0) | (F.col("false_abstention") <= MOST_FALSE_ABSTENTION))
    return rows.orderBy("false_support", "false_abstention", "theta").limit(1).select("theta", "false_support", "false_abstention")


def split(items: DataFrame, strata: list[str], parts: list[str], tag: str = "split") -> DataFrame:
    """items (id, strata...) with `split`: dealt in turn within each stratum in the order of a hash of the tagged id, beginning
    at a place that the stratum's own hash names."""
    key = F.sha2(F.concat_ws("\x1f", F.lit(tag), F.col("id").cast("string")), 256)
    offset = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(tag), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in strata)), 256), 1, 8), 16, 10).cast("long")
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(key, "id")) - 1
    return items.withColumn("split", F.element_at(F.array(*map(F.lit, parts)), ((place + offset) % len(parts) + 1).cast("int")))
