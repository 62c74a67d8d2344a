"""Operators over whole driver tables, with oracles written apart from the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimgraph.functions.shared import shared_path, written
from claimgraph.operators import answers, measures, support, text, traversal, values, vectors, verification
from claimgraph.sources.tables import run_sql, table
from claimgraph.store import changes
from claimgraph.streaming import ingest
from claimgraph.plans import sql_plans


def value_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of parts as minutes against the same in seconds, hours, bytes and as bare numbers."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    left = F.concat(F.col("p_size").cast("string"), F.lit(" min"))
    said = F.explode(F.array(F.concat((F.col("p_size") * 60).cast("string"), F.lit(" s")), F.concat(F.col("p_size").cast("string"), F.lit(" hours")), F.concat(F.col("p_size").cast("string"), F.lit(" bytes")), F.col("p_size").cast("string"), (F.col("p_size") + 1).cast("string")))
    rows = part.select("p_partkey", left.alias("a"), said.alias("b"))
    return rows.groupBy("p_partkey", values.compare(values.parse(F.col("a")), values.parse(F.col("b"))).alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


VALUE_UNITS = """WITH p AS (SELECT p_partkey FROM part) SELECT p_partkey, 'SAME' AS verdict, CAST(2 AS BIGINT) AS n FROM p
UNION ALL SELECT p_partkey, 'DIFFERENT', 1 FROM p UNION ALL SELECT p_partkey, 'UNRESOLVED', 2 FROM p"""


def functional_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line status as the value of a part: parts with both values conflict."""
    lines = table(spark, sf_dir, "lineitem")
    claims = lines.select(F.format_string("%012d.%03d", F.col("l_orderkey"), F.col("l_linenumber")).alias("claim_id"), F.col("l_partkey").alias("subject"), F.lit("HAS_VALUE").alias("predicate"), F.concat(F.lit("'"), "l_linestatus", F.lit("'")).alias("value"))
    return values.conflicts(claims, "subject")


FUNCTIONAL_CONFLICTS = """WITH v AS (SELECT l_partkey AS subject, concat('''', l_linestatus, '''') AS value, min(printf('%012d.%03d', l_orderkey, l_linenumber)) AS claim_id FROM lineitem GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY claim_id) AS k, count(*) OVER (PARTITION BY subject) AS n FROM v)
SELECT a.subject, 'HAS_VALUE' AS predicate, a.claim_id AS left_claim, b.claim_id AS right_claim, a.value AS left_value, b.value AS right_value, CAST(a.n * (a.n - 1) / 2 AS BIGINT) AS pairs FROM r a JOIN r b ON a.subject = b.subject AND a.k = 1 AND b.k = 2"""


def term_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents have a token, and its idf, over all of them."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body"))
    return support.idf(docs).select("token", F.round("idf", 6).alias("idf"))


_STOP = ", ".join(f"'{w}'" for w in text.STOPWORDS)
TERM_IDF = rf"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-z_][A-Za-z0-9_]*|\d+')) AS w FROM documents),
p AS (SELECT doc_id, regexp_extract_all(replace(regexp_replace(w, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '_', ' '), '[^ ]+') AS parts, w FROM t),
a AS (SELECT doc_id, lower(w) AS token FROM p UNION ALL SELECT doc_id, lower(unnest(parts)) FROM p WHERE len(parts) > 1),
d AS (SELECT token, count(DISTINCT doc_id) AS df FROM a WHERE length(token) > 1 AND token NOT IN ({_STOP}) GROUP BY token)
SELECT token, round(ln((SELECT count(*) FROM documents) / df), 6) AS idf FROM d"""


def dense_cosine_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return vectors.cosine_topk_all(rows, rows.where("vec_id % 20 = 0"))


DENSE_COSINE_ALL = """WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.v, e.v) / (sqrt(list_dot_product(q.v, q.v)) * sqrt(list_dot_product(e.v, e.v))), 6) AS cosine FROM q JOIN e ON q.vec_id <> e.vec_id)
SELECT query_id, vec_id, cosine, CAST(row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, vec_id) AS INTEGER) AS rank FROM s QUALIFY rank <= 20"""


def work_queue_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger of users' events as work: queued, started, some finished well and some not, and queued again by other events."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))
    users = written(users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("item_id"), "events"), "users")
    items = users.select("item_id", F.lit("run").alias("run_id"), F.lit("extract").alias("stage"), F.col("item_id").alias("target"), F.sha2("item_id", 256).alias("input_hash"))
    nothing = spark.createDataFrame([], "item_id string, run_id string, stage string, target string, input_hash string, state string, attempts int, error string")
    work = changes.start(changes.enqueue(nothing, items), items)
    done = F.when(F.col("events") % 3 == 0, "DONE").when(F.col("events") % 3 == 1, "FAILED")
    work = changes.finish(work, users.select("item_id", done.alias("state"), F.when(done == "FAILED", "fault").alias("error")).where("state IS NOT NULL"))
    work = changes.requeue(written(work, "work"), "run")
    again = items.join(users.where("events % 2 = 0").select("item_id"), "item_id", "left_semi")
    return changes.enqueue(work, again).select("item_id", "state", "attempts", "error")


WORK_QUEUE_CYCLE = """WITH u AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS item_id, count(*) AS n FROM events GROUP BY user_id)
SELECT item_id, CASE WHEN n % 2 = 0 OR n % 3 = 2 THEN 'PENDING' WHEN n % 3 = 0 THEN 'DONE' ELSE 'FAILED' END AS state, CASE WHEN n % 3 = 0 THEN 0 ELSE 1 END AS attempts, CASE WHEN n % 2 = 1 AND n % 3 = 1 THEN 'fault' END AS error FROM u"""


def tables_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of whole tables, alike for the same rows in any order."""
    columns = {"region": ["r_regionkey", "r_name"], "nation": ["n_nationkey", "n_name", "n_regionkey"], "customer": ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], "part": ["p_partkey", "p_name", "p_brand", "p_size"], "orders": ["o_orderkey", "o_custkey", "o_orderstatus"], "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], "labels": ["doc_id", "quality", "toxic"]}
    return changes.digest({name: table(spark, sf_dir, name).select(cs) for name, cs in columns.items()})


def _digest_sql(name: str, columns: list[str], text: tuple[str, ...]) -> str:
    shown = ", ',', ".join(f"""'"{c}":', {f"concat('\"', {c}, '\"')" if c in text else f"CAST({c} AS VARCHAR)"}""" for c in sorted(columns))
    return f"""SELECT '{name}' AS name, count(*) AS rows, sha256(concat_ws(chr(31), CAST(count(*) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 1, 15)) AS BIGINT)) AS VARCHAR), CAST(sum(CAST(concat('0x', substr(h, 16, 15)) AS BIGINT)) AS VARCHAR))) AS digest FROM (SELECT sha256(concat('{{', {shown}, '}}')) AS h FROM {name}) x"""


TABLES_DIGEST = " UNION ALL ".join(
    _digest_sql(name, columns, text_columns)
    for name, columns, text_columns in (
        ("region", ["r_regionkey", "r_name"], ("r_name",)),
        ("nation", ["n_nationkey", "n_name", "n_regionkey"], ("n_name",)),
        ("customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"], ("c_name", "c_mktsegment")),
        ("part", ["p_partkey", "p_name", "p_brand", "p_size"], ("p_name", "p_brand")),
        ("orders", ["o_orderkey", "o_custkey", "o_orderstatus"], ("o_orderstatus",)),
        ("lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"], ()),
        ("labels", ["doc_id", "quality", "toxic"], ()),
    )
)


def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents dealt to three parts within each pair of labels."""
    rows = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), "quality", "toxic")
    return support.split(rows, ["quality", "toxic"], ["CALIBRATION", "VALIDATION", "TEST"]).select("id", "split")


STRATIFIED_SPLIT = """WITH r AS (SELECT doc_id AS id, quality, toxic, row_number() OVER (PARTITION BY quality, toxic ORDER BY sha256(concat_ws(chr(31), 'split', CAST(doc_id AS VARCHAR))), doc_id) - 1 AS k,
CAST(concat('0x', substr(sha256(concat_ws(chr(31), 'split', coalesce(CAST(quality AS VARCHAR), ''), coalesce(CAST(toxic AS VARCHAR), ''))), 1, 8)) AS BIGINT) AS o FROM labels)
SELECT id, ['CALIBRATION', 'VALIDATION', 'TEST'][CAST((k + o) % 3 AS BIGINT) + 1] AS split FROM r"""


def ranking_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source as a query whose documents are ranked by length; documents of poor quality are the relevant ones."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    ranked = docs.select("source", "doc_id", F.row_number().over(_by_length()).alias("rank"), "quality", "lang")
    ranked = written(ranked.withColumn("qid", F.coalesce("source", F.lit(""))), "ranked")
    relevant = ranked.where("quality = 0").select("qid", F.col("doc_id").alias("item"), F.upper(F.substring("qid", 1, 4)).alias("stratum"))
    return measures.retrieval(ranked.select("qid", F.col("doc_id").alias("item"), "rank"), relevant, by=["stratum"])


def _by_length() -> object:
    from pyspark.sql import Window

    return Window.partitionBy("source").orderBy(F.col("n_chars").desc(), "doc_id")


RANKING_MEASURES = """WITH r AS (SELECT coalesce(d.source, '') AS qid, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id),
f AS (SELECT qid, upper(substr(qid, 1, 4)) AS stratum, min(rank) AS first FROM r WHERE quality = 0 GROUP BY qid)
SELECT stratum, count(*) AS queries, round(avg(CASE WHEN first <= 1 THEN 1.0 ELSE 0.0 END), 4) AS recall_1, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 4) AS recall_5, round(avg(CASE WHEN first <= 10 THEN 1.0 ELSE 0.0 END), 4) AS recall_10, round(avg(1.0 / first), 4) AS mrr FROM f GROUP BY stratum"""


def consensus_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two judges of each labelled document, one by quality and one by toxicity; the worse of two labels stands."""
    labels = table(spark, sf_dir, "labels")
    judged = labels.select(F.col("doc_id").alias("item"), F.explode(F.array(F.struct(F.lit("q").alias("judge"), F.when(F.col("quality") == 1, "SUPPORTED").otherwise("PARTIAL").alias("label")), F.struct(F.lit("t").alias("judge"), F.when(F.col("toxic") == 1, "CONTRADICTED").otherwise("SUPPORTED").alias("label")))).alias("j")).select("item", "j.*")
    return answers.consensus(judged, ["CONTRADICTED", "UNSUPPORTED", "NOT_DETERMINABLE", "PARTIAL", "SUPPORTED"])


CONSENSUS_LABELS = "SELECT doc_id AS item, CASE WHEN toxic = 1 THEN 'CONTRADICTED' WHEN quality = 0 THEN 'PARTIAL' ELSE 'SUPPORTED' END AS label, toxic = 0 AND quality = 1 AS unanimous FROM labels"


def insert_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents put into the table of one source's: contents that are there stay as they are, new ones come once."""
    docs = table(spark, sf_dir, "documents").select(F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"), "doc_id", "source")
    first = docs.groupBy("sha").agg(F.min("doc_id").alias("doc_id")).select("sha", "doc_id")
    held = docs.where("source = 'src1'").groupBy("sha").agg(F.max("doc_id").alias("doc_id")).select("sha", "doc_id")
    return changes.insert_missing(held, first, "sha")


INSERT_MISSING = """WITH d AS (SELECT sha256(coalesce(text, '')) AS sha, doc_id, source FROM documents), h AS (SELECT sha, max(doc_id) AS doc_id FROM d WHERE source = 'src1' GROUP BY sha), f AS (SELECT sha, min(doc_id) AS doc_id FROM d GROUP BY sha)
SELECT f.sha, coalesce(h.doc_id, f.doc_id) AS doc_id FROM f LEFT JOIN h ON f.sha = h.sha"""


def block_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of each document between blank lines, with their offsets in characters."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n\n", -1).alias("b"))
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,n:bigint,blank:boolean>>").alias("out"))
    step = lambda s, b: F.struct((s["at"] + F.length(b) + 2).alias("at"), F.array_append(s["out"], F.struct(s["at"].alias("start"), F.length(b).cast("long").alias("n"), F.rlike(b, F.lit(r"^\s*$")).alias("blank"))).alias("out"))
    return docs.select("doc_id", F.explode(F.aggregate("b", start, step, lambda s: s["out"])).alias("x")).where("NOT x.blank").select("doc_id", F.col("x.start").alias("char_start"), F.col("x.n").alias("n_chars"))


BLOCK_OFFSETS = r"""WITH d AS (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS b FROM documents), p AS (SELECT doc_id, unnest(b) AS block, unnest(range(1, len(b) + 1)) AS i FROM d),
o AS (SELECT doc_id, block, CAST(sum(length(block) + 2) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) - length(block) - 2 AS char_start FROM p)
SELECT doc_id, char_start, length(block) AS n_chars FROM o WHERE NOT regexp_matches(block, '^\s*$')"""


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a stream of files, taken in twice: the second run finds nothing new."""
    path, schema = f"{sf_dir}/documents.parque[t]", table(spark, sf_dir, "documents").schema
    out = shared_path(spark, "ingested")
    for _ in range(2):
        ingest.ingest_texts(spark, path, schema, out, shared_path(spark, "offsets"))
    return spark.read.schema("sha string, doc_id long").parquet(out)


STREAM_INGEST = "SELECT sha256(coalesce(text, '')) AS sha, min(doc_id) AS doc_id FROM documents GROUP BY 1"


def evidence_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents hold each quotation, by the anchor join."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", "text")
    return verification.verify_quotations(docs, items).groupBy("item_id").agg(F.count(F.lit(1)).alias("evidence"), F.min("doc_id").alias("first_doc"))


EVIDENCE_BRIDGE = """WITH e AS (SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text) WHERE length(b.text) > 0)
SELECT item_id, count(*) AS evidence, min(doc_id) AS first_doc FROM e GROUP BY item_id"""


def expand_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best nodes within two edges of a customer, over edges that are written once."""
    edges = written(run_sql(spark, sf_dir, sql_plans.EDGES.replace("{text}", "STRING"), ("orders", "lineitem", "customer")), "edges")
    return traversal.ranked(edges, spark.createDataFrame([("customer:1",)], "node string"))


EXPAND_RANKED = f"""WITH e AS ({sql_plans.EDGES.replace("{text}", "VARCHAR")}), u AS (SELECT subject AS a, object AS b FROM e UNION ALL SELECT object, subject FROM e),
h1 AS (SELECT DISTINCT b AS node FROM u WHERE a = 'customer:1'), h2 AS (SELECT DISTINCT u.b AS node FROM u JOIN h1 ON u.a = h1.node),
r AS (SELECT node, min(depth) AS depth FROM (SELECT node, 1 AS depth FROM h1 UNION ALL SELECT node, 2 FROM h2) x WHERE node <> 'customer:1' GROUP BY node),
i AS (SELECT object AS node, count(*) AS indeg FROM e GROUP BY object)
SELECT r.node, r.depth, round(power(0.6, r.depth) / (1 + ln(1 + coalesce(i.indeg, 0))), 6) AS score, (SELECT count(*) FROM r) AS total_reachable FROM r LEFT JOIN i ON r.node = i.node ORDER BY score DESC, r.node LIMIT 20"""

QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str]] = {f.__name__: (f, sql) for f, sql in ((value_units, VALUE_UNITS), (functional_conflicts, FUNCTIONAL_CONFLICTS), (term_idf, TERM_IDF), (dense_cosine_all, DENSE_COSINE_ALL), (work_queue_cycle, WORK_QUEUE_CYCLE), (tables_digest, TABLES_DIGEST), (stratified_split, STRATIFIED_SPLIT), (ranking_measures, RANKING_MEASURES), (consensus_labels, CONSENSUS_LABELS), (insert_missing, INSERT_MISSING), (block_offsets, BLOCK_OFFSETS), (stream_ingest, STREAM_INGEST), (evidence_bridge, EVIDENCE_BRIDGE), (expand_ranked, EXPAND_RANKED))}
