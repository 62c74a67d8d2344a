"""Rankers over chunks of text for many questions at once: exact identifiers, BM25, latent semantics, graph, and fusions.

Queries are (qid, question), chunks (chunk_id, rel_path, symbol, body); a ranking is (qid, chunk_id, rank, score), rank from 1.
Postings are restricted to the words that some query has before anything is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.compiler.compile import Graph
from claimgraph.functions.shared import written
from claimgraph.functions.words import between
from claimgraph.operators import text
from claimgraph.operators.graph_reads import EXPANDED, PER_HOP
from claimgraph.operators.ranking import K1, RRF_K, B

TOP = 10
# Kinds of symbols whose source is a span, and the least characters of a span.
SPAN_KINDS = ("function", "method", "class", "page", "paragraph", "table")
SPAN_CHARS = 40


def top(scored: DataFrame, k: int = TOP) -> DataFrame:
    """The k best (qid, chunk_id, score) of each query with their rank; of equal scores the lesser id first."""
    w = Window.partitionBy("qid").orderBy(F.col("score").desc(), "chunk_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("qid", "chunk_id", "rank", "score")


# --- words as a full-text index has them -----------------------------------------------------------------------------------

_VOWELS = "aeiou"


def _is_consonant(w: str, i: int) -> bool:
    return w[i] not in _VOWELS and (w[i] != "y" or i == 0 or not _is_consonant(w, i - 1))


def _measure(w: str) -> int:
    """How many runs of vowels are followed by a consonant."""
    kinds = [_is_consonant(w, i) for i in range(len(w))]
    return sum(not a and b for a, b in zip(kinds, kinds[1:], strict=False))


def _has_vowel(w: str) -> bool:
    return not all(_is_consonant(w, i) for i in range(len(w)))


def _doubled(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _is_consonant(w, len(w) - 1)


def _short(w: str) -> bool:
    n = len(w)
    return n > 2 and _is_consonant(w, n - 1) and not _is_consonant(w, n - 2) and _is_consonant(w, n - 3) and w[-1] not in "wxy"


# Fixed values of the published stemming algorithm (Porter 1980): endings of its steps 2, 3 and 4.
_STEP2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
_STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _longest(w: str, endings: Iterator[str] | list[str]) -> str | None:
    return max((e for e in endings if w.endswith(e)), key=len, default=None)


@lru_cache(1 << 16)
def porter(w: str) -> str:
    """The stem of a lower-cased word; words of other letters than a to z stay."""
    if len(w) < 3 or not w.isascii() or not w.isalpha():
        return w
    if w.endswith("s") and not w.endswith("ss"):
        w = w[:-2] if w.endswith(("sses", "ies")) else w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (e := _longest(w, ["ed", "ing"])) and _has_vowel(w[: -len(e)]):
        w = w[: -len(e)]
        if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w) and not _doubled(w)):
            w += "e"
        elif _doubled(w) and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for endings in (_STEP2, _STEP3):
        if (e := _longest(w, list(endings))) and _measure(w[: -len(e)]) > 0:
            w = w[: -len(e)] + endings[e]
    if e := _longest(w, _STEP4):
        rest = w[: -len(e)]
        if _measure(rest) > 1 and (e != "ion" or rest.endswith(("s", "t"))):
            w = rest
    if w.endswith("e") and (_measure(w[:-1]) > 1 or _measure(w[:-1]) == 1 and not _short(w[:-1])):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stemmed(words: pa.Array) -> pa.Array:
    return pa.array([None if ws is None else [porter(w) for w in ws] for ws in words.to_pylist()], pa.list_(pa.string()))


def stems(words: Column) -> Column:
    """The stems of an array of lower-cased words, whole Arrow batches at a time."""
    return F.arrow_udf(_stemmed, "array<string>")(words)


def index_words(body: Column) -> Column:
    """Stemmed runs of letters and digits, lower-cased, as the full-text index has them."""
    return stems(between(F.lower(F.coalesce(body, F.lit(""))), r"^\p{L}\p{N}"))


# --- rankers ---------------------------------------------------------------------------------------------------------------



def bm25(chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Rankings of chunks (chunk_id, words) for queries (qid, words): any word may match; the weight of a word that most chunks
    have is as good as nothing, but not below it."""
    wanted = written(queries.select("qid", F.explode(F.array_distinct("words")).alias("word")), "wanted")
    vocabulary = F.broadcast(wanted.select("word").distinct())
    sized = chunks.select("chunk_id", F.size("words").alias("len"), "words")
    total = sized.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    postings = written(sized.select("chunk_id", "len", F.explode("words").alias("word")).join(vocabulary, "word", "left_semi").groupBy("word", "chunk_id", "len").agg(F.count(F.lit(1)).alias("tf")), "postings")
    df = postings.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    weights = df.crossJoin(F.broadcast(total)).select("word", F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6)).alias("idf"), "avg_len")
    rows = postings.join(weights, "word").join(wanted, "word")
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg_len")))
    return top(rows.groupBy("qid", "chunk_id").agg(F.round(F.sum(part), 9).alias("score")), k)


def exact(chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """Chunks in which an identifier of the question (its last part) stands as a whole word: 2 if the chunk's symbol ends with
    it, else 1; the first identifier that is found counts."""
    named = F.filter(F.regexp_extract_all("question", F.lit(r"[A-Za-z_][A-Za-z0-9_.]*"), F.lit(0)), lambda t: F.rlike(t, F.lit("[A-Z]")) | F.contains(t, F.lit(".")))
    names = written(queries.select("qid", F.posexplode(named).alias("at", "name")).withColumn("bare", F.substring_index("name", ".", -1)).where("bare <> ''"), "names")
    words = chunks.select("chunk_id", "symbol", F.explode(F.array_distinct(between(F.coalesce("body", F.lit("")), r"^\p{L}\p{N}\p{M}_"))).alias("bare"))
    found = words.join(F.broadcast(names), "bare")
    first = found.groupBy("qid", "chunk_id").agg(F.min_by(F.struct("bare", "symbol"), "at").alias("f"))
    score = F.when(F.col("f.symbol").endswith(F.col("f.bare")), 2.0).otherwise(1.0)
    return top(first.select("qid", "chunk_id", score.alias("score")), k)


def lexical(chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """BM25 over the tokens of each chunk, with their parts, and its text."""
    spoken = chunks.select("chunk_id", index_words(F.concat_ws(" ", F.array_join(text.tokens(F.col("body")), " "), "body")).alias("words"))
    asked = queries.select("qid", index_words(F.array_join(F.array_distinct(text.tokens(F.col("question"))), " ")).alias("words"))
    return bm25(spoken, asked, k)


def spans(graph: Graph) -> DataFrame:
    """(chunk_id = evidence_id, rel_path, symbol, kind, quote, body) of definitions and units of some length; the body starts with the
    qualified name's parts and the docstring."""
    rows = graph.claims.where("predicate = 'CONTAINS'").join(graph.symbols.where(F.col("kind").isin(*SPAN_KINDS)).select(F.col("symbol_id").alias("object_id"), F.col("qname").alias("symbol"), "kind", "docstring", "rel_path"), "object_id")
    rows = rows.join(graph.claim_evidence, "claim_id").join(graph.evidence.select("evidence_id", "quote"), "evidence_id").where(F.length("quote") >= SPAN_CHARS)
    named = F.translate("symbol", "._", "  ")
    body = F.concat(named, F.lit("\n"), F.coalesce("docstring", F.lit("")), F.lit("\n"), F.col("quote"))
    return rows.withColumn("body", body).groupBy("evidence_id").agg(F.min(F.struct("symbol", "kind", "rel_path", "quote", "body")).alias("s")).select(F.col("evidence_id").alias("chunk_id"), "s.*")


def span_search(graph: Graph, queries: DataFrame, k: int = 5) -> DataFrame:
    """BM25 over spans, by the words of a question that have more than two characters and are no question words."""
    asked = F.filter(F.split("question", "[^A-Za-z0-9_]+"), lambda t: (F.length(t) > 2) & ~F.lower(t).isin(*text.QUESTION_WORDS))
    words = F.flatten(F.transform(asked, lambda t: F.split(t, "_")))
    wanted = queries.select("qid", stems(F.filter(F.transform(words, F.lower), lambda w: w != "")).alias("words"))
    return bm25(spans(graph).select("chunk_id", index_words(F.col("body")).alias("words")), wanted, k)


def latent(chunks: DataFrame, queries: DataFrame, k: int = TOP, dimensions: int = 64, vocabulary: int = 1 << 16) -> DataFrame:
    """Cosine in the space of the largest singular values of the chunks' weighted words (length-normalised counts times
    ln((1 + n) / (1 + df)) + 1); only chunks that are alike at all. The decomposition is distributed; what the driver holds is
    one column for each of the `vocabulary` most frequent words at most, in `dimensions` numbers."""
    from pyspark.mllib.linalg import Vectors
    from pyspark.mllib.linalg.distributed import RowMatrix

    tokens = written(chunks.select("chunk_id", F.explode(text.tokens(F.col("body"))).alias("word")).groupBy("chunk_id", "word").agg(F.count(F.lit(1)).alias("tf")), "tokens")
    n = chunks.count()
    df = tokens.groupBy("word").agg(F.count(F.lit(1)).alias("df")).orderBy(F.col("df").desc(), "word").limit(vocabulary)
    place = {r["word"]: (i, r["df"]) for i, r in enumerate(df.collect())}
    if not place or not n:
        return top(queries.select("qid", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score")).limit(0), k)
    spark = chunks.sparkSession
    words = written(spark.createDataFrame([(w, i, d) for w, (i, d) in place.items()], "word string, at int, df long").withColumn("idf", F.log((F.lit(1.0) + n) / (1.0 + F.col("df"))) + 1), "words")

    def weighted(counts: DataFrame, key: str) -> DataFrame:
        rows = counts.join(F.broadcast(words), "word").groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", (F.col("tf") * F.col("idf")).alias("w")))).alias("v"))
        norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x["w"] * x["w"]))
        return rows.withColumn("v", F.transform("v", lambda x: F.struct(x["at"].alias("at"), (x["w"] / norm).alias("w"))))

    docs = written(weighted(tokens, "chunk_id"), "vectors")
    width = len(place)
    matrix = RowMatrix(docs.rdd.map(lambda r: Vectors.sparse(width, [x["at"] for x in r["v"]], [x["w"] for x in r["v"]])))
    axes = matrix.computeSVD(min(dimensions, width, n), rCond=1e-9).V.toArray()
    rows = written(spark.createDataFrame([(i, [float(x) for x in axes[i]]) for i in range(width)], "at int, axis array<double>"), "axes")

    def projected(df: DataFrame, key: str) -> DataFrame:
        parts = df.select(key, F.explode("v").alias("x")).select(key, "x.at", "x.w").join(F.broadcast(rows), "at").select(key, F.posexplode(F.transform("axis", lambda a: a * F.col("w"))).alias("dim", "value"))
        point = parts.groupBy(key, "dim").agg(F.sum("value").alias("value")).groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "value"))), lambda x: x["value"]).alias("p"))
        norm = F.sqrt(F.aggregate("p", F.lit(0.0), lambda a, x: a + x * x))
        return point.where(norm > 1e-12).withColumn("p", F.transform("p", lambda x: x / norm))

    asked = queries.select("qid", F.explode(text.tokens(F.col("question"))).alias("word")).groupBy("qid", "word").agg(F.count(F.lit(1)).alias("tf"))
    q = projected(weighted(asked, "qid"), "qid").withColumnRenamed("p", "qp")
    # Each query is compared with all chunks: a stated set of queries, broadcast, against rows that stay where they are.
    cosine = F.aggregate(F.zip_with("p", "qp", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return top(projected(docs, "chunk_id").crossJoin(F.broadcast(q)).select("qid", "chunk_id", F.round(cosine, 9).alias("score")).where("score > 0"), k)


def fused(rankings: list[tuple[DataFrame, float]], k: int = TOP) -> DataFrame:
    """Sums of weight / (60 + rank) over rankings."""
    parts = None
    for ranking, weight in rankings:
        one = ranking.select("qid", "chunk_id", (F.lit(weight) / (RRF_K + F.col("rank"))).alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    return top(parts.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score")), k)


def graph_ranked(graph: Graph, chunks: DataFrame, seeds: DataFrame, k: int = TOP, depth: int = 2) -> DataFrame:
    """Chunks of symbols that the symbols of seed chunks (qid, chunk_id) reach within `depth` edges, by 0.6 a hop, damped by how
    many claims point at the symbol. All queries walk together."""
    claims = graph.claims.where(F.col("predicate").isin(*EXPANDED) & F.col("object_id").isNotNull()).select("subject_id", "object_id")
    both = written(claims.select(F.col("subject_id").alias("a"), F.col("object_id").alias("b")).union(claims.select("object_id", "subject_id")).distinct(), "both")
    names = chunks.where("symbol IS NOT NULL").select("chunk_id", F.col("symbol").alias("qname"))
    layer = seeds.join(names, "chunk_id").join(graph.symbols.select("qname", F.col("symbol_id").alias("a")), "qname").select("qid", "a").distinct()
    layers = None
    for d in range(1, depth + 1):
        layer = written(layer.join(both, "a").select("qid", F.col("b").alias("a")).distinct(), "layer")
        one = layer.select("qid", F.col("a").alias("symbol_id"), F.lit(d).alias("depth"))
        layers = one if layers is None else layers.unionByName(one)
    into = graph.claims.where("object_id IS NOT NULL").groupBy(F.col("object_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("into"))
    reach = layers.groupBy("qid", "symbol_id").agg(F.min("depth").alias("depth")).join(into, "symbol_id", "left").join(graph.symbols.select("symbol_id", "qname"), "symbol_id")
    score = F.pow(F.lit(PER_HOP), F.col("depth")) / (1 + F.log1p(F.coalesce("into", F.lit(0)).cast("double")))
    return top(reach.join(names, "qname").groupBy("qid", "chunk_id").agg(F.round(F.max(score), 9).alias("score")), k)


def _first(ranking: DataFrame, n: int = 3) -> DataFrame:
    return ranking.where(F.col("rank") <= n).select("qid", "chunk_id").distinct()


def lexical_and_graph(graph: Graph, chunks: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    lex = written(lexical(chunks, queries, k), "lexical")
    return fused([(lex, 1.0), (graph_ranked(graph, chunks, _first(lex), k), 0.5)], k)


def hybrid(chunks: DataFrame, queries: DataFrame, k: int = TOP, graph: Graph | None = None) -> DataFrame:
    """Lexical and latent rankings fused; with a graph also what their first hits reach, at half the weight."""
    lex, dense = written(lexical(chunks, queries, k), "lexical"), written(latent(chunks, queries, k), "latent")
    parts = [(lex, 1.0), (dense, 1.0)]
    if graph is not None:
        # The first three of the lexical hits followed by the latent ones.
        n = lex.groupBy("qid").agg(F.count(F.lit(1)).alias("lexical"))
        after = dense.join(n, "qid", "left").withColumn("rank", F.col("rank") + F.coalesce("lexical", F.lit(0)))
        parts.append((graph_ranked(graph, chunks, _first(lex.select("qid", "chunk_id", "rank").unionByName(after.select("qid", "chunk_id", "rank"))), k), 0.5))
    return fused(parts, k)


def symbol_chunks(graph: Graph, texts: DataFrame) -> DataFrame:
    """(chunk_id, rel_path, symbol, body): the source of each symbol other than modules, one chunk a name and file, and the
    records of other files (rel_path, seq, body)."""
    code = graph.symbols.where("kind <> 'module' AND media_type = 'text/x-python'").groupBy("rel_path", "qname").agg(F.min_by("quote", F.struct("byte_start", "byte_end")).alias("body"))
    code = code.select(F.concat("rel_path", F.lit("#"), "qname").alias("chunk_id"), "rel_path", F.col("qname").alias("symbol"), "body")
    other = texts.where(~F.col("rel_path").endswith(".py")).select(F.concat("rel_path", F.lit("#"), F.col("seq").cast("string")).alias("chunk_id"), "rel_path", F.lit(None).cast("string").alias("symbol"), "body")
    return code.unionByName(other)
