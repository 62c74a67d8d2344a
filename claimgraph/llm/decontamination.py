"""Benchmark decontamination by a prefix-filtered set join, with built-in functions only.

Items are cut into windows of `window` consecutive words (a shorter item is one window). A window's tokens are its
shingles of three words (of all its words, if it has fewer), ordered by how often the whole corpus holds them, rarest
first: a document place can only hold the window if it holds its rarest shingle, so that one alone, the necessary
prefix, is joined. Candidates that would begin before the document's first word (positional bound) or end behind its
last (length bound) go; the others are verified word for word, over all windows of the item at that shift.

The corpus is cut into shingles once; those that the benchmark knows are written down, counted and joined. The
benchmark's shingles and windows are broadcast when they are at most `BROADCAST_WORDS`, else joined by key; so are
candidates per document, when they and their items' words are at most `BROADCAST_BYTES`. Defined results: null or empty text has no words, windows or hits; an item without words has
no window; items of one id are looked for one by one, and one without an id hits but has no name to be counted; repeated rows give repeated results; documents are told apart by id and a hash of their text.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.functions.words import between, bound
from claimgraph.llm.common import NOT_ALNUM, ascii_lower, checkpoint

WINDOW = 10
SHINGLE = 3
#: Rows (of at most some hundred bytes) up to which a side is broadcast.
BROADCAST_WORDS = 200_000
#: Bytes, roughly, of the candidates of all documents with their items' words up to which they are broadcast.
BROADCAST_BYTES = 32 << 20


def words_of(text: Column) -> Column:
    """Maximal runs of ASCII letters and digits and of other characters than ASCII, with A-Z lower-cased. Plain ASCII
    texts take the fast way; lower() would change other letters as well."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return between(F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(ascii_lower(text)), NOT_ALNUM)


def shingle_hashes(words: Column, size: int) -> Column:
    """Hashes of all runs of so many words, by their start."""
    each = F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(size))))
    return F.when(F.size(words) >= size, each).otherwise(F.array().cast("array<bigint>"))


def _small(df: DataFrame, n: int, most: int) -> DataFrame:
    return F.broadcast(df) if n <= most else df


def item_words(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(key, item, words, m, g) of items that have words: their number and the size of their shingles. The key tells apart
    items of one id, and those without an id."""
    rows = items.select(F.col(id_col).cast("string").alias("item"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0).distinct()
    said = F.when(F.col("item").isNull(), "").otherwise(F.concat(F.lit("="), "item"))
    rows = rows.withColumn("key", F.md5(F.concat(said, F.lit("\0"), F.array_join("words", " ")).cast("binary")))
    return rows.withColumn("m", F.size("words")).withColumn("g", F.least(F.lit(SHINGLE), "m"))


def item_shingles(items: DataFrame, sizes: list[int]) -> DataFrame:
    """(key, m, g, token, at) of item_words' rows."""
    parts = [items.where(F.col("g") == g).select("key", "m", "g", F.posexplode(shingle_hashes(F.col("words"), g)).alias("at", "token")) for g in sizes]
    return reduce(DataFrame.unionByName, parts)


def anchors(shingles: DataFrame, frequency: DataFrame, window: int = WINDOW) -> DataFrame:
    """(token, g, key, m, offset): per window its rarest shingle, at its offset in the item; windows share anchors."""
    rows = shingles.join(frequency, ["g", "token"], "left").withColumn("df", F.coalesce("df", F.lit(0)))
    per_item = rows.groupBy("key", "m", "g").agg(F.array_sort(F.collect_list(F.struct("at", "df", "token"))).alias("w"))
    span = F.least(F.lit(window), F.col("m"))
    best = F.transform(F.sequence(F.lit(0), F.col("m") - span), lambda j: F.array_min(F.transform(F.slice("w", j + 1, span - F.col("g") + 1), lambda x: F.struct(x["df"], x["token"], x["at"]))))
    return per_item.select("key", "m", "g", F.explode(F.array_distinct(best)).alias("b")).select(F.col("b.token").alias("token"), "g", "key", "m", F.col("b.at").alias("offset"))


def hits(documents: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """documents' rows as the struct `row`, n_words, and hits: array<struct<item, start, words>> of matching windows."""
    nothing = F.array().cast("array<struct<item:string,start:int,words:int>>")
    wanted = checkpoint(item_words(items, item_id, item_text))
    sizes = [r["g"] for r in wanted.select("g").distinct().orderBy("g").collect()]  # at most SHINGLE numbers
    if not sizes:
        return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"), nothing.alias("hits"))
    shingles = checkpoint(item_shingles(wanted, sizes))
    vocabulary = checkpoint(shingles.select("g", "token").distinct())
    n_vocabulary = vocabulary.count()
    key = [F.col(id_col).cast("string").alias("__id"), F.xxhash64(F.col(text_col)).alias("__hash")]
    cut = bound(words_of(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), *(shingle_hashes(w, g).alias(f"s{g}") for g in sizes)))
    spoken = documents.select(*key, cut.alias("cut"))
    parts = [spoken.select("__id", "__hash", F.lit(g).alias("g"), F.col("cut.n").alias("n"), F.posexplode(f"cut.s{g}").alias("at", "token")).join(_small(vocabulary.where(F.col("g") == g).select("token"), n_vocabulary, BROADCAST_WORDS), "token", "left_semi") for g in sizes]
    spots = checkpoint(reduce(DataFrame.unionByName, parts))
    rare = checkpoint(anchors(shingles, spots.groupBy("g", "token").agg(F.count(F.lit(1)).alias("df")), window))
    found = spots.join(_small(rare, rare.count(), BROADCAST_WORDS), ["g", "token"])
    shift = F.col("at") - F.col("offset")
    span = F.least(F.lit(window), F.col("m"))
    # A window that holds the anchor begins at most span - g words before it and lies within item and document.
    first, last = F.greatest(F.lit(0), F.col("offset") - span + F.col("g"), -shift), F.least(F.col("offset"), F.col("m") - span, F.col("n") - span - shift)
    found = found.where(first <= last).select("__id", "__hash", "key", shift.alias("shift"), first.alias("first"), last.alias("last"), span.alias("span"))
    candidates = found.groupBy("__id", "__hash", "key", "shift", "span").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    candidates = candidates.join(_small(wanted.select("key", "item", "words"), wanted.count(), BROADCAST_WORDS // 10), "key")
    weight = 64 + F.coalesce(F.octet_length("item"), F.lit(0)) + F.aggregate("words", F.lit(0).cast("long"), lambda a, w: a + 16 + F.octet_length(w))
    per_document = checkpoint(candidates.groupBy("__id", "__hash").agg(F.collect_list(F.struct("item", "shift", "first", "last", "span", "words")).alias("candidates"), F.sum(weight).alias("bytes")))
    total = per_document.agg(F.sum("bytes")).first()[0] or 0
    right = per_document.select(F.col("__id").alias("__i"), F.col("__hash").alias("__h"), "candidates")
    rows = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), *key)
    joined = rows.join(_small(right, total, BROADCAST_BYTES), F.col("__id").eqNullSafe(F.col("__i")) & (F.col("__hash") == F.col("__h")), "left")

    def verified(words: Column, c: Column) -> Column:
        starts = F.filter(F.sequence(c["first"], c["last"]), lambda j: F.slice(words, c["shift"] + j + 1, c["span"]) == F.slice(c["words"], j + 1, c["span"]))
        return F.transform(starts, lambda j: F.struct(c["item"].alias("item"), (c["shift"] + j).alias("start"), c["span"].alias("words")))

    proof = bound(words_of(F.col(f"row.`{text_col}`")), lambda w: F.struct(F.size(w).cast("long").alias("n"), F.coalesce(F.flatten(F.transform("candidates", lambda c: verified(w, c))), nothing).alias("hits")))
    return joined.select("row", proof.alias("p")).select("row", F.col("p.n").alias("n_words"), F.col("p.hits").alias("hits"))


def op10(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The digest columns of the decontamination contract."""
    found = hits(documents, benchmark)
    places = F.array_distinct(F.flatten(F.transform("hits", lambda h: F.sequence(h["start"], h["start"] + h["words"] - 1))))
    named = F.array_sort(F.array_compact(F.array_distinct(F.col("hits.item"))))
    return found.select(F.col("row.doc_id").alias("doc_id"), "n_words", F.size(places).cast("long").alias("n_hit"), F.size(named).cast("long").alias("n_items"), F.sha2(F.array_join(named, ",").cast("binary"), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


#: Plain SQL over all windows, as a check of the join.
ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, least(10, len(w)) AS k, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i, w FROM b WHERE len(w) > 0),
win AS (SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM bw),
ks AS (SELECT DISTINCT k FROM win),
dw AS (SELECT doc_id, k, unnest(range(1, len(w) - k + 2)) AS i, w FROM d, ks WHERE len(w) >= k),
h AS (SELECT dw.doc_id, win.item, dw.i, dw.k FROM dw JOIN win ON win.k = dw.k AND win.s = array_to_string(dw.w[dw.i:dw.i + dw.k - 1], ' ')),
n AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items,
       sha256(coalesce(t.items, '')) AS items_sha256, coalesce(n.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN t USING (doc_id)
"""
