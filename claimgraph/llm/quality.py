"""Quality classifier with hierarchical empirical Bayes over sites.

A logistic regression on measures of the text (symbols, capitals, separators, repetition, length) gives each document
a probability of being good. Per host and per path these probabilities are summed by grouped aggregation. A host's
posterior share is its sum shrunk toward the global share, a path's is its own sum shrunk toward its host's posterior;
how strongly, follows from the spread between hosts and between paths (method of moments), so sparse sites keep
close to their prior. A document's score adds to its own log-odds the path's log-odds against the global ones, times
`site_weight`. The classifier and the shares read whole texts of all documents; only the fit of the classifier is
bounded, to about `sample_rows` labelled rows.

Every text is scored once: the scores are written with the rows, and shares and results come from that table.

Defined results: null or empty text counts as an empty text with all measures 0; null hosts and paths form a site of
their own; rows held out or without a label are never learnt from, and of several labels of one id the least counts;
without labels of both kinds every document gets the known share of good ones (1 if there is none). Repeated rows give
repeated results. The input's columns are returned as one struct, so none clashes with what is added.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import checkpoint, held_out, small_batches

SAMPLE_ROWS = 20_000
#: A site table of at most so many rows (some tens of bytes each) is broadcast; a larger one is joined by key.
BROADCAST_SITES = 500_000
N_MEASURES = 10
_LETTERS = re.compile(r"[^\W\d_]+")


def measures(text: str | None) -> list[float]:
    """What the classifier sees of a text."""
    words = text.split() if text else []
    n = len(words)
    if not n:
        return [0.0] * N_MEASURES
    letters = sum(map(len, _LETTERS.findall(text)))
    chars = sum(map(len, words))
    capitals = sum(map(str.isupper, words))
    distinct = Counter(words)
    symbols = chars - letters
    alone = sum(w in "|-*#=~_•" for w in words)
    return [1.0, symbols / chars, min(1.0, symbols / n / 3), capitals / n, alone / n, len(distinct) / n, sum(map(eq, words, words[1:])) / n, max(distinct.values()) / n, math.log1p(n) / 10, min(2.0, chars / n / 10)]


@dataclass
class Classifier:
    mean: list[float]
    scale: list[float]
    weights: list[float]
    intercept: float

    def probabilities(self, rows: list[list[float]]) -> np.ndarray:
        x = np.array(rows, float).reshape(len(rows), len(self.weights))
        z = (x - np.array(self.mean)) / np.array(self.scale) @ np.array(self.weights) + self.intercept
        return 1 / (1 + np.exp(-np.clip(z, -20.0, 20.0)))


def expand(x: list[float]) -> list[float]:
    """Measures, and the ones that tell junk as steps, so that a linear rule can separate them."""
    return [*x, float(x[2] > 0.6), float(x[3] > 0.5), float(x[4] > 0.1), float(x[6] > 0.3), float(x[5] < 0.3)]


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, ridge: float = 1.0) -> Classifier:
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.min("label").alias("label"))
    n = known.count()
    share = min(1.0, sample_rows / max(1, n))
    known = known.where((F.xxhash64("id", F.lit("quality")) % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000))
    # At most about `sample_rows` ids, so texts need not move.
    rows = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"x": [expand(measures(t)) for t in batch.column(0).to_pylist()], "y": batch.column(1).to_pylist()}, schema=pa.schema([("x", pa.list_(pa.float64())), ("y", pa.int32())]))

    pairs = rows.mapInArrow(run, "x array<double>, y int").toPandas()
    width = len(expand([0.0] * N_MEASURES))
    y = pairs["y"].to_numpy(float)
    if not len(y) or y.min() == y.max():
        rate = float(y.mean()) if len(y) else 1.0
        return Classifier([0.0] * width, [1.0] * width, [0.0] * width, math.log(max(rate, 1e-9) / max(1 - rate, 1e-9)))
    x = np.stack(pairs["x"].to_numpy())
    mean, scale = x.mean(0), x.std(0) + 1e-6
    design = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    beta, penalty = np.zeros(width + 1), ridge * np.eye(width + 1)
    penalty[-1, -1] = 1e-6
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -20, 20)))
        step = np.linalg.solve(design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + penalty, design.T @ (y - p) - penalty @ beta)
        beta += step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return Classifier(mean.tolist(), scale.tolist(), beta[:-1].tolist(), float(beta[-1]))


def probability(text: Column, model: Classifier) -> Column:
    """The classifier's probability that a text is good, whole Arrow batches at a time."""

    @F.arrow_udf("double")
    def good(texts: pa.Array) -> pa.Array:
        return pa.array(model.probabilities([expand(measures(t)) for t in texts.to_pylist()]), pa.float64())

    return good(text)


def site_posteriors(scored: DataFrame, host: str, path: str, p: str) -> DataFrame:
    """(host, path, n, host_share, path_share, global_share): one row per path, by grouped aggregation alone."""
    paths = scored.groupBy(host, path).agg(F.count(F.lit(1)).alias("n"), F.sum(p).alias("s"))
    hosts = paths.groupBy(host).agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    g = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(F.col("hs") * F.col("hs") / F.col("hn")).alias("q"), F.sum(F.col("hn") * F.col("hn")).alias("n2"), F.count(F.lit(1)).alias("k")).first()
    share = min(max((g["s"] or 0.0) / max(1, g["n"] or 0), 1e-6), 1 - 1e-6)
    k_host = _strength(share, g["q"], g["n"], g["n2"], g["k"])
    hosts = hosts.withColumn("host_share", (F.col("hs") + k_host * share) / (F.col("hn") + k_host))
    both = paths.join(hosts.select(F.col(host).alias("__h"), "host_share", "hn", "hs"), F.col(host).eqNullSafe(F.col("__h"))).drop("__h")
    w = both.agg(F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("q"), F.sum(F.col("n") * F.col("n")).alias("n2"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * (F.col("hs") / F.col("hn")) * (F.col("hs") / F.col("hn"))).alias("m2")).first()
    k_path = _strength(share, (w["q"] or 0.0) - (w["m2"] or 0.0) + share * share * (w["n"] or 0), w["n"], w["n2"], w["k"])
    return both.select(host, path, "n", "host_share", ((F.col("s") + k_path * F.col("host_share")) / (F.col("n") + k_path)).alias("path_share"), F.lit(share).alias("global_share"))


def _strength(share: float, q: float | None, n: int | None, n2: int | None, k: int | None) -> float:
    """A beta prior's weight in documents, from sum s^2/n over k groups of n documents in all (method of moments)."""
    n, k = n or 0, k or 0
    if k < 2 or n <= k:
        return 50.0
    within = share * (1 - share)
    between = ((q or 0.0) - n * share * share - (k - 1) * within) / max(1e-9, n - (n2 or 0) / n)
    return float(min(1e6, max(2.0, within / between - 1 if between > 0 else 1e6)))


def classify(documents: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, id_col: str = "doc_id", text_col: str = "text", site_weight: float = 0.5, threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` of documents (all, if none are named) as the struct `row`, and quality_p, host_share, path_share,
    quality_score, quality_keep."""
    small_batches(documents.sparkSession)
    model = fit(documents, labels, id_col, text_col)
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(F.col("source"), F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    row = F.struct(*(F.col(f"`{c}`") for c in keep or documents.columns)).alias("row")
    scored = checkpoint(documents.select(row, host.cast("string").alias("host"), path.cast("string").alias("path"), probability(F.col(text_col).cast("string"), model).alias("quality_p")))
    sites = checkpoint(site_posteriors(scored, "host", "path", "quality_p").select(F.col("host").alias("h"), F.col("path").alias("p"), "host_share", "path_share", "global_share"))
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    joined = scored.join(sites, F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p")), "left")
    logit = lambda c: F.log(c / (1 - c))
    bound = lambda c: F.least(F.greatest(c, F.lit(1e-6)), F.lit(1 - 1e-6))
    z = logit(bound(F.col("quality_p"))) + site_weight * (logit(bound(F.col("path_share"))) - logit(bound(F.col("global_share"))))
    score = F.round(1 / (1 + F.exp(-z)), 9)
    return joined.select("row", "quality_p", "host_share", "path_share", score.alias("quality_score"), (score >= threshold).alias("quality_keep"))


def op3(documents: DataFrame, labels: DataFrame) -> DataFrame:
    found = classify(documents, labels, keep=["doc_id"])
    return found.select("row.doc_id", held_out(F.col("row.doc_id")).alias("held_out"), "quality_p", "host_share", "path_share", "quality_score", "quality_keep")
