"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Training counts, for every word and word edge (first or last three to eight characters), in how many toxic and other
labelled documents it stands, and turns the counts into log-odds under an informative Dirichlet prior: its pseudo-counts
follow the feature's share of all labelled documents. Those features whose log-odds are at least `least` and `z_min` standard
errors above zero are the signals; how strict this is, one half of the training rows decides over signals learnt from the
other. A word scores as its best-supported signal, any
other word scores below zero. One scan, linear in the words, finds all maximal-scoring segments of a document.

A segment of score S among n words is expected K n exp(-lambda S) times by chance. Both are taken from labelled documents
that are not toxic: lambda is the root of sum p exp(lambda s) = 1 over their words, K follows from how many of their
segments reach their median score. Segments that are expected less than `e_max` times are passages. A document's evidence joins
its best segments: r normalised scores lambda S - ln(K n) that add up to T are reached by chance with a probability of
about exp(-T) T^(r-1) / (r! (r-1)!), and the least of these, over r up to `MOST`, counts (each further r must halve it). Its
-log10 becomes a probability by a logistic fit on the training rows that have a segment.

Learning reads at most about `sample_rows` labelled rows, chosen by a hash of their ids; scoring reads every word of
every text. Defined results: null or empty text has no segments; texts without segments score as the share of toxic ones
among the training rows without any; rows without a label or held out are never learnt from, and of several labels of one id the
largest counts; without any label of either kind every score is the share of toxic labels (0 if there are none). Columns of
other names are ignored, repeated rows give repeated results.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import checkpoint, held_out, small_batches

SAMPLE_ROWS = 12_000
#: Lengths of the word edges that are features.
EDGES = range(3, 9)
#: Most segments that a document's evidence joins.
MOST = 8
#: Evidence above this counts as this much.
CEILING = 12.0
_WORD = re.compile(r"[^\W_]+")
_CACHE = 200_000


@dataclass
class Model:
    signals: dict[str, float] = field(default_factory=dict)
    other: float = -0.5
    lam: float = 1.0
    k: float = 0.1
    e_max: float = 0.01
    slope: float = 0.0
    intercept: float = -30.0
    base: float = 0.0

    def probability(self, evidence: float | None) -> float:
        if evidence is None:
            return self.base
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * min(evidence, CEILING) + self.intercept))))


def tokens(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def edges(word: str) -> list[str]:
    """The word and its edges, as features."""
    lengths = range(EDGES.start, min(EDGES.stop, len(word) + 1))
    return [f"={word}", *(f"<{word[:i]}" for i in lengths), *(f">{word[-i:]}" for i in lengths)]


def maximal_segments(scores: list[tuple[int, float]], other: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score) of words of score `other` < 0 but for the given positive ones
    (place, score), in one pass over the positive ones.

    Each kept segment links to the last one before it whose sum before it is smaller. Whatever lies between the two has a
    sum at least as large, so a search that gets to the one goes on at the other, and no segment is passed twice."""
    out: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum through, link
    total, last = 0.0, 0
    for at, s in scores:
        total += other * (at - last)
        last = at + 1
        start, before, through = at, total, total + s
        total = through
        j = len(out) - 1
        while True:
            while j >= 0 and out[j][2] >= before:
                j = out[j][4]
            if j < 0 or out[j][3] >= through:
                out.append((start, at + 1, before, through, j))
                break
            start, _, before, _, link = out[j]
            del out[j:]
            j = link
    return [(a, b, hi - lo) for a, b, lo, hi, _ in out]


def karlin_lambda(values: list[float], shares: list[float]) -> float:
    """The positive root of sum p exp(lambda s) = 1, by bisection."""
    f = lambda x: sum(p * math.exp(min(700.0, x * s)) for s, p in zip(values, shares, strict=True)) - 1
    lo, hi = 1e-6, 1.0
    while f(hi) < 0 and hi < 64:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if f(mid) < 0 else (lo, mid)
    return hi


class Scorer:
    """Scores words by a model, remembering recent ones."""

    def __init__(self, model: Model):
        self.model, self.known = model, {}

    def word(self, w: str) -> float:
        if len(self.known) > _CACHE:
            self.known.clear()
        found = [s for x in edges(w) if (s := self.model.signals.get(x))]
        self.known[w] = best = max(found, default=0.0)
        return best

    def segments(self, text: str | None) -> tuple[int, list[tuple[int, float]], list[tuple[int, int, float]]]:
        """(words, words that score above zero, maximal segments)."""
        found = tokens(text) if text else []
        known, word = self.known, self.word
        hits = [(i, s) for i, w in enumerate(found) if (s := known[w] if w in known else word(w))]
        return len(found), hits, maximal_segments(hits, self.model.other) if hits else []

    def evidence(self, text: str | None) -> tuple[float | None, int, list[tuple[int, int, float, float]]]:
        """(evidence, words, passages): evidence is None without segments; passages are (start word, end word, score,
        expected number)."""
        m = self.model
        n, _, segments = self.segments(text)
        if not segments:
            return None, n, []
        total, best = 0.0, 0.0
        for r, s in enumerate(sorted((s for *_, s in segments), reverse=True)[:MOST], 1):
            total += m.lam * s - math.log(m.k * n)
            if total > r:
                log_p = -total + (r - 1) * math.log(total) - math.lgamma(r + 1) - math.lgamma(r)
                best = max(best, -log_p / math.log(10) - r * math.log10(2))
        passages = [(a, b, s, m.k * n * math.exp(-m.lam * s)) for a, b, s in segments]
        return best, n, [x for x in passages if x[3] <= m.e_max]


@dataclass(frozen=True)
class Strictness:
    """The Dirichlet prior's weight in words, at most a tenth of those there are, and the least log-odds of a signal, also in
    standard errors."""

    prior: float
    least: float
    z_min: float = 3.0


#: Of these the one is taken that predicts best on the half of the training rows that its signals were not learnt from: many
#: rows bear out strong signals enough, few rows need weaker ones too.
SETTINGS = (Strictness(70_000, 1.0), Strictness(20_000, 2.3))


def signals(table: list[tuple[str, int, int]], words: tuple[int, int], strict: Strictness) -> dict[str, float]:
    """Log-odds of the features (feature, other documents, toxic documents) that are signals; words are the numbers of distinct
    words, added over documents, of either kind."""
    w0, w1 = words
    prior, out = min(strict.prior, (w0 + w1) / 10), {}
    share = prior / max(1, w0 + w1)
    for x, n0, n1 in table:
        if n1 < 3 or n1 * w0 <= n0 * w1:
            continue
        a = share * (n0 + n1)
        odds = math.log((n1 + a) / (w1 + prior - n1 - a)) - math.log((n0 + a) / (w0 + prior - n0 - a))
        if odds >= strict.least and odds / math.sqrt(1 / (n1 + a) + 1 / (n0 + a)) >= strict.z_min:
            out[x] = odds
    return out


def fit(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, settings: tuple[Strictness, ...] = SETTINGS, drift: float = 0.5, e_max: float = 0.01) -> Model:
    """Learn from labelled rows that are not held out."""
    small_batches(documents.sparkSession)
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).where(F.col("label").isin(0, 1) & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("label").alias("label"))
    n = known.count()
    if not n:
        return Model()
    share = min(1.0, sample_rows / n)
    known = known.where((F.xxhash64("id", F.lit("toxicity")) % 1_000_000 + 1_000_000) % 1_000_000 < int(share * 1_000_000))
    known = known.withColumn("half", F.pmod(F.xxhash64("id", F.lit("half")), F.lit(2)))
    # At most about `sample_rows` ids, so texts need not move; the sample is read several times.
    rows = checkpoint(documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "id").select("text", "label", "half"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["a0", "a1", "b0", "b1"]
        for batch in batches:
            seen = [Counter() for _ in names]
            for text, label, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                have, into = set(tokens(text or "")), seen[2 * half + label]
                into.update({x for w in have for x in edges(w)})
                into["#words"] += len(have)
                into["#docs"] += 1
            every = list(set().union(*seen))
            yield pa.RecordBatch.from_pydict({"feature": every} | {k: [c[x] for x in every] for k, c in zip(names, seen, strict=True)}, schema=pa.schema([("feature", pa.string()), *((k, pa.int64()) for k in names)]))

    counts = rows.mapInArrow(count, "feature string, a0 long, a1 long, b0 long, b1 long").groupBy("feature").agg(*(F.sum(k).alias(k) for k in ("a0", "a1", "b0", "b1")))
    counts = checkpoint(counts.where("a1 + b1 >= 3 OR feature LIKE '#%'"))
    totals = {r["feature"]: r for r in counts.where("feature LIKE '#%'").collect()}
    words, docs = totals.get("#words"), totals.get("#docs")
    d0, d1 = (docs["a0"] + docs["b0"], docs["a1"] + docs["b1"]) if docs else (0, 0)
    if not d0 or not d1:
        rate = d1 / max(1, d0 + d1)
        return Model(intercept=math.log(max(rate, 1e-12) / max(1 - rate, 1e-12)), base=rate)
    w0, w1 = words["a0"] + words["b0"], words["a1"] + words["b1"]
    likelier = counts.where("feature NOT LIKE '#%'").where((F.col("a1") + F.col("b1")) * F.lit(w0) > (F.col("a0") + F.col("b0")) * F.lit(w1))
    table = [tuple(r) for r in likelier.toLocalIterator()]  # features of a sample of bounded size
    chosen = settings[0]
    if len(settings) > 1 and docs["a1"] and docs["b0"] and docs["b1"]:
        other = rows.where("half = 1")
        tried = [(_calibrate(Model(signals=signals([(x, a0, a1) for x, a0, a1, _, _ in table], (words["a0"], words["a1"]), s), other=-drift, e_max=e_max), other)[1], i) for i, s in enumerate(settings)]
        chosen = settings[min(tried)[1]]
    final = Model(signals=signals([(x, a0 + b0, a1 + b1) for x, a0, a1, b0, b1 in table], (w0, w1), chosen), other=-drift, e_max=e_max)
    return _calibrate(final, rows)[0]


def _calibrate(model: Model, rows: DataFrame) -> tuple[Model, float]:
    """The model with what it takes to turn segments into probabilities, from rows (text, label), and its mean log-loss on
    them."""

    def chance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Scores of words ("word") and segments ("segment") of documents that are not toxic, with their numbers."""
        scorer, seen = Scorer(model), Counter()
        for batch in batches:
            for text, label in zip(*(c.to_pylist() for c in batch.columns[:2]), strict=True):
                if not label:
                    n, hits, segments = scorer.segments(text)
                    seen["word", 0.0] += n
                    seen.update(("word", round(s, 3)) for _, s in hits)
                    seen.update(("segment", round(s, 3)) for *_, s in segments)
        yield pa.RecordBatch.from_pydict({"kind": [k for k, _ in seen], "score": [s for _, s in seen], "n": list(seen.values())}, schema=pa.schema([("kind", pa.string()), ("score", pa.float64()), ("n", pa.int64())]))

    spread: dict[str, dict[float, float]] = {"word": {}, "segment": {}}
    for r in rows.mapInArrow(chance, "kind string, score double, n long").groupBy("kind", "score").agg(F.sum("n").alias("n")).collect():
        spread[r["kind"]][r["score"]] = r["n"]
    model.lam, model.k = calibrated(spread["word"], spread["segment"], model)

    def evidence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            x = [scorer.evidence(t)[0] for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_pydict({"x": x, "y": batch.column(1).to_pylist()}, schema=pa.schema([("x", pa.float64()), ("y", pa.int32())]))

    pairs = rows.mapInArrow(evidence, "x double, y int").toPandas()
    x, y = pairs["x"].to_numpy(float), pairs["y"].to_numpy(float)
    some = ~np.isnan(x)
    model.base = float((y[~some].sum() + 0.5) / ((~some).sum() + 1))
    if some.any():
        model.slope, model.intercept = _logistic(np.minimum(x[some], CEILING), y[some])
    p = np.array([model.probability(None if math.isnan(v) else v) for v in x])
    return model, float(-np.mean(np.log(np.maximum(1e-12, np.where(y == 1, p, 1 - p))))) if len(y) else 0.0


def calibrated(words: dict[float, float], segments: dict[float, float], model: Model) -> tuple[float, float]:
    """Lambda and K from the numbers of words (0.0: all words) and of maximal segments by score, in texts without toxic
    passages. One word more has the strongest signal, by a tenth, so that there is a lambda where no word scores."""
    hits = {s: n for s, n in words.items() if s > 0}
    total = words.get(0.0, 0) + 1
    strongest = max(model.signals.values(), default=1.0)
    hits[strongest] = hits.get(strongest, 0) + 0.1
    lam = karlin_lambda([*hits, model.other], [*(n / total for n in hits.values()), max(0.0, 1 - sum(hits.values()) / total)])
    ranked = sorted(segments.items())
    half, reached, least = sum(segments.values()) / 2, 0.0, strongest
    for s, n in ranked:
        reached += n
        if reached >= half:
            least = s
            break
    above = sum(n for s, n in ranked if s >= least)
    return lam, (above + 0.5) * math.exp(min(700.0, lam * least)) / total


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope (not below 0) and intercept by damped Newton steps."""
    design, beta = np.stack([x, np.ones_like(x)], axis=1), np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        hessian = design.T @ (design * (p * (1 - p) + 1e-6)[:, None]) + ridge * np.eye(2)
        step = np.linalg.solve(hessian, design.T @ (y - p) - ridge * beta)
        beta += step * min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-8:
            break
    return max(0.0, float(beta[0])), float(beta[1])


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's probability, evidence, word count and toxic passages."""
    small_batches(documents.sparkSession)
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64()), ("expected", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("score", pa.float64()), ("evidence", pa.float64()), ("n_words", pa.int64()), ("passages", pa.list_(passage))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in batches:
            out: dict[str, list] = {"id": batch.column(0).to_pylist(), "score": [], "evidence": [], "n_words": [], "passages": []}
            for text in batch.column(1).to_pylist():
                x, n, found = scorer.evidence(text)
                out["score"].append(model.probability(x))
                out["evidence"].append(x or 0.0)
                out["n_words"].append(n)
                out["passages"].append([{"start": a, "end": b, "score": s, "expected": e} for a, b, s, e in found])
            yield pa.RecordBatch.from_pydict(out, schema=schema)

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double, evidence double, n_words long, passages array<struct<start:long,end:long,score:double,expected:double>>")


def op1(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The digest columns of the toxicity contract."""
    found = score(documents, fit(documents, labels))
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), F.round("evidence", 6).alias("evidence"), F.size("passages").alias("n_passages"))
