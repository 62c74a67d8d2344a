"""Mixing sources to target weights by entropy balancing, with built-in functions only.

Targets: sources take their weights' shares of all words; a target stops at `cap` times its source's size, and what is
over goes to the others by weight until none is above. Rates: among all document rates that meet a source's target and
none of which is above `cap`, those nearest to 1 in relative entropy are min(cap, exp(lambda x)), x being a document's
size over its source's mean size. Lambda solves the convex dual, whose gradient is the target less the words that the
rates take: damped Newton steps per source, all sources at once on the executors, over each source's sizes counted in
bins of a 64th of an octave (at most a few thousand bins a source, however many documents it has).

Rounding: each document takes the whole part of its rate; of the fractional parts, a further copy goes to documents in
the order of hash / fraction, up to the cut at which the source's words come nearest to its target, and last the one
document whose change fits best changes sides. The cut follows from a histogram of that order and an exact pass over
the one bin that holds it, so no task sees a whole source.

Defined results: null or empty text has size 0 and takes rate 1, as does any document of size 0; null is a source of
its own, the last one; sources without words have target 0; rows equal in id and text are taken alike. Reruns agree: hashes have fixed seeds and sums are over whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimgraph.functions.words import count_between
from claimgraph.llm.common import SPACE, checkpoint

#: Fixed value: the weights of sources in order, repeating.
WEIGHTS = (5, 2, 1)
CAP = 3
STEPS = 60
PER_OCTAVE = 64
CUTS = 16_384
#: A source table of at most so many rows (about 60 bytes each) is broadcast; a larger one is joined by key.
BROADCAST_SOURCES = 100_000


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: float = CAP) -> DataFrame:
    """(source, source_size, n_docs, target) from (source, source_size, n_docs): capped shares by water-filling."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(order) - 1) % len(weights) + 1)
    rows = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * cap)
    up = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, everything = up.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    weigh = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / weigh).withColumn("free", F.col("most") / F.col("weight") >= F.col("level"))
    level = F.min_by("level", F.struct(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source")))
    level = F.coalesce(F.first(F.when(F.col("free"), F.col("level")), ignorenulls=True).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(0.0))
    return rows.select("source", "source_size", "n_docs", F.least("most", F.col("weight") * level).alias("target"))


def _bin(size: Column) -> Column:
    return F.floor(F.log2(size.cast("double")) * PER_OCTAVE).cast("int")


def _rate(tilt: Column, lam: Column, cap: float) -> Column:
    return F.least(F.lit(float(cap)), F.exp(F.least(lam * tilt, F.lit(50.0))))


def solve(histogram: DataFrame, cap: float = CAP, steps: int = STEPS) -> DataFrame:
    """(source, lam) from (source, source_size, n_docs, target, bins), bins being array<struct<bin, n, words>>.

    The dual of one source is piecewise smooth and convex in lambda; each step is Newton's unless that leaves the
    bracket of the root, which then is halved. Null where the target is not above 0 or not below cap times the size."""
    mean = F.col("source_size") / F.col("n_docs")
    start = F.struct(F.lit(0.0).alias("lam"), (mean * -800 - 800).alias("lo"), (mean * 2 + 2).alias("hi"))

    def gradient(lam: Column) -> Column:
        """Words that the rates take, and their derivative."""
        zero = F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("h"))

        def add(a: Column, b: Column) -> Column:
            x = b["words"] / b["n"] / mean
            q = _rate(x, lam, cap)
            return F.struct((a["g"] + q * b["words"]).alias("g"), (a["h"] + F.when(q < cap, q * x * b["words"]).otherwise(F.lit(0.0))).alias("h"))

        return F.aggregate("bins", zero, add)

    def step(s: Column, _: Column) -> Column:
        # One element's transform binds the gradient, which otherwise would be computed at each use.
        def move(d: Column) -> Column:
            over = d["g"] - F.col("target")
            lo, hi = F.when(over < 0, s["lam"]).otherwise(s["lo"]), F.when(over < 0, s["hi"]).otherwise(s["lam"])
            newton = s["lam"] - over / d["h"]
            inside = (d["h"] > 0) & (newton > lo) & (newton < hi)
            near = F.abs(over) <= 1e-9 * F.col("target")
            return F.struct(F.when(near, s["lam"]).when(inside, newton).otherwise((lo + hi) / 2).alias("lam"), lo.alias("lo"), hi.alias("hi"))

        return F.element_at(F.transform(F.array(gradient(s["lam"])), move), 1)

    lam = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step, lambda s: s["lam"])
    between = (F.col("target") > 0) & (F.col("target") < F.col("source_size") * cap)
    return histogram.select("source", "source_size", "n_docs", "target", F.when(between, lam).alias("lam"))


def _with_sources(rows: DataFrame, table: DataFrame, n: int) -> DataFrame:
    other = table.withColumnRenamed("source", "__source")
    return rows.join(F.broadcast(other) if n <= BROADCAST_SOURCES else other, F.col("source").eqNullSafe(F.col("__source")), "left").drop("__source")


def mix(df: DataFrame, source: Column | None = None, text: Column | None = None, key: Column | None = None, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """df's columns as the struct `row`, and size, source, source_size, target, rate, copies. `key` is what orders
    documents in rounding; its hash, never its value, counts."""
    source = F.col("source") if source is None else source
    text = F.col("text") if text is None else text
    key = F.xxhash64(F.col("doc_id"), text) if key is None else key
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), source.cast("string").alias("source"), count_between(text.cast("string"), SPACE).alias("size"), key.alias("key"))
    bins = rows.groupBy("source", F.when(F.col("size") > 0, _bin(F.col("size"))).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"))
    bins = bins.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("n").alias("n_docs"), F.array_sort(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n", "words")))).alias("bins"))
    bins = checkpoint(bins)
    wanted = targets(bins.select("source", "source_size", "n_docs"), weights, cap)
    table = checkpoint(solve(wanted.join(bins.select(F.col("source").alias("__s"), "bins"), F.col("source").eqNullSafe(F.col("__s"))).drop("__s"), cap))
    n_sources = table.count()
    per_bin = bins.select(F.col("source"), F.explode("bins").alias("b")).select("source", F.col("b.bin").alias("bin"), (F.col("b.words") / F.col("b.n")).alias("typical"))
    n_bins = per_bin.count()
    tilt = per_bin.withColumnsRenamed({"source": "__s", "bin": "__b"})
    full = _with_sources(rows, table, n_sources).withColumn("bin", F.when(F.col("size") > 0, _bin(F.col("size"))))
    full = full.join(F.broadcast(tilt) if n_bins <= BROADCAST_SOURCES else tilt, F.col("source").eqNullSafe(F.col("__s")) & (F.col("bin") == F.col("__b")), "left").drop("__s", "__b", "bin")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("target") <= 0, 0.0).when(F.col("lam").isNull(), float(cap)).otherwise(_rate(F.col("typical") / (F.col("source_size") / F.col("n_docs")), F.col("lam"), cap))
    full = full.withColumn("rate", rate).withColumn("whole", F.floor("rate")).withColumn("part", F.col("rate") - F.col("whole"))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.col("key"), F.lit("mix")), 11) + 1) / float(2**53)
    ratio = uniform / F.col("part")
    full = full.withColumn("order", F.when((F.col("part") > 0) & (F.col("size") > 0), ratio / (1 + ratio))).withColumn("cut", F.floor(F.col("order") * CUTS).cast("int")).drop("typical", "lam", "n_docs")
    return full


def rounded(full: DataFrame, measured: DataFrame) -> DataFrame:
    """full with copies; measured is the same rows' small columns, checkpointed."""
    base = measured.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("whole") * F.col("size")).alias("taken"))
    cuts = measured.where("cut IS NOT NULL").groupBy("source", "cut").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(Window.partitionBy("source").orderBy("cut"))
    b = base.select(F.col("source").alias("__s"), (F.col("target") - F.col("taken")).alias("need"))
    cuts = cuts.withColumn("through", running).join(b, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    # The bin in which the needed words are reached; none if all bins together stay below.
    edge = cuts.where("through > need").groupBy("source").agg(F.min("cut").alias("edge"), F.min_by(F.col("need") - F.col("through") + F.col("words"), "cut").alias("rest"))
    edge = checkpoint(edge)
    e = edge.withColumnRenamed("source", "__s")
    within = measured.join(F.broadcast(e) if e.count() <= BROADCAST_SOURCES else e, F.col("source").eqNullSafe(F.col("__s")) & (F.col("cut") == F.col("edge"))).drop("__s")
    last = within.withColumn("through", F.sum("size").over(Window.partitionBy("source").orderBy("order", "key", "size").rowsBetween(Window.unboundedPreceding, 0)))
    last = last.where(F.col("through") - F.col("size") / 2 <= F.col("rest")).groupBy("source").agg(F.max(F.struct("order", "key")).alias("stop"), F.count(F.lit(1)).alias("n"))
    stops = edge.join(last.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").select("source", "edge", "stop")
    stops = checkpoint(base.select("source").join(stops.withColumnRenamed("source", "__s"), F.col("source").eqNullSafe(F.col("__s")), "left").drop("__s"))
    n = stops.count()
    extra = F.col("cut").isNotNull() & (F.col("edge").isNull() | (F.col("cut") < F.col("edge")) | ((F.col("cut") == F.col("edge")) & F.coalesce(F.struct("order", "key") <= F.col("stop"), F.lit(False))))
    # What is still missing or over is brought down by the one document whose change of mind fits best.
    decided = _with_sources(measured, stops, n).withColumn("extra", extra)
    missing = decided.groupBy("source").agg((F.max("target") - F.sum((F.col("whole") + F.col("extra").cast("long")) * F.col("size"))).alias("missing"))
    left = F.abs(F.col("missing") - F.when(F.col("extra"), -F.col("size")).otherwise(F.col("size")))
    flips = _with_sources(decided.where("cut IS NOT NULL"), missing, n).where(left < F.abs("missing")).groupBy("source").agg(F.min(F.struct(left.alias("left"), F.col("order"), F.col("key"))).alias("flip"))
    flips = checkpoint(flips.select("source", F.struct("flip.order", "flip.key").alias("flip")))
    joined = _with_sources(_with_sources(full, stops, n), flips, n)
    changed = F.coalesce(F.struct("order", "key") == F.col("flip"), F.lit(False))
    return joined.withColumn("copies", (F.col("whole") + (extra != changed).cast("long")).cast("long")).drop("whole", "part", "order", "cut", "edge", "stop", "flip")


def balance(df: DataFrame, **given: object) -> DataFrame:
    """The mixture: mix() and the copies that rounding gives each document."""
    full = mix(df, **given)
    measured = checkpoint(full.select("source", "size", "target", "whole", "order", "cut", "key"))
    return rounded(full, measured)


def op2(df: DataFrame) -> DataFrame:
    """The digest columns of the mixing contract."""
    found = balance(df)
    return found.select("row.doc_id", "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"), F.col("target").cast("double").alias("target"), (F.col("size") * F.col("copies")).alias("taken"), F.round("rate", 9).alias("rate"))
