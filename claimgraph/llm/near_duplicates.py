"""N-gram Jaccard join over a metric space of shingle sets: exact classes of documents within distance 1/4.

A document's set is its distinct five-word shingles, held as 64-bit hashes. Documents with equal sets fall together
first. The rest is joined in regions around pivots:

1. Outer pivots are one-shingle sets {s} under one global order. Nearly all documents are at distance 1 from any
   document chosen as a pivot, as they share no shingle with it; one-shingle pivots give every document a nearest
   pivot (its first shingle), and the triangle inequality gives the window in which it must be replicated: a partner
   within 1/4 lacks at most a quarter of its shingles, so its own pivot is among the first n - ceil(3n/4) + 1.
   Pivots that would own more than `region` documents (a passage or a group of copies) go to the end of the order,
   whereby documents move on to the regions of their next pivots; those that so many move on to are moved as well, until
   none is left. Each document keeps some pivots beyond its window, so that its text is read again only if they run out.
2. Regions of at most `region` documents are joined pairwise. Pairs whose shared pivots and remaining lengths cannot add
   up to the needed intersection are dropped, and those whose parity sketches differ in more bits than two linked sets can
   differ in shingles (a lower bound of their symmetric difference, so no link is lost); the rest is verified on the whole
   sets.
3. Larger regions of one first document together are its ball: a group of copies shares many regions, and most of them have
   the same first document, so that each pair meets in a few balls only. Balls that fit into a task are compared there; larger
   ones become Voronoi cells around some of their documents, boundary documents being replicated by the triangle
   inequality, and cells of cells (`set_groups`). Links of one class are not all listed, but no two classes with a link
   stay apart.
4. Links are counted, where asked for, on the whole sets of each class: every two of its sets are compared in one task,
   and a number for each document is all that leaves it.

Defined results: null or empty text, or one without words, has an empty set, links with nothing and is its own class;
fewer than five words are one shingle; equal rows count as one document with copies; a class's id is its least id, null if
no row of it has one. Rows without an id are documents like others; those of equal texts are repeated rows. An id must not
stand for several texts, nor be above 2^62. Other columns are not read. Shingles are told apart by their 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm import set_groups
from claimgraph.llm.common import checkpoint, small_batches
from claimgraph.llm.shingling import PERCENT, kept, least_apart, shingles, signature, sketch, window

REGION = 8
#: At most so many outer pivots (8 bytes each) are moved to the end of the order, the most frequent first. Any choice
#: of them gives the same links; it bounds what is sent to the executors.
MOVED = 1_000_000
#: Most rounds in which pivots are moved. Further ones would make regions smaller but leave the links as they are.
ROUNDS = 4
#: Rows without an id get one from here up, by their text. Ids are expected below it.
NAMELESS = 1 << 62


def _key(id_col: Column, text: Column) -> Column:
    """A row's id; one by its text for rows without an id."""
    return F.coalesce(id_col.cast("long"), F.lit(NAMELESS) + F.pmod(F.xxhash64(text.cast("string")), F.lit(NAMELESS)))


def _texts(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(_key(F.col(id_col), F.col(text_col)).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


def _mapped(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """mapInArrow; a worker that waits for its next task gives back what its batches took."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(freed, schema)


def sets(df: DataFrame) -> DataFrame:
    """(id, n, s1, s2, pivots, sketch) of (id, text): size, signature, first shingles (`kept` of them) and parities of
    each set."""
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("pivots", pa.list_(pa.int64())), ("sketch", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, s1, s2, firsts, parities = [], [], [], [], []
            for raw in batch.column(1):
                found = shingles(raw.as_buffer().to_pybytes() if raw.is_valid else None)
                a, b = signature(found)
                n.append(len(found))
                s1.append(a)
                s2.append(b)
                firsts.append(found[: kept(len(found))])
                parities.append(sketch(found) if len(found) else None)
            ends = np.cumsum([0, *map(len, firsts)], dtype=np.int32)
            values = pa.array(np.concatenate(firsts) if firsts else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), values), pa.array(parities, pa.binary())], schema=schema)

    return _mapped(df, run, "id long, n long, s1 long, s2 long, pivots array<long>, sketch binary")


_PLACED = "s long, x long, np long"
_PLACED_SCHEMA = pa.schema([("s", pa.int64()), ("x", pa.int64()), ("np", pa.int64())])


def _rows(x: int, n: int, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A document's rows: pivot, document, and its size and the pivot's place in one number."""
    return pivots, np.full(len(pivots), x, np.int64), (n << 32) + np.arange(len(pivots), dtype=np.int64)


def _batch(rows: list[tuple[np.ndarray, ...]], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows, strict=True)], schema=schema)


def _chunked(made: Iterator[tuple[np.ndarray, ...]], schema: pa.Schema, size: int = 200_000) -> Iterator[pa.RecordBatch]:
    rows, n = [], 0
    for row in made:
        rows.append(row)
        n += len(row[0])
        if n >= size:
            yield _batch(rows, schema)
            rows, n = [], 0
    if rows:
        yield _batch(rows, schema)


def _is_moved(values: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Whether the upper halves of values are among `moved` (sorted)."""
    if not len(moved):
        return np.zeros(len(values), bool)
    upper = values >> np.int64(32)
    at = np.minimum(np.searchsorted(moved, upper), len(moved) - 1)
    return moved[at] == upper


def _window(own: np.ndarray, late: np.ndarray, n: int) -> np.ndarray | None:
    """A document's first pivots under the order in which moved ones (late) come last; None if those that it has kept do
    not reach so far."""
    w = window(n)
    if not late[:w].any():
        return own[:w]
    rest = own[~late]
    if len(rest) < w and len(own) < n:
        return None
    return np.concatenate([rest[:w], own[late]])[:w]


def _documents(batch: pa.RecordBatch, moved: np.ndarray, only_moved: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(id, n, pivots, which of them have moved) of a batch of (id, n, pivots)."""
    ids, sizes, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)
    values, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
    late = _is_moved(values, moved)
    sums = np.concatenate([[0], np.cumsum(late)])
    for k in np.flatnonzero(sums[ends[1:]] > sums[ends[:-1]]) if only_moved else range(len(ids)):
        at = slice(ends[k], ends[k + 1])
        yield ids[k], sizes[k], values[at], late[at]


def placed(lists: DataFrame, moved: np.ndarray) -> DataFrame:
    """Rows (s, x, np) of (id, n, pivots), without the documents that have kept too few pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple[np.ndarray, ...]]:
            for batch in batches:
                for x, n, own, late in _documents(batch, moved, False):
                    if (first := _window(own, late, n)) is not None:
                        yield _rows(x, n, first)

        yield from _chunked(made(), _PLACED_SCHEMA)

    return _mapped(lists, run, _PLACED)


def entered(lists: DataFrame, moved: np.ndarray, before: np.ndarray) -> DataFrame:
    """(u, x) of (id, n, pivots): upper halves of the pivots that come into a window as others have moved, and the
    documents that have kept too few of them, but had enough with those of `before` moved."""
    schema = pa.schema([("u", pa.int64()), ("x", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, short = [np.empty(0, np.int64)], []
            for x, n, own, late in _documents(batch, moved, True):
                w = window(n)
                if _window(own, late, n) is not None:
                    rest = own[~late][:w]
                    new.append(rest[rest > own[w - 1]] >> np.int64(32))
                elif _window(own, _is_moved(own, before), n) is not None:
                    short.append(x)
            u = np.concatenate(new)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(u), pa.nulls(len(short), pa.int64())]), pa.concat_arrays([pa.nulls(len(u), pa.int64()), pa.array(short, pa.int64())])], schema=schema)

    return _mapped(lists, run, "u long, x long")


def whole(texts: DataFrame) -> DataFrame:
    """(id, n, pivots) of (id, text) with all shingles as pivots."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(raw)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()), pa.array([len(found)], pa.int64()), pa.ListArray.from_arrays(pa.array([0, len(found)], pa.int32()), pa.array(found))], names=["id", "n", "pivots"])

    return _mapped(texts, run, "id long, n long, pivots array<long>")


def regions(rows: DataFrame, region: int) -> DataFrame:
    """(s, x, y, nx, ny, i, j) from rows sorted by pivot and document: all pairs x < y of regions of at most `region`
    documents; of larger ones every document x with the region's first document y, s not null."""
    names = ["s", "x", "y", "nx", "ny", "i", "j"]
    schema = pa.schema([(c, pa.int64()) for c in names])
    low = np.int64((1 << 32) - 1)

    def emit(s: np.ndarray | None, x: np.ndarray, y: np.ndarray, px: np.ndarray, py: np.ndarray) -> pa.RecordBatch:
        nx, ny, i, j = px >> np.int64(32), py >> np.int64(32), px & low, py & low
        if s is None:
            most = np.minimum(i, j) + 1 + np.minimum(nx - 1 - i, ny - 1 - j)
            keep = (x != y) & (100 * np.minimum(nx, ny) >= PERCENT * np.maximum(nx, ny)) & (most * (100 + PERCENT) >= PERCENT * (nx + ny))
            x, y, nx, ny, i, j = (c[keep] for c in (x, y, nx, ny, i, j))
        first = pa.nulls(len(x), pa.int64()) if s is None else pa.array(s)
        return pa.RecordBatch.from_arrays([first, *map(pa.array, (x, y, nx, ny, i, j))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = np.empty(0, np.int64)
        held = (empty, empty, empty)
        large: tuple[int, int, int] | None = None  # the large region under way: pivot, first document, its place

        def work(s: np.ndarray, x: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole regions."""
            if not len(s):
                return
            start = np.concatenate([[0], np.flatnonzero(s[1:] != s[:-1]) + 1])
            size = np.diff(np.concatenate([start, [len(s)]]))
            for k in range(2, region + 1):
                at = start[size == k]
                if len(at):
                    for a in range(k - 1):
                        for b in range(a + 1, k):
                            yield emit(None, x[at + a], x[at + b], p[at + a], p[at + b])
            for at, k in zip(start[size > region], size[size > region], strict=True):
                yield emit(s[at : at + k], x[at : at + k], np.full(k, x[at]), p[at : at + k], np.full(k, p[at]))

        for batch in batches:
            s, x, p = (c.to_numpy() for c in batch.columns)
            if large is not None:
                k = int(np.searchsorted(s != large[0], True)) if (s != large[0]).any() else len(s)
                if k:
                    yield emit(s[:k], x[:k], np.full(k, large[1]), p[:k], np.full(k, large[2]))
                s, x, p = s[k:], x[k:], p[k:]
                if not len(s):
                    continue
                large = None
            s, x, p = (np.concatenate(c) for c in zip(held, (s, x, p), strict=True))
            if not len(s):
                continue
            cut = int(np.flatnonzero(s[1:] != s[:-1])[-1]) + 1 if (s[1:] != s[:-1]).any() else 0
            yield from work(s[:cut], x[:cut], p[:cut])
            held = (s[cut:], x[cut:], p[cut:])
            if len(held[0]) > region:  # never hold a large region
                large = (int(held[0][0]), int(held[1][0]), int(held[2][0]))
                k = len(held[0])
                yield emit(held[0], held[1], np.full(k, large[1]), held[2], np.full(k, large[2]))
                held = (empty, empty, empty)
        yield from work(*held)

    return _mapped(rows, run, ", ".join(f"{c} long" for c in names))


def verify(pairs: DataFrame, texts: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(x, y, both, either) of (x, y): sizes of intersection and union on the whole sets."""
    t = texts(pairs.select("x").union(pairs.select(F.col("y").alias("x"))).distinct())
    rows = pairs.select("x", "y").join(t.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x").join(t.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y").select("x", "y", "tx", "ty")
    schema = pa.schema([(c, pa.int64()) for c in ("x", "y", "both", "either")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, np.ndarray] = (b"", np.empty(0, np.int64))
        for batch in batches:
            both, either = [], []
            for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if b != last[0]:
                    last = (b, shingles(b))
                one = shingles(a)
                k = len(np.intersect1d(one, last[1], assume_unique=True))
                both.append(k)
                either.append(len(one) + len(last[1]) - k)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(either, pa.int64())], schema=schema)

    return _mapped(rows, run, "x long, y long, both long, either long")


def resembling(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (x, y), a written table, whose sketches (id, n, sketch) do not rule a link out."""
    ids = checkpoint(pairs.select("x").union(pairs.select("y")).distinct())
    t = set_groups.near(sketches, ids, ids.count())
    rows = pairs.select("x", "y").join(t.select(F.col("id").alias("x"), F.col("n").alias("nx"), F.col("sketch").alias("a")), "x").join(t.select(F.col("id").alias("y"), F.col("n").alias("ny"), F.col("sketch").alias("b")), "y").select("x", "y", "nx", "ny", "a", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            apart = np.array([least_apart(a, b) for a, b in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True)], np.int64)
            both = batch.column(2).to_numpy() + batch.column(3).to_numpy()
            keep = pa.array((100 + PERCENT) * apart <= (100 - PERCENT) * both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], names=["x", "y"])

    return _mapped(rows, run, "x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(id, label) of all ends of edges (x, y): the least id that links reach, by hooking and pointer jumping."""
    both = checkpoint(edges.select("x", "y").union(edges.select("y", "x")).distinct())
    labels = checkpoint(both.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("id"), F.least("x", "m").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("id").alias("y"), "label"), "y").groupBy("x").agg(F.min("label").alias("m"))
        hooked = labels.join(seen.withColumnRenamed("x", "id"), "id", "left").select("id", F.least("label", F.coalesce("m", "label")).alias("new"), "label")
        # A label's own label is at least as small; jumping halves the way that is left.
        jump = hooked.select(F.col("id").alias("__t"), F.col("new").alias("further"))
        after = checkpoint(hooked.join(jump, F.col("new") == F.col("__t"), "left").select("id", F.least("new", F.coalesce("further", "new")).alias("label"), F.col("label").alias("before")))
        changed = after.where("label <> before").limit(1).count()
        labels = after.drop("before")
        if not changed:
            return labels


def _linked() -> Column:
    return F.col("both") * 100 >= F.col("either") * PERCENT


def _each_once(df: DataFrame, repeated: DataFrame, n: int) -> DataFrame:
    """df with each id once; only the rows of the n ids that are repeated (x) move."""
    if not n:
        return df
    repeated = F.broadcast(repeated) if n <= set_groups.BROADCAST_IDS else repeated
    alone = df.join(repeated, F.col("id") == F.col("x"), "left_anti")
    return alone.unionByName(df.join(repeated, F.col("id") == F.col("x"), "left_semi").dropDuplicates(["id"]))


def _shared(found: DataFrame) -> DataFrame:
    """(x, y, c, i, j, nx, ny), x < y: how many pivots two documents share, the last one's places, and their sizes."""
    up = F.col("x") < F.col("y")
    pick = lambda a, b: F.max(F.when(up, F.col(a)).otherwise(F.col(b)))
    return found.groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.count(F.lit(1)).alias("c"), pick("i", "j").alias("i"), pick("j", "i").alias("j"), pick("nx", "ny").alias("nx"), pick("ny", "nx").alias("ny"))


def _possible(pairs: DataFrame, uncounted: DataFrame) -> DataFrame:
    """Pairs (x, y) whose sizes fit and that can still reach the needed intersection: the shared pivots, those that may
    be shared without having been counted (uncounted: id, b), and all shingles after the last shared pivot."""
    pairs = pairs.join(uncounted.select(F.col("id").alias("x"), F.col("b").alias("bx")), "x", "left").join(uncounted.select(F.col("id").alias("y"), F.col("b").alias("by")), "y", "left")
    most = F.col("c") + F.least(F.coalesce("bx", F.lit(0)), F.coalesce("by", F.lit(0))) + F.least(F.col("nx") - 1 - F.col("i"), F.col("ny") - 1 - F.col("j"))
    fits = (100 * F.least("nx", "ny") >= PERCENT * F.greatest("nx", "ny")) & (most * (100 + PERCENT) >= PERCENT * (F.col("nx") + F.col("ny")))
    return pairs.where(fits).select("x", "y")


def links(df: DataFrame, firsts: DataFrame, region: int = REGION, block: int = set_groups.BLOCK, part: tuple[int, int] = set_groups.PART) -> DataFrame:
    """Verified links (x, y) between distinct sets that make up all classes; df is (id, text), firsts (id, n, pivots,
    sketch)."""
    rows = _placed_rows(df, firsts.select("id", "n", "pivots"), region)
    found = checkpoint(regions(rows.repartition("s").sortWithinPartitions("s", "x"), region))
    large = found.where("s IS NOT NULL")
    uncounted = large.groupBy(F.col("x").alias("id")).agg(F.count(F.lit(1)).alias("b"))
    pairs = checkpoint(resembling(checkpoint(_possible(_shared(found.where("s IS NULL")), uncounted)), firsts.select("id", "n", "sketch")))
    verified = verify(pairs, lambda ids: set_groups.near(df, c := checkpoint(ids), c.count()))
    near = checkpoint(verified.where(_linked()).select("x", "y"))
    if not large.limit(1).count():
        return near
    # Regions of one first document share most of their documents; together they are its ball, compared once.
    balls = checkpoint(large.select(F.col("y").alias("g"), F.col("x").alias("id"), F.col("nx").alias("n")).distinct().withColumn("home", F.lit(True)))
    return near.union(set_groups.forests(set_groups.cells(balls, df, block, part), df, block, part))


def _frequent(pivots: DataFrame, region: int, most: int) -> np.ndarray:
    """The `most` most frequent of (u) among those that occur more than `region` times, sorted."""
    found = pivots.groupBy("u").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > region).orderBy(F.col("k").desc(), "u").limit(most).select("u")
    return np.sort(np.array([r["u"] for r in found.toLocalIterator()], np.int64))


def _placed_rows(df: DataFrame, lists: DataFrame, region: int) -> DataFrame:
    """Rows (s, x, np) under an order in which frequent pivots come last."""
    w = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    moved = _frequent(lists.select(F.explode(F.slice("pivots", F.lit(1), w.cast("int"))).alias("s")).select(F.shiftright("s", 32).alias("u")), region, MOVED)
    before, more = np.empty(0, np.int64), None  # documents whose kept pivots ran out, with all of theirs
    for k in range(ROUNDS if len(moved) else 0):
        new = checkpoint(entered(lists if more is None else lists.unionByName(more), moved, before))
        short = checkpoint(new.where("x IS NOT NULL").select("x").distinct())
        if n := short.count():
            added = checkpoint(whole(set_groups.near(df, short, n)))
            more = added if more is None else more.unionByName(added)
            new = new.unionByName(entered(added, moved, moved))
        further = np.setdiff1d(_frequent(new.where("u IS NOT NULL").select("u"), region, MOVED - len(moved)), moved) if k < ROUNDS - 1 and len(moved) < MOVED else before[:0]
        if not len(further):
            break
        before, moved = moved, np.union1d(moved, further)
    rows = placed(lists, moved)
    return rows if more is None else rows.unionByName(placed(more, moved))


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", region: int = REGION, count_links: bool = False, block: int = set_groups.BLOCK, part: tuple[int, int] = set_groups.PART) -> DataFrame:
    """(id, n_shingles, component_id, copy_of) for every row; copy_of is the least id with an equal set. With count_links
    also n_links: how many other rows have a set within 1/4, equal sets included."""
    small_batches(df.sparkSession)
    texts = _texts(df, id_col, text_col)
    stored = checkpoint(sets(texts))
    small = stored.select("id", "n", "s1", "s2")
    groups = small.where("n > 0").groupBy("s1", "s2", "n").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    # Only sets of several documents move; single ones are their own.
    several = checkpoint(groups.where("copies > 1").select("s1", "s2", "n", "rep", "copies"))
    if several.count() <= set_groups.BROADCAST_IDS:
        several = F.broadcast(several)
    members = checkpoint(small.join(several, ["s1", "s2", "n"], "left").select("id", "n", F.coalesce("rep", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies")))
    repeated = checkpoint(small.where("n > 0").groupBy(F.col("id").alias("x")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("x"))
    n_repeated = repeated.count()
    copies = checkpoint(members.where("n > 0 AND id <> rep").select(F.col("id").alias("x")).distinct())
    n_copies = copies.count()
    distinct = stored.where("n > 0").select("id", "n", "pivots", "sketch")
    if n_copies:
        distinct = distinct.join(F.broadcast(copies) if n_copies <= set_groups.BROADCAST_IDS else copies, F.col("id") == F.col("x"), "left_anti")
    once = _each_once(texts, repeated, n_repeated)
    labels = components(links(once, _each_once(distinct, repeated, n_repeated), region, block, part))
    more = []
    if count_links:
        reps = _each_once(members.where("n > 0 AND id = rep"), repeated, n_repeated).select("id", "n", "copies")
        inside = checkpoint(reps.join(labels, "id").select(F.col("label").alias("g"), "id", "n", F.lit(True).alias("home"), "copies"))
        labels = labels.join(set_groups.counts(inside, once, block, part), "id", "left")
        more = [F.when(F.col("n") > 0, F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("n_links")]
    # Written first, so that a set of many copies can be split, or the labels broadcast.
    labels = checkpoint(labels.withColumnRenamed("id", "rep"))
    joined = members.join(F.broadcast(labels) if labels.count() <= set_groups.BROADCAST_IDS else labels, "rep", "left")
    named = lambda c: F.when(c < NAMELESS, c)
    component = F.when(F.col("n") > 0, F.coalesce("label", "rep")).otherwise(F.col("id"))
    return joined.select(named(F.col("id")).alias("id"), F.col("n").alias("n_shingles"), named(component).alias("component_id"), named(F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id"))).alias("copy_of"), *more, F.col("id").alias("key"), component.alias("component_key"))


def op6(df: DataFrame) -> DataFrame:
    """The digest columns of the join contract."""
    found = classes(df, count_links=True)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "n_links")


def one_per_class(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows without those that are near copies of a row that stays: of each class one row of its least id stays, also of
    repeated rows and of classes without an id. Rows without words are no copies of anything and all stay. All columns are kept as
    they are, whatever their names."""
    slim = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = classes(slim, "id", "text").where("n_shingles > 0")
    gone = checkpoint(found.where("key <> component_key").select(F.col("key").alias("x")).distinct())
    again = checkpoint(found.where("key = component_key").groupBy(F.col("key").alias("x")).agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("x"))
    rows = df.select(_key(F.col(id_col), F.col(text_col)).alias("id"), F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"))
    few = lambda t: F.broadcast(t) if t.count() <= set_groups.BROADCAST_IDS else t
    left = rows.join(few(gone), F.col("id") == F.col("x"), "left_anti")
    if again.limit(1).count():
        several = few(again)
        one = left.join(several, F.col("id") == F.col("x"), "left_semi").groupBy("id").agg(F.first("row").alias("row"))
        left = left.join(several, F.col("id") == F.col("x"), "left_anti").unionByName(one)
    return left.select("row.*")
