"""Comparing the sets of a group with each other, exactly and whatever the group's size.

A group holds homes and guests; every pair of which one is a home is to be compared. Groups that fit into a task are dealt
out whole, many to a task. Larger ones first become Voronoi cells, cells of cells if need be: some of their homes are
pivots, each document is a home of the cell of its nearest pivot, and a guest of those other cells that can hold a partner
within `REACH`. With homes x of cell a and y of cell b, d(x, y) <= REACH implies d(y, a) <= d(y, b) + 2 REACH and
d(y, a) <= (radius of cell a) + REACH; two homes of different cells meet in the one whose pivot has the smaller id. Cells of more
homes or guests than a task holds are cut by a hash of the id into parts, and each two parts, one of homes at least, are
compared in a task of their own. Cells make less work where distances differ and no more than parts alone where they
do not; neither changes what is found.

Inside a task the sizes of all intersections come from one product of zero-one matrices, some columns at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimgraph.llm.common import checkpoint
from claimgraph.llm.shingling import PERCENT, shingles

#: The distance up to which two sets are linked.
REACH = 1 - PERCENT / 100
#: Shingles (8 bytes each) of a group, or of a part of one, that a task holds; a pair of parts is twice that.
BLOCK = 1 << 19
#: Sets of a part, on average: a sixteenth of the group's, but at least the first and at most the second number. Two
#: parts make a table of as many numbers of 4 bytes as the product of their sets.
PART = (256, 2048)
#: Most pivots by which a group is cut into cells at once, and how often cells are cut again.
PIVOTS, DEPTH = 64, 3
#: Shingles that are compared at once.
COLUMNS = 1024
#: Ids (8 bytes each) up to which a side is broadcast.
BROADCAST_IDS = 200_000


def near(df: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """Rows of (id, ...) whose ids are among the n of (x)."""
    return df.join(F.broadcast(ids) if n <= BROADCAST_IDS else ids, F.col("id") == F.col("x"), "left_semi")


def _parts(sets: Column, all_shingles: Column, block: int, part: tuple[int, int]) -> Column:
    """Parts into which so many sets of so many shingles in all are cut."""
    size = F.greatest(F.lit(part[0]), F.least(F.lit(part[1]), sets / 16))
    return F.greatest(F.lit(1), F.ceil(F.greatest(all_shingles / block, sets / size))).cast("int")


def _sizes(groups: DataFrame) -> DataFrame:
    """(g, homes, home_n, guests, guest_n, least): sets and shingles of each group, and the home that is always a pivot."""
    home = lambda c: F.coalesce(F.sum(F.when(F.col("home"), c)), F.lit(0))
    guest = lambda c: F.coalesce(F.sum(F.when(~F.col("home"), c)), F.lit(0))
    return groups.groupBy("g").agg(home(F.lit(1)).alias("homes"), home(F.col("n")).alias("home_n"), guest(F.lit(1)).alias("guests"), guest(F.col("n")).alias("guest_n"), F.min(F.when(F.col("home"), F.struct(F.xxhash64("id").alias("h"), "id")))["id"].alias("least"))


def _with_texts(dealt: DataFrame, texts: DataFrame) -> DataFrame:
    ids = checkpoint(dealt.select(F.col("id").alias("x")).distinct())
    return dealt.join(near(texts, ids, ids.count()), "id")


def _sets_of(table: pa.Table) -> list[np.ndarray]:
    return [shingles(raw.as_buffer().to_pybytes()) for raw in table.column("text").combine_chunks()]


def intersections(found: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """How many shingles each of the sets at the places `left` shares with each of those at `right`, which are alike if
    `same`; what a set shares with itself is left out then."""
    both = np.zeros((len(left), len(right)), np.float32)
    if not len(left) or not len(right):
        return both
    sides = [(np.concatenate([found[x] for x in side]), np.repeat(np.arange(len(side)), [len(found[x]) for x in side])) for side in (left, right)]
    # Only shingles that stand on both sides count, and of one part only those of two documents.
    one, counts = np.unique(sides[0][0], return_counts=True)
    shared = one[counts > 1] if same else np.intersect1d(one, sides[1][0])
    places = []
    for values, rows in sides:
        at = np.minimum(np.searchsorted(shared, values), max(len(shared) - 1, 0))
        keep = shared[at] == values if len(shared) else np.zeros(len(values), bool)
        at, rows = at[keep], rows[keep]
        order = np.argsort(at, kind="stable")
        places.append((at[order], rows[order]))
    for low in range(0, len(shared), COLUMNS):
        wide = min(COLUMNS, len(shared) - low)
        held = []
        for (at, rows), side in zip(places, (left, right), strict=True):
            some = slice(*np.searchsorted(at, [low, low + wide]))
            m = np.zeros((len(side), wide), np.float32)
            m[rows[some], at[some] - low] = 1
            held.append(m)
        both += held[0] @ held[1].T
    return both


def _linked(found: list[np.ndarray], left: np.ndarray, right: np.ndarray, same: bool) -> np.ndarray:
    """Whether 100 * intersection >= PERCENT * union, for each of `left` with each of `right`."""
    both = intersections(found, left, right, same).astype(np.float64)
    n, m = (np.array([len(found[x]) for x in side], np.float64) for side in (left, right))
    linked = 100 * both >= PERCENT * (n[:, None] + m[None, :] - both)
    if same:
        np.fill_diagonal(linked, False)
    return linked


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """Links (row, column), at most one for each of either, that reach what all links reach."""
    out: list[tuple[int, int]] = []
    rows, columns = linked.any(1), linked.any(0)  # those not reached yet
    for seed in np.flatnonzero(rows):
        if not rows[seed]:
            continue
        rows[seed], front = False, np.array([seed])
        while len(front):
            to = np.flatnonzero(linked[front].any(0) & columns)
            out += zip(front[linked[np.ix_(front, to)].argmax(0)].tolist(), to.tolist(), strict=True)
            columns[to] = False
            front = np.flatnonzero(linked[:, to].any(1) & rows) if len(to) else to
            if len(front):
                out += zip(front.tolist(), to[linked[np.ix_(front, to)].argmax(1)].tolist(), strict=True)
                rows[front] = False
    return out


def cells(groups: DataFrame, texts: DataFrame, block: int = BLOCK, part: tuple[int, int] = PART) -> DataFrame:
    """Groups (g, id, n, home), a written table, with those of too many homes replaced by Voronoi cells. texts are
    (id, text), each id once."""
    done = []
    for level in range(DEPTH):
        sizes = _sizes(groups).withColumn("parts", _parts(F.col("homes"), F.col("home_n"), block, part))
        large = checkpoint(sizes.where("parts > 1").withColumn("blocks", _parts(F.col("homes") + F.col("guests"), F.col("home_n") + F.col("guest_n"), block, part)).select("g", "homes", "least", F.least("parts", F.lit(PIVOTS)).alias("wanted"), "blocks"))
        if not (n_large := large.count()):
            break
        large = F.broadcast(large) if n_large <= BROADCAST_IDS else large
        done.append(groups.join(large.select("g"), "g", "left_anti"))
        rows = groups.join(large, "g")
        drawn = F.pmod(F.xxhash64("id", F.lit(level)), F.lit(1 << 20)) * F.col("homes") < F.col("wanted") * F.lit(1 << 20)
        pivots = rows.where(F.col("home") & ((F.col("id") == F.col("least")) | drawn)).select("g", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("b"), "id", "n", F.lit(True).alias("pivot"), F.lit(False).alias("home"))
        members = rows.select("g", F.pmod(F.xxhash64("id"), F.col("blocks").cast("long")).cast("int").alias("b"), "id", "n", F.lit(False).alias("pivot"), "home")
        placed = checkpoint(_with_texts(members.unionByName(pivots), texts).groupBy("g", "b").applyInArrow(_place, "g long, cell long, id long, n long, home boolean, d double"))
        radius = placed.where("home").groupBy("g", "cell").agg(F.max("d").alias("radius"))
        groups = placed.join(radius, ["g", "cell"]).where(F.col("home") | (F.col("d") <= F.col("radius") + REACH + 1e-9))
        groups = checkpoint(groups.select(F.xxhash64("g", "cell", F.lit(level)).alias("g"), "id", "n", "home"))
    for other in done:
        groups = groups.unionByName(other)
    return checkpoint(groups) if done else groups


def _place(table: pa.Table) -> pa.Table:
    """The cells of a block's members among the group's pivots."""
    found = _sets_of(table)
    ids, sizes, home, pivot = (table.column(c).to_numpy() for c in ("id", "n", "home", "pivot"))
    center = np.flatnonzero(pivot)
    center, member = center[np.argsort(ids[center], kind="stable")], np.flatnonzero(~pivot)
    both = intersections(found, member, center, False).astype(np.float64)
    n, m = (np.array([len(found[x]) for x in side], np.float64) for side in (member, center))
    d = 1 - both / (n[:, None] + m[None, :] - both)
    nearest = d.argmin(1)
    own = home[member][:, None] & (nearest[:, None] == np.arange(len(center))[None, :])
    guest = (d <= d.min(1, keepdims=True) + 2 * REACH + 1e-9) & (~home[member][:, None] | (np.arange(len(center))[None, :] < nearest[:, None]))
    x, c = np.nonzero(own | guest)
    pa.default_memory_pool().release_unused()
    g = np.full(len(x), table.column("g")[0].as_py() if table.num_rows else 0, np.int64)
    return pa.table({"g": g, "cell": ids[center][c], "id": ids[member][x], "n": sizes[member][x], "home": own[x, c], "d": d[x, c]})


def _dealt(groups: DataFrame, texts: DataFrame, block: int, part: tuple[int, int], *more: str) -> DataFrame:
    """The rows of each task (cut, bin): whole groups, or two parts a <= b of one."""
    sizes = _sizes(groups).where("homes > 0 AND homes + guests > 1").drop("least")
    whole = _parts(F.col("homes") + F.col("guests"), F.col("home_n") + F.col("guest_n"), block, part) == 1
    guest_parts = F.when(F.col("guests") > 0, _parts(F.col("guests"), F.col("guest_n"), block, part)).otherwise(0)
    sizes = checkpoint(sizes.select("g", whole.alias("whole"), F.when(whole, 1).otherwise(_parts(F.col("homes"), F.col("home_n"), block, part)).alias("hp"), F.when(whole, 0).otherwise(guest_parts).alias("gp"), (F.col("home_n") + F.col("guest_n")).alias("all")))
    # Whole groups are dealt out in smaller lots than a task could hold, so that many tasks share them evenly.
    n_bins = max(1, (sizes.where("whole").agg(F.sum("all")).first()[0] or 0) // max(1, block // 8))
    rows = groups.join(sizes.drop("all"), "g").withColumn("home", F.col("home") | F.col("whole"))
    spread = lambda n: F.pmod(F.xxhash64("id"), F.greatest(n, F.lit(1)).cast("long")).cast("int")
    rows = rows.withColumn("part", F.when(F.col("home"), spread(F.col("hp"))).otherwise(F.col("hp") + spread(F.col("gp"))))
    last = F.when(F.col("home"), F.col("hp") + F.col("gp") - 1).otherwise(F.col("hp") - 1)
    rows = rows.withColumn("of", F.explode(F.sequence(F.lit(0), last))).select("g", "whole", "id", "part", *more, F.least("part", "of").alias("a"), F.greatest("part", "of").alias("b"))
    bins = F.when(F.col("whole"), F.pmod(F.xxhash64("g"), F.lit(n_bins))).otherwise(F.xxhash64("g", "a", "b"))
    return _with_texts(checkpoint(rows.select((~F.col("whole")).alias("cut"), bins.alias("bin"), "g", "a", "b", "id", "part", *more)), texts)


def _compared(table: pa.Table) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(places, places, which of them are linked, whether both sides are one part) of each group or pair of parts."""
    if not table.num_rows:
        return
    g, a, b, part = (table.column(c).to_numpy() for c in ("g", "a", "b", "part"))
    found = _sets_of(table)
    order = np.lexsort((b, a, g))
    turns = np.flatnonzero((np.diff(g[order]) != 0) | (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)) + 1
    for at in np.split(order, turns):
        left, right = at[part[at] == a[at[0]]], at[part[at] == b[at[0]]]
        same = bool(a[at[0]] == b[at[0]])
        yield left, right, _linked(found, left, right, same), same


def forests(groups: DataFrame, texts: DataFrame, block: int = BLOCK, part: tuple[int, int] = PART) -> DataFrame:
    """Links (x, y) of groups (g, id, n, home), a written table, that reach what all their links reach: for each task and
    document two at most."""
    schema = pa.schema([("x", pa.int64()), ("y", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        pairs = [(ids[left[i]], ids[right[j]]) for left, right, linked, _ in _compared(table) for i, j in forest(linked)]
        pa.default_memory_pool().release_unused()
        return pa.Table.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], schema=schema)

    return checkpoint(_dealt(groups, texts, block, part).groupBy("cut", "bin").applyInArrow(run, "x long, y long").distinct())


def counts(groups: DataFrame, texts: DataFrame, block: int = BLOCK, part: tuple[int, int] = PART) -> DataFrame:
    """(id, linked) of groups (g, id, n, home, copies), a written table of homes alone, each id in one group: how many rows
    have another set within REACH, a set of c copies counting c times."""
    schema = pa.schema([("id", pa.int64()), ("linked", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        ids, copies, out = table.column("id").to_numpy(), table.column("copies").to_numpy(), [np.empty((0, 2), np.int64)]
        for left, right, linked, same in _compared(table):
            out.append(np.stack([ids[left], linked @ copies[right]], axis=1))
            if not same:
                out.append(np.stack([ids[right], copies[left] @ linked], axis=1))
        pa.default_memory_pool().release_unused()
        found = np.concatenate(out)
        return pa.Table.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], schema=schema)

    return _dealt(groups, texts, block, part, "copies").groupBy("cut", "bin").applyInArrow(run, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))
