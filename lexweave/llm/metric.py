"""Exact radius join of strings by metric-space partitioning.

The metric is Damerau-Levenshtein: characters added, lost or changed, and neighbours swapped, one edit each. The
strings begin in one cell. A cell that holds more than its bound is split by a pivot and a distance m: inside are the
strings at most m from the pivot, outside the others, and the boundary strings, at most the radius beyond m, are
replicated to the other side. By the triangle inequality |d(a, pivot) - d(b, pivot)| <= d(a, b), so no pair within the
radius is parted. Pivots are strings sampled in the cell and the empty string; the one is taken that replicates least.
All oversized cells are split at once, round by round, until every cell is within the bound: the number of pivots and
cells grows with the table, each string goes only to the cells the inequality leaves open, and no task gets more than
a cell. A cell that no pivot splits (its strings are all equally far from each other) is joined block by block.

Inside a cell the join is exact without comparing all pairs: two strings within one edit have a string in common that
lies at most one deletion from both, so candidates meet there, by hashes of the deletions, and are then verified.

Trees are built where the cells are, from at most ``SAMPLE`` strings a cell; what reaches the driver is the trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import checkpointed, parallelism

#: Strings a cell holds at most: between these, by the number of strings and of tasks.
LEAST, MOST = 3_000, 100_000
#: Strings sampled in a cell that is split, pivots tried for each split, and the fewest sampled strings that are split.
SAMPLE, TRIED, FEWEST = 4_000, 12, 64
#: Strings longer than this are split by their length, the distance to the empty string.
LONG = 128
RADIUS = 1


def codes(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all strings in a row, length of each)."""
    flat = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return flat, np.fromiter(map(len, strings), np.int64, len(strings))


def matrix(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points by place and string, 0 beyond the end; length of each)."""
    flat, n = codes(strings)
    out = np.zeros((int(n.max(initial=0)), len(strings)), np.uint32)
    owner = np.repeat(np.arange(len(strings)), n)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n), owner] = flat
    return out, n


def distances(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Damerau-Levenshtein distance of every column of ``x`` (places by strings, lengths n) to that of ``y``, or to its only one."""
    places, count = x.shape
    rows = len(y)
    h = np.empty((rows + 1, places + 1, count), np.int16)
    h[0] = np.arange(places + 1, dtype=np.int16)[:, None]
    # the last row of y before this one that has the character of each place, 0 for none
    row_of = np.zeros((places, count), np.int16)
    for i in range(1, rows + 1):
        h[i, 0] = i
        same = x == y[i - 1]
        at = np.zeros(count, np.int64)  # the last place before this one that has the character of y, 0 for none
        for j in range(1, places + 1):
            eq = same[j - 1]
            best = np.minimum(h[i - 1, j - 1] + ~eq, np.minimum(h[i - 1, j], h[i, j - 1]) + 1)
            k = row_of[j - 1]
            swap = np.flatnonzero((k > 0) & (at > 0))
            if len(swap):
                kk, ll = k[swap].astype(np.int64), at[swap]
                best[swap] = np.minimum(best[swap], h[kk - 1, ll - 1, swap] + (i - kk - 1) + 1 + (j - ll - 1))
            h[i, j] = best
            at[eq] = j
        row_of[same] = i
    return h[m, n, np.arange(count)]


def distance(a: str, b: str) -> int:
    return int(distances(*matrix([a]), *matrix([b]))[0])


def one_edit(a: str, b: str) -> bool:
    """At most one character added, lost or changed, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def tree(sample: list[str], share: float, first: bool = True) -> tuple | int:
    """Splits of a sample: (pivot, m, inner, inside, outside) or a leaf (its number).

    ``share`` is the part of the sample a leaf may be. ``inner`` tells that the boundary strings are replicated inside.
    The ``first`` tree begins with a split at the length ``LONG``: beyond it the empty string is the only pivot.
    """
    leaves = iter(range(1 << 30))
    least = max(FEWEST, 0.7 * share * len(sample))

    def split(strings: list[str], depth: int) -> tuple | int:
        if len(strings) <= least or depth > 40:
            return next(leaves)
        n = np.fromiter(map(len, strings), np.int64, len(strings))
        tried: list[tuple[str, np.ndarray]] = [("", n)]
        # the sample is sorted, so these are spread over it
        pivots = [p for p in strings[:: max(1, len(strings) // TRIED)][:TRIED] if p]
        if pivots and n.max() <= LONG + RADIUS:
            (x, _), (y, m) = matrix(strings), matrix(pivots)
            every = distances(np.tile(x, len(pivots)), np.tile(n, len(pivots)), np.repeat(y, len(n), axis=1), np.repeat(m, len(n)))
            tried += zip(pivots, every.reshape(len(pivots), -1))
        best: tuple | None = None
        for p, d in tried:
            for m in np.unique(d)[:-1].tolist():
                for inner in (True, False):
                    a, b = (d <= m + RADIUS, d > m) if inner else (d <= m, d > m - RADIUS)
                    u, v = a.mean(), b.mean()
                    if max(u, v) < 0.95 and (best is None or u**1.5 + v**1.5 < best[0]):
                        best = (u**1.5 + v**1.5, p, m, inner, a, b)
        if best is None:
            return next(leaves)
        _, p, m, inner, a, b = best
        inside = split([strings[i] for i in np.flatnonzero(a)], depth + 1)
        return (p, m, inner, inside, split([strings[i] for i in np.flatnonzero(b)], depth + 1))

    if first:
        inside = split([s for s in sample if len(s) <= LONG + RADIUS], 0)
        return ("", LONG, True, inside, split([s for s in sample if len(s) > LONG], 0))
    return split(sample, 0)


def leaves_of(node: tuple | int) -> int:
    return 1 if isinstance(node, int) else leaves_of(node[3]) + leaves_of(node[4])


def routed(strings: list[str], node: tuple | int) -> Iterator[tuple[int, np.ndarray]]:
    """(leaf, places in ``strings``) of the leaves that get a string."""
    x, n = matrix([s if len(s) <= LONG + RADIUS else "" for s in strings])
    n = np.fromiter(map(len, strings), np.int64, len(strings))
    todo = [(node, np.arange(len(strings)))]
    while todo:
        node, at = todo.pop()
        if isinstance(node, int):
            yield node, at
            continue
        p, cut, inner, inside, outside = node
        if p:
            # strings of about one length at a time, so that few places are empty
            d = np.empty(len(at), np.int64)
            y, m = matrix([p])
            for lo, hi in ((0, 8), (9, 16), (17, 32), (33, LONG + RADIUS)):
                some = np.flatnonzero((n[at] >= lo) & (n[at] <= hi))
                for k in range(0, len(some), 4096):
                    part = some[k : k + 4096]
                    d[part] = distances(x[: min(hi, len(x)), at[part]], n[at[part]], y, m)
        else:
            d = n[at]
        a, b = (d <= cut + RADIUS, d > cut) if inner else (d <= cut, d > cut - RADIUS)
        todo += [(child, at[k]) for child, k in ((inside, a), (outside, b)) if k.any()]


def close(strings: list[str]) -> Iterator[tuple[list[str], list[str]]]:
    """All pairs of different strings within one edit, by hashes of their deletions."""
    if len(strings) < 2:
        return
    flat, n = codes(strings)
    start = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(strings)), n)
    place = np.arange(len(flat)) - start[owner]
    mask = (1 << 64) - 1
    base, inverse = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
    power = np.ones(int(n.max(initial=0)) + 1, np.uint64)
    np.multiply.accumulate(np.full(len(power) - 1, base & mask, np.uint64), out=power[1:])
    mixed = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xA0761D6478BD642F)
    value = mixed * power[place]
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    begin, end = sums[start], sums[start + n]
    before = sums[:-1] - begin[owner]
    after = (end[owner] - sums[1:]) * np.uint64(inverse)
    key = np.concatenate([end - begin, before + after])
    who = np.concatenate([np.arange(len(strings)), owner])
    order = np.lexsort((who, key))
    key, who = key[order], who[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (who[1:] != who[:-1])])
    key, who = key[first], who[first]
    seen: set[tuple[int, int]] = set()
    step, live = 1, np.arange(len(key) - 1)
    while len(live):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        out: tuple[list[str], list[str]] = ([], [])
        for i, j in zip(who[live].tolist(), who[live + step].tolist()):
            if (i, j) not in seen and one_edit(strings[i], strings[j]):
                seen.add((i, j))
                out[0].append(strings[i])
                out[1].append(strings[j])
        if out[0]:
            yield out
        step += 1


def cells(strings: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows (core, cell): every string of ``strings`` (core, distinct, read once a round) in the cells it is in, each within the bound where a pivot splits it."""
    placed = strings.where("core IS NOT NULL").select("core", F.lit(0).cast("long").alias("cell"))
    over = {0: placed.count()}
    bound = bound or min(MOST, max(LEAST, over[0] // (4 * parallelism(strings.sparkSession))))
    whole: set[int] = set()  # cells no pivot splits
    last = 0
    while over := {c: n for c, n in over.items() if n > bound and c not in whole}:

        def build(t: pa.Table) -> pa.Table:
            cell = t["cell"][0].as_py()
            return pa.table({"cell": [cell], "tree": pa.array([pickle.dumps(tree(sorted(t["core"].to_pylist()), bound / over[cell], last == 0))], pa.binary())})

        # the sample of a cell: those of the least hash, of about SAMPLE strings
        rate = F.element_at(F.create_map(*(x for c, n in over.items() for x in (F.lit(c), F.lit(min(1.0, SAMPLE / n))))), F.col("cell")) if len(over) <= 64 else F.lit(min(1.0, SAMPLE / max(over.values())))
        chance = F.pmod(F.xxhash64("core", F.lit(last)), F.lit(1 << 30)) / float(1 << 30)
        sampled = placed.where(F.col("cell").isin(*over)).where(chance < rate)
        built = {r["cell"]: pickle.loads(r["tree"]) for r in sampled.groupBy("cell").applyInArrow(build, "cell long, tree binary").collect()}
        trees, base = {}, {}
        for c in over:
            if isinstance(built.get(c, 0), int):
                whole.add(c)
            else:
                trees[c], base[c] = built[c], last + 1
                last += leaves_of(built[c])

        def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                core, cell = b["core"].to_pylist(), np.asarray(b["cell"])
                for c in np.unique(cell).tolist():
                    at = np.flatnonzero(cell == c)
                    for leaf, k in routed([core[i] for i in at], trees[c]) if c in trees else [(-1, np.arange(len(at)))]:
                        yield pa.RecordBatch.from_pydict({"core": pa.array([core[i] for i in at[k]], pa.string()), "cell": np.full(len(k), c if leaf < 0 else base[c] + leaf)})

        if trees:
            placed = checkpointed(placed.repartition(parallelism(strings.sparkSession)).mapInArrow(route, "core string, cell long"))
            over = {r["cell"]: r["count"] for r in placed.groupBy("cell").count().where(F.col("count") > bound).collect()}
    return placed


def radius_join(strings: DataFrame, bound: int | None = None) -> DataFrame:
    """Rows (a, b, d): all pairs of different strings of ``strings`` (core, distinct) within one edit, both ways."""
    placed = cells(strings, bound)
    # a cell that could not be split: every pair of its blocks is a group
    most = bound or MOST
    big = placed.groupBy("cell").count().withColumn("blocks", F.ceil(F.col("count") / most).cast("int")).where("blocks > 1").select("cell", "blocks")
    p = placed.join(big, "cell", "left").withColumn("n", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("core"), F.col("n")).cast("int")
    group = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda k: F.struct(F.least(mine, k).alias("i"), F.greatest(mine, k).alias("j")))
    p = p.select("core", "cell", F.explode(group).alias("g"))

    def inside(t: pa.Table) -> pa.Table:
        a: list[str] = []
        b: list[str] = []
        for x, y in close(t["core"].to_pylist()):
            a += x
            b += y
        return pa.table({"a": pa.array(a, pa.string()), "b": pa.array(b, pa.string())})

    met = p.groupBy("cell", "g").applyInArrow(inside, "a string, b string")
    met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().withColumn("d", F.lit(1))
    return met.unionByName(met.select(F.col("b").alias("a"), F.col("a").alias("b"), "d"))
