"""Most similar vectors for every vector (problem 6).

Balanced posting lists. Centroids are fitted on a bounded random sample by hierarchical k-means that goes on until
every leaf holds about the same number of vectors, so lists are of like size wherever the data are dense. A graph of
nearest centroids, held in memory by every worker, is searched best-first for the lists of a vector. A vector on a
boundary is written to several lists (those within ``close`` times the distance of its nearest one, at most
``replicas``), and looks for its neighbours in the lists within ``wide`` times that distance, at most ``probes``.
Lists are joined by equality of their number and compared block-wise inside a list.

Every usable vector is indexed; only the fit sees a sample (``sample`` vectors, 50,000 by default, chosen by hash of
the id; the driver holds that many and no more). For tables far beyond a few hundred million vectors give a larger
sample, since the number of lists is bounded by it; lists that are expected to hold more than ``most`` members are
split into blocks, so that no task gets more, with the same result.

Defined results: vectors of another length, with null, NaN or infinite entries or all zero are unusable and have no
neighbours; norms do not matter; copies of a vector are indexed once and come out as neighbours of each other with
similarity 1; ties go to the smaller id; no vector is its own neighbour; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.session import checkpointed, spread

DEGREE, BEAM, STEPS = 32, 32, 12
SEEN = 500_000


def usable(batch: pa.RecordBatch, column: int, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, unit vectors) of the usable vectors of a batch."""
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    length = np.asarray(col.value_lengths().fill_null(0))
    rows = np.flatnonzero(length == dim)
    if not len(rows):
        return rows, np.zeros((0, dim), np.float32)
    flat = col.take(pa.array(rows)).flatten()
    v = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)  # nulls become NaN
    norm = np.sqrt((v * v).sum(1))
    with np.errstate(invalid="ignore", over="ignore"):
        scale = np.abs(v).max(1)
        big = np.isfinite(scale) & ~np.isfinite(norm) & (scale > 0)
        if big.any():
            v[big] /= scale[big, None]
            norm[big] = np.sqrt((v[big] * v[big]).sum(1))
        tiny = (norm == 0) & (scale > 0)
        if tiny.any():
            v[tiny] /= scale[tiny, None]
            norm[tiny] = np.sqrt((v[tiny] * v[tiny]).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], (v[ok] / norm[ok, None]).astype(np.float32)


class Lists:
    """Centroids of the posting lists and the graph that is searched for them."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 11):
        self.rng = np.random.default_rng(seed)
        self.tops: list[np.ndarray] = []
        out: list[np.ndarray] = []
        self._split(sample, leaf, out)
        self.centroids = np.array(out, np.float32)
        c = len(self.centroids)
        k = min(DEGREE, c - 1)
        self.graph = np.zeros((c, k), np.int64)
        for a in range(0, c, 2000):
            s = self.centroids[a : a + 2000] @ self.centroids.T
            s[np.arange(len(s)), a + np.arange(len(s))] = -np.inf
            if k:
                self.graph[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
        # entry points: as many as the root of the number of lists, spread by the hierarchy
        step = max(1, int(round(c**0.5)))
        self.entries = np.arange(0, c, step)
        self.norm = (self.centroids**2).sum(1)

    def _split(self, x: np.ndarray, leaf: int, out: list[np.ndarray]) -> None:
        if len(x) <= leaf:
            out.append(x.mean(0))
            return
        k = int(min(16, max(2, -(-len(x) // leaf))))
        c = x[self.rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            a = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
            for j in range(k):
                m = a == j
                c[j] = x[m].mean(0) if m.any() else x[self.rng.integers(len(x))]
        a = np.argmax(x @ c.T - 0.5 * (c**2).sum(1), axis=1)
        parts = [x[a == j] for j in range(k)]
        if max(map(len, parts)) > 0.95 * len(x):  # hardly separable: halves along the main spread
            d = x - x.mean(0)
            order = np.argsort(d @ d[np.argmax((d * d).sum(1))], kind="stable")
            parts = [x[order[: len(x) // 2]], x[order[len(x) // 2 :]]]
        for p in parts:
            if len(p):
                self._split(p, leaf, out)

    def search(self, q: np.ndarray, want: int) -> tuple[np.ndarray, np.ndarray]:
        """(list numbers, squared distances), nearest first, by best-first search of the graph; -1 fills up."""
        n, c = len(q), len(self.centroids)
        width = min(max(BEAM, want), c)
        rows = np.arange(n)[:, None]
        seen = np.zeros((n, c), bool)
        first = np.broadcast_to(self.entries, (n, len(self.entries)))
        ids = np.full((n, width), -1, np.int64)
        dist = np.full((n, width), np.inf, np.float32)
        opened = np.ones((n, width), bool)
        new_ids, new_dist = first, self.norm[self.entries] - 2 * (q @ self.centroids[self.entries].T)
        seen[:, self.entries] = True
        for step in range(STEPS + 1):
            all_ids = np.concatenate([ids, new_ids], 1)
            all_dist = np.concatenate([dist, new_dist], 1)
            all_open = np.concatenate([opened, np.zeros(new_ids.shape, bool)], 1)
            keep = np.argpartition(all_dist, width - 1, axis=1)[:, :width] if all_dist.shape[1] > width else np.broadcast_to(np.arange(all_dist.shape[1]), all_dist.shape)
            ids, dist, opened = all_ids[rows, keep], all_dist[rows, keep], all_open[rows, keep]
            if step == STEPS or not self.graph.shape[1]:
                break
            # open the two nearest that are not yet opened
            rank = np.where(opened, np.inf, dist)
            pick = np.argpartition(rank, min(1, width - 1), axis=1)[:, : min(2, width)]
            valid = np.isfinite(rank[rows, pick])
            opened[rows, pick] = True
            around = self.graph[np.where(valid, ids[rows, pick], 0)].reshape(n, -1)
            fresh = ~seen[rows, around] & np.repeat(valid, self.graph.shape[1], axis=1)
            seen[rows, around] |= fresh
            r, k = np.nonzero(fresh)
            node = around[r, k]
            d = self.norm[node] - 2 * np.einsum("ij,ij->i", q[r], self.centroids[node])
            new_ids = np.where(fresh, around, -1)
            new_dist = np.full(around.shape, np.inf, np.float32)
            new_dist[r, k] = d
            # a node reached twice in one step counts once
            order = np.argsort(new_ids, axis=1, kind="stable")
            si = new_ids[rows, order]
            dup = np.zeros_like(fresh)
            dup[:, 1:] = (si[:, 1:] == si[:, :-1]) & (si[:, 1:] >= 0)
            back = np.zeros_like(dup)
            back[rows, order] = dup
            new_dist[back] = np.inf
        order = np.argsort(dist, axis=1)[:, :want]
        ids, dist = ids[rows, order], dist[rows, order]
        ids[~np.isfinite(dist)] = -1
        return ids, np.maximum(dist + (q * q).sum(1)[:, None], 0)


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, sims.shape[1])
    part = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    return ids[part], np.take_along_axis(sims, part, 1)


def class_neighbours(
    df: DataFrame, id_col: str, vec_col: str, k: int, dim: int, floor: float | None, query: str | None, list_size: int, replicas: int, probes: int, close: float, wide: float, sample: int, most: int
) -> tuple[DataFrame, DataFrame]:
    """(members, edges): rows (id, cls, asks) and rows (cls, near, sim), each class with its k nearest other ones."""
    spark = df.sparkSession
    src = df.select(F.col(id_col).alias("id"), F.col(vec_col).alias("v"), F.expr(query or "true").alias("asks")).where(F.col("v").isNotNull())
    kind = src.schema["id"].dataType.simpleString()
    n = src.count()
    share = max(1, round(1_000_000 * min(1.0, sample / max(1, n))))
    rows = src.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < share).select("v").limit(2 * sample).toArrow()
    _, fit = usable(rows.combine_chunks().to_batches()[0], 0, dim) if rows.num_rows else (None, np.zeros((0, dim), np.float32))
    fit = np.unique(fit, axis=0)
    leaf = max(4, round(list_size * len(fit) / max(1, n)))
    # lists of more than ``most`` members, as there are once the sample bounds their number, lie in blocks of their own tasks
    blocks = max(1, -(-n * replicas * leaf // (max(1, len(fit)) * most)))
    lists = spark.sparkContext.broadcast(Lists(fit, leaf) if len(fit) else Lists(np.zeros((1, dim), np.float32), 4))  # at most ``sample`` centroids

    def classes(v: np.ndarray) -> np.ndarray:
        buf = np.ascontiguousarray(np.round(v, 6) + np.float32(0))
        return np.array([xxhash.xxh3_64_intdigest(r) - 2**63 for r in buf.view(f"V{4 * dim}").ravel()], np.int64)

    def who(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, v = usable(b, 1, dim)
            take = pa.array(at)
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), pa.array(classes(v), pa.int64()), b.column(2).take(take)], ["id", "cls", "asks"])

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ls = lists.value
        seen: dict[int, bool] = {}
        for big in batches:
            for lo in range(0, big.num_rows, 2000):
                b = big.slice(lo, 2000)
                at, v = usable(b, 1, dim)
                if not len(at):
                    continue
                cls = classes(v)
                asks = np.asarray(b.column(2).take(pa.array(at)).fill_null(False)).astype(bool)
                # a class is written once a task, and once more if a later copy asks
                fresh = np.zeros(len(at), bool)
                for i, (c, a) in enumerate(zip(cls.tolist(), asks.tolist())):
                    if c not in seen or (a and not seen[c]):
                        fresh[i] = True
                        if len(seen) < SEEN or c in seen:
                            seen[c] = a
                v, cls, asks = v[fresh], cls[fresh], asks[fresh]
                if not len(v):
                    continue
                ids, d = ls.search(v, max(replicas, probes))
                d = np.sqrt(d)
                member = (ids >= 0) & (d <= close * d[:, :1] + 1e-6)
                member[:, replicas:] = False
                looks = (ids >= 0) & (d <= wide * d[:, :1] + 1e-6) & asks[:, None]
                looks[:, probes:] = False
                r, j = np.nonzero(member | looks)
                # a member lies in one block of its list, a vector that looks goes to all of them
                home = cls[r] % blocks
                times = np.where(looks[r, j], blocks, 1)
                e = np.repeat(np.arange(len(r)), times)
                block = np.where(times[e] > 1, np.arange(len(e)) - np.repeat(np.cumsum(times) - times, times), home[e])
                r, j, home = r[e], j[e], home[e]
                role = (member[r, j] & (block == home)).astype(np.int8) + 2 * looks[r, j].astype(np.int8)
                raw = v[r].tobytes()
                vec = pa.Array.from_buffers(pa.binary(), len(r), [None, pa.py_buffer(np.arange(0, 4 * dim * len(r) + 1, 4 * dim, np.int32).tobytes()), pa.py_buffer(raw)])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r, j].astype(np.int64) * blocks + block), pa.array(cls[r]), pa.array(role.astype(np.int32)), vec], ["list", "cls", "role", "vec"])

    def compare(group: pa.Table) -> pa.Table:
        g = group.combine_chunks()
        cls, role = g["cls"].to_numpy(), g["role"].to_numpy()
        order = np.lexsort((-role, cls))
        first = np.ones(len(cls), bool)
        first[1:] = cls[order][1:] != cls[order][:-1]
        # copies from several tasks: one row, with the roles of all
        has = np.zeros(int(first.sum()), np.int32)
        np.bitwise_or.at(has, np.cumsum(first) - 1, role[order])
        one = order[first]
        cls = cls[one]
        vec = g["vec"].combine_chunks()
        v = np.frombuffer(b"".join(vec.take(pa.array(one)).to_pylist()), np.float32).reshape(-1, dim)
        m = np.flatnonzero(has & 1)
        q = np.flatnonzero(has & 2)
        mv, mc = v[m], cls[m]
        out: tuple[list, list, list] = ([], [], [])
        step = max(1, 4_000_000 // max(1, len(m)))
        for a in range(0, len(q), step):
            rows_ = q[a : a + step]
            s = v[rows_] @ mv.T
            s[cls[rows_][:, None] == mc[None, :]] = -2
            if floor is not None:
                i, j = np.nonzero(s >= floor - 1e-4)
                if not len(i):
                    continue
                val = s[i, j]
                o = np.lexsort((-val, i))
                i, j, val = i[o], j[o], val[o]
                start = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]]))
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                # equals of the last place stay, so that ties are settled by id later
                last = np.repeat(val[np.minimum(start + k - 1, np.append(start[1:], len(i)) - 1)], np.diff(np.append(start, len(i))))
                keep = (rank < k) | (val >= last)
                i, j = i[keep], j[keep]
                sims = np.einsum("ij,ij->i", v[rows_[i]].astype(np.float64), mv[j].astype(np.float64))
                hit = sims >= floor - 1e-6
                out[0].append(cls[rows_[i]][hit])
                out[1].append(mc[j][hit])
                out[2].append(sims[hit])
            elif len(m):
                near, sims = _top(mc, s, k)
                ok = sims.ravel() > -1.5
                out[0].append(np.repeat(cls[rows_], near.shape[1])[ok])
                out[1].append(near.ravel()[ok])
                out[2].append(sims.ravel().astype(np.float64)[ok])
        c = [np.concatenate(x) if x else np.zeros(0) for x in out]
        return pa.table({"cls": c[0].astype(np.int64), "near": c[1].astype(np.int64), "sim": c[2].astype(np.float64)})

    members = src.mapInArrow(who, f"id {kind}, cls long, asks boolean")
    posted = spread(src).mapInArrow(post, "list long, cls long, role int, vec binary")
    edges = posted.groupBy("list").applyInArrow(compare, "cls long, near long, sim double")
    edges = edges.groupBy("cls", "near").agg(F.max("sim").alias("sim"))
    best = edges.groupBy("cls").agg(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "near"))).alias("l"))  # at most k x probes entries
    cut = F.filter("l", lambda x: x["d"] <= F.element_at("l", F.least(F.lit(k), F.size("l")))["d"])
    return members, best.select("cls", F.explode(cut).alias("x")).select("cls", "x.near", (-F.col("x.d")).alias("sim"))


def nearest(
    df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, floor: float | None = None, query: str | None = None,
    list_size: int = 400, replicas: int = 3, probes: int = 48, close: float = 1.1, wide: float = 1.5, sample: int = 50_000,
    most: int = 20_000,
) -> DataFrame:
    """Rows (``id_col``, near_id, similarity): for each usable vector (for which ``query`` holds) its k most similar ones.

    With ``floor`` only neighbours of at least that similarity come out; so close a pair shares its nearest lists,
    so few probes do.
    """
    members, edges = class_neighbours(df, id_col, vec_col, k, dim, floor, query, list_size, replicas, probes, close, wide, sample, most)
    members = checkpointed(members)
    edges = checkpointed(edges)
    several = members.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cls")
    every = edges.unionByName(several.select("cls", F.col("cls").alias("near"), F.lit(1.0).alias("sim")))
    wanted = every.select(F.col("near").alias("cls")).distinct()

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the k+1 smallest ids of each class of this task
        got: dict[int, list] = {}
        for b in batches:
            for i, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                l_ = got.setdefault(c, [])
                l_.append(i)
                if len(l_) > 4 * (k + 1):
                    l_.sort()
                    del l_[k + 1 :]
            if len(got) > 100_000:
                yield flat(got)
                got = {}
        yield flat(got)

    def flat(got: dict) -> pa.RecordBatch:
        pairs = [(i, c) for c, l_ in got.items() for i in sorted(l_)[: k + 1]]
        return pa.RecordBatch.from_arrays([pa.array([i for i, _ in pairs], type=id_type), pa.array([c for _, c in pairs], pa.int64())], ["id", "cls"])

    kind = members.schema["id"].dataType.simpleString()
    id_type = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind]
    few = members.join(wanted, "cls", "left_semi").select("id", "cls").mapInArrow(least, f"id {kind}, cls long")
    few = few.groupBy(F.col("cls").alias("near")).agg(F.slice(F.sort_array(F.collect_list("id")), 1, k + 1).alias("ids"))
    offers = (
        every.join(few, "near").select("cls", "sim", F.explode("ids").alias("near_id"))
        .groupBy("cls").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("d"), "near_id"))), 1, k + 1).alias("offer"))
    )
    own = members.where("asks").join(offers, "cls")
    return own.select("id", F.explode(F.slice(F.filter("offer", lambda x: x["near_id"] != F.col("id")), 1, k)).alias("x")).select(F.col("id").alias(id_col), F.col("x.near_id").alias("near_id"), (-F.col("x.d")).alias("similarity"))


def close_pairs(df: DataFrame, id_col: str, vec_col: str, k: int = 5, dim: int = 64, floor: float = 0.9) -> DataFrame:
    """Rows (id_a, id_b): pairs of at least ``floor`` in which one is among the k most similar of the other."""
    near = nearest(df, id_col, vec_col, k, dim, floor=floor, replicas=2, probes=4, close=1.05, wide=1.2).where(F.col("similarity") >= floor)
    return near.select(F.least(id_col, "near_id").alias("id_a"), F.greatest(id_col, "near_id").alias("id_b")).distinct()
