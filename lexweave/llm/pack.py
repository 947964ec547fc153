"""Filling containers of a fixed capacity with items of varying size (problem 9).

Best-fit decreasing, exactly as if the items came one by one, but over sizes instead of items: sizes are integers
of at most ``capacity``, so the plan needs only how many items have each size (at most ``capacity`` rows, whatever
the data). Open containers are kept as runs of equal remaining capacity; a segment tree over the capacities finds
the tightest run that fits in logarithmic time. The plan is a list of placements (size, ranks from-to -> containers
from-to); each item finds its container by its rank among the items of its size. Ranks are counted per size and
salt, so a size that holds a third of all rows is still spread over all tasks.

Defined results: null and empty texts are no items; a text larger than the capacity is split into full pieces and a
rest, all others stay whole; repeated rows are items each; an empty table gives no container; extra columns are
ignored. Among items of equal size the order is by salt and id, which changes no container's fill.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexweave.llm import tokenize
from lexweave.session import checkpointed, parallelism


class TightestFit:
    """Segment tree over remaining capacities: the least remaining capacity of at least ``s`` that is open."""

    def __init__(self, capacity: int):
        self.n = 1 << (capacity + 1).bit_length()
        self.open = bytearray(2 * self.n)

    def set(self, r: int, is_open: bool) -> None:
        i = r + self.n
        self.open[i] = is_open
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def at_least(self, s: int) -> int | None:
        i = s + self.n
        if self.open[i]:
            return s
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.n
            i >>= 1
        return None


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Placements of best-fit decreasing, one row each: size, first rank, items, first container, items a container, fill before."""
    tree = TightestFit(capacity)
    runs: dict[int, list[tuple[int, int]]] = {}
    out: list[tuple[int, int, int, int, int, int]] = []
    bins = 0

    def put(r: int, first: int, n: int) -> None:
        if n and r:
            runs.setdefault(r, []).append((first, n))
            tree.set(r, True)

    for s in sorted(histogram, reverse=True):
        left, rank = histogram[s], 0
        while left:
            r = tree.at_least(s)
            if r is None:
                r, first, n = capacity, bins, -(-left // (capacity // s))
                bins += n
            else:
                first, n = runs[r].pop()
                if not runs[r]:
                    tree.set(r, False)
            k = r // s
            full = min(n, left // k)
            if full:
                out.append((s, rank, full * k, first, k, capacity - r))
                put(r - k * s, first, full)
                left, rank = left - full * k, rank + full * k
            rest = 0
            if left and full < n:
                rest = left
                out.append((s, rank, rest, first + full, k, capacity - r))
                put(r - rest * s, first + full, 1)
                left, rank = 0, rank + rest
            put(r, first + full + bool(rest), n - full - bool(rest))
    return np.array(out, np.int64).reshape(-1, 6)


def pack(df: DataFrame, id_col: str, text_col: str, capacity: int = 2048, path: str | None = None) -> DataFrame:
    """Rows (container, ``id_col``, token_from, token_to, fill_from): the tokens of each text and where they lie."""
    spark = df.sparkSession
    texts = df.where(F.length(text_col) > 0)
    sizes = checkpointed(tokenize.token_counts(texts, id_col, text_col, path).toDF("id", "n").where("n > 0"))
    salts = parallelism(spark)
    last = F.expr(f"(n - 1) DIV {int(capacity)}")
    items = (
        sizes.select("id", "n", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
        .select("id", (F.col("piece") * capacity).alias("token_from"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("piece") * capacity).alias("size"))
        .withColumn("salt", F.pmod(F.xxhash64("id", "token_from"), F.lit(salts)).cast("int"))
    )
    # How many items each size has, by salt: at most capacity x salts rows.
    counts = items.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("items"))
    counts = checkpointed(counts)
    before = counts.select("size", "salt", (F.sum("items").over(Window.partitionBy("size").orderBy("salt")) - F.col("items")).alias("before"))
    histogram = {r["size"]: r["items"] for r in counts.groupBy("size").agg(F.sum("items").alias("items")).collect()}  # at most capacity rows
    shared = spark.sparkContext.broadcast(plan(histogram, capacity))  # placements are bounded by the capacity, not by the data
    ranked = items.withColumn("r", F.row_number().over(Window.partitionBy("size", "salt").orderBy("id", "token_from")) - 1)
    ranked = ranked.join(before, ["size", "salt"]).select("id", "token_from", "size", (F.col("before") + F.col("r")).alias("rank"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shared.value
        p = p[np.lexsort((p[:, 1], p[:, 0]))]
        stride = int((p[:, 1] + p[:, 2]).max(initial=0)) + 1
        keys = p[:, 0] * stride + p[:, 1]
        for b in batches:
            ids, start, size, rank = b.columns
            start, size, rank = (x.to_numpy(zero_copy_only=False) for x in (start, size, rank))
            q = p[np.searchsorted(keys, size * stride + rank, side="right") - 1]
            n = rank - q[:, 1]
            yield pa.RecordBatch.from_arrays(
                [pa.array(q[:, 3] + n // q[:, 4]), ids, pa.array(start), pa.array(start + size), pa.array(q[:, 5] + n % q[:, 4] * size)],
                ["container", "id", "token_from", "token_to", "fill_from"],
            )

    kind = ranked.schema["id"].dataType.simpleString()
    return ranked.mapInArrow(place, f"container long, id {kind}, token_from long, token_to long, fill_from long").withColumnRenamed("id", id_col)
