"""Near-duplicate records with small edits (problem 7).

Every text is the set of its word shingles. Its signature has SEGMENTS x WIDTH min-hash symbols; two texts whose
signatures differ in fewer than 2 x SEGMENTS symbols must have a segment that differs in at most one, so only the
one-wildcard variants of the segments (each segment with each of its symbols left out) are indexed: SEGMENTS x
WIDTH equality keys a text. The symbols are whole min-hashes rather than single bits, since at a similarity of 0.6
half of all bits would differ; at 0.6 a pair is met with probability 0.993, at 0.65 with 0.9994, at 0.7 above
0.9999 (with the default 12 x 5 symbols). Met pairs are first held to a 54-bit sketch and the set sizes carried in
the index row, then verified exactly on the shingle sets.

Copies of a text are one class from the start: the index holds a class once for each task, so a text that is a
third of all rows costs no more than others. Keys are exchanged once, sorted and scanned as a stream; a run of more
than RUN different classes is not paired but handed to an exact prefix-filter join over the classes concerned.

Defined results: texts of fewer than ``least_words`` words (null, empty and blank ones too) have no links; copies
are linked with similarity 1; a pair comes out once, the smaller id first; repeated rows of one id are one record;
extra columns are ignored; texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import checkpointed, parallelism, spread

SEGMENTS, WIDTH, SKETCH = 12, 5, 54
#: Sketch bits that must agree: at a similarity of 0.6, 43 of 54 are expected, with a deviation of 2.9.
AGREE = 32
#: Different classes a key may pair directly; beyond, the exact join takes over.
RUN = 2000
#: One text in so many tells which keys are frequent.
SAMPLED = 64
#: Bits that tell most classes without a candidate from the rest, before their sets are exchanged. A full bitmap
#: only stops saving work.
BITS = 1 << 23
#: Classes a task remembers, to index each once.
SEEN = 1_000_000

_WORD = re.compile(r"[^\W_]+")
_WORD_MARKS = regex.compile(r"[\p{L}\p{M}\p{N}]+")
_MARKS = re.compile("[\u0300-\u036f\u0483-\u0489\u0591-\u1fff\u20d0-\u20ff\u302a-\u302f\u3099\u309a\ufe00-\ufe2f\U00010000-\U0010ffff]")
_rng = np.random.default_rng(20240607)
_MUL = _rng.integers(0, 2**64, SEGMENTS * WIDTH + SKETCH, np.uint64, endpoint=False) | np.uint64(1)
_ADD = _rng.integers(0, 2**64, SEGMENTS * WIDTH + SKETCH, np.uint64, endpoint=False)
_MIX = _rng.integers(0, 2**64, 8, np.uint64, endpoint=False) | np.uint64(1)
_word_hash: dict[str, int] = {}


def words(text: str | None) -> list[str]:
    """Maximal runs of letters, combining marks and digits of the lower-cased text."""
    if not text:
        return []
    low = text.lower()
    return (_WORD_MARKS if _MARKS.search(low) else _WORD).findall(low)


def _hashes(ws: list[str]) -> np.ndarray:
    get = _word_hash.get
    out = list(map(get, ws))
    if None in out:
        if len(_word_hash) > 500_000:
            _word_hash.clear()
        for k, h in enumerate(out):
            if h is None:
                out[k] = _word_hash[ws[k]] = xxhash.xxh3_64_intdigest(ws[k])
    return np.array(out, np.uint64)


def _scramble(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * _MIX[6]
    return h ^ (h >> np.uint64(29))


def shingles(ws: list[str], k: int) -> np.ndarray:
    """The set of k consecutive words as sorted 64-bit hashes."""
    h = _hashes(ws)
    n = len(h) - k + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    s = np.zeros(n, np.uint64)
    for j in range(k):
        s = s * _MIX[7] + h[j : j + n]
    return np.unique(_scramble(s))


def class_of(ws: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(ws)) - 2**63


def _bitmap(classes: DataFrame) -> np.ndarray:
    """A bitmap of fixed size in which the bits of the classes are set; at most BITS / 64 rows reach the driver."""
    bit = F.pmod("cls", F.lit(BITS))
    rows = classes.groupBy(F.floor(bit / 64).cast("int").alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(cls, {BITS}) % 64 AS INT))")).alias("v"))
    out = np.zeros(BITS // 64, np.int64)
    got = rows.toArrow()
    out[got["w"].to_numpy()] = got["v"].to_numpy()
    return out.view(np.uint64)


def _class_sets(batch: pa.RecordBatch, column: int, k: int, least: int, seen: set[int] | None, bits: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    for t in batch.column(column).to_pylist():
        ws = words(t)
        if len(ws) < max(least, k):
            continue
        c = class_of(ws)
        if bits is not None and not int(bits[c % BITS // 64]) >> (c % 64) & 1:
            continue
        if seen is not None:
            if c in seen:
                continue
            if len(seen) < SEEN:
                seen.add(c)
        yield c, shingles(ws, k)


def signatures(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(docs x symbols min-hashes, sketch with the size in its low 10 bits) of non-empty sets."""
    flat = np.concatenate(sets)
    at = np.zeros(len(sets), np.int64)
    np.cumsum([len(s) for s in sets[:-1]], out=at[1:])
    mins = np.empty((len(sets), SEGMENTS * WIDTH), np.uint64)
    sketch = np.zeros(len(sets), np.uint64)
    for i in range(len(_MUL)):
        h = flat * _MUL[i] + _ADD[i]
        h ^= h >> np.uint64(32)
        m = np.minimum.reduceat(h, at)
        if i < SEGMENTS * WIDTH:
            mins[:, i] = m
        else:
            sketch = (sketch << np.uint64(1)) | (_scramble(m) & np.uint64(1))
    size = np.minimum(np.round(64 * np.log2([len(s) for s in sets])), 1023).astype(np.uint64)
    return mins, (sketch << np.uint64(10)) | size


def variant_keys(mins: np.ndarray) -> np.ndarray:
    """docs x (SEGMENTS x WIDTH) keys: every segment with one symbol left out."""
    out = np.empty_like(mins)
    for s in range(SEGMENTS):
        seg = mins[:, s * WIDTH : (s + 1) * WIDTH]
        for w in range(WIDTH):
            key = np.full(len(mins), s * WIDTH + w + 1, np.uint64) * _MIX[5]
            for j in range(WIDTH):
                if j != w:
                    key = (key ^ _scramble(seg[:, j] + _MIX[j])) * _MIX[4]
            out[:, s * WIDTH + w] = _scramble(key)
    return out


def _run_pairs(key: np.ndarray, cls: np.ndarray, sketch: np.ndarray, ratio: float) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Pairs of different classes with one key that pass sketch and size; runs above RUN give (class, None)."""
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
    key, cls, sketch = key[new], cls[new], sketch[new]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))
    left, right = [], []
    for n in np.unique(sizes[(sizes > 1) & (sizes <= RUN)]):
        i, j = np.triu_indices(int(n), 1)
        at = starts[sizes == n]
        step = max(1, 2_000_000 // len(i))
        for k in range(0, len(at), step):
            a = (at[k : k + step, None] + i).ravel()
            b = (at[k : k + step, None] + j).ravel()
            x, y = sketch[a], sketch[b]
            agree = SKETCH - np.bitwise_count((x ^ y) >> np.uint64(10))
            low = np.uint64(1023)
            near = np.abs((x & low).astype(np.int64) - (y & low).astype(np.int64)) <= -64 * np.log2(ratio) + 1
            # the coded size ends at about 65,000 shingles; beyond, it decides nothing
            ok = (agree >= AGREE) & (near | ((x & low) == low) | ((y & low) == low))
            left.append(cls[a[ok]])
            right.append(cls[b[ok]])
    return left, right


_KEYED = "key long, cls long, sketch long"


def _index(k: int, least_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What writes the keys of texts: rows (key, cls, sketch)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                got = list(_class_sets(batch.slice(at, 2000), 0, k, least_words, seen))
                if not got:
                    continue
                mins, sketch = signatures([s for _, s in got])
                keys = variant_keys(mins)
                n = keys.shape[1]
                cls = np.array([c for c, _ in got], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(cls, n)), pa.array(np.repeat(sketch, n).view(np.int64))], ["key", "cls", "sketch"])

    return index


def frequent_keys(src: DataFrame, k: int = 3, least_words: int = 10) -> list[int]:
    """Keys of src(text) so frequent, by one text in ``SAMPLED``, that one would fill half a task: at most two for each task."""
    some = src.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLED)) == 0)
    counted = checkpointed(some.mapInArrow(_index(k, least_words), _KEYED).select("key", "cls").distinct().groupBy("key").count())
    total = counted.agg(F.sum("count").alias("n")).first()["n"] or 0
    return [r["key"] for r in counted.where(F.col("count") > max(1, RUN / SAMPLED, total / (2 * parallelism(src.sparkSession)))).select("key").collect()]


def links(df: DataFrame, id_col: str, text_col: str, k: int = 3, threshold: float = 0.6, least_words: int = 10) -> DataFrame:
    """Rows (class_a, class_b, similarity): linked classes of different texts, class_a < class_b."""
    src = df.select(F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: tuple[np.ndarray, ...] = (np.zeros(0, np.int64),) * 3
        hot = None  # key of a run too long to be paired

        def out(left: list[np.ndarray], right: list[np.ndarray | None]) -> pa.RecordBatch:
            a = np.concatenate(left) if left else np.zeros(0, np.int64)
            if right and right[0] is None:
                return pa.RecordBatch.from_arrays([pa.array(a), pa.nulls(len(a), pa.int64())], ["a", "b"])
            b = np.concatenate(right) if right else np.zeros(0, np.int64)
            pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["a", "b"])

        for batch in batches:
            key, cls, sketch = (np.concatenate([r, c.to_numpy()]) for r, c in zip(rest, batch.columns))
            if not len(key):
                continue
            last = key[-1]
            cut = int(np.searchsorted(key, last, side="left"))
            if hot is not None:
                end = int(np.searchsorted(key, hot, side="right"))
                if end:
                    yield out([np.unique(cls[:end])], [None])
                key, cls, sketch = key[end:], cls[end:], sketch[end:]
                cut = max(0, cut - end)
                if len(key):
                    hot = None
                else:
                    rest = (key, cls, sketch)
                    continue
            yield from done(key[:cut], cls[:cut], sketch[:cut], out)
            tail = np.unique(cls[cut:])
            if len(tail) > RUN:
                yield out([tail], [None])
                hot, rest = last, (np.zeros(0, np.int64),) * 3
            else:
                keep = cut + np.unique(cls[cut:], return_index=True)[1]
                rest = (key[keep], cls[keep], sketch[keep])
        yield from done(*rest, out)

    def done(key, cls, sketch, out) -> Iterator[pa.RecordBatch]:
        if not len(key):
            return
        left, right = _run_pairs(key, cls, sketch.view(np.uint64), threshold)
        if left:
            yield out(left, right)
        order = np.lexsort((cls, key))
        k_, c_ = key[order], cls[order]
        first = np.ones(len(k_), bool)
        first[1:] = (k_[1:] != k_[:-1]) | (c_[1:] != c_[:-1])
        k_, c_ = k_[first], c_[first]
        _, inv, n = np.unique(k_, return_inverse=True, return_counts=True)
        if (big := n[inv] > RUN).any():
            yield out([np.unique(c_[big])], [None])

    keyed = spread(src).mapInArrow(_index(k, least_words), _KEYED)
    # classes of frequent keys go to the exact join at once and are not sent to one task
    frequent = frequent_keys(src, k, least_words)
    apart = None
    if frequent:
        hot_keys = F.broadcast(df.sparkSession.createDataFrame([(x,) for x in frequent], "key long"))  # at most 2 x tasks keys
        apart = keyed.join(hot_keys, "key", "left_semi").select(F.col("cls").alias("a"), F.lit(None).cast("long").alias("b"))
        keyed = keyed.join(hot_keys, "key", "left_anti")
    met = keyed.repartition("key").sortWithinPartitions("key", "cls").mapInArrow(meet, "a long, b long")
    met = checkpointed((met if apart is None else met.unionByName(apart)).distinct())
    pairs = met.where("b IS NOT NULL")
    wanted = met.select(F.explode(F.array("a", "b")).alias("cls")).where("cls IS NOT NULL").distinct()

    needed = df.sparkSession.sparkContext.broadcast(_bitmap(wanted))  # BITS / 8 bytes, whatever the data

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        bits = needed.value
        for batch in batches:
            got = list(_class_sets(batch, 0, k, least_words, seen, bits))
            cls = pa.array(np.array([c for c, _ in got], np.int64))
            off = np.zeros(len(got) + 1, np.int32)
            np.cumsum([len(s) for _, s in got], out=off[1:])
            flat = np.concatenate([s for _, s in got]) if got else np.zeros(0, np.uint64)
            yield pa.RecordBatch.from_arrays([cls, pa.ListArray.from_arrays(pa.array(off), pa.array(flat.view(np.int64)))], ["cls", "shingles"])

    sets = spread(src).mapInArrow(sets_of, T.StructType([T.StructField("cls", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))]))
    sets = sets.join(wanted, "cls", "left_semi").dropDuplicates(["cls"])
    if not met.where("b IS NULL").isEmpty():
        sets = checkpointed(sets)
        hot = met.where("b IS NULL").select(F.col("a").alias("cls")).distinct()
        pairs = pairs.unionByName(_prefix_pairs(sets.join(hot, "cls", "left_semi"), threshold)).distinct()
    a = sets.select(F.col("cls").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("cls").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(a, "a").join(b, "b").withColumn("common", common)
        .select(F.col("a").alias("class_a"), F.col("b").alias("class_b"), (F.col("common") / (F.size("sa") + F.size("sb") - F.col("common"))).alias("similarity"))
        .where(F.col("similarity") >= threshold)
    )


def _prefix_pairs(sets: DataFrame, threshold: float) -> DataFrame:
    """All pairs of classes that may reach the threshold: they share one of the rarest shingles of either set."""
    each = sets.select("cls", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    rare = each.join(each.groupBy("s").agg(F.count(F.lit(1)).alias("df")), "s")
    listed = rare.groupBy("cls", "n").agg(F.sort_array(F.collect_list(F.struct("df", "s"))).alias("l"))
    keep = F.slice("l", F.lit(1), (F.col("n") - F.ceil(F.col("n") * threshold) + 1).cast("int"))
    prefix = listed.select("cls", "n", F.explode(keep).alias("x")).where("x.df > 1").select("cls", "n", F.col("x.s").alias("s"))
    other = prefix.select(F.col("cls").alias("b"), F.col("n").alias("m"), "s")
    return prefix.join(other, "s").where((F.col("cls") < F.col("b")) & (F.least("n", "m") >= threshold * F.greatest("n", "m"))).select(F.col("cls").alias("a"), "b").distinct()


def members(df: DataFrame, id_col: str, text_col: str, k: int = 3, least_words: int = 10) -> DataFrame:
    """Rows (``id_col``, cls) of the records long enough to be compared."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, cls = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                ws = words(t)
                if len(ws) >= max(least_words, k):
                    keep.append(i)
                    cls.append(class_of(ws))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int32())), pa.array(cls, pa.int64())], ["id", "cls"])

    kind = src.schema["id"].dataType.simpleString()
    return spread(src).mapInArrow(run, f"id {kind}, cls long").distinct().withColumnRenamed("id", id_col)


def near_pairs(df: DataFrame, id_col: str, text_col: str, k: int = 3, threshold: float = 0.6, least_words: int = 10) -> DataFrame:
    """Rows (id_a, id_b): all pairs of records, copies included, that reach the threshold. Its rows are its size."""
    who = checkpointed(members(df, id_col, text_col, k, least_words).withColumnRenamed(id_col, "id"))
    other = who.select(F.col("id").alias("id_b"), F.col("cls").alias("cls_b"))
    found = links(df, id_col, text_col, k, threshold, least_words)
    apart = found.join(who, found.class_a == who.cls).join(other, F.col("class_b") == F.col("cls_b")).select("id", "id_b")
    several = who.groupBy("cls").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = who.join(several, "cls", "left_semi").join(other, (F.col("cls") == F.col("cls_b")) & (F.col("id") < F.col("id_b"))).select("id", "id_b")
    return apart.unionByName(copies).select(F.least("id", "id_b").alias("id_a"), F.greatest("id", "id_b").alias("id_b"))


def near_classes(df: DataFrame, id_col: str, text_col: str, k: int = 3, threshold: float = 0.6, least_words: int = 10) -> DataFrame:
    """One row for each record: ``id_col``, class (its least id; null if too short), copies, linked classes. Never larger than the input."""
    who = members(df, id_col, text_col, k, least_words)
    found = links(df, id_col, text_col, k, threshold, least_words)
    degree = found.select(F.explode(F.array("class_a", "class_b")).alias("cls")).groupBy("cls").agg(F.count(F.lit(1)).alias("links"))
    size = who.groupBy("cls").agg(F.count(F.lit(1)).alias("copies"), F.min(id_col).alias("class_id")).join(degree, "cls", "left")
    told = who.join(size, "cls").select(F.col(id_col).alias("id"), "class_id", "copies", "links")
    return (
        df.select(F.col(id_col).alias("id")).distinct().join(told, "id", "left")
        .select(F.col("id").alias(id_col), "class_id", F.coalesce("copies", F.lit(1)).alias("copies"), F.coalesce("links", F.lit(0)).alias("links"))
    )
