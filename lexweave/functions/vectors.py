"""Vector functions: similarity to a query, checks, pooling and the default embedder."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIM = 64


class EmbeddingProvider(Protocol):
    """Anything that turns texts into vectors of one length; loaded once in each worker."""

    def __call__(self, texts: list[str]) -> np.ndarray: ...


def cosine_to(vec: Column, query: list[float]) -> Column:
    """Cosine of each vector and ``query``; null for vectors of another length, zero or not finite."""
    q = np.asarray(query, np.float64)
    norm = float(np.sqrt((q * q).sum()))
    dim = len(q)

    @F.arrow_udf(T.DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            out = np.full(len(b), np.nan)
            rows = np.flatnonzero(np.asarray(b.value_lengths().fill_null(-1)) == dim)
            if len(rows) and norm:
                m = b.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                with np.errstate(invalid="ignore", over="ignore", divide="ignore"):
                    out[rows] = (m * q).sum(1) / np.sqrt((m * m).sum(1)) / norm
            yield pa.array(out, mask=~np.isfinite(out))

    return score(vec)


def index_score(cosine: Column) -> Column:
    """The score of a cosine vector index: (1 + cos) / 2."""
    return (1 + cosine) / 2


def vector_status(vec: Column, dim: int = DIM) -> Column:
    """ok, missing, wrong_length, not_finite or zero."""
    d = F.transform(vec, lambda x: x.cast("double"))
    finite = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        F.when(vec.isNull(), "missing").when(F.size(vec) != dim, "wrong_length").when(~F.coalesce(finite, F.lit(False)), "not_finite")
        .when(F.forall(d, lambda x: x == 0), "zero").otherwise("ok")
    )


def mean_vectors(df: DataFrame, key: str, vec: str) -> DataFrame:
    """Mean of each dimension by group: (key, dim, mean). Partial sums are combined before the exchange."""
    return df.select(key, F.posexplode(vec).alias("dim", "v")).groupBy(key, "dim").agg(F.avg(F.col("v").cast("double")).alias("mean"))


def masked_mean(df: DataFrame, keys: list[str], value: str, mask: str) -> DataFrame:
    """Masked mean pooling of a long table of token values: sum(v * m) / max(sum(m), 1e-9)."""
    v, m = F.col(value).cast("double"), F.col(mask).cast("double")
    return df.groupBy(*keys).agg((F.sum(v * m) / F.greatest(F.sum(m), F.lit(1e-9))).alias("pooled"))


def argmax(logits: Column) -> Column:
    """Position of the largest entry, from 0; the first of equal ones."""
    return F.array_position(logits, F.array_max(logits)) - 1


def hash_embedding(texts: list[str], dim: int = DIM) -> np.ndarray:
    """Deterministic embedder without a model: signed hashing of words, unit length; zero for texts without words."""
    out = np.zeros((len(texts), dim), np.float32)
    for i, t in enumerate(texts):
        for w in (t or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
            out[i, h % dim] += 1.0 if h >> 63 else -1.0
        n = math.sqrt(float((out[i] ** 2).sum()))
        if n:
            out[i] /= n
    return out


#: Words of a text an embedding model is given; what is beyond is cut off, as its window would.
MOST_WORDS = 512


def embed(text: Column, provider: Callable[[], EmbeddingProvider] | None = None, dim: int = DIM, most: int | None = MOST_WORDS, zero: bool = True) -> Column:
    """Embedding of a text column. ``provider`` is called once in each worker and given at most ``most`` words of a text.

    A failing batch gives zero vectors of ``dim``, which are no candidates of a search and are counted by
    ``quality.vector_report``; with ``zero`` false it gives nulls.
    """
    none = [0.0] * dim if zero else None
    beyond = re.compile(rf"(\s*(?:\S+\s+){{{most - 1}}}\S+)\s.*", re.S) if most else None
    cut = lambda x: m.group(1) if beyond and (m := beyond.fullmatch(x)) else x

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = provider() if provider else hash_embedding
        for s in batches:
            try:
                v = model([(cut(x) if provider else x) if isinstance(x, str) else "" for x in s])
                yield pd.Series([list(map(float, r)) for r in v])
            except Exception:  # noqa: BLE001 - a failing provider must not end the job
                yield pd.Series([none] * len(s))

    return run(text)
