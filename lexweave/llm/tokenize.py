"""Encoding of texts with a byte-level BPE vocabulary (problem 8).

Pre-tokenisation uses no regex. Each code point has a class (letter, number, white space, other) held in one
array over all code points. The splitter is a finite automaton whose transition functions compose associatively;
as every function is constant after at most three code points (only an apostrophe's contraction and the last
blank before a word look further than one neighbour), the composed scan reaches its fixed point after three
shifts, so the boundaries of a whole block of documents are a few comparisons of shifted arrays. The slices
between boundaries are looked up in a cache of merged pairs; a miss is merged by rank with a heap.

Defined results: a null and an empty text give an empty list; a null id is kept; repeated rows are encoded
each; an empty table gives an empty table; other columns are ignored, whatever their names. Texts of any length
are encoded whole: a text is worked through in blocks cut only where a boundary is certain.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 4
#: Code points a block has at most, unless one run without white space is longer.
BLOCK = 400_000
#: Merged slices kept by a worker. A full cache is emptied; results do not depend on it.
CACHE = 300_000
#: The Unicode property White_Space (fixed values).
WHITE = [*range(0x9, 0xE), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

_classes: np.ndarray | None = None
_encoders: dict[str, "Encoder"] = {}


def default_vocabulary() -> str:
    """Path of the rank file of byte_bpe_50k."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def classes() -> np.ndarray:
    global _classes
    if _classes is None:
        cat = unicodedata.category
        by = {"L": LETTER, "N": NUMBER}
        _classes = np.fromiter((by.get(cat(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)), np.uint8, sys.maxunicode + 1)
        _classes[WHITE] = SPACE
    return _classes


def boundaries(code: np.ndarray, first: np.ndarray) -> np.ndarray:
    """True where a slice begins. ``first`` marks the first code point of each document of the block."""
    n = len(code)
    c = classes()[code]
    at = np.empty(n, bool)
    if not n:
        return at
    at[0] = True
    np.not_equal(c[1:], c[:-1], out=at[1:])
    at |= first
    # One shift: the last white-space code point before something else begins a slice of its own,
    # and a blank there takes the run that follows into its slice.
    run_ends = np.flatnonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & ~first[1:])
    at[run_ends] = True
    at[run_ends[code[run_ends] == 32] + 1] = False
    # Up to three shifts: contractions. They begin at an apostrophe that itself begins a slice.
    p = np.flatnonzero((code == 39) & at)
    if len(p):
        pad = np.concatenate([code, np.zeros(2, code.dtype)])
        new = np.concatenate([first, np.ones(2, bool)])
        a, b = pad[p + 1], pad[p + 2]
        a[new[p + 1]] = 0
        b[new[p + 1] | new[p + 2]] = 0
        one = np.isin(a, [ord(x) for x in "sdmt"])
        two = ((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101))
        at[(p + 1)[one | two]] = False
        for hit, k in ((one, 2), (two, 3)):
            q = (p + k)[hit]
            at[q[q < n]] = True
    return at


class Encoder:
    """Merges of one rank file, with the cache of slices."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.cache: dict[str, bytes] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Ids of one slice: the pair of least rank is merged first, the leftmost of equal ones."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        n = len(piece)
        nxt, prv, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = nxt[i] if alive[i] else n
            if not alive[i] or j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i], nxt[i] = end[j], nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (r := ranks.get(piece[i : end[nxt[i]]])) is not None:
                    heapq.heappush(heap, (r, i, end[nxt[i]]))
            if (h := prv[i]) >= 0 and (r := ranks.get(piece[h : end[i]])) is not None:
                heapq.heappush(heap, (r, h, end[i]))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = nxt[i]
        return out

    def packed(self, pieces: list[str]) -> list[bytes]:
        """The ids of each slice as little-endian 32-bit bytes."""
        cache = self.cache
        try:
            return [cache[p] for p in pieces]
        except KeyError:
            pass
        if len(cache) > CACHE:
            cache.clear()
        out = []
        for p in pieces:
            v = cache.get(p)
            if v is None:
                v = np.array(self.merged(p.encode()), "<i4").tobytes()
                if len(p) <= 64:
                    cache[p] = v
            out.append(v)
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _parts(text: str) -> Iterator[str]:
    """The text in parts of about BLOCK code points, cut before a white-space run, where a slice always begins."""
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and not (ord(text[cut]) in _WHITE and ord(text[cut - 1]) not in _WHITE):
            cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text):
        yield text[at:]


_WHITE = frozenset(WHITE)


def _blocks(texts: list[str | None]) -> Iterator[list[tuple[int, str]]]:
    block, size = [], 0
    for k, t in enumerate(texts):
        for part in _parts(t) if t else ():
            if size + len(part) > BLOCK and block:
                yield block
                block, size = [], 0
            block.append((k, part))
            size += len(part)
    if block:
        yield block


def encode_batch(texts: list[str | None], path: str, offsets: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """(ids of all texts, number of ids of each text, first code point of each id's slice or None).

    The offsets count from the start of their text; with them, slices can be cut from the source and ids decoded.
    """
    enc = encoder(path)
    counts = np.zeros(len(texts), np.int64)
    done = np.zeros(len(texts), np.int64)
    bufs, offs = [], []
    for block in _blocks(texts):
        text = "".join(t for _, t in block)
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        begin = np.zeros(len(block), np.int64)
        np.cumsum([len(t) for _, t in block[:-1]], out=begin[1:])
        first = np.zeros(len(code), bool)
        first[begin] = True
        cut = np.flatnonzero(boundaries(code, first))
        ends = np.append(cut[1:], len(code))
        got = enc.packed([text[a:b] for a, b in zip(cut.tolist(), ends.tolist())])
        piece0 = np.append(np.searchsorted(cut, begin), len(cut)).tolist()
        per = np.fromiter(map(len, got), np.int64, len(got)) // 4 if offsets else None
        for x, (k, t) in enumerate(block):
            buf = b"".join(got[piece0[x] : piece0[x + 1]])
            bufs.append(buf)
            counts[k] += len(buf) // 4
            if offsets:
                s = slice(piece0[x], piece0[x + 1])
                offs.append(np.repeat(cut[s] - begin[x] + done[k], per[s]))
                done[k] += len(t)
    ids = np.frombuffer(b"".join(bufs), "<i4")
    return ids, counts, (np.concatenate(offs) if offs else np.zeros(0, np.int64)) if offsets else None


def decode(ids: list[int], path: str) -> str:
    """The text of ids, the exact inverse of encoding a whole text."""
    enc = encoder(path)
    if not hasattr(enc, "byte_of"):
        enc.byte_of = {v: k for k, v in enc.ranks.items()}
    return b"".join(enc.byte_of[i] for i in ids).decode("utf-8")


def encode(df: DataFrame, id_col: str, text_col: str, path: str | None = None, ids_col: str = "ids") -> DataFrame:
    """One row for each row of ``df``: its id and the list of token ids of its text."""
    path = path or default_vocabulary()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, counts, _ = encode_batch(b.column(1).to_pylist(), path)
            off = np.zeros(len(counts) + 1, np.int32)
            np.cumsum(counts, out=off[1:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(off), pa.array(ids))], ["id", "ids"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return src.mapInArrow(run, schema).toDF(id_col, ids_col)


def token_counts(df: DataFrame, id_col: str, text_col: str, path: str | None = None, count_col: str = "n_tokens") -> DataFrame:
    """One row for each row of ``df``: its id and the number of tokens of its text (0 for null and empty)."""
    path = path or default_vocabulary()
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, counts, _ = encode_batch(b.column(1).to_pylist(), path)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts)], ["id", "n"])

    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), T.StructField("n", T.LongType())])
    return src.mapInArrow(run, schema).toDF(id_col, count_col)
