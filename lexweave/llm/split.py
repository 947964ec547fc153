"""Splitting oversized items at natural boundaries (problem 5).

A text is read as a tree: sections under headings, paragraphs, lines and list items, sentences, clauses, words.
The tree is packed bottom-up: neighbouring subtrees of one parent are merged while they fit, and only a node that
is itself too large is descended into; a single word above the limit is cut between characters. Every piece after
the first repeats up to ``overlap`` characters of the end of the one before, beginning at a word.

Defined results: outer white space belongs to no piece; null, empty and blank texts have no piece; a text within
the limit is one piece; pieces are numbered from 0 in order, and their new parts together cover every character
that is not white space exactly once; repeated rows each give their pieces; extra columns are ignored.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import spread

from lexweave.llm.sentences import _HEAD, spans

_HEADING_LINE = re.compile(r"(?m)^[ \t]*(?:#{1,6}[ \t]+\S.*|" + _HEAD.pattern + r"[^\n]{0,80}|[^a-zß-ÿ\n.;:,]{4,60})[ \t]*$")
_ITEM = re.compile(r"(?m)^[ \t]*(?:\(?[0-9a-zA-Z]{1,4}(?:-(?:bis|ter|quater))?[.)]|[-–•*·])[ \t]")
_BLANK_LINE = re.compile(r"\n[ \t]*\n\s*|\x0c\s*")
_CLAUSE = re.compile(r"(?<=[;:,、，；])\s*(?=\S)")
_WORD = re.compile(r"\s+")
_OUTER = " \t\n\r\x0b\x0c\x85\u00a0\u2028\u2029"

Span = tuple[int, int]


def _at(cuts: list[int], a: int, b: int) -> list[Span]:
    points = [a, *[c for c in cuts if a < c < b], b]
    return list(zip(points, points[1:]))


class _Sentences:
    """The sentences of a text, of which those within the limit are not to be cut."""

    def __init__(self, text: str, limit: int):
        self.limit = limit
        self.starts, self.ends = map(list, zip(*spans(text))) if text.strip() else ([], [])

    def between(self, cuts: list[int]) -> list[int]:
        """The cuts that fall in no sentence within the limit."""
        out = []
        for c in cuts:
            k = bisect_left(self.starts, c) - 1
            if k < 0 or c >= self.ends[k] or self.ends[k] - self.starts[k] > self.limit:
                out.append(c)
        return out


def _children(text: str, a: int, b: int, level: int, sentences: _Sentences) -> list[Span]:
    """The nodes of the next level inside [a, b), without gaps."""
    if level == 0:
        return _at(sentences.between([m.start() for m in _HEADING_LINE.finditer(text, a, b)]), a, b)
    if level == 1:
        return _at(sentences.between([m.end() for m in _BLANK_LINE.finditer(text, a, b)]), a, b)
    if level == 2:
        return _at(sentences.between([m.start() for m in _ITEM.finditer(text, a, b)]), a, b)
    if level == 3:
        return _at(sentences.starts[bisect_left(sentences.starts, a) : bisect_left(sentences.starts, b)], a, b)
    if level == 4:
        return _at([m.start() for m in _CLAUSE.finditer(text, a, b)], a, b)
    return _at([m.end() for m in _WORD.finditer(text, a, b)], a, b)


def _length(text: str, a: int, b: int) -> int:
    """Characters of [a, b) without outer white space."""
    while b > a and text[b - 1].isspace():
        b -= 1
    while a < b and text[a].isspace():
        a += 1
    return b - a


def _packed(text: str, a: int, b: int, limit: int, sentences: _Sentences, level: int = 0) -> list[Span]:
    if b - a <= limit or _length(text, a, b) <= limit:
        return [(a, b)]
    while level < 6:
        kids = _children(text, a, b, level, sentences)
        level += 1
        if len(kids) > 1:
            break
    else:
        return [(x, min(x + limit, b)) for x in range(a, b, limit)]
    merged: list[Span] = []
    for x, y in kids:
        for p, q in _packed(text, x, y, limit, sentences, level):
            if merged and (q - merged[-1][0] <= limit or _length(text, merged[-1][0], q) <= limit):
                merged[-1] = (merged[-1][0], q)
            else:
                merged.append((p, q))
    return merged


def pieces(text: str | None, limit: int = 1200, overlap: int = 120) -> list[tuple[int, int, int]]:
    """(start, start of the new part, end) of each piece of ``text``."""
    if text is None or not text.strip():
        return []
    b = len(text.rstrip(_OUTER))
    a = len(text) - len(text.lstrip(_OUTER))
    if a >= b:
        return []
    if b - a <= limit:
        return [(a, a, b)]
    out: list[tuple[int, int, int]] = []
    for x, y in _packed(text, a, b, limit - overlap, _Sentences(text, limit - overlap)):
        while y > x and text[y - 1].isspace():
            y -= 1
        while x < y and text[x].isspace():
            x += 1
        if x == y:
            continue
        if not out:
            out.append((x, x, y))
            continue
        end = out[-1][2]
        start = max(end - overlap, out[-1][0], y - limit)
        if start > 0 and not text[start - 1].isspace():
            # begin at a word, unless the script has no spaces
            m = _WORD.search(text, start, end)
            if m and m.end() < end:
                start = m.end()
        while start < end and text[start].isspace():
            start += 1
        out.append((start if start < end else x, x, y))
    return out


def split_pieces(df: DataFrame, id_col: str, text_col: str, limit: int = 1200, overlap: int = 120) -> DataFrame:
    """Rows (``id_col``, piece, pieces, start_pos, new_pos, end_pos, piece_text), one for each piece."""
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[int] = []
            cols: tuple[list, ...] = ([], [], [], [], [], [])
            size = 0

            def made() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows, pa.int32())), *(pa.array(c, pa.int32()) for c in cols[:5]), pa.array(cols[5], pa.string())],
                    ["id", "piece", "pieces", "start_pos", "new_pos", "end_pos", "piece_text"],
                )

            for k, t in enumerate(b.column(1).to_pylist()):
                cut = pieces(t, limit, overlap)
                for n, (s, new, e) in enumerate(cut):
                    rows.append(k)
                    for c, v in zip(cols, (n, len(cut), s, new, e, t[s:e])):
                        c.append(v)
                    size += e - s
                if size > 8_000_000:
                    yield made()
                    rows, cols, size = [], ([], [], [], [], [], []), 0
            yield made()

    ints = [T.StructField(c, T.IntegerType()) for c in ("piece", "pieces", "start_pos", "new_pos", "end_pos")]
    schema = T.StructType([T.StructField("id", src.schema["id"].dataType), *ints, T.StructField("piece_text", T.StringType())])
    return spread(src).mapInArrow(run, schema).withColumnRenamed("id", id_col)
