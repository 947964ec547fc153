"""Text functions as column expressions: tokens, sentences, chunks, paths, markup, tool calls."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.session import spread

NOT_WORD = r"[^\p{L}\p{N}]+"
#: Stand for a blank that may not be split at, and for a place to split at (private characters).
HELD, CUT = "\ue000", "\ue001"
#: Abbreviations that do not end a sentence (a parameter of the functions below).
ABBREVIATIONS = "art artt all avv dott prof sig sigg ing arch geom cap cfr cit co comma doc ecc es fasc fig lett n nn nr num pag pagg par prot rif sent sez ss tab tel v vol".split()


def tokens(text: Column) -> Column:
    """Lower-cased maximal runs of letters and digits."""
    return F.filter(F.split(F.lower(text), NOT_WORD), lambda t: t != "")


def words(text: Column, least: int, abbreviations: list[str] | None = None) -> Column:
    """Alphabetic words longer than ``least`` that are no abbreviations, lower-cased."""
    stop = F.array(*(F.lit(a) for a in (abbreviations if abbreviations is not None else ABBREVIATIONS)))
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: (F.length(w) > least) & ~F.array_contains(stop, w))


def sentence_array(text: Column, abbreviations: list[str] | None = None) -> Column:
    """Sentences: cut after . ! ? and white space, but not after abbreviations, initials and list numbers; blank ones dropped."""
    alt = "|".join(abbreviations if abbreviations is not None else ABBREVIATIONS)
    x = text
    for _ in range(2):  # neighbours share a blank: a second pass holds those the first one stepped over
        x = F.regexp_replace(x, rf"(?i)(^|[^\p{{L}}\p{{N}}])({alt}|\p{{L}})\.\s+", rf"$1$2.{HELD}")
    x = F.regexp_replace(x, r"(^|\s)([0-9]+)\.\s+(\p{Lu}\p{Ll})", rf"$1$2.{HELD}$3")
    x = F.regexp_replace(x, r"([.!?])\s+", f"$1{CUT}")
    parts = F.transform(F.split(x, CUT), lambda s: F.trim(F.replace(s, F.lit(HELD), F.lit(" "))))
    return F.filter(parts, lambda s: F.regexp_replace(s, r"\s+", "") != "")


def grouped_sentences(sentences: Column, size: int = 2) -> Column:
    """Consecutive groups of ``size`` sentences joined by a blank."""
    last = F.ceil(F.size(sentences) / F.lit(float(size))).cast("int") - 1
    groups = F.transform(F.sequence(F.lit(0), last), lambda k: F.concat_ws(" ", F.slice(sentences, k * size + 1, size)))
    return F.when(F.size(sentences) > 0, groups).otherwise(F.array().cast("array<string>"))


def chunk_documents(docs: DataFrame, id_col: str, text_col: str, size: int = 2) -> DataFrame:
    """Rows (``id_col``, idx, chunk_id, text). The chunk id is a hash of document, place and text: loading again changes nothing."""
    s = spread(docs.select(id_col, text_col)).select(F.col(id_col).alias("doc"), sentence_array(F.col(text_col)).alias("s"))
    c = s.select("doc", F.posexplode(grouped_sentences(F.col("s"), size)).alias("idx", "text"))
    key = F.sha2(F.concat_ws("\x1f", F.col("doc").cast("string"), F.col("idx").cast("string"), "text"), 256)
    return c.select(F.col("doc").alias(id_col), "idx", key.alias("chunk_id"), "text")


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"(.)\.[^.]*$", "$1")


def phrase_query(text: str) -> str:
    """A phrase query: trimmed, quotes escaped, in quotes."""
    return '"' + text.replace('"', '\\"').strip() + '"'


@F.pandas_udf(T.StringType())
def html_unescape(s: pd.Series) -> pd.Series:
    return s.map(lambda x: html.unescape(x) if isinstance(x, str) else None)


#: Names of tools a response may call (fixed values); wide_article is the same as wide_search.
TOOLS = ("search_by_embedding", "search_by_text", "search_by_category", "search_article", "wide_search", "wide_article", "end_querying")


def tool_calls(response: Column, faithful: bool = False) -> Column:
    """array<struct<func,arg1,arg2>> of the calls of a response, in order; unknown and malformed ones are dropped.

    By default arguments lose outer blanks and quotes, and a single argument is the text (``arg2``). ``faithful``
    keeps the blank and quote of a second argument and puts a single argument first.
    """
    bodies = F.regexp_extract_all(response, F.lit(r"(?s)<api>(.*?)</api>"), 1)

    def call(body: Column) -> Column:
        b = F.trim(body)
        name = F.regexp_extract(b, r"^([A-Za-z_]+)", 1)
        inner = F.regexp_extract(b, r"(?s)^[A-Za-z_]+[^(]*\((.*)$", 1)
        answer = F.trim(F.regexp_extract(b, r"(?s)end_querying\((.*)\)", 1))
        args = F.split(F.regexp_replace(inner, r"\)+$", ""), ",", 2)
        strip = (lambda c: F.regexp_replace(c, r"^'+|'+$", "")) if faithful else (lambda c: F.regexp_replace(F.trim(c), r"^[' ]+|[' ]+$", ""))
        first, second = strip(F.get(args, F.lit(0))), strip(F.coalesce(F.get(args, F.lit(1)), F.lit("")))
        single = F.size(args) < 2
        one, two = (first, second) if faithful else (F.when(single, "").otherwise(first), F.when(single, first).otherwise(second))
        known = F.lit(False)
        for t in TOOLS[:-1]:
            if not (faithful and t == "wide_article"):
                known = known | b.startswith(t)
        func = name if faithful else F.when(name == "wide_article", "wide_search").otherwise(name)
        has = F.instr(b, "(") > 0
        none = F.lit(None).cast("struct<func:string,arg1:string,arg2:string>")
        return (
            F.when(b.startswith("end_querying") & b.rlike(r"(?s)end_querying\(.*\)"), F.struct(F.lit("end_querying").alias("func"), answer.alias("arg1"), F.lit("").alias("arg2")))
            .when(known & has, F.struct(func.alias("func"), one.alias("arg1"), two.alias("arg2"))).otherwise(none)
        )

    return F.filter(F.transform(bodies, call), lambda c: c.isNotNull())
