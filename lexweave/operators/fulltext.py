"""Full-text scores without an index server: BM25 over terms and phrases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import tokens
from lexweave.session import spread

K1, B = 1.2, 0.75
#: A token, and what keeps a term from being the beginning of a longer one.
WORD, NOT_BEFORE = r"[\p{L}\p{N}]+", r"(?![\p{L}\p{N}])"


def query_terms(query: str) -> list[str]:
    import re

    return list(dict.fromkeys(t for t in re.split(r"[\W_]+", query.lower()) if t))


def _bm25(tf: list[Column], df_: list[Column], n: Column, length: Column, average: Column) -> Column:
    norm = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length / average)
    idf = [F.log(1 + (n - d + 0.5) / (d + 0.5)) for d in df_]
    return reduce(Column.__add__, (i * t / (t + norm) for i, t in zip(idf, tf)))


def search(docs: DataFrame, id_col: str, text_col: str, query: str, phrase: bool = False) -> DataFrame:
    """Rows (``id_col``, score) of the documents that have a term of the query, or with ``phrase`` its terms in a row.

    One pass counts the terms of each document; the corpus statistics are a single row. Nothing is exchanged but
    that row, however large the corpus. A phrase scores as one term with the sum of its terms' weights.
    """
    terms = query_terms(query)
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    t = spread(docs.select(F.col(id_col).alias("id"), F.lower(text_col).alias("x")).where("x IS NOT NULL"))
    # counted by patterns on the text: no array of tokens is built, and a pattern is tried only where its first term occurs
    count = lambda pattern, first: F.when(F.contains("x", F.lit(first)), F.regexp_count("x", F.lit(pattern))).otherwise(0).cast("double")
    counted = t.select(
        "id", "x", F.regexp_count("x", F.lit(WORD)).cast("double").alias("len"), *(count(_whole(v), v).alias(f"tf{i}") for i, v in enumerate(terms)),
        *([count(_phrase(terms), terms[0]).alias("ptf")] if phrase else []),
    )
    stats = counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("average"), *(F.sum(F.when(F.col(f"tf{i}") > 0, 1.0).otherwise(0.0)).alias(f"df{i}") for i in range(len(terms))))
    some = reduce(Column.__or__, (F.contains("x", F.lit(v)) for v in terms))  # the second pass reads the rest no further
    both = counted.where(some).crossJoin(F.broadcast(stats))  # a single row
    dfs = [F.col(f"df{i}") for i in range(len(terms))]
    if phrase:
        score, has = _bm25([F.col("ptf")] * len(terms), dfs, F.col("n"), F.col("len"), F.col("average")), F.col("ptf") > 0
    else:
        score = _bm25([F.col(f"tf{i}") for i in range(len(terms))], dfs, F.col("n"), F.col("len"), F.col("average"))
        has = reduce(Column.__or__, (F.col(f"tf{i}") > 0 for i in range(len(terms))))
    return both.where(has).select(F.col("id").alias(id_col), score.alias("score"))


def _whole(term: str, then: str = "") -> str:
    """Pattern of a term that is a token by itself; what stands before it is looked at last, only where it occurs."""
    return rf"{term}{NOT_BEFORE}{then}(?<![\p{{L}}\p{{N}}]{term})"


def _phrase(terms: list[str]) -> str:
    """Pattern of the terms in a row; only the first is consumed, so that phrases may overlap."""
    rest = "".join(rf"[^\p{{L}}\p{{N}}]+{t}" for t in terms[1:])
    return _whole(terms[0], rf"(?={rest}{NOT_BEFORE})" if rest else "")


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (term, id, tf, len): the inverted table, to be written once partitioned or bucketed by term."""
    t = docs.select(F.col(id_col).alias("id"), F.array_sort(tokens(F.col(text_col))).alias("w")).where(F.size("w") > 0)
    # counted inside each document by where the runs of its sorted tokens begin: no exchange by (term, id), and no search of the array for each term
    begins = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: (i == 0) | (F.get("w", i) != F.get("w", i - 1)))
    runs = t.select("id", F.size("w").alias("len"), "w", begins.alias("b"))
    each = runs.select("id", "len", F.explode(F.transform("b", lambda i, k: F.struct(F.get("w", i).alias("term"), (F.coalesce(F.get("b", k + 1), F.col("len")) - i).alias("tf")))).alias("c"))
    return each.select("c.term", "id", "c.tf", "len")


#: Parts an index is written in; a term lies in one of them.
PARTS = 64


def write_index(docs: DataFrame, id_col: str, text_col: str, folder: str) -> None:
    """Stores the inverted table in parts by term, and the statistics of the corpus, for ``search_index``."""
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    postings(docs, id_col, text_col).withColumn("part", part).repartition("part", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("part", "term").write.mode("overwrite").partitionBy("part").parquet(f"{folder}/postings")
    counted = docs.where(F.col(text_col).isNotNull()).select(F.regexp_count(F.lower(text_col), F.lit(WORD)).cast("double").alias("len"))
    counted.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg("len").alias("average")).write.mode("overwrite").parquet(f"{folder}/statistics")


def search_index(spark: SparkSession, folder: str, id_col: str, query: str) -> DataFrame:
    """The rows of ``search`` from a stored index: only the parts of the query's terms are read, and of these only their row groups."""
    terms = query_terms(query)
    stored = spark.read.parquet(f"{folder}/postings")
    asked = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int").alias("part")).collect()
    hits = stored.where(F.col("part").isin([r["part"] for r in asked]) & F.col("term").isin(terms)).select("term", "id", F.col("tf").cast("double").alias("tf"), F.col("len").cast("double").alias("len"))
    stats = spark.read.parquet(f"{folder}/statistics")
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df"))  # a row for each term of the query
    scored = hits.join(F.broadcast(df_), "term").crossJoin(F.broadcast(stats))
    score = _bm25([F.col("tf")], [F.col("df")], F.col("n"), F.col("len"), F.col("average"))
    return scored.groupBy(F.col("id").alias(id_col)).agg(F.sum(score).alias("score"))


def contains(docs: DataFrame, text_col: str, needle: str) -> DataFrame:
    """Documents whose text holds ``needle``, letter case aside."""
    return docs.where(F.contains(F.lower(text_col), F.lit(needle.lower())))
