"""Reading documents, law corpora, commentaries and settings."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexweave.functions.text import basename, stem
from lexweave.schema import RELATED_JSONL


@dataclass(frozen=True)
class Settings:
    """What a retrieval session needs. Credentials have no place here."""

    limit: int = 5
    candidates: int = 400
    iterations: int = 10
    max_tokens: int = 1000
    extra: dict = field(default_factory=dict)


def load_settings(path: str) -> Settings:
    """Settings from a YAML file; unknown keys are kept in ``extra``."""
    try:
        import yaml

        raw = yaml.safe_load(Path(path).read_text()) or {}
    except ImportError:  # a flat file of "key: value" lines needs no parser
        pairs = (line.split(":", 1) for line in Path(path).read_text().splitlines() if ":" in line and not line.startswith((" ", "#")))
        raw = {k.strip(): int(v) if v.strip().isdigit() else v.strip() for k, v in pairs}
    known = {k: raw[k] for k in ("limit", "candidates", "iterations", "max_tokens") if isinstance(raw.get(k), int)}
    return Settings(**known, extra={k: v for k, v in raw.items() if k not in known})


def file_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the files of a folder, not of its subfolders; contents are not read."""
    return spark.read.format("binaryFile").load(folder).select(basename(F.col("path")).alias("name"))


def decoded(content: Column) -> Column:
    """Bytes as UTF-8 if they are, else as ISO-8859-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), F.decode(content, "UTF-8")).otherwise(F.decode(content, "ISO-8859-1"))


def read_documents(spark: SparkSession, folder: str, pattern: str = "*", pdf_text: Callable[[bytes], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, errors): documents(name, text); errors(name, error) for empty texts and PDF files that cannot be read.

    ``pdf_text`` turns the bytes of a PDF file into text; without it every PDF file is an error row.
    """
    raw = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select(basename(F.col("path")).alias("name"), "content")
    is_pdf = F.lower("name").endswith(".pdf")

    @F.pandas_udf(T.StringType())
    def pdf(s: pd.Series) -> pd.Series:
        def one(b):
            try:
                return pdf_text(bytes(b)) if pdf_text else None
            except Exception:  # noqa: BLE001 - one bad file is one error row
                return None

        return s.map(one)

    plain = raw.where(~is_pdf).select("name", decoded(F.col("content")).alias("text"), F.lit("empty document").alias("error"))
    pdfs = raw.where(is_pdf).select("name", pdf(F.col("content")).alias("text"), F.lit("unreadable or empty PDF").alias("error"))
    both = plain.unionByName(pdfs)
    blank = F.coalesce(F.regexp_replace("text", r"\s+", "") == "", F.lit(True))
    return both.where(~blank).select("name", "text"), both.where(blank).select("name", "error")


def read_statutes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (file, text) of the *.txt files, each read whole."""
    t = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    return t.select(basename(F.col("_metadata.file_path")).alias("file"), F.col("value").alias("text"))


def write_statutes(cleaned: DataFrame, folder: str, suffix: str = "_pulito") -> None:
    """Rows (file, clean_text) as one partition for each file, named <stem><suffix>."""
    cleaned.select(F.concat(stem(F.col("file")), F.lit(suffix)).alias("name"), F.col("clean_text").alias("value")).write.mode("overwrite").partitionBy("name").text(folder)


def read_commentary(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of the *.jsonl files: (file, line_no, article_number, text); lines that are no JSON are error rows."""
    raw = spark.read.option("pathGlobFilter", "*.jsonl").text(folder)
    # files are read by line, large ones in blocks; a line's number is its place in the block and the lines of the blocks before
    raw = raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"))
    blocks = raw.groupBy("path", "block").agg(F.count(F.lit(1)).alias("lines"), F.min("at").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.withColumn("before", F.coalesce(before, F.lit(0))).drop("lines")
    lines = raw.join(blocks, ["path", "block"]).select(basename(F.col("path")).alias("file"), (F.col("at") - F.col("first") + F.col("before")).cast("int").alias("line_no"), "line").where(F.trim("line") != "")
    parsed = lines.withColumn("j", F.from_json("line", RELATED_JSONL, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))
    bad = F.col("j._corrupt_record").isNotNull() | F.col("j").isNull()
    good = parsed.where(~bad).select("file", "line_no", "j.article_number", "j.text").where("article_number IS NOT NULL AND text IS NOT NULL AND text <> ''")
    return good, parsed.where(bad).select("file", "line_no", "line")


def append_results(results: DataFrame, folder: str) -> None:
    """Session results as JSON lines, added to those there."""
    results.write.mode("append").json(folder)
