"""Incremental loading: new files become chunks once, however often a batch is tried."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import basename, chunk_documents
from lexweave.sources.readers import decoded


def document_stream(spark: SparkSession, folder: str, pattern: str = "*.txt", files_per_trigger: int = 1000) -> DataFrame:
    """Stream (name, text, modified) of the files of a folder, of any age: by default the source drops those a week older than the newest."""
    s = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary")
    raw = s.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).option("maxFileAge", "36500d").load(folder)
    return raw.select(basename(F.col("path")).alias("name"), decoded(F.col("content")).alias("text"), F.col("modificationTime").alias("modified"))


def start_ingest(stream: DataFrame, out: str, checkpoint: str):
    """Writes chunks to ``out``; a name that comes again is loaded once, however old its file is.

    Each batch goes to a folder of its own number, which a retry overwrites, so the sink is idempotent. Names that
    other batches have chunks of are left out; of one name in a batch the file modified first stays.
    """

    def write(batch: DataFrame, number: int) -> None:
        new = batch.groupBy("name").agg(F.min_by("text", F.struct("modified", "text")).alias("text"))
        try:
            written = batch.sparkSession.read.schema("name string, batch int").parquet(out)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            new = new.join(written.where(F.col("batch") != number).select("name").distinct(), "name", "left_anti")
        chunk_documents(new, "name", "text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals_by_window(stream: DataFrame, late: str = "30 days", window: str = "7 days") -> DataFrame:
    """Rows of a stream with (created_at, text) counted by window of creation; later ones than ``late`` are left out."""
    s = stream.withWatermark("created_at", late)
    return s.groupBy(F.window("created_at", window)).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars")).select("window.start", "window.end", "chunks", "chars")
