"""Queries of the training-data operators over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.session import table
from lexweave.llm import canonical, names, neardup, neighbours, pack, pii, sentences, spam, split, sql, tokenize


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical.map_laws(table(spark, sf_dir, "kb_document"), table(spark, sf_dir, "law_ref"))


def node_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of both graphs: chunk.text and kb_node.contenuto as (node_id, text)."""
    chunk = table(spark, sf_dir, "chunk").select(F.col("chunk_id").alias("node_id"), "text")
    return chunk.unionByName(table(spark, sf_dir, "kb_node").select("node_id", F.col("contenuto").alias("text")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences.sentence_spans(node_texts(spark, sf_dir), "node_id", "text")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_items(table(spark, sf_dir, "chunk"), "chunk_id", "text")


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.redacted(table(spark, sf_dir, "chunk"), "chunk_id", "text")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.pairs(table(spark, sf_dir, "entity"), "entity_id", "text").toDF("entity_id_a", "entity_id_b")


def p4_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.classes(table(spark, sf_dir, "entity"), "entity_id", "text")


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split.split_pieces(node_texts(spark, sf_dir), "node_id", "text", limit=1200, overlap=120)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_pieces(spark, sf_dir).where("piece = 0 AND pieces > 1").select("node_id")


def node_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vectors of both graphs as (node_id, embedding)."""
    chunk = table(spark, sf_dir, "chunk").select(F.col("chunk_id").alias("node_id"), "embedding")
    return chunk.unionByName(table(spark, sf_dir, "kb_node").select("node_id", "embedding"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.close_pairs(node_vectors(spark, sf_dir), "node_id", "embedding").toDF("node_id_a", "node_id_b")


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of all vectors for every node whose hashed id is divisible by 20."""
    return neighbours.nearest(node_vectors(spark, sf_dir), "node_id", "embedding", query="pmod(xxhash64(id), 20) = 0")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_pairs(table(spark, sf_dir, "chunk"), "chunk_id", "text").toDF("chunk_id_a", "chunk_id_b")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(table(spark, sf_dir, "chunk"), "chunk_id", "text")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize.encode(table(spark, sf_dir, "documents"), "doc_id", "text")


def p9_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pack(table(spark, sf_dir, "documents"), "doc_id", "text", capacity=2048)


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spam.spam_pages(table(spark, sf_dir, "documents"), "doc_id", "text", "lang")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p1_found": p1_found, "p2_found": p2_found, "p3_found": p3_found, "p3_redacted": p3_redacted, "p4_found": p4_found, "p4_classes": p4_classes, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p6_neighbours": p6_neighbours, "p7_found": p7_found, "p7_classes": p7_classes, "p8_ids": p8_ids, "p9_containers": p9_containers, "p10_found": p10_found}


def oracle_sql() -> dict[str, str]:
    return dict(sql.ORACLE)
