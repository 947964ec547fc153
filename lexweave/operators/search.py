"""Retrieval over the document graph: by vector, by text, by entity category, each hit with its context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions import vectors as vec
from lexweave.operators import fulltext, graph
from lexweave.schema import EMPTY_RELATED
from lexweave.session import broadcast_few, checkpointed

CANDIDATES, LIMIT = 400, 5


class Graph:
    """The tables a search reads: chunks(chunk_id, name, idx, text, embedding), entities, has_entity, related, nodes."""

    def __init__(self, chunks: DataFrame, entities: DataFrame, has_entity: DataFrame, related: DataFrame | None = None, nodes: DataFrame | None = None):
        self.chunks, self.entities, self.has_entity, self.nodes = chunks, entities, has_entity, nodes
        self.related = related if related is not None else chunks.sparkSession.createDataFrame([], EMPTY_RELATED)


def vector_top(chunks: DataFrame, query: list[float], k: int = CANDIDATES, id_col: str = "chunk_id", vec_col: str = "embedding") -> DataFrame:
    """The k nearest rows of the whole table, (..., score); ties by id. Unusable vectors are no candidates."""
    scored = chunks.withColumn("score", vec.index_score(vec.cosine_to(F.col(vec_col), query))).drop(vec_col)
    return scored.where("score IS NOT NULL").orderBy(F.desc("score"), id_col).limit(k)


def _shaped(g: Graph, hits: DataFrame, only_category: str | None = None) -> DataFrame:
    """Adds the context to hits (chunk_id, name, idx, text, score). Each side is gathered by itself, for the hits only.

    The hits, at most as many as the limit, are written out first: every side reads them, and the search is done once.
    """
    hits = checkpointed(hits)
    entities = g.entities if only_category is None else g.entities.where(F.lower("label") == only_category.lower())
    keys = broadcast_few(hits.select("chunk_id"))
    ents = graph.entities_of(entities, broadcast_few(g.has_entity.join(keys, "chunk_id", "left_semi").select("entity_id", "chunk_id")))
    related = g.related.withColumnRenamed("src_id", "chunk_id").join(keys, "chunk_id", "left_semi")
    if g.nodes is not None:
        # contents only, each once, with what they say
        target = g.nodes.where("label = 'contenuto'").select(F.col("node_id").alias("dst_id"), F.coalesce("contenuto", F.lit("")).alias("said"))
        related = target.join(broadcast_few(related.select("dst_id", "chunk_id")), "dst_id").select("chunk_id", "dst_id", F.col("said").alias("text"))
    related = related.where("text IS NOT NULL").groupBy("chunk_id").agg(F.array_sort(F.collect_set(F.struct("dst_id", "text"))).alias("r"))
    # one row at most for each hit
    near, ents, related = (F.broadcast(x) for x in (graph.neighbours_of(hits, g.chunks.select("name", "idx", "text")), ents, related))
    alone = F.array().cast("array<string>")
    none = F.array().cast("array<struct<text:string,label:string>>")
    return (
        hits.join(near, "chunk_id", "left").join(ents, "chunk_id", "left").join(related, "chunk_id", "left")
        .select(
            "text", "chunk_id", F.col("score").alias("similarity"), F.col("name").alias("source"),
            *(F.coalesce(c, alone).alias(c) for c in ("prev_chunks", "next_chunks")),
            F.coalesce("entities", none).alias("entities"),
            F.coalesce(F.transform("r", lambda x: F.struct(x["text"].alias("text"))), F.array().cast("array<struct<text:string>>")).alias("related"),
        )
        .orderBy(F.desc("similarity"), "chunk_id")
    )


def by_vector(g: Graph, query: list[float], doc: str | None = None, limit: int = LIMIT, candidates: int = CANDIDATES) -> DataFrame:
    """The nearest chunks; a document filters the nearest ``candidates`` of all, so it may give fewer than ``limit``."""
    top = vector_top(g.chunks.select("chunk_id", "name", "idx", "text", "embedding"), query, candidates)
    hits = (top.where(F.col("name") == doc) if doc else top).orderBy(F.desc("score"), "chunk_id").limit(limit)
    return _shaped(g, hits)


def by_text(g: Graph, text: str, doc: str | None = None, limit: int = LIMIT, mode: str = "bm25") -> DataFrame:
    """Full-text search, ``mode`` bm25 or contains; a document filters after scoring."""
    base = g.chunks.select("chunk_id", "name", "idx", "text")
    if mode == "contains":
        scored = fulltext.contains(base, "text", text).select("chunk_id", F.lit(1.0).alias("score"))
    else:
        scored = fulltext.search(base, "chunk_id", "text", text)
    if doc:
        scored = scored.join(base.where(F.col("name") == doc).select("chunk_id"), "chunk_id", "left_semi")
    top = scored.orderBy(F.desc("score"), "chunk_id").limit(limit)
    return _shaped(g, base.join(F.broadcast(top), "chunk_id"))


def by_category(g: Graph, category: str, doc: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Chunks with an entity of a category (letter case aside), score 1, with the matching entities only."""
    e = g.entities.where(F.lower("label") == category.lower()).select("entity_id")
    ids = g.has_entity.join(e, "entity_id", "left_semi").select("chunk_id").distinct()
    base = g.chunks.select("chunk_id", "name", "idx", "text")
    hits = (base.where(F.col("name") == doc) if doc else base).join(ids, "chunk_id", "left_semi").orderBy("chunk_id").limit(limit)
    return _shaped(g, hits.withColumn("score", F.lit(1.0)), category)
