"""The document graph as tables: nodes, edges, idempotent loading, context of a chunk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import text as tx
from lexweave.functions import vectors as vec
from lexweave.session import broadcast_few


def upsert(new: DataFrame, keys: list[str], old: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """MERGE by key: rows of ``old`` stay, of equal new keys the first by ``order`` is taken. Null keys name nothing."""
    new = new.dropna(subset=keys)
    if order:
        rest = [c for c in new.columns if c not in keys]
        new = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*") if rest else new.distinct()
    else:
        new = new.dropDuplicates(keys)
    return new if old is None else old.unionByName(new.join(old.select(*keys), keys, "left_anti"), allowMissingColumns=True)


def ingest_documents(docs: DataFrame, provider=None, entities: Column | None = None, size: int = 2) -> dict[str, DataFrame]:
    """documents(name, text) -> documents, chunks, entities, has_entity. Documents without a sentence have no chunk.

    A chunk without a text or vector is left out; the chain runs over those that stay. A zero vector is kept and
    marked by ``embedding_ok``.
    """
    from lexweave.functions.entities import extract

    chunks = tx.chunk_documents(docs, "name", "text", size).withColumn("embedding", vec.embed(F.col("text"), provider))
    chunks = chunks.where((F.length("text") > 0) & (F.size("embedding") > 0)).withColumn("embedding_ok", F.exists("embedding", lambda x: x != 0))
    found = chunks.select("chunk_id", F.explode(entities if entities is not None else extract(F.col("text"))).alias("e")).select("chunk_id", "e.text", "e.label")
    key = F.sha2(F.concat_ws("\x1f", "text", F.coalesce("label", F.lit(""))), 256)
    return {
        "documents": docs.select("name", F.lit("d").alias("tag")).dropDuplicates(["name"]),
        "chunks": chunks,
        "entities": found.select(key.alias("entity_id"), "text", "label").distinct(),
        "has_entity": found.select("chunk_id", key.alias("entity_id")).distinct(),
    }


#: Places of a document that one task handles; longer documents are spread.
SPAN = 4096


def with_adjacent(chunks: DataFrame, cols: list[str], doc: str = "name", idx: str = "idx") -> DataFrame:
    """Adds prev and next, structs of ``cols`` of the neighbours of each row in its document (null at the ends).

    A document is cut into spans of places, each a window partition of its own, so the longest document is spread
    over many tasks; only the first and last row of each span meet in a second, smaller window.
    """
    key = F.struct(F.col(idx).alias("i"), F.struct(*cols).alias("r"))
    rows = chunks.withColumn("_span", F.floor(F.col(idx) / SPAN))
    w = Window.partitionBy(doc, "_span").orderBy(idx)
    rows = rows.withColumn("prev", F.lag(F.struct(*cols)).over(w)).withColumn("next", F.lead(F.struct(*cols)).over(w))
    ends = rows.groupBy(doc, "_span").agg(F.min_by(key, idx).alias("first"), F.max_by(key, idx).alias("last"))
    v = Window.partitionBy(doc).orderBy("_span")
    ends = ends.select(doc, "_span", F.lag("last.r").over(v).alias("_before"), F.lead("first.r").over(v).alias("_after"))
    return rows.join(ends, [doc, "_span"]).withColumn("prev", F.coalesce("prev", "_before")).withColumn("next", F.coalesce("next", "_after")).drop("_span", "_before", "_after")


def next_edges(chunks: DataFrame, doc: str = "name", idx: str = "idx", chunk: str = "chunk_id") -> DataFrame:
    """Edges (src, dst): document to its first chunk, chunk to the next one."""
    return with_adjacent(chunks.select(doc, idx, chunk), [chunk], doc, idx).select(F.coalesce(F.col(f"prev.{chunk}"), F.col(doc)).alias("src"), F.col(chunk).alias("dst"))


def with_neighbours(chunks: DataFrame, doc: str = "name", idx: str = "idx") -> DataFrame:
    """Adds prev_chunks and next_chunks, arrays of no or one text."""
    one = lambda c: F.when(c.isNotNull(), F.array(c)).otherwise(F.array().cast("array<string>"))
    near = with_adjacent(chunks, ["text"], doc, idx)
    return near.withColumn("prev_chunks", one(F.col("prev.text"))).withColumn("next_chunks", one(F.col("next.text"))).drop("prev", "next")


def neighbours_of(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """prev_chunks and next_chunks of a few hits by equality on (name, idx +- 1), for chains without gaps.

    The two places beside each hit are broadcast, so the chunks are scanned once and not exchanged.
    """
    beside = F.explode(F.array(*(F.struct(F.lit(s).alias("side"), (F.col("idx") + s).alias("idx")) for s in (-1, 1))))
    places = broadcast_few(hits.select("chunk_id", "name", beside.alias("p")).select("chunk_id", "name", "p.side", "p.idx"))
    got = chunks.select("name", "idx", F.col("text").alias("t")).join(places, ["name", "idx"])
    on = lambda s: F.array_sort(F.collect_set(F.when(F.col("side") == s, F.col("t"))))
    return got.groupBy("chunk_id").agg(on(-1).alias("prev_chunks"), on(1).alias("next_chunks"))


def entities_of(has_entity: DataFrame, entities: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
    """Rows (chunk_id, entities): the sorted set of (text, label). Given ``chunks``, those without entities have [null]."""
    e = has_entity.join(entities, "entity_id").select("chunk_id", F.struct("text", "label").alias("e"))
    if chunks is not None:
        e = chunks.select("chunk_id").join(e, "chunk_id", "left").select("chunk_id", F.coalesce("e", F.struct(F.lit(None).cast("string").alias("text"), F.lit(None).cast("string").alias("label"))).alias("e"))
    return e.groupBy("chunk_id").agg(F.array_sort(F.collect_set("e")).alias("entities"))


def descendants(nodes: DataFrame, depth_limit: int = 20) -> DataFrame:
    """Rows (ancestor_id, node_id, depth) of the HAS closure of a shallow tree: one join a level, until no row is new.

    ``depth_limit`` only guards against cycles; an error is raised if it is reached.
    """
    from lexweave.session import checkpointed

    edges = nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("p"), F.col("node_id").alias("c"))
    level = checkpointed(edges.select(F.col("p").alias("ancestor_id"), F.col("c").alias("node_id"), F.lit(1).alias("depth")))
    out, depth = level, 1
    while not level.isEmpty():
        if depth > depth_limit:
            raise ValueError("the tree is deeper than depth_limit, or has a cycle")
        level = checkpointed(level.join(edges, level.node_id == edges.p).select("ancestor_id", F.col("c").alias("node_id"), (F.col("depth") + 1).alias("depth")))
        out, depth = out.unionByName(level), depth + 1
    return out


def leaves(nodes: DataFrame) -> DataFrame:
    """Nodes without children."""
    return nodes.join(nodes.where("parent_id IS NOT NULL").select(F.col("parent_id").alias("node_id")), "node_id", "left_anti")
