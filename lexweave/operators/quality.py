"""What a graph store would enforce, as queries: uniqueness and the state of vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexweave.functions.vectors import vector_status

#: Unique keys of the tables.
KEYS = {"chunk": [["chunk_id"], ["name", "idx"]], "kb_document": [["kb_id"]], "kb_node": [["node_id"]], "entity": [["entity_id"], ["text", "label"]], "has_entity": [["chunk_id", "entity_id"]]}


def violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with the number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def uniqueness(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows (table, key, violating): how many keys of each constraint are not unique."""
    parts = [violations(tables[t], k).agg(F.count(F.lit(1)).alias("violating")).select(F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("key"), "violating") for t, ks in KEYS.items() if t in tables for k in ks]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def vector_report(df: DataFrame, vec: str, dim: int = 64) -> DataFrame:
    return df.groupBy(vector_status(F.col(vec), dim).alias("status")).agg(F.count(F.lit(1)).alias("rows"))
