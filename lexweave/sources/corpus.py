"""Law corpora in nested JSON: keys become labels, scalars properties, lists and objects children."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexweave.functions.text import basename
from lexweave.schema import KB_NODE

KNOWN = ("titolo", "rubrica", "contenuto", "source")


def node_id(*parts: object) -> str:
    return hashlib.sha256("\x1f".join(map(str, parts)).encode()).hexdigest()[:32]


def flatten(name: str, text: str) -> list[dict]:
    """The nodes of one file, parents first; none if it is no JSON object.

    The id of a node is a hash of the file and its path, so loading again gives the same ids. Scalars inside lists
    are dropped; a law without a name is called Unknown.
    """
    try:
        tree = json.loads(text)
    except ValueError:
        return []
    if not isinstance(tree, dict):
        return []
    root = tree.get("Document", tree)
    if not isinstance(root, dict):
        return []
    law = str(root.get("nome_legge") or "Unknown")
    out: list[dict] = []
    todo = [(root, "Document", None, 0, (name,), 0)]
    at = 0
    while at < len(todo):
        obj, label, parent, pos, path, depth = todo[at]
        at += 1
        me = node_id(*path)
        scalars = {k: v for k, v in obj.items() if not isinstance(v, (dict, list)) and v is not None}
        row = {"node_id": me, "doc_id": node_id(name), "parent_id": parent, "label": label, "nome_legge": law, "child_pos": pos, "depth": depth}
        row |= {k: str(scalars[k]) if k in scalars else None for k in KNOWN}
        row["props"] = {k: v if isinstance(v, str) else json.dumps(v) for k, v in scalars.items() if k not in KNOWN}
        out.append(row)
        n = 0
        for key, value in obj.items():
            for child in value if isinstance(value, list) else [value]:
                if isinstance(child, dict):
                    todo.append((child, key, me, n, (*path, key, n), depth + 1))
                    n += 1
    return out


def nodes_of(files: DataFrame) -> DataFrame:
    """files(name, text) -> nodes; one task flattens a file at a time, which bounds it by the largest file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cols = KB_NODE.fieldNames()
        for b in batches:
            rows = [r for n, t in zip(b["name"], b["text"]) for r in flatten(n, t or "")]
            yield pd.DataFrame([[r[c] for c in cols] for r in rows], columns=cols)

    return files.select("name", "text").mapInPandas(run, KB_NODE)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of all *.json files; files that are no JSON are skipped."""
    t = spark.read.option("pathGlobFilter", "*.json").text(folder, wholetext=True)
    return nodes_of(t.select(basename(F.col("_metadata.file_path")).alias("name"), F.col("value").alias("text")))


def edges_of(nodes: DataFrame) -> DataFrame:
    """HAS edges (parent_id, child_id, child_pos)."""
    return nodes.where("parent_id IS NOT NULL").select("parent_id", F.col("node_id").alias("child_id"), "child_pos")


def with_embeddings(nodes: DataFrame, provider=None) -> DataFrame:
    """Vectors for contents (of the content, else the heading) and parts (of the heading)."""
    from lexweave.functions.vectors import embed

    source = F.when(F.col("label") == "contenuto", F.coalesce("contenuto", "rubrica")).when(F.col("label") == "parti", F.col("rubrica"))
    return nodes.withColumn("embedding", F.when(source.isNotNull(), embed(source, provider)))
