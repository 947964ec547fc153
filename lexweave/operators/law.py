"""The law corpus: articles of a law, resolution of citations, descent along the tree, combined search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.functions import vectors as vec
from lexweave.operators import fulltext, graph
from lexweave.session import checkpointed

THRESHOLD = 0.8


def article_number(title: Column) -> Column:
    """The number of a title 'Art. 5' or 'Articolo 5', as text; null for other titles."""
    n = F.regexp_extract(title, r"^(?:Art\. |Articolo )(.+)$", 1)
    return F.when(n != "", n)


def law_filter(df: DataFrame, law: str | None, col: str = "nome_legge") -> DataFrame:
    """Rows of one law; null and blank names filter nothing."""
    return df.where(F.col(col) == law) if law and law.strip() else df


def articles(nodes: DataFrame, documents: DataFrame) -> DataFrame:
    """Leaves with their law: (node_id, kb_id, number, titolo, rubrica, contenuto, law_name). The law is on the node, so no closure is needed."""
    leaf = graph.leaves(nodes).where("label = 'contenuto'")
    return leaf.join(documents.select("kb_id", F.col("nome_legge").alias("law_name")), "kb_id").select("node_id", "kb_id", article_number(F.col("titolo")).alias("number"), "titolo", "rubrica", "contenuto", "law_name")


def lookup(nodes: DataFrame, documents: DataFrame, number: str, law: str | None = None) -> DataFrame:
    """The first article (by node id) with that number, of one law or any: one row or none."""
    a = articles(nodes, law_filter(documents, law)).where(F.col("titolo") == f"Art. {number}")
    return a.orderBy("node_id").limit(1).select("titolo", F.coalesce("rubrica", F.lit("")).alias("rubrica"), F.coalesce("contenuto", F.lit("")).alias("contenuto"), "law_name")


def best_document(documents: DataFrame, name: str, threshold: float = THRESHOLD) -> DataFrame:
    """The law whose name holds ``name`` as a phrase, of the best score above the threshold: (kb_id, score)."""
    s = fulltext.search(documents, "kb_id", "nome_legge", name, phrase=True)
    return s.where(F.col("score") > threshold).orderBy(F.desc("score"), "kb_id").limit(1)


def best_documents(names: DataFrame, documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``best_document`` for all of names(name) at once: rows (name, kb_id, score), ties by id.

    A name and the laws that may hold it meet at its rarest term; the phrase is then looked for in these only.
    """
    from lexweave.functions.text import tokens

    held = checkpointed(documents.where("nome_legge IS NOT NULL").select("kb_id", tokens(F.col("nome_legge")).alias("w")))
    stats = held.agg(F.count(F.lit(1)).cast("double").alias("n"), F.avg(F.size("w")).alias("average"))
    each = held.select("kb_id", F.explode(F.array_distinct("w")).alias("term"))
    weight = each.groupBy("term").agg(F.count(F.lit(1)).cast("double").alias("df")).crossJoin(F.broadcast(stats))  # a single row
    weight = weight.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    asked = names.select("name").distinct().select("name", tokens(F.col("name")).alias("q")).where(F.size("q") > 0)
    # a name with a term that no law has is in none
    terms = asked.select("name", "q", F.explode(F.array_distinct("q")).alias("term")).join(weight, "term", "left")
    asked = terms.groupBy("name", "q").agg(F.min(F.struct("df", "term")).alias("rarest"), F.sum("idf").alias("idf"), F.max(F.col("df").isNull()).alias("unknown")).where("NOT unknown")
    met = asked.select("name", "q", "idf", F.col("rarest.term").alias("term")).join(each, "term").join(held, "kb_id").crossJoin(F.broadcast(stats))
    m = F.size("q")
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - m + 1)), lambda i: F.slice("w", i, m) == F.col("q"))
    met = met.withColumn("tf", F.size(at).cast("double")).where("tf > 0")
    score = F.col("idf") * F.col("tf") / (F.col("tf") + fulltext.K1 * (F.lit(1 - fulltext.B) + fulltext.B * F.size("w") / F.col("average")))
    best = met.withColumn("score", score).where(F.col("score") > threshold).groupBy("name").agg(F.min(F.struct((-F.col("score")).alias("s"), "kb_id")).alias("b"))
    return best.select("name", "b.kb_id", (-F.col("b.s")).alias("score"))


def resolve(citations: DataFrame, documents: DataFrame, nodes: DataFrame) -> DataFrame:
    """citations(doc_key, number) joined with documents(doc_key, kb_id) and their articles at once.

    Rows (doc_key, number, kb_id, node_id): law and article, law only, or neither.
    """
    c = citations.select("doc_key", "number").distinct()
    d = documents.where("doc_key IS NOT NULL").groupBy("doc_key").agg(F.min("kb_id").alias("kb_id"))
    a = nodes.where("label = 'contenuto'").select("kb_id", "node_id", article_number(F.col("titolo")).alias("number")).where("number IS NOT NULL")
    a = a.groupBy("kb_id", "number").agg(F.min("node_id").alias("node_id"))
    return c.join(d, "doc_key", "left").join(a, ["kb_id", "number"], "left").select("doc_key", "number", "kb_id", "node_id")


def start_nodes(nodes: DataFrame, documents: DataFrame, law: str | None = None) -> DataFrame:
    """Where a descent begins: the parts of the laws and the contents whose title begins with TITOLO."""
    n = nodes.join(law_filter(documents, law).select("kb_id"), "kb_id", "left_semi")
    return n.where("label = 'parti'").select("node_id").union(n.where((F.col("label") == "contenuto") & F.col("titolo").startswith("TITOLO")).select("node_id")).distinct()


def scored_nodes(nodes: DataFrame, query: list[float]) -> DataFrame:
    """Nodes with a usable vector: (node_id, parent_id, titolo, contenuto, source, score)."""
    s = nodes.select("node_id", "parent_id", "label", "titolo", "contenuto", "source", vec.index_score(vec.cosine_to(F.col("embedding"), query)).alias("score"))
    return s.where("score IS NOT NULL")


def best_children(scored: DataFrame, faithful: bool = False) -> DataFrame:
    """The best content child of each node; ties by id. ``faithful``: only a child that is the best content of all."""
    if faithful:
        top = scored.where("label = 'contenuto'").orderBy(F.desc("score"), "node_id").limit(1).select("node_id")
        scored = scored.join(F.broadcast(top), "node_id", "left_semi")  # one row
    w = Window.partitionBy("parent_id").orderBy(F.desc("score"), "node_id")
    return scored.where("label = 'contenuto' AND parent_id IS NOT NULL").withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def descend(start: DataFrame, children: DataFrame, levels: int = 20) -> DataFrame:
    """Best child by best child from every start at once, the queue's first leaf (one with content) ends the search.

    Rows (step, start_id, node_id, score, titolo, contenuto, source), at most one: the least step, then the least start.
    The loop runs over the levels of the tree; a frontier never holds a visited node again.
    """
    frontier = checkpointed(start.select(F.col("node_id").alias("start_id"), "node_id"))
    visited = frontier.select("node_id")
    step = children.select(F.col("parent_id").alias("node_id"), F.col("node_id").alias("child_id"), "titolo", "contenuto", "source", "score")
    for k in range(1, levels + 1):
        if frontier.isEmpty():
            break
        reached = frontier.join(step, "node_id").withColumn("step", F.lit(k))
        reached = checkpointed(reached.select("step", "start_id", F.col("child_id").alias("node_id"), "score", "titolo", "contenuto", "source").join(visited, "node_id", "left_anti"))
        leaf = reached.where("trim(contenuto) <> ''").orderBy("start_id").limit(1)
        if not leaf.isEmpty():
            return leaf
        frontier = reached.select("start_id", "node_id")
        visited = checkpointed(visited.union(frontier.select("node_id")).distinct())
    return start.sparkSession.createDataFrame([], "node_id string, step int, start_id string, score double, titolo string, contenuto string, source string")


def wide_search(nodes: DataFrame, documents: DataFrame, query: list[float], text: str, law: str | None = None, filter_all: bool = False) -> DataFrame:
    """Up to three results (strategy, source, titolo, contenuto, similarity): descent, nearest vector, best full text.

    The law restricts the descent only, unless ``filter_all``.
    """
    scored = checkpointed(scored_nodes(nodes, query))
    out = ["strategy", "source", "titolo", "contenuto", "similarity"]
    pick = lambda df, n: df.select(F.lit(n).alias("strategy"), F.coalesce("source", F.lit("")).alias("source"), F.coalesce("titolo", F.lit("")).alias("titolo"), F.coalesce("contenuto", F.lit("")).alias("contenuto"), F.col("score").alias("similarity"))
    walk = descend(start_nodes(nodes, documents, law), best_children(scored))
    pool = nodes.join(law_filter(documents, law).select("kb_id"), "kb_id", "left_semi") if filter_all else nodes
    near = scored.where("label = 'contenuto'")
    if filter_all:
        near = near.join(pool.select("node_id"), "node_id", "left_semi")
    near = near.orderBy(F.desc("score"), "node_id").limit(1)
    body = pool.where("label = 'contenuto'").select("node_id", "titolo", "contenuto", "source")
    best = fulltext.search(body, "node_id", "contenuto", text).orderBy(F.desc("score"), "node_id").limit(1)
    return pick(walk, "1-descent").unionByName(pick(near, "2-vector")).unionByName(pick(body.join(F.broadcast(best), "node_id"), "3-text")).select(*out)
