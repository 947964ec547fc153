"""Citations between articles: pairing, resolution, edges and their counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexweave.session import checkpointed

#: What the SQL twin of the mentions reads: a part of the forms below (fixed values).
PLAIN = r"(?:articolo|art\.)\s+[0-9]+(?:-bis)?|L\.\s+[0-9]+/[0-9]{4}|d\.lgs\.\s+n\.\s+[0-9]+\s+del\s+[0-9]{4}|codice della navigazione (?:fluviale|lacustre)"


_SUFFIX = "bis|ter|quater|quinquies|sexies|septies|octies|novies|decies|undecies|duodecies|terdecies"
_STOP = r"(?![\p{L}\p{N}])"
_NUMBER = rf"[0-9]+(?:[-\s]?(?:{_SUFFIX}){_STOP})?"
#: Paragraphs and letters between the articles of a list, and what joins these.
_WITHIN = rf"\s*,?\s*(?:co\.|comma|commi|lett\.|lettera|lettere|n\.)\s*(?:{_NUMBER}|[a-z]\)?){_STOP}"
_AND = r"(?:\s*[,;]\s*(?:(?:e|ed|o|od|nonché)\s+)?|\s+(?:e|ed|o|od|nonché)\s+)"
_ARTICLES = rf"(?:artt\.?|articoli)\s*{_NUMBER}(?:(?:{_WITHIN})*{_AND}{_NUMBER})*|(?:articolo\s+|art\.\s*|art\s+){_NUMBER}"
#: Written forms of the kinds of numbered acts, and of codes (fixed values).
ACTS = {
    "decreto legislativo": r"decreto\s+legislativo|d\.?\s?lgs\.?|d\.\s?l\.\s?gs\.?|d\.?\s?leg\.?", "decreto-legge": r"decreto[-\s]+legge|d\.\s?l\.|dl", "decreto ministeriale": r"decreto\s+ministeriale|decreto\s+min\.|d\.\s?m\.|dm",
    "decreto del presidente della repubblica": r"decreto\s+del\s+presidente\s+della\s+repubblica|d\.\s?p\.\s?r\.?|dpr", "regio decreto": r"regio\s+decreto|r\.\s?d\.", "legge": r"legge|l\.",
}
CODES = {
    "codice di procedura civile": r"c\.\s?p\.\s?c\.|cod\.\s?proc\.\s?civ\.|codice\s+di\s+procedura\s+civile", "codice di procedura penale": r"c\.\s?p\.\s?p\.|cod\.\s?proc\.\s?pen\.|codice\s+di\s+procedura\s+penale",
    "codice civile": r"c\.\s?c\.|cod\.\s?civ\.|codice\s+civile", "codice penale": r"c\.\s?p\.|cod\.\s?pen\.|codice\s+penale",
    "codice della navigazione fluviale": r"codice\s+della\s+navigazione\s+fluviale", "codice della navigazione lacustre": r"codice\s+della\s+navigazione\s+lacustre",
}
#: Any other code by its name, one noun long.
CODE = r"codice\s+(?:dell['’]\s?|(?:del|dello|della|dei|degli|delle)\s+)\p{L}+"
_DATE = r"[0-9]{1,2}°?\s+\p{L}+\.?\s+|[0-9]{1,2}[./-][0-9]{1,2}[./-]"
#: (number, year) of an act after its kind, or (year, number).
_DATED = [rf"(?:n\.?\s*)?([0-9]+)\s*[/-]\s*([0-9]{{4}})(?![0-9])", rf"n\.?\s*([0-9]+)\s+(?:del\s+)?(?:{_DATE})?([0-9]{{4}})(?![0-9])"]
_LAST = rf"(?:del\s+)?(?:{_DATE})([0-9]{{4}})\s*,?\s*n\.?\s*([0-9]+)"
_ACT = rf"(?:{'|'.join(ACTS.values())})\s*(?:{'|'.join([*_DATED, _LAST])})"
#: What counts as a citation part in a text, letter case aside; a form inside a word or a longer abbreviation is none.
MENTION = rf"(?i)(?<![\p{{L}}\p{{N}}.])(?:{_ARTICLES}|{_ACT}|(?:{'|'.join([*CODES.values(), CODE])}){_STOP})"


def plain_mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (``id_col``, pos, label, value) of the mentions of a text in order: ART numbers and DOC names."""
    m = df.select(F.col(id_col), F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(f"({PLAIN})"), 1)).alias("pos", "m"))
    art = F.col("m").rlike(r"^(articolo|art\.)")
    return m.select(id_col, "pos", F.when(art, "ART").otherwise("DOC").alias("label"), F.when(art, F.regexp_extract("m", r"([0-9]+(?:-bis)?)$", 1)).otherwise(F.regexp_replace(F.lower("m"), r"\s+", " ")).alias("value"))


def mentions(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (``id_col``, pos, label, value) of the mentions of a text in order: ART numbers, one for each of a list, and DOC names.

    Of a range of articles the first number comes out.
    """
    number = lambda n: F.regexp_replace(F.lower(n), rf"[-\s]?({_SUFFIX})$", "-$1")
    as_row = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))

    def parts(m: Column) -> Column:
        arts = F.regexp_extract_all(F.regexp_replace(m, f"(?i){_WITHIN}", ""), F.lit(f"(?i)({_NUMBER})"), 1)
        return F.when(m.rlike("(?i)^art"), F.transform(arts, lambda n: as_row("ART", number(n)))).otherwise(F.array(as_row("DOC", F.regexp_replace(F.lower(m), r"\s+", " "))))

    m = df.select(F.col(id_col), F.posexplode(F.flatten(F.transform(F.regexp_extract_all(F.col(text_col), F.lit(MENTION), 0), parts))).alias("pos", "m"))
    return m.select(id_col, "pos", "m.label", "m.value")


def pair(entities: DataFrame, key: str, order: list[str | Column], label: str = "label", value: str = "value") -> DataFrame:
    """Each ART with the last DOC before it in its text, else the next one, else dropped: (key, doc, article)."""
    w = Window.partitionBy(key).orderBy(*order)
    doc = F.when(F.col(label) == "DOC", F.col(value))
    before = F.last(doc, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first(doc, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return entities.withColumn("doc", F.coalesce(before, after)).where((F.col(label) == "ART") & F.col("doc").isNotNull()).select(*[c for c in entities.columns if c not in (label, value)], "doc", F.col(value).alias("article"))


def law_key(name: Column) -> Column:
    """A key under which cited and entered names of laws meet, '<kind> <number>/<year>' or the code; null where none can be told."""
    low = F.regexp_replace(F.trim(F.lower(name)), r"\s+", " ")
    # entered names may put the kind last or the year first
    low = F.regexp_replace(F.regexp_replace(low, r"^([0-9]+/[0-9]{4}) \((.+)\)$", "$2 $1"), r"^([0-9]{4}), (.+?) n\. ?([0-9]+)$", "$2 $3/$1")
    key = F.when(low.rlike(f"^(?:{CODE})$"), low)
    for code, forms in CODES.items():
        key = F.when(low.rlike(f"^(?:{forms})$"), code).otherwise(key)
    for kind, forms in ACTS.items():
        for form, (n, y) in ((_DATED[0], (1, 2)), (_DATED[1], (1, 2)), (_LAST, (2, 1))):
            whole = rf"^(?:{forms})\s*{form}\.?$"
            key = F.when(low.rlike(whole), F.concat(F.lit(f"{kind} "), F.regexp_extract(low, whole, n), F.lit("/"), F.regexp_extract(low, whole, y))).otherwise(key)
    return key


def related_edges(resolved: DataFrame, src: str, dst: str, text: str | None = None, order: list[str] | None = None, kind: str = "extensional") -> DataFrame:
    """One edge for each (source, target); with a text the one that is last by ``order`` stays."""
    e = resolved.where(F.col(src).isNotNull() & F.col(dst).isNotNull())
    if text is None:
        return e.select(F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), F.lit(None).cast("string").alias("text"), F.lit(kind).alias("kind")).distinct()
    return e.groupBy(F.col(src).alias("src_id"), F.col(dst).alias("dst_id")).agg(F.max_by(text, F.struct(*(order or [text]))).alias("text")).withColumn("kind", F.lit(kind))


def relation_counts(edges: DataFrame, src: str = "src_id", dst: str = "dst_id") -> DataFrame:
    """One row: each edge counted from both ends (a loop once), and edges counted once."""
    return edges.agg(F.sum(F.when(F.col(src) == F.col(dst), 1).otherwise(2)).cast("bigint").alias("undirected"), F.count(F.lit(1)).alias("directed"))


#: What finds the mentions of a table of texts: (df, id_col, text_col) -> (id_col, pos, label, value).
Recogniser = Callable[[DataFrame, str, str], DataFrame]


def recogniser(provider: Callable[[], Callable[[list[str]], list[list[tuple[str, str]]]]]) -> Recogniser:
    """A recogniser of mentions from a model: ``provider`` makes it once a task, it takes texts and gives the (label, value) of each in order."""

    def find(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
        @F.pandas_udf("array<struct<label:string,value:string>>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            model = provider()
            for s in batches:
                yield pd.Series([[{"label": a, "value": b} for a, b in found] for found in recognised(model, [x if isinstance(x, str) else "" for x in s])])

        return df.select(id_col, F.posexplode(run(F.col(text_col))).alias("pos", "m")).select(id_col, "pos", "m.label", "m.value")

    return find


def recognised(model: Callable[[list[str]], list[list[tuple[str, str]]]], texts: list[str]) -> list[list[tuple[str, str]]]:
    """The mentions of a batch of texts; no texts, no mentions, and the model is not asked."""
    return model(texts) if texts else []


def cited(nodes: DataFrame, find: Recogniser = mentions) -> DataFrame:
    """Rows (node_id, pos, doc, article) of the citations in the contents."""
    return pair(find(nodes.where("label = 'contenuto' AND trim(contenuto) <> ''"), "node_id", "contenuto"), "node_id", ["pos"])


def resolution(nodes: DataFrame, documents: DataFrame, find: Recogniser = mentions, by: str = "key") -> tuple[DataFrame, DataFrame]:
    """(pairs, resolved) of all citations in the contents: (node_id, doc_key, number) and, once for each (doc_key, number), its law and article or nulls.

    ``by`` key: laws meet under ``law_key``. ``by`` name: the law whose name holds the citation as a phrase, of the best
    score above the threshold; the citation as written is then its key.
    """
    from lexweave.operators import law

    if by == "name":
        pairs = cited(nodes, find).select("node_id", F.col("doc").alias("doc_key"), F.col("article").alias("number"))
        pairs = checkpointed(pairs)
        return pairs, law.resolve(pairs, law.best_documents(pairs.select(F.col("doc_key").alias("name")), documents).withColumnRenamed("name", "doc_key"), nodes)
    pairs = cited(nodes, find).select("node_id", law_key(F.col("doc")).alias("doc_key"), F.col("article").alias("number")).where("doc_key IS NOT NULL")
    return pairs, law.resolve(pairs, documents.withColumn("doc_key", law_key(F.col("nome_legge"))), nodes)


def cluster(nodes: DataFrame, documents: DataFrame, find: Recogniser = mentions, by: str = "key", undirected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(edges, counts) of all citations in the contents: mentions, pairs, one resolution of the distinct pairs, edges.

    ``counts`` has, beside the edges counted from both ends and once, the accepted pairs. ``undirected`` keeps one edge for both directions.
    """
    pairs, resolved = resolution(nodes, documents, find, by)
    found = resolved.where("node_id IS NOT NULL").withColumnRenamed("node_id", "target")
    accepted = checkpointed(pairs.join(found, ["doc_key", "number"]).select("node_id", "target"))
    ends = accepted.select(F.least("node_id", "target").alias("node_id"), F.greatest("node_id", "target").alias("target")) if undirected else accepted
    edges = related_edges(ends, "node_id", "target")
    return edges, relation_counts(edges).crossJoin(F.broadcast(accepted.agg(F.count(F.lit(1)).alias("accepted"))))  # single rows


def intensional(commentary: DataFrame, nodes: DataFrame, documents: DataFrame, source_law: str = "Codice Civile") -> DataFrame:
    """Edges from the article a comment is on (of ``source_law``) to those it cites, with the comment as text.

    ``commentary``: file, line_no, article_number, text. Of several comments the last by file and line stays.
    """
    from lexweave.operators import law

    c = commentary.where("article_number IS NOT NULL AND text IS NOT NULL").withColumn("key", F.concat_ws("\x1f", "file", F.col("line_no").cast("string")))
    src = law.articles(nodes, law.law_filter(documents, source_law)).groupBy("number").agg(F.min("node_id").alias("src"))
    c = c.join(src, F.col("article_number").cast("string") == F.col("number")).drop("number")
    pairs = pair(mentions(c, "key", "text"), "key", ["pos"]).select("key", law_key(F.col("doc")).alias("doc_key"), F.col("article").alias("number")).where("doc_key IS NOT NULL")
    found = law.resolve(pairs, documents.withColumn("doc_key", law_key(F.col("nome_legge"))), nodes).where("node_id IS NOT NULL").withColumnRenamed("node_id", "dst")
    return related_edges(pairs.join(found, ["doc_key", "number"]).join(c, "key"), "src", "dst", "text", ["file", "line_no"], "intensional")
