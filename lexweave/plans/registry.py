"""Named queries over the test tables and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexweave.functions import entities, statutes
from lexweave.functions import text as tx
from lexweave.functions import vectors as vec
from lexweave.operators import fulltext, graph, law, quality, relations, search
from lexweave.plans import sql
from lexweave.session import table
from lexweave.sources import corpus

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

#: Parameters of the queries below; plans/sql.py has the same.
TERMS, PHRASE, NEEDLE, LAW = "ricorso notificata canone", "illuminazione pubblica", "servitù di passaggio", "Codice della navigazione lacustre"
CATEGORY, SCOPE = "PERSONA", 3


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def r6(c):
    return F.round(c, 6)


def query_vector(spark: SparkSession, d: str) -> list[float]:
    """The vector of vec_id 0: the query of the examples."""
    return [float(x) for x in table(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


def chunk_query(spark: SparkSession, d: str) -> list[float]:
    """The usable vector of the least chunk id."""
    c = table(spark, d, "chunk")
    return [float(x) for x in c.where(vec.vector_status(F.col("embedding")) == "ok").orderBy("chunk_id").select("embedding").first()[0]]


def largest_document(spark: SparkSession, d: str) -> str:
    return table(spark, d, "chunk").groupBy("name").count().orderBy(F.desc("count"), "name").first()["name"]


def knowledge(spark: SparkSession, d: str) -> search.Graph:
    return search.Graph(table(spark, d, "chunk"), table(spark, d, "entity"), table(spark, d, "has_entity"), nodes=table(spark, d, "kb_node"))


# ---------------------------------------------------------------- vectors


@query
def vector_topk(spark, d):
    top = search.vector_top(table(spark, d, "chunk").select("chunk_id", "name", "text", "embedding"), chunk_query(spark, d))
    return top.orderBy(F.desc("score"), "chunk_id").limit(5).select("chunk_id", F.col("name").alias("source"), r6("score").alias("similarity"))


@query
def vector_topk_doc_scoped(spark, d):
    top = search.vector_top(table(spark, d, "embeddings"), query_vector(spark, d), 50, "vec_id")
    return top.where(F.col("label") == SCOPE).orderBy(F.desc("score"), "vec_id").limit(5).select("vec_id", r6("score").alias("similarity"))


@query
def vector_scores_dim_check(spark, d):
    parts = [quality.vector_report(table(spark, d, t), "embedding").select(F.lit(t).alias("table_name"), "status", "rows") for t in ("chunk", "kb_node")]
    return parts[0].unionByName(parts[1])


@query
def mean_pool(spark, d):
    return vec.mean_vectors(table(spark, d, "embeddings"), "label", "embedding").select("label", "dim", r6("mean").alias("mean"))


@query
def masked_mean_pool(spark, d):
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("dim", "v")).withColumn("m", (F.col("v") > 0).cast("int"))
    return vec.masked_mean(long, ["label", "dim"], "v", "m").select("label", "dim", r6("pooled").alias("pooled"))


@query
def logits_argmax(spark, d):
    return table(spark, d, "embeddings").select("vec_id", vec.argmax(F.col("embedding")).cast("int").alias("cls"))


# ---------------------------------------------------------------- texts and chunks


@query
def chunk_documents(spark, d):
    return tx.chunk_documents(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "idx", "text")


@query
def sentence_split(spark, d):
    return table(spark, d, "kb_node").select("node_id", F.posexplode(tx.sentence_array(F.col("contenuto"))).alias("pos", "sentence"))


@query
def word_tokens(spark, d):
    return table(spark, d, "kb_node").select("node_id", F.array_join(tx.words(F.col("rubrica"), 3), " ").alias("words"))


@query
def chunk_neighbors(spark, d):
    c = graph.with_neighbours(table(spark, d, "chunk").select("chunk_id", "name", "idx", "text"))
    return c.select("chunk_id", F.array_join("prev_chunks", "|").alias("prev_chunks"), F.array_join("next_chunks", "|").alias("next_chunks"))


@query
def chunk_next_pairs(spark, d):
    return graph.next_edges(table(spark, d, "chunk"))


@query
def fulltext_bm25(spark, d):
    s = fulltext.search(table(spark, d, "chunk"), "chunk_id", "text", TERMS)
    return s.select("chunk_id", r6("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(20)


@query
def fulltext_doc_scoped(spark, d):
    c = table(spark, d, "chunk")
    s = fulltext.search(c, "chunk_id", "text", TERMS).join(c.where(F.col("name") == largest_document(spark, d)).select("chunk_id"), "chunk_id", "left_semi")
    return s.select("chunk_id", r6("score").alias("score")).orderBy(F.desc("score"), "chunk_id").limit(5)


@query
def fulltext_postings(spark, d):
    p = fulltext.postings(table(spark, d, "law_ref"), "ref_id", "nome_legge")
    return p.select("term", F.col("id").alias("ref_id"), "tf", "len")


@query
def fulltext_postings_chunks(spark, d):
    return fulltext.postings(table(spark, d, "chunk"), "chunk_id", "text").withColumnRenamed("id", "chunk_id")


@query
def text_contains(spark, d):
    return fulltext.contains(table(spark, d, "chunk"), "text", NEEDLE).select("chunk_id", "name")


@query
def phrase_match_top1(spark, d):
    return law.best_document(table(spark, d, "law_ref").withColumnRenamed("ref_id", "kb_id"), PHRASE).select("kb_id", r6("score").alias("score"))


@query
def phrase_match_documents(spark, d):
    return law.best_document(table(spark, d, "kb_document"), PHRASE).select("kb_id", r6("score").alias("score"))


# ---------------------------------------------------------------- graph


@query
def entity_upsert(spark, d):
    return graph.upsert(table(spark, d, "entity").select("text", "label"), ["text", "label"])


@query
def has_entity_edges(spark, d):
    return graph.upsert(table(spark, d, "has_entity"), ["chunk_id", "entity_id"])


@query
def merge_upsert_documents(spark, d):
    docs = table(spark, d, "documents").select("text", "doc_id", "source")
    old = docs.where("source = 'leggi'").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.lit("leggi").alias("source"))
    merged = graph.upsert(docs, ["text"], old.where("text IS NOT NULL"), ["doc_id"])
    return merged.select("doc_id", F.length("text").alias("n"), "source")


@query
def entities_collect(spark, d):
    e = graph.entities_of(table(spark, d, "has_entity"), table(spark, d, "entity"))
    return e.select("chunk_id", F.array_join(F.transform("entities", lambda x: F.concat_ws("/", x["text"], x["label"])), "|").alias("entities"))


@query
def optional_match_nulls(spark, d):
    e = graph.entities_of(table(spark, d, "has_entity"), table(spark, d, "entity"), table(spark, d, "chunk"))
    return e.select("chunk_id", F.size("entities").alias("n"), F.exists("entities", lambda x: x["text"].isNull()).alias("none"))


@query
def category_search(spark, d):
    h = search.by_category(knowledge(spark, d), CATEGORY)
    ents = F.array_join(F.transform("entities", lambda x: F.concat_ws("/", x["text"], x["label"])), "|")
    return h.select("chunk_id", "source", "similarity", ents.alias("entities"))


@query
def category_search_doc_scoped(spark, d):
    h = search.by_category(knowledge(spark, d), CATEGORY, largest_document(spark, d))
    return h.select("chunk_id", "source", "similarity", F.size("entities").alias("n_entities"))


@query
def search_with_context(spark, d):
    h = search.by_vector(knowledge(spark, d), chunk_query(spark, d))
    ents = F.array_join(F.transform("entities", lambda x: F.concat_ws("/", x["text"], x["label"])), "|")
    return h.select("chunk_id", "source", r6("similarity").alias("similarity"), F.array_join("prev_chunks", "|").alias("prev_chunks"), F.array_join("next_chunks", "|").alias("next_chunks"), ents.alias("entities"), F.size("related").alias("n_related"))


@query
def text_search_with_context(spark, d):
    h = search.by_text(knowledge(spark, d), TERMS)
    return h.select("chunk_id", "source", r6("similarity").alias("similarity"), F.array_join("prev_chunks", "|").alias("prev_chunks"), F.array_join("next_chunks", "|").alias("next_chunks"), F.size("entities").alias("n_entities"))


@query
def related_context(spark, d):
    """A text search whose hits are related to articles: cited numbers, folded into 1 to 40, stand for the articles of that number."""
    nodes = table(spark, d, "kb_node")
    number = (F.regexp_extract("value", "^[0-9]+", 0).cast("int") % 40 + 1).cast("string")
    cited = relations.plain_mentions(table(spark, d, "chunk"), "chunk_id", "text").where("label = 'ART'").select("chunk_id", number.alias("number"))
    target = nodes.where("label = 'contenuto'").select(law.article_number(F.col("titolo")).alias("number"), "node_id").where("number IS NOT NULL").groupBy("number").agg(F.min("node_id").alias("node_id"))
    g = knowledge(spark, d)
    g.related = relations.related_edges(cited.join(target, "number"), "chunk_id", "node_id")
    hits = search.by_text(g, "codice articolo navigazione", limit=20)
    return hits.select("chunk_id", F.size("related").alias("n_related"), F.array_join(F.transform("related", lambda r: r["text"]), "|").alias("related"))


@query
def bfs_descend_faithful(spark, d):
    nodes = table(spark, d, "kb_node")
    scored = law.scored_nodes(nodes, query_vector(spark, d))
    return law.best_children(scored, faithful=True).select("parent_id", "node_id", r6("score").alias("score"))


@query
def hierarchy_descendants(spark, d):
    return graph.descendants(table(spark, d, "kb_node"))


@query
def leaf_nodes(spark, d):
    return graph.leaves(table(spark, d, "kb_node")).select("node_id", "label")


@query
def kb_json_flatten(spark, d):
    """The nodes of each law written as one nested JSON object and read back."""
    n = table(spark, d, "kb_node")
    kids = lambda label: F.transform(F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("node_id", "titolo", "rubrica")))), lambda x: F.struct(x["titolo"].alias("titolo"), x["rubrica"].alias("rubrica")))
    laws = n.groupBy("kb_id").agg(kids("parti").alias("parti"), kids("contenuto").alias("contenuto")).join(table(spark, d, "kb_document"), "kb_id")
    body = F.to_json(F.struct(F.struct("nome_legge", "anno", "parti", "contenuto").alias("Document")))
    nodes = corpus.nodes_of(laws.select(F.col("kb_id").cast("string").alias("name"), body.alias("text")))
    roots = nodes.where("label = 'Document'").select(F.col("node_id").alias("parent_id"), F.col("props")["anno"].cast("int").alias("anno"))
    return nodes.join(roots, "parent_id").select("nome_legge", "anno", "label", "titolo", "rubrica", "child_pos", "depth")


@query
def label_scan_filter(spark, d):
    return table(spark, d, "kb_node").where("label = 'contenuto' AND contenuto IS NOT NULL").select("node_id", "titolo")


@query
def unique_constraint_check(spark, d):
    return quality.uniqueness({t: table(spark, d, t) for t in quality.KEYS})


# ---------------------------------------------------------------- law corpus


@query
def article_title_match(spark, d):
    n = table(spark, d, "kb_node").withColumn("number", law.article_number(F.col("titolo")))
    return n.where("number IS NOT NULL").select("node_id", "number")


@query
def article_lookup_top1(spark, d):
    return law.lookup(table(spark, d, "kb_node"), table(spark, d, "kb_document"), "5")


@query
def law_filter_optional(spark, d):
    docs = table(spark, d, "kb_document")
    parts = [law.law_filter(docs, x).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(x or "").alias("law"), "rows") for x in (None, "", LAW)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query
def start_nodes_union(spark, d):
    return law.start_nodes(table(spark, d, "kb_node"), table(spark, d, "kb_document"))


@query
def best_child_per_node(spark, d):
    return law.best_children(law.scored_nodes(table(spark, d, "kb_node"), query_vector(spark, d))).select("parent_id", "node_id", r6("score").alias("score"))


@query
def bfs_descend(spark, d):
    nodes = table(spark, d, "kb_node")
    walk = law.descend(law.start_nodes(nodes, table(spark, d, "kb_document")), law.best_children(law.scored_nodes(nodes, query_vector(spark, d))))
    return walk.select("step", "start_id", "node_id", r6("score").alias("score"))


@query
def wide_search(spark, d):
    w = law.wide_search(table(spark, d, "kb_node"), table(spark, d, "kb_document"), query_vector(spark, d), TERMS)
    return w.select("strategy", "source", "titolo", "contenuto", r6("similarity").alias("similarity"))


@query
def visited_antijoin(spark, d):
    nodes = table(spark, d, "kb_node")
    seen = law.start_nodes(nodes, table(spark, d, "kb_document"))
    return nodes.join(seen, "node_id", "left_anti").select("node_id")


# ---------------------------------------------------------------- citations


def _pairs(spark, d):
    body = table(spark, d, "kb_node").where("label = 'contenuto' AND trim(contenuto) <> ''")
    return relations.pair(relations.plain_mentions(body, "node_id", "contenuto"), "node_id", ["pos"])


@query
def citation_mentions(spark, d):
    return relations.plain_mentions(table(spark, d, "chunk"), "chunk_id", "text")


@query
def citation_pairing(spark, d):
    return _pairs(spark, d)


def _resolved(spark, d):
    # The test corpus cites laws and articles it does not hold. So that edges come out, cited laws are folded into ten
    # keys, of which each stands for one law with articles, and cited numbers into 1 to 40.
    key, number = relations.law_key(F.col("doc")), (F.regexp_extract("article", "^[0-9]+", 0).cast("int") % 40 + 1).cast("string")
    pairs = _pairs(spark, d).select("node_id", (F.length(key) % 10).cast("string").alias("doc_key"), number.alias("number")).where("doc_key IS NOT NULL")
    nodes = table(spark, d, "kb_node")
    docs = nodes.select("kb_id").distinct().withColumn("doc_key", (F.col("kb_id") % 10).cast("string"))
    return pairs, law.resolve(pairs, docs, nodes)


@query
def citation_keys(spark, d):
    return _pairs(spark, d).select("node_id", "pos", relations.law_key(F.col("doc")).alias("doc_key"), "article")


@query
def citation_resolution(spark, d):
    return _resolved(spark, d)[1]


@query
def related_edges_dedup(spark, d):
    pairs, found = _resolved(spark, d)
    found = found.where("node_id IS NOT NULL").withColumnRenamed("node_id", "target")
    return relations.related_edges(pairs.join(found, ["doc_key", "number"]), "node_id", "target").select("src_id", "dst_id", "kind")


@query
def citation_mentions_whole(spark, d):
    return relations.mentions(table(spark, d, "chunk"), "chunk_id", "text")


@query
def citation_pairing_whole(spark, d):
    return relations.cited(table(spark, d, "kb_node"))


@query
def citation_keys_whole(spark, d):
    return relations.cited(table(spark, d, "kb_node")).select("node_id", "pos", relations.law_key(F.col("doc")).alias("doc_key"), "article")


@query
def citation_resolution_whole(spark, d):
    """Every cited (law, article) under its own key against the names of kb_document, unresolved ones included."""
    return relations.resolution(table(spark, d, "kb_node"), table(spark, d, "kb_document"))[1]


@query
def related_edges_whole(spark, d):
    return relations.cluster(table(spark, d, "kb_node"), table(spark, d, "kb_document"))[0].select("src_id", "dst_id", "kind")


@query
def citation_resolution_names(spark, d):
    """Every cited (law, article) by the best law whose name holds the citation as a phrase, unresolved ones included."""
    return relations.resolution(table(spark, d, "kb_node"), table(spark, d, "kb_document"), relations.plain_mentions, "name")[1]


@query
def cluster_counts(spark, d):
    return relations.cluster(table(spark, d, "kb_node"), table(spark, d, "kb_document"), relations.plain_mentions, "name")[1]


@query
def related_edges_names(spark, d):
    return relations.cluster(table(spark, d, "kb_node"), table(spark, d, "kb_document"), relations.plain_mentions, "name")[0].select("src_id", "dst_id", "kind")


@query
def related_last_write(spark, d):
    e = table(spark, d, "events").withColumn("dst", (F.col("user_id") % 7).cast("string"))
    out = relations.related_edges(e.withColumn("src", F.col("user_id").cast("string")), "src", "dst", "event_type", ["ts", "event_id"], "intensional")
    return out.select("src_id", "dst_id", "text")


@query
def related_undirected_count(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("src_id"), (F.col("user_id") % 7).alias("dst_id")).distinct()
    return relations.relation_counts(e)


# ---------------------------------------------------------------- statutory texts

_HEADED = "concat('TITOLO II', chr(10), 'Parte generale', chr(10), chr(10), 'Art. 2-bis Oggetto', chr(10), contenuto)"


def _laws(spark, d):
    return table(spark, d, "documents").where("text IS NOT NULL").select("doc_id", "text")


@query
def section_classify(spark, d):
    lines = table(spark, d, "kb_node").where("contenuto IS NOT NULL").select("node_id", F.posexplode(F.split(F.expr(_HEADED), "\n")).alias("line_no", "line"))
    return lines.select("node_id", "line_no", statutes.section_kind(F.col("line")).alias("kind"))


@query
def section_carry_forward(spark, d):
    rows = table(spark, d, "kb_node").where("contenuto IS NOT NULL").select("node_id", F.expr(_HEADED).alias("t"))
    return statutes.lines_of(rows, "node_id", "t").select(F.col("id").alias("node_id"), "line_no", "section")


@query
def paragraph_groups(spark, d):
    lines = statutes.lines_of(_laws(spark, d), "doc_id", "text").where(~F.col("blank"))
    return lines.groupBy("id", "paragraph").agg(F.count(F.lit(1)).alias("lines"), F.min("line_no").alias("first_line")).withColumnRenamed("id", "doc_id")


@query
def clean_whitespace(spark, d):
    return _laws(spark, d).select("doc_id", statutes.collapsed(F.col("text")).alias("clean"))


@query
def strip_note_markers(spark, d):
    return _laws(spark, d).select("doc_id", statutes.without_note_markers(F.col("text")).alias("clean"))


@query
def clean_structured(spark, d):
    return statutes.cleaned(_laws(spark, d), "doc_id", "text")


# ---------------------------------------------------------------- agent


@query
def api_call_extract(spark, d):
    call = F.concat(F.lit("penso <api>search_by_text('"), F.col("name"), F.lit("', '"), F.coalesce("tag", F.lit("")), F.lit("')</api> poi <api>ignota('x')</api><api>wide_article('"), F.col("chunk_id"), F.lit("','y')</api>"))
    rows = table(spark, d, "chunk").select("chunk_id", F.posexplode(tx.tool_calls(call)).alias("pos", "c"))
    return rows.select("chunk_id", "pos", "c.func", "c.arg1", "c.arg2")


@query
def end_querying_answers(spark, d):
    """The final answer of a response, whatever else it calls, with its references to characters resolved."""
    said = F.concat(F.lit("penso <api>search_article('5')</api> e <api>end_querying(Il saldo di "), F.col("name"), F.lit(" &egrave; 5 (cinque) &amp; basta.)</api>"))
    rows = table(spark, d, "chunk").select("chunk_id", F.posexplode(tx.tool_calls(said)).alias("pos", "c"))
    return rows.where("c.func = 'end_querying'").select("chunk_id", "pos", tx.html_unescape(F.col("c.arg1")).alias("answer"))


@query
def agent_contexts(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return table(spark, d, "events").select("event_id", F.array_join(F.collect_list("event_type").over(w), ">").alias("contexts"))


@query
def last_turn_answer(spark, d):
    return table(spark, d, "chunk").groupBy("name").agg(F.max_by("chunk_id", "idx").alias("chunk_id"), F.max("idx").alias("idx"))


@query
def coalesce_embed_text(spark, d):
    n = corpus.with_embeddings(table(spark, d, "kb_node").drop("embedding"))
    return n.where("embedding IS NOT NULL").select("node_id", F.size("embedding").alias("n"))


# ---------------------------------------------------------------- operators without SQL


@query
def embed_hash_documents(spark, d):
    return table(spark, d, "documents").select("doc_id", vec.embed(F.col("text")).alias("embedding"))


@query
def extract_entities_udf(spark, d):
    return table(spark, d, "chunk").select("chunk_id", F.explode(entities.extract(F.col("text"))).alias("e")).select("chunk_id", "e.text", "e.label")


@query
def html_unescape_udf(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.html_unescape(F.col("text")).alias("text"))


@query
def intensional_relations(spark, d):
    """Comments made from the chunks, on and about the articles of the law that has most nodes."""
    nodes = table(spark, d, "kb_node")
    first = nodes.groupBy("kb_id").count().orderBy(F.desc("count"), "kb_id").limit(1).select(F.col("kb_id").alias("first"))
    docs = nodes.select("kb_id").distinct().crossJoin(F.broadcast(first)).select("kb_id", F.when(F.col("kb_id") == F.col("first"), LAW).otherwise("altra").alias("nome_legge"))
    number = lambda k: (F.col("idx") * k % 40 + 1).cast("string")
    comments = table(spark, d, "chunk").select(F.col("name").alias("file"), F.col("idx").alias("line_no"), number(1).alias("article_number"), F.concat(F.lit("cfr. art. "), number(7), F.lit(" del "), F.lower(F.lit(LAW)), F.lit(": "), F.col("chunk_id")).alias("text"))
    return relations.intensional(comments, nodes, docs, LAW)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return {k: v for k, v in sql.ORACLE.items() if k in _QUERIES}
