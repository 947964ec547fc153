import json

import pytest
from pyspark.sql import functions as F

from lexweave.operators import agent, fulltext, graph, law, quality, relations, search
from lexweave.sources import corpus, readers

TREE = {"Document": {"nome_legge": "Codice Civile", "anno": 1942, "tags": ["a", "b"], "parti": [{"rubrica": "Delle persone", "contenuto": [
    {"titolo": "TITOLO I", "contenuto": [{"titolo": "Art. 1", "rubrica": "Capacita'", "contenuto": "testo uno"}, {"titolo": "Articolo 2", "contenuto": "testo due"}]}]}]}}


@pytest.fixture(scope="module")
def law_tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("kb")
    (folder / "cc.json").write_text(json.dumps(TREE))
    (folder / "bad.json").write_text("{no json")
    (folder / "x.json").write_text(json.dumps({"parti": [{"rubrica": "r"}]}))
    nodes = corpus.read_corpus(spark, str(folder)).cache()
    docs = nodes.where("label = 'Document'").select(F.col("doc_id").alias("kb_id"), "nome_legge")
    n = nodes.where("label <> 'Document'").withColumn("kb_id", F.col("doc_id"))
    return nodes, n, docs


def test_corpus(spark, law_tables):
    nodes, _, docs = law_tables
    rows = nodes.where("nome_legge = 'Codice Civile'").collect()
    assert sorted((r.label, r.titolo, r.contenuto) for r in rows if r.label == "contenuto") == [("contenuto", "Art. 1", "testo uno"), ("contenuto", "Articolo 2", "testo due"), ("contenuto", "TITOLO I", None)]
    root = next(r for r in rows if r.label == "Document")
    assert root.props["anno"] == "1942" and "tags" not in root.props and root.parent_id is None
    assert corpus.edges_of(nodes).count() == 5 and {r.nome_legge for r in docs.collect()} == {"Codice Civile", "Unknown"}
    assert sorted(r.depth for r in graph.descendants(nodes).where(F.col("ancestor_id") == root.node_id).collect()) == [1, 2, 3, 3]
    assert {r.titolo for r in graph.leaves(nodes).where("label = 'contenuto'").collect()} == {"Art. 1", "Articolo 2"}
    again = corpus.with_embeddings(nodes)
    assert again.where("label = 'contenuto' AND embedding IS NULL").count() == 1


def test_lookup(law_tables):
    _, n, docs = law_tables
    got = lambda *a: [r.titolo for r in law.lookup(n, docs, *a).collect()]
    assert got("1", "Codice Civile") == got("1") == got("1", " ") == ["Art. 1"] and got("9") == [] and got("1", "Altro") == []


def test_descent(spark, law_tables):
    _, n, docs = law_tables
    ids = {r.titolo: r.node_id for r in n.where("titolo IS NOT NULL").collect()}
    scores = spark.createDataFrame([(ids["TITOLO I"], 0.9), (ids["Art. 1"], 0.6), (ids["Articolo 2"], 0.7)], "node_id string, score double")
    best = law.best_children(n.join(scores, "node_id").withColumn("source", F.lit("s")))
    assert [r.titolo for r in law.descend(law.start_nodes(n, docs), best).collect()] == ["Articolo 2"]
    assert law.descend(law.start_nodes(n, docs, "Nessuna"), best).count() == 0
    scored = n.join(scores, "node_id").withColumn("source", F.lit("s"))
    assert law.descend(law.start_nodes(n, docs), law.best_children(scored, faithful=True)).count() == 0
    lower = scored.withColumn("score", F.when(F.col("titolo") == "TITOLO I", 0.5).otherwise(F.col("score")))
    assert [r.titolo for r in law.descend(law.start_nodes(n, docs), law.best_children(lower, faithful=True)).collect()] == ["Articolo 2"]


def test_related_are_contents(spark, small):
    _, g = small
    nodes = spark.createDataFrame([("x", "contenuto", "detto"), ("y", "parti", "no"), ("z", "contenuto", None)], "node_id string, label string, contenuto string")
    first = g.chunks.where("name = 'd.pdf' AND idx = 0").first().chunk_id
    related = spark.createDataFrame([(first, t, None, "extensional") for t in "xyzx"], "src_id string, dst_id string, text string, kind string")
    hits = search.by_text(search.Graph(g.chunks, g.entities, g.has_entity, related, nodes), "giudice").collect()
    assert [[r.text for r in h.related] for h in hits] == [["detto", ""]]


def test_pairing(spark):
    rows = [("1", p, l, v) for p, (l, v) in enumerate([("ART", "5"), ("DOC", "X"), ("ART", "6"), ("DOC", "Y"), ("ART", "7")])]
    rows += [("2", 0, "ART", "9")] + [("3", p, l, v) for p, (l, v) in enumerate([("DOC", "X"), ("ART", "1"), ("ART", "2")])]
    rows += [("4", p, l, v) for p, (l, v) in enumerate([("ART", "1"), ("ART", "2"), ("DOC", "Z")])] + [("5", p, l, v) for p, (l, v) in enumerate([("DOC", "X"), ("DOC", "Y"), ("ART", "3")])]
    df = spark.createDataFrame(rows, "t string, pos int, label string, value string")
    got = sorted((r.t, r.doc, r.article) for r in relations.pair(df, "t", ["pos"]).collect())
    assert got == [("1", "X", "5"), ("1", "X", "6"), ("1", "Y", "7"), ("3", "X", "1"), ("3", "X", "2"), ("4", "Z", "1"), ("4", "Z", "2"), ("5", "Y", "3")]


def test_cluster_and_intensional(spark):
    nodes = spark.createDataFrame(
        [("n1", 1, None, "contenuto", "Art. 1", "Vedi art. 2 del codice della navigazione lacustre e l'art. 9 della L. 5/2001."), ("n2", 1, None, "contenuto", "Articolo 2", "niente"), ("n3", 2, None, "contenuto", "Art. 9", "art. 9 L. 5/2001")],
        "node_id string, kb_id long, parent_id string, label string, titolo string, contenuto string",
    ).withColumn("rubrica", F.lit(None).cast("string"))
    docs = spark.createDataFrame([(1, "Codice della navigazione lacustre"), (2, "Legge 3 marzo 2001, n. 5"), (3, None)], "kb_id long, nome_legge string")
    edges, counts = relations.cluster(nodes, docs)
    # a law once named stays: article 9 is paired with the code before it, where there is none
    assert {(r.src_id, r.dst_id) for r in edges.collect()} == {("n1", "n2"), ("n3", "n3")}
    assert tuple(counts.first()) == (3, 2, 2)
    comments = spark.createDataFrame([("a", 1, "1", "cfr. art. 9 L. 5/2001 vecchio"), ("b", 1, "1", "cfr. art. 9 L. 5/2001 nuovo"), ("b", 2, None, "x")], "file string, line_no int, article_number string, text string")
    got = relations.intensional(comments, nodes, docs, "Codice della navigazione lacustre").collect()
    assert [tuple(r) for r in got] == [("n1", "n3", "cfr. art. 9 L. 5/2001 nuovo", "intensional")]
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "c")], "src_id string, dst_id string")
    assert tuple(relations.relation_counts(e).first()) == (5, 3)


@pytest.fixture(scope="module")
def small(spark):
    docs = spark.createDataFrame([("d.pdf", "Il canone n. 1 è dovuto. Il giudice decide. Il 3 maggio 2001 scade. Quattro. Cinque canone."), ("e", "altro testo.")], "name string, text string")
    t = graph.ingest_documents(docs)
    related = t["chunks"].where("name = 'd.pdf' AND idx = 0").select(F.col("chunk_id").alias("src_id"), F.lit("x").alias("dst_id"), F.lit("commento").alias("text"), F.lit("intensional").alias("kind"))
    return t, search.Graph(t["chunks"].cache(), t["entities"].cache(), t["has_entity"].cache(), related)


def test_ingest_and_search(spark, small):
    t, g = small
    assert t["documents"].count() == 2 and g.chunks.count() == 4 and g.chunks.where("NOT embedding_ok").count() == 0
    hits = search.by_text(g, "CANONE").collect()
    assert [h.source for h in hits] == ["d.pdf", "d.pdf"] and hits[0].similarity >= hits[1].similarity
    by = {h.text: h for h in hits}
    first = by["Il canone n. 1 è dovuto. Il giudice decide."]
    assert first.prev_chunks == [] and first.next_chunks == ["Il 3 maggio 2001 scade. Quattro."] and [r.text for r in first.related] == ["commento"]
    assert by["Cinque canone."].prev_chunks == ["Il 3 maggio 2001 scade. Quattro."] and by["Cinque canone."].next_chunks == []
    assert [h.source for h in search.by_text(g, "altro", "d.pdf").collect()] == []
    assert len(search.by_text(g, "IL GIUDICE", mode="contains").collect()) == 1
    cat = search.by_category(g, "DATA").collect()
    assert [(h.similarity, [tuple(e) for e in h.entities]) for h in cat] == [(1.0, [("3 maggio 2001", "data")])]
    q = [float(x) for x in g.chunks.where("name = 'e'").first().embedding]
    assert search.by_vector(g, q).first().text == "altro testo." and search.by_vector(g, q, "d.pdf", candidates=1).count() == 0
    assert len({tuple(r) for r in graph.next_edges(g.chunks).collect()}) == 4


def test_adjacent_over_spans(spark, monkeypatch):
    monkeypatch.setattr(graph, "SPAN", 3)
    rows = [("a", i, f"a{i}") for i in range(10) if i != 4] + [("b", 7, "b7")]
    df = spark.createDataFrame(rows, "name string, idx int, text string")
    got = {r.text: (r.prev.text if r.prev else None, r.next.text if r.next else None) for r in graph.with_adjacent(df, ["text"]).collect()}
    a = [r[2] for r in rows if r[0] == "a"]
    want = {x: (a[i - 1] if i else None, a[i + 1] if i + 1 < len(a) else None) for i, x in enumerate(a)} | {"b7": (None, None)}
    assert got == want


def test_stored_index(spark, tmp_path):
    df = spark.createDataFrame([(1, "Codice della strada"), (2, "codice penale della navigazione"), (3, None), (4, "strada strada"), (5, "illuminazione della pubblica via"), (6, "")], "id int, t string")
    fulltext.write_index(df, "id", "t", str(tmp_path))
    for query in ("strada codice", "della", "assente", "Strada assente"):
        want = {r.id: round(r.score, 9) for r in fulltext.search(df, "id", "t", query).collect()}
        assert {r.id: round(r.score, 9) for r in fulltext.search_index(spark, str(tmp_path), "id", query).collect()} == want


def test_fulltext(spark):
    df = spark.createDataFrame([(1, "Codice della strada"), (2, "codice penale della navigazione"), (3, None), (4, "strada"), (5, "illuminazione della pubblica via")], "id int, t string")
    assert [r.id for r in fulltext.search(df, "id", "t", "della strada", phrase=True).collect()] == [1]
    assert {r.id for r in fulltext.search(df, "id", "t", "strada").collect()} == {1, 4} and fulltext.search(df, "id", "t", " ,").count() == 0
    p = {(r.term, r.id): r.tf for r in fulltext.postings(df, "id", "t").collect()}
    assert p["strada", 1] == 1 and len(p) == 3 + 4 + 1 + 4
    d = df.select(F.col("id").alias("kb_id"), F.col("t").alias("nome_legge"))
    assert law.best_document(d, "della strada", 0.2).first().kb_id == 1 and law.best_document(d, "della strada", 9.0).count() == 0


def test_upsert_and_quality(spark):
    new = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 5)], "k string, v int")
    old = spark.createDataFrame([("b", 0), ("c", 9)], "k string, v int")
    assert sorted(map(tuple, graph.upsert(new, ["k"], old, ["v"]).collect())) == [("a", 1), ("b", 0), ("c", 9)]
    assert [tuple(r) for r in quality.violations(new, ["k"]).collect()] == [("a", 2)]


def test_agent(spark, small, law_tables, tmp_path):
    _, g = small
    _, n, docs = law_tables
    g = search.Graph(g.chunks, g.entities, g.has_entity, g.related, n.withColumn("embedding", F.lit(None).cast("array<float>")))
    said = iter(["<api>search_by_text('d.pdf','canone')</api> <api>search_article('1','Codice Civile')</api>", "<api>search_by_category('','data')</api><api>wide_article('testo due','')</api><api>end_querying(Il saldo &egrave; 5 (cinque).)</api><api>search_by_text('x','y')</api>"])
    a = agent.Session(g, docs, lambda prompt: next(said)).ask("Quanto?", ["d.pdf"])
    assert a.final_answer == "Il saldo è 5 (cinque)." and len(a.model_responses) == 2
    assert [c.func for c, _ in a.contexts] == ["search_by_text", "search_article", "search_by_category", "wide_search"]
    assert [len(r) for _, r in a.contexts] == [2, 1, 1, 1] and a.contexts[3][1][0].titolo == "Articolo 2"
    assert agent.Session(g, docs, lambda p: "niente").ask("?").final_answer is None
    out = str(tmp_path / "r")
    readers.append_results(agent.results(spark, [a]), out)
    readers.append_results(agent.results(spark, [a]), out)
    assert spark.read.json(out).count() == 2


def test_readers(spark, tmp_path):
    d = tmp_path / "d"
    d.mkdir()
    (d / "a.txt").write_bytes("perché".encode())
    (d / "b.txt").write_bytes("perché".encode("latin-1"))
    (d / "c.txt").write_text("  ")
    (d / "x.PDF").write_bytes(b"%PDF")
    docs, errors = readers.read_documents(spark, str(d))
    assert {r.name: r.text for r in docs.collect()} == {"a.txt": "perché", "b.txt": "perché"} and {r.name for r in errors.collect()} == {"c.txt", "x.PDF"}
    docs, _ = readers.read_documents(spark, str(d), "*.PDF", lambda b: b.decode())
    assert docs.first().text == "%PDF" and readers.file_names(spark, str(d)).count() == 4
    (d / "r.jsonl").write_text('{"article_number": "5", "text": "t"}\n{bad\n{"article_number": 6}\n\n{"article_number": 7, "text": "u"}')
    good, bad = readers.read_commentary(spark, str(d))
    assert sorted((r.article_number, r.text) for r in good.collect()) == [("5", "t"), ("7", "u")] and [r.line_no for r in bad.collect()] == [1]
    t = readers.read_statutes(spark, str(d))
    readers.write_statutes(t.select("file", F.col("text").alias("clean_text")).where("file = 'a.txt'"), str(tmp_path / "o"))
    assert [r.name for r in spark.read.text(str(tmp_path / "o")).select("name").collect()] == ["a_pulito"]
    (d / "c.yaml").write_text("limit: 7\nmodel: x\n")
    s = readers.load_settings(str(d / "c.yaml"))
    assert s.limit == 7 and s.iterations == 10 and s.extra["model"] == "x"


def test_stream(spark, tmp_path):
    from lexweave.streaming import ingest

    src, out, ck = tmp_path / "s", str(tmp_path / "out"), str(tmp_path / "ck")
    src.mkdir()
    (src / "a.txt").write_text("Uno. Due. Tre.")
    ingest.start_ingest(ingest.document_stream(spark, str(src)), out, ck).awaitTermination()
    (src / "b.txt").write_text("Quattro.")
    ingest.start_ingest(ingest.document_stream(spark, str(src)), out, ck).awaitTermination()
    rows = spark.read.parquet(out).collect()
    assert sorted((r.name, r.idx) for r in rows) == [("a.txt", 0), ("a.txt", 1), ("b.txt", 0)]


def test_arrivals_by_window(spark, tmp_path):
    from lexweave.streaming import ingest

    src = str(tmp_path / "in")
    rows = [("2024-01-01 00:00:00", "uno"), ("2024-01-02 00:00:00", "due"), ("2024-03-01 00:00:00", "tre"), (None, "x")]
    df = spark.createDataFrame(rows, "created_at string, text string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    df.write.parquet(src)
    q = ingest.arrivals_by_window(spark.readStream.schema(df.schema).parquet(src)).writeStream.outputMode("complete").format("memory").queryName("arrivals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.chunks, r.chars) for r in spark.table("arrivals").collect()) == [(1, 3), (2, 6)]
