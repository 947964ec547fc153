"""Recognition, pairing and resolution of citations, by key and by name; plans of the context of hits."""

from lexweave.operators import law, relations, search
from lexweave.sources import readers

TEXTS = [
    "art. 1414 del codice civile", "articolo 5 della legge 7 agosto 1990, n. 241", "art. 13 del decreto legislativo 31 marzo 1998, n. 112",
    "art. 15 del Codice della strada", "artt. 1 e 2, c.p.c.", None,
]


def test_codes_and_dated_acts(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    got = relations.pair(relations.mentions(df, "id", "text"), "id", ["pos"]).withColumn("key", relations.law_key(relations.F.col("doc")))
    assert sorted((r.id, r.key, r.article) for r in got.collect()) == [
        (0, "codice civile", "1414"), (1, "legge 241/1990", "5"), (2, "decreto legislativo 112/1998", "13"), (3, "codice della strada", "15"), (4, "codice di procedura civile", "1"), (4, "codice di procedura civile", "2"),
    ]


def test_pairing(spark):
    rows = {1: "ART 5|DOC X|ART 6|DOC Y|ART 7", 2: "ART 9", 3: "DOC X|ART 1|ART 2", 4: "ART 1|ART 2|DOC Z", 5: "DOC X|DOC Y|ART 3"}
    df = spark.createDataFrame([(k, i, *m.split()) for k, v in rows.items() for i, m in enumerate(v.split("|"))], "id int, pos int, label string, value string")
    got = sorted((r.id, r.doc, r.article) for r in relations.pair(df, "id", ["pos"]).collect())
    assert got == [(1, "X", "5"), (1, "X", "6"), (1, "Y", "7"), (3, "X", "1"), (3, "X", "2"), (4, "Z", "1"), (4, "Z", "2"), (5, "Y", "3")]


NODES = "node_id string, kb_id long, parent_id string, label string, titolo string, contenuto string"


def corpus(spark):
    nodes = [
        ("a", 11, None, "contenuto", "Art. 5", "Si vedano l'art. 1414 del codice civile e l'art. 9 del codice civile."), ("b", 12, None, "contenuto", "Art. 1414", "Vedi art. 5 del codice della strada."),
        ("c", 13, None, "contenuto", "Articolo 5", "Vedi art. 5 del codice della strada; art. 1414 del codice civile; art. 1 del codice ignoto."),
    ]
    docs = [(11, "Codice della strada"), (12, "Codice Civile"), (13, "Disposizioni di attuazione del codice civile e disposizioni transitorie"), (14, "Codice civile"), (15, None), *((k, f"Legge numero {k} sulle acque") for k in range(20, 40))]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(docs, "kb_id long, nome_legge string")


def test_resolution_by_name(spark):
    nodes, docs = corpus(spark)
    names = ["codice civile", "codice della strada", "legge", "codice ignoto", "civile codice", ""]
    got = {r.name: (r.kb_id, r.score) for r in law.best_documents(spark.createDataFrame([(n,) for n in names], "name string"), docs).collect()}
    assert {k: v[0] for k, v in got.items()} == {"codice civile": 12, "codice della strada": 11}
    for name, (kb_id, score) in got.items():
        one = law.best_document(docs, name).first()
        assert one.kb_id == kb_id and abs(one.score - score) < 1e-9
    pairs, resolved = relations.resolution(nodes, docs, by="name")
    assert {(r.doc_key, r.number): (r.kb_id, r.node_id) for r in resolved.collect()} == {
        ("codice civile", "1414"): (12, "b"), ("codice civile", "9"): (12, None), ("codice della strada", "5"): (11, "a"), ("codice della strada", "1414"): (11, None), ("codice civile", "1"): (12, None),
    }
    edges, counts = relations.cluster(nodes, docs, by="name")
    assert sorted((r.src_id, r.dst_id) for r in edges.collect()) == [("a", "b"), ("b", "a"), ("c", "a")]
    assert counts.first().asDict() == {"undirected": 6, "directed": 3, "accepted": 3}
    edges, counts = relations.cluster(nodes, docs, by="name", undirected=True)
    assert sorted((r.src_id, r.dst_id) for r in edges.collect()) == [("a", "b"), ("a", "c")] and counts.first().accepted == 3


def test_recogniser_is_a_callable(spark):
    nodes, docs = corpus(spark)

    def provider():
        return lambda texts: [[("ART", "1414"), ("DOC", "codice civile")] if t else [] for t in texts]

    edges, _ = relations.cluster(nodes, docs, relations.recogniser(provider), "name")
    assert {r.dst_id for r in edges.collect()} == {"b"}
    assert relations.recognised(None, []) == []


def test_context_exchanges_no_table(spark):
    chunks = spark.createDataFrame([(f"c{k}", "d", k, f"testo {k}", [1.0, float(k)]) for k in range(50)], "chunk_id string, name string, idx int, text string, embedding array<double>")
    g = search.Graph(
        chunks, spark.createDataFrame([(k, f"e{k}", "x") for k in range(9)], "entity_id long, text string, label string"), spark.createDataFrame([(f"c{k}", k % 9) for k in range(50)], "chunk_id string, entity_id long"),
        spark.createDataFrame([("c3", "n1", None, "extensional")], "src_id string, dst_id string, text string, kind string"), spark.createDataFrame([("n1", "contenuto", "detto")], "node_id string, label string, contenuto string"),
    )
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = search.by_text(g, "3")
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        row = hits.first()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert (row.chunk_id, row.prev_chunks, row.next_chunks, [e.text for e in row.entities], [r.text for r in row.related]) == ("c3", ["testo 2"], ["testo 4"], ["e3"], ["detto"])
    edge = search.by_text(g, "49").first()
    assert edge.prev_chunks == ["testo 48"] and edge.next_chunks == []


def test_commentary_lines_over_blocks(spark, tmp_path):
    lines = [f'{{"article_number": {k}, "text": "riga {k}"}}' for k in range(200)]
    lines[7] = "nessun json"
    (tmp_path / "a.jsonl").write_text("\n".join(lines))
    (tmp_path / "b.jsonl").write_text('\n{"article_number": 1, "text": "x"}\n')
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        good, bad = readers.read_commentary(spark, str(tmp_path))
        got = {(r.file, r.line_no): int(r.article_number) for r in good.collect()}
        assert got == {("a.jsonl", k): k for k in range(200) if k != 7} | {("b.jsonl", 1): 1}
        assert [(r.file, r.line_no) for r in bad.collect()] == [("a.jsonl", 7)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
