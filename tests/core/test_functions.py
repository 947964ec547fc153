import pytest
from pyspark.sql import functions as F

from lexweave.functions import entities, statutes
from lexweave.functions import text as tx
from lexweave.functions import vectors as vec

LAW = """TITOLO I
Delle persone

Art. 1. Capacita' giuridica
premessa scartata
1. Primo comma.
segue.
2. Secondo comma.

AGGIORNAMENTO (3)
testo da rimuovere

altro paragrafo
"""
CLEAN = {
    "A": (LAW, "TITOLO I\n\nDelle persone\nArt. 1\n. Capacita' giuridica\n\n1. Primo comma.\nsegue.\n\n2. Secondo comma.\naltro paragrafo"),
    "B": ("CAPO II\n\nnorme generali\naltre", "CAPO II\nNORME GENERALI\n\naltre"),
    "C": ("Art. 2-bis Titolo", "Art. 2- bis\nTitolo"),
    "D": ("Nota (5) qui\nArt. 7 Titolo (6)\nuso (6)", "Nota qui\nArt. 7\nTitolo (6)"),
    "E": ("a ((Art. 3 x)) b", "a b"),
    "F": (None, ""),
    "G": (" \n ", ""),
}


def test_statutes(spark):
    df = spark.createDataFrame([(k, v[0]) for k, v in CLEAN.items()], "id string, text string")
    assert {r.id: r.clean_text for r in statutes.cleaned(df, "id", "text").collect()} == {k: v[1] for k, v in CLEAN.items()}
    kept = statutes.cleaned(df.where("id = 'E'"), "id", "text", keep_articles=True).first().clean_text
    assert kept == "a ((Art. 3 x)) b"


def test_tool_calls(spark):
    cases = {
        "<api>search_by_text('doc.pdf','mutuo')</api>": ([("search_by_text", "doc.pdf", "mutuo")],) * 2,
        "<api>search_article('1414', 'codice civile')</api>": ([("search_article", "1414", "codice civile")], [("search_article", "1414", " 'codice civile")]),
        "<api>search_by_embedding('testo solo')</api>": ([("search_by_embedding", "", "testo solo")], [("search_by_embedding", "testo solo", "")]),
        "<api>search_by_text('d','a(b)')</api>": ([("search_by_text", "d", "a(b)")],) * 2,
        "<api>wide_article('x','y')</api>": ([("wide_search", "x", "y")], []),
        "<api>end_querying(Il saldo (cinque).)</api>": ([("end_querying", "Il saldo (cinque).", "")],) * 2,
        "nessuna chiamata": ([], []),
        "<api>search_by_text</api><api>ignota('x')</api>": ([], []),
    }
    df = spark.createDataFrame([(k,) for k in cases], "r string").select("r", tx.tool_calls(F.col("r")).alias("i"), tx.tool_calls(F.col("r"), True).alias("f"))
    for r in df.collect():
        want = cases[r.r]
        assert [tuple(x) for x in r.i] == want[0]
        if "(b)" not in r.r:
            assert [tuple(x) for x in r.f] == want[1]


def test_sentences_and_chunks(spark):
    df = spark.createDataFrame([("a", "Visto l'art. 5 del sig. M. Rossi. Poi basta! 1. Il terzo c'è? Fine"), ("b", None), ("c", "  "), ("d", "uno. due. tre. quattro. cinque.")], "name string, text string")
    s = {r.name: r.s for r in df.select("name", tx.sentence_array(F.col("text")).alias("s")).collect()}
    assert s["a"] == ["Visto l'art. 5 del sig. M. Rossi.", "Poi basta!", "1. Il terzo c'è?", "Fine"] and s["b"] is None and s["c"] == []
    c = [(r.name, r.idx, r.text) for r in tx.chunk_documents(df, "name", "text").orderBy("name", "idx").collect()]
    assert [x for x in c if x[0] == "d"] == [("d", 0, "uno. due."), ("d", 1, "tre. quattro."), ("d", 2, "cinque.")]
    ids = [r.chunk_id for r in tx.chunk_documents(df, "name", "text").collect()]
    assert sorted(ids) == sorted(r.chunk_id for r in tx.chunk_documents(df, "name", "text").collect()) and len(set(ids)) == len(ids)


def test_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0]), (5, None), (6, [3.0, 4.0]), (7, [None, 1.0])]
    df = spark.createDataFrame(rows, "id int, v array<float>")
    got = {r.id: (r.c, r.s) for r in df.select("id", vec.cosine_to(F.col("v"), [1.0, 0.0]).alias("c"), vec.vector_status(F.col("v"), 2).alias("s")).collect()}
    assert {k: v[1] for k, v in got.items()} == {1: "ok", 2: "zero", 3: "not_finite", 4: "wrong_length", 5: "missing", 6: "ok", 7: "not_finite"}
    assert got[1][0] == pytest.approx(1) and got[6][0] == pytest.approx(0.6) and all(got[k][0] is None for k in (2, 3, 4, 5, 7))
    pooled = spark.createDataFrame([("a", 0, 1.0, 1), ("a", 0, 3.0, 1), ("a", 0, 9.0, 0), ("b", 0, 2.0, 0)], "k string, dim int, v double, m int")
    assert {r.k: r.pooled for r in vec.masked_mean(pooled, ["k", "dim"], "v", "m").collect()} == {"a": 2.0, "b": 0.0}
    e = spark.createDataFrame([("uno due",), (None,)], "t string").select(vec.embed(F.col("t")).alias("e")).collect()
    assert len(e[0].e) == 64 and abs(sum(x * x for x in e[0].e) - 1) < 1e-5 and set(e[1].e) == {0.0}


def test_failing_providers(spark):
    def broken():
        def f(texts):
            raise RuntimeError("no model")

        return f

    df = spark.createDataFrame([("x",)], "t string")
    r = df.select(vec.embed(F.col("t"), broken, zero=False).alias("e"), vec.embed(F.col("t"), broken, 3).alias("z"), entities.extract(F.col("t"), broken).alias("x"), entities.classify(F.col("t"), broken).alias("c")).first()
    assert r.e is None and r.z == [0.0, 0.0, 0.0] and r.x == [] and r.c == 0

    def counting():
        return lambda texts: [[float(len(t.split()))] for t in texts]

    df = spark.createDataFrame([("a  b c d",), ("a b",), (" ",), (None,)], "t string")
    assert [r.e for r in df.select(vec.embed(F.col("t"), counting, most=3).alias("e")).collect()] == [[3.0], [2.0], [0.0], [0.0]]


def test_entities_and_spans(spark):
    df = spark.createDataFrame([("Il 3 maggio 2001 ha versato € 1.200,50 (n. 12/2001).",)], "t string")
    assert {(x.label, x.text) for x in df.select(entities.extract(F.col("t")).alias("e")).first().e} == {("data", "3 maggio 2001"), ("importo", "€ 1.200,50"), ("numero", "n. 12/2001")}
    df = spark.createDataFrame([([(0, 3), (4, 7), (8, 12)], [(4, 7, "A"), (3, 9, "B"), (5, 6, "C")])], "tok array<struct<start:int,end:int>>, sp array<struct<start:int,end:int,label:string>>")
    assert [tuple(x) for x in df.select(entities.aligned_spans(F.col("tok"), F.col("sp")).alias("a")).first().a] == [(4, 7, "A"), (4, 7, "B")]


def test_classifier(spark):
    rows = spark.createDataFrame([("vedi art. 5 legge", 1), ("articolo 7 codice", 1), ("che bella giornata", 0), ("andiamo al mare", 0)] * 5, "text string, labels int")
    model = entities.train_classifier(rows)
    assert [r.prediction for r in model.transform(rows.limit(4)).collect()] == [float(r.labels) for r in rows.limit(4).collect()]


def test_misc(spark):
    df = spark.createDataFrame([("/a/b/Legge.x.pdf", "a &egrave; b &amp;")], "p string, h string")
    r = df.select(tx.basename(F.col("p")).alias("b"), tx.stem(F.col("p")).alias("s"), tx.html_unescape(F.col("h")).alias("h")).first()
    assert tuple(r) == ("Legge.x.pdf", "Legge.x", "a è b &") and tx.phrase_query(' a "b" ') == '"a \\"b\\""'
