"""The queries that do the whole job where a query with SQL does a part: over small tables made here."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lexweave.operators import relations
from lexweave.plans import registry


@pytest.fixture
def tables(spark, tmp_path):
    def write(**rows):
        for name, (data, schema) in rows.items():
            spark.createDataFrame(data, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        return str(tmp_path)

    return write


NODE = "node_id string, kb_id long, parent_id string, label string, titolo string, contenuto string"
DOCUMENT = "kb_id long, nome_legge string"


def test_resolution_is_by_law(spark, tables):
    nodes = [
        ("a", 11, None, "contenuto", "Art. 1", "Vedi art. 45 della L. 5/2001."), ("b", 11, None, "contenuto", "Art. 45", "Vedi art. 5 della L. 7/2001."),
        ("c", 12, None, "contenuto", "Art. 5", "Vedi art. 5 della L. 9/2001 e art. 6-bis."), ("d", 12, None, "contenuto", "Art. 45", "niente"),
    ]
    d = tables(kb_node=(nodes, NODE), kb_document=([(11, "Legge 3 marzo 2001, n. 5"), (12, "L. 7/2001"), (13, None)], DOCUMENT))
    got = {(r.doc_key, r.number, r.kb_id, r.node_id) for r in registry.queries()["citation_resolution_whole"](spark, d).collect()}
    # laws of keys of one length stay apart, numbers are as cited, and what the corpus does not hold is there without a law
    assert got == {("legge 5/2001", "45", 11, "b"), ("legge 7/2001", "5", 12, "c"), ("legge 9/2001", "5", None, None), ("legge 9/2001", "6-bis", None, None)}
    edges = registry.queries()["related_edges_whole"](spark, d).collect()
    assert sorted(map(tuple, edges)) == [("a", "b", "extensional"), ("b", "c", "extensional")]


def test_mentions_of_all_forms(spark, tables):
    texts = {
        "a": ("Visti gli artt. 242 e 520\nC.P.C., e letta", "ART 242|ART 520|DOC c.p.c."),
        "b": ("ART. 5 e Articolo 6-bis del D.LGS. N. 196 DEL 2003", "ART 5|ART 6-bis|DOC d.lgs. n. 196 del 2003"),
        "c": ("Artt. 1, comma 2, 3-ter ed 8 ter, lett. b), cod. proc. civ.; d.P.R. 380/2001", "ART 1|ART 3-ter|ART 8-ter|DOC cod. proc. civ.|DOC d.p.r. 380/2001"),
        "d": ("art. 7, co. 2, L. 9/2010, legge 3 marzo 2001, n. 5 e d.l. n. 18 del 17 marzo 2020", "ART 7|DOC l. 9/2010|DOC legge 3 marzo 2001, n. 5|DOC d.l. n. 18 del 17 marzo 2020"),
        "e": ("Alfa S.r.l. 5/2001, part. 5, presente legge", ""),
        "f": (None, ""),
    }
    d = tables(chunk=([(k, v[0]) for k, v in texts.items()], "chunk_id string, text string"))
    rows = registry.queries()["citation_mentions_whole"](spark, d).orderBy("chunk_id", "pos").collect()
    assert {k: "|".join(f"{r.label} {r.value}" for r in rows if r.chunk_id == k) for k in texts} == {k: v[1] for k, v in texts.items()}
    assert [r.pos for r in rows if r.chunk_id == "a"] == [0, 1, 2]


def test_pairs_and_keys_of_all_forms(spark, tables):
    nodes = [("a", 1, None, "contenuto", "Art. 1", "Visti gli ARTT. 2 e 3 c.p.c."), ("b", 1, None, "contenuto", "Art. 2", "Art. 4 D.LGS. N. 5 DEL 2001"), ("c", 1, None, "parti", None, "art. 9 c.p.c.")]
    d = tables(kb_node=(nodes, NODE))
    pairs = registry.queries()["citation_pairing_whole"](spark, d).collect()
    assert sorted((r.node_id, r.doc, r.article) for r in pairs) == [("a", "c.p.c.", "2"), ("a", "c.p.c.", "3"), ("b", "d.lgs. n. 5 del 2001", "4")]
    keys = registry.queries()["citation_keys_whole"](spark, d).collect()
    assert sorted((r.node_id, r.doc_key, r.article) for r in keys) == [("a", "codice di procedura civile", "2"), ("a", "codice di procedura civile", "3"), ("b", "decreto legislativo 5/2001", "4")]


@pytest.mark.parametrize("name,key", [
    ("L. 5/2001", "legge 5/2001"), ("5/2001 (legge)", "legge 5/2001"), ("2007, D.LGS. N. 678", "decreto legislativo 678/2007"), ("Dlgs 13/7/2018, n. 690", "decreto legislativo 690/2018"), (" DLGS n.183 10 nov. 2005.", "decreto legislativo 183/2005"),
    ("Decreto-legge 10 maggio 2000, n. 322", "decreto-legge 322/2000"), ("legge n. 5 del 3.3.2001", "legge 5/2001"), ("880/2024 (decreto legge)", "decreto-legge 880/2024"), ("C.p.c.", "codice di procedura civile"), ("vari", None), ("", None), (None, None),
])
def test_law_key(spark, name, key):
    assert spark.createDataFrame([(name,)], "n string").select(relations.law_key(F.col("n"))).first()[0] == key


def test_postings_of_chunks(spark, tables):
    d = tables(chunk=([("a", "Il canone, il CANONE e l’acqua."), ("b", "acqua"), ("c", " .,"), ("d", None)], "chunk_id string, text string"))
    got = {(r.term, r.chunk_id, r.tf, r.len) for r in registry.queries()["fulltext_postings_chunks"](spark, d).collect()}
    assert got == {("il", "a", 2, 7), ("canone", "a", 2, 7), ("e", "a", 1, 7), ("l", "a", 1, 7), ("acqua", "a", 1, 7), ("acqua", "b", 1, 1)}


def test_phrase_of_documents(spark, tables):
    names = ["Testo unico sulla illuminazione pubblica", "Illuminazione pubblica", "illuminazione della via pubblica", None, *["Codice della strada"] * 9]
    d = tables(kb_document=([(i + 1, n) for i, n in enumerate(names)], DOCUMENT))
    assert [r.kb_id for r in registry.queries()["phrase_match_documents"](spark, d).collect()] == [2]


def test_old_and_repeated_files(spark, tmp_path):
    from lexweave.streaming import ingest

    src, out, ck = tmp_path / "s", str(tmp_path / "out"), str(tmp_path / "ck")

    def load(days, **files):
        for name, text in files.items():
            f = src / name.replace("__", "/").replace("_", ".")
            f.parent.mkdir(parents=True, exist_ok=True)
            f.write_text(text)
            os.utime(f, (time.time() - 86400 * days,) * 2)
        ingest.start_ingest(ingest.document_stream(spark, f"{src}/*"), out, ck).awaitTermination()
        return sorted((r.name, r.text) for r in spark.read.parquet(out).collect())

    assert load(0, x__a_txt="Uno.") == [("a.txt", "Uno.")]
    # new names are loaded however old the files are, a name that was loaded is not
    assert load(2, x__b_txt="Due.") == [("a.txt", "Uno."), ("b.txt", "Due.")]
    assert load(400, x__c_txt="Tre.", y__a_txt="Altro.") == [("a.txt", "Uno."), ("b.txt", "Due."), ("c.txt", "Tre.")]
    assert load(0) == load(0, y__c_txt="Altro.") == [("a.txt", "Uno."), ("b.txt", "Due."), ("c.txt", "Tre.")]
