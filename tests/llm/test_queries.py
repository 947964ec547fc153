"""The queries over the smallest tables: columns, whole coverage, and SQL where there is any."""

import os
from pathlib import Path

import pytest

from lexweave.llm import queries

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
COLUMNS = {
    "p1_found": "kb_id bigint, ref_id bigint", "p2_found": "node_id string, start_pos int, end_pos int", "p3_found": "chunk_id string, start_pos int, end_pos int, kind string",
    "p4_found": "entity_id_a bigint, entity_id_b bigint", "p5_found": "node_id string", "p6_found": "node_id_a string, node_id_b string", "p7_found": "chunk_id_a string, chunk_id_b string",
    "p8_ids": "doc_id bigint, ids array<int>", "p10_found": "doc_id bigint",
}


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    if name in COLUMNS:
        assert ", ".join(f"{c} {t}" for c, t in df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows
    pairs = [c for c in df.columns if c.endswith(("_a", "_b"))]
    if pairs:
        assert all(r[pairs[0]] < r[pairs[1]] for r in rows) and len({tuple(r) for r in rows}) == len(rows)
    if name in queries.oracle_sql():
        rel = duck.execute(queries.oracle_sql()[name])
        assert [x[0] for x in rel.description] == df.columns
        assert sorted(map(tuple, rows)) == sorted(rel.fetchall())


def count(duck, sql):
    return duck.execute(sql).fetchall()[0][0]


def test_every_row_is_covered(spark, duck):
    q = queries.queries()
    assert q["p1_found"](spark, DATA).count() == count(duck, "SELECT count(*) FROM kb_document WHERE trim(nome_legge) <> ''")
    assert q["p8_ids"](spark, DATA).count() == count(duck, "SELECT count(*) FROM documents")
    texts = count(duck, r"SELECT count(*) FROM (SELECT text FROM chunk UNION ALL SELECT contenuto FROM kb_node) WHERE regexp_matches(text, '\S')")
    assert q["p2_found"](spark, DATA).select("node_id").distinct().count() == texts
    packed = q["p9_containers"](spark, DATA)
    assert packed.select("doc_id").distinct().count() == count(duck, "SELECT count(*) FROM documents WHERE text <> ''")
    assert packed.groupBy("container").agg({"token_to": "count"}).count() == packed.select("container").distinct().count()
