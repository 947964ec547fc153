import random

from lexweave.llm import canonical as c


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def allowed(r):
    return 0 if len(r) < 5 else 2 if len(r) < 8 else 3 if len(r) < 24 else 4


def test_pigeonhole_join_equals_all_pairs(spark):
    rnd = random.Random(4)
    refs = ["".join(rnd.choices("abcd ", k=rnd.randint(1, 40))) for _ in range(40)] + ["abc", "abcde", "abcdefgh"]
    values = [""]
    for r in refs:
        for _ in range(8):
            w = list(r)
            for _ in range(rnd.randint(0, 6)):
                p = rnd.randrange(len(w) + 1)
                w[p : p + rnd.randint(0, 1)] = rnd.choices("abcd ", k=rnd.randint(0, 2))
            values.append("".join(w))
    values = sorted(set(values))
    v = spark.createDataFrame([(f, x, g) for x in values for f, g in (("a", ""), ("b", "1/2"))], "form string, v string, digits string")
    r = spark.createDataFrame([("a", i, x, "", allowed(x)) for i, x in enumerate(refs)] + [("b", i, x, "1/2" if i % 2 else "3", allowed(x)) for i, x in enumerate(refs)], "form string, rid int, r string, digits string, k int")
    got = {(x.form, x.v, x.rid): x.d for x in c.pigeonhole_join(v, r).collect()}
    want = {("a", x, i): d for x in values for i, y in enumerate(refs) if x and (d := edits(x, y)) <= allowed(y)}
    assert got == want | {("b", x, i): d for (_, x, i), d in want.items() if i % 2} and len(want) > 150


LAWS = ["Legge 22 marzo 1983, n. 519", "Decreto-legge 10 maggio 2000, n. 322", "Decreto legislativo 10 novembre 2005, n. 183", "Decreto ministeriale 8 agosto 2015, n. 874",
        "Decreto del Presidente della Repubblica 4 giugno 1986, n. 601", "Codice in materia di pesca interna", "Codice in materia di apicoltura", "Testo unico delle disposizioni in materia di apicoltura",
        "Codice della navigazione lacustre", "Testo unico delle disposizioni in materia di catasto dei ghiacciai", "Decreto ministeriale 3 marzo 1986, n. 601"]
CASES = {
    0: ["legge 519/1983", "L. 519-1983", " Legge n. n.519 22 mar. 1983.", "LEGEG 22 MARZO 1983, N. 519", "1983, l. n. 519", "519/1983 (L)", "legge n. 22/3/1983, n. 519 e s.m.i."],
    1: ["Decrteo-legge 10 maggio 2000, n. 322", "D.L. 322/'00 del 10 maggio 2000", "DL 322 del 2000 - navig. lacu.", "allegato B al D.L. 322-2000", "decreto_legge_10_maggio_2000_322.pdf"],
    2: ["d.lgs. n.183 10 nov. 2005", "Decr. leg.vo 183/2005", "D. Lgs. n. 183-2005 (testo coordinato)", "Artt. 3-5 dlgs 10/11/2005, n. 183"],
    3: ["dm 874/2015*", "decreto min. 874/'15 del 8 agosto 2015", "DECRETO MINISTERIALE N. 874 DEL 8.8.2015"],
    4: ["dpr 601/1986", "Decr. Pres. Rep. 601 del 1986", "decreto presidente repubblica 4 giugno 1986, n. 601"],
    5: ["Codice pesca interna", "cod. pesca int.", "Codcie in materia di psca interna", "c. pesca interna", "pesca interna (cod.)"],
    6: ["codice apicoltura", "codice apico.", "CODICE DI APICOLSURA"],
    7: ["t.u. apico.", "apicoltura (T.U.)", "T. U. disp. in mat. di apico.", "Testo unico su apicoltura"],
    8: ["codice navigazione lacustre", "cod. navig. lacu."],
    9: ["TU cat. dei ghia.", "Testo unico delle dsposizioni in materai di catasto dei ghiacciai"],
    10: ["d.m. 601/1986"],
    -1: ["Legge 22 marzo 1984, n. 519", "legge 518/1983", "601/1986", "dpr 601/1985", "Codice pesca d’altura", "Codice apicoltura urbana", "Contratto collettivo pesca interna", "apicoltura", "T.U.", "???", "codice navigazione aerostatica",
         "circolare n. 519/1983", "Decreto ministeriale 3 aprile 1986, n. 601", "x" * 5000, "legge 99999999999999999999/1983"],
}


def test_laws(spark):
    rows = [(i, n) for i, n in enumerate((n for ns in CASES.values() for n in ns), 100)]
    want = dict(zip((i for i, _ in rows), (k for k, ns in CASES.items() for _ in ns)))
    extra = [(1, None), (2, ""), (3, " \n"), (4, "legge 519/1983"), (4, "legge 519/1983")]
    docs = spark.createDataFrame(rows + extra, "kb_id long, nome_legge string").selectExpr("*", "1 AS ref_id", "'n' AS name", "2 AS id")
    refs = spark.createDataFrame(list(enumerate(LAWS)), "ref_id long, nome_legge string").selectExpr("*", "1 AS rid")
    got = sorted(map(tuple, c.map_laws(docs, refs).collect()))
    names = dict(rows)
    wrong = {names[i]: (r, want[i]) for i, r in got if i >= 100 and want[i] != r}
    assert not wrong
    assert [x for x in got if x[0] < 100] == [(4, 0), (4, 0)] and len(got) == len(rows) + 2
    assert c.map_laws(docs.limit(0), refs).count() == 0
    assert {r.ref_id for r in c.map_laws(docs, refs.limit(0)).collect()} == {-1}
