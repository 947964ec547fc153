from lexweave.llm import names as nm

SAME = [
    ["Alessandro Futristavanti", "ALESSANDRO FUTRISTAVANTI", "Futristavanti Alessandro", "Futristavanti, A.", "A.Futristavanti", "Ales. Futristavanti", "avv. Futristavanti", "Dott. Futristavanti Alessandro", "Alessandro Futristvaanti", "Sandro Futristavanti"],
    ["Nicolò Licesurasco", "Nicolo' Licesurasco", "N. Licesurasco", "Licesuraoco Nicolò"],
    ["Maria Teresa Trafiborasco", "TRAFIBORASCO Maria Teresa", "M. Trafiborasco"],
    ["Elisabetta Rogugatteri", "Betta Rogugatteri", "Sig.ra ROGUGATTERI Elisabetta", "Elisabbetta Rogugatteri"],
    ["Raffaele Pufopambelli", "Lele Pufopambelli"],
    ["Raffaella Pufopambelli", "Lella Pufopambelli"],
    ["Laboratori Farmaceutici Cisiraorto S.p.A.", "L.F. Cisiraorto società per azioni", "Laboratori & Farmaceutici Cisiraorto SpA", "Cisiraorto spa", "la Laboratori Farmaceutici Cisiraorto"],
    ["Cartiere Frobrosomec S.n.c.", '"Frobrosomec" Cartiere snc', "cartiere frobrosomec", "Cart. Frobrosomec", "Cartiere Fro-brosomec S.N.C. in liquidazione"],
    ["Finanziaria Frobrosomec S.r.l.", "Fin. Frobrosomec"],
    ["Officine Meccaniche Nalascuvetro soc. coop.", "OFFICINE MECCANICHE NALASCUVETRO S.c.a r.l.", "Meccaniche Officine Nalascuvetro società cooperativa", "O.M. Nalascuvetro Scarl"],
]
ALONE = ["avv. Pufopambelli", "R. Pufopambelli", "11 agosto 1993", "€ 3.086,38", "dell’art. 5, co. 3, L. 475/1987", None, "", " ", "Gruppo Cisiraorto"]


def test_classes_and_pairs(spark):
    texts = [t for g in SAME for t in g] + ALONE
    rows = [(i, t, None) for i, t in enumerate(texts)] + [(1000, SAME[0][0], "x")]
    df = spark.createDataFrame(rows, "entity_id long, text string, label string").selectExpr("*", "1 AS id", "'k' AS kind", "'c' AS core")
    got = {r.entity_id: r.identity for r in nm.classes(df, "entity_id", "text").collect()}
    assert len(got) == len(rows)
    k, seen = 0, set()
    for g in SAME:
        ids = {got[k + i] for i in range(len(g))}
        assert len(ids) == 1 and None not in ids, {t: got[k + i] for i, t in enumerate(g)}
        assert not ids & seen
        seen |= ids
        k += len(g)
    for i, t in enumerate(ALONE):
        assert got[k + i] is None or got[k + i] not in seen, t
    pairs = {tuple(r) for r in nm.pairs(df, "entity_id", "text").collect()}
    sizes = [len(g) + (i == 0) for i, g in enumerate(SAME)]
    assert len(pairs) == sum(n * (n - 1) // 2 for n in sizes) and all(a < b for a, b in pairs) and (0, 1000) in pairs
    assert nm.pairs(df.limit(0), "entity_id", "text").count() == 0


def identities(spark, texts, lexicon="italian"):
    df = spark.createDataFrame(list(enumerate(texts)), "entity_id long, text string")
    got = {r.entity_id: r.identity for r in nm.classes(df, "entity_id", "text", lexicon).collect()}
    return [got[i] for i in range(len(texts))]


def test_short_names_and_copies(spark):
    a, b, c, d, e, f, g, h = identities(spark, ["Mario Rossi", "Mario Rosi", "Mario Bianchi", "Mario Bianchy", "Mario Bianhci", "ricorrente", "ricorrente", "convenuto"])
    assert a == b and c == d == e and a != c and None not in (a, c)
    assert f == g != h


def test_without_lists(spark):
    same = ["Wren Oakley", "Oakley, Wren", "WREN OAKLEY", "Wren Oakly", "W. Oakley", "dr. Oakley"]
    other = ["Wendel Brightwater", "W. Brightwater", "Birghtwater Wendel"]
    firm = ["Hollow Pond Widgets S.r.l.", "Widgets Hollow Pond srl", "Hollow Pond Widgest SRL"]
    got = identities(spark, same + other + firm, "none")
    parts = got[: len(same)], got[len(same) : len(same) + len(other)], got[len(same) + len(other) :]
    assert all(len(set(p)) == 1 and p[0] for p in parts) and len({p[0] for p in parts}) == 3
