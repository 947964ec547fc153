import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.pii import Shadow, find, personal_items, redact, redacted


def items(t):
    return [(t[a:b], k) for a, b, k in find(t)]


def test_kinds():
    t = "Il ricorrente Rossi, M., codice fiscale RSS MRA 80A01 H501U, residente in via del Torrione n. 25/3, scala B, 00914 Marina di Olbra (WZ), ha scritto."
    assert items(t) == [("Rossi, M.", "NAME"), ("RSS MRA 80A01 H501U", "ID"), ("via del Torrione n. 25/3, scala B, 00914 Marina di Olbra (WZ)", "ADDRESS")]
    t = "Contattare Ruggero\nStufra (studio+x.y@legal.mail.example) il 7.8.1986\nin Mühlgasse 85a, 00977 Talberg, rif. 3/2001."
    assert items(t) == [("Ruggero\nStufra", "NAME"), ("studio+x.y@legal.mail.example", "EMAIL"), ("Mühlgasse 85a, 00977 Talberg", "ADDRESS")]
    assert items("Eredi: Raffaele Verdi, Futrista Alessandro e E. Zola; quota di € 3.") == [("Raffaele Verdi", "NAME"), ("Futrista Alessandro", "NAME"), ("E. Zola", "NAME")]
    for n in ("0633/555123", "+39 383 5559149", "0039 064 555627", "(037) 555 4737", "3145559214", "341-555.58.416", "335 55 54 354", "+39-061-555-5617"):
        assert items(f"La sig.ra Elisa Bianchi (tel. {n}) ha versato.") == [("Elisa Bianchi", "NAME"), (n, "PHONE")]


def test_no_cases():
    for t in ("Al prot. 303-3174444, in via telematica, il 17 marzo.", "Il conto n. 206712455516 fu estinto.", "Il fascicolo 36232/2011 di EUR 345678901.", "P. IVA 31981230290",
              "La relazione del dott. commercialista incaricato.", "Secondo la c.d. legge Verdi-Bianchi del 2001.", "Fonderie Alfa S.p.A. ha negato.", "Vedi https://norme.example/atti/926 e la sede di Olbra.", "Tra il 3 maggio e il 4 giugno."):
        assert items(t) == [], t


def test_disguises_map_back():
    assert items("Scrivere a studio+x [at] posta.test o a m.r(chiocciola)pec.example oggi.") == [("studio+x [at] posta.test", "EMAIL"), ("m.r(chiocciola)pec.example", "EMAIL")]
    assert items("Scrivere a mаrio@pоsta (punto) test ora.") == [("mаrio@pоsta (punto) test", "EMAIL")]
    assert items("telefonare al tre quattro zero cinque cinque cinque uno due tre quattro entro") == [("tre quattro zero cinque cinque cinque uno due tre quattro", "PHONE")]
    assert items("tel. +39 3​83 555­9149.") == [("+39 3​83 555­9149", "PHONE")]
    t = "Firmato digitalmente il 5 maggio 2015, Anna Rossi, a@b.test, atto 3."
    assert redact(t, find(t)) == "Firmato digitalmente il 5 maggio 2015, [NOME], [EMAIL], atto 3."


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["a", "@", " ", "(at)", "chiocciola", "​", "tre ", "uno-", "3", "О", "\n", "via Po 3", "Anna Rossi ", ".it", "(", ")"]), max_size=25).map("".join))
def test_spans_are_sound(t):
    at = 0
    for a, b, _ in find(t):
        assert at <= a < b <= len(t)
        at = b
    s = Shadow(t)
    for p in range(len(s.text)):
        a, b = s.back(p, p + 1)
        assert 0 <= a <= b <= len(t)


def test_frame(spark):
    df = spark.createDataFrame([("a", "Ha scritto x@y.test."), ("b", None), ("c", " "), ("a", "Ha scritto x@y.test.")], "chunk_id string, text string").selectExpr("*", "1 AS id", "2 AS kind")
    assert [tuple(r) for r in personal_items(df, "chunk_id", "text").collect()] == [("a", 11, 19, "EMAIL")] * 2
    assert [tuple(r) for r in redacted(df, "chunk_id", "text").collect()] == [("a", "Ha scritto [EMAIL].", 1), ("b", None, 0), ("c", " ", 0), ("a", "Ha scritto [EMAIL].", 1)]
    assert personal_items(df.limit(0), "chunk_id", "text").count() == 0


def test_long_text():
    t = "Abita in via Po n. 3, 00914 Olbra. " * 20_000
    assert len(find(t)) == 20_000


def found(text):
    return [(text[a:b], k) for a, b, k in find(text)]


def test_other_alphabets_do_not_hide_disguises():
    assert found("ＭＡＲＩＯ＠ＰＯＳＴＡ．ＩＴ è qui λόγος") == [("ＭＡＲＩＯ＠ＰＯＳＴＡ．ＩＴ", "EMAIL")]
    assert found("λόγος: mario {dot} rossi <et> posta <punto> it") == [("mario {dot} rossi <et> posta <punto> it", "EMAIL")]
    assert found("суд принял решение") == []


def test_other_countries():
    got = found("Call John Smith at 12 Baker Street, phone (415) 555-2671, SSN 123-45-6789")
    assert got == [("John Smith", "NAME"), ("12 Baker Street", "ADDRESS"), ("(415) 555-2671", "PHONE"), ("123-45-6789", "ID")]
    assert found("Jean Dupont, 12 rue de la Paix, 06 12 34 56 78") == [("Jean Dupont", "NAME"), ("12 rue de la Paix", "ADDRESS"), ("06 12 34 56 78", "PHONE")]


def test_hostile_texts_take_linear_time():
    n = 1_000_000
    for text, items in (("a" * n + " m@posta.it", 1), ("a" * n + "@posta.it", 1), ("m@" + "a." * (n // 2), 0), ("AB1234567 " * (n // 10), n // 10), ("@" * n, 0)):
        began = time.time()
        assert len(find(text)) == items
        assert time.time() - began < 10
