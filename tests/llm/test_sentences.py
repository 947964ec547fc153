import time

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.sentences import sentence_spans, spans


def cut(t):
    return [t[a:b] for a, b in spans(t)]


def same(*parts, sep=" "):
    text = sep.join(parts)
    assert cut(text) == list(parts), cut(text)


def test_abbreviations_numbers_initials():
    same("Cfr. Cass. civ., sez. III, sent. n. 3/2001 di € 1.347,20, pag. 4.", "L’avv. A. Rossi ha vinto.", "Il sig. F.Bianchi no.")
    same("Causa contro Alfa S.p.A. e Beta S.r.l. per danni con Gamma soc. coop.", "Il giudice decide.")
    same("Visti gli artt. 4 e 5 c.p.c., e letta l’istanza.", "Ha sostenuto… ma non provato… il fatto.")


def test_quotes_and_brackets():
    same("Il teste disse che «la fattura 1/2 non fu pagata!» e che basta.", "«Non ho firmato.» ha detto lui.", "Ha osservato: «Tutto è finito. Nulla è dovuto.»", "Poi tacque.")
    same("Der Zeuge sagte: „Ich habe gezahlt.“, doch der Beleg fehlt.", "Wer haftet?")


def test_lists_headings_lines():
    assert cut("In fatto\nIl giudice (art. 3)\nha deciso.\n\n1. Sono esenti: a) i fondi; b) gli enti.\n2-bis. Fine.") == [
        "In fatto", "Il giudice (art. 3)\nha deciso.", "1. Sono esenti: a) i fondi; b) gli enti.", "2-bis. Fine."]


def test_scripts():
    same("证人说：“我付了5元！”但收据缺失。", "公司欠款3元……合同编号7。", "谁应承担？", sep="")
    same("「契約は無効である。返せ。」と述べた。", "誰が負担するのか？", sep="")
    same("บริษัทค้างชำระ5บาท", "คดี3เลื่อนไปวันที่2006年1月18日", "ศาลยกคำร้อง")
    same("न्यायालय ने राशि स्वीकार की।", "क्या विक्रेता देगा?", "वाद!")
    same("هل يلزم البائع دفع 5 EUR؟", "قال الشاهد: «العقد باطل.» ثم أنكر.")
    same("Ποιος οφείλει 5 EUR;", "Το ποσό έληξε· ο φάκελος είναι 3.")


def test_missing_space():
    assert cut("Il valore è 1,73%.Abita in via Po.") == ["Il valore è 1,73%.", "Abita in via Po."]


def test_empty():
    assert spans(None) == spans("") == spans(" \n ") == []
    assert cut("senza segno") == ["senza segno"]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aB1 .!?«»“”\"()\n;…。ไ", max_size=60))
def test_spans_cover_the_text(t):
    got = spans(t)
    at = 0
    for a, b in got:
        assert at <= a < b and not t[at:a].strip() and t[a:b].strip() == t[a:b]
        at = b
    assert not t[at:].strip()


def test_frame(spark):
    df = spark.createDataFrame([("a", "Uno. Due."), ("b", None), ("c", " "), ("a", "Uno. Due.")], "node_id string, text string").selectExpr("*", "1 AS id", "2 AS start_pos")
    got = sorted(map(tuple, sentence_spans(df, "node_id", "text").collect()))
    assert got == [("a", 0, 4), ("a", 0, 4), ("a", 5, 9), ("a", 5, 9)]
    assert sentence_spans(df.limit(0), "node_id", "text").count() == 0


def test_long_text():
    t = "Il giudice decide. " * 50_000
    assert len(spans(t)) == 50_000


def test_other_terminators():
    for text in ("ខ្ញុំទៅផ្ទះ។ គាត់មក។", "သူသွားသည်။ သူလာသည်။", "ሰላም ነው። እሱ መጣ።", "Բարեւ ձեզ։ Նա եկավ։"):
        assert len(spans(text)) == 2, text


def test_hostile_texts_take_linear_time():
    n = 1_000_000
    began = time.time()
    for text in ("(" * (n // 2) + "]" * (n // 2), '("' * (n // 2), "A." * (n // 2), "www.a.B" * (n // 7), "!" * n + "a", "\n" * (n // 2) + "a\n" * (n // 4) + "b"):
        t = time.time()
        spans(text)
        assert time.time() - t < 10
    assert time.time() - began < 60
