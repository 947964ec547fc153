import random

from lexweave.llm import spam

PROSE = "Il giudice ha deciso la causa con ordinanza e la parte convenuta non ha versato la somma che era dovuta per il contratto del fondo; si applica il disposto di legge ai fatti della causa, come risulta dagli atti depositati in cancelleria dal ricorrente nei termini"
TOWNS = "Olbra Serralta Cimadura Talberg Fontebassa Granatolo Borgonero".split()


def prose(rnd, n):
    words = PROSE.split()
    out = []
    while len(out) < n:
        k = rnd.randrange(len(words) - 8)
        out += words[k : k + 8] + [str(rnd.randint(1, 999)), "parola" + "".join(rnd.choices("abcdefgh", k=3))]
    return " ".join(out[:n])


def pages():
    rnd = random.Random(1)
    good = [prose(rnd, rnd.randint(40, 400)) for _ in range(300)]
    tagged = [prose(rnd, 200) + " #tag https://a.example/b" for _ in range(10)]
    bad = [
        *(" ".join(f"avvocato online {rnd.choice(TOWNS)}" for _ in range(40)) for _ in range(6)),
        *(" • ".join(f"https://{rnd.choice(TOWNS)}.test/x/{k}" for k in range(40)) for _ in range(6)),
        *(prose(rnd, 20) + " " + " ".join("#" + rnd.choice(TOWNS) + str(k) for k in range(80)) for _ in range(6)),
    ]
    return good + tagged, bad


def test_found(spark):
    good, bad = pages()
    rows = [(i, t, rnd) for i, (t, rnd) in enumerate(zip(good + bad, ["it", None, "en"] * 200))]
    extra = [(1000, None, "it"), (1001, "", None), (1002, " ", "it"), (1003, "corto", "it"), (1004, "日本語の文書。" * 40, "ja"), (None, bad[0], "it"), (len(good), bad[0], "it")]
    df = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string").selectExpr("*", "1 AS id", "'x' AS language", "0D AS links")
    got = [r.doc_id for r in spam.spam_pages(df, "doc_id", "text", "lang").collect()]
    assert sorted(x for x in got if x is not None) == sorted([*range(len(good), len(good) + len(bad)), len(good)]) and got.count(None) == 1
    assert spam.spam_pages(df.limit(0), "doc_id", "text", "lang").count() == 0


def test_majority_of_windows_decides():
    rnd = random.Random(2)
    mostly = prose(rnd, 500) + " " + " ".join("#x" for _ in range(100))
    assert spam.features(mostly)[1][0] < 0.1 < 0.9 < spam.features(" ".join("#x" for _ in range(300)) + " " + prose(rnd, 100))[1][0]


def test_scripts_without_blanks_are_judged():
    prose = "证人在法庭上说合同无效，鉴定人估计损失并提交报告，公司自去年起欠款，法院驳回请求，费用由原告承担。"
    stuffed = "免费律师|贷款|房产|咨询|合同|离婚|" * 12
    for text, repeats in ((prose, False), (stuffed, True), ("รับซื้อ|ที่ดิน|ราคา|" * 15, True)):
        lang, f = spam.features(text)
        assert lang in ("zh", "th") and (f[1] > 0.7) == repeats
    tight = "scarpe,borse,orologi,occhiali,cinture,cappelli,guanti,sciarpe," * 4
    assert spam.features(tight)[1][1] > 0.5
    assert spam.features("o réu não pagou a dívida que é de uma das partes do contrato e o juiz não aceitou o pedido")[0] == "pt"
    # the script is told from all characters
    assert spam.features("суд принял решение по делу " * 200 + "x" * 400)[0] == "ru"
