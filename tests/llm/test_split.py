from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm.sentences import spans
from lexweave.llm.split import pieces, split_pieces


def sound(t, limit, overlap):
    got = pieces(t, limit, overlap)
    seen = [0] * len(t)
    for n, (s, new, e) in enumerate(got):
        assert s <= new < e and e - s <= limit
        if n == 0:
            assert s == new
        elif s < new:
            assert got[n - 1][2] - s <= overlap and s >= got[n - 1][0]
        for i in range(new, e):
            seen[i] += 1
    assert all(v == 1 for v, ch in zip(seen, t) if not ch.isspace()) and all(v <= 1 for v in seen)
    return got


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab .\n;,A1-)", max_size=300), st.sampled_from([20, 50]))
def test_cover(t, limit):
    sound(t, limit, limit // 5)


def test_cuts_at_sentences():
    s = "Il giudice ha deciso la causa n. 5 con ordinanza."
    t = " ".join([s] * 60)
    got = sound(t, 1200, 120)
    assert all(t[e - 1] == "." and t[new : new + 2] == "Il" for _, new, e in got) and all(s_ < new for s_, new, _ in got[1:])
    assert len(got) == 3


def test_sections_first():
    t = "TITOLO I\n\n" + "a b. " * 100 + "\n\nTITOLO II\n\n" + "c d. " * 160
    got = pieces(t, 1000, 100)
    assert [t[new:e].split("\n")[0] for _, new, e in got] == ["TITOLO I", "TITOLO II"]


def test_edges(spark):
    assert pieces(None) == pieces("") == pieces(" \n") == []
    assert pieces(" " * 1300 + "a" * 1200 + "\n") == [(1300, 1300, 2500)]
    assert len(sound("x" * 5000, 1200, 120)) == 5
    sound("日本語。" * 2000, 1200, 120)
    df = spark.createDataFrame([("a", "x " * 900), ("b", None), ("c", "y"), ("c", "y")], "node_id string, text string").selectExpr("*", "1 AS id", "2 AS piece")
    rows = split_pieces(df, "node_id", "text").collect()
    assert sorted((r.node_id, r.piece, r.pieces) for r in rows) == [("a", 0, 2), ("a", 1, 2), ("c", 0, 1), ("c", 0, 1)]
    assert all(r.piece_text == ("x " * 900)[r.start_pos : r.end_pos] for r in rows if r.node_id == "a")
    assert split_pieces(df.limit(0), "node_id", "text").count() == 0


def test_sentences_that_fit_are_not_cut():
    sentence = "La parte ha chiesto quanto segue\n1. la somma dovuta\n- gli interessi\nTITOLO II\n\nin ogni caso le spese del giudizio."
    text = " ".join([sentence] * 40)
    got = pieces(text, 600, 60)
    assert len(got) > 5 and all(b - a <= 600 for a, _, b in got)
    for (_, _, e), (a, x, _) in zip(got, got[1:]):
        assert e - a <= 60 and not text[e:x].strip()
        assert all(not s < e < z for s, z in spans(text))
    # a sentence above the limit is cut at its lines
    assert all(b - a <= 200 for a, _, b in pieces("parola che continua\n" * 100, 200, 20))
