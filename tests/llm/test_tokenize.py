import random

import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import tokenize as tk


def reference():
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=tk.encoder(tk.default_vocabulary()).ranks, special_tokens={})


REF = reference()
PIECES = ["'s", "'ll", "'re", "'", " ", "  ", "\n", "\t", "\r\n", "a", "don't", "l’art. 5", "12", "³", "é", "é", "日本", "ไทย", " ", " ", "　", "\x1c", "😀", "!!", " 's", "\n's", "''s", "x'll y", "'lla", "​", "।"]


def check(texts):
    ids, counts, off = tk.encode_batch(texts, tk.default_vocabulary(), offsets=True)
    at = 0
    for t, n in zip(texts, counts):
        got = ids[at : at + n].tolist()
        assert got == (REF.encode_ordinary(t) if t else []), t
        assert tk.decode(got, tk.default_vocabulary()) == (t or "")
        o = off[at : at + n].tolist()
        assert o == sorted(o) and (not o or o[0] == 0)
        at += n
    assert at == len(ids)


def test_mixed_pieces():
    rnd = random.Random(5)
    check([None, "", *("".join(rnd.choices(PIECES, k=rnd.randint(1, 12))) for _ in range(4000))])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(texts):
    check(texts)


def test_long_texts(monkeypatch):
    monkeypatch.setattr(tk, "BLOCK", 50)
    rnd = random.Random(6)
    check(["".join(rnd.choices(PIECES, k=200)) for _ in range(50)])
    check(["x" * 3000, "\n" * 500 + "a", "ab " * 1000])


def test_frame(spark):
    df = spark.createDataFrame([(1, "L'art. 5", "x"), (2, None, "y"), (None, "", "z"), (1, "L'art. 5", "x")], "doc_id long, text string, ids string")
    rows = tk.encode(df, "doc_id", "text").collect()
    assert [r.doc_id for r in rows] == [1, 2, None, 1]
    assert [r.ids for r in rows] == [REF.encode_ordinary("L'art. 5"), [], [], REF.encode_ordinary("L'art. 5")]
    assert tk.encode(df.limit(0), "doc_id", "text").count() == 0
    assert [r.n_tokens for r in tk.token_counts(df, "doc_id", "text").collect()] == [len(rows[0].ids), 0, 0, len(rows[0].ids)]
