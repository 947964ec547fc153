import random

import pytest

from lexweave.llm import neardup as nd


def brute(rows, k=3, threshold=0.6, least=10):
    sets = {}
    for i, t in rows:
        w = nd.words(t)
        if len(w) >= least:
            sets[i] = set(zip(*(w[j:] for j in range(k))))
    ids = sorted(sets)
    return {(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b])}


def corpus(seed=1, families=60):
    rnd = random.Random(seed)
    vocabulary = [f"parola{i}" for i in range(400)]
    rows = []
    for f in range(families):
        base = rnd.choices(vocabulary, k=rnd.randint(12, 80))
        for v in range(rnd.randint(1, 5)):
            w = list(base)
            for _ in range(rnd.randint(0, 5)):
                p = rnd.randrange(len(w))
                w[p : p + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 2))
            rows.append((f"c{f:03d}-{v}", " ".join(w)))
    return rows + [("n", None), ("e", ""), ("b", " \n"), ("s", "solo tre parole"), ("s2", "solo tre parole")]


def found(spark, rows):
    df = spark.createDataFrame(rows, "chunk_id string, text string").selectExpr("*", "1 AS id", "2 AS cls", "3 AS a")
    return {tuple(r) for r in nd.near_pairs(df, "chunk_id", "text").collect()}, df


def test_pairs_equal_brute_force(spark):
    rows = corpus()
    got, df = found(spark, rows)
    want = brute(rows)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 50
    classes = {r.chunk_id: r for r in nd.near_classes(df, "chunk_id", "text").collect()}
    assert len(classes) == len(rows) and classes["n"].class_id is None and classes["s"].links == 0
    linked = {x for p in got for x in p}
    assert all((classes[i].links > 0 or classes[i].copies > 1) == (i in linked) for i, _ in rows)


def test_exact_way_for_long_runs(spark, monkeypatch):
    rows = corpus(2, 30)
    want = brute(rows)
    import pyspark.cloudpickle as cp

    cp.register_pickle_by_value(nd)  # so that the workers see the small limit
    try:
        monkeypatch.setattr(nd, "RUN", 1)
        got, _ = found(spark, rows)
    finally:
        cp.unregister_pickle_by_value(nd)
    assert got <= want and len(got) >= 0.98 * len(want)


def test_hot_copies_and_empty(spark):
    text = " ".join(f"w{i}" for i in range(20))
    got, df = found(spark, [(f"x{i:02d}", text) for i in range(12)] + [("y", text + " fine"), ("y", text + " fine")])
    assert len(got) == 12 * 11 // 2 + 12
    assert nd.near_pairs(df.limit(0), "chunk_id", "text").count() == 0
    assert nd.near_classes(df.limit(0), "chunk_id", "text").count() == 0


@pytest.mark.parametrize("text", ["Città d’Olbra 12a", "विशेषज्ञ ने", "ไทย ศาล", "état", "a_b"])
def test_words_are_letters_marks_digits(text):
    import unicodedata

    got, cur = [], ""
    for ch in text.lower() + " ":
        if unicodedata.category(ch)[0] in "LMN":
            cur += ch
        elif cur:
            got.append(cur)
            cur = ""
    assert nd.words(text) == got


def test_boilerplate_shared_by_different_texts(spark, monkeypatch):
    rnd = random.Random(4)
    boilerplate = " ".join(f"clausola{i}" for i in range(60))
    rows = [(f"h{i:02d}", boilerplate + " " + " ".join(rnd.choices("abcdefgh", k=rnd.randint(3, 6)))) for i in range(40)] + corpus(6, 20)
    want = brute(rows)
    import pyspark.cloudpickle as cp

    cp.register_pickle_by_value(nd)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        monkeypatch.setattr(nd, "SAMPLED", 1)
        monkeypatch.setattr(nd, "RUN", 10)
        spark.conf.set("spark.sql.shuffle.partitions", "120")
        assert nd.frequent_keys(spark.createDataFrame(rows, "chunk_id string, text string").select("text").where("text IS NOT NULL")) != []
        got, _ = found(spark, rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        cp.unregister_pickle_by_value(nd)
    assert got <= want and len(got) >= 0.98 * len(want) and len(want) > 700
