import random

from hypothesis import given as forall
from hypothesis import strategies as st

from lexweave.llm import metric


def edits(a, b):
    """Damerau-Levenshtein by its recurrence."""
    most = len(a) + len(b)
    h, row_of = {(-1, -1): most}, {}
    h |= {(i, -1): most for i in range(len(a) + 1)} | {(i, 0): i for i in range(len(a) + 1)} | {(-1, j): most for j in range(len(b) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, x in enumerate(a, 1):
        at = 0
        for j, y in enumerate(b, 1):
            k, m = row_of.get(y, 0), at
            if x == y:
                at = j
            h[i, j] = min(h[i - 1, j - 1] + (x != y), h[i, j - 1] + 1, h[i - 1, j] + 1, h[k - 1, m - 1] + i - k - 1 + 1 + j - m - 1)
        row_of[x] = i
    return h[len(a), len(b)]


@forall(st.lists(st.text("abc", max_size=7), min_size=1, max_size=5), st.text("abc", max_size=7))
def test_distances(xs, p):
    assert metric.distances(*metric.matrix(xs), *metric.matrix([p])).tolist() == [edits(x, p) for x in xs]
    assert [metric.one_edit(x, p) for x in xs] == [edits(x, p) <= 1 for x in xs]


def names(n, seed=3):
    rnd = random.Random(seed)
    out = set()
    while len(out) < n:
        w = "".join(rnd.choice("bcdfglmnprstvz") + rnd.choice("aeiou") for _ in range(rnd.randint(3, 6)))
        out.add(w)
        p = rnd.randrange(len(w))
        out.add(rnd.choice([w[:p] + w[p + 1 :], w[:p] + "x" + w[p:], w[:p] + "y" + w[p + 1 :], w[:p] + w[p : p + 2][::-1] + w[p + 2 :]]))
    return sorted(out)[:n]


def pairs(strings):
    return {tuple(sorted(z)) for a, b in metric.close(strings) for z in zip(a, b)}


def test_close_equals_all_pairs():
    rnd = random.Random(1)
    xs = sorted({"".join(rnd.choices("abc\U0001f600", k=rnd.randint(0, 6))) for _ in range(300)})
    assert pairs(xs) == {(a, b) for a in xs for b in xs if a < b and edits(a, b) <= 1}
    long = ["v" * 50_000, "v" * 49_999, "v" * 40_000, "w" + "v" * 49_999]
    assert len(pairs(long)) == 3


def test_join_over_many_cells_loses_nothing(spark):
    xs = names(3000) + ["", "a", "z" * 127, "z" * 128, "z" * 129, "z" * 130, "q" * 400, "q" * 401]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,)], "core string")
    placed = metric.cells(df, 200).toPandas()
    sizes = placed.groupby("cell").size()
    assert (len(sizes) > 15, sizes.max() <= 200, len(placed) < 8 * len(xs)) == (True, True, True), (len(sizes), sizes.max(), len(placed))
    got = {(r.a, r.b) for r in metric.radius_join(df, 200).collect()}
    want = pairs(xs)
    assert got == want | {(b, a) for a, b in want} and len(want) > 500
    assert metric.radius_join(df.limit(0)).count() == 0


def test_cells_no_pivot_splits(spark):
    xs = [chr(0x4E00 + i) for i in range(300)]  # all one edit from each other
    assert metric.radius_join(spark.createDataFrame([(x,) for x in xs], "core string"), 100).count() == 300 * 299
