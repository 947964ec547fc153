from bisect import bisect_left, insort
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from lexweave.llm import pack, tokenize


def best_fit_decreasing(sizes, capacity):
    """One by one: the remaining capacities of all containers."""
    open_ = []
    for s in sorted(sizes, reverse=True):
        i = bisect_left(open_, s)
        r = open_.pop(i) if i < len(open_) else capacity
        insort(open_, r - s)
    return sorted(open_)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.sampled_from([30, 37, 64]))
def test_plan_equals_one_by_one(sizes, capacity):
    fill, seen = Counter(), Counter()
    for s, rank, n, first, k, before in pack.plan(Counter(sizes), capacity).tolist():
        for i in range(n):
            assert fill[first + i // k] == before + i % k * s
            fill[first + i // k] += s
            seen[s, rank + i] += 1
    assert max(seen.values(), default=1) == 1 and Counter(s for s, _ in seen) == Counter(sizes)
    assert sorted(capacity - v for v in fill.values()) == best_fit_decreasing(sizes, capacity)


def test_frame(spark):
    texts = ["uno due tre " * k for k in (0, 1, 2, 3, 5, 8, 40, 40, 3)] + [None, "\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)) + [(3, texts[3])], "doc_id long, text string").selectExpr("*", "1 AS id", "2 AS size", "'x' AS container")
    rows = pack.pack(df, "doc_id", "text", capacity=50).collect()
    want = {r.doc_id: r.n_tokens for r in tokenize.token_counts(df, "doc_id", "text").collect() if r.n_tokens}
    got, fill = Counter(), {}
    for r in rows:
        n = r.token_to - r.token_from
        got[r.doc_id] += n
        assert 0 < n <= 50 and (want[r.doc_id] > 50 or r.token_from == 0)
        fill.setdefault(r.container, []).append((r.fill_from, r.fill_from + n))
    assert got == Counter(want) + Counter({3: want[3]})
    for c in fill.values():
        c.sort()
        assert c[0][0] == 0 and all(a[1] == b[0] for a, b in zip(c, c[1:])) and c[-1][1] <= 50
    sizes = [r.token_to - r.token_from for r in rows]
    assert len(fill) == len(best_fit_decreasing(sizes, 50))
    assert pack.pack(df.limit(0), "doc_id", "text").count() == 0
