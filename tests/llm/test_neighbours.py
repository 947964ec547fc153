import math

import numpy as np

from lexweave.llm import neighbours as nb


def clustered(n=1500, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(25, dim))
    v = centre[rng.integers(25, size=n)] + 0.6 * rng.normal(size=(n, dim))
    v[100:140] = v[100] + 0.05 * rng.normal(size=(40, dim))
    v[200:212] = 3 * v[200]  # copies of differing norm
    v[200:206] /= 3
    return v


def brute(v, k):
    u = v / np.linalg.norm(v, axis=1)[:, None]
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, np.argsort(-s, axis=1, kind="stable")[:, :k]


def test_recall_and_found(spark):
    v = clustered()
    rows = [(f"n{i:05d}", [float(x) for x in r]) for i, r in enumerate(v)]
    bad = [("x1", None), ("x2", [1.0] * 15), ("x3", [0.0] * 16), ("x4", [math.nan] * 16), ("x5", [1.0] * 15 + [math.inf]), ("x6", [None] + [1.0] * 15), ("x7", [])]
    df = spark.createDataFrame(rows + bad, "node_id string, embedding array<float>").selectExpr("*", "1 AS id", "2 AS cls", "3 AS list")
    s, top = brute(v, 5)
    got = {}
    for r in nb.nearest(df, "node_id", "embedding", dim=16, list_size=60).collect():
        got.setdefault(int(r.node_id[1:]), []).append((int(r.near_id[1:]), r.similarity))
    assert set(got) == set(range(len(v))) and all(len(g) == 5 for g in got.values())
    hits = sum(s[i, j] >= s[i, top[i, 4]] - 1e-5 for i, g in got.items() for j, _ in g)
    assert hits >= 0.95 * 5 * len(v)
    assert all(abs(s[i, j] - x) < 1e-4 for i, g in got.items() for j, x in g)
    # copies: the smaller ids
    assert [j for j, _ in sorted(got[211])] == [200, 201, 202, 203, 204]
    pairs = {tuple(r) for r in nb.close_pairs(df, "node_id", "embedding", dim=16).collect()}
    want = set()
    for i in range(len(v)):
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-round(s[i, j], 5), j))[:5]
        want |= {(f"n{min(i, j):05d}", f"n{max(i, j):05d}") for j in order if s[i, j] >= 0.9}
    assert len(pairs & want) >= 0.98 * len(want) and len(pairs - want) <= 0.02 * len(want) and len(want) > 60


def test_queries_and_empty(spark):
    df = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(40)], "id long, embedding array<float>")
    got = nb.nearest(df, "id", "embedding", k=2, dim=2, query="id % 20 = 0").collect()
    assert sorted({r.id for r in got}) == [0, 20] and len(got) == 4
    assert nb.nearest(df.limit(0), "id", "embedding", dim=2).count() == 0
    assert nb.nearest(df.where("id = 3"), "id", "embedding", dim=2).count() == 0
    assert nb.nearest(df, "id", "embedding", dim=64).count() == 0


def test_lists_are_balanced():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(4000, 8)), 0.01 * rng.normal(size=(2000, 8)) + 5])
    lists = nb.Lists(x.astype(np.float32), 50)
    a = np.argmax(x @ lists.centroids.T - 0.5 * (lists.centroids**2).sum(1), axis=1)
    assert np.bincount(a).max() <= 200
    ids, d = lists.search(x[:500].astype(np.float32), 5)
    assert (ids[:, 0] == a[:500]).mean() > 0.8 and (np.diff(d, axis=1) >= 0).all()


def test_blocks_of_long_lists_change_nothing(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(rng.normal(size=(600, 8)))], "id long, embedding array<double>")
    one, many = ({(r.id, r.near_id) for r in nb.nearest(df, "id", "embedding", k=3, dim=8, list_size=60, most=m).collect()} for m in (20_000, 40))
    assert one == many and len(one) == 1800
