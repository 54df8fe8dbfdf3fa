"""Searches over vectors against brute force."""

import numpy as np
import pytest

from triplicate.llm import inner_products, nearest


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(900, 12)).astype(np.float32)
    x[300:500] = x[7]  # copies of one vector
    data = [(i, [float(v) for v in r], 1) for i, r in enumerate(x)]
    data += [(1000, None, 1), (1100, [float("nan")] * 12, 1), (1200, [0.0] * 12, 1), (1300, [None] + [1.0] * 11, 1), (1400, [float("inf")] * 12, 1)]
    return spark.createDataFrame(data, "vec_id long, embedding array<float>, rank int").cache(), x.astype(float)


def test_inner_products(rows):
    df, x = rows
    found = {}
    for r in inner_products.search(df).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    whole = np.floor(1024 * np.vstack([x, np.zeros((1, 12))])).astype(np.int64)
    ids = np.array([*range(len(x)), 1200])
    assert set(found) == {*range(0, 900, 100), 1200}
    for q, got in found.items():
        scores = whole @ whole[np.flatnonzero(ids == q)[0]]
        order = [i for i in np.lexsort((ids, -scores)) if ids[i] != q][:10]
        assert sorted(got) == [(k + 1, ids[i], scores[i]) for k, i in enumerate(order)]


def test_nearest(rows):
    df, x = rows
    hits = total = 0
    found = {}
    for r in nearest.search(df).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == set(range(0, 900, 100))
    for q, got in found.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        best = [i for i in np.lexsort((np.arange(len(x)), d)) if i != q][:10]
        assert [k for k, _, _ in sorted(got)] == list(range(1, 11))
        assert all(abs(s - d[v]) < 1e-12 for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(best))
        total += 10
    assert hits / total >= 0.9


def test_few_and_none(spark):
    few = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    assert [(r.rank, r.vec_id) for r in nearest.search(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert [(r.rank, r.vec_id) for r in inner_products.search(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    none = few.where("vec_id < 0")
    assert nearest.search(none).count() == 0 and inner_products.search(none).count() == 0


def test_repeated_rows_are_one_query_and_one_candidate(spark):
    rows = [(0, [1.0, 0.0])] * 3 + [(i, [1.0, i / 100]) for i in range(1, 30)] * 2 + [(0, [5.0, 5.0]), (7, [9.0, 9.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    near = nearest.search(df, parts=1, probes=1).orderBy("query_id", "rank").collect()
    by = {}
    for i, v in rows:
        if i:
            d = min(np.hypot(v[0] - 1, v[1]), np.hypot(v[0] - 5, v[1] - 5))
            by[i] = min(by.get(i, np.inf), d)
    best = sorted(by.items(), key=lambda t: (t[1], t[0]))[:10]
    assert [(r.query_id, r.rank, r.vec_id) for r in near] == [(0, k + 1, i) for k, (i, _) in enumerate(best)]
    assert np.allclose([r.score for r in near], [d for _, d in best])
    product = lambda v, q: sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, q))
    by = {}
    for i, v in rows:
        if i:
            by[i] = max(by.get(i, 0), product(v, [1.0, 0.0]), product(v, [5.0, 5.0]))
    best = sorted(by.items(), key=lambda t: (-t[1], t[0]))[:10]
    found = inner_products.search(df).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, r.score) for r in found] == [(0, k + 1, i, s) for k, (i, s) in enumerate(best)]


def test_large_values_and_unequal_widths(spark):
    rows = [(0, [1e17, 1.0]), (1, [1.0, 3.0]), (2, [-1.0, 0.5]), (3, [1e200, 1.0]), (4, [2.0]), (5, [0.0, 0.0, 7.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = lambda v: [int(np.floor(1024 * a)) if abs(a) < 1e12 else int(1024 * a) for a in v]
    cut = lambda n: min(max(n, -(2**63)), 2**63 - 1)
    scores = {i: cut(sum(a * b for a, b in zip(whole(v), whole(rows[0][1])))) for i, v in rows[1:]}
    found = inner_products.search(df).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in found] == sorted(scores.items(), key=lambda t: (-t[1], t[0]))
    near = nearest.search(df).orderBy("rank").collect()
    assert {r.vec_id for r in near} == {1, 2, 3, 4, 5} and near[-1].vec_id == 3 and near[-1].score == float("inf")


def test_inner_products_of_several_bands_and_groups(spark, monkeypatch):
    monkeypatch.setattr(inner_products, "QUERIES", 3)
    monkeypatch.setattr(inner_products, "BLOCK", 40)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 6)) * np.exp(rng.normal(size=(400, 1)))
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    whole = np.floor(1024 * x).astype(np.int64)
    found = {}
    for r in inner_products.search(df, every=20).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    for q in range(0, 400, 20):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(400), -scores)) if i != q][:10]
        assert sorted(found[q]) == [(k + 1, i, scores[i]) for k, i in enumerate(order)]
