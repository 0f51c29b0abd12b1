from __future__ import annotations

import math

import numpy as np
import pytest

from pixlens.llm import whiten

SCHEMA = "vec_id long, embedding array<float>, n long, component string, identity_error int"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", 1) for i, v in rows], SCHEMA)


def brute(rows, k=8):
    """{(vec_id, component): (deviation, |whitened|, explained)} by a dense eigendecomposition."""
    ok = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for _, v in ok]
    n, s = len(x), [sum(c) for c in zip(*x)]
    y = np.array([[(n * c - t) / n for c, t in zip(r, s)] for r in x])
    values, vectors = np.linalg.eigh(y.T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(k, int((values > values[0] * 1e-12).sum()))
    w = y @ vectors[:, :k] / np.sqrt(values[:k])
    return {(i, j + 1): (sum((n * c - t) ** 2 for c, t in zip(r, s)), abs(w[a, j]), values[j] / values.sum())
            for a, ((i, _), r) in enumerate(zip(ok, x)) for j in range(k)}


def check(spark, rows, parts=5, want_error=1e-9):
    got = whiten.whiten(frame(spark, rows).repartition(parts)).collect()
    want = brute(rows)
    assert {(r.vec_id, r.component) for r in got} == set(want) and len(got) >= len(want)
    for r in got:
        dev, w, e = want[r.vec_id, r.component]
        assert r.deviation == dev and r.deviation_exact == str(dev)
        assert abs(abs(r.whitened) - w) < 1e-6 * max(1, w)
        assert abs(r.explained - e) < 1e-9
        assert r.identity_error < want_error
    # One sign per component: whitened values agree up to it.
    return got


def random_rows(n=400, d=12, seed=1):
    rng = np.random.default_rng(seed)
    spread = 0.02 * 1.4 ** np.arange(d)
    return [(i, (rng.normal(size=d) * spread).tolist()) for i in range(n)]


def test_matches_a_dense_decomposition(spark):
    check(spark, random_rows())


def test_odd_vectors_take_no_part_and_hot_copies_count(spark):
    rows = random_rows()
    hot = rows[3][1]
    odd = [(900, None), (901, []), (902, [1.0] * 11 + [None]), (903, [float("nan")] * 12), (904, [float("inf")] * 12)]
    check(spark, rows + odd + [(1000 + i, hot) for i in range(200)], parts=7)


def test_other_lengths_and_repeated_rows(spark):
    rows = random_rows(60, 4)
    got = whiten.whiten(frame(spark, [*rows, (5, rows[5][1]), (500, [1.0, 2.0])])).collect()
    assert {r.vec_id for r in got} == set(range(60)) and {r.n for r in got} == {61}
    assert sum(r.vec_id == 5 for r in got) == 8


def test_rank_deficient_constant_and_empty(spark):
    rng = np.random.default_rng(2)
    low = [(i, (rng.normal() * np.array([.5, .25, 0, .125])).tolist()) for i in range(50)]
    got = whiten.whiten(frame(spark, low)).collect()
    assert max(r.component for r in got) <= 3 and {r.component for r in got} >= {1}
    assert whiten.whiten(frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect() == []
    assert whiten.whiten(frame(spark, [])).collect() == []
    assert whiten.whiten(frame(spark, [(1, None)])).collect() == []


def test_deviation_beyond_64_bits(spark):
    rows = [(i, [float(2 ** 30 * (i % 2)), float(i)]) for i in range(40)]
    got = whiten.whiten(frame(spark, rows)).collect()
    want = brute(rows, 2)
    for r in got:
        assert r.deviation_exact == str(want[r.vec_id, 1][0])
        assert r.deviation is None
    with pytest.raises(Exception, match="2\\*\\*42"):
        whiten.whiten(frame(spark, [(1, [1e20]), (2, [0.0])])).collect()


@pytest.mark.parametrize("seed", range(4))
def test_rank_one_updates_reproduce_the_scatter(seed):
    rng = np.random.default_rng(seed)
    d = 9
    x = np.floor(rng.normal(size=(64, d)) * 1000).astype(np.int64)
    x[:, 2] = x[:, 5]
    x[:, 7] = 4
    s, other = whiten.Spectrum.empty(d), whiten.Spectrum.empty(d)
    s.add(x[:10])
    s.add(x[10:11])
    other.add(x[11:])
    s.merge(other)
    y = x - x.mean(axis=0)
    assert np.allclose(s.vectors * s.values @ s.vectors.T, y.T @ y, atol=1e-9 * (y * y).sum())
    assert np.allclose(s.vectors.T @ s.vectors, np.eye(d), atol=1e-12)


def test_merge_of_many_tasks(spark):
    check(spark, random_rows(600, 6, 3), parts=40)
