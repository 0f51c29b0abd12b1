from __future__ import annotations

import math

import numpy as np

from pixlens.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank int"


def brute(rows, asked, k, scale=1024):
    q = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q.setdefault(i, {tuple(math.floor(scale * float(np.float32(x))) for x in v)})
            q[i].add(tuple(math.floor(scale * float(np.float32(x))) for x in v))
    out = set()
    for i in q:
        if not asked(i):
            continue
        for v in q[i]:
            s = sorted((-sum(a * b for a, b in zip(v, w)), j) for j in q if j != i for w in q[j])
            out |= {(i, r + 1, j, -x) for r, (x, j) in enumerate(s[:k])}
    return out


def run(spark, rows, asked, k=10, **more):
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA)
    got = topk.search(df, df.filter("vec_id % 100 = 0"), k, **more)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    return {tuple(r) for r in got.collect()}


def test_matches_brute_force_with_ties_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    hot = rng.normal(size=8).tolist()
    rows = [(i, rng.normal(size=8).tolist()) for i in range(1, 500)] + [(i, hot) for i in range(500, 820)]
    rows += [(900, None), (901, [1.0, None]), (902, [float("nan")] * 8), (1000, [float("inf")] * 8), (1100, []),
             (1200, [0.5, -0.5]), (1300, [0.0] * 8), (None, hot), (700, hot)]
    want = brute(rows, lambda i: i % 100 == 0, 10)
    assert run(spark, rows, None, rows_per_block=100, queries_per_block=3, parts=3) == want
    assert run(spark, rows, None) == want


def test_few_rows_and_empty(spark):
    rows = [(100, [1.0, 2.0]), (200, [1.0, 2.0]), (3, [-1.0, 0.0])]
    assert run(spark, rows, None) == brute(rows, lambda i: i % 100 == 0, 10)
    assert run(spark, [(100, [1.0])], None) == set()
    assert run(spark, [], None) == set()


def test_components_whose_scores_pass_64_bits_raise(spark):
    import pytest

    big = [float(2 ** 21)] * 64
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(100, big), (3, big)], None)
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(100, [1.0]), (3, [1e30])], None)
    edge = [float(2 ** 17)] * 64  # 2**27 a component, 2**60 a score
    assert run(spark, [(100, edge), (3, edge)], None) == {(100, 1, 3, 2 ** 60)}
