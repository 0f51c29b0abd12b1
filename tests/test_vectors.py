"""Vector operators against brute force (quantize, Hamming, exact kNN, LSH, plan shape)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from pixlens.functions import vectors as V
from pixlens.operators import knn

DIM = 64


def _data(spark, n=300, q=5, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, DIM)).astype(np.float32)
    qs = rng.standard_normal((q, DIM)).astype(np.float32)
    idx = spark.createDataFrame([(i, x[i].tolist()) for i in range(n)], "upload_id long, embeddings array<float>")
    qdf = spark.createDataFrame([(j, qs[j].tolist()) for j in range(q)], "request_id long, qvec array<float>")
    return x, qs, idx, qdf


def test_quantize_and_hamming_match_numpy(spark):
    x, qs, idx, qdf = _data(spark, n=50, q=1)
    q = knn.prepare_queries(qdf, DIM).select(F.lit(1).alias("j"), "qcode")
    v = knn.vector_index(idx, DIM).withColumn("j", F.lit(1)).join(q, "j") \
        .select("upload_id", V.hamming("code", "qcode", DIM).alias("h")).collect()
    want = ((x > 0) != (qs[0] > 0)).sum(axis=1)
    assert all(r.h == want[r.upload_id] for r in v)


def test_exact_knn_equals_brute_force(spark):
    x, qs, idx, qdf = _data(spark)
    q = qdf.select("request_id", "qvec", F.lit(-1.0).alias("threshold"), F.lit(10).alias("limit"),
                   F.lit(0).alias("offset"))
    got = knn.search_images_embedding(q, idx, DIM).collect()
    for j in range(len(qs)):
        ham = ((x > 0) != (qs[j] > 0)).sum(axis=1)
        cand = sorted(range(len(x)), key=lambda i: (ham[i], i))[:20]
        cos = {i: float(np.dot(x[i].astype(np.float64), qs[j]) / (np.linalg.norm(x[i]) * np.linalg.norm(qs[j])))
               for i in cand}
        want = sorted(cand, key=lambda i: (-cos[i], i))[:10]
        mine = [r.upload_id for r in sorted((r for r in got if r.request_id == j), key=lambda r: r.rank)]
        assert mine == want


def test_query_blocks_give_same_answer(spark):
    _, _, idx, qdf = _data(spark, q=7)
    q = qdf.select("request_id", "qvec", F.lit(-1.0).alias("threshold"), F.lit(5).alias("limit"),
                   F.lit(0).alias("offset"))
    one = sorted(tuple(r) for r in knn.search_images_embedding(q, idx, DIM).select("request_id", "upload_id",
                                                                                    "rank").collect())
    many = sorted(tuple(r) for r in knn.search_images_embedding(q, idx, DIM, queries_per_block=2)
                  .select("request_id", "upload_id", "rank").collect())
    assert one == many


def test_lsh_returns_subset_of_candidates_with_exact_scores(spark):
    _, _, idx, qdf = _data(spark)
    q = qdf.select("request_id", "qvec", F.lit(-1.0).alias("threshold"), F.lit(10).alias("limit"),
                   F.lit(0).alias("offset"))
    got = knn.knn_lsh(q, idx, DIM, band_bits=8).collect()
    assert all(-1.0 <= r.similarity <= 1.0 for r in got)


def test_rerank_plan_has_partial_topk_and_no_cartesian(spark):
    _, _, idx, qdf = _data(spark, n=40, q=2)
    q = qdf.select("request_id", "qvec", F.lit(0.0).alias("threshold"), F.lit(5).alias("limit"),
                   F.lit(0).alias("offset"))
    plan = knn.search_images_embedding(q, idx, DIM)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_zero_vector_has_no_similarity(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>")
    assert df.select(V.cosine_similarity("a", "b").alias("c")).first().c is None


def test_lsh_equals_brute_force_and_no_pairs_leave_the_blocks(spark):
    """Ids that stand in several rows are near if any of their rows is; blocks of any size give the same."""
    rng = np.random.default_rng(5)
    x, qs = rng.standard_normal((130, DIM)).astype(np.float32), rng.standard_normal((6, DIM)).astype(np.float32)
    ids, asked = [i % 120 for i in range(130)], [0, 1, 2, 3, 4, 4]
    idx = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)] + [(500, None)], "upload_id long, embeddings array<float>")
    q = spark.createDataFrame([(j, v.tolist()) for j, v in zip(asked, qs)], "request_id long, qvec array<float>").select(
        "*", F.lit(-1.0).alias("threshold"), F.lit(4).alias("limit"), F.lit(0).alias("offset"))
    bits, qbits = (x > 0).reshape(130, 1, DIM), (qs > 0).reshape(1, 6, DIM)
    differ = bits != qbits
    near = (differ[:, :, :60].reshape(130, 6, 5, 12).sum(axis=3) <= 3).any(axis=2)
    pairs = {(j, i) for a, i in enumerate(ids) for b, j in enumerate(asked) if near[a, b]}
    for blocks in ({}, {"queries_per_block": 2, "block_cells": DIM * 16}, {"bands": knn.band_table(knn.vector_index(idx, DIM), DIM)}):
        got = knn.knn_lsh(q, idx, DIM, **blocks)
        assert "CoGroups" in got._jdf.queryExecution().executedPlan().toString()
        mine = {}
        for r in got.collect():
            assert (r.request_id, r.upload_id) in pairs
            mine.setdefault(r.request_id, set()).add(r.upload_id)
        for b, j in enumerate(asked[:4]):
            ranked = sorted((int(differ[a, b].sum()), i) for a, i in enumerate(ids) if (j, i) in pairs)[:8]
            assert mine.get(j, set()) <= {i for _, i in ranked} and len(mine.get(j, ())) == min(4, len({i for _, i in ranked}))
