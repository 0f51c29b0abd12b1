"""Approximate search over cells: recall against the exact search, pairs scored, hot cells, odd vectors."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from pixlens.operators import cells, knn


def clustered(n, dim, groups, seed=1, noise=0.35):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((groups, dim))
    return (centres[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, dim))).astype(np.float32)


def frames(spark, x, q, dim):
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "upload_id long, embeddings array<float>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "request_id long, qvec array<float>").select(
        "*", F.lit(-1.0).alias("threshold"), F.lit(20).alias("limit"), F.lit(0).alias("offset"))
    return knn.vector_index(index, dim).cache(), asked, index


def recall(exact, found):
    a = {(r.request_id, r.upload_id) for r in exact.collect()}
    return len(a & {(r.request_id, r.upload_id) for r in found.collect()}) / len(a)


@pytest.mark.parametrize("dim,groups", [(64, 60), (512, 40)])
def test_recall_and_pruning_on_clustered_vectors(spark, dim, groups, tmp_path):
    x = clustered(3000, dim, groups)
    vindex, asked, index = frames(spark, x, x[::100], dim)
    model = cells.fit(vindex, dim)
    cells.write_cells(cells.assign(vindex, model), str(tmp_path / "cells"))
    images = cells.read_cells(spark, str(tmp_path / "cells"))
    assert images.count() == 3000
    exact = knn.search_images_embedding(asked, index, dim, vindex)
    found = cells.search(asked, images, model, dim)
    assert recall(exact, found) >= 0.9
    assert cells.share_of_pairs(asked, images, model) < 0.1


def test_all_cells_give_the_exact_answer_in_small_blocks(spark):
    x = clustered(400, 32, 8, seed=2)
    vindex, asked, index = frames(spark, x, x[:30], 32)
    model = cells.fit(vindex, 32, cells=10, sample_values=32 * 200)
    found = cells.search(asked, cells.assign(vindex, model), model, 32, probes=10, queries_per_block=4, block_cells=32 * 20)
    want = knn.search_images_embedding(asked, index, 32, vindex)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_vectors_without_structure_need_many_probes(spark):
    x = np.random.default_rng(3).standard_normal((600, 48)).astype(np.float32)
    vindex, asked, index = frames(spark, x, x[::12], 48)
    model = cells.fit(vindex, 48)
    images = cells.assign(vindex, model)
    assert recall(knn.search_images_embedding(asked, index, 48, vindex), cells.search(asked, images, model, 48)) >= 0.85
    assert cells.share_of_pairs(asked, images, model) > 0.3


def test_hot_cell_zero_vectors_and_empty_index(spark):
    x = np.vstack([np.tile(np.arange(1, 9, dtype=np.float32), (90, 1)), np.zeros((3, 8), np.float32),
                   np.random.default_rng(4).standard_normal((40, 8)).astype(np.float32)])
    vindex, asked, index = frames(spark, x, x[[0, 95, 91]], 8)
    model = cells.fit(vindex, 8)
    found = cells.search(asked, cells.assign(vindex, model), model, 8, block_cells=80).collect()
    assert [r.upload_id for r in sorted((r for r in found if r.request_id == 0), key=lambda r: r["rank"])] == list(range(20))
    none = vindex.limit(0)
    model = cells.fit(none, 8)
    assert cells.search(asked, cells.assign(none, model), model, 8).collect() == []


def test_small_cells_share_a_block_and_large_ones_are_cut(spark):
    """A request goes once to a block, however many of its cells are there."""
    sizes = {0: 3, 1: 4, 2: 25, 3: 2, 4: 8}
    images = spark.createDataFrame([(c,) for c, n in sizes.items() for _ in range(n)], "cell int")
    assert cells._blocks(images, 10) == [(0, 0, 1), (1, 0, 1), (2, 1, 3), (3, 4, 1), (4, 4, 1)]
