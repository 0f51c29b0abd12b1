"""Cumulative pages against one search per page, also for pages far beyond the results."""

from __future__ import annotations

from pathlib import Path

import numpy as np
from conftest import forum, index_row, post, topic, upload

from pixlens.config import Settings
from pixlens.operators import search as se
from pixlens.plans.catalog import oracle_sql
from pixlens.plans.search_queries import pages_cumulative

from test_search import requests

CFG = Settings(embedding_dim=8, text_similarity_threshold=0.1, image_similarity_threshold=0.0)
FAR = 200_000_000


def test_pages_equal_one_search_per_page(spark):
    rng = np.random.default_rng(5)
    n = 90
    vecs = rng.standard_normal((n, 8)).astype(np.float32).tolist()
    t = forum(
        spark, topics=[topic(1), topic(2)], users=[(1, "Alice", "alice", False), (2, "Bob", "bob", False)],
        posts=[post(100 + i, 1 + i % 2, user_id=1 + i % 2) for i in range(60)],
        uploads=[upload(i) for i in range(n)],
        post_uploads=[(100 + (i * 7 + k) % 60, i) for i in range(n) for k in range(1 + i % 2)],
        index=[index_row(i, ocr_text="a car" if i % 3 else "plane", embeddings=vecs[i]) for i in range(n)])
    rows = [(1, "GET", "car", None, None, "true", "true"), (2, "GET", "car @bob", None, None, "true", "false"),
            (3, "GET", "x", None, None, "false", "true"), (4, "POST", None, "img", "image/png", None, None),
            (5, "GET", "x topic:1", None, None, "false", "true")]
    deep = [(*r, FAR if r[0] != 5 else 3, None) for r in rows] + [
        (6, "GET", "car", None, None, "true", "true", 0, None), (7, "GET", None, None, None, None, None, 5, None),
        (8, "GET", "car", None, None, "true", "true", None, None)]
    qv = [(r[0], rng.standard_normal(8).astype(np.float32).tolist()) for r in deep]
    vectors = spark.createDataFrame(qv, "request_id long, qvec array<float>")
    got = se.cumulative_pages(requests(spark, deep), t, CFG, vectors, limit=4).collect()

    pages = 60  # beyond the last result of every request
    single = [(r[0] * 1000 + p, *r[1:7], p, None) for r in deep for p in range(min(r[7] or 0, pages) + 1)]
    own = spark.createDataFrame([(r[0], dict(qv)[r[0] // 1000]) for r in single], "request_id long, qvec array<float>")
    want = [(r.request_id // 1000, r.request_id % 1000, r.rank, r.post_id, r.upload_id)
            for r in se.search(requests(spark, single), t, CFG, own, limit=4).results.collect()]
    assert max(p for _, p, *_ in want) < pages - 1
    assert {1, 2, 4} <= {r for r, p, *_ in want if p > 3}
    assert sorted(tuple(r) for r in got) == sorted(want)


def test_query_equals_its_sql_beyond_page_100(spark):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}')")
    cols = "request_id, page_no, rank, post_id, upload_id"
    want = con.execute(f"SELECT {cols} FROM ({oracle_sql()['pages_cumulative']})").fetchall()
    got = [tuple(r) for r in pages_cumulative(spark, folder).select(*cols.split(", ")).collect()]
    assert any(r[0] == 21 for r in want)
    assert sorted(got) == sorted(want)
