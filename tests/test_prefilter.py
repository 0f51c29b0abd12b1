"""Filters below the vector top-k, deep pages, and the search width."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from conftest import category, forum, index_row, post, topic, upload
from pyspark.sql import functions as F

from pixlens.config import Settings
from pixlens.operators import knn, prefilter
from pixlens.operators import search as se
from pixlens.operators.ordering import rank_by_score

from test_search import requests

CFG = Settings(embedding_dim=8, text_similarity_threshold=-1.0, image_similarity_threshold=-1.0)
T0 = dt.datetime(2024, 1, 1)
N = 120


def vectors(seed=3):
    rng = np.random.default_rng(seed)
    return rng.standard_normal((N, 8)).astype(np.float32)


def big_forum(spark, vecs):
    """120 images; post 500 + i holds image i and post 900 holds all; topic 3 has the tag."""
    return forum(
        spark, categories=[category(1, "cars"), category(2, "sub", parent=1), category(3, "else")],
        topics=[topic(1, 1), topic(2, 2), topic(3, 3)], tags=[(1, "vip"), (2, "old")], topic_tags=[(3, 1), (1, 2)],
        users=[(1, "Alice", "alice", False), (2, "Bob", "bob", False), (3, "Eve", "eve", False)],
        posts=[post(500 + i, 1 + i % 3, user_id=1 + i % 2, created_at=T0 + dt.timedelta(days=i)) for i in range(N)]
        + [post(900, 3, user_id=3, created_at=T0 - dt.timedelta(days=9))],
        uploads=[upload(i) for i in range(N)],
        post_uploads=[(500 + i, i) for i in range(N)] + [(900, i) for i in range(0, N, 4)],
        index=[index_row(i, embeddings=None if i == 7 else vecs[i].tolist()) for i in range(N)])


def passes(i, kind):
    """Whether image i has a post that passes the filter."""
    own = {"topic": i % 3 + 1, "user": 1 + i % 2, "day": i}
    all4 = i % 4 == 0
    return {"topic:2": own["topic"] == 2, "@bob": own["user"] == 2, "tags:vip,none": own["topic"] == 3 or all4,
            "#=cars": own["topic"] == 1, "#cars": own["topic"] in (1, 2), "after:2024-03": own["day"] > 60,
            "before:2023-12-31": all4, "topic:2 @bob": own["topic"] == 2 and own["user"] == 2, "@nobody": False,
            "before:x": True, "@eve topic:3": all4, "": True}[kind]


KINDS = ["topic:2", "@bob", "tags:vip,none", "#=cars", "#cars", "after:2024-03", "before:2023-12-31", "topic:2 @bob", "@nobody",
         "before:x", "@eve topic:3", ""]


@pytest.mark.parametrize("per_row", [512, 1])
def test_filtered_requests_fill_their_pages(spark, monkeypatch, per_row):
    monkeypatch.setattr(prefilter, "POSTS_PER_ROW", per_row)
    vecs, t = vectors(), None
    t = big_forum(spark, vecs)
    rng = np.random.default_rng(9)
    rows = [(i, "GET", f"x {k}".strip(), None, None, "false", "true", page, None)
            for i, (k, page) in enumerate((k, p) for k in KINDS for p in (0, 1))]
    qs = {r[0]: rng.standard_normal(8).astype(np.float32) for r in rows}
    qv = spark.createDataFrame([(i, v.tolist()) for i, v in qs.items()], "request_id long, qvec array<float>")
    out = se.search(requests(spark, rows), t, CFG, qv, limit=6, prefilter=True).results.collect()
    got = {}
    for r in sorted(out, key=lambda r: r.rank):
        got.setdefault(r.request_id, [])
        if r.upload_id not in got[r.request_id]:
            got[r.request_id].append(r.upload_id)
    for i, (k, page) in enumerate((k, p) for k in KINDS for p in (0, 1)):
        ok = [j for j in range(N) if j != 7 and passes(j, k)]
        ham = {j: int(((vecs[j] > 0) != (qs[i] > 0)).sum()) for j in ok}
        cand = sorted(ok, key=lambda j: (ham[j], j))[:12 + 6 * page]
        cos = {j: float(np.dot(vecs[j].astype(float), qs[i].astype(float)) / np.linalg.norm(vecs[j].astype(float))) for j in cand}
        want = sorted(cand, key=lambda j: (-cos[j], j))[6 * page:6 * page + 6]
        assert got.get(i, []) == want, (k, page)
        if len(ok) >= 6 * page + 6:
            assert len(want) == 6


def test_without_prefilter_the_page_comes_back_short(spark):
    vecs = vectors()
    t = big_forum(spark, vecs)
    qv = spark.createDataFrame([(0, vecs[1].tolist())], "request_id long, qvec array<float>")
    r = requests(spark, [(0, "GET", "x topic:2 @bob", None, None, "false", "true", 0, None)])
    short = se.search(r, t, CFG, qv, limit=6).results.count()
    assert short < se.search(r, t, CFG, qv, limit=6, prefilter=True).results.count() == 6


def test_deep_selection_equals_the_window(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(r, int(u), int(h), k) for r, k in ((1, 50), (2, 400), (3, 3), (4, 1000)) for u, h in
            zip(rng.permutation(500), rng.integers(0, 9, 500))]
    cands = spark.createDataFrame(rows, knn.CANDS_DDL)
    flat = {tuple(r) for r in knn.select_candidates(cands, 1000).select("request_id", "upload_id", "cand_rank").collect()}
    monkeypatch.setattr(knn, "SHALLOW", 0)
    deep = {tuple(r) for r in knn.select_candidates(cands, 1000).select("request_id", "upload_id", "cand_rank").collect()}
    assert flat == deep and len(deep) == 50 + 400 + 3 + 500


def test_rank_by_score_equals_a_sort(spark):
    rng = np.random.default_rng(5)
    scores = np.concatenate([rng.uniform(-1, 1, 300), np.full(200, 0.25), [1.0, -1.0, 1.0]])
    rows = [(g, i, float(s)) for g in (1, 2) for i, s in enumerate(scores)]
    got = rank_by_score(spark.createDataFrame(rows, "g long, id long, s double"), "g", "s", "id").collect()
    want = sorted(range(len(scores)), key=lambda i: (-scores[i], i))
    for g in (1, 2):
        assert [r.id for r in sorted((r for r in got if r.g == g), key=lambda r: r["rank"])] == want
        assert sorted(r["rank"] for r in got if r.g == g) == list(range(1, len(scores) + 1))


def test_deep_pages_equal_one_window(spark, monkeypatch):
    vecs = vectors()
    index = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "upload_id long, embeddings array<float>")
    q = spark.createDataFrame([(j, vecs[j].tolist()) for j in range(3)], "request_id long, qvec array<float>").select(
        "*", F.lit(-1.0).alias("threshold"), F.lit(7).alias("limit"), (F.col("request_id") * 40).alias("offset"))
    run = lambda: sorted(map(tuple, knn.search_images_embedding(q, index, 8).collect()))
    flat = run()
    monkeypatch.setattr(knn, "SHALLOW", 0)
    assert run() == flat and len(flat) == 21


@pytest.mark.parametrize("limit,width", [(5, 40), (20, 40), (50, 100), (30, 60)])
def test_search_width_is_never_below_two_pages(limit, width):
    assert knn.search_width(40, limit) * limit == width
