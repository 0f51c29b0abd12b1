"""Posts of the images of both sides are gathered once; nested items stay where they were grouped."""

from __future__ import annotations

from conftest import forum, index_row, post, topic, upload
from pyspark.sql import functions as F

from pixlens.config import Settings
from pixlens.operators import results as rs
from pixlens.operators import search as se

REQUESTS = ("request_id long, method string, term string, image_ref string, image_content_type string, ocr string, "
            "embed string, page long, current_user_id long")


def test_posts_of_both_sides_are_gathered_once(spark, monkeypatch):
    t = forum(spark, posts=[post(i, post_number=i) for i in range(1, 5)], topics=[topic(1)], uploads=[upload(i) for i in (1, 2, 3)],
              post_uploads=[(1, 1), (2, 2), (3, 2), (4, 3)],
              index=[index_row(1, ocr_text="red car", embeddings=(1.0, 0.1)), index_row(2, ocr_text="blue", embeddings=(0.9, 0.2)),
                     index_row(3, ocr_text="car", embeddings=(-1.0, 0.5))])
    requests = spark.createDataFrame([(1, "GET", "car", None, None, "true", "true", 0, None),
                                      (2, "GET", "car topic:1", None, None, "true", "false", 0, None),
                                      (3, "POST", None, "x", "image/png", None, None, 0, None)], REQUESTS)
    vectors = spark.createDataFrame([(1, [1.0, 0.1]), (3, [-1.0, 0.5])], "request_id long, qvec array<float>")
    cfg = Settings(embedding_dim=2, text_similarity_threshold=0.5, image_similarity_threshold=0.5)
    calls, plain = [], se.shown_posts
    monkeypatch.setattr(se, "shown_posts", lambda *a, **k: calls.append(1) or plain(*a, **k))
    got = [tuple(r) for r in se.search(requests, t, cfg, vectors).results.select("request_id", "rank", "post_id", "upload_id").orderBy(
        "request_id", "rank").collect()]
    assert got == [(1, 1, 4, 3), (1, 2, 3, 2), (1, 3, 2, 2), (1, 4, 1, 1), (2, 1, 4, 3), (2, 2, 1, 1), (3, 1, 4, 3)]
    assert len(calls) == 1
    pages = se.cumulative_pages(requests, t, cfg, vectors)
    assert [tuple(r) for r in pages.select("request_id", "page_no", "rank", "post_id", "upload_id").orderBy("request_id", "rank").collect()] == [(q, 0, n, p, u) for q, n, p, u in got]
    assert len(calls) == 2


ITEM = ("request_id long, rank long, post_id long, post_number long, user_id long, username string, topic_id long, topic_title string, "
        "category_id long, tags array<string>, upload_id long, image_url string, image_width long, image_height long, "
        "optimized_images array<struct<id:long>>, thumbnail_url string, link_target string")


def test_parts_of_a_response(spark):
    items = spark.createDataFrame([(q, n, 10 * q) + (None,) * 14 for q, n in [(1, 3), (1, 1), (1, 2), (2, 1), (3, None), (9, 1)]], ITEM)
    env = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, "d"), (4, "e"), (None, "f")], "request_id long, term string")
    out = rs.envelope(env, items, items_per_part=2)
    assert out.columns == ["request_id", "term", "part", "grouped_results"]
    got = out.select("request_id", "term", "part", F.col("grouped_results.rank").alias("ranks")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted(
        [(1, "a", 0, [1, 2]), (1, "a", 1, [3]), (2, "b", 0, [1]), (3, "c", 0, [None]), (4, "d", 0, []), (4, "e", 0, []), (None, "f", 0, [])],
        key=str)
    # The grouped items meet the requests by the key they were grouped by.
    joins = [x for x in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in x]
    assert "part" in joins[0]
