"""Requests, filters, OCR and vector search (ports of the search examples + own edge cases)."""

from __future__ import annotations

import numpy as np
from conftest import category, forum, index_row, post, topic, upload

from pixlens.config import Settings
from pixlens.operators import search as se
from pixlens.operators.requests import parse_requests, request_modes, validate_requests

CFG = Settings(embedding_dim=8, text_similarity_threshold=0.4, image_similarity_threshold=0.8)
REQ_DDL = ("request_id long, method string, term string, image_ref string, image_content_type string, "
           "ocr string, embed string, page long, current_user_id long")


def requests(spark, rows):
    return spark.createDataFrame(rows, REQ_DDL)


def test_validation_and_modes(spark):
    r = requests(spark, [
        (1, "GET", "car", None, None, None, None, None, None),
        (2, "GET", None, None, None, None, None, None, None),
        (3, "GET", "car", None, None, "false", None, None, None),
        (4, "POST", None, "img", "image/png", None, None, None, None),
        (5, "POST", "x", "img", "text/plain", None, None, None, None),
        (6, "POST", "  ", None, None, None, None, None, None),
    ])
    v = {x.request_id: x.error for x in validate_requests(r).collect()}
    assert v == {1: None, 2: "term", 3: None, 4: None, 5: "image", 6: "image,term"}
    m = {x.request_id: (x.search_ocr, x.search_embeddings, x.search_by_image, x.page_no)
         for x in request_modes(r).collect()}
    assert m[1] == (True, True, False, 0)
    assert m[3] == (False, True, False, 0)
    assert m[4] == (False, False, True, 0)


def test_parse_requests_filters_and_phrases(spark):
    r = requests(spark, [
        (1, "GET", '"and the" @Someone topic:12 rest', None, None, None, None, 0, None),
        (2, "GET", "cat TAGS:a,b #: before:notadate categories:=x,%y", None, None, None, None, 0, None),
    ])
    p = {x.request_id: x for x in parse_requests(r).collect()}
    assert p[1].processed_term == '"and the" rest'
    assert [(f.kind, f.arg) for f in p[1].filters] == [("user", "Someone"), ("topic", "12")]
    assert p[2].processed_term == "cat"
    assert [(f.filter_no, f.kind, f.arg) for f in p[2].filters] == [
        (1, "tags", "a,b"), (2, "category_slug", ":"), (3, "before", "notadate"), (4, "category", "=x,%y")]


def _search_forum(spark, vecs):
    return forum(
        spark,
        categories=[category(1, "cars"), category(2, "sub", parent=1)],
        topics=[topic(1, 1), topic(2, 2)],
        users=[(1, "Alice", "alice", False), (2, "Bob", "bob", False)],
        posts=[post(10, 1, user_id=1), post(11, 2, user_id=2)],
        uploads=[upload(1), upload(2), upload(3)],
        post_uploads=[(10, 1), (10, 2), (11, 3)],
        index=[index_row(1, ocr_text="a car", embeddings=vecs[0]),
               index_row(2, ocr_text="a plane", embeddings=vecs[1]),
               index_row(3, ocr_text="another car", embeddings=vecs[2])],
    )


def _vecs():
    rng = np.random.default_rng(7)
    v = rng.standard_normal((3, 8)).astype(np.float32)
    return [x.tolist() for x in v]


def test_ocr_embedding_combined_and_by_image(spark):
    vecs = _vecs()
    t = _search_forum(spark, vecs)
    r = requests(spark, [
        (1, "GET", "car", None, None, "true", "false", 0, None),     # OCR: images 1 and 3
        (2, "GET", "boat", None, None, "true", "false", 0, None),    # OCR miss
        (3, "GET", "x", None, None, "false", "true", 0, None),       # embedding: image 1 first
        (4, "GET", "car", None, None, "true", "true", 0, None),      # combined
        (5, "POST", None, "img", "image/png", None, None, 0, None),  # by image
        (6, "GET", "car @bob", None, None, "true", "false", 0, None),
        (7, "GET", "car #cars", None, None, "true", "false", 0, None),
        (8, "GET", "car #=cars", None, None, "true", "false", 0, None),
    ])
    qv = spark.createDataFrame([(3, vecs[0]), (4, vecs[0]), (5, vecs[0])], "request_id long, qvec array<float>")
    out = se.search(r, t, CFG.with_(text_similarity_threshold=-1.0, image_similarity_threshold=-1.0), qv, limit=20)
    res = {}
    for x in out.results.orderBy("request_id", "rank").collect():
        res.setdefault(x.request_id, []).append((x.post_id, x.upload_id))
    assert res[1] == [(11, 3), (10, 1)]
    assert 2 not in res
    assert res[3][0] == (10, 1)  # the query vector is image 1's: best first
    assert set(res[4]) == {(11, 3), (10, 1), (10, 2)}
    assert res[5][0] == (10, 1)
    assert res[6] == [(11, 3)]
    assert res[7] == [(11, 3), (10, 1)]  # subcategory included
    assert res[8] == [(10, 1)]  # exact category only
    env = {x.request_id: x for x in out.envelope.collect()}
    assert env[1].has_more is False and env[1].n_results == 2


def test_blank_processed_term_gives_no_ocr_rows(spark):
    t = _search_forum(spark, _vecs())
    r = requests(spark, [(1, "GET", "topic:1", None, None, "true", "false", 0, None)])
    qv = spark.createDataFrame([], "request_id long, qvec array<float>")
    assert se.search(r, t, CFG, qv).results.count() == 0


def test_similarity_threshold_and_paging(spark):
    vecs = _vecs()
    t = _search_forum(spark, vecs)
    r = requests(spark, [(1, "POST", None, "img", "image/png", None, None, 0, None)])
    qv = spark.createDataFrame([(1, vecs[1])], "request_id long, qvec array<float>")
    # only the image itself passes 0.99
    out = se.search(r, t, CFG.with_(image_similarity_threshold=0.99), qv)
    assert [(x.post_id, x.upload_id) for x in out.results.collect()] == [(10, 2)]


def test_ocr_only_batch_pages(spark):
    t = _search_forum(spark, _vecs())
    r = requests(spark, [(1, "GET", "car", None, None, "true", "false", 0, None),
                         (2, "GET", "car", None, None, "true", "false", 1, None)])
    qv = spark.createDataFrame([], "request_id long, qvec array<float>")
    out = se.search(r, t, CFG, qv, limit=1)
    got = sorted((x.request_id, x.rank, x.post_id, x.upload_id) for x in out.results.collect())
    assert got == [(1, 1, 11, 3), (2, 1, 10, 1)]
    env = {x.request_id: x.has_more for x in out.envelope.collect()}
    assert env == {1: True, 2: True}


def test_posting_path_equals_scan_path(spark):
    from pixlens.operators import textindex
    t = _search_forum(spark, _vecs())
    r = requests(spark, [(1, "GET", "a car", None, None, "true", "false", 0, None),
                         (2, "GET", "car", None, None, "true", "false", 0, None),
                         (3, "GET", "a zebra", None, None, "true", "false", 0, None)])
    p = se.prepare_requests(r)
    scan = sorted(map(tuple, textindex.search_images_ocr_scan(p, t.index).collect()))
    post = sorted(map(tuple, textindex.search_images_ocr(p, textindex.postings(t.index, 4)).collect()))
    assert scan == post == [(1, 1), (2, 1), (2, 3)]


def test_deep_and_huge_pages(spark):
    vecs = _vecs()
    t = _search_forum(spark, vecs)
    r = requests(spark, [(1, "GET", "car", None, None, "true", "false", 1, None),
                         (2, "GET", "car", None, None, "true", "false", 200_000_000, None),
                         (4, "GET", "car", None, None, "true", "false", 0, None)])
    qv = spark.createDataFrame([(3, vecs[0])], "request_id long, qvec array<float>")
    out = se.search(r, t, CFG, qv, limit=1)
    assert sorted((x.request_id, x.rank, x.post_id) for x in out.results.collect()) == [(1, 1, 10), (4, 1, 11)]
    assert {x.request_id: x.has_more for x in out.envelope.collect()} == {1: True, 2: False, 4: True}
    r = requests(spark, [(3, "GET", "car", None, None, "true", "true", 200_000_000, None)])
    out = se.search(r, t, CFG, qv)
    assert out.results.count() == 0 and not out.envelope.first().has_more


def test_deep_branch_gives_the_same_pages(spark, monkeypatch):
    t = _search_forum(spark, _vecs())
    r = requests(spark, [(i, "GET", "car", None, None, "true", "false", i, None) for i in range(3)])
    qv = spark.createDataFrame([], "request_id long, qvec array<float>")
    rows = [sorted(map(tuple, se.search(r, t, CFG, qv, limit=1).results.collect()))]
    monkeypatch.setattr(se, "SHALLOW", 1)  # pages 1 and 2 now end beyond it
    rows.append(sorted(map(tuple, se.search(r, t, CFG, qv, limit=1).results.collect())))
    assert rows[0] == rows[1] and len(rows[0]) == 2


def test_images_without_upload_are_no_results(spark):
    vecs = _vecs()
    t = _search_forum(spark, vecs)
    t = t.replace(uploads=t.uploads.filter("id <> 3"))
    r = requests(spark, [(1, "GET", "car", None, None, "true", "true", 0, None)])
    qv = spark.createDataFrame([(1, vecs[2])], "request_id long, qvec array<float>")
    out = se.search(r, t, CFG.with_(text_similarity_threshold=-1.0), qv)
    assert {x.upload_id for x in out.results.collect()} == {1, 2}


def test_knn_blocks_keep_every_request(spark):
    from pyspark.sql import functions as F
    from pixlens.operators import knn
    rng = np.random.default_rng(1)
    imgs = spark.createDataFrame([(i, rng.standard_normal(8).astype(np.float32).tolist()) for i in range(60)],
                                 "upload_id long, embeddings array<float>")
    vi = knn.vector_index(imgs, 8)
    q = spark.range(0, 9000).select((F.lit(1_000_000) + F.col("id") * 100).alias("request_id"), (F.col("id") % 60).alias("upload_id"))
    q = knn.prepare_queries(q.join(imgs.withColumnRenamed("embeddings", "qvec"), "upload_id").drop("upload_id"), 8)
    q = q.withColumn("k", (F.col("request_id") % 3 + 1).cast("long"))
    one = knn.hamming_candidates(vi, q, 8, queries_per_block=100_000, block_cells=1 << 30)
    many = knn.hamming_candidates(vi, q, 8, queries_per_block=512, block_cells=160)
    assert one.count() == many.count() == q.agg(F.sum("k")).first()[0]
    assert one.exceptAll(many).count() == 0
    best = many.filter("cand_rank = 1").agg(F.max("hamming")).first()[0]
    assert best == 0  # every request finds its own vector's code


def test_lsh_recall_is_measured_against_exact(spark):
    from pyspark.sql import functions as F
    from pixlens.operators import knn
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((40, 64))
    imgs = spark.createDataFrame([(i, (centres[i % 40] + 0.7 * rng.standard_normal(64)).astype(np.float32).tolist())
                                  for i in range(800)], "upload_id long, embeddings array<float>")
    q = imgs.filter("upload_id < 40").select(F.col("upload_id").alias("request_id"), F.col("embeddings").alias("qvec"),
                                             F.lit(-1.0).alias("threshold"), F.lit(20).alias("limit"), F.lit(0).alias("offset"))
    pairs = {m: {(r.request_id, r.upload_id) for r in knn.search_images_embedding(q, imgs, 64, method=m).collect()}
             for m in ("exact", "lsh")}
    assert len(pairs["exact"] & pairs["lsh"]) / len(pairs["exact"]) >= 0.9


def test_custom_filter_on_text_values(spark):
    from pyspark.sql import functions as F
    from pixlens.operators import filters as flt
    from pixlens.operators.requests import FILTER_PATTERNS
    flt.register_filter("title_is", r"(?i)\Atitle:(\S+)\z", probe="title",
                        resolve=lambda f, t: f.select("request_id", "filter_no", F.col("arg").alias("value")))
    try:
        cands = spark.createDataFrame([(1, 10, "cars"), (1, 11, "boats"), (2, 10, "cars")],
                                      "request_id long, post_id long, title string")
        rows = spark.createDataFrame([(1, 1, "title_is", "boats")], "request_id long, filter_no int, kind string, arg string")
        got = flt.apply_filters(cands, rows, None, kinds=["title_is"])
        assert sorted((r.request_id, r.post_id) for r in got.collect()) == [(1, 11), (2, 10)]
    finally:
        flt.KINDS.pop("title_is")
        FILTER_PATTERNS[:] = [x for x in FILTER_PATTERNS if x[0] != "title_is"]
