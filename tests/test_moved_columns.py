"""What is shuffled or held at once: postings, the index of the test forum, posts below the top-k."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from pixlens.operators import eligibility as el
from pixlens.operators import knn, prefilter, textindex
from pixlens.sources.testforum import TestForum


def test_postings_group_words_within_rows(spark):
    """Only an upload that stands in several rows is grouped by a shuffle; nulls and repeats are kept."""
    rows = [(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["x"]), (4, ["y", "x"]), (None, ["n"]), (None, ["n"]), (5, ["z", None, "z"])]
    p = textindex.postings(spark.createDataFrame(rows, "upload_id long, ocr_lexemes array<string>"))
    got = {(r.upload_id, r.lexeme): list(r.positions) for r in p.collect()}
    assert got == {(1, "a"): [2], (1, "b"): [1, 3], (4, "x"): [1, 2], (4, "y"): [1], (None, "n"): [1, 1], (5, "z"): [1, 3], (5, None): [2]}
    assert p.count() == len(got)
    assert "RepartitionByExpression" not in p._jdf.queryExecution().optimizedPlan().toString()


def test_index_state_takes_neither_text_nor_vector_through_the_join(spark, tmp_path):
    docs = [(i, None if i in (1, 3) else f"word {i}", "en", "s", 6) for i in range(25)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, None if i == 2 else [0.5, -1.0], 0) for i in range(20)],
                          "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    index = TestForum(spark, str(tmp_path)).index
    state = el.index_state(index)
    plan = state._jdf.queryExecution().optimizedPlan().toString()
    above = plan[:plan.index("Join")]
    assert "text#" not in above.replace("_has_text", "") and "embedding#" not in above
    full = {r.upload_id: r for r in index.collect()}
    assert full[5].ocr_text == "" and full[5].ocr_lexemes == [] and full[0].ocr_lexemes == ["word", "0"] and list(full[0].embeddings) == [0.5, -1.0]
    for r in state.collect():
        own = full[r.id]
        assert r._ocr_missing == (own.ocr_lexemes is None) == (r.id in (1, 3, 10, 17)), r
        assert r._emb_missing == (own.embeddings is None) == (r.id in (2, 5, 16) or r.id >= 20), r


def test_posts_of_one_image_are_dealt_to_several_blocks(spark, monkeypatch):
    """A block holds a bounded number of posts, and the page of a filtered request is the same."""
    index = spark.createDataFrame([(i, [1.0 if b <= i else -1.0 for b in range(8)]) for i in range(8)],
                                  "upload_id long, embeddings array<float>")
    t0 = dt.datetime(2024, 1, 1)
    pairs = spark.createDataFrame([(100 * i + j, i, 1, j, 1, t0) for i in range(8) for j in range(40 if i == 3 else 2)],
                                  "post_id long, upload_id long, topic_id long, user_id long, category_id long, created_at timestamp_ntz")
    monkeypatch.setattr(prefilter, "POSTS_PER_ROW", 4)
    posts = prefilter.image_posts(pairs, None, with_tags=False)
    one = "array<struct<kind:string,arg:string,keys:array<string>>>"
    q = spark.createDataFrame([(1, [1.0] * 8, [("user", "x", ["0", "1"])]), (2, [1.0] * 8, [("user", "x", ["30"])]), (3, [1.0] * 8, None)],
                              f"request_id long, qvec array<float>, filters {one}")
    q = knn.prepare_queries(q, 8).withColumn("k", F.lit(5))
    vindex = knn.vector_index(index, 8)

    def found():
        c = knn.hamming_candidates(vindex, q, 8, posts=posts)
        return sorted(tuple(r) for r in c.select("request_id", "upload_id", "hamming", "cand_rank").collect()), \
            c._jdf.queryExecution().optimizedPlan().toString()

    whole, _ = found()
    monkeypatch.setattr(prefilter, "POSTS_PER_BLOCK", 8)
    parts, plan = found()
    assert parts == whole and [r[1] for r in parts if r[0] == 2] == [3] and len([r for r in parts if r[0] == 1]) == 5
    assert "xxhash64(upload_id" in plan and ", 7)" in plan.replace("sequence", "")
