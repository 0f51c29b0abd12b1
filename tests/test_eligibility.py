"""Eligibility planning (ports of the reference's filter examples plus edge cases)."""

from __future__ import annotations

from conftest import category, forum, index_row, post, topic, upload

from pixlens.config import Settings
from pixlens.operators import eligibility as el

CFG = Settings(analyze_ocr_enabled=True, analyze_embedding_enabled=True, ignored_categories=("3",),
               ignored_tags=("bad",))


def ids(df, col="id"):
    return sorted(r[col] for r in df.select(col).collect())


def test_filter_posts_category_and_tag_rules(spark):
    t = forum(
        spark,
        categories=[category(1), category(2, "secret", restricted=True), category(3, "ignored")],
        topics=[topic(1, 1), topic(2, 2), topic(3, 3), topic(4, 1), topic(5, None), topic(6, 1, visible=False),
                topic(7, 1, archetype="private_message")],
        tags=[(1, "bad"), (2, "good")], topic_tags=[(4, 1), (1, 2)],
        posts=[post(i, topic_id=i) for i in range(1, 8)] + [post(8, topic_id=1, deleted_at=post(1)[4])],
    )
    # 1 ok; 2 restricted; 3 ignored category; 4 ignored tag; 5 no category; 6 hidden; 7 PM; 8 deleted
    assert ids(el.filter_posts(t.posts, t, CFG)) == [1]


def test_size_dimension_and_type_predicates(spark):
    t = forum(spark, uploads=[
        upload(1, width=150, height=150), upload(2, width=50, height=50),
        upload(3, filesize=1024 * 1024), upload(4, filesize=2048 * 1024),
        upload(5, filename="a.jpeg"), upload(6, filename="a.gif"), upload(7, filename="a.PNG"),
        upload(8, filename="a.png\n"), upload(9, width=None), upload(10, filename="a.png.txt"),
    ])
    cfg = CFG.with_(max_image_size_kb=1024)
    got = ids(t.uploads.filter(el.size_predicate(cfg) & el.type_predicate()))
    assert got == [1, 3, 5, 7]


def test_analyzed_and_retry_rules(spark):
    t = forum(
        spark,
        uploads=[upload(i) for i in range(1, 7)],
        index=[index_row(1, ocr_text="", embeddings=[0.0, 0.0], lexemes=[]),  # analyzed, empty text
               index_row(2, ocr_text=None, embeddings=None, retry=2),  # nothing yet, retry 2
               index_row(3, ocr_text=None, embeddings=None, retry=4),  # over the cap
               index_row(4, ocr_text=None),  # partially analyzed
               index_row(5)],  # fully analyzed
        custom_emojis=[(None,)],  # a NULL emoji id must not empty the result
    )
    assert ids(el.filter_uploads(t.uploads, t, CFG)) == [2, 6]
    assert ids(el.filter_uploads(t.uploads, t, CFG, include_partially_analyzed=True)) == [2, 4, 6]
    assert ids(el.filter_uploads(t.uploads, t, CFG, exclude_existing=False, max_retry_times=-1)) == [1, 2, 3, 4, 5, 6]


def test_emoji_uploads_are_excluded(spark):
    t = forum(spark, uploads=[upload(1), upload(2)], custom_emojis=[(2,), (None,)])
    assert ids(el.filter_uploads(t.uploads, t, CFG)) == [1]


def test_posts_needing_analysis_cap(spark):
    base = dict(categories=[category(1)], topics=[topic(1)], posts=[post(10)],
                uploads=[upload(1), upload(2)], post_uploads=[(10, 1), (10, 2)])
    t = forum(spark, **base)
    assert [(r.post_id, r.n_images) for r in el.posts_needing_analysis(t, CFG).collect()] == [(10, 2)]
    assert el.posts_needing_analysis(t, CFG, max_images_per_post=1).count() == 0
    # one image analyzed: only the other one counts
    t1 = forum(spark, **base, index=[index_row(1)])
    assert [(r.post_id, r.n_images) for r in el.posts_needing_analysis(t1, CFG, max_images_per_post=1).collect()] \
        == [(10, 1)]
    t2 = forum(spark, **base, index=[index_row(1), index_row(2)])
    assert el.posts_needing_analysis(t2, CFG).count() == 0


def test_stale_index_rows(spark):
    t = forum(
        spark,
        categories=[category(1), category(2, "secret", restricted=True)],
        topics=[topic(1, 1), topic(2, 2)],
        posts=[post(10, 1), post(11, 1, deleted_at=post(1)[4]), post(12, 1), post(13, 2)],
        uploads=[upload(1), upload(3), upload(4), upload(5), upload(6)],
        post_uploads=[(10, 1), (11, 3), (11, 4), (12, 4), (13, 5), (10, 6)],
        index=[index_row(1), index_row(2), index_row(3), index_row(4), index_row(5), index_row(6, retry=100)],
    )
    # 2: upload gone; 3: only in a deleted post; 4: deleted post but reused by a live one;
    # 5: restricted category; 6: retries ignored by cleanup
    assert ids(el.stale_index_rows(t, CFG), "upload_id") == [2, 3, 5]
