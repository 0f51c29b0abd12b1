"""Registered queries: eligibility planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEST_SETTINGS as CFG
from ..operators import eligibility as el
from ..sources.testforum import TestForum
from .catalog import register


def _t(spark, sf_dir):
    return TestForum(spark, sf_dir).tables()


@register("eligible_posts", "SELECT id, topic_id, user_id FROM eligible_posts")
def eligible_posts(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.filter_posts(t.posts, t, CFG).select("id", "topic_id", "user_id")


@register("ignored_categories", """
  SELECT id, slug FROM categories WHERE NOT read_restricted AND id NOT IN (3, 8)""")
def ignored_categories(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.allowed_categories(t.categories, CFG).select("id", "slug")


@register("ignored_tags", """
  SELECT DISTINCT tt.topic_id FROM topic_tags tt JOIN tags g ON g.id = tt.tag_id WHERE g.name IN ('machinery')""")
def ignored_tags(spark, sf_dir):
    return el.topics_with_ignored_tags(_t(spark, sf_dir), CFG)


@register("searchable_posts", "SELECT id, topic_id FROM searchable_posts")
def searchable_posts(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.searchable_posts(t.posts, t).select("id", "topic_id")


@register("upload_size_filter", """
  SELECT id, filesize, width, height FROM uploads
  WHERE filesize <= 4096 * 1024 AND width >= 100 AND height >= 100""")
def upload_size_filter(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.uploads.filter(el.size_predicate(CFG)).select("id", "filesize", "width", "height")


@register("upload_type_filter", """
  SELECT id, original_filename FROM uploads
  WHERE regexp_matches(original_filename, '\\.(jpg|jpeg|png|webp)$', 'i')""")
def upload_type_filter(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.uploads.filter(el.type_predicate()).select("id", "original_filename")


@register("exclude_emoji", """
  SELECT id FROM uploads u WHERE NOT EXISTS (SELECT 1 FROM custom_emojis e WHERE e.upload_id = u.id)""")
def exclude_emoji(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.without_emoji(t.uploads, t.custom_emojis).select("id")


_UPLOAD_STATE = """
  SELECT u.id FROM size_type_ok u LEFT JOIN image_search_data i ON i.upload_id = u.id
  WHERE {where}"""


@register("eligible_uploads", "SELECT id FROM size_type_ok")
def eligible_uploads(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.filter_uploads(t.uploads, t, CFG, exclude_existing=False, max_retry_times=-1).select("id")


@register("uploads_unanalyzed", _UPLOAD_STATE.format(
    where="(i.upload_id IS NULL OR (i.ocr_text IS NULL AND i.embeddings IS NULL))"
          " AND (i.retry_times IS NULL OR i.retry_times < 3)"))
def uploads_unanalyzed(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.filter_uploads(t.uploads, t, CFG).select("id")


@register("uploads_partial", _UPLOAD_STATE.format(
    where="(i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)"
          " AND (i.retry_times IS NULL OR i.retry_times < 3)"))
def uploads_partial(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.filter_uploads(t.uploads, t, CFG, include_partially_analyzed=True).select("id")


@register("retry_cap", _UPLOAD_STATE.format(where="i.retry_times IS NULL OR i.retry_times < 3"))
def retry_cap(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.filter_uploads(t.uploads, t, CFG, exclude_existing=False, max_retry_times=3).select("id")


@register("post_images", """
  SELECT pu.post_id, pu.upload_id FROM post_uploads pu
  JOIN eligible_posts p ON p.id = pu.post_id JOIN uploads u ON u.id = pu.upload_id""")
def post_images(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.post_images(el.filter_posts(t.posts, t, CFG), t.uploads, t.post_uploads).select(
        "post_id", "upload_id")


_POSTS_NEEDING = """
  SELECT pu.post_id, count(*) AS n_images
  FROM post_uploads pu
  JOIN eligible_posts p ON p.id = pu.post_id
  JOIN ({uploads}) u ON u.id = pu.upload_id
  GROUP BY pu.post_id HAVING count(*) > 0 AND count(*) <= {cap}"""
_UNANALYZED = _UPLOAD_STATE.format(
    where="(i.upload_id IS NULL OR (i.ocr_text IS NULL AND i.embeddings IS NULL))"
          " AND (i.retry_times IS NULL OR i.retry_times < 3)")


@register("posts_needing_analysis", _POSTS_NEEDING.format(uploads=_UNANALYZED, cap=5))
def posts_needing_analysis(spark, sf_dir):
    return el.posts_needing_analysis(_t(spark, sf_dir), CFG)


@register("post_image_cap", _POSTS_NEEDING.format(uploads=_UNANALYZED, cap=1))
def post_image_cap(spark, sf_dir):
    return el.posts_needing_analysis(_t(spark, sf_dir), CFG, max_images_per_post=1)


_NEEDING = """
  SELECT u.id, pu.post_id FROM size_type_ok u
  LEFT JOIN image_search_data i ON i.upload_id = u.id
  JOIN post_uploads pu ON pu.upload_id = u.id
  JOIN eligible_posts p ON p.id = pu.post_id
  WHERE {where}"""


@register("uploads_needing_analysis", _NEEDING.format(
    where="(i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)"
          " AND (i.retry_times IS NULL OR i.retry_times < 3)"
          " AND (FALSE OR i.ocr_text IS NULL OR i.embeddings IS NULL)"))
def uploads_needing_analysis(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.uploads_needing_analysis(t, CFG, with_posts=True).select("id", "post_id")


@register("missing_parts", """
  SELECT DISTINCT id FROM (""" + _NEEDING.format(
    where="(i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)"
          " AND (i.retry_times IS NULL OR i.retry_times < 3)"
          " AND (FALSE OR i.ocr_text IS NULL)") + ") x")
def missing_parts(spark, sf_dir):
    t = _t(spark, sf_dir)
    return el.uploads_needing_analysis(t, CFG, include_missing_ocr=True,
                                       include_missing_embeddings=False).select("id")


@register("stale_index_rows", """
  SELECT upload_id FROM image_search_data
  WHERE upload_id NOT IN (
    SELECT u.id FROM size_type_ok u JOIN post_uploads pu ON pu.upload_id = u.id
    JOIN eligible_posts p ON p.id = pu.post_id)""")
def stale_index_rows(spark, sf_dir):
    return el.stale_index_rows(_t(spark, sf_dir), CFG).select("upload_id")


@register("cascade_deletes", """
  SELECT upload_id FROM image_search_data i WHERE EXISTS (SELECT 1 FROM uploads u WHERE u.id = i.upload_id)""")
def cascade_deletes(spark, sf_dir):
    t = _t(spark, sf_dir)
    return t.index.join(t.uploads.select(F.col("id").alias("upload_id")), "upload_id", "left_semi").select(
        "upload_id")


@register("index_by_post", """
  SELECT pu.post_id, i.upload_id, i.sha1 FROM post_uploads pu JOIN image_search_data i ON i.upload_id = pu.upload_id""")
def index_by_post(spark, sf_dir):
    from ..operators.moderation import index_by_post as ibp
    t = _t(spark, sf_dir)
    return ibp(t.post_uploads.select("post_id").distinct(), t).select("post_id", "upload_id", "sha1")
