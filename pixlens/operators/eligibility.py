"""Which posts and uploads qualify for image analysis, and which index rows are stale.

Everything is joins and filters over the host tables; Catalyst pushes the
predicates into the Parquet scans and AQE picks broadcast or shuffle joins from
runtime sizes (categories, tags and emoji are tiny; posts, uploads, post_uploads
and the index always stay shuffle-joinable).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SUPPORTED_IMAGE_TYPES, Settings
from ..sources.tables import ForumTables

# Anchored at the true end of the string (``$`` in Java also accepts a trailing newline).
IMAGE_TYPE_PATTERN = r"(?i)\.(" + "|".join(SUPPORTED_IMAGE_TYPES) + r")\z"


# ---------------------------------------------------------------- posts
def public_topics(topics: DataFrame) -> DataFrame:
    """Visible, non-private-message topics."""
    return topics.filter(F.col("visible") & (F.col("archetype") != "private_message"))


def allowed_categories(categories: DataFrame, cfg: Settings) -> DataFrame:
    """Categories that are not read-restricted and not in the ignored list (F2)."""
    c = categories.filter(~F.col("read_restricted"))
    ids = cfg.ignored_category_ids
    if ids:
        c = c.filter(~F.col("id").isin(*ids))
    return c


def topics_with_ignored_tags(t: ForumTables, cfg: Settings) -> DataFrame:
    """Topic ids carrying any ignored tag."""
    if not (cfg.tagging_enabled and cfg.ignored_tags):
        return t.topic_tags.select("topic_id").limit(0)
    bad = t.tags.filter(F.col("name").isin(*cfg.ignored_tags)).select(F.col("id").alias("tag_id"))
    return t.topic_tags.join(bad, "tag_id", "left_semi").select("topic_id").distinct()


def eligible_topic_ids(t: ForumTables, cfg: Settings) -> DataFrame:
    """Topics whose posts may be analyzed: public, in an allowed category, no ignored tag."""
    cats = allowed_categories(t.categories, cfg).select(F.col("id").alias("category_id"))
    topics = public_topics(t.topics).select(F.col("id").alias("topic_id"), "category_id")
    topics = topics.join(cats, "category_id", "left_semi")  # NULL category falls out
    if cfg.tagging_enabled and cfg.ignored_tags:
        topics = topics.join(topics_with_ignored_tags(t, cfg), "topic_id", "left_anti")
    return topics.select("topic_id")


def filter_posts(posts: DataFrame, t: ForumTables, cfg: Settings) -> DataFrame:
    """Posts that may be analyzed (F1): not deleted, eligible topic."""
    live = posts.filter(F.col("deleted_at").isNull())
    return live.join(eligible_topic_ids(t, cfg), "topic_id", "left_semi")


def searchable_posts(posts: DataFrame, t: ForumTables, cfg: Settings | None = None,
                     strict_visibility: bool = False) -> DataFrame:
    """Posts search may return (F18): visible and public only, unless strict."""
    if strict_visibility and cfg is not None:
        return filter_posts(posts, t, cfg)
    topics = public_topics(t.topics).select(F.col("id").alias("topic_id"))
    return posts.filter(F.col("deleted_at").isNull()).join(topics, "topic_id", "left_semi")


# -------------------------------------------------------------- uploads
def size_predicate(cfg: Settings) -> Column:
    """inclusive size cap and minimum dimensions; NULLs never qualify."""
    return ((F.col("filesize") <= F.lit(cfg.max_image_size_kb * 1024))
            & (F.col("width") >= cfg.min_image_width)
            & (F.col("height") >= cfg.min_image_height))


def type_predicate() -> Column:
    """supported image extension, case-insensitive."""
    return F.col("original_filename").rlike(IMAGE_TYPE_PATTERN)


def without_emoji(uploads: DataFrame, custom_emojis: DataFrame) -> DataFrame:
    """Anti join (a NULL emoji id must not empty the result, unlike NOT IN)."""
    emoji = custom_emojis.filter(F.col("upload_id").isNotNull()).select(F.col("upload_id").alias("id"))
    return uploads.join(emoji, "id", "left_anti")


def index_state(index: DataFrame) -> DataFrame:
    """The few index columns the planners need (never the vectors or text)."""
    return index.select(
        F.col("upload_id").alias("id"), F.lit(True).alias("_indexed"),
        F.col("ocr_lexemes").isNull().alias("_ocr_missing"),
        F.col("embeddings").isNull().alias("_emb_missing"), F.col("retry_times").alias("_retry"))


def missing_parts(include_missing_ocr: bool, include_missing_embeddings: bool) -> Column:
    """OR of the enabled parts that are missing, starting from FALSE."""
    terms = [F.lit(False)]
    if include_missing_ocr:
        terms.append(F.coalesce(F.col("_ocr_missing"), F.lit(True)))
    if include_missing_embeddings:
        terms.append(F.coalesce(F.col("_emb_missing"), F.lit(True)))
    return reduce(lambda a, b: a | b, terms)


def _uploads_with_state(uploads: DataFrame, t: ForumTables, cfg: Settings, exclude_existing: bool,
                        include_partially_analyzed: bool, max_retry_times: int | None) -> DataFrame:
    max_retry = cfg.max_retry_times_per_image if max_retry_times is None else max_retry_times
    u = uploads.filter(size_predicate(cfg) & type_predicate())
    if exclude_existing or max_retry > 0:
        # One left join with the index serves every index predicate.
        u = u.join(index_state(t.index), "id", "left")
    not_indexed = F.col("_indexed").isNull()
    if exclude_existing:
        if include_partially_analyzed:  # F8
            u = u.filter(not_indexed | F.col("_ocr_missing") | F.col("_emb_missing"))
        else:  # F7
            u = u.filter(not_indexed | (F.col("_ocr_missing") & F.col("_emb_missing")))
    if max_retry > 0:  # F9
        u = u.filter(F.col("_retry").isNull() | (F.col("_retry") < max_retry))
    return without_emoji(u, t.custom_emojis)


def _drop_state(df: DataFrame) -> DataFrame:
    return df.drop("_indexed", "_ocr_missing", "_emb_missing", "_retry")


def filter_uploads(uploads: DataFrame, t: ForumTables, cfg: Settings, exclude_existing: bool = True,
                   include_partially_analyzed: bool = False, max_retry_times: int | None = None) -> DataFrame:
    """uploads that need analysis, regardless of which posts hold them."""
    return _drop_state(_uploads_with_state(uploads, t, cfg, exclude_existing,
                                           include_partially_analyzed, max_retry_times))


# ----------------------------------------------------------- composites
def post_images(posts: DataFrame, uploads: DataFrame, post_uploads: DataFrame) -> DataFrame:
    """(post, upload) pairs through the link table, inner on both sides."""
    pu = post_uploads.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi")
    return pu.join(uploads.withColumnRenamed("id", "upload_id"), "upload_id")


def posts_needing_analysis(t: ForumTables, cfg: Settings, exclude_existing: bool = True,
                           max_images_per_post: int | None = None) -> DataFrame:
    """Eligible posts with 0 < eligible images <= cap; (post_id, n_images)."""
    cap = cfg.max_images_per_post if max_images_per_post is None else max_images_per_post
    posts = filter_posts(t.posts, t, cfg).select(F.col("id").alias("post_id"))
    ups = filter_uploads(t.uploads, t, cfg, exclude_existing=exclude_existing).select(
        F.col("id").alias("upload_id"))
    pairs = t.post_uploads.join(ups, "upload_id", "left_semi").join(posts, "post_id", "left_semi")
    counted = pairs.groupBy("post_id").agg(F.count("upload_id").alias("n_images"))
    if cap is not None and cap > 0:
        counted = counted.filter((F.col("n_images") > 0) & (F.col("n_images") <= cap))
    return counted


def uploads_needing_analysis(t: ForumTables, cfg: Settings, exclude_existing: bool = True,
                             max_retry_times: int | None = None, include_missing_ocr: bool | None = None,
                             include_missing_embeddings: bool | None = None,
                             with_posts: bool = False) -> DataFrame:
    """Uploads (with the index state) that belong to an eligible post.

    ``with_posts=True`` returns one row per (upload, post) like the source; the
    default is one row per upload.
    """
    ocr = cfg.analyze_ocr_enabled if include_missing_ocr is None else include_missing_ocr
    emb = cfg.analyze_embedding_enabled if include_missing_embeddings is None else include_missing_embeddings
    u = _uploads_with_state(t.uploads, t, cfg, exclude_existing, True, max_retry_times)
    if exclude_existing:
        u = u.filter(missing_parts(ocr, emb))
    u = _drop_state(u)
    posts = filter_posts(t.posts, t, cfg).select(F.col("id").alias("post_id"))
    links = t.post_uploads.join(posts, "post_id", "left_semi")
    if with_posts:
        return u.join(links.withColumnRenamed("upload_id", "id"), "id")
    return u.join(links.select(F.col("upload_id").alias("id")), "id", "left_semi")


def stale_index_rows(t: ForumTables, cfg: Settings) -> DataFrame:
    """Index rows whose upload no longer qualifies (retries ignored)."""
    keep = uploads_needing_analysis(t, cfg, exclude_existing=False, max_retry_times=-1).select(
        F.col("id").alias("upload_id"))
    return t.index.join(keep, "upload_id", "left_anti")
