"""Registered queries: index writes, cleanup, migration, moderation, backfill,
hydration (WR1, WR3, WR5, WR6, A2, A4, C6, C9, C10, C11, T6, T7, A6, A7, P2, X10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEST_SETTINGS
from ..operators import analysis as an
from ..operators import backfill as bf
from ..operators import index_store as ix
from ..operators import moderation as md
from ..operators import results as rs
from ..operators import search as se
from ..session import materialize
from ..sources.testforum import BASE_URL, TestForum
from .analysis_queries import RUN, WATCHED
from .catalog import register
from .search_queries import _postings
from .search_sql import LIMIT, TEXT_T, search_sql

CFG = TEST_SETTINGS.with_(base_url=BASE_URL, text_similarity_threshold=TEXT_T)
DIM = CFG.embedding_dim


def _f(spark, sf_dir):
    return TestForum(spark, sf_dir)


def _index_out(df):
    return df.select("upload_id", "sha1", F.md5("ocr_text").alias("ocr_md5"),
                     F.col("embeddings").isNotNull().alias("has_embedding"), "retry_times")


_INDEX_OUT = ("SELECT upload_id, sha1, md5(ocr_text) AS ocr_md5, embeddings IS NOT NULL AS has_embedding, "
              "retry_times FROM ({src}) m")


@register("merge_results", _INDEX_OUT.format(src="""
  SELECT coalesce(i.upload_id, s.upload_id) AS upload_id, coalesce(i.sha1, s.sha1) AS sha1,
         coalesce(s.ocr_text, i.ocr_text) AS ocr_text, coalesce(s.emb, i.embeddings) AS embeddings,
         CAST(CASE WHEN s.upload_id IS NOT NULL THEN 0 ELSE i.retry_times END AS INTEGER) AS retry_times
  FROM image_search_data i FULL OUTER JOIN (
    SELECT n.id AS upload_id, n.content_key AS sha1, array_to_string(a.ocr_result, chr(10)) AS ocr_text, a.embedding AS emb
    FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key WHERE a.success) s
  ON s.upload_id = i.upload_id"""))
def merge_results(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = f.tables()
    info = an.image_info(an.el.uploads_needing_analysis(t, CFG), CFG)
    res = an.run_analyzer(info, f.answers)
    stored = an.storable_results(an.match_results(res, info), f.uploads, CFG)
    return _index_out(ix.merge_results(f.index, stored))


@register("record_failures", """
  SELECT coalesce(i.upload_id, x.id) AS upload_id, coalesce(i.sha1, x.content_key) AS sha1,
         CAST(coalesce(i.retry_times, 0) + coalesce(x.n, 0) AS INTEGER) AS retry_times
  FROM image_search_data i FULL OUTER JOIN (
    SELECT n.id, n.content_key, count(*) AS n FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key
    WHERE NOT a.success GROUP BY n.id, n.content_key) x ON x.id = i.upload_id""")
def record_failures(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = f.tables()
    info = an.image_info(an.el.uploads_needing_analysis(t, CFG), CFG)
    res = an.run_analyzer(info, f.answers)
    failed = an.failed_images(info, res).groupBy(F.col("id").alias("upload_id"), "sha1").agg(F.count("*").alias("n"))
    return ix.record_failures(f.index, failed).select("upload_id", "sha1", "retry_times")


@register("one_per_content", """
  SELECT sha1, min(upload_id) AS upload_id FROM image_search_data GROUP BY sha1""")
def one_per_content(spark, sf_dir):
    return ix.one_per_content(_f(spark, sf_dir).index).select("sha1", "upload_id")


@register("migrate_index", """
  SELECT u.id AS upload_id, c.sha1, c.src_upload_id
  FROM uploads u JOIN (SELECT sha1, min(upload_id) AS src_upload_id FROM image_search_data GROUP BY sha1) c
    ON c.sha1 = coalesce(u.original_sha1, u.sha1)""")
def migrate_index(spark, sf_dir):
    f = _f(spark, sf_dir)
    old = f.index.withColumn("src_upload_id", F.col("upload_id")).withColumn("description", F.lit("retired"))
    return ix.migrate(old, f.uploads).select("upload_id", "sha1", "src_upload_id")


@register("cleanup_index", """
  SELECT upload_id FROM image_search_data i
  WHERE EXISTS (SELECT 1 FROM uploads u WHERE u.id = i.upload_id)
    AND upload_id IN (SELECT u.id FROM size_type_ok u JOIN post_uploads pu ON pu.upload_id = u.id
                      JOIN eligible_posts p ON p.id = pu.post_id)""")
def cleanup_index(spark, sf_dir):
    return ix.cleanup_index(_f(spark, sf_dir).tables(), CFG).select("upload_id")


@register("post_ocr_text", """
  SELECT post_id, md5(txt) AS ocr_md5, CAST(length(txt) AS BIGINT) AS n_chars FROM (
    SELECT pu.post_id, string_agg(coalesce(i.ocr_text, ''), chr(10) ORDER BY i.upload_id) AS txt
    FROM post_uploads pu JOIN image_search_data i ON i.upload_id = pu.upload_id GROUP BY pu.post_id) x""")
def post_ocr_text(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = md.post_ocr_text(f.post_uploads.select("post_id").distinct(), f.tables())
    return t.select("post_id", F.md5("ocr_text").alias("ocr_md5"), F.length("ocr_text").cast("long").alias("n_chars"))


@register("flag_posts", r"""
  SELECT DISTINCT pu.post_id, 'inappropriate' AS flag_type, 'watched_word' AS reason, 'system' AS actor
  FROM post_uploads pu JOIN image_search_data i ON i.upload_id = pu.upload_id
  WHERE regexp_matches(i.ocr_text, '""" + WATCHED + """')""")
def flag_posts(spark, sf_dir):
    f = _f(spark, sf_dir)
    return md.flag_posts(f.post_uploads.select("post_id").distinct(), f.tables())


_NEEDING_PAIRS = """
  SELECT u.id, pu.post_id FROM size_type_ok u
  LEFT JOIN image_search_data i ON i.upload_id = u.id
  JOIN post_uploads pu ON pu.upload_id = u.id JOIN eligible_posts p ON p.id = pu.post_id
  WHERE (i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)
    AND (i.retry_times IS NULL OR i.retry_times < 3) AND (i.ocr_text IS NULL OR i.embeddings IS NULL)"""


@register("backfill_priority", f"""
  SELECT upload_id, newest_post_id,
         CAST(row_number() OVER (ORDER BY newest_post_id DESC, upload_id DESC) AS BIGINT) AS priority
  FROM (SELECT id AS upload_id, max(post_id) AS newest_post_id FROM ({_NEEDING_PAIRS}) x GROUP BY id) y
  ORDER BY newest_post_id DESC, upload_id DESC LIMIT 100""")
def backfill_priority(spark, sf_dir):
    return bf.backfill_priority(_f(spark, sf_dir).tables(), CFG, 100)


@register("backfill_batches", """
  SELECT batch_no, min(id) AS min_id, max(id) AS max_id, count(*) AS n_uploads FROM (
    SELECT id, CAST((row_number() OVER (ORDER BY id DESC) - 1) // 100 AS BIGINT) AS batch_no
    FROM needing_uploads) x GROUP BY batch_no""")
def backfill_batches(spark, sf_dir):
    b = bf.backfill_batches(_f(spark, sf_dir).tables(), CFG, 100)
    return bf.batch_bounds(b).select("batch_no", "min_id", "max_id", "n_uploads")


@register("pick_thumbnail", """
  SELECT u.id AS upload_id, coalesce(t.url, u.url) AS thumbnail_url, t.url IS NOT NULL AS qualified
  FROM uploads u LEFT JOIN (
    SELECT upload_id, arg_min(url, (height * width, -id)) AS url FROM optimized_images
    WHERE height > 300 AND width > 150 GROUP BY upload_id) t ON t.upload_id = u.id""")
def pick_thumbnail(spark, sf_dir):
    f = _f(spark, sf_dir)
    return rs.pick_thumbnail(f.uploads, f.optimized_images)


def _search_results(f):
    return se.search(f.search_requests, f.tables(), CFG, f.request_embeddings, _postings(f.spark, f.sf_dir), limit=LIMIT).results


_OPTIMIZED = """coalesce((SELECT string_agg(o.id || ':' || o.url || ':' || o.width || ':' || o.height, '|' ORDER BY o.id)
                   FROM optimized_images o WHERE o.upload_id = r.upload_id), '')"""
_HYDRATED = f"""
  SELECT r.request_id, r.rank, r.post_id, r.upload_id, p.topic_id, p.user_id, p.post_number, us.username,
         t.title AS topic_title, t.category_id,
         coalesce((SELECT string_agg(DISTINCT g.name, ',' ORDER BY g.name) FROM topic_tags tt JOIN tags g
                   ON g.id = tt.tag_id WHERE tt.topic_id = p.topic_id), '') AS tags,
         u.url AS image_url, u.width AS image_width, u.height AS image_height, {_OPTIMIZED} AS optimized,
         coalesce((SELECT arg_min(o.url, (o.height * o.width, -o.id)) FROM optimized_images o
                   WHERE o.upload_id = r.upload_id AND o.height > 300 AND o.width > 150), u.url) AS thumbnail_url,
         p.url AS link_target
  FROM results r LEFT JOIN posts p ON p.id = r.post_id LEFT JOIN users us ON us.id = p.user_id
  LEFT JOIN topics t ON t.id = p.topic_id LEFT JOIN uploads u ON u.id = r.upload_id"""


def _optimized(images):
    return F.array_join(F.transform(images, lambda x: F.concat_ws(":", x["id"], x["url"], x["width"], x["height"])), "|")


@register("hydrate_results", search_sql(_HYDRATED))
def hydrate_results(spark, sf_dir):
    f = _f(spark, sf_dir)
    h = rs.hydrate(_search_results(f), f.tables())
    return h.withColumn("tags", F.array_join("tags", ",")).withColumn(
        "optimized", _optimized(F.col("optimized_images"))).drop("optimized_images")


@register("search_response", search_sql(f"""
  SELECT e.request_id, e.term, e.processed_term, e.search_ocr, e.search_embeddings, e.search_by_image, e.has_more, e.error,
         CAST(e.n_results AS BIGINT) AS n_results, h.rank, h.post_id, h.post_number, h.user_id, h.username, h.topic_id,
         h.topic_title, h.category_id, h.tags, h.upload_id, h.image_url, h.image_width, h.image_height, h.optimized,
         h.thumbnail_url, h.link_target
  FROM envelope e LEFT JOIN ({_HYDRATED}) h ON h.request_id = e.request_id"""))
def search_response(spark, sf_dir):
    f = _f(spark, sf_dir)
    out = se.search(f.search_requests, f.tables(), CFG, f.request_embeddings, _postings(f.spark, f.sf_dir), limit=LIMIT)
    r = rs.envelope(out.envelope, rs.hydrate(out.results, f.tables()))
    x = r.select("request_id", "term", "processed_term", "search_ocr", "search_embeddings", "search_by_image", "has_more",
                 "error", "n_results", F.explode_outer("grouped_results").alias("i"))
    return x.select(
        "request_id", "term", "processed_term", "search_ocr", "search_embeddings", "search_by_image", "has_more", "error",
        "n_results", "i.rank", F.col("i.post.id").alias("post_id"), "i.post.post_number", F.col("i.user.id").alias("user_id"),
        "i.user.username", F.col("i.topic.id").alias("topic_id"), F.col("i.topic.title").alias("topic_title"),
        "i.topic.category_id", F.array_join("i.topic.tags", ",").alias("tags"), F.col("i.image.id").alias("upload_id"),
        F.col("i.image.url").alias("image_url"), F.col("i.image.width").alias("image_width"),
        F.col("i.image.height").alias("image_height"), _optimized(F.col("i.optimized_images")).alias("optimized"),
        "i.thumbnail_url", "i.link_target")


@register("backfill", """
  SELECT upload_id, CASE WHEN donor_id IS NOT NULL THEN 'reused' WHEN NOT (run_ocr OR run_embed) THEN 'skipped'
         WHEN NOT success THEN 'failed'
         WHEN run_ocr OR (run_embed AND embedding IS NOT NULL) THEN 'analyzed' ELSE 'skipped' END AS outcome
  FROM (""" + RUN + """) x""")
def backfill(spark, sf_dir):
    f = _f(spark, sf_dir)
    return bf.backfill(f.tables(), CFG, f.answers)[0]


_VOID = ", ".join(f"'{t}'" for t in rs.VOID_TAGS)
#: One pass over the tokens of a page: nesting inside a dropped block, head, body, and the text so far.
_EXCERPTS = f"""
  SELECT post_id, list_reduce(tokens, lambda s, t: CASE
    WHEN NOT regexp_matches(t, '^<(!|/?[a-zA-Z])') THEN struct_pack(skip := s.skip, head := s.head, body := s.body,
      txt := CASE WHEN s.skip = 0 AND NOT s.head AND s.body THEN s.txt || replace(replace(replace(replace(replace(replace(replace(replace(
        t, '&copy;', chr(169)), '&middot;', chr(183)), '&quot;', '"'), '&nbsp;', chr(160)), '&#39;', chr(39)), '&lt;', '<'), '&gt;', '>'), '&amp;', '&')
        ELSE s.txt END)
    WHEN regexp_matches(t, '^<!') THEN s
    WHEN regexp_matches(t, '(?i)^</?head[ >]') THEN struct_pack(skip := s.skip, head := NOT starts_with(t, '</'), body := s.body, txt := s.txt)
    WHEN regexp_matches(t, '(?i)^</?body[ >]') THEN struct_pack(skip := s.skip, head := s.head, body := NOT starts_with(t, '</'), txt := s.txt)
    WHEN lower(regexp_extract(t, '^</?([a-zA-Z][a-zA-Z0-9-]*)', 1)) IN ({_VOID}) OR ends_with(t, '/>') THEN s
    ELSE struct_pack(skip := CASE WHEN starts_with(t, '</') THEN greatest(s.skip - 1, 0) WHEN s.skip > 0 THEN s.skip + 1
           WHEN regexp_matches(t, 'class=["''][^"'']*(lightbox-wrapper|onebox)') THEN 1 ELSE 0 END,
         head := s.head, body := s.body, txt := s.txt) END,
    struct_pack(skip := 0, head := FALSE, body := NOT regexp_matches(cooked, '(?i)<body'), txt := '')).txt AS excerpt
  FROM (SELECT post_id, cooked, regexp_extract_all(cooked, '(?s)<!--.*?-->|</?[a-zA-Z][^>]*>|<![^>]*>|[^<]+|<') AS tokens
        FROM post_cooked WHERE post_id IN (SELECT post_id FROM results)) x"""


@register("post_excerpt", search_sql(f"""
  SELECT r.request_id, r.rank, r.post_id, CASE WHEN p.post_number > 1 THEN '#' || p.post_number || ' ' ELSE '' END || e.excerpt AS excerpt
  FROM results r LEFT JOIN posts p ON p.id = r.post_id LEFT JOIN ({_EXCERPTS}) e ON e.post_id = r.post_id"""))
def post_excerpt(spark, sf_dir):
    f = _f(spark, sf_dir)
    results = materialize(_search_results(f), "excerpt-results")
    h = rs.hydrate(results, f.tables()).select("request_id", "rank", "post_id", "post_number")
    return rs.post_excerpt(h, f.post_cooked).select("request_id", "rank", "post_id", "excerpt")
