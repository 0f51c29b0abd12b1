"""Registered queries: requests, filters and the four search modes."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import TEST_SETTINGS
from ..operators import bitmaps
from ..operators import filters as flt
from ..operators import search as se
from ..operators import textindex
from ..operators.requests import filter_rows, parse_requests, request_modes, validate_requests
from ..session import scratch_table_dir
from ..sources.testforum import TestForum
from .catalog import register
from .search_sql import _COS, _HAM, IMAGE_T, LIMIT, PASS, TEXT_T, _arg_case, search_sql

# FIXTURES: the test vectors pass 0.4 rarely, so text-to-image search runs at 0.1.
CFG = TEST_SETTINGS.with_(text_similarity_threshold=TEXT_T)


def _f(spark, sf_dir):
    return TestForum(spark, sf_dir)


def _prepared(spark, sf_dir):
    return se.prepare_requests(_f(spark, sf_dir).search_requests, LIMIT)


def _postings(spark, sf_dir):
    """The bitmap postings of the forum's images, stored as a deployment keeps them."""
    path = scratch_table_dir(spark, f"bitmaps-{uuid.uuid4().hex[:12]}")
    bitmaps.write_bitmaps(bitmaps.bitmap_postings(_f(spark, sf_dir).indexed_texts), path)
    return bitmaps.read_bitmaps(spark, path)


def _search(spark, sf_dir):
    f = _f(spark, sf_dir)
    return se.search(f.search_requests, f.tables(), CFG, f.request_embeddings, _postings(spark, sf_dir), limit=LIMIT)


@register("validate_requests", search_sql(
    "SELECT request_id, error FROM parsed", parts=()))
def validate(spark, sf_dir):
    return validate_requests(_f(spark, sf_dir).search_requests).select("request_id", "error")


@register("request_modes", search_sql(
    "SELECT request_id, search_by_image, search_ocr, search_embeddings, CAST(page_no AS BIGINT) AS page_no "
    "FROM parsed", parts=()))
def modes(spark, sf_dir):
    return request_modes(_f(spark, sf_dir).search_requests).select(
        "request_id", "search_by_image", "search_ocr", "search_embeddings", "page_no")


@register("tokenize_terms", search_sql(
    "SELECT request_id, CAST(wpos AS BIGINT) AS word_no, word FROM words", parts=()))
def tokenize_terms(spark, sf_dir):
    from ..functions.text import is_blank, query_tokens
    r = _f(spark, sf_dir).search_requests
    toks = F.when(is_blank(F.col("term")), F.array().cast("array<string>")).otherwise(query_tokens(F.col("term")))
    return r.select("request_id", F.posexplode(toks).alias("p", "word")).select(
        "request_id", (F.col("p") + 1).cast("long").alias("word_no"), "word")


@register("parse_requests", search_sql(f"""
  SELECT p.request_id, p.processed_term, f.filter_no, f.kind, f.arg
  FROM parsed p LEFT JOIN (
    SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY wpos) AS INTEGER) AS filter_no,
           kind, {_arg_case('cleaned', 'kind')} AS arg FROM kinded WHERE kind IS NOT NULL) f
  ON f.request_id = p.request_id""", parts=()))
def parse(spark, sf_dir):
    p = parse_requests(_f(spark, sf_dir).search_requests)
    return p.select("request_id", "processed_term", F.explode_outer("filters").alias("f")).select(
        "request_id", "processed_term", "f.filter_no", "f.kind", "f.arg")


@register("ocr_query_terms", search_sql("""
  SELECT q.request_id, q.lexeme, n.n_terms FROM qterms q JOIN nterms n ON n.request_id = q.request_id""",
                                        parts=("ocr",)))
def ocr_query_terms(spark, sf_dir):
    r = _prepared(spark, sf_dir).filter(F.col("error").isNull() & F.col("search_ocr"))
    t = textindex.request_terms(r)
    return t.select("request_id", "lexeme", F.col("n_terms").cast("long").alias("n_terms"))


@register("search_images_ocr", search_sql("SELECT request_id, upload_id FROM ocr_hits", parts=("ocr",)))
def search_images_ocr(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = se.prepare_requests(f.search_requests, LIMIT).filter(F.col("error").isNull() & F.col("search_ocr"))
    return textindex.search_images_ocr(r, textindex.postings(f.index), n_buckets=textindex.DEFAULT_BUCKETS)


@register("apply_filters", search_sql("SELECT request_id, post_id, upload_id FROM ocr_pairs", parts=("ocr",)))
def apply_filters(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = f.tables()
    r = se.prepare_requests(f.search_requests, LIMIT).filter(F.col("error").isNull() & F.col("search_ocr"))
    hits = bitmaps.search_bitmaps(r, _postings(spark, sf_dir))
    pairs = se.post_pairs(hits, t)
    out = flt.apply_filters(pairs, filter_rows(r.filter(F.size("filters") > 0)), t)
    return out.select("request_id", "post_id", "upload_id")


def _ocr_page(spark, sf_dir, postings=None):
    f = _f(spark, sf_dir)
    r = se.prepare_requests(f.search_requests, LIMIT).filter(F.col("error").isNull())
    out = se.ocr_side(r, f.tables(), postings, CFG)
    return out.select("request_id", "post_id", "upload_id", F.col("side_rank").cast("long").alias("side_rank"))


_OCR_SIDE = search_sql("SELECT request_id, post_id, upload_id, side_rank FROM ocr_side", parts=("ocr",))


@register("search_ocr_page", _OCR_SIDE)
def search_ocr_page(spark, sf_dir):
    """Rarest term first over the table of single postings."""
    path = scratch_table_dir(spark, f"postings-{uuid.uuid4().hex[:12]}")
    textindex.write_postings(textindex.postings(_f(spark, sf_dir).index), path)
    return _ocr_page(spark, sf_dir, textindex.read_postings(spark, path))


@register("search_ocr", _OCR_SIDE)
def search_ocr(spark, sf_dir):
    return _ocr_page(spark, sf_dir, _postings(spark, sf_dir))


#: A word of an image that begins with the term fulfils it.
_PREFIX_HITS = """
  SELECT request_id, upload_id FROM (
    SELECT DISTINCT q.request_id, q.lexeme, l.upload_id FROM qterms q JOIN img_lex l ON starts_with(l.lexeme, q.lexeme)) x
  GROUP BY request_id, upload_id
  HAVING count(*) = (SELECT n.n_terms FROM nterms n WHERE n.request_id = x.request_id)"""


@register("search_prefix", search_sql(_PREFIX_HITS, parts=("ocr",)))
def search_prefix(spark, sf_dir):
    r = _prepared(spark, sf_dir).filter(F.col("error").isNull() & F.col("search_ocr"))
    return bitmaps.search_bitmaps(r, _postings(spark, sf_dir), prefix=True)


@register("knn_hybrid_stage", search_sql("SELECT request_id, upload_id, CAST(img_rank AS BIGINT) AS img_rank "
                                         "FROM emb_imgs", parts=("emb",)))
def knn_hybrid_stage(spark, sf_dir):
    from ..operators import knn
    f = _f(spark, sf_dir)
    r = se.prepare_requests(f.search_requests, LIMIT).filter(
        F.col("error").isNull() & (F.col("search_embeddings") | F.col("search_by_image")))
    thr = F.when(F.col("search_by_image"), F.lit(CFG.image_similarity_threshold)).otherwise(
        F.lit(CFG.text_similarity_threshold))
    q = r.select("request_id", thr.alias("threshold"), F.col("side_limit").alias("limit"),
                 F.col("side_offset").alias("offset")).join(f.request_embeddings, "request_id")
    out = knn.search_images_embedding(q, f.index, CFG.embedding_dim)
    return out.select("request_id", "upload_id", F.col("rank").alias("img_rank"))


@register("search_embedding", search_sql("SELECT request_id, post_id, upload_id, side_rank FROM emb_side",
                                         parts=("emb",)))
def search_embedding(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = se.prepare_requests(f.search_requests, LIMIT).filter(F.col("error").isNull())
    return se.rank_embedding_side(se.embedding_side(r, f.tables(), f.request_embeddings, CFG))


@register("search_batch", search_sql("SELECT request_id, rank, post_id, upload_id FROM results"))
def search_batch(spark, sf_dir):
    return _search(spark, sf_dir).results


_MODE = ("SELECT r.request_id, r.rank, r.post_id, r.upload_id FROM results r JOIN valid v "
         "ON v.request_id = r.request_id WHERE {cond}")


@register("search_combined", search_sql(_MODE.format(cond="v.search_ocr AND v.search_embeddings")))
def search_combined(spark, sf_dir):
    r = _prepared(spark, sf_dir).filter(F.col("search_ocr") & F.col("search_embeddings")).select("request_id")
    return _search(spark, sf_dir).results.join(r, "request_id", "left_semi")


@register("search_by_image", search_sql(_MODE.format(cond="v.search_by_image")))
def search_by_image(spark, sf_dir):
    r = _prepared(spark, sf_dir).filter(F.col("search_by_image")).select("request_id")
    return _search(spark, sf_dir).results.join(r, "request_id", "left_semi")


@register("search_envelope", search_sql("SELECT * FROM envelope"))
def search_envelope(spark, sf_dir):
    return _search(spark, sf_dir).envelope


@register("has_more", search_sql("SELECT request_id, has_more FROM envelope"))
def has_more(spark, sf_dir):
    return _search(spark, sf_dir).envelope.select("request_id", "has_more")


# ------------------------------------------------------------ filters on posts
def _filters(spark, sf_dir, kind):
    r = _prepared(spark, sf_dir).filter(F.col("error").isNull())
    return filter_rows(r).filter(F.col("kind") == kind)


def _posts(f):
    return f.posts.select(F.col("id").alias("post_id"), "topic_id", "user_id", "created_at")


_FILTER_POSTS = "SELECT f.request_id, p.id AS post_id FROM filt f JOIN posts p ON {on} WHERE f.kind = '{kind}'"
_FILTER_HITS = """
  SELECT h.request_id, h.post_id, h.upload_id
  FROM (SELECT o.request_id, b.* FROM ocr_hits o JOIN pair_base b ON b.upload_id = o.upload_id) h
  JOIN filt f ON f.request_id = h.request_id AND f.kind = '{kind}' GROUP BY ALL HAVING bool_and({on})"""


def _filter_hits(spark, sf_dir, kind):
    """``apply_filters`` with the filters of one kind, over the text matches of the requests that have any."""
    f = _f(spark, sf_dir)
    t = f.tables()
    r = _prepared(spark, sf_dir).filter(F.col("error").isNull() & F.col("search_ocr"))
    filters = filter_rows(r).filter(F.col("kind") == kind)
    r = r.join(filters.select("request_id").distinct(), "request_id", "left_semi")
    pairs = se.post_pairs(bitmaps.search_bitmaps(r, _postings(spark, sf_dir)), t)
    return flt.apply_filters(pairs, filters, t, kinds=[kind]).select("request_id", "post_id", "upload_id")


@register("filter_topic", search_sql(_FILTER_HITS.format(on="h.topic_id = TRY_CAST(f.arg AS BIGINT)", kind="topic"),
                                     parts=("ocr",)))
def filter_topic(spark, sf_dir):
    return _filter_hits(spark, sf_dir, "topic")


@register("filter_before", search_sql(_FILTER_HITS.format(on="f.dt IS NULL OR h.created_at < f.dt", kind="before"),
                                      parts=("ocr",)))
def filter_before(spark, sf_dir):
    return _filter_hits(spark, sf_dir, "before")


@register("filter_after", search_sql(_FILTER_HITS.format(on="f.dt IS NULL OR h.created_at > f.dt", kind="after"),
                                     parts=("ocr",)))
def filter_after(spark, sf_dir):
    return _filter_hits(spark, sf_dir, "after")


# A kind of the forum's own, on a predicate of the candidate.
flt.register_filter("min_post", r"(?i)\Aminpost:(\d+)\z",
                    check=lambda arg: F.coalesce(F.col("post_id") >= arg.try_cast("bigint"), F.lit(False)),
                    mask=lambda posts, arg, keys: posts["post_id"] >= int(arg))


@register("filter_custom", search_sql(_FILTER_HITS.format(on="h.post_id >= TRY_CAST(f.arg AS BIGINT)", kind="min_post"),
                                      parts=("ocr",)))
def filter_custom(spark, sf_dir):
    return _filter_hits(spark, sf_dir, "min_post")


@register("filter_user", search_sql(_FILTER_POSTS.format(on="p.user_id = f.user_id", kind="user"), parts=()))
def filter_user(spark, sf_dir):
    f = _f(spark, sf_dir)
    u = flt.resolve_users(_filters(spark, sf_dir, "user"), f.tables()).withColumnRenamed("value", "user_id")
    return u.join(_posts(f), "user_id").select("request_id", "post_id")


@register("filter_tags_any", search_sql(_FILTER_HITS.format(
    on="EXISTS (SELECT 1 FROM topic_tags tt JOIN tags g ON g.id = tt.tag_id WHERE tt.topic_id = h.topic_id "
       "AND list_contains(string_split(f.arg, ','), g.name))", kind="tags"), parts=("ocr",)))
def filter_tags_any(spark, sf_dir):
    return _filter_hits(spark, sf_dir, "tags")


_CAT_POSTS = """
  SELECT DISTINCT f.request_id, p.id AS post_id FROM filt f
  JOIN cat_ids ci ON ci.request_id = f.request_id AND ci.filter_no = f.filter_no
  JOIN topics t ON t.category_id = ci.category_id JOIN posts p ON p.topic_id = t.id
  WHERE f.kind = '{kind}'"""


@register("filter_category", search_sql(_CAT_POSTS.format(kind="category"), parts=()))
def filter_category(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = f.tables()
    ids = flt.resolve_categories(_filters(spark, sf_dir, "category"), t).withColumnRenamed("value", "category_id")
    topics = t.topics.select(F.col("id").alias("topic_id"), "category_id")
    return ids.join(topics, "category_id").join(_posts(f), "topic_id").select("request_id", "post_id").distinct()


@register("filter_category_slug", search_sql(_CAT_POSTS.format(kind="category_slug"), parts=()))
def filter_category_slug(spark, sf_dir):
    f = _f(spark, sf_dir)
    t = f.tables()
    ids = flt.resolve_slugs(_filters(spark, sf_dir, "category_slug"), t).withColumnRenamed("value", "category_id")
    topics = t.topics.select(F.col("id").alias("topic_id"), "category_id")
    return ids.join(topics, "category_id").join(_posts(f), "topic_id").select("request_id", "post_id").distinct()


@register("category_terms", search_sql(
    "SELECT request_id, filter_no, cid, exact FROM cat_found", parts=()))
def category_terms(spark, sf_dir):
    f = _f(spark, sf_dir)
    return flt.category_terms(_filters(spark, sf_dir, "category"), f.tables()).select(
        "request_id", "filter_no", "cid", "exact")


@register("category_closure", "SELECT root, id FROM category_closure")
def category_closure(spark, sf_dir):
    return flt.category_closure(_f(spark, sf_dir).categories)


#: Pages follow from the ranks; a page that begins beyond the last row of its side is empty.
_PAGES = """,
ocr_paged AS (
  SELECT request_id, post_id, upload_id, (pos - 1) // side_limit AS page_no, pos - (pos - 1) // side_limit * side_limit AS side_rank
  FROM (SELECT p.request_id, p.post_id, p.upload_id, v.side_limit, v.page_no AS upto,
               row_number() OVER (PARTITION BY p.request_id ORDER BY p.post_id DESC, p.upload_id DESC) AS pos
        FROM ocr_pairs p JOIN valid v ON v.request_id = p.request_id) x
  WHERE (pos - 1) // side_limit <= upto),
emb_all AS (
  SELECT * FROM (
    SELECT v.request_id, v.side_limit, v.page_no AS upto, i.upload_id, CASE WHEN v.search_by_image THEN {image} ELSE {text} END AS thr,
           {cos} AS sim, row_number() OVER (PARTITION BY v.request_id ORDER BY {ham}, i.upload_id) AS cand_rank
    FROM valid v JOIN request_embeddings q ON q.request_id = v.request_id, image_search_data i
    WHERE (v.search_embeddings OR v.search_by_image) AND i.embeddings IS NOT NULL) x WHERE sim >= thr),
emb_pages AS (
  SELECT * FROM (SELECT *, unnest(range(0, least(upto, (SELECT count(*) FROM image_search_data) // side_limit) + 1)) AS page_no FROM emb_all) x
  WHERE cand_rank <= 2 * side_limit + page_no * side_limit),
emb_shown AS (
  SELECT request_id, page_no, upload_id, pos - page_no * side_limit AS img_rank FROM (
    SELECT *, row_number() OVER (PARTITION BY request_id, page_no ORDER BY sim DESC, upload_id) AS pos FROM emb_pages) x
  WHERE pos > page_no * side_limit AND pos <= (page_no + 1) * side_limit),
emb_paged AS (
  SELECT h.* FROM (SELECT o.request_id, o.page_no, o.img_rank, b.* FROM emb_shown o JOIN pair_base b ON b.upload_id = o.upload_id) h
  WHERE {passes}),
paged AS (
  SELECT request_id, page_no, post_id, upload_id, min(side_rank) AS first_rank FROM (
    SELECT request_id, page_no, post_id, upload_id, side_rank FROM ocr_paged
    UNION ALL SELECT request_id, page_no, post_id, upload_id, img_rank FROM emb_paged) x GROUP BY ALL)
SELECT p.request_id, CAST(p.page_no AS BIGINT) AS page_no, post_id, upload_id,
       CAST(row_number() OVER (PARTITION BY p.request_id, p.page_no ORDER BY
            CASE WHEN v.search_ocr AND v.search_embeddings THEN 0 ELSE first_rank END, post_id DESC, upload_id DESC) AS BIGINT) AS rank
FROM paged p JOIN valid v ON v.request_id = p.request_id"""


def _paged_sql() -> str:
    tail = _PAGES.format(image=IMAGE_T, text=TEXT_T, cos=_COS, ham=_HAM, passes=PASS)
    return search_sql("", parts=("ocr",)).rstrip() + tail


@register("pages_cumulative", _paged_sql())
def pages_cumulative(spark, sf_dir):
    f = _f(spark, sf_dir)
    return se.cumulative_pages(f.search_requests, f.tables(), CFG, f.request_embeddings, _postings(spark, sf_dir), limit=LIMIT)


#: The requests with filters, as text-to-image searches: the top-k is taken from the images that pass.
_FILTERED = "(SELECT * REPLACE ('GET' AS method, 'false' AS ocr, 'true' AS embed, 0 AS page) FROM search_requests WHERE request_id < 1000 AND page < 100) r"


def _prefilter_sql() -> str:
    sql = search_sql("SELECT r.request_id, r.rank, r.post_id, r.upload_id FROM results r JOIN "
                     "(SELECT DISTINCT request_id FROM filt) f ON f.request_id = r.request_id").replace(
        "FROM search_requests r", f"FROM {_FILTERED}")
    allowed = f"""allowed_images AS (
  SELECT DISTINCT h.request_id, h.upload_id FROM (SELECT v.request_id, b.* FROM valid v, pair_base b) h WHERE {PASS}),
emb_q AS ("""
    sql = sql.replace("emb_q AS (", allowed, 1)
    return sql.replace("WHERE i.embeddings IS NOT NULL) x", """WHERE i.embeddings IS NOT NULL AND
      EXISTS (SELECT 1 FROM allowed_images a WHERE a.request_id = q.request_id AND a.upload_id = i.upload_id)) x""", 1)


@register("search_prefilter", _prefilter_sql())
def search_prefilter(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = f.search_requests.filter((F.col("request_id") < 1000) & (F.col("page") < 100)).withColumns(
        {"method": F.lit("GET"), "ocr": F.lit("false"), "embed": F.lit("true"), "page": F.lit(0).cast("long")})
    found = se.search(r, f.tables(), CFG, f.request_embeddings, limit=LIMIT, prefilter=True).results
    asked = filter_rows(se.prepare_requests(r, LIMIT).filter(F.col("error").isNull())).select("request_id").distinct()
    return found.join(asked, "request_id", "left_semi")
