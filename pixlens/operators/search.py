"""Image search for a batch of requests: OCR, embedding, combined, by image.

Plan per batch: requests -> validate -> modes -> parse -> per-mode image hits
(posting join or two-stage kNN) -> (post, upload) pairs on searchable posts ->
advanced filters -> per-request ordering and paging -> union + de-dup.

Per-request top-k uses ``row_number`` with a literal upper bound so Spark plans
a ``WindowGroupLimit`` before the shuffle: a request matching a third of all
posts still ships only ``offset + limit`` rows per partition.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from ..config import PAGE_SIZE, Settings
from ..session import ensure_checkpoint_dir, materialize
from ..sources.tables import ForumTables
from . import eligibility as el
from . import filters as flt
from . import bitmaps, knn, textindex
from . import prefilter as pf
from .ordering import rank_in_groups
from .requests import FILTER_PATTERNS, filter_rows, parse_requests, request_modes, validate_requests


#: Requests whose page ends within this many rows are cut by a window with this literal bound (a partial
#: top-k before the shuffle); deeper pages are ranked in blocks. Both give the same rows.
SHALLOW = 1024
#: The same for first pages.
FIRST = 64


@dataclass
class SearchOutput:
    results: DataFrame  # request_id, rank, post_id, upload_id
    envelope: DataFrame  # one row per request


def prepare_requests(requests: DataFrame, limit: int = PAGE_SIZE) -> DataFrame:
    """Validated, moded, parsed requests with per-side limits and offsets.

    Combined mode gives each side ``limit div 2`` (T8). Offsets are linear in
    the page number.
    """
    r = parse_requests(request_modes(validate_requests(requests)))
    both = F.col("search_ocr") & F.col("search_embeddings")
    side = F.when(both, F.lit(limit // 2)).otherwise(F.lit(limit))
    return r.select("*", side.cast("int").alias("side_limit"),
                    (F.col("page_no") * side).cast("long").alias("side_offset"))


def shown_posts(upload_ids: DataFrame, t: ForumTables, cfg: Settings | None = None,
                strict_visibility: bool = False, with_category: bool = True) -> DataFrame:
    """(upload_id, post_id, topic_id, user_id, created_at, category_id) of the searchable posts of the given uploads."""
    posts = el.searchable_posts(t.posts, t, cfg, strict_visibility).select(
        F.col("id").alias("post_id"), "topic_id", "user_id", "created_at")
    # An index row whose upload is gone is no result.
    ids = upload_ids.select("upload_id").distinct().join(t.uploads.select(F.col("id").alias("upload_id")), "upload_id", "left_semi")
    shown = t.post_uploads.join(ids, "upload_id", "left_semi").join(posts, "post_id")
    if not with_category:  # only category filters read it
        return shown.withColumn("category_id", F.lit(None).cast("long"))
    topics = t.topics.select(F.col("id").alias("topic_id"), "category_id")
    return shown.join(topics, "topic_id", "left")


def post_pairs(hits: DataFrame, t: ForumTables, cfg: Settings | None = None,
               strict_visibility: bool = False, with_category: bool = True) -> DataFrame:
    """(request_id, upload_id, ...) hits -> rows per (post, upload) on searchable posts.

    The posts of the images that were hit are gathered once per image; the hits meet them in the last join, so
    the rows per (request, post) are not shuffled here.
    """
    hits = materialize(hits, "search-hits")
    shown = materialize(shown_posts(hits, t, cfg, strict_visibility, with_category), "search-shown")
    return hits.join(shown, "upload_id")


def _filtered(pairs: DataFrame, reqs: DataFrame, t: ForumTables, closure: DataFrame | None = None,
              kinds: list[str] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    return flt.apply_filters(pairs, filter_rows(reqs.filter(F.size("filters") > 0)), t, closure, kinds, allowed)


def ocr_hits(reqs: DataFrame, t: ForumTables, postings: DataFrame | None, cfg: Settings | None) -> DataFrame:
    """(request_id, upload_id) of the images whose text holds the words of the request."""
    how = {} if cfg is None else {"cjk_bigrams": cfg.cjk_bigrams, "lexeme_filter": cfg.lexeme_filter}
    terms = reqs.select("request_id", "processed_term")
    if postings is None:
        return textindex.search_images_ocr_scan(terms, t.index, **how)
    if "bits" in postings.columns:
        return bitmaps.search_bitmaps(terms, postings, **how)
    return textindex.search_images_ocr(terms, postings, **how)


def ocr_side(reqs: DataFrame, t: ForumTables, postings: DataFrame | None, cfg: Settings | None,
             paging: str = "linear", strict_visibility: bool = False,
             closure: DataFrame | None = None, kinds: list[str] | None = None,
             allowed: DataFrame | None = None, deep: bool = True,
             found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """OCR matches, filters before the limit, newest post first.

    ``deep=False`` tells that no request's page ends beyond ``SHALLOW`` rows. ``found``: the matches
    (``ocr_hits``) and the posts of at least their images (``shown_posts``), as tables.
    """
    off = F.col("side_offset") if paging == "linear" else F.col("page_no") * F.col("side_offset")
    r = materialize(reqs.filter(F.col("search_ocr")).withColumn("off", off), "search-requests")  # each branch reads it
    with_cat = kinds is None or any(k in ("category", "category_slug") for k in kinds)
    is_deep = F.col("off") + F.col("side_limit") > SHALLOW

    if found is None:
        hits = materialize(ocr_hits(r, t, postings, cfg), "search-hits")  # (request, image) pairs, read by the branches below
        shown = materialize(shown_posts(hits, t, cfg, strict_visibility, with_cat), "search-shown")
    else:
        hits, shown = found
    newest = shown.groupBy("upload_id").agg(F.max("post_id").alias("newest"))
    ends = F.col("off") + F.col("side_limit")
    cols = ("request_id", "post_id", "upload_id")

    def own(asked):
        return hits.join(asked.select("request_id"), "request_id", "left_semi")

    def near(asked, bound):
        """Pairs of requests without filters: at least those of the first ``bound`` ranks that a request needs.

        The newest posts of as many images as the page has rows are that many pairs; older posts come after them.
        """
        w = Window.partitionBy("request_id").orderBy(F.col("newest").desc(), F.col("upload_id").desc())
        mine = own(asked).join(newest, "upload_id")
        top = mine.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= bound)
        last = top.join(asked.select("request_id", ends.alias("_ends")), "request_id").filter(F.col("_n") == F.col("_ends")).groupBy(
            "request_id").agg(F.max("newest").alias("_from"))
        some = mine.join(last, "request_id", "left").filter(F.col("_from").isNull() | (F.col("newest") >= F.col("_from")))
        return some.select("request_id", "upload_id", "_from").join(shown, "upload_id").filter(
            F.col("_from").isNull() | (F.col("post_id") >= F.col("_from"))).select(*cols)

    # Requests without filters bypass the filter stage.
    plain, some = r.filter(F.size("filters") == 0), r.filter(F.size("filters") > 0)
    passed = None
    if kinds is None or kinds:
        passed = _filtered(own(some).join(shown, "upload_id"), some, t, closure, kinds, allowed).select(*cols)
        if deep:
            passed = materialize(passed, "search-passed")

    def first(pairs, bound):
        w = Window.partitionBy("request_id").orderBy(F.col("post_id").desc(), F.col("upload_id").desc())
        return pairs.withColumn("pos", F.row_number().over(w).cast("long")).filter(F.col("pos") <= bound)

    def of(pairs, asked):
        return pairs.join(asked.select("request_id"), "request_id", "left_semi")

    # The tighter bound keeps fewer rows of the first pages.
    ranked = first(near(plain.filter(ends <= FIRST), FIRST), FIRST).unionByName(
        first(near(plain.filter((ends > FIRST) & ~is_deep), SHALLOW), SHALLOW))
    if passed is not None:
        ranked = ranked.unionByName(first(of(passed, r.filter(~is_deep)) if deep else passed, SHALLOW))
    if deep:
        far = own(plain.filter(is_deep)).join(shown, "upload_id").select(*cols)
        found = materialize(far if passed is None else far.unionByName(of(passed, r.filter(is_deep))), "search-deep")
        ranked = ranked.unionByName(rank_in_groups(found, "request_id", F.lit(0), "post_id",
                                                   [F.col("upload_id").desc()], "pos"))
    p = r.select("request_id", "side_limit", "off")
    page = ranked.join(p, "request_id").filter(
        (F.col("pos") > F.col("off")) & (F.col("pos") <= F.col("off") + F.col("side_limit")))
    return page.select("request_id", "post_id", "upload_id", (F.col("pos") - F.col("off")).alias("side_rank"))


def embedding_hits(reqs: DataFrame, t: ForumTables, query_vectors: DataFrame, cfg: Settings,
                   vindex: DataFrame | None = None, oversample: float = 2, method: str = "exact",
                   strict_visibility: bool = False, closure: DataFrame | None = None,
                   kinds: list[str] | None = None, allowed: DataFrame | None = None,
                   every_page: bool = False, prefilter: bool = False) -> DataFrame:
    """V4: the image top-k of each request: (request_id, upload_id, img_rank), see ``embedding_side``."""
    r = reqs.filter(F.col("search_embeddings") | F.col("search_by_image"))
    thr = F.when(F.col("search_by_image"), F.lit(cfg.image_similarity_threshold)).otherwise(
        F.lit(cfg.text_similarity_threshold))
    q = r.select("request_id", thr.alias("threshold"), F.col("side_limit").alias("limit"),
                 F.col("side_offset").alias("offset")).join(query_vectors.select("request_id", "qvec"), "request_id")
    page = ["page_no"] if every_page else []
    if every_page:
        q = q.join(r.select("request_id", (F.col("page_no") + 1).alias("pages")), "request_id")
        imgs = knn.search_images_every_page(q, t.index, cfg.embedding_dim, vindex=vindex, oversample=oversample)
    else:
        posts = None
        if prefilter and (kinds is None or kinds):
            asked = filter_rows(r.filter(F.size("filters") > 0))
            bad = [k for k in kinds or [] if k not in flt.KINDS or flt.KINDS[k].mask is None]
            if bad:
                raise ValueError(f"filter kinds without a mask cannot go below the top-k: {bad}")
            q = q.join(flt.request_filters(asked, t, closure, kinds, allowed), "request_id", "left")
            shown = post_pairs(t.index.filter(F.col("embeddings").isNotNull()).select("upload_id"), t, cfg, strict_visibility)
            posts = pf.image_posts(shown, t, with_tags=kinds is None or "tags" in kinds)
        imgs = knn.search_images_embedding(q, t.index, cfg.embedding_dim, vindex=vindex, oversample=oversample,
                                           method=method, posts=posts)
    return imgs.select("request_id", *page, "upload_id", F.col("rank").alias("img_rank"))


def embedding_side(reqs: DataFrame, t: ForumTables, query_vectors: DataFrame, cfg: Settings,
                   vindex: DataFrame | None = None, oversample: float = 2, method: str = "exact",
                   strict_visibility: bool = False, closure: DataFrame | None = None,
                   kinds: list[str] | None = None, allowed: DataFrame | None = None,
                   every_page: bool = False, prefilter: bool = False,
                   found: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """V4 + T4: image top-k first (limit applies to images), then posts by image rank.

    ``prefilter`` (exact method) takes the top-k of a request with filters from the images that pass them.

    ``every_page`` (exact method) gives the pages 0..page_no of each request, with their ``page_no``.
    ``found``: the images (``embedding_hits``) and the posts of at least these (``shown_posts``), as tables.
    """
    r = reqs.filter(F.col("search_embeddings") | F.col("search_by_image"))
    page = ["page_no"] if every_page else []
    if found is None:
        hits = embedding_hits(reqs, t, query_vectors, cfg, vindex, oversample, method, strict_visibility, closure, kinds,
                              allowed, every_page, prefilter)
        with_cat = kinds is None or any(k in ("category", "category_slug") for k in kinds)
        pairs = post_pairs(hits, t, cfg, strict_visibility, with_cat)
    else:
        hits, shown = found
        pairs = hits.join(shown, "upload_id")
    pairs = _filtered(pairs, r, t, closure, kinds, allowed)
    # Every post holding a top image is returned (no limit on posts), so one
    # image may bring a third of all posts: no per-request window here.
    return pairs.select("request_id", *page, "post_id", "upload_id", "img_rank")


def _found(of_ocr: DataFrame | None, of_emb: DataFrame | None, t: ForumTables, cfg: Settings, strict_visibility: bool,
           kinds: list[str]):
    """The matches of both sides with the posts of their images, which are gathered once for both."""
    hits = [None if h is None else materialize(h, "search-hits") for h in (of_ocr, of_emb)]
    ids = [h.select("upload_id") for h in hits if h is not None]
    if not ids:
        return None, None
    with_cat = any(k in ("category", "category_slug") for k in kinds)
    shown = materialize(shown_posts(ids[0] if len(ids) == 1 else ids[0].unionByName(ids[1]), t, cfg, strict_visibility, with_cat),
                        "search-shown")
    return [None if h is None else (h, shown) for h in hits]


def rank_embedding_side(pairs: DataFrame) -> DataFrame:
    """T4: posts ordered by their image's rank, then newest post."""
    held = materialize(pairs, "search-embedding")
    return rank_in_groups(held, "request_id", F.col("img_rank"), "post_id", [F.col("upload_id").desc()], "side_rank") \
        .select("request_id", "post_id", "upload_id", "side_rank")


@dataclass
class _Batch:
    prepared: DataFrame
    reqs: DataFrame  # the valid ones
    need: Row  # which sides, whether pages are deep
    kinds: list[str]
    closure: DataFrame | None
    allowed: DataFrame | None


def _plan_batch(requests: DataFrame, t: ForumTables, limit: int, paging: str) -> _Batch:
    """Parse a batch once and resolve its filters."""
    # The parsed request batch is small and feeds every branch: checkpoint it
    # once (reliable storage in spark.checkpoint.dir) so each branch reads a
    # short plan. One tiny job then tells which branches the batch needs.
    ensure_checkpoint_dir(requests.sparkSession)
    prepared = prepare_requests(requests, limit).checkpoint(eager=True)
    reqs = prepared.filter(F.col("error").isNull())
    # One one-row job: which sides, whether pages are deep, the filter kinds present.
    # Fixed-width aggregates (one flag per known filter kind): bounded whatever the batch size.
    known = [k for k, _ in FILTER_PATTERNS]
    def is_kind(k):
        return lambda x: x["kind"] == k

    flags = [F.max(F.exists("filters", is_kind(k)).cast("int")).alias(f"k{i}") for i, k in enumerate(known)]
    ends = F.col("side_offset") * (F.col("page_no") if paging != "linear" else F.lit(1)) + F.col("side_limit")
    need = reqs.agg(F.max(F.col("search_ocr").cast("int")).alias("ocr"),
                    F.max((F.col("search_embeddings") | F.col("search_by_image")).cast("int")).alias("emb"),
                    F.max(F.when(F.col("search_ocr"), ends)).alias("ends"), *flags).first()
    kinds = [k for i, k in enumerate(known) if need[f"k{i}"]]
    closure = allowed = None
    if "category" in kinds or "category_slug" in kinds:
        closure = flt.category_closure(t.categories).checkpoint(eager=True)
    if kinds:
        # Resolve every filter of the batch once; both sides probe the same table.
        allowed = flt.resolve_filters(filter_rows(reqs.filter(F.size("filters") > 0)), t, closure,
                                      kinds).checkpoint(eager=True)
    return _Batch(prepared, reqs, need, kinds, closure, allowed)


def _ranked(both: DataFrame, reqs: DataFrame, page: list[str]) -> tuple[DataFrame, DataFrame]:
    """(distinct pairs, their ranks) of the union of both sides, per request and ``page`` columns."""
    modes = reqs.select("request_id", "search_ocr", "search_embeddings")
    # First occurrence of a pair: smallest (src, side_rank), packed into one long
    # so the de-duplication stays a hash aggregate (a struct min would sort).
    packed = F.col("src").cast("long") * F.lit(1 << 40) + F.col("side_rank").cast("long")
    uniq = both.groupBy("request_id", *page, "post_id", "upload_id").agg(F.min(packed).alias("_first"))
    uniq = uniq.join(modes, "request_id")
    combined = F.col("search_ocr") & F.col("search_embeddings")
    # Combined: newest post first. Single mode: that side's own order.
    order_key = F.when(combined, F.lit(0)).otherwise(F.col("_first").bitwiseAND(F.lit((1 << 40) - 1)))
    keyed = uniq.select("request_id", *page, "post_id", "upload_id", order_key.alias("_k"))
    # Embedding results keep every post of a top image, so a request's result set is unbounded: ranked in blocks.
    results = rank_in_groups(keyed, ["request_id", *page], F.col("_k"), "post_id", [F.col("upload_id").desc()]).select(
        "request_id", *page, "post_id", "upload_id", "rank")
    return uniq, results


def search(requests: DataFrame, t: ForumTables, cfg: Settings, query_vectors: DataFrame,
           postings: DataFrame | None = None, vindex: DataFrame | None = None, limit: int = PAGE_SIZE,
           paging: str = "linear", strict_visibility: bool = False, method: str = "exact",
           oversample: float = 2, prefilter: bool = False) -> SearchOutput:
    """All four modes for a batch of requests.

    ``query_vectors`` (request_id, qvec) comes from the user's embedder (text
    for embedding mode, image for by-image mode), see ``embed_queries``.
    ``postings`` is a table of ``bitmaps`` or of ``textindex``; without one the index is scanned.
    ``method`` and ``oversample`` choose the vector search (see ``knn``),
    ``prefilter`` puts filters below its top-k (see ``prefilter``). The
    matches of both sides are written once; results and envelope read them.
    """
    b = _plan_batch(requests, t, limit, paging)
    prepared, reqs, need, kinds, closure, allowed = b.prepared, b.reqs, b.need, b.kinds, b.closure, b.allowed

    sides = []
    ocr_found, emb_found = _found(
        ocr_hits(reqs.filter(F.col("search_ocr")), t, postings, cfg) if need["ocr"] else None,
        embedding_hits(reqs, t, query_vectors, cfg, vindex, oversample, method, strict_visibility, closure, kinds, allowed,
                       prefilter=prefilter) if need["emb"] else None, t, cfg, strict_visibility, kinds)
    if need["ocr"]:
        ocr = ocr_side(reqs, t, postings, cfg, paging, strict_visibility, closure, kinds, allowed,
                       deep=(need["ends"] or 0) > SHALLOW, found=ocr_found)
        sides.append(ocr.select("request_id", "post_id", "upload_id", F.lit(1).alias("src"), "side_rank"))
    if need["emb"]:
        emb = embedding_side(reqs, t, query_vectors, cfg, vindex, oversample, method, strict_visibility,
                             closure=closure, kinds=kinds, allowed=allowed, prefilter=prefilter, found=emb_found)
        # img_rank orders the side; post_id desc breaks ties in the final rank.
        sides.append(emb.select("request_id", "post_id", "upload_id", F.lit(0).alias("src"),
                                F.col("img_rank").cast("long").alias("side_rank")))
    if sides:
        both = materialize(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]), "search-sides")
    else:
        both = reqs.sparkSession.createDataFrame(
            [], "request_id long, post_id long, upload_id long, src int, side_rank long")

    uniq, results = _ranked(both, reqs, [])

    # has_more counts the (post, image) rows of each side before de-duplication.
    side_n = both.groupBy("request_id").agg(F.count_if(F.col("src") == 1).alias("n_ocr"),
                                            F.count_if(F.col("src") == 0).alias("n_emb"))
    res_n = uniq.groupBy("request_id").agg(F.count("*").alias("n_results"))
    counts = reqs.select("request_id", "side_limit", "search_ocr", "search_embeddings", "search_by_image") \
        .join(side_n, "request_id", "left").join(res_n, "request_id", "left")
    n_ocr, n_emb = F.coalesce("n_ocr", F.lit(0)), F.coalesce("n_emb", F.lit(0))
    has_more = (F.when(F.col("search_ocr") & F.col("search_embeddings"),
                       (n_emb >= F.col("side_limit")) | (n_ocr >= F.col("side_limit")))
                .when(F.col("search_ocr"), n_ocr >= F.col("side_limit"))
                .when(F.col("search_embeddings") | F.col("search_by_image"), n_emb >= F.col("side_limit"))
                .otherwise(F.lit(False)))
    env = counts.select("request_id", has_more.alias("has_more"),
                        F.coalesce("n_results", F.lit(0)).alias("n_results"))
    envelope = prepared.select(
        "request_id", "term", "processed_term", "search_ocr", "search_embeddings", "search_by_image",
        "page_no", "error").join(env, "request_id", "left").select(
        "request_id", "term", "processed_term", "search_ocr", "search_embeddings", "search_by_image",
        "page_no", "error", F.coalesce("has_more", F.lit(False)).alias("has_more"),
        F.coalesce("n_results", F.lit(0)).cast("long").alias("n_results"))
    return SearchOutput(results=results, envelope=envelope)


def cumulative_pages(requests: DataFrame, t: ForumTables, cfg: Settings, query_vectors: DataFrame,
                     postings: DataFrame | None = None, vindex: DataFrame | None = None, limit: int = PAGE_SIZE,
                     strict_visibility: bool = False, oversample: float = 2) -> DataFrame:
    """Everything shown after paging to ``page``: (request_id, page_no, rank, post_id, upload_id).

    Each page 0..page is what ``search`` (linear paging, exact vectors) answers for it. Both sides are
    searched once per request for the range of ranks up to the last page and the page number follows
    from the rank, so the work grows with the results and not with the page number.
    """
    b = _plan_batch(requests, t, limit, "linear")
    size = b.reqs.select("request_id", F.col("side_limit").alias("_size"))
    sides = []
    ocr_found, emb_found = _found(
        ocr_hits(b.reqs.filter(F.col("search_ocr")), t, postings, cfg) if b.need["ocr"] else None,
        embedding_hits(b.reqs, t, query_vectors, cfg, vindex, oversample, "exact", strict_visibility, b.closure, b.kinds,
                       b.allowed, every_page=True) if b.need["emb"] else None, t, cfg, strict_visibility, b.kinds)
    if b.need["ocr"]:
        upto = b.reqs.withColumn("side_limit", ((F.col("page_no") + 1) * F.col("side_limit")).cast("long")) \
            .withColumn("side_offset", F.lit(0).cast("long"))
        ocr = ocr_side(upto, t, postings, cfg, "linear", strict_visibility, b.closure, b.kinds, b.allowed,
                       deep=(b.need["ends"] or 0) > SHALLOW, found=ocr_found).join(size, "request_id")
        page_no = F.floor((F.col("side_rank") - 1) / F.col("_size"))
        sides.append(ocr.select("request_id", page_no.alias("page_no"), "post_id", "upload_id", F.lit(1).alias("src"),
                                (F.col("side_rank") - page_no * F.col("_size")).alias("side_rank")))
    if b.need["emb"]:
        emb = embedding_side(b.reqs, t, query_vectors, cfg, vindex, oversample, "exact", strict_visibility,
                             closure=b.closure, kinds=b.kinds, allowed=b.allowed, every_page=True, found=emb_found)
        sides.append(emb.select("request_id", "page_no", "post_id", "upload_id", F.lit(0).alias("src"),
                                F.col("img_rank").cast("long").alias("side_rank")))
    if not sides:
        return requests.sparkSession.createDataFrame(
            [], "request_id long, page_no long, rank long, post_id long, upload_id long")
    both = materialize(sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1]), "search-pages")
    return _ranked(both, b.reqs, ["page_no"])[1].select("request_id", "page_no", "rank", "post_id", "upload_id")
