"""Two-stage vector search over the image index.

Stage 1 ranks every indexed image by the Hamming distance between binary
(sign-bit) codes and keeps ``k = oversample*limit + offset`` candidates per
request. Spark has no vector-scan operator, so images and requests are both cut
into blocks of bounded size; each pair of blocks is one group of a cogroup,
scored by the bits that differ, and gives each request's best ``k`` of the
block. Requests stay a DataFrame of any length: nothing is collected and nothing
is broadcast. A window merges the blocks' lists. Stage 2 joins the few candidates
back to their vectors, computes cosine in double precision on the JVM, applies
the similarity threshold and pages by rank. ``cells`` searches a learned partition
instead of every block.

``knn_lsh`` is the approximate alternative: each block of images is keyed by its banded code
words, a request probes its own words and the neighbouring words of each band, exact rerank of
what they find. No (request, image) pair leaves a block but the best ``k``.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import ANN_DEFAULT_SEARCH_WIDTH
from ..functions import vectors as V
from ..session import materialize
from . import prefilter
from .ordering import rank_by_score, rank_in_groups

BLOCK_CELLS = 1 << 22  # sign values of one image block (rows x dimensions)
QUERIES_PER_BLOCK = 512
MOST_QUERIES = 8192  # of one block, where there are enough blocks to keep all cores busy
SHALLOW = 1024  # ranks up to here are cut by a window with a literal bound, deeper ones ranked in blocks


def vector_index(index: DataFrame, dim: int) -> DataFrame:
    """Index rows with a vector, plus the packed code and the norm (materialize once)."""
    return index.filter(F.col("embeddings").isNotNull()).select(
        "upload_id", "embeddings", V.quantize("embeddings", dim).alias("code"),
        V.norm("embeddings").alias("norm"))


def prepare_queries(queries: DataFrame, dim: int) -> DataFrame:
    """(request_id, qvec, ...) with the query code and norm added."""
    return queries.withColumn("qcode", V.quantize("qvec", dim)).withColumn("qnorm", V.norm("qvec"))


# ------------------------------------------------------------------ stage 1
def _words(codes: pd.Series, dim: int) -> np.ndarray:
    """Packed 63-bit words of each row -> 64-bit words, one line per word."""
    rows = np.stack(codes.to_numpy()).astype(np.int64)
    bits = np.zeros((len(rows), -(-dim // 64) * 64), dtype=bool)
    for j in range(rows.shape[1]):
        width = min(V.BITS_PER_WORD, dim - j * V.BITS_PER_WORD)
        shifts = np.arange(width - 1, -1, -1, dtype=np.int64)
        bits[:, j * V.BITS_PER_WORD:j * V.BITS_PER_WORD + width] = (rows[:, j:j + 1] >> shifts) & 1
    return np.ascontiguousarray(np.packbits(bits, axis=1).view(np.uint64).T)


CANDS_DDL = "request_id long, upload_id long, hamming int, k long"


def _nearest(words: np.ndarray, asked: np.ndarray, k: int, at: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows, distances) of the k rows nearest to ``asked`` by (distance, row), among the rows ``at`` (ascending) when given."""
    parts = words if at is None else words[:, at]
    ham = np.bitwise_count(parts[0] ^ asked[0])
    if len(parts) > 1:
        ham = ham.astype(np.uint16)
        for w, a in zip(parts[1:], asked[1:]):
            ham += np.bitwise_count(w ^ a)
    if k < len(ham):
        # A distance has few values: counting them gives the one at which k is reached.
        near = np.flatnonzero(ham <= np.searchsorted(np.cumsum(np.bincount(ham)), k))
        near = near[np.argsort(ham[near], kind="stable")[:k]]
    else:
        near = np.argsort(ham, kind="stable")
    return (near if at is None else at[near]), ham[near]


class _Found:
    """The candidates of a block, request by request."""

    def __init__(self):
        self.asked, self.images, self.ham, self.k = [], [], [], []

    def add(self, request_id: int, k: int, ids: np.ndarray, ham: np.ndarray) -> None:
        self.asked.append((request_id, k, len(ids)))
        self.images.append(ids)
        self.ham.append(ham)

    def frame(self) -> pd.DataFrame:
        asked = np.array(self.asked, dtype=np.int64).reshape(-1, 3)
        return pd.DataFrame({"request_id": np.repeat(asked[:, 0], asked[:, 2]),
                             "upload_id": np.concatenate([np.zeros(0, np.int64), *self.images]),
                             "hamming": np.concatenate([np.zeros(0, np.int32), *self.ham]).astype(np.int32),
                             "k": np.repeat(asked[:, 1], asked[:, 2])})


def _block_top(dim: int, masks: dict | None = None, rows_of=None):
    """One (image block, request block): each request's k best by (hamming, upload_id).

    Images may carry ``posts`` and requests ``filters`` (see ``prefilter``): a request with filters then
    ranks only the images that have a post which passes them all. ``rows_of(images, requests)`` gives a function
    from the place of a request to the rows that it looks at (see ``cells`` and ``knn_lsh``).
    """

    def run(images, requests):
        found = _Found()
        if images.empty or requests.empty:
            return found.frame()
        images = images.sort_values("upload_id", kind="stable").reset_index(drop=True)
        requests = requests.reset_index(drop=True)
        ids, words = images["upload_id"].to_numpy(np.int64), _words(images["code"], dim)
        qids, qk = requests["request_id"].to_numpy(np.int64), requests["k"].to_numpy(np.int64)
        qwords = _words(requests["qcode"], dim).T
        filters, every = [None] * len(qids), None
        if "filters" in requests.columns:
            allowed, filters = prefilter.Allowed(images, masks), requests["filters"]
            first = np.append(True, ids[1:] != ids[:-1])  # an image with very many posts stands in several rows
            every = None if first.all() else np.flatnonzero(first)
        own = rows_of(images, requests) if rows_of else None
        for i, f in enumerate(filters):
            at = allowed.rows(f) if f is not None and len(f) else own(i) if own else every
            rows, ham = _nearest(words, qwords[i], int(qk[i]), at)
            found.add(qids[i], qk[i], ids[rows], ham)
        return found.frame()

    return run


def block_counts(spark, n_images: int, n_queries: int, dim: int, queries_per_block: int, block_cells: int) -> tuple[int, int]:
    """(blocks of images, blocks of requests).

    Every block of requests gets a copy of all codes: no more blocks than the size of a block or the cores ask for.
    """
    ib = max(1, math.ceil(n_images * dim / block_cells))
    busy = 4 * spark.sparkContext.defaultParallelism
    return ib, max(1, math.ceil(n_queries / max(MOST_QUERIES, queries_per_block)),
                   min(math.ceil(n_queries / queries_per_block), math.ceil(busy / ib)))


def block_of(names: str | list[str], n: int) -> Column:
    return F.pmod(F.xxhash64(*([names] if isinstance(names, str) else names)), F.lit(n)).cast("int")


def every_block(n: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))


def hamming_candidates(vindex: DataFrame, queries: DataFrame, dim: int,
                       queries_per_block: int = QUERIES_PER_BLOCK, block_cells: int = BLOCK_CELLS,
                       posts: DataFrame | None = None) -> DataFrame:
    """Per request, the ``k`` images with the smallest Hamming distance.

    ``queries`` has (request_id, qcode, k). Output: request_id, upload_id,
    hamming, cand_rank (1-based, ties by upload_id). With ``posts`` (from
    ``prefilter.image_posts``) and a column ``filters`` in ``queries``, the k images
    are taken from those that pass the request's filters.
    """
    n_images = vindex.count()
    asked = queries.filter(F.col("k") > 0).select("request_id", "qcode", F.col("k").cast("long").alias("k"),
                                                  *(["filters"] if posts is not None else []))
    n_queries, deepest = asked.agg(F.count("*"), F.max("k")).first()
    rows, by = n_images, ["upload_id"]
    if posts is not None:
        # As many blocks as the posts ask for; those of one image may be in several, which all can find it.
        posts = materialize(posts, "knn-posts")
        n_posts = posts.agg(F.sum(F.size("posts"))).first()[0] or 0
        rows, by = max(n_images, math.ceil(n_posts / prefilter.POSTS_PER_BLOCK * block_cells / dim)), ["upload_id", "part"]
    ib, qb = block_counts(vindex.sparkSession, rows, n_queries, dim, queries_per_block, block_cells)
    images = vindex.select("upload_id", "code")
    if posts is not None:
        images = images.join(posts, "upload_id", "left")
    images = images.withColumn("ib", block_of(by, ib)).drop("part").withColumn("qb", every_block(qb))
    asked = asked.select("*", block_of("request_id", qb).alias("qb"), every_block(ib).alias("ib"))
    cands = images.groupBy("ib", "qb").cogroup(asked.groupBy("ib", "qb")).applyInPandas(
        _block_top(dim, prefilter.masks() if posts is not None else None), CANDS_DDL)
    if posts is not None:
        cands = cands.distinct()
    return select_candidates(cands, min(deepest or 0, n_images))


def select_candidates(cands: DataFrame, deepest: int) -> DataFrame:
    """The first ``k`` of each request's (request_id, upload_id, hamming, k) by (hamming, upload_id): ``cand_rank``.

    Up to ``SHALLOW`` the bound is a literal, so each partition keeps that many rows of a request before the
    shuffle. Beyond it a distance has only as many values as bits: rows are counted per (request, distance),
    the running sum gives the distance where ``k`` is reached, and what is left is ranked in blocks of ids.
    """
    if deepest <= SHALLOW:
        w = Window.partitionBy("request_id").orderBy("hamming", "upload_id")
        ranked = cands.withColumn("cand_rank", F.row_number().over(w)).filter(F.col("cand_rank") <= deepest)
    else:
        cands = materialize(cands, "knn-candidates")
        before = Window.partitionBy("request_id").orderBy("hamming").rowsBetween(Window.unboundedPreceding, -1)
        levels = (cands.groupBy("request_id", "hamming", "k").agg(F.count("*").alias("n"))
                  .withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
                  .filter(F.col("before") < F.col("k")).select("request_id", "hamming"))
        near = materialize(cands.join(levels, ["request_id", "hamming"], "left_semi").withColumn("_id", -F.col("upload_id")),
                           "knn-near")
        ranked = rank_in_groups(near, "request_id", F.col("hamming"), "_id", name="cand_rank").drop("_id")
    return ranked.filter(F.col("cand_rank") <= F.col("k")).drop("k")


# ------------------------------------------------------------------ stage 2
def _similar(cands: DataFrame, vindex: DataFrame, queries: DataFrame, *more: str) -> DataFrame:
    """the candidates whose cosine reaches their request's threshold, with ``similarity``."""
    vec = vindex.select("upload_id", "embeddings", "norm")
    q = queries.select("request_id", "qvec", "qnorm", "threshold", *more)
    scored = cands.join(vec, "upload_id").join(q, "request_id").withColumn(
        "similarity", V.cosine_similarity("embeddings", "qvec", F.col("norm"), F.col("qnorm")))
    return scored.filter(F.col("similarity") >= F.col("threshold")).drop("embeddings", "norm", "qvec", "qnorm", "threshold")


def by_similarity(kept: DataFrame, deepest: int) -> DataFrame:
    """``kept`` with ``pos``: its 1-based place by (similarity descending, upload_id) in its request."""
    if deepest <= SHALLOW:
        w = Window.partitionBy("request_id").orderBy(F.col("similarity").desc(), F.col("upload_id"))
        return kept.withColumn("pos", F.row_number().over(w).cast("long"))
    return rank_by_score(materialize(kept, "knn-similar"), "request_id", "similarity", "upload_id", "pos")


def rerank(cands: DataFrame, vindex: DataFrame, queries: DataFrame) -> DataFrame:
    """T3 + F17: cosine on the candidates, threshold, rank, page.

    ``queries`` has (request_id, qvec, qnorm, threshold, limit, offset).
    Output: request_id, upload_id, rank (1-based within the page's ordering),
    similarity.
    """
    deepest = queries.agg(F.max(F.col("offset") + F.col("limit"))).first()[0] or 0
    kept = _similar(cands.select("request_id", "upload_id"), vindex, queries, "limit", "offset")
    ranked = by_similarity(kept, deepest)
    page = ranked.filter((F.col("pos") > F.col("offset")) & (F.col("pos") <= F.col("offset") + F.col("limit")))
    return page.select("request_id", "upload_id", (F.col("pos") - F.col("offset")).cast("long").alias("rank"),
                       "similarity")


def _with_k(queries: DataFrame, dim: int, oversample: float) -> DataFrame:
    k = F.ceil(F.lit(float(oversample)) * F.col("limit")).cast("long") + F.col("offset").cast("long")
    return prepare_queries(queries, dim).withColumn("k", k)


def search_width(ef_search: int = ANN_DEFAULT_SEARCH_WIDTH, limit: int = 20) -> float:
    """V5: the oversampling that gives a page the search width of ``ef_search`` candidates, twice the page at least."""
    return max(2.0, ef_search / limit)


def search_images_embedding(queries: DataFrame, index: DataFrame, dim: int, vindex: DataFrame | None = None,
                            oversample: float = 2, method: str = "exact", bands: DataFrame | None = None,
                            queries_per_block: int = QUERIES_PER_BLOCK, posts: DataFrame | None = None) -> DataFrame:
    """V4: two-stage kNN for a batch of requests; ``method`` is ``exact`` or ``lsh`` (``cells`` has a third).

    ``queries``: request_id, qvec, threshold, limit, offset. Candidates per
    request = ``oversample * limit + offset``. A request whose offset lies beyond
    the index has no result and is not scored. ``posts`` and a column ``filters`` put
    the filters below the top-k (exact method), see ``prefilter``.
    """
    if method == "lsh":
        return knn_lsh(queries, index, dim, oversample=oversample, vindex=vindex, bands=bands)
    if method != "exact":
        raise ValueError(f"unknown method {method}")
    vindex = vindex if vindex is not None else vector_index(index, dim)
    q = _with_k(queries.filter(F.col("offset") < F.lit(vindex.count())), dim, oversample)
    return rerank(hamming_candidates(vindex, q, dim, queries_per_block, posts=posts), vindex, q)


PAGES_DDL = "request_id long, page_no long, upload_id long, rank long"


def _every_page(pdf: pd.DataFrame) -> pd.DataFrame:
    """One request: the images of each of its pages, from its rows numbered by similarity (``pos``).

    A row takes part from the first page whose candidates hold it. A page adds at most ``limit``
    candidates and begins ``limit`` positions later, so a row before a page's begin is before the begin
    of every later page too: it leaves the heap for good, and no page looks at all rows.
    """
    from heapq import heappop, heappush

    pdf = pdf.sort_values("pos")
    n, limit, pages = len(pdf), int(pdf["limit"].iloc[0]), int(pdf["pages"].iloc[0])
    late = pdf["cand_rank"].to_numpy(np.int64) - int(pdf["first_k"].iloc[0])
    since = np.maximum(0, -(-late // limit))
    entry = np.argsort(since, kind="stable")
    starts = np.searchsorted(since[entry], np.arange(min(pages, -(-n // limit)) + 1))
    heap: list[int] = []
    shown: list[int] = []
    at, page_of, rank_of = [], [], []
    for page in range(len(starts) - 1):
        for i in (*entry[starts[page]:starts[page + 1]].tolist(), *shown):
            heappush(heap, i)
        if page:
            for _ in range(min(limit, len(heap))):
                heappop(heap)
        if not heap:  # this page and all later ones lie beyond the rows
            break
        shown = [heappop(heap) for _ in range(min(limit, len(heap)))]
        at += shown
        page_of += [page] * len(shown)
        rank_of += range(1, len(shown) + 1)
    return pd.DataFrame({"request_id": pdf["request_id"].iloc[0], "page_no": np.array(page_of, np.int64),
                         "upload_id": pdf["upload_id"].to_numpy(np.int64)[at], "rank": np.array(rank_of, np.int64)})


def search_images_every_page(queries: DataFrame, index: DataFrame, dim: int, vindex: DataFrame | None = None,
                             oversample: float = 2, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """V4 for the pages 0..``pages`` - 1 of each request: (request_id, page_no, upload_id, rank).

    Each page holds what ``search_images_embedding`` (exact) finds at its offset, whose candidates grow
    with the page. The index is scanned once per request, whatever its number of pages; one task holds
    the ids of the images of one request that pass the threshold.
    """
    vindex = vindex if vindex is not None else vector_index(index, dim)
    q = _with_k(queries.filter((F.col("limit") > 0) & (F.col("pages") > 0))
                .withColumn("offset", (F.col("pages") - 1) * F.col("limit")), dim, oversample)
    kept = _similar(hamming_candidates(vindex, q, dim, queries_per_block).select("request_id", "upload_id", "cand_rank"),
                    vindex, q, "limit", "pages")
    ranked = by_similarity(kept, SHALLOW + 1)
    first_k = F.ceil(F.lit(float(oversample)) * F.col("limit")).cast("long")
    return ranked.select("request_id", "upload_id", "cand_rank", "pos", "limit", "pages",
                         first_k.alias("first_k")).groupBy("request_id").applyInPandas(_every_page, PAGES_DDL)


# ------------------------------------------------------------------ V6 (approximate)
BAND_BITS = 12
PROBE_BITS = 3


def band_table(vindex: DataFrame, dim: int, band_bits: int = BAND_BITS) -> DataFrame:
    """(band, value, upload_id): the sign bits cut into bands of ``band_bits``."""
    return _bands(vindex, "embeddings", "upload_id", dim, band_bits)


def _band_values(vec: Column, dim: int, band_bits: int) -> list[Column]:
    """The value of each band; bits that fill no band are left to the exact rank."""
    return [F.aggregate(F.slice(vec, b * band_bits + 1, band_bits), F.lit(0).cast("long"),
                        lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
            for b in range(max(1, dim // band_bits))]


def _bands(df: DataFrame, vec: str, key: str, dim: int, band_bits: int) -> DataFrame:
    arr = F.array(*[F.struct(F.lit(b).alias("band"), v.alias("value")) for b, v in enumerate(_band_values(F.col(vec), dim, band_bits))])
    return df.select(key, F.inline(arr))


def _band_key(band: Column, value: Column, band_bits: int) -> Column:
    return F.shiftleft(band.cast("long"), band_bits) + value


def _band_keys(vec: str, dim: int, band_bits: int) -> Column:
    """Band and value of each band of a vector, as one number each."""
    return F.array_compact(F.array(*[_band_key(F.lit(b), v, band_bits) for b, v in enumerate(_band_values(F.col(vec), dim, band_bits))]))


def _flat(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """(owner, value) of the items of the lists."""
    lists = [x if x is not None else () for x in lists]
    return (np.repeat(np.arange(len(lists)), [len(x) for x in lists]),
            np.concatenate([np.zeros(0, np.int64), *[np.asarray(x, dtype=np.int64) for x in lists]]))


def _probed_rows(band_bits: int, probe_bits: int):
    """For ``_block_top``: the rows of a block that share a band of a request up to ``probe_bits`` bits.

    An image or request that stands in several rows is near if any of its rows is.
    """
    from itertools import combinations

    masks = np.array([sum(1 << b for b in c) for r in range(probe_bits + 1) for c in combinations(range(band_bits), r)], dtype=np.int64)

    def rows_of(images, requests):
        owner, key = _flat(images["bands"])
        order = np.argsort(key, kind="stable")
        owner, key = owner[order], key[order]
        held, start = np.unique(key, return_index=True)
        end = np.append(start[1:], len(key))
        ids = images["upload_id"].to_numpy(np.int64)
        first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
        sizes = np.diff(np.append(first, len(ids)))
        of, asked = _flat(requests["bands"])
        person = np.unique(requests["request_id"].to_numpy(np.int64), return_inverse=True)[1]
        by = np.argsort(person[of], kind="stable")
        asked, cuts = asked[by], np.searchsorted(person[of][by], np.arange(len(requests) + 1))

        def rows(i):
            probes = np.unique(asked[cuts[person[i]]:cuts[person[i] + 1], None] ^ masks)
            place = np.searchsorted(held, probes)
            inside = place < len(held)
            place = place[inside][held[place[inside]] == probes[inside]]
            n = end[place] - start[place]
            # The places of all items of the probed keys.
            items = np.arange(n.sum()) + np.repeat(start[place] - (np.cumsum(n) - n), n)
            near = np.zeros(len(ids), dtype=bool)
            near[owner[items]] = True
            if len(first) < len(ids):
                near = np.repeat(np.logical_or.reduceat(near, first), sizes)
            return np.flatnonzero(near)

        return rows

    return rows_of


def knn_lsh(queries: DataFrame, index: DataFrame, dim: int, band_bits: int = BAND_BITS, oversample: float = 2,
            vindex: DataFrame | None = None, bands: DataFrame | None = None, probe_bits: int = PROBE_BITS,
            queries_per_block: int = QUERIES_PER_BLOCK, block_cells: int = BLOCK_CELLS) -> DataFrame:
    """Approximate V4: candidates differ from the query by at most ``probe_bits`` bits in some band.

    Images and requests meet in blocks like in the exact search. A block of images is sorted by its band
    words; a request probes its own and the neighbouring words there, ranks what it finds by
    (Hamming, upload_id) and only its best ``k`` leave the block, to be reranked by cosine like in the exact
    path. ``bands`` is a stored ``band_table``; without one the words are taken from the vectors.
    """
    vindex = vindex if vindex is not None else vector_index(index, dim)
    q = _with_k(queries, dim, oversample)
    asked = q.filter((F.col("k") > 0) & F.col("qcode").isNotNull() & F.col("request_id").isNotNull()).select(
        "request_id", "qcode", F.col("k").cast("long").alias("k"), _band_keys("qvec", dim, band_bits).alias("bands"))
    images = vindex.filter(F.col("upload_id").isNotNull())
    if bands is None:
        images = images.select("upload_id", "code", _band_keys("embeddings", dim, band_bits).alias("bands"))
    else:
        keys = bands.filter(F.col("value").isNotNull()).groupBy("upload_id").agg(
            F.collect_set(_band_key(F.col("band"), F.col("value"), band_bits)).alias("bands"))
        images = images.select("upload_id", "code").join(keys, "upload_id")
    n_images = vindex.count()
    n_queries, deepest = asked.agg(F.count("*"), F.max("k")).first()
    ib, qb = block_counts(vindex.sparkSession, n_images, n_queries, dim, queries_per_block, block_cells)
    images = images.select("*", block_of("upload_id", ib).alias("ib"), every_block(qb).alias("qb"))
    asked = asked.select("*", block_of("request_id", qb).alias("qb"), every_block(ib).alias("ib"))
    cands = images.groupBy("ib", "qb").cogroup(asked.groupBy("ib", "qb")).applyInPandas(
        _block_top(dim, rows_of=_probed_rows(band_bits, probe_bits)), CANDS_DDL)
    return rerank(select_candidates(cands, deepest or 0), vindex, q)
