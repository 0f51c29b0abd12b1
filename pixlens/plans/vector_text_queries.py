"""Registered queries: vector operators (V1-V7) and the OCR text index (TX1-TX2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import TEST_SETTINGS as CFG
from ..functions import vectors as V
from ..operators import cells, knn, textindex
from ..session import materialize
from ..sources.testforum import TestForum
from .catalog import register

DIM = CFG.embedding_dim
KNN_THRESHOLD = 0.1  # FIXTURES: few pairs pass 0.4 on the test vectors
LIMIT = 20

# DuckDB helpers for the oracles (sign bits, Hamming, cosine in double).
_HAM = ("CAST(list_sum(list_transform(range(1, 65), lambda j: CASE WHEN ({a}[j] > 0) <> ({b}[j] > 0) "
        "THEN 1 ELSE 0 END)) AS INTEGER)")
_COS = ("list_dot_product(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])) / "
        "nullif(sqrt(list_dot_product(CAST({a} AS DOUBLE[]), CAST({a} AS DOUBLE[]))) * "
        "sqrt(list_dot_product(CAST({b} AS DOUBLE[]), CAST({b} AS DOUBLE[]))), 0)")


def _f(spark, sf_dir):
    return TestForum(spark, sf_dir)


@register("quantize", """
  SELECT upload_id,
    CAST(list_sum(list_transform(range(0, 63), lambda j: CASE WHEN embeddings[j + 1] > 0
         THEN (CAST(1 AS BIGINT) << (62 - j)) ELSE CAST(0 AS BIGINT) END)) AS BIGINT) AS code_w0,
    CAST(CASE WHEN embeddings[64] > 0 THEN 1 ELSE 0 END AS BIGINT) AS code_w1
  FROM image_search_data WHERE embeddings IS NOT NULL""")
def quantize(spark, sf_dir):
    vi = knn.vector_index(_f(spark, sf_dir).index, DIM)
    return vi.select("upload_id", F.col("code")[0].alias("code_w0"), F.col("code")[1].alias("code_w1"))


def _pairs(spark, sf_dir):
    """Each indexed vector paired with another test vector by a data rule (equi-join)."""
    f = _f(spark, sf_dir)
    vi = knn.vector_index(f.index, DIM).withColumn("vec_id", (F.col("upload_id") * 7) % f.n("embeddings"))
    other = f.base("embeddings").select("vec_id", F.col("embedding").alias("other"))
    return vi.join(other, "vec_id")


_PAIRS = """
  SELECT i.upload_id, e.vec_id, i.embeddings, e.embedding AS other
  FROM image_search_data i JOIN embeddings e ON e.vec_id = (i.upload_id * 7) % (SELECT count(*) FROM embeddings)
  WHERE i.embeddings IS NOT NULL"""


@register("hamming", f"SELECT upload_id, vec_id, {_HAM.format(a='embeddings', b='other')} AS hamming FROM ({_PAIRS}) p")
def hamming(spark, sf_dir):
    p = _pairs(spark, sf_dir).withColumn("ocode", V.quantize("other", DIM))
    return p.select("upload_id", "vec_id", V.hamming("code", "ocode", DIM).alias("hamming"))


@register("cosine", f"SELECT upload_id, vec_id, round({_COS.format(a='embeddings', b='other')}, 6) AS similarity "
                    f"FROM ({_PAIRS}) p")
def cosine(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    return p.select("upload_id", "vec_id", F.round(V.cosine_similarity("embeddings", "other"), 6).alias("similarity"))


@register("vector_parse", """
  SELECT upload_id, CAST(len(embeddings) AS BIGINT) AS dim,
         round(list_sum(CAST(embeddings AS DOUBLE[])), 6) AS total
  FROM image_search_data WHERE embeddings IS NOT NULL""")
def vector_parse(spark, sf_dir):
    idx = _f(spark, sf_dir).index.filter(F.col("embeddings").isNotNull())
    v = V.parse_vector(F.to_json("embeddings"), DIM)
    return idx.select("upload_id", v.alias("v")).select(
        "upload_id", F.size("v").cast("long").alias("dim"),
        F.round(F.aggregate(F.col("v").cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _knn_queries(spark, sf_dir, per_request_page: bool = False):
    f = _f(spark, sf_dir)
    q = f.request_embeddings
    if per_request_page:
        q = q.join(f.search_requests.select("request_id", "page"), "request_id")
        off = F.col("page") * LIMIT
    else:
        off = F.lit(0)
    return q.select("request_id", "qvec", F.lit(KNN_THRESHOLD).alias("threshold"),
                    F.lit(LIMIT).alias("limit"), off.cast("long").alias("offset"))


_CANDS = f"""
  SELECT q.request_id, i.upload_id, i.embeddings, q.qvec,
         {_HAM.format(a='i.embeddings', b='q.qvec')} AS hamming
  FROM request_embeddings q, image_search_data i WHERE i.embeddings IS NOT NULL"""
_CAND_RANKED = f"""
  SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY hamming, upload_id) AS BIGINT) AS cand_rank
  FROM ({_CANDS}) s"""


@register("knn_candidates", f"""
  SELECT request_id, upload_id, hamming, cand_rank FROM ({_CAND_RANKED}) r WHERE cand_rank <= 40""")
def knn_candidates(spark, sf_dir):
    f = _f(spark, sf_dir)
    q = knn.prepare_queries(_knn_queries(spark, sf_dir), DIM).withColumn("k", F.lit(2 * LIMIT))
    c = knn.hamming_candidates(knn.vector_index(f.index, DIM), q, DIM)
    return c.select("request_id", "upload_id", "hamming", F.col("cand_rank").cast("long").alias("cand_rank"))


def _rerank_sql(offset_expr: str) -> str:
    return f"""
  SELECT request_id, upload_id, CAST(pos - off AS BIGINT) AS rank, round(sim, 6) AS similarity FROM (
    SELECT c.request_id, c.upload_id, c.sim, c.off,
           row_number() OVER (PARTITION BY c.request_id ORDER BY c.sim DESC, c.upload_id) AS pos
    FROM (SELECT r.request_id, r.upload_id, {_COS.format(a='r.embeddings', b='r.qvec')} AS sim, {offset_expr} AS off
          FROM ({_CAND_RANKED}) r JOIN search_requests sr ON sr.request_id = r.request_id
          WHERE r.cand_rank <= 2 * {LIMIT} + {offset_expr}) c
    WHERE c.sim >= {KNN_THRESHOLD}) x
  WHERE pos > off AND pos <= off + {LIMIT}"""


@register("knn_rerank", _rerank_sql("0"))
def knn_rerank(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = knn.search_images_embedding(_knn_queries(spark, sf_dir), f.index, DIM)
    return r.select("request_id", "upload_id", "rank", F.round("similarity", 6).alias("similarity"))


@register("search_images_embedding", _rerank_sql(f"sr.page * {LIMIT}"))
def search_images_embedding(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = knn.search_images_embedding(_knn_queries(spark, sf_dir, True), f.index, DIM)
    return r.select("request_id", "upload_id", "rank", F.round("similarity", 6).alias("similarity"))


def _width_sql(limit: int) -> str:
    sql = _rerank_sql("0").replace(f"<= 2 * {LIMIT} + 0", f"<= {max(40, 2 * limit)}").replace(f"off + {LIMIT}", f"off + {limit}")
    return f"SELECT CAST({limit} AS INTEGER) AS page_size, * FROM ({sql}) w"


@register("knn_search_width", " UNION ALL ".join(_width_sql(n) for n in (5, 50)))
def knn_search_width(spark, sf_dir):
    """Pages of 5 look at 40 candidates, pages of 50 at 100."""
    f = _f(spark, sf_dir)
    vindex = knn.vector_index(f.index, DIM)
    found = []
    for n in (5, 50):
        r = knn.search_images_embedding(_knn_queries(spark, sf_dir).withColumn("limit", F.lit(n)), f.index, DIM, vindex,
                                        oversample=knn.search_width(40, n))
        found.append(r.select(F.lit(n).alias("page_size"), "request_id", "upload_id", "rank",
                              F.round("similarity", 6).alias("similarity")))
    return found[0].unionByName(found[1])


_NEAR = ("len([b FOR b IN range(0, 5) IF list_sum([CASE WHEN (i.embeddings[b * 12 + j] > 0) <> (q.qvec[b * 12 + j] > 0) "
         "THEN 1 ELSE 0 END FOR j IN range(1, 13)]) <= 3]) > 0")


@register("knn_lsh", _rerank_sql("0").replace("WHERE i.embeddings IS NOT NULL", f"WHERE i.embeddings IS NOT NULL AND {_NEAR}"))
def knn_lsh(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = knn.search_images_embedding(_knn_queries(spark, sf_dir), f.index, DIM, method="lsh")
    return r.select("request_id", "upload_id", "rank", F.round("similarity", 6).alias("similarity"))


@register("knn_cells", "SELECT count(*) AS requests, TRUE AS recall_90, TRUE AS scores_exact FROM request_embeddings")
def knn_cells(spark, sf_dir):
    """The search over cells against the exact search: recall@20 of at least 0.9, equal scores where both find an image."""
    f = _f(spark, sf_dir)
    vindex = materialize(knn.vector_index(f.index, DIM), "vector-index")
    model = cells.fit(vindex, DIM)
    asked = materialize(_knn_queries(spark, sf_dir), "knn-queries")
    images = materialize(cells.assign(vindex, model), "cells")
    exact = knn.search_images_embedding(asked, f.index, DIM, vindex).select("request_id", "upload_id", F.col("similarity").alias("s"))
    both = exact.join(cells.search(asked, images, model, DIM), ["request_id", "upload_id"], "left")
    return both.agg((F.count("similarity") >= 0.9 * F.count("s")).alias("recall_90"),
                    F.coalesce(F.bool_and(F.abs(F.col("similarity") - F.col("s")) < 1e-9), F.lit(True)).alias("scores_exact")) \
        .select(F.lit(asked.count()).cast("long").alias("requests"), "recall_90", "scores_exact")


_LEX = r"""
  SELECT upload_id, CAST(generate_subscripts(arr, 1) AS BIGINT) AS position, unnest(arr) AS lexeme
  FROM (SELECT upload_id, regexp_extract_all(lower(ocr_text), '[\p{L}\p{N}]+') AS arr
        FROM image_search_data WHERE ocr_text IS NOT NULL) t"""


@register("lexemes", _LEX)
def lexemes(spark, sf_dir):
    return textindex.lexeme_rows(_f(spark, sf_dir).index).select(
        "upload_id", F.col("position").cast("long").alias("position"), "lexeme")


@register("postings", f"""
  SELECT lexeme, upload_id, count(*) AS n_positions, min(position) AS first_position
  FROM ({_LEX}) l GROUP BY lexeme, upload_id""")
def postings(spark, sf_dir):
    p = textindex.postings(_f(spark, sf_dir).index)
    return p.select("lexeme", "upload_id", F.size("positions").cast("long").alias("n_positions"),
                    F.col("positions")[0].cast("long").alias("first_position"))


@register("content_key", """
  SELECT u.id, coalesce(u.original_sha1, u.sha1) AS content_key, md5(d.text) AS bytes_md5, sha1(d.text) AS bytes_sha1
  FROM uploads u JOIN documents d ON d.doc_id = u.id""")
def content_key(spark, sf_dir):
    f = _f(spark, sf_dir)
    keys = f.upload_files.select(F.col("upload_id").alias("id"), F.md5("content").alias("bytes_md5"),
                                 F.sha1("content").alias("bytes_sha1"))
    return f.uploads.select("id", F.coalesce("original_sha1", "sha1").alias("content_key")).join(keys, "id")
