"""Registered queries: analysis planning, the analysis service wire format and the
stub model (SRC2-SRC5, U1, P1, P5, J13, J14, S2, WR2, C4, C5, X2)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..config import TEST_SETTINGS
from ..functions.text import join_lines
from ..operators import analysis as an
from ..operators import eligibility as el
from ..operators import index_store as ix
from ..sources.testforum import BASE_URL, TestForum
from .catalog import register

CFG = TEST_SETTINGS.with_(base_url=BASE_URL)
DIM = CFG.embedding_dim


def _f(spark, sf_dir):
    return TestForum(spark, sf_dir)


def _targets(f):
    return el.uploads_needing_analysis(f.tables(), CFG)


def _info(f, with_content=False):
    info = an.image_info(_targets(f), CFG)
    if with_content:
        info = info.join(f.upload_files.select(F.col("upload_id").alias("id"), "content"), "id", "left")
    return info


def _results(f):
    return an.run_analyzer(_info(f), f.answers)


def histogram(data: bytes) -> list[float]:
    h = np.bincount(np.frombuffer(data, np.uint8) & (DIM - 1), minlength=DIM).astype(np.float32)
    return (h / max(np.linalg.norm(h), 1e-9)).tolist()


def histogram_model(pdf: pd.DataFrame) -> pd.DataFrame:
    """A small real model for the hook: the text lines of the bytes and their byte histogram as vector."""
    raw = [bytes(c) for c in pdf["content"]]
    return pd.DataFrame({"sha1": pdf["sha1"].to_numpy(), "ocr_result": [c.decode("utf-8", "replace").split("\n") for c in raw],
                         "embedding": [histogram(c) for c in raw], "success": [True] * len(raw)})


@register("image_info", f"""
  SELECT id, content_key AS sha1, '{BASE_URL}' || url AS url FROM needing_uploads""")
def image_info(spark, sf_dir):
    return _info(_f(spark, sf_dir))


@register("image_refs", f"SELECT id, '{BASE_URL}' || url AS url FROM uploads")
def image_refs(spark, sf_dir):
    f = _f(spark, sf_dir)
    return an.image_info(f.uploads, CFG).select("id", "url")


@register("data_uri", """
  SELECT u.id, md5(uri) AS uri_md5, CAST(length(uri) AS BIGINT) AS uri_len FROM (
    SELECT u.id, 'data:image/' || u.extension || ';base64,' || to_base64(f.content) AS uri
    FROM uploads u JOIN upload_files f ON f.upload_id = u.id) u""")
def data_uri(spark, sf_dir):
    f = _f(spark, sf_dir)
    info = an.image_info(f.uploads, CFG.with_(analyze_image_base64_encoded=True), files=f.upload_files)
    return info.select("id", F.md5("url").alias("uri_md5"), F.length("url").cast("long").alias("uri_len"))


@register("analysis_requests", f"""
  SELECT batch_no, count(*) AS n_images,
         CAST(to_json({{'images': list({{'id': id, 'sha1': content_key, 'url': '{BASE_URL}' || url}} ORDER BY id),
                        'ocr': true, 'embedding': true}}) AS VARCHAR) AS payload
  FROM (SELECT *, CAST((row_number() OVER (ORDER BY id) - 1) // 100 AS BIGINT) AS batch_no FROM needing_uploads) x
  GROUP BY batch_no""")
def analysis_requests(spark, sf_dir):
    return an.analysis_requests(_info(_f(spark, sf_dir)), CFG, batch_size=100)


@register("parse_analysis", """
  SELECT sha1, success, md5(array_to_string(ocr_result, chr(10))) AS ocr_md5,
         CAST(len(ocr_result) AS BIGINT) AS n_lines, CAST(len(embedding) AS BIGINT) AS dim,
         round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS emb_sum
  FROM analysis_results""")
def parse_analysis(spark, sf_dir):
    res = _f(spark, sf_dir).analysis_results
    bodies = res.groupBy(F.floor(F.col("upload_id") / 100).alias("batch_no")).agg(
        F.to_json(F.struct(F.collect_list(F.struct("sha1", "ocr_result", "embedding", "success")).alias("images")))
        .alias("body"))
    p = an.parse_analysis(bodies)
    emb = F.col("embedding")
    return p.select(
        "sha1", "success", F.md5(join_lines(F.col("ocr_result"))).alias("ocr_md5"),
        F.size("ocr_result").cast("long").alias("n_lines"),
        F.when(emb.isNotNull(), F.size(emb)).cast("long").alias("dim"),
        F.round(F.aggregate(emb.cast("array<double>"), F.lit(0.0), lambda a, x: a + x), 6).alias("emb_sum"))


@register("ocr_text_join", """
  SELECT upload_id, md5(array_to_string(ocr_result, chr(10))) AS ocr_md5 FROM analysis_results""")
def ocr_text_join(spark, sf_dir):
    res = _f(spark, sf_dir).analysis_results
    return res.select("upload_id", F.md5(join_lines(F.col("ocr_result"))).alias("ocr_md5"))


_MODEL = """
  SELECT DISTINCT n.content_key AS sha1, TRUE AS success,
         md5(d.text) AS ocr_md5, CAST(len(string_split(d.text, chr(10))) AS BIGINT) AS n_lines,
         CAST(64 AS BIGINT) AS dim, FALSE AS transport_error
  FROM needing_uploads n JOIN documents d ON d.doc_id = n.id"""


@register("analysis_stub", _MODEL)
def analysis_model(spark, sf_dir):
    f = _f(spark, sf_dir)
    r = an.run_analyzer(_info(f), histogram_model, files=f.upload_files)
    return r.select("sha1", "success", F.md5(join_lines(F.col("ocr_result"))).alias("ocr_md5"),
                    F.size("ocr_result").cast("long").alias("n_lines"),
                    F.size("embedding").cast("long").alias("dim"), "transport_error")


@register("match_results", """
  SELECT n.id AS upload_id, n.content_key AS sha1, a.success FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key""")
def match_results(spark, sf_dir):
    f = _f(spark, sf_dir)
    return an.match_results(_results(f), _info(f)).select("upload_id", "sha1", "success")


@register("match_results_reference_dedup", """
  SELECT max(n.id) AS upload_id, n.content_key AS sha1, any_value(a.success) AS success
  FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key GROUP BY n.content_key""")
def match_results_reference_dedup(spark, sf_dir):
    f = _f(spark, sf_dir)
    return an.match_results(_results(f), _info(f), reference_dedup=True).select("upload_id", "sha1", "success")


_STORABLE = """
  SELECT n.id AS upload_id, n.content_key AS sha1, md5(array_to_string(a.ocr_result, chr(10))) AS ocr_md5,
         a.embedding IS NOT NULL AS has_embedding
  FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key WHERE a.success"""


def _storable(f):
    return an.storable_results(an.match_results(_results(f), _info(f)), f.uploads, CFG)


@register("storable_results", _STORABLE)
def storable_results(spark, sf_dir):
    s = _storable(_f(spark, sf_dir))
    return s.select("upload_id", "sha1", F.md5("ocr_text").alias("ocr_md5"),
                    F.col("embeddings").isNotNull().alias("has_embedding"))


@register("failed_images", """
  SELECT n.id, n.content_key AS sha1 FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key WHERE NOT a.success""")
def failed_images(spark, sf_dir):
    f = _f(spark, sf_dir)
    return an.failed_images(_info(f), _results(f)).select("id", "sha1")


@register("analysis_plan", r"""
  SELECT n.id, (i.ocr_text IS NULL OR len(regexp_extract_all(lower(i.ocr_text), '[\p{L}\p{N}]+')) = 0) AS run_ocr,
         i.embeddings IS NULL AS run_embed
  FROM needing_uploads n LEFT JOIN image_search_data i ON i.upload_id = n.id""")
def analysis_plan(spark, sf_dir):
    f = _f(spark, sf_dir)
    tg = _targets(f).select("id")
    return an.analysis_plan(tg, f.index, CFG).select("id", "run_ocr", "run_embed")


_DONOR = """
  (SELECT min(i.upload_id) FROM image_search_data i WHERE i.sha1 = n.content_key AND i.upload_id <> n.id
     AND i.ocr_text IS NOT NULL AND i.embeddings IS NOT NULL)"""


@register("reuse_by_content", f"""
  SELECT upload_id, donor_id FROM (SELECT n.id AS upload_id, {_DONOR} AS donor_id FROM needing_uploads n) x
  WHERE donor_id IS NOT NULL""")
def reuse_by_content(spark, sf_dir):
    f = _f(spark, sf_dir)
    tg = _targets(f).select("id", an.content_key().alias("sha1"))
    return an.reuse_donors(tg, f.index)


#: The images of one run: their donor, what they still need, and the service's answer for their content.
RUN = rf"""
  SELECT n.id AS upload_id, n.content_key AS sha1, {_DONOR} AS donor_id, i.retry_times AS old_retry,
         (i.ocr_text IS NULL OR len(regexp_extract_all(lower(i.ocr_text), '[\p{{L}}\p{{N}}]+')) = 0) AS run_ocr,
         i.embeddings IS NULL AS run_embed, a.success, a.embedding, array_to_string(a.ocr_result, chr(10)) AS text
  FROM needing_uploads n JOIN answers a ON a.sha1 = n.content_key LEFT JOIN image_search_data i ON i.upload_id = n.id"""
_KEPT = "(success AND (run_ocr OR (run_embed AND embedding IS NOT NULL)))"


def _processed(f, **more):
    return an.process_images(_targets(f), f.tables(), CFG, f.answers, **more)


@register("process_images", f"""
  SELECT upload_id, CASE WHEN donor_id IS NOT NULL THEN 'reused'
                         WHEN NOT (run_ocr OR run_embed) THEN 'skipped'
                         WHEN NOT success THEN 'failed' WHEN {_KEPT} THEN 'analyzed' ELSE 'skipped' END AS outcome
  FROM ({RUN}) x""")
def process_images(spark, sf_dir):
    return _processed(_f(spark, sf_dir))[0]


@register("process_images_upserts", f"""
  SELECT x.upload_id, x.sha1, md5(CASE WHEN x.donor_id IS NOT NULL THEN d.ocr_text WHEN x.run_ocr THEN x.text END) AS ocr_md5,
         CASE WHEN x.donor_id IS NOT NULL THEN d.embeddings IS NOT NULL
              ELSE x.run_embed AND x.embedding IS NOT NULL END AS has_embedding, x.donor_id IS NOT NULL AS reused
  FROM ({RUN}) x LEFT JOIN image_search_data d ON d.upload_id = x.donor_id
  WHERE x.donor_id IS NOT NULL OR {_KEPT.replace('success', 'x.success').replace('embedding IS', 'x.embedding IS')}""")
def process_images_upserts(spark, sf_dir):
    _, upserts, _ = _processed(_f(spark, sf_dir))
    return upserts.select("upload_id", "sha1", F.md5("ocr_text").alias("ocr_md5"),
                          F.col("embeddings").isNotNull().alias("has_embedding"), "reused")


@register("process_images_failures", f"""
  SELECT upload_id, sha1, CAST(1 AS BIGINT) AS n FROM ({RUN}) x
  WHERE donor_id IS NULL AND (run_ocr OR run_embed) AND NOT success""")
def process_images_failures(spark, sf_dir):
    return _processed(_f(spark, sf_dir))[2]


@register("process_images_ocr_only", f"""
  SELECT upload_id, md5(text) AS ocr_md5 FROM ({RUN}) x WHERE donor_id IS NULL AND run_ocr AND success""")
def process_images_ocr_only(spark, sf_dir):
    outcomes, upserts, failures = _processed(_f(spark, sf_dir), record_failed=False, analyze_embedding=False)
    return upserts.filter(~F.col("reused")).join(failures.select("upload_id"), "upload_id", "left_anti").select(
        "upload_id", F.md5("ocr_text").alias("ocr_md5"))


@register("reuse_rows", f"""
  SELECT upload_id, sha1, CAST(coalesce(old_retry, 0) AS INTEGER) AS retry_times FROM ({RUN}) x WHERE donor_id IS NOT NULL""")
def reuse_rows(spark, sf_dir):
    f = _f(spark, sf_dir)
    _, upserts, _ = _processed(f)
    merged = ix.merge_results(f.index, upserts)
    return merged.join(upserts.filter("reused").select("upload_id"), "upload_id", "left_semi").select(
        "upload_id", "sha1", "retry_times")


_POSTS = """
  WITH pimg AS (
    SELECT pu.post_id, u.id, a.success, array_to_string(a.ocr_result, chr(10)) AS text
    FROM post_uploads pu JOIN eligible_posts p ON p.id = pu.post_id
    JOIN size_type_ok u ON u.id = pu.upload_id LEFT JOIN image_search_data i ON i.upload_id = u.id
    JOIN answers a ON a.sha1 = coalesce(u.original_sha1, u.sha1)
    WHERE (i.upload_id IS NULL OR i.ocr_text IS NULL OR i.embeddings IS NULL)
      AND (i.retry_times IS NULL OR i.retry_times < 3)),
  ok AS (SELECT post_id FROM pimg GROUP BY post_id HAVING count(*) <= 5)"""


def _processed_posts(f):
    return an.process_posts(f.post_uploads.select("post_id").distinct(), f.tables(), CFG, f.answers)


@register("process_posts", _POSTS + """
  SELECT post_id, count(*) AS n_images,
         count(*) FILTER (WHERE success) AS n_analyzed,
         count(*) FILTER (WHERE NOT success) AS n_failed
  FROM pimg WHERE post_id IN (SELECT post_id FROM ok) GROUP BY post_id""")
def process_posts(spark, sf_dir):
    return _processed_posts(_f(spark, sf_dir))[0]


WATCHED = r"(?i)(^|[^\p{L}\p{N}_])(erenes|leaux|the it|qu[\p{L}\p{N}_]*nz|!!!)($|[^\p{L}\p{N}_])"


@register("process_posts_flags", _POSTS + f""",
  texts AS (
    SELECT pu.post_id, coalesce(n.text, i.ocr_text) AS text FROM post_uploads pu
    LEFT JOIN image_search_data i ON i.upload_id = pu.upload_id
    LEFT JOIN (SELECT DISTINCT id, text FROM pimg WHERE success AND post_id IN (SELECT post_id FROM ok)) n ON n.id = pu.upload_id
    WHERE pu.post_id IN (SELECT post_id FROM ok))
  SELECT DISTINCT post_id, 'inappropriate' AS flag_type, 'watched_word' AS reason, 'system' AS actor
  FROM texts WHERE regexp_matches(text, '{WATCHED}')""")
def process_posts_flags(spark, sf_dir):
    return _processed_posts(_f(spark, sf_dir))[3]
