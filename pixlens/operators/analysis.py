"""Image analysis as a distributed job (SRC2-SRC5, U1, P1, P5, J13, J14, S2, WR2-WR4, C4, C5).

The model is user-supplied: a function from a pandas batch of images
(id, sha1, url, and optionally content bytes) to a pandas batch of results
(sha1, ocr_result, embedding, success), run inside ``mapInPandas``; or a
DataFrame of answers that a service has already given, keyed by content key.
A run calls the model once per distinct content key, writes the results to the
shared folder, and derives outcomes, index rows and failures from that table.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKFILL_BATCH, Settings
from ..functions.text import join_lines, lexemes
from ..schemas import ANALYSIS_RESPONSE_DDL
from ..session import materialize
from ..sources.tables import ForumTables
from . import eligibility as el
from . import moderation as md
from .ordering import dense_index

Analyzer = Callable[[pd.DataFrame], pd.DataFrame] | DataFrame
RESULT_DDL = ("sha1 string, ocr_result array<string>, embedding array<float>, success boolean, "
              "transport_error boolean, error string")


class AnalyzerCallError(Exception):
    """Raised by a model whose call failed as a whole (service down, bad status)."""


#: What counts as a failed call; anything else is a bug in the model and fails the job.
CALL_ERRORS = (AnalyzerCallError, ConnectionError, TimeoutError)


# ---------------------------------------------------------------- P1, SRC2, SRC3
def content_key() -> Column:
    """The content key of an upload."""
    return F.coalesce(F.col("original_sha1"), F.col("sha1"))


def data_uri(extension: Column, content: Column) -> Column:
    """SRC2: ``data:image/<ext>;base64,<bytes>`` with no line breaks."""
    return F.concat(F.lit("data:image/"), extension, F.lit(";base64,"),
                    F.regexp_replace(F.base64(content), r"[\r\n]", ""))


def image_info(uploads: DataFrame, cfg: Settings, files: DataFrame | None = None) -> DataFrame:
    """P1 + SRC3: (id, sha1 = content key, url) for the analysis service.

    With base64 encoding on, ``files`` (upload_id, content) supplies the bytes.
    """
    base = uploads.select("id", content_key().alias("sha1"), "url", "extension")
    if cfg.analyze_image_base64_encoded:
        if files is None:
            raise ValueError("base64 encoding needs the upload files")
        f = files.select(F.col("upload_id").alias("id"), "content")
        return base.join(f, "id", "left").select("id", "sha1", data_uri(F.col("extension"), F.col("content"))
                                                 .alias("url"))
    return base.select("id", "sha1", F.concat(F.lit(cfg.base_url), F.col("url")).alias("url"))


def analysis_requests(images: DataFrame, cfg: Settings, batch_size: int = BACKFILL_BATCH,
                      analyze_ocr: bool | None = None, analyze_embedding: bool | None = None) -> DataFrame:
    """SRC5: one JSON payload per batch of ``batch_size`` images, in id order.

    Only ids are numbered; urls or bytes join their number once.
    """
    ocr = cfg.analyze_ocr_enabled if analyze_ocr is None else analyze_ocr
    emb = cfg.analyze_embedding_enabled if analyze_embedding is None else analyze_embedding
    idx = dense_index(images.select("id").distinct(), "id")
    b = images.select("id", "sha1", "url").join(idx, "id").withColumn("batch_no", F.floor(F.col("idx") / batch_size).cast("long"))
    g = b.groupBy("batch_no").agg(F.array_sort(F.collect_list(F.struct("id", "sha1", "url"))).alias("images"),
                                  F.count("*").alias("n_images"))
    return g.select("batch_no", "n_images", F.to_json(F.struct(
        "images", F.lit(ocr).alias("ocr"), F.lit(emb).alias("embedding"))).alias("payload"))


def parse_analysis(responses: DataFrame, body_col: str = "body") -> DataFrame:
    """SRC4: response bodies -> one row per image result."""
    parsed = responses.select("*", F.from_json(F.col(body_col), ANALYSIS_RESPONSE_DDL).alias("_r"))
    return parsed.select(*[c for c in responses.columns if c != body_col], F.explode("_r.images").alias("img")) \
        .select("*", "img.*").drop("img")


# ------------------------------------------------------------------------ U1
def per_content(images: DataFrame) -> DataFrame:
    """One work item per content key: (sha1, id = smallest image with it, what any of its images needs)."""
    flags = [F.bool_or(c).alias(c) for c in ("run_ocr", "run_embed") if c in images.columns]
    return images.groupBy("sha1").agg(F.min("id").alias("id"), *flags)


def run_analyzer(images: DataFrame, analyzer: Analyzer, batch_size: int = BACKFILL_BATCH,
                 files: DataFrame | None = None) -> DataFrame:
    """Results of the model, called on each distinct content key once, in executor batches.

    Keys are de-duplicated before url and bytes (``files``: upload_id, content)
    are joined, so wide values are neither sorted nor shuffled for it. A call
    that fails with one of ``CALL_ERRORS`` becomes rows with
    ``transport_error = true`` and the message (no retry is counted for them);
    any other exception fails the job. With a DataFrame of answers
    (sha1, ocr_result, embedding, success) they are joined instead. Image ids
    are unique.
    """
    work = per_content(images)
    if isinstance(analyzer, DataFrame):
        answers = analyzer.select("sha1", "ocr_result", "embedding", "success")
        return work.select("sha1").join(answers, "sha1").select(
            "sha1", "ocr_result", F.col("embedding").cast("array<float>").alias("embedding"), "success",
            F.lit(False).alias("transport_error"), F.lit(None).cast("string").alias("error"))
    wide = [c for c in ("url", "content") if c in images.columns]
    todo = work.join(images.select("id", *wide), "id")
    if files is not None:
        todo = todo.join(files.select(F.col("upload_id").alias("id"), "content"), "id", "left")

    def call(batches):
        for pdf in batches:
            for i in range(0, len(pdf), batch_size):
                chunk = pdf.iloc[i:i + batch_size].reset_index(drop=True)
                try:
                    out = analyzer(chunk).assign(transport_error=False, error=None)
                except CALL_ERRORS as e:
                    out = pd.DataFrame({"sha1": chunk["sha1"].to_numpy(), "ocr_result": None, "embedding": None,
                                        "success": False, "transport_error": True, "error": str(e)})
                yield out[["sha1", "ocr_result", "embedding", "success", "transport_error", "error"]]

    return todo.mapInPandas(call, RESULT_DDL)


# ------------------------------------------------------------ J14, WR2, S2, WR3
def match_results(results: DataFrame, images: DataFrame, reference_dedup: bool = False) -> DataFrame:
    """Results -> uploads of the batch by content key.

    Default: every upload of the batch with that key. ``reference_dedup``: only
    the last (largest id) one, as a hash keyed by content key would keep.
    """
    imgs = images.select(F.col("id").alias("upload_id"), "sha1")
    if reference_dedup:
        imgs = imgs.groupBy("sha1").agg(F.max("upload_id").alias("upload_id"))
    return results.join(imgs, "sha1")


def storable_results(matched: DataFrame, uploads: DataFrame, cfg: Settings, cjk_bigrams: bool | None = None,
                     run_ocr: Column | None = None, run_embed: Column | None = None) -> DataFrame:
    """WR2: the index rows to upsert from successful, matching results.

    A part is kept only when its analysis is enabled and it came back; a row
    with neither part is skipped; a content-key mismatch is skipped.
    """
    u = uploads.select(F.col("id").alias("upload_id"), content_key().alias("_key"))
    m = matched.filter(F.col("success")).join(u, "upload_id").filter(F.col("_key") == F.col("sha1"))
    ocr_on = F.lit(cfg.analyze_ocr_enabled) if run_ocr is None else run_ocr
    emb_on = F.lit(cfg.analyze_embedding_enabled) if run_embed is None else run_embed
    text = F.when(ocr_on & F.col("ocr_result").isNotNull(), join_lines(F.col("ocr_result")))
    vec = F.when(emb_on & F.col("embedding").isNotNull(), F.col("embedding"))
    rows = m.select("upload_id", "sha1", text.alias("ocr_text"), vec.alias("embeddings"))
    rows = rows.filter(F.col("ocr_text").isNotNull() | F.col("embeddings").isNotNull())
    cjk = cfg.cjk_bigrams if cjk_bigrams is None else cjk_bigrams
    return rows.withColumn("ocr_lexemes", lexemes(F.col("ocr_text"), cjk, cfg.lexeme_filter))


def failed_images(images: DataFrame, results: DataFrame) -> DataFrame:
    """Requested images whose content key has no successful result (duplicates kept).

    Images of a call that failed as a whole (transport error) are excluded.
    """
    ok = results.filter(F.col("success")).select("sha1").distinct()
    transport = results.filter(F.col("transport_error")).select("sha1").distinct()
    return images.join(ok, "sha1", "left_anti").join(transport, "sha1", "left_anti")


# ---------------------------------------------------------------- J13, WR4, P5
def reuse_donors(targets: DataFrame, index: DataFrame) -> DataFrame:
    """(upload_id, donor_id) - the smallest other upload with the same content,
    both parts present. Only the two smallest donors per key are kept before the
    join (partial top-k ahead of the shuffle), so a hot key stays bounded.
    """
    donors = index.filter(F.col("ocr_lexemes").isNotNull() & F.col("embeddings").isNotNull()).select(
        "sha1", F.col("upload_id").alias("donor_id"))
    w = Window.partitionBy("sha1").orderBy("donor_id")
    two = donors.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= 2).drop("_r")
    t = targets.select(F.col("id").alias("upload_id"), "sha1")
    j = t.join(two, "sha1").filter(F.col("donor_id") != F.col("upload_id"))
    return j.groupBy("upload_id").agg(F.min("donor_id").alias("donor_id"))


def reuse_rows(donors: DataFrame, index: DataFrame) -> DataFrame:
    """WR4: index rows copied from the donors (text, lexemes, vector)."""
    src = index.select(F.col("upload_id").alias("donor_id"), "sha1", "ocr_text", "ocr_lexemes", "embeddings")
    return donors.join(src, "donor_id").select("upload_id", "sha1", "ocr_text", "ocr_lexemes", "embeddings")


def analysis_plan(targets: DataFrame, index: DataFrame, cfg: Settings) -> DataFrame:
    """P5: per image, whether OCR and/or the embedding still need to run.

    NULL and empty OCR both count as "to run" here (unlike the planner's IS NULL).
    """
    # What is missing is decided on the index rows: neither lexemes nor vectors go through the join.
    no_text = F.col("ocr_lexemes").isNull() | (F.size("ocr_lexemes") == 0)
    st = index.select(F.col("upload_id").alias("id"), no_text.alias("_no_text"), F.col("embeddings").isNull().alias("_no_emb"))
    j = targets.join(st, "id", "left")
    run_ocr = F.lit(cfg.analyze_ocr_enabled) & F.coalesce("_no_text", F.lit(True))
    run_emb = F.lit(cfg.analyze_embedding_enabled) & F.coalesce("_no_emb", F.lit(True))
    return j.select(*targets.columns, run_ocr.alias("run_ocr"), run_emb.alias("run_embed"))


# ----------------------------------------------------------------- C4, C5
def _analyze(todo: DataFrame, t: ForumTables, cfg: Settings, analyzer: Analyzer, files: DataFrame | None,
             batch_size: int, record_failed: bool):
    """Work items (id, sha1, run_ocr, run_embed) -> (index rows, failures); the model runs once, here."""
    todo = materialize(todo, "analysis-todo")
    reps = t.uploads.join(per_content(todo).select("id"), "id", "left_semi")
    info = image_info(reps, cfg, files).select("id", "url").join(todo, "id")
    # What any image of a content needs is asked for, not what its smallest image needs.
    asked = per_content(todo).select("sha1", "run_ocr", "run_embed")
    info = info.drop("run_ocr", "run_embed").join(asked, "sha1")
    results = materialize(run_analyzer(info, analyzer, batch_size, files), "analysis-results")
    matched = match_results(results, todo).join(
        todo.select(F.col("id").alias("upload_id"), "run_ocr", "run_embed"), "upload_id")
    stored = storable_results(matched, t.uploads, cfg, run_ocr=F.col("run_ocr"), run_embed=F.col("run_embed"))
    failed = failed_images(todo, results).groupBy(F.col("id").alias("upload_id"), "sha1").agg(F.count("*").alias("n"))
    return stored, failed if record_failed else failed.limit(0)


def _parts(cfg: Settings, analyze_ocr: bool | None, analyze_embedding: bool | None) -> Settings:
    """Settings with a run's own choice of parts."""
    over = {"analyze_ocr_enabled": analyze_ocr, "analyze_embedding_enabled": analyze_embedding}
    return cfg.with_(**{k: v for k, v in over.items() if v is not None})


def process_images(targets: DataFrame, t: ForumTables, cfg: Settings, analyzer: Analyzer,
                   files: DataFrame | None = None, force: bool = False, batch_size: int = BACKFILL_BATCH,
                   record_failed: bool = True, analyze_ocr: bool | None = None, analyze_embedding: bool | None = None):
    """Reuse by content, else analyze what is missing, for a set of uploads.

    ``targets``: uploads rows. Returns (outcomes, upserts, failures):
    outcomes (upload_id, outcome in reused/analyzed/failed/skipped),
    upserts (index rows for ``merge_results``; ``reused`` rows keep their retry
    count), failures (upload_id, sha1, n) for ``record_failures`` (none with
    ``record_failed=False``).
    """
    cfg = _parts(cfg, analyze_ocr, analyze_embedding)
    tg = targets.select("id", content_key().alias("sha1"))
    if force:
        donors = tg.limit(0).select(F.col("id").alias("upload_id"), F.lit(None).cast("long").alias("donor_id"))
        planned = tg.select("*", F.lit(cfg.analyze_ocr_enabled).alias("run_ocr"),
                            F.lit(cfg.analyze_embedding_enabled).alias("run_embed"))
    else:
        donors = materialize(reuse_donors(tg, t.index), "analysis-donors")
        rest = tg.join(donors.select(F.col("upload_id").alias("id")), "id", "left_anti")
        planned = analysis_plan(rest, t.index, cfg)
    todo = planned.filter(F.col("run_ocr") | F.col("run_embed"))
    stored, failed = _analyze(todo, t, cfg, analyzer, files, batch_size, record_failed)
    upserts = stored.withColumn("reused", F.lit(False)).unionByName(
        reuse_rows(donors, t.index).withColumn("reused", F.lit(True)))
    outcomes = (donors.select("upload_id", F.lit("reused").alias("outcome"))
                .unionByName(stored.select("upload_id", F.lit("analyzed").alias("outcome")))
                .unionByName(failed.select("upload_id", F.lit("failed").alias("outcome"))))
    skipped = tg.select(F.col("id").alias("upload_id")).join(outcomes.select("upload_id"), "upload_id", "left_anti")
    outcomes = outcomes.unionByName(skipped.select("upload_id", F.lit("skipped").alias("outcome")))
    return outcomes, upserts, failed


def process_posts(post_ids: DataFrame, t: ForumTables, cfg: Settings, analyzer: Analyzer,
                  files: DataFrame | None = None, force: bool = False, batch_size: int = BACKFILL_BATCH,
                  record_failed: bool = True, analyze_ocr: bool | None = None, analyze_embedding: bool | None = None,
                  auto_flag_ocr: bool | None = None):
    """C4: analyze the eligible images of each post (at most the cap per post), then check for flags.

    Returns (post_outcomes, upserts, failures, flags). A post over the cap, or
    with no eligible image, is skipped and not flagged; ``force`` skips only the
    post check. Flags (C6) look at all indexed images of a processed post, with
    the texts of this run merged in.
    """
    cfg = _parts(cfg, analyze_ocr, analyze_embedding)
    posts = post_ids.select(F.col("post_id").alias("id"))
    if not force:
        posts = el.filter_posts(t.posts.join(posts, "id", "left_semi"), t, cfg).select("id")
    ups = el.filter_uploads(t.uploads, t, cfg, include_partially_analyzed=True).select(F.col("id").alias("upload_id"))
    pairs = t.post_uploads.join(posts.select(F.col("id").alias("post_id")), "post_id", "left_semi").join(
        ups, "upload_id", "left_semi")
    counts = pairs.groupBy("post_id").agg(F.count("*").alias("n_images"))
    ok = counts.filter(F.col("n_images") <= cfg.max_images_per_post)
    per_post = materialize(pairs.join(ok.select("post_id"), "post_id", "left_semi"), "analysis-pairs")
    imgs = per_post.select(F.col("upload_id").alias("id")).distinct()
    todo = t.uploads.join(imgs, "id", "left_semi").select(
        "id", content_key().alias("sha1"), F.lit(cfg.analyze_ocr_enabled).alias("run_ocr"),
        F.lit(cfg.analyze_embedding_enabled).alias("run_embed")).filter(F.col("run_ocr") | F.col("run_embed"))
    stored, failed = _analyze(todo, t, cfg, analyzer, files, batch_size, record_failed)
    st = stored.select("upload_id", F.lit(1).alias("_ok"))
    fl = failed.select("upload_id", F.lit(1).alias("_failed"))
    post_out = per_post.join(st, "upload_id", "left").join(fl, "upload_id", "left").groupBy("post_id").agg(
        F.count("*").alias("n_images"), F.count("_ok").alias("n_analyzed"), F.count("_failed").alias("n_failed"))
    done = per_post.select("post_id").distinct()
    if cfg.auto_flag_ocr if auto_flag_ocr is None else auto_flag_ocr:
        held = t.post_uploads.join(done, "post_id", "left_semi").select("upload_id").distinct()
        new = stored.select("upload_id", F.col("ocr_text").alias("new_text"))
        texts = (held.join(t.index.select("upload_id", "ocr_text"), "upload_id", "left").join(new, "upload_id", "left")
                 .select("upload_id", F.coalesce("new_text", "ocr_text").alias("ocr_text")))
        flags = md.flag_posts(done, t.replace(index=texts))
    else:
        flags = md.flag_posts(done.limit(0), t)
    return post_out, stored, failed, flags
