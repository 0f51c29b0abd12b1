"""Backfill planning as one distributed plan.

The host runs an hourly loop of 100-image batches bounded by time and
failures; here the whole backlog is planned at once: priority order (newest
post first) or keyset batches by upload id, each batch numbered without a
driver loop, then analyzed by ``process_images`` in one job.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKFILL_BATCH, Settings
from ..sources.tables import ForumTables
from .analysis import Analyzer, dense_index, process_images
from .eligibility import uploads_needing_analysis


def backfill_priority(t: ForumTables, cfg: Settings, limit: int = BACKFILL_BATCH) -> DataFrame:
    """The next batch: uploads by their newest post, newest first (de-duplicated).

    The limit is the feature (one job's batch); Spark plans it as a top-k.
    """
    pairs = uploads_needing_analysis(t, cfg, with_posts=True)
    newest = pairs.groupBy(F.col("id").alias("upload_id")).agg(F.max("post_id").alias("newest_post_id"))
    w = Window.orderBy(F.col("newest_post_id").desc(), F.col("upload_id").desc())
    top = newest.orderBy(F.col("newest_post_id").desc(), F.col("upload_id").desc()).limit(limit)
    return top.withColumn("priority", F.row_number().over(w).cast("long"))


def backfill_batches(t: ForumTables, cfg: Settings, batch_size: int = BACKFILL_BATCH) -> DataFrame:
    """T7 + A6: keyset batches ``id < cursor order by id desc`` for the whole backlog.

    Output per upload: (upload_id, batch_no); per-batch min/max via ``batch_bounds``.
    """
    ups = uploads_needing_analysis(t, cfg).select(F.col("id").alias("upload_id"))
    idx = dense_index(ups, "upload_id", descending=True)
    return idx.select("upload_id", F.floor(F.col("idx") / batch_size).cast("long").alias("batch_no"))


def batch_bounds(batches: DataFrame) -> DataFrame:
    """Per batch, the id range and size (progress and next cursor)."""
    return batches.groupBy("batch_no").agg(F.min("upload_id").alias("min_id"), F.max("upload_id").alias("max_id"),
                                           F.count("*").alias("n_uploads"))


def backfill(t: ForumTables, cfg: Settings, analyzer: Analyzer, files: DataFrame | None = None,
             limit: int | None = None, batch_size: int = BACKFILL_BATCH):
    """Plan the backlog (or the next ``limit`` by priority) and process it in one job.

    Nothing is planned when analysis or search is switched off.
    """
    if not (cfg.enabled and cfg.search_enabled):
        return process_images(t.uploads.limit(0), t, cfg, analyzer, files=files, batch_size=batch_size)
    if limit is not None:
        ids = backfill_priority(t, cfg, limit).select(F.col("upload_id").alias("id"))
    else:
        ids = uploads_needing_analysis(t, cfg).select("id")
    targets = t.uploads.join(ids, "id", "left_semi")
    return process_images(targets, t, cfg, analyzer, files=files, batch_size=batch_size)
