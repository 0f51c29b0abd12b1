"""Periodic runs that look only at what changed (ST3): backfill plan and cleanup.

The host repeats a backfill every hour and a cleanup every three days over everything it has. Here a stream of
changes (kind, id) says which posts, topics, categories, tags, uploads and emojis changed since the last run;
``touched_uploads`` follows them to the uploads whose state can differ, and only these are planned again with
the batch operators. Each micro-batch writes its decisions, one row per touched upload, to a folder of its own,
so a replay writes the same folder again; ``decided`` folds them over the sets of the last full run.
A run uses ``Trigger.AvailableNow``: it takes the changes that are there and ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..operators import eligibility as el
from ..session import materialize
from ..sources.tables import ForumTables

CHANGES = "kind string, id long"
KINDS = ("post", "topic", "category", "tag", "upload", "emoji", "link")


def touched_uploads(changes: DataFrame, t: ForumTables) -> DataFrame:
    """(upload_id) whose eligibility or index state the changes can alter.

    A change of a row's parent (a post that moved to another topic, a topic to another category) is a change
    of that row. A new or removed link counts as a change of its upload; kind ``link`` names the upload too.
    """
    def of(kind):
        return changes.filter(F.col("kind") == kind).select("id").distinct()

    tagged = t.topic_tags.join(of("tag").withColumnRenamed("id", "tag_id"), "tag_id", "left_semi").select("topic_id")
    filed = t.topics.join(of("category").withColumnRenamed("id", "category_id"), "category_id", "left_semi").select(
        F.col("id").alias("topic_id"))
    topics = of("topic").select(F.col("id").alias("topic_id")).unionByName(tagged).unionByName(filed).distinct()
    posts = t.posts.join(topics, "topic_id", "left_semi").select(F.col("id").alias("post_id"))
    posts = posts.unionByName(of("post").select(F.col("id").alias("post_id"))).distinct()
    own = changes.filter(F.col("kind").isin("upload", "emoji", "link")).select(F.col("id").alias("upload_id"))
    return t.post_uploads.join(posts, "post_id", "left_semi").select("upload_id").unionByName(own).distinct()


def restricted(t: ForumTables, uploads: DataFrame) -> ForumTables:
    """The tables with only the given uploads, their links and index rows."""
    ids = uploads.select(F.col("upload_id").alias("id"))
    return t.replace(uploads=t.uploads.join(ids, "id", "left_semi"),
                     post_uploads=t.post_uploads.join(uploads, "upload_id", "left_semi"),
                     index=t.index.join(uploads, "upload_id", "left_semi"))


def decide(changes: DataFrame, t: ForumTables, cfg: Settings) -> DataFrame:
    """(upload_id, needed, stale) for every touched upload, by the operators of the full runs."""
    uploads = materialize(touched_uploads(changes, t), "periodic-uploads")
    own = restricted(t, uploads)
    own = own.replace(post_uploads=materialize(own.post_uploads, "periodic-links"))  # both decisions read them
    needed = el.uploads_needing_analysis(own, cfg).select(F.col("id").alias("upload_id"), F.lit(True).alias("needed"))
    stale = el.stale_index_rows(own, cfg).select("upload_id", F.lit(True).alias("stale"))
    return (uploads.join(needed, "upload_id", "left").join(stale, "upload_id", "left")
            .select("upload_id", F.coalesce("needed", F.lit(False)).alias("needed"), F.coalesce("stale", F.lit(False)).alias("stale")))


def run_changes(changes: DataFrame, t: ForumTables, cfg: Settings, root: str, checkpoint: str) -> None:
    """Take all changes of the stream that are there; decisions go to ``root``."""
    def body(batch: DataFrame, batch_id: int) -> None:
        decide(batch, t, cfg).write.mode("overwrite").parquet(f"{root}/b{batch_id:012d}")

    changes.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).trigger(availableNow=True) \
        .start().awaitTermination()


def decided(spark: SparkSession, root: str, before: DataFrame, what: str) -> DataFrame:
    """(upload_id) of ``before``, the set of the last full run, with the decisions on ``what`` (needed or stale) applied."""
    at = F.regexp_extract(F.input_file_name(), r"/b(\d{12})/", 1)
    d = spark.read.schema("upload_id long, needed boolean, stale boolean").parquet(f"{root}/b*").select(
        "upload_id", F.col(what).alias("yes"), at.alias("at"))
    last = d.groupBy("upload_id").agg(F.max_by("yes", "at").alias("yes"))
    return (before.select("upload_id").join(last.select("upload_id"), "upload_id", "left_anti")
            .unionByName(last.filter("yes").select("upload_id")))
