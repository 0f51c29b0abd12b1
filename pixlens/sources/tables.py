"""Host and index tables as DataFrames (SRC1).

A deployment points ``ForumTables`` at Parquet folders (or any DataFrames, e.g.
a JDBC read with ``partitionColumn``); nothing is collected to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from .. import schemas


@dataclass
class ForumTables:
    """The host tables an image-search job reads, plus the image index."""

    posts: DataFrame
    topics: DataFrame
    categories: DataFrame
    tags: DataFrame
    topic_tags: DataFrame
    users: DataFrame
    uploads: DataFrame
    post_uploads: DataFrame
    custom_emojis: DataFrame
    optimized_images: DataFrame
    watched_words: DataFrame
    index: DataFrame

    def replace(self, **kw) -> "ForumTables":
        d = {f.name: getattr(self, f.name) for f in fields(self)}
        d.update(kw)
        return ForumTables(**d)


def read_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    """Parquet read with the declared schema (columns pruned by Catalyst)."""
    return spark.read.schema(schemas.HOST_SCHEMAS[name]).parquet(path)


def read_forum(spark: SparkSession, root: str) -> ForumTables:
    """Read every host table from ``root/<name>`` Parquet folders."""
    r = lambda n: read_table(spark, f"{root.rstrip('/')}/{n}", n)
    return ForumTables(
        posts=r("posts"), topics=r("topics"), categories=r("categories"), tags=r("tags"),
        topic_tags=r("topic_tags"), users=r("users"), uploads=r("uploads"),
        post_uploads=r("post_uploads"), custom_emojis=r("custom_emojis"),
        optimized_images=r("optimized_images"), watched_words=r("watched_words"),
        index=r("image_search_data"),
    )
