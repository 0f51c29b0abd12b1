"""Filters below the vector top-k (V4, survey Q3).

A request with filters ranks only the images that have a searchable post which passes every filter, so its
page fills while matches are left. Images carry the attributes of their posts into the scorer's blocks
(``image_posts``), requests carry their resolved filters (``filters.request_filters``), and the filters are
evaluated on the arrays of a block: no row per (request, image) exists outside of it.

An image with more than ``POSTS_PER_ROW`` posts stands in several rows, one for each part of its posts. The rows
are dealt to blocks one by one, so that a block has about ``POSTS_PER_BLOCK`` posts whatever an image has.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tables import ForumTables
from . import filters as flt

POSTS_PER_ROW = 512
POSTS_PER_BLOCK = 1 << 17  # (image, post) pairs of one block of images: what one worker holds as objects
ATTRIBUTES = ("post_id", "topic_id", "user_id", "category_id", "created")


def image_posts(pairs: DataFrame, t: ForumTables, with_tags: bool = True) -> DataFrame:
    """(upload_id, part, posts) of (post_id, upload_id, topic_id, user_id, category_id, created_at) pairs."""
    if with_tags:
        pairs = flt.with_topic_tags(pairs, t)
    else:
        pairs = pairs.withColumn("topic_tag_names", F.lit(None).cast("array<string>"))
    parts = pairs.groupBy("upload_id").agg(F.ceil(F.count("*") / POSTS_PER_ROW).alias("parts"))
    created = F.unix_micros(F.col("created_at").cast("timestamp")).alias("created")
    one = F.struct("post_id", "topic_id", "user_id", "category_id", created, F.col("topic_tag_names").alias("tags"))
    return (pairs.join(parts, "upload_id").groupBy("upload_id", F.pmod(F.xxhash64("post_id"), F.col("parts")).alias("part"))
            .agg(F.collect_list(one).alias("posts")))


class Allowed:
    """The posts of one block of images, and which images pass a list of filters."""

    def __init__(self, images: pd.DataFrame, masks: dict):
        self.masks = masks  # of the driver's filter kinds: workers know the built-in ones only
        rows = [p if p is not None else () for p in images["posts"]]
        self.ids = images["upload_id"].to_numpy(np.int64)
        self.image = np.repeat(np.arange(len(rows)), [len(p) for p in rows])
        posts = [x for p in rows for x in p]
        self.posts = {a: np.array([np.nan if x[a] is None else x[a] for x in posts], dtype=np.float64 if any(
            x[a] is None for x in posts) else np.int64) for a in ATTRIBUTES}
        self.posts["tags"] = [frozenset(x["tags"]) if x["tags"] is not None else frozenset() for x in posts]
        self.known: dict = {}

    def rows(self, filters) -> np.ndarray:
        """Rows of the block, one per image, that hold a post which passes all filters."""
        asked = tuple((f["kind"], f["arg"], tuple(f["keys"])) for f in filters)
        if asked not in self.known:
            ok = np.ones(len(self.image), dtype=bool)
            for kind, arg, keys in asked:
                ok &= self.masks[kind](self.posts, arg, keys) if kind in self.masks else False
            at = np.unique(self.image[ok])
            self.known[asked] = at[np.unique(self.ids[at], return_index=True)[1]]
        return self.known[asked]


def masks() -> dict:
    return {kind: k.mask for kind, k in flt.KINDS.items() if k.mask is not None}
