from __future__ import annotations

import datetime as dt
import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pixlens import schemas  # noqa: E402
from pixlens.session import build_session, ship_package  # noqa: E402
from pixlens.sources.tables import ForumTables  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = build_session("local[4]", 4, app="pixlens-tests")
    ship_package(s)
    yield s
    s.stop()


T0 = dt.datetime(2024, 1, 1)


def forum(spark, **rows) -> ForumTables:
    """A forum from literal rows; every table defaults to empty."""
    def df(name, schema_name=None):
        sch = schemas.HOST_SCHEMAS[schema_name or name]
        return spark.createDataFrame(rows.get(name, []), sch)

    return ForumTables(
        posts=df("posts"), topics=df("topics"), categories=df("categories"), tags=df("tags"),
        topic_tags=df("topic_tags"), users=df("users"), uploads=df("uploads"),
        post_uploads=df("post_uploads"), custom_emojis=df("custom_emojis"),
        optimized_images=df("optimized_images"), watched_words=df("watched_words"),
        index=df("index", "image_search_data"),
    )


def post(id, topic_id=1, user_id=1, post_number=1, created_at=T0, deleted_at=None):
    return (id, topic_id, user_id, post_number, created_at, deleted_at, f"/t/{topic_id}/{id}")


def topic(id, category_id=1, visible=True, archetype="regular", title="t"):
    return (id, category_id, visible, archetype, title)


def category(id, slug="general", name=None, parent=None, restricted=False):
    return (id, slug, name or slug.title(), parent, restricted)


def upload(id, sha1=None, original_sha1=None, filesize=1000, width=150, height=150, filename=None):
    fn = filename or f"img{id}.png"
    return (id, sha1 or f"sha{id}", original_sha1, f"/uploads/{fn}", False, "png", fn, filesize, width, height)


def index_row(upload_id, sha1=None, ocr_text="text", embeddings=(0.1, 0.2), retry=0, lexemes=None):
    lex = lexemes if lexemes is not None else (None if ocr_text is None else ocr_text.lower().split())
    emb = list(embeddings) if embeddings is not None else None
    return (upload_id, sha1 or f"sha{upload_id}", ocr_text, lex, emb, retry)
