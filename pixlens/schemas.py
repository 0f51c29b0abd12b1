"""Declared schemas of the host tables and of the tables this engine owns."""

from __future__ import annotations

from pyspark.sql import types as T

L, S, I, B, D = T.LongType(), T.StringType(), T.IntegerType(), T.BooleanType(), T.DoubleType()
TS = T.TimestampNTZType()


def _s(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


LEXEME = _s(("lexeme", S, False), ("positions", T.ArrayType(I, False), False))

# The merged image index, one row per upload.
INDEX = _s(
    ("upload_id", L, False),
    ("sha1", S, False),
    ("ocr_text", S, True),
    ("ocr_lexemes", T.ArrayType(S), True),
    ("embeddings", T.ArrayType(T.FloatType()), True),
    ("retry_times", I, False),
)

UPLOADS = _s(
    ("id", L, False), ("sha1", S, True), ("original_sha1", S, True), ("url", S, True),
    ("secure", B, True), ("extension", S, True), ("original_filename", S, True),
    ("filesize", L, True), ("width", L, True), ("height", L, True),
)
POSTS = _s(
    ("id", L, False), ("topic_id", L, True), ("user_id", L, True), ("post_number", L, True),
    ("created_at", TS, True), ("deleted_at", TS, True), ("url", S, True),
)
TOPICS = _s(("id", L, False), ("category_id", L, True), ("visible", B, True),
            ("archetype", S, True), ("title", S, True))
CATEGORIES = _s(("id", L, False), ("slug", S, True), ("name", S, True),
                ("parent_category_id", L, True), ("read_restricted", B, True))
TAGS = _s(("id", L, False), ("name", S, True))
TOPIC_TAGS = _s(("topic_id", L, False), ("tag_id", L, False))
USERS = _s(("id", L, False), ("username", S, True), ("username_lower", S, True), ("staged", B, True))
POST_UPLOADS = _s(("post_id", L, False), ("upload_id", L, False))
CUSTOM_EMOJIS = _s(("upload_id", L, True))
OPTIMIZED_IMAGES = _s(("id", L, False), ("upload_id", L, False), ("url", S, True),
                      ("width", L, True), ("height", L, True))
WATCHED_WORDS = _s(("word", S, False), ("action", S, False))

# One row per search request; "one HTTP request" of the host becomes one row.
SEARCH_REQUESTS = _s(
    ("request_id", L, False), ("method", S, True), ("term", S, True), ("image_ref", S, True),
    ("image_content_type", S, True), ("ocr", S, True), ("embed", S, True), ("page", L, True),
    ("current_user_id", L, True),
)

# Analysis service wire formats.
ANALYSIS_IMAGE = _s(("id", L, True), ("sha1", S, True), ("url", S, True))
ANALYSIS_RESULT = _s(
    ("sha1", S, True), ("ocr_result", T.ArrayType(S), True),
    ("embedding", T.ArrayType(T.FloatType()), True), ("success", B, True),
)
ANALYSIS_RESPONSE_DDL = (
    "images array<struct<sha1:string, ocr_result:array<string>, embedding:array<float>, success:boolean>>"
)

HOST_SCHEMAS = {
    "uploads": UPLOADS, "posts": POSTS, "topics": TOPICS, "categories": CATEGORIES,
    "tags": TAGS, "topic_tags": TOPIC_TAGS, "users": USERS, "post_uploads": POST_UPLOADS,
    "custom_emojis": CUSTOM_EMOJIS, "optimized_images": OPTIMIZED_IMAGES,
    "watched_words": WATCHED_WORDS, "image_search_data": INDEX,
}
