"""Search requests as rows: validation, mode selection, term parsing (F19, F20, TX5, TX6).

"One HTTP request" of the host becomes one row of a ``search_requests``
DataFrame; every step is a column expression, so a batch of any size is one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_blank, query_tokens

# The advanced-filter patterns, in registration order.
FILTER_PATTERNS: list[tuple[str, str]] = [
    ("topic", r"(?i)\Atopic:(\d+)\z"),
    ("before", r"(?i)\Abefore:(.*)\z"),
    ("after", r"(?i)\Aafter:(.*)\z"),
    ("user", r"(?i)\A@(\S+)\z"),
    ("tags", r"(?i)\Atags:(\S+)\z"),
    ("category", r"(?i)\Acategor(?:y|ies):(.+)\z"),
    ("category_slug", r"(?i)\A#([\p{L}\p{M}0-9\-:=]+)\z"),
]


def register_pattern(kind: str, pattern: str) -> None:
    """Add a filter kind (its matcher resolves in ``operators.filters``)."""
    FILTER_PATTERNS[:] = [(k, p) for k, p in FILTER_PATTERNS if k != kind] + [(kind, pattern)]


def validate_requests(requests: DataFrame, min_term_length: int = 0) -> DataFrame:
    """add ``error`` (NULL when the request is valid).

    GET needs a term; POST needs an image or a term, and an image's content type
    must start with ``image/``. ``min_term_length`` mirrors the browser check
    (off by default, like the server).
    """
    has_image = ~is_blank(F.col("image_ref"))
    blank_term = is_blank(F.col("term"))
    post = F.upper(F.col("method")) == "POST"
    err = (F.when(~post & blank_term, F.lit("term"))
           .when(post & has_image & ~F.coalesce(F.col("image_content_type"), F.lit("")).startswith("image/"),
                 F.lit("image"))
           .when(post & ~has_image & blank_term, F.lit("image,term")))
    if min_term_length > 0:
        err = F.when(err.isNull() & ~has_image & (F.length(F.trim("term")) < min_term_length),
                     F.lit("term_length")).otherwise(err)
    return requests.withColumn("error", err)


def _flag(c: Column) -> Column:
    """Only the literal string ``true`` is true; absent means true."""
    return F.coalesce(c, F.lit("true")) == "true"


def request_modes(requests: DataFrame) -> DataFrame:
    """by_image / search_ocr / search_embeddings / page per request."""
    by_image = (F.upper(F.col("method")) == "POST") & ~is_blank(F.col("image_ref"))
    return requests.select(
        "*",
        by_image.alias("search_by_image"),
        (~by_image & _flag(F.col("ocr"))).alias("search_ocr"),
        (~by_image & _flag(F.col("embed"))).alias("search_embeddings"),
        F.coalesce(F.col("page"), F.lit(0)).cast("long").alias("page_no"),
    )


def _kind_of(cleaned: Column) -> Column:
    out = F.lit(None).cast("string")
    for kind, pat in reversed(FILTER_PATTERNS):
        out = F.when(cleaned.rlike(pat), F.lit(kind)).otherwise(out)
    return out


def _arg_of(cleaned: Column, kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, pat in FILTER_PATTERNS:
        out = F.when(kind == k, F.regexp_extract(cleaned, pat, 1)).otherwise(out)
    return out


def parse_requests(requests: DataFrame) -> DataFrame:
    """TX5 + TX6: add ``processed_term`` and ``filters`` (array of kind/arg/no).

    A word whose quote-stripped form matches a filter pattern becomes a filter;
    the other words, quotes kept, are re-joined with single spaces.
    """
    toks = F.when(is_blank(F.col("term")), F.array().cast("array<string>")).otherwise(query_tokens(F.col("term")))
    tagged = F.transform(toks, lambda w: F.struct(
        w.alias("word"),
        _kind_of(F.regexp_replace(w, "[\"']", "")).alias("kind"),
        F.regexp_replace(w, "[\"']", "").alias("cleaned")))
    t = F.col("_tagged")
    processed = F.array_join(F.transform(F.filter(t, lambda s: s["kind"].isNull()), lambda s: s["word"]), " ")
    filters = F.transform(
        F.filter(t, lambda s: s["kind"].isNotNull()),
        lambda s, i: F.struct((i + 1).cast("int").alias("filter_no"), s["kind"].alias("kind"),
                              _arg_of(s["cleaned"], s["kind"]).alias("arg")))
    return (requests.withColumn("_tagged", tagged)
            .select("*", processed.alias("processed_term"), filters.alias("filters"))
            .drop("_tagged"))


def filter_rows(parsed: DataFrame) -> DataFrame:
    """(request_id, filter_no, kind, arg, current_user_id) for every extracted filter."""
    cols = ["request_id", F.inline("filters")]
    if "current_user_id" in parsed.columns:
        cols.insert(1, "current_user_id")
    return parsed.select(*cols)
