"""OCR text index as bitmaps, with prefix terms (TX2, TX3, TX4).

A posting list is a set of rows, one for each (lexeme, range of upload ids that one bitmap covers), so a lexeme
that a third of all images hold is spread over as many rows as there are ranges. A row of at least ``DENSE``
ids holds them as a bitmap (``bits``, else empty), the many rows of rare lexemes as an array (``places``, else NULL).
A batch of requests is answered rarest word first: the totals per lexeme (key columns only) give the order of
the words of each request, the ids of the first are its candidates, and each further word is looked up in the
ranges that still have candidates. Neither bitmaps nor candidates without a match leave the join that tests them.

``dictionary`` is the table of distinct lexemes by the beginnings of one to ``STEM`` characters; a prefix probes
it with one equality, and the postings of its lexemes are united once, whatever the number of requests with it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import query_terms
from ..session import materialize
from .textindex import DEFAULT_BUCKETS, with_bucket

STEM = 3
RANGE = 32768  # ids of one bitmap
DENSE = 512  # ids from which a row is a bitmap


def _bitmap(places: pd.Series) -> pd.Series:
    """Arrays of positions as bitmaps of 64-bit words, the high byte first; empty for NULL."""
    def one(at):
        if at is None:
            return b""
        held = np.zeros(RANGE, np.uint8)
        held[np.asarray(at, dtype=np.int64)] = 1
        return np.packbits(held, bitorder="little").view("<u8").astype(">u8").tobytes()
    return pd.Series([one(at) for at in places], dtype=object)


def _is_set(words: Column, at: Column) -> Column:
    word = F.get(words, F.call_function("shiftright", at, F.lit(6)))
    return F.call_function("shiftright", word, at.bitwiseAND(F.lit(63))).bitwiseAND(F.lit(1).cast("long")) == 1


def _opened(post: DataFrame) -> DataFrame:
    """Posting rows with ``words``, the bitmap as an array of longs (NULL where ``places`` has the positions)."""
    word = lambda i: F.conv(F.hex(F.substring("bits", i * 8 + 1, F.lit(8))), 16, -10).cast("long")
    words = F.transform(F.sequence(F.lit(0), F.lit(RANGE // 64 - 1)), word)
    return post.select("bucket", "lexeme", "range", "places", F.when(F.col("places").isNull(), words).alias("words"))


def _set_bits(bits: pd.Series) -> pd.Series:
    """The positions of the set bits of each bitmap; NULL for none."""
    def one(b):
        if not b:
            return None
        return np.nonzero(np.unpackbits(np.frombuffer(b, ">u8").astype("<u8").view(np.uint8), bitorder="little"))[0].astype(np.int32)
    return pd.Series([one(b) for b in bits], dtype=object)


def positions(post: DataFrame, *more: str | Column) -> DataFrame:
    """(*more, range, at): the positions of each posting row, dense or not."""
    set_bits = F.pandas_udf(_set_bits, "array<int>")
    return post.select(*more, "range", F.coalesce("places", set_bits("bits")).alias("at"))


def build_postings(rows: DataFrame, n_buckets: int) -> DataFrame:
    """Posting rows of (lexeme, range, bit)."""
    bitmap = F.pandas_udf(_bitmap, "binary")
    held = rows.groupBy("lexeme", "range").agg(F.collect_set("bit").alias("_at")).withColumn("n", F.size("_at").cast("long"))
    dense = F.col("n") >= DENSE
    return with_bucket(held, n_buckets).select(
        "bucket", "lexeme", "range", "n", F.when(~dense, F.array_sort("_at")).alias("places"),
        bitmap(F.when(dense, F.col("_at"))).alias("bits"), F.lit(n_buckets).cast("int").alias("n_buckets"))


def bitmap_postings(index: DataFrame, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """TX2: (bucket, lexeme, range, n, places, bits, n_buckets); bit i of range r is one upload id."""
    rows = index.filter(F.col("ocr_lexemes").isNotNull()).select(
        F.explode(F.array_distinct("ocr_lexemes")).alias("lexeme"), F.bitmap_bucket_number("upload_id").alias("range"),
        F.bitmap_bit_position("upload_id").cast("int").alias("bit"))
    return build_postings(rows, n_buckets)


def write_bitmaps(post: DataFrame, path: str, salt: int = 8) -> None:
    """Partitioned by lexeme bucket; the ranges of a bucket are dealt to ``salt`` tasks."""
    part = F.pmod(F.xxhash64("lexeme", "range"), F.lit(salt))
    post.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_bitmaps(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def dictionary(post: DataFrame) -> DataFrame:
    """(stem, lexeme): every distinct lexeme under each of its beginnings of 1 to ``STEM`` characters."""
    stems = F.transform(F.sequence(F.lit(1), F.least(F.lit(STEM), F.length("lexeme"))), lambda k: F.substring("lexeme", F.lit(1), k))
    return post.select("lexeme").distinct().select(F.explode(stems).alias("stem"), "lexeme")


def unite(post: DataFrame, forms: DataFrame, n_buckets: int) -> DataFrame:
    """Posting rows of ``forms`` (lexeme, form): those of a form hold the ids of all its lexemes."""
    own = positions(post.join(forms, "lexeme"), F.col("form").alias("lexeme"))
    return build_postings(own.select("lexeme", "range", F.explode("at").alias("bit")), n_buckets)


def _held(cands: DataFrame, terms: DataFrame, post: DataFrame) -> DataFrame:
    """(ask, n_terms, range, hits): for each row of ``terms`` the candidates of its request that its lexeme has.

    ``cands``: (ask, range, at). Rows without a hit are left out.
    """
    probes = cands.join(terms, "ask")
    x = probes.join(_opened(post), ["bucket", "lexeme", "range"])
    hits = F.when(F.col("words").isNull(), F.array_intersect("at", "places")).otherwise(
        F.filter("at", lambda p: _is_set(F.col("words"), p)))
    return x.select("ask", "n_terms", "range", hits.alias("hits")).filter(F.size("hits") > 0)


def search_bitmaps(requests: DataFrame, post: DataFrame, term_col: str = "processed_term", prefix: bool = False,
                   words: DataFrame | None = None, cjk_bigrams: bool = False, n_buckets: int | None = None,
                   lexeme_filter=None) -> DataFrame:
    """TX4: (request_id, upload_id) where the image text holds every query lexeme.

    With ``prefix`` a lexeme that begins with the term fulfils it (``words``: the ``dictionary``). Blank terms
    and NULL or empty lexeme sets never match. Each distinct set of terms is solved once.
    """
    if n_buckets is None:
        first = post.select("n_buckets").limit(1).collect()
        n_buckets = int(first[0][0]) if first else DEFAULT_BUCKETS
    # Requests with the same words are one: the words, sorted, are the key; a number stands for it.
    own = requests.select("request_id", F.array_join(F.array_sort(query_terms(F.col(term_col), cjk_bigrams, lexeme_filter)), " ")
                          .alias("asked")).filter(F.col("asked") != "")
    asks = materialize(own.select("asked").distinct().withColumn("ask", F.monotonically_increasing_id()), "search-asks")
    terms = asks.select("ask", F.split("asked", " ").alias("terms")).select(
        "ask", F.size("terms").alias("n_terms"), F.explode("terms").alias("lexeme"))
    if prefix:
        words = dictionary(post) if words is None else words
        asked = terms.select(F.col("lexeme").alias("form")).distinct().withColumn("stem", F.substring("form", 1, STEM))
        forms = asked.join(words, "stem").filter(F.col("lexeme").startswith(F.col("form"))).select("lexeme", "form")
        post = materialize(unite(post, forms, n_buckets), "search-prefixes")
    else:
        # All postings are shuffled once at most; what follows reads only those of the batch's words.
        asked = materialize(terms.select("lexeme").distinct(), "search-words")
        post = materialize(post.join(asked, "lexeme", "left_semi"), "search-postings")
    terms = with_bucket(terms, n_buckets)
    # Requests all of whose words occur, with their words in order of the number of images.
    totals = post.groupBy("bucket", "lexeme").agg(F.sum("n").alias("df"))
    order = (terms.join(totals, ["bucket", "lexeme"]).groupBy("ask", "n_terms")
             .agg(F.array_sort(F.collect_list(F.struct("df", "lexeme", "bucket"))).alias("order"))
             .filter(F.size("order") == F.col("n_terms")))
    order = materialize(order.select("ask", "n_terms", F.posexplode("order").alias("no", "x")).select(
        "ask", "n_terms", "no", "x.lexeme", "x.bucket"), "search-order")
    def of_lead(asked):
        return positions(asked.filter("no = 0").join(post, ["bucket", "lexeme"]), "ask", "n_terms")

    # Few terms are one word: as a table of their own they meet the postings without a shuffle of these.
    single = of_lead(materialize(order.filter("n_terms = 1"), "search-single"))
    lead = of_lead(order.filter("n_terms > 1"))
    # Most candidates fall with the second word; only what is left meets all the others.
    second = _held(lead.drop("n_terms"), order.filter("no = 1").drop("no"), post)
    second = materialize(second.withColumnRenamed("hits", "at"), "search-second")
    rest = _held(second.filter("n_terms > 2").drop("n_terms"), order.filter("no > 1").drop("no"), post)
    all_of = F.aggregate(F.slice("each", 2, F.size("each")), F.col("each")[0], lambda a, x: F.array_intersect(a, x))
    rest = (rest.groupBy("ask", "n_terms", "range").agg(F.collect_list("hits").alias("each"))
            .filter(F.size("each") == F.col("n_terms") - 2).select("ask", "range", all_of.alias("at")))
    both = (single.select("ask", "range", "at").unionByName(second.filter("n_terms = 2").select("ask", "range", "at"))
            .unionByName(rest))
    # Bitmap r > 0 covers the ids from (r - 1) * RANGE + 1 on; the others 0 and the negative ids.
    found = both.select("ask", "range", F.explode("at").alias("bit"))
    upload = F.when(F.col("range") > 0, (F.col("range") - 1) * RANGE + F.col("bit") + 1).otherwise(F.col("range") * RANGE - F.col("bit"))
    return own.join(asks, "asked").select("request_id", "ask").join(found, "ask").select("request_id", upload.alias("upload_id"))
