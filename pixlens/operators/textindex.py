"""OCR text index: lexemes, posting table, boolean AND match (TX1-TX4).

The posting table plays the role of an inverted (GIN) index: one row per
(lexeme, upload) with positions. Stored with a ``bucket = pmod(hash(lexeme), N)``
partition column, a join on (bucket, lexeme) against the broadcast request
terms lets dynamic partition pruning read only the buckets the batch needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lexemes, query_terms
from ..session import materialize

DEFAULT_BUCKETS = 64


def lexeme_rows(index: DataFrame) -> DataFrame:
    """TX1 flat form: (upload_id, position 1-based, lexeme)."""
    return index.filter(F.col("ocr_lexemes").isNotNull()).select(
        "upload_id", F.posexplode("ocr_lexemes").alias("pos", "lexeme")).select(
        "upload_id", (F.col("pos") + 1).alias("position"), "lexeme")


def with_bucket(df: DataFrame, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    return df.withColumn("bucket", F.pmod(F.xxhash64("lexeme"), F.lit(n_buckets)).cast("int"))


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used: an array of one item binds it to a name."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entries(lex: Column) -> Column:
    """(lexeme, positions) of each distinct lexeme of an array, by one sort of the array."""
    placed = F.sort_array(F.transform(lex, lambda x, i: F.struct(x.alias("lexeme"), (i + 1).alias("pos"))))

    def runs(s):
        n = F.size(s)
        begins = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | ~F.get(s, i - 1)["lexeme"].eqNullSafe(F.get(s, i - 2)["lexeme"]))
        return _bound(begins, lambda b: F.transform(b, lambda i, j: F.struct(
            F.get(s, i - 1)["lexeme"].alias("lexeme"),
            F.transform(F.slice(s, i, F.coalesce(F.get(b, j + 1), n + 1) - i), lambda x: x["pos"]).alias("positions"))))

    return _bound(placed, lambda s: F.when(F.size(s) > 0, runs(s)))


def postings(index: DataFrame, n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """TX2: (bucket, lexeme, upload_id, positions).

    The lexemes of a row are grouped within the row: neither texts nor exploded words are
    shuffled or sorted across rows. Only the rows of an upload that stands in several, found
    by its id beforehand, are grouped by (upload_id, lexeme).
    """
    docs = index.filter(F.col("ocr_lexemes").isNotNull()).select("upload_id", "ocr_lexemes")
    again = materialize(docs.groupBy("upload_id").agg(F.count("*").alias("n")).filter("n > 1").select("upload_id"), "postings-again")

    def once(of):
        return of.select("upload_id", F.inline(_entries(F.col("ocr_lexemes"))))

    if again.isEmpty():  # the texts are read once
        grouped = once(docs)
    else:
        same = F.col("upload_id").eqNullSafe(F.col("again"))
        again = again.withColumnRenamed("upload_id", "again")
        rows = docs.join(again, same, "left_semi").select("upload_id", F.posexplode("ocr_lexemes").alias("pos", "lexeme"))
        grouped = once(docs.join(again, same, "left_anti")).unionByName(rows.groupBy("upload_id", "lexeme").agg(
            F.array_sort(F.collect_list(F.col("pos") + 1)).alias("positions")))
    return with_bucket(grouped, n_buckets).select(
        "bucket", "lexeme", "upload_id", "positions", F.lit(n_buckets).cast("int").alias("n_buckets"))


def write_postings(post: DataFrame, path: str, salt: int = 8) -> None:
    """Persist the posting table partitioned by lexeme bucket.

    A bucket is written by ``salt`` tasks that share it by upload id, so a lexeme
    that a third of all images hold is not in one task.
    """
    part = F.pmod(F.xxhash64("upload_id"), F.lit(salt))
    post.repartition("bucket", part).write.mode("overwrite").partitionBy("bucket").parquet(path)


def read_postings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def request_terms(requests: DataFrame, term_col: str = "processed_term", cjk_bigrams: bool = False,
                  n_buckets: int = DEFAULT_BUCKETS, lexeme_filter=None) -> DataFrame:
    """TX3: (request_id, lexeme, n_terms, bucket) for every request with terms."""
    t = requests.select("request_id", query_terms(F.col(term_col), cjk_bigrams, lexeme_filter).alias("terms"))
    t = t.filter(F.size("terms") > 0).select(
        "request_id", F.size("terms").alias("n_terms"), F.explode("terms").alias("lexeme"))
    return with_bucket(t, n_buckets)


def search_images_ocr(requests: DataFrame, post: DataFrame, term_col: str = "processed_term",
                      cjk_bigrams: bool = False, n_buckets: int | None = None, lexeme_filter=None) -> DataFrame:
    """TX4: (request_id, upload_id) where the image text holds every query lexeme.

    Each distinct set of words is solved once, rarest word first: the images of
    its least frequent lexeme are the candidates, these meet the second lexeme
    (equi-join on (bucket, lexeme, upload_id)), and only what is left meets all
    others. The whole posting table is read and shuffled once at most, for the
    rows of the batch's words. Blank terms and NULL or empty lexeme sets never
    match. The bucket count is read from the posting table (one row) unless given.
    """
    if n_buckets is None:
        first = post.select("n_buckets").limit(1).collect() if "n_buckets" in post.columns else []
        n_buckets = int(first[0][0]) if first else DEFAULT_BUCKETS
    words = F.array_sort(query_terms(F.col(term_col), cjk_bigrams, lexeme_filter))
    own = requests.select("request_id", F.array_join(words, " ").alias("asked")).filter(F.col("asked") != "")
    asks = materialize(own.select("asked").distinct().withColumn("ask", F.monotonically_increasing_id()), "search-asks")
    terms = with_bucket(asks.select("ask", F.split("asked", " ").alias("terms")).select(
        "ask", F.size("terms").alias("n_terms"), F.explode("terms").alias("lexeme")), n_buckets)
    # A number stands for a word from here on: what follows shuffles and sorts pairs of numbers.
    asked = materialize(terms.select("bucket", "lexeme").distinct().withColumn("word", F.monotonically_increasing_id()), "search-words")
    # Hashed by the words asked for, which are few in each partition: the postings are not sorted to meet them.
    p = materialize(post.select("bucket", "lexeme", "upload_id").join(asked.hint("shuffle_hash"), ["bucket", "lexeme"])
                    .select("word", "upload_id", "lexeme"), "search-postings")
    p = p.select("word", "upload_id")
    df = p.groupBy("word").agg(F.count("*").alias("df"))
    # Sets of words that all occur, with their words in order of the number of images.
    order = (terms.join(asked.join(df, "word"), ["bucket", "lexeme"]).groupBy("ask", "n_terms")
             .agg(F.array_sort(F.collect_list(F.struct("df", "lexeme", "word"))).alias("order"))
             .filter(F.size("order") == F.col("n_terms")))
    order = materialize(order.select("ask", "n_terms", F.posexplode("order").alias("no", "x")).select(
        "ask", "n_terms", "no", "x.word"), "search-order")

    def lead(of):
        return of.filter("no = 0").join(p, "word").select("ask", "upload_id")

    def held(cands, of):
        return cands.join(of, "ask").join(p, ["word", "upload_id"]).select("ask", "n_terms", "upload_id")

    second = materialize(held(lead(order.filter("n_terms > 1")), order.filter("no = 1")), "search-second")
    rest = held(second.filter("n_terms > 2").drop("n_terms"), order.filter("no > 1"))
    rest = rest.groupBy("ask", "n_terms", "upload_id").agg(F.count("*").alias("n")).filter(F.col("n") == F.col("n_terms") - 2)
    # Few terms are one word: as a table of their own they meet the postings without a shuffle of these.
    single = lead(materialize(order.filter("n_terms = 1"), "search-single"))
    found = (single.unionByName(second.filter("n_terms = 2").select("ask", "upload_id"))
             .unionByName(rest.select("ask", "upload_id")))
    return own.join(asks, "asked").select("request_id", "ask").join(found, "ask").select("request_id", "upload_id")


def search_images_ocr_scan(requests: DataFrame, index: DataFrame, term_col: str = "processed_term",
                           cjk_bigrams: bool = False, lexeme_filter=None) -> DataFrame:
    """TX4 without a posting table: the stored lexeme arrays of the index are
    de-duplicated per image and probed against the (broadcast) request terms.
    No shuffle of the index; one hash aggregate on (request, image) matches.
    """
    terms = request_terms(requests, term_col, cjk_bigrams, lexeme_filter=lexeme_filter).drop("bucket")
    lex = index.filter(F.col("ocr_lexemes").isNotNull()).select(
        "upload_id", F.explode(F.array_distinct("ocr_lexemes")).alias("lexeme"))
    hits = lex.join(terms, "lexeme")
    counted = hits.groupBy("request_id", "upload_id").agg(
        F.count("lexeme").alias("n_hit"), F.first("n_terms").alias("n_terms"))
    return counted.filter(F.col("n_hit") == F.col("n_terms")).select("request_id", "upload_id")


def index_lexemes(ocr_text_col: str = "ocr_text", cjk_bigrams: bool = False, lexeme_filter=None):
    """The lexeme column written with every index row (NULL iff text is NULL)."""
    return lexemes(F.col(ocr_text_col), cjk_bigrams, lexeme_filter)
