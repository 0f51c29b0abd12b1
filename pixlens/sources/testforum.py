"""The test forum: host tables derived from the driver's TPC-H-ish test data.

Every derivation is a Spark expression over the given tables, so the forum grows
with the scale factor (see FIXTURES.md section B). The DuckDB oracle builds the
same views in SQL (``pixlens.plans.oracle_views``).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import lexemes
from .tables import ForumTables

# Fixed values of the test forum.
TAG_ROWS = [(1, "automobile"), (2, "building"), (3, "furniture"), (4, "household"),
            (5, "machinery"), (6, "vip")]
SEGMENT_TAG = {"AUTOMOBILE": 1, "BUILDING": 2, "FURNITURE": 3, "HOUSEHOLD": 4, "MACHINERY": 5}
FILE_EXTENSIONS = [".jpg", ".JPEG", ".png", ".WebP", ".gif", ".png.txt"]
WATCHED_WORD_ROWS = [("erenes", "flag"), ("leaux", "flag"), ("and", "block"), ("the it", "flag"), ("qu*nz", "flag"),
                     ("!!!", "flag")]
BASE_URL = "http://forum.test"
# (request_id, method, term, image_vec_id, content type, ocr, embed, page)
REQUEST_ROWS = [
    (1, "GET", "and", None, None, None, None, 0),
    (2, "GET", "the", None, None, "true", "false", 0),
    (3, "GET", "the tags:vip,building", None, None, "true", "false", 0),
    (4, "GET", "and category:asia before:1998-01-01", None, None, "true", "false", 0),
    (5, "GET", "and #=asia", None, None, "true", "false", 0),
    (6, "GET", "topic:5", None, None, "true", "false", 0),
    (7, "GET", '"and the" @customer#000000011', None, None, "true", "false", 0),
    (8, "GET", "blue", None, None, "false", "true", 0),
    (9, "POST", None, 42, "image/png", None, None, 0),
    (10, "POST", "topic:7", 7, "image/jpeg", None, None, 0),
    (11, "GET", None, None, None, None, None, 0),
    (12, "POST", "x", 3, "text/plain", None, None, 0),
    (13, "GET", "and", None, None, "true", "true", 1),
    (14, "GET", "and category:%ia", None, None, "true", "false", 0),
    (15, "GET", "and after:notadate", None, None, "true", "false", 0),
    (16, "GET", "the #asia", None, None, "true", "false", 0),
    (17, "GET", "the #asia:china", None, None, "true", "false", 0),
    (18, "GET", "the @me", None, None, "true", "false", 0),
    (19, "GET", "the", None, None, "true", "false", 2),
    (20, "GET", "and", None, None, "true", "true", 60),
    (21, "GET", "and", None, None, "true", "true", 200000000),
    (22, "GET", "the topic:16", None, None, "true", "false", 0),
    (23, "GET", "the minpost:300", None, None, "true", "false", 0),
    (24, "GET", "and after:1997 tags:vip", None, None, "true", "true", 0),
]
REQUEST_DDL = ("request_id long, method string, term string, image_vec_id long, "
               "image_content_type string, ocr string, embed string, page long")
CURRENT_USER_ID = 11


class TestForum:
    """Lazily derived forum tables for one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")

    _BASE: dict = {}

    def base(self, name: str) -> DataFrame:
        key = (self.spark.sparkContext.applicationId, self.spark._jsparkSession.sessionUUID(), self.sf_dir, name)
        if key not in TestForum._BASE:
            TestForum._BASE[key] = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return TestForum._BASE[key]

    def n(self, name: str):
        """Row count of a table (its ids are 0..n-1): keys are spread over all of them."""
        return F.lit(self.base(name).count())

    # -- dimension-like tables ------------------------------------------------
    @cached_property
    def categories(self) -> DataFrame:
        top = self.base("region").select(
            (F.lit(100) + F.col("r_regionkey")).cast("long").alias("id"),
            F.replace(F.lower("r_name"), F.lit(" "), F.lit("-")).alias("slug"),
            F.col("r_name").alias("name"),
            F.lit(None).cast("long").alias("parent_category_id"),
            (F.col("r_regionkey") == 4).alias("read_restricted"),
        )
        sub = self.base("nation").select(
            F.col("n_nationkey").cast("long").alias("id"),
            F.lower("n_name").alias("slug"),
            F.col("n_name").alias("name"),
            (F.lit(100) + F.col("n_regionkey")).cast("long").alias("parent_category_id"),
            (F.col("n_nationkey") % 10 == 9).alias("read_restricted"),
        )
        # A subcategory with a top-level category's slug.
        twin = self.spark.createDataFrame([(300, "asia", "Asia in Europe", 103, False)],
                                          "id long, slug string, name string, parent_category_id long, read_restricted boolean")
        return top.unionByName(sub).unionByName(twin)

    @cached_property
    def users(self) -> DataFrame:
        return self.base("customer").select(
            F.col("c_custkey").alias("id"), F.col("c_name").alias("username"),
            F.lower("c_name").alias("username_lower"), (F.col("c_custkey") % 30 == 7).alias("staged"))

    @cached_property
    def topics(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.base("customer").select(
            c.alias("id"),
            F.when(c % 50 == 0, None).otherwise(F.col("c_nationkey")).cast("long").alias("category_id"),
            (c % 20 != 3).alias("visible"),
            F.when(c % 25 == 1, "private_message").otherwise("regular").alias("archetype"),
            F.col("c_name").alias("title"))

    @cached_property
    def tags(self) -> DataFrame:
        return self.spark.createDataFrame(TAG_ROWS, "id long, name string")

    @cached_property
    def topic_tags(self) -> DataFrame:
        cust = self.base("customer")
        seg = F.col("c_mktsegment")
        tag = F.lit(None).cast("long")
        for name, tid in SEGMENT_TAG.items():
            tag = F.when(seg == name, F.lit(tid).cast("long")).otherwise(tag)
        by_segment = cust.select(F.col("c_custkey").alias("topic_id"), tag.alias("tag_id"))
        vip = cust.filter(F.col("c_acctbal") > 5000).select(
            F.col("c_custkey").alias("topic_id"), F.lit(6).cast("long").alias("tag_id"))
        return by_segment.unionByName(vip)

    @cached_property
    def watched_words(self) -> DataFrame:
        return self.spark.createDataFrame(WATCHED_WORD_ROWS, "word string, action string")

    # -- fact-like tables -----------------------------------------------------
    @cached_property
    def posts(self) -> DataFrame:
        k = F.col("o_orderkey")
        w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
        return self.base("orders").select(
            k.alias("id"), F.col("o_custkey").alias("topic_id"), ((k * 7) % self.n("customer")).alias("user_id"),
            F.row_number().over(w).cast("long").alias("post_number"),
            F.col("o_orderdate").alias("created_at"),
            F.when(k % 17 == 0, F.col("o_orderdate")).alias("deleted_at"),
            F.concat(F.lit("/t/"), F.col("o_custkey").cast("string"), F.lit("/"),
                     k.cast("string")).alias("url"))

    @cached_property
    def uploads(self) -> DataFrame:
        d = F.col("doc_id")
        ext = F.element_at(F.array(*[F.lit(e) for e in FILE_EXTENSIONS]), (d % 6 + 1).cast("int"))
        fname = F.concat(F.lit("img"), d.cast("string"), ext)
        # Uploads that are gone leave their links and index rows behind.
        return self.base("documents").filter(d % 41 != 40).select(
            d.alias("id"),
            F.when(d % 2 == 0, F.md5(d.cast("string"))).otherwise(F.md5("text")).alias("sha1"),
            F.when(d % 2 == 0, F.md5("text")).alias("original_sha1"),
            F.concat(F.lit("/uploads/"), fname).alias("url"),
            (d % 8 == 5).alias("secure"),
            F.lower(F.regexp_extract(fname, r"\.([^.]+)$", 1)).alias("extension"),
            fname.alias("original_filename"),
            (F.col("n_chars") * 600).alias("filesize"),
            (F.lit(60) + (d * 37) % 400).alias("width"),
            F.when(d % 31 == 0, None).otherwise(F.lit(60) + (d * 53) % 400).cast("long").alias("height"))

    @cached_property
    def upload_files(self) -> DataFrame:
        """Stand-in for the upload store: the document text is the file content."""
        return self.base("documents").select(F.col("doc_id").alias("upload_id"),
                                             F.encode("text", "UTF-8").alias("content"))

    @cached_property
    def post_uploads(self) -> DataFrame:
        return self.base("lineitem").select(
            F.col("l_orderkey").alias("post_id"), F.col("l_partkey").alias("upload_id")).distinct()

    @cached_property
    def index(self) -> DataFrame:
        """Whether a row has a text or a vector is known before the join: who asks only for that shuffles neither."""
        d = F.col("doc_id")
        ocr = F.when(d % 7 == 3, None).when(d % 7 == 5, "").otherwise(F.col("text"))
        docs = self.base("documents").filter(d % 5 != 4).select("doc_id", "text", ocr.isNotNull().alias("_has_text"))
        emb = self.base("embeddings").select("vec_id", "embedding", F.col("embedding").isNotNull().alias("_has_vector"))

        def none(of):
            return F.array().cast(of)

        return docs.join(emb, F.col("vec_id") == d, "left").select(
            d.alias("upload_id"), F.md5("text").alias("sha1"), F.when(F.col("_has_text"), F.coalesce(ocr, F.lit(""))).alias("ocr_text"),
            F.when(F.col("_has_text"), F.coalesce(lexemes(ocr), none("array<string>"))).alias("ocr_lexemes"),
            F.when((d % 11 != 5) & F.col("_has_vector"), F.coalesce("embedding", none("array<float>"))).alias("embeddings"),
            F.when(d % 13 == 1, 4).otherwise(0).cast("int").alias("retry_times"))

    @cached_property
    def indexed_texts(self) -> DataFrame:
        """(upload_id, ocr_lexemes) of ``index``, for what takes each word of an image once: no vector is joined."""
        d = F.col("doc_id")
        ocr = F.when(d % 7 == 3, None).when(d % 7 == 5, "").otherwise(F.col("text"))
        return self.base("documents").filter(d % 5 != 4).select(d.alias("upload_id"), lexemes(ocr).alias("ocr_lexemes"))

    @cached_property
    def custom_emojis(self) -> DataFrame:
        ids = self.base("documents").filter(F.col("doc_id") % 97 == 0).select(F.col("doc_id").alias("upload_id"))
        return ids.unionByName(self.spark.createDataFrame([(None,)], "upload_id long"))

    @cached_property
    def optimized_images(self) -> DataFrame:
        d = F.col("doc_id")
        k = F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("k")
        base = self.base("documents").filter(d % 4 != 0).select("doc_id", k)
        kk = F.col("k")
        return base.select(
            (d * 3 + kk).alias("id"), d.alias("upload_id"),
            F.concat(F.lit("/opt/"), (d * 3 + kk).cast("string"), F.lit(".png")).alias("url"),
            ((F.lit(60) + (d * 37) % 400) * kk).cast("long").alias("width"),
            ((F.lit(60) + (d * 53) % 400) * kk).cast("long").alias("height"))

    @cached_property
    def analysis_results(self) -> DataFrame:
        """What the analysis service answered, one row per upload."""
        d = F.col("d.doc_id")
        return (self.base("documents").alias("d")
                .join(self.base("embeddings").alias("e"), F.col("e.vec_id") == d, "left")
                .select(d.alias("upload_id"), F.md5(F.col("d.text")).alias("sha1"),
                        F.split(F.col("d.text"), "\n").alias("ocr_result"),
                        F.col("e.embedding").alias("embedding"), (d % 9 != 0).alias("success")))

    @cached_property
    def answers(self) -> DataFrame:
        """The service's answer per content key: that of the smallest upload with it."""
        r = self.analysis_results
        return r.join(r.groupBy("sha1").agg(F.min("upload_id").alias("upload_id")).select("upload_id"),
                      "upload_id", "left_semi")

    # -- requests, events -----------------------------------------------------
    @cached_property
    def search_requests(self) -> DataFrame:
        """The 15 hand-written requests plus one request per user turn of ``conversations``.

        The derived requests (term = the user's message; text+image search on
        even conversations, text only on odd ones) make the batch grow with the data.
        """
        r = self.spark.createDataFrame(REQUEST_ROWS, REQUEST_DDL)
        fixed = r.select(
            "request_id", "method", "term",
            F.col("image_vec_id").cast("string").alias("image_ref"),
            "image_content_type", "ocr", "embed", "page",
            F.lit(CURRENT_USER_ID).cast("long").alias("current_user_id"))
        conv = self.base("conversations").filter(F.col("role") == "user")
        derived = conv.select(
            (F.lit(1_000_000) + F.col("conv_id") * (1 << 20) + F.col("turn")).cast("long").alias("request_id"),
            F.lit("GET").alias("method"), F.col("text").alias("term"),
            F.lit(None).cast("string").alias("image_ref"), F.lit(None).cast("string").alias("image_content_type"),
            F.lit("true").alias("ocr"),
            F.when(F.col("conv_id") % 2 == 0, "true").otherwise("false").alias("embed"),
            F.lit(0).cast("long").alias("page"), F.lit(CURRENT_USER_ID).cast("long").alias("current_user_id"))
        return fixed.unionByName(derived)

    @cached_property
    def request_embeddings(self) -> DataFrame:
        """The stub embedder's answers: a vector per request (text or image)."""
        r = self.search_requests.select(
            "request_id",
            F.coalesce(F.col("image_ref").cast("long"), (F.col("request_id") * 17) % self.n("embeddings")).alias("vec_id"))
        return r.join(self.base("embeddings"), "vec_id").select("request_id", F.col("embedding").alias("qvec"))

    @cached_property
    def post_events(self) -> DataFrame:
        e = self.base("events")
        return e.select(
            "event_id", F.col("ts").cast("timestamp").alias("ts"),
            ((F.col("event_id") * 13) % self.n("orders")).alias("post_id"),
            F.when(F.col("event_type").isin("view", "click"), "rebake").otherwise("create").alias("kind"))

    @cached_property
    def post_cooked(self) -> DataFrame:
        o = self.base("orders").select("o_orderkey")
        p = self.base("pages").select("page_id", "html")
        return o.join(p, p.page_id == o.o_orderkey % self.n("pages")).select(
            F.col("o_orderkey").alias("post_id"),
            F.when(F.col("o_orderkey") % 3 == 0, F.replace("html", F.lit('class="ad"'), F.lit('class="ad lightbox-wrapper"')))
            .when(F.col("o_orderkey") % 3 == 1, F.replace("html", F.lit("<article>"), F.lit("<article class='onebox'><img>")))
            .otherwise(F.col("html")).alias("cooked"))

    def tables(self) -> ForumTables:
        return ForumTables(
            posts=self.posts, topics=self.topics, categories=self.categories, tags=self.tags,
            topic_tags=self.topic_tags, users=self.users, uploads=self.uploads,
            post_uploads=self.post_uploads, custom_emojis=self.custom_emojis,
            optimized_images=self.optimized_images, watched_words=self.watched_words,
            index=self.index)
