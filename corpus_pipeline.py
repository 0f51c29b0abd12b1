"""The corpus pipeline: five stages over the documents table, each calling one operator.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; the driver writes it as Parquet and reads
it again as the next stage's docs. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixlens.llm import bpe, linestore, mixing, ordinal, vptree
from pixlens.llm.common import materialize, set_aside
from pixlens.session import ship_package


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose probability of the highest grade is too low go; a null text is judged as empty."""
    ship_package(spark)
    rated = ordinal.grades(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    model = ordinal.fit(docs.select("doc_id", "text"), rated)
    rows, back = set_aside(docs, ("expected_grade", "tail_probability", "keep"))
    return ordinal.score(rows, model).filter("keep").select(*back)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines shared by three documents or more stay in the one with the largest id; n_chars follows the text."""
    ship_package(spark)
    rows, back = set_aside(docs, ("n_lines", "n_dropped", "kept_text"))
    kept = linestore.drop_shared_lines(rows)
    changed = F.col("n_dropped") > 0
    kept = kept.withColumn("text", F.when(changed, F.col("kept_text")).otherwise(F.col("text")))
    if "n_chars" in rows.columns:
        length = F.length("kept_text").cast(rows.schema["n_chars"].dataType)
        kept = kept.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return kept.select(*back)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies the row with the smallest id stays, then text; rows without id all stay."""
    ship_package(spark)
    key = F.coalesce(F.md5("text"), F.lit(""))
    found = vptree.members(docs, key=key).filter("id = component_id")
    stay = materialize(found.select(F.col("id").alias("__low"), F.col("key").alias("__of"), F.col("root").alias("__root"))
                       .distinct(), "pipeline-stay")
    # An id may stand in several components: rows meet theirs by id and text.
    known = (docs.filter("doc_id IS NOT NULL").withColumn("__id", F.col("doc_id").cast("long")).withColumn("__key", key)
             .join(stay, (F.col("__id") == F.col("__low")) & (F.col("__key") == F.col("__of"))))
    one = Window.partitionBy("__root").orderBy(F.col("text").asc_nulls_last())
    kept = known.withColumn("__rn", F.row_number().over(one)).filter("__rn = 1")
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id IS NULL"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, once for each pass of the mix that takes words of them."""
    ship_package(spark)
    rows, back = set_aside(docs, ("size", "source_size", "target", "taken", "passes", "position"))
    mixed = mixing.mix(rows.withColumn("size", mixing.size_of(F.col("text"))), tie=F.xxhash64("text"))
    return mixing.training_order(mixed).select(*back)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document (little-endian 32-bit integers) in place of its text."""
    import public_tokenizers as tokenizers

    ship_package(spark)
    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ids = bpe.encode(docs.select("doc_id", "source", "text"), path, tokenizers.PATTERN)
    return ids.select("doc_id", "source", bpe.n_tokens("ids").alias("n_tokens"), "ids")


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix_sources", mix_sources),
          ("tokenize", tokenize)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier cannot be expressed in SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None
