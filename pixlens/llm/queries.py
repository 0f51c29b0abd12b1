"""Registered queries of the training-data operators, one per operator, and their DuckDB oracles."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from . import bpe, chatpack, langid, linestore, mixing, ordinal, phrases, rules, suffixes, topk, vptree, warc, whiten
from .sql import ORACLE


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc(spark, sf_dir):
    manifest = warc.write_warc(read(spark, sf_dir, "pages"))
    return warc.read_warc(manifest, with_payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_topk(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.filter("vec_id % 100 = 0"))


def op3_quality(spark, sf_dir):
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.fit(documents, ordinal.grades(read(spark, sf_dir, "labels")))
    return ordinal.score(documents, model).select("doc_id", "expected_grade", "tail_probability", "keep")


def op4_simhash(spark, sf_dir):
    found = vptree.cluster(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), vptree.hex_of("fp").alias("fingerprint"), "component_id")


def op5_langid(spark, sf_dir):
    return langid.identify(read(spark, sf_dir, "pages"), langid.fit(read(spark, sf_dir, "documents")))


def op6_bpe(spark, sf_dir):
    import public_tokenizers as tokenizers

    path = tokenizers.path("byte_bpe_multi_50k.tiktoken")
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(documents, path, tokenizers.PATTERN).select("doc_id", "ids")
    return bpe.decode(ids, path).select(
        "doc_id", bpe.n_tokens("ids").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_lines(spark, sf_dir):
    kept = linestore.drop_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped",
                       F.sha2(F.coalesce("kept_text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


#: The conversation that the contract adds.
CONTROL_TURNS = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))
_CHAT = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(batches):
    import hashlib

    import pyarrow as pa

    def sha(s):
        return hashlib.sha256(s.encode("utf-8", "replace")).hexdigest()

    for b in batches:
        out = []
        for conv, text, spans in zip(*[c.to_pylist() for c in b.columns], strict=True):
            turns = chatpack.parse(text)
            loss = "".join(chatpack.unescape(text[x["from"]:x["to"]]) for x in spans)
            out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(text)))
        if out:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=[x.split()[0] for x in _CHAT.split(", ")])


def op8_chat(spark, sf_dir):
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame(list(CONTROL_TURNS), "conv_id long, turn long, role string, text string")
    segments, paths = chatpack.pack(rows.unionByName(extra))
    return chatpack.unpack(segments, paths).select("conv", "text", "loss").mapInArrow(_digests, _CHAT)


def op9_mix(spark, sf_dir):
    sized = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    mixed = mixing.mix(sized)
    return (mixed.withColumn("position", F.try_element_at("passes", F.lit(1))["time"])
            .repartitionByRange(F.coalesce("position", F.lit(2.0)), "doc_id")
            .sortWithinPartitions(F.coalesce("position", F.lit(2.0)), "doc_id")
            .select("doc_id", "size", "source_size", "target", "taken", F.round("position", 6).alias("position")))


def op10_rules(spark, sf_dir):
    documents = read(spark, sf_dir, "documents")
    return rules.judge(documents, rules.load_references(rules.references(documents)))


def op11_suffixes(spark, sf_dir):
    kept = suffixes.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op12_phrases(spark, sf_dir):
    return phrases.collocations(read(spark, sf_dir, "documents").select("lang", "text"))


def op13_whiten(spark, sf_dir):
    return whiten.whiten(read(spark, sf_dir, "embeddings"))


OPERATORS = (op1_warc, op2_topk, op3_quality, op4_simhash, op5_langid, op6_bpe, op7_lines, op8_chat, op9_mix, op10_rules,
             op11_suffixes, op12_phrases, op13_whiten)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def shipped(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship_package(spark)
            return fn(spark, sf_dir)
        return run
    return {fn.__name__: shipped(fn) for fn in OPERATORS}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
