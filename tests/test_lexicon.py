"""Stems and stop words per language, postings keyed by stem, and a search by other forms and by Han text."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pixlens.functions import stems
from pixlens.functions.text import lexemes
from pixlens.operators import bitmaps, lexicon

CASES = {
    "en": {"queries": "query", "houses": "house", "cats": "cat", "glass": "glass", "corpus": "corpus", "gas": "gas", "is": "is", "as": "as",
           "movies": "movy", "shoes": "shoe", "zombaies": "zombaie", "s": "s", "": "", "图片": "图片", "2020s": "2020"},
    "fr": {"chevaux": "cheval", "bateaux": "bateal", "maisons": "maison", "grande": "grand", "mots": "mots", "étés": "étés"},
    "de": {"häuser": "haus", "frauen": "frau", "lehrerinnen": "lehrerin", "klasse": "klas", "tag": "tag", "fluss": "fluss"},
    "es": {"luces": "luz", "casas": "casa", "casa": "casa", "ciudades": "ciudad", "sol": "sol", "hermanos": "herman", "hermana": "herman"},
}


@pytest.mark.parametrize("language", list(CASES))
def test_stems(spark, language):
    rows = spark.createDataFrame([(w, ) for w in [*CASES[language], None]], "w string")
    got = {r.w: r.s for r in rows.select("w", stems.stem(F.col("w"), language).alias("s")).collect()}
    assert got == CASES[language] | {None: None}


def test_analysis_keeps_order_and_drops_stop_words(spark):
    got = spark.range(1).select(stems.analysis("en")(lexemes(F.lit("The cats of the 图片搜索 houses"), True))).first()[0]
    assert got == ["cat", "图片", "片搜", "搜索", "house"]


TEXTS = [(1, "Cats in houses"), (2, "a cat"), (3, "the house of glass"), (4, None), (5, ""), (6, "中文图片搜索 cats"),
         (40_000, "CAT houses"), (-3, "cat"), (1, "Cats in houses")]


def postings(spark, texts):
    t = spark.createDataFrame(texts, "upload_id long, ocr_text string")
    index = t.withColumn("ocr_lexemes", lexemes("ocr_text", True))
    post = bitmaps.bitmap_postings(index)
    return lexicon.analysed_postings(post, stems.analysis("en"))


@pytest.mark.parametrize("term, want", [
    ("cat", {1, 2, 6, 40_000, -3}), ("cats", {1, 2, 6, 40_000, -3}), ("houses the cat", {1, 40_000}), ("house", {1, 3, 40_000}),
    ("图片", {6}), ("图片搜索 cat", {6}), ("片图", set()), ("the of", set()), ("", set()), (None, set()), ("dog", set())])
def test_search_by_other_forms(spark, term, want):
    asked = spark.createDataFrame([(7, term)], "request_id long, processed_term string")
    got = [r.upload_id for r in lexicon.search_analysed(asked, postings(spark, TEXTS), "en").collect()]
    assert set(got) == want and len(got) == len(want)


def test_no_texts(spark):
    asked = spark.createDataFrame([(7, "cat")], "request_id long, processed_term string")
    assert lexicon.search_analysed(asked, postings(spark, [(1, None)]), "en").collect() == []


def test_equal_to_postings_of_analysed_texts(spark):
    """Uniting the postings gives what analysing every text gives."""
    t = spark.createDataFrame(TEXTS, "upload_id long, ocr_text string")
    direct = bitmaps.bitmap_postings(t.withColumn("ocr_lexemes", lexemes("ocr_text", True, stems.analysis("en"))))
    rows = lambda p: sorted((r.bucket, r.lexeme, r.range, r.n, bytes(r.bits)) for r in p.collect())
    assert rows(postings(spark, TEXTS)) == rows(direct)


def test_lexicon_has_a_row_per_distinct_word(spark):
    words = spark.createDataFrame([("cats",), ("cat",), ("cats",), ("the",), (None,), ("",)], "lexeme string")
    got = sorted((r.lexeme, r.stem) for r in lexicon.lexicon(words, stems.analysis("en")).collect())
    assert got == [("", ""), ("cat", "cat"), ("cats", "cat")]
