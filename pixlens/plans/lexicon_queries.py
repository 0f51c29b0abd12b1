"""Registered queries: word forms per language, and a search by stems over texts with Han captions."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import stems
from ..functions.text import lexemes
from ..operators import bitmaps, lexicon
from ..session import scratch_table_dir
from ..sources.testforum import TestForum
from .catalog import register

HEX, HAN = "0123456789abcdef", "零一二三四五六七八九十百千万亿兆"


def _stem_sql(word: str, language: str) -> str:
    """The rules of ``stems`` as nested SQL; ``word`` is an expression."""
    if language == "de":
        word = f"translate({word}, '{stems.UMLAUTS[0]}', '{stems.UMLAUTS[1]}')"
    for rules in stems.STEPS[language]:
        whens = []
        for ending, not_after, new, shortest in rules:
            before = f"[^{not_after}]" if not_after else "."
            whens.append(f"WHEN length({word}) >= {shortest} AND regexp_full_match({word}, '(?s).*{before}{ending}') "
                         f"THEN left({word}, length({word}) - {len(ending)}) || '{new}'")
        word = f"CASE {' '.join(whens)} ELSE {word} END"
    return word


def _stops_sql(language: str) -> str:
    return ", ".join(f"'{w}'" for w in stems.STOP_WORDS[language])


_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}]+')"


@register("lexicon_stems", " UNION ALL ".join(f"""
  SELECT lang, lexeme, {_stem_sql('lexeme', g)} AS stem FROM (
    SELECT DISTINCT lang, unnest({_WORDS.format('text')}) AS lexeme FROM documents WHERE lang = '{g}') x
  WHERE lexeme NOT IN ({_stops_sql(g)})""" for g in stems.STEPS))
def lexicon_stems(spark, sf_dir):
    """Every distinct word of the documents of a language and its stem, without stop words."""
    docs = TestForum(spark, sf_dir).base("documents")
    words = docs.select("lang", F.explode(F.array_distinct(lexemes(F.col("text")))).alias("lexeme")).distinct()
    out = None
    for g in stems.STEPS:
        own = lexicon.lexicon(words.filter(F.col("lang") == g), stems.analysis(g), ("lang",))
        out = own if out is None else out.unionByName(own)
    return out


def _captions(text):
    """A stand-in for image text of two scripts: the text and a line of twelve Han characters."""
    return F.translate(F.substring(F.md5(text), 1, 12), HEX, HAN)


_CAPTION = f"translate(substr(md5(text), 1, 12), '{HEX}', '{HAN}')"
_LONGEST = f"(list_sort(list_transform({_WORDS.format('text')}, lambda w: {{'n': length(w), 'w': w}}), 'DESC')[1]).w"


@register("search_analysed", f"""
  WITH asked AS (
    SELECT item_id, {_LONGEST} AS w, substr({_CAPTION}, 3, 3) AS han FROM benchmark),
  words AS (SELECT DISTINCT upload_id, {_stem_sql('w', 'en')} AS stem FROM (
    SELECT DISTINCT doc_id AS upload_id, unnest({_WORDS.format('text')}) AS w FROM documents) x WHERE w NOT IN ({_stops_sql('en')}))
  SELECT request_id, upload_id FROM (
    SELECT item_id * 2 AS request_id, CASE WHEN right(w, 1) = 's' THEN left(w, length(w) - 1) ELSE w || 's' END AS form FROM asked) r
  JOIN words ON words.stem = {_stem_sql('form', 'en')} WHERE form NOT IN ({_stops_sql('en')})
  UNION ALL
  SELECT item_id * 2 + 1, doc_id FROM asked JOIN (SELECT doc_id, {_CAPTION} AS caption FROM documents WHERE text IS NOT NULL) d
  ON contains(caption, left(han, 2)) AND contains(caption, right(han, 2))""")
def search_analysed(spark, sf_dir):
    """Two requests per benchmark item, against the texts of all documents with a Han caption each.

    One asks for its longest word in another form (with or without a final s), one for three Han characters, which
    are looked up as two bigrams. Both go through the lexemes, the postings by stem and the bitmap search.
    """
    f = TestForum(spark, sf_dir)
    docs = f.base("documents")
    text = F.concat("text", F.lit("\n"), _captions(F.col("text")))
    index = docs.select(F.col("doc_id").alias("upload_id"), lexemes(text, cjk_bigrams=True).alias("ocr_lexemes"))
    path = scratch_table_dir(spark, f"lexicon-{uuid.uuid4().hex[:12]}")
    bitmaps.write_bitmaps(lexicon.analysed_postings(bitmaps.bitmap_postings(index), stems.analysis("en")), path)
    longest = F.array_max(F.transform(lexemes(F.col("text")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    form = F.when(F.endswith(longest, F.lit("s")), F.substring(longest, F.lit(1), F.length(longest) - 1)).otherwise(
        F.concat(longest, F.lit("s")))
    asked = f.base("benchmark").select((F.col("item_id") * 2).cast("long").alias("id"), form.alias("form"),
                                       F.substring(_captions(F.col("text")), 3, 3).alias("han"))
    requests = asked.select("id", F.posexplode(F.array("form", "han")).alias("no", "processed_term")).select(
        (F.col("id") + F.col("no")).alias("request_id"), "processed_term")
    return lexicon.search_analysed(requests, bitmaps.read_bitmaps(spark, path), "en")
