"""Language-aware analysis of an index that already has its postings (U5, TX1, TX3).

Texts are not read again: the key of each posting row is analysed where the row is, and the ids of all forms
of a stem are united range by range (``analysed_postings``), with one shuffle of ids. Queries get the same
analysis. ``lexicon`` is the dictionary of distinct lexemes and their stems.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stems import analysis
from .bitmaps import build_postings, positions, search_bitmaps
from .textindex import DEFAULT_BUCKETS


def lexicon(words: DataFrame, analyse: Callable[[Column], Column], by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, lexeme, stem) for every distinct lexeme of ``words`` (and each value of ``by``).

    ``analyse`` maps an array of lexemes to the array to keep, as ``Settings.lexeme_filter`` does; a lexeme of which
    nothing stays (a stop word) has no row, one that becomes several has a row for each.
    """
    distinct = words.select(*by, "lexeme").filter(F.col("lexeme").isNotNull()).distinct()
    return distinct.select(*by, "lexeme", F.explode(F.array_distinct(analyse(F.array("lexeme")))).alias("stem"))


def analysed_postings(post: DataFrame, analyse: Callable[[Column], Column], n_buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Bitmap postings keyed by stem (``lexeme``), of bitmap postings keyed by lexeme.

    A stem whose forms a third of all images hold is as many rows as there are ranges of ids.
    """
    stems = F.explode(F.array_distinct(analyse(F.array("lexeme")))).alias("lexeme")
    return build_postings(positions(post, stems).select("lexeme", "range", F.explode("at").alias("bit")), n_buckets)


def search_analysed(requests: DataFrame, post: DataFrame, language: str, term_col: str = "processed_term",
                    cjk_bigrams: bool = True, n_buckets: int | None = None) -> DataFrame:
    """(request_id, upload_id): images that hold a form of every word of the term, stop words aside.

    ``post``: ``analysed_postings`` of the same language and the same ``cjk_bigrams``. A term of stop words alone
    matches nothing.
    """
    return search_bitmaps(requests, post, term_col, cjk_bigrams=cjk_bigrams, n_buckets=n_buckets,
                          lexeme_filter=analysis(language))
