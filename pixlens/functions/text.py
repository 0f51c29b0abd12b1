"""Column functions for text: lexemes, query tokens, blank tests, OCR joins.

All are built-in Spark expressions (JVM side, no Python per row).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns.
WORD_PATTERN = r"[\p{L}\p{N}]+"
HAN_RUN = r"\p{IsHan}+"
# Query-string tokenizer: a run of non-space, non-quote characters, optionally
# followed by one quoted phrase.
QUERY_TOKEN_PATTERN = '([^" \\t\\n\\x0B\\f\\r]+)?("[^"]+")?'


def lexemes(text: Column | str, cjk_bigrams: bool = False,
            lexeme_filter: Callable[[Column], Column] | None = None) -> Column:
    """Searchable lexemes of a text, in order, duplicates kept (positions matter).

    NULL text gives NULL; empty text gives an empty array (OCR ran, no text).
    With ``cjk_bigrams`` a run of Han characters is indexed as overlapping
    bigrams (a single Han character stays a unigram) instead of one token.
    ``lexeme_filter`` maps the array to the lexemes to keep (stop words, stems).
    """
    if lexeme_filter is not None:
        return lexeme_filter(lexemes(text, cjk_bigrams))
    t = F.lower(F.col(text) if isinstance(text, str) else text)
    if not cjk_bigrams:
        return F.regexp_extract_all(t, F.lit(WORD_PATTERN), 0)
    runs = F.regexp_extract_all(t, F.lit(r"\p{IsHan}+|[\p{L}\p{N}&&[^\p{IsHan}]]+"), 0)
    bigrams = lambda x: F.transform(F.sequence(F.lit(1), F.length(x) - 1), lambda i: F.substring(x, i, F.lit(2)))
    return F.flatten(F.transform(runs, lambda x: F.when(x.rlike(HAN_RUN) & (F.length(x) > 1), bigrams(x)).otherwise(F.array(x))))


def query_terms(term: Column, cjk_bigrams: bool = False,
                lexeme_filter: Callable[[Column], Column] | None = None) -> Column:
    """Distinct lexemes of a query: AND of all of them is the match rule."""
    return F.array_distinct(lexemes(term, cjk_bigrams, lexeme_filter))


def query_tokens(term: Column) -> Column:
    """Split a search term into words and quoted phrases, dropping empties."""
    toks = F.regexp_extract_all(F.coalesce(term, F.lit("")), F.lit(QUERY_TOKEN_PATTERN), 0)
    return F.filter(toks, lambda x: F.length(F.trim(x)) > 0)


def is_blank(c: Column) -> Column:
    """NULL or whitespace-only."""
    return F.length(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")) == 0


def join_lines(lines: Column) -> Column:
    """OCR lines joined with newline; NULL items become empty lines."""
    return F.array_join(lines, "\n", "")
