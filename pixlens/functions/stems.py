"""Word forms per language: stop words and light stemming of plural and case endings.

Built-in expressions only, so that an analysis runs on the JVM wherever lexemes do.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. A rule is (ending, letters that must not stand before it, replacement, shortest word); of the rules
# of one step the first that holds is applied. English: the published "S" rules for plurals.
STEPS = {
    "en": [[("ies", "ea", "y", 4), ("es", "aeo", "e", 4), ("s", "us", "", 4)]],
    "fr": [[("aux", "", "al", 6), ("x", "", "", 6), ("s", "s", "", 6)], [("e", "", "", 6), ("é", "", "", 6)]],
    "de": [[("nen", "", "", 7), ("en", "", "", 6), ("se", "", "", 6), ("es", "", "", 6), ("er", "", "", 6),
            ("n", "", "", 5), ("e", "", "", 5), ("s", "s", "", 5), ("r", "", "", 5)]],
    "es": [[("ces", "", "z", 5), ("es", "aeo", "", 5), ("s", "s", "", 5)], [("o", "", "", 5), ("a", "", "", 5), ("e", "", "", 5)]],
}
STOP_WORDS = {
    "en": "a an and are as at be by for from in is it of on or that the this to was were with".split(),
    "fr": "à au aux ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une".split(),
    "de": "an auf das dem den der des die ein eine er es für im in ist mit nicht sie und von zu".split(),
    "es": "a al con de del el en es la las lo los no o para por que se su un una y".split(),
}
UMLAUTS = ("äöü", "aou")


def _step(word: Column, rules) -> Column:
    out = None
    for ending, not_after, replacement, shortest in rules:
        begin = F.substring(word, F.lit(1), F.length(word) - len(ending))
        holds = F.endswith(word, F.lit(ending)) & (F.length(word) >= shortest)
        for letter in not_after:
            holds = holds & ~F.endswith(begin, F.lit(letter))
        out = (F if out is None else out).when(holds, F.concat(begin, F.lit(replacement)))
    return out.otherwise(word)


def stem(word: Column, language: str) -> Column:
    """The stem of a lower-case word; words of other scripts, short words and nulls stay as they are."""
    if language == "de":
        word = F.translate(word, *UMLAUTS)
    for rules in STEPS[language]:
        word = _step(word, rules)
    return word


def is_stop_word(word: Column, language: str) -> Column:
    return word.isin(STOP_WORDS[language])


def analysis(language: str) -> Callable[[Column], Column]:
    """A ``lexeme_filter``: the stems of the lexemes that are no stop words, in order."""
    return lambda words: F.transform(F.filter(words, lambda w: ~is_stop_word(w, language)), lambda w: stem(w, language))
