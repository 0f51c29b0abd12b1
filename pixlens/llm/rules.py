"""Quality rules: distribution divergence of a document from its language's references.

Two histograms describe a text: characters by class (lower and upper case, digits, blanks, sentence
marks, symbols, letters beyond ASCII, others) and words (one bin for each of the language's ``n_words``
commonest words, one for all other words). The references of a language are computed from all its
documents by grouped aggregation: the sums of the documents' class histograms and of their words' shares,
so that every document counts alike, however long. A document is compared with the references of its declared
language, or with every language when that one has no reference, and the smallest Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) counts. A language label with fewer than
``min_documents`` documents of ``MIN_WORDS`` words or more is no reference, as its documents would be
compared with little more than themselves; when no label has as many, all are references.

Verdict of the method: a document of at least ``min_chars`` characters fails when its class distance
is above ``max_class_distance``; one of at least ``min_words`` words fails when its word distance is
above ``max_word_distance``. Shorter documents say too little and pass the respective test.

The base rules come first: fewer than 50 words, or more than half of the words in repeated 3-word
windows, fails.

Defined cases: a null text has no words, no lines with words and zero counts; a document without any
reference has null distances and passes the method; ties between common words go to the smaller word;
extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, byte_slices, materialize

#: The symbols of the base rules.
SYMBOLS = "#*$%&|<>"
BASE_MIN_WORDS = 50

N_WORDS = 64
MIN_CHARS = 200
MIN_WORDS = 50
MAX_CLASS_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.43
MIN_DOCUMENTS = 20
MAX_LANGUAGES = 1000
UNIT = 1_000_000

CLASSES = ("lower", "upper", "digit", "blank", "sentence", "symbol", "letter_beyond_ascii", "other")


def _class_table():
    import unicodedata

    import numpy as np

    table = np.full(0x10000, 7, dtype=np.uint8)
    for cp in range(0x10000):
        c = chr(cp)
        if c in BLANKS:
            table[cp] = 3
        elif cp < 128:
            table[cp] = (0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit()
                         else 4 if c in ".,;:!?'\"()-" else 5 if cp > 32 else 7)
        elif unicodedata.category(c)[0] == "L":
            table[cp] = 6
    return table


def class_counts(text: str, table) -> list[int]:
    """Characters of each class; code points beyond the basic plane count as other."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le", "replace"), dtype="<u4")
    return np.bincount(table[np.minimum(codes, 0xFFFF)], minlength=len(CLASSES)).tolist()


def _key(word: str) -> str:
    return word.lower().strip(".,;:!?'\"()")


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    words = text.encode("utf-8", "replace").split()  # bytes: splits at the ASCII blanks only
    n = len(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    symbols = sum(map(text.count, SYMBOLS))
    seen, dups = set(), 0
    for line in text.split("\n"):
        if line.strip(BLANKS):
            if line in seen:
                dups += 1
            seen.add(line)
    repeats = 0
    if n >= 3:
        windows = list(zip(words, words[1:], words[2:]))
        count = Counter(windows)
        if len(count) < len(windows):
            upto = 0
            for i, w in enumerate(windows):
                if count[w] > 1:
                    repeats += i + 3 - max(i, upto)
                    upto = i + 3
    return n, chars, symbols, dups, repeats


def js_distance(p, q) -> float:
    """Jensen-Shannon distance of two histograms (any positive totals), in [0, 1]."""
    import math

    sp, sq, d = math.fsum(p), math.fsum(q), 0.0
    if not sp or not sq:
        return 1.0 if sp != sq else 0.0
    for a, b in zip(p, q, strict=True):
        a, b = a / sp, b / sq
        m = (a + b) / 2
        if a:
            d += a * math.log2(a / m)
        if b:
            d += b * math.log2(b / m)
    return math.sqrt(max(0.0, min(1.0, d / 2)))


def _corpus_counts(batches):
    """Per task: summed word shares and class histograms by language (each batch sends its own sums)."""
    import numpy as np
    import pyarrow as pa

    table = _class_table()
    for b in batches:
        for part in byte_slices(b, 1, 32 << 20):
            counts: dict = {}
            shares: dict = {}
            long: Counter = Counter()
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                if lang is None or not text:
                    continue
                # Whole millionths: sums do not depend on the order of the rows.
                sums, own = counts.setdefault(lang, {}), Counter(map(_key, text.split()))
                long[lang] += own.total() >= MIN_WORDS
                unit = UNIT / max(1, own.total())
                for w, n in own.items():
                    sums[w] = sums.get(w, 0) + int(n * unit + 0.5)
                h = np.array(class_counts(text, table), dtype=np.float64)
                shares[lang] = shares.get(lang, 0) + np.rint(h / h.sum() * UNIT).astype(np.int64)
            rows = [(lang, "w:" + w, n) for lang, c in counts.items() for w, n in c.items()]
            rows += [(lang, "t", sum(c.values())) for lang, c in counts.items()]
            rows += [(lang, "d", n) for lang, n in long.items()]
            rows += [(lang, f"c:{k}", int(v)) for lang, h in shares.items() for k, v in enumerate(h)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()),
                 pa.array([r[2] for r in rows], pa.int64())], names=["lang", "item", "n"])


def references(documents: DataFrame, n_words: int = N_WORDS) -> DataFrame:
    """(lang, item, n): words of largest share ('w:...'), all words ('t'), classes ('c:i'), long documents ('d')."""
    counted = (documents.select("lang", "text").mapInArrow(_corpus_counts, "lang string, item string, n long")
               .groupBy("lang", "item").agg(F.sum("n").alias("n"))
               .withColumn("kind", F.substring("item", 1, 1)))
    # The window's limit is applied by each task before its rows move.
    ranks = Window.partitionBy("lang", "kind").orderBy(F.desc("n"), "item")
    return (counted.withColumn("rn", F.row_number().over(ranks)).filter(F.col("rn") <= max(n_words, len(CLASSES)))
            .filter((F.col("kind") != "w") | (F.col("rn") <= n_words)).select("lang", "item", "n"))


def load_references(refs: DataFrame, max_languages: int = MAX_LANGUAGES, min_documents: int = MIN_DOCUMENTS) -> dict:
    """References with enough documents as a dict; n_words + 10 rows a language. More languages than the bound raise."""
    refs = materialize(refs, "rules-references")
    known = refs.filter((F.col("item") == "d") & (F.col("n") >= min_documents)).select("lang")
    if not known.isEmpty():
        refs = refs.join(known, "lang", "left_semi")
    if refs.select("lang").distinct().count() > max_languages:
        raise ValueError(f"more than {max_languages} languages; raise max_languages")
    rows, out = refs.collect(), {}
    for lang, item, n in rows:
        ref = out.setdefault(lang, {"words": {}, "rest": 0, "classes": [0] * len(CLASSES)})
        if item == "t":
            ref["rest"] += n
        elif item == "d":
            ref["documents"] = n
        elif item.startswith("c:"):
            ref["classes"][int(item[2:])] = n
        else:
            ref["words"][item[2:]] = n
            ref["rest"] -= n
    for ref in out.values():
        ref["words"] = dict(sorted(ref["words"].items()))
    return out


def distances(text: str, lang, refs: dict, table, counts=None) -> tuple:
    """(class distance, word distance) to the declared language, or to the nearest one without it."""
    near = [refs[lang]] if lang in refs else list(refs.values())
    if not near:
        return None, None
    classes = class_counts(text, table)
    own = Counter(map(_key, text.split())) if counts is None else counts
    total = sum(own.values())

    def words(ref):
        h = [own.get(w, 0) for w in ref["words"]]
        return js_distance([*h, total - sum(h)], [*ref["words"].values(), ref["rest"]])

    return min(js_distance(classes, r["classes"]) for r in near), min(map(words, near))


SCHEMA = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
          "base_failed boolean, kept boolean, class_distance double, word_distance double")


def _judge(refs, min_chars, min_words, max_class, max_word):
    def run(batches):
        import pyarrow as pa

        known, table = refs.value, _class_table()
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.float64()] * 2
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        for b in batches:
            for part in byte_slices(b, 2):
                out = []
                for doc, lang, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                    text = text or ""
                    n, chars, symbols, dups, repeats = base_counts(text)
                    failed = n < BASE_MIN_WORDS or 100 * repeats > 50 * n
                    dc, dw = distances(text, lang, known, table)
                    off = (dc is not None and (len(text) >= min_chars and dc > max_class
                                               or n >= min_words and dw > max_word))
                    out.append((doc, n, chars, symbols, dups, repeats, failed, not failed and not off, dc, dw))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
    return run


def judge(documents: DataFrame, refs: dict, min_chars: int = MIN_CHARS, min_words: int = MIN_WORDS,
          max_class_distance: float = MAX_CLASS_DISTANCE, max_word_distance: float = MAX_WORD_DISTANCE) -> DataFrame:
    """One verdict row per document; ``refs`` is bounded by languages x words."""
    shared = documents.sparkSession.sparkContext.broadcast(refs)
    return (documents.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", "text")
            .mapInArrow(_judge(shared, min_chars, min_words, max_class_distance, max_word_distance), SCHEMA))
