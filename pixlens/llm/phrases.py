"""Phrase collocations from a prefix-free parse of the word sequences.

1. *Parse*: every piece of a text is cut before each trigger word (a word whose hash is divisible by
   ``TRIGGER``; after ``MAX_CORE`` words without one a cut is forced). A chunk is the words up to the
   next cut, its core, and the ``max_words - 1`` words after it. Equal chunks are one entry of the
   dictionary with the number of times the parse uses it.
2. *Count*: n-grams are counted inside distinct chunks only, weighted by that number. An n-gram counts
   in the chunk whose core holds its first word; the overlap behind the core completes it. So each
   occurrence is counted once, also those across a cut.
3. Words and pairs are first counted by 64-bit hash. Hashes with too few occurrences cannot stand for a
   phrase that is asked for, so a bitmap of the others (at most ``MAX_BITS`` bits, whatever the corpus)
   says which n-grams are counted as text. A fuller bitmap lets more of them through and changes no result.
4. Scores use 38-digit decimals and integer division.

Defined cases: a null language is ``und``, a null text is empty; texts without words add nothing; repeated
rows and documents count as often as they stand; ids are not read; words of any length are kept whole; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import ascii_lower, bitmap_of, bitmap_test, byte_slices, gathered, materialize

TRIGGER = 12
MAX_CORE = 64
MAX_BITS = 1 << 28  # 32 MB
MIN_COUNT, MAX_WORDS, TOP, HELD_SHARE = 10, 3, 2000, 50
SLICE_BYTES = 16 << 20

#: Characters that end a piece ([.,;:!?\x0A-\x0D]); blanks between words are space and tab.
PIECE_ENDS = r"[.,;:!?\x0A-\x0D]"


def _words(texts):
    """(word ids, dictionary, row of each word) of the blank-separated words of an Arrow string array."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    lists = pc.split_pattern(texts, " ")
    row = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    values = lists.flatten()
    full = pc.not_equal(values, "")
    coded = values.filter(full).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    return (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary,
            row[full.to_numpy(zero_copy_only=False)])


def _hashes(strings):
    import numpy as np
    import xxhash

    return np.array([xxhash.xxh64_intdigest(s.as_buffer(), 42) for s in strings], dtype=np.uint64)


def parse(texts, max_words: int = MAX_WORDS):
    """(row, core, chunk) arrays of lower-cased Arrow texts."""
    import numpy as np
    import pyarrow as pa
    import pyarrow.compute as pc

    marked = pc.replace_substring_regex(pc.replace_substring(texts, "\t", " "), PIECE_ENDS, " \n ")
    ids, words, row = _words(marked)
    end = pc.index(words, pa.scalar("\n", words.type)).as_py()
    is_end = ids == end
    piece = np.cumsum(is_end)[~is_end]
    ids, row = ids[~is_end], row[~is_end]
    n = len(ids)
    if not n:
        return row, row, pa.array([], pa.string())
    first = np.ones(n, dtype=bool)
    first[1:] = (piece[1:] != piece[:-1]) | (row[1:] != row[:-1])
    at = np.arange(n)
    cut = first | ((_hashes(words) % np.uint64(TRIGGER) == 0)[ids])
    cut |= (at - np.maximum.accumulate(np.where(cut, at, 0))) % MAX_CORE == 0
    starts, pieces = at[cut], np.append(at[first], n)
    stops = np.append(starts[1:], n)
    last = np.minimum(stops + max_words - 1, pieces[np.searchsorted(pieces, starts, side="right")])
    sizes = last - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    take = np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), words.take(pa.array(ids[take])))
    return row[starts], stops - starts, pc.binary_join(lists, " ")


def dictionary(docs: DataFrame, lang: Column | None = None, max_words: int = MAX_WORDS) -> DataFrame:
    """(lang, core, chunk, times): distinct chunks of all texts."""
    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for b in byte_slices(whole, 1):
                row, core, chunk = parse(b.column(1), max_words)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(core, pa.int32()), chunk],
                                                 names=["lang", "core", "chunk"])

    lang = F.col("lang") if lang is None else lang
    texts = docs.select(F.coalesce(lang.cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(ascii_lower(F.col("text")), F.lit("")).alias("text"))
    return (texts.mapInArrow(cut, "lang string, core int, chunk string")
            .groupBy("lang", "core", "chunk").agg(F.count("*").alias("times")))


class Grams:
    """The words of a batch of dictionary rows, numbered per language, and where n-grams may start."""

    def __init__(self, batch):
        import numpy as np

        chunk, core, times = batch.column(2), batch.column(1).to_numpy(), batch.column(3).to_numpy()
        ids, self.words, row = _words(chunk)
        langs = batch.column(0).dictionary_encode()
        self.langs = langs.dictionary
        of_row = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        width = max(len(self.words), 1)
        key, self.id = np.unique(of_row[row] * width + ids, return_inverse=True)
        self.word, self.lang = key % width, key // width
        size = np.bincount(row, minlength=len(chunk))
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        self.left = (size[row] - place)               # words from here to the end of the chunk
        self.start = place < core[row]
        self.weight = times[row]
        lang_hash = _hashes(self.langs)
        with np.errstate(over="ignore"):
            self.hash = mix(_hashes(self.words)[self.word] + lang_hash[self.lang] * np.uint64(0x9E3779B97F4A7C15))

    def starts(self, words: int):
        import numpy as np

        return np.nonzero(self.start & (self.left >= words))[0]

    def one(self):
        return self.hash[self.id]

    def two(self):
        """Hash of the pair that starts at each word (the last has none)."""
        import numpy as np

        h = self.one()
        with np.errstate(over="ignore"):
            return mix(h[:-1] * np.uint64(0xD6E8FEB86659FD93) + h[1:])


def mix(h):
    import numpy as np

    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return h ^ (h >> np.uint64(29))


def _sum_by(key, weight):
    """(distinct keys, summed weights, an index of each)."""
    import numpy as np

    if not len(key):
        return key, weight, np.zeros(0, dtype=np.int64)
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.nonzero(np.append(True, k[1:] != k[:-1]))[0]
    return k[at], np.add.reduceat(weight[order], at), order[at]


def frequent_bits(chunks: DataFrame, min_count: int, max_bits: int = MAX_BITS) -> tuple[int, bytes]:
    """(log2 of the size, bitmap) of the hashes of words and pairs found at least ``min_count`` times."""
    def count(batches):
        import numpy as np
        import pyarrow as pa

        # Joined batches: a phrase found in many of them is handed on once per batch.
        for whole in gathered(batches, 2, SLICE_BYTES):
            for b in byte_slices(whole, 2, SLICE_BYTES):
                g = Grams(b)
                one, two = g.starts(1), g.starts(2)
                h, n, _ = _sum_by(np.concatenate([g.one()[one], g.two()[two]]),
                                  np.concatenate([g.weight[one], g.weight[two]]))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    often = materialize(chunks.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
                        .filter(F.col("n") >= min_count).select("h"), "phrases-frequent")
    return bitmap_of(often, max_bits)


def counts(chunks: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(lang, words, phrase, f) of all phrases of up to ``max_words`` words with ``f >= min_count``."""
    often = bitmap_test(chunks.sparkSession, *frequent_bits(chunks, min_count, max_bits))

    def count(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        # Joined batches: a phrase found in many of them is handed on once per batch.
        for whole in gathered(batches, 2, SLICE_BYTES):
            for b in byte_slices(whole, 2, SLICE_BYTES):
                g = Grams(b)
                one, pair = often(g.one()), np.append(often(g.two()), False)
                width = max(len(g.word), 1)
                found, key = [], g.id
                for n in range(1, max_words + 1):
                    at = g.starts(n)
                    if n == 1:
                        at = at[one[at]]
                    else:
                        for k in range(n - 1):
                            at = at[pair[at + k]]
                    if n <= 3:
                        dense = g.id[at] if n == 1 else (np.unique(key[at], return_inverse=True)[1] * width + g.id[at + n - 1])
                    else:
                        dense = np.unique(np.stack([g.id[at + k] for k in range(n)]), axis=1, return_inverse=True)[1].reshape(-1)
                    _, f, where = _sum_by(dense, g.weight[at])
                    here = at[where]
                    parts = [g.words.take(pa.array(g.word[g.id[here + k]])) for k in range(n)]
                    phrase = parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")
                    found.append((g.langs.take(pa.array(g.lang[g.id[here]])), pa.array(np.full(len(here), n, dtype=np.int32)),
                                  phrase, pa.array(f)))
                    if n == 2:
                        key = np.zeros(len(g.id), dtype=np.int64)
                        pairs = g.id[:-1] * width + g.id[1:]
                        key[:-1] = np.unique(pairs, return_inverse=True)[1]
                for columns in found:
                    yield pa.RecordBatch.from_arrays(list(columns), names=["lang", "words", "phrase", "f"])

    return (chunks.mapInArrow(count, "lang string, words int, phrase string, f long")
            .groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= min_count))


def _inside(words: Column, n: Column) -> Column:
    """All contiguous phrases of two words or more inside ``words`` (``n`` of them) that are shorter."""
    return F.flatten(F.transform(F.sequence(F.lit(2), n - 1), lambda k: F.transform(
        F.sequence(F.lit(1), n - k + 1), lambda i: F.array_join(F.slice(words, i, k), " "))))


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, max_words: int = MAX_WORDS, top: int = TOP,
                 held_share: int = HELD_SHARE, max_bits: int = MAX_BITS) -> DataFrame:
    """The ``top`` phrases of each language: lang, rank, phrase, a, l, r, n, score."""
    chunks = materialize(dictionary(docs, max_words=max_words), "phrases-chunks")
    f = materialize(counts(chunks, min_count, max_words, max_bits), "phrases-counts")
    longer = f.filter("words > 2").select(
        "lang", F.explode(_inside(F.split("phrase", " "), F.col("words"))).alias("phrase"), "f")
    most = longer.groupBy("lang", "phrase").agg(F.max("f").alias("held"))
    kept = (f.filter("words >= 2").join(most, ["lang", "phrase"], "left")
            .filter(F.col("held").isNull() | (F.col("held").cast("decimal(38,0)") * 100 < F.col("f").cast("decimal(38,0)") * held_share)))
    words = F.split("phrase", " ")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), F.explode(F.transform(
        F.sequence(F.lit(1), F.col("words") - 1), lambda k: F.struct(
            k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("head"),
            F.array_join(F.slice(words, k + 1, F.col("words")), " ").alias("tail")))).alias("cut")).select(
        "lang", "phrase", "a", "cut.*")
    heads = f.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    tails = f.select("lang", F.col("phrase").alias("tail"), F.col("f").alias("r"))
    wide = "cast({} as decimal(38,0))".format
    score = F.expr(f"cast({wide('a')} * {wide('a')} * {wide('1000000')} as decimal(38,0)) div cast({wide('l')} * {wide('r')} as decimal(38,0))")
    scored = (cuts.join(heads, ["lang", "head"]).join(tails, ["lang", "tail"])
              .select("lang", "phrase", "a", F.struct(score.alias("score"), "k", "l", "r").alias("low"))
              .groupBy("lang", "phrase", "a").agg(F.min("low").alias("low")).select("lang", "phrase", "a", "low.*"))
    # Ranks follow from a range sort of all languages together: no task holds a whole language.
    placed = dense_index(scored, [F.col("lang"), F.desc("score"), F.desc("a"), F.col("phrase")], name="place")
    first = placed.groupBy("lang").agg(F.min("place").alias("first"))
    best = (placed.join(first, "lang").withColumn("rank", F.col("place") - F.col("first") + 1)
            .filter(F.col("rank") <= top))
    total = chunks.groupBy("lang").agg(F.sum(F.col("core") * F.col("times")).alias("n"))
    return best.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n",
                                           F.col("score").cast("long").alias("score"))
