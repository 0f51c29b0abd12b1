"""Removal of repeated byte strings by the common-prefix interval tree of an enhanced suffix array.

The suffix array is built in shards that hold all occurrences of a string of ``min_bytes`` bytes together:

1. *Anchors*: every window of ``min_bytes`` bytes belongs to its minimizer, the leftmost string of ``GRAM``
   bytes in it with the smallest hash. Equal windows have equal minimizers. The windows of one minimizer in
   one place form a context (their bytes, ``min_bytes`` to ``2 * min_bytes - GRAM``). A first pass over the
   texts counts minimizers; a bitmap (at most ``MAX_BITS`` bits) of those that occur twice lets the second
   pass drop the contexts that cannot hold a repeat. A fuller bitmap lets more through and changes no result.
2. *Classes*: equal contexts are one class; all of its members but the first repeat the first as a whole. The
   members in one batch of texts are settled where they are read, so a class sends one row per batch to the
   shuffle. Only first members of minimizers with several classes go on.
3. *Suffix array*: the contexts of some minimizers are one text. The suffixes that start at its windows are
   sorted, neighbours give common prefix lengths, and a scan with a stack finds the intervals of the prefix
   tree of ``min_bytes`` bytes and more. An interval whose occurrences have different bytes on the left (or
   start a context) is a maximal repeat; all of its occurrences are one group, not only neighbours.
4. A minimizer with more than ``MAX_CONTEXTS`` classes (a passage with as many different borders) is split by
   a longer anchor, the window itself: windows are counted into classes like contexts in step 2, which
   settles them, since different windows share no string of that length.

A repeat that is longer than a context is found as overlapping groups, one for each anchor in it; their spans
are joined per document. Earlier means smaller id (a null id last; rows of one id by the hash of their
text), then earlier start.

Defined cases: null texts are empty; texts shorter than ``min_bytes`` lose nothing; rows with the same id and
text are one document and give equal rows; matches never cross documents; an empty table gives no rows;
long texts are read in overlapping runs; other columns are kept under their names.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import bitmap_of, bitmap_test, byte_slices, materialize, set_aside

MIN_BYTES = 100
GRAM = 32
MAX_CONTEXTS = 4096
MAX_BITS = 1 << 28  # 32 MB
RUN_BYTES = 1 << 18
SLICE_BYTES = 32 << 20
LAST_ID = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1


# ------------------------------------------------------------------ anchors
def _mix(h):
    import numpy as np

    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _power(n: int):
    import numpy as np

    return np.uint64(pow(_BASE, n, 1 << 64))


class Rolling:
    """Polynomial hashes (mod 2**64) of strings of any length inside ``data``, by doubling."""

    def __init__(self, data, longest: int):
        import numpy as np

        self.of = {1: _mix(data.astype(np.uint64) * np.uint64(0xA0761D6478BD642F) + np.uint64(0xE7037ED1A0B428DB))}
        size = 1
        while 2 * size <= longest and 2 * size <= len(data):
            h = self.of[size]
            self.of[2 * size] = h[:-size] * _power(size) + h[size:]
            size *= 2

    def at(self, places, length: int):
        import numpy as np

        out, done = np.zeros(len(places), dtype=np.uint64), 0
        for size in sorted(self.of, reverse=True):
            while length - done >= size:
                out = out * _power(size) + self.of[size][places + done]
                done += size
        return out


def _runs(offsets, min_bytes: int, run_bytes: int):
    """Stretches (from, to) of bytes that hold every window: several short texts, or a part of a long one."""
    start = i = 0
    n = len(offsets) - 1
    while i < n:
        start = j = i
        while j < n and offsets[j + 1] - offsets[start] <= run_bytes:
            j += 1
        if j > i:
            yield offsets[start], offsets[j]
            i = j
        else:
            a, b = offsets[i], offsets[i + 1]
            for x in range(a, max(b - min_bytes + 1, a + 1), run_bytes):
                yield x, min(b, x + run_bytes + min_bytes - 1)
            i += 1


def anchors(data, offsets, min_bytes: int = MIN_BYTES, gram: int = GRAM, run_bytes: int = RUN_BYTES):
    """(text number, first window, windows, minimizer, context) arrays; ``offsets`` bound the texts in ``data``."""
    import numpy as np

    out = []
    for a, b in _runs(offsets.tolist(), min_bytes, run_bytes):
        if b - a < min_bytes:
            continue
        part = data[a:b]
        with np.errstate(over="ignore"):
            rolling = Rolling(part, min_bytes)
            if gram in rolling.of:
                grams = _mix(rolling.of[gram])
            else:
                grams = _mix(rolling.at(np.arange(len(part) - gram + 1), gram))
        low = grams & ~np.uint64(0xFFFFFFFF) | np.arange(len(grams), dtype=np.uint64)
        span, have = min_bytes - gram + 1, 1
        while have < span:
            step = min(have, span - have)
            low = np.minimum(low[:-step], low[step:])
            have += step
        place = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
        # Windows of the texts that lie in this stretch.
        first = max(int(np.searchsorted(offsets, a, side="right")) - 1, 0)
        last = int(np.searchsorted(offsets, b, side="left"))
        bounds = np.clip(offsets[first:last + 1], a, b) - a
        start, stop = bounds[:-1], np.maximum(bounds[1:] - min_bytes + 1, bounds[:-1])
        edge = np.zeros(len(place) + 1, dtype=np.int32)
        full = stop > start
        np.add.at(edge, start[full], 1)
        np.add.at(edge, stop[full], -1)
        inside = np.cumsum(edge[:-1]) > 0
        new = inside.copy()
        new[1:] &= (place[1:] != place[:-1]) | ~inside[:-1]
        new[start[full]] = True
        at = np.nonzero(new)[0]
        text = np.searchsorted(bounds, at, side="right") - 1
        # Empty texts share a bound with the next one, which "right" skips to.
        end = np.minimum(np.append(at[1:], len(place)), bounds[text + 1] - min_bytes + 1)
        n = end - at
        with np.errstate(over="ignore"):
            ctx = _mix(rolling.at(at, min_bytes) * _power(7) + rolling.at(end - 1, min_bytes)
                       + (n.astype(np.uint64) << np.uint64(32)) + (place[at] - at).astype(np.uint64))
            m = _mix(grams[place[at]])  # minimizers are small hashes; mixed again they spread evenly
        out.append((text + first, at + a - offsets[text + first], n, m, ctx))
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def _bytes_of(texts):
    """(bytes, offsets) of an Arrow string array without nulls."""
    import numpy as np

    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    if texts.buffers()[2] is None:
        return np.zeros(0, dtype=np.uint8), offsets * 0
    return np.frombuffer(texts.buffers()[2], dtype=np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``doc``, a document's place in the order.

    It is the id (a null one last); where an id stands with different texts, documents are numbered by id
    and then by the hash of the text.
    """
    keyed = docs.withColumn("doc", F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)))
    tie = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    ids = keyed.select("doc", tie.alias("tie"))
    if ids.groupBy("doc").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).filter("a <> b").isEmpty():
        return keyed
    order = materialize(dense_index(ids.distinct(), ["doc", "tie"], name="place"), "suffix-order")
    return (keyed.withColumn("tie", tie).join(order, ["doc", "tie"]).drop("doc", "tie").withColumnRenamed("place", "doc"))


def _repeated_grams(texts: DataFrame, min_bytes: int, max_bits: int) -> tuple[int, bytes]:
    def count(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for b in byte_slices(whole, 0, SLICE_BYTES):
                m, n = np.unique(anchors(*_bytes_of(b.column(0)), min_bytes)[3], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(m.view(np.int64)), pa.array(n > 1)], names=["m", "more"])

    found = (texts.select("text").mapInArrow(count, "m long, more boolean").groupBy("m")
             .agg(F.count("*").alias("n"), F.max("more").alias("more")).filter("n > 1 OR more"))
    return bitmap_of(materialize(found.select(F.col("m").alias("h")), "suffix-grams"), max_bits)


CONTEXT = "doc long, at long, n int, m long, ctx long, later boolean"


def settle(doc, at, n, m, ctx, merge: bool):
    """Contexts of a batch with ``later``: members of a class after the first one of the batch.

    Repeated rows count once. With ``merge``, neighbouring later contexts of a document become one.
    """
    import numpy as np

    order = np.lexsort((at, doc, ctx, m))
    doc, at, n, m, ctx = (c[order] for c in (doc, at, n, m, ctx))
    if not len(m):
        return doc, at, n, m, ctx, np.zeros(0, dtype=bool)
    new = np.append(True, (m[1:] != m[:-1]) | (ctx[1:] != ctx[:-1]))
    same = np.append(False, (doc[1:] == doc[:-1]) & (at[1:] == at[:-1])) & ~new
    doc, at, n, m, ctx, later = (c[~same] for c in (doc, at, n, m, ctx, ~new))
    if not merge:
        return doc, at, n, m, ctx, later
    gone = np.nonzero(later)[0]
    gone = gone[np.lexsort((at[gone], doc[gone]))]
    if len(gone):
        d, a, z = doc[gone], at[gone], at[gone] + n[gone]
        first = np.append(True, (d[1:] != d[:-1]) | (a[1:] != z[:-1]))
        stop = np.append(np.nonzero(first)[0][1:], len(gone)) - 1
        d, a, z = d[first], a[first], z[stop]
    else:
        d = a = z = gone
    none = np.zeros(len(d), dtype=m.dtype)
    parts = ((doc, d), (at, a), (n, z - a), (m, none), (ctx, none), (later, np.ones(len(d), dtype=bool)))
    return tuple(np.concatenate([c[~later], x]) for c, x in parts)


def contexts(texts: DataFrame, min_bytes: int = MIN_BYTES, max_bits: int = MAX_BITS, merge: bool = False) -> DataFrame:
    """Contexts (doc, at, n, m, ctx, later) of the minimizers that occur at least twice."""
    test = bitmap_test(texts.sparkSession, *_repeated_grams(texts, min_bytes, max_bits))

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for whole in batches:
            for b in byte_slices(whole, 1, SLICE_BYTES):
                text, at, n, m, ctx = anchors(*_bytes_of(b.column(1)), min_bytes)
                keep = test(m)
                doc = b.column(0).to_numpy()[text[keep]]
                doc, at, n, m, ctx, later = settle(doc, at[keep], n[keep], m[keep].view(np.int64), ctx[keep].view(np.int64), merge)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc), pa.array(at), pa.array(n.astype(np.int32)), pa.array(m), pa.array(ctx), pa.array(later)],
                    names=[c.split()[0] for c in CONTEXT.split(", ")])
    return texts.mapInArrow(cut, CONTEXT)


# ------------------------------------------------------------- suffix array
def suffix_array(data, starts, ends):
    """(order of the suffixes, common prefix length of each with the one before; 0 for the first)."""
    import numpy as np

    size = ends - starts
    width = int(size.max())
    padded = np.concatenate([data, np.zeros(width, dtype=np.uint8)])
    by_size = np.argsort(size, kind="stable")  # a prefix sorts before the longer string, also one that ends in zero bytes
    rows = np.lib.stride_tricks.sliding_window_view(padded, width)[starts[by_size]]
    rows[np.arange(width)[None, :] >= size[by_size][:, None]] = 0
    order = np.argsort(rows.view(f"S{width}").reshape(-1), kind="stable")
    rows, order = rows[order], by_size[order]
    differ = rows[1:] != rows[:-1]
    lcp = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    return order, np.append(0, np.minimum(lcp, np.minimum(size[order][1:], size[order][:-1])))


def intervals(lcp, left, rank, min_bytes: int):
    """Maximal repeats (length, from, to, first) of a suffix array.

    ``left`` is the byte before each suffix, or a negative number of its own where a context starts; ``rank``
    its place in document order; ``from`` to ``to`` (inclusive) are the suffixes of the interval and ``first``
    the smallest rank among them.
    """
    import numpy as np

    found = []
    linked = np.append(lcp[1:] >= min_bytes, False)
    starts = np.nonzero(linked & ~np.append(False, linked[:-1]))[0]
    stops = np.nonzero(~linked & np.append(False, linked[:-1]))[0]
    for a, b in zip(starts.tolist(), stops.tolist(), strict=True):
        heights, before, order = lcp[a:b + 1].tolist(), left[a:b + 1].tolist(), rank[a:b + 1].tolist()
        # A node is [height, first suffix, smallest rank, left byte or None once bytes differ].
        stack: list[list] = []
        for i in range(b - a + 2):
            height = heights[i] if 0 < i <= b - a else 0
            node = [None, i - 1, order[i - 1], before[i - 1]] if i else None
            while stack and stack[-1][0] > height:
                top = stack.pop()
                if node is not None:
                    _join(top, node)
                if top[3] is None:
                    found.append((top[0], a + top[1], a + i - 1, top[2]))
                node = top
            if height >= min_bytes:
                if stack and stack[-1][0] == height:
                    _join(stack[-1], node)
                else:
                    stack.append([height, node[1], node[2], node[3]])
    return found


def _join(parent: list, child: list) -> None:
    if child[2] < parent[2]:
        parent[2] = child[2]
    if child[3] != parent[3]:
        parent[3] = None


def scan(rows, min_bytes: int = MIN_BYTES):
    """Maximal repeats of contexts ``(doc, at, n, bytes)``, and the occurrences in the order of the suffix array.

    Repeats are those of ``intervals``; an occurrence is a context number, a window in it and its rank.
    """
    import numpy as np

    n = np.array([r[2] for r in rows])
    size = np.array([len(r[3]) for r in rows])
    data = np.frombuffer(b"".join(r[3] for r in rows), dtype=np.uint8)
    base = np.cumsum(size) - size
    of = np.repeat(np.arange(len(rows)), n)
    window = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    starts = base[of] + window
    order, lcp = suffix_array(data, starts, (base + size)[of])
    left = np.where(window == 0, -1 - np.arange(len(of)), data[np.maximum(starts - 1, 0)])
    doc, at = (np.array([r[k] for r in rows], dtype=np.int64)[of] for k in range(2))
    at = at + window
    by = np.lexsort((at, doc))
    new = np.zeros(len(by), dtype=np.int64)
    new[1:] = (doc[by][1:] != doc[by][:-1]) | (at[by][1:] != at[by][:-1])
    rank = np.zeros(len(by), dtype=np.int64)
    rank[by] = np.cumsum(new)  # repeated rows are one document and share their ranks
    return intervals(lcp, left[order], rank[order], min_bytes), of[order], window[order], rank[order]


def _buckets(batches, most: int):
    """Lists of contexts (m, doc, at, n, bytes) that hold whole buckets of ``m``, about ``most`` contexts each."""
    held = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if len(held) >= most and held[-1][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


BUCKET_ROWS = "m long, doc long, at long, n int, bytes binary"
SPAN = "doc long, at long, until long"
GROUP = "first_doc long, first_at long, length long, doc long, at long"


def _spans_of(min_bytes: int, most: int):
    """Spans that an earlier occurrence covers: of each window the longest repeat in which it is not the first."""
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for held in _buckets(batches, most):
            rows = [r[1:] for r in held]
            found, of, window, rank = scan(rows, min_bytes)
            longest = np.zeros(len(of), dtype=np.int64)
            for length, a, b, first in found:
                later = rank[a:b + 1] != first
                longest[a:b + 1] = np.maximum(longest[a:b + 1], later * length)
            hit = np.nonzero(longest)[0]
            at = np.array([r[1] for r in rows])[of[hit]] + window[hit]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.array([r[0] for r in rows])[of[hit]], pa.int64()), pa.array(at, pa.int64()),
                 pa.array(at + longest[hit], pa.int64())], names=["doc", "at", "until"])
    return run


def _groups_of(min_bytes: int, most: int):
    """All occurrences of each maximal repeat; a group is named by its first occurrence and its length."""
    def run(batches):
        import pyarrow as pa

        for held in _buckets(batches, most):
            rows = [r[1:] for r in held]
            found, of, window, rank = scan(rows, min_bytes)
            for length, a, b, first in found:
                here = [(rows[c][0], rows[c][1] + w) for c, w in zip(of[a:b + 1].tolist(), window[a:b + 1].tolist(), strict=True)]
                head = here[int((rank[a:b + 1] == first).argmax())]
                columns = [*([x] * len(here) for x in (*head, length)), *zip(*here, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in columns],
                                                 names=[c.split()[0] for c in GROUP.split(", ")])
    return run


# ------------------------------------------------------------------- tables
class Repeats:
    """The contexts of a corpus (doc, text), their classes and the buckets of the suffix arrays.

    ``merge`` keeps no classes of the contexts that were settled where they were read; spans need none.
    """

    def __init__(self, texts: DataFrame, min_bytes: int = MIN_BYTES, max_contexts: int = MAX_CONTEXTS, max_bits: int = MAX_BITS,
                 merge: bool = False):
        if min_bytes < GRAM:
            raise ValueError(f"repeats have {GRAM} bytes or more")
        self.texts, self.min_bytes, self.max_contexts, self.max_bits = texts, min_bytes, max_contexts, max_bits
        self.contexts = materialize(contexts(texts, min_bytes, max_bits, merge), "suffix-contexts")
        kept = self.contexts.filter("NOT later")
        classes = kept.groupBy("m", "ctx").agg(F.min("doc").alias("first"), F.count("*").alias("times"))
        classes = materialize(classes, "suffix-classes")
        of = classes.groupBy("m").agg(F.count("*").alias("n_classes"))
        several = classes.join(of, "m").filter("times > 1 OR n_classes > 1")
        self.members = materialize(kept.join(several, ["m", "ctx"]).select("doc", "at", "n", "m", "ctx", "first", "n_classes"),
                                   "suffix-members")
        self.cut = materialize(self._cut(self.members.filter("doc = first AND n_classes > 1")), "suffix-buckets")

    def _cut(self, firsts: DataFrame) -> DataFrame:
        """First members of classes with their bytes."""
        at = materialize(firsts.groupBy("doc").agg(F.collect_list(F.struct("m", "at", "n", "n_classes")).alias("places")),
                         "suffix-places")
        texts = self.texts.filter(_may_be_in(self.texts.sparkSession, at, self.max_bits))
        min_bytes = self.min_bytes

        def cut(batches):
            import pyarrow as pa

            for whole in batches:
                for b in byte_slices(whole, 1):
                    out = []
                    for doc, text, places in zip(*[c.to_pylist() for c in b.columns], strict=True):
                        text = text.encode("utf-8", "surrogatepass")
                        out += [(p["m"], doc, p["at"], p["n"], text[p["at"]:p["at"] + p["n"] + min_bytes - 1], p["n_classes"])
                                for p in places]
                    if out:
                        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                            names=["m", "doc", "at", "n", "bytes", "n_classes"])
        return texts.join(at, "doc").select("doc", "text", "places").mapInArrow(cut, BUCKET_ROWS + ", n_classes long")

    def _scanned(self, run, schema: str) -> DataFrame:
        rows = self.cut.filter(F.col("n_classes") <= self.max_contexts).drop("n_classes")
        return rows.repartition("m").sortWithinPartitions("m").mapInArrow(run(self.min_bytes, min(self.max_contexts, 2048)), schema)

    def _windows(self) -> tuple[DataFrame, DataFrame]:
        """The windows of minimizers with very many classes, by hash: (m, w, doc, at), and their repeated classes."""
        min_bytes = self.min_bytes

        def spread(batches):
            import numpy as np
            import pyarrow as pa

            for b in batches:
                for m, doc, at, n, text in zip(*[c.to_pylist() for c in b.columns], strict=True):
                    with np.errstate(over="ignore"):
                        h = _mix(Rolling(np.frombuffer(text, dtype=np.uint8), min_bytes).at(np.arange(n), min_bytes))
                    yield pa.RecordBatch.from_arrays(
                        [*(pa.array([x] * n, pa.int64()) for x in (m, doc)), pa.array(at + np.arange(n)), pa.array(h.view(np.int64))],
                        names=["m", "doc", "at", "w"])
        hot = self.cut.filter(F.col("n_classes") > self.max_contexts).drop("n_classes")
        # A document may hold a window twice: the first of them is found before the first document.
        windows = materialize(hot.mapInArrow(spread, "m long, doc long, at long, w long"), "suffix-windows")
        by_doc = windows.groupBy("m", "w", "doc").agg(F.min("at").alias("low"), F.countDistinct("at").alias("times"))
        again = (by_doc.groupBy("m", "w").agg(F.min("doc").alias("first"), F.sum("times").alias("times")).filter("times > 1")
                 .drop("times"))
        first_at = again.join(by_doc.select("m", "w", F.col("doc").alias("first"), F.col("low").alias("first_at")), ["m", "w", "first"])
        return windows, first_at

    def spans(self) -> DataFrame:
        """(doc, at, until): every byte that an earlier occurrence covers lies in one of a document's spans."""
        until = (F.col("at") + F.col("n") + (self.min_bytes - 1)).alias("until")
        here = self.contexts.filter("later").select("doc", "at", until)
        members = self.members.filter("doc <> first").select("doc", "at", until)
        scanned = self._scanned(_spans_of, SPAN)
        windows, again = self._windows()
        later = (windows.join(again, ["m", "w"]).filter("doc <> first OR at <> first_at")
                 .select("doc", "at", (F.col("at") + self.min_bytes).alias("until")))
        return here.unionByName(members).unionByName(scanned).unionByName(later)

    def groups(self) -> DataFrame:
        """Maximal repeats with all occurrences: the first occurrence, the length, and each occurrence.

        Needs ``merge=False``. The scan gives the groups of first members; a class with several members is a
        group of its own, as is a window of a minimizer with very many classes.
        """
        scanned = self._scanned(_groups_of, GROUP)
        length = (F.col("n") + (self.min_bytes - 1)).cast("long").alias("length")
        classes = self.contexts.groupBy("m", "ctx").agg(F.min(F.struct("doc", "at")).alias("one"), F.count("*").alias("times"))
        whole = self.contexts.join(classes.filter("times > 1"), ["m", "ctx"]).select(
            F.col("one.doc").alias("first_doc"), F.col("one.at").alias("first_at"), length, "doc", "at")
        windows, again = self._windows()
        hot = windows.join(again, ["m", "w"]).select(
            F.col("first").alias("first_doc"), "first_at", F.lit(self.min_bytes).cast("long").alias("length"), "doc", "at")
        return scanned.unionByName(whole).unionByName(hot).distinct()


def _may_be_in(spark, places: DataFrame, max_bits: int) -> Column:
    """Whether a document may be named in ``places`` (doc), so that a join need not move the other texts."""
    test = bitmap_test(spark, *bitmap_of(places.select(F.xxhash64("doc").alias("h")), max_bits))

    @F.pandas_udf("boolean")
    def known(h: pd.Series) -> pd.Series:
        import numpy as np

        return pd.Series(test(h.to_numpy().view(np.uint64)))
    return known(F.xxhash64("doc"))


def merged(spans, size: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by ``spans`` (at, until)."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, size)) for a, b in out]


RESULT = ("n_bytes", "n_removed", "n_spans", "kept")


def remove_repeats(documents: DataFrame, min_bytes: int = MIN_BYTES, max_contexts: int = MAX_CONTEXTS,
                   max_bits: int = MAX_BITS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``documents`` with n_bytes, n_removed, n_spans and ``kept``, the bytes that stay.

    A column of ``documents`` named like one of these gives way; all others are kept.
    """
    documents = documents.drop(*[c for c in documents.columns if c.lower() in RESULT])
    rows, back = set_aside(documents, ("doc", "tie", "place", "text_bytes", "spans", "maybe"))
    names = rows.columns
    keys = numbered(rows, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = Repeats(keys.select("doc", text.alias("text")), min_bytes, max_contexts, max_bits, merge=True)
    spans = materialize(found.spans().groupBy("doc").agg(F.collect_list(F.struct("at", "until")).alias("spans")), "suffix-spans")
    keys = keys.withColumn("text_bytes", text.cast("binary")).withColumn(
        "maybe", _may_be_in(documents.sparkSession, spans, max_bits))
    plain = keys.filter(~F.col("maybe")).select(
        *names, F.octet_length("text_bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.lit(0).cast("long").alias("n_spans"), F.col("text_bytes").alias("kept"))
    joined = keys.filter("maybe").join(spans, "doc", "left").select(*names, "spans", "text_bytes")
    at = len(names)

    def cut(batches):
        import pyarrow as pa

        for whole in batches:
            for b in byte_slices(whole, at + 1):
                out = []
                for found_in, data in zip(b.column(at).to_pylist(), b.column(at + 1).to_pylist(), strict=True):
                    gone = merged([(s["at"], s["until"]) for s in found_in or []], len(data))
                    kept, last = [], 0
                    for x, y in gone:
                        kept.append(data[last:x])
                        last = y
                    kept.append(data[last:])
                    out.append((len(data), sum(y - x for x, y in gone), len(gone), b"".join(kept)))
                columns = zip(*out, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([*b.columns[:at], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                                                 names=[*names, *RESULT])

    schema = plain.schema
    changed = joined.mapInArrow(cut, schema)
    out = plain.unionByName(changed)
    return out.select(*back, *RESULT)
