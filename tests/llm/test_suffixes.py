from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixlens.llm import suffixes

SCHEMA = "doc_id long, text string, kept string, doc int, m string, spans int"


def covered(texts, size):
    """{document: bytes that a string of ``size`` bytes covers which also starts earlier}."""
    seen, out = set(), {}
    for doc, b in texts:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            w = b[i:i + size]
            if w in seen:
                gone[i:i + size] = b"\1" * size
            seen.add(w)
        out[doc] = gone
    return out


def brute(rows, size=100):
    """Rows have distinct ids, or equal ones with equal texts."""
    texts = {}
    for i, t in rows:
        texts[i] = (t or "").encode()
    gone = covered(sorted(texts.items(), key=lambda x: (x[0] is None, x[0] or 0)), size)
    out = {}
    for i, b in texts.items():
        g = gone[i]
        spans = sum(1 for j in range(len(g)) if g[j] and (j == 0 or not g[j - 1]))
        out[i] = (len(b), sum(g), spans, bytes(x for x, y in zip(b, g) if not y))
    return out


def run(spark, rows, parts=3, **more):
    df = spark.createDataFrame([(*r, "k", 1, "m", 2) for r in rows], SCHEMA).repartition(parts)
    got = suffixes.remove_repeats(df, **more)
    assert got.columns == ["doc_id", "text", "doc", "m", "spans", "n_bytes", "n_removed", "n_spans", "kept"]
    got = got.collect()
    assert len(got) == len(rows) and all((r.doc, r.m, r.spans) == (1, "m", 2) for r in got)
    out = defaultdict(set)
    for r in got:
        out[r.doc_id].add((r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)))
    assert all(len(v) == 1 for v in out.values())
    return {k: next(iter(v)) for k, v in out.items()}


def corpus(seed=1, docs=120):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdeé") for _ in range(rnd.randint(2, 8))) for _ in range(300)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passages = [prose(k) for k in (20, 25, 40, 90)]
    out = []
    for i in range(docs):
        t = prose(rnd.randint(0, 80))
        for _ in range(rnd.choice([0, 1, 2])):
            p = rnd.choice(passages)
            at = rnd.randint(0, len(t))
            t = t[:at] + p[rnd.randint(0, 9):len(p) - rnd.randint(0, 9)] + t[at:]
        if out and rnd.random() < .3:
            t = rnd.choice(out)[1] or ""
            if rnd.random() < .6 and t:
                at = rnd.randint(0, len(t) - 1)
                t = t[:at] + rnd.choice(["X", "", "zz"]) + t[at + 1:]
        out.append((i * 3, t))
    return out


ODD = [(1000, None), (1001, ""), (1002, "a" * 99), (1003, "a" * 100), (1004, "a" * 1000), (1005, "ab" * 300), (1006, "ab" * 400),
       (1007, "\0" * 150), (1008, "\0" * 120 + "b" + "\0" * 130)]


def test_matches_brute_force(spark):
    rows = corpus()
    rows += ODD + [rows[5], rows[5], rows[7], (None, rows[9][1])]
    assert run(spark, rows) == brute(rows)


def test_hot_minimizers_are_split_by_window(spark):
    rnd = random.Random(2)
    passage = " ".join("".join(rnd.choice("abcdefgh") for _ in range(6)) for _ in range(60))
    rows = [(i, f"{rnd.random()} {i} {rnd.random()}" * 3 + passage + f"{rnd.random()} {i}" * 4) for i in range(90)]
    want = brute(rows)
    assert run(spark, rows, max_contexts=8) == want
    assert run(spark, rows) == want


def test_full_bitmap_and_other_lengths(spark):
    rows = corpus(3, 60)
    assert run(spark, rows, max_bits=1 << 16) == brute(rows)
    assert run(spark, rows, min_bytes=50) == brute(rows, 50)
    with pytest.raises(ValueError):
        run(spark, rows, min_bytes=10)


def test_long_texts_and_empty_tables(spark):
    rnd = random.Random(4)
    long = "".join(rnd.choice("abcdefgh ") for _ in range(30_000))
    rows = [(1, long), (2, long[500:9000] + "x" + long[9000:20_000]), (3, "y" + long[100:400]), (4, long[::-1])]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, []) == {}
    assert run(spark, [(5, None)]) == {5: (0, 0, 0, b"")}


def test_groups_hold_all_occurrences(spark):
    """Each group is a repeat, its occurrences have equal bytes, and together they name every repeated window."""
    rows = corpus(5, 50)
    texts = {i: t.encode() for i, t in rows}
    found = suffixes.Repeats(spark.createDataFrame(rows, "doc long, text string"), 100)
    groups = defaultdict(set)
    for r in found.groups().collect():
        groups[r.first_doc, r.first_at, r.length].add((r.doc, r.at))
    named = defaultdict(set)
    for (doc, at, length), places in groups.items():
        want = texts[doc][at:at + length]
        assert len(want) == length >= 100 and min(places) == (doc, at) and len(places) > 1
        for d, x in places:
            assert texts[d][x:x + length] == want
            for k in range(length - 99):
                named[want[k:k + 100]].add((d, x + k))
    windows = defaultdict(set)
    for d, b in texts.items():
        for i in range(len(b) - 99):
            windows[b[i:i + 100]].add((d, i))
    assert {w for w, p in windows.items() if len(p) > 1} == set(named)
    # Later occurrences all appear; the span test above says that the first ones come first.
    for w, p in named.items():
        assert p <= windows[w]


def test_one_id_with_different_texts(spark):
    """Order within an id is that of the hash of the text; what is left of both together is fixed."""
    rnd = random.Random(8)
    a, b = ("".join(rnd.choice("abcdefgh") for _ in range(300)) for _ in range(2))
    df = spark.createDataFrame([(1, a + b), (1, b + a), (None, a), (2, "z" * 50), (None, None)], "doc_id long, text string")
    got = {r.text: r for r in suffixes.remove_repeats(df).collect()}
    assert sorted(got[t].n_removed for t in (a + b, b + a)) == [0, 600]
    assert (got[a].n_removed, got["z" * 50].n_removed, got[None].n_bytes) == (300, 0, 0)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.lists(st.sampled_from([b"a", b"b", b"\0", b"ab"]), min_size=3, max_size=14)),
                min_size=1, max_size=7))
def test_intervals_are_the_maximal_repeats(texts):
    """On whole contexts (every suffix of at least ``size`` bytes) against all pairs of suffixes."""
    size = 3
    rows, seen = [], set()
    for i, (n, parts) in enumerate(texts):
        b = b"".join(parts)
        if len(b) >= size and b not in seen:
            seen.add(b)
            rows.append((i, 0, len(b) - size + 1, b))
    if not rows:
        return
    found, of, window, rank = suffixes.scan(rows, size)
    got = set()
    for length, a, b, first in found:
        places = {(int(of[i]), int(window[i])) for i in range(a, b + 1)}
        assert len(places) == b - a + 1 > 1 and min(places) == next((int(of[i]), int(window[i])) for i in range(a, b + 1) if rank[i] == first)
        got.add((rows[int(of[a])][3][int(window[a]):int(window[a]) + length], frozenset(places)))
    where = defaultdict(set)
    for c, r in enumerate(rows):
        b = r[3]
        for i in range(len(b)):
            for j in range(i + size, len(b) + 1):
                where[b[i:j]].add((c, i))
    want = set()
    for s, places in where.items():
        if len(places) < 2:
            continue
        after = {(rows[c][3][i + len(s):i + len(s) + 1] or (c, i)) for c, i in places}
        before = {(rows[c][3][i - 1:i] if i else (c, i)) for c, i in places}
        if len(after) > 1 and len(before) > 1:
            want.add((s, frozenset(places)))
    assert got == want


def test_equal_windows_share_their_minimizer():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 100, 4000).astype(np.uint8)
    data[2000:2600] = data[300:900]
    offsets = np.array([0, 0, 1000, 1050, 1050, 4000, 4000])
    seen = {}
    for run_bytes in (1 << 20, 700):
        text, at, n, m, _ = suffixes.anchors(data, offsets, 100, 32, run_bytes)
        windows = 0
        for t, a, k, g in zip(text, at, n, m):
            for i in range(k):
                w = bytes(data[offsets[t] + a + i:offsets[t] + a + i + 100])
                assert len(w) == 100 and offsets[t] + a + i + 100 <= offsets[t + 1]
                assert seen.setdefault(w, g) == g
                windows += 1
        assert windows == sum(max(0, int(x) - 99) for x in np.diff(offsets))
