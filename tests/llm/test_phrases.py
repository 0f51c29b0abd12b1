from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixlens.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, rank long, phrase int, f string, chunk int, words int"


def pieces(text):
    return [[w for w in re.split("[ \t]+", p) if w] for p in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").translate(LOWER))]


def grams(rows, max_words=3):
    f = defaultdict(Counter)
    for _, text, lang in rows:
        for w in pieces(text):
            for n in range(1, max_words + 1):
                f[lang or "und"].update(tuple(w[i:i + n]) for i in range(len(w) - n + 1))
    return f


def brute(rows, min_count=10, top=2000, max_words=3):
    out = []
    for lang, c in grams(rows, max_words).items():
        n = sum(v for p, v in c.items() if len(p) == 1)
        cand = {p: v for p, v in c.items() if len(p) > 1 and v >= min_count}
        found = []
        for p, a in cand.items():
            if any(len(q) > len(p) and 100 * b >= 50 * a and any(q[i:i + len(p)] == p for i in range(len(q)))
                   for q, b in cand.items()):
                continue
            score, k = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, x, y, n, -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top])]
    return set(out)


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, 0, 0, "", 0, 0) for r in rows], SCHEMA).repartition(4)
    got = phrases.collocations(df, **more)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert {t for c, t in got.dtypes if c not in ("lang", "phrase")} == {"bigint"}
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus(seed=3, docs=250):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["New", "york", "é", "ÉA", "\x1cz", "a b"]
    fixed = ["New York city", "of the", "a b c d"]
    out = []
    for i in range(docs):
        t = []
        for _ in range(rnd.randint(0, 60)):
            t.append(rnd.choice(fixed) if rnd.random() < .15 else rnd.choice(vocab))
            t.append(rnd.choice([" ", " ", "  ", "\t", ", ", "\n", " . ", "\r"]) if rnd.random() < .4 else " ")
        out.append((i, "".join(t), rnd.choice(["en", "en", "de", None])))
    return out


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [(1, None, "en"), (2, "", None), (3, " \t\n", "de"), rows[0], rows[0], (None, "new york city", "en")]
    rows += [(4, "x y " * 4000, "en"), (5, "k" * 100_000 + " " + "m" * 50_000, "de")]
    rows += [(1000 + i, "one shared passage of the hot copies, again", "en") for i in range(300)]
    assert run(spark, rows) == brute(rows)


def test_top_ties_and_a_full_bitmap(spark):
    rows = corpus(4, 150)
    assert run(spark, rows, min_count=3, top=7, max_bits=1 << 16) == brute(rows, 3, 7)
    assert run(spark, rows, min_count=5, max_words=4) == brute(rows, 5, max_words=4)


def test_empty(spark):
    assert run(spark, []) == set()
    assert run(spark, [(1, None, None)]) == set()
    assert run(spark, [(1, "only two", "en")] * 9) == set()


def test_full_bitmap_lets_all_through(spark, monkeypatch):
    rows = corpus(6, 100)
    monkeypatch.setattr(phrases, "frequent_bits", lambda *a: (16, b"\xff" * 8192))
    assert run(spark, rows) == brute(rows)


WORD = st.text(alphabet="abAé", min_size=1, max_size=3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.one_of(WORD, st.sampled_from([".", "\n", "\t", " ", ",x", ""])), max_size=90), max_size=4),
       st.integers(2, 4))
def test_each_occurrence_counts_in_one_chunk(texts, max_words):
    texts = [" ".join(t).translate(LOWER) for t in texts]
    row, core, chunk = phrases.parse(pa.array(texts, pa.string()), max_words)
    got = Counter()
    for r, c, text in zip(row.tolist(), core.tolist(), chunk.to_pylist()):
        w = text.split(" ")
        assert c <= phrases.MAX_CORE and len(w) <= c + max_words - 1
        got.update((r, tuple(w[i:i + n])) for i in range(c) for n in range(1, max_words + 1) if i + n <= len(w))
    want = Counter()
    for r, t in enumerate(texts):
        for w in pieces(t):
            want.update((r, tuple(w[i:i + n])) for n in range(1, max_words + 1) for i in range(len(w) - n + 1))
    assert got == want


@pytest.mark.parametrize("a,l,r", [(10 ** 13, 10 ** 13, 10 ** 13), (3 * 10 ** 12, 4 * 10 ** 12, 7 * 10 ** 12)])
def test_scores_beyond_64_bits(spark, a, l, r, monkeypatch):
    monkeypatch.setattr(phrases, "dictionary", lambda d, **k: d.sparkSession.createDataFrame(
        [("en", 1, "x y", a), ("en", 1, "x", l - a), ("en", 1, "y", r)], "lang string, core int, chunk string, times long"))
    got = phrases.collocations(spark.createDataFrame([], SCHEMA)).collect()
    assert [(g.a, g.l, g.r, g.score) for g in got] == [(a, l, r, 10 ** 6 * a * a // (l * r))]
