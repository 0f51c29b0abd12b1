from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from pixlens.llm import rules

from .conftest import documents


def slow(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = Counter(tri)
    hit = {j for i, t in enumerate(tri) if count[t] > 1 for j in (i, i + 1, i + 2)}
    return (len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(hit))


def test_base_counts():
    rnd = random.Random(3)
    texts = ["", " \n\t", "a b c a b c", "x\n\nx\n x\nx", "a|b <c> #1", "é ü\x0b日\x1cz   q", "a a a a a", "p q r s p q r"]
    texts += [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 40))) for _ in range(50)]
    texts += ["\n".join(rnd.choice(["a", "a b", "", " "]) for _ in range(12)) for _ in range(30)]
    for t in texts:
        assert rules.base_counts(t) == slow(t), repr(t)


def test_distance():
    assert rules.js_distance([1, 1], [2, 2]) == 0 and rules.js_distance([1, 0], [0, 3]) == 1
    assert rules.js_distance([0, 0], [1, 1]) == 1 and rules.js_distance([0], [0]) == 0
    assert rules.js_distance([3, 1], [1, 3]) == pytest.approx(rules.js_distance([1, 3], [3, 1]))


def test_verdicts_match_brute_force(spark, words, odd_rows):
    rnd = random.Random(8)
    common = words[:40]
    rows = [(100 + i, " ".join(rnd.choice(common if rnd.random() < 0.7 else words) for _ in range(rnd.randint(60, 160))) + ".", "en")
            for i in range(150)]
    rows += [(400 + i, " ".join(rnd.choice(words).upper() + "$$%%" for _ in range(90)), "en") for i in range(10)]
    rows += [(500, " ".join(words[:90]), "xx"), (501, " ".join(words[:90]), None)]
    rows += [(r[0], r[1], "en") for r in odd_rows]
    df = documents(spark, rows).selectExpr("*", "1 AS kept", "2 AS n_words")
    refs = rules.load_references(rules.references(df, n_words=20))
    counts, shares = {}, {}
    table = rules._class_table()
    for _, t, lang in rows:
        if t and lang:
            own = Counter(map(rules._key, t.split()))
            for w, n in own.items():
                counts.setdefault(lang, Counter())[w] += int(n * (1e6 / sum(own.values())) + 0.5)
            c = rules.class_counts(t, table)
            shares.setdefault(lang, [0] * 8)
            shares[lang] = [a + round(b / sum(c) * 1e6) for a, b in zip(shares[lang], c)]
    for lang, ref in refs.items():
        top = sorted(counts[lang].items(), key=lambda x: (-x[1], x[0]))[:20]
        assert ref["words"] == dict(top) and ref["rest"] == sum(counts[lang].values()) - sum(n for _, n in top)
        assert ref["classes"] == shares[lang]
    got = rules.judge(df, refs).collect()
    assert len(got) == len(rows)
    for r in got:
        if 100 <= (r.doc_id or 0) < 250:
            assert r.kept
        if 400 <= (r.doc_id or 0) < 410:
            assert not r.kept and not r.base_failed
    short = {r.doc_id: r for r in got}[2]
    assert short.base_failed and not short.kept and short.n_words == 0


def test_empty(spark):
    df = documents(spark, [])
    assert rules.judge(df, rules.load_references(rules.references(df))).count() == 0
    lone = documents(spark, [(1, "w " * 60, None)])
    assert [r.class_distance for r in rules.judge(lone, {}).collect()] == [None]
