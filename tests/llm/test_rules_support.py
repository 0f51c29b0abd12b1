"""Labels with few documents are judged by the languages that have enough."""

from __future__ import annotations

import random

from pixlens.llm import rules

from .conftest import documents


def test_junk_under_a_rare_label_is_rejected(spark, words):
    rnd = random.Random(8)
    common = words[:40]

    def good():
        return " ".join(rnd.choice(common if rnd.random() < 0.7 else words) for _ in range(rnd.randint(60, 160))) + "."

    def junk():
        return " ".join(rnd.choice(words).upper() + "$$%%" for _ in range(90))

    rows = [(i, good(), "en") for i in range(150)] + [(500, junk(), "x1"), (501, junk(), "x2"), (502, junk(), "x2"), (503, good(), "x3")]
    rows += [(600 + i, "ZZ$$ QQ%%", "x4") for i in range(40)] + [(700, junk(), "x4")]  # many, but short
    refs = rules.load_references(rules.references(documents(spark, rows), n_words=20))
    assert set(refs) == {"en"} and refs["en"]["documents"] == 150
    kept = {r.doc_id: r.kept for r in rules.judge(documents(spark, rows), refs).collect()}
    assert all(kept[i] for i in range(150)) and kept[503]
    assert not any(kept[i] for i in (500, 501, 502, 700))


def test_without_a_well_supported_label_all_count(spark):
    rows = [(i, "one two three " * 30, f"l{i}") for i in range(3)]
    assert set(rules.load_references(rules.references(documents(spark, rows)))) == {"l0", "l1", "l2"}
