"""One row per component, also when its id stands in other components."""

from __future__ import annotations

import random

import corpus_pipeline

from .conftest import documents


def test_repeated_ids(spark):
    rnd = random.Random(3)
    a, b, c, d = (" ".join(f"w{rnd.randrange(10**6)}" for _ in range(200)) for _ in range(4))
    rows = [(10, a), (10, b), (10, b), (20, b), (20, c), (30, c), (None, c), (None, d), (None, d), (40, None), (40, "")]
    out = corpus_pipeline.near_dedup(spark, documents(spark, [(i, t, "en", "s") for i, t in rows]), "").collect()
    want = [(10, a), (10, b), (20, c), (None, c), (None, d), (None, d), (40, "")]
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(want, key=repr)
