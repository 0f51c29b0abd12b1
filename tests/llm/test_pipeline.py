"""Every stage of the corpus pipeline against a brute-force version, on a small corpus with planted cases."""

from __future__ import annotations

import hashlib
import math
import random

import numpy as np
import pytest

import corpus_pipeline
from pixlens.llm import ordinal

from .conftest import documents
from .test_bpe import LIBRARY
from .test_linestore import brute as brute_lines
from .test_mixing import fill
from .test_vptree import slow_components, slow_fingerprint

SHARED = "this passage stands in very many documents of the corpus"


@pytest.fixture(scope="module")
def corpus(spark, words, odd_rows, tmp_path_factory):
    rnd = random.Random(11)
    rows, marks = [], []
    words = ["".join(rnd.choice("abcdefghijklmnoprstu") for _ in range(rnd.randint(3, 9))) for _ in range(6000)]
    for i in range(400):
        ws = [rnd.choice(words) for _ in range(rnd.randint(30, 90))]
        kind = ("good", "good", "good", "junk", "toxic")[i % 5]
        if kind == "junk":
            ws = [w.upper() + "!!" for w in ws]
        if kind == "toxic":
            ws[2] = ws[7] = "vilebad"
        lines = [" ".join(ws[:20]), " ".join(ws[20:])]
        if i % 3 == 0:
            lines.insert(1, SHARED)
        rows.append((1000 + i, "\n".join(lines), "en", rnd.choice(["a", "a", "b", "c", None])))
        if i % 4:
            marks.append((1000 + i, int(kind != "junk"), int(kind == "toxic")))
    good = [r for i, r in enumerate(rows) if i % 5 < 3]
    rows += [(3000 + i, r[1], "en", "b") for i, r in enumerate(good[:40])]  # exact copies
    rows += [(4000 + i, good[0][1], "en", "c") for i in range(60)]
    rows += [(r[0], r[1], "en", "odd") for r in odd_rows]
    folder = tmp_path_factory.mktemp("corpus")
    documents(spark, rows).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder), rows, marks


def test_stage_by_stage(spark, corpus):
    folder, rows, marks = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "line_dedup", "near_dedup", "mix_sources", "tokenize"]

    # Quality: the model itself is tested elsewhere; its decisions must take effect, and be right for planted rows.
    kept = stages["quality"](spark, docs, folder)
    model = ordinal.fit(docs, ordinal.grades(spark.read.parquet(f"{folder}/labels.parquet")))
    weight = dict(zip(model["hashes"], model["weights"]))

    def tail(text):
        f = math.fsum(weight.get(h, 0.0) for h in ordinal.features(text))
        return 1 / (1 + math.exp(model["thresholds"][1] - f))
    want = sorted(((r[0], r[1]) for r in rows if tail(r[1]) >= ordinal.MIN_TAIL), key=repr)
    now = [tuple(r) for r in kept.collect()]
    assert sorted(((r[0], r[1]) for r in now), key=repr) == want and kept.columns == docs.columns
    left = {r[0] for r in now}
    bad = {1000 + i for i in range(400) if i % 5 > 2}
    good = {1000 + i for i in range(400)} - bad
    assert len(left & bad) <= 0.05 * len(bad) and len(good - left) <= 0.05 * len(good)

    # Lines.
    docs = documents(spark, [(r[0], r[1], r[2], r[3]) for r in now])
    out = stages["line_dedup"](spark, docs, folder).collect()
    want = [(d, t) for d, _, _, t in brute_lines([(r[0], r[1]) for r in now])]
    assert sorted(((r.doc_id, r.text) for r in out), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)

    # Near copies: one of each component.
    now = [(r.doc_id, r.text, r.lang, r.source) for r in out]
    out = stages["near_dedup"](spark, documents(spark, now), folder).collect()
    groups = slow_components([(d, slow_fingerprint(t)) for d, t, _, _ in now])
    stay = {c for _, _, c in groups if c is not None}
    assert sorted(r.doc_id for r in out if r.doc_id is not None) == sorted(stay)
    assert sum(r.doc_id is None for r in out) == sum(d is None for d, *_ in now)

    # Mixing: as many passes as the targets ask for, in a fixed order.
    now = [(r.doc_id, r.text, r.lang, r.source) for r in out]
    out = stages["mix_sources"](spark, documents(spark, now), folder)
    again = stages["mix_sources"](spark, documents(spark, now[::-1]), folder)
    mixed = [(r.doc_id, r.text, r.lang, r.source) for r in out.collect()]
    assert mixed == [(r.doc_id, r.text, r.lang, r.source) for r in again.collect()]
    size = {}
    for d, t, _, s in now:
        size.setdefault(s, []).append((hashlib.md5(str("" if d is None else d).encode()).hexdigest(), len((t or "").encode().split()), d, t))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    totals = [sum(x[1] for x in size[s]) for s in order]
    goals = fill(totals, [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(totals))
    want = []
    for s, total, goal in zip(order, totals, goals):
        at = 0
        for _, n, d, t in sorted(size[s], key=lambda x: x[:2]):
            want += [(d, t)] * sum(math.floor(goal + 0.5) > at + p * total for p in range(2) if n)
            at += n
    assert sorted(((d, t) for d, t, _, _ in mixed), key=repr) == sorted(want, key=repr)

    # Tokens.
    out = stages["tokenize"](spark, documents(spark, mixed), folder).collect()
    got = sorted((r.doc_id or -1, r.n_tokens, bytes(r.ids)) for r in out)
    ids = [(d or -1, LIBRARY.encode_ordinary(t or "")) for d, t, _, _ in mixed]
    assert got == sorted((d, len(i), np.array(i, "<u4").tobytes()) for d, i in ids)


def test_run_is_all_stages(spark, corpus):
    folder, rows, _ = corpus
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "source", "n_tokens", "ids"]
    ids = [r.doc_id for r in got.collect()]
    assert 0 < len(set(ids)) < len({r[0] for r in rows}) and max(map(ids.count, set(ids))) <= 2


def test_clashing_columns_and_empty_tables(spark, corpus, tmp_path):
    folder, rows, marks = corpus
    names = ["keep", "Size", "taken", "passes", "position", "n_lines", "kept_text", "fp", "id", "rid", "target"]
    docs = documents(spark, rows[:60]).selectExpr("*", *[f"doc_id AS {n}" for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns, name
        assert all(r[n] == r["doc_id"] for r in out.collect() for n in names), name
    empty = documents(spark, [])
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, folder).count() == 0, name
