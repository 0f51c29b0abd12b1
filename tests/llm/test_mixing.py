from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from pixlens.llm import mixing

from .conftest import documents


def fill(sizes, weights, budget):
    """Targets by repeated sharing of the excess."""
    full = set()
    while True:
        rest = [i for i in range(len(sizes)) if i not in full]
        spent = sum(2 * sizes[i] for i in full)
        if not rest:
            return [2.0 * s for s in sizes]
        level = (budget - spent) / sum(weights[i] for i in rest)
        over = {i for i in rest if 2 * sizes[i] <= weights[i] * level}
        if not over:
            return [2.0 * sizes[i] if i in full else weights[i] * level for i in range(len(sizes))]
        full |= over


def test_targets_and_taken(spark, words):
    rnd = random.Random(9)
    sources = ["a", "B", "é", "Z", "empty", None, "zz"]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randint(0, 30))), "en", rnd.choice(sources[:4] + ["a"] * 6 + [None, "zz"]))
            for i in range(600)]
    rows += [(5000, None, "en", "empty"), (5001, " \n", "en", "empty"), (5002, "w " * 20_000, "en", "a"),
             (7, "twice the same", "en", "a"), (7, "twice the same", "en", "a"), (None, "no id here", "en", "a")]
    df = documents(spark, rows).select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"), F.lit(1).alias("taken"))
    got = mixing.mix(df).collect()
    assert len(got) == len(rows)
    size = {}
    for r in got:
        size[r.source] = size.get(r.source, 0) + r.size
    order = sorted((s for s in size if s is not None)) + [None]
    want = dict(zip(order, fill([size[s] for s in order], [(3, 1, 2)[i % 3] for i in range(len(order))], 1.5 * sum(size.values()))))
    taken = {}
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == size[r.source]
        assert 0 <= r.taken <= 2 * r.size and r.taken == sum(p["words"] for p in r.passes)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s, t in taken.items():
        assert abs(t - want[s]) <= 0.5
    again = sorted((tuple(r) for r in mixing.mix(df).collect()), key=repr)
    assert again == sorted((tuple(r) for r in got), key=repr)


def test_positions_follow_the_schedules(spark):
    rows = [(i, "w " * 10, "en", s) for i in range(900) for s in ("a", "b", "c")]
    df = documents(spark, rows).select("doc_id", "source", mixing.size_of(F.col("text")).alias("size"))
    mixed = mixing.mix(df)
    each = mixing.training_order(mixed)
    rows = each.collect()
    at = [r.position for r in rows]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= 1
    for k, s in enumerate(("a", "b", "c")):
        mine = [r.position for r in rows if r.source == s]
        knots = mixing.SCHEDULES[k]
        area = sum((x + y) / 2 * (t1 - t0) for (t0, x), (t1, y) in zip(knots, knots[1:]))
        for t in (0.25, 0.5, 0.8):
            done = 0.0
            for (t0, x), (t1, y) in zip(knots, knots[1:]):
                h = min(max(t - t0, 0), t1 - t0)
                done += x * h + (y - x) / (t1 - t0) * h * h / 2
            assert sum(p < t for p in mine) / len(mine) == pytest.approx(done / area, abs=0.02)


def test_empty(spark):
    df = documents(spark, []).select("doc_id", "source", F.lit(0).cast("long").alias("size"))
    assert mixing.mix(df).count() == 0 and mixing.training_order(mixing.mix(df)).count() == 0
