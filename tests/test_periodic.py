"""Incremental backfill and cleanup against full runs, after changes of every kind."""

from __future__ import annotations

import pytest
from conftest import category, forum, index_row, post, topic, upload

from pixlens.config import Settings
from pixlens.operators import eligibility as el
from pixlens.streaming import periodic

CFG = Settings(enabled=True, search_enabled=True, analyze_ocr_enabled=True, ignored_categories=("2",), ignored_tags=("vip",))


def state(**changes):
    rows = dict(
        categories=[category(1), category(2), category(3)], topics=[topic(i, 1) for i in range(1, 7)], tags=[(1, "vip"), (2, "x")],
        topic_tags=[(5, 2)], posts=[post(10 + i, 1 + i % 6) for i in range(12)], uploads=[upload(i) for i in range(12)],
        post_uploads=[(10 + i, i) for i in range(12)] + [(10, 5)], custom_emojis=[], users=[],
        index=[index_row(i, ocr_text="t") for i in range(0, 12, 2)])
    return {**rows, **changes}


BASE = state()
CHANGED = {
    "topic": (state(topics=[topic(i, 2 if i == 3 else 1) for i in range(1, 7)]), [("topic", 3)]),
    "tag added": (state(topic_tags=[(5, 2), (1, 1)]), [("topic", 1)]),
    "tag renamed": (state(tags=[(1, "y"), (2, "vip")]), [("tag", 1), ("tag", 2)]),
    "category": (state(categories=[category(1, restricted=True), category(2), category(3)]), [("category", 1)]),
    "post deleted": (state(posts=[post(10 + i, 1 + i % 6, deleted_at=BASE["posts"][0][4] if i in (2, 5) else None) for i in range(12)]),
                     [("post", 12), ("post", 15)]),
    "upload": (state(uploads=[upload(i, width=1 if i in (4, 7) else 150) for i in range(12)]), [("upload", 4), ("upload", 7)]),
    "emoji": (state(custom_emojis=[(6,), (9,)]), [("emoji", 6), ("emoji", 9)]),
    "link": (state(post_uploads=[(10 + i, i) for i in range(12) if i != 8]), [("link", 8), ("link", 5)]),
    "index": (state(index=[index_row(i, ocr_text="t") for i in range(0, 12, 3)]), [("upload", i) for i in range(12)]),
}


def sets(t):
    return ({r.id for r in el.uploads_needing_analysis(t, CFG).select("id").collect()},
            {r.upload_id for r in el.stale_index_rows(t, CFG).collect()})


@pytest.mark.parametrize("what", list(CHANGED))
def test_decisions_on_what_changed_equal_a_full_run(spark, what):
    rows, changes = CHANGED[what]
    old, new = forum(spark, **BASE), forum(spark, **rows)
    d = periodic.decide(spark.createDataFrame(changes, "kind string, id long"), new, CFG).collect()
    touched = {r.upload_id for r in d}
    needed, stale = sets(old)
    got = ((needed - touched) | {r.upload_id for r in d if r.needed}, (stale - touched) | {r.upload_id for r in d if r.stale})
    assert got == sets(new)
    if what not in ("category", "index"):
        assert len(touched) < 6


def test_runs_take_what_is_there_and_later_ones_win(spark, tmp_path):
    run = {k: str(tmp_path / k) for k in ("in", "out", "ck")}
    before = spark.createDataFrame([(i,) for i in sets(forum(spark, **BASE))[0]], "upload_id long")
    now = BASE
    for n, what in enumerate(("upload", "emoji", "upload")):
        now = {**BASE, **{k: v for k, v in CHANGED[what][0].items() if v != BASE[k]}} if n < 2 else BASE
        changes = CHANGED[what][1] + (CHANGED["emoji"][1] if n == 2 else CHANGED["upload"][1] if n == 1 else [])
        spark.createDataFrame(changes, "kind string, id long").write.parquet(f"{run['in']}/n={n}")
        stream = spark.readStream.schema(periodic.CHANGES).option("recursiveFileLookup", "true").parquet(run["in"])
        t = forum(spark, **now)
        periodic.run_changes(stream, t, CFG, run["out"], run["ck"])
        got = {r.upload_id for r in periodic.decided(spark, run["out"], before, "needed").collect()}
        assert got == sets(t)[0]
