from __future__ import annotations

import random

from pixlens.llm import linestore

from .conftest import documents

BLANKS = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(BLANKS))


def brute(rows):
    holders = {}
    for d, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                holders.setdefault(k, []).append(d)
    last = {k: max((d for d in ds if d is not None), default=None) for k, ds in holders.items() if len(ds) >= 3}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in last or last[key(x)] == d]
        out.append((d, len(lines), len(lines) - len(stay), t if len(stay) == len(lines) else "\n".join(stay)))
    return sorted(out, key=repr)


def test_matches_brute_force(spark, odd_rows):
    rnd = random.Random(4)
    shared = [f"a line that {n} documents have in COMMON" for n in range(30)] + ["é" * 19, "é" * 20, "short line"]
    rows = list(odd_rows)
    for i in range(80):
        lines = [rnd.choice([x, x.upper(), "  " + x + "\t", x.lower()]) for x in rnd.choices(shared, k=rnd.randint(0, 8))]
        rows.append((200 + i, "\n".join([*lines, f"the very own line of document {i}", ""])))
    df = documents(spark, rows).selectExpr("*", "1 AS n_lines", "2 AS rid", "3 AS h1")
    for batches, fanout in ((1, 2), (5, 2), (4, 3)):
        got = linestore.drop_shared_lines(df, batches=batches, fanout=fanout)
        assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in got.collect()), key=repr) == brute(rows)


def test_levels_merge_and_new_lines_are_told(spark):
    store = linestore.LineRuns(spark, fanout=2)
    seen = set()
    for b in range(7):
        ids = [(d, h % 11, h) for d in range(b * 3, b * 3 + 3) for h in range(b, b + 4)]
        run = store.add(spark.createDataFrame(ids, "id long, h1 long, h2 long"))
        seen |= {(h % 11, h) for _, _, h in ids}
        assert sum(map(len, store.levels)) == bin(b + 1).count("1")
        assert run.count() >= 4
    totals = {(r.h1, r.h2): (r.n, r.last) for r in store.totals().collect()}
    assert set(totals) == seen and totals[(3, 3)] == (12, 11)
    for level in store.levels:
        for path in level:
            for part in spark.read.parquet(path).rdd.glom().collect():
                assert [(r.h1, r.h2) for r in part] == sorted((r.h1, r.h2) for r in part)
    again = linestore.LineRuns(spark, store.folder, 2, [list(x) for x in store.levels])
    assert again.totals().count() == len(seen)
    fresh = again.add(spark.createDataFrame([(99, 3, 3), (99, 77, 77)], "id long, h1 long, h2 long"))
    assert {(r.h1, r.new) for r in fresh.filter("last = 99 AND h1 IN (3, 77)").collect()} >= {(77, True)}


def test_empty(spark):
    assert linestore.drop_shared_lines(documents(spark, [])).count() == 0
