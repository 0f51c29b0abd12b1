from __future__ import annotations

import random

import numpy as np
import xxhash

from pixlens.llm import vptree

from .conftest import documents


def slow_fingerprint(text):
    import re

    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(ws[i:i + 3]) for i in range(max(1, len(ws) - 2))] if ws else []
    hs = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def slow_components(prints, radius=2):
    """{id: smallest id reachable} by brute force over (id, fingerprint)."""
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    fp = np.array([p for _, p in prints], dtype=np.uint64)
    for i in range(len(prints)):
        for j in np.nonzero(np.bitwise_count(fp ^ fp[i]) <= radius)[0]:
            a, b = find(i), find(int(j))
            parent[max(a, b)] = min(a, b)
    roots = [find(i) for i in range(len(prints))]
    low = {}
    for (d, _), r in zip(prints, roots):
        if d is not None:
            low[r] = min(low.get(r, d), d)
    return [(d, p, low.get(r)) for (d, p), r in zip(prints, roots)]


def test_fingerprints_match_the_definition():
    for t in (None, "", " \n", "One", "One two", "A b C d É é", "x\x1cy z w v", "a b c a b c a b c", "w " * 5000):
        assert vptree.fingerprint(t) % (1 << 64) == slow_fingerprint(t)


def test_links_are_exact_for_any_tree():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**63, 700, dtype=np.uint64)
    near = base[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64))
    ball = np.uint64(1) << np.arange(64, dtype=np.uint64)
    points = np.unique(np.concatenate([base, near, near[:90] ^ np.uint64(3 << 40), ball, [np.uint64(0)]]))
    want = {(int(a), int(b)) for a in points for b in points[vptree.far(points, a) <= 2] if b < a}
    for depth, sample in ((0, points), (3, points[::5]), (5, points[:20]), (4, ball)):
        vantage, cut = vptree.build_tree(sample, depth, 2)
        at, node, guest = vptree.route(points, vantage, cut, depth, 2)
        assert sorted(at[~guest]) == list(range(len(points)))
        got = []
        for shard in np.unique(node):
            mine = node == shard
            homes, guests = points[at[mine & ~guest]], points[at[mine & guest]]
            a, b = vptree.near_pairs(homes, guests, 2, leaf=16)
            p = np.concatenate([homes, guests])
            got += [(max(x, y), min(x, y)) for x, y in zip(p[a].tolist(), p[b].tolist())]
        assert len(got) == len(set(got)) and set(got) == want


def test_components_match_brute_force(spark, words, odd_rows):
    rnd = random.Random(2)
    rows = list(odd_rows)
    for i in range(60):
        t = [rnd.choice(words) for _ in range(rnd.choice((3, 30, 150)))]
        rows.append((100 + i, " ".join(t)))
        for k in range(rnd.choice((0, 0, 1, 4))):
            u = list(t)
            u[rnd.randrange(len(u))] = rnd.choice(words)
            rows.append((1000 + 10 * i + k, " ".join(u)))
    df = documents(spark, rows).selectExpr("*", "1 AS fp", "2 AS component_id")
    got = vptree.cluster(df, shard_size=16).collect()
    want = slow_components([(d, slow_fingerprint(t)) for d, t in rows])
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(((r.id, r.fp % (1 << 64), r.component_id) for r in got), key=key) == sorted(want, key=key)


def test_chain_of_links_and_empty(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(300)] + [(1000, 999)], "a long, b long")
    got = {r.node: r.root for r in vptree.components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 301)}, 1000: 999}
    assert vptree.components(edges.limit(0)).count() == 0
    assert vptree.cluster(documents(spark, [])).count() == 0
