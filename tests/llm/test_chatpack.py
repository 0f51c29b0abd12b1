from __future__ import annotations

import random

from hypothesis import given
from hypothesis import strategies as st

from pixlens.llm import chatpack

SCHEMA = "conv_id long, turn long, role string, text string, owner long, depth int"
CONTROL = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)


def ordered(rows):
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [(r, t) for _, _, r, t in sorted(x)] for c, x in by.items()}


def check(spark, rows):
    want = ordered(rows)
    segments, paths = chatpack.pack(frame(spark, rows))
    got = {r.conv: r for r in chatpack.unpack(segments, paths).collect()}
    assert set(got) == set(want)
    for c, turns in want.items():
        assert chatpack.parse(got[c].text) == turns
        under = [chatpack.unescape(got[c].text[s["from"]:s["to"]]) for s in got[c].loss]
        assert under == [t for r, t in turns if r == "assistant"]
    return segments.collect(), paths.collect(), got


def test_shared_turns_once_with_positions_and_intervals(spark):
    rnd = random.Random(2)
    texts = ["hi", "", None, "a long question " * 5, "é日🙂", *CONTROL, "<\\s> <\\\\/s> [\\INST] tail<", "</s</s>"]
    rows = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]
    for c in range(120):
        n = rnd.randint(1, 6)
        for t in range(n):
            rows.append((c, t, ("user", "assistant")[t % 2] if rnd.random() > 0.1 else rnd.choice(["system", None, "a\nb\\n"]),
                         rnd.choice(texts[:4]) if t < 3 else rnd.choice(texts)))
    rows += [(500, None, "user", "x"), (500, 3, "user", "y"), (500, 3, "assistant", "x"), (501, 0, "user", "z"), (501, 0, "user", "z"),
             (None, 0, "user", "hi"), (502, 0, "assistant", "w" * 50_000)]
    segments, paths, got = check(spark, rows)
    nodes = set()
    for turns in ordered(rows).values():
        nodes |= {tuple(turns[:i + 1]) for i in range(len(turns))}
    assert sum(len(chatpack.parse(s.text)) for s in segments) == len(nodes)
    trees = {}
    for s in segments:
        assert len(s.text) == s.chars and all(a["to"] <= s.start for a in s.ancestors)
        assert sum(a["to"] - a["from"] for a in s.ancestors) == s.position
        trees.setdefault(s.tree, []).append(s)
    for own in trees.values():
        own.sort(key=lambda s: s.start)
        line = ""
        for s in own:
            assert s.start == len(line)
            line += s.text
        for s in own:
            seen = "".join(line[a["from"]:a["to"]] for a in s.ancestors) + s.text
            assert seen == got[s.conv].text
            # Depth-first: what stands between a segment and an ancestor of it also descends from that ancestor.
            for t in own:
                if s.ancestors and s.ancestors[-1]["to"] <= t.start < s.start:
                    assert any(a["from"] < s.ancestors[-1]["to"] and a["to"] >= s.ancestors[-1]["from"] for a in t.ancestors) \
                        or t.start == 0 or t.start <= s.ancestors[-1]["from"]


def test_empty(spark):
    segments, paths = chatpack.pack(frame(spark, []))
    assert segments.count() == 0 and paths.count() == 0 and chatpack.unpack(segments, paths).count() == 0


@given(st.text(alphabet="<>[]/\\sINTYS|imendart_ \n", max_size=30))
def test_escape_is_reversible(text):
    import re

    escaped = re.sub(chatpack.CONTROL, r"\1\2\\\3", text)
    assert chatpack.unescape(escaped) == text and not any(c in escaped for c in CONTROL)
