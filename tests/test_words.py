"""Watched words against a plain matcher, lexemes of Han text in order, and an index that was rewritten."""

from __future__ import annotations

import random
import re

import pytest
from conftest import forum, index_row

from pixlens.functions.text import lexemes
from pixlens.operators import index_store as ix
from pixlens.operators import moderation as mod


def brute(texts, words):
    out = set()
    for u, text in texts:
        for w in words:
            p = "".join(r"\w*" if c == "*" else re.escape(c) for c in w)
            if re.search(rf"(?:^|\W)(?:{p})(?:$|\W)", text, re.I):
                out.add(u)
    return out


def run(spark, texts, words):
    t = spark.createDataFrame(texts, "upload_id long, ocr_text string")
    got = [r.upload_id for r in mod.matching_images(t, spark.createDataFrame([(w,) for w in words], "word string")).collect()]
    assert len(got) == len(set(got))
    return set(got)


TEXTS = [(1, "a quinz here"), (2, "quartz\nqunz"), (3, "QUxxNZ!"), (4, "the-it"), (5, "the it"), (6, "foobar baz"), (7, "foo bar"),
         (8, "x!!!y"), (9, "wow !!! ok"), (10, ""), (11, "éclair ÉCLAT"), (12, "under_score"), (13, "b"), (14, "ab"), (15, "a.b c")]


@pytest.mark.parametrize("words", [["qu*nz"], ["the it"], ["foo*"], ["foo* b*"], ["*bar"], ["!!!"], ["é*t"], ["*_*"], ["*b"], ["b*"],
                                   ["a.b*"], ["*oba*"], ["foo b*"], ["*oo* ba*"], ["qu*nz", "!!!", "*clair", "ab", "foo bar"], ["*"],
                                   ["a*.b"], ["* it"]])
def test_words_match_like_a_plain_matcher(spark, words):
    assert run(spark, TEXTS, words) == brute(TEXTS, words)


def test_many_wildcard_words(spark):
    rnd = random.Random(3)
    letters = "abcde"
    texts = [(i, " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 9))) for _ in range(12))) for i in range(120)]
    words = sorted({"".join(rnd.choice(letters + "*") for _ in range(rnd.randint(5, 9))) for _ in range(300)})
    assert run(spark, texts, words) == brute(texts, words)
    df = spark.createDataFrame(texts, "upload_id long, ocr_text string")
    plan = mod.matching_images(df, spark.createDataFrame([(w,) for w in words if "*" in w], "word string"))
    shown = plan._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in shown and "CartesianProduct" not in shown


def test_han_bigrams_keep_their_place(spark):
    df = spark.createDataFrame([("Car 東京都 x 人 東京abc12",), ("",), (None,), ("plain text",)], "t string")
    got = [r[0] for r in df.select(lexemes("t", cjk_bigrams=True)).collect()]
    assert got == [["car", "東京", "京都", "x", "人", "東京", "abc12"], [], None, ["plain", "text"]]


def test_a_row_that_was_cleaned_away_stays_away(spark, tmp_path):
    t = forum(spark, index=[index_row(1)])
    rows = "upload_id long, sha1 string, ocr_text string, ocr_lexemes array<string>, embeddings array<float>"
    deltas = ix.IndexDeltas(t.index, str(tmp_path / "d0"))
    none = spark.createDataFrame([], "upload_id long, sha1 string, n long")
    deltas.write("a", 0, spark.createDataFrame([(2, "s2", "x", ["x"], None)], rows), none)
    assert {r.upload_id for r in deltas.read().collect()} == {1, 2}
    cleaned = deltas.rewritten(deltas.read().filter("upload_id <> 2"), str(tmp_path / "base1"), str(tmp_path / "d1"))
    assert {r.upload_id for r in cleaned.read().collect()} == {1}
    cleaned.write("a", 1, spark.createDataFrame([(3, "s3", "y", ["y"], None)], rows), none)
    assert {r.upload_id for r in cleaned.read().collect()} == {1, 3}
    with pytest.raises(ValueError):
        cleaned.rewritten(cleaned.read(), str(tmp_path / "base2"), str(tmp_path / "d0"))
