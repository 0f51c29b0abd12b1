"""Postings of long texts, and the search over single postings.

The work of a row grows with its words, not with their square.
"""

from __future__ import annotations

import random
import time

from pixlens.operators import textindex


def test_postings_of_a_long_text(spark):
    n = 30_000
    words = [f"w{i % (n - 5)}" for i in range(n)]  # the first five words stand twice
    index = spark.createDataFrame([(1, words), (2, ["b", "a", "b"]), (3, []), (4, None)], "upload_id long, ocr_lexemes array<string>")
    began = time.time()
    got = {(r.upload_id, r.lexeme): r.positions for r in textindex.postings(index).collect()}
    took = time.time() - began
    want = {(1, f"w{i}"): [i + 1] for i in range(n - 5)} | {(1, f"w{i}"): [i + 1, n - 4 + i] for i in range(5)}
    assert got == want | {(2, "a"): [2], (2, "b"): [1, 3]}
    assert took < 60


def test_postings_of_words_that_are_null_or_in_several_rows(spark):
    index = spark.createDataFrame([(1, ["b", None, "b", None]), (2, ["a"]), (2, ["c", "a"]), (None, ["d", "d"])],
                                  "upload_id long, ocr_lexemes array<string>")
    got = sorted(((r.upload_id, r.lexeme, r.positions) for r in textindex.postings(index).collect()), key=str)
    assert got == sorted([(1, "b", [1, 3]), (1, None, [2, 4]), (2, "a", [1, 2]), (2, "c", [1]), (None, "d", [1, 2])], key=str)


def test_texts_are_read_once_where_uploads_stand_in_one_row(spark):
    index = spark.createDataFrame([(1, ["b", "a", "b"]), (2, ["a"])], "upload_id long, ocr_lexemes array<string>")
    post = textindex.postings(index)
    assert post._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 1
    assert sorted((r.lexeme, r.upload_id, r.positions) for r in post.collect()) == [("a", 1, [2]), ("a", 2, [1]), ("b", 1, [1, 3])]


def test_search_over_single_postings_meets_numbers(spark):
    rnd = random.Random(5)
    words = "abcdefgh"
    texts = [(i, [rnd.choice(words) for _ in range(rnd.randint(0, 7))]) for i in range(60)] + [(None, ["a", "b"])]
    asked = [(i, " ".join(rnd.choice(words + "z") for _ in range(rnd.randint(0, 5)))) for i in range(80)]
    index = spark.createDataFrame(texts, "upload_id long, ocr_lexemes array<string>")
    requests = spark.createDataFrame(asked, "request_id long, processed_term string")
    found = textindex.search_images_ocr(requests, textindex.postings(index))
    got = sorted(((r.request_id, r.upload_id) for r in found.collect()), key=str)
    want = [(i, u) for i, term in asked for u, text in texts if term.split() and set(term.split()) <= set(text)
            and (u is not None or len(set(term.split())) == 1)]  # a row without an id meets no second word
    assert got == sorted(want, key=str)
    # The words themselves are neither shuffled nor sorted once their numbers are known.
    shown = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not any("lexeme" in x for x in shown if "Join" in x or "Project" in x)
