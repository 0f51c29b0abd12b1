"""Bitmap postings: AND of all terms, prefixes, ranges, hot lexemes, odd ids."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from pixlens.operators import bitmaps, textindex


def frames(spark, texts, asked):
    index = spark.createDataFrame([(i, None if t is None else t.split()) for i, t in texts.items()],
                                  "upload_id long, ocr_lexemes array<string>")
    return index, spark.createDataFrame(list(asked.items()), "request_id long, processed_term string")


def brute(texts, asked, prefix=False):
    out = set()
    for r, term in asked.items():
        words = set((term or "").lower().split())
        for u, t in texts.items():
            held = set((t or "").split())
            if words and all(any(h.startswith(w) if prefix else h == w for h in held) for w in words):
                out.add((r, u))
    return out


def corpus():
    rnd = random.Random(1)
    vocab = ["car", "cart", "cargo", "ca", "plane", "plan", "the", "é", "éa", "東京", "x1"]
    ids = [0, 1, 2, -4, 32767, 32768, 32769, 65536, 65537, 1_000_000, 1_000_001, 5_000_000_000] + rnd.sample(range(3, 200_000), 300)
    texts = {i: " ".join(rnd.choice(vocab) for _ in range(rnd.randint(0, 5))) + " common" for i in ids}
    texts[77_777_777], texts[77_777_778] = None, ""
    asked = {1: "car", 2: "the car", 3: "common", 4: "common plan ca", 5: "", 6: None, 7: "missing", 8: "car missing", 9: "éa",
             10: "CAR the", 11: "car the", 12: "c", 13: "pla the", 14: "東"}
    return texts, asked


def test_equals_brute_force_and_the_scan(spark):
    texts, asked = corpus()
    index, requests = frames(spark, texts, asked)
    post = bitmaps.bitmap_postings(index)
    got = [tuple(r) for r in bitmaps.search_bitmaps(requests, post).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, asked)
    assert set(got) == {tuple(r) for r in textindex.search_images_ocr_scan(requests, index).collect()}


def test_prefixes_probe_the_dictionary(spark):
    texts, asked = corpus()
    index, requests = frames(spark, texts, asked)
    post = bitmaps.bitmap_postings(index)
    got = [tuple(r) for r in bitmaps.search_bitmaps(requests, post, prefix=True).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, asked, prefix=True)


def test_a_hot_lexeme_is_split_by_range(spark, tmp_path):
    index = spark.range(0, 300_000, 3).select(F.col("id").alias("upload_id"), F.array(F.lit("hot"), F.col("id").cast("string")).alias("ocr_lexemes"))
    bitmaps.write_bitmaps(bitmaps.bitmap_postings(index.filter("upload_id % 1000 < 30"), 4), str(tmp_path / "post"))
    post = bitmaps.read_bitmaps(spark, str(tmp_path / "post"))
    assert post.filter("lexeme = 'hot'").count() == 11
    requests = spark.createDataFrame([(1, "hot 300"), (2, "hot"), (3, "hot")], "request_id long, processed_term string")
    got = bitmaps.search_bitmaps(requests, post).groupBy("request_id").count().collect()
    assert {r.request_id: r["count"] for r in got} == {2: 3000, 3: 3000}
    requests = spark.createDataFrame([(1, "hot 27")], "request_id long, processed_term string")
    assert [r.upload_id for r in bitmaps.search_bitmaps(requests, post).collect()] == [27]


def test_empty(spark):
    index, requests = frames(spark, {1: "a"}, {1: "a"})
    assert bitmaps.search_bitmaps(requests, bitmaps.bitmap_postings(index.limit(0))).collect() == []
    assert bitmaps.search_bitmaps(requests.limit(0), bitmaps.bitmap_postings(index)).collect() == []


def test_rare_lexemes_take_no_bitmap(spark):
    """A lexeme of one image is one number, not 4 KB; a frequent one is a bitmap, and both meet in a search."""
    index = spark.range(0, 3000).select(F.col("id").alias("upload_id"), F.array(
        F.lit("hot"), F.concat(F.lit("w"), F.col("id")), F.when(F.col("id") % 3 == 0, "third").otherwise("other")).alias("ocr_lexemes"))
    post = bitmaps.bitmap_postings(index)
    size = post.select(F.max(F.when(F.col("lexeme").startswith("w"), F.length("bits") + 4 * F.size("places"))),
                       F.max(F.when(F.col("lexeme") == "hot", F.length("bits")))).first()
    assert size[0] == 4 and size[1] == 4096
    held = bitmaps.positions(post, "lexeme").groupBy("lexeme").agg(F.sum(F.size("at")).alias("n")).filter("n > 1").collect()
    assert {r.lexeme: r.n for r in held} == {"hot": 3000, "third": 1000, "other": 2000}
    requests = spark.createDataFrame([(1, "hot third"), (2, "w27 third hot"), (3, "w28 third hot"), (4, "other hot w2999")],
                                     "request_id long, processed_term string")
    got = [tuple(r) for r in bitmaps.search_bitmaps(requests, post).collect()]
    assert sorted(got) == sorted([(1, i) for i in range(0, 3000, 3)] + [(2, 27), (4, 2999)])


def test_words_with_one_beginning_are_united_once(spark):
    """A prefix of very many lexemes is one posting list, whatever the number of requests that ask for it."""
    index = spark.range(0, 2000).select(F.col("id").alias("upload_id"), F.array(
        F.concat(F.lit("a"), F.col("id")), F.concat(F.lit("b"), F.col("id") % 7)).alias("ocr_lexemes"))
    requests = spark.range(1, 30).select(F.col("id").alias("request_id"), F.concat(F.lit("a b"), F.col("id") % 7).alias("processed_term"))
    got = {(r.request_id, r.upload_id) for r in bitmaps.search_bitmaps(requests, bitmaps.bitmap_postings(index), prefix=True).collect()}
    assert got == {(r, u) for r in range(1, 30) for u in range(2000) if u % 7 == r % 7}


def kept_tables(monkeypatch, module):
    """The tables a search writes, by name."""
    held, write = {}, module.materialize

    def keep(df, name):
        held[name] = write(df, name)
        return held[name]
    monkeypatch.setattr(module, "materialize", keep)
    return held


def test_only_the_postings_of_asked_words_are_read_again(spark, monkeypatch):
    """The stored postings are read once; the joins of the words read a table of the batch's words only."""
    index = spark.range(0, 500).select(F.col("id").alias("upload_id"), F.array(
        F.lit("hot"), F.concat(F.lit("w"), F.col("id"))).alias("ocr_lexemes"))
    requests = spark.createDataFrame([(1, "hot w7"), (2, "w8"), (3, "W7 hot")], "request_id long, processed_term string")
    for module, post, search in ((bitmaps, bitmaps.bitmap_postings(index), bitmaps.search_bitmaps),
                                 (textindex, textindex.postings(index), textindex.search_images_ocr)):
        held = kept_tables(monkeypatch, module)
        assert sorted(tuple(r) for r in search(requests, post).collect()) == [(1, 7), (2, 8), (3, 7)]
        assert {r.lexeme for r in held["search-postings"].select("lexeme").collect()} == {"hot", "w7", "w8"}


def test_single_postings_meet_the_second_word_before_the_others(spark, monkeypatch):
    """Candidates that lack the second rarest word do not meet the further words; equal sets of words are solved once."""
    texts = {i: f"common often{'' if i % 2 else ' rare'}{' seldom' if i % 3 == 0 else ''}" for i in range(60)}
    asked = {1: "common often rare seldom", 2: "seldom RARE often common", 3: "rare", 4: "rare nothing", 5: "common often rare"}
    index, requests = frames(spark, texts, asked)
    held = kept_tables(monkeypatch, textindex)
    got = [tuple(r) for r in textindex.search_images_ocr(requests, textindex.postings(index)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(texts, asked)
    assert held["search-asks"].count() == 4
    assert held["search-second"].filter("n_terms = 4").count() == 10
