"""Analysis, merge, failures, reuse, moderation (ports of the analysis examples)."""

from __future__ import annotations

import pandas as pd
from conftest import category, forum, index_row, post, topic, upload
from pyspark.sql import functions as F

from pixlens.config import Settings
from pixlens.functions.text import lexemes
from pixlens.operators import analysis as an
from pixlens.operators import index_store as ix
from pixlens.operators import moderation as md

CFG = Settings(analyze_ocr_enabled=True, analyze_embedding_enabled=True, embedding_dim=4)


def analyzer_from(table):
    def analyze(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [table[s] for s in pdf["sha1"]]
        return pd.DataFrame({"sha1": pdf["sha1"].to_numpy(), "ocr_result": [r[0] for r in rows],
                             "embedding": [r[1] for r in rows], "success": [r[2] for r in rows]})
    return analyze


def test_store_ocr_lines_and_vector(spark):
    t = forum(spark, uploads=[upload(1)])
    info = an.image_info(t.uploads, CFG)
    res = an.run_analyzer(info, analyzer_from({"sha1": (["a car", "a man"], [0.1, 0.2, 0.3, 0.4], True)}))
    stored = an.storable_results(an.match_results(res, info), t.uploads, CFG).collect()
    assert stored[0].ocr_text == "a car\na man"
    assert stored[0].ocr_lexemes == ["a", "car", "a", "man"]


def test_chinese_bigrams(spark):
    df = spark.createDataFrame([("我爱北京 ok",)], "t string")
    got = df.select(lexemes(F.col("t"), cjk_bigrams=True).alias("l")).first().l
    assert got == ["我爱", "爱北", "北京", "ok"]


def test_content_key_is_original_sha1(spark):
    t = forum(spark, uploads=[upload(1, sha1="secure", original_sha1="orig")])
    assert an.image_info(t.uploads, CFG).first().sha1 == "orig"


def test_transport_error_is_not_a_retry(spark):
    t = forum(spark, uploads=[upload(1), upload(2)])
    info = an.image_info(t.uploads, CFG)

    def boom(pdf):
        raise an.AnalyzerCallError("service down")

    res = an.run_analyzer(info, boom)
    assert an.failed_images(info, res).count() == 0
    assert {(r.transport_error, r.error) for r in res.collect()} == {(True, "service down")}
    res2 = an.run_analyzer(info, analyzer_from({"sha1": (None, None, False), "sha2": (["x"], None, True)}))
    assert [r.id for r in an.failed_images(info, res2).collect()] == [1]


def test_merge_coalesces_and_resets_retries(spark):
    t = forum(spark, index=[index_row(1, ocr_text="old", embeddings=[1.0], retry=2),
                            index_row(2, ocr_text=None, embeddings=None, retry=1)])
    new = spark.createDataFrame([(1, "sha1", None, None, [2.0]), (3, "sha3", "new", ["new"], None)],
                                "upload_id long, sha1 string, ocr_text string, ocr_lexemes array<string>, "
                                "embeddings array<float>")
    m = {r.upload_id: r for r in ix.merge_results(t.index, new).collect()}
    assert (m[1].ocr_text, m[1].embeddings, m[1].retry_times) == ("old", [2.0], 0)
    assert m[2].retry_times == 1 and m[3].ocr_text == "new" and m[3].retry_times == 0
    again = {r.upload_id: tuple(r) for r in ix.merge_results(ix.merge_results(t.index, new), new).collect()}
    assert again == {k: tuple(v) for k, v in m.items()}  # idempotent


def test_failures_increment_and_create_rows(spark):
    t = forum(spark, index=[index_row(1, retry=2)])
    f = spark.createDataFrame([(1, 1, "sha1"), (5, 1, "sha5")], "upload_id long, n long, sha1 string")
    m = {r.upload_id: r.retry_times for r in ix.record_failures(t.index, f).collect()}
    assert m == {1: 3, 5: 1}


def test_reuse_by_content_skips_the_model(spark):
    t = forum(spark, categories=[category(1)], topics=[topic(1)], posts=[post(1)],
              uploads=[upload(1, sha1="s"), upload(2, sha1="s")], post_uploads=[(1, 1), (1, 2)],
              index=[index_row(1, sha1="s")])
    called = []

    def never(pdf):
        called.append(len(pdf))
        raise AssertionError("model must not run")

    outcomes, upserts, _ = an.process_images(t.uploads.filter("id = 2"), t, CFG, never)
    assert [(r.upload_id, r.outcome) for r in outcomes.collect()] == [(2, "reused")]
    merged = ix.merge_results(t.index, upserts)
    assert sorted(r.upload_id for r in merged.filter(F.col("sha1") == "s").collect()) == [1, 2]


def test_flag_once_for_word_in_two_images(spark):
    t = forum(spark, post_uploads=[(1, 1), (1, 2), (2, 3)],
              index=[index_row(1, ocr_text="a car"), index_row(2, ocr_text="another car"),
                     index_row(3, ocr_text="scar tissue")],
              watched_words=[("car", "flag"), ("x", "block")])
    flags = md.flag_posts(t.post_uploads.select("post_id").distinct(), t).collect()
    assert [(r.post_id, r.flag_type, r.reason) for r in flags] == [(1, "inappropriate", "watched_word")]


def test_dense_index_is_global_order(spark):
    df = spark.range(0, 1000, 7).repartition(5).withColumnRenamed("id", "k")
    got = sorted((r.k, r.idx) for r in an.dense_index(df, "k").collect())
    assert [i for _, i in got] == list(range(len(got)))


def test_rank_in_groups_over_blocks(spark):
    from pixlens.operators.ordering import RANK_BUCKET, rank_in_groups
    df = spark.range(0, 3000).select((F.col("id") % 3).alias("g"), (F.col("id") % 2).alias("k"),
                                     (F.col("id") * (RANK_BUCKET // 7)).alias("v"))
    want = {}
    for r in df.collect():
        want.setdefault(r.g, []).append((r.k, -r.v))
    want = {(g, -v): i + 1 for g, own in want.items() for i, (_, v) in enumerate(sorted(own))}
    got = {(r.g, r.v): r.rank for r in rank_in_groups(df, "g", F.col("k"), "v").collect()}
    assert got == want


def test_a_bug_in_the_model_fails_the_job(spark):
    import pytest
    t = forum(spark, uploads=[upload(1)])

    def bug(pdf):
        raise KeyError("typo")

    with pytest.raises(Exception, match="typo"):
        an.run_analyzer(an.image_info(t.uploads, CFG), bug).collect()


def _counting_model(folder):
    """Writes one file per image it is called for: content key, and what was asked of it."""
    def analyze(pdf):
        import uuid
        for r in pdf.itertuples():
            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write(f"{r.sha1} {r.run_ocr} {r.run_embed} {bytes(r.content).decode()}")
        return pd.DataFrame({"sha1": pdf["sha1"].to_numpy(), "ocr_result": [["x"]] * len(pdf),
                             "embedding": [[0.5] * 4] * len(pdf), "success": [s != "bad" for s in pdf["sha1"]]})
    return analyze


def _calls(folder):
    import os
    return sorted(open(f"{folder}/{n}").read() for n in os.listdir(folder))


def test_model_runs_once_per_content_with_the_union_of_needs(spark, tmp_path):
    t = forum(spark, uploads=[upload(1, sha1="s"), upload(2, sha1="s"), upload(3, sha1="bad"), upload(4, sha1="r"),
                              upload(5, sha1="r")],
              index=[index_row(1, sha1="s", ocr_text=None), index_row(2, sha1="s", embeddings=None),
                     index_row(4, sha1="r"), index_row(5, sha1="r", ocr_text=None, embeddings=None, retry=2)])
    files = spark.createDataFrame([(i, bytearray(f"bytes{i}".encode())) for i in range(1, 6)], "upload_id long, content binary")
    outcomes, upserts, failures = an.process_images(t.uploads.filter("id <> 4"), t, CFG, _counting_model(str(tmp_path)),
                                                    files=files)
    assert {r.upload_id: r.outcome for r in outcomes.collect()} == {1: "analyzed", 2: "analyzed", 3: "failed", 5: "reused"}
    rows = {r.upload_id: r for r in upserts.collect()}
    # Each upload stores only what it needed itself.
    assert (rows[1].ocr_text, rows[1].embeddings) == ("x", None) and (rows[2].ocr_text, rows[2].embeddings) == (None, [0.5] * 4)
    assert [(r.upload_id, r.sha1, r.n) for r in failures.collect()] == [(3, "bad", 1)]
    assert _calls(str(tmp_path)) == ["bad True True bytes3", "s True True bytes1"]
    merged = {r.upload_id: r.retry_times for r in ix.merge_results(t.index, upserts).collect()}
    assert merged[5] == 2 and merged[1] == 0  # reuse keeps the count, analysis resets it


def test_overrides_and_unrecorded_failures(spark, tmp_path):
    t = forum(spark, uploads=[upload(1), upload(2, sha1="bad")])
    files = spark.createDataFrame([(1, bytearray(b"a")), (2, bytearray(b"b"))], "upload_id long, content binary")
    outcomes, upserts, failures = an.process_images(t.uploads, t, CFG, _counting_model(str(tmp_path)), files=files,
                                                    record_failed=False, analyze_embedding=False)
    assert [(r.upload_id, r.embeddings) for r in upserts.collect()] == [(1, None)] and failures.count() == 0
    assert all(" True False " in c for c in _calls(str(tmp_path)))
    none, _, _ = an.process_images(t.uploads, t, CFG, _counting_model(str(tmp_path)), files=files, analyze_ocr=False,
                                   analyze_embedding=False)
    assert {r.outcome for r in none.collect()} == {"skipped"} and len(_calls(str(tmp_path))) == 2


def test_process_posts_flags_only_processed_posts(spark, tmp_path):
    t = forum(spark, categories=[category(1), category(2, "secret", restricted=True)], topics=[topic(1, 1), topic(2, 2)],
              posts=[post(1, 1), post(2, 2), post(3, 1)], uploads=[upload(1), upload(2), upload(3)],
              post_uploads=[(1, 1), (2, 2), (3, 3)], index=[index_row(2, ocr_text="x"), index_row(3, ocr_text="x")],
              watched_words=[("X", "flag")])
    files = spark.createDataFrame([(1, bytearray(b"a"))], "upload_id long, content binary")
    posts = spark.createDataFrame([(1,), (2,), (3,)], "post_id long")
    out, stored, _, flags = an.process_posts(posts, t, CFG, _counting_model(str(tmp_path)), files=files, auto_flag_ocr=True)
    assert [r.post_id for r in out.collect()] == [1] and [r.post_id for r in flags.collect()] == [1]
    assert an.process_posts(posts, t, CFG, _counting_model(str(tmp_path)), files=files)[3].count() == 0
    assert stored.count() == 1


def test_watched_words_of_every_form(spark):
    texts = [(1, "A Car, parked"), (2, "scar"), (3, "foo-bar baz"), (4, "foo bar"), (5, "catalogue"), (6, "wow !!! yes"),
             (7, None), (8, "a.b"), (9, "axb"), (10, "under_score"), (11, "ÉCOLE")]
    df = spark.createDataFrame(texts, "upload_id long, ocr_text string")

    def hits(*words):
        w = md.flag_words(spark.createDataFrame([(x, "flag") for x in words], "word string, action string"))
        return sorted(r.upload_id for r in md.matching_images(df, w).collect())

    assert hits("car") == [1] and hits(" Foo Bar ") == [4] and hits("foo-bar") == [3]
    assert hits("cat*") == [5] and hits("*log*") == [5] and hits("!!!") == [6] and hits("a.b") == [8]
    assert hits("score") == [] and hits("under_score") == [10] and hits("école") == [11]
    assert hits("car", "cat*", "foo bar", "zzz") == [1, 4, 5] and hits() == [] and hits("  ") == []
    many = [f"word{i}*" for i in range(1300)] + ["cat*"]
    assert hits(*many) == [5]


def test_image_bytes_are_read_and_key_the_query(spark, tmp_path):
    from pixlens.sources.files import read_upload_files
    from pixlens.streaming import memo
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "img1.png").write_bytes(b"one")
    (tmp_path / "img2.png").write_bytes(b"two")
    t = forum(spark, uploads=[upload(1), upload(2), upload(3)])
    files = read_upload_files(spark, str(tmp_path), t.uploads)
    assert {r.upload_id: bytes(r.content) for r in files.collect()} == {1: b"one", 2: b"two"}
    uri = an.image_info(t.uploads.filter("id = 1"), CFG.with_(analyze_image_base64_encoded=True), files).first().url
    assert uri == "data:image/png;base64,b25l"
    reqs = spark.createDataFrame([(1, None, False, True, "x", "ref1"), (2, None, False, True, "x", "ref2"),
                                  (3, None, True, False, "ref1", None)],
                                 "request_id long, error string, search_embeddings boolean, search_by_image boolean, "
                                 "processed_term string, image_ref string")
    images = spark.createDataFrame([(1, bytearray(b"same")), (2, bytearray(b"same"))], "request_id long, content binary")
    rows = memo.embedding_inputs(reqs, F.current_timestamp(), images)
    keys = {r.request_id: r.key for r in rows.select("request_id", memo.cache_key(F.col("kind"), F.col("content")).alias("key"))
            .collect()}
    assert keys[1] == keys[2] and keys[3] != keys[1] and keys[3].startswith("text_embedding_")


def test_lexeme_hook_and_bigrams_reach_index_and_search(spark):
    from pixlens.operators import textindex
    cfg = CFG.with_(cjk_bigrams=True, lexeme_filter=lambda c: F.array_except(c, F.array(F.lit("the"), F.lit("a"))))
    t = forum(spark, uploads=[upload(1)])
    res = an.run_analyzer(an.image_info(t.uploads, cfg), analyzer_from({"sha1": (["the car 北京市"], None, True)}))
    row = an.storable_results(an.match_results(res, an.image_info(t.uploads, cfg)), t.uploads, cfg).first()
    assert row.ocr_lexemes == ["car", "北京", "京市"]
    idx = spark.createDataFrame([(1, row.ocr_lexemes)], "upload_id long, ocr_lexemes array<string>")
    reqs = spark.createDataFrame([(1, "the 北京"), (2, "the car a"), (3, "北市")], "request_id long, processed_term string")
    hits = textindex.search_images_ocr_scan(reqs, idx, cjk_bigrams=True, lexeme_filter=cfg.lexeme_filter)
    assert sorted(r.request_id for r in hits.collect()) == [1, 2]
