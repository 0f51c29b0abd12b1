"""Driver contract, streaming replays, snapshots."""

from __future__ import annotations

import os

import __spark_entry__ as entry_mod
from conftest import index_row, forum
from pyspark.sql import functions as F

from pixlens.operators import index_store as ix
from pixlens.streaming import ingest


def test_contract_keys(spark):
    qs, orc = entry_mod.queries(), entry_mod.oracle_sql()
    assert set(orc) <= set(qs)
    assert len(qs) >= 80


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.columns == ["request_id", "post_id", "upload_id", "rank"]
    assert df.count() > 0


def test_deltas_fold_in_order_and_replay_without_effect(spark, tmp_path):
    t = forum(spark, index=[index_row(1, ocr_text="old", embeddings=None, retry=2), index_row(2, retry=1)])
    deltas = ix.IndexDeltas(t.index, str(tmp_path / "index"))
    rows = "upload_id long, sha1 string, ocr_text string, ocr_lexemes array<string>, embeddings array<float>"
    stored = lambda *r: spark.createDataFrame(list(r), rows)
    failed = lambda *r: spark.createDataFrame(list(r), "upload_id long, sha1 string, n long")
    view = lambda: {r.upload_id: (r.ocr_text, r.embeddings, r.retry_times) for r in deltas.read().collect()}
    assert view()[1] == ("old", None, 2)
    deltas.write("a", 0, stored((1, "sha1", None, None, [1.0])), failed((2, "sha2", 1), (3, "sha3", 1)))
    first = view()
    assert first[1] == ("old", [1.0], 0) and first[2][2] == 2 and first[3] == (None, None, 1)
    deltas.write("a", 0, stored((1, "sha1", None, None, [1.0])), failed((2, "sha2", 1), (3, "sha3", 1)))
    assert view() == first
    # A new stream starts at batch 0 again and still counts.
    deltas.write("b", 0, stored((3, "sha3", "new", ["new"], None)), failed((1, "sha1", 1)))
    second = view()
    assert second[3] == ("new", None, 0) and second[1] == ("old", [1.0], 1)
    (tmp_path / "index" / "s000009-half" / "b000000000000").mkdir(parents=True)  # not committed: ignored
    assert view() == second
    kept = deltas.read(without=deltas.path("b", 0))
    assert {r.upload_id: r.retry_times for r in kept.collect()} == {1: 0, 2: 2, 3: 1}


def test_events_are_dropped_by_event_time_gap(spark, tmp_path):
    events = [(1, "00:00:00", 1), (2, "00:01:00", 1), (3, "00:11:00", 1), (4, "00:11:01", 1), (5, "00:02:00", 2),
              (6, "05:00:00", 1), (7, "05:00:00", 2), (8, "06:00:00", 3)]
    spark.createDataFrame([(e, f"2024-01-01 {at}", p, "create") for e, at, p in events],
                          "event_id long, ts string, post_id long, kind string").select(
        "event_id", F.to_timestamp("ts").alias("ts"), "post_id", "kind").coalesce(1).write.parquet(str(tmp_path / "in"))
    # One file: several would arrive in any order, and events hours behind the watermark are dropped by Spark.
    s = spark.readStream.schema("event_id long, ts timestamp, post_id long, kind string").option(
        "maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = ingest.dedup_events(s).writeStream.format("parquet").option("path", str(tmp_path / "out")) \
        .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted(r.event_id for r in spark.read.parquet(str(tmp_path / "out")).collect())
    # 2 follows 1, 3 follows 2 by exactly the gap, 4 follows 3; the watermark has not reached 8.
    assert got == [1, 5, 6, 7]


def test_streamed_batches_keep_retry_and_flags_once(spark, tmp_path):
    from conftest import category, post, topic, upload
    from pixlens.config import Settings
    cfg = Settings(enabled=True, analyze_ocr_enabled=True, analyze_embedding_enabled=True, auto_flag_ocr=True, embedding_dim=4)
    t = forum(spark, categories=[category(1)], topics=[topic(1)], posts=[post(1), post(2)], uploads=[upload(1), upload(2)],
              post_uploads=[(1, 1), (2, 2)], watched_words=[("car", "flag")])
    answers = spark.createDataFrame([("sha1", ["a car"], [1.0] * 4, True), ("sha2", None, None, False)],
                                    "sha1 string, ocr_result array<string>, embedding array<float>, success boolean")
    deltas = ix.IndexDeltas(t.index, str(tmp_path / "index"))
    body = ingest.IngestBatch(t, cfg, answers, deltas, "s", flags_path=str(tmp_path / "flags"))
    batch = spark.createDataFrame([(1,), (2,)], "post_id long")
    for _ in range(2):
        body(batch, 0)
        assert {r.upload_id: r.retry_times for r in deltas.read().collect()} == {1: 0, 2: 1}
        assert [r.post_id for r in spark.read.parquet(str(tmp_path / "flags" / "s" / "*")).collect()] == [1]
    body(batch, 1)
    assert {r.upload_id: r.retry_times for r in deltas.read().collect()} == {1: 0, 2: 2}


def test_imports_without_the_training_data_folder(tmp_path):
    """What is left when the subpackage and the pipeline are deleted still gives its queries."""
    import shutil
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(os.path.join(root, "pixlens"), tmp_path / "pixlens", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(root, "__spark_entry__.py"), tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); "
                          "assert 'pipeline' not in q; print(len(q))"], cwd=tmp_path, capture_output=True, text=True,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    assert out.returncode == 0 and int(out.stdout) >= 80, out.stderr
