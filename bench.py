"""

Runs on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]``; one warm-up, then the median of ``$BENCH_REPS`` runs,
each forced with a ``noop`` write. Prints ONE JSON line.

Setup (not timed): the test forum's image index and vector index are written
once to Parquet, as a deployment keeps them (lexemes and codes stored).
Request batches are derived from the tables (document words, stored vectors).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from pixlens.config import TEST_SETTINGS  # noqa: E402
from pixlens.operators import analysis as an  # noqa: E402
from pixlens.operators import eligibility as el  # noqa: E402
from pixlens.operators import index_store as ix  # noqa: E402
from pixlens.operators import bitmaps, cells, filters, knn, moderation, requests, results, search, textindex  # noqa: E402
from pixlens.session import build_session, ship_package  # noqa: E402
from pixlens.sources.testforum import BASE_URL, TestForum  # noqa: E402
from pixlens.streaming import ingest  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
REPS = int(os.environ.get("BENCH_REPS", "3"))
CFG = TEST_SETTINGS.with_(base_url=BASE_URL, text_similarity_threshold=0.1)
DIM = CFG.embedding_dim


def timed(fn) -> float:
    fn().write.format("noop").mode("overwrite").save()  # warm-up
    runs = []
    for _ in range(REPS):
        t0 = time.perf_counter()
        fn().write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - t0)
    return round(statistics.median(runs), 3)


def main() -> None:
    spark = build_session(f"local[{CPUS}]", max(8, CPUS),
                          extra={"spark.sql.files.maxPartitionBytes": str(64 * 1024 * 1024)})
    ship_package(spark)
    scratch = tempfile.mkdtemp(prefix="pixlens-bench-", dir=os.environ.get("PIXLENS_SCRATCH", "/tmp"))
    f = TestForum(spark, SF_DIR)

    # ---- setup: host tables, index (lexemes stored) and vector index (codes + norms) as Parquet
    base = f.tables()
    stored_tables = {}
    for name in ("posts", "topics", "categories", "tags", "topic_tags", "users", "uploads", "post_uploads",
                 "custom_emojis", "optimized_images", "watched_words", "index"):
        getattr(base, name).write.parquet(f"{scratch}/{name}")
        stored_tables[name] = spark.read.parquet(f"{scratch}/{name}")
    index = stored_tables["index"]
    knn.vector_index(index, DIM).write.parquet(f"{scratch}/vindex")
    vindex = spark.read.parquet(f"{scratch}/vindex")
    # x50 copies with a deterministic per-copy perturbation, to show the scan at scale
    emb = f.base("embeddings")
    rep = emb.select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("c"), "vec_id", "embedding").select(
        (F.col("vec_id") * 50 + F.col("c")).alias("upload_id"),
        F.transform("embedding", lambda x, i: x + F.lit(0.05) * F.sin(F.col("c") * 7.0 + i)).alias("embeddings"))
    knn.vector_index(rep, DIM).write.parquet(f"{scratch}/vindex50")
    vindex50 = spark.read.parquet(f"{scratch}/vindex50")
    knn.band_table(vindex50, DIM).write.parquet(f"{scratch}/bands50")
    bands50 = spark.read.parquet(f"{scratch}/bands50")
    knn.band_table(vindex, DIM).write.parquet(f"{scratch}/bands")
    bands = spark.read.parquet(f"{scratch}/bands")
    celled = {}
    for name, v in (("", vindex), ("_x50", vindex50)):
        model = cells.fit(v, DIM)
        cells.write_cells(cells.assign(v, model), f"{scratch}/cells{name}")
        celled[name] = model, cells.read_cells(spark, f"{scratch}/cells{name}")
    f.answers.write.parquet(f"{scratch}/answers")
    answers = spark.read.parquet(f"{scratch}/answers")
    t = base.replace(**stored_tables)
    # the inverted index (bitmaps partitioned by lexeme bucket) is part of the stored index
    bitmaps.write_bitmaps(bitmaps.bitmap_postings(index), f"{scratch}/bitmaps")
    postings = bitmaps.read_bitmaps(spark, f"{scratch}/bitmaps")

    def ocr_requests(n: int):
        docs = f.base("documents").filter(F.col("doc_id") < n)
        return docs.select(F.col("doc_id").alias("request_id"), F.lit("GET").alias("method"),
                           F.element_at(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), 0), 1)
                           .alias("term"),
                           F.lit(None).cast("string").alias("image_ref"),
                           F.lit(None).cast("string").alias("image_content_type"),
                           F.lit("true").alias("ocr"), F.lit("false").alias("embed"),
                           F.lit(0).cast("long").alias("page"), F.lit(None).cast("long").alias("current_user_id"))

    def knn_queries(n: int):
        return emb.filter(F.col("vec_id") < n).select(
            F.col("vec_id").alias("request_id"), F.col("embedding").alias("qvec"),
            F.lit(0.1).alias("threshold"), F.lit(20).alias("limit"), F.lit(0).alias("offset"))

    info = an.image_info(el.uploads_needing_analysis(t, CFG), CFG)
    stored = an.storable_results(an.match_results(an.run_analyzer(info, answers), info), f.uploads, CFG)
    stored.write.parquet(f"{scratch}/stored")
    stored_rows = spark.read.parquet(f"{scratch}/stored")

    q = {}
    q["eligible_posts"] = timed(lambda: el.filter_posts(t.posts, t, CFG))
    q["eligible_uploads"] = timed(lambda: el.filter_uploads(t.uploads, t, CFG))
    q["uploads_needing_analysis"] = timed(lambda: el.uploads_needing_analysis(t, CFG, with_posts=True))
    q["stale_index_rows"] = timed(lambda: el.stale_index_rows(t, CFG))
    q["postings"] = timed(lambda: textindex.postings(index))
    for n in (1, 100):
        q[f"search_ocr_{n}"] = timed(lambda n=n: search.search(
            ocr_requests(n), t, CFG, f.request_embeddings.limit(0), postings=postings, vindex=vindex).results)
    for n in (1, 100, 1000):
        q[f"knn_rerank_{n}"] = timed(lambda n=n: knn.search_images_embedding(knn_queries(n), index, DIM, vindex=vindex))
    q["knn_rerank_100_x50"] = timed(lambda: knn.search_images_embedding(
        knn_queries(100), index, DIM, vindex=vindex50))
    q["knn_lsh_100_x50"] = timed(lambda: knn.knn_lsh(knn_queries(100), index, DIM, vindex=vindex50, bands=bands50))
    q["knn_lsh_100"] = timed(lambda: knn.knn_lsh(knn_queries(100), index, DIM, vindex=vindex, bands=bands))
    fixed15 = f.search_requests.filter(F.col("request_id") <= 15)
    for name, (model, images) in celled.items():
        q[f"knn_cells_100{name}"] = timed(lambda m=model, i=images: cells.search(knn_queries(100), i, m, DIM))
    q["search_mixed_15"] = timed(lambda: search.search(fixed15, t, CFG, f.request_embeddings,
                                                         postings=postings, vindex=vindex).results)
    # every user turn of `conversations` as a request (text + image on half of them)
    q["search_conversations"] = timed(lambda: search.search(f.search_requests, t, CFG, f.request_embeddings,
                                                              postings=postings, vindex=vindex).results)
    q["merge_results"] = timed(lambda: ix.merge_results(index, stored_rows))
    q["flag_posts"] = timed(lambda: moderation.flag_posts(t.post_uploads.select("post_id").distinct(), t))

    def analyzed():
        return an.process_images(el.uploads_needing_analysis(t, CFG), t, CFG, answers)[1]

    def filtered():
        r = search.prepare_requests(fixed15).filter(F.col("error").isNull() & F.col("search_ocr"))
        pairs = search.post_pairs(bitmaps.search_bitmaps(r, postings), t)
        return filters.apply_filters(pairs, requests.filter_rows(r.filter(F.size("filters") > 0)), t)

    def response():
        out = search.search(fixed15, t, CFG, f.request_embeddings, postings=postings, vindex=vindex)
        return results.envelope(out.envelope, results.hydrate(out.results, t))

    def ingested():
        root = tempfile.mkdtemp(prefix="deltas-", dir=scratch)
        deltas = ix.IndexDeltas(index, root)
        ingest.IngestBatch(t, CFG, answers, deltas, "bench")(f.post_events.select("post_id"), 0)
        return deltas.read()

    q["process_images"] = timed(analyzed)
    q["apply_filters"] = timed(filtered)
    q["search_response_15"] = timed(response)
    q["ingest_batch"] = timed(ingested)

    # recall@20 of LSH vs exact, on all stored vectors and on the x50 index (reported, not timed)
    def recall_of(n, **kw):
        every = emb.select(F.col("vec_id").alias("request_id"), F.col("embedding").alias("qvec"), F.lit(0.1).alias("threshold"),
                           F.lit(20).alias("limit"), F.lit(0).alias("offset")).filter(F.col("request_id") < n)
        a = knn.search_images_embedding(every, index, DIM, vindex=kw["vindex"]).select("request_id", "upload_id")
        b = knn.knn_lsh(every, index, DIM, **kw).select("request_id", "upload_id")
        total = a.count()
        return round(a.join(b, ["request_id", "upload_id"]).count() / total, 4) if total else None

    def cell_figures(v, model, images):
        asked = knn_queries(100)
        a = knn.search_images_embedding(asked, index, DIM, vindex=v).select("request_id", "upload_id")
        b = cells.search(asked, images, model, DIM).select("request_id", "upload_id")
        return {"recall_at_20": round(a.join(b, ["request_id", "upload_id"]).count() / max(a.count(), 1), 4),
                "share_of_pairs": round(cells.share_of_pairs(asked, images, model), 4), "cells": len(model.centres),
                "probes": model.probes}

    total = round(sum(q.values()), 3)
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": total, "unit": "sec", "queries": q,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""), "cpus": CPUS,
                      "cells": cell_figures(vindex, *celled[""]), "cells_x50": cell_figures(vindex50, *celled["_x50"]),
                      "lsh_recall_at_20": recall_of(1 << 60, vindex=vindex, bands=bands),
                      "lsh_recall_at_20_x50": recall_of(100, vindex=vindex50, bands=bands50)}))
    spark.stop()


if __name__ == "__main__":
    main()
