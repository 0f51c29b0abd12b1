"""Approximate vector search over a learned partition (V6).

``fit`` learns cells on a bounded sample (``SAMPLE_VALUES`` numbers, chosen by the hash of the id): spherical
k-means, and the number of cells a request has to probe so that the sample's own nearest neighbours are
found with the wanted recall. ``assign`` gives every indexed image its cell, ``write_cells`` stores the cells
as a partitioned table. ``search`` sends each request to the blocks of its nearest cells only; a block holds
several small cells or a part of a large one, so a cell may hold any share of the index, and its images are scored
and reranked like in the exact search. On vectors without structure cells prune little, and ``fit`` then asks for many probes:
``share_of_pairs`` tells which part of all (request, image) pairs is scored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import knn

SAMPLE_VALUES = 1 << 23  # rows x dimensions of the sample, 32 MB
MAX_CELLS = 4096
ROUNDS = 10
CALIBRATE = 256  # sampled vectors that serve as requests


@dataclass
class Cells:
    centres: np.ndarray  # cells x dim, unit length
    probes: int
    recall: float  # of the calibration

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The n cells of each row, nearest first."""
        score = x.astype(np.float32) @ self.centres.T
        n = min(n, len(self.centres))
        top = np.argpartition(-score, n - 1, axis=1)[:, :n]
        return np.take_along_axis(top, np.argsort(-np.take_along_axis(score, top, axis=1), axis=1, kind="stable"), axis=1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)


def _kmeans(x: np.ndarray, cells: int) -> np.ndarray:
    centres = x[np.unique(np.linspace(0, len(x) - 1, cells).astype(int))].copy()
    for _ in range(ROUNDS):
        own = (x @ centres.T).argmax(axis=1)
        order = np.argsort(own, kind="stable")
        at = np.searchsorted(own[order], np.arange(len(centres)))
        sums = np.add.reduceat(x[order], np.minimum(at, len(x) - 1), axis=0)
        filled = np.bincount(own, minlength=len(centres)) > 0
        centres[filled] = _unit(sums)[filled]
    return centres


def fit(vindex: DataFrame, dim: int, recall: float = 0.9, neighbours: int = 20, oversample: float = 2,
        cells: int | None = None, sample_values: int = SAMPLE_VALUES) -> Cells:
    """Cells and probes learned on a sample of at most ``sample_values // dim`` vectors."""
    n = vindex.count()
    rows = max(1, min(n, sample_values // dim))
    sample = vindex.filter("norm > 0").select("embeddings").orderBy(F.xxhash64("upload_id"), "upload_id").limit(rows).toPandas()
    if sample.empty:
        return Cells(np.zeros((1, dim), dtype=np.float32), 1, 1.0)
    x = _unit(np.stack(sample["embeddings"].to_numpy()).astype(np.float32))
    want = min(max(1, round(2 * math.sqrt(n))), MAX_CELLS, len(x)) if cells is None else min(cells, len(x))
    # Vectors held back from the fit are the requests of the calibration, where there are enough.
    asked = np.arange(0, len(x), max(5, -(-len(x) // CALIBRATE))) if len(x) >= 20 else np.arange(len(x))
    taught = np.delete(x, asked, axis=0) if len(x) >= 20 else x
    model = Cells(_kmeans(taught, min(want, len(taught))), 1, 0.0)
    # What the exact search finds for each among the other vectors, and how much of it the probed cells give:
    # fewer candidates also let images in that the exact search has cut by their distance.
    own = (x @ model.centres.T).argmax(axis=1)
    place = np.argsort(model.nearest(x[asked], len(model.centres)), axis=1)  # place[q, cell]
    signs, k = np.where(x > 0, np.float32(1), np.float32(-1)), math.ceil(oversample * neighbours)
    tried = np.unique(np.ceil(len(model.centres) * np.linspace(0, 1, 65) ** 2).astype(int))[1:]
    hits, total = np.zeros(len(tried)), 0
    for i, q in enumerate(asked):
        order = np.argsort(-(signs @ signs[q]), kind="stable")
        order = order[order != q]
        reach = place[i, own[order]]

        def answer(near):
            return near[np.argsort(-(x[near] @ x[q]), kind="stable")[:neighbours]]

        truth = answer(order[:k])
        total += len(truth)
        hits += [np.isin(truth, answer(order[np.nonzero(reach < p)[0][:k]])).sum() for p in tried]
    share = hits / total if total else np.ones(len(tried))
    enough = np.nonzero(share >= recall + (1 - recall) / 5)[0]
    at = int(enough[0]) if len(enough) else len(tried) - 1
    model.probes, model.recall = int(tried[at]), float(share[at])
    return model


def _matrix(column: pd.Series) -> np.ndarray:
    return _unit(np.stack(column.to_numpy()).astype(np.float32))


def assign(vindex: DataFrame, model: Cells) -> DataFrame:
    """``vindex`` with the cell of every image."""
    shared = vindex.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("int")
    def cell(vec: pd.Series) -> pd.Series:
        return pd.Series(np.concatenate([shared.value.nearest(_matrix(vec.iloc[i:i + 1024]), 1)[:, 0] for i in range(0, len(vec), 1024)]
                                        or [np.zeros(0, dtype=int)]).astype(np.int32))
    return vindex.withColumn("cell", cell("embeddings"))


def write_cells(assigned: DataFrame, path: str, salt: int = 8) -> None:
    """The images partitioned by cell; a cell is written by up to ``salt`` tasks."""
    part = F.pmod(F.xxhash64("upload_id"), F.lit(salt))
    assigned.repartition("cell", part).write.mode("overwrite").partitionBy("cell").parquet(path)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def probed(queries: DataFrame, model: Cells, probes: int | None = None) -> DataFrame:
    """``queries`` once for each cell that they probe."""
    shared, n = queries.sparkSession.sparkContext.broadcast(model), probes or model.probes

    @F.pandas_udf("array<int>")
    def cells(vec: pd.Series) -> pd.Series:
        return pd.Series([r.astype(np.int32) for r in shared.value.nearest(_matrix(vec), n)] if len(vec) else [], dtype=object)
    return queries.withColumn("cell", F.explode(cells("qvec")))


def _blocks(images: DataFrame, rows: int) -> list[tuple[int, int, int]]:
    """(cell, block, parts): small cells share a block of about ``rows`` images, a larger one is cut into blocks of its own.

    The counts have one row per cell, at most ``MAX_CELLS``.
    """
    out, block, room = [], -1, 0
    for cell, n in sorted(map(tuple, images.groupBy("cell").count().collect())):
        if n > rows:
            parts = -(-n // rows)
            out.append((cell, block + 1, parts))
            block, room = block + parts, 0
            continue
        if n > room:
            block, room = block + 1, rows
        out.append((cell, block, 1))
        room -= n
    return out


def _probed_rows(shared, probes: int):
    """For ``knn._block_top``: the rows of a block that lie in the cells that a request probes."""
    def rows_of(images, requests):
        cell, model = images["cell"].to_numpy(np.int64), shared.value
        near = np.concatenate([model.nearest(_matrix(requests["qvec"].iloc[i:i + 1024]), probes) for i in range(0, len(requests), 1024)])

        def rows(i):
            seen = np.zeros(len(model.centres), dtype=bool)
            seen[near[i]] = True
            return np.flatnonzero(seen[cell])
        return rows
    return rows_of


def search(queries: DataFrame, images: DataFrame, model: Cells, dim: int, oversample: float = 2, probes: int | None = None,
           queries_per_block: int = knn.QUERIES_PER_BLOCK, block_cells: int = knn.BLOCK_CELLS) -> DataFrame:
    """V4 over the probed cells: request_id, upload_id, rank, similarity.

    ``queries``: request_id, qvec, threshold, limit, offset; ``images``: the assigned index. Blocks hold whole
    cells, as many as fit: a request goes once to each block that has any of its cells, looks at the images of its
    cells only, and its best candidates of the block leave it. Neither the requests nor the candidates grow with the
    number of cells probed.
    """
    spark = images.sparkSession
    q = knn._with_k(queries, dim, oversample).filter(F.col("k") > 0)
    asked = q.filter(F.col("qvec").isNotNull()).select("request_id", "qvec", "qcode", F.col("k").cast("long").alias("k"))
    n_queries, deepest = asked.agg(F.count("*"), F.max("k")).first()
    places = _blocks(images, max(1, block_cells // dim))
    n_blocks = max((b + parts for _, b, parts in places), default=1)
    qb = knn.block_counts(spark, n_blocks, n_queries, 1, queries_per_block, 1)[1]
    shared, n = spark.sparkContext.broadcast(model), probes or model.probes
    of_cell = [(0, 0)] * len(model.centres)
    for cell, block, parts in places:
        of_cell[cell] = (block, parts)
    at = spark.sparkContext.broadcast(of_cell)

    @F.pandas_udf("array<int>")
    def blocks(vec: pd.Series) -> pd.Series:
        near = shared.value.nearest(_matrix(vec), n) if len(vec) else []
        return pd.Series([np.array(sorted({b + j for c in row for b, parts in [at.value[c]] for j in range(parts)}), dtype=np.int32)
                          for row in near], dtype=object)

    table = F.broadcast(spark.createDataFrame(places or [(0, 0, 1)], "cell int, block int, parts int"))
    left = images.join(table, "cell").select(
        "cell", "upload_id", "code", (F.col("block") + F.pmod(F.xxhash64("upload_id"), F.col("parts"))).cast("int").alias("ib"),
        knn.every_block(qb).alias("qb"))
    right = asked.select("*", knn.block_of("request_id", qb).alias("qb"), F.explode(blocks("qvec")).alias("ib"))
    cands = left.groupBy("ib", "qb").cogroup(right.groupBy("ib", "qb")).applyInPandas(
        knn._block_top(dim, rows_of=_probed_rows(shared, n)), knn.CANDS_DDL)
    return knn.rerank(knn.select_candidates(cands, deepest or 0), images, q)


def share_of_pairs(queries: DataFrame, images: DataFrame, model: Cells, probes: int | None = None) -> float:
    """Scored (request, image) pairs over all pairs."""
    sizes = images.groupBy("cell").agg(F.count("*").alias("n"))
    pairs = probed(queries.select("request_id", "qvec"), model, probes).join(F.broadcast(sizes), "cell").agg(F.sum("n")).first()[0]
    total = queries.count() * images.count()
    return (pairs or 0) / total if total else 0.0
