"""Quality classifier: ordinal (cumulative-link) regression on graded ratings.

Grades are ordered: P(grade <= k | text) = sigmoid(threshold_k - w . x). One weight vector is shared
by all thresholds and the thresholds are kept in order. x is the set of hashed text features of the
whole text: its words, their first four
letters and a few coarse shape features (share of capitals, symbols, repeats, ...).
Weights are sparse (L1), so only the non-zero ones travel to the tasks.

Ratings come from ``labels``: quality 0 is grade 0, good but toxic is grade 1, good and not toxic is
grade 2. The model is fitted in one task on a bounded sample (``sample_rows`` rated documents, the
smallest by a hash of the id) of the rated documents; scoring covers every document.

Result: ``expected_grade`` = sum over k of P(grade > k), ``tail_probability`` = P(grade >= select_grade)
and ``keep`` = tail_probability >= ``min_tail``.

Defined cases: a null text counts as empty; ratings with a null quality are ignored, a null toxic
counts as 0; a document rated more than once takes its lowest grade; with fewer than two grades in
the sample nothing can be told apart and every document is kept with tail probability 1 (expected
grade: the one grade, or null without any); extra columns are passed through, result columns replace
input columns of the same name.
"""

from __future__ import annotations

import re
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StructType

from .common import byte_slices, materialize

N_GRADES = 3
SELECT_GRADE = 2
MIN_TAIL = 0.7
SAMPLE_ROWS = 8192
HASH_BITS = 28
MIN_DOCS = 3
L1 = 1.5e-3
RIDGE = 2e-4
STEPS = 200
RATE = 0.3

_EDGES = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = frozenset("#*$%&|<>!^~=+@{}[]\\")


def _level(x: float, steps=(0.0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9)) -> int:
    return sum(x > s for s in steps)


def features(text: str | None) -> set[int]:
    """Hashed features of a whole text."""
    words = (text or "").split()
    n = len(words)
    distinct = set(words)
    names = {"len:" + str(n.bit_length())}
    if n:
        lines = [x for x in text.split("\n") if x.strip()]
        chars = sum(map(len, words))
        names |= {
            f"upper:{_level(sum(w.isupper() and len(w) > 1 for w in words) / n)}",
            f"marks:{_level(sum(w[-1] in _MARKS for w in words) / n)}",
            f"bars:{_level(sum(w == '|' for w in words) / n)}",
            f"digits:{_level(sum(w[0].isdigit() for w in words) / n)}",
            f"same:{_level(sum(a == b for a, b in zip(words, words[1:])) / n)}",
            f"lines:{_level(1 - len(set(lines)) / len(lines))}",
            f"width:{min(20, int(chars / n))}",
        }
        if n >= 20:
            names.add(f"few:{n.bit_length()}:{int(10 * len(distinct) / n)}")
    strip = _EDGES.sub
    plain = {(w if w.isalnum() else strip("", w)).lower() for w in distinct}
    names |= {"w:" + w for w in plain}
    names |= {"p:" + w[:4] for w in plain if len(w) > 4}
    mask = (1 << HASH_BITS) - 1
    crc = zlib.crc32
    return {crc(x.encode("utf-8", "replace")) & mask for x in names}


def grades(labels: DataFrame) -> DataFrame:
    """(rated_id, grade) from quality and toxic labels."""
    grade = (F.when(F.col("quality") == 0, 0).when(F.coalesce(F.col("toxic"), F.lit(0)) != 0, 1).otherwise(2))
    return (labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
            .groupBy(F.col("doc_id").alias("rated_id")).agg(F.min(grade).alias("grade")))


def fit_arrays(rows: list, y, l1: float = L1, steps: int = STEPS, rate: float = RATE, min_docs: int = MIN_DOCS):
    """Fit on feature lists and grades; returns (hashes, weights, thresholds), hashes ascending."""
    import numpy as np

    y = np.asarray(y)
    flat = np.concatenate([np.asarray(r, dtype=np.int64) for r in rows])
    flat.sort()
    hashes = flat[np.flatnonzero(np.diff(flat, prepend=-1))]
    hashes = hashes[np.diff(np.searchsorted(flat, hashes), append=len(flat)) >= min_docs]
    del flat
    found = [np.searchsorted(hashes, r) for r in rows]
    found = [i[(i < len(hashes)) & (hashes[np.minimum(i, len(hashes) - 1)] == r)].astype(np.int32) if len(hashes) else i[:0]
             for i, r in zip(found, rows)]
    row = np.repeat(np.arange(len(rows), dtype=np.int32), [len(i) for i in found])
    col = np.concatenate(found).astype(np.int32)
    del found
    n, top = len(y), N_GRADES - 1
    share = np.clip(np.cumsum(np.bincount(y, minlength=N_GRADES))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    theta = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])  # first, log of the gaps
    w, gw, gt = np.zeros(len(hashes)), np.full(len(hashes), 1e-8), np.full(top, 1e-8)

    def sigmoid(z):
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))

    for step in range(steps):
        cuts = np.concatenate([[-np.inf], np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])])), [np.inf]])
        f = np.bincount(row, weights=w[col], minlength=n)
        hi, lo = sigmoid(cuts[y + 1] - f), sigmoid(cuts[y] - f)
        p = np.maximum(hi - lo, 1e-12)
        df = (1 - hi - lo) / n
        g = np.bincount(col, weights=df[row], minlength=len(hashes)) + RIDGE * w
        up, down = -hi * (1 - hi) / p / n, lo * (1 - lo) / p / n
        dcut = np.bincount(y, weights=up, minlength=N_GRADES)[:-1] + np.bincount(y, weights=down, minlength=N_GRADES)[1:]
        dtheta = np.cumsum(dcut[::-1])[::-1].copy()
        dtheta[1:] *= np.exp(theta[1:])
        gw += g * g
        gt += dtheta * dtheta
        w -= rate * g / np.sqrt(gw)
        w = np.sign(w) * np.maximum(np.abs(w) - rate * l1 / np.sqrt(gw), 0)
        theta -= rate * dtheta / np.sqrt(gt)
        if step == steps // 2:  # then refit the chosen features, without the pull of L1 towards zero
            chosen, l1 = w != 0, 0.0
        if step >= steps // 2:
            w[~chosen] = 0.0
    used = w != 0
    return hashes[used], w[used], np.cumsum(np.concatenate([theta[:1], np.exp(theta[1:])]))


def _feature_rows(batches):
    import pyarrow as pa

    for b in batches:
        for part in byte_slices(b, 0):
            texts, marks = part.column(0).to_pylist(), part.column(1)
            yield pa.RecordBatch.from_arrays(
                [marks, pa.array([sorted(features(t)) for t in texts], type=pa.list_(pa.int64()))], names=["grade", "x"])


def _fit(pdf):
    import pandas as pd

    pdf = pdf.sort_values("order")
    h, w, cuts = fit_arrays(pdf["x"].tolist(), pdf["grade"].to_numpy())
    return pd.DataFrame({"hashes": [h.tolist()], "weights": [w.tolist()], "thresholds": [cuts.tolist()]})


def fit(documents: DataFrame, rated: DataFrame, sample_rows: int = SAMPLE_ROWS, text_col: str = "text",
        id_col: str = "doc_id") -> dict:
    """The model {hashes, weights, thresholds}, or {only: grade or None} when there are no two grades.

    ``rated`` is (rated_id, grade). At most ``sample_rows`` rows reach the one fitting task.
    """
    sample = materialize(rated.orderBy(F.xxhash64("rated_id"), "rated_id").limit(sample_rows), "ordinal-sample")
    found = [r.grade for r in sample.select("grade").distinct().collect()]
    if len(found) < 2:
        return {"only": found[0] if found else None}
    # A repeated document id counts once, with the text of the smallest hash.
    picked = (documents.select(F.col(id_col).alias("rated_id"), F.col(text_col).alias("text"))
              .join(F.broadcast(sample), "rated_id").select("text", "grade")
              .mapInArrow(_feature_rows, "grade int, x array<long>")
              .withColumn("order", F.xxhash64("x")))
    model = (picked.orderBy("order").limit(sample_rows).groupBy(F.lit(0).alias("all"))
             .applyInPandas(_fit, "hashes array<long>, weights array<double>, thresholds array<double>").collect())
    if not model:
        return {"only": None}
    return {"hashes": model[0].hashes, "weights": model[0].weights, "thresholds": model[0].thresholds}


def _score(model, at: int):
    def run(batches):
        import math

        import pyarrow as pa

        m = model.value
        if "only" in m:
            for b in batches:
                n, g = b.num_rows, m["only"]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns, pa.array([None if g is None else float(g)] * n, pa.float64()),
                     pa.array([1.0] * n, pa.float64())],
                    names=[*b.schema.names, "expected_grade", "tail_probability"])
            return
        weight = dict(zip(m["hashes"], m["weights"], strict=True))
        cuts = m["thresholds"]
        for b in batches:
            for part in byte_slices(b, at):
                expected, tail = [], []
                for text in part.column(at).to_pylist():
                    f = math.fsum(weight[h] for h in features(text) if h in weight)
                    above = [1 / (1 + math.exp(min(500.0, max(-500.0, c - f)))) for c in cuts]  # P(grade > k)
                    expected.append(math.fsum(above))
                    tail.append(above[SELECT_GRADE - 1])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(expected, pa.float64()), pa.array(tail, pa.float64())],
                    names=[*part.schema.names, "expected_grade", "tail_probability"])
    return run


def score(documents: DataFrame, model: dict, min_tail: float = MIN_TAIL, text_col: str = "text") -> DataFrame:
    """Add expected_grade, tail_probability and keep to every document. The model is bounded by its sample."""
    base = documents.drop("expected_grade", "tail_probability", "keep")
    schema = StructType([*base.schema.fields]).add("expected_grade", DoubleType()).add("tail_probability", DoubleType())
    shared = base.sparkSession.sparkContext.broadcast(model)
    scored = base.mapInArrow(_score(shared, base.columns.index(text_col)), schema)
    return scored.withColumn("keep", (F.col("tail_probability") >= min_tail).cast(BooleanType()))
