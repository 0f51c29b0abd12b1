"""Embedding whitening from an incremental eigendecomposition of the scatter matrix.

1. *Local spectra*: every task keeps count, mean, eigenvalues and eigenvectors of the rows it has seen.
   A block of rows is centred on its own mean and condensed to its triangular factor, whose rows have
   the block's scatter; each of these rows, and the move of the mean, is one rank-one update. An update
   deflates (components of the vector that vanish, poles that coincide), solves the secular equation
   for all other eigenvalues and rebuilds the eigenvectors from the roots.
2. *Combination*: spectra of different tasks are merged by rank-one updates with the scaled eigenvectors
   of the other, ``FAN`` spectra to a task, level by level. One spectrum (d * d numbers) is left.
3. *Refinement*: one more distributed pass centres every row exactly, projects it on the spectrum's basis
   and sums the small scatter matrix; its eigenvectors (Rayleigh-Ritz) correct the basis to double
   precision.

Entries are integers, so count and sums are exact; rows are centred as integers before anything is
multiplied.

Defined cases: vectors that are null or hold a null or non-finite entry take no part, nor do vectors
whose length is not the most frequent one (ties: the longer); a null id is kept like any other; repeated
rows count as often as they stand; components whose eigenvalue is not above rounding (fewer rows than
components, constant entries) are left out; an empty table gives no rows. Entries of 2**42 and more raise.
Other columns are not read.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
FAN = 16
MAX_DIM = 4096  # a spectrum is dim * dim doubles, held by each task and by the driver
MAX_ENTRY = 2.0 ** 42
BLOCK_CELLS = 1 << 20

OUT = "vec_id long, component int, n long, deviation long, deviation_exact string, whitened double, explained double"


def rank_one(values, vectors, x):
    """Eigenvalues (ascending) and eigenvectors of ``vectors @ diag(values) @ vectors.T + x x.T``."""
    import numpy as np

    eps = np.finfo(float).eps
    z, d, q = vectors.T @ x, values.copy(), vectors.copy()
    size = float(z @ z)
    if size == 0.0:
        return values, vectors
    tol = 8 * eps * max(abs(d[0]), abs(d[-1]), size)
    # Coinciding poles: a rotation moves the weight of both into one of them.
    live = [j for j in range(len(d)) if abs(z[j]) * np.sqrt(size) > tol]
    kept: list[int] = []
    for j in live:
        if kept:
            i = kept[-1]
            r = np.hypot(z[i], z[j])
            c, s = z[j] / r, z[i] / r
            if abs((d[j] - d[i]) * c * s) <= tol:
                qi, qj = q[:, i].copy(), q[:, j].copy()
                q[:, i], q[:, j] = c * qi - s * qj, s * qi + c * qj
                di, dj = d[i], d[j]
                d[i], d[j] = di * c * c + dj * s * s, di * s * s + dj * c * c
                z[i], z[j] = 0.0, r
                kept[-1] = j
                continue
        kept.append(j)
    if kept:
        k = np.array(kept)
        k = k[np.argsort(d[k], kind="stable")]
        roots, w = _secular(d[k], z[k])
        d[k] = roots
        q[:, k] = q[:, k] @ w
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


def _secular(d, z):
    """Roots of ``1 + sum(z**2 / (d - t)) = 0`` and the eigenvectors of ``diag(d) + z z.T``; d ascending and distinct."""
    import numpy as np

    m, z2 = len(d), z * z
    upper = np.append(d[1:], d[-1] + z2.sum())
    gap = upper - d
    # A root is held as the distance from its nearer pole, which keeps differences to poles accurate.
    with np.errstate(all="ignore"):
        delta_mid = d[None, :] - (d + gap / 2)[:, None]
        f_mid = 1 + (z2[None, :] / delta_mid).sum(1)
        left = f_mid >= 0
        left[-1] = True
        origin = np.where(left, d, upper)
        lo = np.where(left, 0.0, -gap / 2)
        hi = np.where(left, gap / 2, 0.0)
        hi[-1] = gap[-1]
        mu = (lo + hi) / 2
        delta = d[None, :] - origin[:, None]
        low = np.tri(m, dtype=bool)
        pole_l, pole_r = d - origin, upper - origin
        for _ in range(60):
            diff = delta - mu[:, None]
            terms = z2[None, :] / diff
            slopes = terms / diff
            f = 1 + terms.sum(1)
            lo, hi = np.where(f < 0, mu, lo), np.where(f < 0, hi, mu)
            psi, phi = np.where(low, slopes, 0).sum(1), np.where(low, 0, slopes).sum(1)
            a1, a2 = pole_l - mu, pole_r - mu
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b, c = a1 * a2 * f, f - a1 * psi - a2 * phi
            root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
            step = np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
            new = mu + step
            new = np.where(np.isfinite(new) & (new > lo) & (new < hi), new, (lo + hi) / 2)
            # At the rounding of f itself no step can improve a root.
            done = (np.abs(f) <= 4e-16 * (8 + np.abs(terms).sum(1))) | (np.abs(new - mu) <= 4e-16 * np.abs(mu))
            mu = np.where(done, mu, new)
            if done.all():
                break
        diff = delta - mu[:, None]  # diff[i, j] = d[j] - root[i]
        # The vector for which these roots are exact, so that the eigenvectors are orthogonal.
        poles = d[None, :] - d[:, None]
        np.fill_diagonal(poles, 1.0)
        exact = np.sign(z) * np.sqrt(np.abs(np.prod(-diff.T / poles, axis=1)))
        w = exact[:, None] / diff.T
        w /= np.linalg.norm(w, axis=0)
    return origin + mu, w


@dataclass
class Spectrum:
    """Count, exact sums, mean and eigenpairs (ascending) of the scatter matrix of some rows."""

    n: int
    sums: list
    mean: object
    values: object
    vectors: object

    @staticmethod
    def empty(dim: int) -> "Spectrum":
        import numpy as np

        return Spectrum(0, [0] * dim, np.zeros(dim), np.zeros(dim), np.eye(dim))

    def _scatter(self, n: int, sums, mean, rows) -> None:
        import numpy as np

        if n == 0:
            return
        total = self.n + n
        for x in rows:
            self.values, self.vectors = rank_one(self.values, self.vectors, x)
        if self.n:
            move = (mean - self.mean) * np.sqrt(self.n * n / total)
            self.values, self.vectors = rank_one(self.values, self.vectors, move)
        # Rounding of many small updates is removed as it appears.
        q, r = np.linalg.qr(self.vectors)
        self.vectors = q * np.sign(np.diag(r))
        self.values = np.maximum(self.values, 0.0)
        self.sums = [int(a) + int(b) for a, b in zip(self.sums, sums, strict=True)]
        self.mean = np.array([s / total for s in self.sums])
        self.n = total

    def add(self, x) -> None:
        """A block of integer rows."""
        import numpy as np

        n = len(x)
        sums = [int(s) for s in x.sum(axis=0)]
        centred = x - np.array([s // n for s in sums], dtype=np.int64) - np.array([s % n for s in sums]) / n
        self._scatter(n, sums, np.array([s / n for s in sums]), np.linalg.qr(centred, mode="r"))

    def merge(self, other: "Spectrum") -> None:
        import numpy as np

        rows = [np.sqrt(v) * other.vectors[:, j] for j, v in enumerate(other.values) if v > 0]
        self._scatter(other.n, other.sums, other.mean, rows)


def integers(vec: Column) -> Column:
    """floor(1024 * c) + 100000 of each entry, as long."""
    def one(c):
        c = c.cast("double")
        return F.when(F.abs(c) >= MAX_ENTRY, F.raise_error(F.lit("embedding entry of 2**42 or more"))).otherwise(
            F.floor(F.lit(float(SCALE)) * c).cast("long") + SHIFT)
    return F.transform(vec, one)


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf")))
    return F.coalesce((F.size(vec) > 0) & ~bad, F.lit(False))


def fit_list(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, x) of the vectors that take part, written once."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).filter(usable(F.col("v")))
    rows = materialize(rows.select("vec_id", integers(F.col("v")).alias("x")), "whiten-rows")
    usual = rows.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    dim = usual[0]["dim"] if usual else 0
    if dim > MAX_DIM:
        raise ValueError(f"vectors of {dim} entries; a spectrum holds {MAX_DIM} at most")
    return rows.filter(F.size("x") == dim)


def blocks(batches, cells: int = BLOCK_CELLS):
    """(Arrow ids, int64 matrix) for runs of rows of (vec_id, x) with about ``cells`` entries."""
    import numpy as np

    for b in batches:
        if not b.num_rows:
            continue
        rows = max(1, cells * b.num_rows // len(b.column(1).flatten()))
        for at in range(0, b.num_rows, rows):
            part = b.slice(at, rows)
            x = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield part.column(0), x.reshape(part.num_rows, -1)


def _blobs(key: int, blob):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([pickle.dumps(blob)], pa.binary())],
                                      names=["part", "blob"])


def _tree(parts: DataFrame, combine, name: str):
    """The blobs of all tasks (part, blob) combined ``FAN`` at a time; None if there are none."""
    parts = materialize(parts, name)
    def merge(key, table):
        import pyarrow as pa

        held = None
        for blob in table.column("blob"):
            blob = pickle.loads(blob.as_py())
            held = blob if held is None else combine(held, blob)
        return pa.Table.from_batches([_blobs(key[0].as_py(), held)])

    while (n := parts.count()) > 1:
        of = parts.select(F.pmod(F.xxhash64("part", F.lit(n)), F.lit(-(-n // FAN))).alias("part"), "blob")
        parts = materialize(of.groupBy("part").applyInArrow(merge, "part long, blob binary"), name)
    row = parts.first()
    return None if row is None else pickle.loads(row["blob"])


def spectrum(rows: DataFrame) -> Spectrum | None:
    """The combined spectrum of (vec_id, x) rows."""
    def local(batches):
        from pyspark import TaskContext

        held = None
        for _, x in blocks(batches):
            held = held or Spectrum.empty(x.shape[1])
            held.add(x)
        if held:
            yield _blobs(TaskContext.get().partitionId(), held)

    def combine(a, b):
        a.merge(b)
        return a
    return _tree(rows.mapInArrow(local, "part long, blob binary"), combine, "whiten-spectra")


def _centring(s: Spectrum):
    import numpy as np

    return (np.array([t // s.n for t in s.sums], dtype=np.int64), np.array([t % s.n for t in s.sums], dtype=np.int64))


def refine(rows: DataFrame, s: Spectrum):
    """(eigenvalues falling, eigenvectors, trace) of the covariance: Rayleigh-Ritz on the spectrum's basis."""
    import numpy as np

    whole, rest = _centring(s)
    n, basis = s.n, s.vectors[:, ::-1].copy()

    def project(batches):
        from pyspark import TaskContext

        g = None
        for _, x in blocks(batches):
            y = ((x - whole) - rest / n) @ basis
            g = y.T @ y if g is None else g + y.T @ y
        if g is not None:
            yield _blobs(TaskContext.get().partitionId(), g)

    g = _tree(rows.mapInArrow(project, "part long, blob binary"), lambda a, b: a + b, "whiten-ritz") / n
    values, turn = np.linalg.eigh((g + g.T) / 2)
    return values[::-1].copy(), (basis @ turn)[:, ::-1].copy(), float(np.trace(g))


@dataclass
class Whitener:
    """Centring and the scaled leading components; ``explained`` are their shares of the variance."""

    n: int
    whole: object
    rest: object
    matrix: object
    explained: list


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    import numpy as np

    s = spectrum(rows)
    if s is None:
        return None
    values, vectors, trace = refine(rows, s)
    floor = max(float(values[0]), 0.0) * len(values) * np.finfo(float).eps * 16
    k = int(sum(1 for v in values[:components] if v > floor))
    whole, rest = _centring(s)
    return Whitener(s.n, whole, rest, vectors[:, :k] / np.sqrt(values[:k]), [float(v / trace) for v in values[:k]])


def _whitened(x, w: Whitener):
    return ((x - w.whole) - w.rest / w.n) @ w.matrix


def deviations(x, w: Whitener) -> list[int]:
    """sum((n * x - S) ** 2) of each row, exact."""
    import numpy as np

    t = x - w.whole
    if len(t) and np.abs(t).max() >= 1 << 24:
        t = t.astype(object)
    rest = w.rest.astype(object) if t.dtype == object or w.n >= 1 << 24 else w.rest
    squares, mixed, last = (t * t).sum(axis=1), (t * rest).sum(axis=1), sum(int(r) ** 2 for r in w.rest)
    n = w.n
    return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(squares, mixed, strict=True)]


def apply(rows: DataFrame, w: Whitener) -> DataFrame:
    """One row per vector and component; a deviation beyond 64 bits is null and stands in ``deviation_exact``."""
    def project(batches):
        import numpy as np
        import pyarrow as pa

        k = len(w.explained)
        for ids, x in blocks(batches, 1 << 17):
            dev = deviations(x, w)
            rows_of = pa.array(np.repeat(np.arange(len(x)), k))
            small = pa.array([d if d < 1 << 63 else None for d in dev], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows_of), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                 pa.array(np.full(len(x) * k, w.n)), small.take(rows_of), pa.array([str(d) for d in dev], pa.string()).take(rows_of),
                 pa.array(_whitened(x, w).reshape(-1)), pa.array(np.tile(np.array(w.explained, dtype=float), len(x)))],
                names=[c.split()[0] for c in OUT.split(", ")])
    return rows.mapInArrow(project, OUT)


def identity_error(rows: DataFrame, w: Whitener) -> float:
    """Largest absolute entry of the whitened covariance minus the identity, over all rows."""
    import numpy as np

    k = len(w.explained)

    def moments(batches):
        import pyarrow as pa

        total, outer = np.zeros(k), np.zeros((k, k))
        for _, x in blocks(batches):
            y = _whitened(x, w)
            total, outer = total + y.sum(axis=0), outer + y.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([[*total, *outer.reshape(-1)]], pa.list_(pa.float64()))], names=["m"])

    m = np.array(rows.mapInArrow(moments, "m array<double>")
                 .agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(k + k * k)]).first()) / w.n
    mean, outer = m[:k], m[k:].reshape(k, k)
    return float(np.abs(outer - np.outer(mean, mean) - np.eye(k)).max())


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Whitened leading components of every vector that takes part, with the check value of the whole fit."""
    rows = fit_list(vectors, id_col, vec_col)
    w = fit(rows, components)
    if w is None or not w.explained:
        return vectors.sparkSession.createDataFrame([], OUT + ", identity_error double")
    return apply(rows, w).withColumn("identity_error", F.lit(identity_error(rows, w)))
