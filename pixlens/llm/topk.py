"""Exact top-k inner-product search by a three-phase uniform threshold.

Vectors are cut into ``parts`` runs of components. Each (part, row block) holds a local score list
per query. With every part's score below ``cutoff / parts`` a row's total is below ``cutoff``; so

1. *gather*: each part's list gives its ``k`` best entries per query. The entries' rows are scored
   exactly, and the k-th best of these totals is a safe cutoff (a lower bound of the true k-th best);
2. *cutoff*: the cutoff goes back to every part, which gives all entries of at least
   ``cutoff / parts``. A row that no part names cannot be in the result. Entries known from some
   parts bound the row's total from above, and rows whose bound is below the cutoff are pruned;
3. *resolve*: the rest are scored exactly and ranked.

Scores are integers, so no rounding can reorder them. Queries and rows meet in blocks: each
(part, row block, query block) is one bounded task. Equal vectors form one class; a class keeps its
``k + 1`` smallest ids, which is all a result of k can show, so copies never multiply the work.
Queries with equal vectors are solved once.

Defined cases: vectors that are null or hold a null or non-finite component take no part, nor do
rows without id; vectors of different length are compared as if padded with zeros; repeated rows
count once; a query without other rows returns nothing; an empty table gives an empty result.
Scores are 64-bit: where the number of components times the product of the largest query and candidate
component could pass 2**63 - 1, the search raises instead of giving wrong scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

SCALE = 1024
PARTS = 2
ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 1024


def quantize(vec: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as long."""
    return F.transform(vec, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(vec: Column) -> Column:
    bad = F.exists(vec, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vec.isNotNull() & ~bad, F.lit(False))


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(class_id, v, ids): distinct vectors with their ``keep`` smallest ids; class_id is the smallest."""
    w = Window.partitionBy("v").orderBy("id")
    return (rows.dropDuplicates(["id", "v"]).withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))
            .select(F.col("ids")[0].alias("class_id"), "v", "ids"))


def _slices(parts: int, dim: int) -> list[tuple[int, int]]:
    step = max(1, -(-dim // parts))
    return [(i, min(step, dim - i)) for i in range(0, max(dim, 1), step)]


def _matrix(column, width: int):
    import numpy as np

    out = np.zeros((len(column), width), dtype=np.int64)
    for i, x in enumerate(column):
        out[i, :len(x)] = x
    return out


def _scores(queries, rows):
    """Integer products; through float64 where that is exact."""
    import numpy as np

    top = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(1, rows.shape[1])
    if top < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    return queries @ rows.T


def _local_lists(k: int, width: int):
    """Phase 1 in one (part, row block, query block): the k best entries of each query."""
    def run(key, rows, queries):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"query": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"),
                             "part": pd.Series(dtype="int32"), "s": pd.Series(dtype="int64")})]
        if len(rows) and len(queries):
            ids = rows["id"].to_numpy()
            x, qm, qid = _matrix(rows["x"], width), _matrix(queries["x"], width), queries["id"].to_numpy()
            for at in range(0, len(qid), 256):
                s = _scores(qm[at:at + 256], x)
                n = min(k, s.shape[1])
                best = np.argpartition(-s, n - 1, axis=1)[:, :n]
                out.append(pd.DataFrame({"query": np.repeat(qid[at:at + 256], n), "class_id": ids[best].ravel(),
                                         "part": np.int32(key[0]),
                                         "s": np.take_along_axis(s, best, axis=1).ravel()}))
        return pd.concat(out)
    return run


def _above_cutoff(parts: int, width: int):
    """Phase 2 in one (part, row block, query block): all entries of at least cutoff / parts."""
    def run(key, rows, queries):
        import numpy as np
        import pandas as pd

        out = [pd.DataFrame({"query": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"),
                             "part": pd.Series(dtype="int32"), "s": pd.Series(dtype="int64")})]
        if len(rows) and len(queries):
            ids = rows["id"].to_numpy()
            x, qm, qid = _matrix(rows["x"], width), _matrix(queries["x"], width), queries["id"].to_numpy()
            least = -(-queries["cutoff"].to_numpy() // parts)  # s * parts >= cutoff
            for at in range(0, len(qid), 256):
                s = _scores(qm[at:at + 256], x)
                i, j = np.nonzero(s >= least[at:at + 256, None])
                out.append(pd.DataFrame({"query": qid[at:at + 256][i], "class_id": ids[j], "part": np.int32(key[0]),
                                         "s": s[i, j]}))
        return pd.concat(out)
    return run


def _totals(width: int):
    """Phase 3 in one (row block, query block): exact totals of the named pairs."""
    def run(key, pairs, vectors):
        import numpy as np
        import pandas as pd

        if not len(pairs):
            return pd.DataFrame({"query": pd.Series(dtype="int64"), "class_id": pd.Series(dtype="int64"),
                                 "score": pd.Series(dtype="int64")})
        asked = vectors["asks"].to_numpy()
        found = []
        for ids, mine in ((pairs["class_id"], ~asked), (pairs["query"], asked)):
            part = vectors[mine]
            order = np.argsort(part["id"].to_numpy())
            at = order[np.searchsorted(part["id"].to_numpy()[order], ids.to_numpy())]
            found.append((_matrix(part["v"], width), at))
        (x, xi), (q, qi) = found
        score = np.concatenate([np.einsum("ij,ij->i", q[qi[i:i + 65536]], x[xi[i:i + 65536]])
                                for i in range(0, len(pairs), 65536)])
        return pd.DataFrame({"query": pairs["query"], "class_id": pairs["class_id"], "score": score})
    return run


def check_range(rows: DataFrame, queries: DataFrame, dim: int) -> None:
    """Raise if a score of ``dim`` products may leave 64 bits."""
    def largest(df):
        size = F.transform("v", lambda x: F.abs(x.cast("double")))
        return df.agg(F.max(F.array_max(size))).first()[0] or 0.0

    a, b = largest(rows), largest(queries)
    # 2**62 leaves room for the rounding of the bound and for sums over parts.
    if a * b * max(dim, 1) >= 2.0 ** 62 or max(a, b) >= 2.0 ** 62:
        raise ValueError(f"components up to {a:.3g} and {b:.3g} in {dim} dimensions: scores may pass 64 bits")


def search(candidates: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id",
           vec_col: str = "embedding", scale: int = SCALE, parts: int = PARTS,
           rows_per_block: int = ROWS_PER_BLOCK, queries_per_block: int = QUERIES_PER_BLOCK) -> DataFrame:
    """Top ``k`` candidates of every query by integer inner product: (query_id, rank, vec_id, score).

    Ties go to the smaller id; a query's own id is never returned.
    """
    def rows_of(df):
        return (df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("raw"))
                .filter(F.col("id").isNotNull() & usable(F.col("raw")))
                .select("id", quantize(F.col("raw"), scale).alias("v")))

    cls = materialize(classes_of(rows_of(candidates), k + 1), "topk-classes")
    asked = materialize(rows_of(queries).dropDuplicates(["id", "v"])
                        .withColumn("query", F.min("id").over(Window.partitionBy("v"))), "topk-queries")
    qcls = asked.filter(F.col("id") == F.col("query")).select(F.col("query").alias("id"), "v")

    # Both sizes are driver-side scalars; they only choose how many blocks there are.
    n_rows, dim = cls.agg(F.count("*"), F.max(F.size("v"))).first()
    n_queries, qdim = qcls.agg(F.count("*"), F.max(F.size("v"))).first()
    check_range(cls, qcls, max(dim or 0, qdim or 0))
    cuts = _slices(parts, max(dim or 0, qdim or 0))
    width, n_parts = cuts[0][1] if cuts[0][1] > 0 else 1, len(cuts)
    row_blocks = max(1, -(-(n_rows or 0) // rows_per_block))
    query_blocks = max(1, -(-(n_queries or 0) // queries_per_block))

    def cut(df, *more):
        pieces = F.array(*[F.struct(F.lit(p).alias("part"), F.slice("v", start + 1, max(n, 1)).alias("x"))
                           for p, (start, n) in enumerate(cuts)])
        return df.select("id", *more, F.explode(pieces).alias("p")).select("id", *more, "p.part", "p.x")

    def spread(n):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    row_parts = (cut(cls.select(F.col("class_id").alias("id"), "v"))
                 .withColumn("rb", F.pmod(F.xxhash64("id"), F.lit(row_blocks)).cast("int"))
                 .withColumn("qb", spread(query_blocks)))
    entry = "query long, class_id long, part int, s long"

    def meet(query_parts, body):
        asks = (query_parts.withColumn("qb", F.pmod(F.xxhash64("id"), F.lit(query_blocks)).cast("int"))
                .withColumn("rb", spread(row_blocks)))
        return (row_parts.groupBy("part", "rb", "qb").cogroup(asks.groupBy("part", "rb", "qb"))
                .applyInPandas(body, entry))

    def block(name, n):
        return F.pmod(F.xxhash64(name), F.lit(n)).cast("int")

    vectors = (cls.select(F.col("class_id").alias("id"), "v", F.lit(False).alias("asks"),
                          block("class_id", row_blocks).alias("rb"), spread(query_blocks).alias("qb"))
               .unionByName(qcls.select("id", "v", F.lit(True).alias("asks"),
                                        block("id", query_blocks).alias("qb"), spread(row_blocks).alias("rb"))))

    def exact(pairs):
        """Total scores of (query, class_id) pairs, with the ids of the class."""
        placed = pairs.select("query", "class_id", block("class_id", row_blocks).alias("rb"),
                              block("query", query_blocks).alias("qb"))
        return (placed.groupBy("rb", "qb").cogroup(vectors.groupBy("rb", "qb"))
                .applyInPandas(_totals(len(cuts) * width), "query long, class_id long, score long")
                .join(cls.select("class_id", "ids"), "class_id"))

    # Phase 1: local lists, their rows' totals, the safe cutoff. The query's own class also holds
    # its own id, so the k-th best is taken over ids other than the query's own.
    by_part = Window.partitionBy("query", "part").orderBy(F.desc("s"), "class_id")
    gathered = (meet(cut(qcls), _local_lists(k + 1, width)).withColumn("rn", F.row_number().over(by_part))
                .filter(F.col("rn") <= k + 1).select("query", "class_id").distinct())
    by_total = Window.partitionBy("query").orderBy(F.desc("score"))
    # k + 1 ids stand above the cutoff, so k others do whichever of them is the asking row itself.
    cutoffs = (exact(gathered).select("query", "score", F.explode("ids").alias("id"))
               .withColumn("rn", F.row_number().over(by_total)).filter(F.col("rn") <= k + 1)
               .groupBy("query").agg(F.min("score").alias("least"), F.count("*").alias("n"))
               .select("query", F.when(F.col("n") == k + 1, F.col("least")).alias("cutoff")))
    cutoffs = materialize(cutoffs, "topk-cutoffs")
    # Fewer than k + 1 ids gathered: the lists held every row, and every total is above this floor.
    floor = F.lit(-(1 << 62))
    asks = qcls.join(cutoffs, qcls["id"] == cutoffs["query"], "left").select(
        "id", "v", F.coalesce("cutoff", floor).alias("cutoff"))

    # Phase 2: sufficient entries; a part that did not name the row scored at most ceil(cutoff/parts) - 1.
    entries = meet(cut(asks, "cutoff"), _above_cutoff(n_parts, width))
    least = F.expr(f"-((-cutoff) div {n_parts}) + CASE WHEN cutoff > 0 AND cutoff % {n_parts} <> 0 THEN 1 ELSE 0 END")
    sums = (entries.groupBy("query", "class_id").agg(F.sum("s").alias("known"), F.count("*").alias("named"))
            .join(asks.select(F.col("id").alias("query"), "cutoff"), "query")
            .filter(F.col("known") + (n_parts - F.col("named")) * (least - 1) >= F.col("cutoff")))

    # Phase 3: exact totals, ids of the classes, final ranks per asking row.
    found = exact(sums.select("query", "class_id")).select("query", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = materialize(found.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k + 1)
                      .drop("rn"), "topk-best")
    by_asker = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    return (asked.select(F.col("id").alias("query_id"), "query").join(top, "query")
            .filter(F.col("query_id") != F.col("vec_id"))
            .withColumn("rank", F.row_number().over(by_asker)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
