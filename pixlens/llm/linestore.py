"""Line de-duplication over levelled sorted runs of line hashes.

``LineRuns`` keeps what is known of the lines seen so far: (h1, h2) is the 128-bit hash of a line's
key, ``n`` the documents that hold it and ``last`` the largest of their ids. The entries lie in
sorted runs. A batch is first aggregated to one entry per key, then merge-anti-joined with the runs:
keys that no run holds are new, the others add to what is known. Both kinds go into one new run at
level 0. When a level has ``fanout`` runs they are merged into one run of the next level and removed,
so an entry is rewritten once per level, a logarithmic number of times.

``drop_shared_lines`` feeds a table to the store in batches, reads the totals back, and removes lines
shared by at least ``min_docs`` documents from all but the document with the largest id. A line's key
is the line without blanks ([\\x20\\x09-\\x0D]) at both ends and with A-Z lower-cased; keys under
``min_chars`` code points are left alone.

Defined cases: a null or empty text is one empty line and stays as it is; every row counts as one
document, also when rows repeat an id; rows that repeat the largest id all keep the line; a null id
counts as smaller than every other (if all holders have null ids they all keep the line); extra
columns are passed through, result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType

from .common import BLANKS, byte_slices, discard, materialize, shared_path

MIN_DOCS = 3
MIN_CHARS = 20
BATCHES = 5
FANOUT = 2

_BLANK_BYTES = BLANKS.encode()


def line_hash(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of the line's key, or None for a key that is too short to count."""
    import xxhash

    key = line.strip(_BLANK_BYTES)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())  # bytes: lower-cases A-Z only


def _line_rows(min_chars: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for part in byte_slices(b, 2):
                at, hashes = [], []
                for i, text in enumerate(part.column(2).to_pylist()):
                    own = {line_hash(x, min_chars) for x in (text or "").encode("utf-8", "replace").split(b"\n")}
                    own.discard(None)
                    hashes += sorted(own)
                    at += [i] * len(own)
                pairs = np.frombuffer(b"".join(hashes), dtype="<i8").reshape(-1, 2)
                at = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array(pairs[:, 0].copy()),
                     pa.array(pairs[:, 1].copy())], names=["id", "rid", "h1", "h2"])
    return run


def line_keys(documents: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id",
              text_col: str = "text") -> DataFrame:
    """(id, rid, h1, h2): the distinct line keys of every row; ``rid`` tells rows of one id apart."""
    return (documents.select(F.col(id_col).cast("long").alias("id"), row_mark(id_col, text_col).alias("rid"),
                             F.col(text_col).alias("text"))
            .mapInArrow(_line_rows(min_chars), "id long, rid long, h1 long, h2 long"))


def row_mark(id_col: str, text_col: str):
    return F.xxhash64(F.col(id_col).cast("long"), F.col(text_col))


class LineRuns:
    """The levelled store. ``levels`` (lists of run folders) is its whole state; pass it to resume."""

    def __init__(self, spark: SparkSession, folder: str | None = None, fanout: int = FANOUT,
                 levels: list[list[str]] | None = None):
        self.spark, self.fanout = spark, fanout
        self.folder = folder or shared_path(spark, "line-runs")
        self.levels = levels or []
        self.written = sum(map(len, self.levels))

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/level{level}-run{self.written}"
        self.written += 1
        run.sortWithinPartitions("h1", "h2").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def entries(self) -> DataFrame | None:
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    @staticmethod
    def _merged(entries: DataFrame) -> DataFrame:
        return entries.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("last").alias("last"),
                                               F.max("new").alias("new"))

    def add(self, lines: DataFrame) -> DataFrame:
        """Add a batch of (id, h1, h2), one row per document and key; returns its new run (``new``: never seen before)."""
        batch = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("last"))
        held = self.entries()
        if held is None:
            run = batch.withColumn("new", F.lit(True))
        else:
            batch = materialize(batch, "line-batch")
            known = held.select("h1", "h2").hint("merge")
            run = (batch.join(known, ["h1", "h2"], "left_anti").withColumn("new", F.lit(True))
                   .unionByName(batch.join(known, ["h1", "h2"], "left_semi").withColumn("new", F.lit(False))))
        self._write(run, 0)
        added = self.levels[0][-1]
        level = 0
        while len(self.levels[level]) >= self.fanout and level + 1 < 32:
            self._compact(level)
            level += 1
        return self.spark.read.parquet(added) if any(added in x for x in self.levels) else self.entries()

    def _compact(self, level: int) -> None:
        old, self.levels[level] = self.levels[level], []
        self._write(self._merged(self.spark.read.parquet(*old)), level + 1)
        for path in old:
            discard(self.spark, path)

    def totals(self) -> DataFrame:
        """(h1, h2, n, last) of every key."""
        held = self.entries()
        if held is None:
            return self.spark.createDataFrame([], "h1 long, h2 long, n long, last long")
        return self._merged(held).drop("new")


def _rebuild(at: int, min_chars: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in byte_slices(b, at):
                n_lines, n_dropped, kept = [], [], []
                for text, drops in zip(part.column(at).to_pylist(), part.column(part.num_columns - 1).to_pylist(),
                                       strict=True):
                    if not drops:
                        n_lines.append((text or "").count("\n") + 1)
                        n_dropped.append(0)
                        kept.append(text)
                        continue
                    gone = {x["h1"].to_bytes(8, "little", signed=True) + x["h2"].to_bytes(8, "little", signed=True)
                            for x in drops}
                    lines = text.encode("utf-8", "replace").split(b"\n")
                    stay = [x for x in lines if line_hash(x, min_chars) not in gone]
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(stay))
                    kept.append(b"\n".join(stay).decode("utf-8"))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:-1], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()),
                     pa.array(kept, pa.string())],
                    names=[*part.schema.names[:-1], "n_lines", "n_dropped", "kept_text"])
    return run


def drop_shared_lines(documents: DataFrame, min_docs: int = MIN_DOCS, min_chars: int = MIN_CHARS,
                      batches: int = BATCHES, fanout: int = FANOUT, id_col: str = "doc_id",
                      text_col: str = "text") -> DataFrame:
    """Every row with n_lines, n_dropped and kept_text."""
    spark = documents.sparkSession
    lines = materialize(line_keys(documents, min_chars, id_col, text_col), "line-keys")
    store = LineRuns(spark, fanout=fanout)
    for i in range(batches):
        store.add(lines.filter(F.pmod(F.xxhash64("rid"), F.lit(batches)) == i))
    shared = materialize(store.totals().filter(F.col("n") >= min_docs), "line-shared")
    gone = materialize(lines.join(shared, ["h1", "h2"]).filter(~F.col("id").eqNullSafe(F.col("last")))
                       .groupBy("id", "rid").agg(F.collect_set(F.struct("h1", "h2")).alias("__gone")), "line-gone")
    base = documents.drop("n_lines", "n_dropped", "kept_text")
    names = base.columns
    marked = base.withColumn("__id", F.col(id_col).cast("long")).withColumn("__rid", row_mark(id_col, text_col))
    joined = (marked.join(gone, marked["__id"].eqNullSafe(gone["id"]) & (marked["__rid"] == gone["rid"]), "left")
              .select(*[marked[c] for c in names], gone["__gone"]))
    schema = StructType([*base.schema.fields]).add("n_lines", LongType()).add("n_dropped", LongType()).add(
        "kept_text", StringType())
    return joined.mapInArrow(_rebuild(names.index(text_col), min_chars), schema)
