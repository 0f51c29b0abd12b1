"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_table_dir

#: The white space that separates words in the contracts ([\x20\x09-\x0D]).
BLANKS = " \t\n\x0b\x0c\r"
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared checkpoint location."""
    return scratch_table_dir(spark, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, computed once."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only; other letters stay."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_slices(batch, column: int, max_bytes: int = 8 << 20):
    """Zero-copy slices of an Arrow batch whose ``column`` holds about ``max_bytes`` each, one row at least."""
    import pyarrow.compute as pc

    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield batch.slice(start)


def gathered(batches, column: int, max_bytes: int = 16 << 20):
    """Successive Arrow batches joined until ``column`` holds about ``max_bytes``."""
    import pyarrow as pa

    held, size = [], 0
    for b in batches:
        held.append(b)
        size += b.column(column).nbytes
        if size >= max_bytes:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if len(held) > 1 else b
            held, size = [], 0
    if held:
        joined = pa.Table.from_batches(held).combine_chunks().to_batches()
        yield joined[0] if joined else held[0]


def bitmap_of(hashes: DataFrame, max_bits: int) -> tuple[int, bytes]:
    """(log2 of the size, bitmap) of the leading bits of the 64-bit hashes in column ``h``.

    Sixteen bits a hash, ``max_bits`` at most whatever the number of hashes: a fuller map says yes more often
    to hashes that are not in it, and never no to one that is.
    """
    bits = min(max(16, (16 * hashes.count()).bit_length()), max_bits.bit_length() - 1)
    place = F.shiftrightunsigned("h", 64 - bits)
    rows = (hashes.select(place.alias("p")).groupBy(F.shiftright("p", 15).alias("block"))
            .agg(F.bitmap_construct_agg(F.col("p") % 32768).alias("bits")).collect())
    out = bytearray(1 << (bits - 3))
    for r in rows:
        out[r["block"] << 12:(r["block"] << 12) + 4096] = r["bits"]
    return bits, bytes(out)


def bitmap_test(spark: SparkSession, bits: int, bitmap: bytes):
    """A function for tasks: which of an array of unsigned 64-bit hashes the bitmap may hold."""
    shared = spark.sparkContext.broadcast(bitmap)

    def test(h):
        import numpy as np

        p = h >> np.uint64(64 - bits)
        known = np.frombuffer(shared.value, dtype=np.uint8)
        return (known[p >> np.uint64(3)] >> (p & np.uint64(7)).astype(np.uint8)) & 1 == 1
    return test


def discard(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library wrote and nothing reads any more."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def set_aside(df: DataFrame, names) -> tuple[DataFrame, list[Column]]:
    """``df`` with its columns of these names renamed, and the columns that bring the old names back."""
    taken = {n.lower() for n in names}
    new = {c: f"__in_{i}_{c}" for i, c in enumerate(df.columns) if c.lower() in taken}
    return df.withColumnsRenamed(new), [F.col(f"`{new.get(c, c)}`").alias(c) for c in df.columns]
