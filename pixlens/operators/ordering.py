"""Global positions and per-group ranks that stay balanced under skew.

``row_number`` over ``partitionBy(g)`` sends a whole group to one task; with a
top-k literal Spark plans a partial ``WindowGroupLimit`` and that is fine. When
the whole group must be ranked (no limit), it is cut into blocks of its order key
whose counts become offsets, so a hot group is spread over many tasks.
``dense_index`` numbers a whole table by a range-partitioned sort and
per-partition counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

_POS_BITS = 33  # monotonically_increasing_id: partition id above bit 33, row below


def dense_index(df: DataFrame, order: str | Column | list, descending: bool = False,
                name: str = "idx", materialized: bool = False) -> DataFrame:
    """0-based dense position in a global order, without a single-partition window.

    The sorted rows are checkpointed (to ``spark.checkpoint.dir``) so the counts
    and the rows come from the same run, also after an executor loss.
    """
    ensure_checkpoint_dir(df.sparkSession)
    cols = order if isinstance(order, list) else [order]
    o = [(F.col(c) if isinstance(c, str) else c) for c in cols]
    if descending:
        o = [c.desc() for c in o]
    if not materialized:
        # Range partitioning samples its input in a separate job, which would
        # otherwise recompute the whole upstream plan.
        df = df.checkpoint(eager=True)
    s = df.repartitionByRange(*o).sortWithinPartitions(*o).withColumn("_mid", F.monotonically_increasing_id())
    s = s.checkpoint(eager=True)
    s = s.withColumn("_pid", F.shiftright("_mid", _POS_BITS)).withColumn(
        "_pos", F.col("_mid").bitwiseAND(F.lit((1 << _POS_BITS) - 1)))
    counts = s.groupBy("_pid").agg(F.count("*").alias("_n"))
    # One row per partition: a bounded table, so the running sum may use one task.
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")).alias("_off"))
    return s.join(F.broadcast(offsets), "_pid").withColumn(name, F.col("_off") + F.col("_pos")).drop(
        "_pid", "_pos", "_mid", "_off")


RANK_BUCKET = 1 << 16


def rank_in_groups(df: DataFrame, group: str | list[str], lead: Column, by: str, ties: list[Column] | None = None,
                   name: str = "rank") -> DataFrame:
    """1-based rank within ``group`` by (``lead`` ascending, ``by`` descending, ``ties``) as a long.

    A group may hold any share of the rows. Rows are counted per (group, lead,
    block of ``RANK_BUCKET`` consecutive ``by`` values); the running sum over these
    counts is where a block's ranks begin, and only a block is ranked by one
    window. ``df`` is read twice and should be a materialized table.
    """
    b = df.withColumn("_lead", lead).withColumn("_block", -F.floor(F.col(by) / RANK_BUCKET))
    of = [group] if isinstance(group, str) else group
    keys = [*of, "_lead", "_block"]
    before = Window.partitionBy(*of).orderBy("_lead", "_block").rowsBetween(Window.unboundedPreceding, -1)
    start = b.groupBy(*keys).agg(F.count("*").alias("_n")).withColumn(
        "_start", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys).orderBy(F.col(by).desc(), *(ties or []))
    return (b.withColumn("_rn", F.row_number().over(inside)).join(start, keys)
            .withColumn(name, (F.col("_start") + F.col("_rn")).cast("long"))
            .drop("_lead", "_block", "_rn", "_start"))


SCORE_STEPS = 4096


def rank_by_score(df: DataFrame, group: str, score: str, by: str, name: str = "rank") -> DataFrame:
    """1-based rank within ``group`` by (``score`` descending, ``by`` ascending) as a long; scores lie in -1..1.

    Rows are counted per step of the score, then per exact score and block of ``by`` inside a step, so that
    no window holds a whole group. ``df`` is read several times and should be a materialized table.
    """
    b = df.withColumn("_step", F.floor((F.lit(1.0) - F.col(score)) * (SCORE_STEPS / 2))).withColumn("_by", -F.col(by))
    before = Window.partitionBy(group).orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    start = b.groupBy(group, "_step").agg(F.count("*").alias("_n")).select(
        group, "_step", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_from"))
    inside = rank_in_groups(b, [group, "_step"], -F.col(score), "_by", name="_in")
    return (inside.join(start, [group, "_step"]).withColumn(name, (F.col("_from") + F.col("_in")).cast("long"))
            .drop("_step", "_by", "_from", "_in"))
