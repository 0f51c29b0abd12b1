"""Mixing sources to target weights with a time-varying curriculum.

Targets. The mix holds ``share`` times the words of all documents. Sources share it by weight; a
source's target stops at ``max_repeats`` times its words and the excess is shared again by weight
among the others, until no target is above its limit.

Curriculum. Each source has a weight schedule over training time 0..1 (piecewise linear knots). Its
integral, scaled to the source's target, is the source's cumulative demand of words at each time. The
documents of a source stand in a fixed pseudo-random order (by the MD5 of the id); a document that
covers the words [a, b) of the source's stream is trained at the time at which the demand reaches a,
the inverse of the integral, which has a closed form on each linear piece. Streams longer than the
source start over. The mix takes the words below the target, so the last document of a stream may
count in part. Documents are range-sorted by time.

A source may hold any share of the rows: the running sums go over (source, MD5 prefix) buckets first,
then within a bucket, so no task sees a whole source.

Defined cases: a null text has size 0 and is not taken; a null source is a source of its own, last; a
source without words has target 0; rows that repeat an id stand next to each other in the order; an
empty table gives an empty result; result columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ordering import dense_index
from .common import WORD_PATTERN, materialize

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
#: Knots (time, relative weight) by rank of the source, repeating: early, even and late sources.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.25), (0.5, 0.75), (1.0, 2.25)))
PREFIX = 3


def size_of(text: Column) -> Column:
    """Number of words of the whole text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)).cast("long"), F.lit(0).cast("long"))


def time_of(u: Column, knots) -> Column:
    """The time in 0..1 at which the normalised integral of the schedule reaches ``u``."""
    pieces, area = [], 0.0
    for (t0, a), (t1, b) in zip(knots, knots[1:]):
        pieces.append((t0, t1, a, b, area))
        area += (a + b) / 2 * (t1 - t0)
    out = F.lit(1.0)
    for t0, t1, a, b, before in reversed(pieces):
        r = F.greatest(u * area - before, F.lit(0.0))
        slope = (b - a) / (t1 - t0)
        root = F.sqrt(F.greatest(F.lit(a * a) + F.lit(2 * slope) * r, F.lit(0.0)))
        here = F.when(r > 0, F.lit(t0) + 2 * r / (F.lit(a) + root)).otherwise(F.lit(t0))
        after = before + (a + b) / 2 * (t1 - t0)
        out = F.when(u * area < after, F.least(here, F.lit(t1))).otherwise(out)
    return out


def targets(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, rank, weight, target) of each source of (source, size)."""
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    ranked = dense_index(sums, [F.col("source").isNull(), F.col("source")], name="rank", materialized=True)
    pick = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = materialize(ranked.withColumn("weight", pick.cast("double")).withColumn(
        "most", (F.col("source_size") * max_repeats).cast("double")), "mix-ranked")
    budget = share * float(table.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0])
    level, full = None, -1
    while True:  # each round fills at least one more source; the table has one row per source
        at_limit = F.lit(False) if level is None else F.col("most") <= F.col("weight") * level
        spent, rest, n = table.agg(F.sum(F.when(at_limit, F.col("most"))), F.sum(F.when(~at_limit, F.col("weight"))),
                                   F.count(F.when(at_limit, 1))).first()
        if n == full or not rest:
            break
        full, level = n, (budget - (spent or 0.0)) / rest
    goal = F.lit(0.0) if level is None else F.least("most", F.col("weight") * level)
    return table.withColumn("target", goal).drop("most")


def mix(rows: DataFrame, weights=WEIGHTS, share: float = SHARE, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES,
        id_col: str = "doc_id", tie: Column | None = None) -> DataFrame:
    """Rows of (id, source, size, ...) with source_size, target, taken and per pass the time and words.

    ``passes`` is array<struct<time, words>>, one entry per pass over the source that takes words of
    the document; ``tie`` orders rows that repeat an id.
    """
    rows = rows.drop("source_size", "target", "taken", "passes", "position")
    by_source = targets(rows.select("source", "size"), weights, share, max_repeats)
    order = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    keyed = (rows.withColumn("__key", key).withColumn("__order", order)
             .withColumn("__bucket", F.substring("__order", 1, PREFIX)))
    buckets = (rows.select(key.alias("k"), F.substring(order, 1, PREFIX).alias("b"), "size")
               .groupBy("k", "b").agg(F.sum("size").alias("n")))
    before = Window.partitionBy("k").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    src = by_source.select(key.alias("k"), "source_size", "rank", "target")
    offsets = materialize(offsets.join(src, "k").withColumnsRenamed({"k": "__of", "b": "__b", "start": "__start"}),
                          "mix-offsets")
    tie_cols = ["__order", "size"] if tie is None else ["__order", "size", tie]
    inside = Window.partitionBy("__key", "__bucket").orderBy(*tie_cols).rowsBetween(Window.unboundedPreceding, -1)
    placed = (keyed.withColumn("__at", F.coalesce(F.sum("size").over(inside), F.lit(0)))
              .join(offsets.withColumnRenamed("rank", "__rank"),
                    (F.col("__key") == F.col("__of")) & (F.col("__bucket") == F.col("__b")))
              .withColumn("__at", F.col("__at") + F.col("__start")))
    goal = F.floor(F.col("target") + 0.5).cast("long")
    passes = []
    for i in range(max_repeats):
        start = F.col("__at") + F.col("source_size") * i
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), goal - start))
        u = start.cast("double") / F.greatest(goal, F.lit(1))
        when = F.lit(None).cast("double")
        for k, knots in enumerate(schedules):
            when = F.when(F.col("__rank") % len(schedules) == k, time_of(u, knots)).otherwise(when)
        passes.append(F.when(words > 0, F.struct(when.alias("time"), words.alias("words"))))
    kept = F.filter(F.array(*passes), lambda x: x.isNotNull())
    taken = F.aggregate(F.col("passes"), F.lit(0).cast("long"), lambda s, x: s + x["words"])
    return (placed.withColumn("passes", kept).withColumn("taken", taken)
            .drop("__key", "__order", "__bucket", "__at", "__of", "__b", "__start", "__rank"))


def training_order(mixed: DataFrame) -> DataFrame:
    """One row per document and pass, range-sorted by training time (column ``position``)."""
    each = mixed.select("*", F.explode("passes").alias("__pass")).withColumn("position", F.col("__pass.time"))
    return each.drop("__pass", "passes").repartitionByRange("position").sortWithinPartitions("position")
