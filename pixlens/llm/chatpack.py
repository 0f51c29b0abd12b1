"""Chat formatting packed as a prefix tree.

A conversation is its rows in order of turn. The template writes each turn as ``<s>role\\ntext</s>``;
control strings inside roles and texts get a backslash after their first character (one more if there
already are some), which removes every control string and is undone on reading.

Conversations that share their first turns share them in the output. A node of the tree is a prefix of
turns; it belongs to the smallest conversation that has it, so each conversation owns the tail of its
own path (nothing, if a smaller one has the whole path). That tail is one *segment*: the tree with its
unbranched runs joined. Segments of one tree stand in depth-first order: a branch that leaves a segment
later comes first, and each shared turn is emitted once. A segment carries

* ``start``: where it begins in its tree's packed sequence, in characters (code points);
* ``position``: the position id of its first character, counted along its own path, so that every
  conversation sees positions 0, 1, 2, ...; the others follow one by one;
* ``ancestors``: the intervals of the packed sequence that its characters attend to besides the earlier
  characters of the segment itself;
* ``loss``: the intervals, within the segment, of assistant texts (the loss mask).

Node identity is a 128-bit hash built up along the path by a running window, so no conversation is
collected for it; depth-first offsets come from one range sort with per-partition sums. Only what is
returned per segment or per conversation (its text, its ancestors) is held together.

Defined cases: null texts and roles count as empty; rows of one turn number are ordered by role and
text, a null turn comes first; only the exact role ``assistant`` is under the loss mask; a conversation
id may be null (it sorts first); an empty table gives empty tables; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

#: Control strings of chat templates, as first character and rest.
CONTROL = r"([<\[])(\\*)(s>|/s>|/?INST\]|<SYS>>|</SYS>>|\|im_start\|>|\|im_end\|>)"
OPEN, CLOSE = "<s>", "</s>"

_UNESCAPE = re.compile(CONTROL.replace(r"(\\*)", r"(\\*)\\"))


def escape(c: Column) -> Column:
    """Break every control string by a backslash after its first character."""
    return F.regexp_replace(c, CONTROL, r"$1$2\\$3")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2\3", text)


def format_turns(conversations: DataFrame) -> DataFrame:
    """(conv, depth, text_f, chars, loss_from, loss_to, k1, k2): formatted turns with their path hashes."""
    role = F.coalesce(F.col("role"), F.lit(""))
    text = F.coalesce(F.col("text"), F.lit(""))
    order = Window.partitionBy("conv").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = (conversations.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"),
                                 role.alias("role"), text.alias("text"))
            .withColumn("depth", F.row_number().over(order)))
    # A newline ends the role.
    head = F.concat(F.lit(OPEN), escape(F.regexp_replace(F.regexp_replace("role", r"\\", r"\\\\"), "\n", r"\\n")), F.lit("\n"))
    rows = rows.withColumn("__head", head).withColumn("__body", escape(F.col("text")))
    rows = rows.withColumn("text_f", F.concat("__head", "__body", F.lit(CLOSE))).withColumn("chars", F.length("text_f").cast("long"))
    masked = F.col("role") == "assistant"
    rows = (rows.withColumn("loss_from", F.when(masked, F.length("__head").cast("long")))
            .withColumn("loss_to", F.when(masked, (F.length("__head") + F.length("__body")).cast("long"))))
    path = order.rowsBetween(Window.unboundedPreceding, 0)
    upto = order.rowsBetween(Window.unboundedPreceding, -1)
    # Two chained hashes of (depth, role, text), combined along the path.
    for name, seed in (("k1", 11), ("k2", 12)):
        rows = rows.withColumn(name, F.bit_xor(F.xxhash64(F.lit(seed), "depth", "role", "text")).over(path))
    return rows.withColumn("at", F.coalesce(F.sum("chars").over(upto), F.lit(0))).select(
        "conv", "depth", "text_f", "chars", "at", "loss_from", "loss_to", "k1", "k2")


def owned(turns: DataFrame) -> DataFrame:
    """The turns with ``owner``: the smallest conversation that has the same path so far."""
    first = F.struct(F.col("conv").isNotNull().alias("known"), F.col("conv").alias("conv"))
    nodes = materialize(turns.groupBy("depth", "k1", "k2").agg(F.min(first).alias("owner")), "chat-nodes")
    return turns.join(nodes, ["depth", "k1", "k2"]).withColumn("owner", F.col("owner.conv"))


def pack(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, paths).

    segments: tree, conv, text, chars, start, position, ancestors array<struct<from, to>>,
    loss array<struct<from, to>>. paths: conv, tree, n_turns, chars and ``pieces``
    array<struct<at, owner, skip, chars>>: the parts of segments that make up the conversation.
    """
    turns = materialize(owned(materialize(format_turns(conversations), "chat-turns")), "chat-owned")
    # Pieces: runs of turns of one owner along a path. Owners never decrease along a path and a turn's
    # place in its owner's segment follows from the positions, which all paths through it share.
    runs = (turns.groupBy("conv", "owner").agg(F.min("at").alias("at"), F.min("depth").alias("depth"),
                                               F.sum("chars").alias("chars"), F.count("*").alias("n")))
    per_path = F.sort_array(F.collect_list(F.struct("at", "owner", "depth", "chars")))
    tree = F.min(F.struct("at", "owner"))["owner"]
    paths = materialize(runs.groupBy("conv").agg(per_path.alias("pieces"), tree.alias("tree"),
                                                 F.sum("n").alias("n_turns"), F.sum("chars").alias("chars")), "chat-paths")
    last = F.element_at("pieces", -1)
    own = paths.filter(last["owner"].eqNullSafe(F.col("conv")))
    # Depth-first order: among siblings the branch that leaves latest, then the smaller conversation.
    key = F.transform("pieces", lambda p: F.struct((-p["depth"]).alias("d"), p["owner"].alias("o")))
    segments = own.select("conv", "tree", "pieces", last["chars"].alias("chars"), last["at"].alias("position"),
                          key.alias("key"))
    placed = _running_start(segments)
    return _with_ancestors(placed, turns), paths.withColumn(
        "pieces", F.transform("pieces", lambda p: F.struct(p["at"], p["owner"], p["chars"])))


def _running_start(segments: DataFrame) -> DataFrame:
    """Add ``start``: characters before the segment in its tree's depth-first order."""
    sort = ["tree", "key"]
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    held = materialize(segments.repartitionByRange(n, *sort).sortWithinPartitions(*sort)
                       .withColumn("part", F.spark_partition_id()), "chat-segments")
    sums = held.groupBy("part").agg(F.sum("chars").alias("n"))  # one row per partition
    offset = sums.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = Window.partitionBy("part").orderBy(*sort).rowsBetween(Window.unboundedPreceding, -1)
    line = (held.withColumn("run", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
            .join(F.broadcast(offset), "part").withColumn("line", F.col("run") + F.col("before")).drop("part", "run", "before"))
    line = materialize(line, "chat-line")
    roots = line.filter(F.size("pieces") == 1).select(F.col("tree").alias("root"), F.col("line").alias("base"))
    return (line.join(roots, F.col("tree").eqNullSafe(F.col("root"))).withColumn("start", F.col("line") - F.col("base"))
            .drop("root", "base", "line"))


def _with_ancestors(placed: DataFrame, turns: DataFrame) -> DataFrame:
    placed = materialize(placed, "chat-placed")
    starts = placed.select(F.col("conv").alias("of"), F.col("start").alias("of_start"), F.col("position").alias("of_at"))
    above = (placed.select("conv", F.posexplode(F.slice("pieces", 1, F.greatest(F.size("pieces") - 1, F.lit(0)))).alias("i", "p"))
             .join(starts, F.col("p.owner").eqNullSafe(F.col("of")))
             .withColumn("from", F.col("of_start") + F.col("p.at") - F.col("of_at"))
             .groupBy("conv").agg(F.sort_array(F.collect_list(
                 F.struct("from", (F.col("from") + F.col("p.chars")).alias("to")))).alias("ancestors")))
    own = turns.filter(F.col("owner").eqNullSafe(F.col("conv")))
    body = (own.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("depth", "text_f", "at", "loss_from", "loss_to")))
                                    .alias("t"))
            .select("conv", F.concat_ws("", F.transform("t", lambda x: x["text_f"])).alias("text"),
                    F.transform(F.filter("t", lambda x: x["loss_from"].isNotNull()), lambda x: F.struct(
                        (x["at"] + x["loss_from"] - F.col("t")[0]["at"]).alias("from"),
                        (x["at"] + x["loss_to"] - F.col("t")[0]["at"]).alias("to"))).alias("loss")))
    empty = F.array().cast("array<struct<from:bigint,to:bigint>>")
    a, b = above.withColumnRenamed("conv", "a_conv"), body.withColumnRenamed("conv", "b_conv")
    return (placed.join(a, F.col("conv").eqNullSafe(F.col("a_conv")), "left")
            .join(b, F.col("conv").eqNullSafe(F.col("b_conv")))
            .select("tree", "conv", "text", "chars", "start", "position",
                    F.coalesce("ancestors", empty).alias("ancestors"), "loss"))


def unpack(segments: DataFrame, paths: DataFrame) -> DataFrame:
    """Read every conversation back: (conv, text, loss), assembled from the segments that its path names."""
    seg = segments.select(F.col("conv").alias("of"), "text", "position", "loss")
    pieces = paths.select("conv", F.explode("pieces").alias("p")).select("conv", "p.*")
    first = F.col("at") - F.col("position")
    cut = (pieces.join(seg, F.col("owner").eqNullSafe(F.col("of")))
           .select("conv", "at", F.expr("substring(text, cast(at - position as int) + 1, cast(chars as int))").alias("part"),
                   F.transform(F.filter("loss", lambda x: (x["from"] >= first) & (x["to"] <= first + F.col("chars"))),
                               lambda x: F.struct((x["from"] - first + F.col("at")).alias("from"),
                                                  (x["to"] - first + F.col("at")).alias("to"))).alias("spans")))
    whole = cut.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("at", "part", "spans"))).alias("c"))
    return whole.select("conv", F.concat_ws("", F.transform("c", lambda x: x["part"])).alias("text"),
                        F.flatten(F.transform("c", lambda x: x["spans"])).alias("loss"))


def parse(text: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns, i = [], 0
    while i < len(text):
        if not text.startswith(OPEN, i):
            raise ValueError("a turn does not begin with its mark")
        line = text.index("\n", i)
        end = text.index(CLOSE, line)
        role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text[i + len(OPEN):line]))
        turns.append((role, unescape(text[line + 1:end])))
        i = end + len(CLOSE)
    return turns
