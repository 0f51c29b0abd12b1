"""SimHash near-duplicates: exact Hamming-distance linking with vantage-point trees.

Fingerprints. A text is lower-cased (A-Z), cut into words, and its shingles of ``shingle`` words are
hashed (XXH64, seed 42); a fingerprint bit is set when more than half of the hashes have it.

Linking. Rows are first reduced to distinct fingerprints, so copies cost nothing later. A
vantage-point tree, fitted on a bounded sample, deals the fingerprints to shards: an inner node sends
those nearer to its vantage point than the median inside, the others outside. By the triangle
inequality two fingerprints at distance r or less whose vantage distances differ by more than r cannot
be a pair, so of the inside points only those within r of the boundary are also sent outside, as
guests; guests follow every branch that their distance leaves open. Each pair thus meets in the home
shard of one of the two. Inside a shard the same pruning goes on down to small blocks, which are
compared bit by bit. The sample only shapes the tree; every fingerprint is dealt and no pair is lost
whatever the sample was.

Components. A shard gives at most one link per member (to the smallest member of its local
component), and alternating large-star and small-star steps join the links over shards.

Defined cases: null and empty texts have fingerprint zero and link like any other; rows that repeat
an id share their component (the smallest id reachable); a null id names its
component only when no other is there; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import byte_slices, materialize

SHINGLE = 3
MAX_BITS = 2
SHARD_SIZE = 2048
MAX_DEPTH = 15
SAMPLE_PER_SHARD = 48
LEAF = 192
SEED = 42


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Signed 64-bit SimHash of a whole text."""
    import numpy as np
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    stops = ends[shingle - 1:].tolist() or [len(joined)]
    starts = [0, *(ends[:len(words) - shingle] + 1).tolist()] if len(words) >= shingle else [0]
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[i:j], SEED) for i, j in zip(starts, stops, strict=True)], dtype="<u8")
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at:at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view("<i8")[0])


def _fingerprints(shingle: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for part in byte_slices(b, 1):
                prints = pa.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), prints, *part.columns[2:]],
                                                 names=["id", "fp", *part.schema.names[2:]])
    return run


def fingerprints(documents: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id",
                 text_col: str = "text", key: Column | None = None) -> DataFrame:
    """(id, fp) of every row, and the string ``key`` of the row if one is given."""
    more = [] if key is None else [key.alias("key")]
    return (documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), *more)
            .mapInArrow(_fingerprints(shingle), "id long, fp long" + ", key string" * len(more)))


def far(a, b):
    """Hamming distances of unsigned 64-bit arrays."""
    import numpy as np

    return np.bitwise_count(a ^ b).astype(np.int64)


def choose(points, radius: int, tries: int = 8):
    """(vantage point, boundary): the try that sends the fewest guests over a boundary near the median."""
    import numpy as np

    best = None
    for i in range(min(tries, len(points))):
        v = points[(i * 2654435761) % len(points)]
        d = far(points, v)
        for cut in np.unique(np.quantile(d, [0.4, 0.5, 0.6]).astype(np.int64) + 1):
            inside = np.count_nonzero(d < cut)
            if 0 < inside < len(points):
                guests = np.count_nonzero((d >= cut - radius) & (d <= cut + radius - 1))
                cost = guests / len(points) + abs(inside / len(points) - 0.5)
                if best is None or cost < best[0]:
                    best = (cost, v, int(cut))
    return (best[1], best[2]) if best else (points[0] if len(points) else np.uint64(0), 1)


def build_tree(sample, depth: int, radius: int):
    """Vantage points and boundaries of a complete tree in heap order."""
    import numpy as np

    n = (1 << depth) - 1
    vantage, cut = np.zeros(n, dtype=np.uint64), np.ones(n, dtype=np.int64)
    own = {0: sample}
    for node in range(n):
        points = own.pop(node)
        vantage[node], cut[node] = choose(points, radius)
        d = far(points, vantage[node])
        if 2 * node + 1 < n:
            own[2 * node + 1], own[2 * node + 2] = points[d < cut[node]], points[d >= cut[node]]
    return vantage, cut


def route(points, vantage, cut, depth: int, radius: int):
    """(index, leaf, guest) of every shard that each point visits."""
    import numpy as np

    at, node = np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
    guest = np.zeros(len(points), dtype=bool)
    for _ in range(depth):
        d = far(points[at], vantage[node]) - cut[node]
        inside = np.where(guest, d <= radius - 1, d < 0)
        outside = d >= -radius
        at = np.concatenate([at[inside], at[outside]])
        # A home inside visits the outside only as a guest.
        guest = np.concatenate([guest[inside], guest[outside] | (d[outside] < 0)])
        node = np.concatenate([2 * node[inside] + 1, 2 * node[outside] + 2])
    return at, node, guest


def near_pairs(homes, guests, radius: int, leaf: int = LEAF):
    """Index pairs at distance <= radius: both in ``homes``, or a home and a guest (numbered after the homes)."""
    import numpy as np

    points = np.concatenate([homes, guests])
    found = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    work = [(np.arange(len(homes)), np.arange(len(homes), len(points)))]
    while work:
        mine, others = work.pop()
        if len(mine) == 0:
            continue
        if len(mine) > leaf:
            v, cut = choose(points[mine[:: max(1, len(mine) // 256)]], radius, 4)
            d, g = far(points[mine], v) - cut, far(points[others], v) - cut
            inside = d < 0
            if len(mine) // 32 < np.count_nonzero(inside) < len(mine) - len(mine) // 32:
                work.append((mine[inside], others[g <= radius - 1]))
                work.append((mine[~inside], np.concatenate([others[g >= -radius], mine[inside & (d >= -radius)]])))
                continue
        step = max(1, (1 << 20) // len(mine))
        asks = np.concatenate([mine, others])
        for i in range(0, len(asks), step):
            part = asks[i:i + step]
            row, col = np.nonzero(far(points[part][:, None], points[mine][None, :]) <= radius)
            a, b = part[row], mine[col]
            keep = (row + i >= len(mine)) | (a > b)  # two homes of this block: once
            found.append((a[keep], b[keep]))
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def local_links(homes, guests, radius: int):
    """(member, smallest member of its local component) for members of components of two or more."""
    import numpy as np

    points = np.concatenate([homes, guests])
    a, b = near_pairs(homes, guests, radius)
    if not len(a):
        return points[:0], points[:0]
    order = np.argsort(points, kind="stable")
    rank = np.empty(len(points), dtype=np.int64)
    rank[order] = np.arange(len(points))
    label = rank.copy()
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        # The label names a point by its rank; its own label may be smaller still.
        new = np.minimum(new, new[order[new]])
        if (new == label).all():
            break
        label = new
    moved = label != rank
    return points[moved], points[order[label[moved]]]


def _router(tree, depth: int, radius: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        vantage, cut = tree.value
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False)
            for i in range(0, len(fp), 2048):
                part = fp[i:i + 2048]
                at, node, guest = route(part.view(np.uint64), vantage, cut, depth, radius)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(part[at]), pa.array(guest)],
                                                 names=["shard", "fp", "guest"])
    return run


def _shard(radius: int):
    def run(table):
        import numpy as np
        import pyarrow as pa

        fp, guest = table.column("fp").to_numpy().view(np.uint64), table.column("guest").to_numpy()
        member, root = local_links(fp[~guest], fp[guest], radius)
        a, b = member.view(np.int64), root.view(np.int64)
        return pa.table({"a": np.maximum(a, b), "b": np.minimum(a, b)})
    return run


def links(distinct: DataFrame, radius: int = MAX_BITS, shard_size: int = SHARD_SIZE,
          max_depth: int = MAX_DEPTH) -> DataFrame:
    """(a, b), a > b: links that join the same components as all pairs within ``radius`` bits.

    ``distinct`` has one row (fp) per fingerprint. The tree has at most 2**max_depth shards and is
    fitted on about ``SAMPLE_PER_SHARD`` fingerprints per shard.
    """
    import numpy as np

    spark = distinct.sparkSession
    n = distinct.count()
    depth = min(max_depth, max(0, -(-n // shard_size) - 1).bit_length())
    wanted = SAMPLE_PER_SHARD << depth
    share = 1 << 30 if n <= wanted else int((1 << 30) * wanted / n)
    sample = (distinct.filter(F.pmod(F.xxhash64("fp"), F.lit(1 << 30)) < share).select("fp").orderBy("fp")
              .toPandas()["fp"].to_numpy(dtype=np.int64)) if depth else np.empty(0, np.int64)
    sample = np.random.default_rng(7).permutation(sample).view(np.uint64)
    tree = spark.sparkContext.broadcast(build_tree(sample, depth, radius))
    dealt = distinct.select("fp").mapInArrow(_router(tree, depth, radius), "shard long, fp long, guest boolean")
    return dealt.groupBy("shard").applyInArrow(_shard(radius), "a long, b long").distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root): smallest node of each component, from links a > b; alternating star contraction."""
    edges = materialize(edges.select("a", "b").filter("a <> b"), "vp-edges")
    last = (edges.count(), None)
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = materialize(both.groupBy(F.col("a").alias("n")).agg(F.least("n", F.min("b")).alias("low")), "vp-low")
        large = (both.filter("b > a").join(low, F.col("a") == F.col("n")).select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .filter("a <> b").distinct())
        large = materialize(large, "vp-large")
        least = materialize(large.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low")), "vp-least")
        joined = large.join(least, F.col("a") == F.col("n"))
        small = (joined.filter("b <> low").select(F.col("b").alias("a"), F.col("low").alias("b"))
                 .unionByName(least.select(F.col("n").alias("a"), F.col("low").alias("b"))).distinct())
        edges = materialize(small, "vp-edges")
        # Stars only (no root is a member) and no change: done.
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == last:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        last = tuple(state)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def cluster(documents: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS, shard_size: int = SHARD_SIZE,
            id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) of every row."""
    return members(documents, shingle, radius, shard_size, id_col, text_col).select("id", "fp", "component_id")


def members(documents: DataFrame, shingle: int = SHINGLE, radius: int = MAX_BITS, shard_size: int = SHARD_SIZE,
            id_col: str = "doc_id", text_col: str = "text", key: Column | None = None) -> DataFrame:
    """``cluster`` with the ``root`` of the component (a fingerprint, unlike the id of one component only) and ``key``."""
    prints = materialize(fingerprints(documents, shingle, id_col, text_col, key), "vp-prints")
    first = F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))
    distinct = materialize(prints.groupBy("fp").agg(F.min(first).alias("first")), "vp-distinct")
    roots = components(links(distinct, radius, shard_size))
    member = materialize(distinct.join(roots, F.col("fp") == F.col("node"), "left")
                         .select("fp", "first", F.coalesce("root", "fp").alias("root")), "vp-members")
    lowest = materialize(member.groupBy("root").agg(F.min("first").alias("lowest")), "vp-lowest")
    named = materialize(member.join(lowest, "root").select(F.col("fp").alias("of"), F.col("lowest.id").alias("component_id"),
                                                           "root"), "vp-named")
    return prints.join(named, F.col("fp") == F.col("of"), "left").drop("of")


def hex_of(column: str):
    """16 lower-case hex digits of a signed 64-bit fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
