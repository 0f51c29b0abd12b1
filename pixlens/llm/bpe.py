"""Byte-level BPE encoding and decoding.

A text is cut by the pattern into pieces; each piece is merged on its own. A piece that is not a
vocabulary entry itself is merged with a segment tree over its byte positions: a leaf holds the rank
of the pair that starts there with its next live neighbour, an inner node the smallest of its two
children. Leaves hold ``rank << 32 | position``, so the root names the leftmost pair of least rank.
A merge changes three leaves (the merged pair, its right part, its left neighbour), each in
logarithmic time; a piece of n bytes takes O(n log n) however long it is.

Within a slice of an Arrow batch, texts are first cut at single blanks between two non-blank
characters, where the pattern always starts a new piece; equal chunks and equal pieces are encoded
once, and the trees of many short pieces are stepped together as rows of one array. Token ids travel as
little-endian unsigned 32-bit integers in one binary value per document.

Defined cases: null and empty texts have no tokens (empty binary) and decode to empty bytes; ids not
in the vocabulary raise; input columns of the same name as the result are replaced.
"""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_slices

MEMO_SIZE = 150_000
SLICE_BYTES = 3 << 20


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: a base64 token and its rank on each line."""
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


@lru_cache(maxsize=4)
def load_tokens(path: str) -> dict[int, bytes]:
    return {rank: token for token, rank in load_ranks(path).items()}


def merge_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Token ids of one piece."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    size = 1 << max(1, (n - 1).bit_length())
    none = 1 << 62
    end = [i + 1 for i in range(n)]  # end of the live token that starts at i
    left = [i - 1 for i in range(n)]  # start of the live token before it
    get = ranks.get
    tree = [none] * (2 * size)
    for i in range(n - 1):
        r = get(piece[i:i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        a, b = tree[2 * i], tree[2 * i + 1]
        tree[i] = a if a < b else b

    def put(pos, value):
        i = size + pos
        tree[i] = value
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            low = a if a < b else b
            if tree[i] == low:
                break
            tree[i] = low
            i >>= 1

    def rank_at(pos):
        mid = end[pos]
        if mid >= n:
            return none
        r = get(piece[pos:end[mid]])
        return none if r is None else r << 32 | pos

    while tree[1] != none:
        pos = tree[1] & 0xFFFFFFFF
        right = end[pos]
        end[pos] = end[right]
        if end[right] < n:
            left[end[right]] = pos
        put(right, none)
        put(pos, rank_at(pos))
        if left[pos] >= 0:
            put(left[pos], rank_at(left[pos]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i:end[i]]])
        i = end[i]
    return ids


class PairRanks:
    """Rank (= id) of the token that two neighbouring tokens form, for arrays of token ids; -1 if none."""

    def __init__(self, ranks: dict[bytes, int]):
        import numpy as np

        get, keys, made = ranks.get, [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = get(token[:i]), get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    made.append(rank)
        keys.append((1 << 63) - 1)
        made.append(-1)
        order = np.argsort(np.array(keys, dtype=np.int64))
        self.keys, self.made = np.array(keys, dtype=np.int64)[order], np.array(made, dtype=np.int64)[order]
        self.byte = np.array([get(bytes([i]), -1) for i in range(256)], dtype=np.int64)

    def __call__(self, a, b):
        import numpy as np

        key = a << 32 | b
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.made[at], -1)


def merge_pieces(pieces: list[bytes], pairs: PairRanks) -> list[bytes]:
    """Token ids (as 32-bit integers) of pieces of at most 2**15 bytes: one segment tree per piece, all trees stepped together."""
    import numpy as np

    count = np.array([len(p) for p in pieces])
    size = 1 << int(count.max()).bit_length()  # a spare leaf at least
    none = np.int64(1 << 62)
    rows = np.arange(len(pieces))
    place = np.arange(size)
    raw = np.zeros((len(pieces), size), dtype=np.uint8)
    raw[place[None, :] < count[:, None]] = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    tok = pairs.byte[raw]
    nxt = np.tile(place + 1, (len(pieces), 1))
    prv = np.tile(place - 1, (len(pieces), 1))
    tree = np.full((len(pieces), 2 * size), none)
    first = pairs(tok[:, :-1], tok[:, 1:])
    can = (first >= 0) & (place[None, 1:] < count[:, None])
    tree[:, size:2 * size - 1] = np.where(can, first << 16 | place[:-1], none)
    level = size
    while level > 1:
        half = level >> 1
        tree[:, half:level] = np.minimum(tree[:, level:2 * level:2], tree[:, level + 1:2 * level:2])
        level = half

    def put(at, pos, value):
        i = size + pos
        tree[at, i] = value
        i >>= 1
        while i[0]:
            tree[at, i] = np.minimum(tree[at, 2 * i], tree[at, 2 * i + 1])
            i >>= 1

    live = rows[tree[:, 1] != none]
    while len(live):
        root = tree[live, 1]
        pos, made = root & 0xFFFF, root >> 16
        right = nxt[live, pos]
        after = nxt[live, right]
        tok[live, pos] = made
        tok[live, right] = -1
        nxt[live, pos] = after
        inside = after < count[live]
        prv[live[inside], after[inside]] = pos[inside]
        put(live, right, none)
        with_next = np.where(inside, pairs(made, tok[live, np.minimum(after, size - 1)]), -1)
        put(live, pos, np.where(with_next >= 0, with_next << 16 | pos, none))
        before = prv[live, pos]
        has = before >= 0
        if has.any():
            mine, before = live[has], before[has]
            joined = pairs(tok[mine, before], made[has])
            put(mine, before, np.where(joined >= 0, joined << 16 | before, none))
        live = live[tree[live, 1] != none]
    kept = (tok >= 0) & (place[None, :] < count[:, None])
    flat = tok[kept].astype("<u4").tobytes()
    stop = (4 * np.cumsum(kept.sum(axis=1))).tolist()
    return [flat[i:j] for i, j in zip([0, *stop], stop, strict=False)]


class Memo:
    """A bounded memo in two generations: what is asked for again outlives the older generation."""

    def __init__(self, size: int = MEMO_SIZE):
        self.size, self.new, self.old = size, {}, {}

    def turn(self) -> None:
        """Called between slices: drops the older generation once the newer one is full."""
        if len(self.new) > self.size:
            self.new, self.old = {}, self.new

    def missing(self, keys: set) -> set:
        """The keys that neither generation holds; those in the older one become new again."""
        rest = keys.difference(self.new)
        again = rest.intersection(self.old)
        for k in again:
            self.new[k] = self.old[k]
        return rest.difference(again)


class Encoder:
    """Encodes texts with bounded memos of chunks and pieces; one per Python worker and vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import re

        import regex

        self.ranks, self.pairs, self.pieces = ranks, PairRanks(ranks), regex.compile(pattern)
        self.chunks, self.known = Memo(), Memo()  # ids of a blank and this chunk; ids of a piece
        # A blank between two characters that are white space under no definition.
        self.cut = re.compile(r"(?<=[^\s\x00-\x20\x7f-\xa0]) (?=[^\s\x00-\x20\x7f-\xa0])")

    def learn(self, pieces) -> None:
        """Put the ids of these pieces in the memo."""
        import numpy as np

        by_size: dict[int, list[bytes]] = {}
        for p in pieces:
            whole = self.ranks.get(p)
            if whole is not None:
                self.known.new[p] = whole.to_bytes(4, "little")
            elif len(p) > 256:
                self.known.new[p] = np.array(merge_piece(p, self.ranks), dtype="<u4").tobytes()
            else:
                by_size.setdefault(len(p).bit_length(), []).append(p)
        for own in by_size.values():
            step = max(16, (1 << 17) >> len(own[0]).bit_length())
            for at in range(0, len(own), step):
                self.known.new.update(zip(own[at:at + step], merge_pieces(own[at:at + step], self.pairs), strict=True))

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        self.chunks.turn()
        self.known.turn()
        cut = [self.cut.split(t) for t in texts]
        find = self.pieces.findall
        split = {c: [p.encode() for p in find(c)] for c in {c[0] for c in cut}}
        spaced = {c: [p.encode() for p in find(" " + c)] for c in self.chunks.missing(set().union(*[c[1:] for c in cut]))}
        self.learn(self.known.missing({p for d in (split, spaced) for ps in d.values() for p in ps}))
        known = self.known.new.__getitem__
        starts = {c: b"".join(map(known, ps)) for c, ps in split.items()}
        self.chunks.new.update((c, b"".join(map(known, ps))) for c, ps in spaced.items())
        chunk = self.chunks.new.__getitem__
        return [starts[c[0]] + b"".join(map(chunk, c[1:])) for c in cut]

    def text(self, text: str) -> bytes:
        return self.texts([text])[0]


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(load_ranks(path), pattern)


def _with_column(batch, name: str, values, kind):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, type=kind)],
                                      names=[*batch.schema.names, name])


def _encode(path: str, pattern: str, at: int, name: str):
    def run(batches):
        import pyarrow as pa

        enc = encoder(path, pattern)
        for b in batches:
            for part in byte_slices(b, at, SLICE_BYTES):
                yield _with_column(part, name, enc.texts([t or "" for t in part.column(at).to_pylist()]), pa.binary())
    return run


def _decode(path: str, at: int, name: str):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        token = load_tokens(path).__getitem__
        for b in batches:
            for part in byte_slices(b, at, SLICE_BYTES):
                out = [b"".join(map(token, np.frombuffer(x, "<u4").tolist())) if x else b""
                       for x in part.column(at).to_pylist()]
                yield _with_column(part, name, out, pa.binary())
    return run


def _added(df: DataFrame, name: str):
    from pyspark.sql.types import BinaryType, StructType

    base = df.drop(name)
    return base, StructType([*base.schema.fields]).add(name, BinaryType())


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """Add ``ids_col``: the token ids of the whole text. ``path`` names the rank file on every worker."""
    base, schema = _added(df, ids_col)
    return base.mapInArrow(_encode(path, pattern, base.columns.index(text_col), ids_col), schema)


def decode(df: DataFrame, path: str, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """Add ``bytes_col``: the bytes that the ids stand for."""
    base, schema = _added(df, bytes_col)
    return base.mapInArrow(_decode(path, base.columns.index(ids_col), bytes_col), schema)


def n_tokens(ids_col: str = "ids"):
    return F.expr(f"octet_length({ids_col}) div 4")
