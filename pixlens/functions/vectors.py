"""Vector column functions: binary quantization, Hamming distance, cosine.

Codes are sign bits packed 63 per ``long`` word (so no sign-bit games); the
Hamming distance is unrolled over the fixed word count, which keeps it inside
whole-stage codegen for the hot query x image scan. Cosine runs only on the
small candidate set and uses higher-order functions in double precision.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS_PER_WORD = 63


def n_words(dim: int) -> int:
    return (dim + BITS_PER_WORD - 1) // BITS_PER_WORD


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def quantize(vec: Column | str, dim: int) -> Column:
    """Sign bits (x > 0) of a vector packed into ``n_words(dim)`` longs.

    Bit order: element 1 of each 63-element slice is the most significant bit.
    """
    v = _c(vec)
    words = []
    for w in range(n_words(dim)):
        sl = F.slice(v, w * BITS_PER_WORD + 1, BITS_PER_WORD)
        words.append(
            F.aggregate(sl, F.lit(0).cast("long"),
                        lambda acc, x: F.shiftleft(acc, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))
        )
    return F.when(v.isNull(), None).otherwise(F.array(*words))


def hamming(code_a: Column | str, code_b: Column | str, dim: int) -> Column:
    """Hamming distance of two packed codes (unrolled, codegen friendly)."""
    a, b = _c(code_a), _c(code_b)
    terms = [F.bit_count(a.getItem(i).bitwiseXOR(b.getItem(i))) for i in range(n_words(dim))]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out.cast("int")


def as_double(vec: Column | str) -> Column:
    return _c(vec).cast("array<double>")


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(as_double(a), F.lit(0.0).cast("double"), lambda acc, x: acc + x * x))


def cosine_similarity(a: Column | str, b: Column | str, norm_a: Column | None = None,
                      norm_b: Column | None = None) -> Column:
    """1 - cosine distance. NULL for a zero vector (undefined)."""
    na = norm_a if norm_a is not None else norm(a)
    nb = norm_b if norm_b is not None else norm(b)
    den = na * nb
    return F.when(den > 0, dot(a, b) / den)


def parse_vector(text: Column | str, dim: int | None = None) -> Column:
    """Text ``[x, y, ...]`` to ``array<float>``; NULL when the width is wrong."""
    v = F.from_json(_c(text), "array<float>")
    if dim is None:
        return v
    return F.when(F.size(v) == dim, v)
