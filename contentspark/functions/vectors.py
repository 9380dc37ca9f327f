"""Vector arithmetic on ``array<float>`` columns with built-in higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from contentspark.functions.binding import let

# Distances are compared at this precision, so summation order cannot change a ranking.
DISTANCE_DIGITS = 10

# Any character that is not white space (the non-breaking blanks are not white space here).
NOT_BLANK = "[^\\t-\\r\\x1c-\\x20\u1680\u2000-\u2006\u2008-\u200a\u2028\u2029\u205f\u3000]"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def cosine_distance(a: Column, b: Column, a_norm: Column | None = None, b_norm: Column | None = None) -> Column:
    """1 - cos(a, b); NULL when either side has no length. Stored norms save one pass each."""
    length = (norm(a) if a_norm is None else a_norm) * (norm(b) if b_norm is None else b_norm)
    return F.lit(1.0) - F.try_divide(dot(a, b), length)


def ranked_distance(distance: Column) -> Column:
    return F.round(distance, DISTANCE_DIGITS)


def l2_normalize(vector: Column) -> Column:
    """Unit vector in single precision; a zero vector stays as it is."""
    def scaled(v: Column, squares: Column) -> Column:
        return let(
            F.sqrt(squares.cast("double")).cast("float"),
            lambda length: F.when(
                squares > 0, F.transform(v, lambda x: (x / length).cast("float"))
            ).otherwise(v),
        )

    def normalized(v: Column) -> Column:
        squares = F.aggregate(v, F.lit(0.0).cast("float"), lambda acc, x: acc + x * x)
        return let(squares, lambda sq: scaled(v, sq))

    return let(vector, normalized)


def _raw_hash_vector(text: Column, dim: int) -> Column:
    data = F.encode(text, "UTF-8")

    def components(digits: Column, n: Column) -> Column:
        def component(i: Column) -> Column:
            signed = let(
                F.conv(F.substring(digits, F.lit(2) * (i % n) + F.lit(1), F.lit(2)), 16, 10).cast("int"),
                lambda byte: F.when(byte > 127, byte - 256).otherwise(byte),
            )
            mixed = F.abs((i * 31 + signed).bitwiseXOR(n * 17))
            return ((mixed % 1000) / F.lit(1000.0)).cast("float")

        return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), component)

    # Component i reads byte i mod n and the byte count n, hence at most `dim` leading bytes matter.
    return let(
        F.hex(F.substring(data, 1, dim)),
        lambda digits: let(F.octet_length(text), lambda n: components(digits, n)),
    )


def hash_vector(text: Column, dim: int) -> Column:
    """Deterministic unit vector of a text; zeros for missing or blank text."""
    zeros = F.array_repeat(F.lit(0.0).cast("float"), dim)
    return F.when(text.rlike(NOT_BLANK), l2_normalize(_raw_hash_vector(text, dim))).otherwise(zeros)


def vector_literal(text: Column) -> Column:
    """``[a, b, ...]`` text as a vector; NULL when it is not one."""
    return F.from_json(text, "array<float>")
