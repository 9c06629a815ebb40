"""Scalar rules as Column expressions, so that they stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BIN_SHIFT = 4
MIN_SPAN = 84
MIN_REGION_BINS = 1260 >> BIN_SHIFT
SATURATION = 65535


def bases(seq: Column, begin: Column | int, length: Column | int) -> Column:
    """`length` bases from the 0-based position `begin`."""
    return F.substring(seq, F.lit(begin) + 1, F.lit(length))


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def saturate(x: Column) -> Column:
    return F.least(x, F.lit(SATURATION))


def to_bin(x: Column) -> Column:
    return F.shiftright(x, BIN_SHIFT)


def from_bin(x: Column) -> Column:
    return F.shiftleft(x, BIN_SHIFT)


def pair_of(x: Column) -> Column:
    """The other strand's node or edge."""
    return x.bitwiseXOR(F.lit(1))


def identity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def comparable(a: Column, b: Column, tolerance: float = 0.12) -> Column:
    """Each length lies within the tolerance of the other."""
    near = lambda x, y: (y * (1 - tolerance) <= x) & (x <= y * (1 + tolerance))
    return near(a, b) | near(b, a)


def similar_paths(a: Column, b: Column, share: float = 0.8) -> Column:
    """Two bubble paths: near in length, then near in letters."""
    return (F.least(F.length(a), F.length(b)) >= share * F.greatest(F.length(a), F.length(b))) & (identity(a, b) >= share)


def rotated(seq: Column, share: float = 0.42) -> Column:
    """A circular sequence begun at another place."""
    at = F.floor(F.length(seq) * share).cast("int")
    return F.concat(bases(seq, at, F.length(seq)), bases(seq, 0, at))


def unitig_tags(name: Column, length: Column, count: Column, circular: Column) -> Column:
    return F.concat(name, F.lit(" LN:i:"), length.cast("string"), F.lit(" RC:i:"), count.cast("string"), F.lit(" XO:i:"), circular.cast("int").cast("string"))

