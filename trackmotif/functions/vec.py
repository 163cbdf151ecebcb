"""Column builders over tensors: arrays of positions, each an array of four channels (A, C, G, T)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "ACGT"


def total(values: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once, though it stands in a function of an array's elements."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def reshape(flat: Column, width: int = 4) -> Column:
    """A flat array as rows of ``width``; what is left over goes."""
    rows = F.floor(F.size(flat) / width).cast("int")
    return F.transform(F.sequence(F.lit(0), rows - 1), lambda p: F.slice(flat, p * width + 1, width))


def argmax_one_hot(tensor: Column) -> Column:
    """1.0 in the first largest channel of each position, else 0.0."""
    return F.transform(tensor, lambda row: F.transform(row, lambda x, k: F.when(F.array_position(row, F.array_max(row)) - 1 == k, 1.0).otherwise(0.0)))


def product(a: Column, b: Column) -> Column:
    """Element-wise product of two tensors of one shape."""
    return F.zip_with(a, b, lambda x, y: F.zip_with(x, y, lambda u, v: u * v))


def row_sums(tensor: Column) -> Column:
    return F.transform(tensor, total)


def reverse_complement(tensor: Column) -> Column:
    """Positions and channels both reversed."""
    return F.reverse(F.transform(tensor, F.reverse))


def centred_crop(values: Column, width: int) -> Column:
    """The middle ``width`` positions; ``width`` must be even, as an odd one would lose a position."""
    if width < 2 or width % 2:
        raise ValueError("the crop width must be even")
    return F.slice(values, F.floor(F.size(values) / 2).cast("int") - width // 2 + 1, F.lit(width))


def l1(values: Column) -> Column:
    """Divided by the sum of magnitudes; unchanged where that is zero."""
    size = F.aggregate(values, F.lit(0.0), lambda s, x: s + F.abs(x))
    return bound(size, lambda n: F.when(n == 0, values).otherwise(F.transform(values, lambda x: F.try_divide(x, n))))


def centred_l2(values: Column) -> Column:
    """Mean taken off, then divided by the Euclidean length plus 1e-7."""
    moved = bound(total(values) / F.size(values), lambda mean: F.transform(values, lambda x: x - mean))
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)) + F.lit(1e-7)
    return bound(moved, lambda v: bound(length(v), lambda n: F.transform(v, lambda x: x / n)))


def flatten(tensor: Column) -> Column:
    return F.flatten(tensor)


def jaccard(x: Column, y: Column) -> Column:
    """Weighted signed similarity: sum of sign-matched minima over sum of maxima of magnitudes; 0 if both are zero."""
    low = F.aggregate(F.zip_with(x, y, lambda a, b: F.least(F.abs(a), F.abs(b)) * F.signum(a) * F.signum(b)), F.lit(0.0), lambda s, v: s + v)
    high = F.aggregate(F.zip_with(x, y, lambda a, b: F.greatest(F.abs(a), F.abs(b))), F.lit(0.0), lambda s, v: s + v)
    return F.coalesce(F.try_divide(low, high), F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def cosine(x: Column, y: Column) -> Column:
    """0 where a side is all zero."""
    return F.coalesce(F.try_divide(dot(x, y), F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))), F.lit(0.0))


def softmax(row: Column) -> Column:
    powers = bound(F.array_max(row), lambda high: F.transform(row, lambda x: F.exp(x - high)))
    return bound(powers, lambda p: bound(total(p), lambda n: F.transform(p, lambda x: x / n)))


def information(ppm: Column, background: list[float], pseudocount: float = 0.001, renormalise: bool = True) -> Column:
    """Bits at each position of a probability matrix against a background; rows may first be made to sum to 1."""
    bg = F.array(*(F.lit(float(b)) for b in background))
    part = lambda p, b: (p + pseudocount) / F.lit(1.0 + 4 * pseudocount)

    def bits(row: Column) -> Column:
        used = F.transform(row, lambda x: F.coalesce(F.try_divide(x, total(row)), F.lit(0.0))) if renormalise else row
        own = F.zip_with(used, bg, lambda p, b: F.log2(part(p, b)) * p - F.log2(b) * b)
        return total(own)

    return F.transform(ppm, bits)


def trim_bounds(scores: Column, share: float = 0.3) -> tuple[Column, Column]:
    """First and last position whose score is at least ``share`` of the largest."""
    least = F.array_max(scores) * share
    used = F.filter(F.sequence(F.lit(0), F.size(scores) - 1), lambda k: F.get(scores, k) >= least)
    return F.array_min(used), F.array_max(used)


def sequence_of(one_hot: Column) -> Column:
    """Letters of the first largest channel of each position."""
    letters = F.transform(one_hot, lambda row: F.substring(F.lit(BASES), F.array_position(row, F.array_max(row)).cast("int"), F.lit(1)))
    return F.array_join(letters, "")
