"""Scalar functions: seeded uniforms, wrapping 64-bit arithmetic, packed attributes, arrays, maps and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(*key: Column | str | int) -> Column:
    """A uniform double in [0, 1) from the md5 of the key's parts joined by "|": the same in any engine.

    The first 13 hexadecimal digits are 52 bits, which a double holds exactly.
    """
    parts = [k if isinstance(k, Column) else F.lit(str(k)) for k in key]
    digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 13)
    return F.conv(digits, 16, 10).cast("bigint") / F.lit(float(1 << 52))


def wrapped_product(x: Column, factor: int) -> Column:
    """x * factor with the silent overflow of 64-bit integers."""
    two63, two64 = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    exact = x.cast("decimal(20,0)") * F.lit(factor).cast("decimal(17,0)") + two63
    return (F.pmod(exact.cast("decimal(38,0)"), two64) - two63).cast("bigint")


def wrapped_abs(x: Column) -> Column:
    """|x|, taking the smallest long (which has no positive counterpart) as 0."""
    return F.when(x == F.lit(-(1 << 63)), F.lit(0).cast("bigint")).otherwise(F.abs(x))


def pack_shorts_and_int(a: Column, b: Column, c: Column) -> Column:
    """Two shorts and an int in one long: a in the top 16 bits, b in the next, c in the low 32."""
    low = lambda x, bits: x.cast("bigint").bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(low(a, 16), 48).bitwiseOR(F.shiftleft(low(b, 16), 32)).bitwiseOR(low(c, 32))


def unpack_shorts_and_int(x: Column) -> tuple[Column, Column, Column]:
    sign = lambda v, bits: F.when(v >= 1 << (bits - 1), v - (1 << bits)).otherwise(v)
    part = lambda shift, bits: sign(F.shiftrightunsigned(x, shift).bitwiseAND(F.lit((1 << bits) - 1)), bits)
    return part(48, 16).cast("short"), part(32, 16).cast("short"), part(0, 32).cast("int")


# arrays and sets: null-safe in the sense that a missing side counts as empty ---------------------------------------


def _or_empty(a: Column, like: Column) -> Column:
    return F.coalesce(a, F.filter(like, lambda _: F.lit(False)))


def merge_sorted(a: Column, b: Column) -> Column:
    """Sorted distinct union of two arrays."""
    return F.array_sort(F.array_union(_or_empty(a, b), _or_empty(b, a)))


def merge_weighted(a: Column, b: Column) -> Column:
    """Union of arrays of (nbr, weight), sorted by neighbor; of a neighbor in both the left weight stays."""
    as_map = lambda x: F.map_from_entries(x)
    both = F.map_zip_with(as_map(_or_empty(a, b)), as_map(_or_empty(b, a)), lambda _, x, y: F.coalesce(x, y))
    return F.array_sort(F.transform(F.map_entries(both), lambda e: F.struct(e["key"].alias("nbr"), e["value"].alias("weight"))))


def set_difference(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_except(a, b))


def set_intersection(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def head(a: Column, k: int) -> Column:
    return F.slice(a, 1, k)


def last(a: Column, k: int) -> Column:
    """The last k elements, or all of a shorter array."""
    return F.when(F.size(a) <= k, a).otherwise(F.slice(a, -k, k)) if k else F.slice(a, 1, 0)


# maps ------------------------------------------------------------------------------------------------------------


def map_merge(a: Column, b: Column, merge) -> Column:
    """Union of two maps; values of keys in both are merged."""
    return F.map_zip_with(a, b, lambda _, x, y: F.when(x.isNull(), y).when(y.isNull(), x).otherwise(merge(x, y)))


def map_update(a: Column, b: Column) -> Column:
    """Union of two maps; of keys in both the right value stays."""
    return map_merge(a, b, lambda _, y: y)


def map_get(m: Column, key: Column, default: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key), default)


def map_remove(m: Column, key: Column) -> Column:
    return F.map_filter(m, lambda k, _: k != key)


# vectors ---------------------------------------------------------------------------------------------------------


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def axpy(factor: Column, x: Column, y: Column) -> Column:
    """factor * x + y."""
    return F.zip_with(x, y, lambda p, q: factor * p + q)


def scale(factor: Column, x: Column) -> Column:
    return F.transform(x, lambda v: factor * v)
