"""Column functions over colour sets, kept as sorted arrays of ints, and their packed forms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def _ints(x: Column) -> Column:
    return x.cast("array<int>")


def test(colors: Column, c: Column) -> Column:
    return F.array_contains(colors, c)


def set_bit(colors: Column, c: Column) -> Column:
    return F.array_sort(F.array_union(colors, F.array(c)))


def unset_bit(colors: Column, c: Column) -> Column:
    return F.array_except(colors, F.array(c))


def toggle_bit(colors: Column, c: Column) -> Column:
    return F.when(test(colors, c), unset_bit(colors, c)).otherwise(set_bit(colors, c))


def both(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_intersect(a, b))


def either(a: Column, b: Column) -> Column:
    return F.array_sort(F.array_union(a, b))


def popcount(colors: Column) -> Column:
    return F.size(colors)


def is_nonzero(colors: Column) -> Column:
    return F.size(colors) > 0


def next_bit(colors: Column, start: Column) -> Column:
    """Least colour from ``start`` on, or null."""
    return F.array_min(F.filter(colors, lambda c: c >= start))


def clear_from(colors: Column, end: Column) -> Column:
    """Colours below ``end``."""
    return F.filter(colors, lambda c: c < end)


def highest(colors: Column) -> Column:
    return F.array_max(colors)


def lowest(colors: Column) -> Column:
    return F.array_min(colors)


def words(colors: Column, n_colors: Column | int) -> Column:
    """Packed 64-bit words, lowest colours first; words of 2^63 and more are negative."""
    n = F.lit(n_colors) if isinstance(n_colors, int) else n_colors
    count = F.greatest(F.lit(1), F.ceil(n / WORD)).cast("int")
    return F.transform(F.sequence(F.lit(0), count - 1), lambda w: F.aggregate(F.filter(colors, lambda c: F.floor(c / WORD) == w), F.lit(0).cast("long"), lambda acc, c: acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), (c % WORD).cast("int")))))


def from_words(packed: Column) -> Column:
    """Colours of packed words."""
    bits = F.transform(packed, lambda w, i: F.transform(F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftrightunsigned", w, b).bitwiseAND(F.lit(1).cast("long")) == 1), lambda b: b + i * WORD))
    return _ints(F.flatten(bits))


def words_text(packed: Column) -> Column:
    """Comma-joined unsigned words."""
    return F.array_join(F.transform(packed, lambda w: F.conv(F.hex(w), 16, 10)), ",")


def text(colors: Column) -> Column:
    return F.array_join(colors.cast("array<string>"), ",")


def from_text(line: Column) -> Column:
    """Sorted colours of a comma-separated line."""
    return F.array_sort(_ints(F.filter(F.split(line, ","), lambda x: x != "")))


# --- bit vectors as arrays of 0 and 1 ----------------------------------------


def insert_zeros(bits: Column, at: Column, n: Column) -> Column:
    return insert_range(bits, at, F.array_repeat(F.lit(0), n))


def insert_range(bits: Column, at: Column, more: Column) -> Column:
    return F.concat(F.slice(bits, F.lit(1), at), more, F.slice(bits, at + 1, F.size(bits)))


def remove_range(bits: Column, start: Column, end: Column) -> Column:
    return F.concat(F.slice(bits, F.lit(1), start), F.slice(bits, end + 1, F.size(bits)))


def remove_bits(bits: Column, places: Column) -> Column:
    return F.filter(bits, lambda _, i: ~F.array_contains(places, i))


def swap_bits(bits: Column, i: Column, j: Column) -> Column:
    return F.transform(bits, lambda b, p: F.when(p == i, F.get(bits, j)).when(p == j, F.get(bits, i)).otherwise(b))


def rearrange_bits(bits: Column, order: Column) -> Column:
    """Bit order[i] moves to place i."""
    return F.transform(order, lambda p: F.get(bits, p))
