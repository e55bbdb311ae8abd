"""Sizes of Bloom filters."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

LN2 = math.log(2)


def by_rate(p: float) -> tuple[float, int, float]:
    """(bits per element, hash functions, false-positive rate) for a wanted rate."""
    bits = -math.log2(p) / LN2
    return bits, math.ceil(bits * LN2 - 1e-12), p


def by_bits(bits: float, hashes: int | None = None) -> tuple[float, int, float]:
    h = math.ceil(bits * LN2 - 1e-12) if hashes is None else hashes
    if h == 0:
        raise ValueError("a filter needs at least one hash function")
    return bits, h, math.exp(-bits * LN2 * LN2)


def bits_for_rate(p: Column) -> Column:
    return -F.log2(p) / F.lit(LN2)


def hashes_for_bits(bits: Column) -> Column:
    return F.ceil(bits * F.lit(LN2) - F.lit(1e-12)).cast("int")


def rate_for_bits(bits: Column) -> Column:
    return F.exp(-bits * F.lit(LN2 * LN2))


def portable_hash(kmer: Column, j: Column) -> Column:
    """60-bit hash number j of a k-mer that any SQL engine can compute."""
    return F.conv(F.substring(F.md5(F.concat(j.cast("string"), F.lit(":"), kmer)), 1, 15), 16, 10).cast("long")


def fast_hash(kmer: Column, j: Column) -> Column:
    return F.xxhash64(kmer, j)
