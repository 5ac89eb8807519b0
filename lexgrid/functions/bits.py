"""Expressions over the bits of 64-bit words, and arrays of numbers as vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ones(x: Column) -> Column:
    return F.bit_count(x.cast("long"))


def _above(x: Column) -> Column:
    """Each bit's place takes the bit before it, the less significant one."""
    return F.shiftleft(x.cast("long"), 1)


def pairs_11(x: Column) -> Column:
    """Ones whose less significant neighbour is one too."""
    return ones(x.bitwiseAND(_above(x)))


def pairs_10(x: Column) -> Column:
    """Zeros above a one, within 64 bits."""
    return ones(F.bitwise_not(x.cast("long")).bitwiseAND(_above(x)))


def pairs_01(x: Column) -> Column:
    """Ones above a zero; below the least significant bit counts as one."""
    return ones(x.cast("long").bitwiseAND(F.bitwise_not(_above(x).bitwiseOR(F.lit(1)))))


def lowest(x: Column) -> Column:
    """Place of the least significant one; null for 0."""
    low = x.cast("long").bitwiseAND(-x.cast("long"))
    return F.when(x != 0, F.bit_count(low - 1))


def highest(x: Column) -> Column:
    """Place of the most significant one of a number that isn't negative; null for 0."""
    return F.when(x != 0, F.length(F.bin(x.cast("long"))) - 1)


def place_of(x: Column, k: Column) -> Column:
    """Place of the k-th one from the least significant, from 1; null if there are fewer."""
    at = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(x.cast("long"), i) == 1)
    return F.get(at, k.cast("int") - 1)


def read_bits(x: Column, start: int, width: int) -> Column:
    """`width` bits from place `start` on."""
    return F.shiftrightunsigned(x.cast("long"), start).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def written_bits(x: Column, start: int, width: int, value: Column) -> Column:
    """x with `width` bits from place `start` on replaced."""
    mask = ((1 << width) - 1) << start
    return x.cast("long").bitwiseAND(F.lit(~mask).cast("long")).bitwiseOR(F.shiftleft(value.cast("long"), start).bitwiseAND(F.lit(mask).cast("long")))


def all_modulo(vector: Column, m: int) -> Column:
    return F.transform(vector, lambda x: x % m)


def with_entry(vector: Column, i: Column, value: Column) -> Column:
    """The vector with entry i, from 0, replaced."""
    return F.transform(vector, lambda x, k: F.when(k == i, value).otherwise(x))


def resized(vector: Column, n: int) -> Column:
    """The vector cut to n entries, or filled with zeros up to them."""
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0).cast("long"), n)), 1, n)
