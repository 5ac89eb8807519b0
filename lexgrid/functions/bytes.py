"""Expressions over binary columns, bits and the sizes of index pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def byte_at(text: Column, pos: Column) -> Column:
    """The byte at pos, as binary of length 1."""
    return F.substring(text, pos + 1, F.lit(1))


def preceding(text: Column, pos: Column, step: int) -> Column:
    """The `step` bytes before pos, the nearest first: fixed-length binary that sorts like the unsigned big-endian integer."""
    return F.concat(*[byte_at(text, pos - 1 - k) for k in range(step)])


def reversed_bytes(value: Column, length: int) -> Column:
    """The first `length` bytes in reverse. reverse() would go through strings and spoil bytes that aren't UTF-8."""
    return F.concat(*[F.substring(value, F.lit(k), F.lit(1)) for k in range(length, 0, -1)])


def fill(byte: str, times: int) -> Column:
    return F.unhex(F.lit(byte * times))


def common_prefix(text: Column, p: Column, q: Column, n: Column) -> Column:
    """Length of the longest common prefix of the suffixes at p and q: a binary search over lengths, each probe one comparison of bytes."""
    most = n - F.greatest(p, q)

    def probe(known: Column, power: Column) -> Column:
        more = known + power
        same = F.substring(text, (p + known + 1).cast("int"), (more - known).cast("int")) == F.substring(text, (q + known + 1).cast("int"), (more - known).cast("int"))
        return F.when((more <= most) & same, more).otherwise(known)

    return F.aggregate(F.array(*[F.lit(1 << b).cast("long") for b in range(30, -1, -1)]), F.lit(0).cast("long"), probe)


def first_differing_bit(x: Column, y: Column) -> Column:
    """0 for the most significant of 8; null for equal bytes."""
    z = x.cast("long").bitwiseXOR(y.cast("long"))
    return F.when(z != 0, 8 - F.length(F.bin(z)))


def test_bit(byte: Column, k: int) -> Column:
    """Bit k of a byte, 0 for the most significant."""
    return F.getbit(byte.cast("long"), F.lit(7 - k)).cast("int")


def bit_length(x: Column) -> Column:
    """Bits of a number; 1 for 0."""
    return F.length(F.bin(x.cast("long")))


def log2_ceiling(x: Column) -> Column:
    """The smallest w with 2^w >= x, for x from 1."""
    return F.when(x <= 1, 0).otherwise(F.length(F.bin(x.cast("long") - 1)))


def low_high(low: Column, high: Column) -> Column:
    """A 40-bit number from its low 32 and high 8 bits."""
    return low.cast("long") + high.cast("long") * (1 << 32)


def branching(page: Column, position_bits: Column, suffix_bits: Column) -> Column:
    """Suffixes that fit a page of a blind tree: 72 bytes of head, 4 bits of shape each."""
    return F.floor((page - 72) * 8 / (4 + position_bits + suffix_bits)).cast("long")


def tree_height(n: Column, b: Column) -> Column:
    return (F.floor(F.log(n.cast("double")) / F.log(b.cast("double"))) + 1).cast("long")


def leaf_points(page: Column, x_bits: Column, y_bits: Column, payload_bits: Column) -> Column:
    """Points that fit a leaf page: 24 bytes of head and 192 bits of widths."""
    return F.floor(((page - 24) * 8 - 192) / (x_bits + y_bits + payload_bits)).cast("long")


def extra_leaves(left: Column, right: Column, b: Column) -> Column:
    """Leaf pages that a range of ranks needs beyond those of its ends."""
    return F.when(left == right, 0).otherwise(F.greatest(F.lit(0), F.ceil(right / b) - F.ceil(left / b) - 1)).cast("long")


#: Bytes of a rectangle on a page: four coordinates of 8 bytes and a byte of flags.
RECTANGLE = 33


def node_bits(parents: Column, children: Column, bits: int) -> Column:
    """Bits of a page of a point tree's nodes: its shape and its parents' values in whole words, a rectangle with 8 bytes, and 23 of head."""
    words = lambda x: F.ceil(x / 64) * 64
    return (words(parents + children) + words(parents * bits) + (RECTANGLE + 8) * 8 + (8 + 2 + 1 + 4 + 8) * 8).cast("long")


def overflows(parents: Column, children: Column, bits: int, page: Column) -> Column:
    """Whether these nodes need more than a page."""
    return node_bits(parents, children, bits) > page * 8


def most_children(page: Column, bits: int) -> Column:
    """Children that a page can have at most: each parent takes its value and two bits of shape."""
    free = page * 8 - ((8 + 4 + 1 + 2 + 8) * 8 + (RECTANGLE + 8) * 8) - 129
    return (F.floor(free / (bits + 2)) + 1).cast("long")


def page_height(page: Column, bits: int, most: int = 40) -> Column:
    """Levels of a whole binary tree in a page: the last height whose nodes don't overflow, 1 at least."""
    leaves = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h - 1)
    fits = F.filter(F.sequence(F.lit(2), F.lit(most)), lambda h: ~overflows(leaves(h) - 1, leaves(h), bits, page))
    return F.size(fits) + 1


def whole_log(x: Column, base: Column) -> Column:
    """The largest k with base^k <= x; exact where logarithms are a little off."""
    k = F.floor(F.log(x.cast("double")) / F.log(base.cast("double")))
    return F.when(F.pow(base, k + 1) <= x, k + 1).when(F.pow(base, k) > x, k - 1).otherwise(k).cast("long")


def node_level(points: Column, leaf: int, fan_out: int) -> Column:
    """Level of a node over so many points, with leaves of `leaf` points and fan_out children: one above floor(log(points / 2 leaf)) where the points lie between a power of leaves and its double."""
    fan = F.lit(fan_out)
    half, whole = whole_log(points / (2 * leaf), fan), whole_log(points / leaf, fan)
    power = F.lit(leaf) * F.pow(fan, whole)
    return F.when((power < points) & (points < 2 * power), half + 1).otherwise(half).cast("long")


def page_offset(page_number: Column, page: Column, head: Column) -> Column:
    """Byte at which a page starts, after the file's head."""
    return (head + page_number * page).cast("long")


def unpacked(x: Column) -> tuple[Column, Column]:
    """The byte and the bit of a packed crit position."""
    return F.shiftright(x.cast("long"), 3), x.cast("long").bitwiseAND(F.lit(7).cast("long"))


def root_leaves(height: Column, page_levels: Column) -> Column:
    """Leaves of the tree in the root's page, where each further page takes page_levels - 1 levels of a tree of that height."""
    rest = (height - page_levels + 1) % (page_levels - 1)
    levels = F.when(height > page_levels, F.when(rest == 0, page_levels - 1).otherwise(rest)).otherwise(page_levels - 1)
    return F.call_function("shiftleft", F.lit(1).cast("long"), levels.cast("int"))
