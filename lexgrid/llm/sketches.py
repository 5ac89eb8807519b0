"""Shingle sets of texts, and parity sketches of them."""

from __future__ import annotations

from functools import lru_cache
from math import ceil, exp, log2

import numpy as np

#: Sizes of a band grow by this factor from its least to its most.
GROWTH = 1.5
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose bits look independent."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of `width` words, A-Z in lower case; of fewer words, of the sequence of all; none without words."""
    from xxhash import xxh3_64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array([xxh3_64_intdigest(w) for w in words], np.uint64)
    wide = min(width, len(h))
    total, n = np.full(len(h) - wide + 1, wide, np.uint64), len(h) - wide + 1
    for k in range(wide):
        total = (total + h[k : k + n]) * _A
        total ^= total >> np.uint64(32)
    return np.unique(mixed(total))


class Bands:
    """Bands of set sizes, for sets that link when inner * size of intersection >= outer * size of union (outer <= inner).

    Sets of sizes a <= b that link differ in at most (a + b)(inner - outer) / (inner + outer) members, so no more than `most` for b in a band. In a sketch of most + 1 + spare blocks at least 1 + spare blocks then agree, for a member is XORed into one block. Blocks that are zero in both agree too, but tell nothing: they number no more than the zero blocks of either set, so with at most `spare` of those in one of the sets a block that isn't zero agrees. Sets with more zero blocks than that have these joined as well.
    """

    def __init__(self, outer: int, inner: int):
        self.outer, self.inner = outer, inner

    @lru_cache(maxsize=None)  # noqa: B019
    def band(self, k: int) -> tuple[int, int, int, int]:
        """(least size, most size, most differences, spare blocks)."""
        least, top = ceil(GROWTH**k), ceil(GROWTH ** (k + 1)) - 1
        most = 2 * top * (self.inner - self.outer) // (self.inner + self.outer)
        zero = (most + 1) * exp(-least * self.outer / self.inner / (most + 1))
        return least, top, most, 2 + ceil(2 * zero)

    def of(self, n: int) -> list[int]:
        """The bands that hold n or a larger size that a set of n can link with."""
        k = 0
        while self.band(k)[1] < n:
            k += 1
        found, most = [k], n * self.inner // max(1, self.outer)
        while self.band(k + 1)[0] <= most:
            k += 1
            found.append(k)
        return found

    def blocks(self, members: np.ndarray) -> np.ndarray:
        """Join keys of a set's sketches: one for each band of the set and block, a hash of band, block and the XOR of the block's members."""
        out = []
        for k in self.of(len(members)):
            _, _, most, spare = self.band(k)
            if not most:
                continue  # different sets don't link
            n = most + 1 + spare
            at = (members % np.uint64(n)).astype(np.int64)
            words = np.zeros(n, np.uint64)
            np.bitwise_xor.at(words, at, mixed(members + _A))
            on = words != 0
            if n - int(on.sum()) > spare:
                on[:] = True
            place = np.flatnonzero(on).astype(np.uint64) + np.uint64(k << 40)
            out.append(mixed(words[on] ^ mixed(place * _A + _B)))
        return np.unique(np.concatenate(out)) if out else np.zeros(0, np.uint64)

    def link(self, both: int, a: int, b: int) -> bool:
        return both > 0 and self.inner * both >= self.outer * (a + b - both)


def parity_bits(members: np.ndarray, bands: Bands) -> bytes:
    """A sketch of single bits, eight or more for each member that a linked set can differ in: each member flips one. Two sketches, folded to the shorter's length, differ in no more bits than the sets in members."""
    most = 2 * len(members) * (bands.inner - bands.outer) // (bands.inner + bands.outer)
    bits = 1 << ceil(log2(max(128, 8 * most)))
    return np.packbits((np.bincount((members >> np.uint64(20)).astype(np.int64) & (bits - 1), minlength=bits) & 1).astype(np.uint8)).tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A sketch folded to `size` bytes."""
    x = np.frombuffer(bits, np.uint8)
    while len(x) > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.view(np.uint64)
