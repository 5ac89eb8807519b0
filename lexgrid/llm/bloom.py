"""Bloom filters of bounded size, filled on executors and merged block by block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame

#: Bits of a filter for each item, and at most (32 MB). Over that it lets more pass to the exact stage behind it; results are the same.
BITS_EACH, MOST_BITS = 16, 1 << 28
#: Bits in a block of a filter: what is sent and merged at a time.
BLOCK = 1 << 16


def size_of(items: int) -> int:
    return min(MOST_BITS, max(BLOCK, 1 << math.ceil(math.log2(BITS_EACH * max(1, items)))))


def places(hashes: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits of each hash."""
    n = np.uint64(bits - 1)
    return hashes & n, (hashes >> np.uint64(33)) & n


def test(filled: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((filled[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1).astype(bool)


def put(filled: np.ndarray, at: np.ndarray) -> None:
    np.bitwise_or.at(filled, (at >> np.uint64(3)).astype(np.int64), np.uint8(128) >> (at & np.uint64(7)).astype(np.uint8))


class Seen:
    """Two Bloom filters: of hashes seen, and of hashes seen again. Two bits for each hash, eight bits in a byte."""

    def __init__(self, bits: int):
        self.bits, self.once, self.twice = bits, np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)

    def add(self, hashes: np.ndarray) -> None:
        """hashes: of one batch; a hash that stands in it twice was seen again."""
        new, counts = np.unique(hashes, return_counts=True)
        at = places(new, self.bits)
        again = (counts > 1) | (test(self.once, at[0]) & test(self.once, at[1]))
        for x in at:
            put(self.twice, x[again])
            put(self.once, x)

    SCHEMA = "block int, once binary, twice binary"

    def batches(self):
        """Rows of SCHEMA."""
        import pyarrow as pa

        for k, once, twice in self.blocks():
            yield pa.RecordBatch.from_pydict({"block": pa.array([k], pa.int32()), "once": pa.array([once], pa.binary()), "twice": pa.array([twice], pa.binary())})

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """(number, once, twice) of each block with a bit."""
        for k in range(self.bits // BLOCK):
            cut = slice(k * BLOCK // 8, (k + 1) * BLOCK // 8)
            if self.once[cut].any():
                yield k, pressed(self.once[cut]), pressed(self.twice[cut])


def pressed(block: np.ndarray) -> bytes:
    """A block's bits as places of 16 bits each, or where that is longer as they are."""
    at = np.flatnonzero(np.unpackbits(block))
    return at.astype("<u2").tobytes() if 2 * len(at) < BLOCK // 8 else block.tobytes()


def spread(data: bytes) -> np.ndarray:
    if len(data) == BLOCK // 8:
        return np.frombuffer(data, np.uint8)
    block = np.zeros(BLOCK // 8, np.uint8)
    put(block, np.frombuffer(data, "<u2").astype(np.uint64))
    return block


def merged(twice: bool):
    def merge(batches):
        """Blocks sorted by number to (number, bits): of hashes seen, or seen again within a part or in two parts."""
        import pyarrow as pa

        now, once, again = None, None, None

        def row():
            return pa.RecordBatch.from_pydict({"block": pa.array([now], pa.int32()), "bits": pa.array([pressed(again if twice else once)], pa.binary())})

        for batch in batches:
            for k, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if k != now:
                    if now is not None:
                        yield row()
                    now, once, again = k, np.zeros(BLOCK // 8, np.uint8), np.zeros(BLOCK // 8, np.uint8)
                bits = spread(a)
                again = again | spread(b) | (once & bits)
                once = once | bits
        if now is not None:
            yield row()

    return merge


def filled(parts: DataFrame, bits: int, twice: bool = False) -> Broadcast:
    """The filter that parts (rows of Seen.SCHEMA) make together, on all executors: bits / 8 bytes whatever the input."""
    out = bytearray(bits // 8)
    for r in parts.repartition("block").sortWithinPartitions("block").mapInArrow(merged(twice), "block int, bits binary").toLocalIterator():
        out[r["block"] * BLOCK // 8 : (r["block"] + 1) * BLOCK // 8] = spread(bytes(r["bits"])).tobytes()
    return parts.sparkSession.sparkContext.broadcast(bytes(out))
