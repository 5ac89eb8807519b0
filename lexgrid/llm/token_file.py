"""Files of token ids: one or more zstandard frames for each document, then a directory of documents, then a seek table.

The file is a zstandard file: the directory and the seek table are skippable frames, and the seek table is that of the zstandard seekable format, with checksums. A reader takes the two from the file's end and then decompresses the frames of the documents that it wants, and no others.

directory: "LXTD", version u16, bytes for each id u16, documents u64, XXH64 of the rest u64, zstandard frame of: ids of documents i64 each, null flags u8 each, frames of each u32.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import xxhash
import zstandard

#: Fixed values of the zstandard formats.
SKIPPABLE, SEEK_TABLE, SEEKABLE = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1
CHECKSUMS = 0x80
#: Of this format.
MAGIC, VERSION = b"LXTD", 1
HEAD = struct.Struct("<4sHHQQ")


class Corrupt(ValueError):
    """A checksum or a length doesn't agree."""


class Writer:
    """Appends documents to an open binary stream. width: 2 or 4 bytes for each id. A document of over frame_bytes has several frames."""

    def __init__(self, stream, width: int = 4, level: int = 3, frame_bytes: int = 1 << 22):
        self.stream, self.width, self.frame_bytes = stream, width, frame_bytes // width * width
        self.compressor = zstandard.ZstdCompressor(level=level)
        self.table, self.ids, self.nulls, self.frames, self.tokens = [], [], [], [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype(f"<u{self.width}").tobytes()
        cuts = [raw[i : i + self.frame_bytes] for i in range(0, max(1, len(raw)), self.frame_bytes)]
        for cut in cuts:
            packed = self.compressor.compress(cut)
            self.stream.write(packed)
            self.table.append((len(packed), len(cut), xxhash.xxh64_intdigest(cut) & 0xFFFFFFFF))
        self.ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.frames.append(len(cuts))
        self.tokens += len(ids)

    def close(self) -> None:
        body = self.compressor.compress(np.array(self.ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.frames, "<u4").tobytes())
        head = HEAD.pack(MAGIC, VERSION, self.width, len(self.ids), xxhash.xxh64_intdigest(body))
        self.stream.write(struct.pack("<II", SKIPPABLE, len(head) + len(body)) + head + body)
        table = np.array(self.table, "<u4").tobytes() + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        self.stream.write(struct.pack("<II", SEEK_TABLE, len(table)) + table)


class Reader:
    """Random access to the documents of a seekable binary stream of the given size."""

    def __init__(self, stream, size: int):
        self.stream = stream
        n, flags, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise Corrupt("no seek table with checksums")
        table = self._at(size - 17 - 12 * n, 8 + 12 * n)
        if struct.unpack("<II", table[:8]) != (SEEK_TABLE, 12 * n + 9):
            raise Corrupt("the seek table's length")
        self.table = np.frombuffer(table[8:], "<u4").reshape(n, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        directory = self._at(int(self.at[-1]), size - 17 - 12 * n - int(self.at[-1]))
        magic, version, self.width, docs, check = HEAD.unpack(directory[8 : 8 + HEAD.size])
        body = directory[8 + HEAD.size :]
        if magic != MAGIC or version != VERSION or xxhash.xxh64_intdigest(body) != check:
            raise Corrupt("the directory")
        body = zstandard.ZstdDecompressor().decompress(body)
        self.nulls = np.frombuffer(body, "u1", docs, 8 * docs).astype(bool)
        self.ids = np.frombuffer(body, "<i8", docs)
        self.first = np.concatenate([[0], np.cumsum(np.frombuffer(body, "<u4", docs, 9 * docs))]).astype(np.int64)

    def _at(self, start: int, n: int) -> bytes:
        self.stream.seek(start)
        got = self.stream.read(n)
        if len(got) != n:
            raise Corrupt("the file ends early")
        return got

    def __len__(self) -> int:
        return len(self.ids)

    def doc_id(self, k: int) -> int | None:
        return None if self.nulls[k] else int(self.ids[k])

    def tokens(self, k: int) -> np.ndarray:
        """Ids of the k-th document, as unsigned 32-bit integers."""
        a, b = int(self.first[k]), int(self.first[k + 1])
        packed, raw = self._at(int(self.at[a]), int(self.at[b] - self.at[a])), []
        for i in range(a, b):
            cut = zstandard.ZstdDecompressor().decompress(packed[int(self.at[i] - self.at[a]) : int(self.at[i + 1] - self.at[a])], max_output_size=max(1, int(self.table[i, 1])))
            if len(cut) != self.table[i, 1] or xxhash.xxh64_intdigest(cut) & 0xFFFFFFFF != self.table[i, 2]:
                raise Corrupt(f"frame {i}")
            raw.append(cut)
        return np.frombuffer(b"".join(raw), f"<u{self.width}").astype("<u4")

    def find(self, doc_id: int | None) -> Iterator[np.ndarray]:
        """Ids of each document of that id."""
        for k in np.flatnonzero(self.nulls if doc_id is None else (self.ids == doc_id) & ~self.nulls):
            yield self.tokens(int(k))
