"""Positions of texts with the bytes around them, in pieces: a text of any length is spread over tasks, and no row carries it whole."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Positions of a piece.
PIECE = 1 << 16


def pieces(corpus: DataFrame, back: int, ahead: int) -> DataFrame:
    """(doc_id, n, start, lead, bytes): each text in pieces of PIECE positions, with `back` bytes before, as far as there are (lead), and `ahead` bytes after."""
    starts = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(PIECE).cast("long"))

    def cut(start: Column) -> Column:
        lead = F.least(start, F.lit(back).cast("long"))
        return F.struct(start.alias("start"), lead.alias("lead"), F.substring("text", (start - lead + 1).cast("int"), (lead + PIECE + ahead).cast("int")).alias("bytes"))

    return corpus.filter("n > 0").select("doc_id", "n", F.explode(F.transform(starts, cut)).alias("piece")).select("doc_id", "n", "piece.*").repartition("doc_id", "start")


def each_position(corpus: DataFrame, step: int, back: int, ahead: int, make: Callable[[Callable[[int | Column, int | Column], Column], Column], Column]) -> DataFrame:
    """doc_id and the fields of make(at, pos), a struct, for every position divisible by step. at(offset, length): the bytes of so many from `offset` after the position on, cut at the text's ends, no further than `back` before it and `ahead` after."""
    first = F.ceil(F.col("start") / step) * step
    last = F.least(F.col("n"), F.col("start") + PIECE) - 1
    there = F.when(first <= last, F.sequence(first.cast("long"), last.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))

    # the lambda only cuts; what is made of the bytes is compiled with the rest of the stage
    def cut(pos: Column) -> Column:
        before = F.least(pos, F.lit(back).cast("long"))
        return F.struct(pos.alias("pos"), F.substring("bytes", (pos - F.col("start") + F.col("lead") - before + 1).cast("int"), (before + ahead).cast("int")).alias("around"))

    rows = pieces(corpus, back, ahead).select("doc_id", F.explode(F.transform(there, cut)).alias("p")).select("doc_id", "p.*")
    own = F.least(F.col("pos"), F.lit(back).cast("long")).cast("int")

    def at(offset, length):
        return F.substring("around", own + offset + 1, F.lit(length) if isinstance(length, int) else length)

    return rows.select("doc_id", make(at, F.col("pos")).alias("made")).select("doc_id", "made.*")


#: Positions that are made at once.
AT_ONCE = 1 << 18


def _tools():
    """Functions that tasks get by value, as executors may lack this package."""

    def spans(batch):
        """Of an Arrow batch of pieces: its bytes as one array and where each row's begin and end, in slices of some AT_ONCE bytes, each with the number of its first row."""
        import numpy as np
        import pyarrow as pa

        if not batch.num_rows:
            return
        column = batch.column("bytes")
        column = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_binary())
        off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        data, row = np.frombuffer(column.buffers()[2], np.uint8), 0
        while row < len(column):
            end = max(row + 1, int(np.searchsorted(off, off[row] + AT_ONCE, "right")) - 1)
            yield row, data[off[row] : off[end]], off[row : end + 1] - off[row]
            row = end

    def found(data, off, wanted: list[bytes]):
        """(which of wanted, row, place in data) of every occurrence, overlaps included, that ends in the row where it begins."""
        import numpy as np

        text, which, places = data.tobytes(), [], []
        for k, p in enumerate(wanted):
            at = text.find(p)
            while at >= 0:
                which.append(k)
                places.append(at)
                at = text.find(p, at + 1)
        which, places = np.array(which, np.int64), np.array(places, np.int64)
        row = np.searchsorted(off, places, "right") - 1
        inside = places + np.array([len(p) for p in wanted], np.int64)[which] <= off[row + 1] if len(places) else np.zeros(0, bool)
        return which[inside], row[inside], places[inside]

    def numbers(batch, first: int, rows: int):
        """n, start and lead of so many pieces."""
        return (batch.column(c).slice(first, rows).to_numpy() for c in ("n", "start", "lead"))

    return spans, found, numbers


def occurrences(corpus: DataFrame, wanted: list[tuple[int, bytes]]) -> DataFrame:
    """(pattern_id, doc_id, pos) of every occurrence of a few patterns of a byte or more (pattern_id, p), overlaps included: texts are searched as they are, and a row is made for what is found."""
    spans, found, numbers = _tools()
    kind, ids, wanted = dict(corpus.dtypes)["doc_id"], [k for k, _ in wanted], [p for _, p in wanted]

    def search(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for first, data, off in spans(batch):
                which, row, place = found(data, off, wanted)
                n, start, lead = numbers(batch, first, len(off) - 1)
                pos = place - off[row] + start[row]
                own = pos < start[row] + PIECE
                if own.any():
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[which[own]]), batch.column("doc_id").take(pa.array(first + row[own])), pa.array(pos[own])], ["pattern_id", "doc_id", "pos"])

    return pieces(corpus, 0, max(map(len, wanted))).mapInArrow(search, f"pattern_id long, doc_id {kind}, pos long")


def keyed_positions(corpus: DataFrame, step: int, key_bytes: int, wanted: list[bytes] | None = None) -> DataFrame:
    """(doc_id, key, y, pos) of every position divisible by step: the next key_bytes bytes, and up to `step` bytes before it, the nearest first; null y at position 0. With wanted, patterns of `step` bytes or more: only the positions that are the first at or after the start of one's occurrence, or of that of its first key_bytes bytes."""
    spans, found, numbers = _tools()
    kind = dict(corpus.dtypes)["doc_id"]
    wanted = wanted and sorted({p[:key_bytes] for p in wanted})

    def cut(data, begin, size, down):
        """Binary array of `size` bytes each from `begin` on, or downwards."""
        import numpy as np
        import pyarrow as pa

        most = int(size.max(initial=0))
        k = np.arange(most)
        at = begin[:, None] - k if down else begin[:, None] + k
        inside = k < size[:, None]
        flat = data[at[inside]] if len(data) else data
        off = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(flat))])

    def make(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            for first, data, off in spans(batch):
                n, start, lead = numbers(batch, first, len(off) - 1)
                end = np.minimum(n, start + PIECE)
                if wanted is None:
                    low = -(-start // step) * step
                    count = np.maximum(0, -(-(end - low) // step))
                    row = np.repeat(np.arange(len(count)), count)
                    pos = low[row] + step * (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count))
                else:
                    _, row, place = found(data, off, wanted)
                    pos = -(-(place - off[row] + start[row] - lead[row]) // step) * step
                    own = (pos >= start[row]) & (pos < end[row])
                    row, pos = row[own], pos[own]
                    _, one = np.unique(off[row] + pos - start[row], return_index=True)
                    row, pos = row[one], pos[one]
                if not len(row):
                    continue
                at = off[row] + lead[row] + pos - start[row]
                key, y = cut(data, at, np.minimum(key_bytes, n[row] - pos), False), cut(data, at - 1, np.minimum(step, pos), True)
                y = pc.if_else(pa.array(pos > 0), y, pa.scalar(None, pa.binary()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(first + row)), key, y, pa.array(pos)], ["doc_id", "key", "y", "pos"])

    return pieces(corpus, step, key_bytes).mapInArrow(make, f"doc_id {kind}, key binary, y binary, pos long")
