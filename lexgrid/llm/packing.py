"""Best-fit packing: documents into sequences under token, document-count and attention-cost capacities."""

from __future__ import annotations

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexgrid.llm.encoding import default_vocabulary, encoder
from lexgrid.llm.shared import as_row, for_python, local, of_row, written

#: Rows of a plan up to which it is broadcast (48 bytes each).
BROADCAST_ROWS = 200_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Open sequences by their residual capacities; those that agree in all are one class, kept as ranges of sequence numbers."""

    def __init__(self, capacity: np.ndarray, weights: np.ndarray, rule: str):
        self.capacity, self.weights, self.rule = capacity, weights / capacity, rule
        self.left, self.alive = np.zeros((64, len(capacity)), np.int64), np.zeros(64, bool)
        self.ranges: list[list[tuple[int, int]]] = []
        self.number: dict[tuple, int] = {}
        self.opened = 0

    def add(self, left: np.ndarray, first: int, n: int) -> None:
        k = self.number.get(key := tuple(left.tolist()))
        if k is None:
            k = self.number[key] = len(self.ranges)
            self.ranges.append([])
            if k == len(self.left):
                self.left, self.alive = np.concatenate([self.left, np.zeros_like(self.left)]), np.concatenate([self.alive, np.zeros_like(self.alive)])
            self.left[k] = left
        self.ranges[k].append((first, n))
        self.alive[k] = True

    def best(self, need: np.ndarray) -> int | None:
        """The class whose residual after the item has the least weighted norm; or, by rule "dot", whose residual points most the item's way."""
        k = np.flatnonzero(self.alive[: len(self.ranges)] & (self.left[: len(self.ranges)] >= need).all(1))
        if not len(k):
            return None
        after = np.sqrt((((self.left[k] - need) * self.weights) ** 2).sum(1))
        if self.rule == "dot":
            now = self.left[k] * self.weights
            after = -(now * (need * self.weights)).sum(1) / np.maximum(np.sqrt((now**2).sum(1)), 1e-300)
        return int(k[np.argmin(after)])

    def place(self, need: np.ndarray, n: int) -> list[tuple[int, int, int, int]]:
        """Place n equal items: (first sequence, items, tokens already there, items for each sequence).

        By least norm, what one item was best put in is the best for the next one too, as long as it fits; so a sequence is filled before the next. By "dot" each sequence of a class gets one.
        """
        out, some = [], need > 0
        while n:
            k = self.best(need)
            if k is None:
                each = int((self.capacity[some] // need[some]).min())
                if each < 1:
                    raise ValueError(f"an item of {need.tolist()} exceeds the capacities {self.capacity.tolist()}")
                m = -(-n // each)
                self.add(self.capacity, self.opened, m)
                self.opened += m
                continue
            left = self.left[k].copy()
            each = 1 if self.rule == "dot" else int((left[some] // need[some]).min())
            first, m = self.ranges[k].pop()
            use = min(m, -(-n // each))
            items = min(n, use * each)
            if use < m:
                self.ranges[k].append((first + use, m - use))
            self.alive[k] = bool(self.ranges[k])
            out.append((first, items, int(self.capacity[0] - left[0]), each))
            full, rest = divmod(items, each)
            if full:
                self.add(left - each * need, first, full)
            if rest:
                self.add(left - rest * need, first + full, 1)
            n -= items
        return out


def plan(counts: dict[int, int], capacity: int, most_docs: int, most_attention: int, weights: tuple[float, float, float], rule: str) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, items, first sequence, offset, items for each sequence) for all items, counted by length; the longest first.

    An item's demand (tokens, 1 document, length squared) depends on its length alone, so equal lengths are placed together and the work depends on the number of lengths, not of items.
    """
    bins, rows = Bins(np.array([capacity, most_docs, most_attention], np.int64), np.array(weights), rule), []
    for length in sorted(counts, reverse=True):
        rank = 0
        for first, n, offset, each in bins.place(np.array([length, 1, length * length], np.int64), counts[length]):
            rows.append((length, rank, n, first, offset, each))
            rank += n
    return rows


def pack(items: DataFrame, *, length: str = "length", capacity: int = 2048, most_docs: int | None = None, most_attention: int | None = None, weights: tuple[float, float, float] = (1.0, 1.0, 1.0), rule: str = "norm") -> DataFrame:
    """items' columns, then sequence_id and offset: vector best-fit decreasing over the whole table.

    Capacities of a sequence: `capacity` tokens, `most_docs` items (default: as many as tokens) and `most_attention` for the sum of squared lengths (default: capacity squared; both defaults never bind, but their residuals count in the choice). Items come longest first. An item goes to the open sequence that it leaves with the least weighted residual norm (rule "norm"), or whose residual points most its way ("dot"), among those that hold it under every constraint; else to a new one.
    Only counts by length reach the driver, `capacity` rows at most. Each partition numbers its items of a length, counts by partition and length turn these into ranks in the table, and ranks look up the plan.
    Items of null or no length get null sequence and offset. A length over a capacity is an error. Repeated rows are items of their own. An empty table gives an empty one. Columns of items that have the new names are dropped.
    """
    spark, own = items.sparkSession, ("sequence_id", "offset")
    boxed = as_row(items, length=F.col(f"`{length}`").cast("long"))
    schema = StructType([*boxed.schema.fields, StructField("part", LongType()), StructField("rank", LongType())])

    def ranked(batches):
        import pyarrow as pa

        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            x = np.asarray(batch.column(1).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            if len(x) and x.max() > capacity:
                raise ValueError(f"an item of {x.max()} tokens exceeds the capacity {capacity}")
            x = np.maximum(x, 0)
            order = np.argsort(x, kind="stable")
            there = x[order]
            first = np.concatenate([[True], there[1:] != there[:-1]]) if len(x) else np.zeros(0, bool)
            rank = np.empty(len(x), np.int64)
            rank[order] = np.arange(len(x)) - np.maximum.accumulate(np.where(first, np.arange(len(x)), 0)) + seen[there]
            seen += np.bincount(x, minlength=capacity + 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(x), part)), pa.array(rank)], names=["row", "length", "part", "rank"])

    rows = written(boxed.mapInArrow(ranked, schema), "pack_items")
    counts = rows.filter("length > 0").groupBy(F.col("part").alias("start_part"), F.col("length").alias("start_length")).agg(F.count(F.lit(1)).alias("items"))
    before = F.coalesce(F.sum("items").over(W.partitionBy("start_length").orderBy("start_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    totals = {r["start_length"]: r["items"] for r in counts.groupBy("start_length").agg(F.sum("items").alias("items")).collect()}
    made = plan(totals, capacity, most_docs or capacity, most_attention or capacity * capacity, weights, rule)
    steps = local(spark, made, "step_length long, first long, step_items long, sequence long, place long, each long")
    starts = counts.select("start_part", "start_length", before.alias("before"))
    x = rows.join(starts, (F.col("part") == F.col("start_part")) & (F.col("length") == F.col("start_length")), "left").withColumn("rank", F.col("rank") + F.col("before"))
    on = (F.col("length") == F.col("step_length")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("step_items"))
    x = x.join(F.broadcast(steps) if len(made) <= BROADCAST_ROWS else steps, on, "left")
    nth = F.col("rank") - F.col("first")
    sequence = (F.col("sequence") + F.expr("(rank - first) div each")).alias("sequence_id")
    return x.select(*of_row(items.columns, own), sequence, (F.col("place") + nth % F.col("each") * F.col("length")).alias("offset"))


def pieces(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 0, capacity: int = 2048) -> DataFrame:
    """Documents to pieces of at most `capacity` ids: doc_id, piece, start, length, ids_crc32.

    A null text is an empty one; each document ends with the id `end`. Only longer documents are cut, from the back, so that the first piece takes what is over. Repeated rows are documents of their own, texts of any length are read whole, an empty table gives an empty one; other columns are not read.
    """
    for_python(docs.sparkSession)
    vocabulary = vocabulary or default_vocabulary()
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))

    def cut(batches):
        import zlib

        import pyarrow as pa

        known, last = encoder(vocabulary), int(end).to_bytes(4, "little")
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            out = []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = known.encode(x.as_py()) + last
                n = len(raw) // 4
                a, piece = 0, 0
                b = (n - 1) % capacity + 1
                while a < n:
                    out.append((k, piece, a, b - a, zlib.crc32(raw[4 * a : 4 * b])))
                    a, b, piece = b, b + capacity, piece + 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # a table of its own: two Python steps in a row would take two workers for each task
    return written(rows.mapInArrow(cut, PIECES), "pieces")
