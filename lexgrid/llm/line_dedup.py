"""Line dedup: Bloom filters of hashes seen once and twice, exact confirmation of suspected repeats, one holder for each line."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lexgrid.llm.bloom import Seen, filled, places, size_of, test
from lexgrid.llm.shared import BLANKS, as_row, for_python, memory_of, of_row_with_text, written

OWN = ("line_total", "line_dropped")
LEAST = -(1 << 63)
_BLANKS = BLANKS.encode()


def line_keys(text: str, least_chars: int) -> Iterator[bytes]:
    """The key of each line: stripped, A-Z in lower case; empty where it has too few code points."""
    for line in text.encode().split(b"\n"):
        key = line.strip(_BLANKS).lower()
        yield key if len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars) else b""


def dedup_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", least_chars: int = 20, least_docs: int = 3, counts: bool = True) -> DataFrame:
    r"""docs' columns with repeated lines taken out of `text` (and n_chars to match, where it exists), then line_total (lines before) and line_dropped.

    A line's key is the line stripped of blanks, A-Z in lower case. Keys of at least least_chars code points that least_docs documents hold lose all their lines but those of the document of largest id that holds them. Other lines stay, joined by \n.
    First each task puts its lines' hashes into two Bloom filters, of hashes seen and seen again; blocks of them are merged by number, and a bit seen in two tasks counts as seen again. The result, at most MOST_BITS bits whatever the input, goes to all tasks. Then only lines that it suspects are shuffled, once for each document, and counted exactly by key and id.
    Null text stays null and counts as one empty line. Rows of one id are one document; null is the smallest id. Texts of any length are read whole, by the line. An empty table gives an empty one. Columns of docs that have the new names are dropped; with counts=False there are no new columns, and all of docs' stay.
    """
    spark = docs.sparkSession
    for_python(spark)
    at, t = F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(LEAST)), F.col(f"`{text}`")
    lines = docs.agg(F.sum(F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) + 1)).first()[0] or 1
    bits = size_of(lines)
    narrow = docs.filter(t.isNotNull()).select(at.alias("id"), t.alias("text"))

    def fill(batches):
        from xxhash import xxh3_64_intdigest

        memory_of("lines")
        seen = Seen(bits)
        for batch in batches:
            hashes = []
            for x in batch.column(1):
                hashes += {xxh3_64_intdigest(k) for k in line_keys(x.as_py(), least_chars) if k}
            seen.add(np.array(hashes, np.uint64))
        yield from seen.batches()

    again = filled(narrow.mapInArrow(fill, Seen.SCHEMA), bits, twice=True)

    def suspect(batches):
        import pyarrow as pa
        from xxhash import xxh3_64_intdigest

        twice = np.frombuffer(again.value, np.uint8)
        for batch in batches:
            keys, ids = [], []
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                new = {y for y in line_keys(x.as_py(), least_chars) if y}
                keys += new
                ids += [k] * len(new)
            if keys:
                a, b = places(np.array([xxh3_64_intdigest(y) for y in keys], np.uint64), bits)
                hit = np.flatnonzero(test(twice, a) & test(twice, b))
                if len(hit):
                    yield pa.RecordBatch.from_pydict({"key": pa.array([keys[i] for i in hit], pa.binary()), "id": pa.array([ids[i] for i in hit], pa.int64())})

    suspects = written(narrow.mapInArrow(suspect, "key binary, id long"), "suspects")
    again.destroy()
    # a table of its own, so that the join's sides are plain shuffles, of which Spark splits the partition of a key that very many documents hold
    repeated = written(suspects.groupBy("key").agg(F.count_distinct("id").alias("docs"), F.max("id").alias("holder")).filter(F.col("docs") >= least_docs).select("key", "holder"), "repeated")
    drops = suspects.join(repeated, "key").filter(F.col("id") < F.col("holder")).groupBy(F.col("id").alias("drop_id")).agg(F.collect_set("key").alias("drops"))

    met = as_row(docs, row_id=at).join(drops, F.col("row_id") == F.col("drop_id"), "left").select("row", "drops")
    place, names = docs.columns.index(text), docs.columns

    def kept(batches):
        import pyarrow as pa

        for batch in batches:
            row, out, totals, gone = batch.column(0), [], [], []
            for x, d in zip(row.field(place), batch.column(1), strict=True):
                x, d = x.as_py(), set(d.as_py() or ())
                n = 1 if x is None else x.count("\n") + 1
                if d:
                    stay = [y for y, k in zip(x.split("\n"), line_keys(x, least_chars), strict=True) if k not in d]
                    x = "\n".join(stay)
                out.append(x)
                totals.append(n)
                gone.append(n - len(stay) if d else 0)
            fields = [pa.array(out, pa.string()) if k == place else row.field(k) for k in range(row.type.num_fields)]
            yield pa.RecordBatch.from_arrays([pa.StructArray.from_arrays(fields, names=names), pa.array(totals, pa.int64()), pa.array(gone, pa.int64())], names=["row", *OWN])

    schema = StructType([met.schema["row"], *(StructField(name, LongType()) for name in OWN)])
    own = OWN if counts else ()
    return met.mapInArrow(kept, schema).select(*of_row_with_text(docs, F.col(f"row.`{text}`"), text, own), *own)
