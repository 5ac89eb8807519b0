"""Suffix and LCP arrays as files of integers: written for other programs, and imported."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.operators.suffixes import merged
from lexgrid.sources.text import integers


def write_integers(rows: DataFrame, folder: str, width: int) -> DataFrame:
    """(doc_id, path, n): a file for each document of its values by rank, little-endian unsigned integers of `width` bytes. rows: (doc_id, rank, value). A file that no row names is the rest of a lost attempt."""
    kind = dict(rows.dtypes)["doc_id"]

    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyarrow import fs

        files, at = fs.FileSystem.from_uri(folder)
        files.create_dir(at, recursive=True)
        stream = now = None

        def row():
            stream.close()
            return pa.RecordBatch.from_pydict({"doc_id": doc, "path": [f"{folder}/{name}"], "n": pa.array([n], pa.int64())})

        for batch in batches:
            ids = batch.column(0).to_pylist()
            values = batch.column(2).to_numpy().astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
            cuts = [0, *[i for i in range(1, len(ids)) if ids[i] != ids[i - 1]], len(ids)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if ids[a : a + 1] != now:
                    if stream is not None:
                        yield row()
                    now, doc, name, n = ids[a : a + 1], batch.column(0).slice(a, 1), f"{uuid.uuid4().hex}.{width}", 0
                    stream = files.open_output_stream(f"{at}/{name}")
                stream.write(values[a:b].tobytes())
                n += b - a
        if stream is not None:
            yield row()

    ordered = rows.select("doc_id", "rank", F.col("value").cast("long").alias("value")).repartition("doc_id").sortWithinPartitions("doc_id", "rank")
    return ordered.mapInArrow(write, f"doc_id {kind}, path string, n long")


def read_integers(files: DataFrame, folder: str, width: int) -> DataFrame:
    """(doc_id, rank, value) of the files of a manifest (doc_id, path, n)."""
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    found = integers(files.sparkSession, folder, width).withColumn("name", name(F.col("path"))).drop("path")
    return found.join(files.select("doc_id", name(F.col("path")).alias("name")), "name").select("doc_id", "rank", "value")


def imported(suffixes: DataFrame, lcps: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, lcp) of two arrays (doc_id, rank, value) read in lock-step: of one length, and the first common prefix 0."""
    return merged(suffixes.withColumnRenamed("value", "pos"), lcps.withColumnRenamed("value", "lcp"))
