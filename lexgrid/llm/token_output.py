"""Token-ID output: documents to files of token ids in order of their ids, and back."""

from __future__ import annotations

import uuid

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.encoding import default_vocabulary, encoder
from lexgrid.llm.shared import file_system, for_python, fresh_path, uri, written
from lexgrid.llm.token_file import Reader, Writer

MANIFEST = "shard long, path string, docs long, tokens long"
#: Bytes of ids in a batch of read rows, at most, but for a single document of more.
BATCH_BYTES = 4 << 20


def write_tokens(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str | None = None, end: int = 0, level: int = 3, folder: str | None = None) -> DataFrame:
    """Encode whole texts and write files under `folder` (a URI that executors can write, else in the shared folder). Returns the manifest, one row for each file: shard, path, docs, tokens.

    Rows are range-partitioned and sorted by id (nulls first, ties by a hash of the text), so files in order of shard, and documents within one, ascend. A null text is an empty one; each document ends with the id `end`. Repeated rows are written as often. An empty table gives an empty manifest. Other columns are not read.
    A task writes a file of its own name and only then its row of the manifest: a file that no row names is the rest of a lost attempt and is never read.
    """
    spark = docs.sparkSession
    for_python(spark)
    vocabulary, folder = vocabulary or default_vocabulary(), uri(spark, folder or fresh_path(spark, "tokens"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text")]

    def write(batches):
        import numpy as np
        import pyarrow as pa

        known, shard = encoder(vocabulary), TaskContext.get().partitionId()
        writer = stream = path = None
        last = np.array([end], "<u4")
        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if writer is None:
                    files, at = file_system(folder)
                    files.create_dir(at, recursive=True)
                    path = f"{folder}/part-{shard:06d}-{uuid.uuid4().hex}.lxt"
                    stream = files.open_output_stream(f"{at}/{path.rpartition('/')[2]}")
                    writer = Writer(stream, 2 if max(known.size - 1, end) < 1 << 16 else 4, level)
                writer.add(k, np.concatenate([np.frombuffer(known.encode(x.as_py()), "<u4"), last]))
        if writer is not None:
            writer.close()
            stream.close()
            yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "docs": [len(writer.ids)], "tokens": [writer.tokens]}, schema=pa.schema([("shard", pa.int64()), ("path", pa.string()), ("docs", pa.int64()), ("tokens", pa.int64())]))

    return written(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(write, MANIFEST), "manifest")


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before it), n_tokens, ids (binary, little-endian unsigned 32-bit integers).

    wanted: ids of documents; then only their frames are decompressed. Every frame's checksum is verified. One task reads one file; where files start is a prefix sum over the manifest, one row for each file.
    """
    asked = None if wanted is None else set(wanted)
    before = F.coalesce(F.sum("tokens").over(W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    files = manifest.select("shard", "path", before.alias("start"))

    def read(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
        for batch in batches:
            for path, start in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                files, at = file_system(path)
                with files.open_input_file(at) as stream:
                    reader, rows, held = Reader(stream, stream.size()), [], 0
                    sizes = [int(reader.table[reader.first[k] : reader.first[k + 1], 1].sum()) // reader.width for k in range(len(reader))]
                    for k, n in enumerate(sizes):
                        if asked is None or reader.doc_id(k) in asked:
                            rows.append((reader.doc_id(k), start, n, reader.tokens(k).tobytes()))
                            held += 4 * n
                        start += n
                        if held >= BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.repartitionByRange(max(1, manifest.count()), "shard").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
