"""Exact top-k search: a ball tree for each shard, blocks of queries, k-th scores shared."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.ball_tree import Tree
from lexgrid.llm.shared import for_python, written

#: Vectors in a shard and queries in a block, at most.
SHARD, BLOCK = 4096, 256
#: Rows of an Arrow batch where each holds a tree and a block of queries, megabytes.
TREE_ROWS = 8
LEAST = -(1 << 63)


def whole_numbers(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as a double; null if the vector is null, empty or holds a null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & ~bad, F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long")))


def gathered(rows: DataFrame, most: int, make, schema: str) -> DataFrame:
    """Each task's rows (id, v) to rows of make(ids, matrix), of vectors of one length, `most` at a time."""

    def run(batches):
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            for k, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids, rows = held.setdefault(len(v), ([], []))
                ids.append(k)
                rows.append(v)
                if len(ids) == most:
                    yield make(np.array(ids, np.int64), np.array(rows, np.int64))
                    del held[len(v)]
        for ids, rows in held.values():
            yield make(np.array(ids, np.int64), np.array(rows, np.int64))

    return rows.mapInArrow(run, schema)


def top_k(vectors: DataFrame, queries: Column, *, k: int = 10, vec_id: str = "vec_id", vector: str = "embedding", scale: int = 1024) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that `queries` holds for, the k rows of highest integer inner product, exact, rank from 1, ties to smaller ids; all if there are fewer.

    Rows are dealt into shards of SHARD, each kept as a ball tree in the shared folder; queries into blocks of BLOCK. Each block first searches one shard, whose k-th scores bound every later search; then every block meets every shard, and k-th scores pass on from shard to shard within a task. A query set against all rows, in blocks, is that many products at worst; the bounds leave out what can't win.
    Vectors that are null, empty or hold a null or non-finite component take no part; nor do null ids. Vectors meet only vectors of their length. A row of the query's id isn't its candidate; other rows of one id are candidates each; of rows of one id the smallest vector asks. No queries or an empty table give an empty result. Other columns are not read.
    """
    for_python(vectors.sparkSession)
    all_rows = written(vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), whole_numbers(F.col(f"`{vector}`"), scale).alias("v"), queries.alias("asks")).filter("id is not null and v is not null"), "vectors")
    asked = all_rows.filter("asks").groupBy("id").agg(F.min("v").alias("v"))
    n_shards, n_blocks = -(-all_rows.count() // SHARD) or 1, -(-asked.count() // BLOCK) or 1

    def shard(ids, rows):
        import pyarrow as pa

        return pa.RecordBatch.from_pydict({"at": [uuid.uuid4().hex], "wide": pa.array([rows.shape[1]], pa.int32()), "tree": pa.array([Tree(ids, rows).dump()], pa.binary())})

    def block(ids, rows):
        import pyarrow as pa

        order = np.argsort(ids)
        return pa.RecordBatch.from_pydict({"at": [uuid.uuid4().hex], "wide": pa.array([rows.shape[1]], pa.int32()), "ids": pa.array([ids[order].tobytes()], pa.binary()), "rows": pa.array([rows[order].tobytes()], pa.binary())})

    number = F.row_number().over(W.partitionBy("wide").orderBy("at")) - 1
    shards = written(gathered(all_rows.select("id", "v").repartition(n_shards), SHARD, shard, "at string, wide int, tree binary"), "shards")
    blocks = written(gathered(asked.select("id", "v").repartition(n_blocks), BLOCK, block, "at string, wide int, ids binary, rows binary"), "blocks")
    # numbers from 0 for each length: a window over one small row for each shard or block
    shards = shards.join(shards.select("wide", "at").select("at", number.alias("shard")), "at").drop("at")
    blocks = blocks.join(blocks.select("wide", "at").select("at", number.alias("block")), "at").drop("at")
    there = shards.groupBy(F.col("wide").alias("w")).agg(F.count(F.lit(1)).alias("shards"))

    def search(batches):
        import pyarrow as pa

        shared: dict[tuple, np.ndarray] = {}
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("wide", pa.int32()), ("block", pa.int32()), ("floor", pa.binary())])
        for batch in batches:
            for r in batch.to_pylist():
                ids, tree = np.frombuffer(r["ids"], np.int64), Tree.load(r["tree"])
                key = r["wide"], r["block"]
                known = shared.get(key, np.full(len(ids), LEAST))
                if r["floor"] is not None:
                    known = np.maximum(known, np.frombuffer(r["floor"], np.int64))
                best, shared[key] = tree.search(ids, np.frombuffer(r["rows"], np.int64).reshape(len(ids), -1), known, k)
                rows = [(int(q), v, s, None, None, None) for q, b in zip(ids, best, strict=True) for s, v in b]
                rows.append((None, None, None, r["wide"], r["block"], shared[key].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    out = "query_id long, vec_id long, score long, wide int, block int, floor binary"
    counted = blocks.join(F.broadcast(there), F.col("wide") == F.col("w"))
    first = counted.withColumn("shard", F.col("block") % F.col("shards")).drop("w", "shards")
    seed = written(first.join(shards, ["wide", "shard"]).select("wide", "block", "ids", "rows", "tree", F.lit(None).cast("binary").alias("floor")).mapInArrow(search, out).filter("floor is not null").select("wide", "block", "floor"), "seeds", TREE_ROWS)
    pairs = counted.join(seed, ["wide", "block"]).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards").cast("int") - 1))).drop("w", "shards")
    found = written(pairs.join(shards, ["wide", "shard"]).select("wide", "block", "ids", "rows", "tree", "floor").mapInArrow(search, out).filter("query_id is not null").select("query_id", "vec_id", "score"), "found", TREE_ROWS)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").filter(F.col("rank") <= k)
