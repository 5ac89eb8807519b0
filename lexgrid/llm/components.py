"""Connected components of an edge table by alternating stars; every step is a table, whatever its size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.shared import dropped, written


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, label) of every node of an edge: label is the smallest node of its component. Loops and repeated edges don't matter.

    Large star: each node links its larger neighbours to the smallest of its neighbourhood. Small star: each node links its smaller neighbours and itself to the smallest of them. Alternating them ends with each node linked to its component's smallest, after a number of rounds that grows with the logarithm of the nodes. Smallest neighbours are pre-aggregated before they are shuffled, and each round is written to the shared folder.
    """
    up = F.greatest(a, b).alias("u"), F.least(a, b).alias("v")
    now = written(edges.filter(F.col(a) != F.col(b)).select(*up).distinct(), "edges")
    while not is_stars(now):
        before = now
        both = now.unionAll(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").filter("u <> v").distinct()
        now = written(small, "edges")
        dropped(before)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("label"))).distinct()


def is_stars(edges: DataFrame) -> bool:
    """Each larger end has one edge, and none is a smaller end: stars are what the steps come to."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("larger"), F.lit(0).alias("smaller")).unionAll(edges.select("v", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("larger").alias("larger"), F.max("smaller").alias("smaller")).filter("larger > 1 or larger = 1 and smaller = 1").isEmpty()
