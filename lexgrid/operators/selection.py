"""Order statistics: numbers of rows in an order over all tasks, the k-th, parts around a pivot, order of suffixes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions.bytes import common_prefix
from lexgrid.sources.store import settled


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with `number`, their place from 0 in the order: ranges of rows are sorted by all tasks, and a row's number is its place in its range plus the sizes of those before, one row for each range."""
    at = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = sizes.select("_part", F.coalesce(F.sum("_size").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("_before"))
    return at.withColumn("_part", part).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + place).alias("number"))


def kth(rows: DataFrame, order: list[str], k: int) -> DataFrame:
    """The k-th row, from 0, in the order."""
    return numbered(rows, order).filter(F.col("number") == k).drop("number")


def kth_point(points: DataFrame, k: int, depth: int) -> DataFrame:
    """The k-th point by x at odd depths and by y at even ones; ties by the other, then id."""
    return kth(points, ["x", "y", "id"] if depth % 2 else ["y", "x", "id"], k)


def split(rows: DataFrame, value: str, pivot: Column) -> DataFrame:
    """rows with `side`: -1, 0 or 1 as the value is below, at or above the pivot."""
    return rows.withColumn("side", F.signum(F.col(value) - pivot).cast("int"))


def median_of_three(first: Column, middle: Column, last: Column) -> Column:
    return F.element_at(F.array_sort(F.array(first, middle, last)), 2)


def compare_suffixes(text: Column, p: Column, q: Column, n: Column) -> Column:
    """-1, 0 or 1 as the suffix at p comes before that at q, is it, or comes after."""
    same = common_prefix(text, p, q, n)
    byte = lambda at: F.substring(text, (at + same + 1).cast("int"), F.lit(1))
    return F.when(p == q, 0).when(byte(p) < byte(q), -1).otherwise(1)
