"""Corpora, patterns and the binary integer files of suffix arrays, as DataFrames.

corpus: (doc_id, text binary, n long). patterns: (pattern_id, p binary, m long). Null texts and null patterns give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def corpus(df: DataFrame, doc_id: Column, text: Column) -> DataFrame:
    """Any table's text column as bytes. Joins with it are shuffled: a small file of repeated texts can hold far more than it seems, and would be broadcast."""
    raw = F.encode(text, "UTF-8") if dict(df.select(text.alias("t")).dtypes)["t"] == "string" else text
    return df.select(doc_id.alias("doc_id"), raw.alias("text")).filter("text is not null").withColumn("n", F.octet_length("text").cast("long")).hint("merge")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """Whole files as documents; doc_id is the path."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("text"), F.col("length").alias("n"))


def byte_range(text: Column, begin: Column, length: Column) -> Column:
    """Bytes [begin, begin + length), cut at the end."""
    return F.substring(text, begin + 1, length)


def pages(n: Column, begin: Column, length: Column, page: int) -> Column:
    """How many pages of so many bytes a byte range of a text of n bytes touches; the range is cut at the end, and none beyond it."""
    have = F.least(n - begin, length)
    last = F.floor((begin + have - 1) / page)
    return F.when(have > 0, last - F.floor(begin / page) + 1).otherwise(0).cast("long")


def patterns(spark: SparkSession, items: list[str | bytes]) -> DataFrame:
    """A batch of patterns, numbered from 0."""
    rows = [(k, bytearray(x.encode() if isinstance(x, str) else x)) for k, x in enumerate(items)]
    return spark.createDataFrame(rows, "pattern_id long, p binary").withColumn("m", F.octet_length("p").cast("long"))


def integers(spark: SparkSession, path: str, width: int) -> DataFrame:
    """(path, rank, value) of files of little-endian unsigned integers of `width` bytes (5 and 8 for suffix and LCP arrays, 8 for positions). A file is one row until it is exploded, so files are to be split to under 2 GB."""
    files = spark.read.format("binaryFile").load(path).select("path", "content", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"length div {width} - 1"))).alias("rank"))
    at = F.col("rank") * width
    low_first = [F.substring("content", (at + k + 1).cast("int"), F.lit(1)) for k in reversed(range(width))]
    return files.select("path", "rank", F.conv(F.hex(F.concat(*low_first)), 16, 10).cast("long").alias("value"))


def random_positions(text: DataFrame, m: int, each: int, seed: int = 1) -> DataFrame:
    """(doc_id, k, pos): `each` positions of every text of numeric id that has m bytes, where m bytes fit; scattered, and the same in every run."""
    at = F.pmod(F.col("doc_id").cast("long") * 40_503 + F.col("k") * 2_654_435_761 + F.lit(seed), F.col("n") - m + 1)
    return text.filter(F.col("n") >= m).select("doc_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(each - 1).cast("long"))).alias("k")).select("doc_id", "k", at.alias("pos"))


def pattern_positions(text: DataFrame, positions: DataFrame, m: int) -> DataFrame:
    """Patterns of m bytes cut from texts at (doc_id, pos); only whole ones."""
    x = text.join(positions, "doc_id").filter(F.col("pos") + m <= F.col("n"))
    return x.select(F.xxhash64("doc_id", "pos").alias("pattern_id"), F.substring("text", (F.col("pos") + 1).cast("int"), F.lit(m)).alias("p"), F.lit(m).cast("long").alias("m"))
