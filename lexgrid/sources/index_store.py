"""A point index as Parquet: written clustered, opened with pushdown, measured."""

from __future__ import annotations

import time
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexgrid.operators.batches import small
from lexgrid.operators.points import directory, keyed_points
from lexgrid.operators.search import candidates, cases, locate
from lexgrid.operators.suffixes import sampled, suffix_array, with_lcp

#: Patterns up to which their key ranges become filters of the scan.
PUSHED_PATTERNS = 200
#: Bytes of a row group: its least and greatest keys are the index's inner nodes.
ROW_GROUP = 4 << 20
#: Points from which 129 ranges are made rather than fewer: up to 128 bounds Spark compares a row with one after the other.
MANY_POINTS = 5_000_000
BUILDS = "part string, rows long, seconds double"


def build(corpus: DataFrame, path: str, step: int, key_bytes: int, partitions: int | None = None, ranks: bool = False) -> None:
    """Texts and points of a corpus under `path`; with `ranks` also the sampled suffixes by rank with their common prefixes, and the directory of first bytes. What was written, with rows and seconds, is appended to its build statistics.

    Points are range-partitioned and sorted by first byte, key and the byte before, so that row groups' least and greatest keys leave most of them unread; a hot first byte spreads over many ranges by its key.
    """
    spark, rows = corpus.sparkSession, []

    def write(df: DataFrame, part: str) -> DataFrame:
        began = time.time()
        df.write.mode("overwrite").option("parquet.block.size", ROW_GROUP).parquet(f"{path}/{part}")
        out = spark.read.parquet(f"{path}/{part}")
        rows.append((part, out.count(), time.time() - began))
        return out

    texts = write(corpus, "corpus")
    # in the order of first byte, key and byte before, which are the heads of key and y; what can be cut from these isn't shuffled
    pts, order = keyed_points(texts, step, key_bytes), ["key", "y"]
    bare, ranges = pts.drop("cx", "cy"), int(spark.conf.get("spark.sql.shuffle.partitions"))
    if not partitions and 16 < ranges <= 128 and (texts.agg(F.sum("n")).first()[0] or 0) > MANY_POINTS * step:
        partitions = 129
    dealt = (bare.repartitionByRange(partitions, *order) if partitions else bare.repartitionByRange(*order)).sortWithinPartitions(*order)
    write(dealt.withColumns({"cx": F.substring("key", 1, 1), "cy": F.substring("y", 1, 1)}).select(*pts.columns), "points")
    if ranks:
        samples = write(sampled(with_lcp(texts, suffix_array(texts)), step).repartitionByRange("doc_id", "x").sortWithinPartitions("doc_id", "x"), "samples")
        write(directory(samples, texts), "directory")
    spark.createDataFrame([(step, key_bytes)], "step int, key_bytes int").write.mode("overwrite").parquet(f"{path}/meta")
    spark.createDataFrame(rows, BUILDS).write.mode("append").parquet(f"{path}/builds")


def after(prefix: bytes) -> bytes | None:
    """The least bytes above all that start with prefix; None if there are none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


class Index:
    """An index opened from `path`."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.points, self.corpus = spark.read.parquet(f"{path}/points"), spark.read.parquet(f"{path}/corpus")
        self.step, self.key_bytes = spark.read.parquet(f"{path}/meta").first()

    def part(self, name: str) -> DataFrame:
        """samples, directory or builds, as written."""
        return self.spark.read.parquet(f"{self.path}/{name}")

    def asked(self, patterns: DataFrame) -> DataFrame:
        """The points that a batch can need. Of up to PUSHED_PATTERNS patterns the scan gets each case's first byte and range of keys, and reads only row groups that these meet."""
        heads = cases(patterns, self.step).select("cx", F.substring("p1", 1, self.key_bytes).alias("head")).distinct().limit(PUSHED_PATTERNS * self.step + 1).collect()
        if len(heads) > PUSHED_PATTERNS * self.step:
            return self.points

        def within(r) -> Column:
            head = bytes(r["head"])
            inside, end = (F.col("cx") == F.lit(bytes(r["cx"]))) & (F.col("key") >= F.lit(head)), after(head)
            return inside & (F.col("key") < F.lit(end)) if end else inside

        return self.points.filter(reduce(Column.__or__, map(within, heads), F.lit(False)))

    def locate(self, patterns: DataFrame) -> DataFrame:
        """(pattern_id, k, doc_id, pos) of every occurrence of patterns of any length; what is longer than a key is tested on the texts."""
        return locate(self.asked(patterns), self.corpus, patterns, self.step, self.key_bytes)

    def metrics(self, patterns: DataFrame) -> DataFrame:
        """(pattern_id, cells, candidates, matches) of patterns of `step` bytes or more: what a search touches and finds."""
        wanted = patterns.filter(F.col("m") >= self.step)
        found = self.locate(wanted).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("matches"))
        return candidates(self.points, wanted, self.step).join(small(found), "pattern_id", "left").select("pattern_id", "cells", "candidates", F.coalesce("matches", F.lit(0).cast("long")).alias("matches"))

    def record(self, patterns: DataFrame) -> DataFrame:
        """metrics() of a batch, appended to the index's query statistics; returns all of these."""
        self.metrics(patterns).write.mode("append").parquet(f"{self.path}/queries")
        return self.part("queries")

    def sizes(self) -> DataFrame:
        """(part, files, bytes): files on disk and their bytes."""
        kinds = [x.getPath().getName() for x in self._files(self.path) if x.isDirectory()]
        rows = [(k, len(f), sum(x.getLen() for x in f)) for k in sorted(kinds) for f in [[x for x in self._files(f"{self.path}/{k}") if x.getPath().getName().endswith(".parquet")]]]
        return self.spark.createDataFrame(rows, "part string, files long, bytes long")

    def _files(self, path: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return list(at.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(at))


def page_statistics(ranks: DataFrame, b: int) -> DataFrame:
    """(doc_id, pages, full, rows) of rows (doc_id, x) in pages of b by rank."""
    each = ranks.groupBy("doc_id", F.expr(f"x div {b}").alias("page")).agg(F.count(F.lit(1)).alias("n"))
    return each.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), F.count(F.when(F.col("n") == b, 1)).alias("full"), F.sum("n").alias("rows"))
