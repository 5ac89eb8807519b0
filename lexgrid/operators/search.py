"""Pattern search: suffix ranges, and counting and locating by the distance to the next sampled position."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.bytes import fill, reversed_bytes
from lexgrid.operators.batches import small
from lexgrid.operators.suffixes import naive_scan

EMPTY = (-1, -2)


def suffix_range(suffixes: DataFrame, corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, lo, hi): closed range of the ranks whose suffixes start with the pattern; (-1, -2) where there is none.

    The join's key is the first byte; the rest of the prefix is tested on the row, and least and greatest rank come from one partial aggregate.
    """
    at = F.col("pos").cast("int")
    rows = suffixes.join(corpus, "doc_id").select("doc_id", "rank", "text", at.alias("pos"), F.substring("text", at + 1, F.lit(1)).alias("c"))
    asked = patterns.filter("m > 0").withColumn("c", F.substring("p", 1, 1))
    hit = rows.join(small(asked), "c").filter(F.substring("text", F.col("pos") + 1, F.col("m").cast("int")) == F.col("p"))
    found = hit.groupBy("doc_id", "pattern_id").agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))
    # the result has a row for every text and pattern
    every = corpus.select("doc_id").join(small(patterns.select("pattern_id")), F.lit(True))
    none = [F.coalesce(c, F.lit(v).cast("long")).alias(c) for c, v in zip(("lo", "hi"), EMPTY, strict=True)]
    return every.join(found, ["doc_id", "pattern_id"], "left").select("doc_id", "pattern_id", *none)


def prefix_suffixes(suffixes: DataFrame, corpus: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, rank, pos): all suffixes that start with a pattern; all suffixes for an empty one."""
    at = F.col("pos").cast("int")
    rows = suffixes.join(corpus, "doc_id").withColumn("c", F.substring("text", at + 1, F.lit(1)))
    met = rows.join(small(patterns.filter("m > 0").withColumn("c", F.substring("p", 1, 1))), "c").filter(F.substring("text", at + 1, F.col("m").cast("int")) == F.col("p"))
    hits, every = met.select("doc_id", "pattern_id", "rank", "pos"), patterns.filter("m = 0").select("pattern_id")
    return hits if every.isEmpty() else hits.unionByName(suffixes.join(small(every), F.lit(True)).select("doc_id", "pattern_id", "rank", "pos"))


def cases(patterns: DataFrame, step: int) -> DataFrame:
    """Patterns of at least `step` bytes by case k from 1 to step: the first n2 bytes (0 for k = 1, else step - k + 1) stand before a sampled position and the rest, p1, starts there. ymin and ymax bound the bytes before it, nearest first."""
    asked = patterns.filter(F.col("m") >= step)
    out = []
    for k in range(1, step + 1):
        n2 = 0 if k == 1 else step - k + 1
        p1 = F.substring("p", n2 + 1, 1 << 30) if n2 else F.col("p")
        back = reversed_bytes(F.col("p"), n2) if n2 else None
        bound = lambda byte, back=back, k=k: F.concat(back, fill(byte, k - 1)) if back is not None else F.lit(None).cast("binary")
        cy = F.substring("p", n2, 1) if n2 else F.lit(None).cast("binary")
        out.append(asked.select("pattern_id", F.lit(k).alias("k"), F.lit(n2).cast("long").alias("n2"), p1.alias("p1"), F.octet_length(p1).alias("m1"), F.substring(p1, 1, 1).alias("cx"), cy.alias("cy"), bound("00").alias("ymin"), bound("FF").alias("ymax")))
    return reduce(DataFrame.unionByName, out)


def with_short(hits: DataFrame, corpus: DataFrame, patterns: DataFrame, step: int) -> DataFrame:
    """hits and the occurrences of patterns of fewer than `step` bytes, as case 0."""
    short = patterns.filter(F.col("m") < step)
    if short.isEmpty():
        return hits
    return hits.unionByName(naive_scan(corpus, short).select("pattern_id", F.lit(0).alias("k"), "doc_id", "pos"))


def locate(points: DataFrame, corpus: DataFrame, patterns: DataFrame, step: int, key_bytes: int | None = None) -> DataFrame:
    """(pattern_id, k, doc_id, pos) of every occurrence, overlaps included.

    points: keyed_points() of this step, with keys of key_bytes (default: of at least the longest pattern's). Each occurrence falls into exactly one case, so nothing is counted twice. Case 1 joins on the first byte, the others on the cell (cx, cy); the prefix and the bounds of y are tested on the same row. What is longer than a key is then tested on the text. Patterns of fewer than `step` bytes scan the texts.
    """
    asked = cases(patterns, step)
    head = F.least("m1", F.lit(key_bytes)) if key_bytes else F.col("m1")
    asked = asked.withColumn("head", F.substring("p1", F.lit(1), head)).withColumn("m1", head).drop("p1")
    starts = F.substring("key", F.lit(1), F.col("m1")) == F.col("head")
    first = points.join(small(asked.filter("k = 1").drop("cy"), "head"), "cx").filter(starts)
    other = points.filter("y is not null").join(small(asked.filter("k > 1"), "head"), ["cx", "cy"]).filter(starts & F.col("y").between(F.col("ymin"), F.col("ymax")))
    columns = ["pattern_id", "k", "doc_id", (F.col("pos") - F.col("n2")).alias("pos")]
    hits = first.select(*columns).unionByName(other.select(*columns))
    if key_bytes:
        longer = patterns.filter(F.col("m") > key_bytes)
        if not longer.isEmpty():
            x = hits.join(small(longer), "pattern_id").join(corpus.select("doc_id", "text"), "doc_id")
            sure = x.filter(F.substring("text", (F.col("pos") + 1).cast("int"), F.col("m").cast("int")) == F.col("p")).select("pattern_id", "k", "doc_id", "pos")
            hits = hits.join(small(longer.select("pattern_id")), "pattern_id", "left_anti").select("pattern_id", "k", "doc_id", "pos").unionByName(sure)
    return with_short(hits, corpus, patterns, step)


def candidates(points: DataFrame, patterns: DataFrame, step: int) -> DataFrame:
    """(pattern_id, cells, candidates): how many cells a search of points asks for each pattern of `step` bytes or more, and the points in them that it tests. Points are counted by cell before they meet the patterns."""
    held = points.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("points"))
    asked = cases(patterns, step)
    first = held.groupBy("cx").agg(F.sum("points").alias("points")).join(small(asked.filter("k = 1").select("pattern_id", "k", "cx")), "cx")
    other = held.filter("cy is not null").join(small(asked.filter("k > 1").select("pattern_id", "k", "cx", "cy")), ["cx", "cy"])
    met = first.select("pattern_id", "points").unionByName(other.select("pattern_id", "points")).groupBy("pattern_id").agg(F.count(F.lit(1)).alias("cells"), F.sum("points").alias("candidates"))
    none = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("cells", "candidates")]
    return patterns.filter(F.col("m") >= step).select("pattern_id").join(met, "pattern_id", "left").select("pattern_id", *none)


def count(points: DataFrame, corpus: DataFrame, patterns: DataFrame, step: int) -> DataFrame:
    """(pattern_id, occurrences, docs): 0 for patterns that don't occur. Partial counts by document are summed."""
    each = locate(points, corpus, patterns, step).groupBy("pattern_id", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    total = each.groupBy("pattern_id").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("docs"))
    zero = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("occurrences", "docs")]
    return patterns.select("pattern_id").join(total, "pattern_id", "left").select("pattern_id", *zero)


def locate_by_ranges(pts: DataFrame, samples: DataFrame, corpus: DataFrame, patterns: DataFrame, step: int) -> DataFrame:
    """The same by two steps: the range of ranks of p1 among the sampled suffixes, then the points of the cell with x in that range and y in its bounds. Patterns of fewer than `step` bytes scan the texts."""
    asked = cases(patterns, step)
    ranges = suffix_range(samples.select("doc_id", F.col("x").alias("rank"), "pos"), corpus, asked.select(F.struct("pattern_id", "k").alias("pattern_id"), F.col("p1").alias("p"), F.col("m1").cast("long").alias("m"))).filter("lo >= 0")
    boxes = ranges.select("doc_id", "lo", "hi", "pattern_id.*").join(asked, ["pattern_id", "k"])
    one = boxes.filter("k = 1").select("doc_id", "pattern_id", "k", "lo", "hi").join(samples, "doc_id").filter("x between lo and hi").select("pattern_id", "k", "doc_id", "pos")
    more = boxes.filter("k > 1").join(pts, ["doc_id", "cx", "cy"]).filter("x between lo and hi and y between ymin and ymax")
    hits = one.unionByName(more.select("pattern_id", "k", "doc_id", (F.col("pos") - F.col("n2")).alias("pos")))
    return with_short(hits, corpus, patterns, step)
