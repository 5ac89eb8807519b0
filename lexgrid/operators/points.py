"""Geometric points of sampled suffixes: cells, directory, rectangles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.bytes import byte_at, preceding
from lexgrid.operators.batches import dealt, few
from lexgrid.operators.positions import keyed_positions


def points(corpus: DataFrame, samples: DataFrame, step: int) -> DataFrame:
    """(doc_id, cx, cy, x, y, pos): rank x of a sampled suffix, y the `step` bytes before it, nearest first; cx its first byte, cy the byte before. Position 0 has nothing before it and makes no point."""
    at, text = F.col("pos").cast("int"), F.col("text")
    return samples.filter("pos > 0").join(corpus, "doc_id").select("doc_id", byte_at(text, at).alias("cx"), byte_at(text, at - 1).alias("cy"), "x", preceding(text, at, step).alias("y"), "pos")


def keyed_points(corpus: DataFrame, step: int, key_bytes: int, asked: DataFrame | None = None) -> DataFrame:
    """(doc_id, cx, cy, key, y, pos) without any sort: `key`, the next bytes, stands for the rank in prefix tests. One pass over the texts, whole arrays at a time; columns are covering, so a search reads nothing else. Position 0 is kept, with null cy and y, for matches that start there.

    asked: a batch of patterns. If they are few, only the points that they can need are made; the texts are searched for them as they are read.
    """
    wanted = None if asked is None else few(asked.filter(F.col("m") >= step))
    made = keyed_positions(corpus, step, key_bytes, None if wanted is None else [p for _, p in wanted])
    return made.select("doc_id", F.substring("key", 1, 1).alias("cx"), F.substring("y", 1, 1).alias("cy"), "key", "y", "pos")


def directory(samples: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, ch, lo, hi): for each first byte, its range of ranks."""
    first = byte_at(F.col("text"), F.col("pos").cast("int"))
    corpus, samples = dealt(corpus, samples)
    return samples.join(corpus.hint("merge"), "doc_id").groupBy("doc_id", first.alias("ch")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"))


def cells(pts: DataFrame) -> DataFrame:
    """(doc_id, cx, cy, points): points of each cell."""
    return pts.groupBy("doc_id", "cx", "cy").agg(F.count(F.lit(1)).alias("points"))


def bounds(pts: DataFrame) -> DataFrame:
    """Bounding box of each document's points."""
    return pts.groupBy("doc_id").agg(F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"), F.count(F.lit(1)).alias("points"))


def in_rectangle(x: Column, y: Column, r: str) -> Column:
    """Closed on all sides."""
    return x.between(F.col(f"{r}lx"), F.col(f"{r}hx")) & y.between(F.col(f"{r}ly"), F.col(f"{r}hy"))


def intersect_open(a: str, b: str) -> Column:
    """As intersect(), but rectangles that share no more than a line meet there only if both sides there are closed: of the one that ends first its upper side (flag hx_in or hy_in), and of the other its lower side (lx_in or ly_in)."""
    c = F.col

    def touch(v: str) -> Column:
        same = F.greatest(c(f"{a}l{v}"), c(f"{b}l{v}")) == F.least(c(f"{a}h{v}"), c(f"{b}h{v}"))
        first = (c(f"{a}h{v}") < c(f"{b}h{v}")) & ~(c(f"{a}h{v}_in") & c(f"{b}l{v}_in"))
        second = (c(f"{b}h{v}") < c(f"{a}h{v}")) & ~(c(f"{b}h{v}_in") & c(f"{a}l{v}_in"))
        return ~(same & (first | second))

    return intersect(a, b) & touch("x") & touch("y")


def rebased(pts: DataFrame, first: DataFrame) -> DataFrame:
    """Points with what their cell implies left out: x less the first rank of its byte (directory()), y without its first byte."""
    lo = first.select("doc_id", F.col("ch").alias("cx"), "lo")
    return pts.join(lo, ["doc_id", "cx"]).select("doc_id", "cx", "cy", (F.col("x") - F.col("lo")).alias("x"), F.substring("y", 2, 1 << 30).alias("y"), "pos")


def intersect(a: str, b: str) -> Column:
    """Closed rectangles share a point."""
    c = F.col
    return (F.greatest(c(f"{a}lx"), c(f"{b}lx")) <= F.least(c(f"{a}hx"), c(f"{b}hx"))) & (F.greatest(c(f"{a}ly"), c(f"{b}ly")) <= F.least(c(f"{a}hy"), c(f"{b}hy")))


def contains(a: str, b: str) -> Column:
    """Rectangle a holds all of b."""
    c = F.col
    return (c(f"{a}lx") <= c(f"{b}lx")) & (c(f"{b}hx") <= c(f"{a}hx")) & (c(f"{a}ly") <= c(f"{b}ly")) & (c(f"{b}hy") <= c(f"{a}hy"))


def range_join(pts: DataFrame, rects: DataFrame, width: int) -> DataFrame:
    """Points (x, y, ...) with the rectangles (rect_id, lx, hx, ly, hy) that hold them, by numbers.

    Rectangles are spread over the strips of x, `width` wide, that they touch and meet points of the strip alone: an equi-join with the bounds as what is left to test, never a nested loop.
    """
    strips = rects.filter("lx <= hx and ly <= hy").withColumn("strip", F.explode(F.sequence(F.floor(F.col("lx") / width), F.floor(F.col("hx") / width))))
    x = pts.withColumn("strip", F.floor(F.col("x") / width)).join(strips, "strip")
    return x.filter(in_rectangle(F.col("x"), F.col("y"), "")).drop("strip", "lx", "hx", "ly", "hy")
