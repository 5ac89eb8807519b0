"""Suffix relations: naive scan, suffix array, inverse, LCP, samples, blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions.bytes import common_prefix
from lexgrid.operators.batches import few, small
from lexgrid.operators.positions import each_position, occurrences
from lexgrid.sources.store import settled

#: Bytes that a suffix is first sorted by; ties are then sorted by doubling.
FIRST_BYTES = 64
#: Texts of more bytes are ranked by ranges over the whole table, not in a window for each document.
WINDOW_BYTES = 1 << 24


def positions(corpus: DataFrame, step: int = 1) -> DataFrame:
    """(doc_id, pos) for every position divisible by step; an empty text has none."""
    return corpus.filter("n > 0").select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(step).cast("long"))).alias("pos"))


def naive_scan(corpus: DataFrame, patterns: DataFrame, longest: int | None = None) -> DataFrame:
    """(pattern_id, doc_id, pos) of every occurrence, overlaps included: of a few patterns by searching the texts, of more by testing each position that starts with the pattern's first byte. An empty pattern occurs at each position. longest: bytes of the longest pattern, of a stream of patterns, which can't be asked."""
    wanted = patterns.filter("p is not null")
    some = few(wanted) if longest is None else None
    if some and all(p for _, p in some):
        return occurrences(corpus, some)
    side = small if longest is None else (lambda df: df)
    most = int(wanted.agg(F.max("m")).first()[0] or 0) if longest is None else longest
    some = each_position(corpus, 1, 0, most, lambda at, pos: F.struct(at(0, 1).alias("c"), at(0, most).alias("head"), pos.alias("pos")))
    hits = some.join(side(wanted.filter("m > 0").withColumn("c", F.substring("p", 1, 1))), "c").filter(F.substring("head", F.lit(1), F.col("m").cast("int")) == F.col("p")).select("pattern_id", "doc_id", "pos")
    every = wanted.filter("m = 0").select("pattern_id")
    if longest is None and every.isEmpty():
        return hits
    return hits.unionByName(some.select("doc_id", "pos").join(side(every), F.lit(True)).select("pattern_id", "doc_id", "pos"))


def ranked(rows: DataFrame, key: str, by_range: bool, within: list[str] | None = None) -> DataFrame:
    """rows (doc_id, pos, key, ...) with rank (of its first equal, from 0, within the document, or within the columns given) and ties (rows of equal key).

    In a window for each document; or, by_range, over ranges of (doc_id, key) that all tasks share: a row's number is its place in its range plus the sizes of the ranges before, one row for each range.
    """
    own = within or ["doc_id"]
    if not by_range:
        same = W.partitionBy(*own, key)
        return rows.select("*", (F.rank().over(W.partitionBy(*own).orderBy(key)) - 1).cast("long").alias("rank"), F.count(F.lit(1)).over(same).alias("ties"))
    ordered = settled(rows.repartitionByRange(*own, key).sortWithinPartitions(*own, key, "pos").withColumn("at", F.monotonically_increasing_id()))
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND((1 << 33) - 1)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select("part", F.coalesce(F.sum("size").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long")).alias("before"))
    numbered = ordered.withColumn("part", part).join(F.broadcast(before), "part").select(*rows.columns, (F.col("before") + place).alias("number"))
    groups = numbered.groupBy(*own, key).agg(F.min("number").alias("low"), F.count(F.lit(1)).alias("ties"))
    starts = groups.groupBy(*own).agg(F.min("low").alias("own_low"))
    return numbered.join(groups.join(starts, own), [*own, key]).select(*rows.columns, (F.col("low") - F.col("own_low")).alias("rank"), "ties")


def suffix_array(corpus: DataFrame, step: int = 1, first_bytes: int = FIRST_BYTES, window_bytes: int = WINDOW_BYTES) -> DataFrame:
    """(doc_id, rank, pos): positions divisible by step in the order of their suffixes (bytes unsigned, shorter first), ranks from 0 in each document.

    Suffixes are sorted by their first bytes. Where a document has ties, and only there, ranks double: a suffix's rank among those of h bytes and that of the suffix h bytes on sort it by 2h bytes; each round sorts only the suffixes that still tie, within their ties. Rounds grow with the logarithm of the longest repeat. Doubling needs all positions of such a document; samples are taken from them after.
    """
    one = settled(_first(corpus, step, first_bytes, window_bytes))
    tied = one.filter("ties > 1").select("doc_id").distinct()
    if tied.isEmpty():
        return one.select("doc_id", "rank", "pos")
    done = one.join(tied, "doc_id", "left_anti").select("doc_id", "rank", "pos")
    rest = corpus.join(tied, "doc_id", "left_semi")
    now = one.join(tied, "doc_id", "left_semi") if step == 1 else settled(_first(rest, 1, first_bytes, window_bytes))
    h, long_docs = first_bytes, corpus.select("doc_id", (F.col("n") > window_bytes).alias("long"))
    while not (again := now.filter("ties > 1")).isEmpty():
        # the others' ranks are final
        ahead = now.select("doc_id", (F.col("pos") - h).alias("pos"), F.col("rank").alias("next"))
        both = again.join(ahead, ["doc_id", "pos"], "left").select("doc_id", "pos", F.col("rank").alias("base"), F.coalesce("next", F.lit(-1).cast("long")).alias("key"))
        better = _ranks(both, long_docs, ["doc_id", "base"]).withColumn("rank", F.col("base") + F.col("rank"))
        now, h = settled(now.filter("ties = 1").unionByName(better.select(*now.columns))), 2 * h
    if step > 1:
        now = now.filter(F.col("pos") % step == 0).withColumn("rank", (F.row_number().over(W.partitionBy("doc_id").orderBy("rank")) - 1).cast("long"))
    return done.unionByName(now.select("doc_id", "rank", "pos"))


def _first(corpus: DataFrame, step: int, first_bytes: int, window_bytes: int) -> DataFrame:
    rows = each_position(corpus, step, 0, first_bytes, lambda at, pos: F.struct(pos.alias("pos"), at(0, first_bytes).alias("key")))
    return _ranks(rows, corpus.select("doc_id", (F.col("n") > window_bytes).alias("long")))


def _ranks(rows: DataFrame, long_docs: DataFrame, within: list[str] | None = None) -> DataFrame:
    """Short documents in windows; long ones, if there are any, by ranges."""
    columns = [*(c for c in rows.columns if c != "key"), "rank", "ties"]
    if long_docs.filter("long").isEmpty():
        return ranked(rows, "key", False, within).select(*columns)
    marked = rows.join(long_docs, "doc_id")
    parts = [ranked(marked.filter(F.col("long") == side).drop("long"), "key", side, within).select(*columns) for side in (False, True)]
    return parts[0].unionByName(parts[1])


def inverse(suffixes: DataFrame) -> DataFrame:
    """(doc_id, pos, isa): the rank of each position's suffix."""
    return suffixes.select("doc_id", "pos", F.col("rank").alias("isa"))


def with_lcp(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, prev, lcp): the suffix before, and the longest common prefix with it; 0 for the first."""
    x = suffixes.withColumn("prev", F.lag("pos").over(W.partitionBy("doc_id").orderBy("rank")))
    x = x.join(corpus, "doc_id")
    lcp = F.when(F.col("prev").isNull(), 0).otherwise(common_prefix(F.col("text"), F.col("pos"), F.col("prev"), F.col("n")))
    return x.select("doc_id", "rank", "pos", "prev", lcp.cast("long").alias("lcp"))


def sampled(lcps: DataFrame, step: int) -> DataFrame:
    """(doc_id, x, pos, lcp) of sampled suffixes, from the full array: positions divisible by step, and the least LCP since the sample before; 0 for the first."""
    by_rank = W.partitionBy("doc_id").orderBy("rank")
    hit = F.when(F.col("pos") % step == 0, 1).otherwise(0)
    group = F.coalesce(F.sum(hit).over(by_rank.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = lcps.withColumn("grp", group)
    x = x.withColumn("least", F.min("lcp").over(W.partitionBy("doc_id", "grp").orderBy("rank"))).filter(F.col("pos") % step == 0)
    return x.select("doc_id", F.col("grp").cast("long").alias("x"), "pos", F.when(F.col("grp") == 0, 0).otherwise(F.col("least")).cast("long").alias("lcp"))


def merged(suffixes: DataFrame, lcps: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, lcp) of two arrays by rank; the first common prefix is 0 whatever is given. Arrays of different lengths, or a rank that one of them lacks, are an error."""
    both = suffixes.select("doc_id", "rank", "pos").join(lcps.select("doc_id", "rank", "lcp"), ["doc_id", "rank"], "full_outer")
    bad = F.col("pos").isNull() | F.col("lcp").isNull()
    lcp = F.when(bad, F.raise_error(F.lit("the arrays differ in length")).cast("long")).when(F.col("rank") == 0, 0).otherwise(F.col("lcp"))
    return both.select("doc_id", "rank", "pos", lcp.cast("long").alias("lcp"))


def interval_positions(suffixes: DataFrame, ranges: DataFrame) -> DataFrame:
    """(query_id, rank, pos): the positions of the ranks lo to hi of each range (query_id, doc_id, lo, hi). Ranges are spread into their ranks, and these join."""
    asked = ranges.filter("lo <= hi").select("query_id", "doc_id", F.explode(F.sequence("lo", "hi")).alias("rank"))
    return asked.join(suffixes, ["doc_id", "rank"]).select("query_id", "rank", "pos")


def verified(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, ordered, permutation): whether each suffix exceeds the one before, by their common prefix and the byte after it, and whether the positions are all of the text's."""
    x = with_lcp(corpus, suffixes).join(corpus, "doc_id")
    byte = lambda at: F.substring("text", (at + F.col("lcp") + 1).cast("int"), F.lit(1))
    up = F.coalesce(byte(F.col("prev")) < byte(F.col("pos")), F.lit(True))
    whole = (F.count_distinct("pos") == F.max("n")) & (F.count(F.lit(1)) == F.max("n")) & (F.min("pos") == 0) & (F.max("pos") == F.max("n") - 1)
    return x.groupBy("doc_id").agg(F.bool_and(up).alias("ordered"), whole.alias("permutation"))


def blocks(lcps: DataFrame, b: int) -> DataFrame:
    """(doc_id, block, first_pos, min_lcp, size): ranks in blocks of b, each with its first suffix and least LCP."""
    return lcps.groupBy("doc_id", F.expr(f"rank div {b}").alias("block")).agg(F.min_by("pos", "rank").alias("first_pos"), F.min("lcp").alias("min_lcp"), F.count(F.lit(1)).alias("size"))


def insert(suffixes: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, pos): the set with new positions, each once."""
    return suffixes.select("doc_id", "pos").unionByName(new.select("doc_id", "pos")).dropDuplicates(["doc_id", "pos"])


def delete(suffixes: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, pos): the set without positions; those it doesn't hold don't matter."""
    return suffixes.select("doc_id", "pos").join(gone.select("doc_id", "pos"), ["doc_id", "pos"], "left_anti")
