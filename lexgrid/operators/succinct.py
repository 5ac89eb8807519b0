"""Relations of succinct text indexes: BWT, Psi, LF, rank and select, entropy, neighbours, intervals of a suffix tree, parentheses, trees."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.operators.batches import dealt, small
from lexgrid.sources.store import settled


def zero() -> Column:
    return F.lit(0).cast("long")


def bwt(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, rank, ch): the byte before each suffix; empty for the whole text."""
    at = F.col("pos").cast("int")
    return suffixes.join(corpus, "doc_id").select("doc_id", "rank", F.when(at > 0, F.substring("text", at, F.lit(1))).otherwise(F.lit(b"")).alias("ch"))


def psi(suffixes: DataFrame) -> DataFrame:
    """(doc_id, rank, psi): the rank of the suffix one byte shorter; that of the whole text follows the last."""
    n = F.count(F.lit(1)).over(W.partitionBy("doc_id"))
    here = suffixes.withColumn("after", (F.col("pos") + 1) % n)
    return here.join(suffixes.select("doc_id", F.col("pos").alias("after"), F.col("rank").alias("psi")), ["doc_id", "after"]).select("doc_id", "rank", "psi")


def lf(suffixes: DataFrame) -> DataFrame:
    """(doc_id, rank, lf): the inverse of psi."""
    return psi(suffixes).select("doc_id", F.col("psi").alias("rank"), F.col("rank").alias("lf"))


def symbol_counts(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, ch, n, c): occurrences of each byte, and of all smaller ones."""
    first = suffixes.join(corpus, "doc_id").groupBy("doc_id", F.substring("text", F.col("pos").cast("int") + 1, F.lit(1)).alias("ch")).agg(F.count(F.lit(1)).alias("n"))
    return first.withColumn("c", F.coalesce(F.sum("n").over(W.partitionBy("doc_id").orderBy("ch").rowsBetween(W.unboundedPreceding, -1)), zero()))


def rank_select(sequence: DataFrame) -> DataFrame:
    """sequence (doc_id, rank, ch) with before (equal symbols in front) and nth (from 1): rank(i, c) and select(k, c) are lookups in it."""
    nth = F.row_number().over(W.partitionBy("doc_id", "ch").orderBy("rank")).cast("long")
    return sequence.select("doc_id", "rank", "ch", (nth - 1).alias("before"), nth.alias("nth"))


def backward_search(corpus: DataFrame, suffixes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, lo, hi): the range of ranks by narrowing it a symbol at a time from the pattern's end; texts that don't hold a pattern have no row.

    Texts have no end mark, so the suffix of the last byte alone, which no suffix precedes, comes first among those of its byte. All patterns in all texts take a step together: one join with the running counts for each symbol of the longest pattern.
    """
    marks = settled(bwt(corpus, suffixes).filter("octet_length(ch) = 1"))
    counts = settled(with_tails(corpus, suffixes))
    symbol = lambda k: F.substring("p", (F.col("m") - k).cast("int"), F.lit(1))
    now = settled(counts.join(small(patterns.filter("m > 0").withColumn("ch", symbol(0))), "ch").select("doc_id", "pattern_id", "p", "m", F.col("c").alias("lo"), (F.col("c") + F.col("all") - 1).alias("hi")))
    longest = patterns.agg(F.max("m")).first()[0] or 0
    for k in range(1, longest):
        open_ = now.filter(F.col("m") > k).withColumn("ch", symbol(k)).withColumn("end", F.col("hi") + 1)
        known = count_before(marks, open_.select("doc_id", "ch", F.explode(F.array("lo", "end")).alias("at")).distinct())
        hit = open_.join(known.select("doc_id", "ch", F.col("at").alias("lo"), F.col("before").alias("low")), ["doc_id", "ch", "lo"])
        hit = hit.join(known.select("doc_id", "ch", F.col("at").alias("end"), F.col("before").alias("high")), ["doc_id", "ch", "end"]).filter("low < high")
        start = F.col("c") + F.col("tail")
        step = hit.join(counts, ["doc_id", "ch"]).select("doc_id", "pattern_id", "p", "m", (start + F.col("low")).alias("lo"), (start + F.col("high") - 1).alias("hi"))
        now = settled(now.filter(F.col("m") <= k).unionByName(step))
    return now.select("doc_id", "pattern_id", "lo", "hi")


def with_tails(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, ch, all, c, tail): symbol_counts, and tail is 1 for the text's last byte."""
    last = F.when(F.substring("text", F.col("n").cast("int"), F.lit(1)) == F.col("ch"), 1).otherwise(0)
    return symbol_counts(corpus, suffixes).withColumnRenamed("n", "all").join(corpus, "doc_id").select("doc_id", "ch", "all", "c", last.alias("tail"))


def count_before(sequence: DataFrame, asked: DataFrame) -> DataFrame:
    """asked (doc_id, ch, at) with before: how many ch the sequence (doc_id, rank, ch) has at ranks under `at`. One running count over both, so that the work is linear in their rows."""
    both = sequence.select("doc_id", "ch", F.col("rank").alias("at"), F.lit(1).alias("one")).unionByName(asked.select("doc_id", "ch", "at", F.lit(0).alias("one")))
    w = W.partitionBy("doc_id", "ch").orderBy("at", "one").rowsBetween(W.unboundedPreceding, 0)
    return both.withColumn("before", F.sum("one").over(w)).filter("one = 0").select("doc_id", "ch", "at", "before")


def forward_search(corpus: DataFrame, suffixes: DataFrame, patterns: DataFrame) -> DataFrame:
    """(doc_id, pattern_id, k, lo, hi): the range of ranks of the pattern's first k bytes, for k from 1 to m, as long as it isn't empty. Suffixes meet a pattern by the first byte; each tells how many bytes they share, and ranges come from one aggregate."""
    at = F.col("pos").cast("int")
    rows = suffixes.join(corpus, "doc_id").select("doc_id", "rank", "text", at.alias("pos"), F.substring("text", at + 1, F.lit(1)).alias("c"))
    met = rows.join(small(patterns.filter("m > 0").withColumn("c", F.substring("p", 1, 1))), "c")
    same = F.filter(F.sequence(F.lit(1), F.col("m").cast("int")), lambda k: F.substring("text", F.col("pos") + 1, k) == F.substring("p", F.lit(1), k))
    x = met.select("doc_id", "pattern_id", "rank", F.explode(same).alias("k"))
    return x.groupBy("doc_id", "pattern_id", F.col("k").cast("long").alias("k")).agg(F.min("rank").alias("lo"), F.max("rank").alias("hi"))


def entropy(corpus: DataFrame, k: int) -> DataFrame:
    """(doc_id, entropy): bits a symbol given the k before it; k = 0 for plain."""
    at = dealt(corpus)[0].filter(F.col("n") > k).select("doc_id", "text", F.explode(F.sequence(F.lit(k).cast("long"), F.col("n") - 1)).alias("pos"))
    p = F.col("pos").cast("int")
    counts = at.groupBy("doc_id", F.substring("text", p - k + 1, F.lit(k)).alias("context"), F.substring("text", p + 1, F.lit(1)).alias("ch")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(W.partitionBy("doc_id", "context"))
    total = F.sum("n").over(W.partitionBy("doc_id"))
    return counts.select("doc_id", (-F.col("n") * F.log2(share) / total).alias("part")).groupBy("doc_id").agg(F.sum("part").alias("entropy"))


def smaller_neighbours(rows: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """rows with psv and nsv: the nearest index before and after with a strictly smaller value; null if there is none.

    One pass over sorted groups as an Arrow function, all groups of a batch at a time and whole arrays: least values of 1, 2, 4, ... neighbours, and each index then skips the largest stretches of its group without a smaller one.
    """
    return _neighbours(rows, group, index, value).drop("last")


def _neighbours(rows: DataFrame, group: str, index: str, value: str) -> DataFrame:
    """smaller_neighbours() with `last`, the last index of the group."""
    schema = f"`{group}` {dict(rows.dtypes)[group]}, i long, v double, psv long, nsv long, last long"

    def found(table):
        import numpy as np
        import pyarrow as pa

        table = table.combine_chunks()
        code = table.column(0).combine_chunks().dictionary_encode("encode").indices.to_numpy()
        at, v, n = table.column("i").to_numpy(), table.column("v").to_numpy(), len(code)
        starts = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        sizes = np.diff(np.append(starts, n))
        first, end = np.repeat(starts, sizes), np.repeat(starts + sizes, sizes)

        def before(v, first):
            """Index of the nearest smaller one in front, or one under first."""
            least = [v]
            while 1 << len(least) <= sizes.max():
                step = 1 << len(least) - 1
                least.append(np.minimum(least[-1][step:], least[-1][:-step]))
            end = np.arange(n)
            for k in reversed(range(len(least))):
                step = 1 << k
                fits = end - step >= first
                skip = fits.copy()
                skip[fits] = least[k][end[fits] - step] >= v[fits]
                end[skip] -= step
            return end - 1

        psv, nsv = before(v, first), n - 1 - before(v[::-1], (n - end)[::-1])[::-1]
        named = lambda k, bad: pa.array(at[np.clip(k, 0, n - 1)], pa.int64(), mask=bad)
        return pa.table({group: table.column(0), "i": table.column("i"), "v": table.column("v"), "psv": named(psv, psv < first), "nsv": named(nsv, nsv >= end), "last": at[end - 1]})

    def scan(batches):
        import pyarrow as pa

        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            head, tail = (batch.column(0)[k].as_py() for k in (0, batch.num_rows - 1))
            if held and (head != now or tail != now):
                # whole groups: all but the batch's last one
                code = batch.column(0).dictionary_encode("encode").indices.to_numpy()
                cut = int((code != code[-1]).sum())
                yield from found(pa.Table.from_batches([*held, batch.slice(0, cut)])).to_batches()
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            now = tail
        if held:
            yield from found(pa.Table.from_batches(held)).to_batches()

    narrow = rows.select(group, F.col(index).cast("long").alias("i"), F.col(value).cast("double").alias("v"))
    return narrow.repartition(group).sortWithinPartitions(group, "i").mapInArrow(scan, schema)


def range_minimum(rows: DataFrame, queries: DataFrame, group: str, most: bool = False) -> DataFrame:
    """(query_id, at): the leftmost index of the least (or greatest) value of rows (group, i, v) in each query (query_id, group, l, r), closed. Indices of a group have no gaps.

    Each index knows the best of the 1, 2, 4, ... from it on; a query takes the two stretches that cover it, by equi-joins, so work grows with rows times the logarithm of the longest query.
    """
    longest = queries.agg(F.max(F.col("r") - F.col("l") + 1)).first()[0] or 1
    w, levels = W.partitionBy(group).orderBy("i"), max(1, int(longest).bit_length())
    x = rows.select(group, "i", F.struct((-F.col("v") if most else F.col("v")).alias("v"), F.col("i").alias("i")).alias("m0"))
    for k in range(1, levels):
        x = x.withColumn(f"m{k}", F.least(f"m{k - 1}", F.coalesce(F.lead(f"m{k - 1}", 1 << (k - 1)).over(w), F.col(f"m{k - 1}"))))
    table = x.select(group, "i", F.array(*[f"m{k}" for k in range(levels)]).alias("best"))
    level = (F.length(F.bin(F.col("r") - F.col("l") + 1)) - 1).cast("int")
    asked = queries.filter("l <= r").select("query_id", group, "l", (F.col("r") - F.call_function("shiftleft", F.lit(1).cast("long"), level) + 1).alias("last"), level.alias("level"))
    one = asked.join(table.select(group, F.col("i").alias("l"), F.col("best").alias("one")), [group, "l"])
    two = one.join(table.select(group, F.col("i").alias("last"), F.col("best").alias("two")), [group, "last"])
    return two.select("query_id", F.least(F.get("one", F.col("level")), F.get("two", F.col("level")))["i"].alias("at"))


def interval_symbols(sequence: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, ch, before, inside): for each symbol of the interval [l, r) of ranks of a query (query_id, doc_id, l, r), how many of it stand in front and inside. Each query asks for the running counts of its text's symbols, at most 257, at both ends."""
    symbols = sequence.select("doc_id", "ch").distinct()
    asked = queries.join(symbols, "doc_id")
    known = count_before(sequence, asked.select("doc_id", "ch", F.explode(F.array("l", "r")).alias("at")).distinct())
    x = asked.join(known.select("doc_id", "ch", F.col("at").alias("l"), "before"), ["doc_id", "ch", "l"]).join(known.select("doc_id", "ch", F.col("at").alias("r"), F.col("before").alias("until")), ["doc_id", "ch", "r"])
    return x.select("query_id", "ch", "before", (F.col("until") - F.col("before")).alias("inside")).filter("inside > 0")


def bit_ranks(bits: DataFrame) -> DataFrame:
    """bits (doc_id, i, bit) with rank1 (ones in front), rank10 (falls in front: a one, then a zero at j and j + 1 < i + 1), prev1 and next1 (nearest ones, itself included)."""
    w = W.partitionBy("doc_id").orderBy("i")
    fall = F.when((F.col("bit") == 0) & (F.lag("bit").over(w) == 1), 1).otherwise(0)
    x = bits.withColumn("fall", fall)
    one = F.when(F.col("bit") == 1, F.col("i"))
    ahead = w.rowsBetween(0, W.unboundedFollowing)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    return x.select("doc_id", "i", "bit", F.coalesce(F.sum("bit").over(before), F.lit(0)).cast("long").alias("rank1"), F.sum("fall").over(w).cast("long").alias("rank10"), F.last(one, True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("prev1"), F.first(one, True).over(ahead).alias("next1"))


def bit_select(bits: DataFrame) -> DataFrame:
    """(doc_id, k, i): the place of the k-th one, from 1."""
    return bits.filter("bit = 1").select("doc_id", F.row_number().over(W.partitionBy("doc_id").orderBy("i")).cast("long").alias("k"), "i")


def intervals(lcps: DataFrame) -> DataFrame:
    """(doc_id, i, depth, lb, rb): for each rank i > 0 the widest range around it whose neighbours share at least lcp[i] bytes."""
    near = _neighbours(lcps.filter("rank > 0"), "doc_id", "rank", "lcp")
    return near.select("doc_id", "i", F.col("v").cast("long").alias("depth"), F.coalesce("psv", zero()).alias("lb"), (F.coalesce("nsv", F.col("last") + 1) - 1).alias("rb"))


def lcp_intervals(lcps: DataFrame) -> DataFrame:
    """(doc_id, depth, lb, rb): inner nodes of the suffix tree, as maximal ranges of ranks whose suffixes share `depth` bytes and no more.

    For each LCP value the nearest smaller ones on both sides bound its range; equal ranges are one node.
    """
    n = lcps.groupBy("doc_id").agg((F.max("rank") + 1).alias("n"))
    inner = intervals(lcps).select("doc_id", "depth", "lb", "rb")
    root = n.filter("n > 1").select("doc_id", zero().alias("depth"), zero().alias("lb"), (F.col("n") - 1).alias("rb"))
    return inner.unionByName(root).distinct()


def parentheses(nodes: DataFrame) -> DataFrame:
    """(doc_id, i, bit): the balanced parentheses of nested ranges, 1 for an opening one.

    Range by range outside in: openings sort by their start and width, closings after all openings inside them.
    """
    opens = nodes.select("doc_id", F.col("lb").alias("at"), F.lit(0).alias("side"), (-F.col("rb")).alias("tie"), F.lit(1).alias("bit"))
    closes = nodes.select("doc_id", F.col("rb").alias("at"), F.lit(1).alias("side"), (-F.col("lb")).alias("tie"), F.lit(0).alias("bit"))
    w = W.partitionBy("doc_id").orderBy("at", "side", "tie")
    return opens.unionByName(closes).select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "bit")


def matching_parentheses(bits: DataFrame) -> DataFrame:
    """(doc_id, open, close): find_close of each opening parenthesis. An opening and its closing one are neighbours among those of their excess."""
    w = W.partitionBy("doc_id").orderBy("i")
    level = F.sum(F.when(F.col("bit") == 1, 1).otherwise(-1)).over(w)
    x = bits.withColumn("level", F.when(F.col("bit") == 1, level).otherwise(level + 1))
    nxt = F.lead("i").over(W.partitionBy("doc_id", "level").orderBy("i"))
    return x.withColumn("close", nxt).filter("bit = 1").select("doc_id", F.col("i").alias("open"), "close")


def matching_statistics(one: DataFrame, other: DataFrame, most: int | None = None) -> DataFrame:
    """(doc_id, pos, longest): for each position of `other`, the longest prefix of its suffix, up to `most` bytes (default: as long as the longest text of the side whose texts are shorter), that occurs in the text of `one` of the same id. Substrings of one length meet as hashes of their bytes; lengths are halved in, as an occurrence of a prefix is one of all shorter ones."""
    at = lambda df: df.filter("n > 0").select("doc_id", "text", "n", F.explode(F.sequence(zero(), F.col("n") - 1)).alias("pos"))
    a, now = at(one), at(other).withColumn("longest", zero())
    if most is None:
        most = max(1, min(x.agg(F.max("n")).first()[0] or 0 for x in (one, other)))
    bit = 1 << (most.bit_length() - 1)
    while bit:
        cut = lambda n: F.substring("text", (F.col("pos") + 1).cast("int"), n.cast("int"))
        want = now.withColumn("try", F.col("longest") + bit).withColumn("key", F.when((F.col("try") <= most) & (F.col("pos") + F.col("try") <= F.col("n")), cut(F.col("try"))))
        lengths = want.filter("key is not null").select("doc_id", "try").distinct()
        there = a.join(lengths, "doc_id").filter(F.col("pos") + F.col("try") <= F.col("n")).select("doc_id", "try", cut(F.col("try")).alias("key")).distinct().withColumn("found", F.lit(True))
        now = want.join(there, ["doc_id", "try", "key"], "left").select("doc_id", "text", "n", "pos", F.when(F.col("found"), F.col("try")).otherwise(F.col("longest")).alias("longest"))
        bit >>= 1
    return now.select("doc_id", "pos", "longest")


def statistics_sums(found: DataFrame) -> DataFrame:
    """(doc_id, total): matching_statistics summed up."""
    return found.groupBy("doc_id").agg(F.sum("longest").alias("total"))


def with_bits(bits: DataFrame, put: DataFrame, gone: DataFrame) -> DataFrame:
    """bits after places (doc_id, i) are put in, and then others taken out."""
    marked = lambda df, name: df.select("doc_id", "i").distinct().withColumn(name, F.lit(True))
    x = bits.join(marked(put, "put"), ["doc_id", "i"], "left").join(marked(gone, "gone"), ["doc_id", "i"], "left")
    return x.select("doc_id", "i", F.when(F.col("gone"), 0).when(F.col("put"), 1).otherwise(F.col("bit")).alias("bit"))


def neighbours_hold(rows: DataFrame, claimed: DataFrame, group: str) -> DataFrame:
    """(group, i, holds): whether psv, claimed for rows (group, i, v), is the nearest index before with a smaller value: its value is smaller, and the least between isn't."""
    x = rows.join(claimed, [group, "i"], "left").join(rows.select(group, F.col("i").alias("psv"), F.col("v").alias("there")), [group, "psv"], "left")
    between = x.filter("psv >= 0 and i - psv > 1").select(F.struct(group, "i").alias("query_id"), group, (F.col("psv") + 1).alias("l"), (F.col("i") - 1).alias("r"))
    least = range_minimum(rows, between, group).select("query_id.*", "at").join(rows.select(group, F.col("i").alias("at"), F.col("v").alias("least")), [group, "at"]).drop("at")
    holds = (F.col("there") < F.col("v")) & (F.col("least").isNull() | (F.col("least") >= F.col("v")))
    return x.join(least, [group, "i"], "left").select(group, "i", F.coalesce(holds, F.lit(False)).alias("holds"))


def bit_places(bits: DataFrame, pattern: str) -> DataFrame:
    """(doc_id, k, i): the place of the k-th 0, 1, 10 or 01, from 1; of two bits that of the second."""
    w = W.partitionBy("doc_id").orderBy("i")
    hit = F.col("bit") == int(pattern[-1])
    if len(pattern) == 2:
        hit &= F.lag("bit").over(w) == int(pattern[0])
    found = bits.withColumn("hit", hit).filter("hit")
    return found.select("doc_id", F.row_number().over(w).cast("long").alias("k"), "i")


def reversed_text(corpus: DataFrame) -> DataFrame:
    """The corpus with each text's bytes from last to first."""
    pair = F.regexp_extract_all(F.hex("text"), F.lit("(..)"), F.lit(1))
    return corpus.select("doc_id", F.unhex(F.array_join(F.reverse(pair), "")).alias("text"), "n")


def compressed_array(corpus: DataFrame, suffixes: DataFrame) -> DataFrame:
    """(doc_id, rank, pos, isa, psi, ch): all arrays of a suffix array by rank; isa is that of the position that equals the rank."""
    isa = suffixes.select("doc_id", F.col("pos").alias("rank"), F.col("rank").alias("isa"))
    return suffixes.join(isa, ["doc_id", "rank"]).join(psi(suffixes), ["doc_id", "rank"]).join(bwt(corpus, suffixes), ["doc_id", "rank"])


def extract(text: Column, begin: Column, end: Column) -> Column:
    """Bytes [begin, end], closed."""
    return F.substring(text, begin + 1, end - begin + 1)
