"""Suffix trees as relations: nodes with parents, navigation, orders, suffix and Weiner links, parentheses, level-order bits.

A node is a closed range (lb, rb) of ranks; its depth is the length of its path. Leaves are ranges of one rank. Of an inner node the deepest length counts. Every step is an equi-join, a window over a document's nodes, or an aggregate; no two nodes meet that aren't neighbours.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.functions.bytes import byte_at
from lexgrid.operators.succinct import count_before, intervals, range_minimum, smaller_neighbours, zero

NODE = ["doc_id", "lb", "rb"]


def with_parents(nodes: DataFrame, lcps: DataFrame) -> DataFrame:
    """nodes (doc_id, lb, rb, ...) with plb and prb: of the common prefixes at a range's two edges the longer is that of its parent, which is the interval there. Null for the root."""
    edge = lcps.filter("rank > 0").select("doc_id", F.col("rank").alias("i"), "lcp")
    left, right = edge.select("doc_id", F.col("i").alias("lb"), F.col("lcp").alias("left")), edge.select("doc_id", (F.col("i") - 1).alias("rb"), F.col("lcp").alias("right"))
    x = nodes.join(left, ["doc_id", "lb"], "left").join(right, ["doc_id", "rb"], "left")
    at = F.when(F.col("left").isNull() | (F.col("right") > F.col("left")), F.when(F.col("right").isNotNull(), F.col("rb") + 1)).otherwise(F.col("lb"))
    up = intervals(lcps).select("doc_id", F.col("i").alias("at"), F.col("lb").alias("plb"), F.col("rb").alias("prb"))
    return x.withColumn("at", at).join(up, ["doc_id", "at"], "left").select(*nodes.columns, "plb", "prb")


def tree(corpus: DataFrame, lcps: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, depth, plb, prb) of all nodes, leaves included. A text of one byte has its leaf as root."""
    inner = intervals(lcps).select("doc_id", "lb", "rb", "depth")
    n = corpus.filter("n > 1").select("doc_id", zero().alias("lb"), (F.col("n") - 1).alias("rb"), zero().alias("depth"))
    inner = inner.unionByName(n).groupBy(NODE).agg(F.max("depth").alias("depth"))
    leaves = lcps.join(corpus, "doc_id").select("doc_id", F.col("rank").alias("lb"), F.col("rank").alias("rb"), (F.col("n") - F.col("pos")).alias("depth"))
    return with_parents(inner.unionByName(leaves), lcps)


def children(nodes: DataFrame) -> DataFrame:
    """nodes with ith (which child of its parent, from 1) and slb, srb (the next sibling); null for the root."""
    w = W.partitionBy("doc_id", "plb", "prb").orderBy("lb")
    some = F.col("plb").isNotNull()
    return nodes.select("*", F.when(some, F.row_number().over(w)).cast("long").alias("ith"), F.when(some, F.lead("lb").over(w)).alias("slb"), F.when(some, F.lead("rb").over(w)).alias("srb"))


def edges(nodes: DataFrame, suffixes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, plb, prb, ch, lb, rb): the child of each parent whose edge starts with byte ch; a child whose path is its parent's has an empty one."""
    up = nodes.select("doc_id", F.col("lb").alias("plb"), F.col("rb").alias("prb"), F.col("depth").alias("above"))
    x = nodes.filter("plb is not null").join(up, ["doc_id", "plb", "prb"]).join(suffixes.select("doc_id", F.col("rank").alias("lb"), "pos"), ["doc_id", "lb"]).join(corpus, "doc_id")
    ch = F.when(F.col("depth") > F.col("above"), byte_at(F.col("text"), (F.col("pos") + F.col("above")).cast("int"))).otherwise(F.lit(b""))
    return x.select("doc_id", "plb", "prb", ch.alias("ch"), "lb", "rb")


def labels(nodes: DataFrame, suffixes: DataFrame, corpus: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, label): the bytes of each node's path."""
    x = nodes.join(suffixes.select("doc_id", F.col("rank").alias("lb"), "pos"), ["doc_id", "lb"]).join(corpus, "doc_id")
    return x.select(*NODE, F.substring("text", (F.col("pos") + 1).cast("int"), F.col("depth").cast("int")).alias("label"))


def parens(nodes: DataFrame) -> DataFrame:
    """(doc_id, i, bit, level, lb, rb): balanced parentheses of the nodes in pre-order; level of an opening one, and of its closing one, is the number of those open after it."""
    one = nodes.select(*NODE, F.explode(F.array(F.struct(F.col("lb").alias("at"), F.lit(0).alias("side"), (-F.col("rb")).alias("tie"), F.lit(1).alias("bit")), F.struct(F.col("rb").alias("at"), F.lit(1).alias("side"), (-F.col("lb")).alias("tie"), F.lit(0).alias("bit")))).alias("p")).select(*NODE, "p.*")
    w = W.partitionBy("doc_id").orderBy("at", "side", "tie")
    level = F.sum(F.when(F.col("bit") == 1, 1).otherwise(-1)).over(w)
    return one.select("doc_id", (F.row_number().over(w) - 1).cast("long").alias("i"), "bit", F.when(F.col("bit") == 1, level).otherwise(level + 1).cast("long").alias("level"), "lb", "rb")


def measures(nodes: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, leaves, degree, node_depth, pre, post, bfs): leaves below, children, ancestors, and places from 0 in depth-first order before and after the children and in breadth-first order."""
    degree = nodes.filter("plb is not null").groupBy("doc_id", F.col("plb").alias("lb"), F.col("prb").alias("rb")).agg(F.count(F.lit(1)).alias("degree"))
    above = parens(nodes).filter("bit = 1").select(*NODE, (F.col("level") - 1).alias("node_depth"))
    x = nodes.join(degree, NODE, "left").join(above, NODE)
    own = W.partitionBy("doc_id")
    place = lambda *order: (F.row_number().over(own.orderBy(*order)) - 1).cast("long")
    return x.select(*NODE, (F.col("rb") - F.col("lb") + 1).alias("leaves"), F.coalesce("degree", zero()).alias("degree"), "node_depth", place("lb", F.col("rb").desc()).alias("pre"), place("rb", F.col("lb").desc()).alias("post"), place("node_depth", "lb").alias("bfs"))


def level_order_bits(nodes: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, nr, pos, degree, parent_nr): in breadth-first order each node writes a one and a zero for each child; pos is its one's place. The root is its own parent."""
    m = measures(nodes)
    w = W.partitionBy("doc_id").orderBy("bfs").rowsBetween(W.unboundedPreceding, -1)
    x = m.select(*NODE, F.col("bfs").alias("nr"), (F.col("bfs") + F.coalesce(F.sum("degree").over(w), zero())).alias("pos"), "degree")
    up = m.select("doc_id", F.col("lb").alias("plb"), F.col("rb").alias("prb"), F.col("bfs").alias("up"))
    return x.join(nodes.select(*NODE, "plb", "prb"), NODE).join(up, ["doc_id", "plb", "prb"], "left").select(*NODE, "nr", "pos", "degree", F.coalesce("up", zero()).alias("parent_nr"))


def matches(nodes: DataFrame) -> DataFrame:
    """(doc_id, open, close, excess, enclose) of each opening parenthesis: the closing one (find_close; find_open is the same relation from the other end), those open after it, and the nearest opening one whose pair holds it, null for the outermost."""
    p = parens(nodes)
    opens, closes = p.filter("bit = 1"), p.filter("bit = 0")
    pairs = opens.select(*NODE, F.col("i").alias("open"), F.col("level").alias("excess")).join(closes.select(*NODE, F.col("i").alias("close")), NODE)
    up = opens.select("doc_id", F.col("lb").alias("plb"), F.col("rb").alias("prb"), F.col("i").alias("enclose"))
    return pairs.join(nodes.select(*NODE, "plb", "prb"), NODE).join(up, ["doc_id", "plb", "prb"], "left").select("doc_id", "open", "close", "excess", "enclose")


def lowest_common(lcps: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (query_id, doc_id, i, j) of ranks i <= j with lb, rb and depth of the smallest node that holds both: the interval at the least common prefix between them; a leaf if i = j, with null depth."""
    rows = lcps.filter("rank > 0").select("doc_id", F.col("rank").alias("i"), F.col("lcp").alias("v"))
    asked = pairs.filter("i < j").select("query_id", "doc_id", (F.col("i") + 1).alias("l"), F.col("j").alias("r"))
    least = range_minimum(rows, asked, "doc_id")
    x = pairs.join(least, "query_id", "left").join(intervals(lcps).select("doc_id", F.col("i").alias("at"), "depth", "lb", "rb"), ["doc_id", "at"], "left")
    own = F.col("i") == F.col("j")
    return x.select("query_id", "doc_id", "i", "j", F.when(own, F.col("i")).otherwise(F.col("lb")).alias("lb"), F.when(own, F.col("i")).otherwise(F.col("rb")).alias("rb"), "depth")


def suffix_links(nodes: DataFrame, suffixes: DataFrame, lcps: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, slb, srb): the smallest node that holds the suffixes one byte shorter of an inner node's first and last leaf. Of nodes of a depth of 1 or more, without ends at the text's last byte, which has no shorter suffix."""
    inv = suffixes.select("doc_id", "pos", F.col("rank").alias("to"))
    shorter = lambda c, name: suffixes.select("doc_id", F.col("rank").alias(c), (F.col("pos") + 1).alias("pos")).join(inv, ["doc_id", "pos"]).select("doc_id", c, F.col("to").alias(name))
    x = nodes.filter("depth > 0 and lb < rb").select(*NODE).join(shorter("lb", "one"), ["doc_id", "lb"]).join(shorter("rb", "two"), ["doc_id", "rb"])
    asked = x.select(F.struct(*NODE).alias("query_id"), "doc_id", F.least("one", "two").alias("i"), F.greatest("one", "two").alias("j"))
    return lowest_common(lcps, asked).select("query_id.*", F.col("lb").alias("slb"), F.col("rb").alias("srb"))


def weiner_links(nodes: DataFrame, sequence: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc_id, lb, rb, ch, wlb, wrb): for each node and byte ch that stands before some of its suffixes, the range of ranks of the suffixes that start with ch and then the node's path. sequence: bwt(); counts: (doc_id, ch, c, tail), see backward_search."""
    asked = nodes.filter("depth > 0").select(*NODE).join(counts.select("doc_id", "ch", "c", "tail"), "doc_id")
    at = asked.select("doc_id", "ch", F.explode(F.array(F.col("lb"), F.col("rb") + 1)).alias("at")).distinct()
    known = count_before(sequence.filter("octet_length(ch) = 1"), at)
    x = asked.join(known.select("doc_id", "ch", F.col("at").alias("lb"), F.col("before").alias("low")), ["doc_id", "ch", "lb"])
    x = x.withColumn("end", F.col("rb") + 1).join(known.select("doc_id", "ch", F.col("at").alias("end"), F.col("before").alias("high")), ["doc_id", "ch", "end"]).filter("low < high")
    start = F.col("c") + F.col("tail")
    return x.select(*NODE, "ch", (start + F.col("low")).alias("wlb"), (start + F.col("high") - 1).alias("wrb"))


def cartesian_parens(rows: DataFrame, group: str) -> DataFrame:
    """(group, k, bit, i, first): parentheses of the tree in which a value's children are larger and stand after it: before index i opens, all open ones of larger values close, the last opened first. first, of closing ones: 1 for the first of equal neighbours on a level."""
    near = smaller_neighbours(rows, group, "i", "v")
    end = F.max("i").over(W.partitionBy(group)) + 1
    x = near.select(group, "i", "v", F.coalesce("nsv", end).alias("stop"), F.coalesce("psv", F.lit(-1).cast("long")).alias("psv"))
    # equal values with the same smaller one before them are neighbours on a level
    x = x.withColumn("first", F.when(F.row_number().over(W.partitionBy(group, "psv", "v", "stop").orderBy("i")) == 1, 1).otherwise(0))
    one = x.select(group, F.explode(F.array(F.struct(F.col("i").alias("at"), F.lit(1).alias("side"), zero().alias("tie"), F.lit(1).alias("bit"), F.col("i").alias("i"), F.lit(None).cast("int").alias("first")), F.struct(F.col("stop").alias("at"), F.lit(0).alias("side"), (-F.col("i")).alias("tie"), F.lit(0).alias("bit"), F.col("i").alias("i"), F.col("first").alias("first")))).alias("p")).select(group, "p.*")
    return one.select(group, (F.row_number().over(W.partitionBy(group).orderBy("at", "side", "tie")) - 1).cast("long").alias("k"), "bit", "i", "first")
