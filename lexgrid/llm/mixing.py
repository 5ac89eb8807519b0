"""Mixing sources to target weights: hash-random order, distributed prefix sums, exact cuts. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.shared import as_row, of_row, of_row_with_text, tie_order, word_count, written

#: The lowest of the 28 bits of a hash key that number its bucket.
KEY_BITS = 28
OWN = ("mix_size", "mix_source_size", "mix_target", "mix_taken")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(mix_source, source_size) to (mix_source, source_size, target, epochs, rest).

    Sources in code-point order, null last, take the weights in turn and divide share * all sizes; none gets more than `most` times its own size, and what it can't take goes to the others by weight. That is one water level, found where the next source in order of capacity per weight isn't full: a window over one row per source.
    """
    named = W.orderBy(F.col("mix_source").asc_nulls_last())
    full = W.orderBy("ratio", F.col("mix_source").asc_nulls_last())
    x = sizes.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(named) - 1) % len(weights) + 1).cast("int")).alias("weight"), (F.lit(float(most)) * F.col("source_size")).alias("top"))
    x = x.select("*", (F.col("top") / F.col("weight")).alias("ratio"), (F.lit(float(share)) * F.sum("source_size").over(W.partitionBy())).alias("all"))
    x = x.select("*", ((F.col("all") - F.coalesce(F.sum("top").over(full.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(full.rowsBetween(0, W.unboundedFollowing))).alias("level"), F.row_number().over(full).alias("n"))
    x = x.select("*", F.min(F.when(F.col("ratio") >= F.col("level"), F.struct("n", "level"))).over(W.partitionBy())["level"].alias("water"))
    x = x.select("mix_source", "source_size", F.coalesce(F.least(F.col("weight") * F.col("water"), F.col("top")), F.col("top")).alias("target"))
    budget = F.floor(F.col("target") + 0.5).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(floor(target + 0.5) as long) div source_size")).otherwise(F.lit(0)).cast("long")
    return x.select("mix_source", "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))


def mix(docs: DataFrame, *, size: Column | None = None, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix", bucket_rows: int = 1024, columns: bool = True) -> DataFrame:
    """docs' columns, then mix_size, mix_source_size, mix_target (its source's) and mix_taken: the words that the mix takes of the row, repeats counted.

    Within a source, rows stand in the order of MD5(seed, id). A source takes whole passes while its budget lasts, then rows in that order up to the exact budget; the row at the cut gives only its first words. So a source's sum of mix_taken is its target, rounded, and reruns agree.
    Prefix sums: a row's key falls into one of about rows / bucket_rows ranges; ranges are summed, summed up in order, and each range's rows are sorted on their own. Rows that agree in id, source and size are counted before they are sorted, so that a repeated row doesn't fill a range.
    size: a column of whole numbers, else words of the text. A null or negative size counts 0; null ids share one key; null sources are one source, the last. An empty table gives an empty one. Texts of any length are counted whole. Columns of docs that have the new names are dropped; with columns=False docs' columns come as one, `row`, and all of them. Only DataFrame functions run.
    """
    n = F.greatest(F.coalesce(size.cast("long") if size is not None else word_count(F.col(f"`{text}`")), F.lit(0).cast("long")), F.lit(0).cast("long"))
    # the row in one column, so that no name of its clashes
    rows = as_row(docs, row_id=F.col(f"`{doc_id}`"), row_source=F.col(f"`{source}`"), mix_size=n)
    key = F.md5(F.concat_ws("|", F.lit(seed), F.col("mix_id").cast("string")))
    groups = written(
        rows.groupBy(F.col("row_id").alias("mix_id"), F.col("row_source").alias("mix_source"), F.col("mix_size").alias("group_size")).agg(F.count(F.lit(1)).alias("copies")).select("*", key.alias("key")),
        "mix_groups",
    )
    bits = min(KEY_BITS, max(0, math.ceil(math.log2(max(1, groups.count()) / bucket_rows))))
    groups = groups.select("*", F.shiftright(F.conv(F.substring("key", 1, KEY_BITS // 4), 16, 10).cast("long"), KEY_BITS - bits).alias("range"), (F.col("group_size") * F.col("copies")).alias("words"))
    ranges = groups.groupBy("mix_source", "range").agg(F.sum("words").alias("words"))
    goals = targets(ranges.groupBy("mix_source").agg(F.sum("words").alias("source_size")), weights, share, most)
    before = F.coalesce(F.sum("words").over(W.partitionBy("mix_source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    starts = ranges.select("mix_source", "range", before.alias("range_start"))
    within = F.coalesce(F.sum("words").over(W.partitionBy("mix_source", "range").orderBy("key", "mix_id", "group_size").rowsBetween(W.unboundedPreceding, -1)), F.lit(0).cast("long"))
    same = lambda a, b, *names: [a[x].eqNullSafe(b[x]) for x in names]
    g = groups.select("mix_id", "mix_source", "group_size", "range", within.alias("within"), "copies")
    g = g.join(starts, same(g, starts, "mix_source", "range")).select(g["*"], starts["range_start"])
    g = g.join(goals, same(g, goals, "mix_source")).select("mix_id", g["mix_source"], "group_size", "copies", (F.col("range_start") + F.col("within")).alias("start"), "source_size", "target", "epochs", "rest")
    places = written(g, "mix_places")
    mine = lambda g: rows.join(g, [rows["row_id"].eqNullSafe(g["mix_id"]), rows["row_source"].eqNullSafe(g["mix_source"]), rows["mix_size"].eqNullSafe(g["group_size"])])
    # only where copies stand on both sides of the cut does it matter which is which: that is one group for each source at most
    cut = (F.col("copies") > 1) & (F.col("start") < F.col("rest")) & (F.col("start") + F.col("copies") * F.col("group_size") > F.col("rest"))
    ties = tie_order(docs, text)
    if places.filter(cut).isEmpty():
        met = mine(places).withColumn("copy", F.lit(0))
    else:
        copy = F.row_number().over(W.partitionBy("mix_id", "mix_source", "group_size").orderBy(*ties)) - 1
        met = mine(places.filter(~cut)).withColumn("copy", F.lit(0)).unionAll(mine(places.filter(cut)).withColumn("copy", copy))
    left = F.col("rest") - F.col("start") - F.col("copy") * F.col("mix_size")
    taken = F.col("epochs") * F.col("mix_size") + F.greatest(F.lit(0).cast("long"), F.least(F.col("mix_size"), left))
    return met.select(*(of_row(docs.columns, OWN) if columns else ["row"]), "mix_size", F.col("source_size").alias("mix_source_size"), F.col("target").alias("mix_target"), taken.alias("mix_taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, blanks as they are."""
    return F.array_join(F.slice(F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])", -1), F.lit(1), n.cast("int")), "")


def take(docs: DataFrame, *, text: str = "text", **how) -> DataFrame:
    """docs' columns: each document as often as whole passes of mix(docs, **how) take it, and once more, cut after its last word, where a pass ends in it."""
    mixed = mix(docs, text=text, columns=False, **how)
    whole = F.when(F.col("mix_size") > 0, F.expr("mix_taken div mix_size")).otherwise(F.lit(0))
    part = F.col("mix_taken") - whole * F.col("mix_size")
    once = mixed.select("row", F.explode(F.when(part > 0, F.sequence(F.lit(0), whole)).when(whole > 0, F.sequence(F.lit(1), whole))).alias("pass"), part.alias("part"))
    words = F.when(F.col("pass") == 0, first_words(F.col(f"row.`{text}`"), F.col("part"))).otherwise(F.col(f"row.`{text}`"))
    return once.select(*of_row_with_text(docs, words, text))
