"""A stream of patterns against a static index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexgrid.functions.bytes import fill, reversed_bytes
from lexgrid.operators.suffixes import naive_scan


def stream_locate(patterns: DataFrame, points: DataFrame, step: int, corpus: DataFrame | None = None) -> DataFrame:
    """(pattern_id, k, doc_id, pos) of a streaming DataFrame (pattern_id, p, m), in append mode and without state.

    A stream-static join: all cases of a pattern are exploded in one row-wise step, as a streaming query can't count its input first. With the corpus, patterns of fewer than `step` bytes scan its texts, as case 0, and what is longer than a cut key is tested on the stored text. Without it both are errors: the first always, the second where a key as long as the longest is all the start of a longer rest.
    """
    made = []
    for k in range(1, step + 1):
        n2 = 0 if k == 1 else step - k + 1
        p1 = F.substring("p", n2 + 1, 1 << 30) if n2 else F.col("p")
        low, high = ((F.concat(reversed_bytes(F.col("p"), n2), fill(b, k - 1)) for b in ("00", "FF")) if n2 else (F.lit(None).cast("binary"),) * 2)
        made.append(F.struct(F.lit(k).alias("k"), F.lit(n2).cast("long").alias("n2"), p1.alias("p1"), low.alias("ymin"), high.alias("ymax")))
    asked = patterns.filter(F.col("m") >= step) if corpus is not None else patterns.filter(F.when(F.col("m") < step, F.raise_error(F.lit(f"a pattern of fewer than {step} bytes needs the corpus")).cast("boolean")).otherwise(F.lit(True)))
    cases = asked.select("p", "m", "pattern_id", F.explode(F.array(*made)).alias("c")).select("pattern_id", "p", "m", "c.*").withColumn("cx", F.substring("p1", 1, 1))
    starts = F.substring("key", F.lit(1), F.octet_length("p1")) == F.col("p1")
    fits = (F.col("k") == 1) | F.col("y").between(F.col("ymin"), F.col("ymax"))
    beyond = (F.octet_length("key") < F.octet_length("p1")) & (F.substring("p1", F.lit(1), F.octet_length("key")) == F.col("key"))
    met = cases.join(points, "cx").filter(fits)
    columns = ["pattern_id", "k", "doc_id", (F.col("pos") - F.col("n2")).alias("pos")]
    if corpus is None:
        longest = points.agg(F.max(F.octet_length("key"))).first()[0] or 0
        cut = beyond & (F.octet_length("key") == longest)
        return met.filter(F.when(cut, F.raise_error(F.lit(f"a pattern longer than keys of {longest} bytes needs the corpus")).cast("boolean")).otherwise(starts)).select(*columns)
    whole = F.substring("text", (F.col("pos") - F.col("n2") + 1).cast("int"), F.col("m").cast("int")) == F.col("p")
    rest = met.filter(beyond).join(corpus.select("doc_id", "text"), "doc_id").filter(whole)
    short = naive_scan(corpus, patterns.filter(F.col("m") < step), step).select("pattern_id", F.lit(0).alias("k"), "doc_id", "pos")
    return met.filter(starts).select(*columns).unionByName(rest.select(*columns)).unionByName(short)
