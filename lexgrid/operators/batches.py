"""The side of patterns in a join: broadcast only while it is small."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows, and bytes of patterns, up to which a batch is broadcast.
MOST_ROWS, MOST_BYTES = 100_000, 32 << 20
#: Bytes of text of a part that dealt() makes.
PART = 1 << 18
#: Patterns up to which texts are searched for each as they are read.
FEW = 200


def small(batch: DataFrame, size: str = "p") -> DataFrame:
    """The batch, marked for broadcast if its rows and the bytes of its column `size` are few; else as it is, and Spark shuffles both sides."""
    row = batch.agg(F.count(F.lit(1)), F.sum(F.octet_length(size))).first() if size in batch.columns else (batch.count(), 0)
    return F.broadcast(batch) if row[0] <= MOST_ROWS and (row[1] or 0) <= MOST_BYTES else batch


def few(patterns: DataFrame) -> list[tuple[int, bytes]] | None:
    """(pattern_id, p) of a batch of up to FEW patterns; None if there are more."""
    rows = patterns.select("pattern_id", "p").limit(FEW + 1).collect()
    return [(r[0], bytes(r[1])) for r in rows] if len(rows) <= FEW else None


def dealt(corpus: DataFrame, *tables: DataFrame) -> list[DataFrame]:
    """The corpus and tables (doc_id, ...) dealt by doc_id into as many parts as it has PART bytes of text, so that what a task makes of its texts is bounded. By their files, or the size of a shuffle, few tasks would get all of a table of short and repeated texts."""
    parts = -(-(corpus.agg(F.sum("n")).first()[0] or 1) // PART)
    return [x.repartition(parts, "doc_id") for x in (corpus, *tables)]
