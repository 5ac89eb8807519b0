"""Quality classifier: boosted trees over statistics of whole documents."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexgrid.llm.boosted_trees import Trees, train
from lexgrid.llm.quality_rules import repeated_words
from lexgrid.llm.shared import for_python

#: Labelled rows to learn from, at most: those of smallest MD5 of their id. 28 statistics of 8 bytes each: 4.5 MB on the driver.
MOST_ROWS = 20_000
#: Fixed values of the contract.
FOLDS, HELD_OUT, THRESHOLD = 5, 0, 0.3

_KINDS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "blank": (9, 11, 12, 13, 32), "line": (10,), "stop": map(ord, ".!?"), "comma": map(ord, ",;:"), "shout": map(ord, "!"),
    "symbol": map(ord, "#*$%&|<>"), "bracket": map(ord, "()[]{}"), "slash": map(ord, "/\\@_=+~^`"), "quote": map(ord, "'\""), "dash": map(ord, "-"), "high": range(192, 256),
}
_TABLE = np.stack([np.isin(np.arange(256), list(v)) for v in _KINDS.values()]).astype(np.float64)
NAMES = ("log_bytes", "log_words", *(f"{k}_share" for k in _KINDS), "byte_entropy", "word_length", "word_length_spread", "longest_word", "distinct_words", "top_word", "word_entropy", "repeated", "line_length", "dup_lines", "short_lines", "last_stop")


def statistics(text: str | None) -> list[float]:
    """NAMES of one text; all but finite numbers are impossible, and an empty or null text has zeros."""
    raw = (text or "").encode()
    words = raw.split()
    if not words:
        return [0.0] * len(NAMES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    p = counts[counts > 0] / len(raw)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lengths, often = np.array([len(w) for w in words], np.float64), np.array(list(seen.values()), np.float64) / len(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(len(raw)), np.log1p(len(words)), *(_TABLE @ counts / len(raw)), -(p * np.log2(p)).sum(), lengths.mean(), lengths.std(), np.log1p(lengths.max()), len(seen) / len(words), often.max(), -(often * np.log2(often)).sum() / np.log2(len(words) + 1),
        repeated_words(words) / len(words), np.log1p(len(raw) / len(lines)), 1 - len(set(lines)) / len(lines), sum(len(x) < 30 for x in lines) / len(lines), float(raw.rstrip()[-1:] in b".!?"),
    ]


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def learn(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = MOST_ROWS, **how) -> Trees:
    """Train on labelled rows outside the held-out fold: label 0 or 1, one row for each id (the larger label), most_rows at most.

    Only their statistics and labels reach the driver, most_rows rows at most. Texts of any length are measured whole. Ids that are null or that docs doesn't hold teach nothing; nor do other labels.
    """
    for_python(docs.sparkSession)
    y = labels.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{label}`").cast("int").alias("y")).filter(F.col("y").isin(0, 1) & F.col("id").isNotNull() & (fold(F.col("id")) != HELD_OUT))
    y = y.groupBy("id").agg(F.max("y").alias("y")).orderBy(F.md5(F.col("id").cast("string")), "id").limit(most_rows)
    rows = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").alias("text")).join(F.broadcast(y), "id")

    def look(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([statistics(x.as_py()) for x in batch.column(0)], pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "y", "id"])

    # rows of one id teach once, by the least of their statistics
    seen = rows.select("text", "y", F.col("id").cast("long")).mapInArrow(look, "x array<double>, y int, id long").groupBy("id").agg(F.min(F.struct("x", "y")).alias("s"))
    got = seen.select("s.x", "s.y", "id").toArrow()
    order = np.lexsort((np.array(got["y"]), np.array(got["id"])))
    x = np.array(got["x"].to_pylist(), np.float64).reshape(-1, len(NAMES))
    return train(x[order], np.array(got["y"], np.float64)[order], **how)


def score(docs: DataFrame, model: Trees, *, text: str = "text") -> DataFrame:
    """docs' columns, then `score`: the probability of label 1, from statistics of the whole text alone. Null and empty texts have the statistics 0 and a score like others. Each row is scored alone, texts of any length whole; an empty table gives an empty one. A column of docs named score is dropped."""
    for_python(docs.sparkSession)
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() != "score"])

    @F.arrow_udf("double")
    def scored(texts):
        import pyarrow as pa

        return pa.array(model.score(np.array([statistics(x.as_py()) for x in texts], np.float64).reshape(-1, len(NAMES))))

    return docs.withColumn("score", scored(F.col(f"`{text}`")))
