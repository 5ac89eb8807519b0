"""A corpus to packed sequences: quality rules, line dedup, near duplicates, mixing, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns a DataFrame; all but the last return the columns of documents, whatever more they hold. Texts of any length are read whole, repeated rows are rows of their own unless a stage says otherwise, and an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexgrid.llm.line_dedup import dedup_lines
from lexgrid.llm.mixing import take
from lexgrid.llm.ngram_join import join_ngrams
from lexgrid.llm.packing import pack, pieces
from lexgrid.llm.quality_rules import kept
from lexgrid.llm.shared import as_row, dropped, of_row, table, tie_order, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts are rejected."""
    return kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, but for one holder of each; every document stays, n_chars follows its text. Null texts stay null."""
    return dedup_lines(docs, counts=False)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that shingles of five words link at a similarity of 0.8 or more, the document of smallest id stays. Rows of one id are one document, of which one row stays, of a text by which the id is the smallest; rows of null id stay, and documents without words."""
    found = join_ngrams(docs, width=5, outer=80, inner=100)
    stays = found.filter(F.col("doc_id") == F.col("component_id")).groupBy(F.col("doc_id").alias("stay_id")).agg(F.min("text_hash").alias("stay_hash"))
    rows = as_row(docs.filter(F.col("doc_id").isNotNull()), row_id=F.col("doc_id").cast("long"), row_hash=F.xxhash64("text"))
    met = rows.join(written(stays, "stays"), (F.col("row_id") == F.col("stay_id")) & (F.col("row_hash") == F.col("stay_hash")))
    first = F.row_number().over(W.partitionBy("row_id", "row_hash").orderBy(*tie_order(docs)))
    stay = met.select("row", first.alias("copy")).filter("copy = 1").select(*of_row(docs.columns))
    return stay.unionAll(docs.filter(F.col("doc_id").isNull()))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; where a source's budget ends in one, its first words. Documents without words go."""
    return take(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens in their sequences; a null text is an empty one, of one token."""
    return pack(pieces(docs))


STAGES = [("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_duplicates", near_duplicates), ("mixing", mixing), ("best_fit_packing", best_fit_packing)]

#: Tokenisers and their bands can't be expressed in SQL; tests hold the pipeline to brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; what a stage has read goes when its result is there."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        dropped(*before)
        before = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
