"""The folder that driver and executors share, and tables settled in it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session, or the checkpoint folder of its context. Where both are unset, a folder of this process in local mode, as in tests; on a cluster that is an error, for executors see no folder of the driver's."""
    context = spark.sparkContext._jsc.sc()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not context.getCheckpointDir().isDefined():
        if not folder and not context.isLocal():
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(folder or f"file://{tempfile.mkdtemp(prefix='lexgrid-')}")
    return folder or context.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df computed once into the shared folder; lineage ends there and lost executors cost only a read."""
    shared_folder(df.sparkSession)
    return _unsized(df.checkpoint(eager=True))


def _unsized(df: DataFrame) -> DataFrame:
    """A checkpoint without the size that Spark carries over from the plan that made it. That is the size of the compressed file it read, however many rows explode() has made of each of its rows, so tables of gigabytes were broadcast through the driver. Of unknown size a table is shuffled, and broadcast only when its shuffle turns out to be small."""
    spark = df.sparkSession
    plan, none = df._jdf.queryExecution().analyzed(), spark._jvm.scala.Option.empty()
    bare = plan.copy(plan.output(), plan.rdd(), plan.outputPartitioning(), plan.outputOrdering(), plan.isStreaming(), plan.stream(), spark._jsparkSession, none, none)
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, bare), spark)
