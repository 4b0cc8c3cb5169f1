"""Intermediate tables in the shared checkpoint folder."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from netweave.session import scratch_path


#: Bytes of rows that go to a Python worker at once, about. Spark's own bound is
#: 10,000 rows of whatever length.
BATCH_BYTES = 4 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Bound the bytes of an Arrow batch, unless the deployment has done so: the
    JVM and the worker each hold one a task, and a grown buffer is up to twice
    its rows. A row longer than the bound is a batch of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(key):
        spark.conf.set(key, str(BATCH_BYTES))


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any
    more. Spark does so when the driver happens to collect garbage, which a
    driver with little to do may not for the length of a job."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to a folder of its own and read again: cuts the lineage,
    outlives executors, and frees the shuffles behind it."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    del df
    release(spark)
    return out
