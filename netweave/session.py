"""Session helpers: a tuned local session for tests/bench and the shared
checkpoint folder for lineage cuts."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

KEPT_BATCH_ROWS = 1000

_SCALE_CONF = {
    # Runtime re-planning: coalesce small shuffles, split skewed join partitions
    # (one source IP may hold a third of all flows).
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Whole-stage methods above 8 KB of bytecode are never JIT-compiled by the
    # JVM and run interpreted (measured 3x slower on the enrichment stage);
    # let Spark split such stages instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Streaming session windows: merge a key's sessions inside each
    # partition before the shuffle (a hot flow sends a few rows, not all).
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app_name: str = "netweave") -> SparkSession:
    """Local session used by tests and the bench (UI off, UTC, AQE on)."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    builder = (builder.config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
               .config("spark.driver.memory", os.environ.get("NETWEAVE_DRIVER_MEMORY", "8g")))
    for k, v in _SCALE_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def _single_process(master: str) -> bool:
    """Whether driver and executors are one process (``local``, ``local[n]``)."""
    return master == "local" or master.startswith("local[")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's checkpoint folder (``spark.checkpoint.dir``).

    On a cluster this must be a shared folder that the deployment sets:
    without one this raises. Only a single-process ``local`` master gets a
    scratch folder of its own, removed when the driver ends.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if configured:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(configured)
        return configured
    current = sc.getCheckpointDir()
    if current:
        return current
    if not _single_process(sc.master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
    local = tempfile.mkdtemp(prefix="netweave-ckpt-")
    atexit.register(shutil.rmtree, local, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", local)
    sc.setCheckpointDir(local)
    return local


def balanced(df):
    """Spread a scan that yields fewer partitions than cores (small inputs
    with few row groups) over all cores; large scans are left untouched."""
    sc = df.sparkSession.sparkContext
    if df.rdd.getNumPartitions() < sc.defaultParallelism:
        return df.repartition(sc.defaultParallelism)
    return df


def split_large_stages(spark: SparkSession) -> None:
    """Lower the limit of ``_SCALE_CONF`` in a session that keeps Spark's own."""
    name = "spark.sql.codegen.hugeMethodLimit"
    if int(spark.conf.get(name)) > int(_SCALE_CONF[name]):
        spark.conf.set(name, _SCALE_CONF[name])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A unique folder below the shared checkpoint folder for derived tables."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")


def materialize(df):
    """Cut lineage with a reliable checkpoint in the shared checkpoint folder
    (survives executor loss, unlike local checkpoints).

    The input is persisted for the duration of the checkpoint so the plan
    runs once (a bare eager checkpoint computes it twice), then released.
    """
    from pyspark import StorageLevel
    ensure_checkpoint_dir(df.sparkSession)
    df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return df.checkpoint(eager=True)
    finally:
        df.unpersist()


@contextlib.contextmanager
def kept(df):
    """``df`` held in memory, and on disk where that is short, for the block: columns
    compressed, parts and their order as they are. A column batch has few rows, since a
    reader of serialised batches holds on to a hundred of them."""
    from pyspark import StorageLevel
    name, spark = "spark.sql.inMemoryColumnarStorage.batchSize", df.sparkSession
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(int(before), KEPT_BATCH_ROWS)))
    try:
        yield df.persist(StorageLevel.MEMORY_AND_DISK)
    finally:
        spark.conf.set(name, before)
        df.unpersist()


def stored(df, name: str):
    """Cut lineage by a compressed table in the shared checkpoint folder: each column can be
    read alone. Parts and their order may change; ``materialize`` keeps them."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
