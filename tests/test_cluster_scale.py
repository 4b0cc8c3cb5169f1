"""Clusters: what is held for the passes, and the centres that they find."""

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from netweave.operators import ml as ML
from netweave.session import KEPT_BATCH_ROWS, kept


def test_kept_batches_are_small(spark):
    name = "spark.sql.inMemoryColumnarStorage.batchSize"
    before, df = spark.conf.get(name), spark.range(5000)
    with kept(df) as held:
        assert int(spark.conf.get(name)) == KEPT_BATCH_ROWS < int(before)
        assert held.storageLevel.useMemory and held.storageLevel.useDisk and held.count() == 5000
    assert spark.conf.get(name) == before and not df.storageLevel.useMemory


def test_centers_are_those_of_sparks_kmeans(spark):
    df = spark.range(0, 3000, 1, 4).select(F.array(*[F.coalesce(F.randn(i) + (F.col("id") % 4) * i, F.lit(0.0)) for i in range(4)]).alias("features")).cache()
    for k in (2, 5):
        want = KMeans(k=k, seed=42).fit(df)
        got = ML.kmeans_centers(df, k, 42)
        assert np.allclose(got, want.clusterCenters(), atol=1e-9)
        mine = df.select(ML._nearest("features", got).alias("c"), "features")
        assert want.transform(mine).where("c != prediction").count() == 0


def test_rows_alike_are_one_cluster(spark):
    df = spark.range(50).select("id", F.lit(1.0).alias("x"), F.lit(None).cast("double").alias("y"))
    assert ML.cluster_flows(df, ["x", "y"]).select("cluster").distinct().count() == 1
