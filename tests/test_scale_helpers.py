"""Skew-safe helpers against straightforward references on skewed data."""

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.functions.prefix import bucketed_scan
from netweave.functions.quantile import exact_quantiles, order_statistics


def test_quantiles_equal_linear_interpolation(spark):
    rng = np.random.default_rng(7)
    ties = np.concatenate([np.full(3000, 5.0), rng.integers(0, 1000, 6000).astype(float)])
    wide = np.concatenate([-np.exp(rng.uniform(-300, 300, 4500)), np.exp(rng.uniform(-300, 300, 4500))])
    df = spark.createDataFrame([(float(a), float(b), None if i % 3 else float(b), None) for i, (a, b) in enumerate(zip(ties, wide))],
                               "a double, b double, c double, d double")
    for q in (0.0, 0.05, 0.5, 0.95, 1.0):
        got = exact_quantiles(df, ["a", "b", "c", "d"], q)
        want = [np.percentile(x, q * 100) for x in (ties, wide, wide[::3])]
        assert [got[c] for c in "abc"] == [pytest.approx(w, rel=1e-12) for w in want] and got["d"] is None


def test_quantiles_of_special_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(v,) for v in (nan, inf, -inf, 1.0, 2.0, None, 1.7e308, -1.7e308)], "v double")
    assert order_statistics(df, [("v", r) for r in range(6)]) == {
        ("v", 0): -inf, ("v", 1): -1.7e308, ("v", 2): 1.0, ("v", 3): 2.0, ("v", 4): 1.7e308, ("v", 5): inf}
    assert np.isnan(order_statistics(df, [("v", 6)])["v", 6])
    assert exact_quantiles(df.limit(0), ["v"], 0.5) == {"v": None}


def test_every_tree_has_its_sample(spark):
    """No size at which trees come up short."""
    from netweave.operators.iforest import _tree_samples
    for n in (300, 2560, 2561, 2700, 3100, 5000):
        df = spark.range(n).select(F.col("id").alias("k"), F.rand(1).alias("x"))
        counts = [r["count"] for r in _tree_samples(df, "k", n, 10, 256, 42).groupBy("tree_id").count().collect()]
        assert counts == [256] * 10


def test_bucketed_scan_matches_plain_window_with_a_hot_key(spark):
    # key "hot" holds a third of all rows
    rows = []
    for i in range(3000):
        k = "hot" if i % 3 == 0 else f"k{i % 50}"
        rows.append((k, i, f"2024-01-01 00:00:00", i * 37 % 86400 * 5, i % 7))
    df = (spark.createDataFrame(rows, "k string, id long, base string, off long, v long")
          .withColumn("ts", F.timestamp_add("SECOND", F.col("off"), F.col("base").cast("timestamp_ntz")))
          .drop("base", "off"))
    _check_scan(df, dict(bucket_seconds=3600))
    # burst: force hot (key, bucket) groups to be cut into finer time slices
    _check_scan(df, dict(bucket_seconds=86400 * 30, max_rows_per_group=50))


def _check_scan(df, kw):
    got = bucketed_scan(df, ["k"], "ts", "id", sums={"v": F.col("v")}, want_prev_ts=True,
                        want_first_ts=True, **kw)
    w = Window.partitionBy("k").orderBy("ts", "id")
    ref = df.select("id", F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("rv"),
                    F.lag("ts").over(w).alias("pt"), F.min("ts").over(Window.partitionBy("k")).alias("ft"))
    j = got.join(ref, "id")
    assert j.count() == 3000
    bad = j.where((F.col("run_v") != F.col("rv")) | ~F.col("prev_ts").eqNullSafe(F.col("pt"))
                  | (F.col("first_ts") != F.col("ft")))
    assert bad.count() == 0


def test_bursts_are_cut_by_rows(spark):
    """3,000 rows of one key within two seconds, 800 of them in one instant."""
    from netweave.functions.prefix import _fine_buckets
    df = spark.range(3000).select(
        F.lit("hot").alias("k"), F.col("id"), (F.col("id") % 7).alias("v"),
        F.timestamp_add("MICROSECOND", F.when(F.col("id") < 800, 5).otherwise(F.col("id") * 613 % 2_000_000),
                        F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).alias("ts"))
    groups = _fine_buckets(df, ["k"], "ts", "id", 3600, 100).groupBy("k", "__b").count()
    assert groups.agg(F.max("count")).first()[0] <= 130
    _check_scan(df, dict(bucket_seconds=3600, max_rows_per_group=100))
