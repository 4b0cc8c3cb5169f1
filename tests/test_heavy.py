"""Heavy hitters: exact in two passes, sketches within their error, streams and merged windows."""

import collections
import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweave.operators import heavy as H
from netweave.sources import fixtures as X

PACKETS = "packet_id long, ts timestamp_ntz, src_ip string"


def skewed(spark, n=20_000):
    """A third of one source, a tenth of another, the rest nearly all different; two days."""
    start = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    i = F.col("id")
    ip = F.when(i % 3 == 0, "hot").when(i % 10 == 1, "warm").otherwise(F.concat(F.lit("cold"), (i % 9973).cast("string")))
    return spark.range(n).select(i.alias("packet_id"), (start + F.make_dt_interval(secs=(i * 8).cast("decimal(18,6)"))).alias("ts"), ip.alias("src_ip"))


def exact(rows, share):
    days = collections.defaultdict(collections.Counter)
    for r in rows:
        if r.src_ip is not None and r.ts is not None:
            days[r.ts.date()][r.src_ip] += 1
    return sorted((d, v, n) for d, c in days.items() for v, n in c.items() if n >= share * sum(c.values()))


def test_exact_in_two_passes(spark, sf):
    for packets, share, counters in ((skewed(spark), 0.05, 128), (X.packets(spark, sf), 0.01, 4096)):
        got = H.heavy_hitters(packets, "src_ip", share, counters=counters)
        assert sorted((r.window_start.date(), r.value, r.packets) for r in got.collect()) == exact(packets.collect(), share)


def test_odd_rows(spark):
    t = dt.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(1, t, "a"), (2, t, "b"), (3, t, None), (None, None, "c"), (1, t, "a"), (5, t, "b")], PACKETS)
    assert sorted((r.value, r.packets, r.share) for r in H.heavy_hitters(rows, "src_ip", 0.5).collect()) == [("a", 2, 0.5), ("b", 2, 0.5)]
    assert H.heavy_hitters(rows.limit(0), "src_ip").count() == 0
    assert H.combined(H.window_sketches(rows.limit(0), "src_ip")).count() == 0
    with pytest.raises(ValueError, match="counters"):
        H.heavy_hitters(rows, "src_ip", 0.001, counters=100)


def test_stream_and_merged_windows(spark, tmp_path):
    packets, counters = skewed(spark), 256
    late = spark.createDataFrame([(-1, dt.datetime(2099, 1, 1), "late")], PACKETS)
    path = str(tmp_path / "in")
    packets.repartition(3).write.parquet(path)
    sketches = H.window_sketches(spark.readStream.schema(PACKETS).parquet(path), "src_ip", 3600, counters, watermark="1 hour")
    q = sketches.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
        late.write.mode("append").parquet(path)
        q.processAllAvailable()
    finally:
        q.stop()
    stored = spark.read.parquet(str(tmp_path / "out"))
    true = collections.defaultdict(collections.Counter)
    for r in packets.collect():
        true[r.ts.replace(minute=0, second=0, microsecond=0)][r.src_ip] += 1
    assert {r.window_start: r.packets for r in stored.collect()} == {h: sum(c.values()) for h, c in true.items()}
    for r in H.estimates(stored, 2).collect():
        assert 0 <= r.estimate - true[r.window_start][r.value] <= H.error_share(counters) * r.packets
    whole = sum(true.values(), collections.Counter())
    top = {r.value: r.estimate for r in H.estimates(H.combined(stored, counters), 2).collect()}
    assert set(top) == {"hot", "warm"} and all(0 <= n - whole[v] <= H.error_share(counters) * 20_000 for v, n in top.items())
