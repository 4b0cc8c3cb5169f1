"""Streams over time-ordered Parquet slices equal their batch twins.

Two far-future sentinel packets (excluded from the comparison) advance the
watermark so that every real window/session is closed and emitted.
"""

import datetime as dt
import tempfile
import time

from pyspark.sql import functions as F

from netweave.operators import packets as PK
from netweave.sources import fixtures as X
from netweave.sources import io as IO
from netweave.streaming import jobs as J

SENTINEL_IP = "0.0.0.1"


def _stream_dir(spark, sf):
    d = tempfile.mkdtemp(prefix="nw-stream-")
    pk = X.packets(spark, sf)
    lo, hi = pk.agg(F.min("ts"), F.max("ts")).first()
    hi = hi + dt.timedelta(seconds=1)
    step = (hi - lo) / 4
    for i in range(4):
        a, b = lo + step * i, lo + step * (i + 1)
        (pk.where((F.col("ts") >= F.lit(str(a)).cast("timestamp_ntz")) & (F.col("ts") < F.lit(str(b)).cast("timestamp_ntz")))
         .coalesce(1).write.mode("append").parquet(f"{d}/packets"))
        time.sleep(1.1)
    for j, day in enumerate(["2099-01-01", "2099-03-01"]):
        s = spark.createDataFrame([(10 ** 12 + j, f"{day} 00:00:00", SENTINEL_IP, "0.0.0.2", 6, 1, 2, 40)],
                                  "packet_id long, ts string, src_ip string, dst_ip string, proto_num int, "
                                  "src_port int, dst_port int, length long")
        s.withColumn("ts", F.col("ts").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(f"{d}/packets")
        time.sleep(1.1)
    return d, pk


def _run(q):
    q.awaitTermination()


def test_streams_equal_batch_twins(spark, sf):
    d, pk = _stream_dir(spark, sf)
    src = IO.read_packets(spark, f"{d}/packets", streaming=True, max_files_per_trigger=1)
    gap = 6 * 3600
    _run(J.flow_sessions_stream(src, gap).writeStream.format("memory").queryName("t_sess").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", f"{d}/c1").start())
    s = spark.table("t_sess").where(F.col("src_ip") != SENTINEL_IP).select(
        *PK.FLOW_KEY, "session_start", "session_last", "packets", "bytes")
    b = PK.flow_sessions(pk, gap).select(*PK.FLOW_KEY, "session_start", "session_last", "packets", "bytes")
    assert s.count() == b.count()
    assert s.exceptAll(b).count() == 0

    _run(J.packet_rate_stream(src).writeStream.format("memory").queryName("t_rate").outputMode("append")
         .trigger(availableNow=True).option("checkpointLocation", f"{d}/c2").start())
    s = spark.table("t_rate").where(F.col("window_start") < F.lit("2090-01-01").cast("timestamp_ntz"))
    b = PK.packet_rate(pk, 10, 1)
    assert s.count() == b.count()
    assert s.exceptAll(b.select(*s.columns)).count() == 0

    _run(J.running_features_stream(src, idle_timeout_seconds=90 * 86400).writeStream.format("memory")
         .queryName("t_run").outputMode("append").trigger(availableNow=True)
         .option("checkpointLocation", f"{d}/c3").start())
    cols = ["packet_id", "total_fwd_packets", "total_length_fwd_packets", "flow_duration", "fwd_iat_total"]
    s = spark.table("t_run").where(F.col("src_ip") != SENTINEL_IP).select(*cols)
    b = PK.running_features(pk).select(*cols)
    assert s.count() == b.count() == pk.count()
    assert s.exceptAll(b).count() == 0


def test_alert_sink_is_idempotent_and_matches_batch(spark, sf):
    """Flows arriving as a stream produce the same structured alerts as the
    batch pipeline; replaying the same input adds nothing."""
    from netweave.operators import alerts as A
    from netweave.operators import detect as D
    from netweave.operators import enrich as E
    from netweave.plans import pipelines as P
    d = tempfile.mkdtemp(prefix="nw-alerts-")
    fl = X.flows(spark, sf)
    ca = P.as_of(fl)
    rules = P.generated_rules(fl, ca)
    fl.repartition(3).write.parquet(f"{d}/flows")
    stream = spark.readStream.schema(fl.schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/flows")
    J.alerts_sink(stream, X.geoip(spark, sf), rules, f"{d}/alerts", f"{d}/ck", created_at=ca).awaitTermination()
    got = spark.read.parquet(f"{d}/alerts").select(*A.ALERT_COLUMNS)
    want = A.to_alerts(D.detect_suspicious(E.enrich_flows(fl, X.geoip(spark, sf)), rules, use_policy=True), ca)
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0
    J.alerts_sink(spark.readStream.schema(fl.schema).parquet(f"{d}/flows"), X.geoip(spark, sf), rules,
                  f"{d}/alerts", f"{d}/ck2", created_at=ca).awaitTermination()
    assert spark.read.parquet(f"{d}/alerts").count() == want.count()


def test_attack_scoring_sink_writes_attack_rows(spark, sf):
    from netweave.operators import enrich as E
    from netweave.operators import ml as ML
    d, pk = _stream_dir(spark, sf)
    clean = IO.clean_flow_features(X.labelled_flows_from(X.flows(spark, sf)))
    # Labels that small flows, as the packet table has them, satisfy.
    frame = ML.labelled_training_frame(clean).withColumn("label", (F.col("total_fwd_packets") < 20).cast("double"))
    model = ML.train_attack_model(frame, num_trees=5, max_depth=4)
    src = IO.read_packets(spark, f"{d}/packets", streaming=True, max_files_per_trigger=1)
    J.attack_scoring_sink(J.flow_sessions_stream(src, 6 * 3600), model, f"{d}/attacks", f"{d}/c9").awaitTermination()
    out = spark.read.parquet(f"{d}/attacks")
    assert {r.prediction for r in out.select("prediction").distinct().collect()} == {"Attack"}
    stored = X.attack_alerts_from(E.enrich_flows(X.flows(spark, sf), X.geoip(spark, sf)))
    assert set(out.columns) == {*stored.columns, "date"}
    before = out.count()
    J.attack_scoring_sink(J.flow_sessions_stream(src, 6 * 3600), model, f"{d}/attacks", f"{d}/c10").awaitTermination()
    assert spark.read.parquet(f"{d}/attacks").count() == before == out.select("id").distinct().count()


def test_out_of_order_packets_equal_the_batch(spark):
    """Slices shuffled in time within the watermark; a packet later than the
    watermark is dropped."""
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(seconds=s), f"10.0.0.{i % 2}", "8.8.8.8", 6, 1, 2, 100 + i)
            for i, s in enumerate([30, 5, 20, 0, 60, 45, 15, 90, 70, 10, 100, 95])]
    late = [(99, base + dt.timedelta(seconds=1), "10.0.0.0", "8.8.8.8", 6, 1, 2, 7)]
    end = [(10 ** 12 + j, dt.datetime(2099, 1 + j, 1), SENTINEL_IP, "0.0.0.2", 6, 1, 2, 40) for j in range(2)]
    schema = IO.PACKET_SCHEMA
    d = tempfile.mkdtemp(prefix="nw-order-")
    later = [[(97 + i, base + dt.timedelta(days=1 + i), "10.0.0.5", "8.8.8.8", 6, 1, 2, 1)] for i in range(2)]
    for part in (rows[:5], rows[5:9], rows[9:], *later, late, end[:1], end[1:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{d}/packets")
        time.sleep(1.1)
    src = IO.read_packets(spark, f"{d}/packets", streaming=True, max_files_per_trigger=1)
    _run(J.running_features_stream(src, watermark="2 minutes").writeStream.format("memory").queryName("t_order")
         .outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{d}/c").start())
    got = spark.table("t_order").where(F.col("packet_id") < 90)
    want = PK.running_features(spark.createDataFrame(rows, schema))
    assert set(got.columns) == set(want.columns)
    assert got.count() == len(rows) and got.select(*want.columns).exceptAll(want).count() == 0
    assert spark.table("t_order").where("packet_id = 99").count() == 0

    _run(J.live_flows_stream(src, idle_seconds=600, watermark="2 minutes").writeStream.format("memory").queryName("t_live")
         .outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{d}/c2").start())
    last = spark.table("t_live").where("dst_ip = '8.8.8.8' AND src_ip IN ('10.0.0.0', '10.0.0.1')").groupBy("src_ip").agg(
        F.max("packets").alias("p"), F.max("bytes").alias("b"), F.min("first_seen").alias("f"), F.max("last_seen").alias("l"))
    flows = PK.flows_from_packets(spark.createDataFrame(rows, schema)).select("src_ip", "packets", "bytes", "first_seen", "last_seen")
    assert sorted(map(tuple, last.collect())) == sorted(map(tuple, flows.collect()))
