"""Per-packet features from keyed state, scoring at every packet, and structured
alerts as one streaming query."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.operators import alerts as A
from netweave.operators import detect as D
from netweave.operators import enrich as E
from netweave.operators import packets as PK
from netweave.plans import pipelines as P
from netweave.session import scratch_path
from netweave.sources import fixtures as X
from netweave.sources import io as IO
from netweave.streaming import jobs as J

BASE = dt.datetime(2024, 1, 1)
END = [(10**12 + j, dt.datetime(2099, 1 + j, 1), "0.0.0.1", "0.0.0.2", 6, 1, 2, 40) for j in range(3)]


def packet(i, ms, src="10.0.0.1"):
    return (i, BASE + dt.timedelta(milliseconds=ms), src, "8.8.8.8", 6, 1, 2, 60 + i % 7)


def stored(spark, parts):
    """One file a part, in this order."""
    path = scratch_path(spark, "packets")
    for part in parts:
        spark.createDataFrame(part, IO.PACKET_SCHEMA).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    return path


def run(df, name, path, mode="append"):
    q = (df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True)
         .option("checkpointLocation", f"{path}-{name}").start())
    q.awaitTermination()
    return q


@pytest.fixture(scope="module")
def shuffled(spark):
    """Two flows of dense packets (many in one slice), shuffled within ten seconds,
    dealt over three files."""
    rng = random.Random(1)
    rows = [packet(i, i * 13, f"10.0.0.{i % 2}") for i in range(900)]
    rows.sort(key=lambda r: (r[1] - BASE).total_seconds() + rng.uniform(0, 10))
    return rows, stored(spark, [rows[:300], rows[300:600], rows[600:], *[[e] for e in END]])


def test_shuffled_slices_equal_the_batch_twin(spark, shuffled):
    rows, path = shuffled
    src = IO.read_packets(spark, path, streaming=True, max_files_per_trigger=1)
    q = run(J.running_features_stream(src, watermark="20 seconds", slice_ms=500), "k_run", path)
    got = spark.table("k_run").where("packet_id < 1000000")
    want = PK.running_features(spark.createDataFrame(rows, IO.PACKET_SCHEMA))
    assert got.count() == len(rows)
    order = ["packet_id", "total_fwd_packets", "total_length_fwd_packets", "ts", "src_ip"]
    assert got.select(*order).exceptAll(want.select(*order)).count() == 0
    a, b = ({r.packet_id: r for r in df.collect()} for df in (got, want))
    for i, r in b.items():
        for c in ("flow_duration", "fwd_packet_length_mean", "flow_bytes_per_s", "flow_packets_per_s", "fwd_iat_total"):
            assert a[i][c] == pytest.approx(r[c], rel=1e-12), (i, c)
    # every waiting slice is an entry of its own, and in the end only the sentinel's state is left
    ops = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    assert max(o["numRowsTotal"] for o in ops) >= 20
    assert ops[-1]["numRowsTotal"] < 10


def test_idle_flows_leave_the_state_and_start_anew(spark):
    hour = 3_600_000
    parts = [[packet(0, 0), packet(1, 1000)], [packet(2, 2 * hour), packet(3, 2 * hour + 1)], *[[e] for e in END]]
    path = stored(spark, parts)
    src = IO.read_packets(spark, path, streaming=True, max_files_per_trigger=1)
    run(J.running_features_stream(src, watermark="10 seconds", idle_timeout_seconds=3600), "k_idle", path)
    got = {r.packet_id: r.total_fwd_packets for r in spark.table("k_idle").where("packet_id < 100").collect()}
    assert got == {0: 1, 1: 2, 2: 1, 3: 2}
    # the same gap within one slice of state: both sides arrive before any timer
    path = stored(spark, [[*parts[1], *parts[0]], *parts[2:]])
    src = IO.read_packets(spark, path, streaming=True, max_files_per_trigger=1)
    run(J.running_features_stream(src, watermark="10 hours", idle_timeout_seconds=3600, slice_ms=24 * hour), "k_idle2", path)
    assert {r.packet_id: r.total_fwd_packets for r in spark.table("k_idle2").where("packet_id < 100").collect()} == got


def test_model_scores_every_packet(spark, sf, shuffled):
    from netweave.operators import ml as ML
    rows, path = shuffled
    frame = ML.labelled_training_frame(IO.clean_flow_features(X.labelled_flows_from(X.flows(spark, sf))))
    frame = frame.withColumn("label", (F.col("total_fwd_packets") < 20).cast("double"))
    model = ML.train_attack_model(frame, num_trees=5, max_depth=4)
    src = IO.read_packets(spark, path, streaming=True, max_files_per_trigger=2)
    features = J.running_features_stream(src, watermark="20 seconds")
    want = J.score_packets(PK.running_features(spark.createDataFrame(rows, IO.PACKET_SCHEMA)), model)
    assert 0 < want.count() < len(rows)
    out = scratch_path(spark, "verdicts")
    for checkpoint in ("c1", "c2"):  # the second replays everything: nothing is added
        J.packet_scoring_sink(features, model, out, f"{path}-{checkpoint}").awaitTermination()
        got = spark.read.parquet(out).where("dst_ip = '8.8.8.8'")
        assert got.count() == want.count()
        cols = ["id", "timestamp", "src_ip", "prediction", "direction"]
        assert got.select(*cols).exceptAll(want.select(*cols)).count() == 0


def test_structured_alerts_as_one_streaming_query(spark, sf):
    flows, geoip = X.flows(spark, sf).limit(1500).persist(), X.geoip(spark, sf)
    ca = P.as_of(flows)
    rules = P.generated_rules(flows, ca)
    want = A.to_alerts(D.detect_suspicious(E.enrich_flows(flows, geoip), rules, use_policy=True), ca)
    path, out = scratch_path(spark, "flows"), scratch_path(spark, "alerts")
    cuts = [r[0] for r in flows.agg(F.explode(F.percentile_approx(F.unix_micros(F.col("last_seen").cast("timestamp")), [0.0, 0.33, 0.66, 1.0]))).collect()]
    us = F.unix_micros(F.col("last_seen").cast("timestamp"))
    sliced = [flows.where(us.between(a, b)) for a, b in zip(cuts, cuts[1:])]  # borders come twice
    end = flows.limit(1).withColumns({"last_seen": F.lit("2099-01-01").cast("timestamp_ntz"), "src_ip": F.lit("0.0.0.1"),
                                      "flow_id": F.lit("end").cast(flows.schema["flow_id"].dataType)})
    for part in (sliced[0], sliced[0], sliced[1], sliced[1].limit(50), sliced[2], end, end):
        part.coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)
    src = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    query = J.alerts_table_stream(J.structured_alerts_stream(src, geoip, rules, ca, watermark="3650 days"), out, f"{path}-c")
    query.awaitTermination()
    got = spark.read.parquet(out).where("src_ip <> '0.0.0.1'").select(*A.ALERT_COLUMNS)
    assert got.count() == want.count() > 100
    assert got.exceptAll(want).count() == 0
    before = spark.read.parquet(out).count()

    # a restart goes on from the checkpoint: input seen before adds nothing
    src = spark.readStream.schema(flows.schema).option("maxFilesPerTrigger", 1).parquet(path)
    J.alerts_table_stream(J.structured_alerts_stream(src, geoip, rules, ca, watermark="3650 days"), out, f"{path}-c").awaitTermination()
    assert spark.read.parquet(out).count() == before
    flows.unpersist()


def test_alert_ids_leave_the_state(spark, sf):
    flows = X.flows(spark, sf).where("proto_num = 23 OR port = 23 OR packets > 0").limit(200)
    at = F.timestamp_add("MINUTE", F.row_number().over(Window.orderBy("flow_id")) * 30, F.lit(str(BASE)).cast("timestamp_ntz"))
    timed = flows.withColumn("last_seen", at).persist()
    path = scratch_path(spark, "flows")
    for lo in range(0, 5000, 1250):
        a, b = BASE + dt.timedelta(minutes=lo), BASE + dt.timedelta(minutes=lo + 1250)
        timed.where(F.col("last_seen").between(F.lit(str(a)).cast("timestamp_ntz"), F.lit(str(b)).cast("timestamp_ntz"))).coalesce(1) \
            .write.mode("append").parquet(path)
        time.sleep(1.1)
    src = spark.readStream.schema(timed.schema).option("maxFilesPerTrigger", 1).parquet(path)
    q = run(J.structured_alerts_stream(src, None, None, watermark="2 hours"), "k_alerts", path)
    ops = [p["stateOperators"][0] for p in q.recentProgress if p["stateOperators"]]
    total = spark.table("k_alerts").count()
    assert total == spark.table("k_alerts").select("alert_id").distinct().count()
    assert total > 40 and ops[-1]["numRowsTotal"] < total / 2
    timed.unpersist()
