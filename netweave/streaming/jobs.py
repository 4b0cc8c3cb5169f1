"""Structured Streaming jobs (event time, watermarks, bounded state).

Each job has a batch twin in ``operators.packets`` / ``operators.detect``;
the tests run the streams with ``trigger(availableNow=True)`` and compare.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from netweave.operators import alerts as A
from netweave.operators import detect as D
from netweave.operators import enrich as E
from netweave.functions.timeparts import date_of, instant_to_ntz, ntz_to_instant
from netweave.operators.packets import FLOW_KEY
from netweave.streaming.running import RUNNING_SCHEMA, RunningFeatures, micros, use_rocksdb


def event_time(packets: DataFrame, col: str = "ts") -> DataFrame:
    """Event-time column as a ``timestamp`` instant (watermarks require it)."""
    if packets.schema[col].dataType.simpleString() == "timestamp_ntz":
        return packets.withColumn(col, ntz_to_instant(col))
    return packets


def _user_set(spark, key: str) -> bool:
    """True when the key was set explicitly in the Spark configuration."""
    return spark.sparkContext.getConf().contains(key)


def packet_rate_stream(packets: DataFrame, window_seconds: int = 10, slide_seconds: int = 1,
                       watermark: str = "30 seconds") -> DataFrame:
    """Packets per second over sliding event-time windows (append mode:
    a window is emitted once the watermark passes its end). Packets are counted
    per slide first; only those counts go to the windows that cover them, so
    packets are not copied per window."""
    if window_seconds % slide_seconds:
        raise ValueError("slide must divide the window")
    per = (event_time(packets).withWatermark("ts", watermark)
           .groupBy(F.window("ts", f"{slide_seconds} seconds").alias("s")).agg(F.count(F.lit(1)).alias("c")))
    w = F.window(F.window_time("s"), f"{window_seconds} seconds", f"{slide_seconds} seconds")
    return (per.groupBy(w.alias("w")).agg(F.sum("c").cast("long").alias("packets"))
            .select(instant_to_ntz("w.start").alias("window_start"), instant_to_ntz("w.end").alias("window_end"),
                    "packets",
                    (F.col("packets") / F.lit(float(window_seconds))).alias("packets_per_second")))


LIVE_SCHEMA = ("src_ip string, dst_ip string, proto_num int, packets long, bytes long, "
               "first_seen timestamp, last_seen timestamp")
_LIVE_STATE = "packets long, bytes long, first_us long, last_us long"


def _live_updater(idle_ms: int):
    def update(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        packets, nbytes, first, last = state.get if state.exists else (0, 0, None, None)
        for pdf in pdfs:
            us = micros(pdf)
            packets, nbytes = packets + len(pdf), nbytes + int(pdf["length"].sum())
            first = int(us.min()) if first is None else min(first, int(us.min()))
            last = int(us.max()) if last is None else max(last, int(us.max()))
        state.update((packets, nbytes, first, last))
        state.setTimeoutTimestamp(max(last // 1000 + idle_ms, state.getCurrentWatermarkMs() + 1))
        times = pd.to_datetime(pd.Series([first, last]), unit="us", utc=True)
        yield pd.DataFrame({"src_ip": [key[0]], "dst_ip": [key[1]], "proto_num": [key[2]], "packets": [packets],
                            "bytes": [nbytes], "first_seen": [times[0]], "last_seen": [times[1]]})
    return update


def live_flows_stream(packets: DataFrame, idle_seconds: int = 60, watermark: str = "30 seconds") -> DataFrame:
    """Live totals of open flows (update mode): after every micro-batch the
    running packets, bytes, first and last time of each flow that got packets.
    A flow idle longer than ``idle_seconds`` of event time leaves the state;
    a later packet starts it anew."""
    out = (event_time(packets).withWatermark("ts", watermark).groupBy(*FLOW_KEY)
           .applyInPandasWithState(_live_updater(idle_seconds * 1000), LIVE_SCHEMA, _LIVE_STATE, "update",
                                   GroupStateTimeout.EventTimeTimeout))
    return out.withColumns({c: instant_to_ntz(c) for c in ("first_seen", "last_seen")})


def flow_sessions_stream(packets: DataFrame, gap_seconds: int, watermark: str | None = None) -> DataFrame:
    """Live flows as event-time sessions per (src, dst, proto): a flow stays
    open while packets arrive less than ``gap_seconds`` apart; closed sessions
    are emitted in append mode and their state is dropped. Rows later than
    the watermark are discarded."""
    wm = watermark or f"{gap_seconds} seconds"
    spark = packets.sparkSession
    merge_conf = "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition"
    if spark.conf.get(merge_conf, None) in (None, "false") and not _user_set(spark, merge_conf):
        spark.conf.set(merge_conf, "true")  # pre-merge per partition before the shuffle
    s = F.session_window("ts", f"{gap_seconds} seconds")
    return (event_time(packets).withWatermark("ts", wm).groupBy(*FLOW_KEY, s.alias("s"))
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").cast("long").alias("bytes"),
                 F.min("ts").alias("session_start"), F.max("ts").alias("session_last"))
            .select(*FLOW_KEY, instant_to_ntz("session_start").alias("session_start"),
                    instant_to_ntz("session_last").alias("session_last"), "packets", "bytes",
                    instant_to_ntz("s.end").alias("session_end")))


def running_features_stream(packets: DataFrame, watermark: str = "1 hour",
                            idle_timeout_seconds: int = 86_400, slice_ms: int = 1000) -> DataFrame:
    """Per-packet running flow features (all 11) in event-time order.

    Packets may arrive in any order within the watermark: a packet's row is
    emitted once the watermark has passed its time slice of ``slice_ms``; later ones are
    dropped. Waiting packets are kept by flow and slice, one small state entry each, and
    a flow's totals leave the state once event time passes its last packet by
    ``idle_timeout_seconds``; a packet after such a gap starts a new flow. The batch twin
    (``operators.packets.running_features``) equals this stream when no flow has such a
    gap. Sets the session's state store provider to RocksDB.
    """
    use_rocksdb(packets)
    out = (event_time(packets).withWatermark("ts", watermark).groupBy(*FLOW_KEY)
           .transformWithStateInPandas(RunningFeatures(idle_timeout_seconds * 1000, slice_ms), RUNNING_SCHEMA, "append", "EventTime"))
    return out.withColumn("ts", instant_to_ntz("ts"))


# --- micro-batch jobs reusing the batch operators ---------------------------------------

def alerts_sink(flows_stream: DataFrame, geoip: DataFrame | None, rules: DataFrame | None,
                alerts_path: str, checkpoint: str, created_at=None, trigger: dict | None = None):
    """Continuous detection: each micro-batch of flows is enriched, checked
    against static reasons, the policy and the (static, broadcast) rule
    table, scored, and appended to the alert store unless its ``alert_id``
    is already stored (retries of a batch are therefore idempotent)."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            newest = batch.agg(F.max("last_seen")).first()[0]
            if newest is not None:
                susp = D.detect_suspicious(E.enrich_flows(batch, geoip), rules, use_policy=True)
                A.append_structured_alerts(A.to_alerts(susp, created_at or newest), alerts_path)
        finally:
            batch.unpersist()

    w = flows_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(**(trigger or {"availableNow": True}))
    return w.start()


def structured_alerts_stream(flows_stream: DataFrame, geoip: DataFrame | None, rules: DataFrame | None,
                             created_at=None, watermark: str = "1 hour", date_grain: str = "day") -> DataFrame:
    """Continuous detection within the query itself: flows are enriched and judged by
    stream-static joins (GeoIP segments, policy, rules), scored, and every
    ``alert_id`` passes once.

    Ids are kept for the ``watermark`` of event time and then leave the state; flows later
    than it are dropped. With a checkpoint, a restarted query continues where it was, so
    a file sink (which commits whole micro-batches) holds every alert once. Adds ``date``
    for partitioned sinks. ``created_at`` defaults to the micro-batch's time.
    """
    susp = D.detect_suspicious(E.enrich_flows(flows_stream, geoip), rules, use_policy=True)
    alerts = A.to_alerts(susp, instant_to_ntz(F.current_timestamp()) if created_at is None else created_at)
    return (alerts.withColumn("__event", ntz_to_instant("timestamp")).withWatermark("__event", watermark)
            .dropDuplicatesWithinWatermark(["alert_id"]).drop("__event").withColumn("date", date_of("timestamp", date_grain)))


def alerts_table_stream(alerts: DataFrame, path: str, checkpoint: str, trigger: dict | None = None):
    """Write ``structured_alerts_stream`` as a date-partitioned Parquet table with a
    commit log, which readers of ``path`` follow."""
    w = alerts.writeStream.format("parquet").partitionBy("date").option("path", path).option("checkpointLocation", checkpoint)
    return w.outputMode("append").trigger(**(trigger or {"availableNow": True})).start()


def _score(feats: DataFrame, model, geoip: DataFrame | None, ident: list[str], when: str) -> DataFrame:
    """Attack alerts of rows with model features; ids are hashes of ``ident``."""
    from netweave.operators.ml import predict_attacks
    attacks = predict_attacks(model, feats).where(F.col("prediction_label") == "Attack")
    return E.enrich_flows(attacks, geoip).select(
        F.xxhash64(*ident).cast("string").alias("id"), F.col(when).alias("timestamp"),
        "src_ip", "dst_ip", F.col("prediction_label").alias("prediction"),
        F.col("confidence_predicted").alias("confidence"), "direction", "protocol_name",
        "is_internal_src", "is_internal_dst", "country")


#: Model features from the columns of ``running_features_stream``.
_RUNNING_FEATURES = {
    "flow_duration": "flow_duration", "total_fwd_packets": "total_fwd_packets",
    "total_backward_packets": "total_backward_packets", "total_length_of_fwd_packets": "total_length_fwd_packets",
    "total_length_of_bwd_packets": "total_length_bwd_packets", "fwd_packet_length_mean": "fwd_packet_length_mean",
    "bwd_packet_length_mean": "bwd_packet_length_mean", "flow_bytes_s": "flow_bytes_per_s",
    "flow_packets_s": "flow_packets_per_s", "fwd_iat_total": "fwd_iat_total", "bwd_iat_total": "bwd_iat_total"}


def score_packets(running: DataFrame, model, geoip: DataFrame | None = None) -> DataFrame:
    """The model's verdict at every packet: attack alerts of ``running`` features (batch
    or stream), one a packet that the model calls an attack."""
    feats = running.select("packet_id", "ts", *FLOW_KEY, *[F.col(c).cast("double").alias(f) for f, c in _RUNNING_FEATURES.items()])
    return _score(feats, model, geoip, [*FLOW_KEY, "packet_id", "ts"], "ts")


def packet_scoring_sink(running_stream: DataFrame, model, alerts_path: str, checkpoint: str,
                        geoip: DataFrame | None = None, trigger: dict | None = None):
    """``running_features_stream`` -> the model at every packet -> attack alerts appended
    unless already stored, so a retried batch adds nothing."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        A.append_unstored(score_packets(batch, model, geoip), alerts_path, "id")

    w = running_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()


def attack_scoring_sink(sessions_stream: DataFrame, model, alerts_path: str, checkpoint: str,
                        geoip: DataFrame | None = None, trigger: dict | None = None):
    """Continuous attack scoring: closed flow sessions -> model features
    (forward-only counts) -> pipeline model -> attack alerts (the columns and
    date folders of the batch table) appended unless already stored; ids are
    hashes of flow and session start, so a retried batch adds nothing."""
    def run(batch: DataFrame, epoch_id: int) -> None:
        dur = F.timestamp_diff("MICROSECOND", "session_start", "session_last").cast("double") / 1e6
        feats = batch.select(
            *FLOW_KEY, "session_start", "session_last", dur.alias("flow_duration"),
            F.col("packets").cast("double").alias("total_fwd_packets"), F.lit(0.0).alias("total_backward_packets"),
            F.col("bytes").cast("double").alias("total_length_of_fwd_packets"),
            F.lit(0.0).alias("total_length_of_bwd_packets"),
            (F.col("bytes") / F.col("packets")).alias("fwd_packet_length_mean"), F.lit(0.0).alias("bwd_packet_length_mean"),
            F.when(dur > 0, F.col("bytes") / dur).otherwise(0.0).alias("flow_bytes_s"),
            F.when(dur > 0, F.col("packets") / dur).otherwise(0.0).alias("flow_packets_s"),
            dur.alias("fwd_iat_total"), F.lit(0.0).alias("bwd_iat_total"))
        A.append_unstored(_score(feats, model, geoip, [*FLOW_KEY, "session_start"], "session_last"), alerts_path, "id")

    w = sessions_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return w.trigger(**(trigger or {"availableNow": True})).start()
