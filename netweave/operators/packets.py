"""Packet-level operators: packets -> flows, flow statistics, per-packet
running features, packet rates and sessions (batch twins of the streams)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.functions import net
from netweave.functions.prefix import DEFAULT_BUCKET_SECONDS, bucketed_scan
from netweave.functions.timeparts import add_seconds, seconds_between

FLOW_KEY = ["src_ip", "dst_ip", "proto_num"]
PACKET_COLUMNS = ["packet_id", "ts", "src_ip", "dst_ip", "proto_num", "src_port", "dst_port", "length"]


def flow_id_of(*cols) -> Column:
    return F.concat_ws("|", *[F.col(c).cast("string") for c in cols])


def flows_from_packets(packets: DataFrame) -> DataFrame:
    """One flow per (src_ip, dst_ip, proto): packet count, byte sum, first
    and last packet time, and the ports of the last packet seen.

    Pure partial/final hash aggregation: a hot flow costs one partial row
    per task before the shuffle.
    """
    last = F.max_by(F.struct("src_port", "dst_port"), F.struct("ts", "packet_id"))
    g = (packets.groupBy(*FLOW_KEY)
         .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").cast("long").alias("bytes"),
              F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), last.alias("__last")))
    return g.select(
        flow_id_of(*FLOW_KEY).alias("flow_id"), *FLOW_KEY,
        F.col("__last.src_port").alias("src_port"), F.col("__last.dst_port").alias("dst_port"),
        net.primary_port("__last.dst_port", "__last.src_port").alias("port"),
        "packets", "bytes", "first_seen", "last_seen")


def _rate(num: Column, dur: Column) -> Column:
    return F.when(dur > 0, num.cast("double") / dur).otherwise(F.lit(0.0))


MODEL_COLUMNS = ["flow_duration", "total_fwd_packets", "total_backward_packets",
                 "total_length_fwd_packets", "total_length_bwd_packets", "fwd_packet_length_mean",
                 "bwd_packet_length_mean", "flow_bytes_per_s", "flow_packets_per_s",
                 "fwd_iat_total", "bwd_iat_total"]


def flow_statistics(packets: DataFrame, bidirectional: bool = False) -> DataFrame:
    """The 11 model features per flow, from packets.

    ``bidirectional=False`` keys flows by the packet's own (src, dst, proto)
    so every packet is forward. ``True`` keys by the unordered endpoint pair;
    forward is the direction of the flow's first packet. Inter-arrival
    totals are per direction (gap to the previous packet of the same
    direction), which telescope to last - first, so one hash aggregation
    computes everything (no window, no join, skew-safe).
    """
    if bidirectional:
        lo, hi = F.least("src_ip", "dst_ip"), F.greatest("src_ip", "dst_ip")
        df = packets.withColumns({"__a": F.col("src_ip") == lo, "__lo": lo, "__hi": hi})
        keys = ["__lo", "__hi", "proto_num"]
    else:
        df = packets.withColumns({"__a": F.lit(True), "__lo": F.col("src_ip"), "__hi": F.col("dst_ip")})
        keys = ["__lo", "__hi", "proto_num"]
    a, b = F.col("__a"), ~F.col("__a")
    g = df.groupBy(*keys).agg(
        F.min_by("__a", F.struct("ts", "packet_id")).alias("first_a"),
        F.count_if(a).alias("n_a"), F.count_if(b).alias("n_b"),
        F.coalesce(F.sum(F.when(a, F.col("length"))), F.lit(0)).cast("long").alias("by_a"),
        F.coalesce(F.sum(F.when(b, F.col("length"))), F.lit(0)).cast("long").alias("by_b"),
        F.min(F.when(a, F.col("ts"))).alias("t0_a"), F.max(F.when(a, F.col("ts"))).alias("t1_a"),
        F.min(F.when(b, F.col("ts"))).alias("t0_b"), F.max(F.when(b, F.col("ts"))).alias("t1_b"),
        F.min("ts").alias("t0"), F.max("ts").alias("t1"))
    fa = F.col("first_a")
    pick = lambda x, y: F.when(fa, F.col(x)).otherwise(F.col(y))
    n_f, n_b = pick("n_a", "n_b"), pick("n_b", "n_a")
    by_f, by_b = pick("by_a", "by_b"), pick("by_b", "by_a")
    iat_f = F.coalesce(seconds_between(pick("t0_a", "t0_b"), pick("t1_a", "t1_b")), F.lit(0.0))
    iat_b = F.coalesce(seconds_between(pick("t0_b", "t0_a"), pick("t1_b", "t1_a")), F.lit(0.0))
    dur = seconds_between("t0", "t1")
    src = F.when(fa, F.col("__lo")).otherwise(F.col("__hi"))
    dst = F.when(fa, F.col("__hi")).otherwise(F.col("__lo"))
    return g.select(
        src.alias("src_ip"), dst.alias("dst_ip"), "proto_num",
        dur.alias("flow_duration"),
        n_f.alias("total_fwd_packets"), n_b.alias("total_backward_packets"),
        by_f.alias("total_length_fwd_packets"), by_b.alias("total_length_bwd_packets"),
        _rate(by_f, n_f.cast("double")).alias("fwd_packet_length_mean"),
        _rate(by_b, n_b.cast("double")).alias("bwd_packet_length_mean"),
        _rate(by_f + by_b, dur).alias("flow_bytes_per_s"),
        _rate(n_f + n_b, dur).alias("flow_packets_per_s"),
        iat_f.alias("fwd_iat_total"), iat_b.alias("bwd_iat_total"),
        F.col("t0").alias("first_seen"), F.col("t1").alias("last_seen"))


def running_features(packets: DataFrame, bucket_seconds: int = DEFAULT_BUCKET_SECONDS) -> DataFrame:
    """The feature vector as it stands after every packet of its flow.

    Per packet (flow = own src, dst, proto; order ts, packet_id): packets
    and bytes so far, their mean, duration since the first packet, rates
    over that duration (0 while it is 0) and the forward inter-arrival total
    (= duration). Running sums use ``bucketed_scan`` so a hot flow is split
    over time buckets instead of landing in one task.
    """
    s = bucketed_scan(packets, FLOW_KEY, "ts", "packet_id",
                      sums={"n": F.lit(1).cast("long"), "bytes": F.col("length").cast("long")},
                      want_first_ts=True, bucket_seconds=bucket_seconds)
    dur = seconds_between("first_ts", "ts")
    n, by = F.col("run_n"), F.col("run_bytes")
    return s.select(
        "packet_id", "ts", *FLOW_KEY,
        dur.alias("flow_duration"), n.alias("total_fwd_packets"),
        F.lit(0).cast("long").alias("total_backward_packets"),
        by.alias("total_length_fwd_packets"), F.lit(0).cast("long").alias("total_length_bwd_packets"),
        (by.cast("double") / n).alias("fwd_packet_length_mean"), F.lit(0.0).alias("bwd_packet_length_mean"),
        _rate(by, dur).alias("flow_bytes_per_s"), _rate(n, dur).alias("flow_packets_per_s"),
        F.when(n > 1, dur).otherwise(F.lit(0.0)).alias("fwd_iat_total"), F.lit(0.0).alias("bwd_iat_total"))


def packet_rate(packets: DataFrame, window_seconds: int = 10, slide_seconds: int | None = 1) -> DataFrame:
    """Packets per second over ``window_seconds`` windows.

    Sliding (``slide_seconds`` set, must divide the window): counts per
    slide-sized bucket first (partial aggregation), then each bucket count is
    added to the ``window/slide`` windows covering it, so rows are never
    replicated ten-fold. Tumbling when ``slide_seconds`` is None.
    """
    if slide_seconds is None:
        w = packets.groupBy(F.window("ts", f"{window_seconds} seconds").alias("w")).agg(
            F.count(F.lit(1)).alias("packets"))
        return w.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"),
                        "packets", (F.col("packets") / F.lit(float(window_seconds))).alias("packets_per_second"))
    if window_seconds % slide_seconds:
        raise ValueError("slide must divide the window")
    per = packets.groupBy(F.window("ts", f"{slide_seconds} seconds").start.alias("b")).agg(
        F.count(F.lit(1)).alias("c"))
    k = window_seconds // slide_seconds
    spread = per.select(F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("i"), "b", "c") \
        .select(add_seconds(F.col("b"), -F.col("i") * slide_seconds).alias("window_start"), "c")
    g = spread.groupBy("window_start").agg(F.sum("c").cast("long").alias("packets"))
    return g.select("window_start", add_seconds(F.col("window_start"), window_seconds).alias("window_end"),
                    "packets", (F.col("packets") / F.lit(float(window_seconds))).alias("packets_per_second"))


def flow_sessions(packets: DataFrame, gap_seconds: int, bucket_seconds: int | None = None) -> DataFrame:
    """Gaps-and-islands sessions per flow key: a packet opens a new session
    when the previous packet of its flow is ``gap_seconds`` or more before it.

    The previous timestamp and the running session number come from
    ``bucketed_scan`` (hot flows split over time buckets); sessions are then
    a hash aggregation on (flow key, session number).
    """
    bs = bucket_seconds or max(DEFAULT_BUCKET_SECONDS, gap_seconds)
    prev = bucketed_scan(packets, FLOW_KEY, "ts", "packet_id", want_prev_ts=True, bucket_seconds=bs)
    starts = prev.withColumn("__start", F.when(
        F.col("prev_ts").isNull() | (seconds_between("prev_ts", "ts") >= gap_seconds), 1).otherwise(0).cast("long"))
    numbered = bucketed_scan(starts.drop("prev_ts"), FLOW_KEY, "ts", "packet_id",
                             sums={"session": F.col("__start")}, bucket_seconds=bs)
    return (numbered.groupBy(*FLOW_KEY, F.col("run_session").alias("session_no"))
            .agg(F.min("ts").alias("session_start"), F.max("ts").alias("session_last"),
                 F.count(F.lit(1)).alias("packets"), F.sum("length").cast("long").alias("bytes")))


def live_flows_recent(flows: DataFrame, as_of, window_seconds: float) -> DataFrame:
    """Flows whose ``last_seen`` is within ``window_seconds`` before ``as_of``."""
    from netweave.functions.timeparts import ntz_literal
    lo = add_seconds(ntz_literal(as_of), F.lit(-float(window_seconds)).cast("long")) \
        if float(window_seconds).is_integer() else None
    cond = (seconds_between("last_seen", ntz_literal(as_of)) <= window_seconds) if lo is None \
        else (F.col("last_seen") >= lo)
    return flows.where(cond & (F.col("last_seen") <= ntz_literal(as_of)))
