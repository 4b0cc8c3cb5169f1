"""Traffic reports over (enriched) flows: summary, protocol counts, per-source
statistics, top talkers and the hour x protocol heatmap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions.timeparts import hour_of


def summary_stats(flows: DataFrame, suspicious: DataFrame | None = None) -> DataFrame:
    """One row: flow count, distinct sources/destinations, byte and packet
    totals and a count per direction (+ suspicious flows when given)."""
    aggs = [
        F.count(F.lit(1)).alias("total_flows"),
        F.count_distinct("src_ip").alias("unique_src_ips"),
        F.count_distinct("dst_ip").alias("unique_dst_ips"),
        F.coalesce(F.sum("bytes"), F.lit(0)).cast("long").alias("total_bytes"),
        F.coalesce(F.sum("packets"), F.lit(0)).cast("long").alias("total_packets"),
        F.count_if(F.col("direction") == K.DIR_IN_TO_EX).alias("internal_to_external_flows"),
        F.count_if(F.col("direction") == K.DIR_EX_TO_IN).alias("external_to_internal_flows"),
        F.count_if(F.col("direction") == K.DIR_IN_TO_IN).alias("internal_to_internal_flows"),
        F.count_if(F.col("direction") == K.DIR_EX_TO_EX).alias("external_to_external_flows"),
    ]
    out = flows.agg(*aggs)
    if suspicious is not None:
        out = out.withColumn("suspicious_flows_count",
                             suspicious.select(F.count(F.lit(1))).scalar())
    return out


def protocol_counts(flows: DataFrame) -> DataFrame:
    return flows.groupBy("protocol_name").agg(F.count(F.lit(1)).alias("flow_count"))


def source_ip_stats(flows: DataFrame) -> DataFrame:
    """Per source: total bytes, total packets, distinct destinations.

    Sums are partially aggregated map-side, so a source holding a third of
    all flows costs one partial row per task before the shuffle.
    """
    return (flows.where(F.col("src_ip").isNotNull())
            .groupBy("src_ip")
            .agg(F.sum("bytes").cast("long").alias("total_bytes"),
                 F.sum("packets").cast("long").alias("total_packets"),
                 F.count_distinct("dst_ip").alias("distinct_destinations")))


_TOP_METRICS = {"bytes": "total_bytes", "packets": "total_packets", "destinations": "distinct_destinations"}


def top_source_ips(flows: DataFrame, by: str = "bytes", n: int = 10,
                   stats: DataFrame | None = None) -> DataFrame:
    """Top ``n`` sources by one metric; ties keep source order (ascending).

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: each task keeps
    its own top n, only n rows per task reach the final merge. Pass
    ``stats`` (a materialised ``source_ip_stats``) to rank several metrics
    without re-aggregating the flows.
    """
    metric = _TOP_METRICS[by]
    st = stats if stats is not None else source_ip_stats(flows)
    return st.orderBy(F.col(metric).desc(), F.col("src_ip").asc()).limit(n)


def protocol_heatmap(flows: DataFrame, ts_col: str = "last_seen") -> DataFrame:
    """Long form: bytes and packets per (hour of day, protocol name).

    Rows with a NULL in hour, protocol name, bytes or packets are dropped.
    """
    df = flows.select(hour_of(ts_col).alias("hour"), "protocol_name", "bytes", "packets")
    return (df.dropna(subset=["hour", "protocol_name", "bytes", "packets"])
            .groupBy("hour", "protocol_name")
            .agg(F.sum("bytes").cast("long").alias("bytes"), F.sum("packets").cast("long").alias("packets")))


def heatmap_pivot(heatmap: DataFrame, value: str = "bytes", protocols: list[str] | None = None) -> DataFrame:
    """Wide form: one row per hour, one column per protocol name, empty cells 0.

    The pivot runs over the already aggregated long form (≤ 24 x #protocols
    rows). Protocol names are read from that small table when not given.
    """
    if protocols is None:
        protocols = sorted(r[0] for r in heatmap.select("protocol_name").distinct().collect())
    wide = heatmap.groupBy("hour").pivot("protocol_name", protocols).agg(F.sum(value))
    return wide.na.fill(0, subset=protocols)
