"""Composite reports (the reference's analysis and rule-application endpoints)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions.timeparts import hour_of
from netweave.operators import detect as D
from netweave.operators import reports as RP
from netweave.operators import rules as R
from netweave.session import materialize


def _long(df: DataFrame, section: str, key_col: str | None, value_col: str) -> DataFrame:
    key = F.col(key_col).cast("string") if key_col else F.lit("")
    return df.select(F.lit(section).alias("section"), key.alias("key"), F.col(value_col).cast("double").alias("value"))


def report_cube(flows: DataFrame) -> DataFrame:
    """Flows (with ``suspicious``) summed per source, destination, hour, protocol
    and direction: all that the report's parts need. ``cell_*`` sum the rows that
    have both bytes and packets, as the heatmap does."""
    whole = F.col("bytes").isNotNull() & F.col("packets").isNotNull()
    return flows.groupBy("src_ip", "dst_ip", hour_of("last_seen").alias("hour"), "protocol_name", "direction").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("suspicious").alias("suspicious"),
        F.sum("bytes").alias("bytes"), F.sum("packets").alias("packets"),
        F.sum(F.when(whole, F.col("bytes"))).alias("cell_bytes"), F.sum(F.when(whole, F.col("packets"))).alias("cell_packets"))


def analysis_report(enriched: DataFrame, rules: DataFrame | None, top_n: int = 10) -> DataFrame:
    """Long form (section, key, value): summary statistics, protocols
    detected, top sources by bytes / packets / destinations, the heatmap
    cells and the suspicious-flow count. The flows are read once, into a
    materialised partial aggregate that every part is derived from; nothing
    but the final rows reaches the driver."""
    cube = materialize(report_cube(D.flag_suspicious(enriched, rules)))
    directions = {"internal_to_external_flows": K.DIR_IN_TO_EX, "external_to_internal_flows": K.DIR_EX_TO_IN,
                  "internal_to_internal_flows": K.DIR_IN_TO_IN, "external_to_external_flows": K.DIR_EX_TO_EX}
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    summary = cube.agg(
        total("n").alias("total_flows"), F.count_distinct("src_ip").alias("unique_src_ips"),
        F.count_distinct("dst_ip").alias("unique_dst_ips"), total("bytes").alias("total_bytes"),
        total("packets").alias("total_packets"),
        *[total(F.when(F.col("direction") == d, F.col("n"))).alias(name) for name, d in directions.items()],
        total("suspicious").alias("suspicious_flows_count"))
    parts = [summary.select(F.explode(F.array(*[
        F.struct(F.lit("summary").alias("section"), F.lit(c).alias("key"), F.col(c).cast("double").alias("value"))
        for c in summary.columns])).alias("r")).select("r.*")]
    parts.append(_long(cube.groupBy("protocol_name").agg(F.sum("n").alias("n")), "protocols_detected", "protocol_name", "n"))
    sources = cube.where(F.col("src_ip").isNotNull()).groupBy("src_ip").agg(
        F.sum("bytes").alias("total_bytes"), F.sum("packets").alias("total_packets"),
        F.count_distinct("dst_ip").alias("distinct_destinations"))
    for by, metric in [("bytes", "total_bytes"), ("packets", "total_packets"), ("destinations", "distinct_destinations")]:
        parts.append(_long(RP.top_source_ips(enriched, by, top_n, stats=sources), f"top_by_{by}", "src_ip", metric))
    heat = cube.dropna(subset=["hour", "protocol_name", "cell_bytes", "cell_packets"]).groupBy("hour", "protocol_name").agg(
        F.sum("cell_bytes").alias("bytes"), F.sum("cell_packets").alias("packets"))
    for v in ("bytes", "packets"):
        parts.append(heat.select(F.lit(f"heatmap_{v}").alias("section"),
                                 F.concat_ws("|", F.col("hour").cast("string"), "protocol_name").alias("key"),
                                 F.col(v).cast("double").alias("value")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_application_summary(recent_flows: DataFrame, rules: DataFrame) -> DataFrame:
    """Flows checked, flows with at least one triggered rule, triggers."""
    trig = R.apply_rules(recent_flows, rules)
    per_flow = trig.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n"))
    checked = recent_flows.agg(F.count(F.lit(1)).alias("total_flows_checked"))
    return checked.select(
        "total_flows_checked",
        per_flow.select(F.count(F.lit(1))).scalar().alias("flows_with_triggers"),
        per_flow.select(F.coalesce(F.sum("n"), F.lit(0)).cast("long")).scalar().alias("total_triggers"))
