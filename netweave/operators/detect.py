"""Suspicious-flow detection: static rules, the (protocol, port) policy,
generated rules, and evidence extraction from packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.operators import rules as R
from netweave.session import materialize

EVIDENCE_BROADCAST_MAX_ROWS = 2_000_000

FLOW_OUT = ["flow_id", "src_ip", "dst_ip", "protocol", "port", "proto_num", "packets", "bytes",
            "last_seen", "direction", "country"]


def static_reasons(df: DataFrame | None = None) -> Column:
    """Array of static rule reasons (possibly empty), in rule order.

    Protocol-number checks form one if/elif chain (telnet, ssh, rdp, dns
    tunnelling), packet/byte volume a second, dynamic-port activity a third.
    """
    proto, port, pk, by = F.col("proto_num"), F.col("port"), F.col("packets"), F.col("bytes")
    first = (F.when(proto == 23, F.lit(K.REASON_TELNET))
             .when((proto == 22) & (port == 22), F.lit(K.REASON_SSH))
             .when((proto == 6) & (port == 3389), F.lit(K.REASON_RDP))
             .when((proto == 17) & (port == 53) & (pk > K.DNS_PACKETS_LIMIT), F.lit(K.REASON_DNS_TUNNEL)))
    second = (F.when(pk > K.HIGH_PACKETS_LIMIT, F.lit(K.REASON_HIGH_PACKETS))
              .when(by > K.HIGH_BYTES_LIMIT, F.lit(K.REASON_HIGH_BYTES)))
    third = F.when((port > K.DYNAMIC_PORT_FLOOR) & (pk > K.DYNAMIC_PORT_PACKETS_LIMIT),
                   F.lit(K.REASON_DYNAMIC_PORT))
    return F.array_compact(F.array(first, second, third))


def static_suspicious(flows: DataFrame) -> DataFrame:
    """Flows tripping at least one static rule, with their joined reasons."""
    return (flows.withColumn("__r", static_reasons())
            .where(F.size("__r") > 0)
            .withColumn("suspicion_reason", F.array_join("__r", K.REASON_SEPARATOR))
            .drop("__r"))


def policy_table(spark) -> DataFrame:
    return spark.createDataFrame(K.SUSPICIOUS_COMBINATIONS, "p_proto int, p_port int, p_text string")


def with_policy(flows: DataFrame, only_flagged: bool = True) -> DataFrame:
    """Attach the (protocol, port) policy text as ``policy_reason``.

    Broadcast equi-join on two keys against a 10-row table; texts ending in
    ``Normal`` are dropped when ``only_flagged``.
    """
    pol = policy_table(flows.sparkSession)
    if only_flagged:
        pol = pol.where(~F.col("p_text").endswith("Normal"))
    pol = F.broadcast(pol)
    j = flows.join(pol, (flows["proto_num"] == pol["p_proto"]) & (flows["port"] == pol["p_port"]), "left")
    return j.withColumnRenamed("p_text", "policy_reason").drop("p_proto", "p_port")


def _reason_array(use_policy: bool) -> Column:
    static = static_reasons()
    if use_policy:
        return F.concat(F.array_compact(F.array(F.col("policy_reason"))), static)
    return static


_IS_SUSPICIOUS = "size(__static) > 0 OR size(__rules) > 0"


def _judged(flows: DataFrame, rules: DataFrame | None, use_policy: bool) -> DataFrame:
    """``flows`` plus its static reasons (``__static``) and rules (``__rules``)."""
    fl = with_policy(flows) if use_policy else flows.withColumn("policy_reason", F.lit(None).cast("string"))
    fl = fl.withColumn("__static", _reason_array(use_policy))
    if rules is not None:
        return R.with_triggered(fl, rules)
    return fl.withColumn("__rules", F.array().cast(f"array<{R.RULE_STRUCT_TYPE}>"))


def flag_suspicious(flows: DataFrame, rules: DataFrame | None = None, use_policy: bool = False) -> DataFrame:
    """Every flow with a boolean ``suspicious``, for counting."""
    return _judged(flows, rules, use_policy).withColumn("suspicious", F.expr(_IS_SUSPICIOUS)).drop(
        "__static", "__rules", "policy_reason")


def detect_suspicious(flows: DataFrame, rules: DataFrame | None = None, use_policy: bool = False,
                      flow_key: str = "flow_id") -> DataFrame:
    """Suspicious flows = static reasons (+ policy) and triggered generated rules.

    Plan: one scan of the flows, broadcast lookups of the policy and of the
    rules grouped by key (``rules.with_triggered``), a filter. Nothing is
    shuffled, and every input row is judged by itself.
    """
    carry = [c for c in FLOW_OUT if c in flows.columns and c != flow_key]
    fl = _judged(flows, rules, use_policy)
    ml_rules = F.transform("__rules", lambda x: x["rule"])
    ml_text = F.transform("__rules", lambda x: F.concat(F.lit(K.ML_REASON_PREFIX), x["rule"]["description"]))
    out = fl.where(_IS_SUSPICIOUS).select(
        flow_key, *carry,
        F.array_join(F.concat("__static", ml_text), K.REASON_SEPARATOR).alias("suspicion_reason"),
        ml_rules.alias("ml_triggered_rules"),
        F.size("__rules").alias("ml_rule_count"),
    )
    if "last_seen" in out.columns:
        out = out.withColumnRenamed("last_seen", "timestamp")
    return out


# --- evidence ------------------------------------------------------------------------

FLOW_KEY = ["src_ip", "dst_ip", "proto_num"]


def evidence_packets(packets: DataFrame, suspicious: DataFrame,
                     broadcast_max_rows: int = EVIDENCE_BROADCAST_MAX_ROWS) -> DataFrame:
    """The packets of every suspicious flow (semi join on the flow key).

    The key set, materialised once (detection does not run twice), is broadcast
    when its counted size allows; otherwise both sides shuffle on the key (AQE
    splits hot keys).
    """
    keys = materialize(suspicious.select(*FLOW_KEY).distinct())
    n = keys.count()
    side = F.broadcast(keys) if n <= broadcast_max_rows else keys
    return packets.join(side, FLOW_KEY, "left_semi").withColumn("date", F.to_date("ts"))


def write_evidence(evidence: DataFrame, path: str) -> None:
    """Append evidence packets as Parquet partitioned by capture date."""
    from netweave.sources.io import write_by_date
    write_by_date(evidence, path)


def evidence_manifest(evidence: DataFrame) -> DataFrame:
    """Per flow: packet count, bytes and first/last packet time."""
    return (evidence.groupBy(*FLOW_KEY)
            .agg(F.count(F.lit(1)).alias("packets"), F.sum("length").cast("long").alias("bytes"),
                 F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")))
