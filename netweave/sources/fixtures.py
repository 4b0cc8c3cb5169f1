"""Stand-in inputs built from the supplied test tables.

These only relabel rows of the supplied parquet tables into the schemas the
library expects (flows, packets, GeoIP ranges, attack alerts, labelled flows).
They do none of the library's work. Each mapping is written once as SQL
expression text with two dialect hooks, so the Spark reader and the DuckDB
oracle read the same definition.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPARK = "spark"
DUCK = "duckdb"


def _add_seconds(ts: str, n: str, dialect: str) -> str:
    if dialect == SPARK:
        return f"timestampadd(SECOND, {n}, {ts})"
    return f"({ts} + to_seconds({n}))"


def _json_k(dialect: str) -> str:
    if dialect == SPARK:
        return "CAST(get_json_object(props, '$.k') AS INT)"
    return "CAST(json_extract_string(props, '$.k') AS INT)"


def _octets(key: str) -> tuple[str, str]:
    hi = f"CAST(CAST(floor({key} / 256) AS BIGINT) % 256 AS STRING)"
    lo = f"CAST({key} % 256 AS STRING)"
    return hi, lo


def flow_inner_columns(dialect: str) -> list[str]:
    s_hi, s_lo = _octets("l_suppkey")
    p_hi, p_lo = _octets("l_partkey")
    s1 = "((l_orderkey * 7919 + l_linenumber * 613) % 86400)"
    first_off = f"({s1} - (l_orderkey * 13 + l_linenumber) % 300)"
    return [
        ("concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
         "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), "
         "CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING)) AS flow_id"),
        (f"CASE WHEN l_suppkey % 5 = 0 THEN concat('203.0.', {s_hi}, '.', {s_lo}) "
         f"ELSE concat('192.168.', {s_hi}, '.', {s_lo}) END AS src_ip"),
        (f"CASE WHEN l_partkey % 3 = 0 THEN concat('10.0.', {p_hi}, '.', {p_lo}) "
         f"ELSE concat('8.', {p_lo}, '.', {p_hi}, '.', CAST(l_orderkey % 16 AS STRING)) END AS dst_ip"),
        ("CAST(CASE WHEN l_orderkey % 97 = 0 THEN 23 WHEN l_orderkey % 97 = 1 THEN 22 "
         "WHEN l_returnflag = 'N' THEN 6 WHEN l_returnflag = 'R' THEN 17 "
         "WHEN l_linestatus = 'O' THEN 6 ELSE 1 END AS INT) AS proto_num"),
        "CAST(1024 + (l_orderkey * 31 + l_linenumber) % 64511 AS INT) AS src_port",
        ("CAST(CASE WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 0 "
         "ELSE CASE CAST(l_partkey % 12 AS INT) WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 "
         "WHEN 3 THEN 22 WHEN 4 THEN 23 WHEN 5 THEN 3389 WHEN 6 THEN 21 WHEN 7 THEN 445 "
         "WHEN 8 THEN 8080 WHEN 9 THEN 3306 ELSE CAST(49000 + l_partkey % 4000 AS INT) END END AS INT) AS dst_port"),
        ("CAST(l_quantity AS BIGINT) * CASE WHEN l_orderkey % 101 = 0 THEN 500 "
         "WHEN l_orderkey % 53 = 0 THEN 60 ELSE 1 END AS packets"),
        ("CAST(floor(l_extendedprice) AS BIGINT) * CASE WHEN l_orderkey % 103 = 0 THEN 40 ELSE 1 END AS bytes"),
        f"CAST({_add_seconds('l_shipdate', first_off, dialect)} AS TIMESTAMP_NTZ) AS first_seen"
        if dialect == SPARK else f"{_add_seconds('l_shipdate', first_off, dialect)} AS first_seen",
        f"CAST({_add_seconds('l_shipdate', s1, dialect)} AS TIMESTAMP_NTZ) AS last_seen"
        if dialect == SPARK else f"{_add_seconds('l_shipdate', s1, dialect)} AS last_seen",
    ]


FLOW_OUTER = ["flow_id", "src_ip", "dst_ip", "proto_num", "src_port", "dst_port",
              "CAST(CASE WHEN dst_port > 0 THEN dst_port ELSE src_port END AS INT) AS port",
              "packets", "bytes", "first_seen", "last_seen"]


def packet_inner_columns(dialect: str) -> list[str]:
    return [
        "event_id", "ts",
        "concat('192.168.0.', CAST(user_id % 8 AS STRING)) AS a",
        f"concat('8.8.', CAST({_json_k(dialect)} % 4 AS STRING), '.8') AS b",
        "CAST(CASE event_type WHEN 'error' THEN 1 WHEN 'click' THEN 17 ELSE 6 END AS INT) AS proto_num",
        "CAST(CASE event_type WHEN 'error' THEN 0 ELSE 1024 + user_id % 1000 END AS INT) AS sp",
        ("CAST(CASE event_type WHEN 'error' THEN 0 WHEN 'click' THEN 53 WHEN 'view' THEN 443 "
         "WHEN 'signup' THEN 80 ELSE 22 END AS INT) AS dp"),
        "CAST(40 + floor(value) AS BIGINT) AS length",
    ]


PACKET_OUTER = [
    "event_id AS packet_id",
    "ts",
    "CASE WHEN event_id % 3 = 0 THEN b ELSE a END AS src_ip",
    "CASE WHEN event_id % 3 = 0 THEN a ELSE b END AS dst_ip",
    "proto_num",
    "CASE WHEN event_id % 3 = 0 THEN dp ELSE sp END AS src_port",
    "CASE WHEN event_id % 3 = 0 THEN sp ELSE dp END AS dst_port",
    "length",
]

GEOIP_COLUMNS = [
    "CAST(134217728 + n_nationkey * 8 * 65536 AS BIGINT) AS start_ip",
    "CAST(134217728 + n_nationkey * 8 * 65536 + 8 * 65536 - 1 AS BIGINT) AS end_ip",
    "n_name AS country",
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def _balanced(df: DataFrame) -> DataFrame:
    from netweave.session import balanced
    return balanced(df)


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One flow per lineitem row (FIXTURES.md §3)."""
    return (_balanced(_table(spark, sf_dir, "lineitem"))
            .selectExpr(*flow_inner_columns(SPARK))
            .selectExpr(*FLOW_OUTER))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One packet per events row."""
    return (_balanced(_table(spark, sf_dir, "events"))
            .selectExpr(*packet_inner_columns(SPARK))
            .selectExpr(*PACKET_OUTER))


def geoip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """25 /13 country blocks from 8.0.0.0 upward."""
    return _table(spark, sf_dir, "nation").selectExpr(*GEOIP_COLUMNS)


# --- derived stand-ins (rows in the schema other jobs expect) --------------

ATTACK_PREDICTION_SQL = ("CASE WHEN proto_num = 23 OR packets > 1000 OR bytes > 1000000 "
                         "THEN 'Attack' ELSE 'Normal' END")


def attack_alerts_from(enriched: DataFrame) -> DataFrame:
    """Attack-alert rows (stored model verdicts) for enriched flows."""
    return enriched.selectExpr(
        "flow_id AS id", "last_seen AS timestamp", "src_ip", "dst_ip",
        f"{ATTACK_PREDICTION_SQL} AS prediction",
        "CAST(packets % 100 AS DOUBLE) / 100 AS confidence",
        "direction", "protocol_name", "is_internal_src", "is_internal_dst", "country")


def labelled_flows_from(fl: DataFrame) -> DataFrame:
    """Labelled flow-feature rows with original CSV-style header names.

    Zero durations give +inf rates and empty backward traffic gives NaN
    means, as in real exports; some names carry stray spaces.
    """
    dur = "CAST(timestampdiff(MICROSECOND, first_seen, last_seen) AS DOUBLE) / 1e6"
    return fl.selectExpr(
        "flow_id",
        f"{dur} AS `Flow Duration`",
        "CAST(packets AS DOUBLE) AS ` Total Fwd Packets`",
        "CAST(packets % 7 AS DOUBLE) AS ` Total Backward Packets`",
        "CAST(bytes AS DOUBLE) AS `Total Length of Fwd Packets`",
        "CAST(bytes % 1009 AS DOUBLE) AS ` Total Length of Bwd Packets`",
        "CAST(bytes AS DOUBLE) / packets AS ` Fwd Packet Length Mean`",
        "CASE WHEN packets % 7 = 0 THEN CAST('NaN' AS DOUBLE) "
        "ELSE CAST(bytes % 1009 AS DOUBLE) / (packets % 7) END AS ` Bwd Packet Length Mean`",
        f"CASE WHEN {dur} = 0 THEN CAST('Infinity' AS DOUBLE) "
        f"ELSE (bytes + bytes % 1009) / ({dur}) END AS `Flow Bytes/s`",
        f"CASE WHEN {dur} = 0 THEN CAST('Infinity' AS DOUBLE) "
        f"ELSE (packets + packets % 7) / ({dur}) END AS ` Flow Packets/s`",
        f"{dur} AS `Fwd IAT Total`",
        f"CASE WHEN packets % 7 > 1 THEN {dur} ELSE 0.0 END AS ` Bwd IAT Total`",
        f"CASE WHEN {ATTACK_PREDICTION_SQL} = 'Attack' THEN 'DDoS' ELSE 'BENIGN' END AS ` Label`",
    )


# --- DuckDB twins --------------------------------------------------------------

def duck_flows_sql() -> str:
    inner = ",\n  ".join(flow_inner_columns(DUCK))
    outer = ", ".join(FLOW_OUTER)
    return f"SELECT {outer} FROM (SELECT\n  {inner}\nFROM lineitem) t"


def duck_packets_sql() -> str:
    inner = ", ".join(packet_inner_columns(DUCK))
    outer = ", ".join(PACKET_OUTER)
    return f"SELECT {outer} FROM (SELECT {inner} FROM events) t"


def duck_geoip_sql() -> str:
    return "SELECT " + ", ".join(GEOIP_COLUMNS) + " FROM nation"
