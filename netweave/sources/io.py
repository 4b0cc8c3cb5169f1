"""Readers and writers: packet/flow sources (batch or stream), the labelled
flow CSV, the rule store and write-then-read helpers for sinks."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from netweave import constants as K
from netweave.session import scratch_path

PACKET_SCHEMA = T.StructType([
    T.StructField("packet_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
    T.StructField("src_ip", T.StringType()), T.StructField("dst_ip", T.StringType()),
    T.StructField("proto_num", T.IntegerType()), T.StructField("src_port", T.IntegerType()),
    T.StructField("dst_port", T.IntegerType()), T.StructField("length", T.LongType()),
])


def read_packets(spark: SparkSession, path: str, fmt: str = "parquet", streaming: bool = False,
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Packets from Parquet/JSON/CSV files, as a batch or a stream (fixed
    schema, no inference)."""
    if streaming:
        r = spark.readStream.schema(PACKET_SCHEMA).format(fmt)
        if max_files_per_trigger:
            r = r.option("maxFilesPerTrigger", max_files_per_trigger)
        return r.load(path)
    return spark.read.schema(PACKET_SCHEMA).format(fmt).load(path)


def read_flow_csv(spark: SparkSession, path: str) -> DataFrame:
    """Labelled flow CSV: header names stripped, values cleaned by
    ``clean_flow_features``."""
    raw = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return clean_flow_features(raw)


def clean_flow_features(df: DataFrame) -> DataFrame:
    """Strip header names; model features to double with ±inf/NaN/NULL -> 0."""
    stripped = df.toDF(*[c.strip() for c in df.columns])
    cols = []
    for c in stripped.columns:
        if c in K.MODEL_FEATURES:
            v = F.col(f"`{c}`").cast("double")
            v = F.when(F.isnan(v) | (F.abs(v) == float("inf")) | v.isNull(), F.lit(0.0)).otherwise(v)
            cols.append(v.alias(c))
        else:
            cols.append(F.col(f"`{c}`"))
    return stripped.select(*cols)


def write_by_date(df: DataFrame, path: str, date_col: str = "date", mode: str = "append") -> None:
    """Append ``df`` as Parquet partitioned by ``date_col``.

    A rebalance hint on the partition column brings the rows of a date
    together; adaptive execution sizes the tasks by bytes, joins small dates and
    splits a hot one, and the input is computed once.
    """
    df.hint("rebalance", F.col(date_col)).write.mode(mode).partitionBy(date_col).parquet(path)


def read_stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame | None:
    """A Parquet table, None when nothing was stored at ``path`` yet. Any other
    failure (permissions, storage, corrupt files) is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def read_if_stored(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """``read_stored``, empty when nothing was stored yet."""
    stored = read_stored(spark, path, schema)
    return spark.createDataFrame([], schema) if stored is None else stored


def roundtrip_parquet(df: DataFrame, name: str, partition_by: list[str] | None = None,
                      mode: str = "append") -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back
    (used by sink queries to verify what was stored)."""
    path = scratch_path(df.sparkSession, name)
    if partition_by:
        write_by_date(df, path, partition_by[0], mode=mode)
    else:
        df.write.mode(mode).parquet(path)
    back = df.sparkSession.read.parquet(path)
    return back.select(*df.columns)


# --- lookbacks and source choice ---------------------------------------------------------

ALERT_LOOKBACK_COLUMNS = ["timestamp", "src_ip", "dst_ip", "protocol_name", "direction",
                          "is_internal_src", "is_internal_dst", "country"]


#: Columns and types of the analysis source, whichever table it comes from.
SOURCE_COLUMNS = [
    ("timestamp", "timestamp_ntz"), ("src_ip", "string"), ("dst_ip", "string"), ("protocol_name", "string"),
    ("direction", "string"), ("is_internal_src", "boolean"), ("is_internal_dst", "boolean"),
    ("country", "string"), ("hour", "int"), ("date", "date"), ("bytes", "long"), ("packets", "long"),
    ("dst_port", "int"), ("src_port", "int"), ("port", "int"), ("proto_num", "int"), ("protocol", "string"),
    ("last_seen", "timestamp_ntz"),
]


def flows_lookback(flows: DataFrame, hours: float, as_of, col: str = "last_seen",
                   date_col: str = "date") -> DataFrame:
    """Flows seen in the last ``hours`` before ``as_of``, newest first.

    The bound is a literal, so it is pushed into the Parquet scan; when the
    table has a ``date`` partition column an equivalent date bound is added
    so whole partitions are pruned.
    """
    import datetime as dt
    lo = as_of - dt.timedelta(hours=hours)
    cond = F.col(col) >= F.lit(str(lo)).cast("timestamp_ntz")
    if date_col in flows.columns:
        cond = cond & (F.col(date_col) >= F.lit(lo.date().isoformat()).cast("date"))
    return flows.where(cond).orderBy(F.col(col).desc())


def alerts_lookback(attack_alerts: DataFrame, hours: float, as_of) -> DataFrame:
    """Attack alerts of the last ``hours`` (8 columns)."""
    import datetime as dt
    lo = as_of - dt.timedelta(hours=hours)
    return (attack_alerts.where(F.col("timestamp") >= F.lit(str(lo)).cast("timestamp_ntz"))
            .select(*ALERT_LOOKBACK_COLUMNS))


def alerts_as_flows(alerts: DataFrame) -> DataFrame:
    """Attack alerts reshaped into the flow analysis frame.

    Ports and protocol numbers come from the protocol name; packet/byte
    counts and the source port are unknown (NULL), never invented.
    """
    name = F.col("protocol_name")
    port = None
    for n, p in K.ALERT_NAME_TO_PORT:
        port = F.when(name == n, F.lit(p)) if port is None else port.when(name == n, F.lit(p))
    port = port.otherwise(F.lit(0))
    proto = None
    for n, p in K.ALERT_NAME_TO_PROTO:
        proto = F.when(name == n, F.lit(p)) if proto is None else proto.when(name == n, F.lit(p))
    proto = proto.otherwise(F.lit(0))
    return alerts.select(
        "timestamp", "src_ip", "dst_ip", "protocol_name", "direction", "is_internal_src", "is_internal_dst",
        "country", F.hour("timestamp").alias("hour"), F.to_date("timestamp").alias("date"),
        F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("long").alias("packets"),
        port.alias("dst_port"), F.lit(None).cast("int").alias("src_port"), port.alias("port"),
        proto.alias("proto_num"), name.alias("protocol"), F.col("timestamp").alias("last_seen"))


def flows_as_source(flows: DataFrame) -> DataFrame:
    """Flows in the columns of ``alerts_as_flows``; what a flow table does not
    hold is NULL, and unknown counts stay NULL."""
    have = set(flows.columns)
    derived = {"timestamp": F.col("last_seen"), "hour": F.hour("last_seen"), "date": F.to_date("last_seen")}
    if "protocol" not in have and "protocol_name" in have:
        derived["protocol"] = F.col("protocol_name")
    return flows.select(*[
        (derived[name] if name in derived and name not in have else F.col(name) if name in have else F.lit(None))
        .cast(kind).alias(name) for name, kind in SOURCE_COLUMNS])


def choose_source(flows_recent: DataFrame, alerts: DataFrame) -> DataFrame:
    """Recent flows when there are any, else attack alerts as flows (never
    fabricated sample data), in the same columns either way. One cheap
    ``isEmpty`` probe picks the plan."""
    if not flows_recent.isEmpty():
        return flows_as_source(flows_recent)
    return alerts_as_flows(alerts)
