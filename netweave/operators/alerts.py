"""Structured alerts: scoring of suspicious flows, filters, search,
statistics, newest-first listings and the append/export sinks."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions import scoring as S
from netweave.functions.timeparts import add_seconds, date_of, ntz_literal, to_ntz
from netweave.session import materialize

ALERT_COLUMNS = ["alert_id", "timestamp", "src_ip", "dst_ip", "protocol", "packets", "bytes",
                 "threat_type", "anomaly_score", "severity", "suspicion_reason", "direction",
                 "country", "port", "proto_num", "created_at"]


def to_alerts(suspicious: DataFrame, created_at, flow_key: str = "flow_id") -> DataFrame:
    """One structured alert per suspicious flow.

    Score in integer tenths (suspicious/monitor reason, TCP/UDP, external
    direction, non-internal country, common/admin port), threat type by an
    ordered cascade, severity band by score. ``alert_id`` is
    ``ALERT_<epoch>_<hash>`` over the flow key and time, so one flow has one
    alert however often and with whatever rules the job runs (idempotent
    appends). Times may be timestamps, ISO text or epoch seconds.
    """
    tenths = S.anomaly_score_tenths("suspicion_reason", "protocol", "direction", "country", "port")
    ident = [flow_key] if flow_key in suspicious.columns else ["src_ip", "dst_ip", "proto_num", "port"]
    when = to_ntz("timestamp", suspicious.schema["timestamp"].dataType.simpleString())
    df = suspicious.withColumn("__t", tenths).withColumn("timestamp", when)
    return df.select(
        S.alert_id("timestamp", *ident).alias("alert_id"),
        F.col("timestamp"),
        F.coalesce("src_ip", F.lit("")).alias("src_ip"),
        F.coalesce("dst_ip", F.lit("")).alias("dst_ip"),
        F.coalesce("protocol", F.lit("")).alias("protocol"),
        F.coalesce(F.col("packets").cast("long"), F.lit(0).cast("long")).alias("packets"),
        F.coalesce(F.col("bytes").cast("long"), F.lit(0).cast("long")).alias("bytes"),
        S.threat_type("suspicion_reason", "protocol", "port").alias("threat_type"),
        F.round(F.col("__t") / F.lit(10.0), 3).alias("anomaly_score"),
        S.severity_from_tenths("__t").alias("severity"),
        F.coalesce("suspicion_reason", F.lit("")).alias("suspicion_reason"),
        F.coalesce("direction", F.lit("")).alias("direction"),
        F.coalesce("country", F.lit("")).alias("country"),
        F.coalesce(F.col("port").cast("int"), F.lit(0)).alias("port"),
        F.coalesce(F.col("proto_num").cast("int"), F.lit(0)).alias("proto_num"),
        (created_at if isinstance(created_at, Column) else ntz_literal(created_at)).alias("created_at"),
    )


# --- filters (each newest first, then alert_id, with the API's limit) -------------

def _newest(df: DataFrame, limit: int | None, by: str = "timestamp") -> DataFrame:
    out = df.orderBy(F.col(by).desc(), F.col("alert_id").asc())
    return out.limit(limit) if limit is not None else out


def alerts_by_severity(alerts: DataFrame, severity: str, limit: int = 50) -> DataFrame:
    return _newest(alerts.where(F.col("severity") == severity.upper()), limit)


def alerts_by_threat_type(alerts: DataFrame, threat_type: str, limit: int = 100) -> DataFrame:
    return _newest(alerts.where(F.col("threat_type") == threat_type), limit)


def alerts_by_protocol(alerts: DataFrame, protocol: str, limit: int = 100) -> DataFrame:
    return _newest(alerts.where(F.col("protocol") == protocol.upper()), limit)


def alerts_by_ip(alerts: DataFrame, ip: str, limit: int = 100) -> DataFrame:
    return _newest(alerts.where((F.col("src_ip") == ip) | (F.col("dst_ip") == ip)), limit)


def alerts_by_date_range(alerts: DataFrame, start=None, end=None, limit: int = 100) -> DataFrame:
    """Inclusive range on ``timestamp``; either bound may be omitted."""
    cond = F.lit(True)
    if start is not None:
        cond = cond & (F.col("timestamp") >= ntz_literal(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= ntz_literal(end))
    return _newest(alerts.where(cond), limit)


def search_alerts(alerts: DataFrame, text: str | None = None, severity: str | None = None,
                  threat_type: str | None = None, protocol: str | None = None,
                  src_ip: str | None = None, dst_ip: str | None = None, port: int | None = None,
                  start=None, end=None, min_score: float | None = None,
                  max_score: float | None = None, limit: int | None = 100) -> DataFrame:
    """Conjunctive alert search over the whole table.

    ``text``: case-insensitive literal substring of the nine text fields
    joined by spaces; src/dst IP: case-insensitive substring; severity,
    threat type, protocol, port: exact; time and score ranges inclusive.
    """
    cond = F.lit(True)
    if text:
        blob = F.lower(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in K.SEARCH_FIELDS]))
        cond = cond & blob.contains(text.lower())
    if severity:
        cond = cond & (F.col("severity") == severity)
    if threat_type:
        cond = cond & (F.col("threat_type") == threat_type)
    if protocol:
        cond = cond & (F.col("protocol") == protocol)
    if src_ip:
        cond = cond & F.lower("src_ip").contains(src_ip.lower())
    if dst_ip:
        cond = cond & F.lower("dst_ip").contains(dst_ip.lower())
    if port is not None:
        cond = cond & (F.col("port") == int(port))
    if start is not None:
        cond = cond & (F.col("timestamp") >= ntz_literal(start))
    if end is not None:
        cond = cond & (F.col("timestamp") <= ntz_literal(end))
    if min_score is not None:
        cond = cond & (F.col("anomaly_score") >= float(min_score))
    if max_score is not None:
        cond = cond & (F.col("anomaly_score") <= float(max_score))
    return _newest(alerts.where(cond), limit)


def alerts_last_hours(alerts: DataFrame, as_of, hours: int = 24, limit: int | None = 100) -> DataFrame:
    """Preset: alerts whose timestamp lies in ``[as_of - hours, as_of]``."""
    end = as_of if isinstance(as_of, _dt.datetime) else _dt.datetime.fromisoformat(str(as_of))
    return search_alerts(alerts, start=end - _dt.timedelta(hours=hours), end=end, limit=limit)


def alert_statistics(alerts: DataFrame, as_of, hours: int = 24) -> DataFrame:
    """Long form (metric, key, value): total, created in the last ``hours``
    before ``as_of``, count per severity and per threat type.

    One scan: a partial aggregate per (severity, threat type) feeds the
    small final unions.
    """
    recent_from = add_seconds(ntz_literal(as_of), -hours * 3600)
    per = (alerts.groupBy("severity", "threat_type")
           .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("created_at") >= recent_from).alias("r")))
    total = per.agg(F.lit("total_alerts").alias("metric"), F.lit("").alias("key"),
                    F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("value"))
    recent = per.agg(F.lit("recent_alerts_24h").alias("metric"), F.lit("").alias("key"),
                     F.coalesce(F.sum("r"), F.lit(0)).cast("long").alias("value"))
    by_sev = per.groupBy("severity").agg(F.sum("n").cast("long").alias("value")) \
        .select(F.lit("severity_distribution").alias("metric"), F.col("severity").alias("key"), "value")
    by_thr = per.groupBy("threat_type").agg(F.sum("n").cast("long").alias("value")) \
        .select(F.lit("threat_type_distribution").alias("metric"), F.col("threat_type").alias("key"), "value")
    return total.unionByName(recent).unionByName(by_sev).unionByName(by_thr)


def latest_alerts(alerts: DataFrame, limit: int = 100) -> DataFrame:
    """Newest structured alerts by ``created_at`` (then alert_id)."""
    return _newest(alerts, limit, by="created_at")


def latest_attack_alerts(attack_alerts: DataFrame, limit: int = 100) -> DataFrame:
    return attack_alerts.orderBy(F.col("timestamp").desc(), F.col("id").asc()).limit(limit)


# --- sinks ------------------------------------------------------------------------------

def append_unstored(new_alerts: DataFrame, path: str, key: str, grain: str = "day") -> DataFrame:
    """Append alerts whose ``key`` is not stored yet (unique ids), in folders by
    ``date`` (of the day, or the first of the ``month`` or ``year`` for sparse alerts: a
    file costs more than its rows); returns the alerts appended.

    The batch is materialised once. Filters beside the store (``membership``) tell which
    ids it can hold: a first append and new ids read nothing of it, and only the others
    are looked up, on date and id, in the folders of their dates. Filters are written
    before the alerts, so an append that breaks off in between leaves ids that are looked
    up once too often. A store without filters gets them here.
    """
    from netweave.operators import membership as M
    from netweave.sources.io import read_stored, write_by_date
    batch = materialize(new_alerts.dropDuplicates([key]).withColumn("date", date_of("timestamp", grain)))
    spark = batch.sparkSession
    stored, known = read_stored(spark, path, batch.schema), read_stored(spark, M.filter_path(path), M.SCHEMA)
    if stored is None:
        if not batch.isEmpty():
            write_by_date(M.filters(batch, key), M.filter_path(path), "month")
            write_by_date(batch, path)
        return batch
    if known is None:
        write_by_date(M.filters(stored, key), M.filter_path(path), "month")
        known = read_stored(spark, M.filter_path(path), M.SCHEMA)
    here = _within(batch, "date")
    if here is None:
        return batch
    judged = materialize(M.possible(batch, known.where(_between("date", here) & _between("month", here)), key))
    unsure = judged.where("__possible").drop("__possible")
    fresh = judged.where("NOT __possible").drop("__possible")
    there = _within(unsure, "date")
    if there is not None:
        ids = stored.where(_between("date", there)).select(F.col("date").alias("s_date"), F.col(key).alias("s_id"))
        fresh = fresh.unionByName(unsure.join(ids, F.col("date").eqNullSafe(F.col("s_date")) & (F.col(key) == F.col("s_id")), "left_anti"))
    write_by_date(M.filters(fresh, key), M.filter_path(path), "month")
    write_by_date(fresh, path)
    return fresh


def _within(rows: DataFrame, date: str):
    """Least and greatest date of the rows, and whether some have none; None without rows."""
    lo, hi, n, undated = rows.agg(F.min(date), F.max(date), F.count(F.lit(1)), F.count_if(F.col(date).isNull())).first()
    return (lo, hi, undated > 0) if n else None


def _between(column: str, bounds) -> Column:
    """Literal bounds of dates, or of the months they lie in, which prune folders."""
    lo, hi, undated = bounds
    held = F.lit(False)
    if lo is not None:
        first = lo.replace(day=1) if column == "month" else lo
        held = F.col(column).between(F.lit(first.isoformat()).cast("date"), F.lit(hi.isoformat()).cast("date"))
    return held | F.col(column).isNull() if undated else held


def append_structured_alerts(new_alerts: DataFrame, path: str, grain: str = "day") -> DataFrame:
    """Append structured alerts whose ``alert_id`` is not stored yet."""
    return append_unstored(new_alerts, path, "alert_id", grain)


def append_attack_alerts(alerts: DataFrame, path: str) -> None:
    """Append attack alerts, partitioned by date for pruning."""
    from netweave.sources.io import write_by_date
    write_by_date(alerts.withColumn("date", F.to_date("timestamp")), path)


def export_csv(alerts: DataFrame, path: str) -> DataFrame:
    """The 13-column CSV export (header titles as in the UI)."""
    out = alerts.select(*[F.col(c).cast("string").alias(title) for c, title in K.EXPORT_COLUMNS])
    out.write.mode("overwrite").option("header", True).csv(path)
    return out


def evolve_alert_table(old: DataFrame, new: DataFrame) -> DataFrame:
    """Older alert rows lacking newer columns get them as NULL."""
    return old.unionByName(new, allowMissingColumns=True)
