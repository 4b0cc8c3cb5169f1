"""Alert scoring as Column expressions.

The anomaly score is summed in integer tenths and divided once, so every
combination of terms gives the same value and the same severity band as a
step-by-step float sum, on any engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions.timeparts import epoch_seconds


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _lower(col) -> Column:
    return F.lower(F.coalesce(_c(col).cast("string"), F.lit("")))


def anomaly_score_tenths(reason, protocol, direction, country, port) -> Column:
    r, p, d, c = _lower(reason), _lower(protocol), _lower(direction), _lower(country)
    prt = _c(port)
    reason_term = (F.when(r.contains("suspicious"), K.SCORE_SUSPICIOUS)
                   .when(r.contains("monitor"), K.SCORE_MONITOR).otherwise(0))
    proto_term = F.when(p.isin("tcp", "udp"), K.SCORE_TCP_UDP).otherwise(0)
    dir_term = F.when(d.contains("external"), K.SCORE_EXTERNAL).otherwise(0)
    country_term = F.when(c != "internal", K.SCORE_NOT_INTERNAL).otherwise(0)
    port_term = (F.when(prt.isin(K.COMMON_PORTS), K.SCORE_COMMON_PORT)
                 .when(prt.isin(K.ADMIN_PORTS), K.SCORE_ADMIN_PORT).otherwise(0))
    total = reason_term + proto_term + dir_term + country_term + port_term
    return F.least(F.greatest(total, F.lit(0)), F.lit(10))


def anomaly_score(reason, protocol, direction, country, port) -> Column:
    """Score in [0, 1], three decimals."""
    return F.round(anomaly_score_tenths(reason, protocol, direction, country, port) / F.lit(10.0), 3)


def severity_from_tenths(tenths) -> Column:
    t = _c(tenths)
    expr = None
    for floor, label in K.SEVERITY_STEPS:
        expr = F.when(t >= floor, F.lit(label)) if expr is None else expr.when(t >= floor, F.lit(label))
    return expr.otherwise(F.lit(K.SEVERITY_DEFAULT))


def severity(score) -> Column:
    """Severity band of a score in [0, 1]."""
    return severity_from_tenths(F.round(_c(score) * 10).cast("int"))


def threat_type(reason, protocol, port) -> Column:
    r = _lower(reason)
    prt = _c(port)
    return (F.when(r.contains("tcp on dns port"), F.lit(K.THREAT_DNS_TUNNELING))
            .when(r.contains("udp on http") | r.contains("udp on https"), F.lit(K.THREAT_PROTOCOL_ANOMALY))
            .when(prt == 23, F.lit(K.THREAT_TELNET))
            .when(prt == 22, F.lit(K.THREAT_SSH))
            .when(prt == 3389, F.lit(K.THREAT_RDP))
            .when(r.contains("suspicious"), F.lit(K.THREAT_SUSPICIOUS))
            .when(r.contains("monitor"), F.lit(K.THREAT_UNUSUAL))
            .otherwise(F.lit(K.THREAT_PROTOCOL_ANOMALY)))


def alert_id(ts, *identity) -> Column:
    """``ALERT_<epoch seconds>_<16 hex of a content hash>`` (idempotent)."""
    key = F.concat_ws("|", *[_c(x).cast("string") for x in identity])
    digest = F.upper(F.substring(F.sha2(key, 256), 1, 16))
    return F.concat(F.lit("ALERT_"), epoch_seconds(ts).cast("string"), F.lit("_"), digest)


# --- SQL twins (DuckDB dialect) ---------------------------------------------

def sql_score_tenths(reason: str, protocol: str, direction: str, country: str, port: str) -> str:
    r = f"lower(coalesce({reason}, ''))"
    p = f"lower(coalesce({protocol}, ''))"
    d = f"lower(coalesce({direction}, ''))"
    c = f"lower(coalesce({country}, ''))"
    common = ", ".join(map(str, K.COMMON_PORTS))
    admin = ", ".join(map(str, K.ADMIN_PORTS))
    total = (f"(CASE WHEN contains({r}, 'suspicious') THEN {K.SCORE_SUSPICIOUS} "
             f"WHEN contains({r}, 'monitor') THEN {K.SCORE_MONITOR} ELSE 0 END"
             f" + CASE WHEN {p} IN ('tcp', 'udp') THEN {K.SCORE_TCP_UDP} ELSE 0 END"
             f" + CASE WHEN contains({d}, 'external') THEN {K.SCORE_EXTERNAL} ELSE 0 END"
             f" + CASE WHEN {c} <> 'internal' THEN {K.SCORE_NOT_INTERNAL} ELSE 0 END"
             f" + CASE WHEN {port} IN ({common}) THEN {K.SCORE_COMMON_PORT} "
             f"WHEN {port} IN ({admin}) THEN {K.SCORE_ADMIN_PORT} ELSE 0 END)")
    return f"least(greatest({total}, 0), 10)"


def sql_severity_from_tenths(t: str) -> str:
    whens = " ".join(f"WHEN {t} >= {floor} THEN '{label}'" for floor, label in K.SEVERITY_STEPS)
    return f"(CASE {whens} ELSE '{K.SEVERITY_DEFAULT}' END)"


def sql_threat_type(reason: str, port: str) -> str:
    r = f"lower(coalesce({reason}, ''))"
    return (f"(CASE WHEN contains({r}, 'tcp on dns port') THEN '{K.THREAT_DNS_TUNNELING}' "
            f"WHEN contains({r}, 'udp on http') OR contains({r}, 'udp on https') THEN '{K.THREAT_PROTOCOL_ANOMALY}' "
            f"WHEN {port} = 23 THEN '{K.THREAT_TELNET}' WHEN {port} = 22 THEN '{K.THREAT_SSH}' "
            f"WHEN {port} = 3389 THEN '{K.THREAT_RDP}' "
            f"WHEN contains({r}, 'suspicious') THEN '{K.THREAT_SUSPICIOUS}' "
            f"WHEN contains({r}, 'monitor') THEN '{K.THREAT_UNUSUAL}' ELSE '{K.THREAT_PROTOCOL_ANOMALY}' END)")


def sql_alert_id(ts: str, *identity: str) -> str:
    key = "concat_ws('|', " + ", ".join(f"CAST({x} AS VARCHAR)" for x in identity) + ")"
    return (f"concat('ALERT_', CAST(epoch_us({ts}) // 1000000 AS VARCHAR), '_', "
            f"upper(substring(sha256({key}), 1, 16)))")
