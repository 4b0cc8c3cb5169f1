"""Shared SQL fragments (DuckDB dialect) for the oracle queries.

The stand-in inputs are rebuilt from the raw tables with the same mapping
text the Spark readers use (``sources.fixtures``); every operator is then
re-derived independently in plain SQL.
"""

from __future__ import annotations

from netweave import constants as K
from netweave.functions import net as N
from netweave.functions import scoring as S
from netweave.sources import fixtures as X


def flows_cte() -> str:
    return f"flows AS ({X.duck_flows_sql()})"


def geoip_cte() -> str:
    return f"geoip AS ({X.duck_geoip_sql()})"


def packets_cte() -> str:
    return f"packets AS ({X.duck_packets_sql()})"


def enriched_cte(source: str = "flows", name: str = "enriched") -> str:
    pn = N.sql_protocol_name("f.proto_num")
    s_int = N.sql_is_private("f.src_ip")
    d_int = N.sql_is_private("f.dst_ip")
    ipl = N.sql_ipv4_to_long("f.dst_ip")
    return (f"{name}_base AS (SELECT f.*, {pn} AS protocol_name, {pn} AS protocol, "
            f"{s_int} AS is_internal_src, {d_int} AS is_internal_dst, {ipl} AS __ipl FROM {source} f), "
            f"{name} AS (SELECT b.* EXCLUDE (__ipl), "
            f"{N.sql_direction('b.is_internal_src', 'b.is_internal_dst')} AS direction, "
            f"CASE WHEN b.is_internal_dst THEN '{K.COUNTRY_INTERNAL}' "
            f"ELSE coalesce(g.country, '{K.COUNTRY_UNKNOWN}') END AS country "
            f"FROM {name}_base b LEFT JOIN geoip g ON b.__ipl BETWEEN g.start_ip AND g.end_ip)")


def with_enriched(*extra: str) -> str:
    parts = [flows_cte(), geoip_cte(), enriched_cte()] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n"


def static_reasons_expr(alias: str = "e") -> str:
    """Static rule reasons as an array (DuckDB), NULLs removed."""
    a = alias
    first = (f"CASE WHEN {a}.proto_num = 23 THEN '{K.REASON_TELNET}' "
             f"WHEN {a}.proto_num = 22 AND {a}.port = 22 THEN '{K.REASON_SSH}' "
             f"WHEN {a}.proto_num = 6 AND {a}.port = 3389 THEN '{K.REASON_RDP}' "
             f"WHEN {a}.proto_num = 17 AND {a}.port = 53 AND {a}.packets > {K.DNS_PACKETS_LIMIT} "
             f"THEN '{K.REASON_DNS_TUNNEL}' END")
    second = (f"CASE WHEN {a}.packets > {K.HIGH_PACKETS_LIMIT} THEN '{K.REASON_HIGH_PACKETS}' "
              f"WHEN {a}.bytes > {K.HIGH_BYTES_LIMIT} THEN '{K.REASON_HIGH_BYTES}' END")
    third = (f"CASE WHEN {a}.port > {K.DYNAMIC_PORT_FLOOR} AND {a}.packets > {K.DYNAMIC_PORT_PACKETS_LIMIT} "
             f"THEN '{K.REASON_DYNAMIC_PORT}' END")
    return f"list_filter([{first}, {second}, {third}], lambda x: x IS NOT NULL)"


def policy_cte() -> str:
    rows = ", ".join(f"({p}, {port}, '{txt}')" for p, port, txt in K.SUSPICIOUS_COMBINATIONS)
    return f"policy(p_proto, p_port, p_text) AS (VALUES {rows})"


__all__ = ["flows_cte", "geoip_cte", "packets_cte", "enriched_cte", "with_enriched",
           "static_reasons_expr", "policy_cte", "N", "S", "K"]


# --- rule tables ---------------------------------------------------------------

_DUCK_TYPES = {"string": "VARCHAR", "int": "INTEGER", "long": "BIGINT", "double": "DOUBLE",
               "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN"}


def rule_select(values: dict[str, str]) -> str:
    """SELECT list of the full rule schema; unspecified columns are typed NULLs."""
    from netweave.operators.rules import RULE_COLUMNS
    cols = []
    for name, t in RULE_COLUMNS:
        expr = values.get(name, "NULL")
        cols.append(f"CAST({expr} AS {_DUCK_TYPES[t]}) AS {name}")
    return ", ".join(cols)


def _stamp(ca: str = "@p.ca") -> str:
    return f"strftime({ca}, '%Y%m%d_%H%M%S')"


def rules_ctes(source: str = "flows", ca_sql: str | None = None, prefix: str = "") -> list[str]:
    """CTEs rules_protocol, rules_port, rules_temporal, rules_behavioral and
    rules_all over ``source`` (needs a ``flows``-shaped relation)."""
    ca = ca_sql or f"SELECT max(last_seen) AS ca FROM {source}"
    lab = N.sql_rule_protocol_label("g.proto_num")
    thr = lambda m, s: f"coalesce({m} + 2 * {s}, {m} * 3)"
    prot = rule_select({
        "rule_id": f"concat('ML_PROTOCOL_', CAST(g.proto_num AS VARCHAR), '_', {_stamp()})",
        "rule_type": f"'{K.RULE_PROTOCOL}'", "family_order": "0", "protocol": "g.proto_num",
        "protocol_name": lab, "severity": "'MEDIUM'",
        "description": f"concat('ML-generated protocol anomaly rule for ', {lab})",
        "confidence": str(K.PROTOCOL_RULE_CONFIDENCE), "created_at": "@p.ca",
        "packets_threshold": thr("g.pm", "g.ps"), "bytes_threshold": thr("g.bm", "g.bs"),
        "unique_ports_threshold": "floor(g.d_port * 1.5)", "unique_src_ips_threshold": "floor(g.d_src * 1.5)",
        "unique_dst_ips_threshold": "floor(g.d_dst * 1.5)",
        "avg_packets": "g.pm", "avg_bytes": "g.bm", "flow_count": "g.n"})
    port = rule_select({
        "rule_id": f"concat('ML_PORT_', CAST(g.port AS VARCHAR), '_', {_stamp()})",
        "rule_type": f"'{K.RULE_PORT}'", "family_order": "1", "port": "g.port",
        "severity": N.sql_port_severity("g.port"),
        "description": "concat('ML-generated port anomaly rule for port ', CAST(g.port AS VARCHAR))",
        "confidence": str(K.PORT_RULE_CONFIDENCE), "created_at": "@p.ca",
        "packets_threshold": thr("g.pm", "g.ps"), "bytes_threshold": thr("g.bm", "g.bs"),
        "unique_src_ips_threshold": "floor(g.d_src * 1.5)", "unique_dst_ips_threshold": "floor(g.d_dst * 1.5)",
        "protocols_threshold": "floor(g.d_proto * 1.5)",
        "avg_packets": "g.pm", "avg_bytes": "g.bm", "flow_count": "g.n"})
    hh = "lpad(CAST(g.hr AS VARCHAR), 2, '0')"
    temp = rule_select({
        "rule_id": f"concat('ML_TEMPORAL_', {hh}, '_', {_stamp()})",
        "rule_type": f"'{K.RULE_TEMPORAL}'", "family_order": "2", "hour": "g.hr", "severity": "'LOW'",
        "description": f"concat('ML-generated temporal anomaly rule for hour ', {hh}, ':00')",
        "confidence": str(K.TEMPORAL_RULE_CONFIDENCE), "created_at": "@p.ca",
        "packets_threshold": "g.pm * CAST(1.5 AS DOUBLE)", "bytes_threshold": "g.bm * CAST(1.5 AS DOUBLE)",
        "unique_src_ips_threshold": "floor(g.d_src * 1.3)", "unique_dst_ips_threshold": "floor(g.d_dst * 1.3)",
        "avg_packets": "g.pm", "avg_bytes": "g.bm", "flow_count": "g.n"})
    beh = rule_select({
        "rule_id": f"concat('ML_BEHAVIOR_', replace(s.src_ip, '.', '_'), '_', {_stamp()})",
        "rule_type": f"'{K.RULE_BEHAVIORAL}'", "family_order": "3", "src_ip": "s.src_ip", "severity": "'HIGH'",
        "description": "concat('ML-generated behavioral anomaly rule for source IP ', s.src_ip)",
        "confidence": str(K.BEHAVIORAL_RULE_CONFIDENCE), "created_at": "@p.ca",
        "total_packets_threshold": "s.p_sum * CAST(0.8 AS DOUBLE)",
        "avg_packets_per_flow_threshold": "s.p_mean * CAST(1.2 AS DOUBLE)",
        "unique_destinations_threshold": "floor(s.d_dst * 0.8)", "unique_ports_threshold": "floor(s.d_port * 0.8)",
        "unique_protocols_threshold": "floor(s.d_proto * 0.8)",
        "total_packets": "s.p_sum", "avg_packets_per_flow": "s.p_mean", "unique_destinations": "s.d_dst",
        "unique_ports": "s.d_port", "unique_protocols": "s.d_proto", "flow_count": "s.n"})
    ms = lambda c, a: f"round(avg({c}), 2) AS {a}m, round(stddev_samp({c}), 2) AS {a}s"
    out = [
        f"@p AS ({ca})",
        (f"@rules_protocol AS (SELECT {prot} FROM (SELECT proto_num, {ms('packets', 'p')}, count(packets) AS n, "
         f"{ms('bytes', 'b')}, count(DISTINCT port) AS d_port, count(DISTINCT src_ip) AS d_src, "
         f"count(DISTINCT dst_ip) AS d_dst FROM {source} WHERE proto_num IS NOT NULL GROUP BY proto_num) g, @p)"),
        (f"@rules_port AS (SELECT {port} FROM (SELECT port, {ms('packets', 'p')}, count(packets) AS n, "
         f"{ms('bytes', 'b')}, count(DISTINCT src_ip) AS d_src, count(DISTINCT dst_ip) AS d_dst, "
         f"count(DISTINCT proto_num) AS d_proto FROM {source} WHERE port IS NOT NULL GROUP BY port "
         f"HAVING count(packets) > {K.PORT_RULE_MIN_FLOWS}) g, @p)"),
        (f"@rules_temporal AS (SELECT {temp} FROM (SELECT hour(last_seen) AS hr, round(avg(packets), 2) AS pm, "
         f"count(packets) AS n, round(avg(bytes), 2) AS bm, count(DISTINCT src_ip) AS d_src, "
         f"count(DISTINCT dst_ip) AS d_dst FROM {source} WHERE last_seen IS NOT NULL GROUP BY hour(last_seen)) g, @p)"),
        (f"@src_stats AS (SELECT src_ip, CAST(sum(packets) AS BIGINT) AS p_sum, round(avg(packets), 2) AS p_mean, "
         f"count(packets) AS n, count(DISTINCT dst_ip) AS d_dst, count(DISTINCT port) AS d_port, "
         f"count(DISTINCT proto_num) AS d_proto FROM {source} WHERE src_ip IS NOT NULL GROUP BY src_ip)"),
        (f"@src_q AS (SELECT quantile_cont(p_sum, {K.BEHAVIORAL_QUANTILE}) AS q1, "
         f"quantile_cont(d_dst, {K.BEHAVIORAL_QUANTILE}) AS q2, "
         f"quantile_cont(d_port, {K.BEHAVIORAL_QUANTILE}) AS q3 FROM @src_stats)"),
        (f"@rules_behavioral AS (SELECT {beh} FROM @src_stats s, @src_q q, @p "
         f"WHERE s.p_sum > q.q1 OR s.d_dst > q.q2 OR s.d_port > q.q3)"),
        ("@rules_all AS (SELECT * FROM @rules_protocol UNION ALL SELECT * FROM @rules_port "
         "UNION ALL SELECT * FROM @rules_temporal UNION ALL SELECT * FROM @rules_behavioral)"),
    ]
    return [c.replace("@", prefix) for c in out]


def triggered_cte(flows: str = "flows", rules: str = "rules_all", name: str = "triggered") -> str:
    sel = (f"f.flow_id, r.rule_id, r.rule_type, r.severity, r.description, r.confidence, r.created_at, "
           f"r.family_order, r.protocol AS r_protocol, r.port AS r_port, r.hour AS r_hour, r.src_ip AS r_src_ip")
    parts = [
        f"SELECT {sel} FROM {flows} f JOIN {rules} r ON r.rule_type = '{K.RULE_PROTOCOL}' "
        f"AND f.proto_num = r.protocol AND f.packets > r.packets_threshold",
        f"SELECT {sel} FROM {flows} f JOIN {rules} r ON r.rule_type = '{K.RULE_PORT}' "
        f"AND f.port = r.port AND f.packets > r.packets_threshold",
        f"SELECT {sel} FROM {flows} f JOIN {rules} r ON r.rule_type = '{K.RULE_TEMPORAL}' "
        f"AND hour(f.last_seen) = r.hour AND f.packets > r.packets_threshold",
        f"SELECT {sel} FROM {flows} f JOIN {rules} r ON r.rule_type = '{K.RULE_BEHAVIORAL}' "
        f"AND f.src_ip = r.src_ip AND f.packets > r.avg_packets_per_flow_threshold",
    ]
    return f"{name} AS (" + " UNION ALL ".join(parts) + ")"


TRIGGER_ORDER = ("created_at, family_order, r_protocol NULLS FIRST, r_port NULLS FIRST, "
                 "r_hour NULLS FIRST, r_src_ip NULLS FIRST, rule_id")


def by_flow_cte(triggered: str = "triggered", name: str = "by_flow") -> str:
    return (f"{name} AS (SELECT flow_id, count(*) AS ml_rule_count, "
            f"string_agg('{K.ML_REASON_PREFIX}' || description, '{K.REASON_SEPARATOR}' ORDER BY {TRIGGER_ORDER}) "
            f"AS ml_reasons, string_agg(rule_id, ';' ORDER BY {TRIGGER_ORDER}) AS ml_rule_ids "
            f"FROM {triggered} GROUP BY flow_id)")


# --- detection and alerts ---------------------------------------------------------

def suspicious_ctes(use_policy: bool, use_rules: bool, src: str = "enriched") -> list[str]:
    """CTEs ``susp`` (one row per suspicious flow) over ``src``; expects the
    enriched/rules/triggered/by_flow CTEs when ``use_rules``."""
    out = []
    if use_policy:
        out.append(policy_cte())
        out.append(f"pol AS (SELECT e.*, pl.p_text AS policy_reason FROM {src} e LEFT JOIN policy pl "
                   f"ON e.proto_num = pl.p_proto AND e.port = pl.p_port AND NOT ends_with(pl.p_text, 'Normal'))")
        arr = (f"list_concat(CASE WHEN e.policy_reason IS NULL THEN CAST([] AS VARCHAR[]) "
               f"ELSE [e.policy_reason] END, {static_reasons_expr('e')})")
        out.append(f"st AS (SELECT e.*, {arr} AS st_arr FROM pol e)")
    else:
        out.append(f"st AS (SELECT e.*, {static_reasons_expr('e')} AS st_arr FROM {src} e)")
    sep = K.REASON_SEPARATOR
    if use_rules:
        reason = (f"CASE WHEN len(s.st_arr) = 0 THEN b.ml_reasons WHEN b.ml_reasons IS NULL "
                  f"THEN array_to_string(s.st_arr, '{sep}') "
                  f"ELSE array_to_string(s.st_arr, '{sep}') || '{sep}' || b.ml_reasons END")
        out.append(f"susp AS (SELECT s.*, {reason} AS suspicion_reason, "
                   f"CAST(coalesce(b.ml_rule_count, 0) AS INTEGER) AS ml_rule_count "
                   f"FROM st s LEFT JOIN by_flow b ON s.flow_id = b.flow_id "
                   f"WHERE len(s.st_arr) > 0 OR b.flow_id IS NOT NULL)")
    else:
        out.append(f"susp AS (SELECT s.*, array_to_string(s.st_arr, '{sep}') AS suspicion_reason, "
                   f"CAST(0 AS INTEGER) AS ml_rule_count FROM st s WHERE len(s.st_arr) > 0)")
    return out


def alerts_cte(src: str = "susp", ca: str = "(SELECT ca FROM p)") -> str:
    t = S.sql_score_tenths("a.suspicion_reason", "a.protocol", "a.direction", "a.country", "a.port")
    return (f"alerts AS (SELECT {S.sql_alert_id('a.last_seen', 'a.flow_id')} AS alert_id, "
            f"a.last_seen AS timestamp, a.src_ip, a.dst_ip, a.protocol, CAST(a.packets AS BIGINT) AS packets, "
            f"CAST(a.bytes AS BIGINT) AS bytes, {S.sql_threat_type('a.suspicion_reason', 'a.port')} AS threat_type, "
            f"round(({t}) / CAST(10.0 AS DOUBLE), 3) AS anomaly_score, {S.sql_severity_from_tenths(t)} AS severity, "
            f"a.suspicion_reason, a.direction, a.country, CAST(a.port AS INTEGER) AS port, "
            f"CAST(a.proto_num AS INTEGER) AS proto_num, {ca} AS created_at FROM {src} a)")


def alert_pipeline_sql(select: str, use_rules: bool = True, extra: list[str] | None = None) -> str:
    ctes = [flows_cte(), geoip_cte(), enriched_cte()]
    if use_rules:
        ctes += rules_ctes() + [triggered_cte(), by_flow_cte()]
    else:
        ctes.append("p AS (SELECT max(last_seen) AS ca FROM flows)")
    ctes += suspicious_ctes(True, use_rules) + [alerts_cte()] + (extra or [])
    return "WITH " + ",\n".join(ctes) + "\n" + select
