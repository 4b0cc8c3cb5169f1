"""Registered queries: one Spark callable and (where SQL can express it) one
DuckDB oracle statement per operator of the inventory.

Every query reads the supplied tables at ``sf_dir`` (whole tables) and runs
the library's own operators on them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.operators import enrich, reports
from netweave.plans import oracle_sql as O
from netweave.session import split_large_stages
from netweave.sources import fixtures as X

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        @wraps(fn)
        def query(spark, sf):
            split_large_stages(spark)  # whatever session runs it
            return fn(spark, sf)

        QUERIES[name] = query
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


# --- shared inputs ---------------------------------------------------------------

def flows(spark: SparkSession, sf: str) -> DataFrame:
    return X.flows(spark, sf)


def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return enrich.enrich_flows(X.flows(spark, sf), X.geoip(spark, sf))


ENRICHED_COLS = ("flow_id, src_ip, dst_ip, proto_num, src_port, dst_port, port, packets, bytes, "
                 "first_seen, last_seen, protocol_name, protocol, is_internal_src, is_internal_dst, "
                 "direction, country")


# --- enrichment --------------------------------------------------------------------

@register("flows_enriched", O.with_enriched() + f"SELECT {ENRICHED_COLS} FROM enriched")
def q_flows_enriched(spark, sf):
    return enriched(spark, sf).selectExpr(*[c.strip() for c in ENRICHED_COLS.split(",")])


@register("geo_country", O.with_enriched() + "SELECT flow_id, dst_ip, country FROM enriched")
def q_geo_country(spark, sf):
    return enriched(spark, sf).select("flow_id", "dst_ip", "country")


# --- reports -------------------------------------------------------------------------

_SRC_STATS_SQL = ("SELECT src_ip, CAST(sum(bytes) AS BIGINT) AS total_bytes, "
                  "CAST(sum(packets) AS BIGINT) AS total_packets, "
                  "count(DISTINCT dst_ip) AS distinct_destinations FROM enriched "
                  "WHERE src_ip IS NOT NULL GROUP BY src_ip")


@register("source_ip_stats", O.with_enriched() + _SRC_STATS_SQL)
def q_source_ip_stats(spark, sf):
    return reports.source_ip_stats(enriched(spark, sf))


def _top_sql(metric: str, n: int = 10) -> str:
    return (O.with_enriched(f"s AS ({_SRC_STATS_SQL})")
            + f"SELECT * FROM s ORDER BY {metric} DESC, src_ip ASC LIMIT {n}")


@register("top_ips_by_bytes", _top_sql("total_bytes"))
def q_top_ips_by_bytes(spark, sf):
    return reports.top_source_ips(enriched(spark, sf), "bytes", 10)


@register("top_ips_by_packets", _top_sql("total_packets"))
def q_top_ips_by_packets(spark, sf):
    return reports.top_source_ips(enriched(spark, sf), "packets", 10)


@register("top_ips_by_destinations", _top_sql("distinct_destinations"))
def q_top_ips_by_destinations(spark, sf):
    return reports.top_source_ips(enriched(spark, sf), "destinations", 10)


# --- generated rules -------------------------------------------------------------

from netweave.operators import rules as R  # noqa: E402
from netweave.functions import net as NF  # noqa: E402
from netweave.session import kept, materialize  # noqa: E402


def as_of(df: DataFrame, col: str = "last_seen"):
    """Reference instant of a data set: its newest ``col`` value (a scalar)."""
    return df.agg(F.max(col)).first()[0]


def all_rules(spark, sf):
    return R.generate_rules(flows(spark, sf))


def _rules_sql(select: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([O.flows_cte()] + O.rules_ctes() + (extra or [])) + "\n" + select


@register("rules_protocol", _rules_sql("SELECT * FROM rules_protocol"))
def q_rules_protocol(spark, sf):
    fl = flows(spark, sf)
    return R.protocol_rules(fl, as_of(fl))


@register("rules_port", _rules_sql("SELECT * FROM rules_port"))
def q_rules_port(spark, sf):
    fl = flows(spark, sf)
    return R.port_rules(fl, as_of(fl))


@register("rules_temporal", _rules_sql("SELECT * FROM rules_temporal"))
def q_rules_temporal(spark, sf):
    fl = flows(spark, sf)
    return R.temporal_rules(fl, as_of(fl))


@register("rules_behavioral", _rules_sql("SELECT * FROM rules_behavioral"))
def q_rules_behavioral(spark, sf):
    fl = flows(spark, sf)
    return R.behavioral_rules(fl, as_of(fl))


@register("rules_all", _rules_sql("SELECT * FROM rules_all"))
def q_rules_all(spark, sf):
    return all_rules(spark, sf)


@register("rules_by_type", _rules_sql(f"SELECT * FROM rules_all WHERE rule_type = '{R.K.RULE_PORT}'"))
def q_rules_by_type(spark, sf):
    """Rules of one type read back from the rule store (one generation run)."""
    from netweave.session import scratch_path
    from netweave.sources import rulestore as RS
    path = scratch_path(spark, "rule_store")
    RS.append_rules(all_rules(spark, sf), path)
    return RS.read_rules(spark, path, R.K.RULE_PORT)


@register("rule_generation_summary", _rules_sql(
    "SELECT f.metric, coalesce(c.n, 0) AS value FROM (VALUES ('protocol_rules', 'protocol_anomaly'), "
    "('port_rules', 'port_anomaly'), ('temporal_rules', 'temporal_anomaly'), "
    "('behavioral_rules', 'behavioral_anomaly')) f(metric, rule_type) LEFT JOIN "
    "(SELECT rule_type, count(*) AS n FROM rules_all GROUP BY rule_type) c USING (rule_type) "
    "UNION ALL SELECT 'total_rules', count(*) FROM rules_all"))
def q_rule_generation_summary(spark, sf):
    return R.rule_generation_summary(all_rules(spark, sf))


@register("rule_statistics", _rules_sql(
    "SELECT 'total_rules' AS metric, '' AS key, CAST(count(*) AS DOUBLE) AS value FROM rules_all "
    "UNION ALL SELECT 'rule_types', rule_type, CAST(count(*) AS DOUBLE) FROM rules_all GROUP BY rule_type "
    "UNION ALL SELECT 'severity_distribution', severity, CAST(count(*) AS DOUBLE) FROM rules_all GROUP BY severity "
    "UNION ALL SELECT 'avg_confidence', '', round(coalesce(sum(confidence) / count(*), 0.0), 10) FROM rules_all "
    "UNION ALL SELECT 'rule_breakdown', f.rule_type, CAST(coalesce(c.n, 0) AS DOUBLE) FROM "
    "(VALUES ('protocol_anomaly'), ('port_anomaly'), ('temporal_anomaly'), ('behavioral_anomaly')) f(rule_type) "
    "LEFT JOIN (SELECT rule_type, count(*) AS n FROM rules_all GROUP BY rule_type) c USING (rule_type)"))
def q_rule_statistics(spark, sf):
    return R.rule_statistics(all_rules(spark, sf))


@register("rules_triggered", _rules_sql(
    "SELECT flow_id, rule_id, rule_type, severity, description, confidence FROM triggered",
    [O.triggered_cte()]))
def q_rules_triggered(spark, sf):
    fl = flows(spark, sf)
    return R.apply_rules(fl, R.generate_rules(fl)).select("flow_id", "rule_id", "rule_type", "severity",
                                           "description", "confidence")


@register("rules_triggered_by_flow", _rules_sql(
    "SELECT * FROM by_flow", [O.triggered_cte(), O.by_flow_cte()]))
def q_rules_triggered_by_flow(spark, sf):
    fl = flows(spark, sf)
    return R.triggered_rules_by_flow(fl, R.generate_rules(fl)).select(
        "flow_id", "ml_rule_count", "ml_reasons", "ml_rule_ids")


@register("rule_protocol_label", "WITH " + O.flows_cte() + " SELECT DISTINCT proto_num, "
          + NF.sql_rule_protocol_label("proto_num") + " AS rule_protocol_label FROM flows")
def q_rule_protocol_label(spark, sf):
    return flows(spark, sf).select("proto_num", NF.rule_protocol_label("proto_num").alias(
        "rule_protocol_label")).distinct()


@register("port_severity", "WITH " + O.flows_cte() + " SELECT DISTINCT port, "
          + NF.sql_port_severity("port") + " AS port_severity FROM flows")
def q_port_severity(spark, sf):
    return flows(spark, sf).select("port", NF.port_severity("port").alias("port_severity")).distinct()


# --- detection ------------------------------------------------------------------------

from netweave.operators import alerts as AL  # noqa: E402
from netweave.operators import detect as DT  # noqa: E402
from netweave.plans import pipelines as P  # noqa: E402


def _susp_sql(select: str, use_policy: bool, use_rules: bool) -> str:
    ctes = [O.flows_cte(), O.geoip_cte(), O.enriched_cte()]
    if use_rules:
        ctes += O.rules_ctes() + [O.triggered_cte(), O.by_flow_cte()]
    return "WITH " + ",\n".join(ctes + O.suspicious_ctes(use_policy, use_rules)) + "\n" + select


@register("suspicious_static", _susp_sql(
    "SELECT flow_id, src_ip, dst_ip, proto_num, port, packets, bytes, suspicion_reason FROM susp", False, False))
def q_suspicious_static(spark, sf):
    return DT.static_suspicious(enriched(spark, sf)).select(
        "flow_id", "src_ip", "dst_ip", "proto_num", "port", "packets", "bytes", "suspicion_reason")


@register("proto_port_policy", O.with_enriched(O.policy_cte()) +
          "SELECT e.flow_id, e.proto_num, e.port, p.p_text AS policy_reason FROM enriched e "
          "JOIN policy p ON e.proto_num = p.p_proto AND e.port = p.p_port WHERE NOT ends_with(p.p_text, 'Normal')")
def q_proto_port_policy(spark, sf):
    return (DT.with_policy(enriched(spark, sf)).where(F.col("policy_reason").isNotNull())
            .select("flow_id", "proto_num", "port", "policy_reason"))


_SUSP_OUT = ("flow_id, src_ip, dst_ip, protocol, port, proto_num, packets, bytes, timestamp, "
             "suspicion_reason, direction, country, ml_rule_count")


@register("suspicious_flows", _susp_sql(
    "SELECT " + _SUSP_OUT.replace("timestamp", "last_seen AS timestamp") + " FROM susp", False, True))
def q_suspicious_flows(spark, sf):
    fl = flows(spark, sf)
    rules = P.generated_rules(fl)
    return P.suspicious_flows(fl, X.geoip(spark, sf), rules).selectExpr(
        *[c.strip() for c in _SUSP_OUT.split(",")])


def alerts_table(spark, sf, use_rules: bool = True) -> DataFrame:
    return P.structured_alerts(flows(spark, sf), X.geoip(spark, sf), use_rules=use_rules)


@register("structured_alerts", O.alert_pipeline_sql("SELECT * FROM alerts"))
def q_structured_alerts(spark, sf):
    return alerts_table(spark, sf)


@register("alert_score", O.alert_pipeline_sql("SELECT alert_id, anomaly_score FROM alerts", use_rules=False))
def q_alert_score(spark, sf):
    return alerts_table(spark, sf, use_rules=False).select("alert_id", "anomaly_score")


@register("alert_threat_type", O.alert_pipeline_sql("SELECT alert_id, threat_type FROM alerts", use_rules=False))
def q_alert_threat_type(spark, sf):
    return alerts_table(spark, sf, use_rules=False).select("alert_id", "threat_type")


@register("alert_severity", O.alert_pipeline_sql(
    "SELECT alert_id, anomaly_score, severity FROM alerts", use_rules=False))
def q_alert_severity(spark, sf):
    return alerts_table(spark, sf, use_rules=False).select("alert_id", "anomaly_score", "severity")


@register("alert_identity", O.alert_pipeline_sql(
    "SELECT alert_id, timestamp, src_ip, dst_ip FROM alerts", use_rules=False))
def q_alert_identity(spark, sf):
    return alerts_table(spark, sf, use_rules=False).select("alert_id", "timestamp", "src_ip", "dst_ip")


# --- alert filters, search, statistics, listings -----------------------------------------

_ALERT_COLS = ", ".join(AL.ALERT_COLUMNS)


def _newest_sql(where: str, limit: int, by: str = "timestamp") -> str:
    return O.alert_pipeline_sql(f"SELECT {_ALERT_COLS} FROM alerts WHERE {where} "
                                f"ORDER BY {by} DESC, alert_id ASC LIMIT {limit}")


@register("alerts_by_severity", _newest_sql("severity = 'HIGH'", 50))
def q_alerts_by_severity(spark, sf):
    return AL.alerts_by_severity(alerts_table(spark, sf), "high", 50)


@register("alerts_by_threat_type", _newest_sql("threat_type = 'DNS Tunneling'", 100))
def q_alerts_by_threat_type(spark, sf):
    return AL.alerts_by_threat_type(alerts_table(spark, sf), "DNS Tunneling", 100)


@register("alerts_by_protocol", _newest_sql("protocol = 'UDP'", 100))
def q_alerts_by_protocol(spark, sf):
    return AL.alerts_by_protocol(alerts_table(spark, sf), "udp", 100)


@register("alerts_by_ip", _newest_sql("src_ip = '192.168.0.16' OR dst_ip = '192.168.0.16'", 100))
def q_alerts_by_ip(spark, sf):
    return AL.alerts_by_ip(alerts_table(spark, sf), "192.168.0.16", 100)


@register("alerts_by_date_range", _newest_sql(
    "timestamp BETWEEN TIMESTAMP '1995-03-01 00:00:00' AND TIMESTAMP '1995-03-31 23:59:59'", 100))
def q_alerts_by_date_range(spark, sf):
    return AL.alerts_by_date_range(alerts_table(spark, sf), "1995-03-01 00:00:00", "1995-03-31 23:59:59", 100)


_SEARCH_BLOB = "lower(concat_ws(' ', " + ", ".join(f"coalesce(CAST({c} AS VARCHAR), '')"
                                                    for c in R.K.SEARCH_FIELDS) + "))"


@register("alerts_search", _newest_sql(
    f"contains({_SEARCH_BLOB}, 'rdp') AND contains(lower(src_ip), '192.168') "
    "AND anomaly_score >= 0.6 AND anomaly_score <= 1.0", 100))
def q_alerts_search(spark, sf):
    return AL.search_alerts(alerts_table(spark, sf), text="RDP", src_ip="192.168",
                            min_score=0.6, max_score=1.0, limit=100)


@register("alerts_last_24h", O.alert_pipeline_sql(
    f"SELECT {_ALERT_COLS} FROM alerts WHERE timestamp >= (SELECT max(timestamp) FROM alerts) - INTERVAL 24 HOUR "
    "AND timestamp <= (SELECT max(timestamp) FROM alerts) ORDER BY timestamp DESC, alert_id ASC LIMIT 100"))
def q_alerts_last_24h(spark, sf):
    al = alerts_table(spark, sf)
    return AL.alerts_last_hours(al, as_of(al, "timestamp"), 24, 100)


@register("alert_statistics", O.alert_pipeline_sql(
    "SELECT 'total_alerts' AS metric, '' AS key, count(*) AS value FROM alerts "
    "UNION ALL SELECT 'recent_alerts_24h', '', count(*) FILTER (WHERE created_at >= "
    "(SELECT max(last_seen) FROM flows) - INTERVAL 24 HOUR) FROM alerts "
    "UNION ALL SELECT 'severity_distribution', severity, count(*) FROM alerts GROUP BY severity "
    "UNION ALL SELECT 'threat_type_distribution', threat_type, count(*) FROM alerts GROUP BY threat_type"))
def q_alert_statistics(spark, sf):
    return AL.alert_statistics(alerts_table(spark, sf), as_of(flows(spark, sf)), 24)


@register("alerts_latest", _newest_sql("true", 100, by="created_at"))
def q_alerts_latest(spark, sf):
    return AL.latest_alerts(alerts_table(spark, sf), 100)


# --- packets ---------------------------------------------------------------------------

from netweave.operators import packets as PK  # noqa: E402


def packets(spark, sf):
    return X.packets(spark, sf)


def _pk_sql(select: str, extra: list[str] | None = None) -> str:
    return "WITH " + ",\n".join([O.packets_cte()] + (extra or [])) + "\n" + select


_PFLOWS_CTE = (
    "pflows AS (SELECT concat_ws('|', g.src_ip, g.dst_ip, CAST(g.proto_num AS VARCHAR)) AS flow_id, "
    "g.src_ip, g.dst_ip, g.proto_num, l.src_port, l.dst_port, "
    "CASE WHEN l.dst_port > 0 THEN l.dst_port ELSE l.src_port END AS port, g.packets, g.bytes, "
    "g.first_seen, g.last_seen FROM (SELECT src_ip, dst_ip, proto_num, count(*) AS packets, "
    "CAST(sum(length) AS BIGINT) AS bytes, min(ts) AS first_seen, max(ts) AS last_seen FROM packets "
    "GROUP BY src_ip, dst_ip, proto_num) g JOIN (SELECT src_ip, dst_ip, proto_num, src_port, dst_port, "
    "row_number() OVER (PARTITION BY src_ip, dst_ip, proto_num ORDER BY ts DESC, packet_id DESC) AS rn "
    "FROM packets) l ON g.src_ip = l.src_ip AND g.dst_ip = l.dst_ip AND g.proto_num = l.proto_num AND l.rn = 1)")


@register("packets_scan", _pk_sql("SELECT * FROM packets"))
def q_packets_scan(spark, sf):
    return packets(spark, sf)


@register("packets_captured", _pk_sql("SELECT * FROM packets"))
def q_packets_captured(spark, sf):
    """All packets written as a capture and read back through the data source."""
    from netweave.session import scratch_path
    from netweave.sources import capture
    path = scratch_path(spark, "capture")
    capture.write_capture(packets(spark, sf), path)
    return capture.read_capture(spark, path)


@register("packets_from_messages", _pk_sql("SELECT * FROM packets"))
def q_packets_from_messages(spark, sf):
    """All packets as message-log rows, each delivered twice, decoded once."""
    from netweave.sources import capture
    messages = capture.message_of(packets(spark, sf), "packets")
    decoded = capture.once(capture.decode_messages(messages.unionByName(messages)))
    return decoded.where("malformed IS NULL").select(*capture.COLUMNS)


@register("heavy_hitters_daily", _pk_sql(
    "SELECT window_start, window_start + INTERVAL 1 DAY AS window_end, value, packets, share FROM ("
    "SELECT date_trunc('day', ts) AS window_start, src_ip AS value, count(*) AS packets, "
    "CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY date_trunc('day', ts)) AS share "
    "FROM packets WHERE src_ip IS NOT NULL AND ts IS NOT NULL GROUP BY 1, 2) WHERE share >= 0.01"))
def q_heavy_hitters_daily(spark, sf):
    """Sources of at least a hundredth of a day's packets, from sketches and an exact recount."""
    from netweave.operators import heavy
    return heavy.heavy_hitters(packets(spark, sf), "src_ip", 0.01)


@register("flows_from_packets", _pk_sql("SELECT * FROM pflows", [_PFLOWS_CTE]))
def q_flows_from_packets(spark, sf):
    return PK.flows_from_packets(packets(spark, sf))


_DUR = "(CAST(epoch_us(t1) - epoch_us(t0) AS DOUBLE) / 1e6)"


def _rate_sql(num: str, den: str) -> str:
    return f"CASE WHEN {den} > 0 THEN CAST({num} AS DOUBLE) / {den} ELSE 0.0 END"


@register("flow_stats_unidirectional", _pk_sql(
    f"SELECT src_ip, dst_ip, proto_num, {_DUR} AS flow_duration, n AS total_fwd_packets, "
    f"CAST(0 AS BIGINT) AS total_backward_packets, nbytes AS total_length_fwd_packets, "
    f"CAST(0 AS BIGINT) AS total_length_bwd_packets, {_rate_sql('nbytes', 'CAST(n AS DOUBLE)')} AS fwd_packet_length_mean, "
    f"0.0 AS bwd_packet_length_mean, {_rate_sql('nbytes', _DUR)} AS flow_bytes_per_s, "
    f"{_rate_sql('n', _DUR)} AS flow_packets_per_s, {_DUR} AS fwd_iat_total, 0.0 AS bwd_iat_total, "
    f"t0 AS first_seen, t1 AS last_seen FROM (SELECT src_ip, dst_ip, proto_num, count(*) AS n, "
    f"CAST(sum(length) AS BIGINT) AS nbytes, min(ts) AS t0, max(ts) AS t1 FROM packets GROUP BY ALL)"))
def q_flow_stats_unidirectional(spark, sf):
    return PK.flow_statistics(packets(spark, sf), bidirectional=False)


def _bidir_sql() -> str:
    d = lambda a, b: f"coalesce(CAST(epoch_us({b}) - epoch_us({a}) AS DOUBLE) / 1e6, 0.0)"
    pick = lambda x, y: f"CASE WHEN fa THEN {x} ELSE {y} END"
    nf, nb = pick("n_a", "n_b"), pick("n_b", "n_a")
    bf, bb = pick("by_a", "by_b"), pick("by_b", "by_a")
    return _pk_sql(
        f"SELECT {pick('lo', 'hi')} AS src_ip, {pick('hi', 'lo')} AS dst_ip, proto_num, {_DUR} AS flow_duration, "
        f"{nf} AS total_fwd_packets, {nb} AS total_backward_packets, {bf} AS total_length_fwd_packets, "
        f"{bb} AS total_length_bwd_packets, {_rate_sql(bf, f'CAST({nf} AS DOUBLE)')} AS fwd_packet_length_mean, "
        f"{_rate_sql(bb, f'CAST({nb} AS DOUBLE)')} AS bwd_packet_length_mean, "
        f"{_rate_sql(f'({bf}) + ({bb})', _DUR)} AS flow_bytes_per_s, "
        f"{_rate_sql(f'({nf}) + ({nb})', _DUR)} AS flow_packets_per_s, "
        f"{d(pick('t0_a', 't0_b'), pick('t1_a', 't1_b'))} AS fwd_iat_total, "
        f"{d(pick('t0_b', 't0_a'), pick('t1_b', 't1_a'))} AS bwd_iat_total, t0 AS first_seen, t1 AS last_seen "
        "FROM (SELECT lo, hi, proto_num, first(a ORDER BY ts, packet_id) AS fa, count(*) FILTER (WHERE a) AS n_a, "
        "count(*) FILTER (WHERE NOT a) AS n_b, CAST(coalesce(sum(length) FILTER (WHERE a), 0) AS BIGINT) AS by_a, "
        "CAST(coalesce(sum(length) FILTER (WHERE NOT a), 0) AS BIGINT) AS by_b, min(ts) FILTER (WHERE a) AS t0_a, "
        "max(ts) FILTER (WHERE a) AS t1_a, min(ts) FILTER (WHERE NOT a) AS t0_b, max(ts) FILTER (WHERE NOT a) AS t1_b, "
        "min(ts) AS t0, max(ts) AS t1 FROM (SELECT *, src_ip = least(src_ip, dst_ip) AS a, "
        "least(src_ip, dst_ip) AS lo, greatest(src_ip, dst_ip) AS hi FROM packets) GROUP BY lo, hi, proto_num)")


@register("flow_stats_bidirectional", _bidir_sql())
def q_flow_stats_bidirectional(spark, sf):
    return PK.flow_statistics(packets(spark, sf), bidirectional=True)


_RUN_W = "OVER (PARTITION BY src_ip, dst_ip, proto_num ORDER BY ts, packet_id ROWS UNBOUNDED PRECEDING)"


@register("flow_running_features", _pk_sql(
    "SELECT packet_id, ts, src_ip, dst_ip, proto_num, d AS flow_duration, n AS total_fwd_packets, "
    "CAST(0 AS BIGINT) AS total_backward_packets, nbytes AS total_length_fwd_packets, "
    "CAST(0 AS BIGINT) AS total_length_bwd_packets, CAST(nbytes AS DOUBLE) / n AS fwd_packet_length_mean, "
    f"0.0 AS bwd_packet_length_mean, {_rate_sql('nbytes', 'd')} AS flow_bytes_per_s, "
    f"{_rate_sql('n', 'd')} AS flow_packets_per_s, CASE WHEN n > 1 THEN d ELSE 0.0 END AS fwd_iat_total, "
    "0.0 AS bwd_iat_total FROM (SELECT *, CAST(epoch_us(ts) - epoch_us(t0) AS DOUBLE) / 1e6 AS d FROM "
    f"(SELECT *, count(*) {_RUN_W} AS n, CAST(sum(length) {_RUN_W} AS BIGINT) AS nbytes, "
    "min(ts) OVER (PARTITION BY src_ip, dst_ip, proto_num) AS t0 FROM packets))"))
def q_flow_running_features(spark, sf):
    return PK.running_features(packets(spark, sf))


@register("packet_rate_sliding", _pk_sql(
    "SELECT window_start, window_start + INTERVAL 10 SECOND AS window_end, count(*) AS packets, "
    "count(*) / 10.0 AS packets_per_second FROM (SELECT date_trunc('second', ts) - to_seconds(r.i) AS window_start "
    "FROM packets CROSS JOIN range(0, 10) AS r(i)) GROUP BY window_start"))
def q_packet_rate_sliding(spark, sf):
    return PK.packet_rate(packets(spark, sf), 10, 1)


@register("packet_rate_tumbling", _pk_sql(
    "SELECT window_start, window_start + INTERVAL 10 SECOND AS window_end, count(*) AS packets, "
    "count(*) / 10.0 AS packets_per_second FROM (SELECT TIMESTAMP '1970-01-01 00:00:00' + "
    "to_seconds(CAST(floor(epoch_us(ts) / 10000000) AS BIGINT) * 10) AS window_start FROM packets) GROUP BY window_start"))
def q_packet_rate_tumbling(spark, sf):
    return PK.packet_rate(packets(spark, sf), 10, None)


SESSION_GAP_SECONDS = 6 * 3600


@register("flow_sessions", _pk_sql(
    "SELECT src_ip, dst_ip, proto_num, CAST(session_no AS BIGINT) AS session_no, min(ts) AS session_start, "
    "max(ts) AS session_last, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes FROM "
    f"(SELECT *, sum(CASE WHEN prev IS NULL OR CAST(epoch_us(ts) - epoch_us(prev) AS DOUBLE) / 1e6 >= "
    f"{SESSION_GAP_SECONDS} THEN 1 ELSE 0 END) {_RUN_W} AS session_no FROM "
    "(SELECT *, lag(ts) OVER (PARTITION BY src_ip, dst_ip, proto_num ORDER BY ts, packet_id) AS prev FROM packets)) "
    "GROUP BY src_ip, dst_ip, proto_num, session_no"))
def q_flow_sessions(spark, sf):
    return PK.flow_sessions(packets(spark, sf), SESSION_GAP_SECONDS)


# evidence: flows built from packets, policy on, then the packets of suspicious flows
def _evidence_sql(select: str) -> str:
    ctes = [O.packets_cte(), _PFLOWS_CTE, O.geoip_cte(), O.enriched_cte("pflows", "enriched")]
    return "WITH " + ",\n".join(ctes + O.suspicious_ctes(True, False)) + "\n" + select


def _evidence(spark, sf):
    pk = packets(spark, sf)
    susp = P.suspicious_flows(PK.flows_from_packets(pk), X.geoip(spark, sf), None, use_policy=True)
    return DT.evidence_packets(pk, susp)


_EVIDENCE_SEMI = ("FROM packets p WHERE EXISTS (SELECT 1 FROM susp s WHERE s.src_ip = p.src_ip "
                  "AND s.dst_ip = p.dst_ip AND s.proto_num = p.proto_num)")


@register("evidence_packets", _evidence_sql(f"SELECT p.*, CAST(p.ts AS DATE) AS date {_EVIDENCE_SEMI}"))
def q_evidence_packets(spark, sf):
    from netweave.sources.io import roundtrip_parquet
    return roundtrip_parquet(_evidence(spark, sf), "evidence", partition_by=["date"])


@register("evidence_manifest", _evidence_sql(
    "SELECT src_ip, dst_ip, proto_num, count(*) AS packets, CAST(sum(length) AS BIGINT) AS bytes, "
    f"min(ts) AS first_ts, max(ts) AS last_ts FROM (SELECT p.* {_EVIDENCE_SEMI}) GROUP BY ALL"))
def q_evidence_manifest(spark, sf):
    return DT.evidence_manifest(_evidence(spark, sf))


# --- projections -------------------------------------------------------------------------

from netweave.functions import timeparts as TP  # noqa: E402
from netweave.sources import io as IO  # noqa: E402


@register("flows_conformed", "WITH " + O.flows_cte() + " SELECT flow_id, src_ip, dst_ip, '' AS protocol_name, "
          "'' AS direction, false AS is_internal_src, false AS is_internal_dst, '' AS country, bytes, packets, "
          "last_seen, first_seen, dst_port, src_port, port, proto_num, '' AS protocol FROM flows")
def q_flows_conformed(spark, sf):
    return enrich.conform_flows(flows(spark, sf)).select("flow_id", *enrich.REQUIRED_COLUMNS)


@register("primary_port", "WITH " + O.flows_cte() +
          " SELECT flow_id, src_port, dst_port, CASE WHEN dst_port > 0 THEN dst_port ELSE src_port END AS primary_port "
          "FROM flows")
def q_primary_port(spark, sf):
    return flows(spark, sf).select("flow_id", "src_port", "dst_port",
                                   NF.primary_port("dst_port", "src_port").alias("primary_port"))


_ADDR_SQL = "(SELECT src_ip AS ip FROM flows UNION SELECT dst_ip FROM flows)"


@register("ip_is_private", "WITH " + O.flows_cte() + f" SELECT ip, {NF.sql_is_private('ip')} AS is_private FROM {_ADDR_SQL}")
def q_ip_is_private(spark, sf):
    fl = flows(spark, sf)
    addrs = fl.select(F.col("src_ip").alias("ip")).union(fl.select("dst_ip")).distinct()
    return addrs.select("ip", NF.is_private_ip("ip").alias("is_private"))


@register("flow_direction", O.with_enriched() + "SELECT flow_id, src_ip, dst_ip, direction FROM enriched")
def q_flow_direction(spark, sf):
    return flows(spark, sf).select("flow_id", "src_ip", "dst_ip",
                                   NF.flow_direction("src_ip", "dst_ip").alias("direction"))


@register("protocol_name", "WITH " + O.flows_cte() +
          f" SELECT DISTINCT proto_num, {NF.sql_protocol_name('proto_num')} AS protocol_name FROM flows")
def q_protocol_name(spark, sf):
    return flows(spark, sf).select("proto_num", NF.protocol_name("proto_num").alias("protocol_name")).distinct()


@register("upload_enrichment", O.with_enriched() +
          "SELECT flow_id, src_ip, dst_ip, proto_num, protocol_name, direction, is_internal_src, is_internal_dst, "
          f"CASE WHEN is_internal_dst THEN 'Internal' ELSE 'Unknown' END AS country FROM enriched")
def q_upload_enrichment(spark, sf):
    up = flows(spark, sf).select("flow_id", "src_ip", "dst_ip", F.col("proto_num").alias("protocol"))
    return enrich.upload_enrichment(up).select("flow_id", "src_ip", "dst_ip", "proto_num", "protocol_name",
                                               "direction", "is_internal_src", "is_internal_dst", "country")


@register("flow_time_parts", "WITH " + O.flows_cte() +
          " SELECT flow_id, last_seen AS timestamp, hour(last_seen) AS hour, CAST(last_seen AS DATE) AS date, "
          "isodow(last_seen) - 1 AS day_of_week FROM flows")
def q_flow_time_parts(spark, sf):
    return enrich.with_time_parts(flows(spark, sf)).select("flow_id", "timestamp", "hour", "date", "day_of_week")


_FEAT_DUR = "(CAST(epoch_us(last_seen) - epoch_us(first_seen) AS DOUBLE) / 1e6)"


@register("flow_features", O.with_enriched() +
          f"SELECT flow_id, {_FEAT_DUR} AS flow_duration, CAST(packets AS DOUBLE) / ({_FEAT_DUR} + 1) AS packets_per_second, "
          "CAST(bytes AS DOUBLE) / (packets + 1) AS bytes_per_packet, CAST(bytes AS DOUBLE) / (packets + 1) AS packet_size_variance, "
          "proto_num AS protocol_numeric, port AS port_numeric, CAST(is_internal_src AS INTEGER) AS is_internal_src, "
          "CAST(is_internal_dst AS INTEGER) AS is_internal_dst, "
          "CAST(is_internal_src AND NOT is_internal_dst AS INTEGER) AS internal_to_external, "
          "CAST(NOT is_internal_src AND is_internal_dst AS INTEGER) AS external_to_internal, "
          "CAST(is_internal_src AND is_internal_dst AS INTEGER) AS internal_to_internal, "
          "hour(last_seen) AS hour_of_day, isodow(last_seen) - 1 AS day_of_week FROM enriched")
def q_flow_features(spark, sf):
    return enrich.flow_features(enriched(spark, sf))


LOOKBACK_HOURS = 168


@register("flows_lookback", "WITH " + O.flows_cte() +
          f" SELECT * FROM flows WHERE last_seen >= (SELECT max(last_seen) FROM flows) - INTERVAL {LOOKBACK_HOURS} HOUR")
def q_flows_lookback(spark, sf):
    fl = flows(spark, sf)
    return IO.flows_lookback(fl, LOOKBACK_HOURS, as_of(fl))


RECENT_SECONDS = 3600


@register("live_flows_recent", "WITH " + O.flows_cte() +
          f" SELECT * FROM flows WHERE last_seen >= (SELECT max(last_seen) FROM flows) - INTERVAL {RECENT_SECONDS} SECOND")
def q_live_flows_recent(spark, sf):
    fl = flows(spark, sf)
    return PK.live_flows_recent(fl, as_of(fl), RECENT_SECONDS)


# --- attack alerts (stored model verdicts) ------------------------------------------------

def attack_alerts(spark, sf):
    return X.attack_alerts_from(enriched(spark, sf))


_ATTACK_CTE = (f"attack AS (SELECT flow_id AS id, last_seen AS timestamp, src_ip, dst_ip, "
               f"{X.ATTACK_PREDICTION_SQL} AS prediction, CAST(packets % 100 AS DOUBLE) / 100 AS confidence, "
               f"direction, protocol_name, is_internal_src, is_internal_dst, country FROM enriched)")


@register("alerts_lookback", O.with_enriched(_ATTACK_CTE) +
          "SELECT timestamp, src_ip, dst_ip, protocol_name, direction, is_internal_src, is_internal_dst, country "
          f"FROM attack WHERE timestamp >= (SELECT max(last_seen) FROM flows) - INTERVAL {LOOKBACK_HOURS} HOUR")
def q_alerts_lookback(spark, sf):
    return IO.alerts_lookback(attack_alerts(spark, sf), LOOKBACK_HOURS, as_of(flows(spark, sf)))


_AS_FLOWS_PORT = "CASE protocol_name " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in R.K.ALERT_NAME_TO_PORT) + " ELSE 0 END"
_AS_FLOWS_PROTO = "CASE protocol_name " + " ".join(f"WHEN '{n}' THEN {p}" for n, p in R.K.ALERT_NAME_TO_PROTO) + " ELSE 0 END"
_AS_FLOWS_SQL = ("SELECT timestamp, src_ip, dst_ip, protocol_name, direction, is_internal_src, is_internal_dst, country, "
                 "hour(timestamp) AS hour, CAST(timestamp AS DATE) AS date, CAST(NULL AS BIGINT) AS bytes, "
                 f"CAST(NULL AS BIGINT) AS packets, {_AS_FLOWS_PORT} AS dst_port, CAST(NULL AS INTEGER) AS src_port, "
                 f"{_AS_FLOWS_PORT} AS port, {_AS_FLOWS_PROTO} AS proto_num, protocol_name AS protocol, "
                 "timestamp AS last_seen FROM attack")


@register("alerts_as_flows", O.with_enriched(_ATTACK_CTE) + _AS_FLOWS_SQL)
def q_alerts_as_flows(spark, sf):
    return IO.alerts_as_flows(attack_alerts(spark, sf))


@register("flow_source_fallback", O.with_enriched() +
          "SELECT last_seen AS timestamp, src_ip, dst_ip, protocol_name, direction, is_internal_src, is_internal_dst, country, "
          "hour(last_seen) AS hour, CAST(last_seen AS DATE) AS date, bytes, packets, dst_port, src_port, port, proto_num, "
          "protocol, last_seen FROM enriched WHERE last_seen >= (SELECT max(last_seen) FROM flows) - INTERVAL 24 HOUR")
def q_flow_source_fallback(spark, sf):
    recent = IO.flows_lookback(enriched(spark, sf), 24, as_of(flows(spark, sf)))
    return IO.choose_source(recent, attack_alerts(spark, sf))


@register("flow_source_alerts", O.with_enriched(_ATTACK_CTE) + _AS_FLOWS_SQL)
def q_flow_source_alerts(spark, sf):
    """No flow was seen in the day after the newest one: alerts stand in."""
    import datetime as dt
    recent = IO.flows_lookback(enriched(spark, sf), 24, as_of(flows(spark, sf)) + dt.timedelta(days=2))
    return IO.choose_source(recent, attack_alerts(spark, sf))


@register("attack_alerts_latest", O.with_enriched(_ATTACK_CTE) +
          "SELECT * FROM attack ORDER BY timestamp DESC, id ASC LIMIT 100")
def q_attack_alerts_latest(spark, sf):
    return AL.latest_attack_alerts(attack_alerts(spark, sf), 100)


@register("attack_alerts_append", O.with_enriched(_ATTACK_CTE) + "SELECT *, CAST(timestamp AS DATE) AS date FROM attack")
def q_attack_alerts_append(spark, sf):
    from netweave.session import scratch_path
    path = scratch_path(spark, "attack_alerts")
    src = attack_alerts(spark, sf)
    AL.append_attack_alerts(src, path)
    return spark.read.parquet(path).select(*src.columns, "date")


_EVOLVE_CUT = "1998-01-01 00:00:00"


@register("alerts_evolved", O.with_enriched(_ATTACK_CTE) +
          f"SELECT id, timestamp, src_ip, dst_ip, prediction, confidence, "
          f"CASE WHEN timestamp < TIMESTAMP '{_EVOLVE_CUT}' THEN NULL ELSE direction END AS direction, "
          f"CASE WHEN timestamp < TIMESTAMP '{_EVOLVE_CUT}' THEN NULL ELSE protocol_name END AS protocol_name, "
          f"CASE WHEN timestamp < TIMESTAMP '{_EVOLVE_CUT}' THEN NULL ELSE is_internal_src END AS is_internal_src, "
          f"CASE WHEN timestamp < TIMESTAMP '{_EVOLVE_CUT}' THEN NULL ELSE is_internal_dst END AS is_internal_dst, "
          f"CASE WHEN timestamp < TIMESTAMP '{_EVOLVE_CUT}' THEN NULL ELSE country END AS country FROM attack")
def q_alerts_evolved(spark, sf):
    al = attack_alerts(spark, sf)
    cut = TP.ntz_literal(_EVOLVE_CUT)
    old = al.where(F.col("timestamp") < cut).select("id", "timestamp", "src_ip", "dst_ip", "prediction", "confidence")
    new = al.where(F.col("timestamp") >= cut)
    return AL.evolve_alert_table(old, new)


# --- structured-alert sinks -----------------------------------------------------------------

@register("structured_alerts_append", _rules_sql(
    "SELECT * FROM old_alerts UNION ALL SELECT * FROM alerts WHERE alert_id NOT IN (SELECT alert_id FROM old_alerts)",
    [O.geoip_cte(), O.enriched_cte(), O.triggered_cte(), O.by_flow_cte()]
    + O.suspicious_ctes(True, True) + [O.alerts_cte()]
    + [c.replace("st AS", "st0 AS").replace("susp AS", "susp0 AS").replace("FROM st s", "FROM st0 s")
       .replace("policy(", "policy0(").replace("pol AS", "pol0 AS").replace("FROM pol e", "FROM pol0 e")
       .replace("JOIN policy pl", "JOIN policy0 pl")
       for c in O.suspicious_ctes(True, False)]
    + [O.alerts_cte("susp0").replace("alerts AS", "old_alerts AS")]))
def q_structured_alerts_append(spark, sf):
    from netweave.session import scratch_path
    path = scratch_path(spark, "structured_alerts")
    old = alerts_table(spark, sf, use_rules=False)
    AL.append_structured_alerts(old, path, grain="year")
    AL.append_structured_alerts(alerts_table(spark, sf), path, grain="year")
    return spark.read.parquet(path).select(*AL.ALERT_COLUMNS)


@register("alerts_csv_export", O.alert_pipeline_sql(
    "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS \"{t}\"" for c, t in R.K.EXPORT_COLUMNS) + " FROM alerts"))
def q_alerts_csv_export(spark, sf):
    from netweave.session import scratch_path
    path = scratch_path(spark, "alerts_csv")
    AL.export_csv(alerts_table(spark, sf), path)
    return spark.read.option("header", True).csv(path)


# --- rule store ---------------------------------------------------------------------------

_BATCH1_HOURS = 24 * 365 * 3


def _rule_store(spark, sf):
    """Two appended generation runs: an earlier one over the flows of the
    three years before (created a day earlier) and one over all flows."""
    import datetime as dt
    from netweave.session import scratch_path
    fl = flows(spark, sf)
    t = as_of(fl)
    path = scratch_path(spark, "rules")
    b1 = R.generate_rules(P.lookback(fl, _BATCH1_HOURS, t), t - dt.timedelta(days=1))
    b1.write.mode("append").parquet(path)
    R.generate_rules(fl, t).write.mode("append").parquet(path)
    return spark.read.parquet(path).select(*R.RULE_NAMES)


def _store_sql(select: str) -> str:
    flows1 = (f"flows1 AS (SELECT * FROM flows WHERE last_seen >= (SELECT max(last_seen) FROM flows) "
              f"- INTERVAL {_BATCH1_HOURS} HOUR)")
    b1 = O.rules_ctes("flows1", "SELECT max(last_seen) - INTERVAL 1 DAY AS ca FROM flows", prefix="b1_")
    b2 = O.rules_ctes("flows", prefix="b2_")
    store = "store AS (SELECT * FROM b1_rules_all UNION ALL SELECT * FROM b2_rules_all)"
    return "WITH " + ",\n".join([O.flows_cte(), flows1] + b1 + b2 + [store]) + "\n" + select


@register("rules_append", _store_sql("SELECT * FROM store"))
def q_rules_append(spark, sf):
    return _rule_store(spark, sf)


@register("rules_latest", _store_sql(
    "SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY rule_type, protocol, port, hour, src_ip "
    "ORDER BY created_at DESC, rule_id DESC) AS rn FROM store) WHERE rn = 1"))
def q_rules_latest(spark, sf):
    return R.latest_rules(_rule_store(spark, sf))


# --- reports ------------------------------------------------------------------------------

_DIRS = [("internal_to_external_flows", "Internal-to-External"), ("external_to_internal_flows", "External-to-Internal"),
         ("internal_to_internal_flows", "Internal-to-Internal"), ("external_to_external_flows", "External-to-External")]
_SUMMARY_SQL = ("SELECT count(*) AS total_flows, count(DISTINCT src_ip) AS unique_src_ips, "
                "count(DISTINCT dst_ip) AS unique_dst_ips, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS total_bytes, "
                "CAST(coalesce(sum(packets), 0) AS BIGINT) AS total_packets, "
                + ", ".join(f"count(*) FILTER (WHERE direction = '{d}') AS {n}" for n, d in _DIRS) + " FROM enriched")


@register("summary_stats", O.with_enriched() + _SUMMARY_SQL)
def q_summary_stats(spark, sf):
    return reports.summary_stats(enriched(spark, sf))


@register("protocol_counts", O.with_enriched() +
          "SELECT protocol_name, count(*) AS flow_count FROM enriched GROUP BY protocol_name")
def q_protocol_counts(spark, sf):
    return reports.protocol_counts(enriched(spark, sf))


_HEAT_SQL = ("SELECT hour(last_seen) AS hour, protocol_name, CAST(sum(bytes) AS BIGINT) AS bytes, "
             "CAST(sum(packets) AS BIGINT) AS packets FROM enriched WHERE last_seen IS NOT NULL AND protocol_name IS NOT NULL "
             "AND bytes IS NOT NULL AND packets IS NOT NULL GROUP BY 1, 2")


@register("protocol_heatmap", O.with_enriched() + _HEAT_SQL)
def q_protocol_heatmap(spark, sf):
    return reports.protocol_heatmap(enriched(spark, sf))


def _pivot_sql(value: str, names: list[str]) -> str:
    cols = ", ".join(f"CAST(coalesce(sum({value}) FILTER (WHERE protocol_name = '{n}'), 0) AS BIGINT) AS \"{n}\""
                     for n in names)
    return O.with_enriched(f"heat AS ({_HEAT_SQL})") + f"SELECT hour, {cols} FROM heat GROUP BY hour"


# Protocol names present in the flow fixture (the pivot's column list).
_FIXTURE_PROTOCOLS = ["ICMP", "Protocol_23", "SSH", "TCP", "UDP"]


@register("heatmap_bytes_pivot", _pivot_sql("bytes", _FIXTURE_PROTOCOLS))
def q_heatmap_bytes_pivot(spark, sf):
    return reports.heatmap_pivot(reports.protocol_heatmap(enriched(spark, sf)), "bytes")


@register("heatmap_packets_pivot", _pivot_sql("packets", _FIXTURE_PROTOCOLS))
def q_heatmap_packets_pivot(spark, sf):
    return reports.heatmap_pivot(reports.protocol_heatmap(enriched(spark, sf)), "packets")


# --- windows, ML and composite reports ------------------------------------------------------

from netweave.operators import iforest as IF  # noqa: E402
from netweave.operators import ml as ML  # noqa: E402
from netweave.plans import reports as PR  # noqa: E402


@register("top_ports_per_protocol", O.with_enriched() +
          "SELECT protocol_numeric, port_numeric, flow_count, rank FROM (SELECT protocol_numeric, port_numeric, flow_count, "
          "row_number() OVER (PARTITION BY protocol_numeric ORDER BY flow_count DESC, port_numeric ASC) AS rank FROM "
          "(SELECT proto_num AS protocol_numeric, port AS port_numeric, count(*) AS flow_count FROM enriched "
          "GROUP BY 1, 2)) WHERE rank <= 10")
def q_top_ports_per_protocol(spark, sf):
    feats = enrich.flow_features(enriched(spark, sf))
    return ML.top_values_per_group(feats, "protocol_numeric", "port_numeric", 10).select(
        "protocol_numeric", "port_numeric", "flow_count", F.col("rank").cast("long").alias("rank"))


def labelled(spark, sf):
    return X.labelled_flows_from(flows(spark, sf))


_LDUR = "(CAST(epoch_us(last_seen) - epoch_us(first_seen) AS DOUBLE) / 1e6)"
_CLEAN_SQL = ("SELECT flow_id, " + f"{_LDUR} AS \"Flow Duration\", CAST(packets AS DOUBLE) AS \"Total Fwd Packets\", "
              "CAST(packets % 7 AS DOUBLE) AS \"Total Backward Packets\", CAST(bytes AS DOUBLE) AS \"Total Length of Fwd Packets\", "
              "CAST(bytes % 1009 AS DOUBLE) AS \"Total Length of Bwd Packets\", "
              "CAST(bytes AS DOUBLE) / packets AS \"Fwd Packet Length Mean\", "
              "CASE WHEN packets % 7 = 0 THEN 0.0 ELSE CAST(bytes % 1009 AS DOUBLE) / (packets % 7) END AS \"Bwd Packet Length Mean\", "
              f"CASE WHEN {_LDUR} = 0 THEN 0.0 ELSE (bytes + bytes % 1009) / {_LDUR} END AS \"Flow Bytes/s\", "
              f"CASE WHEN {_LDUR} = 0 THEN 0.0 ELSE (packets + packets % 7) / {_LDUR} END AS \"Flow Packets/s\", "
              f"{_LDUR} AS \"Fwd IAT Total\", CASE WHEN packets % 7 > 1 THEN {_LDUR} ELSE 0.0 END AS \"Bwd IAT Total\", "
              f"CASE WHEN {X.ATTACK_PREDICTION_SQL} = 'Attack' THEN 'DDoS' ELSE 'BENIGN' END AS \"Label\" FROM flows")


@register("clean_flow_features", "WITH " + O.flows_cte() + " " + _CLEAN_SQL)
def q_clean_flow_features(spark, sf):
    return IO.clean_flow_features(labelled(spark, sf))


@register("train_test_split", "WITH " + O.flows_cte() +
          " SELECT flow_id, CASE WHEN CAST('0x' || substring(md5(flow_id), 1, 8) AS BIGINT) % 100 < 80 "
          "THEN 'train' ELSE 'test' END AS split FROM flows")
def q_train_test_split(spark, sf):
    return ML.train_test_split(flows(spark, sf).select("flow_id"), "flow_id")


@register("classification_report", "WITH " + O.flows_cte() + f""",
pred AS (SELECT CASE WHEN {X.ATTACK_PREDICTION_SQL} = 'Attack' THEN 1 ELSE 0 END AS y,
  CASE WHEN len({O.static_reasons_expr('f')}) > 0 THEN 1 ELSE 0 END AS p FROM flows f),
cm AS (SELECT y, p, count(*) AS n FROM pred GROUP BY y, p),
cls AS (SELECT y AS c FROM cm UNION SELECT p FROM cm),
per AS (SELECT cls.c, coalesce((SELECT sum(n) FROM cm WHERE y = cls.c AND p = cls.c), 0) AS tp,
  coalesce((SELECT sum(n) FROM cm WHERE y = cls.c), 0) AS support,
  coalesce((SELECT sum(n) FROM cm WHERE p = cls.c), 0) AS predicted FROM cls),
m AS (SELECT CAST(c AS VARCHAR) AS class, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
  CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall, CAST(support AS BIGINT) AS support FROM per),
m2 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM m)
SELECT * FROM m2
UNION ALL SELECT 'accuracy', NULL, NULL, (SELECT sum(n) FROM cm), (SELECT sum(n) FILTER (WHERE y = p) FROM cm) / (SELECT sum(n) FROM cm)
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), CAST(sum(support) AS BIGINT), avg(f1) FROM m2
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support),
  CAST(sum(support) AS BIGINT), sum(f1 * support) / sum(support) FROM m2""")
def q_classification_report(spark, sf):
    """Static detector (flagged or not) evaluated against the flow labels."""
    fl = flows(spark, sf)
    pred = fl.select(F.when(F.expr(X.ATTACK_PREDICTION_SQL) == "Attack", 1).otherwise(0).alias("label"),
                     F.when(F.size(DT.static_reasons()) > 0, 1).otherwise(0).alias("prediction"))
    return ML.classification_report(pred)


def _train_frame(spark, sf):
    clean = IO.clean_flow_features(labelled(spark, sf))
    return ML.train_test_split(ML.labelled_training_frame(clean), "flow_id")


@register("attack_predictions")
def q_attack_predictions(spark, sf):
    """Random forest trained on the hash-selected 80 %, scored on the rest."""
    data = _train_frame(spark, sf)
    model = ML.train_attack_model(data.where("split = 'train'"))
    return ML.predict_attacks(model, data.where("split = 'test'")).select(
        "flow_id", "label", "prediction", "prediction_label", "confidence_last_class", "confidence_predicted")


@register("flow_attack_scores")
def q_flow_attack_scores(spark, sf):
    """Flow statistics of the packets, scored by the trained forest."""
    model = ML.train_attack_model(_train_frame(spark, sf).where("split = 'train'"))
    frame = ML.as_model_frame(PK.flow_statistics(X.packets(spark, sf)))
    return ML.predict_attacks(model, frame).select(
        "src_ip", "dst_ip", "proto_num", "prediction_label", "confidence_last_class", "confidence_predicted")


@register("rule_generation_run")
def q_rule_generation_run(spark, sf):
    """One composed run: profiles, rules, store; the report of the run."""
    from netweave.session import scratch_path
    return P.generate_and_store_rules(flows(spark, sf), X.geoip(spark, sf), scratch_path(spark, "rules"))


def _features(spark, sf):
    return enrich.flow_features(enriched(spark, sf))


@register("flow_clusters")
def q_flow_clusters(spark, sf):
    return ML.cluster_flows(_features(spark, sf), enrich.FEATURE_COLUMNS, k=5).select("flow_id", "cluster")


@register("cluster_profiles")
def q_cluster_profiles(spark, sf):
    with kept(_features(spark, sf).drop("flow_id")) as feats:  # flows are built once; the profiles are a small table
        return ML.cluster_profiles(ML.cluster_flows(feats, enrich.FEATURE_COLUMNS, k=5))


@register("flow_anomalies")
def q_flow_anomalies(spark, sf):
    return IF.isolation_forest(_features(spark, sf), "flow_id", enrich.FEATURE_COLUMNS)


@register("anomaly_patterns")
def q_anomaly_patterns(spark, sf):
    with kept(_features(spark, sf)) as feats:
        return IF.anomaly_patterns(feats, IF.isolation_forest(feats, "flow_id", enrich.FEATURE_COLUMNS))


_FEATS_SQL = ("feats AS (SELECT e.flow_id, " + f"{_FEAT_DUR} AS flow_duration, CAST(packets AS DOUBLE) / ({_FEAT_DUR} + 1) AS packets_per_second, "
              "CAST(bytes AS DOUBLE) / (packets + 1) AS bytes_per_packet, proto_num AS protocol_numeric, port AS port_numeric, "
              "CAST(is_internal_src AND NOT is_internal_dst AS INTEGER) AS ie, CAST(NOT is_internal_src AND is_internal_dst AS INTEGER) AS ei, "
              "CAST(is_internal_src AND is_internal_dst AS INTEGER) AS ii, hour(last_seen) AS hour_of_day, "
              f"len({O.static_reasons_expr('e')}) > 0 AS flagged, hour(last_seen) // 6 AS cluster FROM enriched e)")


def _anomaly_sql() -> str:
    row = lambda m, k, v, w="": f"SELECT '{m}' AS metric, {k} AS key, round(CAST({v} AS DOUBLE), 6) AS value FROM {w or 'an'}"
    parts = [row("anomaly_count", "''", "count(*) FILTER (WHERE flagged)", "feats"), row("total_flows", "''", "count(*)", "feats"),
             row("anomaly_ratio", "''", "count(*) FILTER (WHERE flagged) / count(*)", "feats"),
             row("avg_anomalous_duration", "''", "avg(flow_duration)"), row("avg_anomalous_packets_per_sec", "''", "avg(packets_per_second)"),
             row("avg_anomalous_bytes_per_packet", "''", "avg(bytes_per_packet)")]
    parts += [row("anomalous_directions", f"'{k}'", f"sum({c})") for k, c in (
        ("internal_to_external", "ie"), ("external_to_internal", "ei"), ("internal_to_internal", "ii"))]
    parts += [row("anomalous_protocols", "CAST(protocol_numeric AS VARCHAR)", "count(*)") + " GROUP BY protocol_numeric",
              row("anomalous_hours", "CAST(hour_of_day AS VARCHAR)", "count(*)") + " GROUP BY hour_of_day",
              "SELECT * FROM (" + row("anomalous_ports", "CAST(port_numeric AS VARCHAR)", "count(*)")
              + " GROUP BY port_numeric ORDER BY count(*) DESC, port_numeric ASC LIMIT 10)"]
    return O.with_enriched(_FEATS_SQL + ", an AS (SELECT * FROM feats WHERE flagged)") + "\nUNION ALL ".join(parts)


@register("anomaly_profile_static", _anomaly_sql())
def q_anomaly_profile_static(spark, sf):
    """The anomaly profile over flows that static rules flag, a fixed flag that
    SQL can state too."""
    fl = materialize(enriched(spark, sf))
    flag = fl.select("flow_id", F.when(F.size(DT.static_reasons()) > 0, -1).otherwise(1).alias("anomaly"))
    return IF.anomaly_patterns(enrich.flow_features(fl), flag).withColumn("value", F.round("value", 6))


def _top_sql_list(col: str, k: int, name: str) -> str:
    return (f"(SELECT cluster, string_agg(concat({col}, ':', n), ',' ORDER BY rk) AS {name} FROM (SELECT cluster, {col}, n, "
            f"row_number() OVER (PARTITION BY cluster ORDER BY n DESC, {col} ASC) AS rk FROM (SELECT cluster, {col}, count(*) AS n "
            f"FROM feats GROUP BY cluster, {col})) WHERE rk <= {k} GROUP BY cluster)")


@register("cluster_profile_hours", O.with_enriched(_FEATS_SQL) +
          "SELECT b.*, common_protocols, common_ports, peak_hours FROM (SELECT CAST(cluster AS INTEGER) AS cluster, count(*) AS size, "
          "round(avg(flow_duration), 6) AS avg_duration, round(avg(packets_per_second), 6) AS avg_packets_per_sec, "
          "round(avg(bytes_per_packet), 6) AS avg_bytes_per_packet, CAST(sum(ie) AS BIGINT) AS internal_to_external, "
          "CAST(sum(ei) AS BIGINT) AS external_to_internal, CAST(sum(ii) AS BIGINT) AS internal_to_internal FROM feats GROUP BY cluster) b "
          f"JOIN {_top_sql_list('protocol_numeric', 3, 'common_protocols')} p ON p.cluster = b.cluster "
          f"JOIN {_top_sql_list('port_numeric', 5, 'common_ports')} q ON q.cluster = b.cluster "
          f"JOIN {_top_sql_list('hour_of_day', 3, 'peak_hours')} h ON h.cluster = b.cluster")
def q_cluster_profile_hours(spark, sf):
    """Cluster profiles of a fixed grouping (quarters of the day)."""
    feats = _features(spark, sf).withColumn("cluster", F.floor(F.col("hour_of_day") / 6).cast("int"))
    out = ML.cluster_profiles(feats)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_duration", "avg_packets_per_sec", "avg_bytes_per_packet")})


_REPORT_TOP = "SELECT src_ip, {m} AS v FROM s ORDER BY {m} DESC, src_ip ASC LIMIT 10"


def _analysis_sql() -> str:
    ctes = ([O.flows_cte(), O.geoip_cte(), O.enriched_cte()] + O.rules_ctes() + [O.triggered_cte(), O.by_flow_cte()]
            + O.suspicious_ctes(False, True) + [f"s AS ({_SRC_STATS_SQL})", f"heat AS ({_HEAT_SQL})",
                                               f"summ AS ({_SUMMARY_SQL})"])
    summ_cols = ["total_flows", "unique_src_ips", "unique_dst_ips", "total_bytes", "total_packets"] + [n for n, _ in _DIRS]
    parts = [f"SELECT 'summary' AS section, '{c}' AS key, CAST({c} AS DOUBLE) AS value FROM summ" for c in summ_cols]
    parts.append("SELECT 'summary', 'suspicious_flows_count', CAST(count(*) AS DOUBLE) FROM susp")
    parts.append("SELECT 'protocols_detected', protocol_name, CAST(count(*) AS DOUBLE) FROM enriched GROUP BY protocol_name")
    for by, m in [("bytes", "total_bytes"), ("packets", "total_packets"), ("destinations", "distinct_destinations")]:
        parts.append(f"SELECT 'top_by_{by}', src_ip, CAST(v AS DOUBLE) FROM ({_REPORT_TOP.format(m=m)})")
    for v in ("bytes", "packets"):
        parts.append(f"SELECT 'heatmap_{v}', concat_ws('|', CAST(hour AS VARCHAR), protocol_name), CAST({v} AS DOUBLE) FROM heat")
    return "WITH " + ",\n".join(ctes) + "\n" + "\nUNION ALL ".join(parts)


@register("analysis_report", _analysis_sql())
def q_analysis_report(spark, sf):
    fl = flows(spark, sf)
    return PR.analysis_report(enrich.enrich_flows(fl, X.geoip(spark, sf)), P.generated_rules(fl))


APPLY_WINDOW_HOURS = 24 * 30


@register("rule_application_summary", _rules_sql(
    "SELECT (SELECT count(*) FROM recent) AS total_flows_checked, (SELECT count(DISTINCT flow_id) FROM rt) AS "
    "flows_with_triggers, (SELECT count(*) FROM rt) AS total_triggers",
    [f"recent AS (SELECT * FROM flows WHERE last_seen >= (SELECT max(last_seen) FROM flows) - INTERVAL {APPLY_WINDOW_HOURS} HOUR)",
     O.triggered_cte("recent", name="rt")]))
def q_rule_application_summary(spark, sf):
    fl = flows(spark, sf)
    t = as_of(fl)
    rules = P.generated_rules(fl, t)
    return PR.rule_application_summary(P.lookback(fl, APPLY_WINDOW_HOURS, t), rules)
