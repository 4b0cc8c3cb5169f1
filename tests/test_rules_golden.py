"""Rule thresholds on literal flows (golden values from the published rule file)."""

import datetime as dt

import pytest

from netweave.operators import rules as R

T0 = dt.datetime(2024, 1, 1, 12, 0, 0)


def _flows(spark, rows):
    return spark.createDataFrame(rows, "flow_id string, src_ip string, dst_ip string, proto_num int, port int, "
                                       "packets long, bytes long, first_seen timestamp_ntz, last_seen timestamp_ntz")


def test_temporal_threshold_is_mean_times_1_5(spark):
    # mean packets 11.31 (rounded), mean bytes 2866.55 -> 16.965, 4299.825
    pk = [11] * 69 + [12] * 31
    assert round(sum(pk) / len(pk), 2) == 11.31
    by = [2866] * 45 + [2867] * 55
    assert round(sum(by) / len(by), 2) == 2866.55
    rows = [(f"f{i}", "10.0.0.1", "8.8.8.8", 6, 80, p, b, T0, T0) for i, (p, b) in enumerate(zip(pk, by))]
    r = R.temporal_rules(_flows(spark, rows), T0).first()
    assert r["hour"] == 12
    assert r["packets_threshold"] == pytest.approx(16.965)
    assert r["bytes_threshold"] == pytest.approx(4299.825)
    assert r["rule_id"] == "ML_TEMPORAL_12_20240101_120000"


def test_behavioral_thresholds(spark):
    # one heavy source (562 packets over 48 flows, 46 destinations, 6 ports, 2 protocols) among light ones
    rows = []
    for i in range(48):
        pk = 11 if i < 46 else 28
        rows.append((f"h{i}", "203.0.113.9", f"8.8.{i % 46}.1", 6 if i % 2 else 17, 1000 + i % 6, pk, 100,
                     T0, T0))
    assert sum(r[5] for r in rows) == 562
    for j in range(40):
        rows.append((f"l{j}", f"10.0.0.{j}", "8.8.8.8", 6, 80, 1, 10, T0, T0))
    rules = R.behavioral_rules(_flows(spark, rows), T0).collect()
    heavy = [r for r in rules if r["src_ip"] == "203.0.113.9"][0]
    assert heavy["total_packets_threshold"] == pytest.approx(449.6)
    assert heavy["avg_packets_per_flow_threshold"] == pytest.approx(round(562 / 48, 2) * 1.2)
    assert heavy["unique_destinations_threshold"] == 36
    assert heavy["unique_ports_threshold"] == 4
    assert heavy["unique_protocols_threshold"] == 1


def test_protocol_rule_single_flow_uses_three_times_mean(spark):
    rows = [("a", "10.0.0.1", "8.8.8.8", 47, 0, 138, 5000, T0, T0)]
    r = R.protocol_rules(_flows(spark, rows), T0).first()
    assert r["packets_threshold"] == pytest.approx(414.0)
    assert r["protocol_name"] == "PROTO_47"


def test_rule_application_fires_strictly_above_threshold(spark):
    flows = _flows(spark, [("a", "10.0.0.1", "8.8.8.8", 6, 80, 10, 1, T0, T0),
                           ("b", "10.0.0.1", "8.8.8.8", 6, 80, 11, 1, T0, T0)])
    rules = R.conform_rules(spark.createDataFrame(
        [("r1", R.K.RULE_PROTOCOL, 0, 6, 10.0, T0, "MEDIUM", "d", 0.8)],
        "rule_id string, rule_type string, family_order int, protocol int, packets_threshold double, "
        "created_at timestamp_ntz, severity string, description string, confidence double"))
    got = R.apply_rules(flows, rules).select("flow_id").collect()
    assert [r[0] for r in got] == ["b"]
