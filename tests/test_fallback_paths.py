"""Size-checked broadcasts have a shuffle path beyond their limit; force it
and compare with the broadcast result."""

from pyspark.sql import functions as F

from netweave.operators import detect as D
from netweave.operators import enrich as E
from netweave.operators import packets as PK
from netweave.operators import rules as R
from netweave.plans import pipelines as P
from netweave.sources import fixtures as X


def test_geo_country_shuffle_path_equals_broadcast(spark, sf):
    fl = X.flows(spark, sf)
    geo = X.geoip(spark, sf)
    a = E.with_country(fl, geo, "dst_ip", "c").select("flow_id", "c")
    b = E.with_country(fl, geo, "dst_ip", "c", broadcast_max_rows=0).select("flow_id", "c")
    assert a.count() == b.count() == fl.count()
    assert a.exceptAll(b).count() == 0
    assert a.where(F.col("c") != "Unknown").count() > 0


def test_overlapping_ranges_give_one_row_the_narrowest(spark):
    ip = lambda s: sum(int(x) << (24 - 8 * i) for i, x in enumerate(s.split(".")))
    geo = spark.createDataFrame([(ip("8.0.0.0"), ip("9.255.255.255"), "WIDE"), (ip("8.8.8.0"), ip("8.8.8.255"), "NARROW"),
                                 (ip("8.8.8.8"), ip("8.8.8.8"), "ONE"), (ip("8.8.8.8"), ip("8.8.8.8"), "ALSO")],
                                "start_ip long, end_ip long, country string")
    fl = spark.createDataFrame([(i, a) for i, a in enumerate(["8.8.8.8", "8.8.8.9", "8.8.9.0", "9.255.255.255", "10.0.0.1", None, "8.8.8.8"])],
                               "flow_id long, dst_ip string")
    want = ["ALSO", "NARROW", "WIDE", "WIDE", "Unknown", "Unknown", "ALSO"]
    for limit in (E.GEO_BROADCAST_MAX_ROWS, 0):
        got = E.with_country(fl, geo, "dst_ip", "c", broadcast_max_rows=limit).orderBy("flow_id").collect()
        assert [r.c for r in got] == want


def test_missing_store_is_empty_but_other_failures_are_raised(spark, tmp_path):
    import pytest
    from netweave.sources.rulestore import read_rules
    assert read_rules(spark, str(tmp_path / "none")).count() == 0
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_text("not a table")
    with pytest.raises(Exception, match="not a Parquet file"):
        read_rules(spark, str(tmp_path / "bad")).count()


def test_checkpoint_folder_is_required_on_clusters():
    from netweave.session import _single_process
    assert _single_process("local") and _single_process("local[8]")
    assert not any(map(_single_process, ("local-cluster[3,2,1000]", "yarn", "spark://host:7077", "k8s://x")))


def test_rule_probe_shuffle_path_equals_broadcast(spark, sf):
    fl = X.flows(spark, sf)
    rules = R.generate_rules(fl)
    a = R.apply_rules(fl, rules).select("flow_id", "rule_id")
    b = R.apply_rules(fl, rules, broadcast_max_bytes=0).select("flow_id", "rule_id")
    assert a.count() > 0
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_evidence_shuffle_path_equals_broadcast(spark, sf):
    pk = X.packets(spark, sf)
    susp = P.suspicious_flows(PK.flows_from_packets(pk), X.geoip(spark, sf), None, use_policy=True)
    a = D.evidence_packets(pk, susp)
    b = D.evidence_packets(pk, susp, broadcast_max_rows=0)
    assert a.count() > 0
    assert a.count() == b.count()
    assert a.exceptAll(b).count() == 0


def test_source_choice_falls_back_to_alerts_when_no_recent_flows(spark, sf):
    import datetime as dt

    from netweave.sources import io as IO
    fl = X.flows(spark, sf)
    alerts = X.attack_alerts_from(E.enrich_flows(fl, X.geoip(spark, sf)))
    future = P.as_of(fl) + dt.timedelta(days=3650)
    empty_recent = IO.flows_lookback(fl, 1, future).where(F.col("last_seen") > F.lit(str(future)).cast("timestamp_ntz"))
    out = IO.choose_source(empty_recent, alerts)
    assert out.count() == alerts.count()
    assert "packets" in out.columns and out.where(F.col("packets").isNotNull()).count() == 0
    from_flows = IO.choose_source(fl, alerts)
    assert from_flows.schema.simpleString() == out.schema.simpleString()
    assert from_flows.count() == fl.count()
