"""The physical plans keep the properties the design relies on."""

from netweave.operators import detect as D
from netweave.operators import enrich as E
from netweave.operators import rules as R
from netweave.sources import fixtures as X


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_detection_reads_flows_once_and_probes_by_broadcast(spark, sf):
    fl = X.flows(spark, sf)
    rules = R.generate_rules(fl)
    plan = _plan(D.detect_suspicious(E.enrich_flows(fl, X.geoip(spark, sf)), rules, use_policy=True))
    assert plan.count("lineitem.parquet") == 1
    assert "BroadcastHashJoin" in plan
    assert "SortMergeJoin" not in plan


def test_geo_join_is_broadcast(spark, sf):
    plan = _plan(E.enrich_flows(X.flows(spark, sf), X.geoip(spark, sf)))
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_rule_statistics_single_scan(spark, sf):
    plan = _plan(R.family_statistics(X.flows(spark, sf)))
    assert plan.count("lineitem.parquet") == 1
    assert "Expand" in plan
