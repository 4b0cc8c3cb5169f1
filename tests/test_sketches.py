"""Daily sketches: error bounds, merged days, and what a lookback reads; KLL
quantiles by rank error; radix quantiles by passes."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from netweave.functions import quantile as Q
from netweave.operators import rules as R
from netweave.operators import sketches as S
from netweave.session import scratch_path
from netweave.sources import fixtures as X

BASE = dt.datetime(2024, 3, 1)
#: Three standard errors of a sketch with 4,096 registers.
BOUND = 3 * 1.04 / 64


@pytest.fixture(scope="module")
def many(spark):
    """40,000 flows on four days; one source holds a third of them."""
    day = F.timestamp_add("SECOND", (F.col("id") % 4) * 86400 + F.col("id") % 3600, F.lit(str(BASE)).cast("timestamp_ntz"))
    return spark.range(40_000).select(
        F.col("id").alias("flow_id"),
        F.when(F.col("id") % 3 == 0, "10.0.0.1").otherwise(F.concat_ws(".", F.lit("10.1"), (F.col("id") % 50).cast("string"), F.lit("2"))).alias("src_ip"),
        F.concat(F.lit("d"), (F.col("id") * 7919 % 30_011).cast("string")).alias("dst_ip"),
        F.when(F.col("id") % 2 == 0, 6).otherwise(17).alias("proto_num"), (F.col("id") % 1500).cast("int").alias("port"),
        (F.col("id") % 97).alias("packets"), F.when(F.col("id") % 11 > 0, F.col("id") * 13 % 10_000).alias("bytes"), day.alias("last_seen"))


def distinct(flows, key):
    return {r[0]: tuple(r)[1:] for r in flows.groupBy(key).agg(
        F.count_distinct("port"), F.count_distinct("src_ip"), F.count_distinct("dst_ip"), F.count_distinct("proto_num")).collect()}


def near(got, want):
    return abs(got - want) <= BOUND * want + 0.5


def test_counts_within_the_error_bound_and_moments_exact(spark, many):
    path = scratch_path(spark, "sketches")
    S.write_daily_sketches(many.where("flow_id < 15000"), path)
    S.write_daily_sketches(many.where("flow_id >= 15000"), path)  # a day in two appends
    total = S.approx_summary(S.read_sketches(spark, path)).first()
    exact = many.agg(F.count("*"), F.count_distinct("src_ip"), F.count_distinct("dst_ip"), F.sum("bytes"), F.sum("packets")).first()
    assert total.total_flows == exact[0] and total.total_bytes == exact[3] and total.total_packets == exact[4]
    assert near(total.unique_src_ips, exact[1]) and near(total.unique_dst_ips, exact[2])

    got = S.family_statistics(S.read_sketches(spark, path))
    want = R.family_statistics(many)
    a = {tuple(r[k] for k in R.FAMILY_KEYS): r for r in got.collect()}
    b = {tuple(r[k] for k in R.FAMILY_KEYS): r for r in want.collect()}
    assert a.keys() == b.keys()
    for k, r in b.items():
        for c in ("gid", "max_seen", "n", "p_sum", "p_avg", "p_std", "b_avg", "b_std"):
            assert a[k][c] == r[c], (k, c)
    keyed = many.withColumn("hour", F.hour("last_seen"))
    for i, key in enumerate(R.FAMILY_KEYS):
        for value, counts in distinct(keyed, key).items():
            row = a[tuple(value if j == i else None for j in range(len(R.FAMILY_KEYS)))]
            assert all(near(row[c], n) for c, n in zip(("d_port", "d_src", "d_dst", "d_proto"), counts)), (key, value)


def test_lookback_reads_only_its_days_of_sketches(spark, many):
    path = scratch_path(spark, "sketches")
    S.write_daily_sketches(many, path)
    since = BASE.date() + dt.timedelta(days=2)
    recent = S.read_sketches(spark, path, since=since)
    flows = many.where(F.to_date("last_seen") >= F.lit(str(since)).cast("date"))
    plan = recent._jdf.queryExecution().executedPlan().toString()
    assert f"(date#" in plan and "PartitionFilters: [isnotnull(date" in plan
    of = {r.src_ip: r.d_dst for r in S.merged(recent.where(F.col("family") == R.FAMILY_KEYS.index("src_ip"))).collect()}
    want = distinct(flows, "src_ip")
    assert of.keys() == want.keys() and all(near(of[k], want[k][2]) for k in want)
    top = S.approx_top_sources(recent, 3).collect()
    assert top[0].src_ip == "10.0.0.1" and near(top[0].distinct_destinations, want["10.0.0.1"][2])
    assert S.approx_summary(S.read_sketches(spark, path, until=BASE.date())).first().total_flows == 10_000


def test_rules_from_sketches(spark, sf):
    """Few distinct members: sketches are exact there, and so are the rules."""
    flows = X.flows(spark, sf).where("port < 40")
    want = R.generate_rules(flows)
    got = S.generate_rules(S.daily_sketches(flows))
    keys = ["rule_type", "protocol", "port", "hour", "src_ip"]
    a, b = ({tuple(r[k] for k in keys): r for r in df.collect()} for df in (got, want))
    assert a.keys() == b.keys() and len(b) > 30
    for k, r in b.items():
        assert (a[k].packets_threshold, a[k].flow_count, a[k].created_at) == (r.packets_threshold, r.flow_count, r.created_at)
        for c in ("unique_ports_threshold", "unique_src_ips_threshold", "unique_dst_ips_threshold", "unique_destinations_threshold"):
            assert (a[k][c] is None) == (r[c] is None) and (r[c] is None or abs(a[k][c] - r[c]) <= BOUND * r[c] + 2)


def test_no_flows(spark, many):
    none = S.daily_sketches(many.limit(0))
    assert S.family_statistics(none).collect() == []
    assert S.approx_summary(none).collect() == [] and S.approx_top_sources(none).collect() == []


def test_quantiles_of_any_doubles_in_six_passes(spark, monkeypatch):
    """600 decades, subnormals, both signs and long runs of neighbours."""
    rng = np.random.default_rng(3)
    wide = np.concatenate([10.0 ** rng.uniform(-300, 300, 2000), -(10.0 ** rng.uniform(-320, 300, 2000)), [0.0, 5e-324, -5e-324]])
    dense = 1e15 + np.arange(4003) * 0.125
    rng.shuffle(dense)
    df = spark.createDataFrame([(float(a), float(b)) for a, b in zip(wide, dense)], "w double, d double")
    passes, counted = [], Q._counted
    monkeypatch.setattr(Q, "_counted", lambda *a: passes.append(1) or counted(*a))
    for q in (0.0, 0.31, 0.5, 0.95):
        passes.clear()
        got = Q.exact_quantiles(df, ["w", "d"], q)
        assert len(passes) <= Q.MAX_PASSES
        for c, x in (("w", wide), ("d", dense)):
            s, at = np.sort(x), q * (len(x) - 1)
            lo = int(at)
            assert min(s[lo], s[min(lo + 1, len(s) - 1)]) <= got[c] <= max(s[lo], s[min(lo + 1, len(s) - 1)])
    passes.clear()
    assert Q.order_statistics(df, [("w", 7), ("w", 3000), ("d", 4000)]) == {
        ("w", 7): np.sort(wide)[7], ("w", 3000): np.sort(wide)[3000], ("d", 4000): np.sort(dense)[4000]}
    assert len(passes) <= Q.MAX_PASSES


def test_sketched_quantiles_by_rank(spark):
    values = np.random.default_rng(4).lognormal(0, 5, 30_000)
    df = spark.createDataFrame([(i % 7, float(v)) for i, v in enumerate(values)], "day int, v double").withColumn("none", F.lit(None).cast("double"))
    sketches = Q.quantile_sketches(df, ["v", "none"], ["day"])
    assert sketches.count() == 7
    for q in (0.05, 0.5, 0.95):
        got = Q.sketched_quantiles(sketches, ["v", "none"], q)
        assert abs((values < got["v"]).mean() - q) <= 2.3 / 400 and got["none"] is None
