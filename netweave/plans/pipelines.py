"""End-to-end compositions of the operators (the reference's endpoints)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.operators import alerts as A
from netweave.operators import detect as D
from netweave.operators import enrich as E
from netweave.operators import rules as R
from netweave.session import kept, materialize


def as_of(df: DataFrame, col: str = "last_seen"):
    """Reference instant of a data set: its newest ``col`` value (one scalar)."""
    return df.agg(F.max(col)).first()[0]


def lookback(flows: DataFrame, hours: float | None, as_of_value, col: str = "last_seen") -> DataFrame:
    """Rows with ``col >= as_of - hours`` (all rows when ``hours`` is None).

    The bound is a literal, so Parquet row groups / date partitions are
    pruned at the scan.
    """
    if hours is None:
        return flows
    import datetime as dt
    lo = as_of_value - dt.timedelta(hours=hours)
    return flows.where(F.col(col) >= F.lit(str(lo)).cast("timestamp_ntz"))


def generated_rules(flows: DataFrame, created_at=None) -> DataFrame:
    """All rule families over ``flows`` (from one checkpointed statistics
    pass); ``created_at`` defaults to the newest ``last_seen``."""
    return R.generate_rules(flows, created_at)


def suspicious_flows(flows: DataFrame, geoip: DataFrame | None, rules: DataFrame | None,
                     use_policy: bool = False) -> DataFrame:
    return D.detect_suspicious(E.enrich_flows(flows, geoip), rules, use_policy=use_policy)


def structured_alerts(flows: DataFrame, geoip: DataFrame | None, use_rules: bool = True,
                      created_at=None) -> DataFrame:
    """flows -> enrichment -> (generated rules) -> detection with the
    (protocol, port) policy -> scored structured alerts."""
    rules, ca = None, created_at
    if use_rules:
        rules, ca = R.generate_rules_at(flows, created_at)
    if ca is None:
        ca = as_of(flows)
    susp = suspicious_flows(flows, geoip, rules, use_policy=True)
    return A.to_alerts(susp, ca)


def upload_analysis(spark, csv_path: str, model, alerts_path: str | None = None, now=None) -> DataFrame:
    """Labelled-flow CSV -> cleaned features -> model verdicts -> derived
    fields (``Unknown`` without addresses) -> attack-alert rows, appended to
    ``alerts_path`` when given. Returns the alert rows."""
    import datetime as dt
    from netweave.operators import ml as ML
    from netweave.sources import io as IO
    clean = IO.clean_flow_features(spark.read.option("header", True).csv(csv_path))
    feats = clean.select("*", *[F.col(f"`{c}`").alias(ML.snake(c)) for c in ML.K.MODEL_FEATURES])
    pred = ML.predict_attacks(model, feats)
    enriched = E.upload_enrichment(pred)
    ts = now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None, microsecond=0)
    rows = enriched.select(
        F.concat_ws("-", F.lit(uuid.uuid4().hex), F.monotonically_increasing_id().cast("string")).alias("id"),
        F.lit(str(ts)).cast("timestamp_ntz").alias("timestamp"), "src_ip", "dst_ip",
        F.col("prediction_label").alias("prediction"), F.col("confidence_last_class").alias("confidence"),
        "direction", "protocol_name", "is_internal_src", "is_internal_dst", "country")
    if alerts_path:
        rows = materialize(rows)  # the ids of this upload, once
        A.append_attack_alerts(rows, alerts_path)
    return rows


def generate_and_store_rules(flows: DataFrame, geoip: DataFrame | None, path: str, hours: float | None = None,
                             key: str = "flow_id") -> DataFrame:
    """One rule-generation run: flows of the last ``hours`` (all without) ->
    rule features -> anomaly profile and cluster profile, rules of all families
    -> appended to the store. Returns the run's report (section, key, value):
    both profiles and the rule counts."""
    from netweave.operators import iforest as IF
    from netweave.operators import ml as ML
    from netweave.sources import rulestore as RS
    newest = as_of(flows)
    recent = lookback(flows, hours, newest)
    with kept(E.flow_features(E.enrich_flows(recent, geoip), keep=(key,))) as feats:  # both profiles are small tables then
        profile = IF.anomaly_patterns(feats, IF.isolation_forest(feats, key, E.FEATURE_COLUMNS), key)
        clusters = ML.cluster_profiles(ML.cluster_flows(feats, E.FEATURE_COLUMNS))
    rules = R.generate_rules(recent, newest)
    RS.append_rules(rules, path)
    sizes = clusters.select(F.lit("cluster_size").alias("section"), F.col("cluster").cast("string").alias("key"),
                            F.col("size").cast("double").alias("value"))
    counts = R.rule_generation_summary(rules).select(F.lit("rules").alias("section"), F.col("metric").alias("key"),
                                                     F.col("value").cast("double").alias("value"))
    return (profile.select(F.col("metric").alias("section"), "key", "value").unionByName(sizes).unionByName(counts))
