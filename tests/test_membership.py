"""Appends through Bloom filters beside the store: exact, and what they look up."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from netweave.operators import alerts as A
from netweave.operators import membership as M
from netweave.session import scratch_path

BASE = dt.datetime(2024, 1, 1)


def batch(spark, ids, undated=()):
    rows = [(f"a{i}", BASE + dt.timedelta(hours=i)) for i in ids] + [(f"u{i}", None) for i in undated]
    return spark.createDataFrame(rows, "alert_id string, timestamp timestamp_ntz")


@pytest.fixture()
def store(spark):
    return scratch_path(spark, "store")


def ids_in(spark, store):
    return sorted(r.alert_id for r in spark.read.parquet(store).collect())


def looked_up(spark, store, new):
    """How many ids of a batch the filters cannot rule out."""
    known = spark.read.schema(M.SCHEMA).parquet(M.filter_path(store))
    dated = new.withColumn("date", F.to_date("timestamp"))
    return M.possible(dated, known, "alert_id").where("__possible").count()


def test_appends_are_exact_and_look_up_only_possible_ids(spark, store, monkeypatch):
    reads = []
    within = A._within
    monkeypatch.setattr(A, "_within", lambda rows, c: reads.append(rows.count()) or within(rows, c))
    A.append_unstored(batch(spark, range(300), undated=[1]), store, "alert_id")
    assert reads == []  # a first append looks nothing up
    new = batch(spark, range(300, 2300), undated=[2])
    assert looked_up(spark, store, new) <= 20
    A.append_unstored(new, store, "alert_id")
    again = batch(spark, range(200, 400), undated=[1, 2, 3])
    assert looked_up(spark, store, again) >= 200
    fresh = A.append_unstored(again.unionByName(batch(spark, [5000, 5000])), store, "alert_id")
    assert sorted(r.alert_id for r in fresh.collect()) == ["a5000", "u3"]
    want = sorted([f"a{i}" for i in [*range(2300), 5000]] + ["u1", "u2", "u3"])
    assert ids_in(spark, store) == want
    reads.clear()
    A.append_unstored(batch(spark, []), store, "alert_id")
    assert ids_in(spark, store) == want and reads == [0]


def test_old_folders_are_not_read_for_new_ids(spark, store):
    """The store's old files can be gone: ids of other dates never touch them."""
    A.append_unstored(batch(spark, range(24)), store, "alert_id")
    for folder, _, names in os.walk(store):
        if "date=2024-01-01" in folder:
            for name in names:
                if name.startswith("part-"):
                    with open(os.path.join(folder, name), "wb") as f:
                        f.write(b"not a table")
                    crc = os.path.join(folder, f".{name}.crc")
                    if os.path.exists(crc):
                        os.remove(crc)
    A.append_unstored(batch(spark, range(48, 72)), store, "alert_id")
    A.append_unstored(batch(spark, range(48, 96)), store, "alert_id")
    later = spark.read.schema("alert_id string, timestamp timestamp_ntz, date date").parquet(store).where("date > DATE '2024-01-02'")
    assert later.count() == 48
    with pytest.raises(Exception):
        A.append_unstored(batch(spark, [0]), store, "alert_id").collect()


def test_a_store_without_filters_gets_them(spark, store):
    batch(spark, range(50)).withColumn("date", F.to_date("timestamp")).write.partitionBy("date").parquet(store)
    A.append_unstored(batch(spark, range(40, 60)), store, "alert_id")
    assert ids_in(spark, store) == sorted(f"a{i}" for i in range(60))
    assert looked_up(spark, store, batch(spark, range(60))) == 60


def test_broken_off_append_loses_nothing(spark, store):
    A.append_unstored(batch(spark, range(5)), store, "alert_id")
    ghost = batch(spark, range(5, 9)).withColumn("date", F.to_date("timestamp"))
    M.filters(ghost, "alert_id").write.mode("append").partitionBy("month").parquet(M.filter_path(store))
    A.append_unstored(batch(spark, range(9)), store, "alert_id")
    assert ids_in(spark, store) == [f"a{i}" for i in range(9)]


def test_filters_merge_and_never_deny(spark):
    ids = spark.range(20_000).select(F.lit(str(BASE.date())).cast("date").alias("date"), F.col("id").cast("string").alias("k"))
    parts = M.filters(ids.where("k < 7000"), "k").unionByName(M.filters(ids.where("k >= 7000"), "k"))
    assert M.possible(ids, parts, "k").where("NOT __possible").count() == 0
    other = ids.withColumn("k", F.concat(F.lit("x"), "k"))
    assert M.possible(other, parts, "k").where("__possible").count() < 400
    assert M.possible(ids.withColumn("date", F.lit("2000-01-01").cast("date")), parts, "k").where("__possible").count() == 0
