"""Shards are even, slots gapless, and copies together as far as quotas allow."""

import zlib
from collections import Counter, defaultdict

from fixtures import none, odd, odd_rows, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import sharding


def check(got, table, shards):
    texts = Counter((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in table)
    assert Counter(r[:3] for r in got) == texts
    slots = defaultdict(list)
    for r in got:
        assert r[3] == "rows" and 0 <= r[4] < shards and r[6] is None
        slots[r[4]].append(r[5])
    counts = [len(slots[s]) for s in range(shards)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_odd_rows(spark, monkeypatch):
    for bucket in (50_000, 2):
        monkeypatch.setattr(sharding, "BUCKET_ROWS", bucket)
        monkeypatch.setattr(sharding, "HOT_ROWS", bucket)
        for shards in (3, 40):
            check(rows(sharding.shard(odd(spark), shards)), [r[:2] for r in odd_rows()], shards)
    assert rows(sharding.shard(none(spark))) == []


def test_copies_stay_together(spark, monkeypatch):
    """A text with a third of all rows takes no more shards than it must, one
    more at most; small groups are whole."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 16)
    monkeypatch.setattr(sharding, "HOT_ROWS", 16)
    table = [(i, "hot") for i in range(200)] + [(1000 + i, f"pair {i // 2}") for i in range(100)] + [
        (5000 + i, f"single {i}") for i in range(300)]
    got = rows(sharding.shard(spark.createDataFrame(table, "doc_id long, text string"), 10))
    check(got, table, 10)
    shard_of = {r[0]: r[4] for r in got}
    assert all(shard_of[1000 + i] == shard_of[1001 + i] for i in range(0, 100, 2))
    assert len({shard_of[i] for i in range(200)}) <= 5


def test_hot_text_is_numbered_in_many_tasks(spark, monkeypatch):
    """Without broadcasts by size and without AQE, no task holds a hot text."""
    monkeypatch.setattr(sharding, "HOT_ROWS", 20)
    plain = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {name: spark.conf.get(name) for name in plain}
    seen, numbered = [], sharding._numbered

    def watched(df, keys, order, out):
        if keys == ["text_key"]:
            seen.append(df)
        return numbered(df, keys, order, out)

    monkeypatch.setattr(sharding, "_numbered", watched)
    table = [(i, "hot") for i in range(1000)] + [(5000 + i, f"pair {i // 2}") for i in range(400)]
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        check(rows(sharding.shard(spark.createDataFrame(table, "doc_id long, text string"), 10)), table, 10)
        tasks = [r["count"] for r in seen[0].groupBy(F.spark_partition_id()).count().collect()]
        assert sum(tasks) == 1400 and max(tasks) < 500
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_all_linked(spark):
    """No free place: only exchanges are possible."""
    table = [(i, f"pair {i // 2}") for i in range(400)]
    got = rows(sharding.shard(spark.createDataFrame(table, "doc_id long, text string"), 8))
    check(got, table, 8)


@settings(max_examples=100, deadline=None)
@given(st.integers(2, 5).flatmap(lambda n: st.tuples(
    st.lists(st.lists(st.integers(0, 9), min_size=n, max_size=n), min_size=n, max_size=n),
    st.lists(st.integers(0, 9), min_size=n, max_size=n))))
def test_settle_keeps_quotas(case):
    wanted, free = case
    allowed = sharding.settle(wanted, free)
    n = len(free)
    for t in range(n):
        gain = sum(allowed[s][t] for s in range(n)) - sum(allowed[t])
        assert gain <= free[t]
    assert all(0 <= allowed[s][t] <= wanted[s][t] for s in range(n) for t in range(n) if s != t)
