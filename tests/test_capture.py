"""Captures: round trips, ranges, pruning, streams with replay, message logs."""

import ast
import datetime as dt

import pytest
from pyspark.sql import functions as F

from netweave.operators import packets as PK
from netweave.sources import capture as C
from netweave.sources import fixtures as X
from netweave.streaming import jobs as J

ODD = [(1, dt.datetime(2024, 1, 1, 0, 0, 0, 1), "1.2.3.4", "255.255.255.255", 6, 1, 2, 40), (None,) * 8,
       (-5, None, "0.0.0.0", None, 17, 65535, 0, 2 ** 40), (1, dt.datetime(1969, 12, 31), None, "9.9.9.9", None, None, 53, None),
       (1, dt.datetime(2024, 1, 1, 0, 0, 0, 1), "1.2.3.4", "255.255.255.255", 6, 1, 2, 40)]


def same(a, b):
    a, b = (sorted(map(tuple, x.select(*C.COLUMNS).collect()), key=repr) for x in (a, b))
    return a == b


def test_round_trip_and_ranges(spark, sf, tmp_path):
    pk, path = X.packets(spark, sf), str(tmp_path / "cap")
    C.write_capture(pk, path, channels=3)
    got = C.read_capture(spark, path, records_per_partition=100)
    assert got.dtypes == pk.select(*C.COLUMNS).dtypes and same(got, pk)
    assert got.rdd.getNumPartitions() > pk.count() // 100
    C.write_capture(pk.withColumn("extra", F.lit(1)), path, channels=3)  # appends, leaves extra columns out
    assert same(C.read_capture(spark, path), pk.unionByName(pk))


def test_odd_rows_and_empty(spark, tmp_path):
    rows, path = spark.createDataFrame(ODD, C.SCHEMA), str(tmp_path / "odd")
    assert C.read_capture(spark, path).count() == 0
    C.write_capture(rows.limit(0), path)
    assert C.read_capture(spark, path).count() == 0
    C.write_capture(rows, path)
    assert same(C.read_capture(spark, path), rows)
    bad = spark.createDataFrame([(1, None, "1.2.3", None, None, None, None, None)], C.SCHEMA)
    with pytest.raises(Exception, match="no IPv4 address"):
        C.write_capture(bad, path)
    assert C.read_capture(spark, path).count() == len(ODD)
    with pytest.raises(Exception, match="only grows"):
        rows.write.format(C.FORMAT).mode("overwrite").save(path)
    with open(C.segments(path)[0].path, "ab") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="cut off"):
        C.segments(path)


def test_bounds_prune_segments(spark, tmp_path):
    path = str(tmp_path / "days")
    for d in range(1, 5):
        C.write_capture(spark.createDataFrame([(d, dt.datetime(2024, 1, d), "1.1.1.1", "2.2.2.2", 6, 1, 2, 9)], C.SCHEMA), path, channels=1)
    at = lambda d: F.lit(f"2024-01-0{d} 00:00:00").cast("timestamp_ntz")
    got = C.read_capture(spark, path).where((F.col("ts") >= at(2)) & (F.col("ts") < at(4)))
    assert sorted(r.packet_id for r in got.collect()) == [2, 3]
    assert got.rdd.getNumPartitions() == 3  # the day of the open bound is read, the first is not
    reader = C.CaptureReader({"path": path})
    list(reader.pushFilters([C.GreaterThanOrEqual(("ts",), dt.datetime(2024, 1, 2)), C.LessThan(("ts",), dt.datetime(2024, 1, 3))]))
    assert len(reader.partitions()) == 2  # the bound itself counts: rows are judged by Spark


def test_stream_offsets_and_replay(spark, sf, tmp_path):
    pk, path = X.packets(spark, sf), str(tmp_path / "cap")
    half = F.pmod(F.col("packet_id"), F.lit(2)) == 0

    def run():
        q = (C.read_capture(spark, path, streaming=True, records_per_partition=200).writeStream.format("parquet")
             .option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
        q.awaitTermination()
        return q

    C.write_capture(pk.where(half), path, channels=2)
    q = run()
    (end,) = ast.literal_eval(q.lastProgress["sources"][0]["endOffset"]).values()
    assert end[0] == len(C.segments(path)) and end[1] == C.segments(path)[-1].records  # even ids: one channel
    C.write_capture(pk.where(~half), path, channels=2)
    run()
    run()  # nothing new: nothing twice
    assert same(spark.read.parquet(str(tmp_path / "out")), pk)
    stream = C.CaptureStream({"path": path, "recordsPerPartition": "50"})
    end = stream.latestOffset()
    first, again = (sorted((r.path, r.first, r.last) for r in stream.partitions({}, end)) for _ in range(2))
    assert first == again and sum(b - a for _, a, b in first) == pk.count()
    assert stream.partitions(end, end)[0].last == 0 and len(end) == 2


def test_sessions_from_a_capture_stream(spark, sf, tmp_path):
    pk, path, gap = X.packets(spark, sf), str(tmp_path / "cap"), 6 * 3600
    C.write_capture(pk, path)
    late = [(10 ** 12, dt.datetime(2099, 1, 1), "0.0.0.1", "0.0.0.2", 6, 1, 2, 40)]
    q = (J.flow_sessions_stream(C.read_capture(spark, path, streaming=True), gap).writeStream.format("memory").queryName("t_cap")
         .outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start())
    try:
        q.processAllAvailable()
        C.write_capture(spark.createDataFrame(late, C.SCHEMA), path)
        q.processAllAvailable()
    finally:
        q.stop()
    cols = [*PK.FLOW_KEY, "session_start", "session_last", "packets", "bytes"]
    got, want = spark.table("t_cap").select(*cols), PK.flow_sessions(pk, gap).select(*cols)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_messages(spark, sf):
    pk = X.packets(spark, sf)
    messages = C.message_of(pk, "packets")
    assert ", ".join(f"{n} {t}" for n, t in messages.dtypes).replace("bigint", "long") == C.MESSAGE_SCHEMA
    twice = messages.unionByName(messages.limit(50))
    got = C.once(C.decode_messages(twice))
    assert got.where("malformed IS NOT NULL").count() == 0 and same(got, pk)
    bad = spark.createDataFrame([(None, None, "t", 0, 1, None), (b"k", b"{", "t", 0, 2, None), (b"k", b'{"packet_id": "x"}', "t", 0, 3, None),
                                 (b"k", b'{"packet_id": 7}', "t", 0, 4, None)], C.MESSAGE_SCHEMA)
    out = {r.offset: r for r in C.decode_messages(bad).collect()}
    assert [out[i].malformed for i in (1, 2, 3, 4)] == ["", "{", '{"packet_id": "x"}', None]
    assert out[4].packet_id == 7 and out[2].packet_id is None
