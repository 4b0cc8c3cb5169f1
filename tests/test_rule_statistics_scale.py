"""Rule statistics hold up on large tables."""

import datetime as dt
from collections import defaultdict

from netweave.operators import rules as R
from netweave.plans import registry

SCHEMA = ("src_ip string, dst_ip string, proto_num int, port int, packets long, bytes long, last_seen timestamp_ntz")


def _rows():
    day = dt.datetime(2024, 1, 1)
    rows = [(f"10.0.0.{i % 5}", f"8.8.{i % 7}.{i % 3}", (6, 17, 300)[i % 3], 20 + i % 4, i * 2 ** 33, None if i % 9 == 0 else i,
             day + dt.timedelta(hours=i % 11)) for i in range(200)]
    return rows + rows[:20] + [(None, "8.8.8.8", 6, None, 5, 5, None), ("10.0.0.1", None, None, 22, None, 7, day)]


def test_statistics_count_every_pair(spark):
    rows = _rows()
    got = {}
    for r in R.family_statistics(spark.createDataFrame(rows, SCHEMA)).collect():
        key = next((k for k in R.FAMILY_KEYS if r.gid == R._gid(k)), None)
        assert (key, r[key]) not in got
        got[key, r[key]] = r
    want, named = defaultdict(list), ["src_ip", "dst_ip", "proto_num", "port", "packets", "bytes", "last_seen"]
    for values in rows:
        row = dict(zip(named, values))
        row["hour"] = row["last_seen"].hour if row["last_seen"] else None
        for k in R.FAMILY_KEYS:
            want[k, row[k]].append(row)
    assert set(got) == set(want)
    counted = {"proto_num": ("port", "src_ip", "dst_ip"), "port": ("proto_num", "src_ip", "dst_ip"),
               "hour": ("src_ip", "dst_ip"), "src_ip": ("proto_num", "port", "dst_ip")}
    for (k, value), held in want.items():
        r, packets = got[k, value], [x["packets"] for x in held if x["packets"] is not None]
        assert (r.n, r.p_sum) == (len(packets), sum(packets) if packets else None)
        assert r.max_seen == max((x["last_seen"] for x in held if x["last_seen"]), default=None)
        for other in counted[k]:
            assert r[R._MEMBERS[other]] == len({x[other] for x in held} - {None}), (k, value, other)


def test_statistics_deal_flows_before_they_expand(spark):
    """What a task aggregates does not depend on how large the files' parts are."""
    plan = R.family_statistics(spark.createDataFrame(_rows(), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.index("Expand") < plan.index("REPARTITION_BY_NUM")


def test_queries_split_large_stages_in_any_session(spark, sf):
    name = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, "65535")
        registry.QUERIES["packets_scan"](spark, sf)
        assert int(spark.conf.get(name)) <= 8000
    finally:
        spark.conf.set(name, before)


def test_pairs_of_addresses_are_numbers(spark):
    """What is shuffled to count pairs holds no text where the addresses are IPv4, and a
    protocol with a bit needs no row for each of its addresses."""
    rows = [r for r in _rows() if r[0] and r[1] and r[3]]
    sets = R._counted_sets(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sets and all(r.text is None and r.text2 is None for r in sets)
    plain = [r for r in rows if r[2] < 63]
    assert len({r.set for r in R._counted_sets(spark.createDataFrame(plain, SCHEMA)).collect()}) == 6


def test_any_text_counts_as_an_address(spark):
    """Texts that are no IPv4, protocols beyond the bits, and NULL in any place."""
    day = dt.datetime(2024, 1, 1)
    src, dst = ["10.0.0.1", "255.255.255.255", "host", "01.2.3.4", "::1", "", None], ["8.8.8.8", "0.0.0.0", "x|y", None]
    rows = [(a, b, proto, port, 1, 1, day + dt.timedelta(hours=h)) for a in src for b in dst
            for proto, port, h in ((0, 0, 0), (62, -1, 23), (63, 2 ** 31 - 1, 5), (-1, None, 5), (None, -2 ** 31, 7))]
    got = {(r.gid, *(r[k] for k in R.FAMILY_KEYS)): r for r in R.family_statistics(spark.createDataFrame(rows, SCHEMA)).collect()}
    at = {"src_ip": 0, "dst_ip": 1, "proto_num": 2, "port": 3}
    values = {"src_ip": src, "proto_num": [0, 62, 63, -1, None], "port": [0, -1, 2 ** 31 - 1, None, -2 ** 31], "hour": [0, 23, 5, 7]}
    assert len(got) == sum(map(len, values.values()))
    for key, all_of in values.items():
        for v in all_of:
            held = [r for r in rows if (r[6].hour if key == "hour" else r[at[key]]) == v]
            r = got[R._gid(key), *(v if k == key else None for k in R.FAMILY_KEYS)]
            assert r.n == len(held)
            for other in ("src_ip", "dst_ip") if key == "hour" else at.keys() - {key}:
                assert r[R._MEMBERS[other]] == len({x[at[other]] for x in held} - {None}), (key, v, other)
