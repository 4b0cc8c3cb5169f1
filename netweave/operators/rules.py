"""Detection rules derived from flow statistics, the rule table, and rule
application as broadcast equi + theta joins.

Rule table: one wide row per rule (no nested JSON). Columns a family does not
use are NULL. ``family_order`` plus the family key give the rule-file order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions import net
from netweave.functions.quantile import exact_quantiles
from netweave.functions.timeparts import hour_of, ntz_literal

RULE_COLUMNS = [
    ("rule_id", "string"), ("rule_type", "string"), ("family_order", "int"),
    ("protocol", "int"), ("port", "int"), ("hour", "int"), ("src_ip", "string"),
    ("protocol_name", "string"), ("severity", "string"), ("description", "string"),
    ("confidence", "double"), ("created_at", "timestamp_ntz"),
    # conditions
    ("packets_threshold", "double"), ("bytes_threshold", "double"),
    ("unique_ports_threshold", "long"), ("unique_src_ips_threshold", "long"),
    ("unique_dst_ips_threshold", "long"), ("protocols_threshold", "long"),
    ("total_packets_threshold", "double"), ("avg_packets_per_flow_threshold", "double"),
    ("unique_destinations_threshold", "long"), ("unique_protocols_threshold", "long"),
    # statistics / baseline / behaviour profile
    ("avg_packets", "double"), ("avg_bytes", "double"), ("flow_count", "long"),
    ("total_packets", "long"), ("avg_packets_per_flow", "double"),
    ("unique_destinations", "long"), ("unique_ports", "long"), ("unique_protocols", "long"),
]
RULE_NAMES = [n for n, _ in RULE_COLUMNS]
#: Measured size up to which one family's rules are broadcast.
BROADCAST_RULES_MAX_BYTES = 64 << 20


def conform_rules(df: DataFrame) -> DataFrame:
    """Add missing rule columns as typed NULLs and fix the column order."""
    present = set(df.columns)
    return df.select(*[(F.col(n) if n in present else F.lit(None)).cast(t).alias(n)
                       for n, t in RULE_COLUMNS])


def _stamp(created_at) -> F.Column:
    return F.date_format(created_at, "yyyyMMdd_HHmmss")


FAMILY_KEYS = ["proto_num", "port", "hour", "src_ip"]


def _gid(key: str) -> int:
    """``grouping_id()`` of the grouping set ``[key]`` (first column = MSB)."""
    n = len(FAMILY_KEYS)
    return sum(1 << (n - 1 - i) for i, k in enumerate(FAMILY_KEYS) if k != key)


#: Members whose distinct numbers the rules count, as columns of the statistics.
_MEMBERS = {"port": "d_port", "src_ip": "d_src", "dst_ip": "d_dst", "proto_num": "d_proto"}
#: What is counted first, and whether it sums values. Together the sets hold every pair
#: that a rule counts; those of an address with an hour or a protocol are in the hours
#: and protocols (one bit each) of the sets by source and by port and destination.
#: Protocols without a bit have sets of their own.
_PORT_PROTO, _HOUR, _SRC, _ODD_SRC, _ODD_DST, _PORT_SRC, _PORT_DST, _SRC_DST = range(8)
_SUMMED = (_PORT_PROTO, _HOUR, _SRC)
_PROTO_BITS = 63
#: The bit of flows without a time.
_NO_HOUR = 24


def moments_of(v: str) -> list[F.Column]:
    """Mean and sample deviation from the exact sums ``n<v>``, ``<v>1`` and ``<v>2``."""
    count, total, squares = F.col(f"n{v}"), F.col(f"{v}1").cast("double"), F.col(f"{v}2")
    # n * sum of squares - square of the sum, exactly, then the sample variance.
    spread = (squares * count - F.col(f"{v}1") * F.col(f"{v}1")).cast("double")
    return [(total / count).alias(f"{v}_avg"),
            F.when(count > 1, F.sqrt(spread / (count.cast("double") * (count - 1)))).alias(f"{v}_std")]


def _bit(n) -> F.Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _pair(high: str, low: str) -> F.Column:
    """Two 32-bit numbers as one long; NULL if one of them is NULL."""
    return F.call_function("shiftleft", F.col(high).cast("long"), F.lit(32)).bitwiseOR(F.col(low))


def _address(name: str) -> F.Column:
    """The text of an address that base rows hold as a number or as text."""
    return F.coalesce(f"{name}_text", net.long_to_ipv4(name))


def _counted_sets(flows: DataFrame) -> DataFrame:
    """Distinct rows (set, code, num, text, text2) of every set, from one scan.

    A pair with addresses is one long (``code``), since an IPv4 text is 32 bits; a pair
    with a NULL or with any other text is in num, text and text2. Flows are dealt by a
    hash of the whole narrow row first, so that what a task holds does not depend on the
    size of the files; values are carried by the sets that sum them only.
    """
    spark = flows.sparkSession
    base = flows.select(
        F.col("proto_num").cast("int").alias("proto_num"), F.col("port").cast("int").alias("port"), hour_of("last_seen").alias("hour"),
        *[net.ipv4_to_long(f"{a}_ip").alias(a) for a in ("src", "dst")], F.col("src_ip"), F.col("dst_ip"),
        F.col("packets").cast("long").alias("p"), F.col("bytes").cast("long").alias("b"), F.col("last_seen").alias("seen"))
    base = base.select("proto_num", "port", "hour", "src", "dst", "p", "b", "seen",
                       *[F.when(F.col(a).isNull(), F.col(f"{a}_ip")).alias(f"{a}_text") for a in ("src", "dst")])
    base = base.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *base.columns)
    kinds = {"set": "int", "code": "long", "num": "int", "text": "string", "text2": "string", "hours": "long", "protos": "long",
             "p": "long", "b": "long", "seen": "timestamp_ntz"}
    has_bit = F.coalesce(F.col("proto_num").between(0, _PROTO_BITS - 1), F.lit(False))
    bits = {"hours": _bit(F.coalesce("hour", F.lit(_NO_HOUR))), "protos": F.when(has_bit, _bit(F.col("proto_num")))}
    held = {_PORT_PROTO: {"num": F.col("port"), "code": F.col("proto_num")}, _HOUR: {"num": F.col("hour")},
            _SRC: {"code": F.col("src"), "text": F.col("src_text")},
            _SRC_DST: {"code": _pair("src", "dst"), "text": _address("src"), "text2": _address("dst")}}
    for i, num, address in ((_ODD_SRC, "proto_num", "src"), (_ODD_DST, "proto_num", "dst"),
                            (_PORT_SRC, "port", "src"), (_PORT_DST, "port", "dst")):
        held[i] = {"code": _pair(num, address), "num": F.col(num), "text": _address(address)}
    wide = []
    for i, row in sorted(held.items()):
        row["set"] = F.when(~has_bit, F.lit(i)) if i in (_ODD_SRC, _ODD_DST) else F.lit(i)
        if "text" in row:
            row.update({c: F.when(row["code"].isNull(), row[c]) for c in ("num", "text", "text2") if c in row})
        if i in (_SRC, _PORT_DST):
            row.update(bits)
        if i in _SUMMED:
            row.update({c: F.col(c) for c in ("p", "b", "seen")})
        wide += [row.get(c, F.lit(None)).cast(t).alias(f"{c}_{i}") for c, t in kinds.items()]
    each = ", ".join(f"({', '.join(f'{c}_{i}' for c in kinds)}) AS `{i}`" for i in sorted(held))
    rows = spark.sql(f"SELECT * FROM {{rows}} UNPIVOT INCLUDE NULLS (({', '.join(f'`{c}`' for c in kinds)}) FOR name IN ({each}))", rows=base.select(*wide))
    return rows.where("`set` IS NOT NULL").groupBy("set", "code", "num", "text", "text2").agg(
        *[F.bit_or(c).alias(c) for c in bits], F.max("seen").alias("seen"), F.count("p").alias("np"), F.count("b").alias("nb"),
        *[F.sum(x).alias(f"{v}{k}") for v in "pb" for k, x in (
            ("1", F.col(v).cast("decimal(19,0)")), ("2", (F.col(v).cast("decimal(19,0)") * F.col(v)).cast("decimal(38,0)")))])


_SUMS = [("seen", "timestamp_ntz"), ("np", "long"), ("nb", "long"), *[(c, "decimal(38,0)") for c in ("p1", "p2", "b1", "b2")]]
_VALUES = "struct<" + ",".join(f"{c}:{t}" for c, t in _SUMS).replace(":long", ":bigint") + ">"
_KEY = [("family", "int"), ("num", "int"), ("address", "long"), ("text", "string")]
_ROWS = "array<struct<" + ",".join(f"{c}:{t}" for c, t in (
    *_KEY, *_SUMS, *[(m, "bigint") for m in _MEMBERS.values()])).replace(":long", ":bigint") + ">>"
#: Stands for destinations, of which only the hours are wanted.
_DESTINATION = len(FAMILY_KEYS)


def family_statistics(flows: DataFrame) -> DataFrame:
    """All per-family statistics in ONE pass over the flows.

    A first aggregation (``_counted_sets``) finds the distinct pairs that the rules
    count and exact sums of values and squares; a second one turns pair rows into
    families: a distinct count is the number of a key's pairs. A third one counts the
    sources and destinations of each hour by their hours. All combine map-side. Output
    rows ≤ 256 protocols + 65,536 ports + 24 hours + #sources, so it is materialised
    once and every rule family is derived from it.
    """
    keyed = [c for c, _ in _KEY]

    def claim(family, *key, num=None, member=None, other=None, sums=False, bits=False):
        counted = F.when(F.col(other).isNotNull(), list(_MEMBERS.values()).index(member)) if member else F.lit(None)
        return F.struct(
            F.lit(family).alias("family"), *[(F.col(c) if c in key else F.col(num) if num and c == "num" else F.lit(None)).cast(t).alias(c) for c, t in _KEY[1:]],
            *[(F.col(c) if bits else F.lit(None)).cast("long").alias(c) for c in ("hours", "protos")],
            counted.cast("int").alias("member"),
            (F.struct(*[F.col(c) for c, _ in _SUMS]) if sums else F.lit(None)).cast(_VALUES).alias("values"))

    source, number = ("address", "text"), ("num",)
    claims = {_PORT_PROTO: [claim(0, num="other", member="d_port", other="num", sums=True), claim(1, *number, member="d_proto", other="other", sums=True)],
              _HOUR: [claim(2, *number, sums=True)],
              _SRC: [claim(3, *source, sums=True, bits=True)],
              _ODD_SRC: [claim(0, *number, member="d_src", other="known"), claim(3, *source, member="d_proto", other="num")],
              _ODD_DST: [claim(0, *number, member="d_dst", other="known")],
              _PORT_SRC: [claim(1, *number, member="d_src", other="known"), claim(3, *source, member="d_port", other="num")],
              _PORT_DST: [claim(1, *number, member="d_dst", other="known"), claim(_DESTINATION, *source, bits=True)],
              _SRC_DST: [claim(3, *source, member="d_dst", other="known2")]}
    made = F.lit(None)
    for i, of in claims.items():
        made = F.when(F.col("set") == i, F.array(*of)).otherwise(made)
    high, low = F.call_function("shiftright", "code", F.lit(32)), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF))
    packed, both = F.col("code").isNotNull() & (F.col("set") > _HOUR), F.col("set") == _SRC_DST
    pairs = _counted_sets(flows).select(
        "set", "hours", "protos", *[c for c, _ in _SUMS], F.when(F.col("set") == _PORT_PROTO, F.col("code")).cast("int").alias("other"),
        F.when(~packed, F.col("num")).when(~both, high.cast("int")).alias("num"),
        F.when(packed, F.when(both, high.bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(low)).otherwise(net.ipv4_to_long("text")).alias("address"),
        "text", F.when(packed, F.lit(True)).otherwise(F.when(F.col("text").isNotNull(), True)).alias("known"),
        F.when(packed, F.lit(True)).otherwise(F.when(F.col("text2").isNotNull(), True)).alias("known2"))
    pairs = pairs.withColumn("text", F.when(F.col("address").isNull(), F.col("text")))
    added = [F.max("seen").alias("seen"), *[F.sum(c).alias(c) for c, _ in _SUMS[1:]], *[F.sum(m).alias(m) for m in _MEMBERS.values()]]
    of_key = (pairs.select(F.explode(made).alias("r"))
              .select(*[f"r.{c}" for c in (*keyed, "hours", "protos")], *[F.col(f"r.values.{c}").alias(c) for c, _ in _SUMS],
                      *[F.coalesce(F.col("r.member") == i, F.lit(False)).cast("long").alias(m) for i, m in enumerate(_MEMBERS.values())])
              .groupBy(*keyed).agg(*[F.bit_or(c).alias(c) for c in ("hours", "protos")], *added))

    def of_bits(name, bits, family, num):
        """An address counts once for each of its bits."""
        counts = {"d_src": F.col("family") == 3, "d_dst": F.col("family") == _DESTINATION}
        known = F.col("text").isNotNull() | F.col("address").isNotNull()
        each = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: F.col(name).bitwiseAND(_bit(i)) != 0),
            lambda i: F.struct(F.lit(family).alias("family"), num(i).cast("int").alias("num"),
                               *[F.lit(None).cast(t).alias(c) for c, t in (*_KEY[2:], *_SUMS)],
                               *[(known & counts.get(m, F.lit(False))).cast("long").alias(m) for m in _MEMBERS.values()]))
        return F.when(F.col(name) != 0, each).otherwise(F.array().cast(_ROWS))

    own = F.struct(*keyed, *[c for c, _ in _SUMS], *[
        (F.col(m) + F.coalesce(F.bit_count("protos"), F.lit(0)) if m == "d_proto" else F.col(m)).alias(m) for m in _MEMBERS.values()])
    rows = F.concat(F.when(F.col("family") != _DESTINATION, F.array(own)).otherwise(F.array().cast(_ROWS)),
                    of_bits("hours", _NO_HOUR + 1, 2, lambda h: F.when(h < _NO_HOUR, h)),
                    of_bits("protos", _PROTO_BITS, 0, lambda n: n))
    sums = of_key.select(F.explode(rows).alias("r")).select("r.*").groupBy(*keyed).agg(*added)

    gid = F.element_at(F.array(*[F.lit(_gid(k)) for k in FAMILY_KEYS]), F.col("family") + 1)
    keys = [F.when(F.col("family") == i, F.coalesce("text", net.long_to_ipv4("address")) if k == "src_ip" else F.col("num")).alias(k)
            for i, k in enumerate(FAMILY_KEYS)]
    sums = sums.select(*keys, "family", "seen", *[c for c, _ in _SUMS[1:]], *_MEMBERS.values())
    return sums.select(
        *FAMILY_KEYS, gid.cast("long").alias("gid"), F.col("seen").alias("max_seen"), *moments_of("p"), F.col("np").alias("n"),
        F.col("p1").cast("long").alias("p_sum"), *moments_of("b"),
        *[F.when(F.col(c).isNotNull(), F.lit(1).cast("long")).otherwise(F.col(d)).alias(d) if c in FAMILY_KEYS else F.col(d)
          for c, d in _MEMBERS.items()])


def _single_family(flows: DataFrame, key: str) -> DataFrame:
    """Statistics of one family only (plain hash aggregation on its key)."""
    base = flows.select("proto_num", "port", hour_of("last_seen").alias("hour"), "src_ip", "dst_ip",
                        "packets", "bytes")
    return base.where(F.col(key).isNotNull()).groupBy(key).agg(
        F.lit(_gid(key)).alias("gid"),
        F.avg("packets").alias("p_avg"), F.stddev_samp("packets").alias("p_std"),
        F.count("packets").alias("n"), F.sum("packets").alias("p_sum"),
        F.avg("bytes").alias("b_avg"), F.stddev_samp("bytes").alias("b_std"),
        *[F.count_distinct(c).alias(a) for c, a in
          [("port", "d_port"), ("src_ip", "d_src"), ("dst_ip", "d_dst"), ("proto_num", "d_proto")] if c != key],
        *[F.lit(1).cast("long").alias(a) for c, a in
          [("port", "d_port"), ("src_ip", "d_src"), ("dst_ip", "d_dst"), ("proto_num", "d_proto")] if c == key])


def _family(flows: DataFrame, stats: DataFrame | None, key: str) -> DataFrame:
    st = stats if stats is not None else _single_family(flows, key)
    return (st.where((F.col("gid") == _gid(key)) & F.col(key).isNotNull())
            .select(key, F.round("p_avg", 2).alias("packets_mean"), F.round("p_std", 2).alias("packets_std"),
                    "n", "p_sum", F.round("b_avg", 2).alias("bytes_mean"), F.round("b_std", 2).alias("bytes_std"),
                    "d_port", "d_src", "d_dst", "d_proto"))


def _threshold(col: str) -> F.Column:
    m, s = F.col(f"{col}_mean"), F.col(f"{col}_std")
    return F.coalesce(m + F.lit(K.STD_MULTIPLIER) * s, m * K.NO_STD_MULTIPLIER)


def _trunc(col, factor: float) -> F.Column:
    return F.floor(F.col(col) * F.lit(factor)).cast("long") if isinstance(col, str) \
        else F.floor(col * F.lit(factor)).cast("long")


def protocol_rules(flows: DataFrame, created_at, stats: DataFrame | None = None) -> DataFrame:
    """One rule per protocol number: mean + 2 std thresholds (3 x mean when
    the std is undefined), distinct counts x 1.5 truncated."""
    ca = ntz_literal(created_at)
    g = _family(flows, stats, "proto_num")
    label = net.rule_protocol_label("proto_num")
    return conform_rules(g.select(
        F.concat(F.lit("ML_PROTOCOL_"), F.col("proto_num").cast("string"), F.lit("_"), _stamp(ca)).alias("rule_id"),
        F.lit(K.RULE_PROTOCOL).alias("rule_type"), F.lit(0).alias("family_order"),
        F.col("proto_num").alias("protocol"), label.alias("protocol_name"),
        F.lit("MEDIUM").alias("severity"),
        F.concat(F.lit("ML-generated protocol anomaly rule for "), label).alias("description"),
        F.lit(K.PROTOCOL_RULE_CONFIDENCE).alias("confidence"), ca.alias("created_at"),
        _threshold("packets").alias("packets_threshold"), _threshold("bytes").alias("bytes_threshold"),
        _trunc("d_port", K.DISTINCT_MULTIPLIER).alias("unique_ports_threshold"),
        _trunc("d_src", K.DISTINCT_MULTIPLIER).alias("unique_src_ips_threshold"),
        _trunc("d_dst", K.DISTINCT_MULTIPLIER).alias("unique_dst_ips_threshold"),
        F.col("packets_mean").alias("avg_packets"), F.col("bytes_mean").alias("avg_bytes"),
        F.col("n").alias("flow_count")))


def port_rules(flows: DataFrame, created_at, stats: DataFrame | None = None) -> DataFrame:
    """One rule per port seen in more than 10 flows; severity by port class."""
    ca = ntz_literal(created_at)
    g = _family(flows, stats, "port").where(F.col("n") > K.PORT_RULE_MIN_FLOWS)
    return conform_rules(g.select(
        F.concat(F.lit("ML_PORT_"), F.col("port").cast("string"), F.lit("_"), _stamp(ca)).alias("rule_id"),
        F.lit(K.RULE_PORT).alias("rule_type"), F.lit(1).alias("family_order"), F.col("port"),
        net.port_severity("port").alias("severity"),
        F.concat(F.lit("ML-generated port anomaly rule for port "), F.col("port").cast("string")).alias("description"),
        F.lit(K.PORT_RULE_CONFIDENCE).alias("confidence"), ca.alias("created_at"),
        _threshold("packets").alias("packets_threshold"), _threshold("bytes").alias("bytes_threshold"),
        _trunc("d_src", K.DISTINCT_MULTIPLIER).alias("unique_src_ips_threshold"),
        _trunc("d_dst", K.DISTINCT_MULTIPLIER).alias("unique_dst_ips_threshold"),
        _trunc("d_proto", K.DISTINCT_MULTIPLIER).alias("protocols_threshold"),
        F.col("packets_mean").alias("avg_packets"), F.col("bytes_mean").alias("avg_bytes"),
        F.col("n").alias("flow_count")))


def temporal_rules(flows: DataFrame, created_at, stats: DataFrame | None = None) -> DataFrame:
    """One rule per hour of day (of ``last_seen``): mean x 1.5 thresholds."""
    ca = ntz_literal(created_at)
    g = _family(flows, stats, "hour")
    hh = F.lpad(F.col("hour").cast("string"), 2, "0")
    return conform_rules(g.select(
        F.concat(F.lit("ML_TEMPORAL_"), hh, F.lit("_"), _stamp(ca)).alias("rule_id"),
        F.lit(K.RULE_TEMPORAL).alias("rule_type"), F.lit(2).alias("family_order"),
        F.col("hour"), F.lit("LOW").alias("severity"),
        F.concat(F.lit("ML-generated temporal anomaly rule for hour "), hh, F.lit(":00")).alias("description"),
        F.lit(K.TEMPORAL_RULE_CONFIDENCE).alias("confidence"), ca.alias("created_at"),
        (F.col("packets_mean") * K.TEMPORAL_MULTIPLIER).alias("packets_threshold"),
        (F.col("bytes_mean") * K.TEMPORAL_MULTIPLIER).alias("bytes_threshold"),
        _trunc("d_src", K.TEMPORAL_DISTINCT_MULTIPLIER).alias("unique_src_ips_threshold"),
        _trunc("d_dst", K.TEMPORAL_DISTINCT_MULTIPLIER).alias("unique_dst_ips_threshold"),
        F.col("packets_mean").alias("avg_packets"), F.col("bytes_mean").alias("avg_bytes"),
        F.col("n").alias("flow_count")))


def source_behaviour(flows: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per source IP: packet sum/mean/count, byte mean, distinct
    destinations, ports and protocols (rounded to 2 like the other stats)."""
    return _family(flows, stats, "src_ip").select(
        "src_ip", "p_sum", F.col("packets_mean").alias("p_mean"), "n", F.col("bytes_mean").alias("b_mean"),
        "d_dst", "d_port", "d_proto")


def behavioral_rules(flows: DataFrame, created_at, quantile: float = K.BEHAVIORAL_QUANTILE,
                     stats: DataFrame | None = None) -> DataFrame:
    """Rules for sources whose packet total, distinct destinations or
    distinct ports is strictly above the 95th percentile over all sources.

    The per-source table is materialised once (it feeds three exact
    quantiles and the final filter; ``functions.quantile``).
    """
    from netweave.session import materialize
    src = source_behaviour(flows, stats)
    if stats is None:
        src = materialize(src)
    qs = exact_quantiles(src, ["p_sum", "d_dst", "d_port"], quantile)
    cond = F.lit(False)
    for c in ["p_sum", "d_dst", "d_port"]:
        if qs[c] is not None:
            cond = cond | (F.col(c) > F.lit(float(qs[c])))
    ca = ntz_literal(created_at)
    return conform_rules(src.where(cond).select(
        F.concat(F.lit("ML_BEHAVIOR_"), F.regexp_replace("src_ip", r"\.", "_"), F.lit("_"), _stamp(ca)).alias("rule_id"),
        F.lit(K.RULE_BEHAVIORAL).alias("rule_type"), F.lit(3).alias("family_order"), F.col("src_ip"),
        F.lit("HIGH").alias("severity"),
        F.concat(F.lit("ML-generated behavioral anomaly rule for source IP "), F.col("src_ip")).alias("description"),
        F.lit(K.BEHAVIORAL_RULE_CONFIDENCE).alias("confidence"), ca.alias("created_at"),
        (F.col("p_sum") * K.BEHAVIORAL_TOTAL_FACTOR).alias("total_packets_threshold"),
        (F.col("p_mean") * K.BEHAVIORAL_MEAN_FACTOR).alias("avg_packets_per_flow_threshold"),
        _trunc("d_dst", K.BEHAVIORAL_DISTINCT_FACTOR).alias("unique_destinations_threshold"),
        _trunc("d_port", K.BEHAVIORAL_DISTINCT_FACTOR).alias("unique_ports_threshold"),
        _trunc("d_proto", K.BEHAVIORAL_DISTINCT_FACTOR).alias("unique_protocols_threshold"),
        F.col("p_sum").alias("total_packets"), F.col("p_mean").alias("avg_packets_per_flow"),
        F.col("d_dst").alias("unique_destinations"), F.col("d_port").alias("unique_ports"),
        F.col("d_proto").alias("unique_protocols"), F.col("n").alias("flow_count")))


def generate_rules(flows: DataFrame, created_at=None) -> DataFrame:
    """All four families, concatenated in family order (bag union), from
    one materialised ``family_statistics`` pass over the flows.

    ``created_at`` defaults to the newest ``last_seen`` of the flows, read
    from the (small) statistics table instead of another scan. The result
    is a union of projections over the checkpointed statistics, so using it
    several times re-reads only that small table.
    """
    return generate_rules_at(flows, created_at)[0]


def generate_rules_at(flows: DataFrame, created_at=None):
    """``generate_rules`` plus the ``created_at`` it used."""
    from netweave.session import materialize
    return rules_from_statistics(materialize(family_statistics(flows)), created_at)


def rules_from_statistics(st: DataFrame, created_at=None):
    """All four families from a materialised statistics table, and the
    ``created_at`` used."""
    if created_at is None:
        created_at = st.agg(F.max("max_seen")).first()[0]
    rules = (protocol_rules(st, created_at, st)
             .unionByName(port_rules(st, created_at, st))
             .unionByName(temporal_rules(st, created_at, st))
             .unionByName(behavioral_rules(st, created_at, stats=st)))
    return rules, created_at


def rules_by_type(rules: DataFrame, rule_type: str) -> DataFrame:
    return rules.where(F.col("rule_type") == rule_type)


def latest_rules(rules: DataFrame) -> DataFrame:
    """Keep only the newest rule per target (family + key) when batches were
    appended repeatedly."""
    w = Window.partitionBy("rule_type", "protocol", "port", "hour", "src_ip") \
        .orderBy(F.col("created_at").desc(), F.col("rule_id").desc())
    return rules.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def rule_generation_summary(rules: DataFrame) -> DataFrame:
    """Rule count per family plus the total (long form, families with no
    rule report 0)."""
    names = {K.RULE_PROTOCOL: "protocol_rules", K.RULE_PORT: "port_rules",
             K.RULE_TEMPORAL: "temporal_rules", K.RULE_BEHAVIORAL: "behavioral_rules"}
    fam = rules.sparkSession.createDataFrame([(names[f], f) for f in K.RULE_FAMILIES],
                                             "metric string, rule_type string")
    per = rules.groupBy("rule_type").agg(F.count(F.lit(1)).alias("n"))
    fams = (F.broadcast(fam).join(per, "rule_type", "left")
            .select("metric", F.coalesce("n", F.lit(0)).cast("long").alias("value")))
    total = per.agg(F.lit("total_rules").alias("metric"),
                    F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("value"))
    return fams.unionByName(total)


def rule_statistics(rules: DataFrame) -> DataFrame:
    """Long form (metric, key, value): total, per type, per severity, the
    mean confidence (0 without rules) and the four-family breakdown."""
    per = rules.groupBy("rule_type", "severity").agg(F.count(F.lit(1)).alias("n"),
                                                     F.sum("confidence").alias("conf_sum"))
    total = per.agg(F.lit("total_rules").alias("metric"), F.lit("").alias("key"),
                    F.coalesce(F.sum("n"), F.lit(0)).cast("double").alias("value"))
    by_type = per.groupBy("rule_type").agg(F.sum("n").cast("double").alias("value")) \
        .select(F.lit("rule_types").alias("metric"), F.col("rule_type").alias("key"), "value")
    by_sev = per.groupBy("severity").agg(F.sum("n").cast("double").alias("value")) \
        .select(F.lit("severity_distribution").alias("metric"), F.col("severity").alias("key"), "value")
    # Rounded to 10 decimals: the mean is then independent of summation order.
    avg_conf = per.agg(F.lit("avg_confidence").alias("metric"), F.lit("").alias("key"),
                       F.round(F.coalesce(F.sum("conf_sum") / F.sum("n"), F.lit(0.0)), 10).alias("value"))
    fam = rules.sparkSession.createDataFrame([(f, i) for i, f in enumerate(K.RULE_FAMILIES)],
                                             "rule_type string, i int")
    breakdown = (F.broadcast(fam).join(per.groupBy("rule_type").agg(F.sum("n").alias("n")), "rule_type", "left")
                 .select(F.lit("rule_breakdown").alias("metric"), F.col("rule_type").alias("key"),
                         F.coalesce("n", F.lit(0)).cast("double").alias("value")))
    return total.unionByName(by_type).unionByName(by_sev).unionByName(avg_conf).unionByName(breakdown)


# --- rule application ------------------------------------------------------------

ORDER_FIELDS = ["created_at", "family_order", "r_protocol", "r_port", "r_hour", "r_src_ip", "rule_id"]
RULE_INFO = ["rule_id", "rule_type", "severity", "description", "confidence"]
RULE_STRUCT_TYPE = ("struct<created_at:timestamp_ntz,family_order:int,r_protocol:int,r_port:int,r_hour:int,"
                    "r_src_ip:string,rule_id:string,rule:struct<rule_id:string,rule_type:string,"
                    "severity:string,description:string,confidence:double>>")


def rule_lookup(rules: DataFrame) -> DataFrame:
    """Rules as (family, match key, packet threshold, sortable rule struct).

    The match key is the family's flow attribute as text: protocol number,
    port, hour of ``last_seen`` or source IP. Behavioral rules compare the
    flow's packets with the per-flow average threshold.
    """
    key = (F.when(F.col("family_order") == 0, F.col("protocol").cast("string"))
           .when(F.col("family_order") == 1, F.col("port").cast("string"))
           .when(F.col("family_order") == 2, F.col("hour").cast("string"))
           .otherwise(F.col("src_ip")))
    thr = F.when(F.col("family_order") == 3, F.col("avg_packets_per_flow_threshold")) \
        .otherwise(F.col("packets_threshold"))
    order = F.struct(F.col("created_at"), F.col("family_order"), F.col("protocol").alias("r_protocol"),
                     F.col("port").alias("r_port"), F.col("hour").alias("r_hour"),
                     F.col("src_ip").alias("r_src_ip"), F.col("rule_id"),
                     F.struct(*RULE_INFO).alias("rule"))
    return rules.select(F.col("family_order").alias("__fam"), key.alias("__key"), thr.alias("__thr"),
                        order.alias("__rule"))


def with_triggered(flows: DataFrame, rules: DataFrame, broadcast_max_bytes: int = BROADCAST_RULES_MAX_BYTES) -> DataFrame:
    """``flows`` plus ``__rules``: the triggered rules of each row, in rule-file
    order (empty array: none).

    Rules are grouped once per (family, key); a flow looks up its four keys and
    compares thresholds within the row, so flows are neither expanded nor
    shuffled, and rows that share an id stay apart. A family's table is
    broadcast if its measured size allows; a larger one is joined by a shuffle on
    its key, where adaptive execution splits hot keys.
    """
    lookup = rule_lookup(rules)
    width = F.length("__key") + sum((F.coalesce(F.length(F.col(f"__rule.rule.{c}")), F.lit(0))
                                     for c in ("rule_id", "rule_type", "severity", "description")), F.lit(160))
    sizes = dict(lookup.groupBy("__fam").agg(F.sum(width)).collect())
    keys = [F.col("proto_num").cast("string"), F.col("port").cast("string"),
            hour_of("last_seen").cast("string"), F.col("src_ip")]
    out, found = flows, []
    for family, key in enumerate(keys):
        if family not in sizes:
            continue
        side = (lookup.where(F.col("__fam") == family).groupBy(F.col("__key").alias(f"__key{family}"))
                .agg(F.collect_list(F.struct("__thr", "__rule")).alias(f"__of{family}")))
        side = F.broadcast(side) if sizes[family] <= broadcast_max_bytes else side
        out = out.join(side, key == F.col(f"__key{family}"), "left")
        hit = F.filter(F.col(f"__of{family}"), lambda r: F.col("packets") > r["__thr"])
        found.append(F.coalesce(F.transform(hit, lambda r: r["__rule"]), F.array().cast(f"array<{RULE_STRUCT_TYPE}>")))
    every = F.array_sort(F.concat(*found)) if found else F.array().cast(f"array<{RULE_STRUCT_TYPE}>")
    return out.withColumn("__rules", every).drop(*[f"__{x}{i}" for i in range(len(keys)) for x in ("key", "of")])


def apply_rules(flows: DataFrame, rules: DataFrame, flow_key: str = "flow_id",
                broadcast_max_bytes: int = BROADCAST_RULES_MAX_BYTES) -> DataFrame:
    """One row per (flow, triggered rule).

    protocol / port / hour-of-``last_seen`` / source IP equality AND
    ``packets`` above the family's packet threshold (behavioral rules use
    the per-flow average threshold).
    """
    narrow = flows.select(*dict.fromkeys([flow_key, "packets", "proto_num", "port", "src_ip", "last_seen"]))
    m = with_triggered(narrow, rules, broadcast_max_bytes).select(flow_key, F.explode("__rules").alias("__rule"))
    return m.select(flow_key, *[F.col(f"__rule.rule.{c}").alias(c) for c in RULE_INFO],
                    *[F.col(f"__rule.{c}").alias(c) for c in ORDER_FIELDS if c != "rule_id"])


def triggered_rules_by_flow(flows: DataFrame, rules: DataFrame, flow_key: str = "flow_id") -> DataFrame:
    """Per flow that triggers a rule: its rules in rule-file order, their count,
    and the ``ML Rule: <description>`` reasons joined by ``'; '``. Rows are judged
    one by one; nothing is shuffled."""
    narrow = flows.select(*dict.fromkeys([flow_key, "packets", "proto_num", "port", "src_ip", "last_seen"]))
    return _rule_columns(with_triggered(narrow, rules).where(F.size("__rules") > 0), flow_key)


def _rule_columns(rows: DataFrame, flow_key: str) -> DataFrame:
    return rows.select(
        flow_key,
        F.transform("__rules", lambda x: x["rule"]).alias("ml_triggered_rules"),
        F.size("__rules").alias("ml_rule_count"),
        F.array_join(F.transform("__rules", lambda x: F.concat(F.lit(K.ML_REASON_PREFIX), x["rule"]["description"])),
                     K.REASON_SEPARATOR).alias("ml_reasons"),
        F.array_join(F.transform("__rules", lambda x: x["rule"]["rule_id"]), ";").alias("ml_rule_ids"),
    )


def triggered_by_flow(triggered: DataFrame, flow_key: str = "flow_id") -> DataFrame:
    """Per flow: triggered rules in rule-file order, their count and the
    ``ML Rule: <description>`` reasons joined by ``'; '``."""
    order = F.struct(F.col("created_at"), F.col("family_order"), F.col("r_protocol"), F.col("r_port"),
                     F.col("r_hour"), F.col("r_src_ip"), F.col("rule_id"),
                     F.struct("rule_id", "rule_type", "severity", "description", "confidence").alias("rule"))
    g = (triggered.groupBy(flow_key)
         .agg(F.array_sort(F.collect_list(order)).alias("__rules")))
    return _rule_columns(g, flow_key)
