"""Flow enrichment and shaping: private-address flags, direction, protocol
names, country by IP range, conformed columns, time parts, rule features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netweave import constants as K
from netweave.functions import net
from netweave.functions.timeparts import day_of_week, hour_of, seconds_between

# Rows of the bucketed GeoIP table we are willing to ship to every executor.
GEO_BROADCAST_MAX_ROWS = 2_000_000
GEO_BUCKET_BITS = 16


def geo_buckets(geoip: DataFrame) -> DataFrame:
    """Ranges as disjoint segments (ip_bucket, start_ip, end_ip, country), cut at
    /16 buckets. Where ranges overlap, the narrowest wins (ties: the smaller
    start, then the country's name).

    Output rows ≤ 2 x (ranges + buckets covered), independent of traffic; a
    bucket has 65,536 addresses, which bounds what is ordered together.
    """
    shift = GEO_BUCKET_BITS
    last = (1 << shift) - 1
    cut = geoip.where("start_ip <= end_ip").select(
        "start_ip", "end_ip", "country",
        F.explode(F.sequence(F.shiftright("start_ip", shift), F.shiftright("end_ip", shift))).alias("ip_bucket"))
    floor = F.shiftleft(F.col("ip_bucket"), shift)
    cut = cut.select("ip_bucket", F.greatest("start_ip", floor).alias("lo"), F.least("end_ip", floor + last).alias("hi"),
                     F.struct((F.col("end_ip") - F.col("start_ip")).alias("width"), "start_ip", "country").alias("rank"))
    edges = cut.select("ip_bucket", F.col("lo").alias("at")).union(
        cut.select("ip_bucket", (F.col("hi") + 1).alias("at"))).distinct()
    after = F.lead("at").over(Window.partitionBy("ip_bucket").orderBy("at"))
    segments = edges.withColumn("next", after).where("next IS NOT NULL")
    held = segments.join(cut, "ip_bucket").where("lo <= at AND at <= hi")
    return held.groupBy("ip_bucket", F.col("at").alias("start_ip"), (F.col("next") - 1).alias("end_ip")).agg(
        F.min("rank")["country"].alias("country"))


def with_country(flows: DataFrame, geoip: DataFrame, ip_col: str = "dst_ip",
                 out_col: str = "country",
                 broadcast_max_rows: int = GEO_BROADCAST_MAX_ROWS,
                 ip_long_col: str | None = None) -> DataFrame:
    """Country of ``ip_col`` via a bucketed range join; no match -> ``Unknown``.

    Of overlapping ranges the narrowest counts, so every flow keeps exactly one
    row. When the bucketed table is small enough (bounded arithmetically, not
    guessed) it is broadcast and flows never shuffle; otherwise distinct
    addresses are matched with a shuffle join on the bucket and joined back on
    the address. Both ways look up the same disjoint segments.
    """
    buckets = geo_buckets(geoip)
    ip_long = F.col(ip_long_col) if ip_long_col else net.ipv4_to_long(F.col(ip_col))
    # Segments are at most twice the sum of bucket spans (no explode needed).
    span = F.shiftright("end_ip", GEO_BUCKET_BITS) - F.shiftright("start_ip", GEO_BUCKET_BITS) + 1
    n_bucket_rows = 2 * geoip.agg(F.coalesce(F.sum(span), F.lit(0))).first()[0]
    if n_bucket_rows <= broadcast_max_rows:
        fl = flows.withColumn("__ip", ip_long).withColumn("__bucket", F.shiftright("__ip", GEO_BUCKET_BITS))
        g = F.broadcast(buckets.select(F.col("ip_bucket").alias("__g_bucket"),
                                       F.col("start_ip").alias("__g_start"),
                                       F.col("end_ip").alias("__g_end"),
                                       F.col("country").alias("__g_country")))
        joined = fl.join(g, (fl["__bucket"] == g["__g_bucket"])
                         & fl["__ip"].between(g["__g_start"], g["__g_end"]), "left")
        return (joined.withColumn(out_col, F.coalesce("__g_country", F.lit(K.COUNTRY_UNKNOWN)))
                .drop("__ip", "__bucket", "__g_bucket", "__g_start", "__g_end", "__g_country"))
    # Large GeoIP table: resolve each distinct address once.
    key = "__addr"
    addrs = (flows.select(ip_long.alias(key)).distinct().where(F.col(key).isNotNull())
             .withColumn("__bucket", F.shiftright(key, GEO_BUCKET_BITS)))
    matched = (addrs.join(buckets, (addrs["__bucket"] == buckets["ip_bucket"])
                          & addrs[key].between(buckets["start_ip"], buckets["end_ip"]))
               .select(key, F.col("country").alias("__g_country")))
    flows = flows.withColumn("__ip", ip_long)
    joined = flows.join(matched, flows["__ip"] == matched[key], "left")
    return (joined.withColumn(out_col, F.coalesce("__g_country", F.lit(K.COUNTRY_UNKNOWN)))
            .drop("__ip", key, "__g_country"))


def enrich_flows(flows: DataFrame, geoip: DataFrame | None = None) -> DataFrame:
    """Add protocol_name/protocol, internal flags, direction and country.

    Country is ``Internal`` for a private destination, else the GeoIP
    country of the destination (``Unknown`` when none matches or no table).
    """
    # Address -> long once per column; range tests then read that column
    # (keeps generated code small; the regex runs once per address).
    df = (flows
          .withColumn("protocol_name", net.protocol_name("proto_num"))
          .withColumn("protocol", F.col("protocol_name"))
          .withColumn("__src_long", net.ipv4_to_long("src_ip"))
          .withColumn("__dst_long", net.ipv4_to_long("dst_ip"))
          .withColumn("is_internal_src", net.in_private_ranges("__src_long"))
          .withColumn("is_internal_dst", net.in_private_ranges("__dst_long"))
          .drop("__src_long")
          .withColumn("direction", net.direction_from_flags("is_internal_src", "is_internal_dst")))
    if geoip is not None:
        # Private destinations never need a country lookup: their join key is NULL.
        df = df.withColumn("__dst_long", F.when(~F.col("is_internal_dst"), F.col("__dst_long")))
        df = with_country(df, geoip, "dst_ip", "__geo_country", ip_long_col="__dst_long")
    else:
        df = df.withColumn("__geo_country", F.lit(K.COUNTRY_UNKNOWN))
    return (df.withColumn("country", F.when(F.col("is_internal_dst"), F.lit(K.COUNTRY_INTERNAL))
                          .otherwise(F.col("__geo_country")))
            .drop("__geo_country", "__dst_long"))


# --- conformed analysis frame ---------------------------------------------------

_TEXT_DEFAULTS = ["src_ip", "dst_ip", "protocol_name", "direction", "country", "protocol"]
_BOOL_DEFAULTS = ["is_internal_src", "is_internal_dst"]
_LONG_DEFAULTS = ["bytes", "packets"]
_INT_DEFAULTS = ["dst_port", "src_port", "port", "proto_num"]
_TS_DEFAULTS = ["last_seen", "first_seen"]
REQUIRED_COLUMNS = K.REQUIRED_COLUMNS


def conform_flows(df: DataFrame) -> DataFrame:
    """Guarantee the 16 analysis columns with typed defaults and no NULLs.

    Missing columns are added ('' / false / 0 / epoch); NULLs are filled the
    same way. Other columns pass through.
    """
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    present = set(df.columns)
    adds = {}
    for c in _TEXT_DEFAULTS:
        adds[c] = F.coalesce(F.col(c).cast("string"), F.lit("")) if c in present else F.lit("")
    for c in _BOOL_DEFAULTS:
        adds[c] = F.coalesce(F.col(c).cast("boolean"), F.lit(False)) if c in present else F.lit(False)
    for c in _LONG_DEFAULTS:
        adds[c] = F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long")) if c in present else F.lit(0).cast("long")
    for c in _INT_DEFAULTS:
        adds[c] = F.coalesce(F.col(c).cast("int"), F.lit(0)) if c in present else F.lit(0)
    for c in _TS_DEFAULTS:
        adds[c] = F.coalesce(F.col(c).cast("timestamp_ntz"), epoch) if c in present else epoch
    return df.withColumns(adds)


def with_time_parts(df: DataFrame, ts_col: str = "last_seen") -> DataFrame:
    """timestamp, hour, date and day_of_week (Monday = 0) of ``ts_col``."""
    return df.withColumns({
        "timestamp": F.col(ts_col),
        "hour": hour_of(ts_col),
        "date": F.to_date(ts_col),
        "day_of_week": day_of_week(ts_col),
    })


def upload_enrichment(df: DataFrame) -> DataFrame:
    """Derived fields for uploaded rows: full enrichment when both addresses
    are present, else ``Unknown`` direction/country and the protocol name
    of ``protocol`` (default 6)."""
    has_ips = "src_ip" in df.columns and "dst_ip" in df.columns
    proto = F.coalesce(F.col("protocol").cast("int"), F.lit(6)) if "protocol" in df.columns else F.lit(6)
    src = F.col("src_ip") if has_ips else F.lit(None).cast("string")
    dst = F.col("dst_ip") if has_ips else F.lit(None).cast("string")
    known = src.isNotNull() & dst.isNotNull()
    df = (df.withColumn("__s_int", net.in_private_ranges(net.ipv4_to_long(src)))
          .withColumn("__d_int", net.in_private_ranges(net.ipv4_to_long(dst))))
    s_int, d_int = F.col("__s_int"), F.col("__d_int")
    df = df.withColumns({
        "src_ip": F.coalesce(src, F.lit("N/A")),
        "dst_ip": F.coalesce(dst, F.lit("N/A")),
        "proto_num": proto,
        "protocol_name": net.protocol_name(proto),
        "direction": F.when(known, net.direction_from_flags(s_int, d_int)).otherwise(F.lit("Unknown")),
        "is_internal_src": F.when(known, s_int).otherwise(F.lit(False)),
        "is_internal_dst": F.when(known, d_int).otherwise(F.lit(False)),
        "country": F.when(known & d_int, F.lit(K.COUNTRY_INTERNAL)).otherwise(F.lit(K.COUNTRY_UNKNOWN)),
    })
    return df.drop("__s_int", "__d_int")


FEATURE_COLUMNS = [
    "flow_duration", "packets_per_second", "bytes_per_packet", "packet_size_variance",
    "protocol_numeric", "port_numeric", "is_internal_src", "is_internal_dst",
    "internal_to_external", "external_to_internal", "internal_to_internal",
    "hour_of_day", "day_of_week",
]


def flow_features(df: DataFrame, keep: tuple[str, ...] = ("flow_id",)) -> DataFrame:
    """The 13 per-flow rule features (``+1`` smoothing in the ratios).

    ``packet_size_variance`` is the same ratio as ``bytes_per_packet``.
    """
    dur = seconds_between("first_seen", "last_seen")
    s = F.col("is_internal_src").cast("int")
    d = F.col("is_internal_dst").cast("int")
    bpp = F.col("bytes").cast("double") / (F.col("packets") + 1)
    cols = [F.col(k) for k in keep if k in df.columns]
    return df.select(
        *cols,
        dur.alias("flow_duration"),
        (F.col("packets").cast("double") / (dur + 1)).alias("packets_per_second"),
        bpp.alias("bytes_per_packet"),
        bpp.alias("packet_size_variance"),
        F.col("proto_num").alias("protocol_numeric"),
        F.col("port").alias("port_numeric"),
        s.alias("is_internal_src"),
        d.alias("is_internal_dst"),
        ((s == 1) & (d == 0)).cast("int").alias("internal_to_external"),
        ((s == 0) & (d == 1)).cast("int").alias("external_to_internal"),
        ((s == 1) & (d == 1)).cast("int").alias("internal_to_internal"),
        hour_of("last_seen").alias("hour_of_day"),
        day_of_week("last_seen").alias("day_of_week"),
    )
