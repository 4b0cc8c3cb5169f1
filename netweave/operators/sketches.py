"""Approximate distinct counts from daily sketches (opt-in).

One pass over a day's flows makes a small table: per family key (all flows, protocol,
port, hour, source) the exact counts and moments, and a HyperLogLog sketch of the
distinct ports, sources, destinations and protocols. Sketches of days merge, so the
distinct counts of any lookback come from a few rows a key and day; the flows are
not read again. The standard error of a count is about 1.04 / sqrt(2 ** ``lg_k``),
1.6 % by default; counts and moments stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.functions.timeparts import hour_of
from netweave.operators import rules as R
from netweave.session import materialize

LG_K = 12
#: Sketch columns and the flow column whose distinct values they count.
MEMBERS = {"d_port": "port", "d_src": "src_ip", "d_dst": "dst_ip", "d_proto": "proto_num"}
_MOMENTS = ("np", "nb", "p1", "p2", "b1", "b2")
ALL_FLOWS = -1


def daily_sketches(flows: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(date, family, keys, seen, n, moments, sketches): ``family`` is the index of the key
    in ``rules.FAMILY_KEYS``, ``ALL_FLOWS`` for the day's total. Rows with a NULL key have no
    row in its family."""
    base = flows.select(F.to_date("last_seen").alias("date"), "proto_num", "port", hour_of("last_seen").alias("hour"), "src_ip", "dst_ip",
                        F.col("packets").cast("long").alias("p"), F.col("bytes").cast("long").alias("b"), "last_seen")
    kinds = {"proto_num": "int", "port": "int", "hour": "int", "src_ip": "string"}
    families = [F.struct(F.lit(ALL_FLOWS).alias("family"), *[F.lit(None).cast(t).alias(k) for k, t in kinds.items()])]
    for i, key in enumerate(R.FAMILY_KEYS):
        families.append(F.when(F.col(key).isNotNull(), F.struct(
            F.lit(i).alias("family"), *[(F.col(k) if k == key else F.lit(None)).cast(t).alias(k) for k, t in kinds.items()])))
    rows = base.select(F.explode(F.array_compact(F.array(*families))).alias("f"), "date", "p", "b", "last_seen", *[
        F.col(c).alias(f"m_{c}") for c in MEMBERS.values()])
    exact = {f"{v}{k}": F.sum(x).cast("decimal(38,0)") for v in "pb" for k, x in (
        ("1", F.col(v).cast("decimal(19,0)")), ("2", (F.col(v).cast("decimal(19,0)") * F.col(v)).cast("decimal(38,0)")))}
    return rows.groupBy("date", "f.family", *[F.col(f"f.{k}").alias(k) for k in R.FAMILY_KEYS]).agg(
        F.max("last_seen").alias("seen"), F.count(F.lit(1)).alias("n"), F.count("p").alias("np"), F.count("b").alias("nb"),
        *[x.alias(k) for k, x in exact.items()], *[F.hll_sketch_agg(f"m_{c}", F.lit(lg_k)).alias(d) for d, c in MEMBERS.items()])


def write_daily_sketches(flows: DataFrame, path: str, lg_k: int = LG_K) -> None:
    """Append the sketches of ``flows`` to the table at ``path``, in folders by date. A day
    may come in several appends: its sketches merge."""
    from netweave.sources.io import write_by_date
    write_by_date(daily_sketches(flows, lg_k), path)


def read_sketches(spark: SparkSession, path: str, since=None, until=None) -> DataFrame:
    """Sketches of the dates from ``since`` to ``until`` (dates, either may be omitted);
    other folders are not read."""
    out = spark.read.parquet(path)
    for bound, keep in ((since, "date >= DATE '{}'"), (until, "date <= DATE '{}'")):
        if bound is not None:
            out = out.where(keep.format(bound.isoformat()))
    return out


def merged(sketches: DataFrame) -> DataFrame:
    """One row a family key over all of ``sketches``: exact sums, estimated distinct counts."""
    return sketches.groupBy("family", *R.FAMILY_KEYS).agg(
        F.max("seen").alias("max_seen"), *[F.sum(c).alias(c) for c in ("n", *_MOMENTS)],
        *[F.hll_sketch_estimate(F.hll_union_agg(d)).alias(d) for d in MEMBERS])


def approx_summary(sketches: DataFrame) -> DataFrame:
    """Totals with approximate distinct sources and destinations, as in the summary
    statistics."""
    return merged(sketches.where(F.col("family") == ALL_FLOWS)).select(
        F.col("n").alias("total_flows"), F.col("d_src").alias("unique_src_ips"), F.col("d_dst").alias("unique_dst_ips"),
        F.col("b1").cast("long").alias("total_bytes"), F.col("p1").cast("long").alias("total_packets"))


def approx_top_sources(sketches: DataFrame, n: int = 10) -> DataFrame:
    """Sources with most distinct destinations, approximately (ties: by address)."""
    of = merged(sketches.where(F.col("family") == R.FAMILY_KEYS.index("src_ip")))
    return of.select("src_ip", F.col("d_dst").alias("distinct_destinations")).orderBy(F.col("distinct_destinations").desc(), "src_ip").limit(n)


def family_statistics(sketches: DataFrame) -> DataFrame:
    """The statistics that rules are generated from (``rules.family_statistics``), with
    estimated distinct counts."""
    m = merged(sketches.where(F.col("family") != ALL_FLOWS))
    gid = F.element_at(F.array(*[F.lit(R._gid(k)) for k in R.FAMILY_KEYS]), F.col("family") + 1)
    own = F.element_at(F.array(*[F.lit(d) for d in ("d_proto", "d_port", "", "d_src")]), F.col("family") + 1)
    return m.select(
        *R.FAMILY_KEYS, gid.cast("long").alias("gid"), "max_seen", *R.moments_of("p"), F.col("np").alias("n"),
        F.col("p1").cast("long").alias("p_sum"), *R.moments_of("b"),
        *[F.when(own == d, F.lit(1).cast("long")).otherwise(F.col(d)).alias(d) for d in ("d_port", "d_src", "d_dst", "d_proto")])


def generate_rules(sketches: DataFrame, created_at=None) -> DataFrame:
    """All four rule families from ``sketches``: no flow is read."""
    stats = materialize(family_statistics(sketches))
    return R.rules_from_statistics(stats, created_at)[0]

