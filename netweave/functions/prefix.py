"""Skew-safe per-key ordered scans (running sums, previous timestamp).

A plain ``Window.partitionBy(key).orderBy(ts)`` puts every row of a key
into one task; a key holding a third of all rows would then be processed
by a single core. Here each key is split into time buckets:

1. local running sums / lag inside ``(key, bucket)`` windows (the shuffle
   spreads one key over as many tasks as it has busy buckets);
2. one summary row per ``(key, bucket)`` (partially aggregated map-side);
3. per-key offsets = sums over the key's earlier buckets and the last
   timestamp of the previous bucket (a window over the small summary table,
   ≤ span / bucket rows per key);
4. an equi-join on ``(key, bucket)`` adds the offsets back.

A burst (one key with more than ``max_rows_per_group`` rows inside one
bucket) is split further: such hot (key, bucket) groups are found with a
partially aggregated count (≤ rows / max_rows_per_group of them, counted before
they are broadcast) and cut at approximate quantiles of the time, aimed at half
the budget, so slices hold like numbers of rows however short the burst; rows of
one hot instant are cut at quantiles of the tie column. Only rows equal in both
stay together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from netweave.functions.timeparts import epoch_seconds

DEFAULT_BUCKET_SECONDS = 3600
DEFAULT_MAX_ROWS_PER_GROUP = 2_000_000
HOT_BROADCAST_MAX_ROWS = 2_000_000


def _fine_buckets(df: DataFrame, keys: list[str], ts: str, tie: str, bucket_seconds: int,
                  max_rows_per_group: int) -> DataFrame:
    """Add ``__b``: coarse time bucket, and inside hot groups a slice by rows:
    quantiles of the time, then of the tie column where one instant is hot."""
    from netweave.functions.timeparts import EPOCH_NTZ
    us = F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col(ts))
    out = df.withColumn("__us", us).withColumn(
        "__b", F.struct(F.floor(us / F.lit(bucket_seconds * 1_000_000)).cast("long").alias("t"),
                        F.lit(0).alias("s"), F.lit(0).alias("r")))
    out = _sliced(out, keys, F.col("__us"), "s", max_rows_per_group)
    return _sliced(out, keys, F.col(tie).cast("double"), "r", max_rows_per_group).drop("__us")


def _sliced(df: DataFrame, keys: list[str], order: Column, level: str, max_rows: int) -> DataFrame:
    """Cut groups (keys, __b) of more than ``max_rows`` rows at quantiles of
    ``order``; the number goes to the field ``level`` of ``__b``."""
    hot = (df.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"), F.min(order).alias("__lo"), F.max(order).alias("__hi"))
           .where((F.col("__n") > max_rows) & (F.col("__lo") < F.col("__hi"))))
    widest = hot.agg(F.max("__n"), F.count(F.lit(1))).first()
    if not widest[1]:
        return df
    pieces = -(-2 * widest[0] // max_rows)
    names = [f"__h{i}" for i in range(len(keys))]
    side = hot.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.col("__b").alias("__hb"))
    same = F.col("__b") == F.col("__hb")
    for k, n in zip(keys, names):
        same = same & F.col(k).eqNullSafe(F.col(n))
    if widest[1] <= HOT_BROADCAST_MAX_ROWS:
        side = F.broadcast(side)
    # Sketches combine map-side; an error of a piece's tenth keeps pieces near max_rows / 2.
    cuts = (df.join(side, same).groupBy(*names, "__hb")
            .agg(F.percentile_approx(order, [i / pieces for i in range(1, pieces)], 10 * pieces).alias("__cuts")))
    cuts = F.broadcast(cuts) if widest[1] * pieces <= HOT_BROADCAST_MAX_ROWS else cuts
    at = F.coalesce(F.size(F.filter("__cuts", lambda c: c < order)), F.lit(0))
    return (df.join(cuts, same, "left").withColumn("__b", F.col("__b").withField(level, F.when(F.col("__cuts").isNotNull(), at).otherwise(0)))
            .drop("__hb", "__cuts", *names))


def bucketed_scan(df: DataFrame, keys: list[str], ts: str, tie: str,
                  sums: dict[str, Column] | None = None, want_prev_ts: bool = False,
                  want_first_ts: bool = False,
                  bucket_seconds: int = DEFAULT_BUCKET_SECONDS,
                  max_rows_per_group: int = DEFAULT_MAX_ROWS_PER_GROUP) -> DataFrame:
    """Add ``run_<name>`` (inclusive running sum per key in (ts, tie) order),
    optionally ``prev_ts`` (timestamp of the key's previous row, NULL for
    the first) and ``first_ts`` (the key's earliest timestamp)."""
    sums = sums or {}
    base = _fine_buckets(df, keys, ts, tie, bucket_seconds, max_rows_per_group)
    for name, c in sums.items():
        base = base.withColumn(f"__v_{name}", c)
    w_local = Window.partitionBy(*keys, "__b").orderBy(F.col(ts), F.col(tie))
    frame = w_local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = base
    for name in sums:
        local = local.withColumn(f"__l_{name}", F.sum(f"__v_{name}").over(frame))
    if want_prev_ts:
        local = local.withColumn("__lprev", F.lag(ts).over(w_local))

    summ = base.groupBy(*keys, "__b").agg(
        *[F.sum(f"__v_{n}").alias(f"__s_{n}") for n in sums],
        F.max(ts).alias("__bmax"), F.min(ts).alias("__bmin"))
    wk = Window.partitionBy(*keys).orderBy("__b")
    offs = summ
    for name in sums:
        offs = offs.withColumn(f"__o_{name}", F.coalesce(
            F.sum(f"__s_{name}").over(wk.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    offs = offs.withColumn("__pmax", F.lag("__bmax").over(wk))
    if want_first_ts:
        offs = offs.withColumn("__first", F.min("__bmin").over(Window.partitionBy(*keys)))
    offs = offs.drop(*[f"__s_{n}" for n in sums], "__bmax", "__bmin")
    offs = offs.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys + ["__b"])],
                       *[c for c in offs.columns if c not in keys + ["__b"]])

    cond = None
    for i, k in enumerate(keys + ["__b"]):
        c = F.col(k).eqNullSafe(F.col(f"__k{i}"))
        cond = c if cond is None else cond & c
    j = local.join(offs, cond, "inner").drop(*[f"__k{i}" for i in range(len(keys) + 1)])
    out = j
    for name in sums:
        out = out.withColumn(f"run_{name}", F.col(f"__l_{name}") + F.col(f"__o_{name}"))
    if want_prev_ts:
        out = out.withColumn("prev_ts", F.coalesce("__lprev", "__pmax"))
    if want_first_ts:
        out = out.withColumn("first_ts", F.col("__first"))
    drop = ["__b", "__lprev", "__pmax", "__first"] + [f"__{p}_{n}" for n in sums for p in ("v", "l", "o")]
    return out.drop(*[c for c in drop if c in out.columns])
