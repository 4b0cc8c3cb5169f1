"""Quantiles without gathering a column anywhere: exact by radix refinement, or
approximate from mergeable sketches.

Exact: each wanted rank is searched by ranges of the order of doubles. The first
pass counts values by sign and binary exponent (at most some 4,300 bins a column),
which also gives the number of values, the infinities and the NaNs. Every other
pass cuts the range that holds the rank in ``BINS`` equal parts; within one binary
exponent that settles 12 of the 52 bits below it, whatever the values. So an exact
quantile takes at most ``MAX_PASSES`` passes, one aggregation each, for any number of
columns and ranks; the driver sees at most ``BINS`` rows a rank and pass. Bins are
monotone in the value and a range runs from the least to the greatest value really
found, so ranks stay exact under ties and rounding.

Approximate (opt-in): ``quantile_sketches`` makes one small KLL sketch a column and group;
sketches of parts merge, so quantiles of any lookback come from stored ones.

NULLs are ignored; -inf, finite values, +inf and NaN sort in this order.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 4096
MAX_PASSES = 6
_LOW, _HIGH, _NAN = -100_000, 100_000, 100_001
#: Above all binary exponents of doubles, in size.
_SHIFT = 2000


def _value(col: str) -> Column:
    return F.col(f"`{col}`").cast("double")


def _exponent_bin(v: Column) -> Column:
    """Sign and binary exponent as one number in the order of the values."""
    e = F.floor(F.log2(F.abs(v))).cast("int") + _SHIFT
    return (F.when(F.isnan(v), _NAN).when(v == float("inf"), _HIGH).when(v == float("-inf"), _LOW)
            .when(v > 0, e).when(v < 0, -e).otherwise(0))


def _counted(df: DataFrame, parts: list[Column]) -> list[list[tuple]]:
    """One pass: (bin, count, least, greatest) of each part, in order; a part is
    NULL where a row does not belong to it, else (t, bin, v)."""
    rows = df.select(F.explode(F.array_compact(F.array(*parts))).alias("r")).groupBy("r.t", "r.bin").agg(
        F.count(F.lit(1)).alias("n"), F.min("r.v").alias("lo"), F.max("r.v").alias("hi")).collect()
    out: list[list[tuple]] = [[] for _ in parts]
    for r in rows:
        out[r["t"]].append((r["bin"], r["n"], r["lo"], r["hi"]))
    return [sorted(b) for b in out]


def _by_exponent(df: DataFrame, cols: list[str]) -> dict[str, list[tuple]]:
    parts = [F.when(_value(c).isNotNull(), F.struct(F.lit(i).alias("t"), _exponent_bin(_value(c)).alias("bin"), _value(c).alias("v")))
             for i, c in enumerate(cols)]
    return dict(zip(cols, _counted(df, parts)))


def _find(bins: list[tuple], rank: int) -> tuple[float, float, int]:
    """Range of the bin that holds a rank, and the rank within it."""
    for _, n, lo, hi in bins:
        if rank < n:
            return lo, hi, rank
        rank -= n
    raise IndexError("rank beyond the column")


def _refine(df: DataFrame, first: dict[str, list[tuple]], ranks: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    open_ = {(c, rank): _find(first[c], rank) for c, rank in ranks}
    found: dict[tuple[str, int], float] = {}
    while True:
        for key, (lo, hi, _) in list(open_.items()):
            if lo == hi or math.isnan(lo):
                found[key] = lo
                del open_[key]
        if not open_:
            return found
        targets, parts = list(open_.items()), []
        for i, ((c, _), (lo, hi, _)) in enumerate(targets):
            v = _value(c)
            here = F.least(F.floor((v - lo) / F.lit(hi - lo) * BINS), F.lit(BINS - 1)).cast("int")
            parts.append(F.when(v.between(lo, hi), F.struct(F.lit(i).alias("t"), here.alias("bin"), v.alias("v"))))
        for (key, (_, _, rank)), bins in zip(targets, _counted(df, parts)):
            open_[key] = _find(bins, rank)


def order_statistics(df: DataFrame, ranks: list[tuple[str, int]]) -> dict[tuple[str, int], float]:
    """The value at each (column, rank from 0); ranks lie within the column."""
    return _refine(df, _by_exponent(df, list(dict.fromkeys(c for c, _ in ranks))), ranks)


def exact_quantiles(df: DataFrame, cols: list[str], q: float) -> dict[str, float | None]:
    """Quantile ``q`` of each column, as linear interpolation on the sorted
    values (``quantile_cont``); None where a column has no value."""
    first = _by_exponent(df, cols)
    sizes = {c: sum(n for _, n, _, _ in first[c]) for c in cols}
    at = {c: q * (n - 1) for c, n in sizes.items() if n}
    ranks = {c: (math.floor(p), min(math.floor(p) + 1, sizes[c] - 1)) for c, p in at.items()}
    values = _refine(df, first, list(dict.fromkeys((c, r) for c, two in ranks.items() for r in two)))
    out: dict[str, float | None] = dict.fromkeys(cols)
    for c, (low, high) in ranks.items():
        a, b = values[c, low], values[c, high]
        out[c] = a if a == b or at[c] == low else a + (b - a) * (at[c] - low)
    return out


def quantile_sketches(df: DataFrame, cols: list[str], by: list[str] | None = None, k: int = 400) -> DataFrame:
    """One KLL sketch a column and group of ``by``; the rank error of a quantile is
    about 2.3 / ``k`` at most in 99 of 100 cases. NULL and NaN are ignored."""
    sketches = [F.kll_sketch_agg_double(F.when(~F.isnan(_value(c)), _value(c)), k).alias(c) for c in cols]
    return df.groupBy(*(by or [])).agg(*sketches)


def sketched_quantiles(sketches: DataFrame, cols: list[str], q: float) -> dict[str, float | None]:
    """Quantile ``q`` of each column over all of ``sketches`` (merged, one row a group
    is read and no value of the data)."""
    merged = sketches.agg(*[F.kll_merge_agg_double(F.col(f"`{c}`")).alias(c) for c in cols])
    none = F.lit(None).cast("double")
    got = merged.select(*[
        F.when(F.kll_sketch_get_n_double(F.col(f"`{c}`")) > 0, F.kll_sketch_get_quantile_double(F.col(f"`{c}`"), F.lit(float(q)))).otherwise(none).alias(c)
        for c in cols]).first()
    return dict(zip(cols, got))
