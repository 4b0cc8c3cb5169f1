"""Heavy hitters: values that make up a given share of a window's packets, or more.

A frequent-items sketch a window keeps at most ``counters`` values, whatever the number of
different ones, and merges: tasks make partial sketches, a stream keeps one in its state
a window, and stored windows combine to any longer span without reading packets again.
A count is too high by at most ``error_share(counters)`` of the window's packets and never too
low, so every value above a share is among the candidates of a sketch whose error is less.

* ``window_sketches``: rows (window_start, window_end, packets, sketch), batch or stream.
* ``estimates``: values of each sketch with their counts, at most ``k`` a sketch.
* ``combined``: stored windows as one row.
* ``heavy_hitters``: exact in two passes of a batch. The first finds candidates, at most
  ``counters`` a window; the second counts those alone, after a broadcast join of bounded
  size (or a shuffled one beyond ``BROADCAST_ROWS``), so values that are no candidates
  reach no shuffle.

Null values are no values and count for nothing; a packet without a time belongs to no
window. Ties are all returned. An empty table has no window and no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.functions.timeparts import instant_to_ntz, ntz_to_instant

COUNTERS = 4096
BROADCAST_ROWS = 1_000_000
_WINDOW = ["window_start", "window_end"]


def error_share(counters: int) -> float:
    """Largest error of a count, as a share of what was counted."""
    return 3.5 / counters


def _windowed(packets: DataFrame, seconds: int, watermark: str | None) -> DataFrame:
    rows = packets.withColumn("ts", ntz_to_instant("ts")) if packets.schema["ts"].dataType.simpleString() == "timestamp_ntz" else packets
    if watermark:
        rows = rows.withWatermark("ts", watermark)
    return rows.withColumn("w", F.window("ts", f"{seconds} seconds"))


def window_sketches(packets: DataFrame, column: str, window_seconds: int = 60, counters: int = COUNTERS,
                    watermark: str | None = None) -> DataFrame:
    """A sketch of ``column`` a window; a stream needs a ``watermark`` and gives a
    window once it is over (append mode)."""
    rows = _windowed(packets.where(F.col(column).isNotNull()), window_seconds, watermark)
    out = rows.groupBy("w").agg(F.count(F.lit(1)).alias("packets"),
                                F.expr(f"approx_top_k_accumulate(`{column}`, {int(counters)})").alias("sketch"))
    return out.select(instant_to_ntz("w.start").alias("window_start"), instant_to_ntz("w.end").alias("window_end"), "packets", "sketch")


def combined(sketches: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """All windows of ``sketches`` as one row of the same columns."""
    # By a constant: a task without rows makes no empty sketch, which Spark cannot merge.
    return sketches.groupBy(F.lit(0).alias("all")).agg(F.min("window_start").alias("window_start"), F.max("window_end").alias("window_end"),
                       F.sum("packets").cast("long").alias("packets"),
                       F.expr(f"approx_top_k_combine(sketch, {int(counters)})").alias("sketch")).drop("all")


def estimates(sketches: DataFrame, k: int = 10) -> DataFrame:
    """window_start, window_end, packets, value, estimate: the ``k`` most frequent values of each sketch."""
    top = sketches.select(*_WINDOW, "packets", F.explode(F.expr(f"approx_top_k_estimate(sketch, {int(k)})")).alias("t"))
    return top.select(*_WINDOW, "packets", F.col("t.item").alias("value"), F.col("t.count").alias("estimate"))


def heavy_hitters(packets: DataFrame, column: str, share: float = 0.01, window_seconds: int = 86_400,
                  counters: int = COUNTERS) -> DataFrame:
    """window_start, window_end, value, packets, share: exactly the values that make up
    ``share`` of a window's packets or more, with exact counts."""
    from netweave.session import materialize
    if not error_share(counters) < share <= 1:
        raise ValueError(f"{counters} counters find shares above {error_share(counters):.2g}, up to 1")
    sketches = window_sketches(packets, column, window_seconds, counters)
    found = materialize(estimates(sketches, counters).where(F.col("estimate") >= share * F.col("packets"))
                        .select(*_WINDOW, F.col("packets").alias("total"), "value"))
    side = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found.hint("merge")
    rows = _windowed(packets, window_seconds, None).select(
        instant_to_ntz("w.start").alias("window_start"), F.col(column).alias("value"))
    counts = rows.join(side, ["window_start", "value"]).groupBy(*_WINDOW, "value").agg(
        F.count(F.lit(1)).alias("packets"), F.first("total").alias("total"))
    return counts.select(*_WINDOW, "value", "packets", (F.col("packets") / F.col("total")).alias("share")).where(F.col("share") >= share)
