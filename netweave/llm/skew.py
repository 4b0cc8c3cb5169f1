"""Joins of many rows with few, where one key may hold a large share of the rows.

The most frequent keys are found by a partially aggregated count. At most
``KEYS`` of them are treated as hot, so the table of hot keys is bounded whatever
the data; a key that is not among them holds at most one ``KEYS``-th of all rows.
A hot key's rows are dealt over one salt per ``ROWS`` of them, by a hash of the row,
and the other side's row for that key is repeated once a salt.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = 500
ROWS = 1000
MAX_SALTS = 4096


def hot_keys(rows: DataFrame, *key: str) -> DataFrame:
    """(key, __salts) of the hot keys, at most ``KEYS`` rows, held by the driver."""
    counts = rows.dropna(subset=list(key)).groupBy(*key).agg(F.count(F.lit(1)).alias("__n"))
    return hot_of_counts(counts, "__n", *key)


def hot_of_counts(counts: DataFrame, n: str, *key: str) -> DataFrame:
    """``hot_keys`` from rows per key, where column ``n`` has them already."""
    top = (counts.where(F.col(n) > ROWS).orderBy(F.col(n).desc()).limit(KEYS)
           .select(*key, F.least(F.ceil(F.col(n) / ROWS), F.lit(MAX_SALTS)).cast("int").alias("__salts")))
    return counts.sparkSession.createDataFrame(top.collect(), top.schema)


def salted_left_join(rows: DataFrame, other: DataFrame, key: str | list[str], spread: list[str], how: str = "left",
                     hot: DataFrame | None = None) -> DataFrame:
    """``rows`` joined with ``other`` on ``key``; ``other`` has one row a key or a
    few. ``spread`` are the columns that tell rows of one key apart; ``hot`` the
    hot keys, if they are known."""
    key = [key] if isinstance(key, str) else key
    hot = F.broadcast(hot_keys(rows, *key) if hot is None else hot)
    dealt = rows.join(hot, key, "left").withColumn(
        "__salt", F.when(F.col("__salts").isNull(), 0)
        .otherwise(F.pmod(F.xxhash64(*spread), F.col("__salts").cast("long"))).cast("int")).drop("__salts")
    copies = other.join(hot, key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copies, [*key, "__salt"], how).drop("__salt")
