"""Which ids a date-partitioned store can hold, without reading it.

Beside a store lies a table of Bloom filters, one a date folder of the store: rows (date,
word, bits), kept in folders by month, since a file costs more than a sparse day's rows. An id sets ``PROBES`` bits of one 64-bit word of its date's filter, so a lookup is
one equi-join, a filter is built by a partially aggregated ``bit_or``, and the filters of
several appends merge in the same way. A filter never denies a stored id; it holds an
unknown one for stored in about one of a hundred cases with ten bits an id
(``WORDS`` words: 6.7 M ids a folder), more often beyond, and only such ids need the store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS = 1 << 20
PROBES = 6
SCHEMA = "word int, bits long, date date, month date"


def filter_path(store: str) -> str:
    return store.rstrip("/") + "_members"


def _word(key: str) -> Column:
    return F.pmod(F.xxhash64(F.col(key)), F.lit(WORDS).cast("long")).cast("int")


def _bits(key: str) -> Column:
    name = key.replace("`", "``")
    return reduce(Column.bitwiseOR, [
        F.expr(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64(`{name}`, 'bits'), {6 * i}) & 63 as int))") for i in range(PROBES)])


def filters(ids: DataFrame, key: str) -> DataFrame:
    """(word, bits, date, month) of ``ids(date, key)``."""
    return ids.select("date", _word(key).alias("word"), _bits(key).alias("bits")).groupBy("date", "word").agg(
        F.bit_or("bits").alias("bits")).select("word", "bits", "date", month_of(F.col("date")).alias("month"))


def month_of(date: Column) -> Column:
    return F.to_date(F.trunc(date, "month"))


def possible(ids: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """``ids(date, key, ...)`` with ``__possible``: whether the filters ``stored``
    (rows of any number of appends) can hold the id."""
    merged = stored.select(F.col("date").alias("__d"), F.col("word").alias("__w"), "bits").groupBy("__d", "__w").agg(
        F.bit_or("bits").alias("__bits"))
    probe = ids.withColumns({"__word": _word(key), "__mask": _bits(key)})
    held = F.coalesce(F.col("__bits").bitwiseAND(F.col("__mask")) == F.col("__mask"), F.lit(False))
    return (probe.join(merged, F.col("date").eqNullSafe(F.col("__d")) & (F.col("__word") == F.col("__w")), "left")
            .withColumn("__possible", held).drop("__d", "__w", "__bits", "__word", "__mask"))
