"""Best-fit packing with Martello-Toth dominance reduction.

Every text is encoded once and an end id is added; documents longer than a
sequence are cut into full pieces and a rest. What packing needs to know of the
corpus is how many pieces of each length there are: at most ``capacity`` counts,
whatever the input. On those counts the driver

1. *reduces* the instance: a piece together with partners that provably
   dominates every other set holding that piece is fixed for good (a partner
   that fills the sequence exactly; a single partner where two more never fit; a
   pair where three more never fit), many equal sets at a time;
2. packs the remainder by *best fit*, lengths in decreasing order, again many
   equal sequences at a time.

The plan consists of ranges - pieces ``from .. to`` of a length go to sequences
``s, s+1, ..`` at an offset - and its size depends on ``capacity``, not on the
corpus. Spark numbers the pieces of each length (in buckets with prefix sums, so
a very common length is no single task) and looks their place up in the plan.

Null text is empty (its end id alone). Repeated rows are separate documents;
a null doc_id is kept. An empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.llm import tokens
from netweave.session import scratch_path

CAPACITY = 2048
#: Pieces numbered by one task at most, about.
BUCKET_ROWS = 100_000
#: Plans up to this many ranges (six longs each) are broadcast.
PLAN_BROADCAST_ROWS = 100_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """Each document's ids, with ``end_id``, in pieces of ``capacity``."""

    def task(batches):
        enc, end = tokens.encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        step = 4 * capacity
        for batch in batches:
            ids, out = batch.column(0).to_pylist(), []
            for first, texts in tokens.groups(batch.column(1).to_pylist()):
                for i, raw in enumerate(enc.encode(texts), first):
                    raw += end
                    out += [(ids[i], k, lo // 4, (min(lo + step, len(raw)) - lo) // 4, zlib.crc32(raw[lo:lo + step]))
                            for k, lo in enumerate(range(0, len(raw), step))]
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(task, _PIECES)


@dataclass
class Plan:
    """Ranges (length, rank_from, rank_to, sequence, per_sequence, offset)."""

    capacity: int
    left: dict[int, int]
    ranges: list[tuple[int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    reduced: int = 0

    def __post_init__(self):
        self.taken = dict.fromkeys(self.left, 0)
        self.lengths = sorted(x for x, n in self.left.items() if n)

    def take(self, length: int, n: int, sequence: int, per: int, offset: int) -> None:
        """Put the next ``n`` pieces of a length into sequences from
        ``sequence`` on, ``per`` side by side in each, from ``offset``."""
        at = self.taken[length]
        self.ranges.append((length, at, at + n, sequence, per, offset))
        self.taken[length] = at + n
        self.left[length] -= n
        if not self.left[length]:
            self.lengths.pop(bisect.bisect_left(self.lengths, length))

    def fix(self, members: list[int], times: int) -> None:
        """``times`` sequences that hold one piece of each length in ``members``."""
        offset = 0
        for x in members:
            self.take(x, times, self.sequences, 1, offset)
            offset += x
        self.sequences += times
        self.reduced += times * len(members)

    def _count(self, x: int, used: list[int]) -> int:
        return self.left.get(x, 0) - used.count(x)

    def _largest(self, room: int, used: list[int]) -> int | None:
        i = bisect.bisect_right(self.lengths, room) - 1
        while i >= 0 and self._count(self.lengths[i], used) <= 0:
            i -= 1
        return self.lengths[i] if i >= 0 else None

    def _smallest(self, n: int, used: list[int], over: int = 0) -> list[int]:
        out: list[int] = []
        for x in self.lengths[bisect.bisect_right(self.lengths, over):]:
            out += [x] * min(n - len(out), max(0, self._count(x, used)))
            if len(out) >= n:
                break
        return out

    def _dominating(self, j: int) -> list[int] | None:
        """A set that dominates every feasible set holding ``j``, if one of at
        most three pieces is proven to."""
        room = self.capacity - j
        low = self._smallest(3, [j])
        if not low or low[0] > room:
            return [j]
        k = self._largest(room, [j])
        if k == room or len(low) < 2 or low[0] + low[1] > room:
            return [j, k]
        if len(low) == 3 and sum(low) <= room:
            return None
        b = self._largest(room - k, [j, k])
        if b is None:
            return None
        # Of any other pair x >= y that fits, x <= k; y <= b unless two pieces over b fit.
        over = self._smallest(2, [j], over=b)
        return [j, k, b] if len(over) < 2 or sum(over) > room else None

    def reduce(self) -> None:
        changed = True
        while changed:
            changed = False
            for j in self.lengths[::-1]:
                while self.left.get(j, 0) and (members := self._dominating(j)):
                    times = min(self.left[x] // members.count(x) for x in set(members))
                    self.fix(members, times)
                    changed = True

    def best_fit(self) -> None:
        """Lengths in decreasing order, each piece where least room stays."""
        rooms: dict[int, list[tuple[int, int]]] = {}
        keys: list[int] = []

        def put(room: int, sequence: int, n: int) -> None:
            if n and room:
                if room not in rooms:
                    rooms[room] = []
                    bisect.insort(keys, room)
                rooms[room].append((sequence, n))

        for x in self.lengths[::-1]:
            while self.left[x]:
                i = bisect.bisect_left(keys, x)
                if i == len(keys):
                    per = self.capacity // x
                    n = -(-self.left[x] // per)
                    put(self.capacity, self.sequences, n)
                    self.sequences += n
                    continue
                room = keys[i]
                sequence, n = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room]
                    keys.pop(i)
                per, want = room // x, self.left[x]
                full = min(n, want // per)
                if full:
                    self.take(x, full * per, sequence, per, self.capacity - room)
                    put(room - per * x, sequence, full)
                rest = want - full * per
                if full < n and rest:
                    self.take(x, rest, sequence + full, rest, self.capacity - room)
                    put(room - rest * x, sequence + full, 1)
                    full += 1
                put(room, sequence + full, n - full)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Plan:
    """Sequences for ``counts`` pieces of each length."""
    if any(x < 1 or x > capacity for x in counts):
        raise ValueError("lengths are 1 to capacity")
    p = Plan(capacity, dict(counts))
    p.reduce()
    p.best_fit()
    return p


def pack(spark: SparkSession, cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (see :func:`pieces`) with sequence_id and offset."""
    path = scratch_path(spark, "pieces")
    cut.write.parquet(path)
    cut = spark.read.parquet(path)
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    made = plan(counts, capacity)
    buckets = [(x, max(1, n // BUCKET_ROWS)) for x, n in counts.items()]
    wide = F.broadcast(spark.createDataFrame(buckets, "length long, buckets long"))  # capacity rows at most
    spread = cut.join(wide, "length").withColumn(
        "bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "buckets")).drop("buckets")
    sizes = spread.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (spread.withColumn("at", F.row_number().over(inside) - 1).join(bases, ["length", "bucket"])
              .withColumn("rank", F.col("base") + F.col("at")).drop("base", "at", "bucket"))
    ranges = spark.createDataFrame(made.ranges, "length long, lo long, hi long, seq long, per long, place long")
    if len(made.ranges) <= PLAN_BROADCAST_ROWS:
        ranges = F.broadcast(ranges)
    t = F.col("rank") - F.col("lo")
    joined = ranked.join(ranges, "length").where("rank >= lo AND rank < hi")
    return joined.select("doc_id", "piece", "start", "length", "ids_crc32",
                         (F.col("seq") + F.floor(t / F.col("per"))).cast("long").alias("sequence_id"),
                         (F.col("place") + F.pmod(t, "per") * F.col("length")).cast("long").alias("offset"))
