"""Approximate nearest neighbours with a hash-prefix forest.

Every tree gives a vector a string of ``BITS`` bits, one a random hyperplane, and
keeps the strings of its vectors in a sorted array. A query descends each tree by
binary search to its longest prefix match; ascending all trees at once, one bit at
a time, brings in the vectors that share a shorter prefix, until enough candidates
are met. Candidates are ranked by their cosine in double precision.

The forest is kept in segments, one an Arrow batch of a partition, each with its
own sorted arrays, so no array grows with the table; what a query meets at a
prefix length is the sum over segments. Two passes: the first counts, for each
query and prefix length, the strings met in all trees; the second gathers the
candidates at the length settled on, keeps each partition's ``k`` best and ranks
those. Queries that met fewer than ``k`` candidates there (one vector can give a
string to every tree) gather again at half the length, at most six times, down to
all vectors. Queries are taken in blocks of ``QUERY_BLOCK``, which bounds what is
broadcast; each block is two passes over the vectors.

How many strings are enough is measured, not guessed: ``CALIBRATION`` queries,
chosen by hash, are compared with all vectors in the first pass, and the number
is the least that finds ``recall`` of their true neighbours.

Vectors that are null, zero, or hold a null or non-finite component, or whose
length is not that of most vectors, and rows without id take no part. Rows that
repeat an id are separate candidates. A query is not its own candidate: no row
with its id is. Fewer candidates than ``k``: all of them. An empty table gives an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from copy import copy
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.llm.scratch import written

TREES = 24
BITS = 32
NEIGHBOURS = 5
QUERY_BLOCK = 50_000
CALIBRATION = 200
RECALL = 0.96
#: Vectors of one segment.
SEGMENT = 8192
_FOUND = "query_id long, vec_id long, score double"


def _strings(vectors: np.ndarray) -> np.ndarray:
    """Bit strings, trees x vectors, as unsigned integers."""
    planes = np.random.default_rng(7).standard_normal((TREES, BITS, vectors.shape[1]))
    out = np.zeros((TREES, len(vectors)), np.uint64)
    for t in range(TREES):
        bits = vectors @ planes[t].T > 0
        out[t] = np.packbits(bits, axis=1, bitorder="big").view(">u4").ravel()
    return out


def _range(ordered: np.ndarray, wanted: np.ndarray, length) -> tuple[np.ndarray, np.ndarray]:
    """Where strings that share the first ``length`` bits begin and end."""
    low = np.uint64(BITS) - np.asarray(length, np.uint64)
    first = (wanted >> low) << low
    return (np.searchsorted(ordered, first),
            np.searchsorted(ordered, first + ((np.uint64(1) << low) - np.uint64(1)), side="right"))


def _cosines(vectors: np.ndarray, norms: np.ndarray, query: np.ndarray, norm: float) -> np.ndarray:
    return np.sum(vectors * query, axis=1) / (norms * norm)


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the ``k`` best, ties to the smaller id."""
    if len(ids) > 4 * k:
        floor = np.partition(scores, len(scores) - k)[len(scores) - k]
        some = np.flatnonzero(scores >= floor)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


class _Queries:
    """A block of queries; the first ``calibrated`` are for calibration."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, calibrated: int):
        self.ids, self.vectors, self.calibrated = ids, vectors, calibrated
        self.norms = np.sqrt(np.sum(vectors * vectors, axis=1))
        self.strings = _strings(vectors)
        self.length: np.ndarray | None = None  # prefix length settled on

    def only(self, some: np.ndarray) -> _Queries:
        """Some of the queries, at their prefix lengths."""
        out = copy(self)
        out.ids, out.vectors, out.norms, out.length = self.ids[some], self.vectors[some], self.norms[some], self.length[some]
        out.strings, out.calibrated = self.strings[:, some], 0
        return out


def _segments(batches, dim: int):
    """(ids, vectors, norms) of at most SEGMENT rows."""
    for batch in batches:
        for lo in range(0, batch.num_rows, SEGMENT):
            part = batch.slice(lo, SEGMENT)
            vectors = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
            yield part.column(0).to_numpy(zero_copy_only=False), vectors, np.sqrt(np.sum(vectors * vectors, axis=1))


def _count(vectors: DataFrame, queries: _Queries, dim: int, k: int) -> tuple[np.ndarray, list]:
    """Strings met per query and prefix length 0 .. BITS; for calibration
    queries, the best true neighbours as (query, id, score, longest prefix)."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def task(batches):
        q = shared.value
        met = np.zeros((len(q.ids), BITS + 1), np.int64)
        near = [[] for _ in range(q.calibrated)]
        for ids, x, norms in _segments(batches, dim):
            strings = _strings(x)
            for t in range(TREES):
                ordered = np.sort(strings[t])
                for length in range(BITS + 1):
                    lo, hi = _range(ordered, q.strings[t], length)
                    met[:, length] += hi - lo
            for i in range(q.calibrated):
                other = np.flatnonzero(ids != q.ids[i])
                scores = _cosines(x[other], norms[other], q.vectors[i], q.norms[i])
                top = _best(ids[other], scores, k)
                rows = other[top]
                differ = (strings[:, rows] ^ q.strings[:, i:i + 1]).min(axis=0)
                shared_bits = BITS - np.array([int(d).bit_length() for d in differ.tolist()], np.int64)
                near[i] = sorted([*near[i], *zip((-scores[top]).tolist(), ids[rows].tolist(), shared_bits.tolist())])[:k]
        rows = [(i, v, -s, b) for i, found in enumerate(near) for s, v, b in found]
        columns = list(zip(*rows)) if rows else [()] * 4
        near_struct = pa.StructArray.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["query", "vec_id", "score", "bits"])
        some = np.flatnonzero(met[:, 0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(some), pa.ListArray.from_arrays(np.arange(0, len(some) * (BITS + 1) + 1, BITS + 1, dtype=np.int32), met[some].ravel()),
             pa.array([None] * len(some), near_struct.type)], ["query", "met", "near"])
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1] * len(rows), pa.int64()), pa.array([None] * len(rows), pa.list_(pa.int64())), near_struct],
            ["query", "met", "near"])

    schema = "query long, met array<long>, near struct<query:long,vec_id:long,score:double,bits:long>"
    counted = written(vectors.mapInArrow(task, schema), "forest_counts")
    sums = counted.where("query >= 0").groupBy("query").agg(*[
        F.sum(F.col("met")[i]).alias(f"m{i}") for i in range(BITS + 1)]).toArrow()
    met = np.zeros((len(queries.ids), BITS + 1), np.int64)
    for i in range(BITS + 1):
        met[sums["query"].to_numpy(), i] = sums[f"m{i}"].to_numpy()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    true = (counted.where("query < 0").select("near.*").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
            .select("query", "bits").collect())
    return met, [(r["query"], r["bits"]) for r in true]


def _enough(met: np.ndarray, true: list[tuple[int, int]], recall: float) -> int:
    """Least number of strings that finds ``recall`` of the true neighbours: a
    neighbour is found if its longest shared prefix is met at that number."""
    if not true:
        return 1
    needed = np.sort([met[q, bits] if bits >= 0 else met[q, 0] for q, bits in true])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])


def _settle(met: np.ndarray, enough: int) -> np.ndarray:
    """Longest prefix at which a query has met enough strings, else 0: all."""
    reached = met >= enough
    return np.where(reached.any(axis=1), BITS - np.argmax(reached[:, ::-1], axis=1), 0)


def _gather(vectors: DataFrame, queries: _Queries, dim: int, k: int) -> DataFrame:
    """Each partition's best candidates of every query."""
    shared = vectors.sparkSession.sparkContext.broadcast(queries)

    def task(batches):
        q = shared.value
        for ids, x, norms in _segments(batches, dim):
            strings = _strings(x)
            order = np.argsort(strings, axis=1, kind="stable")
            spans = [_range(strings[t][order[t]], q.strings[t], q.length) for t in range(TREES)]
            rows = []
            for i in range(len(q.ids)):
                if q.length[i] == 0:
                    some = np.ones(len(ids), bool)
                else:
                    some = np.zeros(len(ids), bool)
                    for t in range(TREES):
                        some[order[t][spans[t][0][i]:spans[t][1][i]]] = True
                at = np.flatnonzero(some & (ids != q.ids[i]))
                scores = _cosines(x[at], norms[at], q.vectors[i], q.norms[i])
                top = _best(ids[at], scores, k)
                rows.append((np.full(len(top), q.ids[i]), ids[at[top]], scores[top]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*rows)], ["query_id", "vec_id", "score"])

    return vectors.mapInArrow(task, _FOUND)


def _all_found(vectors: DataFrame, queries: _Queries, dim: int, k: int) -> list[DataFrame]:
    """Best candidates of every query, gathered again at half the prefix length for
    queries with fewer than ``k`` until ``k`` are met or length 0, which is all."""
    parts = []
    while True:
        found = written(_gather(vectors, queries, dim, k), "forest_found")
        counts = found.groupBy("query_id").agg(F.count("*").alias("n")).where(F.col("n") >= k)
        reached = counts.select("query_id").toArrow()["query_id"].to_numpy()
        short = (queries.length > 0) & ~np.isin(queries.ids, reached)
        if not short.any():
            return [*parts, found]
        again = queries.ids[short].tolist()
        parts.append(found.join(F.broadcast(found.sparkSession.createDataFrame([(i,) for i in again], "query_id long")), "query_id", "left_anti"))
        queries = queries.only(short)
        queries.length = queries.length // 2


def nearest(embeddings: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL,
            query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id and score (cosine) of the ``k`` nearest found for
    each row of ``embeddings(vec_id, embedding)`` that ``is_query`` selects."""
    spark = embeddings.sparkSession
    vec = F.col("embedding").cast("array<double>")
    whole = (embeddings.where(F.col("vec_id").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), vec.alias("embedding"), F.coalesce(is_query, F.lit(False)).alias("asks"))
        .where(F.size("embedding") > 0)
        .where(F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))))
        .where(F.exists("embedding", lambda v: v != 0)))
    usual = whole.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if usual is None:
        return empty
    dim = usual["d"]
    whole = whole.where(F.size("embedding") == dim)
    vectors = whole.select("vec_id", "embedding")
    asking = whole.where("asks").select("vec_id", "embedding").dropDuplicates(["vec_id"])
    asked = asking.count()
    parts = []
    enough = None
    blocks = -(-asked // query_block) if asked else 0
    for b in range(blocks):
        part = asking.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id")
        got = part.toArrow()
        if not got.num_rows:
            continue
        q = _Queries(got["vec_id"].to_numpy(), got["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim),
                     min(CALIBRATION, got.num_rows) if enough is None else 0)
        met, true = _count(vectors, q, dim, k)
        if enough is None:
            enough = _enough(met, true, recall)
        q.length = _settle(met, enough)
        parts += _all_found(vectors, q, dim, k)
    if not parts:
        return empty
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (reduce(DataFrame.unionByName, parts).withColumn("rank", F.row_number().over(order))
            .where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))
