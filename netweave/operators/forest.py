"""Spark's random forest, grown from rows of one byte a feature.

``RandomForestClassifier`` of Spark ML keeps every training row as objects of some 500
bytes (its draws for all trees among them) and, with cached nodes, another 400 bytes for
each generation of node ids. ``ForestClassifier`` has the same params and returns the same
kind of model, a ``RandomForestClassificationModel``; it grows the trees in the same way
(thresholds from a sample of rows, Poisson draws of rows for each tree, a random subset of the
features at each node, largest gain of Gini impurity, leaves of one prediction merged) but:

* Rows are packed once into blocks of at most ``BLOCK`` rows, a byte a feature (the bin) and
  one for the label. Only the blocks are kept for the passes.
* Draws come from a generator seeded by block and tree, so they are made again, not kept.
* A pass grows the nodes of all trees of one depth, or as many as ``HISTOGRAM_MB`` of counts
  hold. Within a task and block, a row's node is kept from step to step and rows that have
  reached a leaf are left out; between passes nothing of a row is kept.
* Counts are summed and splits chosen by groups of ``CHUNK`` nodes on the executors; the
  driver sees one small row a node.
* So ``cacheNodeIds``, ``checkpointInterval`` and ``maxMemoryInMB`` are accepted, but change nothing.

Nulls, NaN and infinities in features, and labels that are not whole numbers from 0 to 99,
are errors, as in Spark's; so is an empty table.
"""

from __future__ import annotations

import json
import math
import os
import time

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel, TaskContext
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a block, so that its codes and the work on them stay in a core's cache.
BLOCK = 1 << 16
#: Counts that a task holds, and nodes whose counts are summed together.
HISTOGRAM_MB, CHUNK = 64, 64
#: Resolution of the draws.
_DRAWS = 1 << 16
MAX_CLASSES = 100


def continuous_splits(values: np.ndarray, most: int) -> np.ndarray:
    """Thresholds of one feature from sampled values, at most ``most``: between all
    neighbours, or else so that like numbers of samples lie between them."""
    distinct, counts = np.unique(values, return_counts=True)
    middle = distinct[:-1] / 2 + distinct[1:] / 2
    if len(middle) <= most:
        return middle
    stride = len(values) / (most + 1)
    found, target, upto = [], stride, np.cumsum(counts)
    for i in range(1, len(distinct)):
        if abs(upto[i - 1] - target) < abs(upto[i] - target):
            found.append(middle[i - 1])
            target += stride
    return np.array(found[:most])


def _packer(splits: list[np.ndarray]):
    """Arrow batches (features, label) to blocks: number, rows, and bytes of the label
    and then of each feature's bin."""

    def packed(number: int, parts: list[np.ndarray]):
        codes = np.concatenate(parts, axis=1)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([codes.shape[1]], pa.int32()),
                                           pa.array([codes.tobytes()], pa.binary())], names=["block", "n", "codes"])

    def run(batches):
        first, made, parts, held = TaskContext.get().partitionId() << 32, 0, [], 0
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(splits))
            if not np.isfinite(x).all():
                raise ValueError("features must not hold NaN or infinity")
            codes = np.empty((len(splits) + 1, len(x)), np.uint8)
            codes[0] = batch.column(1).to_numpy(zero_copy_only=False)
            for i, thresholds in enumerate(splits):
                codes[i + 1] = np.searchsorted(thresholds, x[:, i], side="left")
            for start in range(0, len(x), BLOCK):
                part = codes[:, start:start + BLOCK]
                if held + part.shape[1] > BLOCK:
                    yield packed(first + made, parts)
                    made, parts, held = made + 1, [], 0
                parts.append(part)
                held += part.shape[1]
        if parts:
            yield packed(first + made, parts)
    return run


def poisson_draws(rate: float) -> np.ndarray:
    """How often a row is drawn, by 16 random bits."""
    pmf = [math.exp(-rate)]
    while len(pmf) < 200 and sum(pmf) < 1 - 1e-9:
        pmf.append(pmf[-1] * rate / len(pmf))
    return np.searchsorted(np.cumsum(pmf), (np.arange(_DRAWS) + 0.5) / _DRAWS).astype(np.uint8)


class Tree:
    """One tree as arrays: rows go from ``node`` to ``left[node]``, or to the node after it
    if their bin of feature ``feature[node]`` is above ``bin[node]``; a leaf leads to itself."""

    def __init__(self, number: int):
        self.number, self.feature, self.bin = number, np.zeros(1, np.int32), np.full(1, 255, np.int32)
        self.left, self.gain, self.counts = np.zeros(1, np.int32), np.full(1, -1.0), None

    def split(self, nodes: np.ndarray, feature: np.ndarray, at: np.ndarray, gain: np.ndarray, children: np.ndarray) -> np.ndarray:
        """Split ``nodes``; ``children`` holds the class counts (node, side, class). Returns
        the new nodes, left and right of each."""
        new = len(self.left) + np.arange(2 * len(nodes), dtype=np.int32)
        self.feature[nodes], self.bin[nodes], self.left[nodes], self.gain[nodes] = feature, at, new[::2], gain
        self.feature = np.append(self.feature, np.zeros(len(new), np.int32))
        self.bin = np.append(self.bin, np.full(len(new), 255, np.int32))
        self.left, self.gain = np.append(self.left, new), np.append(self.gain, np.full(len(new), -1.0))
        self.counts = np.concatenate([self.counts, children.reshape(len(new), -1)])
        return new


def _counter(frontier: list[tuple], subsets: np.ndarray, n_features: int, bins: int, classes: int, draws: np.ndarray, seed: int):
    """Blocks to counts by (node of the frontier, feature of its subset, bin, class),
    summed over the task, ``CHUNK`` nodes a row. ``frontier`` has for each tree its number,
    depth, tables and the wanted nodes with the place of the first."""
    places, tried = subsets.shape
    cell = bins * classes

    def run(batches):
        counts = np.zeros((tried, places * cell))
        for batch in batches:
            for number, n, codes in zip(*(batch.column(i) for i in range(3))):
                n = n.as_py()
                flat = np.frombuffer(codes.as_buffer(), np.uint8)
                for tree, depth, feature, at, left, nodes, first in frontier:
                    times = draws[np.random.default_rng([seed, tree, number.as_py()]).integers(0, _DRAWS, n, np.uint16)]
                    rows = np.flatnonzero(times)
                    node = np.zeros(len(rows), np.int32)
                    start, inner = (feature + 1) * n, left != np.arange(len(left))
                    for step in range(depth):
                        code = flat.take(start.take(node) + rows)
                        node = left.take(node) + (code > at.take(node))
                        if step % 3 == 2 and step + 1 < depth:
                            kept = np.flatnonzero(inner.take(node))
                            rows, node = rows.take(kept), node.take(kept)
                    slots = np.full(len(left), -1, np.int32)
                    slots[nodes] = np.arange(len(nodes))
                    slot = slots.take(node)
                    kept = np.flatnonzero(slot >= 0)
                    rows, slot = rows.take(kept), slot.take(kept)
                    weight, base = times.take(rows).astype(float), slot * cell + flat.take(rows)
                    offsets = (subsets[first:first + len(nodes)] + 1) * n
                    size = len(nodes) * cell
                    for j in range(tried):
                        code = flat.take(offsets[:, j].take(slot) + rows)
                        counts[j, first * cell:first * cell + size] += np.bincount(base + code.astype(np.int64) * classes, weight, size)
        cube = counts.reshape(tried, places, cell)
        for i in range(0, places, CHUNK):
            part = cube[:, i:i + CHUNK].transpose(1, 0, 2).astype(np.uint32)
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK], pa.int32()), pa.array([part.tobytes()], pa.binary())],
                                                 names=["chunk", "counts"])
    return run


SPLIT_SCHEMA = "place int, feature int, bin int, gain double, left array<bigint>, right array<bigint>"


def _gini(counts: np.ndarray) -> np.ndarray:
    total = counts.sum(axis=-1, keepdims=True)
    return 1.0 - (np.divide(counts, total, out=np.zeros(counts.shape), where=total > 0) ** 2).sum(axis=-1)


def best_splits(counts: np.ndarray, n_splits: np.ndarray, least_rows: int, least_gain: float):
    """Of counts by (node, feature, bin, class): the place of the best feature, its bin, the
    gain (-1: no split) and the class counts on both sides. ``n_splits`` is the number of
    thresholds by (node, feature)."""
    left = counts.cumsum(axis=2)
    whole = left[:, :, -1:]
    right = whole - left
    total, n_left, n_right = whole.sum(axis=-1), left.sum(axis=-1), right.sum(axis=-1)
    share = np.divide(n_left, total, out=np.zeros(n_left.shape), where=total > 0)
    gain = _gini(whole) - share * _gini(left) - (1 - share) * _gini(right)
    allowed = (np.arange(counts.shape[2]) < n_splits[:, :, None]) & (np.minimum(n_left, n_right) >= max(least_rows, 1)) & (gain >= least_gain)
    gain = np.where(allowed, gain, -1.0).reshape(len(counts), -1)
    best = gain.argmax(axis=1)
    node, (feature, at) = np.arange(len(counts)), np.divmod(best, counts.shape[2])
    return feature, at, gain[node, best], left[node, feature, at], right[node, feature, at]


def _chooser(subsets: np.ndarray, n_splits: np.ndarray, bins: int, classes: int, least_rows: int, least_gain: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = int(pdf["chunk"].iloc[0]) * CHUNK
        subset = subsets[first:first + CHUNK]
        counts = np.zeros((*subset.shape, bins, classes), np.int64)
        for held in pdf["counts"]:
            counts += np.frombuffer(held, np.uint32).reshape(counts.shape)
        feature, at, gain, left, right = best_splits(counts, n_splits[subset], least_rows, least_gain)
        return pd.DataFrame({"place": first + np.arange(len(subset)), "feature": subset[np.arange(len(subset)), feature],
                             "bin": at, "gain": gain, "left": list(left), "right": list(right)})
    return run


def _subset_size(strategy: str, n_features: int, n_trees: int) -> int:
    named = {"auto": n_features if n_trees == 1 else math.ceil(math.sqrt(n_features)), "all": n_features,
             "sqrt": math.ceil(math.sqrt(n_features)), "log2": max(1, math.ceil(math.log2(n_features))), "onethird": math.ceil(n_features / 3)}
    if strategy in named:
        return named[strategy]
    size = float(strategy)
    return min(n_features, int(size)) if size >= 1 and "." not in strategy else max(1, math.ceil(size * n_features))


class ForestClassifier(RandomForestClassifier):
    """``RandomForestClassifier`` whose training keeps some ``n_features + 1`` bytes a row."""

    def _fit(self, dataset: DataFrame) -> RandomForestClassificationModel:
        value = lambda name: self.getOrDefault(name)
        if self.isDefined("weightCol") and value("weightCol") or value("impurity") != "gini" or not value("bootstrap") \
                or value("minWeightFractionPerNode") > 0 or value("leafCol") or not 2 <= value("maxBins") <= 255:
            raise ValueError("supported: no weights, gini, bootstrap, no leaf column, at most 255 bins")
        rows = dataset.select(vector_to_array(F.col(f"`{value('featuresCol')}`")).alias("x"),
                              F.col(f"`{value('labelCol')}`").cast("double").alias("y"))
        wrong = F.col("x").isNull() | F.col("y").isNull() | ~F.col("y").between(0, MAX_CLASSES - 1) | (F.col("y") != F.floor("y"))
        n, top, bad = rows.agg(F.count(F.lit(1)), F.max("y"), F.count_if(wrong)).first()
        if not n or bad:
            raise ValueError("no rows to fit a forest on" if not n else f"{bad} rows without features or with an invalid label")
        wanted = max(value("maxBins") ** 2, 10_000)
        sample = rows if n <= wanted else rows.sample(False, wanted / n, value("seed") & 0x7FFFFFFF)
        x = np.array([r[0] for r in sample.select("x").collect()], float)
        if not np.isfinite(x).all():
            raise ValueError("features must not hold NaN or infinity")
        splits = [continuous_splits(x[:, i], min(value("maxBins"), n) - 1) for i in range(x.shape[1])]
        blocks = rows.mapInArrow(_packer(splits), "block long, n int, codes binary")
        # Blocks are few bytes a row: dealt evenly, whatever the parts of the input.
        blocks = blocks.repartition(max(rows.rdd.getNumPartitions(), dataset.sparkSession.sparkContext.defaultParallelism))
        blocks.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            trees = self._grow(blocks, splits, int(top) + 1)
        finally:
            blocks.unpersist()
        return self._model(dataset.sparkSession, trees, splits, int(top) + 1)

    def _grow(self, blocks: DataFrame, splits: list[np.ndarray], classes: int) -> list[Tree]:
        n_trees, seed = self.getOrDefault("numTrees"), self.getOrDefault("seed") & 0xFFFFFFFFFFFFFFFF
        n_splits = np.array([len(s) for s in splits])
        n_features, bins = len(splits), int(n_splits.max()) + 1
        tried = _subset_size(self.getOrDefault("featureSubsetStrategy"), n_features, n_trees)
        draws = poisson_draws(self.getOrDefault("subsamplingRate"))
        room = max(CHUNK, (HISTOGRAM_MB << 20) // (8 * tried * bins * classes))
        trees, random = [Tree(i) for i in range(n_trees)], [np.random.default_rng([seed, i]) for i in range(n_trees)]
        frontier = [(t, np.zeros(1, np.int32)) for t in trees]
        for depth in range(self.getOrDefault("maxDepth") + 1):
            # Nodes of this depth with the features that each tries, in passes of ``room`` nodes.
            todo = [(t, nodes, np.sort(random[t.number].random((len(nodes), n_features)).argsort(axis=1)[:, :tried], axis=1)) for t, nodes in frontier]
            frontier = []
            while todo:
                taken, used = [], 0
                while todo and used < room:
                    t, nodes, subset = todo.pop(0)
                    cut = room - used
                    if len(nodes) > cut:
                        todo.insert(0, (t, nodes[cut:], subset[cut:]))
                    taken.append((t, nodes[:cut], subset[:cut], used))
                    used += len(taken[-1][1])
                subsets = np.concatenate([subset for _, _, subset, _ in taken])
                tables = [(t.number, depth, t.feature, t.bin, t.left, nodes, first) for t, nodes, _, first in taken]
                found = (blocks.mapInArrow(_counter(tables, subsets, n_features, bins, classes, draws, seed), "chunk int, counts binary")
                         .groupBy("chunk").applyInPandas(_chooser(subsets, n_splits, bins, classes, self.getOrDefault("minInstancesPerNode"),
                                                                  self.getOrDefault("minInfoGain")), SPLIT_SCHEMA).toPandas())
                place = found["place"].to_numpy()
                feature, at, gain = np.zeros(used, np.int32), np.zeros(used, np.int32), np.full(used, -1.0)
                sides = np.zeros((used, 2, classes), np.int64)
                if len(place):
                    feature[place], at[place], gain[place] = found["feature"], found["bin"], found["gain"]
                    sides[place, 0], sides[place, 1] = np.stack(found["left"]), np.stack(found["right"])
                for t, nodes, _, first in taken:
                    mine = slice(first, first + len(nodes))
                    if depth == 0:
                        t.counts = sides[mine].sum(axis=1)
                    good = np.flatnonzero(gain[mine] > 0) if depth < self.getOrDefault("maxDepth") else []
                    if len(good):
                        new = t.split(nodes[good], feature[mine][good], at[mine][good], gain[mine][good], sides[mine][good])
                        below = new[_gini(t.counts[new]) > np.finfo(float).eps] if depth + 1 < self.getOrDefault("maxDepth") else new[:0]
                        if len(below):
                            frontier.append((t, below))
            frontier.sort(key=lambda x: x[0].number)
            if not frontier:
                break
        return trees

    def _model(self, spark, trees: list[Tree], splits: list[np.ndarray], classes: int) -> RandomForestClassificationModel:
        """The trees as a Spark ML model, through the folder that such a model is saved in."""
        from netweave.session import scratch_path
        path = scratch_path(spark, "forest")
        params = {"paramMap": {p.name: v for p, v in self._paramMap.items()}, "defaultParamMap": {p.name: v for p, v in self._defaultParamMap.items()}}
        about = {"timestamp": int(time.time() * 1000), "sparkVersion": spark.version}

        def metadata(kind: str, uid: str, **more) -> str:
            own = {k: {n: v for n, v in held.items() if more or n not in ("numTrees", "featureSubsetStrategy", "subsamplingRate", "bootstrap")} for k, held in params.items()}
            return json.dumps({"class": f"org.apache.spark.ml.classification.{kind}", "uid": uid, **about, **own, **more})

        whole = metadata("RandomForestClassificationModel", self.uid, numFeatures=len(splits), numClasses=classes, numTrees=len(trees))
        spark.createDataFrame([(whole,)], "value string").coalesce(1).write.text(os.path.join(path, "metadata"))
        spark.createDataFrame([(t.number, metadata("DecisionTreeClassificationModel", f"{self.uid}_{t.number}"), 1.0) for t in trees],
                              "_1 int, _2 string, _3 double").coalesce(1).write.parquet(os.path.join(path, "treesMetadata"))
        flat = pd.concat([_node_rows(t, splits) for t in trees], ignore_index=True)
        nodes = spark.createDataFrame(pa.Table.from_pandas(flat, preserve_index=False))
        split = F.struct(F.col("feature").alias("featureIndex"), F.col("threshold").alias("leftCategoriesOrThreshold"),
                         F.lit(-1).alias("numCategories"))
        nodes.select("treeID", F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild",
                                        split.alias("split")).alias("nodeData")).write.parquet(os.path.join(path, "data"))
        return RandomForestClassificationModel.load(path)


def _node_rows(t: Tree, splits: list[np.ndarray]) -> pd.DataFrame:
    """Rows of the saved form, numbered from the root downwards, left before right; two
    leaves of one prediction are merged into the node above them."""
    prediction, leaf = t.counts.argmax(axis=1), t.left == np.arange(len(t.left))
    for node in range(len(leaf) - 1, -1, -1):  # children come after their parents
        if not leaf[node]:
            a = t.left[node]
            leaf[node] = leaf[a] and leaf[a + 1] and prediction[a] == prediction[a + 1]
    order, stack = [], [0]
    while stack:
        node = stack.pop()
        order.append(node)
        if not leaf[node]:
            stack += [t.left[node] + 1, t.left[node]]
    order, ids = np.array(order), np.zeros(len(leaf), np.int32)
    ids[order] = np.arange(len(order), dtype=np.int32)
    end = leaf[order]
    left = np.where(end, 0, t.left[order])
    return pd.DataFrame({
        "treeID": np.full(len(order), t.number, np.int32), "id": ids[order], "prediction": prediction[order].astype(float),
        "impurity": _gini(t.counts[order]), "impurityStats": list(t.counts[order].astype(float)), "rawCount": t.counts[order].sum(axis=1),
        "gain": np.where(end, -1.0, t.gain[order]), "leftChild": np.where(end, -1, ids[left]).astype(np.int32),
        "rightChild": np.where(end, -1, ids[np.where(end, 0, left + 1)]).astype(np.int32),
        "feature": np.where(end, -1, t.feature[order]).astype(np.int32),
        "threshold": [np.zeros(0) if e else splits[f][b:b + 1] for e, f, b in zip(end, t.feature[order], t.bin[order])]})
