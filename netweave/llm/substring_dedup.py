"""Substring dedup by De Bruijn compaction of token k-mers.

A window is ``window`` consecutive words of one document. A word is removed if a
window covers it whose word sequence also starts in a document with a smaller
doc_id; windows are judged on the input.

1. *Anchors.* Every window has one anchor: of its ``window - K + 1`` k-mers of
   ``K`` words the one with the least hash (leftmost on ties). Equal windows have
   equal anchors, so about two in 36 positions stand for all of them and no equal
   window is missed. Anchors are the nodes of a sparse De Bruijn graph; an edge
   leads from an anchor to the next one of the document and is named by the hash
   of all words from the one to the end of the other.
2. *Compaction.* Only anchors met more than once go on. Joins on node and edge
   tell how often each occurs in the corpus; a text that meets an edge again and again
   is one row there. An edge between nodes that occur
   exactly as often as the edge itself does not branch: every document that
   enters such a path walks it from end to end. A path of such edges is one span
   that stands for all its windows.
3. *Verification at the source.* Documents with repeated anchors are read again
   and give, at their own source coordinates, a 128-bit hash of every path, and
   for each anchor the run of its windows that no path covers: a hash of the
   run's words beside the anchor's. A path or run that a smaller doc_id has too
   is removed. What a text repeats within itself is one row with all its places.
   Of equal runs only the first holder goes on: its windows, one by one, are
   compared with those of other runs at the same anchor.

Groups are never gathered: counts and smallest doc_ids are partial aggregates,
and joins on hot k-mers can be split. Only the marks of one document come
together, as its text does.

Null or empty text: no words, nothing removed, hash of the empty string. Texts
shorter than a window lose nothing and prove nothing. Rows that share a doc_id
are judged apart, and neither counts as smaller than the other. A null doc_id is
not smaller than any and loses nothing. An empty table gives an empty result.
Extra columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import words as W
from netweave.llm.scratch import written
from netweave.llm.skew import hot_of_counts, salted_left_join

WINDOW = 50
K = 16
_PLACE_BITS = np.uint64(28)
_PLACE = np.uint64((1 << 28) - 1)
#: ``side`` is the anchor of a run, a second hash of a path; paths have no windows.
_CLAIMS = "doc_id long, text_hash long, starts array<int>, length int, side long, hash long, windows array<long>"


class _Anchored:
    """Windows and anchors of a group of texts, positions counted in words from
    the group's first word."""

    def __init__(self, group: W.Words, window: int):
        words, bounds = group.hashes[0], group.bounds
        last = np.repeat(bounds[1:], group.counts) - window
        keys = W.sequence_hashes(words, K) & ~_PLACE
        keys |= np.arange(len(keys), dtype=np.uint64)
        least = W.sliding_min(keys, window - K + 1) if len(keys) > window - K else keys[:0]
        self.windows = np.flatnonzero(np.arange(len(least)) <= last[:len(least)])
        self.anchor_of = (least[self.windows] & _PLACE).astype(np.int64)
        self.at = np.unique(self.anchor_of)
        self.doc = np.searchsorted(bounds, self.at, side="right") - 1
        self.last = np.ones(len(self.at), bool)
        self.last[:-1] = self.doc[1:] != self.doc[:-1]
        span = W.SpanHash(words)
        self.node = W.signed(span(self.at, self.at + K))
        after = np.concatenate([self.at[1:], self.at[-1:]])
        self.edge = np.where(self.last, 0, W.signed(span(self.at, np.where(self.last, self.at, after) + K)))
        self.bounds = bounds


def _anchor_rows(window: int):
    def task(batches):
        for batch in batches:
            ids = batch.column(0)
            for group in W.words_of(batch.column(1), W.PLAIN):
                a = _Anchored(group, window)
                if len(a.at):
                    # A text that repeats itself has one row an edge, however often it is met.
                    order = np.lexsort((a.edge, a.node, a.doc))
                    new = np.ones(len(order), bool)
                    new[1:] = np.any([np.diff(x[order]) != 0 for x in (a.doc, a.node, a.edge)], axis=0)
                    one, times = order[new], np.diff(np.append(np.flatnonzero(new), len(order)))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(a.doc[one] + group.first)), pa.array(a.node[one]), pa.array(a.edge[one]),
                         pa.array(times.astype(np.int64))], ["doc_id", "node", "edge", "times"])
    return task


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Value of each wanted key, 0 where there is none."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    order = np.argsort(keys, kind="stable")
    at = np.minimum(np.searchsorted(keys[order], wanted), len(keys) - 1)
    return np.where(keys[order][at] == wanted, values[order][at], 0)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    with np.errstate(over="ignore"):
        for p in parts:
            out = W._finish((out ^ p.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                            + np.uint64(0x632BE59BD9B4E019))
    return out


def _claim_rows(window: int):
    """Paths, and each anchor's runs of uncovered windows, with their hashes."""

    def found(a: _Anchored, marks):
        """(start, end) of paths; (start, end, anchor) of runs."""
        doc, node, edge, nodes, edges = marks
        times = _lookup(_mixed(doc, node), nodes, _mixed(a.doc, a.node))
        edge_times = _lookup(_mixed(doc, node, edge), edges, _mixed(a.doc, a.node, a.edge))
        straight = ~a.last & (times > 0) & (edge_times == times)
        straight[:-1] &= times[1:] == times[:-1]
        path = np.concatenate([[0], np.cumsum(~straight[:-1])])
        first = np.searchsorted(path, np.arange(path[-1] + 1))
        final = np.searchsorted(path, np.arange(path[-1] + 1), side="right") - 1
        starts, ends = a.at[first], a.at[final] + K
        anchor = np.searchsorted(a.at, a.anchor_of)
        own = path[anchor]
        covered = (starts[own] <= a.windows) & (a.windows + window <= ends[own])
        open_ = (times[anchor] > 0) & ~covered
        at, by = a.windows[open_], anchor[open_]
        whole = (times[first] > 0) & (ends - starts >= window)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (np.diff(by) > 0)
        runs = np.flatnonzero(new)
        final = np.append(runs[1:], len(at))[:len(runs)] - 1
        return (starts[whole], ends[whole]), (at[runs], at[final] + window, by[runs]), at

    def task(batches):
        for batch in batches:
            ids, hashes, marks = batch.column(0), batch.column(2), batch.column(3)
            to = marks.offsets.to_numpy().astype(np.int64)
            flat = marks.values
            fields = [flat.field(i).to_numpy(zero_copy_only=False) for i in range(4)]
            for group in W.words_of(batch.column(1), W.PLAIN, seeds=(0, 1)):
                a = _Anchored(group, window)
                if not len(a.at):
                    continue
                lo, hi = to[group.first], to[group.first + len(group.counts)]
                per = np.diff(to[group.first:group.first + len(group.counts) + 1])
                doc = np.repeat(np.arange(len(group.counts)), per)
                (p_start, p_end), (r_start, r_end, r_anchor), alone = found(
                    a, (doc, *(f[lo - to[0]:hi - to[0]] for f in fields)))
                start, end = np.concatenate([p_start, r_start]), np.concatenate([p_end, r_end])
                if not len(start):
                    continue
                row = np.searchsorted(a.bounds, start, side="right") - 1
                at = pa.array(row + group.first)
                one, two = (W.SpanHash(h) for h in group.hashes)
                sizes = np.concatenate([np.zeros(len(p_start), np.int64), r_end - r_start - window + 1])
                side = np.concatenate([W.signed(two(p_start, p_end)), a.node[r_anchor]])
                whole = W.signed(one(start, end))
                # Equal claims of a text are neighbours; the first of them speaks for all.
                order = np.lexsort((start, end - start, whole, side, row))
                new = np.ones(len(order), bool)
                new[1:] = np.any([np.diff(x[order]) != 0 for x in (row, side, whole, end - start)], axis=0)
                says = order[new]
                places = np.append(np.flatnonzero(new), len(order)).astype(np.int32)
                windows = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32),
                                                   W.signed(one(alone, alone + window)))
                at = at.take(pa.array(says))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(at), hashes.take(at),
                     pa.ListArray.from_arrays(places, (start - a.bounds[row])[order].astype(np.int32)),
                     pa.array((end - start)[says].astype(np.int32)), pa.array(side[says]), pa.array(whole[says]),
                     windows.take(pa.array(says))],
                    ["doc_id", "text_hash", "starts", "length", "side", "hash", "windows"])
    return task


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Spans to remove: doc_id, text_hash (``xxhash64`` of the text), starts and
    length in words. ``docs`` has doc_id and text."""
    if window < K:
        raise ValueError(f"a window has {K} words at least")
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where(
        "doc_id IS NOT NULL AND text IS NOT NULL")
    anchors = written(docs.mapInArrow(_anchor_rows(window), "doc_id long, node long, edge long, times long"), "anchors")
    repeated = written(anchors.groupBy("node").agg(F.sum("times").alias("nodes")).where("nodes > 1"), "nodes")
    hits = written(salted_left_join(anchors, repeated, "node", ["doc_id", "edge"], "inner",
                                    hot_of_counts(repeated, "nodes", "node")), "repeated")
    edges = written(hits.groupBy("node", "edge").agg(F.sum("times").alias("edges")), "edges")
    of_edge = salted_left_join(hits, edges, ["node", "edge"], ["doc_id"], "inner", hot_of_counts(edges, "edges", "node", "edge"))
    marked = written(of_edge.groupBy("doc_id").agg(
        F.collect_set(F.struct("node", "edge", "nodes", "edges")).alias("marks")), "marks")
    claims = written(docs.join(marked, "doc_id").select("doc_id", "text", F.xxhash64("text").alias("text_hash"), "marks")
                     .mapInArrow(_claim_rows(window), _CLAIMS), "claims")
    source = written(claims.groupBy("side", "hash").agg(F.min("doc_id").alias("source"), F.count("*").alias("held")), "sources")
    sourced = salted_left_join(claims, source.drop("held"), ["side", "hash"], ["doc_id", "starts"], "inner",
                               hot_of_counts(source, "held", "side", "hash"))
    judged = written(sourced.where("source < doc_id OR size(windows) > 0").select(
        "doc_id", "text_hash", "starts", "length", "side", "hash", "source",
        F.when(F.col("source") == F.col("doc_id"), F.col("windows")).alias("windows")), "judged")
    first = judged.where("source = doc_id")
    contested = first.groupBy("side").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a < b").select("side")
    single = written(first.join(contested, "side").select("doc_id", "text_hash", "side", "starts", F.posexplode("windows"))
                     .select("doc_id", "text_hash", "side", F.expr("transform(starts, s -> s + pos)").alias("starts"),
                             F.col("col").alias("hash")), "windows")
    earliest = single.groupBy("side", "hash").agg(F.min("doc_id").alias("source"), F.max("doc_id").alias("last")).where(
        "source < last").drop("last")
    alone = single.join(earliest, ["side", "hash"]).where("source < doc_id").select(
        "doc_id", "text_hash", "starts", F.lit(window).alias("length"))
    return judged.where("source < doc_id").select("doc_id", "text_hash", "starts", "length").unionByName(alone)


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` with repeated words removed from ``text`` and ``n_chars``, if
    there is such a column, counted anew. Texts that lose nothing stay as they
    are; documents that lose every word go."""
    new = tuple(f"{name} {uuid4().hex}" for name in ("words", "removed", "kept", "hash"))
    words, removed, kept, _ = (F.col(f"`{name}`") for name in new)
    done = strip_spans(docs, repeated_spans(docs, window), new).where((removed == 0) | (removed < words))
    changed = {"text": F.when(removed > 0, kept).otherwise(F.col("text")).cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(removed > 0, F.length(kept)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return done.select(*[changed[c].alias(c) if c in changed else F.col(f"`{c}`") for c in docs.columns])


def strip_spans(docs: DataFrame, spans: DataFrame,
                new: tuple[str, ...] = ("n_words", "n_removed", "kept", "kept_sha256")) -> DataFrame:
    """``docs`` with four more columns, by default n_words, n_removed, kept (the
    words outside ``spans``, joined by one space) and kept_sha256. Columns that
    ``docs`` has under those names are replaced."""
    tag = uuid4().hex
    spans = spans.groupBy(F.col("doc_id").alias(f"id_{tag}"), F.col("text_hash").alias(f"hash_{tag}")).agg(
        F.collect_list(F.struct("starts", "length")).alias(f"spans_{tag}"))
    names = [c for c in docs.columns if c.lower() not in new]
    joined = docs.select(*names).join(spans, (F.col("doc_id").cast("long") == F.col(f"id_{tag}"))
                                      & (F.xxhash64(F.col("text").cast("string")) == F.col(f"hash_{tag}")), "left")
    joined = joined.select(*names, F.col("text").cast("string").alias(f"text_{tag}"), f"spans_{tag}")

    def task(batches):
        for batch in batches:
            texts, cut = batch.column(len(names)), batch.column(len(names) + 1)
            n_words, n_removed, kept, digests = [], [], [], []
            for i in range(batch.num_rows):
                words = (texts[i].as_py() or "").encode().split()
                n_words.append(len(words))
                if cut[i].is_valid:
                    s = cut[i].values
                    start = s.field(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                    length = np.repeat(s.field(1).to_numpy(zero_copy_only=False).astype(np.int64),
                                       s.field(0).value_lengths().to_numpy(zero_copy_only=False))
                    change = np.bincount(start, minlength=len(words) + 1) - np.bincount(start + length, minlength=len(words) + 1)
                    words = [words[j] for j in np.flatnonzero(np.cumsum(change)[:-1] == 0)]
                n_removed.append(n_words[-1] - len(words))
                kept.append(b" ".join(words))
                digests.append(hashlib.sha256(kept[-1]).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:len(names)], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()),
                 pa.array(kept, pa.binary()).cast(pa.string()), pa.array(digests, pa.string())],
                [*names, *new])

    schema = docs.select(*names).schema
    for name, kind in zip(new, ("long", "long", "string", "string")):
        schema = schema.add(name, kind)
    return joined.mapInArrow(task, schema)
