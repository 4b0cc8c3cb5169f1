"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask of ``SPAN`` consecutive words of which some count and the others
are ignored. Every benchmark item is hashed at every place under every mask; so
is every place of every document. An equal hash is a hit: it aligns the item with
the document at one diagonal, whatever stands at the ignored places. Items of
fewer than ``BLOCKS_BELOW`` words are also cut into one block more than they may
have words substituted, so one block is always undisturbed and found, however
short. An item leaks into a document in either of two ways:

* ``share`` of its words stand on one diagonal (substituted words do no harm);
* hits on diagonals at most ``SHIFT`` apart are chained, the alignment is extended
  both ways to the ends of the overlap, and in its longest stretch with ``share``
  of the columns equal (a word put in or left out is an unequal column) there are
  ``LOCAL_WORDS`` columns, or ``share`` of the item's words. So an item cut by the
  end of a document, a long part of one, or one with words put in or left out
  leaks too.

Masks are chosen so that two words substituted anywhere in an item of twice the
span leave a hit under some mask.

The benchmark is taken in blocks of at most ``BLOCK_WORDS`` words, so what is
broadcast has a bound whatever its size; each block is one pass over the
documents. Documents are neither shuffled nor cut.

An item of one or two words stands in any text: ``leaks`` reports it, ``drop_leaking``
drops no document for items of fewer than ``LEAST_WORDS`` words; ``short_items``
lists them.

Words are runs of non-blanks (ASCII blanks) after A-Z are lower-cased. Null and
empty texts and items match nothing. Rows that repeat a doc_id count as one
document; rows without doc_id are compared like others. Empty tables give an
empty result. Extra columns are not read.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm import words as W

SPAN = 11
#: 1: the word counts, 0: it is ignored.
MASKS = ("11101100101", "11011010011", "10110011101", "11111100000", "00000111111")
#: Share of the words of an item, or of an aligned overlap, that must be equal.
SHARE = 0.8
#: Least aligned words of an overlap that is less than the item.
LOCAL_WORDS = 13
#: Diagonals that one chain of hits may shift by at a time: words put in or left out together.
SHIFT = 8
#: Items of fewer words are also looked up by blocks that no allowed substitutions can all disturb.
#: Items of fewer words drop no document.
LEAST_WORDS = 3
BLOCKS_BELOW = 64
#: Words compared at once.
STEP = 1 << 20
BLOCK_WORDS = 4_000_000
_OUT = "doc_id long, item_id long, start long, matched long, item_words long"


def _spaced(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of each span of words under a mask."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, np.uint64(int(mask, 2)))
    with np.errstate(over="ignore"):
        for i, c in enumerate(mask):
            if c == "1":
                out *= np.uint64(0x9E3779B97F4A7C15)
                out += words[i:i + n]
                out ^= out >> np.uint64(29)
    return W._finish(out)


class _Seeds:
    """All seeds of one block of benchmark items, sorted by hash."""

    def __init__(self, items: list[tuple[int, str]], masks: tuple[str, ...], share: float):
        self.masks = masks
        groups = list(W.words_of(pa.array([t for _, t in items], pa.string()), W.LOWER))
        self.words = np.concatenate([g.hashes[0] for g in groups] or [np.zeros(0, np.uint64)])
        counts = np.concatenate([g.counts for g in groups] or [np.zeros(0, np.int64)]).astype(np.int64)
        self.ids = np.array([i for i, _ in items], np.int64)
        self.sizes, self.starts = counts, np.cumsum(counts) - counts
        item = np.repeat(np.arange(len(items)), counts)
        span = len(masks[0])
        self.tables = []
        for mask in masks:
            h = _spaced(self.words, mask)
            at = np.flatnonzero(item[:len(h)] == item[span - 1:]) if len(h) else np.zeros(0, np.int64)
            self.tables.append(self._table(h[at], item[at], at - self.starts[item[at]]))
        # One of allowed + 1 consecutive blocks of an item stands undisturbed.
        blocks: dict[int, list[tuple[int, int]]] = {}
        for i in np.flatnonzero((counts > 0) & (counts < BLOCKS_BELOW)).tolist():
            size = int(counts[i])
            parts = min(size, size - int(np.ceil(share * size - 1e-9)) + 1)
            cuts = [size * j // parts for j in range(parts + 1)]
            for lo, hi in zip(cuts, cuts[1:]):
                blocks.setdefault(hi - lo, []).append((i, lo))
        self.blocks = []  # (words, table)
        for size, places in sorted(blocks.items()):
            own, inner = np.array(places, np.int64).T
            h = W.sequence_hashes(self.words, size)[self.starts[own] + inner]
            self.blocks.append((size, self._table(h, own, inner)))

    @staticmethod
    def _table(hashes, items, places):
        order = np.argsort(hashes, kind="stable")
        maybe = np.zeros(1 << 20, bool)
        maybe[(hashes >> np.uint64(44)).astype(np.int64)] = True
        return hashes[order], items[order], places[order], maybe

    @staticmethod
    def hits(table, hashes: np.ndarray):
        """(place, item, place in item) of every equal hash."""
        known, items, places, maybe = table
        at = np.flatnonzero(maybe[(hashes >> np.uint64(44)).astype(np.int64)])
        lo, hi = np.searchsorted(known, hashes[at]), np.searchsorted(known, hashes[at], side="right")
        n = hi - lo
        row = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return np.repeat(at, n), items[row], places[row]


def _whole(seeds: _Seeds, words: np.ndarray, bounds: np.ndarray, doc: np.ndarray, item: np.ndarray, begin: np.ndarray):
    """Words of the item that stand on each diagonal (document, item, begin)."""
    lo = np.maximum(begin, bounds[doc])
    size = np.maximum(0, np.minimum(begin + seeds.sizes[item], bounds[doc + 1]) - lo)
    there = seeds.starts[item] + lo - begin
    same = np.zeros(len(doc), np.int64)
    ends = np.cumsum(size)
    at = 0
    while at < len(doc):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + STEP, side="right")))
        n = size[at:to]
        row = np.repeat(np.arange(at, to), n)
        inner = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        same[at:to] = np.bincount(row - at, words[lo[row] + inner] == seeds.words[there[row] + inner], to - at)
        at = to
    return same


def _chains(inner: np.ndarray, begin: np.ndarray):
    """Chains of hit runs of one item in one document, each a list of (diagonal,
    first word of the item, last one). Runs are hits on one diagonal less than a
    span apart; a chain goes on from a run to a later one ``SHIFT`` diagonals
    away at most, at a cost of what that shift takes from the equal share."""
    order = np.lexsort((inner, begin))
    inner, begin = inner[order], begin[order]
    new = np.ones(len(inner), bool)
    new[1:] = (begin[1:] != begin[:-1]) | (inner[1:] - inner[:-1] > SPAN)
    at = np.flatnonzero(new)
    runs = sorted(zip(inner[at].tolist(), inner[np.append(at[1:], len(inner)) - 1].tolist(), begin[at].tolist()))
    value, back, followed, latest = [], [], set(), {}
    for r, (first, last, b) in enumerate(runs):
        best, link = 0, -1
        for shift in range(-SHIFT, SHIFT + 1):
            p = latest.get(b + shift)
            if p is not None and runs[p][0] < first + (shift == 0) and runs[p][0] + runs[p][2] < first + b:
                gain = value[p] - min(SPAN, max(0, runs[p][1] + 1 - first)) - 4 * abs(shift)
                if gain > best:
                    best, link = gain, p
        value.append(best + last - first + SPAN // 2)
        back.append(link)
        followed.add(link)
        latest[b] = r
    for r in range(len(runs)):
        if r not in followed:
            chain = [r]
            while back[chain[-1]] >= 0:
                chain.append(back[chain[-1]])
            yield [(runs[c][2], runs[c][0], runs[c][1]) for c in reversed(chain)]


def _path(chain, text: np.ndarray, own: np.ndarray):
    """Columns of the alignment along a chain, to both ends of the overlap:
    whether the words are equal, and the diagonal. A shift of the diagonal is as
    many unequal columns, at the place that leaves most words equal."""
    equal, diagonal, q = [], [], max(0, -chain[0][0])

    def on(b: int, lo: int, hi: int) -> np.ndarray:
        out = np.zeros(max(0, hi - lo), bool)
        a, z = max(lo, -b), min(hi, len(text) - b)
        if a < z:
            out[a - lo:z - lo] = text[a + b:z + b] == own[a:z]
        return out

    for (b, first, _), after in zip(chain, [*chain[1:], None]):
        if after is None:
            end, skip = max(q, min(len(own), len(text) - b)), 0
        else:
            skip = max(0, b - after[0])  # words of the item that the text leaves out
            lo = max(q, min(first, after[1]))
            hi = max(lo, min(len(own) - skip, after[2] + SPAN))
            here, there = on(b, lo, hi), on(after[0], lo + skip, hi + skip)
            gain = np.concatenate([[0], np.cumsum(here)]) - np.concatenate([[0], np.cumsum(there)])
            end = lo + int(np.argmax(gain))
        equal.append(on(b, q, end))
        diagonal.append(np.full(end - q, b))
        if after is not None:
            shift = abs(after[0] - b)
            equal.append(np.zeros(shift, bool))
            diagonal.append(np.full(shift, after[0]))
        q = end + skip
    return np.concatenate(equal), np.concatenate(diagonal)


def _stretch(equal: np.ndarray, share: float):
    """Of the stretches of columns of which ``share`` are equal: the columns of the
    longest, and the first column and the equal columns of that with most of them."""
    sums = np.concatenate([[0.0], np.cumsum(equal - share)])
    low = np.minimum.accumulate(sums)
    first = np.searchsorted(-low, -(sums + 1e-9))
    count = np.concatenate([[0], np.cumsum(equal)])
    most = int(np.argmax(count - count[first]))
    return int((np.arange(len(sums)) - first).max()), int(first[most]), int(count[most] - count[first[most]])


def _found(seeds: _Seeds, column, share: float):
    """Rows (document row, item, begin in the document, words that match) of one
    column of texts."""
    out = [np.zeros((0, 4), np.int64)]
    for group in W.words_of(column, W.LOWER):
        words, bounds = group.hashes[0], group.bounds
        found = [seeds.hits(t, _spaced(words, m)) for m, t in zip(seeds.masks, seeds.tables)]
        found += [seeds.hits(t, W.sequence_hashes(words, size)) for size, t in seeds.blocks]
        place, item, inner = (np.concatenate([f[i] for f in found]) for i in range(3))
        if not len(place):
            continue
        doc = np.searchsorted(bounds, place, side="right") - 1
        hits = np.unique(np.stack([doc, item, place - inner, inner], 1), axis=0)
        new = np.ones(len(hits), bool)
        new[1:] = (hits[1:, :3] != hits[:-1, :3]).any(axis=1)
        doc, item, begin = hits[new, :3].T
        same = _whole(seeds, words, bounds, doc, item, begin)
        leak = same >= np.ceil(share * seeds.sizes[item] - 1e-9)
        out.append(np.stack([doc + group.first, item, begin - bounds[doc], same], 1)[leak])
        # Partial and shifted overlaps, of items that stand whole on no diagonal.
        pair = doc * len(seeds.sizes) + item
        need = np.minimum(LOCAL_WORDS, np.ceil(share * seeds.sizes[item])) * share
        pairs, at = np.unique(pair, return_inverse=True)
        sums, settled = np.bincount(at, same, len(pairs)), np.bincount(at, leak, len(pairs)) > 0
        wanted = ~settled & (sums >= np.floor(need[np.searchsorted(pair, pairs)]))
        every = hits[:, 0] * len(seeds.sizes) + hits[:, 1]
        for p in pairs[wanted].tolist():
            part = hits[np.searchsorted(every, p):np.searchsorted(every, p, side="right")]
            d, i = int(part[0, 0]), int(part[0, 1])
            text = words[bounds[d]:bounds[d + 1]]
            own = seeds.words[seeds.starts[i]:seeds.starts[i] + seeds.sizes[i]]
            for chain in _chains(part[:, 3], part[:, 2] - bounds[d]):
                equal, diagonal = _path(chain, text, own)
                columns, lo, matched = _stretch(equal, share)
                if matched and (columns >= LOCAL_WORDS or matched >= share * len(own) - 1e-9):
                    out.append(np.array([[d + group.first, i, diagonal[lo], matched]], np.int64))
    return np.concatenate(out)


def _scan(docs: DataFrame, seeds: _Seeds, share: float) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(seeds)

    def task(batches):
        s = shared.value
        for batch in batches:
            row, item, begin, same = _found(s, batch.column(1), share).T
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(s.ids[item]), pa.array(begin), pa.array(same), pa.array(s.sizes[item])],
                ["doc_id", "item_id", "start", "matched", "item_words"])

    return docs.mapInArrow(task, _OUT)


def _blocks(benchmark: DataFrame, limit: int):
    """Benchmark items in blocks of about ``limit`` words; one block at a time
    is on the driver."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL").distinct()
    sized = items.withColumn("words", F.size(F.split(F.col("text"), "[ \\t\\n\\x0B\\f\\r]+")))
    total = sized.agg(F.sum("words")).first()[0] or 0
    n = int(total // limit + 1)
    for i in range(n):
        part = sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i) if n > 1 else sized
        rows = part.select("item_id", "text").collect()
        if rows:
            yield sorted((r[0], r[1]) for r in rows)


def leaks(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, masks=MASKS,
          block_words: int = BLOCK_WORDS) -> DataFrame:
    """Leaked items: doc_id, item_id, start (word of the document where the item
    would begin), matched, item_words, similarity (matched of item_words, less than
    ``share`` where only a part of the item stands there); of several alignments of one
    item in one document the best, the first on ties."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = [_scan(docs, _Seeds(items, tuple(masks), share), share) for items in _blocks(benchmark, block_words)]
    if not parts:
        parts = [docs.sparkSession.createDataFrame([], _OUT)]
    best = F.max(F.struct("matched", (-F.col("start")).alias("back"), "item_words")).alias("best")
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", (-F.col("best.back")).alias("start"), F.col("best.matched").alias("matched"),
        F.col("best.item_words").alias("item_words"),
        (F.col("best.matched") / F.col("best.item_words")).alias("similarity"))


def _n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != ""))


def short_items(benchmark: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Items that ``drop_leaking`` leaves out: item_id, item_words (under
    ``least_words``, at least 1)."""
    words = benchmark.select(F.col("item_id").cast("long").alias("item_id"),
                             _n_words(F.col("text").cast("string")).cast("long").alias("item_words"))
    return words.where((F.col("item_words") > 0) & (F.col("item_words") < least_words))


def drop_leaking(docs: DataFrame, benchmark: DataFrame, share: float = SHARE, masks=MASKS,
                 block_words: int = BLOCK_WORDS, least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` without the documents that hold a benchmark item of
    ``least_words`` or more, all columns as they are. Decided row by row, so nothing
    is shuffled."""
    names = docs.columns
    benchmark = benchmark.where(_n_words(F.col("text").cast("string")) >= least_words)

    def filtered(rows: DataFrame, seeds: _Seeds) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(seeds)

        def task(batches):
            for batch in batches:
                keep = np.ones(batch.num_rows, bool)
                keep[_found(shared.value, batch.column(len(names)), share)[:, 0]] = False
                yield pa.RecordBatch.from_arrays(batch.columns[:len(names)], names).filter(pa.array(keep))

        return rows.select("*", F.col("text").cast("string").alias("whole text")).mapInArrow(task, docs.schema)

    for items in _blocks(benchmark, block_words):
        docs = filtered(docs, _Seeds(items, tuple(masks), share))
    return docs
