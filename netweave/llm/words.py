"""Vectorised word hashing for Arrow string columns.

A word is a maximal run of word bytes, given by a 256-entry table (all
separators used here are ASCII, so UTF-8 bytes can be classified one by one).
Words are hashed by a polynomial over a byte table modulo 2**64 followed by a
finaliser, so a batch of texts costs a few numpy passes and no Python loop per
word. Texts are handled in groups of about ``GROUP_BYTES``; a longer text is
hashed piece by piece, cut between words, and its hashes are joined. Memory is
bounded by the piece size plus eight bytes a word of the longest text.

Null texts have no words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

GROUP_BYTES = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD_BASE = np.uint64(0xD1342543DE82EF95)
_SEQ_BASE = np.uint64(0xAF251AF3B0F025B5)


def _finish(h: np.ndarray) -> np.ndarray:
    """Murmur-style finaliser: spreads every input bit over the word."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def _inverse(odd: int) -> int:
    return pow(int(odd), -1, 1 << 64)


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inv = base, np.uint64(_inverse(int(base)))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base), np.full(size, self.inv)
            up[0] = down[0] = 1
            self.up, self.down = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return self.up[:n], self.down[:n]


_WORD_POWERS, _SEQ_POWERS = _Powers(_WORD_BASE), _Powers(_SEQ_BASE)


@dataclass(frozen=True)
class Alphabet:
    """Which bytes belong to words, and what a byte becomes before hashing."""

    is_word: np.ndarray
    fold: np.ndarray

    @staticmethod
    def make(separators, lower: bool) -> Alphabet:
        is_word = np.ones(256, bool)
        is_word[list(separators)] = False
        fold = np.arange(256, dtype=np.uint8)
        if lower:
            fold[65:91] += 32
        return Alphabet(is_word, fold)


_SPACES = [0x20, *range(0x09, 0x0E)]
#: Words ``[^\x20\x09-\x0D]+``, unchanged and with A-Z lower-cased.
PLAIN = Alphabet.make(_SPACES, lower=False)
LOWER = Alphabet.make(_SPACES, lower=True)
#: Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased.
ALNUM = Alphabet.make([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61),
                       *range(0x7B, 0x80)], lower=True)


def _byte_values(seed: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _finish((np.arange(1, 257, dtype=np.uint64) + np.uint64(seed * 1000003)) * _ODD) | np.uint64(1)


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of an Arrow string column, and n + 1 offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0]:at[-1]], at - at[0]


@dataclass
class Words:
    """Words of the texts ``first .. first + len(counts) - 1`` of a column."""

    first: int
    counts: np.ndarray
    hashes: list[np.ndarray]
    starts: np.ndarray
    ends: np.ndarray

    @property
    def bounds(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.counts)])


def _piece(buf: np.ndarray, offsets: np.ndarray, alphabet: Alphabet, seeds):
    """Word starts, ends (in ``buf``), words per text and one hash per seed."""
    n = len(buf)
    counts = np.zeros(len(offsets) - 1, np.int64)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, counts, [np.zeros(0, np.uint64) for _ in seeds]
    word = alphabet.is_word[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begin = word.copy()
    begin[1:] &= ~word[:-1] | edge[1:n]
    stop = word
    stop[:-1] = word[:-1] & (~word[1:] | edge[1:n])
    starts, ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
    marks = np.searchsorted(starts, offsets)
    counts = np.diff(marks)
    up, down = _WORD_POWERS.get(n + 1)
    folded = alphabet.fold[buf]
    hashes = []
    with np.errstate(over="ignore"):
        for seed in seeds:
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_byte_values(seed)[folded] * up[:n], out=sums[1:])
            hashes.append(_finish((sums[ends] - sums[starts]) * down[starts]))
    return starts, ends, counts, hashes


def _cuts(buf: np.ndarray, alphabet: Alphabet, limit: int) -> list[int]:
    """Places that cut a long text into pieces of about ``limit`` bytes, each
    before a separator; a word longer than a piece stays whole."""
    cuts, at = [0], 0
    while len(buf) - at > limit:
        end, step = at + limit, limit
        while True:
            gaps = np.flatnonzero(~alphabet.is_word[buf[end:end + step]])
            if len(gaps) or end + step >= len(buf):
                break
            end += step
        at = end + int(gaps[0]) if len(gaps) else len(buf)
        cuts.append(at)
    if cuts[-1] < len(buf):
        cuts.append(len(buf))
    return cuts


def words_of(column, alphabet: Alphabet, seeds=(0,), limit: int = GROUP_BYTES) -> Iterator[Words]:
    """Words of every text of an Arrow string column, group by group; starts
    and ends are byte positions relative to the group's first text."""
    buf, offsets = text_buffer(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        part, marks = buf[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at]
        if len(part) <= 2 * limit:
            starts, ends, counts, hashes = _piece(part, marks, alphabet, seeds)
        else:
            cuts = _cuts(part, alphabet, limit)
            got = [_piece(part[a:b], np.array([0, b - a]), alphabet, seeds)
                   for a, b in zip(cuts, cuts[1:])]
            starts = np.concatenate([g[0] + a for g, a in zip(got, cuts)])
            ends = np.concatenate([g[1] + a for g, a in zip(got, cuts)])
            counts = np.array([len(starts)])
            hashes = [np.concatenate([g[3][i] for g in got]) for i in range(len(seeds))]
        yield Words(at, counts, hashes, starts, ends)
        at = to


def sequence_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` consecutive word hashes."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _SEQ_POWERS.get(len(words) + 1)
    with np.errstate(over="ignore"):
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[:len(words)], out=sums[1:])
        return _finish((sums[size:] - sums[:n]) * down[:n])


class SpanHash:
    """Hash of any span of word hashes, from one prefix sum."""

    def __init__(self, words: np.ndarray):
        up, self.down = _SEQ_POWERS.get(len(words) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(words) + 1, np.uint64)
            np.cumsum(words * up[:len(words)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return _finish((self.sums[end] - self.sums[start]) * self.down[start]
                           + (end - start).astype(np.uint64) * _ODD)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    have, out = 1, values
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:len(out) - step], out[step:])
        have += step
    return out


def signed(h: np.ndarray) -> np.ndarray:
    """The same 64 bits as Spark longs."""
    return h.view(np.int64)
