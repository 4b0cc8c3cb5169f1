"""Exact, cached encoding of whole texts with the tokenizers library.

Both public vocabularies cut a text into pre-tokens by a published pattern
before any merge is made, so the ids of a text are the ids of its pre-tokens in
order. Each worker keeps the ids of pre-tokens it has met (at most
``CACHE_SIZE``, then it starts anew) and hands only new ones to the library. A
text with characters beyond printable ASCII, tab, line ends and Latin letters
goes to the library whole, since the pattern's Unicode classes differ from
Python's there.

Strings that look like special tokens are ordinary text, as the vocabulary's
notes ask (``encode_special_tokens``).
"""

from __future__ import annotations

import os
import re
from itertools import chain, filterfalse

import numpy as np

CACHE_SIZE = 600_000
#: Texts beyond this many characters go through the cache piece by piece.
PIECE_CHARS = 1 << 20

# The published split patterns of the two vocabularies, with the
# letter class written out for the characters accepted here.
LETTERS = "A-Za-zÀ-ÖØ-öø-įı-ɏ"
SPLIT = {
    "byte_bpe_50k.json": rf"'(?:[stmd]|re|ve|ll)| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\s+(?!\S)|\s+",
    "word_bpe_49k.json": rf"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+",
}
#: Vocabularies that lower-case a text before they cut it.
FOLDED = {"word_bpe_49k.json"}
#: How both vocabularies write bytes: printable ones as they are, the others as
#: the characters from 256 on, in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _PRINTED)}
_OTHER = re.compile(rf"[^\x20-\x7e\t\n\r{LETTERS}]")
_WORKER: dict[str, Encoder] = {}


class Encoder:
    """Texts to little-endian unsigned 32-bit ids, as bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.split = re.compile(SPLIT[os.path.basename(path)]).findall
        self.folded = os.path.basename(path) in FOLDED
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.model.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, new: list[str]) -> None:
        """Ids of pre-tokens, from the library's merges alone: cutting and
        folding are done, and bytes are written as the vocabulary writes them."""
        merge, known = self.model.model.tokenize, self.known
        ids, ends = [], []
        for piece in new:
            ids += [t.id for t in merge(piece.encode().decode("latin-1").translate(_BYTES))]
            ends.append(len(ids))
        raw, at = np.array(ids, "<u4").tobytes(), 0
        for piece, end in zip(new, ends):
            known[piece] = raw[4 * at:4 * end]
            at = end

    def _pieces(self, text: str):
        """A long text cut before a blank that follows a non-blank: there a
        pre-token ends for certain."""
        at = 0
        while len(text) - at > PIECE_CHARS:
            cut = re.compile(r"(?<=[^ \t\n\r])[ \t\n\r]").search(text, at + PIECE_CHARS)
            if not cut:
                break
            yield text[at:cut.start()]
            at = cut.start()
        yield text[at:]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; an empty text has none."""
        if len(self.known) > CACHE_SIZE:
            self.known = {}
        parts = []
        for t in texts:
            folded = t.lower() if self.folded else t
            odd = _OTHER.search(t) or (self.folded and _OTHER.search(folded))
            parts.append(None if odd else [self.split(p) for p in self._pieces(folded)])
        words = chain.from_iterable(p for ps in parts if ps for p in ps)
        fresh = set(filterfalse(self.known.__contains__, words))
        if fresh:
            self._learn(list(fresh))
        get = self.known.__getitem__
        return [self.whole(t) if ps is None else b"".join(b"".join(map(get, p)) for p in ps)
                for t, ps in zip(texts, parts)]


def encoder(path: str) -> Encoder:
    """This worker's encoder; its cache lives as long as the worker."""
    if path not in _WORKER:
        _WORKER[path] = Encoder(path)
    return _WORKER[path]


def groups(texts: list[str | None], chars: int = 1 << 19):
    """(first row, texts) of groups of about ``chars``; null is empty text."""
    first, group, size = 0, [], 0
    for i, t in enumerate(texts):
        group.append(t or "")
        size += len(group[-1])
        if size >= chars:
            yield first, group
            first, group, size = i + 1, [], 0
    if group:
        yield first, group


def forget() -> None:
    """Drop this worker's encoders and what they have kept."""
    _WORKER.clear()
