"""Token files and packing: exact round trips and valid sequences."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from fixtures import none, odd, odd_rows, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import packing, token_files, tokens
from netweave.session import scratch_path


def ids_of(name, text):
    from tokenizers import Tokenizer
    model = Tokenizer.from_file(token_files.vocabulary(name))
    model.encode_special_tokens = True
    return model.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


ALPHABET = list("abzAZ019 \t\n\r'.,!?-éßñçİıſ") + ["'s", "'LL", "  ", "don't", " ", "́", "你", "<|endoftext|>", "\x1c", "ǅ"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join))
@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_cached_encoding_equals_the_library(name, text):
    enc = tokens.encoder(token_files.vocabulary(name))
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids_of(name, text)


def test_long_texts_are_cut_safely(monkeypatch):
    monkeypatch.setattr(tokens, "PIECE_CHARS", 10)
    enc = tokens.Encoder(token_files.vocabulary("byte_bpe_50k.json"))
    text = "it's  a test\n\n of  words, and more\t\twords 123 " * 5
    assert np.frombuffer(enc.encode([text])[0], "<u4").tolist() == ids_of("byte_bpe_50k.json", text)


@pytest.mark.parametrize("width", [16, 32])
def test_token_files_round_trip(spark, width):
    folder = scratch_path(spark, "token_files")
    files = token_files.write_token_files(odd(spark), folder, token_files.vocabulary("byte_bpe_50k.json"), 2, width)
    got = rows(token_files.read_token_files(spark, folder, files))
    order = sorted(((-(1 << 63) if r[0] is None else r[0], r[1] is not None, r[1] or "", r[0]) for r in odd_rows()))
    want, start = [], 0
    for _, _, text, doc in order:
        ids = ids_of("byte_bpe_50k.json", text) + [2]
        want.append((doc, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    used = token_files.read_token_files(spark, folder, files).select(F.spark_partition_id().alias("p")).distinct().count()
    assert used > 1 or files.count() == 1
    folder = scratch_path(spark, "token_files")
    files = token_files.write_token_files(none(spark), folder, token_files.vocabulary("byte_bpe_50k.json"), 2)
    assert rows(token_files.read_token_files(spark, folder, files)) == []


def check_packing(got, table, capacity, end):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for doc, piece, start, length, ids, sequence, offset in got:
        pieces[(doc, piece, start, length, ids)].append(1)
        sequences[sequence].append((offset, length))
    want = defaultdict(list)
    for doc, text in table:
        ids = ids_of("word_bpe_49k.json", text) + [end]
        for k, lo in enumerate(range(0, len(ids), capacity)):
            part = ids[lo:lo + capacity]
            want[(doc, k, lo, len(part), crc(part))].append(1)
    assert pieces == want
    for held in sequences.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing_holds_every_piece(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 3)
    cut = packing.pieces(odd(spark), token_files.vocabulary("word_bpe_49k.json"), 0, 128)
    got = rows(packing.pack(spark, cut, 128))
    used = check_packing(got, [r[:2] for r in odd_rows()], 128, 0)
    assert used <= -(-sum(r[3] for r in got) // 128) + 1
    cut = packing.pieces(none(spark), token_files.vocabulary("word_bpe_49k.json"), 0)
    assert rows(packing.pack(spark, cut)) == []


def least_bins(items, capacity):
    """Exact number of bins by search, for small instances."""
    items = sorted(items, reverse=True)

    def fits(n):
        room = [capacity] * n

        def place(i):
            if i == len(items):
                return True
            tried = set()
            for b in range(n):
                if room[b] >= items[i] and room[b] not in tried:
                    tried.add(room[b])
                    room[b] -= items[i]
                    if place(i + 1):
                        return True
                    room[b] += items[i]
            return False
        return place(0)

    n = -(-sum(items) // capacity)
    while not fits(n):
        n += 1
    return n


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9), st.integers(20, 30))
def test_reduction_keeps_an_optimum(items, capacity):
    counts = {x: items.count(x) for x in items}
    p = packing.Plan(capacity, dict(counts))
    p.reduce()
    rest = [x for x, n in p.left.items() for _ in range(n)]
    assert p.sequences + (least_bins(rest, capacity) if rest else 0) == least_bins(items, capacity)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_plan_places_every_piece_once(items):
    counts = {x: items.count(x) for x in items}
    p = packing.plan(counts, 64)
    held, ranks = defaultdict(list), defaultdict(list)
    for length, lo, hi, sequence, per, offset in p.ranges:
        for t in range(hi - lo):
            held[sequence + t // per].append((offset + t % per * length, length))
            ranks[length].append(lo + t)
    assert {x: sorted(r) for x, r in ranks.items()} == {x: list(range(n)) for x, n in counts.items()}
    for pieces in held.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 64
    assert len(held) == p.sequences
