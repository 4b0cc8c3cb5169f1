"""Cross-tokenizer alignment against a plain version over the two libraries."""

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece
from fixtures import none, odd, odd_rows, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from netweave.llm import align as X
from netweave.llm.phf import PerfectHash
from netweave.llm.token_files import vocabulary
from netweave.session import scratch_path

A, B = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
TEXTS = ["", None, " ", "  two  spaces ", "tab\tline\n\nend \r\n", "don't İstanbul ☕ é é ﬁ ｆｉ", "a ▁ b", "▁", "<s> </s> <|endoftext|> <0x41>",
         "x" * 3000, "日本語のテキスト 中文", "null \0 byte", "a" + " " * 300 + "b", "trailing   ", "🙂🙂 mixed 🙂"]


def tokens_of(text):
    model, pieces = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    model.encode_special_tokens = True
    back = {}
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    for b in range(256):
        back[chr(b) if b in printed else chr(256 + sum(c not in printed for c in range(b)))] = b
    def cut(t):
        if not t:
            return [], []
        a = [(i, bytes(back[c] for c in model.id_to_token(i))) for i in model.encode(" " + t, add_special_tokens=False).ids]
        b = [(i, bytes([int(pieces.id_to_piece(i)[3:5], 16)]) if pieces.is_byte(i) else pieces.id_to_piece(i).replace("▁", " ").encode())
             for i in pieces.encode(t)]
        whole = (" " + t).encode()
        return (a, b) if b"".join(x for _, x in a) == b"".join(x for _, x in b) == whole else ([], [])
    return [cut(t) for t in text]


def spans(tokens):
    at, out = 0, []
    for i, raw in tokens:
        out.append((i, at, at + len(raw)))
        at += len(raw)
    return out


def brute(table):
    cut = [(spans(a), spans(b)) for a, b in tokens_of([t for _, t in table])]
    links = []
    for a, b in cut:
        found, j = [], 0
        for i, s, e in a:
            while j and b[j - 1][2] > s:
                j -= 1
            while j < len(b) and b[j][1] < e:
                if b[j][2] > s:
                    found.append((i, b[j][0]))
                j += 1
        links.append(found)
    counts = Counter(p for found in links for p in set(found))
    high = defaultdict(int)
    for (i, _), n in counts.items():
        high[i] = max(high[i], n)
    out = []
    for (doc, _), (a, b), found in zip(table, cut, links):
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups, at = [], [0, 0]
        for end in ends:
            sides = []
            for k, side in enumerate((a, b)):
                first = at[k]
                while at[k] < len(side) and side[at[k]][2] <= end:
                    at[k] += 1
                sides.append(",".join(str(i) for i, _, _ in side[first:at[k]]))
            groups.append("|".join(sides))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((doc, len(a), len(b), len(groups), len(found), sum(counts[p] == high[p[0]] for p in found),
                    sum(counts[p] for p in found), digest))
    return sorted(out, key=repr), counts


def aligned(spark, docs):
    return sorted(rows(X.align(docs, scratch_path(spark, "align"), A, B)), key=repr)


def test_documents_and_awkward_texts(spark, sf, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_PAIRS", 400)  # many buckets
    monkeypatch.setattr(X, "FAN", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").where("doc_id < 70").unionByName(
        spark.createDataFrame(list(enumerate(TEXTS, 10**6)), "doc_id long, text string"))
    table = [tuple(r) for r in docs.collect()]
    want, counts = brute(table)
    assert aligned(spark, docs) == want
    zero = {r[0] - 10**6 for r in want if r[0] >= 10**6 and r[1] == 0}
    assert zero == {0, 1, 6, 7}

    ids = X.written(X.encode(docs, A, B), "ids")
    folder = scratch_path(spark, "pairs")
    buckets = X.count_pairs(ids, folder)
    assert buckets > 5
    assert {(r.id_a, r.id_b): r["count"] for r in X.pair_counts(spark, folder, buckets).collect()} == dict(counts)


def test_odd_rows_and_empty_table(spark):
    assert aligned(spark, odd(spark)) == brute([(r[0], r[1]) for r in odd_rows()])[0]
    assert aligned(spark, none(spark)) == []
    only = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert aligned(spark, only) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_counts_spread_over_more_buckets_than_a_worker_holds(monkeypatch, tmp_path):
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 31, 4000))
    of = X._buckets_of(keys, 9)
    for b in range(9):
        with open(tmp_path / f"hash-{b:05d}.bin", "wb") as f:
            PerfectHash(keys[of == b]).dump(f)
    monkeypatch.setattr(X, "HOLD", 2)
    store = X.Store(str(tmp_path), "hash", PerfectHash.load)
    for backwards in (False, True):
        seen = 0
        for b, at in X._by_bucket(keys, 9, backwards):
            slots = store.get(b).slots(keys[at])
            assert sorted(slots) == list(range(len(at))) and len(store.held) <= 2
            seen += len(at)
        assert seen == len(keys)


@settings(max_examples=60, deadline=None)
@given(st.sets(st.integers(0, (1 << 62) - 1), max_size=400), st.integers(0, 1 << 62))
def test_perfect_hash(tmp_path_factory, keys, foreign):
    keys = np.array(sorted(keys), np.int64)
    path = tmp_path_factory.mktemp("phf") / "h"
    with open(path, "wb") as f:
        PerfectHash(keys).dump(f)
    with open(path, "rb") as f:
        table = PerfectHash.load(f)
    assert sorted(table.slots(keys)) == list(range(len(keys)))
    assert (table.keys[table.slots(keys)] == keys).all()
    assert (table.slots(np.array([foreign])) >= 0).all() == (foreign in set(keys.tolist()))


def test_perfect_hash_of_many_keys():
    keys = np.random.default_rng(2).permutation(300_000).astype(np.int64) * 65_537
    table = PerfectHash(keys)
    assert (np.sort(table.slots(keys)) == np.arange(len(keys))).all()
    assert (table.slots(keys + 1) == -1).all()
    bits = sum(64 * len(w) for _, w, _ in table.levels)
    assert bits < 4 * len(keys)


def test_units_equal_the_library(monkeypatch):
    pieces = X.Pieces(B)
    assert pieces.by_unit
    texts = list(filter(None, TEXTS))
    for size in (600_000, 6):  # the second forgets units all the time
        monkeypatch.setattr(X, "CACHE_SIZE", size)
        for part in ([t] for t in texts * 2) if size < 10 else (texts, texts):
            for t, raw in zip(part, pieces.encode([f" {t}" for t in part])):
                assert raw is None if "▁" in t else np.frombuffer(raw, "<u2").tolist() == pieces.model.encode(t)


def test_wide_vocabulary_is_refused(monkeypatch):
    class Wide:
        def __init__(self, model_file):
            pass

        def get_piece_size(self):
            return (1 << 16) + 1

        def id_to_piece(self, i):
            return "x"
    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Wide)
    with pytest.raises(ValueError):
        X.Pieces("any")


def test_passes_after_encoding_hold_little():
    """They keep no vocabulary, need none, and align half a million tokens at a time."""
    X.pieces(B), X.tokens.encoder(A)
    sizes = X._sizes(A, B)
    X._forget()
    assert not X._WORKER and not X.tokens._WORKER
    token = np.zeros(1 << 15, "<u2").tobytes()
    batch = pa.RecordBatch.from_arrays([pa.array(range(40)), pa.array([token] * 40), pa.array([token] * 40)], ["doc_id", "ids_a", "ids_b"])
    parts = list(X._aligned([batch], tuple(np.ones_like(s) for s in sizes)))
    assert [i for ids, _ in parts for i in ids] == list(range(40))
    assert all(len(p.a) + len(p.b) <= (1 << 19) + (1 << 16) for _, p in parts)
    assert not X._WORKER and not X.tokens._WORKER
