"""Spelling variants against plain edit distance, and the reduced neighbourhoods."""

import random
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import none, odd, odd_rows, rows
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import spelling as V


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    i = next((i for i, c in enumerate(a) if c != b[i]), len(a))
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i:] == b[i + 1:]


def brute(table, every=31):
    counts = Counter()
    for doc, text in table:
        for run in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run if h % every else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = {w: sorted((o for o in words if one_edit(w, o)), key=lambda o: (-words[o], o)) for w in words}
    form = {w: o[0] if o and words[o[0]] >= 10 * words[w] else None for w, o in near.items()}
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out, key=repr)


def variants(seed, letters="abdeéà÷"):
    """Documents of words with many near ones, with counts that make chains."""
    rng = random.Random(seed)
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(6, 10))) for _ in range(12)]
    texts = []
    for w in base:
        texts.append(f"{w} " * 300)
        one = w[:3] + rng.choice(letters) + w[4:]
        texts.append(f"{one.upper() if one.isascii() else one} " * 25)
        texts.append(f"{one}{rng.choice(letters)} " * 2)
        texts.append(f"{w[1:]} {w[1:]}")
    return list(enumerate(texts))


def test_equals_brute_force_with_chains(spark):
    table = variants(1) + variants(2, "abc")
    got = rows(V.group_variants(spark.createDataFrame(table, "doc_id long, text string")))
    want = brute(table)
    assert sorted(got, key=repr) == want
    assert any(r[1] and r[2] != r[1] for r in want)  # a chain of two forms at least


def test_deleted_letters(spark):
    rng = random.Random(5)
    table = [(i, " ".join(rng.choices(["mississippi", "Straßenbahn", "übermorgen", "abcdefgh", "ÀÉÎÕÜÿý×"], k=40))) for i in range(120)]
    assert sorted(rows(V.group_variants(spark.createDataFrame(table, "doc_id long, text string"), 3)), key=repr) == brute(table, 3)


def test_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60")
    table = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(rows(V.group_variants(docs)), key=repr) == brute(table)


def test_odd_rows_and_long_words(spark):
    long = "".join(random.Random(3).choices("abcdefghij", k=6000))
    extra = [(100, f"{long} {long}"), (101, f"{long[:-1]} {long[:-1]} {long}x {long}x"), (102, "x" * 9), (102, "x" * 9)]
    table = [(r[0], r[1]) for r in odd_rows()] + extra
    docs = odd(spark).unionByName(spark.createDataFrame(extra, "doc_id long, text string"), allowMissingColumns=True)
    assert sorted(rows(V.group_variants(docs)), key=repr) == brute(table)
    assert rows(V.group_variants(none(spark))) == []


@settings(max_examples=60, deadline=None)
@given(st.text("abcdefgéà", min_size=1, max_size=12), st.data())
def test_neighbourhoods_hold_every_edit(word, data):
    other = data.draw(st.sampled_from("abzé")).join
    i = data.draw(st.integers(0, len(word)))
    edits = [word, word[:i] + other(["", ""]) + word[i:]] + ([word[:i] + word[i + 1:], word[:i] + "q" + word[i + 1:]] if i < len(word) else [])
    keys = {int(k) for m in V.neighbour_keys([word], len(word)) for k in m[0]}
    assert all(int(V.own_keys([e], len(e))[0]) in keys for e in edits if e)
    assert len(keys) <= 1 + len(word) * (1 + V.SYMBOLS) + (len(word) + 1) * V.SYMBOLS


def test_neighbourhoods_in_blocks(monkeypatch):
    words = ["abcdefghijkl", "aaaaaaaaaaaa"]
    whole = [np.sort(np.concatenate(m)) for m in zip(*V.neighbour_keys(words, 12))]
    monkeypatch.setattr(V, "CHUNK_KEYS", 64)
    blocks = list(V.neighbour_keys(words, 12))
    assert len(blocks) > 3
    assert all((np.sort(np.concatenate(m)) == w).all() for m, w in zip(zip(*blocks), whole))
