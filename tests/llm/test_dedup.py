"""Substring and near-duplicate removal against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from fixtures import lower, none, odd, odd_rows, rows

from netweave.llm import neardup, substring_dedup
from netweave.llm import words as W

_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def cut_repeats(table):
    """doc_id, n_words, n_removed, hash for every row of (doc_id, text)."""
    first = {}
    for i, t in table:
        w = _WORD.findall(t or "")
        for p in range(len(w) - 49):
            if i is not None:
                k = tuple(w[p:p + 50])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in table:
        w = _WORD.findall(t or "")
        gone = set()
        for p in range(len(w) - 49):
            if i is not None and first[tuple(w[p:p + 50])] < i:
                gone.update(range(p, p + 50))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


def test_word_hashes_agree_with_plain_splitting():
    texts = ["", "a", " a  b\tc ", "ä ö", "x" * 3000, "a b " * 2000, None, "A.b-C9"]
    for limit in (64, 1 << 19):
        seen = {}
        for group in W.words_of(pa.array(texts), W.LOWER, limit=limit):
            for j in range(len(group.counts)):
                own = _WORD.findall(lower(texts[group.first + j] or ""))
                got = group.hashes[0][group.bounds[j]:group.bounds[j + 1]].tolist()
                assert len(got) == len(own)
                for w, h in zip(own, got):
                    assert seen.setdefault(w, h) == h
        assert len(set(seen.values())) == len(seen)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 1000, 200)
    for width in (1, 2, 7, 35):
        assert W.sliding_min(x, width).tolist() == [x[i:i + width].min() for i in range(len(x) - width + 1)]


def test_substring_dedup_equals_brute_force(spark, sf):
    docs = documents(spark, sf)
    got = substring_dedup.strip_spans(docs, substring_dedup.repeated_spans(docs))
    want = cut_repeats([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
    assert sorted(rows(got.select("doc_id", "n_words", "n_removed", "kept_sha256"))) == sorted(want)


def test_substring_dedup_odd_rows(spark):
    docs = odd(spark)
    got = rows(substring_dedup.strip_spans(docs, substring_dedup.repeated_spans(docs))
               .select("doc_id", "n_words", "n_removed", "kept_sha256"))
    want = cut_repeats([r[:2] for r in odd_rows()])
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rows(substring_dedup.strip_spans(none(spark), substring_dedup.repeated_spans(none(spark)))) == []


def test_remove_repeats_keeps_columns(spark):
    docs = odd(spark)
    got = substring_dedup.remove_repeats(docs)
    assert got.schema == docs.schema
    by = {r.doc_id: r for r in got.collect() if r.doc_id is not None}
    assert by[1].text == odd_rows()[0][1] and 7 not in by and by[4].text == " \t\n "
    assert by[10].n_chars == len(by[10].text) and by[13].kept == "k"


def link_components(table, shingle, similarity):
    sets = defaultdict(set)
    for i, t in table:
        if i is not None and i not in sets:
            w = _WORD.findall(lower(t or ""))
            sets[i] = {tuple(w[p:p + shingle]) for p in range(len(w) - shingle + 1)} if len(w) >= shingle else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    inverted = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            inverted[x].append(i)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in inverted[x] if j < i).items():
            if 100 * n >= similarity * (len(s) + len(sets[j]) - n):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("shingle", [2, 5])
def test_near_duplicates_equal_brute_force(spark, sf, shingle):
    docs = documents(spark, sf)
    want = link_components([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], shingle, 80)
    got = neardup.near_duplicates(docs, shingle=shingle).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(want)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_odd_rows(spark):
    plain = [r for r in odd_rows() if r[1] != "other words here"]
    docs = spark.createDataFrame(plain, odd(spark).schema)
    got = neardup.near_duplicates(docs, shingle=2).collect()
    want = link_components([r[:2] for r in plain], 2, 80)
    assert len(got) == len(plain)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None} == want
    assert all(r.component_id is None and r.kept for r in got if r.doc_id is None)
    assert neardup.near_duplicates(none(spark)).collect() == []


def test_keep_one_has_one_row_a_group(spark):
    docs = odd(spark)
    got = neardup.keep_one(docs, shingle=2)
    assert got.schema == docs.schema
    ids = [r.doc_id for r in got.collect()]
    known = [i for i in ids if i is not None]
    assert sorted(known) == sorted(set(known)) and ids.count(None) == 2
    assert {1, 2, 3, 4, 5, 11} <= set(known) and not {6, 7, 8, 12} & set(known)
    assert neardup.keep_one(none(spark)).collect() == []


@pytest.mark.parametrize("block", [256, 8])
def test_large_group_of_near_copies_is_one_component(spark, monkeypatch, block):
    """Copies of one text, each with a few words of its own, and a chain in which
    only neighbours are similar enough."""
    monkeypatch.setattr(neardup, "BLOCK", block)
    base = [f"w{i}" for i in range(100)]
    texts = []
    for i in range(150):
        w = base[:]
        for j in range(3):
            w[(i * 7 + j * 31) % 100] = f"own{i}x{j}"
        texts.append((1000 + i, " ".join(w)))
    chain = [(5000 + i, " ".join(f"c{j}" for j in range(i * 6, i * 6 + 100))) for i in range(30)]
    docs = spark.createDataFrame(texts + chain, "doc_id long, text string")
    want = link_components(texts + chain, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got == want
    assert {c for _, c in want.values()} == {1000, 5000}


def test_rows_that_share_a_doc_id_are_judged_apart(spark):
    """A row's links are those of its own text; only near copies go."""
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    rows_ = [(1, a), (5, a + ["x"]), (5, b), (9, b + ["y"]), (5, b), (7, []), (7, [])]
    docs = spark.createDataFrame([(i, " ".join(w), "k") for i, w in rows_], "doc_id long, text string, root string")
    got = sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(docs, 5).collect())
    assert got == sorted([(1, 56, 1, True), (5, 57, 1, False), (5, 56, 5, True), (5, 56, 5, True), (9, 57, 5, False),
                          (7, 0, 7, True), (7, 0, 7, True)])
    kept = neardup.keep_one(docs, 5)
    assert kept.schema == docs.schema
    assert sorted((r.doc_id, r.text) for r in kept.collect()) == [(1, " ".join(a)), (5, " ".join(b)), (7, "")]


def test_parities_rule_out_no_link():
    """Buckets whose parity differs never exceed the members of one set only, at
    every length to which parities fold."""
    rng = np.random.default_rng(5)
    for size in (1, 30, 300, 3000, 30_000):
        base = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for changed in (0, size // 10, size // 3):
            other = np.concatenate([base[changed:], rng.integers(0, 1 << 63, 2 * changed, dtype=np.uint64)])
            one, two = np.unique(base), np.unique(other)
            flat, to = neardup._parities(np.concatenate([one, two]), np.array([len(one), len(two)]))
            folded = neardup._folded(flat.view(np.uint64), np.diff(to))
            for n in (n for n in folded if n <= np.diff(to).min()):
                assert np.bitwise_count(folded[n][0] ^ folded[n][1]).sum() <= len(np.setxor1d(one, two))


def test_family_below_the_similarity_makes_no_pairs(spark):
    """Texts that share 70 % of their shingles lie within the signature distance
    but have no link: they leave no pair to confirm, and links among them stay."""
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(60):
        w = base[:]
        for j in rng.choice(300, 27, replace=False):
            w[j] = f"own{i}x{j}"
        texts.append((i, " ".join(w)))
    texts += [(100 + i, t + f" end{i}") for i, t in texts[:20]]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    want = link_components(texts, 2, 80)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, shingle=2).collect()}
    assert got == want and len({c for _, c in want.values()}) == 60


def test_substring_dedup_phrases_that_texts_repeat_within(spark):
    """Two words in turn, in some texts at length, with and without other words between."""
    beat = ["one two " * n for n in (24, 25, 26, 60, 200)]
    texts = [*beat, "start " + beat[3] + "middle " + beat[2] + "end", "middle " + beat[2] + "other words " + beat[1],
             " ".join(f"w{i % 7}" for i in range(300)), "w0 w1 " * 40 + " ".join(f"w{i % 7}" for i in range(160))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = substring_dedup.repeated_spans(docs)
    got = substring_dedup.strip_spans(docs, spans).select("doc_id", "n_words", "n_removed", "kept_sha256")
    assert sorted(rows(got)) == sorted(cut_repeats(list(enumerate(texts))))
    assert spans.count() < 60  # not a row a place


def test_anchors_of_a_text_that_repeats_itself():
    """Joins on anchors see an edge of a text once, with how often it is met."""
    texts = ["again and " * 2000, " ".join(f"w{i}" for i in range(200)), None, "short"]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3, 4]), pa.array(texts)], ["doc_id", "text"])
    rows = pa.Table.from_batches(list(substring_dedup._anchor_rows(50)(iter([batch])))).to_pylist()
    met = [r["times"] for r in rows if r["doc_id"] == 1]
    assert len(met) <= 4 and sum(met) > 100
    assert all(r["times"] == 1 for r in rows if r["doc_id"] == 2)
    assert len({(r["doc_id"], r["node"], r["edge"]) for r in rows}) == len(rows)
