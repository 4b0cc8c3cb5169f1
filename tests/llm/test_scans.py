"""Licence scan and benchmark decontamination against brute force."""

import random
import re
from collections import defaultdict

import pytest
from fixtures import lower, none, odd, odd_rows, rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st

from netweave.llm import decontaminate, licenses

_ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_places(text):
    words = _ALNUM.findall(lower(text or ""))
    found = []
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    starts = [i for i, _ in found]
    return (len(words), len(found), min(starts, default=None), max(starts, default=None),
            ",".join(sorted({x for _, x in found})))


def test_base_phrases_equal_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = licenses.scan_licenses(docs).collect()
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    assert {r.doc_id: tuple(r)[1:6] for r in got} == {i: base_places(t) for i, t in texts.items()}
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


def test_license_odd_rows(spark):
    got = rows(licenses.scan_licenses(odd(spark)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels"))
    want = [(r[0], *base_places(r[1])) for r in odd_rows()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert rows(licenses.scan_licenses(none(spark))) == []


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.integers(0, 3), min_size=1, max_size=8), min_size=1, max_size=4),
       st.lists(st.integers(0, 4), max_size=12))
def test_matching_statistics(templates, text):
    a = licenses.Automaton(templates)
    runs = defaultdict(set)
    for n, t in enumerate(templates):
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                runs[tuple(t[i:j])].add((n, j))
    for i, (length, state) in enumerate(a.statistics(text)):
        best = max((k for k in range(i + 2) if k == 0 or tuple(text[i + 1 - k:i + 1]) in runs), default=0)
        assert length == best
        if length:
            assert a.ends[state] == runs[tuple(text[i + 1 - length:i + 1])]


def test_chained_templates(spark):
    grant = dict(licenses.TEMPLATES)["mit"]
    words = licenses.template_words(grant)
    hole = " ".join(words[:20] + ["some", "other"] + words[22:])
    texts = {1: f"{sentence(5, 40)} {grant} {sentence(6, 40)}", 2: hole, 3: " ".join(words[:10]), 4: sentence(7, 400),
             5: "apache license apache license", 6: "Licensed under CC BY-NC 4.0."}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan_licenses(docs).collect()}
    assert got[1].labels == got[2].labels == "mit" and got[1].score == 1.0 and 0.7 <= got[2].score < 1
    assert got[1].n_base == 0 and got[1].spans[0].start == 40
    assert got[3].labels == got[4].labels == "" and got[4].score == 0
    assert got[5].n_base == 2 and got[5].last_word == 2 and got[6].labels == "cc-by,cc-by-nc"


def leaked(table, items, share):
    """Best aligned share of every item in every document, by all diagonals."""
    found = {}
    for doc, text in table:
        words = _WORD.findall(lower(text or ""))
        for item, passage in items:
            own = _WORD.findall(lower(passage or ""))
            for o in range(-len(own), len(words)):
                same = sum(1 for q, w in enumerate(own) if 0 <= o + q < len(words) and words[o + q] == w)
                if own and same >= share * len(own) - 1e-9:
                    found[(doc, item)] = max(found.get((doc, item), 0), same)
    return found


def passages():
    rng = [(1, sentence(11, 24)), (2, sentence(12, 40)), (3, sentence(13, 6)), (4, None), (5, ""), (6, sentence(14, 15)), (6, sentence(14, 15))]
    return rng


@pytest.mark.parametrize("block_words", [4_000_000, 20])
def test_leaks_equal_brute_force(spark, block_words):
    items = passages()
    a, b, c, d = (items[i][1] for i in (0, 1, 2, 5))
    swap = lambda s, *at: " ".join("zzz" if i in at else w for i, w in enumerate(s.split()))
    table = [(1, f"{sentence(21, 30)} {a} {sentence(22, 30)}"), (2, f"x {swap(a, 5, 17)} y"), (3, f"{swap(b, 3, 19, 33)}\n{c}"),
             (4, sentence(23, 500)), (5, " ".join(a.split()[:10])), (6, None), (7, ""), (8, a.upper()), (9, f"{d} {d}"), (None, c),
             (10, swap(d, 7)), (11, f"{a} {b} {c} {d}"), (1, f"{sentence(21, 30)} {a} {sentence(22, 30)}")]
    docs = spark.createDataFrame([(i, t, "e") for i, t in table], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = decontaminate.leaks(docs, bench, block_words=block_words).collect()
    want = leaked(table, items, 0.8)
    assert {(r.doc_id, r.item_id): r.matched for r in got} == want and len(got) == len(want)
    assert {1, 2, 3, 8, 9, 11} <= {d for d, _ in want}
    clean = decontaminate.drop_leaking(docs, bench, block_words=block_words)
    assert clean.schema == docs.schema
    assert sorted(r.doc_id for r in clean.collect()) == [4, 5, 6, 7]


def test_two_substitutions_leave_a_hit():
    """In a run of twice the span some mask misses any two places."""
    span, n = decontaminate.SPAN, 2 * decontaminate.SPAN
    for i in range(n):
        for j in range(i, n):
            assert any(all(m[q] == "0" or p + q not in (i, j) for q in range(span))
                       for m in decontaminate.MASKS for p in range(n - span + 1))


def test_cut_and_shifted_items_leak(spark):
    """Items cut by the end of a document, long parts, and words put in or left out."""
    items = [(n, sentence(300 + n, n)) for n in (15, 18, 21, 30, 59, 500)]
    own = {n: t.split() for n, t in items}
    around = lambda words, seed: f"{sentence(seed, 40)} {' '.join(words)} {sentence(seed + 1, 40)}"
    cases = []
    for n, w in own.items():
        h = n // 2
        cases += [(n, around([*w[:h], "zzz", *w[h:]], n)), (n, around([*w[:h], *w[h + 1:]], n))]
        if n >= 18:
            cases += [(n, around(w[:n * 3 // 4], n)), (n, f"{sentence(n, 40)} {' '.join(w[:13])}"), (n, f"{' '.join(w[-13:])} {sentence(n, 9)}")]
        if n >= 59:
            third = n // 3
            cases += [(n, around([*w[:third], "a", "b", *w[third:2 * third], *w[2 * third + 3:]], n))]
    docs = spark.createDataFrame([*[(i, t) for i, (_, t) in enumerate(cases)], (1000, around(own[30][:9], 5)),
                                  (1001, around([*own[30][:9], *sentence(9, 9).split(), *own[30][9:18]], 6))], "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == {(i, n) for i, (n, _) in enumerate(cases)}
    assert (got[0, 15].matched, got[0, 15].start, got[1, 15].matched) == (15, 40, 14)
    clean = decontaminate.drop_leaking(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(r.doc_id for r in clean.collect()) == [1000, 1001]


def test_allowed_substitutions_at_every_length(spark):
    """Up to 20 % of the words of items of 2 to 30 words, anywhere, against brute force."""
    rng = random.Random(8)
    items = [(n, sentence(500 + n, n)) for n in range(2, 31)]
    table = []
    for n, text in items:
        for round_ in range(12):
            words = text.split()
            for i in rng.sample(range(n), n // 5 + (round_ == 0)):
                words[i] = "zzz"
            table.append((len(table), f"{sentence(len(table), 5)} {' '.join(words)} {sentence(len(table) + 1, 5)}"))
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.matched for r in decontaminate.leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want = leaked(table, items, 0.8)
    assert len(want) >= 11 * len(items) and {k: got.get(k) for k in want} == want
    assert all(item >= decontaminate.LOCAL_WORDS for _, item in set(got) - set(want))


def test_leaks_of_test_tables(spark, sf):
    docs, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()}
    items = [(r.item_id, _WORD.findall(lower(r.text))) for r in bench.collect()]
    texts = [(r.doc_id, _WORD.findall(lower(r.text))) for r in docs.collect()]
    whole = {(d, i) for d, w in texts for i, own in items if f" {' '.join(own)} " in f" {' '.join(w)} "}
    assert whole and whole <= got


def test_leaks_empty(spark):
    bench = spark.createDataFrame(passages(), "item_id long, text string")
    assert decontaminate.leaks(none(spark), bench).collect() == []
    assert decontaminate.leaks(odd(spark), bench.limit(0)).collect() == []
    assert decontaminate.drop_leaking(odd(spark), bench.limit(0)).count() == len(odd_rows())


def test_items_of_a_word_or_two_drop_nothing(spark):
    docs = spark.createDataFrame([(1, "the end of the line"), (2, "in the end all is well"), (3, "quiet")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "the"), (2, " the  end "), (3, "all is well"), (4, ""), (5, None)], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(docs, bench).collect()) == [1, 3]
    assert sorted(map(tuple, decontaminate.short_items(bench).collect())) == [(1, 1), (2, 2)]
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} == {
        (1, 1), (1, 2), (2, 1), (2, 2), (2, 3)}
    assert sorted(r.doc_id for r in decontaminate.drop_leaking(docs, bench, least_words=4).collect()) == [1, 2, 3]
