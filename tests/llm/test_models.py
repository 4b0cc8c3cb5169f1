"""Language identification, quality classifier and vector search."""

import random
import zlib

import numpy as np
import pytest
from fixtures import none, odd, odd_rows, rows, sentence
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from netweave.llm import hash_forest, langid, quality


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=20), st.lists(st.integers(0, 4), min_size=1, max_size=15))
def test_cross_parsing_is_greedy_longest_match(training, text):
    table = langid._parser(langid.suffix_automaton(training), 5)
    state = ends = 0
    for symbol in text:
        move = int(table[state * 5 + symbol])
        state, ends = move >> 2, ends + (move & 3)
    whole = "".join(map(str, training))
    phrases, at = 0, 0
    while at < len(text):
        n = 1
        while at + n < len(text) and "".join(map(str, text[at:at + n + 1])) in whole:
            n += 1
        phrases, at = phrases + 1, at + n
    assert ends + (state != 0) == phrases


def test_language_held_out_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = langid.predict(docs, *langid.training_rows(docs)).collect()
    lang = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(got) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held)


def test_language_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.training_rows(docs)
    got = langid.predict(odd(spark), *model).collect()
    assert len(got) == len(odd_rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (2, 3, 4))
    assert by[15].lang_pred in model[0] and by[5].lang_pred in model[0]
    assert langid.predict(none(spark), *model).collect() == []
    assert {r.lang_pred for r in langid.predict(odd(spark), *langid.training_rows(none(spark))).collect()} == {"und"}
    digits = spark.createDataFrame([(1, "123 456"), (2, "я"), (3, "٣٤")], "doc_id long, text string")
    assert [r.lang_pred == "und" for r in langid.predict(digits, *model).orderBy("doc_id").collect()] == [True, False, True]


def test_language_learns_from_whole_texts_and_short_ones(spark):
    """A language known beyond the beginnings of its texts alone, and one of short
    texts alone, are learned; too many labels are an error."""
    latin, greek = ["alpha beta gamma delta " * 400], "αλφα βητα γαμμα δελτα "
    docs = [(i, latin[0] + f"{i}", "la") for i in range(1, 40)]
    docs += [(i, "0 " * 3000 + greek * 200 + f"{i}", "el") for i in range(101, 140)]
    docs += [(i, "今日は良い天気", "ja") for i in range(201, 240)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string")
    training, documents = langid.training_rows(df)
    assert set(training) == {"la", "el", "ja"} and training["ja"] == ["今日は良い天気"]
    assert all(sum(len(x.encode()) for x in t) <= 4 * langid.TRAIN_BYTES for t in training.values())
    assert len(training["el"]) >= len([i for i in range(101, 140) if zlib.crc32(str(i).encode()) % 5])
    assert sum("βητα" in x for x in training["el"]) > 5
    asked = spark.createDataFrame([(1, "γαμμα δελτα"), (2, "gamma delta"), (3, "良い天気")], "doc_id long, text string")
    got = {r.doc_id: r.lang_pred for r in langid.predict(asked, training, documents).collect()}
    assert got == {1: "el", 2: "la", 3: "ja"}
    many = spark.range(3000).selectExpr("id AS doc_id", "'some text here' AS text", "concat('x', id) AS lang")
    with pytest.raises(ValueError, match="languages"):
        langid.training_rows(many)


def test_label_model_finds_accuracies():
    """Votes drawn from known accuracies: posteriors follow the truth."""
    rng = random.Random(3)
    counts, truth = {}, {}
    for _ in range(20_000):
        bad = rng.random() < 0.2
        vote = tuple(int(bad) if rng.random() < a else 1 - int(bad) for a in (0.9, 0.85, 0.8, 0.55))
        counts[vote] = counts.get(vote, 0) + 1
        truth[vote] = truth.get(vote, 0) + bad
    got = quality.estimate(sorted(counts.items()), gold=-1)
    assert all(abs(got[v] - truth[v] / n) < 0.1 for v, n in counts.items() if n > 300)


def test_quality_held_out_labels(spark):
    """Labels of one half train, those of the other half judge."""
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    got = {r.doc_id: r for r in quality.classify(docs, labels.where(half == 0)).collect()}
    assert len(got) == docs.count()
    judged = labels.where(half == 1).join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r for r in judged if r.quality == 1 and r.toxic == 0]
    junk = [r for r in judged if r.quality == 0]
    toxic = [r for r in judged if r.toxic == 1 and r.lang == "en"]
    assert sum(got[r.doc_id].kept for r in clean) >= 0.98 * len(clean)
    assert sum(not got[r.doc_id].kept for r in junk) >= 0.9 * len(junk)
    assert sum(not got[r.doc_id].kept for r in toxic) >= 0.9 * len(toxic)


@pytest.fixture(scope="module")
def judged(spark):
    """Labelled documents of sf0.1 and some more, judged by the labels of the other half."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(2))
    rng = np.random.default_rng(5)
    more = {-1: "#$%&*~^|" * 20_000, -2: "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdef0123456789+/"), 100_000)),
            -3: "".join(chr(0x4E00 + int(i)) for i in rng.integers(0, 3000, 2000)), -4: "This.", -5: "||| $$$ ###"}
    extra = spark.createDataFrame(list(more.items()), "doc_id long, text string")
    rows_ = docs.select("doc_id", "text").unionByName(extra)
    got, known = {}, {}
    for h in (0, 1):
        part = {r.doc_id: r for r in quality.classify(rows_, labels.where(half == h)).collect()}
        test = labels.where(half == 1 - h).join(docs.select("doc_id", "lang", "text"), "doc_id").collect()
        known |= {r.doc_id: r for r in test}
        got |= {i: part[i] for i in [*more, *(r.doc_id for r in test)]}
    return got, known


def test_quality_short_and_blank_free_texts(judged):
    """Texts under 20 words and texts without blanks are judged by what they hold."""
    got, known = judged
    short = [r for r in known.values() if len(r.text.split()) < 20]
    junk, clean = [r for r in short if r.quality == 0], [r for r in short if r.quality == 1 and r.toxic == 0]
    assert len(junk) == 15 and len(clean) > 90
    assert sum(not got[r.doc_id].kept for r in junk) >= 0.7 * len(junk)
    assert sum(got[r.doc_id].kept for r in clean) >= 0.94 * len(clean)
    assert [got[i].junk > 0.5 for i in (-1, -2, -3, -4, -5)] == [True, True, False, False, True]


def test_quality_rejects_toxic_texts_of_every_language(judged):
    """Labels alone tell toxic texts of other languages than English: no listed insult is theirs."""
    got, known = judged
    toxic = [r for r in known.values() if r.toxic == 1]
    rate = {}
    for r in toxic:
        rate.setdefault(r.lang, []).append(not got[r.doc_id].kept)
    print({x: (sum(v), len(v)) for x, v in rate.items()})
    assert set(rate) == {"en", "fr", "de", "es"} and sum(map(len, rate.values())) == 449
    assert sum(rate["en"]) >= 0.9 * len(rate["en"])
    other = [v for x in ("fr", "de", "es") for v in rate[x]]
    assert len(other) == 170 and sum(other) >= 0.4 * len(other)
    assert all(sum(v) >= 0.25 * len(v) for v in rate.values())


def test_both_strata_stay_in_the_sample(spark):
    """Half labelled and half other rows at any number of labels; all of them where they are few."""
    def judged(labelled, others):
        key = F.xxhash64("id")
        votes_of = lambda last, first: F.array(first, F.lit(-1), last).cast("array<tinyint>")
        label = F.when(F.col("id") < labelled, (F.col("id") % 2).cast("int")).otherwise(-1)
        vote = F.when(F.col("id") % 3 > 0, 1).otherwise(-1)
        return spark.range(labelled + others).select(key.alias("key"), votes_of(label, vote).alias("junk"), votes_of(F.lit(-1), F.lit(-1)).alias("toxic"))

    for labelled in (60, 999, 1000, 4000, 20_000):
        got = quality._picks(judged(labelled, 9000), labelled, 9000, 8000).collect()
        human, others = sum(r.q >= 0 for r in got), sum(r.q < 0 for r in got)
        assert human == labelled if labelled <= 4000 else 3700 <= human <= 4300
        assert 3700 <= others <= 4300
    few = quality._picks(judged(10, 20), 10, 20, 8000).collect()
    assert len(few) == 30


def test_repeated_rows_count_once_in_the_sample(spark, monkeypatch):
    sizes, fit = [], quality.fit
    monkeypatch.setattr(quality, "fit", lambda f, v, starts, *a: sizes.append(len(starts) - 1) or fit(f, v, starts, *a))
    docs = spark.createDataFrame([(1, "### $$$ %%% ^^^ &&& ***")] * 500 + [(i, sentence(i, 40)) for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(2, 60)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == 558 and sizes[0] == 59


def test_quality_odd_rows(spark, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    scorer_docs = docs.select("doc_id", "text", F.lit("x").alias("kept"))
    odd_labels = spark.createDataFrame([(1, None, None), (1, 1, 0), (None, 0, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    got = quality.classify(odd(spark), odd_labels).collect()
    assert len(got) == len(odd_rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.kept for r in got if r.doc_id in (2, 3, 4))
    kept = quality.filter_documents(scorer_docs, labels)
    assert kept.schema == scorer_docs.schema and 0 < kept.count() < docs.count()
    assert quality.classify(none(spark), labels).collect() == []
    assert quality.classify(odd(spark), labels.limit(0)).count() == len(odd_rows())


def exact(table, k):
    rows_ = [(i, np.array(v, float)) for i, v in table if i is not None and v and None not in v
             and np.isfinite(v).all() and np.any(v)]
    out = {}
    for i, q in rows_:
        if i % 2 == 0:
            scored = [(-float(np.sum(v * q) / (np.sqrt(np.sum(v * v)) * np.sqrt(np.sum(q * q)))), j) for j, v in rows_ if j != i]
            out[i] = [j for _, j in sorted(scored)[:k]]
    return out


def test_forest_odd_rows(spark):
    """Few vectors: every candidate is met, so the result is exact."""
    rng = np.random.default_rng(2)
    table = [(i, rng.standard_normal(8).tolist()) for i in range(60)]
    table += [(100, table[0][1]), (101, table[0][1]), (102, table[0][1]), (103, None), (104, []), (105, [0.0] * 8), (None, table[1][1]),
              (106, [None] + table[0][1][1:]), (107, [float("nan")] + table[0][1][1:]), (108, [float("inf")] + table[0][1][1:])]
    df = spark.createDataFrame([(i, v, "r", 1.0) for i, v in table], "vec_id long, embedding array<double>, rank string, score double")
    got = {}
    for r in hash_forest.nearest(df, F.col("vec_id") % 2 == 0, recall=1.0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = exact(table, 5)
    assert set(got) == set(want)
    found = sum(len(set(got[q]) & set(want[q])) for q in want) / sum(map(len, want.values()))
    assert found >= 0.97 and got[0][:3] == [100, 101, 102]
    assert hash_forest.nearest(df.limit(0), F.col("vec_id") % 2 == 0).collect() == []
    two = spark.createDataFrame(table[:2], "vec_id long, embedding array<float>")
    assert rows(hash_forest.nearest(two, F.lit(True)).select("query_id", "rank", "vec_id")) in ([(0, 1, 1), (1, 1, 0)], [(1, 1, 0), (0, 1, 1)])


def test_forest_groups_of_copies(spark):
    """Near groups of six settle the length; exact triples among them still get five."""
    rng = np.random.default_rng(4)
    near = np.repeat(rng.standard_normal((400, 64)), 6, axis=0) + 0.1 * rng.standard_normal((2400, 64))
    copies = np.repeat(rng.standard_normal((6, 64)), 3, axis=0)
    table = [(i, v.tolist()) for i, v in enumerate([*near, *copies])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    asks = F.when(F.col("vec_id") < 2400, F.col("vec_id") % 8 == 0).otherwise(F.col("vec_id") % 3 == 0)
    got = {}
    for r in hash_forest.nearest(df, asks).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert len(got) == 306
    assert [q for q, v in got.items() if len(set(v)) < 5 or len(v) != 5] == []
    assert all({q + 1, q + 2} <= set(v) for q, v in got.items() if q >= 2400)


@pytest.mark.parametrize("block", [50_000, 7])
def test_forest_recall(spark, sf, block):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    table = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    got = {}
    for r in hash_forest.nearest(df, F.col("vec_id") % 20 == 0, query_block=block).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = {q: v for q, v in exact(table, 5).items() if q % 20 == 0}
    assert set(got) == set(want)
    assert sum(len(got[q] & set(want[q])) for q in want) >= 0.9 * 5 * len(want)
