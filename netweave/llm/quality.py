"""Quality classifier: a weak-label model trains a hashed linear scorer.

Two things make a text unwanted: it is *junk* or it is *toxic*. For each there are
overlapping heuristic labellers that vote against a text (1), for it (0) or not at
all (-1); the human labels in ``labels``, which cover some documents, are one more
labeller of each.

1. Votes of all documents are counted per pattern of votes (at most 3 to the
   number of labellers). Expectation-maximisation on those counts estimates how
   often each labeller votes what on good and on bad texts, and the posterior
   probability that a text with a given pattern is bad.
2. A linear scorer on hashed features (words of a text, their first bytes, and
   the steps that its statistics reach) is fitted by logistic regression to the posterior labels of a sample of
   about ``SAMPLE`` documents, which bounds the fit: half of it labelled documents, half
   others (all of them where there are fewer), at any number of either. Rows without a
   human label count where a heuristic votes (for toxicity: votes against them), with
   a weight between 1 and ``VOTED_WEIGHT``, the less the more labels there are. The sample is chosen on narrow rows (a hash of doc_id and text, and votes), and
   only its texts are fetched again. Features met in fewer than ``MIN_DOCS`` of them, or no oftener in bad
   texts than in good ones, get no weight.
3. Every document is scored on its whole text. It is kept if neither its
   probability of junk nor that of toxicity exceeds ``THRESHOLDS``. Short texts
   are judged like others; their statistics are drawn towards those of plain
   prose and their words weigh less, by ``PRIOR_BYTES``, ``PRIOR_WORDS`` and
   ``HALF_WORDS``.

Null and empty texts have nothing to judge: both probabilities are 0, and they
are kept. Several labels of one document count as one bad label if any is.
Repeated rows get equal results and count once in the sample; null doc_ids are scored. Without labels the
heuristics stand alone. An empty table gives an empty result. Extra columns are
not read, or passed on by :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import words as W
from netweave.llm.scratch import release, written

BITS = 18
SAMPLE = 8_000
MIN_DOCS = 4
#: Weight in the fit of a document without a human label: 1 where there are no labels,
#: near the least one where there are many, midway at ``VOTED_HALF`` of them in the sample.
VOTED_WEIGHT, VOTED_HALF = 1 / 8, 200
#: Probabilities of junk and of toxicity beyond which a text is rejected.
THRESHOLDS = (0.5, 0.2)
#: Bytes and words of plain prose that every text's statistics are mixed with, so few words say little.
PRIOR_BYTES, PRIOR_WORDS = 18, 3
#: A text of so many words has half of the weight of words that a long one has.
HALF_WORDS = 20
#: Words or bytes from which a text is long enough to be called varied, or plain.
LONG_WORDS, LONG_BYTES = 20, 160
#: Bytes of a word's prefix.
PREFIX_BYTES = 5
#: Standard errors by which a feature must tell bad texts from good ones.
SIGMAS = 3.0
ROUNDS = 60
#: Probability that a human label is right.
HUMAN = 0.999
_SIZE = 1 << BITS
_PARTS = 1 << 40
_STEPS = 16

#: Statistics among the features, and the value at which their last step begins.
_STATISTICS = (("letters", 1), ("capitals", 1), ("stutter", 1), ("variety", 1), ("bare_symbols", 1), ("symbols", 1), ("word_length", 20))
WORD_SCALE = 10.0

# Insults that the toxicity labellers look for.
INSULTS = ["clown", "disgusting", "dumb", "filthy", "idiot", "imbecile", "loser", "moron", "pathetic", "scum",
           "stupid", "trash", "worthless"]

JUNK_LABELLERS = ("letters", "capitals", "stutter", "variety", "bare_symbols", "symbols", "word_length",
                   "nothing_odd", "label_quality")
TOXIC_LABELLERS = ("any_insult", "two_insults", "label_toxic")


def _sum_by(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(values)])[bounds])


_IS_LETTER = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
_IS_UPPER = np.array([65 <= b <= 90 for b in range(256)])
_IS_SYMBOL = np.array([33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"()-/" for b in range(256)])
#: First bytes of kana, Chinese and Korean characters.
_UNSPACED = np.array([0xE3 <= b <= 0xED for b in range(256)])
_IS_BLANK = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])


@dataclass
class Seen:
    """Statistics and word hashes of a group of texts."""

    first: int
    words: np.ndarray
    bounds: np.ndarray
    prefixes: np.ndarray
    prefix_owner: np.ndarray
    stats: dict[str, np.ndarray]
    insults: np.ndarray

    @property
    def count(self) -> int:
        return len(self.bounds) - 1


def _insult_hashes() -> np.ndarray:
    (group,) = W.words_of(pa.array(INSULTS), W.ALNUM)
    return np.sort(group.hashes[0])


def _look(column) -> Iterator[Seen]:
    """Every group of texts once, one at a time in memory: words between blanks for the statistics, words
    of letters and digits for the features."""
    buf, offsets = W.text_buffer(column)
    insults = _insult_hashes()
    for plain, bare in zip(W.words_of(column, W.PLAIN), W.words_of(column, W.ALNUM)):
        n = len(plain.counts)
        lo, hi = offsets[plain.first], offsets[plain.first + n]
        part, marks = buf[lo:hi], offsets[plain.first:plain.first + n + 1] - lo
        visible = _sum_by(~_IS_BLANK[part], marks)
        letters = _sum_by(_IS_LETTER[part], marks)
        words, bounds = plain.hashes[0], plain.bounds
        total = plain.counts
        # Scripts without blanks: about two characters (six bytes) a word.
        spaced = total + _sum_by(_UNSPACED[part], marks) / 2
        same = np.zeros(len(words), bool)
        same[1:] = words[1:] == words[:-1]
        same[bounds[:-1][plain.counts > 0]] = False
        doc = np.repeat(np.arange(n), plain.counts)
        order = np.lexsort((words, doc))
        new = np.ones(len(words), bool)
        new[1:] = (words[order][1:] != words[order][:-1]) | (doc[1:] != doc[:-1])
        distinct = np.bincount(doc[new], minlength=n)
        inner = np.concatenate([[0], np.cumsum(W.ALNUM.is_word[part])])
        hollow = inner[plain.ends] == inner[plain.starts]
        # Shares are drawn towards those of plain prose, as by PRIOR_BYTES bytes and PRIOR_WORDS words of it.
        stats = {
            "letters": (letters + 0.97 * PRIOR_BYTES) / (visible + PRIOR_BYTES),
            "capitals": _sum_by(_IS_UPPER[part], marks) / (letters + PRIOR_BYTES),
            "stutter": _sum_by(same, bounds) / (total + PRIOR_WORDS),
            "variety": np.log(np.maximum(1, distinct) + PRIOR_WORDS) / np.log(np.maximum(1, total) + PRIOR_WORDS),
            "bare_symbols": _sum_by(hollow, bounds) / (total + PRIOR_WORDS),
            "symbols": _sum_by(_IS_SYMBOL[part], marks) / (visible + PRIOR_BYTES),
            "word_length": (visible + PRIOR_BYTES) / (spaced + PRIOR_WORDS),
            "words": plain.counts,
            "bytes": visible,
        }
        # The first bytes of longer words stand for their inflections.
        longer = np.flatnonzero(bare.ends - bare.starts > PREFIX_BYTES)
        folded = W.ALNUM.fold[part]
        prefix = np.zeros(len(longer), np.uint64)
        for i in range(PREFIX_BYTES):
            prefix = (prefix << np.uint64(8)) | folded[bare.starts[longer] + i]
        # Distinct insults of each text.
        bad = bare.hashes[0]
        at = np.minimum(np.searchsorted(insults, bad), len(insults) - 1)
        hit = np.flatnonzero(insults[at] == bad)
        owner = np.repeat(np.arange(n), bare.counts)
        pairs = np.unique(owner[hit] * len(insults) + at[hit])
        yield Seen(plain.first, bad, bare.bounds, W._finish(prefix), owner[longer], stats, np.bincount(pairs // len(insults), minlength=n))


def _votes(seen: Seen) -> np.ndarray:
    """Votes of the heuristic labellers, texts x labellers (junk, then toxic).
    Each looks for one fault and says nothing where it finds none, since a text
    free of one fault may have another; one votes for texts with nothing odd."""
    s, some = seen.stats, seen.stats["words"] > 0
    long = (s["words"] >= LONG_WORDS) | (s["bytes"] >= LONG_BYTES)

    faults = [
        s["letters"] < 0.8, s["capitals"] > 0.4, s["stutter"] > 0.2, long & (s["variety"] < 0.7),
        s["bare_symbols"] > 0.15, s["symbols"] > 0.1, (s["word_length"] > 15) | (s["word_length"] < 2)]
    odd = np.any([s["letters"] < 0.9, s["capitals"] > 0.2, s["stutter"] > 0.05, s["variety"] < 0.85,
                  s["bare_symbols"] > 0.05, s["symbols"] > 0.03, s["word_length"] > 12, s["word_length"] < 3], axis=0)
    found = [np.where(some & fault, 1, -1) for fault in faults]
    return np.stack([*found, np.where(some & long & ~odd, 0, -1), np.where(seen.insults >= 1, 1, -1),
                     np.where(seen.insults >= 2, 1, -1)], 1).astype(np.int8)


def _features(seen: Seen) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashed features of each text, their values, and where each text's begin.
    A word or prefix counts by the square root of its share of the text, so the words of
    long texts have the same total of squares, those of ``HALF_WORDS`` words half of
    it; every step that a statistic reaches counts 1 and has a slot of its own."""
    n_words = np.diff(seen.bounds)
    owner = np.repeat(np.arange(seen.count), n_words)
    slots = len(_STATISTICS) * _STEPS
    hashed = slots + (np.concatenate([seen.words, seen.prefixes]) % np.uint64(_SIZE - slots)).astype(np.int64)
    words, times = np.unique(np.concatenate([owner, seen.prefix_owner]) * _SIZE + hashed, return_counts=True)
    some = np.flatnonzero(seen.stats["words"] > 0)
    parts, values = [words], [WORD_SCALE * np.sqrt(times / (n_words[words // _SIZE] + HALF_WORDS))]
    for i, (name, top) in enumerate(_STATISTICS):
        reached = np.minimum(_STEPS - 1, seen.stats[name][some] * _STEPS / top).astype(np.int64) + 1
        step = np.arange(reached.sum()) - np.repeat(np.cumsum(reached) - reached, reached)
        parts.append(np.repeat(some, reached) * _SIZE + i * _STEPS + step)
        values.append(np.ones(len(step)))
    every = np.concatenate(parts)
    order = np.argsort(every, kind="stable")
    every = every[order]
    return every % _SIZE, np.concatenate(values)[order], np.searchsorted(every // _SIZE, np.arange(seen.count + 1))


def votes(docs: DataFrame) -> DataFrame:
    """doc_id, key (hash of doc_id and text) and votes (array of bytes, heuristic
    labellers) of all documents."""

    def task(batches):
        for batch in batches:
            for seen in _look(batch.column(1)):
                v = _votes(seen)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(seen.first, seen.count), batch.column(2).slice(seen.first, seen.count),
                     pa.ListArray.from_arrays(np.arange(0, v.size + 1, v.shape[1], dtype=np.int32), v.ravel())],
                    ["doc_id", "key", "votes"])

    return _keyed(docs).mapInArrow(task, "doc_id long, key long, votes array<tinyint>")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a hash of both."""
    typed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return typed.withColumn("key", F.xxhash64("doc_id", "text"))


def estimate(patterns: list[tuple[tuple[int, ...], int]], gold: int, rounds: int = ROUNDS) -> dict[tuple[int, ...], float]:
    """Posterior probability of *bad* for each pattern of votes, by
    expectation-maximisation. ``gold``: the human labeller, whose votes are right
    with probability ``HUMAN`` throughout; heuristics start as mostly right."""
    if not patterns:
        return {}
    seen = np.array([p for p, _ in patterns])
    weight = np.array([n for _, n in patterns], float)
    share = 0.15
    rate = np.zeros((2, seen.shape[1], 3))  # true class, labeller, vote (-1, 0, 1 as 0, 1, 2)
    for j in range(seen.shape[1]):
        right = HUMAN if j == gold else 0.8
        rate[0, j] = (0.5, 0.5 * right, 0.5 * (1 - right))
        rate[1, j] = (0.5, 0.5 * (1 - right), 0.5 * right)
    for _ in range(rounds):
        log = [np.log(s) + np.log(rate[c, np.arange(seen.shape[1]), seen + 1]).sum(1) for c, s in enumerate((1 - share, share))]
        bad = 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))
        share = float(np.clip((weight * bad).sum() / weight.sum(), 1e-4, 1 - 1e-4))
        for c, p in enumerate((1 - bad, bad)):
            for v in range(3):
                rate[c, :, v] = ((weight * p)[:, None] * (seen + 1 == v)).sum(0)
            rate[c] = (rate[c] + 1) / (rate[c].sum(1, keepdims=True) + 3)
            if 0 <= gold < seen.shape[1]:
                voted = 1 - rate[c, gold, 0]
                rate[c, gold, 1], rate[c, gold, 2] = (voted * HUMAN, voted * (1 - HUMAN))[::1 if c == 0 else -1]
    return {tuple(int(x) for x in p): float(b) for p, b in zip(seen, bad)}


@dataclass
class Scorer:
    """Weights of the hashed features for junk and toxicity."""

    weights: np.ndarray
    intercept: np.ndarray

    def __call__(self, features: np.ndarray, values: np.ndarray, starts: np.ndarray) -> np.ndarray:
        sums = np.zeros((len(starts) - 1, 2))
        for c in range(2):
            sums[:, c] = np.diff(np.concatenate([[0.0], np.cumsum(self.weights[c][features] * values)])[starts])
        return 1 / (1 + np.exp(-np.clip(sums + self.intercept, -50, 50)))


def _log_ratio(at: np.ndarray, row: np.ndarray, width: int, target: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Log of how much likelier each feature is in bad texts than in good ones
    (smoothed), 0 where the difference is within ``SIGMAS`` standard errors."""
    bad = np.bincount(at, (weight * target)[row], width) + 0.5
    good = np.bincount(at, (weight * (1 - target))[row], width) + 0.5
    all_bad, all_good = (weight * target).sum() + 1, (weight * (1 - target)).sum() + 1
    ratio = np.log(bad / all_bad) - np.log(good / all_good)
    error = np.sqrt(1 / bad + 1 / good)
    return np.where(np.abs(ratio) > SIGMAS * error, ratio, 0.0)


def fit(features: np.ndarray, values: np.ndarray, starts: np.ndarray, target: np.ndarray, known: np.ndarray,
        weight: np.ndarray, rounds: int = 200, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression with adaptive steps on the features that tell bad
    from good texts, each scaled by its log ratio; ``known`` tells which rows
    count for which of the two targets, ``weight`` how much."""
    n = len(starts) - 1
    weights, intercept = np.zeros((2, _SIZE)), np.zeros(2)
    often = np.bincount(features, minlength=_SIZE) >= MIN_DOCS
    keep, used = often[features], np.flatnonzero(often)
    every_row = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))[keep]
    every, values = (np.cumsum(often, dtype=np.int32) - 1)[features[keep]], values[keep]
    del features, keep
    for c in range(2):
        rows, t = np.where(known[:, c], weight, 0.0), target[:, c]
        if not rows.any():
            intercept[c] = -4.0
            continue
        ratio = _log_ratio(every, every_row, len(used), t, rows)
        telling = (ratio != 0)[every]
        at, row = every[telling].astype(np.int64), every_row[telling].astype(np.int64)
        x = values[telling] * ratio[at]
        del telling
        w, b = np.zeros(len(used)), 0.0
        seen_w, seen_b = np.full(len(used), 1e-8), 1e-8
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(np.bincount(row, w[at] * x, n) + b, -50, 50)))
            error = rows * (p - t) / rows.sum()
            grad, grad_b = np.bincount(at, error[row] * x, len(used)) + decay * w, error.sum()
            seen_w += grad ** 2
            seen_b += grad_b ** 2
            w -= rate * grad / np.sqrt(seen_w)
            b -= rate * grad_b / np.sqrt(seen_b)
        weights[c][used], intercept[c] = w * ratio, b
    return Scorer(weights, intercept)


def _picks(judged: DataFrame, labelled: int, others: int, sample: int) -> DataFrame:
    """key, q and t (human votes) of about ``sample`` rows at most of ``judged(key, junk,
    toxic)``: half of them labelled, half others, of which there are ``labelled`` and
    ``others``; all of them where there are fewer."""
    def below(number: int):
        return F.pmod("key", F.lit(_PARTS)) < int(min(1.0, sample / 2 / max(1, number)) * _PARTS)

    q, t = F.element_at("junk", -1), F.element_at("toxic", -1)
    return judged.where(F.when(F.greatest(q, t) >= 0, below(labelled)).otherwise(below(others))).select(
        "key", q.cast("int").alias("q"), t.cast("int").alias("t"))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Label model over all documents, then the scorer on a sample."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    human = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic").where("doc_id IS NOT NULL")
             .groupBy("doc_id").agg(F.coalesce(1 - F.min("quality"), F.lit(-1)).cast("int").alias("label_quality"),
                                    F.coalesce(F.max("toxic"), F.lit(-1)).cast("int").alias("label_toxic")))
    n = len(JUNK_LABELLERS) - 1
    judged = written(votes(docs).join(human, "doc_id", "left").select(
        "key", F.concat(F.slice("votes", 1, n), F.array(F.coalesce("label_quality", F.lit(-1)).cast("tinyint"))).alias("junk"),
        F.concat(F.slice("votes", n + 1, len(TOXIC_LABELLERS) - 1),
                 F.array(F.coalesce("label_toxic", F.lit(-1)).cast("tinyint"))).alias("toxic")), "quality_votes")
    counts = [(tuple(r["junk"]), tuple(r["toxic"]), r["n"])
              for r in judged.groupBy("junk", "toxic").agg(F.count("*").alias("n")).collect()]  # patterns only

    def posterior(side: int, gold: int) -> dict:
        sums: dict[tuple[int, ...], int] = {}
        for c in counts:
            sums[c[side]] = sums.get(c[side], 0) + c[2]
        return estimate(sorted(sums.items()), gold)

    models = (posterior(0, n), posterior(1, len(TOXIC_LABELLERS) - 1))

    labelled = sum(c[2] for c in counts if max(c[0][-1], c[1][-1]) >= 0)
    others = sum(c[2] for c in counts) - labelled
    voted_weight = VOTED_WEIGHT + (1 - VOTED_WEIGHT) * VOTED_HALF / (VOTED_HALF + min(labelled, sample / 2))
    # about ``sample`` rows, so they are broadcast; equal rows share a key and become one
    picks = F.broadcast(_picks(judged, labelled, others, sample).dropDuplicates(["key"]))
    picked = _keyed(docs).join(picks, "key").dropDuplicates(["key"]).select("text", "q", "t")

    def task(batches):
        for batch in batches:
            q, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for seen in _look(batch.column(0)):
                v, (features, values, starts) = _votes(seen), _features(seen)
                span = slice(seen.first, seen.first + seen.count)
                junk = np.column_stack([v[:, :n], q[span]]).tolist()
                toxic = np.column_stack([v[:, n:], t[span]]).tolist()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([models[0].get(tuple(p), 0.5) for p in junk]), pa.array([models[1].get(tuple(p), 0.5) for p in toxic]),
                     pa.array([max(p) >= 0 for p in junk]), pa.array([p[-1] >= 0 or max(p) > 0 for p in toxic]),
                     pa.array(np.where((q[span] >= 0) | (t[span] >= 0), 1.0, voted_weight)),
                     pa.ListArray.from_arrays(starts.astype(np.int32), features.astype(np.int32)),
                     pa.ListArray.from_arrays(starts.astype(np.int32), values.astype(np.float32))],
                    ["junk", "toxic", "junk_known", "toxic_known", "weight", "features", "values"])

    got = picked.mapInArrow(task, "junk double, toxic double, junk_known boolean, toxic_known boolean, weight double, "
                            "features array<int>, values array<float>").where("junk_known OR toxic_known").toArrow()
    def flat(name, kind):
        return np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy(zero_copy_only=False) for c in got[name].chunks]])

    features, values = flat("features", np.int32), flat("values", np.float32)
    sizes = pc.list_value_length(got["features"]).to_numpy().astype(np.int64)
    target = np.column_stack([got["junk"].to_numpy(), got["toxic"].to_numpy()])
    known = np.column_stack([got["junk_known"].to_numpy(), got["toxic_known"].to_numpy()]).astype(bool)
    weight = got["weight"].to_numpy()
    del got
    release(spark)
    return fit(features, values, np.concatenate([[0], np.cumsum(sizes)]), target.reshape(-1, 2), known.reshape(-1, 2), weight)


#: Rows in a batch that leaves the filter.
ROWS_OUT = 500


def _scored(docs: DataFrame, scorer: Scorer, names: list[str], thresholds: tuple[float, float], only_kept: bool) -> DataFrame:
    """``names`` and, unless only kept rows are wanted, the three results."""
    shared = docs.sparkSession.sparkContext.broadcast(scorer)
    results = [] if only_kept else ["junk", "toxic", "kept"]

    def task(batches):
        s = shared.value
        for batch in batches:
            p = np.zeros((batch.num_rows, 2))
            for seen in _look(batch.column(at)):
                own = s(*_features(seen))
                own[seen.stats["words"] == 0] = 0.0
                p[seen.first:seen.first + seen.count] = own
            kept = (p <= thresholds).all(axis=1)
            rows = pa.RecordBatch.from_arrays(batch.columns[:len(names)], names)
            if only_kept:
                for lo in range(0, batch.num_rows, ROWS_OUT):  # copies of a few rows at a time
                    yield rows.slice(lo, ROWS_OUT).filter(pa.array(kept[lo:lo + ROWS_OUT]))
            else:
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(p[:, 0]), pa.array(p[:, 1]), pa.array(kept)], [*names, *results])

    # The text goes to Python once where it is among the columns as it is.
    if "text" in names and docs.schema["text"].dataType.simpleString() == "string":
        at, picked = names.index("text"), docs.select(*names)
    else:
        at, picked = len(names), docs.select(*names, F.col("text").cast("string").alias("whole text"))
    schema = docs.select(*names).schema
    for name in results:
        schema = schema.add(name, "boolean" if name == "kept" else "double")
    return picked.mapInArrow(task, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, thresholds: tuple[float, float] = THRESHOLDS) -> DataFrame:
    """One row a document: doc_id, junk and toxic (probabilities), kept, and
    score (probability that it is neither)."""
    scored = _scored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), train(docs, labels, sample),
                     ["doc_id"], thresholds, only_kept=False)
    return scored.withColumn("score", 1 - F.greatest("junk", "toxic"))


def filter_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, thresholds: tuple[float, float] = THRESHOLDS) -> DataFrame:
    """``docs`` without the rejected ones, all columns as they are."""
    return _scored(docs, train(docs, labels, sample), docs.columns, thresholds, only_kept=True)
