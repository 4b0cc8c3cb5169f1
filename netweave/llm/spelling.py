"""Spelling variants by reduced-alphabet neighbourhoods.

Letters are hashed to ``SYMBOLS`` symbols, so a word becomes a reduced word, and two
words one edit apart have reduced words at most one edit apart. For every distinct
reduced word the *full* one-edit neighbourhood over the small alphabet is generated
(every deletion, replacement and insertion: about 17 L keys where the full alphabet
would need some 180 L), and joined with the reduced vocabulary. Words of joined
reduced words are then compared letter by letter, so no chance pair stays and no pair
is lost.

Keys are 64-bit polynomial hashes of reduced words, which numpy edits in place of
strings: a key costs eight bytes however long its word is, and neighbourhoods go out
in pieces of bounded size. Equal keys of different reduced words only cost a
comparison. Before the shuffle, keys that no reduced word can have are dropped by a
bitmap of fixed size (``BITMAP_BITS``), which is broadcast.

A word's form is its near word of largest count, if that is ``RATIO`` times its own at
least. Counts grow ``RATIO``-fold along a chain of forms, so chains are short, and
roots follow by doubling a bounded number of times.

Defined results: null and empty texts have no words; a null doc_id is empty text in
the hash; repeated rows count like others; among near words of equal count the first
in code-point order is the form; an empty table gives no word. Other columns are not
read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netweave.llm.scratch import written
from netweave.llm.words import signed

SYMBOLS = 8
LEAST_LETTERS = 7
LEAST_COUNT = 2
RATIO = 10
BITMAP_BITS = 1 << 26
#: Keys generated at once.
CHUNK_KEYS = 1 << 20
_BASE = 0xD1342543DE82EF95
_INVERSE = pow(_BASE, -1, 1 << 64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def runs(text: Column) -> Column:
    """Maximal runs of letters that are long enough to become a word."""
    return F.regexp_extract_all(text, F.lit(rf"[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}"), F.lit(0))


def word_counts(docs: DataFrame, every: int = 31) -> DataFrame:
    """(word, n) of ``docs(doc_id, text)``: runs with A-Z lower-cased; where ``every``
    divides the crc32 of ``<doc_id>:<run>``, without the letter at that crc32 modulo
    the run's length."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    run = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(runs(F.col("text").cast("string"))).alias("run")) \
        .select("id", F.translate("run", upper, upper.lower()).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
    hashed = run.select("run", h.alias("h"), F.pmod(h, F.length("run")).cast("int").alias("at"))
    word = F.when(F.col("h") % every == 0, F.expr("concat(substring(run, 1, at), substring(run, at + 2))")).otherwise(F.col("run"))
    return (hashed.select(word.alias("word")).where(F.length("word") >= LEAST_LETTERS)
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT))


def symbols_of(word: np.ndarray) -> np.ndarray:
    """Symbols 1 to ``SYMBOLS`` of code points."""
    return (word.astype(np.uint64) * np.uint64(0x9E3779B1) >> np.uint64(18)) % np.uint64(SYMBOLS) + np.uint64(1)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def _keyed(sums: np.ndarray, length: int) -> np.ndarray:
    """Key of reduced words of one length: the polynomial, told apart by length."""
    h = sums + np.uint64(length) * _LENGTH
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _matrix(words: list[str], length: int) -> np.ndarray:
    return symbols_of(np.frombuffer("".join(words).encode("utf-32-le"), "<u4").reshape(-1, length))


def own_keys(words: list[str], length: int) -> np.ndarray:
    """Key of the reduced word of each of ``words``, all of ``length`` letters."""
    with np.errstate(over="ignore"):
        return _keyed((_matrix(words, length) * _powers(length)).sum(axis=1, dtype=np.uint64), length)


def neighbour_keys(words: list[str], length: int):
    """Keys of the full one-edit neighbourhoods of the reduced words of ``words``, and of
    themselves: matrices with a row a word, a block of edit places at a time."""
    with np.errstate(over="ignore"):
        x, up, inverse = _matrix(words, length), _powers(length + 1), np.uint64(_INVERSE)
        terms = x * up[:length]
        upto = np.zeros((len(words), length + 1), np.uint64)
        np.cumsum(terms, axis=1, dtype=np.uint64, out=upto[:, 1:])
        whole = upto[:, -1:]
        symbols = np.arange(1, SYMBOLS + 1, dtype=np.uint64)
        step = max(1, CHUNK_KEYS // (2 * SYMBOLS * max(1, len(words))))
        for lo in range(0, length + 1, step):
            at = slice(lo, min(lo + step, length))
            deleted = upto[:, at] + (whole - upto[:, at] - terms[:, at]) * inverse
            replaced = (whole - terms[:, at])[:, :, None] + up[at][None, :, None] * symbols
            ins = slice(lo, min(lo + step, length + 1))
            inserted = (upto[:, ins] + (whole - upto[:, ins]) * np.uint64(_BASE))[:, :, None] + up[ins][None, :, None] * symbols
            yield np.concatenate([_keyed(deleted, length - 1), _keyed(replaced.reshape(len(words), -1), length),
                                  _keyed(inserted.reshape(len(words), -1), length + 1)], axis=1)


def _by_length(words: list[str], most: int):
    """(rows, length) of groups of at most about ``most`` letters."""
    lengths = np.array([len(w) for w in words], np.int64)
    for length in np.unique(lengths):
        rows, size = np.flatnonzero(lengths == length), max(1, most // int(length))
        for lo in range(0, len(rows), size):
            yield rows[lo:lo + size], int(length)


def _add_keys(batches):
    """(word, n) with the key of its reduced word."""
    for batch in batches:
        words, keys = batch.column(0).to_pylist(), np.zeros(batch.num_rows, np.uint64)
        for rows, length in _by_length(words, CHUNK_KEYS):
            keys[rows] = own_keys([words[i] for i in rows], length)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(signed(keys))], ["word", "n", "key"])


def _bitmap(words: DataFrame) -> np.ndarray:
    """Bit (key modulo ``BITMAP_BITS``) of every reduced word: 8 MB whatever the
    vocabulary."""
    slot = F.col("key").bitwiseAND(F.lit(BITMAP_BITS - 1).cast("long"))
    bits = (words.select(F.shiftright(slot, 6).alias("cell"), F.expr(f"shiftleft(1L, cast(key & 63 as int))").alias("bit"))
            .groupBy("cell").agg(F.bit_or("bit").alias("bits")).toArrow())
    out = np.zeros(BITMAP_BITS >> 6, np.int64)
    out[bits.column("cell").to_numpy()] = bits.column("bits").to_numpy()
    return out.view(np.uint64)


def reduced_pairs(words: DataFrame) -> DataFrame:
    """(key, other): keys of reduced words that are the same or one edit apart, from
    ``words(word, n, key)``; a key may also stand for an equal hash."""
    spark = words.sparkSession
    bitmap = spark.sparkContext.broadcast(_bitmap(words))

    def generate(batches):
        bits = bitmap.value
        for batch in batches:
            names, own = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for rows, length in _by_length(names, CHUNK_KEYS // (2 * SYMBOLS)):
                for keys in neighbour_keys([names[i] for i in rows], length):
                    keys.sort(axis=1)
                    new = np.ones(keys.shape, bool)
                    new[:, 1:] = keys[:, 1:] != keys[:, :-1]
                    slot = keys & np.uint64(BITMAP_BITS - 1)
                    new &= (bits[slot >> np.uint64(6)] >> (keys & np.uint64(63)) & np.uint64(1)).astype(bool)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.repeat(own[rows], new.sum(axis=1))), pa.array(signed(keys[new]))], ["key", "other"])

    # words with one reduced word are interchangeable here; one of each key and reduced form is enough
    reduced = words.groupBy("key", _reduced("word").alias("reduced")).agg(F.first("word").alias("word")).select("word", "key")
    near = reduced.mapInArrow(generate, "key long, other long").distinct()
    return near.join(words.select(F.col("key").alias("other")).distinct(), "other", "left_semi")


def _reduced(word: str) -> Column:
    """The reduced word, as text."""
    letters = [*range(ord("a"), ord("z") + 1), *range(0xC0, 0x100)]
    marks = "".join("abcdefgh"[int(s) - 1] for s in symbols_of(np.array(letters)))
    return F.translate(word, "".join(map(chr, letters)), marks)


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, near, near_n): ordered pairs of words exactly one edit apart."""
    pairs = reduced_pairs(words)
    left = words.join(pairs, "key").select("word", "n", "other")
    right = words.select(F.col("key").alias("other"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return left.join(right, "other").where(F.expr("word <> near AND levenshtein(word, near, 1) = 1")).select("word", "n", "near", "near_n")


def _roots(forms: DataFrame, most: int) -> DataFrame:
    """(word, root) of words with a form; ``most`` bounds the counts."""
    edges = max(1, math.floor(math.log(max(most, LEAST_COUNT) / LEAST_COUNT, RATIO) + 1e-9))
    roots = forms.select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(edges + 1))):
        step = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        roots = written(roots.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling_roots")
    return roots


def group_variants(docs: DataFrame, every: int = 31) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``."""
    words = written(word_counts(docs, every).mapInArrow(_add_keys, "word string, n long, key long"), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    found = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("b"), F.first("n").alias("n"))
    fits = -F.col("b.m") >= RATIO * F.col("n")
    found = written(found.select("word", "n_near", F.when(fits, F.col("b.w")).alias("form"), F.when(fits, -F.col("b.m")).alias("form_n")), "spelling_near")
    most = words.agg(F.max("n")).first()[0] or 0
    roots = _roots(found.where("form IS NOT NULL"), most)
    return (words.join(found, "word", "left").join(roots, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n"))
