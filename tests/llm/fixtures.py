"""Small inputs for the training-data operators, with every awkward case."""

from __future__ import annotations

import random

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars int, "
          "n_words string, kept string, node string, bucket int, score string, words string")


def sentence(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null, empty, blank, one-word, very long, repeated and equal texts; null
    ids; passages shared by documents; near copies."""
    base, passage = sentence(1, 300), sentence(2, 80)
    words = base.split()
    near = " ".join(w if i % 90 else "changed" for i, w in enumerate(words))
    long = sentence(3, 30_000)
    texts = [
        (1, base), (2, None), (3, ""), (4, " \t\n "), (5, "word"), (6, "Word"), (7, base), (8, near),
        (9, f"start {passage} end"), (10, f"{sentence(4, 60)}\n{passage} x"), (11, long),
        (12, f"{long} tail"), (13, "ha " * 400), (14, "ha " * 300), (None, base), (None, None),
        (15, "È l'ora — 你好 ☕ don't İstanbul"), (16, " ".join(words[:49])), (17, " ".join(words[:50])),
        (18, "Released under the MIT License, cc by and CC-BY. GNU General Public License"),
        (1, base), (19, "a b"), (20, "a b"), (20, "other words here"), (21, "x" * 5000),
    ]
    return [(i, t, "en", "s", None if t is None else len(t), "1", "k", "n", 0, "s", "w") for i, t in texts]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df) -> list[tuple]:
    return [tuple(r) for r in df.collect()]


def lower(text: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in text)
