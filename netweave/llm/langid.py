"""Language identification by cross-parsing entropy.

Per language a suffix automaton is built of labelled training text. A text is
cross-parsed against it: from where the last phrase ended, the longest match with
any place of the training text is the next phrase (one symbol more is consumed
when nothing matches). Text in the training text's language parses into few long
phrases. The language that needs the fewest phrases, normalised by the training
text's length (a phrase costs its logarithm), wins; ties go to the language with
more labelled documents, then to the smaller name.

Training reads every labelled document outside the held-out fold to find the
languages, and takes at most ``TRAIN_DOCS`` different texts per language (least
hash of doc_id; texts under ``SHORT`` characters only where longer ones are too few)
and of all of them together about ``TRAIN_BYTES`` bytes, in spans at hashed places
spread over the whole of each text: the bound on the model. More than
``MOST_LANGUAGES`` labels are an error that says so, as the model is held whole by
every task.

Parsing runs for many texts at once. Since a phrase always starts at the
automaton's root, failing transitions can be replaced by those of the root, which
leaves one table lookup a byte. Texts are parsed in blocks of ``BLOCK`` bytes, so
a long text is many lanes and no step is wasted on it; all bytes of a text count.

A null text, or one without a letter, is ``und`` with score 0. Repeated rows get
equal results; null doc_ids are predicted, never learned from, and held out. With
nothing to learn from every text is ``und``. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.llm import words as W

FOLDS = 5
TRAIN_DOCS = 64
TRAIN_BYTES = 24_000
SHORT = 16
MOST_LANGUAGES = 500
BLOCK = 2048
#: Bytes parsed at once.
LANE_BYTES = 1 << 20
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_GAP = 0


def _symbols(training: list[bytes]) -> np.ndarray:
    """Byte to symbol: letters of the training texts apart, A-Z as a-z, all
    other ASCII as one gap, unseen bytes as one symbol that never matches."""
    table = np.ones(256, np.uint8)
    seen = sorted(set(b"".join(training)))
    letters = [b for b in seen if b >= 128 or chr(b).isalpha()]
    lower = sorted({b + 32 if 65 <= b <= 90 else b for b in letters})
    for i, b in enumerate(lower):
        table[b] = i + 2
        if 97 <= b <= 122:
            table[b - 32] = i + 2
    for b in range(128):
        if not chr(b).isalpha():
            table[b] = _GAP
    return table


def _squeeze(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which symbols stay when runs of gaps become one; ``starts``: of texts."""
    keep = np.ones(len(symbols), bool)
    keep[1:] = (symbols[1:] != _GAP) | (symbols[:-1] != _GAP)
    keep[starts[starts < len(symbols)]] = True
    return keep


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of one sequence; state 0 is the root."""
    moves, link, length, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at, last = last, new
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at == -1:
            continue
        other = moves[at][symbol]
        if length[other] == length[at] + 1:
            link[new] = other
            continue
        copy = len(moves)
        moves.append(dict(moves[other]))
        length.append(length[at] + 1)
        link.append(link[other])
        link[other] = link[new] = copy
        while at != -1 and moves[at].get(symbol) == other:
            moves[at][symbol] = copy
            at = link[at]
    return moves


def _parser(moves: list[dict[int, int]], width: int) -> np.ndarray:
    """Table [state * width + symbol] -> next state * 4 + phrases that end with
    this step: the one before the symbol, if it cannot grow, and the symbol
    itself, if no training text has it. Missing moves are those of the root."""
    root = np.ones(width, np.int32)
    for symbol, to in moves[0].items():
        root[symbol] = to * 4
    table = np.tile(root + 1, (len(moves), 1))
    table[0] = root
    for state, out in enumerate(moves):
        for symbol, to in out.items():
            table[state, symbol] = to * 4
    return table.ravel()


class Model:
    """Parsers of all languages over one alphabet."""

    def __init__(self, training: dict[str, list[str]], documents: dict[str, int]):
        self.languages = sorted(training, key=lambda x: (-documents[x], x))
        raw = {x: " ".join(training[x]).encode() for x in self.languages}
        self.symbols = _symbols(list(raw.values()))
        self.width = int(self.symbols.max()) + 1
        self.tables, self.base, costs = [], [], []
        for x in self.languages:
            s = self.symbols[np.frombuffer(raw[x], np.uint8)]
            s = s[_squeeze(s, np.zeros(1, np.int64))]
            table = _parser(suffix_automaton(s.tolist()), self.width)
            costs.append(np.log2(max(2, len(s))))
            self.tables.append(table)
        self.costs = np.array(costs)

    def phrases(self, symbols: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Phrases of each block per language: blocks x languages."""
        out = np.ones((len(starts), len(self.tables)), np.int64)
        order = np.argsort(-sizes, kind="stable")
        first, size = starts[order], sizes[order]
        active = np.searchsorted(-size, -np.arange(1, (size[0] if len(size) else 0) + 1), side="right")
        for lang, table in enumerate(self.tables):
            state = np.zeros(len(order), np.int32)
            ended = np.zeros(len(order), np.int32)
            width = np.int32(self.width)
            for step, n in enumerate(active.tolist()):
                move = table[state[:n] * width + symbols[first[:n] + step]]
                ended[:n] += move & 3
                state[:n] = move >> 2
            out[order, lang] = ended + (state != 0)
        return out


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def training_rows(docs: DataFrame, folds: int = FOLDS, per_language: int = TRAIN_DOCS) -> tuple[dict, dict]:
    """Bounded training texts per language, and labelled documents per language."""
    doc_id, text = F.col("doc_id").cast("long"), F.col("text").cast("string")
    fold = F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds))
    keys = [doc_id.alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.xxhash64(text).alias("text_hash")]
    known = docs.select(*keys, F.length(text).alias("size")).where(
        "lang IS NOT NULL AND doc_id IS NOT NULL AND size > 0").where(fold != 0)
    counts = known.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"documents have more than {MOST_LANGUAGES} languages in lang")
    documents = {r["lang"]: r["n"] for r in counts}
    # Copies of one text count once.
    least = F.min(F.struct(F.xxhash64("doc_id").alias("order"), "doc_id")).alias("least")
    different = known.groupBy("lang", "text_hash").agg(least, F.max("size").alias("size"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("size") < SHORT, "least", "text_hash"))
    chosen = different.withColumn("rank", rank).where(F.col("rank") <= per_language)
    chosen = chosen.select("lang", "text_hash", F.col("least.doc_id").alias("doc_id"),
                           F.count("*").over(Window.partitionBy("lang")).alias("chosen"))  # per_language rows a language
    spans = F.greatest(F.lit(1), F.floor(F.lit(per_language) / F.col("chosen"))).cast("int")
    # As many characters as make the span's share of bytes; a part of the text for each span.
    size = F.floor(TRAIN_BYTES / per_language * F.length("text") / F.octet_length("text")).cast("int")
    pieces = F.expr("""IF(length(text) <= spans * size, array(text), transform(sequence(0, spans - 1), i -> substring(
        text, CAST(i * part + pmod(xxhash64(doc_id, i), greatest(part - size, 0) + 1) AS INT) + 1, least(size, part))))""")
    picked = (docs.select(*keys, text.alias("text")).join(F.broadcast(chosen), ["doc_id", "lang", "text_hash"])
              .withColumn("spans", spans).withColumn("size", size)
              .withColumn("part", F.floor(F.length("text") / F.col("spans")).cast("int"))
              .select("lang", "doc_id", "text_hash", pieces.alias("pieces")).distinct()
              .orderBy("lang", F.xxhash64("doc_id"), "text_hash"))
    texts: dict[str, list[str]] = {x: [] for x in documents}
    for r in picked.collect():
        texts[r["lang"]].extend(x for x in r["pieces"] if x)
    return {x: t for x, t in texts.items() if t}, documents


def predict(docs: DataFrame, training: dict[str, list[str]], documents: dict[str, int], folds: int = FOLDS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (how much cheaper the winner is
    than the runner-up, 0 to 1) from texts alone."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(Model(training, documents) if training else None)

    def judge(m: Model, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Cost per text and language."""
        s = m.symbols[buf]
        keep = _squeeze(s, offsets[:-1])
        s = s[keep].astype(np.int32)
        at = np.concatenate([[0], np.cumsum(keep)])[offsets]
        blocks = -(-np.diff(at) // BLOCK)
        text = np.repeat(np.arange(len(blocks)), blocks)
        start = at[text] + BLOCK * (np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        size = np.minimum(BLOCK, at[text + 1] - start)
        got = m.phrases(s, start, size)
        total = np.zeros((len(blocks), len(m.tables)))
        np.add.at(total, text, got)
        return total * m.costs

    def task(batches):
        m = model.value
        for batch in batches:
            buf, offsets = W.text_buffer(batch.column(2))
            texts, n = batch.column(2), batch.num_rows
            label, score = np.full(n, -1), np.zeros(n)
            lo = 0
            while m is not None and lo < n:
                hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + LANE_BYTES, side="right")) - 1)
                cost = judge(m, buf[offsets[lo]:offsets[hi]], offsets[lo:hi + 1] - offsets[lo])
                label[lo:hi] = np.argmin(cost, axis=1)
                if cost.shape[1] > 1:
                    two = np.partition(cost, 1, axis=1)[:, :2]
                    score[lo:hi] = 1 - two[:, 0] / np.maximum(two[:, 1], 1e-9)
                else:
                    score[lo:hi] = 1.0
                lo = hi
            part = buf | np.uint8(32)
            ascii_letter = np.concatenate([[0], np.cumsum((part >= 97) & (part <= 122))])[offsets]
            for i in np.flatnonzero(np.diff(ascii_letter) == 0).tolist():
                if not (texts[i].is_valid and _has_letter(texts[i].as_py())):
                    label[i], score[i] = -1, 0.0
            names = ["und" if x < 0 else m.languages[x] for x in label.tolist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))],
                ["doc_id", "held_out", "lang_pred", "score"])

    doc_id = F.col("doc_id").cast("long")
    held = F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)) == 0, F.lit(True))
    return docs.select(doc_id.alias("doc_id"), held.alias("held_out"),
                       F.col("text").cast("string").alias("text")).mapInArrow(task, _OUT)
