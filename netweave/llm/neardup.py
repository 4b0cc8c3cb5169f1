"""MinHash near-dedup by a multi-index Hamming join.

A document's set holds its distinct word shingles (A-Z lower-cased); with fewer
words than a shingle, the whole sequence is its only member. Two documents are
linked if their sets' Jaccard similarity is ``similarity`` or more.

1. Equal sets are one class; its smallest doc_id stands for it from then on.
2. Each class gets ``SYMBOLS`` minhash symbols of 12 bits. At similarity 0.8 a
   symbol differs with probability 0.2, so the distance of two signatures is
   about 20 of 100 (standard deviation 4); ``DISTANCE`` 39 leaves out about one
   borderline pair in 100,000.
3. Signatures are cut into 20 chunks of five symbols. By pigeonhole, two within
   distance 39 share a chunk with at most one error, so they are equal in that
   chunk when the right symbol is masked: all 5 x 20 masked chunks are index keys
   and no pair within the distance is missed. A pair with several keys in common
   counts at the first of them only.
4. Holders of a key are compared with one of them, the key's hub; distances are
   checked on signatures, links confirmed on full shingle sets. Components follow
   by star steps. A document has a hundred keys and so meets many hubs; keys
   whose holders still lie in different components get all their pairs from
   different components compared, so nothing is lost, and a large group of near
   copies, by then one component, is never paired out.
5. Such a pair leaves its block only if the parities of both sets allow a link.
   A set's parities are the members per bucket of its hash space, modulo 2. Every
   bucket in which two sets' parities differ holds a member of one set only, so
   more such buckets than a link leaves room for rule the pair out. Nothing
   linked is lost, and of a family that is similar at less than ``similarity``
   next to no pair is left to confirm.

Null texts and texts without words have no set and no link. Rows are judged by
their own text, also where they share a doc_id: a row's component is that of its
set, named by the smallest doc_id reachable. Rows without doc_id take no part:
component null, kept. An empty table gives an empty result. Extra columns are not
read.
"""

from __future__ import annotations

from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netweave.llm import words as W
from netweave.llm.graph import components
from netweave.llm.scratch import written

CHUNKS, CHUNK = 20, 5
SYMBOLS = CHUNKS * CHUNK
#: Pigeonhole: under two errors in some chunk.
DISTANCE = 2 * CHUNKS - 1
FIELD = 12
#: Holders of a key compared at once, about.
BLOCK = 256
_LOW, _HIGH = (sum(x << FIELD * i for i in range(CHUNK)) for x in ((1 << FIELD - 1) - 1, 1 << FIELD - 1))
#: Parity buckets a set has: four a member, as a power of two between these.
PARITY_LEAST, PARITY_MOST = 256, 8192
_ROWS = ("doc_id long, text_hash long, n_shingles long, set_a long, set_b long, signature array<long>, "
         "parity array<long>")
_SET = ["set_a", "set_b", "n_shingles"]
_WHOLE = np.uint64(0x5851F42D4C957F2D)


def _shingles(group: W.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a group of texts, sorted within each text;
    shingles per text."""
    words, bounds = group.hashes[0], group.bounds
    n = len(group.counts)
    every = W.sequence_hashes(words, size)
    doc = np.repeat(np.arange(n), group.counts)
    inside = doc[:len(every)] == doc[size - 1:] if len(every) else np.zeros(0, bool)
    values, owner = every[inside], doc[:len(every)][inside]
    short = np.flatnonzero((group.counts > 0) & (group.counts < size))
    if len(short):
        span = W.SpanHash(words)
        values = np.concatenate([values, span(bounds[short], bounds[short + 1]) ^ _WHOLE])
        owner = np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=n)


def _symbols(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Signature of each text that has shingles: a long a chunk, 12 bits a
    minhash symbol."""
    rng = np.random.default_rng(20240607)
    mult = rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
    plus = rng.integers(0, 1 << 32, SYMBOLS, dtype=np.uint64).astype(np.uint32)
    first = (np.cumsum(counts) - counts)[counts > 0]
    out = np.zeros((len(first), CHUNKS), np.uint64)
    if len(first):
        x = (values >> np.uint64(32)).astype(np.uint32)
        y = np.empty_like(x)
        for i in range(SYMBOLS):
            np.multiply(x, mult[i], out=y)
            y += plus[i]
            symbol = np.minimum.reduceat(y, first) * np.uint32(0x9E3779B1) >> np.uint32(32 - FIELD)
            out[:, i // CHUNK] |= symbol.astype(np.uint64) << np.uint64(FIELD * (i % CHUNK))
    return out.view(np.int64)


def _parities(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parities of all texts as longs, one after the other; offsets of the texts."""
    bits = 1 << np.ceil(np.log2(np.clip(4 * counts, PARITY_LEAST, PARITY_MOST))).astype(np.int64)
    ends = np.cumsum(bits)
    at = np.repeat(ends - bits, counts) + (values & np.repeat(bits - 1, counts).astype(np.uint64)).astype(np.int64)
    odd = np.bincount(at, minlength=int(ends[-1]) if len(ends) else 0) & 1
    longs = np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)
    return longs, np.concatenate([[0], ends // 64]).astype(np.int32)


def _folded(flat: np.ndarray, sizes: np.ndarray) -> dict[int, np.ndarray]:
    """Parities by length in longs, a row a text: those of a text as they are and,
    by the exclusive or of both halves, at every shorter length."""
    starts, out, size = np.cumsum(sizes) - sizes, {}, PARITY_MOST // 64
    while size >= PARITY_LEAST // 64:
        rows = np.zeros((len(sizes), size), np.uint64)
        own = sizes == size
        rows[own] = flat[starts[own][:, None] + np.arange(size)]
        if 2 * size in out:
            longer = out[2 * size]
            rows ^= longer[:, :size] ^ longer[:, size:]
        out[size] = rows
        size //= 2
    return out


def signatures(docs: DataFrame, shingle: int) -> DataFrame:
    """doc_id, text_hash (``xxhash64`` of the text), n_shingles, 128-bit hash of
    the set, signature as 20 longs, parities as 4 to 128 longs."""

    def task(batches):
        for batch in batches:
            ids = batch.column(0)
            for group in W.words_of(batch.column(2), W.LOWER):
                values, counts = _shingles(group, shingle)
                ends = np.cumsum(counts)
                parity, to = _parities(values, counts)
                sets = [xxhash.xxh3_128_intdigest(values[e - c:e].tobytes()) for c, e in zip(counts.tolist(), ends.tolist())]
                packed = np.zeros((len(counts), CHUNKS), np.int64)
                packed[counts > 0] = _symbols(values, counts)
                wide = np.array([[s >> 64, s & (1 << 64) - 1] for s in sets], np.uint64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(group.first, len(counts)), batch.column(1).slice(group.first, len(counts)),
                     pa.array(counts, pa.int64()),
                     pa.array(W.signed(wide[:, 0].copy())), pa.array(W.signed(wide[:, 1].copy())),
                     pa.ListArray.from_arrays(np.arange(0, packed.size + 1, CHUNKS, dtype=np.int32), packed.ravel()),
                     pa.ListArray.from_arrays(to, parity)],
                    ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "signature", "parity"])

    return _texts(docs).mapInArrow(task, _ROWS)


def _texts(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _keys(classes: DataFrame) -> DataFrame:
    """All masked chunks of every signature: key, slot (chunk and masked
    symbol), node."""

    def task(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            chunks = batch.column(1).flatten().to_numpy(zero_copy_only=False).view(np.uint64).reshape(-1, CHUNKS)
            for slot in range(SYMBOLS):
                c, mask = divmod(slot, CHUNK)
                field = np.uint64(((1 << FIELD) - 1) << FIELD * mask)
                keys = W._finish((chunks[:, c] & ~field) ^ W._finish(np.full(len(ids), slot + 1, np.uint64)))
                yield pa.RecordBatch.from_arrays([pa.array(W.signed(keys)), pa.array(np.full(len(ids), slot, np.int8)),
                                                  pa.array(ids)], ["key", "slot", "node"])

    return classes.select("node", "signature").mapInArrow(task, "key long, slot tinyint, node long")


def _sets(docs: DataFrame, classes: DataFrame, shingle: int) -> DataFrame:
    """Full shingle sets (sorted longs) of the classes, from the row that stands
    for each: node, members."""

    def task(batches):
        for batch in batches:
            for group in W.words_of(batch.column(1), W.LOWER):
                values, counts = _shingles(group, shingle)
                offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(group.first, len(counts)),
                     pa.ListArray.from_arrays(offsets, W.signed(values))], ["node", "members"])

    stands = classes.select("node", F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"))
    # By merge at every size: a broadcast of ids would grow with the input. Repeated rows count once.
    rows = _texts(docs).join(stands.hint("merge"), ["doc_id", "text_hash"]).dropDuplicates(["doc_id", "text_hash"])
    return rows.select("node", "text").mapInArrow(task, "node long, members array<long>")


def _errors(a: str, b: str, chunk: int | str) -> str:
    """SQL: the high bit of every symbol of a chunk that differs."""
    d = f"({a}[{chunk}] ^ {b}[{chunk}])"
    return f"(((({d} & {_LOW}L) + {_LOW}L) | {d}) & {_HIGH}L)"


def _distance(a: str, b: str) -> str:
    """SQL: differing symbols of two signatures."""
    return "(" + " + ".join(f"bit_count({_errors(a, b, c)})" for c in range(CHUNKS)) + ")"


def _across(mixed: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) of one key in different components, within the signature
    distance, with sizes and parities that allow a link, at the first key they
    share.

    ``mixed``: key, holders (of the key), slot, node, root, n_shingles,
    signature, parity. Holders of a key form blocks of about ``BLOCK``; a block meets
    itself and, by a join, the key's other blocks, and is compared in one numpy
    pass. No key's holders come together, however many there are.
    """
    member = F.struct("node", "root", "n_shingles", "signature", "parity")
    blocks = mixed.groupBy("key", F.pmod(F.xxhash64("node"), F.floor(F.col("holders") / BLOCK) + 1).alias("block")).agg(
        F.first("slot").alias("slot"), F.max("holders").alias("holders"), F.collect_list(member).alias("one"))
    blocks = written(blocks, "blocks")
    other = blocks.where(f"holders >= {BLOCK}").select("key", F.col("block").alias("block_b"), F.col("one").alias("two"))
    met = blocks.where(f"holders >= {BLOCK}").join(other, "key").where("block < block_b").select("slot", "one", "two")
    met = blocks.select("slot", "one", F.lit(None).cast(blocks.schema["one"].dataType).alias("two")).unionByName(met)
    low, high = np.uint64(_LOW), np.uint64(_HIGH)

    def sides(column, i):
        if not column[i].is_valid:
            return None
        flat = column[i].values
        node, root, size = (flat.field(j).to_numpy(zero_copy_only=False) for j in range(3))
        signature, parity = (flat.field(j).flatten().to_numpy(zero_copy_only=False).view(np.uint64) for j in (3, 4))
        lengths = flat.field(4).value_lengths().to_numpy(zero_copy_only=False)
        return node, root, size, signature.reshape(-1, CHUNKS), lengths, _folded(parity, lengths)

    def possible(x, y, a, b):
        """Whether parities of pairs (a, b) leave room for a link."""
        out = np.zeros(len(a), bool)
        total = x[2][a] + y[2][b]
        room = total - 2 * -(-similarity * total // (100 + similarity))
        length = np.minimum(x[4][a], y[4][b])
        for n in np.unique(length).tolist():
            at = np.flatnonzero(length == n)
            odd = np.bitwise_count(x[5][n][a[at]] ^ y[5][n][b[at]]).sum(axis=1, dtype=np.int64)
            out[at] = odd <= room[at]
        return out

    def compare(slot, x, y, same):
        chunk, mask = divmod(slot, CHUNK)
        good = x[1][:, None] != y[1][None, :]
        if same:
            good &= np.arange(len(x[0]))[:, None] < np.arange(len(y[0]))[None, :]
        good &= 100 * np.minimum(x[2][:, None], y[2][None, :]) >= similarity * np.maximum(x[2][:, None], y[2][None, :])
        i, j = np.nonzero(good)
        for lo in range(0, len(i), 1 << 14):
            a, b = i[lo:lo + (1 << 14)], j[lo:lo + (1 << 14)]
            total = np.zeros(len(a), np.int64)
            first = np.ones(len(a), bool)
            for c in range(CHUNKS):
                d = x[3][a, c] ^ y[3][b, c]
                e = (((d & low) + low) | d) & high
                errors = np.bitwise_count(e)
                total += errors
                if c < chunk:
                    first &= errors > 1
                elif c == chunk:
                    first &= (e == np.uint64(1 << FIELD * mask + FIELD - 1)) | ((e == 0) & (mask == 0))
            keep = first & (total <= DISTANCE)
            a, b = a[keep], b[keep]
            keep = possible(x, y, a, b)
            p, q = x[0][a[keep]], y[0][b[keep]]
            yield np.minimum(p, q), np.maximum(p, q)

    def task(batches):
        for batch in batches:
            slots, one, two = (batch.column(k) for k in range(3))
            for i in range(batch.num_rows):
                x, y = sides(one, i), sides(two, i)
                for a, b in compare(slots[i].as_py(), x, x if y is None else y, y is None):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return met.mapInArrow(task, "a long, b long").distinct()


def _close(pairs: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs (a, b) within the signature distance whose sizes allow a link."""
    one = classes.select(F.col("node").alias("a"), F.col("signature").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    two = classes.select(F.col("node").alias("b"), F.col("signature").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    return (pairs.join(one, "a").join(two, "b")
            .where(F.expr(f"100 * least(n_a, n_b) >= {similarity} * greatest(n_a, n_b)"))
            .where(F.expr(f"{_distance('sig_a', 'sig_b')} <= {DISTANCE}")).select("a", "b"))


def _linked(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Pairs confirmed on full sets."""
    one = sets.select(F.col("node").alias("a"), F.col("members").alias("set_a"))
    two = sets.select(F.col("node").alias("b"), F.col("members").alias("set_b"))
    shared = F.size(F.array_intersect("set_a", "set_b"))
    return (pairs.join(one, "a").join(two, "b")
            .select("a", "b", shared.alias("shared"), (F.size("set_a") + F.size("set_b")).alias("total"))
            .where(f"100 * shared >= {similarity} * (total - shared)").select("a", "b"))


def _judged(docs: DataFrame, shingle: int, similarity: int) -> DataFrame:
    """Every row's doc_id, text_hash, n_shingles, component_id and root, a name
    of its component that no other has (null without a set or doc_id)."""
    if not 80 <= similarity <= 100:
        raise ValueError("similarity is 80 to 100 hundredths")
    rows = written(signatures(docs, shingle), "signatures")
    some = rows.where("doc_id IS NOT NULL AND n_shingles > 0")
    # Classes are numbered as they are written: rows that share a doc_id can be of several.
    classes = written(some.groupBy(*_SET).agg(
        F.min(F.struct("doc_id", "text_hash")).alias("first"), F.first("signature").alias("signature"),
        F.first("parity").alias("parity")).withColumn("node", F.monotonically_increasing_id()), "classes")
    index = _keys(classes)
    shared = index.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    held = written(index.join(shared, "key"), "index")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = written(pairs, "pairs")
        ids = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        wanted = classes.select("node", "first").join(ids, "node")
        return written(_linked(pairs, written(_sets(docs, wanted, shingle), "sets"), similarity), "links")

    # A hub for every key; then all pairs that lie in different components.
    first = F.min_by("node", F.xxhash64("node")).alias("hub")
    pairs = held.join(held.groupBy("key").agg(first), "key").where("node <> hub").select(
        F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b")).distinct()
    links = confirmed(_close(pairs, classes, similarity))
    now = held.join(components(links), "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = now.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("holders")).where(
        "x < y").select("key", "holders")
    pairs = _across(now.join(split, "key").join(classes.select("node", "n_shingles", "signature", "parity"), "node"), similarity)
    roots = components(links.unionByName(confirmed(pairs)))

    named = written(classes.select(*_SET, "node", F.col("first.doc_id").alias("rep")).join(roots, "node", "left").select(
        *_SET, "rep", F.coalesce("root", "node").alias("root")), "roots")
    least = named.groupBy("root").agg(F.min("rep").alias("least"))
    of_class = named.join(least, "root").select(*_SET, "root", "least")
    has_id = F.col("doc_id").isNotNull()
    return (rows.select("doc_id", "text_hash", *_SET).join(of_class, _SET, "left")
            .select("doc_id", "text_hash", "n_shingles", F.when(has_id, F.col("root")).alias("root"),
                    F.when(has_id, F.coalesce("least", "doc_id")).alias("component_id")))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id, kept.
    ``similarity`` in hundredths, 80 or more (the index is laid out for that)."""
    return _judged(docs, shingle, similarity).select(
        "doc_id", "n_shingles", "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, shingle: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each component, all columns as they are:
    the row of the smallest doc_id, of several such rows the one whose text has
    the least hash. Of texts without words, one of each doc_id and text stays.
    Rows without doc_id stay."""
    judged = _judged(docs.select("doc_id", "text"), shingle, similarity).where("doc_id IS NOT NULL")
    row = F.struct("doc_id", "text_hash")
    one = judged.where("root IS NOT NULL").groupBy("root").agg(F.min(row).alias("row")).select("row.*")
    kept = one.unionByName(judged.where("root IS NULL").select("doc_id", "text_hash").distinct())
    tag = uuid4().hex
    kept = kept.select(F.col("doc_id").alias(f"id {tag}"), F.col("text_hash").alias(f"hash {tag}"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.select(*names, F.col("doc_id").cast("long").alias(f"doc {tag}"),
                       F.xxhash64(F.col("text").cast("string")).alias(f"text {tag}"))
    rows = rows.join(kept, (F.col(f"doc {tag}") == F.col(f"id {tag}")) & (F.col(f"text {tag}") == F.col(f"hash {tag}")),
                     "left_semi")
    rows = rows.dropDuplicates([f"doc {tag}", f"text {tag}"]).select(*names)
    return rows.unionByName(docs.where("doc_id IS NULL"))
