"""Cross-tokenizer alignment with corpus-wide counts of token pairs.

Two vocabularies, A (byte-level) and B (pieces), cut the same bytes of a text. Tokens whose
byte ranges overlap are linked; places where tokens of both end cut a text into
groups. The count of a pair of ids is the number of documents in which they are linked.

1. Texts are encoded and aligned; their ids and each text's distinct pairs are written to
   a scratch table.
2. Distinct pairs of the corpus go to buckets by their A id. Each bucket gets a minimal perfect
   hash (``phf``) with its keys stored for verification, in a file of the shared folder.
3. Every task counts into dense vectors, one per bucket, indexed by the hash. The
   vectors are summed by a tree: ``FAN`` tasks' vectors at a time, until a bucket has one.
4. The second pass re-aligns documents from their ids and looks their pairs up; foreign keys, which
   would raise, cannot occur.

A worker holds at most ``HOLD`` buckets of about ``BUCKET_PAIRS`` pairs, so its memory is
bounded however many pairs there are; with more, buckets are read in turn for every
group of documents. Nothing is collected to the driver but one row a task or bucket
count. Files are written aside and moved into place, so a task that runs again
replaces them with equal ones.

Defined results: null and empty texts have no tokens, nor have texts whose tokens
do not spell a space and the text (a literal U+2581, which B writes for a space):
all their numbers are 0 and their groups ''. Repeated rows and ids are documents of
their own, and each counts. An empty table has no pair. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import io
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm import tokens
from netweave.llm.phf import PerfectHash, mix
from netweave.llm.scratch import bounded_batches, written
from netweave.llm.token_files import _filesystem, _put

BUCKET_PAIRS = 1 << 18
HOLD = 24
FAN = 16
#: Tokens of both vocabularies that are aligned at once, and characters that are encoded
#: at once; some 100 bytes a token are held.
GROUP_TOKENS = 1 << 19
GROUP_CHARS = 1 << 20
#: Cached units of the B vocabulary; longer ones are not cached.
CACHE_SIZE = 600_000
CACHED_CHARS = 48
_IDS = "doc_id long, ids_a binary, ids_b binary, pairs binary"
_SCORED = ("doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, "
           "count_sum long, groups_sha256 string")
_WORKER: dict[str, Pieces] = {}


class Pieces:
    """Texts to ids of the piece vocabulary, as bytes of unsigned 16-bit integers.

    None of its pieces has a space mark after another character (checked), so no merge
    crosses a place where a space follows one, and a text is encoded unit by unit."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        names = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if len(names) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        self.by_unit = not any("▁" in n.lstrip("▁") for n in names)
        self.bytes = [bytes([int(n[3:5], 16)]) if self.model.is_byte(i) else n.replace("▁", " ").encode()
                      for i, n in enumerate(names)]
        self.space = np.array([self.model.piece_to_id("▁")], "<u2").tobytes()
        self.units = re.compile(" +[^ ]*").findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.unlike: set[str] = set()

    def _raw(self, units: list[str]) -> list[bytes]:
        """Ids of units; each begins with the space that the model puts first."""
        got = self.model.encode([u[1:] for u in units], num_threads=1)
        for u, ids in zip(units, got):
            if len(u) > 1 and b"".join(map(self.bytes.__getitem__, ids)) != u.encode():
                self.unlike.add(u)
        return [np.array(ids, "<u2").tobytes() if len(u) > 1 else self.space for u, ids in zip(units, got)]

    def spells(self, raw: bytes, spaced: str, units: list[str]) -> bool:
        """Whether the ids spell the text. They do if every unit's ids spell the unit."""
        if not self.unlike or self.unlike.isdisjoint(units):
            return True
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(raw, "<u2").tolist())) == spaced.encode()

    def _look_up(self, units: set[str]) -> dict[str, bytes]:
        """Ids of units that are too long to be kept; all others are ``known`` after it.
        Units met of late stay known when older ones are forgotten."""
        if len(self.known) > CACHE_SIZE // 2:
            self.known, self.older = {}, self.known
            self.unlike.intersection_update(self.older)
        fresh = units.difference(self.known)
        again = fresh.intersection(self.older)
        self.known.update(zip(again, map(self.older.__getitem__, again)))
        new, long = list(fresh.difference(again)), {}
        for u, ids in zip(new, self._raw(new) if new else ()):
            (self.known if len(u) <= CACHED_CHARS else long)[u] = ids
        return long

    def encode(self, texts: list[str]) -> list[bytes | None]:
        """Ids of texts that have their leading space put before them; None where they
        do not spell the text."""
        cut = [self.units(t) if self.by_unit else [t] for t in texts]
        long = self._look_up(set().union(*cut))
        known, out = self.known, []
        for spaced, units in zip(texts, cut):
            raw = b"".join([known.get(u) or long[u] for u in units] if long else map(known.__getitem__, units))
            out.append(raw if self.spells(raw, spaced, units) else None)
        self.unlike.difference_update(long)
        return out


def pieces(path: str) -> Pieces:
    if path not in _WORKER:
        _WORKER[path] = Pieces(path)
    return _WORKER[path]


def _forget() -> None:
    """Passes after the encoding keep no vocabulary: their worker may have encoded before."""
    _WORKER.clear()
    tokens.forget()


def byte_tokens(path: str) -> list[bytes]:
    """Bytes of each id of the byte-level vocabulary."""
    model = tokens.encoder(path).model
    back = {chr(c): b for b, c in {**{b: b for b in tokens._PRINTED}, **tokens._BYTES}.items()}
    names = [model.id_to_token(i) for i in range(model.get_vocab_size())]
    return [bytes(back[c] for c in n) if all(c in back for c in n) else n.encode() for n in names]


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, ids_a, ids_b, pairs) of ``docs(doc_id, text)``: unsigned 16-bit ids, empty
    where a text has no tokens, and its distinct linked pairs, as unsigned 32-bit keys."""

    def task(batches):
        a, b = tokens.encoder(path_a), pieces(path_b)
        of_a, sizes = byte_tokens(path_a), _sizes(path_a, path_b)
        if len(of_a) > 1 << 16:
            raise ValueError("ids need more than 16 bits")
        lossless = {bytes([i]) for i in range(256)} <= set(of_a)  # any bytes are spelled then
        for batch in batches:
            for first, texts in tokens.groups(batch.column(1).to_pylist(), GROUP_CHARS):
                rows_a, rows_b = [], []
                spaced = [f" {t}" for t in texts]
                for text, raw, ids_b in zip(texts, a.encode(spaced), b.encode(spaced)):
                    ids_a, ids_b = np.frombuffer(raw, "<u4"), ids_b if text else None
                    if ids_b and not lossless and b"".join(map(of_a.__getitem__, ids_a.tolist())) != f" {text}".encode():
                        ids_b = None
                    rows_b.append(ids_b or b"")
                    rows_a.append(ids_a.astype("<u2").tobytes() if ids_b else b"")
                doc, keys = Aligned(rows_a, rows_b, *sizes).distinct()
                raw, cuts = keys.astype("<u4").tobytes(), 4 * np.searchsorted(doc, np.arange(len(texts) + 1))
                pairs = [raw[lo:hi] for lo, hi in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(rows_a, pa.binary()),
                                                  pa.array(rows_b, pa.binary()), pa.array(pairs, pa.binary())], ["doc_id", "ids_a", "ids_b", "pairs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, _IDS)


class Aligned:
    """Links and groups of some documents, from their ids and the tokens' lengths.

    Documents stand one after the other: both vocabularies spell the same bytes of
    each, so byte places run on over documents and ends of documents end groups."""

    def __init__(self, raw_a, raw_b, size_a: np.ndarray, size_b: np.ndarray):
        self.n_a = np.array([len(r) // 2 for r in raw_a], np.int64)
        self.n_b = np.array([len(r) // 2 for r in raw_b], np.int64)
        self.a = np.frombuffer(b"".join(raw_a), "<u2").astype(np.int64)
        self.b = np.frombuffer(b"".join(raw_b), "<u2").astype(np.int64)
        end_a, end_b = np.cumsum(size_a[self.a]), np.cumsum(size_b[self.b])
        here_a, here_b = (np.zeros((end_a[-1] if len(end_a) else 0) + 1, bool) for _ in range(2))
        here_a[end_a], here_b[end_b] = True, True
        # Every stretch of bytes between two ends, of whichever side, is one link.
        ends = np.flatnonzero(here_a | here_b)
        stops_a, stops_b = here_a[ends], here_b[ends]
        which = np.cumsum(stops_a) - stops_a
        self.last_a, self.last_b = here_b[end_a], here_a[end_b]
        self.doc_a = np.repeat(np.arange(len(self.n_a)), self.n_a)
        self.doc = self.doc_a[which]
        self.key = self.a[which] << 16 | self.b[np.cumsum(stops_b) - stops_b]

    def sum_by_doc(self, values: np.ndarray) -> np.ndarray:
        """Exact sums of long values of links, by document."""
        upto = np.concatenate([[0], np.cumsum(values)])
        ends = np.cumsum(np.bincount(self.doc, minlength=len(self.n_a)))
        return np.diff(upto[np.concatenate([[0], ends])])

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """Document and key of every (document, pair), in order."""
        both = np.sort(self.doc << 32 | self.key)
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        both = both[new]
        return both >> 32, both & 0xFFFFFFFF

    def groups(self):
        """The places of A's and B's tokens in the list of groups, each of which lists A's
        tokens, then B's."""
        of_a = np.cumsum(self.last_a) - self.last_a
        of_b = np.cumsum(self.last_b) - self.last_b
        before_b = np.concatenate([[0], np.flatnonzero(self.last_b) + 1])
        upto_a = np.flatnonzero(self.last_a) + 1
        return np.arange(len(self.a)) + before_b[of_a], np.arange(len(self.b)) + upto_a[of_b]


def _sizes(path_a: str, path_b: str) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([len(t) for t in byte_tokens(path_a)], np.int64), np.array([len(t) for t in pieces(path_b).bytes], np.int64))


def _aligned(batches, sizes: tuple[np.ndarray, np.ndarray]):
    """Groups of documents of (doc_id, ids_a, ids_b), with their ids."""
    for batch in batches:
        ids, raw_a, raw_b = (batch.column(i).to_pylist() for i in range(3))
        at = held = 0
        for i in range(len(ids)):
            held += len(raw_a[i]) + len(raw_b[i])
            if held >= 2 * GROUP_TOKENS or i + 1 == len(ids):
                yield ids[at:i + 1], Aligned(raw_a[at:i + 1], raw_b[at:i + 1], *sizes)
                at, held = i + 1, 0


def _buckets_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """All pairs of an A id are in one bucket, so its highest count is known there."""
    return (mix(keys >> 16, 7) % np.uint64(buckets)).astype(np.int64)


class Store:
    """Buckets of one kind of file, at most ``HOLD`` at a time."""

    def __init__(self, folder: str, kind: str, load):
        self.files, self.root = _filesystem(folder)
        self.kind, self.read, self.held = kind, load, {}

    def get(self, bucket: int):
        if bucket not in self.held:
            if len(self.held) >= HOLD:
                self.held.pop(next(iter(self.held)))
            with self.files.open_input_stream(f"{self.root}/{self.kind}-{bucket:05d}.bin") as f:
                self.held[bucket] = self.read(io.BytesIO(f.read()))
        return self.held[bucket]


def _by_bucket(keys: np.ndarray, buckets: int, backwards: bool):
    """(bucket, rows), in turn forwards and backwards, so that buckets still held
    come first."""
    of = _buckets_of(keys, buckets)
    order = np.argsort(of, kind="stable")
    cuts = np.searchsorted(of[order], np.arange(buckets + 1))
    for b in (range(buckets - 1, -1, -1) if backwards else range(buckets)):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b]:cuts[b + 1]]


def _pair_groups(batches):
    """Keys of the distinct pairs of groups of documents; a document's are not repeated."""
    for batch in batches:
        held, size = [], 0
        for raw in batch.column(0).to_pylist():
            held.append(raw)
            size += len(raw)
            if size >= 4 * GROUP_TOKENS:
                yield np.frombuffer(b"".join(held), "<u4").astype(np.int64)
                held, size = [], 0
        yield np.frombuffer(b"".join(held), "<u4").astype(np.int64)


def _distinct_pairs(ids: DataFrame) -> DataFrame:
    def task(batches):
        _forget()
        kept = np.zeros(0, np.int64)
        for keys in _pair_groups(batches):
            kept = np.union1d(kept, keys)
            if len(kept) > 4 * BUCKET_PAIRS:
                yield pa.RecordBatch.from_arrays([pa.array(kept)], ["pair"])
                kept = np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(kept)], ["pair"])

    return ids.select("pairs").mapInArrow(task, "pair long").distinct()


def _build_hashes(pairs: DataFrame, folder: str, buckets: int) -> None:
    """One file a bucket with the minimal perfect hash of its pairs."""
    def add(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_buckets_of(keys, buckets).astype(np.int32)), batch.column(0)], ["bucket", "pair"])

    def build(table: pa.Table) -> pa.Table:
        files, root = _filesystem(folder)
        bucket = table.column("bucket")[0].as_py()
        made = PerfectHash(np.sort(table.column("pair").to_numpy()))
        _put(files, root, f"hash-{bucket:05d}.bin", made.dump)
        return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(made.keys)], pa.int64())})

    written(pairs.mapInArrow(add, "bucket int, pair long").groupBy("bucket").applyInArrow(build, "bucket int, n long"), "align_hashes")


def _count(ids: DataFrame, folder: str, buckets: int) -> DataFrame:
    """(bucket, node, counts): each task's dense vectors of documents a pair."""
    def task(batches):
        _forget()
        node, store, sums = TaskContext.get().partitionId(), Store(folder, "hash", PerfectHash.load), {}

        def out(bucket):
            return pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([node], pa.int32()),
                                               pa.array([sums.pop(bucket).astype("<i8").tobytes()], pa.binary())], ["bucket", "node", "counts"])

        for turn, keys in enumerate(_pair_groups(batches)):
            for bucket, rows in _by_bucket(keys, buckets, turn % 2 == 1):
                table = store.get(bucket)
                if bucket not in sums:
                    if len(sums) >= HOLD:
                        yield out(next(iter(sums)))
                    sums[bucket] = np.zeros(len(table.keys), np.int64)
                slot = table.slots(keys[rows])
                if slot.min() < 0:
                    raise RuntimeError("a pair without a slot")
                sums[bucket] += np.bincount(slot, minlength=len(table.keys))
        for bucket in list(sums):
            yield out(bucket)

    return ids.select("pairs").mapInArrow(task, "bucket int, node int, counts binary")


def _tree_sum(vectors: DataFrame, nodes: int) -> DataFrame:
    """One vector a bucket: sums of ``FAN`` nodes' vectors, level by level. A task
    holds one sum and one vector at a time."""
    def add(batches):
        at, total = None, None
        for batch in batches:
            for bucket, node, raw in zip(*(batch.column(i).to_pylist() for i in range(3))):
                row = np.frombuffer(raw, "<i8")
                if at == (bucket, node):
                    total += row
                    continue
                if at is not None:
                    yield sent(at, total)
                at, total = (bucket, node), row.copy()
        if at is not None:
            yield sent(at, total)

    def sent(at, total):
        return pa.RecordBatch.from_arrays([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()),
                                           pa.array([total.tobytes()], pa.binary())], ["bucket", "node", "counts"])

    while True:
        nodes = -(-nodes // FAN)
        up = vectors.select("bucket", F.floor(F.col("node") / FAN).cast("int").alias("node"), "counts")
        vectors = up.repartition("bucket", "node").sortWithinPartitions("bucket", "node").mapInArrow(add, "bucket int, node int, counts binary")
        if nodes <= 1:
            return vectors


def _save_counts(sums: DataFrame, folder: str) -> None:
    """Counts of each bucket by slot, and which are their A id's highest."""
    def task(batches):
        files, root = _filesystem(folder)
        store = Store(folder, "hash", PerfectHash.load)
        for batch in batches:
            for bucket, raw in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                keys, counts = store.get(bucket).keys, np.frombuffer(raw, "<i8")
                high = np.zeros(1 << 16, np.int64)
                np.maximum.at(high, keys >> 16, counts)

                def write(out):
                    np.save(out, counts)
                    np.save(out, counts == high[keys >> 16])

                _put(files, root, f"counts-{bucket:05d}.bin", write)
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([len(counts)], pa.int64())], ["bucket", "n"])

    written(sums.mapInArrow(task, "bucket int, n long"), "align_counts")


def _load_counts(source):
    return np.load(source), np.load(source)


_DIGITS = 5
#: Decimal digits of all 16-bit ids, last digit first, and how many each has.
_DECIMAL = np.stack([np.arange(1 << 16) // 10 ** k % 10 + 48 for k in range(_DIGITS)]).astype(np.uint8)
_WIDTH = np.maximum(1, sum(np.arange(1 << 16) >= 10 ** k for k in range(_DIGITS)))


def _group_hashes(part: Aligned) -> tuple[np.ndarray, list[str]]:
    """Number of groups and the hash of their list, by document. The lists are written
    digit by digit for all tokens at once; each id is followed by a comma or by the sign
    that ends its side of the group."""
    place_a, place_b = part.groups()
    ids, sign = np.zeros(len(part.a) + len(part.b), np.int64), np.zeros(len(part.a) + len(part.b), np.uint8)
    ids[place_a], ids[place_b] = part.a, part.b
    sign[place_a] = np.where(part.last_a, ord("|"), ord(","))
    sign[place_b] = np.where(part.last_b, ord(";"), ord(","))
    width = _WIDTH[ids]
    ends = np.cumsum(width + 1)
    text = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
    text[ends - 1] = sign
    for k in range(_DIGITS):
        has = np.flatnonzero(width > k)
        text[ends[has] - 2 - k] = _DECIMAL[k][ids[has]]
    raw, hashes, at = memoryview(text), [], 0
    last = np.concatenate([[0], ends])[np.cumsum(part.n_a + part.n_b)]
    for end in last.tolist():
        hashes.append(hashlib.sha256(raw[at:end - 1]).hexdigest() if end > at else "")
        at = end
    return np.bincount(part.doc_a, weights=part.last_a, minlength=len(part.n_a)).astype(np.int64), hashes


def _score(ids: DataFrame, folder: str, buckets: int, path_a: str, path_b: str) -> DataFrame:
    """The second pass: documents aligned again, with their pairs' counts. The tokens'
    lengths come from the driver, so that no worker loads the vocabularies."""
    sizes = _sizes(path_a, path_b)
    _forget()

    def task(batches):
        _forget()
        hashes, counts = Store(folder, "hash", PerfectHash.load), Store(folder, "counts", _load_counts)
        for turn, (doc_ids, part) in enumerate(_aligned(batches, sizes)):
            count, best = np.zeros(len(part.key), np.int64), np.zeros(len(part.key), np.int64)
            for bucket, rows in _by_bucket(part.key, buckets, turn % 2 == 1):
                slot = hashes.get(bucket).slots(part.key[rows])
                if slot.min() < 0:
                    raise RuntimeError("a pair without a slot")
                counted, highest = counts.get(bucket)
                count[rows], best[rows] = counted[slot], highest[slot]
            n_groups, digests = _group_hashes(part)
            columns = [part.n_a, part.n_b, n_groups, part.sum_by_doc(np.ones(len(count), np.int64)), part.sum_by_doc(best), part.sum_by_doc(count)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), *map(pa.array, columns), pa.array(digests, pa.string())],
                                             ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])

    return ids.select("doc_id", "ids_a", "ids_b").mapInArrow(task, _SCORED)


def count_pairs(ids: DataFrame, folder: str) -> int:
    """Hash and count all pairs of written ``ids`` into files of ``folder``; returns
    the number of buckets."""
    pairs = written(_distinct_pairs(ids), "align_pairs")
    buckets = max(1, -(-pairs.count() // BUCKET_PAIRS))
    files, root = _filesystem(folder)
    files.create_dir(root, recursive=True)
    _build_hashes(pairs, folder, buckets)
    nodes = max(1, ids.rdd.getNumPartitions())
    _save_counts(_tree_sum(_count(ids, folder, buckets), nodes), folder)
    return buckets


def pair_counts(spark: SparkSession, folder: str, buckets: int) -> DataFrame:
    """(id_a, id_b, count) of all linked pairs, from the files."""
    def task(batches):
        hashes, counts = Store(folder, "hash", PerfectHash.load), Store(folder, "counts", _load_counts)
        for batch in batches:
            for bucket in batch.column(0).to_pylist():
                if hashes.files.get_file_info(f"{hashes.root}/hash-{bucket:05d}.bin").is_file:
                    keys = hashes.get(bucket).keys
                    yield pa.RecordBatch.from_arrays([pa.array((keys >> 16).astype(np.int32)), pa.array((keys & 0xFFFF).astype(np.int32)),
                                                      pa.array(counts.get(bucket)[0])], ["id_a", "id_b", "count"])

    return spark.range(buckets, numPartitions=min(buckets, 4096)).mapInArrow(task, "id_a int, id_b int, count long")


def align(docs: DataFrame, folder: str, path_a: str, path_b: str) -> DataFrame:
    """One row a document of ``docs(doc_id, text)``: tokens of both vocabularies,
    groups, links, links that are their A id's most frequent, and the sum of their counts."""
    bounded_batches(docs.sparkSession)
    ids = written(encode(docs, path_a, path_b), "align_ids")
    buckets = count_pairs(ids, folder)
    return _score(ids, folder, buckets, path_a, path_b)
