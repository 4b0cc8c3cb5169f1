"""Token-ID binary output: flat unsigned integers plus 64-bit document offsets.

Documents are range-partitioned and sorted by ``doc_id``, then text (so rows that share
a doc_id are no single task); every task encodes its
documents and writes three files to a folder that all machines see:

    tokens-NNNNN.bin    ids, little-endian unsigned, 16 bits where the
                        vocabulary fits, else 32
    offsets-NNNNN.bin   int64, documents + 1: where each document begins in
                        this file
    docs-NNNNN.bin      int64 doc_id of each document

and reports its number of documents and ids. Prefix sums over those reports
(one row a task) give each file's base, so global positions need no second pass
over the ids. Readers map the files into memory. Files are written under another
name and moved into place, so a task that runs again after a lost executor
replaces them with equal ones.

Null text is empty text: the document has its end id alone. Repeated doc_ids are
separate documents, ordered by text; null doc_ids come first and are stored as
the smallest int64. An empty table gives no file and no row. Other columns are
not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.llm import tokens

NO_ID = -(1 << 63)
_MANIFEST = "part int, n_docs long, n_tokens long, width int"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"
#: Ids converted at once while a long document is read back.
BLOCK_IDS = 1 << 20


def _filesystem(folder: str):
    from pyarrow import fs
    return fs.FileSystem.from_uri(folder)


def _put(files, folder: str, name: str, write) -> None:
    """Write a file aside, then move it into place."""
    aside = f"{folder}/.{name}.{TaskContext.get().taskAttemptId()}"
    with files.open_output_stream(aside) as out:
        write(out)
    files.move(aside, f"{folder}/{name}")


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, width: int = 16) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into ``folder``; returns one row a file:
    part, n_docs, n_tokens, width, base (ids before it)."""
    if width not in (16, 32):
        raise ValueError("width is 16 or 32 bits")

    def task(batches):
        files, base = _filesystem(folder)
        files.create_dir(base, recursive=True)
        part, kind = TaskContext.get().partitionId(), np.dtype(f"<u{width // 8}")
        ids, ends, name = [], [0], f"{part:05d}"
        end = np.array([end_id], "<u4").tobytes()
        enc = tokens.encoder(tokenizer)

        def body(out):
            for batch in batches:
                ids.extend(NO_ID if i is None else i for i in batch.column(0).to_pylist())
                for _, texts in tokens.groups(batch.column(1).to_pylist()):
                    for raw in enc.encode(texts):
                        row = np.frombuffer(raw + end, "<u4")
                        if width == 16 and int(row.max()) > 0xFFFF:
                            raise ValueError("an id needs more than 16 bits")
                        out.write(row.astype(kind).tobytes())
                        ends.append(ends[-1] + len(row))

        _put(files, base, f"tokens-{name}.bin", body)
        _put(files, base, f"offsets-{name}.bin", lambda out: out.write(np.array(ends, "<i8").tobytes()))
        _put(files, base, f"docs-{name}.bin", lambda out: out.write(np.array(ids, "<i8").tobytes()))
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_docs": pa.array([len(ids)], pa.int64()),
                                          "n_tokens": pa.array([ends[-1]], pa.int64()), "width": pa.array([width], pa.int32())})

    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
               .withColumn("head", F.substring("text", 1, 32)).repartitionByRange("doc_id", "head")
               .sortWithinPartitions("doc_id", "head", "text").drop("head"))
    spark = docs.sparkSession
    manifest = f"{folder}/manifest"
    ordered.mapInArrow(task, _MANIFEST).write.mode("overwrite").parquet(manifest)
    files = spark.read.schema(_MANIFEST).parquet(manifest).where("n_docs > 0")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return files.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Every document of the mapped files: doc_id, start, n_tokens, ids_crc32
    (of the ids as little-endian unsigned 32-bit integers)."""

    def mapped(files, path):
        from pyarrow import fs
        return pa.memory_map(path) if isinstance(files, fs.LocalFileSystem) else files.open_input_file(path)

    def task(batches):
        files, root = _filesystem(folder)
        for batch in batches:
            for row in batch.to_pylist():
                name, size = f"{row['part']:05d}", row["width"] // 8
                with mapped(files, f"{root}/docs-{name}.bin") as f:
                    ids = np.frombuffer(f.read(), "<i8")
                with mapped(files, f"{root}/offsets-{name}.bin") as f:
                    at = np.frombuffer(f.read(), "<i8")
                crcs = np.zeros(len(ids), np.int64)
                with mapped(files, f"{root}/tokens-{name}.bin") as f:
                    for i in range(len(ids)):
                        crc = 0
                        for lo in range(int(at[i]), int(at[i + 1]), BLOCK_IDS):
                            n = min(BLOCK_IDS, int(at[i + 1]) - lo)
                            got = np.frombuffer(f.read_at(n * size, lo * size), f"<u{size}")
                            crc = zlib.crc32(got.astype("<u4").tobytes(), crc)
                        crcs[i] = crc
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
                    "start": pa.array(at[:-1] + row["base"], pa.int64()),
                    "n_tokens": pa.array(np.diff(at), pa.int64()), "ids_crc32": pa.array(crcs, pa.int64())})

    files = manifest.select("part", "width", "base")
    # A stated number of partitions stays: the manifest is small, what it names is not.
    return files.repartition(max(1, files.count()), "part").mapInArrow(task, _READ)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine (a default; every
    operator takes the path as a parameter)."""
    import public_tokenizers
    return os.fspath(public_tokenizers.path(name))
