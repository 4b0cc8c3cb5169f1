"""Captured packets as a data source of their own: batch reads, streams and writes.

A capture is a folder of channels (``channel=<n>``), each an append-only log of
numbered segments. A segment is a 64-byte header and records of 64 bytes:

    header: magic ``NWCAP001``, records, least and largest time (microseconds; the
            largest long and the smallest one where no record has a time)
    record: packet_id, time (microseconds since 1970), length, source and
            destination address, protocol, source and destination port, null flags

Addresses are 32-bit numbers (dotted quads in the rows). A segment is written under
a hidden name and appears, complete, with the commit of its write.

* **Batch.** Records have one size, so a segment of any length is cut into ranges of
  ``recordsPerPartition``. Bounds on ``ts`` prune segments by their headers; Spark still
  judges the rows.
* **Stream.** An offset is the next record of each channel, ``[segment, record]``, so it
  grows with channels and not with segments or packets. Segments never change: a replay
  of the same offsets gives the same rows. A micro-batch takes what is there at its
  start; a channel's segments are in the order of their numbers.
* **Write.** Every task writes one segment a channel it holds; ``packet_id`` chooses the
  channel. Segment numbers are given at the commit, after those already there, so appends
  never touch older ones; a task that is repeated leaves a hidden file and no rows.

An empty folder has no rows; null in any column is kept; rows need not be distinct. An
address that is no dotted quad raises, as does a file that is no segment or is cut off.
Paths may be of any file system that Arrow knows (``file``, ``hdfs``, ``s3``, ``gs``) and
must be shared by all machines. ``overwrite`` is refused: a log only grows.
"""

from __future__ import annotations

import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo,
                                    GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual,
                                    WriterCommitMessage)

FORMAT = "netweave_capture"
MAGIC = b"NWCAP001"
HEADER = struct.Struct("<8sqqq32x")
RECORD = np.dtype([("packet_id", "<i8"), ("ts", "<i8"), ("length", "<i8"), ("src_ip", "<u4"), ("dst_ip", "<u4"),
                   ("proto_num", "<i4"), ("src_port", "<i4"), ("dst_port", "<i4"), ("nulls", "<u4"), ("spare", "V16")])
#: Columns in the order of their null flags.
COLUMNS = ["packet_id", "ts", "src_ip", "dst_ip", "proto_num", "src_port", "dst_port", "length"]
SCHEMA = ("packet_id long, ts timestamp_ntz, src_ip string, dst_ip string, proto_num int, src_port int, dst_port int, "
          "length long")
RECORDS_PER_PARTITION = 1_000_000
RECORDS_PER_BATCH = 50_000
CHANNELS = 8
_MOST, _LEAST = 2 ** 63 - 1, -2 ** 63


def _place(path: str):
    """File system and path within it."""
    from pyarrow import fs
    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# --- records ---------------------------------------------------------------------------

def _quads(column: pa.Array) -> np.ndarray:
    """Addresses as numbers, null as 0. Each distinct one is read once."""
    import pyarrow.compute as pc
    coded = pc.dictionary_encode(column.cast(pa.string()))
    values = np.zeros(len(coded.dictionary) + 1, np.uint32)
    for i, text in enumerate(coded.dictionary.to_pylist()):
        parts = text.split(".")
        if len(parts) != 4 or not all(p.isascii() and p.isdigit() and int(p) < 256 for p in parts):
            raise ValueError(f"no IPv4 address: {text!r}")
        values[i] = int.from_bytes(bytes(map(int, parts)), "big")
    return values[pc.fill_null(coded.indices, len(coded.dictionary)).to_numpy(zero_copy_only=False)]


def _dotted(numbers: np.ndarray) -> pa.Array:
    distinct, at = np.unique(numbers, return_inverse=True)
    texts = pa.array([".".join(map(str, int(n).to_bytes(4, "big"))) for n in distinct], pa.string())
    return texts.take(pa.array(at))


def to_records(batch: pa.RecordBatch) -> np.ndarray:
    """Records of a batch that has ``COLUMNS``."""
    import pyarrow.compute as pc
    out = np.zeros(batch.num_rows, RECORD)
    for bit, name in enumerate(COLUMNS):
        column = batch.column(batch.schema.get_field_index(name))
        out["nulls"] |= np.where(column.is_null().to_numpy(zero_copy_only=False), np.uint32(1 << bit), np.uint32(0))
        if name in ("src_ip", "dst_ip"):
            out[name] = _quads(column)
        else:
            plain = column.cast(pa.timestamp("us")).cast(pa.int64()) if name == "ts" else column
            out[name] = pc.fill_null(plain, 0).to_numpy(zero_copy_only=False)
    return out


def to_batch(records: np.ndarray) -> pa.RecordBatch:
    """Rows of records, in the types of ``SCHEMA``."""
    columns = []
    for bit, name in enumerate(COLUMNS):
        null = (records["nulls"] >> np.uint32(bit) & np.uint32(1)).astype(bool)
        values = _dotted(records[name]) if name in ("src_ip", "dst_ip") else pa.array(np.ascontiguousarray(records[name]))
        if name == "ts":
            values = values.cast(pa.timestamp("us"))
        columns.append(pa.compute.if_else(pa.array(~null), values, pa.scalar(None, values.type)) if null.any() else values)
    return pa.RecordBatch.from_arrays(columns, COLUMNS)


# --- segments --------------------------------------------------------------------------

@dataclass
class Segment:
    """A complete segment of a channel."""

    channel: int
    number: int
    path: str
    records: int


def segments(path: str) -> list[Segment]:
    """All segments below ``path``, by channel and number, from one listing."""
    from pyarrow import fs
    store, root = _place(path)
    found = []
    for f in store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True)):
        parts = f.path.split("/")
        if f.type == fs.FileType.File and f.base_name.endswith(".cap") and f.base_name[0] not in "._" and parts[-2].startswith("channel="):
            body = f.size - HEADER.size
            if body < 0 or body % RECORD.itemsize:
                raise ValueError(f"{f.path} is cut off")
            found.append(Segment(int(parts[-2][8:]), int(f.base_name[:-4]), f.path, body // RECORD.itemsize))
    return sorted(found, key=lambda s: (s.channel, s.number))


def _times(store, path: str) -> tuple[int, int]:
    with store.open_input_file(path) as f:
        magic, _, least, most = HEADER.unpack(f.read(HEADER.size))
    if magic != MAGIC:
        raise ValueError(f"{path} is no capture segment")
    return least, most


@dataclass
class Range(InputPartition):
    """Records ``first`` to ``last`` (not included) of a segment."""

    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        super().__init__(None)
        self.path, self.first, self.last = path, first, last


def _ranges(segment: Segment, first: int, last: int, size: int) -> list[Range]:
    return [Range(segment.path, lo, min(lo + size, last)) for lo in range(first, last, size)]


def _rows(path: str, part: Range):
    """Arrow batches of a range."""
    if part.first >= part.last:
        return
    store, _ = _place(path)
    with store.open_input_file(part.path) as f:
        if f.read(len(MAGIC)) != MAGIC:
            raise ValueError(f"{part.path} is no capture segment")
        for lo in range(part.first, part.last, RECORDS_PER_BATCH):
            n = min(RECORDS_PER_BATCH, part.last - lo)
            raw = f.read_at(n * RECORD.itemsize, HEADER.size + lo * RECORD.itemsize)
            yield to_batch(np.frombuffer(raw, RECORD))


class _Options:
    def __init__(self, options):
        self.path = options.get("path") or ""
        if not self.path:
            raise ValueError("a capture needs a path")
        self.size = int(options.get("recordsPerPartition", RECORDS_PER_PARTITION))
        self.channels = int(options.get("channels", CHANNELS))
        if self.size < 1 or self.channels < 1:
            raise ValueError("recordsPerPartition and channels are 1 or more")


class CaptureReader(DataSourceReader):
    """Ranges of all segments that can hold rows within the bounds on ``ts``."""

    def __init__(self, options):
        self.options = _Options(options)
        self.low, self.high = _LEAST, _MOST

    def pushFilters(self, filters):
        for f in filters:
            if getattr(f, "attribute", None) == ("ts",) and getattr(f, "value", None) is not None:
                at = int(np.datetime64(f.value.replace(tzinfo=None), "us").astype(np.int64))
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.low = max(self.low, at)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.high = min(self.high, at)
            yield f  # segments are pruned, rows are left to Spark

    def partitions(self):
        found = segments(self.options.path)
        if (self.low, self.high) != (_LEAST, _MOST):
            store, _ = _place(self.options.path)
            found = [s for s, (least, most) in ((s, _times(store, s.path)) for s in found)
                     if least <= self.high and most >= self.low]
        return [r for s in found for r in _ranges(s, 0, s.records, self.options.size)] or [Range("", 0, 0)]

    def read(self, partition):
        return _rows(self.options.path, partition)


class CaptureStream(DataSourceStreamReader):
    """Offsets ``{channel: [segment, record]}``: the next record to read."""

    def __init__(self, options):
        self.options = _Options(options)

    def initialOffset(self):
        return {}

    def latestOffset(self):
        return {str(s.channel): [s.number, s.records] for s in segments(self.options.path)}  # the last of a channel stays

    def partitions(self, start, end):
        out = []
        for s in segments(self.options.path):
            low, high = (o.get(str(s.channel), [0, 0]) for o in (start, end))
            first = low[1] if s.number == low[0] else 0
            last = high[1] if s.number == high[0] else s.records
            if low[0] <= s.number <= high[0]:
                out += _ranges(s, first, last, self.options.size)
        return out or [Range("", 0, 0)]

    def read(self, partition):
        return _rows(self.options.path, partition)

    def commit(self, end):
        pass  # the log keeps its segments


@dataclass
class Written(WriterCommitMessage):
    """Hidden segments of a task: channel, path."""

    files: list[tuple[int, str]]


class CaptureWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.options = _Options(options)

    def write(self, iterator):
        store, root = _place(self.options.path)
        open_, counts, files = {}, {}, []
        try:
            for batch in iterator:
                records = to_records(batch)
                channel = records["packet_id"] % self.options.channels
                for c in np.unique(channel).tolist():
                    own = records[channel == c]
                    if c not in open_:
                        store.create_dir(f"{root}/channel={c}", recursive=True)
                        path = f"{root}/channel={c}/.{uuid.uuid4().hex}.body"
                        open_[c], counts[c] = store.open_output_stream(path), [0, _MOST, _LEAST]
                        files.append((c, path))
                    open_[c].write(own.tobytes())
                    times = own["ts"][(own["nulls"] & np.uint32(2)) == 0]
                    n, least, most = counts[c]
                    counts[c] = [n + len(own), min([least, *times[:1], times.min(initial=_MOST)]),
                                 max([most, times.max(initial=_LEAST)])]
        finally:
            for f in open_.values():
                f.close()
        out = []
        for c, body in files:  # the header's numbers are known at the end; object stores cannot write back
            path = body.replace(".body", ".part")
            with store.open_input_stream(body) as source, store.open_output_stream(path) as sink:
                sink.write(HEADER.pack(MAGIC, *map(int, counts[c])))
                while chunk := source.read(1 << 22):
                    sink.write(chunk)
            store.delete_file(body)
            out.append((c, path))
        return Written(out)

    def commit(self, messages):
        store, root = _place(self.options.path)
        store.create_dir(root, recursive=True)
        last: dict[int, int] = {}
        for s in segments(self.options.path):
            last[s.channel] = s.number
        for c, path in (f for m in messages if m is not None for f in m.files):
            last[c] = last.get(c, 0) + 1
            store.move(path, f"{root}/channel={c}/{last[c]:012d}.cap")

    def abort(self, messages):
        store, _ = _place(self.options.path)
        for _, path in (f for m in messages if m is not None for f in m.files):
            store.delete_file(path)


class CaptureSource(DataSource):
    """``spark.read / readStream / write.format("netweave_capture")``."""

    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return CaptureReader(self.options)

    def streamReader(self, schema):
        return CaptureStream(self.options)

    def writer(self, schema, overwrite):
        if overwrite:
            raise ValueError("a capture only grows: use mode append")
        return CaptureWriter(self.options)


def use_captures(spark: SparkSession) -> None:
    """Make the format known to the session, and let it take filters (Spark refuses a
    source that takes them while the setting is off)."""
    spark.dataSource.register(CaptureSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_capture(packets: DataFrame, path: str, channels: int = CHANNELS) -> None:
    """Append packets (any extra columns are left out) to the capture at ``path``."""
    use_captures(packets.sparkSession)
    packets.select(*[F.col(f.name).cast(f.dataType) for f in T.StructType.fromDDL(SCHEMA)]).write.format(FORMAT).mode(
        "append").option("channels", channels).save(path)


def read_capture(spark: SparkSession, path: str, streaming: bool = False, records_per_partition: int = RECORDS_PER_PARTITION) -> DataFrame:
    """Packets of the capture at ``path``, as a batch or a stream."""
    use_captures(spark)
    reader = spark.readStream if streaming else spark.read
    return reader.format(FORMAT).option("recordsPerPartition", records_per_partition).load(path)


# --- message logs ----------------------------------------------------------------------

MESSAGE_SCHEMA = "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"


def message_of(packets: DataFrame, topic: str, partitions: int = CHANNELS) -> DataFrame:
    """Packets as message-log rows (JSON values, the flow's two ends as key)."""
    body = F.struct(*[F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts") if c == "ts" else F.col(c) for c in COLUMNS])
    key = F.concat_ws("|", "src_ip", "dst_ip")
    return packets.select(key.cast("binary").alias("key"), F.to_json(body).cast("binary").alias("value"),
                          F.lit(topic).alias("topic"), F.pmod(F.xxhash64(key), F.lit(partitions)).cast("int").alias("partition"),
                          F.col("packet_id").alias("offset"), F.col("ts").cast("timestamp").alias("timestamp"))


def decode_messages(messages: DataFrame) -> DataFrame:
    """Message-log rows (key, value, topic, partition, offset, timestamp) as packets, batch or
    stream: the packet columns, ``topic``, ``partition``, ``offset`` and ``malformed``, null
    for a good row, else the value as text: null, no JSON object, a field of another type.
    JVM-side; a message is one row, in any order."""
    text = F.col("value").cast("string")
    schema = SCHEMA + ", _corrupt string"
    parsed = F.from_json(text, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
                                        "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"})
    bad = F.col("p").isNull() | F.col("p._corrupt").isNotNull()
    rows = messages.select(parsed.alias("p"), text.alias("__text"), "topic", "partition", "offset")
    return rows.select(*[F.when(~bad, F.col(f"p.{c}")).alias(c) for c in COLUMNS], "topic", "partition", "offset",
                       F.when(bad, F.coalesce(F.col("__text"), F.lit(""))).alias("malformed"))


def once(decoded: DataFrame) -> DataFrame:
    """Each message once (a broker may deliver it again), by topic, partition and offset; of
    batches only: a stream keeps its messages apart by its own offsets."""
    return decoded.dropDuplicates(["topic", "partition", "offset"])
