"""Secret scans over an incremental blob ledger.

Every historical version of every path is content-addressed: a *blob* is the
SHA-256 of the text's UTF-8 bytes. The ledger is an append-only table with one
row per scan of a blob: the (rule kind, rule version) pairs that were looked for and
the spans that were found, in one row, so a blob never counts as scanned without
its findings. An update scans only pairs that the ledger does not hold: a new blob
with all rules, a known blob with the rules that are new or have a new version.
Findings are joined back to all paths that hold the blob.

Texts move once, partially aggregated: copies inside a task become one before the
shuffle, so a blob that a third of all paths hold sends one row a task. The join
back moves keys only and deals hot blobs over salts (``skew``).

Within a task, each rule first asks the linear-time matcher of Arrow whether a
text can match at all; only such texts are searched for places, in code points.

Defined results: null text is empty text, which has no spans. Repeated paths keep a
row each. Other columns are not read. Path columns may have any name but ``blob``
and ``spans``. An empty table scans nothing. A ledger row written twice (two
updates at once) changes nothing, since findings are distinct spans.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.skew import salted_left_join
from netweave.sources.io import read_if_stored

_SPAN = "struct<kind:string,version:int,start:int,end:int>"
LEDGER_SCHEMA = f"blob binary, scanned array<struct<kind:string,version:int>>, spans array<{_SPAN}>"


@dataclass(frozen=True)
class Rule:
    """``pattern`` in Python's syntax, ASCII classes; matches are leftmost and do
    not overlap, and those whose ``group`` is shorter than ``least`` are dropped
    afterwards. ``hint`` is a linear-time pattern that every kept match contains.
    Raise ``version`` with every change: known blobs are then scanned anew."""

    kind: str
    version: int
    pattern: str
    hint: str
    least: int = 1
    group: int = 0
    any_case: bool = False

    def finder(self):
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.any_case else 0)).finditer


#: Assignments of password-like names, cloud access ids and long hex strings.
BASE_RULES = (
    Rule("assign", 1, r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
         r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", least=6, group=2, any_case=True),
    Rule("access", 1, r"AKIA[A-Z0-9]+", r"AKIA[A-Z0-9]{16}", least=20),
    Rule("hex", 1, r"[0-9a-f]{24,}", r"[0-9a-f]{24}", least=24),
)
#: Key blocks and tokens of well-known shapes; every repetition is bounded or ends
#: at its first foreign character, so a search takes linear time.
MORE_RULES = (
    Rule("private_key", 1, r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----[^-]+-----END [A-Z ]{0,40}PRIVATE KEY-----",
         r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", 1, r"\bgh[pousr]_[A-Za-z0-9]{36,}", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", 1, r"\bxox[abprs]-[A-Za-z0-9-]{10,}", r"xox[abprs]-[A-Za-z0-9-]{10}"),
    Rule("google", 1, r"\bAIza[A-Za-z0-9_-]{35}", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", 1, r"\b[rs]k_live_[A-Za-z0-9]{20,}", r"[rs]k_live_[A-Za-z0-9]{20}"),
    Rule("jwt", 1, r"\beyJ[A-Za-z0-9_]{10,500}\.eyJ[A-Za-z0-9_]{10,500}\.[A-Za-z0-9_-]{10,}", r"eyJ[A-Za-z0-9_]{10}"),
    Rule("url_login", 1, r"://[A-Za-z0-9._-]{1,64}:[^\s:/@]{3,64}@", r"://[A-Za-z0-9._-]{1,64}:[^\s:/@]{3,64}@"),
)
RULES = BASE_RULES + MORE_RULES


def address(text: Column) -> Column:
    """Content address of a text."""
    return F.unhex(F.sha2(F.coalesce(text.cast("string"), F.lit("")).cast("binary"), 256))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_if_stored(spark, path, LEDGER_SCHEMA)


def _pair(rule: Rule) -> Column:
    return F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.version).alias("version"))


def _scanner(rules: tuple[Rule, ...]):
    """Arrow batches (blob, text, due) to (blob, due, spans)."""

    def scan(batches):
        finders = [r.finder() for r in rules]
        for batch in batches:
            texts, due = batch.column(1), batch.column(2).to_numpy(zero_copy_only=False)
            can = np.zeros(len(due), np.int64)
            for i, r in enumerate(rules):
                hit = pc.match_substring_regex(texts, r.hint, ignore_case=r.any_case).to_numpy(zero_copy_only=False)
                can |= np.where(hit, 1 << i, 0)
            can &= due
            counts = np.zeros(len(due) + 1, np.int32)
            kinds, versions, starts, ends = [], [], [], []
            for row in np.flatnonzero(can):
                text, had = texts[int(row)].as_py(), len(starts)
                for i, r in enumerate(rules):
                    if can[row] >> i & 1:
                        for m in finders[i](text):
                            if len(m.group(r.group)) >= r.least:
                                kinds.append(r.kind)
                                versions.append(r.version)
                                starts.append(m.start())
                                ends.append(m.end())
                counts[row + 1] = len(starts) - had
            flat = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(versions, pa.int32()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())],
                ["kind", "version", "start", "end"])
            spans = pa.ListArray.from_arrays(pa.array(np.cumsum(counts, dtype=np.int32)), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), spans], ["blob", "due", "spans"])

    return scan


def unseen(versions: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """(blob, text, due) of every blob of ``versions(text)`` with rules that the
    ledger does not hold for it; bit i of ``due`` stands for rule i."""
    blobs = versions.select(address(F.col("text")).alias("blob"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")) \
        .groupBy("blob").agg(F.first("text").alias("text"))
    held = F.lit(0).cast("long")
    for i, r in enumerate(rules):
        held = held + F.when(F.array_contains("scanned", _pair(r)), F.lit(1 << i).cast("long")).otherwise(0)
    done = ledger.select("blob", held.alias("held")).groupBy("blob").agg(F.bit_or("held").alias("held"))
    every = F.lit((1 << len(rules)) - 1).cast("long")
    return (blobs.join(done, "blob", "left")
            .select("blob", "text", every.bitwiseXOR(F.coalesce("held", F.lit(0).cast("long"))).alias("due")).where("due <> 0"))


def update(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = RULES) -> None:
    """Scan what the ledger lacks for ``versions(text)`` and append it."""
    if len({r.kind for r in rules}) < len(rules) or len(rules) > 62:
        raise ValueError("rules need distinct kinds, at most 62")
    ledger = read_ledger(versions.sparkSession, ledger_path)
    got = unseen(versions, ledger, rules).mapInArrow(_scanner(tuple(rules)), f"blob binary, due long, spans array<{_SPAN}>")
    scanned = F.array_compact(F.array(*[
        F.when(F.col("due").bitwiseAND(F.lit(1 << i).cast("long")) != 0, _pair(r)) for i, r in enumerate(rules)]))
    got.select("blob", scanned.alias("scanned"), "spans").write.mode("append").parquet(ledger_path)


def findings(versions: DataFrame, ledger_path: str, paths: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``paths`` columns of every row of ``versions``, its ``blob``, and the
    ``spans`` (start, rank, end, kind, version) of the current rules in its text, by
    start, then the rules' order."""
    if {"blob", "spans"} & {p.lower() for p in paths}:
        raise ValueError("path columns cannot be named blob or spans")
    spans = read_ledger(versions.sparkSession, ledger_path).select("blob", F.explode("spans").alias("s"))
    rank = F.lit(None).cast("int")
    for i, r in enumerate(rules):
        rank = F.when((F.col("s.kind") == r.kind) & (F.col("s.version") == r.version), F.lit(i)).otherwise(rank)
    # one blob's own spans: no more than its text holds
    per_blob = (spans.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("blob")
                .agg(F.sort_array(F.collect_set(F.struct("s.start", "rank", "s.end", "s.kind", "s.version"))).alias("spans")))
    held = versions.select(*paths, address(F.col("text")).alias("blob"))
    joined = salted_left_join(held, per_blob, "blob", paths)
    return joined.select(*paths, "blob", F.coalesce("spans", F.array().cast(per_blob.schema["spans"].dataType)).alias("spans"))


def scan(versions: DataFrame, ledger_path: str, paths: list[str], rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Update the ledger with ``versions`` and return their ``findings``."""
    update(versions, ledger_path, rules)
    return findings(versions, ledger_path, paths, rules)


def _written(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def digest(found: DataFrame) -> DataFrame:
    """Counts and a hash of the base rules' spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))

    def number(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(r.kind) for r in BASE_RULES]
    return found.select("doc_id", *counts, F.sha2(_written(base).cast("binary"), 256).alias("base_sha256"), _written(F.col("spans")).alias("spans"))
