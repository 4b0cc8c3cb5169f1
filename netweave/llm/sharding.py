"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. The labels are shards. The law kept is
``rows``: at the end the shards' document counts differ by at most one.

All holders of one text see the same neighbours, so what propagation needs of a
text is how many of its holders sit in each shard: one row a text with at most
``shards`` fragments. The links themselves - quadratic in the copies - are never
made. Linked documents are first dealt out evenly; then, round by round,

1. the smaller half of a text's fragments propose to move to shards where larger
   ones sit (the neighbours' shards);
2. the proposals are summed to a shards x shards matrix of wanted moves, on
   which the allowed ones are settled so that no shard outgrows its quota: first
   exchanges, then moves into free places;
3. each cell takes proposals in order of gain up to what is allowed, the last one
   in part.

It ends when no move is left or after ``rounds``. Documents without links then
fill every shard to its quota. The driver sees ``shards`` x ``shards`` sums a
round. Holders of a text are numbered in buckets with prefix sums, so a text held
by a third of all rows is no single task.

Null text counts as no bytes and equals empty text. Repeated rows are documents
of their own; null doc_ids are dealt out like others. Fewer documents than shards
leave shards empty; an empty table gives no row. Other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from netweave.session import materialize, scratch_path

SHARDS = 40
ROUNDS = 12
OVERHEAD_BYTES = 16
#: Rows numbered by one task at most, about.
BUCKET_ROWS = 50_000
#: The most frequent texts, at most so many, are dealt out over a bucket per so
#: many holders; any other text has at most one in ``HOT_TEXTS`` of all rows.
HOT_TEXTS, HOT_ROWS, HOT_BUCKETS = 500, 1000, 4096


def _numbered(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Number rows 0, 1, .. within ``keys``, bucket by bucket: ``df`` has
    ``bucket``, and rows of one bucket are numbered by one task."""
    sizes = df.groupBy(*keys, "bucket").agg(F.count("*").alias("held"))
    before = Window.partitionBy(*keys).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.withColumn("base", F.coalesce(F.sum("held").over(before), F.lit(0))).drop("held")
    inside = Window.partitionBy(*keys, "bucket").orderBy(*order)
    ranked = df.withColumn("inside", F.row_number().over(inside) - 1)
    return (ranked.join(bases, [*keys, "bucket"]).withColumn(out, (F.col("base") + F.col("inside")).cast("long"))
            .drop("base", "inside"))


def _longs(values: list[int]):
    return F.array(*[F.lit(v).cast("long") for v in values])


def settle(wanted: list[list[int]], free: list[int]) -> list[list[int]]:
    """Allowed moves, cell by cell at most the wanted ones, such that every
    shard gains at most its free places."""
    n = len(free)
    left = [row[:] for row in wanted]
    allowed = [[0] * n for _ in range(n)]
    free = free[:]
    for s in range(n):  # exchanges need no place
        for t in range(s + 1, n):
            both = min(left[s][t], left[t][s])
            for a, b in ((s, t), (t, s)):
                allowed[a][b] += both
                left[a][b] -= both
    moved = True
    while moved:  # a move frees places where it started
        moved = False
        for t in range(n):
            for s in sorted(range(n), key=lambda x: -left[x][t]):
                m = min(left[s][t], free[t])
                if m > 0:
                    allowed[s][t] += m
                    left[s][t] -= m
                    free[t] -= m
                    free[s] += m
                    moved = True
    return allowed


def _propose(texts: DataFrame) -> DataFrame:
    """Rows text, s, t, moving, gain: the i-th largest fragment draws the i-th
    smallest one, for the smaller half."""
    ordered = F.expr("array_sort(frags, (a, b) -> CAST(IF(a.m <> b.m, sign(b.m - a.m), sign(a.s - b.s)) AS INT))")
    pairs = F.expr("transform(sequence(1, size(f) div 2), i -> named_struct("
                   "'s', f[size(f) - i].s, 't', f[i - 1].s, 'moving', f[size(f) - i].m, 'larger', f[i - 1].m))")
    return (texts.where("size(frags) > 1").select("text_key", ordered.alias("f"))
            .select("text_key", F.explode(pairs).alias("p"))
            .select("text_key", "p.*"))


def _round(texts: DataFrame, quota: list[int]) -> tuple[DataFrame, int]:
    """One propagation round on rows (text_key, frags); number of documents moved."""
    n = len(quota)
    loads = dict(texts.select(F.explode("frags").alias("f")).groupBy("f.s").agg(F.sum("f.m").alias("m")).collect())
    proposals = _propose(texts)
    wanted = [[0] * n for _ in range(n)]
    for r in proposals.groupBy("s", "t").agg(F.sum("moving").alias("m")).collect():  # shards x shards at most
        wanted[r["s"]][r["t"]] = r["m"]
    allowed = settle(wanted, [quota[s] - loads.get(s, 0) for s in range(n)])
    moved = sum(map(sum, allowed))
    if not moved:
        return texts, 0
    cell = _longs([x for row in allowed for x in row])
    order = Window.partitionBy("s", "t").orderBy(F.desc("larger"), "text_key").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    taken = F.least(F.col("moving"), F.element_at(cell, F.col("s") * n + F.col("t") + 1)
                    - F.sum("moving").over(order) + F.col("moving"))
    moves = (proposals.withColumn("taken", taken).where("taken > 0").groupBy("text_key")
             .agg(F.collect_list(F.struct("s", "t", "taken")).alias("moves")))
    after = F.expr(
        "filter(transform(frags, f -> named_struct('s', f.s, 'm', f.m "
        "- aggregate(moves, 0L, (x, v) -> x + IF(v.s = f.s, v.taken, 0L)) "
        "+ aggregate(moves, 0L, (x, v) -> x + IF(v.t = f.s, v.taken, 0L)))), f -> f.m > 0)")
    moved_texts = texts.join(moves, "text_key", "left").select(
        "text_key", F.when(F.col("moves").isNull(), F.col("frags")).otherwise(after).alias("frags"))
    return materialize(moved_texts), moved


def shard(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """All documents with doc_id, size, text_crc32, law, shard, slot and
    grown_shard (null under the law ``rows``)."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    path = scratch_path(spark, "documents")
    docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                (F.octet_length(text) + OVERHEAD_BYTES).cast("long").alias("size"),
                F.crc32(text.cast("binary")).alias("text_crc32"),
                F.unhex(F.sha2(text, 256)).alias("text_key")).write.parquet(path)
    nodes = spark.read.parquet(path)
    total = nodes.count()
    quota = [total // shards + (s < total % shards) for s in range(shards)]
    held = nodes.groupBy("text_key").agg(F.count("*").alias("holders"))

    # Linked documents, dealt out evenly: a text begins where the one before it ended.
    texts = materialize(held.where("holders > 1").withColumn(
        "bucket", F.pmod(F.xxhash64("text_key"), F.lit(1024))))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # 1,024 rows
    bases = texts.groupBy("bucket").agg(F.sum("holders").alias("n")).select(
        "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    inside = Window.partitionBy("bucket").orderBy("text_key").rowsBetween(Window.unboundedPreceding, -1)
    state = (texts.join(F.broadcast(bases), "bucket")
             .withColumn("first", F.col("base") + F.coalesce(F.sum("holders").over(inside), F.lit(0)))
             .select("text_key", F.expr(
                 f"transform(sequence(0, CAST(least(holders, {shards}) AS INT) - 1), i -> named_struct("
                 f"'s', CAST((first + i) % {shards} AS INT), "
                 f"'m', CAST(holders div {shards} + IF(i < holders % {shards}, 1, 0) AS BIGINT)))").alias("frags")))
    state = materialize(state)
    for _ in range(rounds):
        state, moved = _round(state, quota)
        if not moved:
            break

    # Holders of a text, numbered; fragment f takes the next m numbers. A hot text's
    # holders are in buckets before they meet its count.
    hot = F.broadcast(materialize(texts.where(F.col("holders") > HOT_ROWS).orderBy(F.desc("holders"), "text_key").limit(HOT_TEXTS)
                                  .select("text_key", F.least(F.ceil(F.col("holders") / HOT_ROWS), F.lit(HOT_BUCKETS))
                                          .cast("long").alias("buckets"))))
    dealt = nodes.join(hot, "text_key", "left").withColumn("bucket", F.coalesce(
        F.pmod(F.xxhash64("doc_id", "text_key"), F.col("buckets")), F.lit(0)).cast("long")).drop("buckets")
    copies = held.join(hot, "text_key", "left").withColumn(
        "bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("buckets", F.lit(1)) - 1))).drop("buckets")
    wide = materialize(dealt.join(copies, ["text_key", "bucket"]))  # read several times below
    linked = _numbered(wide.where("holders > 1").drop("holders"), ["text_key"], ["doc_id"], "number")
    spans = state.select("text_key", F.posexplode(F.expr(
        "transform(frags, (f, i) -> named_struct('s', f.s, 'hi', aggregate(slice(frags, 1, i + 1), 0L, (x, g) -> x + g.m), 'm', f.m))")
    ).alias("i", "f")).select("text_key", F.col("f.s").alias("shard"),
                              (F.col("f.hi") - F.col("f.m")).alias("lo"), F.col("f.hi").alias("hi"))
    ranges = linked.groupBy("text_key", "bucket").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    ranges = ranges.join(spans, "text_key").where("lo <= b AND hi > a").drop("a", "b")
    placed = linked.join(ranges, ["text_key", "bucket"]).where("number >= lo AND number < hi").select(
        "doc_id", "size", "text_crc32", "shard")

    # The others fill what is free.
    loads = dict(state.select(F.explode("frags").alias("f")).groupBy("f.s").agg(F.sum("f.m").alias("m")).collect())
    filled, ends = 0, []
    for s in range(shards):
        filled += quota[s] - loads.get(s, 0)
        ends.append(filled)
    alone = wide.where("holders = 1").drop("holders").withColumn("bucket", F.pmod(
        F.xxhash64("text_key"), F.lit(total // BUCKET_ROWS + 1)))
    alone = _numbered(alone.withColumn("all", F.lit(0)), ["all"], ["text_key"], "number")
    single = alone.select("doc_id", "size", "text_crc32", F.size(F.filter(
        _longs(ends), lambda e: e <= F.col("number"))).alias("shard"))

    every = placed.unionByName(single).withColumn("bucket", F.pmod(
        F.xxhash64("doc_id", "text_crc32"), F.lit(total // shards // BUCKET_ROWS + 1)))
    return _numbered(every, ["shard"], ["doc_id", "text_crc32", "size"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"),
        "slot", F.lit(None).cast("int").alias("grown_shard"))
