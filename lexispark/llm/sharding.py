"""Operator 6, sharding: minimax contiguous partition of atomic groups.

Law ``bytes``. Equal texts are an atomic group, however many they are. Groups
stand in the order of their least doc_id; the smallest shard capacity under
which a greedy walk needs no more than the given number of shards is found by
binary search, and the order is cut there. Within that capacity each cut is put
where the remaining bytes divide most evenly, between the last place that the
greedy walk from the left allows and the first that one from the right allows.

Sizes stay on the executors. The driver holds a summary of at most ``BLOCKS``
blocks of consecutive groups, and the sizes in those blocks in which a cut may
still fall, at most ``DETAIL`` groups at a time. Rows are numbered by a range
sort on (group, doc_id), which splits a hot group over many tasks.

Defined results: a null text is an empty one and shares its group, with
checksum 0; null doc_ids come first in their group; rows that repeat are placed
each by itself; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_texts, table, written

SHARDS = 40
OVERHEAD = 16
BLOCKS = 1 << 16
DETAIL = 1 << 21


def _numbered(df: DataFrame) -> DataFrame:
    """A sorted df with part, its partition, and idx, the place in it."""
    df = df.withColumn("part", F.spark_partition_id().cast("long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for b in batches:
            yield b.append_column("idx", pa.array(np.arange(n, n + b.num_rows)))
            n += b.num_rows

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("idx", T.LongType())]))


class Order:
    """Sizes of groups in order: a summary here, details fetched by blocks."""

    def __init__(self, groups: DataFrame, per_block: int):
        self.groups, self.per_block = groups, per_block
        blk = F.floor(F.col("idx") / per_block)
        rows = groups.groupBy("part", blk.alias("blk")).agg(F.sum("bytes").alias("b"), F.max("bytes").alias("m"), F.count("*").alias("n")).toPandas().sort_values(["part", "blk"])
        self.part, self.blk = rows["part"].to_numpy(), rows["blk"].to_numpy()
        self.ends = np.cumsum(rows["b"].to_numpy(np.int64))
        self.firsts = np.append(0, np.cumsum(rows["n"].to_numpy(np.int64)))
        self.total = int(self.ends[-1]) if len(rows) else 0
        self.largest = int(rows["m"].max()) if len(rows) else 0
        self.known: dict[int, np.ndarray] = {}
        self.part_first = {int(p): int(f) for p, f, k in zip(self.part, self.firsts, self.blk) if k == 0}

    def fetch(self, blocks: set[int]) -> None:
        blocks -= self.known.keys()
        if not blocks:
            return
        if sum(len(x) for x in self.known.values()) > DETAIL:
            self.known.clear()
        wanted = self.groups
        if len(blocks) < len(self.blk):
            spans: dict[int, list[int]] = {}
            for b in blocks:
                spans.setdefault(int(self.part[b]), []).append(int(self.blk[b]))
            test = F.lit(False)
            for part, ks in spans.items():
                test |= (F.col("part") == part) & F.floor(F.col("idx") / self.per_block).isin(ks)
            wanted = wanted.filter(test)
        got = wanted.select("part", "idx", "bytes").toPandas().sort_values(["part", "idx"])
        keys = got["part"].to_numpy() * (1 << 40) + got["idx"].to_numpy() // self.per_block
        sizes = got["bytes"].to_numpy(np.int64)
        for b in blocks:
            k = int(self.part[b]) * (1 << 40) + int(self.blk[b])
            lo, hi = np.searchsorted(keys, k), np.searchsorted(keys, k, "right")
            self.known[b] = np.cumsum(sizes[lo:hi]) + (self.ends[b - 1] if b else 0)

    def last_within(self, place: int) -> tuple[int, int]:
        """How many groups end at byte place or before it, and where the last of them ends."""
        if place >= self.total:
            return int(self.firsts[-1]), self.total
        b = bisect.bisect_right(self.ends, place)
        self.fetch({b})
        inner = self.known[b]
        k = int(np.searchsorted(inner, place, "right"))
        return int(self.firsts[b]) + k, int(inner[k - 1]) if k else int(self.ends[b - 1]) if b else 0

    def first_from(self, place: int) -> tuple[int, int]:
        """The fewest groups that reach byte place, and where the last of them ends."""
        if place <= 0:
            return 0, 0
        b = bisect.bisect_left(self.ends, place)
        self.fetch({b})
        inner = self.known[b]
        k = int(np.searchsorted(inner, place, "left"))
        return int(self.firsts[b]) + k + 1, int(inner[k])

    def greedy(self, capacity: int, shards: int) -> list[int] | None:
        """Ends (in bytes) of shards filled from the left; None if they don't suffice."""
        at, out = 0, []
        for _ in range(shards):
            at = self.last_within(at + capacity)[1]
            out.append(at)
        return out if at == self.total else None

    def near(self, lo: int, hi: int, shards: int) -> None:
        """Fetch all blocks in which a greedy cut may fall for any capacity from lo to hi, if they are few enough."""
        blocks: set[int] = set()
        for k in range(1, shards):
            a = bisect.bisect_right(self.ends, max(0, k * (lo - self.largest)))
            b = bisect.bisect_right(self.ends, k * hi)
            blocks.update(range(a, min(b + 1, len(self.ends))))
            if len(blocks) * self.per_block > DETAIL:
                return
        self.fetch(blocks)


def minimax_cuts(order: Order, shards: int) -> tuple[int, list[int]]:
    """The least capacity, and the number of groups before each shard's end."""
    if not order.total:
        return 0, [0] * shards
    even = -(-order.total // shards)
    lo, hi = max(order.largest, even), even + order.largest
    order.near(lo, hi, shards)
    while lo < hi:
        mid = (lo + hi) // 2
        if order.greedy(mid, shards):
            hi = mid
        else:
            lo = mid + 1
    earliest, at = [0] * (shards + 1), order.total
    for k in range(shards, 0, -1):
        earliest[k] = at
        at = order.first_from(at - lo)[1]
    cuts, at = [], 0
    for k in range(1, shards + 1):
        want = at + (order.total - at) // (shards - k + 1)
        below, above = order.last_within(want), order.first_from(want)
        n, end = below if want - below[1] <= above[1] - want else above
        if end < earliest[k]:
            n, end = order.first_from(earliest[k])
        if end - at > lo:
            n, end = order.last_within(at + lo)
        cuts.append(n)
        at = end
    return lo, cuts


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of docs."""
    d = doc_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    d = d.select("doc_id", (F.octet_length("text") + OVERHEAD).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"), F.xxhash64("text").alias("g1"), F.xxhash64(F.lit("second"), "text").alias("g2"))
    d = written(d, "sizes")
    key = ["g1", "g2", "size", "text_crc32"]
    groups = d.groupBy(*key).agg(F.min("doc_id").alias("lead"), F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    groups = written(_numbered(groups.orderBy("lead", "g1", "g2")), "groups")
    order = Order(groups, max(1024, -(-d.count() // BLOCKS)))
    _, cuts = minimax_cuts(order, shards)

    spark = docs.sparkSession
    firsts = spark.createDataFrame([(p, f) for p, f in order.part_first.items()], "part long, first long")
    placed = groups.join(firsts, "part").withColumn("g", F.col("first") + F.col("idx"))
    placed = placed.withColumn("shard", sum((F.col("g") >= c).cast("int") for c in cuts[:-1]) if shards > 1 else F.lit(0)).select(*key, "g", "shard", "rows")
    before = dict.fromkeys(range(shards), 0)
    for r in placed.groupBy("shard").agg(F.sum("rows").alias("n")).collect():
        before |= {k: before[k] + r.n for k in range(r.shard + 1, shards)}
    rows = written(_numbered(d.join(placed.drop("rows"), key).select("doc_id", "size", "text_crc32", "shard", "g").orderBy("g", "doc_id")), "slots")
    counts = sorted((r.part, r.n) for r in rows.groupBy("part").agg(F.count("*").alias("n")).collect())
    ends = np.append(0, np.cumsum([n for _, n in counts])).tolist()
    starts = spark.createDataFrame([(p, at) for (p, _), at in zip(counts, ends)], "part long, first long")
    shard_start = F.create_map(*(F.lit(x) for kv in before.items() for x in kv))
    return rows.join(starts, "part").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("idx") - shard_start[F.col("shard")]).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
