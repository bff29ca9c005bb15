"""Minimax contiguous partition of a corpus into shards, with DataFrame functions only.

Documents with equal texts form an atomic group.  Groups stand in one fixed order (by hash of the text), their sizes give
prefix sums, and the smallest capacity with which the order can be cut into ``n_shards`` runs is found by binary search,
each probe being checked greedily.  The prefix sums stay distributed: the driver only holds the ends of a bounded number
of buckets and asks for finer buckets (one small aggregation) where a probe falls between two ends that it can't tell apart.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialise

_KEY = ["_h", "_crc", "_size"]


class _Ends:
    """What is known of the sorted set of group ends: some of its values, and whether more may lie behind each."""

    def __init__(self, groups: DataFrame, total: int, buckets: int):
        self.groups, self.total, self.buckets = groups, total, buckets
        self.at, self.open = [0, total + 1], [True, False]
        self.refine({0})

    def refine(self, gaps: set[int]) -> None:
        spans = [(self.at[i], self.at[i + 1], max(1, -(-(self.at[i + 1] - self.at[i]) // self.buckets))) for i in sorted(gaps)]
        x, bucket, inside = F.col("g_end"), F.lit(None).cast("long"), F.lit(False)
        for k, (a, b, width) in enumerate(spans):
            here = (x > a) & (x < b)
            inside = inside | here
            bucket = F.when(here, F.lit(k * (self.buckets + 1)) + F.floor((x - a) / F.lit(width)).cast("long")).otherwise(bucket)
        found = self.groups.where(inside).groupBy(bucket.alias("b")).agg(F.min("g_end"), F.max("g_end"), F.count("*")).collect()
        new: dict[int, list] = {}
        for b, low, high, n in sorted(map(tuple, found)):
            new.setdefault(b // (self.buckets + 1), []).append((low, high, n))
        for k, i in reversed(list(enumerate(sorted(gaps)))):
            at, more = [self.at[i]], [False]
            for low, high, n in new.get(k, []):
                at.append(low)
                more.append(False)
                if high > low:
                    more[-1] = n > 2
                    at.append(high)
                    more.append(False)
            self.at[i : i + 1], self.open[i : i + 1] = at, more

    def below(self, x: int) -> tuple[int, int | None]:
        """The largest known end up to x, and the gap behind it if unknown ends up to x may lie there."""
        i = bisect_right(self.at, x) - 1
        return self.at[i], (i if self.open[i] and x > self.at[i] else None)

    def exact(self, x: int) -> tuple[int, int]:
        """The last end up to x and the first beyond it (or total)."""
        while (gap := self.below(x)[1]) is not None:
            self.refine({gap})
        i = bisect_right(self.at, x) - 1
        while self.open[i]:  # x is an end itself: the next one may be unknown
            self.refine({i})
        return self.at[i], min(self.at[i + 1], self.total) if i + 1 < len(self.at) else self.total

    def fits(self, capacity: int, shards: int, base: int, hopeful: bool, unsure: set[int]) -> bool:
        """Whether the groups behind base fit into so many shards, taking unknown ends to be there (hopeful) or not."""
        for _ in range(shards):
            if base + capacity >= self.total:
                return True
            low, gap = self.below(base + capacity)
            if gap is not None:
                unsure.add(gap)
                low = base + capacity if hopeful else low
            base = low
        return base >= self.total

    def feasible(self, capacity: int, shards: int, base: int = 0) -> bool:
        while True:
            unsure: set[int] = set()
            if self.fits(capacity, shards, base, False, unsure):
                return True
            if not self.fits(capacity, shards, base, True, unsure):
                return False
            self.refine(unsure)


def minimax_cuts(groups: DataFrame, n_shards: int, buckets: int = 4096) -> tuple[int, list[int]]:
    """The smallest feasible capacity and the ends of all shards but the last.

    ``groups`` has g_end (prefix sum with the group itself) and g_size, both positive longs.  Among the cuts that keep
    the capacity, each shard takes the one next to an equal share of what is left.  No groups: capacity 0, cuts at 0.
    """
    total, largest = groups.agg(F.max("g_end"), F.max("g_size")).first()
    if total is None:
        return 0, [0] * (n_shards - 1)
    ends = _Ends(groups, total, buckets)
    low = max(-(-total // n_shards), largest)
    high = min(total, -(-total // n_shards) + largest)
    while low < high:
        middle = (low + high) // 2
        if ends.feasible(middle, n_shards):
            high = middle
        else:
            low = middle + 1
    cuts, base = [], 0
    for left in range(n_shards - 1, 0, -1):
        share = base + -(-(total - base) // (left + 1))
        under, over = ends.exact(min(share, total))
        choices = sorted({under, over}, key=lambda x: (abs(x - share), x))
        most = ends.exact(min(base + low, total))[0]
        base = next((x for x in choices if base <= x <= base + low and ends.feasible(low, left, x)), most)
        cuts.append(base)
    return low, cuts


def shard_documents(docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Give every document a shard and a slot in it: doc_id, size, text_crc32, shard, slot.

    Size is the UTF-8 bytes of the text plus 1.  A null text counts as an empty one.  Equal texts share a shard, however
    many they are; slots count from 0 without gaps, in the order of the shards' groups and then of the id (nulls first;
    rows that repeat an id take neighbouring slots).  More shards than groups: some shards stay empty.  An empty table
    gives an empty result.  Extra columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("_size"), F.crc32(text.cast("binary")).alias("_crc"), F.xxhash64(text).alias("_h"))
    # Two-level prefix sums: ranges of (group, id), so that even one large group spreads over many tasks.
    order = [*_KEY, "doc_id"]
    ranged = materialise(materialise(rows, "shard-rows").repartitionByRange(*order).withColumn("_pid", F.spark_partition_id()), "shard-ranges")
    sums = ranged.groupBy("_pid").agg(F.sum("_size").alias("_b"), F.count("*").alias("_n"))
    before = W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("_pid", F.coalesce(F.sum("_b").over(before), F.lit(0)).alias("_b0"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"))
    here = W.partitionBy("_pid").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    # One row for each range: as many as shuffle partitions.
    placed = materialise(
        ranged.join(F.broadcast(offsets), "_pid").select("doc_id", *_KEY, (F.col("_b0") + F.sum("_size").over(here)).alias("_end"), (F.col("_n0") + F.count("*").over(here)).alias("_row")),
        "shard-placed",
    )
    groups = materialise(placed.groupBy(*_KEY).agg(F.max("_end").alias("g_end"), F.sum("_size").alias("g_size")).select("g_end", "g_size"), "shard-groups")
    _, cuts = minimax_cuts(groups, n_shards)
    shard = sum((F.when(F.col("_end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    first = dict(placed.groupBy(shard.alias("s")).agg(F.min("_row")).collect())
    start = F.lit(None).cast("long")
    for s, row in first.items():
        start = F.when(shard == s, F.lit(row)).otherwise(start)
    return placed.select("doc_id", F.col("_size").alias("size"), F.col("_crc").alias("text_crc32"), shard.alias("shard"), (F.col("_row") - start).alias("slot"))
