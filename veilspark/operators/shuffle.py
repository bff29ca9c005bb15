"""A seeded permutation of rows with dense positions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import written

#: Rows a range has on average, and ranges a group of them.
RANGE, GROUP = 4096, 4096


def shuffle_key(seed: int, *keys: Column | str) -> Column:
    """64 hex digits that order rows by seed: a null is a value of its own."""
    parts = [F.coalesce(F.col(k).cast("string") if isinstance(k, str) else k.cast("string"), F.lit("\x00")) for k in keys]
    return F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), *parts), 256)


def shuffled(rows: DataFrame, seed: int, keys: list[str], position: str = "position") -> DataFrame:
    """rows with their place (0, 1, ...) in a permutation that seed and keys decide alone; rows of equal keys follow each other.

    Rows fall into ranges of a hash; the ranges' sizes are summed up in two levels, and only within a range are rows put in order,
    so no task sees more than its ranges.  More rows make more ranges.  (A generator's own order can't be had in parallel.)
    """
    n = rows.count()
    bits = max(1, min(40, math.ceil(math.log2(max(2, n / RANGE)))))
    keyed = written(rows.withColumn("_h", shuffle_key(seed, *keys)), "shuffle")
    place = F.shiftright(F.conv(F.substring("_h", 1, 15), 16, 10).cast("long"), 60 - bits)
    keyed = keyed.withColumn("_range", place)
    sizes = keyed.groupBy("_range").agg(F.count("*").alias("m")).withColumn("_group", F.floor(F.col("_range") / GROUP))
    groups = sizes.groupBy("_group").agg(F.sum("m").alias("m"))  # a row for each 16 million rows
    before = groups.select("_group", (F.sum("m").over(W.orderBy("_group")) - F.col("m")).alias("_before"))
    within = F.sum("m").over(W.partitionBy("_group").orderBy("_range")) - F.col("m")
    starts = sizes.withColumn("_within", within).join(before, "_group").select("_range", (F.col("_before") + F.col("_within")).alias("_start"))
    inside = F.row_number().over(W.partitionBy("_range").orderBy("_h")) - 1
    return keyed.join(starts, "_range").withColumn(position, (F.col("_start") + inside).cast("long")).drop("_h", "_range", "_start")
