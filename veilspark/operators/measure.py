"""Measures of runs and results: histograms, means, what each stage saw."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .scratch import written


def histogram(rows: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, low, high, n of the finite values in bins of equal width from the least to the largest, all of them, empty ones too; bin -1 holds the infinite and
    not-a-number values, null ones are left out.

    The last bin is closed.  If all values are equal the range is one wide around them.  Without a finite value there is bin -1 alone,
    and without any value nothing.
    """
    v = F.col(column).cast("double")
    finite = ~F.isnan(v) & (F.abs(v) < float("inf"))
    values = rows.where(v.isNotNull()).select(v.alias("v"), finite.alias("finite"))
    ends = values.where("finite").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a is not null")  # one row
    ends = ends.select(F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a")).alias("a"), F.when(F.col("a") == F.col("b"), F.col("b") + 0.5).otherwise(F.col("b")).alias("b"))
    width = (F.col("b") - F.col("a")) / bins
    own = values.where("finite").crossJoin(F.broadcast(ends)).select(F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / width).cast("int")).alias("bin"))
    counted = own.groupBy("bin").agg(F.count("*").alias("n"))
    every = ends.select("a", "b", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    table = every.join(counted, "bin", "left").select("bin", (F.col("a") + F.col("bin") * width).alias("low"), F.when(F.col("bin") == bins - 1, F.col("b")).otherwise(F.col("a") + (F.col("bin") + 1) * width).alias("high"), F.coalesce("n", F.lit(0).cast("long")).alias("n"))
    apart = values.where("not finite").agg(F.count("*").alias("n")).where("n > 0").select(F.lit(-1).alias("bin"), F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high"), "n")
    return table.unionByName(apart)


def means(results: DataFrame, columns: list[str]) -> DataFrame:
    """One row: n, wiki_n, critical_n, and the mean of each column over all rows, whatever their values (an infinite k makes its mean infinite)."""
    return results.agg(F.count("*").alias("n"), F.count_if("wiki").alias("wiki_n"), F.count_if("expected").alias("critical_n"), *(F.avg(F.col(c).cast("double")).alias(f"mean_{c}") for c in columns))


def store_summary(table: DataFrame) -> DataFrame:
    """kind, name, n of a frequency_table(): marginal and joint rows in all, and marginals of each type, the most first."""
    size = F.size("types")
    parts = table.select(F.when(size == 1, "marginals").otherwise("joints").alias("name"), F.when(size == 1, F.get("types", F.lit(0))).alias("type"))
    all_of = parts.groupBy("name").agg(F.count("*").alias("n")).select(F.lit("total").alias("kind"), "name", "n")
    each = parts.where("type is not null").groupBy("type").agg(F.count("*").alias("n")).select(F.lit("type").alias("kind"), F.col("type").alias("name"), "n")
    return all_of.unionByName(each).orderBy("kind", F.desc("n"), "name")


def by_swept(points: DataFrame, swept: dict[str, str]) -> DataFrame:
    """points of one-dimensional sweeps with value, that of the parameter that each sweep varies, in its order."""
    value = F.coalesce(*(F.when(F.col("sweep") == s, F.col(p)) for s, p in swept.items()))
    return points.where(F.col("sweep").isin(*swept)).withColumn("value", value.cast("double")).orderBy("sweep", "value", "point")


class Stages:
    """Stages of a run that are written one after the other; each one's rows and time are observed while it is written, without another pass."""

    def __init__(self, spark: SparkSession):
        self.spark, self.seen = spark, []

    def run(self, name: str, rows: DataFrame, **measures) -> DataFrame:
        """rows, written; ``measures`` are further aggregate columns to be observed."""
        observation = Observation()
        begin = time.time()
        out = written(rows.observe(observation, F.count(F.lit(1)).alias("rows"), *(c.alias(n) for n, c in measures.items())), name)
        self.seen.append((name, dict(observation.get), time.time() - begin))
        return out

    def table(self) -> DataFrame:
        """stage, at, rows, seconds, measures (map) of every stage so far, in order."""
        rows = [(name, i, int(own.pop("rows")), seconds, {k: float(v) for k, v in own.items() if v is not None}) for i, (name, own, seconds) in enumerate((n, dict(o), s) for n, o, s in self.seen)]
        return self.spark.createDataFrame(rows, "stage string, at int, rows long, seconds double, measures map<string,double>")

