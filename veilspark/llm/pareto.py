"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, materialise, unused

#: Bits of a document's random number and of its rank, and of one step of the search for a source's threshold.
BITS, STEP, LEVELS = 52, 8, 3


def uniform(doc_id: Column, seed: str) -> Column:
    """A number of BITS bits from the id, the same in every run; a null id counts as the text 'null'."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("long")


def size_class(size: Column) -> Column:
    """The number of binary digits of a document's size (of 0: 1); a document is wanted in proportion to it."""
    return F.length(F.bin(size)).cast("long")


def pareto_rank(number: Column, p: Column) -> Column:
    """Random odds over inclusion odds, q, as q / (1 + q): the lowest are taken.  Null where the inclusion probability is 0."""
    u = (number + 0.5) / float(1 << BITS)
    q = (u / (1 - u)) / (p / (1 - p))
    return F.when(p > 0, q / (1 + q))


def _place(rank: Column) -> Column:
    return F.floor(rank * float(1 << BITS)).cast("long")


def water_fill(sources: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """Targets of sources (source, source_size): weights in turn by code point (null last), stopping at ``most`` sizes.

    What the stopped sources leave goes to the others by weight: the level at which all is dealt out is found with prefix
    sums over the sources, ordered by the level at which each of them stops.  One row for each source passes through one
    task.  Sizes of 0 give targets of 0.
    """
    rank = (F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (rank + 1).cast("int"))
    caps = sources.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * float(most)).withColumn("_stop", F.col("_cap") / F.col("_w"))
    order = W.orderBy("_stop", F.col("source").asc_nulls_last())
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("_cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = left / F.sum("_w").over(order.rowsBetween(0, W.unboundedFollowing))
    dealt = caps.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_stop"), F.col("_level"))).over(everything))
    return dealt.select("source", "source_size", F.least("_cap", F.coalesce(F.col("_level"), F.lit(0.0)) * F.col("_w")).alias("target"))


def inclusion(by_class: DataFrame, targets: DataFrame, most: int = 3) -> DataFrame:
    """source, cls, source_size, target, whole, p: how often documents of a source and size class are wanted.

    ``by_class`` has source, cls and class_size (words).  A document is wanted in proportion to its class, at most ``most``
    times, so that its source's target is met: whole times for certain, and once more with the inclusion probability p.
    A source has as many classes as its largest size has binary digits.
    """
    own = W.partitionBy("source").orderBy(F.desc("cls"))
    rows = by_class.join(targets.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    # The largest classes stop first: the level is sought as in water_fill().
    left = F.col("target") - F.coalesce(F.sum(F.col("class_size") * float(most)).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    level = F.try_divide(left, F.sum(F.col("cls") * F.col("class_size")).over(own.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") <= float(most) / F.col("cls"), F.col("_level"))).over(own.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)))
    wanted = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.coalesce("_level", F.lit(float(most))) * F.col("cls"))).otherwise(0.0)
    return rows.withColumn("_r", wanted).select("source", "cls", "class_size", "source_size", "target", F.floor("_r").alias("whole"), (F.col("_r") - F.floor("_r")).alias("p"))


def _near(rows: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what the plan has for their keys (nulls meet).  Spark broadcasts a plan of few rows, and splits a hot source otherwise."""
    names = unused([*rows.columns, *plan.columns], *keys)
    for key, name in zip(keys, names, strict=True):
        plan = plan.withColumnRenamed(key, name)
    on = F.lit(True)
    for key, name in zip(keys, names, strict=True):
        on = on & rows[key].eqNullSafe(plan[name])
    return rows.join(plan, on).drop(*names)


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """What the mix takes of each source and size class: source, cls, source_size, target, whole (certain copies), p (inclusion
    probability of one more) and limit (the largest rank, in steps of 2 ** -BITS, that is taken; one for each source).

    ``docs`` has an id, source and size.  The limit is searched digit by digit: three histograms of 256 bins, then the few
    rows of the last bin, so no source passes through one task, however large.
    """
    size = F.coalesce(F.col("size"), F.lit(0)).cast("long")
    d = materialise(docs.select("source", size.alias("size"), size_class(size).alias("cls"), uniform(F.col(id_col), seed).alias("_u")), "mix-rows")
    by_class = materialise(d.groupBy("source", "cls").agg(F.sum("size").alias("class_size")), "mix-classes")
    targets = water_fill(by_class.groupBy("source").agg(F.sum("class_size").alias("source_size")), weights, most)
    classes = materialise(inclusion(by_class, targets, most), "mix-inclusion")
    d = _near(d, classes.where("p > 0").select("source", "cls", "p"), ["source", "cls"]).select("source", "size", _place(pareto_rank(F.col("_u"), F.col("p"))).alias("_v"))
    d = materialise(d, "mix-ranks")
    state = classes.groupBy("source").agg(F.sum(F.col("p") * F.col("class_size")).alias("_left"), F.lit(0).cast("long").alias("_path"), F.lit(0).cast("long").alias("_base"))
    sums = materialise(state, "mix-state")
    for level in range(1, LEVELS + 1):
        digits = F.shiftright(F.col("_v"), BITS - STEP * level)
        at = _near(d, sums, ["source"]).where(F.shiftright(digits, STEP) == F.col("_path")).groupBy("source", digits.alias("_bin")).agg(F.sum("size").alias("_n"), F.first("_base").alias("_base"), F.first("_left").alias("_left"))
        upto = F.col("_base") + F.sum("_n").over(W.partitionBy("source").orderBy("_bin").rowsBetween(W.unboundedPreceding, 0))
        crossing = at.withColumn("_upto", upto).where(F.col("_upto") > F.col("_left"))
        first = crossing.groupBy("source").agg(F.min_by(F.struct("_bin", (F.col("_upto") - F.col("_n")).alias("b")), "_bin").alias("s"), F.first("_left").alias("_left"))
        sums = materialise(first.select("source", "_left", F.col("s._bin").alias("_path"), F.col("s.b").alias("_base")), "mix-state")
    last = _near(d, sums, ["source"]).where(F.shiftright(F.col("_v"), BITS - STEP * LEVELS) == F.col("_path")).groupBy("source", "_v").agg(F.sum("size").alias("_n"), F.first("_base").alias("_base"), F.first("_left").alias("_left"))
    upto = F.col("_base") + F.sum("_n").over(W.partitionBy("source").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    # A rank is in if the sum with it is nearer to the target than the sum without it.
    ends = last.withColumn("_upto", upto).groupBy("source").agg(F.max(F.when(2 * F.col("_left") >= 2 * F.col("_upto") - F.col("_n"), F.col("_v"))).alias("_in"), F.min("_v").alias("_low"))
    full = classes.join(ends.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s")), "left")
    # No bin crosses what is left: all are in.
    limit = F.when(F.col("_low").isNull(), F.lit(1 << BITS)).otherwise(F.coalesce(F.col("_in"), F.col("_low") - 1))
    return materialise(full.select("source", "cls", "source_size", "target", "whole", "p", limit.alias("limit")), "mix-plan")


def copies_of(plan: DataFrame, docs: DataFrame, size: Column, seed: str = "mix", id_col: str = "doc_id") -> tuple[DataFrame, str, str, str]:
    """docs with three more columns, and their (unused) names: its source's and class's plan, how often each row is taken, its Pareto rank."""
    name, cls, copies, rank = unused(docs.columns, "plan", "cls", "copies", "rank")
    plan = plan.select("source", F.col("cls").alias(cls), F.struct("source_size", "target", "whole", "p", "limit").alias(name))
    joined = _near(docs.withColumn(cls, size_class(F.coalesce(size, F.lit(0)).cast("long"))), plan, ["source", cls]).drop(cls)
    joined = joined.withColumn(rank, pareto_rank(uniform(F.col(id_col), seed), F.col(f"{name}.p")))
    return joined.withColumn(copies, (F.col(f"{name}.whole") + F.when(_place(F.col(rank)) <= F.col(f"{name}.limit"), 1).otherwise(0)).cast("long")), name, copies, rank


def pareto_mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: str = "mix", id_col: str = "doc_id") -> DataFrame:
    """How often the mix takes each document: doc_id, source, size, source_size, target, copies, taken, pareto_rank.

    ``docs`` has an id, source and size (words; null counts as 0); other columns are not read, whatever their names.  Documents are
    wanted in proportion to the binary digits of their size, at most ``most`` times.  The whole part of that is certain copies, the
    fraction p is an inclusion probability, which so differs within a source.  A document's rank is its random odds over its
    inclusion odds, (u / (1 - u)) / (p / (1 - p)); of each source the lowest ranks are taken, so many that their words come
    nearest to what the certain copies leave of the target.  Rows that repeat an id share its draw, equal ranks are in or out
    together.  A very long document may be all of its source's mix.  A null source is a source.  An empty table gives an empty result.
    """
    rows = materialise(docs.select(F.col(id_col).alias("doc_id"), "source", F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size")), "mix-docs")
    joined, plan, copies, rank = copies_of(plan_mix(rows, weights, most, seed), rows, F.col("size"), seed)
    return joined.select("doc_id", "source", "size", f"{plan}.source_size", f"{plan}.target", F.col(copies).alias("copies"), (F.col(copies) * F.col("size")).alias("taken"), F.col(rank).alias("pareto_rank"))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
