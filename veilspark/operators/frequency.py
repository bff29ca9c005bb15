"""Population frequencies: marginals and joints with bounds, and the estimates of k that they allow."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

Z = 1.96


def wald(p: Column, n: Column) -> tuple[Column, Column]:
    half = Z * F.sqrt(p * (1 - p) / n)
    return F.greatest(F.lit(0.0), p - half), F.least(F.lit(1.0), p + half)


def wilson(p: Column, n: Column) -> tuple[Column, Column]:
    z2 = Z * Z
    center, spread = (p + z2 / (2 * n)) / (1 + z2 / n), Z * F.sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n)
    return F.greatest(F.lit(0.0), center - spread), F.least(F.lit(1.0), center + spread)


def joint_key(pairs: Column) -> Column:
    """The one form of a key: type=value of array<struct<t, v>> in order of the types, joined by |; these signs are escaped in values, null is \\N."""
    plain = lambda v: F.coalesce(F.regexp_replace(v, r"([\\|=])", r"\\$1"), F.lit("\\N"))
    return F.array_join(F.transform(pairs, lambda x: F.concat(x["t"], F.lit("="), plain(x["v"]))), "|")


def subset_table(rows: DataFrame, pairs: str = "pairs", most: int = 3) -> DataFrame:
    """types, key, count, total, frequency of all combinations of up to ``most`` values that occur in rows (array<struct<t, v>>, by type).

    For many sparse types: each row gives its own subsets, as many as its few values allow.
    """
    own = F.col(pairs)
    one = F.transform(own, lambda x: F.array(x))
    more = lambda sets: F.flatten(F.transform(sets, lambda s: F.transform(F.filter(own, lambda x: x["t"] > F.element_at(s, -1)["t"]), lambda x: F.array_append(s, x))))
    levels = [one]
    for _ in range(most - 1):
        levels.append(more(levels[-1]))
    sets = rows.select(F.explode(F.concat(*levels)).alias("s"))
    counts = sets.groupBy(F.transform("s", lambda x: x["t"]).alias("types"), joint_key(F.col("s")).alias("key")).agg(F.count("*").alias("count"))
    total = rows.agg(F.count("*").alias("total"))  # one row
    return counts.crossJoin(F.broadcast(total)).withColumn("frequency", F.col("count") / F.col("total"))


def frequency_table(facts: DataFrame, types: list[str], most: int = 3) -> DataFrame:
    """types, key, count, total, frequency for all combinations of up to ``most`` columns, in one pass of grouping sets.

    key is joint_key() of the sorted types' values; a null is a value of its own.
    """
    sets = [c for k in range(1, most + 1) for c in combinations(sorted(types), k)]
    rows = facts.groupingSets([[F.col(t) for t in c] for c in sets], *(F.col(t) for t in types)).agg(F.count("*").alias("count"), *(F.grouping(t).alias(f"g_{t}") for t in types))
    pairs = F.filter(F.array(*(F.when(F.col(f"g_{t}") == 0, F.struct(F.lit(t).alias("t"), F.col(t).cast("string").alias("v"))) for t in sorted(types))), lambda x: x.isNotNull())
    total = facts.agg(F.count("*").alias("total"))  # one row
    return rows.withColumn("_p", pairs).select(F.transform("_p", lambda x: x["t"]).alias("types"), joint_key(F.col("_p")).alias("key"), "count").crossJoin(F.broadcast(total)).withColumn("frequency", F.col("count") / F.col("total"))


def first_by_ordinal(rows: DataFrame, keys: list[str], ordinal: str = "ordinal") -> DataFrame:
    """Of rows that repeat a key the one that came first."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(ordinal))).where("_n = 1").drop("_n")


def derive_population(rows: DataFrame, population: int, base: int) -> DataFrame:
    """Counts scaled to another population; frequencies stay."""
    return rows.withColumn("count", (F.col("count") * float(population) / base).cast("int")).withColumn("source", F.concat("source", F.lit("_derived")))


def values_of(types: list[str]) -> Column:
    """array<struct<t, v>> of the columns named, by type, without nulls."""
    return F.filter(F.array(*(F.when(F.col(t).isNotNull(), F.struct(F.lit(t).alias("t"), F.col(t).cast("string").alias("v"))) for t in sorted(types))), lambda x: x.isNotNull())


def estimates(people: DataFrame, types: list[str], table: DataFrame, id_col: str = "id") -> DataFrame:
    """id, method and k (point, lower, upper) of the values in the columns ``types``: see estimate_pairs().  A null value is no value."""
    return estimate_pairs(people.select(F.col(id_col).alias("id"), values_of(types).alias("pairs")), table)


def estimate_pairs(people: DataFrame, table: DataFrame) -> DataFrame:
    """id, qis, method, k_point, k_lower, k_upper, confidence, Fréchet bounds of people (id, pairs: array<struct<t, v>>, by type):
    exact joint, else best pair, else least marginal.

    ``table`` is a frequency_table() or subset_table() of a population; its total is the population's size.  It is read several times,
    so it should be a written or cached one.  Fréchet bounds take the lower bounds of the marginals and need all of them.
    """
    own = people.select("id", F.col("pairs").alias("q"))
    lookup = table.select(F.col("key").alias("_key"), "count", "frequency", "total")
    joint = own.where(F.size("q") > 0).select("id", joint_key(F.col("q")).alias("_key")).join(lookup.where("count > 0"), "_key")
    low, high = wald(F.col("frequency"), F.col("total"))
    joint = joint.select("id", F.col("count").alias("joint"), (low * F.col("total")).alias("joint_low"), (high * F.col("total")).alias("joint_high"))
    one = own.select("id", F.explode("q").alias("x")).select("id", joint_key(F.array("x")).alias("_key"))
    # Pairs of one row's values: at most as many as its types allow.
    pair = F.flatten(F.transform("q", lambda a: F.transform(F.filter("q", lambda b: b["t"] > a["t"]), lambda b: joint_key(F.array(a, b)))))
    two = own.select("id", F.explode(pair).alias("_key"))
    pairs = two.join(lookup, "_key").groupBy("id").agg(F.min(F.col("frequency") * F.col("total")).alias("pair"))
    size = table.select("total").limit(1)
    n, f = F.col("total"), F.col("frequency")
    lower = wald(f, F.greatest("count", F.lit(1)))[0]
    marginals = one.join(lookup.drop("total"), "_key", "left").crossJoin(F.broadcast(size)).groupBy("id").agg(
        F.min(F.when(f > 0, f * n)).alias("least"), F.count_if(f > 0).alias("found"), F.count_if(f.isNull()).alias("missing"),
        F.greatest(F.lit(0.0), F.sum(F.coalesce(lower, F.lit(0.0))) - (F.count("*") - 1)).alias("_frechet"), F.min(lower).alias("_least"), F.first("total").alias("n"),
    )
    share = F.col("found") / (F.col("found") + F.col("missing"))
    rows = own.select("id", F.size("q").alias("qis")).join(joint, "id", "left").join(pairs, "id", "left").join(marginals, "id", "left")
    method = F.when(F.col("qis") == 0, "no_qis").when(F.col("joint").isNotNull(), "empirical_joint").when(F.col("pair").isNotNull(), "pairwise_min_bound").when(F.col("least").isNotNull(), "min_marginal_bound").otherwise("unavailable")
    by = lambda none, exact, pair, least: F.when(F.col("method") == "no_qis", none).when(F.col("method") == "empirical_joint", exact).when(F.col("method") == "pairwise_min_bound", pair).when(F.col("method") == "min_marginal_bound", least)
    infinite = F.lit(float("inf"))
    return rows.withColumn("method", method).select(
        "id", "qis", "method", by(infinite, F.col("joint").cast("double"), F.col("pair"), F.col("least")).alias("k_point"),
        by(infinite, F.col("joint_low"), F.greatest(F.lit(1.0), F.col("pair") * 0.05), F.greatest(F.lit(1.0), F.col("least") * 0.01 * share)).alias("k_lower"),
        by(infinite, F.col("joint_high"), F.col("pair"), F.col("least")).alias("k_upper"), by(F.lit(1.0), F.lit(0.9), F.lit(0.6), F.lit(0.4)).alias("confidence"),
        F.when(F.col("missing") == 0, F.col("_frechet") * F.col("n")).alias("frechet_lower"), F.when(F.col("missing") == 0, F.col("_least") * F.col("n")).alias("frechet_upper"),
    )


def estimate_found(people: DataFrame, table: DataFrame) -> DataFrame:
    """estimate_pairs() of people (id, pairs, found, present) with reason: found and present say how many values a text has, and how many of them are asserted.

    Without any the method is no_qis; if all are denied it is no_patient_qis and k is infinite too; if none of those asserted has a
    value it is no_normalized_values and there is no estimate.  What can't be estimated has a reason.
    """
    rows = estimate_pairs(people.select("id", "pairs"), table).join(people.select("id", "found", "present"), "id")
    none = F.col("method") == "no_qis"
    empty = none & (F.col("present") > 0)
    method = F.when(empty, "no_normalized_values").when(none & (F.col("found") > 0), "no_patient_qis").otherwise(F.col("method"))
    unknown = lambda c: F.when(~empty, F.col(c))
    reason = F.when(empty, "no value of those found is normalized").when(F.col("method") == "unavailable", "no joint, pair or marginal of these values")
    return rows.withColumns({c: unknown(c) for c in ("k_point", "k_lower", "k_upper", "confidence")}).withColumns({"method": method, "reason": reason}).drop("found", "present")
