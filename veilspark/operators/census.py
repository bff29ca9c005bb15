"""Population tables summed from census rows, and joints of a population taken as independent marginals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .population import with_bounds


def universe_marginals(census: DataFrame, values: dict[str, str], universe: str, qi_type: str, source: str, positive: bool = False) -> DataFrame:
    """Marginals of census rows (variable, count) over the count of the variable ``universe``.

    ``values`` says which value a variable counts towards; variables of one value are summed (marital status over both sexes), others
    are left out.  A missing or null count is 0; ``positive`` leaves out values without a count.
    """
    named = F.create_map(*(F.lit(x) for pair in values.items() for x in pair))
    counts = census.groupBy("variable").agg(F.sum(F.coalesce("count", F.lit(0))).alias("count"))
    whole = counts.where(F.col("variable") == universe).select(F.col("count").alias("_total"))  # one row
    parts = counts.where(F.col("variable").isin(*values)).groupBy(named[F.col("variable")].alias("qi_value")).agg(F.sum("count").alias("count"))
    rows = parts.where("count > 0") if positive else parts
    return with_bounds(rows.crossJoin(F.broadcast(whole)).withColumns({"qi_type": F.lit(qi_type), "source": F.lit(source)}), F.col("_total")).drop("_total")


def area_marginals(areas: DataFrame, names: DataFrame, qi_type: str, source: str) -> DataFrame:
    """Marginals of areas (code, count) over the sum of all of them; only those that ``names`` (code, qi_value) knows are returned."""
    counts = areas.groupBy("code").agg(F.sum("count").alias("count"))
    whole = areas.agg(F.sum("count").alias("_total"))  # one row
    rows = counts.join(names.select("code", "qi_value"), "code").crossJoin(F.broadcast(whole))
    return with_bounds(rows.withColumns({"qi_type": F.lit(qi_type), "source": F.lit(source)}), F.col("_total")).drop("_total", "code")


def prevalence_by_area(rates: DataFrame, population: int, source: str) -> DataFrame:
    """Joints of area and condition from per cents (area, condition, percent), each area taken to hold ``population``; counts are cut to whole ones."""
    count = (F.lit(population) * (F.col("percent") / 100)).cast("long")
    return with_bounds(rates.select("area", "condition", count.alias("count"), F.lit(source).alias("source")), F.lit(population), exact=True)


def most_frequent(marginal: DataFrame, n: int) -> DataFrame:
    """The n values (qi_value, frequency) of the highest frequency, ties by value."""
    return marginal.orderBy(F.desc("frequency"), "qi_value").limit(n)


def independent_joints(marginals: dict[str, DataFrame], population: int, least: int | None = None) -> DataFrame:
    """One row for each combination of values, with a column for each type and the count that independence gives, cut to a whole one.

    ``marginals`` (qi_value, frequency) are small dimensions: their product is the result.  Without ``least`` a count is 1 at least;
    with it, only counts above it are returned.
    """
    sides = [m.select(F.col("qi_value").alias(t), F.col("frequency").alias(f"_f_{i}")) for i, (t, m) in enumerate(marginals.items())]
    share = reduce(lambda a, b: a * b, (F.col(f"_f_{i}") for i in range(len(sides))))
    count = (share * F.lit(population)).cast("long")
    rows = reduce(lambda a, b: a.crossJoin(b), sides).withColumn("count", count if least is not None else F.greatest(F.lit(1).cast("long"), count))
    return (rows if least is None else rows.where(F.col("count") > least)).select(*marginals, "count")
