"""Frequencies of a population from published counts, shares and per cents, as rows (qi_type, qi_value, count, frequency, bounds, source)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from .frequency import wald, wilson


def with_bounds(rows: DataFrame, total: Column, exact: bool = False) -> DataFrame:
    """rows with frequency, lower_bound and upper_bound of count in total: Wilson's, or Wald's for joints (``exact``).  Rows without a positive total go."""
    n = total.cast("double")
    p = F.col("count") / n
    low, high = wald(p, n) if exact else wilson(p, n)
    return rows.where(n > 0).withColumns({"frequency": p, "lower_bound": low, "upper_bound": high})


def from_shares(spark: SparkSession, qi_type: str, shares: dict[str, float], population: int, source: str) -> DataFrame:
    """Counts of a population from shares of it; frequency is the share, bounds are Wald's over the count."""
    rows = spark.createDataFrame([(qi_type, v, float(f)) for v, f in shares.items()], "qi_type string, qi_value string, frequency double")
    counted = rows.withColumn("count", (F.col("frequency") * population).cast("long"))
    low, high = wald(F.col("frequency"), F.greatest("count", F.lit(1)))
    return counted.withColumns({"lower_bound": low, "upper_bound": high, "source": F.lit(source)})


def from_counts(rows: DataFrame, qi_type: str, source: str) -> DataFrame:
    """Marginals of counts (qi_value, count): each one's share of them all, whose sum is one row of partial sums."""
    whole = rows.agg(F.sum("count").alias("_total"))
    return with_bounds(rows.crossJoin(F.broadcast(whole)).withColumns({"qi_type": F.lit(qi_type), "source": F.lit(source)}), F.col("_total")).drop("_total")


def from_prevalence(rows: DataFrame, adults: int, source: str) -> DataFrame:
    """Marginals of per cents (qi_type, qi_value, percent); conditions and disabilities get their complement too."""
    has = (F.lit(adults) * (F.col("percent") / 100)).cast("long")
    both = F.col("qi_type").isin("health_condition", "disability_status")
    pair = F.array(F.struct(F.col("qi_value").alias("qi_value"), has.alias("count")), F.when(both, F.struct(F.concat(F.lit("no_"), F.col("qi_value")).alias("qi_value"), (adults - has).alias("count"))))
    return with_bounds(rows.select("qi_type", F.explode(F.array_compact(pair)).alias("x")).select("qi_type", "x.*").withColumn("source", F.lit(source)), F.lit(adults))


def age_bucket(group: Column) -> Column:
    """The bucket of five years of an age group such as under_5, 20, 22_24 or 85_plus; what has no age is null."""
    low = F.when(group.contains("under_"), 0).otherwise(F.regexp_extract(group, r"(\d+)", 1).try_cast("int"))
    low = F.floor(low / 5) * 5
    return F.when(low >= 85, "85+").otherwise(F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string")))


def age_by_sex(census: DataFrame, total: int, source: str) -> tuple[DataFrame, DataFrame]:
    """From census counts (variable such as male_15_17, count) marginals of sex and age, and joints of both, in one aggregation."""
    parts = census.select(F.regexp_extract("variable", r"^(male|female)_", 1).alias("sex"), age_bucket(F.regexp_replace("variable", r"^(male|female)_", "")).alias("age_5yr"), "count")
    cube = parts.where("sex <> '' and age_5yr is not null").groupingSets([["sex"], ["age_5yr"], ["sex", "age_5yr"]], "sex", "age_5yr").agg(F.sum("count").alias("count"), F.grouping("sex").alias("gs"), F.grouping("age_5yr").alias("ga"))
    one = cube.where("gs + ga = 1").select(F.when(F.col("ga") == 1, "sex").otherwise("age_5yr").alias("qi_type"), F.coalesce("sex", "age_5yr").alias("qi_value"), "count", F.lit(source).alias("source"))
    two = cube.where("gs + ga = 0 and count > 0").select("age_5yr", "sex", "count", F.lit(source).alias("source"))
    return with_bounds(one, F.lit(total)), with_bounds(two, F.lit(total), exact=True)


def prevalence_classes(diseases: DataFrame, source: str) -> DataFrame:
    """Diseases (prevalence_class, count) rolled up by class, names made plain, with each class's share."""
    plain = F.replace(F.replace(F.replace("prevalence_class", F.lit("/"), F.lit("_per_")), F.lit(">"), F.lit("gt_")), F.lit("<"), F.lit("lt_"))
    return from_counts(diseases.groupBy(plain.alias("qi_value")).agg(F.sum("count").alias("count")), "rare_disease_prevalence", source)


def newest_series(observations: DataFrame) -> DataFrame:
    """The newest value of each series (series_id, period, value in thousands) as a count."""
    newest = observations.groupBy("series_id").agg(F.max_by("value", "period").alias("value"))
    return newest.select("series_id", (F.col("value") * 1000).cast("long").alias("count"))


def latest_metadata(rows: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Upsert by primary key: of rows that repeat a key the one written last."""
    return rows.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(ordinal)))).where("_n = 1").drop("_n")


#: How a hospital's share of a value differs from the population's: by kind of value, a factor.
_FACTORS = {
    "education": lambda v: 0.9 + 0.2 * F.pmod(F.xxhash64(v), F.lit(10)) / 10,
    "employment": lambda v: F.lit(1.0),
    "occupation_major": lambda v: F.when(v.isin("healthcare_practitioners", "healthcare_support"), 3.0).otherwise(0.8),
    "occupation_detailed": lambda v: F.when(v.rlike("nurse|physician|healthcare"), 5.0).when(v.isin(fixed.RARE_OCCUPATIONS), 0.5).otherwise(1.0),
    "occupation": lambda v: F.when(v == "healthcare", 5.0).otherwise(1.0),
}


def hospital_scaled(marginals: DataFrame, kind: str, patients: int = fixed.HOSPITAL_POPULATION) -> DataFrame:
    """Marginals (qi_type, qi_value, frequency, source) as those of a hospital's patients: shares times a factor of the value, counts cut to whole ones.

    A detailed occupation counts 1 at least.  The factor of education varies by a hash of the value; values of a null frequency have no count.
    """
    count = (F.col("frequency") * float(patients) * _FACTORS[kind](F.col("qi_value"))).cast("long")
    count = F.greatest(F.lit(1).cast("long"), count) if kind == "occupation_detailed" else count
    rows = marginals.withColumn("count", count).where("count is not null").withColumn("frequency", F.col("count") / float(patients))
    low, high = wald(F.col("frequency"), F.greatest("count", F.lit(1)))
    return rows.withColumns({"lower_bound": low, "upper_bound": high}).select("qi_type", "qi_value", "count", "frequency", "lower_bound", "upper_bound", "source")


def hospital_conditions(spark: SparkSession) -> DataFrame:
    """Conditions of a hospital's patients, with Wald's bounds over all patients."""
    rows = spark.createDataFrame([("condition", v, n, f) for v, (n, f) in fixed.HOSPITAL_CONDITIONS.items()], "qi_type string, qi_value string, count long, frequency double")
    low, high = wald(F.col("frequency"), F.lit(float(fixed.HOSPITAL_POPULATION)))
    return rows.withColumns({"lower_bound": low, "upper_bound": high, "source": F.lit("HOSPITAL_DX_2024")})


def yes_and_no(spark: SparkSession, qi_type: str, yes: int, population: int, source: str) -> DataFrame:
    """Two marginals: those who have something, and all others of a population."""
    rows = spark.createDataFrame([(qi_type, "yes", yes), (qi_type, "no", population - yes)], "qi_type string, qi_value string, count long")
    return with_bounds(rows.withColumn("source", F.lit(source)), F.lit(population))


def published(spark: SparkSession) -> DataFrame:
    """The marginals that ship as fixed values: education, employment, occupations, conditions."""
    jobs = spark.createDataFrame(list(fixed.OCCUPATION_COUNTS.items()), "qi_value string, count long")
    rates = spark.createDataFrame([(t, v, p) for t, vs in fixed.PREVALENCE.items() for v, p in vs.items()], "qi_type string, qi_value string, percent double")
    parts = [from_shares(spark, "education", fixed.EDUCATION_SHARES, fixed.US_POPULATION, "ACS_PUMS_SCHL_2022"), from_shares(spark, "employment", fixed.EMPLOYMENT_SHARES, fixed.US_POPULATION, "ACS_PUMS_ESR_2022")]
    parts += [from_counts(jobs, "occupation", "BLS_OES"), from_prevalence(rates, fixed.US_ADULTS, "CDC_PLACES_2023")]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
