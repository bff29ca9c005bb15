"""Policies as rows: the rules of each deployment over time, and the version that holds for a request."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed

POLICY = "deployment string, policy_version string, valid_from timestamp, reference_population string, k_minimum int, k_safe_threshold int, require_joint_estimate boolean, direct_identifier_types array<string>"
#: What holds where no policy does, and what null fields of a policy take.
DEFAULTS = {"policy_version": "default", "reference_population": "none", "k_minimum": 5, "k_safe_threshold": 20, "require_joint_estimate": True, "direct_identifier_types": fixed.DIRECT_TYPES}
#: Most policy rows that are broadcast.
SENT_POLICIES = 100_000


def policies(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """Rows in the order of POLICY as a table; what is shorter has nulls."""
    width = len(POLICY.split(", "))
    return spark.createDataFrame([(*r, *[None] * (width - len(r))) for r in rows], POLICY)


def governed(requests: DataFrame, rules: DataFrame, deployment: str = "deployment", at: str = "at") -> DataFrame:
    """requests with the policy of their deployment that was the newest at their time: the columns of POLICY but deployment and valid_from.

    Each policy holds until the next one of its deployment begins; of two that begin at once the one with the later version
    counts.  A request of no deployment, before the first policy or without a time, takes the defaults, as do a policy's null fields.
    Policies are few: their intervals are broadcast if their number allows, and are joined by deployment if not.
    """
    own = W.partitionBy("deployment")
    newest = rules.withColumn("_n", F.row_number().over(own.partitionBy("deployment", "valid_from").orderBy(F.desc_nulls_last("policy_version")))).where("_n = 1 AND deployment IS NOT NULL AND valid_from IS NOT NULL")
    spans = newest.withColumn("_until", F.lead("valid_from").over(own.orderBy("valid_from"))).drop("_n")
    names = [c for c in DEFAULTS]
    spans = spans.select(F.col("deployment").alias("_deployment"), F.col("valid_from").alias("_from"), "_until", *(F.col(c).alias(f"_{c}") for c in names))
    if rules.count() <= SENT_POLICIES:
        spans = F.broadcast(spans)
    holds = (F.col(deployment) == F.col("_deployment")) & (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    default = lambda c: F.array(*map(F.lit, DEFAULTS[c])) if isinstance(DEFAULTS[c], list | tuple | set | frozenset) else F.lit(DEFAULTS[c])
    rest = [requests[c] for c in requests.columns if c not in names]
    return requests.join(spans, holds, "left").select(*rest, *(F.coalesce(f"_{c}", default(c)).alias(c) for c in names))


def with_population(rows: DataFrame, populations: DataFrame) -> DataFrame:
    """rows (reference_population) with population_size: null where the population (population_id, total_size) isn't known.

    Populations are named by policies, so there are no more of them than policies that anybody uses.
    """
    known = populations.groupBy(F.col("population_id").alias("_population")).agg(F.max("total_size").cast("long").alias("population_size"))
    return rows.join(known, F.col("reference_population") == F.col("_population"), "left").drop("_population")
