"""A corpus pipeline: quality, near-duplicates, benchmark decontamination, mixing, sharding.

In all stages rows are told apart by a number of their own, so null and repeated ids and rows that repeat are worked off one by one.  A null text
is an empty one: it has no words to judge or to match, is a near-duplicate of every other text without words, and has the size 0 in the mix.  Very long texts are read whole.  Columns of other names stay up to the last stage, whatever they are called.  Of
equal choices the smallest id, then a hash of the text decides.  Empty documents give an empty result; without labels all documents
are kept, without benchmark items none is contaminated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm.common import discard, materialise, unused
from veilspark.llm.kneser_ney import kept_documents
from veilspark.llm.pareto import copies_of, plan_mix, word_count
from veilspark.llm.sharding import shard_documents
from veilspark.llm.simhash import one_of_each_group
from veilspark.llm.tiling import clean_documents


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents within their language's quantile of perplexity."""
    return kept_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five words a shingle, a similarity of about 0.8 or more."""
    return one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of every benchmark item."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    size = word_count(F.col("text"))
    joined, _, copies, _ = copies_of(plan_mix(docs.select("doc_id", "source", size.alias("size"))), docs, size)
    number = unused(joined.columns, "number")[0]
    repeated = joined.where(F.col(copies) > 0).withColumn(number, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies))))
    return repeated.select(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row in eight shards of near equal bytes."""
    return shard_documents(docs, 8)


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]

#: SQL can't express the first two stages; tests/llm compares them with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other; what a stage has written is deleted once the next one is."""
    docs, written = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
