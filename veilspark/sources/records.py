"""Files of samples and results: readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.corpus import block

#: The names of an uncertain decision that files use.
UNCERTAIN = ["UNCERTAIN_NEEDS_LLM", "UNCERTAIN_NEED_LLM"]
#: A sample as files hold it.
SAMPLE = "id string, text string, difficulty int, scenario string, direct_identifiers map<string, string>, indirect_identifiers map<string, string>, features array<string>, profile map<string, string>"


def record_text(text: Column, title: Column, article: Column) -> Column:
    """A record's text: its own, else the article's under its title, else the article's, else an empty one.  Without an article a title gives nothing."""
    titled = F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"), article)).otherwise(article)
    return F.coalesce(F.nullif(text, F.lit("")), titled, F.lit(""))


def read_samples(spark: SparkSession, path: str, config: str | None = None, lists_only: bool = False) -> DataFrame:
    """The samples of JSON files, each one array of records or one record a file.

    Folders config=NAME partition an export by its configuration: ``config`` reads that one alone.  With ``lists_only`` a file that isn't
    one array is an error, which names it.
    """
    if lists_only:
        listed = F.coalesce(F.schema_of_variant(F.try_parse_json("value")).startswith("ARRAY"), F.lit(False))
        odd = spark.read.text(path, wholetext=True).where(~listed).select("_metadata.file_name").limit(1).collect()
        if odd:
            raise ValueError(f"{odd[0][0]} isn't a JSON list of records")
    rows = spark.read.schema(SAMPLE).json(path, multiLine=True)
    return rows if config is None else rows.where(F.col("config") == config).drop("config")


def samples(rows: DataFrame, difficulties: list[int] | None = None, most: int | None = None, ordinal: str = "ord") -> DataFrame:
    """Samples of rows (those of SAMPLE that it has, and an ordinal), all of them critical; those without a text go.

    What a row lacks takes its default: the ordinal for the id, difficulty 0, scenario unknown, nothing else.  ``most`` takes the
    first by ordinal, after the filters.
    """
    has = lambda c, d: F.coalesce(c, d) if c in rows.columns else d
    empty = F.create_map().cast("map<string, string>")
    out = rows.select(
        F.col(ordinal), has("id", F.col(ordinal)).cast("string").alias("id"), "text", has("difficulty", F.lit(0)).cast("int").alias("difficulty"), has("scenario", F.lit("unknown")).alias("scenario"),
        has("direct_identifiers", empty).alias("direct_identifiers"), has("indirect_identifiers", empty).alias("indirect_identifiers"), has("features", F.array().cast("array<string>")).alias("features"),
        has("profile", empty).alias("profile"), F.lit(True).alias("expected_critical"),
    ).where("text <> ''")
    if difficulties:
        out = out.where(F.col("difficulty").isin(difficulties))
    return out.orderBy(ordinal).limit(most) if most else out


def numbered(rows: DataFrame, taken: DataFrame, prefix: str = "wiki_", quota: int | None = None, ordinal: str = "ord") -> DataFrame:
    """rows with an id of prefix and ordinal; ids in ``taken`` (id) are skipped, and a skip uses up quota."""
    named = (rows.where(F.col(ordinal) < quota) if quota else rows).withColumn("id", F.concat(F.lit(prefix), F.col(ordinal).cast("string")))
    return named.join(taken.select("id").distinct(), "id", "left_anti")


def write_blocks(rows: DataFrame, path: str) -> None:
    """Transcript blocks of rows (name, expected, text), a text file a task; read_blocks() reads them."""
    rows.select(block(F.coalesce("name", F.lit("")), F.coalesce("expected", F.lit(False)), F.coalesce("text", F.lit(""))).alias("value")).write.mode("overwrite").text(path)


def write_json(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls included."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def undecided(results: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of results whose gate_decision is an uncertain one."""
    return results.where(F.col("gate_decision").isin(UNCERTAIN)).select(*columns)


def decision_of_tier(tier: Column, llm_used: Column, uncertain: str = UNCERTAIN[1]) -> Column:
    """A result's gate_decision from its tier: 3 is unsafe, or uncertain where a model was asked; others are safe."""
    return F.when((tier == 3) & F.coalesce(llm_used, F.lit(False)), uncertain).when(tier == 3, "UNSAFE").otherwise("SAFE")
