"""Scans: a quota of good rows in file order, versions of result files, responses of rows and a header."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import written

#: What a quota scan adds to a row: which file it is of, in order, and its place there.
PLACE = "struct<file:int,row:long>"


def first_good(spark: SparkSession, path: str, good: Callable[[DataFrame], DataFrame], quota: int, growth: int = 2) -> tuple[DataFrame, int]:
    """The first ``quota`` rows in file order that good(), a filter, keeps, with their place and ordinal (0, 1, ...); and how many files were read.

    Files (parquet, in order of their names) are read in blocks, each ``growth`` times as large as the one before it, until there are enough
    good rows; what is behind them isn't read.  The result is what a scan of everything would give.
    """
    schema = spark.read.parquet(path).schema
    files = sorted(spark.read.schema(schema).parquet(path).inputFiles())
    found, have, read, size = [], 0, 0, 1
    while read < len(files) and have < quota:
        block = files[read : read + size]
        number = F.create_map(*(x for i, f in enumerate(block) for x in (F.lit(f.rsplit("/", 1)[-1]), F.lit(read + i))))
        rows = spark.read.schema(schema).parquet(*block).select("*", F.struct(number[F.col("_metadata.file_name")].alias("file"), F.col("_metadata.row_index").alias("row")).alias("place"))
        # Of a block no more rows than the quota are kept, in file order.
        kept = written(good(rows).orderBy("place").limit(quota - have), "quota")
        have, read, size = have + kept.count(), read + len(block), size * growth
        found.append(kept)
    if not found:
        rows = spark.createDataFrame([], schema).withColumn("place", F.lit(None).cast(PLACE))
        return rows.withColumn("ordinal", F.lit(0).cast("long")), 0
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # At most `quota` rows.
    ordered = every.orderBy("place").limit(quota)
    ordinal = F.explode(F.sequence(F.lit(0), F.size("all") - 1))
    listed = ordered.agg(F.array_sort(F.collect_list("place")).alias("all")).where(F.size("all") > 0).select("all", ordinal.alias("i"))
    places = listed.select(F.get("all", F.col("i")).alias("_place"), F.col("i").cast("long").alias("ordinal"))
    return every.join(F.broadcast(places), every["place"] == F.col("_place")).drop("_place"), read


#: A result as any version of the files holds it; what a version lacks is null and takes its default.
RESULT_DEFAULTS = {"sample_name": "''", "sample_hash": "null", "text_length": "0", "expected_critical": "false", "tier": "null", "gate_decision": "''", "k_lower": "0.0", "k_upper": "double('inf')", "joint_risk_score": "0.0", "direct_identifier_count": "0", "quasi_identifier_count": "0", "llm_invoked": "false", "masking_ratio": "0.0", "hard_stop_triggered": "false", "total_time": "0.0", "llm_time": "0.0"}
_KINDS = {"sample_name": "string", "sample_hash": "string", "gate_decision": "string", "text_length": "long", "tier": "int", "direct_identifier_count": "int", "quasi_identifier_count": "int", "expected_critical": "boolean", "llm_invoked": "boolean", "hard_stop_triggered": "boolean"}
#: Older names of fields.
RENAMED = {"llm_invoked": ["llm_used"], "direct_identifier_count": ["direct_id_count"], "quasi_identifier_count": ["qi_count"]}


def int_keys(m: Column, kind: str) -> Column:
    """A map with keys that are integers in text as one with integer keys; other keys and values of another kind go."""
    entries = F.transform(F.map_entries(m), lambda e: F.struct(e["key"].try_cast("int").alias("key"), F.try_variant_get(e["value"], "$", kind).alias("value")))
    return F.map_from_entries(F.filter(entries, lambda e: e["key"].isNotNull() & e["value"].isNotNull()))


def read_results(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Results of JSON files of any version (one array, one record, or a record a line), and what can't be read: file, reason.

    Each record is taken as it is: fields by name with older names and defaults, tiers_by_k and k_lowers_by_k with integer keys,
    the rest of its fields as JSON in ``other``.  A file that isn't JSON, a record that isn't an object and one without a tier
    are set apart with a reason and stop nothing else.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), "value")
    tree = F.try_parse_json("value")
    lines = F.filter(F.split("value", "\n"), lambda x: F.trim(x) != "")
    whole = files.withColumn("tree", tree)
    by_line = F.transform(lines, F.try_parse_json)
    # Lines come first: of several records one after the other a parser sees only the first.
    each_line = (F.size(lines) > 1) & F.forall(by_line, lambda x: x.isNotNull())
    listed = F.schema_of_variant("tree").startswith("ARRAY")
    rows = whole.withColumn("records", F.when(each_line, by_line).when(listed, F.try_variant_get("tree", "$", "array<variant>")).when(F.col("tree").isNotNull(), F.array("tree")))
    bad = rows.where("records is null").select("file", F.lit("not JSON").alias("reason"))
    each = rows.where("records is not null").select("file", F.posexplode("records").alias("at", "r"))
    value = lambda name, kind: F.try_variant_get("r", f"$.{name}", kind)
    field = lambda name: F.coalesce(*(value(n, _KINDS.get(name, "double")) for n in (name, *RENAMED.get(name, ()))), F.expr(RESULT_DEFAULTS[name]).cast(_KINDS.get(name, "double")))
    maps = lambda name: F.try_variant_get("r", f"$.{name}", "map<string,variant>")
    fine = F.coalesce(F.schema_of_variant("r").startswith("OBJECT"), F.lit(False))
    made = each.withColumn("fine", fine).select(
        "file", "at", "fine", *(field(n).alias(n) for n in RESULT_DEFAULTS), int_keys(maps("tiers_by_k"), "int").alias("tiers_by_k"), int_keys(maps("k_lowers_by_k"), "double").alias("k_lowers_by_k"),
        F.to_json("r").alias("other"),
    )
    reason = F.when(~F.col("fine"), "not an object").when(F.col("tier").isNull(), "no tier")
    bad = bad.unionByName(made.where(reason.isNotNull()).select("file", F.concat(F.lit("record "), F.col("at").cast("string"), F.lit(": "), reason).alias("reason")))
    return made.where(F.col("fine") & F.col("tier").isNotNull()).drop("fine"), bad


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """file, row, values (map of name to text): JSON files of one array of arrays, whose first row names the others' fields.

    Rows that are shorter than the header lack the rest of its fields, longer ones lose what has no name.  A file that isn't such an array has no rows.
    """
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.from_json("value", "array<array<string>>").alias("m")).where(F.size("m") > 1)
    rows = files.select("file", F.get("m", F.lit(0)).alias("header"), F.posexplode(F.slice("m", 2, F.size("m"))).alias("row", "cells"))
    named = F.filter(F.transform("header", lambda h, i: F.struct(h.alias("key"), F.get("cells", i).alias("value"))), lambda e: e["key"].isNotNull())
    # A name that comes twice counts once, with its last place.
    names = F.array_distinct(F.transform(named, lambda e: e["key"]))
    return rows.select("file", "row", F.map_from_arrays(names, F.transform(names, lambda k: F.element_at(F.filter(named, lambda e: e["key"] == k), -1)["value"])).alias("values"))


def counts_of(rows: DataFrame, variables: list[str], area: str | None = None) -> DataFrame:
    """code (of the column ``area``; without one of nothing), variable, count of read_matrix(): what isn't a whole number counts 0.

    Without an area only the first row of a file counts, as a national response has just one.
    """
    some = rows if area else rows.where("row = 0")
    number = lambda v: F.coalesce(F.try_element_at("values", F.lit(v)).try_cast("long"), F.lit(0).cast("long"))
    code = F.try_element_at("values", F.lit(area)) if area else F.lit(None).cast("string")
    pairs = F.explode(F.array(*(F.struct(F.lit(v).alias("variable"), number(v).alias("count")) for v in variables)))
    return some.select(code.alias("code"), pairs.alias("p")).select("code", "p.variable", "p.count")
