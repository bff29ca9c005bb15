"""Corpora: article filter, projections, transcripts, resumable processing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import pattern_of


def _any(text: Column, patterns: list[str], ignore_case: bool = True) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.rlike(text, F.lit(pattern_of(p, ignore_case)))
    return out


def biographical(title: Column, text: Column) -> Column:
    """A title of lists or years, a birth or a profession in the first 1200 characters, or a first sentence that says what somebody is."""
    chunk = F.substring(text, 1, 1200)
    sentence = F.substring_index(chunk, ".", 1)
    says = F.rlike(sentence, F.lit(pattern_of(fixed.SENTENCE, False))) & F.rlike(sentence, F.lit(pattern_of(fixed.SENTENCE_WORDS)))
    return _any(title, fixed.TITLES) | _any(chunk, fixed.BIOGRAPHY) | says


def sensitive(text: Column) -> Column:
    return _any(text, fixed.SENSITIVE)


def mentions_person(title: Column, text: Column) -> Column:
    """Whether the title or the first 2000 characters hold a pronoun, a word for persons, an honorific or a name of two words."""
    sample = F.concat(title, F.lit(" "), F.substring(text, 1, 2000))
    part = lambda g: F.regexp_extract_all(sample, F.lit(pattern_of(fixed.NAME, False)), F.lit(g))
    no_name = F.array(*map(F.lit, fixed.NO_NAMES))
    words = rf"\b(?:{'|'.join(fixed.PERSON_WORDS)})\b"
    names = F.exists(F.arrays_zip(part(1).alias("a"), part(2).alias("b")), lambda n: ~F.array_contains(no_name, n["a"]) & ~F.array_contains(no_name, n["b"]))
    return F.rlike(F.lower(sample), F.lit(f"(?U){fixed.PRONOUNS}|{words}")) | F.rlike(sample, F.lit(pattern_of(fixed.HONORIFICS))) | names


def good_articles(articles: DataFrame, least: int = 1000) -> DataFrame:
    """Articles (title, text) that are long enough and neither about persons nor sensitive; cheap tests come first."""
    title, text = F.coalesce("title", F.lit("")), F.coalesce("text", F.lit(""))
    return articles.where((F.length(text) >= least) & ~mentions_person(title, text) & ~biographical(title, text) & ~sensitive(text))


def shorten(text: Column, most: int = 4000) -> Column:
    """Texts over ``most`` characters cut there, the last begun word taken off, with three dots."""
    return F.when(F.length(text) > most, F.concat(F.regexp_replace(F.substring(text, 1, most), r"(?s) [^ ]*\z", ""), F.lit("..."))).otherwise(text)


def sample_hash(name: Column, text: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws(":", name, text), 256), 1, 16)


_BLOCK = r"(?siuU)---\s*# name:\s*([^\n]*)\n# expected_critical:\s*(true|false).*?\[START OF TRANSCRIPT\]\s*(.*?)\s*\[END OF TRANSCRIPT\]"


def block(name: Column, expected: Column, text: Column) -> Column:
    """A transcript block in the text format."""
    return F.format_string("---\n# name: %s\n# expected_critical: %s\n\n[START OF TRANSCRIPT]\n%s\n[END OF TRANSCRIPT]\n", name, F.when(expected, "true").otherwise("false"), text)


def identifier_names(column: Column, kind: str) -> Column:
    """The names in a column of identifiers, which older files hold as a map and others as a list; empty for null."""
    names = F.map_keys(column) if kind.startswith("map") else column if kind.startswith("array") else F.lit(None)
    return F.coalesce(names.cast("array<string>"), F.array().cast("array<string>"))


def quoted(names: Column) -> Column:
    """A list of names as the files write it: ['a', 'b']."""
    sign = F.lit("'")
    one = lambda n: F.when(F.contains(n, sign) & ~F.contains(n, F.lit('"')), F.concat(F.lit('"'), n, F.lit('"'))).otherwise(F.concat(sign, F.replace(F.replace(n, F.lit("\\"), F.lit("\\\\")), sign, F.lit("\\'")), sign))
    return F.concat(F.lit("["), F.array_join(F.transform(names, one), ", "), F.lit("]"))


def sample_block(samples: DataFrame) -> Column:
    """A sample (id, text, difficulty, scenario, expected_critical, direct_identifiers, indirect_identifiers) as a block with its metadata.

    Articles keep their id as name, other samples are named by prefix and id; markers are only added to a text that lacks one of them.
    """
    kinds = dict(samples.dtypes)
    own = F.coalesce(F.col("id").cast("string"), F.lit("unknown"))
    scenario, level, text = F.coalesce("scenario", F.lit("Unknown")), F.coalesce(F.col("difficulty").cast("string"), F.lit("0")), F.coalesce("text", F.lit(""))
    name = F.when(F.startswith(own, F.lit("wiki_")) | (scenario == "Wikipedia article"), own).otherwise(F.concat(F.lit("RAT-"), own))
    marked = F.contains(text, F.lit("[START OF TRANSCRIPT]")) & F.contains(text, F.lit("[END OF TRANSCRIPT]"))
    body = F.when(marked, text).otherwise(F.concat(F.lit("[START OF TRANSCRIPT]\n"), text, F.lit("\n[END OF TRANSCRIPT]")))
    names = [quoted(identifier_names(F.col(c), kinds[c])) for c in ("direct_identifiers", "indirect_identifiers")]
    critical = F.when(F.coalesce("expected_critical", F.lit(False)), "true").otherwise("false")
    return F.concat(
        F.lit("---\n# name: "), name, F.lit(" (difficulty="), level, F.lit(", "), scenario, F.lit(")\n# expected_critical: "), critical, F.lit("\n# rat_difficulty: "), level, F.lit("\n# rat_scenario: "), scenario,
        F.lit("\n# rat_direct_ids: "), names[0], F.lit("\n# rat_indirect_ids: "), names[1], F.lit("\n\n"), body, F.lit("\n"),
    )


def choose_split(rows: DataFrame, split: str, column: str = "split") -> DataFrame:
    """The rows of a split; if there are none, those of the first split by name (null counts as none)."""
    have = rows.agg(F.max(F.col(column) == split).alias("asked"), F.min(column).alias("first"))  # one row
    chosen = have.select(F.when(F.coalesce("asked", F.lit(False)), F.lit(split)).otherwise(F.col("first")).alias("_split"))
    return rows.join(F.broadcast(chosen), F.col(column) == F.col("_split"), "left_semi")


def parse_blocks(files: DataFrame, value: str = "value") -> DataFrame:
    """ord, name, expected, text of the blocks in whole files; a file without blocks gives its paragraphs, not critical."""
    blocks = files.withColumn("_b", F.regexp_extract_all(value, F.lit(_BLOCK), F.lit(0)))
    part = lambda g: F.trim(F.regexp_extract("x", _BLOCK, g))
    found = blocks.select(F.posexplode("_b").alias("ord", "x")).select("ord", part(1).alias("name"), (F.lower(part(2)) == "true").alias("expected"), part(3).alias("text"))
    bare = blocks.where(F.size("_b") == 0).select(F.posexplode(F.filter(F.transform(F.split(value, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")).alias("ord", "text"))
    return found.unionByName(bare.select("ord", F.concat(F.lit("sample_"), (F.col("ord") + 1).cast("string")).alias("name"), F.lit(False).alias("expected"), "text"))


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocks(spark.read.text(path, wholetext=True))


def unprocessed(samples: DataFrame, done: DataFrame, key: str = "hash") -> DataFrame:
    return samples.join(done.select(key).distinct(), key, "left_anti")


def in_sample_order(samples: DataFrame, results: DataFrame, key: str = "hash") -> DataFrame:
    """Results that have a sample, in the samples' order."""
    return results.join(samples.select(key, "ord"), key).orderBy("ord")


def length_stats(samples: DataFrame) -> DataFrame:
    """total, least, most, mean and upper median of the texts' lengths."""
    n = F.length("text")
    # The median of even counts is the upper one: that of the negated lengths from below.
    return samples.agg(F.count("*").alias("total"), F.min(n).alias("least"), F.max(n).alias("most"), F.avg(n).alias("mean"), (-F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY -length(text))")).cast("long").alias("upper_median"))
