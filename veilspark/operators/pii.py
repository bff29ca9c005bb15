"""Identifier spans: detection, categories, overlap merge, masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import fold, hit_spans, hits, let, pattern_of, replace_spans, scan


def category(entity: Column) -> Column:
    return F.when(entity.isin(fixed.DIRECT_TYPES), fixed.CATEGORIES[0]).when(entity.isin(fixed.STRONG_TYPES), fixed.CATEGORIES[1]).when(entity.isin(fixed.CONTEXTUAL_TYPES), fixed.CATEGORIES[3]).otherwise(fixed.CATEGORIES[2])


def priority(cat: Column) -> Column:
    return F.array_position(F.array(*(F.lit(c) for c in fixed.CATEGORIES)), cat)


#: Literals of which a text must hold one to have a match; others need a digit.
_HINTS = {"EMAIL_ADDRESS": ["@"]}
_EVIDENCE = "struct<start:int,end:int,ord:struct<pattern:int,match:int>,entity_type:string,category:string,score:double,detector:string>"
_MERGED = "struct<start:int,end:int,entity_type:string,category:string,detector:string,score:double,n:int,confirmed_by:array<string>>"


def evidence(text: Column, types: list[str] | None = None) -> Column:
    """array<struct<start, end, ord, entity_type, category, score, detector>> of every match of every pattern, by place, then by order of the patterns."""
    every = [(entity, p) for entity in (types or list(fixed.PII)) for p in fixed.PII[entity]]
    names = F.array(*(F.lit(entity) for entity, _ in every))

    def found(digit: Column) -> Column:
        return hits(text, [(k, pattern_of(p), 0, F.contains(text, F.lit(_HINTS[entity][0])) if entity in _HINTS else digit) for k, (entity, p) in enumerate(every)])

    def typed(s: Column) -> Column:
        entity = F.get(names, s["k"])
        return F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.struct(s["k"].alias("pattern"), s["i"].alias("match")).alias("ord"), entity.alias("entity_type"), category(entity).alias("category"), F.lit(fixed.PII_SCORE).alias("score"),
            F.lit("custom_regex").alias("detector"),
        ).cast(_EVIDENCE)

    spans = hit_spans(let(F.rlike(text, F.lit(r"\p{Nd}")), found))
    return F.coalesce(F.array_sort(F.transform(spans, typed)), F.array().cast(f"array<{_EVIDENCE}>"))


def counts(text: Column, types: list[str] | None = None) -> Column:
    """array<struct<entity_type, n>> of the types that the text has, in order; empty for a null text."""
    number = lambda entity: sum((F.regexp_count(text, F.lit(pattern_of(p))) for p in fixed.PII[entity]), F.lit(0))
    guard = lambda entity, digit: F.contains(text, F.lit(_HINTS[entity][0])) if entity in _HINTS else digit
    every = lambda digit: F.array(*(F.struct(F.lit(e).alias("entity_type"), F.when(guard(e, digit), number(e)).otherwise(0).cast("long").alias("n")) for e in types or fixed.PII))
    return F.filter(let(F.rlike(text, F.lit(r"\p{Nd}")), every), lambda x: x["n"] > 0)


def detect(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """doc_id, entity_type, category, start, end, score, ord: every match of every pattern; the text isn't shuffled."""
    rows = docs.select("doc_id", F.explode_outer(evidence(F.col("text"), types)).alias("s")).where("s is not null")
    return rows.select("doc_id", "s.entity_type", "s.start", "s.end", "s.ord", "s.category", "s.score", "s.detector")


def _overlaps(cur: Column, x: Column) -> Column:
    return x["start"] < cur["end"]


def merged(found: Column) -> Column:
    """The spans of evidence() with overlapping ones as one, within the row: see merge()."""
    none = F.array().cast("array<string>")
    names = ["start", "end", "entity_type", "category", "detector", "score", "n", "confirmed_by"]
    row = lambda *c: F.struct(*(x.alias(n) for x, n in zip(c, names, strict=True)))

    def join(cur: Column, x: Column) -> Column:
        end, n = F.greatest(cur["end"], x["end"]), cur["n"] + 1
        won = row(cur["start"], end, x["entity_type"], x["category"], x["detector"], F.greatest(cur["score"], x["score"]), n, F.when(cur["detector"] != x["detector"], F.array(cur["detector"])).otherwise(none))
        kept = row(cur["start"], end, cur["entity_type"], cur["category"], cur["detector"], cur["score"], n, F.array_append(cur["confirmed_by"], x["detector"]))
        return F.when(priority(x["category"]) < priority(cur["category"]), won.cast(_MERGED)).otherwise(kept.cast(_MERGED))

    return fold(found, _MERGED, lambda x: row(x["start"], x["end"], x["entity_type"], x["category"], x["detector"], x["score"], F.lit(1), none), _overlaps, join)


def masked(text: Column, spans: Column, categories: list[str] | None = None) -> Column:
    """The text with merged() spans of the categories (default: all) as [TYPE]."""
    chosen = F.filter(spans, lambda s: s["category"].isin(categories)) if categories else spans
    return replace_spans(text, F.transform(chosen, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), F.upper(s["entity_type"]), F.lit("]")).alias("label"))))


def all_masked(text: Column, spans: Column, qi: Column) -> Column:
    """The text with merged() spans and quasi-identifiers masked together; the first label of an overlap stays."""
    label = "struct<start:int,end:int,o:int,label:string>"
    one = lambda s, o, name: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(o).alias("o"), F.upper(s[name]).alias("label")).cast(label)
    both = F.array_sort(F.concat(F.transform(spans, lambda s: one(s, 0, "entity_type")), F.transform(F.filter(qi, lambda s: s["start"].isNotNull()), lambda s: one(s, 1, "qi_type"))))
    islands = fold(both, label, lambda x: x, _overlaps, lambda cur, x: F.struct(cur["start"].alias("start"), F.greatest(cur["end"], x["end"]).alias("end"), cur["o"].alias("o"), cur["label"].alias("label")))
    return replace_spans(text, F.transform(islands, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.concat(F.lit("["), s["label"], F.lit("]")).alias("label"))))


_PIECE = "struct<start:int,end:int,m_start:int,m_end:int>"


def with_residual(docs: DataFrame, spans: Column, types: list[str], categories: list[str] | None = None, text: str = "text") -> DataFrame:
    """docs with masked (as masked() has it) and left: array<struct<entity_type, category, start, end, m_start, m_end>>, identifiers of these types that masking left.

    The masked text is searched once more; places are given in it (m_start, m_end) and in the source (start, end).  What lies within
    a label stands for the whole span that the label replaced.  A null text has none.  Columns masked and left are replaced.
    """
    chosen = F.filter(spans, lambda s: s["category"].isin(categories)) if categories else spans
    label = lambda s: F.length(s["entity_type"]) + 2

    def step(shift: Column, s: Column) -> tuple[Column, Column]:
        first = s["start"] + shift
        return shift + label(s) - (s["end"] - s["start"]), F.struct(s["start"].alias("start"), s["end"].alias("end"), first.alias("m_start"), (first + label(s)).alias("m_end")).cast(_PIECE)

    def source(at: Column, side: str) -> Column:
        last = F.try_element_at(F.filter("_pieces", lambda p: p["m_start"] < at if side == "end" else p["m_start"] <= at), F.lit(-1))
        return let(last, lambda p: F.when(p.isNull(), at).when(at < p["m_end"], p[side]).otherwise(at - p["m_end"] + p["end"]))

    def placed(s: Column) -> Column:
        return F.struct(s["entity_type"].alias("entity_type"), s["category"].alias("category"), source(s["start"], "start").alias("start"), source(s["end"], "end").alias("end"), s["start"].alias("m_start"), s["end"].alias("m_end"))

    rows = docs.withColumn("_spans", chosen).withColumn("masked", masked(F.col(text), F.col("_spans"))).withColumn("left", merged(evidence(F.col("masked"), types)))
    # An empty list of pieces has no last one.
    pieces = F.when(F.size("left") > 0, scan(F.col("_spans"), F.lit(0), _PIECE, step)["out"])
    return rows.withColumn("_pieces", pieces).withColumn("left", F.transform("left", placed)).drop("_spans", "_pieces")


def merge(evidence: DataFrame) -> DataFrame:
    """Overlapping spans of a document as one: the first of the strongest category names it, its end is the last end.

    The score is the largest among those that raised the category (each stronger than all before it); confirmed_by has the
    detector that the winner replaced, if another one, and those of all behind the winner.
    """
    order = W.partitionBy("doc_id").orderBy("start", "end", "ord")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    e = evidence.withColumn("_new", (F.col("start") >= F.max("end").over(before)).cast("int")).withColumn("_island", F.sum(F.coalesce("_new", F.lit(1))).over(order)).withColumn("_p", priority(F.col("category")))
    inside = W.partitionBy("doc_id", "_island").orderBy("start", "end", "ord")
    e = e.withColumn("_best", F.min("_p").over(inside.rowsBetween(W.unboundedPreceding, -1))).withColumn("_rises", F.col("_best").isNull() | (F.col("_p") < F.col("_best"))).withColumn("_n", F.row_number().over(inside))
    key = F.struct("_p", "_n")
    out = e.groupBy("doc_id", "_island").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min_by("entity_type", key).alias("entity_type"), F.min_by("category", key).alias("category"), F.min_by("detector", key).alias("detector"),
        F.max(F.when(F.col("_rises"), F.col("score"))).alias("score"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("_n", "_p", "_rises", "detector"))).alias("all"),
    )
    rises = F.filter("all", lambda x: x["_rises"])
    replaced = F.get(F.slice(F.reverse(rises), 2, 1), F.lit(0))["detector"]
    winner = F.element_at(rises, -1)
    behind = F.transform(F.filter("all", lambda x: x["_n"] > winner["_n"]), lambda x: x["detector"])
    first = F.when(replaced.isNotNull() & (replaced != F.col("detector")), F.array(replaced)).otherwise(F.array().cast("array<string>"))
    return out.withColumn("confirmed_by", F.concat(first, behind)).drop("all", "_island")
