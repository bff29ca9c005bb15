"""Quasi-identifiers: detection, normalization, deduplication, negation, joint keys."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import HIT_SPAN, fold, hit_spans, hits, let, lowered, pattern_of


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


_FOUND = "struct<qi_type:string,value:string,start:int,end:int,confidence:double,granularity:string,unseen:boolean,detector:string,ord:struct<pattern:int,match:int>>"
#: Literals of which a lowered text must hold one to have a match.
_AGE, _SEX, _MARITAL, _SPOUSE, _CITIZEN = ["age", "year", "yo", "y/o", "i'm", "iam"], [["sex", "gender"], [" male ", " female ", " man ", " woman "], [" male ", " female "]], ["married", "single", "divorced", "widowed", "separated"], ["spouse", "wife", "husband"], ["citizen", "born", "foreign"]
_RACE = [
    "laotian", "hmong", "cambodian", "vietnamese", "filipin", "chinese", "korean", "japanese", "asian", "pacific", "hawaiian", "samoan", "tongan", "white", "caucasian", "black", "african", "indian",
    "alaska", "native", "indigenous", "hispanic", "latin", "mexican", "rican", "cuban", "eastern", "arab", "races", "multiracial", "mixed",
]
#: With blanks around it a literal must be a whole word; "degree" may follow without a blank.
_EDUCATION = [
    ["high school", " hs ", "hsdiploma", "degree"], [" ged ", "g.e.d."], ["college"], ["associate", " aa ", " as ", "degree"], ["bachelor", " ba ", " bs ", "b.a.", "b.s.", "degree"], ["master", " ma ", " ms ", " mba ", "m.a.", "m.s.", "degree"],
    ["doctor", " ph", "phd"], [" md ", "m.d.", "medical", "medicine"], [" jd ", "j.d.", " law ", "juris"], ["drop"], ["education"],
]
_EMPLOYMENT = [["employed", "work"], ["employed", "work", "jobless", "looking"], ["retired", "working"], ["military", "force", "army", "navy", "marine", "guard"], ["serving", "enlisted", "duty"], ["home", "housew", "househ"], ["student", "school", "attending"], ["disab"]]
_MONTHS = [m.lower() for m in fixed.SHORT_MONTHS.split("|")]
_DAY_HINTS = [["/", "-"], _MONTHS, _MONTHS, _MONTHS, ["/", "-"], _MONTHS]
_TIME_HINTS = [[":"], ["am", "pm", "a.m.", "p.m."], [":"], ["noon", "midnight"], ["clock"]]


def _pieces(literal: str) -> list[str]:
    """What must stand in a text's words for the literal to be there: itself, or what lies between its inner blanks."""
    return literal.split() if " " in literal.strip() else [literal]


def _present_in(literals: list[str]):
    """A function from a lowered text to those literals (none with an inner blank) that it has; one that begins with a blank must begin a word, one that
    ends with a blank end it, where words end at anything but a letter a-z, a digit or _, so no whole word is missed.

    Texts are cut at blanks, and the literals are sought in a word when a task meets it first.
    """
    whole = {h: re.compile(("(?<![a-z0-9_])" if h[0] == " " else "") + re.escape(h.strip()) + ("(?![a-z0-9_])" if h[-1] == " " else "")) for h in literals if h != h.strip()}
    bare = {h: h.strip() for h in literals}
    most, longest = 1 << 18, 64

    @F.pandas_udf("array<string>")
    def present(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        nothing, some = set(), {}

        def one(text):
            if text is None:
                return None
            if len(nothing) + len(some) > most:
                nothing.clear()
                some.clear()
            has, new = set(), []
            for word in set(text.split(" ")) - nothing:
                known = some.get(word)
                if known is None:
                    new.append(word)
                else:
                    has.update(known)
            if new:
                all_new = " ".join(new)
                likely = [h for h in literals if bare[h] in all_new]
                for word in new:
                    own = [h for h in likely if bare[h] in word and (h not in whole or whole[h].search(word))]
                    has.update(own)
                    if len(word) <= longest:
                        if own:
                            some[word] = own
                        else:
                            nothing.add(word)
            return sorted(has)

        for texts in batches:
            yield texts.map(one)

    return present


@lru_cache(maxsize=16)
def _found_in(application: str, name: str, types: tuple[str, ...] | None) -> Column:
    # The expression is large: it is put together once for a column's name and an application.
    text, parts = F.col(name), _parts(types)
    literals = {h for _, _, _, hints, _ in parts.patterns for h in hints or []} | {w for _, table, _ in parts.words for w in table}
    present = _present_in(sorted({piece for h in literals for piece in _pieces(h)}))
    hints = lambda has: F.struct(has.alias("literals"), F.rlike(text, F.lit(r"\p{Nd}")).alias("digit"))
    return let(let(present(lowered(text)), hints), lambda h: _found_with(text, h, parts))


def found(name: str = "text", types: list[str] | None = None) -> Column:
    """array of every quasi-identifier found in the column named (of these types only), in order of detection: qi_type, value, start, end, confidence,
    granularity, unseen, detector, ord; null for a null text."""
    return _found_in(SparkSession.getActiveSession().sparkContext.applicationId, name, None if types is None else tuple(types))


def _some(literals: Column, hints: list[str]) -> Column:
    """Whether the text may have one of the hints: all pieces of it are among the literals that the text has."""
    out = F.arrays_overlap(literals, F.array(*(F.lit(h) for h in hints if _pieces(h) == [h]))) if any(_pieces(h) == [h] for h in hints) else F.lit(False)
    for h in hints:
        if _pieces(h) != [h]:
            out = out | F.forall(F.array(*map(F.lit, _pieces(h))), lambda p: F.array_contains(literals, p))
    return out


class _Parts:
    """Patterns and word tables in the order of detection, with what each says of its matches."""

    def __init__(self, types: tuple[str, ...] | None):
        self.types, self.patterns, self.words, self.rows = types, [], [], []

    def _row(self, kind: str, confidence: float, granularity: str, detector: str, mode: str, value: str | None) -> int | None:
        self.rows.append((kind, confidence, granularity, detector, mode, value))
        return len(self.rows) - 1 if self.types is None or kind in self.types else None

    def pattern(self, kind: str, pattern: str, group: int, mode: str, confidence: float, granularity: str = "category", hints: list[str] | None = None, only: str | None = None, value: str | None = None, ignore_case: bool = True) -> None:
        """mode: how a match becomes a value; "first" takes the fixed value of the first match alone."""
        k = self._row(kind, confidence, granularity, "regex", mode, value)
        if k is not None:
            self.patterns.append((k, pattern_of(pattern, ignore_case), group, hints, only))

    def table(self, kind: str, values: dict[str, str], confidence: float, granularity: str, detector: str, first: bool = False) -> None:
        k = self._row(kind, confidence, granularity, detector, "word", None)
        if k is not None:
            self.words.append((k, values, first))


def _parts(types: tuple[str, ...] | None) -> _Parts:
    out = _Parts(types)
    for p in fixed.AGE:
        out.pattern("age", p, 1, "age", 0.9, "5yr_bucket", _AGE, "digit")
    for p, hints in zip(fixed.SEX, _SEX, strict=True):
        out.pattern("sex", p, 1, "sex", 0.85, hints=hints)
    out.pattern("marital_status", fixed.MARITAL, 1, "marital", 0.82, hints=_MARITAL)
    out.pattern("marital_status", fixed.SPOUSE, 0, "fixed", 0.8, hints=_SPOUSE, value="married")
    for p, value in fixed.CITIZENSHIP:
        out.pattern("citizenship", p, 0, "fixed", 0.85, hints=_CITIZEN, value=value)
    out.pattern("race", fixed.RACE, 1, "race", 0.78, hints=_RACE)
    out.table("state", fixed.STATES, 0.88, "state", "gazetteer")
    out.pattern("state", fixed.STATE_CODE, 1, "code", 0.75, "state", only="capitals", ignore_case=False)
    out.table("occupation", fixed.OCCUPATIONS, 0.8, "occupation_broad", "keyword", first=True)
    for p, hints in zip(fixed.DATES, _DAY_HINTS, strict=True):
        out.pattern("date", p, 0, "match", 0.85, "full_date", hints, "digit")
    for p, hints in zip(fixed.TIMES, _TIME_HINTS, strict=True):
        out.pattern("time", p, 0, "match", 0.8, "time", hints, None if hints[0] == "noon" else "digit")
    for p in fixed.STAMP_FORMS:
        out.pattern("datetime", p, 0, "match", 0.9, "datetime", [":"], "digit")
    for term in fixed.RARE_OCCUPATIONS:
        out.table("occupation", {term: term}, 0.85, "specific", "gazetteer")
    for term in fixed.RARE_DISEASES:
        out.table("condition", {term: term.replace(" ", "_").replace("-", "_")}, 0.85, "category", "gazetteer")
    for (p, value), hints in zip(fixed.EDUCATION, _EDUCATION, strict=True):
        out.pattern("education", p, 0, "first", 0.8, hints=hints, value=value)
    for (p, value), hints in zip(fixed.EMPLOYMENT, _EMPLOYMENT, strict=True):
        out.pattern("employment", p, 0, "first", 0.82, hints=hints, value=value)
    return out


def _found_with(text: Column, seen: Column, parts: _Parts) -> Column:
    column = lambda j: F.array(*(F.lit(r[j]) for r in parts.rows))
    kinds, confidences, granularities, detectors, modes, values = map(column, range(6))
    lower = lambda s: F.lower(s["group"])

    def value(s: Column) -> Column:
        mode, group = F.get(modes, s["k"]), s["group"]
        years = F.when(mode == "age", group).cast("int")
        bucket = F.when(years <= 120, F.concat((F.floor(years / 5) * 5).cast("string"), F.lit("-"), (F.floor(years / 5) * 5 + 4).cast("string")))
        return (
            F.when(mode == "fixed", F.get(values, s["k"])).when((mode == "first") & (s["i"] == 0), F.get(values, s["k"])).when(mode == "age", bucket).when(mode == "sex", _literal_map(fixed.SEX_VALUES)[lower(s)])
            .when(mode == "marital", _literal_map(fixed.MARITAL_VALUES)[lower(s)]).when(mode == "race", F.coalesce(_literal_map(fixed.RACE_VALUES)[lower(s)], F.replace(lower(s), F.lit(" "), F.lit("_"))))
            .when((mode == "code") & group.isin(sorted(set(fixed.STATES.values()))), group).when(mode == "word", group).when(mode == "match", s["value"])
        )

    def row(s: Column) -> Column:
        unseen = (F.get(modes, s["k"]) == "race") & lower(s).isin(fixed.RACE_UNSEEN)
        named = {"qi_type": F.get(kinds, s["k"]), "value": value(s), "start": s["start"], "end": s["end"], "confidence": F.get(confidences, s["k"]), "granularity": F.get(granularities, s["k"]), "unseen": unseen, "detector": F.get(detectors, s["k"])}
        return F.struct(*(c.alias(n) for n, c in named.items()), F.struct(s["k"].alias("pattern"), s["i"].alias("match")).alias("ord")).cast(_FOUND)

    guards = {"digit": seen["digit"], "capitals": F.rlike(text, F.lit("[A-Z][A-Z]"))}

    def guard(hints: list[str] | None, only: str | None) -> Column:
        cheap = F.lit(True) if hints is None else _some(seen["literals"], hints)
        return cheap if only is None else guards[only] & cheap

    # Words and what they stand for, sought in the lower-cased text: one table for all.
    words = [(k, i, w, v, first) for k, table, first in parts.words for i, (w, v) in enumerate(table.items())]

    def place(x: Column, plain: Column) -> Column:
        at = F.position(x["w"], plain)
        return F.struct(x["k"].alias("k"), x["i"].alias("i"), (at - 1).alias("start"), (at - 1 + F.length(x["w"])).alias("end"), x["w"].alias("value"), x["v"].alias("group")).cast(HIT_SPAN)

    def word_spans(plain: Column) -> Column:
        table = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(i).alias("i"), F.lit(w).alias("w"), F.lit(max(_pieces(w), key=len)).alias("piece"), F.lit(v).alias("v"), F.lit(first).alias("first")) for k, i, w, v, first in words))
        there = F.filter(table, lambda x: F.array_contains(seen["literals"], x["piece"]) & F.contains(plain, x["w"]))
        # Of a table that gives one value the first word counts.
        least = lambda rows: F.filter(rows, lambda x, i: ~x["first"] | (i == F.array_position(F.transform(rows, lambda y: y["first"]), True) - 1))
        return F.transform(let(there, least), lambda x: place(x, plain))

    spans = hit_spans(hits(text, [(k, p, g, guard(hints, only)) for k, p, g, hints, only in parts.patterns]))
    both = F.concat(spans, let(F.lower(text), word_spans)) if words else spans
    rows = F.filter(F.transform(both, row), lambda x: x["value"].isNotNull())
    in_order = F.array_sort(F.transform(rows, lambda x: F.struct(x["ord"].alias("ord"), x.alias("x"))))
    return F.transform(in_order, lambda y: y["x"])


def detect(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """doc_id, qi_type, value, start, end, confidence, granularity, unseen, detector, ord for every quasi-identifier found (of these types only)."""
    rows = docs.select("doc_id", F.explode_outer(found("text", types)).alias("q")).select("doc_id", "q.*")
    return rows.where("qi_type is not null")


def deduplicated(rows: Column) -> Column:
    """The first of each type and value of found(), within the row; the largest confidence; the detectors that agree (sorted)."""
    names = ["qi_type", "value", "start", "end", "granularity", "unseen", "detector"]
    kinds = "struct<t:string,v:string,i:int,x:" + _FOUND + ",confidence:double,detectors:array<string>>"
    entry = lambda t, v, i, x, c, d: F.struct(t.alias("t"), v.alias("v"), i.alias("i"), x.alias("x"), c.alias("confidence"), d.alias("detectors"))
    keyed = F.transform(rows, lambda x, i: entry(x["qi_type"], x["value"], i, x.cast(_FOUND), x["confidence"], F.array(x["detector"])).cast(kinds))
    same = lambda cur, x: (cur["t"] == x["t"]) & (cur["v"] == x["v"])
    join = lambda cur, x: entry(cur["t"], cur["v"], cur["i"], cur["x"], F.greatest(cur["confidence"], x["confidence"]), F.array_union(cur["detectors"], x["detectors"]))
    # Equal types and values come together, the first found first.
    once = fold(F.array_sort(keyed), kinds, lambda x: x, same, join)
    in_order = F.array_sort(F.transform(once, lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"), e["confidence"].alias("confidence"), F.array_sort(F.array_except(e["detectors"], F.array(e["x"]["detector"]))).alias("agreement"))))
    return F.transform(in_order, lambda e: F.struct(*(e["x"][n].alias(n) for n in names), e["confidence"].alias("confidence"), e["agreement"].alias("agreement")))


def asserted(rows: Column, text: Column) -> Column:
    """rows with assertion: negated if a negation stands in the 50 characters before the value's first place in the text."""

    def one(x: Column, low: Column) -> Column:
        def marked(at: Column) -> Column:
            before = F.substring(low, F.greatest(F.lit(1), at - 50), F.least(F.lit(50), at - 1))
            return x.withField("assertion", F.when((at > 1) & F.rlike(before, F.lit(pattern_of(fixed.NEGATION))), "negated").otherwise("present"))

        return let(F.instr(low, F.replace(F.lower(x["value"]), F.lit("_"), F.lit(" "))), marked)

    return let(F.lower(text), lambda low: F.transform(rows, lambda x: one(x, low)))


def identify(docs: DataFrame, types: list[str] | None = None) -> DataFrame:
    """docs with qi: an array of what was found, without repeats and with assertions.  Null and repeated ids don't matter: each row is worked off by itself."""
    text, none = F.col("text"), F.array().cast(f"array<{_FOUND}>")
    return docs.withColumn("qi", let(F.coalesce(found("text", types), none), lambda rows: asserted(deduplicated(rows), text)))


def key_parts(qi: Column) -> Column:
    """array<struct<t, v>> of what is asserted, by type: the last value of each type, but empty ones."""

    def parts(own: Column) -> Column:
        types = F.array_sort(F.array_distinct(F.transform(own, lambda x: x["qi_type"])))
        return F.transform(types, lambda t: F.struct(t.alias("t"), F.element_at(F.filter(own, lambda x: x["qi_type"] == t), -1)["value"].alias("v")))

    return let(F.filter(qi, lambda x: (x["assertion"] == "present") & (x["value"] != "")), parts)
