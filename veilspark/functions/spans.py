"""Regex spans as column expressions: all matches of a pattern with their places, without leaving the JVM.

Patterns follow Unicode rules: ``(?U)`` in front, ``(?iuU)`` where case doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pattern_of(pattern: str, ignore_case: bool = True) -> str:
    return ("(?iuU)" if ignore_case else "(?U)") + pattern


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often it stands there and wherever the optimizer moves the expression."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lowered(text: Column) -> Column:
    """The text in lower case, with the long s, which matches s where case doesn't matter, as s: what hints are sought in."""
    return F.replace(F.lower(text), F.lit("\u017f"), F.lit("s"))


#: Arrays grow in blocks of so many elements: what is there already is copied once a block, not once an element.
BLOCK = 256


def blocks(items: Column) -> Column:
    """The items in slices of BLOCK, in order; one empty slice without items."""
    return let(items, lambda x: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int"))), lambda b: F.slice(x, b * BLOCK + 1, BLOCK)))


def scan(items: Column, carried: Column, element: str, step) -> Column:
    """struct<at, out> after all items in order: step(at, item) gives what is carried on, and a new element of out (array<element>) or null."""
    empty = F.array().cast(f"array<{element}>")
    state = lambda at, out: F.struct(at.alias("at"), out.alias("out"))

    def one(acc: Column, x: Column) -> Column:
        at, new = step(acc["at"], x)
        return let(new, lambda n: state(at, F.when(n.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], n))))

    def block(acc: Column, part: Column) -> Column:
        return let(F.aggregate(part, state(acc["at"], empty), one), lambda d: state(d["at"], F.concat(acc["out"], d["out"])))

    return F.aggregate(blocks(items), state(carried, empty), block)


def fold(items: Column, element: str, fresh, meets, join) -> Column:
    """array<element>: items in order, where one that meets(last element, item) is joined into it; else it begins one with fresh(item)."""
    none = F.lit(None).cast(element)

    def step(cur: Column, x: Column) -> tuple[Column, Column]:
        joins = F.coalesce(cur.isNotNull() & meets(cur, x), F.lit(False))
        return F.when(joins, join(cur, x).cast(element)).otherwise(fresh(x).cast(element)), F.when(joins, none).otherwise(cur)

    return let(scan(items, none, element, step), lambda d: F.when(d["at"].isNull(), d["out"]).otherwise(F.array_append(d["out"], d["at"])))


HIT = "struct<k:int,gaps:array<string>,values:array<string>,groups:array<string>>"
HIT_SPAN = "struct<k:int,i:int,start:int,end:int,value:string,group:string>"


def hits(text: Column, patterns: list[tuple[int, str, int, Column | None]]) -> Column:
    """array<HIT>: each pattern (number, pattern, group, guard) that matches, with its matches and what lies between them.  A null guard is false, none true."""

    def one(k: int, pattern: str, group: int, guard: Column | None) -> Column:
        def hit(values: Column) -> Column:
            groups = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else values
            return F.when(F.size(values) > 0, F.struct(F.lit(k).alias("k"), F.split(text, pattern, -1).alias("gaps"), values.alias("values"), groups.alias("groups")).cast(HIT))

        # A text without a match is searched once, one with matches twice (a third time for a group).
        found = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), hit)
        return found if guard is None else F.when(guard, found)

    return F.array_compact(F.array(*(one(*p) for p in patterns))) if patterns else F.array().cast(f"array<{HIT}>")


def hit_spans(found: Column) -> Column:
    """array<HIT_SPAN> of hits(): all matches with their places in code points (end exclusive), by pattern, in order.

    The gaps between the matches give their places.  One expression serves all patterns, however many there are.
    """

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at["pos"] + F.length(x["gaps"])
        end = start + F.length(x["values"])
        new = F.struct(x["k"].alias("k"), at["i"].alias("i"), start.alias("start"), end.alias("end"), x["values"].alias("value"), x["groups"].alias("group")).cast(HIT_SPAN)
        return F.struct(end.alias("pos"), (at["i"] + 1).alias("i")), new

    def places(h: Column) -> Column:
        rows = F.transform(F.arrays_zip(h["gaps"].alias("gaps"), h["values"].alias("values"), h["groups"].alias("groups")), lambda x: F.struct(h["k"].alias("k"), x["gaps"].alias("gaps"), x["values"].alias("values"), x["groups"].alias("groups")))
        return scan(F.filter(rows, lambda x: x["values"].isNotNull()), F.struct(F.lit(0).alias("pos"), F.lit(0).alias("i")), HIT_SPAN, step)["out"]

    return F.flatten(F.transform(found, places))


def replace_spans(text: Column, spans: Column) -> Column:
    """The text with spans (start, end, label; ordered, not overlapping) replaced by their labels.  Each block of spans takes its stretch of the text once."""

    def stretch(part: Column, chunk: Column) -> Column:
        first = F.get(part, F.lit(0))["at"]
        return F.array_join(F.transform(part, lambda x: F.concat(F.substring(chunk, x["at"] - first + 1, x["start"] - x["at"]), x["label"])), "")

    def cut(part: Column) -> Column:
        first = F.get(part, F.lit(0))["at"]
        return let(F.substring(text, first + 1, F.element_at(part, -1)["end"] - first), lambda chunk: stretch(part, chunk))

    with_gaps = let(spans, lambda all_: F.transform(all_, lambda s, i: F.struct(F.coalesce(F.get(all_, i - 1)["end"], F.lit(0)).alias("at"), s["start"].alias("start"), s["end"].alias("end"), s["label"].alias("label"))))
    pieces = F.transform(blocks(with_gaps), cut)
    tail = let(spans, lambda all_: F.substring(text, F.element_at(all_, -1)["end"] + 1, F.length(text)))
    return F.when(F.size(spans) > 0, F.concat(F.array_join(pieces, ""), tail)).otherwise(text)
