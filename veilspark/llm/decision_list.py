"""Quality rules: features of texts, and decision lists learned by sequential covering, with DataFrame functions only.

A rule is a conjunction of thresholds.  Rules are grown one threshold at a time by information gain on two thirds of the
labelled rows, pruned on the rest, and kept while they stay precise there; what a rule covers is taken out before the next is
grown.  Each step is one small aggregation of binned features; the list becomes ordered conditional expressions.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, materialise

WINDOW = 8
FEATURES = ["word_length", "symbols_per_word", "marks_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share", "words_per_line"]


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeat_words(words: Column) -> Column:
    """Words in windows of WINDOW words that occur twice or more in the text, the first ones included."""

    def covered(windows: Column) -> Column:
        # Windows by hash and place; those next to an equal one in this order are repeated.
        ordered = F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        same = lambda a, b: F.coalesce(a["h"] == b["h"], F.lit(False))
        places = _let(ordered, lambda s: F.filter(F.transform(s, lambda x, i: F.when(same(F.get(s, i - 1), x) | same(F.get(s, i + 1), x), x["i"])), lambda x: x.isNotNull()))
        start = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        add = lambda acc, p: F.struct((p + WINDOW).alias("end"), (acc["n"] + p + WINDOW - F.greatest(p, acc["end"])).alias("n"))
        return F.aggregate(F.array_sort(places), start, add, lambda acc: acc["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW))))
    count = lambda h: _let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0).cast("long")))
    return _let(hashes, lambda h: F.when(F.size(h) > WINDOW, count(h)).otherwise(F.lit(0).cast("long")))


def text_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts of each whole text, and FEATURES.  A null text is empty; its shares are 0."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    count = lambda pattern: F.regexp_count(F.col("_t"), F.lit(pattern)).cast("long")
    # One struct of what needs the words or lines, so that each array is built once.
    words = F.filter(F.split("_t", SPACE + "+"), lambda w: w != "")
    lines = F.filter(F.split("_t", "\n"), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]")))
    by_word = _let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    by_line = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("_t")).select(
        "doc_id", by_word.alias("w"), by_line.alias("l"), (F.length("_t") - count(SPACE)).cast("long").alias("word_chars"), count(r"[#*$%&|<>]").alias("n_symbols"),
        count(r"[!?]").alias("n_marks"), count(r"[\p{Lu}]").alias("n_upper"), count("[0-9]").alias("n_digits"),
    )
    flat = rows.select("doc_id", "w.*", "l.*", "word_chars", "n_symbols", "n_marks", "n_upper", "n_digits")
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return flat.select(
        "*", share("word_chars", "n_words").alias("word_length"), share("n_symbols", "n_words").alias("symbols_per_word"), share("n_marks", "n_words").alias("marks_per_word"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"), share("n_upper", "word_chars").alias("upper_share"), share("n_digits", "word_chars").alias("digit_share"), share("n_words", "n_lines").alias("words_per_line"),
    )


class Test(NamedTuple):
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        return F.col(self.feature) >= self.threshold if self.above else F.col(self.feature) <= self.threshold


class Rule(NamedTuple):
    tests: tuple[Test, ...]
    precision: float

    def holds(self) -> Column:
        out = F.lit(True)
        for t in self.tests:
            out = out & t.holds()
        return out


def _thresholds(rows: DataFrame, features: list[str], cuts: list[float]) -> dict[str, list[float]]:
    """Quantiles of each feature in either class, as candidate thresholds: a bounded list for each feature."""
    found = rows.groupBy("bad").agg(*(F.percentile_approx(f, cuts, 1000).alias(f) for f in features)).collect()
    return {f: sorted({float(x) for r in found for x in r[f] or []}) for f in features}


def _bins(rows: DataFrame, features: list[str], cuts: dict[str, list[float]]) -> list:
    """Per feature and bin (the number of thresholds up to the value, those equal to it counted apart): bad and good rows."""
    parts = []
    for f in features:
        n = sum((F.when(F.col(f) >= t, 1).otherwise(0) for t in cuts[f]), F.lit(0))
        equal = F.col(f).isin(cuts[f]) if cuts[f] else F.lit(False)
        parts.append(F.struct(F.lit(f).alias("f"), n.alias("bin"), equal.alias("eq")))
    return rows.select("bad", F.explode(F.array(*parts)).alias("x")).groupBy("x.f", "x.bin", "x.eq").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()


def _candidates(counts: list, cuts: dict[str, list[float]]) -> list[tuple[Test, int, int]]:
    out = []
    for f, thresholds in cuts.items():
        own = [r for r in counts if r["f"] == f]
        for k, t in enumerate(thresholds, 1):
            up = [(r["p"], r["n"]) for r in own if r["bin"] >= k]
            down = [(r["p"], r["n"]) for r in own if r["bin"] < k or (r["bin"] == k and r["eq"])]
            out += [(Test(f, above, t), sum(x[0] for x in side), sum(x[1] for x in side)) for above, side in ((True, up), (False, down))]
    return out


def learn(labelled: DataFrame, features: list[str] | None = None, max_rules: int = 6, max_tests: int = 3, least: int = 5, precision: float = 0.95) -> list[Rule]:
    """Rules for bad rows (``labelled`` has features and bad, 0 or 1, without nulls), in order.  Too few labels: no rules."""
    features = features or FEATURES
    rows = labelled.withColumn("_grow", F.pmod(F.xxhash64("doc_id", F.lit("grow")), F.lit(3)) != 0)
    cuts = _thresholds(rows, features, [0.01, 0.05, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999])
    rules: list[Rule] = []
    while len(rules) < max_rules:
        tests: list[Test] = []
        here = rows.where("_grow")
        before: tuple[int, int] | None = None
        while len(tests) < max_tests:
            counts = _bins(here, features, cuts)
            p0, n0 = before or (sum(r["p"] for r in counts if r["f"] == features[0]), sum(r["n"] for r in counts if r["f"] == features[0]))
            if p0 < least or n0 == 0:
                break
            bits = lambda p, n: math.log2(p / (p + n))
            gains = [(p * (bits(p, n) - bits(p0, n0)), -n, t, p, n) for t, p, n in _candidates(counts, cuts) if p >= least and (p, n) != (p0, n0)]
            if not gains or max(gains)[0] <= 0:
                break
            _, _, best, *before = max(gains)
            before = tuple(before)
            tests.append(best)
            here = here.where(best.holds())
        if not tests:
            break
        # Pruning: the shortest beginning of the rule that is as precise as any on rows it wasn't grown on.
        starts = [Rule(tuple(tests[:k]), 0.0) for k in range(1, len(tests) + 1)]
        found = rows.where(~F.col("_grow")).agg(*(c for s in starts for c in (F.count_if(s.holds() & (F.col("bad") == 1)), F.count_if(s.holds())))).first()
        scored = [(found[2 * k], found[2 * k + 1]) for k in range(len(starts))]
        worth = [(p + 1) / (n + 2) for p, n in scored]
        k = max(range(len(starts)), key=lambda i: (worth[i], -i))
        p, n = scored[k]
        if n == 0 or p / n < precision:
            break
        rule = Rule(starts[k].tests, p / n)
        rules.append(rule)
        rows = rows.where(~rule.holds())
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The number of the first rule that holds (from 1), or 0: a chain of conditions in order."""
    out: Column | None = None
    for i, rule in enumerate(rules, 1):
        out = F.when(rule.holds(), i) if out is None else out.when(rule.holds(), i)
    return F.lit(0) if out is None else out.otherwise(0)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = 50_000, label_col: str = "quality") -> DataFrame:
    """doc_id, counts, FEATURES, base_failed, rule (the first that holds, or 0) and kept.

    Rules are learned from at most ``sample`` labelled documents, chosen by hash; an id with several labels counts as bad if one is
    0; null labels and ids aren't used.  base_failed: fewer than 20 words, or over 30 of 100 of them in repeated windows.
    Rows that repeat get the same verdict.  An empty table gives an empty result.
    """
    rows = materialise(text_features(docs), "rules-features")
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label_col).isNotNull()).groupBy("doc_id").agg((1 - F.min(label_col)).cast("int").alias("bad"))
    ids = ids.orderBy(F.xxhash64("doc_id", F.lit("rules")), "doc_id").limit(sample)
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    # What the base rejects needs no rule.
    labelled = materialise(rows.where(~base_failed).join(ids, "doc_id").select("doc_id", "bad", *FEATURES), "rules-sample")
    out = rows.withColumn("base_failed", base_failed).withColumn("rule", verdict(learn(labelled)))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
