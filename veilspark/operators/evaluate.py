"""Evaluation of routed texts: summaries, simulators over parameter grids, choices among operating points."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.fixed import BASELINE


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def joint_risk(k_lower: Column) -> Column:
    return F.when(k_lower.isNull() | (k_lower == 0) | (k_lower == float("inf")), 0.0).otherwise(F.least(F.lit(1.0), 1 / k_lower))


def direct_or_all(direct: Column, identifiers: Column) -> Column:
    """How many direct identifiers a result counts: where there are none, all identifiers stand for them.  Null counts are 0."""
    return F.coalesce(F.nullif(F.coalesce(direct, F.lit(0)), F.lit(0)), identifiers, F.lit(0))


def summary(results: DataFrame) -> DataFrame:
    """One row: tiers, rates over all rows, finite k, from expected, tier, llm_used, k_lower."""
    n, critical, local = F.count("*"), F.col("expected"), F.col("tier") == 3
    finite = F.when(~F.isnan("k_lower") & (F.col("k_lower") < float("inf")), F.col("k_lower"))
    rate = lambda c: ratio(F.count_if(c), n)
    return results.agg(
        n.alias("n"), *(F.count_if(F.col("tier") == t).alias(f"tier_{t}") for t in (1, 2, 3)), rate(critical & ~local).alias("false_cloud_rate"), rate(~critical & local).alias("over_censor_rate"), rate(F.col("llm_used")).alias("llm_rate"),
        F.coalesce(F.avg(finite), F.lit(0.0)).alias("mean_k"), F.coalesce(F.percentile(finite, 0.5), F.lit(0.0)).alias("median_k"), *(F.coalesce(F.avg(F.when(F.col("tier") == t, finite)), F.lit(0.0)).alias(f"mean_k_{t}") for t in (1, 2, 3)),
    )


def correlations(results: DataFrame, features: list[str]) -> DataFrame:
    """feature, correlation with expected (0 where one of the two doesn't vary or there are fewer than 2 rows), largest absolute value first."""
    y = F.col("expected").cast("double")
    one = lambda f: F.when(F.count("*") < 2, 0.0).otherwise(ratio(F.covar_pop(F.col(f).cast("double"), y), F.stddev_pop(F.col(f).cast("double")) * F.stddev_pop(y)))
    return results.agg(*(one(f).alias(f) for f in features)).unpivot([], features, "feature", "correlation").orderBy(F.desc(F.abs("correlation")), "feature")


def normalise(results: DataFrame, least: float = 1.0) -> DataFrame:
    """results with direct_norm and quasi_norm: counts over their maxima (at least ``least``; with least 0 and a maximum of 0: 0)."""
    top = results.agg(F.greatest(F.max("direct"), F.lit(least)).alias("_d"), F.greatest(F.max("quasi"), F.lit(least)).alias("_q"))
    return results.crossJoin(F.broadcast(top)).withColumn("direct_norm", ratio(F.col("direct"), F.col("_d"))).withColumn("quasi_norm", ratio(F.col("quasi"), F.col("_q"))).drop("_d", "_q")


def frange(start: float, stop: float, step: float) -> list[float]:
    return [round(start + i * step, 10) for i in range(int((stop - start) / step + 1e-9) + 1)]


def grid(spark: SparkSession, sweeps: dict[str, list[dict]]) -> DataFrame:
    """sweep, point and parameters: one row for each setting, the baseline's values where a sweep doesn't change them."""
    rows = [(name, i, *(float((BASELINE | p)[k]) for k in BASELINE)) for name, points in sweeps.items() for i, p in enumerate(points)]
    return spark.createDataFrame(rows, "sweep string, point int, " + ", ".join(f"{k} double" for k in BASELINE))


def _one(name: str, values: list) -> list[dict]:
    return [{name: v} for v in values]


def default_sweeps() -> dict[str, list[dict]]:
    """Of simulator a: one parameter at a time, the grid of weights, and that of both thresholds."""
    review, block = frange(0.01, 0.49, 0.02), frange(0.50, 0.95, 0.05)
    return {
        "tau_review": _one("tau_review", [x for x in frange(0.01, 0.80, 0.02) if x < BASELINE["tau_block"]]), "tau_block": _one("tau_block", [x for x in frange(0.20, 0.95, 0.05) if x > BASELINE["tau_review"]]),
        "k_min": _one("k_min", list(range(2, 21))), "w_direct": _one("w_direct", frange(0.1, 1.0, 0.1)), "w_quasi": _one("w_quasi", frange(0.1, 1.0, 0.1)),
        "weights": [{"w_direct": a, "w_quasi": b} for a in frange(0.1, 1.0, 0.1) for b in frange(0.1, 1.0, 0.1)],
        "thresholds": [{"tau_review": a, "tau_block": b} for a in review for b in block if a < b],
    }


def threshold_sweeps() -> dict[str, list[dict]]:
    """Of simulator b: one parameter at a time, and the grids of weights, of direct, quasi and global thresholds, and of all together."""
    review, block, safe = frange(0.05, 0.53, 0.02), frange(0.50, 0.95, 0.05), [5, 10, 15, 20, 30, 50, 75, 100, 150, 200, 1000, 10000]
    dr, db, qr, qb, weights = frange(0.05, 0.45, 0.05), frange(0.40, 0.90, 0.05), frange(0.10, 0.50, 0.05), frange(0.50, 0.90, 0.05), frange(0.1, 1.0, 0.1)
    names = ["tau_direct_review", "tau_direct_block", "tau_quasi_review", "tau_quasi_block", "k_safe"]
    every = product([0.10, 0.20, 0.30, 0.40], [0.50, 0.60, 0.70, 0.80], [0.20, 0.30, 0.40], [0.60, 0.70, 0.80], [10, 20, 50, 100])
    return {
        "tau_review": _one("tau_review", review), "tau_block": _one("tau_block", block), "k_min": _one("k_min", list(range(2, 21))), "k_safe": _one("k_safe", safe),
        "tau_direct_review": _one(names[0], dr), "tau_direct_block": _one(names[1], db), "tau_quasi_review": _one(names[2], qr), "tau_quasi_block": _one(names[3], qb),
        "weights": [{"w_direct": a, "w_quasi": b} for a in weights for b in weights],
        "direct_thresholds": [{names[0]: a, names[1]: b} for a in dr[::2] for b in db[::2] if a < b], "quasi_thresholds": [{names[2]: a, names[3]: b} for a in qr[::2] for b in qb[::2] if a < b],
        "thresholds": [{"tau_review": a, "tau_block": b, "k_safe": k} for a in review[::3] for b in block[::2] for k in safe[::2] if a < b],
        "combined": [dict(zip(names, x, strict=True)) for x in every if x[0] < x[1] and x[2] < x[3]],
    }


def strict_sweeps() -> dict[str, list[dict]]:
    """Of simulator c: one parameter at a time; the block threshold with small weights, the minimum k with the lower threshold beside it."""
    taus, ks = frange(0.02, 0.95, 0.05), [5, 10, 15, 20, 30, 50, 75, 100, 150, 200]
    return {
        "tau_review": _one("tau_review", [x for x in taus if x < BASELINE["tau_block"]]), "tau_block": [{"tau_block": x, "w_direct": 0.2, "w_quasi": 0.2} for x in taus if x > BASELINE["tau_review"]],
        "k_min_strict": [{"k_min": k, "k_safe": k} for k in ks], "k_lower_threshold": _one("k_safe", [k for k in ks if k >= BASELINE["k_min"]]),
        "w_direct": _one("w_direct", frange(0.1, 1.0, 0.1)), "w_quasi": _one("w_quasi", frange(0.1, 1.0, 0.1)),
    }


SWEEPS = {"a": default_sweeps, "b": threshold_sweeps, "c": strict_sweeps}


def outcome(simulator: str) -> Column:
    """block, review or pass of a row under its setting: simulators a, b, c (c also takes use_pii and use_qi)."""
    risk, k = F.col("joint_risk"), F.col("k_lower")
    d, q, wd, wq = (F.col(c) for c in ("direct_norm", "quasi_norm", "w_direct", "w_quasi"))
    if simulator == "b":
        mixed = (risk + wd * d + wq * q) / (1 + wd + wq)
        return (
            F.when(k < F.col("k_min"), "block").when(d >= F.col("tau_direct_block"), "block").when(q >= F.col("tau_quasi_block"), "block").when(mixed >= F.col("tau_block"), "block")
            .when(d >= F.col("tau_direct_review"), "review").when(q >= F.col("tau_quasi_review"), "review").when(mixed >= F.col("tau_review"), "review").when(k < F.col("k_safe"), "review").otherwise("pass")
        )
    mixed = F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk + wd * d + wq * q))
    chain = F.when((k < F.col("k_min")) | (mixed >= F.col("tau_block")), "block").when(mixed >= F.col("tau_review"), "review")
    return (chain.when(k < F.col("k_safe"), "review") if simulator == "c" else chain).otherwise("pass")


def confusion(results: DataFrame, settings: DataFrame, simulator: str) -> DataFrame:
    """Counts and metrics of every setting.  Rows that no setting can tell apart are counted first; the settings, a table of fixed size, are broadcast.

    ``results`` may have a boolean wiki: texts that should pass; without it there are none.
    """
    key = ["sweep", "point", *BASELINE]
    own = results if "wiki" in results.columns else results.withColumn("wiki", F.lit(False))
    own = own.groupBy("expected", "wiki", "joint_risk", "k_lower", "direct_norm", "quasi_norm").agg(F.count("*").alias("_n"))
    marked = own.crossJoin(F.broadcast(settings)).withColumn("_o", outcome(simulator))
    y, m = F.col("expected"), F.col("_o") != "pass"
    count = lambda ok: F.coalesce(F.sum(F.when(ok, F.col("_n"))), F.lit(0))
    counts = marked.groupBy(*key).agg(
        count(y & m).alias("tp"), count(~y & m).alias("fp"), count(~y & ~m).alias("tn"), count(y & ~m).alias("fn"), count(F.col("_o") == "review").alias("reviews"), count(F.col("_o") == "block").alias("blocks"),
        count(F.col("wiki") & m).alias("wiki_marked"), count(F.col("wiki")).alias("wiki_total"),
    )
    n = F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")
    rates = {"review_rate": ratio(F.col("reviews"), n), "block_rate": ratio(F.col("blocks"), n), "pass_rate": ratio(F.col("tn") + F.col("fn"), n), "wiki_fpr": ratio(F.col("wiki_marked"), F.col("wiki_total"))}
    return metrics(counts).withColumns(rates)


def metrics(counts: DataFrame) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    n = tp + fp + tn + fn
    out = counts.withColumns({"precision": ratio(tp, tp + fp), "recall": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "fpr": ratio(fp, fp + tn), "fnr": ratio(fn, fn + tp), "accuracy": ratio(tp + tn, n), "marked_rate": ratio(tp + fp, n)})
    return out.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("balanced_accuracy", (F.col("recall") + F.col("specificity")) / 2)


def _ablated(results: DataFrame, setting: DataFrame) -> DataFrame:
    """results under each condition (full, no_pii, no_qi, no_detectors) and the setting, with outcome and risk: counts of a detector that is off are 0; with
    both off, risk and k aren't looked at."""
    on = results.sparkSession.createDataFrame([("full", True, True), ("no_pii", False, True), ("no_qi", True, False), ("no_detectors", False, False)], "condition string, use_pii boolean, use_qi boolean")
    off = ~F.col("use_pii") & ~F.col("use_qi")
    rows = results.crossJoin(F.broadcast(on)).withColumns({
        "direct_norm": F.when(F.col("use_pii"), F.col("direct_norm")).otherwise(0.0), "quasi_norm": F.when(F.col("use_qi"), F.col("quasi_norm")).otherwise(0.0),
        "joint_risk": F.when(off, 0.0).otherwise(F.col("joint_risk")), "k_lower": F.when(off, float("inf")).otherwise(F.col("k_lower")),
    })
    risk = F.col("joint_risk") + F.col("w_direct") * F.col("direct_norm") + F.col("w_quasi") * F.col("quasi_norm")
    return rows.crossJoin(F.broadcast(setting)).withColumns({"_o": outcome("c"), "_risk": F.least(F.lit(1.0), F.greatest(F.lit(0.0), risk))})


def ablation(results: DataFrame, setting: DataFrame) -> DataFrame:
    """full, no_pii, no_qi, none: counts and metrics of each condition."""
    y, m = F.col("expected"), F.col("_o") != "pass"
    return metrics(_ablated(results, setting).groupBy("condition").agg(F.count_if(y & m).alias("tp"), F.count_if(~y & m).alias("fp"), F.count_if(~y & ~m).alias("tn"), F.count_if(y & ~m).alias("fn")))


def ablation_rates(results: DataFrame, setting: DataFrame) -> DataFrame:
    """condition, the share of each tier (passed, reviewed, blocked), mean_combined_risk."""
    rate = lambda o: ratio(F.count_if(F.col("_o") == o), F.count("*"))
    return _ablated(results, setting).groupBy("condition").agg(rate("pass").alias("tier_1_rate"), rate("review").alias("tier_2_rate"), rate("block").alias("tier_3_rate"), F.coalesce(F.avg("_risk"), F.lit(0.0)).alias("mean_combined_risk"))


def pareto(points: DataFrame) -> DataFrame:
    """Points that no other one beats in fpr and fnr: a running minimum over fpr instead of comparing all pairs."""
    best = points.groupBy("fpr").agg(F.min("fnr").alias("_least"))
    before = best.withColumn("_before", F.min("_least").over(W.orderBy("fpr").rowsBetween(W.unboundedPreceding, -1)))
    return points.join(before, "fpr").where((F.col("fnr") == F.col("_least")) & (F.col("_before").isNull() | (F.col("fnr") < F.col("_before")))).drop("_least", "_before")


def choose(points: DataFrame) -> DataFrame:
    """One point for each aim; the earliest of equal ones."""
    sure, fpr, recall, fnr, wiki = F.lit(True), F.col("fpr"), F.col("recall"), F.col("fnr"), F.col("wiki_fpr")
    aims = {
        "best_f1": (sure, -F.col("f1")), "best_balanced_accuracy": (sure, -F.col("balanced_accuracy")), "high_recall_fpr_le_15": (fpr <= 0.15, -recall), "high_recall_fpr_le_10": (fpr <= 0.10, -recall),
        "high_recall_wiki_fpr_le_10": (wiki <= 0.10, -recall), "low_fnr_fpr_le_15": (fpr <= 0.15, fnr), "low_fnr_wiki_fpr_le_10": (wiki <= 0.10, fnr),
        "low_wiki_fpr_recall_ge_90": (recall >= 0.90, wiki), "low_wiki_fpr_recall_ge_95": (recall >= 0.95, wiki), "lowest_wiki_fpr": (sure, wiki),
    }
    rows = points.select("*", F.explode(F.filter(F.array(*(F.when(ok, F.struct(F.lit(a).alias("aim"), by.alias("by"))) for a, (ok, by) in aims.items())), lambda x: x.isNotNull())).alias("x"))
    n = F.row_number().over(W.partitionBy("x.aim").orderBy("x.by", "sweep", "point"))
    return rows.withColumn("_n", n).where("_n = 1").select(F.col("x.aim").alias("aim"), "sweep", "point", "f1", "recall", "fpr", "fnr")


def per_k(results: DataFrame, ks: list[int], keep: tuple[str, ...] = ()) -> DataFrame:
    """id, k, tier, and the columns to keep, for each minimum k: local below it, else as the text's identifiers say."""
    rows = results.withColumn("k", F.explode(F.array(*(F.lit(k) for k in ks))))
    return rows.select("id", "k", *keep, F.when(F.col("k_lower").isNull() | (F.col("k_lower") < F.col("k")), 3).when(F.col("direct") > 0, 2).otherwise(1).alias("tier"))


def contributions(ablated: DataFrame, metric: str = "f1") -> DataFrame:
    """What either detector adds to a metric, and what only both together do, from ablation()."""
    m = {c: F.max(F.when(F.col("condition") == c, F.col(metric))) for c in ("full", "no_pii", "no_qi", "no_detectors")}
    pii, qi = m["full"] - m["no_pii"], m["full"] - m["no_qi"]
    both = m["full"] - m["no_pii"] - m["no_qi"] + m["no_detectors"]
    return ablated.agg(m["full"].alias("full"), pii.alias("pii"), qi.alias("qi"), both.alias("interaction"), ratio(100 * pii, m["full"]).alias("pii_pct"), ratio(100 * qi, m["full"]).alias("qi_pct"))
