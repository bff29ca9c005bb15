"""Routing: text features, gate, hard stops, tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed

#: As they stand in the published rules; values of conditions are joined by underscores, so the first never meets one.
RARE_CONDITIONS = ["ehlers-danlos", "huntington", "marfan"]
RARE_OCCUPATIONS = ["zoologist", "astronomer", "epidemiologist"]
#: What a masked identifier is taken to be long.
MASK_LENGTH = 15
BOUNDS = ["conservative_bound", "pairwise_min_bound", "min_marginal_bound"]


def text_features(text: Column) -> list[Column]:
    words = F.size(F.filter(F.split(text, r"(?U)\s+"), lambda x: x != ""))
    return [F.length(text).alias("text_length"), words.alias("word_count"), F.regexp_count(text, F.lit("[.!?]")).alias("sentence_count")]


def features(docs: DataFrame) -> DataFrame:
    """docs (text, pii: merged spans, qi: quasi-identifiers) with the gate's features: counts by category, dates, rare values, masking."""
    number = lambda c: F.size(F.filter("pii", lambda e: e["category"] == c))
    of_type = lambda t, ok: F.exists("qi", lambda q: (q["qi_type"] == t) & ok(q["value"]))
    rare = lambda v: F.exists(F.array(*map(F.lit, RARE_CONDITIONS)), lambda t: F.contains(F.lower(v), t))
    own = docs.select("*", *text_features(F.col("text"))).withColumns({
        "pii_count": F.size("pii"), "direct_count": number("direct_identifier"), "strong_count": number("strong_identifier"), "contextual_count": number("contextual"),
        "qi_count": number("quasi_identifier") + F.size("qi"), "qis_found": F.size("qi"), "date_count": F.size(F.filter("qi", lambda q: q["qi_type"] == "date")),
        "rare_disease": of_type("condition", rare), "rare_occupation": of_type("occupation", lambda v: F.lower(v).isin(RARE_OCCUPATIONS)), "has_unseen": F.exists("qi", lambda q: q["unseen"] & (q["assertion"] == "present")),
        "disagreement": F.lit(False),
    })
    own = own.withColumn("mask_count", F.col("direct_count") + F.col("strong_count")).withColumn("rare", F.col("rare_disease") | F.col("rare_occupation"))
    return own.withColumn("mask_ratio", F.when(F.col("text_length") > 0, F.least(F.lit(1.0), F.col("mask_count") * float(MASK_LENGTH) / F.col("text_length"))).otherwise(0.0))


def uncertainty_flags() -> Column:
    """What a decision rests on that isn't sure; none if a hard stop was made."""
    flag = lambda ok, name: F.when(F.coalesce(ok, F.lit(False)), name)
    flags = F.array_compact(F.array(flag(F.col("k_lower").isNull(), "k_estimate_unavailable"), flag(F.col("has_unseen"), "unseen_qi_values"), flag(F.col("llm_invoked") & F.col("model_flag").isNull(), "llm_abstained")))
    return F.when(F.size("hard_stop_reasons") > 0, F.array().cast("array<string>")).otherwise(flags)


def _setting(x: Column | str | int | bool) -> Column:
    """A setting for all rows, or the name of the column that holds each row's own."""
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def gate(k_min: Column | str | int = 5, k_safe: Column | str | int = 20, require_joint: Column | str | bool = True) -> Column:
    """SAFE, UNSAFE or UNCERTAIN from k_lower (null: no estimate), date_count, qi_count, contextual_count, word_count, disagreement, rare.

    Settings are values, or names of columns where each row has its own policy.
    """
    k, uncertain = F.col("k_lower"), F.lit("UNCERTAIN")
    density = (F.col("qi_count") + F.col("contextual_count")) / F.greatest(F.col("word_count"), F.lit(1))
    return (
        F.when(k < _setting(k_min), "UNSAFE").when(k.isNull() & _setting(require_joint), "UNSAFE").when(F.col("date_count") >= 3, uncertain).when((F.col("qi_count") >= 5) & k.isNull(), uncertain)
        .when(density > 0.1, uncertain).when(F.col("disagreement"), uncertain).when(k >= _setting(k_safe), "SAFE").when((F.col("qi_count") <= 2) & ~F.col("rare"), "SAFE").otherwise(uncertain)
    )


def hard_stops(k_min: Column | str | int = 5, require_joint: Column | str | bool = True, residual: Column | None = None) -> Column:
    """Reasons to keep a text local whatever the gate says; ``residual``: how many direct identifiers its masked form still holds."""
    least = _setting(k_min)
    shown = F.when(residual > 0, F.format_string("%d direct identifiers left unmasked", residual)) if residual is not None else F.lit(None).cast("string")
    low = F.when((F.col("k_lower") < least) & (F.col("method") == "empirical_joint"), F.format_string("k_lower %.1f below %d", F.col("k_lower"), least))
    none = F.when(F.col("k_lower").isNull() & _setting(require_joint), "no joint estimate")
    return F.array_compact(F.array(shown, low, none))


def route(features: DataFrame, k_min: Column | str | int = 5, k_safe: Column | str | int = 20, require_joint: Column | str | bool = True, model=None) -> DataFrame:
    """features with hard_stop_reasons, gate_decision and tier (1 as it is, 2 masked, 3 local).

    Settings are values or names of columns.  A column residual_count, if there is one, is how many direct identifiers the masked text
    still holds.  Only texts whose gate is uncertain, and that no hard stop holds, go to ``model``, a function from a DataFrame to it
    with a boolean model_flag; without a model, and where it abstains (null), the flag is false and the text is masked.
    """
    residual = F.col("residual_count") if "residual_count" in features.columns else None
    f = features.withColumn("hard_stop_reasons", hard_stops(k_min, require_joint, residual)).withColumn("_gate", gate(k_min, k_safe, require_joint))
    weak = (F.col("_gate") == "UNSAFE") & F.col("method").isin(BOUNDS) & (F.col("k_lower") < _setting(k_min))
    f = f.withColumn("gate_decision", F.when(weak, "UNCERTAIN").otherwise(F.col("_gate"))).drop("_gate")
    ask = (F.size("hard_stop_reasons") == 0) & (F.col("gate_decision") == "UNCERTAIN")
    f = f.withColumn("llm_invoked", ask if model else F.lit(False))
    if model:
        f = model(f.where(ask)).unionByName(f.where(~ask).withColumn("model_flag", F.lit(False)))
    else:
        f = f.withColumn("model_flag", F.lit(False))
    uncertain = F.when(F.coalesce("model_flag", F.lit(False)), 3).otherwise(2)
    tier = F.when(F.size("hard_stop_reasons") > 0, 3).when(F.col("gate_decision") == "SAFE", F.when(F.col("pii_count") > 0, 2).otherwise(1)).when(F.col("gate_decision") == "UNSAFE", 3).otherwise(uncertain)
    return f.withColumn("tier", tier)


def prompt(masked: Column) -> Column:
    """What a model is asked about a masked text: the factors, the form of the answer, the text."""
    head, tail = fixed.PROMPT.split("{text}")
    return F.concat(F.lit(head.replace("{factors}", "\n".join(f"- {n}: {d}" for n, d in fixed.FACTORS.items()))), F.coalesce(masked, F.lit("")), F.lit(tail))


def model_flag(answer: Column, least: float = 0.7) -> Column:
    """Whether a model's answer (parse_answer() of the names of FACTORS) says that a text gives somebody away: any factor but an unusual
    event, or that one with a confidence above ``least``.  Null (abstention) without an answer or if it can't be parsed."""
    names = list(fixed.FACTORS)
    says = lambda n: answer[n]["detected"]
    some = says(names[0]) & (answer[names[0]]["confidence"] > least)
    for n in names[1:]:
        some = some | says(n)
    return F.when(answer.isNotNull() & answer["parsed"], some)


def asked(answers, text: str = "masked"):
    """A model for route(): ``answers`` is a function from a DataFrame to it with a column answer, for which it finds a column prompt."""

    def model(rows: DataFrame) -> DataFrame:
        said = answers(rows.withColumn("prompt", prompt(F.col(text))))
        return said.withColumn("model_flag", model_flag(parse_answer(F.col("answer"), list(fixed.FACTORS)))).drop("prompt", "answer")

    return model


#: The model's answer, by fixed names.
FACTOR = "struct<detected:variant,confidence:variant>"


def parse_answer(answer: Column, names: list[str]) -> Column:
    """struct<parsed, overall, factors> of a JSON answer: from the first brace to the last; a factor that isn't a boolean is false, confidence is cut to 0..1."""
    tree = F.try_parse_json(F.regexp_extract(answer, r"(?s)\{.*\}", 0))
    number = lambda path: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_variant_get(tree, path, "double"), F.lit(0.0))))
    flag = lambda n: F.coalesce(F.when(F.schema_of_variant(F.try_variant_get(tree, f"$.factors.{n}.detected", "variant")) == "BOOLEAN", F.try_variant_get(tree, f"$.factors.{n}.detected", "boolean")), F.lit(False))
    return F.struct(tree.isNotNull().alias("parsed"), number("$.overall_confidence").alias("overall"), *(F.struct(flag(n).alias("detected"), number(f"$.factors.{n}.confidence").alias("confidence")).alias(n) for n in names))
