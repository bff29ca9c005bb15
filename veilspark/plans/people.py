"""Registered queries over notes about people, made from customers and suppliers: from a text to its tier, against a population of its own; and their SQL."""

from __future__ import annotations

import json
import re
from itertools import combinations

from pyspark.sql import functions as F

from ..functions import fixed
from ..operators import evaluate, frequency, gate, pii, quasi
from ..operators.scratch import spread, written
from . import queries as base
from . import span_sql
from .queries import register, rounded, table

_TYPES = ["age", "sex", "marital_status", "state"]
_MARITAL = ["married", "single", "divorced", "widowed", "separated"]
_STATES = ["TX", "NY", "CA", "FL", "GA", "OH", "IL", "NC", "VA", "WA", "AZ", "TN", "CO", "MN", "WI", "SC", "KY", "OR", "OK", "CT", "UT", "IA", "NV", "AR", "KS"]
_SEEN = "seen 01/02/2020, 01/03/2020 and 01/04/2020"
_FILL = 150


def _people(spark, sf_dir):
    """id, segment (null for suppliers), nation, balance and what follows from them: age, sex, marital_status, state."""
    c, s = table(spark, sf_dir, "customer"), table(spark, sf_dir, "supplier")
    rows = c.select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"))
    rows = rows.unionByName(s.select((-1 - F.col("s_suppkey")).alias("id"), F.lit(None).cast("string").alias("segment"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance")))
    n = F.floor(F.abs("balance"))
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    years = 20 + n % 60
    bucket = F.concat((F.floor(years / 5) * 5).cast("string"), F.lit("-"), (F.floor(years / 5) * 5 + 4).cast("string"))
    return rows.withColumns({"years": years.cast("string"), "age": bucket, "sex": F.when(n % 2 == 0, "male").otherwise("female"), "marital_status": pick(_MARITAL, n), "state": pick(_STATES, F.col("nation"))})


def _notes(people):
    """id, text: what a note says depends on the segment, and for suppliers on the nation."""
    age, sex, marital, state = (F.concat(F.lit(front), F.col(c)) for front, c in (("aged ", "years"), ("sex: ", "sex"), ("marital status: ", "marital_status"), ("living in ", "state")))
    seen = F.when(F.col("balance") < 0, F.lit(_SEEN)).otherwise("")
    case = F.col("nation") % 5
    says = (
        F.when(F.col("segment") == "AUTOMOBILE", F.array(sex)).when(F.col("segment") == "BUILDING", F.array(sex, marital, seen)).when(F.col("segment") == "FURNITURE", F.array(age, sex, state)).when(F.col("segment") == "HOUSEHOLD", F.array(state))
        .when(F.col("segment") == "MACHINERY", F.array(age, sex, marital, state)).when(case == 0, F.array(F.concat(F.lit("denies being "), F.col("marital_status")))).when(case == 1, F.array(F.lit("my race is white")))
        .when(case == 2, F.array(age, F.lit("my race is arab"))).when(case == 3, F.array(F.lit("nothing of note"))).otherwise(F.array(age, sex, state))
    )
    return people.select("id", F.concat(F.repeat(F.lit("plain "), F.lit(_FILL)), F.array_join(says, "; "), F.lit(".")).alias("text"))


def _answers(rows):
    """A model that is sure of the divorced, says nothing of the widowed and finds nothing in others."""
    found = json.dumps({"factors": {"SMALL_COMMUNITY": {"detected": True, "confidence": 0.9}}})
    return rows.withColumn("answer", F.when(F.contains("prompt", F.lit("divorced")), found).when(~F.contains("prompt", F.lit("widowed")), '{"factors": {}}'))


_Q = "concat_ws('|', " + ", ".join(f"CASE WHEN grouping({t}) = 0 THEN '{t}=' || {t} END" for t in sorted(_TYPES)) + ")"


def _sets(most: int) -> str:
    return "GROUPING SETS (" + ", ".join(f"({', '.join(c)})" for k in range(1, most + 1) for c in combinations(sorted(_TYPES), k)) + ")"


_LIST = lambda values: "[" + ", ".join(f"'{v}'" for v in values) + "]"
PEOPLE_SQL = f"""p0 AS (SELECT c_custkey AS id, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance FROM customer UNION ALL SELECT -1 - s_suppkey, NULL, s_nationkey, s_acctbal FROM supplier),
p1 AS (SELECT *, floor(abs(balance))::BIGINT AS n FROM p0),
p AS (SELECT *, ((20 + n % 60) // 5 * 5) || '-' || ((20 + n % 60) // 5 * 5 + 4) AS age, CASE WHEN n % 2 = 0 THEN 'male' ELSE 'female' END AS sex, {_LIST(_MARITAL)}[(n % 5 + 1)::INT] AS marital_status, {_LIST(_STATES)}[(nation % 25 + 1)::INT] AS state, nation % 5 AS c FROM p1),
q AS (SELECT id, t.t, t.v, t.neg, t.unseen FROM (SELECT id, unnest(CASE WHEN segment = 'AUTOMOBILE' THEN [S] WHEN segment = 'BUILDING' THEN CASE WHEN balance < 0 THEN [S, M, D('01/02/2020'), D('01/03/2020'), D('01/04/2020')] ELSE [S, M] END WHEN segment = 'FURNITURE' THEN [A, S, T]
   WHEN segment = 'HOUSEHOLD' THEN [T] WHEN segment = 'MACHINERY' THEN [A, S, M, T] WHEN c = 0 THEN [N] WHEN c = 1 THEN [R('white', false)] WHEN c = 2 THEN [A, R('arab', true)] WHEN c = 3 THEN [] ELSE [A, S, T] END) AS t FROM p))"""
for _sign, _made in (
    ("D('01/02/2020')", "X('date', '01/02/2020', false, false)"), ("D('01/03/2020')", "X('date', '01/03/2020', false, false)"), ("D('01/04/2020')", "X('date', '01/04/2020', false, false)"),
    ("R('white', false)", "X('race', 'white', false, false)"), ("R('arab', true)", "X('race', 'arab', false, true)"),
):
    PEOPLE_SQL = PEOPLE_SQL.replace(_sign, _made)
_ROW = {"A": "X('age', age, false, false)", "S": "X('sex', sex, false, false)", "M": "X('marital_status', marital_status, false, false)", "T": "X('state', state, false, false)", "N": "X('marital_status', marital_status, true, false)"}


def _expanded(sql: str) -> str:
    """Single letters in lists as the values that they stand for, and those as structs."""
    sql = re.sub(r"(?<=[\[ ])([ASMTN])(?=[,\]])", lambda m: _ROW[m[1]], sql)
    return re.sub(r"X\(([^,()]+), ([^,()]+), ([^,()]+), ([^,()]+)\)", r"{'t': \1, 'v': \2, 'neg': \3, 'unseen': \4}", sql)


_head, _cases = PEOPLE_SQL.split("\nq AS ", 1)
PEOPLE_SQL = _head + "\nq AS " + _expanded(_cases)
ROUTED_PEOPLE = rf"""WITH {PEOPLE_SQL},
pop AS (SELECT * FROM p WHERE segment IS NOT NULL),
t AS (SELECT {_Q} AS key, count(*)::DOUBLE AS c, (SELECT count(*)::DOUBLE FROM pop) AS n, count(*) / (SELECT count(*) FROM pop) AS pr FROM pop GROUP BY {_sets(3)}),
own AS (SELECT id, t, max(v) AS v FROM q WHERE NOT neg GROUP BY id, t),
j AS (SELECT id, c, pr, n FROM (SELECT id, string_agg(t || '=' || v, '|' ORDER BY t) AS key FROM own GROUP BY id) JOIN t USING (key)),
pw AS (SELECT id, min(pr * n) AS pair FROM (SELECT a.id, a.t || '=' || a.v || '|' || b.t || '=' || b.v AS key FROM own a JOIN own b ON a.id = b.id AND a.t < b.t) JOIN t USING (key) GROUP BY id),
m AS (SELECT id, min(pr * (SELECT count(*) FROM pop)) AS least, count(pr) AS found, count(*) - count(pr) AS missing FROM (SELECT id, t || '=' || v AS key FROM own) LEFT JOIN t USING (key) GROUP BY id),
f AS (SELECT id, count(*) AS qis, count(*) FILTER (t = 'date') AS dates, count(*) FILTER (NOT neg) AS present, bool_or(unseen) AS unseen FROM q GROUP BY id),
x AS (SELECT p.id, marital_status, coalesce(qis, 0) AS qis, coalesce(dates, 0) AS dates, coalesce(unseen, false) AS unseen, segment,
  CASE WHEN qis IS NULL THEN 'no_qis' WHEN present = 0 THEN 'no_patient_qis' WHEN j.c IS NOT NULL THEN 'empirical_joint' WHEN pair IS NOT NULL THEN 'pairwise_min_bound' WHEN least IS NOT NULL THEN 'min_marginal_bound' ELSE 'unavailable' END AS method,
  greatest(0, j.pr - 1.96 * sqrt(j.pr * (1 - j.pr) / j.n)) * j.n AS kj, greatest(1, pair * 0.05) AS kp, greatest(1, least * 0.01 * (found / (found + missing))) AS km FROM p LEFT JOIN f USING (id) LEFT JOIN j USING (id) LEFT JOIN pw USING (id) LEFT JOIN m USING (id)),
k AS (SELECT *, CASE method WHEN 'no_qis' THEN 'inf'::DOUBLE WHEN 'no_patient_qis' THEN 'inf'::DOUBLE WHEN 'empirical_joint' THEN kj WHEN 'pairwise_min_bound' THEN kp WHEN 'min_marginal_bound' THEN km END AS k FROM x),
g AS (SELECT *, CASE WHEN k < 5 THEN 'UNSAFE' WHEN k IS NULL THEN 'UNSAFE' WHEN dates >= 3 THEN 'UNCERTAIN' WHEN k >= 20 THEN 'SAFE' WHEN qis <= 2 THEN 'SAFE' ELSE 'UNCERTAIN' END AS g, (k < 5 AND method = 'empirical_joint') IS TRUE OR k IS NULL AS hard FROM k),
d AS (SELECT *, CASE WHEN g = 'UNSAFE' AND method IN ('pairwise_min_bound', 'min_marginal_bound') AND k < 5 THEN 'UNCERTAIN' ELSE g END AS gate_decision FROM g),
a AS (SELECT *, NOT hard AND gate_decision = 'UNCERTAIN' AS asked, segment IS NOT NULL AND segment IN ('BUILDING', 'MACHINERY') AS told FROM d)
SELECT id, method, CASE method WHEN 'unavailable' THEN 'no joint, pair or marginal of these values' END AS reason, round(k, 6) AS k_lower, qis::INT AS qis_found, gate_decision, hard::INT AS hard_stops, asked AS llm_invoked,
  CASE WHEN hard THEN '' ELSE concat_ws(',', CASE WHEN unseen THEN 'unseen_qi_values' END, CASE WHEN asked AND told AND marital_status = 'widowed' THEN 'llm_abstained' END) END AS flags,
  CASE WHEN hard THEN 3 WHEN gate_decision = 'SAFE' THEN CASE WHEN dates > 0 THEN 2 ELSE 1 END WHEN gate_decision = 'UNSAFE' THEN 3 WHEN told AND marital_status = 'divorced' THEN 3 ELSE 2 END AS tier FROM a"""


@register(ROUTED_PEOPLE)
def routed_people(spark, sf_dir):
    """Notes about people from detection to the tier, with k against the population of all customers, and a model for the uncertain ones."""
    people = _people(spark, sf_dir)
    population = written(frequency.frequency_table(people.where("segment is not null"), _TYPES), "population")
    notes = quasi.identify(_notes(spread(people))).withColumn("pii", pii.merged(pii.evidence(F.col("text"))))
    present = F.size(F.filter("qi", lambda q: q["assertion"] == "present"))
    rows = gate.features(notes).select("id", quasi.key_parts(F.col("qi")).alias("pairs"), present.alias("present"), pii.masked(F.col("text"), F.col("pii")).alias("masked"), *base.GATE_FEATURES)
    rows = written(rows, "notes")
    k = frequency.estimate_found(rows.select("id", "pairs", F.col("qis_found").alias("found"), "present"), population).select("id", "method", "reason", "k_lower")
    out = gate.route(rows.join(k, "id"), model=gate.asked(_answers)).withColumn("flags", F.array_join(gate.uncertainty_flags(), ","))
    return rounded(out.select("id", "method", "reason", "k_lower", "qis_found", "gate_decision", F.size("hard_stop_reasons").alias("hard_stops"), "llm_invoked", "flags", "tier"))


_SIX = ["joint_risk", "k_finite", "direct", "quasi", "masking_ratio", "llm_used"]


_TAKEN = f"""x AS (SELECT r.* EXCLUDE (llm_used), llm_used::INT AS llm_used, CASE WHEN isfinite(k_lower) THEN k_lower ELSE 0 END AS k_finite, (length(text) - length(masked)) / greatest(length(text), 1) AS masking_ratio
  FROM r JOIN documents d ON d.doc_id = r.id JOIN {span_sql.masked(span_sql._LABELS + ' WHERE prio < 2')} m ON m.doc_id = r.id)"""
_CORRELATION = "SELECT '{f}' AS feature, round(coalesce(covar_pop({f}::DOUBLE, expected::INT::DOUBLE) / nullif(stddev_pop({f}::DOUBLE) * stddev_pop(expected::INT::DOUBLE), 0), 0), 6) AS correlation FROM x"


@register(f"WITH {span_sql.PLAIN}, {span_sql.MERGED}, {base._R}, {_TAKEN} " + " UNION ALL ".join(_CORRELATION.format(f=f) for f in _SIX))
def six_correlations(spark, sf_dir):
    """What goes with toxicity: risk, finite k, identifiers of both kinds, how much masking takes away, whether a model was asked."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text").withColumn("spans", pii.merged(pii.evidence(F.col("text"))))
    taken = (F.length("text") - F.length(pii.masked(F.col("text"), F.col("spans"), fixed.CATEGORIES[:2]))) / F.greatest(F.length("text"), F.lit(1))
    rows = base.results(spark, sf_dir).join(docs.select("id", taken.alias("masking_ratio")), "id").withColumn("k_finite", F.when(F.col("k_lower") < float("inf"), F.col("k_lower")).otherwise(0.0))
    return rounded(evaluate.correlations(rows, _SIX))


_RATES = base._ABLATION[: base._ABLATION.index("m AS (SELECT")]


@register(f"{_RATES} m AS (SELECT *, {base._SIM['c']} AS o, {base._MIX} AS risk FROM m0) SELECT condition, round(count(*) FILTER (o = 0) / count(*), 6) AS tier_1_rate, round(count(*) FILTER (o = 1) / count(*), 6) AS tier_2_rate, round(count(*) FILTER (o = 2) / count(*), 6) AS tier_3_rate, round(avg(risk), 6) AS mean_combined_risk FROM m GROUP BY condition")
def ablation_rates(spark, sf_dir):
    """Rates of the tiers and the mean combined risk with either detector, both or none."""
    rows = evaluate.normalise(base.results(spark, sf_dir))
    return rounded(evaluate.ablation_rates(rows, evaluate.grid(spark, {"baseline": [{}]})))


_F1 = "coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)"
_BY = {c: f"max({_F1}) FILTER (condition = '{c}')" for c in ("full", "no_pii", "no_qi", "no_detectors")}
base.ORACLES["ablation_contributions"] = (
    base._ABLATION[: base._ABLATION.rindex("SELECT condition, tp")].rstrip()
    + f""", v AS (SELECT {_BY['full']} AS f, {_BY['no_pii']} AS p, {_BY['no_qi']} AS q, {_BY['no_detectors']} AS n FROM c)
SELECT round(f, 6) AS "full", round(f - p, 6) AS pii, round(f - q, 6) AS qi, round(f - p - q + n, 6) AS interaction, round(coalesce(100 * (f - p) / nullif(f, 0), 0), 6) AS pii_pct, round(coalesce(100 * (f - q) / nullif(f, 0), 0), 6) AS qi_pct FROM v"""
)
