"""Registered queries over the given tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import let, pattern_of
from ..operators import census, corpus, evaluate, frequency, gate, pii, population, quasi
from ..operators.scratch import spread, written
from ..sources import records
from ..streaming.incremental import run_windowed_counts
from . import span_sql

_FACTS = ["balance", "nation", "segment"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _count(text, pattern: str):
    return F.coalesce(F.regexp_count(text, F.lit(pattern_of(pattern))), F.lit(0)).cast("long")


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents as routed texts: id, expected, direct, quasi, k_lower, joint_risk, tier, llm_used, text_length; wiki: those of another language."""
    docs = table(spark, sf_dir, "documents")
    groups = docs.groupBy("lang", "source").agg(F.count("*").alias("k"))
    labels = table(spark, sf_dir, "labels").select("doc_id", (F.col("toxic") == 1).alias("expected"))
    rows = docs.join(labels, "doc_id").join(groups, ["lang", "source"])
    text = F.col("text")
    rows = rows.select(
        F.col("doc_id").alias("id"), "expected", sum((_count(text, fixed.PII[t][0]) for t in ("EMAIL_ADDRESS", "PHONE_NUMBER")), F.lit(0)).alias("direct"), _count(text, fixed.PRONOUNS).alias("quasi"),
        F.when(F.col("k") >= 30, float("inf")).otherwise(F.col("k").cast("double")).alias("k_lower"), F.length(text).alias("text_length"), gate.text_features(text)[1], _count(text, fixed.DAY_FORMS[0]).alias("date_count"), (F.col("lang") != "en").alias("wiki"),
    )
    tier = F.when(F.col("k_lower") < 5, 3).when(F.col("direct") > 0, 2).otherwise(1)
    # Counted once, before rows meet many settings: an exchange of narrow rows ends the stage that reads texts.
    return rows.withColumns({"joint_risk": evaluate.joint_risk(F.col("k_lower")), "tier": tier, "llm_used": F.col("quasi") >= 3}).repartition("id")


def _sql_count(pattern: str) -> str:
    return "len(regexp_extract_all(text, '(?i)" + pattern.replace("'", "''") + "'))"


_R = f"""
g AS (SELECT lang, source, count(*) AS k FROM documents GROUP BY ALL),
r0 AS (SELECT doc_id AS id, toxic = 1 AS expected, {_sql_count(fixed.PII["EMAIL_ADDRESS"][0])} + {_sql_count(fixed.PII["PHONE_NUMBER"][0])} AS direct, {_sql_count(fixed.PRONOUNS)} AS quasi,
              CASE WHEN k >= 30 THEN 'inf'::DOUBLE ELSE k::DOUBLE END AS k_lower, length(text) AS text_length, lang <> 'en' AS wiki,
              len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count, {_sql_count(fixed.DAY_FORMS[0])} AS date_count
       FROM documents JOIN labels USING (doc_id) JOIN g USING (lang, source)),
r AS (SELECT *, CASE WHEN k_lower = 0 OR k_lower = 'inf'::DOUBLE THEN 0.0 ELSE least(1.0, 1 / k_lower) END AS joint_risk, CASE WHEN k_lower < 5 THEN 3 WHEN direct > 0 THEN 2 ELSE 1 END AS tier, quasi >= 3 AS llm_used FROM r0),
n AS (SELECT *, direct / greatest(1.0, max(direct) OVER ()) AS d, quasi / greatest(1.0, max(quasi) OVER ()) AS q FROM r)"""

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@register(f"SELECT tier, count(*) AS n FROM (SELECT CASE WHEN {_sql_count(fixed.PII['EMAIL_ADDRESS'][0])} + {_sql_count(fixed.PII['PHONE_NUMBER'][0])} > 0 THEN 2 ELSE 1 END AS tier FROM documents) GROUP BY tier")
def tier_counts(spark, sf_dir):
    """Detect, merge, and route by whether a text has identifiers, within the row."""
    found = pii.merged(pii.evidence(F.col("text"), ["EMAIL_ADDRESS", "PHONE_NUMBER"]))
    tier = table(spark, sf_dir, "documents").select(F.when(F.size(found) > 0, 2).otherwise(1).alias("tier"))
    return tier.groupBy("tier").agg(F.count("*").alias("n"))


@register(" UNION ALL ".join(f"SELECT doc_id, '{t}' AS entity_type, n FROM (SELECT doc_id, ({' + '.join(_sql_count(p) for p in ps)})::BIGINT AS n FROM documents) WHERE n > 0" for t, ps in fixed.PII.items()))
def pii_counts(spark, sf_dir):
    """How often each document has each type of identifier, counted within the row."""
    counts = F.explode_outer(pii.counts(F.col("text"))).alias("x")
    return table(spark, sf_dir, "documents").select("doc_id", counts).where("x is not null").select("doc_id", "x.entity_type", "x.n")


def _identified(spark, sf_dir, pii_too: bool = True) -> DataFrame:
    """Documents with merged identifier spans and quasi-identifiers, found within the row."""
    docs = quasi.identify(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return docs.withColumn("pii", pii.merged(pii.evidence(F.col("text")))) if pii_too else docs


@register(span_sql.PII_MERGED)
def pii_merged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.explode_outer(pii.merged(pii.evidence(F.col("text")))).alias("s")).where("s is not null").select("doc_id", "s.*").withColumn("confirmed_by", F.array_join("confirmed_by", ","))


@register(span_sql.PII_MASKED)
def pii_masked(spark, sf_dir):
    """Both masked views: strong and direct identifiers only, and all."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("spans", pii.merged(pii.evidence(F.col("text"))))
    both = docs.select("doc_id", F.length("text").alias("n"), pii.masked(F.col("text"), F.col("spans"), fixed.CATEGORIES[:2]).alias("masked"), pii.masked(F.col("text"), F.col("spans")).alias("full"))
    return rounded(both.select("doc_id", F.md5("masked").alias("masked_md5"), F.md5("full").alias("pii_masked_md5"), ((F.col("n") - F.length("masked")) / F.greatest("n", F.lit(1))).alias("masking_ratio")))


@register(span_sql.EVERYTHING_MASKED)
def everything_masked(spark, sf_dir):
    return _identified(spark, sf_dir).select("doc_id", F.md5(pii.all_masked(F.col("text"), F.col("pii"), F.col("qi"))).alias("masked_md5"))


@register(span_sql.QUASI_IDENTIFIERS)
def quasi_identifiers(spark, sf_dir):
    # An outer explode and a test behind it: a test before it would find everything twice.
    rows = _identified(spark, sf_dir, False).select("doc_id", F.explode_outer("qi").alias("q")).where("q is not null")
    return rows.select("doc_id", *(f"q.{c}" for c in ("qi_type", "value", "start", "end", "confidence", "granularity", "unseen", "assertion")), F.array_join("q.agreement", ",").alias("agreement"))


@register(span_sql.QUASI_KEYS)
def quasi_joint_keys(spark, sf_dir):
    unseen = lambda qi: F.exists(qi, lambda q: q["unseen"] & (q["assertion"] == "present"))
    made = let(F.col("qi"), lambda qi: F.struct(quasi.key_parts(qi).alias("pairs"), unseen(qi).alias("has_unseen")))
    rows = _identified(spark, sf_dir, False).select("doc_id", F.explode_outer(F.array(made)).alias("x")).where(F.size("x.pairs") > 0)
    return rows.select("doc_id", F.array_join(F.transform("x.pairs", lambda x: x["t"]), ",").alias("types"), frequency.joint_key(F.col("x.pairs")).alias("key"), "x.has_unseen")


@register("SELECT doc_id, length(text) AS text_length, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS word_count, length(regexp_replace(text, '[^.!?]', '', 'g')) AS sentence_count FROM documents")
def text_features(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *gate.text_features(F.col("text")))


@register("SELECT doc_id, substr(sha256(source || ':' || text), 1, 16) AS hash, md5(text) AS md5, substr(sha256(text), 1, 32) AS input_hash FROM documents")
def sample_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.sample_hash(F.col("source"), F.col("text")).alias("hash"), F.md5("text").alias("md5"), F.substring(F.sha2("text", 256), 1, 32).alias("input_hash"))


def _facts(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_custkey").alias("id"), F.floor(F.col("c_acctbal") / 2000).cast("string").alias("balance"), F.col("n_name").alias("nation"), F.col("c_mktsegment").alias("segment"))


_F = "f AS (SELECT c_custkey AS id, floor(c_acctbal / 2000)::BIGINT::VARCHAR AS balance, n_name AS nation, c_mktsegment AS segment FROM customer JOIN nation ON c_nationkey = n_nationkey)"
_KEYS = "concat_ws('|', CASE WHEN grouping(balance) = 0 THEN 'balance=' || balance END, CASE WHEN grouping(nation) = 0 THEN 'nation=' || nation END, CASE WHEN grouping(segment) = 0 THEN 'segment=' || segment END)"
_SETS = "GROUPING SETS ((balance), (nation), (segment), (balance, nation), (balance, segment), (nation, segment), (balance, nation, segment))"


@register(f"WITH {_F} SELECT {_KEYS} AS key, count(*) AS count, (SELECT count(*) FROM f) AS total, round(count(*) / (SELECT count(*) FROM f), 6) AS frequency FROM f GROUP BY {_SETS}")
def frequency_table(spark, sf_dir):
    return rounded(frequency.frequency_table(_facts(spark, sf_dir), _FACTS).select("key", "count", "total", "frequency"))


@register(
    f"WITH {_F}, t AS (SELECT {_KEYS} AS key, count(*)::DOUBLE AS c, (SELECT count(*)::DOUBLE FROM f) AS n FROM f GROUP BY GROUPING SETS ((balance), (nation), (segment))), p AS (SELECT *, c / n AS p FROM t) "
    "SELECT key, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / greatest(c, 1))), 6) AS wald_low, round(least(1, p + 1.96 * sqrt(p * (1 - p) / greatest(c, 1))), 6) AS wald_high, "
    "round(greatest(0, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) - 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n) / (1 + 3.8416 / n)), 6) AS wilson_low, "
    "round(least(1, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) + 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n) / (1 + 3.8416 / n)), 6) AS wilson_high FROM p"
)
def marginal_bounds(spark, sf_dir):
    t = frequency.frequency_table(_facts(spark, sf_dir), _FACTS, 1)
    p, n = F.col("frequency"), F.col("total")
    a, b = frequency.wald(p, F.greatest("count", F.lit(1))), frequency.wilson(p, n)
    return rounded(t.select("key", a[0].alias("wald_low"), a[1].alias("wald_high"), b[0].alias("wilson_low"), b[1].alias("wilson_high")))


@register(f"""
WITH {_F}, pop AS (SELECT * FROM f), people AS (SELECT * FROM f UNION ALL SELECT -s_suppkey, floor(s_acctbal / 2000)::BIGINT::VARCHAR, n_name, NULL FROM supplier JOIN nation ON s_nationkey = n_nationkey),
t AS (SELECT {_KEYS} AS key, count(*)::DOUBLE AS c, (SELECT count(*)::DOUBLE FROM pop) AS n, count(*) / (SELECT count(*) FROM pop) AS p FROM pop GROUP BY {_SETS}),
one AS (SELECT id, unnest(list_filter(['balance=' || balance, 'nation=' || nation, 'segment=' || segment], lambda x: x IS NOT NULL)) AS key FROM people),
two AS (SELECT id, unnest(list_filter(['balance=' || balance || '|nation=' || nation, 'balance=' || balance || '|segment=' || segment, 'nation=' || nation || '|segment=' || segment], lambda x: x IS NOT NULL)) AS key FROM people),
j AS (SELECT people.id, c, p, n FROM people JOIN t ON key = concat_ws('|', 'balance=' || balance, 'nation=' || nation, 'segment=' || segment)),
pw AS (SELECT id, min(p * n) AS pair FROM two JOIN t USING (key) GROUP BY id),
m AS (SELECT id, min(p * (SELECT count(*) FROM pop)) AS least, count(p) AS found, count(*) - count(p) AS missing, (SELECT count(*) FROM pop) AS n, greatest(0, sum(coalesce(greatest(0, p - 1.96 * sqrt(p * (1 - p) / greatest(c, 1))), 0)) - (count(*) - 1)) AS fl, min(greatest(0, p - 1.96 * sqrt(p * (1 - p) / greatest(c, 1)))) AS pl FROM one LEFT JOIN t USING (key) GROUP BY id),
x AS (SELECT people.id, 2 + (segment IS NOT NULL)::INT AS qis, CASE WHEN j.c IS NOT NULL THEN 'empirical_joint' WHEN pair IS NOT NULL THEN 'pairwise_min_bound' WHEN least IS NOT NULL THEN 'min_marginal_bound' ELSE 'unavailable' END AS method,
      j.c, j.p, j.n, pair, least, found, missing, m.n AS mn, fl, pl FROM people LEFT JOIN j USING (id) LEFT JOIN pw USING (id) LEFT JOIN m USING (id))
SELECT id, qis, method, CASE method WHEN 'empirical_joint' THEN 0.9::DOUBLE WHEN 'pairwise_min_bound' THEN 0.6::DOUBLE WHEN 'min_marginal_bound' THEN 0.4::DOUBLE END AS confidence, round(CASE method WHEN 'empirical_joint' THEN c WHEN 'pairwise_min_bound' THEN pair WHEN 'min_marginal_bound' THEN least END, 6) AS k_point,
 round(CASE method WHEN 'empirical_joint' THEN greatest(0, p - 1.96 * sqrt(p * (1 - p) / n)) * n WHEN 'pairwise_min_bound' THEN greatest(1, pair * 0.05) WHEN 'min_marginal_bound' THEN greatest(1, least * 0.01 * (found / (found + missing))) END, 6) AS k_lower,
 round(CASE method WHEN 'empirical_joint' THEN least(1, p + 1.96 * sqrt(p * (1 - p) / n)) * n WHEN 'pairwise_min_bound' THEN pair WHEN 'min_marginal_bound' THEN least END, 6) AS k_upper,
 round(CASE WHEN missing = 0 THEN fl * mn END, 6) AS frechet_lower, round(CASE WHEN missing = 0 THEN pl * mn END, 6) AS frechet_upper FROM x
""")
def tiered_k(spark, sf_dir):
    """Joint k of customers, and of suppliers (who have no segment), against the population of all customers: exact, pairwise and marginal estimates."""
    facts = _facts(spark, sf_dir)
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    others = s.join(n, s.s_nationkey == n.n_nationkey).select((-F.col("s_suppkey")).alias("id"), F.floor(F.col("s_acctbal") / 2000).cast("string").alias("balance"), F.col("n_name").alias("nation"), F.lit(None).cast("string").alias("segment"))
    return rounded(frequency.estimates(facts.unionByName(others), _FACTS, written(frequency.frequency_table(facts, _FACTS), "frequencies")))


@register(f"WITH {_R} SELECT id, unnest([{', '.join(map(str, fixed.K_LIST))}]) AS k, CASE WHEN k_lower < k THEN 3 WHEN direct > 0 THEN 2 ELSE 1 END AS tier FROM r")
def tier_by_k(spark, sf_dir):
    return evaluate.per_k(results(spark, sf_dir), fixed.K_LIST)


def routing(docs: DataFrame, k_min: int = 5, k_safe: int = 20) -> DataFrame:
    """docs (doc_id, text) from detection to the tier: the gate's features, k against the documents' own values, gate, hard stops, tier, flags.

    Everything about a text is found within its row; only the narrow rows of features, written once, are joined and counted.
    """
    found = quasi.identify(docs).withColumn("pii", pii.merged(pii.evidence(F.col("text"))))
    rows = gate.features(found).select("doc_id", quasi.key_parts(F.col("qi")).alias("pairs"), *GATE_FEATURES, F.substring(F.sha2("text", 256), 1, 32).alias("input_hash"))
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "features")
    subsets = written(frequency.subset_table(rows), "subsets")
    k = frequency.estimate_pairs(rows.select(F.col("row").alias("id"), "pairs"), subsets).select(F.col("id").alias("row"), "method", "k_point", "k_lower", "k_upper")
    return gate.route(rows.join(k, "row"), k_min, k_safe).withColumn("uncertainty_flags", gate.uncertainty_flags())


GATE_FEATURES = [
    "text_length", "word_count", "sentence_count", "pii_count", "direct_count", "strong_count", "contextual_count", "qi_count", "qis_found", "date_count", "rare_disease", "rare_occupation", "rare",
    "has_unseen", "disagreement", "mask_count", "mask_ratio",
]


@register(span_sql.GATE_FEATURES)
def gate_features(spark, sf_dir):
    """Features of the gate for every document."""
    return rounded(gate.features(_identified(spark, sf_dir)).select("doc_id", *GATE_FEATURES))


@register(span_sql.ROUTED)
def routed(spark, sf_dir):
    """Every document from detection to its tier."""
    rows = routing(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rounded(rows.select("doc_id", "input_hash", "method", "k_lower", "gate_decision", F.array_join("hard_stop_reasons", "; ").alias("hard_stops"), F.array_join("uncertainty_flags", ",").alias("flags"), "direct_count", "qis_found", "tier"))


def _gate_features(spark, sf_dir):
    r = results(spark, sf_dir)
    method = F.when(F.col("quasi") > 4, "pairwise_min_bound").otherwise("empirical_joint")
    k = F.when(F.col("quasi") == 7, None).otherwise(F.col("k_lower"))
    return r.select("id", k.alias("k_lower"), method.alias("method"), "date_count", F.col("quasi").alias("qi_count"), F.lit(0).alias("contextual_count"), "word_count", F.lit(False).alias("disagreement"), F.lit(False).alias("rare"), F.col("direct").alias("pii_count"))


@register(f"""WITH {_R}, x AS (SELECT id, CASE WHEN quasi = 7 THEN NULL ELSE k_lower END AS k, CASE WHEN quasi > 4 THEN 'pairwise_min_bound' ELSE 'empirical_joint' END AS method, date_count AS dates, quasi AS qi, word_count AS w, direct AS p FROM r),
g2 AS (SELECT *, CASE WHEN k < 5 THEN 'UNSAFE' WHEN k IS NULL THEN 'UNSAFE' WHEN dates >= 3 THEN 'UNCERTAIN' WHEN qi / greatest(w, 1) > 0.1 THEN 'UNCERTAIN' WHEN k >= 20 THEN 'SAFE' WHEN qi <= 2 THEN 'SAFE' ELSE 'UNCERTAIN' END AS g,
   (k < 5 AND method = 'empirical_joint') IS TRUE OR k IS NULL AS hard FROM x),
g3 AS (SELECT *, CASE WHEN g = 'UNSAFE' AND method = 'pairwise_min_bound' AND k < 5 THEN 'UNCERTAIN' ELSE g END AS gate_decision FROM g2)
SELECT id, gate_decision, hard::INT AS hard_stops, CASE WHEN hard THEN 3 WHEN gate_decision = 'SAFE' THEN CASE WHEN p > 0 THEN 2 ELSE 1 END WHEN gate_decision = 'UNSAFE' THEN 3 ELSE 2 END AS tier FROM g3""")
def gate_rules(spark, sf_dir):
    """The rules of gate and tier over labelled documents, with pronouns as quasi-identifiers and groups of language and source as k."""
    return gate.route(_gate_features(spark, sf_dir)).select("id", "gate_decision", F.size("hard_stop_reasons").alias("hard_stops"), "tier")


_FIN = "avg(k_lower) FILTER (k_lower < 'inf'::DOUBLE"


@register(f"""WITH {_R} SELECT count(*) AS n, {', '.join(f'count(*) FILTER (tier = {t}) AS tier_{t}' for t in (1, 2, 3))}, round(count(*) FILTER (expected AND tier <> 3) / count(*), 6) AS false_cloud_rate,
 round(count(*) FILTER (NOT expected AND tier = 3) / count(*), 6) AS over_censor_rate, round(count(*) FILTER (llm_used) / count(*), 6) AS llm_rate, round(coalesce({_FIN}), 0), 6) AS mean_k,
 round(coalesce(median(k_lower) FILTER (k_lower < 'inf'::DOUBLE), 0), 6) AS median_k, {', '.join(f'round(coalesce({_FIN} AND tier = {t}), 0), 6) AS mean_k_{t}' for t in (1, 2, 3))} FROM r""")
def summary(spark, sf_dir):
    return rounded(evaluate.summary(results(spark, sf_dir)))


_FEATURES = ["direct", "quasi", "joint_risk", "text_length", "tier"]


@register(f"WITH {_R} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(coalesce(covar_pop({f}::DOUBLE, expected::INT::DOUBLE) / nullif(stddev_pop({f}::DOUBLE) * stddev_pop(expected::INT::DOUBLE), 0), 0), 6) AS correlation FROM r" for f in _FEATURES))
def correlations(spark, sf_dir):
    return rounded(evaluate.correlations(results(spark, sf_dir), _FEATURES))


def _metrics_sql(counts: str, keys: str, rates: bool = False) -> str:
    d = lambda a, b: f"coalesce(({a}) / nullif({b}, 0), 0)"
    n = "(tp + fp + tn + fn)"
    more = f", round({d('reviews', n)}, 6) AS review_rate, round({d('blocks', n)}, 6) AS block_rate, round({d('tn + fn', n)}, 6) AS pass_rate, round({d('wm', 'wt')}, 6) AS wiki_fpr" if rates else ""
    p, r, s = d("tp", "tp + fp"), d("tp", "tp + fn"), d("tn", "tn + fp")
    return f"SELECT {keys}, tp, fp, tn, fn, round({p}, 6) AS precision, round({r}, 6) AS recall, round({d('fp', 'fp + tn')}, 6) AS fpr, round({d(f'2 * {p} * {r}', f'({p} + {r})')}, 6) AS f1, round(({r} + {s}) / 2, 6) AS balanced_accuracy{more} FROM {counts}"


def _grid_sql(sim: str) -> str:
    rows = [f"('{n}', {i}, {', '.join(str(float((fixed.BASELINE | p)[k])) + '::DOUBLE' for k in fixed.BASELINE)})" for n, ps in evaluate.SWEEPS[sim]().items() for i, p in enumerate(ps)]
    return f"s(sweep, point, {', '.join(fixed.BASELINE)}) AS (VALUES {', '.join(rows)})"


_MIX = "least(1.0, greatest(0.0, joint_risk + w_direct * d + w_quasi * q))"
_SIM = {
    "a": f"CASE WHEN k_lower < k_min OR {_MIX} >= tau_block THEN 2 WHEN {_MIX} >= tau_review THEN 1 ELSE 0 END",
    "b": "CASE WHEN k_lower < k_min OR d >= tau_direct_block OR q >= tau_quasi_block OR (joint_risk + w_direct * d + w_quasi * q) / (1 + w_direct + w_quasi) >= tau_block THEN 2 WHEN d >= tau_direct_review OR q >= tau_quasi_review OR (joint_risk + w_direct * d + w_quasi * q) / (1 + w_direct + w_quasi) >= tau_review OR k_lower < k_safe THEN 1 ELSE 0 END",
    "c": f"CASE WHEN k_lower < k_min OR {_MIX} >= tau_block THEN 2 WHEN {_MIX} >= tau_review OR k_lower < k_safe THEN 1 ELSE 0 END",
}
_COUNTS = "count(*) FILTER (expected AND o > 0) AS tp, count(*) FILTER (NOT expected AND o > 0) AS fp, count(*) FILTER (NOT expected AND o = 0) AS tn, count(*) FILTER (expected AND o = 0) AS fn, count(*) FILTER (wiki AND o > 0) AS wm, count(*) FILTER (wiki) AS wt, count(*) FILTER (o = 1) AS reviews, count(*) FILTER (o = 2) AS blocks"


def _points_sql(sim: str) -> str:
    return f"WITH {_R}, {_grid_sql(sim)}, m AS (SELECT *, {_SIM[sim]} AS o FROM n CROSS JOIN s), c AS (SELECT sweep, point, {_COUNTS} FROM m GROUP BY sweep, point), pts AS ({_metrics_sql('c', 'sweep, point', True)})"


def _points(spark, sf_dir, sim: str) -> DataFrame:
    r = evaluate.normalise(results(spark, sf_dir))
    return evaluate.confusion(r, evaluate.grid(spark, evaluate.SWEEPS[sim]()), sim)


_POINT = ["sweep", "point", "tp", "fp", "tn", "fn", "precision", "recall", "fpr", "f1", "balanced_accuracy"]
_RATES = ["review_rate", "block_rate", "pass_rate", "wiki_fpr"]


@register(_points_sql("a") + " SELECT * FROM pts")
def sweep_a(spark, sf_dir):
    return rounded(_points(spark, sf_dir, "a").select(*_POINT, *_RATES))


@register(_points_sql("b") + " SELECT * FROM pts")
def sweep_b(spark, sf_dir):
    return rounded(_points(spark, sf_dir, "b").select(*_POINT, *_RATES))


@register(_points_sql("c") + " SELECT * FROM pts")
def sweep_c(spark, sf_dir):
    return rounded(_points(spark, sf_dir, "c").select(*_POINT, *_RATES))


@register(_points_sql("b") + ", e AS (SELECT sweep, point, fpr, 1 - recall AS fnr FROM pts) SELECT sweep, point, round(fpr, 6) AS fpr, round(fnr, 6) AS fnr FROM e WHERE NOT EXISTS (SELECT 1 FROM e o WHERE o.fpr <= e.fpr AND o.fnr <= e.fnr AND (o.fpr < e.fpr OR o.fnr < e.fnr))")
def pareto_points(spark, sf_dir):
    points = rounded(_points(spark, sf_dir, "b").select(*_POINT, *_RATES)).withColumn("fnr", F.round(1 - F.col("recall"), 6))
    return evaluate.pareto(points).select("sweep", "point", "fpr", "fnr")


@register(_points_sql("a") + " SELECT sweep, point, f1 FROM pts ORDER BY f1 DESC, sweep, point LIMIT 10")
def top_points(spark, sf_dir):
    return rounded(_points(spark, sf_dir, "a").select("sweep", "point", "f1")).orderBy(F.desc("f1"), "sweep", "point").limit(10)


_AIMS = {
    "best_f1": ("true", "-f1"), "best_balanced_accuracy": ("true", "-balanced_accuracy"), "high_recall_fpr_le_15": ("fpr <= 0.15", "-recall"), "high_recall_fpr_le_10": ("fpr <= 0.1", "-recall"),
    "high_recall_wiki_fpr_le_10": ("wiki_fpr <= 0.1", "-recall"), "low_fnr_fpr_le_15": ("fpr <= 0.15", "round(1 - recall, 6)"), "low_fnr_wiki_fpr_le_10": ("wiki_fpr <= 0.1", "round(1 - recall, 6)"),
    "low_wiki_fpr_recall_ge_90": ("recall >= 0.9", "wiki_fpr"), "low_wiki_fpr_recall_ge_95": ("recall >= 0.95", "wiki_fpr"), "lowest_wiki_fpr": ("true", "wiki_fpr"),
}


@register(_points_sql("b") + ", a AS (" + " UNION ALL ".join(f"SELECT *, '{a}' AS aim, {by} AS o FROM pts WHERE {ok}" for a, (ok, by) in _AIMS.items()) + ") SELECT aim, sweep, point FROM a QUALIFY row_number() OVER (PARTITION BY aim ORDER BY o, sweep, point) = 1")
def chosen_points(spark, sf_dir):
    points = rounded(_points(spark, sf_dir, "b").select(*_POINT, *_RATES)).withColumn("fnr", F.round(1 - F.col("recall"), 6))
    return evaluate.choose(points).select("aim", "sweep", "point")


def _ablated(spark, sf_dir):
    r = evaluate.normalise(results(spark, sf_dir))
    return evaluate.ablation(r, evaluate.grid(spark, {"baseline": [{}]}))


_ABLATION = f"""WITH {_R}, s AS (SELECT * FROM (VALUES {', '.join(f"('{c}', {p}, {q})" for c, p, q in (('full', 1, 1), ('no_pii', 0, 1), ('no_qi', 1, 0), ('no_detectors', 0, 0)))}) t(condition, up, uq)),
m0 AS (SELECT expected, wiki, condition, d * up AS d, q * uq AS q, CASE WHEN up + uq = 0 THEN 0 ELSE joint_risk END AS joint_risk, CASE WHEN up + uq = 0 THEN 'inf'::DOUBLE ELSE k_lower END AS k_lower,
   {', '.join(f'{float(v)}::DOUBLE AS {k}' for k, v in fixed.BASELINE.items())} FROM n CROSS JOIN s),
m AS (SELECT *, {_SIM['c']} AS o FROM m0), c AS (SELECT condition, {_COUNTS} FROM m GROUP BY condition) {_metrics_sql('c', 'condition')}"""


@register(_ABLATION)
def ablation(spark, sf_dir):
    return rounded(_ablated(spark, sf_dir).select("condition", *_POINT[2:]))


@register()
def ablation_contributions(spark, sf_dir):
    return rounded(evaluate.contributions(_ablated(spark, sf_dir)))


@register()
def good_articles(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "text")
    return corpus.good_articles(docs).select("doc_id", F.md5(corpus.shorten(F.col("text"))).alias("text_md5"))


@register("SELECT doc_id, length(s) AS n, md5(s) AS md5 FROM (SELECT doc_id, CASE WHEN length(text) > 4000 THEN regexp_replace(substr(text, 1, 4000), '(?s) [^ ]*$', '') || '...' ELSE text END AS s FROM documents)")
def shortened(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", corpus.shorten(F.col("text")).alias("s")).select("doc_id", F.length("s").alias("n"), F.md5("s").alias("md5"))


@register("SELECT conv_id::VARCHAR AS name, role = 'user' AS expected, md5(trim(text, ' \n\r\t')) AS text_md5 FROM conversations")
def transcripts(spark, sf_dir):
    """Turns written as transcript blocks and parsed again."""
    turns = table(spark, sf_dir, "conversations").select(corpus.block(F.col("conv_id").cast("string"), F.col("role") == "user", F.col("text")).alias("value"))
    return corpus.parse_blocks(turns).select("name", "expected", F.md5("text").alias("text_md5"))


@register("SELECT doc_id FROM documents WHERE substr(sha256(source || ':' || text), 1, 16) NOT IN (SELECT substr(sha256(source || ':' || text), 1, 16) FROM documents JOIN labels USING (doc_id))")
def unprocessed(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("hash", corpus.sample_hash(F.col("source"), F.col("text")))
    return corpus.unprocessed(docs, docs.join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")).select("doc_id")


@register("SELECT count(*) FILTER (k = 'd') AS documents, count(*) FILTER (k = 'b') AS benchmark, count(*) AS total FROM (SELECT 'd' AS k FROM documents UNION ALL SELECT 'b' FROM benchmark)")
def union_corpora(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.lit("d").alias("k"), "text", "lang")
    both = d.unionByName(table(spark, sf_dir, "benchmark").select(F.lit("b").alias("k"), "text"), allowMissingColumns=True)
    return both.agg(F.count_if(F.col("k") == "d").alias("documents"), F.count_if(F.col("k") == "b").alias("benchmark"), F.count("*").alias("total"))


@register("SELECT count(*) AS total, min(length(text)) AS least, max(length(text)) AS most, round(avg(length(text)), 6) AS mean, -quantile_disc(-length(text), 0.5) AS upper_median FROM documents")
def length_stats(spark, sf_dir):
    return rounded(corpus.length_stats(table(spark, sf_dir, "documents")))


@register("SELECT source, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM documents), 6) AS pct FROM documents GROUP BY source")
def source_histogram(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return rounded(docs.groupBy("source").agg(F.count("*").alias("n")).crossJoin(F.broadcast(docs.agg(F.count("*").alias("t")))).select("source", "n", (100 * F.col("n") / F.col("t")).alias("pct")))


@register("SELECT strftime(time_bucket(INTERVAL 1 hour, ts), '%Y-%m-%d %H:%M') AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def streamed_event_counts(spark, sf_dir):
    """Event counts by hour and type, streamed with a watermark and a checkpoint."""
    # A glob: the table may be one file, and a stream's plain path must be a folder.
    rows = run_windowed_counts(spark, f"{sf_dir}/events*.parquet")
    return rows.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("hour"), "event_type", "n", F.round("total", 4).alias("total"))


@register("""SELECT c_mktsegment AS qi_value, count(*) AS count, round(p, 6) AS frequency, round(greatest(0, m - s), 6) AS lower_bound, round(least(1, m + s), 6) AS upper_bound FROM customer JOIN
 (SELECT c_mktsegment, p, (p + 3.8416 / (2 * n)) / (1 + 3.8416 / n) AS m, 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n) / (1 + 3.8416 / n) AS s
  FROM (SELECT c_mktsegment, count(*) / (SELECT count(*) FROM customer) AS p, (SELECT count(*)::DOUBLE FROM customer) AS n FROM customer GROUP BY 1)) USING (c_mktsegment) GROUP BY ALL""")
def segment_marginals(spark, sf_dir):
    """Shares of counted groups with Wilson's bounds, as for occupations."""
    counts = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("qi_value")).agg(F.count("*").alias("count"))
    return rounded(population.from_counts(counts, "segment", "customer").select("qi_value", "count", "frequency", "lower_bound", "upper_bound"))


@register("SELECT doc_id, v.value AS occupation FROM (SELECT doc_id, list_filter([" + ", ".join(f"{{'word': '{w}', 'value': '{v}'}}" for w, v in fixed.OCCUPATIONS.items()) + "], lambda x: contains(lower(text), x.word))[1] AS v FROM documents) WHERE v IS NOT NULL")
def occupations(spark, sf_dir):
    """The occupation that each text speaks of first by the table's order."""
    found = quasi.detect(table(spark, sf_dir, "documents").select("doc_id", "text"), ["occupation"]).where("detector = 'keyword'")
    return found.select("doc_id", F.col("value").alias("occupation"))


def _wilson_sql(count: str, total: str) -> str:
    p, n = f"({count} / {total})", f"({total})::DOUBLE"
    m, s = f"(({p} + 3.8416 / (2 * {n})) / (1 + 3.8416 / {n}))", f"(1.96 * sqrt(({p} * (1 - {p}) + 3.8416 / (4 * {n})) / {n}) / (1 + 3.8416 / {n}))"
    return f"round({p}, 6) AS frequency, round(greatest(0, {m} - {s}), 6) AS lower_bound, round(least(1, {m} + {s}), 6) AS upper_bound"


_MARGINAL = ["qi_value", "count", "frequency", "lower_bound", "upper_bound"]
_PRIORITIES = {"1-URGENT": "soon", "2-HIGH": "soon", "3-MEDIUM": "later", "4-NOT SPECIFIED": "unknown"}


@register("WITH o AS (SELECT CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIORITIES.items()) + f""" END AS qi_value, (SELECT count(*) FROM orders) AS t FROM orders)
SELECT qi_value, count, {_wilson_sql('count', 't')} FROM (SELECT qi_value, t, count(*) AS count FROM o WHERE qi_value IS NOT NULL GROUP BY ALL)""")
def universe_marginals(spark, sf_dir):
    """Values summed from several counted variables, over the count of a universe that holds others too."""
    variables = table(spark, sf_dir, "orders").select(F.explode(F.array("o_orderpriority", F.lit("all"))).alias("variable")).groupBy("variable").agg(F.count("*").alias("count"))
    return rounded(census.universe_marginals(variables, _PRIORITIES, "all", "priority", "orders").select(*_MARGINAL))


@register(f"""WITH a AS (SELECT c_nationkey, count(*) AS count, (SELECT count(*) FROM customer) AS t FROM customer GROUP BY 1)
SELECT n_name AS qi_value, count, {_wilson_sql('count', 't')} FROM a JOIN nation ON c_nationkey = n_nationkey""")
def area_marginals(spark, sf_dir):
    """Shares of the areas that have a name, of the sum over all areas."""
    areas = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("count"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("qi_value"))
    return rounded(census.area_marginals(areas, names, "nation", "customer").select(*_MARGINAL))


@register("""WITH g AS (SELECT n_name AS area, c_mktsegment AS condition, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
r AS (SELECT area, condition, 6000000 * (round(100 * n / sum(n) OVER (PARTITION BY area), 1) / 100) AS x FROM g),
c AS (SELECT area, condition, trunc(x)::BIGINT AS count, trunc(x) / 6000000 AS p FROM r)
SELECT area, condition, count, round(p, 6) AS frequency, round(greatest(0, p - 1.96 * sqrt(p * (1 - p) / 6000000)), 6) AS lower_bound, round(least(1, p + 1.96 * sqrt(p * (1 - p) / 6000000)), 6) AS upper_bound FROM c""")
def prevalence_by_area(spark, sf_dir):
    """Joints of area and group from published per cents, with Wald's bounds."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    counts = c.join(n, c.c_nationkey == n.n_nationkey).groupBy(F.col("n_name").alias("area"), F.col("c_mktsegment").alias("condition")).agg(F.count("*").alias("n"))
    percent = F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy("area")), 1)
    rates = counts.withColumn("percent", percent)
    return rounded(census.prevalence_by_area(rates, 6_000_000, "customer").select("area", "condition", "count", "frequency", "lower_bound", "upper_bound"))


def _share_sql(column: str, source: str) -> str:
    return f"SELECT {column} AS v, count(*) / sum(count(*)) OVER ()::DOUBLE AS f FROM {source} GROUP BY 1"


def _shares(rows: DataFrame, column: str) -> DataFrame:
    return population.from_counts(rows.groupBy(F.col(column).alias("qi_value")).agg(F.count("*").alias("count")), column, "counted")


@register(f"""WITH s AS ({_share_sql('c_mktsegment', 'customer')}), p AS ({_share_sql('o_orderpriority', 'orders')}), t AS ({_share_sql('o_orderstatus', 'orders')})
SELECT s.v AS segment, p.v AS priority, t.v AS status, greatest(1, trunc(s.f * p.f * t.f * 150000)::BIGINT) AS count FROM s, p, t""")
def cross_tabulation(spark, sf_dir):
    """Every combination of three marginals with the count that independence gives, 1 at least."""
    orders = table(spark, sf_dir, "orders")
    marginals = {"segment": _shares(table(spark, sf_dir, "customer"), "c_mktsegment"), "priority": _shares(orders, "o_orderpriority"), "status": _shares(orders, "o_orderstatus")}
    return census.independent_joints(marginals, 150_000)


@register(f"""WITH n AS (SELECT n_name AS v, f FROM ({_share_sql('c_nationkey', 'customer')}) JOIN nation ON v = n_nationkey ORDER BY f DESC, n_name LIMIT 10), s AS ({_share_sql('c_mktsegment', 'customer')}), p AS ({_share_sql('o_orderstatus', 'orders')})
SELECT s.v AS segment, p.v AS status, n.v AS nation, trunc(s.f * p.f * n.f * 150000)::BIGINT AS count FROM s, p, n WHERE trunc(s.f * p.f * n.f * 150000) > 100""")
def frequent_joints(spark, sf_dir):
    """Combinations of two marginals and the ten most frequent nations that independence makes more than 100."""
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    nations = _shares(c.join(n, c.c_nationkey == n.n_nationkey), "n_name")
    marginals = {"segment": _shares(c, "c_mktsegment"), "status": _shares(table(spark, sf_dir, "orders"), "o_orderstatus"), "nation": census.most_frequent(nations, 10)}
    return census.independent_joints(marginals, 150_000, least=100)


@register("""SELECT page_id, md5(CASE WHEN text <> '' THEN text WHEN html IS NULL THEN '' WHEN url <> '' THEN concat('# ', url, chr(10), chr(10), html) ELSE html END) AS text_md5
FROM pages LEFT JOIN documents ON doc_id = page_id""")
def record_texts(spark, sf_dir):
    """Each page's record text: the document's of its number, else the page under its address."""
    docs, pages = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "pages")
    both = pages.join(docs, pages.page_id == docs.doc_id, "left")
    return both.select("page_id", F.md5(records.record_text(F.col("text"), F.col("url"), F.col("html"))).alias("text_md5"))


@register("SELECT 'wiki_' || page_id AS id, md5(html) AS text_md5 FROM pages WHERE html <> '' AND page_id NOT IN (SELECT doc_id FROM labels)")
def numbered_samples(spark, sf_dir):
    """Pages as samples under ids that no labelled document has."""
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").alias("ord"), F.col("html").alias("text"))
    taken = table(spark, sf_dir, "labels").select(F.concat(F.lit("wiki_"), F.col("doc_id").cast("string")).alias("id"))
    return records.numbered(records.samples(pages).drop("id"), taken).select("id", F.md5("text").alias("text_md5"))


@register(f"WITH {_R} SELECT id, k, quasi FROM (SELECT id, quasi, unnest([{', '.join(map(str, fixed.K_LIST))}]) AS k, k_lower FROM r WHERE llm_used) WHERE k_lower < k")
def uncertain_results(spark, sf_dir):
    """Results kept local, by minimum k, that a model was asked about, as the export of undecided ones has them."""
    rows = evaluate.per_k(results(spark, sf_dir), fixed.K_LIST, keep=("quasi", "llm_used"))
    return records.undecided(rows.withColumn("gate_decision", records.decision_of_tier(F.col("tier"), F.col("llm_used"))), ["id", "k", "quasi"])
