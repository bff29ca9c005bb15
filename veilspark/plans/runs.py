"""Registered queries of runs: state, policies, quotas, shuffles, readers of result files and responses, measures; and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import fixed
from ..functions.spans import let
from ..operators import census, corpus, evaluate, gate, measure, pii, policy, shuffle, state
from ..operators.scratch import shared_folder, written
from ..sources import records, scan
from ..streaming import incremental
from . import queries as base
from . import span_sql
from .queries import _sql_count, register, rounded, table

_DIRECT = f"({_sql_count(fixed.PII['EMAIL_ADDRESS'][0])} + {_sql_count(fixed.PII['PHONE_NUMBER'][0])})"
_WORDS = r"len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))"


def _decisions(k: int):
    """A run's work: words as the estimate of k, identifiers, tier."""

    def work(samples):
        direct = F.aggregate(pii.counts(F.col("text"), ["EMAIL_ADDRESS", "PHONE_NUMBER"]), F.lit(0).cast("long"), lambda a, x: a + x["n"])
        rows = samples.select("hash", gate.text_features(F.col("text"))[1], direct.alias("direct"))
        return rows.withColumns({"k": F.lit(k), "tier": F.when(F.col("word_count") < k, 3).when(F.col("direct") > 0, 2).otherwise(1)})

    return work


@register(f"""WITH old AS (SELECT DISTINCT substr(sha256(source || ':' || CASE WHEN lang = 'en' THEN text || '.' ELSE text END), 1, 16) AS hash FROM documents),
s AS (SELECT DISTINCT ON (hash) substr(sha256(source || ':' || text), 1, 16) AS hash, {_WORDS} AS word_count, {_DIRECT}::BIGINT AS direct FROM documents),
r AS (SELECT s.*, 5 AS k, CASE WHEN hash IN (SELECT hash FROM old) THEN 1 ELSE 2 END AS worked FROM s UNION ALL SELECT s.*, 20, 3 FROM s)
SELECT hash, k, word_count, direct, CASE WHEN word_count < k THEN 3 WHEN direct > 0 THEN 2 ELSE 1 END AS tier, worked FROM r""")
def resumed_state(spark, sf_dir):
    """Runs over a state: older English texts, then the texts as they are (only changed ones are worked again), then another k (all are)."""
    docs = table(spark, sf_dir, "documents")
    hashed = lambda text: docs.withColumn("text", text).select("text", corpus.sample_hash(F.col("source"), F.col("text")).alias("hash"))
    older, now = hashed(F.when(F.col("lang") == "en", F.concat("text", F.lit("."))).otherwise(F.col("text"))), hashed(F.col("text"))
    own = state.StateTable(spark, shared_folder(spark, "state"), keep=2)
    state.resume(older, _decisions(5), own, {"k": 5})
    first = state.resume(now, _decisions(5), own, {"k": 5})
    return first.unionByName(state.resume(now, _decisions(20), own, {"k": 20})).select("hash", "k", "word_count", "direct", "tier", "worked")


_PHONES = span_sql.found(fixed.PII["PHONE_NUMBER"][0])


@register(f"""WITH {span_sql.PLAIN}, p AS (SELECT * FROM {_PHONES}), m AS (SELECT * FROM {span_sql.found(fixed.PII['EMAIL_ADDRESS'][0])}),
l AS (SELECT p.doc_id, p.start::INT AS start, p.stop::INT AS stop, p.start::INT + coalesce((SELECT sum(length('[EMAIL_ADDRESS]') - (m.stop - m.start)) FROM m WHERE m.doc_id = p.doc_id AND m.stop <= p.start), 0)::INT AS masked_start FROM p
      WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.doc_id = p.doc_id AND m.start < p.stop AND p.start < m.stop))
SELECT doc_id, 'PHONE_NUMBER' AS entity_type, start, stop AS "end", masked_start, count(*) OVER (PARTITION BY doc_id) || ' direct identifiers left unmasked' AS hard_stop FROM l""")
def residual_identifiers(spark, sf_dir):
    """Phone numbers that a masking of addresses alone leaves, found in the masked text and placed in the source, and the reason to keep the text local."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = pii.merged(pii.evidence(F.col("text"), ["EMAIL_ADDRESS"]))
    left = pii.with_residual(docs, spans, ["PHONE_NUMBER"])
    rows = left.select("doc_id", F.size("left").alias("n"), F.explode_outer("left").alias("s")).where("s is not null")
    rows = rows.withColumns({"k_lower": F.lit(100.0), "method": F.lit("empirical_joint")})
    reason = F.get(gate.hard_stops(residual=F.col("n")), F.lit(0))
    return rows.select("doc_id", "s.entity_type", "s.start", "s.end", F.col("s.m_start").alias("masked_start"), reason.alias("hard_stop"))


#: Deployment (an event type), version, day of January 2024 from which it holds, population (a customer segment), k's, whether a joint estimate is needed.
_POLICIES = [
    ("click", "1.0", 1, "BUILDING", 5, 20, True), ("click", "1.1", 12, "BUILDING", 10, 40, False), ("click", "2.0", 21, "MACHINERY", 2, 10, True), ("view", "1.0", 5, "AUTOMOBILE", 20, 30, True),
    ("view", "1.5", 5, "FURNITURE", 3, 15, False), ("error", "1.0", 10, "nobody", 5, 20, True), ("signup", "3.0", 2, "HOUSEHOLD", None, 8, None),
]


@register(f"""WITH p AS (SELECT * FROM (VALUES {", ".join(f"('{d}', '{v}', make_timestamp(2024, 1, {day}, 0, 0, 0), '{pop}', {'NULL' if a is None else a}, {b}, {'NULL' if c is None else str(c).lower()})" for d, v, day, pop, a, b, c in _POLICIES)}) t(deployment, version, valid_from, population, k_min, k_safe, need)
  QUALIFY row_number() OVER (PARTITION BY deployment, valid_from ORDER BY version DESC) = 1),
e AS (SELECT event_id, e.version AS v, coalesce(e.version, 'default') AS policy_version, coalesce(population, 'none') AS population, coalesce(k_min, 5) AS k_min, coalesce(k_safe, 20) AS k_safe, coalesce(need, true) AS need,
  floor(value) AS f, (props::JSON ->> 'k')::INT AS quasi FROM (SELECT events.*, p.* EXCLUDE (deployment) FROM events ASOF LEFT JOIN p ON event_type = deployment AND ts >= valid_from) e),
s AS (SELECT c_mktsegment AS population, count(*) AS size FROM customer GROUP BY 1),
x AS (SELECT e.*, CASE WHEN s.size IS NOT NULL THEN f END AS k FROM e LEFT JOIN s USING (population)),
g AS (SELECT *, CASE WHEN k < k_min THEN 'UNSAFE' WHEN k IS NULL AND need THEN 'UNSAFE' WHEN quasi >= 90 THEN 'UNCERTAIN' WHEN quasi % 10 >= 5 AND k IS NULL THEN 'UNCERTAIN' WHEN k >= k_safe THEN 'SAFE' WHEN quasi % 10 <= 2 THEN 'SAFE' ELSE 'UNCERTAIN' END AS d, (k < k_min) IS TRUE OR (k IS NULL AND need) AS hard FROM x)
SELECT policy_version, population, k_min, k_safe, d AS gate_decision, CASE WHEN hard THEN 3 WHEN d = 'SAFE' THEN 1 WHEN d = 'UNSAFE' THEN 3 ELSE 2 END AS tier, count(*) AS n FROM g GROUP BY ALL""")
def policy_decisions(spark, sf_dir):
    """Events routed under the policy of their type that held at their time, with k from a value, where the policy's population is known."""
    rules = policy.policies(spark, [(d, v, None, pop, a, b, c) for d, v, _, pop, a, b, c in _POLICIES]).drop("valid_from")
    days = spark.createDataFrame([(d, v, day) for d, v, day, *_ in _POLICIES], "deployment string, policy_version string, day int")
    rules = rules.join(days, ["deployment", "policy_version"]).withColumn("valid_from", F.make_timestamp_ntz(F.lit(2024), F.lit(1), "day", F.lit(0), F.lit(0), F.lit(0)).cast("timestamp")).drop("day")
    quasi = F.get_json_object("props", "$.k").cast("int")
    events = table(spark, sf_dir, "events").select(F.col("event_type").alias("deployment"), F.col("ts").cast("timestamp").alias("at"), F.floor("value").cast("double").alias("own_k"), quasi.alias("quasi"))
    sizes = table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("population_id")).agg(F.count("*").alias("total_size"))
    rows = policy.with_population(policy.governed(events, rules), sizes)
    k = F.when(F.col("population_size").isNotNull(), F.col("own_k"))
    features = rows.withColumns({
        "k_lower": k, "method": F.when(k.isNotNull(), "empirical_joint").otherwise("unavailable"), "date_count": F.when(F.col("quasi") >= 90, 3).otherwise(0), "qi_count": F.col("quasi") % 10,
        "contextual_count": F.lit(0), "word_count": F.lit(1000), "disagreement": F.lit(False), "rare": F.lit(False), "pii_count": F.lit(0),
    })
    out = gate.route(features, "k_minimum", "k_safe_threshold", "require_joint_estimate")
    keys = ["policy_version", F.col("reference_population").alias("population"), F.col("k_minimum").alias("k_min"), F.col("k_safe_threshold").alias("k_safe"), "gate_decision", "tier"]
    return out.groupBy(*keys).agg(F.count("*").alias("n"))


def _articles(rows):
    return corpus.good_articles(rows.withColumn("title", F.col("source")))


text_of = span_sql.text
_SAMPLE = "(source || ' ' || substr(text, 1, 2000))"
_any = lambda on, patterns, case="(?i)": "(" + " OR ".join(f"regexp_matches({on}, {text_of(case + p)})" for p in patterns) + ")"
#: What stands behind a full stop and a space is no name: such a place is matched first, and gives none.
_NAME = r"[.!?]\s[A-Z]|\b([A-Z][a-z]{1,15})\s+([A-Z][a-z]{1,15})\b"
_NO_NAMES = "[" + ", ".join(map(text_of, fixed.NO_NAMES)) + "]"
_PERSON = f"""(regexp_matches(lower({_SAMPLE}), {text_of(fixed.PRONOUNS + '|' + chr(92) + 'b(?:' + '|'.join(fixed.PERSON_WORDS) + ')' + chr(92) + 'b')}) OR regexp_matches({_SAMPLE}, {text_of('(?i)' + fixed.HONORIFICS)})
  OR len(list_filter(list_zip(regexp_extract_all({_SAMPLE}, {text_of(_NAME)}, 1), regexp_extract_all({_SAMPLE}, {text_of(_NAME)}, 2)), lambda x: x[1] <> '' AND NOT list_contains({_NO_NAMES}, x[1]) AND NOT list_contains({_NO_NAMES}, x[2]))) > 0)"""
_CHUNK = "substr(text, 1, 1200)"
_FIRST = f"split_part({_CHUNK}, '.', 1)"
_BIOGRAPHY = f"({_any('source', fixed.TITLES)} OR {_any(_CHUNK, fixed.BIOGRAPHY)} OR (regexp_matches({_FIRST}, {text_of(fixed.SENTENCE)}) AND regexp_matches({_FIRST}, {text_of('(?i)' + fixed.SENTENCE_WORDS)})))"
_SHORT = r"CASE WHEN length(text) > 4000 THEN regexp_replace(substr(text, 1, 4000), '(?s) [^ ]*$', '') || '...' ELSE text END"
GOOD = f"length(text) >= 1000 AND NOT {_PERSON} AND NOT {_BIOGRAPHY} AND NOT {_any('text', fixed.SENSITIVE)}"
_DOCS = r"ds AS (SELECT doc_id, source, regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}]', '_', 'g') AS text, text AS raw FROM documents)"
base.ORACLES["good_articles"] = f"WITH {_DOCS} SELECT doc_id, md5({_SHORT.replace('text', 'raw')}) AS text_md5 FROM ds WHERE {GOOD}"


@register(f"WITH {_DOCS}, o AS (SELECT *, row_number() OVER () AS nr FROM ds) SELECT doc_id, (row_number() OVER (ORDER BY nr) - 1)::BIGINT AS ordinal, md5(raw) AS text_md5 FROM o WHERE {GOOD} ORDER BY nr LIMIT 40")
def article_quota(spark, sf_dir):
    """The first 40 good articles in file order; files behind the last of them aren't read."""
    rows, _ = scan.first_good(spark, f"{sf_dir}/documents.parquet", _articles, 40)
    return rows.select("doc_id", "ordinal", F.md5("text").alias("text_md5"))


@register("SELECT doc_id, (row_number() OVER (ORDER BY sha256('42' || chr(31) || doc_id::VARCHAR)) - 1)::BIGINT AS position FROM documents")
def shuffled_documents(spark, sf_dir):
    """Each document's place in a permutation with a seed."""
    return shuffle.shuffled(table(spark, sf_dir, "documents").select("doc_id"), 42, ["doc_id"])


@register(f"""WITH t AS ({base.ORACLES['tiered_k']}), v AS (SELECT k_lower::DOUBLE AS v FROM t WHERE k_lower IS NOT NULL), f AS (SELECT v, min(v) OVER () AS a, max(v) OVER () AS b FROM v WHERE isfinite(v)),
c AS (SELECT least(29, floor((v - a) / ((b - a) / 30)))::INT AS bin, count(*) AS n FROM f GROUP BY 1), e AS (SELECT DISTINCT a, b FROM f)
SELECT i.bin::INT AS bin, round(a + i.bin * ((b - a) / 30), 6) AS low, round(CASE WHEN i.bin = 29 THEN b ELSE a + (i.bin + 1) * ((b - a) / 30) END, 6) AS high, coalesce(c.n, 0) AS n FROM e, (SELECT unnest(range(30)) AS bin) i LEFT JOIN c ON c.bin = i.bin
UNION ALL SELECT -1, NULL, NULL, count(*) FROM v WHERE NOT isfinite(v) HAVING count(*) > 0""")
def k_histogram(spark, sf_dir):
    """The lower bounds of k in 30 bins."""
    return rounded(measure.histogram(base.tiered_k(spark, sf_dir), "k_lower"))


@register(f"WITH {base._R} SELECT count(*) AS n, count(*) FILTER (wiki) AS wiki_n, count(*) FILTER (expected) AS critical_n, round(avg(direct), 6) AS mean_direct, round(avg(quasi), 6) AS mean_quasi, avg(k_lower) AS mean_k_lower FROM r")
def result_means(spark, sf_dir):
    """Means over all results, infinite k too."""
    return rounded(measure.means(base.results(spark, sf_dir), ["direct", "quasi", "k_lower"]))


@register(f"""WITH {base._F}
SELECT kind, name, n FROM (SELECT 'total' AS kind, CASE WHEN g = 2 THEN 'marginals' ELSE 'joints' END AS name, count(*) AS n FROM (SELECT grouping(balance) + grouping(nation) + grouping(segment) AS g FROM f GROUP BY {base._SETS}) GROUP BY 2
UNION ALL SELECT 'type', type, count(*) FROM (SELECT DISTINCT 'balance' AS type, balance FROM f UNION ALL SELECT DISTINCT 'nation', nation FROM f UNION ALL SELECT DISTINCT 'segment', segment FROM f) GROUP BY 2)""")
def store_summary(spark, sf_dir):
    """How many marginals and joints a frequency table holds, and marginals by type."""
    return measure.store_summary(base.frequency.frequency_table(base._facts(spark, sf_dir), base._FACTS))


_SWEPT = {s: s for s in ("tau_review", "tau_block", "k_min", "w_direct", "w_quasi")}


@register(base._points_sql("a") + f" SELECT sweep, round(CASE sweep {' '.join(f'''WHEN '{s}' THEN {s}''' for s in _SWEPT)} END, 6) AS value, point, f1 FROM pts JOIN s USING (sweep, point) WHERE sweep IN ({', '.join(f'''{chr(39)}{s}{chr(39)}''' for s in _SWEPT)})")
def swept_points(spark, sf_dir):
    """F1 along each one-dimensional sweep, by the value of what it varies."""
    settings = evaluate.grid(spark, evaluate.SWEEPS["a"]()).select("sweep", "point", *_SWEPT)
    points = rounded(base._points(spark, sf_dir, "a").select("sweep", "point", "f1"))
    return rounded(measure.by_swept(points.join(F.broadcast(settings), ["sweep", "point"]), _SWEPT).select("sweep", "value", "point", "f1"))


@register(f"WITH {base._R}, u AS (SELECT id, k, CASE WHEN k_lower < k THEN 3 WHEN direct > 0 THEN 2 ELSE 1 END AS tier FROM (SELECT *, unnest([5, 20]) AS k FROM r)) SELECT id, k, tier, id::VARCHAR AS sample_name FROM u")
def result_files(spark, sf_dir):
    """Results written as files of two versions, one JSON array a part and one record a line, and read again: tiers by k."""
    r = base.results(spark, sf_dir)
    tier = lambda k: F.when(F.col("k_lower") < k, 3).when(F.col("direct") > 0, 2).otherwise(1)
    tiers = F.create_map(F.lit("5"), tier(5), F.lit("20"), tier(20))
    rows = written(r.select(F.col("id").cast("string").alias("sample_name"), "tier", "llm_used", tiers.alias("tiers_by_k"), (F.col("wiki")).alias("other")), "results")
    folder = shared_folder(spark, "result-files")
    records.write_json(rows.where("other").drop("other"), f"{folder}/lines")
    records.write_json(rows.where("not other").select("sample_name", "tier", "tiers_by_k"), f"{folder}/older")
    both = [scan.read_results(spark, f"{folder}/{name}")[0] for name in ("lines", "older")]
    return both[0].unionByName(both[1]).select(F.col("sample_name").cast("long").alias("id"), "sample_name", F.explode("tiers_by_k").alias("k", "tier"))


@register(f"""WITH c AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'employed_at_work' WHEN '2-HIGH' THEN 'unemployed' WHEN '3-MEDIUM' THEN 'armed_forces_at_work' WHEN '5-LOW' THEN 'not_in_labor_force' END AS qi_value, (SELECT count(*) FROM orders) AS t FROM orders)
SELECT qi_value, count, {base._wilson_sql('count', 't')} FROM (SELECT qi_value, t, count(*) AS count FROM c WHERE qi_value IS NOT NULL GROUP BY ALL)""")
def response_marginals(spark, sf_dir):
    """Counts as the response of a service (a header and a row), read and summed up over a universe with the published variables."""
    variables = dict(zip(["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"], fixed.EMPLOYMENT_VARIABLES, strict=True))
    counts = table(spark, sf_dir, "orders").agg(F.count("*").alias(fixed.EMPLOYMENT_UNIVERSE), *(F.count_if(F.col("o_orderpriority") == p).alias(v) for p, v in variables.items()))
    names = counts.columns
    folder = f"{shared_folder(spark, 'response')}/national"
    matrix = F.to_json(F.array(F.array(*map(F.lit, names)), F.array(*(F.col(n).cast("string") for n in names))))
    counts.select(matrix.alias("value")).write.text(folder)
    rows = scan.counts_of(scan.read_matrix(spark, folder), names).select("variable", "count")
    return rounded(census.universe_marginals(rows, fixed.EMPLOYMENT_VARIABLES, fixed.EMPLOYMENT_UNIVERSE, "employment_status", "response").select(*base._MARGINAL))


@register(f"SELECT stage, rows, characters FROM (SELECT 'read' AS stage, count(*) AS rows, sum(length(text)) AS characters FROM documents UNION ALL SELECT 'masked', count(*), sum(length(masked)) FROM (WITH {span_sql.PLAIN}, {span_sql.MERGED} SELECT masked FROM {span_sql.masked(span_sql._LABELS)}) UNION ALL SELECT 'long', count(*), sum(length(text)) FROM documents WHERE length(text) >= 1000)")
def stage_measures(spark, sf_dir):
    """Rows and characters that each stage of a run saw, observed while it was written."""
    stages = measure.Stages(spark)
    length = lambda: F.sum(F.length("text"))
    docs = stages.run("read", table(spark, sf_dir, "documents").select("doc_id", "text"), characters=length())
    stages.run("masked", docs.select("doc_id", let(pii.merged(pii.evidence(F.col("text"))), lambda spans: pii.masked(F.col("text"), spans)).alias("text")), characters=length())
    stages.run("long", docs.where(F.length("text") >= 1000), characters=length())
    return stages.table().select("stage", "rows", F.col("measures")["characters"].cast("long").alias("characters"))


#: Texts have about so many bytes a file, and a batch takes so many files at most: a larger input has more batches, not larger tasks.
_FILE_BYTES, _BATCH_FILES = 32 << 20, 16


@register("SELECT lang, count(*) AS n, sum(length(text))::BIGINT AS characters FROM documents GROUP BY lang")
def stopped_stream(spark, sf_dir):
    """Documents streamed in bounded batches: a run that stops after two of them, and one that goes on to the end; each text once."""
    docs = table(spark, sf_dir, "documents").select("lang", "text")
    folder = shared_folder(spark, "batches")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0  # one row
    files = max(5, -(-size // _FILE_BYTES))
    docs.repartition(files).write.parquet(f"{folder}/in")
    work = lambda rows: rows.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("characters"))
    for most in (2, None):
        incremental.run_incremental(spark, f"{folder}/in", docs.schema, work, f"{folder}/out", f"{folder}/state", files_a_batch=min(_BATCH_FILES, files // 5), most_batches=most)
    return spark.read.parquet(f"{folder}/out").groupBy("lang").agg(F.sum("n").alias("n"), F.sum("characters").alias("characters"))


_NL = "chr(10)"
_PARTS = [
    "'---'", _NL, "'# name: '", "CASE WHEN role = 'system' THEN 'wiki_' ELSE 'RAT-' END", "conv_id", "' (difficulty='", "turn", "', '", "role", "')'", _NL, "'# expected_critical: '", "CASE WHEN role = 'user' THEN 'true' ELSE 'false' END", _NL,
    "'# rat_difficulty: '", "turn", _NL, "'# rat_scenario: '", "role", _NL, "'# rat_direct_ids: [''role'', ''turn'']'", _NL, "'# rat_indirect_ids: ['''", "role", "''']'", _NL, _NL, "'[START OF TRANSCRIPT]'", _NL, "text", _NL, "'[END OF TRANSCRIPT]'", _NL,
]


@register(f"SELECT conv_id, turn, md5(concat({', '.join(_PARTS)})) AS block_md5 FROM conversations")
def sample_blocks(spark, sf_dir):
    """Turns as samples in blocks with their metadata: names, difficulty, scenario, identifiers by map and by list."""
    turns = table(spark, sf_dir, "conversations")
    own = F.when(F.col("role") == "system", F.concat(F.lit("wiki_"), F.col("conv_id").cast("string"))).otherwise(F.col("conv_id").cast("string"))
    samples = turns.select(
        "conv_id", "turn", own.alias("id"), "text", F.col("turn").alias("difficulty"), F.col("role").alias("scenario"), (F.col("role") == "user").alias("expected_critical"),
        F.create_map(F.lit("role"), F.col("role"), F.lit("turn"), F.col("turn").cast("string")).alias("direct_identifiers"), F.array("role").alias("indirect_identifiers"),
    )
    return samples.select("conv_id", "turn", F.md5(corpus.sample_block(samples)).alias("block_md5"))
