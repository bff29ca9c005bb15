"""SQL of the privacy queries: spans, their merge, masks, quasi-identifiers and the gate's features, over the table documents."""

from __future__ import annotations

from ..functions import fixed
from ..operators import gate


def text(value: str | None) -> str:
    return "NULL" if value is None else "'" + value.replace("'", "''") + "'"


def _case(on: str, values: dict[str, str]) -> str:
    return f"CASE {on} " + " ".join(f"WHEN {text(k)} THEN {text(v)}" for k, v in values.items()) + " END"


def _list(values) -> str:
    return "(" + ", ".join(map(text, values)) + ")"


#: Words end at ASCII letters alone here: letters, digits and marks beyond ASCII become a sign that belongs to words and keeps all places.
PLAIN = r"plain AS MATERIALIZED (SELECT doc_id, regexp_replace(text, '[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]|[^\x00-\x7F\P{M}]', '_', 'g') AS text FROM documents)"


def found(pattern: str, group: int = 0, ignore_case: bool = True) -> str:
    """doc_id, i, start, stop, value, g of all matches: what lies between them gives their places."""
    p = text(("(?i)" if ignore_case else "") + pattern)
    return (
        f"(SELECT doc_id, i, s AS start, s + length(v[i + 1]) AS stop, v[i + 1] AS value, w[i + 1] AS g FROM (SELECT *, "
        f"coalesce(list_sum(list_transform(gaps[1:i + 1], lambda x: length(x))), 0)::BIGINT + coalesce(list_sum(list_transform(v[1:i], lambda x: length(x))), 0)::BIGINT AS s FROM ("
        f"SELECT *, unnest(range(len(v))) AS i FROM (SELECT doc_id, regexp_extract_all(text, {p}) AS v, regexp_extract_all(text, {p}, {group}) AS w, regexp_split_to_array(text, {p}) AS gaps "
        f"FROM {'documents' if '@' in pattern else 'plain'} WHERE regexp_matches(text, {p})))))"
    )


def _category(entity: str) -> int:
    return 0 if entity in fixed.DIRECT_TYPES else 1 if entity in fixed.STRONG_TYPES else 3 if entity in fixed.CONTEXTUAL_TYPES else 2


_PATTERNS = [(entity, p) for entity, patterns in fixed.PII.items() for p in patterns]
EVIDENCE = " UNION ALL ".join(f"SELECT doc_id, {k} AS pat, i, start, stop, {text(e)} AS entity_type, {_category(e)} AS prio FROM {found(p)}" for k, (e, p) in enumerate(_PATTERNS))
_NAMES = "CASE prio " + " ".join(f"WHEN {i} THEN {text(c)}" for i, c in enumerate(fixed.CATEGORIES)) + " END"
#: Overlapping spans as one: the first of the strongest category names it.
MERGED = f"""ev AS ({EVIDENCE}),
ev1 AS (SELECT *, row_number() OVER w AS rn, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, pat, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM ev WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop, pat, i)),
ev2 AS (SELECT *, sum(CASE WHEN upto IS NULL OR start >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS island FROM ev1),
merged AS (SELECT doc_id, min(start)::INT AS start, max(stop)::INT AS stop, arg_min(entity_type, prio * 1000000 + rn) AS entity_type, min(prio) AS prio, count(*)::INT AS n, max(rn) - min(prio * 1000000 + rn) % 1000000 AS behind FROM ev2 GROUP BY doc_id, island)"""


def masked(spans: str) -> str:
    """doc_id, masked of every document from spans (doc_id, start, stop, label)."""
    return (
        f"(SELECT d.doc_id, coalesce(string_agg(substr(text, prev + 1, start - prev) || label, '' ORDER BY start), '') || substr(text, coalesce(max(stop), 0) + 1) AS masked FROM documents d LEFT JOIN "
        f"(SELECT *, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS prev FROM ({spans})) m ON d.doc_id = m.doc_id GROUP BY d.doc_id, text)"
    )


PII_MERGED = f"""WITH {PLAIN}, {MERGED} SELECT doc_id, start, stop AS "end", entity_type, {_NAMES} AS category, 'custom_regex' AS detector, {fixed.PII_SCORE}::DOUBLE AS score, n, array_to_string(list_transform(range(behind), lambda x: 'custom_regex'), ',') AS confirmed_by FROM merged"""
_LABELS = "SELECT doc_id, start, stop, '[' || upper(entity_type) || ']' AS label FROM merged"
PII_MASKED = f"""WITH {PLAIN}, {MERGED} SELECT a.doc_id, md5(a.masked) AS masked_md5, md5(b.masked) AS pii_masked_md5, round((length(text) - length(a.masked)) / greatest(length(text), 1), 6) AS masking_ratio
FROM {masked(_LABELS + ' WHERE prio < 2')} a JOIN {masked(_LABELS)} b ON a.doc_id = b.doc_id JOIN documents d ON d.doc_id = a.doc_id"""


def _quasi_parts() -> list[str]:
    """One SELECT for each pattern or word table, in the order of detection: doc_id, k, i, qi_type, value, start, stop, confidence, granularity, unseen, detector."""
    parts: list[str] = []

    def add(kind: str, rows: str, value: str, confidence: float, granularity: str = "category", unseen: str = "false", detector: str = "regex", where: str = "true") -> None:
        parts.append(f"SELECT doc_id, {len(parts)} AS k, i, {text(kind)} AS qi_type, {value} AS value, start, stop, {confidence}::DOUBLE AS confidence, {text(granularity)} AS granularity, {unseen} AS unseen, {text(detector)} AS detector FROM {rows} WHERE {where}")

    def words(values: dict[str, str]) -> str:
        table = ", ".join(f"({i}, {text(w)}, {text(v)})" for i, (w, v) in enumerate(values.items()))
        return f"(SELECT doc_id, w.i, instr(lower(text), w.w) - 1 AS start, instr(lower(text), w.w) - 1 + length(w.w) AS stop, w.v AS g FROM documents, (VALUES {table}) w(i, w, v) WHERE contains(lower(text), w.w))"

    bucket = "CASE WHEN g::INT <= 120 THEN (g::INT // 5 * 5) || '-' || (g::INT // 5 * 5 + 4) END"
    for p in fixed.AGE:
        add("age", found(p, 1), bucket, 0.9, "5yr_bucket")
    for p in fixed.SEX:
        add("sex", found(p, 1), _case("lower(g)", fixed.SEX_VALUES), 0.85)
    add("marital_status", found(fixed.MARITAL, 1), _case("lower(g)", fixed.MARITAL_VALUES), 0.82)
    add("marital_status", found(fixed.SPOUSE), "'married'", 0.8)
    for p, v in fixed.CITIZENSHIP:
        # No look-ahead here: what it rules out is matched with what follows and left out.
        add("citizenship", found(p.replace(r"(?!\s+citizen)", r"(?:\s+citizen\w*)?")), text(v), 0.85, where=r"NOT regexp_matches(value, '(?i)born\s+citizen')" if "(?!" in p else "true")
    add("race", found(fixed.RACE, 1), f"coalesce({_case('lower(g)', fixed.RACE_VALUES)}, replace(lower(g), ' ', '_'))", 0.78, unseen=f"lower(g) IN {_list(fixed.RACE_UNSEEN)}")
    add("state", words(fixed.STATES), "g", 0.88, "state", detector="gazetteer")
    add("state", found(fixed.STATE_CODE, 1, False), f"CASE WHEN g IN {_list(sorted(set(fixed.STATES.values())))} THEN g END", 0.75, "state")
    add("occupation", f"(SELECT * FROM {words(fixed.OCCUPATIONS)} QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY i) = 1)", "g", 0.8, "occupation_broad", detector="keyword")
    for kind, patterns, confidence, granularity in (("date", fixed.DATES, 0.85, "full_date"), ("time", fixed.TIMES, 0.8, "time"), ("datetime", fixed.STAMP_FORMS, 0.9, "datetime")):
        for p in patterns:
            add(kind, found(p), "value", confidence, granularity)
    for kind, terms, granularity in (("occupation", fixed.RARE_OCCUPATIONS, "specific"), ("condition", fixed.RARE_DISEASES, "category")):
        for term in terms:
            add(kind, words({term: term if kind == "occupation" else term.replace(" ", "_").replace("-", "_")}), "g", 0.85, granularity, detector="gazetteer")
    for kind, table, confidence in (("education", fixed.EDUCATION, 0.8), ("employment", fixed.EMPLOYMENT, 0.82)):
        for p, v in table:
            add(kind, found(p), text(v), confidence, where="i = 0")
    return parts


_AT = "instr(lower(text), replace(lower(value), '_', ' '))"
QUASI = f"""q0 AS ({" UNION ALL ".join(_quasi_parts())}),
q1 AS (SELECT doc_id, qi_type, value, min(k * 1000000 + i) AS ord, arg_min(start, k * 1000000 + i)::INT AS start, arg_min(stop, k * 1000000 + i)::INT AS stop, max(confidence) AS confidence, arg_min(granularity, k * 1000000 + i) AS granularity,
  arg_min(unseen, k * 1000000 + i) AS unseen, arg_min(detector, k * 1000000 + i) AS detector, list_sort(list_distinct(list(detector))) AS all_detectors FROM q0 WHERE value IS NOT NULL GROUP BY ALL),
quasi AS (SELECT q1.*, array_to_string(list_filter(all_detectors, lambda x: x <> detector), ',') AS agreement,
  CASE WHEN {_AT} > 1 AND regexp_matches(substr(lower(text), greatest(1, {_AT} - 50), least(50, {_AT} - 1)), {text('(?i)' + fixed.NEGATION)}) THEN 'negated' ELSE 'present' END AS assertion FROM q1 JOIN documents USING (doc_id))"""
QUASI_IDENTIFIERS = f'WITH {PLAIN}, {QUASI} SELECT doc_id, qi_type, value, start, stop AS "end", confidence, granularity, unseen, agreement, assertion FROM quasi'
_PAIRS = """pairs AS (SELECT doc_id, qi_type AS t, arg_max(value, ord) AS v FROM quasi WHERE assertion = 'present' AND value <> '' GROUP BY doc_id, qi_type)"""
QUASI_KEYS = rf"""WITH {PLAIN}, {QUASI}, {_PAIRS} SELECT doc_id, string_agg(t, ',' ORDER BY t) AS types, string_agg(t || '=' || regexp_replace(v, '([\\|=])', '\\\1', 'g'), '|' ORDER BY t) AS key,
  bool_or(EXISTS (SELECT 1 FROM quasi x WHERE x.doc_id = pairs.doc_id AND x.unseen AND x.assertion = 'present')) AS has_unseen FROM pairs GROUP BY doc_id"""
_ALL = """a0 AS (SELECT doc_id, start, stop, 0 AS o, upper(entity_type) AS label FROM merged UNION ALL SELECT doc_id, start, stop, 1, upper(qi_type) FROM quasi),
a1 AS (SELECT *, row_number() OVER w AS rn, max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop, o, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM a0 WINDOW w AS (PARTITION BY doc_id ORDER BY start, stop, o, label)),
a2 AS (SELECT *, sum(CASE WHEN upto IS NULL OR start >= upto THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY rn) AS island FROM a1)"""
EVERYTHING_MASKED = f"""WITH {PLAIN}, {MERGED}, {QUASI}, {_ALL} SELECT doc_id, md5(masked) AS masked_md5 FROM {masked("SELECT doc_id, min(start) AS start, max(stop) AS stop, '[' || arg_min(label, rn) || ']' AS label FROM a2 GROUP BY doc_id, island")}"""
_RARE = " OR ".join(f"contains(lower(value), {text(t)})" for t in gate.RARE_CONDITIONS)
FEATURES = rf"""{MERGED}, {QUASI},
pc AS (SELECT doc_id, count(*) AS pii, {", ".join(f"count(*) FILTER (prio = {i}) AS c{i}" for i in range(4))} FROM merged GROUP BY doc_id),
qc AS (SELECT doc_id, count(*) AS qis, count(*) FILTER (qi_type = 'date') AS dates, bool_or(qi_type = 'condition' AND ({_RARE})) AS disease, bool_or(qi_type = 'occupation' AND lower(value) IN {_list(gate.RARE_OCCUPATIONS)}) AS occupation, bool_or(unseen AND assertion = 'present') AS unseen FROM quasi GROUP BY doc_id),
feats AS (SELECT doc_id, text, length(text)::INT AS text_length, len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> ''))::INT AS word_count, length(regexp_replace(text, '[^.!?]', '', 'g'))::INT AS sentence_count, coalesce(pii, 0)::INT AS pii_count,
  coalesce(c0, 0)::INT AS direct_count, coalesce(c1, 0)::INT AS strong_count, coalesce(c3, 0)::INT AS contextual_count, (coalesce(c2, 0) + coalesce(qis, 0))::INT AS qi_count, coalesce(qis, 0)::INT AS qis_found, coalesce(dates, 0)::INT AS date_count,
  coalesce(disease, false) AS rare_disease, coalesce(occupation, false) AS rare_occupation, coalesce(disease, false) OR coalesce(occupation, false) AS rare, coalesce(unseen, false) AS has_unseen, false AS disagreement, (coalesce(c0, 0) + coalesce(c1, 0))::INT AS mask_count
  FROM documents LEFT JOIN pc USING (doc_id) LEFT JOIN qc USING (doc_id))"""
GATE_FEATURES = f"WITH {PLAIN}, {FEATURES} SELECT * EXCLUDE (text), round(CASE WHEN text_length > 0 THEN least(1.0, mask_count * {float(gate.MASK_LENGTH)} / text_length) ELSE 0 END, 6)::DOUBLE AS mask_ratio FROM feats"
_KEY = r"t || '=' || regexp_replace(v, '([\\|=])', '\\\1', 'g')"
#: k of each document's joint against the joints, pairs and marginals of all documents' own values.
OWN_K = f"""{_PAIRS}, one AS (SELECT doc_id, t, {_KEY} AS key FROM pairs),
two AS (SELECT a.doc_id, a.key || '|' || b.key AS key FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.t < b.t),
three AS (SELECT a.doc_id, a.key || '|' || b.key || '|' || c.key AS key FROM one a JOIN one b ON a.doc_id = b.doc_id AND a.t < b.t JOIN one c ON b.doc_id = c.doc_id AND b.t < c.t),
tab AS (SELECT key, count(*)::DOUBLE AS c, (SELECT count(*)::DOUBLE FROM documents) AS n, count(*) / (SELECT count(*) FROM documents) AS p FROM (SELECT key FROM one UNION ALL SELECT key FROM two UNION ALL SELECT key FROM three) GROUP BY key),
j AS (SELECT doc_id, c, p, n FROM (SELECT doc_id, string_agg(key, '|' ORDER BY t) AS key FROM one GROUP BY doc_id) JOIN tab USING (key)),
pw AS (SELECT doc_id, min(p * n) AS pair FROM two JOIN tab USING (key) GROUP BY doc_id),
mg AS (SELECT doc_id, min(p * n) AS least FROM one JOIN tab USING (key) GROUP BY doc_id),
est AS (SELECT d.doc_id, CASE WHEN mg.least IS NULL THEN 'no_qis' WHEN j.c IS NOT NULL THEN 'empirical_joint' WHEN pair IS NOT NULL THEN 'pairwise_min_bound' ELSE 'min_marginal_bound' END AS method,
  CASE WHEN mg.least IS NULL THEN 'inf'::DOUBLE WHEN j.c IS NOT NULL THEN greatest(0, j.p - 1.96 * sqrt(j.p * (1 - j.p) / j.n)) * j.n WHEN pair IS NOT NULL THEN greatest(1, pair * 0.05) ELSE greatest(1, least * 0.01) END AS k
  FROM documents d LEFT JOIN j ON j.doc_id = d.doc_id LEFT JOIN pw ON pw.doc_id = d.doc_id LEFT JOIN mg ON mg.doc_id = d.doc_id)"""
ROUTED = f"""WITH {PLAIN}, {FEATURES}, {OWN_K},
g0 AS (SELECT f.*, method, k, CASE WHEN k < 5 THEN 'UNSAFE' WHEN date_count >= 3 THEN 'UNCERTAIN' WHEN (qi_count + contextual_count) / greatest(word_count, 1) > 0.1 THEN 'UNCERTAIN' WHEN k >= 20 THEN 'SAFE' WHEN qi_count <= 2 AND NOT rare THEN 'SAFE' ELSE 'UNCERTAIN' END AS g, k < 5 AND method = 'empirical_joint' AS hard FROM feats f JOIN est USING (doc_id)),
g1 AS (SELECT *, CASE WHEN g = 'UNSAFE' AND method IN ('pairwise_min_bound', 'min_marginal_bound') AND k < 5 THEN 'UNCERTAIN' ELSE g END AS gate_decision FROM g0)
SELECT doc_id, substr(sha256(text), 1, 32) AS input_hash, method, round(k, 6) AS k_lower, gate_decision, CASE WHEN hard THEN printf('k_lower %.1f below 5', k) ELSE '' END AS hard_stops, CASE WHEN has_unseen AND NOT hard THEN 'unseen_qi_values' ELSE '' END AS flags, direct_count, qis_found,
  CASE WHEN hard THEN 3 WHEN gate_decision = 'SAFE' THEN CASE WHEN pii_count > 0 THEN 2 ELSE 1 END WHEN gate_decision = 'UNSAFE' THEN 3 ELSE 2 END AS tier FROM g1"""
