import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators import census, corpus, evaluate, frequency, gate, pii, population, quasi
from veilspark.plans import queries
from veilspark.sources import records
from veilspark.streaming import incremental

RANK = {"direct_identifier": 1, "strong_identifier": 2, "quasi_identifier": 3, "contextual": 4}


def test_merge_is_the_fold(spark):
    rng, rows = random.Random(3), []
    for doc in range(200):
        for i in range(rng.randrange(1, 8)):
            a = rng.randrange(20)
            rows.append((doc, a, a + rng.randrange(1, 6), f"T{i}", rng.choice(list(RANK)), f"d{rng.randrange(2)}", rng.random(), i))
    schema = "doc_id long, start int, end int, entity_type string, category string, detector string, score double, ord int"
    got = {(r["doc_id"], r["start"]): (r["end"], r["entity_type"], round(r["score"], 9), r["confirmed_by"]) for r in pii.merge(spark.createDataFrame(rows, schema)).collect()}
    want = {}
    for doc in range(200):
        last = None
        for _, s, e, t, c, d, score, _ in sorted((r for r in rows if r[0] == doc), key=lambda r: (r[1], r[2], r[7])):
            if last and s < last[1]:
                if RANK[c] < RANK[last[3]]:
                    last[2:6] = [t, c, d, max(last[5], score)]
                    last[6] = [last[7]] if last[7] != d else []
                    last[7] = d
                else:
                    last[6].append(d)
                last[1] = max(last[1], e)
            else:
                last = [s, e, t, c, d, score, [], d]
                want[(doc, s)] = last
    assert got == {k: (v[1], v[2], round(v[5], 9), v[6]) for k, v in want.items()}


def test_detection(spark):
    docs = spark.createDataFrame([(1, "SSN 123-45-6789, mail A.b+c@Ex-1.org; call (555) 123-4567. I'm 45, a man; denies being married"), (2, None), (3, "")], "doc_id long, text string")
    found = {(r["entity_type"], r["start"], r["end"]) for r in pii.detect(docs).collect()}
    assert ("US_SSN", 4, 15) in found and any(t == "EMAIL_ADDRESS" for t, _, _ in found)
    masked = {r["doc_id"]: r["m"] for r in docs.select("doc_id", pii.masked(F.col("text"), pii.merged(pii.evidence(F.col("text")))).alias("m")).collect()}
    assert "123-45-6789" not in masked[1] and masked[3] == "" and masked[2] is None
    qi = {(q["qi_type"], q["value"]): q["assertion"] for r in quasi.identify(docs).collect() for q in r["qi"]}
    assert qi[("age", "45-49")] == "present" and qi[("sex", "male")] == "present" and qi[("marital_status", "married")] == "negated"


TEXTS = [
    "SSN 123-45-6789 mail a.b@ex.org MRN 12345678 at 10:30 AM on 01/02/2020 and 2020-01-02T10:30:00Z, call +1 (555) 123-4567",
    "I'm 45 years old, sex: female; she is a registered nurse from Texas, not a citizen. Born on March 3, 2001 in Ohio", "no man, never married; my wife was in school. Aged 130, age 7; AGE 07", "", None, "   ",
    "arkansas, TX and CA; arab and caucasian. A zoologist with cystic fibrosis, Marfan; b.s. and ba degree, at noon", "12:30 12:30 12:30pm 3 o'clock 01/02/2020 01/02/2020 3 May 1999 May 1999 Jan. 3, 1999",
    "é" * 40 + " 7:15 é 555-123-4567 \u017fingle", "unemployed student, retired from the army; active duty; stay-at-home; as ma MS", "ABC123456789 123-45-6789", "MR 1234567 Patient ID: 1234567 x@y.zz",
]


def _finds(pattern, text, flags=re.I):
    return [(m.start(), m.end(), m) for m in re.finditer(pattern, text, flags)]


def _merged(text):
    found = sorted(((a, b, k, i, t) for k, (t, p) in enumerate((t, p) for t, ps in fixed.PII.items() for p in ps) for i, (a, b, _) in enumerate(_finds(p, text))))
    cat = lambda t: 1 if t in fixed.DIRECT_TYPES else 2 if t in fixed.STRONG_TYPES else 4 if t in fixed.CONTEXTUAL_TYPES else 3
    out = []
    for a, b, _, _, t in found:
        if out and a < out[-1][1]:
            last = out[-1]
            out[-1] = (last[0], max(last[1], b), t if cat(t) < cat(last[2]) else last[2])
        else:
            out.append((a, b, t))
    return out


def _quasi(text):
    """type, value, start, end of what is found, in order: a plain loop over the same fixed values."""
    low, out = text.lower(), []
    add = lambda t, v, a, b: out.append((t, v, a, b)) if v is not None else None
    for p in fixed.AGE:
        for a, b, m in _finds(p, text):
            n = int(m[1])
            add("age", f"{n // 5 * 5}-{n // 5 * 5 + 4}" if n <= 120 else None, a, b)
    for p in fixed.SEX:
        for a, b, m in _finds(p, text):
            add("sex", fixed.SEX_VALUES.get(m[1].lower()), a, b)
    for a, b, m in _finds(fixed.MARITAL, text):
        add("marital_status", fixed.MARITAL_VALUES.get(m[1].lower()), a, b)
    for a, b, _ in _finds(fixed.SPOUSE, text):
        add("marital_status", "married", a, b)
    for p, v in fixed.CITIZENSHIP:
        for a, b, _ in _finds(p, text):
            add("citizenship", v, a, b)
    for a, b, m in _finds(fixed.RACE, text):
        add("race", fixed.RACE_VALUES.get(m[1].lower(), m[1].lower().replace(" ", "_")), a, b)
    for w, v in fixed.STATES.items():
        if w in low:
            add("state", v, low.index(w), low.index(w) + len(w))
    for a, b, m in _finds(fixed.STATE_CODE, text, 0):
        add("state", m[1] if m[1] in fixed.STATES.values() else None, a, b)
    for w, v in fixed.OCCUPATIONS.items():
        if w in low:
            add("occupation", v, low.index(w), low.index(w) + len(w))
            break
    for kind, patterns in (("date", fixed.DATES), ("time", fixed.TIMES), ("datetime", fixed.STAMP_FORMS)):
        for p in patterns:
            for a, b, _ in _finds(p, text):
                add(kind, text[a:b], a, b)
    for kind, terms in (("occupation", fixed.RARE_OCCUPATIONS), ("condition", fixed.RARE_DISEASES)):
        for w in terms:
            if w in low:
                add(kind, w.replace(" ", "_").replace("-", "_"), low.index(w), low.index(w) + len(w))
    for kind, table in (("education", fixed.EDUCATION), ("employment", fixed.EMPLOYMENT)):
        for p, v in table:
            for a, b, _ in _finds(p, text)[:1]:
                add(kind, v, a, b)
    first, seen = [], set()
    for x in out:
        if x[:2] not in seen:
            seen.add(x[:2])
            at = low.find(x[1].lower().replace("_", " "))
            negated = at > 0 and re.search(fixed.NEGATION, text[max(0, at - 50) : at].lower())
            first.append((*x, "negated" if negated else "present"))
    return first


def test_rows_against_plain_python(spark):
    rows = [(None if i % 3 == 0 else 7, i, t) for i, t in enumerate(TEXTS)]
    docs = quasi.identify(spark.createDataFrame(rows, "doc_id long, i int, text string")).withColumn("pii", pii.merged(pii.evidence(F.col("text"))))
    own = gate.features(docs).select("i", "text", "pii", "qi", "pii_count", "direct_count", "date_count", "qis_found", pii.masked(F.col("text"), F.col("pii")).alias("m"), pii.all_masked(F.col("text"), F.col("pii"), F.col("qi")).alias("all"), frequency.joint_key(quasi.key_parts(F.col("qi"))).alias("key"))
    for r in own.collect():
        text = TEXTS[r["i"]] or ""
        spans, qi = _merged(text), _quasi(text)
        assert [(x["start"], x["end"], x["entity_type"]) for x in r["pii"]] == spans, text
        assert [(x["qi_type"], x["value"], x["start"], x["end"], x["assertion"]) for x in r["qi"]] == qi, text
        if r["text"] is None:
            assert r["m"] is None and r["pii_count"] == 0
            continue
        want = text
        for a, b, t in reversed(spans):
            want = want[:a] + f"[{t}]" + want[b:]
        assert r["m"] == want and r["pii_count"] == len(spans) and r["direct_count"] == sum(t in fixed.DIRECT_TYPES for *_, t in spans)
        islands = []
        for a, b, _, label in sorted([(a, b, 0, t) for a, b, t in spans] + [(a, b, 1, t.upper()) for t, _, a, b, _ in qi]):
            if islands and a < islands[-1][1]:
                islands[-1][1] = max(islands[-1][1], b)
            else:
                islands.append([a, b, label])
        want = text
        for a, b, label in reversed(islands):
            want = want[:a] + f"[{label}]" + want[b:]
        assert r["all"] == want and r["qis_found"] == len(qi) and r["date_count"] == sum(t == "date" for t, *_ in qi)
        last = {t: v for t, v, *_, state in qi if state == "present" and v}
        assert r["key"] == "|".join(f"{t}={last[t]}" for t in sorted(last))


def test_routing(spark):
    texts = ["age 45, male"] * 9 + ["age 45, male; 01/02/2020 01/03/2020 01/04/2020 " + "plain words " * 60, "a zoologist, age 17", "nothing here", None]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    rows = queries.routing(docs).collect()
    assert len(rows) == len(texts)
    got = sorted((r["method"], r["gate_decision"], r["tier"], len(r["hard_stop_reasons"])) for r in rows)
    assert got.count(("no_qis", "SAFE", 1, 0)) == 2 and sum(r["tier"] == 3 for r in rows) == len([r for r in rows if r["k_lower"] is not None and r["k_lower"] < 5 and r["method"] == "empirical_joint"])


def test_keys_and_bounds(spark):
    people = spark.createDataFrame([("a|b", "x=y"), ("a|b", None), ("c", "x=y"), ("a", "b")], "s string, t string")
    keys = {r["key"]: r["count"] for r in frequency.frequency_table(people, ["s", "t"]).collect()}
    assert keys == {r"s=a\|b": 2, "s=c": 1, "s=a": 1, r"t=x\=y": 2, "t=b": 1, r"t=\N": 1, r"s=a\|b|t=x\=y": 1, r"s=a\|b|t=\N": 1, r"s=c|t=x\=y": 1, "s=a|t=b": 1}
    table = frequency.frequency_table(people, ["s", "t"])
    got = frequency.estimates(spark.createDataFrame([(1, "a|b", "b"), (2, "z", "b")], "id int, s string, t string"), ["s", "t"], table).collect()
    rows = {r["id"]: r for r in got}
    low = lambda c: max(0, c / 4 - 1.96 * (c / 4 * (1 - c / 4) / c) ** 0.5)
    assert rows[1]["method"] == "min_marginal_bound" and abs(rows[1]["frechet_upper"] - 4 * min(low(2), low(1))) < 1e-9 and rows[1]["frechet_lower"] == 0
    assert rows[2]["frechet_upper"] is None and rows[2]["k_upper"] == 1


def test_first_sentence(spark):
    rows = [(0, "Ada Lee is a British composer. More"), (1, "The stone is a composer's. More"), (2, "ada Lee is a composer"), (3, "Red Stone was the town. A composer came"), (4, "Jo A. is a poet"), (5, None)]
    got = {r["i"]: r["b"] for r in spark.createDataFrame(rows, "i int, text string").select("i", corpus.biographical(F.lit("T"), F.coalesce("text", F.lit(""))).alias("b")).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: False, 5: False}


def test_golden_metrics(spark):
    rows = spark.createDataFrame([(212, 43, 257, 88), (195, 96, 205, 132)], "tp long, fp long, tn long, fn long")
    got = [(round(r["precision"], 5), round(r["recall"], 5), round(r["f1"], 5)) for r in evaluate.metrics(rows).orderBy(F.desc("tp")).collect()]
    assert got == [(0.83137, 0.70667, 0.76396), (0.67010, 0.59633, 0.63107)]


def test_answers(spark):
    texts = ['x {"factors": {"A": {"detected": true, "confidence": 1.5}, "B": {"detected": "true", "confidence": "0.5"}}, "overall_confidence": 0.7} y', "no json", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", gate.parse_answer(F.col("t"), ["A", "B"]).alias("a")).orderBy("i").collect()
    assert rows[0]["a"]["A"].asDict() == {"detected": True, "confidence": 1.0} and rows[0]["a"]["B"]["detected"] is False and not rows[1]["a"]["parsed"]


def test_blocks(spark):
    files = spark.createDataFrame([("---\n# name: a\n# expected_critical: TRUE\n\n[START OF TRANSCRIPT]\n hi \n[END OF TRANSCRIPT]\n",), ("one\n\n two",)], "value string")
    assert sorted((r["name"], r["expected"], r["text"]) for r in corpus.parse_blocks(files).collect()) == [("a", True, "hi"), ("sample_1", False, "one"), ("sample_2", False, "two")]


@pytest.mark.parametrize("n,want", [(3, 5), (4, 7)])
def test_upper_median(spark, n, want):
    rows = spark.createDataFrame([("x" * k,) for k in (3, 5, 7, 9)[:n]], "text string")
    assert corpus.length_stats(rows).first()["upper_median"] == want


def _speaks_of_person(title, text):
    sample = title + " " + text[:2000]
    if re.search(fixed.PRONOUNS, sample.lower()) or set(re.findall(r"\b[a-z]+\b", sample.lower())) & set(fixed.PERSON_WORDS) or re.search(fixed.HONORIFICS, sample, re.I):
        return True
    return any(a not in fixed.NO_NAMES and b not in fixed.NO_NAMES for a, b in re.findall(fixed.NAME, sample))


def test_mentions_of_persons(spark):
    texts = ["Dr. Smith met", "Mary Jones; x", "New York and Great Britain", "it ended. Anna Lee", "the farmers", "the farmer", "stone and river", "st Andrew", "x" * 2000 + " she", "", "man_y women's", "é man"]
    rows = spark.createDataFrame([(i, "A title", t) for i, t in enumerate(texts)], "i int, title string, text string")
    got = {r["i"]: r["m"] for r in rows.select("i", corpus.mentions_person(F.col("title"), F.col("text")).alias("m")).collect()}
    assert got == {i: _speaks_of_person("A title", t) for i, t in enumerate(texts)}


def test_occupations(spark):
    docs = spark.createDataFrame([(1, "The CEO asked a registered nurse"), (2, "a zoologist"), (3, "none")], "doc_id long, text string")
    got = {(r["doc_id"], r["value"], r["start"], r["end"], r["detector"]) for r in quasi.detect(docs).where("qi_type = 'occupation'").collect()}
    assert got == {(1, "healthcare_practitioners", 27, 32, "keyword"), (2, "zoologist", 2, 11, "keyword"), (2, "zoologist", 2, 11, "gazetteer")}


def test_population(spark):
    census = spark.createDataFrame([("male_under_5", 10), ("female_15_17", 4), ("female_18_19", 6), ("male_85_plus", 5), ("male_60_61", 0), ("total", 99)], "variable string, count long")
    one, two = population.age_by_sex(census, 25, "census")
    assert {(r["qi_value"], r["count"]) for r in one.collect()} == {("male", 15), ("female", 10), ("0-4", 10), ("15-19", 10), ("85+", 5), ("60-64", 0)}
    assert {(r["age_5yr"], r["sex"], r["frequency"]) for r in two.collect()} == {("0-4", "male", 0.4), ("15-19", "female", 0.4), ("85+", "male", 0.2)}
    rows = {(r["qi_type"], r["qi_value"]): r for r in population.published(spark).collect()}
    assert rows[("health_condition", "stroke")]["count"] + rows[("health_condition", "no_stroke")]["count"] == 258000000 and ("health_behavior", "no_short_sleep") not in rows
    assert rows[("education", "ged")]["count"] == 13240000 and abs(sum(r["frequency"] for (t, _), r in rows.items() if t == "occupation") - 1) < 1e-9
    classes = population.prevalence_classes(spark.createDataFrame([("<1/100", 3), ("<1/100", 1), (">1/10", 4)], "prevalence_class string, count long"), "x")
    assert {(r["qi_value"], r["count"], r["frequency"]) for r in classes.collect()} == {("lt_1_per_100", 4, 0.5), ("gt_1_per_10", 4, 0.5)}
    assert population.from_counts(census.where("false").select(F.col("variable").alias("qi_value"), "count"), "a", "b").count() == 0


def test_streamed_counts(spark, tmp_path):
    rows = spark.sql("SELECT timestamp '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 7) AS ts, concat('t', id % 2) AS event_type, double(id) AS value FROM range(100)")
    rows.repartition(3).write.parquet(f"{tmp_path}/events")
    got = {(str(r["window"]["start"]), r["event_type"]): (r["n"], r["total"]) for r in incremental.run_windowed_counts(spark, f"{tmp_path}/events").collect()}
    want = {(str(r["h"]), r["event_type"]): (r["n"], r["t"]) for r in rows.groupBy(F.date_trunc("hour", "ts").alias("h"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("t")).collect()}
    assert got == want


def test_census_sums_universes_and_independence(spark):
    rows = [("total", 1000), ("m_single", 100), ("f_single", 150), ("m_widowed", 0), ("f_widowed", None), ("other", 7)]
    frame = spark.createDataFrame(rows, "variable string, count long")
    names = {"m_single": "single", "f_single": "single", "m_widowed": "widowed", "f_widowed": "widowed"}
    got = {r["qi_value"]: (r["count"], r["frequency"]) for r in census.universe_marginals(frame, names, "total", "marital", "x").collect()}
    assert got == {"single": (250, 0.25), "widowed": (0, 0.0)}
    assert [r["qi_value"] for r in census.universe_marginals(frame, names, "total", "marital", "x", positive=True).collect()] == ["single"]
    assert census.universe_marginals(frame.where("variable <> 'total'"), names, "total", "marital", "x").count() == 0
    areas = spark.createDataFrame([("01", 30), ("02", 10), ("99", 60)], "code string, count long")
    known = spark.createDataFrame([("01", "AL"), ("02", "AK")], "code string, qi_value string")
    assert {r["qi_value"]: r["frequency"] for r in census.area_marginals(areas, known, "state", "x").collect()} == {"AL": 0.3, "AK": 0.1}
    rates = spark.createDataFrame([("AL", "asthma", 12.5), ("AK", "asthma", None)], "area string, condition string, percent double")
    assert {r["area"]: r["count"] for r in census.prevalence_by_area(rates, 6_000_000, "x").collect()} == {"AL": 750_000, "AK": None}
    side = lambda *f: spark.createDataFrame([(chr(97 + i), x) for i, x in enumerate(f)], "qi_value string, frequency double")
    joints = {"x": side(0.5, 0.001), "y": side(0.5, 0.25)}
    assert sorted(map(tuple, census.independent_joints(joints, 1000).collect())) == [("a", "a", 250), ("a", "b", 125), ("b", "a", 1), ("b", "b", 1)]
    assert sorted(map(tuple, census.independent_joints(joints, 1000, least=125).collect())) == [("a", "a", 250)]
    assert [r["qi_value"] for r in census.most_frequent(side(0.2, 0.5, 0.5), 2).collect()] == ["b", "c"]


def test_sample_files(spark, tmp_path):
    (tmp_path / "rat.json").write_text('[{"id": "7", "text": "A b.", "difficulty": 2, "profile": {"age": "40"}}, {"text": ""}, {"text": null}, {"text": "c"}]')
    read = records.read_samples(spark, str(tmp_path / "rat.json")).coalesce(1).withColumn("ord", F.monotonically_increasing_id())
    got = [(r["id"], r["text"], r["difficulty"], r["scenario"], r["profile"], r["expected_critical"]) for r in records.samples(read).orderBy("ord").collect()]
    assert got == [("7", "A b.", 2, "unknown", {"age": "40"}, True), ("3", "c", 0, "unknown", {}, True)]
    assert [r["id"] for r in records.samples(read, [0]).collect()] == ["3"] and [r["id"] for r in records.samples(read, most=1).collect()] == ["7"]
    taken = spark.createDataFrame([("wiki_0",), (None,)], "id string")
    assert [r["id"] for r in records.numbered(read, taken, quota=3).orderBy("ord").collect()] == ["wiki_1", "wiki_2"]
    texts = spark.createDataFrame([("t", "a", "b"), ("", "a", "b"), (None, "", "b"), (None, "a", None), (None, None, None)], "text string, title string, article string")
    assert [r[0] for r in texts.select(records.record_text(F.col("text"), F.col("title"), F.col("article"))).collect()] == ["t", "# a\n\nb", "b", "", ""]
    rows = spark.createDataFrame([("one", True, "first\ntext"), ("two", None, "second")], "name string, expected boolean, text string")
    records.write_blocks(rows.coalesce(1), str(tmp_path / "blocks"))
    back = [(r["name"], r["expected"], r["text"]) for r in corpus.read_blocks(spark, str(tmp_path / "blocks")).orderBy("ord").collect()]
    assert back == [("one", True, "first\ntext"), ("two", False, "second")]
    records.write_json(rows, str(tmp_path / "json"))
    assert sorted(r["name"] for r in spark.read.json(str(tmp_path / "json")).collect()) == ["one", "two"]
    routed = spark.createDataFrame([(1, 3, True), (2, 3, None), (3, 1, True)], "id long, tier int, llm boolean")
    decided = routed.withColumn("gate_decision", records.decision_of_tier(F.col("tier"), F.col("llm")))
    assert {r["id"]: r["gate_decision"] for r in decided.collect()} == {1: "UNCERTAIN_NEED_LLM", 2: "UNSAFE", 3: "SAFE"}
    assert [r["id"] for r in records.undecided(decided, ["id"]).collect()] == [1]
