import json
import random
import time
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilspark.functions import fixed
from veilspark.operators import corpus, evaluate, frequency, gate, measure, pii, policy, population, quasi, shuffle, state
from veilspark.plans import queries
from veilspark.sources import records, scan
from veilspark.streaming import incremental

SAMPLES = "hash string, text string"


def work(calls):
    def process(samples):
        calls.append(sorted(r["text"] or "" for r in samples.collect()))
        return samples.select("hash", F.length("text").alias("n"))

    return process


def test_state_by_hash_and_settings(spark, tmp_path):
    calls, own = [], state.StateTable(spark, f"file://{tmp_path}/state", keep=2)
    make = lambda *texts: spark.createDataFrame([(None if t is None else f"h{t}", t) for t in texts], SAMPLES)
    rows = lambda df: sorted(((r["hash"] or "", r["worked"]) for r in df.collect()))
    assert rows(state.resume(make("a", "b", "b"), work(calls), own, {"k": 5})) == [("ha", 1), ("hb", 1)]
    assert rows(state.resume(make("b", "a", "b"), work(calls), own, {"k": 5})) == [("ha", 1), ("hb", 1)] and len(calls) == 1  # the same input: nothing runs
    assert rows(state.resume(make("b", "c", None), work(calls), own, {"k": 5})) == [("", 2), ("hb", 1), ("hc", 2)]
    assert calls[-1] == ["", "c"]  # the changed ones alone
    assert rows(state.resume(make("b", "c", None), work(calls), own, {"k": 6})) == [("", 3), ("hb", 3), ("hc", 3)]
    assert [m["number"] for m in own.manifests()] == [3, 2]  # the last two stay
    assert own.current({"k": 5}) is None and own.current({"k": 6})[1]["settings"] == {"k": 6}
    own.clear()
    assert own.current() is None
    assert rows(state.resume(spark.createDataFrame([], SAMPLES), work(calls), own, {"k": 6})) == []


def test_state_broken_off(spark, tmp_path, monkeypatch):
    calls, own = [], state.StateTable(spark, f"file://{tmp_path}/state", keep=1)
    make = lambda *texts: spark.createDataFrame([(f"h{t}", t) for t in texts], SAMPLES)
    state.resume(make("a"), work(calls), own, {"k": 5}).collect()

    def fail(*_):
        raise RuntimeError("lost between write and swap")

    with monkeypatch.context() as m:
        m.setattr(own, "publish", fail)
        with pytest.raises(RuntimeError):
            state.resume(make("a", "b"), work(calls), own, {"k": 5})
    assert [r["hash"] for r in own.current({"k": 5})[0].collect()] == ["ha"]  # as before
    (tmp_path / "state/manifests/00000007.json").write_text('{"number": 7, "fold')  # and a manifest that was cut off
    after = state.resume(make("a", "b"), work(calls), own, {"k": 5})
    assert sorted((r["hash"], r["worked"]) for r in after.collect()) == [("ha", 1), ("hb", 2)]
    assert len(list((tmp_path / "state/data").glob("0*"))) == 1  # what was left over is gone
    with pytest.raises(Exception, match="exist"):
        own.publish("another", 2, {}, "")


def test_policy_as_of(spark):
    rng = random.Random(4)
    day = lambda d, h=0: datetime(2024, 1, d, h)
    rules = [(d, f"v{i}", day(rng.randint(1, 28)), rng.choice(["p", "q", None]), rng.choice([None, 3, 7]), rng.randint(8, 30), rng.choice([None, True, False]), rng.choice([None, ["US_SSN"]])) for d in "abc" for i in range(6)] + [(None, "x", day(1)), ("a", "late", None)]
    requests = [(i, rng.choice([*"abcd", None]), rng.choice([day(rng.randint(1, 28), rng.randint(0, 23)), None])) for i in range(300)] + [(1000 + i, r[0], r[2]) for i, r in enumerate(rules) if r[0]]
    got = policy.governed(spark.createDataFrame(requests, "id long, deployment string, at timestamp, "[:-2]), policy.policies(spark, rules)).collect()
    assert len(got) == len(requests)
    want = {}
    for i, d, at in requests:
        held = [r for r in rules if r[0] == d and d and at and r[2] and r[2] <= at]
        best = max(held, key=lambda r: (r[2], r[1]), default=None)
        full = dict(zip(["policy_version", "reference_population", "k_minimum", "k_safe_threshold", "require_joint_estimate", "direct_identifier_types"], [best[1], *best[3:]], strict=True)) if best else {}
        want[i] = {k: full.get(k) if full.get(k) is not None else v for k, v in policy.DEFAULTS.items()}
    assert {r["id"]: {k: r[k] for k in policy.DEFAULTS} for r in got} == want
    sizes = spark.createDataFrame([("p", 10), ("p", 12)], "population_id string, total_size int")
    known = policy.with_population(spark.createDataFrame([(1, "p"), (2, "q"), (3, None)], "id int, reference_population string"), sizes)
    assert {r["id"]: r["population_size"] for r in known.collect()} == {1: 12, 2: None, 3: None}


def test_settings_as_columns(spark):
    row = lambda i, k, method, k_min, k_safe, need, left=0: (i, k, method, 0, 1, 0, 100, False, False, 1, k_min, k_safe, need, left)
    schema = "id int, k_lower double, method string, date_count int, qi_count int, contextual_count int, word_count int, disagreement boolean, rare boolean, pii_count int, a int, b int, c boolean, residual_count int"
    rows = [row(1, 6.0, "empirical_joint", 5, 20, True), row(2, 6.0, "empirical_joint", 7, 20, True), row(3, None, "unavailable", 5, 20, True), row(4, None, "unavailable", 5, 20, False), row(5, 2.0, "min_marginal_bound", 5, 20, True), row(6, 50.0, "empirical_joint", 5, 20, True, 2)]
    got = {r["id"]: r for r in gate.route(spark.createDataFrame(rows, schema), "a", "b", "c").collect()}
    assert [(got[i]["gate_decision"], got[i]["tier"], len(got[i]["hard_stop_reasons"])) for i in range(1, 7)] == [("SAFE", 2, 0), ("UNSAFE", 3, 1), ("UNSAFE", 3, 1), ("SAFE", 2, 0), ("UNCERTAIN", 2, 0), ("SAFE", 3, 1)]
    assert got[6]["hard_stop_reasons"] == ["2 direct identifiers left unmasked"] and got[2]["hard_stop_reasons"] == ["k_lower 6.0 below 7"]


def test_model_and_abstention(spark):
    """Each factor by itself, an unusual event by its confidence, no answer, one that isn't JSON; flags of what a decision rests on."""
    names = list(fixed.FACTORS)
    said = [json.dumps({"factors": {n: {"detected": True, "confidence": 0.1}}}) for n in names]
    said += [json.dumps({"factors": {names[0]: {"detected": True, "confidence": c}}}) for c in (0.7, 0.71)] + ["so {\"factors\": {}} it is", "no idea", None, "{\"factors\": {\"SMALL_COMMUNITY\": {\"detected\": \"yes\"}}}"]
    want = [False, True, True, True, True, True, False, True, False, None, None, False]
    schema = "id int, answer_ string, masked string, k_lower double, method string, date_count int, qi_count int, contextual_count int, word_count int, disagreement boolean, rare boolean, pii_count int, has_unseen boolean"
    rows = spark.createDataFrame([(i, a, "m [PERSON]", 6.0, "empirical_joint", 3, 1, 0, 100, False, False, 0, i == 0) for i, a in enumerate(said)] + [(99, said[1], "m", 1.0, "empirical_joint", 3, 1, 0, 100, False, False, 0, True)], schema)
    prompts = []

    def answers(rows):
        prompts.append(rows.select("prompt").first()[0])
        return rows.withColumn("answer", F.col("answer_"))

    out = gate.route(rows, model=gate.asked(answers)).withColumn("flags", gate.uncertainty_flags()).orderBy("id").collect()
    assert [r["model_flag"] for r in out[:-1]] == want
    assert [r["tier"] for r in out[:-1]] == [3 if w else 2 for w in want]
    assert [r["flags"] for r in out] == [[*(["unseen_qi_values"] if i == 0 else []), *(["llm_abstained"] if w is None else [])] for i, w in enumerate(want)] + [[]]
    assert all(n in prompts[0] for n in names) and prompts[0].endswith("Text:\nm [PERSON]\n") and not out[-1]["llm_invoked"] and out[-1]["tier"] == 3


def test_what_masking_leaves(spark):
    texts = ["a@b.org 555-123-4567 c@d.org and (555) 123-4567, x@y.net", "é 555-123-4567", "", None, "a@b.org", "555-123-4567" * 2 + " q@q.qq 555-123-4567 é q@q.qq 555 123 4567"]
    docs = spark.createDataFrame([(None, t) for t in texts], "doc_id long, text string")
    spans = pii.merged(pii.evidence(F.col("text"), ["EMAIL_ADDRESS"]))
    for r in pii.with_residual(docs, spans, ["PHONE_NUMBER"]).collect():
        if r["text"] is None:
            assert not r["left"]
            continue
        for s in r["left"]:
            assert r["text"][s["start"] : s["end"]] == r["masked"][s["m_start"] : s["m_end"]] and "555" in r["text"][s["start"] : s["end"]]
        alone = docs.sparkSession.createDataFrame([(r["text"],)], "text string").select(pii.merged(pii.evidence(F.col("text"), ["PHONE_NUMBER"]))).first()[0]
        assert [(s["start"], s["end"]) for s in r["left"]] == [(s["start"], s["end"]) for s in alone]
    # All masked: nothing is left.
    every = pii.with_residual(docs, pii.merged(pii.evidence(F.col("text"))), ["PHONE_NUMBER", "EMAIL_ADDRESS"])
    assert every.where(F.size("left") > 0).count() == 0


def test_long_texts_with_many_spans(spark):
    """16,000 matches in one text: more than linear time would show."""
    parts = [f"u{i}@ex.org on {1 + i % 28:02d}/0{1 + i % 9}/20{i % 90 + 10}, " for i in range(8000)]
    docs = spark.createDataFrame([(1, "".join(parts))], "doc_id long, text string")
    begin = time.time()
    got = docs.select(pii.merged(pii.evidence(F.col("text"), ["EMAIL_ADDRESS", "DATE"])).alias("s")).select("s").first()[0]
    assert len(got) == 16_000 and time.time() - begin < 20
    begin, at = time.time(), 0
    text = "".join(parts)
    for i, s in enumerate(got[:600]):
        value = text[s["start"] : s["end"]]
        assert s["start"] >= at and (value.startswith(f"u{i // 2}@") if i % 2 == 0 else value.count("/") == 2)
        at = s["end"]
    masked = docs.select(pii.masked(F.col("text"), pii.merged(pii.evidence(F.col("text"), ["EMAIL_ADDRESS", "DATE"])))).first()[0]
    assert masked == "[EMAIL_ADDRESS] on [DATE], " * 8000 and time.time() - begin < 20
    begin = time.time()
    qi = quasi.identify(docs, ["date"]).select("qi").first()[0]
    assert len(qi) == len({p.split(" on ")[1][:10] for p in parts}) and time.time() - begin < 30


def test_tiers_without_ids(spark, tmp_path):
    rows = [(None, "mail a@b.org"), (None, "nothing"), (7, "c@d.org"), (7, "plain"), (8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {(r["tier"], r["n"]) for r in queries.tier_counts(spark, str(tmp_path)).collect()} == {(1, 3), (2, 2)}


def test_quota_reads_as_few_files_as_it_may(spark, tmp_path):
    rng = random.Random(8)
    for f in range(12):
        rows = [(f * 100 + i, rng.choice(["good", "bad", None])) for i in range(rng.choice([0, 5, 9]))]
        spark.createDataFrame(rows, "id int, text string").coalesce(1).write.parquet(f"{tmp_path}/part{f:02d}")
    files = [str(x) for f in range(12) for x in sorted((tmp_path / f"part{f:02d}").glob("*.parquet"))]
    (tmp_path / "all").mkdir()
    for i, x in enumerate(files):
        (tmp_path / f"all/f{i:02d}.parquet").symlink_to(x)
    good = lambda df: df.where("text = 'good'")
    whole = [r["id"] for i in range(len(files)) for r in spark.read.parquet(f"{tmp_path}/all/f{i:02d}.parquet").where("text = 'good'").orderBy("id").collect()]
    for quota in (0, 1, 4, 13, 1000):
        rows, read = scan.first_good(spark, f"{tmp_path}/all", good, quota)
        assert [r["id"] for r in rows.orderBy("ordinal").collect()] == whole[:quota] and [r["ordinal"] for r in rows.orderBy("ordinal").collect()] == list(range(min(quota, len(whole))))
        # Blocks of 1, 2, 4, ... files: no block begins once there are enough.
        ends, have = [0], 0
        while ends[-1] < len(files) and have < quota:
            ends.append(min(len(files), 2 * ends[-1] + 1))
            have = sum(spark.read.parquet(f"{tmp_path}/all/f{i:02d}.parquet").where("text = 'good'").count() for i in range(ends[-1]))
        assert read == ends[-1]


def test_shuffle_is_a_permutation(spark, monkeypatch):
    monkeypatch.setattr(shuffle, "RANGE", 8)
    monkeypatch.setattr(shuffle, "GROUP", 4)
    rows = spark.range(500).select("id", (F.col("id") % 7).alias("position_")).union(spark.createDataFrame([(None, 1), (None, 2), (3, 9), (3, 10)], "id long, p long"))
    one, two = ({(r["id"], r["position_"]): r["position"] for r in shuffle.shuffled(rows, seed, ["id", "position_"]).collect()} for seed in (1, 1))
    assert one == two and sorted(one.values()) == list(range(504))
    other = {(r["id"], r["position_"]): r["position"] for r in shuffle.shuffled(rows, 2, ["id", "position_"]).collect()}
    assert other != one and abs(np.corrcoef([one[k] for k in one], [other[k] for k in one])[0, 1]) < 0.2
    same = sorted(r["position"] for r in shuffle.shuffled(rows, 2, ["id"]).collect())
    assert same == list(range(504)) and shuffle.shuffled(rows.limit(0), 1, ["id"]).count() == 0


def test_result_files_of_any_version(spark, tmp_path):
    good = [{"sample_name": "a", "tier": 2, "llm_used": True, "tiers_by_k": {"5": 2, "x": 1, "20": 3}, "k_lowers_by_k": {"5": 1.5}, "more": [1]}, {"sample_name": "b", "tier": 3, "llm_invoked": False, "k_lower": "inf"}]
    (tmp_path / "array.json").write_text(json.dumps(good, indent=1))
    (tmp_path / "lines.json").write_text("\n".join(json.dumps(x) for x in good) + "\n")
    (tmp_path / "one.json").write_text(json.dumps(good[0]))
    (tmp_path / "cut.json").write_text(json.dumps(good)[:-9])
    (tmp_path / "mixed.json").write_text(json.dumps([5, {"sample_name": "c"}, good[1]]))
    (tmp_path / "empty.json").write_text("")
    rows, bad = scan.read_results(spark, str(tmp_path))
    rows = rows.collect()
    assert sorted((r["file"], r["sample_name"], r["tier"], r["llm_invoked"]) for r in rows) == sorted([(f, n, t, u) for f in ("array.json", "lines.json") for n, t, u in (("a", 2, True), ("b", 3, False))] + [("one.json", "a", 2, True), ("mixed.json", "b", 3, False)])
    assert all(r["tiers_by_k"] == {5: 2, 20: 3} and r["k_lowers_by_k"] == {5: 1.5} and json.loads(r["other"])["more"] == [1] for r in rows if r["sample_name"] == "a")
    assert all(r["tiers_by_k"] is None and r["k_upper"] == float("inf") and r["total_time"] == 0 for r in rows if r["sample_name"] == "b")
    assert {r["file"] for r in bad.collect()} >= {"cut.json", "mixed.json"} and sorted(r["reason"] for r in bad.where("file = 'mixed.json'").collect()) == ["record 0: not an object", "record 1: no tier"]
    # What the writer writes comes back.
    frame = spark.createDataFrame([("x", 1, True), ("y", None, None)], "sample_name string, tier int, llm_used boolean")
    records.write_json(frame, f"{tmp_path}/written")
    again, missing = scan.read_results(spark, f"{tmp_path}/written")
    assert [(r["sample_name"], r["tier"], r["llm_invoked"]) for r in again.collect()] == [("x", 1, True)] and missing.count() == 1


def test_responses(spark, tmp_path):
    (tmp_path / "us.json").write_text(json.dumps([["B23025_001E", "B23025_004E", "B23025_005E", "us"], ["100", "60", None, "1"], ["7", "7", "7", "2"]]))
    (tmp_path / "bad.json").write_text("<html>")
    (tmp_path / "short.json").write_text("[[\"a\"]]")
    rows = scan.read_matrix(spark, str(tmp_path))
    variables = ["B23025_001E", "B23025_004E", "B23025_005E", "B23025_006E"]
    assert {r["variable"]: r["count"] for r in scan.counts_of(rows, variables).collect()} == dict(zip(variables, [100, 60, 0, 0], strict=True))
    (tmp_path / "states").mkdir()
    (tmp_path / "states/s.json").write_text(json.dumps([["P", "state", "P"], ["1", "01", "5"], ["x", "02", ""], ["3"]]))
    by_state = scan.counts_of(scan.read_matrix(spark, f"{tmp_path}/states"), ["P"], "state").collect()
    assert [(r["code"], r["count"]) for r in by_state] == [("01", 5), ("02", 0), (None, 0)]


@pytest.mark.parametrize("values", [[1.0, 2.0, 2.5, 10.0, float("inf"), None, float("nan")], [3.0, 3.0], [], [float("inf")], [0.1 * i for i in range(97)]])
def test_histogram(spark, values):
    got = measure.histogram(spark.createDataFrame([(v,) for v in values], "k double"), "k").orderBy("bin").collect()
    finite = [v for v in values if v is not None and np.isfinite(v)]
    apart = sum(v is not None and not np.isfinite(v) for v in values)
    assert [r["n"] for r in got if r["bin"] == -1] == ([apart] if apart else [])
    if finite:
        n, edges = np.histogram(finite, 30)
        own = [r for r in got if r["bin"] >= 0]
        assert np.allclose([r["low"] for r in own], edges[:-1]) and own[-1]["high"] == edges[-1] and sum(r["n"] for r in own) == len(finite)
        # A value on an edge may fall to either side by rounding.
        assert np.abs(np.cumsum([r["n"] for r in own]) - np.cumsum(n)).max() <= 1
    else:
        assert all(r["bin"] == -1 for r in got)


def test_stages_are_observed(spark):
    stages = measure.Stages(spark)
    first = stages.run("all", spark.range(1000).toDF("x"), total=F.sum("x"))
    stages.run("some", first.where("x < 10"), total=F.sum("x"))
    stages.run("none", first.where("x < 0"), total=F.sum("x"))
    got = [(r["stage"], r["rows"], r["measures"].get("total")) for r in stages.table().orderBy("at").collect()]
    assert got == [("all", 1000, 499500.0), ("some", 10, 45.0), ("none", 0, None)]


def test_stop_between_batches(spark, tmp_path):
    for i in range(5):
        spark.createDataFrame([(i, f"text {i}")], "id int, text string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    run = lambda **more: incremental.run_incremental(spark, f"{tmp_path}/in", "id int, text string", lambda rows: rows, f"{tmp_path}/out", f"{tmp_path}/state", files_a_batch=1, **more)
    assert run(most_batches=2) == 2
    assert spark.read.parquet(f"{tmp_path}/out").count() == 2
    assert run() == 3 and run() == 0
    assert sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/out").collect()) == list(range(5))


def test_population_and_order(spark):
    rows = spark.createDataFrame([("a", 2, 10, "s"), ("a", 1, 11, "s"), ("b", 3, 7, "t")], "key string, ordinal int, count int, source string")
    assert sorted((r["key"], r["count"]) for r in frequency.first_by_ordinal(rows, ["key"]).collect()) == [("a", 11), ("b", 7)]
    assert sorted((r["count"], r["source"]) for r in frequency.derive_population(rows, 50, 100).collect()) == [(3, "t_derived"), (5, "s_derived"), (5, "s_derived")]
    samples = spark.createDataFrame([("h2", 0), ("h1", 1)], "hash string, ord int")
    results = spark.createDataFrame([("h1", 3), ("h3", 4), ("h2", 5)], "hash string, tier int")
    assert [r["tier"] for r in corpus.in_sample_order(samples, results).collect()] == [5, 3]


def test_sample_blocks(spark):
    schema = "id string, text string, difficulty int, scenario string, expected_critical boolean, direct_identifiers map<string,string>, indirect_identifiers array<string>"
    rows = [("57", "Hello", 3, "Chat", True, {"n": "1"}, ["CIT", "it's"]), ("wiki_1", "x [START OF TRANSCRIPT] y [END OF TRANSCRIPT]", 0, "Other", False, None, None), (None, None, None, None, None, None, []), ("a", "[START OF TRANSCRIPT] only", 1, "Wikipedia article", False, {}, None)]
    frame = spark.createDataFrame(rows, schema)
    got = [r[0] for r in frame.select(corpus.sample_block(frame)).collect()]
    for (i, text, level, scenario, critical, direct, indirect), block in zip(rows, got, strict=True):
        i, text, scenario = i or "unknown", text or "", scenario or "Unknown"
        name = i if i.startswith("wiki_") or scenario == "Wikipedia article" else f"RAT-{i}"
        body = text if "[START OF TRANSCRIPT]" in text and "[END OF TRANSCRIPT]" in text else f"[START OF TRANSCRIPT]\n{text}\n[END OF TRANSCRIPT]"
        assert block == f"---\n# name: {name} (difficulty={level or 0}, {scenario})\n# expected_critical: {str(bool(critical)).lower()}\n# rat_difficulty: {level or 0}\n# rat_scenario: {scenario}\n# rat_direct_ids: {list(direct or {})}\n# rat_indirect_ids: {indirect or []}\n\n{body}\n"
    back = corpus.parse_blocks(spark.createDataFrame([("\n".join(got),)], "value string"))
    assert [r["expected"] for r in back.orderBy("ord").collect()][:2] == [True, False]


def test_splits(spark):
    rows = spark.createDataFrame([(1, "train"), (2, "test"), (3, None), (4, "train")], "id int, split string")
    ids = lambda split, df=rows: sorted(r["id"] for r in corpus.choose_split(df, split).collect())
    assert ids("train") == [1, 4] and ids("test") == [2] and ids("dev") == [2] and ids("x", rows.where("split is null")) == [] and ids("x", rows.limit(0)) == []


def test_hospital_tables(spark):
    shares = population.from_shares(spark, "education", fixed.EDUCATION_SHARES, fixed.US_POPULATION, "s")
    scaled = {r["qi_value"]: r for r in population.hospital_scaled(shares, "education").collect()}
    assert len(scaled) == len(fixed.EDUCATION_SHARES)
    for v, f in fixed.EDUCATION_SHARES.items():
        assert int(f * 150000 * 0.9) - 1 <= scaled[v]["count"] <= f * 150000 * 1.1 and abs(scaled[v]["frequency"] - scaled[v]["count"] / 150000) < 1e-12
    counts = spark.createDataFrame([(v, n) for v, n in fixed.DETAILED_OCCUPATIONS.items()], "qi_value string, count long")
    total = sum(fixed.OCCUPATION_COUNTS.values())
    jobs = counts.select(F.lit("occupation_detailed").alias("qi_type"), "qi_value", (F.col("count") / total).alias("frequency"), F.lit("BLS").alias("source"))
    got = {r["qi_value"]: r["count"] for r in population.hospital_scaled(jobs, "occupation_detailed").collect()}
    factor = lambda v: 5.0 if "nurse" in v or "physician" in v else 0.5 if v in fixed.RARE_OCCUPATIONS else 1.0
    assert got == {v: max(1, int(n / total * 150000 * factor(v))) for v, n in fixed.DETAILED_OCCUPATIONS.items()}
    conditions = {r["qi_value"]: r for r in population.hospital_conditions(spark).collect()}
    se = (0.15 * 0.85 / 150000) ** 0.5
    assert abs(conditions["diabetes_type2"]["upper_bound"] - (0.15 + 1.96 * se)) < 1e-12 and conditions["huntingtons"]["count"] == 45
    pair = {r["qi_value"]: r["count"] for r in population.yes_and_no(spark, "has_rare_disease", fixed.RARE_DISEASE_PATIENTS, fixed.US_POPULATION_2022, "s").collect()}
    assert pair == {"yes": 33_000_000, "no": 298_097_593}


def test_estimates_without_values(spark):
    pop = frequency.frequency_table(spark.createDataFrame([("male",)] * 30, "sex string"), ["sex"])
    pairs = "id int, pairs array<struct<t:string,v:string>>, found int, present int"
    rows = [(1, [], 0, 0), (2, [], 2, 0), (3, [], 2, 1), (4, [("race", "x")], 1, 1), (5, [("sex", "male")], 1, 1)]
    got = {r["id"]: r for r in frequency.estimate_found(spark.createDataFrame(rows, pairs), pop).collect()}
    assert [got[i]["method"] for i in range(1, 6)] == ["no_qis", "no_patient_qis", "no_normalized_values", "unavailable", "empirical_joint"]
    assert [got[i]["k_lower"] for i in (1, 2)] == [float("inf")] * 2 and got[3]["k_lower"] is None and got[4]["k_lower"] is None and got[5]["k_lower"] == 30
    assert [got[i]["reason"] is None for i in range(1, 6)] == [True, True, False, False, True]


def test_configurations_and_lists(spark, tmp_path):
    for name, ids in (("english", "ab"), ("dutch", "c")):
        (tmp_path / f"all/config={name}").mkdir(parents=True)
        (tmp_path / f"all/config={name}/x.json").write_text(json.dumps([{"id": i, "text": i} for i in ids]))
    read = lambda **more: sorted(r["id"] for r in records.read_samples(spark, f"{tmp_path}/all", **more).collect())
    assert read() == ["a", "b", "c"] and read(config="english") == ["a", "b"] and read(config="none") == [] and read(lists_only=True) == ["a", "b", "c"]
    (tmp_path / "all/config=dutch/lone.json").write_text('{"id": "d"}')
    assert read(config="dutch") == ["c", "d"]
    with pytest.raises(ValueError, match="lone.json"):
        read(lists_only=True)


def test_direct_or_all(spark):
    rows = spark.createDataFrame([(0, 3), (2, 3), (None, 4), (None, None), (0, None)], "d int, n int")
    assert [r[0] for r in rows.select(evaluate.direct_or_all(F.col("d"), F.col("n"))).collect()] == [3, 2, 4, 0, 0]
