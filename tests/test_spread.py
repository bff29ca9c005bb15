"""Work is dealt out over tasks however few parts the files have, and texts are searched for all literals at once."""

import random

import pytest
from pyspark.sql import functions as F

from veilspark.operators import quasi
from veilspark.plans import people, queries

SF = "/root/testdata/sf0.001"


def _most_in_one_task(df):
    counts = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(counts) / sum(counts)


def test_notes_are_made_in_many_tasks(spark, monkeypatch):
    shares = []

    def seen(df, tag):
        if tag == "notes":
            shares.append(_most_in_one_task(df.select("id")))
        return real(df, tag)

    real = people.written
    monkeypatch.setattr(people, "written", seen)
    people.routed_people(spark, SF)
    assert shares[0] < 0.5


def test_documents_are_searched_in_many_tasks(spark):
    assert _most_in_one_task(queries._identified(spark, SF).select("doc_id")) < 0.5


def test_texts_are_not_searched_literal_by_literal(spark):
    plan = quasi.identify(spark.createDataFrame([("a",)], "text string"))._jdf.queryExecution().optimizedPlan().toString().lower()
    assert plan.count("contains(") < 20


@pytest.mark.parametrize("blank", [" ", "\n", "  "])
def test_literals_of_a_text(spark, blank):
    literals = ["age", "year", "york", " ba ", " ph", "i'm", "school"]
    draw = random.Random(7)
    words = ["age", "AGED", "teenage,years", "new", "york", "ba", "ba²", "²ba", "abba", "b.a", "phd", "graph", "i'm", "ébaé", "schools", "schoo", "l", "x" * 100 + "age", "ſchool", "-ba-", "ba_"]
    texts = [None, "", " ", "age", "a" * 500 + "york", *(blank.join(draw.choices(words, k=draw.randrange(9))) for _ in range(200))] * 2
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(2)
    low = quasi.lowered(F.col("text"))
    got = {r["id"]: r["got"] for r in rows.select("id", quasi._present_in(literals)(low).alias("got")).collect()}
    plain = {r["id"]: r for r in rows.select("id", *(F.contains(low, F.lit(h.strip())).alias(h) for h in literals), *(F.rlike(low, F.lit(rf"(?U)\b{h.strip()}" + (r"\b" if h[-1] == " " else ""))).alias("whole" + h) for h in literals if h[0] == " ")).collect()}
    for i, text in enumerate(texts):
        if text is None:
            assert got[i] is None
            continue
        for h in literals:
            if h[0] != " ":
                assert (h in got[i]) == plain[i][h], (h, text)
            elif plain[i]["whole" + h]:
                assert h in got[i], (h, text)
