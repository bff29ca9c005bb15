"""Files of a stream are bounded in size and its batches in files, whatever the input has."""

from pyspark.sql import functions as F

from veilspark.plans import runs
from veilspark.streaming import incremental


def test_a_larger_input_has_more_files_not_larger_ones(spark, monkeypatch):
    monkeypatch.setattr(runs, "_FILE_BYTES", 1 << 12)
    seen, real = [], incremental.run_incremental

    def run(spark_, source, *args, **kwargs):
        rows = spark.read.parquet(source).groupBy(F.input_file_name().alias("f")).agg(F.sum(F.octet_length("text")).alias("n")).collect()
        seen.append((len(rows), kwargs["files_a_batch"], real(spark_, source, *args, **kwargs)))
        return seen[-1][-1]

    monkeypatch.setattr(incremental, "run_incremental", run)
    got = {(r["lang"], r["n"], r["characters"]) for r in runs.stopped_stream(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert got == {(r["lang"], r["n"], r["c"]) for r in docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("c")).collect()}
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    assert seen[0][0] > 40 and size / seen[0][0] < 1 << 14
    assert all(files_a_batch == 16 for _, files_a_batch, _ in seen)
    # The first run stops after two batches, the second does the rest.
    assert seen[0][2] == 2 and seen[1][2] >= 1
