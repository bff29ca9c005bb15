"""Incremental processing: each text once, whatever runs come again."""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scratch import shared_folder


_STOPPED = "stopped between batches"


class _Stop(Exception):
    pass


def run_incremental(
    spark: SparkSession, source: str, schema, process: Callable[[DataFrame], DataFrame], out: str, state: str, files_a_batch: int | None = None, most_batches: int | None = None, stop: threading.Event | None = None
) -> int:
    """Process files new in ``source`` and append results to ``out``; ``state`` is the stream's checkpoint.  Returns how many batches were done.

    A batch takes ``files_a_batch`` files at most.  Once ``most_batches`` are done, or ``stop`` is set (by a signal's handler, say), the batch
    that runs is finished and the next one isn't begun; a later run goes on there.  A batch that comes again writes its own folder again,
    so no text is written twice.  A new input or setting takes a new state and out.
    """
    done = 0

    def batch(rows: DataFrame, number: int) -> None:
        nonlocal done
        if (most_batches is not None and done >= most_batches) or (stop is not None and stop.is_set()):
            raise _Stop(_STOPPED)
        process(rows).write.mode("overwrite").parquet(f"{out}/batch={number}")
        done += 1

    reader = spark.readStream.schema(schema)
    reader = reader.option("maxFilesPerTrigger", files_a_batch) if files_a_batch else reader
    query = reader.parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", state).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except StreamingQueryException as e:
        if _STOPPED not in str(e):
            raise
    return done


def windowed_counts(events: DataFrame, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def run_windowed_counts(spark: SparkSession, source: str, late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """window, event_type, n, total of the event files in ``source``, streamed.

    Each batch writes the windows that it changed to its own folder; the newest row of a window is its count.
    """
    folder = shared_folder(spark, "stream")
    # Watermarks need a time with a zone: times without one are taken in the session's.
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source).withColumn("ts", F.col("ts").cast("timestamp"))

    def batch(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = windowed_counts(events, late, size).writeStream.outputMode("update").foreachBatch(batch).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    # Without a file no batch has run, and nothing is written.
    schema = "window struct<start:timestamp,end:timestamp>, event_type string, n long, total double, batch int"
    rows = [] if query.lastProgress is None or not any(p["numInputRows"] for p in query.recentProgress) else None
    changes = spark.createDataFrame(rows, schema) if rows is not None else spark.read.parquet(f"{folder}/out")
    return changes.groupBy("window", "event_type").agg(F.max_by("n", "batch").alias("n"), F.max_by("total", "batch").alias("total"))
