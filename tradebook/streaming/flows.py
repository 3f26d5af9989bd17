"""Stateless and built-in stateful stream operators, and running a stream to completion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tradebook.functions.text import business_key
from tradebook.operators.events import enrich_events, metrics_by_interval
from tradebook.operators.keyed import changed_keys, incremental_snapshot
from tradebook.session import scratch


def read_stream(spark: SparkSession, path: str, like: DataFrame, glob: str | None = None,
                files_per_trigger: int | None = None) -> DataFrame:
    """Parquet files as a stream with the schema of ``like``."""
    reader = spark.readStream.schema(like.schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def run_available(stream: DataFrame, partition_by: str | None = None, mode: str = "append") -> DataFrame:
    """Run a stream over all input available now and return what it wrote.

    Output and checkpoint lie in the shared folder, so a lost executor or driver can resume.
    """
    spark = stream.sparkSession
    out, state = scratch(spark, "stream-out"), scratch(spark, "stream-state")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if partition_by:
        writer = writer.partitionBy(partition_by)
    query = writer.format("parquet").start(out)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def with_end(stream: DataFrame, last: DataFrame) -> DataFrame:
    """The stream followed by ``last``, rows far in the future.

    A bounded run ends with the watermark behind the youngest row; the extra rows move it past everything
    before them, so that all windows and timers of the run come out. They go in before ``withWatermark``, and
    must pass the filters behind it, which Spark applies first.
    """
    path = scratch(stream.sparkSession, "stream-end")
    last.write.parquet(path)
    return stream.unionByName(read_stream(stream.sparkSession, path, last))


def route_by_priority(events: DataFrame, path: str, checkpoint: str):
    """Start a query that writes enriched events into one folder per priority."""
    return enrich_events(events).writeStream.format("parquet").partitionBy("priority") \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path)


def dedup_stream(records: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """One record per business key; keys are forgotten once the watermark has passed them."""
    keyed = records.withColumn("business_key", business_key("business_name", "address"))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["business_key"])


def metrics_stream(events: DataFrame, ts: str = "ts", every: str = "60 seconds", delay: str = "10 minutes") -> DataFrame:
    """Event metrics per interval, emitted once the watermark has passed an interval."""
    return metrics_by_interval(enrich_events(events).withWatermark(ts, delay), every, ts)


def on_batch(stream: DataFrame, callback: Callable[[DataFrame, int], None], checkpoint: str):
    """Hand every micro-batch to ``callback`` (event and pattern subscriptions)."""
    return stream.writeStream.foreachBatch(callback).option("checkpointLocation", checkpoint) \
        .trigger(availableNow=True).start()


def snapshot_on_batch(stream: DataFrame, table: Callable[[], DataFrame], path: str, checkpoint: str):
    """Write an incremental snapshot of ``table()`` for the keys changed in every micro-batch.

    A batch without changes writes nothing; a repeated batch overwrites its own folder.
    """
    def write(batch: DataFrame, number: int) -> None:
        if not changed_keys(batch).isEmpty():
            incremental_snapshot(table(), batch).write.mode("overwrite").parquet(f"{path}/batch={number}")
    return on_batch(stream, write, checkpoint)
