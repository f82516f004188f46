"""Structured Streaming over event files: windowed rollups, idempotent sinks and queue claims."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrano.session import scratch_path


def read_stream(spark: SparkSession, folder: str, pattern: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, at: str, by: list[str], width: str, late: str) -> DataFrame:
    """Counts and sums of value in tumbling windows; rows later than the watermark are dropped in streams."""
    w = F.window(at, width)
    events = events.withColumn(at, F.col(at).cast("timestamp"))
    return events.withWatermark(at, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), *by, "n", "total")


def run_to_table(stream: DataFrame, spark: SparkSession, mode: str = "append") -> DataFrame:
    """Run an available-now query into a Parquet folder, batch by batch under the batch's id, and read it.

    A batch that is tried again replaces its own folder, so the sink is idempotent.
    """
    out, state = scratch_path(spark, "stream"), scratch_path(spark, "state")

    def sink(df: DataFrame, batch: int) -> None:
        # in complete mode each batch holds the whole result
        df.write.mode("overwrite").parquet(f"{out}/batch={0 if mode == 'complete' else batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True).foreachBatch(sink).start()
    query.awaitTermination()
    return spark.read.option("basePath", out).parquet(f"{out}/batch=*").drop("batch")


def for_each_new(stream: DataFrame, keys: list[str], delay: str, at: str, handle: Callable[[DataFrame, int], None], checkpoint: str):
    """Call ``handle`` on rows whose key was not seen within the delay: the shared set of seen keys, kept as state."""
    fresh = stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)
    return fresh.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(handle).start()
