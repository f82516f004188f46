"""Sinks: dry runs, appends without repeats, logs that are written twice, runs with their items. Folders are replaced whole or only added to."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from terrano.functions.normalize import redacted
from terrano.sources.files import read_csv


def commit(df: DataFrame, path: str, dry_run: bool = True, mode: str = "append") -> int:
    """How many rows there are to write; they are written unless it is a dry run."""
    n = df.count()
    if not dry_run:
        df.write.mode(mode).parquet(path)
    return n


def append_csv(df: DataFrame, folder: str, keys: list[str]) -> int:
    """Adds the rows whose keys the folder of CSV files lacks, the first of each; how many that were."""
    spark = df.sparkSession
    new = df.dropDuplicates(keys)
    fs = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        new = new.join(read_csv(spark, folder).select(*keys), keys, "left_anti")
    new = new.persist()
    n = new.count()
    new.write.mode("append").option("header", True).csv(folder)
    new.unpersist()
    return n


def log_errors(errors: DataFrame, lines: str, table: str) -> None:
    """Writes errors as JSON lines first, then as a table; messages are redacted in both."""
    safe = errors.withColumn("mensaje", redacted(F.col("mensaje")))
    safe.write.mode("append").json(lines)
    safe.write.mode("append").parquet(table)


def write_run(run: DataFrame, items: DataFrame, root: str) -> None:
    """Writes a run's items, then the run itself, so that no reader sees a run without its items; on failure the run is written as one with an error."""
    try:
        items.write.mode("overwrite").parquet(f"{root}/items")
    except Exception:
        run.withColumn("status", F.lit("error")).write.mode("overwrite").parquet(f"{root}/run")
        raise
    run.write.mode("overwrite").parquet(f"{root}/run")


def by_category(df: DataFrame, column: str, folder: str) -> None:
    """One folder of CSV files for each category."""
    df.write.mode("overwrite").partitionBy(column).option("header", True).csv(folder)
