"""Sessions, shared scratch space and size-checked broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Scratch paths given out by this process.
_made: list[str] = []


def local_session(cores: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks: UTC, AQE on, shuffles sized to the cores."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("terrano")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str = "t") -> str:
    """A fresh path in the folder all executors share (``spark.checkpoint.dir``).

    Only where that is unset: a temporary folder in local mode, else the warehouse.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.sparkContext.master.startswith("local[")
        base = tempfile.mkdtemp(prefix="spark-") if local else spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
        if local:
            spark.conf.set("spark.checkpoint.dir", base)
    _made.append(f"{base}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def drop_scratch(spark: SparkSession) -> int:
    """Deletes what this process wrote below scratch paths, and says how many there were. For when the results that read them are saved."""
    paths, _made[:] = list(_made), []
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return len(paths)


def written(df: DataFrame, name: str = "t") -> DataFrame:
    """The rows, written to shared Parquet and read back: cuts lineage, outlives executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def broadcast_within(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it is proven to hold at most ``max_rows`` rows, else ``df`` as it is.

    The count stops at ``max_rows + 1`` rows. Give it cheap or written inputs.
    """
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def join_hot(left: DataFrame, right: DataFrame, key: str, counts: DataFrame, share: int = 1000) -> DataFrame:
    """``left`` left-joined with ``right``, which has each key once at most, where a few keys may hold most rows.

    counts: (key, c), rows of ``left`` by key, written. The keys with more than a ``share``-th of all rows, so fewer than
    ``share``, are joined by broadcast, rows without key with nothing, and the rest by a shuffle.
    """
    total = counts.agg(F.sum("c")).first()[0] or 0
    hot = counts.where(F.col(key).isNotNull() & (F.col("c") > total // share)).select(key)
    names = [c for c in right.columns if c != key]
    none = left.where(F.col(key).isNull()).select("*", *(F.lit(None).cast(right.schema[c].dataType).alias(c) for c in names))
    known = left.where(F.col(key).isNotNull())
    cold = known.join(F.broadcast(hot), key, "left_anti").join(right, key, "left")
    few = hot.join(right, key, "left")
    return cold.unionByName(known.join(F.broadcast(few), key)).unionByName(none)
