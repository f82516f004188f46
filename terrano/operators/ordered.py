"""Operations in one order over all rows: running totals by ranges, greedy selection with a limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.operators.dedupe import first_wins
from terrano.session import written


def running_total(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before each, in an order without ties.

    Two passes: rows are dealt by ranges of the order and each range is summed, then each row adds the sums of the ranges
    before it to what stands before it in its own. The driver sees one sum a range, and no window spans the table.
    """
    spark = df.sparkSession
    ranges = written(df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id()), "ranges")
    starts, before = [], 0
    for r in ranges.groupBy("_range").agg(F.sum(value).alias("n")).orderBy("_range").collect():
        starts.append((r["_range"], before))
        before += r["n"] or 0
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    first = F.broadcast(spark.createDataFrame(starts, "_range int, _range_from long"))
    return ranges.withColumn(name, inside).join(first, "_range").withColumn(name, (F.col(name) + F.col("_range_from")).cast("long")).drop("_range", "_range_from")


def select_greedily(rows: DataFrame, reason: Column, key: str, taken: DataFrame, limit: int, order: str) -> DataFrame:
    """``rows`` with ``outcome``: create, why not, or not_reached, as a pass over the rows in order gives them.

    A row is left out for ``reason`` if that is not null, as inmobiliaria_id_invalido without a whole number as key, as
    ya_tiene_pending if its key is in ``taken`` (one column), as duplicado_en_lote if a row before it was created for that key. Once
    ``limit`` rows are created no further row is looked at; a limit of zero or less is none. ``order``: without ties.
    """
    whole = F.col(key).cast("string").try_cast("long")
    known = taken.select(F.col(taken.columns[0]).cast("long").alias("_key")).where("_key is not null").distinct().withColumn("_taken", F.lit(True))
    judged = rows.withColumn("_key", whole).join(known, "_key", "left")
    why = F.coalesce(reason, F.when(F.col("_key").isNull(), "inmobiliaria_id_invalido"), F.when(F.col("_taken"), "ya_tiene_pending"))
    judged = written(judged.withColumn("_why", why), "judged")
    firsts = first_wins(judged.where("_why is null").select("_key", F.col(order).alias("_at")), ["_key"], [F.col("_at")]).select(F.col("_at").alias(order), F.lit(1).alias("_first"))
    placed = judged.join(firsts, order, "left").withColumn("_first", F.coalesce("_first", F.lit(0)))
    if limit > 0:
        placed = running_total(placed, [order], F.col("_first"), "_before")
    else:
        placed = placed.withColumn("_before", F.lit(0).cast("long"))
    reached = F.lit(True) if limit <= 0 else F.col("_before") < limit
    outcome = F.when(~reached, "not_reached").otherwise(F.coalesce("_why", F.when(F.col("_first") == 1, "create").otherwise("duplicado_en_lote")))
    return placed.withColumn("outcome", outcome).drop("_key", "_taken", "_why", "_first", "_before")
