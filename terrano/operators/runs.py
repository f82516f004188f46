"""Scraping runs and their items: claims, starts, retries, ends, counters. Every step is a new snapshot of the table.

Items: id, run_id, inmobiliaria_id, status, created_at, started_at, finished_at, duration_seconds, detectadas, nuevas, error_message, error_type, http_status.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions.parsing import seconds_between
from terrano.operators.dedupe import first_wins

COUNTERS = ("procesadas", "exitosas", "con_error", "detectadas", "nuevas")


def _now(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp")


def _marked(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select(F.col(ids.columns[0]).alias("id"), F.lit(True).alias("_in")).distinct(), "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))


def _set(items: DataFrame, values: dict[str, Column]) -> DataFrame:
    return items.withColumns({c: F.when(F.col("_in"), v.cast(items.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()}).drop("_in")


def next_pending(items: DataFrame, n: int = 1) -> DataFrame:
    """The ids of the oldest pending items; ids break ties."""
    return items.where("status = 'pending'").orderBy("created_at", "id").limit(n).select("id")


def started(items: DataFrame, ids: DataFrame, as_of: str) -> DataFrame:
    """The items running; the first start stays. Doing it twice changes nothing."""
    return _set(_marked(items, ids), {"status": F.lit("running"), "started_at": F.coalesce("started_at", _now(as_of))})


def claimed(items: DataFrame, as_of: str, n: int = 1) -> DataFrame:
    """``items`` after the oldest pending ones were claimed."""
    return started(items, next_pending(items, n), as_of)


def retried(items: DataFrame, ids: DataFrame) -> DataFrame:
    """The items pending again, without times and errors; their counts stay."""
    gone = ("started_at", "finished_at", "duration_seconds", "error_message", "error_type", "http_status")
    return _set(_marked(items, ids), {"status": F.lit("pending"), **{c: F.lit(None) for c in gone}})


def _ended(as_of: str) -> dict[str, Column]:
    return {"finished_at": _now(as_of), "duration_seconds": seconds_between(F.col("started_at"), _now(as_of))}


def succeeded(items: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """The items of the results ended well, with their counts. results: id, detectadas, nuevas; null counts are zero."""
    rows = items.join(results.select("id", F.col("detectadas").alias("_d"), F.col("nuevas").alias("_n"), F.lit(True).alias("_in")), "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return _set(rows, {"status": F.lit("success"), **_ended(as_of), "detectadas": F.coalesce("_d", F.lit(0)), "nuevas": F.coalesce("_n", F.lit(0))}).drop("_d", "_n")


def failed(items: DataFrame, results: DataFrame, as_of: str) -> DataFrame:
    """The items of the results ended with an error. results: id, error_message, error_type, http_status."""
    new = results.select("id", *(F.col(c).alias(f"_{c}") for c in ("error_message", "error_type", "http_status")), F.lit(True).alias("_in"))
    rows = items.join(new, "id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return _set(rows, {"status": F.lit("error"), **_ended(as_of), **{c: F.col(f"_{c}") for c in ("error_message", "error_type", "http_status")}}).drop("_error_message", "_error_type", "_http_status")


def counted(runs: DataFrame, ended: DataFrame) -> DataFrame:
    """``runs`` with the counts of items that ended since added to their counters. ended: run_id, status, detectadas, nuevas."""
    ok = F.col("status") == "success"
    sums = ended.groupBy(F.col("run_id").alias("_r")).agg(
        F.count("*").alias("_procesadas"), F.count_if(ok).alias("_exitosas"), F.count_if(~ok).alias("_con_error"), F.sum(F.when(ok, F.coalesce("detectadas", F.lit(0)))).alias("_detectadas"), F.sum(F.when(ok, F.coalesce("nuevas", F.lit(0)))).alias("_nuevas")
    )
    rows = runs.join(sums, F.col("run_id") == F.col("_r"), "left")
    return rows.withColumns({c: F.col(c) + F.coalesce(f"_{c}", F.lit(0)) for c in COUNTERS}).select(*runs.columns)


def closed(runs: DataFrame, items: DataFrame, as_of: str) -> DataFrame:
    """Runs without pending or running items are finished; a first end stays. Runs: run_id, status, started_at, finished_at, duration_seconds."""
    open_ = items.where(F.col("status").isin("pending", "running")).select("run_id", F.lit(True).alias("_open")).distinct()
    end = F.coalesce("finished_at", _now(as_of))
    rows = runs.join(open_, "run_id", "left").withColumn("_in", F.col("_open").isNull()).drop("_open")
    return _set(rows, {"status": F.lit("finished"), "duration_seconds": seconds_between(F.col("started_at"), end), "finished_at": end})


def new_run(spark, run_id: int, limit: int, kind: str, source: str, notes: str | None, as_of: str) -> DataFrame:
    """One row: a run before its first item."""
    row = spark.range(1).select(F.lit(run_id).cast("long").alias("run_id"), F.lit("running").alias("status"), F.lit(kind).alias("run_type"), F.lit(source).alias("source_view"), F.lit(limit).alias("limit_requested"), F.lit(notes).cast("string").alias("notes"), _now(as_of).alias("started_at"))
    return row.withColumns({c: F.lit(0).cast("long") for c in COUNTERS}).withColumns({"finished_at": F.lit(None).cast("timestamp"), "duration_seconds": F.lit(None).cast("int")})


def candidates(agencies: DataFrame, active: DataFrame, ready: Column, score: str, total: str, n: int) -> DataFrame:
    """Up to ``n`` agencies for a run, ready ones before new ones: by score, then total, both from the top, then id; none that is active, walled or without site.

    agencies: id, web, url_listado, antibot and the two figures; active: inmobiliaria_id of pending and running items.
    """
    text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    open_ = agencies.join(active.select(F.col("inmobiliaria_id").alias("id")).distinct(), "id", "left_anti").where(((text("web") != "") | (text("url_listado") != "")) & ~F.coalesce("antibot", F.lit(False)))
    ranked = first_wins(open_.withColumn("pass", F.when(ready, 1).otherwise(2)), ["id"], [F.col("pass").asc()])
    return ranked.orderBy("pass", F.col(score).desc_nulls_last(), F.col(total).desc_nulls_last(), "id").limit(n)


def planned_items(candidates: DataFrame, run_id: int, as_of: str) -> DataFrame:
    """A run's items for its candidates, the reasons of their choice as JSON."""
    why = F.to_json(F.struct(F.struct(F.col("pass"), F.col("id").alias("inmobiliaria_id")).alias("prioridad")))
    return candidates.select(F.lit(run_id).cast("long").alias("run_id"), F.col("id").alias("inmobiliaria_id"), F.lit("pending").alias("status"), "web", "url_listado", why.alias("metadata"), _now(as_of).alias("created_at"))


def retry_items(failed_items: DataFrame, run_id: int, notes: str, as_of: str) -> DataFrame:
    """Copies of failed items for a new run, with where they come from as JSON."""
    origin = F.to_json(F.struct(F.struct(F.col("id").alias("item_id"), F.col("run_id"), F.col("error_type"), F.lit(notes).alias("notes")).alias("retry_of")))
    return failed_items.select(F.lit(run_id).cast("long").alias("run_id"), "inmobiliaria_id", F.lit("pending").alias("status"), origin.alias("metadata"), _now(as_of).alias("created_at"))


def wanted_queries(missing: DataFrame, columns: list[str], words: str, n: int = 50) -> DataFrame:
    """The first ``n`` distinct search texts for what is missing: the words and the row's places. The report's length is its feature."""
    text = F.concat_ws(" ", F.lit(words), *(F.nullif(F.trim(c), F.lit("")) for c in columns))
    return missing.select(text.alias("query")).distinct().orderBy("query").limit(n)
