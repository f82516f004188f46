"""Validation, publish queue and retention: ordered rules as chained conditions, states as new snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.functions import normalize as N, places as L
from terrano.functions.urls import canonical

#: Age in days beyond which rows of a table and status go.
RETENTION = (("publish_queue", "done", 7), ("staging", "published", 14), ("raw", "published", 30), ("raw", "rejected", 7), ("run_items", None, 90), ("issues", None, 60))


def _blank(c: str) -> Column:
    return N.clean(F.col(c)).isNull()


def _agency(c: str = "inmobiliaria_id") -> Column:
    n = F.col(c).try_cast("long")
    return F.when(n > 0, n)


def validate(raw: DataFrame, known_hashes: DataFrame | None = None) -> DataFrame:
    """``raw`` with hard and soft issues, validation_score, geocoding_status and status staging or rejected.

    Missing data costs points and never rejects. A hash is a duplicate if it is known or if an earlier
    valid row has it; only valid rows block later ones. Place is the row's own or told by its URL's host (``place``). Rows
    without hash meet nothing in the joins.
    """
    # computed for both sides of the self-join below: writing them once took 32 s where this takes 22 (150,000 rows, eight threads)
    df = raw.withColumns(
        {
            "_price": N.locale_number(F.col("precio")),
            "_operation": N.operation(F.col("operacion")),
            "_original": F.lower(N.clean(F.col("operacion"))),
            "place": L.place_of_signals(F.col("ciudad"), F.col("provincia"), F.col("url")),
            "_address": L.address_value(F.col("direccion")),
            # a key of its own for each row without hash, so that these do not gather in one task
            "_key": F.coalesce(N.clean(F.col("hash_dedup")), F.concat(F.lit("\0"), F.col("pos").cast("string"))),
        }
    )
    df = df.withColumns({"_no_place": F.col("place.city").isNull() & F.col("place.province").isNull(), "_no_address": F.col("_address.value").isNull()})
    given = ~_blank("precio")
    currency = F.upper(N.clean(F.col("moneda")))
    operation, original, no_place, no_address = (F.col(c) for c in ("_operation", "_original", "_no_place", "_no_address"))
    hard = [
        F.when(_blank("hash_dedup"), "missing_hash"),
        F.when(_agency().isNull(), "missing_inmobiliaria_id"),
        F.when(canonical(F.col("url")) == "", "missing_url"),
        F.when(given & (F.col("_price").isNull() | (F.col("_price") <= 0)), "invalid_price"),
        F.when((F.col("_price") > 0) & ~F.coalesce(currency.isin("ARS", "USD"), F.lit(False)), "invalid_currency"),
    ]
    present = lambda *issues: F.filter(F.array(*issues), lambda x: x.isNotNull())
    df = df.withColumn("hard", present(*hard))
    if known_hashes is not None:
        df = df.join(known_hashes.select(F.col("hash_dedup").alias("_key"), F.lit(True).alias("_known")).distinct(), "_key", "left")
    else:
        df = df.withColumn("_known", F.lit(None).cast("boolean"))
    valid = (F.size("hard") == 0) & F.col("_known").isNull()
    first = df.where(valid).groupBy("_key").agg(F.min("pos").alias("_first"))
    df = df.join(first, "_key", "left")
    again = F.coalesce(F.col("_known"), F.lit(False)) | F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))
    df = df.withColumn("hard", F.concat("hard", F.when(again, F.array(F.lit("duplicate"))).otherwise(F.array().cast("array<string>"))))

    some_point = F.col("latitud").isNotNull() | F.col("longitud").isNotNull()
    in_country = F.coalesce(F.col("latitud").between(-55, -21) & F.col("longitud").between(-74, -53), F.lit(False))
    soft = [
        (no_place, "missing_location", 15),
        (F.col("place.inferred"), "location_inferred_from_text", 0),
        (_blank("tipo_propiedad"), "missing_type", 15),
        (_blank("titulo"), "missing_title", 5),
        (F.col("n_imagenes") == 0, "missing_images", 10),
        (F.col("_address.reason").isNotNull(), "invalid_address", 5),
        (no_address & ~no_place, "geocoding_skipped_approx_location", 5),
        (some_point & ~in_country, "invalid_coordinates", 10),
        ((operation == "consultar") & original.isNotNull() & (original != "consultar"), "operacion_normalizada_consultar", 0),
        (operation == "venta_y_alquiler", "operacion_venta_y_alquiler", 0),
    ]
    unpriced = F.coalesce(F.col("_price") <= 0, F.lit(True))  # costs points, but is no issue
    penalty = sum((F.when(c, p).otherwise(0) for c, _, p in soft), F.when(unpriced, 20).otherwise(0))
    geo = F.when(in_country, "done").when(no_address & ~no_place, "skipped").otherwise("pending")
    out = df.withColumns(
        {
            "soft": present(*(F.when(c, name) for c, name, _ in soft)),
            "validation_score": F.greatest(F.lit(0), 100 - penalty),
            "geocoding_status": geo,
            "operacion_norm": operation,
            "precio_num": F.when(F.col("_price") > 0, F.col("_price")),
            "status": F.when(F.size("hard") == 0, "staging").otherwise("rejected"),
        }
    )
    return out.drop("_price", "_operation", "_original", "_no_place", "_no_address", "_known", "_first", "_key", "_address")


def _no_url(url: str, canonical_url: str | None) -> Column:
    return _blank(url) & _blank(canonical_url) if canonical_url else _blank(url)


def queue_skip_reason(min_score: int, allow_pending: bool, canonical_url: str | None = None) -> Column:
    """Why a staging row does not enter the queue: the first rule that fails; null if none does. ``canonical_url``: a second column that may hold the URL."""
    geo = ("done", "skipped", "pending", "failed") if allow_pending else ("done", "skipped")
    return (
        F.when(_blank("hash_dedup"), "skip_missing_hash")
        .when(_agency().isNull(), "skip_missing_inmobiliaria")
        .when(_no_url("url", canonical_url), "skip_missing_url")
        .when(~F.coalesce(F.lower(N.clean(F.col("operacion"))).isin(*N.OPERATIONS), F.lit(False)), "skip_invalid_operation")
        .when(F.coalesce(F.col("validation_score"), F.lit(0)) < min_score, "skip_low_score")
        .when(~F.coalesce(F.lower(N.clean(F.col("geocoding_status"))).isin(*geo), F.lit(False)), "skip_geocoding_pending")
    )


def publish_skip_reason(min_score: int, allow_pending: bool, canonical_url: str | None = None) -> Column:
    """Why a queued row is not published; tests status and title too, and place before score."""
    geo = ("done", "skipped", "pending", "failed") if allow_pending else ("done", "skipped")
    return (
        F.when(F.lower(F.coalesce(N.clean(F.col("status")), F.lit(""))) != "queued", "invalid_staging_status")
        .when(_blank("hash_dedup"), "missing_hash")
        .when(_agency().isNull(), "missing_inmobiliaria")
        .when(_no_url("url", canonical_url), "missing_url")
        .when(_blank("titulo"), "missing_title")
        .when(~F.coalesce(F.lower(N.clean(F.col("operacion"))).isin(*N.OPERATIONS), F.lit(False)), "invalid_operation")
        .when(~F.coalesce(F.lower(N.clean(F.col("geocoding_status"))).isin(*geo), F.lit(False)), "geocoding_pending")
        .when(F.coalesce(F.col("validation_score"), F.lit(0)) < min_score, "low_score")
    )


def priority(score: Column, geocoding: Column, price: Column) -> Column:
    """1 for good, located, priced rows; 2 for fair ones or located ones without price; else 3."""
    done = F.coalesce(F.lower(geocoding) == "done", F.lit(False))
    return F.when((score >= 90) & done & F.coalesce(price > 0, F.lit(False)), 1).when((score >= 70) | (done & price.isNull()), 2).otherwise(3)


def claim(queue: DataFrame, n: int) -> DataFrame:
    """The next pending rows by priority, time and id, as publishing."""
    return queue.where("status = 'pending'").orderBy("priority", "queued_at", "staging_id").limit(n).withColumn("status", F.lit("publishing"))


def reclaim(queue: DataFrame, as_of: str, minutes: int = 30, most: int = 5, at: Column | None = None) -> DataFrame:
    """Rows stuck in publishing go back to pending with one more attempt; those of ``most`` attempts stay for a look by hand.

    ``at``: the last attempt, by default queued_at.
    """
    late = (at if at is not None else F.col("queued_at")) < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    stale = F.coalesce((F.col("status") == "publishing") & late & (F.col("attempts") < most), F.lit(False))
    return queue.withColumns({"status": F.when(stale, "pending").otherwise(F.col("status")), "attempts": F.col("attempts") + F.when(stale, 1).otherwise(0)})


def reset_stale(df: DataFrame, states: dict[str, str], at: str, as_of: str, minutes: int = 120) -> DataFrame:
    """Rows that have been in one of the states for too long go back to the state given; attempts stay as they are."""
    old = F.col(at) < F.lit(as_of).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    out = F.col("status")
    for state, to in states.items():
        out = F.when((F.col("status") == state) & old, to).otherwise(out)
    return df.withColumn("status", out)


def retained(df: DataFrame, table: str, as_of: str, at: str, status: str | None = "status") -> DataFrame:
    """``df`` without the rows that the table's retention rules delete."""
    for name, state, days in RETENTION:
        if name == table:
            old = F.col(at) < F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))
            gone = old & (F.col(status) == state) if state is not None else old
            df = df.where(~F.coalesce(gone, F.lit(False)))
    return df


def retry_candidates(items: DataFrame, allowed: list[str], limit: int, pending: DataFrame | None = None) -> DataFrame:
    """(id, inmobiliaria_id, decision, reason) of failed items up to the limit; one item an agency.

    Rows after the limit is reached are neither created nor skipped.
    """
    df = items.where("status = 'error'")
    reason = F.when(~F.coalesce(F.col("error_type").isin(*allowed), F.lit(False)), "error_type")
    if pending is not None:
        df = df.join(pending.select("inmobiliaria_id", F.lit(True).alias("_busy")).distinct(), "inmobiliaria_id", "left")
        reason = reason.when(F.col("_busy"), "pending")
    df = df.withColumn("reason", reason)
    first = df.where("reason is null").groupBy("inmobiliaria_id").agg(F.min("id").alias("_first"))
    df = df.join(first, "inmobiliaria_id", "left").withColumn("reason", F.when(F.col("reason").isNull() & (F.col("id") != F.col("_first")), "repeated").otherwise(F.col("reason")))
    if limit > 0:
        # the last id within the limit: a top-k of ids and one row to the driver, no window over all rows
        last = df.where("reason is null").select("id").orderBy("id").limit(limit).agg(F.max("id").alias("id"), F.count("*").alias("n")).first()
        if last["n"] == limit:
            df = df.where(F.col("id") <= last["id"])
    return df.select("id", "inmobiliaria_id", F.when(F.col("reason").isNull(), "create").otherwise("skip").alias("decision"), "reason")


def even_batches(df: DataFrame, order: str, n: int) -> DataFrame:
    """``df`` with batch 0 to n - 1 of contiguous rows, ceil(count / n) each.

    Ranks come from counts of ordered ranges, so no task orders all rows.
    """
    from pyspark.sql import SparkSession

    spark: SparkSession = df.sparkSession
    total = df.count()
    size = max(1, -(-total // n))
    parts = max(1, min(2048, total // 50_000 + 1))
    bounds = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)] or [0.5], 10_000)).first()[0] if total else []
    edges = sorted(set(bounds)) if parts > 1 else []
    bucket = F.size(F.filter(F.array(*map(F.lit, edges)), lambda b: b <= F.col(order))) if edges else F.lit(0)
    dealt = df.withColumn("_b", bucket)
    counts = {r["_b"]: r["n"] for r in dealt.groupBy("_b").agg(F.count("*").alias("n")).collect()}  # at most 2048 rows
    starts, at = [], 0
    for b in sorted(counts):
        starts.append((b, at))
        at += counts[b]
    first = F.broadcast(spark.createDataFrame(starts or [(0, 0)], "_b int, _at long"))
    place = F.row_number().over(W.partitionBy("_b").orderBy(order)) - 1
    return dealt.withColumn("_r", place).join(first, "_b").withColumn("batch", F.floor((F.col("_at") + F.col("_r")) / size)).drop("_b", "_r", "_at")
