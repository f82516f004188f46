"""Geocoding results: precision, best response, gating and application. No network: responses are rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions import addresses as A, places as L
from terrano.functions.normalize import clean
from terrano.session import join_hot, written

RANK = {"high": 3, "medium": 2, "low": 1}


def precision(address_type: Column, kind: Column, place_rank: Column) -> Column:
    """Precision class of a response: exact, street, area or approximate. Nulls fit no rule."""
    a, k = F.lower(address_type), F.lower(kind)
    return (
        F.when(a.isin("house", "building") | k.isin("house", "building"), "exact")
        .when(a.isin("road", "street") | k.isin("residential", "tertiary", "secondary", "primary"), "street")
        .when(a.isin("neighbourhood", "suburb", "quarter", "city", "town"), "area")
        .when(place_rank.try_cast("int") >= 26, "street")
        .otherwise("approximate")
    )


def confidence(status: Column, precision_class: Column) -> Column:
    """high for exact, medium for street and interpolated successes, else low."""
    p = F.lower(precision_class)
    return F.when((status == "success") & (p == "exact"), "high").when((status == "success") & p.isin("street", "interpolated"), "medium").otherwise("low")


def rated(responses: DataFrame) -> DataFrame:
    """Adds within_city_bounds, confidence_level, should_apply, needs_review, location_validation and quality_flag.

    Needs status, precision_geocoding, latitud, longitud, ciudad, provincia, pais. A success outside its city's box is low.
    """
    within = A.within_city(F.col("latitud"), F.col("longitud"), F.col("ciudad"), F.col("provincia"), F.col("pais"))
    rows = responses.withColumn("within_city_bounds", within)
    outlier = (F.col("status") == "success") & ~F.coalesce("within_city_bounds", F.lit(True))
    rows = rows.withColumn("confidence_level", F.when(outlier, "low").otherwise(confidence(F.col("status"), F.col("precision_geocoding"))))
    rows = rows.withColumn("should_apply", F.col("confidence_level") != "low").withColumn("needs_review", F.col("confidence_level") == "low")
    state = F.when(F.col("within_city_bounds"), "within_city_bounds").when(~F.col("within_city_bounds"), "coordenada_descartada_por_outlier").otherwise("no_rule")
    return rows.withColumn("location_validation", state).withColumn("quality_flag", F.when(F.col("needs_review"), "baja_confianza").otherwise("aplicable"))


def best_responses(responses: DataFrame, key: str, order: str) -> DataFrame:
    """The best response of each key: the highest confidence among successes, the earliest on ties; the last one if none succeeded."""
    rank = F.when(F.col("status") == "success", F.create_map(*(F.lit(x) for kv in RANK.items() for x in kv))[F.col("confidence_level")]).otherwise(0)
    place = F.when(rank > 0, -F.col(order)).otherwise(F.col(order))
    return rated(responses).groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("*"), F.struct(rank, place)).alias("_best")).select("_best.*")


def discarded_outliers(results: DataFrame) -> DataFrame:
    """Rated results whose points lie outside their city or the country become errors without coordinates."""
    success = F.col("status") == "success"
    error = (
        F.when(success & ~F.coalesce("within_city_bounds", F.lit(True)), "geocoding_coordinates_discarded_by_outlier_validation")
        .when(success & ~A.inside(F.col("latitud"), F.col("longitud"), A.ARGENTINA), "geocoding_coordinates_outside_argentina_bounds")
    )
    rows = results.withColumn("error_message", error)
    bad = F.col("error_message").isNotNull()
    rows = rows.withColumn("latitud", F.when(~bad, F.col("latitud"))).withColumn("longitud", F.when(~bad, F.col("longitud")))
    return rows.withColumn("status", F.when(bad, "error").otherwise(F.col("status")))


def skip_reasons(results: DataFrame) -> DataFrame:
    """Adds skip_reason to rated results: all reasons not to apply one, in order, joined by commas; null if it can be applied."""
    no_point = F.col("latitud").isNull() | F.col("longitud").isNull()
    rules = {
        "status_not_success": F.coalesce(F.lower("status") != "success", F.lit(True)),
        "missing_coordinates": no_point,
        "outside_argentina_bounds": ~no_point & ~A.inside(F.col("latitud"), F.col("longitud"), A.ARGENTINA),
        "should_apply_false": ~F.col("should_apply"),
        "needs_review_true": F.col("needs_review"),
        "quality_flag_baja_confianza": F.col("quality_flag") == "baja_confianza",
        "location_validation_not_within_city_bounds": F.col("location_validation") != "within_city_bounds",
        "confidence_not_allowed": F.col("confidence_level") == "low",
    }
    return results.withColumn("skip_reason", F.nullif(F.concat_ws(",", *(F.when(c, n) for n, c in rules.items())), F.lit("")))


def apply_results(listings: DataFrame, results: DataFrame, key: str, order: str) -> DataFrame:
    """Listings with the coordinates of the newest applicable result of each; columns and rows are otherwise unchanged."""
    good = skip_reasons(results).where(F.col("skip_reason").isNull() & A.coordinates_plausible(*(F.col(c) for c in ("latitud", "longitud", "ciudad", "provincia", "pais"))))
    newest = good.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct("latitud", "longitud"), order).alias("_point"))
    rows = listings.join(newest, F.col(key) == F.col("_key"), "left")
    moved = {c: F.coalesce(F.col("_point")[c], F.col(c)).alias(c) for c in ("latitud", "longitud")}
    return rows.select(*(moved.get(c, F.col(c)) for c in listings.columns))


def coordinate_audit(df: DataFrame) -> DataFrame:
    """(state, n): within_bounds, outside_bounds, no_bounds_configured or invalid_coordinates of rows with coordinates."""
    within = A.within_city(F.col("latitud"), F.col("longitud"), F.col("ciudad"), F.col("provincia"), F.col("pais"))
    state = F.when(F.col("latitud").isNull() | F.col("longitud").isNull(), "invalid_coordinates").when(within, "within_bounds").when(~within, "outside_bounds").otherwise("no_bounds_configured")
    return df.groupBy(state.alias("state")).agg(F.count("*").alias("n"))


def geocoding_status(lat: Column, lon: Column, address: Column, city: Column, province: Column) -> Column:
    """done with a point, skipped if only the place is known, else pending."""
    blank = lambda x: F.coalesce(x, F.lit("")) == ""
    return F.when(lat.isNotNull() & lon.isNotNull(), "done").when(blank(address) & ~(blank(city) & blank(province)), "skipped").otherwise("pending")


def geocoder_rows(staging: DataFrame) -> DataFrame:
    """Staging rows as the geocoder takes them: the address without labels and title openings, place by the row, else by the words of its URL."""
    place = L.place_of_context(F.lit(None).cast("string"), F.lit(None).cast("string"), L.url_words(F.col("url")))
    rows = staging.withColumns({"_place": place, "direccion": A.geocoding_text(F.col("direccion_normalizada"))})
    return rows.withColumns({"ciudad": F.coalesce(clean(F.col("ciudad")), "_place.city"), "provincia": F.coalesce(clean(F.col("provincia")), "_place.province"), "pais": F.coalesce(clean(F.col("pais")), F.lit("Argentina"))}).drop("_place")


#: What a row's address, place and queries are made of; rows by which their results are broadcast.
GEOCODED_FROM = ("direccion_normalizada", "titulo", "barrio", "ciudad", "provincia", "pais", "url")
MAX_BROADCAST_TEXTS = 20_000


def geocoded(staging: DataFrame, lookup: DataFrame, max_broadcast: int = MAX_BROADCAST_TEXTS) -> DataFrame:
    """``staging`` with geocoding_status (done, failed, skipped), latitud and longitud. lookup: query, status, latitud, longitud, precision_geocoding, one row a query.

    Rows whose address is garbage or not safe are skipped without a query; of a row's spellings the first found counts, and its point
    must lie in the country and the city's box. Rows of the same texts have the same result: each text is prepared once, in as
    many tasks as shuffles have, and its result joined to its rows, by broadcast where there are few texts or many rows have it.
    """
    tasks = int(staging.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = staging.withColumn("_texts", F.struct(*GEOCODED_FROM))
    counts = written(keyed.groupBy("_texts").agg(F.count("*").alias("c")), "texts")
    rows = geocoder_rows(counts.repartition(tasks, "_texts").select("_texts", "_texts.*"))
    fields = {"direccion": F.col("direccion"), "direccion_limpia": F.col("direccion"), "direccion_geocoding_limpia": F.col("direccion"), "titulo": F.col("titulo"), "barrio": F.col("barrio")}
    made = A.prepared(fields, F.col("ciudad"), F.col("provincia"), F.col("pais"))
    rows = rows.withColumn("_ready", F.when(~A.is_garbage(F.col("direccion")), made))
    queries = F.when(F.col("_ready.readiness") == "geocoding_ready_safe", A.query_variants(F.col("_ready.query")))
    rows = written(rows.select("_texts", "direccion", "ciudad", "provincia", "pais", queries.alias("_queries")), "prepared")
    ask = rows.select("_texts", F.posexplode("_queries").alias("_n", "query"))
    found = ask.join(lookup, "query").groupBy("_texts").agg(F.min_by(F.struct("status", "latitud", "longitud"), F.struct(F.when(F.col("status") == "success", 0).otherwise(1), "_n")).alias("_x"))
    out = rows.join(found, "_texts", "left")
    good = F.coalesce((F.col("_x.status") == "success") & A.coordinates_fit(F.col("_x.latitud"), F.col("_x.longitud"), F.col("ciudad"), F.col("provincia"), F.col("pais")), F.lit(False))
    state = F.when(F.coalesce(F.size("_queries") < 1, F.lit(True)), "skipped").when(good, "done").otherwise("failed")
    point = F.when(good, F.col("_x.latitud")).alias("latitud"), F.when(good, F.col("_x.longitud")).alias("longitud")
    results = written(out.select("_texts", F.struct("direccion", "ciudad", "provincia", "pais", state.alias("geocoding_status"), *point).alias("_of")), "results")
    few = results.limit(max_broadcast + 1).count() <= max_broadcast
    joined = keyed.join(F.broadcast(results), "_texts") if few else join_hot(keyed, results, "_texts", counts)
    new = ("direccion", "ciudad", "provincia", "pais", "geocoding_status", "latitud", "longitud")
    kept = [c for c in staging.columns if c not in ("latitud", "longitud")]
    return joined.select(*(F.col(f"_of.{c}").alias(c) if c in new else F.col(c) for c in [*kept, *(c for c in new if c not in kept)]))


def new_results(results: DataFrame, cache: DataFrame) -> DataFrame:
    """Results whose listing and query the cache lacks. Both: propiedad_id, direccion_geocoding."""
    keys = ["propiedad_id", "direccion_geocoding"]
    return results.join(cache.select(*keys).distinct(), keys, "left_anti")
