"""Queries of addresses, geocoding, agencies, listing pages and reports over the test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.functions import addresses as A, agencies as G, pages as P
from terrano.operators import geocode, reports
from terrano.sources.adapters import agencies, errors, listings, queue, raw_listings, run_items, table

S, D = SparkSession, DataFrame
#: Shapes of captured addresses; N stands for the order's key plus 100.
SHAPES = (
    "Mitre N", "Venta Departamento - Mitre N piso 2", "Ver fotos | Salta N, Rosario", "Ruta 33 km N", "Casa Central Mitre N", "Superficie N m2", "Av. Pellegrini N PB, Centro", "Mitre", "N",
    "Lote en Funes, Catamarca N", "Compartir",
)


def pick(i: Column, *values: str | None) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))


def captured(s: S, d: str) -> D:
    """One captured address for each order."""
    i = F.col("o_orderkey")
    shown = F.replace(pick(i, *SHAPES), F.lit("N"), (i + 100).cast("string"))
    return table(s, d, "orders").select(i.alias("id"), shown.alias("direccion"), pick(i, "Rosario", None, "Santa Fe").alias("ciudad"), pick(i, "Santa Fe", None, "Santa Fe").alias("provincia"))


def responses(s: S, d: str) -> D:
    """One geocoder response for each line item."""
    i, n = F.col("l_orderkey"), F.col("l_linenumber")
    ok = F.col("l_returnflag") != "R"
    kind = pick(i + n, "exact", "street", "area", "approximate")
    lat, lon = -31.5 - (i % 16) / 8.0, -60.5 - (n % 4) / 16.0
    return table(s, d, "lineitem").select(
        i.alias("id"), (n * 100_000_000 + F.col("l_partkey")).alias("n"), F.when(ok, "success").otherwise("error").alias("status"), F.when(ok, kind).alias("precision_geocoding"),
        F.when(ok, lat).alias("latitud"), F.when(ok, lon).alias("longitud"), pick(i, "Rosario", "Santa Fe", "Pueblo").alias("ciudad"), F.lit("Santa Fe").alias("provincia"), F.lit("Argentina").alias("pais"),
    )


def str24_address(s: S, d: str) -> D:
    """Best address, readiness and geocoder query of every captured row."""
    made = A.prepared({"direccion": F.col("direccion")}, F.col("ciudad"), F.col("provincia"), F.lit("Argentina"))
    return captured(s, d).withColumn("p", made).select("id", "p.address", "p.readiness", "p.source", "p.query")


def str25_query_variants(s: S, d: str) -> D:
    i = F.col("o_orderkey")
    text = F.concat(pick(i, "Pte. Roca ", "1ro de Mayo ", "Mitre "), i.cast("string"))
    return table(s, d, "orders").select(i.alias("id"), F.array_join(A.query_variants(text), "|").alias("variants"))


def sco12_best_geocode(s: S, d: str) -> D:
    return geocode.best_responses(responses(s, d), "id", "n").select("id", "n", "status", "confidence_level", "location_validation")


def sco13_apply_decision(s: S, d: str) -> D:
    rows = geocode.skip_reasons(geocode.rated(responses(s, d)))
    return rows.groupBy("skip_reason").agg(F.count("*").alias("n"))


def sco14_outliers(s: S, d: str) -> D:
    return geocode.discarded_outliers(geocode.rated(responses(s, d))).groupBy("status", "error_message").agg(F.count("*").alias("n"), F.count("latitud").alias("points"))


def sco16_geocoding_status(s: S, d: str) -> D:
    state = geocode.geocoding_status(*(F.col(c) for c in ("latitud", "longitud", "direccion", "ciudad", "provincia")))
    return raw_listings(s, d).groupBy(state.alias("estado")).agg(F.count("*").alias("n"))


def pip13_apply_geocodes(s: S, d: str) -> D:
    best = geocode.best_responses(responses(s, d), "id", "n")
    return geocode.apply_results(listings(s, d).select("id", "latitud", "longitud"), best, "id", "n")


def agg26_coordinate_audit(s: S, d: str) -> D:
    return geocode.coordinate_audit(responses(s, d))


def agency_fields(s: S, d: str) -> D:
    i = F.col("id")
    return agencies(s, d).select(
        "id", F.when(i % 9 == 0, None).when(i % 7 == 0, "Sol").when(i % 5 == 0, F.concat(F.lit("Obras "), F.col("nombre"))).when(i % 3 == 0, "Desarrollos Del Sur").otherwise("Norte Propiedades").alias("nombre"),
        pick(i, "https://www.norte.com.ar/x", "https://facebook.com/a", "norte.com.ar", None).alias("web"), F.when(i % 4 != 0, F.col("ciudad")).alias("ciudad"), F.when(i % 6 != 0, F.col("provincia")).alias("provincia"),
        pick(i, "341 412-3456", "12", None).alias("telefono"), F.when(i % 2 == 0, "Mitre 100").alias("direccion"), F.col("categoria"), F.lit(None).cast("string").alias("cms_detectado"),
        F.when(i % 8 == 0, "/listado").alias("url_listado"),
    )


def _points() -> Column:
    fields = ("nombre", "web", "ciudad", "provincia", "telefono", "direccion", "categoria", "cms_detectado", "url_listado")
    return G.confidence({c: F.col(c) for c in fields})


def sco04_agency_confidence(s: S, d: str) -> D:
    rows = agency_fields(s, d).withColumn("points", _points().cast("int"))
    return rows.select("id", "points", G.needs_review(F.col("nombre"), F.col("ciudad"), F.col("points")).alias("revisar"))


def cat10_agency_category(s: S, d: str) -> D:
    current = F.when(F.col("id") % 10 == 0, F.col("categoria")).when(F.col("id") % 2 == 0, "inmobiliaria")
    return agency_fields(s, d).groupBy(G.category(F.col("nombre"), current).alias("categoria")).agg(F.count("*").alias("n"))


def cat12_city_of_address(s: S, d: str) -> D:
    i = F.col("o_orderkey")
    text = F.concat(F.lit("Mitre "), i.cast("string"), pick(i, ", Rosario, Santa Fe", ", S2000 Rosario, 2000", "", ", 2000, AR"))
    return table(s, d, "orders").select(i.alias("id"), G.city_of_address(text).alias("ciudad"))


def agg17_last_runs(s: S, d: str) -> D:
    return reports.last_runs(run_items(s, d))


def agg18_status_without(s: S, d: str) -> D:
    return reports.status_counts(queue(s, d), "status", table(s, d, "lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("staging_id")), "staging_id")


def agg19_audit(s: S, d: str) -> D:
    checks = {
        "estado": F.col("estado") == "activa", "imagenes": F.col("n_imagenes") > 0, "moneda": F.upper("moneda") == "USD", "precio": F.col("precio") > 0, "superficie": F.col("area") > 0,
        "caja": F.col("latitud").between(-35.0, -34.0) & F.col("longitud").between(-60.0, -58.0),
    }
    return reports.audit(listings(s, d), checks)


def agg20_problems(s: S, d: str) -> D:
    rows = agency_fields(s, d).withColumn("points", _points())
    return reports.problem_counts(rows, G.problems(*(F.col(c) for c in ("nombre", "telefono", "direccion", "ciudad", "provincia", "web", "points"))))


def agg22_enrichment_stats(s: S, d: str) -> D:
    return reports.enrichment_stats(agency_fields(s, d), _points(), G.own_site(F.col("web")), G.valid_phone(F.col("telefono")))


def agg23_gates(s: S, d: str) -> D:
    return reports.gate(run_items(s, d), ["run_id"], F.col("status") == "error", 0.15)


def agg25_top_sources(s: S, d: str) -> D:
    return reports.top_counts(errors(s, d), "inmobiliaria_id")


def agg28_stuck(s: S, d: str) -> D:
    return reports.stuck(queue(s, d), "publishing", "staging_id")


def agg31_before_after(s: S, d: str) -> D:
    """Line items of each order: with early ship dates before, open ones after."""
    items = table(s, d, "lineitem")
    count = lambda rows: rows.groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return reports.before_after(count(items.where("l_linestatus = 'F'")), count(items.where("l_returnflag = 'N'")), "l_orderkey", "n")


def web06_detail_fields(s: S, d: str) -> D:
    """Title, classes and pictures of every page."""
    rows = table(s, d, "pages").withColumn("f", P.detail(F.col("html")))
    return rows.select("page_id", "f.title", "f.n_photos", F.size(P.class_tokens(F.col("html"))).cast("long").alias("n_classes"))


QUERIES = {n: f for n, f in list(globals().items()) if callable(f) and getattr(f, "__module__", "") == __name__ and n[:3] in ("str", "sco", "pip", "agg", "cat", "web")}
