"""Addresses and geocoding results, hand-worked."""

import pytest
from pyspark.sql import functions as F

from terrano.functions import addresses as A
from terrano.operators import geocode

CASES = [
    (A.tidy, {" a  b ,.-": "a b", None: "", " - ": ""}),
    (A.place_key, {"San José del Rincón": "san jose del rincon", "N° 5ª": "n 5a", "Straße": "strae", None: ""}),
    (A.control_text, {"Galería de imágenes Mitre 100": "texto_ui_galeria_de_imagenes", "ver foto": "texto_ui_ver_fotos", "BÚSQUEDA DE PROPIEDADES": "texto_ui_busqueda_propiedades", "Mitre 100": None, None: None}),
    (A.without_controls, {"Mitre 100 | Ver fotos Compartir": "Mitre 100", "galerÃ­a de imÃ¡genes": "", None: ""}),
    (A.without_advert_words, {"Mitre 100 dos dormitorios balcón": "Mitre 100", "a estrenar": ""}),
    (A.without_leading_words, {"Venta Departamento - Mitre 100": "Mitre 100", "2 dormitorios. Casa Salta 50": "Salta 50", "Casablanca 100": "Casablanca 100", "depto. Mitre 9": "Mitre 9"}),
    (A.without_unit, {"Mitre 100 piso 3 B": "Mitre 100", "Mitre 100 depto 4": "Mitre 100", "Mitre 100 PB": "Mitre 100", "Mitre 100 2 A": "Mitre 100", "Mitre 100": "Mitre 100"}),
    (A.is_surface, {"120 m2": True, "desde 300": True, "Mitre 100": False, None: False}),
    (A.is_generic, {"Rosario": True, "1234": True, "casa central Mitre 100": True, "Mitre 100": False, "Mitre 5": True, None: True}),
    (A.is_route, {"Ruta 9 km 40": True, "RP 21": True, "Rutaceas 10": False}),
    (A.street_number, {"Departamento en Mitre 1234 piso 2": "en Mitre 1234", "9 de Julio 2345": "9 de Julio 2345", "27 de Febrero 55": "27 de Febrero 55", "Ruta Nacional 33 km 5": "Ruta Nacional 33 km 5",
                       "Superficie 300 m2": None, "Mitre": None, "": None, None: None, "25 de Mayo 0150 esq 200": "25 de Mayo 0150"}),
    (A.segments, {"Mitre 100 - Centro, Rosario|x": ["Mitre 100", "Centro", "Rosario", "x"], "": [], None: []}),
    (A.useful, {"Argentina": None, "Sin barrio": None, " Centro, ": "Centro", "ver fotos": None, None: None}),
    (A.query_variants, {"Pte. Roca 100, Rosario": ["Pte. Roca 100, Rosario", "Presidente Roca 100, Rosario", "Roca 100, Rosario"], "1º de Mayo 9": ["1º de Mayo 9", "Primero de Mayo 9", "1 de Mayo 9"],
                        "Mitre 1": ["Mitre 1"], None: [], " ": []}),
    (A.geocoding_text, {"Address: Maipú 235": "Maipú 235", "Casa en venta en Salta 50": "Salta 50", "Dirección: en alquiler en Sarmiento 9.": "Sarmiento 9", " ": None, None: None}),
]


@pytest.mark.parametrize("of,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, of, cases):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, x string")
    assert [r[0] for r in rows.orderBy("i").select(of(F.col("x"))).collect()] == list(cases.values())


FIELDS = ("direccion", "direccion_limpia", "direccion_geocoding_limpia", "titulo", "barrio")


def prepare(spark, *rows):
    keys = (*FIELDS, "ciudad", "provincia", "pais")
    df = spark.createDataFrame([(i, *(r.get(k) for k in keys)) for i, r in enumerate(rows)], "i int, " + ", ".join(f"{k} string" for k in keys))
    made = A.prepared({n: F.col(n) for n in FIELDS}, F.col("ciudad"), F.col("provincia"), F.col("pais"))
    return [tuple(r[0]) for r in df.orderBy("i").select(made).collect()]


def test_prepared(spark):
    place = {"ciudad": "Rosario", "provincia": "Santa Fe"}
    got = prepare(
        spark,
        {"direccion": "Mitre 1234", **place},
        {"direccion": "Mitre 1234", "titulo": "Casa en Salta 99", "direccion_limpia": "Mitre 1234 piso 2", **place},
        {"direccion": "Ver fotos - Mitre 1234", **place},
        {"direccion": "Ruta 33 km 12"},
        {"direccion": "Ruta 33 km 12", "ciudad": "Pujato", "provincia": "Santa Fe"},
        {"barrio": "Centro", **place},
        {"direccion": "Compartir", **place},
        {"direccion": "Compartir"},
        {},
        {"titulo": "Depto Funes Mitre 500"},
        {"direccion_geocoding_limpia": "Mitre 200, Rosario, Calle 300", **place},
    )
    safe, review, none = "geocoding_ready_safe", "geocoding_ready_review", "geocoding_not_ready"
    assert got == [
        ("Mitre 1234", "alta", "calle_altura_detectada", "direccion", safe, None, None, "Mitre 1234, Rosario, Santa Fe, Argentina"),
        ("Mitre 1234", "alta", "calle_altura_detectada", "direccion_limpia", safe, None, None, "Mitre 1234, Rosario, Santa Fe, Argentina"),
        ("Mitre 1234", "media", "calle_altura_detectada_tras_limpiar_texto_ui", "direccion", review, None, None, "Mitre 1234, Rosario, Santa Fe, Argentina"),
        ("", "muy_baja", "ruta_sin_contexto_ciudad_provincia_confiable", "none", none, None, None, ""),
        ("Ruta 33 km 12", "media", "ruta_geocodificable_con_contexto", "direccion", review, None, None, "Ruta 33 km 12, Pujato, Santa Fe, Argentina"),
        ("Centro", "media", "sin_calle_altura_fallback_barrio_ciudad", "barrio_ciudad", review, "Rosario", "Santa Fe", "Centro, Rosario, Santa Fe, Argentina"),
        ("Rosario", "baja", "sin_calle_altura_fallback_ciudad_provincia", "ciudad_provincia", review, "Rosario", "Santa Fe", "Rosario, Santa Fe, Argentina"),
        ("", "muy_baja", "texto_ui_compartir_limpiado_para_buscar_direccion", "none", none, None, None, ""),
        ("", "muy_baja", "sin_calle_altura_confiable", "none", none, None, None, ""),
        ("Funes Mitre 500", "alta", "calle_altura_detectada", "titulo", safe, "Funes", "Santa Fe", "Funes Mitre 500, Santa Fe, Argentina"),
        ("Mitre 200", "alta", "calle_altura_detectada", "direccion_geocoding_limpia", safe, "Rosario", "Santa Fe", "Mitre 200, Rosario, Santa Fe, Argentina"),
    ]


ROW = "id long, n int, status string, precision_geocoding string, latitud double, longitud double, ciudad string, provincia string, pais string"


def test_coordinates(spark):
    rows = [(-33.0, -60.7, "Rosario", None, True, True, True), (-34.5, -58.5, "Rosario", None, False, False, False), (-34.9, -56.2, "Montevideo", None, True, True, True),
            (0.0, 0.0, None, None, None, False, False), (None, 1.0, "Rosario", None, None, False, False), (50.0, 8.0, "X", None, None, False, True)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, lat double, lon double, c string, p string, w boolean, fit boolean, ok boolean")
    at = [F.col(c) for c in ("lat", "lon", "c", "p")] + [F.lit(None).cast("string")]
    got = df.orderBy("i").select(A.within_city(*at), A.coordinates_fit(*at), F.coalesce(A.coordinates_plausible(*at), F.lit(False))).collect()
    assert [tuple(r) for r in got] == [r[4:] for r in rows]


def test_results(spark):
    rows = [
        (1, 1, "success", "street", -33.0, -60.7, "Rosario", "Santa Fe", None), (1, 2, "success", "exact", -33.0, -60.6, "Rosario", "Santa Fe", None), (1, 3, "success", "exact", -33.0, -60.65, "Rosario", "Santa Fe", None),
        (2, 1, "success", "exact", -40.0, -60.6, "Rosario", "Santa Fe", None), (2, 2, "error", None, None, None, "Rosario", "Santa Fe", None),
        (3, 1, "error", None, None, None, None, None, None), (3, 2, "error", "x", None, None, None, None, None),
        (4, 1, "success", "exact", -33.0, -60.6, "Nowhere", None, None),
    ]
    best = geocode.best_responses(spark.createDataFrame(rows, ROW), "id", "n")
    assert {(r["id"], r["n"], r["confidence_level"]) for r in best.collect()} == {(1, 2, "high"), (2, 1, "low"), (3, 2, "low"), (4, 1, "high")}
    reasons = {r["id"]: r["skip_reason"] for r in geocode.skip_reasons(best).collect()}
    assert reasons[1] is None and reasons[4] == "location_validation_not_within_city_bounds"
    assert reasons[3] == "status_not_success,missing_coordinates,should_apply_false,needs_review_true,quality_flag_baja_confianza,location_validation_not_within_city_bounds,confidence_not_allowed"
    gone = {r["id"]: (r["status"], r["latitud"], r["error_message"]) for r in geocode.discarded_outliers(best).collect()}
    assert gone[2] == ("error", None, "geocoding_coordinates_discarded_by_outlier_validation") and gone[1] == ("success", -33.0, None)
    homes = spark.createDataFrame([(1, None, None), (2, 1.0, 2.0), (9, None, None)], "id long, latitud double, longitud double")
    assert sorted(map(tuple, geocode.apply_results(homes, best, "id", "n").collect())) == [(1, -33.0, -60.6), (2, 1.0, 2.0), (9, None, None)]
    assert {tuple(r) for r in geocode.coordinate_audit(best).collect()} == {("within_bounds", 1), ("outside_bounds", 1), ("invalid_coordinates", 1), ("no_bounds_configured", 1)}


def test_precision(spark):
    rows = [("house", None, None, "exact"), ("x", "residential", None, "street"), ("city", None, None, "area"), (None, None, "27", "street"), (None, None, "a", "approximate"), (None, None, None, "approximate")]
    df = spark.createDataFrame(rows, "a string, k string, r string, want string")
    assert df.where(geocode.precision(F.col("a"), F.col("k"), F.col("r")) != F.col("want")).count() == 0


def test_each_text_is_geocoded_once(spark, monkeypatch):
    """Rows of the same texts share one preparation, rows of the same id keep their own results; by broadcast and by a shuffle."""
    texts = [("Mitre 1250", "Casa", None, "Rosario", "Santa Fe", None, "https://x.com/p/1"), ("Ver fotos", "Casa", None, "Rosario", "Santa Fe", None, "https://x.com/p/1"), ("Pellegrini 1420", "Casa", None, "Rosario", "Santa Fe", None, "https://x.com/p/1"), (None,) * 6 + ("https://x.com",)]
    schema = "id long, " + ", ".join(f"{c} string" for c in geocode.GEOCODED_FROM)
    rows = spark.createDataFrame([(i // 2, *texts[i % 4]) for i in range(400)], schema)
    lookup = spark.createDataFrame([("Mitre 1250, Rosario, Santa Fe, Argentina", "success", -32.95, -60.65, "exact"), ("Pellegrini 1420, Rosario, Santa Fe, Argentina", "error", None, None, None)], "query string, status string, latitud double, longitud double, precision_geocoding string")
    kept, write = {}, geocode.written
    monkeypatch.setattr(geocode, "written", lambda df, name: kept.setdefault(name, []).append(write(df, name)) or kept[name][-1])
    states = {"Mitre 1250": ("done", -32.95), "Ver fotos": ("skipped", None), "Pellegrini 1420": ("failed", None), None: ("skipped", None)}
    for bound in (1000, 0):
        got = geocode.geocoded(rows, lookup, max_broadcast=bound)
        assert got.columns == [*rows.columns, "direccion", "geocoding_status", "latitud", "longitud"]
        got = got.collect()
        assert sorted(r["id"] for r in got) == [i // 2 for i in range(400)]
        assert all((r["geocoding_status"], r["latitud"]) == states[r["direccion_normalizada"]] for r in got)
    assert [df.count() for df in kept["prepared"]] == [4, 4]
