"""Queries of functions of single values: every order carries one captured shape, K standing for its key; results are worked by hand.

The SQL looks up the stated result by the order's key, so it shares nothing with the functions.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.functions import addresses as A, agencies as G, cards as Cd, display as D, images as I, links as K, names as M, normalize as N, pages as Pg, parsing as P, places as L, urls as U
from terrano.operators import geocode as Gc, manifest, reports
from terrano.sources.adapters import table

#: Provinces of cities, in the order in which texts are searched.
CITIES = {"rosario": "Santa Fe", "cordoba": "Córdoba", "mar del plata": "Buenos Aires", "ushuaia": "Tierra del Fuego"}
KEY_DIGEST = hashlib.sha256(b"abcdefghij1234567890").hexdigest()[:12]
B = "https://www.casas.com.ar/lista/hoy"
IMG = ("https://x.com/aK.jpg", "https://x.com/logo.png", "https://x.com/b.SVG", "https://x.com/aK.jpg", "https://x.com/360/c.jpg", "https://x.com/c3601.jpg")


def _list(x: Column) -> Column:
    """A list given as text between bars; null for null."""
    return F.when(x.isNotNull(), F.split(x, r"\|"))


def _joined(x: Column) -> Column:
    return F.array_join(x, "|", "-")


def _longs(*columns: Column) -> list[Column]:
    return [c.try_cast("long") for c in columns]


#: Name: function of as many columns as a case has values, and (values, result) of each shape.
CASES: dict[str, tuple[Callable[..., Column], list[tuple[tuple, str | None]]]] = {
    "arr01_image_split": (
        lambda x: F.concat(_joined(I.split(_list(x))["kept"]), F.lit(" / "), _joined(I.split(_list(x))["discarded"])),
        [(("|".join(IMG),), "https://x.com/aK.jpg|https://x.com/c3601.jpg / https://x.com/logo.png|https://x.com/b.SVG|https://x.com/360/c.jpg"), ((None,), " / "), (("data:image/png;K| ",), " / data:image/png;K")],
    ),
    "arr02_image_item": (
        I.item_url,
        [(('"https://x.com/K.jpg"',), "https://x.com/K.jpg"), (('{"src": " s-K ", "href": "h"}',), "s-K"), (('{"url": "", "image": "i-K"}',), "i-K"), (("[1]",), None), (("{",), None), ((None,), None)],
    ),
    "arr03_page_images": (
        lambda m, x: _joined(I.shown(m, _list(x))),
        [(("mK.jpg", "a.jpg|mK.jpg|virtual-K.jpg|a.jpg"), "mK.jpg|a.jpg"), ((None, "x/360/K.jpg|x/3601.jpg"), "x/3601.jpg"), (("Logo-K.png", None), "")],
    ),
    "arr04_badges": (
        lambda a, g, x: _joined(D.badges(a == "1", g.try_cast("int"), _list(x))),
        [(("1", "2", "Pileta K|Cochera|Quincho"), "Apto crédito|Cochera|Pileta K"), (("0", "0", " | "), ""), (("0", None, None), ""), (("1", "0", "ParrillÃ³n K|SUM"), "Apto crédito|Parrillon K|SUM")],
    ),
    "arr06_any_real": (lambda x: I.any_real(_list(x)), [(("aK.jpg|logo",), "true"), (("logo-K|menu.png",), "false"), ((None,), "false")]),
    "boo01_boolean": (P.boolean, [((" Sí ",), "true"), (("Y",), "true"), (("0",), "false"), (("quizás K",), "false"), ((None,), "false"), (("TRUE",), "true")]),
    "cat02_import_operation": (
        N.imported_operation,
        [(("En  Venta",), "venta"), (("compra",), None), (("ALQ",), "alquiler"), (("por día",), "alquiler_temporario"), (("consultar",), "consultar"), (("venta K",), None), ((" ",), None), (("vacation",), None)],
    ),
    "cat01_operation_words": (
        N.operation,
        [(("compra",), "venta"), (("Sell",), "venta"), (("rental",), "alquiler"), (("LOCACIÓN",), "alquiler"), (("arrendamiento",), "alquiler"), (("alq",), "alquiler"), (("short  term",), "alquiler_temporario"),
         (("turístico",), "alquiler_temporario"), (("por semana",), "alquiler_temporario"), (("alquiler temporal",), "alquiler_temporario"), (("compra o rent K",), "venta_y_alquiler"), (("permuta K",), "consultar"), ((None,), "consultar")],
    ),
    "cat04_operation_in_text": (N.operation_in_text, [(("Alquiler y venta K",), "alquiler"), (("En VENTA K",), "venta"), (("permuta K",), None), ((None,), None)]),
    "cat05_type_name": (M.type_name, [((" PH ",), "departamento"), (("dúplex",), "casa"), (("Terrenos/Lotes",), "terreno"), (("casa K",), "otro"), (("galpón",), "galpon"), ((None,), "otro"), (("garaje",), "cochera")]),
    "cat07_page_type": (
        D.property_type,
        [(("Departamento K",), "departamento"), (("CASA quinta K",), "casa"), (("ph",), "ph"), (("phK",), "otro"), (("Propiedad Horizontal K",), "ph"), (("Lote K",), "terreno"), (("Local u oficina K",), "oficina"), ((None,), "otro"), (("local K",), "local")],
    ),
    "cat08_page_status": (
        D.status,
        [(("Pausada K",), "pausada"), (("reservado K",), "reservada"), (("Vendida",), "vendida"), (("no_detectada vend",), "no_detectada_en_ultimo_scraping"), (("Alquilado K",), "alquilada"), (("no detectada K",), "no_detectada_en_ultimo_scraping"),
         (("desconocida",), "desconocida"), ((None,), "activa"), (("nueva K",), "activa")],
    ),
    "cat14_operation_of_url": (U.operation_of_url, [(("https://x.com/Alquileres/K",), "alquiler"), (("/for-RENT/K",), "alquiler"), (("/casa/K",), "venta"), ((None,), "venta")]),
    "dat01_duration": (
        lambda a, b: P.seconds_between(F.try_to_timestamp(a), F.try_to_timestamp(b)),
        [(("2024-01-01 00:00:00", "2024-01-01 00:01:00.4"), "60"), (("2024-01-01 00:00:00", "2024-01-01 00:00:01.6"), "2"), ((None, "2024-01-01 00:00:00"), None), (("2024-01-02 00:00:00", "2024-01-01 00:00:00"), "-86400")],
    ),
    "dat03_date_label": (D.date_label, [(("2024-03-09T10:00:00",), "09/03/2024"), (("2024-12-31",), "31/12/2024"), (("ayer K",), None), ((None,), None)]),
    "dat04_dated": (P.dated, [((" 2024-03-09 K ",), "2024-03-09 K"), (("a@b.co",), None), (("2024-3-9",), None), ((None,), None)]),
    "ded09_signature": (
        lambda u, a, c, p, n: F.btrim(F.concat_ws("|", U.canonical(u), *(F.lower(F.coalesce(x, F.lit(""))) for x in (a, c, p)), F.coalesce(n, F.lit(""))), F.lit("|")),
        [(("https://x.com/K", "Mitre 1", "Rosario", None, "5.0"), "x.com/K|mitre 1|rosario||5.0"), ((None, None, None, None, None), ""), (("https://x.com/K", None, None, None, None), "x.com/K")],
    ),
    "flt13_prohibited": (
        manifest.prohibited,
        [(("https://www.facebook.com/K",), "true"), (("https://m.Facebook.com/K",), "true"), (("https://myfacebook.com/K",), "false"), (("https://maps.google/K",), "true"), (("https://wix.com",), "false"), (("no url K",), "false"), ((None,), "false")],
    ),
    "flt20_detail_url": (
        lambda u, b: K.is_detail(u, b),
        [(("https://www.casas.com.ar/propiedad/casa-K", B), "true"), (("https://www.casas.com.ar/ver?idprop=K", B), "true"), (("https://www.casas.com.ar/ver?id=", B), "false"), (("https://www.casas.com.ar/propiedades/venta/K", B), "false"),
         (("https://www.casas.com.ar/propiedades/", B), "false"), (("https://www.casas.com.ar/contacto?id=K", B), "false"), (("https://otra.com/propiedad/K", B), "false"), (("https://m.casas.com.ar/ficha/ab-K", B), "true"),
         (("https://www.casas.com.ar/x/casa-en-venta-1K", B), "true"), (("https://www.casas.com.ar/propiedad/K.pdf", B), "false"), (("https://zonaprop.com/propiedad/K", B), "false"), (("ftp://casas.com.ar/propiedad/K", B), "false"), (("https://www.casas.com.ar/", B), "false")],
    ),
    "flt21_card_points": (
        K.card_points,
        [(('<div class="property-card"><h2>Casa en venta</h2> USD K <span>80 m2</span><img src="a.jpg"></div>',), "7"), (("<li>Nosotros K</li>",), "0"), (('<div class="card"><p>Lote K</p></div>',), "2"), (("<p>consultar K</p>",), "2"), ((None,), "0")],
    ),
    "flt22_not_agency": (
        M.not_an_agency,
        [((" CASA ",), "true"), (("Hamburguesería K",), "true"), (("Barrio Privado K",), "true"), (("Calle 24 K",), "true"), (("Calleja K",), "false"), (("Edificio K",), "true"), (("Inmobiliaria K",), "false"), ((None,), "false"), (("Villa del Carmen K",), "true")],
    ),
    "flt23_robot_wall": (
        lambda h, s: K.robot_wall(h, s.try_cast("int")),
        [(("<p>K</p>", "403"), "true"), (("<p>Just a moment... K</p>", "200"), "true"), (("x" * 5000 + "captcha K", "200"), "false"), ((None, "200"), "false"), (("K", None), "false"), (("", "503"), "true")],
    ),
    "flt24_block": (
        lambda s, h, n: K.block_reason(s.try_cast("int"), h, n.try_cast("int"), ("access denied", "cf-challenge")),
        [(("403", "", "0"), "HTTP 403 Forbidden"), (("429", "", "0"), "HTTP 429 Too Many Requests"), (("502", "K", "0"), "HTTP 502 Server Error"), (("200", "<b>Access</b> denied K", "3"), "Texto de bloqueo detectado: 'access denied'"),
         (("200", "<script>access denied</script>K", "0"), None), (("200", "captcha K", "0"), "Captcha activo sin cards visibles"), (("200", "captcha K", "2"), None)],
    ),
    "flt26_validated_images": (lambda x: _joined(I.validated(_list(x))), [(("a-K.jpg|logo.png|b.svg| c.jpg |a-K.jpg|data:x",), "a-K.jpg|c.jpg|a-K.jpg"), (("|".join(f"{i}-K.jpg" for i in range(12)),), "|".join(f"{i}-K.jpg" for i in range(10))), ((None,), "")]),
    "flt26_imported_images": (lambda x: _joined(I.imported(_list(x))), [(("a-K.jpg|google.com/maps/K|google.com/K|btn.png|data:K",), "a-K.jpg|google.com/K|data:K"), ((None,), "")]),
    "flt36_retryable": (K.retryable_block, [(("HTTP 429 Too Many Requests",), "true"), (("HTTP 503 Server Error",), "true"), (("HTTP 403 Forbidden",), "false"), (("Captcha K",), "false"), ((None,), "false")]),
    "jsn01_object": (lambda x: F.to_json(P.json_object(x)), [(('{"b": K, "a": [1]}',), '{"a":[1],"b":K}'), (("[K]",), "{}"), (("{K",), "{}"), ((None,), "{}"), ((" ",), "{}")]),
    "jsn02_merge": (
        lambda x, v: P.merged_json(x, {"m": v, "a": F.lit("z")}),
        [(('{"b": {"d": 1, "c": K}, "a": 9}', "v K"), '{"a":"z","b":{"c":K,"d":1},"m":"v K"}'), (("[1]", 'q"K'), '{"a":"z","m":"q\\"K"}'), ((None, None), '{"a":"z","m":null}')],
    ),
    "jsn03_without_empty": (
        lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(P.without_empty(x))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","),
        [(('{"a": null, "b": "", "c": K, "d": [], "e": {}, "f": "x", "g": false}',), 'c=K,f="x",g=false'), (("[]",), "")],
    ),
    "jsn04_aliases": (P.first_present, [((" ", None, "x K"), "x K"), (("a K", "b", "c"), "a K"), ((None, " b ", "c"), "b"), ((None, "", " "), None)]),
    "joi17_city_province": (lambda x: L.province_of_city(x, CITIES), [((" Córdoba ",), "Córdoba"), (("ROSARIO",), "Santa Fe"), (("Rosario K",), None), ((None,), None)]),
    "joi17_text_province": (lambda x: L.province_in_text(x, CITIES), [(("Casa en Mar del Plata o Córdoba K",), "Córdoba"), (("ushuaia K",), "Tierra del Fuego"), (("K",), None), ((None,), None)]),
    "joi18_host_place": (
        lambda u: F.concat_ws("/", L.place_of_host(u)["city"], L.place_of_host(u)["province"]),
        [(("https://www.tandil-casas.com.ar/K",), "Tandil/Buenos Aires"), (("https://saltamendoza.com/K",), ""), (("https://inmo-lapampa.com.ar/K",), "La Pampa"), (("https://sal.ta/K",), "Salta/Salta"), (("https://a.com/tandil/K",), ""), (("tandil K",), ""), ((None,), "")],
    ),
    "loc01_place": (
        lambda c, p, a, b: F.concat_ws("/", *(L.place_of_signals(c, p, a, b)[k].cast("string") for k in ("city", "province", "inferred"))),
        [((" Funes ", None, "https://tandil.com/K", None), "Funes/false"), ((" ", None, "https://x.com/K", "https://ushuaia.com.ar"), "Ushuaia/Tierra del Fuego/true"), ((None, "Chaco", "https://tandil.com/K", None), "Chaco/false"), ((None, None, None, None), "false")],
    ),
    "loc02_import_place": (lambda c: P.truncated(c, 120), [(("  San   Luis K ",), "San Luis K"), ((" ",), None), (("x" * 130,), "x" * 120)]),
    "loc03_context": (
        lambda c, p, u: F.concat_ws("/", *(L.place_of_context(c, p, L.url_words(u), ("Rosario", None))[k] for k in ("city", "province"))),
        [(("Funes", None, "https://x.com/tandil/K"), "Funes"), ((None, " ", "https://x.com/general-alvear/Mendoza/K"), "General Alvear/Mendoza"), ((None, None, "https://x.com/general-alvear/K"), "Rosario"), ((None, None, "x?q=sauce+viejo%20K"), "Sauce Viejo/Santa Fe"),
         ((None, None, "https://x.com/ciudad_mendoza/K"), "Mendoza/Mendoza"), ((None, None, None), "Rosario")],
    ),
    "loc10_agency_name": (
        D.agency_name,
        [(("https://www.pagliaropropiedades.com.ar/K", "Otra"), "Juan I. Pagliaro Propiedades"), (("svestudioinmobiliario.com.ar/K", None), "SV Inmobiliaria"), (("https://x.com/K", " Norte K "), "Norte K"), ((None, None), D.DEFAULT_AGENCY)],
    ),
    "mig01_states": (D.migrated_state, [(("activo",), "activa"), (("inactivo",), "desconocida"), (("vendida",), "vendida"), ((None,), None)]),
    "num04_rating": (P.rating, [(("4,25",), "4.2"), (("4.35",), "4.4"), (("5.1",), None), (("K x",), None), (("-0.1",), None), ((None,), None), (("3",), "3.0")]),
    "num04_reviews": (P.review_count, [(("(1.2K4)",), "12K4"), (("sin",), None), ((None,), None), (("K reseñas",), "K")]),
    "num05_int32": (P.int32, [(("2147483647",), "2147483647"), (("2147483648",), None), (("-2147483649",), None), (("x K",), None), ((None,), None), (("K",), "K")]),
    "num07_price_label": (
        lambda n, c: D.price_label(n.try_cast("long"), c),
        [(("1234567", "USD"), "USD 1.234.567"), (("0", "USD"), "Consultar precio"), ((None, "ARS"), "Consultar precio"), (("950", "ARS"), "ARS 950"), (("1500", "ARS"), "ARS 1500"), (("15000", "ARS"), "ARS 15.000")],
    ),
    "num08_import_currency": (P.import_currency, [(("u$s",), "USD"), ((" dólares ",), "USD"), (("$",), "ARS"), (("eur",), "EUR"), ((" ",), None), ((None,), None)]),
    "num08_page_currency": (D.currency, [(("Pesos K",), "ARS"), (("ARS",), "ARS"), (("euros K",), "USD"), ((None,), "USD")]),
    "num10_whole": (P.whole, [((" K ",), "K"), (("1.5",), "0"), ((None,), "0"), (("",), "0"), (("-3",), "-3")]),
    "num10_comma": (P.comma_number, [(("12,5",), "12.5"), (("1.234,5",), None), (("",), None), (("7",), "7.0")]),
    "num10_grouped": (P.grouped_whole, [(("1.2K",), "12K"), (("1,000",), "1000"), (("a",), None), ((None,), None)]),
    "prj16_specs": (
        lambda *x: _joined(D.specs(*_longs(*x))),
        [(("3", "1", "2", "1", "90", "70"), "3 amb.|1 dorm.|2 baños|1 coch.|90 m² tot.|70 m² cub."), (("0", "2", "1", "0", "90", "90"), "2 dorm.|1 baño|90 m²"), ((None, None, None, "2", "0", "55"), "2 coch.|55 m² cub."), (("0", "0", "0", "0", "0", "0"), "")],
    ),
    "prj17_location": (
        D.location_label,
        [(("Centro K", "Rosario", "Santa Fe"), "Centro K, Rosario, Santa Fe"), (("", "Salta", "Salta"), "Salta"), ((None, "", "Chaco K"), "Chaco K"), ((None, None, ""), "Argentina")],
    ),
    "prj18_counter": (
        lambda a, b, c: D.counter_label(*_longs(a, b, c)),
        [(("12345", "20000", "24"), "12.345 de 20.000 propiedades · 24 visibles"), (("1200", "1200", "1200"), "1200 propiedades activas"), (("5", "90", "24"), "5 de 90 propiedades"), (("90", "90", "24"), "90 propiedades activas · 24 visibles")],
    ),
    "sco03_completeness": (
        lambda p, m, a, i, o: F.concat_ws("", sum((F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0) for c in (p.isNotNull(), m.isNotNull(), a != "", F.size(_list(i)) > 0, F.lower(F.trim(o)).isin(*N.OPERATIONS, "proyecto"))), F.lit(0)).cast("string")),
        [(("1", "K", "Mitre K", "a.jpg", " Venta "), "5"), ((None, None, "", None, "permuta"), "0"), (("0", None, None, None, "proyecto"), "2")],
    ),
    "sco07_detail_quality": (
        lambda *x: F.concat_ws(" ", reports.detail_quality(*x)["score"].cast("string"), reports.detail_quality(*x)["label"]),
        [(("Casa en Funes K", "USD K", "venta", "casa", "Funes", "x" * 31), "8 high"), (("Casa", "USD K", None, "casa", "Fun", "corta K"), "3 low"), ((None, None, None, None, None, None), "0 very_low"), (("Casa en Funes K", "1", None, None, None, ""), "4 medium")],
    ),
    "str05_name_key": (M.name_key, [(("  Ñandú & Cía. K ",), "nandu cia K"), ((None,), ""), (("São-Paulo_K",), "sao paulo K")]),
    "str06_compare_key": (M.compare_key, [(("Inmobiliaria López S.R.L. K",), "lopezK"), (("Norte Propiedades S.A K",), "norteK"), (("Bienes Raíces K",), "K"), (("Brokers K",), "brokersK"), ((None,), None)]),
    "str08_display_name": (M.display_name, [(("  o'higgins  san-martín & cía ",), "Ohiggins Sanmartin & Cia"), (("3 de FEBRERO K",), "3 De Febrero K"), (("!!",), None), ((None,), None), (("a1b",), "A1B")]),
    "str09_capitalised": (M.capitalised, [(("  barrio  NORTE K ",), "Barrio Norte K"), (("o'higgins san-MARTÍN",), "O'higgins San-martín")]),
    "str10_neighbourhood": (M.neighbourhood, [((" MicroCentro ",), "Centro"), (("constitucion",), "Constitución"), (("las  flores",), "Las Flores"), ((" ",), None), ((None,), None)]),
    "str11_last_part": (M.last_part, [(("Mitre K - Centro -  Barrio  Sur ",), "Barrio Sur"), (("Centro K",), "Centro K"), (("a - ",), None), ((None,), None)]),
    "str12_street_part": (M.street_part, [(("Mitre K, Local 2 - Centro",), "Mitre K 2"), (("Ed - K",), None), (("Torre Oficina Roca  5K",), "Roca 5K"), ((None,), None)]),
    "str14_licence": (
        M.without_licence,
        [(("Norte Prop. CPI 7968",), "Norte Prop"), (("Sur S.A. Mat. 0336",), "Sur S.A."), (("Este (CSI 6250) K",), "Este () K"), (("Este (reg. 62503) K",), "Este () K"), (("Este (abc 6250) K",), "Este K"), (("Oeste | Mendoza 2196",), "Oeste"), (("Casas | 1 y 2 Ambientes K",), "Casas K"), (("Centro desde 1978",), "Centro"), ((None,), None)],
    ),
    "str15_garbled": (M.regarbled, [(("Constitución K".encode().decode("latin-1"),), "Constitución K"), (("Ãxx K",), "Ãxx K"), (("Funes K",), "Funes K"), ((None,), None)]),
    "str16_page_text": (M.shown_text, [((" PeÃ³n K ",), "Peon K"), (("SalÃ\u0081n Ã‰ste K",), "SalAn Este K"), (("Apto crÃ©dito",), "Apto crédito"), ((None,), "")]),
    "str17_no_address": (
        L.no_address_reason,
        [(("Ver Oficinas K",), "contaminated_address"), (("a.b@correo.com",), "address_is_email"), (("Llamar 341-412-3456",), "address_contains_phone"), (("Depto $ 85.000",), "address_contains_price"), (("85.000",), "address_is_price"), (("85.000 pesos",), "address_is_price"),
         (("Mitre K",), None), (("Roca 1 2 3 " + "piso alto " * 9,), "address_too_long_numeric"), ((" ",), None), ((None,), None), (("casas.com.ar",), None)],
    ),
    "str17_no_import_address": (lambda x: L.no_address_reason(x, True), [(("Mitre K casas.com.ar",), "contaminated_address_domain"), (("Mitre K",), None), (("mail K",), "contaminated_address")]),
    "str19_garbage": (
        A.is_garbage,
        [(("Inicio Propiedades K",), "true"), (("Mitre 1K",), "false"), (("Mitre",), "true"), (("Calle 12 bis",), "true"), (("Calle Mitre 1K",), "false"), (("Entre 3 y 4",), "true"), (("Grupo alfa 12 K",), "true"), (("R 12",), "true"), (("120.000 usd",), "true"), (("parcela 12",), "true"), ((None,), "true"), (("Esquina 12 K",), "true"), (("Taller 12",), "true")],
    ),
    "str28_control_title": (L.control_title, [(("Arrastrar K",), "true"), (("Casas en venta | Funes K",), "true"), (("Terrenos a la venta | K",), "true"), (("Casa en venta K",), "false"), ((None,), "false")]),
    "str29_file_title": (
        L.file_title,
        [(("Ca266.Html", "campo", "venta", " La Pampa "), "Campo en venta en La Pampa"), (("mo340.htm", "raro", "alquiler_temporario", None), "Propiedad en alquiler"), (("Campo K", "campo", "venta", None), None), ((None, None, None, None), None)],
    ),
    "str30_made_title": (
        L.title_or_made,
        [((" Casa  K ", "casa", "Funes", None), "Casa K"), ((" ", "casa quinta", "Funes", "Santa Fe"), "Casa quinta en Funes"), ((None, "lote", None, "Chaco"), "Lote en Chaco"), ((None, None, "Funes K", None), "Propiedad en Funes K"), ((None, None, None, "Chaco"), "Propiedad sin título")],
    ),
    "str31_truncated": (lambda x: P.truncated(x, 12), [(("  una   casa muy grande K",), "una casa muy"), ((" ",), None), (("K",), "K")]),
    "str35_spaced_key": (M.spaced_key, [((" Ñandú,  S.A.  K_1 ",), "nandu sa K_1"), ((None,), None)]),
    "str37_address_value": (
        lambda x: F.concat_ws("/", L.address_value(x)["value"], L.address_value(x)["reason"]),
        [((" Mitre   K ",), "Mitre K"), (("tel: K",), "contaminated_address"), ((None,), "")],
    ),
    "str37_import_address": (lambda x: F.concat_ws("/", L.address_value(x, True)["value"], L.address_value(x, True)["reason"]), [(("y " * 200,), ("y " * 150).strip() + " "), (("www.K",), "contaminated_address")]),
    "tel02_first_phone": (M.first_phone, [(("Llamar (0341) 4123-456 o 011 4123-4567 K",), "+541141234567"), (("+54 9 341 412 3456",), None), (("K sin",), None), ((None,), None)]),
    "tel03_chat_url": (D.chat_url, [(("+54 341 412-3456",), "https://wa.me/543414123456"), (("1234567",), None), ((None,), None)]),
    "typ01_own_type": (P.own_type, [((" Casa  Quinta ",), "casa quinta"), (("OTRO",), "otro"), ((" ",), None)]),
    "url02_site": (M.site, [((" WWW.Norte.com.ar/ ",), "https://norte.com.ar"), (("http://www.x.com/K//",), "http://x.com/K"), ((" ",), None), ((None,), None)]),
    "url02_site_www": (lambda x: M.site(x, keep_www=True), [(("www.N orte.com/K/",), "https://www.norte.com/K"), (("https://www.x.com",), "https://www.x.com")]),
    "url03_unwrapped": (U.unwrapped, [(("https://g.com/url?sa=t&q=https%3A%2F%2Fx.com%2FK%3Fa%3D1&u=2",), "https://x.com/K"), (("https://x.com/K?a=1#b",), "https://x.com/K"), ((None,), None)]),
    "url04_absolute": (
        U.absolute,
        [(("/p/K", B), "https://www.casas.com.ar/p/K"), (("p/K?x=1", B), "https://www.casas.com.ar/lista/p/K?x=1"), (("//cdn.com/K", B), "https://cdn.com/K"), (("?p=K", B), "https://www.casas.com.ar/lista/hoy?p=K"), (("#K", B), None), (("mailto:K", B), None), ((" ", B), None),
         (("http://x.com/K", B), "http://x.com/K"), (("K", "https://x.com"), "https://x.com/K")],
    ),
    "url05_detail_links": (
        lambda h, b: _joined(K.detail_links(h, b)),
        [(('<article class="property-card"><a href="/propiedad/casa-K">USD 120.000</a><a href="/contacto">x</a><div data-href="/ficha/ab-K"></div><p onclick="location.href=\'/ver?idprop=K\'">80 m2</p><a href="/propiedad/casa-K">ver</a></article>', B),
          "https://www.casas.com.ar/propiedad/casa-K|https://www.casas.com.ar/ficha/ab-K|https://www.casas.com.ar/ver?idprop=K"), (('<li><a href="/propiedad/casa-K">ver</a></li>', B), ""), ((None, B), "")],
    ),
    "url06_next_page": (
        K.next_page,
        [(('<a href="/p?page=K">Siguiente</a><a rel="next" href="/p?page=9">9</a>', B), "https://www.casas.com.ar/p?page=9"), (("<a href='/p?page=K'> <b>SIGUIENTE</b> </a>", B), "https://www.casas.com.ar/p?page=K"), (('<a class="btn-next" href="https://x.com/K">2</a>', B), "https://x.com/K"), (('<a href="#">siguiente</a>', B), None), ((None, B), None)],
    ),
    "url07_operation_of_path": (U.operation_of_path, [(("https://x.com/Venta/item.asp?id=K",), "venta"), (("/alquiler-temporario/ver.aspx?K",), "alquiler_temporario"), (("/alquiler/ficha.asp",), "alquiler"), (("/venta/casa.asp?K",), None), ((None,), None)]),
    "url08_rural_type": (
        L.rural_type,
        [(("https://campos.com/ca266.html", "casa"), "campo"), (("https://campos.com/ca266.html", "chacra"), None), (("https://casas.com/ca266.html", "casa"), None), (("https://agro.com.ar/K.html", None), None), (("https://agro.com.ar/mo340.htm", None), "campo")],
    ),
    "url09_site_base": (U.site_base, [(("https://X.com/a?K",), "https://X.com"), (("x.com/K",), None), ((None,), None)]),
    "url10_page_url": (
        lambda u, n: U.page_url(u, n.cast("int")),
        [(("https://x.com/a", "3"), "https://x.com/a?pagina=3"), (("https://x.com/a?b=K", "3"), "https://x.com/a?b=K&pagina=3"), (("https://x.com/a?pagina=12&b=K", "3"), "https://x.com/a?pagina=3&b=K")],
    ),
    "url11_click_urls": (
        lambda x: _joined(K.click_urls(x)),
        [(("window.open('/x/K')",), "/x/K"), (("go('/propiedad/K'); f(\"no\")",), "/propiedad/K"), ((None,), "")],
    ),
    "web01_system": (
        K.system,
        [(("<link href='/wp-content/K'> tokkobroker.com", "https://x.com"), "tokko"), (("<b>/wp-json/ K</b>", None), "wordpress"), (("<p>K</p>", "https://norte.wixsite.com/K"), "wix"), (("x" * 60000 + "shopify myshopify.com", None), "custom"), ((None, None), "custom")],
    ),
    "web02_site_key": (
        lambda h: F.left(K.site_key(h), F.lit(12)),
        [(('api_key = "abcdefghij1234567890"',), KEY_DIGEST), (("<p>K</p>",), None), ((None,), None), (('<script src="https://tokkobroker.com/w.js?key=abcdefghij1234567890"></script>',), KEY_DIGEST)],
    ),
    "web03_list_page": (
        K.list_page,
        [(('<nav><a href="/nosotros">N</a><a href="/propiedades">P K</a></nav><a href="/ventas">v</a>', B), "https://www.casas.com.ar/propiedades"), (('<nav><a href="/x">Ver Propiedades K</a></nav>', B), "https://www.casas.com.ar/x"), (('<p><a href="/buscar/K">b</a></p>', B), "https://www.casas.com.ar/buscar/K"),
         (('<a href="https://otra.com/ventas">v</a>', B), None), ((None, B), None)],
    ),
    "web04_pagination": (
        K.pagination,
        [(("<div class='lazyload'>K", None), "scroll_infinito"), (('<a href="?page=2">K</a>', None), "url"), (("<b>Siguiente K</b>", None), "click"), (("<b>K</b>", "https://x.com/page/2"), "url"), (("<b>K</b>", None), "url"), (("", None), "desconocido"), ((None, None), "desconocido")],
    ),
    "web05_total": (
        lambda h: F.concat_ws("/", K.listing_total(h)["total"].cast("string"), K.listing_total(h)["pages"].cast("string")),
        [(("<h1>1.205 propiedades</h1>",), "1205/101"), (("<p>0 resultados y 24 Inmuebles</p>",), "24/2"), (("<p>999999 propiedades</p>",), ""), ((None,), "")],
    ),
    "web10_detail_anchors": (K.detail_anchor_count, [(('<a href="/Propiedad/K">a</a><a href="/x">b</a><a href="/ad/1">c</a>',), "2"), ((None,), "0")]),
    "eml01_site_emails": (
        lambda h, d: _joined(K.contact_emails(h, d)),
        [(('<p>z@otra.com y INFO@norte.com</p><a href="mailto:Ventas@norte.com?subject=K">m</a> test@x.com', "norte.com"), "ventas@norte.com|info@norte.com|z@otra.com"), ((None, "x"), ""), (("a@b.com K", ""), "a@b.com")],
    ),
    "web_contact_phones": (lambda h: _joined(K.contact_phones(h)), [(('<a href="tel:0341-412-3456">x</a><p>(0341) 4123456</p>',), "+543414123456"), ((None,), "")]),
}


def _fields(x: Column, *of: str) -> Column:
    return F.concat_ws("/", *(F.coalesce(x[k].cast("string"), F.lit("-")) for k in of))


CASES |= {
    "flt25_list_page": (
        Cd.is_list_page,
        [(("https://x.com/propiedad/casa-K", '<i class="card">' * 20), "false"), (("https://x.com/ventas/", ""), "true"), (("https://x.com/a/b/ventas", ""), "false"), (("https://x.com/lista?idprop=7", '<i class="card">' * 20), "false"), (("https://x.com/lista", '<i class="big card">' * 9 + "<i class='listing-item'>" * 7), "true"),
         (("https://x.com/lista", '<i class="cards">' * 20), "false"), ((None, None), "false")],
    ),
    "str26_profile": (
        lambda x: _fields(Cd.profile(x), "publica_desde", "nivel", "calificaciones", "avisos_compra", "avisos_alquiler"),
        [(("Norte Publica  desde 2015 Nivel 3 Ver 12 calificaciones 1.204 Avisos compra 1 Aviso alquiler",), "2015/3/12/1204/1"), (("Sur K",), "-/-/-/-/-"), ((None,), "-/-/-/-/-")],
    ),
    "str32_slug": (
        lambda u: _fields(Cd.slug(u), "title", "address", "neighbourhood", "operation"),
        [(("https://x.com/p/4567-Casa-en-Venta-san-martin-1250-barrio-norte?a=K",), "Casa En Venta San Martin Barrio Norte/San Martin Barrio 1250/Barrio Norte/venta"), (("https://x.com/alquiler/lote-funes",), "Lote Funes/Funes/Funes/alquiler"), (("https://x.com/p/4567",), "4567/-/-/-"),
         (("https://x.com/depto-roca-centro/",), "Depto Roca Centro/Roca Centro/Roca Centro/-")],
    ),
    "str33_number_near": (
        lambda x: Cd.number_near(x, "dorm|habit"),
        [(("3 dormitorios y 2 baños",), "3"), (("Dormitorios: 4",), "4"), (("habitaciones por planta en total 5",), None), (("K dorm",), "K"), ((None,), None)],
    ),
    "str34_features": (
        lambda l, v: _fields(Cd.features(_list(l), _list(v)), "dormitorios", "banos", "ambientes", "metros", "tipo"),
        [(("Dormitorios|Baños|Sup. total|Tipo|Dorm.", "3 amplios|2|120 m2|Casa|9"), "3/2/-/120/casa"), (("Superficie|Metros cubiertos|Tipología|Inmueble", "5|80|raro|PH"), "-/-/-/80/departamento"), (("Habitaciones|Ambientes", "cero|K"), "-/-/K/-/-"), ((None, None), "-/-/-/-/-")],
    ),
    "str39_registry_row": (
        lambda *x: F.coalesce(_fields(Cd.registry_row(F.array(*x)), "matricula", "nombre", "direccion", "telefono", "email", "estado"), F.lit("-")),
        [(("Ana", "Mat. 0K7", "", "  Norte  K ", "(2000)\nMitre 1K\nRosario", "0341 4123456\nA@B.co"), "0K7/Norte K/Mitre 1K/03414123456/a@b.co/activo"), (("Baja desde 2K", "9", "", "", "", "341-4123456"), "9///3414123456//baja"), (("x", "sin", "", "y", "", ""), "-/-/-/-/-/-")],
    ),
    "prj10_directory_agency": (
        lambda *x: _fields(Cd.directory_agency(dict(zip(("nombre", "web", "telefono", "telefono_principal", "ciudad", "pais", "rating", "resenas", "fecha_scrapeo"), x, strict=True))), "nombre", "web", "telefono_principal", "ciudad", "pais", "rating", "resenas", "ultimo_scrapeo"),
        [((" Norte K ", "https://n.com/", " ", "341", "", None, "4,5", "1.20K", "2024-01-02T03"), "Norte K/https://n.com/341/-/Argentina/4.5/120K/2024-01-02T03"), ((" ", "w", "1", "2", "c", "p", "1", "2", "x"), "-/-/-/-/-/-/-/-"), (("Sur", None, "1", "2", "Funes", "Uruguay", "x", "x", "a@b"), "Sur/-/1/Funes/Uruguay/-/-/-")],
    ),
    "prj15_directory_payload": (
        lambda n, u, l: _fields(Cd.directory_payload(n, u, l), "nombre", "nombre_normalizado", "metadata"),
        [(("Constitución  K".encode().decode("latin-1"), "u", " 3 "), 'Constitución K/constitucion K/{"nivel":3,"revision_notas":"mojibake_corregido: ConstituciÃ³n K -> Constitución K"}'), (("Norte", "u", "x"), "Norte/norte/{}"), (("Norte", " ", "1"), "-/-/-")],
    ),
}


PROVINCES = {"santa fe": "Santa Fe", "rosario": "Santa Fe", "salta": "Salta"}

CASES |= {
    "str18_geocoding_text": (
        A.geocoding_text,
        [(("Address: Mitre K",), "Mitre K"), (("Dirección:  Roca 5K",), "Roca 5K"), (("Casa en venta en Mitre K",), "Mitre K"), (("Departamento en alquiler temporario en San Luis K",), "San Luis K"), (("En venta en Roca K",), "Roca K"), ((" ",), None), ((None,), None)],
    ),
    "loc08_coordinates_fit": (
        lambda a, b, c, p, n: A.coordinates_fit(a.try_cast("double"), b.try_cast("double"), c, p, n),
        [(("-32.95", "-60.65", "Rosario", "Santa Fe", "Argentina"), "true"), (("-40", "-60.65", "ROSARIO", "Santa Fe", None), "false"), (("-40", "-60.65", "Pueblo K", None, None), "true"), (("-10", "-60.65", "Pueblo K", None, None), "false"), ((None, "-60", "Rosario", None, None), "false"),
         (("-34.9", "-56.2", "Montevideo", None, "Uruguay"), "true")],
    ),
    "cat09_class_types": (
        lambda h: F.concat_ws("/", F.coalesce(Pg.type_of_classes(h), F.lit("-")), F.coalesce(F.nullif(Pg.operation_of_classes(h), F.lit("")), F.lit("-"))),
        [(('<div class="x tipo-local-comercial operacion-venta">K',), "local/venta"), (('<p class="tipo-raro property_types-ph">K</p>',), "departamento/-"), (("<b class='property_types-raro operacion-alquiler'>",), "otro/alquiler"), (("<p>K</p>",), "-/-"), ((None,), "-/-")],
    ),
    "cat11_query_place": (
        lambda q: F.concat_ws("/", G.place_of_query(q, PROVINCES)["provincia"], G.place_of_query(q, PROVINCES)["barrio"]),
        [(("inmobiliarias en barrio alto verde santa fe",), "Santa Fe/Alto Verde"), (("casas en salta o rosario",), "Santa Fe/"), (("K",), "/"), ((None,), "/")],
    ),
    "cat13_query_category": (G.category_of_query, [(("empresa Constructora K",), "constructora"), (("desarrollos K",), "desarrolladora"), ((None,), "desarrolladora")]),
    "sco11_precision": (
        lambda a, k, r: Gc.precision(a, k, r),
        [(("house", None, None), "exact"), ((None, "Building", "1"), "exact"), (("road", None, None), "street"), ((None, "tertiary", "x"), "street"), (("suburb", "x", "30"), "area"), ((None, "x", "26"), "street"), (("x", None, "25"), "approximate"), ((None, None, None), "approximate")],
    ),
    "sco17_site_confirmed": (
        G.site_confirmed,
        [(("Norte Propiedades", "https://www.norteprop.com", "", None), "true"), (("Sur Estudio", "https://x.com", "estudio Sur Estudio K", None), "true"), (("Del Valle", "https://x.com", "el valle K", None), "true"), (("Ana", "https://x.com", "llame al 341-412-3456", "+54 341 4123456"), "true"),
         (("Ana", "https://x.com", "nada K", "123456"), "false"), (("Ana", "x.com", "Bienes Raíces K", None), "true"), ((None, None, None, None), "false")],
    ),
    "sco10_enrichment": (
        lambda w, t, fw, ft, ok: _fields(G.enrichment({"web": w, "ciudad": F.lit("Funes"), "provincia": F.lit(None).cast("string"), "telefono": t, "direccion": F.lit(None).cast("string")}, {"web": fw, "telefono": ft, "direccion": F.lit(None).cast("string")}, ok == "1", F.lit(True)), "confidence", "estado", "web", "telefono"),
        [(("https://norte.com.ar/K", None, None, "341K", "0"), "80/requiere_revision_enriquecimiento/-/341K"), ((None, None, "https://sur.com/K", "341K", "1"), "100/enriquecido/https://sur.com/K/341K"), ((None, "1", "https://sur.com/K", None, "0"), "20/sin_resultados_enriquecimiento/-/-")],
    ),
}


def query_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    of, shapes = CASES[name]

    def query(s: SparkSession, d: str) -> DataFrame:
        i, n = F.col("o_orderkey"), len(shapes)

        def pick(j: int) -> Column:
            text = F.element_at(F.array(*(F.lit(v[j]).cast("string") for v, _ in shapes)), (i % n + 1).cast("int"))
            keyed = [k for k, (v, _) in enumerate(shapes) if "K" in (v[j] or "")]  # only these are searched for it
            return F.when((i % n).isin(*keyed), F.replace(text, F.lit("K"), i.cast("string"))).otherwise(text)

        rows = table(s, d, "orders").select(i.alias("id"), *(pick(j).alias(f"_{j}") for j in range(len(shapes[0][0]))))
        return rows.select("id", of(*(F.col(f"_{j}") for j in range(len(shapes[0][0])))).cast("string").alias("result"))

    query.__name__ = name
    return query


def sql_of(name: str) -> str:
    quoted = lambda v: "NULL" if v is None else "'" + v.replace("'", "''") + "'"
    results = ", ".join(quoted(r) for _, r in CASES[name][1])
    return f"SELECT o_orderkey AS id, replace(([{results}]::VARCHAR[])[o_orderkey % {len(CASES[name][1])} + 1], 'K', o_orderkey::VARCHAR) AS result FROM orders"


QUERIES = {name: query_of(name) for name in CASES}
SQL = {name: sql_of(name) for name in CASES}
