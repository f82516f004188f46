"""Queries of functions of single values over the columns of whole tables: texts, pages, addresses and captured numbers.

Inputs are given once, as SQL that both engines read, and the expected result is worked out from the rule in SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.functions import agencies as G, cards as Cd, display as D, images as I, links as K, names as M, normalize as N, pages as Pg, parsing as P, places as L, urls as U
from terrano.operators import geocode as Gc, manifest, publishing
from terrano.plans import value_queries
from terrano.sources.adapters import table

#: Name: (table, its id, inputs as SQL, function of these, the result as DuckDB SQL over inputs of the same names).
CASES: dict[str, tuple[str, str, dict[str, str], Callable[..., Column], str]] = {}
#: Name: result of the captured shapes (value_queries) as SQL that gives the columns' type. These queries read every order's shape besides the columns.
SHAPES: dict[str, str] = {}
#: Name: inputs and result of a second pass over the same rows, for branches that the columns' own values do not reach.
BRANCHES: dict[str, tuple[dict[str, str], str]] = {}
CITIES = {"rosario": "Santa Fe", "cordoba": "Córdoba", "mar del plata": "Buenos Aires", "ushuaia": "Tierra del Fuego"}
_SPACE = r"[\s\x0b\x85\xa0 -     　]"


def case(name: str, of_table: str, inputs: dict[str, str], function: Callable[..., Column], result: str, shapes: str | None = None, branches: tuple[dict[str, str], str] | None = None) -> None:
    if branches:
        BRANCHES[name] = branches
    if shapes:
        SHAPES[name] = shapes
    ids = {"documents": "doc_id", "pages": "page_id", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "customer": "c_custkey", "supplier": "s_suppkey"}
    CASES[name] = (of_table, ids[of_table], inputs, function, result)


def _any(x: str, parts) -> str:
    return "(" + " OR ".join(f"contains({x}, '{p}')" for p in parts) + ")"


def _squeezed(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '\\s+', ' ', 'g')), '')"


def _texts(values) -> str:
    return ", ".join("NULL" if v is None else f"'{v}'" for v in values)


def _replaced(x: str, pairs) -> str:
    for old, new in pairs:
        x = f"replace({x}, '{old}', '{new}')"
    return x


def _picked(key: str, values) -> str:
    """One of several texts by a key, as SQL that both engines read."""
    return f"element_at(array({_texts(values)}), CAST({key} % {len(values)} + 1 AS int))"


def _told(key: str, values) -> str:
    """The result that goes with the text picked by the key."""
    return f"[{_texts(values)}][{key} % {len(values)} + 1]"


#: UTF-8 read as Latin-1, as Spark and as DuckDB write it.
_AS_LATIN = "decode(encode(text, 'UTF-8'), 'ISO-8859-1')"
_BYTES = ("c", "chr(192 + unicode(c) // 64) || chr(128 + unicode(c) % 64)", "chr(224 + unicode(c) // 4096) || chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64)", "chr(240 + unicode(c) // 262144) || chr(128 + unicode(c) // 4096 % 64) || chr(128 + unicode(c) // 64 % 64) || chr(128 + unicode(c) % 64)")
_DUCK_AS_LATIN = "array_to_string(list_transform(regexp_extract_all(text, '(?s).'), lambda c: CASE WHEN unicode(c) < 128 THEN {} WHEN unicode(c) < 2048 THEN {} WHEN unicode(c) < 65536 THEN {} ELSE {} END), '')".format(*_BYTES)
#: Letters and phrases whose UTF-8 was read as Windows' Latin-1, and how they are shown, in order.
_MISREAD = {letter: "".join(bytes([b]).decode("latin-1" if b in (0x81, 0x8D) else "cp1252") for b in letter.encode()) for letter in "áéíóúñÁÉÍÓÚÑ"}
_SHOWN = (("Apto crÃ©dito", "Apto crédito"), ("Propiedad sin tÃ\u00adtulo", "Propiedad sin título"), ("Propiedad sin tÃtulo", "Propiedad sin título"), *zip(_MISREAD.values(), "aeiounAEIOUN", strict=True))
_PLAIN = "strip_accents(lower({}))"
_TITLE = "regexp_extract(html, '<title>([^<]*)', 1)"
_SITE = "regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1)"
_HOST = "lower(regexp_extract(url, '://([^/?#]*)', 1))"
_PATH = "regexp_extract(url, '://[^/?#]*([^?#]*)', 1)"
_MAILS = "list_transform(regexp_extract_all(regexp_replace(regexp_replace(h, '(?is)<(script|style)[^>]*>.*?</(script|style)[^>]*>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[a-zA-Z0-9._%+\\-]+@[a-zA-Z0-9.\\-]+\\.[a-zA-Z]{2,}'), lambda e: lower(e))"
_MAILS = f"list_filter({_MAILS}, lambda e, i: list_position({_MAILS}, e) = i)"
#: A part's name and numbers as a captured text, words by its columns.
_PART = "concat(p_name, ' ', p_brand, ' ', CASE WHEN p_partkey % 4 = 0 THEN 'en Venta' WHEN p_partkey % 4 = 1 THEN 'Alquiler' WHEN p_partkey % 4 = 2 THEN p_type ELSE 'Compra' END, ' ', CAST(p_size AS string))"
_CLERK = "concat(CASE c_custkey % 5 WHEN 0 THEN 'Inmobiliaria ' WHEN 1 THEN 'Estudio ' WHEN 2 THEN 'Depto ' WHEN 3 THEN 'CASA ' ELSE '  ' END, c_mktsegment, ' - ', c_name)"

#: Operations as imports write them, and what they are.
_OPERATIONS = (
    ("En  Venta", "venta"), (" ALQ", "alquiler"), ("Consultar", "consultar"), ("por día", "alquiler_temporario"), ("compra", None), ("For Sale", "venta"), ("sale", "venta"), ("VENTA", "venta"),
    ("en alquiler ", "alquiler"), ("Rent", "alquiler"), ("for  rent", "alquiler"), ("Temporario", "alquiler_temporario"), ("temporal", "alquiler_temporario"), ("temporaria", "alquiler_temporario"), ("Alquiler  Temporario", "alquiler_temporario"), ("alquiler temporal", "alquiler_temporario"),
    ("POR DIA", "alquiler_temporario"), ("por semana", "alquiler_temporario"), ("short  term", "alquiler_temporario"), ("alquiler_temporario", "alquiler_temporario"), ("venta_y_alquiler", "venta_y_alquiler"), ("alquiler", "alquiler"), ("venta casa", None), (" ", None),
    ("vacation", None), (None, None), ("permuta", None),
)

#: Types by their whole names, and what they are.
_TYPES = (
    ("departamento", "departamento"), ("Depto", "departamento"), (" PH ", "departamento"), ("departamento interno", "departamento"), ("DepartamentoInterno", "departamento"), ("monoambiente", "departamento"), ("PISO", "departamento"), ("apt", "departamento"),
    ("flat", "departamento"), ("Casa", "casa"), ("CHALET", "casa"), ("casa quinta", "casa"), ("quinta", "casa"), ("casas", "casa"), ("duplex", "casa"), ("DÚPLEX", "casa"),
    ("triplex", "casa"), ("tríplex", "casa"), ("terreno", "terreno"), ("LOTE", "terreno"), ("loteo", "terreno"), ("parcela", "terreno"), ("solar", "terreno"), ("Terrenos/Lotes", "terreno"),
    ("terrenos", "terreno"), ("local", "local"), ("Local Comercial", "local"), ("negocio", "local"), ("locales", "local"), ("oficina", "oficina"), ("oficina comercial", "oficina"), ("Office", "oficina"),
    ("oficinas", "oficina"), ("cochera", "cochera"), ("garage", "cochera"), ("GARAJE", "cochera"), ("cocheras", "cochera"), ("galpon", "galpon"), ("GALPÓN", "galpon"), ("galpones", "galpon"),
    ("casa alta", "otro"), ("casas quinta", "otro"), ("lotes", "otro"), ("ph.", "otro"), ("galpón nuevo", "otro"), (None, "otro"),
)

_KEY = "strip_accents(lower(trim(coalesce(x, ''))))"
_TYPE_WORDS = _picked("c_custkey", ("Departamento", "CASA quinta", "ph", " PH ", "Propiedad Horizontal", "Terreno", "Lote", "Oficina", "Local u oficina", "LOCAL", "Casa y lote", "Depto", "Terreno u oficina", "Depártamento", "Phoenix", "Quinta", None))

_STATES = _picked("o_orderkey", ("Activa", "Vendida", "PAUSADA", "reservado", "no_detectada vend", "Alquilado", "no detectada", "desconocida", None, "nueva", "vendida y alquilada", "Reservada o pausada", "NO_DETECTADA", "Desconocido", "Véndida"))

#: Words put before hosts, and the places they tell.
_HOSTS = (
    ("www.tandil-", "Tandil/Buenos Aires"), ("salta.mendoza.", ""), ("", ""), ("Cafayate.", "Cafayate/Salta"), ("inmo-ushuaia-", "Ushuaia/Tierra del Fuego"), ("bariloche", "San Carlos de Bariloche/Río Negro"), ("ana@neuquen-", "Neuquén/Neuquén"), ("resistencia.", "Resistencia/Chaco"),
    ("necochea-", "Necochea/Buenos Aires"), ("OLAVARRIA.", "Olavarría/Buenos Aires"), ("chivilcoy-", "Chivilcoy/Buenos Aires"), ("tandil.ushuaia.", ""), ("formosa.", "Formosa/Formosa"), ("www.posadas-", "Posadas/Misiones"), ("jujuy.", "San Salvador de Jujuy/Jujuy"), ("tucuman-", "San Miguel de Tucumán/Tucumán"),
    ("sal.ta.", "Salta/Salta"), ("mendoza-", "Mendoza/Mendoza"), ("córdoba-", "Córdoba/Córdoba"), ("la-pampa-", "La Pampa"), ("Chubut.", "Chubut"), ("casas.com/tandil/", ""),
)

#: Beginnings of names, and what their keys keep.
_NAMES = (
    ("Inmobiliaria ", ""), ("Estudio ", "estudio"), ("Depto ", "depto"), ("CASA ", "casa"), ("  ", ""), ("Bienes Raíces ", ""), ("Real Estate ", ""), ("Brokers ", "brokers"),
    ("Broker ", ""), ("Negocios & ", ""), ("Propiedades ", ""), ("López_", "lopez_"), (None, None),
)
#: Endings of names, and what their keys keep.
_FORMS = (
    ("", ""), (" S.A.", ""), (" SRL", ""), (" S.R.L.", ""), (" sas", ""), (" SAC", ""), (" S.A.S.", "s"), (" Sala", "sala"),
)

#: Endings of names, and what is left of them without licence numbers.
_LICENCES = (
    (" CPI 7968", ""), (" | Mendoza 2196", ""), (" Prop.", " Prop"), (" C.P.I. 7968", ""), (" CUCICBA 1234", ""), (" C.M.C.P.S.I. 123", ""), (" CSI 6250", ""), (" Mat. 0336", ""),
    (" col 123456", ""), (" REG.6250", ""), (" Colegiado 777", ""), (" Matrícula 4321", ""), (" matricula 4321 y CPI 7968", " y"), (" desde  1978", ""), (" (abc 6250)", ""), (" (CSI 6250) Sur", " () Sur"),
    (" | 1 y 2 Ambientes", ""), (" S.A.", " S.A."), (" Col 999 Norte", " Norte"), (" Mat. 12", " Mat. 12"), (" CPI 1234567", " CPI 1234567"), (" - ", ""), (None, None),
)

# texts
case("str05_name_key", "part", {"x": _picked("p_partkey", ("", "  Ñandú & Cía. ", "São-Paulo_", "ÁÉÍÓÚ Ü ", "¡Ölçü! ", "ñÑ", None)) + " || p_name || '  &-' || p_brand"}, M.name_key, "trim(regexp_replace(strip_accents(lower(coalesce(x, ''))), '[^a-z0-9]+', ' ', 'g'))", "result")
case("str06_compare_key", "customer", {"x": f"{_picked('c_custkey', [x for x, _ in _NAMES])} || c_mktsegment || ' - ' || c_name || {_picked('c_custkey', [x for x, _ in _FORMS])}"}, M.compare_key,
     _told("c_custkey", [y for _, y in _NAMES]) + " || regexp_replace(lower(c_mktsegment || c_name), '[^a-z0-9_]', '', 'g') || " + _told("c_custkey", [y for _, y in _FORMS]), "result")
case("str08_display_name", "part", {"x": "concat(' ', p_name, ' (', p_brand, ')  & ', p_type)"}, M.display_name, "array_to_string(list_transform(regexp_extract_all(trim(regexp_replace(regexp_replace(x, '\\s+', ' ', 'g'), '[^\\w\\s&]', '', 'g')), '[A-Za-z]+|[^A-Za-z]+'), lambda w: upper(left(w, 1)) || lower(w[2:])), '')")
case("str09_capitalised", "customer", {"x": _CLERK}, M.capitalised, "array_to_string(list_transform(string_split(" + _squeezed("lower(x)") + ", ' '), lambda w: upper(left(w, 1)) || w[2:]), ' ')")
case("str10_neighbourhood", "orders", {"x": "concat(CASE o_orderkey % 3 WHEN 0 THEN ' MicroCentro' WHEN 1 THEN 'constitucion ' ELSE substring(o_orderpriority, 3) END, '')"}, M.neighbourhood,
     "CASE lower(trim(x)) WHEN 'microcentro' THEN 'Centro' WHEN 'constitucion' THEN 'Constitución' ELSE array_to_string(list_transform(string_split(" + _squeezed("lower(x)") + ", ' '), lambda w: upper(left(w, 1)) || w[2:]), ' ') END")
case("str11_last_part", "customer", {"x": _CLERK}, M.last_part, _squeezed("string_split(x, '-')[-1]"))
case("str12_street_part", "part", {"x": "concat(p_name, ', Local ', CAST(p_size AS string), ' - ', p_type)"}, M.street_part, "trim(regexp_replace(regexp_replace(string_split(x, '-')[1], '(?i)\\blocal\\b', '', 'g'), '[\\s,]+', ' ', 'g'))")
case("str14_licence", "supplier", {"x": "s_name || " + _picked("s_suppkey", [x for x, _ in _LICENCES])}, M.without_licence, "s_name || " + _told("s_suppkey", [y for _, y in _LICENCES]), "result")
case("str31_truncated", "documents", {"x": "text"}, lambda x: P.truncated(x, 300), f"left(nullif(regexp_replace(regexp_replace(coalesce(x, ''), '{_SPACE}+', ' ', 'g'), '^ | $', '', 'g'), ''), 300)")
case("str33_number_near", "part", {"x": "concat(CASE WHEN p_partkey % 2 = 0 THEN concat(CAST(p_size AS string), ' ') ELSE '' END, 'dormitorios: ', CAST(p_size + 1 AS string))"}, lambda x: Cd.number_near(x, "dorm|habit"), "CASE WHEN p_partkey % 2 = 0 THEN p_size ELSE p_size + 1 END")
case("str35_spaced_key", "customer", {"x": _CLERK}, M.spaced_key, r"trim(regexp_replace(regexp_replace(lower(trim(x)), '[^\w\s]', '', 'g'), '\s+', ' ', 'g'))")
case("str16_page_text", "documents", {"x": f"CASE doc_id % 5 WHEN 0 THEN ' PeÃ³n ' || {_replaced('text', _MISREAD.items())} || ' Apto crÃ©dito ' WHEN 1 THEN {_AS_LATIN} WHEN 2 THEN 'Propiedad sin tÃtulo ' || text WHEN 3 THEN 'Propiedad sin tÃ' || chr(173) || 'tulo ' || text ELSE text END"}, lambda x: F.sha2(M.shown_text(x), 256),
     f"sha256(regexp_replace({_replaced("coalesce(x, '')", _SHOWN)}, '^{_SPACE}+|{_SPACE}+$', '', 'g'))", "sha2(result, 256)")
case("str15_garbled", "documents", {"x": f"CASE doc_id % 3 WHEN 0 THEN {_AS_LATIN} WHEN 1 THEN 'Ãxx ' || text ELSE text END"}, lambda x: F.sha2(M.regarbled(x), 256),
     "sha256(CASE WHEN doc_id % 3 = 0 AND text <> '' AND len(regexp_extract_all(text, '[ÃÂ�]')) < len(regexp_extract_all(x, '[ÃÂ�]')) THEN text ELSE x END)", "sha2(result, 256)")
case("tel02_first_phone", "events", {"x": "concat('tel ', CASE WHEN event_id % 3 = 0 THEN '(11) ' WHEN event_id % 3 = 1 THEN '011 ' ELSE 'x' END, CAST(1000 + user_id % 9000 AS string), '-', CAST(1000 + event_id % 9000 AS string), ' ', event_type)"}, M.first_phone, "CASE WHEN event_id % 3 < 2 THEN '+5411' || (1000 + user_id % 9000) || (1000 + event_id % 9000) END")
case("tel03_chat_url", "events", {"x": "concat('+54 ', CAST(user_id * 997 AS string), '-', CAST(event_id AS string))"}, D.chat_url, "CASE WHEN len(regexp_replace(x, '\\D', '', 'g')) >= 8 THEN 'https://wa.me/' || regexp_replace(x, '\\D', '', 'g') END")
case("typ01_own_type", "part", {"x": "concat(' ', p_type, '  ', p_name)"}, P.own_type, _squeezed("lower(x)"))
case("cat04_operation_in_text", "part", {"x": _PART}, N.operation_in_text, "CASE WHEN contains(lower(x), 'alquiler') THEN 'alquiler' WHEN contains(lower(x), 'venta') THEN 'venta' END")
case("cat02_import_operation", "part", {"x": f"CASE WHEN p_partkey % 5 = 4 THEN p_type ELSE {_picked('p_partkey', [x for x, _ in _OPERATIONS])} END"}, N.imported_operation,
     "CASE WHEN p_partkey % 5 <> 4 THEN " + _told("p_partkey", [y for _, y in _OPERATIONS]) + " END", "result")
case("cat05_type_name", "part", {"x": f"CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE ' ' || CASE WHEN p_size % 2 = 0 THEN upper({_picked('p_partkey', [x for x, _ in _TYPES])}) ELSE {_picked('p_partkey', [x for x, _ in _TYPES])} END || ' ' END"}, M.type_name,
     "CASE WHEN p_partkey % 3 = 0 THEN 'otro' ELSE " + _told("p_partkey", [y for _, y in _TYPES]) + " END", "result")
case("cat07_page_type", "customer", {"x": _CLERK}, D.property_type, "CASE WHEN contains(lower(x), 'depart') THEN 'departamento' WHEN contains(lower(x), 'casa') THEN 'casa' WHEN contains(lower(x), 'terreno') OR contains(lower(x), 'lote') THEN 'terreno' WHEN contains(lower(x), 'oficina') THEN 'oficina' WHEN contains(lower(x), 'local') THEN 'local' ELSE 'otro' END", "result",
     ({"x": f"CASE WHEN c_custkey % 2 = 0 THEN {_CLERK} WHEN c_custkey % 4 = 1 THEN {_TYPE_WORDS} ELSE {_TYPE_WORDS} || ' ' || c_name END"},
      f"CASE WHEN contains({_KEY}, 'depart') THEN 'departamento' WHEN contains({_KEY}, 'casa') THEN 'casa' WHEN {_KEY} = 'ph' OR contains({_KEY}, 'propiedad horizontal') THEN 'ph' WHEN contains({_KEY}, 'terreno') OR contains({_KEY}, 'lote') THEN 'terreno' WHEN contains({_KEY}, 'oficina') THEN 'oficina' WHEN contains({_KEY}, 'local') THEN 'local' ELSE 'otro' END"))
case("cat08_page_status", "orders", {"x": f"CASE WHEN o_orderkey % 2 = 0 THEN CASE o_orderstatus WHEN 'O' THEN 'Activa' WHEN 'F' THEN concat('Vendida ', CAST(o_orderkey AS string)) ELSE 'PAUSADA' END ELSE {_STATES} || ' ' || o_orderpriority END"}, D.status,
     f"CASE WHEN contains({_KEY}, 'paus') THEN 'pausada' WHEN contains({_KEY}, 'reserv') THEN 'reservada' WHEN contains({_KEY}, 'vend') AND NOT contains({_KEY}, 'no_detect') THEN 'vendida' WHEN contains({_KEY}, 'alquil') THEN 'alquilada' WHEN contains({_KEY}, 'no_detect') OR contains({_KEY}, 'no detect') THEN 'no_detectada_en_ultimo_scraping' WHEN contains({_KEY}, 'descon') THEN 'desconocida' ELSE 'activa' END", "result")
case("cat13_query_category", "customer", {"x": "concat('empresa ', CASE WHEN c_nationkey % 2 = 0 THEN 'CONSTRUCTORA ' ELSE '' END, c_mktsegment)"}, G.category_of_query, "CASE WHEN c_nationkey % 2 = 0 THEN 'constructora' ELSE 'desarrolladora' END")
case("mig01_states", "orders", {"x": "CASE o_orderstatus WHEN 'O' THEN 'activo' WHEN 'F' THEN 'inactivo' ELSE lower(substring(o_orderpriority, 3)) END"}, D.migrated_state, "CASE x WHEN 'activo' THEN 'activa' WHEN 'inactivo' THEN 'desconocida' ELSE x END")
case("flt22_not_agency", "customer", {"x": "concat(CASE c_custkey % 5 WHEN 0 THEN 'Barrio Privado ' WHEN 1 THEN 'Hamburguesería ' WHEN 2 THEN 'Calle 24 ' WHEN 3 THEN 'Calleja ' ELSE 'Inmobiliaria ' END, c_name)"}, M.not_an_agency, "c_custkey % 5 < 3")
case("joi17_city_province", "customer", {"x": "CASE c_nationkey % 4 WHEN 0 THEN ' ROSARIO' WHEN 1 THEN 'Córdoba ' ELSE c_mktsegment END"}, lambda x: L.province_of_city(x, CITIES), "CASE c_nationkey % 4 WHEN 0 THEN 'Santa Fe' WHEN 1 THEN 'Córdoba' END")
case("joi17_text_province", "customer", {"x": "concat(c_name, CASE c_nationkey % 3 WHEN 0 THEN ' de Ushuaia y Córdoba' WHEN 1 THEN ' Mar del Plata' ELSE '' END)"}, lambda x: L.province_in_text(x, CITIES), "CASE c_nationkey % 3 WHEN 0 THEN 'Córdoba' WHEN 1 THEN 'Buenos Aires' END")
case("prj17_location", "customer", {"a": "CASE WHEN c_custkey % 3 <> 0 THEN c_mktsegment ELSE '' END", "b": "CASE WHEN c_custkey % 4 <> 0 THEN c_name END", "c": "CASE WHEN c_custkey % 5 = 0 THEN c_name WHEN c_custkey % 6 = 0 THEN '' ELSE 'Chaco' END"}, D.location_label,
     "coalesce(nullif(array_to_string(list_filter([nullif(a, ''), nullif(b, ''), CASE WHEN nullif(c, '') IS DISTINCT FROM nullif(b, '') THEN nullif(c, '') END], lambda v: v IS NOT NULL), ', '), ''), 'Argentina')")
case("str30_made_title", "part", {"t": "CASE WHEN p_partkey % 3 = 0 THEN concat('  ', p_name, '  ') ELSE ' ' END", "k": "CASE WHEN p_partkey % 2 = 0 THEN p_type END", "c": "CASE WHEN p_partkey % 5 <> 0 THEN p_brand END", "p": "'Chaco'"}, L.title_or_made,
     "coalesce(" + _squeezed("t") + ", CASE WHEN k IS NOT NULL THEN upper(left(k, 1)) || lower(k[2:]) || ' en ' || coalesce(c, p) WHEN c IS NOT NULL THEN 'Propiedad en ' || c ELSE 'Propiedad sin título' END)")
case("jsn04_aliases", "part", {"a": "CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE '  ' END", "b": "CASE WHEN p_partkey % 2 = 0 THEN concat(' ', p_brand) END", "c": "p_type"}, P.first_present, "coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(c), ''))")

# numbers
case("num04_rating", "part", {"x": "replace(CAST(CAST(p_size AS decimal(6, 2)) / 8 AS string), '.', ',')"}, P.rating, "CASE WHEN p_size / 8 <= 5 THEN round_even(p_size / 8, 1) END")
case("num04_reviews", "part", {"x": "concat('(', CAST(p_size AS string), '.', CAST(p_partkey AS string), ') ', p_type)"}, P.review_count, "(p_size || '' || p_partkey)::BIGINT", "CAST(result AS bigint)",
     ({"x": "CASE p_partkey % 7 WHEN 1 THEN p_name WHEN 2 THEN NULL WHEN 3 THEN concat(CAST(p_size AS string), ' reseñas de ', p_brand) WHEN 4 THEN concat('9.223.372.036.854.775.80', CAST(p_size % 10 AS string)) WHEN 5 THEN concat(CAST(p_partkey AS string), ' opiniones') WHEN 6 THEN '' ELSE concat('(', CAST(p_size AS string), '.', CAST(p_partkey AS string), ') ', p_type) END"},
      "TRY_CAST(nullif(regexp_replace(x, '[^0-9]', '', 'g'), '') AS BIGINT)"))
case("num05_int32", "orders", {"x": "CAST(o_orderkey * 1000003 AS string)"}, P.int32, "CASE WHEN o_orderkey * 1000003 <= 2147483647 THEN o_orderkey * 1000003 END", "CAST(result AS int)",
     ({"x": "CASE o_orderkey % 7 WHEN 0 THEN NULL WHEN 1 THEN concat('x ', CAST(o_orderkey AS string)) WHEN 2 THEN CAST(-o_orderkey * 1000003 AS string) WHEN 3 THEN CAST(2147483648 - o_orderkey % 2 AS string) WHEN 4 THEN CAST(-2147483648 - o_orderkey % 2 AS string) ELSE CAST(o_orderkey * 1000003 AS string) END"},
      "CASE WHEN TRY_CAST(x AS BIGINT) BETWEEN -2147483648 AND 2147483647 THEN TRY_CAST(x AS INTEGER) END"))
case("num07_price_label", "orders", {"n": "CAST(floor(floor(o_totalprice) * (o_orderkey % 3) / CASE WHEN o_orderkey % 5 = 0 THEN 100 ELSE 1 END) AS bigint)", "c": "CASE WHEN o_orderkey % 2 = 0 THEN 'USD' ELSE 'ARS' END"}, D.price_label,
     "CASE WHEN n > 0 THEN c || ' ' || CASE WHEN n < 10000 THEN n::VARCHAR ELSE replace(format('{:,}', n), ',', '.') END ELSE 'Consultar precio' END")
case("num08_import_currency", "orders", {"x": "CASE o_orderstatus WHEN 'O' THEN ' u$s' WHEN 'F' THEN 'Pesos' ELSE concat(' ', substring(o_orderpriority, 3)) END"}, P.import_currency, "CASE o_orderstatus WHEN 'O' THEN 'USD' WHEN 'F' THEN 'ARS' ELSE " + _squeezed("upper(x)") + " END")
case("num08_page_currency", "orders", {"x": "concat(o_orderpriority, CASE WHEN o_orderkey % 3 = 0 THEN ' Pesos' WHEN o_orderkey % 3 = 1 THEN ' ars' ELSE ' usd' END)"}, D.currency, "CASE WHEN o_orderkey % 3 < 2 THEN 'ARS' ELSE 'USD' END")
case("num10_whole", "part", {"x": "CASE WHEN p_partkey % 3 = 0 THEN concat(' -', CAST(p_size AS string), ' ') WHEN p_partkey % 3 = 1 THEN CAST(p_size AS string) ELSE CAST(p_retailprice AS string) END"}, P.whole, "CASE p_partkey % 3 WHEN 0 THEN -p_size WHEN 1 THEN p_size ELSE 0 END")
case("num10_comma", "part", {"x": "concat(CAST(p_size AS string), ',', CAST(p_partkey % 10 AS string))"}, P.comma_number, "(p_size || '.' || (p_partkey % 10))::DOUBLE")
case("num10_grouped", "part", {"x": "concat(CAST(p_size AS string), '.', CAST(100 + p_partkey % 900 AS string), CASE WHEN p_partkey % 7 = 0 THEN ' x' ELSE '' END)"}, P.grouped_whole, "CASE WHEN p_partkey % 7 <> 0 THEN p_size * 1000 + 100 + p_partkey % 900 END")
case("prj16_specs", "part", {"a": "CAST(p_size % 5 AS bigint)", "b": "CAST(p_partkey % 3 AS bigint)", "c": "CAST(p_size % 3 AS bigint)", "d": "CAST(p_partkey % 2 AS bigint)", "t": "CAST(p_size * 3 AS bigint)", "u": "CAST(CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 1 THEN p_size * 3 ELSE p_size END AS bigint)"},
     lambda *x: F.array_join(D.specs(*x), "|"),
     "array_to_string(list_filter([CASE WHEN a > 0 THEN a || ' amb.' END, CASE WHEN b > 0 THEN b || ' dorm.' END, CASE WHEN c = 1 THEN '1 baño' WHEN c > 1 THEN c || ' baños' END, CASE WHEN d > 0 THEN d || ' coch.' END, CASE WHEN t > 0 THEN t || CASE WHEN u > 0 AND u <> t THEN ' m² tot.' ELSE ' m²' END WHEN u > 0 THEN u || ' m² cub.' END, CASE WHEN t > 0 AND u > 0 AND u <> t THEN u || ' m² cub.' END], lambda v: v IS NOT NULL), '|')")
case("prj18_counter", "part", {"a": "CAST(p_size * p_partkey AS bigint)", "b": "CAST(p_size * p_partkey + p_partkey % 2 AS bigint)", "c": "CAST(24 AS bigint)"}, D.counter_label,
     "CASE WHEN a < b THEN CASE WHEN a < 10000 THEN a::VARCHAR ELSE replace(format('{:,}', a), ',', '.') END || ' de ' ELSE '' END || CASE WHEN b < 10000 THEN b::VARCHAR ELSE replace(format('{:,}', b), ',', '.') END || CASE WHEN a < b THEN ' propiedades' ELSE ' propiedades activas' END || CASE WHEN c < a THEN ' · 24 visibles' ELSE '' END")
case("dat01_duration", "events", {"a": "ts", "b": "ts + make_interval(0, 0, 0, 0, 0, 0, user_id)"}, P.seconds_between, "user_id")
case("dat03_date_label", "orders", {"x": "CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority ELSE substring(CAST(o_orderdate AS string), 1, 10) END"}, D.date_label, "CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%d/%m/%Y') END")
case("dat04_dated", "orders", {"x": "concat(' ', CASE WHEN o_orderkey % 3 = 0 THEN 'el ' ELSE '' END, substring(CAST(o_orderdate AS string), 1, 10), ' ')"}, P.dated, "CASE WHEN o_orderkey % 3 <> 0 THEN trim(x) END")
case("boo01_boolean", "events", {"x": "CASE event_type WHEN 'click' THEN ' Sí ' WHEN 'view' THEN 'NO' WHEN 'signup' THEN CAST(user_id % 3 AS string) ELSE event_type END"}, P.boolean, "CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false WHEN 'signup' THEN user_id % 3 = 1 ELSE false END")
case("sco03_completeness", "part", {"p": "CASE WHEN p_partkey % 2 = 0 THEN p_retailprice END", "m": "CASE WHEN p_partkey % 3 = 0 THEN p_size END", "a": "CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name END", "i": "CASE WHEN p_partkey % 7 = 0 THEN array(p_name) END", "o": "CASE WHEN p_partkey % 4 = 0 THEN ' Venta' ELSE p_type END"},
     publishing.completeness, "(p_partkey % 2 = 0)::INT + (p_partkey % 3 = 0)::INT + (p_partkey % 5 <> 0)::INT + (p_partkey % 7 = 0)::INT + (p_partkey % 4 = 0)::INT")
case("sco11_precision", "part", {"a": "CASE p_size % 4 WHEN 0 THEN 'house' WHEN 1 THEN 'road' WHEN 2 THEN 'suburb' ELSE p_name END", "k": "CASE WHEN p_partkey % 5 = 0 THEN 'Building' ELSE p_type END", "r": "CAST(p_size AS string)"}, Gc.precision,
     "CASE WHEN a = 'house' OR k = 'Building' THEN 'exact' WHEN a = 'road' THEN 'street' WHEN a = 'suburb' THEN 'area' WHEN p_size >= 26 THEN 'street' ELSE 'approximate' END")

# objects
case("jsn01_object", "events", {"x": "CASE WHEN event_id % 4 = 0 THEN concat('[', props, ']') WHEN event_id % 4 = 1 THEN substring(props, 1, length(props) - 1) ELSE props END"}, lambda x: F.to_json(P.json_object(x)), "CASE WHEN event_id % 4 < 2 THEN '{}' ELSE replace(x, ' ', '') END")
case("jsn02_merge", "events", {"x": "props", "v": "event_type"}, lambda x, v: P.merged_json(x, {"a": v, "z": F.lit(1)}), "'{\"a\":\"' || v || '\",\"k\":' || json_extract_string(x, '$.k') || ',\"z\":1}'", "result",
     ({"x": "CASE event_id % 5 WHEN 0 THEN props WHEN 1 THEN concat('{\"b\": {\"d\": ', CAST(user_id AS string), ', \"c\": [1, \"x\"]}, \"a\": 9, ', substring(props, 2)) WHEN 2 THEN concat('[', props, ']') WHEN 3 THEN substring(props, 1, length(props) - 1) END", "v": "CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 7 = 1 THEN concat('q\"', event_type) ELSE event_type END"},
      "'{\"a\":' || CASE event_id % 7 WHEN 0 THEN 'null' WHEN 1 THEN '\"q\\\"' || event_type || '\"' ELSE '\"' || event_type || '\"' END || CASE WHEN event_id % 5 = 1 THEN ',\"b\":{\"c\":[1,\"x\"],\"d\":' || user_id || '}' ELSE '' END || CASE WHEN event_id % 5 < 2 THEN ',\"k\":' || json_extract_string(props, '$.k') ELSE '' END || ',\"z\":1}'"))
case("jsn03_without_empty", "events", {"x": "concat('{\"e\": \"\", \"n\": null, \"l\": [], \"t\": \"', event_type, '\", ', substring(props, 2))"}, lambda x: F.array_join(F.transform(F.array_sort(F.map_entries(P.without_empty(x))), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ","), "'k=' || json_extract_string(props, '$.k') || ',t=\"' || event_type || '\"'")
case("arr02_image_item", "pages", {"x": "CASE page_id % 9 WHEN 0 THEN concat('\"', url, '\"') WHEN 1 THEN concat('{\"url\": \"\", \"src\": \" ', url, ' \"}') WHEN 2 THEN concat('[\"', url, '\"]') WHEN 3 THEN concat('{\"src\": null, \"href\": \"', url, '\", \"image\": \"i\"}') WHEN 4 THEN concat('{\"image\": \"', url, '\"}') WHEN 5 THEN concat('{\"url\": \"', url, '\", \"src\": \"s\"}') WHEN 6 THEN concat('{\"url\": \"', url) WHEN 7 THEN CAST(page_id AS string) END"}, I.item_url,
     "CASE WHEN page_id % 9 IN (0, 1, 3, 4, 5) THEN url END", "result")

# addresses
case("url02_site", "pages", {"x": "CASE WHEN page_id % 2 = 0 THEN concat(' ', upper(url), '//') ELSE regexp_replace(url, '^https?://', '') END"}, M.site, "regexp_replace(rtrim(CASE WHEN page_id % 2 = 0 THEN lower(trim(x)) ELSE 'https://' || replace(lower(trim(x)), ' ', '') END, '/'), '^(https?://)www\\.', '\\1')")
case("url02_site_www", "pages", {"x": "concat(url, '/')"}, lambda x: M.site(x, keep_www=True), "rtrim(lower(x), '/')")
case("url03_unwrapped", "pages", {"x": "CASE WHEN page_id % 2 = 0 THEN concat('https://g.com/url?sa=t&q=', url) ELSE url END"}, U.unwrapped, "regexp_extract(regexp_extract(url, '^([^&#]*)', 1), '^([^?#]*)', 1)")
case("url04_absolute", "pages", {"x": "CASE page_id % 5 WHEN 0 THEN concat('/p/', page_id) WHEN 1 THEN concat('?p=', page_id) WHEN 2 THEN url WHEN 3 THEN '#top' ELSE concat('//cdn.com/', page_id) END", "b": "url"}, U.absolute,
     f"CASE page_id % 5 WHEN 0 THEN {_SITE} || x WHEN 1 THEN regexp_extract(url, '^([^?#]*)', 1) || x WHEN 2 THEN url WHEN 4 THEN 'https:' || x END")
case("url06_next_page", "pages", {"h": "concat('<a href=\"#\">1</a><a class=\"x\" href=\"/l?page=', page_id, '\">', CASE WHEN page_id % 2 = 0 THEN 'Siguiente' ELSE 'ver' END, '</a>', html)", "b": "url"}, K.next_page, f"CASE WHEN page_id % 2 = 0 THEN {_SITE} || '/l?page=' || page_id END")
case("url07_operation_of_path", "pages", {"x": "concat(url, CASE page_id % 3 WHEN 0 THEN '/Venta/item.asp' WHEN 1 THEN '/alquiler-temporario/ver.aspx' ELSE '/venta/casa.asp' END)"}, U.operation_of_path, "['venta', 'alquiler_temporario', NULL][page_id % 3 + 1]")
case("url09_site_base", "pages", {"x": "CASE WHEN page_id % 7 = 0 THEN regexp_replace(url, '^https?://', '') ELSE url END"}, U.site_base, f"CASE WHEN page_id % 7 <> 0 THEN nullif({_SITE}, '') END")
case("url10_page_url", "pages", {"x": "CASE WHEN page_id % 3 = 0 THEN concat('https://a.b/?pagina=', page_id, '&x=1') ELSE url END", "n": "CAST(page_id % 9 AS int)"}, U.page_url, "CASE WHEN page_id % 3 = 0 THEN 'https://a.b/?pagina=' || n || '&x=1' ELSE x || CASE WHEN contains(x, '?') THEN '&' ELSE '?' END || 'pagina=' || n END")
case("url11_click_urls", "pages", {"x": "concat('window.open(\\'', url, '\\'); f(\\'/propiedad/', page_id, '\\')')"}, lambda x: F.array_join(K.click_urls(x), "|"), "url || CASE WHEN regexp_matches(url, '(?i)^https?://.{2,}(propiedad|inmueble|detalle|ficha|ad|ref-|codigo|cod)') THEN '|' || url ELSE '' END || '|/propiedad/' || page_id")
case("cat14_operation_of_url", "pages", {"x": "concat(url, CASE WHEN page_id % 3 = 0 THEN '&Rent' ELSE '' END)"}, U.operation_of_url, "CASE WHEN regexp_matches(lower(x), 'alquiler|rent') THEN 'alquiler' ELSE 'venta' END")
case("flt13_prohibited", "pages", {"x": "CASE page_id % 4 WHEN 0 THEN concat('https://m.Facebook.com/', page_id) WHEN 1 THEN concat('https://my', 'facebook.com/', page_id) ELSE url END"}, manifest.prohibited, "page_id % 4 = 0")
case("flt20_detail_url", "pages", {"x": f"concat(regexp_extract(url, '^([a-zA-Z]+://[^/?#]+)', 1), CASE page_id % 6 WHEN 0 THEN '/propiedad/casa-' WHEN 1 THEN '/propiedades/venta/' WHEN 2 THEN '/ver?idprop=' WHEN 3 THEN '/contacto?id=' WHEN 4 THEN '/x/casa-en-venta-1' ELSE '/a/b/' END, page_id)", "b": "url"}, K.is_detail, "page_id % 6 IN (0, 2, 4)")
case("joi18_host_place", "pages", {"u": f"regexp_replace(url, '://', concat('://', {_picked('page_id', [x for x, _ in _HOSTS])}))"}, lambda u: F.concat_ws("/", L.place_of_host(u)["city"], L.place_of_host(u)["province"]),
     "CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://') THEN " + _told("page_id", [y for _, y in _HOSTS]) + " ELSE '' END", "result")
case("loc10_agency_name", "pages", {"u": "CASE WHEN page_id % 3 = 0 THEN concat('https://www.pagliaropropiedades.com.ar/', page_id) ELSE url END", "n": "CASE WHEN page_id % 2 = 0 THEN concat(' Norte ', page_id) END"}, D.agency_name, "CASE WHEN page_id % 3 = 0 THEN 'Juan I. Pagliaro Propiedades' WHEN page_id % 2 = 0 THEN 'Norte ' || page_id ELSE 'Agencia sin nombre' END")

# pages
case("web04_pagination", "pages", {"h": "CASE WHEN page_id % 4 = 0 THEN concat(html, '<div class=\"loadmore\">') WHEN page_id % 4 = 1 THEN concat(html, '<a href=\"/l?pagina=2\">2</a>') WHEN page_id % 4 = 2 THEN concat(html, '<b class=\"Pagination\">') ELSE html END", "u": "CASE WHEN page_id % 2 = 0 THEN url END"}, K.pagination,
     "CASE WHEN " + _any("h", ("infinite", "infinitescroll", "lazyload", "intersectionobserver", "loadmore", "cargar-mas")) + " THEN 'scroll_infinito' WHEN page_id % 4 = 1 OR regexp_matches(coalesce(u, ''), '(?i)[?&](page|pagina|p|pg)=[0-9]+|/page[/-][0-9]+') THEN 'url' WHEN " + _any("lower(h)", ("siguiente", "next", "btn-next", "pagination", "paginacion")) + " THEN 'click' ELSE 'url' END")
case("web05_total", "pages", {"h": "concat('<h2>', 1 + page_id % 900, ' propiedades</h2>', html)"}, lambda h: F.concat_ws("/", K.listing_total(h)["total"].cast("string"), K.listing_total(h)["pages"].cast("string")), "(1 + page_id % 900) || '/' || ((1 + page_id % 900 + 11) // 12)")
case("web02_site_key", "pages", {"h": "concat(html, CASE WHEN page_id % 2 = 0 THEN concat('<script>api_key = \"', sha2(CAST(page_id AS string), 256), '\"</script>') ELSE '' END)"}, K.site_key, "CASE WHEN page_id % 2 = 0 THEN sha256(left(sha256(page_id::VARCHAR), 50)) END")
case("web03_list_page", "pages", {"h": "concat('<nav><a href=\"/nosotros\">N</a>', CASE WHEN page_id % 2 = 0 THEN '<a href=\"/propiedades\">P</a>' ELSE '' END, '</nav>', html, '<p><a href=\"/buscar/', page_id, '\">b</a></p>')", "u": "url"}, K.list_page, f"{_SITE} || CASE WHEN page_id % 2 = 0 THEN '/propiedades' ELSE '/buscar/' || page_id END")
case("flt23_robot_wall", "pages", {"h": "concat(CASE WHEN page_id % 5 = 0 THEN '<p>Just a moment...</p>' ELSE '' END, html)", "s": "CAST(CASE WHEN page_id % 3 = 0 THEN 403 ELSE 200 END AS int)"}, K.robot_wall, "page_id % 3 = 0 OR " + _any("lower(left(h, 5000))", K.ROBOT_WALLS))
case("flt24_block", "pages", {"s": "CAST(CASE page_id % 13 WHEN 0 THEN 403 WHEN 1 THEN 429 WHEN 2 THEN 502 WHEN 5 THEN NULL WHEN 6 THEN 500 WHEN 7 THEN 404 ELSE 200 END AS int)", "h": "CASE WHEN page_id % 13 < 12 THEN html || CASE page_id % 13 WHEN 3 THEN '<p><b>Access</b> denied</p>' WHEN 5 THEN '<p>CF-Challenge</p>' WHEN 7 THEN '<p>Captcha</p>' WHEN 8 THEN '<p>captcha</p>' WHEN 9 THEN '<noscript><p>captcha</p></noscript>' WHEN 10 THEN '<p>captcha, access denied</p>' WHEN 11 THEN '<style>.captcha{color:red}</style>' ELSE '<script>access denied</script>' END END", "n": "CAST(CASE page_id % 13 WHEN 8 THEN 2 WHEN 10 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS int)"}, lambda s, h, n: K.block_reason(s, h, n, ("access denied", "cf-challenge")),
     "['HTTP 403 Forbidden', 'HTTP 429 Too Many Requests', 'HTTP 502 Server Error', 'Texto de bloqueo detectado: ''access denied''', NULL, 'Texto de bloqueo detectado: ''cf-challenge''', 'HTTP 500 Server Error', 'Captcha activo sin cards visibles', NULL, NULL, 'Texto de bloqueo detectado: ''access denied''', NULL, NULL][page_id % 13 + 1]", "result")
case("flt36_retryable", "pages", {"x": "concat('HTTP ', CASE page_id % 4 WHEN 0 THEN '429' WHEN 1 THEN '503' WHEN 2 THEN '403' ELSE '404' END, ' ', url)"}, K.retryable_block, "page_id % 4 < 2")
case("cat09_class_types", "pages", {"h": "concat(CASE page_id % 3 WHEN 0 THEN '<div class=\"x tipo-local-comercial operacion-venta\">' WHEN 1 THEN '<p class=\"property_types-ph operacion-alquiler\">' ELSE '' END, html)"},
     lambda h: F.concat_ws("/", F.coalesce(Pg.type_of_classes(h), F.lit("-")), F.coalesce(F.nullif(Pg.operation_of_classes(h), F.lit("")), F.lit("-"))), "['local/venta', 'departamento/alquiler', '-/-'][page_id % 3 + 1]")
case("eml01_site_emails", "pages", {"h": "concat(html, '<p>z@otra.com y INFO@norte', page_id, '.com</p><a href=\"mailto:Ventas@norte', page_id, '.com?subject=x\">m</a>')", "d": "concat('norte', page_id, '.com')"}, lambda h, d: F.array_join(K.contact_emails(h, d), "|"), 
     "array_to_string(list_concat(['ventas@' || d], list_filter(" + _MAILS + ", lambda e: contains(e, d)), list_filter(" + _MAILS + ", lambda e: NOT contains(e, d))), '|')")
case("arr01_image_split", "pages", {"x": "array(url, concat(url, '/logo.png'), concat(' ', url, ' '), concat('https://x.com/', page_id, '.SVG'), concat('https://x.com/c', page_id, '.jpg'), NULL, 'data:image/png')"},
     lambda x: F.concat(F.array_join(I.split(x)["kept"], "|"), F.lit(" / "), F.array_join(I.split(x)["discarded"], "|")),
     "CASE WHEN " + _any("lower(url)", I.BRANDING + I.SURFACE) + " OR regexp_matches(lower(url), '(^|[/_.-])360([/_.-]|$)') THEN 'https://x.com/c' || page_id || '.jpg / ' || url || '|' || url || '/logo.png|https://x.com/' || page_id || '.SVG|data:image/png' ELSE url || '|https://x.com/c' || page_id || '.jpg / ' || url || '/logo.png|https://x.com/' || page_id || '.SVG|data:image/png' END")
case("arr06_any_real", "pages", {"x": "CASE page_id % 3 WHEN 0 THEN array(concat('/logo', page_id, '.png'), '') WHEN 1 THEN array('menu.png', concat('https://x.com/c', page_id, '.jpg')) END"}, I.any_real, "page_id % 3 = 1")
case("arr03_page_images", "pages", {"m": "CASE WHEN page_id % 2 = 0 THEN concat('m', page_id, '.jpg') END", "x": "array('a.jpg', concat('m', page_id, '.jpg'), 'virtual-1.jpg', concat('x/360/', page_id, '.jpg'), 'a.jpg')"}, lambda m, x: F.array_join(I.shown(m, x), "|"), "CASE WHEN page_id % 2 = 0 THEN m || '|a.jpg' ELSE 'a.jpg|m' || page_id || '.jpg' END")


def query_of(name: str) -> Callable[[SparkSession, str], DataFrame]:
    of_table, key, inputs, function, _ = CASES[name]

    def query(s: SparkSession, d: str) -> DataFrame:
        def of(inputs: dict[str, str]) -> DataFrame:
            rows = table(s, d, of_table).select(F.col(key).alias("id"), *(F.expr(x).alias(f"_{n}") for n, x in inputs.items()))
            return rows.select("id", function(*(F.col(f"_{n}") for n in inputs)).alias("result"))

        rows = of(inputs)
        if name not in SHAPES:
            return rows
        shapes = value_queries.QUERIES[name](s, d).select("id", F.expr(SHAPES[name]).alias("result"))
        out = rows.withColumn("origin", F.lit("columns")).unionByName(shapes.withColumn("origin", F.lit("shapes")))
        return out.unionByName(of(BRANCHES[name][0]).withColumn("origin", F.lit("branches"))) if name in BRANCHES else out

    query.__name__ = name
    return query


def _duck(x: str) -> str:
    """An input as DuckDB writes it."""
    out = x.replace(_AS_LATIN, _DUCK_AS_LATIN).replace("element_at(array(", "list_extract(list_value(").replace("array(", "list_value(").replace("\\'", "''").replace(" AS string)", " AS VARCHAR)").replace("sha2(", "_sha(").replace("make_interval(0, 0, 0, 0, 0, 0, user_id)", "to_seconds(user_id)")
    return out.replace("_sha(CAST(page_id AS VARCHAR), 256)", "sha256(page_id::VARCHAR)").replace("_sha(result, 256)", "sha256(result)")


def sql_of(name: str) -> str:
    of_table, key, inputs, _, result = CASES[name]

    def of(inputs: dict[str, str], result: str) -> str:
        return f"SELECT {key} AS id, {result} AS result FROM (SELECT *, {', '.join(f'{_duck(x)} AS {n}' for n, x in inputs.items())} FROM {of_table})"

    rows = of(inputs, result)
    if name not in SHAPES:
        return rows
    out = f"SELECT *, 'columns' AS origin FROM ({rows}) UNION ALL SELECT id, {_duck(SHAPES[name])} AS result, 'shapes' AS origin FROM ({value_queries.SQL[name]})"
    return f"{out} UNION ALL SELECT *, 'branches' AS origin FROM ({of(*BRANCHES[name])})" if name in BRANCHES else out


QUERIES = {name: query_of(name) for name in CASES}
SQL = {name: sql_of(name) for name in CASES}
