"""Texts of cards, slugs, features and registry rows: numbers by their words, places by their position. Native expressions; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions import names, normalize as N, parsing as P
from terrano.functions.normalize import let

#: Words of slugs that name no place.
SLUG_WORDS = (
    "venta", "alquiler", "en", "de", "la", "los", "las", "del", "al", "por", "con", "sin", "una", "uno", "para", "casa", "departamento", "depto", "dep", "terreno", "local", "oficina", "cochera", "galpon",
    "duplex", "monoambiente", "ph", "inmueble", "propiedad", "inmobiliaria", "real", "estate", "arg", "com", "net", "property", "propiedades", "lote", "chalet", "quinta", "piso", "flat", "apt", "quincho",
    "triplex", "house", "apart",
)
#: What features' labels say, in order.
FEATURES = (("dormitorios", ("dorm", "habit")), ("banos", ("baño", "bano")), ("ambientes", ("ambi",)), ("metros", ("sup", "m²", "metro", "area", "superficie")))
TYPE_LABELS = ("tipo", "inmueble", "propiedad", "tipolog")
#: URLs of single listings, and ends of URLs of lists.
DETAIL_PATH = r"(?i)/\d{5,}(?:[/?#-]|$)|/propiedad(?:es)?/|/property(?:ies)?/|/inmueble/|/ad/|/detalle/|/ficha(?:s|-)?|/listing/\d|/emprendimiento/\d"
DETAIL_QUERY = r"(?i)(?:^|&)(?:id|idprop|id_prop|cod|codigo|codig|ref|ficha|prop|aviso|inmueble)\s*=\s*\d+"
LIST_ENDS = ("/ventas", "/alquileres", "/propiedades", "/inmuebles", "/listings", "/results", "/resultados", "/busqueda", "/search", "/for-sale", "/for-rent", "/venta", "/alquiler")
CARD_CLASSES = r"(?i)class\s*=\s*[\"'][^\"']*(?:property-item|listing-item|ficha-item|resultado-item)"
PLAIN_CARDS = r"(?i)class\s*=\s*[\"'](?:[^\"']*\s)?card(?:\s[^\"']*)?[\"']"
MANY_CARDS = 15


def number_behind(x: Column, words: str) -> Column:
    """The whole number behind some words, without points; null if they do not occur."""
    return F.nullif(F.replace(F.regexp_extract(F.coalesce(x, F.lit("")), rf"(?i){words}\s+(\d[\d.]*)", 1), F.lit("."), F.lit("")), F.lit("")).try_cast("long")


def number_before(x: Column, words: str) -> Column:
    """The whole number before some words, without points; null if they do not occur."""
    return F.nullif(F.replace(F.regexp_extract(F.coalesce(x, F.lit("")), rf"(?i)(\d[\d.]*)\s+{words}", 1), F.lit("."), F.lit("")), F.lit("")).try_cast("long")


def profile(x: Column) -> Column:
    """struct of a directory card's numbers: since, level, ratings, adverts of sales and rents."""
    return F.struct(
        number_behind(x, r"Publica\s+desde").alias("publica_desde"), number_behind(x, "Nivel").alias("nivel"), number_before(F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)Ver\s+(\d+)\s+calificacion", "$1 calificacion"), "calificacion").alias("calificaciones"),
        number_before(x, r"Avisos?\s+compra").alias("avisos_compra"), number_before(x, r"Avisos?\s+alquiler").alias("avisos_alquiler"),
    )


def number_near(x: Column, words: str, gap: int = 15) -> Column:
    """The number before one of some words (a pattern), else the one up to ``gap`` characters behind it."""
    text = F.coalesce(x, F.lit(""))
    before = F.regexp_extract(text, rf"(?i)(\d+)\s*(?:{words})", 1)
    return F.nullif(F.when(before != "", before).otherwise(F.regexp_extract(text, rf"(?i)(?:{words})[^0-9]{{0,{gap}}}(\d+)", 1)), F.lit("")).try_cast("int")


def slug(url: Column) -> Column:
    """struct(title, address, neighbourhood, operation) that a detail URL's last part tells; nulls for what it does not."""
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"^([^?]*)", 1)
    last = F.regexp_extract(F.rtrim(path, F.lit("/")), "([^/]*)$", 1)
    digits = lambda p: F.rlike(p, F.lit("^[0-9]+$"))

    def of(s: Column) -> Column:
        parts = F.split(s, "-")
        first = F.array_position(F.transform(parts, digits), F.lit(False)).cast("int")
        kept = F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts))
        words = F.filter(kept, lambda p: ~digits(p) & (F.length(p) > 2) & ~F.lower(p).isin(*SLUG_WORDS))
        numbers = F.filter(kept, lambda p: digits(p) & F.length(p).between(2, 5))
        plain = F.array_join(F.filter(parts, lambda p: ~digits(p)), " ")
        joined = lambda ws: names.title(F.array_join(ws, " "))
        low, where = F.lower(s), F.lower(path)
        sold = F.contains(low, F.lit("en-venta")) | low.endswith("-venta") | F.contains(low, F.lit("-venta-")) | F.contains(where, F.lit("/venta"))
        rented = F.contains(low, F.lit("en-alquiler")) | low.endswith("-alquiler") | F.contains(low, F.lit("-alquiler-")) | F.contains(where, F.lit("/alquiler"))
        street = F.when(F.size(numbers) > 0, F.concat(joined(F.slice(words, F.lit(1), F.lit(3))), F.lit(" "), F.get(numbers, F.lit(0)))).otherwise(joined(F.slice(words, F.lit(1), F.lit(4))))
        return F.struct(
            F.left(names.title(F.when(plain != "", plain).otherwise(F.replace(s, F.lit("-"), F.lit(" ")))), F.lit(100)).alias("title"),
            F.when(F.size(words) > 0, street).alias("address"),
            F.when(F.size(words) > 0, joined(F.slice(words, F.greatest(F.size(words) - 1, F.lit(1)), F.lit(2)))).alias("neighbourhood"),
            F.when(sold, "venta").when(rented, "alquiler").alias("operation"),
        )

    return let(last, of)


def features(labels: Column, values: Column) -> Column:
    """struct(dormitorios, banos, ambientes, metros, tipo) of labelled values: the first that a label of its kind gives; areas from 10 to 10000."""
    pairs = F.zip_with(F.coalesce(labels, F.array().cast("array<string>")), F.coalesce(values, F.array().cast("array<string>")), lambda l, v: F.struct(F.lower(F.trim(l)).alias("l"), F.trim(v).alias("v")))
    has = lambda l, parts: F.rlike(l, F.lit("|".join(parts)))
    number = lambda v: F.nullif(F.regexp_extract(v, r"\d+", 0), F.lit("")).try_cast("int")

    def first(ps: Column, name: str, parts: tuple[str, ...], earlier: list[str]) -> Column:
        def good(p: Column) -> Column:
            hit = has(p["l"], parts) & (number(p["v"]) != 0)
            hit = hit & ~has(p["l"], earlier) if earlier else hit
            return F.coalesce(hit & number(p["v"]).between(10, 10000) if name == "metros" else hit, F.lit(False))

        return F.get(F.transform(F.filter(ps, good), lambda p: number(p["v"])), F.lit(0)).alias(name)

    def of(ps: Column) -> Column:
        out = [first(ps, name, parts, [w for _, ws in FEATURES[:n] for w in ws]) for n, (name, parts) in enumerate(FEATURES)]
        every = [p for _, parts in FEATURES for p in parts]
        kinds = F.transform(F.filter(ps, lambda p: F.coalesce(has(p["l"], TYPE_LABELS) & ~has(p["l"], every), F.lit(False))), lambda p: names.type_name(p["v"]))
        out.append(F.get(F.filter(kinds, lambda k: k != "otro"), F.lit(0)).alias("tipo"))
        return F.struct(*out)

    return let(pairs, of)


def is_list_page(url: Column, html: Column) -> Column:
    """Whether a page taken for a listing's is a list: not if its URL is a single listing's; by its URL's end, or by more than fifteen cards."""
    u, h = F.coalesce(url, F.lit("")), F.coalesce(html, F.lit(""))
    path, query = F.regexp_extract(u, "^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)", 1), F.regexp_extract(u, r"\?([^#]*)", 1)
    low = F.lower(F.rtrim(path, F.lit("/")))
    ends = F.rlike(low, F.lit("(?:" + "|".join(LIST_ENDS) + ")$")) & (F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit(""))) <= 2)
    cards = F.regexp_count(h, F.lit(CARD_CLASSES)) + F.regexp_count(h, F.lit(PLAIN_CARDS))
    return F.when(F.rlike(path, F.lit(DETAIL_PATH)) | F.rlike(query, F.lit(DETAIL_QUERY)), False).otherwise(ends | (cards > MANY_CARDS))


def registry_row(cells: Column) -> Column:
    """struct(matricula, nombre, direccion, telefono, email, estado) of a registry's cells (name and state, licence, seal, agency, address, contact); null without a licence."""
    cell = lambda i: F.coalesce(F.get(cells, F.lit(i)), F.lit(""))
    lines = lambda i: F.filter(F.transform(F.split(cell(i), r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")
    licence = F.regexp_extract(cell(1), r"\d+", 0)
    state = F.lower(cell(0))
    last = lambda xs: F.try_element_at(xs, F.lit(-1))
    made = F.struct(
        licence.alias("matricula"), F.coalesce(N.squeeze(cell(3)), F.lit("")).alias("nombre"), F.coalesce(F.get(F.filter(lines(4), lambda x: ~F.rlike(x, F.lit(r"^\(\d+\)"))), F.lit(0)), F.lit("")).alias("direccion"),
        F.coalesce(last(F.transform(F.filter(lines(5), lambda x: ~F.contains(x, F.lit("@")) & F.rlike(x, F.lit(r"\d{6,}"))), lambda x: F.regexp_replace(x, r"\D", ""))), F.lit("")).alias("telefono"),
        F.coalesce(F.lower(last(F.filter(lines(5), lambda x: F.contains(x, F.lit("@"))))), F.lit("")).alias("email"),
        F.when(F.contains(state, F.lit("inactivo")), "inactivo").when(F.contains(state, F.lit("suspendido")), "suspendido").when(F.contains(state, F.lit("baja")), "baja").otherwise("activo").alias("estado"),
    )
    return F.when((F.size(cells) >= 4) & (licence != ""), made)


def directory_agency(r: dict[str, Column]) -> Column:
    """struct of an agency from a directory's row (nombre, web, telefono, telefono_principal, ciudad, pais, rating, resenas, fecha_scrapeo); null without a name."""
    text = lambda k: N.clean(r[k])
    made = F.struct(
        text("nombre").alias("nombre"), F.nullif(F.rtrim(F.coalesce(text("web"), F.lit("")), F.lit("/")), F.lit("")).alias("web"), P.first_present(r["telefono"], r["telefono_principal"]).alias("telefono_principal"), text("ciudad").alias("ciudad"),
        F.coalesce(text("pais"), F.lit("Argentina")).alias("pais"), P.comma_number(r["rating"]).alias("rating"), P.grouped_whole(r["resenas"]).alias("resenas"), P.dated(r["fecha_scrapeo"]).alias("ultimo_scrapeo"),
    )
    return F.when(text("nombre").isNotNull(), made)


def directory_payload(name: Column, profile_url: Column, level: Column) -> Column:
    """struct(nombre, nombre_normalizado, metadata) of a directory's agency, what was garbled noted in the metadata; null without name or profile."""
    raw = N.squeeze(name)
    notes = names.garble_note(raw)
    meta = F.to_json(F.struct(F.when(F.rlike(N.squeeze(level), F.lit("^[+-]?[0-9]+$")), N.squeeze(level).try_cast("int")).alias("nivel"), notes.alias("revision_notas")))
    made = F.struct(N.squeeze(names.regarbled(raw)).alias("nombre"), names.name_key(names.regarbled(raw)).alias("nombre_normalizado"), meta.alias("metadata"))
    return F.when(raw.isNotNull() & N.squeeze(profile_url).isNotNull() & (names.name_key(names.regarbled(raw)) != ""), made)
