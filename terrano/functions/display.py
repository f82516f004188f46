"""What the search page shows: types, states, labels, badges. Native expressions; null counts as empty text unless said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions import images as I
from terrano.functions.names import shown_text
from terrano.functions.normalize import display_operation, unaccented

#: Agencies shown by the domain of a listing; the name where none is known.
AGENCY_OF_DOMAIN = {
    "inmobiliariamendocasa.com.ar": "Mendocasa Lavalle",
    "pagliaropropiedades.com.ar": "Juan I. Pagliaro Propiedades",
    "svestudioinmobiliario.com.ar": "SV Inmobiliaria",
}
DEFAULT_AGENCY = "Agencia sin nombre"


def plain(x: Column) -> Column:
    return unaccented(F.lower(shown_text(x)))


def _first(key: Column, rules: list[tuple[str, Column]], default: str) -> Column:
    out = None
    for value, hit in rules:
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def property_type(x: Column) -> Column:
    k = plain(x)
    has = lambda p: F.contains(k, F.lit(p))
    rules = [
        ("departamento", has("depart")), ("casa", has("casa")), ("ph", (k == "ph") | has("propiedad horizontal")), ("terreno", has("terreno") | has("lote")), ("oficina", has("oficina")), ("local", has("local")),
    ]
    return _first(k, rules, "otro")


def status(x: Column) -> Column:
    k = plain(x)
    has = lambda p: F.contains(k, F.lit(p))
    missing = has("no_detect")
    rules = [
        ("pausada", has("paus")), ("reservada", has("reserv")), ("vendida", (k == "vendida") | has("vend") & ~missing), ("alquilada", has("alquil")),
        ("no_detectada_en_ultimo_scraping", missing | has("no detect")), ("desconocida", has("descon")),
    ]
    return _first(k, rules, "activa")


def currency(x: Column) -> Column:
    """ARS if the text speaks of pesos, else USD."""
    k = plain(x)
    return F.when(F.contains(k, F.lit("ars")) | F.contains(k, F.lit("pesos")), "ARS").otherwise("USD")


def migrated_state(x: Column) -> Column:
    """Old names of states by their new ones; others, and null, as they are."""
    return F.when(x == "activo", "activa").when(x == "inactivo", "desconocida").otherwise(x)


def grouped(n: Column) -> Column:
    """A number with points between thousands and a decimal comma, three decimals at most; numbers of four digits are not grouped."""
    whole = F.format_number(F.floor(F.abs(n)), 0)
    whole = F.when(F.abs(n) < 10000, F.replace(whole, F.lit(","), F.lit(""))).otherwise(F.replace(whole, F.lit(","), F.lit(".")))
    rest = F.rtrim(F.substring(F.format_string("%.3f", F.abs(n.cast("double")) - F.floor(F.abs(n))), 3, 3), F.lit("0"))
    return F.concat(F.when(n < 0, "-").otherwise(""), whole, F.when(rest != "", F.concat(F.lit(","), rest)).otherwise(""))


def price_label(price: Column, currency: Column) -> Column:
    """Currency and grouped price, or a word where there is no positive price."""
    return F.when(price > 0, F.concat(currency, F.lit(" "), grouped(price))).otherwise("Consultar precio")


def _count(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, F.lit(one)).when(n > 0, F.concat(n.cast("string"), F.lit(many)))


def specs(rooms: Column, bedrooms: Column, bathrooms: Column, garages: Column, total: Column, covered: Column) -> Column:
    """array of a card's labels: rooms, bedrooms, bathrooms, garages and areas that are known. Areas are whole numbers."""
    both = (total > 0) & (covered > 0) & (total != covered)
    area = lambda n, what: F.concat(n.cast("string"), F.lit(" m²" + what))
    return F.array_compact(
        F.array(
            F.when(rooms > 0, F.concat(rooms.cast("string"), F.lit(" amb."))), _count(bedrooms, "1 dorm.", " dorm."), _count(bathrooms, "1 baño", " baños"), _count(garages, "1 coch.", " coch."),
            F.when(both, area(total, " tot.")).when(total > 0, area(total, "")).when(covered > 0, area(covered, " cub.")), F.when(both, area(covered, " cub.")),
        )
    )


def location_label(neighbourhood: Column, city: Column, province: Column) -> Column:
    """Neighbourhood, city and province that are known, the province only if it differs from the city."""
    n, c, p = (F.nullif(x, F.lit("")) for x in (neighbourhood, city, province))
    return F.coalesce(F.nullif(F.concat_ws(", ", n, c, F.when(~p.eqNullSafe(c), p)), F.lit("")), F.lit("Argentina"))


def counter_label(found: Column, all_: Column, visible: Column) -> Column:
    base = F.when(found < all_, F.concat(grouped(found), F.lit(" de "), grouped(all_), F.lit(" propiedades"))).otherwise(F.concat(grouped(all_), F.lit(" propiedades activas")))
    return F.when(visible < found, F.concat(base, F.lit(" · "), visible.cast("string"), F.lit(" visibles"))).otherwise(base)


def date_label(x: Column) -> Column:
    """DD/MM/YYYY of an ISO date or time; null if it is none."""
    return F.date_format(F.try_to_timestamp(x), "dd/MM/yyyy")


def chat_url(phone: Column) -> Column:
    """A chat link for eight digits or more, else null."""
    digits = F.regexp_replace(F.coalesce(phone, F.lit("")), r"\D", "")
    return F.when(F.length(digits) >= 8, F.concat(F.lit("https://wa.me/"), digits))


def badges(mortgage: Column, garages: Column, amenities: Column) -> Column:
    """array of distinct badges: mortgage, garage and the first two amenities."""
    first = F.transform(F.slice(F.coalesce(amenities, F.array().cast("array<string>")), F.lit(1), F.lit(2)), shown_text)
    flags = F.array_compact(F.array(F.when(mortgage, "Apto crédito"), F.when(garages > 0, "Cochera")))
    return F.array_distinct(F.concat(flags, F.filter(first, lambda a: a != "")))


def agency_name(url: Column, joined: Column, default: str = DEFAULT_AGENCY) -> Column:
    """The agency of a listing's domain, else its joined name, else the default."""
    full = F.when(F.coalesce(url, F.lit("")).startswith("http"), url).otherwise(F.concat(F.lit("https://"), url))
    host = F.regexp_replace(F.lower(F.regexp_extract(full, "^https?://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^www\.", "")
    known = F.lit(None).cast("string")
    for domain, name in AGENCY_OF_DOMAIN.items():
        known = F.when(host == domain, name).otherwise(known)
    return F.coalesce(known, F.nullif(shown_text(joined), F.lit("")), F.lit(default))


def map_view(listings: DataFrame, agencies: DataFrame, test_hosts: tuple[str, ...] = ("localhost", "example.com")) -> DataFrame:
    """The map's view: listings that have a point and no test address, with their agency's contacts and main picture.

    ``test_hosts``: parts of addresses that only tests have; a site adds its own. A listing without URL fails the test of its address, like the rest of what is unknown.
    """
    a = agencies.select(F.col("id").alias("inmobiliaria_id"), F.col("nombre").alias("inmobiliaria_nombre"), F.col("web").alias("inmobiliaria_web"), F.col("telefono_principal").alias("inmobiliaria_telefono"), F.col("email_principal").alias("inmobiliaria_email"))
    test = F.lower("url")
    here = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    for part in test_hosts:
        here = here & ~F.contains(test, F.lit(part))
    rows = listings.where(here).join(a, "inmobiliaria_id", "left").withColumn("imagen_principal_real", I.view_main(F.col("imagenes")))
    rows = rows.withColumn("tiene_imagen_real", F.col("imagen_principal_real").isNotNull())
    return rows.withColumns({"ciudad_final": F.col("ciudad"), "provincia_final": F.col("provincia")}).withColumnsRenamed({"ciudad": "ciudad_original", "provincia": "provincia_original"})


def search_model(view: DataFrame) -> DataFrame:
    """The view's rows as the search page holds them: nulls as zeros and empty texts, names, labels and pictures made."""
    c = F.col
    zero = lambda n: F.coalesce(c(n), F.lit(0)).alias
    text = lambda n: shown_text(c(n)).alias
    pictures = I.shown(c("imagen_principal_real"), c("imagenes"))
    return view.withColumn("_images", pictures).select(
        c("id").cast("string").alias("id"),
        c("inmobiliaria_id").cast("string").alias("agencyId"),
        F.coalesce("url", F.lit("")).alias("sourceUrl"),
        F.coalesce(F.nullif(shown_text(c("titulo")), F.lit("")), F.lit("Propiedad sin título")).alias("title"),
        text("descripcion")("description"),
        zero("precio")("price"),
        currency(c("moneda")).alias("currency"),
        property_type(c("tipo_propiedad")).alias("propertyType"),
        display_operation(c("operacion")).alias("operation"),
        zero("ambientes")("rooms"), zero("dormitorios")("bedrooms"), zero("banos")("bathrooms"), zero("cocheras")("garages"),
        zero("superficie_total")("totalArea"), zero("superficie_cubierta")("coveredArea"),
        text("direccion")("address"), text("barrio")("neighborhood"), text("ciudad_final")("city"), text("provincia_final")("province"),
        F.coalesce("pais", F.lit("Argentina")).alias("country"),
        c("latitud").alias("latitude"), c("longitud").alias("longitude"),
        c("_images").alias("images"),
        ((F.size("_images") > 0) & F.coalesce("tiene_imagen_real", F.lit(True))).alias("hasRealImage"),
        agency_name(c("url"), c("inmobiliaria_nombre")).alias("agencyName"),
        status(c("estado")).alias("status"),
        F.coalesce("apto_credito", F.lit(False)).alias("mortgageEligible"),
        badges(c("apto_credito"), c("cocheras"), c("amenities")).alias("badges"),
    )


def featured(model: DataFrame) -> DataFrame:
    """Rows with the badge Destacado; all rows if there is none. Decided by one probe that stops at the first hit."""
    hit = F.array_contains("badges", "Destacado")
    return model.where(hit) if model.where(hit).limit(1).count() else model
