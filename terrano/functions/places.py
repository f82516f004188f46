"""Places told by hosts, URLs and city names; addresses that are none; titles. Native expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, let, squeeze, unaccented
from terrano.functions.urls import unquoted

#: Words of hosts, with city and province.
HOST_PLACES = (
    ("cafayate", "Cafayate", "Salta"), ("ushuaia", "Ushuaia", "Tierra del Fuego"), ("bariloche", "San Carlos de Bariloche", "Río Negro"), ("neuquen", "Neuquén", "Neuquén"),
    ("resistencia", "Resistencia", "Chaco"), ("necochea", "Necochea", "Buenos Aires"), ("olavarria", "Olavarría", "Buenos Aires"), ("chivilcoy", "Chivilcoy", "Buenos Aires"),
    ("tandil", "Tandil", "Buenos Aires"), ("formosa", "Formosa", "Formosa"), ("posadas", "Posadas", "Misiones"), ("jujuy", "San Salvador de Jujuy", "Jujuy"), ("tucuman", "San Miguel de Tucumán", "Tucumán"),
    ("salta", "Salta", "Salta"), ("mendoza", "Mendoza", "Mendoza"), ("cordoba", "Córdoba", "Córdoba"), ("lapampa", None, "La Pampa"), ("chubut", None, "Chubut"),
)
#: Phrases of URLs that tell city and province, in order.
URL_PLACES = (
    ((r"\bgeneral\s+alvear\b", r"\bmendoza\b"), "General Alvear", "Mendoza"), ((r"\blas\s+heras\b", r"\bmendoza\b"), "Las Heras", "Mendoza"), ((r"\bciudad\s+mendoza\b",), "Mendoza", "Mendoza"),
    ((r"\btandil\b",), "Tandil", "Buenos Aires"), ((r"\bsauce\s+viejo\b",), "Sauce Viejo", "Santa Fe"),
)
#: Parts of texts that are no address.
NO_ADDRESS = (
    "contacto", "oficinas", "oficina", "telefono", "teléfono", "tel ", "tel:", "cel ", "cel:", "whatsapp", "email", "mail", "www.", "http://", "https://", "inmobiliaria", "bienes raices", "bienes raíces",
    "consultar precio", "usd ", "u$s", "superficie", "expensas", "no acepta hipotecario", "acepta hipotecario", "detalles de la propiedad", "estilo a ", "matricula", "cucicba", "cmcpsi", "consultas online",
)
#: Parts of titles that come from page controls; titles of lists, files and countryside.
CONTROL_TITLES = ("mover a la izquierda", "mover a la derecha", "mover hacia arriba", "mover hacia abajo", "arrastrar", "soltar")
LIST_TITLE = (
    r"(?iU)^(?:terrenos?|casas?|departamentos?|deptos?|lotes?|locales?|oficinas?|galpones?|cocheras?|ph|monoambientes?|campos?|chalets?|duplex|propiedades?)"
    r"\s+(?:a\s+la\s+|en\s+)?(?:venta|alquiler)\s*\|"
)
FILE_TITLE = r"(?i)^[a-zA-Z]{2,4}\d{3,6}\.html?$"
SHORT_ID = r"(?i)/[a-z]{2,3}\d{3,6}\.html?\b"
RURAL_HOSTS = ("campo", "campos", "rural", "agro", "pampa", "hectarea", "hectárea", "haras", "estancia", "chacra")
RURAL_TYPES = ("campo", "chacra", "estancia", "finca", "quinta")
TITLE_TYPES = ("campo", "chacra", "estancia", "finca", "quinta", "casa", "departamento", "terreno", "local", "oficina", "cochera", "lote")


def hostname(url: Column) -> Column:
    """Lower-case host without user and port; empty text if the URL has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1))


def place_of_host(url: Column) -> Column:
    """struct(city, province) if exactly one word of the host tells a place; else null."""
    bare = F.regexp_replace(F.regexp_replace(hostname(url), r"^www\.", ""), r"\.(?:com\.ar|net\.ar|org\.ar|gob\.ar|gov\.ar|edu\.ar|com|net|org|ar)$", "")
    key = F.regexp_replace(unaccented(bare), "[^a-z0-9]+", "")

    def of(k: Column) -> Column:
        hits = F.array_compact(F.array(*(F.when(F.contains(k, F.lit(word)), F.struct(F.lit(c).cast("string").alias("city"), F.lit(p).alias("province"))) for word, c, p in HOST_PLACES)))
        return F.when((F.length(k) >= 4) & (F.size(hits) == 1), F.get(hits, F.lit(0)))

    return let(key, of)


def place_of_signals(city: Column, province: Column, *urls: Column) -> Column:
    """struct(city, province, inferred): the row's own place, or that of the first URL whose host tells one if both are missing."""
    c, p = clean(city), clean(province)
    found = F.coalesce(*(place_of_host(u) for u in urls))
    own = F.struct(c.alias("city"), p.alias("province"), F.lit(False).alias("inferred"))
    return let(found, lambda f: F.when(c.isNull() & p.isNull() & f.isNotNull(), F.struct(f["city"].alias("city"), f["province"].alias("province"), F.lit(True).alias("inferred"))).otherwise(own))


def url_words(*values: Column) -> Column:
    """Decoded URLs as words: signs and underscores as spaces, lower case."""
    parts = (F.translate(unquoted(F.translate(v, "+", " ")), "-_/", "   ") for v in values)
    return F.lower(F.coalesce(squeeze(F.concat_ws(" ", *parts)), F.lit("")))


def place_of_context(city: Column, province: Column, text: Column, fallback: tuple[str | None, str | None] = (None, None)) -> Column:
    """struct(city, province): the known place if there is either, else what the URL's words tell, else the fallback."""
    null = lambda v: F.lit(v).cast("string")
    pair = lambda c, p: F.struct(c.alias("city"), p.alias("province"))
    c, p = clean(city), clean(province)
    out = F.when(c.isNotNull() | p.isNotNull(), pair(c, p))
    for patterns, name, within in URL_PLACES:
        hit = F.lit(True)
        for pattern in patterns:
            hit = hit & F.rlike(text, F.lit(pattern))
        out = out.when(hit, pair(null(name), null(within)))
    return out.otherwise(pair(null(fallback[0]), null(fallback[1])))


def province_of_city(city: Column, provinces: dict[str, str]) -> Column:
    """The province of a city's plain name; null if it is not known."""
    table = F.create_map(*(F.lit(v) for kv in provinces.items() for v in kv))
    return F.try_element_at(table, unaccented(F.lower(F.trim(city))))


def province_in_text(x: Column, provinces: dict[str, str]) -> Column:
    """The province of the first known city, in the order of the table, that a text names."""
    low = unaccented(F.lower(x))
    return F.coalesce(*(F.when(F.contains(low, F.lit(c)), p) for c, p in provinces.items()))


def no_address_reason(x: Column, domains: bool = False) -> Column:
    """Why a text is no address: the first rule that fits; null if none does or it is blank. ``domains``: host names count too, as imports hold."""
    text = squeeze(x)

    def of(t: Column) -> Column:
        low = F.lower(t)
        words = F.lit(False)
        for part in NO_ADDRESS:
            words = words | F.contains(low, F.lit(part))
        amount = r"(?:u\$s|usd|\$|ars)"
        out = F.when(t.isNull(), None).when(words, "contaminated_address")
        if domains:
            out = out.when(F.rlike(low, F.lit(r"(?U)\b[a-z0-9-]+\.(?:com\.ar|net\.ar|org\.ar|com|net|org)\b")), "contaminated_address_domain")
        return (
            out.when(F.rlike(t, F.lit(r"(?U)[\w.%-]+@[\w.-]+\.[A-Za-z]{2,}")), "address_is_email")
            .when(F.rlike(t, F.lit(r"\+?\d[\d\s().-]{7,}\d")), "address_contains_phone")
            .when(F.rlike(low, F.lit(amount + r"\s*[\d.,]{2,}")), "address_contains_price")
            .when(F.rlike(low, F.lit(rf"^{amount}?\s*[\d.,]{{2,}}(?:\s*(?:usd|ars|pesos?))?$")), "address_is_price")
            .when((F.length(t) > 90) & (F.regexp_count(t, F.lit(r"\d+")) > 2), "address_too_long_numeric")
        )

    return let(text, of)


def address_value(x: Column, imported: bool = False) -> Column:
    """struct(value, reason): the squeezed address, or why it is none. Imports cut it to 300 characters first."""
    text = F.left(squeeze(x), F.lit(300)) if imported else squeeze(x)
    return let(text, lambda t: let(no_address_reason(t, imported), lambda r: F.struct(F.when(r.isNull(), t).alias("value"), r.alias("reason"))))


def control_title(x: Column) -> Column:
    """Whether a title comes from page controls or names a list."""
    t = F.coalesce(squeeze(x), F.lit(""))
    hit = F.rlike(t, F.lit(LIST_TITLE))
    for part in CONTROL_TITLES:
        hit = hit | F.contains(F.lower(t), F.lit(part))
    return hit


def file_title(title: Column, kind: Column, operation: Column, province: Column) -> Column:
    """A title made of type, operation and province for one that is a file's name; null for other titles."""
    low = F.lower(F.coalesce(kind, F.lit("")))
    label = F.when(low.isin(*TITLE_TYPES), F.initcap(low)).otherwise("Propiedad")
    how = F.when(F.contains(F.lower(F.coalesce(operation, F.lit("venta"))), F.lit("alquiler")), " en alquiler").otherwise(" en venta")
    within = F.trim(F.coalesce(province, F.lit("")))
    return F.when(F.rlike(F.trim(title), F.lit(FILE_TITLE)), F.concat(label, how, F.when(within != "", F.concat(F.lit(" en "), within)).otherwise("")))


def title_or_made(title: Column, kind: Column, city: Column, province: Column) -> Column:
    """The title, or one of type and place."""
    label = F.initcap(F.lower(F.trim(F.coalesce(kind, F.lit("")))))
    label = F.concat(F.upper(F.left(label, F.lit(1))), F.lower(F.substr(label, F.lit(2))))
    c, p = clean(city), clean(province)
    made = (
        F.when((label != "") & c.isNotNull(), F.concat(label, F.lit(" en "), c))
        .when((label != "") & p.isNotNull(), F.concat(label, F.lit(" en "), p))
        .when(c.isNotNull(), F.concat(F.lit("Propiedad en "), c))
        .otherwise("Propiedad sin título")
    )
    return F.coalesce(squeeze(title), made)


def rural_type(url: Column, kind: Column) -> Column:
    """campo for short-id pages of countryside hosts, unless the type is one of the countryside already; null for others."""
    host, named = hostname(url), F.lit(False)
    for part in RURAL_HOSTS:
        named = named | F.contains(host, F.lit(part))
    return F.when(F.rlike(F.coalesce(url, F.lit("")), F.lit(SHORT_ID)) & named & ~F.coalesce(kind.isin(*RURAL_TYPES), F.lit(False)), "campo")
