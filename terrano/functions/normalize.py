"""Column functions that clean and classify captured values. Native expressions only; null in, null out unless said."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

#: Canonical operations, and the words for them in captured listings.
OPERATIONS = ("venta", "alquiler", "alquiler_temporario", "consultar", "venta_y_alquiler")
OPERATION_WORDS = {
    "venta": ("venta", "sale", "sell", "compra", "en venta", "for sale"),
    "alquiler": ("alquiler", "alq", "rent", "rental", "arrendamiento", "locacion", "locación", "en alquiler", "for rent"),
    "alquiler_temporario": ("temporario", "temporal", "temporaria", "alquiler temporario", "alquiler temporal", "vacation", "turistico", "turístico", "por dia", "por día", "por semana", "short term"),
}
IMPORT_OPERATION_WORDS = {
    "venta": ("venta", "en venta", "sale", "for sale"),
    "alquiler": ("alquiler", "en alquiler", "alq", "rent", "for rent"),
    "alquiler_temporario": ("temporario", "temporal", "temporaria", "alquiler temporario", "alquiler temporal", "por dia", "por día", "por semana", "short term"),
}
SALE_WORDS, RENT_WORDS = "venta|sale|sell|compra", "alquiler|rent"
#: How captured prices and areas are written. A sign needs a letter or digit behind it to tell of dollars.
DOLLARS = r"(?U)\b(?:USD|US\$|U\$S|DÓLAR|DOLAR)\b"
PESOS = r"(?U)\b(?:ARS|PESO|PESOS)\b|\$"
GROUPED_NUMBER, PLAIN_NUMBER = r"[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?", "[0-9]+"
AREA = r"([0-9]{1,4})\s*(?:m2|m²|mts2|metros cuadrados)(?![\p{L}\p{N}_])"
#: Secrets in log texts and what replaces them, in order.
SECRETS = (
    (r"(://)[^@/\s]+(@)", "$1<redacted>$2"),
    (r"(?i)(authorization\s*:\s*bearer\s+)\S+", "$1<redacted>"),
    (r"eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]+", "<redacted_jwt>"),
    (r"sk-[A-Za-z0-9]{8,}", "<redacted_token>"),
    (r"(?i)([?&](?:apikey|api_key|access_token|token|password|passwd|key|secret)=)[^&\s#]+", "$1<redacted>"),
    (r"(?i)\b(service_role|api[_-]?key|password|passwd|secret|token)\b\s*[=:]\s*\S+", "$1=<redacted>"),
)
#: Parts of error texts; 429 passes, other client errors do not.
LASTING_ERRORS = ("400", "401", "403", "404", "409", "422")
PASSING_ERRORS = (
    "500", "502", "503", "504", "timeout", "timed out", "connection reset", "connectionreset", "max retries", "remotedisconnected", "connection aborted", "temporarily unavailable", "10054", "read timed out",
)
TYPE_WORDS = {
    "departamento": "monoambiente|semipiso|ph|departamento|depto|apt|flat|piso",
    "casa": "quinta|chalet|duplex|dúplex|triplex|tríplex|casa",
    "terreno": "terreno|loteo|lote|parcela|solar",
    "local": "negocio|local",
    "oficina": "oficina|office",
    "cochera": "cochera|garage|garaje",
    "galpon": "galp[oó]n",
}
#: Latin letters with one mark and without; combining marks are dropped besides. Letters without a decomposition (ø, ł, ß) stay.
ACCENTED = "áéíóúüñàèìòùâêîôûäëïöçãõåýÿāăąćĉċčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżžÁÉÍÓÚÜÑÀÈÌÒÙÂÊÎÔÛÄËÏÖÇÃÕÅÝ"
PLAIN = "aeiouunaeiouaeiouaeiocaoayyaaaccccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzzAEIOUUNAEIOUAEIOUAEIOCAOAY"


def let(value: Column, of: Callable[[Column], Column]) -> Column:
    """``of(value)`` with the value computed once, however often ``of`` uses it."""
    return F.transform(F.array(value), of)[0]


def clean(x: Column) -> Column:
    """White space stripped, of every kind; null if nothing is left."""
    return F.nullif(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""), F.lit(""))


def squeeze(x: Column) -> Column:
    """Inner white space as single spaces, stripped; null if nothing is left."""
    return clean(F.regexp_replace(x, r"(?U)\s+", " "))


def unaccented(x: Column) -> Column:
    """Latin letters without marks; combining marks dropped."""
    return F.regexp_replace(F.translate(x, ACCENTED, PLAIN), "[\u0300-\u036f]", "")


def search_key(x: Column) -> Column:
    """Lower case, no accents, everything but letters and digits as single spaces."""
    return F.trim(F.regexp_replace(unaccented(F.lower(x)), r"[^\p{L}\p{N}]+", " "))


def matches_all(haystack: Column, query: str) -> Column:
    """Whether every token of the query stands in the haystack, both as search keys; an empty query fits all."""
    key = search_key(haystack)
    found = F.lit(True)
    plain = str.maketrans(ACCENTED, PLAIN)
    for token in "".join(c if c.isalnum() else " " for c in query.lower().translate(plain)).split():
        found = found & F.contains(key, F.lit(token))
    return found


def locale_number(x: Column) -> Column:
    """1.234,5 or 1234.5 as a double; null if it is neither."""
    t = clean(x)
    return F.when(F.contains(t, F.lit(",")), F.replace(F.replace(t, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).otherwise(t).try_cast("double")


def _worded(key: Column, words: dict[str, tuple[str, ...]]) -> Column:
    known = F.when(key.isin(*OPERATIONS), key)
    for to, names in words.items():
        known = known.when(key.isin(*names), to)
    return known


def operation(x: Column) -> Column:
    """Canonical operation; consultar for null, blank and unknown values."""

    def named(key: Column) -> Column:
        both = F.rlike(key, F.lit(SALE_WORDS)) & F.rlike(key, F.lit(RENT_WORDS))
        return F.coalesce(_worded(key, OPERATION_WORDS).when(both, "venta_y_alquiler"), F.lit("consultar"))

    return let(F.lower(squeeze(x)), named)


def imported_operation(x: Column) -> Column:
    """Canonical operation of an import; null for null, blank and unknown values."""
    return let(F.lower(squeeze(x)), lambda key: _worded(key, IMPORT_OPERATION_WORDS))


def operation_in_text(x: Column) -> Column:
    """alquiler if a text speaks of rent, else venta if of sale; null if of neither."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(F.contains(low, F.lit("alquiler")), "alquiler").when(F.contains(low, F.lit("venta")), "venta")


def display_operation(x: Column) -> Column:
    """Operation as the search page shows it: the first rule that fits decides."""
    key = unaccented(F.lower(F.trim(F.coalesce(x, F.lit("")))))
    return (
        F.when(F.contains(key, F.lit("venta_y_alquiler")) | (key == "venta y alquiler"), "venta_y_alquiler")
        .when(F.contains(key, F.lit("alquiler")), "alquiler")
        .when(F.contains(key, F.lit("tempor")), "temporario")
        .when(F.contains(key, F.lit("inver")), "inversion")
        .when(F.contains(key, F.lit("consultar")), "consultar")
        .when(F.contains(key, F.lit("venta")), "venta")
        .otherwise("consultar")
    )


def property_type(x: Column) -> Column:
    """Type by the first group of words that occurs; otro if none does."""
    text = F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), r"[^a-z0-9áéíóúüñ\s]", " ")
    out = None
    for kind, words in TYPE_WORDS.items():
        hit = F.rlike(text, F.lit(f"(^|[^a-z0-9áéíóúüñ])({words})($|[^a-z0-9áéíóúüñ])"))
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("otro")


def price_amount(x: Column) -> Column:
    """Digits of the first price-like number, separators dropped; null for consultar, zero or none."""
    grouped = F.regexp_extract(x, GROUPED_NUMBER, 0)
    found = F.when(grouped != "", grouped).otherwise(F.regexp_extract(x, PLAIN_NUMBER, 0))
    amount = F.regexp_replace(found, "[.,]", "").try_cast("long")
    return F.when(~F.contains(F.upper(x), F.lit("CONSULTAR")) & (amount > 0), amount)


def price_currency(x: Column) -> Column:
    """USD before ARS; a bare dollar sign means ARS; null for consultar or none."""
    up = F.upper(x)
    return F.when(F.contains(up, F.lit("CONSULTAR")), None).when(F.rlike(up, F.lit(DOLLARS)), "USD").when(F.rlike(up, F.lit(PESOS)), "ARS")


def area_m2(x: Column) -> Column:
    """Square metres from 10 to 10000."""
    found = F.regexp_extract(F.lower(x), AREA, 1).try_cast("int")
    return F.when(found.between(10, 10000), found)


def phone(x: Column) -> Column:
    """Argentine numbers in international form; other numbers of seven digits or more as digits."""
    d = F.regexp_replace(x, "[^0-9]", "")
    n = F.length(d)
    return (
        F.when(n == 10, F.concat(F.lit("+54"), d))
        .when((n == 11) & d.startswith("0"), F.concat(F.lit("+54"), F.substr(d, F.lit(2))))
        .when((n == 12) & d.startswith("54") | (n == 13) & d.startswith("549"), F.concat(F.lit("+"), d))
        .when(n >= 7, d)
    )


def emails(x: Column) -> Column:
    """Distinct addresses in order of appearance, lower case."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(x, F.lit("")), F.lit(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"), 0), F.lower))


def redacted(x: Column, limit: int = 4000) -> Column:
    """Secrets replaced by markers, then cut to ``limit`` characters."""
    out = x
    for pattern, instead in SECRETS:
        out = F.regexp_replace(out, pattern, instead)
    return F.when(F.length(out) > limit, F.concat(F.left(out, F.lit(limit)), F.lit("...[truncated]"))).otherwise(out)


def converted(price: Column, currency: Column, to: str, rate: float) -> Column:
    """Price in the other currency, rounded half up; null unless price and rate are positive."""
    if rate <= 0:
        return F.lit(None).cast("long")
    value = F.when(currency == to, price).when(F.lit(to) == "ARS", price * rate).otherwise(price / rate)
    return F.when(price > 0, F.floor(value + 0.5))


def compact_price(price: Column, currency: Column) -> Column:
    """Short label: millions, thousands or the whole number; Consultar unless positive."""
    millions = F.regexp_replace(F.format_string("%.1f", F.floor(price / 100000 + 0.5) / 10), r"\.0$", "")
    label = (
        F.when(price >= 10_000_000, F.concat(F.floor(price / 1_000_000 + 0.5).cast("string"), F.lit("M")))
        .when(price >= 1_000_000, F.concat(F.replace(millions, F.lit("."), F.lit(",")), F.lit("M")))
        .when(price >= 100_000, F.concat(F.floor(price / 1000 + 0.5).cast("string"), F.lit("k")))
        .otherwise(F.floor(price).cast("string"))
    )
    return F.when(price > 0, F.concat(currency, F.lit(" "), label)).otherwise("Consultar")


def transient_error(x: Column) -> Column:
    """Whether an error text tells of a passing failure: 429 does, other client errors do not, then markers decide."""
    low = F.lower(F.coalesce(x, F.lit("")))
    return F.when(F.contains(low, F.lit("429")), True).when(F.rlike(low, F.lit("|".join(LASTING_ERRORS))), False).otherwise(F.rlike(low, F.lit("|".join(PASSING_ERRORS))))
