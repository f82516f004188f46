"""Agencies: names, sites, categories, confidence and review. Native expressions; null counts as missing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, let, squeeze, unaccented

#: Words of map pages inside names.
NAME_NOISE = (
    "ver mapa", "abierto", "cerrado", "califica", "reseña", "sin reseñas", "google", "maps", "ver sitio", "sitio web", "abrir", "nuevo", "verificado", "reclamado", "sponsored", "patrocinado", "anuncio",
)
#: Hosts that are nobody's own site.
SHARED_HOSTS = (
    "google.com", "facebook.com", "instagram.com", "twitter.com", "x.com", "youtube.com", "whatsapp.com", "gmail.com", "hotmail.com", "outlook.com", "zonaprop.com.ar", "argenprop.com",
    "mercadolibre.com.ar", "linkedin.com", "tiktok.com",
)
#: Words that tell a developer, a builder.
DEVELOPER_WORDS = ("desarrolladora", "desarrollos", "developer", "emprendimiento", "fideicomiso")
BUILDER_WORDS = ("constructora", "construccion", "contractor", "obra", "ingenieria", "arquitectura")
QUERY_BUILDER_WORDS = ("constructora", "construccion")
#: Words of names that do not tell one agency from another.
COMMON_NAME_WORDS = ("inmobiliaria", "propiedades", "bienes", "raices", "broker", "estudio", "negocios", "real", "estate", "grupo", "consultora", "inversiones")
SITE_WORDS = ("inmobiliaria", "propiedades", "real estate", "bienes raíces", "bienes raices")


def present(x: Column) -> Column:
    return F.coalesce(x, F.lit("")) != ""


def name(x: Column) -> Column:
    """A name without words of map pages, rating and trailing marks; null if under three characters remain."""
    out = squeeze(F.regexp_replace(x, r"(?iU)\b(?:" + "|".join(NAME_NOISE) + r")\b", ""))
    out = clean(F.regexp_replace(F.regexp_replace(out, r"^\d+[.,]\d+\s+", ""), "[·•|]+$", ""))
    return F.when(F.length(out) >= 3, out)


def host(web: Column) -> Column:
    """Lower-case host of an absolute URL without www; empty text if there is none."""
    return F.replace(F.regexp_extract(F.lower(F.coalesce(web, F.lit(""))), "^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("www."), F.lit(""))


def own_site(web: Column) -> Column:
    """Whether the URL can be the agency's own site."""
    return F.coalesce(F.rlike(web, F.lit(r"(?i)^https?://[^\s/$.?#].\S*$")), F.lit(False)) & let(host(web), lambda h: ~h.isin(*SHARED_HOSTS) & (F.length(h) > 3))


def valid_phone(x: Column) -> Column:
    """Whether there are 7 to 15 digits."""
    return F.length(F.regexp_replace(F.coalesce(x, F.lit("")), "[^0-9]", "")).between(7, 15)


def category(name: Column, current: Column) -> Column:
    """The current category unless it says nothing; else developer, builder or agency by the name."""
    low = unaccented(F.lower(F.coalesce(name, F.lit(""))))
    known = present(current) & ~F.lower(current).isin("inmobiliaria", "none")
    return F.when(known, current).when(F.rlike(low, F.lit("|".join(DEVELOPER_WORDS))), "desarrolladora").when(F.rlike(low, F.lit("|".join(BUILDER_WORDS))), "constructora").otherwise("inmobiliaria")


def category_of_query(query: Column) -> Column:
    """Builder if the search text speaks of building, else developer."""
    return F.when(F.rlike(F.lower(query), F.lit("|".join(QUERY_BUILDER_WORDS))), "constructora").otherwise("desarrolladora")


def place_of_query(query: Column, provinces: dict[str, str], stop_words: tuple[str, ...] = ()) -> Column:
    """struct(provincia, barrio): the first known province in the text, and what follows barrio without provinces and stop words."""
    low = F.lower(F.coalesce(query, F.lit("")))
    province = F.lit("")
    for key, label in reversed(provinces.items()):
        province = F.when(F.contains(low, F.lit(key)), label).otherwise(province)
    rest = F.regexp_extract(low, "(?s)barrio(.*)$", 1)
    for word in (*provinces, *stop_words):
        rest = F.replace(rest, F.lit(word), F.lit(""))
    return F.struct(province.alias("provincia"), F.coalesce(F.initcap(squeeze(rest)), F.lit("")).alias("barrio"))


def city_of_address(x: Column) -> Column:
    """The last comma part but the first that is not only digits (more than two other characters); empty text if none."""
    parts = F.transform(F.split(F.coalesce(x, F.lit("")), ","), lambda p: F.trim(p))
    kept = F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda p: F.length(F.trim(F.regexp_replace(p, r"\d", ""))) > 2)
    return F.coalesce(F.try_element_at(kept, F.lit(-1)), F.lit(""))


def confidence(r: dict[str, Column]) -> Column:
    """Points of an agency's fields, at most 100: nombre, web, ciudad, provincia, telefono, direccion, categoria, cms_detectado, url_listado."""
    rules = [
        (present(r["nombre"]), 15), (name(r["nombre"]).eqNullSafe(r["nombre"]), 5), (own_site(r["web"]), 15), (present(r["ciudad"]), 10), (present(r["provincia"]), 10), (valid_phone(r["telefono"]), 25),
        (present(r["direccion"]), 10), (present(r["categoria"]), 5), (present(r["cms_detectado"]), 3), (present(r["url_listado"]), 2),
    ]
    return F.least(F.lit(100), sum((F.when(c, points).otherwise(0) for c, points in rules), F.lit(0)))


def needs_review(name: Column, city: Column, points: Column) -> Column:
    """Short or numbered names, low confidence, no city."""
    n = F.coalesce(name, F.lit(""))
    return (F.length(n) < 5) | F.rlike(n, F.lit(r"\d{4,}")) | (points < 30) | ~present(city)


def problems(name: Column, phone: Column, address: Column, city: Column, province: Column, web: Column, points: Column) -> Column:
    """What a reviewer has to look at, in order."""
    n = F.trim(F.coalesce(name, F.lit("")))
    bad_name = F.when(n == "", "SIN NOMBRE").when(F.length(n) < 5, "NOMBRE MUY CORTO").when(F.rlike(n, F.lit(r"\d{4,}")), "NÚMERO EN NOMBRE")
    missing = [F.when(~present(x), label) for x, label in ((phone, "sin teléfono"), (address, "sin dirección"), (city, "sin ciudad"), (province, "sin provincia"), (web, "sin web"))]
    return F.array_compact(F.array(bad_name, *missing, F.when(F.coalesce(points, F.lit(0)) < 30, "confidence bajo")))


def site_confirmed(name: Column, url: Column, page_text: Column, phone: Column) -> Column:
    """Whether host or page text tell that the site is the agency's: words of its name, the phone's last six digits, words of the trade."""
    full = F.when(F.rlike(url, F.lit("^http")), url).otherwise(F.concat(F.lit("https://"), url))
    words = F.filter(F.split(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", ""), r"\s+"), lambda w: (F.length(w) >= 3) & ~w.isin(*COMMON_NAME_WORDS))
    text = F.lower(page_text)
    digits = F.regexp_replace(phone, r"\D", "")
    rules = [
        F.exists(words, lambda w: F.contains(host(full), w)),
        (F.trim(name) != "") & F.contains(text, F.lower(name)),
        F.exists(words, lambda w: (F.length(w) >= 4) & F.contains(text, w)),
        (F.length(digits) >= 6) & F.contains(F.regexp_replace(text, r"\D", ""), F.right(digits, F.lit(6))),
        F.rlike(text, F.lit("|".join(SITE_WORDS))),
    ]
    out = F.lit(False)
    for rule in rules:
        out = out | F.coalesce(rule, F.lit(False))
    return out


def enrichment(record: dict[str, Column], found: dict[str, Column], confirmed: Column, similar: Column) -> Column:
    """struct(confidence, estado, web, telefono, direccion) after an enrichment.

    ``record``: web, ciudad, provincia, telefono, direccion as known; ``found``: web, telefono, direccion as found. With a site of its own
    only the phone is taken, from the site; else, for known places and similar names, what is missing. A site counts if confirmed.
    """
    own = own_site(record["web"])
    searched = ~own & (present(record["ciudad"]) | present(record["provincia"])) & F.coalesce(similar, F.lit(False))
    sure = F.coalesce(confirmed, F.lit(False))
    tried = searched & present(found["web"])
    web = F.when(tried & sure & own_site(found["web"]), found["web"])
    phone = F.when((own | searched) & present(found["telefono"]) & ~present(record["telefono"]), found["telefono"])
    address = F.when(searched & present(found["direccion"]) & ~present(record["direccion"]), found["direccion"])
    site = F.when(own, 30).when(tried & ~sure, -10).when(web.isNotNull(), 40).otherwise(0)
    points = site + F.when(phone.isNotNull(), F.when(own, 20).otherwise(30)).otherwise(0) + F.when(address.isNotNull(), 20).otherwise(0)
    points = points + F.when(present(record["telefono"]) | phone.isNotNull(), 30).otherwise(0) + F.when(present(record["direccion"]) | address.isNotNull(), 20).otherwise(0)
    nothing = web.isNull() & phone.isNull() & address.isNull()
    state = F.when(web.isNotNull() & (points >= 60), "enriquecido").when(nothing, "sin_resultados_enriquecimiento").otherwise("requiere_revision_enriquecimiento")
    return F.struct(F.least(points, F.lit(100)).alias("confidence"), state.alias("estado"), web.alias("web"), phone.alias("telefono"), address.alias("direccion"))
