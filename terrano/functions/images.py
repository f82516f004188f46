"""Listing pictures: what is no picture of the property, by who asks. Lists keep their order; null counts as no list."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, let

#: Parts of addresses of logos and page decoration, of other things than rooms, of what imports skip, of what the search page skips.
BRANDING = (
    "static.tokkobroker.com/tfw/img/prop-icons", "/prop-icons", "/imgs/inmobiliaria", "inmobiliaria-", "mascara-galeria", "rounded-cds", "footer", "logo", "isotipo", "imagotipo", "favicon", "placeholder",
    "no-photo", "no_image", "no-image", "sin-imagen", "sin_imagen",
)
SURFACE = ("tour", "virtual", "facebook", "instagram", "whatsapp", "linkedin", "youtube", "menu", "boton", "btn", "mapa", "maps", "streetview")
IMPORT_SKIPS = ("placeholder", "sin-imagen", "no-image", "logo", "favicon", "facebook", "instagram", "whatsapp", "linkedin", "youtube", "menu", "boton", "btn", "mapa")
PAGE_SKIPS = (
    "static.tokkobroker.com/tfw/img/prop-icons", "/prop-icons", "/imgs/inmobiliaria", "inmobiliaria-", "mascara-galeria", "rounded-cds", "footer", "logo", "tour", "virtual", "placeholder", "no-photo",
    "no_image", "sin-imagen",
)
#: The first picture of the map view; only its first pattern minds case.
VIEW_SKIPS = ("unsplash.com", "placeholder", "no-photo", "sin-imagen", "360", "tour", "virtual")
VIEW_ICONS = "static.tokkobroker.com/tfw/img/prop-icons"
ROUND_VIEW = r"(?:^|[/_.-])360(?:[/_.-]|$)"
MOST_KEPT, MOST_IMPORTED = 60, 10


def _has(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(x, F.lit(part))
    return out


def is_branding(url: Column) -> Column:
    """Whether an address is no picture for publishing: blank, inline, a drawing, a logo, page decoration, a tour; null counts as blank."""
    low = F.lower(F.trim(F.coalesce(url, F.lit(""))))

    def of(x: Column) -> Column:
        rest = F.regexp_replace(x, "^[a-z][a-z0-9+.-]*://", "")
        path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
        path = F.when(path == "", x).otherwise(path)
        return (x == "") | x.startswith("data:") | x.startswith("blob:") | path.endswith(".svg") | path.endswith(".ico") | _has(x, BRANDING + SURFACE) | F.rlike(x, F.lit(ROUND_VIEW))

    return let(low, of)


def item_url(item: Column) -> Column:
    """The address of a picture that is a JSON string or an object with url, src, href or image, given as JSON text; null if it has none."""
    v = F.try_parse_json(item)
    fields = (F.nullif(F.try_variant_get(v, f"$.{k}", "string"), F.lit("")) for k in ("url", "src", "href", "image"))
    return clean(F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise(F.coalesce(*fields)))


def split(urls: Column, most: int = MOST_KEPT) -> Column:
    """struct(kept, discarded): distinct addresses in order; reading ends with the last that is kept."""
    distinct = F.array_distinct(F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), lambda u: F.trim(u)), lambda u: F.coalesce(u != "", F.lit(False))))

    def of(all_: Column) -> Column:
        kept = F.filter(all_, lambda u: ~is_branding(u))
        last = F.when(F.size(kept) >= most, F.array_position(all_, F.get(kept, F.lit(most - 1))).cast("int")).otherwise(F.size(all_))
        return F.struct(F.slice(kept, F.lit(1), F.lit(most)).alias("kept"), F.filter(F.slice(all_, F.lit(1), last), is_branding).alias("discarded"))

    return let(distinct, of)


def any_real(urls: Column) -> Column:
    return F.size(split(urls)["kept"]) > 0


def validated(urls: Column) -> Column:
    """The first ten addresses that validation keeps, repeats included."""
    texts = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), clean), lambda u: u.isNotNull())
    return F.slice(F.filter(texts, lambda u: ~_has(F.lower(u), IMPORT_SKIPS) & ~F.lower(u).endswith(".svg") & ~u.startswith("data:")), F.lit(1), F.lit(MOST_IMPORTED))


def imported(urls: Column) -> Column:
    """The first ten addresses that an import keeps, repeats included."""
    texts = F.filter(F.transform(F.coalesce(urls, F.array().cast("array<string>")), clean), lambda u: u.isNotNull())
    maps = lambda u: F.contains(F.lower(u), F.lit("google")) & F.contains(F.lower(u), F.lit("map"))
    return F.slice(F.filter(texts, lambda u: ~_has(F.lower(u), IMPORT_SKIPS) & ~F.lower(u).endswith(".svg") & ~maps(u)), F.lit(1), F.lit(MOST_IMPORTED))


def shown(main: Column, urls: Column) -> Column:
    """What the search page shows: the main picture and the rest, distinct, without blocked ones."""
    every = F.concat(F.array(main), F.coalesce(urls, F.array().cast("array<string>")))
    good = lambda u: F.coalesce(u != "", F.lit(False)) & ~_has(F.lower(u), PAGE_SKIPS) & ~F.rlike(F.lower(u), F.lit(ROUND_VIEW))
    return F.array_distinct(F.filter(every, good))


def view_main(urls: Column) -> Column:
    """The map view's main picture: the first one, unless it is blocked."""
    first = F.get(urls, F.lit(0))
    return F.when(~F.contains(first, F.lit(VIEW_ICONS)) & ~_has(F.lower(first), VIEW_SKIPS), first)
