"""Pages of listing sites: detail links, next pages, systems, blocks, totals. Native expressions over html text, systems by Arrow; null counts as empty.

Markup is read by patterns, without a tree: anchors and attributes with quoted values, in page order.
"""

from __future__ import annotations

import re

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from terrano.functions import urls as U
from terrano.functions.normalize import let, phone
from terrano.functions.pages import attributes, text_of

#: What tells detail pages of listings, and pages that are none.
DETAIL_KEYS = ("id", "idprop", "id_prop", "prop", "propiedad", "inmueble", "codigo", "cod", "ficha", "ref", "referencia", "aviso", "ad")
DETAIL_FOLDERS = (
    "/p/", "/propiedad/", "/propiedades/", "/ad/", "/inmueble/", "/inmuebles/", "/property/", "/properties/", "/listing/", "/listings/", "/detalle/", "/detalles/", "/aviso/", "/emprendimiento/", "/portfolio/",
    "/ficha/", "/ficha-",
)
CATEGORY_WORDS = (
    "venta", "ventas", "alquiler", "alquileres", "page", "buscar", "busqueda", "search", "results", "resultados", "categoria", "category", "tipo", "type", "comprar", "rentas", "emprendimientos", "desarrollos",
)
OTHER_PAGES = (
    "contact", "contacto", "nosotros", "quienes", "quienes-somos", "about", "servicios", "tasacion", "tasaciones", "blog", "noticia", "noticias", "news", "staff", "equipo", "login", "admin", "wp-admin",
)
PORTALS = ("zonaprop", "argenprop", "properati")
FILES = (".jpg", ".jpeg", ".png", ".gif", ".webp", ".svg", ".pdf", ".doc", ".docx", ".xls", ".xlsx", ".zip", ".rar", ".css", ".js", ".ico")
CARD_PRICE = r"(?i)(u\$s|us\$|usd|ars|\$\s*\d|consultar|precio)"
CARD_OPERATION = r"(?iU)\b(venta|alquiler|comprar|renta|en venta|en alquiler)\b"
CARD_TYPE = r"(?iU)\b(casa|departamento|depto|terreno|lote|local|oficina|ph|duplex|galpon|inmueble|propiedad)\b"
CARD_SIZE = r"(?iU)(\d+)\s*(m2|m²|mts|amb|ambientes|dorm|habit|baños|banos)"
CARD_CLASS = r"(?i)(property|propiedad|inmueble|listing|aviso|card|result)"
CLICK_CALL = r"(?i)(?:location(?:\.href)?|window\.location(?:\.href)?|window\.open|openProperty|goTo|verDetalle|detalle|ficha)\s*\(?\s*['\"]([^'\"]+)['\"]"
CLICK_TEXT = r"(?i)['\"]((?:https?://|/)[^'\"]{2,160}(?:propiedad|propiedades|inmueble|detalle|ficha|ad|ref-|codigo|cod|idprop)[^'\"]*)['\"]"
NEXT_WORDS = ("siguiente", "next", ">", "›", "»", "→", "&gt;", "&raquo;", "&rsaquo;")
#: Signs of systems, in order; of blocks; of pagination and list pages.
SYSTEMS = {
    "tokko": ("tokkobroker.com", "tokkowidget", "tokko_key", "api.tokkobroker", "tokko-widget", "data-tokko", "tokko.com"),
    "wordpress": ("wp-content/", "wp-includes/", "/wp-json/", "wp-login.php"),
    "wix": ("wix.com", "_wixcidx", "static.wixstatic.com", "wixsite.com"),
    "webflow": ("webflow.com", "assets-global.website-files.com"),
    "shopify": ("cdn.shopify.com", "myshopify.com"),
    "squarespace": ("squarespace.com", "sqspcdn.com"),
    "nexo": ("nexoinmuebles.com", "nexo.com.ar"),
    "inmoweb": ("inmoweb.com.ar",),
    "properati": ("properati.com",),
    "zonaprop": ("zonaprop.com.ar",),
    "argenprop": ("argenprop.com",),
}
ROBOT_WALLS = (
    "cf-browser-verification", "cloudflare", "checking your browser", "ray id", "turnstile", "captcha", "recaptcha", "hcaptcha", "ddos-guard", "just a moment", "verifying you are human",
)
LIST_WORDS = ("propiedades", "inmuebles", "listings", "properties", "ventas", "alquileres", "venta", "alquiler", "en-venta", "en-alquiler", "catalogo", "buscar")
SCROLL_WORDS = ("infinite", "infinitescroll", "lazyload", "intersectionobserver", "loadmore", "cargar-mas")
CLICK_WORDS = ("siguiente", "next", "btn-next", "pagination", "paginacion")
PAGE_LINK = r"(?i)[?&](page|pagina|p|pg)=\d+|/page[/-]\d+"
TOTAL = r"(?i)(\d[\d\.,]{0,5})\s*(?:propiedades?|inmuebles?|resultados?|listings?)"
ANCHOR_FOLDERS = ("/propiedad", "/propiedades", "/property", "/properties", "/inmueble", "/ficha", "/detalle", "/listing", "/ad/")
A_PAGE = 12


def _any(x: Column, parts) -> Column:
    out = F.lit(False)
    for part in parts:
        out = out | F.contains(x, F.lit(part))
    return out


def same_site(a: Column, b: Column) -> Column:
    """Whether one host is the other or under it; true if either is missing."""
    x, y = U.netloc(a), U.netloc(b)
    return (x == "") | (y == "") | (x == y) | x.endswith(F.concat(F.lit("."), y)) | y.endswith(F.concat(F.lit("."), x))


def _path(url: Column) -> Column:
    return F.regexp_extract(url, "^(?:[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def blocked_detail(url: Column, base: Column) -> Column:
    """Whether a link can't be a listing's page: another scheme, a portal, another site, a file, the home page, a page of other things or of a list."""
    low, path, query = F.lower(url), F.lower(_path(url)), F.regexp_extract(url, r"\?([^#]*)", 1)
    scheme = F.lower(F.regexp_extract(url, "^([a-zA-Z][a-zA-Z0-9+.-]*):", 1))
    files = F.lit(False)
    for end in FILES:
        files = files | path.endswith(end)
    return (
        ((scheme != "") & ~scheme.isin("http", "https"))
        | _any(low, PORTALS)
        | ~same_site(url, base)
        | files
        | (path.isin("", "/") & (query == ""))
        | _any(path, OTHER_PAGES)
        | F.rlike(low, F.lit(r"(/page/|[?&]page=|[?&]pagina=|#)"))
    )


def is_detail(url: Column, base: Column) -> Column:
    """Whether a link looks like a listing's page: a telling parameter, a telling folder with more behind it, or words and a number in its path."""
    path, query = F.lower(_path(url)), F.regexp_extract(url, r"\?([^#]*)", 1)
    named = F.exists(F.split(query, "&"), lambda p: F.lower(F.substring_index(p, "=", 1)).isin(*DETAIL_KEYS) & F.rlike(p, F.lit(r"=\s*\S")))
    behind = lambda folder: F.btrim(F.substr(path, F.instr(path, folder) + len(folder)), F.lit("/"))
    out = F.when(F.coalesce(blocked_detail(url, base), F.lit(True)), False).when(named, True)
    for folder in DETAIL_FOLDERS:
        rest = behind(folder)
        first = F.substring_index(F.substring_index(F.substring_index(rest, "/", 1), "-", 1), "_", 1)
        here = F.contains(path, F.lit(folder))
        out = out.when(here & (rest == ""), False).when(here & first.isin(*CATEGORY_WORDS), False).when(here & (F.length(rest) >= 2), True)
    parts = F.filter(F.split(path, "/"), lambda p: p != "")
    joined = F.array_join(parts, " ")
    words = F.rlike(joined, F.lit("(venta|alquiler|casa|departamento|depto|terreno|lote|local|ph|inmueble|propiedad)")) & F.rlike(joined, F.lit(r"(\d{2,}|ref-|cod)"))
    return out.otherwise((F.size(parts) >= 2) & words & ~F.forall(parts, lambda p: p.isin(*CATEGORY_WORDS)))


def card_points(html: Column) -> Column:
    """Points of a card: price 2; operation, type, size, a picture and its own class 1 each. Two make a card."""
    card = F.coalesce(html, F.lit(""))
    own = F.regexp_extract(F.regexp_extract(card, r"(?s)^\s*<[^>]*>", 0), r"(?is)\sclass\s*=\s*[\"']([^\"']*)", 1)
    blob = F.concat(F.coalesce(text_of(card), F.lit("")), F.lit(" "), own)
    picture = F.rlike(card, F.lit(r"(?is)<img\b[^>]*\s(?:src|data-src|data-lazy-src|data-original)\s*="))
    one = lambda hit, n=1: F.when(hit, n).otherwise(0)
    has = lambda pattern, x=blob: F.rlike(x, F.lit(pattern))
    return one(has(CARD_PRICE), 2) + one(has(CARD_OPERATION)) + one(has(CARD_TYPE)) + one(has(CARD_SIZE)) + one(picture) + one(has(CARD_CLASS, own))


def click_urls(script: Column) -> Column:
    """Addresses in a click handler: of calls first, then other texts that look like listings'."""
    s = F.coalesce(script, F.lit(""))
    return F.concat(F.regexp_extract_all(s, F.lit(CLICK_CALL), 1), F.regexp_extract_all(s, F.lit(CLICK_TEXT), 1))


def detail_links(card: Column, base: Column) -> Column:
    """Distinct listing pages that a card leads to, by anchors, then data attributes and click handlers; empty for what is no card."""
    data = attributes(card, "[a-z][a-z0-9]*", r"data-[a-z-]*(?:href|url|link|slug|path|target)[a-z-]*")
    clicks = F.flatten(F.transform(attributes(card, "[a-z][a-z0-9]*", "onclick"), click_urls))
    raw = F.concat(attributes(card, "a", "href"), data, clicks)
    found = F.array_distinct(F.array_compact(F.transform(raw, lambda r: U.absolute(F.replace(r, F.lit("&amp;"), F.lit("&")), base))))
    return F.when(card_points(card) >= 2, F.filter(found, lambda u: is_detail(u, base))).otherwise(F.array().cast("array<string>"))


def anchors(html: Column) -> Column:
    """array<struct<tag,href,text>> of the links with an address, in page order."""
    whole = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<a\b[^>]*\shref\s*=[^>]*>.*?</a\s*>"), 0)
    href = lambda a: F.trim(F.get(attributes(a, "a", "href"), F.lit(0)))
    made = F.transform(whole, lambda a: F.struct(F.regexp_extract(a, r"(?s)^<[^>]*>", 0).alias("tag"), href(a).alias("href"), F.coalesce(text_of(a), F.lit("")).alias("text")))
    return F.filter(made, lambda a: a["href"].isNotNull())


def next_page(html: Column, current: Column) -> Column:
    """The next page's address: a link marked next, one whose text says so, one of class next; null if there is none."""

    def of(all_: Column) -> Column:
        usable = F.filter(all_, lambda a: (a["href"] != "") & ~a["href"].isin("#", "javascript:void(0)") & (a["href"] != current))
        by = lambda rule: F.get(F.filter(usable, rule), F.lit(0))["href"]
        marked = by(lambda a: F.rlike(a["tag"], F.lit(r"(?i)\srel\s*=\s*[\"']next[\"']")))
        said = by(lambda a: F.lower(F.trim(a["text"])).isin(*NEXT_WORDS))
        named = by(lambda a: F.rlike(a["tag"], F.lit(r"(?i)\sclass\s*=\s*[\"'][^\"']*next")))
        return let(F.coalesce(marked, said, named), lambda h: F.when(h.startswith("http"), h).otherwise(U.absolute(h, current)))

    return let(anchors(html), of)


def detail_anchor_count(html: Column) -> Column:
    """How many links lead to folders of listings."""
    return F.size(F.filter(attributes(html, "a", "href"), lambda h: _any(F.lower(h), ANCHOR_FOLDERS))).cast("long")


def _lowered(texts: pa.Array, most: int) -> pa.Array:
    """The first ``most`` characters in lower case; bytes that are no UTF-8 are replaced."""
    try:
        return pc.utf8_lower(pc.replace_substring(pc.utf8_slice_codeunits(texts, 0, most), "İ", "i\u0307"))
    except pa.ArrowInvalid:
        return pa.array([None if x is None else x.decode("utf-8", "replace")[:most].lower() for x in texts.cast(pa.binary()).to_pylist()], pa.string())


def _systems_of(texts: pa.Array, most: int = 2**31 - 1) -> pa.Array:
    """Each text's first system's place in the list, by its first ``most`` characters; null if there is none. Equal texts of a batch are read once."""
    coded = texts.dictionary_encode()
    low = _lowered(coded.dictionary, most)
    signed = pc.match_substring_regex(low, "|".join(re.escape(s) for signs in SYSTEMS.values() for s in signs))
    places = [next(n for n, signs in enumerate(SYSTEMS.values()) if any(s in t for s in signs)) if hit else None for t, hit in ((low[i].as_py() if hit else "", hit) for i, hit in enumerate(signed.to_pylist()))]
    return pa.array(places, pa.int32()).take(coded.indices)


def system(html: Column, url: Column) -> Column:
    """The system whose sign stands first in the list, in the page's first 60,000 characters or its address; else custom.

    All signs are sought in one pass over a long page, by Arrow.
    """

    @F.arrow_udf("string")
    def of(page: pa.Array, address: pa.Array) -> pa.Array:
        first = pc.min_element_wise(_systems_of(page, 60_000), _systems_of(address))
        return pa.array([*SYSTEMS, "custom"]).take(pc.fill_null(first, len(SYSTEMS)))

    return of(F.when(F.octet_length(html) > 240_000, F.left(html, F.lit(60_000))).otherwise(html), url)  # whatever four bytes a character


def robot_wall(html: Column, status: Column) -> Column:
    """Whether a response keeps robots out: by its status, or a sign in the page's first 5,000 characters."""
    return F.coalesce(status.isin(403, 503, 429), F.lit(False)) | _any(F.lower(F.left(F.coalesce(html, F.lit("")), F.lit(5_000))), ROBOT_WALLS)


def block_reason(status: Column, html: Column, cards: Column, signals: tuple[str, ...]) -> Column:
    """Why a response counts as blocked, by status, then by signals in its visible text, then by a captcha without cards; null if it does not."""
    text = F.lower(F.coalesce(text_of(F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<noscript\b.*?</noscript\s*>", " ")), F.lit("")))
    out = F.when(status == 403, "HTTP 403 Forbidden").when(status == 429, "HTTP 429 Too Many Requests").when(status >= 500, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(" Server Error")))
    for signal in signals:
        out = out.when(F.contains(text, F.lit(signal)), f"Texto de bloqueo detectado: '{signal}'")
    return out.when(F.contains(text, F.lit("captcha")) & (cards == 0), "Captcha activo sin cards visibles")


def retryable_block(reason: Column, codes: tuple[int, ...] = (429, 500, 502, 503, 520, 521, 522, 523, 524)) -> Column:
    """Whether a block may pass: rate limits and server errors; null does not."""
    return _any(F.coalesce(reason, F.lit("")), [f"HTTP {c}" for c in codes])


def pagination(html: Column, url: Column) -> Column:
    """How a list goes on: scroll_infinito, url, click; desconocido for an empty page. The scroll words are sought as written in lower case."""
    page = F.coalesce(html, F.lit(""))
    linked = F.exists(attributes(html, "a", "href"), lambda h: F.rlike(h, F.lit(PAGE_LINK))) | F.rlike(F.coalesce(url, F.lit("")), F.lit(PAGE_LINK))
    return F.when(page == "", "desconocido").when(_any(page, SCROLL_WORDS), "scroll_infinito").when(linked, "url").when(_any(F.lower(page), CLICK_WORDS), "click").otherwise("url")


def listing_total(html: Column) -> Column:
    """struct(total, pages): the first total from 1 to 100,000 that the text states, and its pages of twelve; nulls if there is none."""
    found = F.regexp_extract_all(F.coalesce(text_of(html), F.lit("")), F.lit(TOTAL), 1)
    numbers = F.filter(F.transform(found, lambda m: F.regexp_replace(m, "[.,]", "").try_cast("long")), lambda n: n.between(1, 100_000))
    return let(F.get(numbers, F.lit(0)), lambda n: F.struct(n.alias("total"), F.ceil(n / A_PAGE).cast("long").alias("pages")))


def list_page(html: Column, base: Column) -> Column:
    """The site's page of listings by its links: of menus, headers and lists first, then any short one; null if none is telling."""
    site = U.site_base(base)
    parts = F.slice(F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<(nav|header|ul)\b.*?</\1\s*>"), 0), F.lit(1), F.lit(6))
    full = lambda h: U.absolute(h, F.concat(site, F.lit("/")))
    inside = lambda u: F.coalesce(F.contains(u, site), F.lit(False))
    menus = F.flatten(F.transform(parts, anchors))
    first = F.filter(F.transform(F.filter(menus, lambda a: _any(F.lower(a["href"]), LIST_WORDS) | _any(F.lower(a["text"]), LIST_WORDS)), lambda a: full(a["href"])), inside)
    rest = F.filter(F.transform(F.filter(anchors(html), lambda a: _any(F.lower(a["href"]), LIST_WORDS)), lambda a: full(a["href"])), lambda u: inside(u) & (F.length(u) < 150))
    return F.coalesce(F.get(first, F.lit(0)), F.get(rest, F.lit(0)))


def site_key(html: Column) -> Column:
    """Whether the page carries a listing service's key: its digest only, since the key is a secret; null if there is none."""
    by_id = F.regexp_extract(html, r"(?i)tokko[^'\"]{0,30}['\"]([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})['\"]", 1)
    by_name = F.regexp_extract(html, r"(?i)(?:tokko[_\-]?key|api[_\-]?key|apiKey)\s*[=:'\"]+\s*['\"]?([a-zA-Z0-9\-_]{20,50})['\"]?", 1)
    by_script = F.regexp_extract(F.get(F.filter(attributes(html, "script", "src"), lambda s: F.contains(F.lower(s), F.lit("tokko"))), F.lit(0)), "[?&]key=([a-zA-Z0-9\\-_]{20,50})", 1)
    return F.sha2(F.coalesce(*(F.nullif(k, F.lit("")) for k in (by_id, by_name, by_script))), 256)


#: An address; what stands in addresses that are samples.
MAIL = r"[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}"
SAMPLE_MAILS = ("example@", "noreply@", "no-reply@", "test@", "email@", "correo@", "info@info", "admin@admin")


def _good_emails(all_: Column) -> Column:
    return F.filter(all_, lambda e: F.rlike(e, F.lit(f"^{MAIL}$")) & ~_any(e, SAMPLE_MAILS))


def _written_emails(html: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text_of(html), F.lit("")), F.lit(MAIL), 0), F.lower)


def mentioned_emails(html: Column) -> Column:
    """Addresses of the text in its order, each as often as it stands there. Sample addresses are left out."""
    return _good_emails(_written_emails(html))


def contact_emails(html: Column, domain: Column) -> Column:
    """Distinct addresses: of mail links, then of the text; those of the site's own domain before others. Sample addresses are left out."""
    linked = F.transform(F.filter(attributes(html, "a", "href"), lambda h: h.startswith("mailto:")), lambda h: F.lower(F.trim(F.substring_index(F.replace(h, F.lit("mailto:"), F.lit("")), "?", 1))))
    own = lambda e: F.coalesce((domain != "") & F.contains(e, domain), F.lit(False))
    return let(F.array_distinct(_good_emails(F.concat(linked, _written_emails(html)))), lambda all_: F.concat(F.filter(all_, own), F.filter(all_, lambda e: ~own(e))))


def contact_phones(html: Column) -> Column:
    """Distinct phone numbers: of phone links, then of the text."""
    pattern = r"(?:\+54|0054|011|0\d{2,4})[\s\-]?(?:15[\s\-]?)?\d{4}[\s\-]?\d{4}|\+54\s?9?\s?\d{2,4}[\s\-]?\d{4}[\s\-]?\d{4}|\(\d{2,4}\)\s?\d{4}[\s\-]?\d{4}"
    linked = F.transform(F.filter(attributes(html, "a", "href"), lambda h: h.startswith("tel:")), lambda h: F.trim(F.replace(h, F.lit("tel:"), F.lit(""))))
    return F.array_distinct(F.array_compact(F.transform(F.concat(linked, F.regexp_extract_all(F.coalesce(text_of(html), F.lit("")), F.lit(pattern), 0)), phone)))
