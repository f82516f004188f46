"""Canonical URLs, identity hashes and the parts of URLs. Native expressions; null counts as empty text unless said."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import let

#: Query parameters that only track visits, besides utm_*; the shorter list is the staging key's.
TRACKING = ("fbclid", "gclid", "wbraid", "gbraid", "mc_cid", "mc_eid")
STAGING_TRACKING = ("fbclid", "gclid", "wbraid", "gbraid")


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def unquoted(x: Column) -> Column:
    """Percent-decoded as UTF-8; plus signs and lone percent signs stay."""
    safe = F.replace(F.regexp_replace(x, "%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))
    return F.coalesce(F.try_url_decode(safe), x)


def quoted(x: Column) -> Column:
    """Percent-encoded for a query: all but ASCII letters, digits and _.-~; spaces as plus signs."""
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _parts(url: Column, of) -> Column:
    """``of`` struct(netloc, path, query) of a decoded URL; a missing scheme is supplied, parameters of the last path segment are cut."""
    raw = unquoted(stripped(F.coalesce(url, F.lit(""))))
    rest = F.regexp_replace(F.when(F.rlike(raw, F.lit("(?i)^https?://")), F.regexp_replace(raw, "^[^:]*://", "")).otherwise(F.ltrim(raw, F.lit("/"))), r"[\t\r\n]", "")
    cut = lambda r: F.struct(
        F.regexp_extract(r, r"^([^/?#]*)", 1).alias("netloc"),
        F.regexp_replace(F.regexp_extract(r, r"(?s)^[^/?#]*([^?#]*)", 1), "(?s);[^/]*$", "").alias("path"),
        F.regexp_extract(r, r"(?s)^[^?#]*\?([^#]*)", 1).alias("query"),
    )
    return let(let(rest, cut), of)


def canonical(url: Column, lower_values: bool = True) -> Column:
    """host/path?sorted query without tracking, '' for null or blank.

    The URL is percent-decoded, and its path and query once more. The identity key (``lower_values``) encodes its query again and
    has lower-case values; the staging key leaves values as they are, knows fewer tracking names and keeps a path without host.
    """

    def of(p: Column) -> Column:
        host = F.regexp_replace(F.lower(stripped(F.substring_index(F.substring_index(p["netloc"], "@", -1), ":", 1))), r"^www\.", "")
        path = F.lower(F.rtrim(stripped(F.regexp_replace(unquoted(p["path"]), "/+", "/")), F.lit("/")))
        if lower_values:
            path = F.when(p["netloc"] != "", path).otherwise("")
        plain = lambda s: stripped(unquoted(F.translate(s, "+", " ")))
        items = F.filter(F.split(p["query"], "&"), lambda i: F.rlike(i, F.lit("(?s)^[^=]*=.")))
        pairs = F.transform(items, lambda i: F.struct(F.lower(plain(F.substring_index(i, "=", 1))).alias("k"), plain(F.substr(i, F.instr(i, "=") + 1)).alias("v")))
        names = TRACKING if lower_values else STAGING_TRACKING
        kept = F.filter(pairs, lambda i: ~i["k"].isin(*names) & ~i["k"].startswith("utm_") & ((i["k"] != "") if lower_values else F.lit(True)))
        if lower_values:
            kept = F.transform(kept, lambda i: F.struct(i["k"].alias("k"), F.lower(i["v"]).alias("v")))
        shown = quoted if lower_values else (lambda x: x)
        query = F.array_join(F.transform(F.array_sort(kept), lambda i: F.concat(shown(i["k"]), F.lit("="), shown(i["v"]))), "&")
        whole = let(query, lambda q: F.concat(host, path, F.when(q != "", F.concat(F.lit("?"), q)).otherwise("")))
        return F.rtrim(whole, F.lit("/")) if lower_values else whole

    return F.when(stripped(F.coalesce(url, F.lit(""))) == "", "").otherwise(_parts(url, of))


def host_key(url: Column) -> Column:
    """The host of the canonical URL."""
    return F.regexp_extract(canonical(url), "^([^/?]*)", 1)


def external_key(external_id: Column) -> Column:
    """An external id in lower case without white space; '' for null."""
    return F.lower(F.regexp_replace(F.coalesce(external_id, F.lit("")), r"(?U)\s+", ""))


def identity_hash(agency: Column, external_id: Column, url: Column) -> Column:
    """First 32 hexadecimal digits of SHA-256 over agency and canonical URL, else external id, else neither."""
    agency = F.coalesce(agency.cast("string"), F.lit(""))
    own = external_key(external_id)
    what = let(
        canonical(url),
        lambda key: F.when(key != "", F.concat(agency, F.lit("|url|"), key)).when(own != "", F.concat(agency, F.lit("|id_externo|"), own)).otherwise(F.concat(agency, F.lit("|sin_identidad|"))),
    )
    return F.left(F.sha2(what, 256), F.lit(32))


def netloc(url: Column) -> Column:
    """Host with user and port as written, lower case, without the letters w and dots at its start."""
    return F.regexp_replace(F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), "^[w.]+", "")


def site_base(url: Column) -> Column:
    """Scheme and host; null if there is no scheme or host."""
    return F.nullif(F.regexp_extract(F.coalesce(url, F.lit("")), "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)", 1), F.lit(""))


def absolute(raw: Column, base: Column) -> Column:
    """A link as found in a page: absolute, scheme-relative, rooted, query-only or relative to the base's folder; null for anchors and other schemes.

    Dot segments are left as they are.
    """
    text = stripped(F.coalesce(raw, F.lit("")))
    folder = F.regexp_replace(F.regexp_extract(base, "^([^?#]*)", 1), "(?<=[^/:])/[^/]*$", "/")
    folder = F.when(F.rlike(folder, F.lit("^[a-zA-Z]+://[^/]+$")), F.concat(folder, F.lit("/"))).otherwise(folder)
    return (
        F.when((text == "") | F.rlike(text, F.lit("^(?:#|mailto:|tel:|whatsapp:|javascript:)")), None)
        .when(text.startswith("//"), F.concat(F.lit("https:"), text))
        .when(F.rlike(text, F.lit("^[a-zA-Z][a-zA-Z0-9+.-]*:")), text)
        .when(text.startswith("/"), F.concat(site_base(base), text))
        .when(text.startswith("?"), F.concat(F.regexp_extract(base, "^([^?#]*)", 1), text))
        .otherwise(F.concat(folder, text))
    )


def page_url(url: Column, page: Column, parameter: str = "pagina") -> Column:
    """The URL of a numbered page: the parameter replaced where it stands, else added."""
    n = page.cast("string")
    base = F.coalesce(url, F.lit(""))
    has = F.rlike(base, F.lit(f"[?&]{parameter}=[0-9]+"))
    swapped = F.concat(F.regexp_extract(base, rf"(?s)^(.*?[?&]{parameter}=)[0-9]+", 1), n, F.regexp_extract(base, rf"(?s)^.*?[?&]{parameter}=[0-9]+(.*)$", 1))
    return F.when(has, swapped).otherwise(F.concat(base, F.when(F.contains(base, F.lit("?")), "&").otherwise("?"), F.lit(f"{parameter}="), n))


def unwrapped(url: Column) -> Column:
    """The target of a redirecting /url?q= link, else the URL; without query and fragment. Null for blank."""
    base = F.coalesce(url, F.lit(""))
    target = unquoted(F.regexp_extract(base, r"/url\?(?:[^#]*&)?q=([^&#]*)", 1))
    return F.nullif(F.regexp_extract(F.when(F.contains(base, F.lit("/url?")) & (target != ""), target).otherwise(base), "^([^?#]*)", 1), F.lit(""))


def operation_of_path(url: Column) -> Column:
    """Operation that a detail page's folder names (/venta/item.asp and the like); null if none does."""
    folder = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)/(venta|ventas|alquiler|temporario|alquiler[-_]temporario)/(?:item|ver|ampliar|ficha|detalle)\.aspx?\b", 1))
    return F.when(folder.isin("venta", "ventas"), "venta").when(folder == "alquiler", "alquiler").when(folder != "", "alquiler_temporario")


def operation_of_url(url: Column) -> Column:
    """alquiler if the URL speaks of rent, else venta."""
    return F.when(F.rlike(F.lower(F.coalesce(url, F.lit(""))), F.lit("alquiler|rent")), "alquiler").otherwise("venta")
