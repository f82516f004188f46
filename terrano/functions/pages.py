"""Listing pages: class tokens, embedded data, detail fields. Native expressions over the whole html; null counts as empty."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, let, property_type, squeeze

#: Class suffixes with a type of their own; words of decorative images.
CLASS_TYPES = {"local-comercial": "local", "departamento": "departamento", "casa": "casa", "oficina": "oficina", "terreno": "terreno", "cochera": "cochera"}
DECORATION = "logo|icon|sprite|blank|placeholder|avatar"


def attributes(html: Column, tag: str, name: str) -> Column:
    """Values of one attribute of all tags of a name (a pattern), in page order; quoted values only."""
    value = rf"(?is)<(?:{tag})\b[^>]*?\s{name}\s*=\s*(?:\"([^\"]*)\"|'([^']*)')"
    both = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(value), 1), F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(value), 2)
    return F.zip_with(*both, lambda a, b: F.when(F.coalesce(a, F.lit("")) != "", a).otherwise(F.coalesce(b, F.lit(""))))


def class_tokens(html: Column) -> Column:
    """All class names, in page order, repeats included."""
    return F.filter(F.flatten(F.transform(attributes(html, "[a-z][a-z0-9]*", "class"), lambda c: F.split(c, r"\s+"))), lambda t: t != "")


def type_of_classes(html: Column) -> Column:
    """Property type by the first class tipo-X that is known or property_types-X; null if there is none."""

    def named(token: Column) -> Column:
        word = F.trim(F.regexp_replace(token, "tipo-|property_types-", ""))
        kind = property_type(F.regexp_replace(word, "[-_]", " "))
        for suffix, to in CLASS_TYPES.items():
            kind = F.when(word == suffix, to).otherwise(kind)
        return F.when(token.startswith("property_types-"), kind).when(token.startswith("tipo-"), F.nullif(kind, F.lit("otro")))

    return F.get(F.filter(F.transform(class_tokens(html), named), lambda t: t.isNotNull()), F.lit(0))


def operation_of_classes(html: Column) -> Column:
    """venta or alquiler by the first class operacion-X; null if there is none."""
    return F.regexp_extract(F.get(F.filter(class_tokens(html), lambda t: F.rlike(t, F.lit("^operacion-(venta|alquiler)$"))), F.lit(0)), "^operacion-(.*)$", 1)


def text_of(markup: Column) -> Column:
    """Text of a fragment: tags as spaces, common references decoded, white space squeezed; null if nothing is left."""
    out = F.regexp_replace(F.regexp_replace(markup, r"(?is)<(script|style)\b.*?</\1\s*>", " "), "(?s)<[^>]*>", " ")
    for reference, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(reference), F.lit(char))
    return squeeze(out)


def embedded(html: Column, field: str) -> Column:
    """The first value of a JSON path in the page's JSON-LD blocks (the first item of lists); null if none has it."""
    blocks = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<script\b[^>]*application/ld\+json[^>]*>(.*?)</script\s*>"), 1)
    found = F.transform(blocks, lambda b: clean(F.coalesce(F.get_json_object(b, f"$.{field}"), F.get_json_object(b, f"$[0].{field}"))))
    return F.get(F.filter(found, lambda v: v.isNotNull()), F.lit(0))


def photos(html: Column) -> Column:
    """Image sources in page order: jpg, jpeg, png or webp, none that decorate, no inline data."""
    keep = lambda s: ~F.rlike(F.lower(s), F.lit(DECORATION)) & ~s.startswith("data:") & F.rlike(s, F.lit(r"(?i)\.(jpg|jpeg|png|webp)"))
    return F.filter(attributes(html, "img", "src"), keep)


def detail(html: Column) -> Column:
    """struct(title, price, operation, type, description, n_photos) of a listing's page.

    Embedded data before the page's own markup; null where the page says nothing.
    """
    first = lambda tag: text_of(F.regexp_extract(F.coalesce(html, F.lit("")), rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>", 1))
    paragraphs = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(r"(?is)<p\b[^>]*>(.*?)</p\s*>"), 1)
    long = F.get(F.filter(F.transform(paragraphs, text_of), lambda p: F.length(p) > 80), F.lit(0))
    price = F.nullif(F.regexp_extract(F.coalesce(html, F.lit("")), r"(?i)(?:USD|U\$S|US\$|ARS|\$)\s*[0-9][0-9.,]*", 0), F.lit(""))
    words = lambda text: F.struct(
        F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(venta|alquiler temporario|alquiler)\b", 1)), F.lit("")).alias("operation"),
        F.nullif(F.lower(F.regexp_extract(text, r"(?i)\b(casa|departamento|terreno|lote|local|oficina|cochera|ph|duplex|quinta|galpon)\b", 1)), F.lit("")).alias("type"),
    )
    named = let(text_of(html), words)
    return F.struct(
        F.coalesce(embedded(html, "name"), first("h1"), first("title")).alias("title"),
        F.coalesce(embedded(html, "offers.price"), embedded(html, "offers[0].price"), price).alias("price"),
        F.coalesce(operation_of_classes(html), named["operation"]).alias("operation"),
        F.coalesce(type_of_classes(html), named["type"]).alias("type"),
        long.alias("description"),
        F.size(photos(html)).cast("long").alias("n_photos"),
    )
