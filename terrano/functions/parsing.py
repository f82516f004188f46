"""Lenient readers of captured values, JSON objects, dates and issues. Native expressions; what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from terrano.functions.normalize import clean, let, squeeze

#: Words for yes and no.
YES, NO = ("true", "t", "1", "yes", "y", "si", "sí"), ("false", "f", "0", "no", "n")
#: Other names of currencies.
DOLLAR_NAMES, PESO_NAMES = ("U$S", "US$", "DOLAR", "DOLARES", "DÓLAR", "DÓLARES"), ("$", "PESO", "PESOS")


def int32(x: Column) -> Column:
    """Whole numbers that fit 32 bits; null for others."""
    n = x.try_cast("long")
    return F.when(n.between(-(2**31), 2**31 - 1), n.cast("int"))


def whole(x: Column, default: int = 0) -> Column:
    """A whole number as text, or the default."""
    return F.coalesce(F.when(F.rlike(F.trim(x), F.lit(r"^[+-]?[0-9]+$")), F.trim(x).try_cast("long")), F.lit(default).cast("long"))


def comma_number(x: Column) -> Column:
    """A number with a decimal comma or point; null for empty text."""
    return F.replace(x, F.lit(","), F.lit(".")).try_cast("double")


def grouped_whole(x: Column) -> Column:
    """A whole number with points or commas between its groups."""
    plain = F.trim(F.regexp_replace(x, "[.,]", ""))
    return F.when(F.rlike(plain, F.lit(r"^[+-]?[0-9]+$")), plain.try_cast("long"))


def rating(x: Column) -> Column:
    """0 to 5 with one decimal; halves go to the even digit."""
    n = F.trim(F.replace(x, F.lit(","), F.lit("."))).try_cast("double")
    return F.when(n.between(0, 5), F.bround(n, 1))


def review_count(x: Column) -> Column:
    return F.nullif(F.regexp_replace(x, r"\D", ""), F.lit("")).try_cast("long")


def boolean(x: Column, default: bool = False) -> Column:
    """Yes or no by the usual words; the default for null and other words."""
    word = F.lower(F.trim(x))
    return F.coalesce(F.when(word.isin(*YES), True).when(word.isin(*NO), False), F.lit(default))


def dated(x: Column) -> Column:
    """Trimmed text that starts like an ISO date; null for other text."""
    return F.when(F.rlike(F.trim(x), F.lit(r"^\d{4}-\d{2}-\d{2}")), F.trim(x))


def seconds_between(start: Column, end: Column) -> Column:
    """Whole seconds, rounded; null if either is."""
    return F.round((F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1e6).cast("int")


def import_currency(x: Column) -> Column:
    """Upper case, signs and names of dollars and pesos as USD and ARS; null for blank."""
    up = F.upper(squeeze(x))
    return F.when(up.isin(*DOLLAR_NAMES), "USD").when(up.isin(*PESO_NAMES), "ARS").otherwise(up)


def truncated(x: Column, limit: int) -> Column:
    """Squeezed text, cut; null for blank."""
    return F.left(squeeze(x), F.lit(limit))


def issue(kind: str, detail: Column) -> Column:
    """struct(issue_type, issue_detail): details are cut to 200 characters."""
    return F.struct(F.lit(kind).alias("issue_type"), F.left(F.coalesce(detail.cast("string"), F.lit("")), F.lit(200)).alias("issue_detail"))


def own_type(x: Column) -> Column:
    """A listing's own type in lower case; null for blank."""
    return F.lower(squeeze(x))


def json_object(x: Column) -> Column:
    """A JSON object as VARIANT; the empty object for null, blank, broken and other JSON."""
    parsed = F.try_parse_json(x)
    return F.coalesce(F.when(F.coalesce(F.schema_of_variant(parsed).startswith("OBJECT"), F.lit(False)), parsed), F.parse_json(F.lit("{}")))


def json_entries(x: Column) -> Column:
    """map<string,string> of a JSON object's fields, each as JSON text; empty for anything else."""
    keys = lambda v: F.coalesce(F.json_object_keys(F.to_json(v)), F.array().cast("array<string>"))
    text = lambda v, k: F.to_json(F.try_variant_get(v, F.concat(F.lit("$['"), k, F.lit("']")), "variant"))
    return let(json_object(x), lambda v: F.map_from_arrays(keys(v), F.transform(keys(v), lambda k: F.coalesce(text(v, k), F.lit("null")))))


def merged_json(x: Column, more: dict[str, Column]) -> Column:
    """The object as JSON text with fields set or replaced, sorted by name; other JSON counts as the empty object."""
    new = F.create_map(*(v for k, c in sorted(more.items()) for v in (F.lit(k), F.coalesce(F.to_json(F.to_variant_object(F.array(c))), F.lit("[null]")))))
    new = F.transform_values(new, lambda _, v: F.substring(v, 2, F.length(v) - 2))
    old = F.map_filter(json_entries(x), lambda k, _: ~k.isin(*more))
    shown = F.transform(F.array_sort(F.map_entries(F.map_concat(old, new))), lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), 2, F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    return F.concat(F.lit("{"), F.array_join(shown, ","), F.lit("}"))


def without_empty(x: Column) -> Column:
    """map<string,string> of a JSON object's fields but for nulls and empty texts, lists and objects."""
    return F.map_filter(json_entries(x), lambda _, v: ~v.isin("null", '""', "[]", "{}"))


def first_present(*values: Column) -> Column:
    """The first value that is not blank, trimmed."""
    return F.coalesce(*(clean(v) for v in values))
