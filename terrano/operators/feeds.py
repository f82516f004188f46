"""Items of captured JSON feeds: the array that looks like listings is searched for, and fields are read by their aliases."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions import normalize as N
from terrano.session import written

#: Keys that tell an item; keys under which feeds keep their items, in order; aliases of each field, in order.
ITEM_KEYS = ("price", "precio", "address", "direccion", "bedrooms", "dormitorios", "title", "titulo", "property_type", "surface", "area")
LIST_KEYS = ("results", "data", "propiedades", "properties", "items", "content", "listings", "inmuebles")
ALIASES = {
    "url": ("url", "link", "permalink", "property_url", "propertyUrl"),
    "slug": ("slug", "id_property", "id"),
    "titulo": ("title", "titulo", "name", "address", "direccion"),
    "precio": ("price", "precio", "sale_price", "rent_price"),
    "operacion": ("operacion", "operation", "purpose"),
    "tipo": ("property_type", "tipo", "type"),
    "direccion": ("address", "direccion", "street"),
    "barrio": ("neighborhood", "barrio", "sector"),
}
NUMBERS = {"metros": ("area", "metros", "built_area", "surface", "superficie"), "dormitorios": ("bedrooms", "dormitorios", "rooms"), "banos": ("bathrooms", "banos", "baños")}


def _kind(node: Column) -> Column:
    """OBJECT, ARRAY, or the name of a scalar's type."""
    return F.regexp_extract(F.schema_of_variant(node), "^[A-Z]+", 0)


def _child(node: Column, key: str, kind: str = "string") -> Column:
    return F.try_variant_get(node, f"$['{key}']", kind)


def _telling(node: Column, key: str) -> Column:
    """A field as text; null where it is missing, null, empty, zero or false."""
    value, as_text = _child(node, key, "variant"), _child(node, key)
    kind = _kind(value)
    empty = F.when(kind == "STRING", as_text == "").when(kind == "BOOLEAN", as_text == "false").when(kind.isin("OBJECT", "ARRAY"), F.to_json(value).isin("{}", "[]")).otherwise(as_text.try_cast("double") == 0)
    return F.when(~F.coalesce(empty, as_text.isNull()), F.coalesce(as_text, F.to_json(value)))


def item_arrays(feeds: DataFrame, payload: str, id_column: str, depth: int = 4) -> DataFrame:
    """id, depth, key, items: of each payload the array of items, as JSON.

    Arrays and objects are opened level by level, ``depth`` levels below the top. An array whose first element is an object
    is one of items if that has an item's key, or if it stands under one of the keys that feeds use. The shallowest counts,
    of several on a level the one under the key that comes first in that list, then by name. Payloads that are no JSON, or
    hold no such array, give no row.
    """
    nodes = feeds.select(F.col(id_column).alias("id"), F.lit("").alias("key"), F.try_parse_json(payload).alias("node")).where(F.col("node").isNotNull())
    found, spark = [], feeds.sparkSession
    for level in range(depth + 1):
        first = F.try_variant_get("node", "$[0]", "variant")
        named = reduce(lambda a, b: a | b, (_child(first, k, "variant").isNotNull() for k in ITEM_KEYS))
        looks = (_kind(F.col("node")) == "ARRAY") & F.coalesce(_kind(first) == "OBJECT", F.lit(False)) & (named | F.col("key").isin(*LIST_KEYS))
        found.append(nodes.where(looks).select("id", F.lit(level).alias("depth"), "key", F.to_json("node").alias("items")))
        if level < depth:
            inner = nodes.where(_kind(F.col("node")).isin("OBJECT", "ARRAY") & ~looks)
            opened = spark.sql("SELECT n.id, coalesce(c.key, '') AS key, c.value AS node FROM {inner} n, LATERAL variant_explode(n.node) c", inner=inner)
            nodes = opened.where(_kind(F.col("node")).isin("OBJECT", "ARRAY"))
    every = reduce(DataFrame.unionByName, found)
    rank = F.lit(len(LIST_KEYS))
    for n, key in reversed(list(enumerate(LIST_KEYS))):
        rank = F.when(F.col("key") == key, n).otherwise(rank)
    return every.groupBy("id").agg(F.min_by(F.struct("depth", "key", "items"), F.struct("depth", rank, "key", "items")).alias("_x")).select("id", "_x.*")


def feed_items(feeds: DataFrame, payload: str, id_column: str, base: str, operation: str | None = None, depth: int = 4) -> DataFrame:
    """One row an item of the feeds' arrays, ``pos`` from 0, fields by the first alias that tells something.

    An item without address is known by its slug or id below ``base``; without any it is left out. Prices are numbers (pesos
    unless the currency says dollars) or texts. ``operation`` stands where an item tells neither sale nor rent.
    """
    arrays = written(item_arrays(feeds, payload, id_column, depth), "feeds")
    v = F.col("item")
    rows = feeds.sparkSession.sql("SELECT a.id, a.depth, c.pos, c.value AS item FROM {arrays} a, LATERAL variant_explode(try_parse_json(a.items)) c", arrays=arrays).where(_kind(v) == "OBJECT")
    by = lambda name: F.coalesce(*(_telling(v, k) for k in ALIASES[name]))
    slug = by("slug")
    url = F.coalesce(by("url"), F.concat(F.lit(f"{base}/propiedad/"), slug))
    raw, said = by("precio"), F.lower(F.coalesce(by("operacion"), F.lit(operation or "")))
    numeric = F.coalesce(*(F.when(_telling(v, k).isNotNull(), _kind(_child(v, k, "variant")).isin("BIGINT", "DOUBLE", "DECIMAL", "FLOAT")) for k in ALIASES["precio"]))
    dollars = F.coalesce(F.upper(_child(v, "currency")).isin("USD", "U$S"), F.lit(False))
    kind = N.property_type(by("tipo"))
    title = F.coalesce(by("titulo"), F.lit("Sin título"))
    number = lambda name: F.coalesce(*(F.replace(_telling(v, k), F.lit(","), F.lit(".")).try_cast("double") if name == "metros" else _telling(v, k).try_cast("int") for k in NUMBERS[name])).cast("int").alias(name)
    out = rows.select(
        "id", "depth", "pos", F.when(url.startswith("http"), url).otherwise(F.concat(F.lit(base), url)).alias("url"), title.alias("titulo"),
        F.when(numeric, raw.try_cast("double").cast("long")).otherwise(N.price_amount(raw)).alias("precio"), F.when(numeric, F.when(dollars, "USD").otherwise("ARS")).otherwise(N.price_currency(raw)).alias("moneda"),
        F.when(F.contains(said, F.lit("sale")) | F.contains(said, F.lit("venta")), "venta").when(F.contains(said, F.lit("rent")) | F.contains(said, F.lit("alquiler")), "alquiler").otherwise(F.lit(operation)).alias("operacion"),
        F.when(kind != "otro", kind).otherwise(N.property_type(title)).alias("tipo_propiedad"), by("direccion").alias("direccion"), by("barrio").alias("barrio"), *map(number, NUMBERS),
    )
    return out.where(F.col("url").isNotNull())
