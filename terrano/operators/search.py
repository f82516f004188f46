"""Filters, orders, facets and map clusters of the listing search. Filters are plain predicates, so they reach the scans."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions.normalize import matches_all

UNAVAILABLE = ("vendida", "alquilada", "no_detectada_en_ultimo_scraping")
#: Degrees of a cluster cell by the largest zoom it serves; beyond, the last.
CELLS = ((9, 0.18), (10, 0.1), (11, 0.06), (99, 0.035))


@dataclass
class Filters:
    """Search filters; None or empty ones let everything pass."""

    equal: dict[str, str] = field(default_factory=dict)
    at_least: dict[str, float] = field(default_factory=dict)
    at_most: dict[str, float] = field(default_factory=dict)
    area: tuple[float | None, float | None] = (None, None)
    with_images: bool = False
    with_coordinates: bool = False
    only_available: bool = False
    recent_days: int | None = None
    text: str = ""

    def count(self) -> int:
        """How many filters are set."""
        flags = [self.with_images, self.with_coordinates, self.only_available, self.recent_days is not None, bool(self.text)]
        return len(self.equal) + len(self.at_least) + len(self.at_most) + sum(x is not None for x in self.area) + sum(flags)


def has_coordinates(lat: str = "latitud", lon: str = "longitud") -> Column:
    return F.col(lat).isNotNull() & F.col(lon).isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)


def recent(as_of: str, days: int, at: str = "created_at") -> Column:
    return F.col(at) > F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(days))


def search(df: DataFrame, f: Filters, as_of: str) -> DataFrame:
    """All filters joined by and. Area bounds pass rows of unknown (zero) area; price bounds do not."""
    for name, value in f.equal.items():
        df = df.where(F.col(name) == value)
    for name, value in f.at_least.items():
        df = df.where(F.col(name) >= value)
    for name, value in f.at_most.items():
        df = df.where(F.col(name) <= value)
    low, high = f.area
    if low is not None:
        df = df.where((F.col("area") <= 0) | (F.col("area") >= low))
    if high is not None:
        df = df.where((F.col("area") <= 0) | (F.col("area") <= high))
    if f.with_images:
        df = df.where("n_imagenes > 0")
    if f.with_coordinates:
        df = df.where(has_coordinates())
    if f.only_available:
        df = df.where(~F.col("estado").isin(*UNAVAILABLE))
    if f.recent_days is not None:
        df = df.where(recent(as_of, f.recent_days))
    if f.text:
        df = df.where(matches_all(F.concat_ws(" ", *(c for c in ("tipo", "operacion", "nombre", "ciudad", "provincia") if c in df.columns)), f.text))
    return df


def best_match(as_of: str) -> Column:
    """4 for coordinates, 3 for an image, 2 for a price, and up to 1 for being new."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp("created_at")) / (30 * 24 * 3600.0)
    flag = lambda c, n: F.when(c, float(n)).otherwise(0.0)
    return flag(has_coordinates(), 4) + flag(F.col("n_imagenes") > 0, 3) + flag(F.col("precio") > 0, 2) + F.greatest(F.lit(0.0), F.coalesce(1 - age, F.lit(0.0)))


def top(df: DataFrame, how: str, n: int, as_of: str, offset: int = 0) -> DataFrame:
    """The first rows by newest, price_asc, price_desc, area, rooms or best; ids break ties. No full sort: top-k per task."""
    unpriced = F.when(F.col("precio") > 0, 0).otherwise(1)
    orders = {
        "newest": [F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp")).desc()],
        "price_asc": [unpriced.asc(), F.col("precio").asc()],
        "price_desc": [unpriced.asc(), F.col("precio").desc()],
        "area": [F.when(F.col("area") > 0, 0).otherwise(1).asc(), F.col("area").desc()],
        "rooms": [F.col("ambientes").desc_nulls_last(), F.col("dormitorios").desc_nulls_last()],
        "best": [best_match(as_of).desc()],
    }
    df = df.orderBy(*orders[how], F.col("id").asc())
    return (df.offset(offset) if offset else df).limit(n)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """(facet, value, n) of each column's values: one pass, pre-aggregated before the shuffle."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(each.alias("x")).where("x.value is not null").groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def cell(zoom: int) -> float:
    return next(size for most, size in CELLS if zoom <= most)


def clusters(df: DataFrame, zoom: int, lat: str = "latitud", lon: str = "longitud") -> DataFrame:
    """lat_cell, lon_cell, n and mean place of the grid cells; halves round up."""
    size = cell(zoom)
    at = lambda c: F.floor(F.col(c) / F.lit(size) + 0.5)
    rows = df.where(has_coordinates(lat, lon)).groupBy(at(lat).alias("lat_cell"), at(lon).alias("lon_cell"))
    mean = lambda c: F.round(F.avg(F.col(c).cast("decimal(18,9)")), 6).cast("double").alias(c)
    return rows.agg(F.count("*").alias("n"), mean(lat), mean(lon))


def named_clusters(df: DataFrame, most: int = 3) -> DataFrame:
    """The first groups of more than one listing by city, else neighbourhood, else Zona; by first id."""
    name = F.coalesce(F.nullif(F.col("ciudad"), F.lit("")), F.nullif(F.col("barrio"), F.lit("")), F.lit("Zona"))
    groups = df.groupBy(name.alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    return groups.where("n > 1").orderBy("first_id").limit(most)


def api_filter(df: DataFrame, operacion: str | None = None, tipo: str | None = None, ciudad: str | None = None, barrio: str | None = None, precio_min: int | None = None, precio_max: int | None = None, moneda: str | None = None, ambientes: int | None = None, dormitorios: int | None = None) -> DataFrame:
    """The read API's filters: operation and type in lower case, currency in upper, parts of city and neighbourhood without regard to case; empty and zero values ask nothing.

    With an upper price bound, the lower one is the given or 0, so negative prices are out.
    """
    for column, value in (("operacion", operacion and operacion.lower()), ("tipo", tipo and tipo.lower()), ("moneda", moneda and moneda.upper()), ("ambientes", ambientes), ("dormitorios", dormitorios)):
        if value:
            df = df.where(F.col(column) == value)
    for column, value in (("ciudad", ciudad), ("barrio", barrio)):
        if value:
            df = df.where(F.contains(F.lower(column), F.lit(value.lower())))
    if precio_max:
        return df.where(F.col("precio").between(precio_min or 0, precio_max))
    return df.where(F.col("precio") >= precio_min) if precio_min else df


def page_filter(model: DataFrame, f: dict, as_of: str) -> DataFrame:
    """The search page's filters over its model: equal values, least and most values, areas only where they are known, and flags that are set.

    Keys: operation, propertyType, currency, province, city, neighborhood; minPrice, maxPrice, minRooms, minBedrooms, minBathrooms; min/maxTotalArea,
    min/maxCoveredArea; hasGarage, hasRealImage, hasCoordinates, recentlyPublished, mortgageEligible, onlyAvailable; query. None and 'all' ask nothing.
    """
    c = F.col
    for name in ("operation", "propertyType", "currency", "province", "city", "neighborhood"):
        if f.get(name) not in (None, "all"):
            model = model.where(c(name) == f[name])
    for name, column in (("Price", "price"), ("Rooms", "rooms"), ("Bedrooms", "bedrooms"), ("Bathrooms", "bathrooms")):
        if f.get(f"min{name}") is not None:
            model = model.where(c(column) >= f[f"min{name}"])
        if f.get(f"max{name}") is not None:
            model = model.where(c(column) <= f[f"max{name}"])
    for name, column in (("TotalArea", "totalArea"), ("CoveredArea", "coveredArea")):
        if f.get(f"min{name}") is not None:
            model = model.where((c(column) <= 0) | (c(column) >= f[f"min{name}"]))
        if f.get(f"max{name}") is not None:
            model = model.where((c(column) <= 0) | (c(column) <= f[f"max{name}"]))
    flags = {
        "hasGarage": lambda: c("garages") > 0, "hasRealImage": lambda: c("hasRealImage"), "hasCoordinates": lambda: has_coordinates("latitude", "longitude"), "mortgageEligible": lambda: c("mortgageEligible"),
        "recentlyPublished": lambda: F.coalesce("publishedAt", "createdAt") > F.lit(as_of).cast("timestamp") - F.make_interval(days=F.lit(30)), "onlyAvailable": lambda: ~c("status").isin(*UNAVAILABLE),
    }
    for name, rule in flags.items():
        if f.get(name):
            model = model.where(rule())
    if f.get("query"):
        text = F.concat_ws(" ", *(x for x in ("title", "description", "address", "neighborhood", "city", "province", "agencyName", "propertyType", "operation") if x in model.columns))
        model = model.where(matches_all(text, f["query"]))
    return model


def page(df: DataFrame, order: list[Column], visible: int) -> tuple[DataFrame, bool]:
    """(the first ``visible`` rows, whether there are more): one row more is sought, nothing is counted."""
    more = df.orderBy(*order).limit(visible + 1).count() > visible
    return df.orderBy(*order).limit(visible), more


def cascading_values(df: DataFrame, levels: list[str], chosen: dict[str, str]) -> DataFrame:
    """(level, value): distinct non-empty values of each level among the rows that fit the choices of the levels above it."""
    out = None
    for n, level in enumerate(levels):
        rows = df
        for above in levels[:n]:
            if above in chosen:
                rows = rows.where(F.col(above) == chosen[above])
        part = rows.where(F.coalesce(F.col(level), F.lit("")) != "").select(F.lit(level).alias("level"), F.col(level).alias("value")).distinct()
        out = part if out is None else out.unionByName(part)
    return out


def neighbourhoods(df: DataFrame, name: str, order: str, most: int = 1000) -> DataFrame:
    """Distinct neighbourhoods of the first rows that have one; the row cap is the endpoint's own."""
    return df.where(F.col(name).isNotNull()).orderBy(order).limit(most).select(name).distinct().orderBy(name)
