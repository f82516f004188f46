"""Cards of listing pages and of directories, and the fields of a listing's own page, over rows of elements.

A ladder of rules finds containers: the first rule that anything on a page matches holds for that whole page. What a
card shows is taken from the elements whose innermost container it is, so a card inside another keeps what is its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from terrano.functions import addresses as A, cards as C, links as L, names, normalize as N, urls as U
from terrano.functions.normalize import let
from terrano.operators.elements import attr, class_part, elements, first, first_rung, has_class, in_order, innermost, text
from terrano.operators.publishing import is_valid

#: The rules that find listing cards, in order: parts of class attributes.
CARD_PARTS = (
    ("property-card", "property-item"), ("prop-card", "prop-item"), ("listing-item", "listing-card"), ("inmueble-item", "item-inmueble"), ("aviso-", "-aviso"),
    ("real-estate-item", "estate-item"), ("card-inmueble", "inmueble-card"), ("result-item", "search-result"),
)
#: Parts of links to single listings, in links and in paths; what follows them in links to lists.
LINK_PARTS = (
    "/p/", "/propiedad/", "/propiedades/", "/inmueble/", "/inmuebles/", "/property/", "/properties/", "/listing/", "/listings/", "/detalle/", "/detalles/", "/aviso/", "/emprendimiento/", "/Ficha/", "/ficha/", "ficha-",
)
PATH_PARTS = (
    "/p/", "/propiedad/", "/propiedades/", "/ad/", "/inmueble/", "/inmuebles/", "/property/", "/properties/", "/listing/", "/listings/", "/detalle/", "/detalles/", "/aviso/", "/emprendimiento/", "/Ficha/", "/ficha/", "/ficha-",
)
LIST_STARTS = ("venta", "alquiler", "page", "buscar", "search", "results", "resultados", "categoria", "category", "tipo", "type")
#: Parts of links that a card's own link has not; of links left out where there are no cards.
NOT_OWN_LINKS = ("/page/", "?page=", "#", "javascript:", "/buscar", "/search", "/contact", "/about", "/nosotros", "/quienes", "/servicios")
NOT_LINKS = ("/page/", "?page=", "/busqueda/", "/buscar/", "/search/")
NO_ADDRESS = r"^(#|javascript:|mailto:|tel:)"
NOT_PICTURES = "logo|icon|placeholder|blank|spinner|loading|avatar"
CARD_TYPES = ("casa", "departamento", "terreno", "local", "oficina", "cochera", "galpon", "galpón", "duplex", "dúplex", "ph")
MONEY = ("$", "USD", "U$S", "US$")
#: Words behind or before numbers of rooms.
ROOMS = {"dormitorios": "dorm|habit", "banos": "ba[ñn]", "ambientes": "amb"}
PAGE_ROOMS = {"dormitorios": "dorm(?:itorios?)?|habit(?:aciones?)?", "banos": "ba[ñn](?:os?)?", "ambientes": "amb(?:ientes?)?"}


def _has(x: Column, parts: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(x, F.lit(p))
    return F.coalesce(out, F.lit(False))


def _card_ladder() -> list[Column]:
    tag = F.col("tag")
    return [
        *(class_part(*parts) for parts in CARD_PARTS),
        (tag == "article") & has_class("property-row"),
        (tag == "article") & class_part("prop", "listing"),
        (tag == "article") & class_part("inmueble", "aviso"),
        has_class("rh_list_card", "rh-ultra-property-card-two", "rh_prop_card"),
        has_class("figure-block", "hotels-layout"),
        (tag == "div") & has_class("col-md-6") & has_class("col-lg-6"),
        (tag == "div") & has_class("col-sm-6") & has_class("col-xs-12"),
        (tag == "div") & has_class("col-md-4") & has_class("col-sm-6"),
        (tag == "li") & F.col("_list").isNotNull(),
    ]


def _first_if(value: Column, where: Column, good) -> Column:
    """An aggregate: the first element's value where something holds, if it is good; else null."""
    return let(first(value, where), lambda v: F.when(good(v), v))


def _absolute(href: Column, base: Column) -> Column:
    return F.when(href.startswith("http"), href).otherwise(U.absolute(href, base))


def _picture() -> Column:
    """The address of an image that shows something; null for others."""
    shows = lambda u: F.when(~F.rlike(F.lower(u), F.lit(NOT_PICTURES)) & ~F.lower(u).endswith(".svg"), u)
    source = attr("src", "data-src", "data-lazy-src", "data-original")
    return F.when((F.col("tag") == "img") & ~source.startswith("data:"), let(_absolute(source, F.col("url")), shows))


def _spoken_operation(link: Column, said: Column) -> Column:
    low = F.lower(link)
    of = lambda w: F.contains(low, F.lit(f"en-{w}")) | F.contains(low, F.lit(f"/{w}")) | F.contains(low, F.lit(f"-{w}-")) | low.endswith(f"-{w}")
    sold, let_out = F.contains(said, F.lit("venta")), F.contains(said, F.lit("alquiler"))
    return F.when(of("venta"), "venta").when(of("alquiler"), "alquiler").when(sold & ~let_out, "venta").when(let_out, "alquiler")


def _address(href: Column) -> Column:
    """Words and the last number of a link's parts as a street; null without both."""
    parts = F.split(F.substring_index(href, "?", 1), "[-/]")
    digits = lambda p: F.rlike(p, F.lit("^[0-9]+$"))
    words = F.filter(parts, lambda p: ~digits(p) & (F.length(p) > 2) & ~F.lower(p).isin(*C.SLUG_WORDS))
    last = lambda ws: F.array_join(F.slice(ws, F.greatest(F.size(ws) - 2, F.lit(1)), F.lit(3)), " ")
    number = F.try_element_at(F.filter(parts, digits), F.lit(-1))
    return let(words, lambda ws: F.when((F.size(ws) > 0) & number.isNotNull(), names.title(F.concat(last(ws), F.lit(" "), number))))


def _area(said: Column) -> Column:
    v = F.nullif(F.regexp_extract(said, r"(?i)(\d+)\s*(?:m²|m2|mts?\.?\s*(?:cuad)?)", 1), F.lit("")).try_cast("int")
    return F.when(v.between(10, 10000), v)


def _detail_link(href: Column, base: Column) -> Column:
    """Whether a link's address looks like a single listing's: by the general rule, or by the first telling part of it with more than a list's name behind."""
    out = F.when(F.coalesce(let(U.absolute(href, base), lambda u: L.is_detail(u, base)), F.lit(False)), True)
    for part in PATH_PARTS:
        after = F.btrim(F.substr(href, F.instr(href, part) + len(part)), F.lit("/"))
        start = F.lower(F.substring_index(F.substring_index(after, "/", 1), "-", 1))
        out = out.when(F.contains(href, F.lit(part)), (after != "") & ~start.isin(*LIST_STARTS) & (F.length(after) >= 3))
    return out.otherwise(False)


COLUMNS = ["page_id", "pos", "way", "rung", "url", "titulo", "precio", "moneda", "barrio", "tipo_propiedad", "operacion", "direccion", "imagen", "metros", "ambientes", "dormitorios", "banos"]


def _contained(rows: DataFrame) -> DataFrame:
    """The valid cards of pages on which a rule of the ladder finds containers."""
    tag, href = F.col("tag"), attr("href")
    rows = innermost(rows, (tag == "ul") & has_class("resultados-list"), "_list")
    rows = first_rung(rows, _card_ladder(), "rung")
    rows = innermost(rows, F.col("rung").isNotNull(), "card", itself=True).where("card is not null")
    inside = F.col("start") != F.col("card")
    link, said = inside & (tag == "a") & href.isNotNull(), text()
    path = F.btrim(F.regexp_extract(href, "^(?:https?://[^/?#]*)?([^?#]*)", 1), F.lit("/"))
    plain_link = link & ~F.rlike(href, F.lit(NO_ADDRESS)) & ~_has(href, NOT_OWN_LINKS) & (F.size(F.filter(F.split(path, "/"), lambda p: p != "")) >= 2)
    data = F.map_values(F.map_filter("attrs", lambda k, _: F.rlike(k, F.lit("^data-(target$|.*(?:href|url|link|slug|path))"))))
    hidden = F.concat(data, L.click_urls(F.col("attrs")["onclick"]))
    money = lambda v: _has(v, MONEY)
    price = lambda where: _first_if(said, inside & where, lambda v: money(v) | F.contains(F.lower(v), F.lit("usd")))
    titled = lambda where: _first_if(said, inside & where, lambda v: (F.length(v) > 8) & ~_has(v, ("$", "USD")))
    got = rows.groupBy("page", "page_id", F.col("url").alias("base"), "card").agg(
        F.max("rung").alias("rung"),
        F.coalesce(first(href, link & _has(href, LINK_PARTS)), first(href, plain_link)).alias("href"),
        F.flatten(in_order(hidden, F.size(hidden) > 0)).alias("hidden"),
        first(F.col("class"), ~inside).alias("own_class"),
        F.max((tag == "img") & inside & attr("src", "data-src", "data-lazy-src", "data-original").isNotNull()).alias("pictured"),
        in_order(said, inside & F.col("leaf") & (said != "")).alias("texts"),
        F.coalesce(price(class_part("price")), price(class_part("precio")), price(class_part("Price")), price(tag == "strong"), price(tag == "b")).alias("marked_price"),
        F.coalesce(*(titled(tag == h) for h in ("h2", "h3", "h1")), titled(class_part("title")), titled(class_part("titulo"))).alias("marked_title"),
        first(F.col("picture"), inside & F.col("picture").isNotNull()).alias("imagen"),
    )
    blob = F.concat_ws(" ", F.array_join("texts", " "), "own_class")
    point = lambda pattern, n=1, x=blob: F.when(F.rlike(x, F.lit(pattern)), n).otherwise(0)
    points = point(L.CARD_PRICE, 2) + point(L.CARD_OPERATION) + point(L.CARD_TYPE) + point(L.CARD_SIZE) + F.when(F.col("pictured"), 1).otherwise(0) + point(L.CARD_CLASS, 1, F.col("own_class"))
    found = F.filter(F.array_compact(F.transform("hidden", lambda r: U.absolute(r, F.col("base")))), lambda u: L.is_detail(u, F.col("base")))
    got = got.withColumn("href", F.coalesce("href", F.when(points >= 2, F.get(found, F.lit(0))))).where(F.col("href").isNotNull())
    got = got.where(~F.col("href").startswith("http") | L.same_site(F.col("href"), F.col("base"))).withColumn("link", _absolute(F.col("href"), F.col("base")))
    # of cards of one link the first in page order stays
    got = got.withColumn("_n", F.row_number().over(W.partitionBy("page", "link").orderBy("card"))).where("_n = 1")
    spoken = F.array_join("texts", " ")
    price_text = F.coalesce("marked_price", F.get(F.filter("texts", money), F.lit(0)))
    loose = F.get(F.filter("texts", lambda t: (F.length(t) > 10) & ~_has(t, ("$", "USD", "m²", "Dormitorio", "Área", "U$S"))), F.lit(0))
    kind = N.property_type(F.regexp_replace("href", "[-/]", " "))
    typed = names.type_name(F.get(F.filter("texts", lambda t: F.lower(t).isin(*CARD_TYPES)), F.lit(0)))
    heading = F.left(F.coalesce("marked_title", loose), F.lit(150))
    of_heading = F.when(heading.isNotNull(), N.property_type(heading)).otherwise(F.lit("otro"))
    got = got.withColumn("direccion", _address(F.col("href")))
    return got.select(
        "page", "page_id", F.col("card").alias("start"), F.lit("card").alias("way"), "rung", F.col("link").alias("url"), F.coalesce(F.left("marked_title", F.lit(150)), loose, F.col("direccion"), F.lit("Sin título")).alias("titulo"),
        N.price_amount(price_text).alias("precio"), N.price_currency(price_text).alias("moneda"), F.when(F.col("direccion").isNull(), F.lit("")).alias("barrio"),
        F.when(kind != "otro", kind).when(F.coalesce(typed, F.lit("otro")) != "otro", typed).otherwise(of_heading).alias("tipo_propiedad"), _spoken_operation(F.col("href"), F.lower(spoken)).alias("operacion"),
        "direccion", "imagen", _area(spoken).alias("metros"), *(C.number_near(F.lower(spoken), w).alias(n) for n, w in ROOMS.items()),
    )


def _linked(rows: DataFrame) -> DataFrame:
    """The listings that links alone tell of."""
    href, base = attr("href"), F.col("url")
    parents = rows.select("page", F.col("start").alias("_parent"), F.left(text(), F.lit(150)).alias("_said"))
    links = rows.where((F.col("tag") == "a") & href.isNotNull() & ~F.rlike(href, F.lit(NO_ADDRESS)) & F.col("detail") & ~_has(href, NOT_LINKS))
    links = links.withColumn("_parent", F.element_at("path", -1)).join(parents, ["page", "_parent"], "left")
    made = links.select("page", "page_id", "start", _absolute(href, base).alias("url"), F.coalesce(F.nullif(text(), F.lit("")), "_said", F.lit("")).alias("said"))
    made = made.withColumn("_n", F.row_number().over(W.partitionBy("page", "url").orderBy("start"))).where("_n = 1").withColumn("_slug", C.slug(F.col("url")))
    title = F.coalesce(F.when(F.length("said") > 8, F.left("said", F.lit(150))), F.nullif(F.col("_slug.title"), F.lit("")), F.lit("Sin título"))
    last = F.replace(F.regexp_extract(F.rtrim(F.substring_index("url", "?", 1), F.lit("/")), "([^/]*)$", 1), F.lit("-"), F.lit(" "))
    none = lambda n, t: F.lit(None).cast(t).alias(n)
    return made.select(
        "page", "page_id", "start", F.lit("link").alias("way"), none("rung", "int"), "url", title.alias("titulo"), none("precio", "long"), none("moneda", "string"),
        F.when(F.col("_slug.neighbourhood").isNull() & F.col("_slug.address").isNull(), F.lit("")).otherwise(F.col("_slug.neighbourhood")).alias("barrio"),
        N.property_type(F.concat_ws(" ", last, title)).alias("tipo_propiedad"), F.col("_slug.operation").alias("operacion"), F.col("_slug.address").alias("direccion"), none("imagen", "string"),
        *(none(n, "int") for n in ("metros", *ROOMS)),
    )


def _judged(rows: DataFrame, city: str) -> DataFrame:
    """Valid rows alone; where nothing tells a neighbourhood or address, the city stands for it."""
    rows = rows.withColumn("barrio", F.when(F.col("barrio") == "", F.lit(city or "Argentina")).otherwise(F.col("barrio")))
    return rows.where(is_valid(*(F.col(c) for c in ("url", "titulo", "direccion", "barrio", "tipo_propiedad", "moneda"))))


def listing_cards(pages: DataFrame, city: str = "Santa Fe", operation: str | None = None) -> DataFrame:
    """COLUMNS: one row a listing that a page (page_id, url, html) shows, ``pos`` in page order from 1.

    ``way`` is card, with the rung of the ladder, or link on pages where no container gives a valid card. A card needs
    a link of its own site; of several cards with one link the first counts. ``city`` and ``operation`` stand in where a
    page tells none. Null or empty pages have no cards; relative links need the page's url, and stay out without it.
    """
    from terrano.session import written

    detail = F.when(F.col("tag") == "a", let(attr("href"), lambda h: _detail_link(h, F.col("url"))))
    rows = written(elements(pages.select("page_id", "url", "html"), ["page_id", "url"]).withColumns({"picture": _picture(), "detail": F.coalesce(detail, F.lit(False))}), "elements")
    held = written(_judged(_contained(rows), city), "cards")
    alone = _judged(_linked(rows.join(held.select("page").distinct(), "page", "left_anti")), city)
    every = held.unionByName(alone)
    if operation is not None:
        every = every.withColumn("operacion", F.coalesce("operacion", F.lit(operation)))
    return every.withColumn("pos", F.row_number().over(W.partitionBy("page").orderBy("start"))).select(*COLUMNS)


# --- directories


def directory_cards(pages: DataFrame, site: str = "") -> DataFrame:
    """page_id, pos, rung, nombre, logo, perfil: the agencies that a directory's page shows; of equal names (in lower case) on a page the first.

    Four rules find the containers, the last by links to agencies' profiles and what encloses them; ``site`` comes before relative profile links.
    """
    rows = elements(pages.select("page_id", "html"), ["page_id"], named="a^")
    tag, href, qa = F.col("tag"), attr("href"), F.col("attrs")["data-qa"]
    profile = (tag == "a") & F.contains(F.coalesce(href, F.lit("")), F.lit("/inmobiliarias/"))
    rows = innermost(rows, tag.isin("article", "li", "div", "section"), "_box")
    boxes = F.array_contains(F.collect_list(F.when(profile, F.col("_box"))).over(W.partitionBy("page")), F.col("start"))
    ladder = [(tag == "div") & class_part("directoryCard-module__card-container"), qa == "agency-card", qa == "realEstate-card", boxes]
    rows = rows.withColumn("_boxed", boxes)
    rows = first_rung(rows, [*ladder[:3], F.col("_boxed")], "rung")
    rows = innermost(rows, F.col("rung").isNotNull(), "card", itself=True).where("card is not null")
    inside, said, source = F.col("start") != F.col("card"), F.left(text(), F.lit(200)), attr("src", "data-src")
    brand = F.contains(source, F.lit("empresas")) | F.contains(F.lower(source), F.lit("logo"))
    got = rows.groupBy("page", "page_id", "card").agg(
        F.max("rung").alias("rung"),
        F.coalesce(first(said, inside & (tag == "h2") & class_part("text-content-link-title")), first(said, inside & (tag == "h2"))).alias("nombre"),
        F.coalesce(first(F.coalesce(href, F.lit("")), inside & (tag == "a") & class_part("text-content-link")), first(href, inside & profile)).alias("perfil"),
        F.coalesce(first(source, inside & (tag == "img") & brand), first(source, inside & (tag == "img") & class_part("logo"))).alias("logo"),
    )
    got = got.where(F.length("nombre") >= 2).withColumn("_n", F.row_number().over(W.partitionBy("page", F.lower("nombre")).orderBy("card"))).where("_n = 1")
    link = F.when(F.col("perfil").startswith("http"), F.col("perfil")).otherwise(F.concat(F.lit(site), F.nullif("perfil", F.lit(""))))
    return got.select("page_id", F.row_number().over(W.partitionBy("page").orderBy("card")).alias("pos"), "rung", "nombre", link.alias("perfil"), "logo")


# --- a listing's own page

#: Parts of classes around lists of features, for each way of pairing labels with values.
DEFINITION_LISTS = ("detail-list", "features-list", "property-features")
ITEM_LISTS = ("feature", "amenity", "characteristic", "stats", "spec", "property-detail", "overview")
OWN_ITEM_LISTS = ("prop", "info")
ROOM_CLASSES = {"dormitorios": ("dorm", "bedroom", "room"), "banos": ("bano", "bath"), "metros": ("surface", "metros", "m2")}
DESCRIPTION_PARTS = ("description", "content")
FIELDS = ("dormitorios", "banos", "ambientes", "metros")


def _number(x: Column) -> Column:
    return F.nullif(F.nullif(F.regexp_extract(x, r"\d+", 0), F.lit("")).try_cast("int"), F.lit(0))


def _labelled(label: Column) -> Column:
    """The field that a label names, by the first of the rules that fits."""
    out = None
    for name, parts in (*C.FEATURES, ("tipo", C.TYPE_LABELS)):
        hit = F.rlike(label, F.lit("|".join(parts)))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out


def _pairs(rows: DataFrame) -> DataFrame:
    """page, way, start, label, value, held: what definition lists, list items, table rows and classes pair, in the order of the ways.

    held: by class, a bath that counts only where bedrooms are known otherwise.
    """
    tag = F.col("tag")
    said, spaced = text(), text(between=" ")
    # labels and values of definition lists are paired by their order on the page
    around = innermost(rows, (((tag == "dl") & has_class("dl-horizontal")) | has_class("service-list") | class_part(*DEFINITION_LISTS)), "_list").where("_list is not null")
    place = F.row_number().over(W.partitionBy("page", "tag").orderBy("start"))
    terms = around.where(tag.isin("dt", "dd")).select("page", "tag", "start", said.alias("said"), place.alias("n"))
    lists = terms.where("tag = 'dt'").alias("a").join(terms.where("tag = 'dd'").alias("b"), ["page", "n"])
    first_way = lists.select("page", F.lit("dl").alias("way"), F.col("a.start").alias("start"), F.col("a.said").alias("label"), F.col("b.said").alias("value"))
    # items of lists of features: the first and the last of their spans, or their whole text
    around = innermost(rows, class_part(*ITEM_LISTS) | ((tag == "ul") & class_part(*OWN_ITEM_LISTS)), "_list")
    around = around.withColumn("_listed", (tag == "li") & F.col("_list").isNotNull())
    around = innermost(around, F.col("_listed"), "_item").where("_item is not null or _listed").withColumn("_of", F.when(F.col("_listed"), F.col("start")).otherwise(F.col("_item")))
    spans = tag.isin("span", "b", "strong") & ~F.col("_listed")
    items = around.groupBy("page", "_of").agg(in_order(said, spans).alias("spans"), first(spaced, F.col("_listed")).alias("whole"))
    two = F.size("spans") >= 2
    second_way = items.select(
        "page", F.when(two, "li").otherwise("li_text").alias("way"), F.col("_of").alias("start"), F.when(two, F.get("spans", F.lit(0))).otherwise(F.col("whole")).alias("label"), F.when(two, F.element_at("spans", -1)).otherwise(F.col("whole")).alias("value")
    )
    # rows of tables: their first two cells
    around = innermost(innermost(rows, tag == "table", "_table"), (tag == "tr"), "_row").where("_table is not null and _row is not null and tag in ('td', 'th')")
    cells = around.groupBy("page", "_row").agg(in_order(said, F.lit(True)).alias("cells")).where(F.size("cells") >= 2)
    third_way = cells.select("page", F.lit("table").alias("way"), F.col("_row").alias("start"), F.get("cells", F.lit(0)).alias("label"), F.get("cells", F.lit(1)).alias("value"))
    # elements whose class names a field; one that names bedrooms and baths tells of baths unless it is the page's first for bedrooms
    number = _number(F.lower(said))
    shown = rows.where(class_part("dorm", "bedroom", "room-count", "bano", "bath", "surface", "metros", "m2-") & number.isNotNull())
    beds, baths, area = (class_part(*ROOM_CLASSES[n]) for n in ("dormitorios", "banos", "metros"))
    shown = shown.withColumn("_beds", F.row_number().over(W.partitionBy("page", beds).orderBy("start")))
    named = F.array_compact(F.array(F.when(beds, F.struct(F.lit("dorm").alias("label"), F.lit(False).alias("held"))), F.when(baths, F.struct(F.lit("bano").alias("label"), (beds & (F.col("_beds") == 1)).alias("held"))), F.when(~beds & ~baths & area, F.struct(F.lit("metros").alias("label"), F.lit(False).alias("held")))))
    fourth_way = shown.select("page", F.lit("class").alias("way"), "start", F.explode(named).alias("x"), said.alias("value")).select("page", "way", "start", "x.label", "value", "x.held")
    others = first_way.unionByName(second_way).unionByName(third_way).withColumn("held", F.lit(False))
    return others.unionByName(fourth_way)


def detail_fields(pages: DataFrame, city: str = "Argentina") -> DataFrame:
    """page_id, url, the fields of a listing's page (page_id, url, html), and of each the rule it came from.

    Price, title, address, neighbourhood and description are read by ladders of rules, each looking at the first element
    it matches; rooms and area come from paired labels and values (definition lists, items, tables), then from classes,
    then from the page's text: the first that gives a number. Nulls where a page says nothing.
    """
    from terrano.session import written

    rows = elements(pages.select("page_id", "url", "html"), ["page_id", "url"]).withColumn("picture", _picture())
    tag, said, prop = F.col("tag"), text(), F.col("attrs")["itemprop"]
    rows = innermost(rows, class_part("property-title", "titulo"), "_titled")
    rows = innermost(rows, class_part("location"), "_located")
    rows = innermost(rows, class_part("content"), "_content")
    rows = innermost(rows, tag.isin("article", "main"), "_main")
    rows = innermost(rows, class_part("gallery", "slider", "photo", "imagen") | has_class("carousel") | (F.col("attrs")["id"] == "gallery") | tag.isin("article", "main"), "_shown")
    rows = written(rows, "placed")

    def ladder(rules: dict[str, Column], value: Column, good) -> Column:
        """struct(rule, value) of the first rule whose first element's value is good."""
        named = lambda name: lambda v: F.when(good(v), F.struct(F.lit(name).alias("rule"), v.alias("value")))
        return F.coalesce(*(let(first(value, where), named(name)) for name, where in rules.items()))

    priced = lambda v: _has(v, MONEY) & N.price_amount(v).isNotNull()
    titled = lambda v: (F.length(v) > 4) & ~_has(v, ("$", "USD"))
    placed = lambda v: F.length(v).between(3, 79) & (v != city)
    address = lambda v: F.length(v).between(5, 149) & (A.tidy(v) != "")
    h1, spaced = tag == "h1", text(between=" ")
    heads = rows.groupBy("page", "page_id", "url").agg(
        ladder({"class_price": class_part("price"), "class_precio": class_part("precio"), "class_Price": class_part("Price"), "itemprop": prop == "price", "strong": tag == "strong", "b": tag == "b"}, said, priced).alias("price"),
        ladder({"h1_class": h1 & has_class("property-title"), "in_title": h1 & F.col("_titled").isNotNull(), "h1_title": h1 & class_part("title"), "class_title": class_part("property-title"), "h1": h1}, said, titled).alias("title"),
        ladder(
            {"class_address": class_part("address"), "class_direccion": class_part("direccion"), "address": tag == "address", "itemprop": prop == "streetAddress", "located": tag.isin("h2", "h3") & F.col("_located").isNotNull(), "h2": (tag == "h2") & class_part("ubicac")},
            said, address,
        ).alias("address"),
        ladder({"neighborhood": class_part("neighborhood"), "barrio": class_part("barrio"), "itemprop": prop == "addressLocality", "location": class_part("location")}, said, placed).alias("place"),
        ladder({"class_description": class_part("description"), "entry_content": has_class("entry-content"), "content_p": (tag == "p") & F.col("_content").isNotNull(), "main_p": (tag == "p") & F.col("_main").isNotNull()}, spaced, lambda v: F.length(v) > 50).alias("about"),
        F.slice(F.array_distinct(in_order(F.col("picture"), F.col("_shown").isNotNull() & F.col("picture").isNotNull())), 1, 10).alias("imagenes"),
        first(spaced, tag == "#page").alias("all_text"),
    )
    order = F.element_at(F.create_map(*(F.lit(x) for way, n in (("dl", 1), ("li", 2), ("li_text", 2), ("table", 3), ("class", 4)) for x in (way, n))), F.col("way"))
    known = _pairs(rows).withColumn("field", _labelled(F.lower(F.trim("label")))).withColumn("number", _number(F.col("value")))
    spoken_area = (F.col("way") != "li_text") | F.rlike(F.lower("label"), F.lit("sup|m²|metro"))
    good = F.when(F.col("field") == "metros", F.col("number").between(10, 10000) & spoken_area).otherwise(F.col("number").isNotNull())
    of = lambda f, free: F.min_by(F.struct("way", "number"), F.when((F.col("field") == f) & good & free, F.struct(order, F.col("start"))))
    by = lambda f: of(f, ~F.col("held")).alias(f"_{f}")
    kind = names.type_name(F.col("value"))
    typed = F.min_by(F.struct("way", kind.alias("kind")), F.when((F.col("field") == "tipo") & F.col("way").isin("dl", "li", "table") & (kind != "otro"), F.struct(order, F.col("start")))).alias("_tipo")
    featured = known.groupBy("page").agg(*map(by, FIELDS), of("banos", F.lit(True)).alias("_any_bath"), typed)
    featured = featured.withColumn("_banos", F.when(F.col("_dormitorios.way") != "class", F.col("_any_bath")).otherwise(F.col("_banos")))
    out = heads.join(featured, "page", "left")
    whole = F.col("all_text")
    spoken = {**{n: C.number_near(whole, w, 20) for n, w in PAGE_ROOMS.items()}, "metros": N.area_m2(whole).cast("int")}
    numbers = [c for f in FIELDS for c in (F.coalesce(F.col(f"_{f}.number"), spoken[f]).alias(f), F.coalesce(F.col(f"_{f}.way"), F.when(spoken[f].isNotNull(), F.lit("text"))).alias(f"{f}_rule"))]
    title, about = F.left(F.col("title.value"), F.lit(200)), F.left(F.col("about.value"), F.lit(3000))
    low = F.lower("url")
    operation = F.when(F.contains(low, F.lit("venta")), "venta").when(F.contains(low, F.lit("alquiler")), "alquiler").otherwise(N.operation_in_text(F.concat_ws(" ", title, about)))
    in_text = N.property_type(F.concat(F.coalesce(title, F.lit("")), F.lit(" "), F.left(whole, F.lit(500))))
    return out.select(
        "page_id", "url", title.alias("titulo"), F.col("title.rule").alias("titulo_rule"), N.price_amount(F.col("price.value")).alias("precio"), N.price_currency(F.col("price.value")).alias("moneda"), F.col("price.rule").alias("precio_rule"),
        A.tidy(F.col("address.value")).alias("direccion"), F.col("address.rule").alias("direccion_rule"), F.coalesce("place.value", F.lit(city)).alias("barrio"), F.coalesce("place.rule", F.lit("city")).alias("barrio_rule"), *numbers,
        F.coalesce("_tipo.kind", in_text).alias("tipo_propiedad"), F.coalesce("_tipo.way", F.lit("text")).alias("tipo_rule"), about.alias("descripcion"), F.col("about.rule").alias("descripcion_rule"), F.to_json("imagenes").alias("imagenes"), operation.alias("operacion"),
    )
