"""Listing, directory and detail pages made from the pages table: each page's own markup or title, with a site's cards or fields put in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from terrano.sources.adapters import table

#: What stands in a card, by kind (page_id modulo 6): {p} page, {i} card, {w} a word of the page's title.
LISTING_CARDS = (
    '<div class="property-card"><a href="/propiedad/{p}{i}-casa-en-venta-zona{w}"><h3>Casa amplia {w} {i}</h3></a><span class="price">USD {p}00{i}</span>'
    '<p>{i} dorm. 2 baños 3 amb. 4{i} m²</p><img src="/img/logo.png"><img data-src="/f/{p}-{i}.jpg"></div>',
    '<div class="property-item"><a href="/propiedad/{p}{i}1-casa-en-venta-zona{w}"><h2>Complejo grande {w}</h2></a><b>$ 95.00{i}</b>'
    '<div class="property-item"><a href="/propiedad/{p}{i}2-local-en-alquiler-zona{w}"><h2>Unidad chica {w}</h2></a><b>USD 45.00{i}</b></div></div>',
    '<article class="listing-row"><a href="/contacto/x">c</a><a href="/oferta/{p}{i}-depto-en-alquiler"><strong>Consultar precio U$S</strong></a><h1 class="x">Departamento luminoso {w}</h1></article>',
    '<ul class="resultados-list"><li><a href="/propiedades/{p}{i}-terreno-en-venta-zona{w}">Terreno grande zona {w}</a><span>US$ 7500{i}</span><li class="x"></ul>',
    '<p><a href="/inmueble/{p}{i}-depto-en-alquiler-zona{w}">Ver departamento {i}</a> <a href="/inmueble/{p}{i}-depto-en-alquiler-zona{w}">otra vez</a> <a href="/propiedades/page/2">2</a></p>',
    '<div class="prop-card">solo texto</div><p>Foto del galpon {i} <a href="/ficha/{p}{i}-galpon"><img src="x.png"></a></p>',
)
DIRECTORY_CARDS = (
    '<div class="x directoryCard-module__card-container__a"><a class="text-content-link" href="/inmobiliarias/{w}-{p}{i}"><h2 class="text-content-link-title">Inmobiliaria {w} {i}</h2></a>'
    '<img src="/star.svg"><img data-src="https://cdn.example/empresas/{p}/{i}.jpg"></div><p data-qa="agency-card"><h2>no</h2></p>',
    '<article data-qa="agency-card"><h2>Inmobiliaria {w} {i}</h2><a href="/inmobiliarias/{w}-{p}{i}">ver</a></article>',
    '<section data-qa="realEstate-card"><h2>INMOBILIARIA {w} {i}</h2><img class="logo" src="https://cdn.example/{p}/{i}.png"></section>',
    '<ul><li><h2>Inmobiliaria <i>{w}</i> {i}</h2><a href="/inmobiliarias/{w}-{p}{i}">ver</a></li></ul>',
    '<div class="card"><h2>Inmobiliaria {w} {i}</h2></div>',
)
DETAILS = (
    '<h1 class="property-title">Casa en venta {w}</h1><span class="price">USD {p}00</span><p class="address">Mitre {p}</p><span class="barrio">Zona {w}</span><dl class="dl-horizontal"><dt>Dormitorios</dt><dd>{r}</dd>'
    "<dt>Baños</dt><dd>2</dd><dt>Ambientes</dt><dd>4</dd><dt>Superficie</dt><dd>1{r} m2</dd><dt>Tipo</dt><dd>Local</dd></dl>",
    '<h1>Depto en alquiler {w}</h1><strong>$ {p}000</strong><ul class="info"><li><span>Dormitorios</span> <b>{r}</b></li><li>2 baños</li><li><span>Sup. total</span><i>x</i><span>6{r}</span></li></ul>',
    '<div class="titulo"><h1>Terreno {w}</h1></div><address>Roca {p}</address><table><tr><th>Superficie</th><td>3{r} m2</td></tr><tr><td>Ambientes</td><td>no</td></tr><tr><td>Ambientes</td><td>{r}</td></tr></table>',
    '<h1>Oficina {w}</h1><p class="precio">Consultar</p><p itemprop="price">US$ {p}50</p><span class="bedrooms">{r} cuartos</span><span class="bathroom">1</span><span class="surface">2{r}</span><span class="surface">999</span>',
    "<h1>Cochera {w}</h1><p>Tiene {r} dormitorios, 1 baño, ambientes: 5 y 8{r} m2 en total.</p>",
    '<dl class="features-list"><dt>Sup.</dt><dd>5</dd><dt>Dormitorios</dt><dd>0</dd></dl><div class="stats"><ul><li>{r} dormitorios</li></ul></div><table><tr><td>Metros</td><td>7{r}</td></tr></table>'
    '<div class="description">Una casa con jardín al frente y patio detrás, cerca de todo: {w}.</div><div class="gallery"><img src="/a{p}.jpg"><img src="/logo.jpg"><img src="/a{p}.jpg"><img data-src="/b{p}.jpg"></div>',
)


def word(html: Column) -> Column:
    """A word of the page's title; Zeta if it has none."""
    return F.coalesce(F.nullif(F.regexp_extract(html, "<title>[^<]*?([A-Za-z]{3,12})", 1), F.lit("")), F.lit("Zeta"))


def _filled(template: str, **values: Column) -> Column:
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), value.cast("string"))
    return out


def _by_page(kinds: tuple[str, ...], **values: Column) -> Column:
    out = F.lit("")
    for n, template in enumerate(kinds):
        out = F.when(F.col("page_id") % len(kinds) == n, _filled(template, **values)).otherwise(out)
    return out


def _cards(kinds: tuple[str, ...], count: Column) -> Column:
    return F.array_join(F.transform(F.sequence(F.lit(1), count), lambda i: _by_page(kinds, p=F.col("page_id"), i=i, w=F.col("_w"))), "\n")


def listing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: every page with two to four cards behind its own markup."""
    pages = table(spark, sf_dir, "pages").withColumn("_w", word(F.col("html")))
    return pages.select("page_id", "url", F.concat("html", F.lit("\n"), _cards(LISTING_CARDS, (F.col("page_id") % 3 + 2).cast("int"))).alias("html"))


def directory_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, html: every page with one to three cards behind its own markup, each twice."""
    pages = table(spark, sf_dir, "pages").withColumn("_w", word(F.col("html")))
    cards = _cards(DIRECTORY_CARDS, (F.col("page_id") % 3 + 1).cast("int"))
    return pages.select("page_id", F.concat("html", F.lit("\n"), cards, F.lit("\n"), cards).alias("html"))


def detail_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, html: for every page one of a listing, of six kinds."""
    pages = table(spark, sf_dir, "pages").withColumn("_w", word(F.col("html")))
    body = _by_page(DETAILS, p=F.col("page_id"), w=F.col("_w"), r=F.col("page_id") % 7 + 1)
    return pages.select("page_id", "url", F.concat(F.lit("<html><body>"), body, F.lit("</body></html>")).alias("html"))
