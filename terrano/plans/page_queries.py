"""Queries over rows of elements: listing cards, directory cards, a listing's own page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from terrano.operators import page_cards
from terrano.sources.page_views import detail_pages, directory_pages, listing_pages

QUERIES: dict = {}
SQL: dict = {}

_PAGES = r"""p AS (SELECT page_id AS p, url, regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]+)', 1) AS site, coalesce(nullif(regexp_extract(html, '<title>[^<]*?([A-Za-z]{3,12})', 1), ''), 'Zeta') AS w FROM pages)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


@query(
    rf"""
WITH {_PAGES}, c AS (SELECT *, p % 6 AS k, p::VARCHAR || i AS pi, upper(left(w, 1)) || lower(w[2:]) AS tw, 'Zona' || lower(w) AS zone FROM p, unnest(range(1, p % 3 + 3)) AS t(i)),
r AS (
  SELECT p, i AS pos, 'card' AS way, 0 AS rung, '/propiedad/' || pi || '-casa-en-venta-zona' || w AS link, 'Casa amplia ' || w || ' ' || i AS titulo, (p::VARCHAR || '00' || i)::BIGINT AS precio, 'USD' AS moneda, NULL::VARCHAR AS barrio, 'casa' AS tipo_propiedad, 'venta' AS operacion,
    zone || ' ' || pi AS direccion, site || '/f/' || p || '-' || i || '.jpg' AS imagen, 40 + i AS metros, 3 AS ambientes, i AS dormitorios, 2 AS banos, site FROM c WHERE k = 0
  UNION ALL SELECT p, 2 * i - 1, 'card', 0, '/propiedad/' || pi || '1-casa-en-venta-zona' || w, 'Complejo grande ' || w, 95000 + i, 'ARS', NULL, 'casa', 'venta', zone || ' ' || pi || '1', NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 1
  UNION ALL SELECT p, 2 * i, 'card', 0, '/propiedad/' || pi || '2-local-en-alquiler-zona' || w, 'Unidad chica ' || w, 45000 + i, 'USD', NULL, 'local', 'alquiler', zone || ' ' || pi || '2', NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 1
  UNION ALL SELECT p, i, 'card', 9, '/oferta/' || pi || '-depto-en-alquiler', 'Departamento luminoso ' || w, NULL, NULL, NULL, 'departamento', 'alquiler', 'Oferta ' || pi, NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 2
  UNION ALL SELECT p, i, 'card', 16, '/propiedades/' || pi || '-terreno-en-venta-zona' || w, 'Terreno grande zona ' || w, 75000 + i, 'ARS', NULL, 'terreno', 'venta', zone || ' ' || pi, NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 3
  UNION ALL SELECT p, i, 'link', NULL, '/inmueble/' || pi || '-depto-en-alquiler-zona' || w, 'Ver departamento ' || i, NULL, NULL, zone, 'departamento', 'alquiler', zone, NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 4
  UNION ALL SELECT p, i, 'link', NULL, '/ficha/' || pi || '-galpon', 'Foto del galpon ' || i, NULL, NULL, 'Santa Fe', 'galpon', NULL, NULL, NULL, NULL, NULL, NULL, NULL, site FROM c WHERE k = 5)
SELECT p AS page_id, pos, way, rung, site || link AS url, titulo, precio, moneda, barrio, tipo_propiedad, operacion, direccion, imagen, metros, ambientes, dormitorios, banos FROM r WHERE site <> ''"""
)
def src08_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_cards.listing_cards(listing_pages(spark, sf_dir))


@query(
    rf"""
WITH {_PAGES}, c AS (SELECT *, p % 5 AS k FROM p, unnest(range(1, p % 3 + 2)) AS t(i))
SELECT p AS page_id, i AS pos, k AS rung, CASE k WHEN 2 THEN 'INMOBILIARIA ' || w || ' ' || i WHEN 3 THEN 'Inmobiliaria' || w || i ELSE 'Inmobiliaria ' || w || ' ' || i END AS nombre,
  CASE WHEN k <> 2 THEN 'https://directorio.example/inmobiliarias/' || w || '-' || p || i END AS perfil,
  CASE k WHEN 0 THEN 'https://cdn.example/empresas/' || p || '/' || i || '.jpg' WHEN 2 THEN 'https://cdn.example/' || p || '/' || i || '.png' END AS logo FROM c WHERE k < 4"""
)
def web12_directory_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_cards.directory_cards(directory_pages(spark, sf_dir), "https://directorio.example")


@query(
    rf"""
WITH {_PAGES}, c AS (SELECT *, p % 6 AS k, p % 7 + 1 AS r FROM p)
SELECT p AS page_id, url,
  CASE k WHEN 0 THEN 'Casa en venta ' || w WHEN 1 THEN 'Depto en alquiler ' || w WHEN 2 THEN 'Terreno ' || w WHEN 3 THEN 'Oficina ' || w WHEN 4 THEN 'Cochera ' || w END AS titulo, CASE k WHEN 0 THEN 'h1_class' WHEN 2 THEN 'in_title' WHEN 5 THEN NULL ELSE 'h1' END AS titulo_rule,
  CASE WHEN k = 0 THEN nullif(p * 100, 0) WHEN k = 1 THEN p * 1000 WHEN k = 3 THEN p * 100 + 50 END AS precio, CASE k WHEN 0 THEN CASE WHEN p > 0 THEN 'USD' END WHEN 1 THEN 'ARS' WHEN 3 THEN 'ARS' END AS moneda, CASE k WHEN 0 THEN CASE WHEN p > 0 THEN 'class_price' END WHEN 1 THEN 'strong' WHEN 3 THEN 'itemprop' END AS precio_rule,
  CASE k WHEN 0 THEN 'Mitre ' || p WHEN 2 THEN 'Roca ' || p ELSE '' END AS direccion, CASE k WHEN 0 THEN 'class_address' WHEN 2 THEN 'address' END AS direccion_rule,
  CASE k WHEN 0 THEN 'Zona ' || w ELSE 'Argentina' END AS barrio, CASE k WHEN 0 THEN 'barrio' ELSE 'city' END AS barrio_rule,
  CASE WHEN k <> 2 THEN r END::INT AS dormitorios, CASE k WHEN 0 THEN 'dl' WHEN 1 THEN 'li' WHEN 3 THEN 'class' WHEN 4 THEN 'text' WHEN 5 THEN 'li_text' END AS dormitorios_rule,
  CASE k WHEN 0 THEN 2 WHEN 1 THEN 2 WHEN 3 THEN 1 WHEN 4 THEN 1 END AS banos, CASE k WHEN 0 THEN 'dl' WHEN 1 THEN 'li_text' WHEN 3 THEN 'class' WHEN 4 THEN 'text' END AS banos_rule,
  CASE k WHEN 0 THEN 4 WHEN 2 THEN r WHEN 4 THEN 5 END::INT AS ambientes, CASE k WHEN 0 THEN 'dl' WHEN 2 THEN 'table' WHEN 4 THEN 'text' END AS ambientes_rule,
  CASE k WHEN 0 THEN 10 WHEN 1 THEN 60 WHEN 2 THEN 30 WHEN 3 THEN 20 WHEN 4 THEN 80 ELSE 70 END::INT + r::INT AS metros, CASE k WHEN 0 THEN 'dl' WHEN 1 THEN 'li' WHEN 2 THEN 'table' WHEN 3 THEN 'class' WHEN 4 THEN 'text' ELSE 'table' END AS metros_rule,
  CASE k WHEN 0 THEN 'local' WHEN 1 THEN 'departamento' WHEN 2 THEN 'terreno' WHEN 3 THEN 'oficina' WHEN 4 THEN 'cochera' ELSE 'casa' END AS tipo_propiedad, CASE k WHEN 0 THEN 'dl' ELSE 'text' END AS tipo_rule,
  CASE k WHEN 5 THEN 'Una casa con jardín al frente y patio detrás, cerca de todo: ' || w || '.' END AS descripcion, CASE k WHEN 5 THEN 'class_description' END AS descripcion_rule,
  CASE k WHEN 5 THEN '["' || site || '/a' || p || '.jpg","' || site || '/b' || p || '.jpg"]' ELSE '[]' END AS imagenes,
  CASE WHEN contains(lower(url), 'venta') THEN 'venta' WHEN contains(lower(url), 'alquiler') THEN 'alquiler' WHEN k = 0 THEN 'venta' WHEN k = 1 THEN 'alquiler' END AS operacion FROM c"""
)
def web07_detail_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_cards.detail_fields(detail_pages(spark, sf_dir))
