"""DuckDB SQL of the listing queries."""

from __future__ import annotations

AS_OF = "TIMESTAMP '1998-08-01 00:00:00'"

LISTINGS = """listings AS (SELECT o_orderkey AS id, o_custkey AS inmobiliaria_id, CASE WHEN o_orderkey % 17 = 0 THEN 0.0 ELSE o_totalprice END AS precio,
  CASE WHEN o_orderkey % 3 = 0 THEN 'USD' ELSE 'ARS' END AS moneda,
  CASE o_orderstatus WHEN 'O' THEN 'activa' WHEN 'F' THEN 'vendida' ELSE 'reservada' END AS estado,
  CASE o_orderpriority[1] WHEN '1' THEN 'venta' WHEN '2' THEN 'alquiler' WHEN '3' THEN 'alquiler_temporario' WHEN '4' THEN 'consultar' ELSE 'venta_y_alquiler' END AS operacion,
  (['casa', 'departamento', 'terreno', 'local', 'oficina', 'cochera', 'otro'])[o_orderkey % 7 + 1] AS tipo,
  coalesce(area, 0.0) AS area, coalesce(n, 0) AS n_imagenes, o_orderkey % 6 AS ambientes, o_orderkey % 4 AS dormitorios,
  CASE WHEN o_orderkey % 11 <> 0 THEN -34.0::DOUBLE - (o_orderkey % 1000) / 512.0::DOUBLE END AS latitud,
  CASE WHEN o_orderkey % 11 <> 0 THEN -58.0::DOUBLE - (o_orderkey % 700) / 256.0::DOUBLE END AS longitud, o_orderdate AS created_at, o_orderpriority AS tier
  FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS area, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""
AGENCIES = """agencies AS (SELECT c_custkey AS id, c_name AS nombre, n_name AS ciudad, r_name AS provincia, c_mktsegment AS categoria
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
RAW = """raw AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 23 <> 0 THEN sha256((o_orderkey - o_orderkey % 41)::VARCHAR) END AS hash_dedup,
  CASE WHEN o_orderkey % 29 = 0 THEN '0' WHEN o_orderkey % 31 = 0 THEN 'x' ELSE o_custkey::VARCHAR END AS inmobiliaria_id,
  CASE WHEN o_orderkey % 37 <> 0 THEN CASE WHEN o_orderkey % 18 = 0 THEN 'https://www.tandil-hogar.com.ar' WHEN o_orderkey % 27 = 0 THEN 'https://saltamendoza.com' ELSE 'https://www.site' || (o_custkey % 50) || '.example.com' END || '/Propiedad/' || o_orderkey || '/' END AS url,
  CASE WHEN o_orderkey % 13 <> 0 THEN 'Propiedad ' || o_orderkey END AS titulo,
  CASE WHEN o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 19 = 0 THEN 'abc' WHEN o_orderkey % 17 = 0 THEN '0'
    WHEN o_orderkey % 5 = 0 THEN (floor(o_totalprice)::BIGINT // 1000) || '.' || lpad((floor(o_totalprice)::BIGINT % 1000)::VARCHAR, 3, '0') || ',5' ELSE floor(o_totalprice)::BIGINT::VARCHAR END AS precio,
  (['ARS', 'usd', 'USD', 'eur', 'ARS'])[o_orderkey % 5 + 1] AS moneda,
  (['venta', 'En Venta', 'ALQUILER', 'rent', 'temporario', 'venta y alquiler', 'emprendimiento', 'sale', ' ', 'sale and rent', 'consultar'])[o_orderkey % 11 + 1] AS operacion,
  CASE WHEN o_orderkey % 9 <> 0 THEN 'Ciudad ' || (o_orderkey % 20) END AS ciudad,
  CASE WHEN o_orderkey % 9 <> 0 AND o_orderkey % 4 <> 0 THEN 'Provincia ' || (o_orderkey % 5) END AS provincia,
  CASE WHEN o_orderkey % 14 <> 0 THEN 'Casa' END AS tipo_propiedad, o_orderkey % 4 AS n_imagenes,
  CASE WHEN o_orderkey % 6 = 0 THEN (['info@correo.example', 'Tel: 4123', 'Llamar al +54 341 412-3456', 'Depto a $ 85.000', '120.000 pesos', 'Mitre 1 2 3 ' || repeat('piso alto ', 9), 'Roca 250', 'Casa en Superficie lote 3'])[(o_orderkey // 6) % 8 + 1] WHEN o_orderkey % 8 <> 0 THEN 'Calle ' || (o_orderkey % 300) END AS direccion,
  CASE WHEN o_orderkey % 10 = 0 THEN -10.0 WHEN o_orderkey % 3 <> 0 THEN -34.5 END AS latitud, CASE WHEN o_orderkey % 3 <> 0 THEN -58.5 END AS longitud FROM orders)"""
# the words of the operations, as the rules list them
_OP = """CASE WHEN {o} IN ('venta', 'alquiler', 'alquiler_temporario', 'consultar', 'venta_y_alquiler') THEN {o} WHEN {o} IN ('sale', 'sell', 'compra', 'en venta', 'for sale') THEN 'venta'
    WHEN {o} IN ('alq', 'rent', 'rental', 'arrendamiento', 'locacion', 'locación', 'en alquiler', 'for rent') THEN 'alquiler'
    WHEN {o} IN ('temporario', 'temporal', 'temporaria', 'alquiler temporario', 'alquiler temporal', 'vacation', 'turistico', 'turístico', 'por dia', 'por día', 'por semana', 'short term') THEN 'alquiler_temporario'
    WHEN regexp_matches({o}, 'venta|sale|sell|compra') AND regexp_matches({o}, 'alquiler|rent') THEN 'venta_y_alquiler' ELSE 'consultar' END""".format(o="lower(trim(operacion))")
# reasons by the texts' own kinds, worked by hand: e-mail, phone word, phone, price, price alone, long with numbers, an address, surface
_REASON = "CASE WHEN direccion IS NULL OR starts_with(direccion, 'Calle') OR direccion = 'Roca 250' THEN NULL WHEN direccion = 'info@correo.example' THEN 'address_is_email' WHEN direccion LIKE '%+54%' THEN 'address_contains_phone' WHEN direccion LIKE 'Depto%' THEN 'address_contains_price' WHEN direccion LIKE '%pesos' THEN 'address_is_price' WHEN starts_with(direccion, 'Mitre') THEN 'address_too_long_numeric' ELSE 'contaminated_address' END"


def validated(known: str = "false") -> str:
    """CTEs up to ``v``: the validation of all raw rows. ``known``: condition of a hash that staging has."""
    return f"""{RAW},
n AS (SELECT *, try_cast(CASE WHEN contains(precio, ',') THEN replace(replace(precio, '.', ''), ',', '.') ELSE precio END AS DOUBLE) AS p, {_OP} AS op, coalesce({known}, false) AS known,
  (latitud BETWEEN -55 AND -21 AND longitud BETWEEN -74 AND -53) IS TRUE AS inside, ciudad IS NULL AND provincia IS NULL AND NOT (o_tandil AND url IS NOT NULL) AS no_place, ciudad IS NULL AND provincia IS NULL AND o_tandil AND url IS NOT NULL AS told, {_REASON} AS reason, direccion IS NULL OR {_REASON} IS NOT NULL AS no_address FROM (SELECT *, id % 18 = 0 AS o_tandil FROM raw)),
h AS (SELECT *, list_filter([CASE WHEN hash_dedup IS NULL THEN 'missing_hash' END, CASE WHEN coalesce(try_cast(inmobiliaria_id AS BIGINT), 0) <= 0 THEN 'missing_inmobiliaria_id' END,
  CASE WHEN url IS NULL THEN 'missing_url' END, CASE WHEN precio IS NOT NULL AND coalesce(p, 0) <= 0 THEN 'invalid_price' END,
  CASE WHEN p > 0 AND upper(moneda) NOT IN ('ARS', 'USD') THEN 'invalid_currency' END], lambda x: x IS NOT NULL) AS hard0 FROM n),
f AS (SELECT hash_dedup AS fh, min(id) AS first FROM h WHERE len(hard0) = 0 AND NOT known GROUP BY 1),
v AS (SELECT h.*, CASE WHEN known OR coalesce(id > first, false) THEN list_append(hard0, 'duplicate') ELSE hard0 END AS hard,
  list_filter([CASE WHEN no_place THEN 'missing_location' END, CASE WHEN told THEN 'location_inferred_from_text' END, CASE WHEN tipo_propiedad IS NULL THEN 'missing_type' END, CASE WHEN titulo IS NULL THEN 'missing_title' END,
    CASE WHEN n_imagenes = 0 THEN 'missing_images' END, CASE WHEN reason IS NOT NULL THEN 'invalid_address' END,
    CASE WHEN no_address AND NOT no_place THEN 'geocoding_skipped_approx_location' END, CASE WHEN (latitud IS NOT NULL OR longitud IS NOT NULL) AND NOT inside THEN 'invalid_coordinates' END,
    CASE WHEN op = 'consultar' AND trim(operacion) <> '' AND lower(trim(operacion)) <> 'consultar' THEN 'operacion_normalizada_consultar' END,
    CASE WHEN op = 'venta_y_alquiler' THEN 'operacion_venta_y_alquiler' END], lambda x: x IS NOT NULL) AS soft,
  greatest(0, 100 - 15 * no_place::INT - 15 * (tipo_propiedad IS NULL)::INT - 5 * (titulo IS NULL)::INT - 10 * (n_imagenes = 0)::INT - 20 * coalesce(p <= 0, true)::INT
    - 5 * (reason IS NOT NULL)::INT - 5 * (no_address AND NOT no_place)::INT - 10 * ((latitud IS NOT NULL OR longitud IS NOT NULL) AND NOT inside)::INT) AS score,
  CASE WHEN inside THEN 'done' WHEN no_address AND NOT no_place THEN 'skipped' ELSE 'pending' END AS geo FROM h LEFT JOIN f ON fh = hash_dedup)"""


ERRORS = """errors AS (SELECT event_id AS id, user_id % 10 AS run_id, user_id % 100 AS inmobiliaria_id, event_type AS fase, CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'warning' END AS severidad,
  CASE WHEN event_id % 5 = 0 THEN 'timeout' ELSE 'http_500' END AS error_type, CASE WHEN event_id % 4 <> 0 THEN event_id % 2 = 0 END AS recuperable, ts AS ocurrido_en FROM events)"""
ITEMS = """items AS (SELECT event_id AS id, user_id % 20 AS run_id, user_id % 300 AS inmobiliaria_id, CASE event_type WHEN 'error' THEN 'error' WHEN 'signup' THEN 'pending' ELSE 'success' END AS status,
  event_id % 40 AS detectadas, event_id % 7 AS nuevas, CASE WHEN event_type = 'error' THEN CASE WHEN event_id % 2 = 0 THEN 'timeout' ELSE 'parse' END END AS error_type FROM events)"""
QUEUE = """queue AS (SELECT o_orderkey AS staging_id, o_orderpriority[1]::INT AS priority, o_orderdate AS queued_at, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'done' ELSE 'publishing' END AS status,
  o_orderkey % 7 AS attempts FROM orders)"""
_SCORE = f"""CASE WHEN latitud IS NOT NULL AND longitud IS NOT NULL THEN 4.0::DOUBLE ELSE 0 END + CASE WHEN n_imagenes > 0 THEN 3.0::DOUBLE ELSE 0 END + CASE WHEN precio > 0 THEN 2.0::DOUBLE ELSE 0 END
  + greatest(0.0::DOUBLE, 1 - (epoch({AS_OF}) - floor(epoch(created_at))) / 2592000.0::DOUBLE)"""
_FOLD = "strip_accents(lower({x}))"
_KEY = "trim(regexp_replace(" + _FOLD + r", '[^\p{{L}}\p{{N}}]+', ' ', 'g'))"


def urls(source: str, lower: bool = True) -> str:
    """CTEs up to ``cu`` (id, c, h): canonical URLs of ``source`` (id, url), by the rules: decode, supply a scheme, cut user, port, www, parameters and fragment, decode path and query again."""
    names = "('fbclid', 'gclid', 'wbraid', 'gbraid', 'mc_cid', 'mc_eid')" if lower else "('fbclid', 'gclid', 'wbraid', 'gbraid')"
    value = "lower(trim(url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' '))))" if lower else "trim(url_decode(replace(substr(p, instr(p, '=') + 1), '+', ' ')))"
    shown = "replace(url_encode({x}), '%20', '+')" if lower else "{x}"
    tail = "rtrim({x}, '/')" if lower else "{x}"
    whole = "h || path || CASE WHEN len(q) > 0 THEN '?' || array_to_string(list_transform(q, lambda e: " + shown.format(x="e.k") + " || '=' || " + shown.format(x="e.v") + "), '&') ELSE '' END"
    return rf"""u0 AS (SELECT id, trim(url_decode(trim(coalesce(url, '')))) AS raw FROM ({source})),
u1 AS (SELECT id, raw, CASE WHEN regexp_matches(raw, '^(?i)https?://') THEN regexp_replace(raw, '^[^:]*://', '') ELSE ltrim(raw, '/') END AS r FROM u0),
u2 AS (SELECT id, raw, regexp_extract(r, '^[^/?#]*') AS n, regexp_replace(regexp_extract(r, '^[^/?#]*([^?#]*)', 1), ';[^/]*$', '') AS p, regexp_extract(r, '^[^?#]*\?([^#]*)', 1) AS qs FROM u1),
u3 AS (SELECT id, raw, regexp_replace(lower(trim(string_split(string_split(n, '@')[-1], ':')[1])), '^www\.', '') AS h, lower(rtrim(trim(regexp_replace(url_decode(p), '/+', '/', 'g')), '/')) AS path,
  list_filter(list_transform(list_filter(string_split(qs, '&'), lambda p: regexp_matches(p, '^[^=]*=.')), lambda p: {{'k': lower(trim(url_decode(replace(string_split(p, '=')[1], '+', ' ')))), 'v': {value}}}), lambda e: e.k NOT IN {names} AND NOT starts_with(e.k, 'utm_') {"AND e.k <> ''" if lower else ""}) AS q0 FROM u2),
u4 AS (SELECT id, raw, h, path, list_sort(q0) AS q FROM u3),
cu AS (SELECT id, CASE WHEN raw = '' THEN '' ELSE {tail.format(x=whole)} END AS c, CASE WHEN raw = '' THEN '' ELSE h END AS h FROM u4)"""


#: URLs with escapes, users, ports, blank values, letters beyond ASCII; K stands for the order's key.
URL_SHAPES = (
    "https://www.X.com/Casa%20en%20Venta/?b=2&a=A%26K", "HTTP://user:pw@Sub.Example.com:8080//Prop//K/?utm_source=x&Q=a+b&z=", "//cdn.site.com/á/Ñandú-K?ref=%C3%A1&gclid=1", "site.com.ar/p/K;v=2?id=K#foto",
    "https://x.com/100%25/K?x=%2520&y=a/b", "   ", "https://www.www.net?K=1&A=2&a=1", "https://x.com/a;b/c;d/K/?fbclid=2&msclkid=3&b=~_*-.%20", "https://x.com/%7Eme/K%2Fdetalle?q=%C3%A9&w=ñ%20ü", "/solo/ruta/K?b=1",
)


def url_shapes() -> str:
    shapes = ", ".join("'" + s + "'" for s in URL_SHAPES)
    return f"SELECT o_orderkey AS id, replace(([{shapes}])[o_orderkey % {len(URL_SHAPES)} + 1], 'K', o_orderkey::VARCHAR) AS url FROM orders"


_RECOVERABLE = "count(*) AS n, sum(recuperable::INT)::BIGINT AS recuperables, max(ocurrido_en) AS ultimo"
_CONVERT = "CASE WHEN precio > 0 THEN floor(CASE WHEN moneda = '{to}' THEN precio ELSE precio {op} 1000.5::DOUBLE END + 0.5)::BIGINT END"
_SPACES = r"[\s\p{Z}]"
_QSCORE = "score"

SQL = {
    "flt01_listing_search": f"WITH {LISTINGS} SELECT id, precio, tipo, estado FROM listings WHERE operacion = 'venta' AND moneda = 'ARS' AND precio BETWEEN 1 AND 150000 ORDER BY precio DESC, id LIMIT 50 OFFSET 20",
    "flt03_multi_filter": f"""WITH {LISTINGS}, {AGENCIES} SELECT l.id, nombre, ciudad, precio, area, tipo FROM listings l LEFT JOIN agencies a ON a.id = inmobiliaria_id
WHERE precio >= 50000 AND ambientes >= 1 AND (area <= 0 OR area >= 40) AND n_imagenes > 0 AND latitud IS NOT NULL AND estado NOT IN ('vendida', 'alquilada', 'no_detectada_en_ultimo_scraping') ORDER BY {_SCORE} DESC, l.id LIMIT 24""",
    "flt03_filters_all": f"""WITH {LISTINGS} SELECT id, precio, area, estado FROM listings WHERE tipo = 'casa' AND (area <= 0 OR area BETWEEN 50 AND 120) AND estado NOT IN ('vendida') AND created_at > {AS_OF} - INTERVAL 400 DAY""",
    "flt04_token_search": f"WITH k AS (SELECT doc_id, lang, {_KEY.format(x='text')} AS t FROM documents WHERE lang IN ('fr', 'es')) SELECT doc_id, lang FROM k WHERE contains(t, 'ete') AND contains(t, 'que')",
    "flt09_queue_classify": f"""WITH {validated()} SELECT CASE WHEN hash_dedup IS NULL THEN 'skip_missing_hash' WHEN coalesce(try_cast(inmobiliaria_id AS BIGINT), 0) <= 0 THEN 'skip_missing_inmobiliaria' WHEN url IS NULL THEN 'skip_missing_url'
WHEN lower(trim(operacion)) NOT IN ('venta', 'alquiler', 'alquiler_temporario', 'consultar', 'venta_y_alquiler') THEN 'skip_invalid_operation' WHEN {_QSCORE} < 60 THEN 'skip_low_score' WHEN geo NOT IN ('done', 'skipped') THEN 'skip_geocoding_pending' ELSE 'queued' END AS reason, count(*) AS n FROM v GROUP BY 1""",
    "flt10_publish_validate": f"""WITH {validated()} SELECT id, CASE WHEN id % 5 = 0 THEN 'invalid_staging_status' WHEN hash_dedup IS NULL THEN 'missing_hash' WHEN coalesce(try_cast(inmobiliaria_id AS BIGINT), 0) <= 0 THEN 'missing_inmobiliaria' WHEN url IS NULL THEN 'missing_url' WHEN titulo IS NULL THEN 'missing_title'
WHEN lower(trim(operacion)) NOT IN ('venta', 'alquiler', 'alquiler_temporario', 'consultar', 'venta_y_alquiler') THEN 'invalid_operation' WHEN score < 70 THEN 'low_score' END AS reason FROM v""",
    "flt11_retry_selection": f"""WITH {ITEMS}, b AS (SELECT DISTINCT inmobiliaria_id FROM items WHERE status = 'pending' AND run_id = 3),
c AS (SELECT *, CASE WHEN error_type <> 'timeout' THEN 'error_type' WHEN inmobiliaria_id IN (SELECT inmobiliaria_id FROM b) THEN 'pending' END AS r FROM items WHERE status = 'error'),
e AS (SELECT *, CASE WHEN r IS NULL AND row_number() OVER (PARTITION BY inmobiliaria_id, r IS NULL ORDER BY id) > 1 THEN 'repeated' ELSE r END AS reason FROM c),
g AS (SELECT *, coalesce(sum((reason IS NULL)::INT) OVER (ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e)
SELECT id, inmobiliaria_id, CASE WHEN reason IS NULL THEN 'create' ELSE 'skip' END AS decision, reason FROM g WHERE before < 60""",
    "flt28_transient_errors": """WITH m AS (SELECT lower('HTTP ' || (395 + event_id % 120) || ([' timeout', '', ' Max Retries exceeded', ' temporarily moved', ' RemoteDisconnected', ' WinError 10054', ' temporarily unavailable'])[event_id % 7 + 1]) AS t FROM events WHERE event_type = 'error')
SELECT CASE WHEN contains(t, '429') THEN true WHEN regexp_matches(t, '400|401|403|404|409|422') THEN false ELSE regexp_matches(t, '500|502|503|504|timeout|timed out|connection ?reset|max retries|remotedisconnected|connection aborted|temporarily unavailable|10054') END AS transient, count(*) AS n FROM m GROUP BY 1""",
    "srt05_newest": f"WITH {LISTINGS} SELECT id, created_at FROM listings ORDER BY created_at DESC, id LIMIT 40",
    "srt06_price_sort": f"WITH {LISTINGS} SELECT id, precio FROM listings ORDER BY precio <= 0, precio, id LIMIT 40",
    "srt07_area_rooms": f"WITH {LISTINGS} (SELECT id, area FROM listings ORDER BY area <= 0, area DESC, id LIMIT 30) UNION ALL (SELECT id, area FROM listings ORDER BY ambientes DESC, dormitorios DESC, id LIMIT 30)",
    "srt08_best_match": f"WITH {LISTINGS} SELECT id, round({_SCORE}, 6) AS score FROM listings ORDER BY {_SCORE} DESC, id LIMIT 40",
    "srt10_distinct_on": f"WITH {ITEMS} SELECT DISTINCT ON (inmobiliaria_id) inmobiliaria_id, run_id, id FROM items WHERE status = 'error' ORDER BY inmobiliaria_id, run_id DESC, id DESC",
    "srt12_two_pass": f"WITH {LISTINGS} SELECT CASE WHEN operacion = 'venta' THEN 1 ELSE 2 END AS pass, id FROM listings ORDER BY pass, precio DESC, id LIMIT 3000",
    "srt17_even_split": "WITH r AS (SELECT c_custkey, (row_number() OVER (ORDER BY c_custkey) - 1) // ceil(count(*) OVER () / 7.0)::BIGINT AS batch FROM customer) SELECT batch, count(*) AS n, min(c_custkey) AS first, max(c_custkey) AS last FROM r GROUP BY batch",
    "agg01_error_summary": f"WITH {ERRORS} SELECT run_id, fase, severidad, error_type, {_RECOVERABLE} FROM errors GROUP BY ALL",
    "agg02_error_by_agency": f"WITH {ERRORS} SELECT inmobiliaria_id, {_RECOVERABLE} FROM errors GROUP BY ALL",
    "agg03_status_distribution": f"WITH {LISTINGS} SELECT estado, count(*) AS n FROM listings GROUP BY 1 ORDER BY n DESC, estado",
    "agg04_invalid_values": f"WITH {RAW} SELECT count(*) FILTER (upper(moneda) NOT IN ('ARS', 'USD')) AS moneda, count(*) FILTER (lower(trim(operacion)) NOT IN ('venta', 'alquiler', 'alquiler_temporario', 'consultar', 'venta_y_alquiler')) AS operacion FROM raw",
    "agg05_stats": f"WITH {LISTINGS} SELECT least(count(*), 10000) AS total, least(count(*) FILTER (operacion = 'alquiler'), 10000) AS alquileres, least(count(*) FILTER (operacion = 'venta'), 10000) AS ventas, least(count(latitud), 10000) AS con_coordenadas FROM listings",
    "agg06_issue_counts": f"WITH {validated()} SELECT issue, count(*) AS n FROM (SELECT unnest(list_concat(hard, soft)) AS issue FROM v) GROUP BY 1",
    "agg07_run_rollup": f"""WITH {ITEMS} SELECT run_id, count(*) AS planificadas, count(*) FILTER (status = 'success') AS exitosas, count(*) FILTER (status = 'error') AS con_error, sum(detectadas) FILTER (status = 'success')::BIGINT AS detectadas,
sum(nuevas) FILTER (status = 'success')::BIGINT AS nuevas, count(*) FILTER (status IN ('pending', 'running')) = 0 AS cerrable FROM items GROUP BY 1""",
    "agg10_coverage": f"""WITH {LISTINGS}, {AGENCIES}, h AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_discount >= 0.08), c AS (SELECT provincia AS zona, count(*) AS detectadas, count(l_orderkey) AS cargadas
FROM listings l JOIN agencies a ON a.id = inmobiliaria_id LEFT JOIN h ON l_orderkey = l.id GROUP BY 1) SELECT *, detectadas - cargadas AS faltantes, floor(cargadas * 1000 / detectadas + 0.5) / 10 AS pct FROM c""",
    "agg11_zones": f"WITH {AGENCIES} SELECT count(DISTINCT ciudad) AS zonas FROM agencies",
    "agg12_facets": f"WITH {LISTINGS}, v AS (SELECT * FROM listings WHERE operacion = 'venta') SELECT 'tipo' AS facet, tipo AS value, count(*) AS n FROM v GROUP BY 2 UNION ALL SELECT 'moneda', moneda, count(*) FROM v GROUP BY 2 UNION ALL SELECT 'estado', estado, count(*) FROM v GROUP BY 2",
    "agg14_clusters": "SELECT floor(embedding[1]::DOUBLE / 0.035::DOUBLE + 0.5)::BIGINT AS lat_cell, floor(embedding[2]::DOUBLE / 0.035::DOUBLE + 0.5)::BIGINT AS lon_cell, count(*) AS n FROM embeddings WHERE embedding[1] IS NOT NULL AND embedding[2] IS NOT NULL GROUP BY 1, 2",
    "agg15_bounds": f"WITH {LISTINGS} SELECT min(latitud) AS lat_min, max(latitud) AS lat_max, min(longitud) AS lon_min, max(longitud) AS lon_max FROM listings",
    "agg16_health": f"WITH {LISTINGS} SELECT count(*) AS total, count(*) FILTER (n_imagenes > 0) AS con_imagenes, count(*) FILTER (precio > 0) AS con_precio, count(latitud) AS con_coordenadas, count(*) - count(latitud) AS sin_coordenadas FROM listings",
    "agg29_zone_price": f"WITH {LISTINGS} SELECT tipo, floor(avg((precio / area)::DECIMAL(18, 4)) + 0.5)::BIGINT AS precio_m2 FROM listings WHERE area > 0 AND precio > 0 AND moneda = 'USD' GROUP BY 1",
    "agg30_named_clusters": f"WITH {LISTINGS}, {AGENCIES} SELECT ciudad AS name, count(*) AS n, min(l.id) AS first_id FROM listings l JOIN agencies a ON a.id = inmobiliaria_id GROUP BY 1 HAVING count(*) > 1 ORDER BY first_id LIMIT 3",
    "ded01_canonical_url": f"WITH {urls(url_shapes() + ' UNION ALL SELECT -1 - page_id, url FROM pages')} SELECT id, c AS url_normalizada FROM cu",
    "ded02_staging_url": f"WITH {urls(url_shapes() + ' UNION ALL SELECT -1 - page_id, url FROM pages', False)} SELECT id, c AS url_staging FROM cu",
    "ded03_identity_hash": f"""WITH {urls(url_shapes())} SELECT id, sha256((id % 10) || CASE WHEN c <> '' THEN '|url|' || c WHEN id % 3 = 0 THEN '|id_externo|ab' || id ELSE '|sin_identidad|' END)[1:32] AS hash_dedup FROM cu""",
    "ded04_first_wins": "SELECT doc_id, source FROM documents WHERE text IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
    "ded05_most_complete": f"""WITH {RAW}, s AS (SELECT 'w' || (id % 997) AS web, id, (titulo IS NOT NULL)::INT + (precio IS NOT NULL AND precio NOT IN ('', '0', '0.0'))::INT + (ciudad IS NOT NULL)::INT + (provincia IS NOT NULL)::INT + (direccion IS NOT NULL)::INT + (url IS NOT NULL)::INT AS completeness FROM raw WHERE id % 50 <> 0)
SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY web ORDER BY completeness DESC, id) = 1""",
    "ded07_cross_agency": "WITH f AS (SELECT l_partkey, l_suppkey, first_value(l_suppkey) OVER (PARTITION BY l_partkey ORDER BY l_orderkey * 10 + l_linenumber) AS f FROM lineitem) SELECT l_partkey, count(*) FILTER (l_suppkey <> f) AS n_cross, count(*) AS n FROM f GROUP BY 1",
    "ded10_office_address": "WITH e AS (SELECT o_custkey AS host, o_orderpriority AS direccion, count(*) AS n FROM orders GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY host)::BIGINT AS total FROM e) SELECT * FROM t WHERE total >= 5 AND n > 0.5 * total",
    "ded11_dup_groups": "SELECT md5(text) AS h, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "joi03_run_scope": f"WITH {LISTINGS}, {ITEMS} SELECT id, inmobiliaria_id FROM listings WHERE inmobiliaria_id IN (SELECT inmobiliaria_id FROM items WHERE run_id = (SELECT max(run_id) FROM items WHERE status = 'success'))",
    "joi04_queue_flag": f"WITH {LISTINGS}, {QUEUE} SELECT operacion, count(staging_id) AS ya_en_cola, count(*) - count(staging_id) AS nuevas FROM listings LEFT JOIN (SELECT DISTINCT staging_id FROM queue WHERE status IN ('pending', 'publishing')) ON staging_id = id GROUP BY 1",
    "joi07_theta": "SELECT l_suppkey, count(*) AS n FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_partkey = a.l_partkey AND b.l_suppkey <> a.l_suppkey) GROUP BY 1",
    "joi08_resolve": f"""WITH {urls("SELECT page_id * 2 AS id, CASE WHEN page_id % 5 = 0 THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*$', '') ELSE url END AS url FROM pages UNION ALL SELECT page_id * 2 + 1, CASE WHEN page_id % 2 = 0 THEN regexp_replace(regexp_extract(url, '^([^?#]*)', 1), '/[^/]*$', '') ELSE url END FROM pages WHERE page_id % 3 = 0")},
p AS (SELECT id // 2 AS id, c, h FROM cu WHERE id % 2 = 0), s AS (SELECT id // 2 AS id, c, h FROM cu WHERE id % 2 = 1)
SELECT id AS page_id, coalesce((SELECT min(id) FROM s WHERE s.c = p.c), (SELECT min(id) FROM s WHERE s.h = p.h HAVING count(*) = 1), (SELECT min(id) FROM s WHERE s.h = p.h AND (starts_with(s.c, p.c) OR starts_with(p.c, s.c)))) AS source_id FROM p""",
    "joi16_bbox": f"WITH {LISTINGS}, b AS (SELECT tipo, min(latitud) AS lo, min(latitud) + 1.0::DOUBLE AS hi FROM listings GROUP BY 1) SELECT tipo, count(*) FILTER (latitud BETWEEN lo AND hi) AS dentro, count(*) FILTER (latitud NOT BETWEEN lo AND hi) AS fuera FROM listings JOIN b USING (tipo) WHERE latitud IS NOT NULL GROUP BY 1",
    "joi21_anti": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)",
    "ups01_merge": f"WITH {LISTINGS} SELECT id, precio, estado FROM listings WHERE id % 3 <> 0 AND id % 2 <> 0 UNION ALL SELECT id, precio + 1, 'activa' FROM listings WHERE id % 2 = 0",
    "ups02_disappeared": f"WITH {LISTINGS} SELECT CASE WHEN id % 4 <> 0 THEN estado ELSE 'no_detectada_en_ultimo_scraping' END AS estado, count(*) AS n FROM listings GROUP BY 1",
    "ups03_history": f"""WITH {LISTINGS} SELECT id, 'estado' AS campo, estado AS valor_anterior, 'alquilada' AS valor_nuevo FROM listings WHERE id % 10 = 0 AND estado <> 'alquilada'
UNION ALL SELECT id, 'ambientes', ambientes::VARCHAR, NULL FROM listings WHERE id % 15 = 0""",
    "ups04_fill_missing": f"WITH {AGENCIES} SELECT id, CASE WHEN id % 4 = 0 OR id % 3 = 0 THEN ciudad END AS ciudad FROM agencies WHERE id % 2 = 0 OR id % 3 = 0",
    "set01_set_ops": """WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000)
SELECT CASE WHEN a.k IS NULL THEN 'second_only' WHEN b.k IS NULL THEN 'first_only' ELSE 'both' END AS part, count(*) AS n FROM a FULL JOIN b ON a.k = b.k GROUP BY 1""",
    "sco01_validation_score": f"""WITH {validated("hash_dedup IN (SELECT r.hash_dedup FROM raw r WHERE r.id % 401 = 0 AND r.hash_dedup IS NOT NULL)")}
SELECT id, score AS validation_score, geo AS geocoding_status, CASE WHEN len(hard) = 0 THEN 'staging' ELSE 'rejected' END AS status, op AS operacion_norm, CASE WHEN p > 0 THEN p END AS precio_num, array_to_string(hard, ',') AS hard, array_to_string(soft, ',') AS soft FROM v""",
    "sco06_priority": f"WITH {validated()} SELECT CASE WHEN score >= 90 AND geo = 'done' AND coalesce(p > 0, false) THEN 1 WHEN score >= 70 OR geo = 'done' AND coalesce(p <= 0, true) THEN 2 ELSE 3 END AS priority, count(*) AS n FROM v GROUP BY 1",
    "srt02_claim": f"WITH {QUEUE} SELECT staging_id, priority, 'publishing' AS status FROM queue WHERE status = 'pending' ORDER BY priority, queued_at, staging_id LIMIT 100",
    "dat02_stale_reclaim": f"""WITH {QUEUE}, s AS (SELECT *, status = 'publishing' AND queued_at < {AS_OF} - INTERVAL 30 MINUTE AND attempts < 5 AS stale FROM queue)
SELECT CASE WHEN stale THEN 'pending' ELSE status END AS status, attempts + stale::INT AS attempts, count(*) AS n FROM s GROUP BY 1, 2""",
    "pip11_retention": f"WITH {QUEUE} SELECT status, count(*) AS n FROM queue WHERE NOT (status = 'done' AND queued_at < {AS_OF} - INTERVAL 7 DAY) GROUP BY 1",
    "str01_clean": rf"""WITH r AS (SELECT doc_id, ' ' || chr(9) || text || chr(10) || '  ' AS t FROM documents), c AS (SELECT doc_id, nullif(regexp_replace(t, '^{_SPACES}+|{_SPACES}+$', '', 'g'), '') AS limpio, t FROM r)
SELECT doc_id, limpio, nullif(regexp_replace(limpio, '{_SPACES}+', ' ', 'g'), '') AS junto FROM c""",
    "str07_search_key": f"SELECT doc_id, md5({_KEY.format(x=chr(39).join(['coalesce(text, ', '', ')']))}) AS h FROM documents",
    "str27_redact": r"""WITH r AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace('get http://u:p@h/x?token=abc&b=1 password: ' || coalesce(text, '') || ' sk-abcdef123456 Authorization: Bearer xyz',
'(://)[^@/\s]+(@)', '\1<redacted>\2', 'g'), '(?i)(authorization\s*:\s*bearer\s+)\S+', '\1<redacted>', 'g'), 'eyJ[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]{6,}\.[A-Za-z0-9_\-]+', '<redacted_jwt>', 'g'), 'sk-[A-Za-z0-9]{8,}', '<redacted_token>', 'g'),
'(?i)([?&](?:apikey|api_key|access_token|token|password|passwd|key|secret)=)[^&\s#]+', '\1<redacted>', 'g'), '(?i)\b(service_role|api[_-]?key|password|passwd|secret|token)\b\s*[=:]\s*\S+', '\1=<redacted>', 'g') AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) > 4000 THEN t[1:4000] || '...[truncated]' ELSE t END AS seguro FROM r""",
    "tel01_phone": """WITH r AS (SELECT o_orderkey AS id, regexp_replace((['0' || (3410000000 + o_orderkey), '549' || (3410000000 + o_orderkey), (o_orderkey % 900000 + 100000)::VARCHAR, (3410000000 + o_orderkey)::VARCHAR, '54' || (3410000000 + o_orderkey), (o_orderkey % 9000000 + 1000000)::VARCHAR])[o_orderkey % 6 + 1], '[^0-9]', '', 'g') AS d FROM orders)
SELECT id, CASE WHEN length(d) = 10 THEN '+54' || d WHEN length(d) = 11 AND d[1] = '0' THEN '+54' || d[2:] WHEN length(d) = 12 AND starts_with(d, '54') OR length(d) = 13 AND starts_with(d, '549') THEN '+' || d WHEN length(d) >= 7 THEN d END AS telefono FROM r""",
    "eml01_emails": r"""WITH e AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)) AS a FROM documents)
SELECT doc_id, array_to_string(list_filter(a, lambda x, i: list_position(a, x) = i), ',') AS emails FROM e WHERE len(a) > 0""",
    "num01_locale_number": f"WITH {RAW} SELECT id, try_cast(CASE WHEN contains(precio, ',') THEN replace(replace(precio, '.', ''), ',', '.') ELSE precio END AS DOUBLE) AS precio FROM raw",
    "num02_price_text": r"""WITH r AS (SELECT o_orderkey AS id, (['USD ' || floor(o_totalprice)::BIGINT, '$ 1.200.' || lpad((o_orderkey % 1000)::VARCHAR, 3, '0'), 'Consultar', 'US$' || floor(o_totalprice)::BIGINT, floor(o_totalprice)::BIGINT || ' pesos', '1.200.000,' || (o_orderkey % 90 + 10)])[o_orderkey % 6 + 1] AS t FROM orders),
g AS (SELECT *, regexp_extract(t, '[0-9]{1,3}(?:[.,][0-9]{3})+(?:[.,][0-9]+)?') AS a FROM r), n AS (SELECT *, try_cast(regexp_replace(CASE WHEN a <> '' THEN a ELSE regexp_extract(t, '[0-9]+') END, '[.,]', '', 'g') AS BIGINT) AS v FROM g)
SELECT id, CASE WHEN t <> 'Consultar' AND v > 0 THEN v END AS precio, CASE WHEN t = 'Consultar' THEN NULL WHEN regexp_matches(upper(t), '\b(USD|US\$|U\$S|DÓLAR|DOLAR)\b') THEN 'USD' WHEN regexp_matches(upper(t), '\b(ARS|PESO|PESOS)\b|\$') THEN 'ARS' END AS moneda FROM n""",
    "num03_area": r"""WITH r AS (SELECT o_orderkey AS id, try_cast(regexp_extract(lower('Casa de ' || (o_orderkey % 1200) || ([' m2', 'm²', ' metros cuadrados', ' m2x', ' ha'])[o_orderkey % 5 + 1] || ' y patio'), '([0-9]{1,4})\s*(?:m2|m²|mts2|metros cuadrados)(?:[^a-z0-9_]|$)', 1) AS INT) AS a FROM orders)
SELECT id, CASE WHEN a BETWEEN 10 AND 10000 THEN a END AS area FROM r""",
    "num06_currency": f"WITH {LISTINGS} SELECT id, {_CONVERT.format(to='ARS', op='*')} AS ars, {_CONVERT.format(to='USD', op='/')} AS usd FROM listings",
    "num09_compact_price": f"""WITH {LISTINGS}, p AS (SELECT id, moneda, floor(precio * (id % 100))::BIGINT AS p FROM listings), q AS (SELECT *, floor(p / 100000.0::DOUBLE + 0.5)::BIGINT AS t FROM p)
SELECT id, CASE WHEN p <= 0 THEN 'Consultar' WHEN p >= 10000000 THEN moneda || ' ' || floor(p / 1000000.0::DOUBLE + 0.5)::BIGINT || 'M' WHEN p >= 1000000 THEN moneda || ' ' || (t // 10) || CASE WHEN t % 10 > 0 THEN ',' || (t % 10) ELSE '' END || 'M'
WHEN p >= 100000 THEN moneda || ' ' || floor(p / 1000.0::DOUBLE + 0.5)::BIGINT || 'k' ELSE moneda || ' ' || p END AS etiqueta FROM q""",
    "cat01_operation": f"WITH {RAW} SELECT id, {_OP} AS operacion FROM raw",
    "cat03_display_operation": f"""WITH {RAW}, k AS (SELECT id, lower(trim(operacion)) AS k FROM raw) SELECT id, CASE WHEN contains(k, 'venta_y_alquiler') OR k = 'venta y alquiler' THEN 'venta_y_alquiler' WHEN contains(k, 'alquiler') THEN 'alquiler' WHEN contains(k, 'tempor') THEN 'temporario' WHEN contains(k, 'inver') THEN 'inversion'
WHEN contains(k, 'consultar') THEN 'consultar' WHEN contains(k, 'venta') THEN 'venta' ELSE 'consultar' END AS operacion FROM k""",
    "cat06_property_type": "SELECT o_orderkey AS id, (['casa', 'departamento', 'terreno', 'departamento', 'galpon', 'oficina', 'otro', 'casa'])[o_orderkey % 8 + 1] AS tipo FROM orders",
    "prj13_price_m2": f"WITH {LISTINGS} SELECT id, CASE WHEN precio > 0 AND area > 0 THEN floor(precio / area + 0.5)::BIGINT END AS precio_m2 FROM listings",
    "html01_links": r"""WITH e AS (SELECT page_id, regexp_extract_all(coalesce(html, ''), '<a\s[^>]*href="([^"]*)"', 1) AS a FROM pages), u AS (SELECT page_id, list_filter(a, lambda x, i: list_position(a, x) = i) AS a FROM e)
SELECT page_id, len(a) AS n_links, md5(array_to_string(a, ' ')) AS h FROM u""",
    "web01_pages": """WITH l AS (SELECT page_id, lower(coalesce(html, '')[1:60000]) || ' ' || lower(url) AS t, lower(coalesce(html, '')[1:5000]) AS h FROM pages) SELECT CASE WHEN regexp_matches(t, 'tokkobroker\\.com|tokkowidget|tokko_key|api\\.tokkobroker|tokko-widget|data-tokko|tokko\\.com') THEN 'tokko'
WHEN regexp_matches(t, 'wp-content/|wp-includes/|/wp-json/|wp-login\\.php') THEN 'wordpress' WHEN regexp_matches(t, 'wix\\.com|_wixcidx|wixstatic|wixsite') THEN 'wix' ELSE 'custom' END AS cms,
page_id % 10 = 0 OR regexp_matches(h, 'cloudflare|checking your browser|ray id|turnstile|captcha|ddos-guard|just a moment|verifying you are human') AS antibot, count(*) AS n FROM l GROUP BY 1, 2""",
    "web10_pages": r"""WITH l AS (SELECT page_id, url, coalesce(html, '') AS t FROM pages), a AS (SELECT *, regexp_extract_all(t, '<a href="([^"]*)"', 1) AS hrefs FROM l)
SELECT page_id, len(list_filter(hrefs, lambda h: regexp_matches(lower(h), '/propiedad|/property|/properties|/inmueble|/ficha|/detalle|/listing|/ad/'))) AS detalles,
CASE WHEN t = '' THEN 'desconocido' WHEN regexp_matches(t, 'infinite|lazyload|loadmore|cargar-mas') THEN 'scroll_infinito' WHEN regexp_matches(url, '(?i)[?&](page|pagina|p|pg)=\d+|/page[/-]\d+') THEN 'url' WHEN regexp_matches(lower(t), 'siguiente|next|pagination|paginacion') THEN 'click' ELSE 'url' END AS paginas,
array_to_string(list_filter(list_transform(regexp_extract_all(regexp_replace(regexp_replace(t, '(?s)<(script|style).*?</(script|style)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}'), lambda x: lower(x)), lambda x: NOT regexp_matches(x, 'example@|noreply@|no-reply@|test@|email@|correo@')), ',') AS emails,
NULL::VARCHAR AS listado, NULL::VARCHAR AS siguiente FROM a""",
    "stm01_stream_rollup": "SELECT date_trunc('day', ts)::TIMESTAMP AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stm08_first_seen": f"WITH {ITEMS} SELECT DISTINCT run_id, inmobiliaria_id FROM items",
}
