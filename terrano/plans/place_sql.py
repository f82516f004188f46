"""DuckDB SQL of the place queries. Expected addresses are stated shape by shape."""

from __future__ import annotations

from terrano.plans.listing_sql import AGENCIES, ERRORS, ITEMS, LISTINGS, QUEUE, RAW

RESPONSES = """resp AS (SELECT l_orderkey AS id, l_linenumber::BIGINT * 100000000 + l_partkey AS n, CASE WHEN l_returnflag <> 'R' THEN 'success' ELSE 'error' END AS status,
  CASE WHEN l_returnflag <> 'R' THEN (['exact', 'street', 'area', 'approximate'])[(l_orderkey + l_linenumber) % 4 + 1] END AS prec,
  CASE WHEN l_returnflag <> 'R' THEN -31.5::DOUBLE - (l_orderkey % 16) / 8.0::DOUBLE END AS lat, CASE WHEN l_returnflag <> 'R' THEN -60.5::DOUBLE - (l_linenumber % 4) / 16.0::DOUBLE END AS lon,
  (['Rosario', 'Santa Fe', 'Pueblo'])[l_orderkey % 3 + 1] AS ciudad FROM lineitem),
w AS (SELECT *, CASE ciudad WHEN 'Rosario' THEN lat BETWEEN -33.10::DOUBLE AND -32.80::DOUBLE AND lon BETWEEN -60.85::DOUBLE AND -60.50::DOUBLE
  WHEN 'Santa Fe' THEN lat BETWEEN -31.80::DOUBLE AND -31.45::DOUBLE AND lon BETWEEN -60.90::DOUBLE AND -60.45::DOUBLE END AS within FROM resp),
rated AS (SELECT *, CASE WHEN status <> 'success' OR within IS FALSE OR prec IN ('area', 'approximate') THEN 'low' WHEN prec = 'exact' THEN 'high' ELSE 'medium' END AS conf,
  CASE WHEN within THEN 'within_city_bounds' WHEN NOT within THEN 'coordenada_descartada_por_outlier' ELSE 'no_rule' END AS val FROM w),
best AS (SELECT * FROM rated QUALIFY row_number() OVER (PARTITION BY id ORDER BY CASE WHEN status <> 'success' THEN 0 WHEN conf = 'high' THEN 3 WHEN conf = 'medium' THEN 2 ELSE 1 END DESC,
  CASE WHEN status = 'success' THEN n ELSE -n END) = 1)"""
_REASONS = """nullif(concat_ws(',', CASE WHEN status <> 'success' THEN 'status_not_success' END, CASE WHEN lat IS NULL THEN 'missing_coordinates' END, CASE WHEN conf = 'low' THEN 'should_apply_false' END,
  CASE WHEN conf = 'low' THEN 'needs_review_true' END, CASE WHEN conf = 'low' THEN 'quality_flag_baja_confianza' END, CASE WHEN val <> 'within_city_bounds' THEN 'location_validation_not_within_city_bounds' END,
  CASE WHEN conf = 'low' THEN 'confidence_not_allowed' END), '')"""
FIELDS = f"""{AGENCIES}, fields AS (SELECT id, CASE WHEN id % 9 = 0 THEN NULL WHEN id % 7 = 0 THEN 'Sol' WHEN id % 5 = 0 THEN 'Obras ' || nombre WHEN id % 3 = 0 THEN 'Desarrollos Del Sur' ELSE 'Norte Propiedades' END AS nombre,
  id % 4 = 0 AS own, id % 4 = 3 AS no_web, id % 4 <> 0 AS has_city, id % 6 <> 0 AS has_prov, id % 3 = 0 AS good_phone, id % 3 = 2 AS no_phone, id % 2 = 0 AS has_address, categoria FROM agencies),
points AS (SELECT *, (CASE WHEN nombre IS NOT NULL THEN 15 ELSE 0 END) + 5 + 15 * own::INT + 10 * has_city::INT + 10 * has_prov::INT + 25 * good_phone::INT + 10 * has_address::INT + 5 + 2 * (id % 8 = 0)::INT AS points FROM fields)"""

SQL = {
    "str24_address": """WITH c AS (SELECT o_orderkey AS id, o_orderkey % 11 AS k, (o_orderkey + 100)::VARCHAR AS n, o_orderkey % 3 <> 1 AS placed, CASE o_orderkey % 3 WHEN 0 THEN 'Rosario' WHEN 2 THEN 'Santa Fe' END AS city FROM orders),
a AS (SELECT *, len(n) <= 5 AS fits, CASE WHEN k IN (0, 1) THEN 'Mitre ' || n WHEN k = 2 THEN 'Salta ' || n WHEN k = 3 AND len(n) <= 4 AND placed THEN 'Ruta 33 km ' || n WHEN k = 3 AND len(n) > 4 AND placed THEN 'Ruta 33'
  WHEN k = 4 THEN 'Mitre ' || n WHEN k = 6 THEN 'Av Pellegrini ' || n WHEN k = 9 THEN 'Catamarca ' || n END AS shown FROM c),
b AS (SELECT *, CASE WHEN k = 3 OR fits THEN CASE WHEN k IN (3, 4) AND NOT placed AND k = 3 THEN NULL ELSE shown END END AS address, CASE WHEN k = 2 THEN 'Rosario' WHEN k = 9 THEN 'Funes' END AS named FROM a)
SELECT id, coalesce(address, city, '') AS address, CASE WHEN address IS NULL THEN CASE WHEN placed THEN 'geocoding_ready_review' ELSE 'geocoding_not_ready' END WHEN k IN (2, 3, 4) THEN 'geocoding_ready_review' ELSE 'geocoding_ready_safe' END AS readiness,
  CASE WHEN address IS NOT NULL THEN 'direccion' WHEN placed THEN 'ciudad_provincia' ELSE 'none' END AS source,
  CASE WHEN address IS NOT NULL THEN concat_ws(', ', address, coalesce(named, city), CASE WHEN (named IS NOT NULL OR placed) AND coalesce(named, city) = 'Santa Fe' THEN 'Santa Fe' WHEN named IS NOT NULL OR placed THEN 'Santa Fe' END, 'Argentina')
    WHEN placed THEN CASE city WHEN 'Santa Fe' THEN 'Santa Fe, Argentina' ELSE city || ', Santa Fe, Argentina' END ELSE '' END AS query FROM b""",
    "str25_query_variants": """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'Pte. Roca ' || o_orderkey || '|Presidente Roca ' || o_orderkey || '|Roca ' || o_orderkey
  WHEN 1 THEN '1ro de Mayo ' || o_orderkey || '|Primero de Mayo ' || o_orderkey || '|1 de Mayo ' || o_orderkey ELSE 'Mitre ' || o_orderkey END AS variants FROM orders""",
    "sco12_best_geocode": f"WITH {RESPONSES} SELECT id, n, status, conf AS confidence_level, val AS location_validation FROM best",
    "sco13_apply_decision": f"WITH {RESPONSES} SELECT {_REASONS} AS skip_reason, count(*) AS n FROM rated GROUP BY 1",
    "sco14_outliers": f"""WITH {RESPONSES}, o AS (SELECT *, status = 'success' AND within IS FALSE AS bad FROM rated) SELECT CASE WHEN bad THEN 'error' ELSE status END AS status,
  CASE WHEN bad THEN 'geocoding_coordinates_discarded_by_outlier_validation' END AS error_message, count(*) AS n, count(*) FILTER (lat IS NOT NULL AND NOT bad) AS points FROM o GROUP BY 1, 2""",
    "sco16_geocoding_status": f"""WITH {RAW} SELECT CASE WHEN latitud IS NOT NULL AND longitud IS NOT NULL THEN 'done' WHEN direccion IS NULL AND (ciudad IS NOT NULL OR provincia IS NOT NULL) THEN 'skipped' ELSE 'pending' END AS estado,
  count(*) AS n FROM raw GROUP BY 1""",
    "pip13_apply_geocodes": f"""WITH {LISTINGS}, {RESPONSES}, g AS (SELECT id AS gid, lat, lon FROM best WHERE {_REASONS} IS NULL)
SELECT id, coalesce(lat, latitud) AS latitud, coalesce(lon, longitud) AS longitud FROM listings LEFT JOIN g ON gid = id""",
    "agg26_coordinate_audit": f"WITH {RESPONSES} SELECT CASE WHEN lat IS NULL THEN 'invalid_coordinates' WHEN within THEN 'within_bounds' WHEN NOT within THEN 'outside_bounds' ELSE 'no_bounds_configured' END AS state, count(*) AS n FROM w GROUP BY 1",
    "sco04_agency_confidence": f"WITH {FIELDS} SELECT id, points::INT AS points, length(coalesce(nombre, '')) < 5 OR regexp_matches(coalesce(nombre, ''), '[0-9]{{4}}') OR points < 30 OR NOT has_city AS revisar FROM points",
    "cat10_agency_category": f"""WITH {FIELDS} SELECT CASE WHEN id % 10 = 0 THEN categoria WHEN nombre LIKE 'Desarrollos%' THEN 'desarrolladora' WHEN nombre LIKE 'Obras%' THEN 'constructora' ELSE 'inmobiliaria' END AS categoria,
  count(*) AS n FROM fields GROUP BY 1""",
    "cat12_city_of_address": "SELECT o_orderkey AS id, (['Santa Fe', 'S2000 Rosario', '', ''])[o_orderkey % 4 + 1] AS ciudad FROM orders",
    "agg17_last_runs": f"""WITH {ITEMS}, r AS (SELECT DISTINCT run_id FROM items ORDER BY run_id DESC LIMIT 5), i AS (SELECT * FROM items WHERE run_id IN (FROM r)),
e AS (SELECT run_id, string_agg(error_type || '=' || k, ',' ORDER BY k DESC, error_type) AS errores FROM (SELECT run_id, coalesce(error_type, '') AS error_type, count(*) AS k FROM i WHERE status = 'error' GROUP BY ALL) GROUP BY 1)
SELECT run_id, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, count(*) FILTER (status = 'pending') AS pending, sum(nuevas)::BIGINT AS nuevas, coalesce(any_value(errores), '') AS errores
FROM i LEFT JOIN e USING (run_id) GROUP BY run_id""",
    "agg18_status_without": f"WITH {QUEUE} SELECT status, count(*) AS n FROM queue WHERE staging_id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') GROUP BY 1",
    "agg19_audit": f"""WITH {LISTINGS} SELECT count(*) AS total, count(*) FILTER (estado <> 'activa') AS estado, count(*) FILTER (n_imagenes = 0) AS imagenes, count(*) FILTER (moneda <> 'USD') AS moneda, count(*) FILTER (precio <= 0) AS precio,
  count(*) FILTER (area <= 0) AS superficie, count(*) FILTER ((latitud BETWEEN -35 AND -34 AND longitud BETWEEN -60 AND -58) IS NOT TRUE) AS caja FROM listings""",
    "agg20_problems": f"""WITH {FIELDS}, p AS (SELECT unnest([CASE WHEN nombre IS NULL THEN 'SIN NOMBRE' WHEN length(nombre) < 5 THEN 'NOMBRE MUY CORTO' WHEN regexp_matches(nombre, '[0-9]{{4}}') THEN 'NÚMERO EN NOMBRE' END,
  CASE WHEN no_phone THEN 'sin teléfono' END, CASE WHEN NOT has_address THEN 'sin dirección' END, CASE WHEN NOT has_city THEN 'sin ciudad' END, CASE WHEN NOT has_prov THEN 'sin provincia' END, CASE WHEN no_web THEN 'sin web' END,
  CASE WHEN points < 30 THEN 'confidence bajo' END]) AS problem FROM points) SELECT problem, count(*) AS n FROM p WHERE problem IS NOT NULL GROUP BY 1""",
    "agg22_enrichment_stats": f"""WITH {FIELDS} SELECT count(*) AS total, count(*) FILTER (own) AS con_web, count(*) FILTER (NOT good_phone) AS sin_telefono, count(*) FILTER (NOT has_prov) AS sin_provincia, sum(points)::DOUBLE / count(*) AS confianza FROM points""",
    "agg23_gates": f"WITH {ITEMS} SELECT run_id, count(*) AS n, count(*) FILTER (status = 'error') AS failed, count(*) FILTER (status = 'error') / count(*) AS rate, count(*) FILTER (status = 'error') / count(*) <= 0.15::DOUBLE AS ok FROM items GROUP BY 1",
    "agg25_top_sources": f"WITH {ERRORS} SELECT inmobiliaria_id, count(*) AS n FROM errors GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20",
    "agg28_stuck": f"WITH {QUEUE} SELECT staging_id FROM queue WHERE status = 'publishing' ORDER BY 1 LIMIT 5",
    "agg31_before_after": """WITH b AS (SELECT l_orderkey AS k, count(*) AS b FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1), a AS (SELECT l_orderkey AS k, count(*) AS a FROM lineitem WHERE l_returnflag = 'N' GROUP BY 1),
j AS (SELECT coalesce(b, 0) AS b, coalesce(a, 0) AS a FROM a FULL JOIN b USING (k)) SELECT CASE WHEN b = 0 AND a > 0 THEN 'recovered' WHEN b > 0 AND a = 0 THEN 'lost' WHEN a > b THEN 'gained' WHEN a < b THEN 'reduced' ELSE 'same' END AS change,
  count(*) AS n, sum(b)::BIGINT AS antes, sum(a)::BIGINT AS despues FROM j GROUP BY 1""",
}
