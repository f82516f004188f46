"""Queries of columns that read every order's captured shape as well, and whose columns reach each branch of the rule."""

import pytest

from terrano.plans import column_queries, registry, value_queries
from terrano.sources.adapters import table

#: Name: (table of the columns, conditions that some row of the columns meets each).
WHOLE = {
    "arr02_image_item": ("pages", ["id % 9 = 3 AND result LIKE 'http%'", "id % 9 = 4 AND result LIKE 'http%'", "id % 9 = 6 AND result IS NULL", "id % 9 = 8 AND result IS NULL"]),
    "cat02_import_operation": ("part", ["result = 'venta_y_alquiler'", "result = 'consultar'", "id % 27 = 5 AND result = 'venta'", "id % 27 = 18 AND result = 'alquiler_temporario'", "id % 27 = 22 AND result IS NULL"]),
    "cat05_type_name": ("part", [f"result = '{kind}'" for kind in ("departamento", "casa", "terreno", "local", "oficina", "cochera", "galpon", "otro")]),
    "cat07_page_type": ("customer", [f"result = '{kind}'" for kind in ("departamento", "casa", "ph", "terreno", "oficina", "local", "otro")]),
    "cat08_page_status": ("orders", [f"result = '{state}'" for state in ("activa", "pausada", "reservada", "vendida", "alquilada", "no_detectada_en_ultimo_scraping", "desconocida")]),
    "flt24_block": ("pages", ["result LIKE 'Captcha%'", "result LIKE '%cf-challenge%'", "result = 'HTTP 500 Server Error'", "id % 13 = 8 AND result IS NULL", "id % 13 = 12 AND result IS NULL"]),
    "jsn02_merge": ("events", ["id % 5 = 1 AND result LIKE '%,\"b\":{\"c\":[1,\"x\"],\"d\":%'", "id % 5 = 2 AND result NOT LIKE '%\"k\"%'", "id % 5 = 3 AND result NOT LIKE '%\"k\"%'", "result LIKE '{\"a\":null%'", "length(result) - length(replace(result, chr(92), '')) = 1"]),
    "joi18_host_place": ("pages", [f"result = '{place}'" for _, place in column_queries._HOSTS]),
    "num04_reviews": ("part", ["id % 7 = 1 AND result IS NULL", "id % 7 = 2 AND result IS NULL", "id % 7 = 4 AND result IS NULL", "id % 7 = 4 AND result > 9223372036854775799", "id % 7 = 5 AND result = id"]),
    "num05_int32": ("orders", ["result = 2147483647", "result = -2147483648", "id % 7 = 2 AND result < 0", "id % 7 = 3 AND result IS NULL", "id % 7 = 4 AND result IS NULL", "id % 7 = 1 AND result IS NULL"]),
    "str05_name_key": ("part", ["result LIKE 'nandu cia %'", "result LIKE 'sao paulo %'", "result LIKE 'aeiou u %'", "result LIKE 'olcu %'", "result LIKE 'nn%'", "result = ''"]),
    "str06_compare_key": ("customer", ["id % 13 = 5 AND result NOT LIKE '%raices%'", "id % 13 = 6 AND result NOT LIKE 'real%'", "result LIKE 'brokers%'", "result LIKE 'lopez__%'", "id % 8 = 2 AND result NOT LIKE '%srl'", "result LIKE '%sala'", "result IS NULL"]),
    "str14_licence": ("supplier", [f"id % {len(column_queries._LICENCES)} = {i} AND result " + ("IS NULL" if left is None else f"LIKE 'Supplier#_________{left}'") for i, (_, left) in enumerate(column_queries._LICENCES)]),
    "str15_garbled": ("documents", ["id % 3 = 0 AND text RLIKE '[^\\x00-\\x7f]' AND result = sha2(text, 256)", "id % 3 = 1 AND result = sha2('Ãxx ' || text, 256)"]),
    "str16_page_text": ("documents", ["id % 5 = 0 AND result = sha2('Peon ' || translate(text, 'áéíóúñÁÉÍÓÚÑ', 'aeiounAEIOUN') || ' Apto crédito', 256)", "id % 5 = 2 AND result = sha2('Propiedad sin título ' || rtrim(text), 256)", "id % 5 = 3 AND result = sha2('Propiedad sin título ' || rtrim(text), 256)"]),
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_job(spark, sf, name):
    of, conditions = WHOLE[name]
    sf = sf.replace("sf0.001", "sf0.01") if of == "supplier" else sf  # ten suppliers do not hold every ending
    key = column_queries.CASES[name][1]
    got = registry.QUERIES[name](spark, sf).cache()
    rows = got.where("origin <> 'shapes'").join(table(spark, sf, of).withColumnRenamed(key, "id"), "id")
    for origin in ("columns", "branches")[: 1 + (name in column_queries.BRANCHES)]:
        assert rows.where(column_queries.F.col("origin") == origin).count() == table(spark, sf, of).count()
    assert [c for c in conditions if rows.where(c).isEmpty()] == []
    shapes = got.where("origin = 'shapes'")
    assert shapes.count() == table(spark, sf, "orders").count() == shapes.select("id").distinct().count()
    of_shapes = value_queries.QUERIES[name](spark, sf).select("id", column_queries.F.expr(column_queries.SHAPES[name]).alias("result"))
    assert shapes.select("id", "result").exceptAll(of_shapes).isEmpty()
    got.unpersist()
