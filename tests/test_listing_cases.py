"""Hand-worked cases of the listing functions and operators."""

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from terrano.functions import normalize as N, urls as U
from terrano.operators import dedupe, lifecycle, merge, search
from terrano.sources.adapters import AS_OF, listings


def column(spark, values, of, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in rows.orderBy("i").select(of(F.col("x"))).collect()]


CASES = [
    (N.operation, {"venta": "venta", "VENTA": "venta", "en venta": "venta", "sale": "venta", "rent": "alquiler", "en alquiler": "alquiler", "temporaria": "alquiler_temporario", "vacation": "alquiler_temporario",
                   None: "consultar", "": "consultar", "  ": "consultar", "emprendimiento": "consultar", "0": "consultar", "venta o alquiler": "venta_y_alquiler", "sale and rent": "venta_y_alquiler"}),
    (N.display_operation, {"alquiler_temporario": "alquiler", "temporario": "temporario", None: "consultar", "venta y alquiler": "venta_y_alquiler", "inversion": "inversion"}),
    (N.price_amount, {"USD 120.000": 120000, "$ 1.200.000": 1200000, "Consultar": None, "1.200.000,50": 120000050, "280000": 280000, "0": None, None: None}),
    (N.price_currency, {"USD 120.000": "USD", "$ 1.200.000": "ARS", "US$100": "USD", "Consultar": None, "100": None}),
    (N.area_m2, {"80 m²": 80, "9 m2": None, "120 metros cuadrados": 120, "10000 m2": None, None: None}),
    (N.phone, {"3414123456": "+543414123456", "03414123456": "+543414123456", "543414123456": "+543414123456", "+54 9 341 412-3456": "+5493414123456", "4123456": "4123456", "123456": None}),
    (N.locale_number, {"1.234,5": 1234.5, "1234.5": 1234.5, "abc": None, "": None, None: None}),
    (N.transient_error, {"HTTP 429": True, "HTTP 404": False, "503 unavailable": True, "read timeout": True, "bad": False}),
    (N.clean, {"  a \t": "a", " ": None, None: None}),
    (U.canonical, {"HTTP://www.X.com:80//A/b/?utm_source=z&B=Q&a=1#f": "x.com/a/b?a=1&b=q", "x.com/A": "x.com/a", "http://u:p@h.com/": "h.com", "": "", None: ""}),
]


@pytest.mark.parametrize("of,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, of, cases):
    assert column(spark, list(cases), of) == list(cases.values())


def test_staging_variant_keeps_value_case(spark):
    assert column(spark, ["http://x.com/?A=Q"], lambda c: U.canonical(c, lower_values=False)) == ["x.com?a=Q"]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.text("xyzQ", min_size=1, max_size=3)), max_size=4, unique_by=lambda t: t[0]))
def test_canonical_ignores_order_and_is_stable(spark, items):
    make = lambda xs: "http://h.com/p" + ("?" + "&".join(f"{k}={v}" for k, v in xs) if xs else "")
    a, b = column(spark, [make(items), make(items[::-1])], U.canonical)
    assert a == b and column(spark, [a], U.canonical) == [a]


def test_secrets_never_survive(spark):
    raw = "postgresql://user:hunter2@db/x Authorization: Bearer abc.def eyJhbGciOi.eyJzdWIi12.sig-1 sk-abcdefgh12 /p?token=t0k&b=1 password=pw1"
    out = column(spark, [raw, None], N.redacted)
    assert not any(s in out[0] for s in ("hunter2", "abc.def", "eyJhbGciOi", "sk-abcdefgh12", "t0k", "pw1")) and "<redacted>" in out[0] and out[1] is None


def test_converted(spark):
    rows = spark.createDataFrame([(100.0, "USD"), (0.0, "USD"), (2.5, "ARS")], "p double, c string")
    got = rows.select(N.converted(F.col("p"), F.col("c"), "ARS", 1000.5), N.converted(F.col("p"), F.col("c"), "USD", 1.0), N.converted(F.col("p"), F.col("c"), "USD", 0.0)).collect()
    assert [tuple(r) for r in got] == [(100050, 100, None), (None, None, None), (3, 3, None)]


def test_token_search(spark):
    rows = spark.createDataFrame([("Casa en Córdoba, centro",), ("Depto",), (None,)], "x string")
    assert rows.where(N.matches_all(F.col("x"), "centro cordoba")).count() == 1 and rows.where(N.matches_all(F.col("x"), " ")).count() == 3


def test_priority(spark):
    rows = [(95, "done", 10.0, 1), (95, "done", None, 2), (50, "done", None, 2), (70, "pending", 5.0, 2), (69, "pending", 5.0, 3)]
    df = spark.createDataFrame(rows, "s int, g string, p double, want int")
    assert df.where(lifecycle.priority(F.col("s"), F.col("g"), F.col("p")) != F.col("want")).count() == 0


RAW = "id long, hash_dedup string, inmobiliaria_id string, url string, titulo string, precio string, moneda string, operacion string, ciudad string, provincia string, tipo_propiedad string, n_imagenes long, direccion string, latitud double, longitud double, pos long"


def test_incomplete_rows_are_never_rejected_and_bad_ones_do_not_block(spark):
    bare = lambda i, h, precio=None: (i, h, "9", "x.com/1", None, precio, "ARS" if precio else None, None, None, None, None, 0, None, None, None, i)
    rows = spark.createDataFrame([bare(1, "a"), bare(2, "b", "abc"), bare(3, "b", "5"), bare(4, "b", "6"), bare(5, "k")], RAW)
    known = spark.createDataFrame([("k",)], "hash_dedup string")
    got = {r["id"]: (r["status"], list(r["hard"]), r["validation_score"]) for r in lifecycle.validate(rows, known).collect()}
    assert got == {1: ("staging", [], 35), 2: ("rejected", ["invalid_price"], 35), 3: ("staging", [], 55), 4: ("rejected", ["duplicate"], 55), 5: ("rejected", ["duplicate"], 35)}


def test_rule_order_differs_between_queue_and_publish(spark):
    row = spark.createDataFrame([("h", "1", "u", "t", "venta", 10, "pending", "queued")], "hash_dedup string, inmobiliaria_id string, url string, titulo string, operacion string, validation_score int, geocoding_status string, status string")
    assert row.select(lifecycle.queue_skip_reason(60, False)).first()[0] == "skip_low_score"
    assert row.select(lifecycle.publish_skip_reason(60, False)).first()[0] == "geocoding_pending"


def test_office_addresses_need_more_than_half(spark):
    rows = [("a", "x")] * 4 + [("b", "x")] * 3 + [("b", f"y{i}") for i in range(3)] + [("c", "x")] * 4 + [("c", None)] * 2
    df = spark.createDataFrame(rows, "host string, direccion string")
    assert [tuple(r) for r in dedupe.office_addresses(df, "host", "direccion").collect()] == [("c", "x", 4, 6)]
    assert dedupe.drop_office_addresses(df, "host", "direccion").where("office_address").count() == 4


def test_most_complete_keeps_first_on_ties(spark):
    df = spark.createDataFrame([(1, "w", "a", None), (2, "w", None, "b"), (3, "v", None, None), (4, "v", "a", "b"), (5, None, "a", "b")], "id int, web string, p string, q string")
    assert {r["id"] for r in dedupe.most_complete(df, "web", ["p", "q"], "id").collect()} == {1, 4}
    assert {r["id"] for r in dedupe.most_complete(df, "web", ["p", "q"], "id", keep_keyless=True).collect()} == {1, 4, 5}


def test_fuzzy_pairs(spark):
    df = spark.createDataFrame([(1, "Inmobiliaria Norte"), (2, "Inmobiliaria Norte"), (3, "Inmobiliaria Nortes"), (4, "Otra")], "id int, name string")
    assert [tuple(r)[:2] for r in dedupe.fuzzy_pairs(df, "id", "name", F.left("name", F.lit(4))).collect()] == [(1, 3)]


def test_fuzzy_pairs_equal_brute_force(spark):
    from difflib import SequenceMatcher

    bases = ["inmobiliaria norte de rosario", "estudio gomez propiedades", "casa del sol", "abcdefghijklmnopqrstuvwxyz 0123456789"]
    names = {n for b in bases for i in range(len(b)) for n in (b, b[:i] + b[i + 1 :], b[:i] + "q" + b[i:], b[:i] + "z" + b[i + 1 :], "la " + b)}
    rows = list(enumerate(sorted({" ".join(n.split()) for n in names})))
    want = {(i, j) for i, a in rows for j, b in rows if i < j and SequenceMatcher(None, a, b).ratio() >= 0.92}
    assert any(rows[i][1][:8] != rows[j][1][:8] for i, j in want)
    df = spark.createDataFrame(rows, "id long, name string")
    got = [(r["id_a"], r["id_b"]) for r in dedupe.fuzzy_pairs(df, "id", "name", None, 0.92).collect()]
    assert sorted(got) == sorted(want)


def test_merge_and_history(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string"), spark.createDataFrame([(2, "b"), (3, "c")], "id int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(merge.upsert(old, new, ["id"])) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(merge.fill_missing(old, new, "id")) == [(1, "a"), (2, "b"), (3, "c")]
    assert rows(merge.history(old, new, "id", ["v"])) == [(2, "v", None, "b")]


def test_search_filters_reach_the_scan(spark, sf):
    f = search.Filters(equal={"moneda": "USD"}, at_least={"precio": 10.0})
    plan = search.search(listings(spark, sf), f, AS_OF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "ReadSchema" in plan
    assert f.count() == 2


def test_area_bounds_pass_unknown_area(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 30.0), (3, 80.0)], "id int, area double")
    assert {r["id"] for r in search.search(df, search.Filters(area=(50.0, None)), AS_OF).collect()} == {1, 3}


def test_cluster_halves_round_up(spark):
    df = spark.createDataFrame([(1, -2.5 * 0.25, 0.0)], "id int, latitud double, longitud double")
    assert search.cell(9) == 0.18 and search.cell(13) == 0.035
    assert df.select(F.floor(F.col("latitud") / 0.25 + 0.5)).first()[0] == -2
