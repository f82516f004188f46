"""Agencies, listing pages and reports, hand-worked."""

import pytest
from pyspark.sql import functions as F

from terrano.functions import agencies as G, pages as P
from terrano.operators import reports

PAGE = """<html><head><title>T &amp; x</title><script type="application/ld+json">[{"name": " Casa  Sur", "offers": {"price": "120"}}]</script></head><body class="a tipo-local-comercial">
<div class='b operacion-alquiler'><h1>Casa <b>Norte</b></h1><img src="/logo.png"><img alt="x" src="/a.JPG"><img src='data:image/png;x'><p>corto</p><p>%s</p><script>var a='venta'</script>USD 99.000</div></body>""" % ("largo " * 20)
CASES = [
    (G.name, {"4,5 Norte  google maps ·": "Norte", "ab": None, None: None, "Sur": "Sur"}),
    (G.own_site, {"https://www.norte.com": True, "https://www.facebook.com/x": False, "norte.com": False, None: False, "http://a.b": False, "": False}),
    (G.valid_phone, {"341-4123456": True, "12": False, None: False, "1" * 16: False}),
    (G.category_of_query, {"constructora rosario": "constructora", "x": "desarrolladora", None: "desarrolladora"}),
    (G.city_of_address, {"Mitre 1, Rosario, 2000": "Rosario", "Mitre 1": "", None: "", "a, bcd , 12": "bcd"}),
    (P.type_of_classes, {PAGE: "local", '<p class="tipo-x tipo-galpon">': "galpon", '<p class="property_types-zzz tipo-casa">': "otro", "": None, None: None}),
    (P.operation_of_classes, {PAGE: "alquiler", "<p>": None, None: None}),
    (P.photos, {PAGE: ["/a.JPG"], None: []}),
    (P.text_of, {"<p>a&nbsp;<b>b</b></p><style>x</style>": "a b", "": None, None: None}),
    (P.detail, {PAGE: ("Casa  Sur", "120", "alquiler", "local", ("largo " * 20).strip(), 1), None: (None, None, None, None, None, 0), "<title>Lote en venta</title>$ 5.000": ("Lote en venta", "$ 5.000", "venta", "lote", None, 0)}),
]


@pytest.mark.parametrize("of,cases", CASES, ids=[f.__name__ for f, _ in CASES])
def test_cases(spark, of, cases):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(cases)], "i int, x string")
    got = [r[0] for r in rows.orderBy("i").select(of(F.col("x"))).collect()]
    assert [tuple(g) if isinstance(g, tuple) else g for g in got] == list(cases.values())


def test_category_and_place(spark):
    df = spark.createDataFrame([("Fideicomiso Sur", None, "desarrolladora"), ("Obras y más", "none", "constructora"), (None, "Inmobiliaria", "inmobiliaria"), ("Obras", "banco", "banco")], "n string, c string, want string")
    assert df.where(G.category(F.col("n"), F.col("c")) != F.col("want")).count() == 0
    df = spark.createDataFrame([("inmobiliarias en cordoba barrio nueva  cordoba",), (None,)], "q string")
    got = df.select(G.place_of_query(F.col("q"), {"cordoba": "Córdoba", "salta": "Salta"}, ("venta",))).collect()
    assert [tuple(r[0]) for r in got] == [("Córdoba", "Nueva"), ("", "")]


def test_site_and_enrichment(spark):
    df = spark.createDataFrame([("Inmobiliaria Norte", "norte.com", None, None, True), ("Sur Propiedades", "https://x.com", "llame al 412-3456", "341 4123456", True), ("Este", "https://x.com", None, None, False), (None, None, "real estate", None, True)],
                               "n string, u string, t string, p string, want boolean")
    assert df.where(G.site_confirmed(F.col("n"), F.col("u"), F.col("t"), F.col("p")) != F.col("want")).count() == 0
    rows = [("https://norte.com.ar", "R", None, None, None, "1234567", None, True, True, (50 + 30, "requiere_revision_enriquecimiento", None, "1234567", None)),
            (None, "R", None, None, "https://norte.com.ar", None, "Mitre 1", True, True, (80, "enriquecido", "https://norte.com.ar", None, "Mitre 1")),
            (None, "R", "1", "2", "https://a.com.ar", None, None, False, True, (40, "sin_resultados_enriquecimiento", None, None, None)),
            (None, None, None, None, "https://a.com.ar", "1", None, True, True, (0, "sin_resultados_enriquecimiento", None, None, None))]
    df = spark.createDataFrame([(i, *r[:9]) for i, r in enumerate(rows)], "i int, w string, c string, t string, d string, fw string, ft string, fd string, ok boolean, sim boolean")
    made = G.enrichment({"web": F.col("w"), "ciudad": F.col("c"), "provincia": F.lit(None), "telefono": F.col("t"), "direccion": F.col("d")}, {"web": F.col("fw"), "telefono": F.col("ft"), "direccion": F.col("fd")}, F.col("ok"), F.col("sim"))
    assert [tuple(r[0]) for r in df.orderBy("i").select(made).collect()] == [r[9] for r in rows]


def test_reports_on_empty_tables(spark):
    empty = spark.createDataFrame([], "run_id long, status string, error_type string, nuevas long, id long, provincia string")
    assert reports.last_runs(empty).count() == 0 and reports.gate(empty, ["run_id"], F.col("status") == "error", 0.1).count() == 0
    assert tuple(reports.audit(empty, {"x": F.col("id") > 0}).first()) == (0, 0)
    assert reports.before_after(empty, empty, "id", "nuevas").count() == 0
    assert reports.enrichment_stats(empty, F.lit(1), F.lit(True), F.lit(True)).first()["total"] == 0


def test_systems_of_long_pages_are_sought_in_one_pass(spark):
    """The first 60,000 characters and the address, in the order of the list; odd letters, nulls, copies, bytes that are no text."""
    from terrano.functions import links as K

    far, near = "é" * 60_000, "é" * 59_993
    rows = [(far + "wix.com", "x", "custom"), (near + "WIX.com", "x", "wix"), (near + "wIX.comx", "https://tokko.com", "tokko"), ("x" * 300_000 + "wix.com", None, "custom"), ("x" * 50_000 + "wix.com" + "x" * 300_000, None, "wix"), (near + "-WIX.com", None, "custom"), ("wİx.com", "WEBFLOW.com", "webflow"), (None, None, "custom"), ("", "https://a.inmoweb.com.ar", "inmoweb"), ("<b>squarespace.com wp-login.php</b>", "", "wordpress")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows * 3)], "i int, html string, url string, want string")
    assert [(r["got"], r["i"]) for r in df.select("i", "want", K.system(F.col("html"), F.col("url")).alias("got")).where("got <> want or got is null").collect()] == []
    broken = spark.range(1).select(F.expr("cast(concat(X'FF', cast('wp-content/' as binary)) as string)").alias("html"))
    assert broken.select(K.system(F.col("html"), F.lit(None).cast("string"))).first()[0] == "wordpress"
    plan = df.select(K.system(F.col("html"), F.col("url")).alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Contains" not in plan and "contains" not in plan.lower()
