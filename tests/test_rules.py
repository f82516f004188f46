"""Hand-worked cases of table operators, files, sinks and streams that the test tables can't show."""

import random
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pytest
from pyspark.sql import functions as F

from terrano.functions import images, names, normalize as N, urls
from terrano.operators import dedupe, lifecycle, manifest, merge, publishing, reports
from terrano.plans import listing_queries
from terrano.sources import files, sinks


def column(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in df.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def plain_canonical(url):
    """The identity key by the standard library's URL parts."""
    text = unquote((url or "").strip())
    if not text:
        return ""
    parts = urlsplit(text if text[:7].lower() == "http://" or text[:8].lower() == "https://" else "http://" + text.lstrip("/"))
    host = parts.netloc.rsplit("@", 1)[-1].split(":")[0].strip().lower().removeprefix("www.")
    head, _, last = parts.path.rpartition("/")
    path = unquote(f"{head}/{last.split(';')[0]}" if "/" in parts.path else parts.path.split(";")[0])
    while "//" in path:
        path = path.replace("//", "/")
    path = path.strip().rstrip("/").lower() if parts.netloc else ""
    pairs = [(k.strip().lower(), v.strip().lower()) for k, v in parse_qsl(parts.query)]
    query = urlencode(sorted((k, v) for k, v in pairs if k and k not in urls.TRACKING and not k.startswith("utm_")))
    return (host + path + ("?" + query if query else "")).rstrip("/")


def test_canonical_url_by_hand(spark):
    cases = {
        "HTTP://www.X.com:80//A/b/?utm_source=z&B=Q&a=1#f": "x.com/a/b?a=1&b=q",
        "https://www.x.com/Casa%20en%20Venta/?b=2&a=A%26": "x.com/casa en venta?a=a&b=2",
        "user:pw@x.com/a;v=1": "x.com/a",
        "x.com/?a=&b": "x.com",
        "https://x.com/a%2Fb?q=a+b%2Bc": "x.com/a/b?q=a+b+c",
        "https://x.com/%e9": "x.com/�",
        "//x.com/ñ?ñ=Á": "x.com/ñ?%C3%B1=%C3%A1",
        "  ": "",
    }
    assert column(spark, urls.canonical, [*cases, None]) == [*cases.values(), ""]
    assert column(spark, lambda c: urls.canonical(c, False), ["http://x.com/A/?B=Q%20r&a=1&msclkid=2&mc_cid=3"]) == ["x.com/a?a=1&b=Q r&mc_cid=3&msclkid=2"]


def test_canonical_url_equals_the_standard_library(spark):
    rng = random.Random(4)
    bits = ["a", "B", "%20", "+", "%2F", "/", "//", ";x", "?", "&", "=", "q=1", "utm_a=1", "#", "%", "ñ", "é%C3", "www.", ":80", "@", "~*_-.", "%252B"]
    made = ["".join(rng.choice(["https://", "http://", "", "//"]) + rng.choice(["x.com", "www.Y.com", "u@z.com:1"])) + "/" + "".join(rng.choices(bits, k=rng.randint(0, 9))) for _ in range(600)]
    assert column(spark, urls.canonical, made) == [plain_canonical(u) for u in made]
    assert column(spark, urls.quoted, made) == [quote(u, safe="").replace("%20", "+") for u in made]


def test_prices_and_errors(spark):
    texts = ["5000 peso", "cars 5000", "500 usdx", "US$ 100", "US$100", "U$S 5", "dólar 9", "dólares 9", "$ 1", "A consultar $ 5"]
    assert column(spark, N.price_currency, texts) == ["ARS", None, None, "ARS", "USD", "USD", "USD", None, "ARS", None]
    errors = ["ConnectionResetError 10054", "Max retries", "RemoteDisconnected", "Connection aborted", "temporarily moved", "temporarily unavailable", "HTTP 429 and 404", "404 timeout", None]
    assert column(spark, N.transient_error, errors) == [True, True, True, True, False, True, True, False, False]


def test_accents(spark):
    assert column(spark, N.unaccented, ["Ação ýåś", "éñ", "øł"]) == ["Acao yas", "en", "øł"]


def test_image_limits(spark):
    many = "|".join(["logo.png", *(f"a{i}.jpg" for i in range(60)), "menu.png", "z.jpg"])
    got = column(spark, lambda c: images.split(F.split(c, r"\|")), [many])[0]
    assert len(got["kept"]) == 60 and got["kept"][-1] == "a59.jpg" and got["discarded"] == ["logo.png"]


def test_stuck_rows_of_most_attempts_stay(spark):
    rows = [(1, "publishing", 4, "2020-01-01 00:00:00"), (2, "publishing", 5, "2020-01-01 00:00:00"), (3, "publishing", 0, "2024-01-01 00:00:00"), (4, "done", 0, "2020-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "staging_id int, status string, attempts int, at string").withColumn("queued_at", F.col("at").cast("timestamp"))
    got = {r["staging_id"]: (r["status"], r["attempts"]) for r in lifecycle.reclaim(df, "2024-01-01 00:10:00").collect()}
    assert got == {1: ("pending", 5), 2: ("publishing", 5), 3: ("publishing", 0), 4: ("done", 0)}


def test_selection_and_error_types():
    assert [publishing.selection_mode(*a) for a in ((False, False, None), (False, False, 14), (False, True, 14), (True, True, 3))] == ["run_latest", "run", "backlog", "ids_file"]
    assert manifest.error_types(" timeout,item_timeout ,timeout") == ["item_timeout", "timeout"]
    for bad in ("", "other"):
        with pytest.raises(ValueError):
            manifest.error_types(bad)


def test_unseen_equals_a_sequential_pass(spark):
    rng = random.Random(7)
    rows = [(i, rng.choice([None, *"abcdefgh"]), rng.choice([None, *"pqrstuvw"])) for i in range(60)]
    webs, used, want = set(), set(), []
    for i, a, b in rows:
        if (a is None or a not in webs) and (b is None or b not in used):
            want.append(i)
            webs |= {a} - {None}
            used |= {b} - {None}
    df = spark.createDataFrame(rows, "i int, a string, b string")
    assert sorted(r["i"] for r in dedupe.unseen(df, ["a", "b"], "i").collect()) == want
    assert dedupe.unseen(df.limit(0), ["a", "b"], "i").count() == 0


def test_fuzzy_query_finds_planted_names(spark, sf):
    from difflib import SequenceMatcher

    rows = {r["id"]: r["name"] for r in listing_queries.fuzzy_names(spark, sf).collect()}
    first = {}
    for i, n in sorted(rows.items()):
        first.setdefault(n, i)
    ids = sorted(first.values())
    want = {(i, j) for x, i in enumerate(ids) for j in ids[x + 1 :] if SequenceMatcher(None, *sorted((rows[i], rows[j]), key=lambda n: first[n])).quick_ratio() >= 0.92 and SequenceMatcher(None, rows[i], rows[j]).ratio() >= 0.92}
    got = {(r["id_a"], r["id_b"]) for r in listing_queries.ded13_fuzzy(spark, sf).collect()}
    assert got and got == want


def test_embedded_application_data(spark):
    data = '{"props": {"list": [{"name": "Norte", "phone": "1"}, {"deep": {"er": {"name": "Sur", "email": "s@s.co"}}}, {"name": "Norte", "phone": "2"}, {"name": "sin contacto"}]}}'
    df = spark.createDataFrame([(f'<script id="__NEXT_DATA__" type="application/json">{data}</script>',), (None,), ("<p>",), ('<script id="__NEXT_DATA__">{broken</script>',)], "html string")
    assert sorted(map(tuple, files.embedded_agencies(df, "html").collect())) == [("Norte", "1", None), ("Sur", None, "s@s.co")]


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id int, v string")
    assert sinks.commit(df, f"{tmp_path}/t") == 3 and not (tmp_path / "t").exists()
    assert sinks.commit(df, f"{tmp_path}/t", dry_run=False) == 3 and spark.read.parquet(f"{tmp_path}/t").count() == 3
    assert sinks.append_csv(df, f"{tmp_path}/c", ["id"]) == 2 and sinks.append_csv(df.unionByName(spark.createDataFrame([(3, "c")], df.schema)), f"{tmp_path}/c", ["id"]) == 1
    assert files.read_csv(spark, f"{tmp_path}/c").count() == 3
    sinks.log_errors(spark.createDataFrame([("x?token=abc",)], "mensaje string"), f"{tmp_path}/j", f"{tmp_path}/e")
    assert spark.read.json(f"{tmp_path}/j").first()[0] == spark.read.parquet(f"{tmp_path}/e").first()[0] == "x?token=<redacted>"
    sinks.write_run(df.limit(1).withColumn("status", F.lit("running")), df, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/run").count() == 1 and spark.read.parquet(f"{tmp_path}/r/items").count() == 3
    bad = df.withColumn("v", F.raise_error(F.lit("no")))
    with pytest.raises(Exception):
        sinks.write_run(df.limit(1).withColumn("status", F.lit("running")), bad, f"{tmp_path}/r")
    assert spark.read.parquet(f"{tmp_path}/r/run").first()["status"] == "error"
    sinks.by_category(df, "v", f"{tmp_path}/k")
    assert {p.name for p in (tmp_path / "k").iterdir() if p.is_dir()} == {"v=a", "v=b"}
    (tmp_path / "l").mkdir()
    for n, name in enumerate(("b.csv", "a.csv")):
        (tmp_path / "l" / name).write_text("x")
        __import__("os").utime(tmp_path / "l" / name, (n, n))
    assert files.latest_file(spark, f"{tmp_path}/l", "*.csv").endswith("a.csv") and files.latest_file(spark, f"{tmp_path}/l", "*.none") is None
    maps = spark.createDataFrame([({"a": "1", "b": "2"},), ({"a": "1", "b": "2"},), ({"a": "1", "c": "2"},)], "m map<string,string>")
    assert [tuple(r) for r in files.odd_keys(maps, "m").collect()] == [("b", "c", 1)]
    assert reports.markdown(df.limit(1), "T") == "# T\n\n| id | v |\n| - | - |\n| 1 | a |\n"


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", 1.0), (2, None, 2.0)], "id int, v string, latitud double")
    new = spark.createDataFrame([(1, None, 9.0), (2, "b", 9.0), (3, "c", 9.0)], old.schema)
    assert sorted(map(tuple, merge.patched(old, new, "id").collect())) == [(1, "a", 1.0), (2, "b", 2.0)]
    assert sorted(map(tuple, merge.insert_or_fill(old, new, "id").collect())) == [(1, "a", 9.0), (2, "b", 9.0), (3, "c", 9.0)]


def test_changed_fields(spark):
    df = spark.createDataFrame([("a", "b", "a", "c"), (None, "b", "x", None)], "p string, q string, p2 string, q2 string")
    got = [r[0] for r in df.select(names.changed_fields({"p": F.col("p"), "q": F.col("q")}, {"p": F.col("p2"), "q": F.col("q2")})).collect()]
    assert got == [{"q": "c"}, {"p": "x"}]


def test_payload_and_validity(spark):
    df = spark.createDataFrame([("http://x.com/1", "Casa", 3_000_000_000, 80, "tokko", 5)], "url string, titulo string, dormitorios long, metros long, fuente string, inmobiliaria_id long")
    df = df.withColumns({c: F.lit(None).cast("long") for c in ("banos", "ambientes")})
    r = publishing.payload(df).first()
    assert (r["dormitorios"], r["superficie_total"], r["fuente_extraccion"], r["estado"]) == (None, 80, "tokko", "activa") and len(r["hash_dedup"]) == 32
    rows = [("http://x", "abc", "", "Centro", "casa", ""), ("ftp://x", "abc", "d", "", "casa", ""), ("http://x", " ab ", "d", "", "casa", ""), ("http://x", "abc", "", None, "casa", ""), ("http://x", "abc", "d", "", "campo", ""), ("http://x", "abc", "d", "", "otro", "EUR")]
    df = spark.createDataFrame(rows, "u string, t string, a string, p string, k string, m string")
    assert [r[0] for r in df.select(publishing.is_valid(*(F.col(c) for c in "utapkm"))).collect()] == [True, False, False, False, False, False]


def test_scratch_tables_can_be_dropped(spark):
    from terrano import session

    df = session.written(spark.range(3), "kept")
    assert df.count() == 3 and session.drop_scratch(spark) >= 1 and session.drop_scratch(spark) == 0
    with pytest.raises(Exception):
        session.written(spark.range(3)) and df.count()


def test_filter_counter_and_prefixes(spark):
    from terrano.operators import imports, search

    assert search.Filters(equal={"tipo": "casa"}, at_least={"precio": 1}, area=(40, None), with_images=True, text="x").count() == 5 and search.Filters().count() == 0
    sources = spark.createDataFrame([("x.com/a", 2, 20), ("x.com/abc", 1, 10), ("y.com", 3, 30)], "_c string, pos int, held int")
    rows = spark.createDataFrame([("x.com/abcd",), ("x.com/a/z",), ("x.com",), ("z.com",), ("",), ("y.com/1",), ("y.com.ar/1",)], "_c string")
    assert {r["_c"]: r["_by_prefix"] for r in imports.prefix_matches(rows, sources).collect()} == {"x.com/abcd": 10, "x.com/a/z": 20, "x.com": 10, "y.com/1": 30}
    assert imports.prefix_matches(rows, sources.limit(0)).count() == 0
