"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns; the ways beyond broadcast bounds."""

import fractions
import json
import re
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from terrano.llm import decontaminate, fingerprint, html_text, minhash, packing, pii, quality, token_counts, tool_calls, url_filter
from terrano.session import scratch_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i % 977}" for i in range(60_000))
ODD = [
    (1, None, None, None, None),
    (2, "", "en", "s", 0),
    (3, "one two three", "en", "s", 13),
    (4, "one two three", "en", "s", 13),
    (4, "one two three", "en", "s", 13),
    (5, LONG, None, "t", len(LONG)),
    (None, "no id here at all, five words", "en", "t", 3),
    (6, " \n\t ", "en", "t", 4),
    (7, "Ünïcödé 😀 tèxt wïth märks", "de", "s", 24),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_decontaminate_cases(spark, odd, none):
    words = [f"b{i}" for i in range(20)]
    bench = items(spark, [(10, " ".join(words)), (9, "one TWO"), (None, "one two"), (11, None), (12, "...")])
    docs = spark.createDataFrame([*ODD, (20, "x " + " ".join(words[2:17]).upper() + " y " * 400, "en", "s", 1)], DOCS).withColumn("n_hit", F.lit("clash"))
    for bound in (1000, 0):  # broadcast, then join
        got = sorted((r["doc_id"] or 0, r["n_words"], r["n_hit"], list(r["items"]), r["contaminated"]) for r in decontaminate.scan(docs, bench, max_broadcast=bound).collect())
        assert (20, 416, 15, ["10"], False) in got and got.count((4, 3, 2, ["9"], True)) == 2 and (1, 0, 0, [], False) in got and len(got) == 10
    assert decontaminate.remove_documents(odd, bench).count() == 6
    cut = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench).collect()}
    assert cut[3] == " three" and cut[1] is None and "B2" not in cut[20] and cut[20].startswith("x ")
    beyond = {r["doc_id"]: r["text"] for r in decontaminate.remove_spans(docs, bench, max_broadcast=0).collect()}
    assert beyond == cut and decontaminate.remove_spans(docs, bench, max_broadcast=0).count() == len(ODD) + 1
    assert decontaminate.scan(none, bench).count() == 0
    assert decontaminate.scan(odd, items(spark, [])).where("n_hit > 0 or contaminated").count() == 0
    assert decontaminate.scan(odd, items(spark, []), max_broadcast=-1).count() == len(ODD)


def test_packing_cases(odd, none):
    got = packing.pack(odd.withColumn("queue", F.lit(1)), with_ids=True).collect()
    assert sum(r["length"] for r in got if r["doc_id"] == 4) == 2 * sum(r["length"] for r in got if r["doc_id"] == 3)
    assert [(r["length"], r["doc_tokens"]) for r in got if r["doc_id"] == 1] == [(1, 1)]
    assert all(len(r["ids"]) == r["length"] for r in got)
    assert packing.pack(none).count() == 0


def round_robin(totals, window, quantum, weights):
    """(queue, k) in order of service, by a plain deficit round-robin with counters."""
    names, left = sorted(totals), {q: totals[q] // quantum for q in totals}
    share = {q: fractions.Fraction(str(weights.get(q, 0))) if weights is not None else fractions.Fraction(left[q]) for q in names}
    active = [q for q in names if share[q] > 0]
    deficit, done, out = {q: fractions.Fraction(quantum, 2) for q in active}, dict.fromkeys(names, 0), []
    while any(left[q] for q in active):
        for q in active:
            deficit[q] += window * share[q] / sum(share.values())
            while deficit[q] >= quantum and left[q]:
                out.append((q, done[q]))
                deficit[q] -= quantum
                left[q] -= 1
                done[q] += 1
            assert not left[q] or deficit[q] < quantum
    return out + [(q, done[q] + i) for q in names if share[q] == 0 for i in range(left[q])]


@pytest.mark.parametrize("seed", range(8))
@pytest.mark.parametrize("kind", [np.int64, object])
def test_schedule_equals_sequential_deficit_round_robin(seed, kind):
    rng = np.random.default_rng(seed)
    totals = {f"s{i}": int(rng.integers(0, 9000)) for i in range(rng.integers(1, 9))}
    for weights in (None, {q: round(float(rng.random()), 3) for q in totals}, {q: int(rng.integers(0, 4)) for q in list(totals)[1:]}):
        plan = packing.Schedule(totals, 1024, 256, weights)
        plan.kind = kind
        plan.credit = plan.credit.astype(kind)
        got = {}
        for i, q in enumerate(plan.names):
            k = np.arange(plan.full[i])
            got |= {int(s): (q, int(x)) for s, x in zip(plan.slots(np.full(len(k), i), k), k, strict=True)}
        assert [got[s] for s in range(len(got))] == round_robin(totals, 1024, 256, weights)


def test_weights_are_kept_in_proportion(spark):
    assert packing.whole_weights({"a": 0.9, "b": 0.1, "c": 0}) == {"a": 9, "b": 1}
    for bad in (-1, float("nan"), float("inf")):
        with pytest.raises(ValueError):
            packing.whole_weights({"a": bad})
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.concat(F.lit("word "), F.repeat(F.lit("and so on "), 40)).alias("text"), F.when(F.col("id") % 3 == 0, "a").when(F.col("id") % 3 == 1, "b").otherwise("c").alias("source"))
    got = packing.pack(docs, weights={"a": 0.25, "b": 0.75}).join(docs, "doc_id")
    first = {r["source"]: r["n"] for r in got.where("sequence_id < 24").groupBy("source").agg(F.sum("length").alias("n")).collect()}
    assert set(first) == {"a", "b"} and abs(first["a"] - 6 * 1024) <= 512 and abs(first["b"] - 18 * 1024) <= 512
    last = got.where("source = 'c'").agg(F.min("sequence_id")).first()[0]
    assert last >= 40


@pytest.mark.parametrize("weights", [None, {"s1": 0.5, "s2": 1.5, "s7": 3}])
def test_ranked_quanta_equal_the_closed_form(spark, weights):
    rows = [(i, " ".join(["many words"] * (i * 37 % 900)), None if i % 23 == 0 else f"s{i % 19}") for i in range(150)]
    docs = spark.createDataFrame([*rows, rows[5], (None, None, None)], "doc_id long, text string, source string").repartition(5, "doc_id")
    key = lambda df: sorted(map(repr, df.collect()))
    one, two = (packing.pack(docs, weights=weights, max_held=m, with_ids=True) for m in (4096, 3))
    assert key(one) == key(two) and one.count() > 150


def test_fingerprint_cases(spark, odd, none):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_chars"], r["fingerprint"], r["near_next"]) for r in fingerprint.edited_likeness(odd).collect())
    by = {g[0]: g for g in got}
    assert len(got) == len(ODD) and by[1][1:3] == (0, "") and by[3][2] == by[4][2] and by[3][3] == 1.0 and by[1][3] == 1.0 and by[2][3] == 0.0
    assert by[6][1] == 4 and by[6][2] == ""
    assert fingerprint.edited_likeness(none).count() == 0
    alone = fingerprint.edited_likeness(odd.where("doc_id = 5")).first()
    assert alone["near_next"] == 1.0


def test_next_crosses_bucket_bounds(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "ROWS_PER_BUCKET", 3)
    monkeypatch.setattr(fingerprint, "FAN", 6)
    df = spark.range(100).select((F.col("id") * 3).alias("doc_id"), F.col("id").cast("string").alias("text"))
    got = {r["doc_id"]: r["next_text"] for r in fingerprint.with_next(df, "doc_id", ["text"]).collect()}
    assert got == {i * 3: str((i + 1) % 100) for i in range(100)}


def test_sketches_estimate_containment_and_merge(spark):
    words = [f"t{i}" for i in range(4000)]
    df = spark.createDataFrame([(" ".join(words), " ".join(words[:1000]))], "a string, b string")
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    r = df.select(fingerprint.containment(F.col("sa"), F.col("sb")), fingerprint.resemblance(F.col("sa"), F.col("sb")), fingerprint.merge(F.col("sa"), F.col("sb")) == F.col("sa")).first()
    assert r[0] > 0.95 and 0.15 < r[1] < 0.35


def test_merged_sketches_are_those_of_both_texts(spark):
    """Every text is followed by white space and the next one's words at a distance of a shingle that both lack."""
    rows = [(f"a{i} b{i} c{i} d{i} e{i}", " ".join(f"x{i}_{j}" for j in range(5 + i % 40))) for i in range(80)]
    df = spark.createDataFrame(rows, "a string, b string")
    both = fingerprint.retained(F.array_union(fingerprint.hashes(fingerprint.words(F.col("a"))), fingerprint.hashes(fingerprint.words(F.col("b")))))
    df = fingerprint.with_sketch(fingerprint.with_sketch(df, "a", "sa"), "b", "sb")
    assert df.where(fingerprint.merge(F.col("sa"), F.col("sb")) != both).count() == 0
    assert df.where(fingerprint.merge(F.col("sa"), F.array().cast("array<string>")) != F.col("sa")).count() == 0


def test_pii_cases(spark, odd, none):
    texts = {
        "mail a@b.co, x@y.z_q@w.org": "email:5:11,email:13:18,email:18:26",
        "999.1.1.1 and 10.0.0.255.7": "ip:14:24",
        "pay 4111 1111-1111 1111 now 4111111111111112": "card:4:23",
        "call +54 (341) 412-3456.": "phone:5:23",
        "iban DE89 3704 0044 0532 0130 00 ok": "iban:5:32",
        "DE88370400440532013000": "",
        "ssn 123-45-6789": "social:4:15",
        "123-45-6789": "",
        "1" * 200_000 + " a" * 100_000 + "@": "",
        "😀 a@b.co": "email:2:8",
    }
    df = spark.createDataFrame([(t, w) for t, w in texts.items()], "text string, want string").withColumn("spans", F.lit(0))
    assert pii.with_spans(df).where(pii.listed(F.col("spans")) != F.col("want")).count() == 0
    red = {r["want"]: r["text"] for r in pii.redact(df).collect()}
    assert red["ssn 123-45-6789" and "social:4:15"] == "ssn [SOCIAL]" and red["email:2:8"] == "😀 [EMAIL]" and red["card:4:23"].startswith("pay [CARD] now")
    assert pii.redact(odd).exceptAll(odd).count() == 0 and pii.redact(none).count() == 0
    plan = pii.redact(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_pii_many_matches(spark):
    """100,000 addresses in one text: offsets, overlaps and redaction stay linear."""
    n = 100_000
    many = " ".join(f"é{i} user{i}@mail.example" for i in range(n))
    df = spark.createDataFrame([(many,), ("a@b.co " * 5000 + "+54 341 412 3456",)], "text string")
    t = time.perf_counter()
    got = pii.with_spans(df).select(pii.listed(F.col("spans")).alias("s")).collect()
    want = ",".join(f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", many))
    assert got[0]["s"] == want and got[1]["s"].endswith("email:34993:34999,phone:35000:35016")
    clean = [r["text"] for r in pii.redact(df).collect()]
    assert clean[0] == " ".join(f"é{i} [EMAIL]" for i in range(n)) and clean[1] == "[EMAIL] " * 5000 + "[PHONE]"
    assert time.perf_counter() - t < 60


def test_pii_merges_overlaps(spark):
    spans = [(0, 5, "email"), (3, 4, "ip"), (4, 9, "card"), (9, 12, "phone"), (20, 21, "ip"), (20, 30, "card")]
    spans += [(100 + 3 * i, 102 + 3 * i + i % 3, "ip") for i in range(300)]
    df = spark.createDataFrame([(spans, "x" * 3000)], "s array<struct<start:int,end:int,kind:string>>, t string")
    r = df.select(pii.merged(F.col("s")).alias("m"), pii.redacted(F.col("t"), pii.merged(F.col("s"))).alias("r")).first()
    want = []
    for a, b, k in spans:
        if want and want[-1][1] > a:
            want[-1] = (want[-1][0], max(want[-1][1], b), want[-1][2])
        else:
            want.append((a, b, k))
    assert [tuple(x) for x in r["m"]] == [(a, b, k) for a, b, k in want]
    out, at = "", 0
    for a, b, k in want:
        out, at = out + "x" * (a - at) + f"[{k.upper()}]", b
    assert r["r"] == out + "x" * (3000 - at)
    assert df.select(pii.redacted(F.lit(""), F.slice(pii.merged(F.col("s")), 1, 0)).alias("r")).first()["r"] == ""


def test_pii_context_on_both_sides(spark):
    df = spark.createDataFrame([("123-45-6789 is my ssn",), ("123-45-6789 and then " + "x" * 40 + " ssn",), ("mail to a@b.co, e-mail",)], "text string")
    got = [[(s["kind"], round(s["score"], 2)) for s in r["spans"]] for r in pii.with_spans(df).collect()]
    assert got == [[("social", 0.6)], [], [("email", 1.0)]]


def test_pii_accounts_end_by_country(spark):
    texts = {
        "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF": "iban:5:32",
        "pay DE89 3704 0044 0532 0130 00 EUR": "iban:4:31",
        "DE89370400440532013000 12345": "iban:0:22",
        "DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32": "iban:0:27,iban:28:55",
        "AT12 DE89 3704 0044 0532 0130 00": "iban:5:32",
        "AB12 NO93 8601 1117 947 X": "iban:5:23",
        "MT84 MALT 0110 0001 2345 MTLC AST0 01S 7": "iban:0:38",
        "😀 NL91 ABNA 0417 1643 00 A1": "iban:2:24",
        "DE89 3704 0044 0532 0130 01 EUR": "",
        "DE89 3704 0044 0532 0130 00EUR": "",
        "AT12 " * 300: "",
    }
    df = spark.createDataFrame(list(texts.items()), "text string, want string")
    got = {r["text"]: r["got"] for r in pii.with_spans(df).select("text", pii.listed(F.col("spans")).alias("got")).collect()}
    assert got == texts
    assert pii.redact(df).where("text = '[IBAN] [IBAN]'").count() == 1


def brute(docs):
    sets = [(i, minhash.shingles(t.encode() if t else b"")) for i, t in docs]
    up = minhash.Forest()
    for i, s in sets:
        up.root(i)
    for x, (i, a) in enumerate(sets):
        for j, b in sets[:x]:
            if minhash.linked(a, b):
                up.join(i, j)
    return {i: up.root(i) for i, _ in sets}


@pytest.mark.parametrize("list_limit,bound", [(40, 1000), (2, 1000), (2, 0)])
def test_minhash_equals_brute_force(spark, list_limit, bound):
    rng = np.random.default_rng(3)
    word = lambda: f"v{rng.integers(400)}"
    docs, passage = [], [word() for _ in range(60)]
    for base in range(6):
        text = [word() for _ in range(80)] + passage * (base % 2)
        for copy in range(14):
            own = [w if rng.random() > 0.02 * (copy % 4) else word() for w in text]
            docs.append((base * 100 + copy, " ".join(own)))
    docs += [(900 + i, f"just {i % 2} short text") for i in range(6)] + [(950, ""), (951, None), (952, " ".join(passage))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in minhash.near_duplicates(df, list_limit=list_limit, max_broadcast=bound).collect()}
    want = brute(docs)
    assert got == {i: (c, i == c) for i, c in want.items()}


@pytest.mark.parametrize("words", [33, 35, 38])
def test_minhash_links_across_the_short_bound(spark, words):
    base = [f"b{i}" for i in range(words)]
    edits = [lambda i: [*base[:-1], f"x{i}"], lambda i: [*base, f"y{i}"], lambda i: [f"z{i}", *base[1:]], lambda i: [*base, f"u{i}", f"v{i}"]]
    docs = [(4 * i + k, " ".join(edit(i))) for i in range(45) for k, edit in enumerate(edits)]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == brute(docs) and set(got.values()) == {0}


def test_minhash_cases(odd, none):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(odd.withColumn("node", F.lit(1))).collect())
    assert got[0] == (-1, 3, None, True) and (1, 0, 1, True) in got and (2, 0, 2, True) in got and got.count((4, 1, 3, False)) == 2
    assert minhash.near_duplicates(none).count() == 0
    assert sorted(r["doc_id"] or 0 for r in minhash.keep_first(odd).collect()) == [0, 1, 2, 3, 5, 6, 7]


def test_url_cases(spark):
    urls = ["http://A.example.ORG/es/x", "https://example.org/en/12?q", "x://b.org", "http://b.org/", "http://a.com/de/", "http://a.com/fr/#f", "no scheme", None, "http://notexample.org/es/", "http://u@h.com:80/de/"]
    df = spark.createDataFrame([(1, u, "x") for u in urls + urls[:2]], "page_id long, url string, host string")
    got = {(r["url"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(df, url_filter.rules_frame(spark)).collect()}
    assert ("http://A.example.ORG/es/x", "a.example.org", "/es/x", "example.org/es/", "block") in got
    assert ("https://example.org/en/12?q", "example.org", "/en/12", "example.org/en/1", "block") in got
    assert ("x://b.org", "b.org", "", None, "allow") in got and ("http://b.org/", "b.org", "/", "org/", "allow") in got
    assert ("http://a.com/de/", "a.com", "/de/", "com/de/", "block") in got and ("http://a.com/fr/#f", "a.com", "/fr/", "com/fr/", "allow") in got
    assert ("no scheme", "", "", None, "allow") in got and (None, "", "", None, "allow") in got and ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow") in got
    assert url_filter.judge(df, url_filter.rules_frame(spark)).count() == 12
    assert url_filter.judge(df, url_filter.rules_frame(spark).limit(0)).where("rule is not null").count() == 0
    assert url_filter.judge(df.limit(0), url_filter.rules_frame(spark)).count() == 0
    long = spark.createDataFrame([(1, "http://" + "a." * 50_000 + "example.org/es/" + "p" * 100_000), (2, "http://x.com/de/")] + [(i, "http://b.com/fr/") for i in range(3, 3000)], "page_id long, url string")
    got = url_filter.judge(long, url_filter.rules_frame(spark)).groupBy("rule").count().collect()
    assert sorted(map(tuple, got)) == [("com/de/", 1), ("com/fr/", 2997), ("example.org/es/", 1)]


PAGE = """<html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><nav><a href=1>Home</a></nav>
<div class="cookie-notice">We use cookies on the site</div><article class="post with-sidebar"><h1>Head &amp; more</h1><p>First &nbsp; one<br>goes on<p>Second <b>part</b> 3 &lt; 4
<aside>Read also</aside><form><label>Mail</label></form><script>var a="<p>no</p>";</script></p><!-- note --><ul><li>item</li></ul><div class="ad">Buy</div></article>
<section id="comments"><article class="comment"><p>Nice post, thanks to the author of it</p></article></section><footer>&copy; all</footer></body></html>"""


def test_html_cases(spark):
    assert html_text.main_text(PAGE) == "Head & more\nFirst one goes on\nSecond part 3 < 4\nitem"
    plain = "<nav><a>x</a></nav><p>The house is on the hill and it was there for all of the years that we were in the town.</p><p>Short one.</p><div><a href=2>many links here in a row of links</a></div>"
    assert html_text.main_text(plain).split("\n") == ["The house is on the hill and it was there for all of the years that we were in the town.", "Short one."]
    df = spark.createDataFrame([(1, "u", None), (2, "u", ""), (3, "u", "<p"), (4, None, "<b>" * 3000 + "</i>" * 3000), (5, "u", PAGE)], "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    assert got[1] == got[2] == ("", 0) and got[5][1] == len(got[5][0]) and len(got) == 5
    assert html_text.extract(df.limit(0)).count() == 0


MANY = 100_000
HOSTILE = ["<a " * MANY, '<a "' * MANY, "<a '" * MANY + "x", "<!" * MANY, "<b>" * MANY + "</i>" * MANY, "<article>" * MANY, "<nav><article>" * MANY, "<p>x " * MANY, "<div>ab</div>" * MANY, "<article>" + "<p>ab</p>" * MANY]


@pytest.mark.parametrize("page", HOSTILE, ids=lambda p: p[:12])
def test_html_in_linear_time(page):
    t = time.perf_counter()
    html_text.main_text(page)
    assert time.perf_counter() - t < 10


def bare(page):
    """A page without article elements, names and roles: nothing but the blocks' own words tell them apart."""
    page = re.sub(r"</?(?:article|main)[^>]*>", "", page)
    return re.sub(r' (?:class|id|role)="[^"]*"', "", re.sub(r"<(/?)(?:nav|header|footer|aside|section|form)\b[^>]*>", r"<\1div>", page))


def test_html_rules_on_pages_without_articles(spark, monkeypatch):
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect()]
    want = [Counter(html_text.main_text(p).split()) for p in pages]

    def measured():
        both = found = 0
        for p, w in zip(pages, want, strict=True):
            g = Counter(html_text.main_text(bare(p)).split())
            both, found = both + sum((g & w).values()), found + sum(g.values())
        return both / max(1, found), both / sum(sum(w.values()) for w in want)

    precision, recall = measured()
    assert precision > 0.95 and recall > 0.96
    monkeypatch.setattr(html_text, "_nearest", lambda found, rated, order: [None] * len(found))
    assert measured()[0] < precision - 0.005  # the second pass matters
    monkeypatch.undo()
    monkeypatch.setattr(html_text, "STOP_WORDS", frozenset())
    assert measured()[0] > 0.95  # where no stop words are known, the signs of prose take in no more of what is none
    monkeypatch.setattr(html_text, "MOST_MARKS", 10**9)
    assert measured()[1] < 0.5  # and so do the stop words


PROSE = {
    "ru": ["Вчера утром комитет собрался в старом здании у реки, чтобы обсудить план на следующий год.", "Жители долго спорили о новой дороге, и многие говорили, что она пройдёт слишком близко к лесу!", "Решение отложили до весны, когда вода спадёт и станет ясно, сколько это будет стоить."],
    "it": ["Ieri mattina i cittadini hanno discusso per ore davanti alla vecchia stazione, senza trovare alcun accordo.", "Secondo gli esperti servono almeno dieci anni affinché quei boschi tornino verdi come prima.", "Nessuno sa dire quando arriveranno i soldi promessi dal governo."],
    "ja": ["昨日の朝、委員会は川のそばの古い建物に集まり、来年の計画について話し合った。", "住民は新しい道路について長い間議論し、多くの人が森に近すぎると言った。", "決定は水が引いて費用が分かる春まで延期されることになった。"],
}
MENU = "<ul>" + "".join(f"<li><a href='/{i}'>Раздел {i}</a></li>" for i in range(6)) + "</ul>"


@pytest.mark.parametrize("lang", sorted(PROSE))
def test_html_prose_in_other_languages(lang):
    page = f"<html><body>{MENU}<div>{'</div><div>'.join(PROSE[lang])}</div><div>Foto Foto Foto Foto Foto Foto Foto Foto Foto Foto Foto Foto</div>{MENU}</body></html>"
    assert html_text.main_text(page).split("\n") == PROSE[lang]


def test_html_links_in_articles():
    good = "<p>The house is on the hill and it was there for all of the years that we were in the town.</p>"
    linked = "<p><a href='/r'>Full report of the committee on the river and the town</a></p>"
    page = f"<article><h1><a href='/x'>The title of the story</a></h1>{good}{linked}{good}</article>"
    assert html_text.main_text(page).split("\n")[::2] == ["The title of the story", "Full report of the committee on the river and the town"]
    assert len(html_text.main_text(page).split("\n")) == 4
    assert html_text.main_text(f"<article>{good}{linked * 3}{good}</article>").count("\n") == 1  # three in a row are a list
    alone = "<article><h2><a href='/x'>Only a linked line</a></h2></article>"
    assert html_text.main_text(alone) in ("", "Only a linked line")


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    a, b = "one two three four five six seven", "something else that nobody has said before now"
    docs = spark.createDataFrame([(1, a, "x"), (5, a, "y"), (5, b, "z"), (6, None, "n"), (7, "", "e")], "doc_id long, text string, _hash string")
    assert sorted((r["doc_id"], r["_hash"]) for r in minhash.keep_first(docs).collect()) == [(1, "x"), (5, "z"), (6, "n"), (7, "e")]


def test_html_inside_articles():
    junk = "<p>" + " ".join(f"<a href={i}>tag{i}</a>" for i in range(12)) + "</p>"
    words = "<p>Qzx wvut srqp onml kjih gfed cba zyx wvu tsr qpo nml.</p>"
    good = "<p>The house is on the hill and it was there for all of the years that we were in the town.</p>"
    assert html_text.main_text(f"<article>{good}{words}{junk}{good}</article><p>{good}") == html_text.main_text(f"<article>{good}{words}{good}</article>")
    assert len(html_text.main_text(f"<article>{words}</article>").split()) == 12 and html_text.main_text(f"<div>{good}{words}{junk}</div>").count("\n") == 0


def test_quality_cases(spark, odd, none):
    labels = spark.createDataFrame([(3, 1), (4, None), (99, 0), (5, 0)], "doc_id long, quality int")
    machine = quality.train(odd, labels)
    got = [(r["text"], r["score"]) for r in quality.score(odd.withColumn("score", F.lit("clash")), machine).collect()]
    assert len(got) == len(ODD) and all(0 <= s <= 1 for _, s in got) and len({s for t, s in got if t == "one two three"}) == 1
    assert quality.score(none, machine).count() == 0
    assert quality.train(none, labels).scores([b"x", b""], [(1,), (None,)]).tolist() == [0.5, 0.5]
    assert quality.described((None,)) == quality.described((-1,)) != quality.described((0,)) != quality.described((900,))
    twice = spark.createDataFrame([(3, 1), (3, 0), (5, 0)], "doc_id long, quality int")
    assert (quality.train(odd, twice).w == quality.train(odd.unionByName(odd), twice.limit(3)).w).all()


def test_quality_statistics_read_the_whole_text():
    level = lambda words: quality.structure(b" ".join(words), words)[14] - (1 << quality.HASH_BITS) - 14 * quality.LEVELS
    words = [b"spam" if i % 5 in (1, 3) else b"w%d" % i for i in range(1000)]
    assert level(words) == quality._level(0.4) > level([b"w%d" % i for i in range(1000)])
    shouted = lambda word: quality.structure(word * 50, [word])[4]
    assert shouted(b"ZUGVJ") == shouted(b"AEHIN")


def test_quality_scores_a_batch_like_single_texts():
    rng = np.random.default_rng(2)
    m = quality.Machine(0.2, rng.normal(size=quality.FEATURES), rng.normal(size=(quality.FEATURES, 4)))
    texts, meta = [b"a b c a", b"", b"one " * 300, "ä ö".encode()], [(7,), (0,), (None,), (3,)]
    at, x, sizes = quality.features(texts, meta)
    assert np.allclose(m.scores(texts, meta), [m.scores([t], [d])[0] for t, d in zip(texts, meta, strict=True)]) and sizes.tolist() == [3 + 17, 17, 1 + 17, 2 + 17] and len(at) == len(x)


def test_interactions_equal_the_sum_over_pairs():
    rng = np.random.default_rng(1)
    m = quality.Machine(0.1, rng.normal(size=6), rng.normal(size=(6, 3)))
    at, x = np.arange(6), rng.normal(size=6)
    pairs = sum(m.v[i] @ m.v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert abs(m.margins(at, x, np.array([6]))[0] - (0.1 + m.w @ x + pairs)) < 1e-9


def test_ledger(spark, odd):
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    assert ledger.totals().count() == 0
    assert ledger.commit(1, upserts=token_counts.counted(odd)) and not ledger.commit(1, upserts=token_counts.counted(odd))
    total = lambda: {(r["source"], r["lang"], r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}
    assert total()[("s", "en", "words-1")] == (3, 6) and total()[(None, None, "bytes-1")] == (1, 0)
    ledger.commit(2, upserts=token_counts.counted(spark.createDataFrame([(3, "five words are now here", "en", "s", 0), (8, "new", "en", "s", 0)], DOCS)))
    assert total()[("s", "en", "words-1")] == (4, 9)
    ledger.commit(3, deletes=spark.createDataFrame([(3,), (77,)], "doc_id long"))
    assert total()[("s", "en", "words-1")] == (3, 4)
    # a batch that broke off before its marker is written anew
    spark.range(5).write.parquet(f"{ledger.root}/changes/batch=4/bucket=3")
    ledger.commit(4, upserts=token_counts.counted(odd.limit(0)))
    ledger.commit(5)
    assert total()[("s", "en", "words-1")] == (3, 4) and ledger.committed() == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        ledger.commit(0)
    # a change and a delete of one document in a batch: the delete holds, whether it was known or not
    both = spark.createDataFrame([(8, "now two", "en", "s", 0), (900, "one", "en", "s", 0)], DOCS)
    ledger.commit(6, upserts=token_counts.counted(both).withColumn("batch", F.lit("clash")), deletes=spark.createDataFrame([(8,), (900,), (None,)], "doc_id long"))
    assert total()[("s", "en", "words-1")] == (2, 3) and ledger.current().where("doc_id in (8, 900)").count() == 0


def test_ledger_with_a_second_writer(spark, monkeypatch):
    """One that has read the state before a batch was committed, and dies or comes second, changes nothing; a marker left empty is passed over."""
    change = lambda n: spark.createDataFrame([(1, "w", "s", "en", n), (2, "w", "s", "en", n)], token_counts.CHANGE)
    root = scratch_path(spark, "ledger")
    one, two = token_counts.Ledger(spark, root), token_counts.Ledger(spark, root)
    total = lambda: [(r["n_docs"], r["n_tokens"]) for r in one.totals().collect()]
    mark = two._mark
    monkeypatch.setattr(two, "_mark", lambda *a: one.commit(0, upserts=change(15)) and mark(*a))  # commits between its data and its marker
    assert not two.commit(0, upserts=change(999)) and total() == [(2, 30)]
    monkeypatch.setattr(two, "committed", lambda: [])
    monkeypatch.setattr(two, "_mark", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        two.commit(0, upserts=change(7))
    assert total() == [(2, 30)] and one.current().count() == 2
    monkeypatch.setattr(token_counts, "PATIENCE", 0.1)
    fs, p = one._fs(f"{root}/markers/batch=1.0")
    fs.create(p, False).close()
    assert one.committed() == [0] and one.commit(1, deletes=spark.createDataFrame([(2,)], "doc_id long")) and total() == [(1, 15)]
    assert one.compact() and not one.compact() and not one.commit(1, upserts=change(3)) and total() == [(1, 15)]


def test_ledger_equals_a_recount(spark):
    """Random batches, compacted now and then: totals equal those of the state, and the state what a plain dictionary holds."""
    rng, held = np.random.default_rng(5), {}
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    for batch in range(5):
        ups = [(int(d), f"v{rng.integers(2)}", f"s{rng.integers(3)}", None if rng.random() < 0.3 else "en", int(rng.integers(50))) for d in rng.integers(0, 40, 25)]
        gone = sorted({int(d) for d in rng.integers(0, 60, 8)})
        ledger.commit(batch, spark.createDataFrame(ups, token_counts.CHANGE), spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        best = {}
        for d, v, s, l, n in ups:
            best[d, v] = max(best.get((d, v), (n, s, l or "")), (n, s, l or ""))
        held = {k: x for k, x in (held | best).items() if k[0] not in gone}
        if batch in (1, 3):
            assert ledger.compact() and not ledger.compact()
    state = {(r["doc_id"], r["tokenizer_version"]): (r["n_tokens"], r["source"], r["lang"] or "") for r in ledger.current().collect()}
    want = {}
    for (_, v), (n, s, l) in held.items():
        docs, tokens = want.get((s, l, v), (0, 0))
        want[s, l, v] = (docs + 1, tokens + n)
    assert state == held and {(r["source"], r["lang"] or "", r["tokenizer_version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()} == want


CALLS = "conv_id long, call_id string, turn long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, turn long, content string"


def test_tool_calls(spark):
    ok = '{"words": 2, "query": "a \\"b\\""}'
    calls = [
        (1, "a", 0, "answer", ok, []),
        (1, "b", 1, "answer", ok, ["c"]),  # depends on a later call
        (1, "c", 2, "answer", '{"query":"","words":"x"}', ["a", "gone"]),
        (1, "d", 1, "other", "[1", ["b"]),
        (2, "x", 0, "answer", None, ["y"]),
        (2, "y", 1, "answer", ok, ["x"]),  # a cycle
        (3, "z", 0, "answer", ok, None),
        (3, "z", 0, "answer", ok, None),
        (None, None, None, None, None, None),
    ]
    results = [(1, "a", 5, "late"), (1, "a", 3, "first\n"), (9, "q", 1, "orphan"), (None, None, None, None)]
    got = tool_calls.link(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS)).collect()
    by = {(r["conv_id"], r["call_id"]): r for r in got}
    key = lambda c: (by[1, c]["order_turn"], by[1, c]["order_depth"])
    assert key("a") < key("c") < key("b") < key("d")
    assert json.loads(by[1, "a"]["json"]) == {"arguments": {"query": 'a "b"', "words": 2}, "depends_on": [], "id": "a", "name": "answer", "result": "first\n"}
    assert list(json.loads(by[1, "a"]["json"])) == sorted(json.loads(by[1, "a"]["json"])) and by[1, "a"]["linked"] and by[1, "a"]["valid"]
    assert by[1, "c"]["issues"] == "bad:query,bad:words,missing_dependency" and by[1, "d"]["issues"] == "not_json,unknown_tool"
    assert "no_order" in by[2, "x"]["issues"] and "no_order" in by[2, "y"]["issues"] and by[9, "q"]["issues"] == "orphan_result"
    assert len(got) == 11 and sum(r["conv_id"] == 3 for r in got) == 2
    assert tool_calls.link(spark.createDataFrame([], CALLS), spark.createDataFrame([], RESULTS)).count() == 0


def test_tool_arguments(spark):
    args = {
        '{"query": 5, "words": "7"}': ("bad:query,bad:words", '{"query":5,"words":"7"}'),
        '{"words": 2, "query": "a", "extra": {"b": [2, 1], "a": null}}': ("unknown:extra", '{"extra":{"a":null,"b":[2,1]},"query":"a","words":2}'),
        '{"words": 99999999999999999999, "query": "a"}': ("", '{"query":"a","words":99999999999999999999}'),
        '{"words": 2.5, "query": null}': ("bad:query,bad:words", '{"query":null,"words":2.5}'),
        '{"query": "a", "query": "b", "words": 1}': ("missing:query,missing:words,not_json", "null"),
        "[1, {}]": ("not_object", "[1,{}]"),
        '"text"': ("not_object", '"text"'),
        "": ("missing:query,missing:words,not_json", "null"),
    }
    calls = spark.createDataFrame([(1, f"i{i}", i, "answer", a, []) for i, a in enumerate(args)] + [(1, "u", 50, "other", '{"z": 1, "a": {"c": 1, "b": 2}}', [])], CALLS).withColumn("key", F.lit("clash"))
    results = spark.createDataFrame([(1, "i0", 1, "".join(map(chr, range(1, 35))) + "\\ é\u2028"), (1, "i1", 1, ""), (1, "i2", 1, "long " * 200_000), (1, "i3", 1, None)], RESULTS)
    by = {r["call_id"]: r for r in tool_calls.link(calls, results).collect()}
    for i, (issue, canonical) in enumerate(args.values()):
        assert by[f"i{i}"]["issues"] == issue and by[f"i{i}"]["json"].startswith(f'{{"arguments":{canonical},"depends_on":')
    assert by["u"]["issues"] == "unknown_tool" and '{"arguments":{"a":{"b":2,"c":1},"z":1},' in by["u"]["json"]
    assert json.loads(by["i0"]["json"])["result"] == "".join(map(chr, range(1, 35))) + "\\ é\u2028" and not set(by["i0"]["json"]) & set(map(chr, range(32)))
    assert len(json.loads(by["i2"]["json"])["result"]) == 1_000_000 and json.loads(by["i3"]["json"])["result"] is None and json.loads(by["i1"]["json"])["result"] == ""


def test_tool_call_order(spark):
    """A chain of 300 late dependencies, a cycle of 200 calls and one behind it settle in a few rounds of doubling."""
    chain = [(1, f"a{i}", i, "answer", "{}", [f"a{i + 1}"] if i < 299 else []) for i in range(300)]
    cycle = [(2, f"b{i}", i, "answer", "{}", [f"b{(i + 1) % 200}"]) for i in range(200)] + [(2, "late", 500, "answer", "{}", ["b3"]), (2, "early", 1, "answer", "{}", ["b3", "late"])]
    t = time.perf_counter()
    by = {(r["conv_id"], r["call_id"]): r["key"] for r in tool_calls.order_keys(spark.createDataFrame(chain + cycle, CALLS)).collect()}
    assert all(tuple(by[1, f"a{i}"]) == (299, 299 - i) for i in range(300))
    assert all(by[2, f"b{i}"] is None for i in range(200)) and tuple(by[2, "late"]) == (500, 0) and tuple(by[2, "early"]) == (500, 1)
    assert time.perf_counter() - t < 60
