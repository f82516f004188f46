"""The training-data queries against their SQL, and against brute force where SQL has no form."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import public_tokenizers
from oracle import same
from terrano.llm import html_text, minhash, queries


def rows(sf, sql):
    return duckdb.sql(sql.format(**{t: f"'{sf}/{t}.parquet'" for t in ("documents", "pages", "labels")})).fetchall()


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, sf, name):
    same(spark, queries.QUERIES[name], queries.SQL[name], sf)


def test_packing_is_exact(spark, sf):
    pieces = sorted(map(tuple, queries.op4_packing(spark, sf).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()))
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    at, ends, total = {}, {}, 0
    for d, t in rows(sf, "SELECT doc_id, coalesce(text, '') FROM {documents}"):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        total += len(ids)
        at[d] = ids
    for d, start, length, crc, n, seq, off in pieces:
        assert n == len(at[d]) and start == ends.get(d, 0) and length > 0 and off + length <= 1024
        assert crc == zlib.crc32(np.array(at[d][start : start + length], "<u4").tobytes())
        ends[d] = start + length
    assert ends == {d: len(x) for d, x in at.items()}
    used = {}
    for _, _, length, _, _, seq, off in sorted(pieces, key=lambda p: p[5:]):
        assert off == used.get(seq, 0)  # gapless
        used[seq] = off + length
    assert sorted(used) == list(range(-(-total // 1024))) and sum(x < 1024 for x in used.values()) <= 1


def test_windows_hold_the_mixture(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    from terrano.llm import packing

    pieces = packing.pack(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "sequence_id").agg(F.sum("length").alias("n")).toPandas()
    wide = pieces.pivot(index="sequence_id", columns="source", values="n").fillna(0).sort_index()
    share = wide.sum() / wide.to_numpy().sum()
    filled = np.cumsum(wide.sum(axis=1).to_numpy())
    ahead = wide.cumsum().to_numpy() - filled[:, None] * share.to_numpy()[None]
    behind = -ahead[:-10]
    # a queue lacks at most half a quantum after a round, and what the round under way still owes it
    quantum = packing.quantum_for(wide.shape[1])
    assert behind.max() <= quantum / 2 + (share.to_numpy()[None] * packing.WINDOW).max() + quantum


def test_every_window_holds_the_mixture(spark):
    """Window by window: the tokens that lie off their source's target, over full windows of all sources' quanta."""
    from terrano.llm import packing

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    pieces = packing.pack(docs).join(docs.select("doc_id", "source"), "doc_id").groupBy("source", "sequence_id").agg(F.sum("length").alias("n")).toPandas()
    wide = pieces.pivot(index="sequence_id", columns="source", values="n").fillna(0).sort_index()
    wide = wide[wide.sum(axis=1) == packing.WINDOW].iloc[:-1]
    share = (wide.sum() / wide.to_numpy().sum()).to_numpy()
    off = np.abs(wide.to_numpy() / packing.WINDOW - share[None]).sum(axis=1)
    assert wide.shape[1] > 10 and off.mean() < packing.DEVIATION and off.max() < 0.3


@pytest.mark.parametrize(("queues", "window"), [(1, 1024), (2, 1024), (20, 1024), (500, 1024), (20, 1000), (3, 7)])
def test_quantum_divides_the_window(queues, window):
    from terrano.llm import packing

    quantum = packing.quantum_for(queues, window)
    assert window % quantum == 0 and 1 <= quantum <= packing.COARSEST and (quantum <= packing.FINEST or quantum * queues <= 3 * packing.DEVIATION * window)


def test_token_counts_equal_a_recount(spark, sf):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    want = {}
    for source, lang, t in rows(sf, "SELECT source, lang, coalesce(text, '') FROM {documents}"):
        n = len(re.findall(r"[^\x20\x09-\x0D]+", t))
        t = t.replace(queries.LICENSE_LINE, "")
        if n >= 5:
            for v, k in (("bytes-1", len(t.encode())), ("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", t))), ("byte_bpe_50k-1", len(tok.encode(t, add_special_tokens=False).ids))):
                docs, tokens = want.get((source, lang, v), (0, 0))
                want[source, lang, v] = (docs + 1, tokens + k)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in queries.op2_token_counts(spark, sf).collect()} == want


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10 == 0


def base_spans(t):
    found = [(m.start(), r, k, m.end()) for r, (k, (p, ok)) in enumerate(BASE.items()) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_pii_equals_brute_force(spark, sf):
    got = {r["doc_id"]: r for r in queries.op6_pii(spark, sf).collect()}
    for d, t in rows(sf, "SELECT doc_id, coalesce(text, '') FROM {documents}"):
        want = base_spans(t)
        assert got[d]["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert ",".join(s for s in got[d]["spans"].split(",") if s.split(":")[0] in BASE) == want


@pytest.mark.parametrize("list_limit", [40, 2])
def test_near_duplicates_miss_no_link(spark, list_limit):
    """Recall against all pairs of plain word sets that share a shingle, over all rows of sf0.01."""
    big, lists, sets, up = "/root/testdata/sf0.01", {}, {}, {}
    for d, t in rows(big, "SELECT doc_id, coalesce(text, '') FROM {documents}"):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        up[d] = d
        for g in sets[d]:
            lists.setdefault(g, []).append(d)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    both = Counter((a, b) for ds in lists.values() for i, a in enumerate(ds) for b in ds[i + 1 :])
    for (a, b), n in both.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((root(a), root(b)))
            up[y] = x
    docs = spark.read.parquet(f"{big}/documents.parquet")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(docs, list_limit=list_limit).collect()}
    assert got == {d: (len(s), root(d)) for d, s in sets.items()}


def test_main_text_is_the_article(spark, sf):
    import html

    for page, raw, text, n in [(r["page_id"], r["html"], r["text"], r["n_chars"]) for r in queries.op9_html_text(spark, sf).join(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html"), "page_id").collect()]:
        inner = re.search(r"(?s)<article>(.*)</article>", raw or "")
        parts = re.split(r"</?(?:p|h1|div)[^>]*>", inner[1] if inner else "")
        want = "\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b.replace("<br>", " "))).split()) for b in parts) if x)
        assert (text, n) == (want, len(want)), page


def test_quality_on_held_out_rows(spark, sf):
    big = "/root/testdata/sf0.01"
    got = queries.op10_quality(spark, big).join(spark.read.parquet(f"{big}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got["score"].between(0, 1)).all() and (got["predicted"] == (got["score"] >= 0.3)).all()
    low, high = got[got.quality == 0].score.to_numpy(), got[got.quality == 1].score.to_numpy()
    assert (low[:, None] < high[None]).mean() > 0.97  # the area under the curve
    assert (got.predicted == got.quality).mean() > 0.9


def test_stop_lists_are_lower_case():
    assert all(w == w.lower() for w in html_text.STOP_WORDS)
