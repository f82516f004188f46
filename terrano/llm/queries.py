"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from terrano.llm import bpe, conversation_repair, decontaminate, fill_middle, fingerprint, html_text, minhash, packing, pii, quality, token_counts, tool_calls, url_filter
from terrano.session import scratch_path

LICENSE_LINE = "Licensed under the Apache License, Version 2.0."


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = decontaminate.scan(docs, read(spark, sf_dir, "benchmark"), keep_text=False)
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def _ledger_totals(spark: SparkSession, sf_dir: str, vocabularies: dict[str, str] | None) -> DataFrame:
    """Totals after three batches: all documents; revised counts of those that lose a licence line; deletes of those under five words."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    ledger = token_counts.Ledger(spark, scratch_path(spark, "ledger"))
    ledger.commit(0, upserts=token_counts.counted(docs, vocabularies=vocabularies))
    cut = docs.where(F.contains("text", F.lit(LICENSE_LINE))).withColumn("text", F.replace("text", F.lit(LICENSE_LINE), F.lit("")))
    revised = token_counts.counted(cut, vocabularies=vocabularies)
    ledger.commit(1, upserts=revised)
    words = token_counts.TOKENIZERS["words-1"](F.coalesce("text", F.lit("")))
    ledger.commit(2, deletes=docs.where(words < 5).select("doc_id"))
    ledger.commit(1, upserts=revised)  # again: changes nothing
    return ledger.totals()


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the tokens of a public vocabulary beside bytes and words."""
    return _ledger_totals(spark, sf_dir, {"byte_bpe_50k-1": token_counts.VOCABULARIES["byte_bpe_50k-1"]})


def token_counts_native(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ledger with the versions that SQL can count."""
    return _ledger_totals(spark, sf_dir, None)


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.link(*tool_calls.from_conversations(read(spark, sf_dir, "conversations")))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents").select("doc_id", "source", "text"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.edited_likeness(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pii.with_spans(read(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")  # noqa: E731
    base = F.filter("spans", lambda s: s["kind"].isin(*pii.BASE))
    return out.select("doc_id", *(count(k) for k in pii.BASE), F.sha2(pii.listed(base), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"), F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",").alias("scores"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, url_filter.rules_frame(spark)).select("page_id", "host", "path", "rule", "verdict")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "n_chars")
    machine = quality.train(docs, read(spark, sf_dir, "labels"))
    out = quality.score(docs, machine, keep_text=False)
    return out.select("doc_id", (quality.fold(F.col("doc_id")) == 0).alias("held_out"), "score", "predicted")


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations")
    found = conversation_repair.digests(conversation_repair.damaged(rows)).withColumnRenamed("conv_id", "_c")
    every = rows.select("conv_id").distinct()
    out = every.join(found, F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    return out.fillna(0).fillna("", ["audit"]).fillna(hashlib.sha256(b"").hexdigest(), ["repaired_sha256"])


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontaminate, op2_token_counts, token_counts_native, op3_tool_calls, op4_packing, op5_fingerprint, op6_pii, op7_minhash, op8_url_filter, op9_html_text, op10_quality, op11_bpe, op12_conversation_repair, op13_fill_middle)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(%s, '[^\x20\x09-\x0D]+')"

_SHINGLES = r"""CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: substr(md5(array_to_string(w[i:i + 4], ' ')), 1, 16))
  WHEN len(w) > 0 THEN [substr(md5(array_to_string(w, ' ')), 1, 16)] ELSE []::VARCHAR[] END"""
_KEPT = """CASE WHEN len(list_filter(h, lambda x: x < '2')) > 0 THEN list_sort(list_distinct(list_filter(h, lambda x: x < '2')))
  WHEN len(h) > 0 THEN [list_min(h)] ELSE h END"""
_ALIKE = """CASE WHEN len({a}) = 0 AND len({b}) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect({a}, {b}))::DOUBLE / greatest({n}, 1) END"""
_UNION = "len({a}) + len({b}) - len(list_intersect({a}, {b}))"
_LEAST = "least(len({a}), len({b}))"


def _alike(b: str, n: str) -> str:
    return _ALIKE.format(a="s", b=b, n=n.format(a="s", b=b))


_UNITS = r"regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+')"


def _draw(i: int) -> str:
    return f"('0x' || substr(h, {8 * i - 7}, 8))::BIGINT"


def _way(x: str, cost: str, edit: str, line: str) -> str:
    """One edit behind the way ``x`` (a struct of cost, edits and turns), or NULL."""
    return f"CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {x}.r || {line}}} END"


_USER, _ASSISTANT = "['user:']", "['assistant:']"
_TWO_IN = "CASE WHEN {x} IS NOT NULL THEN {{'c': {x}.c + 10, 'a': {x}.a || 'II', 'r': {x}.r || ['user:', 'assistant:']}} END"


def _least(*ways: str) -> str:
    return f"list_min([{', '.join(ways)}])"


_REPAIR = rf"""
WITH RECURSIVE plain AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS s FROM conversations),
k AS (SELECT *, xor(list_reduce(list_transform(range(0, len(s) + 1), lambda i: CASE WHEN i = 0 THEN 4294967295 ELSE ascii(substr(s, i, 1)) END::UBIGINT),
  lambda c, b: list_reduce(list_transform(range(9), lambda i: CASE WHEN i = 0 THEN xor(c, b) ELSE 0 END::UBIGINT), lambda x, y: xor(x >> 1, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END::UBIGINT))), 4294967295::UBIGINT) % 20 AS k FROM plain),
dam AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text FROM k, range(2) AS c(n) WHERE k <> 0 AND (n = 0 OR k = 3)),
pos AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM dam),
f AS (SELECT *, left(role, 1) AS s, role || ':' || text AS line, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) || left(role, 1) AS pair,
  CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
    WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 'truncated' ELSE '' END AS fault FROM pos),
st AS (SELECT DISTINCT conv_id, 0::BIGINT AS i, {{'c': 0::BIGINT, 'a': '', 'r': []::VARCHAR[]}} AS b0, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS b1, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS b2, NULL::STRUCT(c BIGINT, a VARCHAR, r VARCHAR[]) AS b3 FROM f
  UNION ALL
  SELECT conv_id, i, {_way("b0", "2", "D", "[]::VARCHAR[]")},
    {_least(_way("b1", "2", "D", "[]::VARCHAR[]"), f"CASE WHEN s = 's' AND stays THEN {_way('b0', 'more', 'K', '[line]')} END")},
    {_least(_way("m2", "2", "D", "[]::VARCHAR[]"), *(f"CASE WHEN s = 'u' AND stays THEN {_way(x, 'more', 'K', '[line]')} END" for x in ("b0", "b1", "m3")), *(f"CASE WHEN stays THEN {_way(x, 'more + 1', 'R', "['user:' || text]")} END" for x in ("b0", "b1", "m3")))},
    {_least(_way("m3", "2", "D", "[]::VARCHAR[]"), f"CASE WHEN s = 'a' AND stays THEN {_way('m2', 'more', 'K', '[line]')} END", f"CASE WHEN stays THEN {_way('m2', 'more + 1', 'R', "['assistant:' || text]")} END")}
  FROM (SELECT f.conv_id, f.i, s, line, text, fault NOT IN ('blank', 'duplicate') AS stays, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS more, b0, b1,
      {_least("b2", *(_way(x, "5", "I", _USER) for x in ("b0", "b1", "b3")))} AS m2,
      {_least("b3", _way("b2", "5", "I", _ASSISTANT), _TWO_IN.format(x="b0"), _TWO_IN.format(x="b1"))} AS m3
    FROM st JOIN f ON f.conv_id IS NOT DISTINCT FROM st.conv_id AND f.i = st.i + 1)),
best AS (SELECT st.conv_id, {_least("b0", "b3", _way("b2", "5", "I", _ASSISTANT), _TWO_IN.format(x="b1"))} AS b FROM st JOIN (SELECT DISTINCT conv_id, n FROM f) e ON e.conv_id IS NOT DISTINCT FROM st.conv_id AND e.n = st.i),
g AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
  count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(b.c, 0) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(array_to_string(b.r, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN g ON g.conv_id IS NOT DISTINCT FROM o.conv_id"""

SQL = {
    "op12_conversation_repair": _REPAIR,
    "op13_fill_middle": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_UNITS} AS u, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
c AS (SELECT *, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR {_draw(3)} % 100 >= 50 AS plain, {_draw(4)} % 100 < 80 AS spm, {_draw(1)} % (len(u) + 1) AS x, {_draw(2)} % (len(u) + 1) AS y FROM d),
p AS (SELECT *, array_to_string(u[1:least(x, y)], '') AS prefix, array_to_string(u[least(x, y) + 1:greatest(x, y)], '') AS middle, array_to_string(u[greatest(x, y) + 1:], '') AS suffix FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(prefix) END AS prefix_chars, CASE WHEN NOT plain THEN length(middle) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE '<P>' || prefix || '<S>' || suffix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM p""",
    "op1_decontaminate": rf"""
WITH words AS (SELECT row_number() OVER () AS u, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, w, least(13, len(w)) AS n FROM (SELECT item_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark)),
grams AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM items WHERE n > 0)),
sizes AS (SELECT DISTINCT n FROM grams),
windows AS (SELECT u, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT u, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
hits AS (SELECT u, n, i, item_id FROM windows JOIN grams USING (n, g)),
places AS (SELECT u, count(*) AS n_hit FROM (SELECT DISTINCT u, unnest(range(i, i + n)) AS p FROM hits) GROUP BY u),
named AS (SELECT u, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT u, item_id::VARCHAR AS item FROM hits) GROUP BY u)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN places USING (u) LEFT JOIN named USING (u)""",
    "token_counts_native": rf"""
WITH d AS (SELECT source, lang, replace(coalesce(text, ''), '{LICENSE_LINE}', '') AS t FROM documents WHERE doc_id IS NOT NULL AND len({_WORDS % "coalesce(text, '')"}) >= 5),
c AS (SELECT source, lang, 'bytes-1' AS tokenizer_version, strlen(t) AS n FROM d UNION ALL SELECT source, lang, 'words-1', len({_WORDS % "t"}) FROM d)
SELECT source, lang, tokenizer_version, count(*) AS n_docs, sum(n)::BIGINT AS n_tokens FROM c GROUP BY ALL""",
    "op3_tool_calls": rf"""
WITH t AS (SELECT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL AND turn IS NOT NULL),
a AS (SELECT conv_id, turn, to_json(coalesce(text, ''))::VARCHAR AS q, coalesce(text, '') = '' AS blank, len({_WORDS % "coalesce(text, '')"}) AS n, (31 * conv_id + turn) % 12 AS k, (conv_id + turn) % 9 AS s FROM t WHERE role = 'user'),
e AS (SELECT a.*, b.k AS kb, c.k AS kc, d.turn IS NOT NULL AS far FROM a LEFT JOIN a b ON b.conv_id = a.conv_id AND b.turn = a.turn - 2 LEFT JOIN a c ON c.conv_id = a.conv_id AND c.turn = a.turn + 2 LEFT JOIN a d ON d.conv_id = a.conv_id AND d.turn = a.turn + 4),
o AS (SELECT *, k = 7 AND kc IS NOT NULL OR coalesce(kb = 7, false) AS cycle, k IN (1, 3, 7) AND kc IS NULL OR k = 5 AS lost,
  CASE WHEN k = 1 AND kc IS NOT NULL AND far THEN 2 WHEN k IN (1, 3) AND kc IS NOT NULL THEN 1 ELSE 0 END AS up,
  list_sort(list_filter([CASE WHEN kb NOT IN (1, 3) THEN 'c' || (turn - 2) END, CASE WHEN k IN (1, 3, 7) THEN 'c' || (turn + 2) END, CASE WHEN k = 5 THEN 'x' || turn END], lambda x: x IS NOT NULL)) AS deps,
  CASE s WHEN 0 THEN '{{"query":5,"words":' || n || '}}' WHEN 1 THEN '{{"query":' || q || ',"words":"7"}}' WHEN 2 THEN '{{"extra":[{{"a":[],"b":1.5}}],"query":' || q || ',"words":' || n || '}}' WHEN 3 THEN 'null'
    WHEN 4 THEN '{{"a":{{"x":true,"y":null}},"z":1}}' WHEN 5 THEN '{{"query":' || q || '}}' WHEN 6 THEN '[' || n || ']' ELSE '{{"query":' || q || ',"words":' || n || '}}' END AS args,
  list_filter([CASE WHEN s = 0 OR blank AND s IN (1, 2, 5, 7, 8) THEN 'bad:query' END, CASE WHEN s = 1 OR n = 0 AND s IN (0, 2, 7, 8) THEN 'bad:words' END, CASE WHEN s = 3 THEN 'missing:query' END, CASE WHEN s IN (3, 5) THEN 'missing:words' END,
    CASE WHEN s = 3 THEN 'not_json' END, CASE WHEN s = 6 THEN 'not_object' END, CASE WHEN s = 2 THEN 'unknown:extra' END, CASE WHEN s = 4 THEN 'unknown_tool' END,
    CASE WHEN k IN (1, 3, 7) AND kc IS NULL OR k = 5 THEN 'missing_dependency' END, CASE WHEN k = 7 AND kc IS NOT NULL OR kb = 7 THEN 'no_order' END], lambda x: x IS NOT NULL) AS wrong FROM e),
r AS (SELECT conv_id, turn - 1 AS turn, text, turn AS seen FROM t WHERE role = 'assistant' QUALIFY row_number() OVER (PARTITION BY conv_id, turn ORDER BY text) = 1)
SELECT conv_id, 'c' || turn AS call_id, CASE WHEN cycle THEN turn ELSE coalesce(turn + 2 * up, r.seen) END AS order_turn, (CASE WHEN cycle THEN 0 ELSE coalesce(up, 0) END)::BIGINT AS order_depth, q IS NOT NULL AND seen IS NOT NULL AS linked,
  q IS NOT NULL AND len(wrong) = 0 AS valid, CASE WHEN q IS NULL THEN 'orphan_result' ELSE array_to_string(wrong, ',') END AS issues,
  '{{"arguments":' || coalesce(args, 'null') || ',"depends_on":[' || coalesce(array_to_string(list_transform(deps, lambda x: '"' || x || '"'), ','), '') || '],"id":"c' || turn || '","name":' ||
  CASE WHEN q IS NULL THEN 'null' WHEN s = 4 THEN '"search"' ELSE '"answer"' END || ',"result":' || coalesce(to_json(r.text)::VARCHAR, 'null') || '}}' AS json
FROM o FULL JOIN r USING (conv_id, turn)""",
    "op5_fingerprint": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(coalesce(text, '')) OVER o, first_value(coalesce(text, '')) OVER o) AS nt FROM documents WINDOW o AS (ORDER BY doc_id)),
e AS (SELECT *, substr(t, 1, length(t) - length(t) // 4) || substr(nt, 1, length(t) // 4) AS et FROM d),
h AS (SELECT doc_id, length(t) AS n_chars, sha256(et) AS edited_sha256,
  (SELECT {_SHINGLES} FROM (SELECT {_WORDS % "t"} AS w)) AS ht, (SELECT {_SHINGLES} FROM (SELECT {_WORDS % "et"} AS w)) AS he, (SELECT {_SHINGLES} FROM (SELECT {_WORDS % "nt"} AS w)) AS hn FROM e),
k AS (SELECT *, (SELECT {_KEPT} FROM (SELECT ht AS h)) AS s, (SELECT {_KEPT} FROM (SELECT he AS h)) AS se, (SELECT {_KEPT} FROM (SELECT hn AS h)) AS sn FROM h)
SELECT doc_id, n_chars, edited_sha256, array_to_string(s, '') AS fingerprint, array_to_string(se, '') AS edited_fingerprint,
  {_alike("se", _UNION)} AS near_edited, {_alike("sn", _UNION)} AS near_next, {_alike("se", _LEAST)} AS contained_edited, {_alike("sn", _LEAST)} AS contained_next FROM k""",
    "op7_minhash": rf"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS % _LOWER} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) ELSE [array_to_string(w, ' ')] END) AS g FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sym AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(x, y) AS (SELECT x, y FROM sym UNION SELECT r.x, b.y FROM reach r JOIN sym b ON b.x = r.y),
c AS (SELECT x, min(y) AS m FROM reach GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, coalesce(m, d.doc_id) >= d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.x = d.doc_id""",
    "op8_url_filter": r"""
WITH p AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
q AS (SELECT *, '.' || host AS h FROM p),
j AS (SELECT page_id, host, path, CASE
  WHEN ends_with(h, '.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN ends_with(h, '.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN ends_with(h, '.org') AND starts_with(path, '/') THEN 'org/'
  WHEN ends_with(h, '.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN ends_with(h, '.com') AND starts_with(path, '/de/') THEN 'com/de/' END AS rule FROM q)
SELECT *, CASE WHEN rule IN ('example.org/en/1', 'example.org/es/', 'com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM j""",
}
