"""Queries that write whole tables through the sinks and read them back through the readers."""

from __future__ import annotations

from pyspark.sql import DataFrame as D, SparkSession as S, functions as F

from terrano.operators import reports
from terrano.session import scratch_path
from terrano.sources import files, sinks
from terrano.sources.adapters import table

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


@query("SELECT p_partkey AS id, p_name AS nombre, p_name || ', \"' || p_brand || '\"' || chr(10) || p_type AS nota FROM part")
def src05_csv(s: S, d: str) -> D:
    """Parts as CSV with a byte-order mark, quotes, commas and line breaks inside."""
    path, part = scratch_path(s, "csv"), table(s, d, "part")
    note = F.concat("p_name", F.lit(', "'), "p_brand", F.lit('"\n'), "p_type")
    part.select(F.col("p_partkey").alias("﻿id"), F.col("p_name").alias("nombre"), note.alias("nota")).write.option("header", True).option("escape", '"').csv(path)
    return files.read_csv(s, path).select(F.col("id").cast("long").alias("id"), "nombre", "nota")


@query("SELECT 'https://x.com/' || (o_orderkey // 500) AS source_url, count(*) AS n, min(o_orderkey)::VARCHAR AS first_id, max(floor(o_totalprice))::BIGINT AS top FROM orders GROUP BY o_orderkey // 500")
def src06_captures(s: S, d: str) -> D:
    """Five hundred orders after another as captured JSON files, a list of properties each."""
    path = scratch_path(s, "captures")
    prop = F.create_map(F.lit("id"), F.col("o_orderkey").cast("string"), F.lit("precio"), F.floor("o_totalprice").cast("string"))
    rows = table(s, d, "orders").groupBy(F.floor(F.col("o_orderkey") / 500).alias("k")).agg(F.collect_list(prop).alias("props"))
    rows.select("k", F.concat(F.lit("https://x.com/"), "k").alias("url"), "props").write.partitionBy("k").json(path)
    got = files.read_captures(s, path)
    number = lambda k: files.first_of("prop", "x", k).cast("long")
    return got.groupBy("source_url").agg(F.count("*").alias("n"), F.min(number("id")).cast("string").alias("first_id"), F.max(number("precio")).alias("top"))


@query("SELECT DISTINCT o_custkey AS id FROM orders")
def src14_ids(s: S, d: str) -> D:
    """The agencies of all orders as an allow list: one id a line, some blank."""
    path = scratch_path(s, "ids")
    table(s, d, "orders").select(F.lit("x").alias("nota"), F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey").cast("string")).otherwise("no id").alias("staging_id")).unionByName(
        table(s, d, "orders").select(F.lit("y").alias("nota"), F.col("o_custkey").cast("string").alias("staging_id"))
    ).write.option("header", True).csv(path)
    return files.read_ids(s, path)


@query("SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE c_mktsegment END AS nombre FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 = 0")
def snk07_csv_append(s: S, d: str) -> D:
    """Customers of even keys, then those of keys divisible by three: a key that is there keeps its first row."""
    path, c = scratch_path(s, "csv"), table(s, d, "customer")
    k = F.col("c_custkey")
    sinks.append_csv(c.where(k % 2 == 0).select(k.alias("id"), F.col("c_name").alias("nombre")), path, ["id"])
    sinks.append_csv(c.where(k % 3 == 0).select(k.cast("string").alias("id"), F.col("c_mktsegment").alias("nombre")), path, ["id"])
    return files.read_csv(s, path).select(F.col("id").cast("long").alias("id"), "nombre")


@query("SELECT event_id AS id, event_type || ' en ?token=<redacted>' AS mensaje, 2::BIGINT AS copias FROM events WHERE event_type = 'error'")
def snk08_error_log(s: S, d: str) -> D:
    """Error events logged as lines and as a table, secrets taken out of both."""
    lines, rows = scratch_path(s, "lines"), scratch_path(s, "errors")
    errors = table(s, d, "events").where("event_type = 'error'").select(F.col("event_id").alias("id"), F.concat("event_type", F.lit(" en ?token="), F.sha2(F.col("event_id").cast("string"), 256)).alias("mensaje"))
    sinks.log_errors(errors, lines, rows)
    both = s.read.schema("id long, mensaje string").json(lines).unionByName(s.read.parquet(rows))
    return both.groupBy("id", "mensaje").agg(F.count("*").alias("copias"))


@query("SELECT o_orderstatus AS estado, count(*) AS n, 0::BIGINT AS en_seco FROM orders GROUP BY 1")
def snk11_dry_run(s: S, d: str) -> D:
    """Orders committed twice, first as a dry run, which writes nothing."""
    path, rows = scratch_path(s, "orders"), table(s, d, "orders").select(F.col("o_orderstatus").alias("estado"))
    counted = sinks.commit(rows, path)
    path_class = s._jvm.org.apache.hadoop.fs.Path(path)
    dry = 1 if path_class.getFileSystem(s._jsc.hadoopConfiguration()).exists(path_class) else 0
    assert sinks.commit(rows, path, dry_run=False) == counted
    return s.read.parquet(path).groupBy("estado").agg(F.count("*").alias("n")).withColumn("en_seco", F.lit(dry).cast("long"))


@query("""WITH r AS (SELECT o_orderpriority AS p, count(*) AS n, min(o_orderkey) AS i FROM orders GROUP BY 1)
SELECT '| ' || p || ' | ' || n || ' | ' || i || ' |' AS x FROM r UNION ALL SELECT unnest(['# Prioridades', '| prioridad | n | primera |', '| - | - | - |'])""")
def snk09_report(s: S, d: str) -> D:
    """Counts of priorities as a Markdown report, by line."""
    rows = table(s, d, "orders").groupBy(F.col("o_orderpriority").alias("prioridad")).agg(F.count("*").alias("n"), F.min("o_orderkey").alias("primera"))
    lines = [x for x in reports.markdown(rows, "Prioridades").splitlines() if x]
    return s.createDataFrame([(x,) for x in lines], "x string")


@query("SELECT user_id % 20 AS run_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS errores, 'running' AS status FROM events GROUP BY 1")
def ups08_run_and_items(s: S, d: str) -> D:
    """Runs written behind their items: every run that is read has all of them."""
    root, e = scratch_path(s, "run"), table(s, d, "events")
    items = e.select((F.col("user_id") % 20).alias("run_id"), F.col("event_id").alias("id"), "event_type")
    sinks.write_run(items.select("run_id").distinct().withColumn("status", F.lit("running")), items, root)
    got = s.read.parquet(f"{root}/items").groupBy("run_id").agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errores"))
    return got.join(s.read.parquet(f"{root}/run"), "run_id")


@query("""SELECT CASE WHEN event_id % 10 = 0 THEN 'v' ELSE '' END AS missing, CASE WHEN event_id % 15 = 0 THEN 'extra' ELSE '' END AS extra, count(*) AS n FROM events WHERE event_id % 10 = 0 OR event_id % 15 = 0 GROUP BY 1, 2""")
def qua01_odd_keys(s: S, d: str) -> D:
    """Events as records, some without a key that most have, some with one more."""
    i = F.col("event_id")
    record = F.map_from_entries(F.array_compact(F.array(F.struct(F.lit("k").alias("a"), F.col("event_type").alias("b")), F.when(i % 10 != 0, F.struct(F.lit("v").alias("a"), F.col("event_type").alias("b"))), F.when(i % 15 == 0, F.struct(F.lit("extra").alias("a"), F.col("event_type").alias("b"))))))
    return files.odd_keys(table(s, d, "events").select(record.alias("r")), "r")
