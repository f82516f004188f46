"""File sources: CSV exports with a byte-order mark, JSON captures, id lists. Read by Spark, with declared schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

CAPTURE = "url string, props array<map<string,string>>"
ID_COLUMNS = ("id", "staging_id", "inmobiliaria_id")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as strings; a byte-order mark before the first name is dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def read_captures(spark: SparkSession, folder: str) -> DataFrame:
    """(source_url, pos, prop) of every captured listing in *.json files, metadata files aside."""
    df = spark.read.schema(CAPTURE).option("multiLine", True).option("pathGlobFilter", "*.json").json(folder)
    df = df.where(~F.endswith(F.input_file_name(), F.lit(".metadata.json")))
    return df.select(F.col("url").alias("source_url"), F.posexplode("props").alias("pos", "prop"))


def first_of(prop: str, *names: str):
    """The first non-blank value among a map column's alias keys."""
    return F.coalesce(*(F.nullif(F.trim(F.col(prop)[n]), F.lit("")) for n in names))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ids from the first known id column of a CSV file."""
    df = read_csv(spark, path)
    name = next((c for c in ID_COLUMNS if c in df.columns), None)
    if name is None:
        raise ValueError(f"none of {', '.join(ID_COLUMNS)} in {path}")
    return df.select(F.col(name).try_cast("long").alias("id")).where("id is not null").distinct()


def require(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df``, if it has all the columns."""
    if missing := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def latest_file(spark: SparkSession, folder: str, pattern: str) -> str | None:
    """The path of the newest file of a folder; names break ties. Only file listings are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder).select("path", "modificationTime")
    row = files.orderBy(F.desc("modificationTime"), F.desc("path")).first()
    return row["path"] if row else None


def odd_keys(df: DataFrame, record: str) -> DataFrame:
    """(missing, extra, n): how many records (maps) of a batch lack keys that others have, or that the batch's required ones do not name."""
    every = df.select(F.explode(F.map_keys(record)).alias("k")).groupBy("k").count()
    total = df.count()
    common = [r["k"] for r in every.where(F.col("count") * 2 > total).limit(1000).collect()]  # keys most records have, bounded
    known = F.array(*map(F.lit, sorted(common))) if common else F.array().cast("array<string>")
    diff = lambda a, b: F.array_join(F.array_sort(F.array_except(a, b)), ",")
    rows = df.select(diff(known, F.map_keys(record)).alias("missing"), diff(F.map_keys(record), known).alias("extra"))
    return rows.where("missing <> '' or extra <> ''").groupBy("missing", "extra").agg(F.count("*").alias("n"))


def embedded_agencies(df: DataFrame, html: str, depth: int = 12) -> DataFrame:
    """(nombre, telefono, email) of the objects with a name and a contact at any depth of a page's embedded application data, each name once.

    The data is walked level by level, one pass of the engine a level, down to ``depth``.
    """
    body = F.regexp_extract(F.coalesce(html, F.lit("")), r'(?is)<script\b[^>]*id\s*=\s*["\']__NEXT_DATA__["\'][^>]*>(.*?)</script\s*>', 1)
    level = df.select(F.try_parse_json(body).alias("v")).where("v is not null")
    text = lambda k: F.try_variant_get("v", f"$.{k}", "string")
    found = None
    for _ in range(depth):
        hit = level.select(text("name").alias("nombre"), F.coalesce(text("phone"), text("telephone")).alias("telefono"), text("email").alias("email")).where("nombre is not null and (telefono is not null or email is not null)")
        found = hit if found is None else found.unionByName(hit)
        kind = F.schema_of_variant("v")
        level = level.where(kind.startswith("OBJECT") | kind.startswith("ARRAY")).lateralJoin(df.sparkSession.tvf.variant_explode(F.col("v").outer())).select(F.col("value").alias("v"))
    return found.groupBy("nombre").agg(F.min(F.struct("telefono", "email")).alias("x")).select("nombre", "x.telefono", "x.email")
