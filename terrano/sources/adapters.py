"""Listing-shaped views of the test tables: selections only, so that filters reach the scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: The moment time-dependent operators count from in the registered queries.
AS_OF = "1998-08-01 00:00:00"
#: Captured texts that are no address, of each kind, and one that is.
NO_ADDRESSES = ("info@correo.example", "Tel: 4123", "Llamar al +54 341 412-3456", "Depto a $ 85.000", "120.000 pesos", "Mitre 1 2 3 " + "piso alto " * 9, "Roca 250", "Casa en Superficie lote 3")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def agencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, nombre, ciudad, provincia, categoria of every customer."""
    places = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = table(spark, sf_dir, "customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.col("n_name").alias("ciudad"), F.col("r_name").alias("provincia"), F.col("c_mktsegment").alias("categoria"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One listing for each order; area and images come from its line items."""
    items = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("area"), F.count("*").alias("n"))
    rows = table(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    i = F.col("o_orderkey")
    return rows.select(
        i.alias("id"),
        F.col("o_custkey").alias("inmobiliaria_id"),
        F.when(i % 17 == 0, 0.0).otherwise(F.col("o_totalprice")).alias("precio"),
        F.when(i % 3 == 0, "USD").otherwise("ARS").alias("moneda"),
        F.when(F.col("o_orderstatus") == "O", "activa").when(F.col("o_orderstatus") == "F", "vendida").otherwise("reservada").alias("estado"),
        F.when(F.col("o_orderpriority").startswith("1"), "venta")
        .when(F.col("o_orderpriority").startswith("2"), "alquiler")
        .when(F.col("o_orderpriority").startswith("3"), "alquiler_temporario")
        .when(F.col("o_orderpriority").startswith("4"), "consultar")
        .otherwise("venta_y_alquiler")
        .alias("operacion"),
        F.element_at(F.array(*map(F.lit, ("casa", "departamento", "terreno", "local", "oficina", "cochera", "otro"))), (i % 7 + 1).cast("int")).alias("tipo"),
        F.coalesce("area", F.lit(0.0)).alias("area"),
        F.coalesce("n", F.lit(0)).alias("n_imagenes"),
        (i % 6).alias("ambientes"),
        (i % 4).alias("dormitorios"),
        F.when(i % 11 != 0, -34.0 - (i % 1000) / 512.0).alias("latitud"),
        F.when(i % 11 != 0, -58.0 - (i % 700) / 256.0).alias("longitud"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderpriority").alias("tier"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captured listings with the usual defects, from the orders."""
    i, price = F.col("o_orderkey"), F.floor("o_totalprice")
    pick = lambda values: F.element_at(F.array(*map(F.lit, values)), (i % len(values) + 1).cast("int"))
    local = F.concat(F.floor(price / 1000).cast("string"), F.lit("."), F.lpad((price % 1000).cast("string"), 3, "0"), F.lit(",5"))
    return table(spark, sf_dir, "orders").select(
        i.alias("id"),
        F.when(i % 23 != 0, F.sha2((i - i % 41).cast("string"), 256)).alias("hash_dedup"),
        F.when(i % 29 == 0, "0").when(i % 31 == 0, "x").otherwise(F.col("o_custkey").cast("string")).alias("inmobiliaria_id"),
        F.when(i % 37 != 0, F.concat(F.when(i % 18 == 0, "https://www.tandil-hogar.com.ar").when(i % 27 == 0, "https://saltamendoza.com").otherwise(F.concat(F.lit("https://www.site"), (F.col("o_custkey") % 50).cast("string"), F.lit(".example.com"))), F.lit("/Propiedad/"), i.cast("string"), F.lit("/"))).alias("url"),
        F.when(i % 13 != 0, F.concat(F.lit("Propiedad "), i.cast("string"))).alias("titulo"),
        F.when(i % 7 == 0, None).when(i % 19 == 0, "abc").when(i % 17 == 0, "0").when(i % 5 == 0, local).otherwise(price.cast("string")).alias("precio"),
        pick(("ARS", "usd", "USD", "eur", "ARS")).alias("moneda"),
        pick(("venta", "En Venta", "ALQUILER", "rent", "temporario", "venta y alquiler", "emprendimiento", "sale", " ", "sale and rent", "consultar")).alias("operacion"),
        F.when(i % 9 != 0, F.concat(F.lit("Ciudad "), (i % 20).cast("string"))).alias("ciudad"),
        F.when((i % 9 != 0) & (i % 4 != 0), F.concat(F.lit("Provincia "), (i % 5).cast("string"))).alias("provincia"),
        F.when(i % 14 != 0, "Casa").alias("tipo_propiedad"),
        (i % 4).alias("n_imagenes"),
        F.when(i % 6 == 0, F.element_at(F.array(*map(F.lit, NO_ADDRESSES)), (F.floor(i / 6) % len(NO_ADDRESSES) + 1).cast("int"))).when(i % 8 != 0, F.concat(F.lit("Calle "), (i % 300).cast("string"))).alias("direccion"),
        F.when(i % 10 == 0, -10.0).when(i % 3 != 0, -34.5).alias("latitud"),
        F.when(i % 3 != 0, -58.5).alias("longitud"),
        F.col("o_orderdate").alias("created_at"),
        F.lower("o_orderstatus").alias("status"),
        i.alias("pos"),
    )


def queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Publish-queue rows from the orders."""
    i = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        i.alias("staging_id"),
        F.left("o_orderpriority", F.lit(1)).cast("int").alias("priority"),
        F.col("o_orderdate").alias("queued_at"),
        F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", "done").otherwise("publishing").alias("status"),
        (i % 7).alias("attempts"),
    )


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error-log rows from the events."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 10).alias("run_id"),
        (F.col("user_id") % 100).alias("inmobiliaria_id"),
        F.col("event_type").alias("fase"),
        F.when(F.col("event_id") % 3 == 0, "critical").otherwise("warning").alias("severidad"),
        F.when(F.col("event_id") % 5 == 0, "timeout").otherwise("http_500").alias("error_type"),
        F.when(F.col("event_id") % 4 != 0, F.col("event_id") % 2 == 0).alias("recuperable"),
        F.col("ts").alias("ocurrido_en"),
    )


def run_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scraping run items from the events."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        (F.col("user_id") % 20).alias("run_id"),
        (F.col("user_id") % 300).alias("inmobiliaria_id"),
        F.when(kind == "error", "error").when(kind == "signup", "pending").otherwise("success").alias("status"),
        (F.col("event_id") % 40).alias("detectadas"),
        (F.col("event_id") % 7).alias("nuevas"),
        F.col("ts").alias("created_at"),
        F.when(kind == "error", F.when(F.col("event_id") % 2 == 0, "timeout").otherwise("parse")).alias("error_type"),
    )
