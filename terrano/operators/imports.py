"""From captured properties to raw rows: checks, values, identity, marks of likely duplicates, and what is new.

Captures: capture_id, pos, source_url, prop (map of texts), images (array). Sources: url, inmobiliaria_id and the agency's place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions import images as I, normalize as N, parsing as P, places as L, urls as U
from terrano.operators.dedupe import cross_owner, first_wins
from terrano.session import written

#: Points that warnings take from a row without a score of its own.
PENALTIES = ((("missing_location",), 15), (("missing_type", "invalid_type"), 15), (("missing_images",), 10), (("invalid_price", "invalid_currency"), 20), (("invalid_operation",), 20))
PICTURE_PATH = r"(?i)\.(?:jpg|jpeg|png|gif|webp|svg|bmp|ico)$"


def quality(given: Column, warnings: Column, price: Column) -> Column:
    """A row's own score from 0 to 100, else 100 without points for warnings and a missing price."""
    number = given.try_cast("double").cast("int")
    own = F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0)), F.lit(100)))
    lost = sum((F.when(F.arrays_overlap(warnings, F.array(*map(F.lit, names))), n).otherwise(0) for names, n in PENALTIES), F.when(F.coalesce(price, F.lit("")) == "", 20).otherwise(0))
    return F.coalesce(own, F.least(F.greatest(100 - lost, F.lit(0)), F.lit(100)))


def prefix_matches(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(_c, _by_prefix): for canonical URLs the first source whose URL begins like theirs, or theirs like its.

    rows: _c; sources: _c, pos, held. Each side's URLs are cut at the lengths that the other side's have, and the pieces meet in equi-joins,
    so no host's rows are paired.
    """
    urls = rows.where("_c <> ''").select("_c").distinct()
    firsts = sources.where("_c <> ''").groupBy(F.col("_c").alias("_s")).agg(F.min(F.struct("pos", "held")).alias("_x"))
    lengths = lambda df, c: F.array(*(F.lit(r[0]) for r in df.select(F.length(c)).distinct().orderBy(F.length(c)).collect()))  # noqa: E731  as many as URLs have lengths
    if not firsts.limit(1).count() or not urls.limit(1).count():
        return urls.select("_c", F.lit(None).cast(sources.schema["held"].dataType).alias("_by_prefix")).limit(0)
    cut = lambda c, sizes: F.explode(F.transform(F.filter(sizes, lambda n: n <= F.length(c)), lambda n: F.left(c, n)))
    longer = urls.select("_c", cut(F.col("_c"), lengths(firsts, "_s")).alias("_s")).join(firsts, "_s").select("_c", "_s", "_x")
    shorter = firsts.select("_s", "_x", cut(F.col("_s"), lengths(urls, "_c")).alias("_c")).join(urls, "_c").select("_c", "_s", "_x")
    host = lambda c: F.regexp_extract(c, "^([^/?]*)", 1)  # noqa: E731  x.com is no beginning of x.com.ar
    return longer.unionByName(shorter).where(host("_c") == host("_s")).groupBy("_c").agg(F.min("_x").alias("_x")).select("_c", F.col("_x.held").alias("_by_prefix"))


def resolved(captures: DataFrame, sources: DataFrame) -> DataFrame:
    """``captures`` with the source of the same canonical URL, the first one listed, else the only one of the host, else the first of the host's whose URL begins like theirs or theirs like its; null if none."""
    src = sources.withColumn("_c", U.canonical(F.col("url"))).withColumn("_h", F.regexp_extract("_c", "^([^/?]*)", 1))
    held = F.struct("inmobiliaria_id", "inmob_ciudad", "inmob_provincia")
    exact = src.where("_c <> ''").groupBy("_c").agg(F.min_by(held, "pos").alias("_exact"))
    single = src.where("_h <> ''").groupBy("_h").agg(F.min_by(held, "pos").alias("_single"), F.count("*").alias("_n")).where("_n = 1").drop("_n")
    rows = captures.withColumn("_c", U.canonical(F.col("source_url"))).withColumn("_h", F.regexp_extract("_c", "^([^/?]*)", 1))
    near = prefix_matches(rows.join(single, "_h", "left_anti"), src.select("_c", "pos", held.alias("held")))
    found = rows.join(exact, "_c", "left").join(single, "_h", "left").join(near, "_c", "left")
    return found.withColumn("source", F.coalesce("_exact", "_single", "_by_prefix")).drop("_c", "_h", "_exact", "_single", "_by_prefix")


def candidates(captures: DataFrame) -> DataFrame:
    """``captures`` (with source) as raw rows: their values, warnings in order, and rejected, whether a warning forbids them."""
    prop = lambda k: F.col("prop")[k]
    c = F.col
    df = captures.withColumns(
        {
            "inmobiliaria_id": F.coalesce(F.col("source.inmobiliaria_id"), prop("inmobiliaria_id").try_cast("long"), F.lit(0).cast("long")),
            "url": N.squeeze(prop("url")),
            "titulo": P.truncated(prop("titulo"), 300),
            "_operation": N.imported_operation(prop("operacion")),
            "_path_operation": U.operation_of_path(prop("url")),
            "_own_type": P.own_type(prop("tipo_propiedad")),
            "_price": N.locale_number(prop("precio")),
            "moneda": P.import_currency(prop("moneda")),
            "_city": P.truncated(prop("ciudad"), 120),
            "_province": P.truncated(prop("provincia"), 120),
            "barrio": P.truncated(prop("barrio"), 120),
            "imagenes": I.imported(F.col("images")),
            "_address": L.address_value(prop("direccion"), imported=True),
        }
    )
    df = df.withColumns({"url_normalizada": U.canonical(c("url")), "operacion": F.coalesce("_path_operation", "_operation"), "_rural": L.rural_type(c("url"), c("_own_type")), "precio": F.when(c("_price") > 0, c("_price"))})
    fallback = c("_city").isNull() & c("_province").isNull() & (F.trim(F.coalesce("source.inmob_ciudad", F.lit(""))) != "")
    df = df.withColumns(
        {
            "tipo_propiedad": F.coalesce("_rural", "_own_type"),
            "ciudad": F.when(fallback, F.trim("source.inmob_ciudad")).otherwise(c("_city")),
            "provincia": F.when(fallback, F.nullif(F.trim("source.inmob_provincia"), F.lit(""))).otherwise(c("_province")),
            "hash_dedup": F.when(c("inmobiliaria_id") > 0, U.identity_hash(c("inmobiliaria_id"), prop("id_externo"), c("url"))),
        }
    )
    made = L.file_title(c("titulo"), c("tipo_propiedad"), c("operacion"), c("provincia"))
    given = F.coalesce(prop("precio"), F.lit("")) != ""
    hard = [
        ("missing_inmobiliaria_id", c("inmobiliaria_id") <= 0),
        ("missing_url", c("url").isNull() | (c("url_normalizada") == "")),
        ("url_is_image_file", F.rlike(U.unquoted(F.regexp_extract(F.coalesce("url", F.lit("")), "^(?:[a-zA-Z]+://[^/?#]*)?([^?#]*)", 1)), F.lit(PICTURE_PATH))),
        ("missing_title", c("titulo").isNull()),
        ("ui_contaminated_title", L.control_title(c("titulo"))),
    ]
    soft = [
        ("operation_inferred_from_url_path", c("_path_operation").isNotNull() & ~c("_path_operation").eqNullSafe(c("_operation"))),
        ("invalid_operation", c("operacion").isNull()),
        ("tipo_inferred_from_rural_domain", c("_rural").isNotNull()),
        ("missing_type", F.coalesce("tipo_propiedad", F.lit("otro")) == "otro"),
        ("invalid_price", given & c("precio").isNull()),
        ("invalid_currency", c("precio").isNotNull() & ~F.coalesce(c("moneda").isin("ARS", "USD"), F.lit(False))),
        ("ciudad_fallback_inmob", fallback),
        ("missing_location", c("_city").isNull() & c("_province").isNull() & ~fallback),
        ("titulo_sintetizado_desde_filename", made.isNotNull()),
        ("missing_images", F.size("imagenes") == 0),
    ]
    listed = lambda rules: F.array_compact(F.array(*(F.when(F.coalesce(hit, F.lit(False)), name) for name, hit in rules)))
    df = df.withColumn("_hard", listed(hard)).withColumn("_soft", listed(soft))
    df = df.withColumn("score", quality(prop("score_calidad"), F.concat("_hard", "_soft"), prop("precio")))
    late = listed([("missing_hash", c("hash_dedup").isNull()), ("low_quality_score", c("score") < 60), ("invalid_address", c("_address.reason").isNotNull())])
    signature = F.btrim(F.concat_ws("|", "url_normalizada", *(F.lower(F.coalesce(x, F.lit(""))) for x in (c("_address.value"), c("ciudad"), c("provincia"))), F.coalesce(c("precio").cast("string"), F.lit(""))), F.lit("|"))
    return df.select(
        "pos", "inmobiliaria_id", "hash_dedup", F.coalesce(made, c("titulo")).alias("titulo"), P.truncated(prop("descripcion"), 500).alias("descripcion"), "precio", "moneda", "tipo_propiedad", "operacion", "url", "url_normalizada",
        c("_address.value").alias("direccion_raw"), "barrio", "ciudad", "provincia", F.coalesce(P.truncated(prop("pais"), 80), F.lit("Argentina")).alias("pais"), "imagenes", "score", signature.alias("firma"),
        F.concat("_hard", "_soft", late).alias("warnings"), ((F.size("_hard") > 0) | c("hash_dedup").isNull()).alias("rejected"),
    )


def address_key() -> Column:
    """Address (80 characters), city and province in lower case; null if that is five characters or fewer."""
    part = lambda x: F.nullif(F.trim(F.lower(x)), F.lit(""))
    key = F.concat_ws("|", F.nullif(F.left(F.trim(F.lower("direccion_raw")), F.lit(80)), F.lit("")), part(F.col("ciudad")), part(F.col("provincia")))
    return F.when(F.length(key) > 5, key)


def marked(rows: DataFrame) -> DataFrame:
    """Distinct candidates (the first of each hash) with cross_agency, another agency had their URL first, and same_address, an earlier row has their address.

    Rows without a key meet nothing; both marks come from the first row of each key, aggregated before they are joined.
    """
    unique = first_wins(rows.where("hash_dedup is not null"), ["hash_dedup"], [F.col("pos").asc()])
    unique = cross_owner(unique, "url_normalizada", "inmobiliaria_id", "pos").withColumnRenamed("cross_owner", "cross_agency").drop("first_owner")
    keyed = unique.withColumn("_k", F.coalesce(address_key(), F.concat(F.lit("\0"), F.col("pos").cast("string"))))
    first = keyed.groupBy("_k").agg(F.min("pos").alias("_first"))
    return keyed.join(first, "_k").withColumn("same_address", F.col("pos") != F.col("_first")).drop("_k", "_first")


def new_rows(rows: DataFrame, known_hashes: DataFrame) -> DataFrame:
    """Rows whose hash is in no table yet."""
    return rows.join(known_hashes.select("hash_dedup").where("hash_dedup is not null").distinct(), "hash_dedup", "left_anti")


def first_reasons(rows: DataFrame, lookups: list[tuple[str, str, DataFrame]]) -> DataFrame:
    """``rows`` with reason: the first lookup (reason, key, table of keys) that already has them; null for new ones."""
    reason, df = None, rows
    for n, (name, key, known) in enumerate(lookups):
        df = df.join(known.select(F.col(known.columns[0]).alias(key), F.lit(True).alias(f"_k{n}")).where(F.col(key).isNotNull()).distinct(), key, "left")
        reason = F.when(F.col(f"_k{n}"), name) if reason is None else reason.when(F.col(f"_k{n}"), name)
    return df.withColumn("reason", reason).drop(*(f"_k{n}" for n in range(len(lookups))))


def imported(captures: DataFrame, sources: DataFrame, known_hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw rows to add, warnings by capture) of an import: sources resolved, rows checked and made, copies and known rows left out."""
    made = written(candidates(resolved(captures, sources)), "candidates")  # some fifty expressions a row, read several times below
    rows = new_rows(marked(made.where(~F.col("rejected"))), known_hashes)
    return rows, made.select("pos", F.explode("warnings").alias("issue_type"))
