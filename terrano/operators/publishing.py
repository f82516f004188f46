"""The publish queue as tables: staging rows in, records out, attempts, retries. Every step is a new snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions import images as I, normalize as N, parsing as P
from terrano.functions.urls import identity_hash
from terrano.operators import lifecycle


def selection_mode(ids: bool, backlog: bool, run: int | None) -> str:
    """Which staging rows a queue is built of: an id list before the backlog, before a run, before the latest finished run."""
    return "ids_file" if ids else "backlog" if backlog else "run" if run is not None else "run_latest"


def classified(staging: DataFrame, queue: DataFrame, min_score: int = 0, allow_pending: bool = True, canonical_url: str | None = None) -> DataFrame:
    """``staging`` with outcome (queued, skip_already_queued or a reason) and priority of queued rows. queue: staging_id, status."""
    have = queue.where(F.col("status").isin("pending", "publishing", "done")).select(F.col("staging_id").alias("id"), F.lit(True).alias("_have")).distinct()
    reason = lifecycle.queue_skip_reason(min_score, allow_pending, canonical_url)
    out = staging.join(have, "id", "left").withColumn("outcome", F.when(F.col("_have"), "skip_already_queued").otherwise(F.coalesce(reason, F.lit("queued"))))
    rank = lifecycle.priority(F.coalesce("validation_score", F.lit(0)), F.col("geocoding_status"), F.col("precio_num"))
    return out.withColumn("priority", F.when(F.col("outcome") == "queued", rank)).drop("_have")


def queue_rows(classified: DataFrame, as_of: str) -> DataFrame:
    """The rows that enter the queue."""
    return classified.where("outcome = 'queued'").select(
        F.col("id").alias("staging_id"), F.lit(None).cast("long").alias("propiedad_supabase_id"), F.lit("upsert").alias("action"), "priority", F.lit(0).alias("attempts"), F.lit("pending").alias("status"), F.lit(as_of).cast("timestamp").alias("queued_at")
    )


def with_state(df: DataFrame, ids: DataFrame, key: str, state: str, column: str = "status") -> DataFrame:
    """``df`` with the state set on the rows of the ids."""
    found = ids.select(F.col(ids.columns[0]).alias(key), F.lit(True).alias("_in")).distinct()
    return df.join(found, key, "left").withColumn(column, F.when(F.col("_in"), state).otherwise(F.col(column))).drop("_in")


def record(staging: DataFrame) -> DataFrame:
    """Staging rows as published: pictures without logos, activa unless a state is given, the address under its own name."""
    kept = [c for c in staging.columns if c not in ("imagenes", "direccion_normalizada", "estado", "id", "status")]
    state = F.coalesce(F.nullif("estado", F.lit("")), F.lit("activa")) if "estado" in staging.columns else F.lit("activa")
    return staging.select("id", *kept, F.col("direccion_normalizada").alias("direccion"), I.split(F.col("imagenes"))["kept"].alias("imagenes"), state.alias("estado"))


def payload(props: DataFrame) -> DataFrame:
    """Captured properties as records: areas and counts as 32-bit whole numbers, renamed area and source, activa, identity hash."""
    small = lambda c: P.int32(F.col(c)).alias(c)
    same = ("url", "titulo", "precio", "moneda", "direccion", "barrio", "tipo_propiedad", "descripcion", "imagenes", "ciudad", "operacion", "latitud", "longitud")
    return props.select(
        *(c for c in same if c in props.columns), small("dormitorios"), small("banos"), small("ambientes"), P.int32(F.col("metros")).alias("superficie_total"), F.col("fuente").alias("fuente_extraccion"),
        F.lit("activa").alias("estado"), "inmobiliaria_id", identity_hash(F.coalesce(F.col("inmobiliaria_id").cast("string"), F.lit("None")), F.lit(None).cast("string"), F.col("url")).alias("hash_dedup"),
    )


def is_valid(url: Column, title: Column, address: Column, place: Column, kind: Column, currency: Column) -> Column:
    """Whether a captured property can be a record: absolute URL, a title, an address or neighbourhood, known type and currency; no currency is fine."""
    text = lambda c: F.coalesce(c, F.lit(""))
    types = ("casa", "departamento", "terreno", "local", "oficina", "cochera", "galpon", "otro")
    return text(url).startswith("http") & (F.length(F.trim(text(title))) >= 3) & ((text(address) != "") | (text(place) != "")) & text(kind).isin(*types) & ((text(currency) == "") | text(currency).isin("ARS", "USD"))


def completeness(price: Column, area: Column, address: Column, pictures: Column, operation: Column) -> Column:
    """0 to 5: a price, an area, an address, a picture and a known operation count one each."""
    known = F.lower(F.trim(operation)).isin(*N.OPERATIONS, "proyecto")
    rules = (price.isNotNull(), area.isNotNull(), address != "", F.size(pictures) > 0, known)
    return sum((F.when(F.coalesce(rule, F.lit(False)), 1).otherwise(0) for rule in rules), F.lit(0))


def backoff(attempt: Column, base: float = 1.0, most: float = 30.0, jitter: Column | None = None) -> Column:
    """Seconds to wait before a retry: doubled each time up to ``most``, plus up to a quarter by ``jitter`` from 0 to 1."""
    wait = F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))
    return wait if jitter is None else wait + wait * 0.25 * jitter


def published(claimed: DataFrame, staging: DataFrame, properties: DataFrame, min_score: int, allow_pending: bool, as_of: str) -> tuple[DataFrame, DataFrame]:
    """The claimed queue rows after an attempt, and the properties after it.

    Rows without staging row or that fail a rule become failed, with the reason and one more attempt; deactivations set the state
    of their property; the rest is merged into the properties by identity hash and done. Of staging rows of one hash the last id holds.
    """
    rows = claimed.join(staging.withColumnsRenamed({"id": "staging_id", "status": "staging_status"}), "staging_id", "left").withColumn("_missing", F.col("staging_status").isNull())
    as_staging = rows.withColumn("_queue", F.col("status")).withColumn("status", F.col("staging_status"))
    reason = F.when(F.col("action") == "deactivate", None).when(F.col("_missing"), "missing_staging").otherwise(lifecycle.publish_skip_reason(min_score, allow_pending))
    as_staging = as_staging.withColumn("error_message", reason)
    now = F.lit(as_of).cast("timestamp")
    ok = F.col("error_message").isNull()
    queue = as_staging.select(
        "staging_id", "propiedad_supabase_id", "action", "priority", (F.col("attempts") + F.when(ok, 0).otherwise(1)).alias("attempts"), F.when(ok, "done").otherwise("failed").alias("status"), "queued_at", "error_message", now.alias("last_attempt_at")
    )
    good = as_staging.where(ok & (F.col("action") != "deactivate"))
    fields = [c for c in properties.columns if c not in ("id", "hash_dedup", "estado")]
    new = good.groupBy("hash_dedup").agg(F.max_by(F.struct(*fields), "staging_id").alias("_x")).select("hash_dedup", "_x.*", F.lit("activa").alias("estado"))
    off = as_staging.where(ok & (F.col("action") == "deactivate")).select(F.col("propiedad_supabase_id").alias("id"), F.lit(True).alias("_off")).distinct()
    merged = properties.alias("p").join(new.alias("n"), "hash_dedup", "full").join(off, "id", "left")
    state = F.when(F.col("_off"), "no_detectada_en_ultimo_scraping").otherwise(F.coalesce("n.estado", "p.estado"))
    return queue, merged.select("id", "hash_dedup", *(F.when(F.col("n.estado").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"p.{c}")).alias(c) for c in fields), state.alias("estado"))
