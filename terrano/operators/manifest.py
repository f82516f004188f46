"""Manifests of sources: ordered rules, sources for a run, agencies behind them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from terrano.functions.urls import netloc
from terrano.operators.dedupe import first_wins

#: Hosts that no source may have, states and errors that keep a source out.
PROHIBITED_HOSTS = (
    "facebook.com", "instagram.com", "twitter.com", "x.com", "tiktok.com", "linkedin.com", "youtube.com", "youtu.be", "mercadolibre.com", "argenprop.com", "zonaprop.com", "properati.com", "navent.com",
    "inmuebles24.com", "mitula.com.ar", "nuroa.com.ar", "wa.me", "whatsapp.com", "t.me", "bit.ly", "linktr.ee", "wordpress.com", "blogspot.com", "wixsite.com", "maps.google", "google.com",
)
BLOCKED_STATES = ("still_failed", "http_error", "error")
BLOCKED_ERRORS = ("http_error", "connection_error", "domain_down", "missing_url")
ERROR_TYPES = ("timeout", "item_timeout", "static_timeout", "connection_error", "http_error")


def prohibited(url: Column) -> Column:
    """Whether a URL's host is one that no source may have, or under one."""
    host = netloc(url)
    out = host.isin(*PROHIBITED_HOSTS)
    for name in PROHIBITED_HOSTS:
        out = out | host.endswith("." + name)
    return out


def _text(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit("")))


def listing_url() -> Column:
    """The new URL of the listings if there is one, else the old."""
    return F.trim(F.coalesce(F.nullif(F.col("new_url_listado"), F.lit("")), F.col("old_url_listado"), F.lit("")))


def checked(rows: DataFrame, order: str, excluded: DataFrame | None = None) -> DataFrame:
    """``rows`` with reason, the first rule that fails, null for valid ones; of valid rows of one source_id the first stays.

    Columns of a manifest are texts; excluded: source_id.
    """
    sid, url, error = _text("source_id"), listing_url(), F.lower(_text("error"))
    reason = (
        F.when(sid == "", "missing source_id")
        .when(url == "", "missing url_listado")
        .when(prohibited(url), F.concat(F.lit("prohibited domain: "), netloc(url)))
        .when(_text("combined_status").isin(*BLOCKED_STATES), F.concat(F.lit("blocked combined_status="), _text("combined_status")))
        .when(error.isin(*BLOCKED_ERRORS), F.concat(F.lit("blocked error_type="), error))
        .when(F.lower(_text("needs_playwright")) == "true", "needs_playwright=True — excluded")
    )
    df = rows.withColumn("_sid", sid)
    if excluded is not None:
        df = df.join(excluded.select(F.trim("source_id").alias("_sid"), F.lit(True).alias("_out")).distinct(), "_sid", "left")
        reason = reason.when(F.col("_out"), "source_id found in manifest_excluded")
    df = df.withColumn("reason", reason)
    first = df.where("reason is null").groupBy("_sid").agg(F.min(order).alias("_first"))
    again = F.col("reason").isNull() & (F.col(order) != F.col("_first"))
    df = df.join(first, "_sid", "left").withColumn("reason", F.when(again, "duplicate source_id").otherwise(F.col("reason")))
    return df.select(*rows.columns, "reason")


def sources(valid: DataFrame) -> DataFrame:
    """(key, source_id, web, name): what a run visits; the key is the name in lower case, 40 characters at most, or made of the id."""
    name, sid = _text("source_name"), _text("source_id")
    slug = F.btrim(F.left(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), F.lit(40)), F.lit("_"))
    return valid.select(F.coalesce(F.nullif(slug, F.lit("")), F.concat(F.lit("src_"), sid)).alias("key"), sid.alias("source_id"), listing_url().alias("web"), name.alias("name"))


def with_agencies(rows: DataFrame, agencies: DataFrame) -> DataFrame:
    """``rows`` with inmobiliaria_id, null where no agency came from the source. agencies: origen_id, inmobiliaria_id, the smallest wins."""
    known = agencies.where("origen_id is not null").groupBy(F.col("origen_id").cast("string").alias("source_id")).agg(F.min("inmobiliaria_id").alias("inmobiliaria_id"))
    return rows.join(known, "source_id", "left")


def preflight(rows: DataFrame) -> DataFrame:
    """One row: total, matched, unmatched, pct (tenths) of rows with an agency."""
    out = rows.agg(F.count("*").alias("total"), F.count("inmobiliaria_id").alias("matched"))
    return out.withColumn("unmatched", F.col("total") - F.col("matched")).withColumn("pct", F.when(F.col("total") > 0, F.round(100 * F.col("matched") / F.col("total"), 1)).otherwise(0.0))


def error_types(raw: str) -> list[str]:
    """Distinct error types of a comma list, sorted; others than the known are refused."""
    found = sorted({x.strip() for x in raw.split(",") if x.strip()})
    if unknown := [x for x in found if x not in ERROR_TYPES]:
        raise ValueError(f"unknown error types: {', '.join(unknown)}")
    if not found:
        raise ValueError("no error types")
    return found


def own_sources(rows: DataFrame, url: str, order: str, skipped: tuple[str, ...]) -> DataFrame:
    """Sources with an absolute URL that names no portal or network, the first of each host."""
    low = F.lower(F.trim(url))
    keep = F.rlike(low, F.lit("^https?://")) & ~F.rlike(low, F.lit("|".join(s.replace(".", r"\.") for s in skipped)))
    return first_wins(rows.where(keep).withColumn("_host", netloc(low)), ["_host"], [F.col(order).asc()]).drop("_host")
