"""Rollups, audits and gates: one pass of conditional aggregates each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def error_summary(errors: DataFrame, by: list[str]) -> DataFrame:
    """n, recoverable and last time of errors by group; recoverable is null where no row says."""
    return errors.groupBy(*by).agg(F.count("*").alias("n"), F.sum(F.col("recuperable").cast("int")).alias("recuperables"), F.max("ocurrido_en").alias("ultimo"))


def run_rollup(items: DataFrame) -> DataFrame:
    """Counters of each run, recomputed from its items, and whether it may close."""
    state = lambda s: F.count_if(F.col("status") == s)
    return items.groupBy("run_id").agg(
        F.count("*").alias("planificadas"),
        state("success").alias("exitosas"),
        state("error").alias("con_error"),
        F.sum(F.when(F.col("status") == "success", F.col("detectadas"))).alias("detectadas"),
        F.sum(F.when(F.col("status") == "success", F.col("nuevas"))).alias("nuevas"),
        (F.count_if(F.col("status").isin("pending", "running")) == 0).alias("cerrable"),
    )


def coverage(expected: DataFrame, loaded: DataFrame, key: str, zone: Column) -> DataFrame:
    """zona, detectadas, cargadas, faltantes, pct (tenths half up) of expected keys that are loaded."""
    have = loaded.select(key, F.lit(True).alias("_have")).distinct()
    rows = expected.join(have, key, "left").groupBy(zone.alias("zona")).agg(F.count("*").alias("detectadas"), F.count("_have").alias("cargadas"))
    pct = F.floor(F.col("cargadas") * 1000 / F.col("detectadas") + 0.5) / 10
    return rows.withColumn("faltantes", F.col("detectadas") - F.col("cargadas")).withColumn("pct", pct)


def health(df: DataFrame) -> DataFrame:
    """One row: total, with images, priced, located, not located."""
    located = F.col("latitud").isNotNull() & F.col("longitud").isNotNull()
    return df.agg(
        F.count("*").alias("total"),
        F.count_if(F.col("n_imagenes") > 0).alias("con_imagenes"),
        F.count_if(F.col("precio") > 0).alias("con_precio"),
        F.count_if(located).alias("con_coordenadas"),
        F.count_if(~located).alias("sin_coordenadas"),
    )


def stats(df: DataFrame, cap: int | None = 10_000) -> DataFrame:
    """One row: total, alquileres, ventas, con_coordenadas, each at most ``cap``."""
    counts = {
        "total": F.count("*"),
        "alquileres": F.count_if(F.col("operacion") == "alquiler"),
        "ventas": F.count_if(F.col("operacion") == "venta"),
        "con_coordenadas": F.count_if(F.col("latitud").isNotNull()),
    }
    return df.agg(*((F.least(c, F.lit(cap)) if cap else c).alias(n) for n, c in counts.items()))


def bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.min("latitud").alias("lat_min"), F.max("latitud").alias("lat_max"), F.min("longitud").alias("lon_min"), F.max("longitud").alias("lon_max"))


def issue_counts(validated: DataFrame) -> DataFrame:
    """(issue, n) over hard and soft issues."""
    return validated.select(F.explode(F.concat("hard", "soft")).alias("issue")).groupBy("issue").agg(F.count("*").alias("n"))


def problem_counts(agencies: DataFrame, problems: Column) -> DataFrame:
    """(problem, n) over lists of problems."""
    return agencies.select(F.explode(problems).alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


def last_runs(items: DataFrame, n_runs: int = 5, n_errors: int = 5) -> DataFrame:
    """One row for each of the latest runs: items by status, new listings, its most frequent error types (ties: by name)."""
    runs = items.select("run_id").distinct().orderBy(F.desc("run_id")).limit(n_runs)
    recent = items.join(F.broadcast(runs), "run_id", "left_semi")
    counts = recent.groupBy("run_id").agg(
        *(F.count_if(F.col("status") == s).alias(s) for s in ("success", "error", "pending")),
        F.sum(F.coalesce("nuevas", F.lit(0))).alias("nuevas"),
    )
    kinds = recent.where("status = 'error'").groupBy("run_id", F.coalesce("error_type", F.lit("")).alias("error_type")).agg(F.count("*").alias("k"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "error_type")))
    top = kinds.groupBy("run_id").agg(F.transform(F.slice(order, 1, n_errors), lambda e: F.concat(e["error_type"], F.lit("="), (-e["k"]).cast("string"))).alias("_top"))
    return counts.join(top, "run_id", "left").withColumn("errores", F.coalesce(F.array_join("_top", ","), F.lit(""))).drop("_top")


def status_counts(df: DataFrame, status: str, excluded: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """(status, n), without the keys of ``excluded``."""
    rows = df if excluded is None else df.join(excluded.select(key), key, "left_anti")
    return rows.groupBy(status).agg(F.count("*").alias("n"))


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row: total, and for each check the number of rows that fail it; a null fails."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(~F.coalesce(c, F.lit(False))).alias(n) for n, c in checks.items()))


def gate(df: DataFrame, by: list[str], failed: Column, limit: float) -> DataFrame:
    """Rows, failures, rate and whether the rate is within the limit, for each group; a null counts as no failure."""
    rows = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(failed).alias("failed"))
    return rows.withColumn("rate", F.when(F.col("n") > 0, F.col("failed") / F.col("n")).otherwise(0.0)).withColumn("ok", F.col("rate") <= limit)


def top_counts(df: DataFrame, by: str, n: int = 20) -> DataFrame:
    """The most frequent values, ties by value: the report's length is its feature."""
    return df.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by).limit(n)


def stuck(df: DataFrame, status: str, key: str, n: int = 5) -> DataFrame:
    """The first few keys in a state that no row should be in."""
    return df.where(F.col("status") == status).select(key).orderBy(key).limit(n)


def before_after(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(change, n, antes, despues) of a count by key: recovered, lost, gained, reduced, same; an absent key counts zero."""
    both = before.select(key, F.col(value).alias("_b")).join(after.select(key, F.col(value).alias("_a")), key, "full")
    b, a = (F.coalesce(c, F.lit(0)) for c in ("_b", "_a"))
    change = F.when((b == 0) & (a > 0), "recovered").when((b > 0) & (a == 0), "lost").when(a > b, "gained").when(a < b, "reduced").otherwise("same")
    return both.groupBy(change.alias("change")).agg(F.count("*").alias("n"), F.sum(b).alias("antes"), F.sum(a).alias("despues"))


def enrichment_stats(agencies: DataFrame, points: Column, site: Column, phone: Column) -> DataFrame:
    """One row: total, con_web, sin_telefono, sin_provincia, confianza (mean points, null if there are no rows)."""
    return agencies.agg(
        F.count("*").alias("total"),
        F.count_if(site).alias("con_web"),
        F.count_if(~phone).alias("sin_telefono"),
        F.count_if(F.coalesce("provincia", F.lit("")) == "").alias("sin_provincia"),
        F.avg(points).alias("confianza"),
    )


#: Categories of sources by what their detail pages gave.
QUALITY_CATEGORIES = {
    "regression_warning": "high", "regression_ok": "low", "http_error_on_detail": "medium", "false_positive_links": "high", "detail_parse_ok": "low", "detail_parse_partial": "low", "listing_links_ok_but_detail_weak": "medium",
    "needs_detail_parser_fix": "medium", "manual_review": "medium",
}


def detail_quality(title: Column, price: Column, operation: Column, kind: Column, place: Column, description: Column) -> Column:
    """struct(score, label) of a detail page's fields: title and price count two, the others one; a title, place or description must be more than a word."""
    longer = lambda c, n: F.coalesce(F.length(c) > n, F.lit(False))
    given = lambda c: F.coalesce(c != "", F.lit(False))
    rules = [(longer(title, 5), 2), (given(price), 2), (given(operation), 1), (given(kind), 1), (longer(place, 3), 1), (longer(description, 30), 1)]
    score = sum((F.when(hit, n).otherwise(0) for hit, n in rules), F.lit(0))
    return F.struct(score.alias("score"), F.when(score >= 6, "high").when(score >= 4, "medium").when(score >= 2, "low").otherwise("very_low").alias("label"))


def source_category(group: Column, old_cards: Column, new_cards: Column, all_errors: Column, all_listings: Column, score: Column) -> Column:
    """struct(category, risk) of a source: regressions by card counts, then errors, pages that are lists, then the best score."""
    lost = (old_cards > 0) & (new_cards == 0)
    name = (
        F.when((group == "regression") & (lost | all_errors), "regression_warning")
        .when(group == "regression", "regression_ok")
        .when(all_errors, "http_error_on_detail")
        .when(all_listings, "false_positive_links")
        .when(score >= 6, "detail_parse_ok")
        .when(score >= 4, "detail_parse_partial")
        .when(score >= 2, "listing_links_ok_but_detail_weak")
        .when(score == 0, "needs_detail_parser_fix")
        .otherwise("manual_review")
    )
    risk = F.create_map(*(F.lit(v) for kv in QUALITY_CATEGORIES.items() for v in kv))[name]
    return F.struct(name.alias("category"), F.when((group == "regression") & ~lost & all_errors, "medium").otherwise(risk).alias("risk"))


def best_samples(samples: DataFrame, source: str, score: str, order: str) -> DataFrame:
    """Each source's sample of the highest score, the first on ties."""
    return samples.groupBy(source).agg(F.max_by(F.struct("*"), F.struct(F.col(score), (-F.col(order)).alias("_o"))).alias("_x")).select("_x.*")


def regressions(before: DataFrame, after: DataFrame, key: str, count: str) -> DataFrame:
    """(key, antes, despues, recovered, regression): counts of both parsers; a source that one lacks counts zero there."""
    both = before.select(key, F.col(count).alias("antes")).join(after.select(key, F.col(count).alias("despues")), key, "full").na.fill(0, ["antes", "despues"])
    return both.withColumn("recovered", (F.col("antes") == 0) & (F.col("despues") > 0)).withColumn("regression", (F.col("antes") > 0) & (F.col("despues") == 0))


def progress(items: DataFrame, started: str, as_of: str) -> DataFrame:
    """One row: total, done, elapsed seconds and the seconds left at that pace; null before the first is done."""
    done = F.count_if(F.col("status").isin("success", "error"))
    rows = items.agg(F.count("*").alias("total"), done.alias("done"), F.min(started).alias("_from"))
    elapsed = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(F.col("_from").cast("timestamp"))
    left = F.when(F.col("done") > 0, F.round(elapsed / F.col("done") * (F.col("total") - F.col("done"))).cast("long"))
    return rows.select("total", "done", elapsed.alias("elapsed"), left.alias("eta"))


def markdown(df: DataFrame, title: str, rows: int = 200) -> str:
    """A report's first rows as a Markdown table; for reports of few rows, whose length is their feature."""
    line = lambda values: "| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in values) + " |"
    return "\n".join([f"# {title}", "", line(df.columns), line("-" for _ in df.columns), *(line(r) for r in df.limit(rows).collect())]) + "\n"


def not_loaded(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Rows (nombre, web) that a table lacks, by site without last slash or by name, both without regard to case; a row that either knows is loaded."""
    site = lambda c: F.nullif(F.lower(F.rtrim(F.trim(c), F.lit("/"))), F.lit(""))
    name = lambda c: F.nullif(F.lower(F.trim(c)), F.lit(""))
    sites, names = (known.select(f.alias(k)).where(F.col(k).isNotNull()).distinct() for f, k in ((site(F.col("web")), "_w"), (name(F.col("nombre")), "_n")))
    keyed = rows.withColumns({"_w": site(F.col("web")), "_n": name(F.col("nombre"))})
    return keyed.join(sites, "_w", "left_anti").join(names, "_n", "left_anti").drop("_w", "_n")


def membership_audit(df: DataFrame, unique: str, key: str, members: DataFrame) -> DataFrame:
    """One row: total, repetidos (rows beyond the first of a value that should be unique), fuera (rows whose key another table lacks)."""
    repeated = df.groupBy(unique).agg(F.count("*").alias("n")).agg(F.sum("n").alias("total"), F.sum(F.col("n") - 1).alias("repetidos"))
    outside = df.join(members.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("fuera"))
    return repeated.crossJoin(F.broadcast(outside))  # one row each
