"""Upserts, snapshot differences, history and set operations on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` with rows of the same key replaced by ``new``'s, and new keys added."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def insert_missing(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and the rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys), keys, "left_anti"))


def fill_missing(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Every key of either side; the old value where there is one, else the new."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*(F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c) for c in old.columns))


def disappeared(old: DataFrame, snapshot: DataFrame, key: str, state: str = "estado", to: str = "no_detectada_en_ultimo_scraping") -> DataFrame:
    """``old`` with the state of rows that the snapshot lacks set to ``to``; nothing is deleted."""
    seen = snapshot.select(F.col(key), F.lit(True).alias("_seen")).distinct()
    return old.join(seen, key, "left").withColumn(state, F.when(F.col("_seen"), F.col(state)).otherwise(to)).drop("_seen")


def history(old: DataFrame, new: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, campo, valor_anterior, valor_nuevo) of each changed value."""
    a = old.select(key, *(F.col(c).cast("string").alias(f"_o_{c}") for c in columns))
    b = new.select(key, *(F.col(c).cast("string").alias(f"_n_{c}") for c in columns))
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("campo"), F.col(f"_o_{c}").alias("valor_anterior"), F.col(f"_n_{c}").alias("valor_nuevo")) for c in columns)))
    return a.join(b, key).select(key, each.alias("x")).select(key, "x.*").where("not (valor_anterior <=> valor_nuevo)")


def membership(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(part, n): how many keys are in both, in the first only and in the second only."""
    left = a.select(key).distinct().withColumn("_a", F.lit(True))
    right = b.select(key).distinct().withColumn("_b", F.lit(True))
    part = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "first_only").otherwise("second_only")
    return left.join(right, key, "full_outer").groupBy(part.alias("part")).agg(F.count("*").alias("n"))


def split_new(old: DataFrame, new: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows of ``new`` to add, rows ignored because their key is there); copies inside the batch are the caller's to drop."""
    known = old.select(*keys).distinct()
    return new.join(known, keys, "left_anti"), new.join(known, keys, "left_semi")


def patched(old: DataFrame, changes: DataFrame, key: str, fixed: tuple[str, ...] = ("latitud", "longitud", "url")) -> DataFrame:
    """``old`` with the changes' set values in all columns they share but the fixed ones; null changes nothing."""
    shared = [c for c in changes.columns if c in old.columns and c != key and c not in fixed]
    rows = old.join(changes.select(key, *(F.col(c).alias(f"_{c}") for c in shared)), key, "left")
    return rows.select(*(F.coalesce(f"_{c}", c).alias(c) if c in shared else F.col(c) for c in old.columns))


def insert_or_fill(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` where rows of a new key are added and those of a known one take the new values that are set."""
    both = old.alias("o").join(new.alias("n"), F.col(f"o.{key}") == F.col(f"n.{key}"), "full_outer")
    return both.select(*(F.coalesce(F.col(f"n.{c}"), F.col(f"o.{c}")).alias(c) for c in old.columns))


def by_keys(df: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of the keys, each once however often a key is asked for."""
    return df.join(keys.distinct(), keys.columns, "left_semi")
