"""First or last rows by key, which lookups in order come down to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, key: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key. Spark keeps the best n of each partition before it shuffles, so a hot key stays small."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return rows.withColumn("rank in key", rank).where(F.col("rank in key") <= n).drop("rank in key")


def not_stored(rows: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not stored yet; null keys count as equal."""
    same = [rows[c].eqNullSafe(stored[c]) for c in key]
    return rows.join(stored, on=same, how="left_anti")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """rows but for those of the keys in gone (a column of that name)."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")
