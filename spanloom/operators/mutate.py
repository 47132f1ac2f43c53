"""Changes of tables as new snapshots: diff, upsert, delete, insert-or-ignore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def hash_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, status) of two (path, hash) snapshots: added, changed, deleted or unchanged."""
    a, b = old.select("path", F.col("hash").alias("old")), new.select("path", F.col("hash").alias("new"))
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "deleted").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return a.join(b, "path", "full_outer").select("path", status.alias("status"))


def scoped_diff(old: DataFrame, new: DataFrame, prefix: str = "") -> DataFrame:
    """``hash_diff`` of what lies below ``prefix``; paths elsewhere were not looked at, so they are not gone."""
    return hash_diff(old.where(F.startswith("path", F.lit(prefix))), new)


def upsert(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``table`` with ``rows`` in place of those of equal key."""
    return table.join(rows.select(key), key, "left_anti").unionByName(rows)


def first_of(rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """For each key its first row in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def insert_or_ignore(table: DataFrame, rows: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``table`` and the rows whose key it lacks; of rows with one key the first."""
    return table.unionByName(first_of(rows, keys, order).join(table.select(*keys), keys, "left_anti").select(table.columns))


def replace_payload(payload: DataFrame, rewritten: DataFrame, rows: DataFrame) -> DataFrame:
    """A per-file table with the rows of ``rewritten`` paths exchanged for ``rows``."""
    return payload.join(rewritten.select("path"), "path", "left_anti").unionByName(rows)


def with_missing_columns(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Additive migration: the columns a table of an older layout lacks, by their defaults (SQL)."""
    return table.withColumns({n: F.expr(x) for n, x in columns.items() if n not in table.columns})
