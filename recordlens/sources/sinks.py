"""Creates, updates and deletes as DataFrames to be written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split(rows: DataFrame, issues: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, to be appended, and those with one, for quarantine. ``issues`` has row_id and severity."""
    bad = issues.where("severity = 'error'").select(F.col("row_id").alias(key)).distinct()
    return rows.join(bad, key, "left_anti"), rows.join(bad, key, "left_semi")


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """The table with non-null values of ``changes`` (some of its columns, a key once) in place of its own."""
    new = [c for c in changes.columns if c != key]
    renamed = changes.select(key, *[F.col(c).alias(f"__new_{c}") for c in new])
    joined = table.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in new else F.col(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")
