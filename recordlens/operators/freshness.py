"""Age of synchronized metadata, and objects related to others within some steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 24 * 60 * 60 * 1000
CORE = ("Account", "Contact", "Lead", "Opportunity", "Case", "Task")


def age_ms(synced_at: Column, as_of: Column) -> Column:
    return F.unix_millis(as_of.cast("timestamp")) - F.unix_millis(synced_at.cast("timestamp"))


def is_stale(synced_at: Column, as_of: Column, ttl_ms: int = DAY_MS) -> Column:
    """Never synchronized, or longer ago than the time to live."""
    return F.coalesce(age_ms(synced_at, as_of) > ttl_ms, F.lit(True))


def ages(names: DataFrame, sobjects: DataFrame, as_of: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    """For requested names: age_ms (null if unknown) and stale."""
    known = sobjects.select("name", "synced_at")
    return names.join(known, "name", "left").select("name", age_ms(F.col("synced_at"), as_of).alias("age_ms"), is_stale(F.col("synced_at"), as_of, ttl_ms).alias("stale"))


def stale(names: DataFrame, sobjects: DataFrame, as_of: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    return ages(names, sobjects, as_of, ttl_ms).where("stale").select("name")


def cache_stats(sobjects: DataFrame, as_of: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    fresh_core = F.col("name").isin(*CORE) & ~is_stale(F.col("synced_at"), as_of, ttl_ms)
    return sobjects.agg(F.count("*").alias("total_objects"), F.count_if(fresh_core).alias("core_objects_cached")).withColumns({"ttl_ms": F.lit(ttl_ms).cast("long"), "ttl_hours": F.lit(ttl_ms / 3600000)})


def cache_totals(sobjects: DataFrame, fields: DataFrame, relationships: DataFrame, as_of: Column, ttl_ms: int = DAY_MS) -> DataFrame:
    """``cache_stats`` with total_fields and total_relationships."""
    n = lambda df, name: F.broadcast(df.agg(F.count("*").alias(name)))  # noqa: E731  one row
    return cache_stats(sobjects, as_of, ttl_ms).crossJoin(n(fields, "total_fields")).crossJoin(n(relationships, "total_relationships"))


def related(starts: DataFrame, relationships: DataFrame, depth: int) -> DataFrame:
    """name and the least number of steps (0 to ``depth``) in which it is reached over outgoing relationships.

    Only names reached for the first time go on, so a cycle does not repeat work.
    """
    edges = relationships.select(F.col("from_sobject").alias("name"), "to_sobject").distinct()
    reached = front = starts.select("name").distinct().withColumn("steps", F.lit(0))
    for step in range(1, depth + 1):
        further = front.join(edges, "name").select(F.col("to_sobject").alias("name")).distinct()
        front = further.join(reached, "name", "left_anti").withColumn("steps", F.lit(step))
        reached = reached.unionByName(front)
    return reached
