"""Keeping the metadata catalog current: what is missing or too old is synchronized when it is asked for."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import catalog as C
from ..operators import freshness


class MetadataCache:
    """A catalog over tables given by name (DataFrames, or functions that make them).

    ``now`` makes the time that ages are counted to. Every call that synchronizes
    replaces ``catalog`` and returns the names it took.
    """

    def __init__(self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], references: Mapping[tuple[str, str], Sequence[str]] | None = None, ttl_ms: int = freshness.DAY_MS, now: Callable[[], str | None] = lambda: None):
        self.spark, self.tables, self.references, self.now = spark, dict(tables), references, now
        self.catalog = C.empty(spark)
        self.set_ttl(ttl_ms)

    def set_ttl(self, ttl_ms: int) -> None:
        if ttl_ms < 0:
            raise ValueError("a time to live is not negative")
        self.ttl_ms = ttl_ms

    def _as_of(self):
        at = self.now()
        return F.lit(at).cast("timestamp") if at else F.current_timestamp()

    def _sync(self, names: Sequence[str]) -> list[str]:
        lost = [n for n in names if n not in self.tables]
        if lost:
            raise ValueError(f"unknown objects: {', '.join(lost)}")
        if names:
            self.catalog, _ = C.sync_each(self.spark, self.catalog, {n: self.tables[n] for n in names}, self.references, self.now())
            # What later calls read is the rows of schemas, not the plan of all calls before.
            self.catalog = C.Catalog({k: self.spark.createDataFrame(t.collect(), t.schema) for k, t in self.catalog.tables.items()})
        return list(names)

    def _wanting(self, names: Sequence[str]) -> list[str]:
        asked = self.spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
        gone = {r["name"] for r in freshness.stale(asked, self.catalog["sobjects"], self._as_of(), self.ttl_ms).collect()}
        return [n for n in dict.fromkeys(names) if n in gone]

    def initialize(self) -> list[str]:
        """The core objects that there are tables of."""
        return self.ensure([n for n in freshness.CORE if n in self.tables])

    def ensure(self, names: Sequence[str]) -> list[str]:
        """Synchronize those of the names that are missing or too old."""
        return self._sync(self._wanting(names)) if names else []

    def ensure_related(self, names: Sequence[str], depth: int = 1) -> list[str]:
        """The names, then what they refer to, step by step. References to objects without a table are left out."""
        taken, front, seen = self.ensure(names), list(names), set(names)
        for _ in range(depth):
            wanted = {t for (n, _), to in (self.references or {}).items() if n in front for t in to}
            front = sorted(t for t in wanted - seen if t in self.tables)
            seen |= set(front)
            taken += self.ensure(front)
        if seen - set(names):  # references to what came later
            fields, objects = self.catalog["fields"], self.catalog["sobjects"]
            self.catalog = C.put(self.catalog, "relationships", C.relationships_from(fields, objects))
        return taken

    def refresh(self, names: Sequence[str] | None = None) -> list[str]:
        """Synchronize whatever the age: the names, or all that the catalog has."""
        if names is None:
            names = [r["name"] for r in self.catalog["sobjects"].select("name").orderBy("name").collect()]
        return self._sync([n for n in names])

    def is_cached(self, name: str) -> bool:
        return not self._wanting([name])

    def age_ms(self, name: str) -> int | None:
        """How long ago an object was synchronized; None if never."""
        asked = self.spark.createDataFrame([(name,)], "name string")
        return freshness.ages(asked, self.catalog["sobjects"], self._as_of(), self.ttl_ms).first()["age_ms"]

    def clear(self) -> None:
        self.catalog = C.clear(self.catalog)

    def stats(self) -> DataFrame:
        return freshness.cache_totals(self.catalog["sobjects"], self.catalog["fields"], self.catalog["relationships"], self._as_of(), self.ttl_ms)
