"""The tools by name, as functions of a session and arguments."""

from __future__ import annotations

from collections.abc import Mapping
from functools import partial
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.checks import require_data, require_object_name
from ..operators import catalog as C
from ..sources import search, sinks
from .orchestrate import pre_flight


class ToolError(Exception):
    """Has name, message, code and status_code, like the tools' error answers."""

    def __init__(self, message: str, code: str = "INTERNAL_ERROR", status_code: int = 500):
        super().__init__(message)
        self.code, self.status_code = code, status_code

    def answer(self) -> dict[str, Any]:
        return {"name": type(self).__name__, "message": str(self), "code": self.code, "status_code": self.status_code}


class Tools:
    """Tools over a session's tables. ``keys`` names each table's key column (Id, if not given)."""

    def __init__(self, spark: SparkSession, keys: Mapping[str, str] | None = None):
        self.spark, self.keys, self.catalog = spark, dict(keys or {}), C.empty(spark)

    def _key(self, name: str) -> str:
        return self.keys.get(require_object_name(name), "Id")

    def _pre_flight(self, kind: str, object: str, data: Mapping[str, Any]) -> None:
        if C.get_object(self.catalog, require_object_name(object)).limit(1).count():
            errors, _ = pre_flight(self.spark, {"type": kind, "sobject": object, "data": require_data(data)}, self.catalog)
            if errors:
                raise ValueError("; ".join(errors))

    def query(self, query: str) -> DataFrame:
        return search.query(self.spark, query)

    def get_record(self, object: str, id: Any, fields: tuple[str, ...] = ()) -> DataFrame:
        return search.get_record(self.spark, object, self._key(object), id, fields)

    def create_record(self, object: str, data: Mapping[str, Any]) -> DataFrame:
        """The table with one more record; what ``data`` lacks is null. Objects that the catalog knows are validated first."""
        self._pre_flight("create", object, data)
        table = self.spark.table(require_object_name(object))
        row = self.spark.range(1).select(*[F.lit(require_data(data).get(f.name)).cast(f.dataType).alias(f.name) for f in table.schema.fields])
        return table.unionByName(row)

    def update_record(self, object: str, id: Any, data: Mapping[str, Any]) -> DataFrame:
        """The table with a record's new values. Objects that the catalog knows are validated first."""
        self._pre_flight("update", object, data)
        table, key = self.spark.table(require_object_name(object)), self._key(object)
        data = {**require_data(data)}
        kinds = {f.name: f.dataType for f in table.schema.fields}
        row = self.spark.range(1).select(*[F.lit(v).cast(kinds[k]).alias(k) for k, v in {key: id, **data}.items()])
        return sinks.updated(table, row, key)

    def delete_record(self, object: str, id: Any) -> DataFrame:
        table, key = self.spark.table(require_object_name(object)), self._key(object)
        return sinks.deleted(table, self.spark.range(1).select(F.lit(id).alias(key)), key)

    def describe_object(self, object: str) -> DataFrame:
        return search.describe_object(self.spark, object)

    def describe_global(self) -> DataFrame:
        return search.describe_global(self.spark)

    def search(self, search_string: str) -> dict[str, DataFrame]:
        return search.search(self.spark, search_string)

    def limits(self) -> DataFrame:
        """The session's settings that bound a job."""
        names = ("spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.files.maxPartitionBytes")
        return self.spark.createDataFrame([(n, self.spark.conf.get(n)) for n in names], "name string, value string")

    def test_connection(self) -> DataFrame:
        return self.spark.range(1).select(F.lit(True).alias("success"), F.lit(self.spark.version).alias("version"))

    def sync_metadata(self, objects: list[str] | None = None) -> DataFrame:
        names = objects or [t.name for t in self.spark.catalog.listTables()]
        """Describe the tables, and the organization. Returns what became of each table."""
        self.catalog, report = C.sync_each(self.spark, C.sync_org(self.spark, self.catalog), {n: partial(self.spark.table, n) for n in names})
        return report

    def sync_stats(self) -> DataFrame:
        return C.full_stats(self.catalog)

    def call(self, name: str, arguments: Mapping[str, Any] | None) -> Any:
        if arguments is None:
            raise ToolError("Missing arguments", "INVALID_INPUT", 400)
        if name not in NAMES:
            raise ToolError(f"Unknown tool: {name}", "UNKNOWN_TOOL", 404)
        try:
            return getattr(self, name)(**arguments)
        except ValueError as error:
            raise ToolError(str(error), "VALIDATION_ERROR", 400) from error


NAMES = ("query", "get_record", "create_record", "update_record", "delete_record", "describe_object", "describe_global", "search", "limits", "test_connection", "sync_metadata", "sync_stats")
