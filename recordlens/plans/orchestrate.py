"""Running record operations: one with its checks, or many in the order of their dependencies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from threading import Lock
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import depgraph, matching, validate
from ..operators.catalog import Catalog, get_relationships
from .cache import MetadataCache

#: Operations of a level that run at once.
AT_ONCE = 16
OPERATION = ("type", "sobject", "temp_id", "record_id", "data")


def has_dependencies(operations: Sequence[Mapping[str, Any]]) -> bool:
    return any(isinstance(v, str) and v.startswith("@") for op in operations for v in op.get("data", {}).values())


def route(given: Any) -> tuple[str, list[Mapping[str, Any]]]:
    """single or multi, and the operations: a lone operation, alone or in a list and without references, is single."""
    if isinstance(given, Mapping) and "sobject" in given and "type" in given:
        return "single", [given]
    if isinstance(given, (list, tuple)) and given:
        operations = list(given)
        return ("multi" if len(operations) > 1 or has_dependencies(operations) else "single"), operations
    raise ValueError("Invalid operation input format")


def operations_frame(spark: SparkSession, operations: Sequence[Mapping[str, Any]]) -> DataFrame:
    rows = [(k, op["type"], op["sobject"], op.get("temp_id"), op.get("record_id"), {n: None if v is None else str(v) for n, v in op.get("data", {}).items()}) for k, op in enumerate(operations)]
    return spark.createDataFrame(rows, depgraph.SCHEMA)


def check_duplicates(probes: DataFrame, records: DataFrame, field: str = "Name", limit: int = 10, min_confidence: str = "MEDIUM", **columns: str) -> DataFrame:
    """Likely duplicates of new records; those without a value have none."""
    return matching.find_duplicates(probes, records, matching.Search(field, limit, min_confidence=min_confidence), **columns)


def duplicate_warnings(matches: DataFrame) -> DataFrame:
    """query_id with the numbers of matches of high and medium confidence."""
    return matches.groupBy("query_id").agg(F.count_if(F.col("confidence") == "HIGH").alias("n_high"), F.count_if(F.col("confidence") == "MEDIUM").alias("n_medium"))


def annotate(rows: DataFrame, values: DataFrame, catalog: Catalog, records: DataFrame, terms: DataFrame, mode: str = "create") -> DataFrame:
    """Single operations in bulk: row_id, valid, counts of findings, and counts of likely duplicates (which warn only).

    ``terms`` has query_id (a row_id) and term; ``records`` id and name.
    """
    findings = validate.validate(rows, values, catalog, mode)
    out = validate.verdicts(rows, findings)
    if mode == "create":
        warned = duplicate_warnings(check_duplicates(terms, records)).withColumnRenamed("query_id", "row_id")
        return out.join(warned, "row_id", "left").na.fill(0, ["n_high", "n_medium"])
    return out.withColumns({"n_high": F.lit(0).cast("long"), "n_medium": F.lit(0).cast("long")})


class MemoryStore:
    """A store of records by object for executing plans: ids are made in order. ``fail`` names objects whose writes fail."""

    def __init__(self, fail: Sequence[str] = ()):
        self.records: dict[str, dict[str, dict[str, Any]]] = {}
        self.fail, self.made, self.lock = set(fail), 0, Lock()

    def create(self, sobject: str, data: Mapping[str, Any]) -> str:
        if sobject in self.fail:
            raise RuntimeError(f"cannot create {sobject}")
        with self.lock:
            self.made += 1
            record_id = f"{self.made:015d}"
            self.records.setdefault(sobject, {})[record_id] = dict(data)
        return record_id

    def update(self, sobject: str, record_id: str, data: Mapping[str, Any]) -> str:
        record_id = data.get("Id", record_id)
        self.records.setdefault(sobject, {}).setdefault(record_id, {}).update(data)
        return record_id

    def delete(self, sobject: str, record_id: str) -> str:
        self.records.get(sobject, {}).pop(record_id, None)
        return record_id


def _run(store: Any, op: Mapping[str, Any], ids: Mapping[str, str], leave: Sequence[str] = ()) -> dict[str, Any]:
    data = {}
    for field, value in op.get("data", {}).items():
        if isinstance(value, str) and value.startswith("@"):
            if field in leave:
                continue
            if value not in ids:
                raise ValueError(f"Cannot resolve reference {value} in {field}")
            value = ids[value]
        data[field] = value
    kind = op["type"]
    if kind not in ("create", "update", "delete"):
        raise ValueError(f"Unknown operation type: {kind}")
    if kind != "create" and not op.get("record_id"):
        raise ValueError(f"{kind.capitalize()} operation requires record_id")
    args = [op["sobject"]] + ([op["record_id"]] if kind != "create" else []) + ([data] if kind != "delete" else [])
    return {"temp_id": op.get("temp_id"), "sobject": op["sobject"], "type": kind, "success": True, "id": getattr(store, kind)(*args)}


def pre_flight(spark: SparkSession, op: Mapping[str, Any], catalog: Catalog) -> tuple[list[str], list[str]]:
    """The messages of errors and of warnings about a create or an update."""
    if op["type"] not in ("create", "update"):
        return [], []
    rows, values = validate.from_record(spark, op["sobject"], op.get("data", {}))
    found = validate.validate(rows, values, catalog, op["type"]).select("severity", "message").collect()
    said = lambda s: [r["message"] for r in found if r["severity"] == s]
    return said("error"), said("warning")


def likely_duplicates(spark: SparkSession, op: Mapping[str, Any], records: DataFrame, field: str = "Name") -> list[str]:
    """Warnings about records (id, name) that a new one may repeat."""
    term = op.get("data", {}).get(field)
    if op["type"] != "create" or not term:
        return []
    probes = spark.createDataFrame([(0, str(term))], "query_id long, term string")
    found = check_duplicates(probes, records, field).orderBy("rank").collect()
    high, medium = ([r for r in found if r["confidence"] == c] for c in ("HIGH", "MEDIUM"))
    out = [f"POTENTIAL DUPLICATE: Found {len(high)} high-confidence match(es):"] if high else []
    out += [f"  {k}. {r['name']} ({r['score'] * 100:.1f}% match)" for k, r in enumerate(high, 1)]
    return out + ([f"Possible duplicates: Found {len(medium)} medium-confidence match(es)"] if medium else [])


def _answer(kind: str, operations: Sequence[Mapping[str, Any]], results: list[dict], errors: list[dict], warnings: list[str], plan: list[dict]) -> dict[str, Any]:
    return {
        "type": kind,
        "success": not errors,
        "results": results,
        "errors": errors,
        "warnings": warnings,
        "plan": plan,
        "ids": [{"temp_id": r["temp_id"], "record_id": r["id"], "sobject": r["sobject"]} for r in results if r["success"] and r["id"]],
        "n_success": len(results),
        "n_failed": len(errors),
        "sobjects": sorted({op["sobject"] for op in operations}),
    }


def execute_single(spark: SparkSession, op: Mapping[str, Any], store: Any, catalog: Catalog | None = None, records: DataFrame | None = None) -> dict[str, Any]:
    """One operation: duplicates warn, errors of the pre-flight stop it before anything is written."""
    warnings = likely_duplicates(spark, op, records) if records is not None else []
    lacking, more = pre_flight(spark, op, catalog) if catalog else ([], [])
    errors = [{"message": m, "phase": "validation", "op": 0} for m in lacking]
    results = []
    if not errors:
        try:
            results.append(_run(store, op, {}))
        except Exception as error:
            errors.append({"message": str(error), "phase": "execution", "op": 0})
    return _answer("single", [op], results, errors, warnings + more, [])


def execute(spark: SparkSession, given: Any, store: Any, catalog: Catalog | None = None, cache: MetadataCache | None = None, records: Mapping[str, DataFrame] | None = None) -> dict[str, Any]:
    """Run operations on a store: level by level, then the updates that set what break points left empty.

    With a ``cache``, metadata of the objects is ensured first, that of referred objects too if there
    are several operations, and its catalog serves where none is given. A single operation takes
    ``execute_single``, with the records (id, name) of its object if given. The operations of a level run
    at the same time; in a level of several an error does not stop the others, in a level of one it stops everything.
    The operations of one call are on the driver already; bulk data goes through ``annotate`` and the sinks.
    """
    kind, operations = route(given)
    objects = list(dict.fromkeys(op["sobject"] for op in operations))
    if cache is not None:
        known = [n for n in objects if n in cache.tables]
        cache.ensure(known) if kind == "single" else cache.ensure_related(known)
        catalog = catalog or cache.catalog
    if kind == "single":
        return execute_single(spark, operations[0], store, catalog, (records or {}).get(operations[0]["sobject"]))
    ops = operations_frame(spark, operations)
    relationships = get_relationships(catalog) if catalog else None
    op_levels, broken = depgraph.resolve(ops, relationships)
    by_level: dict[int, list[int]] = {}
    for r in op_levels.orderBy("level", "op").collect():
        by_level.setdefault(r["level"], []).append(r["op"])
    plan = [{"level": k, "operations": [f"op_{n}" for n in own], "can_parallelize": len(own) > 1} for k, own in sorted(by_level.items())]
    left: dict[int, list[tuple[str, str]]] = {}
    for r in broken.collect():
        left.setdefault(r["to_op"], []).append((r["field"], operations[r["to_op"]]["data"][r["field"]]))
    results, errors, ids, made, stopped = [], [], {}, {}, False

    def run(k: int) -> dict[str, Any] | Exception:
        try:
            return _run(store, operations[k], ids, [f for f, _ in left.get(k, ())])
        except Exception as error:
            return error

    for level in sorted(by_level):
        own = by_level[level]
        with ThreadPoolExecutor(min(len(own), AT_ONCE)) as pool:
            outcomes = list(pool.map(run, own))
        for k, done in zip(own, outcomes):
            if isinstance(done, Exception):
                errors.append({"message": str(done), "phase": "execution", "op": k})
                stopped = len(own) == 1
                continue
            results.append(done)
            made[k] = done["id"]
            if done["temp_id"]:
                ids.setdefault(done["temp_id"], done["id"])
        if stopped:
            break
    for k, fields in left.items():
        if k in made and not stopped:
            results.append(_run(store, {**operations[k], "type": "update", "record_id": made[k], "data": dict(fields)}, ids))
    return _answer(kind, operations, results, errors, [], plan)
