"""Queries: SQL, records by key, and FIND statements over all text fields of several objects."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import require_object_name, require_query

_FIND = re.compile(r"^\s*FIND\s+\{(?P<term>(?:\\.|[^}\\])*)\}(?:\s+IN\s+(?P<scope>ALL|NAME)\s+FIELDS)?(?:\s+RETURNING\s+(?P<objects>.+?))?(?:\s+LIMIT\s+(?P<limit>\d+))?\s*$", re.I | re.S)
_OBJECT = re.compile(r"\s*([A-Za-z]\w*)\s*(?:\(([^)]*)\))?\s*(?:,|$)")


@dataclass(frozen=True)
class Find:
    """A parsed FIND statement. ``mode`` is exact, prefix, wildcard or fuzzy; ``scope`` is all or name."""

    term: str
    mode: str
    objects: tuple[tuple[str, tuple[str, ...]], ...]
    limit: int | None
    scope: str = "all"


def parse_find(statement: str) -> Find:
    """``FIND {term} IN ALL FIELDS RETURNING A(x, y), B LIMIT n``; ``t*`` is a prefix, ``*t*`` any place, ``t~`` similar."""
    m = _FIND.match(require_query(statement))
    if not m:
        raise ValueError("not a FIND statement")
    raw = m["term"].strip()
    starts, ends, like = bool(re.match(r"\*", raw)), bool(re.search(r"(?<!\\)\*$", raw)), bool(re.search(r"(?<!\\)~$", raw))
    mode = "fuzzy" if like else "wildcard" if starts else "prefix" if ends else "exact"
    core = re.sub(r"^\*", "", re.sub(r"(?<!\\)[*~]$", "", raw))
    objects = tuple((name, tuple(c.strip() for c in (cols or "").split(",") if c.strip())) for name, cols in _OBJECT.findall(m["objects"] or "") if name)
    return Find(re.sub(r"\\(.)", r"\1", core), mode, objects, int(m["limit"]) if m["limit"] else None, (m["scope"] or "all").lower())


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def searched_columns(df: DataFrame, scope: str) -> list[str]:
    """The text columns that a scope covers: all, or those that are a name by their own name."""
    return [c for c in text_columns(df) if scope == "all" or c.lower().endswith("name")]


def search_object(df: DataFrame, find: Find, columns: Sequence[str] = ()) -> DataFrame:
    """Rows of which a text field in scope meets the term, ignoring case; the limit takes the first by all columns asked for."""
    term = find.term.lower()
    fields = [F.lower(F.col(c)) for c in searched_columns(df, find.scope)]
    if not fields or not term:
        return df.limit(0)
    if find.mode == "prefix":
        hits = [c.startswith(term) for c in fields]
    elif find.mode == "fuzzy":
        from ..functions.similarity import composite_score

        hits = [composite_score(c, F.lit(term)) > 0.6 for c in fields]
    else:
        hits = [c.contains(term) if find.mode == "wildcard" else c == term for c in fields]
    out = df.where(F.coalesce(F.array_contains(F.array(*hits), True), F.lit(False)))
    out = out.select(*columns) if columns else out
    return out.orderBy(*out.columns).limit(find.limit) if find.limit else out


def search(spark: SparkSession, statement: str) -> dict[str, DataFrame]:
    """A DataFrame for every object (a table or view) that the statement returns."""
    find = parse_find(statement)
    return {name: search_object(spark.table(name), find, columns) for name, columns in find.objects}


def query(spark: SparkSession, statement: str) -> DataFrame:
    try:
        return spark.sql(require_query(statement))
    except (ValueError, PySparkException) as error:
        raise ValueError(f"Query execution failed: {error}") from error


def get_record(spark: SparkSession, name: str, key: str, value: object, columns: Sequence[str] = ()) -> DataFrame:
    out = spark.table(require_object_name(name)).where(F.col(key) == F.lit(value)).limit(1)
    return out.select(*columns) if columns else out


def describe_object(spark: SparkSession, name: str) -> DataFrame:
    fields = spark.table(require_object_name(name)).schema.fields
    return spark.createDataFrame([(k, f.name, f.dataType.simpleString(), f.nullable) for k, f in enumerate(fields)], "position int, name string, type string, nillable boolean")


def describe_global(spark: SparkSession) -> DataFrame:
    rows = [(t.name, bool(t.isTemporary)) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string, temporary boolean")


#: Fields returned with a match, besides Id and Name.
RETURN_FIELDS = {
    "Account": ("Industry", "BillingCity", "Phone", "Website"),
    "Contact": ("Email", "Phone", "AccountId", "Title"),
    "Lead": ("Email", "Phone", "Company", "Status"),
}


def return_fields(name: str, match_field: str = "Name") -> list[str]:
    return list(dict.fromkeys(["Id", "Name", match_field, *RETURN_FIELDS.get(name, ())]))
