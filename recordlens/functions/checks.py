"""Predicates on identifiers and values."""

from __future__ import annotations

import re
from collections.abc import Mapping
from typing import Any
from urllib.parse import urlparse

from pyspark.sql import Column
from pyspark.sql import functions as F

OBJECT_NAME = r"^[a-zA-Z][a-zA-Z0-9_]*$"


def is_object_name(c: Column) -> Column:
    return F.coalesce(c.rlike(OBJECT_NAME), F.lit(False))


def is_record_id(c: Column) -> Column:
    return F.coalesce(F.length(c).isin(15, 18) & c.rlike("^[a-zA-Z0-9]+$"), F.lit(False))


def is_record_data(data: Column) -> Column:
    """Of a map: not null and not empty."""
    return F.coalesce(F.size(F.map_keys(data)) > 0, F.lit(False))


def has_reference(data: Column) -> Column:
    """Whether a value of a map of strings begins with @."""
    return F.coalesce(F.exists(F.map_values(data), lambda v: F.coalesce(v.startswith("@"), F.lit(False))), F.lit(False))


def number_text(c: Column) -> Column:
    """A double as the shortest plain text: no ``.0``, no exponent between 1e-7 and 1e21."""
    text = c.cast("double").cast("string")
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%s", c.cast("double").cast("decimal(38,12)").cast("string")), r"(\.[0-9]*?)0+$", "$1"), r"\.$", "")
    size = F.abs(c.cast("double"))
    big = F.regexp_replace(F.regexp_replace(text, r"\.0E", "E"), r"E(?=[0-9])", "e+")
    return F.when(text.rlike("E"), F.when((size >= 1e-7) & (size < 1e21), plain).otherwise(F.lower(big))).otherwise(F.regexp_replace(text, r"\.0$", ""))


def require_query(query: Any) -> str:
    if not isinstance(query, str):
        raise ValueError("Query must be a non-empty string")
    if not query.strip():
        raise ValueError("Query cannot be empty")
    return query


def require_object_name(name: Any) -> str:
    if not isinstance(name, str) or not re.fullmatch(OBJECT_NAME[1:-1], name):
        raise ValueError(f"Invalid object name: {name!r}")
    return name


def require_record_id(value: Any) -> str:
    if not isinstance(value, str) or len(value) not in (15, 18) or not re.fullmatch("[a-zA-Z0-9]+", value):
        raise ValueError(f"Invalid record id: {value!r}")
    return value


def require_data(data: Any) -> Mapping[str, Any]:
    if not isinstance(data, Mapping) or not data:
        raise ValueError("Record data must have at least one field")
    return data


def require_config(config: Mapping[str, Any]) -> dict[str, Any]:
    """A connection's settings: https address, id and secret of ten characters or more, version like 65.0, timeout in ms."""
    url = urlparse(str(config.get("login_url", "")))
    if url.scheme != "https" or not url.netloc:
        raise ValueError("login_url must be an https address")
    for key in ("client_id", "client_secret"):
        if len(str(config.get(key, ""))) < 10:
            raise ValueError(f"{key} must have at least 10 characters")
    version = str(config.get("api_version", "65.0"))
    if not re.fullmatch(r"\d+\.\d+", version):
        raise ValueError("api_version must be like 65.0")
    return {**config, "api_version": version, "timeout": int(config.get("timeout", 30000))}
