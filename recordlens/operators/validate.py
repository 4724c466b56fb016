"""Validation of rows against the catalog, in long form: a row for every value given.

Values are (row_id, object, field, value, js_type): the value as text (numbers
in their shortest form) and its kind, one of string, number, boolean,
object; a null value has none. Findings are (row_id, field, severity, type,
message, suggestion). The catalog's tables are small beside the values; joins
are on (object, field).
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.checks import number_text
from .catalog import Catalog, get_relationships

# The kind of value that each declared type takes; others take any.
EXPECTED = {
    "string": "string",
    "textarea": "string",
    "email": "string",
    "url": "string",
    "phone": "string",
    "picklist": "string",
    "multipicklist": "string",
    "id": "string",
    "reference": "string",
    "int": "number",
    "double": "number",
    "currency": "number",
    "percent": "number",
    "boolean": "boolean",
    "date": "string",
    "datetime": "string",
    "time": "string",
}

# Fields that the system fills in.
SYSTEM_FIELDS = ("Id", "IsDeleted", "CreatedDate", "CreatedById", "LastModifiedDate", "LastModifiedById", "SystemModstamp", "LastViewedDate", "LastReferencedDate")
FALSE_BY_DEFAULT = ("IsExcludedFromRealign", "IsPartner", "IsCustomerPortal", "HasOptedOutOfEmail", "HasOptedOutOfFax", "DoNotCall", "IsEmailBounced", "IsPriorityRecord")
FILLED_BY_DEFAULT = ("OwnerId",)
SYSTEM_RELATIONSHIPS = ("OwnerId", "CreatedById", "LastModifiedById", "RecordTypeId")

FINDINGS = ("row_id", "field", "severity", "type", "message", "suggestion")


def _number(column: str, kind: T.DataType) -> Column:
    """A number as text; whole numbers in full, beyond what a double holds too."""
    return F.col(column).cast("string") if isinstance(kind, T.IntegralType) else number_text(F.col(column))


def long_form(rows: DataFrame, key: str, sobject: str, fields: Mapping[str, str] | None = None) -> DataFrame:
    """Values of a wide table; ``fields`` maps its columns to field names (all but the key, if not given)."""
    types = {f.name: f.dataType for f in rows.schema.fields}
    names = fields or {c: c for c in rows.columns if c != key}
    each = []
    for column, name in names.items():
        kind = types[column]
        if isinstance(kind, (T.NumericType,)):
            text, js = _number(column, kind), "number"
        elif isinstance(kind, T.BooleanType):
            text, js = F.col(column).cast("string"), "boolean"
        elif isinstance(kind, (T.StringType, T.DateType, T.TimestampType)):
            text, js = F.col(column).cast("string"), "string"
        else:
            text, js = F.to_json(F.struct(column)), "object"
        each.append(F.struct(F.lit(name).alias("field"), text.alias("value"), F.when(F.col(column).isNotNull(), js).alias("js_type")))
    return rows.select(F.col(key).alias("row_id"), F.lit(sobject).alias("object"), F.explode(F.array(*each)).alias("v")).select("row_id", "object", "v.*")


def from_record(spark: SparkSession, sobject: str, data: Mapping[str, object], row_id: int = 0) -> tuple[DataFrame, DataFrame]:
    """One record that the driver holds, as a row and its values."""
    kind = lambda v: "boolean" if isinstance(v, bool) else "number" if isinstance(v, (int, float, Decimal)) else "string" if isinstance(v, str) else "object"
    text = lambda v: str(v).lower() if isinstance(v, bool) else re.sub(r"\.0$", "", str(v))
    rows = [(row_id, sobject, k, None if v is None else v if isinstance(v, str) else text(v), None if v is None else kind(v)) for k, v in data.items()]
    return spark.createDataFrame([(row_id, sobject)], "row_id long, object string"), spark.createDataFrame(rows, "row_id long, object string, field string, value string, js_type string")


def from_maps(rows: DataFrame, key: str, sobject: str, data: str) -> DataFrame:
    """Values of a map of strings."""
    return rows.select(F.col(key).alias("row_id"), F.col(sobject).alias("object"), F.explode(data).alias("field", "value")).withColumn("js_type", F.when(F.col("value").isNotNull(), "string"))


def _finding(where: Column, field: Column, severity: str, kind: str, message: Column, suggestion: Column | None = None) -> Column:
    """A finding where a condition holds, else null."""
    suggestion = F.lit(None).cast("string") if suggestion is None else suggestion
    return F.when(where, F.struct(field.alias("field"), F.lit(severity).alias("severity"), F.lit(kind).alias("type"), message.alias("message"), suggestion.alias("suggestion")))


def _found(rows: DataFrame, *findings: Column) -> DataFrame:
    """All findings of all rows, from one pass over them."""
    return rows.select("row_id", F.explode(F.array_compact(F.array(*findings))).alias("f")).select("row_id", "f.*")


def _said(template: str, *columns: str) -> Column:
    return F.format_string(template, *[F.col(c) for c in columns])


def objects_allowed(rows: DataFrame, catalog: Catalog, mode: str) -> tuple[DataFrame, DataFrame]:
    """Rows (row_id, object) of known objects that the mode may write to, and findings on all others."""
    able = "is_createable" if mode == "create" else "is_updateable"
    objects = catalog["sobjects"].select(F.col("name").alias("object"), F.coalesce(able, F.lit(False)).alias("able"))
    known = rows.join(objects, "object", "left")
    field, able = F.lit("__sobject__"), F.col("able")
    word = "createable" if mode == "create" else "updateable"
    missing = _finding(able.isNull(), field, "error", "METADATA_NOT_FOUND", _said("Object '%s' not found in metadata. Run metadata sync first.", "object"))
    barred = _finding(~able, field, "error", "CRUD_PERMISSION", _said(f"Object '%s' is not {word}. Check CRUD permissions.", "object"))
    return known.where("able").select("row_id", "object"), _found(known, missing, barred)


def required_fields(catalog: Catalog) -> DataFrame:
    """Required fields that a user must give: not the system's, and without a default."""
    excluded = (*SYSTEM_FIELDS, *FALSE_BY_DEFAULT, *FILLED_BY_DEFAULT)
    return catalog["fields"].where(F.col("is_required") & ~F.col("name").isin(*excluded) & (F.coalesce("default_value", F.lit("")) == ""))


def check_required(rows: DataFrame, values: DataFrame, catalog: Catalog) -> DataFrame:
    need = rows.join(required_fields(catalog).select(F.col("sobject").alias("object"), F.col("name").alias("field"), "label", F.col("type").alias("declared")), "object")
    given = values.where("value IS NOT NULL AND value <> ''").select("row_id", "object", "field")
    lacking = need.join(given, ["row_id", "object", "field"], "left_anti")
    return _found(lacking, _finding(F.lit(True), F.col("field"), "error", "REQUIRED_FIELD", _said("Required field '%s' is missing or empty.", "label"), _said("Provide a value for %s (%s)", "field", "declared")))


def check_fields(values: DataFrame, catalog: Catalog) -> DataFrame:
    """Unknown fields, wrong kinds of values, lengths, pick-lists, precision and scale."""
    fields = catalog["fields"].select(F.col("sobject").alias("object"), F.col("name").alias("field"), "label", F.lower("type").alias("declared"), "length", "precision_val", "scale", "picklist_values", F.lit(True).alias("known"))
    v = values.join(fields, ["object", "field"], "left")
    expected = F.create_map(*[F.lit(x) for pair in EXPECTED.items() for x in pair])
    v = v.withColumns({"expects": expected[F.col("declared")], "valid": F.transform("picklist_values", lambda p: p["value"])})
    v = v.withColumns({"digits": F.when(F.col("js_type") == "number", F.length(F.regexp_replace("value", r"\.", ""))), "decimals": F.when(F.col("js_type") == "number", F.length(F.coalesce(F.get(F.split("value", r"\."), F.lit(1)), F.lit(""))))})
    given, f, js, declared = F.col("value").isNotNull(), F.col("field"), F.col("js_type"), F.col("declared")
    size, numeric = F.length("value"), declared.isin("double", "currency", "percent")
    v = v.withColumn("n", size)
    return _found(
        v,
        _finding(F.col("known").isNull(), f, "warning", "UNKNOWN_FIELD", _said("Field '%s' not found in metadata. It may not exist or you may lack access.", "field")),
        _finding(given & (F.col("expects") != js), f, "error", "TYPE_MISMATCH", _said("Field '%s' expects type %s but got %s.", "label", "expects", "js_type"), _said("Convert value to %s", "expects")),
        _finding(given & (declared == "string") & (js == "string") & (size > F.col("length")), f, "error", "LENGTH_EXCEEDED", _said("Field '%s' exceeds maximum length of %d characters (provided: %d).", "label", "length", "n")),
        _finding(
            given & (declared == "picklist") & ~(F.array_contains("valid", F.col("value")) & (js == "string")),
            f,
            "error",
            "INVALID_PICKLIST_VALUE",
            _said("Invalid picklist value '%s' for field '%s'.", "value", "label"),
            F.concat(F.lit("Valid values: "), F.array_join(F.slice("valid", 1, 10), ", "), F.when(F.size("valid") > 10, "...").otherwise("")),
        ),
        _finding(given & numeric & (F.col("digits") > F.col("precision_val")), f, "warning", "PRECISION_WARNING", _said("Field '%s' may exceed precision of %d digits.", "label", "precision_val")),
        _finding(given & numeric & (F.col("decimals") > F.col("scale")), f, "warning", "SCALE_WARNING", _said("Field '%s' has %d decimal places but max is %d.", "label", "decimals", "scale"), _said("Round to %d decimal places", "scale")),
    )


def check_rules(rows: DataFrame, catalog: Catalog) -> DataFrame:
    """A warning where active rules exist; their formulas are not evaluated."""
    active = catalog["validation_rules"].where("active").groupBy(F.col("sobject").alias("object")).agg(F.count("*").alias("n"))
    return _found(rows.join(active, "object"), _finding(F.lit(True), F.lit("__validation_rules__"), "warning", "VALIDATION_RULES_EXIST", _said("This object has %d active validation rule(s) that may prevent save.", "n")))


def _truthy(values: DataFrame) -> DataFrame:
    blank = (F.col("value") == "") | ((F.col("js_type") == "number") & (F.col("value") == "0")) | ((F.col("js_type") == "boolean") & (F.col("value") == "false"))
    return values.where(F.col("value").isNotNull() & ~blank)


def check_relationships(rows: DataFrame, values: DataFrame, catalog: Catalog) -> DataFrame:
    """Required references that are missing (in updates too), and a suggestion for every reference that is given."""
    rels = get_relationships(catalog).where(~F.col("field_name").isin(*SYSTEM_RELATIONSHIPS)).select(F.col("from_sobject").alias("object"), F.col("field_name").alias("field"), "to_sobject", "is_required")
    each = rows.join(rels, "object").join(_truthy(values).select("row_id", "object", "field", "value"), ["row_id", "object", "field"], "left")
    given = F.col("value").isNotNull()
    return _found(
        each,
        _finding(F.col("is_required") & ~given, F.col("field"), "error", "REQUIRED_RELATIONSHIP", _said("Required relationship field '%s' to %s is missing.", "field", "to_sobject"), _said("Create or reference a %s record first", "to_sobject")),
        _finding(given, F.col("field"), "suggestion", "REFERENCE_CHECK", _said("Ensure %s record with ID '%s' exists.", "to_sobject", "value")),
    )


def check_references(values: DataFrame, catalog: Catalog, targets: Mapping[str, tuple[DataFrame, str]]) -> DataFrame:
    """References whose record doesn't exist, for target objects given with their key: the check that REFERENCE_CHECK only suggests.

    Zero and false are looked up as any other value: only nulls and empty texts refer to nothing. Keys are read as ``long_form`` writes values.
    """
    given = values.where("value <> ''").select("row_id", "object", "field", "value")
    rels = get_relationships(catalog).select(F.col("from_sobject").alias("object"), F.col("field_name").alias("field"), "to_sobject")
    out = None
    for name, (df, key) in targets.items():
        here = given.join(rels.where(F.col("to_sobject") == name), ["object", "field"])
        kind = df.schema[key].dataType
        keys = df.select((_number(key, kind) if isinstance(kind, T.NumericType) else F.col(key).cast("string")).alias("value")).distinct()
        lost = here.join(keys, "value", "left_anti")
        one = _found(lost, _finding(F.lit(True), F.col("field"), "error", "REFERENCE_NOT_FOUND", _said("No %s record with ID '%s'.", "to_sobject", "value")))
        out = one if out is None else out.unionByName(one)
    return out


def validate(rows: DataFrame, values: DataFrame, catalog: Catalog, mode: str = "create") -> DataFrame:
    """All findings on ``rows`` (row_id, object) with their values. Objects that are unknown or barred are looked at no further."""
    if mode not in ("create", "update"):
        raise ValueError("mode must be create or update")
    allowed, out = objects_allowed(rows, catalog, mode)
    own = values.join(allowed, ["row_id", "object"], "left_semi")
    if mode == "create":
        out = out.unionByName(check_required(allowed, own, catalog))
    return out.unionByName(check_fields(own, catalog)).unionByName(check_rules(allowed, catalog)).unionByName(check_relationships(allowed, own, catalog))


def verdicts(rows: DataFrame, findings: DataFrame) -> DataFrame:
    """row_id, valid and the numbers of errors, warnings and suggestions."""
    counts = findings.groupBy("row_id").agg(*[F.count_if(F.col("severity") == s).alias(f"n_{s}s") for s in ("error", "warning", "suggestion")])
    out = rows.select("row_id").join(counts, "row_id", "left").na.fill(0)
    return out.withColumn("valid", F.col("n_errors") == 0)


def summary(findings: list) -> str:
    """Collected findings of one row as text."""
    groups = {s: [f for f in findings if f["severity"] == s] for s in ("error", "warning", "suggestion")}
    out = ["Validation FAILED" if groups["error"] else "Validation PASSED"]
    for severity, some in groups.items():
        if some:
            out.append(f"{severity.capitalize()}s ({len(some)}):")
            out += [f"  - {f['field']}: {f['message']}" + (f" ({f['suggestion']})" if severity == "error" and f["suggestion"] else "") for f in some]
    return "\n".join(out)
