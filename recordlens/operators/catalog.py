"""The metadata catalog: eight relational tables, upserts, lookups, counts and synchronization."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

PICKLIST = "array<struct<label:string,value:string>>"

#: Schemas of the tables; keys of upserts beside them.
SCHEMAS = {
    "org_info": "org_id string, instance_url string, org_name string, last_synced_at timestamp",
    "sobjects": "name string, label string, label_plural string, api_name string, key_prefix string, is_custom boolean, is_queryable boolean, is_createable boolean, is_updateable boolean, is_deletable boolean, is_retrieveable boolean, is_searchable boolean, synced_at timestamp",
    "fields": f"sobject string, name string, label string, api_name string, type string, length int, precision_val int, scale int, is_required boolean, is_nillable boolean, is_unique boolean, is_external_id boolean, is_auto_number boolean, is_calculated boolean, default_value string, picklist_values {PICKLIST}, reference_to array<string>, relationship_name string, help_text string",
    "validation_rules": "sobject string, name string, api_name string, active boolean, error_message string, error_display_field string, formula string, description string",
    "relationships": "from_sobject string, to_sobject string, field_name string, relationship_name string, relationship_type string, is_cascade_delete boolean, is_restricted_delete boolean, is_required boolean",
    "record_types": "sobject string, name string, developer_name string, record_type_id string, is_active boolean, is_default boolean, description string",
    "field_dependencies": "sobject string, controlling_field string, dependent_field string, dependency_matrix map<string,array<string>>",
    "triggers": "sobject string, name string, api_name string, active boolean, trigger_events array<string>, description string",
}
KEYS = {
    "org_info": ("org_id",),
    "sobjects": ("name",),
    "fields": ("sobject", "name"),
    "validation_rules": ("sobject", "name"),
    "relationships": ("from_sobject", "field_name"),
    "record_types": ("record_type_id",),
    "field_dependencies": ("sobject", "controlling_field", "dependent_field"),
    "triggers": ("sobject", "name"),
}

#: Objects that come first when standard objects are chosen, in this order.
PRIORITY = ("Account", "Contact", "Lead", "Opportunity", "Case", "Task", "Event")
MOST_OTHERS = 20
MOST_RULES = 200
ENTITY_PREFIX = "01I"


@dataclass
class Catalog:
    """The tables as DataFrames."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]


def empty(spark: SparkSession) -> Catalog:
    return Catalog({name: spark.createDataFrame([], schema) for name, schema in SCHEMAS.items()})


def conform(rows: DataFrame, table: str) -> DataFrame:
    """Rows with exactly a table's columns: missing ones are null, as are a length, precision or scale of zero and an empty default."""
    out = []
    for f in T._parse_datatype_string(SCHEMAS[table]).fields:
        c = F.col(f.name).cast(f.dataType) if f.name in rows.columns else F.lit(None).cast(f.dataType)
        if table == "fields" and f.name in ("length", "precision_val", "scale"):
            c = F.nullif(c, F.lit(0))
        if table == "fields" and f.name == "default_value":
            c = F.nullif(c, F.lit(""))
        out.append(c.alias(f.name))
    rows = rows.select(*out)
    if table == "sobjects":
        rows = rows.withColumn("label_plural", F.coalesce("label_plural", "label"))
    return rows


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace old ones with the same keys. ``new`` should have a key once."""
    return old.join(new.select(*keys).distinct(), list(keys), "left_anti").select(*old.columns).unionByName(new)


def put(catalog: Catalog, table: str, rows: DataFrame) -> Catalog:
    return Catalog({**catalog.tables, table: upsert(catalog[table], conform(rows, table), KEYS[table])})


def clear(catalog: Catalog) -> Catalog:
    """All tables empty but org_info."""
    return Catalog({n: t if n == "org_info" else t.limit(0) for n, t in catalog.tables.items()})


def migrate(sobjects: DataFrame) -> DataFrame:
    """Adds synced_at where an older table lacks it."""
    return sobjects if "synced_at" in sobjects.columns else sobjects.withColumn("synced_at", F.lit(None).cast("timestamp"))


def get_object(catalog: Catalog, name: str) -> DataFrame:
    return catalog["sobjects"].where(F.col("name") == name)


def get_objects(catalog: Catalog, names: Sequence[str]) -> DataFrame:
    return catalog["sobjects"].where(F.col("name").isin(*names)) if names else catalog["sobjects"].limit(0)


def get_fields(catalog: Catalog, name: str) -> DataFrame:
    return catalog["fields"].where(F.col("sobject") == name).join(get_object(catalog, name).select(F.col("name").alias("sobject")), "sobject")


def get_required_fields(catalog: Catalog, name: str) -> DataFrame:
    return get_fields(catalog, name).where("is_required")


def get_rules(catalog: Catalog, name: str) -> DataFrame:
    return catalog["validation_rules"].where((F.col("sobject") == name) & F.col("active"))


def get_relationships(catalog: Catalog, name: str | None = None) -> DataFrame:
    """Outgoing relationships whose two objects and field are known."""
    rels, objects = catalog["relationships"], catalog["sobjects"].select("name")
    rels = rels if name is None else rels.where(F.col("from_sobject") == name)
    known = rels.join(objects.withColumnRenamed("name", "from_sobject"), "from_sobject").join(objects.withColumnRenamed("name", "to_sobject"), "to_sobject")
    return known.join(catalog["fields"].select(F.col("sobject").alias("from_sobject"), F.col("name").alias("field_name")), ["from_sobject", "field_name"])


def stats(catalog: Catalog) -> DataFrame:
    """One row of counts."""
    names = {"sobjects": "sobjects", "fields": "fields", "validation_rules": "validation_rules", "relationships": "relationships"}
    parts = [catalog[t].agg(F.count("*").alias("n")).select(F.lit(k).alias("what"), "n") for k, t in names.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.agg(*[F.coalesce(F.max(F.when(F.col("what") == k, F.col("n"))), F.lit(0)).alias(k) for k in names])


def put_org(catalog: Catalog, org: DataFrame) -> Catalog:
    """The organization: there is one row at most, and a new one replaces it."""
    return Catalog({**catalog.tables, "org_info": conform(org.limit(1), "org_info")})


def get_org(catalog: Catalog) -> DataFrame:
    return catalog["org_info"].limit(1)


def sync_org(spark: SparkSession, catalog: Catalog, org_id: str | None = None, name: str | None = None, as_of: str | None = None) -> Catalog:
    """The organization of a warehouse: the session's catalog and where its tables are, if not given."""
    at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    row = (org_id or spark.catalog.currentCatalog(), spark.conf.get("spark.sql.warehouse.dir"), name or spark.catalog.currentDatabase())
    return put_org(catalog, spark.createDataFrame([row], "org_id string, instance_url string, org_name string").withColumn("last_synced_at", at))


def full_stats(catalog: Catalog) -> DataFrame:
    """The counts with the organization beside them (nulls where there is none)."""
    org = catalog["org_info"].agg(*[F.first(c, ignorenulls=True).alias(c) for c in ("org_id", "org_name", "last_synced_at")])
    return stats(catalog).crossJoin(F.broadcast(org))  # one row and one row


def standard_objects(described: DataFrame) -> DataFrame:
    """From (name, is_queryable, is_createable, is_custom, position): priority objects in their order, then up to twenty others by position."""
    rows = described.where("is_queryable AND is_createable AND NOT is_custom")
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("name"))
    rows = rows.withColumn("grp", F.when(rank > 0, 0).otherwise(1)).withColumn("place", F.when(rank > 0, rank).otherwise(F.col("position")))
    rows = rows.withColumn("at", F.row_number().over(Window.partitionBy("grp").orderBy("place"))).where(f"grp = 0 OR at <= {MOST_OTHERS}")
    return rows.withColumn("rank", F.row_number().over(Window.orderBy("grp", "place"))).select("name", "rank")


def described_fields(described: DataFrame, sobject: str | None = None) -> DataFrame:
    """Field rows from a description with nillable, precision and so on; required is what is known not to be nillable."""
    out = described if sobject is None else described.withColumn("sobject", F.lit(sobject))
    return out.withColumns({"api_name": F.col("name"), "is_required": F.coalesce(~F.col("nillable"), F.lit(False)), "is_nillable": F.coalesce("nillable", F.lit(False))})


def relationships_from(fields: DataFrame, objects: DataFrame) -> DataFrame:
    """A relationship for every reference to a known object; of several targets the last known one stays."""
    each = fields.where(F.size("reference_to") > 0).select("sobject", "name", "relationship_name", "is_required", F.posexplode("reference_to").alias("at", "to_sobject"))
    each = each.join(objects.select(F.col("name").alias("to_sobject")), "to_sobject")
    last = each.groupBy("sobject", "name").agg(F.max(F.struct("at", "to_sobject", "relationship_name", "is_required")).alias("x"))
    return last.select(F.col("sobject").alias("from_sobject"), "x.to_sobject", F.col("name").alias("field_name"), F.coalesce("x.relationship_name", "name").alias("relationship_name"), F.lit("lookup").alias("relationship_type"), F.lit(False).alias("is_cascade_delete"), F.lit(False).alias("is_restricted_delete"), "x.is_required")


def rules_from(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Active rules with their object's name, by entity id; without a known entity a rule goes."""
    ids = entities.where(F.col("id").startswith(ENTITY_PREFIX)).select(F.col("id").alias("entity_id"), F.col("name").alias("sobject")).distinct()
    return rules.where("active").orderBy("name").limit(MOST_RULES).join(ids, "entity_id")


def schema_fields(spark: SparkSession, tables: Mapping[str, DataFrame], references: Mapping[tuple[str, str], Sequence[str]] | None = None) -> DataFrame:
    """Field rows that describe DataFrames: the catalog of a warehouse made from its own schemas."""
    kinds = {"string": "string", "int": "int", "bigint": "int", "double": "double", "boolean": "boolean", "timestamp": "datetime", "date": "date"}
    rows = []
    for name, df in tables.items():
        for f in df.schema.fields:
            rows.append((name, f.name, f.name, f.name, kinds.get(f.dataType.simpleString(), "textarea"), not f.nullable, f.nullable, list((references or {}).get((name, f.name), ()))))
    return spark.createDataFrame(rows, "sobject string, name string, label string, api_name string, type string, is_required boolean, is_nillable boolean, reference_to array<string>")


def sync(spark: SparkSession, catalog: Catalog, tables: Mapping[str, DataFrame], references: Mapping[tuple[str, str], Sequence[str]] | None = None, as_of: str | None = None) -> Catalog:
    """Describe tables into the catalog: objects first, then fields, then relationships to any known object."""
    at = F.lit(as_of).cast("timestamp") if as_of else F.current_timestamp()
    objects = spark.createDataFrame([(n, n, n, False, True, True, True, True, True, True) for n in tables], "name string, label string, api_name string, is_custom boolean, is_queryable boolean, is_createable boolean, is_updateable boolean, is_deletable boolean, is_retrieveable boolean, is_searchable boolean").withColumn("synced_at", at)
    catalog = put(catalog, "sobjects", objects)
    catalog = put(catalog, "fields", schema_fields(spark, tables, references))
    return put(catalog, "relationships", relationships_from(catalog["fields"], catalog["sobjects"]))


def sync_each(spark: SparkSession, catalog: Catalog, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], references: Mapping[tuple[str, str], Sequence[str]] | None = None, as_of: str | None = None) -> tuple[Catalog, DataFrame]:
    """As ``sync``, but a table that can't be described is reported and the others go on.

    Returns the catalog and (object, success, n_fields, n_relationships, error) of every table.
    """
    found, errors = {}, {}
    for name, given in tables.items():
        try:
            df = given() if callable(given) else given
            df.schema  # noqa: B018  plans are made here
            found[name] = df
        except (PySparkException, ValueError) as error:
            errors[name] = str(error).splitlines()[0]
    if found:
        catalog = sync(spark, catalog, found, references, as_of)
    fields = catalog["fields"].groupBy(F.col("sobject").alias("object")).agg(F.count("*").alias("n_fields"))
    rels = catalog["relationships"].groupBy(F.col("from_sobject").alias("object")).agg(F.count("*").alias("n_relationships"))
    report = spark.createDataFrame([(n, n in found, errors.get(n)) for n in tables], "object string, success boolean, error string")
    counted = report.join(fields, "object", "left").join(rels, "object", "left")
    n = lambda c: F.when(F.col("success"), F.coalesce(c, F.lit(0))).otherwise(0).cast("long").alias(c)
    return catalog, counted.select("object", "success", n("n_fields"), n("n_relationships"), "error")
