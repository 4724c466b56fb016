"""Sessions, tables and written intermediate results."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: Declared references of the test tables: (table, column) -> tables.
REFERENCES = {
    ("nation", "n_regionkey"): ("region",),
    ("customer", "c_nationkey"): ("nation",),
    ("supplier", "s_nationkey"): ("nation",),
    ("orders", "o_custkey"): ("customer",),
    ("lineitem", "l_orderkey"): ("orders",),
    ("lineitem", "l_partkey"): ("part",),
    ("lineitem", "l_suppkey"): ("supplier",),
    ("labels", "doc_id"): ("documents",),
}


def session(name: str = "recordlens", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; further settings as given."""
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", **conf}
    return SparkSession.builder.appName(name).config(map=settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register(spark: SparkSession, folder: str, names: tuple[str, ...] = TABLES) -> None:
    """Temporary views of the tables, for SQL."""
    for name in names:
        table(spark, folder, name).createOrReplaceTempView(name)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table of its own in the folder of ``spark.checkpoint.dir``, read again: its lineage is cut there.

    Where that is unset, a temporary folder serves, in local mode only.
    """
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "recordlens-tables")
    path = f"{base.rstrip('/')}/recordlens-tables/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
