"""Intermediate tables in the folder that driver and executors share.

A written table cuts the lineage: what is lost with an executor is read again
from shared storage instead of being computed from the start, and an expensive
step (tokenizing, fingerprinting) runs once although several later steps use it.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The application's folder below ``spark.checkpoint.dir``.

    Where that is unset, a temporary folder serves, in local mode only.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "recordlens-scratch")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/recordlens/{spark.sparkContext.applicationId}"


#: Tables that this process has cut and not deleted.
_made: list[str] = []


def cut(df: DataFrame, label: str, instead: DataFrame | None = None) -> DataFrame:
    """Write ``df`` as a table of its own and return the reader of that table.

    ``instead`` is a table cut earlier that this one replaces: it is deleted.
    """
    spark = df.sparkSession
    path = f"{folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append(path)
    if instead is not None:
        _delete(spark, instead._scratch_path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, name: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    if name in _made:
        _made.remove(name)


def made() -> set[str]:
    """The tables cut so far, for ``sweep``."""
    return set(_made)


def sweep(spark: SparkSession, before: set[str], keep: DataFrame) -> None:
    """Delete what was cut since ``before``, but for one table that no longer needs the others."""
    for path in made() - before - {keep._scratch_path}:
        _delete(spark, path)


def drop(spark: SparkSession) -> None:
    """Delete all tables this application has cut; DataFrames on them become unreadable."""
    _delete(spark, folder(spark))
    _made.clear()
