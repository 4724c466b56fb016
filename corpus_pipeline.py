"""From raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame. ``run`` writes
every stage's rows as Parquet in the shared folder, gives them to the next
stage and deletes what the stages before left; all but the last have the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from recordlens.llm import linededup, minhash, mixing, packing, quality, scratch
from recordlens.llm.queries import vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the production policy rejects go."""
    return quality.accepted(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Runs of lines that came before are deleted; a document of which nothing is left stays, empty."""
    return linededup.deduplicated(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group that is connected by five-word Jaccard similarities of 0.8 or more."""
    return minhash.representatives(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come near their target weights: a row for each document and pass, with the words the mix takes."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the mixed documents in sequences of at most 4096 tokens."""
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Fingerprints, tokens and permutations can't be expressed in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = raw = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before = scratch.made()
        docs = scratch.cut(stage(spark, docs, sf_dir), name, instead=docs if docs is not raw else None)
        scratch.sweep(spark, before, keep=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
