"""Two-pass external shuffle into shards of equal counts.

Pass one scatters whole records uniformly over buckets by a seeded hash, so many
that each fits a worker's memory. Pass two shuffles every bucket by itself
(Fisher-Yates, seeded by the bucket) and writes it. A record's place in the whole
order is its bucket's start plus its place there; shards are equal stretches of
that order, so their counts are at most one apart, and a reader of a shard meets
the corpus in random order.

Defined cases: a null text has no bytes (size 1, CRC 0); rows are put in order
before they are shuffled, so reruns and retried tasks agree; rows equal in all
columns are interchangeable and each get a place, and where they overfill a bucket they
are counted, numbered and scattered by number; an empty table gives an empty result; all columns
are kept, whatever their names, except that ``shard`` and ``slot`` replace
columns of those names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import scratch
from .shipping import ship

SHARDS = 16
SEED = 20240607
#: Bytes of text that a bucket holds on average. A worker holds one bucket, as Arrow, twice.
BUCKET_BYTES = 4 << 20
#: Buckets that a task shuffles, one after another, about.
TASK_BUCKETS = 4
#: Tasks at most: beyond, a task shuffles more buckets, still one after another.
MOST_TASKS = 200_000
#: How often the average a bucket may hold before it is looked through for copies.
OVERFULL = 4
#: Buckets of a stretch: starts are summed within stretches, then over them.
STRETCH = 4096


def _shuffled(seed: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        places = pc.sort_indices(table, sort_keys=[("_id", "ascending"), ("_tie", "ascending")])
        bucket = table.column("_bucket")[0].as_py()
        picked = places.to_numpy()[np.random.default_rng([seed, bucket]).permutation(table.num_rows)]
        return table.take(pa.array(picked)).append_column("_place", pa.array(np.arange(table.num_rows), pa.int64()))

    return run


def _sizes(rows: DataFrame) -> DataFrame:
    """_bucket, n (its rows) and bytes, a written table."""
    return scratch.cut(rows.groupBy("_bucket").agg(F.count("*").alias("n"), F.sum("_size").alias("bytes")), "sizes")


def _starts(sizes: DataFrame) -> DataFrame:
    """_bucket, _start (rows in the buckets before) and _all (rows in all)."""
    sizes = sizes.select("_bucket", "n", F.expr(f"_bucket div {STRETCH}").alias("stretch"))
    stretches = sizes.groupBy("stretch").agg(F.sum("n").alias("n"))
    before = stretches.select("stretch", (F.sum("n").over(Window.orderBy("stretch")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("_all"))
    here = F.sum("n").over(Window.partitionBy("stretch").orderBy("_bucket")) - F.col("n")
    return sizes.withColumn("here", here).join(before, "stretch").select("_bucket", (F.col("before") + F.col("here")).alias("_start"), "_all")


def _hashed(docs: DataFrame, seed: int) -> Column:
    """A hash of all columns; maps and variants by their JSON."""
    odd = [F.col(f"`{f.name}`") for f in docs.schema if isinstance(f.dataType, (T.MapType, T.VariantType))]
    plain = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return F.xxhash64(F.lit(seed), *plain, *([F.to_json(F.struct(*odd))] if odd else []))


def _scattered(rows: DataFrame, sizes: DataFrame, buckets: int, bucket_bytes: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """The rows, those of which copies overfill a bucket dealt out by a number among the copies, and the buckets' sizes."""
    full = sizes.where(F.col("bytes") > OVERFULL * bucket_bytes).select("_bucket")
    if not full.limit(1).count():
        return rows, sizes
    key = ["_bucket", "_id", "_tie", "_tie2"]
    many = rows.join(full.hint("shuffle_hash"), "_bucket", "left_semi").groupBy(*key).agg(F.sum("_size").alias("n"), F.count("*").alias("c")).where((F.col("n") > bucket_bytes) & (F.col("c") > 1))
    many = scratch.cut(many.select(*key, "c"), "copies")
    if not many.limit(1).count():
        return rows, sizes
    # Fewer than one key for each bucket of the average size.
    one = rows.join(many.hint("shuffle_hash"), key, "left_semi").groupBy(*key).agg(F.first("_row").alias("_row"), F.first("_size").alias("_size"))
    copies = one.join(many, key).withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "c")))
    copies = copies.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 2), "_id", "_tie", "copy"), F.lit(buckets)))
    rows = rows.join(many.hint("shuffle_hash"), key, "left_anti").unionByName(copies.select(*rows.columns))
    return rows, _sizes(rows)


def shuffle(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of ``docs`` with ``shard`` (from 0) and ``slot`` (gapless from 0 in each shard)."""
    spark = docs.sparkSession
    ship(spark)
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("shard", "slot")]
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    total = docs.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    buckets = max(1, -(-total // bucket_bytes))
    tie, tie2 = _hashed(docs, seed), _hashed(docs, seed + 7)
    rows = docs.select(F.struct(*kept).alias("_row"), F.pmod(F.xxhash64(F.lit(seed + 1), number, tie), F.lit(buckets)).alias("_bucket"), tie.alias("_tie"), tie2.alias("_tie2"), number.alias("_id"), size.alias("_size"))
    rows, sizes = _scattered(rows, _sizes(rows), buckets, bucket_bytes, seed)
    starts = scratch.cut(_starts(sizes), "starts")
    rows = rows.drop("_size", "_tie2")
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), min(MOST_TASKS, buckets // TASK_BUCKETS))
    # One shuffle of the texts: the small table of starts comes to the buckets, where they are shuffled.
    dealt = rows.repartition(tasks, "_bucket").join(starts.hint("shuffle_hash"), "_bucket")
    schema = T.StructType([*dealt.schema.fields, T.StructField("_place", T.LongType())])
    placed = dealt.groupBy("_bucket").applyInArrow(_shuffled(seed), schema)
    at = F.col("_start") + F.col("_place")
    shard = F.expr(f"(_start + _place) * {shards} div _all")
    first = F.expr(f"({shards - 1} + ((_start + _place) * {shards} div _all) * _all) div {shards}")
    return placed.select("_row.*", shard.cast("int").alias("shard"), (at - first).cast("long").alias("slot"))


def write(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Write the shards below ``path``, a folder for each, and return their reader."""
    shuffled = shuffle(docs, shards, seed, bucket_bytes)
    shuffled.write.partitionBy("shard").parquet(path)
    return docs.sparkSession.read.schema(shuffled.schema).parquet(path)
