"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are turned and projected by several seeded rotations, shifted, and put
in the order of a Hilbert curve, once for each rotation. Spark range-partitions every
order into windows of about ``WINDOW`` vectors. A query looks through the windows
around its own place in every order; what they hold is ranked by the
cosine, and the best of all orders are merged. More of them than are asked for are then
ranked again by their cosine in exact arithmetic on the original vectors, rounded once, so
that equal cosines are equal numbers and the smaller id comes first.

How many neighbouring windows that are is either a number (``reach``), for vectors with
structure, and then work grows as the table does; or a share of all of them (``SHARE``),
for vectors without structure are near each other in no order: on such data
(64 dimensions, weak clusters) recall is about what the windows cover, and a
share that reaches 0.9 reads much of the table. Groups that meet are bounded either way:
the queries of a window come in parts of about ``ASKED``.

Equal vectors are indexed once and carry their smallest ids, enough for any
answer, so neither a group of copies nor a query repeated in it grows a window.

Defined cases: vectors that are null, zero or hold null or non-finite
components, rows without an id, and vectors of another than the commonest number of
dimensions (of two, the smaller) take no part; rows that repeat an id and its vector
count once; ties go to the smaller id; a query gets all candidates if there are fewer;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import scratch
from .shipping import ship

CURVES = 8
DIMENSIONS = 8
BITS = 6
WINDOW = 2048
SHARE = 0.2
SEED = 5
#: Queries that meet a window's vectors in one group, about.
ASKED = 4096
#: Digits to which cosines are compared before they are ranked exactly; more candidates than asked for are kept.
DIGITS = 12
#: Rows of equal vectors that one group of the first aggregation holds at most, about.
GROUP = 50_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer points (n, dimensions) with coordinates below 2**bits.

    After Skilling, "Programming the Hilbert curve" (2004), for all points at once.
    """
    x = np.ascontiguousarray(cells.T.astype(np.int64))
    bit = 1 << (bits - 1)
    while bit > 1:
        low = bit - 1
        for row in x:
            high = (row & bit) != 0
            swap = np.where(high, 0, (x[0] ^ row) & low)
            x[0] ^= np.where(high, low, swap)
            row ^= swap
        bit >>= 1
    for i in range(1, len(x)):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    bit = 1 << (bits - 1)
    while bit > 1:
        flip ^= np.where((x[-1] & bit) != 0, bit - 1, 0)
        bit >>= 1
    x ^= flip
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for row in x:
            place = (place << 1) | ((row >> b) & 1)
    return place


def _unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _keyed(size: int, curves: int, seed: int):
    names = ["rep", "vector", "ids", "asks", "curve", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            units = _unit(_matrix(batch.column(1), size))
            for curve in range(curves):
                rng = np.random.default_rng([seed, curve])
                turned = units @ np.linalg.qr(rng.normal(size=(size, size)))[0][:, : min(DIMENSIONS, size)]
                shifted = (turned * math.sqrt(size) / 2.5 + 1) / 2 * 0.75 + rng.uniform(0, 0.25, turned.shape[1])
                places = hilbert(np.clip(shifted * 2**BITS, 0, 2**BITS - 1), BITS)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(places), curve, np.int32)), pa.array(places)], names=names)

    return run


def _searched(size: int, k: int):
    """Within one window of one curve: for each query vector the best k vectors, itself included if it is there."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        asked = table.column("asking").to_numpy(zero_copy_only=False).astype(bool)
        reps = table.column("rep").to_numpy()
        units = _unit(_matrix(table.column("vector").combine_chunks(), size))
        ids = table.column("ids").to_pylist()
        here, rows = np.flatnonzero(~asked), np.flatnonzero(asked)
        out: list[tuple[int, int, list[int], float]] = []
        for at in range(0, len(rows) if len(here) else 0, 256):
            some = rows[at : at + 256]
            scores = np.round(units[some] @ units[here].T, DIGITS)
            for q, line in zip(some.tolist(), scores):
                near = np.argpartition(-line, min(k, len(line)) - 1)[:k]
                near = np.flatnonzero(line >= line[near].min())
                order = near[np.lexsort((reps[here[near]], -line[near]))][:k]
                out += [(int(reps[q]), int(reps[here[j]]), ids[here[j]], float(line[j])) for j in order]
        columns = list(zip(*out)) or [()] * 4
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()))], names=["query_rep", "rep", "ids", "score"])

    return run


def _whole(vector: list[float]) -> list[int]:
    """Whole numbers in the proportions of a vector's components."""
    parts = [x.as_integer_ratio() for x in vector]
    most = max(d for _, d in parts)
    return [n * (most // d) for n, d in parts]


def cosine(x: list[float], y: list[float]) -> float:
    """The cosine of two vectors: its square is an exact fraction, rounded once, and so is the root."""
    x, y = _whole(x), _whole(y)
    dot = math.sumprod(x, y)
    size = math.sqrt(dot * dot / (math.sumprod(x, x) * math.sumprod(y, y)))
    return size if dot >= 0 else -size


def _rescored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [cosine(x, y) for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], names=["query_rep", "ids", "score"])


def vectors(table: DataFrame) -> DataFrame:
    """vec_id and vector (doubles) of the rows that take part, each once."""
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"))
    rows = rows.where("vec_id IS NOT NULL AND vector IS NOT NULL AND size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
    return rows.where(finite)


def distinct(rows: DataFrame, queries_at: int, k: int, n_rows: int) -> DataFrame:
    """rep (smallest id), vector, ids (the k + 1 smallest), asks (whether a query has it) of each distinct vector.

    Copies are first gathered in salted groups of bounded size.
    """
    salts = max(64, n_rows // GROUP)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(salts)))
    asks = F.max(F.pmod("vec_id", F.lit(queries_at)) == 0).alias("asks")
    some = rows.groupBy("vector", "salt").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"), asks)
    all_ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return some.groupBy("vector").agg(all_ids.alias("ids"), F.max("asks").alias("asks")).select(F.col("ids")[0].alias("rep"), "vector", "ids", "asks")


def windows(index: DataFrame, size: int, n: int, curves: int = CURVES, window: int = WINDOW, seed: int = SEED) -> DataFrame:
    """Every distinct vector in its window of every curve: rep, vector, ids, asks, curve, window (from 0), last (window of the curve)."""
    keyed = scratch.cut(index.mapInArrow(_keyed(size, curves, seed), "rep long, vector array<double>, ids array<long>, asks boolean, curve int, place long"), "places")
    parts = max(1, math.ceil(n / window))
    each = [keyed.where(F.col("curve") == c).repartitionByRange(parts, "place", "rep").withColumn("window", F.spark_partition_id()).drop("place") for c in range(curves)]
    out = each[0]
    for one in each[1:]:
        out = out.unionByName(one)
    out = scratch.cut(out, "windows")
    # Partitions are numbered through all curves, and there may be more and smaller ones than asked for: neighbours merge until a window is full.
    by = Window.partitionBy("curve")
    merged = out.groupBy("curve", "window").agg(F.count("*").alias("n")).withColumn("full", F.floor((F.sum("n").over(by.orderBy("window")) - F.col("n")) / window))
    merged = merged.withColumn("to", F.dense_rank().over(by.orderBy("full")) - 1).select("curve", "window", "to", F.max("to").over(by).alias("last"))
    return out.join(merged, ["curve", "window"]).drop("window").withColumnRenamed("to", "window")


def nearest(table: DataFrame, queries_at: int = 50, k: int = 5, curves: int = CURVES, window: int = WINDOW, share: float = SHARE, reach: int | None = None, seed: int = SEED) -> DataFrame:
    """For each row whose id is divisible by ``queries_at``: query_id, rank (from 1), vec_id, score of its k nearest found.

    A query looks ``reach`` windows to either side, or, if that is not given, as many as make ``share`` of all.
    """
    spark = table.sparkSession
    ship(spark)
    rows = vectors(table)
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    size, n_rows = common
    rows = rows.where(F.size("vector") == size)
    index = scratch.cut(distinct(rows, queries_at, k, n_rows), "vectors")
    n, n_asked = index.agg(F.count("*"), F.count(F.when(F.col("asks"), 1))).first()
    placed = windows(index, size, n, curves, window, seed)
    far = F.lit(reach) if reach is not None else F.ceil((F.col("last") + 1) * share / 2).cast("int")
    asking = placed.where("asks").withColumn("window", F.explode(F.sequence(F.greatest(F.lit(0), F.col("window") - far), F.least(F.col("last"), F.col("window") + far))))
    # About so many queries meet a window; its vectors go to each part of them.
    meeting = n_asked * (share if reach is None else min(1.0, (2 * reach + 1) * window / max(n, 1)))
    parts = max(1, round(meeting / ASKED))
    asking = asking.withColumns({"asking": F.lit(True), "part": F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int")})
    both = placed.withColumns({"asking": F.lit(False), "part": F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))}).unionByName(asking, allowMissingColumns=True)
    both = both.select("curve", "window", "part", "rep", "vector", F.expr("CASE WHEN asking THEN NULL ELSE ids END").alias("ids"), "asking")
    found = both.groupBy("curve", "window", "part").applyInArrow(_searched(size, 2 * (k + 1)), "query_rep long, rep long, ids array<long>, score double")
    found = found.groupBy("query_rep", "rep").agg(F.max("score").alias("score"), F.first("ids").alias("ids"))
    found = found.withColumn("at", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep"))).where(F.col("at") <= 2 * (k + 1))
    own = index.where("asks").select(F.col("rep").alias("query_rep"), F.col("vector").alias("query"))
    pairs = found.select("query_rep", "rep", "ids").join(index.select("rep", "vector"), "rep").join(own, "query_rep").select("query_rep", "ids", "query", "vector")
    exact = pairs.mapInArrow(_rescored, "query_rep long, ids array<long>, score double").select("query_rep", "score", F.explode("ids").alias("vec_id"))
    best = Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id")
    exact = exact.withColumn("at", F.row_number().over(best)).where(F.col("at") <= k + 1)
    answers = exact.groupBy("query_rep").agg(F.array_sort(F.collect_list(F.struct("at", "vec_id", "score"))).alias("near"))
    asked = rows.where(F.pmod("vec_id", F.lit(queries_at)) == 0).select(F.col("vec_id").alias("query_id"), "vector").distinct()
    asked = asked.join(own.withColumnRenamed("query", "vector"), "vector").select("query_id", "query_rep")
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = asked.join(answers, "query_rep").select("query_id", F.posexplode(others).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
