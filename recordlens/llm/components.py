"""Connected components by alternating stars, on written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch


def _signature(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


#: A node is hot if it has more of the links than one in so many, and more than ``LEAST``: so there are at most so many.
HOT = 256
LEAST = 1000
SALTS = 32


def _hot(both: DataFrame, n: int) -> list[int]:
    """The hot nodes u of ``n`` links both ways: at most ``HOT`` of them."""
    most = max(LEAST, n // HOT)
    return [r["u"] for r in both.groupBy("u").agg(F.count("*").alias("n")).where(F.col("n") > most).collect()] if n > LEAST else []


def _meet(rows: DataFrame, least: DataFrame, hot: list[int]) -> DataFrame:
    """Rows (u, v) with the least of their u. The rows of hot nodes are spread over ``SALTS`` keys by v."""
    if not hot:
        return rows.join(least, "u")
    is_hot = F.col("u").isin(hot)
    salted = rows.withColumn("salt", F.when(is_hot, F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).otherwise(0))
    every = least.withColumn("salt", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))))
    return salted.join(every, ["u", "salt"]).drop("salt")


def roots(edges: DataFrame) -> DataFrame:
    """For edges (u, v) of longs: (node, root), root being the smallest node reachable. Roots themselves have no row.

    Each round joins every node's larger neighbours to its smallest one, then its
    smaller neighbours likewise, until nothing changes; the number of rounds
    grows with the logarithm of the number of nodes. Only per-node minima are
    aggregated, so a node with many neighbours is pre-aggregated before it is
    shuffled, and its links are spread by a salt where they meet its minimum. Loops
    and repeated edges are allowed; an empty table gives an empty result.
    """
    now = scratch.cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before, after = None, _signature(now)
    while after != before and after[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        hot = _hot(both, 2 * after[0])
        least = both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("least"))
        large = _meet(both, least, hot).where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
        least = large.groupBy("u").agg(F.min("v").alias("least"))
        small = _meet(large, least, hot).select(F.when(F.col("v") == F.col("least"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("least").alias("v"))
        now = scratch.cut(small.where("u <> v").distinct(), "edges", instead=now)
        before, after = after, _signature(now)
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
