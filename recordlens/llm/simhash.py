"""SimHash near-duplicates: fingerprints, links within a Hamming distance, and their components.

A fingerprint is embedded as the bit counts of its 32 two-bit segments. Two
fingerprints that differ in at most ``DISTANCE`` bits have counts whose
Manhattan distance is at most that, so the counts' distance is a lower bound.
The grid cuts the segments into groups: within distance 4 all but four groups at
most have equal counts. A cell is thus the counts of all groups but four, and every
link shares a cell. With eight groups a fingerprint lies in 70 cells that carry
22.6 bits each (a two-bit count carries 1.41: it repeats by chance three times
out of eight), so a cell holds N / 2^22.6 chance members. With more fingerprints
than cells there are more groups (``grid``), which keeps that number below one.

Inside a cell no more rows are made than it has members. Every member is first
tested against the cell's ``PIVOTS`` few pivots, by the lower bound, then exactly; the links
found connect nearly all. Only members of cells of which several
components are left are then paired, and only across components. Where such
a cell still has more than ``CELL`` members, its members are put into finer cells: two fingerprints
are within 4 bits just if some value is within 2 bits of both, so each is put to
the 2,081 values around it and linked to the smallest fingerprint there, which is
exact without a further test and linear in their number.

Defined cases: a null text counts as empty; texts without words have
fingerprint zero and are linked like any other; fewer than four words are one
shingle; repeated rows share their component; an empty table gives an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch
from .arrow import slices
from .shipping import ship

SHINGLE = 4
SEED = 42
DISTANCE = 4
SEGMENTS = 32
#: Numbers of groups that the grid may have.
GROUPS = (8, 10, 12, 16)
#: What a cell's pivots are nearest to, counted from the highest bit.
PIVOTS = (0, -1, 0x5A3C96E10F784B2D, 0x2D1E69B4C3A5870F)
#: Members of a cell up to which those of different components are compared with each other.
CELL = 512
#: Fingerprints that a task puts into their cells, about, once there are more than the usual number of tasks would put.
TASK_PRINTS = 50_000

ODD = 0x5555555555555555


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shingles(text: str | None, words: int = SHINGLE) -> list[int]:
    """The hashes of a text's runs of ``words`` words, in order; a shorter text is one run, one without words has none."""
    found = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII letters and spaces only
    if not found:
        return []
    line = b" ".join(found)
    digest = xxhash.xxh64_intdigest
    if len(found) <= words:
        return [digest(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1)
    starts = [0, *ends[:-words].tolist()]
    return [digest(line[a:b], SEED) for a, b in zip(starts, (ends[words - 1 :] - 1).tolist())]


def fingerprint(text: str | None, words: int = SHINGLE) -> int:
    """The fingerprint of one text, as a signed long."""
    return summed(shingles(text, words))


def summed(hashes: list[int] | np.ndarray) -> int:
    """The fingerprint of a text's hashes."""
    if not len(hashes):
        return 0
    codes = np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(codes), 1 << 16):
        ones += np.unpackbits(codes[at : at + (1 << 16)], axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        prints = pa.array([fingerprint(t) for t in part.column(1).to_pylist()], pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), prints], names=["doc_id", "digest", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, digest (a hash of the text) and fp, the fingerprint as a signed long, for each row."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest")).mapInArrow(_rows, "doc_id long, digest long, fp long")


def counts(fp: Column) -> Column:
    """The bit counts of the two-bit segments, in unary within each segment: 00, 01 or 11.

    So the Manhattan distance of two vectors of counts is the number of bits in which these longs differ.
    """
    odd, even = fp.bitwiseAND(F.lit(ODD)), F.shiftrightunsigned(fp, 1).bitwiseAND(F.lit(ODD))
    return odd.bitwiseOR(even).bitwiseOR(F.shiftleft(odd.bitwiseAND(even), 1))


def grid(n: int) -> list[tuple[int, int]]:
    """The groups for ``n`` distinct fingerprints, each as its first segment and the next group's: the fewest whose cells are as many."""
    for groups in GROUPS:
        ends = [SEGMENTS * g // groups for g in range(groups + 1)]
        cuts = list(zip(ends, ends[1:]))
        fixed = sum(sorted(b - a for a, b in cuts)[: groups - DISTANCE])
        if 2 ** (math.log2(8 / 3) * fixed) >= n:
            break
    return cuts


def _cells(fps: DataFrame, cuts: list[tuple[int, int]]) -> DataFrame:
    """fp, cell: the counts of all groups but four; those hold 10 in each segment, which no count has."""
    keys = []
    for chosen in combinations(cuts, len(cuts) - DISTANCE):
        keep = sum(((1 << 2 * (b - a)) - 1) << (2 * a) for a, b in chosen)
        filler = (ODD << 1) & ~keep & (2**64 - 1)
        keys.append(F.col("counts").bitwiseAND(F.lit(_signed(keep))).bitwiseOR(F.lit(_signed(filler))))
    return fps.select("fp", counts(F.col("fp")).alias("counts")).select("fp", F.explode(F.array(*keys)).alias("cell"))


def _linked(u: Column, v: Column) -> Column:
    """Whether two fingerprints are linked: by the lower bound, then exactly."""
    differ = lambda x, y: F.bit_count(x.bitwiseXOR(y))
    return (differ(counts(u), counts(v)) <= DISTANCE) & (differ(u, v) <= DISTANCE)


def _around(fps: DataFrame, within: int = DISTANCE // 2) -> DataFrame:
    """Links (u, v) among all given fingerprints by the values within 2 bits of them."""
    flips = [_signed(sum(1 << b for b in bits)) for n in range(within + 1) for bits in combinations(range(64), n)]
    near = fps.select("fp", F.explode(F.array(*map(F.lit, flips))).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("value"))
    least = near.groupBy("value").agg(F.min("fp").alias("least"), F.count("*").alias("n")).where("n > 1")
    return near.join(least, "value").where("fp <> least").select(F.col("fp").alias("u"), F.col("least").alias("v"))


def _rest(members: DataFrame, root: DataFrame, largest: int) -> DataFrame:
    """Links (u, v) between members of a cell that are of different components as yet."""
    rooted = members.where(F.col("n") > 3).join(root.select(F.col("node").alias("fp"), "root"), "fp", "left").select("cell", "fp", "n", F.coalesce("root", "fp").alias("root"))
    rooted = scratch.cut(rooted, "rooted")
    mixed = rooted.groupBy("cell").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("cell")
    left = scratch.cut(rooted.join(mixed.hint("merge"), "cell", "left_semi"), "left")
    some = left.where(F.col("n") <= largest)
    a, b = some.select("cell", F.col("fp").alias("u"), F.col("root").alias("ru")), some.select("cell", F.col("fp").alias("v"), F.col("root").alias("rv"))
    near = a.join(b, "cell").where((F.col("u") < F.col("v")) & (F.col("ru") != F.col("rv")) & _linked(F.col("u"), F.col("v"))).select("u", "v")
    many = left.where(F.col("n") > largest).select("fp").distinct()
    if many.limit(1).count():
        near = near.unionByName(_around(many))
    return near.distinct()


def links(fps: DataFrame, largest: int = CELL) -> DataFrame:
    """Pairs (u, v) of distinct fingerprints, all of them linked, that connect whatever links connect.

    ``fps`` has distinct ``fp`` and is read several times.
    """
    n = fps.count()
    tasks = max(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // TASK_PRINTS)
    # One shuffle by cell serves both the count and the join with it.
    cells = _cells(fps.repartition(tasks, "fp"), grid(n)).repartition("cell")
    pivots = [F.min(F.col("fp").bitwiseXOR(F.lit(p))).bitwiseXOR(F.lit(p)) for p in PIVOTS]
    shared = cells.groupBy("cell").agg(F.count("*").alias("n"), F.array(*pivots).alias("pivots")).where("n > 1")
    # The table of shared cells grows with the corpus: it is never broadcast, however small it is here.
    members = scratch.cut(cells.join(shared.hint("shuffle_hash"), "cell").select("cell", "fp", "n", "pivots"), "members")
    pivot = F.explode(F.filter("pivots", lambda p: (p != F.col("fp")) & _linked(p, F.col("fp"))))
    near = scratch.cut(members.select("fp", pivot.alias("pivot")).select(F.least("fp", "pivot").alias("u"), F.greatest("fp", "pivot").alias("v")).distinct(), "near")
    return near.unionByName(_rest(members, components.roots(near), largest))


def grouped(docs: DataFrame, largest: int = CELL) -> DataFrame:
    """doc_id, digest, fp and component_id (the smallest doc_id reachable over links), a row for each row of ``docs``.

    Fingerprints are computed once, into a written table.
    """
    prints = scratch.cut(fingerprints(docs), "fingerprints")
    firsts = scratch.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    root = scratch.cut(components.roots(links(firsts.select("fp"), largest)), "roots")
    rooted = firsts.join(root.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("fp", "root", "component_id")
    return prints.join(named, "fp")


def near_duplicates(docs: DataFrame, largest: int = CELL) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links), a row for each row of ``docs``."""
    return grouped(docs, largest).select("doc_id", "fp", "component_id")


def representatives(docs: DataFrame, largest: int = CELL) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each component: that with the smallest doc_id (of several, the smallest hash of the text)."""
    return firsts(docs, grouped(docs, largest))


def firsts(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """Of each root in ``groups`` (doc_id, digest, root for each row of ``docs``) the first row, as ``representatives`` says."""
    groups = scratch.cut(groups.select("doc_id", "digest", "root"), "groups")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    chosen = scratch.cut(groups.groupBy("root").agg(F.min(order).alias("r")).select("r.doc_id", "r.digest"), "chosen")
    c = chosen.alias("c")
    same = lambda x: F.col(f"{x}.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col(f"{x}.digest") == F.col("c.digest"))
    rows = docs.select(F.struct(*[F.col(f"`{x}`") for x in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("digest"))
    kept = rows.alias("d").join(c.hint("shuffle_hash"), same("d"), "left_semi")
    twice = groups.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).where("n > 1").alias("t").join(c, same("t"), "left_semi")
    if twice.limit(1).count():  # a chosen row occurs more than once
        kept = kept.dropDuplicates(["doc_id", "digest"])
    return kept.select(*[F.col(f"row.`{x}`").alias(x) for x in docs.columns])
