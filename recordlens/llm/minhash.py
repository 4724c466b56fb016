"""Near-duplicates by Jaccard similarity: SimHash and MinHash find candidates, the texts' shingles decide.

The stage of the pipeline that keeps one of several near copies calls this. Candidates are what
``simhash`` links, on fingerprints of the sets below, and what MinHash adds: at a Jaccard similarity of 0.8
two 64-bit SimHash fingerprints differ in about 10 bits, and in up to 17 for all but one pair in a
hundred, which no grid of 64 bits can hold. One exact check follows both.

Two texts are linked if their sets of five-word shingles have a Jaccard
similarity of ``SIMILAR`` or more. Texts with equal sets are one node. A node has
``BANDS`` keys, each of ``ROWS`` minima; nodes that share a key are candidates,
and each pair of candidates is decided by the exact similarity of its texts. A
pair at 0.8 shares no key with a probability of (1 - 0.8^5)^32, or 3 in a
million, and less above.

In keys with more than ``CELL`` nodes, all are first compared with the smallest
one. What is then left of such a key in several parts is compared across parts only: the
nodes of keys that hang together are one group, met block by block, each node with its set of shingles
once for each block. A sketch of 512 bits settles most pairs without the sets
(two sets at 0.8 fail it with a probability of 2 in a million), the sets decide the others,
and only links leave the join. These connect the same nodes as all pairs.

Defined cases: as in ``simhash``; texts without words are equal to each other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import components, scratch, simhash
from .arrow import slices
from .shipping import ship

SHINGLE = 5
#: The least similarity of a link, as a fraction of whole numbers.
SIMILAR = (4, 5)
BANDS = 32
ROWS = 5
#: Nodes up to which a key's are all compared with each other.
CELL = 32
#: Bytes of sets that a worker remembers while it compares.
HELD = 64 << 20
#: Bits of a sketch, and how many may differ: 0.1 of them do on average at 0.8, with a deviation of 7.
BITS = 512
DIFFER = 85
#: Nodes of a block of a group.
BLOCK = 512

_draw = np.random.default_rng(simhash.SEED)
_XOR = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64)
_TIMES = _draw.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
_SKETCH_XOR = _draw.integers(0, 2**64, BITS, np.uint64)
_SKETCH_TIMES = _draw.integers(0, 2**64, BITS, np.uint64) | np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set of a text's shingles, as sorted hashes."""
    return np.unique(np.array(simhash.shingles(text, SHINGLE), "<u8"))


def keys(hashes: np.ndarray) -> np.ndarray:
    """The keys of a set's bands, as signed longs."""
    least = np.full(BANDS * ROWS, 2**64 - 1, "<u8")
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[at : at + 512, None] ^ _XOR) * _TIMES).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(least.reshape(BANDS, ROWS))], "<u8").view("<i8")


def sketch(hashes: np.ndarray) -> np.ndarray:
    """A bit of each of ``BITS`` minima of a set, as longs."""
    least = np.full(BITS, 2**64 - 1, "<u8")
    for at in range(0, len(hashes), 512):
        least = np.minimum(least, ((hashes[at : at + 512, None] ^ _SKETCH_XOR) * _SKETCH_TIMES).min(axis=0))
    return np.packbits((least >> np.uint64(24)).astype(np.uint8) & 1).view("<i8")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return SIMILAR[1] * common >= SIMILAR[0] * (len(x) + len(y) - common)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [shingles(t) for t in part.column(1).to_pylist()]
        nodes = pa.array([simhash._signed(xxhash.xxh64_intdigest(s.tobytes(), simhash.SEED)) for s in sets], pa.int64())
        found = pa.array([keys(s) for s in sets], pa.list_(pa.int64()))
        prints = pa.array(map(simhash.summed, sets), pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), nodes, pa.array(map(len, sets), pa.int64()), prints, found, part.column(1)], names=["doc_id", "digest", "node", "size", "fp", "keys", "text"])


def _similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sets: dict[int, np.ndarray] = {}
    held = 0
    for batch in batches:
        us, vs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        mask = []
        for u, v, s, t in zip(us, vs, batch.column(2), batch.column(3)):
            if held > HELD:
                sets.clear()
                held = 0
            for node, text in ((u, s), (v, t)):
                if node not in sets:
                    sets[node] = shingles(text.as_py())
                    held += sets[node].nbytes
            mask.append(similar(sets[u], sets[v]))
        yield pa.RecordBatch.from_arrays([pa.array([w for w, m in zip(c, mask) if m], pa.int64()) for c in (us, vs)], names=["u", "v"])


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        sets = [shingles(t) for t in part.column(1).to_pylist()]
        longs = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([sketch(x) for x in sets], longs), pa.array([x.view("<i8") for x in sets], longs)], names=["node", "sketch", "set"])


def _texts(nodes: DataFrame, signed: DataFrame) -> DataFrame:
    """node and a text of it, for all given nodes."""
    return signed.select("node", "text").join(nodes.hint("shuffle_hash"), "node", "left_semi").groupBy("node").agg(F.min("text").alias("text"))


def verified(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) of nodes whose texts are similar. ``pairs`` is read twice."""
    needed = pairs.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    texts = scratch.cut(_texts(needed, signed), "texts")
    u, v = texts.select(F.col("node").alias("u"), F.col("text").alias("s")), texts.select(F.col("node").alias("v"), F.col("text").alias("t"))
    rows = pairs.join(v.hint("merge"), "v").join(u.hint("merge"), "u").select("u", "v", "s", "t")
    return scratch.cut(rows.mapInArrow(_similar, "u long, v long"), "links", instead=texts)


def _may_link(a: str, b: str) -> Column:
    """Whether the sizes of two sets allow a link."""
    x, y = F.col(f"{a}.size"), F.col(f"{b}.size")
    return F.least(x, y) * SIMILAR[1] >= F.greatest(x, y) * SIMILAR[0]


def _alike(signed: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that SimHash links, of sizes that allow a link: nodes with the fingerprint's smallest, and the smallest of linked fingerprints."""
    before = scratch.made()
    prints = scratch.cut(signed.select("node", "size", "fp").dropDuplicates(["node"]), "prints")
    firsts = scratch.cut(prints.groupBy("fp").agg(F.min(F.struct("node", "size")).alias("least")), "firsts")
    a, b = firsts.select(F.col("fp").alias("u"), F.col("least").alias("a")), firsts.select(F.col("fp").alias("v"), F.col("least").alias("b"))
    across = simhash.links(firsts.select("fp")).join(a.hint("merge"), "u").join(b.hint("merge"), "v").select("a", "b")
    within = prints.join(firsts.hint("merge"), "fp").where("node <> least.node").select(F.col("least").alias("a"), F.struct("node", "size").alias("b"))
    pairs = across.unionByName(within).where(_may_link("a", "b")).select(F.least("a.node", "b.node").alias("u"), F.greatest("a.node", "b.node").alias("v"))
    out = scratch.cut(pairs.distinct(), "alike")
    scratch.sweep(signed.sparkSession, before, keep=out)
    return out


def _pairs(members: DataFrame) -> DataFrame:
    """Pairs (u, v) of nodes that share a key, of sizes that allow a link."""
    a, b = members.alias("a"), members.alias("b")
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.node") < F.col("b.node")) & _may_link("a", "b")).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")).distinct()


def _rest(many: DataFrame, root: DataFrame, signed: DataFrame) -> DataFrame:
    """Links (u, v) between different roots among nodes that share a large key: key, node, size and least (of the key)."""
    r = root.select(F.col("node").alias("r_node"), "root")
    rooted = many.join(r, F.col("node") == F.col("r_node"), "left").select("key", "node", "size", "least", F.coalesce("root", "node").alias("root"))
    rooted = scratch.cut(rooted, "rooted")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    left = scratch.cut(rooted.join(mixed.hint("merge"), "key", "left_semi"), "left")
    group = components.roots(left.select(F.col("least").alias("u"), F.col("node").alias("v"))).select("node", F.col("root").alias("group"))
    nodes = left.select("node", "size", "root").distinct().join(group, "node", "left").withColumn("group", F.coalesce("group", "node"))
    blocks = nodes.groupBy("group").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    sets = _texts(nodes.select("node"), signed).mapInArrow(_sketched, "node long, sketch array<long>, set array<long>")
    rows = scratch.cut(nodes.join(blocks.hint("merge"), "group").join(sets.hint("merge"), "node"), "sets")
    a = rows.withColumn("block", F.pmod(F.xxhash64("node"), "blocks")).alias("a")
    b = rows.withColumn("block", F.explode(F.expr("sequence(0L, blocks - 1)"))).alias("b")
    differ = sum((F.bit_count(F.col("a.sketch")[k].bitwiseXOR(F.col("b.sketch")[k])) for k in range(BITS // 64)), F.lit(0))
    common = F.size(F.array_intersect("a.set", "b.set"))
    near = (F.col("a.group") == F.col("b.group")) & (F.col("a.block") == F.col("b.block")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & _may_link("a", "b")
    near &= (differ <= DIFFER) & (SIMILAR[1] * common >= SIMILAR[0] * (F.col("a.size") + F.col("b.size") - common))
    return scratch.cut(a.join(b.hint("merge"), near).select(F.col("a.node").alias("u"), F.col("b.node").alias("v")), "links")


def links(signed: DataFrame, largest: int = CELL) -> DataFrame:
    """Links (u, v) of nodes that connect all that are similar."""
    alike = _alike(signed)
    cells = signed.select("node", "size", "keys").dropDuplicates(["node"]).select("node", "size", F.explode("keys").alias("key"))
    cells = scratch.cut(cells, "cells")
    shared = scratch.cut(cells.groupBy("key").agg(F.count("*").alias("n"), F.min("node").alias("least")).where("n > 1"), "shared")
    members = scratch.cut(cells.join(shared.hint("merge"), "key"), "members", instead=cells)
    many = members.where(F.col("n") > largest)
    star = many.where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    pairs = scratch.cut(_pairs(members.where(F.col("n") <= largest)).unionByName(star).unionByName(alike).distinct(), "pairs")
    found = verified(pairs, signed)
    if not many.limit(1).count():
        return found
    return found.unionByName(_rest(many, components.roots(found), signed))


def grouped(docs: DataFrame, largest: int = CELL) -> DataFrame:
    """doc_id, digest and root (a node, the same for all that links connect), a row for each row of ``docs``."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("digest"))
    signed = scratch.cut(rows.mapInArrow(_rows, "doc_id long, digest long, node long, size long, fp long, keys array<long>, text string"), "signed")
    root = scratch.cut(components.roots(links(signed, largest)), "roots")
    rows = signed.select("doc_id", "digest", "node").join(root, "node", "left").select("doc_id", "digest", F.coalesce("root", "node").alias("root"))
    return scratch.cut(rows, "grouped", instead=signed)


def representatives(docs: DataFrame, largest: int = CELL) -> DataFrame:
    """The rows of ``docs``, with all their columns, one of each group: that with the smallest doc_id (of several, the smallest hash of the text)."""
    return simhash.firsts(docs, grouped(docs, largest))
