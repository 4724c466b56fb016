"""Mixing sources to target weights, in blocks of words.

The texts of a source, one after another, are a stream of words cut into blocks
of ``BLOCK`` words; the last, shorter block is its tail. Every source gets a
target number of words. Output shards of ``SHARD`` slots draw how many blocks
they take from each source: multinomial counts, under the condition that those of all
shards add up to the targets. Such counts are dealt by one permutation of all
slots that the targets come to. A source's slots, numbered through the shards, are mapped through a
pseudorandom permutation of its blocks, a new one for each pass over the source;
its tail ends each pass. Slots then meet the blocks in an equi-join on source and
block number. The last slot of a source takes only the words still due, so what
is taken from a source is its target to the word, and no pass takes a word twice.

Word places in a stream are sums over salted parts of a source, each part a
window of bounded size, so a source with most of the rows is no single task.

Defined cases: a null text has no words; a null source is a source of its own,
the last in order; repeated rows each count; a source without words has target 0;
an empty table gives an empty result; columns other than ``doc_id``, ``text`` and
``source`` are ignored. Nothing depends on partitioning, so reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from . import scratch

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in order, repeating.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times its source's size.
REPEATS = 3
BLOCK = 256
SHARD = 1024
SEED = 77
#: Rows of a source's part whose word places one window sums.
PART_ROWS = 100_000
#: Parts of a source at least.
PARTS = 256
#: Slots that a task makes, about, once there are more than the usual number of tasks would make.
TASK_SLOTS = 1_000_000
#: Slots that one row is expanded into.
CHUNK = 1024
#: Shards of a stretch: what a source gives to earlier shards is summed within stretches, then over them.
STRETCH = 4096
#: Sources up to which their table is sent to every executor (under 10 MB); more are joined by shuffle.
BROADCAST_SOURCES = 50_000


def permuted(x: Column, n: Column, *key: Column, rounds: int = 24) -> Column:
    """Where a keyed pseudorandom permutation of 0..n-1 puts x: a swap-or-not shuffle.

    In every round x is paired with a keyed partner, and one hash of the pair tells whether they swap.
    """

    def turn(now: Column, k: Column) -> Column:
        partner = F.pmod(F.pmod(F.xxhash64(*key, k), n) - now, n)
        swap = F.xxhash64(*key, k, F.greatest(now, partner), F.lit("swap")).bitwiseAND(F.lit(1).cast("long")) == 1
        return F.when(swap, partner).otherwise(now)

    return F.aggregate(F.array(*[F.lit(k) for k in range(rounds)]), x.cast("long"), turn)


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """For (source, source_size): sid (from 0, sources by code point, null last), weight and target.

    Weights share the total; a target above ``repeats`` times its source's size
    stops there and the excess goes to the others by weight, until none is above.
    That comes to min(weight x level, cap) with one level for all: among sources
    by cap per weight, the level is what remains of the total after the caps of
    those before, per remaining weight, at the first source whose cap it doesn't exceed.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    ranked = sizes.withColumn("sid", F.row_number().over(order) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("sid"), F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("cap", F.lit(float(repeats)) * F.col("source_size"))
    fill = Window.orderBy(F.col("cap") / F.col("weight"), "sid")
    whole = Window.partitionBy()
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    heavy = F.sum("weight").over(fill.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    ranked = ranked.withColumn("level", left / heavy).withColumn("k", F.row_number().over(fill))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("k"))
    level = F.coalesce(F.min_by("level", fits).over(whole), F.lit(float("inf")))
    return ranked.select("source", "source_size", "sid", "weight", F.least(F.col("weight") * level, F.col("cap")).alias("target"))


def sources(items: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The targets with what the draws need: due words, full blocks of a pass, tail words, slots, and the slots of sources before."""
    t = targets(items.groupBy("source").agg(F.sum("size").alias("source_size")), weights)
    t = t.withColumn("due", F.round("target").cast("long"))
    t = t.withColumn("blocks", F.expr(f"source_size div {block}")).withColumn("tail", F.col("source_size") % block)
    a_pass = F.col("blocks") + F.when(F.col("tail") > 0, 1).otherwise(0)
    t = t.withColumn("a_pass", a_pass)
    size = F.greatest("source_size", F.lit(1))
    t = t.withColumn("passes", F.expr("due div greatest(source_size, 1)")).withColumn("rest", F.col("due") % size)
    t = t.withColumn("slots", F.col("passes") * F.col("a_pass") + F.expr(f"(rest + {block - 1}) div {block}"))
    return t.withColumn("slots_before", F.sum("slots").over(Window.orderBy("sid")) - F.col("slots")).withColumn("all_slots", F.sum("slots").over(Window.partitionBy()))


def _tasks(table: DataFrame) -> int:
    """Over how many tasks slots are made: few rows expand into many, so their number must not follow the size of those rows."""
    slots = table.agg(F.max("all_slots")).first()[0] or 0
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), slots // TASK_SLOTS)


def draws(table: DataFrame, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """How many blocks each output shard takes from each source: (shard, sid, n).

    All slots are dealt over the shards by one permutation, which is the draw without replacement.
    """
    chunks = table.where("slots > 0").select("sid", "slots", "slots_before", "all_slots", F.explode(F.expr(f"sequence(0L, (slots - 1) div {CHUNK})")).alias("chunk"))
    chunks = chunks.repartition(_tasks(table), "sid", "chunk")
    slots = chunks.select("sid", "slots_before", "all_slots", F.explode(F.expr(f"sequence(chunk * {CHUNK}, least(chunk * {CHUNK} + {CHUNK - 1}, slots - 1))")).alias("k"))
    place = permuted(F.col("slots_before") + F.col("k"), F.col("all_slots"), F.lit(seed), F.lit("deal"))
    return slots.select("sid", place.alias("place")).withColumn("shard", F.expr(f"place div {shard}")).groupBy("shard", "sid").agg(F.count("*").alias("n"))


def _numbered(counts: DataFrame) -> DataFrame:
    """The draws with ``first``, how many blocks earlier shards take from the source: summed in stretches of shards, so that no source is one task's."""
    counts = counts.withColumn("stretch", F.expr(f"shard div {STRETCH}"))
    stretches = counts.groupBy("sid", "stretch").agg(F.sum("n").alias("n"))
    before = stretches.select("sid", "stretch", (F.sum("n").over(Window.partitionBy("sid").orderBy("stretch")) - F.col("n")).alias("before"))
    here = F.sum("n").over(Window.partitionBy("sid", "stretch").orderBy("shard")) - F.col("n")
    return counts.withColumn("here", here).join(before, ["sid", "stretch"]).select("shard", "sid", "n", (F.col("before") + F.col("here")).alias("first"))


def mixture(table: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED) -> DataFrame:
    """The slots of the mix: shard, sid, slot (through all shards), pass, block and words (how many the slot takes from its block's start)."""
    counts = _numbered(draws(table, shard, seed))
    t = table.select("sid", "blocks", "tail", "a_pass", "passes", "rest", "slots")
    slots = counts.join(t, "sid").repartition(_tasks(table), "sid", "shard").withColumn("slot", F.explode(F.expr("sequence(first, first + n - 1)")))
    slots = slots.withColumn("pass", F.expr("slot div a_pass")).withColumn("at", F.col("slot") % F.col("a_pass"))
    number = F.when(F.col("at") < F.col("blocks"), permuted(F.col("at"), F.greatest("blocks", F.lit(1)), F.lit(seed), F.col("sid"), F.col("pass"))).otherwise(F.col("blocks"))
    full = F.when(F.col("at") < F.col("blocks"), F.lit(block)).otherwise(F.col("tail"))
    taken = F.when((F.col("pass") == F.col("passes")), F.least(full, F.col("rest") - F.col("at") * block)).otherwise(full)
    return slots.select("shard", "sid", "slot", "pass", number.alias("block"), taken.cast("long").alias("words"))


def placed(items: DataFrame, table: DataFrame, n_rows: int, n_sources: int) -> DataFrame:
    """The items with sid, source_size, target, and ``place``: where their words begin in their source's stream."""
    parts = max(PARTS, -(-n_rows // PART_ROWS))
    items = items.withColumn("part", F.pmod(F.xxhash64("doc_id", "digest"), F.lit(parts)))
    starts = items.groupBy("source", "part").agg(F.sum("size").alias("part_size"))
    starts = starts.withColumn("part_place", F.sum("part_size").over(Window.partitionBy("source").orderBy("part")) - F.col("part_size"))
    here = Window.partitionBy("source", "part").orderBy("doc_id", "digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = items.withColumn("upto", F.sum("size").over(here)).alias("i")
    s = starts.alias("s")
    rows = rows.join(s, F.col("i.source").eqNullSafe(F.col("s.source")) & (F.col("i.part") == F.col("s.part"))).select("i.*", (F.col("s.part_place") + F.col("upto") - F.col("size")).alias("place"))
    t = table.select(F.col("source").alias("t_source"), "sid", "source_size", "target")
    t = F.broadcast(t) if n_sources <= BROADCAST_SOURCES else t
    return rows.join(t, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source", "upto", "part")


def uses(places: DataFrame, slots: DataFrame, block: int = BLOCK) -> DataFrame:
    """Which words of which document each slot takes: sid, place (of the document), size, shard, slot, pass, start and n (words of the document)."""
    some = places.where("size > 0").select("sid", "place", "size", F.explode(F.expr(f"sequence(place div {block}, (place + size - 1) div {block})")).alias("block"))
    lo = F.greatest(F.col("place"), F.col("block") * block)
    hi = F.least(F.col("place") + F.col("size"), F.col("block") * block + F.col("words"))
    return slots.join(some, ["sid", "block"]).withColumn("n", hi - lo).where("n > 0").select("sid", "place", "size", "shard", "slot", "pass", (lo - F.col("place")).alias("start"), "n")


def prepared(docs: DataFrame, block: int = BLOCK, weights: Sequence[int] = WEIGHTS) -> tuple[DataFrame, DataFrame]:
    """The placed items and the sources' table, both written."""
    items = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), words(F.col("text")).alias("size"), F.xxhash64("text").alias("digest"))
    items = scratch.cut(items, "items")
    table = scratch.cut(sources(items, block, weights), "sources")
    return scratch.cut(placed(items, table, items.count(), table.count()), "places"), table


def mix(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """doc_id, source, size, source_size, target and taken (words that the mix takes of the document, repeats counted), a row for each row of ``docs``."""
    places, table = prepared(docs, block, weights)
    taken = uses(places, mixture(table, block, shard, seed), block).groupBy("sid", "place").agg(F.sum("n").alias("taken"))
    rows = places.alias("p").join(taken.alias("t"), (F.col("p.sid") == F.col("t.sid")) & (F.col("p.place") == F.col("t.place")) & (F.col("p.size") > 0), "left")
    return rows.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, block: int = BLOCK, shard: int = SHARD, seed: int = SEED, weights: Sequence[int] = WEIGHTS) -> DataFrame:
    """The mix as documents with the columns of ``docs``: one row for each document and pass that takes words of it.

    A pass that takes a document whole returns its text as it is; else the words
    that the pass takes, in their order, joined by spaces. ``n_chars`` is made
    anew where there is such a column. Documents without words are not taken. Rows
    equal in doc_id, source and text have a place each, and each takes what its own place takes.
    """
    places, table = prepared(docs, block, weights)
    parts = uses(places, mixture(table, block, shard, seed), block).groupBy("sid", "place", "pass").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("start", "n"))).alias("parts"))
    passes = places.where("size > 0").join(parts, ["sid", "place"]).select("doc_id", "source", "digest", "place", "size", "n", "parts")
    by_doc = passes.groupBy("doc_id", "source", "digest", "size", "place").agg(F.collect_list(F.struct("n", "parts")).alias("passes"))  # a few
    same = ["doc_id", "source", "digest"]
    if not places.where("size > 0").groupBy(*same).count().where("count > 1").limit(1).count():
        return _written(docs, by_doc.withColumn("nth", F.lit(1)), F.lit(1))
    numbers = places.where("size > 0").select(*same, "place", F.row_number().over(Window.partitionBy(*same).orderBy("place")).alias("nth"))
    s = numbers.select(F.col("source").alias("n_source"), F.col("place").alias("n_place"), "nth")
    by_doc = by_doc.join(s, F.col("source").eqNullSafe(F.col("n_source")) & (F.col("place") == F.col("n_place")))
    others = [F.col(f"`{f.name}`") for f in docs.schema if not isinstance(f.dataType, (MapType, VariantType))]
    here = Window.partitionBy(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text")).orderBy(F.xxhash64(*others))
    return _written(docs, by_doc, F.row_number().over(here))


def _written(docs: DataFrame, by_doc: DataFrame, nth: Column) -> DataFrame:
    names = docs.columns
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.xxhash64("text").alias("digest"), nth.alias("nth")).alias("d")
    b = by_doc.alias("b")
    same = F.col("d.row.doc_id").cast("long").eqNullSafe(F.col("b.doc_id")) & F.col("d.row.source").cast("string").eqNullSafe(F.col("b.source")) & (F.col("d.digest") == F.col("b.digest")) & (F.col("d.nth") == F.col("b.nth"))
    rows = d.join(b.hint("shuffle_hash"), same).select("row", F.explode("b.passes").alias("taken"), F.col("b.size").alias("size"))
    tokens = F.regexp_extract_all(F.col("row.text"), F.lit(f"({WORD})"), F.lit(1))
    cut = F.array_join(F.flatten(F.transform("taken.parts", lambda p: F.slice(tokens, (p["start"] + 1).cast("int"), p["n"].cast("int")))), " ")
    text = F.when(F.col("taken.n") == F.col("size"), F.col("row.text")).otherwise(cut)
    rows = rows.withColumn("new_text", text)
    made = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in names])
