"""Repeated runs of lines, found by winnowing over line hashes, deleted but for their first occurrence.

A gram starts at every line with words and is the least run of such lines that
has ``GRAM`` words; its hash is that of its lines' hashes. In the window of grams
that start within ``RUN - GRAM`` words of a line, the least gram hash is
selected, a fingerprint. A run of ``RUN`` or more words, wherever it occurs,
holds the whole window of its first line, so its occurrences share a selected
fingerprint; no selected gram has fewer than ``GRAM`` words, so nothing
shorter is matched.

Every selected gram that occurs more than once gets a key for itself, one for
itself with each number of lines after it, and one with each number of lines
before it. The first occurrence of a key (the smallest doc_id, then position) is a
pre-aggregated minimum: no pairs of a group are made. A line is repeated if the key
that ends with it occurred before, wherever that was, so a run is matched both ways as far as any
earlier text agrees with it, even if different parts of it occurred first in
different documents. Neighbouring fingerprints of a run are nearer than a gram is
long, so grams cover its inside. Before the first of them the run has at most ``RUN - GRAM`` words and
after the last fewer than ``RUN``; extensions go that far, and reach its ends.
All lines of a later occurrence are then deleted.

Only DataFrame functions are used. Defined cases: a null text stays null and has
no lines; lines without words are never matched and stay; lines are compared
without spaces at their ends; rows equal in doc_id and text are one document and
get the same result; rows without doc_id come last in order; an empty table gives
an empty result; all columns of ``docs`` are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Words of a run that is found wherever it repeats.
RUN = 50
#: Words of the shortest run that can match.
GRAM = 40
WORD = r"[^\x20\x09-\x0D]+"
EDGES = r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$"


def _keys() -> list[Column]:
    """Two longs that name a document by doc_id and text."""
    return [F.xxhash64("doc_id", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc_id").alias("b")]


def lines(docs: DataFrame) -> DataFrame:
    """a, b, doc_id, line (its number), h (its hash) and w (its words) of all lines with words."""
    each = docs.where("text IS NOT NULL").select(*_keys(), F.col("doc_id").cast("long").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("line", "content"))
    each = each.select("a", "b", "doc_id", "line", F.xxhash64(F.regexp_replace("content", EDGES, "")).alias("h"), F.regexp_count("content", F.lit(WORD)).cast("long").alias("w"))
    return each.where("w > 0")


def fingerprints(each: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """The selected grams: a, b, doc_id, at (their first line), g (hash), own (their lines) and, as arrays of (line, h), what is near before and after."""
    slack = run - gram
    # Rows equal in doc_id and text give each line several times; it is kept once.
    each = each.repartition("a", "b").dropDuplicates(["a", "b", "line"])
    doc = Window.partitionBy("a", "b")
    so_far = doc.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    each = each.withColumn("end", F.sum("w").over(so_far)).withColumn("start", F.col("end") - F.col("w"))
    item = F.struct("line", "h")
    after = doc.orderBy("end").rangeBetween(1, run)
    each = each.withColumn("after", F.collect_list(item).over(after))
    by_start = doc.orderBy("start")
    grams = by_start.rangeBetween(0, gram - 1)
    each = each.withColumns(
        {
            "before": F.collect_list(item).over(by_start.rangeBetween(-slack, -1)),
            "own": F.collect_list(F.struct("line", "h")).over(grams),
            "n": F.sum("w").over(grams),
            "next": F.last("after").over(grams),
        }
    )
    each = each.withColumn("g", F.when(F.col("n") >= gram, F.xxhash64(F.transform("own", lambda x: x["h"]))))
    each = each.withColumn("least", F.min("g").over(by_start.rangeBetween(0, slack)))
    each = each.withColumn("chosen", F.max("least").over(by_start.rangeBetween(-slack, 0)))
    return each.where(F.col("g") == F.col("chosen")).select("a", "b", "doc_id", F.col("line").alias("at"), "g", F.transform("own", lambda x: x["line"]).alias("own"), "before", F.col("next").alias("after"))


def _extended(items: Column, side: str) -> Column:
    """Of lines (line, h) next to a gram, nearest first: a key (and its last line) for every number of them."""
    hashes = F.transform(items, lambda x: x["h"])
    return F.transform(items, lambda x, k: F.struct(F.xxhash64("g", F.lit(side), F.slice(hashes, 1, k + 1)).alias("key"), F.array(x["line"]).alias("lines")))


def repeats(grams: DataFrame) -> DataFrame:
    """a, b and the numbers of the lines to delete, of every document that repeats what came before. ``grams`` is read twice."""
    often = grams.groupBy("g").agg(F.count("*").alias("n")).where("n > 1").select("g")
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "a", "b", "at")
    itself = F.array(F.struct(F.col("g").alias("key"), F.col("own").alias("lines")))
    keys = F.concat(itself, _extended(F.col("after"), "after"), _extended(F.reverse("before"), "before"))
    each = scratch.cut(grams.join(often, "g").select(place.alias("place"), F.explode(keys).alias("x")).select("place", "x.key", "x.lines"), "keys")
    firsts = each.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = each.join(firsts, "key").where(F.col("place") != F.col("first"))
    return later.groupBy("place.a", "place.b").agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("gone"))


def _judged(docs: DataFrame, run: int, gram: int) -> tuple[DataFrame, Column]:
    """``row`` (all columns of ``docs``) and ``gone``, the lines to delete or null; and the text without them."""
    found = scratch.cut(fingerprints(lines(docs), run, gram), "grams")
    gone = scratch.cut(repeats(found), "repeats")
    a, b = _keys()
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), a, b)
    rows = rows.join(gone.hint("shuffle_hash"), ["a", "b"], "left").select("row", "gone")
    split = F.split(F.col("row.text"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    left = F.array_join(F.transform(kept, lambda k: F.get(split, k)), "\n")
    return rows, F.when(F.col("gone").isNull(), F.col("row.text")).otherwise(left)


def dedup(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """All columns of ``docs`` with later repeated runs of lines deleted from ``text``, and n_deleted_lines (in place of a column of that name).

    Fingerprints are computed once, into a written table.
    """
    rows, text = _judged(docs, run, gram)
    names = [c for c in docs.columns if c.lower() != "n_deleted_lines"]
    return rows.select(*[text.alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in names], F.coalesce(F.size("gone"), F.lit(0)).alias("n_deleted_lines"))


def deduplicated(docs: DataFrame, run: int = RUN, gram: int = GRAM) -> DataFrame:
    """``docs`` with its own columns, the runs deleted and ``n_chars``, where there is such a column, made anew."""
    rows, text = _judged(docs, run, gram)
    made = {"text": text, "n_chars": F.length(text).cast("long")}
    return rows.select(*[made.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
