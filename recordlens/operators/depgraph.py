"""Dependencies among record operations: edges, cycles, levels and plans.

Operations are (op, type, sobject, temp_id, record_id, data), ``op`` being their
place and ``data`` a map of strings. A value beginning with @ that is another
operation's temp_id makes this one depend on that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import written

SCHEMA = "op long, type string, sobject string, temp_id string, record_id string, data map<string,string>"


#: Operations up to which reachability is closed: at most the square of it in rows.
CLOSED = 2000


class UnbreakableCycle(ValueError):
    """A cycle in which no reference may be left empty at first."""


def references(ops: DataFrame) -> DataFrame:
    """op, sobject, field and value of every value that begins with @."""
    return ops.select("op", "sobject", F.explode("data").alias("field", "value")).where(F.col("value").startswith("@"))


def edges(ops: DataFrame) -> DataFrame:
    """from_op (referred to), to_op (referring), field and sobject (of the latter), for every referring field.

    Of several operations with one temp_id the first counts.
    """
    named = ops.where("temp_id IS NOT NULL").groupBy(F.col("temp_id").alias("value")).agg(F.min("op").alias("from_op"))
    return references(ops).join(named, "value").select("from_op", F.col("op").alias("to_op"), "field", "sobject")


def _peeled(links: DataFrame) -> DataFrame:
    """Links that lie on a cycle or between two: those left when nodes without links in, or without links out, go again and again."""
    now = written(links.select("from_op", "to_op").distinct(), "peel")
    size = now.count()
    while size:
        inner = now.join(now.select(F.col("to_op").alias("from_op")).distinct(), "from_op", "left_semi")
        inner = inner.join(now.select(F.col("from_op").alias("to_op")).distinct(), "to_op", "left_semi")
        now = written(inner.select("from_op", "to_op"), "peel")
        left = now.count()
        if left == size:
            break
        size = left
    return now


def _spread(labels: DataFrame, links: DataFrame) -> DataFrame:
    """op and label: the least label of all operations (op, label) from which links lead there, its own included.

    Only operations whose label became less hand it on, so a round costs what changed; rows are never more than the operations.
    """
    now = written(labels.select("op", "label", F.lit(True).alias("changed")), "labels")
    while now.where("changed").limit(1).count():
        offered = now.where("changed").join(links, F.col("op") == F.col("from_op")).groupBy(F.col("to_op").alias("op")).agg(F.min("label").alias("offer"))
        less = F.coalesce(F.col("offer") < F.col("label"), F.lit(False))
        now = written(now.join(offered, "op", "left").select("op", F.when(less, F.col("offer")).otherwise(F.col("label")).alias("label"), less.alias("changed")), "labels")
    return now.select("op", "label")


def _closed(rest: DataFrame) -> DataFrame:
    """op and cycle, by paths that double in length: few rounds, but a row for each pair of operations that one leads to the other."""
    reach, size = rest, rest.count()
    while size:
        more = reach.alias("a").join(reach.alias("b"), F.col("a.to_op") == F.col("b.from_op")).select("a.from_op", "b.to_op")
        reach = written(reach.unionByName(more).distinct(), "reach")
        now = reach.count()
        if now == size:
            break
        size = now
    mutual = reach.alias("a").join(reach.alias("b"), (F.col("a.from_op") == F.col("b.to_op")) & (F.col("a.to_op") == F.col("b.from_op")))
    return mutual.select(F.col("a.from_op").alias("op"), F.col("a.to_op").alias("other")).groupBy("op").agg(F.min("other").alias("cycle"))


def _colored(rest: DataFrame) -> DataFrame:
    """op and cycle, by labels: no more rows than operations and links, but a round for each step of the longest way.

    Every operation takes the least operation that leads to it. Those with one label that lead
    back to it are its component; no cycle has two labels, so the rest goes on without them and without links between labels.
    """
    found = rest.where("false").select(F.col("from_op").alias("op"), F.col("from_op").alias("cycle"))
    while rest.limit(1).count():
        nodes = rest.select(F.col("from_op").alias("op")).union(rest.select("to_op")).distinct()
        colors = _spread(nodes.withColumn("label", F.col("op")), rest)
        a, b = colors.select(F.col("op").alias("from_op"), "label"), colors.select(F.col("op").alias("to_op"), F.col("label").alias("other"))
        inner = written(rest.join(a, "from_op").join(b, "to_op").where("label = other").select("from_op", "to_op"), "inner")
        away = colors.select("op", F.when(F.col("op") == F.col("label"), 0).otherwise(1).alias("label"))
        back = _spread(away, inner.select(F.col("to_op").alias("from_op"), F.col("from_op").alias("to_op"))).where("label = 0").select("op")
        settled = written(back.join(colors.withColumnRenamed("label", "cycle"), "op"), "settled")
        # A node between cycles may settle alone; it is on a cycle only if it refers to itself.
        loops = inner.where("from_op = to_op").select(F.col("from_op").alias("op")).distinct().withColumn("loop", F.lit(True))
        large = settled.groupBy("cycle").agg(F.count("*").alias("n"))
        found = found.unionByName(settled.join(large, "cycle").join(loops, "op", "left").where("n > 1 OR loop").select("op", "cycle"))
        gone = settled.select("op")
        left = inner.join(gone.withColumnRenamed("op", "from_op"), "from_op", "left_anti").join(gone.withColumnRenamed("op", "to_op"), "to_op", "left_anti")
        rest = _peeled(left)
    return found


def cycles(links: DataFrame, closed: int = CLOSED) -> DataFrame:
    """op and cycle (its smallest member) of all operations on a cycle: the strongly connected components of more than one node, and loops.

    Both ways are exact. Reachability is closed where what peeling leaves has at most ``closed`` operations, so that its square
    bounds the rows; beyond it labels are spread.
    """
    rest = _peeled(links)
    n = rest.select("from_op").distinct().count()  # peeling leaves every operation a link out
    return _closed(rest) if n <= closed else _colored(rest)


def break_points(links: DataFrame, relationships: DataFrame) -> DataFrame:
    """One link of each cycle that may be empty at first: cycle, from_op, to_op, field, strategy.

    ``relationships`` has from_sobject, field_name and is_required; links of unknown fields are not broken.
    """
    on = cycles(links)
    inside = links.join(on.select(F.col("op").alias("to_op"), "cycle"), "to_op").join(on.select(F.col("op").alias("from_op"), F.col("cycle").alias("other")), "from_op").where("cycle = other")
    free = inside.join(relationships.where("NOT is_required").select(F.col("from_sobject").alias("sobject"), F.col("field_name").alias("field")).distinct(), ["sobject", "field"])
    first = free.groupBy("cycle").agg(F.min(F.struct("to_op", "field", "from_op")).alias("b"))
    return first.select("cycle", "b.from_op", "b.to_op", "b.field", F.lit("create-then-update").alias("strategy"))


def levels(ops: DataFrame, links: DataFrame) -> DataFrame:
    """op and level: the length of the longest path that leads there. ``links`` must have no cycle."""
    links = written(links.select("from_op", "to_op").distinct(), "links")
    start = ops.select("op").join(links.select(F.col("to_op").alias("op")), "op", "left_anti").withColumn("level", F.lit(0))
    done = front = written(start, "levels")
    step, most = 0, ops.count()
    while front.limit(1).count():
        step += 1
        if step > most:
            raise UnbreakableCycle("the operations depend on each other in a cycle")
        # Whatever is reached again gets the later level; paths of one length are one row.
        front = written(front.join(links, front["op"] == links["from_op"]).select(F.col("to_op").alias("op")).distinct().withColumn("level", F.lit(step)), "levels")
        done = done.unionByName(front)
    return done.groupBy("op").agg(F.max("level").alias("level"))


def resolve(ops: DataFrame, relationships: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The levels of all operations, and the break points: links left empty at first, to be set by updates afterwards.

    Each round breaks one link of every cycle; a cycle without a link to break is an error.
    """
    links, broken = edges(ops), None
    while on_cycle := cycles(links).agg(F.countDistinct("cycle")).first()[0]:
        if relationships is None:
            raise UnbreakableCycle(f"{on_cycle} cycle(s) and no relationships to tell which may be broken")
        points = written(break_points(links, relationships), "breaks")
        if points.count() < on_cycle:
            raise UnbreakableCycle(f"{on_cycle - points.count()} cycle(s) without a reference that may be empty")
        links = written(links.join(points.select("from_op", "to_op", "field"), ["from_op", "to_op", "field"], "left_anti").select("from_op", "to_op", "field", "sobject"), "links")
        broken = points if broken is None else broken.unionByName(points)
    if broken is None:
        broken = ops.sparkSession.createDataFrame([], "cycle long, from_op long, to_op long, field string, strategy string")
    return levels(ops, links), broken


def plan(ops: DataFrame, op_levels: DataFrame) -> DataFrame:
    """level, n, node_ids (op_0, op_1, ... in order) and can_parallelize of every level."""
    ids = F.transform(F.array_sort(F.collect_list("op")), lambda k: F.concat(F.lit("op_"), k.cast("string")))
    return ops.join(op_levels, "op").groupBy("level").agg(F.count("*").alias("n"), ids.alias("node_ids")).withColumn("can_parallelize", F.col("n") > 1)


def resolved_data(ops: DataFrame, ids: DataFrame) -> DataFrame:
    """op, data with references replaced by ids (temp_id, record_id), and errors (references that no id is known for)."""
    known = ids.select(F.col("temp_id").alias("value"), F.col("record_id").alias("real"))
    found = references(ops).join(known, "value", "left")
    by_op = found.groupBy("op").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("real").isNotNull(), F.struct("field", "real")))).alias("set"),
        F.array_sort(F.collect_list(F.when(F.col("real").isNull(), F.concat(F.lit("Cannot resolve reference "), "value", F.lit(" in "), "field")))).alias("errors"),
    )
    rows = ops.join(by_op, "op", "left")
    data = F.when(F.col("set").isNull(), F.col("data")).otherwise(F.transform_values("data", lambda k, v: F.coalesce(F.col("set")[k], v)))
    return rows.select("op", data.alias("data"), F.coalesce("errors", F.array().cast("array<string>")).alias("errors"))
