"""Matching of probes against records, for whole tables at once.

Candidates come from five strategies, in this order:

exact       the field equals the term, ignoring case
prefix      the field begins with the term
wildcard    the field contains the term
fuzzy       the composite similarity of the normalized texts is above 0.6
normalized  the lower-cased field equals the normalized term, where that differs from the lower-cased term

All of them are equi-joins. A field that contains a term holds the term's first
characters (up to three) somewhere, so containment joins on these; and with
the default weights two different texts without a common trigram score below 0.6,
so fuzzy candidates join on trigrams and lose nothing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
import dataclasses
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normalize as N
from ..functions import similarity as S
from ..sources.tables import written

STRATEGIES = ("exact", "prefix", "wildcard", "fuzzy", "normalized")
HIGH, MEDIUM = 0.95, 0.75
LEVELS = {"LOW": 1, "MEDIUM": 2, "HIGH": 3}
FUZZY = 0.6
BOOST = 0.05
KEY = 3
#: By how much blocks of texts grow, texts of a block up to which all are met, and pairs that a task then meets.
GROWTH = 4
CROSSED = 128
PAIRS = 20_000
#: What is known of a fuzzy candidate.
FOUND = "struct<score: double, pair: bigint>"


@dataclass(frozen=True)
class Search:
    """What to match on. ``per_strategy`` candidates of each strategy at most, by smallest id (None: all)."""

    field: str = "Name"
    limit: int | None = 10
    per_strategy: int | None = 20
    min_confidence: str | None = None
    weights: Mapping[str, float] = dataclasses.field(default_factory=dict)


def search_key(term: str) -> str:
    """A term with the characters that search languages reserve escaped, trimmed."""
    return "".join("\\" + c if c in "?&|!{}[]()^~*:\\\"'+-" else c for c in term).strip()


def escaped(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"""([?&|!{}\[\]()^~*:\\"'+\-])""", r"\\$1"))


def confidence(score: Column) -> Column:
    return F.when(score >= HIGH, "HIGH").when(score >= MEDIUM, "MEDIUM").otherwise("LOW")


def level(confidence: Column) -> Column:
    return F.when(confidence == "HIGH", 3).when(confidence == "MEDIUM", 2).otherwise(1)


def boosted(score: Column, strategies: Column) -> Column:
    """Each strategy beyond the first adds 0.05, up to 1."""
    n = F.size(strategies)
    return F.when(n > 1, F.least(F.lit(1.0), score + BOOST * (n - 1))).otherwise(score)


def summary(confidence: Column, score: Column, strategies: Column) -> Column:
    return F.concat(confidence, F.lit(" confidence ("), F.format_string("%.1f", F.round(score * 100, 1)), F.lit("%) - Matched by: "), F.array_join(strategies, ", "))


def _records(records: DataFrame, id_column: str, name_column: str, options: N.Options) -> DataFrame:
    name = F.coalesce(F.col(name_column).cast("string"), F.lit(""))
    return records.select(F.col(id_column).alias("id"), name.alias("name")).withColumns({"low": F.lower("name"), "norm": N.normalize(F.col("name"), options)})


def _probes(probes: DataFrame, id_column: str, term_column: str, options: N.Options) -> DataFrame:
    term = F.coalesce(F.col(term_column).cast("string"), F.lit(""))
    out = probes.select(F.col(id_column).alias("query_id"), term.alias("term")).withColumns({"term_low": F.lower("term"), "term_norm": N.normalize(F.col("term"), options)})
    return out.where("trim(term) <> ''")


def _here(value: Column) -> Column:
    """The value, computed once and where it stands.

    A column that depends on the task is neither pushed below joins and aggregations, where it
    would be computed for every shared trigram, nor repeated in the expressions that use it. The value does not change.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def _pieces(text: Column) -> Column:
    """All distinct pieces of up to ``KEY`` characters."""

    def of(size: int) -> Column:
        starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))

    return F.array_distinct(F.flatten(F.array(*map(of, range(1, KEY + 1)))))


def _strategy(df: DataFrame, name: str) -> DataFrame:
    further = ["fuzzy"] if name == "fuzzy" else []
    return df.select("query_id", "id", F.lit(STRATEGIES.index(name)).alias("strategy"), *further)


def _fewest(records: DataFrame, text: str, most: int | None) -> DataFrame:
    """Of the records with one text the ``most`` of smallest id: no strategy tells such records apart, so it takes no others."""
    if most is None:
        return records
    return records.withColumn("nth", F.row_number().over(Window.partitionBy(text).orderBy(F.asc_nulls_last("id")))).where(F.col("nth") <= most).drop("nth")


def contained(probes: DataFrame, records: DataFrame) -> DataFrame:
    """Pairs in which the record's lower-cased name contains the term, with both texts."""
    r = records.select("id", "low", F.explode(_pieces(F.col("low"))).alias("key"))
    p = probes.select("query_id", "term_low", F.substring("term_low", 1, KEY).alias("key"))
    return p.join(r, "key").where(F.col("low").contains(F.col("term_low")))


def _met(p: DataFrame, r: DataFrame) -> DataFrame:
    """Pairs of texts with a common trigram and the number of those, by a join on trigrams."""
    a = p.select("term_norm", F.size("p_grams").alias("m"), F.explode("p_grams").alias("gram"))
    b = r.select("norm", F.size("r_grams").alias("n"), F.explode("r_grams").alias("gram"))
    return a.join(b, "gram").groupBy("term_norm", "norm", "m", "n").agg(F.count("*").alias("shared"))


def _crossed(p: DataFrame, r: DataFrame) -> DataFrame:
    """The same with a few texts ``r``, by meeting all."""
    shared = F.size(F.array_intersect("p_grams", "r_grams"))
    pairs = p.crossJoin(F.broadcast(r)).select("term_norm", "norm", F.size("p_grams").alias("m"), F.size("r_grams").alias("n"), _here(shared).alias("shared"))
    return pairs.where("shared > 0")


def _near(pairs: DataFrame, above: float, weights: Mapping[str, float] | None, tasks: int | None) -> DataFrame:
    """Pairs whose composite is above the bound, with their score and hash; dealt to ``tasks`` before they are scored, if given.

    Shared trigrams are known; with the similarity of edits, which is cheap, they bound the composite from above, and only
    pairs above the bound are scored in full.
    """
    w = {k: max(0.0, v) for k, v in {**S.WEIGHTS, **(weights or {})}.items()}
    most = w["levenshtein"] * S.levenshtein_similarity(F.col("term_norm"), F.col("norm")) + w["jaro_winkler"] + w["trigram"] * 2 * F.col("shared") / (F.col("m") + F.col("n")) + w["soundex"]
    pairs = pairs.where(_here(most > above - 1e-9)).select("term_norm", "norm")
    if tasks is not None:
        pairs = pairs.repartition(tasks, "term_norm", "norm")
    near = pairs.withColumn("score", _here(S.composite_score(F.col("term_norm"), F.col("norm"), weights))).where(F.col("score") > above)
    return near.select("term_norm", "norm", F.struct("score", F.xxhash64("term_norm", "norm").alias("pair")).alias("fuzzy"))


def _first_near(p: DataFrame, records: DataFrame, above: float, weights: Mapping[str, float] | None, most: int) -> DataFrame:
    """term_norm, id and fuzzy: of the records near to a text those ``most`` that have the smallest ids.

    Distinct texts of records are met in the order of their smallest ids, in blocks that grow. A text that has ``most`` records
    with ids below those of all blocks to come is done, since nothing later can come before these; all others go on, to the last block if need be.
    """
    spark = records.sparkSession
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = _fewest(records.where("norm <> '' AND id IS NOT NULL"), "norm", most).groupBy("norm").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    texts = texts.select("norm", "ids", F.col("ids")[0].alias("first"), S.trigrams(F.col("norm")).alias("r_grams"))
    texts = written(texts.repartitionByRange("first").sortWithinPartitions("first").withColumn("at", F.monotonically_increasing_id()), "texts")
    # ``at`` is the number of the part, then a text's place in it: what a place in the whole order is there.
    sizes = sorted((r["part"], r["n"]) for r in texts.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n")).collect())
    total = sum(n for _, n in sizes)

    def place(k: int) -> int:
        for part, n in sizes:
            if k < n:
                return (part << 33) + k
            k -= n
        return 1 << 62

    todo = written(p, "todo")
    found, low, size, left = [], 0, most + most // 4 + 1, todo.count()
    while left and low < total:
        high = total if total - low <= GROWTH * size else low + size
        block = texts.where((F.col("at") >= place(low)) & (F.col("at") < place(high)))
        if high - low <= CROSSED:
            near = _near(_crossed(todo.repartition(max(usual, left * (high - low) // PAIRS)), block), above, weights, None)
        else:
            near = _near(_met(todo, block), above, weights, usual)
        found.append(written(near.join(block.select("norm", "ids"), "norm").select("term_norm", "ids", "fuzzy"), "near"))
        if high < total:
            after = F.broadcast(texts.where(F.col("at") == place(high)).select(F.col("first").alias("after")))
            every = reduce(DataFrame.unionByName, found).crossJoin(after)
            done = every.groupBy("term_norm").agg(F.sum(F.size(F.filter("ids", lambda x: x < F.col("after")))).alias("n")).where(F.col("n") >= most)
            todo = written(todo.join(done, "term_norm", "left_anti"), "todo")
            left = todo.count()
        low, size = high, size * GROWTH
    if not found:
        return p.crossJoin(records.select("id").limit(0)).select("term_norm", "id", F.lit(None).cast(FOUND).alias("fuzzy"))
    rows = reduce(DataFrame.unionByName, found).select("term_norm", F.explode("ids").alias("id"), "fuzzy")
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy("term_norm").orderBy("id"))).where(F.col("nth") <= most).drop("nth")


def fuzzy(probes: DataFrame, records: DataFrame, above: float = FUZZY, weights: Mapping[str, float] | None = None, most: int | None = None) -> DataFrame:
    """Pairs (query_id, id) whose normalized texts have a composite similarity above a bound, which must be 0.6 or more, and fuzzy: that score, and a hash of both texts.

    Distinct texts are paired, each once, whatever number of rows has them. With ``most`` each probe has the so many
    records of smallest id, and texts are paired only until these are known.
    """
    p = probes.where("term_norm <> ''").select("term_norm").distinct().withColumn("p_grams", S.trigrams(F.col("term_norm")))
    queries = probes.select("query_id", "term_norm")
    if most is not None:
        return _first_near(p, records, above, weights, most).join(queries, "term_norm").select("query_id", "id", "fuzzy")
    r = records.where("norm <> ''").select("norm").distinct().withColumn("r_grams", S.trigrams(F.col("norm")))
    near = _near(_met(p, r), above, weights, int(probes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return near.join(queries, "term_norm").join(records.select("id", "norm"), "norm").select("query_id", "id", "fuzzy")


def candidates(probes: DataFrame, records: DataFrame, search: Search = Search(), strategies: Sequence[str] = STRATEGIES) -> DataFrame:
    """query_id, id, matched_by (names of strategies, in order), first_strategy and fuzzy (score and a hash of the texts, if found so), from prepared probes and records.

    Strategies don't depend on each other: with fewer ``strategies`` the rest find what they find with all.
    """
    most = search.per_strategy
    lows = _fewest(records, "low", most)
    inside = contained(probes, lows)
    ways = {
        "exact": lambda: inside.where("low = term_low"),
        "prefix": lambda: inside.where(F.col("low").startswith(F.col("term_low"))),
        "wildcard": lambda: inside,
        "fuzzy": lambda: fuzzy(probes, records, most=most),
        "normalized": lambda: probes.where("term_norm <> term_low AND term_norm <> ''").join(lows, F.col("term_norm") == F.col("low")),
    }
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_strategy(ways[name](), name) for name in STRATEGIES if name in strategies])
    if "fuzzy" not in strategies:
        out = out.withColumn("fuzzy", F.lit(None).cast(FOUND))
    if most is not None:
        out = out.withColumn("at", F.row_number().over(Window.partitionBy("query_id", "strategy").orderBy(F.asc_nulls_last("id")))).where(F.col("at") <= most)
    names = F.array(*map(F.lit, STRATEGIES))
    by = F.transform(F.array_sort(F.collect_set("strategy")), lambda k: F.get(names, k))
    return out.groupBy("query_id", "id").agg(by.alias("matched_by"), F.min("strategy").alias("first_strategy"), F.max("fuzzy").alias("fuzzy"))


def prepare(probes: DataFrame, records: DataFrame, search: Search = Search(), probe_id: str = "query_id", term: str = "term", record_id: str = "id", name: str = "name") -> tuple[DataFrame, DataFrame]:
    """Probes and records as the strategies read them, each normalized once, into written tables: every strategy reads them."""
    options = N.options_for(search.field)
    return written(_probes(probes, probe_id, term, options), "probes"), written(_records(records, record_id, name, options), "records")


def scored(probes: DataFrame, records: DataFrame, search: Search = Search()) -> DataFrame:
    """All candidates with base_score, score (boosted) and confidence."""
    rows = candidates(probes, records, search).join(probes.select("query_id", "term_norm"), "query_id").join(records.select("id", "name", "norm"), "id")
    score = S.composite_score(F.col("term_norm"), F.col("norm"), search.weights)
    if not search.weights:  # fuzzy candidates have the same score already, unless their ids stand for several texts
        score = F.when(F.col("fuzzy.pair") == F.xxhash64("term_norm", "norm"), F.col("fuzzy.score")).otherwise(score)
    rows = rows.withColumn("base_score", _here(score)).drop("fuzzy")
    rows = rows.withColumn("score", boosted(F.col("base_score"), F.col("matched_by")))
    return rows.withColumn("confidence", confidence(F.col("score")))


def find_matches(probes: DataFrame, records: DataFrame, search: Search = Search(), **columns: str) -> DataFrame:
    """query_id, rank, id, name, score, confidence, matched_by and both normalized texts; best first.

    Ties go to the earlier strategy, then the smaller id. The least confidence is
    asked for before the limit: it follows the score, so the outcome is the same.
    """
    p, r = prepare(probes, records, search, **columns)
    rows = scored(p, r, search)
    if search.min_confidence:
        rows = rows.where(level(F.col("confidence")) >= LEVELS[search.min_confidence])
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "first_strategy", "id")
    rows = rows.withColumn("rank", F.row_number().over(best))
    if search.limit is not None:
        rows = rows.where(F.col("rank") <= search.limit)
    return rows.select("query_id", "rank", "id", "name", "score", "confidence", "matched_by", F.col("term_norm").alias("normalized_input"), F.col("norm").alias("normalized_record"))


def find_duplicates(probes: DataFrame, records: DataFrame, search: Search | None = None, **columns: str) -> DataFrame:
    """Matches of at least medium confidence, unless the search asks otherwise."""
    search = search or Search()
    if search.min_confidence is None:
        search = Search(search.field, search.limit, search.per_strategy, "MEDIUM", search.weights)
    return find_matches(probes, records, search, **columns)


def format_matches(rows: list, shown: Sequence[str] = ()) -> str:
    """Collected matches as numbered lines, with the values of further fields that the rows have."""
    if not rows:
        return "No matches found."
    out = []
    for k, r in enumerate(rows, 1):
        out.append(f"{k}. {r['name']} (id {r['id']})")
        further = [f"{f}: {r[f]}" for f in shown if f in r and r[f] not in (None, "")]
        out += [f"   {', '.join(further)}"] if further else []
        out.append(f"   {r['confidence']} confidence ({r['score'] * 100:.1f}%) - Matched by: {', '.join(r['matched_by'])}")
    return "\n".join(out)
