"""The library's queries and the SQL they are held against.

Every query runs over whole tables. Similarities are taken between the
distinct part names (a small domain, whatever the scale factor).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as O
from .functions import checks as K
from .functions import normalize as N
from .functions import similarity as S
from .operators import catalog as C
from .operators import depgraph as G
from .operators import freshness as A
from .operators import matching as M
from .operators import validate as V
from .plans.cache import MetadataCache
from .sources import search as Q
from .sources import sinks
from .sources.tables import REFERENCES, TABLES, table

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return put


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


# Similarity: all pairs of distinct part names that share a trigram (a domain of a few dozen names).


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).distinct()


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs a < b of distinct names with a common trigram: an equi-join, without repeats."""
    grams = _names(spark, sf_dir).select("name", F.explode(S.trigrams(F.col("name"))).alias("gram"))
    a, b = grams.select(F.col("name").alias("a"), "gram"), grams.select(F.col("name").alias("b"), "gram")
    return a.join(b, "gram").where("a < b").select("a", "b").distinct()


_PAIRS = f"SELECT x.p_name AS a, y.p_name AS b FROM (SELECT DISTINCT p_name FROM part) x JOIN (SELECT DISTINCT p_name FROM part) y ON x.p_name < y.p_name WHERE len(list_intersect({O.trigrams('x.p_name')}, {O.trigrams('y.p_name')})) > 0"


def _with_scores(select: str) -> str:
    return f"WITH {O.pairs_with_scores(_PAIRS)} SELECT a, b, {select} FROM s"


@query(f"SELECT a, b, levenshtein(a, b) AS distance, round({O.levenshtein('a', 'b')}, 9) AS score FROM ({_PAIRS}) p")
def sim_levenshtein(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("a", "b", S.levenshtein_distance(a, b).cast("long").alias("distance"), F.round(S.levenshtein_similarity(a, b), 9).alias("score"))


@query(f"SELECT a, b, round({O.trigram('a', 'b')}, 9) AS score FROM ({_PAIRS}) p")
def sim_trigram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(S.trigram_similarity(F.col("a"), F.col("b")), 9).alias("score"))


@query(f"SELECT name, {O.soundex('name')} AS code FROM (SELECT DISTINCT p_name AS name FROM part) n")
def sim_soundex_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _names(spark, sf_dir).select("name", S.soundex(F.col("name")).alias("code"))


@query(f"SELECT a, b, {O.soundex('a')} = {O.soundex('b')} AS matches, {O.soundex_similarity('a', 'b')} AS score FROM ({_PAIRS}) p")
def sim_soundex(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("a"), F.col("b")
    return _pairs(spark, sf_dir).select("a", "b", S.soundex_matches(a, b).alias("matches"), S.soundex_similarity(a, b).alias("score"))


@query(f"WITH p1 AS (SELECT a, b, {O.jaro_state('a', 'b')} AS state FROM ({_PAIRS}) p) SELECT a, b, round({O.jaro_from('state', 'a', 'b')}, 9) AS score FROM p1")
def sim_jaro(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(S.jaro(F.col("a"), F.col("b")), 9).alias("score"))


@query(_with_scores("round(jw, 9) AS score"))
def sim_jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(S.jaro_winkler(F.col("a"), F.col("b")), 9).alias("score"))


@query(_with_scores(f"round({O.composite()}, 9) AS score"))
def sim_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(S.composite_score(F.col("a"), F.col("b")), 9).alias("score"))


@query(_with_scores(f"round({O.composite({'levenshtein': 0.5, 'soundex': 0.0})}, 9) AS score"))
def sim_custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", F.round(S.composite_score(F.col("a"), F.col("b"), {"levenshtein": 0.5, "soundex": 0.0}), 9).alias("score"))


@query(_with_scores("CASE greatest(lev, jw, tri, sdx) WHEN lev THEN 'LEVENSHTEIN' WHEN jw THEN 'JARO_WINKLER' WHEN tri THEN 'TRIGRAM' ELSE 'SOUNDEX' END AS algorithm"))
def sim_algorithm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("a", "b", S.composite(F.col("a"), F.col("b"))["algorithm"].alias("algorithm"))


# Normalization of whole texts.


def _text_query(name: str, table_name: str, key: str, column: str, options: N.Options, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, table_name).select(key, F.md5(N.normalize(F.col(column), options)).alias("digest"))

    run.__name__ = name
    query(f"SELECT {key}, md5({sql}) AS digest FROM {table_name}")(run)


_text_query("norm_person", "documents", "doc_id", "text", N.PERSON, O.person("text"))
_text_query("norm_search", "documents", "doc_id", "text", N.SEARCH, O.search("text"))
_text_query("norm_company", "documents", "doc_id", "text", N.COMPANY, O.company("text"))
_text_query("norm_email", "pages", "page_id", "url", N.EMAIL, O.person("url"))


@query(f"SELECT doc_id, md5({O.diacritics('text')}) AS digest FROM documents")
def norm_diacritics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.fold_diacritics(F.col("text"))).alias("digest"))


_LOW = f"lower({O.diacritics('text')})"


def _changes_sql() -> str:
    """Each suffix is looked for in the text as those before left it: a CTE for each."""
    ctes = [f"t0 AS (SELECT item_id, text, {_LOW} AS t, '' AS log FROM benchmark)"]
    for k, key in enumerate(N.suffix_order()):
        pattern = O.quoted(rf"(?i)\b{key}\b")
        note = O.quoted(f"{key} → {N.SUFFIXES[key]};")
        ctes.append(f"t{k + 1} AS (SELECT item_id, text, regexp_replace(t, {pattern}, '{N.SUFFIXES[key]}', 'g') AS t, log || CASE WHEN regexp_matches(t, {pattern}) THEN {note} ELSE '' END AS log FROM t{k})")
    last = f"t{len(N.SUFFIXES)}"
    return f"WITH {', '.join(ctes)} SELECT item_id, (length(text) - length({O.diacritics('text')}))::BIGINT AS diacritics_removed, log AS suffixes, (length(t) - length({O.special('t')}))::BIGINT AS special_removed, {O.squeeze(O.special('t'))} AS normalized FROM {last}"


@query(_changes_sql())
def norm_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark").select("item_id", N.normalize_with_changes(F.col("text"), N.SEARCH).alias("n"))
    log = F.array_join(F.transform("n.changes.suffixes_normalized", lambda x: F.concat(x, F.lit(";"))), "")
    return rows.select("item_id", F.col("n.changes.diacritics_removed").cast("long").alias("diacritics_removed"), log.alias("suffixes"), F.col("n.changes.special_chars_removed").cast("long").alias("special_removed"), "n.normalized")


# Matching: probes made from part names against the distinct names, numbered.

_PROBE_FORMS = ("n", "upper(n)", "substr(n, 1, 4)", "substr(n, 3, 4)", "replace(n, 'e', '')", "n || ' corporation'", "substr(n, 2) || ' inc.'")


def _record_sql() -> str:
    return "SELECT dense_rank() OVER (ORDER BY p_name) AS id, p_name AS name FROM (SELECT DISTINCT p_name FROM part) d"


def _probe_sql() -> str:
    forms = " UNION ALL ".join(f"SELECT id * 10 + {k} AS query_id, {form} AS term FROM (SELECT id, name AS n FROM ({_record_sql()}) r) q" for k, form in enumerate(_PROBE_FORMS))
    return forms


def _probes_and_records(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    from pyspark.sql import Window

    records = _names(spark, sf_dir).select(F.dense_rank().over(Window.orderBy("name")).cast("long").alias("id"), "name")
    each = F.array(*[F.struct(F.lit(k).alias("k"), F.expr(form).alias("term")) for k, form in enumerate(_PROBE_FORMS)])
    probes = records.withColumn("n", F.col("name")).select("id", F.explode(each).alias("p")).select((F.col("id") * 10 + F.col("p.k")).alias("query_id"), "p.term")
    return probes, records


_MATCH = f"WITH {O.matches(_probe_sql(), _record_sql())} "


def _strategy_query(name: str, strategy: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        probes, records = M.prepare(*_probes_and_records(spark, sf_dir))
        found = M.candidates(probes, records, M.Search(per_strategy=20))
        return found.where(F.array_contains("matched_by", strategy)).select("query_id", "id")

    run.__name__ = name
    query(f"{_MATCH} SELECT query_id, id FROM capped WHERE k = {M.STRATEGIES.index(strategy)}")(run)


for _s in M.STRATEGIES[:-1]:
    _strategy_query(f"match_{_s}", _s)


# Suppliers as firms: every row a record, and a probe for each whose suffix is written out.

_FIRMS = "SELECT s_suppkey::BIGINT AS id, s_name || CASE s_suppkey % 3 WHEN 0 THEN ' Corp' WHEN 1 THEN ' inc' ELSE ' Ltd' END AS name FROM supplier"
_FIRM_PROBES = "SELECT s_suppkey::BIGINT AS query_id, replace(upper(s_name), 'U', 'Ü') || CASE s_suppkey % 3 WHEN 0 THEN ' CORPORATION' WHEN 1 THEN ' Incorporated' ELSE ' limited' END AS term FROM supplier"
_FIRM_MATCH = f"WITH {O.matches(_FIRM_PROBES, _FIRMS)} "


def _firms(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    suppliers = table(spark, sf_dir, "supplier")
    suffix = lambda *to: F.element_at(F.array(*map(F.lit, to)), (F.col("s_suppkey") % 3 + 1).cast("int"))
    key = F.col("s_suppkey").cast("long")
    probes = suppliers.select(key.alias("query_id"), F.concat(F.replace(F.upper("s_name"), F.lit("U"), F.lit("Ü")), suffix(" CORPORATION", " Incorporated", " limited")).alias("term"))
    return probes, suppliers.select(key.alias("id"), F.concat("s_name", suffix(" Corp", " inc", " Ltd")).alias("name"))


@query(f"{_FIRM_MATCH} SELECT query_id, id FROM capped WHERE k = {M.STRATEGIES.index('normalized')}")
def match_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.candidates(*M.prepare(*_firms(spark, sf_dir)), M.Search(per_strategy=20), ("normalized",))
    return found.where(F.array_contains("matched_by", "normalized")).select("query_id", "id")


@query(f"{_FIRM_MATCH} SELECT query_id, rank, id, confidence FROM graded WHERE rank <= 10 AND confidence IN ('HIGH', 'MEDIUM')")
def find_duplicates_of_firms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.find_duplicates(*_firms(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "confidence")


@query(f"{_MATCH} SELECT query_id, id, matched_by, round(base_score, 9) AS base_score, round(score, 9) AS score, confidence FROM graded")
def match_scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.scored(*M.prepare(*_probes_and_records(spark, sf_dir)))
    return rows.select("query_id", "id", F.array_join("matched_by", ",").alias("matched_by"), F.round("base_score", 9).alias("base_score"), F.round("score", 9).alias("score"), "confidence")


@query(f"{_MATCH} SELECT query_id, rank, id, name, round(score, 9) AS score, confidence, matched_by FROM graded WHERE rank <= 10")
def match_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.find_matches(*_probes_and_records(spark, sf_dir))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "id", "name", F.round("score", 9).alias("score"), "confidence", F.array_join("matched_by", ",").alias("matched_by"))


@query(f"{_MATCH} SELECT query_id, rank, id, round(score, 9) AS score FROM graded WHERE rank <= 10 AND confidence = 'HIGH'")
def match_min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = M.find_matches(*_probes_and_records(spark, sf_dir), M.Search(min_confidence="HIGH"))
    return rows.select("query_id", F.col("rank").cast("long").alias("rank"), "id", F.round("score", 9).alias("score"))


@query(f"{_MATCH} SELECT query_id, rank, id, name, confidence FROM graded WHERE rank <= 10 AND confidence IN ('HIGH', 'MEDIUM')")
def find_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.find_duplicates(*_probes_and_records(spark, sf_dir)).select("query_id", F.col("rank").cast("long").alias("rank"), "id", "name", "confidence")


@query(f"{_MATCH} SELECT query_id, count(*) FILTER (WHERE confidence = 'HIGH') AS n_high, count(*) FILTER (WHERE confidence = 'MEDIUM') AS n_medium FROM graded WHERE rank <= 10 AND confidence <> 'LOW' GROUP BY query_id")
def duplicate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.orchestrate import check_duplicates
    from .plans.orchestrate import duplicate_warnings as count

    return count(check_duplicates(*_probes_and_records(spark, sf_dir)))


# Queries and search.


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def soql_where_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return Q.query(spark, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")


@query("SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
def soql_where_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return Q.query(spark, "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")


@query("SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")
def soql_project_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return Q.query(spark, "SELECT c_custkey, c_name FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 10")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def soql_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return Q.query(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")
def get_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return Q.get_record(spark, "customer", "c_custkey", 7, ("c_custkey", "c_name", "c_acctbal"))


@query("SELECT conv_id, turn FROM conversations WHERE contains(lower(role), 'the') OR contains(lower(text), 'the')")
def search_all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "conversations").createOrReplaceTempView("conversations")
    return Q.search(spark, "FIND {*The*} IN ALL FIELDS RETURNING conversations(conv_id, turn)")["conversations"]


@query("SELECT 'part' AS object, p_partkey AS key FROM part WHERE starts_with(lower(p_name), 'bl') OR starts_with(lower(p_brand), 'bl') OR starts_with(lower(p_type), 'bl') UNION ALL SELECT 'nation', n_nationkey FROM nation WHERE starts_with(lower(n_name), 'bl')")
def search_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    for name in ("part", "nation"):
        table(spark, sf_dir, name).createOrReplaceTempView(name)
    found = Q.search(spark, "FIND {bl*} IN ALL FIELDS RETURNING part(p_partkey), nation(n_nationkey)")
    parts = found["part"].select(F.lit("part").alias("object"), F.col("p_partkey").cast("long").alias("key"))
    return parts.unionByName(found["nation"].select(F.lit("nation").alias("object"), F.col("n_nationkey").cast("long").alias("key")))


@query("SELECT p_partkey FROM part WHERE contains(lower(p_name), 'e')")
def search_name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return Q.search(spark, "FIND {*e*} IN NAME FIELDS RETURNING part(p_partkey)")["part"]


@query("SELECT p_partkey FROM part WHERE lower(p_brand) = 'brand#23' OR lower(p_name) = 'brand#23' OR lower(p_type) = 'brand#23' ORDER BY p_partkey LIMIT 7")
def search_exact_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return Q.search(spark, "FIND {Brand#23} IN ALL FIELDS RETURNING part(p_partkey) LIMIT 7")["part"]


# The catalog, made from the schemas of the tables and declared references.


def _catalog(spark: SparkSession, sf_dir: str) -> C.Catalog:
    tables = {n: table(spark, sf_dir, n) for n in TABLES}
    catalog = C.sync(spark, C.empty(spark), tables, REFERENCES, "2024-01-01 00:00:00")
    rules = spark.createDataFrame([("orders", "positive_total", "positive_total", True, "Total must be positive"), ("orders", "old_rule", "old_rule", False, "-"), ("part", "has_brand", "has_brand", True, "Brand is needed")], "sobject string, name string, api_name string, active boolean, error_message string")
    return C.put(catalog, "validation_rules", rules)


_RELS = ", ".join(f"('{t}', '{c}', '{to[-1]}')" for (t, c), to in REFERENCES.items())


@query(f"SELECT * FROM (VALUES {_RELS}) r(from_sobject, field_name, to_sobject)")
def catalog_relationships(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.get_relationships(_catalog(spark, sf_dir)).select("from_sobject", "field_name", "to_sobject")


@query("SELECT table_name AS sobject, column_name AS name FROM information_schema.columns WHERE table_name IN ('orders', 'lineitem')")
def catalog_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    return C.get_fields(catalog, "orders").unionByName(C.get_fields(catalog, "lineitem")).select("sobject", "name")


@query("SELECT 14::BIGINT AS sobjects, (SELECT count(*) FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + f")) AS fields, 3::BIGINT AS validation_rules, {len(REFERENCES)}::BIGINT AS relationships")
def catalog_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.stats(_catalog(spark, sf_dir))


@query("SELECT 'orders' AS sobject, 'positive_total' AS name, 'Total must be positive' AS error_message")
def catalog_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.get_rules(_catalog(spark, sf_dir), "orders").select("sobject", "name", "error_message")


@query("SELECT name, row_number() OVER (ORDER BY g, n_nationkey) AS rank FROM (SELECT n_name AS name, n_nationkey, 1 AS g, row_number() OVER (ORDER BY n_nationkey) AS k FROM nation WHERE n_regionkey <> 0) x WHERE k <= 20")
def standard_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    described = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.lit(True).alias("is_queryable"), F.lit(True).alias("is_createable"), (F.col("n_regionkey") == 0).alias("is_custom"), F.col("n_nationkey").alias("position"))
    return C.standard_objects(described).select("name", F.col("rank").cast("long").alias("rank"))


@query("WITH m AS (SELECT max(ts) AS t FROM events), s AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT user_id::VARCHAR AS name, epoch_us(t) // 1000 - epoch_us(last) // 1000 AS age_ms, epoch_us(t) // 1000 - epoch_us(last) // 1000 > 86400000 AS stale FROM s, m")
def metadata_age(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    synced = events.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max("ts").alias("synced_at"))
    as_of = F.lit(events.agg(F.max("ts")).first()[0])
    return A.ages(synced.select("name"), synced, as_of)


@query("WITH m AS (SELECT max(ts) AS t FROM events), s AS (SELECT user_id, max(ts) AS last FROM events GROUP BY user_id) SELECT count(*) AS total_objects, 0::BIGINT AS core_objects_cached, 86400000::BIGINT AS ttl_ms, 24.0::DOUBLE AS ttl_hours FROM s")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    synced = events.groupBy(F.col("user_id").cast("string").alias("name")).agg(F.max("ts").alias("synced_at"))
    return A.cache_stats(synced, F.lit(events.agg(F.max("ts")).first()[0]))


@query(f"SELECT 14::BIGINT AS total_objects, 0::BIGINT AS core_objects_cached, 3600000::BIGINT AS ttl_ms, 1.0::DOUBLE AS ttl_hours, (SELECT count(*) FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + f")) AS total_fields, {len(REFERENCES)}::BIGINT AS total_relationships")
def cache_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalog = _catalog(spark, sf_dir)
    return A.cache_totals(catalog["sobjects"], catalog["fields"], catalog["relationships"], F.lit("2024-01-02").cast("timestamp"), 3600000)


@query("SELECT name FROM (VALUES ('lineitem'), ('orders'), ('part'), ('supplier'), ('customer'), ('nation')) x(name) UNION ALL SELECT 'again: lineitem' UNION ALL SELECT 'refreshed: orders'")
def cache_ensure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a cache takes for an object and two steps of references, a day later for another, and when it is told to."""
    at = ["2024-01-01 00:00:00"]
    cache = MetadataCache(spark, {t: table(spark, sf_dir, t) for t in ("lineitem", "orders", "part", "supplier", "customer", "nation")}, REFERENCES, now=lambda: at[0])
    names = cache.ensure_related(["lineitem"], 2)
    names += cache.ensure(["lineitem", "orders"])
    at[0] = "2024-01-02 00:00:01"
    names += [f"again: {n}" for n in cache.ensure(["lineitem"])] + [f"refreshed: {n}" for n in cache.refresh(["orders"])]
    return spark.createDataFrame([(n,) for n in names], "name string")


@query(f"WITH RECURSIVE e(a, f, b) AS (VALUES {_RELS}), r(name, steps) AS (SELECT 'lineitem', 0 UNION SELECT b, steps + 1 FROM r JOIN e ON a = name WHERE steps < 3) SELECT name, min(steps) AS steps FROM r GROUP BY name")
def related_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = C.get_relationships(_catalog(spark, sf_dir)).select("from_sobject", "to_sobject")
    return A.related(spark.createDataFrame([("lineitem",)], "name string"), rels, 3)


# Validation, of orders and customers with a catalog that makes some of them fail.


def _strict_catalog(spark: SparkSession) -> C.Catalog:
    objects = spark.createDataFrame([("order", True, False), ("customer", True, True), ("part", False, True)], "name string, is_createable boolean, is_updateable boolean")
    pick = [{"label": s, "value": s} for s in ("BUILDING", "MACHINERY", "FURNITURE")]
    fields = spark.createDataFrame(
        [
            ("order", "o_custkey", "Customer", "string", None, None, None, False, None, ["customer"]),
            ("order", "o_totalprice", "Total", "currency", None, 7, 1, False, None, None),
            ("order", "o_orderstatus", "Status", "int", None, None, None, False, None, None),
            ("order", "o_comment", "Comment", "string", None, None, None, True, None, None),
            ("customer", "c_name", "Name", "string", 17, None, None, True, None, None),
            ("customer", "c_mktsegment", "Segment", "picklist", None, None, None, False, pick, None),
            ("customer", "c_region", "Region", "string", None, None, None, True, None, ["customer"]),
        ],
        f"sobject string, name string, label string, type string, length int, precision_val int, scale int, is_required boolean, picklist_values {C.PICKLIST}, reference_to array<string>",
    )
    catalog = C.put(C.put(C.empty(spark), "sobjects", objects), "fields", fields)
    catalog = C.put(catalog, "relationships", C.relationships_from(catalog["fields"], catalog["sobjects"]))
    return C.put(catalog, "validation_rules", spark.createDataFrame([("customer", "r1", True), ("customer", "r2", True), ("order", "r3", False)], "sobject string, name string, active boolean"))


def _order_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    return rows.select(F.col("o_orderkey").alias("row_id"), F.lit("order").alias("object")), V.long_form(rows, "o_orderkey", "order")


def _customer_values(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return rows.select(F.col("c_custkey").alias("row_id"), F.lit("customer").alias("object")), V.long_form(rows, "c_custkey", "customer")


def _number(c: str) -> str:
    return rf"regexp_replace({c}::VARCHAR, '\.0$', '')"


@query(
    f"""
SELECT o_orderkey AS row_id, 'o_comment' AS field, 'error' AS severity, 'REQUIRED_FIELD' AS type, 'Required field ''Comment'' is missing or empty.' AS message FROM orders
UNION ALL SELECT o_orderkey, 'o_custkey', 'error', 'TYPE_MISMATCH', 'Field ''Customer'' expects type string but got number.' FROM orders
UNION ALL SELECT o_orderkey, 'o_orderstatus', 'error', 'TYPE_MISMATCH', 'Field ''Status'' expects type number but got string.' FROM orders
UNION ALL SELECT o_orderkey, 'o_totalprice', 'warning', 'PRECISION_WARNING', 'Field ''Total'' may exceed precision of 7 digits.' FROM orders WHERE length(replace({_number('o_totalprice')}, '.', '')) > 7
UNION ALL SELECT o_orderkey, 'o_totalprice', 'warning', 'SCALE_WARNING', 'Field ''Total'' has ' || length(split_part({_number('o_totalprice')}, '.', 2)) || ' decimal places but max is 1.' FROM orders WHERE length(split_part({_number('o_totalprice')}, '.', 2)) > 1
UNION ALL SELECT o_orderkey, 'o_custkey', 'suggestion', 'REFERENCE_CHECK', 'Ensure customer record with ID ''' || o_custkey || ''' exists.' FROM orders WHERE o_custkey <> 0
"""
)
def validate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values = _order_values(spark, sf_dir)
    return V.validate(rows, values, _strict_catalog(spark), "create").select("row_id", "field", "severity", "type", "message")


_CUSTOMERS = """
SELECT c_custkey AS row_id, 'c_name' AS field, 'error' AS severity, 'LENGTH_EXCEEDED' AS type FROM customer WHERE length(c_name) > 17
UNION ALL SELECT c_custkey, 'c_mktsegment', 'error', 'INVALID_PICKLIST_VALUE' FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'FURNITURE')
UNION ALL SELECT c_custkey, 'c_acctbal', 'warning', 'UNKNOWN_FIELD' FROM customer
UNION ALL SELECT c_custkey, '__validation_rules__', 'warning', 'VALIDATION_RULES_EXIST' FROM customer
UNION ALL SELECT c_custkey, 'c_region', 'error', 'REQUIRED_RELATIONSHIP' FROM customer
"""


@query(_CUSTOMERS)
def validate_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values = _customer_values(spark, sf_dir)
    return V.validate(rows, values, _strict_catalog(spark), "update").select("row_id", "field", "severity", "type")


@query(f"SELECT row_id, count(*) FILTER (WHERE severity = 'error') AS n_errors, count(*) FILTER (WHERE severity = 'warning') AS n_warnings, 0::BIGINT AS n_suggestions, count(*) FILTER (WHERE severity = 'error') = 0 AS valid FROM ({_CUSTOMERS}) f GROUP BY row_id")
def validate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values = _customer_values(spark, sf_dir)
    return V.verdicts(rows, V.validate(rows, values, _strict_catalog(spark), "update"))


@query("SELECT p_partkey AS row_id, CASE WHEN p_size % 2 = 0 THEN 'CRUD_PERMISSION' ELSE 'METADATA_NOT_FOUND' END AS type, CASE WHEN p_size % 2 = 0 THEN 'Object ''part'' is not createable. Check CRUD permissions.' ELSE 'Object ''widget'' not found in metadata. Run metadata sync first.' END AS message FROM part")
def validate_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.when(F.col("p_size") % 2 == 0, "part").otherwise("widget").alias("object"), "p_name")
    values = rows.select("row_id", "object", F.lit("p_name").alias("field"), F.col("p_name").alias("value"), F.lit("string").alias("js_type"))
    return V.validate(rows.select("row_id", "object"), values, _strict_catalog(spark), "create").select("row_id", "type", "message")


@query("SELECT doc_id AS row_id, 'doc_id' AS field, 'No labels record with ID ''' || doc_id || '''.' AS message FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def reference_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = spark.createDataFrame([("documents",), ("labels",)], "name string")
    fields = spark.createDataFrame([("documents", "doc_id", "Doc", "reference", ["labels"])], "sobject string, name string, label string, type string, reference_to array<string>")
    catalog = C.put(C.put(C.empty(spark), "sobjects", objects), "fields", fields)
    catalog = C.put(catalog, "relationships", C.relationships_from(catalog["fields"], catalog["sobjects"]))
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), "doc_id")
    values = V.long_form(docs, "row_id", "documents")
    return V.check_references(values, catalog, {"labels": (table(spark, sf_dir, "labels"), "doc_id")}).select("row_id", "field", "message")


@query("SELECT c_custkey, regexp_full_match(name, '[a-zA-Z][a-zA-Z0-9_]*') AS is_name, length(rid) IN (15, 18) AND regexp_full_match(rid, '[a-zA-Z0-9]+') AS is_id FROM (SELECT c_custkey, replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE '#' END) AS name, substr(replace(c_name, '#', '') || repeat('x', (c_custkey % 4)::INT), 1, 18) AS rid FROM customer) x")
def validator_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.expr("replace(c_name, '#', CASE WHEN c_custkey % 2 = 0 THEN '_' ELSE '#' END)").alias("name"),
        F.expr("substr(replace(c_name, '#', '') || repeat('x', CAST(c_custkey % 4 AS INT)), 1, 18)").alias("rid"),
    )
    return rows.select("c_custkey", K.is_object_name(F.col("name")).alias("is_name"), K.is_record_id(F.col("rid")).alias("is_id"))


# Dependencies: every turn of a conversation refers to the turn before.


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    name = F.concat(F.lit("@"), F.col("conv_id").cast("string"), F.lit("-"), F.col("turn").cast("string"))
    before = F.concat(F.lit("@"), F.col("conv_id").cast("string"), F.lit("-"), (F.col("turn") - 1).cast("string"))
    return c.select((F.col("conv_id") * 100000 + F.col("turn")).alias("op"), F.lit("create").alias("type"), F.lit("turn").alias("sobject"), name.alias("temp_id"), F.lit(None).cast("string").alias("record_id"), F.create_map(F.lit("after"), before, F.lit("role"), F.col("role")).alias("data")).dropDuplicates(["op"])


_TURNS = "(SELECT DISTINCT conv_id, turn, conv_id * 100000 + turn AS op FROM conversations)"


@query(f"SELECT a.op AS from_op, b.op AS to_op, 'after' AS field FROM {_TURNS} a JOIN {_TURNS} b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def dep_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(_turns(spark, sf_dir)).select("from_op", "to_op", "field")


_LEVELS = f"WITH t AS (SELECT op, conv_id, turn, turn - row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS island FROM {_TURNS} x), l AS (SELECT op, (row_number() OVER (PARTITION BY conv_id, island ORDER BY turn) - 1)::INT AS level FROM t)"


@query(f"{_LEVELS} SELECT op, level FROM l")
def dep_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.resolve(_turns(spark, sf_dir))[0]


@query(f"{_LEVELS} SELECT level, count(*) AS n, count(*) > 1 AS can_parallelize, md5(string_agg('op_' || op, ',' ORDER BY op)) AS nodes FROM l GROUP BY level")
def dep_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _turns(spark, sf_dir)
    return G.plan(ops, G.resolve(ops)[0]).select("level", "n", "can_parallelize", F.md5(F.array_join("node_ids", ",")).alias("nodes"))


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations of a region refer to the next of it in a ring; a region of one nation refers to itself."""
    from pyspark.sql import Window

    n = table(spark, sf_dir, "nation")
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nxt = F.coalesce(F.lead("n_nationkey").over(w), F.min("n_nationkey").over(Window.partitionBy("n_regionkey")))
    name = lambda c: F.concat(F.lit("@n"), c.cast("string"))
    return n.select(F.col("n_nationkey").cast("long").alias("op"), F.lit("create").alias("type"), F.lit("nation").alias("sobject"), name(F.col("n_nationkey")).alias("temp_id"), F.lit(None).cast("string").alias("record_id"), F.create_map(F.lit("next"), name(nxt)).alias("data"))


@query("SELECT n_nationkey::BIGINT AS op, (min(n_nationkey) OVER (PARTITION BY n_regionkey))::BIGINT AS cycle FROM nation")
def dep_cycles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.cycles(G.edges(_rings(spark, sf_dir)))


@query("SELECT (min(n_nationkey) OVER w)::BIGINT AS cycle, n_nationkey::BIGINT AS to_op, 'next' AS field, 'create-then-update' AS strategy FROM nation WINDOW w AS (PARTITION BY n_regionkey) QUALIFY n_nationkey = min(n_nationkey) OVER w")
def dep_break_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    rels = spark.createDataFrame([("nation", "next", False)], "from_sobject string, field_name string, is_required boolean")
    return G.resolve(_rings(spark, sf_dir), rels)[1].select("cycle", "to_op", "field", "strategy")


@query(f"SELECT b.op, coalesce('id' || a.op, '@' || b.conv_id || '-' || (b.turn - 1)) AS after, (a.op IS NULL)::INT AS n_errors FROM {_TURNS} b LEFT JOIN {_TURNS} a ON a.conv_id = b.conv_id AND b.turn = a.turn + 1")
def resolve_temp_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = _turns(spark, sf_dir)
    ids = ops.select("temp_id", F.concat(F.lit("id"), F.col("op").cast("string")).alias("record_id"))
    return G.resolved_data(ops, ids).select("op", F.col("data")["after"].alias("after"), F.size("errors").alias("n_errors"))


# Sinks.


@query("SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY', 'FURNITURE') AND length(c_name) <= 18 AS accepted FROM customer")
def sink_create_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, values = _customer_values(spark, sf_dir)
    catalog = _strict_catalog(spark)
    wider = C.put(catalog, "fields", catalog["fields"].where("name <> 'c_region'").withColumn("length", F.when(F.col("name") == "c_name", 18).otherwise(F.col("length"))))
    findings = V.check_fields(values, wider)
    good, bad = sinks.split(rows.withColumnRenamed("row_id", "c_custkey"), findings, "c_custkey")
    return good.select("c_custkey", F.lit(True).alias("accepted")).unionByName(bad.select("c_custkey", F.lit(False).alias("accepted")))


@query("SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'MOVED' ELSE c_mktsegment END AS c_mktsegment, c_acctbal FROM customer")
def sink_update_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer")
    changes = customers.where("c_nationkey = 3").select("c_custkey", F.lit("MOVED").alias("c_mktsegment"), F.lit(None).cast("double").alias("c_acctbal"))
    return sinks.updated(customers, changes, "c_custkey").select("c_custkey", "c_mktsegment", "c_acctbal")


@query("SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def sink_delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("o_custkey"))
    return sinks.deleted(table(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likely duplicates of all probes, best first, with their confidence."""
    return match_topk(spark, sf_dir)
