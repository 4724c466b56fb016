import pytest
from pyspark.sql import functions as F

from recordlens.operators import catalog as C
from recordlens.operators import depgraph as G
from recordlens.operators import freshness as A
from recordlens.operators import matching as M
from recordlens.operators import validate as V
from recordlens.plans import orchestrate as O
from recordlens.plans.tools import ToolError, Tools
from recordlens.sources import search as Q
from recordlens.sources import sinks
from tests import models

NAMES = ["Acme Corporation", "Acme Corp", "ACME Inc", "Beta Industries", "Café Industries", "Cafe Industries", "Müller GmbH", "Muller GmbH", "3M Company", "日本 Corp", "X"]


def records(spark):
    return spark.createDataFrame(list(enumerate(NAMES)), "id long, name string")


def probes(spark, *terms):
    return spark.createDataFrame([(k, t) for k, t in enumerate(terms)], "query_id long, term string")


def test_matches_by_all_strategies(spark):
    got = M.find_matches(probes(spark, "Acme Corporation", "", None, "muller gmbh", "m"), records(spark), M.Search(limit=None)).collect()
    by = {(r.query_id, r.name): r for r in got}
    assert by[0, "Acme Corporation"].matched_by == ["exact", "prefix", "wildcard", "fuzzy"] and by[0, "Acme Corporation"].score == 1.0
    assert by[0, "Acme Corp"].matched_by == ["fuzzy", "normalized"] and by[0, "Acme Corp"].confidence == "HIGH"
    assert by[3, "Müller GmbH"].matched_by == ["fuzzy"] and by[3, "Muller GmbH"].rank == 1
    assert not [r for r in got if r.query_id in (1, 2)]
    assert {n for q, n in by if q == 4} >= {"Acme Corp", "3M Company", "Müller GmbH"}


def test_fuzzy_blocking_loses_nothing(spark):
    texts = [f"{a} {b}" for a in ("red", "read", "bred", "blue", "x") for b in ("anvil", "anvl", "bolt", "bold")]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, name string")
    p, r = M.prepare(rows.select(F.col("id").alias("query_id"), F.col("name").alias("term")), rows)
    got = {(x.query_id, x.id) for x in M.fuzzy(p, r).collect()}
    weights = (0.3, 0.4, 0.2, 0.1)
    want = {(i, j) for i, a in enumerate(texts) for j, b in enumerate(texts) if sum(w * s for w, s in zip(weights, models.scores(a, b))) > 0.6}
    assert got == want


def test_first_fuzzy_candidates_are_the_smallest_of_all(spark, monkeypatch):
    monkeypatch.setattr(M, "GROWTH", 2)
    monkeypatch.setattr(M, "CROSSED", 6)
    texts = [f"{a} {b}" for a in ("red", "read", "bred", "blue", "x") for b in ("anvil", "anvl", "bolt", "bold")]
    rows = spark.createDataFrame([(k * 7 % 61, texts[k * k % 20]) for k in range(61)], "id long, name string")
    p, r = M.prepare(rows.select(F.col("id").alias("query_id"), F.col("name").alias("term")), rows)
    near = {}
    for x in sorted(M.fuzzy(p, r).collect()):
        near.setdefault(x.query_id, []).append(x.id)
    for most in (2, 5):
        got = {(x.query_id, x.id) for x in M.fuzzy(p, r, most=most).collect()}
        assert got == {(q, i) for q, ids in near.items() for i in ids[:most]}


def test_alike_names_are_paired_until_enough_are_found(spark, monkeypatch):
    monkeypatch.setattr(M, "_met", lambda *_: pytest.fail("all names are paired"))
    rows = spark.createDataFrame([(k, f"Firm number {k:04}") for k in range(300)], "id long, name string")
    got = M.find_duplicates(rows.select(F.col("id").alias("query_id"), F.col("name").alias("term")), rows).groupBy("query_id").count().collect()
    assert len(got) == 300 and all(r["count"] == 10 for r in got)


def test_one_strategy_needs_no_other(spark, monkeypatch):
    p, r = M.prepare(probes(spark, "Acme Corporation", "m"), records(spark))
    want = {(x.query_id, x.id) for x in M.candidates(p, r).collect() if "normalized" in x.matched_by}
    monkeypatch.setattr(M, "fuzzy", lambda *_, **__: pytest.fail("fuzzy"))
    assert want == {(0, 1)} == {(x.query_id, x.id) for x in M.candidates(p, r, strategies=("normalized",)).collect()}


def test_limits_thresholds_and_duplicates(spark):
    some = probes(spark, "Cafe Industries")
    assert [r.rank for r in M.find_matches(some, records(spark), M.Search(limit=2)).collect()] == [1, 2]
    assert all(r.confidence in ("HIGH", "MEDIUM") for r in M.find_duplicates(some, records(spark)).collect())
    assert M.find_matches(some, records(spark), M.Search(min_confidence="HIGH")).count() == 2
    assert M.search_key(' a+b "c" ') == r"a\+b \"c\""
    assert "HIGH confidence" in M.format_matches(M.find_matches(some, records(spark), M.Search(limit=1)).collect())


def catalog(spark):
    objects = spark.createDataFrame([("Account", True, True), ("Contact", True, True), ("Locked", False, False)], "name string, is_createable boolean, is_updateable boolean")
    pick = [{"label": v, "value": v} for v in ("Agriculture", "Technology", "Finance")]
    fields = [
        ("Account", "Name", "Account Name", "string", 255, None, None, True, None, None, None),
        ("Account", "Industry", "Industry", "picklist", None, None, None, False, None, pick, None),
        ("Account", "AnnualRevenue", "Revenue", "currency", None, 8, 2, False, None, None, None),
        ("Account", "NumberOfEmployees", "Employees", "int", None, None, 0, False, None, None, None),
        ("Account", "OwnerId", "Owner", "reference", None, None, None, True, None, None, ["Contact"]),
        ("Contact", "LastName", "Last Name", "string", 80, None, None, True, None, None, None),
        ("Contact", "Level", "Level", "string", 80, None, None, True, "1", None, None),
        ("Contact", "AccountId", "Account", "reference", None, None, None, True, None, None, ["Account", "Nowhere", "Contact", "Account"]),
    ]
    schema = f"sobject string, name string, label string, type string, length int, precision_val int, scale int, is_required boolean, default_value string, picklist_values {C.PICKLIST}, reference_to array<string>"
    out = C.put(C.put(C.empty(spark), "sobjects", objects), "fields", spark.createDataFrame(fields, schema))
    out = C.put(out, "relationships", C.relationships_from(out["fields"], out["sobjects"]))
    return C.put(out, "validation_rules", spark.createDataFrame([("Account", "a", True), ("Account", "b", False)], "sobject string, name string, active boolean"))


def issues(spark, sobject, data, mode="create"):
    rows = spark.createDataFrame([(1, sobject)], "row_id long, object string")
    js = lambda v: None if v is None else "number" if isinstance(v, (int, float)) and not isinstance(v, bool) else "boolean" if isinstance(v, bool) else "string"
    values = spark.createDataFrame([(1, sobject, k, None if v is None else str(v).lower() if isinstance(v, bool) else str(v), js(v)) for k, v in data.items()], "row_id long, object string, field string, value string, js_type string")
    return {(r.field, r.type): r for r in V.validate(rows, values, catalog(spark), mode).collect()}


def test_validation(spark):
    base = {("__validation_rules__", "VALIDATION_RULES_EXIST")}
    assert set(issues(spark, "Account", {"Name": "A", "Industry": "Technology"})) == base
    assert set(issues(spark, "Account", {"Name": "", "Industry": None})) == base | {("Name", "REQUIRED_FIELD")}
    assert ("Name", "REQUIRED_FIELD") not in issues(spark, "Account", {"Industry": "Finance"}, "update")
    found = issues(spark, "Account", {"Name": "A" * 300, "Industry": "Nope", "NumberOfEmployees": "many", "AnnualRevenue": 1234567.891, "Odd__c": 1, "OwnerId": "x"})
    assert set(found) == base | {("Name", "LENGTH_EXCEEDED"), ("Industry", "INVALID_PICKLIST_VALUE"), ("NumberOfEmployees", "TYPE_MISMATCH"), ("AnnualRevenue", "PRECISION_WARNING"), ("AnnualRevenue", "SCALE_WARNING"), ("Odd__c", "UNKNOWN_FIELD")}
    assert found["Name", "LENGTH_EXCEEDED"].message == "Field 'Account Name' exceeds maximum length of 255 characters (provided: 300)."
    assert found["Industry", "INVALID_PICKLIST_VALUE"].suggestion == "Valid values: Agriculture, Technology, Finance"
    assert set(issues(spark, "Contact", {"FirstName": "x"})) == {("FirstName", "UNKNOWN_FIELD"), ("LastName", "REQUIRED_FIELD"), ("AccountId", "REQUIRED_FIELD"), ("AccountId", "REQUIRED_RELATIONSHIP")}
    assert set(issues(spark, "Contact", {"LastName": "x", "AccountId": "001"})) == {("AccountId", "REFERENCE_CHECK")}
    assert set(issues(spark, "Gone", {"a": "b"})) == {("__sobject__", "METADATA_NOT_FOUND")}
    assert set(issues(spark, "Locked", {"a": "b"})) == {("__sobject__", "CRUD_PERMISSION")}
    assert V.summary([r.asDict() for r in found.values()]).startswith("Validation FAILED\nErrors (3):")


def test_verdicts_and_sinks(spark):
    rows = spark.createDataFrame([(1, "Account"), (2, "Account")], "row_id long, object string")
    wide = spark.createDataFrame([(1, "A"), (2, None)], "row_id long, Name string")
    findings = V.validate(rows, V.long_form(wide, "row_id", "Account"), catalog(spark), "create")
    assert {r.row_id: r.valid for r in V.verdicts(rows, findings).collect()} == {1: True, 2: False}
    good, bad = sinks.split(wide, findings, "row_id")
    assert [r.row_id for r in good.collect()] == [1] and [r.row_id for r in bad.collect()] == [2]
    changed = sinks.updated(wide, spark.createDataFrame([(2, "B"), (1, None)], "row_id long, Name string"), "row_id")
    assert sorted(map(tuple, changed.collect())) == [(1, "A"), (2, "B")]
    assert sinks.deleted(wide, wide.where("row_id = 1"), "row_id").count() == 1


def test_reference_to_a_record_numbered_zero(spark):
    objects = spark.createDataFrame([("doc",), ("label",)], "name string")
    fields = spark.createDataFrame([("doc", "of", "Of", "reference", ["label"])], "sobject string, name string, label string, type string, reference_to array<string>")
    known = C.put(C.put(C.empty(spark), "sobjects", objects), "fields", fields)
    known = C.put(known, "relationships", C.relationships_from(known["fields"], known["sobjects"]))
    big = 2**53
    docs = spark.createDataFrame(list(enumerate([0, 1, None, big, big + 1, -5])), "k long, of long")

    def lost(keys, kind="long"):
        labels = spark.createDataFrame([(k,) for k in keys], f"id {kind}")
        return {(r.row_id, r.message) for r in V.check_references(V.long_form(docs, "k", "doc"), known, {"label": (labels, "id")}).collect()}

    assert lost([1, big + 1, None]) == {(k, f"No label record with ID '{v}'.") for k, v in ((0, 0), (3, big), (5, -5))}
    assert {k for k, _ in lost([0.0, 1.0, -5.0], "double")} == {3, 4}


def test_catalog(spark):
    c = catalog(spark)
    rels = {(r.from_sobject, r.field_name): r.to_sobject for r in C.get_relationships(c).collect()}
    assert rels == {("Account", "OwnerId"): "Contact", ("Contact", "AccountId"): "Account"}
    assert C.stats(c).first().asDict() == {"sobjects": 3, "fields": 8, "validation_rules": 2, "relationships": 2}
    assert C.get_required_fields(c, "Account").count() == 2 and C.get_rules(c, "Account").count() == 1
    assert c["fields"].where("name = 'NumberOfEmployees'").first().scale is None  # zero is kept as null
    again = C.put(c, "sobjects", spark.createDataFrame([("Account", "New")], "name string, label string"))
    assert again["sobjects"].where("name = 'Account'").first().label_plural == "New" and again["sobjects"].count() == 3
    assert C.clear(c)["fields"].count() == 0 and C.get_objects(c, []).count() == 0
    assert "synced_at" in C.migrate(spark.createDataFrame([("a",)], "name string")).columns
    described = spark.createDataFrame([(n, True, True, n.endswith("__c"), k) for k, n in enumerate(["Zed", "Task", "Account", "Own__c", *[f"O{i}" for i in range(30)]])], "name string, is_queryable boolean, is_createable boolean, is_custom boolean, position int")
    names = [r.name for r in C.standard_objects(described).orderBy("rank").collect()]
    assert names[:3] == ["Account", "Task", "Zed"] and len(names) == 22
    rules = spark.createDataFrame([("r", "01Ia", True), ("s", "01Ib", True), ("t", "01Ia", False)], "name string, entity_id string, active boolean")
    assert [r.sobject for r in C.rules_from(rules, spark.createDataFrame([("01Ia", "Account"), ("x", "No")], "id string, name string")).collect()] == ["Account"]


def test_freshness(spark):
    names = spark.createDataFrame([("a",), ("b",), ("c",), ("d",)], "name string")
    synced = spark.createDataFrame([("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 12:00:00"), ("c", None)], "name string, at string").select("name", F.col("at").cast("timestamp").alias("synced_at"))
    as_of = F.lit("2024-01-02 00:00:00").cast("timestamp")
    assert {r.name for r in A.stale(names, synced, as_of).collect()} == {"c", "d"}
    assert {r.name for r in A.stale(names, synced, as_of, A.DAY_MS - 1).collect()} == {"a", "c", "d"}
    rels = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d")], "from_sobject string, to_sobject string")
    start = names.where("name = 'a'")
    assert {r.name: r.steps for r in A.related(start, rels, 2).collect()} == {"a": 0, "b": 1, "c": 2}
    assert {r.name for r in A.related(start, rels, 0).collect()} == {"a"}


def test_dependencies(spark):
    ops = O.operations_frame(spark, [
        {"type": "create", "sobject": "Contact", "data": {"AccountId": "@acct1", "Name": "c"}},
        {"type": "create", "sobject": "Account", "temp_id": "@acct1", "data": {"Name": "a"}},
        {"type": "create", "sobject": "Task", "data": {"WhatId": "@acct1", "Other": "@nobody"}},
        {"type": "create", "sobject": "Account", "temp_id": "@acct1", "data": {"Name": "same name, later"}},
    ])
    levels, broken = G.resolve(ops)
    assert {r.op: r.level for r in levels.collect()} == {0: 1, 1: 0, 2: 1, 3: 0} and broken.count() == 0
    plan = {r.level: (r.node_ids, r.can_parallelize) for r in G.plan(ops, levels).collect()}
    assert plan == {0: (["op_1", "op_3"], True), 1: (["op_0", "op_2"], True)}
    ids = spark.createDataFrame([("@acct1", "001")], "temp_id string, record_id string")
    got = {r.op: r for r in G.resolved_data(ops, ids).collect()}
    assert got[0].data == {"AccountId": "001", "Name": "c"} and got[2].errors == ["Cannot resolve reference @nobody in Other"]


def ring(n, required=()):
    return [{"type": "create", "sobject": f"S{k}", "temp_id": f"@{k}", "data": {"next": f"@{(k + 1) % n}"}} for k in range(n)]


@pytest.mark.parametrize("closed", [0, 2000])
def test_cycles_are_the_strongly_connected_components(spark, closed):
    # Two rings joined by a node smaller than either, a loop, a chain, and a repeated link.
    links = [(5, 6), (6, 7), (7, 5), (7, 1), (1, 8), (8, 9), (9, 8), (9, 8), (3, 3), (9, 3), (10, 11), (11, 12)]
    got = {r.op: r.cycle for r in G.cycles(spark.createDataFrame(links, "from_op long, to_op long"), closed).collect()}
    assert got == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 3: 3}
    assert G.cycles(spark.createDataFrame([(1, 2), (2, 3)], "from_op long, to_op long"), closed).count() == 0


@pytest.mark.parametrize("n", [1, 2, 3])
def test_cycles_are_broken_or_refused(spark, n):
    ops = O.operations_frame(spark, ring(n))
    free = spark.createDataFrame([(f"S{k}", "next", k != 0) for k in range(n)], "from_sobject string, field_name string, is_required boolean")
    levels, broken = G.resolve(ops, free)
    assert [(r.to_op, r.field) for r in broken.collect()] == [(0, "next")]
    assert {r.op: r.level for r in levels.collect()} == {k: (n - k) % n for k in range(n)}
    with pytest.raises(G.UnbreakableCycle):
        G.resolve(ops, free.withColumn("is_required", F.lit(True)))


def test_execution(spark):
    given = [{"type": "create", "sobject": "Contact", "data": {"AccountId": "@a"}}, {"type": "create", "sobject": "Account", "temp_id": "@a", "data": {"Name": "x"}}]
    store = O.MemoryStore()
    out = O.execute(spark, given, store)
    assert out["success"] and out["type"] == "multi" and out["n_success"] == 2
    assert list(store.records["Contact"].values()) == [{"AccountId": "000000000000001"}]
    out = O.execute(spark, given, O.MemoryStore(fail=["Account"]))
    assert not out["success"] and out["n_success"] == 0 and len(out["errors"]) == 1
    assert O.execute(spark, given[1], O.MemoryStore())["type"] == "single"
    assert not O.execute(spark, [{"type": "update", "sobject": "A", "data": {"x": "y"}}], O.MemoryStore())["success"]
    with pytest.raises(ValueError):
        O.route([])


def test_broken_references_are_set_afterwards(spark):
    c = C.Catalog({**C.empty(spark).tables})
    c = C.put(c, "sobjects", spark.createDataFrame([("S0",), ("S1",)], "name string"))
    c = C.put(c, "fields", spark.createDataFrame([("S0", "next", ["S1"], False), ("S1", "next", ["S0"], True)], "sobject string, name string, reference_to array<string>, is_required boolean"))
    c = C.put(c, "relationships", C.relationships_from(c["fields"], c["sobjects"]))
    store = O.MemoryStore()
    out = O.execute(spark, ring(2), store, c)
    assert out["success"] and store.records == {"S0": {"000000000000001": {"next": "000000000000002"}}, "S1": {"000000000000002": {"next": "000000000000001"}}}


def test_search_statements(spark):
    find = Q.parse_find(r"FIND {*a\+b*} IN ALL FIELDS RETURNING Account(Id, Name), Contact LIMIT 5")
    assert find == Q.Find("a+b", "wildcard", (("Account", ("Id", "Name")), ("Contact", ())), 5)
    assert [Q.parse_find(f"FIND {{{t}}}").mode for t in ("x", "x*", "*x*", "x~")] == ["exact", "prefix", "wildcard", "fuzzy"]
    with pytest.raises(ValueError):
        Q.parse_find("SELECT 1")
    with pytest.raises(ValueError, match="Query execution failed"):
        Q.query(spark, " ")


def test_tools(spark):
    spark.createDataFrame([(1, "Acme", 2.0), (2, "Beta", None)], "Id long, Name string, Size double").createOrReplaceTempView("Firm")
    tools = Tools(spark)
    assert tools.call("query", {"query": "SELECT count(*) AS n FROM Firm"}).first().n == 2
    assert tools.call("get_record", {"object": "Firm", "id": 2, "fields": ("Name",)}).first().asDict() == {"Name": "Beta"}
    assert tools.call("create_record", {"object": "Firm", "data": {"Id": 3, "Name": "C"}}).count() == 3
    assert tools.call("update_record", {"object": "Firm", "id": 2, "data": {"Size": 5}}).where("Id = 2").first().Size == 5.0
    assert tools.call("delete_record", {"object": "Firm", "id": 2}).count() == 1
    assert tools.call("describe_object", {"object": "Firm"}).count() == 3
    assert tools.call("search", {"search_string": "FIND {ac*} RETURNING Firm(Id)"})["Firm"].first().Id == 1
    assert tools.call("sync_metadata", {"objects": ["Firm"]}).first().n_fields == 3
    assert tools.call("test_connection", {}).first().success and tools.call("limits", {}).count() == 3
    for name, args, code in (("nope", {}, "UNKNOWN_TOOL"), ("query", None, "INVALID_INPUT"), ("query", {"query": ""}, "VALIDATION_ERROR")):
        with pytest.raises(ToolError) as e:
            tools.call(name, args)
        assert e.value.answer()["code"] == code
    spark.catalog.dropTempView("Firm")


def test_stream(spark, tmp_path):
    from recordlens.streaming import intake

    spark.createDataFrame([(1, "Acme Corp", "2024-01-01 00:00:00"), (1, "Acme Corp", "2024-01-01 00:00:01"), (2, "zzz", "2024-01-01 00:00:02")], "query_id long, term string, t string").withColumn("t", F.col("t").cast("timestamp")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("query_id long, term string, t timestamp").parquet(str(tmp_path / "in"))
    seen = []
    once = intake.without_repeats(stream, ["query_id"], "t", "10 minutes")
    intake.match_stream(once, records(spark), lambda df, n: seen.extend(df.collect()), str(tmp_path / "ckpt"), M.Search(min_confidence="HIGH")).awaitTermination()
    assert [(r.query_id, r.name) for r in seen if r["rank"] == 1] == [(1, "Acme Corp")]


def test_search_scope_and_errors(spark):
    spark.createDataFrame([(1, "Acme", "x"), (2, "Beta", "acme")], "Id long, FirmName string, Note string").createOrReplaceTempView("Scoped")
    assert [r.Id for r in Q.search(spark, "FIND {acme} IN NAME FIELDS RETURNING Scoped(Id)")["Scoped"].collect()] == [1]
    assert sorted(r.Id for r in Q.search(spark, "FIND {acme} IN ALL FIELDS RETURNING Scoped(Id)")["Scoped"].collect()) == [1, 2]
    with pytest.raises(ValueError, match="Query execution failed"):
        Q.query(spark, "SELECT nothing FROM no_such_table")


def firm_catalog(spark):
    c = C.put(C.empty(spark), "sobjects", spark.createDataFrame([("Firm", True, True)], "name string, is_createable boolean, is_updateable boolean"))
    pick = [{"label": "One", "value": "1"}]
    return C.put(c, "fields", spark.createDataFrame([("Firm", "Name", "Name", "string", 10, True, None), ("Firm", "Kind", "Kind", "picklist", None, False, pick)], f"sobject string, name string, label string, type string, length int, is_required boolean, picklist_values {C.PICKLIST}"))


def test_single_operations_are_checked(spark):
    c, store = firm_catalog(spark), O.MemoryStore()
    known = spark.createDataFrame([(1, "Acme Corp"), (2, "Other")], "id long, name string")
    out = O.execute(spark, {"type": "create", "sobject": "Firm", "data": {"Name": "Acme Corp", "Kind": "1", "More": 2}}, store, c, records={"Firm": known})
    assert out["success"] and out["warnings"][0].startswith("POTENTIAL DUPLICATE: Found 1") and "100.0% match" in out["warnings"][1] and any("More" in w for w in out["warnings"])
    out = O.execute(spark, {"type": "create", "sobject": "Firm", "data": {"Kind": 1}}, store, c)
    assert not out["success"] and not out["results"] and len(store.records["Firm"]) == 1
    assert {e["phase"] for e in out["errors"]} == {"validation"} and any("picklist" in e["message"] for e in out["errors"]) and any("missing" in e["message"] for e in out["errors"])
    assert not O.execute(spark, {"type": "update", "sobject": "Firm", "record_id": "1", "data": {"Name": "x" * 11}}, store, c)["success"]
    assert not O.execute(spark, {"type": "create", "sobject": "Unknown", "data": {}}, store, c)["success"]


def test_levels_run_with_a_plan_and_ensured_metadata(spark):
    from recordlens.plans.cache import MetadataCache

    at = ["2024-01-01 00:00:00"]
    a, b = spark.createDataFrame([], "Id long, Name string"), spark.createDataFrame([], "Id long, Account long")
    cache = MetadataCache(spark, {"Account": a, "Contact": b, "Broken": lambda: spark.table("no_such_table")}, {("Contact", "Account"): ["Account"]}, now=lambda: at[0])
    out = O.execute(spark, [{"type": "create", "sobject": "Contact", "data": {"Account": "@a"}}, {"type": "create", "sobject": "Account", "temp_id": "@a", "data": {"Name": "x"}}, {"type": "create", "sobject": "Account", "data": {"Name": "y"}}], O.MemoryStore(), cache=cache)
    assert out["success"] and [(p["operations"], p["can_parallelize"]) for p in out["plan"]] == [(["op_1", "op_2"], True), (["op_0"], False)]
    assert cache.is_cached("Account") and cache.is_cached("Contact") and cache.age_ms("Account") == 0 and cache.age_ms("Nothing") is None
    stats = cache.stats().first()
    assert (stats.total_objects, stats.core_objects_cached, stats.total_fields, stats.total_relationships) == (2, 2, 4, 1)
    at[0] = "2024-01-02 01:00:00"
    assert not cache.is_cached("Account") and cache.initialize() == ["Account", "Contact"] and cache.initialize() == []
    cache.set_ttl(10)
    assert cache.refresh() == ["Account", "Contact"] and cache.ensure(["Broken"]) == ["Broken"] and not cache.is_cached("Broken")
    with pytest.raises(ValueError):
        cache.ensure(["Nothing"])
    cache.clear()
    assert cache.stats().first().total_objects == 0


def test_catalog_of_an_organization_and_reports(spark):
    c = C.sync_org(spark, C.sync_org(spark, C.empty(spark), "first", "One"), "second", "Two", "2024-01-01")
    assert [(r.org_id, r.org_name) for r in C.get_org(c).collect()] == [("second", "Two")]
    c, report = C.sync_each(spark, c, {"good": spark.range(1), "bad": lambda: spark.table("no_such_table")})
    assert {(r.object, r.success, r.n_fields, r.error is None) for r in report.collect()} == {("good", True, 1, True), ("bad", False, 0, False)}
    full = C.full_stats(c).first()
    assert (full.sobjects, full.org_id) == (1, "second") and C.full_stats(C.empty(spark)).first().org_id is None
    assert C.get_org(C.clear(c)).count() == 1


def test_tools_validate_what_the_catalog_knows(spark):
    spark.createDataFrame([(1, "Acme")], "Id long, Name string").createOrReplaceTempView("Firm2")
    tools = Tools(spark)
    assert tools.call("sync_metadata", {"objects": ["Firm2", "NoSuchTable"]}).where("success").count() == 1
    assert tools.call("sync_stats", {}).first().fields == 2
    assert tools.call("create_record", {"object": "Firm2", "data": {"Id": 2, "Name": "B"}}).count() == 2
    with pytest.raises(ToolError, match="expects type"):
        tools.call("update_record", {"object": "Firm2", "id": 1, "data": {"Name": 5}})
    spark.catalog.dropTempView("Firm2")


def test_formatted_matches_show_further_fields():
    rows = [{"name": "Acme", "id": 1, "confidence": "HIGH", "score": 1.0, "matched_by": ["exact"], "Phone": "1", "Site": None}]
    assert "   Phone: 1\n" in M.format_matches(rows, ("Phone", "Site", "Other"))
