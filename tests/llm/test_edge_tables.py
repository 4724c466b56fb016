"""Every registered query and every stage on an empty table, and on odd rows with columns whose names operators use."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlens.llm import queries

NAMES = "c_doc c_digest_here n_deleted_lines digest node root key keys gone row a b g at size part place target taken _row _bucket _id _tie shard slot blob spans id fp cell kind new n_entities passes nth n parts d t c length piece host path rule verdict short full expression word page"
NOTE = "a note of some length, and so on; " * 4
ROWS = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one", "b"),
    (5, NOTE, "b"),
    (5, NOTE, "b"),
    (None, "no id here", None),
    (None, "no id here", None),
    (6, " ".join(f"w{k * k % 977}" for k in range(20_000)), "c"),
    (7, "Ünïcode 日本 <|endoftext|> mail jo@x.example.com password=abcdef1 " + " ".join(f"vines{k}" for k in range(90)), "a"),
    (8, " ".join(f"xylo{k}" for k in range(200)), "c"),
]
PAGES = [(1, None), (2, ""), (3, "no scheme"), (4, "http://example.org/es/x?y#z"), (4, "http://example.org/es/x?y#z"), (5, "HTTPS://A.B.EXAMPLE.ORG"), (None, "http:///p"), (6, "x://" + "a." * 3000 + "com/de/" + "p" * 9000)]
VECTORS = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [2.0, 0.0]), (2, None), (3, []), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0]), (8, [-1.0, 0.5]), (None, [1.0, 1.0])]


def clashing(df):
    return df.withColumns({n: F.lit(f"mine {n}") for n in NAMES.split() if n not in df.columns})


@pytest.fixture(scope="module")
def odd(spark):
    return clashing(spark.createDataFrame(ROWS, "doc_id long, text string, source string"))


@pytest.fixture(scope="module", params=["odd", "empty"])
def folder(request, spark, odd, tmp_path_factory):
    path = tmp_path_factory.mktemp(request.param)
    tables = {"documents": odd, "pages": clashing(spark.createDataFrame(PAGES, "page_id long, url string")), "embeddings": clashing(spark.createDataFrame(VECTORS, "vec_id long, embedding array<double>"))}
    for name, df in tables.items():
        (df if request.param == "odd" else df.limit(0)).write.parquet(f"{path}/{name}.parquet")
    return request.param, str(path)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, folder, name):
    kind, path = folder
    got = queries.queries()[name](spark, path)
    found = got.count()
    if kind == "empty":
        assert found == 0 and got.columns
    elif name.startswith("op5"):
        assert found == len(PAGES)
    elif name.startswith("op10"):
        assert [(r.query_id, r["rank"], r.vec_id) for r in got.orderBy("query_id", "rank").collect()] == [(0, 1, 1), (0, 2, 8)]
    elif name.startswith("op2"):
        assert got.where("start = 0").count() == len(ROWS)
    else:
        assert found == len(ROWS)


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stage(spark, odd, name, stage):
    last = name == corpus_pipeline.STAGES[-1][0]
    empty = stage(spark, odd.limit(0), "")
    assert empty.count() == 0
    got = stage(spark, odd, "")
    if last:
        assert got.where("start = 0").count() == len(ROWS)
        return
    assert got.columns == empty.columns == odd.columns
    rows = got.collect()
    names = [n for n in odd.columns if n not in ("doc_id", "text", "source")]
    assert all(r[n] == f"mine {n}" for r in rows for n in names)
    ids = [r.doc_id for r in rows]
    if name == "quality_rules":
        assert sorted(ids) == [7, 8]
    elif name == "line_dedup":
        assert len(ids) == len(ROWS)
    elif name == "near_dedup":
        assert sorted(i or 0 for i in ids) == [0, 1, 4, 5, 6, 7, 8]
