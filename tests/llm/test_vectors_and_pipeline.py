import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from recordlens.llm import ann


def plain_nearest(rows, k=5):
    """query -> [(id, cosine)], ties to smaller ids."""
    units = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    out = {}
    for q, u in units.items():
        if q % 50 == 0:
            out[q] = sorted(((i, float(u @ w)) for i, w in units.items() if i != q), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_hilbert_places_are_a_walk_through_the_grid():
    cells = np.array([(a, b, c) for a in range(8) for b in range(8) for c in range(8)])
    places = ann.hilbert(cells, 3)
    walk = cells[np.argsort(places)]
    assert sorted(places) == list(range(512)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_small_tables_are_searched_whole(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(260)]
    same = rows[0][1]
    rows += [(i, same) for i in range(260, 330)]
    odd = [(1000, None), (1050, [0.0] * 8), (1100, [float("nan")] + [1.0] * 7), (1150, [None] + [1.0] * 7), (1200, [float("inf")] * 8), (1250, [1.0, 2.0]), (None, same), (1300, [])]
    table = spark.createDataFrame(rows + odd + rows[:3], "vec_id long, embedding array<float>").withColumns({"window": F.lit(1), "score": F.lit(2), "label": F.lit(3)})
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    want = plain_nearest(rows)
    assert set(got) == set(want)
    for q, near in want.items():
        mine = sorted(got[q])
        assert [x[0] for x in mine] == [1, 2, 3, 4, 5] and [x[1] for x in mine] == [i for i, _ in near]
        assert [x[2] for x in mine] == pytest.approx([s for _, s in near], abs=1e-12)
    assert ann.nearest(table.limit(0)).count() == 0
    assert {r.vec_id for r in ann.nearest(spark.createDataFrame(rows[:3], "vec_id long, embedding array<float>")).collect()} == {1, 2}


def test_recall_of_many_windows(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(10, 32))
    vectors = (centres[rng.integers(0, 10, 3000)] * 0.3 + rng.normal(size=(3000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table, window=150).collect()}
    want = {(q, i) for q, near in plain_nearest(rows).items() for i, _ in near}
    assert len(got & want) >= 0.9 * len(want)


def test_parallel_vectors_tie(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8).astype(np.float32).astype(float)
    rows = [(0, base.tolist())] + [(i, (base * m).tolist()) for i, m in ((1, 3), (2, 7), (3, 2), (4, 1 / 4), (5, 11), (6, 5), (7, 13))]
    rows += [(8 + i, (-base * m).tolist()) for i, m in enumerate((1, 3, 5))] + [(50, [0.0] * 7 + [1e-310])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("query_id = 0").orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(i, 1.0) for i in range(1, 6)]
    assert ann.cosine(rows[0][1], rows[8][1]) == ann.cosine(rows[1][1], rows[9][1]) == -1.0 and ann.cosine([1.0, 0.0], [0.0, 5.0]) == 0.0
    assert ann.cosine([1e300, 1e300], [1e-300, 0.0]) == pytest.approx(0.5**0.5, abs=1e-15)


def test_few_windows_suffice_for_vectors_with_structure(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(60, 32))
    vectors = (centres[rng.integers(0, 60, 6000)] + 0.15 * rng.normal(size=(6000, 32))).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r.query_id, r.vec_id) for r in ann.nearest(table, window=200, reach=1).collect()}
    want = {(q, i) for q, near in plain_nearest(rows).items() for i, _ in near}
    assert len(got & want) >= 0.95 * len(want)


def test_queries_of_a_window_in_parts(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 6)).astype(np.float32))]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, ann.nearest(table, queries_at=2, window=300).collect()))
    monkeypatch.setattr(ann, "ASKED", 40)
    assert sorted(map(tuple, ann.nearest(table, queries_at=2, window=300).collect())) == whole and len(whole) == 3750


def test_pipeline(spark, tmp_path):
    rng = random.Random(3)
    text = lambda n: " ".join(f"word{rng.randrange(3000)}" for _ in range(n))
    passage = text(60)
    good = [f"{text(90)}\n{passage}\n{text(40)}" for _ in range(12)]
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate([*good, "too short", good[0], good[1].replace("word1", "Word1")])]
    path = tmp_path / "sf"
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    now = spark.read.parquet(str(path / "documents.parquet"))
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(path))
        assert out.columns == now.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        seen[name] = now.collect()
    assert {r.doc_id for r in seen["quality_rules"]} == {k for k in range(15) if k != 12}
    texts = {r.doc_id: r.text for r in seen["line_dedup"]}
    assert sum(passage in t for t in texts.values()) == 1 and texts[13] == ""
    assert {r.doc_id for r in seen["near_dedup"]} >= set(range(12))
    packed = corpus_pipeline.run(spark, str(path))
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in seen["source_mixing"]}
