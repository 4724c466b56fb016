from collections import Counter

from pyspark.sql import functions as F

from recordlens.llm import mixing


def test_each_of_equal_rows_takes_what_its_own_place_takes(spark):
    text = " ".join(f"w{i}" for i in range(20))
    rows = [(1, text, "a")] * 9 + [(2, text + " x", "b")] * 30 + [(3, text, None)] * 4 + [(4, text, "a"), (None, text, "a"), (None, text, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    ask = {"block": 8, "shard": 4}
    want = Counter()
    for r in mixing.mix(docs, **ask).collect():
        want[(r.doc_id, r.source)] += r.taken
    got = Counter()
    for r in mixing.mixed_documents(docs, **ask).collect():
        got[(r.doc_id, r.source)] += len(r.text.split())
    assert got == +want
    target = {r.source: round(r.target) for r in mixing.mix(docs, **ask).select("source", "target").distinct().collect()}
    out = mixing.mixed_documents(docs, **ask).groupBy("source").agg(F.sum(F.size(F.split("text", " "))).alias("n"))
    assert {r.source: r.n for r in out.collect()} == target
