import random

import pytest

import corpus_pipeline
from recordlens.llm import minhash


def similarity(x, y):
    sets = []
    for t in (x, y):
        w = t.lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def edited(rng, text, n):
    """The text with n words changed, each in shingles of its own."""
    w = text.split()
    for i in rng.sample(range(4, len(w) - 4, 9), n):
        w[i] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def kept(rows):
    """doc_ids that are the smallest of their component, by all pairs."""
    root = {i: i for i, _ in rows}

    def find(i):
        return i if root[i] == i else find(root[i])

    for k, (i, x) in enumerate(rows):
        for j, y in rows[:k]:
            if similarity(x, y) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i for i in root if root[i] == i}


@pytest.mark.parametrize("largest", [2, 32])
def test_near_copies_at_08_to_095_go(spark, largest):
    rng = random.Random(11)
    texts = []
    for _ in range(20):
        base = " ".join(f"w{rng.randrange(5000)}" for _ in range(404))
        texts += [base, *[edited(rng, base, n) for n in (2, 4, 7, 8, 9, 12, 16)]]
    one = edited(rng, texts[0], 7)
    texts += [one, edited(rng, one, 7), "", "  ", None, "Two words", "two  WORDS", "a b c d e f"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = kept([(i, t or "") for i, t in rows])
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [r.doc_id for r in minhash.representatives(docs, largest).collect()]
    assert sorted(got) == sorted(want)
    if largest == minhash.CELL:
        assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == want
    assert minhash.representatives(docs.limit(0), largest).count() == 0


def test_simhash_gives_candidates_of_its_own(spark, monkeypatch):
    rng = random.Random(17)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(900)) for _ in range(3)]
    rows = [(k, t) for k, t in enumerate([*base, *[f"{t} end" for t in base], f"{base[0]} {base[1]}"])]
    prints = [minhash.simhash.summed(minhash.shingles(t)) for _, t in rows]
    assert all((prints[k] ^ prints[k + 3]).bit_count() <= 4 for k in range(3))
    monkeypatch.setattr(minhash, "_pairs", lambda members: members.select(members.node.alias("u"), members.node.alias("v")).limit(0))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == {0, 1, 2, 6}


def test_a_large_group_of_near_copies_is_met_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", 40)
    rng = random.Random(13)
    base = " ".join(f"w{rng.randrange(5000)}" for _ in range(200))
    rows = [(k, edited(rng, base, rng.randrange(0, 12))) for k in range(160)] + [(1000 + k, f"{base} and {k} more") for k in range(40)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in minhash.representatives(docs, 8).collect()} == kept(sorted(rows))
