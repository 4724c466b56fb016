import random

import pytest
from pyspark.sql import functions as F

from recordlens.functions import checks as K
from recordlens.functions import normalize as N
from recordlens.functions import similarity as S
from tests import models


def column(spark, texts, make):
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    return [r[1] for r in rows.select("k", make(F.col("t"))).orderBy("k").collect()]


def scored(spark, pairs, weights=None):
    rows = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(pairs)], "k int, a string, b string")
    return rows.select("k", S.composite(F.col("a"), F.col("b"), weights).alias("c")).orderBy("k").select("c.scores.*", "c.score", "c.algorithm").collect()


def test_random_strings_agree_with_the_plain_versions(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcAB d3é") for _ in range(random.randint(0, 9)))
    pairs = [(word(), word()) for _ in range(400)]
    for (a, b), r in zip(pairs, scored(spark, pairs)):
        want = models.scores(a, b)
        assert tuple(r)[:4] == pytest.approx(want), (a, b)
        assert r.score == pytest.approx(want[0] * 0.3 + want[1] * 0.4 + want[2] * 0.2 + want[3] * 0.1)


def test_known_scores(spark):
    known = {
        ("Microsoft Corporation", "Microsoft Corp"): (0.6667, 0.9333, 0.7179, 1, 0.8169),
        ("Google LLC", "Gogle LLC"): (0.9, 0.9733, 0.8696, 1, 0.9332),
        ("Café Inc", "Cafe Inc"): (0.875, 0.9417, 0.7, 1, 0.8792),
        ("Acme Corporation", "Acme Corp"): (0.5625, 0.9125, 0.6207, 1, 0.7579),
        ("John Smith", "Jon Smyth"): (0.8, 0.917, 0.5217, 1, 0.8112),
        ("International Business Machines", "IBM"): (0.0968, 0.6194, 0.0556, 0, 0.2879),
        ("Apple Inc", "Zebra Corp"): (0.1, 0.5315, 0.0, 0, 0.2426),
    }
    for want, r in zip(known.values(), scored(spark, list(known))):
        assert tuple(r)[:5] == pytest.approx(want, abs=6e-5)


def test_edges_of_similarity(spark):
    got = scored(spark, [("", "a"), (None, None), ("x", "x"), ("ACME", "acme"), ("3M", "3M Company")])
    assert [g.score for g in got[:2]] == [0.0, 0.0]
    assert got[2].score == pytest.approx(1.0) and got[3].levenshtein == 1.0 and got[0].algorithm == "LEVENSHTEIN"
    assert column(spark, ["Smith", "Smyth", "Robert", "Rupert", "Tymczak", "Jackson", "3M", "Honeyman", "", None], S.soundex) == ["S530", "S530", "R163", "R163", "T520", "J500", "3500", "H500", "", ""]


def test_custom_weights_replace_some(spark):
    r = scored(spark, [("Google LLC", "Gogle LLC")], {"levenshtein": 1.0})[0]
    assert r.score == pytest.approx(0.9 + 0.9733333 * 0.4 + 0.8695652 * 0.2 + 0.1, abs=1e-6)


NORMALIZED = {
    N.DEFAULT: {"Café": "cafe", "Größe": "grosse", "Straße": "strasse", "São Paulo": "sao paulo", "Łódź": "lodz", "Český": "cesky", "İstanbul": "istanbul"},
    N.COMPANY: {
        "Acme Corporation": "acme corp",
        "Smith Incorporated": "smith inc",
        "ABC Company": "abc co",
        "XYZ Corp.": "xyz corp",
        "Siemens Aktiengesellschaft": "siemens ag",
        "Banco Santander Sociedad Anónima": "banco santander sa",
        "Google Limited Liability Company": "google llc",
        "Łódź Spółka z o.o.": "lodz spolka z o.o",
        "Müller & Söhne GmbH": "muller & sohne gmbh",
        "Acme Corp Holdings": "acme corpholdings",
        " a \t\n b  ": "a b",
        "Inch": "inc",
    },
    N.EMAIL: {"John.Doe@Example.COM": "john.doe@example.com", "info@müller-gmbh.de": "info@muller-gmbh.de"},
    N.PERSON: {"José García": "jose garcia", "Søren Andersen": "soren andersen"},
    N.SEARCH: {'Café "Elite" (Paris)': "cafe elite paris", "Smith & Jones, Ltd.": "smith jones ltd", "100% Pure!": "100 pure", "!!!": ""},
}


@pytest.mark.parametrize("options", list(NORMALIZED), ids=str)
def test_normalized(spark, options):
    assert column(spark, list(NORMALIZED[options]), lambda c: N.normalize(c, options)) == list(NORMALIZED[options].values())


def test_strict_suffixes_take_full_stops_literally(spark):
    strict = N.Options(strict_suffixes=True)
    assert column(spark, ["Acme Corp Holdings", "Inch", "Acme Corp. Holdings"], lambda c: N.normalize(c, strict)) == ["acme corp holdings", "inch", "acme corp holdings"]


def test_suffixes_agree_with_the_plain_version(spark):
    random.seed(5)
    parts = ["acme", "corp", "corp.", "company", "limited", "s.a.", "inc", "x", "pty ltd", "co", "ag.", "holdings"]
    texts = [" ".join(random.choice(parts) for _ in range(random.randint(1, 5))) for _ in range(300)]
    assert column(spark, texts, N.canonical_suffixes) == [models.suffixes(t) for t in texts]


def test_changes_are_told(spark):
    got = column(spark, ["Größe Corporation (x)"], lambda c: N.normalize_with_changes(c, N.SEARCH))[0]
    assert got.normalized == "grosse corp x" and got.changes.diacritics_removed == -1
    assert got.changes.suffixes_normalized == ["corporation → corp"] and got.changes.special_chars_removed == 2


def test_field_names_choose_options():
    assert [N.options_for(f) for f in ("Email", "Name", "AccountName", "FirstName", "Title")] == [N.EMAIL, N.COMPANY, N.COMPANY, N.PERSON, N.SEARCH]


def test_number_text(spark):
    numbers = {100.0: "100", 1.5: "1.5", -0.25: "-0.25", 12345678.9: "12345678.9", 1e21: "1e+21", 0.001: "0.001", 0.0: "0", 123456789012.0: "123456789012"}
    rows = spark.createDataFrame([(float(k),) for k in numbers], "x double")
    assert [r[0] for r in rows.select(K.number_text(F.col("x"))).collect()] == list(numbers.values())


def test_guards():
    for bad in ("", " ", None, 3):
        with pytest.raises(ValueError):
            K.require_query(bad)
    with pytest.raises(ValueError):
        K.require_record_id("short")
    with pytest.raises(ValueError):
        K.require_data({})
    with pytest.raises(ValueError):
        K.require_config({"login_url": "http://x.test", "client_id": "1234567890", "client_secret": "1234567890"})
    assert K.require_config({"login_url": "https://x.test", "client_id": "1234567890", "client_secret": "1234567890"})["api_version"] == "65.0"
