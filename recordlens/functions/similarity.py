"""String similarity as Column expressions, all inside the JVM.

In every similarity a null counts as an empty string, an empty side gives 0,
and equal strings give 1 before case is folded. Lengths count code points.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Weights of the four similarities in the composite.
WEIGHTS = {"levenshtein": 0.3, "jaro_winkler": 0.4, "trigram": 0.2, "soundex": 0.1}

#: Soundex digits (fixed values).
SOUNDEX_LETTERS = "BFPVCGJKQSXZDTLMNR"
SOUNDEX_DIGITS = "111122222222334556"

#: Marks a matched character; it must not occur in the strings compared.
_USED = "\x00"


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _bound(value: Column, use) -> Column:
    """``use`` of a value that is computed once."""
    return F.transform(F.array(value), use)[0]


def _pair(a: Column, b: Column, differing) -> Column:
    """0 if a side is empty, 1 if both are equal, else what ``differing`` makes of them."""
    a, b = _text(a), _text(b)
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(differing(a, b))


def levenshtein_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(_text(a), _text(b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    return _pair(a, b, lambda x, y: 1 - F.levenshtein(F.lower(x), F.lower(y)) / F.greatest(F.length(x), F.length(y)))


def _jaro_different(a: Column, b: Column) -> Column:
    """Jaro of two strings that are neither empty nor equal.

    Each character of ``a`` takes the first free equal character of ``b`` within
    the window. Half of the matches out of order are subtracted, unrounded.
    """

    def matched(p: Column) -> Column:
        x, y, reach = p["a"], p["b"], p["reach"]

        def take(state: Column, i: Column) -> Column:
            first = F.greatest(F.lit(1), i - reach)
            window = F.substring(state["free"], first, F.greatest(F.lit(0), F.least(F.length(y), i + reach) - first + 1))
            c = F.substring(x, i, F.lit(1))
            return _bound(
                F.instr(window, c),
                lambda at: F.when(at > 0, F.struct(F.overlay(state["free"], F.lit(_USED), first + at - 1).alias("free"), F.concat(state["hits"], c).alias("hits"))).otherwise(state),
            )

        return F.aggregate(F.sequence(F.lit(1), F.length(x)), F.struct(y.alias("free"), F.lit("").alias("hits")), take)

    def score(p: Column) -> Column:
        def from_state(state: Column) -> Column:
            hits, y = state["hits"], p["b"]
            order = F.array_join(F.transform(F.sequence(F.lit(1), F.length(y)), lambda i: F.when(F.substring(state["free"], i, F.lit(1)) == _USED, F.substring(y, i, F.lit(1))).otherwise("")), "")

            def of(m: Column) -> Column:
                moved = _bound(order, lambda o: F.aggregate(F.sequence(F.lit(1), m), F.lit(0), lambda n, i: n + (F.substring(hits, i, F.lit(1)) != F.substring(o, i, F.lit(1))).cast("int")))
                return F.when(m == 0, F.lit(0.0)).otherwise((m / F.length(p["a"]) + m / F.length(y) + (m - moved / 2) / m) / 3)

            return _bound(F.length(hits), of)

        return _bound(matched(p), from_state)

    reach = F.floor(F.greatest(F.length(a), F.length(b)) / 2).cast("int") - 1
    return _bound(F.struct(a.alias("a"), b.alias("b"), reach.alias("reach")), score)


def jaro(a: Column, b: Column) -> Column:
    """Case-sensitive Jaro similarity."""
    return _pair(a, b, _jaro_different)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro of the lower-cased strings, raised by a tenth of the rest for each of up to four equal first characters."""

    def lowered(x: Column, y: Column) -> Column:
        def of(p: Column) -> Column:
            low, lov = p["x"], p["y"]
            prefix = sum((F.substring(low, 1, k) == F.substring(lov, 1, k)).cast("int") * ((F.length(low) >= k) & (F.length(lov) >= k)).cast("int") for k in range(1, 5))
            return _bound(jaro(low, lov), lambda j: j + prefix * 0.1 * (1 - j))

        return _bound(F.struct(F.lower(x).alias("x"), F.lower(y).alias("y")), of)

    return _pair(a, b, lowered)


def trigrams(c: Column) -> Column:
    """The distinct three-character pieces of the lower-cased string with two spaces on either side."""
    low = F.lower(_text(c))
    padded = F.concat(F.lit("  "), low, F.lit("  "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(low) + 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Dice coefficient of the trigrams."""

    def dice(x: Column, y: Column) -> Column:
        return _bound(F.struct(trigrams(x).alias("x"), trigrams(y).alias("y")), lambda p: 2 * F.size(F.array_intersect(p["x"], p["y"])) / (F.size(p["x"]) + F.size(p["y"])))

    return _pair(a, b, dice)


def soundex(c: Column) -> Column:
    """Four-character code: the first character, upper-cased whatever it is, then digits of further consonants.

    Letters without a digit are passed over and do not separate equal digits.
    """
    up = F.upper(_text(c))
    first = F.substring(up, 1, 1)

    def digits(x: Column) -> Column:
        return F.translate(F.regexp_replace(x, f"[^{SOUNDEX_LETTERS}]", ""), SOUNDEX_LETTERS, SOUNDEX_DIGITS)

    lead = digits(first)
    runs = F.regexp_replace(F.concat(lead, digits(F.substring(up, F.lit(2), F.length(up)))), r"(.)\1+", "$1")
    rest = F.substring(runs, F.length(lead) + 1, F.lit(3))
    return F.when(up == "", F.lit("")).otherwise(F.rpad(F.concat(first, rest), 4, "0"))


def soundex_matches(a: Column, b: Column) -> Column:
    return (_text(a) != "") & (_text(b) != "") & (soundex(a) == soundex(b))


def soundex_similarity(a: Column, b: Column) -> Column:
    return F.when(soundex_matches(a, b), F.lit(1.0)).otherwise(F.lit(0.0))


def scores(a: Column, b: Column) -> Column:
    """Struct of the four similarities."""
    return F.struct(
        levenshtein_similarity(a, b).alias("levenshtein"),
        jaro_winkler(a, b).alias("jaro_winkler"),
        trigram_similarity(a, b).alias("trigram"),
        soundex_similarity(a, b).alias("soundex"),
    )


def weighted(s: Column, weights: Mapping[str, float] | None = None) -> Column:
    """The weighted sum of a struct of scores, added in a fixed order. Given weights replace defaults and are not rescaled."""
    w = {**WEIGHTS, **(weights or {})}
    return s["levenshtein"] * w["levenshtein"] + s["jaro_winkler"] * w["jaro_winkler"] + s["trigram"] * w["trigram"] + s["soundex"] * w["soundex"]


def dominant(s: Column) -> Column:
    """Which score is the highest; of several the first in the order of the struct."""
    top = F.greatest(*[s[k] for k in WEIGHTS])
    label = F.when(s["levenshtein"] == top, "LEVENSHTEIN").when(s["jaro_winkler"] == top, "JARO_WINKLER")
    return label.when(s["trigram"] == top, "TRIGRAM").when(s["soundex"] == top, "SOUNDEX").otherwise("COMPOSITE")


def composite(a: Column, b: Column, weights: Mapping[str, float] | None = None) -> Column:
    """Struct of score, scores and algorithm (the dominant one)."""
    return _bound(scores(a, b), lambda s: F.struct(weighted(s, weights).alias("score"), s.alias("scores"), dominant(s).alias("algorithm")))


def composite_score(a: Column, b: Column, weights: Mapping[str, float] | None = None) -> Column:
    return _bound(scores(a, b), lambda s: weighted(s, weights))
