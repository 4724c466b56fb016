"""Quality rules: a ledger of rule failures, judged later by versioned policies.

``ledger`` reads each text once and keeps, per document, the measurements and
one failure bit per rule. A policy is a name for a set of bits, so a verdict, a
second policy or an ablation never touches the texts again: they are bitwise
operations on one long per document.

Defined cases: a null text counts as empty; an empty text has no words and fails
``few_words``; repeated rows are judged each for itself; an empty table gives
an empty ledger; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow import slices
from .shipping import ship

MEASURES = {
    "n_words": pa.int64(),
    "word_chars": pa.int64(),
    "n_symbols": pa.int64(),
    "n_lines": pa.int64(),
    "n_dup_lines": pa.int64(),
    "n_repeat_words": pa.int64(),
    "n_letters": pa.int64(),
    "n_upper": pa.int64(),
    "n_exclaims": pa.int64(),
    "longest_word": pa.int64(),
}

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class Rule:
    """A rule fails where ``fails`` holds of the measurements. ``bit`` is its place in the ledger and is never given to another rule."""

    bit: int
    name: str
    fails: Callable[[dict[str, int]], bool]


RULES = (
    Rule(0, "few_words", lambda m: m["n_words"] < 50),
    Rule(1, "repeated_windows", lambda m: 100 * m["n_repeat_words"] > 50 * m["n_words"]),
    Rule(2, "symbols", lambda m: 10 * m["n_symbols"] > 3 * m["n_words"]),
    Rule(3, "repeated_lines", lambda m: m["n_lines"] >= 4 and 100 * m["n_dup_lines"] > 30 * m["n_lines"]),
    Rule(4, "capitals", lambda m: 100 * m["n_upper"] > 50 * m["n_letters"]),
    Rule(5, "exclamations", lambda m: 10 * m["n_exclaims"] > 3 * m["n_words"]),
    Rule(6, "word_length", lambda m: m["word_chars"] < 2 * m["n_words"] or m["word_chars"] > 20 * m["n_words"]),
    Rule(7, "no_prose", lambda m: 2 * m["n_letters"] < m["word_chars"]),
    Rule(8, "giant_word", lambda m: m["longest_word"] > 1000),
)

#: Versioned policies: each is the set of rules that reject.
POLICIES = {
    "base-1": ("few_words", "repeated_windows"),
    "shape-1": ("few_words", "repeated_windows", "symbols", "repeated_lines", "word_length", "no_prose"),
    "production-1": tuple(r.name for r in RULES),
}


def mask(policy: str) -> int:
    """The bits of a policy's rules."""
    bits = {r.name: 1 << r.bit for r in RULES}
    return sum(bits[name] for name in POLICIES[policy])


def measure(text: str | None) -> dict[str, int]:
    """All measurements of one text."""
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()  # of bytes: at the six ASCII spaces only
    n = len(words)
    filled = [x for x in data.split(b"\n") if x.strip()]
    out = {
        "n_words": n,
        "word_chars": len(text) - sum(map(text.count, SPACES)),
        "n_symbols": sum(map(text.count, SYMBOLS)),
        "n_lines": len(filled),
        "n_dup_lines": len(filled) - len(set(filled)),
        "n_repeat_words": 0,
        "n_exclaims": text.count("!"),
        "longest_word": max(map(len, words), default=0),
    }
    if n >= 4:
        known: dict[bytes, int] = {}
        ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
        pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1]
        _, which, often = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)
        again = often[which] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= again
        out["n_repeat_words"] = int(covered.sum())
    codes = np.frombuffer(data, np.uint8)
    plain = np.count_nonzero(((codes | 32) >= 97) & ((codes | 32) <= 122))
    upper = np.count_nonzero((codes >= 65) & (codes <= 90))
    if not text.isascii():
        others = [c for c in text if c > "\x7f" and c.isalpha()]
        plain += len(others)
        upper += sum(map(str.isupper, others))
    out["n_letters"], out["n_upper"] = int(plain), int(upper)
    return out


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches):
        found = [measure(t) for t in part.column(1).to_pylist()]
        bits = [fail_bits(m) for m in found]
        columns = [pa.array([m[k] for m in found], kind) for k, kind in MEASURES.items()]
        yield pa.RecordBatch.from_arrays([part.column(0), *columns, pa.array(bits, pa.int64())], names=["doc_id", *MEASURES, "fail_bits"])


def ledger(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, the measurements, and fail_bits with a bit for each failed rule."""
    ship(docs.sparkSession)
    schema = "doc_id long, " + ", ".join(f"{k} long" for k in MEASURES) + ", fail_bits long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_rows, schema)


@F.arrow_udf(T.LongType())
def _fail_bits(text: pa.Array) -> pa.Array:
    return pa.array([fail_bits(measure(t)) for t in text.to_pylist()], pa.int64())


def fail_bits(measures: dict[str, int]) -> int:
    return sum(1 << r.bit for r in RULES if r.fails(measures))


def accepted(docs: DataFrame, policy: str = "production-1") -> DataFrame:
    """The rows of ``docs``, with all their columns, that a policy keeps."""
    ship(docs.sparkSession)
    return docs.where(_fail_bits(F.col("text").cast("string")).bitwiseAND(F.lit(mask(policy))) == 0)


def judge(rows: DataFrame, policy: str = "production-1") -> DataFrame:
    """The ledger with ``kept`` (no rule of the policy failed) and the policy's name."""
    return rows.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0).withColumn("policy", F.lit(policy))


def patterns(rows: DataFrame) -> DataFrame:
    """How many documents have each set of failures: at most two to the number of rules, whatever the corpus."""
    return rows.groupBy("fail_bits").agg(F.count("*").alias("n_docs"))


def ablate(rows: DataFrame, policy: str = "production-1") -> DataFrame:
    """For each rule of a policy: how many documents fail it, and how many only it (they would stay without the rule).

    ``only_by`` is the bitwise OR of all other failures among its documents, as a
    hint which rules overlap with it.
    """
    spark = rows.sparkSession
    used = spark.createDataFrame([(r.name, 1 << r.bit) for r in RULES if r.name in POLICIES[policy]], "rule string, bit long")
    seen = patterns(rows).withColumn("in_policy", F.col("fail_bits").bitwiseAND(F.lit(mask(policy))))
    hit = F.col("in_policy").bitwiseAND(F.col("bit")) != 0
    return (
        seen.join(F.broadcast(used), hit)
        .groupBy("rule")
        .agg(
            F.sum("n_docs").alias("n_failed"),
            F.sum(F.when(F.col("in_policy") == F.col("bit"), F.col("n_docs")).otherwise(0)).alias("n_only_this"),
            F.bit_or(F.col("in_policy").bitwiseXOR(F.col("bit"))).alias("overlaps"),
        )
    )
