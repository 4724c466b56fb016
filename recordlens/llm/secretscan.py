"""Secret scans over an incremental ledger of blobs.

A text is a blob, named by the SHA-256 of its UTF-8 bytes. The ledger has a row
for every pair of blob and rule version that was scanned, with what was found.
A scan reads only pairs the ledger lacks, each once however many documents
hold the blob; findings then go back to all documents by the blob's name.

Defined cases: a null text is the empty blob; repeated rows each get their
blob's findings; an empty table gives an empty ledger; columns other than
``doc_id`` and ``text`` are ignored. Positions count code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices
from .shipping import ship

#: Kinds in the order in which spans that start together are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "pem", "github", "slack", "jwt")
BASE = KINDS[:3]

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
#: Further kinds: a string without which there is no match, and the pattern.
FURTHER = {
    "pem": ("-----BEGIN ", re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----")),
    "github": ("gh", re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")),
    "slack": ("xox", re.compile(r"xox[abprs]-[A-Za-z0-9-]{10,}")),
    "jwt": ("eyJ", re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")),
}
#: Rule versions: the kinds that each looks for.
VERSIONS = {"base-1": BASE, "full-1": KINDS}

_DIGITS = bytes(120 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

Span = tuple[str, int, int]


def scan(text: str, kinds: tuple[str, ...] = KINDS) -> list[Span]:
    """The spans (kind, start, end) of one text, by start, then kind as listed."""
    out: list[Span] = []
    low = text.lower()
    if "assign" in kinds and any(w in low for w in _WORDS):
        out += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "access" in kinds and "AKIA" in text:
        out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    if "hex" in kinds and b"x" * 24 in text.encode("utf-8", "surrogatepass").translate(_DIGITS):
        out += [("hex", *m.span()) for m in HEX.finditer(text) if len(m[0]) >= 24]
    for kind in kinds:
        if kind in FURTHER and FURTHER[kind][0] in text:
            out += [(kind, *m.span()) for m in FURTHER[kind][1].finditer(text)]
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FINDINGS = "blob string, rule_version string, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(version: str):
    kinds = VERSIONS[version]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for blob, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                spans = scan(text, kinds)
                base = [s for s in spans if s[0] in BASE]
                rows.append((blob, version, *(sum(s[0] == k for s in base) for k in BASE), hashlib.sha256(written(base).encode()).hexdigest(), written(spans)))
            kinds_of = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds_of)], names=[x.split()[0] for x in FINDINGS.split(", ")])

    return run


def blobs(docs: DataFrame) -> DataFrame:
    """doc_id, text (null: empty) and blob for each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("blob", F.sha2("text", 256))


def unseen(docs: DataFrame, version: str, ledger: DataFrame | None = None) -> DataFrame:
    """One row (blob, text) for every blob that the ledger lacks under this rule version.

    Which document speaks for a blob is settled on names alone (the smallest
    doc_id), pre-aggregated; texts move once, to be met with that choice, spread
    by document and not by blob.
    """
    rows = blobs(docs)
    ids = rows.select("blob", F.coalesce("doc_id", F.lit(-(2**63))).alias("id"))
    first = ids.groupBy("blob").agg(F.min("id").alias("id"))
    if ledger is not None:
        first = first.join(ledger.where(F.col("rule_version") == version).select("blob"), "blob", "left_anti")
    chosen = rows.withColumn("id", F.coalesce("doc_id", F.lit(-(2**63)))).join(first.hint("shuffle_hash"), ["id", "blob"], "left_semi")
    return chosen.dropDuplicates(["id", "blob"]).select("blob", "text")  # repeated rows; they are together already


def update(docs: DataFrame, version: str = "full-1", ledger: DataFrame | None = None) -> DataFrame:
    """The new rows of the ledger: findings for every unseen pair of blob and rule version."""
    ship(docs.sparkSession)
    return unseen(docs, version, ledger).mapInArrow(_scanned(version), FINDINGS)


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The ledger kept at ``path``, empty if there is none yet."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], FINDINGS)
    return spark.read.schema(FINDINGS).parquet(path)


def record(docs: DataFrame, path: str, version: str = "full-1") -> DataFrame:
    """Scan what the ledger at ``path`` lacks, append that to it, and return the ledger.

    Each call adds files and touches none that are there: earlier versions of a
    document keep their blobs' rows, and neither they nor blobs that return are scanned again.
    """
    spark = docs.sparkSession
    update(docs, version, stored(spark, path)).write.mode("append").parquet(path)
    return stored(spark, path)


def findings(docs: DataFrame, ledger: DataFrame, version: str = "full-1") -> DataFrame:
    """What the ledger has for every document: doc_id, blob and the columns of the findings."""
    return blobs(docs).select("doc_id", "blob").join(ledger.where(F.col("rule_version") == version), "blob")
