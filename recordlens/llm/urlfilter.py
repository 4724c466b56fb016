"""URL rules by host suffix and path prefix.

Every distinct URL is expanded into expressions, a suffix of its host followed by
a prefix of its path. Expressions meet rules in an equi-join on a short prefix of
their SHA-256 digests; full digests then confirm, and the longest rule wins.
Suffixes have at most as many labels, and prefixes only the lengths, that occur
in the rules, so no rule is missed and the expansion doesn't grow with the URL.

Defined cases: a null URL or one without ``://`` has an empty host and path
and takes the default verdict; a host is lower-cased for A-Z only; an empty path
starts with no rule's path but the empty one; repeated rows are judged each
alike; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of the digest's hexadecimal form that the join compares first.
SHORT = 8
#: Rules up to which their table is sent to every executor (under 4 MB); more are joined by shuffle.
BROADCAST_RULES = 20_000

Rule = tuple[str, str, str]  # allow or block, host, path


def host(url: Column) -> Column:
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(host: Column, path: Column, labels: int, lengths: Sequence[int]) -> Column:
    """All host suffixes of up to ``labels`` labels, each with the path's prefixes of the given lengths."""
    parts = F.split(host, r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))), lambda k: F.array_join(F.slice(parts, -k, k), "."))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, lengths)), lambda n: n <= F.length(path)), lambda n: F.substring(path, F.lit(1), n))
    return F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.concat(s, p))))


def judge(pages: DataFrame, rules: Sequence[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, rule (host and path of the longest that fits, else null) and verdict, a row for each row of ``pages``.

    Of two rules with the same host and path, block wins.
    """
    spark = pages.sparkSession
    urls = pages.select("page_id", host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    if not rules:
        return urls.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})
    rows = [(verdict, h + p, len(h + p), hashlib.sha256((h + p).encode()).hexdigest()) for verdict, h, p in rules]
    table = spark.createDataFrame([(*r, r[3][:SHORT]) for r in rows], "verdict string, rule string, size int, digest string, short string")
    table = F.broadcast(table) if len(rows) <= BROADCAST_RULES else table
    labels = max(h.count(".") + 1 for _, h, _ in rules)
    lengths = sorted({len(p) for _, _, p in rules})
    each = urls.where("host <> ''").select("host", "path").distinct()
    each = each.select("host", "path", F.explode(expressions(F.col("host"), F.col("path"), labels, lengths)).alias("expression"))
    each = each.select("host", "path", F.sha2(F.col("expression"), 256).alias("full")).withColumn("short", F.substring("full", 1, SHORT))
    fits = each.join(table, "short").where(F.col("full") == F.col("digest"))
    best = fits.groupBy("host", "path").agg(F.max(F.struct("size", F.expr("verdict = 'block' AS block"), "rule", "verdict")).alias("best"))
    best = best.select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("ruled"))
    ruled = urls.where("host <> ''").join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("ruled", F.lit(default)).alias("verdict"))
    # However many rows have no host, no join gathers them.
    return ruled.unionByName(urls.where("host = ''").withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)}))
