"""Text normalization as Column expressions: diacritics, case, business suffixes, special characters, white space."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters with diacritics, one for one, and those that become two letters.
FOLDED_FROM = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝŸąćęłńśźżĄĆĘŁŃŚŹŻčďěňřšťůžČĎĚŇŘŠŤŮŽğışĞİŞðÐ"
FOLDED_TO = "aaaaaaceeeeiiiinoooooouuuuyyAAAAAACEEEEIIIINOOOOOOUUUUYYacelnszzACELNSZZcdenrstuzCDENRSTUZgisGISdD"
UNFOLDED = {"æ": "ae", "œ": "oe", "ß": "ss", "Æ": "AE", "Œ": "OE", "þ": "th", "Þ": "TH"}

# Business suffixes and what they become.
SUFFIXES = {
    "corporation": "corp",
    "incorporated": "inc",
    "limited": "ltd",
    "company": "co",
    "gesellschaft mit beschränkter haftung": "gmbh",
    "gesellschaft mit beschrankter haftung": "gmbh",
    "aktiengesellschaft": "ag",
    "sociedad anónima": "sa",
    "sociedad anonima": "sa",
    "société anonyme": "sa",
    "societe anonyme": "sa",
    "sociedade anônima": "sa",
    "sociedade anonima": "sa",
    "limited liability company": "llc",
    "limited liability partnership": "llp",
    "public limited company": "plc",
    "corp.": "corp",
    "inc.": "inc",
    "ltd.": "ltd",
    "co.": "co",
    "llc.": "llc",
    "llp.": "llp",
    "plc.": "plc",
    "s.a.": "sa",
    "s.a.r.l.": "sarl",
    "gmbh.": "gmbh",
    "ag.": "ag",
    "limited company": "ltd",
    "pvt ltd": "pvt",
    "private limited": "pvt",
    "pty ltd": "pty",
    "proprietary limited": "pty",
}

_WORD = r"\w"  # ASCII letters, digits and _
_BOUNDARY = f"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"


@dataclass(frozen=True)
class Options:
    """What ``normalize`` does. With ``strict_suffixes`` a full stop in a suffix stands for itself only; without it, for any character."""

    diacritics: bool = True
    lowercase: bool = True
    suffixes: bool = True
    special: bool = False
    whitespace: bool = True
    keep_at: bool = False
    strict_suffixes: bool = False


DEFAULT = Options()
COMPANY = Options()
EMAIL = Options(suffixes=False, keep_at=True)
PERSON = Options(suffixes=False)
SEARCH = Options(special=True)


def fold_diacritics(c: Column) -> Column:
    return reduce(lambda x, pair: F.replace(x, F.lit(pair[0]), F.lit(pair[1])), UNFOLDED.items(), F.translate(c, FOLDED_FROM, FOLDED_TO))


def suffix_order() -> list[str]:
    """Longest first; of the same length, as listed."""
    return sorted(SUFFIXES, key=len, reverse=True)


def suffix_pattern(key: str, strict: bool = False, lowered: bool = False) -> str:
    """Matches a suffix between word boundaries. Unless the text is ``lowered``, in any case; no letter beyond ASCII counts as one within."""
    body = key.replace(".", r"\.") if strict else key
    if not lowered:
        body = "(?i:" + re.sub(r"[^\x00-\x7f]", lambda m: f"[{m[0]}{m[0].upper()}]", body) + ")"
    last = rf"(?!{_WORD})" if key[-1] != "." else f"(?!{_WORD})" if strict else _BOUNDARY
    return f"(?<!{_WORD}){body}{last}"


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it occurs there."""
    return F.transform(F.array(value), use)[0]


def _turned(key: str, strict: bool, lowered: bool) -> Callable[[Column], Column]:
    """Replaces a suffix. In lowered texts the pattern is only tried where the longest plain piece of the suffix is found."""
    pattern, to = suffix_pattern(key, strict, lowered), SUFFIXES[key]
    piece = max(re.split(r"[^\x00-\x7f]|\.", key), key=len)
    if not lowered or len(piece) < 2:
        return lambda x: F.regexp_replace(x, pattern, to)
    return lambda x: _let(x, lambda t: F.when(t.contains(piece), F.regexp_replace(t, pattern, to)).otherwise(t))


def canonical_suffixes(c: Column, strict: bool = False, lowered: bool = False) -> Column:
    """Every suffix in turn, each on the outcome of those before. ``lowered`` texts have no capitals."""
    return reduce(lambda x, key: _turned(key, strict, lowered)(x), suffix_order(), c)


def suffixes_found(c: Column, strict: bool = False) -> Column:
    """Struct of the canonical text and the log of replacements ("key → canonical")."""
    rules = F.array(*[F.struct(F.lit(suffix_pattern(k, strict)).alias("p"), F.lit(SUFFIXES[k]).alias("to"), F.lit(f"{k} → {SUFFIXES[k]}").alias("log")) for k in suffix_order()])
    start = F.struct(c.alias("text"), F.array().cast("array<string>").alias("log"))

    def step(acc: Column, r: Column) -> Column:
        log = F.when(F.regexp_like(acc["text"], r["p"]), F.array_append(acc["log"], r["log"])).otherwise(acc["log"])
        return F.struct(F.regexp_replace(acc["text"], r["p"], r["to"]).alias("text"), log.alias("log"))

    return F.aggregate(rules, start, step)


def squeeze(c: Column) -> Column:
    """White space becomes single spaces, full stops at the very end go, then spaces at both ends."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), r"\.+$", ""))


def drop_special(c: Column, keep_at: bool = False) -> Column:
    """Only ASCII letters, digits and white space stay (and @ if asked for)."""
    return F.regexp_replace(c, rf"(?U)[^a-zA-Z0-9\s{'@' if keep_at else ''}]", "")


def normalize(c: Column, options: Options = DEFAULT) -> Column:
    out = F.coalesce(c, F.lit(""))
    if options.diacritics:
        out = fold_diacritics(out)
    if options.lowercase:
        out = F.lower(out)
    if options.suffixes:
        out = canonical_suffixes(out, options.strict_suffixes, options.lowercase)
    if options.special:
        out = drop_special(out, options.keep_at)
    if options.whitespace:
        out = squeeze(out)
    return F.trim(out)


def normalize_with_changes(c: Column, options: Options = DEFAULT) -> Column:
    """Struct of original, normalized and changes: by how much folding and removal shortened the text, and the suffixes replaced."""
    original = F.coalesce(c, F.lit(""))
    folded = fold_diacritics(original) if options.diacritics else original
    low = F.lower(folded) if options.lowercase else folded
    found = suffixes_found(low, options.strict_suffixes) if options.suffixes else F.struct(low.alias("text"), F.array().cast("array<string>").alias("log"))

    def done(s: Column) -> Column:
        bare = drop_special(s["text"], options.keep_at) if options.special else s["text"]
        changes = F.struct(
            (F.length(original) - F.length(folded)).alias("diacritics_removed"),
            s["log"].alias("suffixes_normalized"),
            (F.length(s["text"]) - F.length(bare)).alias("special_chars_removed"),
        )
        return F.struct(original.alias("original"), F.trim(squeeze(bare) if options.whitespace else bare).alias("normalized"), changes.alias("changes"))

    return F.transform(F.array(found), done)[0]


def options_for(field: str) -> Options:
    """Which options suit a field of this name."""
    low = field.lower()
    if "email" in low:
        return EMAIL
    if "account" in low or low == "name":
        return COMPANY
    if any(x in low for x in ("firstname", "lastname", "fullname")):
        return PERSON
    return SEARCH


def normalize_for(c: Column, field: str) -> Column:
    return normalize(c, options_for(field))
