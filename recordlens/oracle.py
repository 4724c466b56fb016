"""SQL fragments, in DuckDB's dialect, that compute the library's functions independently. ASCII text is assumed."""

from __future__ import annotations

from .functions import normalize as N
from .functions import similarity as S
from .operators import matching as M


def guarded(a: str, b: str, differing: str) -> str:
    return f"(CASE WHEN {a} = '' OR {b} = '' THEN 0::DOUBLE WHEN {a} = {b} THEN 1::DOUBLE ELSE {differing} END)"


def levenshtein(a: str, b: str) -> str:
    return guarded(a, b, f"1 - levenshtein(lower({a}), lower({b}))::DOUBLE / greatest(length({a}), length({b}))")


def trigrams(a: str) -> str:
    return f"list_distinct(list_transform(range(1, length({a}) + 3), lambda i: substr('  ' || lower({a}) || '  ', i, 3)))"


def trigram(a: str, b: str) -> str:
    return guarded(a, b, f"2 * len(list_intersect({trigrams(a)}, {trigrams(b)}))::DOUBLE / (len({trigrams(a)}) + len({trigrams(b)}))")


def soundex(a: str) -> str:
    up = f"upper({a})"
    digits = lambda x: f"translate(regexp_replace({x}, '[^{S.SOUNDEX_LETTERS}]', '', 'g'), '{S.SOUNDEX_LETTERS}', '{S.SOUNDEX_DIGITS}')"
    lead = digits(f"substr({up}, 1, 1)")
    runs = f"{lead} || {digits(f'substr({up}, 2)')}"
    for d in "123456":
        runs = f"regexp_replace({runs}, '{d}+', '{d}', 'g')"
    return f"(CASE WHEN {a} = '' THEN '' ELSE rpad(substr({up}, 1, 1) || substr({runs}, length({lead}) + 1, 3), 4, '0') END)"


def soundex_similarity(a: str, b: str) -> str:
    return f"(CASE WHEN {a} <> '' AND {b} <> '' AND {soundex(a)} = {soundex(b)} THEN 1::DOUBLE ELSE 0::DOUBLE END)"


def jaro_state(a: str, b: str) -> str:
    """'hits|free' after every character of a has looked for a free one of b; ~ marks those taken."""
    w = f"(greatest(length({a}), length({b})) // 2 - 1)"
    lo = f"greatest(1, i - {w})"
    window = f"substr(split_part(acc, '|', 2), {lo}, greatest(0, least(length({b}), i + {w}) - {lo} + 1))"
    at = f"({lo} + instr({window}, c) - 1)"
    taken = f"split_part(acc, '|', 1) || c || '|' || substr(split_part(acc, '|', 2), 1, {at} - 1) || '~' || substr(split_part(acc, '|', 2), {at} + 1)"
    return f"list_reduce(string_split({a}, ''), lambda acc, c, i: CASE WHEN instr({window}, c) > 0 THEN {taken} ELSE acc END, '|' || {b})"


def jaro_from(state: str, a: str, b: str) -> str:
    """Jaro of two different texts from a column with their state."""
    hits = f"split_part({state}, '|', 1)"
    order = f"array_to_string(list_transform(range(1, length({b}) + 1), lambda i: CASE WHEN substr(split_part({state}, '|', 2), i, 1) = '~' THEN substr({b}, i, 1) ELSE '' END), '')"
    moved = f"len(list_filter(range(1, length({hits}) + 1), lambda i: substr({hits}, i, 1) <> substr({order}, i, 1)))"
    return f"(CASE WHEN length({hits}) = 0 THEN 0::DOUBLE ELSE (length({hits})::DOUBLE / length({a}) + length({hits})::DOUBLE / length({b}) + (length({hits}) - {moved} / 2.0::DOUBLE) / length({hits})) / 3 END)"


def pairs_with_scores(pairs: str) -> str:
    """CTEs up to ``s``: columns of ``pairs`` (with a and b) and lev, jw, tri, sdx."""
    prefix = " + ".join(f"(CASE WHEN length(a) >= {k} AND length(b) >= {k} AND substr(lower(a), 1, {k}) = substr(lower(b), 1, {k}) THEN 1 ELSE 0 END)" for k in range(1, 5))
    return f"""
p0 AS ({pairs}),
p1 AS (SELECT *, {jaro_state('lower(a)', 'lower(b)')} AS state FROM p0),
p2 AS (SELECT *, CASE WHEN lower(a) = lower(b) THEN 1::DOUBLE ELSE {jaro_from('state', 'lower(a)', 'lower(b)')} END AS j FROM p1),
s AS (SELECT *, {levenshtein('a', 'b')} AS lev, {guarded('a', 'b', f'j + ({prefix}) * 0.1::DOUBLE * (1 - j)')} AS jw, {trigram('a', 'b')} AS tri, {soundex_similarity('a', 'b')} AS sdx FROM p2)
"""


def composite(weights: dict[str, float] | None = None) -> str:
    w = {**S.WEIGHTS, **(weights or {})}
    return f"(lev * {w['levenshtein']}::DOUBLE + jw * {w['jaro_winkler']}::DOUBLE + tri * {w['trigram']}::DOUBLE + sdx * {w['soundex']}::DOUBLE)"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def diacritics(a: str) -> str:
    out = f"translate({a}, '{N.FOLDED_FROM}', '{N.FOLDED_TO}')"
    for k, v in N.UNFOLDED.items():
        out = f"replace({out}, '{k}', '{v}')"
    return out


def suffixes(a: str) -> str:
    for key in N.suffix_order():
        a = f"regexp_replace({a}, {quoted(rf'(?i)\b{key}\b')}, '{N.SUFFIXES[key]}', 'g')"
    return a


def squeeze(a: str) -> str:
    return rf"trim(regexp_replace(regexp_replace({a}, '\s+', ' ', 'g'), '\.+$', ''))"


def special(a: str) -> str:
    return rf"regexp_replace({a}, '[^a-zA-Z0-9\s]', '', 'g')"


def company(a: str) -> str:
    return squeeze(suffixes(f"lower({diacritics(a)})"))


def person(a: str) -> str:
    return squeeze(f"lower({diacritics(a)})")


def search(a: str) -> str:
    return squeeze(special(suffixes(f"lower({diacritics(a)})")))


def matches(probes: str, records: str) -> str:
    """CTEs up to ``scored``, all scored candidates of (query_id, term) against (id, name), twenty of each strategy at most."""
    names = "[" + ", ".join(f"'{s}'" for s in M.STRATEGIES) + "]"
    return f"""
probes AS (SELECT query_id, term, lower(term) AS tl, {company('term')} AS tn FROM ({probes}) x WHERE trim(term) <> ''),
records AS (SELECT id, name, lower(name) AS nl, {company('name')} AS nn FROM ({records}) x),
texts AS (SELECT DISTINCT tn AS a, nn AS b FROM probes, records WHERE tn <> '' AND nn <> ''),
{pairs_with_scores('SELECT * FROM texts')},
comp AS (SELECT a, b, {composite()} AS base FROM s),
hits AS (
  SELECT query_id, id, 0 AS k FROM probes, records WHERE nl = tl
  UNION ALL SELECT query_id, id, 1 FROM probes, records WHERE starts_with(nl, tl)
  UNION ALL SELECT query_id, id, 2 FROM probes, records WHERE contains(nl, tl)
  UNION ALL SELECT query_id, id, 3 FROM probes JOIN comp ON a = tn JOIN records ON b = nn WHERE base > {M.FUZZY}
  UNION ALL SELECT query_id, id, 4 FROM probes, records WHERE tn <> tl AND tn <> '' AND nl = tn
),
capped AS (SELECT * FROM hits QUALIFY row_number() OVER (PARTITION BY query_id, k ORDER BY id) <= 20),
merged AS (SELECT query_id, id, list_sort(list(k)) AS ks, min(k) AS first_k FROM capped GROUP BY query_id, id),
scored AS (
  SELECT m.query_id, m.id, name, coalesce(base, 0) AS base_score, array_to_string(list_transform(ks, lambda k: {names}[k + 1]), ',') AS matched_by, len(ks) AS n, first_k,
         CASE WHEN len(ks) > 1 THEN least(1.0, coalesce(base, 0) + {M.BOOST}::DOUBLE * (len(ks) - 1)) ELSE coalesce(base, 0) END AS score
  FROM merged m JOIN probes USING (query_id) JOIN records USING (id) LEFT JOIN comp ON a = tn AND b = nn
),
graded AS (SELECT *, CASE WHEN score >= {M.HIGH} THEN 'HIGH' WHEN score >= {M.MEDIUM} THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
                  row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first_k, id) AS rank FROM scored)
"""
