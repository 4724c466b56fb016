"""Plain Python versions of the functions, to compare with."""

import re

from recordlens.functions import normalize as N
from recordlens.functions import similarity as S


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def jaro(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    reach = max(len(a), len(b)) // 2 - 1
    free, hits = list(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(i + reach + 1, len(b))):
            if free[j] == c:
                free[j] = None
                hits.append(c)
                break
    if not hits:
        return 0.0
    order = [y for x, y in zip(free, b) if x is None]
    moved = sum(x != y for x, y in zip(hits, order))
    return (len(hits) / len(a) + len(hits) / len(b) + (len(hits) - moved / 2) / len(hits)) / 3


def jaro_winkler(a, b):
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    a, b = a.lower(), b.lower()
    j, p = jaro(a, b), 0
    while p < min(4, len(a), len(b)) and a[p] == b[p]:
        p += 1
    return j + p * 0.1 * (1 - j)


def grams(s):
    padded = f"  {s.lower()}  "
    return {padded[i : i + 3] for i in range(len(padded) - 2)}


def scores(a, b):
    if not a or not b:
        return 0.0, 0.0, 0.0, 0.0
    same = a == b
    lev = 1.0 if same else 1 - levenshtein(a.lower(), b.lower()) / max(len(a), len(b))
    x, y = grams(a), grams(b)
    tri = 1.0 if same else 2 * len(x & y) / (len(x) + len(y))
    return lev, jaro_winkler(a, b), tri, float(soundex(a) == soundex(b))


def soundex(s):
    if not s:
        return ""
    up = s.upper()
    code = dict(zip(S.SOUNDEX_LETTERS, S.SOUNDEX_DIGITS))
    out, last = up[0], code.get(up[0], "0")
    for c in up[1:]:
        d = code.get(c, "0")
        if d != "0":
            out += d if d != last else ""
            last = d
    return out[:4].ljust(4, "0")


def suffixes(text):
    for key in N.suffix_order():
        text = re.sub(rf"\b{key}\b", N.SUFFIXES[key], text, flags=re.I | re.A)
    return text
