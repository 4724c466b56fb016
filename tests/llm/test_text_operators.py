import ipaddress
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recordlens.llm import components, linededup, mixing, packing, pii, quality, scratch, secretscan, sharding, simhash, urlfilter
from recordlens.llm.queries import URL_RULES, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = " ".join(f"w{k * k % 977}" for k in range(30_000))

#: Null and empty texts, ties, repeated rows, a very long text, missing ids and sources; further columns with names that operators use.
ODD = [
    (1, None, "a"),
    (2, "", "a"),
    (3, " \n\t ", None),
    (4, "one", "b"),
    (5, "a b c a b c a b c # $ 100%\nx\nx\n\nx", "b"),
    (6, LONG, "c"),
    (7, "Ünïcode 日本 \x85 nbsp\xa0here 'S it's THE End. <|endoftext|>", "c"),
    (7, "Ünïcode 日本 \x85 nbsp\xa0here 'S it's THE End. <|endoftext|>", "c"),
    (None, "no id here", "a"),
    (8, "one", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string, source string")
    return df.withColumns({"shard": F.lit("mine"), "size": F.lit(1), "length": F.lit(2), "a": F.lit(3), "fp": F.lit(4), "row": F.lit(5)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"word{rng.randrange(vocabulary)}" for _ in range(n))


# Quality rules


def plain_base(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    seen, dups = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(covered)


def test_quality_measures(spark, odd):
    rows = quality.judge(quality.ledger(odd)).collect()
    assert len(rows) == len(ODD)
    by = {r.doc_id: r for r in rows}
    for doc, text, _ in ODD:
        r = by[doc]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain_base(text)
        n, _, _, _, repeated = plain_base(text)
        assert bool(r.fail_bits & quality.mask("base-1")) == (n < 50 or 100 * repeated > 50 * n)
        assert r.kept == (r.fail_bits == 0)
    rng = random.Random(1)
    for _ in range(50):
        text = " ".join(rng.choice(["a", "b", "c\n", "#x"]) for _ in range(rng.randrange(40)))
        m = quality.measure(text)
        assert tuple(m[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == plain_base(text)


def test_quality_verdicts_and_ablation(spark):
    rng = random.Random(2)
    good = [prose(rng, 80) for _ in range(5)]
    bad = [g.upper().replace(" ", "!! ") for g in good[:2]] + [good[0].replace(" ", "### "), "too short"]
    docs = spark.createDataFrame(list(enumerate(good + bad)), "doc_id long, text string")
    rows = quality.ledger(docs)
    assert {r.doc_id for r in quality.judge(rows).where("kept").collect()} == set(range(5))
    assert {r.doc_id for r in quality.accepted(docs).collect()} == set(range(5))
    by = {r.rule: r for r in quality.ablate(rows).collect()}
    assert (by["few_words"].n_failed, by["few_words"].n_only_this) == (1, 1)
    assert (by["capitals"].n_failed, by["capitals"].n_only_this) == (2, 0)
    assert by["capitals"].overlaps == 1 << 5 | 1 << 7  # also too few letters
    assert quality.ledger(docs.limit(0)).count() == 0


# Packing


def test_packing_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for _ in range(150):
        capacity = rng.randint(3, 60)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 80))]
        bins = []
        for size in sorted(sizes, reverse=True):
            open_ = [(room, k) for k, room in enumerate(bins) if room >= size]
            if open_:
                bins[min(open_)[1]] -= size
            else:
                bins.append(capacity - size)
        placed = {}
        for length, _, n, first, offset in packing.plan(Counter(sizes), capacity):
            for k in range(n):
                placed.setdefault(first + k, []).append((offset, length))
        for parts in placed.values():
            end = 0
            for offset, length in sorted(parts):
                assert offset == end
                end += length
            assert end <= capacity
        assert sorted(length for parts in placed.values() for _, length in parts) == sorted(sizes) and len(placed) == len(bins)


def test_packing_gives_added_tokens_as_the_tokenizer_does():
    from tokenizers import Tokenizer

    own, chunks = Tokenizer.from_file(vocabulary()), packing.Chunks(vocabulary())
    assert chunks.by_word
    rng = random.Random(2)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", "word", " ", "\n", "É", "7", "'s"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(9))) for _ in range(2000)]
    want = [np.array(own.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(chunks.texts(pa.array(texts))) == want and any(b"\xff\xc0\x00\x00" in w for w in want)


def test_packing_round_trip(spark, odd):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(vocabulary())
    capacity = 64
    packed = packing.pack_documents(odd, vocabulary(), capacity)
    rows = packed.collect()
    want = Counter()
    for doc, text, _ in ODD:
        ids = own.encode(text or "", add_special_tokens=False).ids + [packing.END]
        for piece, at in enumerate(range(0, len(ids), capacity)):
            own_ids = ids[at : at + capacity]
            want[doc, piece, at, len(own_ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own_ids))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    whole = {r.sequence_id: r for r in packing.sequences(odd, packed, vocabulary(), capacity).collect()}
    for r in rows:
        part = bytes(whole[r.sequence_id].ids)[4 * r.offset : 4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32
    assert packing.pack_documents(odd.limit(0), vocabulary()).count() == 0


def test_other_vocabularies_tokenize_whole_texts():
    import pyarrow as pa
    import public_tokenizers

    chunks = packing.Chunks(public_tokenizers.path("byte_bpe_50k.json"))
    assert not chunks.by_word
    assert list(chunks.texts(pa.array(["two words", None]))) == [chunks.encode("two words"), b""]


# Line dedup


def plain_repeats(docs, at_least):
    """For each document the lines in a run of at least so many words that began earlier."""
    first, out = set(), {}
    for doc, text in docs:
        lines = [(k, x.strip(" \t\n\x0b\x0c\r"), len(WORD.findall(x))) for k, x in enumerate(text.split("\n")) if WORD.search(x)]
        gone = set()
        for a in range(len(lines)):
            n = 0
            for b in range(a, len(lines)):
                n += lines[b][2]
                if n >= at_least:
                    run = tuple(x for _, x, _ in lines[a : b + 1])
                    if run in first:
                        gone |= {k for k, _, _ in lines[a : b + 1]}
                    first.add(run)
        out[doc] = gone
    return out


def test_line_dedup_finds_every_repeated_run(spark):
    rng = random.Random(4)
    runs = [[prose(rng, rng.choice([1, 2, 4, 9, 20, 45, 70]), 10**6) for _ in range(rng.randint(1, 30))] for _ in range(6)]
    docs = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += rng.choice(runs) if rng.random() < 0.5 else [prose(rng, rng.randint(0, 60), 10**6)]
        docs.append((doc, "\n".join(lines)))
    docs += [(100, "\n".join(runs[0][:3])), (101, "\n".join([prose(rng, 9, 10**6), *runs[0][-4:]]))]
    docs += [(k, "\n".join([prose(rng, 30, 10**6), *(x for r in runs[:3] for x in r)])) for k in (102, 103)]
    rows, _ = linededup._judged(spark.createDataFrame(docs, "doc_id long, text string"), linededup.RUN, linededup.GRAM)
    gone = {r.doc_id: set(r.gone or ()) for r in rows.select("row.doc_id", "gone").collect()}
    must, may = plain_repeats(docs, linededup.RUN), plain_repeats(docs, linededup.GRAM)
    assert sum(map(len, gone.values())) > 100
    for doc, _ in docs:
        assert set(must[doc]) <= gone[doc] <= set(may[doc])


def test_line_dedup_of_runs_whose_parts_came_first_elsewhere(spark):
    rng = random.Random(8)
    run = [prose(rng, 11, 10**6) for _ in range(12)]
    docs = [(1, "\n".join(run[:4])), (2, "\n".join(run[7:])), (3, "\n".join(run)), (4, "\n".join(["new", *run, "end"]))]
    got = {r.doc_id: r.text for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[4] == "new\nend" and got[1] == docs[0][1] and got[2] == docs[1][1]


def test_line_dedup_simple_and_odd(spark, odd):
    rng = random.Random(5)
    passage, tail, other = prose(rng, 60), "short tail line", [prose(rng, 30, 10**6) for _ in range(4)]
    docs = [(2, f"{other[0]}\n{passage}\n{tail}\n{other[1]}"), (1, f"{passage}\n{tail}"), (3, f"{other[2]}\n\n{passage}  \n{other[3]}\n{passage}"), (4, tail)]
    got = {r.doc_id: r for r in linededup.dedup(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[1].text == docs[1][1] and got[4].text == tail
    assert got[2].text == f"{other[0]}\n{other[1]}" and got[2].n_deleted_lines == 2
    assert got[3].text == f"{other[2]}\n\n{other[3]}"
    out = linededup.dedup(odd)
    assert set(out.columns) == {*odd.columns, "n_deleted_lines"} and Counter(r.text for r in out.collect()) == Counter(t for _, t, _ in ODD)
    assert linededup.dedup(odd.limit(0)).count() == 0


# SimHash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Fingerprint -> smallest fingerprint reachable."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = root[root[p]]
            p = root[p]
        return p

    for p in prints:
        for q in prints:
            if q < p and ((p ^ q) & (2**64 - 1)).bit_count() <= 4:
                a, b = find(p), find(q)
                root[max(a, b)] = min(a, b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("largest", [512, 3])
def test_links_connect_what_brute_force_connects(spark, largest):
    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(30)]
    for _ in range(300):
        p = rng.choice(prints)
        for _ in range(rng.randint(1, 6)):
            p ^= 1 << rng.randrange(64)
        prints.append(p)
    prints = sorted({simhash._signed(p) for p in prints})
    found = dict(map(tuple, components.roots(simhash.links(spark.createDataFrame([(p,) for p in prints], "fp long"), largest)).collect()))
    assert {p: found.get(p, p) for p in prints} == plain_components(prints)


def test_links_of_a_large_group_of_near_copies(spark):
    rng = random.Random(9)
    prints = set()
    for most in (3, 6, 12):  # dense, loose, and mostly apart
        middle = rng.getrandbits(64)
        while len(prints) % 700 or not prints or len(prints) < 700 * {3: 1, 6: 2, 12: 3}[most]:
            p = middle
            for _ in range(rng.randint(1, most)):
                p ^= 1 << rng.randrange(64)
            prints.add(simhash._signed(p))
    prints = sorted(prints)
    table = spark.createDataFrame([(p,) for p in prints], "fp long")
    for largest in (simhash.CELL, 20):
        links = simhash.links(table, largest).collect()
        assert all(((u ^ v) & (2**64 - 1)).bit_count() <= 4 for u, v in links)
        found = dict(map(tuple, components.roots(spark.createDataFrame(links, "u long, v long")).collect()))
        assert {p: found.get(p, p) for p in prints} == plain_components(prints)


def test_links_share_a_cell_in_every_grid():
    rng = random.Random(3)
    for n in (10**5, 10**8, 10**9, 10**11):
        cuts = simhash.grid(n)
        assert sum(b - a for a, b in cuts) == 32
        for _ in range(200):
            p = rng.getrandbits(64)
            q = p ^ sum(1 << b for b in rng.sample(range(64), 4))
            count = lambda x: [(x >> 2 * k & 1) + (x >> 2 * k + 1 & 1) for k in range(32)]
            assert sum(count(p)[a:b] == count(q)[a:b] for a, b in cuts) >= len(cuts) - 4
    assert [len(simhash.grid(n)) for n in (10**5, 10**7, 10**8, 10**11)] == [8, 10, 12, 16]


def test_components_with_hot_nodes(spark):
    rng = random.Random(4)
    edges = [(0, k) for k in range(1, 3000)] + [(k, 5000 + k) for k in range(1, 300)] + [(9000 + k, 9001 + k) for k in range(40)]
    rng.shuffle(edges)
    found = dict(map(tuple, components.roots(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert all(found[v] == 0 for u, v in edges if v < 9000) and all(found[9001 + k] == 9000 for k in range(40)) and 0 not in found


def test_near_duplicates_and_representatives(spark, odd):
    rows = simhash.near_duplicates(odd).collect()
    texts = {}
    for doc, text, _ in ODD:
        texts.setdefault(doc, text)
    for r in rows:
        assert r.fp & (2**64 - 1) == plain_fingerprint(texts[r.doc_id])
    by = {r.doc_id: r.component_id for r in rows}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[8] == 4 and by[7] == 7
    kept = simhash.representatives(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == sorted({(r.component_id or 0) for r in rows})
    assert simhash.near_duplicates(odd.limit(0)).count() == 0
    assert components.roots(spark.createDataFrame([(1, 1), (2, 3), (3, 2)], "u long, v long")).collect() == [T.Row(node=3, root=2)]


# URL filters


def test_url_rules(spark):
    urls = {
        "http://www.x.org/a?b": ("www.x.org", "/a", "org/", "allow"),
        "http://A.Example.ORG/es/1#x": ("a.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/17": ("example.org", "/en/17", "example.org/en/1", "block"),
        "https://example.org/en/2": ("example.org", "/en/2", "org/", "allow"),
        "http://notexample.org": ("notexample.org", "", None, "allow"),
        "x://shop.com/de/": ("shop.com", "/de/", "com/de/", "block"),
        "x://com/fr/": ("com", "/fr/", "com/fr/", "allow"),
        "x://comm/fr/": ("comm", "/fr/", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "a://b://c.org/": ("b:", "//c.org/", None, "allow"),
        "http://h\nost.org/\n": ("h\nost.org", "/\n", "org/", "allow"),
        "http://" + "a." * 3000 + "org/" + "p" * 5000: ("a." * 3000 + "org", "/" + "p" * 5000, "org/", "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    rows = [(k, u, 1, "x") for k, u in enumerate(urls)] + [(0, next(iter(urls)), 1, "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, size int, rule string")
    got = urlfilter.judge(pages, URL_RULES).collect()
    assert len(got) == len(rows)
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == dict(enumerate(urls.values()))
    assert urlfilter.judge(pages.limit(0), URL_RULES).count() == 0
    assert {r.verdict for r in urlfilter.judge(pages, ()).collect()} == {"allow"}


# Secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def plain_secrets(text):
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


def test_secret_spans():
    rng = random.Random(7)
    parts = ["password", "PassWord", "token", "api_key", "ſecret", "=", ": ", '"', "abcdef", "abc", " ", "é", "AKIA", "A1B2C3D4E5F6G7H8", "0123456789abcdef", "\n"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(12)))
        assert secretscan.written([s for s in secretscan.scan(text) if s[0] in secretscan.BASE]) == plain_secrets(text)
    text = "x -----BEGIN RSA PRIVATE KEY----- ghp_" + "z9" * 20
    assert [k for k, _, _ in secretscan.scan(text)] == ["pem", "github"] and secretscan.scan(text, secretscan.BASE) == []


def test_secret_ledger_scans_only_what_is_new(spark, odd):
    first = scratch.cut(secretscan.update(odd), "ledger")
    assert first.count() == len({t or "" for _, t, _ in ODD})
    more = odd.select("doc_id", "text").unionByName(spark.createDataFrame([(20, "token = abcdef1"), (21, "one")], "doc_id long, text string"))
    new = secretscan.update(more, ledger=first).collect()
    assert [(r.n_assign, r.spans) for r in new] == [(1, "assign:0:15")]
    assert secretscan.update(more, "base-1", first).count() == first.count() + 1
    both = first.unionByName(secretscan.update(more, ledger=first))
    assert secretscan.findings(more, both).count() == len(ODD) + 2
    assert secretscan.update(odd.limit(0)).count() == 0


def test_secret_ledger_is_kept_and_appended(spark, odd, tmp_path):
    path = str(tmp_path / "ledger")
    assert secretscan.record(odd.limit(0), path).count() == 0
    blobs = len({t or "" for _, t, _ in ODD})
    assert secretscan.record(odd, path).count() == secretscan.record(odd, path).count() == blobs
    later = spark.createDataFrame([(5, "secret: hunter22"), (1, None)], "doc_id long, text string")
    assert secretscan.record(later, path).count() == blobs + 1
    assert secretscan.record(later, path, "base-1").count() == blobs + 3
    assert [r.spans for r in secretscan.findings(later, secretscan.stored(spark, path)).orderBy("doc_id").collect()] == ["", "assign:0:16"]


def test_secret_scans_read_repeated_rows_once(spark):
    docs = spark.createDataFrame([(None, "token=abcdef")] * 50 + [(1, "token=abcdef")] * 3, "doc_id long, text string")
    assert secretscan.unseen(docs, "full-1").count() == 1 and secretscan.findings(docs, secretscan.update(docs)).count() == 53


# Surrogates


def test_surrogates_are_consistent_and_typed(spark, odd):
    texts = [
        "mail Jo.Doe@Mail.example.com, card 4111111111111111, ip 10.0.0.1 (also jo.doe@mail.example.com).",
        "call +1 (473) 555-2164 or +14735552164; Mr Peter Smith met Ms Anna Smith and Mr PETER SMITH. Господин Иванов.",
        "1234 5678 9012 3456 and 999.1.1.1 and plain 42, no more@ @none",
        "4111111111111111",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace(docs, "key").collect()}
    again = {r.doc_id: r.text for r in pii.replace(docs, "key").collect()}
    other = {r.doc_id: r.text for r in pii.replace(docs, "another").collect()}
    assert {k: r.text for k, r in got.items()} == again != other
    m = re.fullmatch(r"mail (\S+)@(\S+)\.com, card (4\d{15}), ip (\d+\.\d+\.\d+\.\d+) \(also (\S+@\S+\.com)\)\.", got[0].text)
    assert m and m[1][0].isupper() and f"{m[1]}@{m[2]}.com".lower() == m[5] and got[3].text == m[3] != texts[3]
    digits = [int(c) for c in reversed(m[3])]
    assert sum(d if k % 2 == 0 else 2 * d // 10 + 2 * d % 10 for k, d in enumerate(digits)) % 10 == 0
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3})-(\d{4}) or \+1(\d{10}); Mr (\w+) (\w+) met Ms (\w+) (\w+) and Mr (\w+) (\w+)\. Господин ([А-Я][а-я]+)\.", got[1].text)
    assert m and m[1] + m[2] + m[3] == m[4]
    assert m[5].endswith(pii.GIVEN["Latin"]["m"]) and m[7].endswith(pii.GIVEN["Latin"]["f"]) and (m[5].upper(), m[6].upper()) == (m[9], m[10]) and m[6] == m[8]
    assert re.fullmatch(r"1\d{3} \d{4} \d{4} \d{4} and 999\.1\.1\.1 and plain 42, no more@ @none", got[2].text)
    assert not any(x in " ".join(again.values()) for x in ("Smith", "555-2164", "example.com", "4111111111111111", "10.0.0.1"))
    out = pii.replace(odd, "key")
    assert set(out.columns) == {*odd.columns, "n_entities"} and Counter(r.text for r in out.collect()) == Counter(t for _, t, _ in ODD)


def replaced(spark, texts, key="key"):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.replace(docs, key).orderBy("doc_id").collect()]


def test_surrogates_of_persons(spark):
    one, two, three, four, five = replaced(
        spark,
        [
            "Mr Peter Smith came. Mr Smith sat by Mrs Smith. Peter Smith left, Smith's hat stayed; SMITH!",
            "Mrs Anna Müller and Dr Müller. Anna-Lena O'Neil and Frau Anna-Lena O'Neil, Herr von Braun, von Braun.",
            "Ms Kim Lee and Mr Kim Lee, then Kim Lee.",
            "Smith and Peter and Kim Lee are not named here with a title.",
            "Dr Kim Lee. Nothing else About Smithers.",
        ],
    )
    m = re.fullmatch(r"Mr (\w+) (\w+) came\. Mr (\w+) sat by Mrs (\w+)\. (\w+) (\w+) left, (\w+)'s hat stayed; (\w+)!", one)
    assert m and m[1] == m[5] and len({m[2], m[3], m[4], m[6], m[7], m[8].title()}) == 1 and m[8].isupper() and m[2] != "Smith" and m[1] != "Peter"
    m = re.fullmatch(r"Mrs (\w+) (\w+) and Dr (\w+)\. (\w+-\w+) (\w'\w+) and Frau (\w+-\w+) (\w'\w+), Herr von (\w+), von (\w+)\.", two)
    assert m and m[2] == m[3] and m[4] == m[6] and m[5] == m[7] and m[8] == m[9] != "Braun" and m[4][0].isupper() and m[4].split("-")[1][0].isupper() and m[5][2].isupper()
    m = re.fullmatch(r"Ms (\w+) (\w+) and Mr (\w+) (\w+), then (\w+) (\w+)\.", three)
    assert m and m[1] != m[3] and m[1] == m[5] and m[2] == m[4] == m[6] and m[1].endswith(pii.GIVEN["Latin"]["f"]) and m[3].endswith(pii.GIVEN["Latin"]["m"])
    assert four.startswith("Smith and Peter") and re.fullmatch(r"Dr (\w+) (\w+)\. Nothing else About Smithers\.", five)


def test_surrogates_of_numbers(spark):
    texts = ["call 555-123-4567 or 030 1234567", "pay 3782 822463 10005 from DE89 3700 0440 0532 0130 00 or DE89370400440532013000 not DE00 3700 0440 0532 0130 00", "id 078-05-1120", "hosts 192.168.3.4 10.9.8.7 172.20.0.9 127.0.0.1 169.254.7.7 8.8.8.8", "in 2024-05-17, 1234-5678, 12.5.2024, v1.2.3, 100 200 300"]
    valid = "DE89 3704 0044 0532 0130 00"
    texts[1] = texts[1].replace("DE89 3700 0440 0532 0130 00", valid)
    phones, pay, own, hosts, plain = replaced(spark, texts)
    assert plain == texts[4]
    assert re.fullmatch(r"call 5\d\d-\d{3}-\d{4} or 0\d\d \d{7}", phones) and phones != texts[0] and re.fullmatch(r"id 0\d\d-\d\d-\d{4}", own) and own != texts[2]
    m = re.fullmatch(r"pay (3\d{3} \d{6} \d{5}) from (DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}) not DE00 3700 0440 0532 0130 00", pay)
    assert m and m[2].replace(" ", "") == m[3] != valid.replace(" ", "") and int(m[3][4:] + "1314" + m[3][2:4]) % 97 == 1
    ips = hosts.split()[1:]
    nets = [ipaddress.ip_address(x) for x in ips]
    assert ips[0].startswith("192.168.") and ips[1].startswith("10.") and nets[2] in ipaddress.ip_network("172.16.0.0/12") and ips[3].startswith("127.") and ips[4].startswith("169.254.") and not set(ips) & set(texts[3].split())


def test_surrogates_on_generated_documents(spark):
    """Held against the slots that the documents were made of: what is between them stays, and one entity is one surrogate."""
    rng = random.Random(12)
    families, givens = [f"{a}{b}{c}" for a in ("Bra", "Lind", "Mor") for b in ("du", "ke", "ra") for c in ("n", "ss", "lt")], {"Mr": ["Paul", "Karl", "Kim"], "Ms": ["Rita", "Nora", "Kim"]}
    people = [(t, g, f) for t in givens for g in givens[t] for f in families]
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    mails = [f"user{k}@mail{k % 7}.example.com" for k in range(40)]
    phones = [f"+1 (2{number(2)}) {number(3)}-{number(4)}" for _ in range(40)]
    ips = [f"{rng.randrange(11, 100)}.{rng.randrange(256)}.{rng.randrange(256)}.{rng.randrange(256)}" for _ in range(40)]
    filler = ["and so it went on", "the river, 42 of them,", "later\nthat day", "«nothing»"]
    docs, slots = [], []
    for _ in range(150):
        parts, own = [], []

        def put(text, *entity):
            own.append((len(parts), entity))
            parts.append(text)

        title, given, family = rng.choice(people)
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(filler))
            what = rng.randrange(6)
            if what < 3:
                if what != 1 and not any(e[0] == "family" for _, e in own):
                    parts.append(title)
                    put(given, f"given {title}", given)
                    put(family, "family", family)
                elif any(e[0] == "family" for _, e in own):
                    put(family if what else family.upper(), "family", family)
            else:
                x = rng.choice((mails, phones, ips)[what - 3])
                put(x, str(what), x)
        docs.append(" ".join(parts))
        slots.append((parts, own))
    to = {}
    for text, (parts, own), new in zip(docs, slots, replaced(spark, docs)):
        at = dict(own)
        pattern = " ".join(r"([^\n]+?)" if k in at else re.escape(p) for k, p in enumerate(parts))
        m = re.fullmatch(pattern, new)
        assert m, (text, new)
        for got, (k, entity) in zip(m.groups(), sorted(own)):
            assert got.lower() != parts[k].lower() and (got.isupper() == parts[k].isupper())
            to.setdefault(entity, set()).add(got.lower())
    assert all(len(x) == 1 for x in to.values()) and len(to) > 100
    for kind in {e[0] for e in to}:
        own = [next(iter(x)) for e, x in to.items() if e[0] == kind]
        assert len(own) == len(set(own)) and not set(own) & {e[1].lower() for e in to if e[0] == kind}


def test_surrogates_stay_distinct_where_draws_collide(spark):
    values = [(k, f"Mr {a}{b}") for k, (a, b) in enumerate((a, b) for a in "ABCDEFGHIKLMNOP" for b in "aeiou")]
    docs = spark.createDataFrame(values, "doc_id long, text string")  # two-letter names: many draws collide
    got = [r.text for r in pii.replace(docs, "key").collect()]
    assert len(set(got)) == len(values) and not set(got) & {t for _, t in values}


# Sharding


def plain_shuffle(rows, shards, seed):
    """rows: (bucket, id, tie, text). Buckets in order, each by Fisher-Yates, cut into shards."""
    order = []
    for bucket in sorted({r[0] for r in rows}):
        own = sorted((r for r in rows if r[0] == bucket), key=lambda r: r[1:3])
        order += [own[k] for k in np.random.default_rng([seed, bucket]).permutation(len(own))]
    n, out, slots = len(order), [], Counter()
    for k, r in enumerate(order):
        shard = k * shards // n
        out.append((r[1], r[3] or "", shard, slots[shard]))
        slots[shard] += 1
    return sorted(out)


def placed(rows):
    return sorted((-(2**63) if r.doc_id is None else r.doc_id, r.text or "", r.shard, r.slot) for r in rows)


def test_sharding(spark, odd):
    many = odd.unionByName(odd.withColumn("doc_id", F.col("doc_id") + 100)).unionByName(odd.withColumn("doc_id", F.col("doc_id") + 200))
    out = sharding.shuffle(many, shards=4, bucket_bytes=20_000)
    rows = out.collect()
    total = sum(len((r.text or "").encode()) + 1 for r in rows)
    number, tie = F.coalesce("doc_id", F.lit(-(2**63))), sharding._hashed(many, sharding.SEED)
    hashed = many.select(F.pmod(F.xxhash64(F.lit(sharding.SEED + 1), number, tie), F.lit(-(-total // 20_000))), number, tie, "text").collect()
    assert len({r[0] for r in hashed}) > 5 and placed(rows) == plain_shuffle([tuple(r) for r in hashed], 4, sharding.SEED)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    sizes = [len(s) for s in slots.values()]
    assert sorted(slots) == [0, 1, 2, 3] and max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert placed(sharding.shuffle(many.repartition(7), shards=4, bucket_bytes=20_000).collect()) == placed(rows)
    assert sharding.shuffle(odd.limit(0)).count() == 0


def test_sharding_scatters_copies_that_overfill_a_bucket(spark):
    rows = [(None, "the same " * 10)] * 400 + [(k, f"text {k} " * 9) for k in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("more", F.create_map(F.lit("k"), F.lit(1)))
    out = sharding.shuffle(docs, shards=3, bucket_bytes=2_000)
    got = out.collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter(rows) and all(r.more == {"k": 1} for r in got)
    assert sorted((r.shard, r.slot) for r in got) == [(s, k) for s, n in enumerate((234, 233, 233)) for k in range(n)]
    assert placed(sharding.shuffle(docs.repartition(5), shards=3, bucket_bytes=2_000).collect()) == placed(got)
    by_shard = Counter(r.shard for r in got if r.doc_id is None)
    assert all(90 < n < 180 for n in by_shard.values())


def test_sharding_writes_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sharding.write(docs, str(tmp_path / "shards")).columns == ["doc_id", "text", "shard", "slot"] and sharding.write(docs, str(tmp_path / "again")).count() == 0


# Mixing


def plain_targets(sizes, weights=(5, 2, 1)):
    order = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: weights[k % 3] for k, s in enumerate(order)}
    total, out, free = sum(sizes.values()), {}, set(sizes)
    while free:
        left, share = total - sum(out.values()), sum(weight[s] for s in free)
        above = [s for s in free if left * weight[s] / share > 3 * sizes[s]]
        for s in above:
            out[s] = 3.0 * sizes[s]
        free -= set(above)
        if not above:
            out |= {s: left * weight[s] / share for s in free}
            break
    return out


@pytest.mark.parametrize("seed", range(3))
def test_mixing_reaches_its_targets(spark, seed):
    rng = random.Random(seed)
    docs = [(k, prose(rng, rng.choice([0, 1, 30, 300, 1500])), rng.choice(["a", "a", "a", "b", "ä", None, "z"])) for k in range(120)] + [(7, "same row", "b"), (7, "same row", "b"), (None, None, "only nulls")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    rows = mixing.mix(df).collect()
    sizes = {}
    for _, t, s in docs:
        sizes[s] = sizes.get(s, 0) + len(WORD.findall(t or ""))
    want, taken = plain_targets(sizes), Counter()
    assert Counter((r.doc_id, r.source, r["size"]) for r in rows) == Counter((d, s, len(WORD.findall(t or ""))) for d, t, s in docs)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - want[s]) <= 0.51 for s in sizes)
    key = lambda rows: sorted((r.doc_id or -1, r.source or "", r["size"], r.taken) for r in rows)
    assert key(mixing.mix(df.repartition(5)).collect()) == key(rows)


def test_mixed_documents_hold_what_was_taken(spark):
    rng = random.Random(9)
    docs = [(k, prose(rng, rng.choice([1, 30, 300, 1500]), 10**6).replace(" ", " \n", 3), rng.choice("aab")) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("n_chars", F.length("text").cast("long"))
    out, taken = mixing.mixed_documents(df), {r.doc_id: r.taken for r in mixing.mix(df).collect()}
    assert out.columns == df.columns
    words, texts = Counter(), {d: t for d, t, _ in docs}
    for r in out.collect():
        own = WORD.findall(r.text)
        words[r.doc_id] += len(own)
        assert r.n_chars == len(r.text) and set(own) <= set(WORD.findall(texts[r.doc_id]))
        assert len(own) < len(WORD.findall(texts[r.doc_id])) or r.text == texts[r.doc_id]
    assert {d: n for d, n in taken.items() if n} == dict(words)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0


def test_permutations(spark):
    rows = spark.range(1).select(F.explode(F.sequence(F.lit(1), F.lit(40))).alias("n")).select("n", F.explode(F.expr("sequence(0, n - 1)")).alias("x"))
    got = {}
    for r in rows.select("n", mixing.permuted(F.col("x"), F.col("n").cast("long"), F.lit(3), F.col("n")).alias("y")).collect():
        got.setdefault(r.n, []).append(r.y)
    assert all(sorted(v) == list(range(n)) for n, v in got.items()) and got[40] != list(range(40))
