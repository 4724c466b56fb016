"""Personal data replaced by surrogates.

E-mail addresses, payment cards, phone numbers, national numbers (3-2-4 digits),
bank accounts (IBAN, if its check digits are right), IP addresses and persons are
detected in whole texts. An entity is a type and a canonical value: an address in
lower case, a number's digits, a part of a name in lower case. It gets one
surrogate, derived from a key, so that all its mentions in all documents still
agree. Surrogates keep the type: a card keeps its issuer digit and a valid check
digit, a phone number its first digit and grouping, an account its country
and valid check digits, an e-mail address its top-level domain, an IP address its
private or special network.

Persons are found by a title before their name. The last word of a titled name is a family name,
those before it are given names. In a document with such names all other mentions of
their words, with or without a title, are replaced too: a family name alone
gets what it got in the full name. Family names keep their length, capitals and
pattern of vowels; given names come from a rule that marks the gender. The gender is
that of the mention's title, else of the first title that the name has in the
document, so two persons who share a name of either gender stay apart. Names
never found after a title aren't detected.

Surrogates are checked for collisions before any is used: no two entities of a type
may share one, and none may be the value of another real entity. Those that
collide, but for the first, draw again until nothing collides. IP addresses are
mapped by a keyed permutation of their network instead, which can't collide; a network may
be too small to avoid real addresses.

Only DataFrame functions are used. Texts are read twice: documents with entities are
written aside with what is found, the others pass through without a shuffle. Texts
are put together from the pieces between mentions, so a replacement is never looked at
again. Defined cases: a null or empty text stays as it is; repeated rows get the same
result; an empty table gives an empty result; all columns of ``docs`` are kept
whatever their names, ``n_entities`` excepted, which is made anew.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch
from .mixing import permuted

#: Titles that come before names, by the gender they show.
TITLES = {
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н"),
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "г-жа"),
    "": ("Dr", "Prof"),
}
#: Given names for surrogates are a beginning, a middle and an ending that shows the gender.
GIVEN = {
    "Latin": {
        "begin": ("al", "ber", "cor", "dan", "el", "fer", "gal", "hel", "is", "jor", "kar", "lor", "mar", "nor", "ol", "per", "ros", "sal", "tor", "vin"),
        "middle": ("d", "l", "m", "n", "r", "s", "t", "v", "nd", "rt", "ll", "ss"),
        "m": ("o", "an", "er", "us", "in", "ert", "old", "iel"),
        "f": ("a", "ina", "ette", "elle", "ia", "ona", "isa", "ara"),
        "": ("y", "ie", "en", "el", "is", "or", "e", "i"),
    },
    "Cyrillic": {
        "begin": ("ал", "бор", "вер", "гал", "дан", "ел", "зор", "ин", "кар", "лар", "мар", "нор", "ол", "пет", "рад", "сав"),
        "middle": ("в", "д", "л", "м", "н", "р", "с", "т"),
        "m": ("ан", "ий", "ей", "ор", "ид", "ир"),
        "f": ("а", "ина", "ия", "ея", "ана", "ира"),
        "": ("и", "е", "о", "ико"),
    },
}
#: What letters are replaced by: others of their kind; letters of further scripts become Latin.
LETTERS = (("aeiouy", r"[aeiouyà-æè-ïò-öø-ý]"), ("bcdfghklmnprstvwz", r"[a-zß-ɏ]"), ("аеиоуя", "[аеёиоуыэюя]"), ("бвгдзклмнпрст", "[а-ё]"), ("αεηιοω", "[αεηιουωά-ώ]"), ("βγδζκλμνπρστ", "[α-ω]"), ("bcdfghklmnprstvwz", r"\p{L}"))

_TITLE = "(?:" + "|".join(t for ts in TITLES.values() for t in ts) + r")\.?|M\."
_PARTICLES = "(?:(?:von|van|der|den|de|di|da|la|le|du) ){0,3}"
#: A word of a name.
PART = r"(?<![\p{L}\p{N}])\p{Lu}(?=[\p{L}'’])\p{L}{0,40}(?:['’]\p{Lu}\p{L}{0,40}|-\p{L}{1,40}){0,4}"
_BEFORE = rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE}) {_PARTICLES}"
NAME = rf"{_BEFORE}{PART}(?: {_PARTICLES}{PART}){{0,2}}"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,8}\.[A-Za-z]{2,24}"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9])(?:[0-9]{4}(?:[ -]?[0-9]{4}){2}[ -]?[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
PHONE = r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?|\([0-9]{2,4}\) ?)[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}(?![0-9])"
#: Phone numbers as written at home.
LOCAL = r"(?<![0-9A-Za-z.-])(?:[2-9][0-9]{2}[ .-][0-9]{3}[ .-][0-9]{4}|0[0-9]{2,4}[ /-][0-9]{5,8})(?![0-9]|[.-][0-9])"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
IP = rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])"
NUMBERS = "|".join((EMAIL, IBAN, CARD, PHONE, SSN, LOCAL, IP))
#: What is taken apart in documents with names: numbers, and words of names with the title before them.
WORDS = f"{NUMBERS}|(?:{_BEFORE})?{PART}"
#: Networks whose addresses stay in them: first address and number of addresses. All others are one space.
NETWORKS = ((10 << 24, 1 << 24), (127 << 24, 1 << 24), ((169 << 24) + (254 << 16), 1 << 16), ((172 << 24) + (16 << 16), 1 << 20), ((192 << 24) + (168 << 16), 1 << 16))

#: Mentions for each task that draws surrogates, about, once there are more than the usual number of tasks would draw.
TASK_ENTITIES = 50_000
#: Draws after which collisions that remain are an error.
DRAWS = 40


def titled(text: Column) -> Column:
    """Whether there is a name after a title. Texts without the letters of a title are settled by a cheaper test."""
    some = F.lit(False)
    for title in sorted({t for ts in TITLES.values() for t in ts} | {"M."}):
        some = some | text.contains(title)
    return F.coalesce(some & text.rlike(NAME), F.lit(False))


def has_entity(text: Column) -> Column:
    """Whether anything is found in a text."""
    return F.coalesce(text.rlike("[0-9@]") & text.rlike(NUMBERS), F.lit(False)) | titled(text)


def kind(token: Column) -> Column:
    """The type of a token; null for words and for what only looks like an account."""
    number = F.when(token.rlike(rf"^{IP}$"), "ip").when(token.rlike(rf"^{SSN}$"), "ssn").when(token.rlike("^[+(]") | token.rlike(rf"^{LOCAL}$"), "phone")
    iban = F.when(token.rlike(rf"^{IBAN}$") & (_mod97(F.regexp_replace(token, " ", "")) == 1), "iban")
    return F.when(token.contains("@"), "email").when(token.rlike("^[A-Z]{2}[0-9]{2}"), iban).when(token.rlike("^[0-9+(]"), F.coalesce(number, F.lit("card")))


def canonical(token: Column, kind: Column) -> Column:
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(token, "[^0-9]", "")).when(kind == "iban", F.regexp_replace(token, " ", "")).when(kind == "email", F.lower(token)).otherwise(token)


def gender(mention: Column) -> Column:
    """m, f or empty, by the title that a mention begins with."""
    title = F.regexp_extract(mention, r"^(\S+?)\.? ", 1)
    return F.when(title.isin(*TITLES["m"], "M"), "m").when(title.isin(*TITLES["f"]), "f").otherwise("")


def _draw(seed: Column, at: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, at), F.lit(n)).cast("int")


def _character(c: Column, seed: Column, at: Column) -> Column:
    """Another character of the same kind and case; what is neither letter nor digit stays. No digit but zero becomes zero."""
    low = F.lower(c)
    out = F.when(c == "0", _draw(seed, at, 10).cast("string")).when(c.rlike("[1-9]"), (_draw(seed, at, 9) + 1).cast("string"))
    for letters, those in LETTERS:
        one = F.substring(F.lit(letters), _draw(seed, at, len(letters)) + 1, F.lit(1))
        out = out.when(low.rlike(those), F.when(c == low, one).otherwise(F.upper(one)))
    return out.otherwise(c)


def _spelled(value: Column, seed: Column) -> Column:
    return F.array_join(F.transform(F.split(value, ""), lambda c, i: _character(c, seed, i)), "")


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of ten for a valid number; digits are counted from the right."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + (c.cast("int") * 2) % 10))
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _mod97(account: Column) -> Column:
    """What is left of an account number, its first four characters put last and letters as 10 to 35, by 97."""
    moved = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(moved, ""), F.lit(0), lambda s, c: (s * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c)) % 97)


def surrogate(kind: Column, value: Column, key: str, draw: Column) -> Column:
    """The surrogate of a canonical value at a given draw, canonical itself."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, value, draw.cast("string")), 256)
    digits = F.concat(F.substring(value, 1, 1), _spelled(F.substring(value, F.lit(2), F.length(value)), seed))
    local = F.regexp_extract(value, r"^(.*)\.([^.]*)$", 1)
    email = F.concat(_spelled(local, seed), F.lit("."), F.regexp_extract(value, r"\.([^.]*)$", 1))
    out = F.when(kind == "ip", _address(value, key)).when(kind == "email", email).when(kind == "card", _card(digits, value)).when(kind == "iban", _account(value, seed))
    return out.when(kind == "family", _family(value, seed, draw)).when(kind.startswith("given"), _given(kind, value, seed, draw)).otherwise(digits)


def _address(value: Column, key: str) -> Column:
    octets = F.split(value, r"\.")
    number = F.aggregate(octets, F.lit(0).cast("long"), lambda s, x: s * 256 + x.cast("long"))
    base, size = F.lit(0), F.lit(1 << 32)
    for first, n in NETWORKS:
        inside = (number >= first) & (number < first + n)
        base, size = F.when(inside, F.lit(first)).otherwise(base), F.when(inside, F.lit(n)).otherwise(size)
    new = base.cast("long") + permuted(number - base, size.cast("long"), F.lit(key), F.lit("ip"), base)
    return F.concat_ws(".", *[F.shiftright(new, s).bitwiseAND(F.lit(255)).cast("string") for s in (24, 16, 8, 0)])


def _card(digits: Column, value: Column) -> Column:
    """The number with a check digit that is valid if the original's is."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    check = F.pmod(F.lit(10) - F.pmod(_luhn(F.concat(body, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")
    return F.when(_luhn(value) % 10 == 0, F.concat(body, check)).otherwise(digits)


def _account(value: Column, seed: Column) -> Column:
    country, body = F.substring(value, 1, 2), _spelled(F.substring(value, F.lit(5), F.length(value)), seed)
    check = F.lit(98) - _mod97(F.concat(country, F.lit("00"), body))
    return F.concat(country, F.lpad(check.cast("string"), 2, "0"), body)


def _family(value: Column, seed: Column, draw: Column) -> Column:
    """After every eight draws a name gets two letters longer: there are not enough short ones for many entities."""
    more = F.when(value.rlike("[а-ё]"), F.lit("ба")).when(value.rlike("[α-ω]"), F.lit("βα")).otherwise(F.lit("ba"))
    return _spelled(F.concat(value, F.repeat(more, F.floor(draw / 8).cast("int"))), seed)


def _given(kind: Column, value: Column, seed: Column, draw: Column) -> Column:
    """A name for each part between hyphens. After every four draws it gets a syllable longer."""

    def pick(parts: tuple[str, ...], *at: Column) -> Column:
        return F.element_at(F.array(*map(F.lit, parts)), F.pmod(F.xxhash64(seed, *at), F.lit(len(parts))).cast("int") + 1)

    def name(script: str, at: Column) -> Column:
        own = GIVEN[script]
        longer = F.array_join(F.transform(F.sequence(F.lit(0), F.floor(draw / 4).cast("int")), lambda k: pick(own["begin"], at, k)), "")
        ending = F.when(kind == "given_m", pick(own["m"], at, F.lit("end"))).when(kind == "given_f", pick(own["f"], at, F.lit("end"))).otherwise(pick(own[""], at, F.lit("end")))
        return F.concat(longer, pick(own["middle"], at, F.lit("middle")), ending)

    return F.array_join(F.transform(F.split(value, "-"), lambda part, at: F.when(part.rlike("[а-ё]"), name("Cyrillic", at)).otherwise(name("Latin", at))), "-")


def rendered(token: Column, kind: Column, value: Column) -> Column:
    """A surrogate written as the mention was: its separators, capitals and title."""
    letters = F.split(token, "")
    start = F.struct(F.lit("").alias("s"), F.lit(0).alias("k"))

    def step(acc: Column, c: Column) -> Column:
        taken = F.struct(F.concat(acc["s"], F.substring(value, acc["k"] + 1, F.lit(1))).alias("s"), (acc["k"] + 1).alias("k"))
        return F.when(c.rlike("[0-9A-Z]"), taken).otherwise(F.struct(F.concat(acc["s"], c).alias("s"), acc["k"].alias("k")))

    number = F.aggregate(letters, start, step)["s"]
    email = _as_written(value, token)
    core = word(token)
    given = F.array_join(F.transform(F.split(value, "-"), lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, F.lit(2), F.length(p)))), "-")
    name = F.when((core == F.upper(core)) & (F.length(core) > 1), F.upper(value)).when(kind == "family", _as_written(value, core)).otherwise(given)
    named = F.concat(F.substring(token, F.lit(1), F.length(token) - F.length(core)), name)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), number).when(kind == "email", email).when(kind == "ip", value).otherwise(named)


def _as_written(value: Column, like: Column) -> Column:
    """The value, capital where ``like`` is."""
    letters = F.split(like, "")

    def one(c: Column, i: Column) -> Column:
        there = F.get(letters, i)
        return F.when(F.coalesce(there != F.lower(there), F.lit(False)), F.upper(c)).otherwise(c)

    return F.array_join(F.transform(F.split(value, ""), one), "")


def word(token: Column) -> Column:
    """The word of a name without the title and particles before it."""
    return F.regexp_extract(token, r"(\S+)$", 1)


def names(found: DataFrame) -> DataFrame:
    """id, value, role (given or family) and its gender by the first title that shows one, of every word of a titled name in a document."""
    each = found.where(F.size("names") > 0).select("id", F.posexplode("names").alias("at", "mention"))
    each = each.select("id", "at", gender(F.col("mention")).alias("shown"), F.regexp_extract_all("mention", F.lit(f"({PART})"), F.lit(0)).alias("parts"))
    each = each.withColumn("parts", F.filter("parts", lambda p: ~p.isin([t for ts in TITLES.values() for t in ts])))
    each = each.select("id", "at", "shown", F.size("parts").alias("n"), F.posexplode("parts").alias("k", "part"))
    given = F.max(F.col("k") < F.col("n") - 1)
    shown = F.min_by(F.col("shown"), F.when(F.col("shown") != "", F.col("at")))
    return each.groupBy("id", F.lower("part").alias("value")).agg(F.when(given, "given").otherwise("family").alias("role"), F.coalesce(shown, F.lit("")).alias("gender"))


def mentions(found: DataFrame) -> DataFrame:
    """id, at (the token's number), token, kind and value of all mentions in written documents with ``tokens`` and ``names``."""
    each = found.select("id", F.posexplode("tokens").alias("at", "token")).withColumn("kind", kind(F.col("token")))
    numbers = each.where("kind IS NOT NULL").withColumn("value", canonical(F.col("token"), F.col("kind")))
    words = each.where("kind IS NULL").withColumn("value", F.lower(word(F.col("token")))).drop("kind").join(names(found), ["id", "value"])
    own = gender(F.col("token"))
    kinds = F.when(F.col("role") == "family", "family").otherwise(F.concat(F.lit("given_"), F.when(own != "", own).otherwise(F.col("gender"))))
    return numbers.unionByName(words.select("id", "at", "token", kinds.alias("kind"), "value"))


def _tasks(found: DataFrame) -> int:
    """Over how many tasks mentions are worked on: they take much longer than their few bytes suggest, so tasks don't go by bytes."""
    return max(int(found.sparkSession.conf.get("spark.sql.shuffle.partitions")), found.count() // TASK_ENTITIES)


def surrogates(found: DataFrame, key: str, tasks: int) -> DataFrame:
    """kind, value and surrogate of all entities, without collisions. Each round is a written table."""
    now, seen = found.select("kind", "value").distinct().withColumn("draw", F.lit(0)), None
    for _ in range(DRAWS):
        # By a hash of its own: Spark would drop a shuffle by the columns that it has just grouped by.
        now = now.repartition(tasks, F.xxhash64("kind", "value"))
        now = scratch.cut(now.withColumn("surrogate", surrogate(F.col("kind"), F.col("value"), key, F.col("draw"))), "surrogates", instead=seen)
        owner = now.groupBy("kind", "surrogate").agg(F.min("value").alias("owner"), F.count("*").alias("n")).where("n > 1").drop("n")
        real = now.select("kind", F.col("value").alias("surrogate"), F.lit(True).alias("real"))
        seen = now.join(owner, ["kind", "surrogate"], "left").join(real, ["kind", "surrogate"], "left")
        again = (F.coalesce("real", F.lit(False)) | F.coalesce(F.col("owner") != F.col("value"), F.lit(False))) & (F.col("kind") != "ip")
        if not seen.where(again).limit(1).count():
            return now.select("kind", "value", "surrogate")
        seen = scratch.cut(seen.select("kind", "value", "draw", again.alias("again")), "collisions", instead=now)
        now = seen.select("kind", "value", (F.col("draw") + F.col("again").cast("int")).alias("draw"))
    raise RuntimeError(f"surrogates still collide after {DRAWS} draws")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` with surrogates in ``text``, and n_entities, the number of mentions replaced."""
    columns = [c for c in docs.columns if c.lower() != "n_entities"]
    has, named = has_entity(F.col("text")), titled(F.col("text"))
    without = docs.where(~has).select(*[F.col(f"`{c}`") for c in columns], F.lit(0).alias("n_entities"))
    all_of = lambda pattern: F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(0))
    some = docs.where(has).select(
        F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"),
        F.monotonically_increasing_id().alias("id"),
        F.when(named, all_of(WORDS)).otherwise(all_of(NUMBERS)).alias("tokens"),
        F.when(named, F.split("text", WORDS, -1)).otherwise(F.split("text", NUMBERS, -1)).alias("between"),
        F.when(named, all_of(NAME)).otherwise(F.array()).cast("array<string>").alias("names"),
    )
    some = scratch.cut(some, "entities")  # what is written once has ids that stay
    each = scratch.cut(mentions(some.select("id", "tokens", "names")), "mentions")
    tasks = _tasks(each)
    found = each.join(surrogates(each, key, tasks), ["kind", "value"]).repartition(tasks, "id")
    new = found.select("id", F.struct("at", rendered(F.col("token"), F.col("kind"), F.col("surrogate")).alias("new")).alias("one"))
    new = new.groupBy("id").agg(F.map_from_entries(F.collect_list("one")).alias("new"), F.count("*").alias("n"))
    rows = some.join(new.hint("shuffle_hash"), "id", "left")
    put = F.transform("between", lambda s, i: F.concat(s, F.coalesce(F.try_element_at("new", i), F.get("tokens", i), F.lit(""))))
    changed = rows.select(*[F.array_join(put, "").alias(c) if c == "text" else F.col(f"row.`{c}`").alias(c) for c in columns], F.coalesce("n", F.lit(0)).cast("int").alias("n_entities"))
    return without.unionByName(changed)
