"""PII surrogates (DataFrame operations only).

Entities are found by pattern, and each is replaced by a surrogate of its own
kind and format: digits stay digits, letters stay letters of the same script
and case (Latin ones for scripts not in ``_CLASSES``), separators stay, card numbers keep their check sum, names follow the
person's gender (told by the honorifics of all mentions, else by a listed given
name, else a name of any gender) and the name's script.  A surrogate is drawn by a keyed hash
of the *normalised* entity (a phone's digits, a lower-cased mail address, the
bare name), so one entity gets one surrogate in every document and spelling.

All distinct entities of the corpus are then checked: a surrogate that another
entity also got, or that is itself an entity of the corpus, is drawn again
until none is left, so distinct entities stay distinct.  Surrogates grow with the
draw (those of a fixed size after ``FIXED_SIZE`` draws), so no format runs full.
Only these redrawn entities, and persons whose mentions tell their gender unlike,
are looked up or joined back, to the documents that hold them.

Defined cases: a null text stays null; empty and entity-free texts stay as they
are; overlapping patterns are taken from left to right, and at one place in the
order of ``KINDS``; equal rows get equal texts; extra columns are kept, whatever
their names; the columns ``text`` and ``n_entities`` of the result are the new
text and the number of replaced entities (instead of a column of that name).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize
from .common import free_names, table

_WORD = r"\p{L}\p{N}_"
#: Kind -> pattern, in order of preference at one place; none starts inside a word (see ANY).
KINDS = {
    "email": r"(?<![._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "ip": rf"(?<!\.)(?:\d{{1,3}}\.){{3}}\d{{1,3}}(?!\.?[{_WORD}])",
    "mac": rf"(?<![:-])(?:[0-9A-Fa-f]{{2}}[:-]){{5}}[0-9A-Fa-f]{{2}}(?![{_WORD}:-])",
    "ip6": rf"(?<![:.])(?=[a-fA-F:]*\d)(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:[0-9A-Fa-f]{{1,4}}:){{1,6}}(?::[0-9A-Fa-f]{{1,4}}){{1,6}})(?![{_WORD}:])",
    "ssn": rf"(?<!-)\d{{3}}-\d{{2}}-\d{{4}}(?![{_WORD}-])",
    "iban": rf"[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{3,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_WORD}])",
    "key": rf"(?:AKIA|ASIA)[A-Z0-9]{{16}}(?![{_WORD}])",
    "hex": rf"(?=[a-f]*\d)[0-9a-f]{{32,128}}(?![{_WORD}])",
    "card": rf"(?<!\+)\d(?:[ -]?\d){{12,18}}(?![{_WORD}])",
    "phone": rf"(?<!\+)(?:(?:\+\d{{1,3}}[ .-]?)?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{3,4}}[ .-]\d{{3,4}}|\+\d{{8,15}}|\+\d{{1,3}}(?:[ .-]\d{{1,4}}){{3,6}}|0\d(?:[ .-]\d{{2}}){{4}})(?![{_WORD}])",
    "person": r"(?:Mr|Mrs|Ms|Mx|Miss|Dr|Prof|Doctor|Professor|Docteur|Herr|Herrn|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra|Господин|Госпожа)\.? \p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?",
    "secret": r"(?<=(?i:password|passwd|pwd|secret|token|api[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[^\s\"',;]+",
}
#: What a text without digits, @, : and = must contain to hold an entity; fixed values, parts of the patterns above.
NEEDED = ["AKIA", "ASIA", "Mr", "Ms", "Mx", "Miss", "Dr", "Prof", "Doct", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Sr", "Господин", "Госпожа"]
#: Honorifics that tell a gender; the others (Dr, Prof, Mx, ...) tell none.
_FEMALE = r"^(Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа)\b"
_MALE = r"^(Mr|Herr|Herrn|Monsieur|Señor|Sr|Господин)\b"
#: Given names by gender and script; fixed values.
GIVEN = {
    ("f", "latin"): ["Anna", "Clara", "Diana", "Elena", "Emma", "Helen", "Ines", "Julia", "Laura", "Lucia", "Maria", "Nina", "Olivia", "Rosa", "Sara", "Vera"],
    ("m", "latin"): ["Adam", "Alan", "Bruno", "Carl", "David", "Erik", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Marco", "Oscar", "Paul", "Simon", "Victor"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    ("m", "cyrillic"): ["Алексей", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей"],
    ("n", "latin"): ["Alex", "Andrea", "Charlie", "Dominique", "Jules", "Kai", "Kim", "Luca", "Noa", "Robin", "Sam", "Sascha"],
    ("n", "cyrillic"): ["Валя", "Женя", "Саша", "Слава", "Шура", "Юля"],
}
#: Syllables of surnames by script; fixed values.
SYLLABLES = {
    "latin": ["bar", "cor", "den", "far", "gal", "hol", "kin", "lan", "mar", "nor", "pel", "ros", "sal", "tor", "vel", "win"],
    "cyrillic": ["бар", "вол", "гор", "дан", "кал", "лен", "мар", "нов", "пет", "род", "сав", "тар", "фед", "хар", "чер", "шал"],
}
#: Character classes: pattern of the class and the characters a surrogate may take.
_CLASSES = [
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àáâäçèéêëìíîïñòóôöùúûü"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÇÈÉÊËÌÍÎÏÑÒÓÔÖÙÚÛÜ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "".join(map(chr, range(0x430, 0x450)))),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "".join(map(chr, range(0x410, 0x430)))),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    # What else is ASCII stays; letters of scripts not named below, and their vowel signs, become Latin ones.
    (r"[\x00-\x7F]", None),
    (r"[\p{L}[\p{M}&&[^\p{IsInherited}]]]", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"),
]
#: Any entity; most places are ruled out at once, as they are inside a word.
ANY = f"(?<![{_WORD}])(?:" + "|".join(f"(?:{p})" for p in KINDS.values()) + ")"
#: Draws after which a surrogate grows (mails, phones, secrets) and phones give up their exchange; names grow from the first on.
SAME_SIZE = 3
#: Draws after which surrogates of kinds with a fixed size grow too.  As every kind grows, redrawing ends without a cap.
FIXED_SIZE = 20
#: Redrawn entities that are looked up from a list; more are joined.  The result is the same.
LISTED = 4096


def kind_of(value: Column) -> Column:
    """The kind of a found entity; what no other kind matches alone is a secret."""
    out = F.lit("secret")
    for kind, pattern in reversed([x for x in KINDS.items() if x[0] != "secret"]):
        out = F.when(value.rlike(f"^(?:{pattern})$"), kind).otherwise(out)
    return out


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, r"\D", "")


def _name(value: Column) -> Column:
    return F.regexp_replace(value, r"^\S+ ", "")


def _country(value: Column) -> Column:
    """The country code of a number with a plus that is too short to have ten digits beside it."""
    digits = _digits(value)
    code = F.regexp_extract(digits, r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1)
    return F.when(value.startswith("+") & (F.length(code) > F.length(digits) - 10), code).otherwise("")


def norm_of(kind: Column, value: Column) -> Column:
    return (F.when((kind == "phone") & (_country(value) != ""), F.concat(F.lit("+"), _digits(value))).when(kind == "phone", F.substring(F.concat(F.lit("0" * 10), _digits(value)), -10, 10)).when(kind.isin("card", "ssn"), _digits(value))
            .when(kind == "ip6", F.lower(value)).when(kind.isin("email", "mac"), F.lower(F.replace(value, F.lit("-"), F.when(kind == "mac", ":").otherwise("-"))))
            .when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind == "person", F.lower(_name(value))).otherwise(value))


def _byte(h: Column, k: Column) -> Column:
    """The k-th (from 0) of the 64 bytes of a hexadecimal digest, round and round."""
    return F.conv(F.substr(h, k % 64 * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _hash(key: str, *parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws("\x1f", F.lit(key), *parts), "UTF-8"), 512)


def _pick(choices: str | list[str], draw: Column) -> Column:
    if isinstance(choices, str):
        return F.substr(F.lit(choices), draw % len(choices) + 1, F.lit(1))
    return F.element_at(F.array(*map(F.lit, choices)), draw % len(choices) + 1)


def _mapped(value: Column, h: Column) -> Column:
    """Every letter and digit replaced by one of its class."""
    def one(c: Column, i: Column) -> Column:
        out = c
        for pattern, chars in reversed(_CLASSES):
            out = F.when(c.rlike(f"^{pattern}$"), c if chars is None else _pick(chars, _byte(h, i))).otherwise(out)
        return out
    return F.array_join(F.transform(F.split(value, ""), one), "")


def _spelled(value: Column) -> Column:
    """The value, or as many letters if it has no letter or digit to replace."""
    return F.when(value.rlike(r"[\p{L}\p{N}]"), value).otherwise(F.repeat(F.lit("x"), F.char_length(value)))


def _number(h: Column, n: Column) -> Column:
    return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), n), lambda k: (_byte(h, k) % 10).cast("string")), "")).otherwise("")


def _filled(value: Column, digits: Column) -> Column:
    """The digits of ``value`` replaced, in order, by ``digits``."""
    step = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
                       lambda a, c: F.when(c.rlike("^[0-9]$"), F.struct(F.concat(a.out, F.substr(digits, a.k, F.lit(1))).alias("out"), (a.k + 1).alias("k")))
                       .otherwise(F.struct(F.concat(a.out, c).alias("out"), a.k.alias("k"))))
    return step.out


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    def add(total: Column, k: Column) -> Column:
        d = F.substr(digits, k, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return total + F.when((n - k) % 2 == 1, twice).otherwise(d)
    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10


def mark_of(kind: Column, value: Column) -> Column:
    """The gender that a mention's honorific tells: f, m, or n for none."""
    return F.when(kind != "person", "n").when(value.rlike(_FEMALE), "f").when(value.rlike(_MALE), "m").otherwise("n")


def surrogates(key: str, values: Column, known_of) -> Column:
    """The surrogates of an array of entities; ``known_of(kind, norm, value)`` is (redraws, gender).

    Each step binds what the next ones use again and again.
    """
    found = F.transform(values, lambda v: F.struct(v.alias("value"), kind_of(v).alias("kind")))
    found = F.transform(found, lambda e: F.struct(e.value.alias("value"), e.kind.alias("kind"), norm_of(e.kind, e.value).alias("norm")))
    found = F.transform(found, lambda e: F.struct(e.value.alias("value"), e.kind.alias("kind"), e.norm.alias("norm"), known_of(e.kind, e.norm, e.value).alias("known")))
    found = F.transform(found, lambda e: F.struct(e.value.alias("value"), e.kind.alias("kind"), e.norm.alias("norm"), e.known.draw.alias("draw"), e.known.gender.alias("gender"),
                                                  _digits(e.value).alias("digits"), _hash(key, e.kind, e.norm, e.known.draw.cast("string")).alias("h")))
    return F.transform(found, lambda e: _surrogate(key, e.kind, e.value, e.norm, e.draw, e.gender, e.digits, e.h))


def _surrogate(key: str, kind: Column, value: Column, norm: Column, draw: Column, gender: Column, digits: Column, h: Column) -> Column:
    """The surrogate of an entity in its own spelling."""
    n = F.length(digits)
    more = _number(h, F.greatest(draw - SAME_SIZE, F.lit(0)))
    late = _number(h, F.greatest(draw - FIXED_SIZE, F.lit(0)))
    # Phones: country code kept; area and exchange start with 2 to 9; the fictional exchange 555 is kept while it has room.
    local = F.substring(F.concat(F.lit("0" * 10), digits), -10, 10)
    exchange = F.when((F.substring(local, 4, 3) == "555") & (draw <= SAME_SIZE), "555").otherwise(F.concat((_byte(h, F.lit(3)) % 8 + 2).cast("string"), _number(h, F.lit(2))))
    long_phone = F.concat(F.substr(digits, F.lit(1), n - 10), (_byte(h, F.lit(0)) % 8 + 2).cast("string"), F.substring(_number(h, F.lit(9)), 4, 2), exchange, F.substring(_number(h, F.lit(9)), 6, 4))
    country = _country(value)
    phone = _filled(value, F.when(country != "", F.concat(country, _number(h, n - F.length(country)))).when(n >= 10, long_phone).otherwise(_number(h, n)))
    # Cards: issuer digit and check sum kept.
    body = F.concat(F.substr(digits, F.lit(1), F.lit(1)), _number(h, n - 2))
    card = _filled(value, F.concat(body, F.pmod(_luhn(digits) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")))
    octet = lambda k: (_byte(h, F.lit(k)) % 254 + 1).cast("string")
    first = F.element_at(F.array(*[F.lit(str(x)) for x in range(11, 224) if x != 127]), _byte(h, F.lit(0)) % 212 + 1)
    ip = F.concat_ws(".", first, octet(1), octet(2), octet(3))
    # Mail: equal domains stay equal; the top level (and a reserved example domain) is kept.
    domain = F.lower(F.substring_index(value, "@", -1))
    keep = F.regexp_extract(domain, r"((?:^|\.)example\.[a-z]+|\.[^.]+)$", 1)
    site = F.substr(domain, F.lit(1), F.length(domain) - F.length(keep))
    email = F.concat(_mapped(_spelled(F.substring_index(norm, "@", 1)), h), more, F.lit("@"), _mapped(site, _hash(key, F.lit("domain"), site)), keep)
    hexes = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9a-f]$"), _pick("0123456789abcdef", _byte(h, i)))
                                     .when(c.rlike("^[A-F]$"), _pick("0123456789ABCDEF", _byte(h, i))).otherwise(c)), "")
    mac = F.array_join(F.transform(F.split(value, ""), lambda c, i: F.when(c.rlike("^[0-9A-Fa-f]$"), _pick("0123456789abcdef", _byte(h, i))).otherwise(c)), "")
    ip6 = F.when(draw <= SAME_SIZE, hexes).otherwise(F.concat_ws(":", *[F.substr(h, F.lit(4 * k + 1), F.lit(4)) for k in range(8)]))
    head = F.when(kind == "iban", 2).otherwise(4)
    code = F.concat(F.substr(value, F.lit(1), head), _mapped(F.substr(value, head + 1), h))
    iban = F.concat(F.substr(value, F.lit(1), F.lit(2)), _spaced(F.substr(value, F.lit(3)), _mapped(F.substr(norm, F.lit(3)), h)))
    secret = F.concat(_mapped(_spelled(value), h), more)
    fixed = (F.when(kind == "ip", ip).when(kind == "mac", mac).when(kind == "ip6", ip6).when(kind == "ssn", _filled(value, _number(h, n))).when(kind == "iban", iban)
             .when(kind == "key", code).when(kind == "hex", hexes).when(kind == "card", card))
    return (F.when(kind == "email", email).when(kind == "phone", F.concat(phone, more)).when(kind == "person", _person(key, value, gender, draw)).when(kind == "secret", secret)
            .otherwise(F.concat(fixed, late)))


def _spaced(value: Column, chars: Column) -> Column:
    """The characters of ``value`` that are not spaces replaced, in order, by ``chars``."""
    step = F.aggregate(F.split(value, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("k")),
                       lambda a, c: F.when(c != " ", F.struct(F.concat(a.out, F.substr(chars, a.k, F.lit(1))).alias("out"), (a.k + 1).alias("k")))
                       .otherwise(F.struct(F.concat(a.out, c).alias("out"), a.k.alias("k"))))
    return step.out


def _person(key: str, value: Column, gender: Column, draw: Column) -> Column:
    """Honorific kept; a given name of the person's gender and script; a surname drawn from the surname.

    Where no honorific tells the gender, a given name from the lists does; else
    the new one is a name of any gender.
    """
    parts = F.split(value, " ")
    surname, given_name = F.lower(F.element_at(parts, -1)), F.lower(F.element_at(parts, 2))
    cyrillic = value.rlike(r"\p{IsCyrillic}")
    for sign in "mf":
        listed = [x.lower() for script in ("latin", "cyrillic") for x in GIVEN[sign, script]]
        gender = F.when((gender == "n") & given_name.isin(listed), sign).otherwise(gender)
    hs, hg = _hash(key, F.lit("surname"), surname, draw.cast("string")), _hash(key, F.lit("given"), given_name, draw.cast("string"))
    def family(script: str) -> Column:
        syllables = F.transform(F.sequence(F.lit(1), draw + 3), lambda k: _pick(SYLLABLES[script], _byte(hs, k)))
        return F.initcap(F.array_join(syllables, ""))
    given = F.lit(None)
    for (sign, script), names in GIVEN.items():
        fits = (gender == sign) & (cyrillic if script == "cyrillic" else ~cyrillic)
        given = F.when(fits, _pick(names, _byte(hg, F.lit(0)))).otherwise(given)
    last = F.when(cyrillic, family("cyrillic")).otherwise(family("latin"))
    return F.when(F.size(parts) > 2, F.concat_ws(" ", parts[0], given, last)).otherwise(F.concat_ws(" ", parts[0], last))


def may_hold(text: Column) -> Column:
    """True for every text with an entity, and cheap to tell for the others."""
    out = text.rlike("[0-9@:=]")
    for literal in NEEDED:
        out = out | text.contains(literal)
    return F.coalesce(out, F.lit(False))


def entities(text: Column) -> Column:
    """All entities of a text, in order."""
    none = F.array().cast("array<string>")
    return F.when(may_hold(text), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(none)


_KNOWN = "struct<draw: int, gender: string>"


def redraws(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, draw, gender) of the distinct entities of ``found`` (value) that need another
    draw, or whose mentions tell their gender unlike.

    A person has one gender in all mentions: the one that some honorifics tell
    and none contradicts.
    """
    each = found.select(kind_of(F.col("value")).alias("kind"), "value").select("kind", norm_of(F.col("kind"), F.col("value")).alias("norm"), "value", mark_of(F.col("kind"), F.col("value")).alias("mark"))
    told = lambda sign: F.max(F.col("mark") == sign)
    all_ = each.groupBy("kind", "norm").agg(F.min("value").alias("value"), told("f").alias("f"), told("m").alias("m"), (F.min("mark") != F.max("mark")).alias("mixed"))
    gender = F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n")
    all_ = materialize(all_.select("kind", "norm", "value", "mixed", gender.alias("gender")), "entities")
    kept = ["kind", "norm", "value", "mixed", "gender", "draw"]
    known_of = lambda *_: F.struct("draw", "gender")
    drawn = lambda rows: rows.withColumn("to", norm_of(F.col("kind"), surrogates(key, F.array("value"), known_of)[0]))
    taken = materialize(drawn(all_.withColumn("draw", F.lit(0))).select(*kept, "to"), "surrogates")
    known = all_.select("kind", F.col("norm").alias("to"), F.lit(True).alias("known"))
    while True:
        # The first draw wins a shared surrogate; ties go to the smaller entity.
        owners = taken.groupBy("kind", "to").agg(F.min(F.struct("draw", "norm")).alias("owner"))
        judged = taken.join(owners, ["kind", "to"]).join(known, ["kind", "to"], "left")
        clash = (F.col("owner.norm") != F.col("norm")) | F.col("known").isNotNull()
        judged = materialize(judged.select(*kept, "to", clash.alias("clash")), "surrogates")
        again = judged.filter("clash")
        if again.isEmpty():
            return judged.filter("draw > 0 OR mixed").select("kind", "norm", "draw", "gender")
        again = drawn(again.select(*kept).withColumn("draw", F.col("draw") + 1))
        taken = materialize(judged.filter("NOT clash").select(*kept, "to").unionByName(again.select(*kept, "to")), "surrogates")


def replace_pii(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """All columns of ``docs`` with surrogates in the text, and ``n_entities`` (instead of a column of that name)."""
    found_name, draws_name, row1, row2 = free_names(docs, 4)
    words = F.col(f"`{text}`")
    row = [F.xxhash64(words).alias(row1), F.sha2(F.encode(words, "UTF-8"), 256).alias(row2)]
    found = docs.filter(may_hold(words)).select(F.explode(entities(words)).alias("value"))
    moved = materialize(redraws(found, key), "redraws")
    with_entities = docs.withColumn(found_name, entities(words))
    entry = F.struct(F.concat_ws("\x1f", "kind", "norm").alias("k"), F.struct("draw", "gender").alias("known"))
    count = moved.count()
    if 0 < count <= LISTED:
        # A short list is looked up as it is; no text moves.
        with_entities = with_entities.withColumn(draws_name, moved.select(F.map_from_entries(F.collect_list(entry))).scalar())
    elif count:
        # Texts that hold a listed entity: which, and what is known of it.
        named = docs.filter(may_hold(words)).select(*row, F.explode(entities(words)).alias("value")).distinct()
        named = named.withColumn("kind", kind_of(F.col("value"))).withColumn("norm", norm_of(F.col("kind"), F.col("value")))
        per_text = named.join(moved, ["kind", "norm"]).select(row1, row2, entry.alias("e")).distinct()
        per_text = per_text.groupBy(row1, row2).agg(F.map_from_entries(F.collect_list("e")).alias(draws_name))
        some = F.size(found_name) > 0
        with_entities = with_entities.withColumns({row1: F.when(some, row[0]), row2: F.when(some, row[1])})
        with_entities = with_entities.join(per_text, [row1, row2], "left").drop(row1, row2)
    else:
        with_entities = with_entities.withColumn(draws_name, F.lit(None).cast(f"map<string, {_KNOWN}>"))

    def known_of(kind: Column, norm: Column, value: Column) -> Column:
        own = F.struct(F.lit(0).alias("draw"), mark_of(kind, value).alias("gender"))
        return F.coalesce(F.element_at(F.col(draws_name), F.concat_ws("\x1f", kind, norm)), own)

    between = F.split(words, ANY, -1)
    new = F.array_join(F.flatten(F.zip_with(between, surrogates(key, F.col(found_name), known_of), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    replaced = F.when(F.size(found_name) > 0, new).otherwise(words)
    return with_entities.select(*[replaced.alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != "n_entities"], F.size(found_name).cast("bigint").alias("n_entities"))


#: Key of the registered query; a real run passes its own secret.
QUERY_KEY = "registered query"


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
