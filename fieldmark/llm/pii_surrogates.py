"""PII surrogates: every detected entity gets a keyed replacement of its own type, gender, script and format.

Only DataFrame functions are used.  A text is cut at the matches of one pattern; each match is replaced
by a surrogate that a keyed SHA-512 of (kind, normalised value, attempt) decides:

- card, id, iban, secret: digit for digit, hex for hex, letter for letter, separators and case kept; a card
  that passes the Luhn check and an IBAN whose check digits fit get surrogates that do;
- phone: its last ten (North American) or nine digits are the entity, so that a number with and without
  country code or trunk zero is one; what stands before stays;
- token: keys of known prefixes (the prefix stays) and what follows a cue such as `password:`;
- email: character classes kept; its domain is an entity of its own, the top level stays;
- ip: four octets from 1 to 254; ipv6: hex for hex;
- person (a title, or a cue such as `Contact:`, and capitalised words): the title stays, every word is an
  entity of kind name; a bare later mention of a detected word in the same text is replaced too.  What a word
  is, a surname or a given name and of which gender, is told by all its mentions in the corpus together, so
  that it has one surrogate under whatever title; the script stays.

The same entity gets the same surrogate wherever it stands and however it is formatted.  Distinctness is
checked over the whole corpus: a candidate that another entity won, or that is itself a real entity, is
refused and the entity tries again (`attempt`).  Surnames and other entities at attempt 0 need no lookup;
the rest, the exceptions, go with the plan if they are at most MAP_ROWS; else the texts that hold one meet
their exceptions in a join on the text's digest, common texts by broadcast.

The key is the setting spark.fieldmark.pii.key of the session; without it KEY, which protects nothing.

Defined results: a null text stays null; texts without entities are unchanged, byte for byte; every
other column passes through (a column `entities` is replaced); repeated rows are treated alike.  Names
without title or cue, and names in scripts without capitals, are not found.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.shared import join_counted, stored

KEY, KEY_SETTING = "fieldmark-demo-key", "spark.fieldmark.pii.key"
#: Exceptions that travel inside the plan; more are joined.
MAP_ROWS = 2_000
#: From this attempt on a surrogate grows by further characters, so that small name spaces end too.
GROW_AT = 8

# fixed values: titles by gender, and the syllables names are made of
MALE = ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Sir", "г-н", "Господин", "господин", "κ", "Κύριος", "κύριος")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señorita", "Señora", "Sra", "г-жа", "Госпожа", "госпожа", "κα", "Κυρία", "κυρία")
NEUTRAL = ("Dr", "Prof", "Mx")
LATIN = ("ba", "bel", "bor", "cal", "cor", "da", "del", "dor", "fen", "fal", "gar", "gil", "ha", "hol", "ker", "kin", "la", "lor", "mar", "mel", "nor", "na", "pal", "per", "ra", "ros", "sal", "sen", "tal", "ter", "val", "wil")
CYRILLIC = ("ба", "бел", "бор", "вал", "вер", "га", "гор", "да", "дан", "зор", "ил", "ка", "кор", "ла", "лев", "ма", "мар", "на", "нов", "ол", "па", "пет", "ра", "рос", "са", "сав", "та", "тар", "фе", "хол", "ча", "яр")
GREEK = ("αλ", "βα", "γε", "δη", "ελ", "ζα", "θα", "ιω", "κα", "κο", "λα", "λε", "μα", "με", "να", "νι", "ξε", "ολ", "πα", "πε", "ρα", "ρο", "σα", "σο", "τα", "τε", "υρ", "φα", "φι", "χα", "χρ", "ψα")
ENDINGS = {
    "latin": {"male": ("o", "us", "an", "er"), "female": ("a", "ine", "elle", "ia"), "neutral": ("y", "is", "ey", "en"), "surname": ("son", "man", "field", "ers")},
    "cyrillic": {"male": ("ор", "ан", "им", "ий"), "female": ("а", "ия", "ина", "ова"), "neutral": ("ь", "ей", "ен", "ис"), "surname": ("ов", "ин", "ко", "ский")},
    "greek": {"male": ("ος", "ης", "ας", "ων"), "female": ("α", "η", "ια", "ινα"), "neutral": ("ι", "υ", "ις", "ε"), "surname": ("ου", "ιδης", "ακης", "οπουλος")},
}

_NAME = r"\p{Lu}[\p{L}'’]*\p{L}(?:-\p{Lu}\p{L}+)?"
_TITLES = sorted((*MALE, *FEMALE, *NEUTRAL), key=lambda t: -len(t))
# a look at one letter comes first, as most places end there
_TITLE = f"(?=[{''.join(sorted({t[0] for t in _TITLES}))}])" + r"(?<!\p{L})(?:" + "|".join(_TITLES) + r")\.?"
_CUE = r"(?=[CNASPE])(?:Contact|Name|Attn|Signed|Customer|Patient|Employee|Author): {1,2}"
_CALL = r"(?=[PpTtFfMmCc])(?i:phone|tel|fax|mobile|cell|call)[.:]{0,2} {0,2}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_HEX = "[0-9A-Fa-f]{1,4}"
_TOLD = r"(?=[PpAaSs])(?i:password|passwd|pwd|passphrase|api[_-]key|secret[_-]key|access[_-]token)[\"']? {0,2}[:=] {0,2}[\"']?"
#: What a match may begin with that stays as it is.
_BEFORE = rf"^(?:{_TOLD}|{_CALL}(?=[0-9]{{7,12}}$)|{_CUE})"
#: What stays of a token.
TOKEN_PREFIX = "^(?:AKIA|ASIA|gh[pousr]_|github_pat_|(?:sk|pk|rk)_(?:live|test)_|xox[abprs]-|AIza|eyJ)"
# fixed values: what each kind looks like, the first that fits counts
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*(?<=\.[A-Za-z]{2,24})",
    "ip": rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
    "ipv6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]{{0,39}}[0-9])(?:{_HEX}:){{1,7}}:(?:{_HEX}(?::{_HEX}){{0,6}})?)(?![0-9A-Za-z:])",
    "token": r"(?<![0-9A-Za-z_-])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,255}|github_pat_[0-9A-Za-z_]{22,255}|(?:sk|pk|rk)_(?:live|test)_[0-9A-Za-z]{10,99}|xox[abprs]-[0-9A-Za-z-]{10,99}|AIza[0-9A-Za-z_-]{35}|eyJ[0-9A-Za-z_-]{8,999}\.eyJ[0-9A-Za-z_-]{8,999}\.[0-9A-Za-z_-]{8,999})(?![0-9A-Za-z_-])",
    "told": _TOLD + r"(?=[^\s\"',;<>]{0,64}[0-9!#$%^&*])[^\s\"',;<>]{6,128}",
    "card": r"(?<![0-9-])(?:[0-9]{4}[ -]){3}[0-9]{4}(?!-?[0-9])|(?<![0-9A-Za-z])3[47][0-9]{2} [0-9]{6} [0-9]{5}(?![0-9])|(?<![0-9A-Za-z])[0-9]{13,19}(?![0-9A-Za-z])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "secret": r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])",
    "id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?!-?[0-9])",
    "phone": r"(?<![\w+(])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-][0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?!\w)"
    r"|(?<![\w.+-])[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}(?![\w-])|(?<![\w.+-])0[0-9]{2,4} [0-9]{3,4} [0-9]{3,4}(?![\w-])|" + _CALL + r"[0-9]{7,12}(?!\w)",
    "person": rf"{_TITLE} {_NAME}(?: {_NAME}){{0,5}}|{_CUE}{_NAME}(?: {_NAME}){{1,5}}",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values()).replace(r"([ .-])", r"(?<gap>[ .-])").replace(r"\1", r"\k<gap>")
#: No text without one of these has an entity; most texts stop here.
HINT = rf"@|[0-9]|{_TOLD}|{_TITLE} \p{{Lu}}|{_CUE}\p{{Lu}}"
FORMS = ("male", "female", "neutral", "surname")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once; keeps expressions small where a part is used again and again."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(hit: Column) -> Column:
    """(kind, before, value) of a match: a cue before the value stays and tells the kind where the value's looks do not."""
    kinds = [(kind, pattern) for kind, pattern in PATTERNS.items() if kind != "told"]

    def told(before: Column) -> Column:
        value = F.substring(hit, F.length(before) + 1, F.length(hit))
        kind = F.when(before.rlike(f"^{_TOLD}$"), "token").when(before.rlike(f"^{_CALL}$"), "phone").when(before.rlike(f"^{_CUE}$"), "person")
        for name, pattern in kinds:
            kind = kind.when(hit.rlike(f"^(?:{pattern})$"), name)
        return F.struct(kind.otherwise("bare").alias("kind"), before.alias("before"), value.alias("value"))

    return let(F.regexp_extract(hit, _BEFORE, 0), told)


def normalised(kind: Column, value: Column) -> Column:
    """What makes two mentions the same entity: case and separators aside."""
    digits = F.regexp_replace(value, "[^0-9]", "")
    phone = let(digits, lambda d: F.when(d.rlike("^1?[1-9][0-9]{9}$"), F.right(d, F.lit(10))).otherwise(F.right(d, F.lit(9))))
    plain = F.regexp_replace(F.lower(value), "[^0-9a-z]", "")
    return F.when(kind.isin("email", "domain", "ip", "ipv6", "name"), F.lower(value)).when(kind == "token", value).when(kind == "phone", phone).otherwise(plain)


def _stream(key: str, kind: Column, norm: Column, attempt: Column) -> Column:
    """128 hex digits that the key, the entity and the attempt decide."""
    inner = F.sha2(F.concat(F.lit(f"{key}|"), kind, F.lit("|"), norm, F.lit("|"), attempt.cast("string")), 512)
    return F.sha2(F.concat(F.lit(f"{key}|"), inner), 512)


def _byte(stream: Column, k: Column) -> Column:
    return F.conv(F.substring(stream, F.pmod(k, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(alphabet: str, n: Column) -> Column:
    return F.substring(F.lit(alphabet), F.pmod(n, F.lit(len(alphabet))) + 1, F.lit(1))


def _masked(norm: Column, stream: Column, hexadecimal: bool = False) -> Column:
    """norm with digit for digit and letter for letter."""

    def one(c: Column, k: Column) -> Column:
        n = _byte(stream, k)
        if hexadecimal:
            return F.when(c.rlike("[0-9a-f]"), _letter("0123456789abcdef", n)).otherwise(c)
        return F.when(c.rlike("[0-9]"), _letter("0123456789", n)).when(c.rlike("[a-z]"), _letter("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("[A-Z]"), _letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)

    return F.array_join(F.transform(F.split(norm, ""), one), "")


def _luhn(digits: Column) -> Column:
    def value(c: Column, k: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return F.when(k % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda a, b: a + b) % 10


def _card(norm: Column, stream: Column) -> Column:
    def checked(raw: Column) -> Column:
        head = F.substring(raw, F.lit(1), F.length(raw) - 1)
        last = F.pmod(10 - _luhn(F.concat(head, F.lit("0"))), F.lit(10)).cast("string")
        return F.when(_luhn(norm) == 0, F.concat(head, last)).otherwise(raw)

    return let(F.concat(F.substring(norm, 1, 1), _masked(F.substring(norm, F.lit(2), F.length(norm) - 1), stream)), checked)


def _remainder(iban: Column) -> Column:
    """What is left of an IBAN, its first four characters moved behind, on division by 97."""
    moved = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4))

    def value(c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)

    return F.aggregate(F.transform(F.split(moved, ""), value), F.lit(0), lambda rest, v: (rest * F.when(v > 9, 100).otherwise(10) + v) % 97)


def _iban(norm: Column, stream: Column) -> Column:
    def checked(body: Column) -> Column:
        check = F.lpad((98 - _remainder(F.concat(F.substring(norm, 1, 2), F.lit("00"), body))).cast("string"), 2, "0")
        return F.when(_remainder(norm) == 1, F.concat(F.substring(norm, 1, 2), check, body)).otherwise(F.concat(F.substring(norm, 1, 2), _masked(F.substring(norm, 3, 2), F.reverse(stream)), body))

    return let(_masked(F.substring(norm, F.lit(5), F.length(norm)), stream), checked)


def _domain(norm: Column, stream: Column) -> Column:
    top = F.substring_index(norm, ".", -1)
    return F.concat(_masked(F.substring(norm, F.lit(1), F.length(norm) - F.length(top) - 1), stream), F.lit("."), top)


def _token(norm: Column, stream: Column) -> Column:
    return let(F.regexp_extract(norm, TOKEN_PREFIX, 0), lambda head: F.concat(head, _masked(F.substring(norm, F.length(head) + 1, F.length(norm)), stream)))


def _ip(norm: Column, stream: Column) -> Column:
    octets = F.transform(F.split(norm, r"\."), lambda c, k: (F.pmod(_byte(stream, k * 2) * 256 + _byte(stream, k * 2 + 1), F.lit(254)) + 1).cast("string"))
    return F.array_join(octets, ".")


def _name(form: Column, norm: Column, stream: Column) -> Column:
    scripts = {"latin": LATIN, "cyrillic": CYRILLIC, "greek": GREEK}

    def made(script: Column) -> Column:
        def one_of(pool: Column, k: int) -> Column:
            return F.element_at(pool, F.pmod(_byte(stream, F.lit(k)), F.size(pool)) + 1)

        pools = F.create_map(*[x for s, syllables in scripts.items() for x in (F.lit(s), F.array(*map(F.lit, syllables)))])
        ends = F.create_map(*[x for s, kinds in ENDINGS.items() for k, e in kinds.items() for x in (F.lit(f"{s} {k}"), F.array(*map(F.lit, e)))])
        stem = let(F.element_at(pools, script), lambda pool: F.concat(one_of(pool, 0), one_of(pool, 1), one_of(pool, 2)))
        return F.concat(stem, let(F.element_at(ends, F.concat(script, F.lit(" "), form)), lambda pool: one_of(pool, 9)))

    return let(F.when(norm.rlike(r"\p{IsCyrillic}"), "cyrillic").when(norm.rlike(r"\p{IsGreek}"), "greek").otherwise("latin"), made)


def _grow(kind: Column, attempt: Column, stream: Column, made: Column) -> Column:
    """made, with more letters (names, domains) or digits from attempt GROW_AT on."""
    size = F.greatest(attempt - GROW_AT + 2, F.lit(0))
    digits = F.translate(F.substring(stream, F.lit(90), size), "abcdef", "012345")
    letters = F.translate(F.substring(stream, F.lit(90), size), "0123456789", "ghijklmnop")
    extra = F.when(attempt < GROW_AT, "").when(kind.isin("name", "domain"), letters).otherwise(digits)
    return F.when(kind.isin("email", "domain"), F.concat(extra, made)).otherwise(F.concat(made, extra))


def core(kind: Column, norm: Column, form: Column, attempt: Column, key: str) -> Column:
    """The surrogate's normalised form: what collision checks compare.  An email's keeps the real domain here: domains are checked apart, and none of theirs is real."""

    def made(stream: Column) -> Column:
        return (
            F.when(kind == "email", F.concat(_masked(F.substring_index(norm, "@", 1), stream), F.lit("@"), F.substring_index(norm, "@", -1)))
            .when(kind == "domain", _domain(norm, stream))
            .when(kind == "ip", _ip(norm, stream))
            .when(kind == "card", _card(norm, stream))
            .when(kind == "iban", _iban(norm, stream))
            .when(kind.isin("secret", "ipv6"), _masked(norm, stream, hexadecimal=True))
            .when(kind == "token", _token(norm, stream))
            .when(kind == "name", _name(form, norm, stream))
            .otherwise(_masked(norm, stream))
        )

    return let(_stream(key, kind, norm, attempt), lambda stream: let(made(stream), lambda out: _grow(kind, attempt, stream, out)))


def _rendered(kind: Column, value: Column, norm: Column, surrogate: Column) -> Column:
    """The normalised surrogate in the clothes of the mention: its separators and its case, and the digits before a phone's."""

    def dressed(full: Column) -> Column:
        def one(c: Column, k: Column) -> Column:
            place = F.length(F.regexp_replace(F.substring(value, F.lit(1), k + 1), "[^0-9A-Za-z]", ""))
            put = F.substring(full, place, F.lit(1))
            return F.when(c.rlike("[0-9a-z]"), put).when(c.rlike("[A-Z]"), F.upper(put)).otherwise(c)

        filled = F.array_join(F.transform(F.split(value, ""), one), "")
        size = F.length(F.regexp_replace(value, "[^0-9A-Za-z]", ""))
        return F.concat(filled, F.substring(full, size + 1, F.length(full)))

    digits = F.regexp_replace(value, "[^0-9]", "")
    before = F.when(kind == "phone", F.substring(digits, F.lit(1), F.length(digits) - F.length(norm))).otherwise("")
    upper = (F.length(value) > 1) & (value == F.upper(value))
    named = F.when(upper, F.upper(surrogate)).otherwise(F.concat(F.upper(F.substring(surrogate, 1, 1)), F.substring(surrogate, F.lit(2), F.length(surrogate))))
    whole = F.when(upper & kind.isin("email", "ipv6"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind == "name", named).when(kind.isin("email", "ip", "ipv6", "token"), whole).otherwise(let(F.concat(before, surrogate), dressed))


def _titled(words: Column) -> Column:
    return F.regexp_replace(F.element_at(words, 1), r"\.$", "").isin(*MALE, *FEMALE, *NEUTRAL)


def _named_parts(hit: Column) -> Column:
    """(form, value) of the words after the title, if there is one: the last is a surname, the others go by the title's gender."""

    def told(words: Column) -> Column:
        title = F.regexp_replace(F.element_at(words, 1), r"\.$", "")
        gender = F.when(title.isin(*MALE), "male").when(title.isin(*FEMALE), "female").otherwise("neutral")
        names = F.when(_titled(words), F.slice(words, F.lit(2), F.size(words))).otherwise(words)
        return let(names, lambda n: F.transform(n, lambda w, k: F.struct(F.when(k == F.size(n) - 1, "surname").otherwise(gender).alias("form"), w.alias("value"))))

    return let(F.split(hit, " "), told)


def detected(documents: DataFrame) -> DataFrame:
    """documents with __pieces (the text between matches), __hits (kind, before, value) and __names (form, value) of the words of persons."""
    hits = F.when(F.col("text").rlike(HINT), F.transform(F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)), found))
    empty = F.expr("cast(array() as array<struct<kind:string,before:string,value:string>>)")
    first = documents.withColumn("__hits", F.coalesce(hits, empty))
    persons = F.filter(F.col("__hits"), lambda h: h.kind == "person")
    named = first.withColumn("__names", F.array_distinct(F.flatten(F.transform(persons, lambda h: _named_parts(h.value)))))
    bare = F.array_distinct(F.transform(F.col("__names"), lambda n: n.value))
    pattern = F.when(F.size(bare) > 0, F.concat(F.lit(PATTERN + r"|(?<!\p{L})(?:"), F.array_join(F.array_sort(bare, lambda a, b: F.length(b) - F.length(a)), "|"), F.lit(r")(?!\p{L})"))).otherwise(F.lit(PATTERN))
    cut = named.withColumn("__pattern", pattern)
    again = F.transform(F.regexp_extract_all(F.col("text"), F.col("__pattern"), F.lit(0)), found)
    out = cut.withColumn("__hits", F.when(F.size("__names") > 0, again).otherwise(F.col("__hits")))
    pieces = F.when((F.size("__hits") > 0) & (F.size("__names") > 0), F.split("text", F.col("__pattern"), -1)).when(F.size("__hits") > 0, F.split("text", PATTERN, -1))
    return out.withColumn("__pieces", pieces).drop("__pattern")


def _units(hits: Column, names: Column) -> Column:
    """The entities that get a surrogate of their own, as (kind, norm, form): hits other than persons, emails' domains, and the words of persons."""

    def unit(kind: Column, norm: Column, form: Column) -> Column:
        return F.struct(kind.alias("kind"), norm.alias("norm"), form.alias("form"))

    plain = F.transform(F.filter(hits, lambda h: ~h.kind.isin("person", "bare")), lambda h: unit(h.kind, normalised(h.kind, h.value), F.lit("")))
    domains = F.transform(F.filter(hits, lambda h: h.kind == "email"), lambda h: unit(F.lit("domain"), F.lower(F.substring_index(h.value, "@", -1)), F.lit("")))
    return F.array_distinct(F.concat(plain, domains, F.transform(names, lambda n: unit(F.lit("name"), F.lower(n.value), n.form))))


def entities(documents: DataFrame) -> DataFrame:
    """(kind, norm, form): every distinct entity of the corpus.

    The form of a name is that of a given name if any mention has it so, with the gender that all its titles of a gender agree on.
    """
    units = detected(documents.select("text").filter(F.col("text").rlike(HINT))).select(F.explode(_units(F.col("__hits"), F.col("__names"))).alias("u"))
    told = {f: F.max(F.col("u.form") == f) for f in FORMS[:3]}
    forms = units.groupBy("u.kind", "u.norm").agg(*[c.alias(f) for f, c in told.items()])
    given = F.when(F.col("male") & ~F.col("female"), "male").when(F.col("female") & ~F.col("male"), "female").when(F.col("male") | F.col("neutral"), "neutral").otherwise("surname")
    return forms.select("kind", "norm", F.when(F.col("kind") == "name", given).otherwise("").alias("form"))


def assign(every: DataFrame, key: str = KEY) -> DataFrame:
    """(kind, norm, form, surrogate, attempt) for each entity: surrogates are distinct within a kind and are no real entities."""
    every = stored(every, "entities")
    won, pending, attempt = None, every, 0
    while True:
        tried = pending.withColumn("surrogate", core(F.col("kind"), F.col("norm"), F.col("form"), F.lit(attempt), key))
        first = tried.groupBy("kind", "surrogate").agg(F.min(F.struct("norm", "form")).alias("e"))
        real = every.select("kind", F.col("norm").alias("surrogate"))
        free = first.join(real, ["kind", "surrogate"], "left_anti")
        if won is not None:
            free = free.join(won, ["kind", "surrogate"], "left_anti")
        fresh = stored(free.select("kind", "e.norm", "e.form", "surrogate", F.lit(attempt).alias("attempt")), "surrogates")
        won = fresh if won is None else won.unionByName(fresh)
        pending = stored(pending.join(fresh, ["kind", "norm"], "left_anti"), "pending")
        if pending.isEmpty():
            return won
        attempt += 1


def _replaced(key: str, known: Column | None) -> Column:
    """The text put together again, each hit by its surrogate; known maps kind|norm of the exceptions to attempt:form."""

    def surrogate_of(kind: Column, norm: Column) -> Column:
        usual = F.when(kind == "name", "0:surname").otherwise("0:")
        told = usual if known is None else F.coalesce(F.element_at(known, F.concat(kind, F.lit("|"), norm)), usual)
        return let(told, lambda x: core(kind, norm, F.substring_index(x, ":", -1), F.substring_index(x, ":", 1).cast("int"), key))

    def one(part: Column) -> Column:
        def put(norm: Column) -> Column:
            domain = F.concat(F.lit("@"), surrogate_of(F.lit("domain"), F.substring_index(norm, "@", -1)))
            whole = let(surrogate_of(part.kind, norm), lambda s: F.when(part.kind == "email", F.concat(F.substring_index(s, "@", 1), domain)).otherwise(s))
            return let(whole, lambda surrogate: _rendered(part.kind, part.value, norm, surrogate))

        return let(normalised(part.kind, part.value), put)

    def parts(h: Column) -> Column:
        """The entities a hit stands for: a person's words, or the hit itself."""
        words = F.when(h.kind == "person", F.transform(_named_parts(h.value), lambda n: n.value)).when(h.kind == "bare", F.array(h.value))
        return F.when(words.isNotNull(), F.transform(words, lambda w: F.struct(F.lit("name").alias("kind"), w.alias("value")))).otherwise(F.array(F.struct(h.kind.alias("kind"), h.value.alias("value"))))

    def hit(h: Column) -> Column:
        title = F.when((h.kind == "person") & _titled(F.split(h.value, " ")), F.concat(F.substring_index(h.value, " ", 1), F.lit(" "))).otherwise("")
        return F.concat(h.before, title, F.array_join(F.transform(parts(h), one), " "))

    puts = F.transform(F.col("__hits"), hit)
    return F.array_join(F.flatten(F.zip_with("__pieces", puts, lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")


def session_key(spark: SparkSession) -> str:
    return spark.conf.get(KEY_SETTING, KEY)


def replace(documents: DataFrame, key: str | None = None) -> DataFrame:
    """documents with surrogates in `text` and the array `entities` of (kind, n) that were replaced."""
    key = session_key(documents.sparkSession) if key is None else key
    beyond = stored(assign(entities(documents), key).filter("attempt > 0 or form not in ('', 'surname')"), "exceptions")
    beyond = beyond.select(F.concat("kind", F.lit("|"), "norm").alias("entity"), F.concat("attempt", F.lit(":"), "form").alias("told"))
    marked = detected(documents.drop("entities"))
    few = beyond.limit(MAP_ROWS + 1).collect()
    kinds = F.transform(F.col("__hits"), lambda h: F.when(h.kind == "bare", "person").otherwise(h.kind))
    counts = F.transform(F.array_sort(F.array_distinct(kinds)), lambda k: F.struct(k.alias("kind"), F.size(F.filter(kinds, lambda o: o == k)).alias("n")))

    def put(rows: DataFrame, known: Column | None) -> DataFrame:
        out = rows.withColumn("entities", counts).withColumn("text", F.when(F.size("__hits") > 0, _replaced(key, known)).otherwise(F.col("text")))
        return out.drop("__hits", "__names", "__pieces", "__told")

    if len(few) <= MAP_ROWS:
        return put(marked, F.from_json(F.lit(json.dumps({r.entity: r.told for r in few})), "map<string,string>") if few else None)
    # the texts that hold an exception, each once, with what is told of its entities; rows without hits stay out of the join
    held = marked.filter(F.size("__hits") > 0).withColumn("__digest", F.sha2(F.col("text"), 256))
    units = held.select("__digest", F.explode(_units(F.col("__hits"), F.col("__names"))).alias("u")).select("__digest", F.concat("u.kind", F.lit("|"), "u.norm").alias("entity"))
    own = units.groupBy("__digest", "entity").agg(F.count("*").alias("n")).join(beyond, "entity")
    own = own.groupBy("__digest").agg(F.map_from_entries(F.collect_list(F.struct("entity", "told"))).alias("__told"), F.max("n").alias("n"))
    joined = put(join_counted(held, stored(own, "told-texts"), "__digest", how="left").drop("__digest"), F.col("__told"))
    return joined.unionByName(put(marked.filter(F.size("__hits") == 0), None))
