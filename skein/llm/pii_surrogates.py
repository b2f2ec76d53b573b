"""PII surrogates in DataFrame functions only: every entity gets a keyed, type-consistent stand-in.

Entities: secrets after a marker (``password=x``, ``"api_key": "x"``, ``token: x1``), keys of known form, e-mail,
IBAN (also spaced), phone, payment card (valid check digit), IPv4, IPv6, US social security number, and person
names after a title or with a known given name.  A canonical form (an e-mail in lower case, the digits of a number)
and a secret key fix an entity's surrogate in every document, so mentions of one entity stay mentions of one.
A name is made of its parts, each with a stand-in of its own: "Mr. John Smith" and "Mr. Smith" keep a surname in
common (coreference), and unlike names stay unlike.  Surrogates keep type and format: separators, positions of
digits, country codes, a card's first digit and valid check digits; names keep gender (by title, known given name
or surname form), script and number of words; e-mails keep their shape and one domain stays one domain.

Collision checks keep distinct entities distinct: two entities of a type may not share a surrogate, and no
surrogate may equal an entity that occurs.  The smaller entity keeps it; the other tries again with the next
attempt number.  From attempt ``WIDE`` on surrogates grow by two signs each time, so that a format whose space is
used up (all four-digit PINs) still ends, and attempt ``LAST`` carries 40 further signs and is taken as it is.

Defined edge cases: null texts stay null, texts without entities stay as they are; a value without letters and
digits (``password=****``) is no entity; repeated rows get the same result, null ids too; an empty table gives an
empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, free, join_by_size

#: Common given names that mark a person without a title, by gender.
FEMALE_NAMES = ("Alice", "Amelia", "Anna", "Barbara", "Caroline", "Charlotte", "Claire", "Elena", "Elizabeth", "Emily", "Emma", "Hannah", "Isabel", "Jennifer", "Jessica", "Julia", "Katharina", "Laura", "Linda", "Margaret", "Maria", "Nicole", "Olivia", "Patricia", "Rachel", "Sarah", "Sophie", "Susan", "Анна", "Елена", "Ирина", "Мария", "Наталья", "Ольга", "Татьяна")
MALE_NAMES = ("Alexander", "Andrew", "Anthony", "Benjamin", "Charles", "Christopher", "Daniel", "David", "Edward", "Felix", "George", "Hans", "Henry", "James", "Jean", "John", "Jonathan", "Joseph", "Klaus", "Lucas", "Matthew", "Michael", "Nicholas", "Oliver", "Peter", "Richard", "Robert", "Stefan", "Thomas", "William", "Александр", "Андрей", "Дмитрий", "Иван", "Михаил", "Сергей")
#: A word of a name: inner capitals, hyphens and apostrophes belong to it, a possessive 's does not.
NAME = r"\p{Lu}(?:[\p{L}\p{M}]++|['’-](?!s(?![\p{L}\p{M}]))(?=\p{L})[\p{L}\p{M}]++)++"
REST = rf"(?: (?:\p{{Lu}}\.|{NAME}))"
FEMALE = r"^(?:Mrs|Ms|Frau|Mme|Señora|Sra|госпожа)\b"
MALE = r"^(?:Mr|Herr|M\.|Señor|Sr|господин)"
TITLES = r"(?:Mrs?\.?|Ms\.?|Dr\.?|Prof\.?|Herr|Frau|Mme|M\.|Señora?|Sra?\.?|господин|госпожа) "
TITLE = r"^" + TITLES
_KEYS = r"(?i:password|passwd|passphrase|pwd|token|secret|api[_-]?key|access[_-]?key|private[_-]?key)[\"']?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_SIGN = r"[^\s\"']"
#: What stands before a secret: a separator right before, then (looked for only there) the marker.
AFTER = rf"(?:(?<=[=:])(?<={_KEYS}[=:])|(?<=[\"'])(?<={_KEYS}[ \t]{{0,2}}[=:][ \t]{{0,2}}[\"']))"
SPACED = rf"(?<=[=:][ \t])(?<={_KEYS}[ \t]{{0,1}}[=:][ \t])"
#: Types and patterns, the first that matches counts.  Every pattern starts at a token's edge, so scans stay linear.
PATTERNS = (
    ("secret", AFTER + rf"(?=[^\s\"'\p{{L}}\p{{N}}]*+[\p{{L}}\p{{N}}]){_SIGN}{{4,}}+"),
    ("secret", SPACED + rf"(?=[^\s\"'0-9]*+[0-9])(?=[^\s\"'\p{{L}}]*+\p{{L}}){_SIGN}{{6,}}+"),
    ("secret", r"(?<=-----)(?<=-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----)[^-]{16,}+"),
    ("secret", r"(?<=\")(?=[a-fA-F]*+[0-9])[0-9a-fA-F]{32,}+(?=\")"),
    ("secret", r"(?<!\w)(?:AKIA[0-9A-Z]{16}|ghp_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,}+|eyJ[\w-]{10,}+\.[\w-]{10,}+\.[\w-]++)(?!\w)"),
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+){0,126}\.[A-Za-z]{2,24}"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?!\w)"),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:(?:[ .-]\d{2,4}){2,3}|[ .-]?\d{5,10})(?!\d)|(?<![\w+])\+\d{8,15}(?!\d)"),
    ("phone", r"(?<![\w(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}([.-])\d{3}\1\d{4}(?![\d-])"),
    ("card", r"(?<![\w-])(?:\d{4}([ -]?)\d{4}\2\d{4}\2\d{4}|3[47]\d{2}([ -]?)\d{6}\3\d{5})(?![\d-])"),
    ("ip", rf"(?<![\w.])(?=\d)(?<!(?i:version|release|build|rev) )(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\w])"),
    ("ip", r"(?<![\w:.])(?=[0-9A-Fa-f]{1,4}:)(?=[0-9A-Fa-f:]{0,39}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("person", r"(?<!\p{L})" + TITLES + NAME + REST + "{0,2}"),
    ("person", r"(?<!\p{L})(?=\p{Lu})(?:" + "|".join(FEMALE_NAMES + MALE_NAMES) + ")" + REST + "{1,2}"),
)
#: No pattern begins inside a word of ASCII letters or at a blank, which leaves most places of a text at once.
ANY = r"(?<![A-Za-z])(?=\S)(?:" + "|".join(f"(?:{p})" for _, p in PATTERNS) + ")"
#: Put before and after each entity of a text; texts that hold it are cut in another way.
MARK = "\ufdd0"
HEX, DIGITS = "0123456789abcdef", "abcdef"
#: Signs of a class are replaced by others of it; the last two take letters and digits of all other scripts.
CLASSES = (
    ("[0-9]", "0123456789"),
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    ("[A-Z]", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    (r"[\p{IsCyrillic}&&\p{Ll}]", "абвгдежзиклмнопрстуфхцчшэюя"),
    (r"[\p{IsCyrillic}&&\p{Lu}]", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ"),
    (r"[\p{IsGreek}&&\p{Ll}]", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"[\p{IsGreek}&&\p{Lu}]", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    (r"[\p{IsLatin}&&\p{Ll}]", "àáâäåæçèéêëìíîïñòóôöøùúûü"),
    (r"[\p{IsLatin}&&\p{Lu}]", "ÀÁÂÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÖØÙÚÛÜ"),
    (r"\p{IsHan}", "一二三四五六七八九十人大小山水火木金土日月上下中"),
    (r"\p{L}", "abcdefghijklmnopqrstuvwxyz"),
    (r"\p{N}", "0123456789"),
)
#: Consonants (one for each hex digit) and vowels of made-up names, by script.
SOUNDS = {"latin": ("bdfghklmnprstvwz", "aeiouaeiouaeioua"), "cyrillic": ("бвгджзклмнпрстфх", "аеиоуаеиоуаеиоуа"), "greek": ("βγδζθκλμνξπρστφχ", "αεηιοαεηιοαεηιοα")}
#: Attempts from which surrogates grow, and the last one.
WIDE, LAST = 6, 24


def _chars(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))


def kind_of(surface: Column, before: Column) -> Column:
    """Type of a match, by its form and what stands before it; null for numbers that only look like a card."""
    return (
        F.when(before.rlike(f"(?:{_KEYS}[ \t]{{0,2}}[=:][ \t]{{0,2}}[\"']?|PRIVATE KEY-----)$"), "secret")
        .when(surface.contains("@") & surface.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,24}$"), "email")
        .when(surface.rlike(r"^[A-Z]{2}\d{2}[ A-Z0-9]{10,44}$") & ~surface.rlike(r"^AKIA"), "iban")
        .when(surface.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^[0-9A-Fa-f]{0,4}:[0-9A-Fa-f:]+$"), "ip")
        .when(surface.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(surface.rlike(r"^(?:\+[\d .()-]{8,}|\(\d{3}\) ?\d{3}-\d{4}|\d{3}([.-])\d{3}\1\d{4})$"), "phone")
        .when(surface.rlike(r"^\d[\d -]{13,18}$"), F.when(_luhn(F.regexp_replace(surface, r"\D", "")) == 0, "card"))
        .when(surface.rlike(r"^[\p{L}.]+ \p{Lu}"), "person")
        .otherwise("secret")
    )


def _luhn(digits: Column) -> Column:
    """Check sum modulo 10 of a number, its last digit included."""
    twice = F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)])
    add = lambda s, c, i: s + F.when(i % 2 == 1, F.element_at(twice, c + 1)).otherwise(c)
    signs = F.transform(F.reverse(_chars(digits)), lambda c, i: F.struct(c.cast("int").alias("c"), i.alias("i")))
    return F.aggregate(signs, F.lit(0), lambda s, x: add(s, x["c"], x["i"])) % 10


def _mod97(text: Column) -> Column:
    """The number that a text of digits and letters (A = 10) stands for, modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    return F.aggregate(_chars(text), F.lit(0), lambda s, c: (F.when(value(c) > 9, s * 100).otherwise(s * 10) + value(c)) % 97)


def canonical(kind: Column, surface: Column) -> Column:
    """What makes two mentions one entity."""
    return (
        F.when(kind.isin("email", "ip") | kind.startswith("given") | kind.startswith("surname"), F.lower(surface))
        .when(kind == "phone", F.concat(F.regexp_extract(surface, r"^\+", 0), F.regexp_replace(surface, r"\D", "")))
        .when(kind.isin("card", "ssn"), F.regexp_replace(surface, r"\D", ""))
        .when(kind == "iban", F.replace(surface, F.lit(" "), F.lit("")))
        .otherwise(F.regexp_replace(surface, r"(?<=.{3})[.,;:!?)\]}>]+$", ""))
    )


PART = "struct<kind:string,canon:string,surface:string>"


def parts_of(kind: Column, surface: Column) -> Column:
    """The entities that a mention holds, in order: itself, or the words of a person's name."""
    words = F.split(F.regexp_replace(surface, TITLE, ""), " ")
    known = lambda names: F.element_at(words, 1).isin(*names)
    gender = F.when(surface.rlike(FEMALE), "f").when(surface.rlike(MALE), "m").when(known(FEMALE_NAMES), "f").when(known(MALE_NAMES), "m").otherwise("n")
    own = F.when(gender == "f", "f").otherwise("m")

    def word(w: Column, i: Column) -> Column:
        last = F.when(w.rlike(r"^\p{IsCyrillic}"), F.concat(F.lit("surname_"), own)).otherwise("surname")
        k = F.when(w.endswith("."), "initial").when(i + 1 == F.size(words), last).otherwise(F.concat(F.lit("given_"), gender))
        return F.struct(k.alias("kind"), canonical(k, w).alias("canon"), w.alias("surface"))

    return F.when(kind == "person", F.transform(words, word)).otherwise(F.array(F.struct(kind.alias("kind"), canonical(kind, surface).alias("canon"), surface.alias("surface"))))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """128 hex digits that only the key's owner can foresee."""
    said = F.concat_ws("|", F.lit(key), kind, canon, attempt.cast("string"))
    return F.concat(F.sha2(said, 256), F.sha2(F.concat(said, F.lit("|2")), 256))


def _refill(surface: Column, stream: Column) -> Column:
    """The surface with every letter and digit replaced by one of its script and class."""

    def one(c: Column, i: Column) -> Column:
        pick = F.conv(F.substring(stream, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int")
        out = F.when(c.rlike(CLASSES[0][0]), F.substring(F.lit(CLASSES[0][1]), pick % 10 + 1, F.lit(1)))
        for pattern, signs in CLASSES[1:]:
            out = out.when(c.rlike(pattern), F.substring(F.lit(signs), pick % len(signs) + 1, F.lit(1)))
        return out.otherwise(c)

    return F.array_join(F.transform(_chars(surface), one), "")


def _put(surface: Column, signs: Column, class_: str = "[0-9]") -> Column:
    """The surface with its signs of a class, in order, taken from ``signs``; what is left of these follows."""
    parts = _chars(surface)
    nth = lambda i: F.size(F.filter(F.slice(parts, F.lit(1), i + 1), lambda x: x.rlike(class_)))
    put = F.array_join(F.transform(parts, lambda c, i: F.when(c.rlike(class_), F.substring(signs, nth(i), F.lit(1))).otherwise(c)), "")
    return F.concat(put, F.substring(signs, F.size(F.filter(parts, lambda x: x.rlike(class_))) + 1, F.lit(64)))


def surrogate(key: str, kind: Column, surface: Column, canon: Column, attempt: Column) -> Column:
    """The stand-in for one entity as it is written in one place; its canonical form depends on ``canon`` alone."""
    # a lambda's variable holds the stream, so that it is hashed once
    return F.element_at(F.transform(F.array(_stream(key, kind, canon, attempt)), lambda s: _made(key, s, kind, surface, canon, attempt)), 1)


def _made(key: str, s: Column, kind: Column, surface: Column, canon: Column, attempt: Column) -> Column:
    digits = F.translate(s, DIGITS, "604827")
    byte = lambda i: F.conv(F.substring(s, F.lit(2 * i + 1), F.lit(2)), 16, 10).cast("int")
    # further signs of late attempts
    more = F.when(attempt >= LAST, 40).when(attempt >= WIDE, 2 * (attempt - WIDE + 1)).otherwise(0)
    grown = lambda signs: F.substring(signs, F.lit(80), more)
    letters = F.translate(s, HEX, SOUNDS["latin"][0])

    domain = F.substring_index(canon, "@", -1)
    site = F.element_at(F.transform(F.array(_stream(key, F.lit("domain"), domain, F.lit(0))), lambda x: _refill(F.regexp_replace(domain, r"\.[^.]*$", ""), x)), 1)
    email = F.concat(_refill(F.substring_index(canon, "@", 1), s), grown(letters), F.lit("@"), site, F.lit(".example"))
    # the country code stays, one of three digits where no shorter one is given out
    code = F.length(F.regexp_extract(canon, r"^\+(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})", 1))
    n = F.length(F.regexp_replace(canon, r"\D", ""))
    phone = _put(surface, F.concat(F.substring(F.replace(canon, F.lit("+"), F.lit("")), F.lit(1), code), F.substring(digits, F.lit(1), n - code), grown(digits)))
    body = F.concat(F.substring(canon, 1, 1), F.substring(digits, F.lit(1), n - 2))
    card = _put(surface, F.concat(body, F.pmod(10 - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"), grown(digits)))
    v4 = F.concat_ws(".", *[(byte(i) % 254 + 1).cast("string") for i in range(4)])
    v6 = F.concat(F.lit("fd"), F.substring(s, 1, 2), F.lit(":"), F.concat_ws(":", *[F.substring(s, 3 + 4 * i, 4) for i in range(7)]))
    ip = F.when(canon.contains(":"), F.when(attempt < WIDE, _put(canon, F.substring(s, F.lit(3), F.length(F.replace(canon, F.lit(":"), F.lit("")))), "[0-9a-f]")).otherwise(v6)).when(attempt < WIDE, v4).otherwise(v6)
    ssn = _put(surface, F.concat(F.lit("9"), F.substring(digits, 1, 8), grown(digits)))
    bban = F.concat(_refill(F.substring(canon, F.lit(5), F.length(canon)), s), grown(digits))
    check = F.lpad((98 - _mod97(F.concat(bban, F.substring(canon, 1, 2), F.lit("00")))).cast("string"), 2, "0")
    iban = _put(surface, F.concat(F.substring(canon, 1, 2), check, bban), "[A-Z0-9]")

    cyrillic, greek = canon.rlike(r"^\p{IsCyrillic}"), canon.rlike(r"^\p{IsGreek}")

    def name(script: str, at: int, n: int, end: Column) -> Column:
        con, vow = SOUNDS[script]
        sound = [F.translate(F.substring(s, at + i, 1), HEX, (con, vow)[i % 2]) for i in range(n)]
        return F.concat(F.initcap(F.concat(*sound, F.translate(F.substring(s, F.lit(80), more), HEX, con))), end)

    f, m = kind.endswith("_f"), kind.endswith("_m")
    given = (
        F.when(cyrillic, name("cyrillic", 1, 6, F.when(f, "на").when(m, "н").otherwise("")))
        .when(greek, name("greek", 1, 6, F.when(f, "να").when(m, "νος").otherwise("")))
        .otherwise(name("latin", 1, 6, F.when(f, "na").when(m, "n").otherwise("")))
    )
    last = lambda at: F.when(cyrillic, name("cyrillic", at, 7, F.when(f, "ина").otherwise("ин"))).when(greek, name("greek", at, 7, F.lit("ης"))).otherwise(name("latin", at, 7, F.lit("er")))
    surname = F.when(canon.rlike(r"\p{L}-\p{L}"), F.concat(last(1), F.lit("-"), last(20))).otherwise(last(1))
    person = F.when(kind.startswith("given"), given).otherwise(surname)
    person = F.when((F.length(surface) > 2) & (F.upper(surface) == surface), F.upper(person)).otherwise(person)

    hexes = F.substring(F.repeat(s, F.ceil(F.length(canon) / 128).cast("int")), F.lit(1), F.length(canon))
    told = F.when(canon.rlike(r"^(?=.*[a-f])[0-9a-f]{8,}$"), hexes).when(canon.rlike(r"^(?=.*[A-F])[0-9A-F]{8,}$"), F.upper(hexes))
    fixed = F.regexp_extract(canon, r"^(AKIA|ghp_|sk-|eyJ)", 1)
    told = told.otherwise(F.concat(fixed, _refill(F.substring(canon, F.length(fixed) + 1, F.length(canon)), s)))
    secret = F.concat(told, F.when(canon.rlike("^[0-9]+$"), grown(digits)).otherwise(grown(letters)), F.substring(surface, F.length(canon) + 1, F.length(surface)))
    return (
        F.when(kind == "email", email).when(kind == "phone", phone).when(kind == "card", card).when(kind == "ip", ip).when(kind == "ssn", ssn).when(kind == "iban", iban)
        .when(kind == "initial", _refill(surface, s)).when(kind.startswith("given") | kind.startswith("surname"), person).otherwise(secret)
    )


def attempts(entities: DataFrame, key: str) -> DataFrame:
    """Attempt numbers above 0 of ``entities(kind, canon, surface)``, one row per entity that had to try again."""
    spark = entities.sparkSession
    real = durable(entities.where("kind <> 'initial'").select("kind", F.col("canon").alias("s")).distinct())
    open_, old = durable(entities.where("kind <> 'initial'").withColumn("attempt", F.lit(0))), []
    fixed, again = None, spark.createDataFrame([], "kind string, canon string, attempt int")
    for n in range(LAST + 1):
        tried = open_.withColumn("s", canonical(F.col("kind"), surrogate(key, F.col("kind"), F.col("surface"), F.col("canon"), F.col("attempt"))))
        tried = durable(tried)
        if n == LAST:  # 40 further signs
            again = again.union(tried.select("kind", "canon", "attempt"))
            break
        won = tried.groupBy("kind", "s").agg(F.min("canon").alias("canon"))
        won = won.join(real, ["kind", "s"], "left_anti")
        if fixed is not None:
            won = won.join(fixed.select("kind", "s"), ["kind", "s"], "left_anti")
        won = durable(won)
        fixed = won if fixed is None else fixed.union(won)
        if n:
            again = again.union(tried.join(won.select("kind", "canon"), ["kind", "canon"], "left_semi").select("kind", "canon", "attempt"))
        old += [open_]
        open_ = durable(tried.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "surface", (F.col("attempt") + 1).alias("attempt")))
        if open_.isEmpty():
            break
    out = durable(again)
    free(real, *old)
    return out


def pseudonymise(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``id_col, text`` with surrogates, ``n_entities, entities`` (kind and surrogate of each mention, in order)."""
    t = F.col("text")
    d = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # one pass over the texts cuts them at their entities: plain, entity, plain, ... plain
    found = F.regexp_extract_all(t, F.lit(ANY), F.lit(0))
    rare = F.flatten(F.zip_with(F.split(t, ANY, -1), F.concat(found, F.array(F.lit(""))), lambda a, b: F.array(a, b)))
    pieces = F.when(t.contains(MARK), F.slice(rare, F.lit(1), F.size(rare) - 1)).otherwise(F.split(F.regexp_replace(t, ANY, MARK + "$0" + MARK), MARK, -1))
    d = durable(d.withColumn("pieces", pieces).select("id", F.when(F.coalesce(F.size("pieces"), F.lit(0)) <= 1, t).alias("text"), F.when(F.size("pieces") > 1, F.col("pieces")).alias("pieces")))
    p = F.col("pieces")
    at = F.transform(F.sequence(F.lit(1), F.size(p) - 1, F.lit(2)), lambda i: F.struct(F.element_at(p, i + 1).alias("surface"), F.element_at(p, i).alias("before")))
    kinds = F.transform(at, lambda x: F.struct(x["surface"].alias("surface"), kind_of(x["surface"], F.right(x["before"], F.lit(40))).alias("kind")))
    mentions = F.transform(kinds, lambda x: F.struct(x["kind"].alias("kind"), x["surface"].alias("surface"), F.when(x["kind"].isNotNull(), parts_of(x["kind"], x["surface"])).alias("parts")))
    d = d.withColumn("mentions", F.when(p.isNotNull(), mentions))
    said = lambda **more: d.where("mentions is not null").select(*(c.alias(k) for k, c in more.items()), F.explode(F.array_distinct(F.flatten(F.filter(F.col("mentions.parts"), lambda x: x.isNotNull())))).alias("e")).select(*more, "e.*")
    entities = durable(said().groupBy("kind", "canon").agg(F.min("surface").alias("surface")))
    again = attempts(entities, key)
    if again.isEmpty():
        d = d.withColumn("tries", F.lit(None).cast("map<string,int>"))
    else:
        # the few documents that hold an entity of another attempt get a map of these
        dk = F.xxhash64("id", "pieces")
        hold = said(dk=dk).select("dk", F.concat_ws("|", "kind", "canon").alias("e"))
        hold = join_by_size(hold, durable(again.select(F.concat_ws("|", "kind", "canon").alias("e"), "attempt")), "e", row_bytes=256)
        hold = hold.distinct().groupBy("dk").agg(F.map_from_entries(F.collect_list(F.struct("e", "attempt"))).alias("tries"))
        d = join_by_size(d.withColumn("dk", dk), durable(hold), "dk", "left", row_bytes=512).drop("dk")

    def part(x: Column) -> Column:
        tries = F.coalesce(F.try_element_at(F.col("tries"), F.concat_ws("|", x["kind"], x["canon"])), F.lit(0))
        return surrogate(key, x["kind"], x["surface"], x["canon"], tries)

    def stand_in(x: Column) -> Column:
        put = F.concat(F.regexp_extract(F.when(x["kind"] == "person", x["surface"]).otherwise(""), TITLE, 0), F.array_join(F.transform(x["parts"], part), " "))
        return F.struct(x["kind"].alias("kind"), F.when(x["kind"].isNull(), x["surface"]).otherwise(put).alias("surrogate"))

    d = d.withColumn("put", F.when(F.col("mentions").isNotNull(), F.transform("mentions", stand_in)))
    plain = F.transform(F.sequence(F.lit(1), F.size("pieces"), F.lit(2)), lambda i: F.element_at("pieces", i))
    text = F.array_join(F.zip_with(plain, F.concat(F.transform("put", lambda e: e["surrogate"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    none = F.array().cast("array<struct<kind:string,surrogate:string>>")
    out = F.coalesce(F.filter("put", lambda e: e["kind"].isNotNull()), none)
    return d.select(F.col("id").alias(id_col), F.when(F.col("pieces").isNotNull(), text).otherwise(F.col("text")).alias("text"), out.alias("entities")).select(id_col, "text", F.size("entities").alias("n_entities"), "entities")
