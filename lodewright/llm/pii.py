"""PII: detected entities are replaced by keyed surrogates, with DataFrame functions alone.

One pattern finds e-mail addresses, IPv4, IPv6 and MAC addresses, account and card
numbers, IBANs, social security and telephone numbers, secrets (keyed values, long
hexadecimal strings, JSON web tokens, private key blocks) and titled names. A surrogate
depends on a key and on the entity alone, so the same entity gets the same surrogate
everywhere, and has its type and format: digits stand for digits, letters for letters
of the same case, punctuation stays.

* Numbers go through a keyed Feistel network over their digits, which is one to one,
  whatever stands between the digits; an account and an international number keep their
  first digit, and a valid Luhn check digit stays valid. IPv4 addresses go through one
  over 32 bits.
* E-mail addresses, IBANs and secrets take characters from a keyed digest; domains are
  mapped on their own, so that addresses of one domain stay together, and keep their last
  label; a valid IBAN stays valid.
* Names keep their title; given names match its gender, all parts match their script
  (Latin, Cyrillic or Greek); each part is mapped on its own, so "Mr. Smith" follows "Mr. John Smith".

Collision checks: what is told apart (of names, each part; else the entity without case
and punctuation) is held with its surrogate against all others and against the real ones
of the corpus; one that meets another, a real one or itself is derived anew until no
clash is left, or an error is raised. Names start with as many syllables as their number
asks for; formats without room grow after some rounds. Only these exceptions are looked
up when texts are rewritten, by the list of entities of a text.

Defined cases: null texts stay null, texts without an entity stay as they are; repeated
rows are rewritten alike, whatever their doc_id, which is not read and may be null; very
long texts are read whole; an empty table stays empty; other columns pass through, and
none of the names used inside can clash with them.
"""

from __future__ import annotations

import secrets
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodewright.llm.fingerprint import small_or_shuffled
from lodewright.storage import materialize

OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
#: Titles by the gender they tell.
MALE = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "г-н", "κ")
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа", "κα")
OPEN = ("Dr", "Prof")
TITLE = r"(?:" + "|".join(sorted(MALE + FEMALE + OPEN, key=len, reverse=True)) + r")\.? "
NAME_PART = r"\p{Lu}\p{Ll}+(?:-\p{Lu}\p{Ll}+)?"
#: An entity starts where no letter or digit comes before it; the types' patterns follow this one look back. Their order matters.
START = r"(?<![\p{L}\p{N}])"
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IP = rf"(?<!\d\.)(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)"
MAC = r"(?<![0-9A-Fa-f][:-])[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}(?![:-]?[0-9A-Za-z])"
IPV6 = r"(?<!:)(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){7}|[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,6}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,4})?|[0-9A-Fa-f]{1,4}::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){1,5})(?![:0-9A-Za-z])"
TOKEN = r"eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"
BLOCK = r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----[A-Za-z0-9+/=\s]++-----END [A-Z ]{0,20}PRIVATE KEY-----"
KEYED = r"(?<=[=:\"' ])(?=[A-Za-z0-9_+/-]{8})(?<=[=:]\s{0,2}[\"']{0,1})(?<=(?i:token|secret|passw(?:or)?d|api[_-]?key|access[_-]?key)[\"']?\s{0,2}[=:]\s{0,2}[\"']?)[A-Za-z0-9_+/-]{8,}"
HEXED = r"(?=[0-9A-Fa-f]{32})(?=[0-9]*[A-Fa-f])(?=[A-Fa-f]*[0-9])(?:[0-9a-f]{32,}|[0-9A-F]{32,})(?![A-Za-z0-9])"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?\d{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<!\d\.)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?![\dA-Za-z])"
PHONE = r"(?<!\d\.)(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\d)"
SSN = r"(?<!\d-)\d{3}-\d{2}-\d{4}(?![\d-])"
NAME = rf"{TITLE}{NAME_PART}(?: {NAME_PART}){{0,2}}"
PATTERN = START + "(?:" + "|".join((EMAIL, IP, TOKEN, BLOCK, KEYED, HEXED, MAC, IPV6, IBAN, CARD, PHONE, SSN, NAME)) + ")"
#: A text that has neither of these has no entity.
MARKS, TITLED = "[0-9@=:]|eyJ|-----B", rf"{START}{TITLE}\p{{Lu}}"
#: Characters that stand around entities while a text is taken apart, and what stands for those of them that a text has.
EDGE, ESCAPE, EDGE_AS, ESCAPE_AS = "\u0001", "\u0002", "\u0002\u0003", "\u0002\u0004"

#: Given names and the syllables of surnames by script.
GIVEN = {
    ("latin", "m"): ("Adrian", "Bruno", "Cedric", "Dario", "Emil", "Felix", "Gregor", "Hugo", "Ivo", "Jonas", "Karl", "Leon", "Marco", "Nils", "Oscar", "Pablo"),
    ("latin", "f"): ("Alma", "Bianca", "Clara", "Diana", "Elisa", "Flora", "Greta", "Helena", "Irene", "Julia", "Katja", "Laura", "Marta", "Nora", "Olga", "Paula"),
    ("latin", "o"): ("Alex", "Charlie", "Dominique", "Eli", "Jamie", "Jules", "Kim", "Lou", "Maxime", "Noa", "Robin", "Sam", "Sascha", "Toni", "Valentine", "Yael"),
    ("cyrillic", "m"): ("Антон", "Борис", "Вадим", "Глеб", "Денис", "Егор", "Захар", "Иван"),
    ("cyrillic", "f"): ("Алина", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Ирина"),
    ("cyrillic", "o"): ("Саша", "Женя", "Валя", "Шура", "Слава", "Тоша", "Паша", "Вася"),
    ("greek", "m"): ("Αδάμ", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θωμάς", "Ιάσων", "Κώστας"),
    ("greek", "f"): ("Αθηνά", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα"),
    ("greek", "o"): ("Αρετή", "Εύα", "Ηβη", "Θάλεια", "Μένη", "Νίκη", "Φανή", "Χαρά"),
}
SYLLABLES = {
    "latin": ("ba", "del", "fer", "gan", "hol", "kir", "lam", "mon", "nel", "par", "ros", "sel", "tor", "var", "wen", "zan"),
    "cyrillic": ("ба", "вер", "гор", "дан", "жар", "зен", "кир", "лом", "мар", "нов", "пет", "рас", "сел", "тор", "фед", "чер"),
    "greek": ("βα", "γερ", "δαν", "ζαν", "θεο", "καρ", "λαμ", "μαν", "νικ", "παπ", "ραλ", "σαρ", "τσι", "φωτ", "χρι", "ψαρ"),
}
#: The role of a name's last part; other parts have their title's gender. Attempts before a format may grow, and after which clashes are an error.
SURNAME, GROW, ROUNDS = "s", 3, 24
ENDINGS = {"latin": ("er", "son", "ini", "ez"), "cyrillic": ("ов", "ин", "енко", "ский"), "greek": ("ίδης", "όπουλος", "άκης", "άς")}
#: Syllables of the shortest surname, and how many surrogates there are for each name part at least.
LEAST_SYLLABLES, ROOM = 3, 4
#: Units whose surrogates one task derives.
TASK_UNITS = 50_000


def session_key(spark: SparkSession) -> str:
    """The key of surrogates: the setting ``spark.lodewright.pii.key``, or one drawn at random for this session."""
    name = "spark.lodewright.pii.key"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(16))
    return spark.conf.get(name)


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once."""
    return F.transform(F.array(value), use)[0]


def _keyed(key: str, *parts: Column) -> Column:
    """64 hexadecimal digits from the key and the parts."""
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 256)


def _number(hexed: Column, at: int | Column = 1, digits: int = 15) -> Column:
    return F.conv(F.substring(hexed, F.lit(at) if isinstance(at, int) else at, F.lit(digits)), 16, 10).cast("long")


def _feistel(key: str, left: Column, right: Column, left_size: Column, right_size: Column, tweak: Column) -> Column:
    """A one-to-one map of pairs (left, right), as a struct of that."""

    def turn(pair: Column, i: Column) -> Column:
        own, other, size = (F.when(i % 2 == 0, a).otherwise(b) for a, b in ((pair["l"], pair["r"]), (pair["r"], pair["l"]), (left_size, right_size)))
        moved = F.pmod(own + _number(_keyed(key, tweak, i, other)) % size, size)
        return F.struct(F.when(i % 2 == 0, moved).otherwise(pair["l"]).alias("l"), F.when(i % 2 == 0, pair["r"]).otherwise(moved).alias("r"))

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(5)), start, turn)


def _digits(key: str, digits: Column, attempt: Column) -> Column:
    """A one-to-one map of digit strings of one length (2 to 36)."""
    n = F.length(digits)
    a = F.floor(n / 2).cast("int")
    ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
    pair = _feistel(key, F.substring(digits, F.lit(1), a), F.substring(digits, a + 1, n - a), ten(a), ten(n - a), F.concat_ws("|", n, attempt))
    return _let(pair, lambda p: F.concat(F.lpad(p["l"].cast("string"), a, F.lit("0")), F.lpad(p["r"].cast("string"), n - a, F.lit("0"))))


def _luhn(digits: Column, with_check: bool) -> Column:
    """Luhn sum modulo 10 of digits, read from the right; the last one is the check digit if ``with_check``."""
    each = F.reverse(F.split(digits, ""))
    first = 0 if with_check else 1

    def worth(d: Column, i: Column) -> Column:
        v = d.cast("int")
        return F.when((i + first) % 2 == 0, v).otherwise(F.when(v * 2 > 9, v * 2 - 9).otherwise(v * 2))

    return F.aggregate(F.transform(each, worth), F.lit(0), lambda s, v: s + v) % 10


def _dealt(shape: Column, characters: Column, places: str) -> Column:
    """``shape`` with its characters of a class replaced in turn."""
    return F.array_join(F.zip_with(F.split(shape, places, -1), F.concat(F.split(characters, ""), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _numeric(key: str, entity: Column, attempt: Column, kept: Column) -> Column:
    """Every digit replaced (the ``kept`` leading ones stay); a Luhn-valid number of 13 digits or more stays valid."""

    def moved(d: Column) -> Column:
        valid = (F.length(d) >= 13) & (_luhn(d, True) == 0)
        n = F.length(d) - kept - valid.cast("int")
        body = F.concat(F.substring(d, F.lit(1), kept), _digits(key, F.substring(d, kept + 1, n), attempt))
        return _let(body, lambda b: F.when(valid, F.concat(b, ((10 - _luhn(b, False)) % 10).cast("string"))).otherwise(b))

    return _dealt(entity, _let(F.regexp_replace(entity, "[^0-9]", ""), moved), "[0-9]")


def _spelled(key: str, text: Column, seed: Column, attempt: Column, hexed: Column) -> Column:
    """The letters and digits of a text from a keyed digest, one after the other, in their case; with ``hexed`` letters a to f."""
    letters = F.when(hexed, 6).otherwise(26)
    between = lambda c, a, b: (c >= a) & (c <= b)

    def characters(stream: Column) -> Column:
        def other(c: Column, i: Column) -> Column:
            v = _number(stream, (i % 64) * 2 + 1, 2) + F.floor(i / 64)
            letter = F.char(v % letters + 97)
            return F.when(between(c, "0", "9"), (v % 10).cast("string")).when(between(c, "a", "z"), letter).otherwise(F.upper(letter))

        return F.array_join(F.transform(F.split(F.regexp_replace(text, "[^A-Za-z0-9]", ""), ""), other), "")

    return _let(F.concat(_keyed(key, seed, attempt, F.lit(0)), _keyed(key, seed, attempt, F.lit(1))), characters)


def _more(key: str, seed: Column, attempt: Column, letters: bool = True) -> Column:
    """What is added to a surrogate whose format has had no room after ``GROW`` attempts: one character more each time."""
    hexed = _keyed(key, F.lit("more"), attempt, seed)
    return F.substring(F.translate(hexed, "0123456789abcdef", "abcdefghijklmnop") if letters else F.translate(hexed, "abcdef", "012345"), F.lit(1), F.greatest(F.lit(0), attempt - GROW))


def _remainder(iban: Column) -> Column:
    """A compact IBAN modulo 97, its first four characters moved to the end."""
    each = F.split(F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, 1, 4)), "")
    return F.aggregate(each, F.lit(0), lambda s, c: F.when(c >= "A", s * 100 + F.ascii(c) - 55).otherwise(s * 10 + F.ascii(c) - 48) % 97)


def _letters(key: str, entity: Column, kind: Column, attempt: Column) -> Column:
    """Surrogates that are spelled: of an e-mail address, an IBAN, a MAC or IPv6 address, a secret."""
    mail, iban, block = kind == "email", kind == "iban", kind == "block"
    at, low = F.instr(entity, "@"), F.lower(entity)
    opening, closing = F.regexp_extract(entity, "^-----[^-]*-----", 0), F.regexp_extract(entity, "-----[^-]*-----$", 0)
    domain = F.substring(entity, at + 1, F.length(entity))
    top = F.regexp_extract(domain, r"\.[A-Za-z]+$", 0)
    head = F.when(iban, F.substring(entity, 1, 2)).when(block, opening).otherwise("")
    body = F.when(mail, F.substring(entity, F.lit(1), at - 1)).when(block, F.substring(entity, F.length(opening) + 1, F.length(entity) - F.length(opening) - F.length(closing))).otherwise(F.substring(entity, F.length(head) + 1, F.length(entity)))
    name = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    tail = F.when(mail, F.concat(F.lit("@"), _dealt(name, _spelled(key, name, F.lower(domain), F.lit(0), F.lit(False)), "[A-Za-z0-9]"), top)).when(block, closing).otherwise("")
    hexed = kind.isin("mac", "ipv6") | body.rlike("^[0-9a-fA-F]{16,}$")
    seed = F.when(iban, F.regexp_replace(entity, " ", "")).when(kind == "mac", F.regexp_replace(low, "[:-]", "")).otherwise(low)
    more = F.when(kind.isin("email", "secret"), _more(key, low, attempt)).otherwise("")

    def checked(found: Column) -> Column:
        compact = F.regexp_replace(entity, " ", "")
        check = 98 - _remainder(F.concat(head, F.lit("00"), F.substring(found, F.lit(3), F.length(found))))
        return F.when(iban & (_remainder(compact) == 1), F.concat(F.lpad(check.cast("string"), 2, "0"), F.substring(found, F.lit(3), F.length(found)))).otherwise(found)

    return F.concat(head, _dealt(body, _let(_spelled(key, body, seed, attempt, hexed), checked), "[A-Za-z0-9]"), more, tail)


def _ip(key: str, entity: Column, attempt: Column) -> Column:
    part = lambda i: F.element_at(F.split(entity, r"\."), i).cast("long")
    pair = _feistel(key, part(1) * 256 + part(2), part(3) * 256 + part(4), F.lit(65536), F.lit(65536), attempt)
    return _let(pair, lambda p: F.concat_ws(".", *(F.floor(p[h] / 256) if high else p[h] % 256 for h in "lr" for high in (True, False))))


def _script(part: Column) -> Column:
    return F.when(part.rlike(r"\p{IsCyrillic}"), "cyrillic").when(part.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _pick(values: dict[str, tuple[str, ...]], by: Column) -> Column:
    """The array of values under a name."""
    found = None
    for name, each in values.items():
        array = F.split(F.lit(" ".join(each)), " ")
        found = F.when(by == name, array) if found is None else found.when(by == name, array)
    return found


def _part(key: str, value: Column, role: Column, attempt: Column, levels: dict[tuple[str, str], int]) -> Column:
    """The surrogate of one part of a name, a ``SURNAME`` or a given name of a gender; with each attempt one syllable more than its level."""

    def built(script: Column) -> Column:
        begin = F.lit(0)
        for (r, s), level in levels.items():
            begin = F.when((role == r) & (script == s), level).otherwise(begin)
        level = begin + attempt

        def named(hexed: Column) -> Column:
            of = lambda array, at: _let(array, lambda a: F.element_at(a, (_number(hexed, at, 2) % F.size(a) + 1).cast("int")))
            sounds = _pick(SYLLABLES, script)
            count = F.when(role == SURNAME, level + LEAST_SYLLABLES).otherwise(level + 1)
            spelled = F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), count - 1), lambda i: of(sounds, i * 2 + 1)), ""))
            given = of(_pick({f"{s} {g}": v for (s, g), v in GIVEN.items()}, F.concat_ws(" ", script, role)), 61)
            return F.when(role == SURNAME, F.concat(spelled, of(_pick(ENDINGS, script), 63))).when(level > 0, F.concat_ws("-", given, spelled)).otherwise(given)

        return _let(_keyed(key, value, attempt), named)

    return _let(_script(value), built)


def _title(name: Column) -> Column:
    return F.regexp_extract(name, rf"^{TITLE}", 0)


def _parts(name: Column) -> Column:
    """role, value of each part of a name."""
    bare = F.regexp_replace(_title(name), r"[. ]", "")
    gender = F.when(bare.isin(*MALE), "m").when(bare.isin(*FEMALE), "f").otherwise("o")
    parts = F.split(F.substring(name, F.length(_title(name)) + 1, F.length(name)), " ")
    return F.transform(parts, lambda p, i: F.struct(F.when(i == F.size(parts) - 1, SURNAME).otherwise(gender).alias("role"), p.alias("value")))


def kind_of(entity: Column) -> Column:
    whole = lambda p: entity.rlike(f"^(?:{p})$")
    return (
        F.when(F.startswith(entity, F.lit("-----")), "block").when(F.instr(entity, "@") > 0, "email").when(whole(IP), "ip").when(whole(MAC), "mac").when(F.instr(entity, ":") > 0, "ipv6").when(whole(CARD), "account")
        .when(whole(IBAN), "iban").when(whole(SSN), "ssn").when(whole(PHONE), "phone").when(whole(NAME), "name").otherwise("secret")
    )


def identity(kind: Column, entity: Column) -> Column:
    """What an entity is told apart by: equal for spellings of one number or address."""
    digits = F.concat(F.when(F.startswith(entity, F.lit("+")), "+").otherwise(""), F.regexp_replace(entity, "[^0-9]", ""))
    own = F.when(kind.isin("account", "ssn", "phone"), digits).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(kind == "mac", F.regexp_replace(F.lower(entity), "[:-]", "")).otherwise(F.lower(entity))
    return F.concat_ws(" ", kind, own)


def surrogate(key: str, entity: Column, attempts: Column | None = None, levels: dict[tuple[str, str], int] | None = None) -> Column:
    """The surrogate of an entity. attempts: of each part of a name, else one; levels: syllables more by role and script."""
    nth = (lambda i: F.lit(0)) if attempts is None else (lambda i: F.coalesce(F.get(attempts, i), F.lit(0)))
    first = nth(F.lit(0))

    def derived(kind: Column) -> Column:
        kept = F.when((kind == "account") | F.startswith(entity, F.lit("+")), 1).otherwise(0)
        number = F.concat(_numeric(key, entity, first, kept), F.when(kind == "phone", _more(key, F.regexp_replace(entity, "[^0-9]", ""), first, False)).otherwise(""))
        name = F.concat(_title(entity), F.array_join(F.transform(_parts(entity), lambda p, i: _part(key, p["value"], p["role"], nth(i), levels or {})), " "))
        return F.when(kind == "name", name).when(kind.isin("account", "ssn", "phone"), number).when(kind == "ip", _ip(key, entity, first)).otherwise(_letters(key, entity, kind, first))

    return _let(kind_of(entity), derived)


def _pieces(text: Column) -> Column:
    """Text, entity, text, entity, ..., text; null for a null text and one that has no mark of an entity."""
    escaped = F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE_AS)), F.lit(EDGE), F.lit(EDGE_AS))
    return F.when(text.rlike(MARKS) | text.rlike(TITLED), F.split(F.regexp_replace(escaped, PATTERN, f"{EDGE}$0{EDGE}"), EDGE, -1))


def _entities(pieces: Column) -> Column:
    return F.filter(F.coalesce(pieces, F.array().cast("array<string>")), lambda x, i: i % 2 == 1)


def found_in(text: Column) -> Column:
    """All entities of a text, in order."""
    return _entities(_pieces(text))


def _units(entities: DataFrame) -> DataFrame:
    """entity, at, role, value, own: what gets a surrogate of its own, each part of a name or a whole entity of another type (role '')."""
    kinds = entities.select("entity", kind_of(F.col("entity")).alias("kind"))
    whole = F.array(F.struct(F.lit("").alias("role"), F.col("entity").alias("value")))
    units = kinds.select("entity", "kind", F.posexplode(F.when(F.col("kind") == "name", _parts(F.col("entity"))).otherwise(whole)).alias("at", "unit"))
    return units.select("entity", "at", "unit.role", "unit.value", "kind", F.when(F.col("kind") == "name", F.col("unit.value")).otherwise(identity(F.col("kind"), F.col("entity"))).alias("own"))


def _levels(units: DataFrame) -> dict[tuple[str, str], int]:
    """Syllables more that parts of a role and script need, so that there are ``ROOM`` surrogates for each."""
    found = {}
    for r in units.filter("role <> ''").groupBy("role", _script(F.col("value")).alias("script")).agg(F.count("*").alias("n")).collect():  # a row for each role and script
        level, sounds = 0, len(SYLLABLES[r["script"]])
        room = lambda k: sounds ** (LEAST_SYLLABLES + k) * len(ENDINGS[r["script"]]) if r["role"] == SURNAME else len(GIVEN[r["script"], r["role"]]) * (sounds ** (k + 1) if k else 1)  # noqa: B023, E731
        while room(level) < ROOM * r["n"]:
            level += 1
        found[r["role"], r["script"]] = level
    return found


def exceptions(lists: DataFrame, key: str) -> tuple[DataFrame | None, dict[tuple[str, str], int]]:
    """(entity, other of entities whose plain surrogate is taken, or None; levels of names) for the lists of entities ``found``. Ends when no clash is left."""
    spark = lists.sparkSession
    lanes = lambda df: max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // TASK_UNITS))
    entities = materialize(lists.select(F.explode("found").alias("entity")).distinct(), "pii-entities")
    named = materialize(_units(entities.repartition(lanes(entities), "entity")), "pii-named")
    units = materialize(named.groupBy("role", "own").agg(F.min("value").alias("value"), F.first("kind").alias("kind")), "pii-units")
    levels = _levels(units)
    role, value, attempt = F.col("role"), F.col("value"), F.col("attempt")
    other = F.when(role == "", surrogate(key, value, F.array(attempt))).otherwise(_part(key, value, role, attempt, levels))
    low = F.when(role == "", identity(F.col("kind"), F.col("other"))).otherwise(F.col("other"))
    derived = lambda df, n: materialize(df.select("role", "own", "value", "kind", F.lit(n).alias("attempt")).repartition(lanes(df), "role", "own").withColumn("other", other).withColumn("low", low).drop("other"), "pii-pending")
    pending, taken, moved = derived(units, 0), units.select("role", F.col("own").alias("low")), []
    for n in range(ROUNDS + 1):
        first = pending.groupBy("role", "low").agg(F.min("own").alias("first"))
        met = taken.join(small_or_shuffled(materialize(first.select("role", "low"), "pii-asked")), ["role", "low"], "left_semi").distinct().withColumn("met", F.lit(True))
        judged = materialize(pending.join(first, ["role", "low"]).join(met, ["role", "low"], "left").withColumn("bad", F.col("met").isNotNull() | (F.col("own") > F.col("first"))), "pii-judged")
        good, bad = judged.filter("NOT bad"), judged.filter("bad")
        taken = taken.unionByName(good.select("role", "low"))
        if n:
            moved.append(good.select("role", "own", "attempt"))
        if bad.isEmpty():
            break
        pending = derived(bad, n + 1)
    else:
        raise RuntimeError(f"surrogates still clash after {ROUNDS} attempts")
    if not moved:
        return None, levels
    again = moved[0]
    for more in moved[1:]:
        again = again.unionByName(more)
    again = materialize(again, "pii-moved")
    hit = named.join(small_or_shuffled(again), ["role", "own"], "left")
    each = hit.groupBy("entity").agg(F.max("attempt").alias("most"), F.array_sort(F.collect_list(F.struct("at", F.coalesce("attempt", F.lit(0)).alias("attempt")))).alias("each")).filter("most > 0")  # a name has few parts
    return materialize(each.select("entity", surrogate(key, F.col("entity"), F.col("each.attempt"), levels).alias("other")), "pii-others"), levels


def pseudonymise(docs: DataFrame, key: str, text: str = "text", counted: str | None = None) -> DataFrame:
    """``docs`` with every entity in ``text`` replaced; ``counted`` names a column for their number (an earlier one of that name gives way)."""
    quoted = lambda c: F.col("`" + c.replace("`", "``") + "`")
    lists = materialize(docs.select(found_in(quoted(text)).alias("found")).filter(F.size("found") > 0).distinct(), "pii-lists")
    others, levels = exceptions(lists, key)
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("row"), _pieces(quoted(text)).alias("pieces"))
    plain = lambda e: surrogate(key, e, levels=levels)
    mapped = plain
    if others is not None:
        hit = lists.select("found", F.explode("found").alias("entity")).join(small_or_shuffled(others), "entity").groupBy("found").agg(F.map_from_entries(F.collect_set(F.struct("entity", "other"))).alias("others"))
        # rows without entities are many: they are dealt apart, under lists that no text has
        none = F.array(F.concat(F.lit(EDGE), (F.xxhash64(F.col("row").getField(text)) % 4096).cast("string")))
        keyed = rows.withColumn("found", _entities(F.col("pieces"))).withColumn("found", F.when(F.size("found") > 0, F.col("found")).otherwise(none))
        rows = keyed.join(small_or_shuffled(materialize(hit, "pii-exceptions")), "found", "left")
        mapped = lambda e: F.coalesce(F.try_element_at(F.col("others"), e), plain(e))
    joined = F.array_join(F.transform("pieces", lambda x, i: F.when(i % 2 == 1, mapped(x)).otherwise(x)), "")
    new = F.replace(F.replace(joined, F.lit(EDGE_AS), F.lit(EDGE)), F.lit(ESCAPE_AS), F.lit(ESCAPE))
    number = [F.greatest(F.lit(0), F.coalesce(F.floor(F.size("pieces") / 2).cast("int"), F.lit(0))).alias(counted)] if counted else []
    own = lambda c: F.col("row").getField(c)
    return rows.select(*(F.when(F.size("pieces") > 1, new).otherwise(own(c)).alias(c) if c == text else own(c).alias(c) for c in docs.columns if c != counted), *number)
