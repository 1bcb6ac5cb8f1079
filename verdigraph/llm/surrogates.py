"""PII surrogates: detected entities get keyed, type-consistent replacements, equal for equal entities and distinct
for distinct ones.

Detection is one regular expression; a mention is cut into parts (a name into honorific, given name and surnames,
anything else is one part), and a part's canonical form is what it refers to: digits of a phone number, lower case
of an address, the stem of a surname that has a form for women and one for men. Canonical forms are replaced by keyed
hashes that keep the class of every character; given names keep gender and script, surnames the script, card numbers
their Luhn remainder, valid IBANs are valid again. The corpus-wide table of canonical forms is checked: a surrogate
that two forms share, or that is itself a detected form, is drawn again with the next attempt number until none is
left. The mention's own format (separators, case, the gender of a surname) is poured back over the surrogate.

The key is a setting of the session; without one, each application draws its own, so surrogates can't be computed
from the source code alone.

Only DataFrame functions are used. The texts are searched once and staged with their mentions. Mentions meet their
surrogates by a join on the part, and texts meet their mentions by a join on the text's digest, so copies of a text
are looked up once.
"""

from __future__ import annotations

import re
import secrets
from functools import cache, reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from verdigraph.llm import common

#: The session's setting that holds the key.
KEY_SETTING = "spark.verdigraph.surrogates.key"
#: From this attempt on, a surrogate is longer than what it replaces: the short form's space is too small.
LONGER_FROM = 4
MOST_ATTEMPTS = 60

# Honorifics by the gender they tell, and given names by gender and script.
HONORIFICS = {
    "m": ["Mr", "Sir", "Herr", "Monsieur", "Señor", "Sr", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Señora", "Sra", "Señorita", "госпожа"],
    "u": ["Dr", "Prof", "Mx", "Doktor", "Docteur"],
}
GIVEN = {
    ("m", "latin"): "James John Robert Michael William David Richard Thomas Charles Daniel Matthew Anthony Peter Hans Jürgen Klaus Wolfgang Stefan Pierre Jean Jacques François Antoine Carlos José Miguel Javier Alejandro Pablo Diego Ahmed Mohammed Ali Omar Hassan Raj Amit Giovanni Marco Lars Jan Piotr Andrew Steven Paul Mark George Kevin Brian Luis Juan Pedro João".split(),
    ("f", "latin"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Laura Anna Petra Ursula Sabine Monika Heike Marie Sophie Camille Élodie Juliette Carmen María Lucía Isabel Elena Pilar Teresa Fatima Aisha Leila Priya Giulia Francesca Ingrid Agnieszka Nancy Lisa Margaret Sandra Ashley Julia Emma Olivia Ana Rosa Beatriz".split(),
    ("m", "cyrillic"): "Иван Дмитрий Сергей Алексей Николай Михаил Андрей Павел Владимир Александр".split(),
    ("f", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
    ("m", "greek"): "Γιώργος Γιάννης Κώστας Νίκος Δημήτρης Παναγιώτης Βασίλης".split(),
    ("f", "greek"): "Μαρία Ελένη Αικατερίνη Βασιλική Σοφία Άννα Γεωργία".split(),
}
# Parts of surnames that are made up, in three places, and parts of made-up given names: a front and an ending by gender.
SURNAME_PARTS = {
    "latin": ("Al Bar Cor Dal Er Fen Gar Hol Is Jor Kel Lam Mor Nor Os Pel Quin Ros Sal Tor Ul Var Wen Yar".split(), "ba de fi go ha ki lo mu ni pe ra so tu vi we zo".split(), "den field ger land ler man mont ner ram ren sen son ter ton vall well".split()),
    "cyrillic": ("Ал Бар Вол Гор Дан Ер Жар Зор Кал Лам Мор Нов Ор Пол Рам Сав Тар Фед".split(), "ба ве го да зи ко ле мо на пе ра се ти ву".split(), "ков лов мин нев нин ров рин сов тов шин".split()),
    "greek": ("Αλ Βαρ Γορ Δελ Ζαφ Θεμ Καλ Λαμ Μαρ Νικ Παν Σαρ Ταλ Φωτ Χαρ".split(), "ανα ερι ιδα ολα υμε ακι ενο ιτσι ορα ουλ".split(), "δοπουλ κοπουλ λοπουλ νοπουλ ροπουλ τοπουλ".split()),
}
GIVEN_PARTS = {
    "latin": ("Adel Ald Bern Ced Corn Der Ed Elm Fab Ger Hec Ign Jul Lor Luc Mar Nor Oct Ral Rod Sim Tib Val Vic Wil Aur Bast Dor Flor Leon".split(), {"m": "ian ard us in o eric ald el and ert is ulf".split(), "f": "ia ina elle ette a ane isa eva ilda ora inda ela".split()}),
    "cyrillic": ("Ар Бор Вал Ген Дан Евг Зах Кир Лев Мар Род Сев Тим Фед Эд".split(), {"m": "ислав имир ентий ий ан ел иан ор".split(), "f": "ина ия ена лина ида ана елина ислава".split()}),
    "greek": ("Αλεξ Αριστ Δαμ Ευγ Θεοδ Κλε Λεων Μεν Νικηφ Πλατ Σωκρ Φιλ".split(), {"m": "ανδρος ίδης ιανός ωνας ίας έας".split(), "f": "άνδρα ίνα ιανή ώνη ία έα".split()}),
}
# Endings of surnames that tell the gender: of men, of women, and how the men's form is made from the stem.
WOMENS_CYRILLIC, MENS_CYRILLIC = "(ов|ев|ёв|ин|ын)а$", "(ов|ев|ёв|ин|ын)$"
ENDING_GREEK, WOMENS_GREEK = "(ος|ου|ης|η|ας|α)$", "(ου|η|α)$"
SECRET_WORDS = ["token", "secret", "api_key", "api-key", "apikey", "password", "passwd", "access_key"]

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Small words inside names and those that may follow them, and the country codes of one and of two digits.
PARTICLES, FURTHER = "von van vom zu zum zur de del della di da dos du bin ibn al".split(), "der den de la los le".split()
_ONE_DIGIT, _TWO_DIGITS = r"^\+[17]", r"^\+(?:2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
#: A word of a name: an initial with an apostrophe, capitals inside (McDonald), and parts with hyphens.
_WORD = r"(?:\p{Lu}['’])?\p{Lu}\p{Ll}++(?:\p{Lu}\p{Ll}++)*+"
_TITLE = rf"(?:(?:{'|'.join(PARTICLES)}) (?:(?:{'|'.join(FURTHER)}) )?+)?+{_WORD}(?:-{_WORD})*+"
_SHOUTED = r"(?:\p{Lu}['’])?\p{Lu}{2,}+(?:-\p{Lu}{2,}+)*+"
#: Words after which a name follows whatever it is; the colon or equals sign is needed.
_CUES = "(?i:name|nombre|nom|имя)"


def _any(words: list[str]) -> str:
    """Alternatives by first letter, so that one look rules out most."""
    by_letter: dict[str, list[str]] = {}
    for w in dict.fromkeys(words):
        by_letter.setdefault(w[0], []).append(re.escape(w[1:]))
    return "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by_letter.items())


_given = _any([n for names in GIVEN.values() for n in names])
_honor = _any([h for titles in HONORIFICS.values() for h in titles])
_GIVEN = _any([n.upper() for names in GIVEN.values() for n in names])
_HONOR = _any([h.upper() for titles in HONORIFICS.values() for h in titles])
#: Types in order of preference. The possessive parts keep the search linear on long runs without spaces.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "secret": r"(?<![A-Za-z0-9_/+-])(?=[A-Za-z0-9_/+-]{12})(?=[A-Za-z_/+-]*\d)(?<=(?i:" + "|".join(SECRET_WORDS) + r")\"?\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+-]+|(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|(?:sk|ghp|xoxb)[-_][A-Za-z0-9_-]{16,})(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "mac": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}(?![0-9A-Fa-f:])",
    "ipv6": r"(?<![0-9A-Fa-f:.])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[0-9A-Fa-f:]*\d)[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5}::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![0-9A-Fa-f:])",
    "ip": r"(?<![\d.])" + _OCTET + r"(?:\." + _OCTET + r"){3}(?!\d|\.\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(+-])\(\d{3}\) ?\d{3}[ .-]?\d{4}(?!\d)|(?<![\w+.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\d-])|(?<![\w+.-])0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d.])\d(?:[ -]?\d){12,18}(?!\d|\.\d)",
    "name": rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:(?:{_honor})\.? {_TITLE}(?: {_TITLE}){{0,2}}|(?:{_given})(?: {_TITLE}){{1,2}}|(?:{_HONOR})\.? {_SHOUTED}(?: {_SHOUTED}){{0,2}}|(?:{_GIVEN})(?: {_SHOUTED}){{1,2}}|(?<={_CUES}\s{{0,2}}[=:]\s{{0,2}}){_TITLE}(?: {_TITLE}){{1,2}})",
}
_DIGITS = ("phone", "ssn", "card")
#: One look at the characters around a place rules out most places before any pattern is tried there.
ANY = "(?<![A-Za-z0-9])(?=[\\p{L}0-9._%+/-])(?:" + "|".join(p for k, p in PATTERNS.items() if k not in (*_DIGITS, "ip")) + ")|(?=[0-9+(])(?:" + "|".join(PATTERNS[k] for k in ("ip", *_DIGITS)) + ")"
#: What every entity without a digit or an at sign holds: the start of a name, of a digit-free secret, or of a MAC or IPv6 address.
_NAME_START = rf"(?<!\p{{L}})(?=[\p{{Lu}}г])(?:(?:{_honor}|{_HONOR})\.?|(?:{_given}|{_GIVEN})) (?:\p{{Lu}}['’\p{{L}}]|(?:{'|'.join(PARTICLES)}) )|{_CUES}\s{{0,2}}[=:]"
_LETTERS = r"AKIA|(?:sk|ghp|xoxb)[-_]|[a-f]{32}|[A-F]{32}|[A-Fa-f]{2}[:-][A-Fa-f]{2}[:-]|[A-Fa-f]:[A-Fa-f]{1,4}:"


def mentions(text: Column) -> Column:
    """The entities of a text in order, as they stand there; null for a text that has nothing an entity needs."""
    possible = text.rlike("[0-9@]") | text.rlike(_NAME_START) | text.rlike(_LETTERS)
    return F.when(possible, F.regexp_extract_all(text, F.lit(ANY), F.lit(0)))


SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}", "other": r"[^\p{IsLatin}\p{IsCommon}\p{IsInherited}]"}


def _by_script(word: Column, made) -> Column:
    """made(script) of the word's script: latin, or the first of SCRIPTS whose letters it has."""
    return reduce(lambda rest, script: F.when(word.rlike(SCRIPTS[script]), made(script)).otherwise(rest), reversed(SCRIPTS), made("latin"))


def _shouted(word: Column) -> Column:
    return (word == F.upper(word)) & (word != F.lower(word)) & (F.length(word) > 1)


def _titled(word: Column) -> Column:
    """A word of capitals with capitals at the front alone."""
    return F.when(_shouted(word), F.array_join(F.transform(F.split(word, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.lower(F.substring(x, F.lit(2), F.length(x))))), "-")).otherwise(word)


def _kind(mention: Column) -> Column:
    """The type of a mention: what it starts with and consists of tells it without its surroundings."""
    digits = F.length(F.regexp_replace(mention, r"\D", ""))
    cases = [
        ("email", mention.contains("@")),
        ("ip", mention.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")),
        ("mac", mention.rlike(r"^([0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}$")),
        ("ipv6", mention.rlike(r"^([0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}$|^[0-9A-Fa-f:]*::[0-9A-Fa-f:]*$")),
        ("ssn", mention.rlike(r"^\d{3}-\d{2}-\d{4}$")),
        ("phone", mention.rlike(r"^\+|^\(|^\d{3}([-.])\d{3}[-.]\d{4}$|^0\d{1,4}[ -]\d{3,4}[ -]\d{3,4}$")),
        ("card", mention.rlike(r"^[\d -]+$") & digits.between(13, 19)),
        ("name", mention.rlike(r"^[\p{L}.'’-]+ ") & mention.rlike(r"\p{L}$") & ~mention.rlike(r"\d")),
        ("iban", mention.rlike(r"^[A-Z]{2}\d{2}[A-Z0-9 ]+$") & ~mention.rlike("^AKIA")),
    ]
    return reduce(lambda rest, case: F.when(case[1], case[0]).otherwise(rest), reversed(cases), F.lit("secret"))


def _parts(mention: Column) -> Column:
    """array<struct<type, raw>> of a mention; joined by spaces, the raws are the mention."""
    title = rf"^(?:{_honor}|{_HONOR})\.?$"
    tokens = F.split(mention, " ")
    names = {g: [n for (own, _), group in GIVEN.items() if own == g for n in group] for g in ("m", "f")}

    def name_part(token: Column, i: Column) -> Column:
        plain = _titled(token)
        given = F.when(plain.isin(names["m"]), "given-m").when(plain.isin(names["f"]), "given-f").otherwise("surname")
        after = F.when(i > 0, F.get(tokens, i - 1))
        first = F.when(token.rlike(title), "title").otherwise(given)
        kind = F.when(token.isin(PARTICLES + FURTHER), "title").when(i == 0, first).when(after.rlike(title), given).otherwise("surname")
        return F.struct(kind.alias("type"), token.alias("raw"))

    return F.when(_kind(mention) == "name", F.transform(tokens, name_part)).otherwise(F.array(F.struct(_kind(mention).alias("type"), mention.alias("raw"))))


def _stem(surname: Column) -> Column:
    """A surname without what tells the gender of who bears it."""
    plain = _titled(surname)
    return F.when(plain.rlike(SCRIPTS["cyrillic"]), F.regexp_replace(plain, WOMENS_CYRILLIC, "$1")).when(plain.rlike(SCRIPTS["greek"]), F.regexp_replace(plain, ENDING_GREEK, "")).otherwise(plain)


def _canonical(kind: Column, raw: Column) -> Column:
    return F.when(kind.isin(*_DIGITS), F.concat(F.when(raw.startswith("+"), "+").otherwise(""), F.regexp_replace(raw, r"\D", ""))).when(kind == "iban", F.replace(raw, F.lit(" "), F.lit(""))).when(kind == "surname", _stem(raw)).when(kind.isin("given-m", "given-f"), _titled(raw)).when(kind == "title", raw).when(kind == "secret", F.when(raw.rlike("^[0-9A-Fa-f]+$"), F.lower(raw)).otherwise(raw)).otherwise(F.lower(raw))


def _stream(*of: Column) -> Column:
    """256 keyed hexadecimal digits."""
    seed = F.concat_ws("|", *of)
    return F.concat(F.sha2(seed, 512), F.sha2(F.concat(seed, F.lit("|2")), 512))


def _pick(stream: Column, place: Column, n: int | Column) -> Column:
    """A number below n from the four digits of the stream at a place, which wraps around."""
    return (F.conv(F.substring(stream, (place % 63) * 4 + 1, F.lit(4)), 16, 10).cast("long") % n).cast("int")


def _classes(text: Column, stream: Column, keep: Column) -> Column:
    """text with its characters from the `keep`-th on (from 0) replaced within their class: digits, hexadecimal or other letters."""
    hexadecimal = text.rlike("^[0-9A-Fa-f:.-]+$")

    def letter(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), _pick(stream, i, len(alphabet)) + 1, F.lit(1))

    def one(c: Column, i: Column) -> Column:
        new = F.when(c.rlike("[0-9]"), letter("0123456789", i)).when(c.rlike("[a-z]"), F.when(hexadecimal, letter("abcdef", i)).otherwise(letter("abcdefghijklmnopqrstuvwxyz", i)))
        new = new.when(c.rlike("[A-Z]"), F.when(hexadecimal, letter("ABCDEF", i)).otherwise(letter("ABCDEFGHIJKLMNOPQRSTUVWXYZ", i))).otherwise(c)
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _luhn(digits: Column) -> Column:
    """The Luhn sum modulo 10."""
    def one(c: Column, i: Column) -> Column:
        d = c.cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x) % 10


def _mod97(text: Column) -> Column:
    """An account number modulo 97, its first four characters last and letters as the numbers from 10 on."""
    def add(a: Column, c: Column) -> Column:
        n = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
        return F.when(n < 10, a * 10 + n).otherwise(a * 100 + n) % 97

    return F.aggregate(F.split(F.concat(F.substring(text, F.lit(5), F.length(text)), F.substring(text, 1, 4)), ""), F.lit(0), add)


def _drawn(table: DataFrame, key: str) -> DataFrame:
    """table (type, canon, attempt) with `surrogate`; the keyed digits are columns, so lambdas don't hash again."""
    domain = F.element_at(F.split("canon", "@"), -1)
    table = table.withColumn("stream", _stream(F.lit(key), F.col("type"), F.col("attempt").cast("string"), F.col("canon")))
    table = table.withColumn("of_domain", F.when(F.col("type") == "email", _stream(F.lit(key), F.lit("domain"), domain)))
    return table.withColumn("surrogate", _surrogate(*map(F.col, ("type", "canon", "attempt", "stream", "of_domain")))).drop("stream", "of_domain")


def _surrogate(kind: Column, canon: Column, attempt: Column, stream: Column, of_domain: Column) -> Column:
    """The attempt-th surrogate of a canonical form."""
    tail = F.when(attempt >= LONGER_FROM, F.translate(F.substring(stream, 200, F.lit(8)), "0123456789abcdef", "ghijklmnopqrstuv")).otherwise("")
    more_digits = F.when(attempt >= LONGER_FROM, F.lpad(_pick(stream, F.lit(50), 10000).cast("string"), 4, "0")).otherwise("")

    domain = F.element_at(F.split(canon, "@"), -1)
    ending = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(ending) - 1)
    email = F.concat(_classes(F.substring_index(canon, "@", 1), stream, F.lit(0)), tail, F.lit("@"), _classes(host, of_domain, F.lit(0)), F.lit("."), ending)

    octet = lambda i, n, low: (_pick(stream, F.lit(i), n) + low).cast("string")
    ip = F.concat_ws(".", octet(0, 222, 1), octet(1, 254, 1), octet(2, 254, 1), octet(3, 254, 1))

    digits = F.concat(_classes(canon, stream, F.when(canon.rlike(_ONE_DIGIT), 2).when(canon.rlike(_TWO_DIGITS), 3).when(canon.startswith("+"), 4).otherwise(0)), more_digits)
    body = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), F.lit("0"))
    card = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((_luhn(canon) - _luhn(body) + 10) % 10).cast("string"))

    def one_of(parts: list[str], i: int) -> Column:
        return F.element_at(F.array(*map(F.lit, parts)), _pick(stream, F.lit(i), len(parts)) + 1)

    def given(gender: str) -> Column:
        """Of the list at first; made up once the list's names are taken, and double after that."""
        def of(script: str) -> Column:
            if script == "other":
                return shuffled
            fronts, endings = GIVEN_PARTS[script]
            made = lambda at: F.concat(one_of(fronts, at), one_of(endings[gender], at + 1))
            return F.when(attempt < 1, one_of(GIVEN[gender, script], 0)).otherwise(F.concat(made(1), F.when(attempt >= 6, F.concat(F.lit("-"), made(3))).otherwise("")))

        return _by_script(canon, of)

    def surname(script: str) -> Column:
        if script == "other":
            return shuffled
        family = lambda at: F.concat(*(one_of(part, at + i) for i, part in enumerate(SURNAME_PARTS[script])))
        double, more = canon.contains("-"), attempt >= 2  # of a double name both parts are made up
        return F.concat(F.when(double & more, F.concat(family(6), F.lit("-"))).otherwise(""), F.when(double | more, F.concat(family(3), F.lit("-"))).otherwise(""), family(0))

    # a script without parts of its own: the word's letters in a keyed order, repeated if that is taken
    letters = F.transform(F.split(F.lower(canon), ""), lambda c, i: F.struct(F.md5(F.concat(stream, i.cast("string"))).alias("k"), c.alias("c")))
    order = F.array_join(F.transform(F.array_sort(letters), lambda x: x["c"]), "")
    shuffled = F.initcap(F.concat(order, F.repeat(F.substring(order, 1, 2), F.greatest(attempt - 1, F.lit(0)))))
    country, account = F.substring(canon, 1, 2), F.concat(F.substring(_classes(canon, stream, F.lit(4)), F.lit(5), F.length(canon)), F.upper(tail))
    check = F.lpad((98 - _mod97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    iban = F.concat(country, F.when(_mod97(canon) == 1, check).otherwise(F.substring(_classes(canon, stream, F.lit(2)), 3, 2)), account)
    return (
        F.when(kind == "title", canon)
        .when(kind == "email", email)
        .when(kind == "ip", ip)
        .when(kind == "card", card)
        .when(kind.isin("phone", "ssn"), digits)
        .when(kind == "given-m", given("m"))
        .when(kind == "given-f", given("f"))
        .when(kind == "surname", _by_script(canon, surname))
        .when(kind == "iban", iban)
        .when(kind.isin("mac", "ipv6"), _classes(canon, stream, F.lit(0)))
        .otherwise(F.concat(_classes(canon, stream, F.lit(0)), tail))
    )


def _rendered(kind: Column, raw: Column, surrogate: Column) -> Column:
    """The surrogate in the format of the mention: its separators, or its case."""
    plain = F.replace(surrogate, F.lit("+"), F.lit(""))

    def pour(a: Column, c: Column) -> Column:
        takes = c.rlike("[0-9A-Za-z]")
        return F.struct(F.concat(a["out"], F.when(takes, F.substring(plain, a["at"], F.lit(1))).otherwise(c)).alias("out"), F.when(takes, a["at"] + 1).otherwise(a["at"]).alias("at"))

    poured = F.aggregate(F.split(raw, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), pour, lambda a: F.concat(a["out"], F.substring(plain, a["at"], F.lit(1000))))
    cased = F.concat(F.array_join(F.transform(F.split(raw, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(surrogate, i + 1, F.lit(1)))).otherwise(F.substring(surrogate, i + 1, F.lit(1)))), ""), F.substring(surrogate, F.length(raw) + 1, F.length(surrogate)))
    women_greek = F.when(_titled(raw).rlike(WOMENS_GREEK), "ου").otherwise("ος")
    ending = F.when(raw.rlike(SCRIPTS["greek"]), women_greek).when(F.lower(raw).rlike(WOMENS_CYRILLIC), "а").otherwise("")
    named = F.concat(surrogate, F.when(kind == "surname", ending).otherwise(""))
    named = F.when(_shouted(raw) & (kind != "title"), F.upper(named)).otherwise(named)
    upper = _shouted(raw)
    plain_case = F.when(upper, F.upper(surrogate)).when(F.length(raw) == F.length(surrogate), cased).otherwise(surrogate)
    return F.when(kind.isin(*_DIGITS, "iban"), poured).when(kind.isin("title", "surname", "given-m", "given-f"), named).when(kind.isin("email", "mac", "ipv6") | ((kind == "secret") & raw.rlike("^[0-9A-Fa-f]+$")), plain_case).otherwise(surrogate)


@cache
def _drawn_key(application: str) -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key of KEY_SETTING; without one, a random key that lasts as long as the application."""
    return spark.conf.get(KEY_SETTING, None) or _drawn_key(spark.sparkContext.applicationId)


def assigned(entities: DataFrame, key: str | None = None) -> DataFrame:
    """(type, canon, surrogate) of distinct (type, canon) rows: one surrogate each, no two alike, none a known form.

    Each round draws again for the rows that lose: of those with one surrogate, the row of the lowest attempt and
    form keeps it. Rows that were settled have lower attempts than those that are drawn, so they stay.
    """
    key = key or session_key(entities.sparkSession)
    table = common.staged(entities.withColumn("attempt", F.lit(0)), "entities")
    for _ in range(MOST_ATTEMPTS):
        drawn = _drawn(table, key)
        known = table.select("type", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
        same = Window.partitionBy("type", "surrogate").orderBy("attempt", "canon")
        drawn = drawn.join(known, ["type", "surrogate"], "left").withColumn("place", F.row_number().over(same))
        lost = (F.col("place") > 1) | F.col("real").isNotNull()
        drawn = common.staged(drawn.select("type", "canon", "attempt", "surrogate", (lost & (F.col("type") != "title")).alias("lost")), "surrogates")
        if drawn.where("lost").isEmpty():
            return drawn.select("type", "canon", "surrogate")
        table = drawn.select("type", "canon", (F.col("attempt") + F.col("lost").cast("int")).alias("attempt"))
    raise RuntimeError("surrogates did not become distinct")


def searched(docs: DataFrame) -> DataFrame:
    """(__row, __text, __found) of every row of docs, staged: the row, its text and its mentions (null for none)."""
    found = mentions(F.col("text"))
    return common.staged(docs.select(F.struct(*docs.columns).alias("__row"), F.col("text").alias("__text"), F.when(F.size(found) > 0, found).alias("__found")), "searched-texts")


def replaced(docs: DataFrame, key: str | None = None) -> DataFrame:
    """docs with the surrogates in `text`; rows, columns and null or empty texts stay as they are.

    Copies of a text get one replacement; repeated rows stay repeated; columns of any other name pass through.
    """
    own = searched(docs)
    return _replaced(own, key).select(*(F.col("__new").alias(c) if c.lower() == "text" else F.col(f"__row.`{c}`") for c in docs.columns))


def _replaced(own: DataFrame, key: str | None) -> DataFrame:
    """`searched` rows with __new, the text with surrogates."""
    found = own.where("__found is not null").select(F.md5("__text").alias("digest"), F.array_distinct("__found").alias("found"))
    found = found.dropDuplicates(["digest"]).select("digest", F.explode("found").alias("mention"))
    parts = found.select("digest", F.explode(_parts(F.col("mention"))).alias("part")).select("digest", "part.type", "part.raw").distinct()
    parts = common.staged(parts.withColumn("canon", _canonical(F.col("type"), F.col("raw"))), "mentions")
    known = assigned(parts.select("type", "canon").distinct(), key)
    new = parts.join(known, ["type", "canon"]).select("digest", F.concat_ws("|", "type", "raw").alias("part"), _rendered(F.col("type"), F.col("raw"), F.col("surrogate")).alias("new"))
    maps = new.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("part", "new"))).alias("new"))
    touched = own.where("__found is not null").withColumn("digest", F.md5("__text")).join(maps, "digest")
    pieces = F.split("__text", ANY, -1)
    mention = lambda m: F.array_join(F.transform(_parts(m), lambda p: F.element_at("new", F.concat_ws("|", p["type"], p["raw"]))), " ")
    text = F.array_join(F.flatten(F.zip_with(pieces, F.transform("__found", mention), lambda a, b: F.array(a, F.coalesce(b, F.lit(""))))), "")
    # a surname that a text names with its bearer is replaced where it stands alone, too
    surnames = F.filter(F.map_entries("new"), lambda e: e["key"].startswith("surname|") & (F.length(e["key"]) > len("surname|") + 2))
    alone = lambda a, e: F.regexp_replace(a, F.concat(F.lit(r"(?<![\p{L}\p{N}@._'’-])\Q"), F.substring(e["key"], F.lit(len("surname|") + 1), F.length(e["key"])), F.lit(r"\E(?![\p{L}\p{N}@_-]|\.\p{L})")), e["value"])
    text = F.aggregate(surnames, text, alone)
    clean = own.where("__found is null").select("__row", "__found", F.col("__text").alias("__new"))
    return clean.unionByName(touched.select("__row", "__found", text.alias("__new")))


def digest(docs: DataFrame, key: str | None = None) -> DataFrame:
    """(doc_id, text, n_entities): every row's text with surrogates, and how many mentions its text had."""
    own = searched(docs.select("doc_id", "text"))
    out = _replaced(own, key)
    return out.select("__row.doc_id", F.col("__new").alias("text"), F.greatest(F.coalesce(F.size("__found"), F.lit(0)), F.lit(0)).cast("long").alias("n_entities"))
