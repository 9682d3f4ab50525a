"""Surrogates for personal data, in Spark expressions only.

Entities are found by one pattern: e-mail addresses, IPv4 addresses, numbers of 13 to 19
digits with a valid check digit (cards; in one run or in a card's groups), telephone and social security numbers, IBANs, secrets (values
after ``token =`` and the like, access keys, long hexadecimal strings) and names after a title.  Two
plain patterns say which texts can hold one at all; only those are parted, once, into what
lies between entities and the entities.  Each
is replaced in place by a surrogate that depends on a key and the entity alone, so an
entity has the same surrogate everywhere without a table of all entities:

* digits go through a keyed Feistel network over numbers of the same length, a bijection:
  different numbers keep different surrogates.  Separators, country codes and the
  validity of a Luhn check digit stay.  IPv4 addresses: the same over 223 x 2**24.
  A country code is told by the digits, not by what stands behind it.
* e-mail addresses, secrets and IBANs keep the class (case, script, digit) of each character; a domain
  is replaced on its own, so that addresses of one domain still share one, and its last
  label stays; an IBAN keeps its country, and its check digits their validity.
* names keep title, gender, script and number of words; a family name has one surrogate with any title and any given name.

A number or an IBAN has one surrogate in every spelling, written as the mention is.  The last two kinds could collide, so a pass over the distinct entities (never over texts)
counts the entities of each surrogate; those that share one, or take one that is itself an
entity, try again.  A second and a third attempt are longer; from the fourth on an attempt
holds the attempt's number and the entity, enciphered, and so differs from that of every
other entity and from all its own before (see :func:`collisions`).  Few such exceptions travel as literals;
more are joined by document.

Who knows the key can undo the surrogates of digits, so it comes from the caller.
"""

from __future__ import annotations

import hashlib
import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.llm.common import columns, free_name, table
from siftstone.sources.scratch import cut

#: The setting that holds the key of the query and of the pipeline's stage.
KEY_SETTING = "spark.siftstone.pii.key"
#: Exceptions that are sent with the plan; more are joined.
LITERAL_EXCEPTIONS = 2000
ROUNDS = 6
#: Attempts from this one on hold the entity itself, enciphered.
CIPHERED = 3

#: Titles of men, of women, and of either.
MALE = ["Mr", "Herr", "Monsieur", "Señor", "Don", "Господин"]
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "Госпожа"]
EITHER = ["Dr", "Prof"]
TITLES = MALE + FEMALE + EITHER
_TITLE = r"\b(?:" + "|".join(TITLES) + r")\b"
_NAME = _TITLE + r"\.? \p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’-]+){0,2}"
_LOCAL = r"\p{L}\p{N}._%+\-"
_EMAIL = rf"(?<![{_LOCAL}])[{_LOCAL}]{{1,64}}@(?:[\p{{L}}\p{{N}}-]{{1,63}}\.){{1,8}}\p{{L}}{{2,24}}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
#: One run of digits, or a card's groups: four of four digits or more (a row of which ``_pieces`` parts), or 4-6-5 and 4-6-4.
_GROUPS = r"(?:\d{4}(?: \d{4}){3,}|\d{4}(?:-\d{4}){3}|\d{4} \d{6} \d{4,5}|\d{4}-\d{6}-\d{4,5})"
_LONG = rf"(?<![\w+])\d{{13,19}}(?!\w)|(?<![\w+]){_GROUPS}(?!\w)"
#: The end of a number of 7 to 15 digits, country code included.
_NEXT = r"[ .()-]{0,3}\d"
_E164 = r"(?!\w)(?<=\+\d" + _NEXT * 6 + f"(?:{_NEXT}" * 8 + ")?" * 8 + ")"
_PHONE = (
    rf"(?<![\w+])\+\d{{1,3}}[ .-]?\(0\)[ .-]?\d{{1,4}}(?:[ .-]?\d{{2,4}}){{1,4}}{_E164}"
    r"|(?<![\w+])\+\d{1,3}[ .-]?\(\d{1,4}\)[ .-]?\d{3,4}[ .-]?\d{2,4}(?:-\d{2,4})?(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,5}(?!\w)"
    rf"|(?<![\w+])\+\d{{1,3}}(?:[ .-]?\(\d{{1,4}}\)(?:[ .-]?\d{{1,4}}){{2,5}}|[ .-]\d[ .-]\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,3}}){_E164}"
    r"|(?<!\w)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\w)|(?<![\w-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w-])"
)
_SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
_IBAN = r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"
_BEFORE = r"(?i:token|secret|passw(?:or)?d|pwd|api_?key|access_?key)[\"']? {0,2}"
_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|sk-)"
_SECRET = (
    rf"(?<={_BEFORE}[=:] {{0,2}}[\"']?)(?=[^\s\"']{{0,255}}\d)[^\s\"',;=:][^\s\"',;]{{6,254}}[A-Za-z0-9+/=]"
    rf"|\b{_PREFIX}[A-Za-z0-9]{{16,80}}\b|\b[0-9a-f]{{32,128}}\b"
)
PATTERN = "|".join([_EMAIL, _SECRET, _IP, _PHONE, _SSN, _IBAN, _LONG, _NAME])
#: A text in which neither is found has no entity: an at sign, seven digits with little between them, an address of
#: four numbers, the sign after a secret's name; long hexadecimal strings, access keys, an IBAN's beginning, titles.
#: Both begin with a look at one character, at which nearly all places of a text fail.
HINTS = [
    rf"(?=[\d@=:])(?:@|\d(?:[ .()-]{{0,3}}\d){{6}}|\d\.\d{{1,3}}\.\d{{1,3}}\.\d|(?<={_BEFORE})[=:])",
    rf"[0-9a-f]{{32}}|(?=[AgsA-Z\p{{Lu}}])(?:{_PREFIX}[A-Za-z0-9]{{16}}|[A-Z]{{2}}\d{{2}} ?[A-Z0-9]{{4}} ?[A-Z0-9]{{4}}|(?:" + "|".join(TITLES) + r")\.? \p{Lu})",
]
#: Parts a text in which entities are marked; a text that holds it is matched twice instead.
_MARK = "\ue000"

GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carlos", "David", "Emil", "Felix", "Gustav", "Henri", "Ivan", "Jonas", "Karl", "Louis"],
    ("f", "latin"): ["Anna", "Berta", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Илья", "Кирилл"],
    ("f", "cyrillic"): ["Анна", "Вера", "Галина", "Дарья", "Елена", "Ирина", "Ксения", "Лидия"],
    ("m", "greek"): ["Ανδρέας", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος"],
    ("f", "greek"): ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Μαρία", "Σοφία"],
}
SYLLABLES = {
    "latin": ["ba", "be", "do", "fa", "ga", "ka", "ko", "la", "le", "lo", "ma", "mi", "na", "no", "pa", "ra", "ri", "ro", "sa", "so", "ta", "to", "va", "vi"],
    "cyrillic": ["ба", "бе", "до", "фа", "га", "ка", "ко", "ла", "ле", "ло", "ма", "ми", "на", "но", "па", "ра", "ри", "ро", "са", "со", "та", "то", "ва", "ви"],
    "greek": ["βα", "βε", "γα", "γο", "δα", "δο", "κα", "κο", "λα", "λε", "μα", "μι", "να", "νο", "πα", "πο", "ρα", "ρο", "σα", "σο", "τα", "το", "φα", "φι"],
}
#: The letters of an enciphered attempt in each script, and the end of a family name.
CIPHER = {"latin": "bcdfghjklmnprstv", "cyrillic": "бвгджзклмнпрстфх", "greek": "βγδζθκλμνξπρστφχ"}
NAME_END = {"latin": "n", "cyrillic": "н", "greek": "ς"}


def _parts(text: Column) -> Column:
    """What lies between matches and the matches, in order, each with whether it is an entity;
    most texts, at little cost, are one part."""
    hint = text.rlike(HINTS[0]) | text.rlike(HINTS[1])
    marked = F.split(F.regexp_replace(text, F.lit(PATTERN), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)
    both = F.zip_with(F.split(text, PATTERN, -1), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), lambda g, m: F.array(g, m))
    twice = F.filter(F.flatten(both), lambda p: p.isNotNull())
    cut = F.when(hint, F.when(text.contains(_MARK), twice).otherwise(marked)).otherwise(F.array(text))

    def tagged(parts: Column) -> Column:
        def one(p: Column, i: Column) -> Column:
            return F.struct(p.alias("text"), F.when(i % 2 == 1, _genuine(p, F.get(parts, i - 1))).otherwise(False).alias("entity"))

        return F.transform(parts, one)

    return _with(cut, tagged)


def _genuine(match: Column, before: Column) -> Column:
    """Whether a match is an entity: a number in a card's form is one if its Luhn check holds,
    or if it stands where a secret does.  Others are numbers of any kind."""
    number = match.rlike(r"^\d(?:[ -]?\d){12,18}$")
    digits = F.regexp_replace(match, "[ -]", "")
    valid = _with(digits, lambda d: _luhn(F.substr(d, F.lit(1), F.length(d) - 1)).cast("string") == F.substr(d, F.length(d), F.lit(1)))
    return F.when(number, valid | before.rlike(_BEFORE + r"[=:] {0,2}[\"']?$")).otherwise(True)


def _matches(parts: Column) -> Column:
    return F.transform(F.filter(parts, lambda p: p["entity"]), lambda p: p["text"])


def _is_row(match: Column) -> Column:
    """Whether a match is a row of more groups of four digits than one card has."""
    return (F.length(match) > 19) & match.rlike(r"^\d{4}(?: \d{4}){4,}$")


def _check_sum(group: Column) -> Column:
    """What four digits add to a Luhn sum."""

    def digit(i: int) -> Column:
        return F.substring(group, i, 1).cast("int")

    def double(d: Column) -> Column:
        return d * 2 - F.when(d > 4, 9).otherwise(0)

    return double(digit(1)) + digit(2) + double(digit(3)) + digit(4)


def _pieces(row: Column) -> Column:
    """Of a row, by turns: the groups before a card (maybe none), and the card; the rest at the end.

    Cards are those four groups whose Luhn check holds, from the left; four that don't
    begin as cards do give way to four that do and overlap them.  Every group gets one character that says whether a
    card could begin there, one pattern picks the beginnings from that text, and marks part the groups: linear in the row.
    """

    def part(x: Column) -> Column:
        groups, sums = x["groups"], x["sums"]

        def state(g: Column, i: Column) -> Column:
            holds = (F.get(sums, i) + F.get(sums, i + 1) + F.get(sums, i + 2) + F.get(sums, i + 3)) % 10 == 0  # null near the end
            return F.when(~F.coalesce(holds, F.lit(False)), "0").when(g.rlike("^(?:[3-6]|2[2-7])"), "2").otherwise("1")

        def marked(starts: Column) -> Column:
            begins = lambda i: F.coalesce(F.get(starts, i) == "s", F.lit(False))
            edge = lambda i: F.concat(F.when(begins(i - 4), _MARK).otherwise(""), F.when(begins(i), _MARK).otherwise(""))
            line = F.array_join(F.transform(groups, lambda g, i: F.concat(edge(i), g)), " ")
            line = F.concat(line, F.when(begins(F.size(groups) - 4), _MARK).otherwise(""))
            return F.transform(F.split(line, _MARK, -1), lambda p: F.trim(p))

        picked = F.regexp_replace(F.array_join(F.transform(groups, state), ""), "(?:2|1(?!.{0,2}2)).{3}", "s---")
        return _with(F.split(picked, ""), marked)

    return _with(_with(F.split(row, " "), lambda g: F.struct(g.alias("groups"), F.transform(g, _check_sum).alias("sums"))), part)


def _entities(matches: Column) -> Column:
    """The entities of matches: of a row of groups its cards."""
    each = F.transform(matches, lambda m: F.when(_is_row(m), F.filter(_pieces(m), lambda p, i: i % 2 == 1)).otherwise(F.array(m)))
    return F.when(F.exists(matches, _is_row), F.flatten(each)).otherwise(matches)


def _row_surrogate(key: str, row: Column) -> Column:
    fresh = F.transform(_pieces(row), lambda p, i: F.when(i % 2 == 1, _digits_surrogate(key, p)).otherwise(p))
    return F.array_join(F.filter(fresh, lambda p: p != ""), " ")


def find(text: Column) -> Column:
    """All entities of a text, in order."""
    return _with(_matches(_parts(text)), _entities)


def _any(e: Column, titles: list[str]) -> Column:
    return e.rlike(r"^(?:" + "|".join(titles) + r")\.? \p{Lu}")


def kind(e: Column) -> Column:
    return (
        F.when(e.rlike(rf"^(?:{_EMAIL})$"), "email")
        .when(_any(e, TITLES), "name")
        .when(e.rlike(rf"^(?:{_OCTET}\.){{3}}{_OCTET}$"), "ip")
        .when(e.rlike(rf"^[+(]?\d[\d() .-]{{6,}}$"), "digits")
        .when(e.rlike(rf"^(?:{_IBAN})$"), "iban")
        .otherwise("secret")
    )


def canonical(e: Column) -> Column:
    """The form in which mentions of one entity agree: e-mail addresses lower-cased, IBANs without spaces, numbers without
    separators (and a trunk zero in parentheses), names with the first title of their gender."""
    return _with(kind(e), lambda k: _canonical(e, k))


def _canonical(e: Column, k: Column) -> Column:
    plus = F.when(e.startswith("+"), "+").otherwise("")
    number = F.concat(plus, F.regexp_replace(F.regexp_replace(e, r"\(0\)", ""), r"\D", ""))
    return (
        F.when(k == "email", F.lower(e)).when(k == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(k == "digits", number)
        .when(k == "name", F.concat(_title(e), F.lit(" "), _after_title(e))).otherwise(e)
    )


def _title(e: Column) -> Column:
    return F.when(_any(e, MALE), MALE[0]).when(_any(e, FEMALE), FEMALE[0]).otherwise(EITHER[0])


def _after_title(e: Column) -> Column:
    return F.substr(e, F.instr(e, " ") + 1, F.length(e))


def family(e: Column) -> Column:
    """The canonical form of a name's family name alone, whatever its title and given names."""
    return F.concat(F.lit(MALE[0] + " "), F.substring_index(e, " ", -1))


def _checked(e: Column) -> Column:
    """The entities, in canonical form, whose surrogates could collide: for a name its family name as well."""

    def of(k: Column) -> Column:
        name = F.array_distinct(F.array(_canonical(e, k), family(e)))
        return F.when(k.isin("email", "secret", "iban"), F.array(_canonical(e, k))).when(k == "name", name).otherwise(F.array().cast("array<string>"))

    return _with(kind(e), of)


def _number(key: str, *parts: Column) -> Column:
    """A keyed pseudo-random number of 60 bits."""
    text = F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts))
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def _feistel(key: str, tweak: Column, left: Column, right: Column, left_size: Column, right_size: Column) -> Column:
    """struct(l, r): a keyed bijection of pairs below the two sizes."""

    def turn(s: Column, i: Column) -> Column:
        to_left = i % 2 == 0
        move = _number(key, tweak, i, F.when(to_left, s["r"]).otherwise(s["l"]))
        return F.struct(
            F.when(to_left, (s["l"] + move % left_size) % left_size).otherwise(s["l"]).alias("l"),
            F.when(to_left, s["r"]).otherwise((s["r"] + move % right_size) % right_size).alias("r"),
        )

    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn)


def _power(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(10**i).cast("long") for i in range(19))), (n + 1).cast("int"))


def _with(value: Column, f) -> Column:
    """``f(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _permute_digits(key: str, tweak: Column, digits: Column) -> Column:
    n = F.length(digits)
    a = F.floor(n / 2)
    b = n - a
    halves = _feistel(
        key, F.concat_ws("|", tweak, n.cast("string")), F.substr(digits, F.lit(1), a.cast("int")), F.substr(digits, (a + 1).cast("int"), b.cast("int")), _power(a), _power(b)
    )
    return _with(halves, lambda h: F.concat(F.lpad(h["l"].cast("string"), 10, "0").substr(F.lit(11) - a.cast("int"), a.cast("int")), F.lpad(h["r"].cast("string"), 10, "0").substr(F.lit(11) - b.cast("int"), b.cast("int"))))


def _luhn(digits: Column) -> Column:
    """The Luhn check digit for these digits."""
    double = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, (d.cast("int") * 2) % 10 + F.floor(d.cast("int") * 2 / 10)).otherwise(d.cast("int")).cast("int"),
    )
    return (F.lit(10) - F.aggregate(double, F.lit(0), lambda s, x: s + x) % 10) % 10


#: Country codes: of one digit, of two, and all others of three.
_CODE = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
#: Stands for a trunk zero in parentheses, which no number keeps abroad.
_TRUNK = "\ue001"


def _respelt(form: Column, sign: str, fresh: Column) -> Column:
    """``form`` with its characters of the class ``sign`` replaced, one by one, by those of
    ``fresh``; what is over follows at the end."""
    marks = F.split(F.regexp_replace(form, sign, "\ue002"), "")

    def put(new: Column) -> Column:
        def step(s: Column, c: Column) -> Column:
            mine = c == "\ue002"
            return F.struct(F.concat(s["out"], F.when(mine, F.substr(new, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["n"] + F.when(mine, 1).otherwise(0)).alias("n"))

        start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))
        return F.aggregate(marks, start, step, lambda s: F.concat(s["out"], F.substr(new, s["n"] + 1, F.length(new))))

    return _with(fresh, put)


def _digits_surrogate(key: str, e: Column, plain: Column | None = None) -> Column:
    """By the canonical digits, written in the separators of the mention.  A number of ten digits
    that isn't a card is taken for one of country code 1."""
    form = F.replace(e, F.lit("(0)"), F.lit(_TRUNK))
    plain = F.regexp_replace(e, r"[^\d+]", "") if plain is None else plain  # a card

    def card(d: Column) -> Column:
        head = F.substr(d, F.lit(1), F.length(d) - 1)
        off = F.substr(d, F.length(d), F.lit(1)).cast("int") - _luhn(head) + 10
        return _with(_permute_digits(key, F.lit("card"), head), lambda h: F.concat(h, ((_luhn(h) + off) % 10).cast("string")))

    def number(x: Column) -> Column:
        code, d = x["code"], x["digits"]
        tweak = F.when((code == "") & (F.length(d) == 10), "+1").otherwise(code)
        fresh = F.when((F.length(d) >= 13) & (code == ""), card(d)).otherwise(_permute_digits(key, F.concat(F.lit("digits"), tweak), d))
        return F.concat(F.regexp_replace(code, r"\D", ""), fresh)

    def parted(code: Column) -> Column:
        return F.struct(code.alias("code"), F.regexp_replace(F.substr(plain, F.length(code) + 1, F.length(plain)), r"\D", "").alias("digits"))

    fresh = _with(_with(F.regexp_extract(plain, _CODE, 0), parted), number)
    return F.replace(_respelt(form, r"\d", fresh), F.lit(_TRUNK), F.lit("(0)"))


def _rest97(text: Column) -> Column:
    """A number modulo 97, letters standing for 10 to 35."""

    def step(r: Column, c: Column) -> Column:
        digit = F.ascii(c) - 48
        return F.when(digit <= 9, (r * 10 + digit) % 97).otherwise((r * 100 + digit - 7) % 97)

    return F.aggregate(F.split(text, ""), F.lit(0), step)


def _check97(country: Column, rest: Column) -> Column:
    return F.lit(98) - _rest97(F.concat(rest, country, F.lit("00")))


def _iban_surrogate(key: str, e: Column, plain: Column, attempt: Column) -> Column:
    """Country, form and the validity of the check digits stay; what later attempts add are digits."""
    longer = F.repeat(F.lit("0"), F.least(attempt, F.lit(CIPHERED)) * 2)
    old = F.struct(F.substring(plain, 1, 2).alias("country"), F.substr(plain, F.lit(5), F.length(plain)).alias("rest"))

    def whole(x: Column) -> Column:
        usual = _with(_keyed(key, F.lit("iban"), plain, attempt), lambda d: _substitute(F.concat(x["rest"], longer), d))
        off = F.substring(plain, 3, 2).cast("int") - _check97(x["country"], x["rest"])  # 0 where they are valid
        new = F.when(attempt < CIPHERED, usual).otherwise(F.upper(_ciphered(key, plain, attempt)))
        checked = lambda r: F.concat(x["country"], F.lpad((F.pmod(_check97(x["country"], r) - 2 + off, F.lit(97)) + 2).cast("string"), 2, "0"), r)
        return _with(new, checked)

    return _respelt(e, "[A-Z0-9]", _with(old, whole))


def _ip_surrogate(key: str, e: Column) -> Column:
    o = F.transform(F.split(e, r"\."), lambda x: x.cast("long"))

    def fresh(v: Column) -> Column:
        first = F.element_at(v, 1)
        usual = (first >= 1) & (first <= 223)
        low = F.element_at(v, 2) * 65536 + F.element_at(v, 3) * 256 + F.element_at(v, 4)
        h = _feistel(key, F.when(usual, F.lit("ip")).otherwise(F.concat(F.lit("ip"), first.cast("string"))), F.when(usual, first - 1).otherwise(0), low, F.when(usual, F.lit(223)).otherwise(F.lit(1)), F.lit(1 << 24))
        return _with(h, lambda p: F.concat_ws(".", F.when(usual, p["l"] + 1).otherwise(first).cast("string"), F.floor(p["r"] / 65536).cast("string"), (F.floor(p["r"] / 256) % 256).cast("string"), (p["r"] % 256).cast("string")))

    return _with(o, fresh)


def _letters(first: int, size: int) -> str:
    return "".join(chr(first + k) for k in range(size))


#: Scripts by their first and last letter, and the letters that replace theirs.
_SCRIPTS = [
    ("a", "z", _letters(0x61, 26)), ("A", "Z", _letters(0x41, 26)), ("а", "я", _letters(0x430, 32)), ("А", "Я", _letters(0x410, 32)),
    ("α", "ω", _letters(0x3B1, 17)), ("Α", "Ω", _letters(0x391, 17)), ("à", "ö", _letters(0xE0, 23)), ("ø", "þ", _letters(0xF8, 6)), ("À", "Ö", _letters(0xC0, 23)), ("Ø", "Þ", _letters(0xD8, 6)),
    ("\u0621", "\u064a", _letters(0x628, 19)), ("\u05d0", "\u05ea", _letters(0x5D0, 27)), ("\u0904", "\u0939", _letters(0x915, 37)), ("\u0e01", "\u0e2e", _letters(0xE01, 46)),
    ("\u3041", "\u3096", _letters(0x3042, 84)), ("\u30a1", "\u30fa", _letters(0x30A2, 88)), ("\u4e00", "\u9fff", _letters(0x4E00, 512)), ("\uac00", "\ud7a3", _letters(0xAC00, 512)),
]


def _substitute(text: Column, digest: Column) -> Column:
    """Each letter or digit by one of the same class, chosen by the digest and the place.
    Letters of scripts that are not listed become Latin ones of the same case."""
    hexadecimal = text.rlike(r"^(?=.*\d)(?=.*[a-f])[0-9a-f]+$")

    def one(c: Column, i: Column) -> Column:
        n = F.conv(F.substr(digest, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7
        out = F.when(hexadecimal, F.substr(F.lit("0123456789abcdef"), n % 16 + 1, F.lit(1))).when(c.rlike(r"^\d$"), (n % 10).cast("string"))
        for first, last, letters in _SCRIPTS:
            out = out.when((c >= first) & (c <= last), F.substr(F.lit(letters), n % len(letters) + 1, F.lit(1)))
        plain = "bcdfghklmnprstvw"
        return out.when(c.rlike(r"^\p{Lu}$"), F.upper(F.substr(F.lit(plain), n % 16 + 1, F.lit(1)))).when(c.rlike(r"^\p{L}$"), F.substr(F.lit(plain), n % 16 + 1, F.lit(1))).otherwise(c)

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *(p.cast("string") for p in parts)), 512)


def _longer(attempt: Column) -> Column:
    """What later attempts add: letters that are replaced like the others."""
    return F.repeat(F.lit("x"), F.least(attempt, F.lit(CIPHERED)) * 2)


def _ciphered(key: str, e: Column, attempt: Column) -> Column:
    """Attempt and entity under AES, as hexadecimal digits: different for different pairs."""
    secret = F.unhex(F.lit(hashlib.sha256(f"cipher|{key}".encode()).hexdigest()[:32]))
    return F.lower(F.hex(F.aes_encrypt(F.concat_ws("|", attempt.cast("string"), e).cast("binary"), secret, F.lit("ECB"), F.lit("PKCS"))))


def _spelt(code: Column, script: Column) -> Column:
    return _by_script(script, {s: F.translate(code, "0123456789abcdef", x) for s, x in CIPHER.items()})


def _email_surrogate(key: str, e: Column, attempt: Column) -> Column:
    local, domain = F.substring_index(e, "@", 1), F.lower(F.substring_index(e, "@", -1))
    name = F.regexp_extract(domain, r"^(.*)\.[^.]*$", 1)
    last = F.substring_index(domain, ".", -1)
    usual = _with(_keyed(key, F.lit("email"), F.lower(e), attempt), lambda d: _substitute(F.concat(local, _longer(attempt)), d))
    return F.concat(
        F.when(attempt < CIPHERED, usual).otherwise(F.translate(_ciphered(key, F.lower(e), attempt), "0123456789abcdef", CIPHER["latin"])), F.lit("@"),
        _with(_keyed(key, F.lit("domain"), domain), lambda d: _substitute(name, d)), F.lit("."), last,
    )


def _given_names(key: str, e: Column, plain: Column, words: Column, script: Column, attempt: Column) -> Column:
    """The words of a name, its given names replaced by ones that depend on the whole name."""

    def of(h: Column) -> Column:
        female = F.when(_any(e, EITHER), _hex4(h, F.lit(31)) % 2 == 0).otherwise(_any(e, FEMALE))
        more = F.when(attempt == 0, "").when(attempt < CIPHERED, _sounds(h, script, attempt * 2)).otherwise(_spelt(_ciphered(key, plain, attempt), script))
        which = F.concat(F.when(female, "f ").otherwise("m "), script)
        some = F.lit(None).cast("array<string>")
        for (g, s), names in GIVEN.items():
            some = F.when(which == f"{g} {s}", F.array(*map(F.lit, names))).otherwise(some)

        def listed(x: Column) -> Column:
            one = lambda w, i: F.when((i == 0) | (i == F.size(words) - 1), w).otherwise(F.concat(_nth(x["some"], _hex4(h, i)), x["more"]))
            return F.transform(words, one)

        return _with(F.struct(some.alias("some"), more.alias("more")), listed)

    return _with(_keyed(key, F.lit("name"), plain, attempt), of)


def _family_name(key: str, kin: Column, script: Column, attempt: Column) -> Column:
    """The surrogate of a family name, by its canonical form."""

    def of(h: Column) -> Column:
        usual = _sounds(h, script, F.least(attempt, F.lit(CIPHERED)) * 2 + 4)
        end = _by_script(script, {s: F.lit(x) for s, x in NAME_END.items()})
        return F.initcap(F.concat(F.when(attempt < CIPHERED, usual).otherwise(_spelt(_ciphered(key, kin, attempt), script)), end))

    return _with(_keyed(key, F.lit("family"), kin, attempt), of)


def _hex4(h: Column, i: Column) -> Column:
    return F.conv(F.substr(h, (i % 32) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _nth(items: Column, n: Column) -> Column:
    return F.get(items, n % F.size(items))


def _by_script(script: Column, of: dict[str, Column]) -> Column:
    out = F.lit(None)
    for s, v in of.items():
        out = F.when(script == s, v).otherwise(out)
    return out


def _sounds(h: Column, script: Column, n: Column) -> Column:
    syllables = _by_script(script, {s: F.array(*map(F.lit, x)) for s, x in SYLLABLES.items()})
    return _with(syllables, lambda some: F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: _nth(some, _hex4(h, i + 4))), ""))


def _name_surrogate(key: str, e: Column, plain: Column, attempt: Column, family_attempt: Column, keeps: Column) -> Column:
    """Title, gender, script and number of words stay.  The family name depends on the family
    name alone, given names on the whole name; where ``keeps`` holds the family name stays."""
    last = F.substring_index(e, " ", -1)
    script = F.when(last.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(last.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")

    def of(x: Column) -> Column:
        words, s = x["words"], x["script"]
        # A name of one word is its family's.
        first = F.when(F.size(words) > 2, _given_names(key, e, plain, words, s, attempt)).otherwise(words)
        new = F.when(keeps, x["last"]).otherwise(_with(family(e), lambda kin: _family_name(key, kin, s, family_attempt)))
        return F.concat_ws(" ", F.slice(first, F.lit(1), F.size(words) - 1), new)

    return _with(F.struct(F.split(e, " ").alias("words"), script.alias("script"), last.alias("last")), of)


def surrogate(e: Column, key: str, attempt: Column | None = None, family_attempt: Column | None = None) -> Column:
    """The replacement of one entity; of a name, with the family name's own attempt."""
    attempt = F.lit(0) if attempt is None else attempt.cast("int")
    family_attempt = attempt if family_attempt is None else family_attempt.cast("int")
    return _surrogate(e, key, attempt, family_attempt, F.lit(False))


def _compared(e: Column, key: str, attempt: Column) -> Column:
    """The surrogate of a canonical entity by which collisions are found: family names are
    compared with each other, and the names of one family by their given names."""
    return _surrogate(e, key, attempt, attempt, F.size(F.split(e, " ")) > 2)


def _surrogate(e: Column, key: str, attempt: Column, family_attempt: Column, keeps: Column) -> Column:
    def secret(e: Column, a: Column) -> Column:
        sign = F.regexp_extract(e, "^" + _PREFIX, 0)

        def of(sign: Column) -> Column:
            rest = F.substr(e, F.length(sign) + 1, F.length(e))
            usual = _with(_keyed(key, F.lit("secret"), e, a), lambda d: _substitute(F.concat(rest, _longer(a)), d))
            return F.concat(sign, F.when(a < CIPHERED, usual).otherwise(_ciphered(key, e, a)))

        return _with(sign, of)

    def by_kind(x: Column) -> Column:
        e, k, plain, a = x["e"], x["k"], x["plain"], x["a"]
        return (
            F.when(k == "email", _email_surrogate(key, e, a)).when(k == "name", _name_surrogate(key, e, plain, a, x["f"], x["keeps"])).when(k == "ip", _ip_surrogate(key, e))
            .when(k == "digits", _digits_surrogate(key, e, plain)).when(k == "iban", _iban_surrogate(key, e, plain, a)).otherwise(secret(e, a))
        )

    def bound(k: Column) -> Column:
        return F.struct(e.alias("e"), k.alias("k"), _canonical(e, k).alias("plain"), attempt.alias("a"), family_attempt.alias("f"), keeps.alias("keeps"))

    return _with(_with(kind(e), bound), by_kind)


def collisions(entities: DataFrame, key: str) -> DataFrame:
    """(entity, attempt) for those distinct canonical entities (column ``entity``) whose
    first surrogate another entity has too, or is an entity itself.

    A round looks only at the entities that the round before left.  It ends: from attempt
    ``CIPHERED`` on the surrogates of a round differ from each other, and those of one
    entity from round to round, so an entity can only meet the finitely many entities and
    surrogates that are settled, each of them once.
    """
    pending, rounds = entities.select("entity"), []
    while True:
        turn = F.lit(len(rounds))
        now = _with(_compared(F.col("entity"), key, turn), canonical)
        given = cut(pending.select("entity", turn.alias("attempt"), now.alias("surrogate")), "pii-surrogates")
        shared = given.groupBy("surrogate").agg(F.min("entity").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
        again = given.join(shared, "surrogate").where("entity != first").select("entity")
        real = given.join(entities.select(F.col("entity").alias("surrogate")), "surrogate", "left_semi").select("entity")
        clash = again.unionByName(real)
        for held, left in rounds:
            met = given.select("entity", "surrogate").join(held.select("surrogate", F.col("entity").alias("holder")), "surrogate")
            clash = clash.unionByName(met.join(left.select(F.col("entity").alias("holder")), "holder", "left_anti").select("entity"))
        bad = cut(clash.distinct(), "pii-bad")
        rounds.append((given, bad))
        if bad.isEmpty():
            break
        pending = bad
    out = entities.select("entity", F.lit(0).alias("attempt")).limit(0)
    for held, left in rounds[1:]:
        out = out.unionByName(held.select("entity", "attempt").join(left, "entity", "left_anti"))
    return out


def replace(docs: DataFrame, key: str, literal_exceptions: int = LITERAL_EXCEPTIONS) -> DataFrame:
    """``docs`` with the entities of ``text`` replaced, and their number: ``n_entities``, or
    ``n_entities_1`` and so on where ``docs`` has such a column.

    ``n_chars``, if there, follows the text.  Null texts stay null with 0 entities; empty
    ones stay empty.  All other columns stay as they are, whatever their names.  Texts of any
    length are matched whole.  Repeated rows get the same text, an entity the same surrogate
    in every row, and no two entities that surrogates could confuse the same one (of those
    that tie for one the smallest keeps it).  An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    found = docs.select(F.explode(find(text)).alias("e")).select(F.explode(_checked(F.col("e"))).alias("entity"))
    entities = cut(found.distinct(), "pii-entities")
    exceptions = collisions(entities, key)
    few = exceptions.limit(literal_exceptions + 1).collect()
    parts, n_entities, by, held = (free_name(docs, c) for c in ("parts", "n_entities", "text_hash", "tries"))
    if len(few) <= literal_exceptions:
        tries = F.create_map(*(F.lit(v) for r in few for v in (r["entity"], r["attempt"]))) if few else None
        source = docs
    else:  # the exceptions of each text come by its hash
        named = docs.select(F.xxhash64(text).alias(by), F.explode(F.array_distinct(F.flatten(F.transform(find(text), _checked)))).alias("entity")).distinct()
        maps = named.join(exceptions, "entity").groupBy(by).agg(F.map_from_entries(F.collect_list(F.struct("entity", "attempt"))).alias(held))
        source = docs.withColumn(by, F.xxhash64(text)).join(maps, by, "left")
        tries = F.coalesce(held, F.create_map().cast("map<string,int>"))
    attempt = (lambda e: F.lit(0)) if tries is None else (lambda e: F.coalesce(F.element_at(tries, e), F.lit(0)))
    marked = source.withColumn(parts, _parts(F.col("text")))
    fresh = lambda e: F.when(_is_row(e), _row_surrogate(key, e)).otherwise(surrogate(e, key, attempt(canonical(e)), attempt(family(e))))
    woven = F.array_join(F.transform(F.col(parts), lambda p: F.when(p["entity"], fresh(p["text"])).otherwise(p["text"])), "")
    out = marked.withColumn(n_entities, F.coalesce(F.size(_entities(_matches(F.col(parts)))), F.lit(0)))
    out = out.withColumn("text", F.when(F.col(n_entities) > 0, woven).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(n_entities) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*columns(docs), n_entities)


_drawn: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The key in ``spark.siftstone.pii.key``; where it is unset, one drawn at random for this
    application, which nobody can use later on."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(16))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace(table(spark, sf_dir, "documents"), session_key(spark))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents with surrogates in their texts.  Every row stays, with
    nulls, empty, long and repeated texts treated as in :func:`replace`; columns of any name stay."""
    return replace(docs, session_key(spark)).select(*columns(docs))
