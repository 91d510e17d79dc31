"""Personal information inside free text (problem 10): find it, and put typed pseudonyms in its place.

Items are found in the order e-mail, address, identity number, phone number, name; a span belongs to the first that
takes it. Names rest on a list of given and family names, on the endings that the list itself shows to be typical, so
that names missing from it are found too, and on titles before two capitalised words.

An item becomes ``[KIND pseudonym]``. The digits and letters of phone and identity numbers are permuted within their
format by a keyed Feistel network: the form stays, a number that passes its format's check keeps passing it and one that
fails keeps failing, dates inside stay dates, country codes and trunk prefixes stay as they are. Equal numbers keep equal
pseudonyms in all documents, and the holder of the key can undo it. Names, e-mail addresses and street addresses get a
keyed tag of their normal form.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from math import isqrt

import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.tables import stage

#: Most rows of a name list that goes to every task; a longer one is joined with the texts' words instead.
MOST_NAMES = 1_000_000
#: An ending of so many letters is typical of a role if so many names of the list have it.
ENDINGS = (3, 4, 5)
SUPPORT = 3
ROUNDS = 10
#: Words that a task keeps judged.
CACHED = 500_000

# Words and forms that addresses, phone and identity numbers are written with.
_S = r"[    ]"
_CAP = r"[\p{Lu}][\p{L}'’\-]+"
_LABEL = r"[\p{L}\p{N}](?:[\p{L}\p{N}\-]*[\p{L}\p{N}])?"
_AT = r"(?:\s?@\s?|\s?[\[({]\s?at\s?[\])}]\s?)"
_DOT = r"(?:\.|\s?[\[({]\s?dot\s?[\])}]\s?)"
EMAIL = regex.compile(
    rf"(?<![\p{{L}}\p{{N}}._%+\-])[\p{{L}}\p{{N}}](?:[\p{{L}}\p{{N}}._%+\-]*[\p{{L}}\p{{N}}_+\-])?"
    rf"(?:{_AT}{_LABEL}(?:{_DOT}{_LABEL})*{_DOT}\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}@])|{_S}at{_S}{_LABEL}(?:{_S}dot{_S}{_LABEL})*{_S}dot{_S}\p{{L}}{{2,}}(?![\p{{L}}\p{{N}}]))",
    regex.I,
)

_UNIT_EN = r"(?:Flat|Unit|Apt\.?|Apartment|Suite|Floor|Room)"
_WAY_EN = r"(?:Road|Rd|Street|St|Lane|Ln|Close|Avenue|Ave|Crescent|Cres|Drive|Dr|Way|Court|Ct|Place|Boulevard|Blvd|Terrace|Square|Sq|Gardens|Row|Hill|Parade|Grove)"
_WAY_FR = r"(?:rue|avenue|av\.|place|quai|boulevard|bd|chemin|allée|impasse|cours|route|passage|square)"
_WAY_ES = r"(?:Calle|C/|Plaza|Pl\.|Avenida|Avda\.|Av\.|Paseo|Camino|Ronda|Travesía|Carrera)"
_WAY_DE = r"(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|chaussee)"
_WAY_RU = r"(?:ул\.|улица|пер\.|переулок|пр\.|пр-т|просп\.|проспект|пл\.|площадь|наб\.|набережная|бул\.|бульвар|ш\.|шоссе)"
_PART_RU = rf"(?:,?{_S}(?:кв\.|квартира|корп\.|корпус|к\.|стр\.|строение|эт\.|этаж|оф\.|офис|под\.){_S}?\d+\p{{L}}?)*"
_HINT_EN = ("road", "rd", "street", "st", "lane", "ln", "close", "ave", "cres", "dr", "way", "court", "ct", "place", "boulevard", "blvd", "terrace", "sq", "gardens", "row", "hill", "parade", "grove")
_HINT_FR = ("rue", "ave", "av.", "place", "quai", "boulevard", "bd", "chemin", "allée", "impasse", "cours", "route", "passage", "square")
_HINT_ES = ("calle", "c/", "plaza", "pl.", "avenida", "avda.", "av.", "paseo", "camino", "ronda", "travesía", "carrera")
_HINT_AT = ("am", "an", "im", "in", "zum", "zur", "auf", "unter")
_HINT_DE = ("strasse", "str.", "weg", "platz", "allee", "gasse", "ring", "damm", "ufer", "chaussee")
_HINT_RU = ("ул", "пер", "пр", "пл", "наб", "бул", "ш.", "шоссе")
#: Address forms, each with case-folded pieces of text one of which every match holds.
ADDRESS = [
    (hint, regex.compile(form))
    for hint, form in (
        (("flat", "unit", "apt", "apartment", "suite", "floor", "room"), rf"(?i:{_UNIT_EN}){_S}(?:\d+\p{{L}}?|\p{{L}}),{_S}\d+[A-Za-z]?(?:{_S}(?:{_CAP}|\p{{Lu}}\.)){{1,3}}{_S}(?i:{_WAY_EN})(?![\p{{L}}\p{{N}}])"),
        (_HINT_EN, rf"(?<![\p{{L}}\p{{N}}.,/:\-])\d+[A-Za-z]?(?:-\d+)?(?:{_S}(?:{_CAP}|\p{{Lu}}\.)){{1,3}}?{_S}(?i:{_WAY_EN})(?![\p{{L}}\p{{N}}])(?:\.?,{_S}(?i:{_UNIT_EN}){_S}(?:\d+\p{{L}}?|\p{{Lu}})(?![\p{{L}}\p{{N}}]))?"),
        (_HINT_FR, rf"(?<![\p{{L}}\p{{N}}.,/:\-])\d+(?:{_S}?(?:bis|ter|quater|[A-D])(?!\p{{L}}))?,?{_S}(?i:{_WAY_FR}){_S}(?:(?:de{_S}la|de{_S}l['’]|des|du|de|d['’]){_S}?)?{_CAP}(?:{_S}{_CAP})?(?:,{_S}(?:(?:bât\.|bâtiment|appt\.?|appartement|apt\.|esc\.|escalier|porte){_S}?\p{{N}}*\p{{Lu}}?|\d+(?:er|e|ème){_S}étage)(?!\p{{L}}))*"),
        (_HINT_ES, rf"(?<!\p{{L}})(?i:{_WAY_ES}){_S}?(?:(?:de{_S}los|de{_S}las|de{_S}la|del|de){_S})?{_CAP}(?:{_S}{_CAP})?,?{_S}(?:n\.?{_S}?[ºo°]{_S}?|n[ºo°]\.?{_S}?|núm\.?{_S}?)?\d+(?:{_S}?(?:bis|\p{{Lu}}))?(?![\p{{L}}\p{{N}}])(?:,{_S}(?:\d+\.?[ºªo°](?:{_S}?(?:\p{{Lu}}|izq|dcha|izda)(?!\p{{L}}))?|bajo(?:{_S}\p{{Lu}})?|piso{_S}\d+\p{{L}}?|puerta{_S}\w+))*"),
        (_HINT_AT, rf"(?<!\p{{L}})(?:Am|An{_S}der|An{_S}den|Im|In{_S}der|Zum|Zur|Auf{_S}der|Auf{_S}dem|Unter{_S}den){_S}{_CAP}(?:{_S}{_CAP})?{_S}\d+(?:{_S}?[a-z](?!\p{{L}}))?(?![\p{{L}}\p{{N}}])(?:,{_S}(?:\d+\.{_S}?(?:OG|UG|DG|Stock|Etage)|EG|DG|(?:Whg\.|Wohnung){_S}\d+)(?!\p{{L}}))*"),
        (_HINT_DE, rf"(?<!\p{{L}}){_CAP}(?:(?i:{_WAY_DE})|[\s-](?:Straße|Str\.|Weg|Platz|Allee|Gasse|Ring|Damm|Ufer)){_S}?\d+(?:{_S}?[a-z](?!\p{{L}}))?(?![\p{{N}}])(?:,{_S}(?:\d+\.{_S}?(?:OG|UG|DG|Stock|Etage)|EG|DG|(?:Whg\.|Wohnung){_S}\d+)(?!\p{{L}}))*"),
        (_HINT_RU, rf"(?<!\p{{L}}){_WAY_RU}{_S}?{_CAP}(?:{_S}{_CAP})?,?{_S}(?:д\.{_S}?|дом{_S})?\d+(?:[а-яА-Я](?!\p{{L}}))?(?:/\d+)?{_PART_RU}"),
        (_HINT_RU, rf"(?<!\p{{L}}){_CAP}{_S}{_WAY_RU},?{_S}(?:д\.{_S}?|дом{_S})?\d+(?:[а-яА-Я](?!\p{{L}}))?(?:/\d+)?{_PART_RU}"),
        (("号",), r"[\p{Han}]{1,8}(?:路|街|巷|弄|大道)\d+号(?:\d+(?:号楼|单元|楼|层|室))*"),
    )
]

_EDGE, _END = r"(?<![\p{L}\p{N}#=/_.,:+\-])", r"(?![\p{L}\p{N}/_=%])(?![.,:\-]\p{N})"
ID_NUMBER = regex.compile(
    "|".join(
        (
            rf"{_EDGE}\d{{3}}([\- ])\d{{2}}\1\d{{4}}{_END}",  # social security
            rf"{_EDGE}\p{{Lu}}{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?\d{{2}}{_S}?[A-D]{_END}",  # national insurance
            rf"{_EDGE}[A-Z]{{1,2}}\d{{7,8}}{_END}",  # passport
            rf"{_EDGE}\d{{8}}-?[A-Z]{_END}",  # identity card with a check letter
            rf"{_EDGE}[XYZ]-?\d{{7}}-?[A-Z]{_END}",
            rf"{_EDGE}[1-478]{_S}\d{{2}}{_S}\d{{2}}{_S}\d[\dAB]{_S}\d{{3}}{_S}\d{{3}}(?:{_S}\d{{2}})?{_END}",  # insurance, with birth date
            rf"{_EDGE}\d{{2}}{_S}\d{{3}}{_S}\d{{3}}{_S}\d{{3}}{_END}",  # tax and identity
            rf"{_EDGE}\d{{4}}{_S}\d{{6}}{_END}",  # internal passport
            rf"{_EDGE}\d{{3}}-\d{{3}}-\d{{3}}{_S}\d{{2}}{_END}",  # pension insurance
            rf"{_EDGE}\d{{17}}[\dX]{_END}",  # resident identity
        )
    )
)

_EXT = rf"(?:,?{_S}?(?:ext\.?|extension|x|Durchwahl|Dw\.|доб\.|poste|int\.|分机){_S}?\d{{1,5}})?"
_P_EDGE = r"(?<![\p{L}\p{N}#=/_.,:+\-])"
PHONE = regex.compile(
    "(?:"
    + "|".join(
        (
            rf"{_P_EDGE}\+\d{{1,3}}(?:{_S}?[.\-]?\(\d{{1,5}}\))?(?:{_S}?[.\-/]?\d{{1,12}}){{1,6}}",
            rf"{_P_EDGE}00\d{{2}}(?:[ \-]\d{{2,8}}){{1,5}}",
            rf"{_P_EDGE}(?:1[ \-.])?\(\d{{3}}\)[ \-]?\d{{3}}[\-. ]\d{{4}}",
            rf"{_P_EDGE}(?:1[\-.])?\d{{3}}([\-.])\d{{3}}\1\d{{4}}",
            rf"{_P_EDGE}\d{{3}}-\d{{4}}",
            rf"{_P_EDGE}8{_S}?(?:\(\d{{3}}\)|\d{{3}}){_S}?\d{{3}}[ \-]?\d{{2}}[ \-]?\d{{2}}",
            rf"{_P_EDGE}(?:\(0\d{{4}}\)|0\d{{4}}){_S}\d{{5,6}}",
            rf"{_P_EDGE}(?:\(0\d{{2,3}}\)|0\d{{2,3}}){_S}\d{{3,4}}{_S}\d{{4}}",
            rf"{_P_EDGE}0\d{{2,4}}(?:/|{_S}|{_S}?/{_S}?)\d{{4,8}}(?:[ \-]\d{{1,4}})?",
            rf"{_P_EDGE}0[1-9](?:([ .\-]?)\d{{2}})(?:\2\d{{2}}){{3}}",
            rf"{_P_EDGE}[5-9]\d{{2}}{_S}\d{{3}}{_S}\d{{3}}",
            rf"{_P_EDGE}[5-9]\d{{2}}{_S}\d{{2}}{_S}\d{{2}}{_S}\d{{2}}",
            rf"{_P_EDGE}1[3-9]\d[ \-]?\d{{4}}[ \-]?\d{{4}}",
        )
    )
    + rf"){_EXT}(?![\p{{L}}\p{{N}}/_=%@])(?![.,:\-]\p{{N}})",
    regex.I,
)

_TOKEN = regex.compile(r"\p{L}+(?:['’]\p{L}+)?(?:-\p{L}+(?:['’]\p{L}+)?)*")
_JOIN = regex.compile(rf"{_S}(?:\p{{Lu}}\.{_S}?){{0,3}}(?:(?:de{_S}la|de{_S}los|de|del|von{_S}der|von|van{_S}der|van{_S}den|van|zu|da|di|du|le|la){_S})?")
_COMMA = regex.compile(rf",{_S}")
_INITIALS = regex.compile(rf"(?:{_S}\p{{Lu}}\.){{1,3}}(?={_S}?[^\p{{L}}\s]|$|{_S}\p{{Ll}})")
_AT_HINT = regex.compile(r"[\[({]\s?at\s?[\])}]|\bdot\b", regex.I)
_DIGIT = regex.compile(r"\d")
_DIGITS = regex.compile(r"\d(?:[^\d\n\x00]{0,3}\d){5}")  # no number that is sought has fewer digits this close together
# Titles that stand before a person's name.
_TITLES = r"Dr|Prof|Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|M(?=\.)|Sr|Sra|Srta|Don|Doña|г-н|г-жа|господин|госпожа"
_HINT_TITLE = ("Dr", "Prof", "Mr", "Ms", "Miss", "Herr", "Frau", "Mme", "Mlle", "M.", "Sr", "Don", "Doña", "г-н", "г-жа", "господин", "госпожа")
TITLED = regex.compile(rf"(?<!\p{{L}})(?:(?:{_TITLES})\.?{_S})+({_CAP}{_JOIN.pattern}{_CAP})(?!{_S}{_CAP})(?![\p{{L}}\p{{N}}])")
KINDS = ("name", "email", "phone", "id_number", "address")


class Names:
    """What a list of (name part, role) says about a word: given name, family name, both or neither."""

    def __init__(self, rows: Iterable[tuple[str | None, str | None]]):
        self.listed: dict[str, set[str]] = {"given": set(), "family": set()}
        for part, role in rows:
            if part and role in self.listed:
                self.listed[role].add(unicodedata.normalize("NFC", part.strip()).casefold())
        self._roles: dict[str, int] = {}
        self.endings = {role: {e for e, n in Counter(w[-k:] for w in names for k in ENDINGS if len(w) > k).items() if n >= SUPPORT} for role, names in self.listed.items()}

    @classmethod
    def matched(cls, rows: Iterable[tuple[str, str, bool]]) -> Names:
        """What a list says about some texts, from those of its (form, role, is an ending) that occur there."""
        names = cls(())
        for form, role, ending in rows:
            (names.endings if ending else names.listed)[role].add(form)
        return names

    def roles(self, word: str) -> int:
        """Bits: 1 and 2 if it may be a given and a family name, 4 and 8 if it is listed as such.

        Every hyphenated part must be listed, or, in a word with a capital, end as names of that role do.
        """
        known = self._roles.get(word)
        if known is None:
            if len(self._roles) > CACHED:
                self._roles.clear()
            known = self._roles[word] = self._judge(word)
        return known

    def _judge(self, word: str) -> int:
        parts = [(p[0].isupper(), unicodedata.normalize("NFC", p).casefold()) for p in word.split("-")]
        bits = 0
        for role, may, sure in (("given", 1, 4), ("family", 2, 8)):
            listed, endings = self.listed[role], self.endings[role]
            if all(low in listed for _, low in parts):
                bits |= may | sure
            elif all(low in listed or capital and len(low) >= 5 and any(low[-k:] in endings for k in ENDINGS) for capital, low in parts):
                bits |= may
        return bits

    def find(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of full names: given family, with initials and particles; family, given; family given."""
        known, roles = self._roles, 0
        for word in _TOKEN.findall(text):
            if len(word) > 2 and (self.roles(word) if (bits := known.get(word)) is None else bits):
                roles += 1
        if roles < 2:
            return
        words = [(m.start(), m.end(), bits) for m in _TOKEN.finditer(text) if m.end() - m.start() > 2 and (bits := self.roles(m.group()))]
        i = 0
        while i < len(words) - 1:
            (start, end, a), (start_b, end_b, b) = words[i], words[i + 1]
            span = None
            if start_b - end > 20:
                pass
            elif _JOIN.fullmatch(text, end, start_b):
                if a & 1 and b & 2:
                    span = (start, end_b, 2)
                elif a & b & 1 and i + 2 < len(words) and words[i + 2][2] & 2 and _JOIN.fullmatch(text, end_b, words[i + 2][0]):
                    span = (start, words[i + 2][1], 3)
                elif a & 2 and b & 1 and start_b - end == 1 and (a & 8 or b & 4):
                    span = (start, end_b, 2)
            elif a & 2 and b & 1 and _COMMA.fullmatch(text, end, start_b):
                more = _INITIALS.match(text, end_b)
                span = (start, more.end() if more else end_b, 2)
            if span:
                yield span[:2]
            i += span[2] if span else 1

    def titled(self, text: str) -> Iterator[tuple[int, int]]:
        """Spans of two capitalised words, with initials and particles, behind a title."""
        for m in TITLED.finditer(text):
            yield m.span(1)


def find(text: str | None, names: Names) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all items, in order and apart from each other. A null text has none."""
    if not text:
        return []
    taken: list[tuple[int, int, str]] = []
    masked = text

    def take(kind: str, pattern: regex.Pattern) -> None:
        nonlocal masked
        spans = [m.span() for m in pattern.finditer(masked) if kind != "phone" or 7 <= sum(map(str.isdigit, m.group())) <= 20]
        if spans:
            pieces, at = [], 0
            for s, e in spans:  # a mark that no pattern takes, so that later ones stop at it
                taken.append((s, e, kind))
                pieces += [masked[at:s], "\x00" * (e - s)]
                at = e
            masked = "".join([*pieces, masked[at:]])

    if "@" in text or _AT_HINT.search(text):
        take("email", EMAIL)
    if _DIGIT.search(text):
        low = masked.casefold()
        for hints, form in ADDRESS:
            if any(h in low for h in hints):
                take("address", form)
        if _DIGITS.search(masked):
            take("id_number", ID_NUMBER)
            take("phone", PHONE)
    named = list(names.find(masked))
    if any(t in masked for t in _HINT_TITLE):
        named += [(s, e) for s, e in names.titled(masked) if not any(a < e and s < b for a, b in named)]
    return sorted(taken + [(s, e, "name") for s, e in named])


def _feistel(value: int, size: int, key: bytes, undo: bool = False) -> int:
    """A keyed permutation of the numbers below ``size``: an alternating Feistel network, walked on beyond the border."""
    if size < 2:
        return value
    b = isqrt(size - 1) + 1
    sizes = (-(-size // b), b)
    while True:
        halves = [value // b, value % b]
        for r in reversed(range(ROUNDS)) if undo else range(ROUNDS):
            into, other = r % 2, halves[1 - r % 2]
            f = int.from_bytes(hashlib.blake2b(f"{size}:{r}:{other}".encode(), key=key, digest_size=32).digest(), "big")
            halves[into] = (halves[into] - f if undo else halves[into] + f) % sizes[into]
        value = halves[0] * b + halves[1]
        if value < size:
            return value


_DIGIT_SIGNS, _LETTER_SIGNS = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Fixed values of the formats: check letters, weights, letters that a prefix may not have.
_CHECK_ES = "TRWAGMYFPDXBNJZSQVHLCKE"
_CHECK_CN, _WEIGHTS_CN = "10X98765432", (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)
_NO_FIRST_UK, _NO_SECOND_UK, _NO_PREFIX_UK = "DFIQUV", "DFIOQUV", ("BG", "GB", "NK", "KN", "TN", "NT", "ZZ")
#: Country codes of one digit, and first two digits of those with three; all others have two.
_ONE_DIGIT, _THREE_DIGITS = "17", "21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split()


def _eleven_ten(digits: str) -> int:
    """The check digit after ISO 7064, MOD 11,10."""
    p = 10
    for d in digits:
        p = (int(d) + p) % 10 or 10
        p = p * 2 % 11
    return (11 - p) % 10


def _sum_101(digits: str) -> int:
    return sum(int(d) * w for d, w in zip(digits, range(9, 0, -1))) % 101 % 100


def _good_ssn(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _good_nino(letters: str) -> bool:
    return letters[0] not in _NO_FIRST_UK and letters[1] not in _NO_SECOND_UK and letters[:2] not in _NO_PREFIX_UK


#: Formats of identity numbers by the signs alone: the pattern; the check's signs, and its value for the rest; the place
#: of a date (from, to); and the class that a permuted number must stay in.
FORMATS: list[tuple[regex.Pattern, str, Callable[[str], int] | None, tuple[int, int] | None, Callable[[str], object] | None]] = [
    (regex.compile(r"\d{17}[\dX]"), "0123456789X", lambda d: "0123456789X".index(_CHECK_CN[sum(int(x) * w for x, w in zip(d, _WEIGHTS_CN)) % 11]), (6, 14), None),
    (regex.compile(r"\d{8}[A-Z]"), _CHECK_ES, lambda d: int(d) % 23, None, None),
    (regex.compile(r"[XYZ]\d{7}[A-Z]"), _CHECK_ES, lambda d: int(str("XYZ".index(d[0])) + d[1:]) % 23, None, lambda d: d[0] in "XYZ"),
    (regex.compile(r"[1-478]\d{4}\d[\dAB]\d{6}\d{2}"), "00-96", lambda d: 97 - int(d.replace("A", "0").replace("B", "0")) % 97, (1, 5), lambda d: (d[0] in "12", d[0] in "123478", d[6] in "AB")),
    (regex.compile(r"\d{11}"), _DIGIT_SIGNS, _eleven_ten, None, lambda d: d[0] == "0"),
    (regex.compile(r"\d{9}"), "", None, None, _good_ssn),
    (regex.compile(r"[A-Z]{2}\d{6}[A-D]"), "", None, None, lambda d: (_good_nino(d), d[-1] in "ABCD")),
]


def _days(text: str) -> tuple[int, int] | None:
    """(number, how many there are) of a valid date: a day of 1900 to 2099 (8 digits) or a month of a century (4)."""
    if len(text) == 4:
        return (int(text[:2]) * 12 + int(text[2:]) - 1, 1200) if 1 <= int(text[2:]) <= 12 else None
    try:
        day = dt.date(int(text[:4]), int(text[4:6]), int(text[6:]))
    except ValueError:
        return None
    return ((day - _FIRST).days, _LAST) if 1900 <= day.year < 2100 else None


_FIRST = dt.date(1900, 1, 1)
_LAST = (dt.date(2100, 1, 1) - _FIRST).days


def _date(number: int, width: int) -> str:
    if width == 4:
        return f"{number // 12:02d}{number % 12 + 1:02d}"
    return (_FIRST + dt.timedelta(number)).strftime("%Y%m%d")


def _mixed(signs: str, key: bytes, undo: bool, same: Callable[[str], object]) -> str:
    """The signs permuted, digits among digits and capitals among capitals, until they are in the class they were in."""
    alphabets = [_DIGIT_SIGNS if c.isdigit() else _LETTER_SIGNS for c in signs]
    size = 1
    for a in alphabets:
        size *= len(a)
    shape, wanted, out = "".join("9" if len(a) == 10 else "A" for a in alphabets), same(signs), signs
    own = hashlib.blake2b(shape.encode(), key=key, digest_size=32).digest()
    while True:
        value = 0
        for c, a in zip(out, alphabets):
            value = value * len(a) + a.index(c)
        value = _feistel(value, size, own, undo)
        back = []
        for a in reversed(alphabets):
            value, at = divmod(value, len(a))
            back.append(a[at])
        out = "".join(reversed(back))
        if same(out) == wanted:
            return out


def _identity(signs: str, key: bytes, undo: bool) -> str:
    """An identity number's signs permuted within its format, see :data:`FORMATS`; unknown formats keep their shape."""
    for pattern, alphabet, check, date, kind in FORMATS:
        if pattern.fullmatch(signs):
            break
    else:
        return _mixed(signs, key, undo, lambda _: True)
    two = alphabet == "00-96"
    width = 0 if check is None else 2 if two else 1
    body, tail = signs[: len(signs) - width], signs[len(signs) - width :]
    if width and not two and tail not in alphabet:
        return _mixed(signs, key, undo, lambda s: s[-1] not in alphabet)
    days = _days(body[date[0] : date[1]]) if date and body[date[0] : date[1]].isdigit() else None
    if days is not None:
        new = _date(_feistel(days[0], days[1], key, undo), date[1] - date[0])
        rest = body[: date[0]] + body[date[1] :]
        rest = _mixed(rest, key, undo, (lambda s: kind(s[: date[0]] + new + s[date[0] :])) if kind else lambda _: True)
        fresh = rest[: date[0]] + new + rest[date[0] :]
    else:
        dated = (lambda s: _days(s[date[0] : date[1]]) is None if s[date[0] : date[1]].isdigit() else True) if date else (lambda _: True)
        fresh = _mixed(body, key, undo, lambda s: (dated(s), kind(s) if kind else None))
    if not width:
        return fresh
    # What the check is off by stays, so that a valid number stays valid.
    count = 100 if two else len(alphabet)
    old = int(tail) if two else alphabet.index(tail)
    now = (check(fresh) + old - check(body)) % count
    return fresh + (f"{now:02d}" if two else alphabet[now])


def _phone_start(digits: str, plus: bool, parted: bool) -> int:
    """How many digits of a phone number stay: the country code, or the trunk prefix."""
    abroad = 0 if plus else 2 if digits.startswith("00") else None
    if abroad is not None:
        code = digits[abroad : abroad + 3]
        return min(len(digits), abroad + (1 if code[:1] in tuple(_ONE_DIGIT) else 3 if code[:2] in _THREE_DIGITS else 2))
    return 1 if digits[:1] in ("0", "8") and len(digits) > 9 or digits[:1] == "1" and len(digits) == 11 and parted else 0


def permute(number: str, key: bytes, kind: str = "id_number", undo: bool = False) -> str:
    """The number with its digits and its capitals A to Z permuted within the format; all other signs stay."""
    own = _DIGIT_SIGNS if kind == "phone" else _DIGIT_SIGNS + _LETTER_SIGNS
    at = [i for i, c in enumerate(number) if c in own]
    signs = "".join(number[i] for i in at)
    if kind == "phone":
        plus, parted = number.lstrip().startswith("+"), number[1:2] in tuple("-. (")
        start = _phone_start(signs, plus, parted)
        kept = signs[:start]
        fresh = kept + _mixed(signs[start:], key, undo, lambda s: (s[:1] == "0", _phone_start(kept + s, plus, parted) == start)) if len(signs) > start else signs
    else:
        fresh = _identity(signs, key, undo) if signs else signs
    out = list(number)
    for i, c in zip(at, fresh):
        out[i] = c
    return "".join(out)


def _normal(kind: str, item: str) -> str:
    low = unicodedata.normalize("NFC", item).casefold()
    if kind == "name":
        return " ".join(sorted(regex.findall(r"\p{L}+", low)))
    if kind == "email":
        low = regex.sub(rf"{_AT}|{_S}at{_S}", "@", low)
        return regex.sub(rf"{_DOT}|{_S}dot{_S}", ".", low)
    return " ".join(regex.findall(r"[\p{L}\p{N}]+", low))


@lru_cache(maxsize=100_000)
def pseudonym(kind: str, item: str, key: bytes) -> str:
    """The placeholder of an item."""
    if kind in ("phone", "id_number"):
        return f"[{kind.upper()} {permute(item, key, kind)}]"
    tag = hashlib.blake2b(f"{kind}:{_normal(kind, item)}".encode(), key=key, digest_size=6).hexdigest()
    return f"[{kind.upper()} {tag}]"


def redact(text: str | None, names: Names, key: bytes) -> str | None:
    """The text with placeholders; null stays null, a text without items as it is."""
    if not text:
        return text
    out, at = [], 0
    for s, e, kind in find(text, names):
        out += [text[at:s], pseudonym(kind, text[s:e], key)]
        at = e
    return "".join([*out, text[at:]])


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``row, form, ending``: the distinct parts of each text's words, and their endings, in normal form."""
    for whole in batches:
        for lo in range(0, whole.num_rows, 2_000):
            part = whole.slice(lo, 2_000)
            out: list[tuple] = []
            for row, text in zip(part.column("row").to_pylist(), part.column("text").to_pylist()):
                low = {unicodedata.normalize("NFC", p).casefold() for w in set(_TOKEN.findall(text or "")) for p in w.split("-")}
                out += [(row, w, False) for w in low]
                out += [(row, e, True) for e in {w[-k:] for w in low for k in ENDINGS if len(w) > k}]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.string(), pa.bool_()))], ["row", "form", "ending"])


def _normal_parts(parts: pd.Series) -> pd.Series:
    return parts.map(lambda p: unicodedata.normalize("NFC", p.strip()).casefold())


def _joined(docs: DataFrame, listed: DataFrame) -> DataFrame:
    """``docs`` with ``hits``: what a list of any length says about each text's words, found by joins."""
    docs = stage(docs.withColumn("row", F.monotonically_increasing_id()), "texts")
    own = listed.where(F.col("name_part").isNotNull() & F.col("role").isin("given", "family")).select(F.pandas_udf(_normal_parts, "string")("name_part").alias("form"), "role").distinct()
    own = stage(own, "names")
    ends = own.select(F.explode(F.array(*(F.when(F.length("form") > k, F.right("form", F.lit(k))) for k in ENDINGS))).alias("form"), "role").where(F.col("form").isNotNull())
    ends = ends.groupBy("form", "role").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT).select("form", "role", F.lit(True).alias("ending"))
    known = own.select("form", "role", F.lit(False).alias("ending")).union(ends)
    forms = docs.select("row", "text").mapInArrow(_forms, "row long, form string, ending boolean")
    hits = forms.join(known.hint("merge"), ["form", "ending"]).groupBy("row").agg(F.collect_list(F.struct("form", "role", "ending")).alias("hits"))
    return docs.join(hits.hint("merge"), "row", "left").drop("row")


def _mapped(docs: DataFrame, name_list: DataFrame, schema: str, row) -> DataFrame:
    """``row(part, names)`` over the texts. A list within the bound goes to every task; a longer one is joined."""
    texts, listed = docs.select("doc_id", F.make_valid_utf8("text").alias("text")), name_list.select("name_part", "role").distinct()
    few = listed.limit(MOST_NAMES + 1).collect()
    if len(few) <= MOST_NAMES:
        names = docs.sparkSession.sparkContext.broadcast(Names((r.name_part, r.role) for r in few))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 2_000):
                    yield row(batch.slice(lo, 2_000), names.value)

        return texts.mapInArrow(run, schema)

    def run_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2_000):
                part = batch.slice(lo, 2_000)
                yield row(part, Names.matched((h["form"], h["role"], h["ending"]) for hits in part.column(2).to_pylist() for h in hits or ()))

    return _joined(texts, listed).mapInArrow(run_joined, schema)


def items(docs: DataFrame, name_list: DataFrame, key: bytes) -> DataFrame:
    """Distinct ``doc_id, kind, found, pseudonym`` of all items, exactly as written, with what stands for them.

    ``docs`` has ``doc_id, text``, ``name_list`` has ``name_part, role``; further columns are ignored. Null and empty
    texts have no items. Rows are handled where they are; what is found is small beside the texts.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(part: pa.RecordBatch, names: Names) -> pa.RecordBatch:
        at, kinds, found = [], [], []
        for i, text in enumerate(part.column(1).to_pylist()):
            for s, e, k in find(text, names):
                at.append(i)
                kinds.append(k)
                found.append(text[s:e])
        put = [pseudonym(k, f, key) for k, f in zip(kinds, found)]
        return pa.RecordBatch.from_arrays([part.column(0).take(pa.array(at, pa.int64())), *(pa.array(c, pa.string()) for c in (kinds, found, put))], ["doc_id", "kind", "found", "pseudonym"])

    return _mapped(docs, name_list, f"doc_id {kind}, kind string, found string, pseudonym string", row).distinct()


def redacted(docs: DataFrame, name_list: DataFrame, key: bytes) -> DataFrame:
    """``doc_id, text`` with every item replaced by its placeholder; one row for each input row."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def row(part: pa.RecordBatch, names: Names) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column(0), pa.array([redact(t, names, key) for t in part.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return _mapped(docs, name_list, f"doc_id {kind}, text string", row)
