"""Format-preserving pseudonyms for personal data by keyed Feistel permutations.

A value is found by a pattern, validated (checksum, calendar, ranges), and its characters are permuted within its
format: digits stay digits, letters letters of the same case, check digits are worked out anew, dates stay
dates.  Dates are numbers or have an English month, in any order with the year first or last; the year is one of
1900 to 2099, ordinals end as they should, and month and day keep their number of digits.  A time after a date stays,
as do the domain of an e-mail address and a telephone number's country.  The permutation depends on the key, the kind and the format only, so equal values (separators and the case
of letters aside) get equal pseudonyms in all documents, different ones different pseudonyms, and who has the key can invert it.

Nulls: a null text stays null and has no values.  Texts without values come back as they are.  Where patterns
overlap, the earlier kind in ``KINDS`` has the span.  Each text is read whole.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from harrow.llm.shared import ship, slim

ROUNDS = 8


class Feistel:
    """A keyed permutation of 0 .. n-1: rounds of modular addition between two halves, walked until inside."""

    def __init__(self, key: bytes, label: str, n: int):
        self.key, self.label, self.n = hashlib.blake2b(key, digest_size=32).digest(), label.encode(), n
        self.a = max(1, int(n**0.5) if n < 1 << 100 else 1 << (n.bit_length() // 2))
        self.b = -(-n // self.a)

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d/%d/%d/" % (i, x, self.n) + self.label, key=self.key, digest_size=24).digest())

    def _once(self, x: int, back: bool) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            f = self._f(i, left if i % 2 else right)
            f = -f if back else f
            if i % 2:
                right = (right + f) % self.b
            else:
                left = (left + f) % self.a
        return left * self.b + right

    def permute(self, x: int, back: bool = False) -> int:
        if self.n < 2:
            return x
        x = self._once(x, back)
        while x >= self.n:  # fewer than a of the a * b values are outside
            x = self._once(x, back)
        return x


def _permute_text(value: str, key: bytes, kind: str, back: bool, alphabets: Callable[[int, str], str | None]) -> str:
    """Permutes the characters that have an alphabet; alphabets(i, c) for the i-th such character."""
    digits, radix, places = [], [], []
    for i, c in enumerate(value):
        a = alphabets(len(places), c)
        if a:
            places.append((i, a))
            digits.append(a.index(c))
            radix.append(len(a))
    x, n = 0, 1
    for d, r in zip(digits, radix, strict=True):
        x, n = x * r + d, n * r
    x = Feistel(key, f"{kind}/{','.join(map(str, radix))}", n).permute(x, back)
    out = list(value)
    for (i, a), r in zip(reversed(places), reversed(radix), strict=True):
        x, d = divmod(x, r)
        out[i] = a[d]
    return "".join(out)


DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _digit(_: int, c: str) -> str | None:
    return DIGITS if c in DIGITS else None


def _by_class(_: int, c: str) -> str | None:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _card(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m[0]
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or len(set(digits)) < 2 or not luhn(digits):
        return None
    body = _permute_text(digits[:-1], key, "card", back, lambda i, c: DIGITS if i else DIGITS[1:] if c != "0" else None)
    digits = iter(body + next(d for d in DIGITS if luhn(body + d)))
    return "".join(next(digits) if c in DIGITS else c for c in value)


def _phone(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m[0]
    lead = re.match(r"\+\d{1,3}(?=[ .-]|\()|\+1(?=\d{10}$)", value)
    head = lead[0] if lead else ""
    digits = sum(c in DIGITS for c in value[len(head) :])
    if not 7 <= digits <= 12:
        return None
    return head + _permute_text(value[len(head) :], key, "phone", back, lambda i, c: DIGITS if i and c in DIGITS else (DIGITS[2:] if c in DIGITS[2:] else None))


def _ssn(m: re.Match, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, m[0].split("-"))
    areas = [a for a in range(1, 900) if a != 666]
    if area == 666 or not 1 <= area <= 899 or not group or not serial:
        return None
    x = (areas.index(area) * 99 + group - 1) * 9999 + serial - 1
    x = Feistel(key, "ssn", 898 * 99 * 9999).permute(x, back)
    x, serial = divmod(x, 9999)
    area, group = divmod(x, 99)
    return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"


def _ip(m: re.Match, key: bytes, back: bool) -> str | None:
    parts = m[0].split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    x = Feistel(key, "ip", 1 << 32).permute(int.from_bytes(bytes(map(int, parts))), back)
    return ".".join(map(str, x.to_bytes(4)))


def _iban_check(country: str, body: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97


def _iban(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m[0]
    plain = value.replace(" ", "")
    if not 15 <= len(plain) <= 34 or int(plain[2:4]) != _iban_check(plain[:2], plain[4:]):
        return None
    body = _permute_text(plain[4:], key, "iban" + plain[:2], back, _by_class)
    out = iter(f"{plain[:2]}{_iban_check(plain[:2], body):02d}{body}")
    return "".join(c if c == " " else next(out) for c in value)


MONTHS = "January February March April May June July August September October November December".split()


@lru_cache(maxsize=None)
def _days(least_day: int, one_month: bool, one_day: bool, month: int = 0) -> array:
    """Days of 1900 to 2099 in order whose month and day have one digit or two; of one month only if it is given."""
    days = map(date.fromordinal, range(date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal() + 1))
    return array("i", (d.toordinal() for d in days if d.day >= least_day and (d.month < 10, d.day < 10) == (one_month, one_day) and month in (0, d.month)))


def _moved(year: int, month: int, day: int, key: bytes, back: bool, kind: str = "date", least_day: int = 1, only: int = 0) -> date | None:
    """Permutes a date among those with as many digits in month and day, so that every spelling stays one of its kind."""
    if not 1900 <= year <= 2099 or not _is_date(year, month, day):
        return None
    days = _days(least_day, month < 10, day < 10, only)
    x = bisect_left(days, date(year, month, day).toordinal())
    return date.fromordinal(days[Feistel(key, f"{kind}/{month < 10:d}{day < 10:d}", len(days)).permute(x, back)])


def _iso(m: re.Match, key: bytes, back: bool) -> str | None:
    d = _moved(int(m["y"]), int(m["m"]), int(m["d"]), key, back)
    return d and f"{d.year:04d}{m['s']}{d.month:0{len(m['m'])}d}{m['s']}{d.day:0{len(m['d'])}d}"


def _any_numeric_date(m: re.Match, key: bytes, back: bool) -> str | None:
    """One format for all of a separator: / has the month first, . and - the day; dates that are valid the other way only are permuted among themselves."""
    a, b, year, s = int(m["a"]), int(m["b"]), int(m["v"]), m["t"]
    month_first = s == "/"
    d = _moved(year, *((a, b) if month_first else (b, a)), key, back)
    if not d:
        month_first = not month_first
        month, day = (a, b) if month_first else (b, a)
        d = _moved(year, month, day, key, back, "date/other", 13) if day > 12 else None
    if not d:
        return None
    first, second = (d.month, d.day) if month_first else (d.day, d.month)
    return f"{first:0{len(m['a'])}d}{s}{second:0{len(m['b'])}d}{s}{d.year:04d}"


def _is_date(y: int, m: int, d: int) -> bool:
    try:
        date(y, m, d)
        return True
    except ValueError:
        return False


def _ordinal(day: int) -> str:
    return "th" if 11 <= day <= 13 else {1: "st", 2: "nd", 3: "rd"}.get(day % 10, "th")


def _worded(m: re.Match, key: bytes, back: bool) -> str | None:
    """Names in full (May is one), of three letters, or Sept, which only September has; in capitals, small letters or with one capital."""
    name, suffix = m["mon"], m["suffix"] or ""
    style = next((f for f in (str.title, str.upper, str.lower) if f(name) == name), None)
    month = next((i for i, x in enumerate(MONTHS, 1) if name.title() in (x, x[:3], "Sept" if x == "September" else x)), 0)
    if not style or not month or suffix.lower() not in ("", _ordinal(int(m["wd"]))) or suffix not in (suffix.lower(), suffix.upper()):
        return None
    sept, short = name.title() == "Sept", len(name) == 3 and month != 5
    d = _moved(int(m["wy"]), month, int(m["wd"]), key, back, "date/sept" if sept else "date", only=9 if sept else 0)
    while d and short and d.month == 5:  # May would be read as a name in full
        d = _moved(d.year, d.month, d.day, key, back)
    if not d:
        return None
    new = style("Sept" if sept else MONTHS[d.month - 1][: 3 if short else None])
    number = f"{d.day:0{len(m['wd'])}d}" + (_ordinal(d.day).upper() if suffix.isupper() else _ordinal(d.day) if suffix else "")
    first, second = (new, number) if m.start("mon") < m.start("wd") else (number, new)
    return f"{first}{m['g1']}{second}{m['g2']}{d.year}"


def _email(m: re.Match, key: bytes, back: bool) -> str | None:
    local, at, domain = m[0].rpartition("@")
    # case is kept and does not count: letters are permuted in lower case
    out = _permute_text(local.lower(), key, "email/" + domain.lower(), back, _by_class)
    return "".join(c.upper() if o in UPPER else c for c, o in zip(out, local, strict=True)) + at + domain


def _secret(m: re.Match, key: bytes, back: bool) -> str | None:
    value = m["secret"]
    hexadecimal = re.fullmatch("[0-9a-f]+", value)
    new = _permute_text(value, key, "secret", back, (lambda i, c: DIGITS + "abcdef") if hexadecimal else _by_class)
    a, b = m.start("secret") - m.start(), m.end("secret") - m.start()
    return m[0][:a] + new + m[0][b:]


def _access_key(m: re.Match, key: bytes, back: bool) -> str | None:
    return m[0][:4] + _permute_text(m[0][4:], key, "key", back, lambda i, c: UPPER + DIGITS)


@dataclass(frozen=True)
class Kind:
    """needs: text without this has no value of the kind."""

    name: str
    needs: str
    pattern: re.Pattern
    replace: Callable[[re.Match, bytes, bool], str | None]


_B, _E = r"(?<![\w.+-])", r"(?![\w])"
_MONTH = r"(?=[JFMASONDjfmasond])(?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
KINDS = (
    Kind("email", "@", re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"), _email),
    Kind("secret", "", re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b)[\"']?\s*[=:]\s*[\"']?(?P<secret>[^\s\"',;]{6,})"), _secret),
    Kind("access_key", "A", re.compile(r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"), _access_key),
    Kind("iban", "", re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"), _iban),
    Kind("date", "", re.compile(r"(?<![\w/.-])(?P<y>(?:19|20)[0-9]{2})(?P<s>[-/.])(?P<m>[0-9]{1,2})(?P=s)(?P<d>[0-9]{1,2})(?!(?![Tt][0-9]{2}(?::?[0-9]{2}|Z|\b))[\w/-]|\.\d)"), _iso),
    Kind("date", "", re.compile(r"(?<![\w/.-])(?P<a>[0-9]{1,2})(?P<t>[-/.])(?P<b>[0-9]{1,2})(?P=t)(?P<v>(?:19|20)[0-9]{2})(?![\w/-]|\.\d)"), _any_numeric_date),
    Kind("date", "", re.compile(rf"\b(?P<mon>{_MONTH})(?P<g1>\.?\s{{1,3}}|\.?[-/])(?P<wd>[0-9]{{1,2}})(?P<suffix>(?i:st|nd|rd|th))?(?P<g2>,?\s{{1,3}}|,|[-/])(?P<wy>(?:19|20)[0-9]{{2}})\b"), _worded),
    Kind("date", "", re.compile(rf"\b(?P<wd>[0-9]{{1,2}})(?P<suffix>(?i:st|nd|rd|th))?(?P<g1>\.?\s{{1,3}}(?:of\s{{1,3}})?|[-/.])(?P<mon>{_MONTH})(?P<g2>\.?,?\s{{1,3}}|[-/.])(?P<wy>(?:19|20)[0-9]{{2}})\b"), _worded),
    Kind("ssn", "-", re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _ssn),
    Kind("card", "", re.compile(r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?P<c>[ -])\d{4}(?P=c)\d{4}(?P=c)\d{4}(?:(?P=c)\d{1,3})?|\d{4}(?P<x>[ -])\d{6}(?P=x)\d{5})(?![\w-])"), _card),
    Kind("ip", ".", re.compile(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _ip),
    Kind("phone", "", re.compile(r"(?<![\w+.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]\d{2,4}){2,5}(?![\w-])|(?<![\w+])\+1\d{10}(?!\w)"), _phone),
)
NAMES = tuple(dict.fromkeys(k.name for k in KINDS))
_ANY = re.compile(r"[\d@]|(?i:password|passwd|pwd|secret|token|key)")


def pseudonyms(text: str, key: bytes, back: bool = False) -> tuple[str, dict[str, int]]:
    """(text with its values permuted, how many of each kind)."""
    found: dict[str, int] = {}
    if not _ANY.search(text):
        return text, found
    spans: list[tuple[int, int, str]] = []
    for kind in KINDS:
        if kind.needs and kind.needs not in text:
            continue
        for m in kind.pattern.finditer(text):
            if any(a < m.end() and m.start() < b for a, b, _ in spans):
                continue
            new = kind.replace(m, key, back)
            if new is not None:
                spans.append((m.start(), m.end(), new))
                found[kind.name] = found.get(kind.name, 0) + 1
    out, at = [], 0
    for a, b, new in sorted(spans):
        out += (text[at:a], new)
        at = b
    return "".join([*out, text[at:]]), found


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, text with pseudonyms, n_values, n_<kind> for every row of docs.  key: kept by the caller."""
    ship(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new, n = [], []
            for value in batch.column(1).to_pylist():
                t, found = (None, {}) if value is None else pseudonyms(value, key)
                new.append(t)
                n.append(found)
            columns = [batch.column(0), pa.array(new, pa.string()), pa.array([sum(x.values()) for x in n], pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array([x.get(k, 0) for x in n], pa.int64()) for k in NAMES)], [id_col, "text", "n_values", *(f"n_{k}" for k in NAMES)])

    return docs.select(id_col, text).mapInArrow(slim(run), f"{id_col} {id_type}, text string, n_values long, " + ", ".join(f"n_{k} long" for k in NAMES))
