"""Format-preserving pseudonyms of personal numbers, dates and addresses in texts.

A value is found by its shape, checked (card numbers and IBANs by their check digits, dates by the calendar,
network addresses by their octets), numbered within all valid values of its format, sent through a keyed
Feistel permutation of those numbers, and written back in the notation that was found.  So it stays valid and keeps
its separators, equal values become equal pseudonyms in all documents, however they are written,
different ones different, and with the key they can be turned back.  A format is what a value is and not how it is
written: a card number of so many digits, a day, an account of a country.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from calendar import monthrange
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from datetime import date
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tutorspark.llm.arrow_text import slices, utf8
from tutorspark.llm.storage import numbered

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
CACHED = 1 << 16


def _round(key: bytes, tweak: str, number: int, value: int, size: int) -> int:
    """Keyed pseudo-random number below ``size``, with 128 bits to spare."""
    length = (size.bit_length() + 7) // 8 + 16
    seed = b"%d|%d|%d|%s|%s" % (len(key), number, value, key, tweak.encode())
    return int.from_bytes(hashlib.shake_256(seed).digest(length), "big") % size


def permute(key: bytes, tweak: str, value: int, size: int, back: bool = False) -> int:
    """Feistel permutation of 0 .. size - 1, of which the tweak picks one; ``back`` inverts it.

    The value is a pair (left, right) below (a, b) with a * b barely above size; what falls outside
    is sent through again until it is inside.
    """
    if size <= 1:
        return value
    a = int(size**0.5) if size < 1 << 50 else _root(size)
    a = max(a, 1)
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        steps = range(ROUNDS)
        for number in reversed(steps) if back else steps:
            sign = -1 if back else 1
            if number % 2:
                right = (right + sign * _round(key, tweak, number, left, b)) % b
            else:
                left = (left + sign * _round(key, tweak, number, right, a)) % a
        value = left * b + right
        if value < size:
            return value


def _root(n: int) -> int:
    x = 1 << (n.bit_length() + 1) // 2
    while (y := (x + n // x) // 2) < x:
        x = y
    return x


def check_digit(digits: str) -> str:
    """Luhn's check digit for the digits before it."""
    total = 0
    for n, digit in enumerate(reversed(digits)):
        value = int(digit) * (2 if n % 2 == 0 else 1)
        total += value - 9 if value > 9 else value
    return str(-total % 10)


def _refill(shape: str, digits: str) -> str:
    """The digits in the places of the shape's digits."""
    left = iter(digits)
    return "".join(next(left) if c.isdigit() else c for c in shape)


def _only_digits(text: str) -> str:
    return "".join(c for c in text if c.isdigit())


def _separators(text: str) -> str:
    """The shape of a value: its digits as 0, the rest as it is."""
    return "".join("0" if c.isdigit() else c for c in text)


@dataclass(frozen=True)
class Kind:
    """A kind of value: where it may stand, its number among the values of its format (None if it is not
    valid) with the format's name and size, and how a number is written in the shape of a value."""

    name: str
    pattern: str
    number: Callable[[str], tuple[int, str, int] | None]
    write: Callable[[str, int], str]


def _card_number(text: str) -> tuple[int, str, int] | None:
    digits = _only_digits(text)
    if check_digit(digits[:-1]) != digits[-1]:
        return None
    return int(digits[:-1]), str(len(digits)), 10 ** (len(digits) - 1)


def _card_write(shape: str, number: int) -> str:
    body = str(number).zfill(len(_only_digits(shape)) - 1)
    return _refill(shape, body + check_digit(body))


def _octet_number(text: str) -> tuple[int, str, int] | None:
    octets = [int(x) for x in text.split(".")]
    if max(octets) > 255 or any(len(x) > 1 and x[0] == "0" for x in text.split(".")):
        return None
    return int.from_bytes(bytes(octets), "big"), "ipv4", 1 << 32


def _octet_write(shape: str, number: int) -> str:
    return ".".join(str(x) for x in number.to_bytes(4, "big"))


CARD = r"(?<!\w)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\w)"
#: National numbers with a leading 0, which stays, so that their pseudonyms are such numbers, too.
NATIONAL = r"0(?:\d{2,4}[ /-]\d{6,8}|\d(?:[ .-]\d{2}){4}|\d{2} \d{4} \d{4}|\d{3} \d{3} \d{4})"
PHONE = (
    r"(?<![\w+])(?:(?:\+\d{1,3}[ .-]?\(?\d{2,4}\)?|\(\d{3}\)|\d{3}(?=[.-]))[ .-]?\d{3}[ .-]\d{4}"
    r"|\+(?=(?:[ .()-]{0,2}\d){8})\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,8}){1,5}"
    rf"|\d{{3}} \d{{3}} \d{{4}}|{NATIONAL})(?!\w)"
)


def _phone_parts(text: str) -> tuple[str, str]:
    """The country code or the leading 0 stays, the rest is the number."""
    country = re.match(rf"\+\d{{1,3}}|0(?={NATIONAL[1:]}\Z)", text)
    cut = country.end() if country else 0
    return text[:cut], text[cut:]


def _phone_number(text: str) -> tuple[int, str, int] | None:
    country, rest = _phone_parts(text)
    digits = _only_digits(rest)
    form, size = f"{country}|{len(digits)}", 10 ** len(digits)
    if not re.search(CARD, text):
        if country or len(digits) != 10:
            return int(digits), form, size
        # Ten digits are a number without separators, too, if the first is none of 0 and 1; so stay those.
        first = 0 if digits[0] in "01" else 2 * 10**9
        return int(digits) - first, f"{form}|{'01' if first == 0 else '2-9'}", 2 * 10**9 if first == 0 else 8 * 10**9
    # A long number without separators is no card number, and its pseudonym must not be one either.
    wrong = _not_check(text)
    if wrong is None or digits[-1] not in wrong:
        return None
    form += "|unbroken"
    return int(digits[:-1]) * 9 + wrong.index(digits[-1]), form, size // 10 * 9


def _not_check(text: str) -> str | None:
    """Last digits with which + and digits are no card number; None for another shape."""
    return "0123456789".replace(check_digit(text[1:-1]), "") if text[1:].isdigit() else None


def _phone_write(shape: str, number: int) -> str:
    country, rest = _phone_parts(shape)
    length = len(_only_digits(rest))
    if not re.search(CARD, shape):
        if not country and length == 10 and _only_digits(rest)[0] not in "01":
            number += 2 * 10**9
        return country + _refill(rest, str(number).zfill(length))
    body, last = divmod(number, 9)
    new = country + str(body).zfill(length - 1)
    return new + _not_check(new + "0")[last]


#: The lengths of IBANs by country.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
    25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV",
    29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC", 33: "RU",
}
IBAN = "|".join(rf"(?:{c.replace(' ', '|')})\d{{2}}(?: ?[A-Z0-9]){{{n - 4}}}" for n, c in IBAN_LENGTHS.items())


def _iban_check(country: str, account: str) -> str:
    """The two check digits, by which the number is 1 modulo 97."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02}"


def _iban_number(text: str) -> tuple[int, str, int] | None:
    account = text[4:].replace(" ", "")
    if _iban_check(text[:2], account) != text[2:4]:
        return None
    number, shape, size = _spelt_number(account)
    return number, text[:2] + shape, size


def _iban_write(shape: str, number: int) -> str:
    account = _spelt_write(shape[4:], number)
    return shape[:2] + _iban_check(shape[:2], account.replace(" ", "")) + account


# Areas 000, 666 and 900-999, group 00 and serial 0000 are never given out.
AREAS = [n for n in range(1, 900) if n != 666]


def _insurance_number(text: str) -> tuple[int, str, int] | None:
    area, group, serial = (int(x) for x in text.split("-"))
    if area not in AREAS or group == 0 or serial == 0:
        return None
    return (AREAS.index(area) * 99 + group - 1) * 9999 + serial - 1, "insurance", len(AREAS) * 99 * 9999


def _insurance_write(shape: str, number: int) -> str:
    rest, serial = divmod(number, 9999)
    area, group = divmod(rest, 99)
    return f"{AREAS[area]:03}-{group + 1:02}-{serial + 1:04}"


def _date_order(text: str) -> str:
    """Year first; else day first, but month first with slashes."""
    return "ymd" if text[:4].isdigit() else "mdy" if "/" in text else "dmy"


def _date_number(text: str) -> tuple[int, str, int] | None:
    part = dict(zip(_date_order(text), re.split(r"[-/.]", text), strict=True))
    try:
        day = date(int(part["y"]), int(part["m"]), int(part["d"])).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    return day - FIRST_DAY, "day", LAST_DAY - FIRST_DAY + 1


def _padding(shape: str) -> int:
    """Digits that days and months have at least: one if any of the shape has one, as in 5/3/1980."""
    return min(map(len, re.split(r"[-/.]", shape)), default=2)


def _date_write(shape: str, number: int) -> str:
    day, width = date.fromordinal(number + FIRST_DAY), min(_padding(shape), 2)
    part = {"y": f"{day.year:04}", "m": f"{day.month:0{width}}", "d": f"{day.day:0{width}}"}
    mark = re.search(r"[-/.]", shape).group()
    return mark.join(part[c] for c in _date_order(shape))


# Slash dates that month first is none of: day first, with a day over 12, numbered among themselves, as a pseudonym
# that could be read month first would be another day.
LATE_BEFORE = [0, *accumulate(monthrange(1900 + n // 12, n % 12 + 1)[1] - 12 for n in range(2400))]


def _late_number(text: str) -> tuple[int, str, int] | None:
    day, month, year = (int(x) for x in text.split("/"))
    if not (1900 <= year <= 2099 and 1 <= month <= 12 and 12 < day <= monthrange(year, month)[1]):
        return None
    return LATE_BEFORE[(year - 1900) * 12 + month - 1] + day - 13, "day first", LATE_BEFORE[-1]


def _late_write(shape: str, number: int) -> str:
    month = bisect_right(LATE_BEFORE, number) - 1
    return f"{number - LATE_BEFORE[month] + 13:02}/{month % 12 + 1:0{_padding(shape)}}/{1900 + month // 12:04}"


def _alphabet(char: str) -> str | None:
    for alphabet in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"):
        if char in alphabet:
            return alphabet
    return None


def _spelt_number(text: str) -> tuple[int, str, int]:
    """Number, shape and count of the texts with letters of one case and digits in the same places."""
    number, size, shape = 0, 1, []
    for char in text:
        alphabet = _alphabet(char)
        shape.append(alphabet[0] if alphabet else char)
        if alphabet:
            number, size = number * len(alphabet) + alphabet.index(char), size * len(alphabet)
    return number, "".join(shape), size


def _spelt_write(shape: str, number: int) -> str:
    written = []
    for char in reversed(shape):
        alphabet = _alphabet(char)
        if alphabet:
            number, place = divmod(number, len(alphabet))
            char = alphabet[place]
        written.append(char)
    return "".join(reversed(written))


def _mail_number(text: str) -> tuple[int, str, int] | None:
    return _spelt_number(text[: text.index("@")])


def _mail_write(shape: str, number: int) -> str:
    cut = shape.index("@")
    return _spelt_write(shape[:cut], number) + shape[cut:]


#: Nothing that would make more of a date than a date; a time of day may follow.
DATE_END = r"(?:(?=T\d{2}:?\d{2})|(?![\w/-]|\.\d))"
#: In the order in which they claim a stretch of text that fits more than one.  A local part of a mail
#: address keeps its letters' case, digits and punctuation in place; its domain stays.
KINDS = (
    Kind("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+", _mail_number, _mail_write),
    Kind("iban", rf"(?<!\w)(?:{IBAN})(?!\w)", _iban_number, _iban_write),
    Kind("card", CARD, _card_number, _card_write),
    Kind("phone", PHONE, _phone_number, _phone_write),
    Kind("address", r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?!\w|\.\d)", _octet_number, _octet_write),
    Kind("insurance", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])", _insurance_number, _insurance_write),
    Kind(
        "date",
        rf"(?<![\w./-])(?:\d{{4}}([-/.])\d{{1,2}}\1\d{{1,2}}|\d{{1,2}}([-/.])\d{{1,2}}\2\d{{4}}){DATE_END}",
        _date_number,
        _date_write,
    ),
)
#: What ``pseudonymise`` replaces: slash dates are read day first, too, when month first is no date, and ten digits in
#: a row that begin with none of 0 and 1 are a phone number.
ALL_KINDS = (
    *KINDS,
    Kind("day_first_date", rf"(?<![\w./-])\d{{2}}/\d{{1,2}}/\d{{4}}{DATE_END}", _late_number, _late_write),
    Kind("phone", r"(?<![\w+./-])[2-9]\d{9}(?![\w/-]|\.\d)", _phone_number, _phone_write),
)
HAS_NUMBER = np.zeros(256, dtype=bool)
HAS_NUMBER[ord("0") : ord("9") + 1] = True
HAS_NUMBER[ord("@")] = True


def pseudonym(kind: Kind, key: bytes, value: str, back: bool = False) -> str | None:
    """The value's pseudonym, or with ``back`` the value behind it; None if it is not valid."""
    found = kind.number(value)
    if found is None:
        return None
    number, form, size = found
    return kind.write(value, permute(key, f"{kind.name}|{form}", number, size, back))


class Replacer:
    """Replaces the values in texts; pseudonyms met lately are remembered."""

    def __init__(self, key: bytes, kinds: Iterable[Kind] = KINDS, back: bool = False):
        self.kinds = [(kind, re.compile(kind.pattern, re.ASCII), lru_cache(CACHED)(self._one(kind, key, back))) for kind in kinds]

    @staticmethod
    def _one(kind: Kind, key: bytes, back: bool) -> Callable[[str], str | None]:
        return lambda value: pseudonym(kind, key, value, back)

    def __call__(self, text: str) -> tuple[str, list[tuple[int, int, str]]]:
        """The new text, and start, end and kind of the values in the old one."""
        found: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []
        for kind, pattern, replace in self.kinds:
            mine = []
            for match in pattern.finditer(text):
                new = replace(match.group())
                if new is not None:
                    mine.append((*match.span(), kind.name, new))
            if mine and taken:
                mine = [m for m in mine if not _overlaps(taken, m[0], m[1])]
            found += mine
            taken = sorted([*taken, *[(s, e) for s, e, _, _ in mine]])
        pieces, at = [], 0
        found.sort()
        for start, end, _, new in found:
            pieces += [text[at:start], new]
            at = end
        return "".join([*pieces, text[at:]]), [(s, e, k) for s, e, k, _ in found]


def _overlaps(taken: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether a stretch meets one of the sorted, separate stretches that are taken."""
    place = bisect_left(taken, (end, end))
    return place > 0 and taken[place - 1][1] > start


def pseudonymise(docs: DataFrame, key: str, text: str = "text", values: str = "pseudonyms", back: bool = False) -> DataFrame:
    """The rows of ``docs`` with the values in their texts replaced, and ``values``: array of
    (start, end, kind) of each in the old text, in code points.

    Invalid numbers and dates are left alone.  Values are linked however they are written: card numbers, accounts and
    phone numbers by their digits, dates by the day.  A slash date with a day over 12 in front is linked with its like
    only, and a date written without leading zeros comes back with them if its pseudonym needed none.  A NULL text stays NULL and has no values.  A column of
    the input that is called as ``values`` is left out.  Rows are replaced one by one: repeated rows
    alike, an empty table gives an empty one.  ``back`` turns pseudonyms into the values again.
    """
    names = [c for c in docs.columns if c.lower() != values.lower()]
    read, plain = numbered(docs, names)
    carried, text = list(plain.values()), plain[text]
    secret = key.encode()
    span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))

    def kernel(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replace = Replacer(secret, ALL_KINDS, back)
        for batch in batches:
            for part in slices(batch, text):
                column = part.column(text)
                data, offsets = utf8(column)
                numbers = np.r_[0, np.cumsum(HAS_NUMBER[data])]
                rows = np.flatnonzero(numbers[offsets[1:]] > numbers[offsets[:-1]])
                spans: list = [[] for _ in range(part.num_rows)]
                if len(rows):
                    texts = column.to_pylist()
                    for row in rows.tolist():
                        texts[row], found = replace(texts[row])
                        spans[row] = [{"start": s, "end": e, "kind": k} for s, e, k in found]
                    column = pa.array(texts, column.type)
                columns = [column if c == text else part.column(c) for c in carried]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, span)], [*carried, "found"])

    schema = [f"{c} {read.schema[c].dataType.simpleString()}" for c in carried]
    found = read.mapInArrow(kernel, ", ".join([*schema, "found array<struct<start:int,end:int,kind:string>>"]))
    return found.toDF(*names, values)
