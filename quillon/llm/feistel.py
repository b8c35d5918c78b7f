"""Format-preserving pseudonyms of personal numbers and dates by a keyed Feistel permutation.

A value that passes its kind's validation is numbered within its format (all values of the same shape that
pass too), the number is permuted under the key, and the result is written in the same shape. Equal values
get equal pseudonyms in every document, so they stay linked; with the key the step can be undone.

Kinds, in order of precedence where spans overlap:

====== ==================================== ==================================================
kind   validated by                         kept
====== ==================================== ==================================================
email  one @ between name and host          host, separators, case and class of each character
card   Luhn sum, 13 to 19 digits            length, grouping, a valid Luhn sum
iban   mod-97 sum, 15 to 34 characters      country, classes of characters, a valid sum
ssn    area, group, serial not reserved     hyphens, the validation
phone  +country code and 7 to 14 digits     country code, grouping (any grouping, one pseudonym)
ip     four octets up to 255                digits in each octet
date   a day of the calendar, 1900 to 2099  order and separators, a day of that range
secret 32 to 64 hexadecimal digits of both  length, case
       letters and digits
====== ==================================== ==================================================

Phones, cards and IBANs may hold blanks and hyphens, so a match can run into a number that follows. Its ends at
group boundaries are tried, the likeliest first: a phone stops before an address, a date, an ssn or a card, at ten
digits after +1, and at a blank behind ten digits joined by hyphens or dots; a card is sought in its usual groups, an
IBAN in its country's length; then the longest valid one counts. Numbers without a country's code (555-123-4567) and
dates without leading zeros (3/12/2020) are no values here and stay. E-mail names that differ in case are different values. What stays open: a short number after a phone that
is written in blanks alone (+49 30 1234567 12) is read as its last group. A card in unusual groups or an IBAN of
an unlisted country beside other numbers may be cut otherwise when the step is undone, if a longer sum fits by chance.
"""

from __future__ import annotations

import datetime
import hashlib
import re
import string
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache, partial
from math import isqrt, prod

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import lean, text_runs

ROUNDS = 10


def permute(n: int, x: int, key: bytes, tweak: str, back: bool = False) -> int:
    """The keyed permutation of 0 to n - 1 at x; ``back`` inverts it.

    An unbalanced Feistel network over a rectangle that holds at least n points, walked until it falls below n.
    """
    if n < 2:
        return x
    a = isqrt(n - 1) + 1
    b = -(-n // a)
    while True:
        x = _network(a, b, x, key, tweak, back)
        if x < n:
            return x


def _network(a: int, b: int, x: int, key: bytes, tweak: str, back: bool) -> int:
    left, right = divmod(x, b)  # below a, below b
    for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if r % 2:
            left = (left + (-1 if back else 1) * _noise(key, tweak, r, right)) % a
        else:
            right = (right + (-1 if back else 1) * _noise(key, tweak, r, left)) % b
    return left * b + right


def _noise(key: bytes, tweak: str, r: int, half: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{r}|{half}".encode(), key=key, digest_size=32).digest(), "big")


def _mixed(radices: list[int], digits: list[int], key: bytes, tweak: str, back: bool) -> list[int]:
    """Permutes a number written in mixed radices."""
    x = 0
    for r, d in zip(radices, digits, strict=True):
        x = x * r + d
    x, out = permute(prod(radices), x, key, tweak, back), []
    for r in reversed(radices):
        x, d = divmod(x, r)
        out.append(d)
    return out[::-1]


def _refill(shape: str, replace: str, new: Iterator[str]) -> str:
    return re.sub(replace, lambda _: next(new), shape)


def luhn(digits: str) -> int:
    """The Luhn sum modulo 10; valid numbers have 0."""
    return sum((2 * int(c) - 9 * (c > "4")) if i % 2 else int(c) for i, c in enumerate(reversed(digits))) % 10


def _card(s: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", s)
    if not 13 <= len(d) <= 19 or luhn(d) or not int(d):
        return None
    n, first = 10 ** (len(d) - 1), _CARD.match(s)
    first = len(re.sub(r"\D", "", first[0])) if first and first.end() < len(s) else 0
    while True:
        body = str(permute(n, int(d[:-1]), key, f"card{len(d)}", back)).zfill(len(d) - 1)
        d = body + str(-luhn(body + "0") % 10)
        if not first or luhn(d[:first]):  # its first groups alone are no card either
            return _refill(s, r"\d", iter(d))


def _iban(s: str, key: bytes, back: bool) -> str | None:
    d = s.replace(" ", "")
    if not 15 <= len(d) <= 34 or _mod97(d) != 1:
        return None
    radices = [10 if c.isdigit() else 26 for c in d[4:]]
    digits = [int(c) if c.isdigit() else ord(c) - 65 for c in d[4:]]
    moved = _mixed(radices, digits, key, "iban" + d[:2] + "".join("d" if r == 10 else "a" for r in radices), back)
    body = "".join(str(x) if r == 10 else chr(65 + x) for x, r in zip(moved, radices, strict=True))
    return _refill(s, r"[0-9A-Z]", iter(f"{d[:2]}{98 - _mod97(d[:2] + '00' + body):02d}{body}"))


def _mod97(d: str) -> int:
    return int("".join(str(int(c, 36)) for c in d[4:] + d[:4])) % 97


def _ssn(s: str, key: bytes, back: bool) -> str | None:
    area, group, serial = map(int, s.split("-"))
    if area in (0, 666) or area >= 900 or not group or not serial:
        return None
    moved = _mixed([898, 99, 9999], [area - 1 - (area > 666), group - 1, serial - 1], key, "ssn", back)
    area = moved[0] + 1
    return f"{area + (area >= 666):03d}-{moved[1] + 1:02d}-{moved[2] + 1:04d}"


#: Country calling codes of one and of two digits; all others have three.
_ONE_DIGIT = "1 7".split()
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()


def _national(s: str) -> int:
    """Where the digits behind the country's code begin in a number that starts with +, however it is grouped."""
    digits = [i for i, c in enumerate(s[:12]) if c.isdigit()]
    code = "".join(s[i] for i in digits[:2])
    n = 1 if code[:1] in _ONE_DIGIT else 2 if code in _TWO_DIGITS else 3
    return digits[n - 1] + 1 if len(digits) >= n else len(s)


def _phone(s: str, key: bytes, back: bool) -> str | None:
    kept = _national(s)
    d = re.sub(r"\D", "", s[kept:])
    if not 7 <= len(d) <= 14:
        return None
    code = re.sub(r"\D", "", s[:kept])
    return s[:kept] + _refill(s[kept:], r"\d", iter(str(permute(10 ** len(d), int(d), key, f"phone+{code}.{len(d)}", back)).zfill(len(d))))


def _ip(s: str, key: bytes, back: bool) -> str | None:
    parts = s.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    low, radices = {1: 0, 2: 10, 3: 100}, {1: 10, 2: 90, 3: 156}
    moved = _mixed([radices[len(p)] for p in parts], [int(p) - low[len(p)] for p in parts], key, "ip" + ".".join(str(len(p)) for p in parts), back)
    return ".".join(str(x + low[len(p)]) for x, p in zip(moved, parts, strict=True))


_FIRST_DAY, _LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _date(s: str, key: bytes, back: bool) -> str | None:
    sep = re.search(r"\D", s)[0]
    parts = s.split(sep)
    if len(parts[0]) == 4:
        return _day(parts, (0, 1, 2), key, back, sep)
    # Day first where that is a date; else month first, which is then permuted among days that only so are dates.
    return _day(parts, (2, 1, 0), key, back, sep) or _day(parts, (2, 0, 1), key, back, sep)


def _day(parts: list[str], order: tuple[int, int, int], key: bytes, back: bool, sep: str) -> str | None:
    try:
        day = datetime.date(*(int(parts[i]) for i in order)).toordinal()
    except ValueError:
        return None
    if not _FIRST_DAY <= day <= _LAST_DAY:
        return None
    if order == (2, 0, 1):
        days = _late_days()
        day = days[permute(len(days), bisect_left(days, day), key, "late date", back)]
    else:
        day = _FIRST_DAY + permute(_LAST_DAY - _FIRST_DAY + 1, day - _FIRST_DAY, key, "date", back)
    d = datetime.date.fromordinal(day)
    out = ["", "", ""]
    for i, x in zip(order, (f"{d.year:04d}", f"{d.month:02d}", f"{d.day:02d}"), strict=True):
        out[i] = x
    return sep.join(out)


@lru_cache(1)
def _late_days() -> list[int]:
    return [x for x in range(_FIRST_DAY, _LAST_DAY + 1) if datetime.date.fromordinal(x).day > 12]


def _letters(s: str, key: bytes, tweak: str, back: bool) -> str:
    """Permutes letters among letters of their case and digits among digits."""
    at = [(i, 10, 48) if c.isdigit() else (i, 26, 65 if c.isupper() else 97) for i, c in enumerate(s) if c.isalnum()]
    moved = _mixed([r for _, r, _ in at], [ord(s[i]) - b for i, _, b in at], key, tweak + "".join("d" if r == 10 else "a" for _, r, _ in at), back)
    out = list(s)
    for (i, _, b), x in zip(at, moved, strict=True):
        out[i] = chr(b + x)
    return "".join(out)


def _email(s: str, key: bytes, back: bool) -> str | None:
    name, _, host = s.partition("@")
    # Longer names than the format allows are permuted 64 characters at a time.
    parts = (_letters(name[i : i + 64], key, f"email@{host.lower()}{f'#{i}' if i else ''}", back) for i in range(0, len(name), 64))
    return f"{''.join(parts)}@{host}"


def _secret(s: str, key: bytes, back: bool) -> str | None:
    if s.isdigit() or s.isalpha() or not (s == s.lower() or s == s.upper()):
        return None
    moved = f"{permute(16 ** len(s), int(s, 16), key, f'secret{len(s)}', back):0{len(s)}x}"
    return moved.upper() if s == s.upper() else moved


#: Cards in their usual groups, and what a phone or a card in other groups does not run into behind a blank.
_CARD = re.compile(r"(?:\d{4}([ -])\d{4}\1\d{4}\1\d{4}|\d{4}([ -])\d{6}\2\d{5}|\d{13,19})(?!\d)")
_OTHER = re.compile(r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)|\d{4}([-/.])\d{2}\1\d{2}(?![\d-])|\d{2}([-/.])\d{2}\2\d{4}(?!\d)|\d{3}-\d{2}-\d{4}(?![\d-])")
_IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV "
    "22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA 23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG "
    "25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU"
).split()) for c in cs.split(",")}


def _after_blanks(text: str, a: int, b: int) -> list[int]:
    return [i + 1 for i in range(a, b) if text[i] == " "]


def _phone_rank(text: str, a: int, b: int) -> tuple:
    s = text[a:b]
    kept = _national(s)
    apart = not any(_OTHER.match(text, i) or _CARD.match(text, i) for i in _after_blanks(text, a + kept, b))
    ten = s[:kept] != "+1" or len(re.sub(r"\D", "", s[kept:])) == 10
    joined = not any(len(re.sub(r"\D", "", s[kept : kept + m.end()])) >= 10 for m in re.finditer(r"(?<=\d)[.-]\d+(?= )", s[kept:]))
    return apart, ten, joined


def _card_rank(text: str, a: int, b: int) -> tuple | None:
    if _CARD.fullmatch(text, a, b):
        return (True,)
    for i in _after_blanks(text, a, b):
        card = _CARD.match(text, i)
        if _OTHER.match(text, i) or card and not luhn(re.sub(r"\D", "", card[0])):
            return None
    return (False,)


def _iban_rank(text: str, a: int, b: int) -> tuple:
    return (len(text[a:b].replace(" ", "")) == _IBAN_LENGTHS.get(text[a : a + 2]),)


@dataclass(frozen=True)
class Kind:
    """``rank`` orders ends at group boundaries, greater first; None is no end. Without it a match has one end."""

    name: str
    pattern: str
    change: Callable[[str, bytes, bool], str | None]
    rank: Callable[[str, int, int], tuple | None] | None = None


_DIGIT_KINDS = [
    Kind("iban", r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])", _iban, _iban_rank),
    Kind("secret", r"[0-9A-Fa-f]{32,64}(?![0-9A-Za-z])", _secret),
    Kind("phone", r"\+\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{2,4}(?:[ .-]?\d{2,4}){1,3}(?!\d)|\+\d{1,3}(?:[ .-]\d{2,8}){2,5}(?!\d)|\+\d{9,15}(?!\d)", _phone, _phone_rank),
    Kind("date", r"\d{4}([-/.])\d{2}\1\d{2}(?![\d-])|\d{2}([-/.])\d{2}\2\d{4}(?!\d)", _date),
    Kind("ssn", r"\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    Kind("ip", r"\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ip),
    Kind("card", r"\d(?:[ -]?\d){12,18}(?!\d)", _card, _card_rank),
]
KINDS = ["email", *(k.name for k in _DIGIT_KINDS)]
#: What any of the kinds may begin with: a sign, a digit, or letters that a digit follows soon.
_START = re.compile(r"(?<![0-9A-Za-z])(?<!\d\.)(?:\+?\d|[A-Z]{2}\d{2}|[A-Fa-f]{1,24}\d)")
_AT = [(k, re.compile(k.pattern)) for k in _DIGIT_KINDS]
_SOLID = frozenset(string.ascii_letters + string.digits)
_IN_NAME = _SOLID | frozenset("._%+-")
_HOST = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}(?![A-Za-z0-9])")


def _name_start(text: str, at: int) -> int:
    """Where the e-mail name before the @ at ``at`` starts; ``at`` if there is none."""
    if not at or text[at - 1] not in _SOLID:
        return at
    a = at
    while a and text[a - 1] in _IN_NAME:
        a -= 1
    while text[a] not in _SOLID:
        a += 1
    return a


def _ends(kind: Kind, pattern: re.Pattern, text: str, a: int, b: int) -> list[int]:
    """The ends to try for the match from a to b: the greatest rank first, then the longest."""
    if kind.rank is None:
        return [b]
    shorter = (e for e in range(b - 1, a, -1) if text[e] in " .-" and text[e - 1].isalnum() and pattern.fullmatch(text, a, e))
    ranked = [(r, e) for e in (b, *shorter) if (r := kind.rank(text, a, e)) is not None]
    return [e for _, e in sorted(ranked, reverse=True)]


class Pseudonyms:
    """Finds the values of a text and gives their pseudonyms under ``key``."""

    def __init__(self, key: bytes, back: bool = False):
        self.key, self.back = key, back
        self.changed = lru_cache(100_000)(self._changed)

    def _changed(self, kind: int, s: str) -> str | None:
        change = _email if kind < 0 else _DIGIT_KINDS[kind].change
        return change(s, self.key, self.back)

    def spans(self, text: str) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of each value, in order, without overlaps."""
        found = []
        at = text.find("@")
        while at >= 0:
            a, host = _name_start(text, at), _HOST.match(text, at + 1)
            if a < at and host:
                found.append((a, host.end(), "email", self.changed(-1, text[a : host.end()])))
            at = text.find("@", at + 1)
        taken, i = [(a, b) for a, b, _, _ in found], 0
        for m in _START.finditer(text):
            if m.start() < i or any(a <= m.start() < b for a, b in taken):
                continue
            for k, (kind, pattern) in enumerate(_AT):
                hit = pattern.match(text, m.start())
                ends = _ends(kind, pattern, text, m.start(), hit.end()) if hit else []
                end, new = next(((e, x) for e in ends if (x := self.changed(k, text[m.start() : e])) is not None), (0, None))
                if new is not None:
                    found.append((m.start(), end, kind.name, new))
                    i = end
                    break
        return sorted(found)

    def text(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it held."""
        spans = self.spans(text)
        if not spans:
            return text, {}
        out, at, n = [], 0, {}
        for a, b, kind, new in spans:
            if a < at:
                continue
            out += [text[at:a], new]
            n[kind] = n.get(kind, 0) + 1
            at = b
        return "".join([*out, text[at:]]), n


def _replace(batches: Iterator[pa.RecordBatch], key: bytes, back: bool) -> Iterator[pa.RecordBatch]:
    made = Pseudonyms(key, back)
    for batch in batches:
        for a, b in text_runs(batch.column("text")):
            part = batch.slice(a, b - a)
            texts, values = [], []
            for t in part.column("text").to_pylist():
                new, n = (None, {}) if t is None else made.text(t)
                texts.append(new)
                values.append(sorted(n.items()))
            columns = [pa.array(texts, pa.string()) if name == "text" else c for name, c in zip(part.schema.names, part.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(values, pa.map_(pa.string(), pa.int32()))], names=[*part.schema.names, "pii"])


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with the values of ``text`` replaced by their pseudonyms, and ``pii``, a map of kind to count.

    What fails validation stays as it is. A null text stays null and an empty one empty. ``back`` undoes the
    step under the same key. Other columns pass; a column ``pii`` is replaced. Each text is read whole.
    """
    rest = docs.drop("pii")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rest.schema)
    return rest.mapInArrow(lean(partial(_replace, key=key, back=back)), f"{schema}, pii map<string, int>")
