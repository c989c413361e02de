"""Format-preserving pseudonyms for personal data.

What validates as a card number (Luhn), IBAN (mod 97), social security number, phone number,
IPv4 address, e-mail address, calendar date or labelled secret is replaced by a value of the
same format: a keyed Feistel network permutes the values of that format among themselves
(walking on until the result validates too), so the same value has the same pseudonym in
every document and different values keep different ones. Whoever has the key can invert it.
Separators, lengths, letter case and e-mail domains stay; check digits are computed anew.

Each document is handled by itself; nothing is shuffled.

Cases: null text stays null and empty stays empty, with no finds; what does not validate is
left alone; digits beside a phone number belong to it, and leave it alone, only where it has no
+ and the separator between is its own (988-555-2485-17), but for lists of numbers of one shape;
labelled values without a digit are secrets after =, in quotes or in mixed case; where formats overlap the first kind in KINDS wins, then the leftmost; repeated
rows give the same result; null doc_id is passed on; an empty table gives an empty result;
the other columns of the input are passed on, but for its own columns of the names n_found
and kinds, which the result's replace.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from datetime import date
from hashlib import blake2b
from math import prod

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1).toordinal(), date(2099, 12, 31).toordinal()
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the formats, in order of preference.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}(?![\w-])",
    "secret": r"(?i:(?<![a-z])(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\s{0,3}[=:]\s{0,3}[\"']?)[A-Za-z0-9_/+-][A-Za-z0-9_/+=.-]{10,}[A-Za-z0-9_/+=-]|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv4": r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])",
    "date": r"(?<![0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9]|[./-][0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){2,3}(?:[ -][0-9]{1,3})?|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?:(?<![0-9])\+[0-9]{1,3}[ .-]?|(?<![A-Za-z0-9]))(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9])\+[0-9]{10,14}(?![0-9])",
}


LABEL = re.compile(r"(?i:[a-z_-]+)\s{0,3}[=:]\s{0,3}[\"']?")
#: Characters of a secret that are permuted together; the next ones depend on all before.
PIECE = 128
#: How far the numbers beside a phone number are looked at.
RUN = 1000


class Feistel:
    """A keyed permutation of the mixed-radix numbers with given radices."""

    def __init__(self, key: bytes) -> None:
        self.key = key

    def _round(self, i: int, tweak: bytes, half: int, modulus: int) -> int:
        size = (modulus.bit_length() + 7) // 8 + 8
        out = b""
        for block in range(-(-size // 64)):
            out += blake2b(b"%d|%d|%b|%d" % (i, block, tweak, half), key=self.key).digest()
        return int.from_bytes(out[:size], "big") % modulus

    def permute(self, digits: list[int], radices: list[int], tweak: bytes, back: bool = False) -> list[int]:
        cut = len(digits) // 2
        if not digits:
            return []
        sizes = prod(radices[:cut]), prod(radices[cut:])
        halves = [_number(digits[:cut], radices[:cut]), _number(digits[cut:], radices[cut:])]
        for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
            one, other = i % 2, 1 - i % 2
            move = self._round(i, tweak, halves[other], sizes[one])
            halves[one] = (halves[one] + (-move if back else move)) % sizes[one]
        return _digits(halves[0], radices[:cut]) + _digits(halves[1], radices[cut:])

    def walk(self, digits: list[int], radices: list[int], tweak: bytes, valid: Callable[[list[int]], bool], back: bool = False) -> list[int]:
        """Permutes the valid numbers among themselves."""
        out = self.permute(digits, radices, tweak, back)
        while not valid(out):
            out = self.permute(out, radices, tweak, back)
        return out


def _number(digits: list[int], radices: list[int]) -> int:
    n = 0
    for d, r in zip(digits, radices):
        n = n * r + d
    return n


def _digits(n: int, radices: list[int]) -> list[int]:
    out = []
    for r in reversed(radices):
        n, d = divmod(n, r)
        out.append(d)
    return out[::-1]


def luhn(digits: list[int]) -> bool:
    doubled = [sum(divmod(2 * d, 10)) for d in digits[-2::-2]]
    return (sum(digits[-1::-2]) + sum(doubled)) % 10 == 0


def _refill(shape: str, digits: list[int]) -> str:
    left = iter(digits)
    return "".join(str(next(left)) if c in "0123456789" else c for c in shape)


def _own_digits(shape: str) -> list[int]:
    return [int(c) for c in shape if c in "0123456789"]


def _alnum(f: Feistel, text: str, tweak: bytes, back: bool) -> str:
    """Permutes letters among letters (keeping their case) and digits among digits, at the same places."""
    at = [i for i, c in enumerate(text) if c.isascii() and c.isalnum()]
    radices = [10 if text[i].isdigit() else 26 for i in at]
    old = [int(text[i]) if text[i].isdigit() else LETTERS.index(text[i].lower()) for i in at]
    shape = bytes(r for r in radices)
    chars = list(text)
    for i, r, d in zip(at, radices, f.permute(old, radices, tweak + shape, back)):
        chars[i] = str(d) if r == 10 else LETTERS[d].upper() if text[i].isupper() else LETTERS[d]
    return "".join(chars)


def _card(f: Feistel, x: str, back: bool) -> str | None:
    digits = _own_digits(x)
    if not luhn(digits) or len(set(digits)) == 1:
        return None
    same = lambda d: len({*d, _check(d)}) > 1
    new = f.walk(digits[:-1], [10] * (len(digits) - 1), b"card", same, back)
    return _refill(x, [*new, _check(new)])


def _check(digits: list[int]) -> int:
    return next(c for c in range(10) if luhn([*digits, c]))


def _iban_rest(x: str) -> int:
    return int("".join(str(int(c, 36)) for c in x[4:] + x[:4])) % 97


def _iban(f: Feistel, x: str, back: bool) -> str | None:
    plain = x.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _iban_rest(plain) != 1:
        return None
    body = _alnum(f, plain[4:], b"iban" + plain[:2].encode(), back)
    left = iter(f"{plain[:2]}{98 - _iban_rest(plain[:2] + '00' + body):02d}{body}")
    return "".join(c if c == " " else next(left) for c in x)


def _ipv4(f: Feistel, x: str, back: bool) -> str | None:
    parts = x.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    return ".".join(map(str, f.permute([int(p) for p in parts], [256] * 4, b"ipv4", back)))


def _ssn_valid(d: list[int]) -> bool:
    area = d[0] * 100 + d[1] * 10 + d[2]
    return 0 < area < 900 and area != 666 and any(d[3:5]) and any(d[5:])


def _ssn(f: Feistel, x: str, back: bool) -> str | None:
    digits = _own_digits(x)
    return _refill(x, f.walk(digits, [10] * 9, b"ssn", _ssn_valid, back)) if _ssn_valid(digits) else None


def _date(f: Feistel, x: str, back: bool) -> str | None:
    sep = x[4] if x[4] in "-/" else x[2]
    a, b, c = map(int, x.split(sep))
    order = "ymd" if x[4] in "-/" else "dmy" if sep == "." or a > 12 else "mdy"
    y, m, d = (a, b, c) if order == "ymd" else (c, b, a) if order == "dmy" else (c, a, b)
    try:
        n = date(y, m, d).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= n <= LAST_DAY:
        return None
    # 24/12/2020 cannot be read month first: the days of one reading are permuted among themselves
    fits = lambda v: FIRST_DAY + _number(v, [512, 512]) <= LAST_DAY and (order != "dmy" or sep == "." or date.fromordinal(FIRST_DAY + _number(v, [512, 512])).day > 12)
    new = date.fromordinal(FIRST_DAY + _number(f.walk(_digits(n - FIRST_DAY, [512, 512]), [512, 512], b"date" + (b"dm/" if order == "dmy" and sep == "/" else b""), fits, back), [512, 512]))
    y, m, d = f"{new.year:04d}", f"{new.month:02d}", f"{new.day:02d}"
    return sep.join((y, m, d) if order == "ymd" else (d, m, y) if order == "dmy" else (m, d, y))


def _phone_parts(x: str) -> tuple[int, list[int]]:
    """(digits of the country code, all digits)."""
    code = re.match(r"\+([0-9]{1,3})(?=[ .(-])", x)
    return (len(code[1]) if code else 2 if x[0] == "+" else 0), _own_digits(x)


def _phone(f: Feistel, x: str, back: bool) -> str | None:
    skip, digits = _phone_parts(x)
    own = digits[skip:]
    if not 10 <= len(digits) <= 15 or len(own) < 7 or own[0] < 1:
        return None
    new = f.walk(own, [10] * len(own), b"phone" + bytes(digits[:skip]), lambda d: d[0] >= 1, back)
    return _refill(x, digits[:skip] + new)


def _phone_stands(text: str, start: int, end: int) -> bool:
    """Whether what is found as a phone number is no part of a longer number."""
    x = text[start:end]
    if x[0] == "+":
        return True
    before, after = re.search(r"[0-9][ .-]$", text[max(0, start - 2) : start]), re.match(r"[ .-][0-9]", text[end : end + 2])
    if not before and not after:
        return True
    seps = re.findall("[ .-]", x)
    longer = seps and (before and x[0] != "(" and before.group()[1] == seps[0] or after and after.group()[0] == seps[-1])
    if not longer:
        return True
    if set(seps) != {" "}:
        return False
    # numbers of one shape in a row, each of groups parted by spaces
    left, right = re.search(r"[0-9 ]*$", text[max(0, start - RUN) : start]), re.match(r"[0-9 ]*", text[end : end + RUN])
    shape = [len(g) for g in x.split(" ")]
    sides = [[len(g) for g in side.group().split()] for side in (left, right)]
    return len(set(shape)) > 1 and all(len(side) % len(shape) == 0 and side == shape * (len(side) // len(shape)) for side in sides)


def _email(f: Feistel, x: str, back: bool) -> str | None:
    local, _, domain = x.rpartition("@")
    return f"{_alnum(f, local, b'email' + domain.lower().encode(), back)}@{domain}"


def _secret(f: Feistel, x: str, back: bool) -> str | None:
    if x[:4] in ("AKIA", "ASIA"):  # access keys say what they are
        return x[:4] + _alnum(f, x[4:], b"access key" + x[:4].encode(), back)
    at = LABEL.match(x).end()
    value, label = x[at:], x[:at]
    if not any(c.isdigit() for c in value) and "=" not in label and label[-1] not in "\"'" and not re.search("[a-z][A-Z]", value):
        return None  # a word, not a secret
    hexadecimal = re.fullmatch("[0-9a-f]+", value) is not None
    before, out = blake2b(), []
    for k in range(0, len(value), PIECE):
        piece, tweak = value[k : k + PIECE], before.digest() if k else b""
        if hexadecimal:
            new = "".join(f"{d:x}" for d in f.permute([int(c, 16) for c in piece], [16] * len(piece), b"hex" + tweak, back))
        else:
            new = _alnum(f, piece, b"secret" + tweak, back)
        before.update((new if back else piece).encode())
        out.append(new)
    return label + "".join(out)


_MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "ipv4": _ipv4, "date": _date, "ssn": _ssn, "card": _card, "phone": _phone}


class Pseudonyms:
    def __init__(self, key: bytes) -> None:
        self.f = Feistel(key)
        self.patterns = {k: re.compile(p) for k, p in KINDS.items()}
        self.digit = re.compile("[0-9]|AKIA|ASIA|(?i:passw|pwd|secret|token|key)")

    def replace(self, text: str, back: bool = False) -> tuple[str, dict[str, int]]:
        """(text with pseudonyms, finds by kind). back: from pseudonyms to what they stand for."""
        if "@" not in text and not self.digit.search(text):
            return text, {}
        taken: list[tuple[int, int, str, str]] = []
        for kind, pattern in self.patterns.items():
            if kind == "email" and "@" not in text:
                continue
            at = 0
            while m := pattern.search(text, at):
                new = _MAKERS[kind](self.f, m.group(), back)
                if new is not None and (kind != "phone" or _phone_stands(text, *m.span())):
                    taken.append((m.start(), m.end(), new, kind))
                    at = m.end()
                else:  # a phone number may begin inside of what is none
                    at = m.start() + 1 if kind == "phone" else m.end()
        if not taken:
            return text, {}
        free = bytearray(len(text))
        chosen = []
        for start, end, new, kind in taken:  # in order of kinds
            if not any(free[start:end]):
                free[start:end] = b"\x01" * (end - start)
                chosen.append((start, end, new, kind))
        out, at, counts = [], 0, {}
        for start, end, new, kind in sorted(chosen):
            out += text[at:start], new
            at = end
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*out, text[at:]]), counts


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """docs with text replaced, and n_found (long) and kinds (map of finds by kind)."""
    columns = [c for c in docs.columns if c not in ("n_found", "kinds")]
    schema = T.StructType([*(docs.schema[c] for c in columns), T.StructField("n_found", T.LongType()), T.StructField("kinds", T.MapType(T.StringType(), T.LongType()))])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = Pseudonyms(key)
        for b in batches:
            texts, counts = [], []
            for t in b.column("text").to_pylist():
                new, found = (None, {}) if t is None else names.replace(t, back)
                texts.append(new)
                counts.append(found)
            cols = [pa.array(texts, pa.string()) if c == "text" else b.column(c) for c in columns]
            yield pa.record_batch([*cols, pa.array([sum(c.values()) for c in counts], pa.int64()), pa.array([list(c.items()) for c in counts], pa.map_(pa.string(), pa.int64()))], [*columns, "n_found", "kinds"])

    return docs.select(*[F.col(f"`{c}`") for c in columns]).mapInArrow(run, schema)
