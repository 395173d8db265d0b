"""Format-preserving pseudonyms for personal data.

A value that passes its check (a Luhn or mod-97 sum, a real date, a valid
address) is permuted within the valid values of its format by a keyed Feistel
network: equal values get equal pseudonyms in all documents, different ones
stay different, and separators and check sums stay valid.  Lengths stay too,
but for numbers without leading zeros (parts of an address, months and days
of one digit), which may gain or lose digits.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import LongType, StructField, StructType

from .common import rows_of

ROUNDS = 10


class Feistel:
    """A keyed permutation of range(size), by a Feistel network over enough bits and walking its cycles back into the range."""

    def __init__(self, key: bytes, kind: str, size: int):
        self.size = size
        bits = max(2, (size - 1).bit_length())
        self.low = bits // 2
        self.high = bits - self.low
        self.mac = hmac.new(key, kind.encode() + b"/" + size.to_bytes(bits // 8 + 1, "big"), hashlib.sha256)

    def _once(self, x: int) -> int:
        a, b, wa, wb = x >> self.low, x & ((1 << self.low) - 1), self.high, self.low
        for r in range(ROUNDS):
            mac = self.mac.copy()
            mac.update(b"%d/%d" % (r, b))
            f = int.from_bytes(mac.digest() if wa <= 256 else hashlib.shake_256(mac.digest()).digest(wa // 8 + 1), "big")
            a, b, wa, wb = b, (a ^ f) & ((1 << wa) - 1), wb, wa
        return a << wb | b

    def __call__(self, x: int) -> int:
        x = self._once(x)
        while x >= self.size:
            x = self._once(x)
        return x


def luhn_digit(digits: str) -> str:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 - i % 2)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


#: First days of the ranges that dates are permuted in, and the day after the last.
DAYS = [datetime.date(y, 1, 1).toordinal() for y in (1, 1000, 1900, 2100)] + [datetime.date.max.toordinal() + 1]
#: Characters of a mixed value that are permuted at once.
BLOCK = 64


def issued(digits: str) -> bool:
    """Whether card numbers of this length begin so (fixed values: issuer ranges)."""
    two, three, four = int(digits[:2]), int(digits[:3]), int(digits[:4])
    n = len(digits)
    return (
        n in (13, 16, 19) and digits[0] == "4"
        or n == 16 and (51 <= two <= 55 or 2221 <= four <= 2720)
        or n == 15 and two in (34, 37)
        or 14 <= n and (two in (36, 38, 39) or 300 <= three <= 305)
        or 16 <= n and (two in (62, 65) or 644 <= three <= 649 or four == 6011 or 3528 <= four <= 3589)
        or two in (50, 56, 57, 58, 63, 67)
    )


def assigned(d: str) -> bool:
    """Whether a social security number can be one."""
    return not (d[:3] in ("000", "666") or d[0] == "9" or d[3:5] == "00" or d[5:] == "0000")


#: Characters of an IBAN by country.
IBAN_LENGTH = {
    c: n
    for n, names in {
        15: "NO", 16: "BE", 18: "DK FI FO GL NL", 19: "MK SI", 20: "AT BA EE KZ LT LU XK", 21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU", 31: "MT SC", 32: "LC",
    }.items()
    for c in names.split()
}


class Masker:
    """Replaces personal data in texts with one key."""

    def __init__(self, key: bytes):
        self.key = key
        self.rules: list[tuple[str, re.Pattern, Callable[[re.Match], str | None]]] = [
            ("email", re.compile(r"(?<![\w.+%-])[A-Za-z0-9_%+-][\w.%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])"), self._email),
            ("iban", re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}(?![A-Za-z0-9])"), self._iban),
            ("secret", re.compile(r"(?i)(?<![a-z])(?:api[_-]?key|access[_-]?key|token|secret|password|passwd)(\s{0,3}[=:]\s{0,3}[\"']?)([A-Za-z0-9_+/.-]{8,})"), self._secret),
            ("date", re.compile(r"(?<![\d./-])(?:([0-9]{4})([-/.])([0-9]{1,2})\2([0-9]{1,2})|([0-9]{1,2})([-/.])([0-9]{1,2})\6([0-9]{4}))(?![\d/-]|\.\d)"), self._date),
            ("ip", re.compile(r"(?<![\d.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?!\.?\d)"), self._ip),
            ("ssn", re.compile(r"(?<![\d-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\d-])"), self._ssn),
            ("phone", re.compile(r"(?<![\w+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{2,4}[ .-][0-9]{3,4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ .-]?[0-9]){7,13}(?!\w)|(?<![\w+.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![\w-])"), self._phone),
            ("card", re.compile(r"(?<![\w-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])"), self._card),
        ]

    @lru_cache(maxsize=4096)  # noqa: B019 a masker lives as long as its process
    def _cipher(self, kind: str, size: int) -> Feistel:
        return Feistel(self.key, kind, size)

    def _digits(self, kind: str, digits: str, ok: Callable[[str], bool] = lambda d: True) -> str:
        """A permutation of the digit strings that are ok: of all, walking on from those that are not."""
        cipher = self._cipher(kind, 10 ** len(digits))
        while True:
            digits = f"{cipher(int(digits)):0{len(digits)}d}"
            if ok(digits):
                return digits

    def _mixed(self, kind: str, text: str) -> str:
        """Each digit stays a digit and each letter a letter of its case.  Blocks are numbers of mixed radix; the permutation of one depends on all before it."""
        shape = "".join("d" if "0" <= c <= "9" else "l" if c.isascii() and c.isalpha() else "." for c in text)
        out, before = [], hashlib.sha256()
        for at in range(0, len(text), BLOCK):
            part, form = text[at : at + BLOCK], shape[at : at + BLOCK]
            if len(text) <= BLOCK:
                out.append(self._block(lambda size: self._cipher(kind + form, size), part, form))  # noqa: B023
            else:
                name = f"{kind}{shape if len(shape) <= 256 else hashlib.sha256(shape.encode()).hexdigest()}/{at}/{before.hexdigest()}"
                out.append(self._block(lambda size: Feistel(self.key, name, size), part, form))  # noqa: B023
                before.update(part.encode())
        return "".join(out)

    @staticmethod
    def _block(cipher: Callable[[int], Feistel], text: str, form: str) -> str:
        value, size = 0, 1
        for c, f in zip(text, form, strict=True):
            if f != ".":
                r = 10 if f == "d" else 26
                value, size = value * r + (int(c) if f == "d" else ord(c.lower()) - 97), size * r
        if size == 1:
            return text
        value, out = cipher(size)(value), []
        for c, f in zip(reversed(text), reversed(form), strict=True):
            if f == ".":
                out.append(c)
                continue
            value, d = divmod(value, 10 if f == "d" else 26)
            out.append(str(d) if f == "d" else chr(d + (65 if c.isupper() else 97)))
        return "".join(reversed(out))

    @staticmethod
    def _fill(shape: str, digits: str) -> str:
        it = iter(digits)
        return "".join(next(it) if c.isdigit() else c for c in shape)

    def _email(self, m: re.Match) -> str:
        body, top = m[0].rsplit(".", 1)
        return f"{self._mixed('email', body)}.{top}"

    def _iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        number = lambda s: int("".join(str(int(c, 36)) for c in s)) % 97
        if not 15 <= len(plain) <= 34 or number(plain[4:] + plain[:4]) != 1:
            return None
        body = self._mixed("iban", plain[4:])
        new = plain[:2] + f"{98 - number(body + plain[:2] + '00'):02d}" + body
        it = iter(new)
        return "".join(" " if c == " " else next(it) for c in m[0])

    def _secret(self, m: re.Match) -> str:
        return m[0][: m.start(2) - m.start()] + self._mixed("secret", m[2])

    def _date(self, m: re.Match) -> str | None:
        if m[1]:
            shape, y, a, b = m[2], int(m[1]), int(m[3]), int(m[4])
            orders = [(a, b)]
        else:
            shape, y, a, b = m[6], int(m[8]), int(m[5]), int(m[7])
            orders = [(b, a), (a, b)]  # day first, else month first
        for month, day in orders:
            try:
                at = datetime.date(y, month, day).toordinal()
            except ValueError:
                continue
            first, end = next((a, b) for a, b in zip(DAYS, DAYS[1:], strict=False) if a <= at < b)
            new = datetime.date.fromordinal(first + self._cipher("date", end - first)(at - first))
            if m[1]:
                return f"{new.year:04d}{shape}{new.month:0{min(2, len(m[3]))}d}{shape}{new.day:0{min(2, len(m[4]))}d}"
            x, z = (new.day, new.month) if (month, day) == (b, a) else (new.month, new.day)
            return f"{x:0{min(2, len(m[5]))}d}{shape}{z:0{min(2, len(m[7]))}d}{shape}{new.year:04d}"
        return None

    def _ip(self, m: re.Match) -> str | None:
        parts = [int(p) for p in m[0].split(".")]
        if max(parts) > 255:
            return None
        new = self._cipher("ip", 1 << 32)(int.from_bytes(bytes(parts), "big"))
        return ".".join(map(str, new.to_bytes(4, "big")))

    def _ssn(self, m: re.Match) -> str | None:
        d = m[0].replace("-", "")
        return self._fill(m[0], self._digits("ssn", d, assigned)) if assigned(d) else None

    def _phone(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m[0])
        if not 8 <= len(d) <= 15:
            return None
        lead = len(re.match(r"\+(\d*)", m[0])[1]) if re.match(r"\+\d{1,3}[ .(-]", m[0]) else 1 if m[0][0] == "+" else 0
        return self._fill(m[0], d[:lead] + self._digits("phone", d[lead:]))

    def _card(self, m: re.Match) -> str | None:
        d = re.sub(r"\D", "", m[0])
        if luhn_digit(d[:-1]) != d[-1] or not issued(d):
            return None
        body = self._digits("card", d[:-1], lambda b: issued(b + "0"))
        return self._fill(m[0], body + luhn_digit(body))

    @staticmethod
    def _values(kind: str, pattern: re.Pattern, m: re.Match) -> Iterator[re.Match]:
        """The match, and for kinds with a check sum the shorter ones that end at a separator inside of it: neighbours may have joined it."""
        yield m
        if kind in ("card", "iban"):
            ends = [x.start() for x in re.finditer("[ -]", m[0])][::-1]
            if kind == "iban":
                ends.sort(key=lambda e: len(m[0][:e].replace(" ", "")) != IBAN_LENGTH.get(m[0][:2]))
            yield from filter(None, (pattern.fullmatch(m.string, m.start(), m.start() + e) for e in ends))

    def mask(self, text: str) -> tuple[str, dict[str, int]]:
        """The text with pseudonyms, and how many values of each kind it held.  Each place is replaced once, by the first rule that takes it."""
        found: list[tuple[int, int, str, str]] = []
        taken: list[tuple[int, int]] = []  # sorted and disjoint

        def free(m: re.Match) -> bool:
            at = bisect_left(taken, (m.end(), 0))
            return not at or taken[at - 1][1] <= m.start()

        has_digit = any(c in text for c in "0123456789")
        for kind, pattern, make in self.rules:
            if kind == "email" and "@" not in text or kind not in ("email", "secret") and not has_digit:
                continue
            spans, at = [], 0
            while whole := pattern.search(text, at):
                at = whole.end()
                for m in self._values(kind, pattern, whole):
                    if not free(m):
                        continue
                    new = make(m)
                    if new is not None:
                        spans.append(m.span())
                        found.append((*m.span(), kind, new))
                        at = m.end()
                        break
                else:  # a value may begin after the first group
                    if kind in ("card", "iban"):
                        at = whole.start() + len(re.match("[^ -]+", whole[0])[0])
            taken = sorted(taken + spans)
        if not found:
            return text, {}
        found.sort()
        out, at, n = [], 0, {}
        for a, b, kind, new in found:
            out += [text[at:a], new]
            at = b
            n[kind] = n.get(kind, 0) + 1
        return "".join([*out, text[at:]]), n


@lru_cache(maxsize=4)
def masker(key: bytes) -> Masker:
    return Masker(key)


KINDS = ["email", "iban", "secret", "date", "ip", "ssn", "phone", "card"]
#: The key of tests and of the registered query; a real run sets its own, as KEY_CONF or as an argument.
KEY, KEY_CONF = b"public test key", "spark.skyframe.pii.key"


def pseudonymise(docs: DataFrame, key: bytes | None = None, text_col: str = "text") -> DataFrame:
    """docs with pseudonyms in the text, and n_<kind> (long) for each kind of personal data found in it.

    key: by default the session's setting KEY_CONF, and where that is unset the
    published KEY, with which anyone can undo the pseudonyms.  A null text stays null and holds none; columns named n_<kind> are replaced,
    other columns and all rows are kept; the whole text is searched.
    """
    key = key or docs.sparkSession.conf.get(KEY_CONF, KEY.decode()).encode()
    names = [f"n_{k}" for k in KINDS]
    rest = [c for c in docs.columns if c not in names]
    df = docs.select(*rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = masker(key)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                k = part.schema.get_field_index(text_col)
                done = [(None, {}) if t is None else m.mask(t) for t in part.column(k).to_pylist()]
                cols = [pa.array([d[0] for d in done], part.schema.field(k).type) if i == k else part.column(i) for i in range(part.num_columns)]
                cols += [pa.array([d[1].get(kind, 0) for d in done], pa.int64()) for kind in KINDS]
                yield pa.RecordBatch.from_arrays(cols, names=[*part.schema.names, *names])

    return df.mapInArrow(run, StructType([*df.schema.fields, *(StructField(n, LongType()) for n in names)]))
