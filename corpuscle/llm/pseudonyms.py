"""Personal data: format-preserving pseudonyms by a keyed Feistel network.

Numbers and dates that pass their own validation (check digits, ranges, the calendar) are permuted within their format:
a card number becomes another with a right check digit, a date another date written the same way. Each kind is
permuted under the one key, so equal values are replaced by equal ones in all documents, different ones by different.
"""

from __future__ import annotations

import datetime
import hashlib
import hmac
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpuscle.llm.kernels import blocks, texts
from corpuscle.plans.runtime import ship

ROUNDS = 10


def permute(value: int, size: int, key: bytes, kind: str) -> int:
    """The image of value under a keyed permutation of 0..size-1: a Feistel network over a*b >= size, walked until below it.

    Halves are numbers modulo a and b in turn, so that any size will do; round values are HMAC-SHA256 of the kind, size,
    round and half.
    """
    if size <= 1:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    head = f"{kind}:{size}:".encode()
    while True:
        x, y = divmod(value, b)
        for r in range(ROUNDS):
            digest = hmac.digest(key, head + b"%d:%d" % (r, y if r % 2 == 0 else x), "sha256")
            f = int.from_bytes(digest[:16], "big")
            if r % 2 == 0:
                x = (x + f) % a
            else:
                y = (y + f) % b
        value = x * b + y
        if value < size:
            return value


def _luhn(digits: str) -> int:
    """The check digit that follows digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def _refill(like: str, digits: str) -> str:
    """like with its digits replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in like)


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def card(s: str, key: bytes) -> str | None:
    d = _digits(s)
    if not 13 <= len(d) <= 19 or len(set(d)) == 1 or _luhn(d[:-1]) != int(d[-1]):
        return None
    body = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, "card")).zfill(len(d) - 1)
    return _refill(s, body + str(_luhn(body)))


#: Country codes of the E.164 plan that are shorter than three digits.
_CODE = re.compile(r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}")


def phone(s: str, key: bytes) -> str | None:
    """The country code, and a 0 before the area, stay; the other digits are permuted, a first one of 0 stays 0.

    A number's digits after those are the same in each layout, and so are its pseudonym's.
    """
    wide = re.match(r"\+|00(?=[1-9])", s)
    if wide:
        if not 8 <= len(_digits(s[wide.end() :])) <= 15:
            return None
        code = re.compile(r"\d{1,3}(?=[ .(/-])").match(s, wide.end()) or _CODE.match(s, wide.end())
        if code is None:
            return None
        head = re.compile(r"[ .-]?\(0\)").match(s, code.end()) or code
    else:
        if not 7 <= len(_digits(s)) <= 12:
            return None
        head = re.match(r"\(?0(?=[1-9])", s)
    end = head.end() if head else 0
    d = _digits(s[end:])
    size = 10 ** (len(d) - 1)
    new = str(permute(int(d), size, key, "phone")).zfill(len(d)) if d[0] == "0" else str(size + permute(int(d) - size, 9 * size, key, "phone"))
    return s[:end] + _refill(s[end:], new)


def address(s: str, key: bytes) -> str | None:
    parts = [int(p) for p in s.split(".")]
    if max(parts) > 255:
        return None
    value = 0
    for p in parts:
        value = value * 256 + p
    value = permute(value, 1 << 32, key, "ip")
    return ".".join(str(value >> s_ & 255) for s_ in (24, 16, 8, 0))


def social(s: str, key: bytes) -> str | None:
    """United States: area 001-899 without 666, group 01-99, serial 0001-9999."""
    a, b, c = (int(p) for p in s.split("-"))
    if not 1 <= a <= 899 or a == 666 or not b or not c:
        return None
    index = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    rest, c = divmod(permute(index, 898 * 99 * 9999, key, "ssn"), 9999)
    a, b = divmod(rest, 99)
    a = a + 1 + (a + 1 >= 666)
    return f"{a:03d}-{b + 1:02d}-{c + 1:04d}"


def _mod97(s: str) -> int:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def iban(s: str, key: bytes) -> str | None:
    """Digits of the account are permuted and the check digits set anew; country and letters stay."""
    plain = s.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    d = _digits(plain[4:])
    body = _refill(plain[4:], str(permute(int(d), 10 ** len(d), key, "iban")).zfill(len(d))) if d else plain[4:]
    check = 98 - _mod97(plain[:2] + "00" + body)
    it = iter(plain[:2] + f"{check:02d}" + body)
    return "".join(c if c == " " else next(it) for c in s)


_EPOCH = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _EPOCH
#: Years of two digits.
_SHORT = datetime.date(1950, 1, 1).toordinal(), datetime.date(2050, 1, 1).toordinal()


def date(s: str, key: bytes) -> str | None:
    """Dates from 1900 to 2099: year first, else day first where that is a date, else month first. They keep their form.

    Years of two digits are of 1950 to 2049, and permuted apart.
    """
    parts = re.findall(r"\d+", s)
    short = max(map(len, parts)) == 2
    start, stop = _SHORT if short else (_EPOCH, _EPOCH + _DAYS)
    if len(parts[0]) == 4:
        forms = [(0, 1, 2)]
    else:
        forms = [(2, 1, 0), (2, 0, 1)]
    for y, m, d in forms:
        try:
            year = int(parts[y]) + (1900 if int(parts[y]) >= 50 else 2000) * short
            day = datetime.date(year, int(parts[m]), int(parts[d])).toordinal() - start
        except ValueError:
            continue
        if not 0 <= day < stop - start:
            continue
        new = datetime.date.fromordinal(permute(day, stop - start, key, "date") + start)
        values = {y: str(new.year)[2 * short :], m: f"{new.month:02d}", d: f"{new.day:02d}"}
        it = iter(values[k] for k in range(3))
        return re.sub(r"\d+", lambda _: next(it), s)
    return None


def email(s: str, key: bytes) -> str | None:
    """Letters and digits before the @ are permuted, each within its kind; the domain stays. Case doesn't distinguish."""
    local, _, domain = s.rpartition("@")
    kinds = [("0123456789", [c for c in local if c in "0123456789"]), ("abcdefghijklmnopqrstuvwxyz", [c for c in local.lower() if "a" <= c <= "z"])]
    size, value = 1, 0
    for alphabet, chars in kinds:
        for c in chars:
            size, value = size * len(alphabet), value * len(alphabet) + alphabet.index(c)
    if size == 1:
        return None
    value = permute(value, size, key, "email:" + re.sub("[a-z]", "a", re.sub("[0-9]", "0", local.lower())) + "@" + domain.lower())
    out: list[list[str]] = []
    for alphabet, chars in reversed(kinds):
        own = []
        for _ in chars:
            value, k = divmod(value, len(alphabet))
            own.append(alphabet[k])
        out.append(own[::-1])
    letters, digits = iter(out[0]), iter(out[1])
    new = "".join(next(digits) if c in "0123456789" else next(letters) if "a" <= c.lower() <= "z" else c for c in local)
    return new + "@" + domain


_EDGE = r"(?<![\w.+-])"
#: In this order at each place; the first that validates counts.
KINDS = [
    ("email", email, r"[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    ("iban", iban, r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("date", date, r"(?:\d{4}([-/.])\d{1,2}\1\d{1,2}(?=T\d)|(?:\d{4}([-/.])\d{1,2}\2\d{1,2}|\d{1,2}([-/.])\d{1,2}\3\d{4})(?![\w-])|\d{2}([-/.])\d{2}\4\d{2}(?![\w-]|[./]\d))"),
    ("ip", address, r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\w|\.\d)"),
    ("ssn", social, r"\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", card, r"\d(?:[ -]?\d){12,18}(?![\w-])"),
    (
        "phone",
        phone,
        r"(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\w)"
        r"|\+\d{1,3}[ .-]?\(\d{1,5}\)(?:[ ./-]?\d){4,13}(?!\w)|(?:\+|00(?=[1-9]))\d(?:[ ./-]?\d){7,14}(?!\w)"
        r"|0[1-9](?P<by>[ .-])\d{2}(?:(?P=by)\d{2}){3}(?!\w)|\d{3}[ .-]\d{3}[ .-]\d{4}(?!\w)|\(?0[1-9](?:\)?[ ./-]?\d){7,10}(?!\w)",
    ),
]
_DIGIT = re.compile(r"\d")
_PATTERNS = [(name, f, re.compile(p)) for name, f, p in KINDS]
_NUMBER = re.compile(r"(?<![\w.+-])(?=[\d+(]|[A-Z]{2}\d{2})")
_MAIL = re.compile(_EDGE + KINDS[0][2])


class Pseudonymiser:
    """Replaces personal data in texts; results of values are kept for the next occurrence."""

    MEMO = 100_000

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()
        self.memo: dict[tuple[str, str], str | None] = {}

    def _new(self, kind: str, f, value: str) -> str | None:
        at = (kind, value)
        if at not in self.memo:
            if len(self.memo) >= self.MEMO:
                self.memo.clear()
            self.memo[at] = f(value, self.key)
        return self.memo[at]

    def _spans(self, text: str) -> Iterator[tuple[int, int, str, str]]:
        end = 0
        for m in _NUMBER.finditer(text):
            at = m.start()
            if at < end:
                continue
            for kind, f, pattern in _PATTERNS[1:]:
                if (found := pattern.match(text, at)) and (new := self._new(kind, f, found.group())) is not None:
                    end = found.end()
                    yield at, end, kind, new
                    break

    def replace(self, text: str | None) -> tuple[str | None, dict[str, int]]:
        """The text with pseudonyms, and how many of each kind."""
        counts: dict[str, int] = {}
        if not text:
            return text, counts
        spans: list[tuple[int, int, str, str]] = []
        if "@" in text:
            for m in _MAIL.finditer(text):
                if (new := self._new("email", email, m.group())) is not None:
                    spans.append((m.start(), m.end(), "email", new))
        if _DIGIT.search(text):
            mails = list(spans)
            spans += [s for s in self._spans(text) if not any(a < s[1] and s[0] < b for a, b, _, _ in mails)]
        if not spans:
            return text, counts
        pieces, at = [], 0
        for a, b, kind, new in sorted(spans):
            pieces += [text[at:a], new]
            at = b
            counts[kind] = counts.get(kind, 0) + 1
        return "".join([*pieces, text[at:]]), counts


def _apply(key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Pseudonymiser(key)
        for batch in batches:
            column = texts(batch)
            place = batch.schema.get_field_index("text")
            for a, b in blocks(column):
                part = column.slice(a, b - a)
                new, counts = zip(*map(own.replace, part.to_pylist()))
                n = np.array([sum(c.values()) for c in counts], np.int64)
                kinds = pa.array([",".join(f"{k}:{c[k]}" for k in sorted(c)) for c in counts], pa.string())
                rest = batch.slice(a, b - a)
                arrays = [pa.array(new, pa.string()) if k == place else rest.column(k) for k in range(rest.num_columns)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(n), kinds], names=[*rest.schema.names, "__replaced", "__kinds"])

    return run


def pseudonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """All rows and columns of docs (with text: STRING), personal data in text replaced, __replaced (number) and __kinds.

    key is the caller's secret: who has it can undo the permutations, and only runs with the same key give the same pseudonyms.
    __kinds lists kinds and numbers, as card:1,phone:2. Replaced are e-mail addresses (before the @), IBANs, dates of
    1900-2099, IPv4 addresses, US social security numbers, payment cards and phone numbers, each if it validates; digits within words
    or longer numbers are left alone. Phone numbers are those with + or 00 (8 to 15 digits in any groups), with a 0 before the
    area (9 to 12 digits), with the area in brackets, and of 3, 3 and 4 digits. Not covered: other numbers without + or 0
    (Spanish 612 345 678), dates with names of months, and years of two digits beside days or months of one digit. Years of
    two digits aren't linked to those of four. What is before an @ has 64 characters at most, as in the standard; a longer run is no address.
    Where kinds overlap, an address of mail goes first, then the first place, and there the order of KINDS. A null text stays null; a null
    doc_id, empty texts and tables, and repeated rows, are fine. Columns of docs that are called __replaced or __kinds are replaced.
    """
    from pyspark.sql.types import LongType, StringType, StructType

    ship(docs.sparkSession)
    docs = docs.drop("__replaced", "__kinds")
    schema = StructType([*docs.schema.fields]).add("__replaced", LongType()).add("__kinds", StringType())
    return docs.mapInArrow(_apply(key), schema)


def pseudonymised(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, n_replaced, kinds) for each row of docs; see pseudonymise()."""
    out = pseudonymise(docs.select("doc_id", F.col("text").cast("string").alias("text")), key)
    return out.select("doc_id", "text", F.col("__replaced").alias("n_replaced"), F.col("__kinds").alias("kinds"))
