"""Personal data: format-preserving pseudonyms from a keyed Feistel permutation."""

from __future__ import annotations

import datetime as dt
import ipaddress
import math
import re
from collections.abc import Callable
from functools import cache
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.llm.tools import table, texts_of

ROUNDS = 8
# pseudonyms a worker remembers; values repeat across documents
MEMORY = 200_000
FIRST_DAY, LAST_DAY = dt.date(1900, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()

#: fixed values: what looks like personal data or a secret, strongest first
EMAIL = re.compile(r"(?<![\w.+%-])[\w.+%-]{1,64}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){0,5}\.[A-Za-z]{2,24}(?![\w-])")
CLOUD_KEY = re.compile(r"(?<![A-Za-z0-9])((?:AKIA|ASIA)|ghp_|sk-)([A-Za-z0-9]{16,64})(?![A-Za-z0-9])")
NAMED_SECRET = re.compile(r"(?i)(\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?\s{0,3}[:=]\s{0,3}[\"']?)([^\s\"',;]{6,128})")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?![\w]|\.\d)")
# usual groups of a card number, longest first, then any groups of one separator
CARDS = [re.compile(rf"(?<![\w.]){form}(?![\w]|\.\d)") for form in (
    r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}\1\d{1,3}", r"\d{4}([ -])\d{4}\1\d{4}\1\d{4}", r"\d{4}([ -])\d{6}\1\d{4,5}", r"\d{4}([ -])\d{4}\1\d{5}",
    r"\d{13,19}", r"\d{2,8}([ -])\d{2,13}(?:\1\d{2,8}){0,6}")]
IPV6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{0,4}:){2,7}[0-9A-Fa-f]{0,4}(?![\w:]|\.\d)")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
PHONE = re.compile(r"(?<![\w.+])(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)")
ABROAD = re.compile(r"(?<![\w.+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,4}\)?){2,5}(?!\w)")
DATE = re.compile(r"(?<![\w.-])(?:(\d{4})([./-])(\d\d?)\2(\d\d?)|(\d\d?)([./-])(\d\d?)\6(\d{4}))(?:(?=[Tt]\d\d)|(?![\w]|[.-]\d))")


class Permuter:
    """A keyed permutation of 0..size-1 for any size: an unbalanced Feistel network with cycle walking."""

    def __init__(self, key: bytes):
        self.key = blake2b(key, digest_size=32).digest()

    def _round(self, tweak: bytes, i: int, value: int, size: int) -> int:
        wide = (size.bit_length() + 7) // 8 + 8
        data = b"%d|%d|%d|" % (i, value, size) + tweak
        out = b"".join(blake2b(data + bytes([n]), key=self.key).digest() for n in range(-(-wide // 64)))
        return int.from_bytes(out[:wide], "big") % size

    def permuted(self, value: int, size: int, tweak: bytes, fits: Callable[[int], bool] | None = None) -> int:
        """The image of ``value``; values that don't fit are walked past, so the fitting ones are permuted among themselves."""
        if size < 2:
            return value
        left_size = math.isqrt(size - 1) + 1
        right_size = -(-size // left_size)
        while True:
            left, right = divmod(value, right_size)
            for i in range(0, ROUNDS, 2):
                left = (left + self._round(tweak, i, right, left_size)) % left_size
                right = (right + self._round(tweak, i + 1, left, right_size)) % right_size
            value = left * right_size + right
            if value < size and (fits is None or fits(value)):
                return value


@cache
def block(number: int, kind: str) -> str:
    """The letters of 128 neighbouring code points: small ones that have a capital there ("pair"), digits, or all others ("single")."""
    own = [chr(i) for i in range(128 * number, 128 * number + 128) if not 0xD800 <= i < 0xE000]
    digits = [c for c in own if c.isdecimal()]
    pairs = [c for c in own if c.isalpha() and len(c.upper()) == 1 and c.upper() != c and c.upper() in own and c.upper().lower() == c]
    if kind != "single":
        return "".join(digits if kind == "digit" else pairs)
    return "".join(c for c in own if c.isalpha() and c not in pairs and c.lower() not in pairs)


@cache
def alphabet(c: str) -> str:
    """What a character may become: those of its kind in its script block; of capitals their small letters."""
    if c.isdecimal():
        return block(ord(c) >> 7, "digit")
    if not c.isalpha():
        return ""
    pairs = block(ord(c) >> 7, "pair")
    return pairs if c in pairs or c.lower() in pairs else block(ord(c) >> 7, "single")


def luhn_digit(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def iban_rest(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def in_form(pattern: str, digits: str) -> str:
    """``pattern`` with its digits replaced in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in pattern)


class Pseudonyms:
    """Finds personal data in a text and replaces each value within its own format."""

    def __init__(self, key: bytes):
        self.permuter, self.known = Permuter(key), {}

    def by_class(self, text: str, tweak: bytes) -> str:
        """Each digit becomes a digit, each letter one of its script block and case; other characters stay. Case is no part of the value."""
        classes = [alphabet(c) for c in text]
        value, size, shape = 0, 1, bytearray()
        for c, letters in zip(text, classes, strict=True):
            shape += bytes([min(len(letters) or 1, 255)])
            if letters and not c.isascii():
                shape += b"|%d|" % ord(letters[0])
            if len(letters) > 1:
                value, size = value * len(letters) + letters.index(c if c in letters else c.lower()), size * len(letters)
        value, out = self.permuter.permuted(value, size, tweak + bytes(shape)), []
        for c, letters in zip(reversed(text), reversed(classes), strict=True):
            if len(letters) < 2:
                out.append(c)
            else:
                value, place = divmod(value, len(letters))
                out.append(letters[place] if c in letters else letters[place].upper())
        return "".join(reversed(out))

    def digits(self, text: str, tweak: bytes, fits: Callable[[str], bool] = lambda d: True) -> str:
        own = "".join(c for c in text if c.isdigit())
        new = self.permuter.permuted(int(own), 10 ** len(own), tweak + b"%d" % len(own), lambda v: fits(f"{v:0{len(own)}}"))
        return in_form(text, f"{new:0{len(own)}}")

    def email(self, m: re.Match) -> str | None:
        name, _, end = m[0].rpartition(".")
        return f"{self.by_class(name, b'email')}.{end}"

    def cloud_key(self, m: re.Match) -> str | None:
        return m[1] + self.by_class(m[2], b"key" + m[1].encode())

    def named_secret(self, m: re.Match) -> str | None:
        return m[1] + self.by_class(m[2], b"secret")

    def iban(self, m: re.Match) -> str | None:
        plain = m[0].replace(" ", "")
        if not 15 <= len(plain) <= 34 or iban_rest(plain) != 1:
            return None
        body = self.by_class(plain[4:], b"iban" + plain[:2].encode())
        check = f"{98 - iban_rest(plain[:2] + '00' + body):02}"
        letters = iter(plain[:2] + check + body)
        return "".join(c if c == " " else next(letters) for c in m[0])

    def ipv4(self, m: re.Match) -> str | None:
        parts = m[0].split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        value = self.permuter.permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4")
        return ".".join(map(str, value.to_bytes(4, "big")))

    def ipv6(self, m: re.Match) -> str | None:
        try:
            value = int(ipaddress.IPv6Address(m[0]))
        except ValueError:
            return None
        if not any(c.isdigit() for c in m[0]) or value < 2:
            return None
        return str(ipaddress.IPv6Address(self.permuter.permuted(value, 1 << 128, b"ipv6", lambda v: v > 1 and any(c.isdigit() for c in str(ipaddress.IPv6Address(v))))))

    def card(self, m: re.Match) -> str | None:
        plain = "".join(c for c in m[0] if c.isdigit())
        if not 13 <= len(plain) <= 19 or luhn_digit(plain[:-1]) != int(plain[-1]) or len(set(plain)) == 1:
            return None
        body = plain[0] + self.digits(plain[1:-1], b"card" + plain[:1].encode())
        return in_form(m[0], body + str(luhn_digit(body)))

    def ssn(self, m: re.Match) -> str | None:
        valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        return self.digits(m[0], b"ssn", valid) if valid(m[0].replace("-", "")) else None

    def phone(self, m: re.Match) -> str | None:
        plain = "".join(c for c in m[0] if c.isdigit())
        lead = len(plain) - 10
        valid = lambda d: d[0] in "23456789"
        if not valid(plain[lead:]):
            return None
        return in_form(m[0], plain[:lead] + self.digits(plain[lead:], b"phone", valid))

    def abroad(self, m: re.Match) -> str | None:
        plain = "".join(c for c in m[0] if c.isdigit())
        if not 8 <= len(plain) <= 15:
            return None
        return in_form(m[0], plain[:2] + self.digits(plain[2:], b"phone" + plain[:2].encode()))

    def date(self, m: re.Match) -> str | None:
        """Year, month, day, or day first, or month first where day first is no date; each part keeps its number of digits."""
        orders = [(1, 3, 4)] if m[1] else [(8, 7, 5), (8, 5, 7)]
        for month_first, (y, mo, d) in enumerate(orders):
            try:
                value = dt.date(int(m[y]), int(m[mo]), int(m[d])).toordinal() - FIRST_DAY
            except ValueError:
                continue
            size = LAST_DAY - FIRST_DAY + 1
            if not 0 <= value < size:
                return None

            def fits(v: int) -> bool:
                new = dt.date.fromordinal(v + FIRST_DAY)
                return new.day < 10 ** len(m[d]) and new.month < 10 ** len(m[mo]) and (not month_first or new.day > 12)

            new = dt.date.fromordinal(self.permuter.permuted(value, size, b"date", fits) + FIRST_DAY)
            parts = {y: f"{new.year:04}", mo: f"{new.month:0{len(m[mo])}}", d: f"{new.day:0{len(m[d])}}"}
            return (m[2] or m[6]).join(parts[k] for k in sorted(parts))
        return None

    def replaced(self, text: str) -> tuple[str, list[tuple[str, int, int, str]]]:
        """The text with pseudonyms, and (kind, start, length, pseudonym) of what was replaced, by place in the old text."""
        digits = any(c in text for c in "0123456789")
        kinds = []
        if "@" in text:
            kinds.append(("email", EMAIL, self.email))
        if digits or "=" in text or ":" in text:
            kinds += [("key", CLOUD_KEY, self.cloud_key), ("secret", NAMED_SECRET, self.named_secret)]
        if digits:
            kinds += [("iban", IBAN, self.iban), ("ipv4", IPV4, self.ipv4), ("ipv6", IPV6, self.ipv6), *[("card", form, self.card) for form in CARDS], ("date", DATE, self.date),
                      ("ssn", SSN, self.ssn), ("phone", PHONE, self.phone), ("phone", ABROAD, self.abroad)]
        found: list[tuple[int, int, str, str]] = []
        taken = bytearray()  # one mark per character, from the first find on
        for kind, pattern, make in kinds:
            for m in pattern.finditer(text):
                start, end = m.span()
                if taken.find(1, start, end) >= 0:
                    continue
                name = (kind, m[0])
                if name not in self.known:
                    if len(self.known) > MEMORY:
                        self.known.clear()
                    self.known[name] = make(m)
                if (new := self.known[name]) is not None:
                    found.append((start, end, kind, new))
                    taken = taken or bytearray(len(text))
                    taken[start:end] = b"\x01" * (end - start)
        found.sort()
        out, at = [], 0
        for start, end, _, new in found:
            out += [text[at:start], new]
            at = end
        return "".join([*out, text[at:]]), [(kind, start, end - start, new) for start, end, kind, new in found]


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """``docs`` with pseudonyms in ``text`` and a column ``pii``: kind, start, length (in the old text) and pseudonym of each.

    Cards (Luhn, 13 to 19 digits in any groups of one separator), IBANs (mod 97), IPv4 and IPv6 addresses, social
    security and phone numbers, and calendar dates (year, day or month first; day first where both are valid) are
    validated; what fails stays. E-mail addresses, keys and named secrets keep their classes of characters.
    The permutation depends on the key and the format only, so equal values get equal pseudonyms in all
    documents, and different ones of a format different ones. Null texts stay null, with no ``pii``. One narrow
    pass, one row per row; a column already named ``pii`` is replaced.
    """
    kept = [c for c in docs.columns if c.lower() != "pii"]
    narrow = docs.select(*[f"`{c}`" for c in kept])
    at = kept.index(text)
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("pseudonym", pa.string())]))

    def run(batches):
        own = Pseudonyms(key)
        for batch in batches:
            valid = batch.column(at).is_valid().to_pylist()
            done = [own.replaced(t) for t in texts_of(batch.column(at))]
            columns = list(batch.columns)
            columns[at] = pa.array([t if ok else None for (t, _), ok in zip(done, valid, strict=True)], pa.string())
            found = pa.array([[dict(zip(("kind", "start", "length", "pseudonym"), f, strict=True)) for f in fs] for _, fs in done], spans)
            yield pa.RecordBatch.from_arrays([*columns, found], [*batch.schema.names, "pii"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema)
    return narrow.mapInArrow(run, f"{schema}, pii array<struct<kind:string,start:int,length:int,pseudonym:string>>")


# the query's key; a real run passes its own secret
QUERY_KEY = b"rostrum query key"


def op3_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
    return out.select("doc_id", "text", F.size("pii").alias("n_replaced"), "pii")
