"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations."""

from __future__ import annotations

import datetime
import hashlib
import math
import re
import secrets
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.threadweave.pii.secret"  #: setting of the session that holds the key
ROUNDS = 8
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def permute(value: int, size: int, key: bytes, tweak: bytes, back: bool = False) -> int:
    """Keyed permutation of 0..size-1: a Feistel network over a pair of residues, walked along its cycle until it falls inside."""
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = (size + a - 1) // a
    while True:
        left, right = divmod(value, b)
        for r in reversed(range(ROUNDS)) if back else range(ROUNDS):
            m, other = (a, right) if r % 2 == 0 else (b, left)
            text = b"%s|%d|%d|%d" % (tweak, size, r, other)
            f = int.from_bytes(hashlib.blake2b(text, key=key[:64], digest_size=(m.bit_length() + 7) // 8 + 8).digest(), "big")
            f = -f if back else f
            if r % 2 == 0:
                left = (left + f) % a
            else:
                right = (right + f) % b
        value = left * b + right
        if value < size:
            return value


ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþß", "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ")
#: Longest local part and domain aren't limited; what stands before an @ is looked for from there backwards.
LOCAL, AFTER = re.compile(r"[\w.+%-]"), re.compile(r"@[\w-]+(?:\.[\w-]+)*\.[^\W\d_]{2,}")
HEX = ("0123456789abcdef",), ("0123456789ABCDEF",)


@lru_cache(4_096)
def page(c: str) -> str:
    """The letters or digits of the general category of ``c`` that share its page of 256 code points, or where it is alone there its 4,096."""
    kind = unicodedata.category(c)
    for width in (256, 4_096):
        first = ord(c) // width * width
        found = "".join(x for x in map(chr, range(first, first + width)) if unicodedata.category(x) == kind and not any(x in a for a in ALPHABETS))
        if len(found) > 1:
            break
    return found


def spelled(text: str, key: bytes, tweak: bytes, alphabets: tuple[str, ...] = ALPHABETS, back: bool = False) -> str:
    """Permute all characters that an alphabet has, each within its own; without stated alphabets all other letters and digits
    within their page. The rest stays."""
    at, value, size = [], 0, 1
    for i, c in enumerate(text):
        letters = next((a for a in alphabets if c in a), None) or (page(c) if alphabets is ALPHABETS and c.isalnum() else None)
        if letters:
            at.append((i, letters))
            value, size = value * len(letters) + letters.index(c), size * len(letters)
    value = permute(value, size, key, tweak, back)
    out = list(text)
    for i, letters in reversed(at):
        value, k = divmod(value, len(letters))
        out[i] = letters[k]
    return "".join(out)


def refill(shape: str, digits: str) -> str:
    """The digits of ``shape`` replaced in order."""
    new = iter(digits)
    return "".join(next(new) if c.isdigit() else c for c in shape)


def luhn_sum(digits: str) -> int:
    return sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10


def card(text: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    if not 13 <= len(d) <= 19 or luhn_sum(d) or len(set(d)) == 1:
        return None
    new = str(permute(int(d[:-1]), 10 ** (len(d) - 1), key, b"card", back)).zfill(len(d) - 1)
    return refill(text, new + str(-luhn_sum(new + "0") % 10))


def ipv4(text: str, key: bytes, back: bool) -> str | None:
    parts = text.split(".")
    if any(int(p) > 255 or p != str(int(p)) for p in parts):
        return None
    n = permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, b"ipv4", back)
    return ".".join(map(str, n.to_bytes(4, "big")))


def email(text: str, key: bytes, back: bool) -> str | None:
    local, _, domain = text.partition("@")
    name, dot, top = domain.rpartition(".")
    return spelled(local + "@" + name, key, b"email", back=back) + dot + top


def phone(text: str, key: bytes, back: bool) -> str | None:
    d = re.sub(r"\D", "", text)
    plus = re.match(r"\+(\d{1,3})\D", text)
    stays = len(plus[1]) if plus else 0
    if not 9 <= len(d) <= 15:
        return None
    n = len(d) - stays
    return refill(text, d[:stays] + str(permute(int(d[stays:]), 10**n, key, b"phone", back)).zfill(n))


def ssn(text: str, key: bytes, back: bool) -> str | None:
    def good(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    d = text.replace("-", "")
    if not good(d):
        return None
    while True:
        d = str(permute(int(d), 10**9, key, b"ssn", back)).zfill(9)
        if good(d):
            return refill(text, d)


def iban(text: str, key: bytes, back: bool) -> str | None:
    plain = text.replace(" ", "")

    def rest(body: str) -> int:
        return int("".join(str(int(c, 36)) for c in body)) % 97

    if not 15 <= len(plain) <= 34 or rest(plain[4:] + plain[:4]) != 1:
        return None
    body = spelled(plain[4:], key, b"iban" + plain[:2].encode(), back=back)
    new = iter(plain[:2] + f"{98 - rest(body + plain[:2] + '00'):02d}" + body)
    return "".join(c if c == " " else next(new) for c in text)


DATES = (
    (re.compile(r"(?P<y>\d{4})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<d>\d{2})"), "{y:04d}{s}{m:02d}{s}{d:02d}"),
    (re.compile(r"(?P<d>\d{2})(?P<s>[-/.])(?P<m>\d{2})(?P=s)(?P<y>\d{4})"), "{d:02d}{s}{m:02d}{s}{y:04d}"),
    (re.compile(r"(?P<m>\d{2})(?P<s>[-/.])(?P<d>\d{2})(?P=s)(?P<y>\d{4})"), "{m:02d}{s}{d:02d}{s}{y:04d}"),
)


def date(text: str, key: bytes, back: bool) -> str | None:
    """Of the readings year-month-day, day-month-year and month-day-year the first that is a day from 1900 to 2099. In the second and third the
    day must not be open to both after the permutation, so their result is walked on until it reads the same way."""
    for k, (form, shape) in enumerate(DATES):
        m = form.fullmatch(text)
        try:
            day = datetime.date(int(m["y"]), int(m["m"]), int(m["d"])).toordinal() if m else 0
        except ValueError:
            continue
        if not FIRST_DAY <= day <= LAST_DAY:
            continue
        while True:
            day = FIRST_DAY + permute(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, key, b"date%d" % k, back)
            x = datetime.date.fromordinal(day)
            if k < 2 or x.day > 12:
                return shape.format(y=x.year, m=x.month, d=x.day, s=m["s"])
    return None


def secret(text: str, key: bytes, back: bool) -> str | None:
    if not (re.search(r"\d", text) and re.search(r"[A-Fa-f]", text)) or not (text == text.lower() or text == text.upper()):
        return None
    return spelled(text, key, b"hex", HEX[0] if text == text.lower() else HEX[1], back)


#: In this order; what an earlier kind takes is not looked at again.
KINDS = {
    "email": (AFTER.pattern, email),
    "secret": (r"(?<![0-9A-Za-z])(?:[0-9A-Fa-f]{64}|[0-9A-Fa-f]{40}|[0-9A-Fa-f]{32})(?![0-9A-Za-z])", secret),
    "iban": (r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])", iban),
    "date": (r"(?<![\d.-])(?:\d{4}([-/.])\d{2}\1\d{2}|\d{2}([-/.])\d{2}\2\d{4})(?![\d]|[.-]\d)", date),
    "ssn": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    "ipv4": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", ipv4),
    "card": (r"(?<!\d)(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}([ -])\d{6}\2\d{5})(?!\d)", card),
    "phone": (r"(?<![\w.-])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{3}[ .-])\d{3,4}[ .-]\d{4}(?![\w-])|(?<!\w)\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)", phone),
}
FOUND = {kind: re.compile(p) for kind, (p, _) in KINDS.items()}
WORTH = re.compile(r"[0-9@]|[0-9A-Fa-f]{32}")


def places(kind: str, text: str) -> Iterator[tuple[int, int]]:
    """Begin and end of what looks like a value of the kind."""
    last = 0
    for m in FOUND[kind].finditer(text):
        s, e = m.span()
        if kind == "email":
            at = s
            while s > last and LOCAL.match(text, s - 1):
                s -= 1
            if s == at:
                continue
            last = e
        yield s, e


def pseudonymise(text: str, key: bytes, seen: dict | None = None, back: bool = False) -> tuple[str, dict[str, int]]:
    """The text with every validated value permuted in its format, and how many of each kind. ``back`` undoes it."""
    found: dict[str, int] = {}
    if not WORTH.search(text):
        return text, found
    begins: list[int] = []
    taken: list[tuple[int, int, str]] = []  # in order, as ``begins``
    for kind, (_, change) in KINDS.items():
        if kind == "email" and "@" not in text:
            continue
        for s, e in places(kind, text):
            i = bisect_right(begins, s)
            if (i and taken[i - 1][1] > s) or (i < len(taken) and taken[i][0] < e):
                continue
            value = text[s:e]
            at = kind, value
            new = seen.get(at, "") if seen is not None else ""
            if new == "":
                new = change(value, key, back)
                if seen is not None:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen[at] = new
            if new is not None:
                begins.insert(i, s)
                taken.insert(i, (s, e, new))
                found[kind] = found.get(kind, 0) + 1
    out, last = [], 0
    for s, e, new in taken:
        out += [text[last:s], new]
        last = e
    return "".join([*out, text[last:]]), found


def session_key(spark: SparkSession) -> bytes:
    """The key that the session's setting ``KEY`` holds; where it holds none, a random one is made for the session."""
    held = spark.conf.get(KEY, None) or spark.sparkContext.getConf().get(KEY)
    if not held:
        held = secrets.token_hex(32)
        spark.conf.set(KEY, held)
    return held.encode()


def pseudonymise_docs(docs: DataFrame, text: str = "text", key: bytes | None = None, count: str | None = None) -> DataFrame:
    """``docs`` with the values in its ``text`` column replaced; ``count`` names a column for their number.

    Emails, IPv4 addresses, phone numbers, payment cards (Luhn), IBANs (mod 97), social security
    numbers, dates and hexadecimal keys that pass their validation are permuted under ``key``
    within their own format: digits stay digits, check digits hold, a date is a date. Equal
    values get equal pseudonyms in all documents, and :func:`pseudonymise` with ``back`` undoes
    them. What fails validation stays. The result is again one row per row of ``docs``, with the
    columns in their order; null texts stay null with the number 0, empty texts empty; a column
    called as ``count`` is replaced. Narrow: no shuffle, and no cap on a text's length.
    """
    key = session_key(docs.sparkSession) if key is None else key

    @F.pandas_udf("x string, n int")
    def change(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        seen: dict = {}
        for texts in batches:
            done = [(None, {}) if t is None else pseudonymise(t, key, seen) for t in texts]
            yield pd.DataFrame({"x": [d[0] for d in done], "n": [sum(d[1].values()) for d in done]})

    held = "_pseudonym" + "_" * max(map(len, docs.columns))
    changed = docs.withColumn(held, change(F.col(f"`{text}`").cast("string")))
    out = [F.col(f"{held}.x").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c != count]
    return changed.select(*out, *([F.col(f"{held}.n").alias(count)] if count else []))
