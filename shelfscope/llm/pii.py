"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

The patterns are anchored so that time grows with the text alone: an address is
looked for around each ``@``, and a run of digits is tried from its start only
(from a later digit it would fail at the same place).
"""

from __future__ import annotations

import bisect
import ipaddress
import itertools
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from shelfscope.llm.base import scan, struct

LOCAL = regex.compile(r"(?r)[A-Za-z0-9._%+-]+")  # read backwards from the @
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
#: Characters of an account number by country.
IBAN_SIZES = {
    country: size
    for size, countries in {
        15: "NO", 16: "BE", 18: "DK FI FO FK GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG",
        25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for country in countries.split()
}
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
#: Access key ids, access tokens and the heads of private keys, by their fixed beginnings and lengths.
SECRET = re.compile(
    r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{36}|-----BEGIN (?:[A-Z]+ ){0,2}PRIVATE KEY-----)(?![A-Za-z0-9])"
)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Za-z:])")

BASE_KINDS = ["email", "ip", "card", "phone"]
KINDS = [*BASE_KINDS, "iban", "ssn", "short_card", "secret", "ipv6"]

#: Score of a confirmed span without context, and the words that raise or lower it when they stand near.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.9, "phone": 0.7, "iban": 0.9, "ssn": 0.4, "short_card": 0.3, "secret": 0.9, "ipv6": 0.6}
SUPPORT = {
    "email": {"mail", "email", "contact", "write"},
    "ip": {"ip", "address", "host", "server", "client"},
    "card": {"card", "credit", "visa", "mastercard", "payment"},
    "phone": {"phone", "call", "tel", "mobile", "fax", "contact"},
    "iban": {"iban", "account", "bank", "transfer"},
    "ssn": {"ssn", "social", "security"},
    "short_card": {"card", "credit", "amex", "american", "diners", "payment"},
    "secret": {"key", "token", "secret", "password", "credentials"},
    "ipv6": {"ip", "address", "host", "server", "client"},
}
AGAINST = {"version", "release", "example", "sample", "isbn", "order", "build", "test"}
RAISED, LOWERED = 0.3, -0.3
NEAR = 40  # characters looked at on either side
NEEDED = 0.5  # score a span of an added kind must reach; base kinds always stay

WORD = re.compile(r"[a-z]+")
RESULTS = struct(
    spans=T.ArrayType(struct(kind=T.StringType(), start=T.LongType(), end=T.LongType(), score=T.DoubleType(), base=T.BooleanType()))
)


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2]))
    return (total + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """The check digits of an account number: letters as 10 to 35, first four characters last, remainder 1."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def iban_end(text: str, start: int, end: int) -> int | None:
    """Where an account number that begins a proposed span ends: after the length of its country, else with the span."""
    size = IBAN_SIZES.get(text[start : start + 2])
    at, left = start, size or 0
    while left and at < end:
        left -= text[at] != " "
        at += 1
    ends = [at] if size and not left and not (at < end and text[at].isalnum()) else []
    for stop in [*ends, end]:
        number = text[start:stop].replace(" ", "")
        if 15 <= len(number) <= 34 and mod97(number):
            return stop
    return None


def ibans(text: str):
    """What follows a number (a currency, a year) may look like more of it; the search goes on behind the number itself."""
    at = 0
    while m := IBAN.search(text, at):
        end = iban_end(text, *m.span())
        if end:
            yield m.start(), end
        at = end or m.start() + 1


def is_ipv6(address: str) -> bool:
    """Whether it reads as an address with three groups that are written and a digit, which names of code such as a::b lack."""
    if sum(map(bool, address.split(":"))) < 3 or not any(map(str.isdigit, address)):
        return False
    try:
        ipaddress.IPv6Address(address)
    except ValueError:
        return False
    return True


def emails(text: str):
    end, at = 0, text.find("@")
    while at >= 0:
        local = LOCAL.match(text, end, at) if at > end else None
        domain = DOMAIN.match(text, at + 1) if local else None
        if domain:
            end = domain.end()
            yield local.start(), end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The base kinds: leftmost, non-overlapping within a kind; a match that fails its check is passed over."""
    spans = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in IP.finditer(text):
        parts = [part.lstrip("0") for part in m[0].split(".")]
        if all(len(part) < 4 and int(part or 0) <= 255 for part in parts):
            spans.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                spans.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                spans.append(("phone", *m.span()))
    return spans


def added_spans(text: str) -> list[tuple[str, int, int]]:
    spans = [("iban", a, b) for a, b in ibans(text)]
    for m in SSN.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            spans.append(("ssn", *m.span()))
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 29:
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 15 and digits[0] in "3456" and luhn(digits):
                spans.append(("short_card", *m.span()))
    spans += [("secret", *m.span()) for m in SECRET.finditer(text)]
    spans += [("ipv6", *m.span()) for m in IPV6.finditer(text) if is_ipv6(m[0])]
    return spans


def scored(text: str, kind: str, start: int, end: int) -> float:
    near = set(WORD.findall(text[max(0, start - NEAR) : start].lower())) | set(WORD.findall(text[end : end + NEAR].lower()))
    return round(min(1.0, max(0.0, PRIOR[kind] + RAISED * bool(near & SUPPORT[kind]) + LOWERED * bool(near & AGAINST))), 3)


def spans_of(text: str) -> list[dict]:
    """All spans with scores, by kind in the order of KINDS and then by start.

    An added span is left out when its score is too low or a base span overlaps it.
    """
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    furthest = list(itertools.accumulate((b for _, b in taken), max))
    found = [{"kind": k, "start": a, "end": b, "score": scored(text, k, a, b), "base": True} for k, a, b in base]
    for k, a, b in added_spans(text):
        before = bisect.bisect_left(taken, (b,))  # base spans that begin before this one ends
        if not (before and furthest[before - 1] > a) and (score := scored(text, k, a, b)) >= NEEDED:
            found.append({"kind": k, "start": a, "end": b, "score": score, "base": False})
    return sorted(found, key=lambda s: (KINDS.index(s["kind"]), s["start"]))


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scored spans of every text, offsets in code points, end exclusive.

    One row per input row, repeated rows and null ids included; other columns
    are left out.  A null or empty text has an empty list.  No shuffle.
    """

    def run(texts: pa.Array) -> dict:
        return {"spans": [spans_of(x) if x else [] for x in texts.to_pylist()]}

    return scan(docs, [id_col], text_col, RESULTS, lambda: run)

