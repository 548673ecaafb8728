"""Format-preserving pseudonyms of personal numbers, dates and addresses by a keyed Feistel permutation.

Values are found by pattern and validated: card numbers by their check digit, telephone and social security
numbers by their rules, internet addresses by their ranges, dates by the calendar.  In a run of digit groups every
sequence of whole groups may be a card, so numbers beside one do not hide it.  A valid value becomes a
number within the set of all values of its format, and a Feistel network keyed by a secret permutes that set
(out-of-set results are permuted again).  So a card number stays a valid card number, a date a date, and equal
values get equal pseudonyms in all documents, while nothing but the key leads back.

Defined results: null and empty texts hold nothing; a pseudonym has the separators of its value; values that do
not validate stay as they are; repeated rows are treated alike; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from benchloom.llm.common import table

ROUNDS = 10
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

PATTERN = re.compile(
    r"""(?<![\w.+-])(?P<email>[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,})(?![\w-])
    |(?<![\d.])(?P<ip>\d{1,3}(?:\.\d{1,3}){3})(?!\.?\d)
    |(?<![\d-])(?P<date>\d{4}-\d\d-\d\d|\d\d?/\d\d?/\d{4})(?![\d-])
    |(?<![\d-])(?P<ssn>\d{3}-\d\d-\d{4})(?![\d-])
    |(?<![\w+])(?P<phone>(?:\+1[ .-]?)?(?:\(\d{3}\)[ ]?|\d{3}[ .-])\d{3}[ .-]\d{4})(?!\d)
    |(?<![\d.-])(?P<card>\d(?:[ -]?\d){12,})""",
    re.VERBOSE | re.ASCII,
)
#: A run of digits, and its groups.
RUN, GROUP = re.compile(r"\d(?:[ -]?\d)*", re.ASCII), re.compile(r"\d+", re.ASCII)
CARD_DIGITS = range(13, 20)
#: A text without any of these holds no value.
HINT = re.compile(r"[0-9@]")


def _mix(key: bytes, tweak: str, turn: int, half: int, size: int) -> int:
    data = half.to_bytes((half.bit_length() + 7) // 8 or 1, "big")
    digest = hashlib.blake2b(data, digest_size=32, key=key, person=bytes([turn]), salt=tweak.encode()[:16]).digest()
    width = (size.bit_length() + 7) // 8 + 8
    while len(digest) < width:
        digest += hashlib.blake2b(digest, digest_size=32, key=key).digest()
    return int.from_bytes(digest, "big") % size


def permute(value: int, size: int, key: bytes, tweak: str, back: bool = False) -> int:
    """A keyed permutation of 0 .. ``size`` - 1; ``back`` undoes it."""
    if not 0 <= value < size:
        raise ValueError("value outside its format")
    if size < 2:
        return value
    a = math.isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for turn in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if turn % 2:
                move = _mix(key, tweak, turn, left, b)
                right = (right - move if back else right + move) % b
            else:
                move = _mix(key, tweak, turn, right, a)
                left = (left - move if back else left + move) % a
        value = left * b + right
        if value < size:
            return value


def luhn_digit(payload: str) -> int:
    total = 0
    for i, c in enumerate(reversed(payload)):
        d = int(c) * (2 - i % 2)
        total += d - 9 * (d > 9)
    return -total % 10


def _fill(form: str, digits: str) -> str:
    """``form`` with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if "0" <= c <= "9" else c for c in form)


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


Permute = Callable[[int, int, str], int]


def _card(value: str, p: Permute) -> str | None:
    d = _digits(value)
    if not _is_card(d):
        return None
    payload = str(p(int(d[:-1]), 10 ** (len(d) - 1), f"card{len(d)}")).zfill(len(d) - 1)
    return _fill(value, payload + str(luhn_digit(payload)))


def _phone(value: str, p: Permute) -> str | None:
    d = _digits(value)
    country, own = d[:-10], d[-10:]
    if not country and (own[0] in "01" or own[3] in "01"):
        return None
    return _fill(value, country + str(p(int(own), 10**10, "phone")).zfill(10))


def _ssn_valid(d: str) -> bool:
    return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"


def _ssn(value: str, p: Permute) -> str | None:
    d = _digits(value)
    if not _ssn_valid(d):
        return None
    while True:
        d = str(p(int(d), 10**9, "ssn")).zfill(9)
        if _ssn_valid(d):
            return _fill(value, d)


def _ip(value: str, p: Permute) -> str | None:
    parts = [int(x) for x in value.split(".")]
    if max(parts) > 255:
        return None
    n = p(int.from_bytes(bytes(parts), "big"), 1 << 32, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _date(value: str, p: Permute) -> str | None:
    try:
        if "-" in value:
            day = datetime.date.fromisoformat(value)
        else:
            month, day_of, year = (int(x) for x in value.split("/"))
            day = datetime.date(year, month, day_of)
    except ValueError:
        return None
    if not FIRST_DAY <= day.toordinal() <= LAST_DAY:
        return None
    new = datetime.date.fromordinal(FIRST_DAY + p(day.toordinal() - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, "date"))
    return new.isoformat() if "-" in value else f"{new.month}/{new.day}/{new.year}"


def _email(value: str, p: Permute) -> str | None:
    """Letters stay letters and digits digits in the part before the sign; the domain stays."""
    name, _, domain = value.rpartition("@")
    radix = [10 if "0" <= c <= "9" else 26 if c.isalpha() else 1 for c in name]
    n = 0
    for c, r in zip(name.lower(), radix):
        n = n * r + (int(c) if r == 10 else ord(c) - 97 if r == 26 else 0)
    form = "".join({10: "9", 26: "a"}.get(r, c) for c, r in zip(name, radix))
    tweak = hashlib.blake2b(form.encode(), digest_size=8).hexdigest()
    n = p(n, math.prod(radix), tweak)
    out = []
    for c, r in zip(reversed(name), reversed(radix)):
        n, d = divmod(n, r)
        new = str(d) if r == 10 else chr(97 + d) if r == 26 else c
        out.append(new.upper() if c.isupper() else new)
    return "".join(reversed(out)) + "@" + domain


KINDS = {"card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "date": _date, "email": _email}


def _is_card(d: str) -> bool:
    return luhn_digit(d[:-1]) == int(d[-1]) and len(set(d)) > 1


def card_spans(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Begin and end of the cards in a run of digits: whole groups with the check digit right, chosen so that they
    cover as many digits as can be; the first and longest where that is equal."""
    groups = [m.span() for m in GROUP.finditer(text, begin, end)]
    # From each group on: the digits that are covered, and where the card from there ends (0: none begins there).
    covered, stops = [0] * (len(groups) + 1), [0] * len(groups)
    for i in range(len(groups) - 1, -1, -1):
        covered[i], digits = covered[i + 1], ""
        for j in range(i, len(groups)):
            a, b = groups[j]
            if len(digits) + b - a > CARD_DIGITS[-1]:
                break
            digits += text[a:b]
            outer = b == end and text[b : b + 1] == "-"
            if len(digits) in CARD_DIGITS and not outer and len(digits) + covered[j + 1] >= max(covered[i], 1) and _is_card(digits):
                covered[i], stops[i] = len(digits) + covered[j + 1], j + 1
    spans, i = [], 0
    while i < len(groups):
        if stops[i]:
            spans.append((groups[i][0], groups[stops[i] - 1][1]))
        i = stops[i] or i + 1
    return spans


def _values(text: str) -> Iterator[tuple[str, int, int]]:
    """Kind, begin and end of everything that may be a value.  After one that is none, the search goes on right
    behind its begin; the cards of a run of digits are chosen together, and other kinds looked for between them."""

    def at(begin: int) -> tuple[str, int, int] | None:
        m = PATTERN.match(text, begin)
        return (m.lastgroup, begin, m.end()) if m and m.lastgroup != "card" and KINDS[m.lastgroup](m.group(), _same) else None

    pos = 0
    while match := PATTERN.search(text, pos):
        begin, pos = match.start(), match.end()
        if match.lastgroup != "card" and KINDS[match.lastgroup](match.group(), _same) is not None:
            yield match.lastgroup, begin, pos
            continue
        run = RUN.match(text, begin)
        if run is None:
            pos = begin + 1
            continue
        cards = card_spans(text, begin, run.end())
        pos, left = begin, cards[::-1]
        for a, _ in [m.span() for m in GROUP.finditer(text, begin, run.end())]:
            if a < pos:
                continue
            if left and a == left[-1][0]:
                _, pos = left.pop()
                yield "card", a, pos
            elif (other := at(a)) and not (left and other[2] > left[-1][0]):
                yield other
                pos = other[2]
        pos = max(pos, run.end())


def _same(value: int, size: int, tweak: str) -> int:
    return value


def replace_values(text: str | None, key: bytes, back: bool = False) -> tuple[str | None, list[tuple[str, int, int, str]]]:
    """The text with pseudonyms, and ``(kind, start, length, pseudonym)`` of each, by places in ``text``."""
    if not isinstance(text, str) or not HINT.search(text):
        return text, []

    def p(value: int, size: int, tweak: str) -> int:
        return permute(value, size, key, tweak, back)

    out, found, at = [], [], 0
    for kind, begin, end in _values(text):
        new = KINDS[kind](text[begin:end], p)
        out += [text[at:begin], new]
        at = end
        found.append((kind, begin, end - begin, new))
    return "".join([*out, text[at:]]), found


def pseudonymize(docs: DataFrame, key: bytes) -> DataFrame:
    """``doc_id``, ``text`` with pseudonyms and ``found`` (kind, start, length, pseudonym) of every document."""

    def replace(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            done = [replace_values(t, key) for t in frame["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": frame["doc_id"].astype("Int64"),
                    "text": [d[0] for d in done],
                    "found": [[dict(zip(("kind", "start", "length", "pseudonym"), f)) for f in d[1]] for d in done],
                }
            )

    return docs.select("doc_id", "text").mapInPandas(
        replace, "doc_id long, text string, found array<struct<kind:string,start:int,length:int,pseudonym:string>>"
    )


def op8_pseudonyms(spark, folder: str) -> DataFrame:
    """One row per value replaced.  The key is a parameter; this one serves the query only."""
    found = pseudonymize(table(spark, folder, "documents"), b"query key, not a secret")
    return found.select("doc_id", F.inline("found"))


QUERIES = {"op8_pseudonyms": op8_pseudonyms}
