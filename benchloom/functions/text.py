"""Text rules shared by the jobs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Trim white space of every kind, line ends included."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def normal_text(text: Column) -> Column:
    """Lower case, punctuation and non-ASCII letters removed, trimmed."""
    return strip(F.regexp_replace(F.lower(text), r"[^\w\s]+", ""))


def collapsed_text(text: Column) -> Column:
    """Lower case with each run of white space as one blank: the form duplicates are found by."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def first_non_empty(columns: Iterable[Column]) -> Column:
    """First column that is neither null nor empty, else an empty text."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def last_match(text: Column, pattern: str, group: int = 0) -> Column:
    """Last match of ``pattern``, null when there is none."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def first_found(text: Column, patterns: Iterable[tuple[str, int]]) -> Column:
    """Match of the first pattern that occurs, given as (pattern, group); null when none does.

    An array evaluates each pattern once; nested conditions would repeat them in the generated code.
    """
    found = F.array(*[F.regexp_extract(text, pattern, group) for pattern, group in patterns])
    return F.try_element_at(F.filter(found, lambda m: m != ""), F.lit(1))


def first_match(text: Column, pattern: str, group: int = 0) -> Column:
    """First match of ``pattern``, null when there is none."""
    return first_found(text, [(pattern, group)])


def lines(text: Column) -> Column:
    return F.split(text, "\n")


def head_tail(text: Column, limit: int = 4000, head: int = 3000, tail: int = 1000, mark: str = "\n…\n") -> Column:
    """Long text as its first and last characters around a mark; short text unchanged."""
    return F.when(F.char_length(text) <= limit, text).otherwise(
        F.concat(F.left(text, F.lit(head)), F.lit(mark), F.right(text, F.lit(tail)))
    )


def cut_bytes(text: Column, limit: int, mark: str) -> Column:
    """At most ``limit`` bytes of UTF-8, cut between characters, ending in ``mark`` when cut.

    The cut bytes lose a trailing part of a character: one byte at a time, up to three, is
    dropped until the rest decodes to text that encodes to the same bytes.
    """
    raw = F.encode(text, "UTF-8")
    keep = max(limit - len(mark.encode("utf-8")), 0)

    def cut(n: int) -> Column:
        return F.substring(raw, 1, max(n, 0))

    # In UTF-8 a byte of the form 10xxxxxx continues a character; a cut is clean when the
    # byte after it does not.
    def clean(n: int) -> Column:
        following = F.conv(F.hex(F.substring(raw, n + 1, 1)), 16, 10).cast("int")
        return (following < 128) | (following >= 192)

    whole = cut(keep - 3)
    for n in (keep - 2, keep - 1, keep):
        whole = F.when(clean(n), cut(n)).otherwise(whole)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.concat(F.decode(whole, "UTF-8"), F.lit(mark)))


def was_cut(text: Column, limit: int) -> Column:
    return F.coalesce(F.octet_length(text) > limit, F.lit(False))
