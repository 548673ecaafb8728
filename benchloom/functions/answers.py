"""Rules that pull an answer out of a response and compare it with the gold answer."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.text import first_match, last_match, lines, normal_text, strip

# Patterns that decide what an answer looks like.
NUMBER = r"-?\$?\d[\d,]*(?:\.\d+)?%?"
ANSWER_MARK = r"(?im)(?:####|final\s+answer|(?:the\s+)?answer\s+is|^\s*answer)\s*[:=]?\s*"
EQUATION_RESULT = r"=\s*(-?\$?\d[\d,]*(?:\.\d+)?%?)"
BOLD_NUMBER = r"\*\*([^*]*\d[^*]*)\*\*"
# ASCII word borders, so that an accented letter next to a word does not hide it.
SUMMARY_WORD = r"(?i)(?<![A-Za-z0-9_])(?:total|result|therefore|so)(?![A-Za-z0-9_])"


def _non_empty(values: Column) -> Column:
    return F.filter(values, lambda v: v != "")


def _last(values: Column) -> Column:
    return F.try_element_at(values, F.lit(-1))


def _last_bold(text: Column) -> Column:
    """Number in the last bold part that is no heading (a heading has a colon)."""
    bold = F.regexp_extract_all(text, F.lit(BOLD_NUMBER), F.lit(1))
    plain = F.filter(bold, lambda b: ~F.contains(b, F.lit(":")))
    return _last(_non_empty(F.transform(plain, lambda b: F.regexp_extract(b, NUMBER, 0))))


def last_number(text: Column) -> Column:
    """Last number in the text, else the text."""
    return F.coalesce(last_match(text, NUMBER), text)


def _final_answer_rules(text: Column) -> dict[str, Column]:
    parts = F.split(text, ANSWER_MARK)
    summary = F.filter(lines(text), lambda line: line.rlike(SUMMARY_WORD))
    by_line = F.transform(summary, lambda line: F.coalesce(_last_bold(line), last_match(line, NUMBER), F.lit("")))
    return {
        "marker": F.when(F.size(parts) > 1, first_match(F.element_at(parts, -1), NUMBER)),
        "summary": _last(_non_empty(by_line)),
        "equation": last_match(text, EQUATION_RESULT, 1),
        "bold": _last_bold(text),
        "last_number": last_match(text, NUMBER),
    }


def final_answer(text: Column) -> Column:
    """Number after the last answer mark, else of the last summary line, the last equation, the last
    bold part, the last number, else the text."""
    return F.coalesce(*_final_answer_rules(text).values(), text)


def with_final_answer(rows: DataFrame, text: str, answer: str, rule: str = "rule") -> DataFrame:
    """Add the final answer of a text column and the rule that found it (``raw`` for the whole text).

    Each rule is a column of its own, computed once and only while the rules before it found nothing.
    """
    found: list[str] = []
    for name, value in _final_answer_rules(F.col(text)).items():
        missing = F.lit(True)
        for earlier in found:
            missing = missing & F.col(earlier).isNull()
        rows = rows.withColumn(f"_by_{name}", F.when(missing, value) if found else value)
        found.append(f"_by_{name}")
    which = F.when(F.col(found[0]).isNotNull(), found[0].removeprefix("_by_"))
    for column in found[1:]:
        which = which.when(F.col(column).isNotNull(), column.removeprefix("_by_"))
    return (
        rows.withColumn(rule, which.otherwise("raw")).withColumn(answer, F.coalesce(*found, F.col(text))).drop(*found)
    )


def regex_answer(text: Column, pattern: str | None) -> Column:
    """Last match (its first group if it has one); an empty or bad pattern gives the text."""
    if not pattern:
        return text
    try:
        groups = re.compile(pattern).groups
    except re.error:
        return text
    return F.coalesce(last_match(text, pattern, 1 if groups else 0), text)


def extracted_answer(text: Column, mode: str, pattern: str | None = None) -> Column:
    if mode == "final_answer":
        return final_answer(text)
    if mode == "last_number":
        return last_number(text)
    if mode == "regex":
        return regex_answer(text, pattern)
    return text


def normal_number(text: Column) -> Column:
    """Text without currency, grouping and percent marks and without one closing dot."""
    return F.regexp_replace(F.translate(strip(text), "$,% ", ""), r"\.$", "")


def answers_match(answer: Column, gold: Column) -> Column:
    """Equal as plain text, as formatted number, or as number within 1e-9."""
    a, g = normal_number(answer), normal_number(gold)
    close = F.abs(a.try_cast("double") - g.try_cast("double")) < 1e-9
    return (normal_text(answer) == normal_text(gold)) | ((a != "") & (a == g)) | F.coalesce(close, F.lit(False))


def _stated_letter(plain: Column) -> Column:
    """Letter a plain text is or numbers (one-based); a number beyond the letters stays; null otherwise."""
    number = plain.try_cast("int")
    return F.when(plain.rlike("^[a-z]$"), F.upper(plain)).when(
        plain.rlike(r"^\d+$"), F.when(number <= 26, F.char(F.lit(64) + F.greatest(number, F.lit(1)))).otherwise(plain)
    )


def _lone_letter(plain: Column) -> Column:
    """First one-letter word of a plain text."""
    return F.upper(F.nullif(F.regexp_extract(plain, r"(?<![^\s])([a-z])(?!\S)", 1), F.lit("")))


def letter_of_plain(plain: Column, choices: Column) -> Column:
    """``choice_letter`` of a text already in plain form."""
    place = F.array_position(F.transform(choices, normal_text), plain)
    named = F.when(F.coalesce(place, F.lit(0)) > 0, F.char(F.lit(64) + place))
    return F.coalesce(_stated_letter(plain), named, _lone_letter(plain), plain)


def choice_letter(value: Column, choices: Column) -> Column:
    """Letter of the choice a text names: a letter, a one-based number, a choice text, or the
    first one-letter word; else the plain text."""
    return letter_of_plain(normal_text(value), choices)


def choice_reading(plain: Column) -> Column:
    """What choosing a letter needs of a plain text, without the text: the letter it states, its hash,
    and its first one-letter word."""
    return F.struct(
        _stated_letter(plain).alias("stated"), F.sha2(plain, 256).alias("hash"), _lone_letter(plain).alias("word")
    )


def letter_of_reading(reading: Column, choice_hashes: Column) -> Column:
    """Letter a reading names among choices given by hash; without any, the hash stands for the text."""
    place = F.array_position(choice_hashes, reading["hash"])
    named = F.when(F.coalesce(place, F.lit(0)) > 0, F.char(F.lit(64) + place))
    return F.coalesce(reading["stated"], named, reading["word"], reading["hash"])


def choice_list(text: Column, separator: str = "|") -> Column:
    """Choices from a JSON array or a separated text, blanks dropped."""
    as_json = F.from_json(strip(text), "array<string>")
    parts = F.filter(F.transform(F.split(text, re.escape(separator)), strip), lambda p: p != "")
    return F.coalesce(F.when(F.size(as_json) > 0, as_json), parts)


def valid_choice_gold(gold: Column, choices: Column) -> Column:
    """A letter in range, a zero-based number in range, or one of the choice texts."""
    plain = strip(gold)
    upper = F.upper(plain)
    place = F.when(F.octet_length(upper) == 1, F.ascii(upper) - 65)
    index = F.when(plain.rlike(r"^[+-]?\d+$"), plain.try_cast("int"))
    hits = [
        place.between(0, F.size(choices) - 1),
        index.between(0, F.size(choices) - 1),
        F.exists(choices, lambda c: F.lower(strip(c)) == F.lower(plain)),
    ]
    found = F.lit(False)
    for hit in hits:
        found = found | F.coalesce(hit, F.lit(False))
    return F.coalesce(plain != "", F.lit(False)) & found


def choice_lines(choices: Column) -> Column:
    """``A. first`` and so on, one choice per line."""
    return F.array_join(
        F.transform(choices, lambda c, i: F.concat(F.char(F.lit(65) + i), F.lit(". "), c)), "\n"
    )


def rendered_prompt(template: Column, text: Column, choices: Column) -> Column:
    """Fill ``{{input}}`` and ``{{choices}}``, blank ``{{gold}}``; no choices leaves their mark alone."""
    filled = F.replace(F.replace(template, F.lit("{{input}}"), text), F.lit("{{gold}}"), F.lit(""))
    with_choices = F.replace(filled, F.lit("{{choices}}"), choice_lines(choices))
    return strip(F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, with_choices).otherwise(filled))


# The prompts used when a task brings none.
CHOICE_TEMPLATE = "Answer the question. Reply with only the letter of the correct choice.\n\n{{input}}\n\n{{choices}}"
NUMBER_TEMPLATE = (
    "Solve the problem. Show your reasoning step by step, then end your reply with a line in the form "
    "'Final answer: <number>'.\n\n{{input}}"
)


def default_template(choices: Column) -> Column:
    return F.when(F.coalesce(F.size(choices), F.lit(0)) > 0, CHOICE_TEMPLATE).otherwise(F.lit(NUMBER_TEMPLATE))


def judge_score(reply: Column) -> Column:
    """Score of a judge reply.

    A JSON object counts by the number in its ``score``; without a number there it scores 0.  A reply that is no
    JSON object, or whose number lies outside 0..1, counts by the first such number in its text.
    """
    found = F.try_parse_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0))
    whole = F.coalesce(F.schema_of_variant(found).startswith("OBJECT"), F.lit(False))
    given = F.try_variant_get(found, "$.score", "variant")
    numeric = F.coalesce(F.schema_of_variant(given).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), F.lit(False))
    number = F.when(numeric, F.try_variant_get(found, "$.score", "double")).otherwise(F.lit(0.0))
    plain = F.nullif(F.regexp_extract(reply, r"(?i)(?:score\D+)?([01](?:\.\d+)?)", 1), F.lit("")).try_cast("double")
    inside = lambda v: F.when(v.between(0.0, 1.0), v)
    return F.coalesce(inside(F.when(whole, number)), inside(plain))


def reward(text: Column) -> Column:
    """``reward`` of a JSON object, else the text as a number."""
    return F.coalesce(
        F.get_json_object(text, "$.reward").try_cast("double"), strip(text).try_cast("double")
    )


def thinking_requested(prompt: Column) -> Column:
    head = strip(prompt)
    return (
        F.when(F.startswith(head, F.lit("/no_think")) | F.contains(prompt, F.lit("\n/no_think")), "disabled")
        .when(F.startswith(head, F.lit("/think")) | F.contains(prompt, F.lit("\n/think")), "enabled")
        .otherwise("unspecified")
    )


def thinking_observed(requested: Column, reasoning: Column) -> Column:
    return (
        F.when(strip(F.coalesce(reasoning, F.lit(""))) != "", "enabled")
        .when(requested == "disabled", "disabled")
        .otherwise("unknown")
    )
