"""Nested JSON documents as flat fields."""

from __future__ import annotations

import json
from decimal import Decimal

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

ENTRY = "array<struct<field:string,value:string,kind:string,key:string,depth:int,place:string>>"


def _shown(value) -> tuple[str, str]:
    if value is None:
        return "null", "null"
    if isinstance(value, bool):
        return ("true" if value else "false"), "bool"
    if isinstance(value, Decimal):
        text = format(value, "f")
        return (text.rstrip("0").rstrip(".") if "." in text else text), "number"
    if isinstance(value, int):
        return str(value), "number"
    return value, "string"


def _entries(text: str) -> list[tuple] | None:
    try:
        root = json.loads(text, parse_float=Decimal)
    except (TypeError, ValueError):
        return None
    out: list[tuple] = []
    todo = [("", "", "", 0, root)]
    while todo:
        field, key, place, depth, value = todo.pop()
        if isinstance(value, dict) and value:
            for k in sorted(value, reverse=True):
                todo.append((f"{field}.{k}" if field else k, k, f"{place}\x01{k}", depth + 1, value[k]))
        elif isinstance(value, list) and value:
            for i in range(len(value) - 1, -1, -1):
                todo.append((f"{field}[{i}]", "", f"{place}\x01{i:010d}", depth + 1, value[i]))
        elif isinstance(value, (dict, list)):
            out.append((field, "{}" if isinstance(value, dict) else "[]", "empty", key, depth, place))
        else:
            out.append((field, *_shown(value), key, depth, place))
    return out


def flat_entries(text: Column) -> Column:
    """Leaves of a JSON text in field order: ``a.b[0].c``, value text, kind, last key, depth and place.

    Nesting has no fixed depth, which no built-in can walk; texts go over in Arrow batches.
    """

    @F.pandas_udf(ENTRY)
    def walk(texts: pd.Series) -> pd.Series:
        return texts.map(_entries)

    return walk(text)


# Keys that hold an answer.
ANSWER_KEYS = ["gold", "answer", "referenceAnswer", "expectedAnswer", "correctAnswer", "label", "target"]


def _without(value, keys: frozenset):
    if isinstance(value, dict):
        return {k: _without(v, keys) for k, v in value.items() if k not in keys}
    if isinstance(value, list):
        return [_without(v, keys) for v in value]
    return value


def without_keys(text: Column, keys: list[str]) -> Column:
    """A JSON text without the given keys at any depth; text that is no JSON becomes null."""
    wanted = frozenset(keys)

    def one(raw):
        try:
            return json.dumps(_without(json.loads(raw), wanted), ensure_ascii=False, separators=(",", ":"))
        except (TypeError, ValueError):
            return None

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        return texts.map(one)

    return clean(text)
