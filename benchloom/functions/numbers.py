"""Numeric rules shared by the jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_to(value: Column, digits: int) -> Column:
    """Round half away from zero on the scaled value (1.005 to two digits is 1.0)."""
    scale = float(10**digits)
    return F.signum(value) * F.floor(F.abs(value) * scale + 0.5) / scale


def round1(value: Column) -> Column:
    return round_to(value, 1)


def round2(value: Column) -> Column:
    return round_to(value, 2)


def round4(value: Column) -> Column:
    return round_to(value, 4)


def number_field(text: Column) -> Column:
    """A number or numeric text; anything else is 0."""
    return F.coalesce(text.try_cast("double"), F.lit(0.0))


def positive_number(text: Column) -> Column:
    """A number or trimmed numeric text above 0, else null."""
    value = F.trim(text.cast("string")).try_cast("double")
    return F.when(value > 0, value)


def first_positive(texts: Column) -> Column:
    """First positive number in an array of texts."""
    values = F.transform(texts, lambda t: F.trim(t).try_cast("double"))
    return F.try_element_at(F.filter(values, lambda v: v > 0), F.lit(1))


def measured(value: Column) -> Column:
    """A metric value counts only when it is above 0."""
    return F.when(value > 0, value)


# Parts of a metric name that make smaller values better.
LOWER_IS_BETTER_MARKS = ["latency", "ttft", "ms", "watt"]


def lower_is_better(metric: str) -> bool:
    name = metric.lower()
    return any(mark in name for mark in LOWER_IS_BETTER_MARKS)


def lower_is_better_column(metric: Column) -> Column:
    return F.lower(metric).rlike("|".join(LOWER_IS_BETTER_MARKS))


def is_better(value: Column, base: Column, lower: Column) -> Column:
    """Whether ``value`` beats ``base``; against a base of 0 any positive value does."""
    return F.when(base == 0, value > 0).when(lower, (value > 0) & (value < base)).otherwise(value > base)
