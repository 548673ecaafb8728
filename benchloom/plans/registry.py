"""Queries by name, each with the SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from benchloom.plans.fixtures import FIXTURES, LARGE, TABLES, with_fixtures
from benchloom.session import ship, spread

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The given tables and the stand-in record sets built from them, read on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        ship(spark)
        self.spark = spark
        self.folder = folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name not in self._known:
            if name in TABLES:
                table = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
                self._known[name] = spread(table) if name in LARGE else table
            elif name in FIXTURES:
                needs, sql = FIXTURES[name]
                self._known[name] = self.spark.sql(
                    sql.format(**{n: "{" + n + "}" for n in needs}), **{n: getattr(self, n) for n in needs}
                )
            else:
                raise AttributeError(name)
        return self._known[name]


def query(name: str, oracle: str | None = None):
    """Register a query; ``oracle`` may use the stand-in record sets by name."""

    def register(build: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle)
        return build

    return register


def r(value: str, digits: int) -> str:
    """The library's rounding rule as SQL for the checking engine."""
    scale = 10**digits
    return f"(sign({value})*floor(abs({value})*{scale}+0.5)/{scale})"


def r1(value: str) -> str:
    return r(value, 1)


def r2(value: str) -> str:
    return r(value, 2)


def r4(value: str) -> str:
    return r(value, 4)


def pct(value: str, point: float) -> str:
    """Interpolated percentile of a group written out, as SQL."""
    ordered = f"list_sort(list({value}) FILTER (WHERE {value} IS NOT NULL))"
    rank = f"({point}::double * (count({value}) - 1))"
    return (
        f"({ordered}[cast(floor({rank}) AS int) + 1] * (1 - ({rank} - floor({rank}))) + "
        f"{ordered}[cast(ceil({rank}) AS int) + 1] * ({rank} - floor({rank})))"
    )
