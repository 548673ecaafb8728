"""Set comparisons: warnings, disagreeing names, changed fields and equal id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.text import strip


def merged_warnings(*lists: Column) -> Column:
    """All warnings in order, trimmed, without blanks and repeats."""
    every = F.concat(*[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(every, strip), lambda w: F.coalesce(w, F.lit("")) != ""))


def merge_warnings(rows: DataFrame, columns: Sequence[str], name: str = "warnings") -> DataFrame:
    return rows.withColumn(name, merged_warnings(*[F.col(c) for c in columns]))


def set_mismatch(rows: DataFrame, key: str, sources: Sequence[str]) -> DataFrame:
    """Pairs of sources that name different values for a row; blanks never disagree, case is ignored.

    The few sources are columns, so pairs are formed inside the row.
    """
    pairs = [(a, b) for i, a in enumerate(sources) for b in sources[i + 1 :]]
    plain = lambda c: F.coalesce(F.col(c), F.lit(""))
    found = F.array_compact(
        F.array(
            *[
                F.when(
                    (plain(a) != "") & (plain(b) != "") & (F.lower(strip(plain(a))) != F.lower(strip(plain(b)))),
                    F.struct(
                        F.lit(a).alias("left_source"),
                        F.col(a).alias("left"),
                        F.lit(b).alias("right_source"),
                        F.col(b).alias("right"),
                    ),
                )
                for a, b in pairs
            ]
        )
    )
    return rows.select(key, F.explode(found).alias("m")).select(key, "m.*")


def changed_fields(expected: DataFrame, actual: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Fields whose value differs between two fingerprints or that only one of them has.

    A side without any field for an owner counts as no fingerprint: nothing is reported for it when
    the expected side is empty.
    """
    owner = keys[:-1]
    rows = expected.select(*keys, F.col(value).alias("_e"), F.lit(True).alias("_in_e")).join(
        actual.select(*keys, F.col(value).alias("_a"), F.lit(True).alias("_in_a")), list(keys), "full_outer"
    )
    changed = rows.where(
        F.col("_in_e").isNull() | F.col("_in_a").isNull() | ~F.col("_e").eqNullSafe(F.col("_a"))
    )
    known = expected.select(*owner).distinct()
    change = F.when(F.col("_in_e").isNull(), "added").when(F.col("_in_a").isNull(), "removed").otherwise("changed")
    return changed.join(known, list(owner), "left_semi").select(*keys, change.alias("change"))


def added_only(changes: DataFrame, expected: DataFrame, owner: str, field: str, name: str, empty: str) -> DataFrame:
    """Owners whose only change is that ``name`` went from the ``empty`` mark to a value."""
    unset = expected.where((F.col(field) == name) & (F.col("value") == empty)).select(owner).distinct()
    single = changes.groupBy(owner).agg(F.count(F.lit(1)).alias("_n"), F.min(field).alias("_f"))
    return single.where((F.col("_n") == 1) & (F.col("_f") == name)).join(unset, owner, "left_semi").select(owner)


def same_set(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Whether two id lists hold the same ids equally often (one row)."""
    tagged = left.select(key, F.lit(1).alias("_d")).unionByName(right.select(key, F.lit(-1).alias("_d")))
    sums = tagged.groupBy(key).agg(F.sum("_d").alias("_d"))
    return sums.agg((F.count_if(F.col("_d") != 0) == 0).alias("same"), F.count_if(F.col("_d") != 0).alias("differing"))
