"""Ordered work without putting a whole key, or the whole table, in one task.

``as_sequence`` sorts rows over all executors and stores them with the number
of the sorted slice (``_bucket``) and the place inside it (``_row``).  Slices
are cut by row order, not by key, so a key holding a third of all rows is
spread over many of them.  Window functions then run inside slices, and one
row per slice carries what has to cross a border.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.session import materialize


def _in_slice():
    return Window.partitionBy("_bucket").orderBy("_row")


def _slices():
    """Over the slice table, which has one row per sorted slice."""
    return Window.orderBy("_bucket")


def _key(keys: Sequence[str]) -> Column:
    return F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)


def as_sequence(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Rows sorted by ``keys`` then ``order`` (make ``order`` unique), stored with slice and place."""
    ordered = df.orderBy(*keys, *order).withColumn("_id", F.monotonically_increasing_id())
    return materialize(
        ordered.select(
            *df.columns,
            F.shiftright("_id", 33).alias("_bucket"),
            F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)).alias("_row"),
        ),
        "sequence",
    )


def with_position(seq: DataFrame, name: str = "position") -> DataFrame:
    """Zero-based place of each row in the whole sequence."""
    starts = (
        seq.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "_bucket",
            F.coalesce(F.sum("_n").over(_slices().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"),
        )
    )
    # One row per sorted slice, so never more rows than shuffle partitions.
    return seq.join(F.broadcast(starts), "_bucket").withColumn(name, F.col("_start") + F.col("_row")).drop("_start")


def with_previous(seq: DataFrame, keys: Sequence[str], columns: Sequence[str], prefix: str = "prev_") -> DataFrame:
    """Add the values of the previous row of the same key (null on its first row)."""
    seq = seq.withColumn("_here", F.struct(_key(keys).alias("k"), *[F.col(c) for c in columns]))
    last = (
        seq.groupBy("_bucket")
        .agg(F.max_by("_here", "_row").alias("_last"))
        .select("_bucket", F.lag("_last").over(_slices()).alias("_border"))
    )
    seq = seq.join(F.broadcast(last), "_bucket").withColumn(
        "_before", F.coalesce(F.lag("_here").over(_in_slice()), F.col("_border"))
    )
    same = F.col("_before.k").eqNullSafe(F.col("_here.k"))
    for c in columns:
        seq = seq.withColumn(prefix + c, F.when(same, F.col(f"_before.{c}")))
    return seq.withColumn(prefix + "exists", F.col("_before").isNotNull() & same).drop("_here", "_border", "_before")


def with_running_sum(seq: DataFrame, keys: Sequence[str], value: str | Column, name: str) -> DataFrame:
    """Add the sum of ``value`` over this and all earlier rows of the same key."""
    value = F.col(value) if isinstance(value, str) else value
    inside = Window.partitionBy("_bucket", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    seq = seq.withColumn("_k", _key(keys)).withColumn("_run", F.sum(value).over(inside))
    edges = seq.groupBy("_bucket").agg(
        F.min_by("_k", "_row").alias("_first"), F.max_by("_k", "_row").alias("_last"), F.max_by("_run", "_row").alias("_tail")
    )
    same_key = Window.partitionBy("_last").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_upto", F.sum("_tail").over(same_key))
    carry = edges.select(
        "_bucket",
        "_first",
        F.when(F.lag("_last").over(_slices()).eqNullSafe(F.col("_first")), F.lag("_upto").over(_slices())).alias("_carry"),
    )
    return (
        seq.join(F.broadcast(carry), "_bucket")
        .withColumn(
            name,
            F.col("_run") + F.when(F.col("_k").eqNullSafe(F.col("_first")), F.coalesce("_carry", F.lit(0))).otherwise(0),
        )
        .drop("_k", "_run", "_first", "_carry")
    )


def drop_marks(df: DataFrame) -> DataFrame:
    return df.drop("_bucket", "_row")


# A key with at least this many rows is hot.  A table of r rows has at most r / HOT_ROWS hot keys, so
# the hot side of a lookup stays small enough to send to every executor: 1e11 rows give 1e5 keys.
HOT_ROWS = 1_000_000


def lookup_by_key(rows: DataFrame, per_key: DataFrame, key: str, count: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Join rows to a table with one row per key, without moving the rows of hot keys.

    ``count`` is the number of rows a key has.  Hot keys are sent to the rows; the other keys
    meet their rows in a shuffle that no longer holds a large group.
    """
    hot = F.broadcast(per_key.where(F.col(count) >= hot_rows))
    cold = per_key.where(F.col(count) < hot_rows)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))


def _as_ordered_long(value: Column) -> Column:
    """A double as the whole number of 64 bits that has the same place in the order (NaN comes last, as in a sort)."""
    # Adding zero makes one number of the two zeros.
    plain = value.cast("double") + F.lit(0.0)
    bits = F.reflect(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), plain).cast("long")
    return F.when(bits >= 0, bits).otherwise(bits.bitwiseXOR(F.lit((1 << 63) - 1)))


def _from_ordered_long(number: Column) -> Column:
    bits = F.when(number >= 0, number).otherwise(number.bitwiseXOR(F.lit((1 << 63) - 1)))
    return F.reflect(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), bits).cast("double")


# Bits of the middle and of the low digit of a number; its high digit has the other 22: values that differ by 0.1 % or less share it.
MIDDLE, LOW = 21, 21
# So many cells of wanted values are sent to the rows, 8 bytes each.
FEW_CELLS = 256


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, points: dict[str, float]) -> DataFrame:
    """Per key: the count ``n`` and linearly interpolated percentiles, exact for groups of any size.

    Values are selected by digits of order-preserving whole numbers.  A first pass counts high digits; they tell in which cell
    - key and high digit - each wanted value lies.  A second pass counts the values of those cells only, by middle and by low digit.
    The cells are a filter on the second scan when they are few, which Spark finds out while it runs; else the counts meet them
    in a join.  All counts are summed before they are moved, ranks are taken over counts of digits, and nothing is stored, so
    neither a key with a third of all rows nor one with all values different is ever put together in one task.
    """
    names = [f"_k{i}" for i in range(len(keys))]
    number = _as_ordered_long(F.col(value))
    rows = df.where(F.col(value).isNotNull()).select(*[F.col(k).alias(n) for k, n in zip(keys, names)], number.alias("_u"))
    high, middle, low = (
        F.shiftright("_u", MIDDLE + LOW),
        F.shiftright("_u", LOW).bitwiseAND(F.lit((1 << MIDDLE) - 1)),
        F.col("_u").bitwiseAND(F.lit((1 << LOW) - 1)),
    )

    # High digits: their counts give the count of the key, and with it the wanted places (two for each percentile).
    cells = rows.groupBy(*names, high.alias("_high")).agg(F.count(F.lit(1)).alias("_c"))
    upto = Window.partitionBy(*names).orderBy("_high").rowsBetween(Window.unboundedPreceding, 0)
    cells = cells.withColumn("n", F.sum("_c").over(Window.partitionBy(*names))).withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
    rank = lambda p: F.lit(float(p)) * (F.col("n") - 1)
    places = [
        F.struct(F.lit(2 * i + side).alias("place"), to_whole(rank(p)).cast("long").alias("rank"))
        for i, p in enumerate(points.values())
        for side, to_whole in ((0, F.floor), (1, F.ceil))
    ]
    here = F.filter(F.array(*places), lambda x: (x["rank"] >= F.col("_before")) & (x["rank"] < F.col("_before") + F.col("_c")))
    wanted = cells.withColumn("_x", F.explode(here)).select(
        *names, "_high", "n", F.col("_x.place").alias("_place"), (F.col("_x.rank") - F.col("_before")).alias("_rank")
    )

    cell = F.xxhash64(*names, "_high")
    few = wanted.select(cell.alias("_cell")).distinct().limit(FEW_CELLS + 1).agg(F.collect_list("_cell").alias("_cells"))
    few = few.select(F.when(F.size("_cells") <= FEW_CELLS, F.col("_cells"))).scalar()
    inside = rows.withColumn("_high", high).where(F.coalesce(F.array_contains(few, cell), F.lit(True)))
    counts = inside.groupBy(*names, "_high", middle.alias("_middle"), low.alias("_low")).agg(F.count(F.lit(1)).alias("_c"))

    def chosen(sums: DataFrame, wanted: DataFrame, by: list[str], digit: str) -> DataFrame:
        """The digit in which each wanted place lies, and its rank there."""
        on = [F.col(f"s.{c}").eqNullSafe(F.col(f"w.{c}")) for c in by]
        met = sums.alias("s").join(wanted.alias("w"), on).select(*[F.col(f"s.{c}").alias(c) for c in by], digit, "_c", "n", "_place", "_rank")
        upto = Window.partitionBy(*names, "_place").orderBy(digit).rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("_before", F.sum("_c").over(upto) - F.col("_c"))
        met = met.where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_c")))
        return met.select(*by, digit, "n", "_place", (F.col("_rank") - F.col("_before")).alias("_rank"))

    by = [*names, "_high"]
    wanted = chosen(counts.groupBy(*by, "_middle").agg(F.sum("_c").alias("_c")), wanted, by, "_middle")
    wanted = chosen(counts, wanted, [*by, "_middle"], "_low")
    whole = F.shiftleft("_high", MIDDLE + LOW) + F.shiftleft("_middle", LOW) + F.col("_low")
    found = wanted.withColumn("_v", _from_ordered_long(whole))
    at = lambda place: F.max(F.when(F.col("_place") == place, F.col("_v")))
    wide = found.groupBy(*names).agg(F.max("n").alias("n"), *[at(j).alias(f"_v{j}") for j in range(2 * len(points))])
    wide = wide.where(F.col("n").isNotNull())
    result = [F.col(n).alias(k) for k, n in zip(keys, names)] + [F.col("n")]
    for i, (name, p) in enumerate(points.items()):
        below, above, weight = F.col(f"_v{2 * i}"), F.col(f"_v{2 * i + 1}"), rank(p) - F.floor(rank(p))
        result.append(F.when(weight == 0, below).otherwise(below * (1 - weight) + above * weight).alias(name))
    return wide.select(*result)
