"""A uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

Rows lie in source partitions of bounded size.  How many rows of each source go to each shard is drawn as a
random matrix with the given row and column sums - the law that a uniform permutation of all rows would give.
Each source permutes its rows locally and cuts them by its line of the matrix, the rows are exchanged, and each
shard permutes what it got.  Only counts are drawn centrally: one number per source and shard.

Defined results: shard sizes differ by one at most (law ``rows``); a null text has size 8 and checksum 0; null
ids and repeated rows are rows like any other; other columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from benchloom.llm.common import scaled_parts, stored, table

#: Rows of one source partition and of one slice of a shard.
PART_ROWS = 200_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """How many of ``draws`` from ``good`` + ``bad`` are good, for numbers of any size."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if draws else 0
    # Inversion outward from the mode; the walk is about as long as the deviation.
    lgamma = math.lgamma
    low, high = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (good + bad + 2), low), high)

    def log_choose(n: int, k: int) -> float:
        return lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1)

    at_mode = math.exp(log_choose(good, mode) + log_choose(bad, draws - mode) - log_choose(good + bad, draws))
    left = rng.random() - at_mode
    up = down = mode
    p_up = p_down = at_mode
    while left > 0:
        moved = False
        if up < high:
            p_up *= (good - up) * (draws - up) / ((up + 1) * (bad - draws + up + 1))
            up += 1
            left -= p_up
            moved = True
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (bad - draws + down) / ((good - down + 1) * (draws - down + 1))
            down -= 1
            left -= p_down
            moved = True
            if left <= 0:
                return down
        if not moved or (p_up < 1e-300 and p_down < 1e-300):
            break
    return mode


def communication_matrix(sources: list[int], shards: list[int], seed: int) -> list[list[int]]:
    """Random counts with row sums ``sources`` and column sums ``shards``, drawn cell by cell."""
    rng = np.random.default_rng(seed)
    left = list(shards)
    matrix = []
    for rows in sources:
        line, total = [], sum(left)
        for j, room in enumerate(left):
            n = hypergeometric(rng, room, total - room, rows)
            line.append(n)
            rows -= n
            total -= room
        left = [a - b for a, b in zip(left, line)]
        matrix.append(line)
    return matrix


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 20, part_rows: int = PART_ROWS) -> DataFrame:
    """Every row of ``docs`` with its ``shard`` and its ``slot`` there: ``doc_id``, ``size``, ``text_crc32``,
    ``law``, ``shard``, ``slot``, ``grown_shard``."""
    spark = docs.sparkSession
    bytes_of = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    # ``place`` tells equal rows apart; it is fixed once stored.
    rows = stored(
        docs.select(
            "doc_id",
            (F.octet_length(bytes_of) + 8).cast("long").alias("size"),
            F.crc32(bytes_of).alias("text_crc32"),
            F.monotonically_increasing_id().alias("place"),
        ),
        "rows",
    )
    total = rows.count()
    parts = scaled_parts(total, part_rows)
    key = ["doc_id", "text_crc32", "place"]
    rows = rows.withColumn("source", F.pmod(F.xxhash64(*key, F.lit(seed)), F.lit(parts)).cast("int"))
    # One count per source: a few bytes for every part_rows rows.
    counts = {r["source"]: r["count"] for r in rows.groupBy("source").count().collect()}
    sources = sorted(counts)
    targets = [total // shards + (j < total % shards) for j in range(shards)]
    matrix = communication_matrix([counts[s] for s in sources], targets, seed)
    cuts = []
    for source, line in zip(sources, matrix):
        ends = np.cumsum(line).tolist()
        cuts += [(source, ends)]
    cuts = spark.createDataFrame(cuts, "source int, ends array<long>")

    local = Window.partitionBy("source").orderBy(F.xxhash64(*key, F.lit(seed + 1)), *key)
    sent = (
        rows.withColumn("rank", F.row_number().over(local))
        .join(cuts, "source")
        .withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
        .drop("ends", "rank", "source")
    )
    # The second permutation: a random number orders the shard; slices of its range are ranked on their own.
    slices = scaled_parts(total, part_rows * shards)
    drawn = F.xxhash64(*key, F.lit(seed + 2))
    sent = stored(sent.withColumn("draw", drawn).withColumn("slice", F.pmod(F.shiftright("draw", 40), F.lit(slices))), "sent")
    before = Window.partitionBy("shard").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sent.groupBy("shard", "slice")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("shard", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    )
    inside = Window.partitionBy("shard", "slice").orderBy("draw", *key)
    return (
        sent.withColumn("rank", F.row_number().over(inside))
        .join(offsets, ["shard", "slice"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            "shard",
            (F.col("base") + F.col("rank") - 1).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )


def op4_sharding(spark, folder: str) -> DataFrame:
    return shuffle_into_shards(table(spark, folder, "documents"))


QUERIES = {"op4_sharding": op4_sharding}
