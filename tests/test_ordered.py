"""Ordered work over slices: equal to plain windows, with a key that holds most rows."""

import math
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from benchloom.operators import ordered
from benchloom.operators.measure import last_seen, with_runs
from benchloom.operators.ordered import (
    as_sequence,
    exact_percentiles,
    lookup_by_key,
    with_position,
    with_previous,
    with_running_sum,
)
from benchloom.operators.quality import shard_assign
from benchloom.operators.runs import rank_groups


@pytest.fixture(scope="module", autouse=True)
def eight_slices(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def skewed(spark):
    """20,000 rows, two thirds of them under one key."""
    k = F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 17)
    return spark.range(20000).select(
        k.alias("k"), "id", (F.xxhash64("id") % 1000).alias("v"), (F.xxhash64(F.col("id") * 7) % 3).alias("s")
    )


def same(a, b):
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def test_hot_key_is_cut_into_slices(skewed):
    seq = as_sequence(skewed, ["k"], ["id"])
    sizes = {r[0]: r[1] for r in seq.groupBy("_bucket").count().collect()}
    assert len(sizes) == 8
    assert max(sizes.values()) < 0.3 * 20000
    assert seq.where("k = 0").select("_bucket").distinct().count() > 1


def test_position(skewed):
    got = with_position(as_sequence(skewed, [], ["v", "id"])).select("id", "position")
    want = skewed.select("id", (F.row_number().over(Window.orderBy("v", "id")) - 1).cast("bigint").alias("position"))
    same(got, want)


def test_previous(skewed):
    got = with_previous(as_sequence(skewed, ["k"], ["id"]), ["k"], ["v"]).select("id", "prev_v")
    want = skewed.select("id", F.lag("v").over(Window.partitionBy("k").orderBy("id")).alias("prev_v"))
    same(got, want)


def test_running_sum(skewed):
    got = with_running_sum(as_sequence(skewed, ["k"], ["id"]), ["k"], "v", "total").select("id", "total")
    want = skewed.select("id", F.sum("v").over(Window.partitionBy("k").orderBy("id")).alias("total"))
    same(got, want)


def test_last_seen(skewed):
    rows = skewed.withColumn("x", F.when(F.col("v") % 50 == 0, F.col("v")))
    got = last_seen(rows, ["k"], ["id"], "x", "seen").select("id", "seen")
    want = rows.select("id", F.last("x", True).over(Window.partitionBy("k").orderBy("id")).alias("seen"))
    same(got, want)


def test_islands(skewed):
    got = with_runs(skewed, ["k"], ["id"], ["s"]).groupBy("k", "island").agg(F.count("*").alias("n"), F.min("id").alias("a"))
    w = Window.partitionBy("k").orderBy("id")
    flag = F.when(F.col("s").eqNullSafe(F.lag("s").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    islands = skewed.withColumn("f", flag).withColumn("island", F.sum("f").over(w))
    same(got, islands.groupBy("k", "island").agg(F.count("*").alias("n"), F.min("id").alias("a")))


def test_percentiles(skewed):
    rows = skewed.withColumn("x", ((F.col("v") - 40) / 7).cast("double"))
    got = exact_percentiles(rows, ["k"], "x", {"a": 0.0, "b": 0.5, "c": 0.95, "d": 1.0})
    want = rows.groupBy("k").agg(
        F.count("*").alias("n"), *[F.percentile("x", p).alias(n) for n, p in (("a", 0.0), ("b", 0.5), ("c", 0.95), ("d", 1.0))]
    )
    left = {r.k: r for r in got.collect()}
    right = {r.k: r for r in want.collect()}
    assert left.keys() == right.keys()
    for k, r in right.items():
        assert left[k].n == r.n
        for n in "abcd":
            assert left[k][n] == pytest.approx(r[n], abs=1e-9)


def test_percentiles_of_odd_numbers(spark):
    """Any doubles, null keys and values, single rows, equal values: as a sort has them."""
    r = random.Random(8)
    odd = [0.0, -0.0, 5e-324, -5e-324, 1e308, -1e308, math.inf, -math.inf, 1.0, math.nextafter(1.0, 2.0), -1.5, 2.0**53, 1 / 3]
    rows = [(r.choice(["a", "b", None]), r.choice(odd)) for _ in range(60)] + [("one", -7.25), ("same", 2.5), ("same", 2.5), ("none", None)]
    got = exact_percentiles(spark.createDataFrame(rows, "k string, x double"), ["k"], "x", {"p": 0.25, "q": 2 / 3}).collect()
    groups = {}
    for k, x in rows:
        if x is not None:
            groups.setdefault(k, []).append(x)
    assert {g.k for g in got} == set(groups)
    for g in got:
        xs = sorted(groups[g.k])
        for p, found in ((0.25, g.p), (2 / 3, g.q)):
            rank = p * (len(xs) - 1)
            low, high, weight = xs[math.floor(rank)], xs[math.ceil(rank)], rank - math.floor(rank)
            want = low if weight == 0 else low * (1 - weight) + high * weight
            assert found == want or math.isnan(found) and math.isnan(want)


def test_percentile_of_everything(spark):
    rows = spark.range(101).select(F.col("id").cast("double").alias("x"))
    row = exact_percentiles(rows, [], "x", {"p": 0.25}).first()
    assert (row.n, row.p) == (101, 25.0)
    assert exact_percentiles(rows.where("x < 0"), [], "x", {"p": 0.25}).count() == 0


@pytest.mark.parametrize("few", [ordered.FEW_CELLS, 0])
def test_percentiles_with_and_without_the_filter(skewed, monkeypatch, few):
    monkeypatch.setattr(ordered, "FEW_CELLS", few)
    rows = skewed.withColumn("x", F.sin("id") * 10)
    got = exact_percentiles(rows, ["k"], "x", {"p": 0.9})
    want = rows.groupBy("k").agg(F.percentile("x", 0.9).alias("p"))
    same(got.select("k", F.round("p", 9)), want.select("k", F.round("p", 9)))


@pytest.mark.parametrize("hot_rows", [1, 5000, 10**9])
def test_lookup(skewed, hot_rows):
    per_key = skewed.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("first")).where("n > 400")
    same(lookup_by_key(skewed, per_key, "k", "n", hot_rows).select("id", "first"), skewed.join(per_key, "k").select("id", "first"))


@pytest.mark.parametrize("rows, shards", [(10, 3), (7, 7), (3, 8), (100, 9)])
def test_shards(spark, rows, shards):
    got = {r.id: r.shard for r in shard_assign(spark.range(rows), ["id"], shards).collect()}
    for i in range(shards):
        for p in range(i * rows // shards, (i + 1) * rows // shards):
            assert got[p] == i


def test_rank(spark):
    stats = spark.createDataFrame([("a", 5.0), ("b", 3.0), ("c", 5.0), ("d", None), ("e", 1.0)], "key string, best double")
    up = {r.key: r["rank"] for r in rank_groups(stats, "tok_s_out").collect()}
    down = {r.key: r["rank"] for r in rank_groups(stats, "ttft_ms").collect()}
    assert up == {"a": 1, "c": 1, "b": 3, "e": 4, "d": 5}
    assert down == {"e": 1, "b": 2, "a": 3, "c": 3, "d": 5}
