"""Streams in several batches give what the batch forms give."""

import random
from collections import Counter
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from benchloom.operators.measure import counter_delta, repeat_runs
from benchloom.streaming import jobs


@pytest.fixture(scope="module", autouse=True)
def few_partitions(spark):
    """Each state partition costs a Python worker per batch; two are enough here."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module", params=["in order", "dealt"])
def feed(request, spark, tables, tmp_path_factory):
    """The event table as files read one per batch: by time, or dealt by a hash with a lateness that spans all of them."""
    folder = str(tmp_path_factory.mktemp("feed"))
    rows = tables.events
    part = F.floor(F.col("event_id") / 400) if request.param == "in order" else F.pmod(F.xxhash64("event_id"), F.lit(4))
    for i in range(4):
        rows.where(part == i).coalesce(1).write.mode("append").parquet(folder)
    table = spark.read.parquet(folder)

    def stream():
        one = jobs.Feed(spark, folder, table.schema, "ts", per_batch=1)
        return jobs.with_event_time(one.rows), one

    return table, stream, "1 hour" if request.param == "in order" else "40 days"


def keys(df, *names):
    return sorted(tuple(r[n] for n in names) for r in df.collect())


YEARS = timedelta(days=4000)


def test_counter_delta_over_batches(feed):
    table, stream, late = feed
    rows, end = stream()
    shape = lambda df: df.select(F.col("user_id").alias("source"), "ts", "event_id", F.floor("value").cast("bigint").alias("counter"))
    got = jobs.run_to_files(jobs.counter_delta(shape(rows), late, YEARS), "d", end)
    want = counter_delta(shape(table), "source", ["ts", "event_id"], ["counter"])
    as_text = lambda df, d: sorted((r.source, r.event_id, r.reset, str(r[d])) for r in df.collect())
    assert as_text(got, "delta") == as_text(want, "counter_delta")


def test_repeats_over_batches(feed):
    table, stream, late = feed
    rows, end = stream()
    few = F.when(F.col("event_type") == "error", "e").otherwise("x")
    steps = lambda df: df.select((F.col("user_id") % 3).alias("run"), "ts", "event_id", few.alias("command"), F.lit("o").alias("output"))
    got = jobs.run_to_files(jobs.repeat_detector(steps(rows), late, YEARS), "r", end)
    runs = repeat_runs(steps(table), "run", ["ts", "event_id"], "command", "output").collect()
    assert got.where("repeats = 3").count() == len(runs)
    assert got.where("action = 'stop'").count() == sum(max(r.length - 5, 0) for r in runs)


def scrapes(spark, folder, rows):
    """Rows (source, seconds, event_id, counter), one file and so one batch for each list."""
    schema = "source long, ts timestamp, event_id long, counter long"
    for batch in rows:
        frame = spark.createDataFrame([(s, datetime(2024, 1, 1, tzinfo=UTC) + timedelta(seconds=t), i, c) for s, t, i, c in batch], schema)
        frame.coalesce(1).write.mode("append").parquet(folder)
    return jobs.Feed(spark, folder, spark.read.parquet(folder).schema, "ts", per_batch=1)


def test_a_silent_key_starts_anew_whether_or_not_its_state_is_gone(spark, tmp_path):
    rows = [(1, 0, 1, 10), (1, 60, 2, 15), (2, 3600, 3, 0), (1, 60 + 600, 4, 20), (1, 60 + 600 + 601, 5, 30), (2, 90_000, 6, 1), (1, 200_000, 7, 4)]
    want = [(1, False, None), (2, False, 5), (3, False, None), (4, False, 5), (5, False, None), (6, False, None), (7, False, None)]
    cuts = [[rows], [rows[:2] + rows[3:5], rows[2:3], rows[5:6], rows[6:]]]
    for n, cut in enumerate(cuts):
        one = scrapes(spark, str(tmp_path / f"in{n}"), cut)
        got = jobs.run_to_files(jobs.counter_delta(one.rows, "2 hours", timedelta(minutes=10)), "forget", one)
        assert keys(got, "event_id", "reset", "delta") == want


def test_scrapes_without_a_value_are_passed_over(spark, tmp_path):
    one = scrapes(spark, str(tmp_path / "in"), [[(1, 0, 1, None), (1, 1, 2, 5), (1, 2, 3, None)], [(1, 7200, 4, None), (1, 7201, 5, 3), (1, 7202, 6, 9)]])
    got = jobs.run_to_files(jobs.counter_delta(one.rows, "1 hour"), "nulls", one)
    assert keys(got, "event_id", "reset", "delta") == [
        (1, False, None), (2, False, None), (3, False, None), (4, False, None), (5, True, None), (6, False, 6),
    ]


def test_in_time_and_late_rows_are_all_rows(spark, tmp_path):
    r = random.Random(3)
    rows = [(i % 3, i * 60 - r.randrange(7200), i, None) for i in range(300)]
    ahead, want = {}, []
    for s, t, i, _ in rows:
        behind = max(0, ahead.get(s, t) - t)
        want.append((i, behind > 1800, behind * 1_000_000))
        ahead[s] = max(ahead.get(s, t), t)
    for n, cut in enumerate([[rows], [rows[k : k + 75] for k in range(0, 300, 75)]]):
        one = scrapes(spark, str(tmp_path / f"in{n}"), cut)
        got = jobs.run_to_files(jobs.mark_late(one.rows, timedelta(minutes=30)), "late", split_by=["late"])
        assert keys(got, "event_id", "late", "behind") == want
        assert {f.rsplit("/", 2)[1] for f in got.inputFiles()} == {"late=true", "late=false"}
        counts = {x["source"]: (x["in_time"], x["late"], x["most_behind"]) for x in jobs.late_counts(got).collect()}
        for s in range(3):
            own = [w for w, row in zip(want, rows) if row[0] == s]
            assert counts[s] == (sum(not w[1] for w in own), sum(w[1] for w in own), max(w[2] for w in own))


def test_notices_once_per_change(spark, tmp_path):
    states = ["warning", "warning", "failed", "ok", "ok", "warning"]
    for i, s in enumerate(states):
        row = spark.createDataFrame([(1, "m", i, s)], "listing long, model string, event_id long, state string")
        row.withColumn("ts", F.timestamp_seconds(F.col("event_id") + 1_700_000_000)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    one = jobs.Feed(spark, str(tmp_path / "in"), schema, "ts", per_batch=1)
    assert keys(jobs.run_to_files(jobs.change_notices(one.rows), "n", one), "event_id", "state") == [(0, "warning"), (2, "failed"), (5, "warning")]


def test_sales_over_batches(feed):
    table, stream, late = feed
    sales = lambda df: df.select("ts", F.col("event_id").alias("input_tokens"), F.col("user_id").alias("output_tokens"), F.lit(1).alias("earned"))
    rows, end = stream()
    got = jobs.run_to_files(jobs.daily_sales(sales(rows), late), "s", end).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "input_tokens")
    want = table.groupBy(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(F.sum("event_id").alias("input_tokens"))
    assert keys(got, "day", "input_tokens") == keys(want, "day", "input_tokens")

    rows, end = stream()
    got = jobs.run_to_files(jobs.recent_sales(sales(rows), late), "h", end)
    hours = Counter()
    for x in table.select(F.unix_seconds(F.col("ts").cast("timestamp")).alias("t")).collect():
        hours.update(x["t"] // 3600 + k for k in range(1, 25))
    assert {x["u"] // 3600: x["requests"] for x in got.select(F.unix_seconds("until").alias("u"), "requests").collect()} == hours


def test_recent_sales_copy_hours_and_not_rows(feed):
    rows, _ = feed[1]()
    plan = jobs.recent_sales(rows.select("ts", "user_id", F.lit(1).alias("output_tokens"), F.lit(1).alias("earned")))
    text = plan._jdf.queryExecution().analyzed().toString()
    # Read upwards: the first aggregate over the rows is the one by hour, the windows come after it.
    assert text.count("Aggregate") == 2 and text.rindex("Aggregate") > text.rindex("Expand") if "Expand" in text else True


def test_run_state_updates(feed):
    table, stream, _ = feed
    shape = lambda df: df.select(
        (F.col("user_id") % 5).alias("run"), "ts", F.when(F.col("event_type") == "signup", "started").otherwise("task").alias("event"),
        (F.col("event_id") % 2 == 0).alias("scored"), F.lit(True).alias("passed"),
    )
    got = jobs.run_updates(jobs.run_state(shape(stream()[0])), ["run"], "u")
    want = jobs.run_state(shape(jobs.with_event_time(table)))
    assert keys(got, "run", "scored", "unscored", "state") == keys(want, "run", "scored", "unscored", "state")


def test_dedupe_over_batches(feed):
    """A question that is sent again, however much later, comes out once, with its newest row."""
    table, stream, _ = feed
    shape = lambda df: df.select("event_type", "ts", "event_id", "user_id")
    got = jobs.run_updates(jobs.dedupe_results(shape(stream()[0].where("event_id IS NOT NULL")), ["event_type"]), ["event_type"], "x")
    want = table.groupBy("event_type").agg(F.max("event_id").alias("event_id"), F.max_by("user_id", "event_id").alias("user_id"))
    assert keys(got, "event_type", "event_id", "user_id") == keys(want, "event_type", "event_id", "user_id")


@pytest.mark.parametrize("stored", ["file", "folder"])
def test_a_table_is_a_file_or_a_folder(spark, tmp_path, stored):
    """Large tables are folders of files; a stream of one has all rows."""
    rows = spark.range(40).select("id", F.lit(datetime(2024, 1, 1)).alias("ts")).repartition(1 if stored == "file" else 4)
    rows.write.parquet(str(tmp_path / "made"))
    table = tmp_path / "labels.parquet"
    if stored == "file":
        next((tmp_path / "made").glob("*.parquet")).rename(table)
    else:
        (tmp_path / "made").rename(table)
    (tmp_path / "labels.parquex").mkdir()
    schema = spark.read.parquet(str(table)).schema
    got = jobs.run_to_files(jobs.read_stream(spark, str(table), schema, per_batch=1), "whole")
    assert sorted(r.id for r in got.collect()) == list(range(40))
    fed = jobs.Feed(spark, str(table) + "/", schema, "ts")
    assert jobs.run_to_files(jobs.watermarked(fed.rows, "1 hour"), "fed", fed).count() == 40
