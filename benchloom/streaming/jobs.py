"""Continuous forms of the status, sales, repeat, counter and coverage jobs."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.readwriter import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from benchloom.operators.measure import request_metrics
from benchloom.session import new_path
from benchloom.streaming.processors import ChangeNotices, CounterDelta, LateRows, RepeatDetector

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"

#: No event is as late as this; a row with this time ends a stream.
END = "9999-01-01 00:00:00"


def read_stream(spark: SparkSession, path: str, schema: T.StructType, per_batch: int = 1 << 27) -> DataFrame:
    """A parquet table, one file or a folder of files, as a stream; a batch takes files of at most ``per_batch`` bytes (one at
    least), so a backlog is worked off in bounded steps.  Results do not depend on it."""
    # A plain path of a stream may only be a folder; a pattern, here of the last letter, finds a file as well.
    path = path.rstrip("/")
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


class Feed:
    """A table, one file or a folder of files, as a stream that can be ended.

    Windows, sessions and rows put aside come out when the watermark passes them, and the watermark follows the events; so what came
    last would wait for ever.  ``end`` puts one row without values and with the time ``END`` beside the data, and the watermark
    passes everything.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, time: str, per_batch: int = 1 << 27):
        self.spark, self.time = spark, time
        self.last = spark.createDataFrame([], schema)
        self.beside = new_path(spark, "feed-end")
        self.last.write.parquet(self.beside)
        data = read_stream(spark, path, schema, per_batch)
        self.rows = data.unionByName(read_stream(spark, self.beside, schema))

    def end(self) -> None:
        row = self.spark.range(1).select(
            *[(F.lit(END) if f.name == self.time else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.last.schema]
        )
        row.coalesce(1).write.mode("append").parquet(self.beside)


def watermarked(df: DataFrame, late: str, time: str = "ts") -> DataFrame:
    """``df`` with a watermark, without the row that ends it.  The filter names the event time, so Spark keeps it above the watermark."""
    return df.withWatermark(time, late).where(F.col(time) < F.lit(END).cast("timestamp"))


def with_event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Event time as a point in time (UTC session); a watermark does not take local times."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def _run(writer: DataStreamWriter, path: str, feed: Feed | None) -> None:
    """Process everything available; then end the feed, if there is one, and process what that releases."""
    writer = writer.option("checkpointLocation", path + "-checkpoint").trigger(availableNow=True)
    writer.start().awaitTermination()
    if feed is not None:
        feed.end()
        writer.start().awaitTermination()


def run_to_files(df: DataFrame, name: str, feed: Feed | None = None, split_by: Sequence[str] = ()) -> DataFrame:
    """Process everything available into files, each row once, and read them back; ``split_by`` gives each value of
    these columns a folder of its own."""
    path = new_path(df.sparkSession, name)
    writer = df.writeStream.format("parquet").outputMode("append").option("path", path)
    _run(writer.partitionBy(*split_by) if split_by else writer, path, feed)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def run_updates(df: DataFrame, keys: Sequence[str], name: str, feed: Feed | None = None) -> DataFrame:
    """Process everything available in update mode and read back the latest row of each key.

    Batches are written under their number, so a repeated batch replaces its own rows.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    spark.conf.set(CHANGELOG, "true")
    path = new_path(spark, name)

    def store(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    _run(df.writeStream.outputMode("update").foreachBatch(store), path, feed)
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(path)
    kept = F.struct(*[c for c in df.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(kept, "batch").alias("_r")).select(*keys, "_r.*")


# ---------------------------------------------------------------- aggregates


def run_state(events: DataFrame) -> DataFrame:
    """State of each run from its events (run, ts, event, scored, passed).

    A completed run stays completed; else a loss after the last start means interrupted; else it runs.
    Partial sums are formed before the shuffle, so a busy run is no burden for one task.
    """
    at = lambda event: F.max(F.when(F.col("event") == event, F.col("ts")))
    rows = events.groupBy("run").agg(
        F.count_if((F.col("event") == "task") & F.col("scored")).alias("scored"),
        F.count_if((F.col("event") == "task") & F.col("scored") & F.col("passed")).alias("passed"),
        F.count_if((F.col("event") == "task") & ~F.col("scored")).alias("unscored"),
        F.max("ts").alias("last_activity"),
        at("completed").alias("_done"),
        at("started").alias("_start"),
        at("lost").alias("_lost"),
    )
    state = (
        F.when(F.col("_done").isNotNull(), "completed")
        .when(F.col("_lost") >= F.coalesce("_start", F.lit("1970-01-01").cast("timestamp")), "interrupted")
        .otherwise("running")
    )
    return rows.select("run", "scored", "passed", "unscored", "last_activity", state.alias("state"))


def daily_sales(sales: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tokens and earnings per day; a day is final once the watermark has passed it."""
    days = watermarked(sales, late).groupBy(F.window("ts", "1 day"))
    return days.agg(
        F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("earned").alias("earned")
    ).select(F.col("window.start").alias("day"), "input_tokens", "output_tokens", "earned")


def recent_sales(sales: DataFrame, late: str = "1 hour") -> DataFrame:
    """Totals of the last 24 hours, renewed every hour.

    Sales are summed once per hour; the windows are made of at most one row an hour, whatever is sold.
    """
    hours = watermarked(sales, late).groupBy(F.window("ts", "1 hour").alias("hour")).agg(
        F.count(F.lit(1)).alias("requests"), F.sum("output_tokens").alias("output_tokens"), F.sum("earned").alias("earned")
    )
    windows = hours.groupBy(F.window(F.window_time("hour"), "24 hours", "1 hour"))
    return windows.agg(
        F.sum("requests").alias("requests"), F.sum("output_tokens").alias("output_tokens"), F.sum("earned").alias("earned")
    ).select(F.col("window.end").alias("until"), "requests", "output_tokens", "earned")


def request_sessions(tokens: DataFrame, keys: Sequence[str], gap: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Timing of each request from its token events; a request ends when nothing follows within ``gap``.

    ``kind`` is token for an output token; anything else only marks time.
    """
    ms = F.unix_micros("ts") / 1000
    token = F.when(F.col("kind") == "token", ms)
    sessions = watermarked(tokens, late).groupBy(*keys, F.session_window("ts", gap))
    rows = sessions.agg(
        F.min(ms).alias("started"),
        F.min(token).alias("first_token"),
        F.max(token).alias("last_token"),
        F.max(ms).alias("completed"),
        F.count(token).alias("output_tokens"),
        F.max("prompt_tokens").alias("prompt_tokens"),
    )
    return request_metrics(rows.withColumn("start", F.col("session_window.start")).drop("session_window"))


def dedupe_results(results: DataFrame, keys: Sequence[str], order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """The newest result of each question, however long after the first it was sent again.

    One row of state per question, which does not expire; run it with ``run_updates``.  Equal places in the order are one row.
    """
    newest = F.max(F.struct(*order, *[c for c in results.columns if c not in (*keys, *order)])).alias("_newest")
    return results.groupBy(*keys).agg(newest).select(*keys, "_newest.*")


def coverage_join(results: DataFrame, catalog: DataFrame, key: str) -> DataFrame:
    """Results as they come beside the stored data set catalog."""
    return results.join(catalog, key, "left")


# ---------------------------------------------------------------- state per key


def _stateful(df: DataFrame, keys: Sequence[str], processor: StatefulProcessor, schema: str, time: str) -> DataFrame:
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    df.sparkSession.conf.set(CHANGELOG, "true")
    return df.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=schema, outputMode="Append", timeMode=time
    )


def _ms(span: timedelta) -> int:
    return span // timedelta(milliseconds=1)


def change_notices(checks: DataFrame, late: str = "1 hour", forget: timedelta = timedelta(days=30)) -> DataFrame:
    """Notices of (listing, model, ts, event_id, state): once per change, not on every refresh.  A listing that was silent for
    longer than ``forget`` starts anew."""
    schema = "listing long, model string, event_id long, state string"
    return _stateful(watermarked(checks, late), ["listing", "model"], ChangeNotices(_ms(forget)), schema, "EventTime")


def repeat_detector(steps: DataFrame, late: str = "1 hour", forget: timedelta = timedelta(days=1)) -> DataFrame:
    """Warnings and stops of (run, ts, event_id, command, output); a run that rested for longer than ``forget`` starts anew."""
    rows = watermarked(steps, late)
    rows = rows.withColumn("print", F.sha2(F.concat("command", F.lit("\0"), "output"), 256)).drop("command", "output")
    return _stateful(rows, ["run"], RepeatDetector(_ms(forget)), "run long, event_id long, repeats long, action string", "EventTime")


def counter_delta(scrapes: DataFrame, late: str = "1 hour", forget: timedelta = timedelta(days=7)) -> DataFrame:
    """Growth per scrape of (source, ts, event_id, counter); a source without a scrape for longer than ``forget`` starts anew."""
    schema = "source long, event_id long, reset boolean, delta long"
    return _stateful(watermarked(scrapes, late), ["source"], CounterDelta(_ms(forget)), schema, "EventTime")


def mark_late(rows: DataFrame, lateness: timedelta) -> DataFrame:
    """Rows (source, event_id in arrival order, ts) as ``source``, ``event_id``, ``at_us``, ``late`` and ``behind``:
    how far the source's clock was ahead.  Nothing is dropped: write them with ``split_by=["late"]`` for one output each.
    """
    known = rows.where(F.col("ts") < F.lit(END).cast("timestamp")).select("source", "event_id", F.unix_micros("ts").alias("at_us"))
    schema = "source long, event_id long, at_us long, late boolean, behind long"
    return _stateful(known, ["source"], LateRows(lateness // timedelta(microseconds=1)), schema, "None")


def late_counts(marked: DataFrame) -> DataFrame:
    """Rows in time, rows late and the largest delay in microseconds per source."""
    return marked.groupBy("source").agg(
        F.count_if(~F.col("late")).alias("in_time"), F.count_if("late").alias("late"), F.max("behind").alias("most_behind")
    )
