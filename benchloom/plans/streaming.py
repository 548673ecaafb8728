"""Streaming jobs over the event, label and document tables, each run until nothing is left."""

from datetime import timedelta

from pyspark.sql import functions as F

from benchloom.plans.registry import query, r1, r2
from benchloom.functions.numbers import round2
from benchloom.streaming import jobs


def event_feed(t):
    """The events as a stream that ends, and what ends it."""
    feed = jobs.Feed(t.spark, f"{t.folder}/events.parquet", t.events.schema, "ts")
    return jobs.with_event_time(feed.rows), feed


def event_stream(t):
    return jobs.with_event_time(jobs.read_stream(t.spark, f"{t.folder}/events.parquet", t.events.schema))


@query(
    "stream_run_state",
    """WITH s AS (SELECT user_id AS run, count(CASE WHEN event_type IN ('click', 'error') AND event_id % 3 > 0 THEN 1 END) AS scored,
         count(CASE WHEN event_type IN ('click', 'error') AND event_id % 3 > 0 AND event_type = 'click' THEN 1 END) AS passed,
         count(CASE WHEN event_type IN ('click', 'error') AND event_id % 3 = 0 THEN 1 END) AS unscored, max(epoch_us(ts)) AS last_activity,
         max(CASE WHEN event_type = 'purchase' AND event_id % 50 = 0 THEN ts END) AS done, max(CASE WHEN event_type = 'signup' THEN ts END)
         AS start, max(CASE WHEN event_type = 'view' THEN ts END) AS lost FROM events GROUP BY user_id)
       SELECT run, scored, passed, unscored, last_activity, CASE WHEN done IS NOT NULL THEN 'completed' WHEN lost >= coalesce(start,
         TIMESTAMP '1970-01-01') THEN 'interrupted' ELSE 'running' END AS state FROM s""",
)
def _(t):
    kind = (
        F.when(F.col("event_type").isin("click", "error"), "task")
        .when((F.col("event_type") == "purchase") & (F.col("event_id") % 50 == 0), "completed")
        .when(F.col("event_type") == "signup", "started")
        .when(F.col("event_type") == "view", "lost")
        .otherwise("note")
    )
    events = event_stream(t).select(
        F.col("user_id").alias("run"),
        "ts",
        kind.alias("event"),
        (F.col("event_id") % 3 > 0).alias("scored"),
        (F.col("event_type") == "click").alias("passed"),
    )
    got = jobs.run_updates(jobs.run_state(events), ["run"], "run-state")
    return got.withColumn("last_activity", F.unix_micros("last_activity"))


def _sales(t):
    rows, feed = event_feed(t)
    sales = rows.select(
        "ts",
        (F.col("event_id") % 1000).alias("input_tokens"),
        F.col("user_id").alias("output_tokens"),
        F.col("value").cast("decimal(18,6)").alias("earned"),
    )
    return sales, feed


@query(
    "stream_daily_sales",
    f"""SELECT strftime(d, '%Y-%m-%d') AS day, sum(event_id % 1000)::bigint AS input_tokens, sum(user_id)::bigint AS output_tokens,
        {r2('sum(value::decimal(18,6))::double')} AS earned FROM (SELECT *, date_trunc('day', ts) AS d FROM events) GROUP BY d""",
)
def _(t):
    sales, feed = _sales(t)
    got = jobs.run_to_files(jobs.daily_sales(sales), "daily", feed)
    return got.select(
        F.date_format("day", "yyyy-MM-dd").alias("day"), "input_tokens", "output_tokens", round2(F.col("earned").cast("double")).alias("earned")
    )


@query(
    "stream_recent_sales",
    f"""SELECT strftime(u, '%Y-%m-%d %H') AS until, count(*) AS requests, sum(user_id)::bigint AS output_tokens,
        {r2('sum(value::decimal(18,6))::double')} AS earned FROM (SELECT *, date_trunc('hour', ts) + INTERVAL (i) HOUR AS u FROM events,
        range(1, 25) r(i)) GROUP BY u""",
)
def _(t):
    sales, feed = _sales(t)
    got = jobs.run_to_files(jobs.recent_sales(sales), "recent", feed)
    return got.select(
        F.date_format("until", "yyyy-MM-dd HH").alias("until"), "requests", "output_tokens", round2(F.col("earned").cast("double")).alias("earned")
    )


@query(
    "stream_request_metrics",
    f"""WITH g AS (SELECT *, epoch_us(ts) / 1000.0::double AS ms, coalesce(ts - lag(ts) OVER w >= INTERVAL 2 HOUR, true) AS new FROM events
          WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        i AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g),
        q AS (SELECT user_id, s, min(ms) AS st, min(ms) FILTER (WHERE event_type <> 'error') AS ft, max(ms) FILTER (WHERE event_type <>
          'error') AS lt, max(ms) AS en, count(*) FILTER (WHERE event_type <> 'error') AS n, max(event_id % 100) AS p, min(ts) AS start FROM i GROUP BY user_id, s)
        SELECT user_id, epoch_us(start) AS start, n AS output_tokens, {r2('(ft - st)')} AS ttft_ms,
          CASE WHEN n > 1 AND lt - ft > 0 THEN {r1('((n - 1) / ((lt - ft) / 1000))')} WHEN en - coalesce(ft, st) > 0 AND n > 0 THEN
          {r1('(n / ((en - coalesce(ft, st)) / 1000))')} END AS tok_s_out,
          CASE WHEN ft - st > 0 AND p > 0 THEN {r1('(p / ((ft - st) / 1000))')} END AS tok_s_prefill
        FROM q""",
)
def _(t):
    rows, feed = event_feed(t)
    tokens = rows.select(
        "user_id",
        "ts",
        F.when(F.col("event_type") != "error", "token").alias("kind"),
        (F.col("event_id") % 100).alias("prompt_tokens"),
    )
    got = jobs.run_to_files(jobs.request_sessions(tokens, ["user_id"], "2 hours"), "requests", feed)
    return got.select(
        "user_id",
        F.unix_micros("start").alias("start"),
        "output_tokens",
        round2(F.col("ttft_ms")).alias("ttft_ms"),
        "tok_s_out",
        "tok_s_prefill",
    )


@query(
    "stream_dedupe_results",
    "SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS event_id, max(epoch_us(ts)) AS at FROM events GROUP BY user_id, event_type",
)
def _(t):
    rows = event_stream(t).select("user_id", "event_type", "ts", "event_id")
    got = jobs.run_updates(jobs.dedupe_results(rows, ["user_id", "event_type"]), ["user_id", "event_type"], "dedupe")
    return got.select("user_id", "event_type", "event_id", F.unix_micros("ts").alias("at"))


@query(
    "stream_coverage_join",
    """SELECT l.doc_id, quality, lang AS task, source FROM labels l LEFT JOIN (SELECT * FROM documents WHERE lang <> 'de') d ON
       d.doc_id = l.doc_id""",
)
def _(t):
    results = jobs.read_stream(t.spark, f"{t.folder}/labels.parquet", t.labels.schema).select("doc_id", "quality")
    catalog = t.documents.where(F.col("lang") != "de").select("doc_id", F.col("lang").alias("task"), "source")
    return jobs.run_to_files(jobs.coverage_join(results, catalog, "doc_id"), "coverage")


# A key that was silent for longer than this starts anew.
_FORGET = timedelta(days=1)
_MS = "ceil(epoch_us(ts) / 1000.0)"


def _apart(key: str) -> str:
    gap = f"{_MS} - lag({_MS}) OVER (PARTITION BY {key} ORDER BY ts, event_id)"
    return f"coalesce({gap} > {_FORGET // timedelta(milliseconds=1)}, true)"


@query(
    "stream_change_notices",
    f"""WITH c AS (SELECT user_id AS listing, concat('m', event_id % 2) AS model, ts, event_id, CASE event_type WHEN 'error' THEN 'failed'
          WHEN 'view' THEN 'warning' ELSE 'ok' END AS state FROM events),
        p AS (SELECT *, lag(state) OVER (PARTITION BY listing, model ORDER BY ts, event_id) AS before, {_apart("listing, model")} AS apart FROM c)
        SELECT listing, model, event_id, state FROM p WHERE state <> 'ok' AND (apart OR state <> before)""",
)
def _(t):
    rows, feed = event_feed(t)
    state = F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "view", "warning").otherwise("ok")
    checks = rows.select(
        F.col("user_id").alias("listing"),
        F.concat(F.lit("m"), (F.col("event_id") % 2).cast("string")).alias("model"),
        "ts",
        "event_id",
        state.alias("state"),
    )
    return jobs.run_to_files(jobs.change_notices(checks, forget=_FORGET), "notices", feed)


@query(
    "stream_repeat_detector",
    f"""WITH s AS (SELECT *, coalesce(event_type <> lag(event_type) OVER w, true) OR {_apart("user_id")} AS new FROM events WINDOW w AS
          (PARTITION BY user_id ORDER BY ts, event_id)), i AS (SELECT *, sum(new::int) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g
          FROM s), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, g ORDER BY ts, event_id) AS repeats FROM i)
        SELECT user_id AS run, event_id, repeats, CASE WHEN repeats >= 6 THEN 'stop' ELSE 'warn' END AS action FROM n WHERE repeats = 3 OR
          repeats >= 6""",
)
def _(t):
    rows, feed = event_feed(t)
    steps = rows.select(
        F.col("user_id").alias("run"), "ts", "event_id", F.col("event_type").alias("command"), F.lit("out").alias("output")
    )
    return jobs.run_to_files(jobs.repeat_detector(steps, forget=_FORGET), "repeats", feed)


@query(
    "stream_counter_delta",
    f"""SELECT user_id AS source, event_id, coalesce(c < p, false) AS reset, CASE WHEN NOT coalesce(c < p, false) THEN c - p END AS delta FROM
        (SELECT user_id, event_id, c, CASE WHEN NOT apart THEN b END AS p FROM (SELECT *, floor(value)::bigint AS c, lag(floor(value)::bigint)
        OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b, {_apart("user_id")} AS apart FROM events))""",
)
def _(t):
    rows, feed = event_feed(t)
    scrapes = rows.select(
        F.col("user_id").alias("source"), "ts", "event_id", F.floor("value").cast("bigint").alias("counter")
    )
    return jobs.run_to_files(jobs.counter_delta(scrapes, forget=_FORGET), "deltas", feed)


# Records are stamped up to ten hours before they arrive.
_STAMPED = "ts - INTERVAL (event_id * 37 % 11) HOUR"


def _late_oracle(hours: int) -> str:
    return f"""SELECT source, event_id, at_us, coalesce(ahead - at_us > {hours * 3_600_000_000}, false) AS late, greatest(coalesce(ahead - at_us, 0), 0)
        AS behind FROM (SELECT *, max(at_us) OVER (PARTITION BY source ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead
        FROM (SELECT user_id % 50 AS source, event_id, epoch_us({_STAMPED}) AS at_us FROM events))"""


def _late(t, hours: int):
    stamped = F.col("ts") - F.make_dt_interval(hours=(F.col("event_id") * 37 % 11).cast("int"))
    rows = event_stream(t).select((F.col("user_id") % 50).alias("source"), "event_id", stamped.alias("ts"))
    return jobs.run_to_files(jobs.mark_late(rows, timedelta(hours=hours)), "late", split_by=["late"])


@query("stream_late_rows", _late_oracle(1))
def _(t):
    return _late(t, 1)


@query("stream_late_rows_wide", _late_oracle(6))
def _(t):
    return _late(t, 6)


@query(
    "stream_late_counts",
    f"""SELECT source, count(*) FILTER (WHERE NOT late) AS in_time, count(*) FILTER (WHERE late) AS late, max(behind) AS most_behind
        FROM ({_late_oracle(6)}) GROUP BY source""",
)
def _(t):
    return jobs.late_counts(_late(t, 6))


@query("sink_status_log", "SELECT event_id, event_type AS event FROM events")
def _(t):
    from benchloom.session import new_path
    from benchloom.sources.writers import status_log

    path = new_path(t.spark, "status")
    log = event_stream(t).select(F.col("event_type").alias("event"), "event_id", F.col("ts").cast("string").alias("time"))
    status_log(log, path, path + "-checkpoint").awaitTermination()
    return t.spark.read.schema("event_id bigint, event string").json(path)
