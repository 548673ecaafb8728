"""Measurement reduction over events and line items."""

from pyspark.sql import functions as F

from benchloom.operators import measure as ops
from benchloom.plans.registry import pct, query, r1, r2


def _scrapes(t):
    return t.events.select(
        "user_id", "ts", "event_id", F.floor("value").cast("bigint").alias("draft"), "event_type"
    )


@query(
    "counter_delta",
    """SELECT user_id, event_id, event_type, coalesce(draft < p, false) AS reset, CASE WHEN NOT coalesce(draft < p, false)
         THEN draft - p END AS draft_delta FROM (SELECT *, floor(value)::bigint AS draft, lag(floor(value)::bigint) OVER
         (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)""",
)
def _(t):
    return ops.counter_delta(_scrapes(t), "user_id", ["ts", "event_id"], ["draft"]).drop("ts")


_ISLANDS = """SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM
  (SELECT *, coalesce({same}, false) AS same FROM events)"""


@query(
    "repeat_runs",
    f"""WITH i AS ({_ISLANDS.format(same='event_type = lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id)')})
        SELECT user_id, cast(island AS bigint) AS island, count(*) AS length,
          CASE WHEN count(*) >= 6 THEN 'stop' ELSE 'warn' END AS action FROM i GROUP BY user_id, island HAVING count(*) >= 3""",
)
def _(t):
    steps = t.events.select("user_id", "ts", "event_id", "event_type", F.lit("same").alias("output"))
    return ops.repeat_runs(steps, "user_id", ["ts", "event_id"], "event_type", "output")


@query(
    "failure_streak",
    """WITH c AS (SELECT user_id % 10 AS host, event_id % 3 AS model, ts, event_id, event_type = 'error' AS failed FROM events),
       s AS (SELECT *, coalesce(failed = lag(failed) OVER w, false) AS same FROM c WINDOW w AS (PARTITION BY host, model ORDER
         BY ts, event_id)),
       i AS (SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END) OVER (PARTITION BY host, model ORDER BY ts, event_id) AS island FROM s)
       SELECT host, model, cast(island AS bigint) AS island, failed, count(*) AS streak, max(event_id) AS until,
         CASE WHEN NOT failed THEN 'ok' WHEN count(*) = 1 THEN 'warning' ELSE 'failed' END AS state FROM i
       GROUP BY host, model, island, failed""",
)
def _(t):
    checks = t.events.select(
        (F.col("user_id") % 10).alias("host"),
        (F.col("event_id") % 3).alias("model"),
        "ts",
        "event_id",
        (F.col("event_type") == "error").alias("failed"),
    )
    return ops.failure_streaks(checks, ["host", "model"], ["ts", "event_id"])


@query(
    "last_event_time",
    """SELECT user_id, strftime(max(CASE WHEN event_type <> 'view' AND event_id % 5 > 0 THEN ts END), '%Y-%m-%d %H:%M:%S.%f') AS
       last_event FROM events GROUP BY user_id""",
)
def _(t):
    logs = t.events.select(
        "user_id",
        F.when(F.col("event_type") != "view", F.col("event_type")).alias("event"),
        F.when(F.col("event_id") % 5 == 0, "not a time")
        .otherwise(F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .alias("time"),
    )
    got = ops.last_event_time(logs, "user_id", "time", "event")
    return got.select("user_id", F.date_format("last_event", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("last_event"))


@query(
    "error_consensus",
    """SELECT user_id, CASE WHEN min(c) = max(c) THEN min(c) ELSE 'no_scored_questions' END AS error_code FROM (SELECT user_id,
       CASE WHEN user_id % 2 = 0 THEN 'timeout' ELSE event_type END AS c FROM events) GROUP BY user_id""",
)
def _(t):
    code = F.when(F.col("user_id") % 2 == 0, "timeout").otherwise(F.col("event_type"))
    return ops.error_consensus(t.events.select("user_id", code.alias("code")), ["user_id"], "code")


@query(
    "consensus_value",
    """SELECT p_brand, p_type, CASE WHEN min(p_size) = max(p_size) THEN min(p_size) ELSE 0 END AS max_turns FROM part
       GROUP BY p_brand, p_type""",
)
def _(t):
    rows = t.part.select("p_brand", "p_type", F.col("p_size").alias("max_turns"))
    return ops.consensus_value(rows, ["p_brand", "p_type"], "max_turns", F.lit(0))


# A request is an order of line items: starts at 0 ms, one token per line, ends after the last.
_REQUESTS = """SELECT l_orderkey AS request, l_orderkey % 500 AS run, l_orderkey // 500 % 7 AS iteration,
  count(*) AS output_tokens, 0.0::double AS started, CASE WHEN l_orderkey % 9 > 0 THEN min(l_quantity) END AS first_token,
  CASE WHEN l_orderkey % 9 > 0 THEN max(l_quantity) + 100 * count(*) END AS last_token,
  max(l_quantity) + 100 * count(*) + 50 AS completed, max(l_partkey % 50) AS prompt_tokens FROM lineitem GROUP BY l_orderkey"""


def _requests(t):
    rows = t.lineitem.groupBy(F.col("l_orderkey").alias("request")).agg(
        F.count(F.lit(1)).alias("output_tokens"),
        F.min("l_quantity").alias("_f"),
        F.max("l_quantity").alias("_l"),
        F.max(F.col("l_partkey") % 50).alias("prompt_tokens"),
    )
    timed = F.col("request") % 9 > 0
    last = F.col("_l") + 100 * F.col("output_tokens")
    return rows.select(
        "request",
        (F.col("request") % 500).alias("run"),
        (F.expr("request div 500") % 7).alias("iteration"),
        "output_tokens",
        F.lit(0.0).alias("started"),
        F.when(timed, F.col("_f")).alias("first_token"),
        F.when(timed, last).alias("last_token"),
        (last + 50).alias("completed"),
        "prompt_tokens",
    )


_RATED = f"""SELECT *, first_token - started AS ttft_ms,
  CASE WHEN output_tokens > 1 AND last_token - first_token > 0 THEN {r1('((output_tokens - 1) / ((last_token - first_token) / 1000))')}
    WHEN completed - coalesce(first_token, started) > 0 AND output_tokens > 0 THEN
    {r1('(output_tokens / ((completed - coalesce(first_token, started)) / 1000))')} END AS tok_s_out,
  CASE WHEN output_tokens > 1 AND last_token - first_token > 0 THEN 'inter_token'
    WHEN completed - coalesce(first_token, started) > 0 AND output_tokens > 0 THEN 'request_window' END AS tok_s_out_source,
  CASE WHEN first_token - started > 0 AND prompt_tokens > 0 THEN {r1('(prompt_tokens / ((first_token - started) / 1000))')} END
    AS tok_s_prefill FROM ({_REQUESTS})"""


@query("decode_window", f"SELECT request, ttft_ms, tok_s_out, tok_s_out_source, tok_s_prefill FROM ({_RATED})")
def _(t):
    rows = ops.request_metrics(_requests(t))
    return rows.select("request", "ttft_ms", "tok_s_out", "tok_s_out_source", "tok_s_prefill")


@query(
    "request_rows",
    """SELECT user_id, cast(event_id // 2000 AS bigint) AS request, min(us) FILTER (WHERE event_type = 'signup') AS started,
       min(us) FILTER (WHERE event_type = 'view') AS first_token, max(us) FILTER (WHERE event_type = 'view') AS last_token,
       max(us) FILTER (WHERE event_type = 'error') AS completed, count(*) FILTER (WHERE event_type = 'view') AS output_tokens,
       max(floor(value)::bigint) AS prompt_tokens FROM (SELECT *, epoch_us(ts) AS us FROM events) GROUP BY ALL""",
)
def _(t):
    kind = (
        F.when(F.col("event_type") == "signup", "start")
        .when(F.col("event_type") == "view", "token")
        .when(F.col("event_type") == "error", "end")
    )
    events = t.events.select(
        "user_id",
        F.expr("event_id div 2000").alias("request"),
        kind.alias("kind"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ms"),
        F.floor("value").cast("bigint").alias("prompt_tokens"),
    )
    return ops.requests_from_tokens(events, ["user_id", "request"])


_MEDIANS = ", ".join(f"{r2(pct(c, 0.5))} AS {c}" for c in ("ttft_ms", "tok_s_prefill"))


@query(
    "iteration_summary",
    f"""WITH q AS ({_RATED}),
        g AS (SELECT run, iteration, count(*) AS n, min(started) AS s, max(completed) AS e, min(first_token) AS f,
          sum(output_tokens) AS o, sum(prompt_tokens) AS p, max(tok_s_out) AS one FROM q GROUP BY ALL),
        i AS (SELECT run, CASE WHEN n > 1 THEN CASE WHEN e - coalesce(f, s) > 0 THEN {r1('(o / ((e - coalesce(f, s)) / 1000))')} END
          ELSE one END AS tok_s_out, CASE WHEN e - s > 0 THEN {r1('((p + o) / ((e - s) / 1000))')} END AS tok_s_total FROM g),
        a AS (SELECT run, {_MEDIANS}, {pct('output_tokens', 0.5)} AS output_tokens, {pct('prompt_tokens', 0.5)} AS
          prompt_tokens FROM q GROUP BY run),
        b AS (SELECT run, {r2(pct('tok_s_out', 0.5))} AS tok_s_out, {r2(pct('tok_s_total', 0.5))} AS tok_s_total FROM i GROUP BY run)
        SELECT a.*, b.tok_s_out, b.tok_s_total FROM a JOIN b USING (run)""",
)
def _(t):
    return ops.iteration_summary(_requests(t))


@query(
    "sample_statistics",
    f"""WITH q AS ({_RATED}),
        g AS (SELECT run, iteration, count(*) AS n, min(started) AS s, max(completed) AS e, min(first_token) AS f,
          sum(output_tokens) AS o, sum(prompt_tokens) AS p, max(tok_s_out) AS one FROM q GROUP BY ALL),
        i AS (SELECT run, n, CASE WHEN n > 1 THEN CASE WHEN e - coalesce(f, s) > 0 THEN {r1('(o / ((e - coalesce(f, s)) / 1000))')} END
          ELSE one END AS tok_s_out, CASE WHEN e - s > 0 THEN {r1('((p + o) / ((e - s) / 1000))')} END AS tok_s_total FROM g),
        v AS (SELECT run, 'ttft_ms' AS metric, ttft_ms::double AS v FROM q UNION ALL SELECT run, 'tok_s_out', tok_s_out FROM i UNION ALL
          SELECT run, 'tok_s_total', tok_s_total FROM i)
        SELECT run, metric, count(v) AS count, {r2('min(v)')} AS min, {r2(pct('v', 0.5))} AS p50, {r2('avg(v)')} AS mean, {r2('max(v)')} AS max,
          CASE WHEN count(v) > 1 THEN {r2('stddev_samp(v)')} END AS stddev FROM v WHERE run IN (SELECT run FROM i GROUP BY run HAVING
          count(*) > 1 OR max(n) > 1) GROUP BY run, metric""",
)
def _(t):
    return ops.sample_statistics(_requests(t))


def _points(t):
    return t.lineitem.select(
        (F.col("l_suppkey") % 5).alias("model"),
        F.col("l_returnflag").alias("quantization"),
        (F.col("l_linenumber") * 10000).alias("level"),
        (F.col("l_extendedprice") / 1000).alias("tok_s_out"),
        F.col("l_quantity").alias("ttft_ms"),
    )


@query(
    "context_sweep",
    "SELECT l_suppkey % 5 AS model, l_returnflag AS quantization, "
    + ", ".join(
        f"{r2(pct(f'(CASE WHEN l_linenumber = {x} THEN {e} END)', 0.5))} AS {n}_{x}0000"
        for x in (1, 2, 3, 4)
        for n, e in (("tok_s_out", "l_extendedprice / 1000"), ("ttft_ms", "l_quantity"))
    )
    + " FROM lineitem GROUP BY ALL",
)
def _(t):
    return ops.context_sweep(_points(t), ["model", "quantization"], "level", [10000, 20000, 30000, 40000])


@query(
    "matrix_summary",
    f"""SELECT l_linestatus AS phase, l_linenumber AS context, l_suppkey % 4 AS concurrency, count(*) AS cells,
        {r2('max(l_extendedprice)')} AS best_tps FROM lineitem GROUP BY GROUPING SETS ((l_linestatus), (l_linestatus, l_linenumber),
        (l_linestatus, l_suppkey % 4), (l_linestatus, l_linenumber, l_suppkey % 4))""",
)
def _(t):
    cells = t.lineitem.select(
        F.col("l_linestatus").alias("phase"),
        F.col("l_linenumber").alias("context"),
        (F.col("l_suppkey") % 4).alias("concurrency"),
        F.col("l_extendedprice").alias("aggregate_tps"),
    )
    return ops.matrix_summary(cells)


@query(
    "spec_acceptance",
    """WITH s AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN user_id * 10.0 END AS d, CASE WHEN event_id % 2 = 0 THEN
         user_id * 7.0 END AS a, event_id % 4 + 1 AS n, CASE WHEN event_id % 3 = 0 THEN value / 100 END AS g,
         CASE WHEN event_id % 5 > 0 THEN value / 10 END AS l FROM events),
       p AS (SELECT *, CASE WHEN n > 1 THEN floor(d / n + 0.5) ELSE d END AS dd, CASE WHEN n > 1 THEN floor(a / n + 0.5) ELSE a END
         AS aa FROM s)
       SELECT event_id, CASE WHEN dd > 0 THEN dd::bigint END AS spec_draft_tokens, CASE WHEN dd > 0 THEN aa::bigint END AS
         spec_accepted_tokens, CASE WHEN dd > 0 THEN floor(aa::double / dd::double * 10000 + 0.5) / 10000 WHEN g BETWEEN 0 AND 1 THEN
         floor(g * 10000 + 0.5) / 10000 END AS spec_acceptance_rate,
         CASE WHEN l >= 1 THEN floor(l * 10000 + 0.5) / 10000 END AS spec_mean_accepted_length,
         coalesce(dd > 0, false) OR coalesce(g BETWEEN 0 AND 1, false) OR coalesce(l >= 1, false) AS spec_decoding FROM p""",
)
def _(t):
    even = F.col("event_id") % 2 == 0
    scrapes = t.events.select(
        "event_id",
        F.when(even, F.col("user_id") * 10.0).alias("draft_tokens"),
        F.when(even, F.col("user_id") * 7.0).alias("accepted_tokens"),
        (F.col("event_id") % 4 + 1).alias("requests"),
        F.lit(None).cast("double").alias("draft_acceptance_rate"),
        F.when(F.col("event_id") % 3 == 0, F.col("value") / 100).alias("accept_rate"),
        F.when(F.col("event_id") % 5 > 0, F.col("value") / 10).alias("accept_length"),
    )
    return ops.spec_acceptance(scrapes, "event_id")


@query(
    "cache_evidence",
    """WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 100 AS total,
         CASE l_partkey % 4 WHEN 0 THEN floor(l_quantity * 100 * l_discount * 10) WHEN 1 THEN 0.5 END AS x,
         CASE l_suppkey % 3 WHEN 0 THEN floor(l_quantity * 100 * l_discount * 10) WHEN 1 THEN l_linenumber END AS y,
         CASE l_linenumber % 3 WHEN 0 THEN l_quantity * 100 - floor(l_quantity * 100 * l_discount * 10) END AS z FROM lineitem),
       v AS (SELECT *, list_filter([x, y, total - z], lambda q: q IS NOT NULL) AS q, coalesce(x <> floor(x) OR x > total, false) OR
         coalesce(y > total, false) OR coalesce(z > total OR z < 0, false) AS bad FROM c),
       s AS (SELECT CASE WHEN bad OR len(list_distinct(q)) <> 1 THEN 'unknown' WHEN q[1] = 0 THEN 'not_retained'
         WHEN q[1] = total THEN 'retained' ELSE 'partial' END AS status,
         CASE WHEN NOT (bad OR len(list_distinct(q)) <> 1) THEN q[1] END AS cached, total FROM v)
       SELECT status, count(*) AS n, sum(cached)::bigint AS cached, sum(total - cached)::bigint AS uncached FROM s GROUP BY status""",
)
def _(t):
    total = F.col("l_quantity") * 100
    hit = F.floor(total * F.col("l_discount") * 10).cast("double")
    rows = t.lineitem.select(
        total.alias("prompt_tokens"),
        F.when(F.col("l_partkey") % 4 == 0, hit).when(F.col("l_partkey") % 4 == 1, 0.5).alias("cached_tokens"),
        F.when(F.col("l_suppkey") % 3 == 0, hit)
        .when(F.col("l_suppkey") % 3 == 1, F.col("l_linenumber").cast("double"))
        .alias("cache_n"),
        F.when(F.col("l_linenumber") % 3 == 0, total - hit).alias("prompt_n"),
    )
    return (
        ops.cache_evidence(rows)
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("cached").cast("bigint").alias("cached"),
            F.sum("uncached").cast("bigint").alias("uncached"),
        )
    )
