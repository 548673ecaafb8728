"""From raw events to measurements: counters, request timing, repeats and sweeps."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions.numbers import round1, round2
from benchloom.operators.ordered import (
    as_sequence,
    drop_marks,
    exact_percentiles,
    with_previous,
    with_running_sum,
)


def last_seen(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str) -> DataFrame:
    """Add the latest non-null ``value`` at or before each row of a key."""
    seq = as_sequence(df, keys, order)
    key = F.struct(*keys)
    inside = Window.partitionBy("_bucket", *keys).orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    seq = seq.withColumn("_k", key).withColumn("_in", F.last(value, ignorenulls=True).over(inside))
    edges = seq.groupBy("_bucket").agg(
        F.min_by("_k", "_row").alias("_first"), F.max_by("_k", "_row").alias("_last"), F.max_by("_in", "_row").alias("_tail")
    )
    same = Window.partitionBy("_last").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    edges = edges.withColumn("_upto", F.last("_tail", ignorenulls=True).over(same))
    slices = Window.orderBy("_bucket")  # one row per sorted slice
    carry = edges.select(
        "_bucket",
        "_first",
        F.when(F.lag("_last").over(slices).eqNullSafe(F.col("_first")), F.lag("_upto").over(slices)).alias("_carry"),
    )
    joined = seq.join(F.broadcast(carry), "_bucket")
    found = F.coalesce("_in", F.when(F.col("_k").eqNullSafe(F.col("_first")), F.col("_carry")))
    return drop_marks(joined.withColumn(name, found).drop("_k", "_in", "_first", "_carry"))


def counter_delta(
    scrapes: DataFrame, source: str, order: Sequence[str], counters: Sequence[str], gauges: Sequence[str] = ()
) -> DataFrame:
    """Growth of counters since the previous scrape of a source; a falling counter is a reset.

    Gauges keep their latest value.  The first scrape of a source has no growth.
    """
    seq = with_previous(as_sequence(scrapes, [source], order), [source], counters)
    growth = {c: F.col(c) - F.col(f"prev_{c}") for c in counters}
    reset = F.lit(False)
    for g in growth.values():
        reset = reset | F.coalesce(g < 0, F.lit(False))
    kept = [c for c in scrapes.columns if c not in counters]
    return seq.select(
        *kept, reset.alias("reset"), *[F.when(~reset, g).alias(f"{c}_delta") for c, g in growth.items()]
    )


def with_runs(df: DataFrame, keys: Sequence[str], order: Sequence[str], same: Sequence[str]) -> DataFrame:
    """Number the runs of rows of a key whose ``same`` columns do not change (``island``, from 1)."""
    seq = with_previous(as_sequence(df, keys, order), keys, same)
    equal = F.col("prev_exists")
    for c in same:
        equal = equal & F.col(c).eqNullSafe(F.col(f"prev_{c}"))
    # ``with_previous`` keeps slice and place, so the running count needs no second sort.
    seq = seq.withColumn("_new", F.when(equal, 0).otherwise(1))
    return drop_marks(with_running_sum(seq, keys, "_new", "island")).drop(
        "_new", "prev_exists", *[f"prev_{c}" for c in same]
    )


def repeat_runs(steps: DataFrame, key: str, order: Sequence[str], command: str, output: str) -> DataFrame:
    """Longest runs of one command with one output: a warning from 3 in a row, a stop from 6."""
    marked = steps.withColumn("_print", F.sha2(F.concat(F.col(command), F.lit("\0"), F.col(output)), 256))
    runs = with_runs(marked, [key], order, ["_print"]).groupBy(key, "island").agg(F.count(F.lit(1)).alias("length"))
    return runs.where(F.col("length") >= 3).select(
        key, "island", "length", F.when(F.col("length") >= 6, "stop").otherwise("warn").alias("action")
    )


def failure_streaks(checks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """State after each check (column ``failed``): one failure warns, two in a row fail, a pass clears."""
    runs = with_runs(checks, keys, order, ["failed"])
    islands = runs.groupBy(*keys, "island").agg(
        F.first("failed").alias("failed"), F.count(F.lit(1)).alias("streak"), F.max_by(order[-1], F.struct(*order)).alias("until")
    )
    state = F.when(~F.col("failed"), "ok").when(F.col("streak") == 1, "warning").otherwise("failed")
    return islands.withColumn("state", state)


def last_event_time(events: DataFrame, key: str, time_text: str, event: str) -> DataFrame:
    """Latest valid time of each log; lines without event name or with a bad time do not count."""
    time = F.try_to_timestamp(F.col(time_text))
    named = F.coalesce(F.col(event), F.lit("")) != ""
    return events.groupBy(key).agg(F.max(F.when(named, time)).alias("last_event"))


def error_consensus(rows: DataFrame, by: Sequence[str], code: str) -> DataFrame:
    """The one error code all failed rows share, else a general one."""
    return rows.groupBy(*by).agg(
        F.when(F.min(code) == F.max(code), F.min(code)).otherwise("no_scored_questions").alias("error_code")
    )


def consensus_value(rows: DataFrame, by: Sequence[str], value: str, default: Column) -> DataFrame:
    """The value all rows of a group share, else ``default``."""
    shared = F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1))), F.min(value))
    return rows.groupBy(*by).agg(F.coalesce(shared, default).alias(value))


# ---------------------------------------------------------------- request timing


def decode_rate(tokens: Column, started: Column, first: Column, last: Column, completed: Column) -> Column:
    """Tokens per second: between tokens when there are several, else over the request (times in milliseconds)."""
    between = last - first
    window = completed - F.coalesce(first, started)
    return F.when((tokens > 1) & (between > 0), round1((tokens - 1) / (between / 1000))).when(
        (window > 0) & (tokens > 0), round1(tokens / (window / 1000))
    )


def decode_source(tokens: Column, started: Column, first: Column, last: Column, completed: Column) -> Column:
    return F.when((tokens > 1) & (last - first > 0), "inter_token").when(
        (completed - F.coalesce(first, started) > 0) & (tokens > 0), "request_window"
    )


def requests_from_tokens(token_events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per request from its events (``kind`` start, token or end; ``ms`` is the time)."""
    at = lambda kind: F.when(F.col("kind") == kind, F.col("ms"))
    return token_events.groupBy(*keys).agg(
        F.min(at("start")).alias("started"),
        F.min(at("token")).alias("first_token"),
        F.max(at("token")).alias("last_token"),
        F.max(at("end")).alias("completed"),
        F.count(at("token")).alias("output_tokens"),
        F.max("prompt_tokens").alias("prompt_tokens"),
    )


def request_metrics(requests: DataFrame) -> DataFrame:
    """Add time to the first token, decode rate with its source, and prefill rate to each request."""
    times = [F.col(c) for c in ("output_tokens", "started", "first_token", "last_token", "completed")]
    ttft = F.col("first_token") - F.col("started")
    return (
        requests.withColumn("ttft_ms", ttft)
        .withColumn("tok_s_out", decode_rate(*times))
        .withColumn("tok_s_out_source", decode_source(*times))
        .withColumn(
            "tok_s_prefill",
            F.when((ttft > 0) & (F.col("prompt_tokens") > 0), round1(F.col("prompt_tokens") / (ttft / 1000))),
        )
    )


def _iterations(rows: DataFrame, run: str, iteration: str) -> DataFrame:
    """``tok_s_out`` and ``tok_s_total`` of each iteration, and its number ``n`` of requests."""
    groups = rows.groupBy(run, iteration).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("started").alias("s"),
        F.max("completed").alias("e"),
        F.min("first_token").alias("f"),
        F.sum("output_tokens").alias("o"),
        F.sum("prompt_tokens").alias("p"),
        F.max("tok_s_out").alias("one"),
    )
    window = F.col("e") - F.coalesce("f", "s")
    shared = F.when(window > 0, round1(F.col("o") / (window / 1000)))
    whole = F.col("e") - F.col("s")
    return groups.select(
        run,
        "n",
        F.when(F.col("n") > 1, shared).otherwise(F.col("one")).alias("tok_s_out"),
        F.when(whole > 0, round1((F.col("p") + F.col("o")) / (whole / 1000))).alias("tok_s_total"),
    )


def _long_metrics(df: DataFrame, run: str, names: Sequence[str]) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("v")) for n in names])
    return df.select(run, F.explode(pairs).alias("x")).select(run, "x.metric", "x.v")


def iteration_summary(requests: DataFrame, run: str = "run", iteration: str = "iteration") -> DataFrame:
    """Medians of a run over its requests and iterations.

    Requests give time to first token and prefill rate; an iteration gives the total rate over its whole
    window and, with several requests, the decode rate from its first token to its end.
    """
    rows = request_metrics(requests)
    values = _long_metrics(rows, run, ["ttft_ms", "tok_s_prefill", "output_tokens", "prompt_tokens"]).unionByName(
        _long_metrics(_iterations(rows, run, iteration), run, ["tok_s_out", "tok_s_total"])
    )
    medians = exact_percentiles(values, [run, "metric"], "v", {"p50": 0.5})
    names = ["ttft_ms", "tok_s_prefill", "tok_s_out", "tok_s_total", "output_tokens", "prompt_tokens"]
    wide = medians.groupBy(run).agg(*[F.max(F.when(F.col("metric") == n, F.col("p50"))).alias(n) for n in names])
    return wide.select(
        run,
        *[round2(F.col(n)).alias(n) for n in ("ttft_ms", "tok_s_prefill", "tok_s_out", "tok_s_total")],
        "output_tokens",
        "prompt_tokens",
    )


def sample_statistics(requests: DataFrame, run: str = "run", iteration: str = "iteration") -> DataFrame:
    """Count, min, p50, mean, max and sample deviation of the samples behind a run's medians, a row per metric.

    Only runs with several iterations, or several requests in one, have statistics.  A metric without a value
    has the count 0 and nothing else.
    """
    rows = request_metrics(requests)
    iterations = _iterations(rows, run, iteration)
    several = iterations.groupBy(run).agg(F.count(F.lit(1)).alias("i"), F.max("n").alias("r")).where("i > 1 OR r > 1").select(run)
    values = _long_metrics(rows, run, ["ttft_ms"]).unionByName(_long_metrics(iterations, run, ["tok_s_out", "tok_s_total"]))
    basic = values.groupBy(run, "metric").agg(
        F.count("v").alias("count"),
        round2(F.min("v")).alias("min"),
        round2(F.avg("v")).alias("mean"),
        round2(F.max("v")).alias("max"),
        F.when(F.count("v") > 1, round2(F.stddev_samp("v"))).alias("stddev"),
    )
    middle = exact_percentiles(values, [run, "metric"], "v", {"p50": 0.5}).select(run, "metric", round2(F.col("p50")).alias("p50"))
    return basic.join(several, run).join(middle, [run, "metric"], "left").select(
        run, "metric", "count", "min", "p50", "mean", "max", "stddev"
    )


def context_sweep(points: DataFrame, by: Sequence[str], level: str, levels: Sequence[int]) -> DataFrame:
    """Decode rate and time to first token per context level, one row per group and one column per level."""
    chosen = points.where(F.col(level).isin(*levels))

    def long(name: str) -> Column:
        return F.struct(F.lit(name).alias("metric"), F.col(name).cast("double").alias("v"))

    values = chosen.select(*by, level, F.explode(F.array(long("tok_s_out"), long("ttft_ms"))).alias("x")).select(
        *by, level, "x.metric", "x.v"
    )
    medians = exact_percentiles(values, [*by, level, "metric"], "v", {"p50": 0.5})
    cells = [
        F.max(F.when((F.col(level) == x) & (F.col("metric") == m), round2(F.col("p50")))).alias(f"{m}_{x}")
        for x in levels
        for m in ("tok_s_out", "ttft_ms")
    ]
    return medians.groupBy(*by).agg(*cells)


def matrix_summary(cells: DataFrame) -> DataFrame:
    """Rate by context and concurrency with totals rows (null stands for all).

    Cells are summed once; the totals are made of those sums.
    """
    sums = cells.groupBy("phase", "context", "concurrency").agg(F.count(F.lit(1)).alias("n"), F.max("aggregate_tps").alias("best"))
    sets = [[F.col("phase"), *rest] for rest in ([], [F.col("context")], [F.col("concurrency")], [F.col("context"), F.col("concurrency")])]
    totals = sums.groupingSets(sets, "phase", "context", "concurrency")
    return totals.agg(F.sum("n").alias("cells"), round2(F.max("best")).alias("best_tps"))


# ---------------------------------------------------------------- engine evidence


def spec_acceptance(scrapes: DataFrame, key: str, requests: str = "requests") -> DataFrame:
    """Draft and accepted tokens per request, acceptance rate and mean accepted length, where known and valid."""
    n = F.col(requests)
    scaled = lambda c: F.when(n > 1, F.floor(F.col(c) / n + 0.5)).otherwise(F.col(c))
    drafted, accepted = scaled("draft_tokens"), scaled("accepted_tokens")
    ratio = lambda v: F.floor(v * 10000 + 0.5) / 10000
    known = F.coalesce(F.col("draft_tokens"), F.col("accepted_tokens")).isNotNull() & (F.coalesce(drafted, F.lit(0.0)) > 0)
    gauge = F.coalesce("draft_acceptance_rate", "accept_rate")
    rate = F.when(known, ratio(F.coalesce(accepted, F.lit(0.0)) / drafted)).when(gauge.between(0, 1), ratio(gauge))
    length = F.when(F.col("accept_length") >= 1, ratio(F.col("accept_length")))
    return scrapes.select(
        key,
        F.when(known, F.floor(drafted)).cast("bigint").alias("spec_draft_tokens"),
        F.when(known, F.floor(F.coalesce(accepted, F.lit(0.0)))).cast("bigint").alias("spec_accepted_tokens"),
        rate.alias("spec_acceptance_rate"),
        length.alias("spec_mean_accepted_length"),
        (rate.isNotNull() | length.isNotNull()).alias("spec_decoding"),
    )


def cache_evidence(rows: DataFrame) -> DataFrame:
    """Prefix-cache reuse of each request from up to three counters, which must be whole, in range and agree.

    Adds ``status``: unknown, not_retained, partial or retained; and the cached and uncached tokens.
    """
    total = F.col("prompt_tokens")
    whole = lambda v: (v >= 0) & (v <= total) & (v == F.floor(v))
    usable_total = (total > 0) & (total == F.floor(total)) & ~F.isnan(total)
    counters = [F.col("cached_tokens"), F.col("cache_n"), F.col("prompt_n")]
    bad = F.lit(False)
    for c in counters:
        bad = bad | (c.isNotNull() & ~F.coalesce(whole(c), F.lit(False)))
    values = F.array_compact(F.array(counters[0], counters[1], total - counters[2]))
    agree = F.size(F.array_distinct(values)) == 1
    valid = F.coalesce(usable_total, F.lit(False)) & ~bad & agree
    cached = F.when(valid, values[0])
    rows = rows.withColumn("_cached", cached)
    status = (
        F.when(F.col("_cached").isNull(), "unknown")
        .when(F.col("_cached") == 0, "not_retained")
        .when(F.col("_cached") == total, "retained")
        .otherwise("partial")
    )
    return (
        rows.withColumn("status", status)
        .withColumn("cached", F.col("_cached"))
        .withColumn("uncached", total - F.col("_cached"))
        .drop("_cached")
    )
