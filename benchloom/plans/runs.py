"""Run analytics over the event table."""

from pyspark.sql import functions as F

from benchloom.operators import runs as ops
from benchloom.operators.ordered import exact_percentiles
from benchloom.functions.numbers import round2
from benchloom.plans.registry import pct, query, r1, r2

_STATS = f"""
SELECT key, count(*) AS runs, count(v) AS metric_runs, {r2('min(v)')} AS min, {r2(pct('v', 0.5))} AS p50,
  {r2('avg(v)')} AS mean, {r2('max(v)')} AS max, {r2(pct('v', 0.95))} AS p95,
  {r2('stddev_samp(v)')} AS stddev, {r2('max(v)')} AS best,
  arg_min(path, struct_pack(a := -v, b := path)) FILTER (WHERE v IS NOT NULL) AS best_run
FROM (SELECT quantization AS key, path, CASE WHEN tok_s_out > 0 THEN tok_s_out END AS v FROM runs) GROUP BY key"""


@query("run_group_stats", _STATS)
def _(t):
    return ops.run_group_stats(t.runs, "tok_s_out", "quant")


_COMPARE = f"""
WITH s AS ({_STATS}), b AS (SELECT key AS baseline, p50 AS base FROM s ORDER BY best DESC, key LIMIT 1)
SELECT key AS name, 'tok_s_out' AS metric, {r2('p50')} AS value, baseline, {r2('base')} AS baseline_value,
  {r2('(p50 - base)')} AS delta, {r2('(p50 / base)')} AS ratio, {r2('((p50 - base) / base * 100)')} AS percent,
  p50 > base AS better FROM s, b"""


@query("compare_groups", _COMPARE)
def _(t):
    return ops.compare_groups(t.runs, "tok_s_out", "quantization")


@query(
    "rank_groups",
    f"""SELECT key, {r2('min(v)')} AS best, rank() OVER (ORDER BY {r2('min(v)')}) AS rank FROM (
        SELECT hf_id AS key, CASE WHEN ttft_ms > 0 THEN ttft_ms END AS v FROM runs) GROUP BY key""",
)
def _(t):
    return ops.rank_groups(ops.run_group_stats(t.runs, "ttft_ms", "model"), "ttft_ms").select("key", "best", "rank")


@query(
    "best_run",
    """SELECT hf_id AS key, path, hf_id, engine, mode, quantization, hardware, tok_s_out FROM (
         SELECT *, row_number() OVER (PARTITION BY hf_id ORDER BY tok_s_out DESC, path) AS n FROM runs
         WHERE tok_s_out > 0) WHERE n = 1""",
)
def _(t):
    return ops.best_run(t.runs, "tok_s_out", "model")


@query(
    "filter_runs",
    """SELECT run_id, hf_id, engine, mode, quantization, kind, hardware, tok_s_out FROM runs
       WHERE lower(hf_id) = 'org/model-3' AND lower(mode) = 'remote' AND lower(kind) = 'speed'
       AND contains(lower(hardware), 'gpu 3') AND lower(engine) = 'llama.cpp'""",
)
def _(t):
    kept = ops.filter_runs(
        t.runs, model="ORG/Model-3", engine="llama-bench", mode="REMOTE", kind="speed", hardware="gpu 3"
    )
    return kept.select("run_id", "hf_id", "engine", "mode", "quantization", "kind", "hardware", "tok_s_out")


@query(
    "project_fields",
    """SELECT path, hf_id AS model, strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS "updatedAt", hardware,
       json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.a.b') AS "a.b" FROM runs""",
)
def _(t):
    return ops.project_fields(t.runs, ["path", "model", "updatedAt", "hardware", "k", "a.b"])


@query(
    "list_runs",
    """SELECT path, hf_id AS model, engine, mode, quantization, tok_s_out, tok_s_out > 0 AS can_submit,
       strftime(updated_at, '%Y-%m-%dT%H:%M:%SZ') AS updated_at FROM runs ORDER BY runs.updated_at DESC, path LIMIT 50""",
)
def _(t):
    return ops.list_runs(t.runs)


@query("newest_runs", "SELECT run_id, path, tok_s_out FROM runs ORDER BY updated_at DESC, path LIMIT 25")
def _(t):
    return ops.newest_runs(t.runs, 25).select("run_id", "path", "tok_s_out")


@query(
    "metric_summary",
    f"""SELECT count(v) AS count, {r2('min(v)')} AS min, {r2(pct('v', 0.5))} AS p50, {r2('avg(v)')} AS mean,
        {r2('max(v)')} AS max, {r2('stddev_samp(v)')} AS stddev
        FROM (SELECT CASE WHEN tok_s_out > 0 THEN tok_s_out END AS v FROM runs)""",
)
def _(t):
    return ops.metric_summary(t.runs, "tok_s_out")


@query(
    "interp_percentile",
    f"""SELECT hf_id, count(*) AS n, {r2(pct('tok_s_prefill', 0.05))} AS p5,
        {r2(pct('tok_s_prefill', 0.5))} AS p50, {r2(pct('tok_s_prefill', 0.99))} AS p99
        FROM runs GROUP BY hf_id""",
)
def _(t):
    got = exact_percentiles(t.runs, ["hf_id"], "tok_s_prefill", {"p5": 0.05, "p50": 0.5, "p99": 0.99})
    return got.select("hf_id", "n", *[round2(F.col(c)).alias(c) for c in ("p5", "p50", "p99")])


_PAIR_METRICS = ["tok_s_out", "tok_s_prefill", "ttft_ms"]


def _pair_sql(metric: str, lower: bool) -> str:
    v, b = f"coalesce(r.{metric}, 0)", f"coalesce(l.{metric}, 0)"
    delta = f"({b} - {v})" if lower else f"({v} - {b})"
    better = f"({v} > 0 AND {v} < {b})" if lower else f"({v} > {b})"
    both = f"{v} > 0 AND {b} > 0"
    return f"""SELECT l.run_id AS run_id, '{metric}' AS metric, {r2(v)} AS value, {r2(b)} AS baseline_value,
      CASE WHEN {both} THEN {r2(delta)} END AS delta, CASE WHEN {both} THEN {r2(f'({v} / {b})')} END AS ratio,
      CASE WHEN {both} THEN {r2(f'({delta} / {b} * 100)')} END AS percent, CASE WHEN {both} THEN {better} END AS better
      FROM runs l JOIN runs r ON r.run_id = l.run_id + 1 WHERE NOT ({v} = 0 AND {b} = 0)"""


@query(
    "compare_pair", " UNION ALL ".join(_pair_sql(m, m == "ttft_ms") for m in _PAIR_METRICS)
)
def _(t):
    left = t.runs.select("run_id", *[F.col(m).alias(f"left_{m}") for m in _PAIR_METRICS])
    right = t.runs.select((F.col("run_id") - 1).alias("run_id"), *[F.col(m).alias(f"right_{m}") for m in _PAIR_METRICS])
    return ops.compare_pairs(left.join(right, "run_id"), _PAIR_METRICS)


@query(
    "validate_runs",
    """WITH v AS (SELECT run_id, tok_s_out, CASE WHEN ttft_ms > 100 THEN ttft_ms END AS ttft_ms,
         CASE WHEN run_id % 13 = 0 THEN ' ' ELSE hf_id END AS hf_id,
         CASE WHEN run_id % 17 = 0 THEN NULL ELSE hardware END AS hardware,
         CASE WHEN run_id % 3 = 0 THEN tok_s_total END AS tok_s_total FROM runs)
       SELECT run_id, cast((trim(hf_id) = '')::int + (hardware IS NULL)::int + coalesce((tok_s_out <= 0)::int, 0)
         + coalesce((ttft_ms <= 0)::int, 0) + coalesce((tok_s_total <= 0)::int, 0) AS bigint) AS field_errors,
         cast((NOT (coalesce(tok_s_out > 0, false) OR coalesce(ttft_ms > 0, false) OR coalesce(tok_s_total > 0, false)))::int
         AS bigint) AS form_errors FROM v""",
)
def _(t):
    rows = t.runs.select(
        "run_id",
        "tok_s_out",
        "engine",
        "quantization",
        F.when(F.col("ttft_ms") > 100, F.col("ttft_ms")).alias("ttft_ms"),
        F.when(F.col("run_id") % 13 == 0, " ").otherwise(F.col("hf_id")).alias("hf_id"),
        F.when(F.col("run_id") % 17 != 0, F.col("hardware")).alias("hardware"),
        F.when(F.col("run_id") % 3 == 0, F.col("tok_s_total")).alias("tok_s_total"),
    )
    return ops.validate_runs(rows).select(
        "run_id",
        F.size("field_errors").cast("bigint").alias("field_errors"),
        F.size("form_errors").cast("bigint").alias("form_errors"),
    )


@query(
    "patch_runs",
    # Several patches of a key in order, some of which clear the status and some of which do not name it.
    """WITH p AS (SELECT o_orderkey - o_orderkey % 3 AS k, o_orderkey AS turn, o_orderkey % 5 <> 0 AS held,
         CASE WHEN o_orderkey % 2 = 0 THEN 'X' END AS status FROM orders),
       l AS (SELECT k, bool_or(held) AS held, (list(status ORDER BY turn DESC) FILTER (WHERE held))[1] AS status FROM p GROUP BY k)
       SELECT o.o_orderkey, CASE WHEN l.held THEN l.status ELSE o.o_orderstatus END AS o_orderstatus,
         CASE WHEN l.k IS NOT NULL THEN 'edited' ELSE o.o_orderpriority END AS o_orderpriority,
         o.o_totalprice, CASE WHEN l.k IS NULL THEN o.o_custkey END AS o_custkey
       FROM orders o LEFT JOIN l ON l.k = o.o_orderkey""",
)
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_custkey")
    patches = t.orders.select(
        (F.col("o_orderkey") - F.col("o_orderkey") % 3).alias("o_orderkey"),
        F.when(F.col("o_orderkey") % 2 == 0, "X").alias("o_orderstatus"),
        F.when(F.col("o_orderkey") % 5 != 0, F.array(F.lit("o_orderstatus"))).otherwise(F.array().cast("array<string>")).alias("named"),
        F.col("o_orderkey").alias("at"),
    )
    edited = {"o_orderpriority": F.lit("edited")}
    return ops.patch_runs(orders, patches, "o_orderkey", ["o_orderstatus"], edited, ["o_custkey"], "named", "at")


@query(
    "comparable_metrics",
    f"""WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_suppkey % 2 = 0 THEN 'local' ELSE 'remote' END
          AS mode, l_quantity * 10 AS p, cast(l_linenumber * 16 AS double) AS o, l_extendedprice / 100 AS pf,
          l_tax * 1000 AS d, CASE WHEN l_partkey % 3 = 0 THEN l_discount * 1000 ELSE 0 END AS ttft FROM lineitem),
        n AS (SELECT *, mode = 'local' AND ttft = 0 AND p > 0 AND pf > 0 AS ft,
          mode = 'local' AND p > 0 AND o > 0 AND pf > 0 AND d > 0 AS fx FROM m),
        k AS (SELECT *, CASE WHEN ft THEN {r1('(p / pf * 1000)')} ELSE ttft END AS nt,
          CASE WHEN fx THEN {r1('((p + o) / (p / pf + o / d))')} ELSE 0 END AS tt FROM n)
        SELECT mode, CASE WHEN ft THEN 'estimated_from_prefill' WHEN nt > 0 THEN CASE WHEN mode = 'local' THEN 'reported'
          ELSE 'stream_first_token' END END AS ttft_source,
          CASE WHEN fx THEN 'derived_from_prefill_and_decode' END AS tok_s_total_source, count(*) AS n,
          {r2('sum(cast(nt AS decimal(18,4)))')} AS ttft_sum, {r2('sum(cast(tt AS decimal(18,4)))')} AS total_sum
        FROM k GROUP BY ALL""",
)
def _(t):
    rows = t.lineitem.select(
        F.when(F.col("l_suppkey") % 2 == 0, "local").otherwise("remote").alias("mode"),
        (F.col("l_quantity") * 10).alias("prompt_tokens"),
        (F.col("l_linenumber") * 16).cast("double").alias("output_tokens"),
        (F.col("l_extendedprice") / 100).alias("tok_s_prefill"),
        (F.col("l_tax") * 1000).alias("tok_s_out"),
        F.when(F.col("l_partkey") % 3 == 0, F.col("l_discount") * 1000).otherwise(0.0).alias("ttft_ms"),
        F.lit(0.0).alias("tok_s_total"),
    )
    return (
        ops.comparable_metrics(rows)
        .groupBy("mode", "ttft_source", "tok_s_total_source")
        .agg(
            F.count(F.lit(1)).alias("n"),
            round2(F.sum(F.col("ttft_ms").cast("decimal(18,4)")).cast("double")).alias("ttft_sum"),
            round2(F.sum(F.col("tok_s_total").cast("decimal(18,4)")).cast("double")).alias("total_sum"),
        )
    )
