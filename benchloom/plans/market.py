"""Marketplace and capacity over line items, orders, suppliers and parts."""

from pyspark.sql import functions as F

from benchloom.operators import capacity as cap
from benchloom.operators import market as ops
from benchloom.plans.registry import query, r2, r4

NOW = "2001-06-01 00:00:00"

_PRICES = """SELECT s_suppkey AS listing, cast((s_nationkey + 1) * 0.05 AS decimal(18,6)) AS input_price,
  CASE WHEN s_suppkey % 3 > 0 THEN cast((s_nationkey + s_suppkey % 4) * 0.04 AS decimal(18,6)) END AS cached_price,
  cast((s_nationkey + 1) * 0.25 AS decimal(18,6)) AS output_price FROM supplier"""


def prices(t):
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    money = lambda c: c.cast("decimal(18,6)")
    return t.supplier.select(
        k.alias("listing"),
        money((n + 1) * F.lit(0.05)).alias("input_price"),
        F.when(k % 3 > 0, money((n + k % 4) * F.lit(0.04))).alias("cached_price"),
        money((n + 1) * F.lit(0.25)).alias("output_price"),
    )


@query("price_list", f"SELECT listing, input_price, coalesce(cached_price, input_price) AS cached_price, output_price FROM ({_PRICES})")
def _(t):
    return ops.price_list(prices(t))


def usage(t):
    """Reported usage, partly missing or too high, beside what was measured."""
    u, k = t.usage_ev, F.col("renter")
    return u.select(
        "listing",
        "renter",
        "model",
        "sold_at",
        F.when(k % 7 > 0, F.col("prompt_tokens")).alias("prompt_tokens"),
        F.when(k % 7 > 0, F.col("cached_tokens") * F.when(k % 5 == 0, 100).otherwise(1)).alias("cached_tokens"),
        F.when(k % 7 > 0, F.col("output_tokens")).alias("output_tokens"),
        (F.col("prompt_tokens") - F.when(k % 3 == 0, 50).otherwise(0)).alias("request_tokens"),
        (F.expr("output_tokens div 2")).alias("delivered_tokens"),
        F.lit(10).alias("prompt_floor"),
        F.lit(3).alias("output_floor"),
        F.col("output_tokens").alias("max_output_tokens"),
    )


_SETTLED = f"""WITH p AS ({_PRICES}), b AS (SELECT u.*, renter % 7 > 0 AS has, prompt_tokens - CASE WHEN renter % 3 = 0 THEN 50 ELSE 0 END
    AS req, output_tokens // 2 AS del FROM usage_ev u),
  c AS (SELECT *, greatest(least(CASE WHEN has THEN prompt_tokens ELSE 10 END, req), 0) AS bp FROM b),
  d AS (SELECT *, greatest(least(CASE WHEN has THEN cached_tokens * CASE WHEN renter % 5 = 0 THEN 100 ELSE 1 END ELSE 0 END, bp), 0)
    AS bc, greatest(least(CASE WHEN has THEN output_tokens ELSE 3 END, del), 0) AS bo FROM c),
  s AS (SELECT d.*, input_price, output_price, ((bp - bc)::decimal(19,0) * input_price + bc::decimal(19,0) *
    least(coalesce(cached_price, input_price), input_price) + bo::decimal(19,0) * output_price) AS cost_m,
    (req::decimal(19,0) * input_price + output_tokens::decimal(19,0) * output_price) AS res_m FROM d LEFT JOIN p USING (listing))"""


@query(
    "settle_usage",
    f"""{_SETTLED} SELECT listing, count(*) AS requests, sum(bp)::bigint AS prompt_tokens, sum(bc)::bigint AS cached_tokens,
        sum(bo)::bigint AS output_tokens, {r4('(sum(cost_m)::double / 1000000)')} AS cost,
        {r4('((sum(res_m) - sum(cost_m))::double / 1000000)')} AS refund FROM s GROUP BY listing""",
)
def _(t):
    return ops.settlement_totals(ops.settle_usage(usage(t), prices(t)), ["listing"])


def sales(t):
    """Settled requests with what the renter paid."""
    return ops.settle_usage(usage(t), prices(t)).select(
        "listing",
        "renter",
        "model",
        "sold_at",
        F.col("billed_prompt").alias("prompt_tokens"),
        F.col("billed_cached").alias("cached_tokens"),
        F.col("billed_output").alias("output_tokens"),
        F.col("cost").alias("gross"),
    )


def now():
    return F.lit(NOW).cast("timestamp_ntz")


def _period(name, cond):
    return f"""SELECT '{name}' AS period, coalesce(sum(bp), 0)::bigint AS input_tokens, coalesce(sum(bc), 0)::bigint AS
      cached_input_tokens, coalesce(sum(bo), 0)::bigint AS output_tokens, count(*) AS requests, count(DISTINCT renter) AS renters,
      {r4('(coalesce(sum(cost_m), 0)::double / 1000000)')} AS gross_usd, {r4('(coalesce(sum(cost_m), 0)::double / 1000000 * 0.9)')} AS
      earned_usd FROM s WHERE {cond}"""


@query(
    "period_rollup",
    f"""{_SETTLED} {_period('all_time', 'true')} UNION ALL
        {_period('last_30_days', f"sold_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOURS")} UNION ALL
        {_period('last_24_hours', f"sold_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS")}""",
)
def _(t):
    return ops.period_rollup(sales(t), now())


@query(
    "listing_rollup",
    f"""{_SETTLED} SELECT listing, model, count(*) AS requests, sum(bp)::bigint AS input_tokens, sum(bo)::bigint AS output_tokens,
        {r4('(sum(cost_m)::double / 1000000 * 0.9)')} AS earned_usd,
        count(CASE WHEN sold_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOURS THEN 1 END) AS requests_30_days,
        {r4(f"(coalesce(sum(cost_m) FILTER (WHERE sold_at >= TIMESTAMP '{NOW}' - INTERVAL 720 HOURS), 0)::double / 1000000 * 0.9)")}
          AS earned_30_days, strftime(max(sold_at), '%Y-%m-%d') AS last_sold
        FROM s GROUP BY GROUPING SETS ((listing), (listing, model))""",
)
def _(t):
    return ops.listing_rollup(sales(t), now())


@query(
    "daily_series",
    f"""{_SETTLED} SELECT strftime(sold_at, '%Y-%m-%d') AS day, sum(bp)::bigint AS input_tokens, sum(bo)::bigint AS output_tokens,
        {r4('(sum(cost_m)::double / 1000000 * 0.9)')} AS earned_usd FROM s GROUP BY 1""",
)
def _(t):
    return ops.daily_series(sales(t))


@query(
    "earnings_split",
    """SELECT o_custkey, sum(CASE WHEN o_orderstatus = 'O' THEN a ELSE 0 END)::double AS available_usd, sum(CASE WHEN o_orderstatus = 'P'
       THEN a ELSE 0 END)::double AS held_usd, 0::double AS pending_usd, sum(CASE WHEN o_orderstatus = 'F' THEN a ELSE 0 END)::double AS
       paid_usd FROM (SELECT *, o_totalprice::decimal(18,6) AS a FROM orders) GROUP BY o_custkey""",
)
def _(t):
    state = F.when(F.col("o_orderstatus") == "O", "available").when(F.col("o_orderstatus") == "P", "held").otherwise("paid")
    rows = t.orders.select("o_custkey", state.alias("state"), F.col("o_totalprice").alias("amount"))
    return ops.earnings_split(rows, ["o_custkey"])


@query(
    "check_rollup",
    """WITH l AS (SELECT o_custkey AS listing, o_orderpriority AS model, arg_max(o_orderstatus, struct_pack(a := o_orderdate, b :=
         o_orderkey)) AS st FROM orders GROUP BY ALL),
       g AS (SELECT listing, string_agg(CASE WHEN st = 'F' THEN model END, ', ' ORDER BY model) AS f, string_agg(CASE WHEN st = 'P' THEN
         model END, ', ' ORDER BY model) AS w, count(CASE WHEN st = 'O' AND listing % 4 > 0 THEN 1 END) AS ok FROM l GROUP BY listing)
       SELECT listing, CASE WHEN c <> '' THEN CASE WHEN length(c) <= 50 THEN c ELSE left(c, 49) || '…' END WHEN ok > 0 THEN 'ok' ELSE
         '-' END AS "check" FROM (SELECT *, concat_ws('; ', 'failed: ' || f, 'warning: ' || w) AS c FROM g)""",
)
def _(t):
    state = (
        F.when(F.col("o_orderstatus") == "F", "failed")
        .when(F.col("o_orderstatus") == "P", "warning")
        .when(F.col("o_custkey") % 4 > 0, "ok")
    )
    checks = t.orders.select(
        F.col("o_custkey").alias("listing"),
        F.col("o_orderpriority").alias("model"),
        state.alias("state"),
        "o_orderdate",
        "o_orderkey",
    )
    return ops.check_rollup(ops.latest_checks(checks, ["listing", "model"], ["o_orderdate", "o_orderkey"]))


# ---------------------------------------------------------------- capacity

SCENARIOS = [
    {"scenario": "dense", "architecture": "dense", "moe_routing": "expected", "tokens_per_iteration": 1.0, "read_context": 16000},
    {"scenario": "dense-spec", "architecture": "dense", "moe_routing": "expected", "tokens_per_iteration": 3.3616, "read_context": 16000},
    {"scenario": "moe", "architecture": "moe", "moe_routing": "expected", "tokens_per_iteration": 1.0, "read_context": 4000},
    {"scenario": "moe-min", "architecture": "moe", "moe_routing": "minimum", "tokens_per_iteration": 1.0, "read_context": 4000},
    {"scenario": "bad", "architecture": "dense", "moe_routing": "expected", "tokens_per_iteration": 1.0, "read_context": 99000},
]


def hardware(t):
    k = F.col("p_partkey")
    return t.part.select(
        "p_partkey",
        (F.col("p_size") * 8.0).alias("capacity_gb"),
        (F.col("p_retailprice") / 1.5).alias("bandwidth_gbps"),
        (10.0 + k % 90).alias("total_params_b"),
        (1.0 + k % 9).alias("active_params_b"),
        F.lit(5.0).alias("min_tok_s"),
    )


@query(
    "capacity_grid",
    "SELECT p_partkey, s AS scenario, p_size * 8.0::double AS capacity_gb FROM part, (VALUES "
    + ", ".join(f"('{s['scenario']}')" for s in SCENARIOS)
    + ") v(s)",
)
def _(t):
    return cap.capacity_grid(hardware(t), SCENARIOS).select("p_partkey", "scenario", "capacity_gb")


_GRID = "(VALUES " + ", ".join(
    f"('{s['scenario']}', '{s['architecture']}' = 'moe', '{s['moe_routing']}' = 'minimum', {s['tokens_per_iteration']}::double, "
    f"{s['read_context']}::double)"
    for s in SCENARIOS
) + ") v(scenario, moe, minimum, tpi, rc)"

_RATE = """(bw / (CASE WHEN moe AND NOT minimum THEN (trunk + expert * 256 * (1 - pow(1 - 8.0/256, {b} * tpi))) * 4.5 / 8 ELSE active END
  / ({b} * tpi) + kvr))"""


@query(
    "decode_upper_bound",
    f"""WITH g AS (SELECT p_partkey, scenario, moe, minimum, tpi, rc, p_size * 8.0::double AS cap, p_retailprice / 1.5 AS bw,
          (10.0 + p_partkey % 90)::double AS tp, (1.0 + p_partkey % 9)::double AS ap FROM part, {_GRID}),
        h AS (SELECT *, CASE WHEN rc > 32768 THEN 'Read context cannot exceed allocated context' WHEN moe AND ap - 8 * (tp - ap) / 248 < 0
          THEN 'MoE fields imply a negative fixed-parameter trunk' END AS error, tp * (4.5 / 8) AS resident,
          CASE WHEN moe THEN ap ELSE tp END * (4.5 / 8) AS active, (tp - ap) / 248 AS expert, ap - 8 * ((tp - ap) / 248) AS trunk,
          2.0 * 8 * 128 * 2 * 64 * 32768 / 1e9 AS kvs, 2.0 * 8 * 128 * 2 * 64 * rc / 1e9 AS kvr FROM g),
        m AS (SELECT *, cap - resident - 6 AS margin FROM h),
        f AS (SELECT *, CASE WHEN margin >= 0 THEN floor(margin / kvs)::bigint END AS fit FROM m),
        s AS (SELECT *, CASE WHEN error IS NULL AND fit >= 1 THEN {_RATE.format(b='1.0')} END AS single FROM f),
        b AS (SELECT p_partkey, scenario, max(b) AS batch FROM s, range(1, 200) r(b) WHERE error IS NULL AND b <= fit AND single >= 5
          AND {_RATE.format(b='b')} / b >= 5 GROUP BY ALL)
        SELECT p_partkey, scenario, error, CASE WHEN error IS NOT NULL THEN NULL WHEN margin < 0 THEN 'resident-fail' WHEN fit < 1 THEN
          'session-fail' WHEN single < 5 THEN 'floor-fail' ELSE 'usable' END AS state, fit AS fit_batch,
          {r2('single')} AS single_tok_s, batch FROM s LEFT JOIN b USING (p_partkey, scenario)""",
)
def _(t):
    from benchloom.functions.numbers import round2

    got = cap.decode_upper_bound(cap.capacity_grid(hardware(t), SCENARIOS))
    return got.select(
        "p_partkey", "scenario", "error", "state", "fit_batch", round2(F.col("single_tok_s")).alias("single_tok_s"), "batch"
    )
