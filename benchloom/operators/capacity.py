"""Decode capacity: upper bounds of serving a model on hardware."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The inputs assumed when a row does not state them.
DEFAULTS: dict[str, object] = {
    "capacity_gb": 128.0,
    "bandwidth_gbps": 800.0,
    "overhead_gb": 6.0,
    "architecture": "dense",
    "total_params_b": 32.0,
    "active_params_b": 32.0,
    "weight_bits": 4.5,
    "draft_resident_gb": 0.0,
    "draft_traffic_gb": 0.0,
    "moe_routing": "expected",
    "expert_count": 256,
    "experts_per_token": 8,
    "global_layers": 64,
    "local_layers": 0,
    "kv_heads": 8,
    "head_dim": 128,
    "store_bits": 16.0,
    "read_bits": 16.0,
    "fixed_store_gb": 0.0,
    "fixed_read_gb": 0.0,
    "sliding_window": 4096,
    "allocated_context": 32768,
    "read_context": 16000,
    "tokens_per_iteration": 1.0,
    "min_tok_s": 20.0,
}
DECIMAL_GB = 1e9
MAX_SCENARIOS = 10_000


def speculative_tokens(draft: Column, acceptance: Column) -> Column:
    """Expected tokens per step with ``draft`` drafted tokens accepted at a rate."""
    return F.when(acceptance == 1, (draft + 1).cast("double")).otherwise(
        (1 - F.pow(acceptance, draft + 1)) / (1 - acceptance)
    )


def capacity_grid(hardware: DataFrame, scenarios: Sequence[Mapping[str, object]]) -> DataFrame:
    """Every hardware row with every scenario of a list: models and workloads to plan for.

    The scenarios are settings, not data, so each row is expanded in place and nothing is shuffled.
    """
    if not 0 < len(scenarios) <= MAX_SCENARIOS:
        raise ValueError(f"need 1 to {MAX_SCENARIOS} scenarios")
    names = list(scenarios[0])
    entries = F.array(*[F.struct(*[F.lit(s[n]).alias(n) for n in names]) for s in scenarios])
    rows = hardware.withColumn("_s", F.explode(entries))
    return rows.select(*hardware.columns, *[F.col(f"_s.{n}").alias(n) for n in names])


def _kv(context: Column, bits: Column, fixed: Column) -> Column:
    attended = F.col("global_layers") * context + F.col("local_layers") * F.least(context, F.col("sliding_window"))
    size = F.lit(2.0) * F.col("kv_heads") * F.col("head_dim") * (bits / 8) * attended.cast("double")
    return size / DECIMAL_GB + fixed


def decode_upper_bound(grid: DataFrame) -> DataFrame:
    """State and best batch of each grid row.

    ``resident-fail``: weights do not fit; ``session-fail``: no session fits beside them; ``floor-fail``:
    one session is too slow; ``usable``: the largest batch whose sessions all reach the wanted rate.
    A row that contradicts itself carries an ``error`` instead.
    """
    rows = grid.withColumns({n: F.lit(v) for n, v in DEFAULTS.items() if n not in grid.columns})
    moe = F.col("architecture") == "moe"
    experts = F.col("expert_count").cast("double")
    chosen = F.col("experts_per_token").cast("double")
    per_expert = F.try_divide(F.col("total_params_b") - F.col("active_params_b"), experts - chosen)
    trunk = F.col("active_params_b") - chosen * per_expert
    error = (
        F.when(F.col("global_layers") + F.col("local_layers") < 1, "At least one attention layer is required")
        .when(F.col("read_context") > F.col("allocated_context"), "Read context cannot exceed allocated context")
        .when(moe & (F.col("active_params_b") > F.col("total_params_b")), "Active parameters cannot exceed total parameters")
        .when(moe & (chosen >= experts), "Experts per token must be smaller than expert count")
        .when(moe & (trunk < 0), "MoE fields imply a negative fixed-parameter trunk")
    )
    weight = F.col("weight_bits") / 8
    rows = rows.withColumns(
        {
            "error": error,
            "resident_gb": F.col("total_params_b") * weight + F.col("draft_resident_gb"),
            "active_gb": F.when(moe, F.col("active_params_b")).otherwise(F.col("total_params_b")) * weight
            + F.col("draft_traffic_gb"),
            "kv_session_gb": _kv(F.col("allocated_context"), F.col("store_bits"), F.col("fixed_store_gb")),
            "kv_read_gb": _kv(F.col("read_context"), F.col("read_bits"), F.col("fixed_read_gb")),
            "_expert": per_expert,
            "_trunk": trunk,
        }
    )
    rows = rows.withColumn("margin_gb", F.col("capacity_gb") - F.col("resident_gb") - F.col("overhead_gb"))
    rows = rows.withColumn(
        "fit_batch", F.when(F.col("margin_gb") >= 0, F.floor(F.col("margin_gb") / F.col("kv_session_gb")))
    )

    def traffic(batch: Column) -> Column:
        routed = experts * (1 - F.pow(1 - chosen / experts, batch * F.col("tokens_per_iteration")))
        expected = (F.col("_trunk") + F.col("_expert") * routed) * weight + F.col("draft_traffic_gb")
        return F.when(moe & (F.col("moe_routing") != "minimum"), expected).otherwise(F.col("active_gb"))

    def aggregate_rate(batch: Column) -> Column:
        per_token = traffic(batch) / (batch * F.col("tokens_per_iteration")) + F.col("kv_read_gb")
        return F.col("bandwidth_gbps") / per_token

    one = F.lit(1.0)
    runs = F.col("error").isNull() & (F.col("fit_batch") >= 1)
    rows = rows.withColumn("single_tok_s", F.when(runs, aggregate_rate(one)))

    # The rate per session falls with the batch, so the best batch is found by halving; 63 steps cover
    # every long, and a settled range no longer changes.
    def halve(acc: Column, _: Column) -> Column:
        low, high = acc["low"], acc["high"]
        mid = low + F.ceil((high - low) / 2).cast("bigint")
        enough = aggregate_rate(mid.cast("double")) / mid.cast("double") >= F.col("min_tok_s")
        return F.when(low >= high, acc).when(enough, F.struct(mid.alias("low"), high.alias("high"))).otherwise(
            F.struct(low.alias("low"), (mid - 1).alias("high"))
        )

    start = F.struct(F.lit(1).cast("bigint").alias("low"), F.col("fit_batch").cast("bigint").alias("high"))
    usable = F.coalesce(F.col("single_tok_s") >= F.col("min_tok_s"), F.lit(False))
    best = F.when(usable, F.aggregate(F.sequence(F.lit(1), F.lit(63)), start, halve)["low"])
    rows = rows.withColumn("batch", best)
    state = (
        F.when(F.col("error").isNotNull(), None)
        .when(F.col("margin_gb") < 0, "resident-fail")
        .when(F.col("fit_batch") < 1, "session-fail")
        .when(F.col("single_tok_s") < F.col("min_tok_s"), "floor-fail")
        .otherwise("usable")
    )
    blocked = (
        F.when(F.col("state") == "resident-fail", "memory")
        .when(F.col("state") == "session-fail", "kv-cache")
        .when(F.col("state") == "floor-fail", "speed")
    )
    rows = rows.withColumn("state", state).withColumn("blocked_by", blocked)
    return rows.withColumn(
        "aggregate_tok_s", F.when(F.col("batch").isNotNull(), aggregate_rate(F.col("batch").cast("double")))
    ).drop("_expert", "_trunk")
