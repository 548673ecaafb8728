"""Marketplace: settlement, period and listing rollups, prices, earnings and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions.numbers import round4
from benchloom.operators.joins import first_per_key

# Widths that keep every product exact: prices up to a million dollars, counts up to 1e12 tokens.
PRICE = "decimal(12,6)"
TOKENS = "decimal(12,0)"
MONEY = "decimal(28,12)"
PERIODS = {"all_time": None, "last_30_days": 30 * 24, "last_24_hours": 24}


def price_list(listings: DataFrame) -> DataFrame:
    """Listings with the price of cached input, which defaults to the input price."""
    return listings.withColumn("cached_price", F.coalesce("cached_price", "input_price"))


def _cost(prompt: Column, cached: Column, output: Column) -> Column:
    """Price of token counts in millionths of a dollar, exact."""
    fresh = (prompt - cached).cast(TOKENS) * F.col("input_price")
    hits = cached.cast(TOKENS) * F.col("_cached_price")
    return fresh + hits + output.cast(TOKENS) * F.col("output_price")


def settle_usage(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Bill each request from its reported usage, checked against what was measured.

    Output cannot exceed what was delivered, prompt not the request, cached not the prompt.  Without
    usage the lower bounds count.  ``reserved`` is the most the request could cost and ``refund`` the
    part of it that was not used.  Amounts are in dollars.  A request whose listing has no price keeps its
    tokens, has no amounts and ``error`` set.
    """
    table = prices.select(
        "listing",
        F.col("input_price").cast(PRICE).alias("input_price"),
        F.least(F.coalesce("cached_price", "input_price"), F.col("input_price")).cast(PRICE).alias("_cached_price"),
        F.col("output_price").cast(PRICE).alias("output_price"),
        F.lit(True).alias("_priced"),
    )
    zero = F.lit(0)
    prompt = F.least(F.coalesce("prompt_tokens", "prompt_floor", zero), F.col("request_tokens"))
    rows = usage.join(table, "listing", "left").withColumn("billed_prompt", F.greatest(prompt, zero))
    rows = rows.withColumn(
        "billed_cached", F.greatest(F.least(F.coalesce("cached_tokens", zero), F.col("billed_prompt")), zero)
    ).withColumn(
        "billed_output",
        F.greatest(F.least(F.coalesce("output_tokens", "output_floor", zero), F.col("delivered_tokens")), zero),
    )
    settled = _cost(F.col("billed_prompt"), F.col("billed_cached"), F.col("billed_output"))
    reserved = _cost(F.col("request_tokens"), zero, F.col("max_output_tokens"))
    per_million = F.lit("0.000001").cast("decimal(6,6)")
    return (
        rows.withColumn("cost", (settled * per_million).cast(MONEY))
        .withColumn("reserved", (reserved * per_million).cast(MONEY))
        .withColumn("refund", F.col("reserved") - F.col("cost"))
        .withColumn("error", F.when(F.col("_priced").isNull(), F.lit("listing has no price")))
        .drop("_priced")
        .drop("_cached_price")
    )


def settlement_totals(settled: DataFrame, by: Sequence[str]) -> DataFrame:
    return settled.groupBy(*by).agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("billed_prompt").alias("prompt_tokens"),
        F.sum("billed_cached").alias("cached_tokens"),
        F.sum("billed_output").alias("output_tokens"),
        round4(F.sum("cost").cast("double")).alias("cost"),
        round4(F.sum("refund").cast("double")).alias("refund"),
    )


def _since(now: Column, hours: int | None) -> Column:
    return F.lit(True) if hours is None else F.col("sold_at") >= now - F.expr(f"INTERVAL {hours} HOURS")


def period_rollup(sales: DataFrame, now: Column, share: float = 0.9) -> DataFrame:
    """Tokens, requests, distinct renters and money per period, one row per period.

    Sales are summed per renter first, so distinct renters are counted from one row each.
    """
    sums = []
    for name, hours in PERIODS.items():
        inside = _since(now, hours)
        for field in ("prompt_tokens", "cached_tokens", "output_tokens"):
            sums.append(F.sum(F.when(inside, F.col(field)).otherwise(0)).alias(f"{field}_{name}"))
        sums.append(F.count_if(inside).alias(f"requests_{name}"))
        sums.append(F.sum(F.when(inside, F.col("gross")).otherwise(0)).alias(f"gross_{name}"))
    renters = sales.groupBy("renter").agg(*sums)
    totals = []
    for name in PERIODS:
        for field in ("prompt_tokens", "cached_tokens", "output_tokens", "requests", "gross"):
            totals.append(F.sum(f"{field}_{name}").alias(f"{field}_{name}"))
        totals.append(F.count_if(F.col(f"requests_{name}") > 0).alias(f"renters_{name}"))
    wide = renters.agg(*totals)

    def row(name: str) -> Column:
        gross = F.col(f"gross_{name}").cast("double")
        return F.struct(
            F.lit(name).alias("period"),
            F.col(f"prompt_tokens_{name}").alias("input_tokens"),
            F.col(f"cached_tokens_{name}").alias("cached_input_tokens"),
            F.col(f"output_tokens_{name}").alias("output_tokens"),
            F.col(f"requests_{name}").alias("requests"),
            F.col(f"renters_{name}").alias("renters"),
            round4(gross).alias("gross_usd"),
            round4(gross * share).alias("earned_usd"),
        )

    return wide.select(F.explode(F.array(*[row(n) for n in PERIODS])).alias("r")).select("r.*")


def listing_rollup(sales: DataFrame, now: Column, share: float = 0.9) -> DataFrame:
    """Requests, tokens and earnings per listing and model, with totals per listing (model null)."""
    month = _since(now, PERIODS["last_30_days"])
    rows = sales.rollup("listing", "model").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum("prompt_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        round4(F.sum("gross").cast("double") * share).alias("earned_usd"),
        F.count_if(month).alias("requests_30_days"),
        round4(F.sum(F.when(month, F.col("gross")).otherwise(0)).cast("double") * share).alias("earned_30_days"),
        F.date_format(F.max("sold_at").cast("timestamp"), "yyyy-MM-dd").alias("last_sold"),
    )
    return rows.where(F.col("listing").isNotNull())


def daily_series(sales: DataFrame, share: float = 0.9) -> DataFrame:
    return sales.groupBy(F.date_format(F.col("sold_at").cast("timestamp"), "yyyy-MM-dd").alias("day")).agg(
        F.sum("prompt_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        round4(F.sum("gross").cast("double") * share).alias("earned_usd"),
    )


def earnings_split(earnings: DataFrame, by: Sequence[str] = (), states: Sequence[str] = ("available", "held", "pending", "paid")) -> DataFrame:
    """Earned amount per payout state, one column each."""
    exact = F.col("amount").cast("decimal(18,6)")
    return earnings.groupBy(*by).agg(
        *[
            F.coalesce(F.sum(F.when(F.col("state") == s, exact)).cast("double"), F.lit(0.0)).alias(f"{s}_usd")
            for s in states
        ]
    )


def latest_checks(checks: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Latest check of each listing model."""
    return first_per_key(checks, keys, [F.desc(c) for c in order])


def check_rollup(models: DataFrame, listing: str = "listing", width: int = 50) -> DataFrame:
    """Check cell of each listing: failed and warning models by name, else ``ok``, else ``-``.

    ``models`` holds one row per listing model.  A cell shows ``width`` characters, which the first
    ``width // 3 + 1`` names always fill (a name and its separator are three characters or more), so
    later names are dropped inside each task before anything is put together.
    """
    marked = models.where(F.col("state").isin("failed", "warning"))
    place = F.row_number().over(Window.partitionBy(listing, "state").orderBy("model"))
    shown = marked.withColumn("_place", place).where(F.col("_place") <= width // 3 + 1)
    names = lambda s: F.array_join(
        F.array_sort(F.collect_list(F.when(F.col("state") == s, F.col("model")))), ", "
    )
    cells = shown.groupBy(F.col(listing).alias("_listing")).agg(
        names("failed").alias("_failed"), names("warning").alias("_warning")
    )
    passed = models.groupBy(listing).agg(F.count_if(F.col("state") == "ok").alias("_ok"))
    rows = passed.join(cells, F.col(listing) == F.col("_listing"), "left")
    text = F.array_join(
        F.array_compact(
            F.array(
                F.when(F.col("_failed") != "", F.concat(F.lit("failed: "), "_failed")),
                F.when(F.col("_warning") != "", F.concat(F.lit("warning: "), "_warning")),
            )
        ),
        "; ",
    )
    cut = F.when(F.char_length(text) <= width, text).otherwise(F.concat(F.left(text, F.lit(width - 1)), F.lit("…")))
    return rows.select(listing, F.when(text != "", cut).when(F.col("_ok") > 0, "ok").otherwise("-").alias("check"))
