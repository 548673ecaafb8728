"""Run records: filter, project, group statistics, comparison, edits and checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.naming import canonical_engine_name
from benchloom.functions.numbers import is_better, lower_is_better, measured, round1, round2
from benchloom.functions.text import strip
from benchloom.operators.ordered import as_sequence, drop_marks, exact_percentiles, with_running_sum
from benchloom.session import materialize


def filter_runs(
    runs: DataFrame,
    model: str = "",
    engine: str = "",
    mode: str = "",
    quantization: str = "",
    kind: str = "",
    hardware: str = "",
) -> DataFrame:
    """Rows that match every given option, case ignored; ``hardware`` matches part of the label."""
    equal = {
        "hf_id": model,
        "engine": canonical_engine_name(engine),
        "mode": mode,
        "quantization": quantization,
        "kind": kind,
    }
    for column, wanted in equal.items():
        if wanted:
            runs = runs.where(F.lower(column) == wanted.lower())
    if hardware:
        runs = runs.where(F.contains(F.lower("hardware"), F.lit(hardware.lower())))
    return runs


def dotted(document: Column, path: str) -> Column:
    """Value at a dotted path of a JSON text."""
    return F.get_json_object(document, "$." + path)


def project_fields(runs: DataFrame, fields: Sequence[str], document: str = "props") -> DataFrame:
    """Named fields of each run: a column of the typed head, else a dotted path of the document.

    ``model`` stands for the model id and ``updatedAt`` for the time as RFC 3339 text.
    """
    chosen = []
    for field in fields:
        field = field.strip()
        if field == "model":
            value = F.col("hf_id")
        elif field == "updatedAt":
            value = F.date_format(F.col("updated_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
        elif field in runs.columns:
            value = F.col(field)
        else:
            value = dotted(F.col(document), field)
        chosen.append(value.alias(field))
    return runs.select(*chosen)


def newest_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    """The latest runs; the top-n runs inside each task before anything moves."""
    return runs.orderBy(F.desc("updated_at"), F.asc("path")).limit(limit)


def list_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return newest_runs(runs, limit).select(
        "path",
        F.col("hf_id").alias("model"),
        "engine",
        "mode",
        "quantization",
        "tok_s_out",
        (F.coalesce("tok_s_out", F.lit(0.0)) > 0).alias("can_submit"),
        F.date_format(F.col("updated_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"),
    )


def group_key(field: str, runs: DataFrame) -> Column:
    """Group label of a run: one group for ``all``, ``unknown`` for a blank value."""
    field = field.strip()
    if field in ("", "all", "none"):
        return F.lit("all")
    field = {"quant": "quantization", "model": "hf_id"}.get(field, field)
    value = F.col(field) if field in runs.columns else dotted(F.col("props"), field)
    text = value.cast("string")
    return F.when(strip(F.coalesce(text, F.lit(""))) == "", "unknown").otherwise(text)


def run_group_stats(runs: DataFrame, metric: str = "tok_s_out", by: str = "all") -> DataFrame:
    """Statistics of a metric per group; values of 0 or less are no measurement."""
    lower = lower_is_better(metric)
    rows = runs.select(group_key(by, runs).alias("key"), "path", measured(F.col(metric)).alias("v"))
    best_order = F.struct(F.col("v") if lower else -F.col("v"), F.col("path"))
    basic = rows.groupBy("key").agg(
        F.count(F.lit(1)).alias("runs"),
        F.count("v").alias("metric_runs"),
        F.min("v").alias("min"),
        F.avg("v").alias("mean"),
        F.max("v").alias("max"),
        F.stddev_samp("v").alias("stddev"),
        (F.min("v") if lower else F.max("v")).alias("best"),
        F.min(F.when(F.col("v").isNotNull(), best_order))["path"].alias("best_run"),
    )
    ranked = exact_percentiles(rows, ["key"], "v", {"p50": 0.5, "p95": 0.95}).select(
        F.col("key").alias("_key"), "p50", "p95"
    )
    return basic.join(ranked, F.col("key") == F.col("_key"), "left").select(
        "key",
        "runs",
        "metric_runs",
        *[round2(F.col(c)).alias(c) for c in ("min", "p50", "mean", "max", "p95")],
        round2(F.when(F.col("metric_runs") > 1, F.col("stddev"))).alias("stddev"),
        round2(F.col("best")).alias("best"),
        "best_run",
    )


def metric_summary(runs: DataFrame, metric: str) -> DataFrame:
    """Count, min, p50, mean, max and sample deviation of one metric."""
    rows = runs.select(measured(F.col(metric)).alias("v"))
    basic = rows.agg(
        F.count("v").alias("count"),
        round2(F.min("v")).alias("min"),
        round2(F.avg("v")).alias("mean"),
        round2(F.max("v")).alias("max"),
        F.when(F.count("v") > 1, round2(F.stddev_samp("v"))).alias("stddev"),
    )
    middle = exact_percentiles(rows, [], "v", {"p50": 0.5}).select(round2(F.col("p50")).alias("p50"))
    return basic.join(F.broadcast(middle), F.lit(True), "left")  # one row on each side


def rank_groups(stats: DataFrame, metric: str) -> DataFrame:
    """Groups with their rank by best value; equal values share a rank, no value comes last."""
    worst = F.lit(float("inf"))
    score = F.coalesce(F.col("best") if lower_is_better(metric) else -F.col("best"), worst)
    stats = stats.withColumn("_score", score)
    levels = stats.groupBy("_score").agg(F.count(F.lit(1)).alias("_n"))
    ahead = with_running_sum(as_sequence(levels, [], ["_score"]), [], "_n", "_upto")
    ranks = drop_marks(ahead).select(F.col("_score").alias("_s"), (F.col("_upto") - F.col("_n") + 1).alias("rank"))
    return stats.join(ranks, F.col("_score") == F.col("_s")).drop("_score", "_s")


def best_run(runs: DataFrame, metric: str, by: str) -> DataFrame:
    """The run behind the best value of each group (first path among equals)."""
    value = measured(F.col(metric))
    order = F.struct(value if lower_is_better(metric) else -value, F.col("path"))
    return (
        runs.where(value.isNotNull())
        .groupBy(group_key(by, runs).alias("key"))
        .agg(F.min_by(F.struct("path", "hf_id", "engine", "mode", "quantization", "hardware", metric), order).alias("b"))
        .select("key", "b.*")
    )


def comparison_columns(value: Column, base: Column, lower: Column) -> dict[str, Column]:
    """Signed delta (positive is better), ratio, percent and verdict; null unless both are positive."""
    both = (base > 0) & (value > 0)
    delta = F.when(lower, base - value).otherwise(value - base)
    return {
        "delta": F.when(both, round2(delta)),
        "ratio": F.when(both, round2(value / base)),
        "percent": F.when(both, round2(delta / base * 100)),
        "better": F.when(both, is_better(value, base, lower)),
    }


def compare_groups(
    runs: DataFrame, metric: str = "tok_s_out", by: str = "quantization", baseline: str = ""
) -> DataFrame:
    """Every group against a baseline group: the named one, else the one with the best value."""
    # One row per group, read twice below: for the baseline and for the rows.
    stats = materialize(run_group_stats(runs, metric, by), "groups").withColumn(
        "stat", F.when(F.coalesce("p50", F.lit(0.0)) > 0, F.col("p50")).otherwise(F.coalesce("best", F.lit(0.0)))
    )
    lower = lower_is_better(metric)
    best = F.coalesce("best", F.lit(0.0))
    preferred = F.struct(
        (F.lower("key") != baseline.lower()) if baseline else F.lit(True), best if lower else -best, F.col("key")
    )
    base = stats.agg(F.min_by(F.struct("key", "stat"), preferred).alias("b")).select(
        F.col("b.key").alias("baseline"), F.col("b.stat").alias("base")
    )
    rows = stats.join(F.broadcast(base), F.lit(True))  # the baseline is exactly one row
    return rows.select(
        F.col("key").alias("name"),
        F.lit(metric).alias("metric"),
        round2(F.col("stat")).alias("value"),
        "baseline",
        round2(F.col("base")).alias("baseline_value"),
        *[c.alias(n) for n, c in comparison_columns(F.col("stat"), F.col("base"), F.lit(lower)).items()],
    )


def compare_pairs(pairs: DataFrame, metrics: Sequence[str], left: str = "left_", right: str = "right_") -> DataFrame:
    """Two runs per row, metric by metric; a metric that is 0 on both sides is left out."""
    entries = F.array(
        *[
            F.struct(
                F.lit(m).alias("metric"),
                F.coalesce(F.col(left + m), F.lit(0.0)).alias("base"),
                F.coalesce(F.col(right + m), F.lit(0.0)).alias("v"),
                F.lit(lower_is_better(m)).alias("lower"),
            )
            for m in metrics
        ]
    )
    keys = [c for c in pairs.columns if not c.startswith((left, right))]
    rows = pairs.select(*keys, F.explode(entries).alias("e")).select(*keys, "e.*")
    rows = rows.where(~((F.col("base") == 0) & (F.col("v") == 0)))
    return rows.select(
        *keys,
        "metric",
        round2(F.col("v")).alias("value"),
        round2(F.col("base")).alias("baseline_value"),
        *[c.alias(n) for n, c in comparison_columns(F.col("v"), F.col("base"), F.col("lower")).items()],
    )


# What a submitted run must carry.
REQUIRED_FIELDS = {
    "hf_id": "Model ID is required",
    "engine": "Engine name is required",
    "quantization": "Quantization is required",
    "hardware": "Hardware is required",
}
PERFORMANCE_FIELDS = ["ttft_ms", "tok_s_out", "tok_s_total"]


def validate_runs(runs: DataFrame) -> DataFrame:
    """Each run with its field errors and whether any performance metric is positive."""
    missing = [
        F.when(strip(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "", F.concat(F.lit(f + ": "), F.lit(text)))
        for f, text in REQUIRED_FIELDS.items()
    ]
    numbers = [
        F.when(F.col(f).isNotNull() & ~(F.col(f) > 0), F.lit(f + ": Must be a positive number"))
        for f in PERFORMANCE_FIELDS
    ]
    measured_any = F.lit(False)
    for f in PERFORMANCE_FIELDS:
        measured_any = measured_any | F.coalesce(F.col(f) > 0, F.lit(False))
    none = F.when(~measured_any, F.lit("At least one performance metric is required"))
    return runs.withColumn("field_errors", F.array_compact(F.array(*missing, *numbers))).withColumn(
        "form_errors", F.array_compact(F.array(none))
    )


def patch_runs(
    runs: DataFrame,
    patches: DataFrame,
    key: str,
    fields: Sequence[str],
    set_values: dict[str, Column] | None = None,
    unset: Sequence[str] = (),
    named: str | None = None,
    order: str | None = None,
) -> DataFrame:
    """Edit the runs that have a patch: values of the patch win, then ``set_values``, then ``unset`` clears.

    ``named`` is a column of the patches with the names of the fields each one holds (``field`` or
    ``field.member``); a field held as null is cleared.  Without it a null counts as not held.  Of several
    patches of one key the last by ``order`` that holds a field wins (ties: the larger value), so a run is never
    doubled.  A struct field is merged member by member.
    """

    def leaves(name: str) -> list[str]:
        kind = runs.schema[name].dataType
        return [f"{name}.{m}" for m in kind.names] if kind.typeName() == "struct" else [name]

    place = {leaf: f"_new_{i}" for i, leaf in enumerate(x for f in fields for x in leaves(f))}

    def newest(leaf: str) -> Column:
        held = F.col(leaf).isNotNull()
        if named:
            # A patch that names the whole struct holds all its members.
            held = F.array_contains(named, leaf) | F.array_contains(named, leaf.split(".")[0])
        at = F.col(order) if order else F.lit(0)
        return F.max(F.when(held, F.struct(at.alias("at"), F.col(leaf).alias("value"))))

    by_key = patches.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"))
    last = by_key.agg(F.lit(True).alias("_patched"), *[newest(leaf).alias(n) for leaf, n in place.items()])
    rows = runs.join(last, F.col(key) == F.col("_key"), "left")
    patched = F.col("_patched").isNotNull()

    def merged_leaf(leaf: str) -> Column:
        new = F.col(place[leaf])
        return F.when(new.isNotNull(), new["value"]).otherwise(F.col(leaf))

    def merged(name: str) -> Column:
        if name in unset:
            return F.when(~patched, F.col(name))
        if set_values and name in set_values:
            return F.when(patched, set_values[name]).otherwise(F.col(name))
        if name not in fields:
            return F.col(name)
        if runs.schema[name].dataType.typeName() == "struct":
            whole = F.struct(*[merged_leaf(leaf).alias(leaf.split(".", 1)[1]) for leaf in leaves(name)])
            return F.when(patched, whole).otherwise(F.col(name))
        return merged_leaf(name)

    return rows.select(*[merged(c).alias(c) for c in runs.columns])


def comparable_metrics(runs: DataFrame, mode: str = "mode") -> DataFrame:
    """Fill the time to the first token and the total rate of local runs from prefill and decode rates."""
    local = F.col(mode) == "local"
    prompt, output = F.coalesce("prompt_tokens", F.lit(0.0)), F.coalesce("output_tokens", F.lit(0.0))
    prefill, decode = F.coalesce("tok_s_prefill", F.lit(0.0)), F.coalesce("tok_s_out", F.lit(0.0))
    ttft, total = F.coalesce("ttft_ms", F.lit(0.0)), F.coalesce("tok_s_total", F.lit(0.0))
    fill_ttft = local & (ttft == 0) & (prompt > 0) & (prefill > 0)
    fill_total = local & (total == 0) & (prompt > 0) & (output > 0) & (prefill > 0) & (decode > 0)
    new_ttft = F.when(fill_ttft, round1(prompt / prefill * 1000)).otherwise(ttft)
    seconds = prompt / prefill + output / decode
    return runs.select(
        *[c for c in runs.columns if c not in ("ttft_ms", "tok_s_total")],
        new_ttft.alias("ttft_ms"),
        F.when(fill_ttft, "estimated_from_prefill")
        .when(new_ttft > 0, F.when(local, "reported").otherwise("stream_first_token"))
        .alias("ttft_source"),
        F.when(fill_total, round1((prompt + output) / seconds)).otherwise(total).alias("tok_s_total"),
        F.when(fill_total, "derived_from_prefill_and_decode").alias("tok_s_total_source"),
        F.when(local, "local_runtime").otherwise("remote_endpoint").alias("metric_source"),
    )
