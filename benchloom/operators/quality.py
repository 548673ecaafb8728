"""Benchmark data sets: column mapping, import, validation, audit, redaction and sharding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from benchloom.functions.answers import choice_list, valid_choice_gold
from benchloom.functions.documents import ANSWER_KEYS, without_keys
from benchloom.functions.text import collapsed_text, strip
from benchloom.operators.ordered import as_sequence, drop_marks, lookup_by_key, with_position
from benchloom.session import materialize

# Column names a data set may use, best first.
COLUMN_ALIASES = {
    "input": ["input", "question", "prompt", "instruction"],
    "gold": ["gold", "answer", "label", "target", "expected_answer"],
    "choices": ["choices", "options", "answers"],
    "rubric": ["rubric", "grading_rubric", "criteria"],
}


def resolve_columns(columns: Sequence[str], explicit: Mapping[str, str] | None = None) -> dict[str, str]:
    """Column of each role: the explicit one (must exist), else the first alias present, case ignored."""
    found: dict[str, str] = {}
    for role, aliases in COLUMN_ALIASES.items():
        stated = (explicit or {}).get(role)
        if stated:
            if stated not in columns:
                raise ValueError(f"column {stated!r} given for {role} does not exist")
            found[role] = stated
            continue
        for alias in aliases:
            match = next((c for c in columns if c.strip().lower() == alias), None)
            if match is not None:
                found[role] = match
                break
    return found


def infer_kind(found: Mapping[str, str]) -> str:
    if "rubric" in found:
        return "judge"
    return "multiple_choice" if "choices" in found else "qa"


def map_columns(rows: DataFrame, explicit: Mapping[str, str] | None = None, kind: str = "") -> DataFrame:
    """Rows with their role columns named ``input``, ``gold``, ``choices`` and ``rubric``, and their kind."""
    found = resolve_columns(rows.columns, explicit)
    kind = kind or infer_kind(found)
    needed = {"judge": ["input", "rubric"], "multiple_choice": ["input", "gold", "choices"]}.get(kind, ["input", "gold"])
    missing = [role for role in needed if role not in found]
    if missing:
        raise ValueError(f"no column found for {', '.join(missing)}")
    others = [F.col(f"`{c}`") for c in rows.columns if c not in found.values()]
    roles = [F.col(f"`{column}`").alias(role) for role, column in found.items()]
    return rows.select(*others, *roles, F.lit(kind).alias("kind"))


def import_items(rows: DataFrame, kind: str = "qa", separator: str = "|") -> DataFrame:
    """Items with trimmed input and parsed choices; ``error`` says why a row cannot be imported."""
    text = strip(F.coalesce(F.col("input").cast("string"), F.lit("")))
    problem = F.when(text == "", "no input")
    if kind == "judge":
        rows = rows.withColumn("rubric", strip(F.coalesce("rubric", F.lit(""))))
        problem = problem.when(F.col("rubric") == "", "no rubric")
    else:
        problem = problem.when(F.col("gold").isNull(), "no gold")
    if kind in ("multiple_choice", "loglikelihood"):
        rows = rows.withColumn("choices", choice_list(F.col("choices"), separator))
        problem = problem.when(F.coalesce(F.size("choices"), F.lit(0)) < 2, "needs at least two choices")
    return rows.withColumn("input", text).withColumn("error", problem)


# ---------------------------------------------------------------- audit


def _issue(condition: Column, severity: str, code: str, path: Column) -> Column:
    return F.when(
        condition, F.struct(F.lit(severity).alias("severity"), F.lit(code).alias("code"), path.alias("path"))
    )


def checked_items(items: DataFrame) -> DataFrame:
    """One narrow row per item: path, place, input key, gold answer and the item's own issues.

    The texts are read once, here; everything after works on this table.
    """
    text, gold = strip(F.coalesce("input", F.lit(""))), strip(F.coalesce("gold", F.lit("")))
    rows = items.select("path", "place", text.alias("text"), gold.alias("gold"), "choices")
    has_choices = F.coalesce(F.size("choices"), F.lit(0)) > 0
    plain = F.transform("choices", collapsed_text)
    issues = F.array_compact(
        F.array(
            _issue(F.octet_length("text") > 12000, "warning", "input_very_long", F.concat("path", F.lit(".input"))),
            _issue(
                (F.octet_length("gold") >= 4) & F.contains(F.lower("text"), F.lower("gold")),
                "warning",
                "possible_gold_leak",
                F.col("path"),
            ),
            _issue(
                has_choices & (F.size(F.array_distinct(plain)) < F.size("choices")),
                "error",
                "duplicate_choice",
                F.concat("path", F.lit(".choices")),
            ),
            _issue(
                has_choices & ~valid_choice_gold(F.col("gold"), F.col("choices")),
                "error",
                "invalid_choice_gold",
                F.concat("path", F.lit(".gold")),
            ),
        )
    )
    return rows.select(
        "path", "place", F.sha2(collapsed_text(F.col("text")), 256).alias("key"), F.upper("gold").alias("gold"), issues.alias("issues")
    )


def duplicate_inputs(rows: DataFrame, key: str = "key", place: str = "place", path: str = "path") -> DataFrame:
    """Rows whose key occurred earlier, with the path of the first one."""
    firsts = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("copies"), F.min(place).alias("_first"), F.min_by(path, place).alias("duplicates")
    )
    repeated = firsts.where(F.col("copies") > 1)
    found = lookup_by_key(rows.select(path, place, key), repeated, key, "copies")
    return found.where(F.col(place) > F.col("_first")).select(path, "duplicates", "copies")


def answer_balance(golds: DataFrame, gold: str = "gold", by: Sequence[str] = ()) -> DataFrame:
    """Distribution of gold answers and whether it is strongly uneven."""
    counts = golds.where(F.coalesce(F.col(gold), F.lit("")) != "").groupBy(*by, F.upper(gold).alias("_g")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    return (
        counts.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("answers"),
            F.sum("_n").alias("items"),
            F.min("_n").alias("least"),
            F.max("_n").alias("most"),
        )
        .withColumn(
            "imbalanced", (F.col("answers") > 1) & (F.col("items") >= 20) & (F.col("most") > F.col("least") * 3)
        )
    )


def audit_items(items: DataFrame, description: str = "", source_url: str = "") -> DataFrame:
    """All issues of a data set as (severity, code, path)."""
    spark = items.sparkSession
    checked = materialize(checked_items(items), "audit")
    own = checked.select(F.explode("issues").alias("i")).select("i.*")
    copies = duplicate_inputs(checked).select(
        F.lit("error").alias("severity"), F.lit("duplicate_input").alias("code"), F.concat("path", F.lit(".input")).alias("path")
    )
    total = checked.agg(F.count(F.lit(1)).alias("n"))
    small = total.where(F.col("n").between(1, 19)).select(
        F.lit("warning").alias("severity"), F.lit("dataset_small").alias("code"), F.lit("tasks").alias("path")
    )
    balance = answer_balance(checked).join(F.broadcast(total), F.lit(True))  # one row on each side
    uneven = balance.where(
        (F.col("answers") > 1) & (F.col("n") >= 20) & (F.col("most") > F.col("least") * 3)
    ).select(F.lit("warning").alias("severity"), F.lit("answer_imbalance").alias("code"), F.lit("tasks").alias("path"))
    issues = own.unionByName(copies).unionByName(small).unionByName(uneven)
    for value, code, path in ((description, "description_missing", "description"), (source_url, "source_missing", "sourceUrl")):
        if not value.strip():
            issues = issues.unionByName(
                spark.range(1).select(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit(path).alias("path"))
            )
    return issues


def sorted_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy("severity", "path", "code")


def audit_summary(issues: DataFrame, items: DataFrame, description: str = "", strict: bool = False) -> DataFrame:
    """Counts, validity, and whether the data set may be published."""
    counts = issues.agg(
        F.count_if(F.col("severity") == "error").alias("error_count"),
        F.count_if(F.col("severity") != "error").alias("warning_count"),
    )
    total = items.agg(F.count(F.lit(1)).alias("item_count"))
    row = total.join(F.broadcast(counts), F.lit(True))  # one row on each side
    clean = F.col("error_count") == 0
    gate = clean & (F.lit(not strict) | (F.col("warning_count") == 0)) & F.lit(len(description.strip().encode()) >= 20)
    return row.withColumn("valid", clean).withColumn("publishable", gate)


# ---------------------------------------------------------------- suites

# What a suite may state.
RUNNERS = {"CUSTOM": "custom", "LM_EVAL_HARNESS": "lm-eval-harness"}
SCORING_METHODS = ["exact_match", "f1", "pass_at_k", "perplexity", "llm_judge", "user_rating", "loglikelihood"]
EXTRACTIONS = ["none", "last_number", "regex"]


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string"), F.lit("")) == ""


def _errors(df: DataFrame, keep: Sequence[str], path: Column, rules: Mapping[str, Column]) -> DataFrame:
    found = F.array_compact(
        F.array(*[F.when(F.coalesce(broken, F.lit(False)), F.lit(text)) for text, broken in rules.items()])
    )
    return df.select(*keep, path.alias("path"), F.explode(found).alias("message"))


def validate_suites(suites: DataFrame) -> DataFrame:
    """Structural errors of suites (columns slug, name, category, runner, doc_runner, scoring_method, tasks)."""
    size = lambda c: F.octet_length(F.coalesce(c, F.lit("")))
    custom = F.when(F.col("runner") == "LM_EVAL_HARNESS", "lm-eval-harness").otherwise("custom")
    rules = {
        "slug is required": _blank("slug"),
        "name is required": _blank("name"),
        "runner is required": _blank("runner"),
        "slug must be 3-64 lowercase alphanumeric characters with hyphens": ~F.coalesce("slug", F.lit("")).rlike(
            "^[a-z0-9]+(?:-[a-z0-9]+)*$"
        )
        | ~size("slug").between(3, 64),
        "name is required and must be <= 256 chars": ~size("name").between(1, 256),
        "category is required and must be <= 64 chars": ~size("category").between(1, 64),
        "runner must be CUSTOM or LM_EVAL_HARNESS": ~F.coalesce("runner", F.lit("")).isin(*RUNNERS),
        "runner of the suite document does not fit": F.coalesce("doc_runner", F.lit("")) != custom,
        "scoringMethod is invalid": ~F.coalesce("scoring_method", F.lit("")).isin(*SCORING_METHODS),
        "perplexity scoring is not supported yet": F.col("scoring_method") == "perplexity",
        "tasks must contain at least one task": F.col("tasks") == 0,
        "tasks cannot exceed 100 tasks": F.col("tasks") > 100,
    }
    return _errors(suites, ["suite"], F.lit("suite"), rules)


def validate_tasks(tasks: DataFrame) -> DataFrame:
    """Structural errors of tasks; a key seen at a smaller index is a duplicate."""
    first = tasks.groupBy("suite", "key").agg(F.min("task_index").alias("_first"))
    rows = tasks.join(first.withColumnRenamed("key", "_key").withColumnRenamed("suite", "_suite"),
                      (F.col("suite") == F.col("_suite")) & F.col("key").eqNullSafe(F.col("_key")))
    custom = F.col("runner") == "CUSTOM"
    rules = {
        "key is required": _blank("key"),
        "key is a duplicate": F.col("task_index") > F.col("_first"),
        "displayName is required": _blank("display_name"),
        "promptTemplate is required for CUSTOM suites": custom & _blank("prompt_template"),
        "answerExtraction must be none, last_number, or regex": custom
        & ~_blank("answer_extraction")
        & ~F.col("answer_extraction").isin(*EXTRACTIONS),
        "answerRegex is required when answerExtraction is regex": custom
        & (F.col("answer_extraction") == "regex")
        & _blank("answer_regex"),
        "dataset is required for CUSTOM suites": custom & F.col("items").isNull(),
        "dataset.items is required for inline datasets": custom & (F.col("items") == 0),
    }
    return _errors(rows, ["suite", "task_index"], F.concat(F.lit("tasks["), F.col("task_index").cast("string"), F.lit("]")), rules)


def validate_suite_items(items: DataFrame) -> DataFrame:
    """Structural errors of inline items."""
    rules = {
        "input is required": _blank("input"),
        "needs gold or rubric": F.col("gold").isNull() & F.col("rubric").isNull(),
        "choices is required for multiple_choice tasks": (F.col("task_type") == "multiple_choice")
        & (F.coalesce(F.size("choices"), F.lit(0)) <= 0),
    }
    path = F.concat(F.lit("items["), F.col("item_index").cast("string"), F.lit("]"))
    return _errors(items, ["suite", "item_index"], path, rules)


# ---------------------------------------------------------------- redaction, sampling, sharding


def redact_labels(rows: DataFrame, document: str | None = None) -> DataFrame:
    """Drop answer columns, and answer keys at any depth of a JSON document column."""
    kept = rows.drop(*[c for c in rows.columns if c in ANSWER_KEYS])
    return kept.withColumn(document, without_keys(F.col(document), ANSWER_KEYS)) if document else kept


def balanced_sample(results: DataFrame, by: Sequence[str], order: str, limit: int) -> DataFrame:
    """Scored rows in order, at most ``limit // 2`` failing and the rest passing per group; all of them
    if ``limit`` is 0 or less.

    The rank filter is applied inside each task before the shuffle, so a large group never meets in one task.
    """
    if limit <= 0:
        return results.where("scored")
    fails = limit // 2
    place = F.row_number().over(Window.partitionBy(*by, "pass").orderBy(order))
    rows = results.where("scored").withColumn("_place", place)
    rows = rows.where(F.col("_place") <= max(fails, limit - fails))
    return rows.where(F.col("_place") <= F.when(F.col("pass"), limit - fails).otherwise(fails)).drop("_place")


def shard_assign(rows: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Add the shard (from 0) of each row: shard i holds rows i*n/c up to (i+1)*n/c in order."""
    placed = with_position(as_sequence(rows, [], order))
    total = rows.agg(F.count(F.lit(1)).alias("_n"))
    placed = drop_marks(placed).join(F.broadcast(total), F.lit(True))  # the total is one row
    # The largest i with floor(i*n/c) <= p is the largest with i*n < (p+1)*c.
    return placed.withColumn("shard", F.expr(f"((position + 1) * {int(shards)} - 1) div _n")).drop("_n")
