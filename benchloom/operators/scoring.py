"""Scores: single items, samples, tasks and suites."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.answers import (
    answers_match,
    choice_letter,
    default_template,
    extracted_answer,
    judge_score,
    letter_of_plain,
    rendered_prompt,
    reward,
    with_final_answer,
)
from benchloom.functions.numbers import round4
from benchloom.functions.text import first_non_empty, normal_text, strip

# ---------------------------------------------------------------- single items


def score_exact(rows: DataFrame, mode: str = "final_answer", pattern: str | None = None) -> DataFrame:
    """Add ``predicted`` and ``pass``: the extracted answer against the gold answer."""
    if mode == "final_answer":
        rows = with_final_answer(rows, "response", "predicted", "_rule").drop("_rule")
    else:
        rows = rows.withColumn("predicted", extracted_answer(F.col("response"), mode, pattern))
    return rows.withColumn("pass", answers_match(F.col("predicted"), F.col("gold")))


def score_choice(rows: DataFrame) -> DataFrame:
    """Add ``predicted``, ``gold_letter`` and ``pass``: letters must agree and not be empty."""
    rows = rows.withColumn("_plain", normal_text(F.col("response")))
    rows = rows.withColumn("predicted", letter_of_plain(F.col("_plain"), F.col("choices"))).withColumn(
        "gold_letter", choice_letter(F.col("gold"), F.col("choices"))
    )
    same = (F.col("predicted") != "") & (F.col("predicted") == F.col("gold_letter"))
    return rows.withColumn("pass", same).drop("_plain")


def _shared_words(left: str, right: str) -> int:
    return (Counter(left.split()) & Counter(right.split())).total() if left and right else 0


def token_f1(rows: DataFrame, response: str = "response", gold: str = "gold") -> DataFrame:
    """Add ``f1`` of the two bags of words; 0 when either is empty or nothing is shared.

    A bag has no built-in form inside a row, and exploding words would shuffle every text, so the
    one number that needs counting, the shared words, comes from Arrow batches.
    """

    @F.pandas_udf("long")
    def shared(left: pd.Series, right: pd.Series) -> pd.Series:
        return pd.Series([_shared_words(a, b) for a, b in zip(left, right)], dtype="int64")

    def words(text: str) -> Column:
        return F.when(F.col(text) == "", 0).otherwise(F.size(F.split(F.col(text), r"\s+")))

    rows = rows.withColumn("_r", normal_text(F.coalesce(F.col(response), F.lit("")))).withColumn(
        "_g", normal_text(F.coalesce(F.col(gold), F.lit("")))
    )
    rows = rows.withColumn("_shared", shared("_r", "_g"))
    precision, recall = F.col("_shared") / words("_r"), F.col("_shared") / words("_g")
    f1 = F.when(F.col("_shared") == 0, 0.0).otherwise(2 * precision * recall / (precision + recall))
    return rows.withColumn("f1", f1).drop("_r", "_g", "_shared")


def score_loglikelihood(items: DataFrame, norm: str = "byte", target: str = "choice_text") -> DataFrame:
    """Add ``sums``, ``predicted``, ``gold_letter`` and ``pass`` from log-probabilities per choice.

    ``scored`` holds one ``struct<logprobs, offsets>`` per choice, echoing context and continuation;
    tokens before ``context_bytes`` and null log-probabilities do not count.  The first best choice wins.
    """

    def total(choice: Column, context: Column) -> Column:
        tokens = F.filter(
            F.arrays_zip(choice["offsets"].alias("o"), choice["logprobs"].alias("p")),
            lambda t: (t["o"] >= context) & t["p"].isNotNull(),
        )
        return F.aggregate(tokens, F.lit(0.0), lambda acc, t: acc + t["p"])

    def length(choice: Column, i: Column) -> Column:
        text = F.lit("A") if target == "letter" else strip(choice)
        return F.octet_length(F.concat(F.lit(" "), text)).cast("double")

    rows = items.withColumn("sums", F.transform("scored", lambda c: total(c, F.col("context_bytes")))).withColumn(
        "_len", F.transform("choices", length)
    )
    value = F.zip_with("sums", "_len", lambda s, n: s / F.greatest(n, F.lit(1.0)) if norm == "byte" else s)
    rows = rows.withColumn("_value", value)
    best = F.array_position("_value", F.array_max("_value"))
    rows = rows.withColumn("predicted", F.char(F.lit(64) + best)).withColumn(
        "gold_letter", choice_letter(F.col("gold"), F.col("choices"))
    )
    return rows.withColumn("pass", F.col("predicted") == F.col("gold_letter")).drop("_len", "_value")


def score_judge(replies: DataFrame, key: str) -> DataFrame:
    """Mean judge score per key; a reply without a score counts as 0 and as a failure."""
    rows = replies.select(key, judge_score(F.col("reply")).alias("score"))
    return rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("replies"),
        F.count_if(F.col("score").isNull()).alias("failures"),
        round4(F.sum(F.coalesce("score", F.lit(0.0)).cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias(
            "score"
        ),
    )


def agent_rewards(rows: DataFrame, key: str, text: str = "reward_text") -> DataFrame:
    """Rewards read from verifier output, a JSON object or a plain number."""
    return rows.select(key, reward(F.col(text)).alias("reward"))


# Data sets with their own scoring method, by name or name prefix.
DATASET_METHODS = {"hellaswag": "loglikelihood", "cruxeval": "candidate_execution"}
CODE_PREFIXES = ["humaneval", "mbpp"]


def default_method(dataset: Column) -> Column:
    """Scoring method of a data set when the task names none."""
    name = F.lower(dataset)
    method = F.when(name.rlike("^(?:" + "|".join(CODE_PREFIXES) + ")"), "code_execution")
    for known, value in DATASET_METHODS.items():
        method = method.when(name == known, value)
    return method.otherwise("exact_match")


def score_items(rows: DataFrame) -> DataFrame:
    """Score every row by what it carries: choices by letter, anything else by its final answer.

    A row without question id or gold answer is unscored and says why.  Adds ``prompt_hash``,
    ``predicted``, ``gold_shown``, ``scored``, ``pass`` and ``error``.
    """
    has_choices = F.coalesce(F.size("choices"), F.lit(0)) > 0
    error = F.when(F.coalesce(F.col("question_id").cast("string"), F.lit("")) == "", "row is missing question_id").when(
        F.col("gold").isNull(), "row is missing gold answer for local scoring"
    )
    rows = rows.withColumn("error", error).withColumn("_gold", strip(F.col("gold")))
    rows = rows.withColumn(
        "prompt", rendered_prompt(default_template(F.col("choices")), F.col("input"), F.col("choices"))
    )
    # Texts of rows that need neither reading are passed on as null, so each text is read one way only.
    usable = F.col("error").isNull()
    rows = rows.withColumn("_free", F.when(usable & ~has_choices, F.col("response")))
    rows = with_final_answer(rows, "_free", "_answer", "_rule")
    rows = rows.withColumn("_plain", F.when(usable & has_choices, normal_text(F.col("response"))))
    answer = F.when(has_choices, letter_of_plain(F.col("_plain"), F.col("choices"))).otherwise(F.col("_answer"))
    rows = rows.withColumn("predicted", F.when(usable, answer)).withColumn(
        "gold_shown",
        F.when(error.isNull(), F.when(has_choices, choice_letter(F.col("_gold"), F.col("choices"))).otherwise(F.col("_gold"))),
    )
    same = F.when(has_choices, (F.col("predicted") != "") & (F.col("predicted") == F.col("gold_shown"))).otherwise(
        answers_match(F.col("predicted"), F.col("gold_shown"))
    )
    return (
        rows.withColumn("scored", F.col("error").isNull())
        .withColumn("pass", F.coalesce(same, F.lit(False)))
        .withColumn("prompt_hash", F.sha2("prompt", 256))
        .drop("_gold", "prompt", "_free", "_answer", "_rule", "_plain")
    )


# Metric names of a harness result per scoring method, best first.
HARNESS_METRICS = {
    "f1": ["f1,none", "f1", "macro_f1,none", "macro_f1", "rouge1,none", "rouge1", "rougeL,none", "rougeL"],
    "pass_at_k": [
        "pass_at_1,none",
        "pass@1,none",
        "pass_at_1",
        "pass@1",
        "pass_at_k,none",
        "pass@k,none",
        "pass_at_k",
        "pass@k",
    ],
    "llm_judge": ["score,none", "score", "acc,none", "acc"],
    "perplexity": ["word_perplexity,none", "perplexity,none", "ppl,none", "word_perplexity", "perplexity", "ppl"],
    "loglikelihood": ["acc_norm,none", "acc,none", "acc_norm", "acc"],
    "": [
        "acc_norm,none",
        "acc,none",
        "exact_match,none",
        "exact,none",
        "em,none",
        "pass_at_1,none",
        "pass@1,none",
        "inst_level_strict_acc,none",
        "prompt_level_strict_acc,none",
        "acc_norm",
        "acc",
        "exact_match",
        "exact",
        "em",
        "pass_at_1",
        "pass@1",
        "inst_level_strict_acc",
        "prompt_level_strict_acc",
    ],
}


def harness_score(results: DataFrame, method: str = "", metrics: str = "metrics") -> DataFrame:
    """Add ``metric`` and ``score`` of a harness result, a JSON object of metric values.

    Preferred names come first, then any other name in name order except error bars.  Scores are
    0 to 1; ROUGE, BLEU and chrF may be percentages.
    """
    names = HARNESS_METRICS.get(method, HARNESS_METRICS[""])
    entries = F.transform(
        F.map_entries(F.from_json(metrics, "map<string,string>")),
        lambda e: F.struct(
            F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(n) for n in names]), e["key"]), F.lit(0)), F.lit(999)).alias(
                "place"
            ),
            e["key"].alias("name"),
            F.lower(e["key"]).alias("plain"),
            e["value"].alias("text"),
        ),
    )
    # Only JSON numbers count: a quoted value keeps its quotes in the raw text.
    quoted = F.regexp_extract_all(F.col(metrics), F.lit(r'"([^"]*)"\s*:\s*"'), F.lit(1))

    def value(e: Column) -> Column:
        number = e["text"].try_cast("double")
        percent = e["plain"].rlike("^rouge|bleu|chrf") & number.between(0, 100)
        return F.when(number.between(0, 1), number).when(percent, number / 100)

    usable = F.filter(
        F.transform(
            F.filter(
                F.col("_entries"),
                lambda e: ~F.array_contains(F.col("_quoted"), e["name"])
                & ((e["place"] < 999) | ~F.contains(e["plain"], F.lit("stderr"))),
            ),
            lambda e: F.struct(e["place"].alias("place"), e["name"].alias("name"), value(e).alias("value")),
        ),
        lambda e: e["value"].isNotNull(),
    )
    rows = results.withColumn("_entries", entries).withColumn("_quoted", quoted)
    rows = rows.withColumn("_best", F.array_min(usable))
    return rows.withColumn("metric", F.col("_best.name")).withColumn("score", F.col("_best.value")).drop(
        "_entries", "_quoted", "_best"
    )


def harness_entry(document: Column, task: Column) -> Column:
    """Result object of a task in a harness document: ``results`` before ``groups``, ``_`` for ``-``."""
    results = F.coalesce(F.get_json_object(document, "$.results"), document)
    groups = F.get_json_object(document, "$.groups")
    under = F.replace(task, F.lit("-"), F.lit("_"))
    found = []
    for part in (results, groups):
        table = F.from_json(part, "map<string,string>")
        found += [F.try_element_at(table, name) for name in (task, under)]
    return F.coalesce(*found)


# ---------------------------------------------------------------- samples, tasks, suites


def join_grades(generations: DataFrame, grades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every generation with its verdict; a failed generation or a missing verdict is not passed."""
    verdicts = grades.select(*[F.col(k).alias(f"_g_{k}") for k in keys], F.col("passed").alias("_passed"))
    rows = generations.join(verdicts, [F.col(k) == F.col(f"_g_{k}") for k in keys], "left")
    return rows.withColumn(
        "passed", F.coalesce("_passed", F.lit(False)) & F.col("error").isNull()
    ).drop("_passed", *[f"_g_{k}" for k in keys])


def pass_at_k_value(n: Column, c: Column, k: int) -> Column:
    """Chance that k of n samples, c of them passing, hold a passing one.

    The chance to miss is the product of (n-c-j)/(n-j) for j below k: k factors, however many
    samples an item has.
    """
    miss = F.aggregate(
        F.sequence(F.lit(0), F.least(F.lit(k), n).cast("int") - 1),
        F.lit(1.0),
        lambda acc, j: acc * ((n - c - j) / (n - j)),
    )
    return F.when((n - c) < F.least(F.lit(k), n), F.lit(1.0)).otherwise(1 - miss)


def pass_at_k_items(samples: DataFrame, k: int, item: str = "item") -> DataFrame:
    counts = samples.groupBy(item).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("c")
    )
    return counts.select(
        item,
        "n",
        "c",
        pass_at_k_value(F.col("n"), F.col("c"), k).alias("pass_at_k"),
        (F.col("c") / F.col("n")).alias("pass_at_1"),
    )


def pass_at_k(samples: DataFrame, k: int, item: str = "item") -> DataFrame:
    """Mean pass@k and pass@1 over items."""
    return pass_at_k_items(samples, k, item).agg(
        F.count(F.lit(1)).alias("items"),
        F.lit(k).alias("k"),
        round4(F.avg("pass_at_k")).alias("pass_at_k"),
        round4(F.avg("pass_at_1")).alias("pass_at_1"),
    )


def generation_guard(generations: DataFrame, item: str = "item") -> DataFrame:
    """Whether more than half of the first samples failed, which stops grading."""
    first = generations.where(F.col("sample") == 0)
    return first.agg(
        F.count(F.lit(1)).alias("items"), F.count_if(F.col("error").isNotNull()).alias("failures")
    ).withColumn("abort", (F.col("items") > 0) & (F.col("failures") > F.floor(F.col("items") / 2)))


def shard_stats(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """Correct, scored and unscored counts, accuracy, and mean latency over all rows in whole milliseconds."""
    return (
        results.groupBy(*by)
        .agg(
            F.count_if(F.col("scored") & F.col("pass")).alias("correct"),
            F.count_if("scored").alias("scored"),
            F.count_if(~F.col("scored")).alias("errors"),
            F.sum("latency_ms").cast("bigint").alias("total_latency_ms"),
            F.count(F.lit(1)).alias("_n"),
        )
        .withColumn(
            "accuracy",
            F.when(F.col("scored") > 0, round4(F.col("correct") / F.col("scored"))).otherwise(F.lit(0.0)),
        )
        .withColumn("avg_latency_ms", F.expr("total_latency_ms div _n"))
        .drop("_n")
    )


def task_score(results: DataFrame, task: str = "task") -> DataFrame:
    """Mean score per task; a failed row counts as 0."""
    return results.groupBy(task).agg(
        F.count(F.lit(1)).alias("samples"),
        F.count_if(F.col("score").isNull()).alias("failures"),
        round4(F.sum(F.coalesce("score", F.lit(0.0)).cast("decimal(18,6)")).cast("double") / F.count(F.lit(1))).alias(
            "score"
        ),
    )


def suite_aggregate(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """One score per suite from its task scores: ``min``, ``max``, ``mean``, else weighted.

    Tasks without a score are left out, a weight of 0 or less is 1, and no task at all gives 0.
    """
    weight = F.when(F.coalesce("weight", F.lit(0.0)) > 0, F.col("weight")).otherwise(1.0)
    rows = tasks.select(*by, "aggregation", "score", F.when(F.col("score").isNotNull(), weight).alias("w"))
    result = rows.groupBy(*by).agg(
        F.min("aggregation").alias("aggregation"),
        F.count("score").alias("tasks"),
        F.min("score").alias("_min"),
        F.max("score").alias("_max"),
        F.avg("score").alias("_mean"),
        (F.sum(F.col("score") * F.col("w")) / F.sum("w")).alias("_weighted"),
    )
    chosen = (
        F.when(F.col("aggregation") == "min", F.col("_min"))
        .when(F.col("aggregation") == "max", F.col("_max"))
        .when(F.col("aggregation") == "mean", F.col("_mean"))
        .otherwise(F.col("_weighted"))
    )
    return result.select(*by, "aggregation", "tasks", round4(F.coalesce(chosen, F.lit(0.0))).alias("score"))


# Own choice: the reference site's interval formula is not public, so this is the Wilson interval.
Z95 = 1.959963984540054


def pooled_score(results: DataFrame, by: Sequence[str], question: str, newest: str) -> DataFrame:
    """Accuracy over distinct questions (newest submission counts) with a 95 % Wilson interval."""
    latest = results.groupBy(*by, question).agg(
        F.max_by(F.struct("pass", "scored", "shard"), newest).alias("r")
    )
    n = F.count_if("r.scored").cast("double")
    p = F.count_if(F.col("r.scored") & F.col("r.pass")) / F.nullif(n, F.lit(0.0))
    pooled = latest.groupBy(*by).agg(
        F.count(F.lit(1)).alias("questions"),
        n.alias("n"),
        p.alias("p"),
        F.count_distinct("r.shard").alias("shards_covered"),
    )
    z2 = Z95 * Z95
    n, p = F.col("n"), F.col("p")
    center = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = Z95 * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n)) / (1 + z2 / n)
    return pooled.select(
        *by,
        "questions",
        "shards_covered",
        round4(p).alias("pooled_score"),
        round4(center - half).alias("ci_lower"),
        round4(center + half).alias("ci_upper"),
    )


def sample_size(datasets: DataFrame, by: Sequence[str], margin: float = 0.05) -> DataFrame:
    """Items to run per data set for a margin at 95 %: Cochran's size with the finite correction (own choice)."""
    n0 = Z95 * Z95 * 0.25 / (margin * margin)
    items = F.count(F.lit(1))
    return datasets.groupBy(*by).agg(
        items.alias("items"), F.least(items, F.ceil(F.lit(n0) / (1 + (n0 - 1) / items))).alias("recommended")
    )


# ---------------------------------------------------------------- code prompts


def few_shot_prefix(examples: DataFrame, n: int) -> DataFrame:
    """The first ``n`` examples rendered as one prompt prefix (one row; ``n`` is a prompt setting)."""
    first = examples.orderBy("place").limit(n)
    shown = F.concat(
        F.col("text"),
        F.lit("\nYour code should pass these tests:\n"),
        F.array_join("tests", "\n"),
        F.lit("\n```python\n"),
        F.regexp_replace("code", r"\n+$", ""),
        F.lit("\n```\n\n"),
    )
    parts = first.agg(F.array_sort(F.collect_list(F.struct("place", shown.alias("t")))).alias("p"))
    return parts.select(
        F.concat(
            F.lit("Here are examples of Python tasks and correct solutions.\n\n"),
            F.array_join(F.transform("p", lambda e: e["t"]), ""),
        ).alias("prefix")
    )


# Instructions around a code task.
FEW_SHOT_TAIL = (
    "Now complete this task. Reply with only the implementation in a single ```python code block and no prose.\n\n"
)
ZERO_SHOT_HEAD = (
    "Complete the following Python function. Reply with the complete implementation in a single ```python code "
    "block and no prose.\n\n"
)


def code_prompt(items: DataFrame, prefix: DataFrame | None = None) -> DataFrame:
    """Add the prompt of a code task: after the few-shot prefix where ``few_shot`` holds, else plain."""
    plain = F.concat(F.lit(ZERO_SHOT_HEAD), F.col("input"))
    if prefix is None:
        return items.withColumn("prompt", plain)
    rows = items.join(F.broadcast(prefix), F.lit(True))  # the prefix is one row
    shots = F.concat(F.col("prefix"), F.lit(FEW_SHOT_TAIL), F.col("input"))
    return rows.withColumn("prompt", F.when(F.col("few_shot"), shots).otherwise(plain)).drop("prefix")


def agent_task_results(tasks: DataFrame, by: Sequence[str]) -> DataFrame:
    """Accuracy over scored tasks, mean wall time over all, turns and token usage."""
    return (
        tasks.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("tasks"),
            F.count_if("scored").alias("scored"),
            F.count_if(F.col("scored") & F.col("pass")).alias("passed"),
            F.sum("turns").alias("turns"),
            F.sum("wall_time_ms").cast("bigint").alias("_wall"),
            F.sum("input_tokens").cast("bigint").alias("input_tokens"),
            F.sum("output_tokens").cast("bigint").alias("output_tokens"),
        )
        .withColumn("accuracy", F.when(F.col("scored") > 0, round4(F.col("passed") / F.col("scored"))).otherwise(0.0))
        .withColumn("avg_wall_ms", F.expr("_wall div tasks"))
        .drop("_wall")
    )


def first_id(rows: DataFrame, columns: Sequence[str]) -> Column:
    """First non-empty id among alias columns."""
    return first_non_empty([F.col(c).cast("string") for c in columns if c in rows.columns])
