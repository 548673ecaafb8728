"""Values out of texts: answers, choices, code, log metrics, names, commands, devices and costs.

Everything is computed inside the row that holds the text, so texts never move;
only small per-key counts are shuffled.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions import naming
from benchloom.functions.answers import (
    choice_reading,
    last_number,
    letter_of_reading,
    regex_answer,
    thinking_observed,
    thinking_requested,
    with_final_answer,
)
from benchloom.functions.documents import flat_entries
from benchloom.functions.numbers import first_positive, positive_number, round1, round4
from benchloom.functions.text import first_found, first_match, last_match, lines, normal_text, strip

# ---------------------------------------------------------------- answers


def extract_answers(responses: DataFrame, pattern: str | None = None) -> DataFrame:
    """Every response with the rule that found its final answer, and its other readings."""
    rows = with_final_answer(responses, "response", "final_answer")
    return rows.select(
        *[c for c in responses.columns if c != "response"],
        "rule",
        "final_answer",
        last_number(F.col("response")).alias("last_number"),
        regex_answer(F.col("response"), pattern).alias("regex_answer"),
    )


def answer_extraction(responses: DataFrame) -> DataFrame:
    """How often each rule found the answer per model and task, and the share that fell back to raw text."""
    rows = extract_answers(responses)
    return (
        rows.groupBy("model", "task")
        .agg(
            F.count(F.lit(1)).alias("responses"),
            *[F.count_if(F.col("rule") == x).alias(x) for x in ("marker", "summary", "equation", "bold", "last_number")],
            F.count_if(F.col("rule") == "raw").alias("fallbacks"),
        )
        .withColumn("fallback_rate", round4(F.col("fallbacks") / F.col("responses")))
    )


def resolve_choices(responses: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Letters of the predicted and the gold choice of each response; a text that names no choice is
    shown by its hash.

    Responses are read where they lie and only the reading is joined, so no text is shuffled.
    """
    plain = responses.withColumn("_plain", normal_text(F.col("response")))
    read = plain.select(
        *[c for c in responses.columns if c != "response"], choice_reading(F.col("_plain")).alias("_read")
    )
    known = items.withColumn("_plain", normal_text(F.col("gold"))).select(
        key,
        F.transform("choices", lambda c: F.sha2(normal_text(c), 256)).alias("_choices"),
        choice_reading(F.col("_plain")).alias("_gold"),
    )
    rows = read.join(known, key)
    return rows.withColumn("predicted", letter_of_reading(F.col("_read"), F.col("_choices"))).withColumn(
        "gold_letter", letter_of_reading(F.col("_gold"), F.col("_choices"))
    ).drop("_read", "_choices", "_gold")


def choice_resolution(responses: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Counts of gold against predicted letter per task; anything but a letter counts as ``-``."""

    def shown(c: str) -> Column:
        return F.when(F.col(c).rlike("^[A-Z]$"), F.col(c)).otherwise("-").alias(c)

    rows = resolve_choices(responses, items, key).select("task", shown("gold_letter"), shown("predicted"))
    return rows.groupBy("task", "gold_letter", "predicted").agg(F.count(F.lit(1)).alias("n"))


# Code fences and where a one-line candidate starts.
CODE_FENCE = r"(?s)```(?:python|py)?[ \t]*\r?\n(.*?)```"
ANY_FENCE = r"(?s)```(?:python|py)?\s*(.*?)```"
DEFINED_NAME = r"(?m)^[ \t]*def[ \t]+([A-Za-z_]\w*)[ \t]*\("
CANDIDATE_MARK = r"(?is)(?:CRUX_ANSWER|final\s+answer|answer)\s*[:=]\s*"


def generated_code(response: Column, prompt: Column, entry: Column) -> Column:
    """Code of the first fence, else the response; the prompt goes in front when the entry is not defined."""
    fenced = F.when(response.rlike(CODE_FENCE), F.regexp_extract(response, CODE_FENCE, 1)).otherwise(response)
    code = F.regexp_replace(fenced, r"[ \t\r\n]+$", "")
    defined = F.array_contains(F.regexp_extract_all(code, F.lit(DEFINED_NAME), F.lit(1)), entry)
    stub = F.concat(F.regexp_replace(prompt, r"\n+$", ""), F.lit("\n"), code)
    return F.when((entry != "") & ~defined, stub).otherwise(code)


def runnable_program(solution: Column, prompt: Column, test: Column, entry: Column) -> Column:
    """Imports of the prompt that the solution lacks, the solution, the tests, and the check call."""
    wanted = F.filter(
        F.transform(lines(prompt), strip),
        lambda line: (F.startswith(line, F.lit("import ")) | F.startswith(line, F.lit("from ")))
        & ~F.contains(solution, line),
    )
    imports = F.when((entry != "") & (F.size(wanted) > 0), F.concat(F.array_join(wanted, "\n"), F.lit("\n")))
    call = F.when(
        (entry != "") & F.contains(test, F.lit("def check(")), F.concat(F.lit("\n\ncheck("), entry, F.lit(")\n"))
    )
    return F.concat(F.coalesce(imports, F.lit("")), solution, F.lit("\n\n"), test, F.coalesce(call, F.lit("")))


def code_extraction(generations: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Generations joined to their items as runnable programs; ``fenced`` tells whether a code block was found."""
    wanted = items.select(key, "prompt", "test", "entry_point")
    rows = generations.join(wanted, key).withColumn(
        "code", generated_code(F.col("response"), F.col("prompt"), F.coalesce("entry_point", F.lit("")))
    )
    return rows.select(
        *[c for c in generations.columns if c != "response"],
        F.col("response").rlike(CODE_FENCE).alias("fenced"),
        "code",
        runnable_program(
            F.col("code"), F.col("prompt"), F.col("test"), F.coalesce("entry_point", F.lit(""))
        ).alias("program"),
    )


def _clean_candidate(line: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(strip(line), "^- ", ""), r"^\* ", "")
    bare = strip(F.regexp_replace(strip(bare), "^`+|`+$", ""))
    labelled = F.startswith(F.lower(bare), F.lit("final answer")) & F.contains(bare, F.lit(":"))
    return F.when(labelled, strip(F.regexp_replace(bare, "^[^:]*:", ""))).otherwise(bare)


def one_line_candidate(response: Column) -> Column:
    """First non-empty line after the last answer mark, of the last fence there if it has one."""
    parts = F.split(strip(response), CANDIDATE_MARK)
    text = strip(F.element_at(parts, -1))
    fenced = F.nullif(strip(F.coalesce(last_match(text, ANY_FENCE, 1), F.lit(""))), F.lit(""))
    body = F.coalesce(fenced, text)
    found = F.filter(F.transform(lines(body), _clean_candidate), lambda line: line != "")
    return F.coalesce(F.try_element_at(found, F.lit(1)), _clean_candidate(body), F.lit(""))


def candidate_extraction(responses: DataFrame) -> DataFrame:
    """Responses per task whose one-line candidate is empty, and the total length of the candidates."""
    rows = responses.select("task", one_line_candidate(F.col("response")).alias("candidate"))
    return rows.groupBy("task").agg(
        F.count(F.lit(1)).alias("responses"),
        F.count_if(F.col("candidate") == "").alias("empty"),
        F.sum(F.char_length("candidate")).alias("characters"),
    )


def thinking_mode_rates(rows: DataFrame) -> DataFrame:
    """Counts of requested against observed thinking mode (columns ``prompt`` and ``reasoning``)."""
    asked = thinking_requested(F.col("prompt"))
    modes = rows.select(asked.alias("requested"), thinking_observed(asked, F.col("reasoning")).alias("observed"))
    return modes.groupBy("requested", "observed").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- measurement logs

# Log phrases of each metric, tried in this order.
LOG_PATTERNS = {
    "tok_s_out": [
        r"(?i)output\s+token\s+throughput[^\d]*(\d+(?:\.\d+)?)",
        r"(?i)output\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)decode\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)generation\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)generated\s+tokens\s+per\s+second[^\d]*(\d+(?:\.\d+)?)",
        r"(?i)(\d+(?:\.\d+)?)\s+output\s+tokens/s",
    ],
    "tok_s_prefill": [
        r"(?i)prefill\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)prompt\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)input\s+token\s+throughput[^\d]*(\d+(?:\.\d+)?)",
    ],
    "tok_s_total": [
        r"(?i)total\s+token\s+throughput[^\d]*(\d+(?:\.\d+)?)",
        r"(?i)total\s+throughput[^\d]*(\d+(?:\.\d+)?)[^\n]*(?:tok|token)/s",
        r"(?i)(\d+(?:\.\d+)?)\s+total\s+tokens/s",
    ],
    "ttft_ms": [
        r"(?i)(?:mean|median)?\s*ttft[^\d]*(\d+(?:\.\d+)?)[^\n]*ms",
        r"(?i)time\s+to\s+first\s+token[^\d]*(\d+(?:\.\d+)?)[^\n]*ms",
    ],
    "peak_vram_gb": [r"(?i)peak\s+(?:gpu\s+)?(?:vram|memory)[^\d]*(\d+(?:\.\d+)?)[^\n]*gb"],
    "prompt_tokens": [
        r"(?i)total\s+(?:input|prompt)\s+tokens[^\d]*(\d+)",
        r"(?i)total\s+num\s+prompt\s+tokens[^\d]*(\d+)",
    ],
    "output_tokens": [
        r"(?i)total\s+(?:generated|output)\s+tokens[^\d]*(\d+)",
        r"(?i)total\s+num\s+output\s+tokens[^\d]*(\d+)",
    ],
}
LOG_METRICS = [*LOG_PATTERNS, "prefill_tokens", "context_tokens", "latency_ms"]

# Cells of a markdown benchmark table.
TABLE_TEST = r"(?i)^(pp|tg)\s*(\d+)(?![A-Za-z0-9_])"
TABLE_DEPTH = r"(?i)@\s*d\s*(\d+)"
TABLE_VALUE = r"^(\d+(?:\.\d+)?)(?:\s*[+-]|\s*±|\s*$)"


def phrase_metrics(text: Column) -> dict[str, Column]:
    """Metrics named by log phrases: the first phrase that occurs decides."""
    return {
        metric: first_positive(F.array(first_found(text, [(p, 1) for p in patterns])))
        for metric, patterns in LOG_PATTERNS.items()
    }


def _first(entries: Column, keep, value) -> Column:
    return F.try_element_at(F.transform(F.filter(entries, keep), value), F.lit(1))


def table_entries(text: Column) -> Column:
    """Test cells of all table lines as (kind, tokens, depth, value), in reading order."""

    def of_line(line: Column) -> Column:
        cells = F.filter(F.transform(F.split(line, r"\|"), strip), lambda c: c != "")
        tests = F.transform(
            cells,
            lambda cell, i: F.struct(
                F.lower(F.regexp_extract(cell, TABLE_TEST, 1)).alias("kind"),
                F.regexp_extract(cell, TABLE_TEST, 2).try_cast("double").alias("tokens"),
                F.regexp_extract(cell, TABLE_DEPTH, 1).try_cast("double").alias("depth"),
                F.try_element_at(
                    F.filter(
                        F.transform(
                            F.slice(cells, i + 2, F.size(cells)), lambda c: F.regexp_extract(c, TABLE_VALUE, 1)
                        ),
                        lambda v: v != "",
                    ),
                    F.lit(1),
                )
                .try_cast("double")
                .alias("value"),
            ),
        )
        return F.filter(tests, lambda e: e["kind"] != "")

    return F.flatten(F.transform(F.split(text, r"[\n\r]+"), of_line))


def table_metrics(entries: Column) -> dict[str, Column]:
    """Metrics of the entries ``table_entries`` found."""

    def of(kind: str, field: str) -> Column:
        return _first(
            entries, lambda e: (e["kind"] == kind) & e["value"].isNotNull() & (e[field] > 0), lambda e: e[field]
        )

    return {
        "tok_s_prefill": of("pp", "value"),
        "tok_s_out": of("tg", "value"),
        "prompt_tokens": of("pp", "tokens"),
        "output_tokens": of("tg", "tokens"),
        "prefill_tokens": _first(entries, lambda e: e["depth"] > 0, lambda e: e["depth"]),
    }


# Field names of benchmark result rows.
ROW_FIELDS = {
    "input": ["input_len", "inputLen", "prompt_len", "promptLen", "num_input_tokens", "numPromptTokens"],
    "output": ["output_len", "outputLen", "generation_len", "generationLen", "num_output_tokens", "numOutputTokens"],
    "batch": ["batch_size", "batchSize"],
    "out_rate": [
        "output_token_throughput",
        "outputTokenThroughput",
        "output_throughput",
        "generation_throughput",
        "tokens_per_second",
    ],
    "total_rate": ["total_token_throughput", "totalTokenThroughput", "total_throughput"],
    "latency_ms": ["avg_latency_ms", "mean_latency_ms", "median_latency_ms", "latency_ms"],
    "latency_s": [
        "avg_latency",
        "mean_latency",
        "median_latency",
        "latency",
        "avg_latency_s",
        "mean_latency_s",
        "median_latency_s",
    ],
}
_ROW_SCHEMA = "array<struct<" + ",".join(
    f"`{f}`:string" for f in ["n_prompt", "n_gen", "n_depth", "avg_ts", *sum(ROW_FIELDS.values(), [])]
) + ">>"


def result_rows(text: Column) -> Column:
    """Benchmark result rows in a text: the whole text, else its outermost array or object."""
    trimmed = strip(text)
    inner = F.coalesce(first_match(trimmed, r"(?s)(\[.*\])", 1), first_match(trimmed, r"(?s)(\{.*\})", 1))
    return F.from_json(F.when(trimmed.rlike(r"(?s)^[\[{].*[\]}]$"), trimmed).otherwise(inner), _ROW_SCHEMA)


def row_rates(rows: Column) -> Column:
    """Rate, prompt, generated and depth tokens of each result row."""

    def of(row: Column, field: str) -> Column:
        return F.coalesce(first_positive(F.array(row[field])), F.lit(0.0))

    return F.transform(
        rows,
        lambda row: F.struct(
            of(row, "avg_ts").alias("rate"),
            of(row, "n_prompt").alias("p"),
            of(row, "n_gen").alias("g"),
            of(row, "n_depth").alias("d"),
        ),
    )


def row_fields(rows: Column) -> Column:
    """Sizes, rates and latency each result row states, under one name per field."""
    return F.transform(
        rows,
        lambda row: F.struct(
            *[first_positive(F.array(*[row[n] for n in names])).alias(f) for f, names in ROW_FIELDS.items()]
        ),
    )


def timed_rows(fields: Column) -> Column:
    """Rates of each row, derived from its latency where it states none."""

    def latency(row: Column) -> Column:
        return F.coalesce(row["latency_ms"], round1(row["latency_s"] * 1000))

    def tokens(row: Column, field: str) -> Column:
        return F.coalesce(row[field], F.lit(0.0))

    def rate(count: Column, row: Column) -> Column:
        return F.when(count > 0, round1(count * F.coalesce(row["batch"], F.lit(1.0)) / (latency(row) / 1000)))

    return F.transform(
        fields,
        lambda row: F.struct(
            tokens(row, "input").alias("i"),
            tokens(row, "output").alias("o"),
            latency(row).alias("latency"),
            F.coalesce(row["total_rate"], rate(tokens(row, "input") + tokens(row, "output"), row)).alias("total"),
            F.coalesce(row["out_rate"], rate(tokens(row, "output"), row)).alias("out"),
        ),
    )


def json_metrics(simple: Column, timed: Column) -> dict[str, Column]:
    """Metrics of result rows, given their rates and their timed form."""
    prompt_only = lambda e: (e["rate"] > 0) & (e["p"] > 0) & (e["g"] == 0)
    output_only = lambda e: (e["rate"] > 0) & (e["g"] > 0) & (e["p"] == 0)

    def first_positive(field: str) -> Column:
        return _first(timed, lambda e: e[field] > 0, lambda e: e[field])

    return {
        "tok_s_prefill": _first(simple, prompt_only, lambda e: e["rate"]),
        "tok_s_out": F.coalesce(_first(simple, output_only, lambda e: e["rate"]), first_positive("out")),
        "tok_s_total": first_positive("total"),
        "prompt_tokens": F.coalesce(_first(simple, prompt_only, lambda e: e["p"]), first_positive("i")),
        "output_tokens": F.coalesce(_first(simple, output_only, lambda e: e["g"]), first_positive("o")),
        "prefill_tokens": _first(simple, lambda e: (e["rate"] > 0) & (e["d"] > 0), lambda e: e["d"]),
        "context_tokens": first_positive("i"),
        "latency_ms": first_positive("latency"),
    }


def _with_entries(texts: DataFrame, text: str) -> DataFrame:
    """Parsed forms of a text as columns, so that each is computed once per row."""
    return (
        texts.withColumn("_table", F.when(F.contains(text, F.lit("|")), table_entries(F.col(text))))
        .withColumn("_rows", F.when(F.col(text).rlike(r"[\[{]"), result_rows(F.col(text))))
        .withColumn("_rates", row_rates(F.col("_rows")))
        .withColumn("_fields", row_fields(F.col("_rows")))
        .withColumn("_timed", timed_rows(F.col("_fields")))
    )


def bench_table_metrics(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    metrics = table_metrics(F.col("_table"))
    return _with_entries(texts, text).select(key, *[v.alias(k) for k, v in metrics.items()])


def bench_json_metrics(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    metrics = json_metrics(F.col("_rates"), F.col("_timed"))
    return _with_entries(texts, text).select(key, *[v.alias(k) for k, v in metrics.items()])


def log_metrics(layers: DataFrame, key: str = "run_id", layer: str = "layer", text: str = "text") -> DataFrame:
    """One metric row per run: earlier layers win, and in a layer tables win over rows over phrases."""
    table, rows = table_metrics(F.col("_table")), json_metrics(F.col("_rates"), F.col("_timed"))
    phrases = phrase_metrics(F.col(text))
    per_layer = _with_entries(layers, text).select(
        key,
        layer,
        *[
            F.coalesce(*[source[m] for source in (table, rows, phrases) if m in source]).alias(m)
            for m in LOG_METRICS
        ],
    )
    return per_layer.groupBy(key).agg(
        *[F.min_by(m, F.when(F.col(m).isNotNull(), F.col(layer))).alias(m) for m in LOG_METRICS]
    )


# Field names of each metric in result documents.
METRIC_ALIASES = {
    "tok_s_out": [
        "tokSOut",
        "outputTokensPerSecond",
        "outputTokenThroughput",
        "outputThroughput",
        "generationTokensPerSecond",
        "decodeThroughput",
        "genThroughput",
    ],
    "tok_s_prefill": [
        "tokSPrefill",
        "prefillTokensPerSecond",
        "promptTokensPerSecond",
        "inputTokensPerSecond",
        "prefillThroughput",
        "promptThroughput",
    ],
    "tok_s_total": [
        "tokSTotal",
        "totalTokensPerSecond",
        "totalTokenThroughput",
        "totalThroughput",
        "tokensPerSecond",
        "requestThroughput",
    ],
    "ttft_ms": [
        "ttftMs",
        "timeToFirstTokenMs",
        "meanTtftMs",
        "medianTtftMs",
        "meanTtft",
        "medianTtft",
    ],
    "peak_vram_gb": ["peakVramGb", "peakGpuMemoryGb", "maxVramGb"],
    "prompt_tokens": ["promptTokens", "inputTokens", "totalInputTokens", "totalPromptTokens", "numPromptTokens"],
    "output_tokens": [
        "outputTokens",
        "completionTokens",
        "generatedTokens",
        "totalOutputTokens",
        "totalGeneratedTokens",
        "numOutputTokens",
    ],
}


def metric_by_alias(
    documents: DataFrame, key: str, document: str, aliases: Mapping[str, Sequence[str]] = METRIC_ALIASES
) -> DataFrame:
    """First positive number whose field name is an alias: shallowest, then in field order."""
    rows = documents.select(key, flat_entries(F.col(document)).alias("_e"))

    def found(names: Sequence[str]) -> Column:
        wanted = sorted({n.replace("_", "").replace("-", "").replace(" ", "").lower() for n in names})
        hits = F.filter(
            F.col("_e"),
            lambda e: F.translate(F.lower(e["key"]), "_- ", "").isin(*wanted)
            & (e["kind"].isin("number", "string"))
            & (F.coalesce(positive_number(e["value"]), F.lit(0.0)) > 0),
        )
        best = F.array_min(F.transform(hits, lambda e: F.struct(e["depth"], e["place"], e["value"])))
        return positive_number(best["value"])

    return rows.select(key, *[found(names).alias(metric) for metric, names in aliases.items()])


# The counters of the two engines' metric pages.
SPEC_SERIES = {
    "draft_tokens": "vllm:spec_decode_num_draft_tokens_total",
    "accepted_tokens": "vllm:spec_decode_num_accepted_tokens_total",
    "draft_acceptance_rate": "vllm:spec_decode_draft_acceptance_rate",
    "accept_length": "sglang:spec_accept_length",
    "accept_rate": "sglang:spec_accept_rate",
}
METRIC_LINE = r"^([^{ \t]+)(?:\{.*\}|[ \t])\s*(\S+)"


def prometheus_rollup(lines_: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Known series of each scrape, summed over their labels; null when a scrape lacks the series."""
    text = strip(F.col(line))
    rows = lines_.where((text != "") & ~F.startswith(text, F.lit("#"))).select(
        key,
        F.regexp_extract(text, METRIC_LINE, 1).alias("name"),
        F.regexp_extract(text, METRIC_LINE, 2).try_cast("double").alias("value"),
    )
    rows = rows.where(F.col("name").isin(*SPEC_SERIES.values()))
    return rows.groupBy(key).agg(
        *[F.sum(F.when(F.col("name") == series, F.col("value"))).alias(n) for n, series in SPEC_SERIES.items()]
    )


# ---------------------------------------------------------------- names, commands, devices, costs


def name_files(files: DataFrame) -> DataFrame:
    """Files with the model name and quantization in their names."""
    return files.withColumn("model", naming.model_name_from_file(F.col("file"))).withColumn(
        "quantization", F.coalesce(naming.quantization_from_file(F.col("file")), F.lit(""))
    )


def artifact_naming(files: DataFrame) -> DataFrame:
    """Files and bytes per model and quantization, and whether the model name could be a repository."""
    return (
        name_files(files)
        .groupBy("model", "quantization")
        .agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
        .withColumn("repository_name", naming.is_repository_name(F.col("model")))
    )


def name_canonicalization(rows: DataFrame, column: str) -> DataFrame:
    """Raw names with their canonical form, whether it is known, and how often each occurs."""
    counted = rows.groupBy(F.col(column).alias("raw")).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        "raw",
        naming.canonical_engine(F.col("raw")).alias("canonical"),
        naming.known_engine(F.col("raw")).alias("known"),
        "n",
    )


def flag_pairs(argv: Column) -> Column:
    """``--name value`` and ``--name=value`` pairs of an argument list."""

    def entry(arg: Column, i: Column) -> Column:
        bare = F.regexp_replace(arg, "^--", "")
        name = F.replace(F.regexp_extract(bare, "^([^=]*)", 1), F.lit("_"), F.lit("-"))
        following = F.try_element_at(argv, i + 2)
        value = F.when(F.contains(bare, F.lit("=")), F.regexp_replace(bare, "^[^=]*=", "")).when(
            following.isNotNull() & ~F.startswith(following, F.lit("-")), following
        )
        return F.struct(name.alias("flag"), F.coalesce(value, F.lit("")).alias("value"), arg.alias("arg"))

    return F.filter(
        F.transform(argv, entry), lambda e: F.startswith(e["arg"], F.lit("--")) & (e["flag"] != "")
    )


def command_flags(runs: DataFrame, key: str, command: str = "command") -> DataFrame:
    """One row per run and flag of its command; the first of a name counts."""
    rows = (
        runs.select(key, F.filter(F.split(command, r"\s+"), lambda a: a != "").alias("argv"))
        .select(key, flag_pairs(F.col("argv")).alias("p"))
        .select(key, "p", F.col("p.flag").alias("names"))
    )
    first = F.filter("p", lambda e, i: F.array_position("names", e["flag"]) == i + 1)
    return rows.select(key, F.explode(first).alias("e")).select(key, "e.flag", "e.value")


# The flags behind each typed field, first match wins.
NUMBER_FLAGS = {
    "concurrency": ["--max-concurrency", "--concurrency"],
    "num_parallel": ["--parallel", "--num-parallel", "-np"],
    "max_running_seqs": ["--max-running-requests", "--max-num-seqs"],
    "spec_num_tokens": [
        "--spec-draft-n-max",
        "--num-speculative-tokens",
        "--speculative-num-draft-tokens",
        "--speculative-dflash-block-size",
    ],
    "spec_draft_window": ["--speculative-dflash-draft-window-size"],
}
TEXT_FLAGS = {
    "spec_method": ["--spec-type", "--speculative-algorithm"],
    "spec_draft_model": ["--model-draft", "-md", "--spec-draft-model", "--speculative-draft-model-path"],
}


def _number_flag(command: Column, flags: Sequence[str]) -> Column:
    patterns = []
    for flag in flags:
        patterns.append(rf"(?:^|\s){flag}(?:=|\s+)([0-9]+(?:\.[0-9]+)?)(?:\s|$)")
        if len(flag) == 2:
            patterns.append(rf"(?:^|\s){flag}([0-9]+(?:\.[0-9]+)?)(?:\s|$)")
    return first_positive(F.array(*[F.regexp_extract(command, p, 1) for p in patterns]))


def _text_flag(command: Column, flags: Sequence[str]) -> Column:
    values = r"""(?:=|\s+)(?:"([^"]*)"|'([^']*)'|(\S+))"""
    return first_found(command, [(rf"(?:^|\s){flag}{values}", group) for flag in flags for group in (1, 2, 3)])


def _whole(value: Column) -> Column:
    return F.when((value >= 1) & (value == F.floor(value)), value.cast("bigint"))


def command_flag_table(runs: DataFrame, key: str, command: str = "command", options: Sequence[str] = ()) -> DataFrame:
    """Typed fields of each command; a column of ``options`` named like a field beats the command."""
    text = F.coalesce(F.col(command), F.lit(""))
    fields = {n: _number_flag(text, f) for n, f in NUMBER_FLAGS.items()}
    fields |= {n: _text_flag(text, f) for n, f in TEXT_FLAGS.items()}
    found = runs.select(key, *[F.col(o).alias(f"_opt_{o}") for o in options], *[c.alias(n) for n, c in fields.items()])

    def field(n: str) -> Column:
        value = _whole(F.col(n)) if n in NUMBER_FLAGS else F.col(n)
        return (F.coalesce(F.col(f"_opt_{n}"), value) if n in options else value).alias(n)

    rows = found.select(key, *[field(n) for n in fields])
    method = naming.canonical_spec_method(F.col("spec_method"), F.col("spec_draft_model"))
    any_spec = F.coalesce(
        *[F.col(n).cast("string") for n in ("spec_method", "spec_draft_model", "spec_num_tokens", "spec_draft_window")]
    ).isNotNull()
    return rows.select(
        key,
        F.coalesce("concurrency", "num_parallel").alias("concurrency"),
        "num_parallel",
        "max_running_seqs",
        "spec_num_tokens",
        "spec_draft_window",
        method.alias("spec_method"),
        "spec_draft_model",
        any_spec.alias("spec_decoding"),
        F.coalesce(method == "MTP", F.lit(False)).alias("mtp_enabled"),
    )


def device_rollup(hosts: DataFrame, key: str, listing: str = "listing") -> DataFrame:
    """Cards of each host from its device listing: names, count, memory of the first card and in total."""
    cards = F.transform(
        F.filter(F.transform(lines(F.col(listing)), strip), lambda line: F.contains(line, F.lit(","))),
        lambda line: F.struct(
            strip(F.split(line, ",")[0]).alias("name"), strip(F.split(line, ",")[1]).try_cast("double").alias("mb")
        ),
    )
    rows = hosts.select(key, cards.alias("c")).where(F.size("c") > 0)
    total = F.aggregate("c", F.lit(0.0), lambda acc, c: acc + F.coalesce(c["mb"], F.lit(0.0)))
    return rows.select(
        key,
        F.size("c").cast("bigint").alias("cards"),
        F.array_join(F.transform("c", lambda c: c["name"]), " + ").alias("names"),
        round1(F.col("c")[0]["mb"] / 1024).alias("vram_gb"),
        F.when(total > 0, round1(total / 1024)).alias("total_vram_gb"),
    )


def cost_entries(runs: DataFrame, key: str, costs: str = "costs") -> DataFrame:
    """Cost entries ``component|condition|year|price|currency`` split at semicolons, each with its reject reason."""
    rows = runs.select(key, F.posexplode(F.split(costs, ";")).alias("entry", "raw")).withColumn(
        "f", F.transform(F.split("raw", r"\|"), strip)
    )
    part = lambda i: F.try_element_at("f", F.lit(i))
    rows = rows.select(
        key,
        "entry",
        F.size("f").alias("fields"),
        part(1).alias("component"),
        F.upper(part(2)).alias("condition"),
        part(3).alias("year_text"),
        part(3).try_cast("int").alias("year"),
        part(4).try_cast("double").alias("price"),
        F.upper(part(5)).alias("currency"),
    )
    reason = (
        F.when(F.col("fields") != 5, "must have 5 pipe-separated fields")
        .when((F.col("year_text") != "") & F.col("year").isNull(), "year is not an integer")
        .when(F.col("price").isNull(), "price is not a number")
        .when(F.col("component") == "", "component is required")
        .when(~F.col("condition").isin("NEW", "USED"), "condition must be NEW or USED")
        .when(F.col("price") <= 0, "price must be a positive number")
        .when(~F.col("currency").rlike("^[A-Z]{3}$"), "currency must be a 3-letter ISO code")
        .when(
            (F.col("year") != 0) & ~F.col("year").between(1980, F.year(F.current_date())),
            "year must be from 1980 through this year",
        )
    )
    return rows.withColumn("reason", reason).drop("fields", "year_text")


def cost_rollup(runs: DataFrame, key: str, costs: str = "costs") -> DataFrame:
    """Accepted cost per run and currency, with the number of entries accepted."""
    kept = cost_entries(runs, key, costs).where(F.col("reason").isNull())
    return kept.groupBy(key, "currency").agg(
        F.count(F.lit(1)).alias("entries"), F.sum(F.col("price").cast("decimal(18,6)")).cast("double").alias("price")
    )


def watts_total(text: Column) -> Column:
    """Sum of comma-separated watts; null unless there is at least one entry and all are positive numbers."""
    parts = F.filter(F.transform(F.split(text, "[,;]"), strip), lambda p: p != "")
    values = F.transform(parts, lambda p: F.coalesce(p.try_cast("double"), F.lit(0.0)))
    return F.when(
        (F.size(parts) > 0) & F.forall(values, lambda v: v > 0),
        F.aggregate(values, F.lit(0.0), lambda acc, v: acc + v),
    )
