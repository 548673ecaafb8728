"""Training rows from graded runs: messages, passing and failing records, prompts and their checks."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from benchloom.functions.text import cut_bytes, strip, was_cut
from benchloom.operators.joins import first_per_key
from benchloom.operators.ordered import as_sequence, drop_marks, with_previous, with_running_sum

MESSAGE_BYTES = 64 * 1024
CUT_MARK = "\n[TRAINING_DATA_TRUNCATED]"
CONTENT = (
    "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:string>>"
)
EVENT = f"type string, message struct<role:string,content:{CONTENT},toolCallId:string,toolName:string>"


def truncate_bytes(rows: DataFrame, column: str, limit: int = MESSAGE_BYTES, mark: str = CUT_MARK) -> DataFrame:
    """Cut a text to ``limit`` bytes between characters and add ``<column>_cut``."""
    return rows.withColumn(f"{column}_cut", was_cut(F.col(column), limit)).withColumn(
        column, cut_bytes(F.col(column), limit, mark)
    )


def finalized_only(events: DataFrame) -> DataFrame:
    """Events that close a message; streamed parts of messages are left out."""
    return events.where(F.col("type") == "message_end")


def normalize_messages(
    events: DataFrame, keys: Sequence[str], limit: int = MESSAGE_BYTES, mark: str = CUT_MARK
) -> DataFrame:
    """Closed messages as chat rows: texts joined by line, thinking left out, tool calls in function form.

    Other roles and empty messages are dropped; an empty tool output becomes a note.
    """
    m = F.col("message")
    parts = F.filter(F.transform(m["content"], lambda c: F.coalesce(c["text"], F.lit(""))), lambda x: x != "")
    calls = F.transform(
        F.filter(m["content"], lambda c: c["type"] == "toolCall"),
        lambda c: F.struct(
            F.coalesce(c["id"], F.lit("")).alias("id"),
            F.lit("function").alias("type"),
            F.struct(
                F.coalesce(c["name"], F.lit("")).alias("name"), F.coalesce(c["arguments"], F.lit("{}")).alias("arguments")
            ).alias("function"),
        ),
    )
    rows = finalized_only(events).select(
        *keys,
        m["role"].alias("_role"),
        F.coalesce(F.array_join(parts, "\n"), F.lit("")).alias("content"),
        F.when(m["role"] == "assistant", F.coalesce(calls, F.array().cast(
            "array<struct<id:string,type:string,function:struct<name:string,arguments:string>>>"
        ))).alias("tool_calls"),
        F.when(m["role"] == "toolResult", F.coalesce(m["toolCallId"], F.lit(""))).alias("tool_call_id"),
        F.when(m["role"] == "toolResult", F.coalesce(m["toolName"], F.lit(""))).alias("name"),
    )
    # Decided on the whole text, before the cut, so that the filter stays small when it moves down: a cut
    # text ends in the mark and is never blank.
    blank = (strip(F.col("content")) == "") & ~was_cut(F.col("content"), limit)
    kept = (
        F.when(F.col("_role") == "user", ~blank)
        .when(F.col("_role") == "assistant", ~blank | (F.size("tool_calls") > 0))
        .otherwise(F.col("_role") == "toolResult")
    )
    rows = truncate_bytes(rows.where(kept), "content", limit, mark)
    return rows.select(
        *keys,
        F.when(F.col("_role") == "toolResult", "tool").otherwise(F.col("_role")).alias("role"),
        F.when((F.col("_role") == "toolResult") & (F.col("content") == ""), "(no output)")
        .otherwise(F.col("content"))
        .alias("content"),
        F.when(F.size("tool_calls") > 0, F.col("tool_calls")).alias("tool_calls"),
        "tool_call_id",
        "name",
        "content_cut",
    )


def classify_records(records: DataFrame, messages: DataFrame, key: str = "id") -> DataFrame:
    """Add ``use`` (sft, skipped or failure) and ``reason`` to graded records.

    A scored passing record needs a trace with messages of both a user and an assistant.
    """
    shape = messages.groupBy(F.col(key).alias("_key")).agg(
        F.count_if(F.col("role") == "user").alias("_users"),
        F.count_if(F.col("role") == "assistant").alias("_assistants"),
        F.count_if("content_cut").alias("cut_messages"),
    )
    rows = records.join(shape, F.col(key) == F.col("_key"), "left")
    good = F.coalesce("scored", F.lit(False)) & F.coalesce("passed", F.lit(False))
    reason = (
        F.when(~good, None)
        .when(F.coalesce("trace_path", F.lit("")) == "", "passing_trace_missing")
        .when(F.col("_key").isNull(), "passing_trace_invalid")
        .when((F.col("_users") == 0) | (F.col("_assistants") == 0), "passing_conversation_incomplete")
    )
    rows = rows.withColumn("reason", reason)
    use = F.when(~good, "failure").when(F.col("reason").isNull(), "sft").otherwise("skipped")
    return rows.withColumn("use", use).drop("_key", "_users", "_assistants")


def sft_rows(records: DataFrame, messages: DataFrame, key: str = "id") -> DataFrame:
    """Messages of the records fit for training, one row per message.

    A conversation is put together only where its file format needs one line per example.
    """
    fit = classify_records(records, messages, key).where(F.col("use") == "sft").select(key)
    return messages.join(fit, key, "left_semi")


def failure_rows(records: DataFrame, messages: DataFrame, key: str = "id", limit: int = MESSAGE_BYTES) -> DataFrame:
    """Records kept for diagnosis only, with cut question and verifier output."""
    rows = classify_records(records, messages, key).where(F.col("use") == "failure")
    for column in ("question", "verifier_output"):
        rows = truncate_bytes(rows, column, limit)
    return rows.withColumn("training_use", F.lit("diagnostic_only"))


def export_manifest(
    records: DataFrame, messages: DataFrame, key: str = "id", limit: int = MESSAGE_BYTES
) -> DataFrame:
    """Totals of an export in one row, skip reasons as a map."""
    rows = classify_records(records, messages, key)
    failed = F.col("use") == "failure"
    cut = (
        F.when(F.col("use").isin("sft", "skipped"), F.coalesce("cut_messages", F.lit(0)))
        .otherwise(was_cut(F.col("question"), limit).cast("int") + was_cut(F.col("verifier_output"), limit).cast("int"))
    )
    reasons = ["passing_trace_missing", "passing_trace_invalid", "passing_conversation_incomplete"]
    sums = rows.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("scored").alias("scored"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.coalesce("passed", F.lit(False))).alias("failed"),
        F.count_if(F.col("use") == "sft").alias("sft_examples"),
        F.count_if(failed).alias("failure_examples"),
        F.sum(cut).cast("bigint").alias("truncated_fields"),
        *[F.count_if(F.col("reason") == r).alias(f"_{r}") for r in reasons],
    )
    counted = F.map_from_entries(F.array(*[F.struct(F.lit(r).alias("reason"), F.col(f"_{r}").alias("n")) for r in reasons]))
    return sums.withColumn("skipped", F.map_filter(counted, lambda _, n: n > 0)).drop(*[f"_{r}" for r in reasons])


def latest_trace(files: DataFrame, task: str, path: str) -> DataFrame:
    """Last trace path of each task in sort order."""
    return files.groupBy(task).agg(F.max(path).alias(path))


def dedupe_first(rows: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """First row of each id in file order, rows without id dropped."""
    return first_per_key(rows.where(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], order)


def strict_task_order(rows: DataFrame, order: Sequence[str], task: str) -> DataFrame:
    """Rows whose task id is not above the one before them in file order."""
    seq = with_previous(as_sequence(rows, [], order), [], [task])
    return drop_marks(seq.where(F.col("prev_exists") & (F.col(task) <= F.col(f"prev_{task}")))).drop("prev_exists")


def safe_segment(text: Column) -> Column:
    """A plain name: no slash, no control character, no outer white space, not ``.`` or ``..``."""
    return (
        (text != "")
        & (text == strip(text))
        & ~text.isin(".", "..")
        & ~text.rlike(r"[/\\]")
        & ~text.rlike(r"[\x00-\x1f\x7f]")
    )


def prompt_rows(tasks: DataFrame) -> DataFrame:
    """One user message per task; tasks with an unsafe name or a name or reference used twice are refused.

    ``error`` is null for rows that may be written.
    """
    rows = tasks
    for column in ("task_id", "bundle_ref"):
        counts = rows.groupBy(F.col(column).alias("_c")).agg(F.count(F.lit(1)).alias(f"_{column}_n"))
        rows = rows.join(counts, F.col(column) == F.col("_c"), "left").drop("_c")
    error = (
        F.when(strip(F.coalesce("instruction", F.lit(""))) == "", "empty instruction")
        .when(~safe_segment(F.col("task_id")), "unsafe task id")
        .when((F.col("bundle_ref") != ".") & ~safe_segment(F.col("bundle_ref")), "unsafe bundle reference")
        .when(F.col("_task_id_n") > 1, "duplicate task id")
        .when(F.col("_bundle_ref_n") > 1, "duplicate bundle reference")
    )
    prompt = F.array(F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content")))
    return rows.select(prompt.alias("prompt"), "task_id", "bundle_ref", error.alias("error"))


PROMPT_ROW = "struct<prompt:array<struct<role:string,content:string>>,task_id:string,bundle_ref:string>"


def validate_prompt_rows(lines: DataFrame, tasks: DataFrame, line: str = "line") -> DataFrame:
    """Strict check of written prompt rows: shape, no unknown fields, one user message, known task and text."""
    row = F.from_json(line, PROMPT_ROW)
    keys = F.json_object_keys(line)
    first = F.try_element_at(F.expr(f"from_json({line}, 'struct<prompt:array<string>>').prompt"), F.lit(1))
    rows = lines.withColumn("_row", row).withColumn("_keys", keys).withColumn("_first", F.json_object_keys(first))
    known = tasks.select(
        F.col("task_id").alias("_task"), F.col("bundle_ref").alias("_ref"), F.col("instruction").alias("_text")
    )
    rows = rows.join(known, (F.col("_row.task_id") == F.col("_task")) & (F.col("_row.bundle_ref") == F.col("_ref")), "left")
    message = F.try_element_at(F.col("_row.prompt"), F.lit(1))
    unknown = F.size(F.array_except("_keys", F.array(*map(F.lit, ["prompt", "task_id", "bundle_ref"])))) > 0
    unknown = unknown | (F.size(F.array_except("_first", F.array(F.lit("role"), F.lit("content")))) > 0)
    error = (
        F.when(strip(F.col(line)) == "", "empty line")
        .when(F.col("_row").isNull() | F.col("_keys").isNull(), "not a row")
        .when(unknown, "unknown field")
        .when(
            (F.coalesce(F.size("_row.prompt"), F.lit(0)) != 1)
            | (F.coalesce(message["role"], F.lit("")) != "user")
            | (strip(F.coalesce(message["content"], F.lit(""))) == ""),
            "needs exactly one nonempty user message",
        )
        .when(~F.coalesce(safe_segment(F.col("_row.task_id")), F.lit(False)), "unsafe task id")
        .when(F.col("_task").isNull() | (F.col("_text") != message["content"]), "does not match its task")
    )
    return rows.withColumn("error", error).drop("_row", "_keys", "_first", "_task", "_ref", "_text")


def validate_conversations(messages: DataFrame, key: str = "id") -> DataFrame:
    """Conversations lacking a user or an assistant message."""
    roles = messages.groupBy(key).agg(
        F.count_if(F.col("role") == "user").alias("users"), F.count_if(F.col("role") == "assistant").alias("assistants")
    )
    return roles.where((F.col("users") == 0) | (F.col("assistants") == 0))


def words_as_tokens(text: Column) -> Column:
    """Default tokens: one per word, numbered by hash."""
    return F.transform(
        F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w).bitwiseAND(F.lit(0x7FFFFFFF))
    )


def label_mask(
    messages: DataFrame,
    key: str,
    order: Sequence[str],
    max_length: int,
    tokens: Callable[[Column], Column] = words_as_tokens,
) -> DataFrame:
    """Token ids and labels per message: only assistant tokens are learned (others get -100).

    Messages are cut where their conversation reaches ``max_length`` tokens, counted over the sorted
    messages; ``order`` must be unique inside a conversation.  ``tokens`` turns a text column into an
    array of ids and may be a vectorized UDF around a tokenizer.
    """
    rows = messages.withColumn("input_ids", tokens(F.col("content")))
    rows = rows.withColumn("_n", F.size("input_ids"))
    placed = drop_marks(with_running_sum(as_sequence(rows, [key], order), [key], "_n", "_upto"))
    left = F.greatest(F.least(F.col("_n"), F.lit(max_length) - (F.col("_upto") - F.col("_n"))), F.lit(0)).cast("int")
    placed = placed.withColumn("input_ids", F.slice("input_ids", 1, left)).where(F.size("input_ids") > 0)
    labels = F.when(F.col("role") == "assistant", F.col("input_ids")).otherwise(
        F.transform("input_ids", lambda _: F.lit(-100).cast("bigint"))
    )
    return placed.withColumn("labels", labels).drop("_n", "_upto")


def label_counts(masked: DataFrame, key: str) -> DataFrame:
    """Tokens and learned tokens of each conversation, those without a learned token left out."""
    counts = masked.groupBy(key).agg(
        F.sum(F.size("input_ids")).alias("tokens"),
        F.sum(F.when(F.col("role") == "assistant", F.size("labels")).otherwise(0)).alias("learned"),
    )
    return counts.where(F.col("learned") > 0)


# ---------------------------------------------------------------- traces

# Event types a trace may hold besides the ones counted on their own.
KNOWN_EVENTS = [
    "message_end",
    "tool_execution_end",
    "notice",
    "auto_compaction_start",
    "auto_compaction_end",
    "trace_filter_summary",
    "session",
    "agent_start",
    "agent_end",
    "turn_start",
    "turn_end",
    "message_start",
    "message_update",
    "tool_execution_start",
    "tool_execution_update",
]
# Fixed value: longest trace line read.
TRACE_LINE_BYTES = 4 * 1024 * 1024


def parse_trace_lines(lines: DataFrame, line: str = "line", limit: int = TRACE_LINE_BYTES) -> DataFrame:
    """Add ``state`` (ok, oversized, malformed or blank) and ``type`` to each trace line; bad lines are kept."""
    text = F.col(line)
    valid = F.json_object_keys(text).isNotNull()
    state = (
        F.when(F.octet_length(text) > limit, "oversized")
        .when(text == "", "blank")
        .when(valid, "ok")
        .otherwise("malformed")
    )
    kind = F.coalesce(F.nullif(F.get_json_object(text, "$.type"), F.lit("")), F.lit("(missing type)"))
    return lines.withColumn("state", state).withColumn("type", F.when(F.col("state") == "ok", kind))


def trace_summary(lines: DataFrame, key: str, line: str = "line", limit: int = TRACE_LINE_BYTES) -> DataFrame:
    """Per trace: assistant messages with text, tool runs, turns, streamed parts, and bad or unknown lines."""
    rows = parse_trace_lines(lines, line, limit)
    message = F.from_json(
        F.when(F.col("type") == "message_end", F.get_json_object(line, "$.message")),
        f"role string, content {CONTENT}",
    )
    texts = F.filter(message["content"], lambda c: F.coalesce(c["text"], F.lit("")) != "")
    spoken = (message["role"] == "assistant") & (F.size(texts) > 0)
    of = lambda kind: F.count_if(F.col("type") == kind)
    return rows.groupBy(key).agg(
        F.count_if(F.col("state") == "ok").alias("events"),
        F.count_if(F.coalesce(spoken, F.lit(False))).alias("assistant_messages"),
        of("tool_execution_end").alias("tool_executions"),
        of("turn_start").alias("turns_started"),
        of("message_update").alias("updates"),
        F.count_if(~F.col("type").isin(*KNOWN_EVENTS)).alias("unknown_events"),
        F.count_if(F.col("state") == "malformed").alias("malformed_lines"),
        F.count_if(F.col("state") == "oversized").alias("oversized_lines"),
    )


# Spellings of the usage counters, first non-zero wins.
USAGE_ALIASES = {
    "input_tokens": ["prompt_tokens", "input_tokens", "inputTokens", "input"],
    "output_tokens": ["completion_tokens", "output_tokens", "outputTokens", "output"],
    "cache_read_tokens": ["cache_read_tokens", "cacheReadTokens", "cacheRead"],
    "cache_write_tokens": ["cache_write_tokens", "cacheWriteTokens", "cacheWrite"],
    "total_tokens": ["total_tokens", "totalTokens"],
    "model_calls": ["model_calls", "modelCalls"],
}
_USAGE = "struct<" + ",".join(f"`{n}`:double" for names in USAGE_ALIASES.values() for n in names) + ">"


def usage_totals(events: DataFrame, key: str, line: str = "line") -> DataFrame:
    """Six token counters per key, over closed assistant messages only.

    A missing total is the sum of the parts; a message with any tokens counts as one model call.
    """
    head = F.from_json(line, f"struct<type:string,message:struct<role:string,usage:{_USAGE}>>")
    rows = events.select(key, head.alias("e")).where(
        (F.col("e.type") == "message_end") & (F.col("e.message.role") == "assistant")
    )
    usage = F.col("e.message.usage")

    def first(field: str) -> Column:
        values = F.array(*[F.coalesce(usage[n].cast("bigint"), F.lit(0)) for n in USAGE_ALIASES[field]])
        return F.coalesce(F.try_element_at(F.filter(values, lambda v: v != 0), F.lit(1)), F.lit(0)).alias(field)

    rows = rows.select(key, *[first(f) for f in USAGE_ALIASES])
    parts = sum((F.col(f"{f}_tokens") for f in ("input", "output", "cache_read", "cache_write")), F.lit(0))
    rows = rows.withColumn("total_tokens", F.when(F.col("total_tokens") == 0, parts).otherwise(F.col("total_tokens")))
    calls = F.when(F.col("total_tokens") == 0, 0).when(F.col("model_calls") == 0, 1).otherwise(F.col("model_calls"))
    rows = rows.withColumn("model_calls", calls)
    return rows.groupBy(key).agg(*[F.sum(f).alias(f) for f in USAGE_ALIASES])
