"""Training rows over conversations, pages, documents and orders."""

from pyspark.sql import functions as F

from benchloom.operators import training as ops
from benchloom.plans.registry import query

MARK = ops.CUT_MARK


def trace_events(t):
    """Each turn as a closed message event; system turns as tool results; every fifth event only a streamed part."""
    k = F.col("conv_id") * 31 + F.col("turn")
    role = (
        F.when(F.col("role") == "system", "toolResult").when(k % 23 == 0, "developer").otherwise(F.col("role"))
    )
    part = lambda kind, text, name: F.struct(
        F.lit(kind).alias("type"),
        text.alias("text"),
        F.lit("private").alias("thinking"),
        F.lit("c1").alias("id"),
        F.lit(name).alias("name"),
        F.lit(None).cast("string").alias("arguments"),
    )
    none = F.lit(None).cast("string")
    content = F.array(
        part("thinking", none, ""),
        part("text", F.when(k % 7 > 0, F.col("text")), ""),
        part("text", F.when(k % 7 > 0, F.lit("tail")), ""),
        F.when(k % 4 == 0, part("toolCall", none, "bash")),
    )
    return t.conversations.select(
        F.col("conv_id").alias("id"),
        F.col("turn").alias("seq"),
        F.when(k % 5 == 0, "message_update").otherwise("message_end").alias("type"),
        F.struct(
            role.alias("role"),
            F.array_compact(content).alias("content"),
            F.lit("call").alias("toolCallId"),
            F.lit("bash").alias("toolName"),
        ).alias("message"),
    )


_MESSAGES = f"""SELECT id, seq, CASE role WHEN 'toolResult' THEN 'tool' ELSE role END AS role,
    CASE WHEN role = 'toolResult' AND c = '' THEN '(no output)' WHEN strlen(c) <= 1024 THEN c ELSE concat(cut, '{MARK}') END AS content,
    role = 'assistant' AND k % 4 = 0 AS has_calls, strlen(c) > 1024 AS content_cut
  FROM (SELECT conv_id AS id, turn AS seq, conv_id * 31 + turn AS k, CASE WHEN role = 'system' THEN 'toolResult' WHEN
      (conv_id * 31 + turn) % 23 = 0 THEN 'developer' ELSE role END AS role,
      CASE WHEN (conv_id * 31 + turn) % 7 > 0 THEN concat(text, chr(10), 'tail') ELSE '' END AS c,
      list_aggregate(list_transform(list_filter(range(1, length(text) + 6), lambda i: strlen(left(concat(text, chr(10), 'tail'), i)) <=
        1024 - strlen('{MARK}')), lambda i: i), 'max') AS chars,
      left(concat(text, chr(10), 'tail'), cast(chars AS int)) AS cut FROM conversations)
  WHERE k % 5 > 0 AND role IN ('user', 'assistant', 'toolResult') AND (role = 'toolResult' OR c <> '' OR
    (role = 'assistant' AND k % 4 = 0))""".replace("\n[", "' || chr(10) || '[")


def messages(t, limit=1024):
    return ops.normalize_messages(trace_events(t), ["id", "seq"], limit)


@query("normalize_messages", f"SELECT id, seq, role, sha256(content) AS content_hash, has_calls, content_cut FROM ({_MESSAGES})")
def _(t):
    return messages(t).select(
        "id",
        "seq",
        "role",
        F.sha2("content", 256).alias("content_hash"),
        F.coalesce(F.size("tool_calls") > 0, F.lit(False)).alias("has_calls"),
        "content_cut",
    )


@query("finalized_only", "SELECT conv_id AS id, turn AS seq FROM conversations WHERE (conv_id * 31 + turn) % 5 > 0")
def _(t):
    return ops.finalized_only(trace_events(t)).select("id", "seq")


def records(t):
    k = F.col("id")
    return t.conversations.groupBy(F.col("conv_id").alias("id")).agg(F.first("text").alias("_x")).select(
        "id",
        (k % 3 != 0).alias("passed"),
        (k % 7 != 0).alias("scored"),
        F.when(k % 11 > 0, F.concat(F.lit("/t/"), k.cast("string"))).alias("trace_path"),
        F.repeat(F.lit("é"), 600).alias("question"),
        F.lit("short").alias("verifier_output"),
    )


_CLASSIFIED = f"""SELECT r.id, r.passed, r.scored, coalesce(m.cut, 0) AS cut, CASE WHEN NOT (passed AND scored) THEN NULL WHEN
    id % 11 = 0 THEN 'passing_trace_missing' WHEN m.id IS NULL THEN 'passing_trace_invalid' WHEN u = 0 OR a = 0 THEN
    'passing_conversation_incomplete' END AS reason, passed AND scored AS good FROM
  (SELECT DISTINCT conv_id AS id, conv_id % 3 <> 0 AS passed, conv_id % 7 <> 0 AS scored FROM conversations) r LEFT JOIN
  (SELECT id, count(CASE WHEN role = 'user' THEN 1 END) AS u, count(CASE WHEN role = 'assistant' THEN 1 END) AS a, count(CASE WHEN content_cut THEN 1 END) AS cut FROM ({_MESSAGES})
   GROUP BY id) m USING (id)"""


@query(
    "sft_rows",
    f"""SELECT m.id, m.seq, m.role, sha256(m.content) AS content_hash FROM ({_MESSAGES}) m JOIN ({_CLASSIFIED}) c USING (id) WHERE
        c.good AND c.reason IS NULL""",
)
def _(t):
    rows = ops.sft_rows(records(t), messages(t))
    return rows.select("id", "seq", "role", F.sha2("content", 256).alias("content_hash"))


@query(
    "failure_rows",
    f"""SELECT id, sha256(concat(repeat('é', {(1024 - len(MARK)) // 2}), '{MARK}')) AS question_hash, true AS question_cut, 'short' AS
        verifier_output, 'diagnostic_only' AS training_use FROM ({_CLASSIFIED}) WHERE NOT good""".replace("\n[", "' || chr(10) || '["),
)
def _(t):
    rows = ops.failure_rows(records(t), messages(t), limit=1024)
    return rows.select(
        "id", F.sha2("question", 256).alias("question_hash"), "question_cut", "verifier_output", "training_use"
    )


@query(
    "export_manifest",
    f"""SELECT count(*) AS total, count(CASE WHEN scored THEN 1 END) AS scored, count(CASE WHEN passed THEN 1 END) AS passed, count(CASE WHEN NOT passed THEN 1 END) AS failed,
        count(CASE WHEN good AND reason IS NULL THEN 1 END) AS sft_examples, count(CASE WHEN NOT good THEN 1 END) AS failure_examples,
        cast(sum(CASE WHEN good THEN cut ELSE 1 END) AS bigint) AS truncated_fields,
        count(CASE WHEN reason = 'passing_trace_missing' THEN 1 END) AS trace_missing, count(CASE WHEN reason = 'passing_trace_invalid' THEN 1 END) AS trace_invalid,
        count(CASE WHEN reason = 'passing_conversation_incomplete' THEN 1 END) AS incomplete FROM ({_CLASSIFIED})""",
)
def _(t):
    row = ops.export_manifest(records(t), messages(t), limit=1024)
    skipped = lambda k: F.coalesce(F.try_element_at("skipped", F.lit(k)), F.lit(0))
    return row.select(
        "total",
        "scored",
        "passed",
        "failed",
        "sft_examples",
        "failure_examples",
        "truncated_fields",
        skipped("passing_trace_missing").alias("trace_missing"),
        skipped("passing_trace_invalid").alias("trace_invalid"),
        skipped("passing_conversation_incomplete").alias("incomplete"),
    )


@query(
    "truncate_bytes",
    f"""SELECT doc_id, strlen(text) > 4000 AS text_cut, sha256(CASE WHEN strlen(text) <= 4000 THEN text ELSE concat(left(text, cast(n AS
        int)), '{MARK}') END) AS text_hash FROM (SELECT *, CASE WHEN strlen(text) > 4000 THEN list_aggregate(list_filter(range(1900,
        4000), lambda i: strlen(left(text, i)) <= 4000 - {len(MARK)}), 'max') END AS n FROM documents)""".replace(
        "\n[", "' || chr(10) || '["
    ),
)
def _(t):
    rows = ops.truncate_bytes(t.documents.select("doc_id", "text"), "text", 4000)
    return rows.select("doc_id", "text_cut", F.sha2("text", 256).alias("text_hash"))


@query(
    "latest_trace",
    "SELECT split_part(url, '/', 3) AS task, max(url) AS path FROM pages GROUP BY 1",
)
def _(t):
    files = t.pages.select(F.split_part("url", F.lit("/"), F.lit(3)).alias("task"), F.col("url").alias("path"))
    return ops.latest_trace(files, "task", "path")


def _tasks(t):
    k = F.col("doc_id")
    return t.documents.select(
        F.when(k % 10 == 0, F.concat(F.lit("a/b"), k.cast("string")))
        .when(k % 10 == 1, F.concat(F.lit("task"), F.expr("doc_id div 100")))
        .otherwise(F.concat(F.lit("task-"), k.cast("string")))
        .alias("task_id"),
        F.concat(F.lit("ref-"), F.when(k % 50 == 2, F.lit("same")).otherwise(k.cast("string"))).alias("bundle_ref"),
        F.when(k % 30 == 5, " \n").otherwise(F.col("text")).alias("instruction"),
    )


_TASKS = """SELECT CASE doc_id % 10 WHEN 0 THEN concat('a/b', doc_id) WHEN 1 THEN concat('task', doc_id // 100) ELSE concat('task-',
  doc_id) END AS task_id, concat('ref-', CASE WHEN doc_id % 50 = 2 THEN 'same' ELSE cast(doc_id AS varchar) END) AS bundle_ref,
  CASE WHEN doc_id % 30 = 5 THEN ' ' ELSE text END AS instruction, doc_id FROM documents"""


@query(
    "rl_prompt_rows",
    f"""SELECT task_id, bundle_ref, CASE WHEN trim(instruction) = '' THEN 'empty instruction' WHEN task_id LIKE '%/%' THEN
        'unsafe task id' WHEN count(*) OVER (PARTITION BY task_id) > 1 THEN 'duplicate task id' WHEN count(*) OVER (PARTITION BY
        bundle_ref) > 1 THEN 'duplicate bundle reference' END AS error FROM ({_TASKS})""",
)
def _(t):
    return ops.prompt_rows(_tasks(t)).select("task_id", "bundle_ref", "error")


@query(
    "rl_row_validate",
    f"""SELECT doc_id, CASE doc_id % 7 WHEN 1 THEN 'not a row' WHEN 2 THEN 'unknown field' WHEN 3 THEN
        'needs exactly one nonempty user message' WHEN 4 THEN 'unknown field' WHEN 5 THEN CASE WHEN task_id LIKE '%/%' THEN
        'unsafe task id' ELSE 'does not match its task' END ELSE CASE WHEN trim(instruction) = '' THEN
        'needs exactly one nonempty user message' WHEN task_id LIKE '%/%' THEN 'unsafe task id' END END AS error FROM ({_TASKS})""",
)
def _(t):
    rows = _numbered(t)
    k = F.col("doc_id")
    message = F.struct(F.lit("user").alias("role"), F.col("instruction").alias("content"))
    good = F.to_json(F.struct(F.array(message).alias("prompt"), "task_id", "bundle_ref"))
    two = F.to_json(F.struct(F.array(message, message).alias("prompt"), "task_id", "bundle_ref"))
    extra = F.to_json(F.struct(F.array(message).alias("prompt"), "task_id", "bundle_ref", F.lit(1).alias("x")))
    inner = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("user").alias("role"), "instruction", F.lit("c").alias("content"))).alias("prompt"),
            "task_id",
            "bundle_ref",
        )
    )
    other = F.to_json(
        F.struct(
            F.array(F.struct(F.lit("user").alias("role"), F.lit("another text").alias("content"))).alias("prompt"),
            "task_id",
            "bundle_ref",
        )
    )
    line = (
        F.when(k % 7 == 1, "{broken")
        .when(k % 7 == 2, extra)
        .when(k % 7 == 3, two)
        .when(k % 7 == 4, inner)
        .when(k % 7 == 5, other)
        .otherwise(good)
    )
    known = rows.select("task_id", "bundle_ref", "instruction").dropDuplicates(["task_id", "bundle_ref"])
    checked = ops.validate_prompt_rows(rows.select("doc_id", line.alias("line")), known)
    return checked.select("doc_id", "error")


def _numbered(t):
    """Tasks with a reference of their own each, so that every row has one task."""
    k = F.col("doc_id")
    return t.documents.select(
        "doc_id",
        F.when(k % 10 == 0, F.concat(F.lit("a/b"), k.cast("string")))
        .when(k % 10 == 1, F.concat(F.lit("task"), F.expr("doc_id div 100").cast("string")))
        .otherwise(F.concat(F.lit("task-"), k.cast("string")))
        .alias("task_id"),
        F.concat(F.lit("ref-"), k.cast("string")).alias("bundle_ref"),
        F.when(k % 30 == 5, " ").otherwise(F.col("text")).alias("instruction"),
    )


@query(
    "sft_validate",
    """SELECT conv_id AS id, count(CASE WHEN role = 'user' THEN 1 END) AS users, count(CASE WHEN role = 'assistant' THEN 1 END) AS assistants FROM conversations
       GROUP BY conv_id HAVING count(CASE WHEN role = 'user' THEN 1 END) = 0 OR count(CASE WHEN role = 'assistant' THEN 1 END) = 0""",
)
def _(t):
    return ops.validate_conversations(t.conversations.withColumnRenamed("conv_id", "id"))


@query(
    "label_mask",
    r"""WITH m AS (SELECT conv_id AS id, turn, role, len(list_filter(string_split_regex(text, '\s+'), lambda w: w <> '')) AS n FROM
         conversations),
        k AS (SELECT *, greatest(least(n, 60 - (sum(n) OVER (PARTITION BY id ORDER BY turn) - n)), 0) AS kept FROM m)
        SELECT id, cast(sum(kept) AS bigint) AS tokens, cast(sum(CASE WHEN role = 'assistant' THEN kept ELSE 0 END) AS bigint) AS
        learned FROM k GROUP BY id HAVING sum(CASE WHEN role = 'assistant' THEN kept ELSE 0 END) > 0""",
)
def _(t):
    rows = t.conversations.select(F.col("conv_id").alias("id"), "turn", "role", F.col("text").alias("content"))
    return ops.label_counts(ops.label_mask(rows, "id", ["turn"], 60), "id")


@query(
    "strict_task_order",
    """SELECT o_orderkey, o_custkey FROM (SELECT *, lag(o_custkey) OVER (ORDER BY o_orderkey) AS p FROM orders) WHERE o_custkey <= p""",
)
def _(t):
    return ops.strict_task_order(t.orders.select("o_orderkey", "o_custkey"), ["o_orderkey"], "o_custkey").select(
        "o_orderkey", "o_custkey"
    )


def trace_lines(t):
    k = F.col("conv_id") * 31 + F.col("turn")
    message = F.struct(
        F.col("role").alias("role"),
        F.array(F.struct(F.lit("text").alias("type"), F.when(k % 6 > 0, F.col("text")).alias("text"))).alias("content"),
        F.struct(
            F.octet_length("text").alias("input"),
            F.when(k % 2 == 0, k).alias("completion_tokens"),
            F.lit(3).alias("cacheRead"),
            F.when(k % 3 == 0, F.lit(1000)).alias("totalTokens"),
        ).alias("usage"),
    )
    kind = (
        F.when(k % 8 == 0, "tool_execution_end")
        .when(k % 8 == 1, "turn_start")
        .when(k % 8 == 2, "message_update")
        .when(k % 8 == 3, "surprise")
        .when(k % 8 == 4, None)
        .otherwise("message_end")
    )
    line = F.to_json(F.struct(kind.alias("type"), message.alias("message")))
    line = F.when(k % 13 == 0, F.concat(F.lit("{"), line)).when(k % 13 == 1, "").otherwise(line)
    return t.conversations.select("conv_id", line.alias("line"))


@query(
    "trace_summary",
    """WITH e AS (SELECT *, conv_id * 31 + turn AS k FROM conversations), s AS (SELECT *, k % 13 > 1 AS ok FROM e)
       SELECT conv_id, count(CASE WHEN ok THEN 1 END) AS events, count(CASE WHEN ok AND k % 8 > 4 AND role = 'assistant' AND k % 6 > 0 AND text <> '' THEN 1 END) AS
         assistant_messages, count(CASE WHEN ok AND k % 8 = 0 THEN 1 END) AS tool_executions, count(CASE WHEN ok AND k % 8 = 1 THEN 1 END) AS turns_started,
         count(CASE WHEN ok AND k % 8 = 2 THEN 1 END) AS updates, count(CASE WHEN ok AND k % 8 IN (3, 4) THEN 1 END) AS unknown_events,
         count(CASE WHEN k % 13 = 0 THEN 1 END) AS malformed_lines, cast(0 AS bigint) AS oversized_lines FROM s GROUP BY conv_id""",
)
def _(t):
    return ops.trace_summary(trace_lines(t), "conv_id")


@query(
    "usage_totals",
    """WITH e AS (SELECT *, conv_id * 31 + turn AS k, strlen(text) AS i FROM conversations),
       u AS (SELECT conv_id, i, CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS o, CASE WHEN k % 3 = 0 THEN 1000 ELSE i + CASE WHEN k % 2 = 0
         THEN k ELSE 0 END + 3 END AS total FROM e WHERE k % 13 > 1 AND k % 8 > 4 AND role = 'assistant')
       SELECT conv_id, cast(sum(i) AS bigint) AS input_tokens, cast(sum(o) AS bigint) AS output_tokens, cast(sum(3) AS bigint) AS
         cache_read_tokens, cast(0 AS bigint) AS cache_write_tokens, cast(sum(total) AS bigint) AS total_tokens, count(*) AS model_calls
       FROM u GROUP BY conv_id""",
)
def _(t):
    return ops.usage_totals(trace_lines(t), "conv_id")
