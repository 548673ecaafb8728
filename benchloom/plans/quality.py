"""Data set quality over documents, labels and pages."""

from pyspark.sql import functions as F

from benchloom.functions.text import head_tail
from benchloom.operators import quality as ops
from benchloom.operators.training import dedupe_first
from benchloom.plans.extraction import sql_strip
from benchloom.plans.registry import query

_COLLAPSED = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"


@query(
    "map_columns",
    "SELECT doc_id, text AS input, source AS gold, lang AS rubric_note, 'qa' AS kind FROM documents",
)
def _(t):
    rows = t.documents.select(
        "doc_id", F.col("text").alias(" Question"), F.col("source").alias("ANSWER"), F.col("lang").alias("rubric_note")
    )
    return ops.map_columns(rows)


@query(
    "import_items",
    rf"""WITH r AS (SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN '  ' ELSE concat(' ', text, ' ') END AS input,
          CASE WHEN doc_id % 7 > 0 THEN source END AS gold, CASE doc_id % 4 WHEN 0 THEN '["a", "b", "c"]' WHEN 1 THEN
          'x | y || z' WHEN 2 THEN 'only' ELSE concat(lang, '|', source) END AS choices FROM documents)
        SELECT doc_id, sha256({sql_strip('input')}) AS input_hash, CASE doc_id % 4 WHEN 0 THEN 'a;b;c' WHEN 1 THEN 'x;y;z'
          WHEN 2 THEN 'only' ELSE replace(choices, '|', ';') END AS choices,
          CASE WHEN {sql_strip('input')} = '' THEN 'no input' WHEN gold IS NULL THEN 'no gold' WHEN doc_id % 4 = 2 THEN
          'needs at least two choices' END AS error FROM r""",
)
def _(t):
    k = F.col("doc_id")
    rows = t.documents.select(
        "doc_id",
        F.when(k % 11 == 0, "  ").otherwise(F.concat(F.lit(" "), "text", F.lit(" "))).alias("input"),
        F.when(k % 7 > 0, F.col("source")).alias("gold"),
        F.when(k % 4 == 0, '["a", "b", "c"]')
        .when(k % 4 == 1, "x | y || z")
        .when(k % 4 == 2, "only")
        .otherwise(F.concat("lang", F.lit("|"), "source"))
        .alias("choices"),
    )
    got = ops.import_items(rows, "multiple_choice")
    return got.select(
        "doc_id", F.sha2("input", 256).alias("input_hash"), F.array_join("choices", ";").alias("choices"), "error"
    )


def audit_input(t):
    k = F.col("item_id")
    choices = F.when(k % 2 == 0, F.array("c1", "c2", F.when(k % 10 == 0, F.upper("c1")).otherwise(F.col("c3")), "c4"))
    return t.items.select(
        F.concat(F.lit("items["), k.cast("string"), F.lit("]")).alias("path"),
        k.alias("place"),
        "input",
        F.when(k % 9 == 0, "").otherwise(F.col("gold")).alias("gold"),
        choices.alias("choices"),
    )


_ITEMS = """SELECT concat('items[', item_id, ']') AS path, item_id AS place, regexp_replace(input, '^\\s+|\\s+$', '', 'g') AS input,
  regexp_replace(CASE WHEN item_id % 9 = 0 THEN '' ELSE gold END, '^\\s+|\\s+$', '', 'g') AS gold,
  CASE WHEN item_id % 2 = 0 THEN [c1, c2, CASE WHEN item_id % 10 = 0 THEN upper(c1) ELSE c3 END, c4] END AS choices FROM items"""
_ISSUES = f"""SELECT 'warning' AS severity, 'input_very_long' AS code, path || '.input' AS path FROM it WHERE strlen(input) > 12000
  UNION ALL SELECT 'warning', 'possible_gold_leak', path FROM it WHERE strlen(gold) >= 4 AND contains(lower(input), lower(gold))
  UNION ALL SELECT 'error', 'duplicate_choice', path || '.choices' FROM it WHERE choices IS NOT NULL AND
    len(list_distinct(list_transform(choices, lambda c: {_COLLAPSED.format(x='c')}))) < len(choices)
  UNION ALL SELECT 'error', 'invalid_choice_gold', path || '.gold' FROM it WHERE choices IS NOT NULL AND NOT (gold <> '' AND
    ((strlen(gold) = 1 AND upper(gold) BETWEEN 'A' AND 'D') OR coalesce(try_cast(gold AS int) BETWEEN 0 AND 3, false) OR
     list_contains(list_transform(choices, lambda c: lower(trim(c))), lower(gold))))
  UNION ALL SELECT 'error', 'duplicate_input', path || '.input' FROM (SELECT path, row_number() OVER (PARTITION BY
    {_COLLAPSED.format(x='input')} ORDER BY place) AS n FROM it) WHERE n > 1
  UNION ALL SELECT 'warning', 'answer_imbalance', 'tasks' FROM (SELECT count(*) AS k, min(n) AS a, max(n) AS b FROM (SELECT
    upper(gold), count(*) AS n FROM it WHERE gold <> '' GROUP BY 1)) WHERE k > 1 AND b > 3 * a
  UNION ALL SELECT 'warning', 'source_missing', 'sourceUrl'"""


@query("audit_items", f"WITH it AS ({_ITEMS}) {_ISSUES}")
def _(t):
    return ops.audit_items(audit_input(t), description="Questions over documents.")


@query("sorted_issues", f"WITH it AS ({_ITEMS}) {_ISSUES} ORDER BY severity, path, code")
def _(t):
    return ops.sorted_issues(ops.audit_items(audit_input(t), description="Questions over documents."))


@query(
    "audit_summary",
    f"""WITH it AS ({_ITEMS}), x AS ({_ISSUES}) SELECT (SELECT count(*) FROM it) AS item_count, count(CASE WHEN severity = 'error' THEN 1 END) AS
        error_count, count(CASE WHEN severity <> 'error' THEN 1 END) AS warning_count, count(CASE WHEN severity = 'error' THEN 1 END) = 0 AS valid, false AS
        publishable FROM x""",
)
def _(t):
    items = audit_input(t)
    return ops.audit_summary(ops.audit_items(items, "Questions over documents."), items, "Questions over documents.")


@query(
    "duplicate_input",
    f"""SELECT doc_id, first_id AS duplicates, copies FROM (SELECT doc_id, min(doc_id) OVER w AS first_id, count(*) OVER w AS
        copies FROM documents WINDOW w AS (PARTITION BY {_COLLAPSED.format(x='text')})) WHERE doc_id > first_id""",
)
def _(t):
    from benchloom.functions.text import collapsed_text
    from benchloom.session import materialize

    keyed = materialize(
        t.documents.select("doc_id", F.col("doc_id").alias("place"), F.sha2(collapsed_text(F.col("text")), 256).alias("key")),
        "keys",
    )
    return ops.duplicate_inputs(keyed, path="doc_id")


@query(
    "answer_balance",
    """SELECT lang, count(*) AS answers, cast(sum(n) AS bigint) AS items, min(n) AS least, max(n) AS most, count(*) > 1 AND
       sum(n) >= 20 AND max(n) > 3 * min(n) AS imbalanced FROM (SELECT lang, upper(concat('q', quality)) AS g, count(*) AS n FROM
       labels JOIN documents USING (doc_id) GROUP BY ALL) GROUP BY lang""",
)
def _(t):
    golds = t.labels.join(t.documents.select("doc_id", "lang"), "doc_id").select(
        "lang", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("gold")
    )
    return ops.answer_balance(golds, by=["lang"])


def _suites(t):
    k = F.col("p_partkey")
    return t.part.select(
        k.alias("suite"),
        F.when(k % 5 == 0, "Bad Slug").when(k % 5 == 1, None).otherwise(F.translate("p_name", " ", "-")).alias("slug"),
        F.when(k % 7 > 0, F.col("p_name")).alias("name"),
        F.col("p_type").alias("category"),
        F.when(k % 3 == 0, "CUSTOM").when(k % 3 == 1, "LM_EVAL_HARNESS").otherwise("OTHER").alias("runner"),
        F.when(k % 2 == 0, "custom").otherwise("lm-eval-harness").alias("doc_runner"),
        F.when(k % 4 == 0, "perplexity").when(k % 4 == 1, "guess").otherwise("f1").alias("scoring_method"),
        (F.col("p_size") * 3).alias("tasks"),
    )


@query(
    "validate_suite",
    """WITH s AS (SELECT p_partkey AS k, CASE p_partkey % 5 WHEN 0 THEN 'Bad Slug' WHEN 1 THEN NULL ELSE replace(p_name, ' ', '-')
         END AS slug, CASE WHEN p_partkey % 7 > 0 THEN p_name END AS name, CASE p_partkey % 3 WHEN 0 THEN 'CUSTOM' WHEN 1 THEN
         'LM_EVAL_HARNESS' ELSE 'OTHER' END AS runner, p_partkey % 2 = 0 AS custom, p_partkey % 4 AS m, p_size * 3 AS tasks FROM part)
       SELECT k AS suite, cast((slug IS NULL)::int + (name IS NULL)::int + (slug IS NULL OR k % 5 = 0)::int + (name IS NULL)::int +
         (runner = 'OTHER')::int + (custom <> (runner <> 'LM_EVAL_HARNESS'))::int + (m = 1)::int + (m = 0)::int + (tasks > 100)::int
         AS bigint) AS errors FROM s WHERE (slug IS NULL)::int + (name IS NULL)::int + (slug IS NULL OR k % 5 = 0)::int +
         (runner = 'OTHER')::int + (custom <> (runner <> 'LM_EVAL_HARNESS'))::int + (m = 1)::int + (m = 0)::int + (tasks > 100)::int > 0""",
)
def _(t):
    return ops.validate_suites(_suites(t)).groupBy("suite").agg(F.count(F.lit(1)).alias("errors"))


@query(
    "validate_tasks",
    """WITH k AS (SELECT l_orderkey AS suite, l_partkey * 100000 + l_suppkey * 100 + l_linenumber AS task_index,
         CASE WHEN l_quantity < 5 THEN '' ELSE cast(l_linenumber AS varchar) END AS key, CASE WHEN l_suppkey % 2 = 0 THEN 'CUSTOM' ELSE
         'LM_EVAL_HARNESS' END AS runner, l_partkey % 10 = 0 AS no_name, l_partkey % 6 AS e, l_linenumber % 4 AS items FROM lineitem),
       d AS (SELECT *, task_index > min(task_index) OVER (PARTITION BY suite, key) AS dup FROM k)
       SELECT message, count(*) AS n FROM (SELECT unnest(list_filter([
         CASE WHEN key = '' THEN 'key is required' END, CASE WHEN dup THEN 'key is a duplicate' END,
         CASE WHEN no_name THEN 'displayName is required' END,
         CASE WHEN runner = 'CUSTOM' AND e = 1 THEN 'promptTemplate is required for CUSTOM suites' END,
         CASE WHEN runner = 'CUSTOM' AND e = 2 THEN 'answerExtraction must be none, last_number, or regex' END,
         CASE WHEN runner = 'CUSTOM' AND e = 3 THEN 'answerRegex is required when answerExtraction is regex' END,
         CASE WHEN runner = 'CUSTOM' AND items = 3 THEN 'dataset is required for CUSTOM suites' END,
         CASE WHEN runner = 'CUSTOM' AND items = 0 THEN 'dataset.items is required for inline datasets' END],
         lambda x: x IS NOT NULL)) AS message FROM d) GROUP BY message""",
)
def _(t):
    e, items = F.col("l_partkey") % 6, F.col("l_linenumber") % 4
    tasks = t.lineitem.select(
        F.col("l_orderkey").alias("suite"),
        (F.col("l_partkey") * 100000 + F.col("l_suppkey") * 100 + F.col("l_linenumber")).alias("task_index"),
        F.when(F.col("l_quantity") < 5, "").otherwise(F.col("l_linenumber").cast("string")).alias("key"),
        F.when(F.col("l_suppkey") % 2 == 0, "CUSTOM").otherwise("LM_EVAL_HARNESS").alias("runner"),
        F.when(F.col("l_partkey") % 10 != 0, "name").alias("display_name"),
        F.when(e != 1, "{{input}}").alias("prompt_template"),
        F.when(e == 2, "final").when(e == 3, "regex").alias("answer_extraction"),
        F.lit("").alias("answer_regex"),
        F.when(items != 3, items).alias("items"),
    )
    return ops.validate_tasks(tasks).groupBy("message").agg(F.count(F.lit(1)).alias("n"))


@query(
    "validate_suite_items",
    """SELECT doc_id, cast((doc_id % 5 = 0)::int + (doc_id % 3 = 0)::int + (doc_id % 4 = 0)::int AS bigint) AS errors FROM documents
       WHERE doc_id % 5 = 0 OR doc_id % 3 = 0 OR doc_id % 4 = 0""",
)
def _(t):
    k = F.col("doc_id")
    items = t.documents.select(
        F.lit("s").alias("suite"),
        k.alias("item_index"),
        F.when(k % 5 > 0, F.col("text")).alias("input"),
        F.when(k % 6 > 0, F.when(k % 3 > 0, F.col("source"))).alias("gold"),
        F.lit(None).cast("string").alias("rubric"),
        F.lit("multiple_choice").alias("task_type"),
        F.when(k % 4 == 0, F.array().cast("array<string>")).otherwise(F.array("lang", "source")).alias("choices"),
    )
    got = ops.validate_suite_items(items).groupBy("item_index").agg(F.count(F.lit(1)).alias("errors"))
    return got.withColumnRenamed("item_index", "doc_id")


@query(
    "redact_labels",
    """SELECT event_id, props AS doc, event_type FROM (SELECT event_id, concat('{"k":', json_extract_string(props, '$.k'),
       ',"list":[{"z":"é"}],"n":{"Gold":1}}') AS props, event_type FROM events)""",
)
def _(t):
    doc = F.concat(
        F.lit('{"k": '),
        F.get_json_object("props", "$.k"),
        F.lit(', "gold": 1, "list": [{"answer": "x", "z": "é"}], "n": {"label": {}, "Gold": 1, "target": [1]}}'),
    )
    rows = t.events.select("event_id", "event_type", doc.alias("doc"), F.col("value").alias("answer"))
    return ops.redact_labels(rows, "doc")


@query(
    "balanced_sample",
    """SELECT question_id, task, pass FROM (SELECT *, row_number() OVER (PARTITION BY task, pass ORDER BY question_id) AS n FROM
       results WHERE scored) WHERE n <= CASE WHEN pass THEN 6 ELSE 5 END""",
)
def _(t):
    return ops.balanced_sample(t.results, ["task"], "question_id", 11).select("question_id", "task", "pass")


@query(
    "shard_assign",
    """SELECT doc_id, p AS position, cast(max(i) AS bigint) AS shard FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS p,
       count(*) OVER () AS n FROM documents), range(0, 7) r(i) WHERE i * n // 7 <= p GROUP BY doc_id, p""",
)
def _(t):
    return ops.shard_assign(t.documents.select("doc_id"), ["doc_id"], 7)


@query(
    "dedupe_first",
    """SELECT key, doc_id FROM (SELECT concat(lang, source) AS key, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY
       n_chars, doc_id) AS n FROM documents) WHERE n = 1""",
)
def _(t):
    rows = t.documents.select(F.concat("lang", "source").alias("key"), "doc_id", "n_chars")
    return dedupe_first(rows, "key", ["n_chars", "doc_id"]).select("key", "doc_id")


@query(
    "head_tail_sample",
    """SELECT doc_id, sha256(text) AS text_hash, sha256(left(text, 2000)) AS prompt_hash, sha256(CASE WHEN length(text) <= 4000 THEN
       text ELSE concat(left(text, 3000), chr(10), '…', chr(10), right(text, 1000)) END) AS sample_hash FROM documents""",
)
def _(t):
    text = F.col("text")
    return t.documents.select(
        "doc_id",
        F.sha2(text, 256).alias("text_hash"),
        F.sha2(F.left(text, F.lit(2000)), 256).alias("prompt_hash"),
        F.sha2(head_tail(text), 256).alias("sample_hash"),
    )
