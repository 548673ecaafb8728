"""Extraction jobs over documents, pages, conversations and texts rendered from the tables."""

from pyspark.sql import functions as F

from benchloom.operators import extraction as ops
from benchloom.plans.registry import query, r1, r4
from benchloom.session import spread

# SQL forms of the shared rules, for checking.
NUM = r"-?\$?\d[\d,]*(?:\.\d+)?%?"
BOLD = r"\*\*([^*]*\d[^*]*)\*\*"


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_plain(x: str) -> str:
    return sql_strip(rf"regexp_replace(lower({x}), '[^\w\s]+', '', 'g')")


def _bold(x: str) -> str:
    return (
        f"list_filter(list_transform(list_filter(regexp_extract_all({x}, '{BOLD}', 1), lambda b: NOT contains(b, ':')), "
        f"lambda b: regexp_extract(b, '{NUM}')), lambda b: b <> '')[-1]"
    )


FINAL_ANSWER = rf"""
SELECT question_id, model, task, response,
  CASE WHEN len(parts) > 1 THEN nullif(regexp_extract(parts[-1], '{NUM}'), '') END AS a_marker,
  list_filter(list_transform(list_filter(string_split(response, chr(10)),
    lambda l: regexp_matches(l, '(?i)\b(?:total|result|therefore|so)\b')),
    lambda l: coalesce({_bold('l')}, regexp_extract_all(l, '{NUM}')[-1], '')), lambda l: l <> '')[-1] AS a_summary,
  regexp_extract_all(response, '=\s*({NUM})', 1)[-1] AS a_equation,
  {_bold('response')} AS a_bold, regexp_extract_all(response, '{NUM}')[-1] AS a_number
FROM (SELECT *, string_split_regex(response,
  '(?im)(?:####|final\s+answer|(?:the\s+)?answer\s+is|^\s*answer)\s*[:=]?\s*') AS parts FROM responses)"""

RULED = f"""SELECT *, CASE WHEN a_marker IS NOT NULL THEN 'marker' WHEN a_summary IS NOT NULL THEN 'summary'
  WHEN a_equation IS NOT NULL THEN 'equation' WHEN a_bold IS NOT NULL THEN 'bold' WHEN a_number IS NOT NULL
  THEN 'last_number' ELSE 'raw' END AS rule,
  coalesce(a_marker, a_summary, a_equation, a_bold, a_number, response) AS final_answer FROM ({FINAL_ANSWER})"""


@query(
    "answer_extraction_rows",
    rf"""SELECT question_id, rule, CASE WHEN rule <> 'raw' THEN final_answer END AS final_answer,
         sha256(coalesce(a_number, response)) AS last_number_hash,
         sha256(coalesce(regexp_extract_all(response, '(\d+) apples', 1)[-1], response)) AS regex_hash FROM ({RULED})""",
)
def _(t):
    rows = ops.extract_answers(t.responses, r"(\d+) apples")
    return rows.select(
        "question_id",
        "rule",
        F.when(F.col("rule") != "raw", F.col("final_answer")).alias("final_answer"),
        F.sha2("last_number", 256).alias("last_number_hash"),
        F.sha2("regex_answer", 256).alias("regex_hash"),
    )


@query(
    "answer_extraction",
    f"""SELECT model, task, count(*) AS responses, count(CASE WHEN rule = 'marker' THEN 1 END) AS marker, count(CASE WHEN rule = 'summary' THEN 1 END) AS
        summary, count(CASE WHEN rule = 'equation' THEN 1 END) AS equation, count(CASE WHEN rule = 'bold' THEN 1 END) AS bold,
        count(CASE WHEN rule = 'last_number' THEN 1 END) AS last_number, count(CASE WHEN rule = 'raw' THEN 1 END) AS fallbacks,
        {r4("(count(CASE WHEN rule = 'raw' THEN 1 END) / count(*))")} AS fallback_rate FROM ({RULED}) GROUP BY model, task""",
)
def _(t):
    return ops.answer_extraction(t.responses)


def sql_letter(value: str, choices: str) -> str:
    p = sql_plain(value)
    return rf"""CASE WHEN regexp_matches({p}, '^[a-z]$') THEN upper({p})
      WHEN regexp_matches({p}, '^\d+$') THEN CASE WHEN try_cast({p} AS int) <= 26 THEN chr(64 + greatest(try_cast({p} AS int), 1)) ELSE {p} END
      WHEN list_position(list_transform({choices}, lambda c: {sql_plain('c')}), {p}) > 0
        THEN chr(64 + cast(list_position(list_transform({choices}, lambda c: {sql_plain('c')}), {p}) AS int))
      ELSE coalesce(upper(list_filter(string_split_regex({p}, '\s+'), lambda w: regexp_matches(w, '^[a-z]$'))[1]), {p}) END"""


LETTERS = f"""SELECT item_id, task, {sql_letter('response', 'choices')} AS predicted, {sql_letter('gold', 'choices')} AS
  gold_letter FROM (SELECT i.item_id, i.task, i.gold, [c1, c2, c3, c4] AS choices,
    CASE i.item_id % 4 WHEN 0 THEN i.c1 WHEN 1 THEN '(B)' WHEN 2 THEN '4' ELSE i.input END AS response FROM items i)"""


def choice_responses(t):
    response = (
        F.when(F.col("item_id") % 4 == 0, F.col("c1"))
        .when(F.col("item_id") % 4 == 1, "(B)")
        .when(F.col("item_id") % 4 == 2, "4")
        .otherwise(F.col("input"))
    )
    return t.items.select("item_id", "task", response.alias("response"))


def choice_items(t):
    return t.items.select("item_id", "gold", F.array("c1", "c2", "c3", "c4").alias("choices"))


@query(
    "choice_resolution",
    f"""SELECT task, CASE WHEN regexp_matches(gold_letter, '^[A-Z]$') THEN gold_letter ELSE '-' END AS gold_letter,
        CASE WHEN regexp_matches(predicted, '^[A-Z]$') THEN predicted ELSE '-' END AS predicted, count(*) AS n
        FROM ({LETTERS}) GROUP BY ALL""",
)
def _(t):
    return ops.choice_resolution(choice_responses(t), choice_items(t), "item_id")


_GENERATIONS = r"""SELECT page_id, concat('import os', chr(10), 'from math import pi', chr(10), 'def solve(a):', chr(10),
    '    pass', chr(10)) AS prompt,
  CASE page_id % 4 WHEN 0 THEN concat('Here:', chr(10), '```python', chr(10), 'import os', chr(10), 'def solve(a):',
      chr(10), '    return ', cast(page_id AS varchar(20)), chr(10), '```', chr(10), html)
    WHEN 1 THEN concat('```py', chr(10), '    return a', chr(10), '```')
    WHEN 2 THEN concat('def solve (a):', chr(10), '    return 1  ', chr(10)) ELSE html END AS response,
  CASE WHEN page_id % 3 = 0 THEN concat('def check(f):', chr(10), '    assert f(1)') ELSE 'assert solve(1)' END AS test,
  CASE WHEN page_id % 5 = 0 THEN '' ELSE 'solve' END AS entry_point FROM {pages}"""


@query(
    "code_extraction",
    rf"""WITH g AS ({_GENERATIONS.format(pages='pages')}),
    c AS (SELECT *, regexp_matches(response, '(?s)```(?:python|py)?[ \t]*\r?\n(.*?)```') AS fenced,
      regexp_replace(CASE WHEN regexp_matches(response, '(?s)```(?:python|py)?[ \t]*\r?\n(.*?)```') THEN
        regexp_extract(response, '(?s)```(?:python|py)?[ \t]*\r?\n(.*?)```', 1) ELSE response END, '[ \t\r\n]+$', '') AS body
      FROM g),
    d AS (SELECT *, CASE WHEN entry_point <> '' AND NOT regexp_matches(body, '(?m)^[ \t]*def[ \t]+solve[ \t]*\(')
      THEN concat(regexp_replace(prompt, '\n+$', ''), chr(10), body) ELSE body END AS code FROM c)
    SELECT page_id, fenced, sha256(code) AS code_hash, sha256(concat(
      CASE WHEN entry_point <> '' THEN concat(
        CASE WHEN NOT contains(code, 'import os') THEN concat('import os', chr(10)) ELSE '' END,
        CASE WHEN NOT contains(code, 'from math import pi') THEN concat('from math import pi', chr(10)) ELSE '' END)
        ELSE '' END, code, chr(10), chr(10), test,
      CASE WHEN entry_point <> '' AND contains(test, 'def check(') THEN concat(chr(10), chr(10), 'check(solve)', chr(10))
        ELSE '' END)) AS program_hash FROM d""",
)
def _(t):
    rows = t.spark.sql(_GENERATIONS, pages=t.pages)
    programs = ops.code_extraction(rows.select("page_id", "response"), rows.drop("response"), "page_id")
    return programs.select(
        "page_id", "fenced", F.sha2("code", 256).alias("code_hash"), F.sha2("program", 256).alias("program_hash")
    )


def _clean_sql(x: str) -> str:
    a = rf"{sql_strip(rf'''regexp_replace(regexp_replace({sql_strip(x)}, '^- ', ''), '^\* ', '')''')}"
    b = sql_strip(rf"regexp_replace({a}, '^`+|`+$', '', 'g')")
    return (
        f"CASE WHEN starts_with(lower({b}), 'final answer') AND contains({b}, ':') "
        f"THEN {sql_strip(f'''regexp_replace({b}, '^[^:]*:', '')''')} ELSE {b} END"
    )


@query(
    "candidate_extraction",
    rf"""WITH p AS (SELECT task, {sql_strip(r"string_split_regex(" + sql_strip("response") +
        r", '(?is)(?:CRUX_ANSWER|final\s+answer|answer)\s*[:=]\s*')[-1]")} AS body FROM responses),
      l AS (SELECT task, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x: {_clean_sql('x')}),
        lambda x: x <> '')[1], '') AS candidate FROM p)
      SELECT task, count(*) AS responses, count(CASE WHEN candidate = '' THEN 1 END) AS empty,
        cast(sum(length(candidate)) AS bigint) AS characters FROM l GROUP BY task""",
)
def _(t):
    return ops.candidate_extraction(t.responses)


@query(
    "thinking_mode_rates",
    r"""WITH r AS (SELECT CASE conv_id % 5 WHEN 0 THEN concat('/no_think ', text) WHEN 1 THEN concat(text, chr(10),
          '/think') ELSE text END AS prompt, CASE WHEN turn % 3 = 1 THEN text ELSE ' ' END AS reasoning FROM conversations),
        q AS (SELECT CASE WHEN starts_with(prompt, '/no_think') OR contains(prompt, chr(10) || '/no_think') THEN 'disabled'
          WHEN starts_with(prompt, '/think') OR contains(prompt, chr(10) || '/think') THEN 'enabled' ELSE 'unspecified' END
          AS requested, trim(reasoning) <> '' AS has FROM r)
        SELECT requested, CASE WHEN has THEN 'enabled' WHEN requested = 'disabled' THEN 'disabled' ELSE 'unknown' END AS
          observed, count(*) AS n FROM q GROUP BY ALL""",
)
def _(t):
    prompt = (
        F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("/no_think "), F.col("text")))
        .when(F.col("conv_id") % 5 == 1, F.concat(F.col("text"), F.lit("\n/think")))
        .otherwise(F.col("text"))
    )
    reasoning = F.when(F.col("turn") % 3 == 1, F.col("text")).otherwise(" ")
    return ops.thinking_mode_rates(t.conversations.select(prompt.alias("prompt"), reasoning.alias("reasoning")))


_VALUE = "cast(cast(value AS decimal(10,2)) AS varchar(20))"
_LAYERS = f"""SELECT event_id AS run_id, 0 AS layer, CASE event_id % 4
    WHEN 0 THEN concat('Mean TTFT: ', {_VALUE}, ' ms', chr(10), 'Output token throughput (tok/s): ', {_VALUE})
    WHEN 1 THEN concat('prefill throughput = ', {_VALUE}, ' tok/s, peak GPU memory 21.5 GB')
    WHEN 2 THEN concat('12.5 output tokens/s', chr(10), 'decode throughput: ', {_VALUE}, ' tok/s') ELSE '' END AS text
  FROM {{events}} UNION ALL
  SELECT event_id, 1, concat('Total input tokens: ', cast(user_id + 1 AS varchar(20)), chr(10),
    'Output throughput: 7.25 tok/s', chr(10), 'total throughput 99 token/s') FROM {{events}}"""


@query(
    "log_metrics",
    f"""SELECT event_id AS run_id, CASE event_id % 4 WHEN 0 THEN coalesce(nullif(v, 0), 7.25) WHEN 2 THEN coalesce(nullif(v, 0), 7.25) ELSE 7.25 END
          AS tok_s_out,
        CASE WHEN event_id % 4 = 1 THEN nullif(v, 0) END AS tok_s_prefill, 99.0::double AS tok_s_total,
        CASE WHEN event_id % 4 = 0 THEN nullif(v, 0) END AS ttft_ms,
        CASE WHEN event_id % 4 = 1 THEN 21.5::double END AS peak_vram_gb, cast(user_id + 1 AS double) AS prompt_tokens
        FROM (SELECT *, cast(cast(value AS decimal(10,2)) AS double) AS v FROM events)""",
)
def _(t):
    rows = ops.log_metrics(t.spark.sql(_LAYERS, events=spread(t.events)))
    names = ["tok_s_out", "tok_s_prefill", "tok_s_total", "ttft_ms", "peak_vram_gb", "prompt_tokens"]
    return rows.select("run_id", *names)


_TABLE_TEXT = """SELECT event_id AS run_id, concat('| model | test | t/s |', chr(10), '| m | pp',
    cast(user_id + 1 AS varchar(20)), ' | ', {v}, ' ± 1.25 |', chr(10), '| m | tg', cast(event_id % 128 AS varchar(20)),
    ' @ d', cast(event_id % 3 * 1000 AS varchar(20)), ' | note | ', {v}, ' |', chr(10), '| m | tg 64 | 3.5 |') AS text
  FROM {{events}}""".format(v=_VALUE)


@query(
    "bench_table_metrics",
    """SELECT event_id AS run_id, nullif(v, 0) AS tok_s_prefill, CASE WHEN v > 0 THEN v ELSE 3.5 END AS tok_s_out,
       cast(user_id + 1 AS double) AS prompt_tokens,
       CASE WHEN event_id % 128 > 0 THEN cast(event_id % 128 AS double) ELSE 64 END AS output_tokens,
       nullif(cast(event_id % 3 * 1000 AS double), 0) AS prefill_tokens
       FROM (SELECT *, cast(cast(value AS decimal(10,2)) AS double) AS v FROM events)""",
)
def _(t):
    return ops.bench_table_metrics(t.spark.sql(_TABLE_TEXT, events=spread(t.events)), "run_id")


@query(
    "bench_json_metrics",
    f"""SELECT event_id AS run_id, CASE WHEN even THEN nullif(v, 0) END AS tok_s_prefill,
        CASE WHEN even THEN 45.5 ELSE {r1('(64 * 2 / (nullif(lat, 0) / 1000))')} END AS tok_s_out,
        CASE WHEN NOT even THEN {r1('((user_id + 64) * 2 / (nullif(lat, 0) / 1000))')} END AS tok_s_total,
        CASE WHEN even THEN CASE WHEN v > 0 THEN 512.0 END ELSE nullif(cast(user_id AS double), 0) END AS prompt_tokens,
        CASE WHEN even THEN 128.0::double ELSE 64.0 END AS output_tokens,
        CASE WHEN even AND v > 0 THEN nullif(cast(event_id % 7 AS double), 0) END AS prefill_tokens,
        CASE WHEN NOT even THEN nullif(cast(user_id AS double), 0) END AS context_tokens,
        CASE WHEN NOT even THEN nullif(lat, 0) END AS latency_ms
        FROM (SELECT *, event_id % 2 = 0 AS even, cast(cast(value AS decimal(10,2)) AS double) AS v,
          {r1('(cast(cast(value AS decimal(10,2)) AS double) * 1000)')} AS lat FROM events)""",
)
def _(t):
    return ops.bench_json_metrics(_json_texts(t), "run_id")


def _json_texts(t):
    v = F.col("value").cast("decimal(10,2)").cast("string")
    rows = F.concat(
        F.lit('log [{"n_prompt": 512, "n_gen": 0, "n_depth": '),
        (F.col("event_id") % 7).cast("string"),
        F.lit(', "avg_ts": '),
        v,
        F.lit('}, {"n_prompt": 0, "n_gen": "128", "avg_ts": "45.5"}] done'),
    )
    timed = F.concat(
        F.lit('{"input_len": '),
        F.col("user_id").cast("string"),
        F.lit(', "output_len": 64, "batch_size": 2, "avg_latency": '),
        v,
        F.lit("}"),
    )
    return spread(t.events).select(
        F.col("event_id").alias("run_id"), F.when(F.col("event_id") % 2 == 0, rows).otherwise(timed).alias("text")
    )


def _alias_documents(t):
    """Event properties below a result document with metrics at several depths."""
    deep = F.concat(
        F.lit('{"meta": {"tok_s_out": '),
        F.col("value").cast("decimal(10,2)").cast("string"),
        F.lit(', "x": [{"mean_ttft_ms": "'),
        (F.col("event_id") % 5).cast("string"),
        F.lit('"}]}, "zz": '),
        F.col("props"),
        F.lit(', "Output-Throughput": '),
        F.when(F.col("event_id") % 3 == 0, "null").otherwise((F.col("event_id") % 10).cast("string")),
        F.lit(', "list": []}'),
    )
    return spread(t.events).select("event_id", deep.alias("doc"))


@query(
    "metric_by_alias",
    """SELECT event_id, CASE WHEN event_id % 3 <> 0 AND event_id % 10 > 0 THEN cast(event_id % 10 AS double)
         ELSE nullif(cast(cast(value AS decimal(10,2)) AS double), 0) END AS tok_s_out,
       nullif(cast(event_id % 5 AS double), 0) AS ttft_ms, nullif(json_extract(props, '$.k')::double, 0) AS k FROM events""",
)
def _(t):
    wanted = {"tok_s_out": ops.METRIC_ALIASES["tok_s_out"], "ttft_ms": ops.METRIC_ALIASES["ttft_ms"], "k": ["k"]}
    return ops.metric_by_alias(_alias_documents(t), "event_id", "doc", wanted)


@query(
    "flatten_document",
    """SELECT event_id, u.field AS field, u.value AS value FROM (SELECT event_id, unnest([
         {'field': 'Output-Throughput', 'value': CASE WHEN event_id % 3 = 0 THEN 'null' ELSE cast(event_id % 10 AS varchar) END},
         {'field': 'list', 'value': '[]'},
         {'field': 'meta.tok_s_out', 'value': CASE WHEN value = floor(value) THEN cast(cast(value AS bigint) AS varchar)
            ELSE rtrim(cast(cast(value AS decimal(10,2)) AS varchar), '0') END},
         {'field': 'meta.x[0].mean_ttft_ms', 'value': cast(event_id % 5 AS varchar)},
         {'field': 'zz.k', 'value': json_extract_string(props, '$.k')}]) AS u FROM events)""",
)
def _(t):
    from benchloom.operators.inventory import flatten_documents

    return flatten_documents(_alias_documents(t), "event_id", "doc").select("event_id", "field", "value")


@query(
    "prometheus_rollup",
    """SELECT o_orderkey AS scrape, sum(cast(o_custkey AS double)) + 0.5 * count(*) AS draft_tokens,
         sum(cast(o_custkey AS double)) AS accepted_tokens, cast(NULL AS double) AS draft_acceptance_rate,
         CASE WHEN o_orderkey % 2 = 0 THEN 2.5::double END AS accept_length, cast(NULL AS double) AS accept_rate
       FROM orders GROUP BY o_orderkey""",
)
def _(t):
    c = F.col("o_custkey").cast("string")
    page = F.array(
        F.lit("# HELP vllm:spec_decode_num_draft_tokens_total drafted"),
        F.concat(F.lit('vllm:spec_decode_num_draft_tokens_total{model="a b",x="{1}"} '), c),
        F.lit('vllm:spec_decode_num_draft_tokens_total{model="c"} 0.5 1700000000'),
        F.concat(F.lit("vllm:spec_decode_num_accepted_tokens_total "), c),
        F.when(F.col("o_orderkey") % 2 == 0, "sglang:spec_accept_length 2.5").otherwise("other_series 3"),
        F.lit(""),
    )
    lines = t.orders.select(F.col("o_orderkey").alias("scrape"), F.explode(page).alias("line"))
    return ops.prometheus_rollup(lines, "scrape")


@query(
    "artifact_naming",
    r"""WITH n AS (SELECT bytes, regexp_replace(regexp_replace(regexp_replace(file, '\.[^.]*$', ''),
          '(?i)-\d{5}-of-\d{5}$', ''), '(?i)(?:-(?:(?:IQ|Q)[0-9][A-Z0-9_]*|(?:(?:NV|MX)FP|BF|F|FP)[0-9]+|ud|gguf|imat|imatrix))+$',
          '') AS model, coalesce(upper(regexp_extract_all(regexp_replace(file, '\.[^.]*$', ''),
          '(?i)(?:^|[-_.])((?:IQ|Q)[0-9][A-Z0-9_]*|(?:(?:NV|MX)FP|BF|F|FP)[0-9]+)(?:[-_.]|$)', 1)[-1]), '') AS quantization
          FROM files)
        SELECT model, quantization, count(*) AS files, cast(sum(bytes) AS bigint) AS bytes, true AS repository_name
        FROM n GROUP BY model, quantization""",
)
def _(t):
    return ops.artifact_naming(t.files)


@query(
    "name_canonicalization",
    """WITH r AS (SELECT CASE event_id % 6 WHEN 0 THEN 'Llama-Bench' WHEN 1 THEN ' vllm serve' WHEN 2 THEN 'SGL' WHEN 3 THEN
         'actual e' WHEN 4 THEN event_type ELSE 'zml' END AS raw FROM events)
       SELECT raw, CASE raw WHEN 'Llama-Bench' THEN 'llama.cpp' WHEN ' vllm serve' THEN 'vllm' WHEN 'SGL' THEN 'sglang'
         WHEN 'actual e' THEN 'e' WHEN 'zml' THEN 'llmd' ELSE raw END AS canonical,
         raw IN ('Llama-Bench', ' vllm serve', 'SGL', 'actual e', 'zml') AS known, count(*) AS n FROM r GROUP BY raw""",
)
def _(t):
    pick = F.col("event_id") % 6
    raw = (
        F.when(pick == 0, "Llama-Bench")
        .when(pick == 1, " vllm serve")
        .when(pick == 2, "SGL")
        .when(pick == 3, "actual e")
        .when(pick == 4, F.col("event_type"))
        .otherwise("zml")
    )
    return ops.name_canonicalization(t.events.select(raw.alias("raw")), "raw")


def _commands(t):
    k = F.col("o_orderkey")
    command = F.concat(
        F.lit("vllm serve org/m --max-num-seqs="),
        (k % 64).cast("string"),
        F.when(k % 3 == 0, F.lit(" -np 4")).otherwise(F.lit(" --parallel 8 --parallel 9")),
        F.when(k % 4 == 0, F.lit(" --spec-type draft-mtp --spec-draft-n-max 3"))
        .when(k % 4 == 1, F.lit(' --model-draft "org/d flash2" --spec-type dflash'))
        .otherwise(F.lit(" --api_key abc --tensor-parallel-size 2")),
    )
    option = F.when(k % 5 == 0, F.lit(32).cast("bigint"))
    return t.orders.select("o_orderkey", command.alias("command"), option.alias("concurrency"))


@query(
    "command_flag_table",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 32 WHEN o_orderkey % 3 = 0 THEN 4 ELSE 8 END::bigint AS
         concurrency, CASE WHEN o_orderkey % 3 = 0 THEN 4 ELSE 8 END::bigint AS num_parallel,
         nullif(o_orderkey % 64, 0)::bigint AS max_running_seqs,
         CASE WHEN o_orderkey % 4 = 0 THEN 3 END::bigint AS spec_num_tokens, NULL::bigint AS spec_draft_window,
         CASE o_orderkey % 4 WHEN 0 THEN 'MTP' WHEN 1 THEN 'DFlash' END AS spec_method,
         CASE WHEN o_orderkey % 4 = 1 THEN 'org/d flash2' END AS spec_draft_model,
         o_orderkey % 4 < 2 AS spec_decoding, o_orderkey % 4 = 0 AS mtp_enabled FROM orders""",
)
def _(t):
    return ops.command_flag_table(_commands(t), "o_orderkey", options=["concurrency"])


@query(
    "command_flag_rows",
    """SELECT o_orderkey, u.f AS flag, u.v AS value FROM (SELECT o_orderkey, unnest(list_filter([
         {'f': 'max-num-seqs', 'v': cast(o_orderkey % 64 AS varchar)},
         CASE WHEN o_orderkey % 3 <> 0 THEN {'f': 'parallel', 'v': '8'} END,
         CASE WHEN o_orderkey % 4 = 0 THEN {'f': 'spec-type', 'v': 'draft-mtp'} END,
         CASE WHEN o_orderkey % 4 = 0 THEN {'f': 'spec-draft-n-max', 'v': '3'} END,
         CASE WHEN o_orderkey % 4 = 1 THEN {'f': 'model-draft', 'v': '"org/d'} END,
         CASE WHEN o_orderkey % 4 = 1 THEN {'f': 'spec-type', 'v': 'dflash'} END,
         CASE WHEN o_orderkey % 4 > 1 THEN {'f': 'api-key', 'v': 'abc'} END,
         CASE WHEN o_orderkey % 4 > 1 THEN {'f': 'tensor-parallel-size', 'v': '2'} END], lambda x: x IS NOT NULL)) AS u
         FROM orders)""",
)
def _(t):
    return ops.command_flags(_commands(t), "o_orderkey")


@query(
    "device_rollup",
    f"""WITH s AS (SELECT s_suppkey, s_nationkey, floor(abs(s_acctbal)) AS mb FROM supplier)
        SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 2 ELSE 1 END::bigint AS cards,
          CASE WHEN s_suppkey % 2 = 0 THEN concat('GPU ', s_nationkey, ' + GPU B') ELSE concat('GPU ', s_nationkey) END AS names,
          {r1('(mb / 1024)')} AS vram_gb,
          CASE WHEN mb + CASE WHEN s_suppkey % 2 = 0 THEN 24564 ELSE 0 END > 0 THEN
            {r1('((mb + CASE WHEN s_suppkey % 2 = 0 THEN 24564 ELSE 0 END) / 1024)')} END AS total_vram_gb FROM s""",
)
def _(t):
    listing = F.concat(
        F.lit("\n GPU "),
        F.col("s_nationkey").cast("string"),
        F.lit(", "),
        F.floor(F.abs("s_acctbal")).cast("string"),
        F.when(F.col("s_suppkey") % 2 == 0, F.lit("\nGPU B, 24564\nnonsense\n")).otherwise(F.lit("\n\n")),
    )
    return ops.device_rollup(t.supplier.select("s_suppkey", listing.alias("listing")), "s_suppkey")


_COSTS = """SELECT l_orderkey, concat('RTX|used|', CASE WHEN l_partkey % 7 = 0 THEN 'x' WHEN l_partkey % 7 = 1 THEN '1970'
    WHEN l_partkey % 7 = 2 THEN '' ELSE '2021' END, '|', cast(l_linenumber * 100 AS varchar(20)), '|',
    CASE l_suppkey % 3 WHEN 0 THEN 'usd' WHEN 1 THEN 'EUR' ELSE 'US' END, '; CPU | NEW | 2024 | ',
    cast(l_linenumber - 3 AS varchar(20)), ' | usd; bad|entry') AS costs FROM {lineitem}"""


@query(
    "cost_rollup",
    """SELECT l_orderkey, currency, count(*) AS entries, sum(price) AS price FROM (
         SELECT l_orderkey, CASE l_suppkey % 3 WHEN 0 THEN 'USD' ELSE 'EUR' END AS currency,
           cast(l_linenumber * 100 AS double) AS price FROM lineitem WHERE l_suppkey % 3 < 2 AND l_partkey % 7 > 1
         UNION ALL SELECT l_orderkey, 'USD', cast(l_linenumber - 3 AS double) FROM lineitem WHERE l_linenumber > 3)
       GROUP BY ALL""",
)
def _(t):
    return ops.cost_rollup(t.spark.sql(_COSTS, lineitem=t.lineitem), "l_orderkey")


@query(
    "cost_rejects",
    """SELECT reason, count(*) AS n FROM (
         SELECT CASE WHEN l_partkey % 7 = 0 THEN 'year is not an integer' WHEN l_suppkey % 3 = 2 THEN
           'currency must be a 3-letter ISO code' WHEN l_partkey % 7 = 1 THEN 'year must be from 1980 through this year' END
           AS reason FROM lineitem
         UNION ALL SELECT CASE WHEN l_linenumber <= 3 THEN 'price must be a positive number' END FROM lineitem
         UNION ALL SELECT 'must have 5 pipe-separated fields' FROM lineitem) WHERE reason IS NOT NULL GROUP BY reason""",
)
def _(t):
    entries = ops.cost_entries(t.spark.sql(_COSTS, lineitem=t.lineitem), "l_orderkey")
    return entries.where(F.col("reason").isNotNull()).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
