"""Stand-in record sets over the given tables, as SQL both engines understand."""

from __future__ import annotations

import re

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

# Tables of texts, where the work is in the row; in the test data each is one file.
LARGE = ["documents", "pages", "conversations"]

# name: (tables or record sets it reads, SQL)
FIXTURES: dict[str, tuple[list[str], str]] = {
    # One record per measured run.
    "runs": (
        ["events"],
        """SELECT event_id AS run_id, concat('runs/', cast(event_id as varchar(20)), '.json') AS path, ts AS updated_at,
           concat('org/model-', cast(user_id % 10 as varchar(20))) AS hf_id,
           CASE user_id % 3 WHEN 0 THEN 'vllm' WHEN 1 THEN 'llama.cpp' ELSE 'sglang' END AS engine,
           CASE event_id % 2 WHEN 0 THEN 'remote' ELSE 'local' END AS mode,
           event_type AS quantization,
           CASE WHEN event_id % 4 = 0 THEN 'kvcache' ELSE 'speed' END AS kind,
           concat('GPU ', cast(user_id % 5 as varchar(20)), ' 24GB') AS hardware,
           CASE WHEN event_id % 11 = 0 THEN 0.0 ELSE value END AS tok_s_out,
           cast(event_id % 997 as double) * 0.5 AS ttft_ms,
           value * 20 AS tok_s_prefill, value * 5 AS tok_s_total,
           user_id, props FROM {events}""",
    ),
    # Graded questions.
    "results": (
        ["labels", "documents"],
        """SELECT l.doc_id AS question_id, d.lang AS task, d.source AS model,
           cast(l.doc_id % 12 + 1 as int) AS shard, l.quality = 1 AS pass, l.toxic = 0 AS scored,
           d.n_chars AS latency_ms FROM {labels} l JOIN {documents} d ON l.doc_id = d.doc_id""",
    ),
    # Samples per item; (l_orderkey, l_linenumber) repeats, so rows are numbered.
    "samples": (
        ["lineitem"],
        """SELECT l_orderkey AS item, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey,
           l_suppkey, l_extendedprice, l_shipdate) - 1 AS sample, l_returnflag = 'R' AS passed,
           l_linestatus = 'O' AS graded FROM {lineitem}""",
    ),
    # Billed requests.
    "usage_ev": (
        ["lineitem", "orders"],
        """SELECT l.l_suppkey AS listing, o.o_custkey AS renter, l.l_shipdate AS sold_at,
           concat('model-', cast(l.l_partkey % 7 as varchar(20))) AS model,
           cast(l.l_quantity * 100 as bigint) AS prompt_tokens,
           cast(floor(l.l_quantity * 100 * l.l_discount) as bigint) AS cached_tokens,
           cast(floor(l.l_extendedprice) as bigint) AS output_tokens
           FROM {lineitem} l JOIN {orders} o ON l.l_orderkey = o.o_orderkey""",
    ),
    "responses": (
        ["documents"],
        """SELECT doc_id AS question_id, source AS model, lang AS task, concat(text, CASE doc_id % 8
           WHEN 0 THEN concat(chr(10), 'Final answer: $1,234.50')
           WHEN 1 THEN concat(chr(10), 'Steps: **12**', chr(10), 'So the total is **Sum: 3** then **', cast(doc_id as
             varchar(20)), '** of 9')
           WHEN 2 THEN concat(' and 3 + 4 = ', cast(doc_id % 50 as varchar(20)), '.')
           WHEN 3 THEN concat(chr(10), '**Heading: 5**', chr(10), '**about -17%**', chr(10))
           WHEN 4 THEN concat(chr(10), '#### ', cast(doc_id % 9 as varchar(20)), ' apples')
           ELSE '' END) AS response FROM {documents}""",
    ),
    # Benchmark items with four choices and a gold answer that is a letter, an index, a choice text or wrong.
    "items": (
        ["documents"],
        """SELECT doc_id AS item_id, lang AS task, text AS input, source AS c1, concat('src', cast(n_chars % 20 as
           varchar(20))) AS c2, lang AS c3, concat('Choice ', cast(doc_id % 3 as varchar(20))) AS c4,
           CASE doc_id % 6 WHEN 0 THEN 'a' WHEN 1 THEN '3' WHEN 2 THEN source WHEN 3 THEN 'E' WHEN 4 THEN
           substr(text, 5, 9) ELSE concat('choice ', cast(doc_id % 3 as varchar(20))) END AS gold FROM {documents}""",
    ),
    "traces": (
        ["conversations"],
        """SELECT conv_id AS id, turn AS seq, role, text AS content, conv_id % 3 <> 0 AS passed,
           conv_id % 7 <> 0 AS scored FROM {conversations}""",
    ),
    # Weight files of model repositories.
    "files": (
        ["part"],
        """SELECT p_partkey AS file_id, concat('org', cast(p_size as varchar(20))) AS owner,
           concat(replace(p_name, ' ', '-'), CASE p_partkey % 4 WHEN 0 THEN '-Q4_K_M' WHEN 1 THEN '-UD-IQ4_NL'
           WHEN 2 THEN '-bf16' ELSE '-Instruct' END, CASE WHEN p_partkey % 5 = 0 THEN '-00001-of-00003' ELSE '' END,
           '.gguf') AS file, cast(floor(p_retailprice * 1000) as bigint) AS bytes, p_brand AS brand FROM {part}""",
    ),
}


def _uses(sql: str) -> list[str]:
    return [n for n in FIXTURES if re.search(rf"(?i)\b(?:from|join)\s+{n}\b", sql)]


def with_fixtures(sql: str) -> str:
    """Put the record sets a statement uses in front of it."""
    wanted: list[str] = []

    def add(name: str) -> None:
        if name in FIXTURES and name not in wanted:
            for need in FIXTURES[name][0]:
                add(need)
            wanted.append(name)

    for name in _uses(sql):
        add(name)
    if not wanted:
        return sql.strip()
    parts = [f"{n} AS ({FIXTURES[n][1].format(**{t: t for t in FIXTURES[n][0]})})" for n in wanted]
    body = sql.strip()
    if body.lower().startswith("with "):
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
