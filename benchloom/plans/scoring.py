"""Scoring over documents, labels, line items, conversations and embeddings."""

from pyspark.sql import functions as F

from benchloom.functions.answers import rendered_prompt
from benchloom.functions.numbers import round4
from benchloom.operators import scoring as ops
from benchloom.plans.extraction import LETTERS, RULED, choice_items, choice_responses, sql_plain, sql_strip
from benchloom.plans.registry import query, r4


def sql_match(a: str, g: str) -> str:
    def num(x):
        return rf"regexp_replace(translate({sql_strip(x)}, '$,% ', ''), '\.$', '')"

    return (
        f"(({sql_plain(a)} = {sql_plain(g)}) OR ({num(a)} <> '' AND {num(a)} = {num(g)}) OR "
        f"coalesce(abs(try_cast({num(a)} AS double) - try_cast({num(g)} AS double)) < 1e-9, false))"
    )


_GOLD = """CASE question_id % 8 WHEN 0 THEN '1234.5' WHEN 1 THEN cast(question_id AS varchar(20)) WHEN 2 THEN
  concat('$', cast(question_id % 50 AS varchar(20))) WHEN 3 THEN '-17.0' ELSE '4' END"""


def _gold():
    q = F.col("question_id")
    return (
        F.when(q % 8 == 0, "1234.5")
        .when(q % 8 == 1, q.cast("string"))
        .when(q % 8 == 2, F.concat(F.lit("$"), (q % 50).cast("string")))
        .when(q % 8 == 3, "-17.0")
        .otherwise("4")
    )


@query("score_exact", f"SELECT question_id, {sql_match('final_answer', '(' + _GOLD + ')')} AS pass FROM ({RULED})")
def _(t):
    return ops.score_exact(t.responses.withColumn("gold", _gold())).select("question_id", "pass")


@query(
    "score_choice",
    f"""SELECT item_id, CASE WHEN regexp_matches(predicted, '^[A-Z]$') THEN predicted ELSE '-' END AS predicted,
        gold_letter, predicted <> '' AND predicted = gold_letter AS pass FROM ({LETTERS})""",
)
def _(t):
    rows = choice_responses(t).join(choice_items(t), "item_id")
    scored = ops.score_choice(rows)
    letter = F.when(F.col("predicted").rlike("^[A-Z]$"), F.col("predicted")).otherwise("-")
    return scored.select("item_id", letter.alias("predicted"), "gold_letter", "pass")


_TOKENS = rf"""SELECT doc_id, unnest(string_split_regex(x, '\s+')) AS w FROM (SELECT doc_id, {sql_plain('text')} AS x FROM
  documents) WHERE x <> ''"""
_GOLDS = rf"""SELECT doc_id, unnest(string_split_regex(x, '\s+')) AS w FROM (SELECT d.doc_id, {sql_plain('b.text')} AS x FROM
  documents d JOIN benchmark b ON b.item_id = d.doc_id % 40) WHERE x <> ''"""


@query(
    "score_f1",
    f"""WITH p AS (SELECT doc_id, w, count(*) AS n FROM ({_TOKENS}) GROUP BY ALL),
        g AS (SELECT doc_id, w, count(*) AS n FROM ({_GOLDS}) GROUP BY ALL),
        c AS (SELECT p.doc_id, sum(least(p.n, g.n)) AS shared FROM p JOIN g USING (doc_id, w) GROUP BY 1),
        np AS (SELECT doc_id, sum(n) AS n FROM p GROUP BY 1), ng AS (SELECT doc_id, sum(n) AS n FROM g GROUP BY 1)
        SELECT d.doc_id, {r4('coalesce(2.0 * c.shared / (np.n + ng.n), 0)')} AS f1 FROM documents d
        LEFT JOIN c USING (doc_id) LEFT JOIN np USING (doc_id) LEFT JOIN ng USING (doc_id)""",
)
def _(t):
    docs = t.documents.select("doc_id", F.col("text").alias("response"), (F.col("doc_id") % 40).alias("item_id"))
    # Every document meets one benchmark item; the benchmark is the small side of the join.
    rows = docs.join(t.benchmark.select("item_id", F.col("text").alias("gold")), "item_id")
    return ops.token_f1(rows).select("doc_id", round4(F.col("f1")).alias("f1"))


@query(
    "score_loglikelihood",
    """WITH p AS (SELECT vec_id, label, list_transform([0, 1, 2, 3], lambda i: list_sum(list_transform(
         embedding[16*i+3:16*i+16], lambda x: x::double)) / (7 + i)) AS s FROM embeddings)
       SELECT vec_id, chr(64 + cast(list_position(s, list_max(s)) AS int)) AS predicted,
         chr(65 + cast(label % 4 AS int)) AS gold_letter,
         list_position(s, list_max(s)) = label % 4 + 1 AS pass FROM p""",
)
def _(t):
    def choice(i):
        return F.struct(
            F.slice("embedding", 16 * i + 1, 16).cast("array<double>").alias("logprobs"),
            F.sequence(F.lit(0), F.lit(75), F.lit(5)).alias("offsets"),
        )

    items = t.embeddings.select(
        "vec_id",
        F.lit(10).alias("context_bytes"),
        F.array(*[choice(i) for i in range(4)]).alias("scored"),
        F.array(F.lit("choice"), F.lit(" choices"), F.lit("a choice"), F.lit("choice no")).alias("choices"),
        F.char(F.lit(65) + F.col("label") % 4).alias("gold"),
    )
    return ops.score_loglikelihood(items).select("vec_id", "predicted", "gold_letter", "pass")


@query(
    "score_judge",
    f"""WITH s AS (SELECT user_id, CASE event_id % 4 WHEN 0 THEN (event_id % 11) / 10.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.5
          ELSE CASE WHEN event_id % 8 = 7 THEN 0.0 END END AS score FROM events)
        SELECT user_id, count(*) AS replies, count(CASE WHEN score IS NULL THEN 1 END) AS failures,
          {r4('(sum(coalesce(score, 0)) / count(*))')} AS score FROM s GROUP BY user_id""",
)
def _(t):
    k = F.col("event_id")
    reply = (
        F.when(
            k % 4 == 0,
            F.concat(
                F.lit('Verdict: {"score": '), ((k % 11) / 10).cast("string"), F.lit(', "rationale": "ok"} done')
            ),
        )
        .when(k % 4 == 1, "I give it a Score: 1 of 1")
        .when(k % 4 == 2, '{"score": 7} but rather 0.5')
        .when(k % 8 == 3, "no number here")
        .otherwise('{"score": "0.8", "rationale": "step 1 fine"}')
    )
    return ops.score_judge(t.events.select("user_id", reply.alias("reply")), "user_id")


@query(
    "agent_rewards",
    """SELECT event_id, CASE event_id % 3 WHEN 0 THEN cast(value AS double) WHEN 1 THEN 0.25 END AS reward FROM events""",
)
def _(t):
    text = (
        F.when(F.col("event_id") % 3 == 0, F.concat(F.lit('{"reward": '), F.col("value").cast("string"), F.lit("}")))
        .when(F.col("event_id") % 3 == 1, " 0.25\n")
        .otherwise("failed")
    )
    return ops.agent_rewards(t.events.select("event_id", text.alias("reward_text")), "event_id")


@query(
    "score_items",
    f"""WITH base AS (SELECT i.item_id, CASE WHEN i.item_id % 13 = 0 THEN NULL ELSE i.item_id END AS question_id,
          CASE WHEN i.item_id % 17 = 0 THEN NULL WHEN i.item_id % 2 = 0 THEN i.gold ELSE
            CASE WHEN i.item_id % 8 = 1 THEN cast(i.item_id AS varchar) ELSE '-17' END END AS gold, i.item_id % 2 = 0 AS ch,
          i.input FROM items i),
        q AS (SELECT b.*, CASE WHEN b.question_id IS NULL THEN 'row is missing question_id' WHEN b.gold IS NULL THEN
          'row is missing gold answer for local scoring' END AS error, l.predicted AS pl, l.gold_letter AS gl,
          r.final_answer AS fa, x.c1, x.c2, x.c3, x.c4 FROM base b JOIN ({LETTERS}) l ON l.item_id = b.item_id
          JOIN ({RULED}) r ON r.question_id = b.item_id JOIN items x ON x.item_id = b.item_id)
        SELECT item_id, error, error IS NULL AS scored,
          CASE WHEN error IS NOT NULL THEN false WHEN ch THEN pl <> '' AND pl = gl ELSE {sql_match('fa', 'gold')} END AS pass,
          sha256({sql_strip('''CASE WHEN ch THEN concat('Answer the question. Reply with only the letter of the correct choice.',
            chr(10), chr(10), input, chr(10), chr(10), 'A. ', c1, chr(10), 'B. ', c2, chr(10), 'C. ', c3, chr(10), 'D. ', c4)
            ELSE concat('Solve the problem. Show your reasoning step by step, then end your reply with a line in the form ',
            chr(39), 'Final answer: <number>', chr(39), '.', chr(10), chr(10), input) END''')}) AS prompt_hash FROM q""",
)
def _(t):
    k = F.col("item_id")
    choice = choice_responses(t).select("item_id", F.col("response").alias("_choice"))
    free = t.responses.select(F.col("question_id").alias("item_id"), F.col("response").alias("_free"))
    rows = t.items.join(choice, "item_id").join(free, "item_id")
    gold = F.when(
        k % 17 != 0,
        F.when(k % 2 == 0, F.col("gold")).otherwise(F.when(k % 8 == 1, k.cast("string")).otherwise("-17")),
    )
    rows = rows.select(
        "item_id",
        F.when(k % 13 != 0, k).alias("question_id"),
        gold.alias("gold"),
        F.when(k % 2 == 0, F.array("c1", "c2", "c3", "c4")).alias("choices"),
        "input",
        F.when(k % 2 == 0, F.col("_choice")).otherwise(F.col("_free")).alias("response"),
    )
    return ops.score_items(rows).select("item_id", "error", "scored", "pass", "prompt_hash")


@query(
    "render_prompt",
    f"""SELECT item_id, sha256({sql_strip('''CASE WHEN item_id % 3 = 0 THEN concat('Q: ', input, ' G: ', chr(10), '{{choices}}')
         ELSE concat('Q: ', input, ' G: ', chr(10), 'A. ', c1, chr(10), 'B. ', c2) END''')}) AS prompt_hash FROM items""",
)
def _(t):
    choices = F.when(F.col("item_id") % 3 != 0, F.array("c1", "c2"))
    prompt = rendered_prompt(F.lit(" Q: {{input}} G: {{gold}}\n{{choices}}\n"), F.col("input"), choices)
    return t.items.select("item_id", F.sha2(prompt, 256).alias("prompt_hash"))


@query(
    "harness_score",
    """SELECT o_orderkey, CASE o_orderkey % 5 WHEN 0 THEN 'acc_norm,none' WHEN 1 THEN 'exact_match' WHEN 2 THEN 'bleu'
         WHEN 3 THEN 'my_metric' END AS metric,
       CASE o_orderkey % 5 WHEN 0 THEN (o_orderkey % 100) / 100.0 WHEN 1 THEN 0.5 WHEN 2 THEN 0.31 WHEN 3 THEN 0.0 END AS
         score FROM orders""",
)
def _(t):
    k = F.col("o_orderkey")
    text = (
        F.when(
            k % 5 == 0,
            F.concat(
                F.lit('{"acc,none": 0.9, "acc_stderr,none": 0.01, "acc_norm,none": '),
                ((k % 100) / 100).cast("string"),
                F.lit("}"),
            ),
        )
        .when(k % 5 == 1, '{"acc": "0.7", "alias": "t", "exact_match": 0.5, "acc_norm,none": 1.5}')
        .when(k % 5 == 2, '{"alias": "t", "bleu": 31, "a_stderr": 0.1}')
        .when(k % 5 == 3, '{"z": -1, "zz_metric": 0.4, "my_metric": 0}')
        .otherwise('{"a_stderr": 0.2, "big": 42}')
    )
    return ops.harness_score(t.orders.select("o_orderkey", text.alias("metrics"))).select(
        "o_orderkey", "metric", "score"
    )


_SAMPLES = """SELECT item, sample, CASE WHEN item % 7 = 0 AND sample = 0 THEN 'timeout' END AS error FROM samples"""


@query(
    "join_grades",
    f"""SELECT g.item, g.sample::int AS sample, g.error, coalesce(v.passed, false) AND g.error IS NULL AS passed FROM ({_SAMPLES}) g
        LEFT JOIN (SELECT * FROM samples WHERE graded) v ON v.item = g.item AND v.sample = g.sample""",
)
def _(t):
    failed = F.when((F.col("item") % 7 == 0) & (F.col("sample") == 0), "timeout")
    generations = t.samples.select("item", "sample", failed.alias("error"))
    grades = t.samples.where("graded")
    return ops.join_grades(generations, grades, ["item", "sample"])


_PASS = """SELECT item, n, c, CASE WHEN n - c < least(2, n) THEN 1.0 WHEN n = 1 THEN 0.0 ELSE 1 - (n - c) * (n - c - 1) / (n * (n - 1.0)) END AS
  pass_at_k, c / n AS pass_at_1 FROM (SELECT item, count(*) AS n, count(CASE WHEN passed THEN 1 END) AS c FROM {s} GROUP BY item)"""


@query(
    "pass_at_k",
    f"""SELECT count(*) AS items, 2 AS k, {r4('avg(pass_at_k)')} AS pass_at_k, {r4('avg(pass_at_1)')} AS pass_at_1
        FROM ({_PASS.format(s='samples')})""",
)
def _(t):
    return ops.pass_at_k(t.samples, 2)


@query(
    "score_code",
    f"""WITH g AS (SELECT g.item, g.sample, coalesce(v.passed, false) AND g.error IS NULL AS passed FROM ({_SAMPLES}) g
          LEFT JOIN (SELECT * FROM samples WHERE graded) v ON v.item = g.item AND v.sample = g.sample)
        SELECT item, n, c, {r4('pass_at_k')} AS pass_at_k, {r4('pass_at_1')} AS pass_at_1
        FROM ({_PASS.format(s='g')})""",
)
def _(t):
    failed = F.when((F.col("item") % 7 == 0) & (F.col("sample") == 0), "timeout")
    generations = t.samples.select("item", "sample", failed.alias("error"))
    grades = t.samples.where("graded")
    graded = ops.join_grades(generations, grades, ["item", "sample"])
    rows = ops.pass_at_k_items(graded, 2)
    return rows.select("item", "n", "c", *[round4(F.col(c)).alias(c) for c in ("pass_at_k", "pass_at_1")])


@query(
    "score_candidate_exec",
    """SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'input_prediction' ELSE 'output_prediction' END AS task_type,
         count(*) AS items, count(CASE WHEN l_returnflag = 'R' AND l_orderkey % 5 <> 0 THEN 1 END) AS passed FROM lineitem GROUP BY 1""",
)
def _(t):
    from benchloom.operators.joins import candidate_task_type

    line = t.lineitem.select(
        F.concat(
            F.when(F.col("l_orderkey") % 2 == 0, "Set CRUXEval-I:").otherwise("CRUXEval-O:"), F.col("l_orderkey")
        ).alias("question_id"),
        F.when(F.col("l_orderkey") % 5 == 0, "empty candidate").alias("error"),
        (F.col("l_returnflag") == "R").alias("passed"),
    )
    return (
        line.withColumn("task_type", candidate_task_type(F.lit(""), F.col("question_id")))
        .groupBy("task_type")
        .agg(
            F.count(F.lit(1)).alias("items"),
            F.count_if(F.col("passed") & F.col("error").isNull()).alias("passed"),
        )
    )


@query(
    "generation_guard",
    f"""SELECT count(*) AS items, count(CASE WHEN error IS NOT NULL THEN 1 END) AS failures,
        count(*) > 0 AND count(CASE WHEN error IS NOT NULL THEN 1 END) > count(*) // 2 AS abort FROM ({_SAMPLES}) WHERE sample = 0""",
)
def _(t):
    failed = F.when((F.col("item") % 7 == 0) & (F.col("sample") == 0), "timeout")
    return ops.generation_guard(t.samples.select("item", "sample", failed.alias("error")))


@query(
    "shard_stats",
    f"""SELECT task, shard, count(CASE WHEN scored AND pass THEN 1 END) AS correct, count(CASE WHEN scored THEN 1 END) AS scored, count(CASE WHEN NOT scored THEN 1 END) AS errors,
        cast(sum(latency_ms) AS bigint) AS total_latency_ms,
        CASE WHEN count(CASE WHEN scored THEN 1 END) > 0 THEN {r4('(count(CASE WHEN scored AND pass THEN 1 END) / count(CASE WHEN scored THEN 1 END))')} ELSE 0 END AS accuracy,
        cast(sum(latency_ms) // count(*) AS bigint) AS avg_latency_ms FROM results GROUP BY task, shard""",
)
def _(t):
    return ops.shard_stats(t.results, ["task", "shard"])


_SCORES = "SELECT task, model, CASE WHEN scored THEN pass::int::double END AS score FROM results"


@query(
    "task_score",
    f"""SELECT task, count(*) AS samples, count(CASE WHEN score IS NULL THEN 1 END) AS failures,
        {r4('(sum(coalesce(score, 0)) / count(*))')} AS score FROM ({_SCORES}) GROUP BY task""",
)
def _(t):
    return ops.task_score(t.results.select("task", F.when(F.col("scored"), F.col("pass").cast("int")).cast("double").alias("score")))


@query(
    "suite_aggregate",
    f"""WITH k AS (SELECT model, task, CASE WHEN length(task) % 2 = 1 OR task = 'de' THEN NULL ELSE
          sum(coalesce(score, 0)) / count(*) END AS score FROM ({_SCORES}) GROUP BY model, task),
        w AS (SELECT model, score, CASE ascii(right(model, 1)) % 4 WHEN 0 THEN 'min' WHEN 1 THEN 'max' WHEN 2 THEN 'mean' ELSE
          'weighted' END AS aggregation, CASE task WHEN 'en' THEN 3.0 WHEN 'fr' THEN 1.0 ELSE 1.0 END AS w FROM k)
        SELECT model, min(aggregation) AS aggregation, count(score) AS tasks, {r4('''coalesce(CASE min(aggregation)
          WHEN 'min' THEN min(score) WHEN 'max' THEN max(score) WHEN 'mean' THEN avg(score) ELSE
          sum(score * w) / sum(w) FILTER (WHERE score IS NOT NULL) END, 0)''')} AS score FROM w GROUP BY model""",
)
def _(t):
    scores = t.results.groupBy("model", "task").agg(
        (F.sum(F.when(F.col("scored"), F.col("pass").cast("int")).otherwise(0)) / F.count(F.lit(1))).alias("score")
    )
    pick = F.ascii(F.right("model", F.lit(1))) % 4
    tasks = scores.select(
        "model",
        F.when(pick == 0, "min").when(pick == 1, "max").when(pick == 2, "mean").otherwise("weighted").alias("aggregation"),
        F.when(F.col("task") != "de", F.col("score")).alias("score"),
        F.when(F.col("task") == "en", 3.0).when(F.col("task") == "fr", 0.0).alias("weight"),
    )
    return ops.suite_aggregate(tasks, ["model"])


@query(
    "pooled_score",
    f"""WITH l AS (SELECT task, question_id // 2 AS q, arg_max(pass, question_id) AS pass, arg_max(scored, question_id) AS
          scored, arg_max(shard, question_id) AS shard FROM results GROUP BY ALL),
        a AS (SELECT task, count(*) AS questions, count(DISTINCT shard) AS shards_covered, count(CASE WHEN scored THEN 1 END)::double AS n,
          count(CASE WHEN scored AND pass THEN 1 END) / count(CASE WHEN scored THEN 1 END)::double AS p FROM l GROUP BY task)
        SELECT task, questions, shards_covered, {r4('p')} AS pooled_score,
          {r4('((p + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) - 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4 * n * n)) / (1 + 3.8414588206941236 / n))')} AS ci_lower,
          {r4('((p + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) + 1.959963984540054 * sqrt(p * (1 - p) / n + 3.8414588206941236 / (4 * n * n)) / (1 + 3.8414588206941236 / n))')} AS ci_upper FROM a""",
)
def _(t):
    rows = t.results.withColumn("q", F.expr("question_id div 2"))
    return ops.pooled_score(rows, ["task"], "q", "question_id")


@query(
    "sample_size",
    """SELECT lang, source, count(*) AS items, cast(least(count(*), ceil(384.1458820694124 / (1 + 383.1458820694124 / count(*))))
       AS bigint) AS recommended FROM documents GROUP BY lang, source""",
)
def _(t):
    return ops.sample_size(t.documents, ["lang", "source"])


@query(
    "few_shot_prefix",
    """WITH e AS (SELECT item_id, concat(text, chr(10), 'Your code should pass these tests:', chr(10), 'assert f(', item_id,
         ')', chr(10), 'assert g', chr(10), '```python', chr(10), 'def f(x): pass', chr(10), '```', chr(10), chr(10)) AS t
         FROM benchmark ORDER BY item_id LIMIT 3)
       SELECT sha256(concat('Here are examples of Python tasks and correct solutions.', chr(10), chr(10),
         string_agg(t, '' ORDER BY item_id))) AS prefix_hash FROM e""",
)
def _(t):
    return ops.few_shot_prefix(_examples(t), 3).select(F.sha2("prefix", 256).alias("prefix_hash"))


def _examples(t):
    return t.benchmark.select(
        F.col("item_id").alias("place"),
        "text",
        F.array(F.concat(F.lit("assert f("), F.col("item_id"), F.lit(")")), F.lit("assert g")).alias("tests"),
        F.lit("def f(x): pass\n").alias("code"),
    )


@query(
    "code_prompt",
    """WITH e AS (SELECT item_id, concat(text, chr(10), 'Your code should pass these tests:', chr(10), 'assert f(', item_id,
         ')', chr(10), 'assert g', chr(10), '```python', chr(10), 'def f(x): pass', chr(10), '```', chr(10), chr(10)) AS t
         FROM benchmark ORDER BY item_id LIMIT 3),
       p AS (SELECT concat('Here are examples of Python tasks and correct solutions.', chr(10), chr(10),
         string_agg(t, '' ORDER BY item_id)) AS prefix FROM e)
       SELECT page_id, sha256(CASE WHEN page_id % 2 = 0 THEN concat(prefix, 'Now complete this task. Reply with only the ',
         'implementation in a single ```python code block and no prose.', chr(10), chr(10), html) ELSE
         concat('Complete the following Python function. Reply with the complete implementation in a single ```python code ',
         'block and no prose.', chr(10), chr(10), html) END) AS prompt_hash FROM pages, p""",
)
def _(t):
    items = t.pages.select("page_id", F.col("html").alias("input"), (F.col("page_id") % 2 == 0).alias("few_shot"))
    rows = ops.code_prompt(items, ops.few_shot_prefix(_examples(t), 3))
    return rows.select("page_id", F.sha2("prompt", 256).alias("prompt_hash"))


@query(
    "agent_task_results",
    f"""WITH k AS (SELECT conv_id, conv_id % 3 <> 0 AS pass, conv_id % 7 <> 0 AS scored, count(CASE WHEN role = 'assistant' THEN 1 END) AS
          turns, sum(length(text)) AS wall, sum(CASE WHEN role = 'user' THEN strlen(text) ELSE 0 END) AS i,
          sum(CASE WHEN role = 'assistant' THEN strlen(text) ELSE 0 END) AS o FROM conversations GROUP BY conv_id)
        SELECT conv_id % 5 AS shard, count(*) AS tasks, count(CASE WHEN scored THEN 1 END) AS scored, count(CASE WHEN scored AND pass THEN 1 END) AS passed,
          cast(sum(turns) AS bigint) AS turns, cast(sum(i) AS bigint) AS input_tokens, cast(sum(o) AS bigint) AS output_tokens,
          {r4('(count(CASE WHEN scored AND pass THEN 1 END) / count(CASE WHEN scored THEN 1 END))')} AS accuracy, cast(sum(wall) // count(*) AS bigint) AS avg_wall_ms
        FROM k GROUP BY 1""",
)
def _(t):
    size = F.octet_length("text")
    tasks = t.conversations.groupBy("conv_id").agg(
        F.count_if(F.col("role") == "assistant").alias("turns"),
        F.sum(F.char_length("text")).alias("wall_time_ms"),
        F.sum(F.when(F.col("role") == "user", size).otherwise(0)).alias("input_tokens"),
        F.sum(F.when(F.col("role") == "assistant", size).otherwise(0)).alias("output_tokens"),
    )
    tasks = tasks.select(
        "*",
        (F.col("conv_id") % 5).alias("shard"),
        (F.col("conv_id") % 3 != 0).alias("pass"),
        (F.col("conv_id") % 7 != 0).alias("scored"),
    )
    return ops.agent_task_results(tasks, ["shard"])
