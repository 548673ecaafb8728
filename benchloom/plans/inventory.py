"""Inventories and set comparisons over parts, pages, suppliers, orders and events."""

from pyspark.sql import functions as F

from benchloom.functions.text import first_non_empty
from benchloom.operators import inventory as ops
from benchloom.operators import sets
from benchloom.plans.registry import query


@query(
    "split_groups",
    r"""WITH f AS (SELECT o_custkey AS folder, CASE WHEN o_orderkey % 3 = 0 THEN concat('m', o_orderkey % 4, '.gguf') ELSE
          concat('m', o_orderkey % 4, '-0000', o_orderkey % 3, '-of-0000', o_custkey % 2 + 2, '.gguf') END AS file,
          floor(o_totalprice)::bigint AS bytes FROM orders),
        s AS (SELECT folder, file, bytes, CASE WHEN regexp_matches(file, '-\d{5}-of-\d{5}\.gguf$') THEN
          regexp_replace(file, '-\d{5}-of-\d{5}\.gguf$', '.gguf') ELSE file END AS model_file,
          try_cast(regexp_extract(file, '-of-(\d{5})', 1) AS int) AS total FROM f)
        SELECT folder, model_file, count(*) AS parts, arg_min(total, file) FILTER (WHERE file = mf) AS expected, min(file) AS first_file,
          sum(bytes)::bigint AS bytes, CASE WHEN coalesce(count(*) <> arg_min(total, file) FILTER (WHERE file = mf), false) THEN 'partial'
          ELSE 'available' END AS status FROM (SELECT *, min(file) OVER (PARTITION BY folder, model_file) AS mf FROM s)
        GROUP BY folder, model_file""",
)
def _(t):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("m"), (k % 4).cast("string"))
    split = F.concat(
        name, F.lit("-0000"), (k % 3).cast("string"), F.lit("-of-0000"), (F.col("o_custkey") % 2 + 2).cast("string"), F.lit(".gguf")
    )
    files = t.orders.select(
        F.col("o_custkey").alias("folder"),
        F.when(k % 3 == 0, F.concat(name, F.lit(".gguf"))).otherwise(split).alias("file"),
        F.floor("o_totalprice").cast("bigint").alias("bytes"),
    )
    return ops.split_groups(files)


@query(
    "param_count",
    """SELECT l_orderkey, count(*) AS shards, CASE WHEN count(CASE WHEN l_linenumber = 7 THEN 1 END) = 0 THEN sum(l_partkey * l_suppkey + l_linenumber)
       END::bigint AS parameters FROM lineitem GROUP BY l_orderkey""",
)
def _(t):
    text = F.concat(
        F.lit('{"__metadata__": {"format": "pt"}, "w": {"dtype": "BF16", "shape": ['),
        F.col("l_partkey").cast("string"),
        F.lit(", "),
        F.col("l_suppkey").cast("string"),
        F.lit(']}, "b": {"shape": ['),
        F.col("l_linenumber").cast("string"),
        F.lit("]}}"),
    )
    shards = t.lineitem.select("l_orderkey", F.when(F.col("l_linenumber") != 7, text).otherwise("garbage").alias("header"))
    return ops.parameter_counts(shards, ["l_orderkey"])


@query("inventory_order", "SELECT s_suppkey, s_name AS name, 'registered' AS kind FROM supplier ORDER BY lower(s_name), kind")
def _(t):
    entries = t.supplier.select("s_suppkey", F.col("s_name").alias("name"), F.lit("registered").alias("kind"))
    return ops.inventory_order(entries)


@query(
    "union_inventory",
    """SELECT s_name AS name, s_suppkey AS bytes, NULL AS segment, NULL AS status, 'registered' AS kind FROM supplier UNION ALL
       SELECT c_name, NULL, c_mktsegment, NULL, 'cache' FROM customer UNION ALL
       SELECT n_name, NULL, NULL, 'unreadable', 'directory' FROM nation""",
)
def _(t):
    unreadable = t.nation.select(F.col("n_name").alias("name"), F.lit("directory").alias("kind"))
    return ops.union_inventory(
        {
            "registered": t.supplier.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("bytes")),
            "cache": t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment")),
        },
        unreadable,
    )


_PATH = r"regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '')"


def page_paths(t):
    path = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return t.pages.select("page_id", path.alias("path"))


@query(
    "select_files_glob",
    rf"""SELECT page_id, path FROM (SELECT page_id, {_PATH} AS path FROM pages) WHERE
        (regexp_matches(path, '^[^/]*\.example\.com(/[^/]*)*$') OR regexp_matches(path, '^([^/]*/)*en/[^/]*$'))
        AND NOT regexp_matches(path, '^([^/]*/)*[^/]*7$')""",
)
def _(t):
    return ops.select_files(page_paths(t), "path", ["*.example.com/**", "**/en/*"], ["**/*7"])


@query(
    "check_paths",
    rf"""WITH n AS (SELECT CASE WHEN page_id % 20 = 0 THEN '../' || p WHEN page_id % 20 = 1 THEN split_part(p, '/', 1) ELSE p END AS path
          FROM (SELECT page_id, {_PATH} AS p FROM pages)), d AS (SELECT path, count(*) AS n FROM n GROUP BY path)
        SELECT path, 'unsafe' AS problem FROM d WHERE path LIKE '../%' OR path LIKE '%/' UNION ALL
        SELECT path, 'duplicate' FROM d WHERE n > 1 UNION ALL
        SELECT path, 'collision' FROM d WHERE EXISTS (SELECT 1 FROM d x WHERE starts_with(x.path, d.path || '/'))""",
)
def _(t):
    p, k = F.col("path"), F.col("page_id")
    rows = page_paths(t).select(
        F.when(k % 20 == 0, F.concat(F.lit("../"), p)).when(k % 20 == 1, F.split_part(p, F.lit("/"), F.lit(1))).otherwise(p).alias("path")
    )
    return ops.check_paths(rows)


@query(
    "integrity_check",
    """SELECT doc_id, CASE WHEN lang = 'de' THEN 'missing' WHEN doc_id % 5 = 0 THEN 'changed' ELSE 'ok' END AS status FROM documents""",
)
def _(t):
    k = F.col("doc_id")
    expected = t.documents.select(
        "doc_id", F.octet_length("text").alias("size"), F.sha2("text", 256).alias("sha256")
    )
    now = F.when(k % 5 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    actual = t.documents.where(F.col("lang") != "de").select("doc_id", F.octet_length(now).alias("size"), F.sha2(now, 256).alias("sha256"))
    return ops.integrity_check(expected, actual, "doc_id").select("doc_id", "status")


@query(
    "canonical_prompt_match",
    """SELECT d.doc_id, b.item_id AS prompt_id, sha256(CASE WHEN d.doc_id % 2 = 0 THEN x.text ELSE d.text END) AS prompt_hash,
         d.n_chars AS output_tokens, b.item_id IS NOT NULL AND d.n_chars >= 256 AS verified
       FROM documents d JOIN benchmark x ON x.item_id = d.doc_id % 40
       LEFT JOIN benchmark b ON b.text = CASE WHEN d.doc_id % 2 = 0 THEN x.text ELSE d.text END""",
)
def _(t):
    shown = t.documents.select("doc_id", "text", "n_chars", (F.col("doc_id") % 40).alias("item_id")).join(
        t.benchmark.select("item_id", F.col("text").alias("_b")), "item_id"
    )
    runs = shown.select(
        "doc_id",
        F.when(F.col("doc_id") % 2 == 0, F.col("_b")).otherwise(F.col("text")).alias("prompt"),
        F.col("n_chars").alias("output_tokens"),
    )
    known = t.benchmark.select(F.col("item_id").alias("prompt_id"), "text", F.lit(256).alias("min_output_tokens"))
    return ops.canonical_prompt_match(runs, known)


@query(
    "hardware_dimension",
    """WITH h AS (SELECT p_partkey % 4 AS k, p_brand AS b, p_size AS s, p_type AS ty FROM part)
       SELECT label, hw_class, slots, count(*) AS runs FROM (SELECT CASE k WHEN 0 THEN concat(b, ' ', s, 'GB + ', ty) WHEN 1 THEN
         concat('2x ', b, ' ', s, '.5GB') WHEN 2 THEN concat('Apple ', ty, ' ', s, 'GB') ELSE concat('cpu ', ty) END AS label,
         CASE k WHEN 2 THEN 'UNIFIED' WHEN 3 THEN 'CPU_ONLY' ELSE 'DISCRETE_GPU' END AS hw_class, CASE k WHEN 0 THEN 2 ELSE 0 END AS slots
         FROM h) GROUP BY ALL""",
)
def _(t):
    k = F.col("p_partkey") % 4
    slot = lambda name, gb: F.struct(name.alias("name"), gb.cast("double").alias("vram_gb"), F.lit(1).alias("count"))
    none = F.lit(None).cast("string")
    empty = slot(F.lit(""), F.lit(0))
    runs = t.part.select(
        F.when(
            k == 0, F.array(slot(F.col("p_brand"), F.col("p_size")), slot(F.col("p_type"), F.lit(0)))
        ).alias("gpus"),
        F.when(k == 1, F.col("p_brand")).alias("gpu_name"),
        F.when(k == 1, 2.0).alias("gpu_count"),
        F.when(k == 1, F.col("p_size") + 0.5).alias("vram_gb"),
        F.when(k == 2, "Apple").alias("chip_vendor"),
        F.when(k == 2, F.col("p_type")).alias("chip_family"),
        none.alias("chip_variant"),
        F.when(k == 2, F.col("p_size").cast("double")).alias("unified_gb"),
        F.concat(F.lit("cpu "), "p_type").alias("cpu"),
        empty.alias("_empty"),
    ).drop("_empty")
    return ops.hardware_dimension(runs)


_COMMANDS = """SELECT doc_id, concat('serve --api-key ', lang, 'abc --hf_token=''x y'' --port 80 --max-tokens 5 --admin-password="', source,
  '" ', text) AS cmd FROM documents"""


@query(
    "redact_secrets",
    f"""SELECT doc_id, sha256(regexp_replace(cmd, '(?i)(--(?:[\\w-]*-)?(?:key|token|secret|password))(=|\\s+)(''[^'']*''|"[^"]*"|[^\\s-]\\S*)',
        '\\1\\2<redacted>', 'g')) AS cmd_hash,
        concat('--api-key ', '<redacted> --x=', source, ' --my-token=<redacted> --secret --port 1') AS argv
        FROM ({_COMMANDS})""".replace("source, ' --my", "doc_id, ' --my"),
)
def _(t):
    command = F.concat(
        F.lit("serve --api-key "),
        "lang",
        F.lit("abc --hf_token='x y' --port 80 --max-tokens 5 --admin-password=\""),
        "source",
        F.lit('" '),
        "text",
    )
    k = F.col("doc_id").cast("string")
    argv = F.array(
        F.lit("--api-key"), F.col("source"), F.concat(F.lit("--x="), k), F.concat(F.lit("--my-token="), "lang"),
        F.lit("--secret"), F.lit("--port"), F.lit("1"),
    )
    return t.documents.select(
        "doc_id",
        F.sha2(ops.redact_command(command), 256).alias("cmd_hash"),
        F.array_join(ops.redact_arguments(argv), " ").alias("argv"),
    )


def matrix_reports(t):
    """One report per order: its lines are decode cells with bulky parts."""
    cell = F.struct(
        (F.col("l_linenumber") * 1024).alias("context_tokens"),
        F.col("l_suppkey").alias("concurrency"),
        F.col("l_extendedprice").alias("aggregate_tps"),
        F.col("l_quantity").alias("ttft_ms"),
        F.repeat(F.lit("x"), 200).alias("request_samples"),
    )
    cells = t.lineitem.groupBy("l_orderkey").agg(F.collect_list(cell).alias("cells"))
    engine = F.when(F.col("l_orderkey") % 5 == 0, "openai_proxy").when(F.col("l_orderkey") % 5 == 1, "sglang").otherwise("vllm")
    document = F.concat(
        F.lit('{"metadata": {"engine": "'), engine, F.lit('"}, "prefill": {"1024": {"tok_s": 5.5, "loop_diagnostics": [1]}}, "results": '),
        F.to_json("cells"),
        F.lit("}"),
    )
    return cells.select("l_orderkey", document.alias("document"))


@query(
    "trim_cells",
    """SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 1 THEN 'sglang' ELSE 'vllm' END AS engine, 'decode' AS phase, (l_linenumber *
         1024)::bigint AS context_tokens, l_suppkey AS concurrency, l_extendedprice AS aggregate_tps, l_quantity AS ttft_ms FROM lineitem
         WHERE l_orderkey % 5 > 0 UNION ALL
       SELECT DISTINCT l_orderkey, CASE WHEN l_orderkey % 5 = 1 THEN 'sglang' ELSE 'vllm' END, 'prefill', 1024, NULL, 5.5, NULL FROM
         lineitem WHERE l_orderkey % 5 > 0""",
)
def _(t):
    return ops.trim_cells(matrix_reports(t))


@query(
    "coalesce_aliases",
    """SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_brand WHEN p_partkey % 5 > 0 THEN p_type ELSE '' END AS id FROM part""",
)
def _(t):
    rows = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise("").alias("question_id"),
        F.lit(None).cast("string").alias("questionId"),
        F.when(F.col("p_partkey") % 5 > 0, F.col("p_type")).alias("id"),
    )
    return rows.select("p_partkey", first_non_empty([F.col("question_id"), F.col("questionId"), F.col("id")]).alias("id"))


@query(
    "merge_warnings",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'O|late' ELSE concat(o_orderstatus, '|O|late') END AS warnings FROM orders
       WHERE o_orderpriority <> '2-HIGH' UNION ALL
       SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'O' ELSE concat(o_orderstatus, '|O') END FROM orders WHERE
       o_orderpriority = '2-HIGH'""",
)
def _(t):
    rows = t.orders.select(
        "o_orderkey",
        F.array(F.concat(F.col("o_orderstatus"), F.lit(" ")), F.lit("O"), F.lit("  ")).alias("first"),
        F.when(
            F.col("o_orderpriority") != "2-HIGH", F.array(F.lit("O"), F.lit("late\n"), F.lit(None).cast("string"))
        ).alias("second"),
    )
    return sets.merge_warnings(rows, ["first", "second"]).select(
        "o_orderkey", F.array_join("warnings", "|").alias("warnings")
    )


@query(
    "set_mismatch",
    """WITH s AS (SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN '' ELSE p_type END AS cli, lower(p_type) AS filename,
         CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS models FROM part)
       SELECT p_partkey, 'cli' AS left_source, cli AS left, 'models' AS right_source, models AS right FROM s WHERE cli <> '' AND
         models IS NOT NULL UNION ALL SELECT p_partkey, 'filename', filename, 'models', models FROM s WHERE models IS NOT NULL""",
)
def _(t):
    rows = t.part.select(
        "p_partkey",
        F.when(F.col("p_size") % 3 == 0, "").otherwise(F.col("p_type")).alias("cli"),
        F.lower("p_type").alias("filename"),
        F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("models"),
    )
    return sets.set_mismatch(rows, "p_partkey", ["cli", "filename", "models"])


def fingerprints(t):
    def long(df):
        entries = F.array(
            *[F.struct(F.lit(n).alias("field"), F.col(n).cast("string").alias("value")) for n in ("status", "priority", "hardware")]
        )
        return df.select("o_orderkey", F.explode(entries).alias("e")).select("o_orderkey", "e.*").where("value is not null")

    k = F.col("o_orderkey")
    expected = t.orders.where(F.col("o_orderpriority") != "1-URGENT").select(
        "o_orderkey",
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.when(k % 4 > 0, "none").alias("hardware"),
    )
    actual = t.orders.select(
        "o_orderkey",
        F.when(k % 3 == 0, "F").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(k % 7 > 0, F.col("o_orderpriority")).alias("priority"),
        F.when(k % 5 == 0, "gpu").otherwise("none").alias("hardware"),
    )
    return long(expected), long(actual)


_CHANGES = """SELECT o_orderkey, 'status' AS field, 'changed' AS change FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 3 = 0 AND
    o_orderstatus <> 'F' UNION ALL SELECT o_orderkey, 'priority', 'removed' FROM orders WHERE o_orderpriority <> '1-URGENT' AND o_orderkey % 7 = 0
  UNION ALL SELECT o_orderkey, 'hardware', CASE WHEN o_orderkey % 4 = 0 THEN 'added' ELSE 'changed' END FROM orders WHERE
    o_orderpriority <> '1-URGENT' AND (o_orderkey % 4 = 0 OR o_orderkey % 5 = 0)"""


@query("changed_fields", _CHANGES)
def _(t):
    return sets.changed_fields(*fingerprints(t), ["o_orderkey", "field"])


@query(
    "added_only",
    f"""SELECT o_orderkey FROM ({_CHANGES}) GROUP BY o_orderkey HAVING count(*) = 1 AND min(field) = 'hardware' AND o_orderkey % 4 > 0""",
)
def _(t):
    expected, actual = fingerprints(t)
    changes = sets.changed_fields(expected, actual, ["o_orderkey", "field"])
    return sets.added_only(changes, expected, "o_orderkey", "field", "hardware", "none")


@query(
    "covered_intersection",
    """SELECT count(*) = 0 AS same, count(*) AS differing FROM (SELECT k FROM (SELECT l_orderkey AS k, 1 AS d FROM lineitem UNION ALL
       SELECT o_orderkey, -1 FROM orders) GROUP BY k HAVING sum(d) <> 0)""",
)
def _(t):
    return sets.same_set(
        t.lineitem.select(F.col("l_orderkey").alias("task")), t.orders.select(F.col("o_orderkey").alias("task")), "task"
    )
