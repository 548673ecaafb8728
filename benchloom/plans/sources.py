"""Sources and sinks: files written from the tables and read back."""

from pyspark.sql import functions as F

from benchloom.plans.registry import query
from benchloom.plans.training import messages, records, trace_lines
from benchloom.session import new_path
from benchloom.sources import readers, writers


@query(
    "scan_runs",
    """SELECT cast(s_suppkey AS bigint) AS run, s_name AS model, CASE WHEN s_suppkey % 3 > 0 THEN s_acctbal END AS tok_s_out
       FROM supplier WHERE s_suppkey % 7 > 0""",
)
def _(t):
    k = F.col("s_suppkey")
    inner = F.struct(k.alias("id"), F.col("s_name").alias("hfId"), F.when(k % 3 > 0, F.col("s_acctbal")).alias("tokSOut"))
    good = F.when(k % 2 == 0, F.to_json(F.struct(inner.alias("payload")))).otherwise(F.to_json(inner))
    path = new_path(t.spark, "runs")
    writers.write_documents(t.supplier.select(F.when(k % 7 == 0, "[1, 2").otherwise(good).alias("value")), path)
    runs = readers.scan_runs(t.spark, path)
    return readers.typed_head(runs, {"run": "id bigint", "model": "hfId string", "tok_s_out": "tokSOut double"}).select(
        "run", "model", "tok_s_out"
    )


@query(
    "scan_run_lines",
    "SELECT event_id AS run, event_type AS quantization, value AS tok_s_out FROM events",
)
def _(t):
    path = new_path(t.spark, "run-lines")
    doc = F.struct(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("quantization"), F.col("value").alias("tokSOut")).alias("payload"))
    t.events.select(F.to_json(doc)).write.text(path)
    runs = readers.scan_run_lines(t.spark, path)
    head = readers.typed_head(runs, {"run": "id bigint", "quantization": "quantization string", "tok_s_out": "tokSOut double"})
    return head.select("run", "quantization", "tok_s_out")


_ITEM = "item_id bigint, input string, gold string"


@query(
    "scan_items",
    """SELECT form, item_id, input, gold FROM (SELECT item_id, text AS input, concat('g', item_id) AS gold FROM benchmark),
       (VALUES ('csv'), ('jsonl')) v(form)""",
)
def _(t):
    path = new_path(t.spark, "items")
    rows = t.benchmark.select("item_id", F.col("text").alias("input"), F.concat(F.lit("g"), F.col("item_id")).alias("gold"))
    rows.withColumnRenamed("input", " input ").write.option("header", True).option("escape", '"').csv(path + "/csv")
    rows.write.json(path + "/jsonl")
    tagged = lambda form: readers.scan_items(t.spark, f"{path}/{form}", _ITEM, form).withColumn("form", F.lit(form))
    return tagged("csv").unionByName(tagged("jsonl"))


@query(
    "scan_items_auto",
    """SELECT lang, form, doc_id, source FROM documents, (VALUES ('array'), ('lines')) v(form)""",
)
def _(t):
    path = new_path(t.spark, "auto")
    rows = t.documents.select("doc_id", "lang", "source")
    # One array per language: a file of this form is one document.
    arrays = rows.groupBy("lang").agg(F.to_json(F.collect_list(F.struct("doc_id", "lang", "source"))).alias("value"))
    arrays.select("value", F.col("lang").alias("file")).write.partitionBy("file").text(path + "/array")
    rows.write.json(path + "/lines")
    schema = "doc_id bigint, lang string, source string"
    tagged = lambda form: readers.scan_items_auto(t.spark, f"{path}/{form}", schema).withColumn("form", F.lit(form))
    return tagged("array").unionByName(tagged("lines"))


@query(
    "resolve_item_source",
    """SELECT 'inline' AS task, text AS input, cast(item_id AS varchar) AS gold, 'a|b' AS choices FROM benchmark UNION ALL
       SELECT lang, text, source, NULL FROM documents UNION ALL
       SELECT 'remote', CASE WHEN page_id % 2 = 0 THEN url ELSE 'p' END, cast(page_id AS varchar), NULL FROM pages""",
)
def _(t):
    item = F.struct(
        F.col("text").alias("input"),
        F.col("item_id").cast("string").alias("gold"),
        F.array(F.lit("a"), F.lit("b")).alias("choices"),
    )
    inline = t.benchmark.select(F.lit("inline").alias("task"), F.array(item).alias("items"))
    files = t.documents.select(
        F.col("lang").alias("task"), F.col("text").alias("input"), F.col("source").alias("gold"), F.lit(None).cast("array<string>").alias("choices")
    )
    row = F.struct(
        F.when(F.col("page_id") % 2 == 0, F.col("url")).otherwise("").alias("question"),
        F.lit("p").alias("prompt"),
        F.col("page_id").cast("string").alias("label"),
    )
    remote = t.pages.select(F.lit("remote").alias("task"), row.alias("row"))
    got = readers.resolve_item_source(inline, files, remote)
    return got.select("task", "input", "gold", F.array_join("choices", "|").alias("choices"))


@query(
    "scan_matrix",
    """SELECT 'vllm' AS engine, s_nationkey::bigint AS nation, max(s_acctbal) AS best, count(*) AS cells,
       s_nationkey % 2 = 0 AS wrapped FROM supplier GROUP BY s_nationkey""",
)
def _(t):
    path = new_path(t.spark, "matrix")
    cells = t.supplier.groupBy("s_nationkey").agg(
        F.collect_list(F.struct(F.lit(0).alias("context_tokens"), F.col("s_acctbal").alias("aggregate_tps"))).alias("results")
    )
    report = F.struct(
        F.struct(F.lit("vllm").alias("engine"), F.col("s_nationkey").alias("nation")).alias("metadata"), "results"
    )
    wrapped = F.struct(
        F.lit("lil-bench-result/1").alias("schema"),
        F.struct(report.alias("bench")).alias("results"),
        F.struct(F.lit("GPU").alias("gpuName")).alias("hardware"),
    )
    text = F.when(F.col("s_nationkey") % 2 == 0, F.to_json(wrapped)).otherwise(F.to_json(report))
    cells.select(text.alias("value"), F.col("s_nationkey").alias("run")).repartition(8, "run").write.option(
        "compression", "gzip"
    ).partitionBy("run").text(path)
    rows = readers.scan_matrix(t.spark, path, "*.txt.gz")
    shape = "metadata struct<engine:string,nation:bigint>, results array<struct<aggregate_tps:double>>"
    d = rows.select(F.from_json("document", shape).alias("d"), F.col("hardware").isNotNull().alias("wrapped"))
    return d.select(
        "d.metadata.engine",
        "d.metadata.nation",
        F.array_max(F.transform("d.results", lambda c: c["aggregate_tps"])).alias("best"),
        F.size("d.results").cast("bigint").alias("cells"),
        "wrapped",
    )


@query(
    "scan_traces",
    """WITH e AS (SELECT conv_id * 31 + turn AS k, length(text) AS n FROM conversations)
       SELECT count(CASE WHEN k % 13 > 1 THEN 1 END) AS ok, count(CASE WHEN k % 13 = 0 THEN 1 END) AS malformed, count(CASE WHEN k % 13 = 1 THEN 1 END) AS blank, 0::bigint AS oversized FROM e""",
)
def _(t):
    path = new_path(t.spark, "traces")
    trace_lines(t).select("line").repartition(8).write.text(path)
    rows = readers.scan_traces(t.spark, path, glob="*.txt")
    of = lambda s: F.count_if(F.col("state") == s).alias(s)
    return rows.agg(of("ok"), of("malformed"), of("blank"), of("oversized"))


@query(
    "scan_harness_results",
    """SELECT n_nationkey::bigint AS nation, CASE WHEN n_regionkey = 0 THEN 'missing' WHEN n_nationkey % 2 = 0 THEN 'ok' ELSE 'ambiguous' END AS
       status, CASE WHEN n_regionkey > 0 AND n_nationkey % 2 = 0 THEN n_nationkey / 100.0 END::double AS acc FROM nation""",
)
def _(t):
    path = new_path(t.spark, "harness")
    k = F.col("n_nationkey")
    text = F.concat(F.lit('{"results": {"my_task": {"acc,none": '), (k / 100).cast("string"), F.lit('}}, "groups": {"my-task": {}}}'))
    rows = t.nation.where(F.col("n_regionkey") > 0).select(text.alias("value"), k.alias("nation"), F.explode(F.sequence(F.lit(1), k.cast("int") % 2 + 1)).alias("copy"))
    rows.repartition(8, "nation", "copy").write.partitionBy("nation", "copy").text(path)
    # Spark names its part files itself; they stand for the harness file their folders tell.
    shown = F.regexp_replace("path", r"^.*/nation=(\d+)/copy=(\d+)/.*$", "/out/$1/results_$2.json")
    files = readers.whole_files(t.spark, path, "*.txt").select(shown.alias("path"), "text")
    tasks = t.nation.select(F.col("n_nationkey").cast("string").alias("folder"), F.lit("my-task").alias("task"))
    got = readers.harness_results(files, tasks)
    return got.select(
        F.col("folder").cast("bigint").alias("nation"),
        "status",
        F.get_json_object("metrics", "$['acc,none']").cast("double").alias("acc"),
    )


@query("scan_manifest")
def _(t):
    return readers.scan_manifest(t.spark, t.folder, "*.parquet").select("file", "bytes")


@query("file_integrity")
def _(t):
    from benchloom.operators.inventory import integrity_check

    listed = readers.scan_range_hashes(t.spark, t.folder, "*.parquet")
    return integrity_check(listed, readers.scan_range_hashes(t.spark, t.folder, "*.parquet")).select("path", "status")


@query(
    "sink_json",
    """SELECT path, hf_id AS model, tok_s_out, json_extract(props, '$.k')::varchar AS k FROM runs""",
)
def _(t):
    path = new_path(t.spark, "export-json")
    writers.write_json(t.runs, ["path", "model", "tok_s_out", "k"], path)
    return t.spark.read.schema("path string, model string, tok_s_out double, k string").json(path)


@query(
    "sink_csv",
    """SELECT path, hf_id AS model, CASE WHEN tok_s_out = floor(tok_s_out) THEN cast(tok_s_out::bigint AS varchar) ELSE
       cast(tok_s_out AS varchar) END AS tok_s_out, json_extract_string(props, '$.k') AS k FROM runs""",
)
def _(t):
    path = new_path(t.spark, "export-csv")
    writers.write_csv(t.runs, ["path", "model", "tok_s_out", "k", "nothing"], path)
    rows = t.spark.read.option("header", True).csv(path)
    return rows.select("path", "model", "tok_s_out", "k")


@query("sink_jsonl_split")
def _(t):
    path = new_path(t.spark, "training")
    writers.write_training_split(records(t), messages(t), path, "seq", limit=1024)
    sft = t.spark.read.schema("id bigint, messages array<struct<role:string,content:string>>").json(path + "/sft")
    failures = t.spark.read.schema("id bigint").json(path + "/failures")
    manifest = t.spark.read.schema("sft_examples bigint, failure_examples bigint").json(path + "/manifest")
    counts = sft.agg(F.count(F.lit(1)).alias("sft_rows"), F.sum(F.size("messages")).alias("messages"))
    return manifest.join(counts, F.lit(True)).join(failures.agg(F.count(F.lit(1)).alias("failure_rows")), F.lit(True))
