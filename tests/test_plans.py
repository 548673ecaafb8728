"""Plan shape: nothing leaves the JVM that need not, no all-pairs joins, scans read what they need."""

import re

import pytest

import __spark_entry__ as entry_points
from tests_data import SMALL

QUERIES = entry_points.queries()
# Nested documents of any depth, shared words and state per key have no built-in form.
PYTHON = {
    "metric_by_alias",
    "flatten_document",
    "redact_labels",
    "score_f1",
}
STREAMS = {n for n in QUERIES if n.startswith("stream_") or n == "sink_status_log"}


def plan_of(spark, name):
    return QUERIES[name](spark, SMALL)._jdf.queryExecution().toString()


@pytest.mark.parametrize(
    "name",
    ["answer_extraction", "score_items", "log_metrics", "audit_items", "normalize_messages", "settle_usage", "decode_upper_bound",
     "truncate_bytes", "trace_summary", "label_mask", "nearest_vocab", "hardware_dimension"],
)
def test_stays_in_the_jvm(spark, name):
    assert not re.search(r"EvalPython|MapInPandas|FlatMapGroups", plan_of(spark, name))


@pytest.mark.parametrize("name", ["nearest_vocab", "missing_shards", "gold_leak_join", "source_candidates", "coverage_catalog", "join_grades"])
def test_no_all_pairs(spark, name):
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin", plan_of(spark, name))


def test_filters_and_columns_reach_the_scan(spark):
    from pyspark.sql import functions as F

    from benchloom.operators.runs import filter_runs

    runs = spark.read.parquet(f"{SMALL}/events.parquet").withColumnRenamed("event_type", "mode")
    plan = filter_runs(runs, mode="click").where(F.col("user_id") == 3).select("event_id")._jdf.queryExecution().toString()
    assert "EqualTo(user_id,3)" in plan
    assert "props" not in re.search(r"ReadSchema: (.*)", plan).group(1)


def test_listing_reads_no_content(spark):
    from benchloom.sources.readers import scan_manifest

    plan = scan_manifest(spark, SMALL)._jdf.queryExecution().toString()
    assert "content" not in re.search(r"ReadSchema: (.*)", plan.split("Physical Plan")[1]).group(1)


def test_newest_takes_the_top_in_each_task(spark):
    assert "TakeOrderedAndProject" in plan_of(spark, "newest_runs")


def test_first_of_key_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan_of(spark, "dedupe_first")
    assert "WindowGroupLimit" in plan_of(spark, "balanced_sample")
